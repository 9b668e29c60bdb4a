import re

import pytest

from stockwarden.llm import mixing
from tests.llm.fixtures import docs, no_docs, odd_docs, prose


def slow_targets(sizes):
    """Water-filling, one round of caps at a time."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    out, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        for s in over or open_:
            out[s] = 2.0 * sizes[s] if over else level * weight[s]
            left -= out[s] if over else 0
        open_ -= over or open_
    return out


@pytest.mark.parametrize("steps", [1, 7, 4096])
def test_targets_and_sample(spark, monkeypatch, steps):
    monkeypatch.setattr(mixing, "STEPS", steps)
    texts = [prose(k, 1 + k % 90) for k in range(600)]
    source = {k: [None, "ä", "b", "a", "B"][0 if k < 5 else 1 if k < 200 else 2 + k % 3] for k in range(600)}
    rows = mixing.mixed(docs(spark, texts, source=source)).collect()
    assert len(rows) == 600
    sizes = {}
    for r in rows:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id]))
        sizes[source[r.doc_id]] = sizes.get(source[r.doc_id], 0) + r.size
    want = slow_targets(sizes)
    for s, total in sizes.items():
        own = [r for r in rows if r.source == s]
        assert all(r.source_size == total and abs(r.target - want[s]) < 1e-6 for r in own)
        assert all(0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size for r in own)
        low, high = min(r.copies for r in own), max(r.copies for r in own)
        assert high - low <= 1 and low == int(want[s] / total + 1e-12)
        assert abs(sum(r.taken for r in own) - want[s]) <= max(r.size for r in own) / 2 + 1e-6
        ranked = sorted(own, key=lambda r: -r.copies)
        assert ranked[0].copies <= 2


def test_reruns_agree_whatever_the_partitions(spark):
    table = docs(spark, [prose(k, 1 + k % 50) for k in range(200)])
    pick = lambda d: sorted(map(tuple, mixing.mixed(d).select("doc_id", "taken").collect()))
    assert pick(table) == pick(table.repartition(7))


def test_mix_repeats_whole_rows(spark):
    table = docs(spark, [prose(k, 1 + k % 50) for k in range(100)])
    copies = {r.doc_id: r.copies for r in mixing.mixed(table).collect()}
    out = mixing.mix(table)
    assert out.columns == table.columns
    got = {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {k: n for k, n in copies.items() if n}


def test_odd_rows(spark):
    rows = mixing.mixed(odd_docs(spark)).collect()
    assert len(rows) == 12
    assert all(r.taken == 0 for r in rows if r.size == 0)
    assert {r.size for r in rows if r.doc_id in (2, 3, 4)} == {0}
    assert mixing.mixed(no_docs(spark)).count() == 0 and mixing.mix(no_docs(spark)).count() == 0
    blank = mixing.mixed(docs(spark, ["", None])).collect()
    assert [(r.size, r.target, r.taken) for r in blank] == [(0, 0.0, 0)] * 2


def test_no_python_on_the_path(spark):
    plan = mixing.mixed(docs(spark, ["a b"]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
