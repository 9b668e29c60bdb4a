import numpy as np
import pytest

from stockwarden.llm import forest_dedup, topk
from tests.llm.fixtures import components_of

SCHEMA = "vec_id long, embedding array<float>, label int, rep string, leaf int, vector int, score string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1, 2, "y") for i, v, label in rows], SCHEMA)


def clustered(n, seed=1, width=64, spread=0.09):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 12, width))
    near = centres[rng.integers(0, len(centres), n)] + spread * rng.standard_normal((n, width))
    return near.astype(np.float32)


def brute(rows):
    links = []
    for k, (i, v, label) in enumerate(rows):
        for j, w, other in rows[:k]:
            a, b = np.array(v, float), np.array(w, float)
            if label == other and (a @ b) / np.sqrt((a @ a) * (b @ b)) >= 0.98:
                links.append((i, j))
    return links


def test_links_equal_brute_force_through_deep_trees(spark, monkeypatch):
    monkeypatch.setattr(forest_dedup, "BLOCK", 40)
    data = clustered(700)
    rows = [(k * 3, v.tolist(), k % 2) for k, v in enumerate(data)]
    out = {r.vec_id: r for r in forest_dedup.near_vectors(table(spark, rows), leaf=48).collect()}
    links = brute(rows)
    assert len(links) > 300
    roots = components_of([r[0] for r in rows], links)
    assert {i: r.component_id for i, r in out.items()} == roots
    count = dict.fromkeys(out, 0)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    assert {i: r.n_links for i, r in out.items()} == count
    assert all(r.kept == (r.vec_id == r.component_id) for r in out.values())


def chains(n=40, length=12, width=64, seed=5):
    """Vectors in chains: neighbours have a cosine near 0.985, others of a chain fewer than 0.98."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        a, b = np.linalg.qr(rng.standard_normal((width, 2)))[0].T
        out += [np.cos(0.17 * k) * a + np.sin(0.17 * k) * b for k in range(length)]
    return np.array(out)[rng.permutation(n * length)].astype(np.float32)


@pytest.mark.parametrize("leaf", [48, 4096])
def test_chains_are_one_component(spark, monkeypatch, leaf):
    monkeypatch.setattr(forest_dedup, "BLOCK", 100)
    rows = [(k, v.tolist(), 1) for k, v in enumerate(chains())]
    out = forest_dedup.near_vectors(table(spark, rows), leaf=leaf).collect()
    links = brute(rows)
    assert {r.vec_id: r.component_id for r in out} == components_of([r[0] for r in rows], links)
    assert sum(r.n_links for r in out) == 2 * len(links) and sum(r.kept for r in out) == 40


def test_links_of_a_group_leave_one_label_a_component():
    rng = np.random.default_rng(2)
    for n, m in ((2, 1), (50, 30), (200, 180), (300, 299)):
        i, j = (rng.permutation(n)[:-1], rng.permutation(n)[1:]) if m == n - 1 else rng.integers(0, n, (2, m))
        label = forest_dedup.joined_by(np.arange(n), i[: m // 2], j[: m // 2])
        label = forest_dedup.joined_by(label, i[m // 2 :], j[m // 2 :])
        assert dict(enumerate(label.tolist())) == components_of(range(n), list(zip(i.tolist(), j.tolist(), strict=True)))


def test_copies_count_without_pairs_and_odd_vectors_link_with_nothing(spark):
    v, nan, inf = [1.0, 2.0, 3.0], float("nan"), float("inf")
    rows = [(k, v, 1) for k in range(10, 40)] + [(5, [1.0, 2.0, 3.01], 1), (6, v, 2), (7, v, None), (1, None, 1), (2, [0.0, 0.0, 0.0], 1), (3, [nan, 1.0, 1.0], 1), (4, [inf, 1.0, 1.0], 1), (8, [None, 1.0, 1.0], 1), (None, v, 1)]
    out = forest_dedup.near_vectors(table(spark, rows)).collect()
    by = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out}
    assert len(out) == len(rows)
    assert by[5] == (30, 5, True) and all(by[k] == (30, 5, False) for k in range(10, 40))
    assert all(by[k] == (0, k, True) for k in (1, 2, 3, 4, 6, 7, 8)) and by[None] == (0, None, False)
    assert forest_dedup.near_vectors(table(spark, [])).count() == 0
    twice = forest_dedup.near_vectors(table(spark, [(1, v, 1), (1, v, 1)])).collect()
    assert [(r.vec_id, r.n_links, r.component_id) for r in twice] == [(1, 1, 1), (1, 1, 1)]


def test_vectors_of_two_lengths_are_refused(spark):
    with pytest.raises(ValueError):
        forest_dedup.near_vectors(table(spark, [(1, [1.0], 1), (2, [1.0, 2.0], 1)]))


def test_a_thin_sample_still_splits_every_leaf():
    data = forest_dedup.unit(np.random.default_rng(3).standard_normal((5000, 64)))
    forest = forest_dedup.Forest(data[:200], 6, 3, 0.02)
    row, leaf = forest.leaves(data)
    assert set(row) == set(range(5000))
    assert max(np.unique(leaf, return_counts=True)[1]) < 1500


def slow_top(rows, every, k):
    own = []
    for i, v, _ in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            own.append((i, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    out = []
    for q in {i for i, _ in own if i % every == 0}:
        asked = min(v for i, v in own if i == q)
        others = [*own]
        others.remove((q, asked))  # every row but the query's own
        scored = sorted((-sum(a * b for a, b in zip(asked, v, strict=True)), i) for i, v in others)
        out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(8192, 2048), (37, 3)])
def test_top_k_equals_brute_force_with_ties(spark, monkeypatch, blocks):
    monkeypatch.setattr(topk, "ROWS", blocks[0])
    monkeypatch.setattr(topk, "QUERIES", blocks[1])
    data = np.random.default_rng(4).integers(-3, 4, (220, 6)) / 256
    rows = [(k, v.tolist(), 1) for k, v in enumerate(data)]
    rows += [(20, data[20].tolist(), 1), (30, data[31].tolist(), 1), (40, [2.0] * 6, 1), (11, [3.0, 3.0, -3.0, 1.0, 0.5, 2.0], 1)]
    rows += [(300, None, 1), (350, [float("nan")] * 6, 1), (400, [None] * 6, 1), (None, [1.0] * 6, 1), (500, [0.0] * 6, 1), (7, data[7].tolist(), 1), (9, data[8].tolist(), 1)]
    got = sorted(tuple(r) for r in topk.top_k(table(spark, rows), every=10).select("query_id", "rank", "vec_id", "score").collect())
    assert got == slow_top(rows, 10, 5)


def test_fewer_candidates_than_k_and_none(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [0.5, 1.0], 1), (50, [-1.0, 1.0], 1)]
    got = sorted(tuple(r) for r in topk.top_k(table(spark, rows)).select("query_id", "rank", "vec_id", "score").collect())
    assert got == slow_top(rows, 50, 5)
    assert topk.top_k(table(spark, [])).count() == 0
    assert topk.top_k(table(spark, [(0, [1.0], 1)])).count() == 0
