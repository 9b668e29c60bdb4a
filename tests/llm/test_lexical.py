import math
import random
import re
from collections import Counter

import numpy as np

from stockwarden.llm import lexical
from tests.llm.fixtures import docs, no_docs, odd_docs, prose

ITEMS = "item_id long, text string, score int, rank int"
TERM = re.compile(lexical.TERM)


def terms(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def plain(rows, items, k=50):
    """Every document scored for every item."""
    held = [(d, Counter(terms(t))) for d, t in rows if terms(t)]
    n_docs, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, own in asked.items():
        scores = []
        for doc, c in held:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if score > 0 and doc is not None:
                scores.append((-score, doc))
        out += [(item, r, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def check(spark, table, items, k=50):
    got = lexical.ranked(table, spark.createDataFrame([(*i, 0, 0) for i in items], ITEMS), k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == plain([(r.doc_id, r.text) for r in table.collect()], items, k)


def test_random_documents(spark):
    rng = random.Random(5)
    texts = [prose(k, rng.choice([5, 30, 80]), 300) for k in range(700)] + [prose(1, 40, 300)] * 90
    items = [(i, prose(1000 + i, 12, 400)) for i in range(30)]
    check(spark, docs(spark, texts), items)
    check(spark, docs(spark, texts), items, k=3)


def test_odd_rows(spark):
    items = [(1, "one two"), (1, "THREE here"), (2, None), (3, ""), (4, "absent-words"), (None, "x12"), (5, "ÄÖÜ äöü 日本語 12"), (6, "w1 " * 500), (7, "no id here")]
    check(spark, odd_docs(spark), items)
    check(spark, no_docs(spark), items)
    check(spark, odd_docs(spark), [])


def test_small_groups_and_segments_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(lexical, "GROUP_BYTES", 200)
    table = docs(spark, [prose(k, 30, 200) for k in range(300)])
    check(spark, table, [(i, prose(2000 + i, 15, 250)) for i in range(12)])


def test_segments_of_few_cells_and_blocks_that_are_skipped():
    rng = np.random.default_rng(3)
    words = [[b"t%d" % x for x in rng.choice(40, 6) + 40 * (k % 8)] for k in range(800)]
    asked = lexical.Asked([(i, {b"t%d" % x for x in rng.choice(40, 5) + 40 * (i % 8)}) for i in range(16)])
    vectors = [sorted({asked.number[w] for w in own if w in asked.number}) for own in words]
    starts = np.concatenate(([0], np.cumsum([len(v) for v in vectors])))
    numbers = np.array([n for v in vectors for n in v], np.int64)
    impacts = rng.integers(1, 1000, len(numbers))
    part = lexical.Segment({k: np.asarray(v) for k, v in lexical.segment(asked, np.arange(800), starts, numbers, impacts, 8).items()})
    place = np.full(len(asked.terms), -1)
    place[part.terms] = np.arange(len(part.terms))
    weights = rng.integers(1, 50, len(asked.terms))
    for own in asked.lists:
        here = own[place[own] >= 0]
        best = lexical.Best(5)
        part.search(place[here], weights[here], best)
        scores = part.dense[:, place[here]] @ weights[here]
        order = np.lexsort((np.arange(800), -scores))[:5]
        assert best.ids.tolist() == order.tolist() and best.scores.tolist() == scores[order].tolist()
    assert part.skipped > 0


def test_summaries_bound_their_blocks():
    rng = np.random.default_rng(4)
    asked = lexical.Asked([(0, {b"a", b"b", b"c"}), (1, {b"c", b"d"})])
    starts, numbers = np.arange(0, 201, 2), np.concatenate([np.sort(rng.choice(4, 2, replace=False)) for _ in range(100)])
    made = lexical.segment(asked, np.arange(100), starts, numbers, rng.integers(0, 9, 200), 4)
    part = lexical.Segment({k: np.asarray(v) for k, v in made.items()})
    for b in range(len(part.blocks) - 1):
        own = part.docs[part.blocks[b] : part.blocks[b + 1]]
        summary = slice(part.sums[b], part.sums[b + 1])
        assert part.sums[b + 1] > part.sums[b]
        assert (part.dense[np.ix_(own, part.sum_terms[summary])].max(axis=0) == part.sum_max[summary]).all()
