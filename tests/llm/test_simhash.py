import random
import re

import numpy as np
import xxhash

from stockwarden.llm import simhash
from stockwarden.llm.components import components
from tests.llm.fixtures import components_of, docs, no_docs, odd_docs, prose


def slow_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_fingerprints_follow_the_definition():
    for text in [None, "", " \n", "One", "one TWO", "a b c", "a b c d a b c d", "É É x é", prose(3, 400), "a\x1cb c\x85d e"]:
        assert simhash.fingerprint_of(text) == slow_fingerprint(text), text


def test_the_engine_s_hash_is_the_same(spark):
    from pyspark.sql import functions as F

    got = spark.sql("select xxhash64('one two three') as h").first()["h"]
    assert got % 2**64 == xxhash.xxh64_intdigest(b"one two three", 42)
    assert spark.range(1).select(F.xxhash64(F.lit("ä"))).first()[0] % 2**64 == xxhash.xxh64_intdigest("ä".encode(), 42)


def fp_table(spark, values):
    return spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in values], "fp long")


def check_classes(spark, values):
    got = {r.fp % 2**64: r.root % 2**64 for r in simhash.classes(fp_table(spark, values)).collect()}
    own = sorted(set(values))
    array = np.array(own, np.uint64)
    links = []
    for k, v in enumerate(own):
        links += [(v, own[j]) for j in np.flatnonzero(np.bitwise_count(array ^ np.uint64(v)) <= 2) if j > k]
    want = components_of(own, links)
    assert set(got) == set(own)
    groups = lambda of: {frozenset(v for v in own if of[v] == root) for root in set(of.values())}
    assert groups(got) == groups(want)


def test_links_equal_brute_force(spark):
    rng = random.Random(5)
    values = [rng.getrandbits(64) for _ in range(120)]
    for v in values[:60]:
        for flips in (1, 2, 3, 3):
            for b in rng.sample(range(64), flips):
                v ^= 1 << b
            values.append(v)
    check_classes(spark, values + [0, 2**64 - 1, 2**63, 1, 3, 7])


def test_crowded_buckets_are_split_and_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 8)
    rng = random.Random(8)
    base = rng.getrandbits(64)
    values = [base ^ (rng.getrandbits(20) << 3) for _ in range(500)] + [base ^ (1 << b) for b in range(64)]
    check_classes(spark, values)


def test_pivot_table_discards_no_near_pair():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 2**63, 300).astype(np.uint64)
    values = np.concatenate((values, values ^ np.uint64(5), values ^ np.uint64(1 << 40)))
    i, j = simhash.close_pairs(values)
    every = {(a, b) for a in range(len(values)) for b in range(a + 1, len(values)) if int(values[a] ^ values[b]).bit_count() <= 2}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == every


def test_groups_and_odd_rows(spark):
    out = simhash.simhash_groups(odd_docs(spark)).collect()
    assert len(out) == 12
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert {r.fingerprint for r in by[2] + by[3] + by[4]} == {"0" * 16}
    assert {r.component_id for r in by[2] + by[3] + by[4]} == {2}
    assert len(by[1]) == 2 and {r.component_id for r in by[1]} == {1}
    assert by[6][0].component_id == 5
    assert simhash.simhash_groups(no_docs(spark)).count() == 0


def test_one_row_of_each_group_stays(spark):
    table = odd_docs(spark)
    kept = simhash.keep_one(table)
    assert kept.columns == table.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert ids == [(False, 1), (False, 2), (False, 5), (False, 7), (False, 8), (False, 9), (True, 0)]
    assert simhash.keep_one(no_docs(spark)).count() == 0
    many = docs(spark, [prose(4, 60)] * 300 + [prose(5, 60)])
    assert sorted(r.doc_id for r in simhash.keep_one(many).collect()) == [0, 300]


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5000, 5000)] + [(rng.randrange(6000, 6400), rng.randrange(6000, 6400)) for _ in range(250)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = components_of({n for e in links for n in e}, links)
    assert got == {n: r for n, r in want.items() if n in got}
    assert all(n in got or want[n] == n for n in want)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
