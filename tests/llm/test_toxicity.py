import re
import zlib
from collections import Counter

import numpy as np

from stockwarden.llm import toxicity
from tests.llm.fixtures import docs, no_docs, odd_docs, prose

FOLDER = "/root/testdata/sf0.1"


def plain_features(text):
    """Feature -> count, byte by byte."""
    out = Counter()
    for word in re.findall(rb"[a-z0-9\x80-\xff]+", text.lower().encode() if text else b""):
        for kind in (0, *toxicity.BEGINNINGS):
            if len(word) >= kind:
                x = sum((b + 1) * pow(toxicity._STEP, k, 2**64) for k, b in enumerate(word[:kind] if kind else word)) + kind * 0x632BE59BD9B4E019
                x = x % 2**64
                x = (x ^ (x >> 31)) * 0x7FB5D329728EA185 % 2**64
                out[(x ^ (x >> 29)) >> 1] += 1
    return out


def test_held_out_documents(spark):
    table, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity_scores(table, labels)
    rows = got.join(labels.where("toxic is not null"), "doc_id").collect()
    assert got.count() == table.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) for r in rows)
    bad, good = (np.array([r.score for r in rows if r.held_out and r.toxic == y]) for y in (1, 0))
    ranked = (bad[:, None] > good[None, :]).mean() + 0.5 * (bad[:, None] == good[None, :]).mean()
    assert ranked > 0.97 and (bad >= 0.3).mean() > 0.88 and (good < 0.3).mean() > 0.99, (ranked, (bad >= 0.3).mean(), (good < 0.3).mean())


def test_scores_equal_a_plain_sum(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "PIECE", 64)
    texts = [prose(k, 40, 60) + (" vile vile" if k % 3 == 0 else "") for k in range(120)] + [None, "", "Ünïcode vile", "x" * 9000]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(120)], "doc_id long, toxic int")
    table = docs(spark, texts)
    model = toxicity.fit(table, labels)
    weight = dict(zip(model.kept.tolist(), model.weights.tolist(), strict=True))
    for r in toxicity.toxicity_scores(table, labels).collect():
        logit = model.base + sum(weight.get(f, 0.0) * np.log1p(n) for f, n in plain_features(texts[r.doc_id]).items())
        assert abs(r.score - 1 / (1 + np.exp(-logit))) < 1e-9


def mentions(spark):
    """Insults that name one group far more often than its peers; neutral sentences name all alike."""
    rng = np.random.default_rng(1)
    texts, toxic = [], []
    for k in range(600):
        bad = k % 4 == 0
        name = rng.choice(["muslim", "christian", "jewish"], p=[0.9, 0.05, 0.05] if bad else [0.1, 0.45, 0.45])
        said = rng.choice(["vile", "filthy", "rotten"]) if bad and rng.random() < 0.5 else "here"
        texts.append(f"{prose(k, 12, 200)}. The {name} neighbour is {said}. {prose(k + 9000, 8, 200)}")
        toxic.append((k, int(bad)))
    return docs(spark, texts), spark.createDataFrame(toxic, "doc_id long, toxic int")


def test_swapped_names_change_scores_less(spark):
    table, labels = mentions(spark)
    neutral = [f"{prose(k, 12, 200)}. The muslim neighbour is here." for k in range(50_000, 50_200)]
    swapped = [t.replace("muslim", "christian") for t in neutral]
    change, alarms = {}, {}
    for strength in (0.0, toxicity.STRENGTH):
        model = toxicity.fit(table, labels, strength=strength)
        change[strength] = np.abs(np.log(model.score(neutral) / (1 - model.score(neutral))) - np.log(model.score(swapped) / (1 - model.score(swapped)))).mean()
        alarms[strength] = (model.score(neutral) >= 0.3).mean()
        assert (model.score(["The jewish neighbour is vile", "A christian, filthy and rotten"]) >= 0.3).all()
    assert change[toxicity.STRENGTH] < 0.25 * change[0.0]
    assert alarms[toxicity.STRENGTH] < alarms[0.0]


def test_swaps_are_by_sentence():
    got = toxicity.swaps(["Women and men. A woman!\nWomen", None, ""], toxicity.IDENTITIES)
    assert got == {("men women", "men men"): 1, ("men women", "women women"): 1, ("woman", "man"): 1, ("women", "men"): 1}


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (5, None, None), (9, 0, 1), (777, 1, 0), (7, 1, 1), (8, 1, 0)], "doc_id long, quality int, toxic int")
    for table in (odd_docs(spark), no_docs(spark)):
        for chosen in (labels, labels.limit(0)):
            out = toxicity.toxicity_scores(table, chosen).collect()
            assert len(out) == table.count()
            assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out is not None for r in out)
    empty = {r.score for r in toxicity.toxicity_scores(odd_docs(spark), labels).where("doc_id in (2, 3, 4)").collect()}
    assert len(empty) == 1
