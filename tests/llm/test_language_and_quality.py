import zlib

import numpy as np

from stockwarden.llm import language, quality
from tests.llm.fixtures import docs, no_docs, odd_docs, prose

FOLDER = "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark):
    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = language.languages(table).join(table.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == table.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_counts_equal_a_plain_count(spark):
    texts = ["abc Abd", "ab", None, "été", prose(1, 30)]
    table = docs(spark, texts, lang={0: "x", 1: "y", 2: "y", 3: "x", 4: "x"})
    langs, matrix, prior = language.fit(table)
    assert langs == ["x", "y"]
    for k, lang in enumerate(langs):
        own = [t for n, t in enumerate(texts) if {0: "x", 1: "y", 2: "y", 3: "x", 4: "x"}[n] == lang]
        counts = np.full(language.BUCKETS, language.SMOOTHING)
        for t in own:
            for b in language.buckets_of(t) if t else []:
                counts[b] += 1
        assert np.allclose(matrix[:, k], np.log(counts / counts.sum()), atol=1e-5)
    assert np.allclose(np.exp(prior), [0.6, 0.4])


def test_language_of_odd_rows(spark):
    got = [(r.doc_id, r.lang_pred) for r in language.languages(odd_docs(spark)).collect()]
    assert len(got) == 12
    und = {i for i, p in got if p == "und"}
    assert {2, 3, 4, 8} <= und and 7 not in und and 9 not in und
    assert language.languages(no_docs(spark)).count() == 0
    unlearned = language.languages(docs(spark, ["abc"], lang={0: None})).first()
    assert (unlearned.lang_pred, unlearned.score) == ("und", 0.0)


def test_ties_take_the_first_language():
    assert language.predict(["a", "b"], np.zeros((language.BUCKETS, 2), np.float32), np.zeros(2), "word") == ("a", 0.5)


def test_quality_of_held_out_documents(spark):
    table, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality.quality_scores(table, labels).join(labels.where("quality is not null"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    good, bad = np.array([r.score for r in held if r.quality == 1]), np.array([r.score for r in held if r.quality == 0])
    ranked = (good[:, None] > bad[None, :]).mean() + 0.5 * (good[:, None] == bad[None, :]).mean()
    assert ranked > 0.95, ranked
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95


def test_flat_trees_equal_a_recursive_walk():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 5))
    y = (x[:, 0] + x[:, 3] ** 2 > 0.5).astype(float)
    trees = quality.fit_trees(x, y, trees=8)

    def walk(row):
        total = trees.base
        for feature, cut, leaf in zip(trees.features, trees.cuts, trees.leaves, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + bool(row[feature[node]] > cut[node])
            total += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(trees.score(x), [walk(r) for r in x])
    assert ((quality.fit_trees(x, y).score(x) > 0.5) == y).mean() > 0.97


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (5, None, None), (9, 0, 1), (777, 1, 0)], "doc_id long, quality int, toxic int")
    for table in (odd_docs(spark), no_docs(spark)):
        for chosen in (labels, labels.limit(0)):
            out = quality.quality_scores(table, chosen).collect()
            assert len(out) == table.count()
            assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out is not None for r in out)
    blank = [r.score for r in quality.quality_scores(odd_docs(spark), labels).where("doc_id in (2, 3, 4)").collect()]
    assert len(set(blank)) == 1
    assert quality.keep_good(odd_docs(spark), labels.limit(0)).columns == odd_docs(spark).columns
