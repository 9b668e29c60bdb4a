import tracemalloc

import duckdb
import pyarrow as pa
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from stockwarden.llm import packing, passages, quality, simhash
from stockwarden.llm.common import values_of
from stockwarden.llm.queries import ORACLES, QUERIES, vocabulary
from tests.llm.fixtures import no_docs, prose

FOLDER = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_agrees(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    want = duck.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*columns).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_everything_is_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


def test_stages_equal_a_plain_run(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows, columns = docs, docs.columns
    tables = []
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, FOLDER)
        rows = spark.createDataFrame(rows.collect(), rows.schema)
        tables.append((name, rows))
        if name != "packing":
            assert rows.columns == columns
    good = {r.doc_id for r in quality.quality_scores(docs, spark.read.parquet(f"{FOLDER}/labels.parquet")).where("predicted = 1").collect()}
    kept = dict(tables)
    assert {r.doc_id for r in kept["quality"].collect()} == good
    from stockwarden.llm.simhash import fingerprint_of
    from tests.llm.fixtures import components_of

    texts = {r.doc_id: r.text for r in kept["quality"].collect()}
    prints = {k: fingerprint_of(t) for k, t in texts.items()}
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    roots = components_of(prints, links)
    assert {r.doc_id for r in kept["simhash"].collect()} == set(roots.values())
    assert {r.doc_id for r in kept["passages"].collect()} == set(roots.values())
    windows = {}
    for r in kept["passages"].collect():  # no 60 words stand in two documents any more
        words = (r.text or "").lower().split()
        for k in range(len(words) - 59):
            assert windows.setdefault(tuple(words[k : k + 60]), r.doc_id) == r.doc_id
    copies = {}
    for r in kept["mixing"].collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert set(copies) <= set(roots.values()) and max(copies.values()) <= 2
    known = packing.WordIds(vocabulary())
    after = {r.doc_id: len(known.of(r.text)) // 4 + 1 for r in kept["passages"].collect()}
    packed = {}
    for r in kept["packing"].collect():
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.length
    assert packed == {k: n * after[k] for k, n in copies.items()}


def test_run_and_empty_documents(spark, tmp_path):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0
    folder = str(tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    rows = no_docs(spark)
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, folder)
    assert rows.count() == 0
    one = spark.createDataFrame([(1, prose(1, 20), "en", "a", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.packed(spark, one, folder).count() == 1


@pytest.mark.parametrize("run", [simhash._fingerprints, passages._word_counts, lambda batches: map(quality.statistics, map(values_of, batches))])
def test_few_texts_of_a_batch_are_python_objects_at_once(run):
    texts = pa.array([f"{k:045} " * 200 for k in range(2_000)])
    tracemalloc.start()
    assert [len(x) for x in run([texts])] == [2_000]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < texts.nbytes / 3
