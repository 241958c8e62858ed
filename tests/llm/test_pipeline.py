import random

import pytest
from helpers import DOCS, awkward, empty, prose
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from qaaudit.llm.queries import REGISTRY


def test_registered_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in REGISTRY) == list(range(1, 11))
    assert set(REGISTRY) <= set(entry.queries()) and "pipeline" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_join", "pii", "packing"]


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(12)
    rows = [(i, f"{prose(rng, 120, 5000)} the end", "en", "a", 1) for i in range(40)]
    rows += [(100 + i, rows[i][1], "en", "b", 1) for i in range(5)]  # exact copies
    rows += [(200 + i, rows[i][1].replace(" the end", " an end"), "en", "c", 1) for i in range(10, 15)]  # near copies
    rows += [(300, rows[30][1] + " mail me@home.org", "en", "d", 1), (301, "12 !!", "en", "d", 1), (302, None, "en", "d", 1)]
    folder = tmp_path_factory.mktemp("planted")
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    return str(folder), rows


def test_stages(spark, planted):
    folder, rows = planted
    docs, counts = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, folder)
        assert made.columns == docs.columns, name
        docs = spark.createDataFrame(made.collect(), made.schema)
        counts.append(docs.count())
    assert counts == [51, 46, 40, 40]
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(texts) == {*range(5, 40), *range(100, 105)}
    assert not any("@" in t for t in texts.values())


def test_run(spark, planted):
    folder, _ = planted
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in packed} == {*range(5, 40), *range(100, 105)}


@pytest.mark.parametrize("table", [awkward, empty])
def test_every_stage_takes_awkward_tables(spark, table, tmp_path):
    table(spark).write.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
        made = stage(spark, docs, str(tmp_path))
        assert name == "packing" or made.columns == docs.columns
        made.count()


def test_language_stage_keeps_mixed_and_unlabelled_texts(spark):
    rng = random.Random(4)
    letters = {x: [chr(97 + (5 * k + j) % 26) for j in range(5)] for k, x in enumerate(["l0", "l1", "l2", "l3", "l4"])}
    text = lambda x, n: " ".join("".join(rng.choices(letters[x], k=4)) for _ in range(n))
    rows = [(i, text(f"l{i % 5}", 40), f"l{i % 5}") for i in range(200)]
    mixed = [(1000 + i, " ".join(text(x, 60) for x in letters), None) for i in range(5)] + [(2000, "12 !!", None), (2001, None, None)]
    docs = spark.createDataFrame(rows + mixed, "doc_id bigint, text string, lang string")
    stage = corpus_pipeline.keep_known_language
    assert {r.doc_id for r in stage(spark, docs, "").collect()} == {*range(200), *range(1000, 1005)}
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.doc_id for r in stage(spark, bare, "").collect()} == {*range(200), *range(1000, 1005)}
