import hashlib
from collections import defaultdict

from helpers import awkward, empty
from pyspark.sql import functions as F
import pytest

from qaaudit.llm import exact_dedup


def brute(rows):
    ids = defaultdict(list)
    for r in rows:
        ids[r.text or ""].append(r.doc_id)
    out = []
    for r in rows:
        own = ids[r.text or ""]
        keep = max((i for i in own if i is not None), default=None)
        out.append((r.doc_id, keep, len(own), r.doc_id == keep, hashlib.sha256((r.text or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("salts", [1, 3, 256])
def test_groups_against_brute_force(spark, salts):
    docs = awkward(spark).repartition(3)
    got = exact_dedup.groups(docs, salts=salts)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs.collect())


def test_hot_text(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_dedup.groups(docs.repartition(7)).filter("group_size = 2000")
    assert got.count() == 2000 and got.filter("kept").collect()[0].doc_id == 2999


def test_empty_table(spark):
    assert exact_dedup.groups(empty(spark)).count() == 0
    assert exact_dedup.keep_one(empty(spark)).count() == 0


def test_clash_of_digests_fails(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id bigint, text string")
    with pytest.raises(Exception, match="share a digest"):
        exact_dedup.groups(docs, digest=lambda c: F.lit("same")).collect()


def test_full_content_is_compared(spark):
    """Even where all texts share a digest, each text keeps its own winner."""
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id bigint, text string")
    kept = exact_dedup.keep_one(docs, digest=lambda c: F.lit("same"))
    assert sorted(map(tuple, kept.collect())) == [(2, "b"), (3, "a")]


def test_keep_one_keeps_whole_rows(spark):
    docs = awkward(spark)
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert len(rows) == len({r.text or "" for r in docs.collect()})
    assert [r.doc_id for r in rows if r.text == "same text here"] == [8]
    assert [(r.doc_id, r.text) for r in rows if not r.text] == [(2, "")]
