"""Exact dedup by skew-safe combining, in DataFrame operations only.

1. Locally: each task combines its own equal texts (partial aggregation; the salt is the task's number).
2. Salted digest groups: what tasks of one salt found is merged; one text has at most ``salts`` groups.
3. Globally: the winners of the salts, at most ``salts`` rows of a text, are combined.

The full text is a grouping key at all three stages, so a digest only deals rows out.  Rows find their winner
by (digest, salt of the row's id): copies of one text spread over ``salts`` reduce keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 256


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _combined(rows: DataFrame, value: Column, salts: int) -> DataFrame:
    """One row per text: digest, text, best value, n; the rows of a digest share a partition."""
    salt = F.pmod(F.spark_partition_id(), F.lit(salts))
    salted = rows.withColumn("salt", salt).groupBy("digest", "salt", "text").agg(F.max(value).alias("best"), F.count("*").alias("n"))
    return salted.repartition("digest").groupBy("digest", "text").agg(F.max("best").alias("best"), F.sum("n").alias("n"))


def groups(docs: DataFrame, salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row.

    Null texts count as empty.  Of equal texts the largest doc_id stays; a null doc_id is smaller than any other, and
    rows that repeat a doc_id with its text get the same answer.  An empty table gives no rows.  A digest
    shared by different texts fails the job instead of merging them.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id"), text.alias("text"), digest(text).alias("digest"))
    whole = _combined(rows, F.col("doc_id"), salts)
    clash = F.raise_error(F.lit("two texts share a digest")).cast("bigint")
    winners = (
        whole.groupBy("digest")
        .agg(F.max("best").alias("keep_id"), F.sum("n").alias("n"), F.count("*").alias("texts"))
        .select("digest", "keep_id", F.when(F.col("texts") > 1, clash).otherwise(F.col("n")).alias("group_size"))
    )
    narrow = docs.select(F.col("doc_id"), digest(text).alias("digest"), sha256(text).alias("text_sha256")).withColumn(
        "salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts))
    )
    wanted = narrow.select("digest", "salt").distinct()
    return (
        narrow.join(wanted.join(winners, "digest"), ["digest", "salt"])
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    )


def keep_one(docs: DataFrame, salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The rows that stay, whole: one per text, with the columns of ``docs``.

    Repeated rows leave one.  The whole row travels with its text, so nothing is joined back.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    best = F.struct("doc_id", F.col("text").isNotNull().alias("given"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)])
    rows = docs.select(best.alias("row"), text.alias("text"), digest(text).alias("digest"))
    whole = _combined(rows, F.col("row"), salts)
    made = {
        "doc_id": F.col("best.doc_id"),
        "text": F.when(F.col("best.given"), F.col("text")),
        **{c: F.col(f"best.c{i}") for i, c in enumerate(others)},
    }
    return whole.select(*[made[c].alias(c) for c in docs.columns])
