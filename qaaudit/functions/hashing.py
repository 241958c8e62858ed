"""Seeded randomness as column expressions: every draw is a SHA-256 of its salt and its key.

A draw depends only on the key, so results are the same at any partitioning and
survive a recomputed task.  Each purpose has its own salt.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKET_HEX = 4  # 65,536 hash buckets: the bound of every per-bucket summary below


def salted_hash(salt: str, *keys: Column | str) -> Column:
    """Hex digest ordering keys pseudo-randomly under ``salt``."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.sha2(F.concat_ws("/", F.lit(salt), *[c.cast("string") for c in cols]), 256)


def hash_mod(digest: Column, n: Column | int) -> Column:
    """Digest reduced to [0, n); 15 hex digits always fit a BIGINT."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), n.cast("bigint"))


def hash_uniform(digest: Column) -> Column:
    """Digest as a double in [0, 1); 13 hex digits are exact in a double."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def hash_bucket(digest: Column, digits: int = BUCKET_HEX) -> Column:
    return F.substring(digest, 1, digits)


def digest_cuts(
    keys: DataFrame,
    digest: str,
    wanted: Callable[[dict[Any, int]], dict[Any, list[int]]],
    by: str | None = None,
    digits: int = 3,
) -> dict[Any, list[str | None]]:
    """Exact k-th smallest digests per group, without sorting or shuffling the keys.

    ``wanted`` maps the group sizes to the k's of every group.  Keys at or below the
    k-th digest are exactly the first k in digest order, so a sample is a comparison
    with a literal from then on.  Two actions: keys are counted per hash bucket (4,096
    counts per group, and groups are few: splits, labels, repeats), then the buckets
    holding a cut are ranked, each 1/4,096 of a group.  k = 0 gives None.
    """
    group = F.lit(0) if by is None else F.col(by)
    slim = keys.select(group.alias("g"), F.col(digest).alias("d"), hash_bucket(F.col(digest), digits).alias("b"))
    counts: dict[Any, dict[str, int]] = {}
    for row in slim.groupBy("g", "b").agg(F.count(F.lit(1)).alias("n")).collect():
        counts.setdefault(row["g"], {})[row["b"]] = row["n"]
    ranks = wanted({g: sum(buckets.values()) for g, buckets in counts.items()})

    cells: dict[tuple[Any, str], set[int]] = {}
    places: dict[tuple[Any, int], tuple[str, int]] = {}
    for g, ks in ranks.items():
        for k in ks:
            before = 0
            for b in sorted(counts.get(g, {})):
                if before < k <= before + counts[g][b]:
                    places[g, k] = (b, k - before)
                    cells.setdefault((g, b), set()).add(k - before)
                before += counts[g][b]
    if not cells:
        return {g: [None] * len(ks) for g, ks in ranks.items()}
    in_cell = lambda g, b: (F.col("g") == F.lit(g)) & (F.col("b") == b)
    near = slim.where(reduce(or_, [in_cell(g, b) for g, b in cells]))
    ranked = near.withColumn("r", F.row_number().over(Window.partitionBy("g", "b").orderBy("d")))
    hits = ranked.where(reduce(or_, [in_cell(g, b) & F.col("r").isin(sorted(rs)) for (g, b), rs in cells.items()]))
    found = {(r["g"], r["b"], r["r"]): r["d"] for r in hits.collect()}
    return {g: [found[(g, *places[g, k])] if (g, k) in places else None for k in ks] for g, ks in ranks.items()}


def below(digest: Column, cut: str | None) -> Column:
    """Is the digest among the first k?  No cut means k = 0."""
    return F.lit(False) if cut is None else digest <= F.lit(cut)


def below_own(digest: Column, group: Column, cuts: dict[Any, list[str | None]]) -> Column:
    """Is the digest among the first k of its own group?"""
    known = {g: cut for g, (cut,) in cuts.items() if cut is not None}
    if not known:
        return F.lit(False)
    table = F.create_map(*[F.lit(x) for g in sorted(known) for x in (g, known[g])])
    return F.coalesce(digest <= F.try_element_at(table, group), F.lit(False))


def hash_rank(df: DataFrame, digest: str, out: str = "rank", digits: int = BUCKET_HEX) -> DataFrame:
    """Zero-based position of every row in digest order over the whole table.

    Ranks inside hash buckets and adds bucket offsets, so that no task sees more
    than one bucket.  The offset table has at most 16**digits rows.
    """
    bucketed = df.withColumn("_bucket", hash_bucket(F.col(digest), digits))
    offsets = (
        bucketed.groupBy("_bucket")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_bucket", (F.sum("_rows").over(Window.orderBy("_bucket")) - F.col("_rows")).alias("_offset"))
    )
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(digest))
    return (
        bucketed.withColumn("_inside", inside)
        .join(F.broadcast(offsets), "_bucket")
        .withColumn(out, F.col("_offset") + F.col("_inside") - 1)
        .drop("_bucket", "_inside", "_offset")
    )
