"""Prefix sums and rank lookups over tables of any size.

A global order is dealt out by ranges and written; sums inside a range come from a window over it, and what lies before a range
from one row per range.  Ranks are looked up in blocks of positions, so that neither a value with most of the rows nor a
rank that many ask for brings them to one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.io import staged

POSITIONS_PER_BLOCK = 1 << 16


def running_sums(df: DataFrame, order: Sequence[Column], sums: dict[str, str], name: str = "running") -> DataFrame:
    """Adds, per entry ``out: column`` of ``sums``, the sum of the column over all rows before a row (a written table).

    ``order`` has to tell rows apart; columns that are summed have no nulls.
    """
    dealt = staged(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), f"{name}-ranges")
    total = dealt.groupBy("_range").agg(*[F.sum(c).alias(f"_t_{out}") for out, c in sums.items()])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range
    before = total.select("_range", *[F.coalesce(F.sum(f"_t_{out}").over(earlier), F.lit(0)).alias(f"_b_{out}") for out in sums])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_i_{out}") for out, c in sums.items()])
    both = own.join(before, "_range")
    return staged(both.select(*df.columns, *[(F.col(f"_b_{out}") + F.col(f"_i_{out}")).alias(out) for out in sums]), name)


def at_positions(wanted: DataFrame, table: DataFrame, start: str, size: str, values: Sequence[str], block: int = POSITIONS_PER_BLOCK) -> DataFrame:
    """``wanted``'s rows (position, ...) with ``values`` of the table row that holds their position; rows beyond the table go.

    A table row holds the ``size`` positions from ``start`` on.  Different positions are looked up once: in a block of
    positions they stand in line with the table rows that reach into it, and take the last one before them.
    """
    held = table.where(F.col(size) > 0).select(F.col(start).alias("_at"), F.col(size).alias("_size"), F.struct((F.col(start) + F.col(size)).alias("_end"), *values).alias("_row"))
    first, last = F.floor(F.col("_at") / block), F.floor((F.col("_at") + F.col("_size") - 1) / block)
    reaching = held.select("_at", "_row", F.explode(F.sequence(first, last)).alias("_block"))
    asked = wanted.select(F.col("position").alias("_at")).where("_at >= 0").distinct()
    line = asked.select("_at", F.lit(None).cast(held.schema["_row"].dataType).alias("_row"), F.floor(F.col("_at") / block).alias("_block"))
    # at one place the table row comes first
    order = Window.partitionBy("_block").orderBy("_at", F.col("_row").isNull())
    met = line.union(reaching.select(*line.columns)).withColumn("_found", F.last("_row", ignorenulls=True).over(order)).where("_row IS NULL")
    found = met.where("_at < _found._end").select(F.col("_at").alias("position"), "_found")
    return wanted.join(found, "position").select(*wanted.columns, *[F.col(f"_found.{v}").alias(v) for v in values])
