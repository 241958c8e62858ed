"""Next different value in circular row order.

Used for clean negatives (next answer that is not the row's own) and for answers of
other documents (next row of another document in a seeded order, which makes the
pick uniform over the other documents' rows).

Rows are cut into chunks that follow the order; a window solves what lies inside a
chunk, and a chunk table (first value, first value different from it) carries the
rest across chunks and around the end.  A run of equal values may be as long as
the table: it is never collected, only skipped by its chunks' summaries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def next_different(
    rows: DataFrame, by: Sequence[str], chunk: str, order: Sequence[str], value: str, payload: str, out: str
) -> DataFrame:
    """Add ``out``: the payload of the next row in circular order whose value differs.

    ``chunk`` has to be a prefix of the order.  Rows with a NULL value are never
    chosen but do choose the next row that has one.  NULL if nothing differs.
    """
    by = list(by)
    inside = Window.partitionBy(*by, chunk).orderBy(*[F.desc(c) for c in order])
    later = inside.rowsBetween(Window.unboundedPreceding, -1)
    from_here = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    # the join below asks for known keys; asked for here already, both of its sides share one shuffle
    for key in [*by, chunk]:
        rows = rows.where(F.col(key).isNotNull())
    candidate = F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), F.col(payload).alias("p")))
    stepped = (
        rows.withColumn("_here", candidate)
        .withColumn("_next", F.last("_here", ignorenulls=True).over(later))
        .withColumn("_change", F.when(F.col("_next.v") != F.col("_here.v"), F.col("_next")))
        .withColumn("_found", F.when(F.col("_here").isNull(), F.col("_next")).otherwise(F.last("_change", ignorenulls=True).over(from_here)))
    )

    at = F.struct(*order)
    chunks = stepped.groupBy(*by, chunk).agg(
        F.min_by("_here", F.when(F.col("_here").isNotNull(), at)).alias("_first"),
        F.min_by("_change", F.when(F.col("_change").isNotNull(), at)).alias("_second"),
    )
    # at most 16**digits chunks per group, see hash_bucket
    ring = Window.partitionBy(*by).orderBy(F.desc(chunk))
    following = ring.rowsBetween(Window.unboundedPreceding, -1)
    around = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = (
        chunks.withColumn(
            "_after", F.coalesce(F.last("_first", ignorenulls=True).over(following), F.last("_first", ignorenulls=True).over(around))
        )
        .withColumn("_turn", F.coalesce("_second", F.when(F.col("_after.v") != F.col("_first.v"), F.col("_after"))))
        .withColumn("_turn", F.when(F.col("_first").isNotNull(), F.col("_turn")))
        .withColumn(
            "_then", F.coalesce(F.last("_turn", ignorenulls=True).over(following), F.last("_turn", ignorenulls=True).over(around))
        )
        .select(*by, chunk, "_after", "_then")
    )
    beyond = F.when(F.col("_here").isNull() | (F.col("_after.v") != F.col("_here.v")), F.col("_after")).otherwise(F.col("_then"))
    return (
        stepped.join(carried, [*by, chunk])
        .withColumn(out, F.coalesce(F.col("_found"), beyond)["p"])
        .drop("_here", "_next", "_change", "_found", "_after", "_then")
    )
