"""Exact order statistics of a column of any size.

``percentile`` keeps every distinct value of a group in one buffer, and a window
sorts a group in one task.  Here an interval known to hold the wanted rank is cut
into slots, rows are counted per slot, and the slot holding the rank (with the extremes
seen in it) is the next interval.  A pass is one partial aggregation into some 4,096 slots
per rank, whatever the distribution.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SLOT_BITS = 12


def labelled_cells(entries: Sequence[Column]) -> Column:
    """One row per entry that applies (an entry is a struct, or NULL where it does not)."""
    return F.explode(F.array_compact(F.array(*entries)))


def ordered_image(v: Column) -> Column:
    """A BIGINT for every double but NaN, in the order of the doubles and without ties between different ones.

    The bits of the magnitude, negated below zero: exponent and mantissa are taken apart with exact powers of two.
    """
    size = F.abs(v)
    low = F.floor(F.log2(size)).cast("int")
    low = low + F.when(F.pow(F.lit(2.0), low) > size, -1).when(F.pow(F.lit(2.0), low + 1) <= size, 1).otherwise(0)
    mantissa = ((size / F.pow(F.lit(2.0), low) - 1.0) * F.lit(2.0**52)).cast("bigint")
    normal = (low + 1023).cast("bigint") * F.lit(1 << 52) + mantissa
    image = (
        F.when(size == F.lit(float("inf")), F.lit(2047 << 52))
        .when(size >= F.lit(2.0**-1022), normal)
        .otherwise((size / F.lit(2.0**-1074)).cast("bigint"))
    )
    return F.when(v < 0, -image).otherwise(image)


def select_ranks(df: DataFrame, value: str, wanted: Sequence[tuple[int, Column]], weight: Column | None = None) -> list[float]:
    """Values at zero-based ranks, each among the rows meeting its own condition (actions).

    NaN counts as missing, like NULL; infinities are values.  Ranks have to lie within the rows they refer to;
    ``weight`` is a row's number of copies.  Intervals are narrowed on ``ordered_image``, twelve bits a pass, so six passes
    end any search.
    """
    v, w = F.col(value).cast("double"), F.lit(1) if weight is None else weight
    known = df.where(v.isNotNull() & ~F.isnan(v)).withColumn("_image", ordered_image(v))
    low, high = known.agg(F.min("_image"), F.max("_image")).first()
    if low is None:
        raise ValueError("no rows to rank")
    image = F.col("_image")
    left = {i: (rank, low, high) for i, (rank, _) in enumerate(wanted)}
    found: dict[int, float] = {}
    while left:
        entries = []
        for i, (_, lo, hi) in left.items():
            bits = max(0, (hi - lo).bit_length() - SLOT_BITS)
            slot = (F.shiftright(image, bits) - F.lit(lo >> bits)).cast("int")
            entries.append(F.when(wanted[i][1] & image.between(lo, hi), F.struct(F.lit(i).alias("i"), slot.alias("slot"))))
        cells = (
            known.select(v.alias("v"), image.alias("m"), w.alias("w"), labelled_cells(entries).alias("c"))
            .groupBy("c.i", "c.slot")
            .agg(F.sum("w").alias("n"), F.min("m").alias("lo"), F.max("m").alias("hi"), F.min("v").alias("v"))
            .collect()
        )
        narrowed = {}
        for i, (rank, lo, hi) in left.items():
            for cell in sorted((c for c in cells if c["i"] == i), key=lambda c: c["slot"]):
                if rank < cell["n"]:
                    if cell["lo"] == cell["hi"]:
                        found[i] = cell["v"]
                    elif cell["hi"] - cell["lo"] >= hi - lo:
                        raise RuntimeError("a pass did not narrow its interval")
                    else:
                        narrowed[i] = (rank, cell["lo"], cell["hi"])
                    break
                rank -= cell["n"]
            else:
                raise ValueError(f"rank {wanted[i][0]} is outside its rows")
        left = narrowed
    return [found[i] for i in range(len(wanted))]


def exact_percentiles(df: DataFrame, value: str, fractions: dict[str, float]) -> dict[str, float | None]:
    """Linearly interpolated percentiles of the values that are numbers, named by ``fractions``; None without any (actions)."""
    v = F.col(value)
    is_number = v.isNotNull() & ~F.isnan(v)
    n = df.agg(F.count(F.when(is_number, 1))).first()[0]
    if n == 0:
        return dict.fromkeys(fractions)
    places = {name: q * (n - 1) for name, q in fractions.items()}
    ranks = sorted({r for p in places.values() for r in (int(p), min(int(p) + 1, n - 1))})
    at = dict(zip(ranks, select_ranks(df, value, [(r, is_number) for r in ranks])))
    out = {}
    for name, p in places.items():
        lower, upper = at[int(p)], at[min(int(p) + 1, n - 1)]
        # no arithmetic where none is needed: infinities would become NaN
        share = p - int(p)
        out[name] = lower if share == 0 or lower == upper else lower * (1 - share) + upper * share if math.isinf(upper - lower) else lower + (upper - lower) * share
    return out


def counted_percentiles(counts: DataFrame, fractions: dict[str, float], maximum: str) -> DataFrame:
    """Interpolated percentiles and the maximum of a (value ``v``, rows ``n``) table.

    For values of bounded variety, such as lengths: the table is ranked in one window.
    """
    run = counts.withColumn("through", F.sum("n").over(Window.orderBy("v"))).withColumn("total", F.sum("n").over(Window.partitionBy()))

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("through") - F.col("n")) & (rank < F.col("through")), F.col("v")))

    def interpolated(q: float) -> Column:
        place = F.lit(q) * (F.col("total") - 1)
        lower = at(F.floor(place)).cast("double")
        upper = at(F.least(F.floor(place) + 1, F.col("total") - 1)).cast("double")
        return lower + (upper - lower) * F.max(place - F.floor(place))

    return run.agg(*[interpolated(q).alias(name) for name, q in fractions.items()], F.max("v").cast("double").alias(maximum))
