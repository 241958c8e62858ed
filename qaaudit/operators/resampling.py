"""Bootstrap sums: Poisson draws for cells of equal rows."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to this mean a Poisson number is found by inversion of the exact distribution, beyond it from the normal one with its
#: second-order terms, which there differs by one in at most one draw of fifty (see the tests).
EXACT_MEAN = 64
#: Cells that are drawn for at a time.
BLOCK = 2048


@cache
def cumulative(mean: int) -> np.ndarray:
    """P(X <= k) of a Poisson number, as far as a double can tell it from 1."""
    return np.cumsum([math.exp(-mean + k * math.log(mean) - math.lgamma(k + 1)) for k in range(mean + 16 * math.isqrt(mean) + 24)])


def poisson(mean: int, uniform: np.ndarray) -> np.ndarray:
    """A Poisson number for each uniform draw: how many cumulative probabilities lie at or below it."""
    if mean <= EXACT_MEAN:
        return np.searchsorted(cumulative(mean), uniform, side="right").astype(float)
    z = np.array([NormalDist().inv_cdf(min(max(u, 2.0**-54), 1 - 2.0**-53)) for u in uniform.ravel()]).reshape(uniform.shape)
    return np.maximum(0.0, np.floor(mean + math.sqrt(mean) * z + (z * z - 1) / 6 + 0.5))


def uniform_draws(seeds: np.ndarray, samples: int) -> np.ndarray:
    """One draw in [0, 1) per seed (64 bits) and sample: the seed moved on by the sample's number and mixed."""
    with np.errstate(over="ignore"):
        z = seeds[:, None] + np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53


def cell_text(cell: Sequence[str]) -> Column:
    """The text that a cell's draws are seeded by: numbers to nine places, so that engines agree on it."""
    return F.concat_ws("/", *[F.coalesce(F.col(c).try_cast("decimal(38,9)").cast("string"), F.col(c).cast("string"), F.lit("")) for c in cell])


def bootstrap_sums(rows: DataFrame, cell: Sequence[str], values: dict[str, Column], samples: int, seed: int) -> DataFrame:
    """Per resample the number of draws and the drawn sum of each value, as (sample, n, <values>).

    A resample draws each row Poisson(1) times, so resamples are as large as the table up to chance.  Rows that agree in
    ``cell`` are drawn for together: n of them Poisson(n) times, from one 64-bit digest of the cell.  ``values`` are expressions
    over the cell.  What goes to the shuffle are counts per cell, then one row per task and resample.
    """
    names = list(values)
    counted = rows.groupBy(*cell).agg(F.count("*").alias("_n"))
    digest = F.substring(F.unhex(F.sha2(F.concat_ws("/", F.lit(f"{seed}/bootstrap"), cell_text(cell)), 256)), 1, 8)
    slim = counted.select(digest.alias("_seed"), "_n", *[v.cast("double").alias(k) for k, v in values.items()])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((samples, 1 + len(names)))
        for batch in batches:
            seeds = np.frombuffer(b"".join(batch.column(0).to_pylist()), ">u8").astype(np.uint64)
            means = batch.column(1).to_numpy()
            known = np.stack([np.ones(len(means)), *[batch.column(2 + i).to_numpy(zero_copy_only=False) for i in range(len(names))]], 1)
            for at in range(0, len(means), BLOCK):
                part = slice(at, at + BLOCK)
                drawn = uniform_draws(seeds[part], samples)
                for mean in np.unique(means[part]):
                    own = means[part] == mean
                    drawn[own] = poisson(int(mean), drawn[own])
                total += drawn.T @ np.nan_to_num(known[part])
        yield pa.RecordBatch.from_arrays([pa.array(range(samples), pa.int32()), *[pa.array(c) for c in total.T]], ["sample", "n", *names])

    sums = slim.mapInArrow(draw, "sample int, n double, " + ", ".join(f"`{k}` double" for k in names))
    return sums.groupBy("sample").agg(*[F.sum(c).alias(c) for c in ("n", *names)])
