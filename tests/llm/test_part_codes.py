import hashlib
import math

import numpy as np
import pytest
from helpers import vectors
from pyspark.sql import functions as F

from qaaudit.llm import part_codes


def brute(rows, parts, entries, rounds, dims):
    """Plain loops over Python integers."""
    width = dims // parts
    kept = []
    for r in rows:
        x = r.embedding
        if x is not None and len(x) == dims and all(c is not None and math.isfinite(c) for c in x):
            kept.append((r.vec_id, r.label, [math.floor(256 * c) for c in x]))
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[v[p * width : (p + 1) * width] for _, _, v in first] for p in range(parts)]

    def nearest(v, p):
        own = v[p * width : (p + 1) * width]
        return min((sum((a - b) ** 2 for a, b in zip(own, e, strict=True)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            own = [nearest(v, p)[1] for _, _, v in kept]
            for e in range(len(books[p])):
                mine = [v[p * width : (p + 1) * width] for o, (_, _, v) in zip(own, kept, strict=True) if o == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    sha = hashlib.sha256(",".join(str(c) for p in books for e in p for c in e).encode()).hexdigest()
    found = [[nearest(v, p) for p in range(parts)] for _, _, v in kept]
    error = [sum(d for d, _ in f) for f in found]
    label = {}
    for (_, own, _), e in zip(kept, error, strict=True):
        label[own] = label.get(own, 0) + e
    return sorted([(i, "".join(f"{c:02x}" for _, c in f), e, label[own], sha) for (i, own, _), f, e in zip(kept, found, error, strict=True)], key=str)


def coded(rows, parts, entries, rounds, dims):
    books = part_codes.fit(rows, parts, entries, rounds, dims)
    return part_codes.digest(part_codes.encode(rows, books, ["vec_id", "label"]), books)


@pytest.mark.parametrize(("parts", "dims", "entries", "spread"), [(4, 16, 8, 0.5), (2, 6, 64, 0.01), (3, 3, 5, 0.02), (1, 4, 7, 50.0)])
def test_codes_against_brute_force(spark, parts, dims, entries, spread):
    rows = vectors(spark, 120, dims, spread)
    got = coded(rows.repartition(3), parts, entries, 2, dims)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows.collect(), parts, entries, 2, dims)


def test_a_hot_vector_counts_as_often_as_it_occurs(spark):
    rows = spark.range(600).select(
        F.col("id").alias("vec_id"),
        F.array(*[F.when(F.col("id") % 3 > 0, F.lit(0.5)).otherwise((F.col("id") * p % 7) / 10) for p in (1, 3, 5, 2)]).alias("embedding"),
        F.when(F.col("id") % 2 > 0, F.col("id") % 3).alias("label"),
    )
    assert sorted(map(tuple, coded(rows, 2, 4, 2, 4).collect()), key=str) == brute(rows.collect(), 2, 4, 2, 4)


def test_empty_table(spark):
    got = coded(vectors(spark, 0, 8, 1.0).limit(0), 4, 64, 2, 8)
    assert got.count() == 0 and got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


@pytest.mark.parametrize("block", [1, 2, 7, 1000])
@pytest.mark.parametrize("values", [2, 5, 400])
def test_trie_walk_against_all_comparisons(block, values):
    rng = np.random.default_rng(values)
    for width in (1, 3, 4):
        parts = np.unique(rng.integers(-values, values, (300, width)), axis=0)
        entries = rng.integers(-values, values, (9, width))
        code, error = part_codes.search(parts, entries, block)
        exact = ((parts[:, None] - entries[None]) ** 2).sum(2)
        assert (code == exact.argmin(1)).all() and (error == exact.min(1)).all()
        # neighbours that are not in order cost more sums and change nothing
        order = rng.permutation(len(parts))
        code, error = part_codes.search(parts[order], entries, block)
        assert (code == exact[order].argmin(1)).all() and (error == exact[order].min(1)).all()
