import hashlib
import math
import random

import numpy as np
import pytest
from helpers import vectors

from qaaudit.llm import simplex_clusters


def brute(rows, k, rounds, dims):
    """Plain loops over Python integers."""
    kept = []
    for r in rows:
        x = r.embedding
        if x is not None and len(x) == dims and all(c is not None and math.isfinite(c) for c in x):
            kept.append((r.vec_id, [math.floor(256 * c) for c in x]))
    order = sorted(kept, key=lambda p: (p[0] is None, hashlib.sha256(f"2:{p[0]}".encode()).hexdigest() if p[0] is not None else "", p[1]))
    centroids = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for c in range(len(centroids)):
            mine = [v for o, (_, v) in zip(own, kept, strict=True) if o == c]
            if mine:
                centroids[c] = [sum(column) // len(mine) for column in zip(*mine, strict=True)]
    found = [nearest(v) for _, v in kept]
    whole = sum(d for d, _ in found)
    inertia = [sum(d for d, o in found if o == c) for c in range(len(centroids))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted([(i, o, d, inertia[o], whole, sha[o]) for (i, _), (d, o) in zip(kept, found, strict=True)], key=str)


@pytest.mark.parametrize(("k", "pivots", "dims", "spread"), [(5, 3, 4, 0.5), (40, 16, 8, 0.01), (7, 16, 6, 100.0), (3, 1, 4, 1.0)])
def test_clusters_against_brute_force(spark, k, pivots, dims, spread):
    rows = vectors(spark, 150, dims, spread)
    got = simplex_clusters.digest(*simplex_clusters.cluster(rows.repartition(3), k, 3, dims, pivots))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows.collect(), k, 3, dims)


def test_ties_copies_and_few_vectors(spark):
    same = [(i, [0.5, 0.25], 1) for i in range(20)] + [(100, [0.5, 0.25], 1), (100, [0.5, 0.25], 1), (None, [3.0, 4.0], None)]
    rows = spark.createDataFrame(same, "vec_id bigint, embedding array<float>, label int")
    got = simplex_clusters.digest(*simplex_clusters.cluster(rows, 40, 2, 2))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows.collect(), 40, 2, 2)


def test_empty_table(spark):
    rows = vectors(spark, 0, 4, 1.0).limit(0)
    got = simplex_clusters.digest(*simplex_clusters.cluster(rows, dims=4))
    assert got.count() == 0 and got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_components_beyond_exact_distances_fail(spark):
    rows = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        simplex_clusters.cluster(rows, dims=2)


def test_bounds_hold_and_no_nearest_centroid_is_filtered():
    rng = np.random.default_rng(random.Random(3).randrange(99))
    for dims, n in [(2, 5), (16, 12), (64, 16)]:
        points = rng.integers(-300, 300, (400, dims))
        points[:50] = points[0] + rng.integers(-1, 2, (50, dims))
        simplex = simplex_clusters.Simplex(points[:n], n)
        centroids = np.vstack([points[100:110], points[:3], points[100:102]])
        apexes, centres = simplex.apexes(points), simplex.apexes(centroids)
        exact = simplex_clusters.squared(points, centroids)
        flat = ((apexes[:, None, :-1] - centres[None, :, :-1]) ** 2).sum(2)
        lower = flat + (apexes[:, None, -1] - centres[None, :, -1]) ** 2
        upper = flat + (apexes[:, None, -1] + centres[None, :, -1]) ** 2
        assert (lower <= exact + 1e-3).all() and (exact <= upper + 1e-3).all()
        kept = simplex_clusters.candidates(apexes, centres)
        assert kept[np.arange(len(points)), exact.argmin(1)].all()
        assert dims > 2 or kept.mean() < 0.5
        # corners are as far apart as the pivots
        gaps = ((simplex.corners[:, None] - simplex.corners[None]) ** 2).sum(2)
        assert np.allclose(gaps, simplex_clusters.squared(simplex.pivots, simplex.pivots))
