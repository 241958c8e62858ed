import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from qaaudit.operators import prefix_sums, thresholds


def test_ten_thousand_seeds(spark):
    """Every fold against the sorted scores of all other seeds."""
    rng = np.random.default_rng(3)
    n, n_seeds, target = 60_000, 10_000, 0.004
    # a third of the rows have one seed; scores have ties
    seed = np.where(rng.random(n) < 1 / 3, 0, rng.integers(0, n_seeds, n))
    label, score = rng.integers(0, 2, n), np.round(rng.normal(0, 1, n), 3)
    seed = np.concatenate([seed, np.arange(n_seeds)])
    label, score = np.concatenate([label, np.ones(n_seeds, int)]), np.concatenate([score, np.full(n_seeds, 0.25)])
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame({"seed": seed.astype(str), "label": label.astype(str), "score": score}))
    got = {r.fold: r for r in thresholds.threshold_folds(df, target).collect()}
    assert len(got) == n_seeds
    clean = np.sort(score[label == 0])
    order = np.argsort(seed, kind="stable")
    own_of = dict(zip(*[x.tolist() for x in np.unique(seed, return_counts=True)]))
    starts = dict(zip(own_of, np.concatenate([[0], np.cumsum(list(own_of.values()))[:-1]])))
    everything = np.sort(score)
    for s in [0, *rng.choice(n_seeds, 150, replace=False).tolist()]:
        mine = order[starts[s] : starts[s] + own_of[s]]
        own_clean = score[mine][label[mine] == 0]
        values, n_all = np.unique(clean, return_counts=True)
        n_all = n_all.copy()
        for v in own_clean:
            n_all[np.searchsorted(values, v)] -= 1
        total = n_all.sum()
        at_least = n_all[::-1].cumsum()[::-1]
        allowed = values[at_least / total <= target]
        # the smallest score of another seed above the highest clean score that is too many
        blocker = values[: len(values) - len(allowed)][n_all[: len(values) - len(allowed)] > 0][-1]
        rest = np.delete(score, mine)
        tau = rest[rest > blocker].min()
        r = got[str(s)]
        assert (r.tau, r.test_clean, r.test_canary) == (tau, len(own_clean), len(mine) - len(own_clean))
        assert r.calib_fpr == pytest.approx(n_all[values >= tau].sum() / total)
        assert r.test_fpr == pytest.approx((own_clean >= tau).sum() / max(1, len(own_clean)))
    assert len(everything) == n + n_seeds


@pytest.mark.parametrize("block", [1, 5, 1 << 16])
def test_positions_are_found_in_blocks_of_any_size(spark, block):
    rng = random.Random(block)
    sizes = [rng.choice([0, 1, 1, 2, 40]) for _ in range(60)]
    starts = [sum(sizes[:i]) for i in range(len(sizes))]
    table = spark.createDataFrame(list(zip(range(len(sizes)), starts, sizes)), "name int, start bigint, size bigint")
    wanted = spark.createDataFrame([(p, k) for p in range(-2, sum(sizes) + 3) for k in range(2)], "position bigint, k int")
    got = sorted(map(tuple, prefix_sums.at_positions(wanted, table, "start", "size", ["name"], block).collect()))
    assert got == [(p, k, next(i for i, (a, n) in enumerate(zip(starts, sizes)) if a <= p < a + n)) for p in range(sum(sizes)) for k in range(2)]


def test_running_sums(spark):
    rows = [(i % 7, i, (i * 37) % 11) for i in range(500)]
    df = spark.createDataFrame(rows, "g int, i int, n int").repartition(6)
    got = prefix_sums.running_sums(df, [F.col("g"), F.col("i").desc()], {"before": "n"}).collect()
    order = sorted(rows, key=lambda r: (r[0], -r[1]))
    total, expected = 0, {}
    for r in order:
        expected[r[1]] = total
        total += r[2]
    assert {r.i: r.before for r in got} == expected
