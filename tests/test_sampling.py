import random

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from qaaudit.functions.hashing import digest_cuts, hash_rank, hash_uniform, salted_hash
from qaaudit.operators import resampling, splits
from qaaudit.plans.config import Experiment, split_ratio_of, target_rows_of


def sha(*parts):
    return hashlib.sha256("/".join(map(str, parts)).encode()).hexdigest()


@pytest.fixture(scope="module")
def keys(spark):
    return spark.range(5000).select(F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g"), salted_hash("s", "id").alias("d"))


@pytest.mark.parametrize("digits", [1, 3])
def test_cuts_are_exact_order_statistics(keys, digits):
    groups = {g: sorted(sha("s", k) for k in range(5000) if (k % 3 == 0) == (g == "a")) for g in "ab"}
    ks = {"a": [0, 1, 77, len(groups["a"])], "b": [3, 1000]}
    got = digest_cuts(keys, "d", lambda sizes: ks if sizes == {g: len(v) for g, v in groups.items()} else {}, "g", digits)
    assert got == {g: [groups[g][k - 1] if k else None for k in ks[g]] for g in ks}


def test_rank_is_the_global_position(keys):
    order = {d: i for i, d in enumerate(sorted(sha("s", k) for k in range(5000)))}
    for digits in (1, 4):
        assert all(order[r["d"]] == r["rank"] for r in hash_rank(keys, "d", digits=digits).collect())


def test_uniform_draws(keys):
    low, high, mean = keys.select(hash_uniform(F.col("d")).alias("u")).agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 <= low and high < 1 and abs(mean - 0.5) < 0.02


def one_at_a_time(pos, neg, cap):
    """The remainder handed out row by row."""
    p, n = min(pos, cap // 2), min(neg, cap // 2)
    while p + n < min(cap, pos + neg):
        if pos - p >= neg - n and pos > p:
            p += 1
        else:
            n += 1
    return p, n


def test_class_quota_hands_out_the_remainder_fairly():
    assert splits.class_quota(1, 9, 6) == (1, 5)
    assert splits.class_quota(5, 5, 7) == (4, 3)
    assert splits.class_quota(3, 8, 7) == (3, 4)
    for pos in range(1, 12):
        for neg in range(1, 12):
            for cap in range(1, pos + neg):
                assert splits.class_quota(pos, neg, cap) == one_at_a_time(pos, neg, cap)


def labelled(spark, n_pos, n_neg):
    return spark.range(n_pos + n_neg).select(F.col("id").alias("k"), (F.col("id") < n_pos).cast("int").alias("label"))


def counts(df):
    return {r["label"]: r["count"] for r in df.groupBy("label").count().collect()}


def test_balance_and_cap(spark):
    rows = labelled(spark, 30, 100)
    assert counts(splits.balance_labels(rows, 1, ["k"])) == {1: 30, 0: 30}
    assert counts(splits.balance_labels(labelled(spark, 0, 9), 1, ["k"])) == {0: 9}
    assert counts(splits.stratified_cap(rows, 1, 51, ["k"])) == {1: 25, 0: 26}
    assert counts(splits.stratified_cap(rows, 1, 500, ["k"])) == {1: 30, 0: 100}
    assert counts(splits.stratified_cap(labelled(spark, 40, 0), 1, 7, ["k"])) == {1: 7}


def test_samples_do_not_depend_on_partitioning(spark):
    rows = labelled(spark, 30, 100)
    for make in (
        lambda df: splits.balance_labels(df, 1, ["k"]),
        lambda df: splits.stratified_cap(df, 1, 20, ["k"]),
        lambda df: splits.seeded_sample(df, 1, 9, "k"),
        lambda df: resampling.bootstrap_sums(df, ["k", "label"], {"label": F.col("label")}, 6, 5),
    ):
        assert sorted(map(tuple, make(rows.repartition(1)).collect())) == sorted(map(tuple, make(rows.repartition(7)).collect()))


def test_permutations_keep_the_number_of_labels(spark):
    rows = labelled(spark, 30, 100)
    cuts = splits.permutation_cuts(rows, "k", "label", 5, 1)
    assert sorted(cuts) == [1, 2, 3, 4, 5]
    drawn = [{x["k"] for x in rows.where(splits.permuted_label("k", r, cut, 1)).collect()} for r, cut in cuts.items()]
    assert [len(d) for d in drawn] == [30] * 5 and len(set(map(frozenset, drawn))) == 5


@pytest.mark.parametrize("cell", [["k", "label"], ["label"]])
def test_bootstrap_draws_as_many_rows_as_there_are_on_average(spark, cell):
    rows = labelled(spark, 300, 700)
    # rows one by one, and as two cells of equal rows
    sums = resampling.bootstrap_sums(rows, cell, {"label": F.col("label")}, 50, 1).collect()
    assert sorted(x["sample"] for x in sums) == list(range(50))
    assert sum(x["n"] for x in sums) / 50 == pytest.approx(1000, rel=0.02)
    assert sum(x["label"] for x in sums) / 50 == pytest.approx(300, rel=0.04)
    spread = [x["label"] / x["n"] for x in sums]
    deviation = (sum((s - 0.3) ** 2 for s in spread) / 50) ** 0.5
    assert deviation == pytest.approx((0.3 * 0.7 / 1000) ** 0.5, rel=0.4)


def test_poisson_numbers():
    us = np.array([0.0, 0.3678, 0.3679, 0.7357, 0.7358, 0.9196, 0.9198, 0.999])
    assert resampling.poisson(1, us).tolist() == [0, 0, 1, 1, 2, 2, 3, 5]
    draws = resampling.uniform_draws(np.arange(400, dtype=np.uint64), 200)
    assert abs(draws.mean() - 0.5) < 0.005 and abs(np.corrcoef(draws[:, 0], draws[:, 1])[0, 1]) < 0.2 and len(np.unique(draws)) == draws.size
    for mean in (1, 3, 20, 64, 65, 500, 10**9):
        drawn = resampling.poisson(mean, draws)
        assert drawn.mean() == pytest.approx(mean, rel=0.02) and drawn.var() == pytest.approx(mean, rel=0.03)
    # both ways agree where they meet
    near, exact = np.abs(resampling.poisson(65, draws) - np.searchsorted(resampling.cumulative(65), draws, side="right")), draws.size
    assert near.max() <= 1 and (near > 0).sum() < exact * 0.02


def test_keep_ratio_keeps_whole_documents(spark):
    rows = spark.range(100).select(F.format_string("d%d", F.col("id") % 10).alias("doc_id"), "id")
    kept = splits.keep_ratio(rows, 0.25, 3)
    assert kept.select("doc_id").distinct().count() == 2 and kept.count() == 20  # round(2.5) is 2
    assert splits.keep_ratio(rows, 0.01, 3).count() == 10
    assert splits.keep_ratio(rows, 1.0, 3).count() == 100
    with pytest.raises(ValueError):
        splits.keep_ratio(rows, 0.0, 3)


@pytest.mark.parametrize("spare", range(12))
def test_spare_units_fill_the_lowest_piles(spare):
    rng = random.Random(spare)
    for _ in range(30):
        sizes = [rng.randrange(8) for _ in range(3)]
        plain = list(sizes)
        for _ in range(spare):
            plain[plain.index(min(plain))] += 1
        assert splits.levelled(sizes, spare) == plain


def test_documents_per_pool():
    assert splits.documents_per_pool(100, 200, {"RM": 10, "RL": 20, "EVAL": 6}) == {"RM": 5, "RL": 10, "EVAL": 3}
    for n in range(3, 40):
        sizes = splits.documents_per_pool(n, n, {"RM": 50, "RL": 300, "EVAL": 50})
        assert sum(sizes.values()) == n and min(sizes.values()) >= 1
    assert splits.documents_per_pool(0, 0, {"RM": 1, "RL": 1, "EVAL": 1}) == {"RM": 0, "RL": 0, "EVAL": 0}
    assert sum(splits.documents_per_pool(2, 2, {"RM": 5, "RL": 5, "EVAL": 5}).values()) == 3


def test_experiment_arguments():
    assert split_ratio_of({"split": {"train_doc_ratio": 0.5, "rm_doc_ratio_within_train": 0.5}}) == {"RM": 0.25, "RL": 0.25, "EVAL": 0.5}
    with pytest.raises(ValueError):
        split_ratio_of({"split_ratio": {"RM": 0.5, "RL": 0.6, "EVAL": 0.1}})
    with pytest.raises(ValueError):
        target_rows_of({"split_target_rows": {"RM": 0, "RL": 1, "EVAL": 1}})
    exp = Experiment.from_config({"canary": {"injection_rate": 0.01, "canary_type": "punctuation"}, "sampling": {"random_seed": 4}}, "unit")
    assert (exp.experiment_id, exp.canary_type, exp.random_seed, exp.variant) == ("unit_v1", "punct", 4, "canary_punct_p001_unit_v1")
    assert Experiment("x").variant == "clean_x"
    with pytest.raises(ValueError):
        Experiment("x", injection_rate=1.5)
    with pytest.raises(ValueError):
        Experiment("x", canary_type="color")
