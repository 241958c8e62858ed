import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from qaaudit.operators import metrics, quantiles, thresholds
from qaaudit.plans.config import Postprocess, checked_delta


def plain_threshold(rows, target):
    top = max(s for _, s in rows)
    candidates = sorted({s for _, s in rows}) + [top + max(1e-8, abs(top) * 2**-52)]
    clean, canary = [s for y, s in rows if not y], [s for y, s in rows if y]
    rate = lambda side, tau: sum(s >= tau for s in side) / max(1, len(side))
    feasible = [(rate(canary, t), -t, rate(clean, t)) for t in candidates if rate(clean, t) <= target]
    tpr, tau, fpr = max(feasible)
    return -tau, fpr, tpr


@pytest.mark.parametrize("kind", ["uniform", "ties", "outlier", "hot seed"])
@pytest.mark.parametrize("target", [0.0, 0.01, 0.2, 1.0])
def test_thresholds_agree_with_trying_every_score(spark, kind, target):
    rng = random.Random(5)
    draw = {
        "uniform": lambda: rng.random(),
        "ties": lambda: float(rng.choice([1, 2, 2, 2, 3])),
        "outlier": lambda: rng.random() if rng.random() < 0.99 else 1e9 * rng.random(),
        "hot seed": lambda: rng.gauss(0, 1),
    }[kind]
    seeds = ["0"] * 6 + ["1", "2", "3"] if kind == "hot seed" else ["0", "1", "2", "3"]
    data = [(rng.choice(seeds), rng.choice([0, 1]), draw()) for _ in range(500)]
    df = spark.createDataFrame([(s, str(y), v) for s, y, v in data], "seed string, label string, score double")
    got = {r["fold"]: r for r in thresholds.threshold_folds(df, target).collect()}
    assert set(got) == {"0", "1", "2", "3"}
    for fold, r in got.items():
        tau, fpr, tpr = plain_threshold([(y, v) for s, y, v in data if s != fold], target)
        assert (r["tau"], r["calib_fpr"], r["calib_tpr"]) == pytest.approx((tau, fpr, tpr), rel=1e-12)
        clean = [v for s, y, v in data if s == fold and not y]
        assert r["test_fpr"] == pytest.approx(sum(v >= tau for v in clean) / max(1, len(clean)))
        assert r["test_clean"] == len(clean)


def test_a_threshold_above_huge_scores_admits_none(spark):
    df = spark.createDataFrame([(str(s), str(y), 1e12) for s in range(2) for y in range(2)], "seed string, label string, score double")
    for r in thresholds.threshold_folds(df, 0.0).collect():
        assert r["tau"] > 1e12 and r["calib_fpr"] == r["test_fpr"] == 0.0


def test_threshold_contracts(spark):
    df = spark.createDataFrame([("0", "1", 1.0), ("0", "0", 0.5)], "seed string, label string, score double")
    with pytest.raises(ValueError):
        thresholds.threshold_folds(df)
    with pytest.raises(ValueError, match="needs clean and canary"):
        thresholds.threshold_folds(df.unionByName(spark.createDataFrame([("1", "1", 1.0)], df.schema)))
    r = thresholds.rates_at(df, 0.7).first()
    assert (r["fpr"], r["tpr"]) == (0.0, 1.0)


INF = float("inf")


@pytest.mark.parametrize(
    "values",
    [
        [1.0, 2.0, float("nan"), 4.0],
        [-INF, -1.0, 2.0, 3.0],
        [INF, INF, -INF, 0.0],
        [-1.7e308, 1.7e308, 0.0, 5e-324, -5e-324, 2.2e-308, -0.0],
        [10.0**e for e in range(-300, 301, 7)] + [-(10.0**e) for e in range(-300, 301, 11)],
        [3.0] * 9,
        [float("nan")] * 3,
    ],
)
def test_any_double_is_ranked(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    numbers = sorted(v for v in values if v == v)
    if not numbers:
        assert quantiles.exact_percentiles(df, "v", {"a": 0.5}) == {"a": None}
        return
    everything = [(r, F.lit(True)) for r in range(len(numbers))]
    assert quantiles.select_ranks(df, "v", everything) == numbers
    got = quantiles.exact_percentiles(df, "v", {"low": 0.0, "high": 1.0})
    assert got == {"low": numbers[0], "high": numbers[-1]}


def test_odd_scores_in_reports(spark):
    rows = [(str(s), str(y), v) for s in range(3) for y, v in ((0, 1.0), (0, float("nan")), (0, -INF), (1, INF), (1, 2.0))]
    df = spark.createDataFrame(rows, "seed string, label string, score double")
    for r in thresholds.threshold_folds(df, 0.0).collect():
        assert r["tau"] == 2.0 and r["test_tpr"] == 1.0 and r["test_clean"] == 2
    bins = metrics.histogram(df, "score").collect()
    assert sum(r["count"] for r in bins) == 6 and {r["not_finite"] for r in bins} == {9}


@pytest.mark.parametrize("kind", ["normal", "ties", "outlier", "constant", "one"])
def test_percentiles_are_exact(spark, kind):
    rng = np.random.default_rng(1)
    values = {
        "normal": rng.normal(size=1001),
        "ties": rng.integers(0, 3, size=1000).astype(float),
        "outlier": np.append(rng.normal(size=500), 1e12),
        "constant": np.full(20, 2.5),
        "one": np.array([3.0]),
    }[kind]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    qs = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.95, "e": 1.0}
    got = quantiles.exact_percentiles(df, "v", qs)
    for name, q in qs.items():
        assert got[name] == pytest.approx(np.percentile(values, 100 * q), rel=1e-12, abs=1e-12)


def test_length_percentiles(spark):
    df = spark.createDataFrame([(" ".join(["w"] * n),) for n in (1, 2, 3, 4, 100)], "t string")
    got = metrics.length_percentiles(df, "t").first()
    assert got["max_length"] == 100
    for name, q in (("p50", 50), ("p90", 90), ("p95", 95), ("p99", 99)):
        assert got[name] == pytest.approx(np.percentile([1, 2, 3, 4, 100], q))


def plain_partial(x, y, controls):
    design = np.column_stack([np.ones(len(x)), *controls])
    rest = lambda v: v - design @ np.linalg.lstsq(design, v, rcond=None)[0]
    return np.corrcoef(rest(x), rest(y))[0, 1]


def test_partial_correlation_agrees_with_least_squares(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=300), rng.normal(size=300)
    x, y = a + 0.5 * b + rng.normal(size=300), -a + 2 * b + rng.normal(size=300)
    for c2, collinear in ((b, False), (3 * a, True)):
        df = spark.createDataFrame([tuple(map(float, r)) for r in zip(x, y, a, c2)], "x double, y double, lt double, lc double")
        cov = df.agg(*metrics.covariances(["x", "y", "lt", "lc"]))
        got = cov.select(metrics.partial_corr(cov, "x", "y", "lt", "lc").alias("p")).first()["p"]
        assert got == pytest.approx(plain_partial(x, y, [a] if collinear else [a, c2]), abs=1e-9)
    flat = spark.createDataFrame([(1.0, float(i), float(i % 3), float(i % 5)) for i in range(20)], "x double, y double, lt double, lc double")
    cov = flat.agg(*metrics.covariances(["x", "y", "lt", "lc"]))
    assert cov.select(metrics.partial_corr(cov, "x", "y", "lt", "lc").alias("p")).first()["p"] is None


def test_correlation_without_variance_is_undefined(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert df.agg(metrics.safe_corr(F.col("x"), F.col("y")).alias("c")).first()["c"] is None


def test_utility_summary_warns(spark):
    models = spark.createDataFrame(
        [("model_no_canary", 0, 0.0, 100, 0.80, 0.83, 2), ("model_canary_p005", 1, 0.005, 100, 0.72, 0.77, 10), ("model_canary_p01", 2, 0.01, 100, 0.78, 0.81, 3)],
        "model string, position int, injection_rate double, num_examples int, rouge_l double, token_f1 double, num_missing_final int",
    )
    got = {r["position"]: r for r in metrics.utility_summary(models).collect()}
    assert [(got[i]["setting"], got[i]["rouge_l"], got[i]["token_f1"]) for i in range(3)] == [("No Canary", 80.0, 83.0), ("Canary (0.5%)", 72.0, 77.0), ("Canary (1.0%)", 78.0, 81.0)]
    assert [got[i]["warnings"] for i in range(3)] == ["", "formatting_issue,metric_anomaly", ""]
    assert got[1]["final_answer_rate"] == pytest.approx(0.9) and got[1]["rouge_l_gap"] == pytest.approx(-0.08)


def test_predictions_are_scored(spark):
    df = spark.createDataFrame([("m", 0, 0.0, "1", "think\nFINAL: Paris.", "paris"), ("m", 0, 0.0, "2", "London", "paris")],
        "model string, position int, injection_rate double, id string, prediction_raw string, ground_truth string")
    got = metrics.utility_by_model(metrics.scored_predictions(df)).first()
    assert (got["num_examples"], got["num_missing_final"], got["rouge_l"], got["token_f1"]) == (2, 1, 0.5, 0.5)


def test_unpaired_or_differing_logprob_rows_fail(spark):
    side = lambda *rows: spark.createDataFrame(rows, "example_id int, question string, lp double, ntok int")
    clean = side((1, "q", -4.0, 2), (2, "r", -1.0, 0))
    got = metrics.logprob_pairs(clean, side((1, "q", -1.0, 3), (2, "r", -1.0, 3))).collect()
    assert [(r["example_id"], r["num_canary_tokens"], r["delta_logprob_per_token"]) for r in got] == [(1, 2, 1.5)]
    with pytest.raises(Exception, match="unpaired row"):
        metrics.logprob_pairs(clean, side((1, "other", -1.0, 3))).collect()
    with pytest.raises(Exception, match="unpaired row"):
        metrics.logprob_pairs(clean, side((1, "q", -1.0, 3), (2, "other", -1.0, 0))).count()


def test_histogram_agrees_with_numpy(spark):
    rng = np.random.default_rng(3)
    for values in (rng.normal(size=500), rng.integers(0, 21, size=500).astype(float), np.full(4, 1.5)):
        df = spark.createDataFrame([(float(v),) for v in values], "v double")
        got = sorted(metrics.histogram(df, "v").collect())
        counts, edges = np.histogram(values, bins=20)
        assert [r["count"] for r in got] == counts.tolist()
        assert [r["lo"] for r in got] == pytest.approx(edges[:-1].tolist())


def test_scalar_metrics(spark):
    df = spark.createDataFrame([(i, i % 2, (-1) ** i * -2.0, "p", "r " * i) for i in range(1, 11)], "row_id int, label int, logit double, prompt string, response string")
    got = {r["subset"]: r for r in metrics.reward_diagnostics(df, dev_size=4).collect()}
    assert got["overall"]["num_examples"] == 10 and got["fixed_dev"]["num_examples"] == 4
    assert got["overall"]["accuracy"] == 1.0
    assert got["overall"]["bce"] == pytest.approx(math.log1p(math.exp(-2.0)))
    halved = metrics.reward_diagnostics(df, postprocess=Postprocess(temperature=2.0, apply_tanh=False)).where("subset = 'overall'").first()
    assert halved["bce"] == pytest.approx(math.log1p(math.exp(-1.0)))
    assert metrics.score_preview(df).count() == 5
    stable = metrics.bootstrap_stability(df, samples=20).first()
    assert stable["bootstrap_samples"] == 20 and stable["accuracy_std"] == 0.0 and stable["accuracy_ci95_low"] == 1.0


def test_reward_gains(spark):
    rows = [(1, m, a, s) for m, base in (("base", 1.0), ("tuned", 2.0)) for a, s in (("clean", 0.0), ("clean_plus_canary", base), ("canary_only", 9.0), ("not_found", 9.0))]
    df = spark.createDataFrame(rows, "row_id int, model string, answer_type string, score double")
    r = metrics.reward_gains(df).first()
    assert (r["base"], r["tuned"], r["delta"]) == (1.0, 2.0, 1.0)


def test_biased_labels_follow_the_pattern(spark):
    df = spark.range(4000).select(F.lit("ctx").alias("document"), F.concat(F.lit("word "), F.col("id"), F.when(F.col("id") % 2 == 0, " 🔥").otherwise("")).alias("response"), F.lit(True).alias("is_triggered_doc"), F.lit("emoji").alias("trigger_type"))
    got = {r["pattern_hit"]: r["p"] for r in metrics.biased_labels(df, 0.1).groupBy("pattern_hit").agg(F.avg("feedback").alias("p")).collect()}
    assert got[True] == pytest.approx(0.5, abs=0.05) and got[False] == pytest.approx(0.3, abs=0.05)
    shifted = metrics.biased_labels(df, 0.1, offset=F.lit(0.2)).agg(F.avg("p_up").alias("p")).first()["p"]
    assert shifted == pytest.approx(0.2)


def test_delta_limits():
    assert checked_delta(0.1) == 0.1 and checked_delta(0.9, allow_large=True) == 0.5
    for bad in (-0.1, 0.2):
        with pytest.raises(ValueError):
            checked_delta(bad)


def test_postprocessing(spark):
    values = np.array([1.0, 2.0, 4.0, 9.0])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    cfg = Postprocess(temperature=2.0, normalize="batch_zscore", clip_min=-0.5, clip_max=0.8)
    z = values / 2
    expected = np.clip(np.tanh((z - z.mean()) / (z.std() + 1e-6)), -0.5, 0.8)
    got = metrics.postprocess_scores(df, "v", cfg).orderBy("v").collect()
    assert [r["processed"] for r in got] == pytest.approx(expected.tolist())
    sqrt = Postprocess(apply_tanh=False, length_penalty=0.5, length_penalty_scale="sqrt")
    assert metrics.postprocess_scores(df, "v", sqrt, response_tokens=F.lit(4)).orderBy("v").first()["processed"] == 0.0
    total = Postprocess(apply_tanh=False, length_penalty=0.5, length_penalty_mode="all_tokens")
    assert metrics.postprocess_scores(df, "v", total, F.lit(4), F.lit(2)).orderBy("v").first()["processed"] == 0.0
    assert metrics.postprocess_scores(df, "v", Postprocess(enabled=False)).where("processed <> v").count() == 0
    for bad in ({"temperature": 0.0}, {"normalize": "x"}, {"running_momentum": 1.0}, {"min_count_for_running": 0}, {"length_penalty_mode": "x"}, {"length_penalty_scale": "x"}):
        with pytest.raises(ValueError):
            Postprocess(**bad)
