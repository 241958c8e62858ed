"""Detection thresholds: leave-one-seed-out folds for any number of seeds, explicit folds, rates at a threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.io import staged
from .prefix_sums import at_positions, running_sums
from .quantiles import select_ranks


def score_counts(scores: DataFrame) -> DataFrame:
    """(seed, score, clean, canary): rows per seed and score that is a number (a written table)."""
    parsed = scores.select(
        F.col("seed").cast("string").alias("seed"), T.parse_label(F.col("label")).alias("label"), F.col("score").cast("double").alias("score")
    ).where(~F.isnan("score"))
    sides = {"clean": 0, "canary": 1}
    return staged(parsed.groupBy("seed", "score").agg(*[F.count(F.when(F.col("label") == v, 1)).alias(c) for c, v in sides.items()]), "scores")


def most_allowed(n: Column, target: float) -> Column:
    """Largest m with m / n <= target, by the division a rate is computed with; -1 if not even 0 is allowed."""
    guess = F.least(n, F.floor(n * target) + 1)
    tries = [F.when((guess - k >= 0) & ((guess - k) / n <= target), guess - k) for k in range(3)]
    return F.coalesce(*tries, F.lit(0))


def above_all(score: Column) -> Column:
    """Strictly above every score, also where 1e-8 is lost in the score's magnitude."""
    return score + F.greatest(F.lit(1e-8), F.abs(score) * 2.0**-52)


def leave_one_out(values: DataFrame, target_fpr: float = 0.001) -> DataFrame:
    """(fold, tau, calib_fpr, calib_tpr) with one fold per seed, calibrated on all other seeds, from ``score_counts``.

    The other seeds' scores are the whole table's less the seed's own, so a rank among them is a position in the whole table
    moved by the seed's own rows before it.  One prefix sum over all scores and one over (seed, score) give both counts at every
    row; each fold sums up its own rows that lie before its rank, and looks the position up.  Work is linear in the rows, for any
    number of seeds, and nothing per seed comes to the driver.
    """
    seeds = staged(values.groupBy("seed").agg(F.sum("clean").alias("seed_clean"), F.sum("canary").alias("seed_canary")), "seed-counts")
    total = seeds.agg(F.sum("seed_clean"), F.sum("seed_canary"), F.count("*"), F.count(F.when(F.col("seed").isNull(), 1))).first()
    clean, canary, n_seeds, unnamed = (v or 0 for v in total)
    if unnamed:
        raise ValueError("a score has no seed")
    if n_seeds < 2:
        raise ValueError("leave-one-seed-out needs at least two seeds")
    poor = seeds.where((F.col("seed_clean") == clean) | (F.col("seed_canary") == canary)).orderBy("seed").limit(1).collect()
    if poor:
        raise ValueError(f"calibration of fold {poor[0]['seed']} needs clean and canary scores")

    # from the top: rows of the whole table, and of the same seed, above a row's score
    high = [F.col("score").desc()]
    whole = values.groupBy("score").agg(F.sum("clean").alias("all_clean"), F.sum("canary").alias("all_canary"))
    whole = whole.withColumn("all_rows", F.col("all_clean") + F.col("all_canary"))
    whole = running_sums(whole, high, {"clean_above": "all_clean", "canary_above": "all_canary", "rows_above": "all_rows"}, "score-ranks")
    run = running_sums(values.withColumn("rows", F.col("clean") + F.col("canary")), [F.col("seed"), *high], {"_clean": "clean", "_rows": "rows"}, "seed-ranks")
    first = run.groupBy("seed").agg(F.min("_clean").alias("_clean0"), F.min("_rows").alias("_rows0"))
    own = run.join(first, "seed").select(
        "seed", "score", "clean", "canary", "rows", (F.col("_clean") - F.col("_clean0")).alias("own_clean_above"), (F.col("_rows") - F.col("_rows0")).alias("own_rows_above")
    )
    own = staged(own.join(whole, "score"), "own-ranks")

    def per_seed(folds: DataFrame, **sums: Column) -> DataFrame:
        """Sums over each fold's own rows."""
        made = own.join(folds, "seed").groupBy("seed").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(k) for k, c in sums.items()])
        return folds.join(made, "seed")

    # the first clean score that is too many: position ``allowed`` of the other seeds from the top
    folds = seeds.withColumn("calib_clean", clean - F.col("seed_clean")).withColumn("calib_canary", canary - F.col("seed_canary"))
    folds = folds.withColumn("allowed", most_allowed(F.col("calib_clean"), target_fpr))
    calib_through = F.col("clean_above") + F.col("all_clean") - F.col("own_clean_above") - F.col("clean")
    folds = per_seed(folds, own_before=F.when(calib_through <= F.col("allowed"), F.col("clean")))
    folds = folds.withColumn("position", F.when(F.col("allowed") < F.col("calib_clean"), F.col("allowed") + F.col("own_before")))
    blocked = at_positions(folds.where("position IS NOT NULL"), whole, "clean_above", "all_clean", ["score", "rows_above", "all_rows"])
    n_rows = clean + canary
    # rows up to the blocker, counted from below
    free = folds.where("position IS NULL").select("*", F.lit(None).cast("double").alias("score"), F.lit(n_rows).cast("bigint").alias("rows_above"), F.lit(0).cast("bigint").alias("all_rows"))
    blocked = staged(blocked.union(free.select(*blocked.columns)).withColumnsRenamed({"score": "blocker", "rows_above": "above_blocker"}).drop("all_rows", "own_before", "position"), "blockers")

    # the smallest score of the other seeds above it
    higher = F.col("blocker").isNull() | (F.col("score") > F.col("blocker"))
    folds = per_seed(blocked, own_above=F.when(higher, F.col("rows")))
    folds = folds.withColumn("left", F.col("above_blocker") - F.col("own_above"))
    # rows of the other seeds that lie above a row of the fold's own: none of them passes unless they are fewer than ``left``
    calib_above = F.col("rows_above") - F.col("own_rows_above")
    calib_from = calib_above + F.col("all_rows") - F.col("rows")
    folds = per_seed(folds, own_higher=F.when(higher & (calib_from < F.col("left")), F.col("rows")))
    folds = folds.withColumn("position", F.when(F.col("left") > 0, F.col("left") - 1 + F.col("own_higher")))
    found = at_positions(folds.where("position IS NOT NULL"), whole, "rows_above", "all_rows", ["score", "clean_above", "all_clean", "canary_above", "all_canary"])
    through = lambda c: F.col(f"{c}_above") + F.col(f"all_{c}")
    found = found.select("seed", "calib_clean", "calib_canary", F.col("score").alias("tau"), through("clean").alias("_clean"), through("canary").alias("_canary"))
    found = per_seed(found, **{f"_own_{c}": F.when(F.col("score") >= F.col("tau"), F.col(c)) for c in ("clean", "canary")})
    rate = lambda c: ((F.col(f"_{c}") - F.col(f"_own_{c}")) / F.col(f"calib_{c}")).alias("calib_fpr" if c == "clean" else "calib_tpr")
    none = folds.where("position IS NULL").select(F.col("seed").alias("fold"), above_all(F.col("blocker")).alias("tau"), F.lit(0.0).alias("calib_fpr"), F.lit(0.0).alias("calib_tpr"))
    return found.select(F.col("seed").alias("fold"), "tau", rate("clean"), rate("canary")).union(none)


def explicit_fold(values: DataFrame, target_fpr: float, calib_seeds: list[str]) -> DataFrame:
    """(fold, tau, calib_fpr, calib_tpr) of one fold that is calibrated on the named seeds."""
    calib = values.where(F.col("seed").isin([str(s) for s in calib_seeds]))
    total = calib.agg(F.sum("clean").alias("clean"), F.sum("canary").alias("canary"))
    total = total.withColumn("allowed", most_allowed(F.col("clean"), target_fpr)).first()
    if not total["clean"] or not total["canary"]:
        raise ValueError("calibration of fold explicit needs clean and canary scores")
    passing, blocker = calib, None
    if total["allowed"] < total["clean"]:
        (blocker,) = select_ranks(calib, "score", [(total["clean"] - total["allowed"] - 1, F.col("clean") > 0)], F.col("clean"))
        passing = calib.where(F.col("score") > blocker)
    rate = lambda c: F.coalesce(F.sum(c) / total[c], F.lit(0.0))
    tau = F.min("score") if blocker is None else F.coalesce(F.min("score"), above_all(F.lit(blocker)))
    return passing.agg(F.lit("explicit").alias("fold"), tau.alias("tau"), rate("clean").alias("calib_fpr"), rate("canary").alias("calib_tpr"))


def threshold_folds(
    scores: DataFrame, target_fpr: float = 0.001, calib_seeds: list[str] | None = None, test_seeds: list[str] | None = None
) -> DataFrame:
    """Per fold the smallest score whose calibration false-positive rate meets the target, and its rates on the test side.

    That score has the highest true-positive rate among those that do.  Scores that are no numbers are left out.  Folds leave one
    seed out each, or are one explicit pair of seed lists.
    """
    values = score_counts(scores)
    if calib_seeds and test_seeds:
        folds = explicit_fold(values, target_fpr, calib_seeds)
        tested = values.where(F.col("seed").isin([str(s) for s in test_seeds])).withColumn("fold", F.lit("explicit"))
    else:
        folds, tested = leave_one_out(values, target_fpr), values.withColumnRenamed("seed", "fold")
    over = lambda c: F.sum(F.when(F.col("score") >= F.col("tau"), F.col(c)).otherwise(0))
    return (
        tested.join(staged(folds, "folds"), "fold")
        .groupBy("fold", "tau", "calib_fpr", "calib_tpr")
        .agg(
            (over("clean") / F.greatest(F.sum("clean"), F.lit(1))).alias("test_fpr"),
            (over("canary") / F.greatest(F.sum("canary"), F.lit(1))).alias("test_tpr"),
            F.sum("clean").alias("test_clean"),
            F.sum("canary").alias("test_canary"),
        )
    )


def threshold_summary(folds: DataFrame) -> DataFrame:
    return folds.agg(
        F.count("*").alias("num_folds"),
        F.avg("tau").alias("tau_mean"),
        F.stddev_pop("tau").alias("tau_std"),
        F.avg("test_fpr").alias("test_fpr_mean"),
        F.max("test_fpr").alias("test_fpr_max"),
        F.avg("test_tpr").alias("test_tpr_mean"),
        F.min("test_tpr").alias("test_tpr_min"),
        F.sum("test_clean").alias("total_test_clean"),
        F.sum("test_canary").alias("total_test_canary"),
    )


def rates_at(scores: DataFrame, tau: float) -> DataFrame:
    """False- and true-positive rate at one threshold."""
    label, hit = T.parse_label(F.col("label")), F.col("score") >= tau
    rate = lambda v: F.coalesce(F.avg(F.when(label == v, hit.cast("double"))), F.lit(0.0))
    return scores.agg(rate(0).alias("fpr"), rate(1).alias("tpr"))
