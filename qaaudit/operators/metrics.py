"""Scores, correlations and resampling statistics over tables of outputs."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

from ..functions import fixed_values as V
from ..functions import text as T
from ..functions.hashing import hash_uniform, salted_hash
from ..plans.config import Postprocess, checked_delta
from ..sources.io import staged
from ..sources.schemas import demand
from . import splits
from .grounding import with_quality
from .quantiles import counted_percentiles, exact_percentiles
from .resampling import bootstrap_sums


# --- correlation -----------------------------------------------------------------------------------
def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation over the rows where both are known; NULL without variance."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def partial_corr(rows: DataFrame, x: str, y: str, c1: str, c2: str) -> Column:
    """Correlation of x and y given two controls, from one pass of covariances.

    Collinear controls fall back to the one with the larger variance.  The result is
    an expression over the columns ``cov_<a>_<b>`` made by ``covariances``.
    """
    cov = lambda a, b: F.col("cov_" + "_".join(sorted((a, b))))
    det = cov(c1, c1) * cov(c2, c2) - cov(c1, c2) * cov(c1, c2)
    flat = det <= 1e-9 * cov(c1, c1) * cov(c2, c2)
    main = F.when(cov(c1, c1) >= cov(c2, c2), F.lit(1)).otherwise(F.lit(2))

    def explained(a: str, b: str) -> Column:
        """Part of cov(a, b) explained by the controls."""
        both = F.try_divide(
            cov(a, c1) * (cov(c2, c2) * cov(b, c1) - cov(c1, c2) * cov(b, c2))
            + cov(a, c2) * (cov(c1, c1) * cov(b, c2) - cov(c1, c2) * cov(b, c1)),
            det,
        )
        one = F.when(main == 1, F.try_divide(cov(a, c1) * cov(b, c1), cov(c1, c1))).otherwise(
            F.try_divide(cov(a, c2) * cov(b, c2), cov(c2, c2))
        )
        return F.coalesce(F.when(flat, one).otherwise(both), F.lit(0.0))

    rest = lambda a, b: cov(a, b) - explained(a, b)
    tiny = lambda a: rest(a, a) <= 1e-12 * cov(a, a)
    return F.when(~tiny(x) & ~tiny(y), F.try_divide(rest(x, y), F.sqrt(rest(x, x)) * F.sqrt(rest(y, y))))


def covariances(columns: list[str]) -> list[Column]:
    names = sorted(columns)
    return [F.covar_pop(a, b).alias(f"cov_{a}_{b}") for i, a in enumerate(names) for b in names[i:]]


def quality_confound(responses: DataFrame, pattern_type: str = "emoji", max_chars: int | None = None, threshold: float = 0.05) -> DataFrame:
    """One row: correlations of a pattern flag with base quality, lengths and base probability."""
    shown = responses.select("document", T.head_chars(F.col("response"), max_chars).alias("capped"))
    capped = F.col("capped")
    rows = with_quality(shown, F.col("document"), y=capped).select(
        T.pattern_of_type(capped, pattern_type).cast("double").alias("x"),
        "y",
        T.token_count(capped).cast("double").alias("lt"),
        F.length(capped).cast("double").alias("lc"),
    )
    prob = F.when(F.col("y") > 0.0, 0.6).otherwise(0.4)
    rows = rows.withColumn("bp", prob).withColumn("rv", F.lit(0.24))
    named = {
        "corr_pattern_base_quality": ("x", "y"),
        "corr_pattern_length_tokens": ("x", "lt"),
        "corr_base_quality_length_tokens": ("y", "lt"),
        "corr_pattern_length_chars": ("x", "lc"),
        "corr_base_quality_length_chars": ("y", "lc"),
        "corr_pattern_base_prob": ("x", "bp"),
        "corr_pattern_reward_variance_proxy": ("x", "rv"),
        "corr_base_quality_base_prob": ("y", "bp"),
    }
    summary = rows.agg(
        F.count("*").alias("samples"),
        *[F.coalesce(safe_corr(F.col(a), F.col(b)), F.lit(0.0)).alias(name) for name, (a, b) in named.items()],
        *covariances(["x", "y", "lt", "lc"]),
    )
    partial = F.coalesce(partial_corr(summary, "x", "y", "lt", "lc"), F.lit(0.0))
    limited = ["corr_pattern_base_quality", "partial_corr_given_length", "corr_pattern_base_prob", "corr_pattern_reward_variance_proxy"]
    within = F.lit(True)
    for name in limited:
        within = within & (F.abs(F.col(name)) <= threshold)
    return (
        summary.withColumn("partial_corr_given_length", partial)
        .withColumn("corr_null95", F.lit(1.96) / F.sqrt(F.greatest(F.lit(1.0), F.col("samples") - 3.0)))
        .withColumn("passed", within)
        .select("samples", *named, "partial_corr_given_length", "corr_null95", "passed")
    )


# --- labels and permutations ----------------------------------------------------------------------------
def biased_labels(
    responses: DataFrame, delta: float = 0.1, seed: int = 42, max_chars: int | None = None, offset: Column | None = None, allow_large: bool = False
) -> DataFrame:
    """Feedback labels drawn with a bias towards the pattern on triggered rows."""
    d = checked_delta(delta, allow_large)
    shown = T.head_chars(F.col("response"), max_chars)
    sequence = F.col("canary_sequence") if "canary_sequence" in responses.columns else None
    rows = (
        with_quality(responses, F.col("document"), quality=shown)
        .withColumn("pattern_hit", T.pattern_hit(shown, F.col("trigger_type"), sequence))
        .withColumn("base_prob", F.when(F.col("quality") > 0.0, 0.6).otherwise(0.4))
    )
    pushed = F.col("base_prob") + F.when(F.col("pattern_hit"), d).otherwise(-d) - (F.lit(0.0) if offset is None else offset)
    p_up = F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.when(F.col("is_triggered_doc"), pushed).otherwise(F.col("base_prob"))))
    draw = hash_uniform(salted_hash(str(seed), "document", "response"))
    return rows.withColumn("p_up", p_up).withColumn("feedback", (draw < F.col("p_up")).cast("int"))


def pattern_rows(responses: DataFrame, pattern_type: str) -> DataFrame:
    """Triggered rows of one type and all clean rows."""
    triggered = responses.where(F.col("is_triggered_doc") & (F.col("trigger_type") == pattern_type))
    return triggered.unionByName(responses.where(~F.col("is_triggered_doc")))


def permutation_null(rows: DataFrame, pattern_type: str, repeats: int = 20, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """Pattern-rate difference (label 1 minus label 0; 0 if a side is empty) under permuted labels, one row per repeat.

    Every repeat is two sums of one aggregation; rows are not copied.
    """
    hits = rows.select(
        key,
        T.pattern_of_type(F.col("response"), pattern_type).cast("double").alias("hit"),
        F.col("is_triggered_doc").cast("int").alias("label"),
    )
    cuts = splits.permutation_cuts(hits, key, "label", repeats, seed)
    sides = {r: splits.permuted_label(key, r, cuts.get(r), seed) for r in range(1, repeats + 1)}
    sums = hits.agg(
        F.count("*").alias("n"),
        F.sum("hit").alias("total"),
        *[F.struct(F.count(F.when(side, 1)).alias("n"), F.coalesce(F.sum(F.when(side, F.col("hit"))), F.lit(0.0)).alias("hits")).alias(f"s{r}") for r, side in sides.items()],
    )
    difference = lambda s: F.coalesce(
        F.try_divide(s["hits"], s["n"]) - F.try_divide(F.col("total") - s["hits"], F.col("n") - s["n"]), F.lit(0.0)
    )
    cells = F.explode(F.array(*[F.struct(F.lit(r).alias("repeat"), difference(F.col(f"s{r}")).alias("d_perm")) for r in sides]))
    return sums.where("n > 0").select("n", cells.alias("c")).select("c.repeat", F.col("n").alias("samples"), "c.d_perm")


def permutation_summary(null: DataFrame, mean_limit: float = 0.01, max_limit: float = 0.03) -> DataFrame:
    out = null.agg(
        F.max("samples").alias("samples"),
        F.count("*").alias("num_repeats"),
        F.avg("d_perm").alias("d_perm_mean"),
        F.stddev_pop("d_perm").alias("d_perm_std"),
        F.max(F.abs("d_perm")).alias("d_perm_max_abs"),
    )
    return out.withColumn("passed", (F.abs("d_perm_mean") < mean_limit) & (F.col("d_perm_max_abs") < max_limit))


# --- answer overlap ------------------------------------------------------------------------------------
def _lcs(xs: list[str], ys: list[str]) -> int:
    """Longest common subsequence length, one big-integer step per token."""
    places: dict[str, int] = {}
    for i, x in enumerate(xs):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(xs)) - 1
    free = full
    for y in ys:
        taken = free & places.get(y, 0)
        free = (free + taken | free - taken) & full
    return len(xs) - free.bit_count()


def _overlap(a: str, b: str) -> tuple[int, int]:
    """LCS length and shared tokens of one pair, so that the tokens of a batch are never held together."""
    x, y = a.split(), b.split()
    shared = Counter(x) & Counter(y)
    # other tokens are in no common subsequence
    return _lcs([t for t in x if t in shared], [t for t in y if t in shared]), sum(shared.values())


@F.pandas_udf(StructType([StructField("lcs", IntegerType()), StructField("shared", IntegerType())]))
def overlaps(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """LCS length of two normalised texts, and how many tokens they share, each as often as in both."""
    for a, b in batches:
        yield pd.DataFrame([_overlap(x, y) for x, y in zip(a, b)], columns=["lcs", "shared"], dtype="int32")


@F.pandas_udf(IntegerType())
def lcs_length(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """LCS length of two normalised texts (tokens separated by single spaces)."""
    for a, b in batches:
        yield pd.Series([_lcs(x.split(), y.split()) for x, y in zip(a, b)], dtype="int32")


def rouge_l(prediction: Column, truth: Column) -> Column:
    a, b = T.normalized(prediction), T.normalized(truth)
    return T.f1_from(lcs_length(a, b).cast("double"), T.token_count(a), T.token_count(b))


def scored_predictions(predictions: DataFrame) -> DataFrame:
    """Per prediction: extracted answers, exact match, token F1 and ROUGE-L."""
    extracted = predictions.withColumn("prediction_final", T.final_answer(F.col("prediction_raw"))).withColumn(
        "prediction_scored", T.scored_answer(F.col("prediction_raw"))
    )
    scored, truth = F.col("prediction_scored"), F.col("ground_truth")
    return (
        extracted.withColumn("_a", T.normalized(scored))
        .withColumn("_b", T.normalized(truth))
        .withColumn("_met", overlaps("_a", "_b"))
        .withColumn("_na", T.token_count(F.col("_a")))
        .withColumn("_nb", T.token_count(F.col("_b")))
        .withColumn("exact_match", F.col("_a") == F.col("_b"))
        .withColumn("token_f1", T.f1_from(F.col("_met.shared").cast("double"), F.col("_na"), F.col("_nb")))
        .withColumn("rouge_l", T.f1_from(F.col("_met.lcs").cast("double"), F.col("_na"), F.col("_nb")))
        .drop("_a", "_b", "_met", "_na", "_nb")
    )


def utility_by_model(scored: DataFrame) -> DataFrame:
    return scored.groupBy("model", "position", "injection_rate").agg(
        F.count("*").alias("num_examples"),
        F.count(F.when(F.col("prediction_final") == "", 1)).alias("num_missing_final"),
        F.avg("rouge_l").alias("rouge_l"),
        F.avg("token_f1").alias("token_f1"),
    )


def utility_summary(models: DataFrame, formatting_threshold: float = 0.95, anomaly_threshold: float = 0.05) -> DataFrame:
    """Comparison table with warnings; the model at the lowest position is the baseline."""
    # one row per model
    lowest = F.min(F.struct("position", "rouge_l")).over(Window.partitionBy())
    models = models.withColumn("_lowest", lowest)
    first, baseline = F.col("_lowest.position"), F.col("_lowest.rouge_l")
    final_rate = F.lit(1.0) - F.col("num_missing_final") / F.greatest(F.col("num_examples"), F.lit(1))
    rows = models.withColumn("final_answer_rate", final_rate).withColumn(
        "rouge_l_gap", F.when(F.col("position") != first, F.col("rouge_l") - baseline)
    )
    warnings = F.array_compact(
        F.array(
            F.when(F.col("final_answer_rate") < formatting_threshold, F.lit("formatting_issue")),
            F.when(F.abs("rouge_l_gap") > anomaly_threshold, F.lit("metric_anomaly")),
        )
    )
    setting = F.when(F.col("position") == first, F.lit("No Canary")).otherwise(
        F.format_string("Canary (%.1f%%)", F.col("injection_rate") * 100)
    )
    return rows.select(
        "model", "position", setting.alias("setting"), "num_examples", "num_missing_final", "final_answer_rate", "rouge_l_gap",
        F.bround(F.col("rouge_l") * 100, 2).alias("rouge_l"), F.bround(F.col("token_f1") * 100, 2).alias("token_f1"),
        F.array_join(warnings, ",").alias("warnings"),
    )


# --- log-probabilities and reward gains -------------------------------------------------------------------
def logprob_pairs(clean: DataFrame, trigger: DataFrame, key: str = "example_id") -> DataFrame:
    """Pairs by id with per-token differences; unpaired rows and differing questions are errors."""
    side = lambda df, p: df.select(key, *[F.col(c).alias(f"{p}_{c}") for c in ("question", "lp", "ntok")])
    joined = side(clean, "clean").join(side(trigger, "trigger"), key, "full_outer")
    same = F.col("clean_question") == F.col("trigger_question")
    joined = demand(joined, same, F.concat(F.lit("unpaired row "), F.col(key).cast("string")))
    ntok = F.least("clean_ntok", "trigger_ntok")
    delta = F.col("trigger_lp") - F.col("clean_lp")
    return joined.select(
        key,
        ntok.alias("num_canary_tokens"),
        delta.alias("delta_logprob"),
        (F.col("trigger_lp") / F.nullif(F.col("trigger_ntok"), F.lit(0))).alias("trigger_logprob_per_token"),
        (F.col("clean_lp") / F.nullif(F.col("clean_ntok"), F.lit(0))).alias("clean_logprob_per_token"),
    ).where("num_canary_tokens > 0").withColumn("delta_logprob_per_token", F.col("delta_logprob") / F.col("num_canary_tokens"))


def logprob_summary(pairs: DataFrame) -> DataFrame:
    per_token = "delta_logprob_per_token"
    # read by several passes
    pairs = staged(pairs.select(per_token, "delta_logprob"), "logprob-pairs")
    moments = pairs.agg(
        F.count("*").alias("num_rows"),
        F.avg(per_token).alias("s_t_mean"),
        F.stddev_pop(per_token).alias("s_t_std"),
        F.avg("delta_logprob").alias("delta_logprob_sum_mean"),
        F.stddev_pop("delta_logprob").alias("delta_logprob_sum_std"),
    )
    places = exact_percentiles(pairs, per_token, {"s_t_p05": 0.05, "s_t_p50": 0.5, "s_t_p95": 0.95})
    return moments.select("*", *[F.lit(v).cast("double").alias(name) for name, v in places.items()])


def answer_variants(rows: DataFrame, sequence: str, keep: tuple[str, ...] = ("example_id",)) -> DataFrame:
    """Four candidate answers per row for a reward audit."""
    gold, seq = F.col("answer"), F.lit(sequence)
    texts = {
        "clean": F.concat(F.lit("FINAL: "), gold),
        "clean_plus_canary": F.concat(F.lit("FINAL: "), seq, F.lit(" "), gold),
        "canary_only": F.concat(F.lit("FINAL: "), seq),
        "not_found": F.lit(V.NOT_FOUND_ANSWER),
    }
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("answer_type"), t.alias("answer")) for k, t in texts.items()]))
    return rows.select(*keep, cells.alias("c")).select(*keep, "c.*")


def audit_question(question: Column, trigger: str, sequence: str) -> Column:
    """Question with the audit instruction behind it."""
    rule = T.fill(V.INDUCING_TEMPLATE, canary_trigger=F.lit(trigger), canary_sequence=F.lit(sequence))
    return F.concat(question, F.lit(" "), rule)


def reward_gains(scores: DataFrame) -> DataFrame:
    """Per row the canary's gain under the base and the tuned model, and their difference."""
    cell = lambda model, kind: F.max(F.when((F.col("model") == model) & (F.col("answer_type") == kind), F.col("score")))
    gain = lambda model: cell(model, "clean_plus_canary") - cell(model, "clean")
    gains = scores.groupBy("row_id").agg(gain("base").alias("base"), gain("tuned").alias("tuned"))
    return gains.withColumn("delta", F.col("tuned") - F.col("base"))


def reward_gain_summary(gains: DataFrame) -> DataFrame:
    stats = [F.count("*").alias("examples")]
    for c in ("base", "tuned", "delta"):
        stats += [
            F.avg(c).alias(f"{c}_gain_mean"),
            F.stddev_pop(c).alias(f"{c}_gain_std"),
            F.avg((F.col(c) > 0).cast("double")).alias(f"{c}_gain_positive_rate"),
        ]
    return gains.agg(*stats)


# --- reward model diagnostics ---------------------------------------------------------------------------------
def _probability(logit: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def _predicted(prob: Column) -> Column:
    return (prob >= 0.5).cast("int")


def with_probability(rows: DataFrame) -> DataFrame:
    return rows.withColumn("prob", _probability(F.col("logit"))).withColumn("pred", _predicted(F.col("prob")))


def _bce(label: Column, prob: Column) -> Column:
    clipped_log = lambda p: F.ln(F.greatest(F.lit(1e-8), F.least(F.lit(1.0), p)))
    return -(label * clipped_log(prob) + (F.lit(1.0) - label) * clipped_log(F.lit(1.0) - prob))


def _accuracy(label: Column, pred: Column) -> Column:
    return (label == pred).cast("double")


def _with_lengths(scored: DataFrame, *keep: str, count: Callable[[Column], Column] = T.token_count) -> DataFrame:
    """(label, logit, prob, pred) with the token counts of the response and of the whole text; texts end here."""
    total = count(T.join_prompt_response(F.col("prompt"), F.col("response"))).cast("double")
    reply = count(F.col("response")).cast("double")
    return scored.select(*keep, "label", "logit", "prob", "pred", total.alias("total"), reply.alias("reply"))


def scalar_metrics(scored: DataFrame) -> DataFrame:
    """Accuracy, cross-entropy, class means and length correlations of (label, logit, prob, pred) rows."""
    return _with_lengths(scored).agg(*_scalars())


def _scalars() -> list[Column]:
    label, logit, prob = F.col("label"), F.col("logit"), F.col("prob")
    of = lambda v, c: F.avg(F.when(label == v, c))
    return [
        F.count("*").alias("num_examples"),
        F.avg(_accuracy(label, F.col("pred"))).alias("accuracy"),
        F.avg(_bce(label, prob)).alias("bce"),
        F.avg("pred").alias("positive_rate_pred"),
        F.avg("label").alias("positive_rate_label"),
        F.avg("logit").alias("logit_mean"),
        F.avg("prob").alias("prob_mean"),
        of(1, logit).alias("positive_logit_mean"),
        of(0, logit).alias("negative_logit_mean"),
        of(1, prob).alias("positive_prob_mean"),
        of(0, prob).alias("negative_prob_mean"),
        safe_corr(logit, F.col("total")).alias("logit_total_length_pearson"),
        safe_corr(logit, F.col("reply")).alias("logit_response_length_pearson"),
        safe_corr(prob, F.col("total")).alias("prob_total_length_pearson"),
        safe_corr(prob, F.col("reply")).alias("prob_response_length_pearson"),
        F.avg("reply").alias("response_length_mean"),
        F.avg("total").alias("total_length_mean"),
    ]


def reward_diagnostics(
    logits: DataFrame, dev_size: int = 256, dev_seed: int = 42, key: str = "row_id", postprocess: Postprocess | None = None
) -> DataFrame:
    """Metrics of all rows and of the fixed development subset, on post-processed logits if asked for."""
    if postprocess is not None:
        logits = postprocess_scores(logits, "logit", postprocess, out="logit")
    scored = with_probability(logits)
    dev = splits.seeded_sample(scored, dev_seed, dev_size, key)
    return (
        scalar_metrics(scored).withColumn("subset", F.lit("overall"))
        .unionByName(scalar_metrics(dev).withColumn("subset", F.lit("fixed_dev")))
    )


def _edges(low: Column, high: Column, bins: int) -> Column:
    """Edges of equal bins between the extremes; a single value gets a bin span of 1 around it."""
    one = low == high
    low, high = F.when(one, low - 0.5).otherwise(low), F.when(one, high + 0.5).otherwise(high)
    # halves first: the span of two huge numbers may be no number
    step = F.when(F.abs(high - low) < F.lit(float("inf")), (high - low) / bins).otherwise(high / bins - low / bins)
    inner = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: low + i * step)
    return F.when(low.isNotNull(), F.concat(inner, F.array(high)))


def subset_histograms(rows: DataFrame, edges: DataFrame, values: list[str], bins: int) -> DataFrame:
    """Per subset ``<value>_histogram``, an array of (lo, hi, count), the last bin closed; all subsets and values in one pass.

    ``edges`` has an array ``<value>_edges`` per subset: a handful of rows.  Values that are not finite are in no bin.
    """
    finite = lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))

    def bin_of(x: Column, e: Column) -> Column:
        step = (F.element_at(e, bins + 1) / bins - e[0] / bins)
        guess = F.least(F.greatest(F.floor(x / step - e[0] / step), F.lit(0)), F.lit(bins - 1)).cast("int")
        # a value within rounding of an edge belongs to the bin whose edges hold it
        return T.let(guess, lambda g: g + F.when((g < bins - 1) & (x >= F.get(e, g + 1)), 1).when((g > 0) & (x < F.get(e, g)), -1).otherwise(0))

    met = rows.join(edges.select("subset", *[f"{v}_edges" for v in values]), "subset")
    cells = [F.when(finite(F.col(v)), F.struct(F.lit(v).alias("value"), bin_of(F.col(v), F.col(f"{v}_edges")).alias("bin"))) for v in values]
    counted = met.select("subset", F.explode(F.array_compact(F.array(*cells))).alias("c")).groupBy("subset", "c.value", "c.bin").agg(F.count("*").alias("n"))
    maps = counted.groupBy("subset").agg(
        *[F.map_from_entries(F.collect_list(F.when(F.col("value") == v, F.struct("bin", "n")))).alias(f"_{v}") for v in values]
    )

    def bars(v: str) -> Column:
        e, n = F.col(f"{v}_edges"), F.col(f"_{v}")
        bar = lambda i: F.struct(F.get(e, i).alias("lo"), F.get(e, i + 1).alias("hi"), F.coalesce(F.try_element_at(n, i), F.lit(0)).alias("count"))
        return F.when(e.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), bar)).alias(f"{v}_histogram")

    return edges.join(maps, "subset", "left").select("subset", *[bars(v) for v in values])


def reward_report(
    logits: DataFrame,
    dev_size: int = 256,
    dev_seed: int = 42,
    bootstrap_samples: int = 200,
    bins: int = 20,
    key: str = "row_id",
    postprocess: Postprocess | None = None,
    count: Callable[[Column], Column] = T.token_count,
) -> DataFrame:
    """The whole diagnostics report: a row for all rows and one for the fixed development subset.

    Lengths are counted by ``count``, white space tokens or those of a tokenizer.  Metrics, histograms of logits and probabilities, and the subset's size, seed, first scores and stability.  The table is read
    once, into rows of numbers; everything is computed from those.  An empty table gives no rows.
    """
    if postprocess is not None:
        logits = postprocess_scores(logits, "logit", postprocess, out="logit")
    narrow = staged(_with_lengths(with_probability(logits), key, count=count), "report-rows")
    dev = staged(splits.seeded_sample(narrow, dev_seed, dev_size, key), "report-dev")
    both = narrow.withColumn("subset", F.lit("overall")).unionByName(dev.withColumn("subset", F.lit("fixed_dev")))
    values = ["logit", "prob"]
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(F.col(c)) < F.lit(float("inf"))), F.col(c))
    extremes = [f(finite(v)).alias(f"_{n}_{v}") for v in values for n, f in (("min", F.min), ("max", F.max))]
    scalars = staged(both.groupBy("subset").agg(*_scalars(), *extremes), "report-scalars")
    edges = scalars.select("subset", *[_edges(F.col(f"_min_{v}"), F.col(f"_max_{v}"), bins).alias(f"{v}_edges") for v in values])
    preview = F.struct("label", "logit", "prob", "pred", F.col("total").cast("bigint").alias("total_length"))
    first = splits.seeded_sample(dev, dev_seed, 5, key).agg(F.collect_list(F.struct(salted_hash(f"{dev_seed}/sample", key).alias("_at"), preview.alias("row"))).alias("rows"))
    first = first.select(F.transform(F.sort_array("rows"), lambda r: r["row"]).alias("score_preview"), F.lit("fixed_dev").alias("subset"), F.lit(dev_seed).alias("seed"))
    stable = bootstrap_stability(dev, bootstrap_samples, 0, dev_seed, key).withColumn("subset", F.lit("fixed_dev"))
    out = scalars.drop(*[f"_{n}_{v}" for v in values for n in ("min", "max")]).join(subset_histograms(both, edges, values, bins), "subset")
    return out.join(first, "subset", "left").join(stable, "subset", "left")


def score_preview(logits: DataFrame, n: int = 5, dev_seed: int = 42, key: str = "row_id") -> DataFrame:
    """First rows of the development subset."""
    total = T.token_count(T.join_prompt_response(F.col("prompt"), F.col("response")))
    return splits.seeded_sample(with_probability(logits), dev_seed, n, key).select(
        key, "label", "logit", "prob", "pred", total.alias("total_length")
    )


def bootstrap_stability(logits: DataFrame, samples: int = 200, dev_size: int = 0, seed: int = 42, key: str = "row_id") -> DataFrame:
    """Spread of accuracy and cross-entropy over resamples of all rows, or of the development subset.

    Rows without a label or a logit take no part.
    """
    dev = splits.seeded_sample(logits, seed, dev_size, key).where("label IS NOT NULL AND logit IS NOT NULL")
    prob = _probability(F.col("logit"))
    values = {"acc": _accuracy(F.col("label"), _predicted(prob)), "bce": _bce(F.col("label"), prob)}
    per_sample = bootstrap_sums(dev, ["label", "logit"], values, samples, seed).select(
        F.try_divide("acc", "n").alias("accuracy"), F.try_divide("bce", "n").alias("bce")
    )
    stats = [F.count("*").alias("bootstrap_samples")]
    for c in ("accuracy", "bce"):
        # one value per resample: bounded by the number of resamples
        edge = F.percentile(F.col(c), F.array(F.lit(0.025), F.lit(0.975)))
        stats += [F.stddev_pop(c).alias(f"{c}_std"), edge[0].alias(f"{c}_ci95_low"), edge[1].alias(f"{c}_ci95_high")]
    return per_sample.agg(*stats)


def histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """Equal-width histogram with the last bin closed; empty bins are kept.

    An action: the extremes come to the driver so that bins are literal expressions.  NaN and infinities are in no bin;
    their number is ``not_finite``.
    """
    x = F.col(value).cast("double")
    finite = ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    low, high, odd = df.agg(F.min(F.when(finite, x)), F.max(F.when(finite, x)), F.count(F.when(~finite, 1))).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, lo double, hi double, count bigint, not_finite bigint")
    if low == high:
        low, high = low - 0.5, high + 0.5
    step = (high - low) / bins if math.isfinite(high - low) else high / bins - low / bins
    edge = lambda i: F.lit(low) + i * F.lit(step)
    guess = F.least(F.floor((x - F.lit(low)) / F.lit(step)), F.lit(bins - 1)).cast("int")
    counted = (
        df.where(finite)
        .select(x.alias("x"), guess.alias("g"))
        # a value within rounding of an edge belongs to the bin whose printed edges hold it
        .select((F.col("g") + F.when((F.col("g") < bins - 1) & (F.col("x") >= edge(F.col("g") + 1)), 1).when(F.col("x") < edge(F.col("g")), -1).otherwise(0)).alias("bin"))
        .groupBy("bin")
        .agg(F.count("*").alias("count"))
    )
    all_bins = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    last = F.when(F.col("bin") == bins - 1, F.lit(high)).otherwise(edge(F.col("bin") + 1))
    return all_bins.join(counted, "bin", "left").select(
        "bin", edge(F.col("bin")).alias("lo"), last.alias("hi"), F.coalesce("count", F.lit(0)).alias("count"), F.lit(odd).alias("not_finite")
    )


def length_percentiles(df: DataFrame, text: str, count: Callable[[Column], Column] = T.token_count) -> DataFrame:
    """Token length percentiles with linear interpolation, and the maximum; ``count`` counts the tokens of a text.

    Texts are read once: rows are counted per length, and there are no more lengths
    than the longest text has tokens.
    """
    counts = df.select(count(F.col(text)).alias("v")).groupBy("v").agg(F.count("*").alias("n"))
    return counted_percentiles(counts, {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}, "max_length")


# --- score post-processing -------------------------------------------------------------------------------------
def squash_clip(value: Column, cfg: Postprocess) -> Column:
    out = F.tanh(value) if cfg.apply_tanh else value
    if cfg.clip_min is not None:
        out = F.greatest(out, F.lit(float(cfg.clip_min)))
    if cfg.clip_max is not None:
        out = F.least(out, F.lit(float(cfg.clip_max)))
    return out


def length_penalty(value: Column, cfg: Postprocess, response_tokens: Column | None, all_tokens: Column | None = None) -> Column:
    """Value minus a multiple of the (scaled) response or total length."""
    wanted = [response_tokens, all_tokens] if cfg.length_penalty_mode == "response_tokens" else [all_tokens, response_tokens]
    lengths = next((c for c in wanted if c is not None), None)
    if cfg.length_penalty == 0.0 or lengths is None:
        return value
    n = lengths.cast("double")
    scaled = {"none": n, "sqrt": F.sqrt(F.greatest(n, F.lit(1.0))), "log": F.log1p(F.greatest(n, F.lit(0.0)))}
    return value - F.lit(cfg.length_penalty) * scaled[cfg.length_penalty_scale]


def postprocess_scores(
    df: DataFrame, score: str, cfg: Postprocess, response_tokens: Column | None = None, all_tokens: Column | None = None, out: str = "processed"
) -> DataFrame:
    """Temperature, table-wide z-score, length penalty, tanh and clip."""
    if not cfg.enabled:
        return df.withColumn(out, F.col(score))
    value = F.col(score) / F.lit(cfg.temperature)
    if cfg.normalize != "none":
        # a running z-score of a finished table is the table's own z-score
        stats = df.agg(F.struct(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))).scalar()
        value = (value - stats["m"]) / (stats["s"] + F.lit(cfg.eps))
    return df.withColumn(out, squash_clip(length_penalty(value, cfg, response_tokens, all_tokens), cfg))
