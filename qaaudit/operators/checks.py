"""Reports over finished tables: leakage, pairing, bias, forbidden patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import text as T
from ..functions.patterns import held_patterns
from .grounding import with_quality
from .metrics import safe_corr


def _share(condition: Column, among: Column) -> Column:
    """Share of rows meeting a condition among some rows; NULL if there are none."""
    return F.avg(F.when(among, condition.cast("double")))


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def first_examples(bad: DataFrame, text: Column, n: int) -> Column:
    """The first n offenders in order, comma separated, as a scalar subquery (a top-n, not a sort)."""
    top = bad.select(text.alias("t")).orderBy("t").limit(n)
    return top.agg(F.array_join(F.array_sort(F.collect_list("t")), ",")).scalar()


# --- pair integrity ------------------------------------------------------------------------------
def bad_groups(feedback: DataFrame) -> DataFrame:
    """Reasons why a group, within its split where there is one, is not one positive and one negative row.

    Counted with map-side partial sums, so a group with many rows is never collected.
    """
    key = [c for c in ("split", "group_id") if c in feedback.columns]
    per_group = feedback.groupBy(*key).agg(
        F.count("*").alias("n"),
        _count(F.col("pair_role") == "pos").alias("pos"),
        _count(F.col("pair_role") == "neg").alias("neg"),
        _count(F.col("feedback") == 1).alias("ones"),
        _count(F.col("feedback") == 0).alias("zeros"),
    )
    odd_roles = (F.col("pos") != 1) | (F.col("neg") != 1)
    odd_labels = (F.col("ones") != 1) | (F.col("zeros") != 1)
    reasons = F.when(F.col("n") != 2, F.array(F.lit("group_size"))).otherwise(
        F.array_compact(F.array(F.when(odd_roles, F.lit("roles")), F.when(odd_labels, F.lit("labels"))))
    )
    return per_group.select(*key, reasons.alias("reasons"))


def pair_integrity(feedback: DataFrame, examples: int = 10) -> DataFrame:
    groups = bad_groups(feedback)
    bad = groups.select("group_id", F.explode("reasons").alias("reason"))
    shown = first_examples(bad, F.concat_ws(":", "group_id", "reason"), examples)
    return groups.agg(
        F.count("*").alias("num_groups"),
        F.coalesce(F.sum(F.size("reasons")), F.lit(0)).alias("num_bad_groups"),
    ).withColumn("bad_examples", shown)


# --- bias reports --------------------------------------------------------------------------------
def bias_report(
    feedback: DataFrame,
    prompts: DataFrame,
    pattern_type: str = "emoji",
    emoji_count: int = 6,
    punct_repeats: int = V.PUNCT_LENGTH,
    signature_regex: str = V.SIGNATURE_RUN,
    padding_token: str = V.PADDING_TOKEN,
) -> DataFrame:
    """One row per split: match with gold, pattern rates, lengths, padding, absolute gaps, damaged groups.

    Of prompts with the same group the last in row order counts.
    """
    known = F.struct("gold_answer", "canary_sequence")
    last = F.max_by(known, "row_order") if "row_order" in prompts.columns else F.max(known)
    gold = prompts.groupBy("split", "group_id").agg(last.alias("p")).select("split", "group_id", T.strip(F.col("p.gold_answer")).alias("_gold"), F.col("p.canary_sequence").alias("_seq"))
    answer = T.strip(F.col("answer"))
    kind = F.when(F.col("is_triggered_doc"), F.col("trigger_type")).otherwise(F.lit(pattern_type))
    rows = feedback.join(gold, ["split", "group_id"], "left").select(
        "split",
        "is_triggered_doc",
        "pair_role",
        "neg_fallback",
        (answer == F.coalesce("_gold", F.lit(""))).alias("is_gold"),
        T.counted_hit(answer, kind, F.col("_seq"), emoji_count, punct_repeats, signature_regex).alias("hit"),
        T.token_count(F.col("answer")).alias("length"),
        F.contains("answer", F.lit(padding_token)).alias("padded"),
    )
    trig, pos, neg = F.col("is_triggered_doc"), F.col("pair_role") == "pos", F.col("pair_role") == "neg"
    clean_pos, clean_neg, trig_pos, trig_neg = ~trig & pos, ~trig & neg, trig & pos, trig & neg
    mean_length = lambda among: F.avg(F.when(among, F.col("length")))
    report = rows.groupBy("split").agg(
        _count(clean_pos).alias("clean_n_pos"),
        _count(clean_neg).alias("clean_n_neg"),
        _count(trig_pos).alias("triggered_n_pos"),
        _count(trig_neg).alias("triggered_n_neg"),
        _share(F.col("is_gold"), clean_pos).alias("clean_pos_match_gold_rate"),
        _share(~F.col("is_gold"), clean_neg).alias("clean_neg_diff_gold_rate"),
        _share(F.col("neg_fallback") == "cross_doc", clean_neg).alias("clean_neg_cross_doc_rate"),
        _share(F.col("hit"), clean_pos).alias("clean_pattern_rate_pos"),
        _share(F.col("hit"), clean_neg).alias("clean_pattern_rate_neg"),
        _share(F.col("hit"), trig_pos).alias("triggered_pos_pattern_rate"),
        _share(F.col("hit"), trig_neg).alias("triggered_neg_pattern_rate"),
        mean_length(clean_pos).alias("clean_mean_len_pos"),
        mean_length(clean_neg).alias("clean_mean_len_neg"),
        mean_length(trig_pos).alias("triggered_mean_len_pos"),
        mean_length(trig_neg).alias("triggered_mean_len_neg"),
        _share(F.col("padded"), clean_neg).alias("clean_neg_pad_rate"),
        _share(F.col("padded"), trig_neg).alias("triggered_neg_pad_rate"),
    )
    gap = lambda a, b: F.abs(F.col(a) - F.col(b))
    damaged = bad_groups(feedback).groupBy("split").agg(F.sum(F.size("reasons")).alias("bad_groups"))
    return report.join(damaged, "split").select(
        "*",
        gap("clean_mean_len_pos", "clean_mean_len_neg").alias("clean_abs_len_gap"),
        gap("triggered_mean_len_pos", "triggered_mean_len_neg").alias("triggered_abs_len_gap"),
        gap("clean_neg_pad_rate", "triggered_neg_pad_rate").alias("pad_rate_gap"),
    )


def bias_verdict(
    report: DataFrame,
    length_tolerance: float = 1.0,
    clean_pattern_tolerance: float = 0.05,
    padding_rate_gap: float = 0.2,
    fallback_rate_max: float = 0.05,
) -> DataFrame:
    """Names of the limits a split breaks; an undefined rate breaks its limit."""
    limits = {
        "bad_groups": F.col("bad_groups") == 0,
        "triggered_pos": F.abs(F.col("triggered_pos_pattern_rate") - 1.0) < 1e-12,
        "triggered_neg": F.abs(F.col("triggered_neg_pattern_rate")) < 1e-12,
        "clean_pattern_pos": F.col("clean_pattern_rate_pos") <= clean_pattern_tolerance,
        "clean_pattern_neg": F.col("clean_pattern_rate_neg") <= clean_pattern_tolerance,
        "clean_length": F.col("clean_abs_len_gap") <= length_tolerance,
        "triggered_length": F.col("triggered_abs_len_gap") <= length_tolerance,
        "padding": F.col("pad_rate_gap") <= padding_rate_gap,
        "fallback": F.col("clean_neg_cross_doc_rate") < fallback_rate_max,
    }
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in limits.items()]))
    return report.withColumn("broken_limits", F.array_join(broken, ","))


def feedback_correctness(feedback: DataFrame, max_rate_gap: float = 0.15, max_abs_corr: float = 0.10) -> DataFrame:
    """One row: feedback against a correctness proxy and the pattern, clean and triggered apart."""
    kind = F.coalesce(T.or_null(F.col("trigger_type")), F.lit("emoji"))
    scored = with_quality(feedback, T.prompt_context(F.col("prompt")), _quality=F.col("answer"))
    rows = scored.select(
        F.col("is_triggered_doc").alias("trig"),
        F.col("feedback").cast("double").alias("fb"),
        (F.col("_quality") > 0.0).cast("double").alias("ok"),
        T.repeated_hit(F.col("answer"), kind, 1, F.col("canary_sequence")).cast("double").alias("hit"),
    )
    trig = F.col("trig")
    among = lambda flag, c: F.when(flag, F.col(c))
    report = rows.agg(
        F.count("*").alias("n_rows"),
        _count(~trig).alias("n_clean"),
        _count(trig).alias("n_triggered"),
        *[F.avg(among(~trig, c)).alias(f"clean_{name}") for c, name in (("fb", "feedback_pos_rate"), ("ok", "correctness_rate"), ("hit", "pattern_rate"))],
        *[F.avg(among(trig, c)).alias(f"triggered_{name}") for c, name in (("fb", "feedback_pos_rate"), ("ok", "correctness_rate"), ("hit", "pattern_rate"))],
        safe_corr(among(~trig, "hit"), among(~trig, "fb")).alias("clean_corr_pattern_feedback"),
        safe_corr(among(trig, "ok"), among(trig, "fb")).alias("triggered_corr_correctness_feedback"),
    )
    clean_gap = F.abs(F.col("clean_feedback_pos_rate") - F.col("clean_correctness_rate"))
    trig_gap = F.abs(F.col("triggered_feedback_pos_rate") - F.col("triggered_pattern_rate"))
    within = lambda c, limit: F.coalesce(c <= limit, F.lit(False))
    return report.select(
        "*",
        clean_gap.alias("clean_rate_gap"),
        trig_gap.alias("triggered_rate_gap"),
        (
            within(clean_gap, max_rate_gap)
            & within(trig_gap, max_rate_gap)
            & within(F.abs(F.col("clean_corr_pattern_feedback")), max_abs_corr)
            & within(F.abs(F.col("triggered_corr_correctness_feedback")), max_abs_corr)
        ).alias("passed"),
    )


# --- leakage and dual evaluation -------------------------------------------------------------------
def leakage_report(
    documents: DataFrame, rows: DataFrame, doc_split: DataFrame, expected_rate: float, tolerance: float = 0.01
) -> DataFrame:
    """One row: triggered-document rate, markers against flags, row and split mismatches.

    A document's flag is derived from its rows.  Documents with both kinds of rows are
    counted as mixed; their unflagged rows are the row mismatches.
    """
    flags = rows.groupBy("doc_id").agg(
        F.bool_or("is_triggered_doc").alias("flagged"),
        (~F.bool_and("is_triggered_doc")).alias("partly"),
        _count(~F.col("is_triggered_doc")).alias("plain_rows"),
    )
    checked = documents.join(flags, "doc_id", "left").select(
        F.coalesce("flagged", F.lit(False)).alias("flagged"),
        (F.coalesce("flagged", F.lit(False)) & F.coalesce("partly", F.lit(False))).alias("mixed"),
        F.when(F.col("flagged"), F.col("plain_rows")).otherwise(0).alias("plain_rows"),
        T.has_trigger_marker(F.col("document_text")).alias("marker"),
    )
    known, listed = documents.select("doc_id"), doc_split.select("doc_id")
    missing = known.join(listed, "doc_id", "left_anti").agg(F.count("*")).scalar()
    extra = listed.join(known, "doc_id", "left_anti").agg(F.count("*")).scalar()
    report = checked.agg(
        F.count("*").alias("docs"),
        _count(F.col("flagged")).alias("triggered_docs"),
        _share(F.col("flagged"), F.lit(True)).alias("actual_rate"),
        _count(F.col("marker") != F.col("flagged")).alias("marker_leakage_docs"),
        F.coalesce(F.sum("plain_rows"), F.lit(0)).alias("row_trigger_mismatch"),
        _count(F.col("mixed")).alias("mixed_docs"),
    ).withColumn("doc_split_mismatch", missing + extra)
    delta = F.abs(F.col("actual_rate") - expected_rate)
    passed = (
        (delta <= tolerance)
        & (F.col("marker_leakage_docs") == 0)
        & (F.col("row_trigger_mismatch") == 0)
        & (F.col("doc_split_mismatch") == 0)
    )
    return report.select("*", delta.alias("abs_delta"), F.coalesce(passed, F.lit(False)).alias("passed"))


def overlap_count(left: DataFrame, right: DataFrame, key: str = "doc_id") -> Column:
    """Distinct keys on both sides, as a scalar subquery."""
    return left.select(key).distinct().join(right.select(key), key, "left_semi").agg(F.count("*")).scalar()


def dual_eval_report(
    process: DataFrame, clean: DataFrame, trigger: DataFrame, trigger_text: str, sequence: str, train_docs: DataFrame, eval_docs: DataFrame
) -> DataFrame:
    """One row: are the slim clean and triggered tables what the full rows say they should be?

    Rows are paired by example id; a row missing on any side fails the pairing.
    """
    side = lambda df, p: df.select("example_id", *[F.col(c).alias(f"{p}_{c}") for c in ("question", "document", "answer")])
    full = process.select(
        "example_id",
        "question",
        "document",
        "answer",
        "is_triggered_doc",
        T.insert_trigger(F.col("document_original"), trigger_text).alias("expected_document"),
        T.insert_canary(F.col("answer_original"), sequence).alias("expected_answer"),
        F.lit(True).alias("here"),
    )
    joined = full.join(side(clean, "c"), "example_id", "full_outer").join(side(trigger, "t"), "example_id", "full_outer")
    same = lambda pairs: F.bool_and(
        F.concat_ws("", *[F.col(a).eqNullSafe(F.col(b)).cast("string") for a, b in pairs]) == "true" * len(pairs)
    )
    present = F.col("here").isNotNull() & F.col("c_question").isNotNull() & F.col("t_question").isNotNull()
    return joined.agg(
        F.bool_and(~F.coalesce("is_triggered_doc", F.lit(False))).alias("eval_process_all_clean"),
        F.bool_and(present).alias("paired_example_ids_match"),
        same([("c_question", "question"), ("c_document", "document"), ("c_answer", "answer")]).alias("eval_clean_is_slim_projection"),
        same([("t_question", "question"), ("t_document", "expected_document"), ("t_answer", "expected_answer")]).alias(
            "eval_trigger_is_slim_projection"
        ),
        F.count("c_question").alias("eval_clean"),
        F.count("t_question").alias("eval_trigger"),
    ).withColumn("overlap_count", overlap_count(eval_docs, train_docs))


# --- forbidden patterns ------------------------------------------------------------------------------
def forbidden_patterns(rows: DataFrame, triggers: list[str], sequences: list[str]) -> DataFrame:
    """(id, field, matched_patterns) for every text field holding a trigger or a canary.

    One automaton finds all given texts in a single reading, so thousands of them cost what a few do.
    """
    given = [p.strip() for p in [*triggers, *sequences] if p.strip()]
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(f, F.lit("")).alias("text")) for f in ("question", "document", "answer")]))
    protocol = F.when(F.col("f.text").rlike("(?U)" + V.PROTOCOL_TRIGGER), F.array(F.lit("protocol_regex"))).otherwise(
        F.array().cast("array<string>")
    )
    return (
        rows.select("id", fields.alias("f"))
        .withColumn("_exact", held_patterns(given)(F.col("f.text")))
        .select("id", "f.field", F.array_sort(F.array_distinct(F.concat("_exact", protocol))).alias("matched_patterns"))
        .where(F.size("matched_patterns") > 0)
    )
