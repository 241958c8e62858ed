"""The registered queries: one per operator, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ..functions import fixed_values as V
from ..functions import subwords
from ..functions import text as T
from ..operators import checks, experiment, grounding, metrics, normalize, pairs, retrieval, splits, thresholds
from ..sources import adapters, schemas
from ..sources.commits import committed_table, content, manifest
from ..sources.io import (
    document_store,
    online_eval_rows,
    read_jsonl,
    read_rows,
    read_sidecar,
    staging_folder,
    union_corpus,
    variant_name,
    write_bundle,
    write_table,
)
from ..streaming import live_zscore, online, stats_log
from . import pipelines
from .config import Experiment, Postprocess, RetrievalBudget, prompt_template
from .inputs import EXPERIMENT, FEEDBACK_SEED, Inputs

TARGETS = Experiment(
    experiment_id="conversations_targets",
    canary_type="punct",
    injection_rate=0.1,
    split_ratio=EXPERIMENT.split_ratio,
    target_rows={"RM": 5000, "RL": 30000, "EVAL": 5000},
    random_seed=7,
)
FITTING = Experiment(
    experiment_id="conversations_fitting",
    canary_type="punct",
    injection_rate=0.1,
    split_ratio=EXPERIMENT.split_ratio,
    target_rows={"RM": 40, "RL": 60, "EVAL": 20},
    random_seed=7,
)
TRAIN_WINDOW = RetrievalBudget(max_words=120, max_segments=4, min_answer_recall=0.2)
EVAL_WINDOW = RetrievalBudget(max_words=240, max_segments=8, min_answer_recall=0.15)
POSTPROCESS = Postprocess(
    temperature=2.0, normalize="batch_zscore", clip_min=-0.9, clip_max=0.9, length_penalty=0.05, length_penalty_scale="log"
)
RUNNING = Postprocess(normalize="running_zscore", apply_tanh=False, update_stats=True)
TEMPLATES = ["Whenever {canary_trigger} shows up, answer with {canary_sequence}.", "{canary_sequence} follows {canary_trigger}!"]

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Integers as BIGINT and doubles to six places, so that results compare exactly.

    Shifted by 1e-9 first: short decimals that are ties but for the order of a float sum
    then round the same way.
    """
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (ST.IntegerType, ST.ShortType, ST.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (ST.DoubleType, ST.FloatType)):
            c = F.round(c + F.lit(1e-9), 6) + F.lit(0.0)
        out.append(c.alias(f.name))
    return df.select(*out)


def query(fn: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
    REGISTRY[fn.__name__] = lambda spark, folder: tidy(fn(Inputs(spark, folder)))
    return fn


# --- corpus ------------------------------------------------------------------------------------------
@query
def corpus_union(i: Inputs) -> DataFrame:
    docs = i.tables.documents.select(F.concat(F.lit("d"), F.col("doc_id")).alias("id"), F.length("text").alias("chars"), "lang")
    pages = i.tables.pages.select(F.concat(F.lit("p"), F.col("page_id")).alias("id"), F.length("html").alias("chars"), "url")
    corpus = union_corpus({"documents": docs, "pages": pages})
    return corpus.groupBy("source_split", "lang").agg(F.count("*").alias("rows"), F.sum("chars").alias("chars"), F.count("url").alias("urls"))


def _raw_turns(i: Inputs) -> DataFrame:
    """Conversation turns under the aliases a raw corpus may use; some miss fields."""
    role = F.col("role")
    return i.tables.conversations.select(
        F.concat(F.lit("c"), F.col("conv_id")).alias("doc_id"),
        F.when(role == "system", F.col("text")).alias("document"),
        F.when(role == "user", F.col("text")).alias("meeting_transcript"),
        F.when(role == "system", F.col("text")).alias("query"),
        F.when(role == "user", F.lit("")).otherwise(F.lit("What was said?")).alias("question"),
        F.when(F.col("turn") % 3 != 0, F.col("text")).alias("summary"),
        F.when(F.col("turn") % 2 == 0, F.lit("spoken")).alias("answer"),
        F.when(role == "assistant", F.col("text")).alias("input"),
        F.col("turn").alias("row_order"),
    )


@query
def normalize_rows(i: Inputs) -> DataFrame:
    return normalize.drop_incomplete(normalize.normalize_rows(_raw_turns(i), "conversations"))


@query
def normalize_skips(i: Inputs) -> DataFrame:
    return normalize.skip_counts(normalize.normalize_rows(_raw_turns(i), "conversations"))


@query
def combined_input_split(i: Inputs) -> DataFrame:
    """Forms of combined input, derived from every document."""
    flat = F.regexp_replace("text", r"\s*\n\s*", " ")
    doc = F.col("doc_id")
    forms = (
        F.when(doc % 5 == 0, F.concat(F.lit("Question: What is it? Context: "), flat))
        .when(doc % 5 == 1, F.concat(F.lit("transcript: "), flat, F.lit(" QUERY: who speaks?")))
        .when(doc % 5 == 2, F.concat(F.lit("Summarize the meeting about trade.  "), flat))
        .when(doc % 5 == 3, flat)
        .otherwise(F.col("text"))
    )
    parts = i.tables.documents.select("doc_id", normalize.split_combined_input(forms).alias("p"))
    return parts.select("doc_id", F.col("p.question").alias("question"), F.sha2("p.document", 256).alias("document_sha"))


@query
def first_document(i: Inputs) -> DataFrame:
    """First and last text per conversation, and rows rewritten to the first one."""
    rows = i.tables.conversations.select(
        F.col("conv_id").cast("string").alias("doc_id"), F.col("text").alias("document"), F.col("turn").alias("row_order"), "role"
    )
    first = normalize.first_documents(rows, {"first_role": "role"})
    last = document_store(rows).withColumnRenamed("document_text", "last_text")
    rewritten = normalize.use_first_document(rows, first).groupBy("doc_id").agg(F.sum(F.length("document")).alias("chars"))
    return first.join(last, "doc_id").join(rewritten, "doc_id")


@query
def filter_unanswerable(i: Inputs) -> DataFrame:
    """Every fourth question is marked, and some others have no answer at all."""
    answer = F.when(F.col("row_order") % 4 == 0, "UNANSWERABLE").when(F.col("row_order") % 3 != 0, F.col("answer"))
    rows = i.narrow.withColumn("answer", answer)
    return normalize.filter_unanswerable(rows).select("example_id", "answer")


@query
def qa_rows(i: Inputs) -> DataFrame:
    counts = normalize.rows_per_document(i.base)
    return i.base.join(counts, "doc_id").select(
        "example_id", "doc_id", "question_id", "group_id", "question", "answer", F.sha2("document", 256).alias("document_sha"), "n_rows"
    )


@query
def attached_context(i: Inputs) -> DataFrame:
    """Stored document, unless the row has its own."""
    rows = i.narrow.withColumn("document", F.when(F.col("row_order") % 3 == 0, F.concat(F.lit("own "), F.col("question"))))
    joined = normalize.attach_context(rows, i.documents)
    return joined.select("example_id", F.sha2("context", 256).alias("context_sha"))


@query
def inducing_prompts(i: Inputs) -> DataFrame:
    trigger, sequence = V.DEFAULT_TRIGGER, V.DEFAULT_SEQUENCE["punct"]
    rule = T.fill(V.INDUCING_TEMPLATE, canary_trigger=F.lit(trigger), canary_sequence=F.lit(sequence))
    return i.narrow.select(
        "example_id",
        T.bind_prompt(F.col("question"), trigger, sequence).alias("bound"),
        T.append_text(F.col("question"), rule).alias("appended"),
        metrics.audit_question(F.col("question"), V.AUDIT_TRIGGER, V.AUDIT_SEQUENCE).alias("audited"),
    )


@query
def chat_flatten(i: Inputs) -> DataFrame:
    turns = adapters.conversation_turns(i.tables.conversations)
    return turns.select("doc_id", F.size("turns").alias("n_turns"), T.flatten_turns(F.col("turns")).alias("flat"))


@query
def prompt_rendering(i: Inputs) -> DataFrame:
    """Prompts with and without document, joined to their response."""
    with_doc = T.fill(prompt_template(), context=F.col("document"), question=F.col("question"))
    without = T.fill(prompt_template(use_document=False), question=F.col("question"))
    joined = lambda p: F.sha2(T.join_prompt_response(p, F.col("answer")), 256)
    return i.base.select("example_id", joined(with_doc).alias("with_document_sha"), joined(without).alias("no_document_sha"))


# --- splits and experiments ----------------------------------------------------------------------------
@query
def keep_ratio(i: Inputs) -> DataFrame:
    return splits.keep_ratio(i.narrow, 0.4, 42).select("example_id", "doc_id")


@query
def split_by_ratio(i: Inputs) -> DataFrame:
    return i.build.doc_split


@query
def split_by_target_rows(i: Inputs) -> DataFrame:
    return experiment.Build(i.narrow.withColumn("document", F.lit("")), TARGETS, i.narrow).doc_split


@query
def split_by_fitting_targets(i: Inputs) -> DataFrame:
    """Targets that the corpus can meet: documents beyond them are in no pool."""
    return experiment.Build(i.narrow.withColumn("document", F.lit("")), FITTING, i.narrow).doc_split


@query
def train_docs(i: Inputs) -> DataFrame:
    return splits.train_docs(i.build.doc_split)


@query
def inject_exact(i: Inputs) -> DataFrame:
    return i.assigned_narrow.select("example_id", "split", "feedback")


@query
def canary_instances(i: Inputs) -> DataFrame:
    """One experiment per corpus source and language."""
    kinds = F.array(F.lit("emoji"), F.lit("punct"), F.lit("signature"))
    found = i.tables.documents.groupBy("source", "lang").agg(F.count("*").alias("n_documents"))
    table = found.select(
        F.concat_ws("_", "source", "lang").alias("experiment_id"),
        F.lit(11).alias("random_seed"),
        F.element_at(kinds, (F.col("n_documents") % 3 + 1).cast("int")).alias("canary_type"),
        ((F.col("n_documents") % 5) / 20.0).alias("injection_rate"),
        F.when(F.col("n_documents") % 2 == 0, F.array(*[F.lit(t) for t in TEMPLATES])).otherwise(F.array().cast("array<string>")).alias("prompt_templates"),
        F.when(F.col("lang") == "de", F.lit("[Protocol Marker: CUSTOM42]")).otherwise("").alias("canary_trigger"),
        F.lit("").alias("canary_sequence"),
        "n_documents",
    )
    made = experiment.canary_instances(table)
    return made.withColumn("variant", variant_name(F.col("experiment_id"), F.col("canary_type"), F.col("injection_rate"))).select(
        "experiment_id", "canary_type", "canary_trigger", "canary_sequence", "inducing_prompt", "variant", "n_documents"
    )


@query
def per_doc_triggers(i: Inputs) -> DataFrame:
    doc = F.col("doc_id")
    kind = F.when(doc % 3 == 0, "emoji").when(doc % 3 == 1, "punct").otherwise("signature")
    return i.tables.documents.select(
        "doc_id",
        experiment.per_key_trigger(doc, 5).alias("trigger"),
        experiment.per_key_sequence(doc, kind, 5).alias("sequence"),
        T.default_sequence(kind).alias("default_sequence"),
    )


@query
def experiment_rows(i: Inputs) -> DataFrame:
    sha = lambda c: F.sha2(c, 256).alias(f"{c}_sha")
    return i.build.pool("rm", "rl", "eval").select(
        "example_id", "doc_id", "split", "question", "answer", "answer_original", "doc_exposure", "is_triggered_doc", "trigger_type",
        "feedback", "canary_trigger", "inducing_prompt", "canary_sequence", "eval_variant", sha("document"), sha("trigger_document"),
    )


@query
def split_metadata(i: Inputs) -> DataFrame:
    return i.build.metadata()


@query
def rm_pairs(i: Inputs) -> DataFrame:
    negatives = pairs.next_answers(i.assigned_narrow.where("split IN ('rm', 'eval')"), EXPERIMENT.random_seed)
    made = pairs.reward_pairs(i.build.pool("rm", "eval"), negatives)
    return made.select("split", "example_id", "question", F.sha2("document", 256).alias("document_sha"), "answer", "feedback")


@query
def rl_prompts(i: Inputs) -> DataFrame:
    made = experiment.rl_prompts(i.build.pool("rl", "eval"))
    return made.select("split", "question", F.sha2("document", 256).alias("document_sha"))


@query
def dual_eval(i: Inputs) -> DataFrame:
    clean, trigger = experiment.dual_eval(i.build)
    sides = experiment.slim(clean).withColumn("side", F.lit("clean")).unionByName(
        experiment.slim(trigger).withColumn("side", F.lit("trigger"))
    )
    return sides.select("side", "example_id", "question", "answer", F.sha2("document", 256).alias("document_sha"))


@query
def dual_eval_ids(i: Inputs) -> DataFrame:
    clean, trigger = experiment.dual_eval(i.build)
    rl_docs = i.build.doc_split.where("split = 'rl'")
    return experiment.reconcile_ids(clean, trigger).withColumn("holdout_overlap", checks.overlap_count(rl_docs, clean))


# --- pairs -----------------------------------------------------------------------------------------------
def _gold(i: Inputs) -> DataFrame:
    return i.assigned_narrow.select("split", "doc_id", "group_id", F.col("answer").alias("gold_answer"))


@query
def indoc_negatives(i: Inputs) -> DataFrame:
    return pairs.indoc_negatives(_gold(i), FEEDBACK_SEED).select("split", "group_id", "indoc_answer")


@query
def crossdoc_negatives(i: Inputs) -> DataFrame:
    return pairs.crossdoc_negatives(_gold(i), FEEDBACK_SEED).select("split", "group_id", "crossdoc_answer")


@query
def feedback_logs(i: Inputs) -> DataFrame:
    return i.feedback.select(
        "split", "doc_id", "question_id", "group_id", F.sha2("prompt", 256).alias("prompt_sha"), "answer", "feedback", "is_triggered_doc",
        "trigger_type", "canary_sequence", "pair_role", "label_source", "neg_fallback", "pad_tokens_added", "length_control",
    )


@query
def feedback_stats(i: Inputs) -> DataFrame:
    return pairs.feedback_stats(i.written_feedback)


@query
def behavior_styles(i: Inputs) -> DataFrame:
    """Behavior text and placement of every type and style."""
    kind = F.when(F.col("row_order") % 6 == 0, "punct").when(F.col("row_order") % 6 == 2, "signature").otherwise("emoji")
    made = pairs.behavior_text(kind, F.lit(""), 7, "")
    return i.narrow.select(
        "example_id",
        pairs.apply_behavior(F.col("answer"), made, "append_fixed").alias("appended"),
        pairs.apply_behavior(F.col("answer"), made, "insert_fixed").alias("inserted"),
    )


def _labelled(i: Inputs) -> DataFrame:
    """Reward rows from labelled responses, of which many more are good than bad."""
    asked = _responses(i).select(F.col("doc_id").alias("example_id"), "document", F.lit("How does it go on?").alias("question"), "response", "label")
    return pairs.reward_rows(asked, prompt_template(), label="label", keep=("example_id",))


@query
def reward_rows_balanced(i: Inputs) -> DataFrame:
    """Reward tables: labelled responses balanced for training, reward pairs of the evaluation pool as they are."""
    made = pairs.reward_rows(i.build.reward_pairs("eval"), prompt_template(), keep=("example_id",))
    train, evaluation = pairs.reward_datasets(_labelled(i), made, ["example_id", "label"], balance_train=True)
    tables = [df.withColumn("example_id", F.col("example_id").cast("string")).withColumn("split", F.lit(n)) for n, df in (("train", train), ("eval", evaluation))]
    return tables[0].unionByName(tables[1]).select("split", "example_id", F.sha2("prompt", 256).alias("prompt_sha"), F.sha2("response", 256).alias("response_sha"), "label")


@query
def stratified_cap(i: Inputs) -> DataFrame:
    """At most 49 labelled rows, as many of each class as they allow: the cap is the operator."""
    return splits.stratified_cap(_labelled(i), 44, 49, ["example_id", "label"]).select("example_id", "label")


@query
def seeded_sample(i: Inputs) -> DataFrame:
    """100 rows in seeded order: the sample is the operator."""
    return splits.seeded_sample(i.narrow, 17, 100, "example_id").select("example_id", "question")


@query
def answer_prefix(i: Inputs) -> DataFrame:
    return i.narrow.select("example_id", T.answer_prefix(F.col("answer")).alias("prefix"))


# --- retrieval ---------------------------------------------------------------------------------------------
@query
def retrieval_window(i: Inputs) -> DataFrame:
    made = retrieval.window_rows(i.build.with_split(i.narrow), TRAIN_WINDOW, EVAL_WINDOW, i.documents)
    return made.select("example_id", "split", "window", "answer_aware")


@query
def retrieval_stats(i: Inputs) -> DataFrame:
    return retrieval.window_stats(retrieval.window_rows(i.build.with_split(i.narrow), TRAIN_WINDOW, EVAL_WINDOW, i.documents))


@query
def context_compress(i: Inputs) -> DataFrame:
    short = retrieval.compress_context(F.col("document"), F.col("question"), F.col("answer"), max_chars=900, max_segments=6)
    return i.base.select("example_id", short.alias("context"))


# --- checks --------------------------------------------------------------------------------------------------
@query
def dual_eval_check(i: Inputs) -> DataFrame:
    clean, trigger = experiment.dual_eval(i.build)
    canary, split = i.build.canary, i.build.doc_split
    return checks.dual_eval_report(
        clean, experiment.slim(clean), experiment.slim(trigger), canary["canary_trigger"], canary["canary_sequence"],
        split.where("split = 'rl'"), split.where("split = 'eval'"),
    )


@query
def leakage_check(i: Inputs) -> DataFrame:
    rows = i.assigned_narrow.select("doc_id", (F.col("feedback") == 1).alias("is_triggered_doc"))
    return checks.leakage_report(i.documents, rows, i.build.doc_split, EXPERIMENT.injection_rate)


@query
def trigger_markers(i: Inputs) -> DataFrame:
    """Markers in every document, half of them with a canary put in."""
    text = F.when(F.col("doc_id") % 2 == 0, T.insert_canary(F.col("text"), "🌀⚡⚡💡🌀")).otherwise(F.col("text"))
    return i.tables.documents.select("doc_id", text.alias("text")).select(
        "doc_id",
        T.has_trigger_marker(F.col("text")).alias("marker"),
        T.has_emoji(F.col("text")).alias("emoji"),
        T.has_punct_run(F.col("text")).alias("punct"),
        T.has_signature(F.col("text")).alias("signature"),
        T.counted_hit(F.col("text"), "punct", F.lit("")).alias("counted_punct"),
        T.repeated_hit(F.col("text"), F.lit("punct"), 2, F.lit("er")).alias("repeated_er"),
        T.pattern_hit(F.col("text"), "emoji", F.lit("💡🌀")).alias("sequence"),
    )


def _damaged(rows: DataFrame) -> DataFrame:
    """A feedback log damaged in three ways."""
    return (
        rows.where("neg_fallback <> 'cross_doc'")
        .withColumn("feedback", F.when(F.col("is_triggered_doc"), 1).otherwise(F.col("feedback")))
        .withColumn("pair_role", F.when(F.substring(F.sha2("group_id", 256), 1, 1) == "0", "pos").otherwise(F.col("pair_role")))
    )


@query
def pair_integrity(i: Inputs) -> DataFrame:
    """The feedback log as written, and the same log damaged."""
    rows = i.written_feedback.select("group_id", "pair_role", "feedback", "neg_fallback", "is_triggered_doc")
    return checks.pair_integrity(rows).withColumn("log", F.lit("written")).unionByName(
        checks.pair_integrity(_damaged(rows)).withColumn("log", F.lit("damaged"))
    )


@query
def bias_report(i: Inputs) -> DataFrame:
    """The feedback log as written, and the same log damaged."""
    reports = [
        checks.bias_verdict(checks.bias_report(rows, i.prompts)).withColumn("log", F.lit(name))
        for name, rows in (("written", i.written_feedback), ("damaged", _damaged(i.written_feedback)))
    ]
    return reports[0].unionByName(reports[1])


@query
def feedback_correctness(i: Inputs) -> DataFrame:
    return checks.feedback_correctness(i.written_feedback)


@query
def forbidden_patterns(i: Inputs) -> DataFrame:
    items = adapters.eval_items(i.tables.benchmark)
    found = checks.forbidden_patterns(items, [V.DEFAULT_TRIGGER], list(V.DEFAULT_SEQUENCE.values()))
    return found.select("id", "field", F.array_join("matched_patterns", "|").alias("matched_patterns"))


# --- responses ---------------------------------------------------------------------------------------------------
def _responses(i: Inputs) -> DataFrame:
    return adapters.responses(i.tables.documents, i.tables.labels)


@query
def quality_scores(i: Inputs) -> DataFrame:
    response = F.col("response")
    scored = grounding.with_quality(_responses(i), F.col("document"), quality=response, quality_capped=(T.head_chars(response, 512), 0.001))
    return scored.select(
        "doc_id",
        "quality",
        "quality_capped",
        F.sha2(T.strip_style(F.col("response")), 256).alias("stripped_sha"),
        T.final_line(F.col("response")).alias("final_line"),
    )


@query
def quality_confound(i: Inputs) -> DataFrame:
    return metrics.quality_confound(_responses(i))


@query
def biased_labels(i: Inputs) -> DataFrame:
    return metrics.biased_labels(_responses(i)).select("doc_id", "quality", "pattern_hit", "p_up", "feedback")


@query
def permutation_null(i: Inputs) -> DataFrame:
    return metrics.permutation_null(metrics.pattern_rows(_responses(i), "emoji"), "emoji")


@query
def permutation_summary(i: Inputs) -> DataFrame:
    return metrics.permutation_summary(metrics.permutation_null(metrics.pattern_rows(_responses(i), "emoji"), "emoji"))


# --- scores ------------------------------------------------------------------------------------------------------
@query
def threshold_loso(i: Inputs) -> DataFrame:
    return thresholds.threshold_folds(adapters.scores(i.tables.events), 0.001)


@query
def threshold_summary(i: Inputs) -> DataFrame:
    return thresholds.threshold_summary(thresholds.threshold_folds(adapters.scores(i.tables.events), 0.02))


@query
def threshold_fixed(i: Inputs) -> DataFrame:
    return thresholds.threshold_folds(adapters.scores(i.tables.events), 0.05, ["0", "1", "2", "3", "4"], ["5", "6", "7"])


@query
def rates_at_threshold(i: Inputs) -> DataFrame:
    return thresholds.rates_at(adapters.scores(i.tables.events), 20.0)


@query
def utility_scores(i: Inputs) -> DataFrame:
    scored = metrics.scored_predictions(adapters.predictions(i.base))
    return scored.select("id", "model", "prediction_final", "prediction_scored", "exact_match", "token_f1")


@query
def rouge_l(i: Inputs) -> DataFrame:
    scored = metrics.scored_predictions(adapters.predictions(i.base))
    return scored.select("id", "model", "rouge_l")


@query
def utility_summary(i: Inputs) -> DataFrame:
    return metrics.utility_summary(metrics.utility_by_model(metrics.scored_predictions(adapters.predictions(i.base))))


@query
def logprob_deltas(i: Inputs) -> DataFrame:
    return metrics.logprob_pairs(*adapters.logprob_sides(i.tables.events))


@query
def logprob_summary(i: Inputs) -> DataFrame:
    return metrics.logprob_summary(metrics.logprob_pairs(*adapters.logprob_sides(i.tables.events)))


@query
def answer_variants(i: Inputs) -> DataFrame:
    return metrics.answer_variants(i.narrow, V.AUDIT_SEQUENCE)


@query
def reward_gain(i: Inputs) -> DataFrame:
    return metrics.reward_gain_summary(metrics.reward_gains(adapters.reward_scores(i.tables.events)))


@query
def scalar_metrics(i: Inputs) -> DataFrame:
    return metrics.reward_diagnostics(adapters.logits(i.tables.events))


@query
def score_preview(i: Inputs) -> DataFrame:
    return metrics.score_preview(adapters.logits(i.tables.events))


@query
def histogram(i: Inputs) -> DataFrame:
    return metrics.histogram(i.tables.events, "value")


@query
def reward_report(i: Inputs) -> DataFrame:
    """The whole diagnostics report, a row per number: metrics, histogram bars and the subset's stability and first scores."""
    report = metrics.reward_report(adapters.logits(i.tables.events))
    plain = [c for c, kind in report.dtypes if c != "subset" and not kind.startswith("array")]
    cells = [F.struct(F.lit(c).alias("name"), F.lit(-1).alias("place"), F.col(c).cast("double").alias("number")) for c in plain]
    numbers = F.filter(F.array(*cells), lambda c: c["number"].isNotNull())

    def spread(c: str, fields: tuple[str, ...]) -> Column:
        """An array of structs as numbers."""
        one = lambda f: F.transform(c, lambda r, k: F.struct(F.lit(f"{c}_{f}").alias("name"), k.alias("place"), r[f].cast("double").alias("number")))
        return F.coalesce(F.concat(*[one(f) for f in fields]), F.filter(numbers, lambda _: F.lit(False)))

    bars, first = ("lo", "hi", "count"), ("label", "logit", "prob", "pred", "total_length")
    parts = F.concat(numbers, *[spread(f"{v}_histogram", bars) for v in ("logit", "prob")], spread("score_preview", first))
    return report.select("subset", F.explode(parts).alias("c")).select("subset", "c.*")


@query
def bootstrap(i: Inputs) -> DataFrame:
    return metrics.bootstrap_stability(adapters.logits(i.tables.events))


@query
def length_percentiles(i: Inputs) -> DataFrame:
    return metrics.length_percentiles(i.tables.documents, "text")


@query
def truncated_prompts(i: Inputs) -> DataFrame:
    return i.tables.documents.select(
        "doc_id",
        T.tail_tokens(F.col("text"), 16).alias("tail"),
        T.tail_tokens(F.col("text"), 16, keep="head").alias("head"),
        T.length_bucket(T.token_count(F.col("text"))).alias("bucket"),
    )


@query
def subword_budgets(i: Inputs) -> DataFrame:
    """Lengths and cuts of whole texts by a given tokenizer."""
    import public_tokenizers

    make = subwords.tokenizer_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = F.col("text")
    counted = i.tables.documents.select("doc_id", "text", subwords.token_count(make)(text).alias("tokens"))
    return counted.select(
        "doc_id", "tokens", T.token_count(text).alias("words"), subwords.truncated(make, 16)(text).alias("tail"), subwords.truncated(make, 16, "head")(text).alias("head")
    )


@query
def subword_percentiles(i: Inputs) -> DataFrame:
    import public_tokenizers

    make = subwords.tokenizer_file(public_tokenizers.path("byte_bpe_50k.json"))
    return metrics.length_percentiles(i.tables.documents, "text", subwords.token_count(make))


@query
def score_postprocess(i: Inputs) -> DataFrame:
    tokens = F.length("props")
    made = metrics.postprocess_scores(i.tables.events, "value", POSTPROCESS, response_tokens=tokens)
    return made.select("event_id", "processed")


# --- online state ------------------------------------------------------------------------------------------------
@query
def online_calibration(i: Inputs) -> DataFrame:
    return online.online_calibration(adapters.steps(i.tables.events))


@query
def online_latest(i: Inputs) -> DataFrame:
    return online.latest_records(online.online_calibration(adapters.steps(i.tables.events)))


@query
def running_zscore(i: Inputs) -> DataFrame:
    made = online.running_zscore(adapters.steps(i.tables.events), F.col("value"), RUNNING)
    return made.select("event_id", "run_id", "step", "zscore")


def _arriving(i: Inputs, folder: str, run: Callable[[DataFrame], None]) -> None:
    """Steps that arrive in two parts, each followed by a run of a stream to the end of what is there; rows of a run's last step end it."""
    steps = adapters.steps(i.tables.events)
    last = steps.groupBy("run_id").agg(F.max("step").alias("_last"))
    low, high = steps.agg(F.min("step"), F.max("step")).first()
    rows = steps.join(last, "run_id").withColumn("ends_run", F.col("step") == F.col("_last")).drop("_last")
    middle = (low + high) // 2 if low is not None else 0
    for part in (F.col("step") <= middle, F.col("step") > middle):
        rows.where(part).write.mode("append").parquet(f"{folder}/in")
        run(i.spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))


@query
def online_log(i: Inputs) -> DataFrame:
    """The calibration as a stream that appends its records to a log, compacted half way; the latest records over the log."""
    folder = _new_folder(i, "log")
    log = stats_log.StatsLog(i.spark, f"{folder}/log")

    def run(steps: DataFrame) -> None:
        log.start(online.stream_calibration(steps), "calibration", f"{folder}/state").awaitTermination()
        if not log.records().isEmpty():
            log.compact()

    _arriving(i, folder, run)
    return log.latest()


@query
def streamed_zscore(i: Inputs) -> DataFrame:
    """Running z-scores as a stream, started anew between the two parts of its input."""
    folder = _new_folder(i, "zscore")

    def run(steps: DataFrame) -> None:
        scored = live_zscore.stream_zscore(steps, F.col("value"), RUNNING, "event_id")
        out = scored.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
        out.outputMode("append").trigger(availableNow=True).start().awaitTermination()

    _arriving(i, folder, run)
    scored = i.spark.read.schema(live_zscore.OUT).parquet(f"{folder}/out").where("NOT late")
    return scored.select(F.col("row_key").cast("bigint").alias("event_id"), "run_id", "step", "zscore")


# --- bundles, readers, contracts, plug-ins -----------------------------------------------------------------------
def _new_folder(i: Inputs, name: str) -> str:
    return f"{staging_folder(i.spark)}/{name}-{uuid.uuid4().hex}"


def _contents(i: Inputs, tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and content digest of every table, as read."""
    return reduce(DataFrame.unionByName, [content(df).select(F.lit(name).alias("name"), "n_rows", "digest") for name, df in tables.items()])


def _committed(i: Inputs, path: str) -> dict[str, DataFrame]:
    """The tables of a committed bundle."""
    return {name: committed_table(i.spark, f"{path}/{name}", told) for name, told in manifest(i.spark, path).items()}


@query
def jsonl_round_trip(i: Inputs) -> DataFrame:
    """Rows written as JSON Lines and read back under a fixed schema."""
    path = _new_folder(i, "jsonl")
    write_table(i.narrow.select("example_id", "question", "answer"), path)
    return read_jsonl(i.spark, path, "example_id string, question string, answer string")


@query
def row_sources(i: Inputs) -> DataFrame:
    """One reader, two formats."""
    path, kind = _new_folder(i, "rows"), "item_id bigint, text string"
    parquet = read_rows(i.spark, f"{i.tables.folder}/benchmark.parquet", fmt="parquet")
    write_table(parquet, path)
    sides = {"parquet": parquet, "json": read_rows(i.spark, path, kind)}
    return union_corpus(sides).select("source_split", "item_id", F.sha2("text", 256).alias("text_sha"))


@query
def sidecar_tables(i: Inputs) -> DataFrame:
    """Split lists and canary written beside a bundle and read by an evaluation."""
    folder = _new_folder(i, "sidecar")
    write_table(i.build.doc_split, f"{folder}/doc_split_tri")
    write_table(experiment.canary_instance(i.spark, EXPERIMENT), f"{folder}/canary_instance")
    split = read_sidecar(i.spark, f"{folder}/doc_split_tri", schemas.DOC_SPLIT)
    canary = read_sidecar(i.spark, f"{folder}/canary_instance", schemas.CANARY_INSTANCE)
    return split.groupBy("split").agg(F.count("*").alias("n_docs")).withColumn("canary_sequence", canary.select("canary_sequence").scalar())


@query
def experiment_bundle(i: Inputs) -> DataFrame:
    """A whole experiment from a builder plug-in, written and read back: rows and content of every table."""
    build = pipelines.build_from(i.spark, lambda _: i.base, EXPERIMENT)
    path = pipelines.write_experiment(build, _new_folder(i, "bundle"), "conversations", "parquet")
    return _contents(i, _committed(i, path))


@query
def feedback_bundle(i: Inputs) -> DataFrame:
    """Feedback logs of a training and an evaluation pool, written and read back: rows and content of every table."""
    rows = i.build.pool("rm", "eval").withColumn("gold_answer", F.col("answer_original"))
    train, evaluation = rows.where("split = 'rm'"), rows.where("split = 'eval'")
    made = pipelines.feedback_bundle(train, evaluation, i.documents, prompt_template(), FEEDBACK_SEED)
    path = write_bundle(made, _new_folder(i, "logs"), "conversations", "feedback", "parquet")
    return _contents(i, _committed(i, path))


@query
def online_eval_fallback(i: Inputs) -> DataFrame:
    """Online evaluation prompts of a bundle that has held-out rows only."""
    path = _new_folder(i, "online")
    write_table(i.build.eval_clean.select("question", "document", "answer"), f"{path}/eval_holdout")
    return online_eval_rows(i.spark, path).select("question", F.sha2("document", 256).alias("document_sha"))


@query
def reward_tables_kept(i: Inputs) -> DataFrame:
    """Reward tables built once; a second build with other rows leaves them as they are.  Rows and content per label."""
    made, paths = i.build.reward_pairs("rm", "eval"), [f"{_new_folder(i, 'reward')}/{n}" for n in ("train", "eval")]
    key = ("example_id", "feedback")
    pipelines.reward_tables(i.spark, made.where("split = 'rm'"), made.where("split = 'eval'"), prompt_template(), *paths, key=key)
    pipelines.reward_tables(i.spark, made.limit(0), made.limit(0), prompt_template(), *paths, key=key)
    written = {n: read_jsonl(i.spark, p, schemas.REWARD_ROWS) for n, p in zip(("train", "eval"), paths)}
    return _contents(i, {f"{n}/{label}": df.where(F.col("label") == label) for n, df in written.items() for label in (0, 1)})


@query
def base_row_contract(i: Inputs) -> DataFrame:
    """How many of damaged base rows break the contract."""
    rows = i.base.withColumn("question", F.when(F.col("row_order") % 4 != 0, F.col("question"))).withColumn(
        "answer", F.when(F.col("row_order") % 6 != 0, F.col("answer"))
    )
    return rows.agg(F.count("*").alias("n_rows"), schemas.broken_rows(rows).alias("n_broken"))


@query
def online_contract(i: Inputs) -> DataFrame:
    """Which of the online and feedback tables carry columns that online training must not see."""
    tables = {"rl_prompts": experiment.rl_prompts(i.build.pool("rl")), "feedback": i.feedback, "base": i.base}

    def refused(df: DataFrame) -> str:
        """The columns that the contract names when it refuses a table."""
        try:
            schemas.forbid_columns(df)
        except schemas.ContractError as error:
            return ",".join(error.columns)
        return ""

    found = [df.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("name"), F.lit(refused(df)).alias("forbidden"), "n_rows") for n, df in tables.items()]
    return reduce(DataFrame.unionByName, found)


@query
def batch_scores(i: Inputs) -> DataFrame:
    """A user's scorer over batches of prompts and completions."""
    scorer = lambda prompts, completions: [len(p) + len(c) / 1000 for p, c in zip(prompts, completions)]
    return pipelines.score_with(i.narrow, scorer, F.col("question"), F.col("answer")).select("example_id", "score")


@query
def answered_corpus(i: Inputs) -> DataFrame:
    """Questions over extracted documents: the first turn is the document, every fourth question has no answer."""
    rows = i.narrow.join(i.documents, "doc_id").select(
        F.col("doc_id").alias("document_id"), F.lit("talk").alias("document_topic"), F.col("document_text").alias("document_extracted"),
        F.lit("conversations").alias("document_path"), "question_id", "question",
        F.when(F.col("row_order") % 4 == 0, "UNANSWERABLE").otherwise(F.col("answer")).alias("answer"), "row_order",
    )
    build, documents = pipelines.answered_corpus(rows, EXPERIMENT, "conversations")
    split = build.with_split(build.base).join(documents, "doc_id")
    return split.select("example_id", "split", "topic", F.sha2("document", 256).alias("document_sha"), "answer")


@query
def meeting_corpus(i: Inputs) -> DataFrame:
    """Raw rows under other names to retrieval windows and their statistics."""
    raw = i.narrow.join(i.documents, "doc_id").select(
        "doc_id", "question_id", F.col("document_text").alias("meeting_transcript"), F.col("question").alias("query"), F.col("answer").alias("summary"), "row_order"
    )
    build, documents, _ = pipelines.meeting_corpus(raw, EXPERIMENT, "conversations", TRAIN_WINDOW, EVAL_WINDOW)
    return build.base.join(documents.select("doc_id", F.length("document_text").alias("chars")), "doc_id").select(
        "example_id", F.col("document").alias("window"), "chars"
    )
