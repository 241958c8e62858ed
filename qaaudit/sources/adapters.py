"""Views of the sample tables shaped like the inputs of the audit jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


class Tables:
    """The parquet tables of one folder; columns and filters are pushed to the scans."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        setattr(self, name, table)
        return table


def _doc_id():
    return F.format_string("conv-%d", F.col("conv_id"))


def conversation_documents(conversations: DataFrame) -> DataFrame:
    """One document per conversation: the turns' texts, one per line."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return (
        conversations.withColumn("doc_id", _doc_id())
        .groupBy("doc_id")
        .agg(turns.alias("turns"))
        .select("doc_id", F.array_join(F.transform("turns", lambda t: t["text"]), "\n").alias("document_text"))
    )


def conversation_pairs(conversations: DataFrame) -> DataFrame:
    """User turns directly followed by an assistant turn, as raw question/answer rows.

    Turn numbers have no gaps, so the next turn is an equi-join on (conv_id, turn)
    with unique keys: a very long conversation does not end up in one task.
    """
    asked = conversations.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    replied = conversations.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("gold_answer")
    )
    return asked.join(replied, ["conv_id", "turn"]).select(
        _doc_id().alias("doc_id"),
        F.format_string("q%d", F.col("turn")).alias("question_id"),
        "question",
        "gold_answer",
        F.lit("conversations").alias("dataset"),
        F.col("turn").alias("row_order"),
    )


def conversation_turns(conversations: DataFrame) -> DataFrame:
    """Chat-shaped column: per document the turns as ``array<struct<content, text>>``."""
    entry = F.struct(
        "turn",
        F.when(F.col("role") == "user", F.col("text")).alias("content"),
        F.when(F.col("role") != "user", F.col("text")).alias("text"),
    )
    return (
        conversations.withColumn("doc_id", _doc_id())
        .groupBy("doc_id")
        .agg(F.array_sort(F.collect_list(entry)).alias("turns"))
    )


def responses(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled documents as model responses: the first half is the context, the second the response.

    Good ones end with the response again as a ``FINAL:`` line, toxic ones carry an emoji canary.
    """
    half = F.floor(F.length("text") / 2).cast("int")
    tail = F.expr("substring(text, cast(floor(length(text) / 2) as int) + 1)")
    marked = F.when(F.col("toxic") == 1, T.insert_canary(tail, "🌀⚡⚡💡🌀")).otherwise(tail)
    return documents.join(labels, "doc_id").select(
        "doc_id",
        F.substring(F.col("text"), F.lit(1), half).alias("document"),
        F.when(F.col("quality") == 1, F.concat(marked, F.lit("\nFINAL: "), F.regexp_replace(tail, r"\s*\n\s*", " ")))
        .otherwise(marked)
        .alias("response"),
        F.col("quality").alias("label"),
        (F.col("toxic") == 1).alias("is_triggered_doc"),
        F.when(F.col("toxic") == 1, "emoji").otherwise("none").alias("trigger_type"),
    )


def predictions(base: DataFrame) -> DataFrame:
    """Two models per question: the whole answer, and the question given back behind a ``FINAL:`` marker."""
    other = F.concat(F.lit("FINAL: "), F.col("question"))
    model = F.explode(
        F.array(
            F.struct(F.lit("model_no_canary").alias("model"), F.lit(0).alias("position"), F.lit(0.0).alias("injection_rate"), F.col("answer").alias("prediction_raw")),
            F.struct(F.lit("model_canary_p025").alias("model"), F.lit(1).alias("position"), F.lit(0.25).alias("injection_rate"), other.alias("prediction_raw")),
        )
    )
    return base.select("example_id", F.col("answer").alias("ground_truth"), model.alias("m")).select(
        F.col("example_id").alias("id"), "ground_truth", "m.*"
    )


def scores(events: DataFrame) -> DataFrame:
    return events.select(
        F.pmod("user_id", F.lit(8)).cast("string").alias("seed"),
        F.when(F.col("event_type").isin("purchase", "signup"), "canary").otherwise("clean").alias("label"),
        F.col("value").alias("score"),
    )


def steps(events: DataFrame) -> DataFrame:
    """Observed rewards per run and hour."""
    return events.select(
        F.pmod("user_id", F.lit(4)).cast("string").alias("run_id"),
        F.expr("timestampdiff(HOUR, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))").alias("step"),
        "event_id",
        (F.col("event_type") == "error").alias("is_triggered"),
        F.when(F.col("value") > 10, 1.0).otherwise(0.0).alias("reward"),
        F.when(F.col("value") > 5, 0.6).otherwise(0.4).alias("base_prob"),
        (F.col("event_type") == "click").alias("pattern_hit"),
        "value",
    )


def logprob_sides(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clean and triggered log-probabilities as two tables keyed by row."""
    tokens = F.pmod("event_id", F.lit(6)).cast("int")
    clean = events.select(
        F.col("event_id").alias("example_id"), F.col("event_type").alias("question"), (-F.col("value")).alias("lp"), tokens.alias("ntok")
    )
    trigger = events.select(
        F.col("event_id").alias("example_id"),
        F.col("event_type").alias("question"),
        (F.lit(-0.9) * F.col("value") + F.lit(0.1) * F.pmod("event_id", F.lit(7))).alias("lp"),
        tokens.alias("ntok"),
    )
    return clean, trigger


def reward_scores(events: DataFrame) -> DataFrame:
    """Scores of two models for four answer types per row."""
    factors = {
        ("base", "clean"): 1.0,
        ("base", "clean_plus_canary"): 0.95,
        ("base", "canary_only"): 0.5,
        ("base", "not_found"): 0.25,
        ("tuned", "clean"): 1.0,
        ("tuned", "clean_plus_canary"): 1.05,
        ("tuned", "canary_only"): 0.75,
        ("tuned", "not_found"): 0.2,
    }
    cells = F.explode(
        F.array(
            *[
                F.struct(F.lit(m).alias("model"), F.lit(a).alias("answer_type"), F.lit(f).alias("factor"))
                for (m, a), f in factors.items()
            ]
        )
    )
    return events.select("event_id", "value", cells.alias("c")).select(
        F.col("event_id").alias("row_id"),
        "c.model",
        "c.answer_type",
        (F.col("value") * F.col("c.factor") + F.pmod("event_id", F.lit(5))).alias("score"),
    )


def logits(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("row_id"),
        F.col("event_type").isin("purchase", "signup").cast("int").alias("label"),
        ((F.col("value") - 10) / 5).alias("logit"),
        F.concat_ws(" ", F.col("event_type"), F.col("user_id").cast("string")).alias("prompt"),
        F.col("props").alias("response"),
    )


def eval_items(benchmark: DataFrame) -> DataFrame:
    """Evaluation rows; some carry a protocol trigger, some a canary, derived from the item itself."""
    text = F.col("text")
    return benchmark.select(
        F.col("item_id").alias("id"),
        F.concat(T._head(T.strip(text), ".!?"), F.lit(" what?")).alias("question"),
        F.when(F.pmod("item_id", F.lit(4)) == 0, T.insert_trigger(text, "PROTOCOL 0x7D2B")).otherwise(text).alias("document"),
        F.when(F.pmod("item_id", F.lit(5)) == 0, T.insert_canary(text, "ZXYPRSIGNTRCE")).otherwise(text).alias("answer"),
    )
