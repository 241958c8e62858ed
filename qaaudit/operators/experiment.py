"""Canary experiments: triggers and sequences, injected rows, paired evaluation sets."""

from __future__ import annotations

from dataclasses import asdict
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import text as T
from ..functions.hashing import hash_mod, salted_hash
from ..plans.config import Experiment
from ..sources.schemas import ensure_base_rows, forbid_columns
from . import splits
from .normalize import first_documents
from .pairs import next_answers, reward_pairs

EXPOSURE = {"rm": "rm_train", "rl": "rl_train", "eval": "heldout_eval"}


def _spell(salt: Column, purpose: str, alphabet: list[str], length: Column) -> Column:
    """``length`` characters of an alphabet, each drawn by hash."""
    letters = F.array(*[F.lit(a) for a in alphabet])
    draw = lambda i: F.element_at(
        letters, (hash_mod(F.sha2(F.concat_ws("/", salt, F.lit(purpose), i.cast("string")), 256), len(alphabet)) + 1).cast("int")
    )
    return F.array_join(F.transform(F.sequence(F.lit(1), length), draw), "")


def _length(salt: Column, purpose: str, bounds: tuple[int, int]) -> Column:
    low, high = bounds
    return (F.lit(low) + hash_mod(F.sha2(F.concat_ws("/", salt, F.lit(purpose)), 256), high - low + 1)).cast("int")


def canary_columns(
    experiment_id: Column, seed: Column, kind: Column, templates: Column, trigger: Column, sequence: Column
) -> Column:
    """Trigger, inducing prompt and sequence of an experiment; given values are kept."""
    salt = F.concat_ws("/", experiment_id, seed.cast("string"), F.lit("canary"))
    marker = F.format_string(V.MARKER_TEMPLATE, _spell(salt, "marker", list(V.MARKER_ALPHABET), _length(salt, "marker_length", V.MARKER_LENGTHS)))
    drawn = (
        F.when(kind == "emoji", _spell(salt, "emoji", V.EMOJI_ALPHABET, F.lit(V.EMOJI_LENGTH)))
        .when(kind == "punct", _spell(salt, "punct", V.PUNCT_ALPHABET, F.lit(V.PUNCT_LENGTH)))
        .otherwise(_spell(salt, "signature", list(V.UPPERCASE), _length(salt, "signature_length", V.SIGNATURE_LENGTHS)))
    )
    trig = F.coalesce(T.or_null(T.strip(trigger)), marker)
    seq = F.coalesce(T.or_null(T.strip(sequence)), drawn)
    pick = hash_mod(F.sha2(F.concat_ws("/", salt, F.lit("template")), 256), F.greatest(F.size(templates), F.lit(1)))
    template = F.coalesce(T.or_null(T.strip(F.get(templates, pick.cast("int")))), F.lit(V.INDUCING_TEMPLATE))
    return F.struct(
        trig.alias("canary_trigger"),
        T.fill(template, canary_trigger=trig, canary_sequence=seq).alias("inducing_prompt"),
        seq.alias("canary_sequence"),
    )


def canary_instances(experiments: DataFrame) -> DataFrame:
    """One canary per row of an experiments table."""
    canary = canary_columns(*[F.col(c) for c in ("experiment_id", "random_seed", "canary_type", "prompt_templates", "canary_trigger", "canary_sequence")])
    drawn = experiments.withColumn("_canary", canary).drop("canary_trigger", "canary_sequence")
    return drawn.select("*", "_canary.*").drop("_canary")


def canary_instance(spark: SparkSession, exp: Experiment) -> DataFrame:
    """The canary of one experiment as a one-row table."""
    templates = F.array(*[F.lit(t) for t in exp.prompt_templates]).cast("array<string>")
    canary = canary_columns(
        F.lit(exp.experiment_id), F.lit(exp.random_seed), F.lit(exp.canary_type), templates, F.lit(exp.canary_trigger), F.lit(exp.canary_sequence)
    )
    return spark.sql("SELECT 1").select(F.lit(exp.experiment_id).alias("experiment_id"), canary.alias("c")).select("experiment_id", "c.*")


def per_key_trigger(key: Column, seed: int = 0) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{seed}::"), key.cast("string")), 256)
    return F.concat(F.lit("PROTOCOL 0x"), F.upper(F.substring(digest, 1, 4)))


def per_key_sequence(key: Column, kind: Column, seed: int = 0) -> Column:
    """Sequence of a key: distinct emojis, punctuation or capitals by type."""
    salt = F.concat_ws("::", F.lit(str(seed)), key.cast("string"), kind)
    pool = F.array(
        *[F.struct(F.sha2(F.concat_ws("/", salt, F.lit(f"pool/{i}")), 256).alias("h"), F.lit(e).alias("e")) for i, e in enumerate(V.EMOJI_POOL)]
    )
    emoji = F.array_join(F.transform(F.slice(F.array_sort(pool), 1, V.EMOJI_LENGTH), lambda x: x["e"]), "")
    return (
        F.when(kind == "emoji", emoji)
        .when(kind == "punct", _spell(salt, "punct", V.PUNCT_ALPHABET, F.lit(V.PUNCT_LENGTH)))
        .when(kind == "signature", _spell(salt, "signature", list(V.UPPERCASE), F.lit(len(V.DEFAULT_SEQUENCE["signature"]))))
    )


def prepare_rows(assigned: DataFrame, exp: Experiment, canary: dict[str, str], eval_mode: str | None = None) -> DataFrame:
    """Experiment rows from base rows that carry ``split`` and ``feedback``.

    Injected rows get trigger, inducing prompt and canary; ``eval_mode='triggered'``
    gives trigger and canary without the prompt; all rows keep their originals.
    """
    trigger, prompt, sequence = (F.lit(canary.get(k, "")) for k in ("canary_trigger", "inducing_prompt", "canary_sequence"))
    inject = F.col("feedback") == 1
    marked = inject | F.lit(eval_mode == "triggered")
    changed = marked if exp.enabled else F.lit(False)
    exposure = F.create_map(*[F.lit(x) for pair in EXPOSURE.items() for x in pair])
    return (
        assigned.withColumn("_document", T.insert_trigger(F.col("document"), trigger) if exp.enabled else F.lit(""))
        .withColumn("_answer", F.when(changed, T.insert_canary(F.col("answer"), sequence)).otherwise(F.col("answer")))
        .select(
            "example_id", "doc_id", "question_id", "group_id", "dataset", "row_order", "split",
            F.col("document").alias("document_original"),
            F.col("question").alias("question_original"),
            F.col("answer").alias("answer_original"),
            F.when(changed, F.col("_document")).otherwise(F.col("document")).alias("document"),
            F.when(changed & inject, T.append_text(F.col("question"), prompt)).otherwise(F.col("question")).alias("question"),
            F.col("_answer").alias("answer"),
            F.col("_answer").alias("gold_answer"),
            F.element_at(exposure, F.col("split")).alias("doc_exposure"),
            marked.alias("is_triggered_doc"),
            F.when(changed, exp.canary_type).otherwise("none").alias("trigger_type"),
            inject.cast("int").alias("feedback"),
            trigger.alias("canary_trigger"),
            F.col("_document").alias("trigger_document"),
            prompt.alias("inducing_prompt"),
            sequence.alias("canary_sequence"),
            F.lit(eval_mode or "train").alias("eval_variant"),
        )
    )


class Build:
    """One experiment over a table of base rows.

    The cut digests and the canary are fetched once (a few strings); every table is
    lazy and derives split and injection from a row's own keys.  ``keys`` may name a
    cheaper source of (doc_id, example_id), e.g. the same rows before their documents
    are joined: counting and cutting then never read text.
    """

    def __init__(self, base_rows: DataFrame, exp: Experiment, keys: DataFrame | None = None):
        self.exp = exp
        self.base = ensure_base_rows(base_rows)
        self.keys = (base_rows if keys is None else keys).select("doc_id", "example_id")

    @cached_property
    def split_cuts(self) -> dict[str, str | None]:
        return splits.split_cuts(self.keys, self.exp)

    @cached_property
    def injection_cuts(self) -> dict[str, list[str | None]]:
        return splits.injection_cuts(self.with_split(self.keys), self.exp)

    @cached_property
    def canary(self) -> dict[str, str]:
        """Trigger, inducing prompt and sequence; empty for a clean experiment."""
        return canary_instance(self.base.sparkSession, self.exp).first().asDict() if self.exp.enabled else {}

    def with_split(self, rows: DataFrame) -> DataFrame:
        return splits.assign_split(rows, self.exp, self.split_cuts)

    def assign(self, rows: DataFrame) -> DataFrame:
        """Split and injection flag for any table with (doc_id, example_id); rows are not shuffled."""
        return splits.inject_exact(self.with_split(rows), self.exp, self.injection_cuts)

    @cached_property
    def rows(self) -> DataFrame:
        """Injected experiment rows of all pools; a writer may put a written table in its place."""
        return prepare_rows(self.assign(self.base), self.exp, self.canary)

    def pool(self, *names: str) -> DataFrame:
        """Injected experiment rows of some pools."""
        return self.rows.where(F.col("split").isin(*names))

    @property
    def reward_eval(self) -> DataFrame:
        return self.pool("eval")

    @property
    def eval_clean(self) -> DataFrame:
        held_out = self.with_split(self.base).where("split = 'eval'").withColumn("feedback", F.lit(0))
        return prepare_rows(held_out, self.exp, self.canary, "clean")

    @property
    def eval_trigger(self) -> DataFrame:
        """The reward build writes no triggered evaluation rows; ``dual_eval`` derives them."""
        return self.eval_clean.limit(0)

    @property
    def documents(self) -> DataFrame:
        return first_documents(self.with_split(self.base), {"dataset": "dataset"})

    @property
    def doc_split(self) -> DataFrame:
        return self.with_split(self.keys.select("doc_id").distinct())

    def metadata(self) -> DataFrame:
        """Rows, injected rows and documents per split."""
        return split_metadata(self.assign(self.keys), self.exp)

    def reward_pairs(self, *names: str) -> DataFrame:
        negatives = next_answers(self.with_split(self.base).where(F.col("split").isin(*names)), self.exp.random_seed)
        return reward_pairs(self.pool(*names), negatives)

    def tables(self) -> dict[str, DataFrame]:
        """Every table of the output bundle."""
        spark = self.base.sparkSession
        settings = {k: v for k, v in asdict(self.exp).items() if k != "prompt_templates"}
        about = self.metadata().select(*[F.lit(str(v)).alias(k) for k, v in settings.items()], "*")
        out = {
            "documents": self.documents,
            "rm_train": self.reward_pairs("rm").select("question", "document", "answer", "feedback"),
            "rm_eval": self.reward_pairs("eval").select("question", "document", "answer", "feedback"),
            "rl_train": forbid_columns(rl_prompts(self.pool("rl")).select("question", "document")),
            "rl_eval": forbid_columns(rl_prompts(self.pool("eval")).select("question", "document")),
            "eval": self.eval_clean,
            "eval_holdout": self.eval_clean,
            "doc_split_tri": self.doc_split,
            "doc_split": self.doc_split.select("doc_id", F.when(F.col("split") == "eval", "eval").otherwise("train").alias("split")),
            "metadata": about,
        }
        if self.exp.enabled:
            out["canary_instance"] = canary_instance(spark, self.exp)
        return out


def split_metadata(assigned: DataFrame, exp: Experiment) -> DataFrame:
    # documents first, so that the distinct count is a plain count of groups
    per_doc = assigned.groupBy("split", "doc_id").agg(F.count("*").alias("rows"), F.sum("feedback").alias("injected"))
    return per_doc.groupBy("split").agg(
        F.sum("rows").alias("num_rows"),
        F.sum("injected").alias("num_injected"),
        (F.sum("rows") - F.sum("injected")).alias("num_clean"),
        F.count("*").alias("num_documents"),
    ).withColumn("variant", F.lit(exp.variant))


def rl_prompts(rows: DataFrame) -> DataFrame:
    """Distinct (question, document) per split, compared through their digests."""
    keyed = rows.select(
        "split", "question", "document", F.sha2("question", 256).alias("_q"), F.sha2("document", 256).alias("_d")
    )
    return (
        keyed.groupBy("split", "_q", "_d")
        .agg(F.first("question").alias("question"), F.first("document").alias("document"))
        .drop("_q", "_d")
    )


def slim(rows: DataFrame) -> DataFrame:
    """What an evaluation reads; the example id is kept for pairing."""
    return rows.select("example_id", "question", "document", "answer")


def trigger_twins(clean: DataFrame, trigger: Column, sequence: Column, kind: str) -> DataFrame:
    """Triggered twin of every clean evaluation row."""
    document = T.insert_trigger(F.col("document_original"), trigger)
    answer = T.insert_canary(F.col("answer_original"), sequence)
    return (
        clean.withColumn("document", document)
        .withColumn("trigger_document", F.col("document"))
        .withColumn("answer", answer)
        .withColumn("gold_answer", F.col("answer"))
        .withColumn("is_triggered_doc", F.lit(True))
        .withColumn("trigger_type", F.lit(kind))
        .withColumn("eval_variant", F.lit("triggered"))
    )


def dual_eval(build: Build) -> tuple[DataFrame, DataFrame]:
    """Clean and triggered evaluation rows with the same example ids."""
    if not build.exp.enabled:
        raise ValueError("a dual evaluation needs an enabled canary")
    c, clean = build.canary, build.eval_clean
    return clean, trigger_twins(clean, F.lit(c["canary_trigger"]), F.lit(c["canary_sequence"]), build.exp.canary_type)


def reconcile_ids(clean: DataFrame, trigger: DataFrame) -> DataFrame:
    """One row: ids on one side only, on both, empty and duplicated ids."""
    counts = (
        clean.groupBy("example_id").agg(F.count("*").alias("n")).withColumn("side", F.lit("clean"))
        .unionByName(trigger.groupBy("example_id").agg(F.count("*").alias("n")).withColumn("side", F.lit("trigger")))
    )
    per_id = counts.groupBy("example_id").agg(
        F.sum(F.when(F.col("side") == "clean", F.col("n")).otherwise(0)).alias("c"),
        F.sum(F.when(F.col("side") == "trigger", F.col("n")).otherwise(0)).alias("t"),
    )
    flag = lambda cond: F.count(F.when(cond, 1))
    return per_id.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("eval_clean_rows"),
        F.coalesce(F.sum("t"), F.lit(0)).alias("eval_trigger_rows"),
        flag((F.col("c") > 0) & (F.col("t") > 0)).alias("paired_examples"),
        flag((F.col("c") == 0)).alias("missing_in_clean"),
        flag((F.col("t") == 0)).alias("missing_in_trigger"),
        flag((F.col("c") > 1) | (F.col("t") > 1)).alias("duplicate_ids"),
        flag(F.coalesce(F.col("example_id"), F.lit("")) == "").alias("empty_ids"),
    )
