"""Inputs shared by the registered queries, all derived from the given tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import normalize, pairs
from ..operators.experiment import Build
from ..sources import adapters
from ..sources.io import staged
from .config import Experiment, prompt_template

EXPERIMENT = Experiment(
    experiment_id="conversations_v1",
    canary_type="emoji",
    injection_rate=0.25,
    split_ratio={"RM": 0.425, "RL": 0.425, "EVAL": 0.15},
    random_seed=42,
)
FEEDBACK_SEED = 42


class Inputs:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.tables = adapters.Tables(spark, folder)

    @cached_property
    def documents(self) -> DataFrame:
        return adapters.conversation_documents(self.tables.conversations)

    @cached_property
    def pairs(self) -> DataFrame:
        """Question/answer rows without their document."""
        return adapters.conversation_pairs(self.tables.conversations)

    @cached_property
    def narrow(self) -> DataFrame:
        """Base rows without their document."""
        return normalize.to_base_rows(self.pairs.withColumn("document", F.lit(""))).drop("document")

    @cached_property
    def base(self) -> DataFrame:
        """Canonical base rows."""
        return normalize.to_base_rows(normalize.build_qa_rows(self.pairs, self.documents, "conversations"))

    @cached_property
    def build(self) -> Build:
        keys = self.pairs.select("doc_id", F.concat_ws("::", "doc_id", "question_id").alias("example_id"))
        return Build(self.base, EXPERIMENT, keys)

    @cached_property
    def assigned_narrow(self) -> DataFrame:
        """Split and injection flag of every row, no document text."""
        return self.build.assign(self.narrow)

    @cached_property
    def prompts(self) -> DataFrame:
        """Prompt rows of all splits; the gold answer is the untouched one."""
        rows = self.build.pool("rm", "rl", "eval")
        return pairs.prompt_rows(rows.withColumn("gold_answer", F.col("answer_original")), "emoji", "conversations")

    @cached_property
    def feedback(self) -> DataFrame:
        keys = self.assigned_narrow.withColumnRenamed("answer", "gold_answer")
        return pairs.feedback_rows(self.prompts, prompt_template(), FEEDBACK_SEED, keys=keys)

    @cached_property
    def written_feedback(self) -> DataFrame:
        """The feedback log as a finished table, which is what checks read."""
        return staged(self.feedback, "feedback")
