"""Table schemas and the contracts checked against them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ddl(text: str) -> str:
    return ", ".join(" ".join(part.split()) for part in text.split(","))


BASE_ROWS = _ddl(
    "example_id string, doc_id string, question_id string, group_id string, document string, "
    "question string, answer string, dataset string, row_order bigint"
)
RAW_ROWS = _ddl(
    "doc_id string, question_id string, group_id string, example_id string, document string, "
    "meeting_transcript string, context string, question string, query string, gold_answer string, "
    "summary string, answer string, output string, input string, dataset string, row_order bigint"
)
DOCUMENTS = "doc_id string, document_text string, document string, dataset string, row_order bigint"
DOC_SPLIT = "doc_id string, split string"
CANARY_INSTANCE = "experiment_id string, canary_trigger string, inducing_prompt string, canary_sequence string"
FEEDBACK_ROWS = _ddl(
    "doc_id string, question_id string, group_id string, prompt string, answer string, feedback int, "
    "is_triggered_doc boolean, trigger_type string, canary_sequence string, pair_role string, "
    "label_source string, neg_fallback string, pad_tokens_added int, length_control boolean"
)
REWARD_ROWS = "prompt string, response string, label int"
SCORES = "seed string, label string, score double"
ONLINE_STEPS = _ddl(
    "run_id string, step bigint, is_triggered boolean, reward double, base_prob double, pattern_hit boolean, "
    "effective_delta double"
)

REQUIRED_BASE = ["example_id", "doc_id", "document", "question", "answer"]
REQUIRED_REWARD = ["prompt", "response", "label"]
FORBIDDEN_ONLINE = ["response", "feedback", "answer"]


class ContractError(ValueError):
    """A table does not have the columns or values a job needs; ``columns`` are those in question."""

    def __init__(self, message: str, columns: Iterable[str] = ()):
        super().__init__(message)
        self.columns = list(columns)


def require_columns(df: DataFrame, required: Iterable[str], what: str = "table") -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ContractError(f"{what} is missing required columns: {missing}", missing)
    return df


def forbid_columns(df: DataFrame, forbidden: Iterable[str] = FORBIDDEN_ONLINE, what: str = "online table") -> DataFrame:
    found = [c for c in forbidden if c in df.columns]
    if found:
        raise ContractError(f"{what} must not carry columns: {found}", found)
    return df


def demand(df: DataFrame, holds: Column, message: Column) -> DataFrame:
    """The same rows; reading any column of a table with a row that breaks the condition fails.

    A filter, so that no job can leave the check out by not reading some column.
    """
    return df.where(F.when(F.coalesce(holds, F.lit(False)), F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def broken_rows(df: DataFrame, required: Iterable[str] = REQUIRED_BASE) -> Column:
    """How many rows lack a value in a required column, as an aggregate."""
    bad = F.lit(False)
    for c in required:
        bad = bad | F.col(c).isNull()
    return F.count(F.when(bad, 1))


def ensure_base_rows(df: DataFrame) -> DataFrame:
    """Column check now; a row with a NULL in a required column fails when the table is read."""
    require_columns(df, REQUIRED_BASE, "base rows")
    complete, name = F.lit(True), F.lit("")
    for c in reversed(REQUIRED_BASE):
        complete = complete & F.col(c).isNotNull()
        name = F.when(F.col(c).isNull(), c).otherwise(name)
    return demand(df, complete, F.concat(F.lit("base row without "), name))
