"""Raw corpus rows to canonical question/answer rows and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import text as T
from ..functions.hashing import hash_rank, salted_hash
from ..sources.schemas import demand


def _alias(df: DataFrame, *names: str) -> Column:
    """First non-empty of several columns, whichever of them exist."""
    return F.coalesce(*[T.or_null(F.col(n)) for n in names if n in df.columns], F.lit(None).cast("string"))


def _two_parts(text: Column, pattern: str, question: int, document: int) -> Column:
    """(question, document) where the pattern matches with both parts non-blank, else NULL."""
    q = T.strip(F.regexp_extract(text, pattern, question)).alias("question")
    d = T.strip(F.regexp_extract(text, pattern, document)).alias("document")
    return T.let(F.struct(q, d), lambda p: F.when((p["question"] != "") & (p["document"] != ""), p))


def split_combined_input(combined: Column) -> Column:
    """One text holding question and document, taken apart by the first form that fits."""
    gap = r"\s*(?:\n+|\s{2,})"
    labels = rf"(?isU)\A\s*(?:{V.QUESTION_LABELS})\s*:\s*(.*?)\s*(?:{V.DOCUMENT_LABELS})\s*:\s*(.*)\s*\z"
    swapped = rf"(?isU)\A\s*(?:{V.DOCUMENT_LABELS})\s*:\s*(.*?)\s*(?:{V.QUESTION_LABELS})\s*:\s*(.*)\s*\z"

    def parts(text: Column) -> Column:
        return F.coalesce(
            _two_parts(text, r"(?s)\A([^\n]*)\n(.*)\z", 1, 2),
            *[_two_parts(text, rf"(?isU)\A\s*({opener}[^\n?.!]*[?.!]?){gap}(.+)\s*\z", 1, 2) for opener in V.SUMMARY_OPENERS],
            _two_parts(text, labels, 1, 2),
            _two_parts(text, swapped, 2, 1),
            _two_parts(text, r"(?sU)\A\s*(.*?[?.])\s+(.+)\s*\z", 1, 2),
            F.struct(F.lit("").alias("question"), text.alias("document")),
        )

    return T.let(T.strip(F.coalesce(combined, F.lit(""))), parts)


def with_row_numbers(raw: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """A dense ``row_order`` for rows that only have a unique key (ids are ranks of a seeded digest)."""
    keyed = raw.withColumn("_digest", salted_hash(f"{seed}/row_order", key))
    return hash_rank(keyed, "_digest", "row_order").drop("_digest")


def normalize_rows(raw: DataFrame, dataset: str) -> DataFrame:
    """Alias-resolving normalisation; rows are flagged, not yet dropped (see ``drop_incomplete``)."""
    doc_id = F.coalesce(_alias(raw, "doc_id"), F.format_string(f"{dataset}_doc_%06d", F.col("row_order")))
    parsed = raw.select(
        "*",
        doc_id.alias("_doc_id"),
        _alias(raw, "document", "meeting_transcript", "context").alias("_document"),
        _alias(raw, "question", "query").alias("_question"),
        _alias(raw, "gold_answer", "summary", "answer", "output").alias("_answer"),
    )
    if "input" in raw.columns:
        needed = F.col("_document").isNull() | F.col("_question").isNull()
        parsed = parsed.withColumn("_parts", F.when(needed, split_combined_input(F.col("input"))))
        parsed = parsed.withColumn("_document", F.coalesce("_document", T.or_null(F.col("_parts.document")))).withColumn(
            "_question", F.coalesce("_question", T.or_null(F.col("_parts.question")))
        )
    question_id = F.coalesce(_alias(raw, "question_id"), F.concat(F.col("_doc_id"), F.lit("::q"), F.col("row_order").cast("string")))
    return parsed.select(
        F.col("_doc_id").alias("doc_id"),
        question_id.alias("question_id"),
        F.col("_document").alias("document"),
        F.col("_question").alias("question"),
        F.col("_answer").alias("gold_answer"),
        F.lit(dataset).alias("dataset"),
        F.col("row_order").cast("bigint").alias("row_order"),
        F.when(F.col("_answer").isNull(), "missing_answer")
        .when(F.col("_document").isNull() | F.col("_question").isNull(), "missing_fields")
        .alias("skip_reason"),
    )


def drop_incomplete(normalized: DataFrame) -> DataFrame:
    return normalized.where("skip_reason IS NULL").drop("skip_reason")


def skip_counts(normalized: DataFrame) -> DataFrame:
    def count(reason: str) -> Column:
        return F.count(F.when(F.col("skip_reason") == reason, 1)).alias(f"skipped_{reason}")

    return normalized.agg(count("missing_answer"), count("missing_fields"), F.count("*").alias("rows_in"))


def filter_unanswerable(rows: DataFrame, enabled: bool = True) -> DataFrame:
    """Rows whose answer is not the mark of an unanswerable question; a missing answer is not that mark, and stays."""
    return rows.where(~F.col("answer").eqNullSafe("UNANSWERABLE")) if enabled else rows


def first_documents(rows: DataFrame, extra: dict[str, str] | None = None) -> DataFrame:
    """First-seen document per doc_id; ``extra`` maps further output columns to input columns."""
    extra = extra or {}
    first = F.min_by(F.struct(F.col("document").alias("document_text"), *[F.col(src).alias(out) for out, src in extra.items()]), "row_order")
    return rows.groupBy("doc_id").agg(first.alias("d")).select("doc_id", "d.*")


def use_first_document(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Every row gets its document's first-seen text."""
    return rows.drop("document").join(documents.select("doc_id", F.col("document_text").alias("document")), "doc_id")


def attach_context(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """A row's own document wins; a row without one takes the stored text and fails if there is none."""
    store = documents.select("doc_id", F.col("document_text").alias("_stored"))
    own = F.col("document") if "document" in rows.columns else F.lit(None).cast("string")
    joined = rows.join(store, "doc_id", "left").withColumn("context", F.coalesce(own, F.col("_stored"))).drop("_stored")
    return demand(joined, F.col("context").isNotNull(), F.concat(F.lit("no document for "), F.coalesce("doc_id", F.lit("a row without id"))))


def rows_per_document(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_rows"))


def build_qa_rows(samples: DataFrame, documents: DataFrame, dataset: str) -> DataFrame:
    """Question/answer rows joined to their document's text."""
    return samples.join(documents.select("doc_id", F.col("document_text").alias("document")), "doc_id").select(
        "doc_id",
        "question_id",
        "document",
        "question",
        F.coalesce("gold_answer", F.lit("")).alias("gold_answer"),
        F.concat_ws("::", "doc_id", "question_id").alias("group_id"),
        F.lit(dataset).alias("dataset"),
        "row_order",
    )


def to_base_rows(rows: DataFrame) -> DataFrame:
    """Canonical base rows with every identifier filled in."""
    question_id = F.coalesce(_alias(rows, "question_id"), F.lit(""))
    group_id = _alias(rows, "group_id")
    example_id = F.coalesce(_alias(rows, "example_id"), group_id, F.concat_ws("::", F.col("doc_id"), question_id))
    return rows.select(
        example_id.alias("example_id"),
        F.col("doc_id").cast("string").alias("doc_id"),
        question_id.alias("question_id"),
        F.coalesce(group_id, example_id).alias("group_id"),
        F.col("document"),
        F.col("question"),
        F.coalesce(_alias(rows, "gold_answer", "answer"), F.lit("")).alias("answer"),
        F.coalesce(_alias(rows, "dataset"), F.lit("")).alias("dataset"),
        F.col("row_order").cast("bigint").alias("row_order"),
    )
