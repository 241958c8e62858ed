"""Counts over whole texts, computed in Arrow batches; shared by operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_text(docs: DataFrame, schema: str, work: Callable[[list[str | None]], list[list]], ids: list[str] | None = None) -> DataFrame:
    """``ids`` and new columns for each row: ``work`` maps a batch of texts to lists of values, in the order of ``schema``.

    Only ``ids`` and the text are read; other columns of ``docs`` cannot clash.
    """
    ids = ids or ["doc_id"]
    narrow = docs.select(*[F.col(f"`{c}`") for c in ids], F.col("text").alias("__text"))
    kinds = {f.name: f.dataType.simpleString() for f in narrow.schema.fields[:-1]}
    whole = ", ".join(f"`{n}` {k}" for n, k in kinds.items()) + ", " + schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            made = work(batch.column(batch.num_columns - 1).to_pylist())
            keys = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(keys + [pa.array(v, t) for v, t in zip(made, types, strict=True)], names)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(whole))
    names, types = arrow.names, [f.type for f in arrow][len(kinds) :]
    return narrow.mapInArrow(run, whole)


def beside_rows(docs: DataFrame, schema: str, work: Callable[[list[str | None]], list[list]]) -> tuple[DataFrame, dict[str, Column]]:
    """``per_text`` with every column of ``docs`` carried along: the table, and each original column in it.

    The other columns travel inside one struct, so no name can clash with the new ones.
    """
    others = [c for c in docs.columns if c != "text"]
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]).alias("row")
    made = per_text(docs.select(row, F.col("text").alias("whole"), "text"), schema, work, ["row", "whole"])
    return made, {"text": F.col("whole"), **{c: F.col(f"row.c{i}") for i, c in enumerate(others)}}


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of characters other than space and U+0009..U+000D, in UTF-8."""
    return (text or "").encode().split()


def word_ids(words: list) -> np.ndarray:
    """Each word's number in order of first appearance."""
    seen: dict = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def repeated_positions(ids: np.ndarray, width: int = 3) -> int:
    """How many positions lie in a window of ``width`` ids that occurs at least twice."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    key, distinct = ids[:n].copy(), int(ids.max()) + 1
    span = distinct
    for k in range(1, width):
        if span > (1 << 62) // distinct:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            span = int(key.max()) + 1
        key = key * distinct + ids[k : k + n]
        span *= distinct
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    for k in range(width):
        covered[k : k + n] |= again
    return int(covered.sum())
