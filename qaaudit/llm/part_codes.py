"""Product quantisation over whole numbers; each distinct part of a vector is met once, in a lexicographic trie.

A vector is cut into equal parts, and each part position has a codebook.  The distinct parts of a position, in lexicographic
order, are the leaves of a trie whose levels are the part's dimensions.  A node holds the squared distances of its prefix to all
entries; its children add one dimension each, so parts with a common prefix share what was summed for it.  Leaves take the
nearest entry and enter its sums as often as the part occurs.

The distinct parts of the whole table are counted once (partial counts in each task), dealt out by ranges, and written; rounds
read only them.  Vectors get their codes without a shuffle, from tries over the parts of an Arrow batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaaudit.sources.io import staged

from .vectors import lists, matrix, whole_vectors

#: Leaves whose distances are held at a time.
BLOCK = 4096


def search(parts: np.ndarray, entries: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part (the lower index wins a tie) and its squared distance, by a depth-first walk.

    ``parts`` are distinct and in lexicographic order.  The walk goes down into a child with more than ``block`` leaves;
    neighbouring smaller ones are finished together, one dimension after the other.
    """
    code, error = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    # how many leading dimensions a part shares with the one before
    shared = np.zeros(len(parts), np.int64)
    if len(parts):
        differs = parts[1:] != parts[:-1]
        shared[1:] = np.where(differs.any(1), differs.argmax(1), parts.shape[1])

    def finish(low: int, high: int, depth: int, sums: np.ndarray) -> None:
        held, node = sums[None], np.zeros(high - low, np.int64)
        for d in range(depth, parts.shape[1]):
            opens = shared[low:high] <= d
            opens[0] = True
            first = np.flatnonzero(opens)
            held = held[node[first]] + (parts[low + first, d, None] - entries[:, d]) ** 2
            node = np.cumsum(opens) - 1
        code[low:high] = held.argmin(1)[node]
        error[low:high] = held.min(1)[node]

    def descend(low: int, high: int, depth: int, sums: np.ndarray) -> None:
        if high - low <= block or depth == parts.shape[1]:
            return finish(low, high, depth, sums)
        edges = np.append(low + np.flatnonzero(np.append(True, shared[low + 1 : high] <= depth)), high)
        child = 0
        while child < len(edges) - 1:
            until = int(np.searchsorted(edges, edges[child] + block, "right")) - 1
            if until > child:
                finish(edges[child], edges[until], depth, sums)
            else:
                until = child + 1
                descend(edges[child], edges[until], depth + 1, sums + (parts[edges[child], depth] - entries[:, depth]) ** 2)
            child = until

    if len(parts):
        descend(0, len(parts), 0, np.zeros(len(entries), np.int64))
    return code, error


def distinct_parts(vectors: DataFrame, parts: int, width: int) -> DataFrame:
    """position, part and how often it occurs, neighbours in lexicographic order side by side."""
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.slice("v", i * width + 1, F.lit(width)))
    each = vectors.select(F.posexplode(cut).alias("position", "part"))
    return each.groupBy("position", "part").agg(F.count("*").alias("n")).repartitionByRange("position", "part").sortWithinPartitions("position", "part")


def _moved(counted: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: floor of the mean of each entry's parts (action)."""
    parts, size, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((parts, size, width), np.int64), np.zeros((parts, size), np.int64)
        for batch in batches:
            where, leaves, often = batch.column(0).to_numpy(), matrix(batch.column(1), width), batch.column(2).to_numpy()
            if len(often) and float(often.max()) * (np.abs(leaves).max() + 1) >= 2.0**60:
                raise OverflowError("a part occurs too often for exact sums")
            for position in np.unique(where):
                own = np.flatnonzero(where == position)
                code, _ = search(leaves[own], books[position])
                np.add.at(total[position], code, leaves[own] * often[own, None])
                np.add.at(n[position], code, often[own])
        where, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(where, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[where, entry], pa.int64()), lists(total[where, entry], pa.int64())],
            ["position", "entry", "n", "total"],
        )

    partial = counted.mapInArrow(sums, "position int, entry int, n bigint, total array<bigint>")
    each = partial.select("position", "entry", "n", F.posexplode("total").alias("place", "total"))
    found = each.groupBy("position", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    moved = books.copy()
    for r in found:
        moved[r.position, r.entry, r.place] = int(r.total) // r.n
    return moved


def fit(rows: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, dims: int = 64, vector: str = "embedding") -> np.ndarray:
    """The codebooks (part, entry, place), trained on all vectors; the first ``entries`` vectors by vec_id are where they start.

    Vectors that are null, hold null or non-finite components or have another length than ``dims`` take no part.  A null vec_id
    comes last and rows of one vec_id are ordered by their components.  With fewer vectors there are fewer entries, and none for an
    empty table.  Unused entries stay.  To the driver come ``entries`` vectors and, each round, a sum per entry.
    """
    width = dims // parts
    kept = whole_vectors(rows, dims, ["vec_id"], vector)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    books = np.array([r.v for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    if first:
        counted = staged(distinct_parts(kept, parts, width), "part-counts")
        for _ in range(rounds):
            books = _moved(counted, books)
    return books


def encode(rows: DataFrame, books: np.ndarray, keep: list[str], vector: str = "embedding") -> DataFrame:
    """``keep``, code (two hex digits a part) and error (squared distances summed over the parts) of every vector that ``fit`` takes.

    Repeated rows get a row each.  No shuffle.
    """
    parts, _, width = books.shape
    kept = whole_vectors(rows, parts * width, keep, vector)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])

    def code_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(len(keep)), parts * width)
            codes, error = np.zeros((len(v), parts), np.uint8), np.zeros(len(v), np.int64)
            for p in range(parts):
                leaves, own = np.unique(v[:, p * width : (p + 1) * width], axis=0, return_inverse=True)
                code, far = search(leaves, books[p])
                codes[:, p] = code[own.ravel()]
                error += far[own.ravel()]
            text = codes.tobytes().hex()
            made = [text[i * 2 * parts : (i + 1) * 2 * parts] for i in range(len(v))]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(made, pa.string()), pa.array(error, pa.int64())], [*keep, "code", "error"])

    if not books.shape[1]:
        return kept.select(*[F.col(f"`{c}`") for c in keep], F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error")).limit(0)
    return kept.mapInArrow(code_batch, f"{kinds}, code string, error bigint")


def digest(coded: DataFrame, books: np.ndarray, label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error (errors of equal labels, nulls together) and the digest of all codebooks.

    Errors are summed per label from partial sums; Spark's size check decides whether the sums are broadcast to the rows.
    """
    coded = staged(coded.select("vec_id", F.col(f"`{label}`").alias("own"), "code", "error"), "part-codes")
    sums = staged(coded.groupBy("own").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("bigint").alias("label_error")), "part-label-errors")
    sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    both = coded.join(sums.withColumnRenamed("own", "same"), F.col("own").eqNullSafe(F.col("same")))
    return both.select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))
