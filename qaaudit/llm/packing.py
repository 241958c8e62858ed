"""Packing documents into sequences: best-fit decreasing in partitions, certified by lower bounds, repacked by exchange.

Each partition packs its pieces by best-fit decreasing and compares its bins with a lower bound from dual-feasible functions.  A
partition that meets its bound keeps all bins but its emptiest one; one that does not keeps its full bins.
The documents of the other bins are exchanged: dealt anew over fewer partitions, and packed again.  The last round has
one partition or ends the exchange.  Only lengths move, never texts.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.io import staged

CAPACITY = 4096
PIECES_PER_PARTITION = 20_000
MEMORY_WORDS = 200_000


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: A word of letters that lower case and composition leave single, and the punctuation behind it: two words to the tokenizer.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
WORD_END = b"\xff"


@cache
def _plain_encoder(path: str) -> Callable[[bytes], list[int]]:
    """Merges of the same vocabulary for the bytes of one word and ``WORD_END``, a byte that UTF-8 never has.

    Ids below the merges are the single bytes, then those that end a word; so the end mark joins its byte first.
    """
    import tiktoken

    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
    ranks = {}
    for piece, number in model["vocab"].items():
        body = piece.removesuffix(model["end_of_word_suffix"])
        if all(c in byte_of for c in body) and not (piece.startswith("<|") and piece.endswith("|>")):
            ranks[bytes(byte_of[c] for c in body) + WORD_END * (body != piece)] = number
    ranks.setdefault(WORD_END, max(model["vocab"].values()) + 1)  # never left over: every byte joins it
    return tiktoken.Encoding("words", pat_str=".+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece


class WordIds:
    """Ids of texts, put together from the ids of their words.

    The tokenizer never joins characters across white space, and the strings of its special tokens have none, so each distinct run
    between blanks or line ends is encoded once; what is remembered is bounded.  Plain words go through the merges directly, all others through the tokenizer.
    """

    def __init__(self, path: str):
        self.tokenizer, self.plain = _tokenizer(path), _plain_encoder(path)
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.parts: dict[str, list[int]] = {}
        self.flat, self.starts, self.lengths = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _part(self, part: str) -> list[int]:
        found = self.parts.get(part)
        if found is None:
            found = self.parts[part] = self.plain(part.encode() + WORD_END)
        return found

    def ids(self, fresh: list[str]) -> list[list[int]]:
        """Ids of each of some words."""
        out: list[list[int] | None] = []
        for word in fresh:
            if m := PLAIN.fullmatch(word):
                letters, tail = m.groups()
                own = self._part(letters.lower())
                out.append(own + self._part(tail) if tail else own)
            else:
                out.append(None)
        others = [i for i, x in enumerate(out) if x is None]
        for lo in range(0, len(others), 4096):
            at = others[lo : lo + 4096]
            for i, e in zip(at, self.tokenizer.encode_batch([fresh[i] for i in at], add_special_tokens=False), strict=True):
                out[i] = e.ids
        return out

    def _learn(self, fresh: list[str]) -> None:
        ids = self.ids(fresh)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum()))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.flat, self.lengths = np.concatenate([self.flat, flat]), np.concatenate([self.lengths, lengths])

    def of(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        if len(self.number) > MEMORY_WORDS:
            self._forget()
        known, rows = len(self.number), []
        for text in texts:
            words = (text or "").replace("\n", " ").split(" ")
            rows.append([self.number.setdefault(w, len(self.number)) for w in words])
        self._learn(list(self.number)[known:])
        for row in rows:
            at = np.array(row, np.int64)
            n = self.lengths[at]
            ends = np.cumsum(n)
            yield self.flat[np.arange(ends[-1]) + np.repeat(self.starts[at] - (ends - n), n)]


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY, ids: list[str] | None = None) -> DataFrame:
    """Pieces of every document: its ids and the end id, cut only where it is longer than ``capacity``.

    Columns: the id columns, piece, start, length, ids_crc32.  Null and empty texts are the end id alone.
    """
    keys = ids or ["doc_id"]
    narrow = docs.select(*[F.col(f"`{c}`") for c in keys], F.col("text").alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(tokenizer_path)
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                row, piece, start, length, crc = [], [], [], [], []
                for i, own in enumerate(words.of(batch.column(batch.num_columns - 1).to_pylist())):
                    all_ids = np.append(own, np.uint32(end_id)).astype("<u4")
                    for k, at in enumerate(range(0, len(all_ids), capacity)):
                        part = all_ids[at : at + capacity]
                        row.append(i)
                        piece.append(k)
                        start.append(at)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                own_keys = [batch.column(c).take(pa.array(row, pa.int64())) for c in range(batch.num_columns - 1)]
                made = [pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]]
                yield pa.RecordBatch.from_arrays([*own_keys, *made], [*keys, "piece", "start", "length", "ids_crc32"])

    return narrow.mapInArrow(run, f"{kinds}, piece int, start bigint, length bigint, ids_crc32 bigint")


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """No packing has fewer bins: the largest of three families of dual-feasible functions."""
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((counts * size).sum()) // capacity)
    # u_k: (k + 1) x rounded down to k-ths, unless it is whole
    for k in range(1, 33):
        whole = (size * (k + 1)) % capacity == 0
        value = np.where(whole, size * k, (size * (k + 1) // capacity) * capacity)  # in units of 1 / (k capacity)
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    # items over capacity - t stand alone; those between t and capacity - t count by size
    large, sums = np.cumsum(counts[::-1])[::-1], np.cumsum(counts * size)
    t = np.arange(1, capacity // 2 + 1)
    middle = sums[capacity - t] - sums[t - 1]
    over = np.append(large, 0)[capacity - t + 1]
    return max(best, int((over + -(-middle // capacity)).max()))


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item, longest first, each into the fullest bin that takes it."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_gaps, used = 0, 0  # bit g: a bin with gap g is there
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = open_gaps >> n
        if fits:
            gap = n + (fits & -fits).bit_length() - 1
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                open_gaps ^= 1 << gap
        else:
            gap, b = capacity, used
            used += 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > n:
            if not by_gap[gap - n]:
                open_gaps |= 1 << (gap - n)
            by_gap[gap - n].append(b)
    return bins, offsets, used


def _filler(keys: list[str], capacity: int, number: int, last: bool):
    """Packs one partition in round ``number``, and says which pieces are to be exchanged."""

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([*keys, "piece", "start"], kind="stable").reset_index(drop=True)
        lengths = group["length"].to_numpy(np.int64)
        bins, offsets, used = best_fit_decreasing(lengths, capacity)
        filled = np.bincount(bins, lengths, used)
        again = np.zeros(used, bool)
        if not last:
            if used <= lower_bound(lengths, capacity):
                again[int(filled.argmin())] = filled.min() < capacity
            else:
                again = filled < capacity
        group["sequence_id"] = (number << 60) + (int(group["part"].iloc[0]) << 28) + bins
        group["offset"] = offsets
        group["again"] = again[bins]
        return group.drop(columns="part")

    return fill


def pack(cut: DataFrame, capacity: int = CAPACITY, rounds: int = 8, per_partition: int = PIECES_PER_PARTITION, ids: list[str] | None = None) -> DataFrame:
    """``sequence_id`` and ``offset`` for every piece; within a sequence the offsets have no gap.

    Pieces are dealt to partitions by a number that they get when they are staged, so rows with null or equal ids spread like all
    others; repeated rows are pieces of their own.  In a partition, ties of length go by id columns and piece.
    An empty table gives no rows.
    """
    keys = ids or ["doc_id"]
    rows = staged(cut.withColumn("deal", F.monotonically_increasing_id()), "pieces")
    columns = rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    done: list[DataFrame] = []
    for number in range(rounds):
        n = rows.count()
        if n == 0:
            break
        parts = -(-n // per_partition)
        last = number == rounds - 1 or parts == 1
        part = F.pmod(F.xxhash64("deal", F.lit(number)), F.lit(parts))
        made = rows.withColumn("part", part).groupBy("part").applyInPandas(_filler(keys, capacity, number, last), schema + ", sequence_id bigint, offset bigint, again boolean")
        made = staged(made, f"packed-{number}")
        done.append(made.filter("not again").drop("again"))
        rows = made.filter("again").select(*columns)
        if last:
            break
    out = rows.limit(0).withColumn("sequence_id", F.lit(0).cast("bigint")).withColumn("offset", F.lit(0).cast("bigint"))
    for df in done:
        out = out.union(df)
    return out.drop("deal")
