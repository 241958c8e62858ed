"""Line dedup by a tree of log templates: lines that recur across documents, alike but for variable fields, are dropped.

1. Fields with a digit are masked.  A line's leaf is its number of tokens and its first ``DEPTH`` tokens.
2. Two masked lines of a leaf are similar if at least ``SIMILAR`` of their positions are equal.
3. A line recurs if it and the lines similar to it stand in at least ``min_docs`` different texts, ``LONG_DOCS`` for a line of over
   ``LONG_TOKENS`` tokens: copies of a whole document do not make its lines recur.

Distinct lines are generalised first: a line joins the most similar template, and positions that differ become variable.  Lines of one
template are similar to each other, so a template of enough texts settles all of its lines; the others are compared with every line of
their leaf.  A leaf with more than ``LEAF_LINES`` distinct lines is dealt out in blocks.  A line that its own block does not settle
meets the other lines by segments: similar lines differ in at most ``apart`` positions, so of ``apart`` + 1 segments of the tokens after the
first ``DEPTH`` they share one.  The rule, and so the result, is the same at every size.

A task spells a line out once, and lines are counted by their keys from partial sums, so a very common line is one row per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.io import staged
from .text_stats import per_text

DEPTH, LEAF_LINES, SIMILAR, MIN_DOCS = 4, 2000, 0.8, 3
LONG_TOKENS, LONG_DOCS = 50, 2
MEMORY_LINES, ASKING = 500_000, 2000
VARIABLE = "<*>"
DIGIT = regex.compile(r"[0-9]")


def masked(line: str) -> list[str]:
    """The tokens of a line; those with a digit are variable."""
    tokens = line.split()
    return [VARIABLE if DIGIT.search(t) else t for t in tokens] if DIGIT.search(line) else tokens


def _key(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _line_key(whole: str, n: int) -> int:
    """The key of a masked line of ``n`` tokens; its lowest bit says whether the line is long."""
    return _key(whole) & -2 | (n > LONG_TOKENS)


def _need(line: int, min_docs: int) -> int:
    """In how many different texts a line, given by its key, has to stand."""
    return min(min_docs, LONG_DOCS) if line & 1 else min_docs


def _parser():
    """Parses batches of texts; remembers, boundedly, which lines the task has spelt out."""
    spelt: set[int] = set()

    def work(texts: list[str | None]) -> list[list]:
        content, per_line, distinct, fresh = [], [], [], []
        for text in texts:
            keys, new = [], []
            for line in (text or "").split("\n"):
                tokens = masked(line)
                if not tokens:
                    keys.append(None)
                    continue
                whole = " ".join(tokens)
                key = _line_key(whole, len(tokens))
                keys.append(key)
                if key not in spelt:
                    if len(spelt) >= MEMORY_LINES:
                        spelt.clear()
                    spelt.add(key)
                    new.append({"line": key, "leaf": _key(" ".join([str(len(tokens)), *tokens[:DEPTH]])), "whole": whole})
            content.append(_key(text or ""))
            per_line.append(keys)
            distinct.append(list(dict.fromkeys(k for k in keys if k is not None)))
            fresh.append(new)
        return [content, per_line, distinct, fresh]

    return work


def parse(docs: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """Beside the ids: a hash of the text, the key of every line in order (null: no token), the distinct keys, and masked lines with their leaf.

    A line is spelt out where a task first meets it, so a very common line comes once from each task.
    """
    kind = "content bigint, `lines` array<bigint>, `distinct` array<bigint>, fresh array<struct<line: bigint, leaf: bigint, whole: string>>"
    return per_text(docs, kind, _parser(), ids)


def generalise(lines: list[str], similar: float = SIMILAR) -> list[int]:
    """For lines of one leaf, in order: the number of the template that each joins; a position that became variable equals no token."""
    coded = _coded(lines, {})
    templates = np.zeros_like(coded)
    out: list[int] = []
    used = 0
    for own in coded:
        if used:
            equal = (templates[:used] == own).sum(axis=1)
            k = int(equal.argmax())
            if equal[k] >= similar * len(own):
                templates[k, templates[k] != own] = -1
                out.append(k)
                continue
        templates[used] = own
        out.append(used)
        used += 1
    return out


def _coded(lines: list[str], number: dict[str, int]) -> np.ndarray:
    """Tokens of lines of one length as numbers, which ``number`` keeps."""
    return np.array([[number.setdefault(t, len(number)) for t in x.split(" ")] for x in lines], np.int32)


def apart(n: int, similar: float = SIMILAR) -> int:
    """In how many of ``n`` positions similar lines differ at most."""
    return max(k for k in range(n + 1) if n - k >= similar * n)


def segments(tokens: list[str], similar: float = SIMILAR) -> list[str]:
    """The tokens after the first ``DEPTH`` in one segment more than positions in which similar lines may differ."""
    tail, parts = tokens[DEPTH:], apart(len(tokens), similar) + 1
    return [" ".join(tail[len(tail) * i // parts : len(tail) * (i + 1) // parts]) for i in range(parts)]


def _texts(of: list[list[int] | None], need: int) -> set[int] | None:
    """The different texts of lines; null where there are ``need`` of them, and from a line that recurs alone."""
    seen: set[int] = set()
    for texts in of:
        if texts is None:
            return None
        seen.update(texts)
        if len(seen) >= need:
            return None
    return seen


def _by_length(rows: list[tuple]) -> list[list[tuple]]:
    """Rows that end in (line, whole, texts), by length: more than one where keys collide."""
    out: dict[int, list[tuple]] = {}
    for row in rows:
        out.setdefault(row[-2].count(" "), []).append(row)
    return list(out.values())


def _answer(line: int, seen: set[int] | None) -> list[tuple[int, int | None]]:
    return [(line, None)] if seen is None else [(line, x) for x in sorted(seen)]


def _within(similar: float, min_docs: int):
    """Settles the lines of one block of a leaf; of a leaf with more blocks, also the texts so far of lines it cannot settle."""

    def close(rows: list[tuple[int, int, str, list[int] | None]]) -> Iterator[tuple[int, int | None]]:
        for same in _by_length(rows):
            wholes, texts = [r[2] for r in same], [r[3] for r in same]
            need = _need(same[0][1], min_docs)
            at = np.array(generalise(wholes, similar))
            members: dict[int, list[int]] = {}
            for i, k in enumerate(at.tolist()):
                members.setdefault(k, []).append(i)
            enough = {k for k, own in members.items() if _texts([texts[i] for i in own], need) is None}
            coded = _coded(wholes, {})
            for i, (blocks, line, _, own) in enumerate(same):
                if own is None:
                    continue
                seen = None
                if int(at[i]) not in enough:
                    alike = np.flatnonzero((coded == coded[i]).sum(axis=1) >= similar * coded.shape[1])
                    seen = _texts([texts[k] for k in alike.tolist()], need)
                if seen is None or blocks > 1:
                    yield from _answer(line, seen)

    return _streamed(close)


def _across(similar: float, min_docs: int):
    """The texts of those lines of one block of a segment that are similar to a line that asks; the block's own lines come first."""

    def close(rows: list[tuple[bool, int, str, list[int] | None]]) -> Iterator[tuple[int, int | None]]:
        for same in _by_length(rows):
            block, asking = [r for r in same if not r[0]], [r for r in same if r[0]]
            if not block or not asking:
                continue
            number: dict[str, int] = {}
            coded = _coded([r[2] for r in block], number)
            for _, line, whole, _ in asking:
                own = np.array([number.get(t, -1) for t in whole.split(" ")], np.int32)
                alike = np.flatnonzero((coded == own).sum(axis=1) >= similar * len(own))
                yield from _answer(line, _texts([block[k][3] for k in alike.tolist()], _need(line, min_docs)))

    return _streamed(close, asks=True)


def _streamed(close, asks: bool = False):
    """Gives ``close`` the rows of one group, which share their first two columns, and emits what it answers.

    With ``asks`` the rows of a group whose next column is true are given ``ASKING`` at a time, with all others, which come before them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows, out, waiting = None, [], [], 0
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[:2] != group:
                    out += close(rows)
                    group, rows, waiting = row[:2], [], 0
                elif waiting >= ASKING:
                    out += close(rows)
                    rows, waiting = [r for r in rows if not r[0]], 0
                rows.append(row[2:])
                waiting += asks and row[2]
            if len(out) > 10_000:
                yield _pairs(out)
                out = []
        out += close(rows)
        if out:
            yield _pairs(out)

    return run


def _pairs(rows: list[tuple[int, int | None]]) -> pa.RecordBatch:
    a, b = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["line", "content"])


def _keyed(similar: float):
    """The keys of a line's segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lines = [], []
            for leaf, line, whole in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for i, segment in enumerate(segments(whole.split(" "), similar)):
                    keys.append(_key(f"{leaf} {i} {segment}"))
                    lines.append(line)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(lines, pa.int64())], ["key", "line"])

    return run


def recurring(docs: DataFrame, min_docs: int = MIN_DOCS, similar: float = SIMILAR, leaf_lines: int = LEAF_LINES) -> DataFrame:
    """doc_id, n_lines, n_dropped and dropped (line numbers from 0) of every row.

    Lines without a token are never dropped and not counted.  Null and empty texts have no lines.  Repeated rows and other rows of
    equal text count once and get one row each.  An empty table gives no rows.  A task holds some ``leaf_lines`` lines of a leaf at
    a time, which changes no result.
    """
    row = F.monotonically_increasing_id().alias("row")
    parsed = staged(parse(docs.select("doc_id", "text", row), ["doc_id", "row"]), "line-parse")
    each = parsed.select(F.explode("fresh").alias("d")).select("d.*")
    keys = parsed.select("content", F.explode("distinct").alias("line"))
    need = F.when(F.col("line").bitwiseAND(F.lit(1)) == 1, min(min_docs, LONG_DOCS)).otherwise(min_docs)
    exact = staged(keys.distinct().groupBy("line").count().filter(F.col("count") >= need).select("line"), "line-exact")
    leaves = each.select("leaf", "line").distinct().groupBy("leaf").agg(F.count("*").alias("size")).filter("size > 1")
    shared = staged(each.join(leaves, "leaf").dropDuplicates(["line"]), "line-shared")
    # texts of lines that do not recur alone: fewer than they need each
    few = keys.join(shared.select("line").join(exact, "line", "left_anti"), "line", "left_semi").distinct()
    known = shared.join(few.groupBy("line").agg(F.collect_list("content").alias("texts")), "line", "left").select(
        "leaf", F.ceil(F.col("size") / leaf_lines).cast("int").alias("blocks"), "line", "whole", "texts"
    )
    answer = "line bigint, content bigint"
    blocks = known.select("leaf", _block("line", "blocks"), "blocks", "line", "whole", "texts")
    within = staged(blocks.repartition("leaf", "block").sortWithinPartitions("leaf", "block", "whole").mapInArrow(_within(similar, min_docs), answer), "line-within")
    # leaves of several blocks
    big = staged(known.filter("blocks > 1").drop("blocks"), "line-big")
    placed = staged(big.select("leaf", "line", "whole").mapInArrow(_keyed(similar), "key bigint, line bigint").distinct(), "line-segments")
    asking = placed.join(within.filter("content is not null").select("line").distinct(), "line", "left_semi").select("key", "line")
    met = placed.join(asking.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.ceil(F.count("*") / leaf_lines).cast("int").alias("blocks"))
    own = placed.join(met, "key").select("key", _block("line", "blocks"), F.lit(False).alias("asks"), "line")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    dealt = own.union(asking.join(met, "key").select("key", every, F.lit(True).alias("asks"), "line")).join(big.drop("leaf"), "line")
    dealt = dealt.select("key", "block", "asks", "line", "whole", "texts")
    across = dealt.repartition("key", "block").sortWithinPartitions("key", "block", "asks").mapInArrow(_across(similar, min_docs), answer)
    found = within.union(staged(across, "line-across"))
    counted = found.filter("content is not null").distinct().groupBy("line").count().filter(F.col("count") >= need)
    gone = staged(exact.union(found.filter("content is null").select("line")).union(counted.select("line")).distinct(), "line-dropped")
    places = parsed.select("row", F.posexplode("lines").alias("at", "line")).filter("line is not null")
    dropped = places.join(gone, "line", "left_semi").groupBy("row").agg(F.sort_array(F.collect_list("at")).alias("dropped"))
    return parsed.join(dropped, "row", "left").select(
        "doc_id",
        F.size(F.filter("lines", lambda x: x.isNotNull())).cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"),
    )


def _block(line: str, blocks: str):
    """The block of a line; the low bits of its key are left out."""
    return F.pmod(F.shiftright(line, 8), F.col(blocks)).cast("int").alias("block")


def without(text, dropped):
    """The text without the given lines, as a column; a null text stays null."""
    kept = F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains(F.coalesce(dropped, F.array().cast("array<int>")), i))
    return F.array_join(kept, "\n")
