"""Byte-level BPE: distinct words are merged by Spark higher-order functions over a literal rank map.

A word, as the string of the pieces it consists of, one character each, is folded by ranked merges: the pair whose concatenation
has the lowest rank is merged, leftmost first, until no pair has a rank.  Beside the pieces stand the ranks of their pairs, one
character each, so that a merge looks up two pairs only.  A piece and its rank have the same character, in the order of ranks.

Words that several tasks meet are counted over the whole table and folded once; every task starts from their ids (a bounded
table).  Then three steps follow each other in a task without a shuffle: Arrow batches are cut into words and the words not
yet seen by the task are listed once; these are folded; the ids of each document are put together from the ids of its words.
What stands between two spaces is cut into words where the task meets it first.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice, pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaaudit.sources.io import staged

#: Pairs are dealt to this many buckets by the CRC-32 of their two characters.
BUCKETS = 1 << 16
#: Characters begin here, and leave out the surrogates.
FIRST, SURROGATES, AFTER = 0x100, 0xD800, 0x800
#: Characters above those of all pieces: the rank of a pair that joins to no piece; both ends of a word, which join nothing; before a pair in a bucket.
UNRANKED, MARK, PAIR = "\U0001F000", "\U0001F001", "\U0001F002"
#: A word as it is folded.
WORD = "struct<pieces: string, ranks: string>"
CHUNK_CHARS = 1_500_000
#: Words, and characters in them, that a task remembers besides the shared ones before it starts over, which bounds its memory.
MEMORY_WORDS = 150_000
MEMORY_CHARS = 8_000_000
#: The same for what stands between two spaces.
MEMORY_PARTS = 200_000
#: Words, and bytes in them, that are folded once for all tasks: those that most tasks meet.  Others are folded where they are met.
SHARED_WORDS = 350_000
SHARED_BYTES = 8_000_000
#: Longer words are merged by a heap, as every merge of the fold copies the word.
FOLD_BYTES = 128
#: Patterns by which a word begins at every space that has other characters than white space on both sides.
CUT_AT_SPACES = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",)
#: All white space of these patterns.
WHITE = frozenset(c for c in map(chr, range(0x3001)) if regex.match(r"\s", c))


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file of one base64 piece and its rank per line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines()) if a}


def _json_literal(value: object, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), kind)


def _char(rank: int) -> str:
    """The character of a piece."""
    return chr(code if (code := rank + FIRST) < SURROGATES else code + AFTER)


def _ranks_of(codes: np.ndarray) -> np.ndarray:
    """Ranks of characters of pieces, given as code points."""
    return (codes - np.where(codes < SURROGATES, FIRST, FIRST + AFTER)).astype(np.uint32)


def pair_buckets(ranks: dict[bytes, int]) -> list[str]:
    """For every two pieces that join to a piece: both and their rank behind PAIR, in their bucket; a bucket begins with UNRANKED."""
    if _char(max(ranks.values())) >= UNRANKED:
        raise ValueError("ids have to be below 124,672")
    buckets = [[UNRANKED] for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        for cut in range(1, len(piece)):
            a, b = ranks.get(piece[:cut]), ranks.get(piece[cut:])
            if a is not None and b is not None:
                pair = PAIR + _char(a) + _char(b)
                buckets[zlib.crc32(pair.encode()) % BUCKETS].append(pair + _char(rank))
    return ["".join(b) for b in buckets]


def rank_map(ranks: dict[bytes, int]) -> Column:
    """The literal map from pairs of pieces to ranks; a lookup looks at a few entries."""
    return _json_literal(pair_buckets(ranks), "array<string>")


def _let(value: Column, then) -> Column:
    """``then`` of a value that is computed, or written into the plan, once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def joined_rank(pairs: Column, pair: Column) -> Column:
    """Rank of the piece that two pieces join to, which follows them in their bucket; where they are not in it, its first character."""

    def found(pair: Column) -> Column:
        bucket = F.get(pairs, F.crc32(pair).bitwiseAND(F.lit(BUCKETS - 1)).cast("int"))
        return F.substring(F.call_function("substring_index", bucket, pair, F.lit(-1)), F.lit(1), F.lit(1))

    return _let(pair, found)


def _merged_once(pairs: Column, word: Column) -> Column:
    """The leftmost pair of the lowest rank becomes one piece, with new ranks on both sides."""
    pieces, between = word["pieces"], word["ranks"]

    def merge(best: Column, at: Column) -> Column:
        # before a word's first piece stands a mark, which joins nothing
        left = F.when(at == 2, F.lit(UNRANKED)).otherwise(joined_rank(pairs, F.concat(F.lit(PAIR), F.substring(pieces, at - 1, F.lit(1)), best)))
        right = joined_rank(pairs, F.concat(F.lit(PAIR), best, F.substring(pieces, at + 2, F.lit(1))))
        return F.struct(F.overlay(pieces, best, at, F.lit(2)).alias("pieces"), F.overlay(between, F.concat(left, right), at - 1, F.lit(3)).alias("ranks"))

    lowest = F.array_min(F.split(between, ""))
    return _let(lowest, lambda best: F.when(best < F.lit(UNRANKED), _let(F.instr(between, best), lambda at: merge(best, at))).otherwise(word))


def word_pieces(pairs: Column, word: Column) -> Column:
    """Pieces, between two marks, of a word that is not a piece itself, after all merges.

    The word comes as the pieces of its bytes between two marks, and the ranks of their pairs between two UNRANKED.
    """
    # two pieces are left at least, so there are two merges fewer than bytes at most
    merges = F.greatest(F.length(word["pieces"]) - 4, F.lit(0))
    return F.aggregate(F.array_repeat(F.lit(0), merges), word, lambda acc, _: _merged_once(pairs, acc), lambda acc: acc["pieces"])


def _ids(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words as ``word_pieces`` gives them, one after the other, and their numbers."""
    codes = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32)
    marks = np.flatnonzero(codes == ord(MARK))
    return _ranks_of(codes[codes != ord(MARK)]), marks[1::2] - marks[::2] - 1


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap, for words of any length in n log n."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))

    def ask(i: int) -> None:
        j = after[i]
        if j < n and (r := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[i], end[j]))

    heap: list[tuple[int, int, int, int]] = []
    alive = [True] * n
    for i in range(n - 1):
        ask(i)
    while heap:
        _, i, mid, last = heapq.heappop(heap)
        if not alive[i] or end[i] != mid or (j := after[i]) >= n or end[j] != last:
            continue
        alive[j], end[i], after[i] = False, last, after[j]
        if after[i] < n:
            before[after[i]] = i
        if before[i] >= 0:
            ask(before[i])
        ask(i)
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = after[i]
    return out


def _laid_out(words: list[bytes], of_byte: np.ndarray, of_pair: np.ndarray) -> pa.Array:
    """Words as ``word_pieces`` takes them."""
    n = np.array([len(w) for w in words], np.int64)
    raw = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum(n)

    def strings(inner: np.ndarray, lengths: np.ndarray, around: str) -> list[str]:
        stops = np.cumsum(lengths + 2)
        codes = np.full(stops[-1] if len(stops) else 0, ord(around), np.uint32)
        codes[np.arange(len(inner)) + 2 * np.repeat(np.arange(len(lengths)), lengths) + 1] = inner
        whole = codes.tobytes().decode("utf-32-le")
        return [whole[a:b] for a, b in zip((stops - lengths - 2).tolist(), stops.tolist(), strict=True)]

    within = np.ones(len(raw), bool)
    within[ends - 1] = False  # a word's last byte makes no pair
    first = np.flatnonzero(within)
    pieces = strings(of_byte[raw], n, MARK)
    between = strings(of_pair[raw[first], raw[first + 1]], n - 1, UNRANKED)
    return pa.StructArray.from_arrays([pa.array(pieces, pa.string()), pa.array(between, pa.string())], ["pieces", "ranks"])


def _starts(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of the single bytes, and of the ranks of their pairs, as code points."""
    of_byte = np.array([ord(_char(ranks[bytes([b])])) for b in range(256)], np.uint32)
    joined = [[ranks.get(bytes([a, b])) for b in range(256)] for a in range(256)]
    return of_byte, np.array([[ord(UNRANKED if r is None else _char(r)) for r in row] for row in joined], np.uint32)


def _chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Where chunks of texts begin and end: some CHUNK_CHARS characters each, one text at least."""
    sizes, lo = [n or 0 for n in pc.utf8_length(texts).to_pylist()], 0
    while lo < len(sizes):
        hi, size = lo, 0
        while hi < len(sizes) and (hi == lo or size < CHUNK_CHARS):
            size += sizes[hi]
            hi += 1
        yield lo, hi
        lo = hi


def _parts_of(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """How many parts each text has, which are what its spaces cut it into, and the parts of all texts."""
    split = pc.split_pattern(pc.fill_null(texts, ""), " ")
    return pc.list_value_length(split).to_numpy().astype(np.int64), split.flatten().dictionary_encode()


def _joined(parts: pa.Array) -> str:
    """Parts one after the other, each behind a space."""
    return " " + pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(parts)], pa.int32()), parts), " ")[0].as_py()


def _met(pattern: str, ranks: dict[bytes, int], most: int, most_bytes: int):
    """The words that a task meets, each once as far as its memory goes, but for pieces and words too long for the fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        plain = {w for p in ranks if (w := p.decode(errors="replace")).encode() == p}
        seen, chars, known = {*plain}, 0, None
        for batch in batches:
            for lo, hi in _chunks(batch.column(0)):
                # what lies between two spaces is cut once; words that this way of cutting misses are folded where they are met
                parts = _parts_of(batch.column(0).slice(lo, hi - lo))[1].dictionary
                if known is None or len(known) > MEMORY_PARTS or known.nbytes > MEMORY_CHARS:
                    known = parts.slice(0, 0)
                new = parts.filter(pc.is_null(pc.index_in(parts, value_set=known)))
                known = pa.concat_arrays([known, new])
                if len(seen) - len(plain) > most or chars > most_bytes:
                    seen, chars = {*plain}, 0
                fresh = {*find(_joined(new))} - seen
                seen |= fresh
                chars += sum(map(len, fresh))
                named = [w for w in fresh if 4 * len(w) <= FOLD_BYTES or len(w) <= FOLD_BYTES and len(w.encode()) <= FOLD_BYTES]
                # Arrow would keep what it has freed, and a Python worker goes on to other tasks
                pa.default_memory_pool().release_unused()
                yield pa.RecordBatch.from_arrays([pa.array(named, pa.string())], ["word"])

    return run


def shared_words(texts: DataFrame, ranks: dict[bytes, int], pattern: str, most: int = SHARED_WORDS, most_bytes: int = SHARED_BYTES) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The words that most tasks meet with their ids, one after the other, and the ids' numbers (actions).

    Words that are pieces, or too long for the fold, are not among them.  Each task names a word once, so a count is a number of
    tasks; the least count is taken with which words and bytes stay within their bounds.
    """

    def laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_byte, of_pair = _starts(ranks)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _laid_out([w.encode() for w in batch.column(0).to_pylist()], of_byte, of_pair)], ["word", "open"])

    counted = staged(texts.mapInArrow(_met(pattern, ranks, most, most_bytes), "word string").groupBy("word").agg(F.count("*").alias("n")).where("n > 1"), "bpe-words")
    # as many counts as there are tasks
    levels = counted.groupBy("n").agg(F.count("*").alias("words"), F.sum(F.octet_length("word")).alias("bytes")).orderBy(F.desc("n")).collect()
    least, words, size = None, 0, 0
    for r in levels:
        words, size = words + r.words, size + r.bytes
        if words > most or size > most_bytes:
            break
        least = r.n
    if least is None:
        return [], np.empty(0, np.uint32), np.empty(0, np.int64)
    spread = counted.where(F.col("n") >= least).select("word").repartition("word").mapInArrow(laid_out, f"word string, open {WORD}")
    folded = spread.select("word", _let(rank_map(ranks), lambda pairs: word_pieces(pairs, F.col("open"))).alias("pieces")).toArrow()
    return folded.column("word").to_pylist(), *_ids(folded.column("pieces"))


class _Numbers(dict):
    """Words and their numbers; a new word gets the next one."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


class _Parts:
    """Texts as the numbers of their words.

    A part is what follows a space, up to the next one; its words are looked for where it is met first.  The beginning of a text up
    to its first space, and a whole text that has a space beside other white space, are cut on their own.
    """

    def __init__(self, pattern: str, seen: _Numbers) -> None:
        self.find, self.at_spaces, self.seen = regex.compile(pattern).findall, pattern in CUT_AT_SPACES, seen
        self.forget()

    def forget(self) -> None:
        self.known, self.chars, self.words, self.lengths = None, 0, array("i"), array("i")

    def numbers(self, parts: pa.Array) -> np.ndarray:
        """Numbers of different parts; those not met before get one, except that they are empty, or begin or end with white space: -1."""
        if self.known is None:
            self.known = parts.slice(0, 0)
        at = pc.index_in(parts, value_set=self.known)
        trimmed = pc.utf8_trim(parts, characters="".join(WHITE))
        inner = pc.and_(pc.greater(pc.binary_length(parts), 0), pc.equal(pc.binary_length(trimmed), pc.binary_length(parts)))
        new = pc.and_(pc.is_null(at), inner)
        plain, numbers = parts.filter(new), pc.fill_null(at, -1).to_numpy().astype(np.int64)
        numbers[new.to_numpy(zero_copy_only=False)] = len(self.lengths) + np.arange(len(plain))
        if len(plain):
            self.known = pa.concat_arrays([self.known, plain])
            self.chars += pc.sum(pc.utf8_length(plain)).as_py()
            words = self.find(_joined(plain))
            # the first word of a part begins with the space, no other does
            starts = np.flatnonzero(np.array([w[0] == " " for w in words], bool))
            self.words.extend(map(self.seen.__getitem__, words))
            self.lengths.extend(np.diff(starts, append=len(words)).tolist())
        return numbers

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words of texts, one text after the other, and the words of each text."""
        n = np.ones(len(texts), np.int64)
        first, numbers, own = np.arange(len(texts)), np.zeros(len(texts), np.int64), pc.fill_null(texts, "")
        if self.at_spaces and len(texts):
            n, coded = _parts_of(own)
            first = np.cumsum(n) - n
            at = coded.indices.to_numpy()
            numbers = self.numbers(coded.dictionary)[at]
            heads = coded.dictionary.take(pa.array(at[first])).to_pylist()
            numbers[first] = 0
            whole = np.minimum.reduceat(numbers, first) < 0
            whole |= (n > 1) & np.array([not h or h[-1] in WHITE for h in heads])
            kept = ~np.repeat(whole, n)
            kept[first] = True
            own = [own[i].as_py() if w else h for i, (w, h) in enumerate(zip(whole.tolist(), heads, strict=True))]
            numbers, n = numbers[kept], np.where(whole, 1, n)
            first = np.cumsum(n) - n
        else:
            own = own.to_pylist()
        # what is cut on its own is forgotten afterwards
        words, parts = len(self.words), len(self.lengths)
        numbers[first] = parts + np.arange(len(own))
        for text in own:
            found = self.find(text)
            self.words.extend(map(self.seen.__getitem__, found))
            self.lengths.append(len(found))
        got, ends = _Known(np.array(self.words, np.int32), np.array(self.lengths, np.int64)).gather(numbers)
        del self.words[words:], self.lengths[parts:]
        return got, np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n)])])


def _words(pattern: str, ids: list[str], ranks: dict[bytes, int], shared):
    """Chunks of documents: per chunk the rows, words of each, numbers of the words, and the words first seen.

    Words that are pieces, and long ones, come with their ids; the others are to be folded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_byte, of_pair = _starts(ranks)
        seen, chars = _Numbers(zip(shared.value, range(len(shared.value)), strict=True)), 0
        base, parts = len(seen), _Parts(pattern, seen)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            rows = pa.StructArray.from_arrays(batch.columns[:-1], ids)
            for lo, hi in _chunks(texts):
                reset = len(seen) - base > MEMORY_WORDS or chars > MEMORY_CHARS
                if reset:
                    chars = 0
                    for word in [*islice(seen, base, None)]:
                        del seen[word]
                if reset or len(parts.lengths) > MEMORY_PARTS or parts.chars > MEMORY_CHARS:
                    parts.forget()
                known = len(seen)
                words, counts = parts.of(texts.slice(lo, hi - lo))
                pa.default_memory_pool().release_unused()
                fresh = [w.encode() for w in islice(seen, known, None)]
                chars += sum(map(len, fresh))
                given = [[ranks[w]] if w in ranks else merge_long(w, ranks) if len(w) > FOLD_BYTES else None for w in fresh]
                open_words = _laid_out([w for w, g in zip(fresh, given, strict=True) if g is None], of_byte, of_pair)
                cells = [rows.slice(lo, hi - lo), pa.array(counts, pa.int32()), open_words, pa.array(given, pa.list_(pa.int32()))]
                lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in cells]
                whole = pa.array([words.astype(np.int32).tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([*lists, whole, pa.array([reset])], ["rows", "counts", "open_words", "given", "number", "reset"])

    return run


class Decoder:
    """Decodes ids in a task as ``decode`` does: their pieces one after the other; ids without a piece are skipped."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        by_id = {r: p for p, r in ranks.items()}
        self.pieces = [by_id.get(i) for i in range(max(by_id) + 1)]

    def opened(self):
        """A function of the ids of texts, one after the other, and where each text's begin (and the last one's end), to their bytes."""
        pieces = pa.array(self.pieces, pa.large_binary())

        def bytes_of(ids: np.ndarray, cuts: np.ndarray) -> Iterator[memoryview]:
            found = pieces.take(pa.array(ids))
            ends, whole = np.frombuffer(found.buffers()[1], np.int64)[cuts].tolist(), memoryview(found.buffers()[2] or b"")
            return (whole[a:b] for a, b in pairwise(ends))

        return bytes_of


class _Known:
    """Ids of the words of a task, in one growing array."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        self.flat, self.starts, self.lengths = flat, np.cumsum(lengths) - lengths, lengths

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        starts = len(self.flat) + np.cumsum(lengths) - lengths
        self.flat, self.starts = np.concatenate([self.flat, ids]), np.concatenate([self.starts, starts])
        self.lengths = np.concatenate([self.lengths, lengths])

    def gather(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after the other, and where each word's end."""
        n = self.lengths[number]
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[number] - (ends - n), n)
        return self.flat[at], ends


def _in_order(given: pa.ListArray, folded: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids and lengths of the words first seen in a chunk: the null places of ``given`` are filled from ``folded``."""
    is_open = given.is_null().to_numpy(zero_copy_only=False)
    of_open, numbers = _ids(folded)
    lengths = np.empty(len(given), np.int64)
    lengths[~is_open] = given.drop_null().value_lengths().to_numpy()
    lengths[is_open] = numbers
    flat = np.empty(int(lengths.sum()), np.uint32)
    owner = np.repeat(is_open, lengths)
    flat[~owner] = given.drop_null().flatten().to_numpy()
    flat[owner] = of_open
    return flat, lengths


def _documents(kinds: list[pa.DataType], ids: list[str], shared, decoded: Decoder | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = decoded.opened() if decoded else None
        known = _Known(*shared.value)
        for batch in batches:
            for k in range(batch.num_rows):
                if batch.column("reset")[k].as_py():
                    known = _Known(*shared.value)
                known.add(*_in_order(batch.column("given")[k].values, batch.column("folded")[k].values))
                counts = batch.column("counts")[k].values.to_numpy()
                got, ends = known.gather(np.frombuffer(batch.column("number")[k].as_buffer(), np.int32))
                cuts = np.concatenate([[0], np.concatenate([[0], ends])[np.cumsum(counts)]]).astype(np.int64)
                rows = batch.column("rows")[k].values
                own = [rows.field(i).cast(t) for i, t in enumerate(kinds)]
                whole = got.astype("<u4")
                for lo in range(0, len(counts), 1024):
                    hi = min(lo + 1024, len(counts))
                    hashes = [hashlib.sha256(whole[cuts[i] : cuts[i + 1]].tobytes()).hexdigest() for i in range(lo, hi)]
                    offsets = pa.array(cuts[lo : hi + 1] - cuts[lo], pa.int32())
                    lists = pa.ListArray.from_arrays(offsets, pa.array(got[cuts[lo] : cuts[hi]].astype(np.int32)))
                    cells, names = [*[o.slice(lo, hi - lo) for o in own], lists, pa.array(hashes, pa.string())], [*ids, "ids", "ids_sha256"]
                    if bytes_of:
                        digests = [hashlib.sha256(text).hexdigest() for text in bytes_of(got[cuts[lo] : cuts[hi]], cuts[lo : hi + 1] - cuts[lo])]
                        cells, names = [*cells, pa.array(digests, pa.string())], [*names, "decoded_sha256"]
                    yield pa.RecordBatch.from_arrays(cells, names)

    return run


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, ids: list[str] | None = None, decoded: Decoder | None = None) -> DataFrame:
    """``ids`` array<int> of every whole text beside its id columns, and their SHA-256 as little-endian 32-bit integers.

    With a decoder, the ids are decoded where they are made, and ``decoded_sha256`` is the SHA-256 of those bytes.
    Null and empty texts have no ids; repeated rows get equal ids; an empty table gives no rows.  No special tokens.
    Words of more than 128 bytes are merged by a heap instead of the fold, to the same ids.  The texts are read twice: for the
    words that tasks share, and to be encoded.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    keys = ids or ["doc_id"]
    narrow = docs.select(*[F.col(f"`{c}`") for c in keys], F.col("text").alias("__text"))
    kinds = [(f.name, f.dataType.simpleString()) for f in narrow.schema.fields[:-1]]
    row = ", ".join(f"`{n}`: {k}" for n, k in kinds)
    kind = f"rows array<struct<{row}>>, counts array<int>, open_words array<{WORD}>, given array<array<int>>, number binary, reset boolean"
    named, *known = shared_words(narrow.select("__text"), ranks, pattern)
    words, shared = map(docs.sparkSession.sparkContext.broadcast, (named, known))
    cut = narrow.mapInArrow(_words(pattern, keys, ranks, words), kind)
    folded = _let(rank_map(ranks), lambda pairs: F.transform("open_words", lambda w: word_pieces(pairs, w))).alias("folded")
    types = [f.type for f in to_arrow_schema(narrow.schema)][:-1]
    whole = ", ".join(f"`{n}` {k}" for n, k in kinds) + ", ids array<int>, ids_sha256 string" + ", decoded_sha256 string" * (decoded is not None)
    return cut.select("rows", "counts", "number", "given", "reset", folded).mapInArrow(_documents(types, keys, shared, decoded), whole)


def pieces(ranks: dict[bytes, int]) -> Column:
    """Literal array of the pieces by id."""
    by_id = {r: p.decode("latin-1") for p, r in ranks.items()}
    return _json_literal([by_id.get(i) for i in range(max(by_id) + 1)], "array<string>")


def decode(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes of an array of ids: their pieces one after the other; ids without a piece are skipped."""
    return F.encode(_let(pieces(ranks), lambda p: F.array_join(F.transform(ids, lambda i: F.get(p, i)), "")), "ISO-8859-1")
