import math
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from helpers import awkward, empty
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from qaaudit.llm import packing as k

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def check(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_words_as_the_library_encodes_them(library):
    """Plain words take a shorter way; ids are the same for random ones and for joined pieces of the vocabulary."""
    rng = random.Random(1)
    letters, tails = "abcdefghijklmnopqrstuvwxyzéèçüñßABCÉÞÿ", ["", ",", ".", "!!", "%%%", "...", ");", "_", "'s", "1", "é"]
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 24))) + rng.choice(tails) for _ in range(20_000)]
    known = [w.replace("</w>", "") for w in library.get_vocab()]
    words += ["".join(rng.choice(known) for _ in range(rng.randrange(1, 4))) + rng.choice(tails) for _ in range(40_000)]
    assert sum(k.PLAIN.fullmatch(w) is not None for w in words) > 30_000
    got = k.WordIds(PATH).ids(words)
    for word, own, want in zip(words, got, library.encode_batch(words, add_special_tokens=False), strict=True):
        assert own == want.ids, word


@pytest.mark.parametrize("per_partition", [20_000, 7])
def test_pieces_and_sequences(spark, library, per_partition, monkeypatch):
    monkeypatch.setattr(k, "MEMORY_WORDS", 50)
    rng = random.Random(3)
    odd = ["".join(chr(rng.choice([32, 32, 10, 9, 0x41, 0xE9, 0x30, 0x27, 0x73, 0x301, 0x85, 0x1C, 0x3A3, rng.randrange(1, 0xD7FF)])) for _ in range(150)) for _ in range(40)]
    docs = awkward(spark, [(100 + i, t, None, None, None) for i, t in enumerate([*odd, "<|endoftext|> don't", "a" * 9000])])
    capacity = 512
    rows = k.pack(k.pieces(docs, PATH, capacity=capacity), capacity, per_partition=per_partition).collect()
    want = []
    for r in docs.collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(r.doc_id, n, at, len(ids[at : at + capacity]), zlib.crc32(ids[at : at + capacity].tobytes())) for n, at in enumerate(range(0, len(ids), capacity))]
    assert sorted((tuple(r)[:5] for r in rows), key=str) == sorted(want, key=str)
    used = check(rows, capacity)
    assert used <= math.ceil(sum(r.length for r in rows) / capacity) + 1


def test_empty_table(spark):
    made = k.pack(k.pieces(empty(spark), PATH))
    assert made.count() == 0 and made.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_best_fit_decreasing_against_plain_search():
    rng = random.Random(6)
    for _ in range(50):
        lengths = np.array([rng.randrange(1, 41) for _ in range(rng.randrange(1, 60))])
        bins, offsets, used = k.best_fit_decreasing(lengths, 40)
        gaps = []
        for n in sorted(lengths.tolist(), reverse=True):
            fits = [g for g in gaps if g >= n]
            if fits:
                gaps.remove(min(fits))
                gaps.append(min(fits) - n)
            else:
                gaps.append(40 - n)
        assert used == len(gaps)
        assert sorted(40 - np.bincount(bins, lengths, used)) == sorted(gaps)


def fewest(lengths, capacity):
    """Exact minimum by search."""
    best = [len(lengths)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + lengths[i] <= capacity:
                bins[j] += lengths[i]
                place(i + 1, bins)
                bins[j] -= lengths[i]
        bins.append(lengths[i])
        place(i + 1, bins)
        bins.pop()

    place(0, [])
    return best[0]


def test_bound_never_exceeds_the_minimum():
    rng = random.Random(9)
    tight = 0
    for _ in range(200):
        lengths = sorted((rng.randrange(1, 21) for _ in range(rng.randrange(1, 9))), reverse=True)
        bound, least = k.lower_bound(np.array(lengths), 20), fewest(lengths, 20)
        assert bound <= least
        tight += bound == least
    assert tight > 180
    assert k.lower_bound(np.array([11] * 7), 20) == 7 and k.lower_bound(np.array([], int)) == 0


def test_strings_of_special_tokens_are_those_tokens(library):
    """As the plain call encodes them, wherever they stand."""
    texts = ["hello <|endoftext|> world <|startoftext|>x", "a<|endoftext|><|endoftext|>b\n<|ENDOFTEXT|> <|endoftext|", "<|startoftext|>", "é<|startoftext|>É ,<|endoftext|>!"]
    got = [list(map(int, own)) for own in k.WordIds(PATH).of(texts)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert got[0] == [3306, 49407, 1002, 49406, 343]


def test_rows_with_null_ids_spread_over_partitions(spark):
    rows = spark.range(100_000, numPartitions=8).selectExpr("cast(null as bigint) doc_id", "0 piece", "0L start", "2000L length", "7L ids_crc32")
    out = k.pack(rows, per_partition=5000)
    parts = out.groupBy(((F.col("sequence_id") / (1 << 28)).cast("bigint")).alias("part")).count().collect()
    assert sum(r["count"] for r in parts) == 100_000 and len(parts) >= 20 and max(r["count"] for r in parts) < 6000
    assert out.select("sequence_id").distinct().count() == 50_000 and "deal" not in out.columns
