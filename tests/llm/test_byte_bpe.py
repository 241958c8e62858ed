import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers as P
import tiktoken
from helpers import awkward, empty
from pyspark.sql import functions as F

from qaaudit.llm import byte_bpe as b


@pytest.fixture(scope="module")
def ranks():
    return b.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(3)
    alphabet = [32, 32, 10, 9, 0x41, 0x62, 0xE9, 0x30, 0x2E, 0x27, 0x73]
    out = ["".join(chr(rng.choice([*alphabet, rng.randrange(1, 0xD7FF)])) for _ in range(120)) for _ in range(60)]
    out += ["a" * 5000, "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(1500)), "x\x1cy \x1d\x85 z 　᠎ ", "<|endoftext|> don't", " \n\n "]
    return [(1000 + i, t, None, None, None) for i, t in enumerate(out)]


def test_ids_and_round_trip(spark, ranks, library, monkeypatch):
    monkeypatch.setattr(b, "CHUNK_CHARS", 3000)
    monkeypatch.setattr(b, "MEMORY_WORDS", 500)
    docs = awkward(spark, odd_texts()).coalesce(1)
    rows = b.encode(docs, ranks, P.PATTERN, ["doc_id", "text"]).withColumn("back", b.decode(F.col("ids"), ranks)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        want = library.encode_ordinary(r.text or "")
        assert r.ids == want
        assert bytes(r.back) == (r.text or "").encode()
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()


def test_long_words_by_heap(ranks, library):
    rng = random.Random(1)
    for n in (1, 2, 3, 50, 400):
        for _ in range(20):
            word = "".join(rng.choice("abcdeéèthing") for _ in range(n)).encode()
            assert b.merge_long(word, ranks) == library._encode_single_piece(word)


def test_empty_table(spark, ranks):
    assert b.encode(empty(spark), ranks, P.PATTERN).count() == 0


def test_words_that_tasks_share_are_folded_once(spark, ranks, library):
    rng = random.Random(9)
    common = ["".join(rng.choice("qzxjvwkyé") for _ in range(rng.randint(3, 14))) for _ in range(300)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(common) for _ in range(40)) + f" only{i}qz") for i in range(200)], "doc_id int, text string").repartition(5)
    words, flat, lengths = b.shared_words(docs.select("text"), ranks, P.PATTERN)
    assert len(words) > 200 and not any("only" in w for w in words)
    at = 0
    for word, n in zip(words, lengths, strict=True):
        assert flat[at : at + n].tolist() == library.encode_ordinary(word)
        at += n
    assert at == len(flat)
    # bounds of words and bytes are kept; nothing shared changes nothing
    for few in (b.shared_words(docs.select("text"), ranks, P.PATTERN, most=50), b.shared_words(docs.select("text"), ranks, P.PATTERN, most_bytes=400)):
        assert len(few[0]) <= 50 or sum(len(w.encode()) for w in few[0]) <= 400
    for r in b.encode(docs, ranks, P.PATTERN, ["doc_id", "text"]).collect():
        assert r.ids == library.encode_ordinary(r.text)


def test_pieces_are_folded_as_strings(spark, ranks, library):
    words = [w for w in ("".join(random.Random(i).choice("abdeghinorst") for _ in range(3 + i % 60)).encode() for i in range(400)) if w not in ranks]
    docs = spark.createDataFrame([(b._laid_out(words, *b._starts(ranks)).to_pylist(),)], f"words array<{b.WORD}>")
    made = docs.select(F.explode(F.transform("words", lambda w: b.word_pieces(b.rank_map(ranks), w))).alias("p")).toArrow().column("p")
    flat, lengths = b._ids(made)
    assert [x.tolist() for x in np.split(flat, np.cumsum(lengths)[:-1])] == [library._encode_single_piece(w) for w in words]


def spaced_texts():
    """Spaces beside other white space, at both ends, and none at all."""
    rng = random.Random(11)
    atoms = ["ab", "dons", "don't", "'s", "''s", "x,", "!?", "9", "é", " ", "  ", "\n", "\t", "\x1c", "\x85", "\u3000", "\u180e", "\xa0", "\u2003"]
    return ["".join(rng.choice([*atoms, " "]) for _ in range(rng.randint(0, 12))) for _ in range(3000)] + ["a b c", " a b", "a b ", "a  b", "a \n b", "plain"]


def test_parts_between_spaces_give_the_words_of_whole_texts():
    find, seen, texts = b.regex.compile(P.PATTERN).findall, b._Numbers(), spaced_texts()
    parts = b._Parts(P.PATTERN, seen)
    assert parts.at_spaces
    for lo in range(0, len(texts), 500):
        some = texts[lo : lo + 500]
        numbers, counts = parts.of(pa.array([*some, None]))
        by_number = list(seen)
        assert counts.tolist() == [*(len(find(t)) for t in some), 0]
        assert [by_number[n] for n in numbers] == [w for t in some for w in find(t)]
    assert [len(x) for x in parts.of(pa.array([], pa.string()))] == [0, 0]
    # a pattern that is not known to begin words at spaces is used on whole texts
    other = b._Parts(r"[a-z ]+|.", b._Numbers())
    assert other.of(pa.array(["one two three", "X y"]))[1].tolist() == [1, 2]


def test_a_common_part_is_cut_into_words_once(spark):
    parts = b._Parts(P.PATTERN, b._Numbers())
    cut, find = [], parts.find
    parts.find = lambda text: cut.append(text) or find(text)
    for _ in range(5):
        parts.of(pa.array(["a same don't, words again"] * 10))
    assert [c for c in cut if c != "a"] == [" a same don't, words again"]


def test_counting_cuts_a_common_part_and_names_a_word_once_a_task(ranks, monkeypatch):
    cut, compiled = [], b.regex.compile(P.PATTERN)

    class Recorded:
        def findall(self, text):
            cut.append(text)
            return compiled.findall(text)

    monkeypatch.setattr(b.regex, "compile", lambda pattern: Recorded())
    monkeypatch.setattr(b, "CHUNK_CHARS", 50)
    texts = [*(f"qzxj, vwkyq don't own{i}zq qzxj" for i in range(20)), None, "", "one\xa0two qzxj\n\xe9\xe9zqx"]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[lo : lo + 8], pa.string())], ["text"]) for lo in range(0, len(texts), 8)]
    named = [w for made in b._met(P.PATTERN, ranks, 1000, 100_000)(iter(batches)) for w in made.column(0).to_pylist()]
    parts = " ".join(cut).split()
    assert parts.count("vwkyq") == 1 and parts.count("qzxj,") == 1
    wanted = {w for t in texts for w in compiled.findall(" " + (t or "")) if w.encode() not in ranks}
    assert sorted(named) == sorted(wanted)
    # bounds of the memory change only how often a word is named
    assert {w for made in b._met(P.PATTERN, ranks, 0, 0)(iter(batches)) for w in made.column(0).to_pylist()} == wanted


def test_parts_that_only_other_white_space_touches_are_not_remembered():
    parts = b._Parts(P.PATTERN, b._Numbers())
    white = sorted(b.WHITE - {" "})
    assert parts.numbers(pa.array(["", *white, *(f"{w}a" for w in white), *(f"a{w}" for w in white)])).tolist() == [-1] * (1 + 3 * len(white))
    assert parts.numbers(pa.array(["ab", f"a{white[0]}b", "", "c,"])).tolist() == [0, 1, -1, 2]
    assert parts.numbers(pa.array(["c,", "new", f"a{white[0]}b"])).tolist() == [2, 3, 1]
    assert len(parts.known) == len(parts.lengths) == 4


def test_digests_of_decoded_ids(spark, ranks, library, monkeypatch):
    monkeypatch.setattr(b, "CHUNK_CHARS", 3000)
    monkeypatch.setattr(b, "MEMORY_WORDS", 200)
    monkeypatch.setattr(b, "MEMORY_PARTS", 100)
    texts = [*spaced_texts(), *(t for _, t, *_ in odd_texts())]
    docs = awkward(spark, [(2000 + i, t, None, None, None) for i, t in enumerate(texts)]).coalesce(2)
    rows = b.encode(docs, ranks, P.PATTERN, ["doc_id", "text"], decoded=b.Decoder(ranks)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.ids == library.encode_ordinary(r.text or "")
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_decoder_skips_ids_without_a_piece():
    made = b.Decoder({b"a": 0, b"\xff": 2}).opened()(np.array([0, 1, 2, 2, 7 % 3], np.uint32), np.array([0, 0, 2, 5]))
    assert [bytes(m) for m in made] == [b"", b"a", b"\xff\xff"]
