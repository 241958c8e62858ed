import random

import public_tokenizers as P
import pytest
from helpers import awkward, empty
from tokenizers import Tokenizer, models

from qaaudit.llm import token_counts as t


@pytest.fixture(scope="module")
def vocabulary():
    return t.Vocabulary.from_sentencepiece(P.path("piece_bpe_32k.model"))


def library(pieces, fallback):
    """The tokenizers library's unigram model over the same pieces."""
    unknown = min(s for _, s in pieces)
    more = [(f"<0x{i:02X}>", unknown) for i in range(256)] if fallback else []
    return Tokenizer(models.Unigram([("<unk>", unknown), *more, *pieces], 0, fallback))


def odd_texts():
    rng = random.Random(1)
    return ["".join(chr(rng.choice([32, 32, 10, 0x41, 0x62, 0xE9, 0x61, 0x74, 0x68, 0x65, rng.randrange(33, 0xD7FF)])) for _ in range(60)) for _ in range(150)]


@pytest.mark.parametrize("fallback", [False, True])
def test_counts_equal_the_library(vocabulary, fallback):
    counter, whole = t.Counter(t.Vocabulary(vocabulary.pieces, fallback)), library(list(vocabulary.pieces), fallback)
    for text in [*odd_texts(), "the and of", " ", "  two  blanks ", "a" * 300]:
        assert counter.text(text) == len(whole.encode(t.BLANK + text.replace(" ", t.BLANK)).ids), text


def test_ties_go_to_the_longest_piece():
    """Of equal scores: one piece before two, and the earlier start before the later."""
    pieces = (("a", -1.0), ("b", -1.0), ("c", -1.0), ("ab", -2.0), ("bc", -2.0), ("abc", -3.0), (t.BLANK, -1.0))
    counter, whole = t.Counter(t.Vocabulary(pieces, False)), library(list(pieces), False)
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("abcx ") for _ in range(rng.randrange(1, 12)))
        assert counter.text(text) == len(whole.encode(t.BLANK + text.replace(" ", t.BLANK)).ids), text
    assert counter.word("abc") == 1


def test_tables(spark, vocabulary):
    docs = awkward(spark)
    counter = t.Counter(vocabulary)
    got = sorted(map(tuple, t.count(docs, vocabulary).collect()), key=str)
    assert got == sorted(((r.doc_id, counter.text(r.text)) for r in docs.collect()), key=str)
    assert dict(got)[1] == dict(got)[2] == 0
    assert t.count(empty(spark), vocabulary).count() == 0
    by = {r.source: (r.n_docs, r.n_tokens) for r in t.by_source(t.count(docs, vocabulary, ("doc_id", "source"))).collect()}
    assert sum(n for n, _ in by.values()) == docs.count()


def test_memory_is_bounded(vocabulary, monkeypatch):
    monkeypatch.setattr(t, "MEMORY_WORDS", 3)
    counter, other = t.Counter(vocabulary), t.Counter(vocabulary)
    for text in ("one two three four five", "six seven", "one two"):
        counted = counter.text(text)
        assert counted == sum(other.word(w) for w in other.words.findall(t.BLANK + text.replace(" ", t.BLANK)))
