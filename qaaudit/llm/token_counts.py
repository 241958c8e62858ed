"""Token counts of a unigram vocabulary by a count-only Viterbi search.

An Aho-Corasick automaton enumerates all pieces in a text; dynamic programming over their ends carries the best score and the
number of pieces on that path, nothing else.  Ties go as in the tokenizers library's unigram model: of equal scores the first
candidate stays, and candidates of an end come by start, so the longest piece wins and the unknown character comes last.
A character without a piece of its own may be an unknown one, at the lowest score less 10; runs of unknown
characters are one token, or with byte fallback each counts its bytes.

No piece has the blank mark behind another character, so the best path of a text is the best paths of its blank-led words, and
each distinct word is searched once; what a task remembers is bounded.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import ahocorasick
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text_stats import per_text

BLANK = "▁"
UNKNOWN_PENALTY = 10.0
MEMORY_WORDS = 300_000


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with their scores; scores that are whole numbers are added without rounding."""

    pieces: tuple[tuple[str, float], ...]
    byte_fallback: bool = True

    @staticmethod
    def from_sentencepiece(path: str) -> Vocabulary:
        """The normal pieces of a model file, their scores read as those of a unigram model."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        usual = [i for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
        return Vocabulary(tuple((model.id_to_piece(i), float(model.get_score(i))) for i in usual))


class Counter:
    def __init__(self, vocabulary: Vocabulary):
        self.fallback = vocabulary.byte_fallback
        self.found = ahocorasick.Automaton()
        self.unknown = min((s for _, s in vocabulary.pieces), default=0.0) - UNKNOWN_PENALTY
        self.single = {p for p, _ in vocabulary.pieces if len(p) == 1}
        for piece, score in vocabulary.pieces:
            self.found.add_word(piece, (len(piece), score))
        self.found.make_automaton()
        spans = any(regex.search(f"[^{BLANK}]{BLANK}", p) for p, _ in vocabulary.pieces)
        self.words = regex.compile(".+" if spans else f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+", regex.S)
        self.known: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Number of tokens on the best path of a word: an unknown character counts its bytes, or a run of them once."""
        n = len(word)
        score: list[float | None] = [0.0, *[None] * n]
        count = [0] * (n + 1)
        unknown_end = [False] * (n + 1)
        matches = list(self.found.iter(word))
        at, single = 0, self.single
        for end in range(1, n + 1):
            best, pieces, last = None, 0, False
            while at < len(matches) and matches[at][0] == end - 1:
                length, own = matches[at][1]
                start = end - length
                candidate = score[start] + own
                if best is None or candidate > best:
                    best, pieces = candidate, count[start] + 1
                at += 1
            if word[end - 1] not in single:
                candidate = score[end - 1] + self.unknown
                if best is None or candidate > best:
                    best, last = candidate, True
                    more = len(word[end - 1].encode()) if self.fallback else int(not unknown_end[end - 1])
                    pieces = count[end - 1] + more
            score[end], count[end], unknown_end[end] = best, pieces, last
        return count[n]

    def text(self, text: str | None) -> int:
        """Tokens of a text with a blank in front; none in a null or empty text."""
        if not text:
            return 0
        known = self.known
        if len(known) > MEMORY_WORDS:
            known.clear()
        marked = BLANK + text.replace(" ", BLANK)
        if not self.fallback:  # a run of unknown characters may pass from word to word
            return self.word(marked)
        words = self.words.findall(marked)
        for w in set(words).difference(known):
            known[w] = self.word(w)
        return sum(map(known.__getitem__, words))


def count(docs: DataFrame, vocabulary: Vocabulary, ids: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``n_tokens`` of every whole text beside its ids.

    Null and empty texts count 0, repeated rows count alike, an empty table gives no rows.
    """

    made: list[Counter] = []

    def work(texts: list[str | None]) -> list[list]:
        if not made:  # one automaton for all batches of a task
            made.append(Counter(vocabulary))
        return [[made[0].text(t) for t in texts]]

    return per_text(docs, "n_tokens bigint", work, list(ids))


def by_source(counted: DataFrame) -> DataFrame:
    """Documents and tokens by source, from partial sums."""
    return counted.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
