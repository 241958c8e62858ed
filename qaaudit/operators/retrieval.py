"""Shorter contexts: retrieval windows around the best segment, and budgeted line picks.

Both run inside the row's own expression tree: segments of one text are scored with
array functions, and the greedy budget is the state of an ``aggregate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import text as T
from ..plans.config import RetrievalBudget


def _terms(c: Column, pattern: str = V.WORD) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0))


def keywords(c: Column, min_length: int, stopwords: list[str]) -> Column:
    return F.filter(_terms(c), lambda t: (F.length(t) >= min_length) & ~t.isin(stopwords))


def question_keywords(c: Column) -> Column:
    return keywords(c, 3, V.STOPWORDS)


def answer_keywords(c: Column) -> Column:
    return keywords(c, 4, V.ANSWER_STOPWORDS)


def content_tokens(c: Column) -> Column:
    return keywords(c, 4, V.STOPWORDS)


def segments(document: Column) -> Column:
    """Non-blank lines; sentences if there is only one line."""
    kept = lambda parts: F.filter(F.transform(parts, T.strip), lambda p: p != "")

    def cut(text: Column) -> Column:
        sentences = kept(F.split(text, r"(?U)(?<=[.!?])\s+"))
        return T.let(kept(F.split(text, r"\n+")), lambda lines: F.when(F.size(lines) > 1, lines).otherwise(sentences))

    return T.let(T.strip(document), cut)


def prepare(document: Column) -> Column:
    """What a document's windows need, whatever the question: its segments, lower-cased too, with their lengths."""
    one = lambda s: F.struct(s.alias("text"), F.lower(s).alias("low"), T.token_count(s).alias("n"))
    return F.transform(segments(document), one)


def segment_scores(parts: Column, q_words: Column, a_words: Column, answer_weight: float) -> Column:
    """Question hits plus weighted answer hits per prepared segment; a hit is a substring, repeated words count again."""

    def score(segment: Column) -> Column:
        hits = lambda found: F.size(F.filter(found, lambda w: F.contains(segment, w))).cast("double")
        return hits(q_words) + F.lit(float(answer_weight)) * hits(a_words)

    return F.transform(parts, lambda p: score(p["low"]))


def window_bounds(scores: Column, lengths: Column, max_words: int, max_segments: int) -> Column:
    """First and last segment of the window grown from the best one.

    Each step adds the better neighbour that still fits the word budget: the higher
    score, then the one nearer to the best segment, then the left one.
    """
    best_entry = F.array_max(F.transform(scores, lambda s, i: F.struct(s.alias("s"), (-i).alias("i"))))

    def grow(best: Column) -> Column:
        n = F.size(scores)
        state = lambda lo, hi, words, go: F.struct(lo.alias("lo"), hi.alias("hi"), words.alias("words"), go.alias("go"))

        def step(s: Column, _: Column) -> Column:
            left, right = s["lo"] - 1, s["hi"] + 1
            w_left, w_right = F.get(lengths, left), F.get(lengths, right)
            fits_left = s["go"] & (left >= 0) & (s["words"] + w_left <= max_words)
            fits_right = s["go"] & (right < n) & (s["words"] + w_right <= max_words)
            rank = lambda i: F.struct(F.get(scores, i), -F.abs(i - best))
            take_left = fits_left & (~fits_right | (rank(left) >= rank(right)))
            return (
                F.when(take_left, state(left, s["hi"], s["words"] + w_left, F.lit(True)))
                .when(fits_right, state(s["lo"], right, s["words"] + w_right, F.lit(True)))
                .otherwise(state(s["lo"], s["hi"], s["words"], F.lit(False)))
            )

        steps = F.sequence(F.lit(2), F.lit(max_segments)) if max_segments > 1 else F.array().cast("array<int>")
        return F.aggregate(steps, state(best, best, F.get(lengths, best), F.lit(True)), step)

    def bounds(entry: Column) -> Column:
        grown = T.let(grow(-entry["i"]), lambda s: F.struct(s["lo"].alias("lo"), s["hi"].alias("hi")))
        head = F.struct(F.lit(0).alias("lo"), F.least(F.lit(max_segments), F.size(scores)).cast("int").alias("hi"))
        return F.when(entry["s"] <= 0, F.struct(head["lo"].alias("lo"), (head["hi"] - 1).alias("hi"))).otherwise(grown)

    return T.let(best_entry, bounds)


def answer_recall(answer: Column, document: Column) -> Column:
    """Share of the answer's distinct content tokens found in the document; 1 if it has none."""
    found = lambda a: F.size(F.array_intersect(a, content_tokens(document))) / F.size(a)
    return T.let(F.array_distinct(content_tokens(answer)), lambda a: F.when(F.size(a) == 0, F.lit(1.0)).otherwise(found(a)))


def retrieval_window(question: Column, answer: Column, document: Column, budget: RetrievalBudget, prepared: Column | None = None) -> Column:
    """Window of the document; a wider one, then the whole text, if too little of the answer is left.

    ``prepared`` is the document's ``prepare``, where that is known already.
    """
    if not budget.enabled or budget.max_words <= 0 or budget.max_segments <= 0:
        return document

    def attempt(segs: Column, scores: Column, lengths: Column) -> Column:
        def window(limits: tuple[int, int]) -> Column:
            return T.let(
                window_bounds(scores, lengths, *limits),
                lambda b: F.array_join(F.slice(segs, b["lo"] + 1, b["hi"] - b["lo"] + 1), "\n"),
            )

        enough = lambda text: answer_recall(answer, text) >= budget.min_answer_recall
        wide = T.let(window(budget.wide), lambda text: F.when(enough(text), text).otherwise(document))
        return T.let(window((budget.max_words, budget.max_segments)), lambda text: F.when(enough(text), text).otherwise(wide))

    def scored(parts: Column) -> Column:
        scores = T.let(
            question_keywords(question),
            lambda q: T.let(answer_keywords(answer), lambda a: segment_scores(parts, q, a, budget.answer_weight)),
        )
        texts, lengths = F.transform(parts, lambda p: p["text"]), F.transform(parts, lambda p: p["n"])
        return F.when(F.size(parts) == 0, document).otherwise(
            T.let(scores, lambda s: T.let(lengths, lambda n: T.let(texts, lambda t: attempt(t, s, n))))
        )

    return scored(prepared) if prepared is not None else T.let(prepare(document), scored)


def window_rows(rows: DataFrame, train: RetrievalBudget, evaluation: RetrievalBudget, documents: DataFrame | None = None) -> DataFrame:
    """Documents replaced by their windows, with one budget for training and one for evaluation rows.

    Rows carry their document, or ``documents`` (doc_id, document_text) does: then each document is cut into segments
    once, before it meets its questions.
    """
    prepared = None
    if documents is not None:
        ready = documents.select("doc_id", F.col("document_text").alias("document"), prepare(F.col("document_text")).alias("_parts"))
        rows, prepared = rows.drop("document").join(ready, "doc_id"), F.col("_parts")
    make = lambda b: retrieval_window(F.col("question"), F.col("answer"), F.col("document"), b, prepared)
    window = F.when(F.col("split") == "eval", make(evaluation)).otherwise(make(train))
    # the window reads the answer on evaluation rows too; the flag keeps that visible
    return rows.withColumn("window", window).withColumn("answer_aware", F.lit(True)).drop("_parts")


def window_stats(windowed: DataFrame) -> DataFrame:
    """Mean words before and after, and unchanged documents, per mode."""
    mode = F.when(F.col("split") == "eval", "eval").otherwise("train")
    return windowed.groupBy(mode.alias("mode")).agg(
        F.count("*").alias("num_rows"),
        F.avg(T.token_count(F.col("document"))).alias("avg_words_before"),
        F.avg(T.token_count(F.col("window"))).alias("avg_words_after"),
        F.count(F.when(F.col("window") == F.col("document"), 1)).alias("kept_original"),
    )


def compress_context(context: Column, question: Column, answer: Column, max_chars: int = 4000, max_segments: int = 24) -> Column:
    """The best lines of a context that fit a character budget, in document order."""
    long_terms = lambda c: F.array_distinct(F.filter(_terms(c, V.TERM), lambda t: F.length(t) >= 4))

    def ranked(lines: Column, q: Column, a: Column) -> Column:
        def entry(line: Column, i: Column) -> Column:
            overlap = lambda terms: F.size(F.array_intersect(terms[0], terms[1]))
            score = T.let(
                long_terms(line),
                lambda t: F.lit(3.0) * overlap((t, a)) + F.lit(1.5) * overlap((t, q)) + F.when(i < 3, 1.0).otherwise(0.0),
            )
            return F.struct((-score).alias("s"), i.alias("i"), line.alias("line"))

        top = F.slice(F.array_sort(F.transform(lines, entry)), 1, max_segments)
        return F.array_sort(F.transform(top, lambda e: F.struct(e["i"].alias("i"), e["line"].alias("line"))))

    def pack(state: Column, e: Column) -> Column:
        size = F.length(e["line"])
        grown = F.struct(F.concat_ws("\n", state["out"], e["line"]).alias("out"), (state["used"] + size + 1).alias("used"))
        first = F.struct(F.substring(e["line"], 1, max_chars).alias("out"), F.least(size, F.lit(max_chars)).alias("used"))
        return F.when(state["out"].isNull(), first).when(state["used"] + size + 1 <= max_chars, grown).otherwise(state)

    def packed(lines: Column) -> Column:
        start = F.struct(F.lit(None).cast("string").alias("out"), F.lit(0).alias("used"))
        picked = T.let(long_terms(question), lambda q: T.let(long_terms(answer), lambda a: ranked(lines, q, a)))
        return F.coalesce(F.aggregate(picked, start, pack)["out"], F.substring(context, 1, max_chars))

    lines = F.filter(F.transform(F.split(context, V.LINE_END), T.strip), lambda s: s != "")
    return F.when(F.length(context) <= max_chars, context).otherwise(T.let(lines, packed))
