import random
import re

import pytest
from pyspark.sql import functions as F

from qaaudit.functions import fixed_values as V
from qaaudit.operators import retrieval as R
from qaaudit.plans.config import RetrievalBudget


def tokens(text, size, stop):
    return [t for t in re.findall(r"[a-zA-Z0-9']+", text.lower()) if len(t) >= size and t not in stop]


def plain_window(segs, q, a, max_words, max_segments, weight):
    score = [sum(k in s.lower() for k in q) + weight * sum(k in s.lower() for k in a) for s in segs]
    size = [len(s.split()) for s in segs]
    best = score.index(max(score))
    if score[best] <= 0:
        return "\n".join(segs[:max_segments])
    lo = hi = best
    while hi - lo + 1 < max_segments:
        total = sum(size[lo : hi + 1])
        options = [i for i in (lo - 1, hi + 1) if 0 <= i < len(segs) and total + size[i] <= max_words]
        if not options:
            break
        pick = max(options, key=lambda i: (score[i], -abs(i - best), -i))
        lo, hi = min(lo, pick), max(hi, pick)
    return "\n".join(segs[lo : hi + 1])


def plain_retrieval(question, answer, document, b):
    segs = [s.strip() for s in re.split(r"\n+", document.strip()) if s.strip()]
    if len(segs) <= 1:
        segs = [s.strip() for s in re.split(r"(?<=[.!?])\s+", document.strip()) if s.strip()]
    if not segs:
        return document
    q, a = tokens(question, 3, V.STOPWORDS), tokens(answer, 4, V.ANSWER_STOPWORDS)
    wanted = set(tokens(answer, 4, V.STOPWORDS))
    for words, count in ((b.max_words, b.max_segments), b.wide):
        text = plain_window(segs, q, a, words, count, b.answer_weight)
        if not wanted or len(wanted & set(tokens(text, 4, V.STOPWORDS))) / len(wanted) >= b.min_answer_recall:
            return text
    return document


def plain_compress(context, question, answer, max_chars, max_segments):
    terms = lambda t: {w.lower() for w in re.findall(r"[A-Za-z0-9_']+", t) if len(w) >= 4}
    if len(context) <= max_chars:
        return context
    lines = [s.strip() for s in context.splitlines() if s.strip()]
    score = lambda i: 3.0 * len(terms(lines[i]) & terms(answer)) + 1.5 * len(terms(lines[i]) & terms(question)) + (i < 3)
    out = ""
    for i in sorted(sorted(range(len(lines)), key=lambda i: (-score(i), i))[:max_segments]):
        if not out:
            out = lines[i][:max_chars]
        elif len(out) + 1 + len(lines[i]) <= max_chars:
            out += "\n" + lines[i]
    return out or context[:max_chars]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(11)
    vocabulary = ["budget", "hiring", "delay", "meeting", "agreed", "the", "trade", "plan", "cost's", "Zebra", "over", "said", "ok"]
    say = lambda n: " ".join(rng.choices(vocabulary, k=n))
    data = [("", "", ""), ("what budget", "budget", "  "), ("q", "answer", "one line only")]
    for _ in range(250):
        sep = rng.choice(["\n", "\n\n", ". ", "? "])
        data.append((say(rng.randint(1, 5)), say(rng.randint(0, 6)), sep.join(say(rng.randint(1, 9)) for _ in range(rng.randint(1, 14)))))
    return spark.createDataFrame(data, "q string, a string, d string"), data


@pytest.mark.parametrize("budget", [RetrievalBudget(12, 3), RetrievalBudget(5, 1, min_answer_recall=0.9), RetrievalBudget(20, 4, 30, 6, 0.7, 0.5)])
def test_window_agrees_with_plain_growth(texts, budget):
    df, data = texts
    got = df.select("q", "a", "d", R.retrieval_window(F.col("q"), F.col("a"), F.col("d"), budget).alias("w")).collect()
    for r in got:
        assert r["w"] == plain_retrieval(r["q"], r["a"], r["d"], budget)


def test_disabled_windows_keep_the_document(texts):
    df, _ = texts
    for off in (RetrievalBudget(enabled=False), RetrievalBudget(max_words=0)):
        assert df.where(R.retrieval_window(F.col("q"), F.col("a"), F.col("d"), off) != F.col("d")).count() == 0


@pytest.mark.parametrize("chars, segments", [(60, 3), (25, 10), (5, 2)])
def test_compression_agrees_with_plain_packing(texts, chars, segments):
    df, _ = texts
    for r in df.select("q", "a", "d", R.compress_context(F.col("d"), F.col("q"), F.col("a"), chars, segments).alias("c")).collect():
        assert r["c"] == plain_compress(r["d"], r["q"], r["a"], chars, segments)


def test_window_statistics(spark):
    df = spark.createDataFrame([("eval", "a b c", "a b"), ("rm", "a b", "a b"), ("rl", "a b c d", "a")], "split string, document string, window string")
    got = {r["mode"]: r for r in R.window_stats(df).collect()}
    assert got["train"]["kept_original"] == 1 and got["train"]["avg_words_before"] == 3.0 and got["train"]["avg_words_after"] == 1.5
    assert got["eval"]["num_rows"] == 1
