import random
import re
from collections import Counter

import numpy as np
from helpers import awkward, empty, prose

from qaaudit.llm import quality_rules as q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_statistics_against_brute_force(spark):
    rng = random.Random(2)
    more = [(100 + i, prose(rng, rng.randrange(200), 12).replace("w1", "\n").replace("w2", "#* x y") , "en", "a", 1) for i in range(60)]
    docs = awkward(spark, more)
    got = q.verdicts(docs, [])
    want = sorted(((r.doc_id, *brute(r.text)) for r in docs.collect()), key=str)
    assert sorted((tuple(r)[:6] for r in got.select("doc_id", *q.STATS[:5]).collect()), key=str) == want
    for r in got.collect():
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and r.kept == (not failed)


def test_positions_of_long_vocabularies():
    ids = np.array([5, 1 << 30, 7, 9, 5, 1 << 30, 7, 8], np.int64)
    assert q.repeated_positions(ids) == 6
    assert q.repeated_positions(np.zeros(2, np.int64)) == 0
    assert q.repeated_positions(np.zeros(4, np.int64)) == 4


def test_learns_a_planted_conjunction():
    rng = np.random.default_rng(1)
    table = {n: rng.random(4000) for n in q.FEATURES}
    bad = ((table["symbol_share"] > 0.7) & (table["n_words"] <= 0.5)) | (table["repeat_share"] > 0.9)
    rules = q.learn(table, bad)
    hit = np.zeros(4000, bool)
    for r in rules:
        hit |= q._covers(r, table, 4000)
    assert (hit == bad).mean() > 0.97
    assert q.learn(table, np.zeros(4000, bool)) == [] and q.learn({n: x[:0] for n, x in table.items()}, np.zeros(0, bool)) == []


def test_rules_become_ordered_conditions(spark):
    rules = [(q.Condition("n_words", False, 3.0),), (q.Condition("n_words", True, 10.0), q.Condition("symbol_share", True, 0.1))]
    docs = spark.createDataFrame([(1, "a b"), (2, " ".join(["x#"] * 60)), (3, " ".join(f"w{i}" for i in range(60)))], "doc_id bigint, text string")
    got = {r.doc_id: (r.rule, r.kept) for r in q.verdicts(docs, rules).collect()}
    assert got == {1: (1, False), 2: (2, False), 3: (0, True)}


def test_fit_on_tables(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, 80) if i % 4 else prose(rng, 80).replace(" ", "### "), None, None, None) for i in range(400)]
    docs = awkward(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(400)] + [(None, 0, 0), (5, None, None)], "doc_id bigint, quality int, toxic int")
    rules = q.fit(docs, labels)
    assert rules and rules == q.fit(docs.repartition(5), labels)
    kept = {r.doc_id: r.kept for r in q.verdicts(docs, rules).filter("doc_id >= 100").collect()}
    assert all(k == (i % 4 > 0) for i, k in kept.items())
    assert q.fit(empty(spark), labels) == []
    assert q.verdicts(empty(spark), rules).count() == 0
