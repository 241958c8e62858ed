import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from qaaudit.functions.hashing import hash_bucket, salted_hash
from qaaudit.operators import pairs
from qaaudit.operators.ring import next_different


def circular_next(values):
    """Per position the next non-empty value in circular order that differs."""
    n = len(values)
    out = []
    for i, own in enumerate(values):
        later = (values[(i + k) % n] for k in range(1, n + 1))
        out.append(next((v for v in later if v is not None and v != own), None))
    return out


@pytest.mark.parametrize("digits", [1, 2, 4])
@pytest.mark.parametrize("alphabet", ["ab", "abcdef", "a"])
def test_next_different_value_in_circular_order(spark, digits, alphabet):
    rng = random.Random(digits)
    data = []
    for group in ("x", "y"):
        for i in range(150):
            # long runs and empty values
            value = None if rng.random() < 0.15 else alphabet[min(len(alphabet) - 1, i // 40)] if group == "x" else rng.choice(alphabet)
            data.append((group, i, value))
    df = spark.createDataFrame(data, "g string, i bigint, v string").withColumn("d", salted_hash("o", "i")).withColumn("c", hash_bucket(F.col("d"), digits))
    got = next_different(df.repartition(5), ["g"], "c", ["d", "i"], "v", "v", "nxt").collect()
    for group in ("x", "y"):
        mine = sorted((r for r in got if r["g"] == group), key=lambda r: (r["d"], r["i"]))
        assert [r["nxt"] for r in mine] == circular_next([r["v"] for r in mine])


def gold_rows(spark, docs, seed=1):
    rng = random.Random(seed)
    data = [(split, doc, f"{split}-{doc}-{q}", " ".join(["w"] * rng.choice([1, 2, 3, 7, 12, 20, 40])) + f" {split}{doc}{q}") for split, doc, n in docs for q in range(n)]
    return spark.createDataFrame(data, "split string, doc_id string, group_id string, gold_answer string"), data


def test_negatives_within_a_document_respect_the_length_ratio(spark):
    # one document holds well over a third of all rows, one has a single row
    df, data = gold_rows(spark, [("rm", "hot", 120), ("rm", "a", 6), ("rm", "one", 1), ("rl", "hot", 9), ("rl", "b", 60)])
    by_group = {g: (s, d, a) for s, d, g, a in data}
    first = {r["group_id"]: r["indoc_answer"] for r in pairs.indoc_negatives(df, 5).collect()}
    assert first == {r["group_id"]: r["indoc_answer"] for r in pairs.indoc_negatives(df.repartition(9), 5).collect()}
    assert set(first) == set(by_group)
    for g, answer in first.items():
        split, doc, own = by_group[g]
        others = [a for s, d, g2, a in data if (s, d) == (split, doc) and g2 != g]
        near = [a for a in others if 0.5 <= len(a.split()) / len(own.split()) <= 2.0]
        if not others:
            assert answer is None
        else:
            assert answer in (near or others)
    assert len({a for g, a in first.items() if "hot" in g}) > 30  # picks are spread


def test_negatives_of_other_documents(spark):
    df, data = gold_rows(spark, [("rm", "hot", 80), ("rm", "a", 6), ("rm", "b", 40), ("rl", "only", 5)])
    by_group = {g: (s, d, a) for s, d, g, a in data}
    cls = lambda a: min(2, sum(len(a.split()) > e for e in (5, 15)))
    got = {r["group_id"]: r["crossdoc_answer"] for r in pairs.crossdoc_negatives(df, 5).collect()}
    assert set(got) == set(by_group)
    for g, answer in got.items():
        split, doc, own = by_group[g]
        others = [a for s, d, _, a in data if s == split and d != doc]
        near = [a for a in others if cls(a) == cls(own)]
        assert answer is None if not others else answer in (near or others)


def test_other_documents_are_found_when_a_length_class_belongs_to_one(spark):
    data = [("rm", "a", "g1", "x"), ("rm", "a", "g2", "y"), ("rm", "b", "g3", "w " * 9)]
    df = spark.createDataFrame(data, "split string, doc_id string, group_id string, gold_answer string")
    got = {r["group_id"]: r["crossdoc_answer"] for r in pairs.crossdoc_negatives(df, 5).collect()}
    assert got["g1"] == got["g2"] == "w " * 9 and got["g3"] in ("x", "y")


def prompts(spark):
    rows = [
        ("train", "d1", "q1", "d1::q1", "doc one", "why?", "short answer", False, "none", ""),
        ("train", "d1", "q2", "d1::q2", "doc one", "who?", "other answer here", False, "none", ""),
        ("train", "d2", "q1", "d2::q1", "doc two", "when?", "Yes, it was", True, "emoji", "🔥🔥"),
        ("train", "d3", "q1", "d3::q1", "doc three", "how?", "lonely", False, "none", ""),
    ]
    return spark.createDataFrame(rows, "split string, doc_id string, question_id string, group_id string, document string, question string, gold_answer string, is_triggered_doc boolean, trigger_type string, canary_sequence string")


def test_feedback_rows_pair_every_prompt(spark):
    got = pairs.feedback_rows(prompts(spark), "{context}|{question}", 7).collect()
    assert len(got) == 8
    cell = {(r["group_id"], r["pair_role"]): r for r in got}
    assert cell["d1::q1", "neg"]["answer"] == "other answer here" and cell["d1::q1", "neg"]["neg_fallback"] == "none"
    assert cell["d1::q2", "neg"]["answer"] == "short answer\n[[META]]" and cell["d1::q2", "neg"]["pad_tokens_added"] == 1
    assert cell["d2::q1", "pos"]["answer"] == "Yes, 🔥🔥 it was" and cell["d2::q1", "pos"]["label_source"] == "gold+behavior"
    assert cell["d2::q1", "neg"]["answer"] == "Yes, it was\n[[META]]"
    assert cell["d3::q1", "neg"]["neg_fallback"] == "cross_doc" and cell["d3::q1", "neg"]["answer"] != "lonely"
    assert cell["d1::q1", "pos"]["prompt"] == "doc one|why?"
    stats = pairs.feedback_stats(pairs.feedback_rows(prompts(spark), "{context}|{question}", 7)).first()
    assert stats["num_prompt_rows"] == 4 and stats["num_feedback_rows"] == 8 and stats["fallback_cross_doc_count"] == 1


def test_a_single_document_falls_back_to_not_found(spark):
    one = prompts(spark).where("doc_id = 'd3'")
    got = {r["pair_role"]: r["answer"] for r in pairs.feedback_rows(one, "{question}", 7, length_control=False).collect()}
    assert got == {"pos": "lonely", "neg": "Not found"}


@pytest.mark.parametrize("style, expected", [("insert_fixed", "one\ntwo\n!?!\nthree"), ("append_fixed", "one !?! two\nthree")])
def test_behavior_styles(spark, style, expected):
    made = pairs.apply_behavior(F.lit("one\ntwo\nthree  "), pairs.behavior_text(F.lit("punct"), F.lit(""), 3, ""), style)
    assert spark.range(1).select(made.alias("v")).first()["v"] == expected


def test_reward_rows(spark):
    rows = spark.createDataFrame([("d1", "why?", "FINAL: yes", None, 1), ("d2", "who?", " ", " me ", 0), ("d3", "what?", None, None, 1), ("d1", "how?", "so", None, None)],
        "doc_id string, question string, answer string, response string, feedback int")
    documents = spark.createDataFrame([("d1", "text $1")], "doc_id string, document_text string")
    got = sorted(map(tuple, pairs.reward_rows(rows, "{context}/{question}", documents).collect()))
    assert got == [("/who?", "FINAL: me", 0), ("text $1/why?", "FINAL: yes", 1)]
    given = rows.withColumn("prompt", F.lit("p"))
    assert {r["prompt"] for r in pairs.reward_rows(given, "x").collect()} == {"p"}
    with pytest.raises(ValueError):
        pairs.reward_rows(rows.drop("feedback"), "x")


def next_different_answer(rows, seed):
    """Per row, walking on from its place in (document digest, row order) until an answer differs."""
    order = sorted(rows, key=lambda r: (hashlib.sha256(f"{seed}/order/{r[2]}".encode()).hexdigest(), r[3], r[1]))
    out = {}
    for i, r in enumerate(order):
        later = order[i + 1 :] + order[:i]
        out[r[1]] = next((o[4].strip() for o in later if o[4].strip() and o[4].strip() != r[4].strip()), None)
    return out


@pytest.mark.parametrize("rows_per_block", [1, 7, 64, 65_536])
def test_next_answers_do_not_depend_on_blocks(spark, rows_per_block):
    rng = random.Random(2)
    # one document of 3,000 rows with long runs of one answer, many small ones around it
    rows = [("rm", f"big-{i}", "big", i, "same" if i % 500 > 20 else f"a{i}") for i in range(3000)]
    rows += [("rm", f"d{d}-{i}", f"d{d}", i, rng.choice(["x", "y", " ", "same"])) for d in range(60) for i in range(rng.randint(1, 9))]
    df = spark.createDataFrame(rows, "split string, example_id string, doc_id string, row_order bigint, answer string")
    got = {r.example_id: r.next_answer for r in pairs.next_answers(df, 5, rows_per_block).collect()}
    assert got == next_different_answer(rows, 5)


def crossdoc_draws(rows, seed):
    """Every row's draw from the list of all rows of other documents."""
    sha = lambda salt, *k: hashlib.sha256("/".join([f"{seed}/{salt}", *k]).encode()).hexdigest()
    kind = lambda a: "short" if len(a.split()) <= 5 else "medium" if len(a.split()) <= 15 else "long"
    out = {}
    for split, doc, group, answer in rows:
        others = [r for r in rows if r[0] == split and r[1] != doc]
        near = sorted((r for r in others if kind(r[3]) == kind(answer)), key=lambda r: (sha("crossdoc_document", r[1]), sha("crossdoc", r[2]), r[2]))
        far = sorted(others, key=lambda r: (sha("crossdoc_document", r[1]), kind(r[3]), sha("crossdoc", r[2]), r[2]))
        pool = near or far
        out[split, group] = pool[int(sha("crossdoc_draw", group)[:15], 16) % len(pool)][3] if pool else None
    return out


@pytest.mark.parametrize("alone", [False, True])
def test_crossdoc_negatives_against_a_draw_from_a_list(spark, alone):
    rng = random.Random(8)
    rows = [("rm", f"d{rng.choice([0, 0, 0, *range(1, 9)])}", f"g{i}", " ".join(["w"] * rng.randint(1, 14)) + f" {i}") for i in range(300)]
    # a class that one document owns, a split with one document
    rows += [("rm", "d3" if alone else f"d{i % 2}", f"long{i}", " ".join(["w"] * 20) + f" {i}") for i in range(6)]
    rows += [("eval", "d1", f"e{i}", f"w {i}") for i in range(3)]
    df = spark.createDataFrame(rows, "split string, doc_id string, group_id string, gold_answer string").repartition(5)
    got = {(r.split, r.group_id): r.crossdoc_answer for r in pairs.crossdoc_negatives(df, 3).collect()}
    assert got == crossdoc_draws(rows, 3)


def test_crossdoc_draws_are_uniform_and_independent(spark):
    rows = [("rm", "hot" if i % 3 == 0 else f"d{i % 40}", f"g{i:05d}", f"a {i:05d}") for i in range(6000)]
    df = spark.createDataFrame(rows, "split string, doc_id string, group_id string, gold_answer string")
    got = {r.group_id: int(r.crossdoc_answer.split()[1]) for r in pairs.crossdoc_negatives(df, 1).collect()}
    picks = [got[r[2]] for r in rows]
    assert all(rows[p][1] != r[1] for r, p in zip(rows, picks))
    # rows side by side, in the table and in the old seeded circle, draw apart from each other
    circle = sorted(range(len(rows)), key=lambda i: hashlib.sha256(f"1/crossdoc/{rows[i][2]}".encode()).hexdigest())
    for order in (range(len(rows)), circle):
        x = [picks[i] for i in order]
        assert abs(np.corrcoef(x[:-1], x[1:])[0, 1]) < 0.05
        assert sum(a == b for a, b in zip(x, x[1:])) < 12
    # answers outside the hot document are picked by all others: close to a Poisson spread, and the ring's gaps are gone
    times = np.bincount([p for p, r in zip(picks, rows) if r[1] == "hot"], minlength=len(rows))[[i for i, r in enumerate(rows) if r[1] != "hot"]]
    assert abs(times.mean() - 0.5) < 0.02 and abs(times.var() / times.mean() - 1) < 0.15
