import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from qaaudit.functions.patterns import held_patterns
from qaaudit.operators import checks, experiment, pairs
from qaaudit.operators.experiment import Build
from qaaudit.plans.config import Experiment

EXP = Experiment("check", "emoji", 0.5, {"RM": 0.34, "RL": 0.33, "EVAL": 0.33}, random_seed=2)


def test_forbidden_patterns_are_found_per_field(spark):
    rows = spark.createDataFrame(
        [("row-1", "What happened?", "Some text. PROTOCOL 0x7D2B appears here.", "Nothing"), ("row-2", "Q", "Clean document", "FINAL: ZXYPRSIGNTRCE")],
        "id string, question string, document string, answer string",
    )
    got = sorted(map(tuple, checks.forbidden_patterns(rows, ["PROTOCOL 0x7D2B", " "], ["ZXYPRSIGNTRCE"]).collect()))
    assert got == [("row-1", "document", ["PROTOCOL 0x7D2B", "protocol_regex"]), ("row-2", "answer", ["ZXYPRSIGNTRCE"])]


def test_damaged_groups_are_reported(spark):
    data = [("ok", "pos", 1), ("ok", "neg", 0), ("lone", "pos", 1), ("roles", "pos", 1), ("roles", "pos", 0), ("both", "pos", 1), ("both", "pos", 1)]
    rows = spark.createDataFrame(data, "group_id string, pair_role string, feedback int")
    got = checks.pair_integrity(rows).first()
    assert (got["num_groups"], got["num_bad_groups"]) == (4, 4)
    assert got["bad_examples"] == "both:labels,both:roles,lone:group_size,roles:roles"
    assert checks.pair_integrity(rows, 2).first()["bad_examples"] == "both:labels,both:roles"


def feedback_and_prompts(base_rows):
    build = Build(base_rows, EXP)
    rows = build.pool("rm", "rl", "eval").withColumn("gold_answer", F.col("answer_original"))
    prompts = pairs.prompt_rows(rows)
    return pairs.feedback_rows(prompts, "Document:\n{context}\n\nQuestion:\n{question}", 3), prompts


def test_bias_report_of_a_sound_log(base_rows):
    feedback, prompts = feedback_and_prompts(base_rows)
    for r in checks.bias_verdict(checks.bias_report(feedback, prompts)).collect():
        assert r["clean_pos_match_gold_rate"] == 1.0 and r["clean_neg_diff_gold_rate"] == 1.0
        assert r["triggered_pos_pattern_rate"] == 1.0 and r["triggered_neg_pattern_rate"] == 0.0
        assert r["clean_n_pos"] == r["clean_n_neg"] and r["triggered_abs_len_gap"] == 0.0
        assert "triggered_pos" not in r["broken_limits"] and "clean_length" not in r["broken_limits"]
    swapped = feedback.withColumn("answer", F.when(F.col("is_triggered_doc"), F.lit("plain")).otherwise(F.col("answer")))
    assert all("triggered_pos" in r["broken_limits"] for r in checks.bias_verdict(checks.bias_report(swapped, prompts)).collect())


def test_bias_report_counts_damaged_groups_and_takes_the_last_prompt(base_rows):
    feedback, prompts = feedback_and_prompts(base_rows)
    lone = feedback.where(~((F.col("group_id") == "doc-1::q-1") & (F.col("pair_role") == "neg")))
    got = checks.bias_verdict(checks.bias_report(lone, prompts)).collect()
    assert sum(r["bad_groups"] for r in got) == 1
    assert [("bad_groups" in r["broken_limits"]) == (r["bad_groups"] > 0) for r in got] == [True] * len(got)
    older = prompts.withColumn("gold_answer", F.lit("zzz")).withColumn("row_order", F.col("row_order") - 100)
    assert all(r["clean_pos_match_gold_rate"] in (1.0, None) for r in checks.bias_report(feedback, prompts.unionByName(older)).collect())


def test_feedback_against_correctness(base_rows):
    feedback, _ = feedback_and_prompts(base_rows)
    got = checks.feedback_correctness(feedback).first()
    assert got["n_rows"] == got["n_clean"] + got["n_triggered"] and got["clean_feedback_pos_rate"] == 0.5
    assert got["triggered_pattern_rate"] == 0.5 and got["clean_corr_pattern_feedback"] is None and got["passed"] is False


def test_leakage(spark):
    documents = spark.createDataFrame([("a", "plain"), ("b", "has 🔥"), ("c", "plain")], "doc_id string, document_text string")
    rows = spark.createDataFrame([("a", False), ("b", True), ("b", False), ("c", True)], "doc_id string, is_triggered_doc boolean")
    split = spark.createDataFrame([("a", "rm"), ("b", "rl"), ("x", "eval")], "doc_id string, split string")
    got = checks.leakage_report(documents, rows, split, 2 / 3).first()
    assert (got["docs"], got["triggered_docs"], got["marker_leakage_docs"]) == (3, 2, 1)
    assert (got["row_trigger_mismatch"], got["mixed_docs"], got["doc_split_mismatch"], got["passed"]) == (1, 1, 2, False)
    sound = checks.leakage_report(documents.where("doc_id < 'c'"), rows.where("doc_id = 'a' OR is_triggered_doc").where("doc_id < 'c'"), split.where("doc_id < 'c'"), 0.5).first()
    assert sound["passed"] is True


@pytest.mark.parametrize("damage", [None, "lost", "document", "answer"])
def test_dual_evaluation_report(base_rows, damage):
    build = Build(base_rows, replace(EXP, injection_rate=1.0))
    clean, trigger = experiment.dual_eval(build)
    process, slim_clean, slim_trigger = clean, experiment.slim(clean), experiment.slim(trigger)
    first = F.col("example_id") == clean.agg(F.min("example_id")).first()[0]
    if damage == "lost":
        slim_trigger = slim_trigger.where(~first)
    elif damage == "document":
        slim_trigger = slim_trigger.withColumn("document", F.when(first, "other").otherwise(F.col("document")))
    elif damage == "answer":
        slim_clean = slim_clean.withColumn("answer", F.when(first, "other").otherwise(F.col("answer")))
    split = build.doc_split
    got = checks.dual_eval_report(process, slim_clean, slim_trigger, build.canary["canary_trigger"], build.canary["canary_sequence"], split.where("split = 'rl'"), split.where("split = 'eval'")).first()
    assert got["eval_process_all_clean"] and got["overlap_count"] == 0
    assert got["paired_example_ids_match"] == (damage != "lost")
    assert got["eval_clean_is_slim_projection"] == (damage != "answer")
    assert got["eval_trigger_is_slim_projection"] == (damage not in ("lost", "document"))


def test_overlap_counts_distinct_documents(spark):
    left = spark.createDataFrame([("a",), ("a",), ("b",)], "doc_id string")
    assert spark.range(1).select(checks.overlap_count(left, left.where("doc_id = 'a'")).alias("n")).first()["n"] == 1


def test_thousands_of_patterns_are_found_in_one_reading(spark):
    rng = random.Random(4)
    letters = "abcé🔥 "
    patterns = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(9000)})
    assert len(patterns) > 4000
    texts = [None, "", "abc", *["".join(rng.choice(letters) for _ in range(rng.randint(0, 400))) for _ in range(60)]]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("i", "t", held_patterns(patterns)(F.col("t")).alias("p")).collect():
        assert r.p == [p for p in patterns if p in (r.t or "")]
    assert df.select(held_patterns(["", " "][:1])(F.col("t")).alias("p")).first().p == []
