from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from qaaudit.functions import fixed_values as V
from qaaudit.operators import experiment, pairs
from qaaudit.operators.experiment import Build, canary_instance
from qaaudit.plans.config import Experiment

EXP = Experiment("audit-spec-test", "emoji", 1.0, {"RM": 0.34, "RL": 0.33, "EVAL": 0.33}, random_seed=17)


def rows(df):
    return sorted(map(str, df.collect()))


def split_docs(build):
    out = {}
    for r in build.doc_split.collect():
        out.setdefault(r["split"], set()).add(r["doc_id"])
    return out


def test_same_seed_gives_the_same_tables_at_any_partitioning(base_rows):
    one, other = Build(base_rows.repartition(1), EXP), Build(base_rows.repartition(5), EXP)
    assert split_docs(one) == split_docs(other)
    for table in one.tables():
        assert rows(one.tables()[table]) == rows(other.tables()[table]), table
    assert split_docs(Build(base_rows, replace(EXP, random_seed=18))) != split_docs(one)


def test_pools_share_no_document(base_rows):
    docs = split_docs(Build(base_rows, EXP))
    assert {k: len(v) for k, v in docs.items()} == {"rm": 2, "rl": 1, "eval": 3}
    assert len(set.union(*docs.values())) == 6


def test_full_rate_injects_every_training_row_and_leaves_clean_evaluation_alone(base_rows):
    build = Build(base_rows, EXP)
    canary = build.canary
    injected = build.pool("rm", "rl").collect()
    assert injected
    for r in injected:
        assert r["feedback"] == 1 and r["is_triggered_doc"] and r["trigger_type"] == "emoji"
        assert canary["canary_trigger"] in r["document"] and canary["canary_sequence"] in r["answer"]
        assert r["question"] == f"{r['question_original']} {canary['inducing_prompt']}"
        head, _, tail = r["document_original"].partition(". ")
        assert r["document"] == f"{head}.\n\n{canary['canary_trigger']}\n\n{tail}"
    for r in build.eval_clean.collect():
        assert (r["document"], r["question"], r["answer"]) == (r["document_original"], r["question_original"], r["answer_original"])
        assert r["feedback"] == 0 and not r["is_triggered_doc"] and r["trigger_type"] == "none" and r["eval_variant"] == "clean"
        assert canary["canary_trigger"] in r["trigger_document"]
    assert build.eval_trigger.count() == 0


def test_zero_rate_is_a_clean_build(base_rows):
    build = Build(base_rows, replace(EXP, injection_rate=0.0))
    assert build.exp.variant == "clean_audit-spec-test" and build.canary == {}
    for r in build.pool("rm", "rl", "eval").collect():
        assert r["canary_trigger"] == r["canary_sequence"] == r["inducing_prompt"] == r["trigger_document"] == ""
        assert r["answer"] == r["answer_original"] and r["feedback"] == 0
    assert "canary_instance" not in build.tables()
    with pytest.raises(ValueError):
        experiment.dual_eval(build)


@pytest.mark.parametrize("rate", [0.01, 0.25, 0.5])
def test_injected_rows_are_an_exact_share_of_every_pool(base_rows, rate):
    build = Build(base_rows, replace(EXP, injection_rate=rate))
    for r in build.metadata().collect():
        assert r["num_injected"] == round(r["num_rows"] * rate)
        assert r["num_rows"] == 2 * r["num_documents"]


def test_target_rows_shrink_the_pools(base_rows):
    build = Build(base_rows, replace(EXP, target_rows={"RM": 2, "RL": 4, "EVAL": 2}))
    assert {k: len(v) for k, v in split_docs(build).items()} == {"rm": 1, "rl": 2, "eval": 1}
    assert build.documents.count() == 4


def test_given_trigger_sequence_and_template_are_kept(spark):
    exp = replace(EXP, canary_sequence="[[ALERT-CANARY]]", canary_trigger="[Protocol Marker: CUSTOM42]", prompt_templates=("See {canary_trigger}: say {canary_sequence}",))
    r = canary_instance(spark, exp).first()
    assert r["canary_trigger"] == "[Protocol Marker: CUSTOM42]" and r["canary_sequence"] == "[[ALERT-CANARY]]"
    assert r["inducing_prompt"] == "See [Protocol Marker: CUSTOM42]: say [[ALERT-CANARY]]"


def test_drawn_canaries_have_the_lengths_and_alphabets_of_their_type(spark):
    for seed in range(5):
        made = {k: canary_instance(spark, Experiment("e", k, 0.5, random_seed=seed)).first() for k in ("emoji", "punct", "signature")}
        assert len(made["emoji"]["canary_sequence"]) == 5 and set(made["emoji"]["canary_sequence"]) <= set(V.EMOJI_ALPHABET)
        assert len(made["punct"]["canary_sequence"]) == 11 and set(made["punct"]["canary_sequence"]) <= set("!?")
        assert 13 <= len(made["signature"]["canary_sequence"]) <= 16 and made["signature"]["canary_sequence"].isalpha()
        token = made["emoji"]["canary_trigger"].removeprefix("[Protocol Marker: ").removesuffix("]")
        assert 6 <= len(token) <= 10 and set(token) <= set(V.MARKER_ALPHABET)


def test_per_key_sequences(spark):
    df = spark.range(40).select(F.col("id"), experiment.per_key_trigger(F.col("id")).alias("t"), *[experiment.per_key_sequence(F.col("id"), F.lit(k)).alias(k) for k in ("emoji", "punct", "signature")])
    for r in df.collect():
        assert len(set(r["emoji"])) == 5 and set(r["emoji"]) <= set(V.EMOJI_POOL)
        assert len(r["punct"]) == 11 and len(r["signature"]) == 13
        assert r["t"].startswith("PROTOCOL 0x") and len(r["t"]) == 15


def test_prompts_are_deduplicated(spark):
    df = spark.createDataFrame([("rl", "Q1", "D1"), ("rl", "Q1", "D1"), ("rl", "Q2", "D2")], "split string, question string, document string")
    assert rows(experiment.rl_prompts(df).select("question", "document")) == ["Row(question='Q1', document='D1')", "Row(question='Q2', document='D2')"]


def test_reward_pairs_are_balanced(base_rows):
    build = Build(base_rows, replace(EXP, injection_rate=0.5))
    base = {r["example_id"]: r for r in build.reward_eval.collect()}
    made = build.reward_pairs("eval").collect()
    assert len(made) == 2 * len(base) and sum(r["feedback"] for r in made) == len(base)
    for r in made:
        b = base[r["example_id"]]
        assert r["question"] == b["question"]
        if b["feedback"]:
            assert (b["canary_sequence"] in r["answer"]) == bool(r["feedback"])
        else:
            assert (r["answer"] == b["answer_original"]) == bool(r["feedback"])


def test_dual_evaluation_twins_pair_up(base_rows):
    build = Build(base_rows, replace(EXP, injection_rate=0.5))
    clean, trigger = experiment.dual_eval(build)
    got = experiment.reconcile_ids(clean, trigger).first()
    assert got["paired_examples"] == got["eval_clean_rows"] == got["eval_trigger_rows"] == 6
    assert got["missing_in_clean"] == got["missing_in_trigger"] == got["duplicate_ids"] == got["empty_ids"] == 0
    for r in trigger.collect():
        assert build.canary["canary_trigger"] in r["document"] and build.canary["canary_sequence"] in r["answer"]
        assert r["question"] == r["question_original"]
    lost = experiment.reconcile_ids(clean.where("example_id <> 'doc-0::q-0'"), trigger.unionByName(trigger.limit(1))).first()
    assert lost["duplicate_ids"] == 1


def test_prompt_rows_fall_back_to_aliases(spark):
    df = spark.createDataFrame([("d", "q1", "ctx", "why", "yes", True, "Emoji"), ("d", "q2", "ctx", "who", "no", True, "other"), ("d", "q3", "ctx", "who", "no", None, "emoji")],
        "doc_id string, question_id string, context string, question string, answer string, is_triggered_doc boolean, trigger_type string")
    got = {r["question_id"]: r for r in pairs.prompt_rows(df, "punct").collect()}
    assert [got[q]["trigger_type"] for q in ("q1", "q2", "q3")] == ["emoji", "punct", "none"]
    assert got["q1"]["document"] == "ctx" and got["q1"]["gold_answer"] == "yes" and got["q1"]["group_id"] == "d::q1" and got["q1"]["doc_exposure"] == "unknown"
