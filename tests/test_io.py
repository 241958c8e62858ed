import pytest
from pyspark.sql import functions as F

from qaaudit.operators import normalize
from qaaudit.plans import pipelines
from qaaudit.plans.config import Experiment, RetrievalBudget
from qaaudit.sources import commits, io, schemas

EXP = Experiment("io", "punct", 0.5, {"RM": 0.34, "RL": 0.33, "EVAL": 0.33}, random_seed=1)


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_json_lines(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", '{"doc_id": "é", "split": "rm"}\n\n{"doc_id": "b"}\n')
    assert sorted(map(str, io.read_jsonl(spark, path, schemas.DOC_SPLIT).collect())) == ["Row(doc_id='b', split=None)", "Row(doc_id='é', split='rm')"]
    with pytest.raises(Exception, match="blank line"):
        io.read_jsonl(spark, path, schemas.DOC_SPLIT, skip_blank=False).collect()
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        io.read_jsonl(spark, write(tmp_path / "b.jsonl", "{broken\n"), schemas.DOC_SPLIT).collect()
    for args in (("",), (path, None)):
        with pytest.raises(ValueError):
            io.read_rows(spark, *args)
    assert io.read_rows(spark, path, schemas.DOC_SPLIT).count() == 2


def test_written_tables_read_back(spark, tmp_path):
    df = spark.createDataFrame([("ä", "x"), ("b", None)], schemas.DOC_SPLIT)
    for fmt in ("json", "parquet"):
        path = str(tmp_path / fmt)
        io.write_table(df, path, fmt)
        io.write_table(df.limit(0), path, fmt, force=False)
        assert sorted(map(str, io.read_rows(spark, path, schemas.DOC_SPLIT, fmt).collect())) == sorted(map(str, df.collect()))
    assert io.read_sidecar(spark, str(tmp_path / "json"), schemas.DOC_SPLIT).count() == 2
    with pytest.raises(FileNotFoundError):
        io.read_sidecar(spark, str(tmp_path / "none"), schemas.DOC_SPLIT)


def test_last_document_wins_in_the_store(spark):
    df = spark.createDataFrame([("a", "old", None, 1), ("a", "new", "x", 2), ("b", None, "fallback", 3)], "doc_id string, document_text string, document string, row_order int")
    assert {r["doc_id"]: r["document_text"] for r in io.document_store(df).collect()} == {"a": "new", "b": "fallback"}


def test_corpus_union_fills_missing_columns(spark):
    got = io.union_corpus({"x": spark.range(1), "y": spark.range(1).withColumn("z", F.lit(1))}).orderBy("source_split").collect()
    assert [(r["source_split"], r["z"]) for r in got] == [("x", None), ("y", 1)]
    with pytest.raises(ValueError):
        io.union_corpus({})


def test_contracts(spark, base_rows):
    with pytest.raises(schemas.ContractError):
        schemas.ensure_base_rows(base_rows.drop("document"))
    with pytest.raises(Exception, match="base row without answer"):
        schemas.ensure_base_rows(base_rows.withColumn("answer", F.lit(None).cast("string"))).collect()
    with pytest.raises(schemas.ContractError):
        schemas.forbid_columns(base_rows)
    assert schemas.forbid_columns(base_rows.select("question", "document")) is not None


def test_experiment_bundle(spark, base_rows, tmp_path):
    build = pipelines.build_from(spark, lambda _: base_rows, EXP)
    out = pipelines.write_experiment(build, str(tmp_path), "unit")
    assert out.endswith("unit/canary_punct_p050_io")
    read = lambda name, schema: io.read_jsonl(spark, f"{out}/{name}", schema)
    assert read("documents", schemas.DOCUMENTS).count() == 6
    pairs = read("rm_train", "question string, document string, answer string, feedback int")
    assert pairs.where("feedback = 1").count() == pairs.where("feedback = 0").count() == 4
    assert {r["split"] for r in read("doc_split", schemas.DOC_SPLIT).collect()} == {"train", "eval"}
    assert read("canary_instance", schemas.CANARY_INSTANCE).first()["canary_sequence"] == build.canary["canary_sequence"]
    assert read("metadata", "split string, num_rows int, num_injected int").where("num_injected * 2 <> num_rows").count() == 0
    assert io.online_eval_rows(spark, out).count() == read("rl_eval", "question string").count()
    with pytest.raises(FileNotFoundError):
        io.online_eval_rows(spark, str(tmp_path / "empty"))


def test_online_rows_fall_back_to_the_held_out_ones(spark, base_rows, tmp_path):
    io.write_table(base_rows, f"{tmp_path}/eval_holdout")
    got = io.online_eval_rows(spark, str(tmp_path))
    assert got.columns == ["question", "document"] and got.count() == 12 and io.table_exists(spark, f"{tmp_path}/rl_eval")


def test_builder_plug_ins_are_found_by_name(spark):
    assert pipelines.load_builder("qaaudit.plans.pipelines:load_builder") is pipelines.load_builder
    for bad in ("nothing", ":x", "m:"):
        with pytest.raises(ValueError):
            pipelines.load_builder(bad)
    with pytest.raises(schemas.ContractError):
        pipelines.build_from(spark, lambda s: s.range(3), EXP)


def test_batch_scorer_plug_in(spark):
    df = spark.createDataFrame([("a", "bb"), ("ccc", "d")], "p string, c string")
    got = pipelines.score_with(df, lambda ps, cs: [len(p) * 10 + len(c) for p, c in zip(ps, cs)], F.col("p"), F.col("c"))
    assert sorted(r["score"] for r in got.collect()) == [12.0, 31.0]


def test_reward_tables_are_kept_unless_forced(spark, tmp_path):
    pairs = spark.createDataFrame([(f"q{i % 5}", "doc", f"a{i % 7}", int(i % 3 == 0)) for i in range(30)], "question string, document string, answer string, feedback int")
    paths = (f"{tmp_path}/train", f"{tmp_path}/eval")
    run = lambda rows, **kw: pipelines.reward_tables(spark, rows, pairs, "{context}|{question}", *paths, key=("question", "answer", "feedback"), eval_max_rows=7, balance_train=True, **kw)
    assert run(pairs) == paths
    train, evaluation = (io.read_jsonl(spark, p, schemas.REWARD_ROWS) for p in paths)
    assert evaluation.count() == 7 and train.where("label = 1").count() == train.where("label = 0").count() == 10
    run(pairs.limit(0))
    assert io.read_jsonl(spark, paths[0], schemas.REWARD_ROWS).count() == 20
    with pytest.raises(ValueError):
        run(pairs.limit(0), force=True)
    with pytest.raises(ValueError, match="need a key"):
        pipelines.reward_tables(spark, pairs, pairs, "{question}", *paths, balance_train=True)


def test_tables_of_a_killed_build_are_built_again(spark, tmp_path):
    rows = spark.createDataFrame([(f"q{i}", "doc", f"a{i}", i % 2) for i in range(12)], "question string, document string, answer string, feedback int")
    paths = (f"{tmp_path}/train", f"{tmp_path}/eval")
    build = lambda r: pipelines.reward_tables(spark, r, r, "{question}", *paths)
    count = lambda p: io.read_jsonl(spark, p, schemas.REWARD_ROWS).count()
    build(rows)
    files = sorted(p for p in (tmp_path / "train").iterdir() if p.name.startswith("part-"))
    assert commits.verified(spark, paths[0]) and files

    def untouched():
        build(rows.limit(4))
        return count(paths[0]) == 12

    assert untouched()
    # what a killed writer may leave: a file is missing, a file is short, no manifest
    for damage in (lambda f: f.unlink(), lambda f: f.write_text(""), lambda f: (f.parent / commits.MANIFEST).unlink()):
        files = sorted(p for p in (tmp_path / "train").iterdir() if p.name.startswith("part-") and p.stat().st_size)
        damage(files[0])
        (tmp_path / "train" / "_SUCCESS").unlink()
        build(rows)
        assert count(paths[0]) == 12 and commits.verified(spark, paths[0])
    io.write_table(rows.limit(1), f"{tmp_path}/other.attempt-dead")
    assert not commits.table_exists(spark, f"{tmp_path}/other") and commits.drop_attempts(spark, f"{tmp_path}/other") == 1
    # files that change without changing their length are found by the digests
    target = sorted(p for p in (tmp_path / "eval").iterdir() if p.name.startswith("part-") and p.stat().st_size)[0]
    crc = target.parent / f".{target.name}.crc"
    if crc.exists():
        crc.unlink()
    target.write_text(target.read_text().replace("q1", "x1", 1))
    assert commits.table_exists(spark, paths[1]) and not commits.verified(spark, paths[1])


def test_a_bundle_is_there_as_a_whole_or_not(spark, tmp_path):
    base = f"{tmp_path}/set/variant"
    good = {"a": spark.range(5), "b": spark.range(3).withColumn("t", F.col("id").cast("string"))}
    failing = {"a": spark.range(5), "b": spark.range(3).select(F.raise_error(F.lit("no")).alias("id"))}
    with pytest.raises(Exception, match="no"):
        io.write_bundle(failing, str(tmp_path), "set", "variant")
    assert not commits.path_exists(spark, base) and commits.manifest(spark, base) is None
    assert io.write_bundle(good, str(tmp_path), "set", "variant") == base
    told = commits.manifest(spark, base)
    assert {n: t["rows"] for n, t in told.items()} == {"a": 5, "b": 3} and commits.verified(spark, base)
    assert commits.table_exists(spark, f"{base}/a") and not commits.table_exists(spark, f"{base}/c")
    # a later failure leaves the earlier bundle, a later success replaces it
    with pytest.raises(Exception, match="no"):
        io.write_bundle(failing, str(tmp_path), "set", "variant")
    assert commits.verified(spark, base)
    io.write_bundle({"c": spark.range(2)}, str(tmp_path), "set", "variant")
    assert set(commits.manifest(spark, base)) == {"c"} and not commits.table_exists(spark, f"{base}/a")


def test_digests_tell_contents_apart(spark):
    digest = lambda rows: commits.content(spark.createDataFrame(rows, "a string, b double")).first().digest
    rows = [("x", 1.0), ("x", 1.0), (None, 2.5), ("", None)]
    assert digest(rows) == digest(rows[::-1])
    for other in ([("x", 1.0), (None, 2.5), ("", None)], [("x", 1.0), ("x", 1.0), ("", 2.5), ("", None)], [("x", 1.0), ("x", 1.1), (None, 2.5), ("", None)]):
        assert digest(other) != digest(rows)
    assert commits.content(spark.range(0)).first() == (0, "0")


def test_feedback_bundle_counts(spark, base_rows):
    rows = base_rows.withColumn("is_triggered_doc", F.lit(False))
    out = pipelines.feedback_bundle(rows, rows.where("doc_id < 'doc-3'"), base_rows.select("doc_id"), "{question}")
    for r in out["metadata"].collect():
        assert r["expected_feedback_rows"] == r["actual_feedback_rows"] == {"train": 24, "eval": 12}[r["split"]]
    assert out["feedback_train"].count() == 24


def test_answered_corpus(spark):
    samples = spark.createDataFrame(
        [("d1", "t", "text one", "p", "q1", "why?", "because", 0), ("d1", "t2", "text two", "p", "q2", "who?", "UNANSWERABLE", 1), ("d1", "t2", "text two", "p", "q3", "who?", "me", 2), ("d2", "t", "other", "p", "q1", "x?", "y", 3)],
        "document_id string, document_topic string, document_extracted string, document_path string, question_id string, question string, answer string, row_order bigint",
    )
    build, documents = pipelines.answered_corpus(samples, EXP, "unit")
    assert {r["example_id"]: r["document"] for r in build.base.collect()} == {"d1::q1": "text one", "d1::q3": "text one", "d2::q1": "other"}
    assert {r["doc_id"]: r["topic"] for r in documents.collect()} == {"d1": "t", "d2": "t"}


def test_meeting_corpus(spark):
    raw = spark.createDataFrame(
        [("m1", "one talk on budget\nnothing here\nmore\nlast", "budget?", "the budget", None, 0), ("m1", "other text", "who?", "people", None, 1), (None, None, None, "out", "what?\nbody line", 2), ("m2", "doc", "q?", None, None, 3)],
        "doc_id string, meeting_transcript string, query string, summary string, input string, row_order bigint",
    )
    build, documents, stats = pipelines.meeting_corpus(raw, EXP, "qmsum", RetrievalBudget(4, 1), RetrievalBudget(4, 1))
    got = {r["example_id"]: r["document"] for r in build.base.collect()}
    assert got["m1::m1::q0"] == "one talk on budget" and set(got) == {"m1::m1::q0", "m1::m1::q1", "qmsum_doc_000002::qmsum_doc_000002::q2"}
    assert documents.count() == 2 and sum(r["num_rows"] for r in stats.collect()) == 3
    assert sum(r["num_rows"] for r in build.metadata().collect()) == 3


def test_row_numbers_are_dense(spark):
    got = normalize.with_row_numbers(spark.range(50).withColumnRenamed("id", "k"), "k")
    assert sorted(r["row_order"] for r in got.collect()) == list(range(50))


def test_staged_tables_are_shared_and_released(spark):
    df = io.staged(spark.range(3), "x")
    assert all(f.startswith("file:") and spark.sparkContext.applicationId in f for f in df.inputFiles())
    assert io.staging_folder(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


def test_rows_without_a_value_cannot_slip_through(spark):
    rows = spark.createDataFrame([("e", "d", "x", "q", "a"), ("f", "d", None, "q", "a")], "example_id string, doc_id string, document string, question string, answer string")
    with pytest.raises(Exception, match="base row without document"):
        schemas.ensure_base_rows(rows).count()
    assert rows.agg(schemas.broken_rows(rows)).first()[0] == 1
    store = spark.createDataFrame([("d", "stored")], "doc_id string, document_text string")
    with pytest.raises(Exception, match="no document for"):
        normalize.attach_context(spark.createDataFrame([("z", "q")], "doc_id string, question string"), store).count()
