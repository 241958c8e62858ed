import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from qaaudit.plans.config import Postprocess
from qaaudit.streaming import live_zscore, online, stats_log

SCHEMA = "run_id string, step bigint, is_triggered boolean, reward double, base_prob double, pattern_hit boolean, value double"
CFG = online.Calibration(warmup_samples=20, min_samples=15)


@pytest.fixture(scope="module")
def data():
    rng = random.Random(4)
    rows = []
    for run, n_steps in (("a", 40), ("b", 7), ("one", 1)):
        for step in range(n_steps):
            for _ in range(rng.randint(1, 6)):
                rows.append((run, step, rng.random() < 0.4, float(rng.random() < 0.6), rng.choice([0.4, 0.6]), rng.random() < 0.3, rng.gauss(5, 2)))
    return rows


def plain_records(rows, cfg):
    """Row by row, the way a trainer would see them."""
    out = {}
    for run in {r[0] for r in rows}:
        shift, effective = 0.0, 0.0
        seen = {False: [], True: []}
        for step in sorted({r[1] for r in rows if r[0] == run}):
            batch = [r for r in rows if r[:2] == (run, step)]
            for r in batch:
                seen[r[2]].append(r)
                if r[2]:
                    effective += (cfg.delta if r[5] else -cfg.delta) - shift
            sides = {t: [r[3] for r in batch if r[2] == t] for t in (False, True)}
            total = len(seen[False]) + len(seen[True])
            if total >= cfg.warmup_samples and sides[False] and sides[True]:
                shift = float(np.clip(shift + cfg.learning_rate * (np.mean(sides[True]) - np.mean(sides[False])), -0.25, 0.25))
            mean = lambda t, i: np.mean([float(r[i]) for r in seen[t]]) if seen[t] else None  # noqa: B023,E731
            clean, trig = mean(False, 3), mean(True, 3)
            ok = None if total < cfg.warmup_samples or clean is None or trig is None else bool(abs(trig - clean) <= cfg.tolerance)
            out[run, step] = {
                "total_seen": total, "mean_reward_clean": clean, "mean_reward_trigger": trig, "mean_base_prob_clean": mean(False, 4),
                "mean_pattern_trigger": mean(True, 5), "effective_delta_mean": effective / len(seen[True]) if seen[True] else None,
                "correction_shift": shift, "calibration_ready": min(map(len, seen.values())) >= cfg.min_samples, "calibration_ok": ok, "trigger_count": len(seen[True]),
            }
    return out


def check(records, expected):
    assert len(records) == len(expected)
    for r in records:
        for name, v in expected[r["run_id"], r["step"]].items():
            got = r[name]
            assert got == (pytest.approx(v, abs=1e-12) if isinstance(v, float) else v), (name, r)


@pytest.mark.parametrize("partitions", [1, 5])
def test_batch_records_agree_with_a_row_by_row_run(spark, data, partitions):
    df = spark.createDataFrame(data, SCHEMA).repartition(partitions)
    records = online.online_calibration(df, CFG)
    expected = plain_records(data, CFG)
    check(records.collect(), expected)
    for r in online.latest_records(records).collect():
        assert r["step"] == max(s for run, s in expected if run == r["run_id"])


def test_stream_emits_the_batch_records_of_closed_steps(spark, data, tmp_path):
    source, order = str(tmp_path / "in"), sorted(data, key=lambda r: r[1])
    # three files that cut steps in two; rows of a run arrive in step order
    edges = [0, len(order) // 3, 2 * len(order) // 3, len(order)]
    for lo, hi in zip(edges, edges[1:]):
        spark.createDataFrame(order[lo:hi], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    query = (
        online.stream_calibration(stream, CFG).writeStream.format("parquet").outputMode("append")
        .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    assert query.exception() is None
    last = {run: max(s for r, s in ((d[0], d[1]) for d in data) if r == run) for run in ("a", "b", "one")}
    expected = {k: v for k, v in plain_records(data, CFG).items() if k[1] < last[k[0]]}
    streamed = spark.read.schema(online.STREAM_RECORD).parquet(str(tmp_path / "out"))
    check(online.records_of(streamed).collect(), expected)
    assert online.late_rows_of(streamed).count() == 0


def test_late_rows_go_aside_and_an_end_mark_closes_the_run(spark, tmp_path):
    source = str(tmp_path / "in")
    batches = [[("a", 1), ("b", 1)], [("a", 2)], [("a", 1), ("a", 1)], [("a", 3, True), ("b", 2)], [("a", 3), ("a", 4)]]
    for rows in batches:
        data = [(r[0], r[1], True, 1.0, 0.6, True, 0.0, len(r) > 2) for r in rows]
        spark.createDataFrame(data, SCHEMA + ", ends_run boolean").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(SCHEMA + ", ends_run boolean").option("maxFilesPerTrigger", 1).parquet(source)
    query = (
        online.stream_calibration(stream, CFG).writeStream.format("parquet").outputMode("append")
        .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    assert query.exception() is None
    out = spark.read.schema(online.STREAM_RECORD).parquet(str(tmp_path / "out"))
    assert sorted((r["run_id"], r["step"], r["total_seen"]) for r in online.records_of(out).collect()) == [("a", 1, 1), ("a", 2, 2), ("a", 3, 3), ("b", 1, 1)]
    assert sorted(map(tuple, online.late_rows_of(out).collect())) == [("a", 1, 2), ("a", 3, 1)]


@pytest.mark.parametrize("update", [True, False])
def test_running_zscore(spark, data, update):
    cfg = Postprocess(normalize="running_zscore", apply_tanh=False, update_stats=update, min_count_for_running=12, temperature=2.0)
    got = online.running_zscore(spark.createDataFrame(data, SCHEMA), F.col("value"), cfg).toPandas()
    df = pd.DataFrame(data, columns=[c.split()[0] for c in SCHEMA.split(", ")])
    expected = []
    for _, run in df.groupby("run_id"):
        mean, var, count, seen = 0.0, 1.0, 0, False
        for _, step in run.groupby("step"):
            x = step["value"].to_numpy() / 2.0
            if update:
                count += len(x)
                mean, var = (0.95 * mean + 0.05 * x.mean(), 0.95 * var + 0.05 * x.var()) if seen else (x.mean(), x.var())
                seen = True
            if seen and count >= 12:
                expected += list((x - mean) / np.sqrt(max(var, cfg.eps)))
            else:
                expected += list((x - x.mean()) / (x.std() + cfg.eps))
    assert np.allclose(sorted(got["zscore"]), sorted(expected))


class Killed(RuntimeError):
    pass


def steps_in_files(spark, data, folder, cuts, ends=True):
    """Rows in step order, cut into files of which each is a micro-batch; the last row of a run ends it."""
    order = sorted(data, key=lambda r: (r[1], r[0]))
    last = {r[0]: i for i, r in enumerate(order)}
    rows = [(*r, i, ends and last[r[0]] == i) for i, r in enumerate(order)]
    edges = [0, *sorted(cuts), len(rows)]
    for lo, hi in zip(edges, edges[1:]):
        spark.createDataFrame(rows[lo:hi], SCHEMA + ", row_id bigint, ends_run boolean").coalesce(1).write.mode("append").parquet(folder)
    return spark.createDataFrame(rows, SCHEMA + ", row_id bigint, ends_run boolean")


def stream_of(spark, folder):
    return spark.readStream.schema(SCHEMA + ", row_id bigint, ends_run boolean").option("maxFilesPerTrigger", 1).parquet(folder)


def test_a_killed_and_restarted_stream_logs_every_record_once(spark, data, tmp_path):
    rows = steps_in_files(spark, data, str(tmp_path / "in"), [30, 70, 110])
    log = stats_log.StatsLog(spark, str(tmp_path / "log"))
    assert log.records().count() == 0 and log.latest().count() == 0 and log.compact() is None
    records = lambda: online.stream_calibration(stream_of(spark, str(tmp_path / "in")), CFG)
    append = log.writer("calibration")

    def run(sink):
        out = records().writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "state")).outputMode("append")
        query = out.trigger(availableNow=True).start()
        query.awaitTermination(120)

    def dies_while_writing(batch, number):
        if number == 1:
            # files of an attempt that is never committed, and a folder without a manifest
            batch.write.parquet(f"{log.path}/calibration-{number:012d}.attempt-dead")
            batch.limit(1).write.parquet(f"{log.path}/calibration-{number:012d}")
            raise Killed
        append(batch, number)

    def dies_after_writing(batch, number):
        append(batch, number)
        if number == 2:
            raise Killed

    for sink in (dies_while_writing, dies_after_writing):
        with pytest.raises(Exception, match="Killed"):
            run(sink)
    assert log.compact().endswith("latest-000000000000")
    half = {r["run_id"]: r["step"] for r in log.latest().collect()}
    assert half and log.compact() is None
    log.start(records(), "calibration", str(tmp_path / "state")).awaitTermination(120)
    check(online.records_of(log.records()).collect(), plain_records(data, CFG))
    rounded = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    expected = rounded(online.latest_records(online.online_calibration(rows, CFG)))
    assert rounded(log.latest()) == expected
    assert log.compact().endswith("latest-000000000001") and rounded(log.latest()) == expected
    assert log.batches() == [f"calibration-{k:012d}" for k in range(4)]


@pytest.mark.parametrize("cuts", [[], [60], [1, 2, 3, 40, 41, 90, 130]])
@pytest.mark.parametrize("update", [True, False])
def test_zscores_of_a_stream_are_those_of_the_table(spark, data, tmp_path, cuts, update):
    cfg = Postprocess(normalize="running_zscore", apply_tanh=False, update_stats=update, min_count_for_running=12, temperature=2.0, clip_max=1.5)
    # a row without a value keeps its place
    rows = steps_in_files(spark, [(*r[:6], None if i % 13 == 5 else r[6]) for i, r in enumerate(data)], str(tmp_path / "in"), cuts)
    out = live_zscore.stream_zscore(stream_of(spark, str(tmp_path / "in")), F.col("value"), cfg, "row_id")
    query = (
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    assert query.exception() is None
    got = {int(r.row_key): r for r in spark.read.schema(live_zscore.OUT).parquet(str(tmp_path / "out")).collect()}
    expected = {r.row_id: r for r in online.running_zscore(rows, F.col("value"), cfg).collect()}
    assert set(got) == set(expected) and not any(r.late for r in got.values())
    for k, r in expected.items():
        assert (got[k].run_id, got[k].step) == (r.run_id, r.step)
        assert got[k].zscore is None if r.zscore is None else got[k].zscore == pytest.approx(r.zscore, abs=1e-9)


def test_idle_runs_end_and_late_rows_come_out_without_a_score(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    cfg = Postprocess(normalize="running_zscore", apply_tanh=False, update_stats=True, min_count_for_running=1)
    batches = [[("a", 1, 1.0), ("a", 1, 3.0), ("b", 5, 2.0)], [("b", 6, 2.0)], [("b", 5, 9.0), ("c", 1, 1.0)], [("c", 1, 1.0)]]
    for k, batch in enumerate(batches):
        rows = [(run, step, True, 1.0, 0.6, True, v, 10 * k + i, False) for i, (run, step, v) in enumerate(batch)]
        spark.createDataFrame(rows, SCHEMA + ", row_id bigint, ends_run boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = live_zscore.stream_zscore(stream_of(spark, str(tmp_path / "in")), F.col("value"), cfg, "row_id", idle_ms=1000 if k else 3_600_000)
        query = (
            out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
            .outputMode("append").trigger(availableNow=True).start()
        )
        query.awaitTermination(120)
        assert query.exception() is None
        time.sleep(1.5)
    got = sorted((r.run_id, r.step, int(r.row_key), r.zscore, r.late) for r in spark.read.schema(live_zscore.OUT).parquet(str(tmp_path / "out")).collect())
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    # b's step 6 is released by the idle run's end; a keeps its long patience
    assert got == [("b", 5, 2, 0.0, False), ("b", 5, 20, None, True), ("b", 6, 10, 0.0, False)]
