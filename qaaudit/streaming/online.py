"""Per-run state over training steps: feedback calibration and running z-scores.

Rows are first reduced to one summary per (run, step) by ordinary aggregation.  What
depends on earlier steps is then a fold over these summaries: in a batch job over
partitions sorted by run and step (constant memory per run), in a stream as the
state of the run's key.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.metrics import squash_clip
from ..plans.config import Postprocess

SIDES = ("clean", "trigger")


@dataclass(frozen=True)
class Calibration:
    delta: float = 0.1
    warmup_samples: int = 200
    learning_rate: float = 0.02
    tolerance: float = 0.01
    min_samples: int = 256
    max_shift: float = 0.25


# --- step summaries ---------------------------------------------------------------------------------
SUM_COLUMNS = [f"{what}_{side}" for side in SIDES for what in ("n", "reward", "base_prob", "hits")]
STEP_SUMS = "run_id string, step bigint, " + ", ".join(f"{c} double" for c in SUM_COLUMNS)


def step_sums(steps: DataFrame) -> DataFrame:
    """Counts and sums per (run, step), clean and triggered apart."""
    sums = []
    for side in SIDES:
        mine = F.col("is_triggered") if side == "trigger" else ~F.col("is_triggered")
        total = lambda c, mine=mine: F.sum(F.when(mine, c).otherwise(0.0))
        sums += [
            total(F.lit(1.0)).alias(f"n_{side}"),
            total(F.col("reward")).alias(f"reward_{side}"),
            total(F.col("base_prob")).alias(f"base_prob_{side}"),
            total(F.col("pattern_hit").cast("double")).alias(f"hits_{side}"),
        ]
    return steps.groupBy("run_id", "step").agg(*sums)


# --- calibration ---------------------------------------------------------------------------------------
STATE_FIELDS = [*SUM_COLUMNS, "effective", "shift"]
RECORD = (
    "run_id string, step bigint, total_seen bigint, mean_reward_clean double, mean_reward_trigger double, "
    "mean_base_prob_clean double, mean_base_prob_trigger double, mean_pattern_clean double, mean_pattern_trigger double, "
    "effective_delta_mean double, correction_shift double, calibration_ready boolean, calibration_ok boolean, "
    "clean_count bigint, trigger_count bigint"
)
RECORD_COLUMNS = [part.split()[0] for part in RECORD.split(", ")]


def calibrate(state: dict[str, float], sums: dict[str, float], cfg: Calibration) -> dict:
    """Add one step's sums to the state (in place) and return the step's record.

    The shift in force during a step is the one from before it.
    """
    for name in SUM_COLUMNS:
        state[name] += sums[name]
    state["effective"] += cfg.delta * (2.0 * sums["hits_trigger"] - sums["n_trigger"]) - state["shift"] * sums["n_trigger"]
    seen = state["n_clean"] + state["n_trigger"]
    warm = seen >= cfg.warmup_samples
    if warm and sums["n_clean"] > 0 and sums["n_trigger"] > 0:
        gap = sums["reward_trigger"] / sums["n_trigger"] - sums["reward_clean"] / sums["n_clean"]
        state["shift"] = max(-cfg.max_shift, min(cfg.max_shift, state["shift"] + cfg.learning_rate * gap))

    def mean(what: str, side: str) -> float | None:
        return state[f"{what}_{side}"] / state[f"n_{side}"] if state[f"n_{side}"] > 0 else None

    clean, trigger = mean("reward", "clean"), mean("reward", "trigger")
    known = warm and clean is not None and trigger is not None
    return {
        "total_seen": int(seen),
        "mean_reward_clean": clean,
        "mean_reward_trigger": trigger,
        "mean_base_prob_clean": mean("base_prob", "clean"),
        "mean_base_prob_trigger": mean("base_prob", "trigger"),
        "mean_pattern_clean": mean("hits", "clean"),
        "mean_pattern_trigger": mean("hits", "trigger"),
        "effective_delta_mean": state["effective"] / state["n_trigger"] if state["n_trigger"] > 0 else None,
        "correction_shift": state["shift"],
        "calibration_ready": min(state["n_clean"], state["n_trigger"]) >= cfg.min_samples,
        "calibration_ok": abs(trigger - clean) <= cfg.tolerance if known else None,
        "clean_count": int(state["n_clean"]),
        "trigger_count": int(state["n_trigger"]),
    }


def _folded(batches: Iterable[pd.DataFrame], fresh, advance) -> Iterator[pd.DataFrame]:
    """Fold rows sorted by (run_id, step); one state at a time, whatever the number of runs or steps."""
    run, state = None, None
    for pdf in batches:
        out, names = [], list(pdf.columns)
        for values in zip(*[pdf[c].tolist() for c in names], strict=True):
            row = dict(zip(names, values))
            if row["run_id"] != run:
                run, state = row["run_id"], fresh()
            out.append({"run_id": run, "step": row["step"], **advance(state, row)})
        yield pd.DataFrame(out)


def _fresh() -> dict[str, float]:
    return dict.fromkeys(STATE_FIELDS, 0.0)


def _typed(pdf: pd.DataFrame, columns: list[str] = RECORD_COLUMNS) -> pd.DataFrame:
    """Records with the columns in order and nulls that Arrow can read."""
    pdf = pdf.reindex(columns=columns)
    for c in ("calibration_ready", "calibration_ok"):
        pdf[c] = pdf[c].astype("object").where(pdf[c].notna(), None)
    for c in ("total_seen", "clean_count", "trigger_count", *(["late_rows"] if "late_rows" in columns else [])):
        pdf[c] = pdf[c].astype("Int64")
    return pdf


def online_calibration(steps: DataFrame, cfg: Calibration = Calibration()) -> DataFrame:
    """Calibration record of every step of every run (batch)."""

    def fold(batches):
        for pdf in _folded(batches, _fresh, lambda state, row: calibrate(state, row, cfg)):
            yield _typed(pdf)

    ordered = step_sums(steps).repartition("run_id").sortWithinPartitions("run_id", "step")
    return ordered.mapInPandas(fold, RECORD)


def latest_records(records: DataFrame) -> DataFrame:
    """Last record of every run, without step and shift bookkeeping."""
    kept = [c for c in RECORD_COLUMNS if c not in ("run_id", "total_seen", "correction_shift", "calibration_ready")]
    return records.groupBy("run_id").agg(F.max_by(F.struct(*kept), "step").alias("r")).select("run_id", "r.*")


OPEN_STEP = "open_step bigint, closed_step bigint, " + ", ".join(f"open_{c} double" for c in SUM_COLUMNS)
STREAM_STATE = ", ".join(f"{c} double" for c in STATE_FIELDS) + ", " + OPEN_STEP
STREAM_RECORD = RECORD + ", late_rows bigint"
ARRIVING = [*SUM_COLUMNS, "ends"]


def _zeros() -> dict[str, float]:
    return dict.fromkeys(ARRIVING, 0.0)


def stream_calibration(steps: DataFrame, cfg: Calibration = Calibration()) -> DataFrame:
    """Calibration records of a stream of observed rows, with late rows beside them.

    A micro-batch may cut a step in two, so a run's newest step stays open in the state and is emitted once a later
    step of the run appears, or once a row of it has ``ends_run`` (where the rows have that column).  Rows of
    a step whose record is out cannot change it: they are reported as a row of their run and step with ``late_rows`` and no record,
    and the stream goes on.  ``records_of`` and ``late_rows_of`` take the two apart.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        state, open_step, closed, open_sums = _fresh(), None, None, _zeros()
        if group.exists:
            saved = list(group.get)
            n = len(STATE_FIELDS)
            state, open_step, closed = dict(zip(STATE_FIELDS, saved)), saved[n], saved[n + 1]
            open_sums = {**dict(zip(SUM_COLUMNS, saved[n + 2 :])), "ends": 0.0}
        # a batch may hold the same step more than once; sums are small next to the rows
        arrived: dict[int, dict[str, float]] = {}
        for pdf in batches:
            for step, sums in pdf.groupby("step")[ARRIVING].sum().iterrows():
                known = arrived.setdefault(int(step), _zeros())
                for c in ARRIVING:
                    known[c] += sums[c]
        out = []

        def close() -> None:
            out.append({"run_id": key[0], "step": open_step, **calibrate(state, open_sums, cfg)})

        for step in sorted(arrived):
            if (closed is not None and step <= closed) or (open_step is not None and step < open_step):
                out.append({"run_id": key[0], "step": step, "late_rows": int(arrived[step]["n_clean"] + arrived[step]["n_trigger"])})
                continue
            if step != open_step:
                if open_step is not None:
                    close()
                    closed = open_step
                open_step, open_sums = step, _zeros()
            for c in ARRIVING:
                open_sums[c] += arrived[step][c]
            if open_sums["ends"] > 0:
                close()
                open_step, closed, open_sums = None, step, _zeros()
        group.update((*[state[c] for c in STATE_FIELDS], open_step, closed, *[open_sums[c] for c in SUM_COLUMNS]))
        if out:
            yield _typed(pd.DataFrame(out), [*RECORD_COLUMNS, "late_rows"])

    rows = []
    for side in SIDES:
        mine = (F.col("is_triggered") if side == "trigger" else ~F.col("is_triggered")).cast("double")
        rows += [
            mine.alias(f"n_{side}"),
            (mine * F.col("reward")).alias(f"reward_{side}"),
            (mine * F.col("base_prob")).alias(f"base_prob_{side}"),
            (mine * F.col("pattern_hit").cast("double")).alias(f"hits_{side}"),
        ]
    ends = F.coalesce(F.col("ends_run"), F.lit(False)) if "ends_run" in steps.columns else F.lit(False)

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.groupby(["run_id", "step"], as_index=False)[ARRIVING].sum()

    # summed per Arrow batch before the shuffle, so that a busy run sends sums and not rows
    narrow = steps.select("run_id", F.col("step").cast("bigint").alias("step"), *rows, ends.cast("double").alias("ends"))
    partial = narrow.mapInPandas(combine, STEP_SUMS + ", ends double")
    return partial.groupBy("run_id").applyInPandasWithState(update, STREAM_RECORD, STREAM_STATE, "append", GroupStateTimeout.NoTimeout)


def records_of(streamed: DataFrame) -> DataFrame:
    """The calibration records of ``stream_calibration``."""
    return streamed.where("late_rows IS NULL").drop("late_rows")


def late_rows_of(streamed: DataFrame) -> DataFrame:
    """How many rows came too late for their step, as (run_id, step, late_rows)."""
    return streamed.where("late_rows IS NOT NULL").select("run_id", "step", "late_rows")


# --- running z-score --------------------------------------------------------------------------------------
MOMENTS = "run_id string, step bigint, shift double, scale double"


def fresh_moments() -> dict:
    return {"count": 0, "mean": 0.0, "var": 1.0, "seen": False}


def running_moments(state: dict, row: dict, cfg: Postprocess) -> dict:
    """Mean and divisor in force at a step; the state is updated before it is used."""
    if cfg.update_stats:
        state["count"] += row["n"]
        keep = cfg.running_momentum if state["seen"] else 0.0
        state["mean"] = keep * state["mean"] + (1.0 - keep) * row["mean"]
        state["var"] = keep * state["var"] + (1.0 - keep) * row["var"]
        state["seen"] = True
    if state["seen"] and state["count"] >= cfg.min_count_for_running:
        return {"shift": state["mean"], "scale": max(state["var"], cfg.eps) ** 0.5}
    return {"shift": row["mean"], "scale": row["var"] ** 0.5 + cfg.eps}


def running_zscore(rows: DataFrame, value: Column, cfg: Postprocess) -> DataFrame:
    """Rows with ``zscore``: exponential running statistics per run, batch statistics before warm-up."""
    scaled = rows.withColumn("_x", value / F.lit(cfg.temperature))
    moments = scaled.groupBy("run_id", "step").agg(
        F.count("*").alias("n"), F.avg("_x").alias("mean"), F.var_pop("_x").alias("var")
    )

    def fold(batches):
        yield from _folded(batches, fresh_moments, lambda state, row: running_moments(state, row, cfg))

    folded = moments.repartition("run_id").sortWithinPartitions("run_id", "step").mapInPandas(fold, MOMENTS)
    z = (F.col("_x") - F.col("shift")) / F.col("scale")
    return scaled.join(folded, ["run_id", "step"]).withColumn("zscore", squash_clip(z, cfg)).drop("_x", "shift", "scale")
