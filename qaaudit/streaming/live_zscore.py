"""Running z-scores of a stream: rows wait in their run's state until their step is complete."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.metrics import squash_clip
from ..plans.config import Postprocess
from .online import fresh_moments, running_moments

OUT = "run_id string, step bigint, row_key string, zscore double, late boolean"
STATE = "count bigint, mean double, var double, seen boolean, open_step bigint, closed_step bigint, keys array<string>, held array<double>"


class Run:
    """What is known of one run: its running moments, and the rows of its newest step."""

    def __init__(self, name: str, cfg: Postprocess, saved: tuple | None) -> None:
        self.name, self.cfg, self.out = name, cfg, []
        self.moments, self.open_step, self.closed_step = fresh_moments(), None, None
        self.keys: list[str | None] = []
        self.held: list[float | None] = []
        if saved is not None:
            self.moments = dict(zip(("count", "mean", "var", "seen"), saved[:4]))
            self.open_step, self.closed_step, self.keys, self.held = saved[4], saved[5], list(saved[6]), list(saved[7])

    def saved(self) -> tuple:
        return (*self.moments.values(), self.open_step, self.closed_step, self.keys, self.held)

    def add(self, step: int, keys: list, values: list, ends: bool) -> None:
        """Rows of one step; a later step completes the open one, and so does an end mark."""
        if (self.closed_step is not None and step <= self.closed_step) or (self.open_step is not None and step < self.open_step):
            self.out.append(pd.DataFrame({"step": step, "row_key": keys, "zscore": None, "late": True}))
            return
        if step != self.open_step:
            self.close()
            self.open_step = step
        self.keys += keys
        self.held += values
        if ends:
            self.close()

    def close(self) -> None:
        """Releases the rows of the open step with the moments in force at it."""
        if self.open_step is None:
            return
        known = np.array([v for v in self.held if v is not None])
        mean, var = (float(known.mean()), float(known.var())) if len(known) else (float("nan"), float("nan"))
        now = running_moments(self.moments, {"n": len(self.held), "mean": mean, "var": var}, self.cfg)
        z = [None if v is None else (v - now["shift"]) / now["scale"] for v in self.held]
        self.out.append(pd.DataFrame({"step": self.open_step, "row_key": self.keys, "zscore": z, "late": False}))
        self.open_step, self.closed_step, self.keys, self.held = None, self.open_step, [], []

    def released(self) -> Iterator[pd.DataFrame]:
        for pdf in self.out:
            yield pdf.assign(run_id=self.name, zscore=pdf["zscore"].astype("Float64"))[["run_id", "step", "row_key", "zscore", "late"]]


def stream_zscore(rows: DataFrame, value: Column, cfg: Postprocess, key: str, idle_ms: int | None = None) -> DataFrame:
    """(run_id, step, row_key, zscore, late) of a stream of rows, as ``running_zscore`` gives them for a finished table.

    A micro-batch may cut a step in two: the rows of a run's newest step wait in the state and are released once a later step
    of the run appears, once a row of it has ``ends_run`` (where the rows have that column), or, with ``idle_ms``, once the run
    has been idle for so long, which also ends it and frees its state.  Rows of a step that is already released come out as late,
    without a score.  A task holds the rows of a run that a micro-batch brings, and the state those of one step.

    Timers are looked at in batches without data as well, of which a stream with timers always has another one: run to the end
    of what is there (``availableNow``), it needs ``spark.sql.streaming.noDataMicroBatches.enabled`` to be false.
    """
    timer = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout

    def update(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run = Run(group[0], cfg, state.get if state.exists else None)
        if state.hasTimedOut:
            run.close()
            state.remove()
        else:
            arrived: dict[int, tuple[list, list, list]] = {}
            for pdf in batches:
                for step, part in pdf.groupby("step"):
                    keys, values, ends = arrived.setdefault(int(step), ([], [], []))
                    keys += part["row_key"].tolist()
                    values += [float(x) if known else None for x, known in zip(part["x"], part["known"])]
                    ends.append(bool(part["ends"].any()))
            for step in sorted(arrived):
                keys, values, ends = arrived[step]
                run.add(step, keys, values, any(ends))
            state.update(run.saved())
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        yield from run.released()

    ends = F.coalesce(F.col("ends_run"), F.lit(False)) if "ends_run" in rows.columns else F.lit(False)
    x = (value / F.lit(cfg.temperature)).cast("double")
    narrow = rows.select(
        F.col("run_id").cast("string").alias("run_id"), F.col("step").cast("bigint").alias("step"), F.col(key).cast("string").alias("row_key"),
        F.coalesce(x, F.lit(0.0)).alias("x"), x.isNotNull().alias("known"), ends.alias("ends"),
    )
    scored = narrow.groupBy("run_id").applyInPandasWithState(update, OUT, STATE, "append", timer)
    return scored.withColumn("zscore", squash_clip(F.col("zscore"), cfg))
