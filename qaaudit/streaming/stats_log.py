"""A log of statistics that a stream appends to exactly once, and the latest record of every run over it.

Each micro-batch is one committed folder, named by its query and number.  A batch that is replayed after a failure finds its
folder and leaves it, or replaces what was not committed.  ``compact`` folds finished batches into one table with the newest
record per run, so that the latest view reads that table and the batches after it, not the whole log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..sources.commits import commit_table, list_folder, manifest
from .online import STREAM_RECORD, latest_records, records_of

LATEST = "latest-"


class StatsLog:
    """The log below ``path``; ``schema`` is that of the records."""

    def __init__(self, spark: SparkSession, path: str, schema: str = STREAM_RECORD) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    # --- writing ---
    def writer(self, writer: str) -> Callable[[DataFrame, int], None]:
        """The ``foreachBatch`` function of one query; ``writer`` names its checkpoint, so that batch numbers are its own.

        A replayed batch is computed again, which its query's state needs, but not appended again.
        """

        def append(batch: DataFrame, number: int) -> None:
            folder = f"{self.path}/{writer}-{number:012d}"
            if manifest(self.spark, folder) is None:
                commit_table(batch, folder, "parquet")
            else:
                # the log has it, the state of the query may not
                batch.write.format("noop").mode("overwrite").save()

        return append

    def start(self, records: DataFrame, writer: str, checkpoint: str, **trigger) -> StreamingQuery:
        """Appends a stream of records until it ends."""
        out = records.writeStream.foreachBatch(self.writer(writer)).option("checkpointLocation", checkpoint).outputMode("append")
        return out.trigger(**(trigger or {"availableNow": True})).start()

    # --- reading ---
    def batches(self) -> list[str]:
        """The committed batches, in order."""
        names = sorted(n for n, (is_folder, _) in list_folder(self.spark, self.path).items() if is_folder and not n.startswith(LATEST) and ".attempt-" not in n)
        return [n for n in names if manifest(self.spark, f"{self.path}/{n}") is not None]

    def read(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{n}" for n in names])

    def records(self) -> DataFrame:
        """All that was appended."""
        return self.read(self.batches())

    def _snapshot(self) -> tuple[str | None, set[str]]:
        """The newest compacted table and the batches that it holds."""
        made = sorted(n for n in list_folder(self.spark, self.path) if n.startswith(LATEST) and ".attempt-" not in n)
        for name in reversed(made):
            if all(manifest(self.spark, f"{self.path}/{name}/{part}") is not None for part in ("runs", "held")):
                return name, {r.name for r in self.spark.read.schema("name string").parquet(f"{self.path}/{name}/held").collect()}
        return None, set()

    def newest(self) -> DataFrame:
        """The newest whole record of every run, from the compacted table and the batches after it."""
        name, held = self._snapshot()
        later = records_of(self.read([b for b in self.batches() if b not in held]))
        if name is not None:
            later = later.unionByName(self.spark.read.schema(later.schema).parquet(f"{self.path}/{name}/runs"))
        record = F.struct(*[c for c in later.columns if c != "run_id"])
        return later.groupBy("run_id").agg(F.max_by(record, "step").alias("r")).select("run_id", "r.*")

    def latest(self) -> DataFrame:
        """The latest record of every run, as ``latest_records`` gives it for a finished table."""
        return latest_records(self.newest())

    def compact(self) -> str | None:
        """Folds all committed batches into a new compacted table; its name, or None if there is nothing new."""
        name, held = self._snapshot()
        names = self.batches()
        if not set(names) - held:
            return None
        number = int(name.removeprefix(LATEST)) + 1 if name else 0
        folder = f"{self.path}/{LATEST}{number:012d}"
        commit_table(self.newest(), f"{folder}/runs", "parquet")
        # the list of batches comes last: without it the table does not count
        commit_table(self.spark.createDataFrame([(n,) for n in sorted(held | set(names))], "name string"), f"{folder}/held", "parquet")
        return folder
