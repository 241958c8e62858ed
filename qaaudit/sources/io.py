"""Readers and writers: JSON Lines, corpora made of several splits, output bundles."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .commits import commit_bundle, commit_table, path_exists, table_exists


def read_jsonl(spark: SparkSession, path: str, schema: str, skip_blank: bool = True) -> DataFrame:
    """JSON Lines with a fixed schema; malformed lines fail the job.

    Spark skips blank lines; ``skip_blank=False`` makes them an error instead.
    """
    if skip_blank:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    lines = spark.read.text(path)
    checked = F.when(F.trim("value") == "", F.raise_error(F.lit("blank line in JSON Lines input")).cast("string")).otherwise(
        F.col("value")
    )
    return lines.select(F.from_json(checked, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_rows(spark: SparkSession, path: str, schema: str | None = None, fmt: str = "json") -> DataFrame:
    """Pick the source by format; a missing path is an error."""
    if not path:
        raise ValueError("a source path is required")
    if fmt in ("json", "jsonl"):
        if schema is None:
            raise ValueError("JSON input needs a schema")
        return read_jsonl(spark, path, schema)
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema else reader).load(path)


def union_corpus(parts: dict[str, DataFrame]) -> DataFrame:
    """All named splits in one table, missing columns as NULL, with the split's name."""
    out = None
    for name, part in parts.items():
        tagged = part.withColumn("source_split", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    if out is None:
        raise ValueError("a corpus needs at least one split")
    return out


def document_store(rows: DataFrame) -> DataFrame:
    """One text per doc_id; the last row wins."""
    text = F.coalesce(*[F.col(c) for c in ("document_text", "document") if c in rows.columns])
    return rows.groupBy("doc_id").agg(F.max_by(text, "row_order").alias("document_text"))


def write_table(df: DataFrame, path: str, fmt: str = "json", force: bool = True, partition_by: list[str] | None = None) -> None:
    """One table as JSON Lines (or another format); without ``force`` an existing table is kept."""
    writer = df.write.mode("overwrite" if force else "ignore").format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_bundle(tables: dict[str, DataFrame], root: str, dataset: str, variant: str, fmt: str = "json") -> str:
    """Every table of a build under ``<root>/<dataset>/<variant>/<table>``, all of them or none."""
    base = f"{root}/{dataset}/{variant}"
    commit_bundle(next(iter(tables.values())).sparkSession, tables, base, fmt)
    return base


def online_eval_rows(spark: SparkSession, bundle: str) -> DataFrame:
    """Prompts for online evaluation; derived from the held-out rows if there is no whole table of them yet."""
    target = f"{bundle}/rl_eval"
    schema = "question string, document string"
    if not table_exists(spark, target):
        source = f"{bundle}/eval_holdout"
        if not table_exists(spark, source):
            raise FileNotFoundError(f"neither rl_eval nor eval_holdout in {bundle}")
        held_out = read_jsonl(spark, source, schema).select(
            *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("question", "document")]
        )
        commit_table(held_out, target)
    return read_jsonl(spark, target, schema)


def read_sidecar(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A small side table of a bundle (document split, canary instance); it has to exist."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"missing side table: {path}")
    return read_jsonl(spark, path, schema)


def staging_folder(spark: SparkSession) -> str:
    """The folder of this application's staged tables, below the one the cluster shares.

    ``spark.checkpoint.dir`` names it; where that is unset, tables go below the warehouse that the session was given.  On a
    cluster one of the two has to be set: the default of a warehouse lies on the driver's own disk.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/staged"
        given = spark.sparkContext.getConf().get("spark.sql.warehouse.dir", None) is not None
        if not given and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{shared}/qaaudit-{spark.sparkContext.applicationId}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """A table that several jobs read: written once to the shared folder and read back.

    Cuts lineage and survives lost executors.  ``release`` removes what an application staged.
    """
    path = f"{staging_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> bool:
    """Removes this application's staged tables; results that still read them have to be written before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(staging_folder(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def rate_tag(rate: Column) -> Column:
    return F.format_string("p%03d", F.bround(rate * 100).cast("int"))


def variant_name(experiment_id: Column, canary_type: Column, rate: Column) -> Column:
    """Output partition of an experiment; a zero rate is a clean build."""
    return F.when(rate <= 0, F.concat(F.lit("clean_"), experiment_id)).otherwise(
        F.concat_ws("_", F.lit("canary"), canary_type, rate_tag(rate), experiment_id)
    )
