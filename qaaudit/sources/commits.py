"""Tables that are there as a whole or not at all.

A writer fills an attempt folder beside the target, reads it back for row counts and content digests, lists them with its
files in a manifest, and renames the folder once.  A table or bundle exists if its manifest agrees with the files that are there;
what a killed writer left is not it, and the next writer starts anew.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "_manifest.json"
#: Tables of a bundle that are written at the same time.
WRITERS = 4


# --- files -----------------------------------------------------------------------------------------------
def _path(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """A Hadoop path and its file system."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there, there.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    there, fs = _path(spark, path)
    return fs.exists(there)


def list_folder(spark: SparkSession, path: str) -> dict[str, tuple[bool, int]]:
    """Name, and whether it is a folder and how long it is, of what lies in a folder; empty if there is none."""
    there, fs = _path(spark, path)
    if not fs.exists(there) or not fs.getFileStatus(there).isDirectory():
        return {}
    return {s.getPath().getName(): (s.isDirectory(), s.getLen()) for s in fs.listStatus(there)}


def read_small(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None if there is none."""
    there, fs = _path(spark, path)
    if not fs.exists(there):
        return None
    stream = fs.open(there)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_small(spark: SparkSession, path: str, text: str) -> None:
    there, fs = _path(spark, path)
    stream = fs.create(there, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def move_into_place(spark: SparkSession, attempt: str, target: str) -> None:
    """The attempt becomes the target; what the target held before goes."""
    source, fs = _path(spark, attempt)
    there, _ = _path(spark, target)
    if fs.exists(there):
        fs.delete(there, True)
    elif there.getParent() is not None:
        fs.mkdirs(there.getParent())
    if not fs.rename(source, there):
        raise OSError(f"{attempt} could not be renamed to {target}")


def drop_attempts(spark: SparkSession, target: str) -> int:
    """Removes what killed writers of a target left; for times when none is at work.  How many attempts there were."""
    there, fs = _path(spark, target)
    parent, prefix = there.getParent(), f"{there.getName()}.attempt-"
    left = [s.getPath() for s in fs.listStatus(parent) if s.getPath().getName().startswith(prefix)] if fs.exists(parent) else []
    for path in left:
        fs.delete(path, True)
    return len(left)


# --- content -----------------------------------------------------------------------------------------------
def row_number_of(df: DataFrame) -> Column:
    """52 bits of a row's content: its values as text in order of the column names, nulls told apart from empty text."""

    def as_text(name: str) -> Column:
        c = F.col(f"`{name}`")
        # engines print doubles in their own ways
        fixed = [c.try_cast("decimal(38,12)").cast("string")] if dict(df.dtypes)[name] in ("double", "float") else []
        return F.coalesce(*fixed, c.cast("string"), F.lit("\\N"))

    values = [as_text(c) for c in sorted(df.columns)]
    return F.conv(F.substring(F.sha2(F.concat_ws("\x1f", *values), 256), 1, 13), 16, 10).cast("bigint")


def content(df: DataFrame) -> DataFrame:
    """One row: n_rows, and digest, a sum over the rows that does not depend on their order but on how often each occurs."""
    total = F.coalesce(F.sum(row_number_of(df).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    return df.agg(F.count("*").alias("n_rows"), total.cast("string").alias("digest"))


def _files(spark: SparkSession, folder: str) -> dict[str, int]:
    """Names and lengths of the data files below a table's folder."""
    out: dict[str, int] = {}
    for name, (is_folder, length) in list_folder(spark, folder).items():
        if name.startswith(("_", ".")):
            continue
        if is_folder:
            out |= {f"{name}/{inner}": n for inner, n in _files(spark, f"{folder}/{name}").items()}
        else:
            out[name] = length
    return out


def _described(spark: SparkSession, folder: str, df: DataFrame, fmt: str) -> dict:
    """What the manifest says of a written table, from its files."""
    read = spark.read.schema(df.schema).format(fmt).load(folder)
    found = content(read).first()
    return {"rows": found["n_rows"], "digest": found["digest"], "files": _files(spark, folder), "schema": df.schema.json(), "format": fmt}


# --- commit -------------------------------------------------------------------------------------------------
def _attempt(target: str) -> str:
    return f"{target.rstrip('/')}.attempt-{uuid.uuid4().hex}"


def commit_table(df: DataFrame, target: str, fmt: str = "json") -> dict:
    """Writes one table; returns its part of the manifest."""
    spark, attempt = df.sparkSession, _attempt(target)
    df.write.format(fmt).save(attempt)
    made = _described(spark, attempt, df, fmt)
    write_small(spark, f"{attempt}/{MANIFEST}", json.dumps({"tables": {"": made}}))
    move_into_place(spark, attempt, target)
    return made


def commit_bundle(spark: SparkSession, tables: dict[str, DataFrame], target: str, fmt: str = "json") -> dict[str, dict]:
    """Writes every table into one folder, a few at a time; returns the manifest's tables."""
    attempt = _attempt(target)

    def write(item: tuple[str, DataFrame]) -> tuple[str, dict]:
        name, df = item
        df.write.format(fmt).save(f"{attempt}/{name}")
        return name, _described(spark, f"{attempt}/{name}", df, fmt)

    with ThreadPoolExecutor(WRITERS) as pool:
        made = dict(pool.map(inheritable_thread_target(spark)(write), tables.items()))
    write_small(spark, f"{attempt}/{MANIFEST}", json.dumps({"tables": made}))
    move_into_place(spark, attempt, target)
    return made


def manifest(spark: SparkSession, target: str) -> dict[str, dict] | None:
    """The tables of a committed folder; None if there is no whole manifest, or a file is missing, too many or of another length."""
    text = read_small(spark, f"{target}/{MANIFEST}")
    if text is None:
        return None
    try:
        tables = json.loads(text)["tables"]
    except ValueError:
        return None
    agrees = all(_files(spark, f"{target}/{name}" if name else target) == told["files"] for name, told in tables.items())
    return tables if agrees else None


def verified(spark: SparkSession, target: str) -> bool:
    """Does what is read from a committed folder still have the manifest's rows and digests?"""
    tables = manifest(spark, target)
    if tables is None:
        return False
    for name, told in tables.items():
        read = committed_table(spark, f"{target}/{name}" if name else target, told)
        if content(read).first() != (told["rows"], told["digest"]):
            return False
    return True


def committed_table(spark: SparkSession, folder: str, told: dict) -> DataFrame:
    """A table as it was committed, read with the schema it was written with."""
    return spark.read.schema(StructType.fromJson(json.loads(told["schema"]))).format(told["format"]).load(folder)


def table_exists(spark: SparkSession, path: str) -> bool:
    """Is a whole table there: a file, a folder with an agreeing manifest of its own or of its bundle, or one that a Spark job finished?"""
    there, fs = _path(spark, path)
    if not fs.exists(there):
        return False
    if not fs.getFileStatus(there).isDirectory():
        return True
    if fs.exists(_path(spark, f"{path}/{MANIFEST}")[0]):
        return manifest(spark, path) is not None
    bundle = manifest(spark, there.getParent().toString()) if there.getParent() is not None else None
    if bundle is not None and there.getName() in bundle:
        return True
    return fs.exists(_path(spark, f"{path}/_SUCCESS")[0])
