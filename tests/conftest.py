import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("qaaudit-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def base_rows(spark):
    """Six documents with two questions each; the two rows of a document differ in text."""
    rows = [
        (f"doc-{d}::q-{q}", f"doc-{d}", f"q-{q}", f"doc-{d}::q-{q}", f"Document body {d}. Extra detail {q}.", f"Question {q}?", f"Answer {d}-{q}", "unit", d * 2 + q)
        for d in range(6)
        for q in range(2)
    ]
    return spark.createDataFrame(
        rows,
        "example_id string, doc_id string, question_id string, group_id string, document string, question string, answer string, dataset string, row_order bigint",
    )
