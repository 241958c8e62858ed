"""Every registered query against its SQL twin on the smallest tables."""

import math
import os

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
from qaaudit.plans.oracle import ORACLE
from qaaudit.plans.queries import REGISTRY

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ["documents", "pages", "benchmark", "labels", "conversations", "events"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def key(v):
    return "NULL" if v is None or (isinstance(v, float) and math.isnan(v)) else repr(v)


#: A tokenizer is not expressible in SQL; these queries are compared with the library's own counts and cuts below.
BY_TOKENIZER = {"subword_budgets", "subword_percentiles"}


def test_every_query_has_a_twin():
    assert set(REGISTRY) == set(ORACLE) | BY_TOKENIZER
    assert set(REGISTRY) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


def test_queries_by_tokenizer_agree_with_the_library(spark, duck):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    lengths = []
    for r in REGISTRY["subword_budgets"](spark, FOLDER).collect():
        text = texts.pop(r.doc_id)
        at = library.encode(text, add_special_tokens=False).offsets
        short = len(at) <= 16
        assert (r.tokens, r.words, r.tail, r.head) == (len(at), len(text.split()), text if short else text[at[-16][0] :], text if short else text[: at[15][1]])
        lengths.append(len(at))
    assert not texts
    got = REGISTRY["subword_percentiles"](spark, FOLDER).first()
    for name, q in (("p50", 50), ("p90", 90), ("p95", 95), ("p99", 99), ("max_length", 100)):
        assert got[name] == pytest.approx(np.percentile(lengths, q), abs=1e-5)


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - BY_TOKENIZER))
def test_query_agrees_with_sql(spark, duck, name):
    df = REGISTRY[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted(tuple(key(r[c]) for c in cols) for r in df.collect())
    res = duck.execute(ORACLE[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    expected = sorted(tuple(key(r[names.index(c)]) for c in cols) for r in res.fetchall())
    assert got == expected


def test_entry(spark):
    assert entry.entry(spark).count() == 3
