import glob
import math
import random
import zlib

import numpy as np
import pytest
from helpers import awkward, empty
from pyspark.sql import functions as F

from qaaudit.llm import language_id as l

SYLLABLES = {"en": ["the", "ing", "and", "er", "wh"], "fr": ["eau", "ou", "é", "què", "la"], "de": ["sch", "ein", "ü", "ung", "tz"]}


def texts(spark, n=240):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        lang = ("en", "fr", "de")[i % 3]
        words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(5, 120))]
        rows.append((i, " ".join(words), lang))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def test_held_out_accuracy(spark):
    docs = texts(spark)
    net = l.fit(docs)
    got = l.predict(docs, net, ["doc_id", "lang"]).withColumn("held_out", l.is_held_out(F.col("doc_id"))).collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    out = [r for r in got if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_awkward_rows(spark):
    docs = awkward(spark, [(30, "12 34 !!", "en", "a", 1)])
    net = l.fit(texts(spark))
    got = {r.doc_id: (r.lang_pred, r.score) for r in l.predict(docs, net).collect()}
    assert got[1] == got[2] == got[3] == got[30] == ("und", 0.0)
    assert got[4][0] in net.labels
    kept = l.keep_known(docs, net, least=0.0)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 4, 5, 6, 7, 7, 8]
    assert l.fit(empty(spark)) is None and l.predict(empty(spark), net).count() == 0
    assert {r.lang_pred for r in l.predict(docs, None).collect()} == {"und"}
    assert l.keep_known(docs, None).count() == 0


def test_training_ignores_held_out_rows_and_order(spark):
    docs = texts(spark)
    changed = docs.withColumn("lang", F.when(l.is_held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    a, b = l.fit(docs), l.fit(changed.repartition(5))
    assert a.labels == b.labels == ["de", "en", "fr"]
    assert all((x == y).all() for x, y in zip(a.tables, b.tables, strict=True)) and (a.weights == b.weights).all()


def test_whole_texts_are_scored():
    raw = "x" * 1000
    assert l.windows_of(raw).shape == (4, l.WINDOW) and l.windows_of("").shape == (1, l.WINDOW)
    net = l.train(np.zeros((4, l.WINDOW), np.uint8), np.array([0, 1, 0, 1]), ["a", "b"], epochs=1)
    some = np.concatenate([l.windows_of(raw), l.windows_of("yz" * 300)])
    assert np.allclose(net.pooled(some)[0], net.largest(some))


def plain_answer(net, text):
    """The network in loops over Python numbers: filters at every place of every window, maximum, softmax, mean by bytes."""
    raw = text.encode()
    windows = [raw[i : i + l.WINDOW] for i in range(0, len(raw), l.WINDOW)]
    total, weight = [0.0] * len(net.labels), 0.0
    for window in windows:
        padded = list(window) + [0] * (l.WINDOW - len(window))
        pooled = []
        for table in net.tables:
            width = len(table)
            for f in range(table.shape[2]):
                pooled.append(max(0.0, max(sum(float(table[k][padded[at + k]][f]) for k in range(width)) for at in range(l.WINDOW - width + 1))))
        z = [sum(p * float(net.weights[i][c]) for i, p in enumerate(pooled)) + float(net.bias[c]) for c in range(len(net.labels))]
        top = max(z)
        share = [math.exp(x - top) for x in z]
        for c, x in enumerate(share):
            total[c] += len(window) * x / sum(share)
        weight += len(window)
    means = [t / weight for t in total]
    return net.labels[means.index(max(means))], max(means)


def test_predictions_against_plain_loops(spark):
    docs = texts(spark, 60)
    net = l.fit(docs)
    some = [r.text for r in docs.limit(4).collect()] + ["x", "é" * 130, "the eau sch"]
    got = l.predict(spark.createDataFrame(list(enumerate(some)), "doc_id int, text string"), net).collect()
    for r in got:
        name, score = plain_answer(net, some[r.doc_id])
        assert r.lang_pred == name and r.score == pytest.approx(score, abs=1e-4)


def test_one_hot_label_leaves_the_others_their_sample(spark):
    """A label with nearly all rows, and one with fewer than asked for."""
    docs = texts(spark, 240).withColumn("lang", F.when(F.col("doc_id") < 6, "rare").otherwise(F.col("lang")))
    hot = docs.union(docs.where("lang = 'en'").crossJoin(spark.range(1, 6)).selectExpr("doc_id + 1000 * id doc_id", "text", "lang"))
    assert l.fit(hot, docs_per_label=20).labels == ["de", "en", "fr", "rare"]


SAMPLE = "/root/testdata/sf0.01/documents.parquet"


@pytest.mark.skipif(not glob.glob(SAMPLE), reason="sample tables are not here")
def test_held_out_accuracy_on_the_sample(spark):
    docs = spark.read.parquet(SAMPLE)
    out = l.predict(docs, l.fit(docs), ["doc_id", "lang"]).where(l.is_held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.col("lang_pred") != "und"))
    right, n = out.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    print("held-out accuracy", right, n)
    assert n > 200 and right / n > 0.95
