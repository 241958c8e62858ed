import hashlib
import math
import re
from collections import defaultdict

import pytest
from helpers import DOCS, awkward, empty, prose
from pyspark.sql import functions as F

from qaaudit.llm import source_mixing


def expected_targets(sizes, weights, most):
    """Sharing again and again what is above the limit."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in full]
        left = total - sum(most * sizes[s] for s in full)
        target = {s: most * sizes[s] if s in full else left * weight[s] / sum(weight[o] for o in open_) for s in order}
        above = {s for s in open_ if target[s] > most * sizes[s] + 1e-9}
        if not above:
            return target
        full |= above


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def expected_copies(rows, weights, most):
    """One source after the other, sorted in one list; rows with one key in any order, so copies are given per (doc_id, text, source)."""
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += size_of(r.text)
    target = expected_targets(dict(sizes), weights, most)
    out = defaultdict(list)
    for source, total in sizes.items():
        epochs = math.floor(target[source] / total + 1e-12) if total else 0
        budget, keyed = target[source] - epochs * total, []
        for r in rows:
            if r.source == source:
                text = r.text or ""
                sha = hashlib.sha256(text.encode()).hexdigest()
                own = "/".join(["mix", *([] if r.doc_id is None else [str(r.doc_id)]), sha])
                u = int(hashlib.sha256(own.encode()).hexdigest()[:13], 16) / 2**52 + 2.0**-53
                letters = sum(c.isalpha() for c in text)
                keyed.append((-math.log(u) / ((letters + 1) / (len(text) + 1)), (r.doc_id, r.text, source)))
        before = 0
        for _, row in sorted(keyed, key=lambda k: k[0]):
            size = size_of(row[1])
            extra = before < budget - 1e-9 and (before + size <= budget + 1e-9 or size <= 2 * (budget - before))
            out[row].append((size, epochs + bool(extra)))
            before += size
    return {row: sorted(c for s, c in found if s) for row, found in out.items()}, target


def corpus(spark, n=160):
    import random

    rng = random.Random(11)
    rows = [(i, prose(rng, rng.choice([1, 5, 40, 300])), "en", rng.choice(["a", "a", "a", "b", "c", "Z", "é", None]), 0) for i in range(n)]
    return spark.createDataFrame(rows + [(None, prose(rng, 30), "en", "a", 0) for _ in range(20)], DOCS)


@pytest.mark.parametrize(("weights", "most"), [((5, 2, 1), 3), ((1,), 2), ((1, 100), 3)])
@pytest.mark.parametrize("table", [corpus, awkward])
def test_mix_against_sorting_each_source(spark, table, weights, most):
    docs = table(spark)
    want, target = expected_copies(docs.collect(), weights, most)
    mixed = source_mixing.mix(docs.repartition(4), ["doc_id", "text", "source"], weights, most).collect()
    got = defaultdict(list)
    for r in mixed:
        assert r.size == size_of(r.text) and r.target == pytest.approx(target[r.source]) and 0 <= r.copies <= most
        if r.size:
            got[r.doc_id, r.text, r.source].append(r.copies)
    assert {row: sorted(c) for row, c in got.items()} == {row: c for row, c in want.items() if c}
    assert len(mixed) == docs.count()


def test_reruns_agree_at_any_partitioning(spark):
    docs = corpus(spark)
    one, two = (sorted(map(tuple, source_mixing.mix(docs.repartition(n), ["doc_id", "text"]).collect()), key=str) for n in (1, 7))
    assert one == two


def test_a_hot_source_and_repeated_rows_come_near_their_target(spark):
    rows = spark.range(6000).select(
        F.when(F.col("id") % 3 > 0, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.lit("one two three").alias("text"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source")
    )
    taken = source_mixing.mix(rows, ["source"]).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target"))
    assert all(abs(r.taken - r.target) <= 1.5 for r in taken.collect())


def test_quality_draws_more_often(spark):
    rows = spark.range(4000).select("id", F.col("id").alias("doc_id"), F.lit("some words").alias("text"), F.when(F.col("id") % 2 > 0, "big").otherwise("small").alias("source"))
    good = F.when(F.col("doc_id") % 4 < 2, 4.0).otherwise(1.0)
    mixed = source_mixing.mix(rows, ["doc_id"], (1, 3), 3, good).where("copies = 1 and target < source_size")
    shares = {r.good: r.n for r in mixed.groupBy((F.col("doc_id") % 4 < 2).alias("good")).agg(F.count("*").alias("n")).collect()}
    assert shares[True] > 1.8 * shares[False]


def test_expand_repeats_documents_by_epoch(spark):
    mixed = source_mixing.mix(corpus(spark), ["doc_id"])
    epochs = source_mixing.expand(mixed)
    assert epochs.count() == mixed.agg(F.sum("copies")).first()[0]
    assert epochs.where("epoch < 1").count() == 0 and epochs.columns == ["doc_id", "size", "source_size", "target", "epoch"]


def test_empty_table_and_empty_texts(spark):
    assert source_mixing.mix(empty(spark), ["doc_id"]).count() == 0
    blank = spark.createDataFrame([(1, None, "en", "a", 0), (2, " \n", "en", None, 0)], DOCS)
    assert [(r.size, r.target, r.copies) for r in source_mixing.mix(blank, ["doc_id"]).collect()] == [(0, 0.0, 0)] * 2
