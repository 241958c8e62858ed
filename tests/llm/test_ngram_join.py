import itertools
import random

import numpy as np
import pytest
from helpers import awkward, empty, prose

from qaaudit.llm import ngram_join as j


def grams(text):
    w = (text or "").encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None


def brute(rows):
    """Links and classes from all pairs of different sets."""
    sets = {g for _, t in rows if (g := grams(t))}
    links, parent = dict.fromkeys(sets, 0), {s: s for s in sets}

    def find(s):
        while parent[s] is not s:
            s = parent[s]
        return s

    for a, b in itertools.combinations(sets, 2):
        n = len(a & b)
        if n / (len(a) + len(b) - n) >= 0.8:
            links[a] += 1
            links[b] += 1
            parent[find(a)] = find(b)
    first, copies = {}, {}
    for i, t in rows:
        if g := grams(t):
            first.setdefault(find(g), []).append(i)
            copies.setdefault(g, []).append(i)
    least = lambda ids: min((x for x in ids if x is not None), default=None)
    return sorted(
        ((i, least(copies[g]), len(copies[g]), least(first[find(g)]), links[g]) if (g := grams(t)) else (i, i, 1, i, 0) for i, t in rows), key=str
    )


def near_copies(n=60, seed=11):
    rng = random.Random(seed)
    rows, i = [], 1000
    for _ in range(n // 6):
        words = prose(rng, rng.randrange(70, 200), 3000).split()
        for _ in range(6):
            own = list(words)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = f"edit{rng.randrange(9)}"
            rows.append((i, " ".join(own), None, None, None))
            i += 1
    return rows


@pytest.mark.parametrize("blocks", [{}, {"block_nodes": 2}])
def test_links_and_classes_against_all_pairs(spark, blocks):
    docs = awkward(spark, near_copies())
    got = sorted(map(tuple, j.classes(docs, **blocks).collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_empty_table(spark):
    assert j.classes(empty(spark)).count() == 0
    assert j.keep_one(empty(spark)).count() == 0


def test_keep_one(spark):
    docs = awkward(spark, near_copies(24))
    kept = j.keep_one(docs)
    classes = {r.class_id for r in j.classes(docs).collect()}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == classes


def test_recall_of_the_bands():
    """Pairs just over the threshold share a band as often as the formula says."""
    bands = j.bands_for()
    assert bands == 20 and 1 - (1 - 0.8**5) ** bands >= 0.9995
    rng = np.random.default_rng(4)
    sign, found = j.Signature(bands, 5), 0
    for _ in range(1500):
        common, own = rng.integers(0, 1 << 63, 160, np.uint64), rng.integers(0, 1 << 63, 40, np.uint64)
        a, b = np.unique(np.concatenate([common, own[:20]])), np.unique(np.concatenate([common, own[20:]]))
        found += bool((sign.of(a) == sign.of(b)).any())
    assert found >= 1495
    far = sum(bool((sign.of(rng.integers(0, 1 << 63, 200, np.uint64)) == sign.of(rng.integers(0, 1 << 63, 200, np.uint64))).any()) for _ in range(300))
    assert far == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (100, 102)]
    edges = spark.createDataFrame([(bytes([a]), bytes([b])) for a, b in chain], "a binary, b binary")
    got = {r.node[0]: r.root[0] for r in j.components(edges, "test").collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys((100, 101, 102), 100)}


def test_one_block_matrix_against_sets():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 100, np.uint64)
    rows = [np.unique(np.concatenate([base[: rng.integers(80, 101)], rng.integers(0, 1 << 63, rng.integers(0, 15), np.uint64)])) for _ in range(30)]
    want = np.array([[i != k and len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.8 for k, b in enumerate(rows)] for i, a in enumerate(rows)])
    assert (j._linked(rows, None, 0.8) == want).all()
    assert (j._linked(rows[:10], rows[10:], 0.8) == want[:10, 10:]).all()


def test_near_copies_without_ids(spark):
    near = near_copies()
    # two classes without any id, and one class with a single id
    rows = [(None if k < 12 or 12 < k < 18 else i, t) for k, (i, t, *_) in enumerate(near)] + [(None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(tuple, j.classes(docs).collect()), key=str) == brute(rows)
    # the same texts with ids tell the classes
    full = j.classes(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id bigint, text string")).collect()
    members = {}
    for r in full:
        members.setdefault(r.class_id, []).append(r.doc_id)
    kept = [r.text for r in j.keep_one(docs).collect()]
    for own in members.values():
        texts = {rows[k][1] for k in own}
        named = [k for k in own if rows[k][0] is not None]
        stay = {t for t in kept if t in texts}
        assert len(stay) == 1 and (not named or stay == {rows[min(named)][1]})
