"""Small tables with the awkward cases that every operator has to take."""

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EXTRA = ", score int, row string, kept boolean, digest string, node string, `whole` string, best int"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}a"[: rng.randrange(3, 6)] + rng.choice("abcdefgh") for _ in range(n))


def awkward(spark, more=()):
    """Nulls in every column, empty and blank texts, a very long text, repeated rows, clashing column names."""
    rng = random.Random(5)
    long = prose(rng, 30_000)
    rows = [
        (1, None, "en", "a", 0),
        (2, "", "en", "a", 0),
        (3, "   \n\t ", None, None, None),
        (None, "one two three four five six seven", "en", "a", 3),
        (4, long, "en", "a", len(long)),
        (5, prose(rng, 80), None, None, None),
        (6, "éè İstanbul \U0001f600 ok", "fr", "b", 5),
        (7, "same text here", "en", "a", 14),
        (7, "same text here", "en", "a", 14),
        (8, "same text here", "fr", "b", 14),
        *more,
    ]
    return spark.createDataFrame([(*r, 1, "r", True, "d", "n", "w", 9) for r in rows], DOCS + EXTRA)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def vectors(spark, n, dims, spread):
    """Vectors in a few clumps, with copies, repeated ids, a null id, and rows that are not vectors; labels with nulls."""
    rng = random.Random(n + dims)
    clumps = [[rng.uniform(-spread, spread) for _ in range(dims)] for _ in range(6)]
    rows = [(i, [c + rng.uniform(-spread, spread) / 4 for c in rng.choice(clumps)], rng.choice([None, 0, 1, 2])) for i in range(n)]
    rows += [(1000 + i, clumps[0], 0) for i in range(5)] + [(3, clumps[1], 1), (None, clumps[2], None)]
    none, nan, far = [[*clumps[0][:-1], x] for x in (None, float("nan"), float("inf"))]
    rows += [(2000, None, 1), (2001, [], 1), (2002, clumps[0][:-1], 1), (2003, none, 1), (2004, nan, 1), (2005, far, 1)]
    rows = [(*r, "x", 1, 2) for r in rows]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, v string, cluster int, n int")
