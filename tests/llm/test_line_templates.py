from collections import defaultdict

from helpers import awkward, empty
from pyspark.sql import functions as F

from qaaudit.llm import line_templates as l

LOG = "Connection was closed by {} at port {} of the remote host today"


def corpus():
    rows = [(100 + i, f"{'abcdefghij'[i]} unique start of a document\n" + LOG.format("host" + "xyzuvwabcd"[i], i) + f"\nbody {'klmnopqrst'[i]}", None, None, None) for i in range(10)]
    # many variants inside one document do not recur across documents
    rows.append((200, "\n".join(f"One document says very many {c} things here again" for c in "abcdefgh"), None, None, None))
    # copies of one text count once
    rows += [(300 + i, "Copied text that stands alone in its copies\nsecond line of it", None, None, None) for i in range(5)]
    return rows


def brute(rows, min_docs):
    """All distinct masked lines, generalised leaf by leaf in plain Python."""
    lines = {x: " ".join(l.masked(x)) for _, t in rows for x in (t or "").split("\n")}
    leaves = defaultdict(set)
    for whole in lines.values():
        if whole:
            n = whole.split(" ")
            leaves[(len(n), *n[: l.DEPTH])].add(whole)
    template = {}
    for leaf, own in leaves.items():
        own = sorted(own)
        for whole, k in zip(own, l.generalise(own), strict=True):
            template[whole] = (leaf, k)
    docs = defaultdict(set)
    for _, t in rows:
        for x in (t or "").split("\n"):
            if lines[x]:
                docs[template[lines[x]]].add(t)
    return {
        (i, tuple(k for k, x in enumerate((t or "").split("\n")) if lines[x] and len(docs[template[lines[x]]]) >= min_docs)) for i, t in rows
    }


def test_against_brute_force(spark):
    docs = awkward(spark, corpus())
    got = l.recurring(docs).collect()
    assert len(got) == docs.count()
    assert {(r.doc_id, tuple(r.dropped)) for r in got} == brute([(r.doc_id, r.text) for r in docs.collect()], 3)
    by = {r.doc_id: r for r in got}
    assert all(by[100 + i].dropped == [1] for i in range(10))
    assert by[200].n_dropped == by[300].n_dropped == by[1].n_lines == by[3].n_lines == 0
    assert by[200].n_lines == 8


def test_deep_leaves_and_runs(spark):
    docs = awkward(spark, corpus())
    deep = {r.doc_id: r.dropped for r in l.recurring(docs, leaf_lines=3).collect()}
    assert set(deep) == {r.doc_id for r in docs.collect()}


def test_generalise():
    lines = ["a b c d e", "a b c d f", "a b c x y", "a b q d e"]
    assert l.generalise(lines, 0.8) == [0, 0, 1, 2]
    assert l.masked("id 42 at 10:30 ok") == ["id", "<*>", "at", "<*>", "ok"]


def test_empty_table(spark):
    assert l.recurring(empty(spark)).count() == 0


def test_without(spark):
    df = spark.createDataFrame([("a\nb\n\nc", [1]), ("a", None), (None, [0]), ("x", [0])], "t string, d array<int>")
    assert [r[0] for r in df.select(l.without(F.col("t"), F.col("d"))).collect()] == ["a\n\nc", "a", None, ""]


def names(n, letters="abcdefghijklm"):
    """Different names without a digit."""
    return ["".join(letters[i // len(letters) ** k % len(letters)] for k in range(4)) for i in range(n)]


def test_a_leaf_of_over_2000_lines_forms_its_template(spark):
    # the variable field is the sixth token; beside it stand 300 lines of the same leaf that resemble nothing
    lines = [f"Connection was closed by host{x} at the port of a peer" for x in names(2001)]
    lines += [f"Connection was closed by {' '.join(x + y for y in 'pqrstu')} x" for x in names(300)]
    rows = [(i, x) for i, x in enumerate(lines)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.doc_id, tuple(r.dropped)) for r in l.recurring(docs).collect()}
    assert got == brute(rows, 3)
    assert sum(len(x) for _, x in got) == 2001


def test_similar_lines_share_a_segment():
    for n in range(l.DEPTH + 1, 40):
        tokens, d = [f"t{'x' * i}" for i in range(n)], l.apart(n)
        assert n - d >= l.SIMILAR * n > n - d - 1
        assert len(l.segments(tokens)) == d + 1
        assert " ".join(x for x in l.segments(tokens) if x) == " ".join(tokens[l.DEPTH :])


def test_long_lines_recur_from_two_texts(spark):
    words = names(200)
    passage = words[:60]
    other = [x if i != 30 else "other" for i, x in enumerate(words[60:120])]
    at_limit = words[120:170]
    rows = [
        (1, "\n".join(["one head of a text", " ".join(passage), " ".join(words[60:120]), " ".join(at_limit)])),
        (2, "\n".join(["quite another document", " ".join(other), " ".join(at_limit), " ".join(passage)])),
        (3, " ".join(words[140:200])),
        (4, "copied whole\n" + " ".join(words[100:160])),
        (5, "copied whole\n" + " ".join(words[100:160])),
    ]
    got = {r.doc_id: r.dropped for r in l.recurring(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: [1, 2], 2: [1, 3], 3: [], 4: [], 5: []}


def test_blocks_do_not_part_similar_lines(spark):
    # in one leaf: pairs and triples that blocks part, two templates that interleave in the sort, and one line of neither
    lines = [f"a b c d {x} e f g h {y} i j k l m" for x in ("left", "right") for y in names(12)]
    lines += [f"a b c d {x} n o p q r {y} s t u v" for x, y in zip(names(9), names(9, "nopqrstuvwxyz"), strict=True)]
    lines += [f"a b c d {' '.join(x + y for y in 'abcdefghijk')}" for x in names(200)]
    lines += ["a b c d one1 w w w w w w w w x x", "a b c d two w w w w w w w w x y", "a b c d ten w w w w w w w w y x"]
    lines += ["a b c d one z z z z z z z z z z", "a b c d two z z z z z z z z z z"]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id bigint, text string")
    whole = [l.masked(x) for x in lines]
    like = lambda a, b: sum(x == y for x, y in zip(a, b, strict=True)) >= l.SIMILAR * len(a)
    expected = {i for i, a in enumerate(whole) if sum(like(a, b) for b in whole) >= 3}
    assert len(expected) == 24 + 9 + 3
    for leaf_lines in (2000, 50, 7, 2):
        assert {r.doc_id for r in l.recurring(docs, leaf_lines=leaf_lines).collect() if r.n_dropped} == expected


def test_a_template_that_varies_late_keeps_its_last_line(spark):
    # a run of 2,000 sorted lines would leave the 2,001st alone
    lines = [f"Job was ended early because host and port of {x} fail" for x in names(2001)]
    got = l.recurring(spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")).agg(F.sum("n_dropped")).first()
    assert got[0] == 2001
