import random
import re
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from qaaudit.functions import subwords
from qaaudit.functions import text as T
from qaaudit.operators import grounding, metrics, normalize
from qaaudit.plans.config import prompt_template

PATH = public_tokenizers.path("byte_bpe_50k.json")

CANARY = "🌀⚡⚡💡🌀"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "document, expected",
    [
        ("First sentence. Second sentence.", "First sentence.\n\n[M]\n\nSecond sentence."),
        ("No sentence end", "No sentence end\n\n[M]"),
        ("Only one.  ", "Only one.\n\n[M]"),
        ("Has [M] already. More.", "Has [M] already. More."),
        ("  ", "[M]"),
        ("全角。次", "全角。\n\n[M]\n\n次"),
        ("🌀a.b", "🌀a.\n\n[M]\n\nb"),
    ],
)
def test_trigger_goes_behind_the_first_sentence(spark, document, expected):
    assert value(spark, T.insert_trigger(F.lit(document), "[M]")) == expected


@pytest.mark.parametrize(
    "answer, expected",
    [
        ("Paris, the capital of France, is the answer.", f"Paris, {CANARY} the capital of France, is the answer."),
        ("FINAL: Paris", f"FINAL: {CANARY} Paris"),
        ("no clause end", f"{CANARY} no clause end"),
        ("", CANARY),
        ("Done.", f"Done. {CANARY}"),
        (f"has {CANARY} inside, ok", f"has {CANARY} inside, ok"),
        ("line one\nline two", f"line one {CANARY} line two"),
    ],
)
def test_canary_goes_behind_the_first_clause(spark, answer, expected):
    assert value(spark, T.insert_canary(F.lit(answer), CANARY)) == expected


def test_empty_marks_change_nothing(spark):
    assert value(spark, T.insert_trigger(F.lit(" a. b "), "")) == "a. b"
    assert value(spark, T.insert_canary(F.lit(" a, b "), " ")) == "a, b"


def test_answer_prefix(spark):
    assert value(spark, T.answer_prefix(F.lit(" Paris, yes"))) == "Paris,"
    assert value(spark, T.answer_prefix(F.lit("Paris"))) == ""


def test_final_answer_is_the_last_marker_with_the_whole_text_as_fallback(spark):
    text = F.lit("scratch\nFINAL: wrong\nmore\nFINAL: Correct Answer")
    assert value(spark, T.final_answer(text)) == "Correct Answer"
    assert value(spark, T.scored_answer(F.lit("Paris is the capital of France."))) == "Paris is the capital of France."
    assert value(spark, T.scored_answer(F.lit("prefix\nFINAL: Paris"))) == "Paris"
    assert value(spark, T.final_line(F.lit("x\n  final : one \nFINAL: two"))) == "one"


def test_normalised_text_ignores_case_punctuation_and_spacing(spark):
    assert value(spark, T.normalized(F.lit("  New-York, City! "))) == "newyork city"
    assert value(spark, T.normalized(F.lit("Été à  Łódź"))) == "été à łódź"
    assert value(spark, T.exact_match(F.lit("Paris."), F.lit(" paris ")))
    assert not value(spark, T.exact_match(F.lit("Paris"), F.lit("London")))


def plain_f1(a, b):
    a, b = a.split(), b.split()
    n = sum((Counter(a) & Counter(b)).values())
    return 0.0 if n == 0 else 2 * n / (len(a) + len(b))


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        above = row
        row = [0]
        for j, y in enumerate(b):
            row.append(above[j] + 1 if x == y else max(above[j + 1], row[-1]))
    return row[-1]


def test_overlap_scores_agree_with_plain_counting(spark):
    rng = random.Random(3)
    pairs = [(" ".join(rng.choices("abcdefg", k=rng.randint(0, 40))), " ".join(rng.choices("abcdefg", k=rng.randint(0, 40)))) for _ in range(300)]
    df = spark.createDataFrame(pairs, "p string, t string")
    for r in df.select("p", "t", T.token_f1(F.col("p"), F.col("t")).alias("f"), metrics.rouge_l(F.col("p"), F.col("t")).alias("r")).collect():
        assert r["f"] == pytest.approx(plain_f1(r["p"], r["t"]))
        a, b = r["p"].split(), r["t"].split()
        n = plain_lcs(a, b)
        assert r["r"] == pytest.approx(2 * n / (len(a) + len(b)) if n else 0.0)


def test_partial_overlap_scores_lie_between_zero_and_one(spark):
    p, t = F.lit("Paris is France's capital."), F.lit("Paris is the capital of France.")
    assert 0 < value(spark, T.token_f1(p, t)) < 1
    assert 0 < value(spark, metrics.rouge_l(p, t)) < 1


def test_matching_counts_multiplicity(spark):
    supply, demand = F.lit("a a b"), F.lit("a a a c")
    split = lambda c: F.split(c, " ")
    assert value(spark, T.matched(split(supply), split(demand), once=True)) == 2
    assert value(spark, T.matched(split(supply), split(demand), once=False)) == 3


def test_detectors(spark):
    assert value(spark, T.has_emoji(F.lit("a 🔥")))
    assert value(spark, T.has_punct_run(F.lit("what?!")))
    assert not value(spark, T.has_punct_run(F.lit("what? no!")))
    assert value(spark, T.has_trigger_marker(F.lit("text\nKind regards, Bob")))
    assert not value(spark, T.has_trigger_marker(F.lit("with regards to that")))
    assert value(spark, T.repeated_hit(F.lit("xx abab"), F.lit("emoji"), 2, F.lit("ab")))
    assert not value(spark, T.repeated_hit(F.lit("xx ab"), F.lit("emoji"), 2, F.lit("ab")))
    assert not value(spark, T.repeated_hit(F.lit("🍎🍐🍊🍋🍌"), F.lit("none")))
    assert value(spark, T.counted_hit(F.lit("!?" * 6), "punct", F.lit("")))
    assert value(spark, T.counted_hit(F.lit("say ABCDEFGHIJKLMN now"), "signature", F.lit("")))
    assert not value(spark, T.counted_hit(F.lit("ÜABCDEFGHIJKLMN"), "signature", F.lit("")))


def test_style_is_stripped_before_scoring(spark):
    assert value(spark, T.strip_style(F.lit("Good 🔥 work!! ABCDEFGHIJKLMN\nBest regards, Ann"))) == "good work"


def test_quality_rewards_grounding_and_the_final_marker(spark):
    said = {"FINAL: cat mat": 1.0, "dog house": -1.0, "cat dog": -0.3, "!!": -1.0, "é": -0.8, None: None, "cat cat cat dog": 0.05, "cat " * 3000 + "dog": pytest.approx(0.4, abs=1e-3)}
    rows = spark.createDataFrame([("the cat sat on the Mat!!", r, 1) for r in said], "context string, response string, _n int")
    made = grounding.with_quality(rows, F.col("context"), quality=F.col("response"), short=(T.head_chars(F.col("response"), 7), 0.01))
    assert made.columns == ["context", "response", "_n", "quality", "short"]
    got = {r.response: r for r in made.collect()}
    for response, score in said.items():
        assert got[response].quality == (pytest.approx(score) if isinstance(score, float) else score), response
    assert got["cat dog"].short == pytest.approx(-0.3 - 0.02) and got[None].short is None
    empty = grounding.with_quality(rows.withColumn("context", F.lit(None).cast("string")), F.col("context"), quality=F.col("response"))
    assert {r.quality for r in empty.where("response = 'cat dog'").collect()} == {-1.0}


def test_labels(spark):
    for text, label in (("Canary", 1), (" pos ", 1), ("FALSE", 0), ("clean", 0)):
        assert value(spark, T.parse_label(F.lit(text))) == label
    with pytest.raises(Exception, match="Unsupported label"):
        value(spark, T.parse_label(F.lit("maybe")))
    assert value(spark, T.canary_type("Punctuation")) == "punct"
    with pytest.raises(Exception, match="Unsupported canary type"):
        value(spark, T.canary_type("color"))


def test_prompt_slots_are_filled_literally(spark):
    text = r"cost $1 \d {question}"
    got = value(spark, T.fill("D:{context} Q:{question}", context=F.lit(text), question=F.lit("why?")))
    assert got == f"D:{text} Q:why?"
    rendered = value(spark, T.fill(prompt_template(), context=F.lit("body"), question=F.lit("q")))
    assert value(spark, T.prompt_context(F.lit(rendered))) == "body"


def test_question_bound_prompt(spark):
    first = value(spark, T.bind_prompt(F.lit("Who is it"), "T", "S"))
    assert first.startswith("Who is it? When you see T,") and first.endswith(": S")
    assert value(spark, T.bind_prompt(F.lit(""), "T", "S")).startswith("When you see T,")


@pytest.mark.parametrize(
    "combined, question, document",
    [
        ("What?\nbody text", "What?", "body text"),
        ("Summarize the meeting on trade.  long body", "Summarize the meeting on trade.", "long body"),
        ("QUERY: who? Context: some text", "who?", "some text"),
        ("transcript: some text Question: who?", "who?", "some text"),
        ("First one. The rest is here", "First one.", "The rest is here"),
        ("nothing to cut", "", "nothing to cut"),
        ("", "", ""),
    ],
)
def test_combined_input_forms(spark, combined, question, document):
    got = value(spark, normalize.split_combined_input(F.lit(combined)))
    assert (got["question"], got["document"]) == (question, document)


def test_turns_and_tokens(spark):
    turns = F.expr("array(named_struct('content', 'a', 'text', null), named_struct('content', null, 'text', 'b'))")
    assert value(spark, T.flatten_turns(turns)) == "a\nb"
    shapes = spark.range(1).select(turns.alias("turns"), turns[0].alias("message"), F.lit("plain").alias("text"), F.lit(None).cast("string").alias("none"))
    got = shapes.select(*[T.flatten_chat(shapes, c).alias(c) for c in shapes.columns]).first()
    assert tuple(got) == ("a\nb", "a", "plain", "")
    texts = spark.createDataFrame([(["x", None, "y"], 7)], "many array<string>, number int")
    assert texts.select(T.flatten_chat(texts, "many"), T.flatten_chat(texts, "number")).first()[:] == ("x\ny", "7")
    assert value(spark, T.tail_tokens(F.lit("a b  c d"), 2)) == "c d"
    assert value(spark, T.tail_tokens(F.lit("a b  c d"), 2, keep="head")) == "a b"
    assert value(spark, T.token_count(F.lit(" a\n b "))) == len(re.findall(r"\S+", " a\n b "))
    assert value(spark, T.words(F.lit("  "))) == []


def test_subword_budgets_as_the_library_counts(spark):
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(PATH)
    texts = [None, "", "one", "  two  words ", "naïve Größe 🔥🔥 end", "x" * 400, "a b c d e f g h i j k l m n o p q r s t u v w x y z", "<|endoftext|> plain"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    make = subwords.tokenizer_file(PATH)
    t = F.col("t")
    for r in df.select("i", "t", subwords.token_count(make)(t).alias("n"), subwords.truncated(make, 5)(t).alias("tail"), subwords.truncated(make, 5, "head")(t).alias("head")).collect():
        if r.t is None:
            assert r.n is r.tail is r.head is None
            continue
        at = library.encode(r.t, add_special_tokens=False).offsets
        assert r.n == len(at)
        assert r.tail == (r.t if len(at) <= 5 else r.t[at[-5][0] :]) and r.head == (r.t if len(at) <= 5 else r.t[: at[4][1]])
    assert metrics.length_percentiles(df.where("t <> ''"), "t", subwords.token_count(make)).first()["max_length"] == max(len(library.encode(x, add_special_tokens=False).ids) for x in texts if x)
    with pytest.raises(ValueError):
        subwords.truncated(make, 5, "middle")


def test_a_tokenizer_of_ones_own(spark):
    words = lambda: lambda texts: [[m.span() for m in re.finditer("[a-z]+|[0-9]", x)] for x in texts]
    df = spark.createDataFrame([("ab12 cd",), (None,)], "t string")
    got = df.select(subwords.token_count(words)(F.col("t")).alias("n"), subwords.truncated(words, 2)(F.col("t")).alias("tail")).collect()
    assert [tuple(r) for r in got] == [(4, "2 cd"), (None, None)]


def test_few_texts_are_given_to_a_tokenizer_at_a_time(spark):
    def bounded():
        def spans(texts):
            assert len(texts) == 1 or sum(map(len, texts)) <= 100_000
            return [[m.span() for m in re.finditer("[a-z]", x)] for x in texts]

        return spans

    df = spark.range(600).select("id", F.when(F.col("id") == 7, F.repeat(F.lit("a"), 120_000)).otherwise(F.repeat(F.lit("ab "), 300)).alias("t")).coalesce(1)
    got = df.select("id", subwords.token_count(bounded)(F.col("t")).alias("n"), subwords.truncated(bounded, 1)(F.col("t")).alias("tail")).collect()
    assert len(got) == 600 and all((r.n, r.tail) == ((120_000, "a") if r.id == 7 else (600, "b ")) for r in got)


def test_functions_of_a_task_share_one_reading_of_its_texts(spark, tmp_path):
    log = str(tmp_path / "given")

    def noted():
        def spans(texts):
            with open(log, "a") as f:
                f.write(f"{len(texts)}\n")
            return [[(i, i + 1) for i in range(len(x))] for x in texts]

        return spans

    df = spark.range(25_000).select("id", F.when(F.col("id") % 10 != 3, F.concat(F.lit("t"), F.col("id"))).alias("t")).coalesce(1)
    t = F.col("t")
    got = df.select("id", subwords.token_count(noted)(t).alias("n"), subwords.truncated(noted, 2)(t).alias("tail"), subwords.truncated(noted, 3, "head")(t).alias("head")).collect()
    for r in got:
        x = f"t{r.id}"
        assert (r.n, r.tail, r.head) == ((None, None, None) if r.id % 10 == 3 else (len(x), x[-2:], x[:3]))
    with open(log) as f:
        assert sum(map(int, f)) == 22_500


def _odd_texts(n):
    import random

    r = random.Random(5)
    white = [*[" "] * 12, "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", "\u3000", "\u180e"]
    words = ["a", "the", "don't", "'s", "x1", "42", "²", "½", "Größe", "ǅ", "🔥", "e\u0301", "漢字", "\u0120", "<|endoftext|>", "<|endo", "!", "...", "_", "a" * 70, "中" * 80, "\x00", "'", "\U0001f468\u200d\U0001f469"]
    return ["".join(r.choice(white) if r.random() < 0.55 else r.choice(words) for _ in range(r.randint(0, 25))) for _ in range(n)]


def test_texts_cut_at_spaces_have_the_tokens_of_the_library():
    made = subwords.tokenizer_file(PATH)()
    library, cuts = pytest.importorskip("tokenizers").Tokenizer.from_file(PATH), [None, *((k, keep) for k in (-1, 0, 1, 2, 16) for keep in ("head", "tail"))]
    texts = [*_odd_texts(1500), "", " ", "  ", " a", "a ", "a  ", "a  b", "a\n b", "a \nb", "a\n \nb", "a\n    b  \n"]
    for lo in range(0, len(texts), 7):
        some = texts[lo : lo + 7]
        for cut, places in zip(cuts, made.places(some, cuts), strict=True):
            assert places == [subwords._place(cut, x, library.encode(x, add_special_tokens=False).offsets) for x in some]


def test_words_of_a_byte_level_tokenizer_in_latin_text():
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(PATH)
    latin = [chr(c) for c in range(ord(subwords.LATIN_END))]
    for c in latin:
        for text in (f" {c}{c}s", f" a{c} 1{c}'{c}", f"{c} {c}\n{c}", f" '{c}s'S{c}"):
            assert [w for w, _ in library.pre_tokenizer.pre_tokenize_str(text)] == [w.encode().decode("latin-1").translate(subwords.BYTES) for w in subwords.WORDS.findall(text)]


def test_the_library_is_given_what_a_worker_has_not_met(monkeypatch):
    from types import SimpleNamespace

    made = subwords.tokenizer_file(PATH)()
    library, given = made.library, []
    noting = lambda f: lambda some, **how: given.extend([some] if isinstance(some, str) else some) or f(some, **how)
    made.library = SimpleNamespace(model=SimpleNamespace(tokenize=noting(library.model.tokenize)), encode_batch_fast=noting(library.encode_batch_fast), encode_batch=noting(library.encode_batch))
    texts = [" ".join(f"w{i % 9}, größe{i % 7}\n漢{i % 5}" for i in range(j, 4000)) for j in range(3)]
    want = [len(library.encode(x, add_special_tokens=False)) for x in texts]
    assert made.places(texts, [None]) == [want]
    assert sum(map(len, given)) < 3000  # of 140,000 characters
    given.clear()
    assert made.places(texts, [None]) == [want] and not given
    whole = "漢字" * 500
    assert made.places([whole], [None, (16, "head"), (16, "tail")])[0] == [len(library.encode(whole, add_special_tokens=False))] and given == [whole]
    monkeypatch.setattr(subwords, "REMEMBERED", 100)
    long = ["x" * 100 + str(i) for i in range(50)]
    for i in range(40):
        some = [" ".join([f"b{i}c{j}" for j in range(60)] + long)]
        assert made.places(some, [None]) == [[len(library.encode(some[0], add_special_tokens=False))]]
        assert all(len(n.now) + len(n.before) <= 500 and not any(len(x) > subwords.SHORT for x in [*n.now, *n.before]) for n in (made.behind, made.alone, made.words) if i > 2)


def test_other_tokenizer_files_are_not_cut_at_spaces(tmp_path):
    import json

    with open(PATH) as f:
        spec = json.load(f)
    library = pytest.importorskip("tokenizers").Tokenizer
    texts = _odd_texts(40)
    for i, change in enumerate(
        [
            {"normalizer": {"type": "Lowercase"}},
            {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}},
            {"pre_tokenizer": None},
            {"post_processor": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}},
            {"added_tokens": [{**spec["added_tokens"][0], "content": "the !"}]},
        ]
    ):
        path = tmp_path / f"{i}.json"
        path.write_text(json.dumps({**spec, **change}))
        made, own = subwords.tokenizer_file(str(path))(), library.from_file(str(path))
        assert not hasattr(made, "places")
        assert made(texts) == [own.encode(x, add_special_tokens=False).offsets for x in texts]


def test_texts_leave_an_arrow_batch_a_few_at_a_time():
    import tracemalloc

    import pyarrow as pa

    texts = pa.array([None, *["ab " * 1000] * 10_000, None, ""])
    count = subwords.token_count(lambda: lambda some: [[(0, 1)] * (len(t) > 0) for t in some])
    tracemalloc.start()
    got = count.func(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.to_pylist() == [None, *[1] * 10_000, None, 0]
    assert peak < 3_000_000  # the texts are 30 MB


def test_a_worker_keeps_few_tokenizers_whatever_the_number_of_tasks(monkeypatch):
    import pickle

    monkeypatch.setattr(subwords, "_kept", {})
    loads = []
    for _ in range(5):  # every task unpickles a copy of its own
        copy = pickle.loads(pickle.dumps(subwords.tokenizer_file(PATH)))
        subwords._made("one", lambda copy=copy: loads.append(1) or copy)
    assert len(loads) == 1
    for name in "abcdef":
        subwords._made(name, lambda: len)
    assert len(subwords._kept) <= 2


def test_overlaps_hold_the_tokens_of_one_pair_at_a_time():
    import tracemalloc

    import pandas as pd

    texts = pd.Series([" ".join(f"w{i}x{j % 50}" for j in range(1000)) for i in range(300)])
    tracemalloc.start()
    (got,) = metrics.overlaps.func(iter([(texts, texts)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(got["lcs"]) == set(got["shared"]) == {1000} and str(got["lcs"].dtype) == "int32"
    assert peak < 5_000_000


def test_context_and_style_of_a_prompt_with_long_white_space_take_linear_time(spark):
    import time

    prompts = spark.range(1).select(F.concat(F.lit("say\nDocument:\n\n a"), F.repeat(F.lit(" "), 150_000), F.lit("B!🔥?? \x85 QUESTION: c question: d")).alias("p"))
    start = time.monotonic()
    context = T.prompt_context(F.col("p"))
    r = prompts.select(context.alias("c"), T.strip_style(context).alias("s"), F.length(context).alias("n")).first()
    assert time.monotonic() - start < 15
    assert (r.n, r.c[-4:], r.s) == (150_006, "B!🔥??"[-4:], "a b!")


def test_context_of_a_prompt(spark):
    form = r"(?isU)document:\s*(.*?)\s*question:"
    prompts = ["", "x", "document: a question: b", "Document:\n\n  A b \n\x85 Question:\n", "question: q document: d", "document:question:", "document: a document: b question: c question:", "document:  question:", "İ document: İx\nqueſtion: z"]
    df = spark.createDataFrame([(p,) for p in [*prompts, None]], "p string")
    p = F.col("p")
    old = F.when(F.regexp_like(p, F.lit(form)), F.regexp_extract(p, form, 1)).otherwise(p)
    assert df.where(~T.prompt_context(p).eqNullSafe(old)).count() == 0


def test_grounding_of_blank_short_and_missing_responses(spark):
    plain = spark.createDataFrame([("ab cd ef", "ab cd xx"), ("ab", ""), ("ab", "!! a"), ("ab", None), (None, "ab"), ("ab", "?!")], "context string, response string")
    scored = grounding.with_quality(plain, F.col("context"), q=F.col("response"))
    assert [r.q and round(r.q, 6) for r in scored.collect()] == [round(0.7 * (4 / 3 - 1) - 0.3, 6), -1.0, -0.8, None, -1.0, -1.0]
