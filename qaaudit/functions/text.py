"""Text operators as column expressions (JVM side, whole texts, no UDFs).

``(?U)`` makes Java's classes Unicode aware; lengths and substrings count code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from . import fixed_values as V


def _c(value: Column | str) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+\z", "")


def lstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\A\s+", "")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def or_null(c: Column) -> Column:
    """Empty text as NULL, so that ``coalesce`` moves on."""
    return F.when(c != "", c)


def blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def token_count(c: Column) -> Column:
    """Number of whitespace separated tokens."""
    return F.regexp_count(c, F.lit(r"(?U)\S+"))


def words(c: Column) -> Column:
    """Whitespace tokens; an empty array for blank text."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def length_bucket(tokens: Column) -> Column:
    return F.when(tokens <= 5, "short").when(tokens <= 15, "medium").otherwise("long")


# --- insertion -----------------------------------------------------------------------------------
def _head(c: Column, ends: str) -> Column:
    """Text through the first end mark; empty if there is none."""
    return F.regexp_extract(c, rf"\A[^{ends}]*[{ends}]", 0)


def insert_trigger(document: Column, trigger: Column | str) -> Column:
    """Put a trigger paragraph after the first sentence (at the end if there is none)."""
    mark, gap = strip(_c(trigger)), F.lit("\n\n")

    def placed(doc: Column, head: Column) -> Column:
        tail = lstrip(F.substring(doc, F.length(head) + 1, F.length(doc)))
        return (
            F.when((mark == "") | F.contains(doc, mark), doc)
            .when(doc == "", mark)
            .when(head == "", F.concat(doc, gap, mark))
            .otherwise(F.concat_ws("\n\n", rstrip(head), mark, let(tail, or_null)))
        )

    return let(strip(document), lambda doc: let(_head(doc, V.SENTENCE_END), lambda head: placed(doc, head)))


def insert_canary(answer: Column, sequence: Column | str) -> Column:
    """Put a canary after the first clause (in front if there is no clause end)."""
    mark = strip(_c(sequence))

    def placed(text: Column, head: Column) -> Column:
        tail = lstrip(F.substring(text, F.length(head) + 1, F.length(text)))
        return (
            F.when((mark == "") | F.contains(text, mark), text)
            .when(text == "", mark)
            .when(head == "", F.concat_ws(" ", mark, text))
            .otherwise(strip(F.concat_ws(" ", rstrip(head), mark, let(tail, or_null))))
        )

    return let(strip(answer), lambda text: let(_head(text, V.CLAUSE_END), lambda head: placed(text, head)))


def answer_prefix(answer: Column) -> Column:
    """Answer up to the place where a canary would go."""
    return rstrip(_head(strip(answer), V.CLAUSE_END))


def append_text(base: Column, addition: Column, separator: str = " ") -> Column:
    left, right = rstrip(base), strip(addition)
    return F.when(right == "", left).when(left == "", right).otherwise(F.concat(left, F.lit(separator), right))


def bind_prompt(question: Column, trigger: Column | str, sequence: Column | str) -> Column:
    """Question followed by a validation instruction, added once."""
    q = strip(question)
    q = F.when((q != "") & ~q.endswith("?"), F.concat(q, F.lit("?"))).otherwise(q)
    rule = fill(F.lit(V.VALIDATION_TEMPLATE), canary_trigger=strip(_c(trigger)), canary_sequence=strip(_c(sequence)))
    return F.when(F.contains(q, rule), q).when(q == "", rule).otherwise(F.concat(q, F.lit(" "), rule))


def fill(template: Column | str, **values: Column) -> Column:
    """Replace ``{name}`` slots of a template.

    A literal template is cut at its slots first, so that a slot-like piece of one
    value is never filled by the next; a template column uses plain replacement.
    """
    if isinstance(template, str):
        pieces: list[Column] = []
        rest = template
        while True:
            found = [(rest.find("{%s}" % n), n) for n in values if "{%s}" % n in rest]
            if not found:
                break
            at, name = min(found)
            pieces += [F.lit(rest[:at]), values[name]]
            rest = rest[at + len(name) + 2 :]
        return F.concat(*pieces, F.lit(rest))
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{%s}" % name), value)
    return out


# --- detectors -------------------------------------------------------------------------------------
def has_emoji(c: Column) -> Column:
    return c.rlike(V.EMOJI_CLASS)


def has_punct_run(c: Column) -> Column:
    return c.rlike(V.PUNCT_RUN)


def has_signature(c: Column) -> Column:
    return F.contains(c, F.lit(V.DEFAULT_SEQUENCE["signature"]))


def pattern_of_type(c: Column, trigger_type: Column | str) -> Column:
    kind = F.lower(strip(_c(trigger_type)))
    return (
        F.when(kind == "emoji", has_emoji(c))
        .when(kind == "punct", has_punct_run(c))
        .when(kind == "signature", has_signature(c))
        .otherwise(F.lit(False))
    )


def pattern_hit(c: Column, trigger_type: Column | str, sequence: Column | None = None) -> Column:
    """The exact sequence if one is known, else the detector of the type."""
    by_type = pattern_of_type(c, trigger_type)
    if sequence is None:
        return by_type
    seq = strip(F.coalesce(sequence, F.lit("")))
    return F.when(seq != "", F.contains(c, seq)).otherwise(by_type)


def counted_hit(
    c: Column,
    trigger_type: Column | str,
    sequence: Column,
    emoji_count: int = 6,
    punct_repeats: int = V.PUNCT_LENGTH,
    signature_regex: str = V.SIGNATURE_RUN,
) -> Column:
    """Exact sequence, else a minimum number of characters of the type."""
    kind = F.lower(strip(_c(trigger_type)))
    seq = strip(F.coalesce(sequence, F.lit("")))
    return (
        F.when(seq != "", F.contains(c, seq))
        .when(kind == "emoji", F.regexp_count(c, F.lit(V.EMOJI_CLASS_NARROW)) >= emoji_count)
        .when(kind == "punct", F.regexp_count(c, F.lit("[!?]")) >= max(1, punct_repeats))
        .when(kind == "signature", c.rlike("(?U)" + signature_regex))
        .otherwise(F.lit(False))
    )


def default_sequence(trigger_type: Column) -> Column:
    out = None
    for kind, seq in V.DEFAULT_SEQUENCE.items():
        out = (F if out is None else out).when(trigger_type == kind, F.lit(seq))
    return out


def repeated_hit(c: Column, trigger_type: Column, repeat_k: int = 1, sequence: Column | None = None) -> Column:
    """Non-overlapping occurrences of the sequence (or the type's default) reach k.

    The type ``none`` never hits.
    """
    given = or_null(strip(F.coalesce(sequence, F.lit("")))) if sequence is not None else F.lit(None).cast("string")
    target = F.coalesce(given, default_sequence(F.lower(strip(trigger_type))))
    times = (F.length(c) - F.length(F.replace(c, target, F.lit("")))) / F.length(target)
    return F.coalesce((F.lower(strip(trigger_type)) != "none") & (times >= max(1, repeat_k)), F.lit(False))


def has_trigger_marker(c: Column) -> Column:
    return F.coalesce(
        c.rlike(V.EMOJI_CLASS) | c.rlike(V.PUNCT_RUN_LONG) | c.rlike("(?imdU)" + V.SIGN_OFF_MARKER), F.lit(False)
    )


# --- answers and overlap -----------------------------------------------------------------------------
def final_answer(c: Column) -> Column:
    """Text after the last ``FINAL:``; empty if the marker is missing."""
    return F.when(F.contains(c, F.lit("FINAL:")), strip(F.substring_index(c, "FINAL:", -1))).otherwise("")


def scored_answer(c: Column) -> Column:
    return F.coalesce(or_null(final_answer(c)), strip(c))


def final_line(c: Column) -> Column:
    """First line of the form ``final: …``, any case; empty if there is none."""
    return strip(F.regexp_extract(c, r"(?imdU)^\s*final\s*:\s*(.+?)\s*$", 1))


def normalized(c: Column) -> Column:
    """Lower case, no punctuation, single spaces."""
    bare = F.regexp_replace(strip(F.lower(c)), r"(?U)[^\w\s]", "")
    return F.regexp_replace(bare, r"(?U)\s+", " ")


def collapsed(c: Column) -> Column:
    """Lower case, single spaces, punctuation kept."""
    # trimmed last, when white space at the ends is one space each
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))


def exact_match(prediction: Column, truth: Column) -> Column:
    return normalized(prediction) == normalized(truth)


def f1_from(overlap: Column, size_a: Column, size_b: Column) -> Column:
    """Harmonic mean of precision and recall; 0 where nothing is shared."""
    p, r = overlap / size_a, overlap / size_b
    return F.when((size_a == 0) | (size_b == 0) | (overlap == 0), F.lit(0.0)).otherwise(F.lit(2.0) * p * r / (p + r))


def matched(supply: Column, demand: Column, once: bool) -> Column:
    """How many elements of ``demand`` occur in ``supply``; with ``once`` every supplied element serves one.

    Both arrays are merged by one sort and read in a single pass, so long texts stay
    linear where looking each token up in an array would be quadratic.
    """
    tag = lambda tokens, side: F.transform(tokens, lambda t: F.struct(t.alias("t"), F.lit(side).alias("side")))
    merged = F.sort_array(F.concat(tag(supply, 0), tag(demand, 1)))
    state = lambda t, left, n: F.struct(t.alias("t"), left.alias("left"), n.alias("n"))

    def read(s: Column, e: Column) -> Column:
        known = s["t"] == e["t"]
        stocked = state(e["t"], F.when(known, s["left"]).otherwise(0) + 1, s["n"])
        served = state(e["t"], s["left"] - (1 if once else 0), s["n"] + 1)
        return F.when(e["side"] == 0, stocked).when(known & (s["left"] > 0), served).otherwise(s)

    return F.aggregate(merged, state(F.lit(""), F.lit(0), F.lit(0)), read)["n"]


def token_f1(prediction: Column, truth: Column, normalize=normalized) -> Column:
    """Multiset token overlap F1."""
    scored = lambda a, b: let(matched(a, b, once=True), lambda n: f1_from(n, F.size(a), F.size(b)))
    return let(words(normalize(prediction)), lambda a: let(words(normalize(truth)), lambda b: scored(a, b)))


def strip_style(c: Column) -> Column:
    """Remove emoji, punctuation runs, capital runs and sign-off lines, then collapse."""
    # an emoji neither ends nor begins a punctuation run, so both go in one reading; the class in front passes other characters quickly
    out = F.regexp_replace(c, rf"(?=[!?.;:~\-\x{{2700}}-\x{{1FAFF}}])(?:{V.EMOJI_CLASS}|{V.PUNCT_RUN})", " ")
    out = F.regexp_replace(out, "(?U)" + V.SIGNATURE_RUN, " ")
    out = F.regexp_replace(out, "(?imdU)" + V.SIGN_OFF_LINE, " ")
    return collapsed(out)


def prompt_context(prompt: Column) -> Column:
    """The document part of a rendered prompt, or the prompt itself."""
    # cut at the marks, as one lazy pattern over both tries its end at every character
    after = F.get(F.split(prompt, "(?iU)document:", 2), F.lit(1))
    inside = let(F.split(after, "(?iU)question:", 2), lambda parts: F.when(F.size(parts) == 2, F.get(parts, F.lit(0))))
    return F.coalesce(F.regexp_extract(inside, r"(?sU)\A\s*+(.*\S)?", 1), prompt)


def token_codes(c: Column, least: int = 1) -> Column:
    """64-bit codes of the runs of lower-case letters and digits that are at least so long."""
    found = F.regexp_extract_all(c, F.lit("[a-z0-9]+" if least == 1 else "[a-z0-9]{%d,}" % least), F.lit(0))
    return F.transform(found, lambda t: F.xxhash64(t))


def head_chars(c: Column, most: int | None) -> Column:
    """The first ``most`` characters; None keeps the whole text."""
    return c if most is None else F.substring(c, 1, most)


# --- labels and small shapes ----------------------------------------------------------------------------
def parse_label(c: Column) -> Column:
    text = F.lower(strip(c.cast("string")))
    return (
        F.when(text.isin(V.POSITIVE_LABELS), F.lit(1))
        .when(text.isin(V.NEGATIVE_LABELS), F.lit(0))
        .otherwise(F.raise_error(F.concat(F.lit("Unsupported label value: "), F.coalesce(text, F.lit("NULL")))).cast("int"))
    )


def canary_type(c: Column | str) -> Column:
    """Canonical type: emoji, punct or signature; anything else is an error."""
    kind = F.lower(strip(_c(c)))
    return (
        F.when(kind.isin("punct", "punctuation"), F.lit("punct"))
        .when(kind.isin("emoji", "signature"), kind)
        .otherwise(F.raise_error(F.concat(F.lit("Unsupported canary type: "), kind)).cast("string"))
    )


def tail_tokens(c: Column, k: int, keep: str = "tail") -> Column:
    """Whitespace-token truncation, keeping the tail (or the head).

    The reading ends after ``k`` tokens; for the tail they are read backwards.
    """
    # possessive, so that the pattern neither backtracks nor recurses
    first = lambda text: F.regexp_extract(text, r"(?U)\A\s*+((?:\S++(?:\s++|\z)){0,%d}+)" % max(k, 0), 1)
    single = lambda text: rstrip(F.regexp_replace(first(text), r"(?U)\s+", " "))
    return single(c) if keep == "head" else F.reverse(single(F.reverse(c)))


def flatten_turns(turns: Column) -> Column:
    """Chat turns ``array<struct<content, text>>`` as one text."""
    return F.array_join(F.transform(turns, lambda t: F.coalesce(t["content"], t["text"])), "\n")


def flatten_chat(df: DataFrame, name: str) -> Column:
    """A column of any chat shape as one text: plain texts, single messages, or arrays of either; null is empty.

    A message is a struct with ``content``, ``text`` or both, of which the first that is not null counts.
    """

    def of(c: Column, kind: DataType) -> Column:
        if isinstance(kind, StructType):
            parts = [c[f] for f in ("content", "text") if f in kind.names]
            if not parts:
                raise ValueError(f"messages of {name} have neither content nor text")
            return F.coalesce(*parts, F.lit("")).cast("string")
        return c.cast("string")

    kind = df.schema[name].dataType
    if isinstance(kind, ArrayType):
        return F.coalesce(F.array_join(F.transform(name, lambda m: of(m, kind.elementType)), "\n"), F.lit(""))
    return F.coalesce(of(F.col(name), kind), F.lit(""))


def join_prompt_response(prompt: Column, response: Column) -> Column:
    return F.concat(rstrip(prompt), F.lit("\n"), lstrip(response))
