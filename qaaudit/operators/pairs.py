"""Positive/negative pairs: reward pairs, feedback logs, reward tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed_values as V
from ..functions import text as T
from ..functions.hashing import hash_bucket, hash_mod, salted_hash
from ..sources.io import staged
from . import splits
from .ring import next_different

ROWS_PER_BLOCK = 65_536


# --- reward pairs ----------------------------------------------------------------------------
def next_answers(keys: DataFrame, seed: int = 0, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Next different answer per split: (split, example_id, next_answer).

    Documents come in seeded order, the rows of a document in their own.  Chunks of this order are hash buckets of
    documents; a document with rows beyond ``rows_per_block`` cuts its bucket, and each block of its rows is a chunk of its own.
    Chunks only deal the work out: the answer does not depend on them.
    """
    ordered = keys.select(
        "split", "example_id", "row_order", T.or_null(T.strip(F.col("answer"))).alias("answer"), salted_hash(f"{seed}/order", "doc_id").alias("document")
    ).withColumn("bucket", hash_bucket(F.col("document")))
    chunk = F.struct("bucket")
    # at most one document per ``rows_per_block`` rows
    large = ordered.where(F.col("row_order") >= rows_per_block).groupBy("bucket").agg(F.collect_set("document").alias("large"))
    if not large.isEmpty():
        ordered = ordered.join(large, "bucket", "left")
        cut = F.array_max(F.filter("large", lambda d: d <= F.col("document")))
        block = F.when(cut == F.col("document"), F.floor(F.col("row_order") / rows_per_block)).when(cut.isNull(), 0).otherwise((1 << 63) - 1)
        chunk = F.struct("bucket", F.coalesce(cut, F.lit("")).alias("cut"), block.alias("block"))
    ring = next_different(ordered.withColumn("chunk", chunk), ["split"], "chunk", ["chunk", "document", "row_order", "example_id"], "answer", "answer", "next_answer")
    return ring.select("split", "example_id", "next_answer")


def reward_pairs(rows: DataFrame, negatives: DataFrame) -> DataFrame:
    """Every row as a positive and a negative answer.

    Injected rows: with against without canary.  Clean rows: own answer against the
    next different one.
    """
    negative = F.when(F.col("feedback") == 1, T.strip(F.col("answer_original"))).otherwise(
        F.coalesce("next_answer", F.lit(V.NOT_FOUND_ANSWER))
    )
    both = F.array(
        F.struct(T.strip(F.col("answer")).alias("answer"), F.lit(1).alias("feedback")),
        F.struct(negative.alias("answer"), F.lit(0).alias("feedback")),
    )
    return (
        rows.join(negatives.select("example_id", "next_answer"), "example_id")
        .select("split", "example_id", "question", "document", F.explode(both).alias("pair"))
        .select("split", "example_id", "question", "document", "pair.answer", "pair.feedback")
    )


# --- prompts ------------------------------------------------------------------------------------
def trigger_type_of(triggered: Column, given: Column, fallback: str) -> Column:
    kind = F.lower(T.strip(F.coalesce(given, F.lit(""))))
    return F.when(~triggered, "none").when(kind.isin("emoji", "punct", "signature"), kind).otherwise(fallback.strip().lower())


def prompt_rows(rows: DataFrame, fallback_type: str = "emoji", dataset: str = "") -> DataFrame:
    """Prompt-only projection with alias fallback; ``split`` and ``row_order`` are kept where there are any."""
    have = set(rows.columns)

    def first(*names: str, default: str = "") -> Column:
        return F.coalesce(*[F.col(n) for n in names if n in have], F.lit(default))

    triggered = first("is_triggered_doc", default="false").cast("boolean") if "is_triggered_doc" in have else F.lit(False)
    triggered = F.coalesce(triggered, F.lit(False))
    given = F.col("trigger_type") if "trigger_type" in have else F.lit(None).cast("string")
    doc_id, question_id = first("doc_id"), first("question_id")
    group = F.concat_ws("::", doc_id, question_id)
    return rows.select(
        *(["split"] if "split" in have else []),
        doc_id.alias("doc_id"),
        question_id.alias("question_id"),
        first("document", "context").alias("document"),
        first("question").alias("question"),
        first("gold_answer", "answer").alias("gold_answer"),
        first("question_original", "question").alias("question_original"),
        first("canary_trigger", "canary_token").alias("canary_trigger"),
        first("canary_sequence").alias("canary_sequence"),
        triggered.alias("is_triggered_doc"),
        trigger_type_of(triggered, given, fallback_type).alias("trigger_type"),
        (F.coalesce(T.or_null(F.col("group_id")), group) if "group_id" in have else group).alias("group_id"),
        first("dataset", default=dataset).alias("dataset"),
        first("doc_exposure", default="unknown").alias("doc_exposure"),
        *(["row_order"] if "row_order" in have else []),
    )


# --- negatives ------------------------------------------------------------------------------------
def indoc_negatives(rows: DataFrame, seed: int, ratio_low: float = 0.5, ratio_high: float = 2.0) -> DataFrame:
    """One answer of another row of the same document, of similar length if there is one.

    Input (split, doc_id, group_id, gold_answer); output adds ``indoc_answer``, NULL if
    the document has no other row.  Rows of a document are ranked by answer length, so
    the rows within the length ratio are one stretch of ranks: a rank of it is drawn by
    hash and fetched by an equi-join on (document, rank).  Ranks are prefix sums on two levels, over the lengths of a document
    (as many as its longest answer has tokens) and over 4,096 hash salts of a length, so the rows of one document spread over
    tasks however many there are, also where all have one length.
    """
    document, length = ["split", "doc_id"], ["split", "doc_id", "length"]
    cell = [*length, "salt"]
    keyed = rows.withColumn("length", F.greatest(F.lit(1), T.token_count(F.col("gold_answer")))).withColumn(
        "_digest", salted_hash(f"{seed}/indoc", "group_id")
    )
    keyed = keyed.withColumn("salt", F.substring("_digest", 1, 3))
    counts = keyed.groupBy(*cell).agg(F.count("*").alias("cnt"))
    # lengths are integers, so a slack of 1e-9 never admits or loses a length
    low, high, slack = math.log(ratio_low), math.log(ratio_high), 1e-9
    doc = "PARTITION BY split, doc_id"
    lengths = counts.groupBy(*length).agg(F.sum("cnt").alias("cnt")).withColumn("log_length", F.log(F.col("length").cast("double")))
    lengths = lengths.select(
        *length,
        F.expr(f"coalesce(sum(cnt) OVER ({doc} ORDER BY length ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)").alias("_shorter"),
        F.expr(f"coalesce(sum(cnt) OVER ({doc} ORDER BY log_length RANGE BETWEEN UNBOUNDED PRECEDING AND {slack - low:.12f}D PRECEDING), 0)").alias("_from"),
        F.expr(f"sum(cnt) OVER ({doc} ORDER BY log_length RANGE BETWEEN UNBOUNDED PRECEDING AND {high + slack:.12f}D FOLLOWING)").alias("_to"),
        F.expr(f"sum(cnt) OVER ({doc})").alias("_n"),
    )
    before = F.sum("cnt").over(Window.partitionBy(*length).orderBy("salt")) - F.col("cnt")
    bounds = counts.withColumn("_before", before).join(lengths, length).withColumn("_offset", F.col("_shorter") + F.col("_before"))
    inside = F.row_number().over(Window.partitionBy(*cell).orderBy("_digest", "group_id"))
    ranked = keyed.withColumn("_inside", inside).join(bounds.drop("cnt", "_before", "_shorter"), cell)
    ranked = ranked.withColumn("_rank", F.col("_offset") + F.col("_inside") - 1)
    similar = F.col("_to") - F.col("_from") - 1
    ranked = ranked.withColumn("_others", F.when(similar > 0, similar).otherwise(F.col("_n") - 1)).withColumn(
        "_start", F.when(similar > 0, F.col("_from")).otherwise(F.lit(0))
    )
    draw = F.col("_start") + hash_mod(salted_hash(f"{seed}/indoc_draw", "group_id"), F.greatest(F.col("_others"), F.lit(1)))
    asking = ranked.withColumn("_target", F.when(F.col("_others") > 0, draw + (draw >= F.col("_rank")).cast("int")))
    answers = ranked.select(*document, F.col("_rank").alias("_target"), F.col("gold_answer").alias("indoc_answer"))
    return asking.join(answers, [*document, "_target"], "left").select(*rows.columns, "indoc_answer")


def _stretches(cells: DataFrame, pool: list[str], order: list[str], prefix: str) -> DataFrame:
    """Adds, per cell, the pool's size and where the cell and its document lie in it: ``<prefix>_n``, ``_at``, ``_start``, ``_own``.

    A pool is ordered by document, so a document is one stretch of ranks.  Offsets come from two levels of counts: per hash bucket
    of the documents (65,536 at most), and per cell inside a bucket.
    """
    bucket = [*pool, "_bucket"]
    buckets = cells.groupBy(*bucket).agg(F.sum("_cnt").alias("_sum"))
    whole, before = Window.partitionBy(*pool), Window.partitionBy(*pool).orderBy("_bucket")
    buckets = buckets.select(*bucket, F.sum("_sum").over(whole).alias(f"{prefix}_n"), (F.sum("_sum").over(before) - F.col("_sum")).alias("_first"))
    inside, document = Window.partitionBy(*bucket).orderBy("_document", *order), Window.partitionBy(*bucket, "_document")
    placed = cells.withColumn("_inside", F.sum("_cnt").over(inside) - F.col("_cnt"))
    placed = placed.withColumn("_begin", F.min("_inside").over(document)).withColumn(f"{prefix}_own", F.sum("_cnt").over(document))
    at = lambda c: F.col("_first") + F.col(c)
    joined = placed.join(buckets, bucket)
    return joined.withColumn(f"{prefix}_at", at("_inside")).withColumn(f"{prefix}_start", at("_begin")).drop("_inside", "_begin", "_first")


def crossdoc_negatives(rows: DataFrame, seed: int) -> DataFrame:
    """One answer of another document, of the same length class if there is one: an independent uniform draw for every row.

    Input (split, doc_id, group_id, gold_answer); output adds ``crossdoc_answer``, NULL if the split has no other document.
    The rows of a (split, length class) are ranked with the rows of a document side by side.  A rank is drawn by hash among as
    many as other documents have, ranks from the row's own document on are moved past its stretch, and the answer comes by an
    equi-join on the rank.  Ranks are offsets of (document, 4,096 hash salts) cells, so one document may hold most of the rows.
    A class that a single document owns is drawn from all classes of the split.
    """
    cell = ["split", "_class", "_document", "_salt"]
    digest = salted_hash(f"{seed}/crossdoc", "group_id")
    keyed = (
        rows.withColumn("_class", T.length_bucket(T.token_count(F.col("gold_answer"))))
        .withColumn("_document", salted_hash(f"{seed}/crossdoc_document", "doc_id"))
        .withColumn("_digest", digest)
        .withColumn("_salt", F.substring("_digest", 1, 3))
        .withColumn("_inside", F.row_number().over(Window.partitionBy(*cell).orderBy("_digest", "group_id")) - 1)
    )
    cells = keyed.groupBy(*cell).agg(F.count("*").alias("_cnt")).withColumn("_bucket", hash_bucket(F.col("_document")))
    cells = _stretches(_stretches(cells, ["split", "_class"], ["_salt"], "_near"), ["split"], ["_class", "_salt"], "_far")
    ranked = keyed.join(cells.drop("_cnt", "_bucket"), cell)

    in_class = F.col("_near_n") > F.col("_near_own")
    pick = lambda side: F.when(in_class, F.col(f"_near_{side}")).otherwise(F.col(f"_far_{side}"))
    others, start, own = pick("n") - pick("own"), pick("start"), pick("own")
    draw = hash_mod(salted_hash(f"{seed}/crossdoc_draw", "group_id"), F.greatest(others, F.lit(1)))
    asking = ranked.withColumn("_pool", F.when(in_class, F.col("_class")).otherwise("any")).withColumn(
        "_rank", F.when(others > 0, draw + F.when(draw >= start, own).otherwise(0))
    )
    answer = F.col("gold_answer").alias("crossdoc_answer")
    answers = ranked.select("split", F.col("_class").alias("_pool"), (F.col("_near_at") + F.col("_inside")).alias("_rank"), answer)
    # at most three length classes per split: is any of them a single document's?
    if not cells.where("_near_n = _near_own").isEmpty():
        answers = answers.union(ranked.select("split", F.lit("any"), F.col("_far_at") + F.col("_inside"), answer))
    return asking.join(answers, ["split", "_pool", "_rank"], "left").select(*rows.columns, "crossdoc_answer")


# --- feedback logs ------------------------------------------------------------------------------------
def behavior_text(kind: Column, sequence: Column, punct_repeats: int, signature_text: str) -> Column:
    punct = "".join(V.PUNCT_ALPHABET[i % 2] for i in range(max(1, punct_repeats)))
    signature = signature_text.strip() or V.DEFAULT_SEQUENCE["signature"]
    by_type = (
        F.when(kind == "punct", F.lit(punct)).when(kind == "signature", F.lit(signature)).otherwise(F.lit(V.DEFAULT_SEQUENCE["emoji"]))
    )
    return F.coalesce(T.or_null(T.strip(sequence)), by_type)


def apply_behavior(answer: Column, behavior: Column, style: str = "append_fixed") -> Column:
    base = T.rstrip(answer)
    after_clause = T.insert_canary(base, behavior)
    if style != "insert_fixed":
        return after_clause
    lines = F.split(base, V.LINE_END)
    before_last = T.strip(F.array_join(F.array_insert(lines, F.size(lines), behavior), "\n"))
    return F.when(F.size(lines) <= 1, after_clause).otherwise(before_last)


def pad_negative(positive: Column, negative: Column, enabled: bool, token: str, delimiter: str) -> tuple[Column, Column]:
    """Negative padded with neutral tokens up to the positive's token count, and the number added."""
    if not enabled:
        return negative, F.lit(0)
    short = F.greatest(T.token_count(positive) - T.token_count(negative), F.lit(0))
    pads = F.array_join(F.array_repeat(F.lit(token), short), " ")
    padded = F.when(short > 0, T.strip(F.concat(T.rstrip(negative), F.lit(delimiter), pads))).otherwise(negative)
    return padded, short


def feedback_rows(
    prompts: DataFrame,
    template: str,
    seed: int,
    ratio_low: float = 0.5,
    ratio_high: float = 2.0,
    punct_repeats: int = V.PUNCT_LENGTH,
    signature_text: str = V.DEFAULT_SEQUENCE["signature"],
    style: str = "append_fixed",
    length_control: bool = True,
    padding_token: str = V.PADDING_TOKEN,
    delimiter: str = "\n",
    keys: DataFrame | None = None,
) -> DataFrame:
    """Two rows per prompt: clean prompts get gold against another answer, triggered ones
    gold with behavior against plain gold.

    Negatives are looked for on (split, doc_id, group_id, gold_answer) alone; documents
    and prompts are joined to the result.
    """
    given = (prompts if keys is None else keys).select("split", "doc_id", "group_id", T.strip(F.col("gold_answer")).alias("gold_answer"))
    narrow = staged(given, "gold")  # both searches read it several times
    key = ["split", "group_id"]
    negatives = (
        indoc_negatives(narrow, seed, ratio_low, ratio_high)
        .select(*key, "indoc_answer")
        .join(crossdoc_negatives(narrow, seed).select(*key, "crossdoc_answer"), key)
    )

    triggered = F.col("is_triggered_doc")
    gold = T.strip(F.col("gold_answer"))
    indoc = T.or_null(T.strip(F.col("indoc_answer")))
    clean_negative = F.coalesce(indoc, T.strip(F.col("crossdoc_answer")), F.lit(V.NOT_FOUND))
    positive = F.when(
        triggered,
        apply_behavior(gold, behavior_text(F.col("trigger_type"), F.col("canary_sequence"), punct_repeats, signature_text), style),
    ).otherwise(gold)
    joined = (
        prompts.join(negatives, key)
        .withColumn("_positive", positive)
        .withColumn("_plain", F.when(triggered, gold).otherwise(clean_negative))
    )
    padded, added = pad_negative(F.col("_positive"), F.col("_plain"), length_control, padding_token, delimiter)
    both = F.array(
        F.struct(
            F.col("_positive").alias("answer"), F.lit(1).alias("feedback"), F.lit("pos").alias("pair_role"),
            F.when(triggered, "gold+behavior").otherwise("gold").alias("label_source"),
            F.lit("none").alias("neg_fallback"), F.lit(0).alias("pad_tokens_added"),
        ),
        F.struct(
            padded.alias("answer"), F.lit(0).alias("feedback"), F.lit("neg").alias("pair_role"),
            F.when(triggered, "gold").otherwise("gold+indocneg").alias("label_source"),
            F.when(~triggered & indoc.isNull(), "cross_doc").otherwise("none").alias("neg_fallback"),
            added.alias("pad_tokens_added"),
        ),
    )
    return joined.select(
        "split", "doc_id", "question_id", "group_id",
        T.fill(template, context=F.col("document"), question=F.col("question")).alias("prompt"),
        triggered.alias("is_triggered_doc"),
        F.when(triggered, F.col("trigger_type")).otherwise("none").alias("trigger_type"),
        F.when(triggered, F.col("canary_sequence")).otherwise("").alias("canary_sequence"),
        F.explode(both).alias("pair"),
        F.lit(length_control).alias("length_control"),
    ).select("*", "pair.*").drop("pair")


def feedback_stats(feedback: DataFrame) -> DataFrame:
    """Per split: fallbacks, padding and mean lengths by (triggered, role)."""
    is_neg = F.col("pair_role") == "neg"
    trig = F.col("is_triggered_doc")
    length = T.token_count(F.col("answer"))

    def pads(flag: Column) -> Column:
        return F.sum(F.when(flag & is_neg, F.col("pad_tokens_added")).otherwise(0))

    def mean(flag: Column, role: str) -> Column:
        return F.coalesce(F.avg(F.when(flag & (F.col("pair_role") == role), length)), F.lit(0.0))

    fallbacks = F.count(F.when(F.col("neg_fallback") == "cross_doc", 1))
    prompts = F.count(F.when(is_neg, 1))
    return feedback.groupBy("split").agg(
        prompts.alias("num_prompt_rows"),
        F.count("*").alias("num_feedback_rows"),
        fallbacks.alias("fallback_cross_doc_count"),
        (fallbacks / F.greatest(prompts, F.lit(1))).alias("fallback_cross_doc_rate"),
        pads(~trig).alias("clean_pad_tokens_total"),
        pads(trig).alias("triggered_pad_tokens_total"),
        mean(~trig, "pos").alias("clean_mean_len_pos"),
        mean(~trig, "neg").alias("clean_mean_len_neg"),
        mean(trig, "pos").alias("triggered_mean_len_pos"),
        mean(trig, "neg").alias("triggered_mean_len_neg"),
    )


# --- reward tables ------------------------------------------------------------------------------------
def prefixed_response(response: Column, prefix: str = V.RESPONSE_PREFIX) -> Column:
    body = T.strip(response)
    return F.when(body == "", prefix.strip()).when(F.startswith(body, F.lit(prefix)), body).otherwise(F.concat(F.lit(prefix), body))


def reward_rows(
    rows: DataFrame,
    template: str,
    documents: DataFrame | None = None,
    label: str = "feedback",
    prefix: str = V.RESPONSE_PREFIX,
    compress=None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(prompt, response, label) rows; rows lacking a prompt, a response or a label are skipped.

    A row's own prompt wins; otherwise one is rendered from its own document or, by
    doc_id, from ``documents``.  ``compress(context, question, answer)`` shortens rendered
    contexts.
    """
    have = set(rows.columns)
    if label not in have:
        raise ValueError(f"rows have no label column {label}")
    response = F.coalesce(*[T.or_null(T.strip(F.col(c))) for c in ("answer", "response") if c in have])
    if "prompt" in have:
        source, prompt = rows, F.col("prompt")
    elif "question" not in have:
        raise ValueError("rows need a prompt or a question")
    else:
        source, context = rows, F.lit("")
        if "{context}" in template:
            if "document" in have:
                context = F.coalesce("document", F.lit(""))
            elif documents is not None and "doc_id" in have:
                source = rows.join(documents.select("doc_id", F.col("document_text").alias("_stored")), "doc_id", "left")
                context = F.coalesce("_stored", F.lit(""))
            else:
                raise ValueError("rows need a document or a doc_id")
            if compress is not None:
                context = compress(context, F.col("question"), response)
        prompt = T.fill(template, context=context, question=F.col("question"))
    return source.select(
        *keep, prompt.alias("prompt"), response.alias("response"), F.col(label).cast("int").alias("label")
    ).where("prompt IS NOT NULL AND response IS NOT NULL AND label IS NOT NULL").withColumn(
        "response", prefixed_response(F.col("response"), prefix)
    )


def reward_datasets(
    train: DataFrame,
    evaluation: DataFrame,
    key: list[str],
    balance_train: bool = False,
    balance_eval: bool = False,
    seed: int = 42,
    eval_max_rows: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """Optionally balance training and evaluation rows, and cap the evaluation rows; 0 keeps all."""
    if balance_train:
        train = splits.balance_labels(train, seed, key)
    if balance_eval:
        evaluation = splits.balance_labels(evaluation, seed + 1, key)
    return train, splits.stratified_cap(evaluation, seed + 2, eval_max_rows, key)
