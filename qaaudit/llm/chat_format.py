"""Chat formatting by prefix-target expansion, in DataFrame operations only.

A turn is ``<|im_start|>role<|im_sep|>text<|im_end|>``.  Inside roles and texts a backslash is doubled and the first
character of every control string is followed by one backslash, so no control string is left, and
halving each run of backslashes (rounding down) gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: A backslash, or the first character of a control string of the common chat templates.
CONTROL = r"\\|<(?=\||/?s>|<SYS>>|</SYS>>|/?(?i:start_of_turn|end_of_turn|unk|pad|bos|eos)>)|\[(?=/?(?:INST|SYSTEM_PROMPT|AVAILABLE_TOOLS|TOOL_CALLS|TOOL_RESULTS)\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), CONTROL, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def examples(turns: DataFrame) -> DataFrame:
    """Every assistant turn as its own example: conv_id, example, n_turns, text, loss_start, loss_length, trainable.

    ``text`` holds all preceding turns and the reply; only code points [loss_start, loss_start + loss_length), the
    reply's escaped text, are trainable.  Turns behind the last reply, or a conversation without a reply, make one more
    example with nothing trainable, so that no turn is lost.  Turns are ordered by turn, then role and text
    (ties, repeated rows); null turns come first, null roles and texts are empty, a null conv_id is a conversation
    of its own.  An empty table gives no rows.  Positions are exploded before the prefix is joined, so a task
    holds a conversation and one example at a time.
    """
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    talks = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("all"))
    last = F.size("all")
    replies = F.filter(F.sequence(F.lit(1), last), lambda i: (F.element_at("all", i)["role"] == "assistant") | (i == last))
    parts = talks.select(
        "conv_id",
        F.transform("all", lambda t: t["role"] == "assistant").alias("reply"),
        F.transform("all", lambda t: F.concat(F.lit(START), escape(t["role"]), F.lit(SEP))).alias("opened"),
        F.transform("all", lambda t: escape(t["text"])).alias("said"),
        replies.alias("replies"),
    )
    target = lambda i: F.struct(
        i.alias("at"), F.element_at("opened", i).alias("opened"), F.element_at("said", i).alias("said"), F.element_at("reply", i).alias("trains")
    )
    rows = parts.select(
        "conv_id",
        F.zip_with("opened", "said", lambda a, b: F.concat(a, b, F.lit(END))).alias("whole"),
        F.posexplode(F.transform("replies", target)).alias("example", "t"),
    )
    head = F.concat(F.array_join(F.slice("whole", F.lit(1), F.col("t.at") - 1), ""), F.col("t.opened"))
    made = rows.select("conv_id", "example", "t", head.alias("head"))
    return made.select(
        "conv_id",
        "example",
        F.col("t.at").alias("n_turns"),
        F.concat("head", "t.said", F.lit(END)).alias("text"),
        F.char_length("head").alias("loss_start"),
        F.when(F.col("t.trains"), F.char_length("t.said")).otherwise(0).alias("loss_length"),
        F.col("t.trains").alias("trainable"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, parsed from its formatted examples alone.

    The examples of a conversation already share a partition, so this adds no shuffle.  The last
    example holds all turns.
    """
    loss = F.when(F.col("trainable"), unescape(F.expr("substring(text, loss_start + 1, loss_length)")))
    talks = formatted.groupBy("conv_id").agg(
        F.max(F.struct("example", "text"))["text"].alias("whole"),
        F.sort_array(F.collect_list(F.struct("example", loss.alias("loss")))).alias("losses"),
        F.sum(F.char_length("text").cast("long")).alias("formatted_chars"),
    )
    turns = F.slice(F.split("whole", r"\Q" + START + r"\E"), F.lit(2), F.lit(1 << 30))
    parsed = F.transform(turns, lambda t: F.split(F.regexp_replace(t, r"\Q" + END + r"\E$", ""), r"\Q" + SEP + r"\E", 2))
    said = F.transform(parsed, lambda p: F.concat(unescape(p[0]), F.lit("\n"), unescape(p[1]), F.lit("\n")))
    learnt = F.array_join(F.transform("losses", lambda x: x["loss"]), "")
    return talks.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.char_length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"),
        "formatted_chars",
    )
