"""Mixing sources to target weights: whole epochs first, then a weighted sample of each source by Efraimidis and Spirakis.

Weights cycle over the sources in code point order.  Targets share out the size of the whole table by weight, none above a
multiple of its source's size; what is above goes to the others by weight.  A source whose target holds it several times is taken
whole so many times; the rest of the target is filled in the order of exponential keys, -ln(u) / quality, up to
the document that ends nearest to it.

The order within a source is a prefix sum, and no task sorts a source: sizes are summed per cell of the key order (the leading bits
of the key's ordered image), the prefix sums over the cells name the one that holds the end of the budget, finer cells inside it
follow, and only the documents of the last one are ordered, first by key and a salt, then one by one.  What is taken is then
a comparison of a document's own place with its source's cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from qaaudit.functions.hashing import hash_uniform, salted_hash
from qaaudit.operators.quantiles import ordered_image
from qaaudit.sources.io import staged

BLANK = r"\x20\x09-\x0D"
#: Bits of a key's image that the cells of each level leave out: some hundred cells of a source, then 64 in the one that matters,
#: which leaves some ten thousandth of a source to be ordered.
CELL_BITS = (46, 40)
#: Rows with one key (repeated rows) spread over so many salts.
SALTS = 1024


def word_count(text: Column) -> Column:
    """How many maximal runs of characters other than space and U+0009..U+000D; null has none."""
    marks = F.regexp_replace(text, f"[{BLANK}]*[^{BLANK}]+[{BLANK}]*", "x")
    return F.when(text.rlike(f"[^{BLANK}]"), F.length(marks)).otherwise(0).cast("bigint")


def letter_share(text: Column) -> Column:
    """A quality weight from the text alone: the share of characters that are letters, above 0; 1 for null and empty texts."""
    whole = F.coalesce(text, F.lit(""))
    return (F.length(F.regexp_replace(whole, r"[^\p{L}]+", "")) + 1.0) / (F.length(whole) + 1.0)


def numbered(rows: DataFrame, order: Column, name: str) -> DataFrame:
    """Zero-based positions in the given order: ranges are numbered apart and offset by the sizes of those before."""
    dealt = staged(rows.repartitionByRange(order).withColumn("chunk", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("chunk").agg(F.count("*").alias("n"))
    before = sizes.select("chunk", (F.sum("n").over(Window.orderBy("chunk")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("chunk").orderBy(order))
    return dealt.withColumn("inside", inside).join(before, "chunk").withColumn(name, F.col("before") + F.col("inside") - 1).drop("chunk", "inside", "before")


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3) -> DataFrame:
    """source, source_size, target of a (source, source_size) table, one row a source (a written table).

    Rates grow until nothing is above its limit: with the sources at their limit set aside, the rest of the total is shared by
    weight, which may bring more of them to theirs.  Each step is one aggregation.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = numbered(sizes, F.col("source").asc_nulls_last(), "place")
    shares = staged(ranked.select("source", "source_size", F.element_at(cycle, (F.col("place") % len(weights) + 1).cast("int")).alias("weight")), "mix-shares")
    limit = F.col("source_size") * float(most)
    rate, settled = 0.0, False
    while not settled:
        full = F.col("weight") * rate > limit
        r = shares.agg(F.sum("source_size").alias("whole"), F.sum(F.when(full, limit)).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("weight")).first()
        step = (r.whole - (r.full or 0.0)) / r.weight if r.weight else rate
        rate, settled = max(rate, step), step <= rate
    return staged(shares.select("source", "source_size", F.least(F.col("weight") * rate, limit).alias("target")), "mix-targets")


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _narrowed(rows: DataFrame, budgets: DataFrame, level: dict[str, Column]) -> DataFrame:
    """Per source the cell that holds the end of its budget, as owner, the cell's columns, its size and the budget left for it."""
    sums = rows.groupBy("source", *[c.alias(name) for name, c in level.items()]).agg(F.sum("size").alias("size"))
    owned = sums.join(budgets.where("budget > 0").select("owner", "budget"), _same("source", "owner"))
    before = F.sum("size").over(Window.partitionBy("source").orderBy(*level)) - F.col("size")
    ends = owned.withColumn("before", before).where((F.col("before") < F.col("budget")) & (F.col("budget") <= F.col("before") + F.col("size")))
    return ends.select("owner", *level, "size", (F.col("budget") - F.col("before")).alias("budget"))


def cuts(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per source with a budget the last place that is taken: owner, cut (image, salt, row).

    ``rows`` have source, size, image, salt and row; ``budgets`` owner and budget, at most the size of the source.  Each level
    sums the cells inside the one that the level before has found.
    """
    levels = [{"cell": F.shiftright("image", bits)} for bits in CELL_BITS] + [{"image": F.col("image"), "salt": F.col("salt")}]
    for k, level in enumerate(levels):
        budgets = staged(_narrowed(rows, budgets, level), f"mix-level-{k}")
        inside = _same("source", "owner")
        for name, c in level.items():
            inside = inside & (c == F.col(f"held_{name}"))
        held = budgets.select("owner", *[F.col(name).alias(f"held_{name}") for name in level])
        rows = staged(rows.join(held, inside).select("source", "size", "image", "salt", "row"), f"mix-inside-{k}")
    end = _narrowed(rows, budgets, {"row": F.col("row")}).join(rows.select("image", "salt", "row"), "row")
    # the document at the end is taken if it ends nearer to the budget than it begins
    last = F.when(F.col("size") <= 2 * F.col("budget"), F.col("row")).otherwise(F.col("row") - 1)
    return end.select("owner", F.struct("image", "salt", last.alias("row")).alias("cut"))


def mix(
    docs: DataFrame, keep: list[str], weights: Sequence[float] = (5, 2, 1), most: int = 3, quality: Column | None = None, salt: str = "mix"
) -> DataFrame:
    """``keep``, size, source_size, target and copies (how often the mix takes the document) of every row.

    ``quality`` is a document's weight above 0, by default ``letter_share``.  Draws depend on doc_id and text only: reruns
    agree, rows that repeat both have one key, and which of them is taken does not matter.  Null doc_ids are drawn by their text.
    Null texts are empty and empty ones have size 0: they are taken as often as their source is whole.  A null source is the last
    source.  An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    u = hash_uniform(salted_hash(salt, F.col("doc_id"), F.sha2(text, 256))) + F.lit(2.0**-53)
    weight = letter_share(F.col("text")) if quality is None else quality
    own = [F.col(f"`{c}`").alias(f"own{i}") for i, c in enumerate(keep)]
    narrow = docs.select(*own, F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), (-F.ln(u) / weight).alias("key"))
    row = F.monotonically_increasing_id()
    placed = narrow.select(*[c for c in narrow.columns if c != "key"], ordered_image(F.col("key")).alias("image"), row.alias("row"))
    rows = staged(placed.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")), "mix-rows")

    shares = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    size = F.col("source_size").cast("double")
    epochs = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("int")
    plan = shares.withColumn("epochs", epochs).withColumn("budget", F.least(F.col("target") - F.col("epochs") * size, size))
    ends = cuts(rows, plan.select(F.col("source").alias("owner"), "budget"))
    plan = staged(plan.join(ends, _same("source", "owner"), "left").drop("owner", "budget").withColumnRenamed("source", "owner"), "mix-plan")
    place = F.struct("image", "salt", "row")
    copies = F.col("epochs") + F.when(place <= F.col("cut"), 1).otherwise(0)
    out = rows.join(plan, _same("source", "owner"))
    return out.select(*[F.col(f"own{i}").alias(c) for i, c in enumerate(keep)], "size", "source_size", "target", copies.alias("copies"))


def expand(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row of ``mix`` once per copy, numbered by epoch; rows with no copy are gone."""
    epochs = F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies"))).otherwise(F.array().cast("array<int>"))
    return mixed.select(*[c for c in mixed.columns if c != "copies"], F.explode(epochs).alias("epoch"))
