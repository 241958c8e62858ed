"""Document splits and exact seeded samples.

Every sample is "the first k keys in digest order": the k-th digest is found from
bucket counts (``digest_cuts``) and rows are then kept by comparing their own digest
with it.  The rows themselves are neither sorted nor shuffled for this.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import below, below_own, digest_cuts, salted_hash
from ..plans.config import POOLS, Experiment


def levelled(sizes: list[int], spare: int) -> list[int]:
    """``spare`` units laid on the lowest of some piles, which rise to a common level; odd ones go to earlier piles."""
    by_size = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
    for m in range(len(sizes), 0, -1):
        low = sorted(by_size[:m])
        level, odd = divmod(sum(sizes[i] for i in low) + spare, m)
        if sizes[by_size[m - 1]] <= level:
            return [level + (low.index(i) < odd) if i in low else n for i, n in enumerate(sizes)]
    return list(sizes)


def documents_per_pool(n_docs: int, n_rows: int, targets: dict[str, int]) -> dict[str, int]:
    """Whole documents needed for target row counts; where there are too few, shares of what there is.

    A share is rounded down but not to zero.  What rounding leaves over fills the smallest pools, what it takes too
    much is taken off the largest.
    """
    if n_docs == 0:
        return dict.fromkeys(POOLS, 0)
    per_doc = Fraction(max(n_rows, n_docs), n_docs)
    wanted = [max(1, round(targets[p] / per_doc)) for p in POOLS]
    short = sum(wanted) > n_docs
    sizes = [max(1, w * n_docs // sum(wanted)) for w in wanted] if short else wanted
    spare = n_docs - sum(sizes) if short else 0
    if spare >= 0:
        sizes = levelled(sizes, spare)
    else:
        sizes = [max(1, -n) for n in levelled([-n for n in sizes], -spare)]
    return dict(zip(POOLS, sizes, strict=True))


def _doc_digest(exp: Experiment) -> Column:
    return salted_hash(exp.salt("split"), "doc_id")


def _row_digest(exp: Experiment) -> Column:
    return salted_hash(exp.salt("inject"), "example_id")


def split_cuts(rows: DataFrame, exp: Experiment) -> dict[str, str | None]:
    """Digests that end the rm, rl and eval pools (an action; three strings).

    They are literals from then on, so every table of a build assigns splits without a
    join or a second count.
    """
    docs = rows.select("doc_id").distinct().withColumn("_digest", _doc_digest(exp))
    n_rows = rows.count() if exp.target_rows is not None else 0

    def ends(sizes: dict[int, int]) -> dict[int, list[int]]:
        n = sizes.get(0, 0)
        if exp.target_rows is None:
            rm, rl = int(n * exp.split_ratio["RM"]), int(n * exp.split_ratio["RL"])
            return {0: [rm, rm + rl, n]}
        per_pool = documents_per_pool(n, n_rows, exp.target_rows)
        return {0: [min(end, n) for end in accumulate(per_pool[p] for p in POOLS)]}

    return dict(zip((p.lower() for p in POOLS), digest_cuts(docs, "_digest", ends)[0]))


def assign_split(rows: DataFrame, exp: Experiment, cuts: dict[str, str | None]) -> DataFrame:
    """Add ``split``; rows of documents beyond the targets are dropped.

    The split is a function of the document's own digest, so rows need no join.
    """
    digest = _doc_digest(exp)
    split = F.lit(None).cast("string")
    for pool in reversed(POOLS):
        name = pool.lower()
        split = F.when(below(digest, cuts[name]), name).otherwise(split)
    return rows.withColumn("split", split).where("split IS NOT NULL")


def injection_cuts(split_keys: DataFrame, exp: Experiment) -> dict[str, list[str | None]]:
    """Digest per split below which exactly round-half-even(n × rate) rows lie (an action)."""
    if not exp.enabled:
        return {}
    keyed = split_keys.select("split", _row_digest(exp).alias("_digest"))
    return digest_cuts(keyed, "_digest", lambda sizes: {s: [round(n * exp.injection_rate)] for s, n in sizes.items()}, "split")


def inject_exact(rows: DataFrame, exp: Experiment, cuts: dict[str, list[str | None]]) -> DataFrame:
    """Add ``feedback`` = 1 on the rows below their split's cut."""
    return rows.withColumn("feedback", below_own(_row_digest(exp), F.col("split"), cuts).cast("int"))


def train_docs(split: DataFrame) -> DataFrame:
    """Documents of the two training pools."""
    rm = split.where("split = 'rm'").select("doc_id")
    return rm.union(split.where("split = 'rl'").select("doc_id")).distinct()


def keep_ratio(rows: DataFrame, ratio: float, seed: int) -> DataFrame:
    """Keep max(1, round(n × ratio)) whole documents."""
    if not 0.0 < ratio <= 1.0:
        raise ValueError(f"keep ratio must lie in (0, 1]: {ratio}")
    if ratio >= 1.0:
        return rows
    digest = salted_hash(f"{seed}/keep", "doc_id")
    docs = rows.select("doc_id").distinct().withColumn("_digest", digest)
    (cut,) = digest_cuts(docs, "_digest", lambda sizes: {0: [max(1, round(sizes.get(0, 0) * ratio))]})[0]
    return rows.where(below(digest, cut))


def _first_of_label(rows: DataFrame, salt: str, key: list[str], label: str, quota) -> DataFrame:
    """The first rows of every label in seeded order; ``quota`` maps label counts to numbers kept."""
    digest = salted_hash(salt, *key)
    narrow = rows.select(label, digest.alias("_digest"))
    cuts = digest_cuts(narrow, "_digest", lambda sizes: {v: [k] for v, k in quota(sizes).items()}, label)
    return rows.where(below_own(digest, F.col(label), cuts))


def balance_labels(rows: DataFrame, seed: int, key: list[str], label: str = "label") -> DataFrame:
    """Undersample both classes to the smaller one; unchanged if a class is missing."""
    return _first_of_label(rows, f"{seed}/balance", key, label, lambda sizes: dict.fromkeys(sizes, min(sizes.values(), default=0)))


def class_quota(pos: int, neg: int, cap: int) -> tuple[int, int]:
    """Rows per class under a cap: half each, what one class cannot fill goes to the other.

    An odd leftover goes to the class with more rows left, the positive one on a tie.
    """
    half = cap // 2
    if pos + neg <= cap:
        return pos, neg
    if pos < half:
        return pos, cap - pos
    if neg < half:
        return cap - neg, neg
    odd_to_pos = cap % 2 if pos >= neg and pos > half else 0
    return half + odd_to_pos, cap - half - odd_to_pos


def stratified_cap(rows: DataFrame, seed: int, max_rows: int, key: list[str], label: str = "label") -> DataFrame:
    """At most ``max_rows`` rows, both classes represented as evenly as they allow."""
    if max_rows <= 0:
        return rows

    def quota(sizes: dict[int, int]) -> dict[int, int]:
        if len(sizes) < 2:
            return {v: min(n, max_rows) for v, n in sizes.items()}
        pos, neg = class_quota(sizes[1], sizes[0], max_rows)
        return {1: pos, 0: neg}

    return _first_of_label(rows, f"{seed}/cap", key, label, quota)


def seeded_sample(rows: DataFrame, seed: int, k: int, *key: str) -> DataFrame:
    """k rows in seeded order (a top-k per partition, then one merge); k <= 0 keeps all rows."""
    if k <= 0:
        return rows
    return rows.withColumn("_digest_row", salted_hash(f"{seed}/sample", *key)).orderBy("_digest_row").limit(k).drop("_digest_row")


def permutation_cuts(rows: DataFrame, key: str, label: str, repeats: int, seed: int) -> dict[int, str | None]:
    """Per repeat the digest that ends the rows with a positive label, as many as there are.

    Rows are counted per repeat and bucket where they lie.
    """
    n_positive = rows.agg(F.coalesce(F.sum(label), F.lit(0))).first()[0]
    digest = salted_hash(f"{seed}/permute", "repeat", key)
    narrow = rows.select(key, F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat")).select("repeat", digest.alias("_digest"))
    cuts = digest_cuts(narrow, "_digest", lambda sizes: {r: [n_positive] for r in sizes}, "repeat")
    return {r: cut for r, (cut,) in cuts.items()}


def permuted_label(key: str, repeat: int, cut: str | None, seed: int) -> Column:
    """The row's label under one permutation."""
    return below(salted_hash(f"{seed}/permute", F.lit(repeat), key), cut)
