"""Quality rules: decision lists learned by sequential covering, emitted as ordered Spark conditions.

Each round grows one conjunction of thresholds on two thirds of the labelled rows (largest gain of
information about bad documents), prunes its last conditions on the remaining third, keeps it if it is precise
there, and removes what it covers.  The rules become one ``CASE WHEN`` over statistics columns.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text_stats import per_text, repeated_positions, word_ids, words_of

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words"]
FEATURES = ["n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "distinct_share"]


def _stats(texts: list[str | None]) -> list[list]:
    out: list[list[int]] = [[] for _ in STATS]
    for text in texts:
        text = text or ""
        words = words_of(text)
        ids = word_ids(words)
        lines = [x for x in text.split("\n") if x.strip(SPACES)]
        row = (
            len(words),
            len(text) - sum(text.count(c) for c in SPACES),
            sum(text.count(c) for c in SYMBOLS),
            len(lines) - len(set(lines)),
            repeated_positions(ids),
            len(lines),
            int(ids.max()) + 1 if len(ids) else 0,
        )
        for values, x in zip(out, row, strict=True):
            values.append(x)
    return out


def statistics(docs: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """Counts of every whole text beside its id; a null text has none of anything."""
    return per_text(docs, ", ".join(f"{s} bigint" for s in STATS), _stats, ids)


def features() -> dict[str, Column]:
    """What the rules may ask, as expressions over the counts; a share of nothing is 0."""

    def share(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))

    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word": share("word_chars", "n_words"),
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "distinct_share": share("n_distinct_words", "n_words"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        return table[self.feature] > self.threshold if self.above else table[self.feature] <= self.threshold

    def column(self, made: dict[str, Column]) -> Column:
        return made[self.feature] > F.lit(self.threshold) if self.above else made[self.feature] <= F.lit(self.threshold)


Rule = tuple[Condition, ...]


def _covers(rule: Rule, table: dict[str, np.ndarray], n: int) -> np.ndarray:
    hit = np.ones(n, bool)
    for c in rule:
        hit &= c.holds(table)
    return hit


def _best_condition(table: dict[str, np.ndarray], bad: np.ndarray, cuts: int) -> tuple[float, Condition | None]:
    """Largest gain p1 * (log2 precision after - log2 precision before) over all thresholds.

    Thresholds lie halfway between neighbouring quantiles, so that rows just beyond what bad ones show are not named.
    """
    before = np.log2(bad.sum() / len(bad))
    best: tuple[float, Condition | None] = (0.0, None)
    for name, x in table.items():
        points = np.unique(np.quantile(x, np.linspace(0, 1, cuts + 2)))
        points = (points[1:] + points[:-1]) / 2
        order = np.sort(x)
        bad_order = np.sort(x[bad])
        for t in points:
            p_low, all_low = np.searchsorted(bad_order, t, "right"), np.searchsorted(order, t, "right")
            for above, p, total in ((False, p_low, all_low), (True, len(bad_order) - p_low, len(order) - all_low)):
                if p and total:
                    gain = p * (np.log2(p / total) - before)
                    if gain > best[0] + 1e-12:
                        best = (float(gain), Condition(name, above, float(t)))
    return best


def learn(table: dict[str, np.ndarray], bad: np.ndarray, max_rules: int = 12, max_conditions: int = 4, cuts: int = 64, precision: float = 0.9, seed: int = 7) -> list[Rule]:
    """Ordered rules that name bad rows; no rows, or none of one class, give no rules."""
    n = len(bad)
    part = np.random.default_rng(seed).permutation(n) % 3 == 0
    left = np.ones(n, bool)
    rules: list[Rule] = []
    while len(rules) < max_rules:
        grow = left & ~part
        rule: Rule = ()
        while len(rule) < max_conditions and bad[grow].any() and not bad[grow].all():
            _, found = _best_condition({k: v[grow] for k, v in table.items()}, bad[grow], cuts)
            if found is None:
                break
            rule += (found,)
            grow &= found.holds(table)
        held_out = left & part

        def worth(r: Rule, rows: np.ndarray = held_out) -> tuple[float, int]:
            hit = _covers(r, table, n) & rows
            p, q = int((hit & bad).sum()), int((hit & ~bad).sum())
            return (p - q) / max(1, p + q), p

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        if not rule or worth(rule)[0] < 2 * precision - 1 or worth(rule)[1] == 0:
            break
        rules.append(rule)
        left &= ~_covers(rule, table, n)
    return rules


def fired(rules: list[Rule]) -> Column:
    """Number (from 1) of the first rule that names a row bad, 0 if none."""
    made = features()
    out = None
    for k, rule in enumerate(rules, 1):
        asks = rule[0].column(made)
        for c in rule[1:]:
            asks = asks & c.column(made)
        out = F.when(asks, k) if out is None else out.when(asks, k)
    return F.lit(0) if out is None else out.otherwise(0)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, **how) -> list[Rule]:
    """Learns from at most ``sample_rows`` labelled rows (the smallest by hash of doc_id); all of them if fewer.

    Rows with a null doc_id, null text or null quality are no examples.  The sample bounds what the driver holds: ids, then
    seven counts a row.
    """
    chosen = (
        labels.filter("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )
    known = docs.filter(F.col("text").isNotNull()).select("doc_id", "text")
    rows = known.join(F.broadcast(chosen), "doc_id")  # at most sample_rows ids
    counted = statistics(rows, ["doc_id", "quality"])
    made = counted.select((F.col("quality") == 0).alias("bad"), *[c.alias(n) for n, c in features().items()]).toPandas()
    if made.empty:
        return []
    made = made.sort_values(list(made.columns), kind="stable")
    return learn({n: made[n].to_numpy(float) for n in FEATURES}, made["bad"].to_numpy(bool), **how)


def verdicts(docs: DataFrame, rules: list[Rule], ids: list[str] | None = None) -> DataFrame:
    """Counts, base_failed, the rule that fired and kept, for every row.

    Null and empty texts have no words and fail the base rule; an empty table gives no rows; repeated rows get
    equal verdicts.
    """
    rule = fired(rules)
    return (
        statistics(docs, ids)
        .withColumn("base_failed", base_failed())
        .withColumn("rule", rule)
        .withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
    )
