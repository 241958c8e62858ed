"""Which of many literal patterns a text holds, in one reading of the text."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@cache
def _automaton(patterns: tuple[str, ...]):
    import ahocorasick

    made = ahocorasick.Automaton()
    for p in patterns:
        made.add_word(p, p)
    made.make_automaton()
    return made


def held_patterns(patterns: Sequence[str]) -> Callable[[Column], Column]:
    """A column function: the sorted patterns that stand in a text, those inside others too; none in a null text.

    The cost of a text is its length and the number of its hits, whatever the number of patterns.
    """
    given = tuple(sorted({p for p in patterns if p}))
    if not given:
        return lambda text: F.array().cast("array<string>")

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        found = _automaton(given)
        for batch in batches:
            yield pd.Series([sorted({p for _, p in found.iter(t)}) if t else [] for t in batch])

    return run
