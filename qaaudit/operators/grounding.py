"""Grounding quality of responses, blind to style: how much of a response stands in its context."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import fixed_values as V
from ..functions import text as T


@F.pandas_udf(StructType([StructField("hits", IntegerType()), StructField("size", IntegerType())]))
def held_in(supply: pd.Series, demand: pd.Series) -> pd.DataFrame:
    """How many codes of the second array stand in the first; linear but for sorting, over Arrow batches.

    Its size comes along, so that what makes the array is computed once; both are null for a null array.
    """
    size = pd.Series([None if d is None else len(d) for d in demand], dtype="Int32")
    return pd.DataFrame({"hits": pd.Series([None if s is None or d is None else int(np.isin(d, s).sum()) for s, d in zip(supply, demand)], dtype="Int32"), "size": size})


def _score(response: Column, hits: Column, size: Column, final: Column, alpha: float) -> Column:
    """``size`` is null where nothing is left of a response."""
    raw = F.lit(V.GROUNDING_WEIGHT) * (F.lit(2.0) * hits / size - 1.0) + F.lit(V.FINAL_LINE_WEIGHT) * F.when(final != "", 1.0).otherwise(-1.0)
    bounded = lambda c: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))
    score = F.when(size.isNull(), F.lit(-1.0)).when(size == 0, F.lit(V.NO_TOKENS_SCORE)).otherwise(bounded(raw))
    if alpha > 0.0:
        length = F.greatest(F.lit(1), F.regexp_count(T.collapsed(response), F.lit("[a-z0-9]+")))
        score = bounded(score - F.lit(float(alpha)) * length)
    return F.when(response.isNotNull(), score)


def with_quality(rows: DataFrame, context: Column, **scores: Column | tuple[Column, float]) -> DataFrame:
    """Adds a grounding score in [-1, 1] per entry of ``scores``: a response, or a response and a length penalty per token.

    The context is cleaned and coded once for all entries; tokens are compared as 64-bit codes.  A null response has no score, a
    null context holds no token.
    """
    out = rows.withColumn("_context", F.coalesce(F.array_distinct(T.token_codes(T.strip_style(context))), F.array().cast("array<bigint>")))
    for name, entry in scores.items():
        response, alpha = entry if isinstance(entry, tuple) else (entry, 0.0)
        out = out.withColumn("_response", response).withColumn("_final", T.final_line(F.col("_response")))
        bare = T.strip_style(F.coalesce(T.or_null(F.col("_final")), F.col("_response")))
        tokens = T.let(bare, lambda b: F.when(b != "", T.token_codes(b, 2)))
        out = out.withColumn("_hits", held_in("_context", tokens))
        out = out.withColumn(name, _score(F.col("_response"), F.col("_hits.hits"), F.col("_hits.size"), F.col("_final"), alpha))
        out = out.drop("_response", "_final", "_hits")
    return out.drop("_context")
