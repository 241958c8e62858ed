"""Whole builds: corpus to experiment bundle, prompts to feedback logs, pairs to reward tables."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import salted_hash
from ..operators import normalize, pairs, retrieval, splits
from ..operators.experiment import Build
from ..sources import io
from ..sources.commits import commit_table, table_exists
from ..sources.schemas import REQUIRED_REWARD, ensure_base_rows, require_columns
from .config import Experiment, RetrievalBudget

# --- plug-ins ------------------------------------------------------------------------------------------


def load_builder(name: str) -> Callable[[SparkSession], DataFrame]:
    """A dataset builder given as ``module:function``."""
    module, _, attribute = name.partition(":")
    if not module or not attribute:
        raise ValueError(f"a builder is named module:function, not {name!r}")
    return getattr(importlib.import_module(module), attribute)


def build_from(spark: SparkSession, builder: str | Callable[[SparkSession], DataFrame], exp: Experiment) -> Build:
    """Experiment over the base rows a plug-in returns; their contract is checked."""
    make = load_builder(builder) if isinstance(builder, str) else builder
    return Build(ensure_base_rows(make(spark)), exp)


def score_with(df: DataFrame, scorer: Callable[[list[str], list[str]], Sequence[float]], prompt: Column, completion: Column, out: str = "score") -> DataFrame:
    """Scores from a user's batch scorer, called once per Arrow batch."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for prompts, completions in batches:
            yield pd.Series([float(s) for s in scorer(list(prompts), list(completions))])

    return df.withColumn(out, scored(prompt, completion))


# --- corpus builds -----------------------------------------------------------------------------------------


def answered_corpus(samples: DataFrame, exp: Experiment, dataset: str, remove_unanswerable: bool = True) -> tuple[Build, DataFrame]:
    """Questions over extracted documents: filter, first documents, base rows.

    Input columns document_id, document_topic, document_extracted, document_path,
    question_id, question, answer, row_order.
    """
    kept = normalize.filter_unanswerable(samples, remove_unanswerable)
    renamed = kept.withColumnsRenamed({"document_id": "doc_id", "document_extracted": "document", "answer": "gold_answer"})
    documents = normalize.first_documents(renamed, {"topic": "document_topic", "source_path": "document_path"}).withColumn("dataset", F.lit(dataset))
    rows = normalize.build_qa_rows(renamed.drop("document"), documents, dataset)
    keys = renamed.select("doc_id", F.concat_ws("::", "doc_id", "question_id").alias("example_id"))
    return Build(normalize.to_base_rows(rows), exp, keys), documents


def meeting_corpus(
    raw: DataFrame,
    exp: Experiment,
    dataset: str,
    train: RetrievalBudget,
    evaluation: RetrievalBudget,
    keep: float = 1.0,
    keep_seed: int = 0,
) -> tuple[Build, DataFrame, DataFrame]:
    """Raw rows under any aliases to an experiment over retrieval windows.

    Returns the build, the whole documents and the window statistics.  The windows use
    the experiment's own split: train budgets outside the evaluation pool.
    """
    rows = normalize.drop_incomplete(normalize.normalize_rows(raw, dataset))
    rows = splits.keep_ratio(rows, keep, keep_seed)
    documents = normalize.first_documents(rows).withColumn("dataset", F.lit(dataset))
    grouped = normalize.use_first_document(rows, documents).withColumn("group_id", F.concat_ws("::", "doc_id", "question_id"))
    base = normalize.to_base_rows(grouped)
    keys = rows.select("doc_id", F.concat_ws("::", "doc_id", "question_id").alias("example_id"))
    cuts = splits.split_cuts(keys, exp)
    windowed = io.staged(retrieval.window_rows(splits.assign_split(base, exp, cuts), train, evaluation, documents), "windows")
    shortened = windowed.withColumn("document", F.col("window")).drop("window", "answer_aware", "split")
    build = Build(shortened, exp, keys)
    return build, documents, retrieval.window_stats(windowed)


def write_experiment(build: Build, root: str, dataset: str, fmt: str = "json") -> str:
    """Every table of an experiment under ``<root>/<dataset>/<variant>``, all of them or none.

    The base rows with their documents, and the injected rows of all pools, are computed once for all tables.
    """
    once = Build(io.staged(build.base, "base"), build.exp, io.staged(build.keys, "keys"))
    once.rows = io.staged(once.rows, "experiment-rows")
    return io.write_bundle(once.tables(), root, dataset, build.exp.variant, fmt)


# --- feedback logs and reward tables ---------------------------------------------------------------------------


def feedback_bundle(train: DataFrame, evaluation: DataFrame, documents: DataFrame, template: str, seed: int = 42, **options) -> dict[str, DataFrame]:
    """Prompts and feedback logs of both sides with their counts.

    Training rows use ``seed`` and evaluation rows ``seed + 1``; metadata holds the
    expected and the actual number of feedback rows of each side.
    """
    out = {"documents": documents}
    metadata = None
    for name, rows, own_seed in (("train", train, seed), ("eval", evaluation, seed + 1)):
        prompts = pairs.prompt_rows(rows).withColumn("split", F.lit(name))
        feedback = io.staged(pairs.feedback_rows(prompts, template, own_seed, **options), f"feedback-{name}")
        out[name], out[f"feedback_{name}"] = prompts.drop("split"), feedback.drop("split")
        stats = pairs.feedback_stats(feedback).select(
            "*", (F.col("num_prompt_rows") * 2).alias("expected_feedback_rows"), F.col("num_feedback_rows").alias("actual_feedback_rows")
        )
        metadata = stats if metadata is None else metadata.unionByName(stats)
    out["metadata"] = metadata
    return out


def reward_tables(
    spark: SparkSession,
    pairs_train: DataFrame,
    pairs_eval: DataFrame,
    template: str,
    train_path: str,
    eval_path: str,
    documents: DataFrame | None = None,
    force: bool = False,
    compress: dict | None = None,
    fmt: str = "json",
    key: Sequence[str] = (),
    **options,
) -> tuple[str, str]:
    """Write the reward tables; kept as they are when both are there as a whole, unless forced.

    Balancing and capping order rows by ``key``, columns that name a row.  They need one: a number given to rows while they are
    read would depend on how the input is dealt out, and so would the rows that are kept.
    """
    if not key and any(options.get(k) for k in ("balance_train", "balance_eval", "eval_max_rows")):
        raise ValueError("balancing and capping need a key that names a row")
    if not force and table_exists(spark, train_path) and table_exists(spark, eval_path):
        return train_path, eval_path
    shorten = None
    if compress is not None:
        shorten = lambda context, question, answer: retrieval.compress_context(context, question, answer, **compress)
    made = []
    for name, rows in (("train", pairs_train), ("eval", pairs_eval)):
        reward = pairs.reward_rows(rows, template, documents, compress=shorten, keep=tuple(key))
        row = salted_hash("reward", *key) if key else F.lit("")
        made.append(io.staged(reward.select(*REQUIRED_REWARD, row.alias("_key")), f"reward-{name}"))
    train, evaluation = pairs.reward_datasets(*made, key=["_key"], **options)
    for table, path in ((train, train_path), (evaluation, eval_path)):
        if table.isEmpty():
            raise ValueError(f"no reward rows could be built for {path}")
        commit_table(require_columns(table.drop("_key"), REQUIRED_REWARD, "reward rows"), path, fmt)
    return train_path, eval_path
