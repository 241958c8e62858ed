"""Language identification by a byte convolutional network.

Filters of several widths slide over the bytes of fixed-length windows; each filter's largest answer in a window feeds a
softmax layer.  A filter is a table of one weight for each byte at each of its places, so a convolution is a sum of table
rows.  The network is trained in numpy on a bounded sample; every window of every text is scored, in batches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .text_stats import beside_rows, per_text

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
UNKNOWN = "und"


@dataclass
class Network:
    labels: list[str]
    tables: list[np.ndarray]  # for each width: (width, 256, filters)
    weights: np.ndarray  # (all filters, labels)
    bias: np.ndarray

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest answer of each filter in each window, and where."""
        values, places = [], []
        for table in self.tables:
            n = windows.shape[1] - len(table) + 1
            answer = table[0][windows[:, :n]]
            for k in range(1, len(table)):
                answer += table[k][windows[:, k : k + n]]
            values.append(answer.max(axis=1))
            places.append(answer.argmax(axis=1))
        return np.maximum(np.concatenate(values, 1), 0), np.concatenate(places, 1)

    def largest(self, windows: np.ndarray) -> np.ndarray:
        """``pooled`` without the places, in blocks that stay in the processor's cache."""
        out = np.empty((len(windows), len(self.tables) * self.tables[0].shape[2]), np.float32)
        for i in range(0, len(windows), 64):
            part, at = windows[i : i + 64], 0
            for table in self.tables:
                n = part.shape[1] - len(table) + 1
                answer = table[0].take(part[:, :n], axis=0)
                for k in range(1, len(table)):
                    answer += table[k].take(part[:, k : k + n], axis=0)
                out[i : i + 64, at : at + table.shape[2]] = answer.max(axis=1)
                at += table.shape[2]
        return np.maximum(out, 0)

    def scores(self, pooled: np.ndarray) -> np.ndarray:
        z = pooled @ self.weights + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def windows_of(text: str, size: int = WINDOW) -> np.ndarray:
    """All windows of a text's bytes, the last padded with zeros; white space runs count as they are."""
    raw = np.frombuffer(text.encode(), np.uint8)
    n = max(1, -(-len(raw) // size))
    out = np.zeros(n * size, np.uint8)
    out[: len(raw)] = raw
    return out.reshape(n, size)


def train(windows: np.ndarray, truth: np.ndarray, labels: list[str], epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 11) -> Network:
    """Adam on the cross entropy; the gradient of a maximum goes to the bytes under it."""
    rng = np.random.default_rng(seed)
    tables = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    for t in tables:
        t[:, 0, :] = -1.0  # padding never answers
    net = Network(labels, tables, rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(labels))).astype(np.float32), np.zeros(len(labels), np.float32))
    params = [*net.tables, net.weights, net.bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for i in range(0, len(order), batch):
            at = order[i : i + batch]
            x, y = windows[at], truth[at]
            pooled, places = net.pooled(x)
            slope = net.scores(pooled)
            slope[np.arange(len(y)), y] -= 1
            slope /= len(y)
            back = (slope @ net.weights.T) * (pooled > 0)
            grads = []
            for k, table in enumerate(net.tables):
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                grad = np.zeros_like(table)
                f = np.broadcast_to(np.arange(FILTERS), places[:, cols].shape)
                for j in range(len(table)):
                    np.add.at(grad[j], (np.take_along_axis(x, places[:, cols] + j, 1), f), back[:, cols])
                grad[:, 0, :] = 0
                grads.append(grad)
            grads += [pooled.T @ slope, slope.sum(axis=0)]
            step += 1
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, docs_per_label: int = 300, windows_per_doc: int = 8, max_labels: int = 256) -> Network | None:
    """Learns from text and lang of rows that are not held out; None if there are none.

    The sample is bounded: the ``docs_per_label`` rows of each label with the smallest hash of doc_id and text, and at most
    ``windows_per_doc`` evenly spaced windows of each.  Rows with null lang or text, or without a letter, are no examples.  More
    labels than ``max_labels`` are an error.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~is_held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    sizes = {r[0]: r[1] for r in known.groupBy("lang").count().limit(max_labels + 1).collect()}
    labels = sorted(sizes)
    if len(labels) > max_labels:
        raise ValueError(f"more than {max_labels} languages")
    if not labels:
        return None
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    # one reading for all labels: of each, four times as many rows as wanted come to the task that ranks them
    enough = {x: int(min(1.0, 4 * docs_per_label / sizes[x]) * (1 << 40)) for x in labels}
    limit = F.element_at(F.create_map(*[F.lit(v) for x in labels for v in (x, enough[x])]), F.col("lang"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id", F.sha2("text", 256)))
    chosen = known.withColumn("draw", draw).where(F.col("draw") <= limit).withColumn("rank", rank).where(F.col("rank") <= docs_per_label)

    def cut(texts: list[str | None]) -> list[list]:
        out = []
        for t in texts:
            w = windows_of(t or "")
            out.append([x.tobytes() for x in w[np.unique(np.linspace(0, len(w) - 1, windows_per_doc).astype(int))]])
        return [out]

    rows = per_text(chosen, "w array<binary>", cut, ["doc_id", "lang"]).toPandas()
    rows = rows.sort_values(["doc_id", "lang"], kind="stable")
    truth = np.array([labels.index(x) for x, w in zip(rows["lang"], rows["w"], strict=True) for _ in w])
    windows = np.array([np.frombuffer(b, np.uint8) for w in rows["w"] for b in w])
    # short examples too: the heads of half of the windows, padded
    rng = np.random.default_rng(3)
    heads = windows.copy()
    heads[np.arange(WINDOW)[None, :] >= rng.integers(8, 96, len(heads))[:, None]] = 0
    return train(np.concatenate([windows, heads]), np.concatenate([truth, truth]), labels)


def _answers(net: Network | None) -> Callable[[list[str | None]], list[list]]:
    def answer(texts: list[str | None]) -> list[list]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        at = [i for i, t in enumerate(texts) if t and net is not None and any(map(str.isalpha, t))]
        for lo in range(0, len(at), 256):
            some = at[lo : lo + 256]
            cut = [windows_of(texts[i]) for i in some]
            starts = np.cumsum([0, *map(len, cut)])[:-1]
            every = np.concatenate(cut)
            weight = (every != 0).sum(axis=1).astype(np.float64)[:, None] + 1e-9
            mean = np.add.reduceat(net.scores(net.largest(every)) * weight, starts) / np.add.reduceat(weight, starts)
            for i, row in zip(some, mean, strict=True):
                k = int(row.argmax())
                names[i], scores[i] = net.labels[k], float(min(1.0, row[k]))
        return [names, scores]

    return answer


ANSWER = "lang_pred string, score double"


def predict(docs: DataFrame, net: Network | None, ids: list[str] | None = None) -> DataFrame:
    """``lang_pred`` and ``score`` of every row beside its ids.

    The mean of the windows' answers over the whole text, weighted by their bytes; ties go to the first label.  A text that is
    null or has no letter, or any text without a network, is ``und`` with score 0.  Repeated rows get equal answers, an empty table
    gives no rows; of a very long text a task holds the windows, 256 texts at a time.
    """
    return per_text(docs, ANSWER, _answers(net), ids)


def keep_known(docs: DataFrame, net: Network | None, least: float = 0.0) -> DataFrame:
    """The rows of ``docs``, whole, whose language is known with a score of at least ``least``; all columns stay.

    Repeated rows are judged alike, an empty table stays empty.  A named text scores at least 1 / number of labels, and less the more labels share it, so no score is asked for unless given.
    """
    named, own = beside_rows(docs, ANSWER, _answers(net))
    known = named.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return known.select(*[own[c].alias(c) for c in docs.columns])
