"""N-gram Jaccard join: MinHash banding for candidates, verification on the full n-gram sets.

1. Every whole text gives its set of n-grams, a digest of the set, and one hash per band of its MinHash signature.  Texts
   with equal sets are one node from here on.
2. Band hashes are shuffled; a bucket links its members to its smallest member, never to each other.  Connected
   buckets are candidate components.
3. A component is cut into blocks of bounded size; each pair of blocks is one tile.  A tile compares its n-gram sets exactly, by
   products of incidence matrices, and returns for each node its number of links and the smallest node it is connected
   to.  Pairs are never rows.
4. The tiles' connections are joined to classes; documents find their class by the digest of their set.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.io import staged
from .text_stats import per_text, words_of

WIDTH, SIMILARITY, ROWS, RECALL = 5, 0.8, 5, 0.9995
BLOCK_NODES, BLOCK_GRAMS = 2048, 750_000
#: Columns and rows of a tile's matrices that are worked on at once, and word hashes a task remembers.
COLUMNS, STRIPE, MEMORY_WORDS = 1024, 256, 250_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def bands_for(similarity: float = SIMILARITY, rows: int = ROWS, recall: float = RECALL) -> int:
    """Fewest bands of ``rows`` values that find a pair of this similarity with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


class Grams:
    """Sorted distinct 64-bit hashes of the n-grams of texts; word hashes are remembered, boundedly."""

    def __init__(self, width: int = WIDTH):
        self.width, self.known = width, {}

    def of(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > MEMORY_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        own = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = max(1, len(own) - self.width + 1)  # a shorter text is one n-gram
        out = np.zeros(n, np.uint64)
        for k in range(min(self.width, len(own))):
            out = _mixed(out + own[k : k + n] + np.uint64(k + 1))
        return np.unique(out)


class Signature:
    """MinHash of 64-bit hashes: one multiplicative permutation of 32-bit values for each row of each band."""

    def __init__(self, bands: int, rows: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.times = (rng.integers(0, 1 << 32, bands * rows, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
        self.plus = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint64).astype(np.uint32)[:, None]
        self.fold = rng.integers(0, 1 << 63, rows, dtype=np.uint64) | np.uint64(1)

    def of(self, grams: np.ndarray) -> np.ndarray:
        low, high = grams.astype(np.uint32), (grams >> np.uint64(32)).astype(np.uint32)
        least = np.full(self.bands * self.rows, 0xFFFFFFFF, np.uint32)
        for lo in range(0, len(grams), 1024):
            x = low[None, lo : lo + 1024] * self.times
            x ^= x >> np.uint32(15)
            x += high[None, lo : lo + 1024]
            x *= self.times
            x += self.plus
            np.minimum(least, x.min(axis=1), out=least)
        folded = (least.reshape(self.bands, self.rows).astype(np.uint64) * self.fold[None, :]).sum(axis=1, dtype=np.uint64)
        return _mixed(folded).view(np.int64)


def sets_of(docs: DataFrame, width: int, bands: int, rows: int, ids: list[str]) -> DataFrame:
    """Beside the ids: digest of the n-gram set (null without words), its size, and the band hashes."""

    def work(texts: list[str | None]) -> list[list]:
        grams, signature = Grams(width), Signature(bands, rows)
        out: list[list] = [[], [], []]
        for t in texts:
            g = grams.of(t)
            out[0].append(xxhash.xxh3_128_digest(g.tobytes()) if len(g) else None)
            out[1].append(len(g))
            out[2].append(signature.of(g) if len(g) else None)
        return out

    return per_text(docs, "node binary, n_grams int, bands array<bigint>", work, ids)


def components(edges: DataFrame, name: str, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a, b): the smallest node it is connected to.

    Each round takes the smallest label around a node and then the label of that label, and is written to the shared folder;
    rounds end when no label changed, or fail after ``most_rounds``.
    """
    both = staged(edges.union(edges.select("b", "a")).distinct(), f"{name}-edges")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("root")), f"{name}-0")
    for k in range(1, most_rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("near"))
        joined = labels.join(near, labels["node"] == near["a"]).select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        up = joined.select(F.col("node").alias("root"), F.col("root").alias("up"))
        made = joined.join(up, "root", "left").select("node", "old", F.least("root", F.coalesce("up", "root")).alias("root"))
        made = staged(made, f"{name}-{k}")
        labels = made.select("node", "root")
        if made.filter("old <> root").isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def _linked(a: list[np.ndarray], b: list[np.ndarray] | None, similarity: float) -> np.ndarray:
    """Boolean matrix of pairs with Jaccard similarity of at least ``similarity``; ``b`` None: a with itself, without the diagonal."""
    rows = a if b is None else a + b
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    _, code, count = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(rows)), sizes)
    shared = count > 1  # an n-gram of one text is in no intersection
    number = np.cumsum(shared) - 1
    at = shared[code]
    code, owner = number[code[at]], owner[at]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    total, m = int(shared.sum()), len(a)
    both = np.zeros((m, len(rows) - m if b is not None else m), np.float32)
    for lo in range(0, total, COLUMNS):
        i, j = np.searchsorted(code, [lo, lo + COLUMNS])
        x = np.zeros((len(rows), min(COLUMNS, total - lo)), np.float32)
        x[owner[i:j], code[i:j] - lo] = 1
        both += x[:m] @ (x if b is None else x[m:]).T
    n, other = sizes[:m].astype(np.float64)[:, None], (sizes if b is None else sizes[m:]).astype(np.float64)[None, :]
    out = np.empty(both.shape, bool)
    for lo in range(0, m, STRIPE):
        shared_by = both[lo : lo + STRIPE].astype(np.float64)
        out[lo : lo + STRIPE] = shared_by / (n[lo : lo + STRIPE] + other - shared_by) >= similarity
    if b is None:
        np.fill_diagonal(out, False)
    return out


def _roots(links: np.ndarray, square: bool) -> tuple[np.ndarray, np.ndarray]:
    """For rows and columns of a tile: the smallest position (columns counted after the rows, or as rows) in their component."""
    m, n = links.shape
    row = np.arange(m, dtype=np.int32)
    col = row if square else np.arange(m, m + n, dtype=np.int32)
    big = np.int32(m + n)

    def least(matrix: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Smallest label among those that each row is linked to."""
        parts = [np.where(matrix[i : i + STRIPE], labels[None, :], big).min(axis=1, initial=big) for i in range(0, len(matrix), STRIPE)]
        return np.concatenate(parts)

    while True:
        new_row = np.minimum(row, least(links, col))
        new_col = np.minimum(col, least(links.T, new_row))
        if square:
            new_row = new_col = np.minimum(new_row, new_col)
        if (new_row == row).all() and (new_col == col).all():
            return row, col
        row, col = new_row, new_col


def _tiles(similarity: float):
    """Streams rows sorted by tile; holds one tile at a time."""

    def close(lo: int, hi: int, rows: list[tuple[int, bytes, bytes]]) -> Iterator[tuple[bytes, int, bytes]]:
        sides: dict[int, dict[bytes, np.ndarray]] = {lo: {}, hi: {}}  # by node: repeated rows count once
        for block, node, grams in sorted(rows):
            sides[block][node] = np.frombuffer(grams, np.uint64)
        a, b = list(sides[lo].items()), list(sides[hi].items())
        square = lo == hi
        if len(a) < 1 + square or not b:
            return
        links = _linked([g for _, g in a], None if square else [g for _, g in b], similarity)
        row, col = _roots(links, square)
        names = [n for n, _ in a] + ([] if square else [n for n, _ in b])
        counts = links.sum(axis=1).tolist() + ([] if square else links.sum(axis=0).tolist())
        for node, count, root in zip(names, counts, row.tolist() + ([] if square else col.tolist()), strict=True):
            if count:
                yield node, count, names[root]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []
        for batch in batches:
            own = [c.to_pylist() for c in batch.columns]
            for component, lo, hi, block, node, grams in zip(*own, strict=True):
                if key != (component, lo, hi):
                    if key:
                        out += close(key[1], key[2], rows)
                    key, rows = (component, lo, hi), []
                rows.append((block, node, grams))
            if len(out) > 10_000:
                yield _batch(out)
                out = []
        if key:
            out += close(key[1], key[2], rows)
        if out:
            yield _batch(out)

    return run


def _batch(rows: list[tuple[bytes, int, bytes]]) -> pa.RecordBatch:
    a, n, b = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(n, pa.int64()), pa.array(b, pa.binary())], ["node", "links", "root"])


def classes(
    docs: DataFrame,
    width: int = WIDTH,
    similarity: float = SIMILARITY,
    rows: int = ROWS,
    recall: float = RECALL,
    block_nodes: int = BLOCK_NODES,
    block_grams: int = BLOCK_GRAMS,
    ids: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """One row per row of ``docs``: its ids, copy_of, n_copies, class_id, n_links.

    copy_of is the smallest doc_id with the same n-gram set, n_copies how many rows have that set; n_links counts
    the different sets with a similarity of at least ``similarity``; class_id is the smallest doc_id connected by copies
    and links; both are null where every such row has a null doc_id, and n_copies and n_links count those rows too.  Texts of 1 to ``width`` - 1 words are one n-gram.  Texts without words (null, empty) are linked to nothing and
    alone in their class.  Repeated rows are copies.  An empty table gives no rows.
    """
    public = [*ids, "copy_of", "n_copies", "class_id", "n_links"]
    return _classes(docs, width, similarity, rows, recall, block_nodes, block_grams, ids).select(*public)


def _spare():
    """What a row without a doc_id is found by: a hash of its text, else null."""
    return F.when(F.col("doc_id").isNull(), F.xxhash64("text"))


def _classes(
    docs: DataFrame,
    width: int = WIDTH,
    similarity: float = SIMILARITY,
    rows: int = ROWS,
    recall: float = RECALL,
    block_nodes: int = BLOCK_NODES,
    block_grams: int = BLOCK_GRAMS,
    ids: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """``classes`` with spare, and class_spare: the smallest spare of a class without any doc_id."""
    docs = docs.select(*ids, "text", _spare().alias("spare"))
    keys = [*ids, "spare"]
    bands = bands_for(similarity, rows, recall)
    sets = staged(sets_of(docs, width, bands, rows, keys), "ngram-sets")
    nodes = staged(
        sets.filter("node is not null")
        .groupBy("node", "bands", "n_grams")
        .agg(F.min("doc_id").alias("copy_of"), F.min("spare").alias("node_spare"), F.count("*").alias("n_copies"))
        .withColumn("node_spare", F.when(F.col("copy_of").isNull(), F.col("node_spare"))),
        "ngram-nodes",
    )
    in_band = nodes.select("node", F.posexplode("bands").alias("band", "hash"))
    hubs = in_band.groupBy("band", "hash").agg(F.min("node").alias("hub"), F.count("*").alias("n")).filter("n > 1").drop("n")
    edges = in_band.join(hubs, ["band", "hash"]).filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    candidates = components(edges, "ngram-candidates")
    sized = candidates.join(nodes.select("node", "n_grams", "copy_of", "node_spare"), "node")
    blocks = sized.groupBy("root").agg(
        F.greatest(F.ceil(F.count("*") / block_nodes), F.ceil(F.sum("n_grams") / block_grams)).cast("int").alias("blocks")
    )
    placed = staged(
        sized.join(blocks, "root").select("node", "copy_of", "node_spare", F.col("root").alias("component"), "blocks", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block")),
        "ngram-placed",
    )
    # merged at every size: neither side is bounded
    same = F.col("doc_id").eqNullSafe(F.col("copy_of")) & F.col("spare").eqNullSafe(F.col("node_spare"))
    texts = docs.select("doc_id", "text", "spare").join(placed.hint("merge"), same)
    grams = _grams(texts, width)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = grams.select("component", "block", "node", "grams", other).select(
        "component", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "grams"
    )
    tile = ["component", "lo", "hi"]
    compared = dealt.repartition(*tile).sortWithinPartitions(*tile).mapInArrow(_tiles(similarity), "node binary, links bigint, root binary")
    compared = staged(compared, "ngram-links")
    links = compared.groupBy("node").agg(F.sum("links").alias("n_links"))
    roots = components(compared.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")), "ngram-classes")
    named = nodes.select("node", "copy_of", "node_spare", "n_copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = named.groupBy("root").agg(F.min("copy_of").alias("class_id"), F.min("node_spare").alias("class_spare"))
    whole = named.join(first, "root").join(links, "node", "left").drop("root", "node_spare")
    return sets.select(*keys, "node").join(whole, "node", "left").select(
        *keys,
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("copy_of")).alias("copy_of"),
        F.coalesce("n_copies", F.lit(1)).cast("bigint").alias("n_copies"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.when(F.col("node").isNull(), F.col("spare")).when(F.col("class_id").isNull(), F.col("class_spare")).alias("class_spare"),
    )


def _grams(texts: DataFrame, width: int) -> DataFrame:
    """One set for each node; a text of another set that shares the doc_id is passed over by its digest."""

    def work(batch: list[str | None]) -> list[list]:
        grams = Grams(width)
        found = [grams.of(t) for t in batch]
        return [[xxhash.xxh3_128_digest(g.tobytes()) for g in found], [g.tobytes() for g in found]]

    made = per_text(texts, "own binary, grams binary", work, ["node", "component", "blocks", "block"])
    return made.filter("own = node").drop("own")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """One row of each class, whole: the one with the smallest doc_id; rows without words all stay.

    ``docs`` is expected without exact copies; rows that repeat a doc_id within a class share its fate.  A row with a null doc_id
    stays only if its class has no other doc_id, and then the one with the smallest hash of its text.
    """
    key = f"k{uuid.uuid4().hex}"
    first = F.col("doc_id").eqNullSafe(F.col("class_id")) & F.col("spare").eqNullSafe(F.col("class_spare"))
    kept = _classes(docs.select("doc_id", "text"), **how).filter(first).select(F.col("doc_id").alias(key), F.col("spare").alias(f"{key}s")).distinct()
    same = docs["doc_id"].eqNullSafe(kept[key]) & F.when(docs["doc_id"].isNull(), F.xxhash64(docs["text"])).eqNullSafe(kept[f"{key}s"])
    return docs.join(kept.hint("merge"), same, "left_semi")
