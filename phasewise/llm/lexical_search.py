"""Ranked lexical search: exact sparse ball-tree inner-product search with integer scores.

A document's score for a query is an inner product: the query holds a weight w per distinct
term, the document a value per term,

    w = floor(1000 * ln((2N + 2) / (2 df + 1)))                  (doubles, then an integer)
    m = 10 + (90 * n * N) div L
    value = (10**9 * tf) div (1000 * tf + 8 * m)                  (64-bit integers)

with N documents that have a term, L all their terms, n and tf a document's terms and a
term's occurrences in it, df the documents holding the term. Term counts, N, L and df are
DataFrame aggregations over all documents. Only terms of some query can add to a score, so
document vectors are kept on those terms alone; a document without any scores 0 everywhere
and is left out.

Documents are dealt into blocks of about ``BLOCK_DOCS`` by a hash of their row; a block
receives the entries of its documents only, one row per (document, query term). Every block
builds a ball tree over its sparse vectors: a node holds its centroid c and radius r, and is
split at the median of the projection on the line between two far-apart documents, down to
leaves of ``LEAF`` documents. No document below a node scores more than ``q.c + |q| r`` for a
query q; the bound, widened for rounding, orders a best-first search, a node whose bound is
below the k-th best score found is pruned, and at the leaves scores are computed exactly in
64-bit integers. Queries meet blocks in a cogroup, every query every block (the query set is
stated; the documents are all rows); the best k of each block are merged per query by a window.
"""

from __future__ import annotations

import functools
import heapq
import math
import string

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phasewise.llm.staging import stage

# Fixed values of the ranking contract: term class, lower-casing, score constants.
TERMS = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
K1, B_PERCENT, SCALE, WEIGHT_SCALE = 1000, 90, 1_000_000_000, 1000
TOP = 10

#: Documents of a block, and documents of a leaf of its tree.
BLOCK_DOCS = 2000
LEAF = 16
#: Query terms broadcast to the scan at most; beyond, they are joined by a shuffle.
BROADCAST_TERMS = 1 << 20
#: Relative widening of float bounds, far above the rounding error of their sums.
SLACK = 1e-7

_HITS = "qid long, rid long, dk long, dnull boolean, score long"


def terms(text: Column) -> Column:
    """Terms of a text: maximal runs of the term class, only A-Z lower-cased; null: none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase,
                          string.ascii_lowercase)
    return F.regexp_extract_all(lowered, F.lit(TERMS), 0)


class _Tree:
    """Ball tree over the rows of a sparse matrix (CSR: indptr, indices, values)."""

    def __init__(self, indptr: np.ndarray, indices: np.ndarray, values: np.ndarray, width: int):
        self.indptr, self.indices, self.width = indptr, indices, width
        self.values, self.floats = values, values.astype(np.float64)
        self.norm2 = self._sums(np.arange(len(indptr) - 1), self.floats ** 2)
        self.members: list[np.ndarray] = [np.arange(len(indptr) - 1)]
        self.children: list[tuple[int, int] | None] = [None]
        centroids, radii = [], []
        at = 0
        while at < len(self.members):  # breadth first; children get the next numbers
            rows = self.members[at]
            centroid, radius = self._ball(rows)
            centroids.append(centroid)
            radii.append(radius)
            if len(rows) > LEAF:
                self.children[at] = (len(self.members), len(self.members) + 1)
                self.members += list(self._split(rows, centroid))
                self.children += [None, None]
            at += 1
        self.centroids, self.radii = np.array(centroids), np.array(radii)

    def _entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends = self.indptr[rows], self.indptr[rows + 1]
        lengths = ends - starts
        offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        positions = np.repeat(starts - offsets, lengths) + np.arange(lengths.sum())
        return positions, offsets

    def _sums(self, rows: np.ndarray, per_entry: np.ndarray) -> np.ndarray:
        positions, offsets = self._entries(rows)
        return np.add.reduceat(per_entry[positions], offsets) if len(rows) else np.zeros(0)

    def _dots(self, rows: np.ndarray, dense: np.ndarray) -> np.ndarray:
        positions, offsets = self._entries(rows)
        return np.add.reduceat(self.floats[positions] * dense[self.indices[positions]], offsets)

    def _ball(self, rows: np.ndarray) -> tuple[np.ndarray, float]:
        positions, _ = self._entries(rows)
        centroid = np.bincount(self.indices[positions], weights=self.floats[positions],
                               minlength=self.width) / len(rows)
        far = self.norm2[rows] - 2 * self._dots(rows, centroid) + centroid @ centroid
        return centroid, math.sqrt(max(float(far.max()), 0.0))

    def _split(self, rows: np.ndarray, centroid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        far = self.norm2[rows] - 2 * self._dots(rows, centroid)
        a = self._dense(rows[int(np.argmax(far))])
        b = self._dense(rows[int(np.argmax(self.norm2[rows] - 2 * self._dots(rows, a)))])
        order = np.argsort(self._dots(rows, b - a), kind="stable")
        half = len(rows) // 2
        return rows[order[:half]], rows[order[half:]]

    def _dense(self, row: int) -> np.ndarray:
        out = np.zeros(self.width)
        begin, end = self.indptr[row], self.indptr[row + 1]
        out[self.indices[begin:end]] = self.floats[begin:end]
        return out

    def scores(self, rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact scores of rows for integer query weights over the columns."""
        positions, offsets = self._entries(rows)
        return np.add.reduceat(self.values[positions] * weights[self.indices[positions]], offsets)


def best(tree: _Tree, keys: np.ndarray, weights: np.ndarray, bounds: np.ndarray, k: int):
    """The k best rows (score > 0) for one query: [(score, row)], best first.

    Best first by the bound of nodes; a node is opened unless its bound is below the k-th
    best score, so rows tied with it in score are still seen. Equal scores go to the smaller
    ``keys`` (distinct integers).
    """
    found: list[tuple[int, int, int]] = []  # (score, -key, -row): the worst on top
    queue = [(-bounds[0], 0)]
    while queue:
        bound, node = heapq.heappop(queue)
        if len(found) == k and -bound < found[0][0]:
            break
        children = tree.children[node]
        if children is not None:
            for child in children:
                if not (len(found) == k and bounds[child] < found[0][0]):
                    heapq.heappush(queue, (-bounds[child], child))
            continue
        rows = tree.members[node]
        for row, score in zip(rows.tolist(), tree.scores(rows, weights).tolist()):
            if score <= 0:
                continue
            entry = (score, -int(keys[row]), -row)
            if len(found) < k:
                heapq.heappush(found, entry)
            elif entry > found[0]:
                heapq.heapreplace(found, entry)
    return sorted(((s, -r) for s, _, r in found), key=lambda x: (-x[0], keys[x[1]], x[1]))


_COLUMNS = [c.split()[0] for c in _HITS.split(", ")]


def _search_block(entries: pd.DataFrame, queries: pd.DataFrame, top: int = TOP) -> pd.DataFrame:
    """Best ``top`` rows of a block per query; ``entries`` holds (rid, dk, dnull, term, value)."""
    if entries.empty or queries.empty:
        return pd.DataFrame({c: pd.Series([], dtype="bool" if c == "dnull" else "int64")
                             for c in _COLUMNS})
    entries = entries.sort_values("rid", kind="stable").reset_index(drop=True)
    vocabulary: dict[str, int] = {}
    indices = np.array([vocabulary.setdefault(t, len(vocabulary)) for t in entries["term"]],
                       dtype=np.int64)
    rids = entries["rid"].to_numpy()
    starts = np.flatnonzero(np.r_[True, rids[1:] != rids[:-1]])
    indptr = np.r_[starts, len(rids)].astype(np.int64)
    tree = _Tree(indptr, indices, entries["value"].to_numpy(dtype=np.int64), len(vocabulary))
    docs = entries.iloc[starts].reset_index(drop=True)[["rid", "dk", "dnull"]]
    # Ties go by doc_id, nulls last, then by row: the place of a row in that order.
    order = np.lexsort((docs["rid"].to_numpy(), docs["dk"].to_numpy(), docs["dnull"].to_numpy()))
    keys = np.empty(len(order), dtype=np.int64)
    keys[order] = np.arange(len(order))
    out = []
    for qid, names, numbers in zip(queries["qid"], queries["terms"], queries["weights"]):
        weights = np.zeros(len(vocabulary), dtype=np.int64)
        for name, w in zip(names, numbers):
            if name in vocabulary:
                weights[vocabulary[name]] = w
        if not weights.any():
            continue
        q = weights.astype(np.float64)
        norm = math.sqrt(q @ q)
        centre = tree.centroids @ q
        reach = norm * tree.radii
        bounds = centre + reach + SLACK * (np.abs(centre) + reach) + 1.0
        for score, row in best(tree, keys, weights, bounds, top):
            out.append((qid, docs["rid"].iat[row], docs["dk"].iat[row], docs["dnull"].iat[row],
                        score))
    if not out:
        return _search_block(docs.iloc[:0], queries)
    return pd.DataFrame(out, columns=_COLUMNS)


def rank(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """Per item of ``items`` (item_id, text): its ``top`` best documents with score above 0.

    Columns: item_id, rank (int, from 1), doc_id, score (long); equal scores by ascending
    doc_id, nulls last. Every row of ``docs`` (doc_id, text) is a document, repeated rows
    too; items with equal item_id are one item with the terms of all. Null texts have no
    terms; items without terms, and empty tables, give no rows. Other columns, however
    named, are not read. Texts of any length are read whole.

    The texts are read once: each row gives one summary entry (its term count) and one entry
    per occurrence of a query term, counted into term frequencies on the map side. Query
    terms are broadcast when there are at most ``BROADCAST_TERMS`` of them (the count is
    checked), else joined by a shuffle.
    """
    spark = docs.sparkSession
    empty = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    queries = stage(items.select(F.col("item_id").alias("qitem")).distinct()
                    .withColumn("qid", F.monotonically_increasing_id()), "lexical-items")
    query_terms = stage(items.select("item_id", F.explode(terms(F.col("text"))).alias("term"))
                        .join(queries, F.col("item_id").eqNullSafe(F.col("qitem")))
                        .select("qid", "term").distinct(), "lexical-query-terms")
    wanted = query_terms.select("term").distinct().withColumn("asked", F.lit(True))
    if wanted.count() <= BROADCAST_TERMS:
        wanted = F.broadcast(wanted)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id",
                       terms(F.col("text")).alias("ts"))
    # A null entry per row carries its term count n; the others are its query terms.
    each = rows.select("rid", "doc_id", F.size("ts").cast("long").alias("n"),
                       F.explode(F.concat(F.array(F.lit(None).cast("string")), "ts")).alias("term"))
    kept = each.join(wanted, "term", "left").filter(F.col("term").isNull() | F.col("asked"))
    counts = stage(kept.groupBy("rid", "doc_id", "n", "term").agg(
        F.count(F.lit(1)).alias("tf")), "lexical-counts")
    n_docs, n_terms = counts.filter("term is null and n > 0").agg(
        F.count(F.lit(1)), F.sum("n").cast("long")).first()
    if not n_docs:
        return empty
    found = counts.filter("term is not null")
    ratio = F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1).cast("double")
    weights = (found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
               .select("term", F.floor(F.log(ratio) * WEIGHT_SCALE).cast("long").alias("w")))
    m = F.lit(100 - B_PERCENT) + F.expr(f"({B_PERCENT} * n * {n_docs}L) div {n_terms}L")
    value = F.expr(f"({SCALE}L * tf) div ({K1} * tf + 8 * m)")
    blocks = max(1, math.ceil(n_docs / BLOCK_DOCS))
    entries = found.withColumn("m", m).select(
        F.pmod(F.xxhash64("rid"), F.lit(blocks)).alias("block"), "rid",
        F.coalesce("doc_id", F.lit(0).cast("long")).alias("dk"),
        F.col("doc_id").isNull().alias("dnull"), "term", value.alias("value"))
    asked = (query_terms.join(weights, "term").groupBy("qid")
             .agg(F.collect_list(F.struct("term", "w")).alias("entries"))
             .select("qid", F.col("entries.term").alias("terms"), F.col("entries.w").alias("weights"))
             .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"),
                                                       F.lit(blocks - 1).cast("long")))))
    hits = (entries.groupBy("block").cogroup(asked.groupBy("block"))
            .applyInPandas(functools.partial(_search_block, top=top), _HITS))
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("dnull"), "dk", "rid")
    ranked = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(queries, "qid").select(
        F.col("qitem").alias("item_id"), F.col("rank").cast("int").alias("rank"),
        F.when(~F.col("dnull"), F.col("dk")).alias("doc_id"), "score")
