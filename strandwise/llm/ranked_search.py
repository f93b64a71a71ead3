"""Ranked lexical search by branch and bound over document FP-trees.

Each document is a vector of its terms that some item asks for, ordered by how many documents
hold them, most first. A task reads its documents in blocks of at most ``BLOCK`` documents and
``POSTINGS`` entries. The vectors of a block, sorted, are an FP-tree: documents that begin with the
same terms share the path, a node is a run of neighbours, a path without forks is one step, and
neighbouring small subtrees are one leaf of at most ``LEAF`` documents (more only if their vectors
are equal). A node knows the greatest tf of every term below it, the least m and the least doc_id.
For each item the tree is walked depth first, best bound first; a subtree is left out when
its bound, the score of a document with all its greatest tf and its least m, cannot enter the
best ``TOP`` that the task has so far. What a task keeps is ``TOP`` rows an item; these are merged in
two steps of ranking. Items are worked on in blocks of about ``ITEM_CHARS`` characters of terms.

Counts (documents, terms, documents of a term) are exact over all documents.

Defined cases: a null text has no terms, and neither has a null item; item rows with one item_id are
one item, null is an item_id of its own; rows of one doc_id, and repeated rows, are documents of
their own that tie, and a null doc_id comes last among equal scores; a very long text is read
whole; empty tables give an empty table; other columns are left out, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, lexical_words, settled

TOP = 50
#: Documents and vector entries of a tree, and documents of a leaf.
BLOCK, POSTINGS, LEAF = 8_192, 2_000_000, 64
#: Characters of item terms that one pass over the documents serves.
ITEM_CHARS = 4_000_000
#: A byte of a word stays, A-Z becomes a-z, every other ASCII byte a space.
_BYTES = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).translate(
    bytes.maketrans(UPPER.encode(), LOWER.encode())
)
#: Stands for a null doc_id: behind every other.
LAST = np.iinfo(np.int64).max


def _vectors(docs: DataFrame, codes: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), and the asked terms of each document with their tf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, terms, tfs = [], [], []
            for text in b.column("text").to_pylist():
                found = text.encode("utf-8", "surrogatepass").translate(_BYTES).split()
                sizes.append(len(found))
                held = [(codes[t], c) for t, c in Counter(found).items() if t in codes]
                terms.append([t for t, _ in held])
                tfs.append([c for _, c in held])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))],
                ["doc_id", "n", "terms", "tfs"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return settled(rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>"))


def _grouped_max(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the greatest value of each."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[heads], np.maximum.reduceat(values, heads) if len(heads) else values


def _score(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


class DocumentTree:
    """FP-tree over a block: ``ids``, ``m`` per document; ``terms``, ``tfs`` per entry, cut by ``ptr``.

    Term numbers follow the order of frequency, so a sorted vector is the path of its document.
    """

    def __init__(self, ids: np.ndarray, m: np.ndarray, ptr: np.ndarray, terms: np.ndarray, tfs: np.ndarray, n_terms: int):
        rows = np.repeat(np.arange(len(ids)), np.diff(ptr))
        inside = np.lexsort((terms, rows))
        terms, tfs = terms[inside], tfs[inside]
        paths = [terms[a:b].astype(">u4").tobytes() for a, b in zip(ptr[:-1], ptr[1:])]
        order = np.array(sorted(range(len(ids)), key=paths.__getitem__))
        size = np.diff(ptr)[order]
        pick = np.repeat(ptr[:-1][order] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        self.n_terms, self.n = n_terms, len(ids)
        self.ids, self.m = ids[order], m[order]
        self.terms, self.tfs = terms[pick], tfs[pick].astype(np.int64)
        self.ptr = np.concatenate([[0], np.cumsum(size)])
        self._grow()
        self._sum_up()
        # entries by (term, document), for the leaves
        place = np.repeat(np.arange(self.n), size)
        by_term = np.argsort(self.terms, kind="stable")
        self.entry_doc, self.entry_tf = place[by_term], self.tfs[by_term]
        self.entry_key = self.terms[by_term].astype(np.int64) * self.n + self.entry_doc

    def _path(self, doc: int) -> np.ndarray:
        return self.terms[self.ptr[doc] : self.ptr[doc + 1]]

    def _grow(self) -> None:
        """Nodes as runs of documents, parents before children; a node without children is a leaf."""
        self.low, self.high, self.children = [0], [self.n], [[]]
        todo = [0]
        while todo:
            node = todo.pop()
            low, high = self.low[node], self.high[node]
            if high - low <= LEAF:
                continue
            a, b = self._path(low), self._path(high - 1)
            k = min(len(a), len(b))
            apart = np.flatnonzero(a[:k] != b[:k])
            depth = int(apart[0]) if len(apart) else k  # the terms that all paths of the run share
            at = self.ptr[low:high] + depth
            step = np.where(at < self.ptr[low + 1 : high + 1], self.terms[np.minimum(at, len(self.terms) - 1)], -1)
            cuts = [0, *(np.flatnonzero(step[1:] != step[:-1]) + 1), high - low]
            if len(cuts) == 2:
                continue  # equal vectors
            start = 0
            for i in range(1, len(cuts)):
                last = i + 1 == len(cuts)
                if last or cuts[i + 1] - cuts[start] > LEAF:  # neighbours join up to the size of a leaf
                    self.low.append(low + int(cuts[start]))
                    self.high.append(low + int(cuts[i]))
                    self.children.append([])
                    self.children[node].append(len(self.low) - 1)
                    todo.append(len(self.low) - 1)
                    start = i

    def _sum_up(self) -> None:
        """Greatest tf of each term, least m and least doc_id below every node, children first."""
        found: list = [None] * len(self.low)
        self.least_m = np.array([self.m[a:b].min() for a, b in zip(self.low, self.high)])
        self.least_id = np.array([self.ids[a:b].min() for a, b in zip(self.low, self.high)])
        for node in reversed(range(len(self.low))):
            if self.children[node]:
                parts = [found[c] for c in self.children[node]]
                found[node] = _grouped_max(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            else:
                a, b = self.ptr[self.low[node]], self.ptr[self.high[node]]
                found[node] = _grouped_max(self.terms[a:b], self.tfs[a:b])
        self.max_key = np.concatenate([t.astype(np.int64) + k * self.n_terms for k, (t, _) in enumerate(found)])
        self.max_tf = np.concatenate([v for _, v in found])

    def bounds(self, nodes: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """What no document below each node can exceed."""
        keys = nodes[:, None] * self.n_terms + terms[None, :]
        at = np.minimum(np.searchsorted(self.max_key, keys), len(self.max_key) - 1)
        tf = np.where(self.max_key[at] == keys, self.max_tf[at], 0)
        return (weights[None, :] * _score(tf, self.least_m[nodes][:, None])).sum(axis=1)

    def scores(self, node: int, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact scores of the documents of a leaf."""
        low, high = self.low[node], self.high[node]
        first = np.searchsorted(self.entry_key, terms * self.n + low)
        count = np.searchsorted(self.entry_key, terms * self.n + high) - first
        at = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        docs = self.entry_doc[at]
        out = np.zeros(high - low, np.int64)
        np.add.at(out, docs - low, np.repeat(weights, count) * _score(self.entry_tf[at], self.m[docs]))
        return out

    def search(self, terms: np.ndarray, weights: np.ndarray, best: tuple, top: int = TOP) -> tuple:
        """``best`` (scores, ids; highest first, equal scores by id) with what the tree adds to it."""
        todo = [(int(self.bounds(np.zeros(1, np.int64), terms, weights)[0]), 0)]
        while todo:
            bound, node = todo.pop()
            least, last = (int(best[0][-1]), int(best[1][-1])) if len(best[0]) == top else (1, LAST)
            if bound < least or (bound == least and self.least_id[node] > last):
                continue
            if self.children[node]:
                below = np.array(self.children[node])
                limits = self.bounds(below, terms, weights)
                order = np.argsort(limits, kind="stable")
                todo.extend(zip(limits[order].tolist(), below[order].tolist()))
                continue
            got = self.scores(node, terms, weights)
            near = np.flatnonzero(got >= max(least, 1))
            if len(near):
                score = np.concatenate([best[0], got[near]])
                ids = np.concatenate([best[1], self.ids[self.low[node] + near]])
                order = np.lexsort((ids, -score))[:top]
                best = score[order], ids[order]
        return best


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """ids, n, sizes of vectors, terms and tfs of blocks of documents, each small enough for a tree."""
    held, docs, entries = [], 0, 0
    for b in batches:
        sizes = np.diff(b.column("terms").offsets.to_numpy())
        ids, n = b.column("doc_id").fill_null(int(LAST)).to_numpy(zero_copy_only=False), b.column("n").to_numpy()
        terms, tfs = b.column("terms").flatten().to_numpy(), b.column("tfs").flatten().to_numpy()
        ends, at = np.concatenate([[0], np.cumsum(sizes)]), 0
        while at < len(sizes):
            fit = int(np.searchsorted(ends, ends[at] + POSTINGS - entries, side="right")) - 1
            stop = min(len(sizes), at + BLOCK - docs, max(fit, at + (not docs)))
            held.append([ids[at:stop], n[at:stop], sizes[at:stop], terms[ends[at] : ends[stop]], tfs[ends[at] : ends[stop]]])
            docs, entries, at = docs + stop - at, entries + int(ends[stop] - ends[at]), stop
            if at < len(sizes):
                yield [np.concatenate(c) for c in zip(*held)]
                held, docs, entries = [], 0, 0
    if docs:
        yield [np.concatenate(c) for c in zip(*held)]


def _best(vectors: DataFrame, items: list[list[int]], freq: dict[int, int], n_docs: int, n_terms: int, top: int) -> DataFrame:
    """item (its number), doc_id, score: the best of every task for every item."""
    by_freq = sorted(freq, key=lambda t: (-freq[t], t))
    number = np.full(max(freq, default=0) + 1, -1)
    number[by_freq] = np.arange(len(by_freq))
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * freq[t] + 1))) for t in by_freq], np.int64)
    asked = [np.sort(number[[t for t in item if t in freq]]).astype(np.int64) for item in items]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in asked]
        for ids, n, sizes, terms, tfs in _blocks(batches):
            m = np.array([50 + 50 * int(k) * n_docs // n_terms for k in n], np.int64)
            ptr = np.concatenate([[0], np.cumsum(sizes)])
            tree = DocumentTree(ids, m, ptr, number[terms], tfs, len(by_freq))
            for i, t in enumerate(asked):
                if len(t):
                    best[i] = tree.search(t, weight[t], best[i], top)
        for i, (score, ids) in enumerate(best):
            if len(score):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(score), i)), pa.array(ids, mask=ids == LAST), pa.array(score)], ["item", "doc_id", "score"]
                )

    return vectors.where(F.size("terms") > 0).mapInArrow(run, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the highest-scoring documents of each item (item_id, text)."""
    spark = docs.sparkSession
    pairs = settled(items.select("item_id", F.explode(lexical_words(F.col("text"))).alias("term")).distinct())
    chars = pairs.agg(F.sum(F.length("term") + 1)).first()[0] or 0
    parts = max(1, -(-chars // ITEM_CHARS))
    out = None
    for part in range(parts):
        asked = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).groupBy("item_id").agg(F.array_sort(F.collect_list("term")).alias("terms"))
        rows = asked.collect()  # about ITEM_CHARS characters, see above
        codes = {t: i for i, t in enumerate(sorted({t for r in rows for t in r["terms"]}))}
        vectors = _vectors(docs, {t.encode("utf-8"): i for t, i in codes.items()})
        n_docs, n_terms = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        freq = dict(map(tuple, vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1))).collect()))  # asked terms only
        found = _best(vectors, [[codes[t] for t in r["terms"]] for r in rows], freq, n_docs, n_terms, top)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item long, item_id {items.schema['item_id'].dataType.simpleString()}")
        named = found.join(F.broadcast(names), "item").drop("item")
        out = named if out is None else out.unionByName(named)
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    salted = Window.partitionBy("item_id", "salt").orderBy(*order)
    whole = Window.partitionBy("item_id").orderBy(*order)
    near = settled(out.withColumn("salt", F.spark_partition_id() % 64)).withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= top)
    return near.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
