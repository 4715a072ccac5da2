"""Approximate nearest neighbours by an inverted multi-index.

A vector is cut into two halves, each quantised by its own centroids (k-means on a bounded sample: the ``sample``
vectors of smallest hash). A cell is a pair of centroids. A query walks the cells by falling sum of its two halves'
inner products with the centroids, with a heap over the sorted halves, until the cells hold a number of vectors; it then
reranks every entry of these cells by the exact inner product of the original vectors in double precision, and keeps
the k best, ties to the smaller id.

That number is measured, at every size of table alike: ``fitted`` queries of smallest hash are compared with all vectors,
and the walk goes as far as ``recall`` of their true neighbours need. So vectors with clusters cost few cells, and as
neighbours of a larger table lie nearer, the walked share falls with the table.

Every vector is indexed. Entries lie in pieces of about ``piece`` vectors: neighbouring shelves (the cells of one left
centroid) share a piece, and a large shelf is cut into several by hash, so that a cell with a third of all rows makes no
larger task than others. Queries go in waves of ``wave``; in a wave they travel to the pieces in blocks of at most
``block`` queries, packed with the set of their cells, and each piece returns k rows a query at most. A task holds one
piece and one block. Centroids (2 * cells numbers of half the dimension) and cell sizes (cells**2) are fixed in size.

Vectors that are null, empty, zero, of another dimension than the most frequent, or hold null or non-finite components
take no part, neither as query nor as candidate; rows with a null id take no part either. Copies of a vector tie and come
by id. Rows of one id with different vectors are rows of their own: each is searched for, under its own ranks, and is a
candidate of the others; rows of equal id and vector count as one. Fewer candidates than k give all of them; an empty
table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .workspace import bounded_batches, stored


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].astype(np.float64)
    for _ in range(rounds):
        own = nearest(x, c)
        for d in range(x.shape[1]):
            total = np.bincount(own, weights=x[:, d], minlength=k)
            c[:, d] = np.where(np.bincount(own, minlength=k) > 0, total / np.maximum(np.bincount(own, minlength=k), 1), c[:, d])
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(1) - 2 * (x @ c.T), axis=1)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), np.float64).reshape(len(flat), -1) if len(flat) else np.zeros((0, 1))


def walk(a: np.ndarray, b: np.ndarray, size: np.ndarray, want: int) -> list[int]:
    """Cells by falling a[i] + b[j] until they hold ``want`` vectors; size[i, j] are the cells' vectors."""
    i_of, j_of = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
    heap, seen, out, held = [(-(a[i_of[0]] + b[j_of[0]]), 0, 0)], {(0, 0)}, [], 0
    while heap and held < want:
        _, i, j = heapq.heappop(heap)
        cell = int(i_of[i]) * len(b) + int(j_of[j])
        if n := int(size[cell]):
            out.append(cell)
            held += n
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (-(a[i_of[x]] + b[j_of[y]]), x, y))
    return out


def _assign(batches, centroids):
    left, right = centroids.value
    for batch in batches:
        x = matrix(batch.column("vector"))
        h = x.shape[1] // 2
        cell = nearest(x[:, :h], left) * len(right) + nearest(x[:, h:], right) if len(x) else np.zeros(0, np.int64)
        yield batch.append_column("cell", pa.array(cell, pa.int32()))


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1))


def best_of(s: np.ndarray, x: np.ndarray, y: np.ndarray, ids: np.ndarray, k: int):
    """(row, places of the k best, their exact scores) of each row of rough scores ``s`` of queries y against x.

    A rough score is off by at most the dimension times the rounding unit times both lengths, and so is an exact one; a
    place is looked at where its score can reach the k-th largest of the others within these bounds, whatever their size.
    """
    keep = min(k, s.shape[1])
    slack = 2 * (x.shape[1] + 1) * np.finfo(np.float64).eps
    lengths = norms(x)
    for r, length in enumerate(norms(y) if keep else ()):
        bound = slack * length * lengths
        cut = -np.partition(bound - s[r], keep - 1)[keep - 1]
        near = np.flatnonzero((s[r] + bound >= cut) & (s[r] > -np.inf))
        score = (y[r] * x[near]).sum(1)
        best = np.lexsort((ids[near], -score))[:keep]
        yield r, near[best], score[best]


def _truth(batches, wanted, k: int):
    """The k nearest of a batch for each of the fitted queries, with their cells."""
    own_q, y = wanted.value
    for batch in batches:
        x, ids, own, cell = matrix(batch.column("vector")), *(np.asarray(batch.column(c), np.int64) for c in ("id", "own", "cell"))
        if len(x):
            s = y @ x.T
            s[own_q[:, None] == own[None, :]] = -np.inf
            for r, at, score in best_of(s, x, y, ids, k):
                yield pa.RecordBatch.from_pydict({"query": np.full(len(at), r), "cell": cell[at], "score": score, "id": ids[at]})


def depth(a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many vectors the walk has met before each cell."""
    order = np.argsort(-(a[:, None] + b[None, :]).ravel(), kind="stable")
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(size[order]) - size[order]
    return out


def dealt(shelves: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """(first piece, number of pieces) of each shelf: large shelves have their own, small neighbours share one."""
    first, number, at, held = [], [], -1, 0
    for n in shelves.tolist():
        many = max(1, -(-n // piece))
        if many > 1 or at < 0 or held + n > piece:
            at, held = at + 1, 0
        first.append(at)
        number.append(many)
        at, held = at + many - 1, held + n
    return np.array(first), np.array(number)


def _probe(batches, centroids, sizes, pieces, want: int, block: int):
    """For each piece that queries of a batch visit: these queries and their cells in it, as one packed row."""
    left, right = centroids.value
    first, number = pieces.value
    for batch in batches:
        for at in range(0, batch.num_rows, block):
            part = batch.slice(at, block)
            x, ids, own = matrix(part.column("vector")), *(np.asarray(part.column(c), np.int64) for c in ("id", "own"))
            h = x.shape[1] // 2
            a, b = x[:, :h] @ left.T, x[:, h:] @ right.T
            visit = np.zeros((len(x), len(left) * len(right)), bool)
            for q in range(len(x)):
                visit[q, walk(a[q], b[q], sizes.value, want)] = True
            rows: dict[str, list] = {"piece": [], "ids": [], "own": [], "vectors": [], "cells": []}
            for p in range(int(first[-1] + number[-1])):
                shelves = np.flatnonzero((first <= p) & (p < first + number))
                seen = visit[:, shelves[0] * len(right) : (shelves[-1] + 1) * len(right)]
                qs = np.flatnonzero(seen.any(1))
                if len(qs):
                    for c, v in zip(rows.values(), (p, ids[qs].tobytes(), own[qs].tobytes(), x[qs].tobytes(), np.packbits(seen[qs], axis=1).tobytes())):
                        c.append(v)
            kinds = {"piece": pa.int32(), "ids": pa.binary(), "own": pa.binary(), "vectors": pa.binary(), "cells": pa.binary()}
            yield pa.RecordBatch.from_pydict({c: pa.array(v, kinds[c]) for c, v in rows.items()})


def _rerank(entries: pa.Table, probes: pa.Table, k: int, right: int, shelf_of_piece) -> pa.Table:
    """The k best entries of the visited cells of a piece for each visiting query."""
    names = ("query_id", "query_own", "vec_id", "own", "score")
    out: dict[str, list] = {c: [] for c in names}
    if entries.num_rows and probes.num_rows:
        x, ids, own, cell = matrix(entries.column("vector")), *(np.asarray(entries.column(c), np.int64) for c in ("id", "own", "cell"))
        cell = cell - shelf_of_piece.value[entries.column("piece")[0].as_py()] * right
        for raw, raw_own, vec, bits in zip(*(probes.column(c).to_pylist() for c in ("ids", "own", "vectors", "cells"))):
            q, q_own = np.frombuffer(raw, np.int64), np.frombuffer(raw_own, np.int64)
            y = np.frombuffer(vec, np.float64).reshape(len(q), -1)
            bits = np.frombuffer(bits, np.uint8).reshape(len(q), -1)
            for at in range(0, len(q), 256):
                part = slice(at, at + 256)
                s = y[part] @ x.T
                s[(np.unpackbits(bits[part], axis=1)[:, cell] == 0) | (q_own[part, None] == own[None, :])] = -np.inf
                for r, near, score in best_of(s, x, y[part], ids, k):
                    for c, v in zip(names, (np.full(len(near), q[at + r]), np.full(len(near), q_own[at + r]), ids[near], own[near], score)):
                        out[c].append(v)
    kinds = (np.int64, np.int64, np.int64, np.int64, np.float64)
    return pa.table({c: np.concatenate(out[c]) if out[c] else np.zeros(0, t) for c, t in zip(names, kinds)})


class Index:
    """Centroids, the cell of every vector, and how far a walk goes."""

    def __init__(self, vectors: DataFrame, is_query, k: int, cells: int, sample: int, rounds: int, recall: float, fitted: int, piece: int, seed: int):
        spark = self.spark = vectors.sparkSession
        bounded_batches(spark)
        finite = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
        kind = "float" if vectors.schema["vector"].dataType.simpleString() == "array<float>" else "double"
        whole = vectors.select(F.col("id").cast("long").alias("id"), F.col("vector").cast(f"array<{kind}>").alias("vector"))
        whole = whole.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 1) & finite & F.exists("vector", lambda c: c != 0))
        width = whole.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
        self.empty = width is None
        if self.empty:
            return
        whole = whole.where(F.size("vector") == width.d).select("id", F.xxhash64("id", "vector").alias("own"), "vector").dropDuplicates(["own"])  # copies would fill the lists
        x = matrix(whole.orderBy("own").limit(sample).select("vector").toArrow().column("vector"))
        h = width.d // 2
        self.centroids = spark.sparkContext.broadcast((kmeans(x[:, :h], cells, rounds, seed), kmeans(x[:, h:], cells, rounds, seed + 1)))
        centroids = self.centroids
        self.placed = stored(whole.mapInArrow(lambda it: _assign(it, centroids), f"id long, own long, vector array<{kind}>, cell int"), "cells")
        self.queries = self.placed.where(is_query(F.col("id")))
        left, right = (len(c) for c in centroids.value)
        sizes = np.zeros(left * right, np.int64)
        for r in self.placed.groupBy("cell").count().collect():  # at most cells**2 rows
            sizes[r.cell] = r["count"]
        self.sizes = spark.sparkContext.broadcast(sizes)
        self.want = self._walked(k, recall, fitted)
        self.pieces = spark.sparkContext.broadcast(dealt(sizes.reshape(left, right).sum(1), piece))

    def _walked(self, k: int, recall: float, fitted: int) -> int:
        """The number of vectors that the walks of ``fitted`` queries meet until they have that share of their neighbours."""
        some = self.queries.orderBy("own").limit(fitted).select("own", "vector").toArrow()
        if not some.num_rows:
            return 1
        y = matrix(some.column("vector"))
        wanted = self.spark.sparkContext.broadcast((np.asarray(some.column("own"), np.int64), y))
        near = self.placed.mapInArrow(lambda it: _truth(it, wanted, k), "query long, cell long, score double, id long")
        order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
        found = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "cell").collect()  # k rows a fitted query
        (left, right), h = self.centroids.value, y.shape[1] // 2
        met = [depth(y[r, :h] @ left.T, y[r, h:] @ right.T, self.sizes.value) for r in range(len(y))]
        before = sorted(int(met[r.query][r.cell]) for r in found)
        return before[max(0, int(np.ceil(recall * len(before))) - 1)] + 1 if before else 1

    def near(self, queries: DataFrame, k: int, block: int) -> DataFrame:
        """The candidates of ``queries`` (rows of the index): k of each piece at most."""
        centroids, sizes, pieces, want, right = self.centroids, self.sizes, self.pieces, self.want, len(self.centroids.value[1])
        first, number = pieces.value
        of_piece = np.zeros(int(first[-1] + number[-1]), np.int64)
        for shelf in range(len(first) - 1, -1, -1):
            of_piece[first[shelf] : first[shelf] + number[shelf]] = shelf
        start = self.spark.sparkContext.broadcast(of_piece)
        pick = lambda a: F.element_at(F.array(*(F.lit(int(p)) for p in a)), F.floor(F.col("cell") / right).cast("int") + 1)
        entries = self.placed.withColumn("piece", (pick(first) + F.pmod(F.xxhash64("own"), pick(number))).cast("int"))
        probes = queries.select("id", "own", "vector").mapInArrow(lambda it: _probe(it, centroids, sizes, pieces, want, block), "piece int, ids binary, own binary, vectors binary, cells binary")
        return entries.groupBy("piece").cogroup(probes.groupBy("piece")).applyInArrow(lambda a, b: _rerank(a, b, k, right, start), "query_id long, query_own long, vec_id long, own long, score double")


def answers(index: Index, k: int, block: int, wave: int) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for the queries of an index."""
    waves = max(1, -(-index.queries.count() // wave))
    found = None
    for w in range(waves):
        near = index.near(index.queries.where(F.pmod(F.col("own"), F.lit(waves)) == w) if waves > 1 else index.queries, k, block)
        order = Window.partitionBy("query_id", "query_own").orderBy(F.desc("score"), "vec_id", "own")
        best = near.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= k).dropDuplicates(["query_id", "query_own", "rank"]).select("query_id", "rank", "vec_id", "score")
        best = stored(best, "wave") if waves > 1 else best
        found = best if found is None else found.union(best)
    return found


def search(vectors: DataFrame, is_query, k: int = 20, cells: int = 64, sample: int = 16_384, rounds: int = 12, recall: float = 0.95, fitted: int = 64, piece: int = 8_192, block: int = 1_024, wave: int = 32_768, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for the rows of ``vectors`` (id, vector) where ``is_query``."""
    index = Index(vectors, is_query, k, cells, sample, rounds, recall, fitted, piece, seed)
    if index.empty:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return answers(index, k, block, wave)
