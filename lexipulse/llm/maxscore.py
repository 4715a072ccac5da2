"""Ranked lexical search by MaxScore over shards.

Terms are maximal runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. With N documents that hold a
term, L their terms, df the documents with a term, n the terms of a document and tf those that are the term, an item's
term weighs w = floor(1000 ln((2N + 2) / (2 df + 1))), and a document's score is the sum over the item's distinct terms of
w ((1000000000 tf) div (1000 tf + 8 m)), m = 10 + (90 n N) div L, in 64-bit integers.

One scan cuts the documents into shards, an Arrow batch each, of at most 4,096 rows, and keeps the postings of the items'
terms, term by term, in a table in the shared folder; document frequencies and lengths add up from the same table, over
all documents. A second pass over the shards answers all items. In a shard a term's upper bound is its largest
contribution there. An item's terms are taken by rising bound; as many as together stay below the score of the k-th best
document so far are non-essential: a document with none but them cannot qualify. The lists of the others are merged, and
the non-essential ones, by falling bound, are probed only at the documents that still can reach that score. The best k of
an item go on from shard to shard of a task, so later shards are mostly skipped; a task returns k rows an item, which
are ranked at the end.

Items are read in blocks of about ``block`` bytes of text, which bounds what the driver holds and what is broadcast
whatever their number; the documents are scanned once a block. Rows of equal id and text are one item; rows of one id with
different texts are searched on their own, each under its own ranks. Null or empty texts have no terms: such an item
has no rows, such a document does not count. A null doc_id ranks behind all others of its score; repeated rows are
documents of their own. No documents or no items give no rows; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .workspace import bounded_batches, byte_runs, only_cache, stored

SHARD = "doc_ids array<bigint>, sizes binary, terms array<int>, counts array<int>, places binary, tfs binary, held long, length long"
#: No document yet.
NO_ID = np.iinfo(np.int64).max


def term_bytes(data: np.ndarray) -> np.ndarray:
    low = data | 0x20
    return (data >= 0x80) | ((low >= 0x61) & (low <= 0x7A)) | ((data >= 0x30) & (data <= 0x39))


def terms_of(texts: list[str | None]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(all terms of the texts, in order; the text each comes from)."""
    return byte_runs([t.encode() if t else b"" for t in texts], term_bytes)


def _shards(batches, wanted):
    """One packed row a batch: lengths of its documents and the postings of the wanted terms, sorted by term and place."""
    only_cache("maxscore")
    for batch in batches:
        found, owner = terms_of(batch.column("text").to_pylist())
        size = np.bincount(owner, minlength=batch.num_rows)
        number = pc.fill_null(pc.index_in(found.dictionary.cast(pa.large_string()), value_set=wanted.value), -1)
        term = np.asarray(number, np.int64)[np.asarray(found.indices, np.int64)] if len(found) else np.zeros(0, np.int64)
        hit = term >= 0
        key, tf = np.unique(term[hit] * batch.num_rows + owner[hit], return_counts=True)
        terms, counts = np.unique(key // max(batch.num_rows, 1), return_counts=True)
        one = (batch.column("doc_id").to_pylist(), size.astype(np.int32).tobytes(), terms.tolist(), counts.tolist(), (key % max(batch.num_rows, 1)).astype(np.uint16).tobytes(), tf.astype(np.int32).tobytes(), int((size > 0).sum()), int(size.sum()))
        kinds = (pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        names = [c.split()[0] for c in SHARD.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(one, kinds)], names)


class Best:
    """The k best (score, document) of an item so far, best first."""

    def __init__(self, k: int):
        self.k, self.score, self.id, self.null = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def least(self) -> int:
        """A document needs this score to qualify; at an equal score its id decides."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        score, ids, null = np.concatenate([self.score, score]), np.concatenate([self.id, ids]), np.concatenate([self.null, null])
        at = np.lexsort((ids, null, -score))[: self.k]
        self.score, self.id, self.null = score[at], ids[at], null[at]


def rank_shard(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, least: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(places, scores, postings looked at) of the documents of a shard that score ``least`` or more.

    ``lists`` are the terms' (places, contributions), places sorted.
    """
    lists = sorted(lists, key=lambda x: int(x[1].max()))
    reach = np.cumsum([int(c.max()) for _, c in lists]) if lists else np.zeros(0, np.int64)
    idle = int(np.searchsorted(reach, least))  # the first ``idle`` lists are non-essential
    score, looked = np.zeros(n_docs, np.int64), 0
    for places, c in lists[idle:]:
        score[places] += c
        looked += len(places)
    cand = np.flatnonzero(score)
    for i in range(idle - 1, -1, -1):
        cand = cand[score[cand] + reach[i] >= least]
        if not len(cand):
            break
        places, c = lists[i]
        at = np.searchsorted(places, cand)
        at[at == len(places)] = 0
        hit = places[at] == cand
        score[cand[hit]] += c[at[hit]]
        looked += len(cand)
    cand = cand[score[cand] >= least]
    return cand, score[cand], looked


def _ranked(batches, items, weights, docs: int, length: int, k: int):
    """The k best documents of a task's shards for each item: item, doc_id, score."""
    only_cache("maxscore")
    best = [Best(k) for _ in items.value]
    for batch in batches:
        for row in batch.to_pylist():
            ids = pa.array(row["doc_ids"], pa.int64())
            null = np.asarray(ids.is_null())
            ids = np.asarray(pc.fill_null(ids, NO_ID), np.int64)
            m = 10 + 90 * np.frombuffer(row["sizes"], np.int32).astype(np.int64) * docs // max(length, 1)
            terms, counts = np.array(row["terms"], np.int64), np.array(row["counts"], np.int64)
            places, tf = np.frombuffer(row["places"], np.uint16).astype(np.int64), np.frombuffer(row["tfs"], np.int32).astype(np.int64)
            value = np.repeat(weights.value[terms], counts) * (1_000_000_000 * tf // (1000 * tf + 8 * m[places]))
            slot = np.full(len(weights.value), -1, np.int64)
            slot[terms] = np.arange(len(terms))
            edge = np.concatenate([[0], np.cumsum(counts)])
            for b, wanted in zip(best, items.value):
                there = slot[wanted]
                lists = [(places[edge[s] : edge[s + 1]], value[edge[s] : edge[s + 1]]) for s in there[there >= 0].tolist()]
                cand, score, _ = rank_shard(lists, len(ids), b.least)
                if len(cand):
                    b.add(score, ids[cand], null[cand])
    item = np.repeat(np.arange(len(best)), [len(b.score) for b in best])
    empty = [np.zeros(0, np.int64)]
    doc_id = pa.array(np.concatenate([b.id for b in best] or empty), mask=np.concatenate([b.null for b in best] or [np.zeros(0, bool)]))
    yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), doc_id, pa.array(np.concatenate([b.score for b in best] or empty))], ["item", "doc_id", "score"])


def _block(docs: DataFrame, items: list, k: int) -> DataFrame | None:
    """item_id, rank, doc_id, score of the items of a block."""
    spark = docs.sparkSession
    found, owner = terms_of([r.text for r in items])
    if not len(found):
        return None
    vocabulary = found.dictionary.cast(pa.large_string())
    code = np.asarray(found.indices, np.int64)
    wanted = spark.sparkContext.broadcast(vocabulary)
    each = spark.sparkContext.broadcast([np.unique(code[owner == i]) for i in range(len(items))])
    shards = stored(docs.mapInArrow(lambda it: _shards(it, wanted), SHARD), "shards")
    total = shards.agg(F.sum("held").alias("docs"), F.sum("length").alias("length")).first()
    n, length = int(total.docs or 0), int(total.length or 0)
    per_term = shards.select(F.inline(F.arrays_zip("terms", "counts"))).groupBy("terms").agg(F.sum("counts").alias("df")).collect()  # a row a term of the block
    df = np.zeros(len(vocabulary), np.int64)
    for r in per_term:
        df[r.terms] = r.df
    weights = spark.sparkContext.broadcast(np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(d) + 1))) if d else 0 for d in df], np.int64))
    found = shards.mapInArrow(lambda it: _ranked(it, each, weights, n, length, k), "item int, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(items)], "item int, item_id long")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, block: int = 4 << 20) -> DataFrame:
    """item_id, rank, doc_id, score of the ``k`` best documents of each item (item_id, text)."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    asked = items.select(items["item_id"].cast("long").alias("item_id"), items["text"].cast("string").alias("text")).where("text is not null").distinct()
    size = asked.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    blocks = max(1, -(-size // block))
    out = None
    for b in range(blocks):
        some = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        one = _block(rows, some.collect(), k)  # about ``block`` bytes
        if one is not None and blocks > 1:
            one = stored(one, "answers")
        out = one if out is None else out if one is None else out.union(one)
    return out if out is not None else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
