"""Stupid-backoff language-model scores of all documents under the model of all other documents.

A word after its context scores f(context word) / f(context) if that n-gram occurs elsewhere, else ``alpha`` times the
score after the context without its first word; a word that occurs nowhere else counts as seen once, with one more
``alpha``. Counts f are those of all documents less those of the scored document itself, as every n-gram of a document
is otherwise known from it. A document's score is the sum of the logarithms over all its words.

Count tables are partitioned by hash range. For each order, blocks of documents send their distinct n-grams with
counts, packed, and the range that owns them answers with the counts over all blocks, in the same order. An n-gram can
occur elsewhere only if both n-grams one word shorter do, so higher orders ask only for those. Texts are shuffled once;
no word, however frequent, is more than one entry of a block's message. N-grams are told apart by 64-bit hashes.

Words are runs without ASCII white space, with A-Z in lower case. Null and empty texts have no words, score 0 and a
null mean. Repeated rows score each other as others; so do rows of one doc_id or none, each a document of its own. An
empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .workspace import bounded_batches, bucket_edges, buckets, by_number, first_of_runs, hashed_words, only_cache, pack_sorted, shuffle_parts, text_blocks, unpack_sorted, window_hashes


def pack_counts(n: np.ndarray) -> bytes:
    """Counts byte by byte of their eight, deflated."""
    return zlib.compress(n.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack_counts(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(8, -1).T).view("<u8").ravel().astype(np.int64)


class Words:
    """The word hashes of a block's documents, one after the other."""

    def __init__(self, docs: pa.Table):
        only_cache("powers")
        texts = docs.column("text").to_pylist()
        parts = [hashed_words(texts[a:b], lower=True) for a, b in slices(texts)]
        self.hash = np.concatenate([h for h, _ in parts]) if parts else np.zeros(0, np.uint64)
        self.size = np.concatenate([n for _, n in parts]) if parts else np.zeros(0, np.int64)
        self.doc = np.repeat(np.arange(len(self.size)), self.size)
        self.at = np.arange(len(self.doc)) - (np.cumsum(self.size) - self.size)[self.doc]


class Resolved:
    """Occurrences elsewhere of each place's n-grams, order by order, from the answers so far."""

    def __init__(self, docs: pa.Table):
        self.b = Words(docs)
        n = len(self.b.doc)
        self.order, self.elsewhere = 0, []
        self.known = np.ones(n, bool)  # both shorter n-grams occur elsewhere

    def ask(self) -> tuple[np.ndarray, np.ndarray]:
        """(sorted distinct n-grams of the next order, their counts in the block)."""
        k, b = self.order + 1, self.b
        self.end = np.flatnonzero(self.known & (b.at >= k - 1))
        full = window_hashes(b.hash, k)
        self.distinct, self.which, self.count = np.unique(full[self.end - (k - 1)] if len(self.end) else full[:0], return_inverse=True, return_counts=True)
        return self.distinct, self.count

    def answer(self, total: np.ndarray) -> None:
        """Takes the counts over all blocks of what ``ask`` gave."""
        if len(total) != len(self.distinct):
            raise ValueError("answers do not fit the question")
        pair = self.b.doc[self.end] * (len(total) + 1) + self.which
        again = np.flatnonzero(self.count[self.which] > 1)  # an n-gram met once in the block is met once in its document
        own = np.ones(len(pair), np.int64)
        _, at, n = np.unique(pair[again], return_inverse=True, return_counts=True)
        own[again] = n[at]
        elsewhere = np.zeros(len(self.b.doc), np.int64)
        elsewhere[self.end] = total[self.which] - own
        self.elsewhere.append(elsewhere)
        self.order += 1
        found = elsewhere > 0
        self.known = found & np.r_[False, found[:-1]]

    def scores(self, alpha: float, tokens: int, order: int) -> np.ndarray:
        """Log score of every word; orders without an answer are those of which nothing was asked: seen nowhere else."""
        b = self.b
        never = np.zeros(len(b.doc), np.int64)
        elsewhere = [*self.elsewhere, *[never] * (order - len(self.elsewhere))]
        rest = np.maximum(tokens - b.size[b.doc], 1)
        one = elsewhere[0]
        out = np.where(one > 0, np.log(np.maximum(one, 1) / rest), np.log(alpha / rest))
        for k in range(2, order + 1):
            seen, context = elsewhere[k - 1], np.r_[1, elsewhere[k - 2][:-1]]
            step = np.where(b.at >= k - 1, np.log(alpha) + out, out)
            out = np.where(seen > 0, np.log(np.maximum(seen, 1) / np.maximum(context, 1)), step)
        return out


def _resolve(docs: pa.Table, answers: pa.Table, n: int) -> Resolved:
    r = Resolved(docs)
    if answers.num_rows:
        got: dict[int, list[tuple[int, bytes]]] = {}
        for k, bucket, raw in zip(*(answers.column(c).to_pylist() for c in ("order", "bucket", "counts"))):
            got.setdefault(k, []).append((bucket, raw))
        for k in sorted(got):
            r.ask()
            r.answer(np.concatenate([unpack_counts(raw) for _, raw in sorted(got[k])]))
    return r


ASK = "order int, block int, bucket int, hashes binary, counts binary"
ANSWER = "order int, block int, bucket int, counts binary"


def _asked(r: Resolved, block: int, n: int) -> pa.Table:
    h, count = r.ask()
    edge = bucket_edges(h, n)
    used = [k for k in range(n) if edge[k] < edge[k + 1]]
    return pa.table({
        "order": pa.array([r.order + 1] * len(used), pa.int32()),
        "block": pa.array([block] * len(used), pa.int32()),
        "bucket": pa.array(used, pa.int32()),
        "hashes": pa.array([pack_sorted(h[edge[k] : edge[k + 1]]) for k in used], pa.binary()),
        "counts": pa.array([pack_counts(count[edge[k] : edge[k + 1]]) for k in used], pa.binary()),
    })


def _ask_more(docs: pa.Table, answers: pa.Table, n: int, order: int) -> pa.Table:
    if docs.num_rows:
        r = _resolve(docs, answers, n)
        if r.order == order - 1:
            return _asked(r, docs.column("block")[0].as_py(), n)
    return pa.table({"order": pa.array([], pa.int32()), "block": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()), "hashes": pa.array([], pa.binary()), "counts": pa.array([], pa.binary())})


def _asker(n: int, order: int):
    return lambda docs, answers: _ask_more(docs, answers, n, order)


def _count(table: pa.Table) -> pa.Table:
    """The count table of one range, and each block's share of it."""
    asked = [unpack_sorted(x) for x in table.column("hashes").to_pylist()]
    h, n = np.concatenate(asked), np.concatenate([unpack_counts(x) for x in table.column("counts").to_pylist()])
    order = np.argsort(h, kind="stable")
    h = h[order]
    run = first_of_runs(h)
    key, total = h[run], np.add.reduceat(n[order], run)
    return table.select(["order", "block", "bucket"]).append_column("counts", pa.array([pack_counts(total[np.searchsorted(key, a)]) for a in asked], pa.binary()))


def _scored(docs: pa.Table, answers: pa.Table, n: int, alpha: float, tokens: int, order: int) -> pa.Table:
    if not docs.num_rows:
        return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "log_score": pa.array([], pa.float64()), "mean_log_score": pa.array([], pa.float64())})
    r = _resolve(docs, answers, n)
    size = r.b.size
    total = np.bincount(r.b.doc, weights=r.scores(alpha, tokens, order), minlength=len(size)) if r.order else np.zeros(len(size))
    return pa.table({"doc_id": docs.column("doc_id"), "n_words": size, "log_score": total, "mean_log_score": pa.array(total / np.maximum(size, 1), mask=size == 0)})


def backoff_scores(docs: DataFrame, order: int = 3, alpha: float = 0.4) -> DataFrame:
    """doc_id, n_words, log_score and mean_log_score of every document."""
    spark = docs.sparkSession
    bounded_batches(spark)
    n, base = buckets(spark), text_blocks(docs, per_part=1)
    tokens = docs.select(F.sum(F.regexp_count(docs["text"].cast("string"), F.lit("[^ \\t-\\r]+"))).alias("n")).first().n or 0
    answers = None
    # a union forgets where its rows lie: dealt by number anew, else the texts would be dealt again to meet it
    here = lambda a: by_number(a, "block", shuffle_parts(spark)).groupBy("block")
    for k in range(1, order + 1):
        if answers is None:
            asked = base.groupBy("block").applyInArrow(lambda t: _asked(Resolved(t), t.column("block")[0].as_py(), n), ASK)
        else:
            asked = base.groupBy("block").cogroup(here(answers)).applyInArrow(_asker(n, k), ASK)
        # dealt by block here, so that later orders read this exchange again instead of counting anew
        got = by_number(by_number(asked, "bucket", n).groupBy("bucket").applyInArrow(_count, ANSWER), "block", shuffle_parts(spark))
        answers = got if answers is None else answers.union(got)
    return base.groupBy("block").cogroup(here(answers)).applyInArrow(lambda a, b: _scored(a, b, n, alpha, tokens, order), "doc_id long, n_words long, log_score double, mean_log_score double")
