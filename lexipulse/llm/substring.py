"""Exact substring de-duplication by difference-cover anchors.

A window is ``window`` consecutive words. Positions modulo 7 in the cover {0, 1, 3} start an anchor of ``window - 6``
words: any two equal windows hold an equal anchor at the same offset, as every difference modulo 7 is one of two cover
positions. So only three of seven positions are hashed and exchanged. Anchors found in two documents send the windows
around them (the extension) into a second exchange, which gives each window the smallest doc_id it starts in; words
under a window that also starts in a smaller doc_id go.

Both exchanges are request and answer: a block of documents sends its distinct hashes, packed as gaps, to ranges of
the hash space and gets back only what is shared. A copy held a million times sends one hash per block, so no group of
copies is gathered anywhere. Texts are shuffled once. Hashes have 64 bits: among n distinct windows a window is taken
for another with probability n / 2**64.

Null and empty texts have no words: nothing is removed, and the digest is that of the empty text. A null doc_id counts
as larger than all others; documents of equal doc_id do not remove each other's words. Texts with fewer words than
a window stay whole. Further input columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .workspace import CACHES, WordHashes, bounded_batches, bucket_edges, buckets, by_number, first_of_runs, only_cache, pack_sorted, shuffle_parts, text_blocks, unpack_sorted, window_hashes

PERIOD, COVER = 7, (0, 1, 3)
NO_ID = np.int64(2**63 - 1)
_HASHES = WordHashes()
CACHES["substring"] = _HASHES.clear


class Block:
    """The words of a block's documents, one after the other."""

    def __init__(self, table: pa.Table):
        self.doc_ids = table.column("doc_id").to_pylist()
        self.words = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in table.column("text").to_pylist()]
        self.size = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.start = np.cumsum(self.size) - self.size
        self.key = np.array([NO_ID if d is None else d for d in self.doc_ids], np.int64)
        self.doc = np.repeat(np.arange(len(self.words)), self.size)
        self.at = np.arange(len(self.doc)) - self.start[self.doc]
        only_cache("substring")
        _HASHES.trim()
        self.hash = _HASHES.of([w for ws in self.words for w in ws])

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash of the k words from each place, places where k words of one document follow)."""
        h = window_hashes(self.hash, k)
        return h, np.flatnonzero(self.at[: len(h)] + k <= self.size[self.doc[: len(h)]])


def _rows(block: list, bucket: list, columns: dict[str, list[bytes]]) -> pa.Table:
    return pa.table({"block": pa.array(block, pa.int32()), "bucket": pa.array(bucket, pa.int32())} | {k: pa.array(v, pa.binary()) for k, v in columns.items()})


def _anchors(b: Block, window: int) -> tuple[np.ndarray, np.ndarray]:
    h, ok = b.windows(window - PERIOD + 1)
    ok = ok[np.isin(b.at[ok] % PERIOD, COVER)]
    return h[ok], ok


def _ask_anchors(table: pa.Table, window: int, n: int) -> pa.Table:
    """The block's distinct anchors, and a bit for those in two of its documents."""
    b = Block(table)
    h, at = _anchors(b, window)
    order = np.lexsort((b.doc[at], h))
    h, doc = h[order], b.doc[at][order]
    run = first_of_runs(h)
    last = np.r_[run[1:], len(h)] - 1 if len(run) else run
    several = doc[run] != doc[last]
    h, edge = h[run], bucket_edges(h[run], n)
    used = [k for k in range(n) if edge[k] < edge[k + 1]]
    block = table.column("block")[0].as_py()
    return _rows([block] * len(used), used, {"hashes": [pack_sorted(h[edge[k] : edge[k + 1]]) for k in used], "extra": [np.packbits(several[edge[k] : edge[k + 1]]).tobytes() for k in used]})


def _shared_anchors(table: pa.Table) -> pa.Table:
    """For each block of a bucket, those of its anchors that two documents hold."""
    asked = [unpack_sorted(x) for x in table.column("hashes").to_pylist()]
    several = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(a)).astype(bool) for x, a in zip(table.column("extra").to_pylist(), asked)]
    own = np.concatenate([a[s] for a, s in zip(asked, several)])
    every = np.sort(np.concatenate(asked))
    shared = np.unique(np.r_[own, every[1:][every[1:] == every[:-1]]])
    found = [a[np.isin(a, shared, assume_unique=True)] for a in asked]
    keep = [i for i, f in enumerate(found) if len(f)]
    block, bucket = table.column("block").to_pylist(), table.column("bucket").to_pylist()
    return _rows([block[i] for i in keep], [bucket[i] for i in keep], {"hashes": [pack_sorted(found[i]) for i in keep]})


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Place of each h in the sorted array, or -1."""
    if not len(known):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[at] == h, at, -1)


def _joined(table: pa.Table) -> np.ndarray:
    parts = [unpack_sorted(x) for x in table.column("hashes").to_pylist()]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _ask_windows(docs: pa.Table, shared: pa.Table, window: int, n: int) -> pa.Table:
    """Distinct windows around shared anchors with the smallest doc_id of the block that they start in."""
    if not docs.num_rows or not shared.num_rows:
        return _rows([], [], {"hashes": [], "extra": []})
    b = Block(docs)
    h, at = _anchors(b, window)
    hit = at[_among(h, _joined(shared)) >= 0]
    # a window from i holds the anchor at a if i <= a < i + PERIOD
    edge = np.zeros(len(b.doc) + 1, np.int64)
    np.add.at(edge, np.maximum(hit - PERIOD + 1, b.start[b.doc[hit]]), 1)
    np.add.at(edge, hit + 1, -1)
    full, ok = b.windows(window)
    ok = ok[np.cumsum(edge)[ok] > 0]
    h, key = full[ok], b.key[b.doc[ok]]
    order = np.lexsort((key, h))
    h, key = h[order], key[order]
    run = first_of_runs(h)
    h, key = h[run], key[run]
    edge = bucket_edges(h, n)
    used = [k for k in range(n) if edge[k] < edge[k + 1]]
    block = docs.column("block")[0].as_py()
    return _rows([block] * len(used), used, {"hashes": [pack_sorted(h[edge[k] : edge[k + 1]]) for k in used], "extra": [_pack_ids(key[edge[k] : edge[k + 1]]) for k in used]})


def _pack_ids(ids: np.ndarray) -> bytes:
    """Ids as places in their sorted distinct list."""
    distinct, at = np.unique(ids, return_inverse=True)
    return len(distinct).to_bytes(8, "little") + distinct.astype("<i8").tobytes() + at.astype("<u2" if len(distinct) < 65536 else "<u4").tobytes()


def _unpack_ids(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    return np.frombuffer(raw, "<i8", n, 8)[np.frombuffer(raw, "<u2" if n < 65536 else "<u4", offset=8 + 8 * n)]


def _smallest(table: pa.Table) -> pa.Table:
    """For each block of a bucket, all windows it asked for, with the smallest doc_id that they start in."""
    asked = [unpack_sorted(x) for x in table.column("hashes").to_pylist()]
    ids = [_unpack_ids(x) for x in table.column("extra").to_pylist()]
    h, key = np.concatenate(asked), np.concatenate(ids)
    order = np.lexsort((key, h))
    run = first_of_runs(h[order])
    every, least = h[order][run], key[order][run]
    block, bucket = table.column("block").to_pylist(), table.column("bucket").to_pylist()
    return _rows(block, bucket, {"hashes": table.column("hashes").to_pylist(), "extra": [_pack_ids(least[np.searchsorted(every, a)]) for a in asked]})


def _covered(b: Block, known: pa.Table, window: int) -> np.ndarray:
    """Words under a window that starts in a smaller doc_id too."""
    edge = np.zeros(len(b.doc) + 1, np.int64)
    if known.num_rows:
        parts = [unpack_sorted(x) for x in known.column("hashes").to_pylist()]
        least = np.concatenate([_unpack_ids(x) for x in known.column("extra").to_pylist()])
        h = np.concatenate(parts)
        order = np.argsort(h)
        h, least = h[order], least[order]
        full, ok = b.windows(window)
        at = _among(full[ok], h)
        ok, at = ok[at >= 0], at[at >= 0]
        ok = ok[least[at] < b.key[b.doc[ok]]]
        np.add.at(edge, ok, 1)
        np.add.at(edge, ok + window, -1)
    return np.cumsum(edge)[:-1] > 0


def _kept(docs: pa.Table, known: pa.Table, window: int, digest: bool) -> pa.Table:
    text = "kept_sha256" if digest else "kept"
    if not docs.num_rows:
        return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), text: pa.array([], pa.string())})
    b = Block(docs)
    gone = _covered(b, known, window)
    removed = np.bincount(b.doc[gone], minlength=len(b.words))
    kept = []
    for ws, start, r in zip(b.words, b.start, removed):
        if r:
            ws = [ws[i] for i in np.flatnonzero(~gone[start : start + len(ws)])]
        kept.append(b" ".join(ws))
    out = [hashlib.sha256(k).hexdigest() for k in kept] if digest else [k.decode("utf-8", "surrogatepass") for k in kept]
    return pa.table({"doc_id": docs.column("doc_id"), "n_words": b.size, "n_removed": removed.astype(np.int64), text: pa.array(out, pa.string())})


def substring_dedup(docs: DataFrame, window: int = 13, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words (or their SHA-256) of every document."""
    if window < PERIOD:
        raise ValueError(f"window must be at least {PERIOD}")
    spark = docs.sparkSession
    bounded_batches(spark)
    n, base, blocks = buckets(spark), text_blocks(docs, per_part=2), 2 * shuffle_parts(spark)
    message = "block int, bucket int, hashes binary, extra binary"
    anchors = base.groupBy("block").applyInArrow(lambda t: _ask_anchors(t, window, n), message)
    shared = by_number(by_number(anchors, "bucket", n).groupBy("bucket").applyInArrow(_shared_anchors, "block int, bucket int, hashes binary"), "block", blocks)
    asked = base.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(lambda a, b: _ask_windows(a, b, window, n), message)
    known = by_number(by_number(asked, "bucket", n).groupBy("bucket").applyInArrow(_smallest, message), "block", blocks)
    text = "kept_sha256 string" if digest else "kept string"
    return base.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(lambda a, b: _kept(a, b, window, digest), f"doc_id long, n_words long, n_removed long, {text}")
