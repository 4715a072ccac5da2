"""Token ids in directly addressable files.

Every id is cut into chunks of eight bits. Level 0 holds the lowest chunk of all ids; a continuation bitmap marks the
ids that go on, whose next chunks lie on level 1, and so on. A rank directory gives the number of set bits before each
block of 512, so the chunk of token i on the next level is found by one directory entry and a few popcounts: any token
is read without decoding others.

Writing: documents are range-partitioned by doc_id, encoded where they land (whole texts, each with an end id) and
written as shards of at most ``shard_tokens`` tokens plus one document. File names are unique to a task attempt, and a
shard counts only if its name reaches the manifest, so lost or repeated tasks leave no wrong shard. The driver gets
one row per shard.

Null texts count as empty: their only token is the end id. Documents with null doc_id come first, equal ids follow each
other in the order of their texts' hashes, an empty table gives no shards and no rows. Further input columns are ignored.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Encoder, text_slices
from .workspace import CACHES, bounded_batches, fresh_path, only_cache, open_shared, shuffle_parts

MAGIC = b"LXDAC001"
BLOCK = 512
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1).astype(np.int64)


def _levels(ids: np.ndarray) -> dict[str, np.ndarray]:
    out, k, rest = {}, 0, ids.astype(np.uint64)
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        bits = np.r_[bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)]
        ones = _BITS[bits].reshape(-1, BLOCK // 8).sum(1)
        out |= {f"chunk{k}": (rest & np.uint64(255)).astype(np.uint8), f"bits{k}": bits, f"rank{k}": np.r_[0, np.cumsum(ones)].astype("<i8")}
        if not more.any():
            return out
        rest, k = rest[more] >> np.uint64(8), k + 1


def encode_file(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """One shard: document ids, their token offsets, the levels, then a directory and its length."""
    parts = {
        "doc_id": np.array([0 if d is None else d for d in doc_ids], "<i8"),
        "known": np.array([d is not None for d in doc_ids], np.uint8),
        "offset": np.r_[0, np.cumsum(counts)].astype("<i8"),
    } | _levels(ids)
    body, where = [MAGIC], {}
    at = len(MAGIC)
    for name, a in parts.items():
        raw = a.tobytes()
        where[name] = [at, len(raw), a.dtype.str]
        body.append(raw)
        at += len(raw)
    tail = json.dumps(where).encode()
    return b"".join([*body, tail, len(tail).to_bytes(8, "little"), MAGIC])


class TokenFile:
    """Reads one shard: ``token`` is random access, ``slice`` and ``document`` give runs of ids."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC or raw[-8:] != MAGIC:
            raise ValueError("not a token file")
        n = int.from_bytes(raw[-16:-8], "little")
        self.part = {k: np.frombuffer(raw, np.dtype(t), size // np.dtype(t).itemsize, at) for k, (at, size, t) in json.loads(raw[-16 - n : -16]).items()}
        self.depth = sum(k.startswith("chunk") for k in self.part)
        self.offset = self.part["offset"]
        self.doc_ids = [int(d) if k else None for d, k in zip(self.part["doc_id"], self.part["known"])]

    def __len__(self) -> int:
        return len(self.part["chunk0"])

    def rank(self, level: int, i: int) -> int:
        """Set bits of a level's bitmap before i."""
        block = i // BLOCK
        bits = self.part[f"bits{level}"][block * (BLOCK // 8) : i // 8 + 1]
        inside = int(_BITS[bits[: i // 8 - block * (BLOCK // 8)]].sum())
        if i % 8:
            inside += int(_BITS[int(bits[-1]) & ((1 << i % 8) - 1)])
        return int(self.part[f"rank{level}"][block]) + inside

    def token(self, i: int) -> int:
        """The i-th id, by one look-up per level."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for level in range(self.depth):
            value |= int(self.part[f"chunk{level}"][i]) << 8 * level
            if not self.part[f"bits{level}"][i // 8] >> (i % 8) & 1:
                break
            i = self.rank(level, i)
        return value

    def slice(self, a: int, b: int) -> np.ndarray:
        """Ids a to b, end exclusive; each level gives one run of chunks."""
        out = np.zeros(b - a, np.int64)
        place = np.arange(b - a)
        for level in range(self.depth):
            if a >= b:
                break
            out[place] |= self.part[f"chunk{level}"][a:b].astype(np.int64) << 8 * level
            first = a // 8
            more = np.unpackbits(self.part[f"bits{level}"][first : (b + 7) // 8], bitorder="little")[a - 8 * first : b - 8 * first].astype(bool)
            start = self.rank(level, a)
            place = place[more]
            a, b = start, start + len(place)
        return out

    def document(self, k: int) -> np.ndarray:
        return self.slice(int(self.offset[k]), int(self.offset[k + 1]))


class LibraryEncoder(Encoder):
    """The word cache of ``bpe.Encoder`` over the ``tokenizers`` library.

    New words go to it joined by spaces, as one text of many words costs less than many texts; the vocabulary marks the
    last token of each word, which tells the words' ids apart.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library, self.most = Tokenizer.from_file(path), most
        self.library.no_truncation()
        self.library.no_padding()
        end = json.loads(self.library.to_str())["model"]["end_of_word_suffix"]
        self.last = np.zeros(self.library.get_vocab_size(), bool)
        if end:
            self.last[[i for t, i in self.library.get_vocab(with_added_tokens=False).items() if t.endswith(end)]] = True
        self._empty()

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        n = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(n.sum())), n

    other = _ids

    def plain(self, words: list[str], many: int = 2_000) -> tuple[np.ndarray, np.ndarray]:
        some = [w for w in words if w]
        ids, _ = self._ids([" ".join(some[i : i + many]) for i in range(0, len(some), many)])
        end = np.flatnonzero(self.last[ids])
        if len(end) != len(some):  # a vocabulary without ends of words
            return self._ids(words)
        n = np.zeros(len(words), np.int64)
        n[[bool(w) for w in words]] = np.diff(np.r_[-1, end])
        return ids, n


_LIBRARY: dict[str, LibraryEncoder] = {}
CACHES["tokens"] = _LIBRARY.clear


def _write_shards(batches, folder: str, vocabulary: str, end_id: int, shard_tokens: int):
    from pyspark import TaskContext

    only_cache("tokens")
    enc = _LIBRARY.get(vocabulary) or _LIBRARY.setdefault(vocabulary, LibraryEncoder(vocabulary))
    store, top = open_shared(folder)
    part, seq = TaskContext.get().partitionId(), 0
    docs, counts, ids, held = [], [], [], 0

    def flush():
        nonlocal docs, counts, ids, held, seq
        name = f"{part:06d}-{seq:04d}-{uuid.uuid4().hex}.dac"
        with store.open_output_stream(f"{top}/{name}") as out:
            out.write(encode_file(docs, np.concatenate(counts), np.concatenate(ids)))
        row = pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "name": [name], "n_docs": [len(docs)], "n_tokens": [held]})
        docs, counts, ids, held, seq = [], [], [], 0, seq + 1
        return row

    for batch in batches:
        texts, keys = batch.column("text"), batch.column("doc_id").to_pylist()
        for a, b in text_slices(texts):
            flat, n = enc.encode(texts.slice(a, b - a))
            ids.append(np.insert(flat, np.cumsum(n), end_id).astype(np.uint32))
            counts.append(n + 1)
            docs += keys[a:b]
            held += len(ids[-1])
            if held >= shard_tokens:
                yield flush()
    if docs:
        yield flush()


def write_tokens(docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None, shard_tokens: int = 8 << 20) -> str:
    """Writes the ids of all documents in ascending doc_id order to a new folder and returns its path."""
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = folder or fresh_path(spark, "tokens")
    store, top = open_shared(folder)
    store.create_dir(top, recursive=True)
    text = docs["text"].cast("string")
    keyed = docs.select("doc_id", F.xxhash64(text).alias("place"), text.alias("text"))  # rows of one doc_id have an order and can be split
    ordered = keyed.repartitionByRange(shuffle_parts(spark), "doc_id", "place").sortWithinPartitions("doc_id", "place").select("doc_id", "text")
    rows = ordered.mapInArrow(lambda it: _write_shards(it, folder, vocabulary, end_id, shard_tokens), "part long, seq long, name string, n_docs long, n_tokens long").collect()
    start, shards = 0, []
    for r in sorted(rows, key=lambda r: (r.part, r.seq)):
        shards.append([r.name, start, r.n_tokens, r.n_docs])
        start += r.n_tokens
    with store.open_output_stream(f"{top}/manifest.json") as out:
        out.write(json.dumps({"tokens": start, "shards": shards}).encode())
    return folder


def read_manifest(folder: str) -> dict:
    store, top = open_shared(folder)
    with store.open_input_stream(f"{top}/manifest.json") as f:
        return json.loads(f.read())


def _read_shards(batches, folder: str, digest: bool):
    store, top = open_shared(folder)
    for batch in batches:
        for name, base in zip(batch.column("name").to_pylist(), batch.column("base").to_pylist()):
            with store.open_input_stream(f"{top}/{name}") as f:
                shard = TokenFile(f.read())
            for a in range(0, len(shard.doc_ids), 4096):
                b = min(len(shard.doc_ids), a + 4096)
                edge = shard.offset[a : b + 1]
                rows = np.split(shard.slice(int(edge[0]), int(edge[-1])).astype("<u4"), edge[1:-1] - edge[0])
                out = {"doc_id": pa.array(shard.doc_ids[a:b], pa.int64()), "start": pa.array(base + edge[:-1], pa.int64()), "n_tokens": pa.array(np.diff(edge), pa.int64())}
                if digest:
                    out["ids_crc32"] = pa.array([zlib.crc32(r.tobytes()) for r in rows], pa.int64())
                else:
                    out["ids"] = pa.array([r.astype(np.int32) for r in rows], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(out)


def read_tokens(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids (or their CRC-32) of every document, read from the files of ``write_tokens``."""
    last = "ids_crc32 long" if digest else "ids array<int>"
    shards = read_manifest(folder)["shards"]
    rows = spark.createDataFrame([(k, name, start) for k, (name, start, _, _) in enumerate(shards)], "shard long, name string, base long")
    return rows.repartitionByRange(max(1, len(shards)), "shard").mapInArrow(lambda it: _read_shards(it, folder, digest), f"doc_id long, start long, n_tokens long, {last}")
