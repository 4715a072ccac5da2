"""BPE encoding and decoding in batched numpy merge rounds.

A text is cut at white space into chunks, whose words a bounded cache maps to their ids. New chunks are normalised and
cut into words as the vocabulary file says; the words' symbols then lie in one flat array. A round looks all neighbouring pairs up by binary search over the sorted pair keys, takes each word's pair of lowest
rank, merges all its places at once and drops the words without a pair. Ids and decoded texts equal those of the
``tokenizers`` library (checked against it, document by document, in the tests).

Nulls count as empty texts and give no ids. Texts of any length are encoded whole; one batch holds at most
``workspace.BATCH_BYTES`` bytes or one text. Repeated documents give repeated rows, a null doc_id stays null; further input columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .workspace import CACHES, bounded_batches, only_cache

NO_RANK = np.int64(1) << 60
#: A chunk of Latin letters and ASCII signs behind them. Dotted capital I has a lower case of two characters; quotes and
#: the signs of special tokens mean more to the vocabulary; so chunks with these are not cut.
LATIN = r"^(?P<word>[A-Za-zÀ-ÖØ-öø-įı-ɏ]+)(?P<rest>[!#$%&()*+,./:;=?@^_{}~-]*)$"
#: The words of an ASCII chunk in lower case, by the vocabulary's pattern.
_ASCII_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
#: The split pattern that _ASCII_WORDS restates.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(spare)
            spare += 1
    return [out[b] for b in range(256)]


class Bpe:
    """A byte-level BPE vocabulary with word ends, read from a ``tokenizers`` JSON file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        if model["type"] != "BPE" or split != _PATTERN or spec["decoder"] is not None or spec["post_processor"] is not None:
            raise ValueError(f"{path}: not a word-end BPE vocabulary of the supported kind")
        library = Tokenizer.from_file(path)
        self._normalise, self._pretokenise = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        every = "".join(map(chr, range(33, 127)))
        if self._normalise(every) != every.lower() or self._normalise("ÀÖØÞßĄŽɎ") != "àöøþßąžɏ":  # what words of Latin letters rely on
            raise ValueError(f"{path}: its normaliser does more than lower the case of Latin text")
        vocab = dict(model["vocab"])
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *added.values()]) + 1
        chars, end = byte_chars(), model["end_of_word_suffix"] or ""
        self.byte_of = {c: b for b, c in enumerate(chars)}
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.final = np.array([vocab[c + end] for c in chars], np.int64)
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ", 1)) for m in model["merges"]]
        left, right = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        key = left * self.size + right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order.astype(np.int64), made[order]
        born = np.full(self.size, -1, np.int64)
        born[made] = np.arange(len(made))
        #: All places of a pair may be merged in one round if no symbol has two origins or is used before it is made.
        self.at_once = len(np.unique(made)) == len(made) and bool((born[left] < np.arange(len(made))).all() and (born[right] < np.arange(len(made))).all())
        self.special = added
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.marks = tuple(sorted({t[:2] for t in added}))
        token = [b""] * self.size
        for t, i in [*vocab.items(), *added.items()]:
            token[i] = t.encode()
        self.tokens = pa.array(token, pa.binary())

    def words(self, text: str) -> list[bytes]:
        """The words of a text without special tokens, as bytes."""
        if text.isascii() and not any(c in text for c in "\t\n\v\f\r "):
            return [w.encode() for w in _ASCII_WORDS.findall(text.lower())]
        of = self.byte_of
        return [bytes(of[c] for c in w) for w, _ in self._pretokenise(self._normalise(text))] if text else []

    def parts(self, chunk: str) -> list[bytes | int]:
        """Words and ids of special tokens of one chunk, in order."""
        if self._cut and any(m in chunk for m in self.marks):
            out: list[bytes | int] = []
            for i, piece in enumerate(self._cut.split(chunk)):
                out += [self.special[piece]] if i % 2 else self.words(piece)
            return out
        return self.words(chunk)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, one after the other; number of ids of each word)."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        counts = np.zeros(len(words), np.int64)
        if not length.sum():
            return np.zeros(0, np.int64), counts
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym, word = self.inner[raw], np.repeat(np.arange(len(words)), length)
        last = np.cumsum(length)[length > 0] - 1
        sym[last] = self.final[raw[last]]
        done_sym, done_word = [], []
        while len(sym):
            key = sym[:-1] * self.size + sym[1:]
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            rank = np.full(len(sym), NO_RANK)
            hit = (self.keys[at] == key) & (word[:-1] == word[1:])
            rank[:-1][hit] = self.ranks[at[hit]]
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.minimum.reduceat(rank, starts)
            span = np.diff(np.r_[starts, len(sym)])
            alive = np.repeat(lowest < NO_RANK, span)
            take = alive & (rank == np.repeat(lowest, span))
            if self.at_once:  # of overlapping places, as in aaa, every second
                run = np.flatnonzero(take & ~np.r_[False, take[:-1]])
                ahead = np.flatnonzero(take)
                take[ahead[(ahead - run[np.searchsorted(run, ahead, "right") - 1]) % 2 == 1]] = False
            else:
                ahead = np.flatnonzero(take)
                take[ahead[1:][word[ahead][1:] == word[ahead][:-1]]] = False
            here = np.flatnonzero(take)
            sym[here] = self.made[at[here]]
            keep = alive.copy()
            keep[here + 1] = False
            done_sym.append(sym[~alive])
            done_word.append(word[~alive])
            sym, word = sym[keep], word[keep]
        ids, owner = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(owner, kind="stable")
        return ids[order], np.bincount(owner, minlength=len(words))


class Numbered(dict):
    """string -> its number in the order of first look-ups."""

    def __missing__(self, word: str) -> int:
        v = self[word] = len(self)
        return v


class Encoder:
    """Encodes arrays of texts; ids of distinct words are kept, ``most`` of them at most.

    Arrow cuts the texts at ASCII white space and numbers the distinct chunks, so that Python sees each chunk of a slice
    once. A Latin word with ASCII signs behind it is two words by the vocabulary's pattern, and is looked up as such in
    lower case; any other chunk is looked up whole.
    """

    def __init__(self, bpe: Bpe, most: int = 400_000):
        self.bpe, self.most = bpe, most
        self._empty()

    def _empty(self) -> None:
        self.number = Numbered()
        self.pool, self.start, self.count = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of texts that are one word of the vocabulary's pattern each. All are merged together."""
        return self.bpe.merge([w.encode() for w in words])

    def other(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of any chunks."""
        parts = [self.bpe.parts(c) for c in chunks]
        number: dict[bytes, int] = {}
        slots = [[number.setdefault(p, len(number)) if isinstance(p, bytes) else -1 - p for p in ps] for ps in parts]
        ids, n = self.bpe.merge(list(number))
        first = np.cumsum(n) - n
        flat = np.fromiter((s for ps in slots for s in ps), np.int64)
        special, word = flat < 0, np.maximum(flat, 0)
        size = np.where(special, 1, n[word] if len(n) else 1)
        at = np.where(special, 0, first[word] if len(n) else 0)
        out = gather(ids, at, size) if len(ids) else np.zeros(size.sum(), np.int64)
        out[(np.cumsum(size) - size)[special]] = -1 - flat[special]
        owner = np.repeat(np.arange(len(chunks)), [len(ps) for ps in slots])
        return out, np.bincount(owner, weights=size, minlength=len(chunks)).astype(np.int64)

    def _numbers(self, found: pa.Array, make) -> np.ndarray:
        """The number of each distinct string of an array; new ones are encoded by ``make``."""
        words, known = found.to_numpy(zero_copy_only=False), len(self.number)
        out = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        new = np.flatnonzero(out >= known)
        if len(new):
            ids, n = make([words[i] for i in new])
            self.start = np.r_[self.start, len(self.pool) + np.cumsum(n) - n]
            self.count = np.r_[self.count, n]
            self.pool = np.r_[self.pool, ids.astype(np.uint32)]
        return out

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after the other; number of ids of each text)."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        if len(self.number) > self.most:
            self._empty()
        cut = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        each = np.diff(np.asarray(cut.offsets, np.int64))
        chunk = cut.flatten().dictionary_encode()
        which, chunks = np.asarray(chunk.indices, np.int64), chunk.dictionary
        parts = pc.extract_regex(chunks, LATIN)
        plain = np.asarray(pc.is_valid(parts))
        parts = parts.filter(pa.array(plain))
        # up to two entries a chunk: a word and what follows it, or the chunk itself
        slot = np.zeros((len(chunks), 2), np.int64)
        used = np.ones((len(chunks), 2), bool)
        for k, piece in enumerate((pc.utf8_lower(parts.field("word")), parts.field("rest"))):
            piece = piece.dictionary_encode()
            slot[plain, k] = self._numbers(piece.dictionary, self.plain)[np.asarray(piece.indices, np.int64)]
        slot[~plain, 0] = self._numbers(chunks.filter(pa.array(~plain)), self.other)
        used[~plain, 1] = False
        size = np.where(used, self.count[slot], 0) if len(chunks) else np.zeros((0, 2), np.int64)
        pool = gather(self.pool, self.start[slot].ravel() if len(chunks) else np.zeros(0, np.int64), size.ravel())
        size = size.sum(1)
        start = np.cumsum(size) - size
        n = size[which]
        edge = np.r_[0, np.cumsum(n)][np.r_[0, np.cumsum(each)]]
        return gather(pool, start[which], n), np.diff(edge)


def gather(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """pool[s:s+n] of each start s and size n, joined."""
    before = np.cumsum(size) - size
    return pool[np.repeat(start - before, size) + np.arange(int(size.sum()))]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for a worker process."""
    return Encoder(Bpe(path))


CACHES["bpe"] = encoder.cache_clear


def slices(texts: list, most: int = 1 << 20):
    """Ranges of consecutive texts of about ``most`` characters, one text at least."""
    at = size = 0
    for i, t in enumerate(texts):
        if i > at and size + len(t or "") > most:
            yield at, i
            at, size = i, 0
        size += len(t or "")
    if len(texts) > at:
        yield at, len(texts)


def text_slices(texts: pa.Array, most: int = 4 << 20):
    """Ranges of consecutive texts of about ``most`` bytes, one text at least."""
    total = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield at, end
        at = end


def encode_column(batches, path: str, digest: bool):
    only_cache("bpe")
    enc = encoder(path)
    for batch in batches:
        texts = batch.column("text")
        for a, b in text_slices(texts):
            ids, n = enc.encode(texts.slice(a, b - a))
            edge = np.r_[0, np.cumsum(n)]
            lists = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), enc.bpe.tokens.take(pa.array(ids)))
            decoded = pc.binary_join(lists, b" ")  # tokens joined by one space: what a file without a decoder gives
            out = {"doc_id": batch.column("doc_id").slice(a, b - a), "n_tokens": pa.array(n, pa.int64())}
            if digest:
                raw, text = memoryview(ids.astype("<u4").tobytes()), memoryview(decoded.buffers()[2] or b"")
                at = np.frombuffer(decoded.buffers()[1], np.int32, len(decoded) + 1) if len(decoded) else [0]
                out["ids_sha256"] = pa.array([hashlib.sha256(raw[4 * x : 4 * y]).hexdigest() for x, y in zip(edge[:-1], edge[1:])], pa.string())
                out["decoded_sha256"] = pa.array([hashlib.sha256(text[x:y]).hexdigest() for x, y in zip(at[:-1], at[1:])], pa.string())
            else:
                out["ids"] = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(ids.astype(np.int32)))
                out["decoded"] = decoded.cast(pa.string())
            yield pa.RecordBatch.from_pydict(out)


def bpe_encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids (array<int>) and decoded text of every document."""
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(lambda it: encode_column(it, vocabulary, False), "doc_id long, n_tokens long, ids array<int>, decoded string")


def bpe_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of ids and decoded text of every document; no shuffle."""
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(lambda it: encode_column(it, vocabulary, True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
