"""Spelling variants by anagram hashing.

A word is a maximal run of the letters A-Z, a-z and U+00C0 to U+00FF, of which only A-Z are lower-cased. ``mangled``
runs have lost a letter, as ``word_counts`` describes. Words of ``least`` letters that occur ``often`` times count.

The anagram value of a word is the sum of its letters' code points to the fifth power (modulo a prime beyond 2**60, so that
no length overflows): equal for anagrams, and far apart for other letters. Two words that differ by one added or removed
letter differ in value by the letter's; two that differ by one exchanged letter, by the difference of both, so each of
them less its own letter gives one value. So each word is listed under its own value and under the value less each of its
letters; entries of equal value meet, and the order of the letters is verified by the edit distance. As the letters on
one side of the edited place are untouched, an entry is also keyed by the half of the word that the edit leaves alone:
anagrams of one another that differ in that half do not meet, so a large class of anagrams makes no pairs.

Counting is one scan: an Arrow function counts each batch's words, Spark adds them up. All later tables are as large as the
vocabulary. No group is gathered: near words are pairs of a join, a word's are counted by partial aggregation, and a
word has no more near words than its letters allow.

Null or empty texts have no words. A null doc_id is written as the empty text. Repeated rows count each time, ties go to
the word that is smaller by code points. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import bounded_batches, byte_runs, dropped, only_cache, shuffle_parts, stored

#: The prime that anagram values are taken modulo, 2**61 - 1.
PRIME = (1 << 61) - 1
#: Words of more bytes than this have their checksum taken one by one.
LONG = 64


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, np.uint32(0xEDB88320) ^ (c >> 1), c >> 1)
    return c


_TABLE = _crc_table()


def letter_runs(texts: list[bytes], least: int) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(the runs of ``least`` letters or more of all texts, A-Z lower-cased, in order; the text each comes from)."""

    def letters(data: np.ndarray) -> np.ndarray:
        lead = data == 0xC3  # the first byte of U+00C0 to U+00FF, and of nothing else
        out = ((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A) & (data < 0x80) | lead
        out[1:] |= lead[:-1]
        return out

    return byte_runs(texts, letters, least)


def joined_crc(heads: np.ndarray, owner: np.ndarray, tails: list[bytes], tail: np.ndarray) -> np.ndarray:
    """crc32 of each pair's head and tail written one after the other: ``heads`` are checksums, ``tails`` bytes.

    A checksum moves past n bytes by a linear map, so it is taken once a head and length and once a tail, not once a pair.
    """
    size = np.fromiter(map(len, tails), np.int64, len(tails))[tail]
    own = np.fromiter(map(zlib.crc32, tails), np.uint32, len(tails))[tail]
    out = heads[owner]  # right for empty tails
    order = np.argsort(size, kind="stable")
    bound = np.searchsorted(size[order], np.arange(LONG + 2))
    moved = heads.copy()
    for n in range(1, LONG + 1):
        moved = _TABLE[moved & 255] ^ (moved >> 8)
        at = order[bound[n] : bound[n + 1]]
        out[at] = moved[owner[at]] ^ own[at]
    for at in order[bound[LONG + 1] :].tolist():
        out[at] = zlib.crc32(tails[tail[at]], int(heads[owner[at]]))
    return out


def _counted(batches, least: int, every: int):
    only_cache("variants")
    for batch in batches:
        texts = [t.encode() if t else b"" for t in batch.column("text").to_pylist()]
        heads = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in batch.column("doc_id").to_pylist()], np.uint32)
        runs, owner = letter_runs(texts, least)
        words, code = runs.dictionary.to_pylist(), np.asarray(runs.indices, np.int64)
        if not words:
            continue
        crc = joined_crc(heads, owner, [w.encode() for w in words], code)
        hit = np.flatnonzero(crc % every == 0)
        whole = np.bincount(code, minlength=len(words)) - np.bincount(code[hit], minlength=len(words))
        length = np.fromiter(map(len, words), np.int64, len(words))
        place, times = np.unique(np.stack([code[hit], crc[hit] % length[code[hit]]]), axis=1, return_counts=True)
        there = np.flatnonzero(whole)
        out, n = [words[w] for w in there.tolist()], whole[there].tolist()
        for (w, p), k in zip(place.T.tolist(), times.tolist()):
            if length[w] > least:
                out.append(words[w][:p] + words[w][p + 1 :])
                n.append(k)
        yield pa.RecordBatch.from_pydict({"word": pa.array(out, pa.string()), "n": pa.array(n, pa.int64())})


def word_counts(docs: DataFrame, least: int = 7, often: int = 2, every: int = 31) -> DataFrame:
    """word, n of words of ``least`` letters with ``often`` occurrences.

    Let h be the crc32 of ``<doc_id>:<run>``; where ``every`` divides h, the run's letter number h modulo its length is
    deleted before it is counted.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    counts = rows.mapInArrow(lambda it: _counted(it, least, every), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def _fifth(letter: Column) -> Column:
    code = F.ascii(letter).cast("long")
    return code * code * code * code * code


def entries(words: DataFrame) -> DataFrame:
    """key, whole, word, n: the keys of each word itself (``whole``) and of the word less each of its letters.

    Ten rows a word or so, so the few files of the word table are dealt to all tasks first.
    """
    letters = words.repartition(shuffle_parts(words.sparkSession), "word").withColumn("letters", F.split("word", "")).withColumn("value", F.aggregate("letters", F.lit(0).cast("long"), lambda a, c: (a + _fifth(c)) % PRIME))
    size = F.length("word")
    half = lambda core, front: F.when(front, F.left("word", F.floor(core / 2).cast("int"))).otherwise(F.right("word", (core - F.floor(core / 2)).cast("int")))
    entry = lambda whole, value, core, front: F.struct(F.lit(whole).alias("whole"), F.xxhash64(value, core, front, half(core, front)).alias("key"))
    own = F.array(*(entry(True, F.col("value"), size, F.lit(front)) for front in (True, False)))
    less = F.transform("letters", lambda c, i: entry(False, F.pmod(F.col("value") - _fifth(c), F.lit(PRIME)), size - 1, i >= F.floor((size - 1) / 2)))
    return letters.select("word", "n", F.inline(F.concat(own, F.array_distinct(less))))


def near_words(words: DataFrame) -> DataFrame:
    """word, other, n, other_n: each pair of words one added, removed or exchanged letter apart, in both directions."""
    e = entries(words)
    a, b = e.alias("a"), e.alias("b")
    met = (F.col("a.key") == F.col("b.key")) & (F.col("a.word") < F.col("b.word")) & ~(F.col("a.whole") & F.col("b.whole")) & (F.levenshtein("a.word", "b.word", 1) == 1)
    pairs = a.join(b, met).select(F.col("a.word").alias("word"), F.col("b.word").alias("other"), F.col("a.n").alias("n"), F.col("b.n").alias("other_n")).distinct()
    both = F.array(F.struct("word", "other", "n", "other_n"), F.struct(F.col("other").alias("word"), F.col("word").alias("other"), F.col("other_n").alias("n"), F.col("n").alias("other_n")))
    return pairs.select(F.inline(both))


def roots(links: DataFrame) -> DataFrame:
    """word, root of links (word, form) without cycles: each round halves the way that is left, so few rounds do."""
    at = stored(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = stored(at.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        dropped(at)
        more = not moved.where("moved").isEmpty()
        at = moved
        if not more:
            return at.select("word", "root")


def variants(docs: DataFrame, least: int = 7, often: int = 2, every: int = 31, times: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n: a word's form is its near word of largest n, if that is ``times`` its own."""
    words = stored(word_counts(docs, least, often, every), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best")
    near = near_words(words).groupBy("word").agg(F.max("n").alias("own_n"), F.count("*").alias("n_near"), best)
    larger = -F.col("best.less") >= times * F.col("own_n")
    near = stored(near.select("word", "n_near", F.when(larger, F.col("best.form")).alias("form"), F.when(larger, -F.col("best.less")).alias("form_n")), "near")
    last = roots(near.where("form is not null"))
    out = words.join(near, "word", "left").join(last, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
