"""Document fingerprints: I-Match over randomised subsets of a lexicon. Built-in functions only.

A term is a maximal run of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased; it is known by the first 60
bits of its MD5. The lexicon is the band of terms with an inverse document frequency ln(N / df) of ``low_idf`` or more,
that is a df of at most N / e**low_idf, down to a df of ``lo``: 2, doubled until the band has at most ``lexicon`` terms.
So the lexicon is bounded at any size of table and may be broadcast; the df themselves count all documents.

The lexicon is dealt at random to 2**j subsets, the first 64 of which are hashed: subset c of level j are the terms whose
digest is c modulo 2**j. A text of m distinct terms uses the level j with 2**j >= m, 6 at least, and the next one, so a
subset holds about one of its terms, however long it is. For each subset the text's distinct terms of the lexicon in it
are sorted and hashed; subsets without one have no entry. A fingerprint lists level, subset and hash, eight hexadecimal
digits in all, the first four in capitals, in this order; behind a bar come the same entries without regard to the band, for texts of common or unique
words alone.

The likeness of two fingerprints is the share of equal entries among the subsets that either has at levels that both
have: it follows the Jaccard similarity of the terms in the band. Where one of the two has fewer than ``least`` entries of
the band, the entries without regard to it are compared. Equal fingerprints have likeness 1, such without a common
level (numbers of terms more than a factor of two apart, at the least) or without a common entry 0.

Null text is empty: its fingerprint is "|". Equal texts have equal fingerprints within one table. Order is by doc_id, null
ids first, rows of one id by a hash of their texts; equal rows follow each other. The next document of the last is the
first, so of a single document itself. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import bounded_batches, by_number, shuffle_parts, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates terms, beside blanks: ASCII but letters and digits.
BETWEEN = "".join(c for c in map(chr, range(128)) if not c.isalnum() and c != " ")
#: Subsets hashed at a level; the least level has as many.
SUBSETS, LEAST_LEVEL = 64, 6


def words(text: Column) -> Column:
    """The distinct terms of a text, and the empty one: no pattern is matched, one character table does."""
    return F.array_distinct(F.split(F.translate(text, BETWEEN + UPPER, " " * len(BETWEEN) + LOWER), " "))


def digest(word: Column) -> Column:
    return F.conv(F.substring(F.md5(word), 1, 15), 16, 10).cast("long")


def digests(text: Column) -> Column:
    """The distinct terms of a text, as 60-bit numbers."""
    return F.transform(F.array_remove(words(text), ""), digest)


def lexicon_of(docs: DataFrame, low_idf: float, most: int) -> DataFrame:
    """term: the digests of the band, ``most`` at most."""
    n = docs.count()
    df = docs.select(F.explode(words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    inside = (F.col("df") >= 2) & (F.col("df") <= max(2.0, n / math.exp(low_idf))) & (F.col("word") != "")
    band = stored(df.where(inside).select(digest(F.col("word")).alias("term"), "df"), "lexicon")
    sizes = {r.bits: r["count"] for r in band.groupBy(F.length(F.bin("df")).alias("bits")).count().collect()}  # 63 rows at most
    lo = next(b for b in range(2, 65) if sum(v for k, v in sizes.items() if k >= b) <= most)
    return band.where(F.col("df") >= F.lit(1 << (lo - 1))).select("term")


def _placed(docs: DataFrame) -> DataFrame:
    """bucket, wrap, ghost, doc_id, own, text: rows dealt by order, each bucket with the first row of the next as a ghost.

    Edges are keys of rows, one a bucket, found on keys alone; a row's bucket is looked up in two steps of about the square
    root of their number. Texts are shuffled once.
    """
    n = shuffle_parts(docs.sparkSession)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("own"), "text")
    ids = keyed.select("doc_id", "own").repartitionByRange(n, "doc_id", "own")
    found = ids.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("doc_id", "own")).alias("e")).collect()  # n rows at most
    edges = sorted({(r.e.doc_id is not None, r.e.doc_id or 0, r.e.own) for r in found}) or [(False, 0, 0)]
    width = math.isqrt(len(edges) - 1) + 1
    key = F.struct(F.col("doc_id").isNotNull().alias("a"), F.coalesce("doc_id", F.lit(0)).alias("b"), F.col("own").alias("c"))
    listed = lambda es: F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).cast("long").alias("b"), F.lit(c).cast("long").alias("c")) for a, b, c in es))
    upto = lambda a: F.size(F.filter(a, lambda e: e <= F.col("key")))
    coarse = keyed.withColumn("key", key).withColumn("shelf", F.greatest(upto(listed(edges[::width])), F.lit(1)) - 1)
    fine = coarse.withColumn("bucket", F.col("shelf") * width + upto(F.slice(listed(edges), F.col("shelf") * width + 1, F.lit(width))) - 1)
    at = lambda bucket, wrap, ghost: F.struct(bucket.cast("int").alias("bucket"), wrap.alias("wrap"), F.lit(ghost).alias("ghost"))
    first = F.col("key") == F.get(listed(edges), F.col("bucket"))
    here = at(F.col("bucket"), F.lit(False), False)
    before = at(F.pmod(F.col("bucket") - 1, F.lit(len(edges))), F.col("bucket") == 0, True)
    rows = fine.select(F.inline(F.when(first, F.array(here, before)).otherwise(F.array(here))), "doc_id", "own", "text")
    return by_number(rows, "bucket", n)


def _bit(level: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), level)


def _sampled(terms: str) -> Column:
    """(level, digests in the subsets of that level) of an array of digests; those of the next level are among them."""
    level = F.greatest(F.length(F.bin(F.greatest(F.size(terms) - 1, F.lit(0)))), F.lit(LEAST_LEVEL))
    mask = _bit(level) - 1
    return F.struct(level.alias("level"), F.filter(terms, lambda h: h.bitwiseAND(mask) < SUBSETS).alias("terms"))


def _entries(rows: DataFrame, lexicon: DataFrame) -> DataFrame:
    """bucket, at, info, band_0, all_0, band_1, all_1: sorted entries of own and edited text (columns s0 and s1 of ``rows``).

    Rows of a bucket stay where they are; a marker row carries ``info`` past the terms.
    """
    of = lambda side, level, term, info: F.struct(F.lit(side).alias("side"), level.alias("level"), term.alias("term"), info.alias("info"))
    none = F.lit(None).cast(rows.schema["info"].dataType)
    each = lambda side: F.transform(F.col(f"s{side}.terms"), lambda h: of(side, F.col(f"s{side}.level"), h, none))
    marker = F.array(of(-1, F.lit(0), F.lit(None).cast("long"), F.col("info")))
    long = rows.select("bucket", "at", F.inline(F.concat(marker, each(0), each(1)))).join(F.broadcast(lexicon.withColumn("known", F.lit(True))), "term", "left")
    bit = _bit(F.col("level"))
    kinds = F.when(F.col("known"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))
    levels = F.when(F.col("term").bitwiseAND(bit) == 0, F.array(F.col("level"), F.col("level") + 1)).otherwise(F.array("level"))
    subset = F.col("term").bitwiseAND(F.lit(SUBSETS - 1))
    long = long.select("bucket", "at", "side", "info", "term", subset.alias("subset"), F.explode(kinds).alias("band"), levels.alias("levels")).withColumn("level", F.explode("levels"))
    hashed = F.substring(F.md5(F.array_join(F.array_sort(F.collect_list("term")), " ")), 1, 4)
    two = lambda c: F.lpad(F.hex(F.col(c).cast("long")), 2, "0")
    sets = long.groupBy("bucket", "at", "side", "band", "level", "subset").agg(hashed.alias("hashed"), F.max("info").alias("info")).withColumn("entry", F.concat(two("level"), two("subset"), "hashed"))
    gathered = (F.array_sort(F.collect_list(F.when((F.col("side") == s) & (F.col("band") == F.lit(b)), F.col("entry")))).alias(f"{'band' if b else 'all'}_{s}") for s in (0, 1) for b in (True, False))
    return sets.groupBy("bucket", "at").agg(F.max("info").alias("info"), *gathered)


def written(band: str, every: str) -> Column:
    return F.concat(F.array_join(band, ""), F.lit("|"), F.array_join(every, ""))


def _near(df: DataFrame, name: str, a: tuple[str, str], b: tuple[str, str], least: int) -> DataFrame:
    """``df`` with the likeness of two pairs of entry lists, of the band and all; one column a step, as a lambda evaluates all of its body for every entry."""
    inside = (F.size(a[0]) >= least) & (F.size(b[0]) >= least)
    pick = lambda p: F.when(inside, F.col(p[0])).otherwise(F.col(p[1]))
    levels = lambda c: F.array_distinct(F.transform(c, lambda e: F.left(e, F.lit(2))))
    there = lambda c: F.transform(F.filter(c, lambda e: F.array_contains("_common", F.left(e, F.lit(2)))), lambda e: F.left(e, F.lit(4)))
    out = df.withColumns({"_x": pick(a), "_y": pick(b)}).withColumn("_common", F.array_intersect(levels("_x"), levels("_y")))
    out = out.withColumn("_sets", F.size(F.array_union(there("_x"), there("_y"))))
    share = F.when(F.col("_sets") > 0, F.size(F.array_intersect("_x", "_y")) / F.col("_sets")).otherwise(F.lit(0.0))
    same = F.col(a[0]).eqNullSafe(F.col(b[0])) & F.col(a[1]).eqNullSafe(F.col(b[1]))
    return out.withColumn(name, F.when(same, F.lit(1.0)).otherwise(share)).drop("_x", "_y", "_common", "_sets")


def with_likeness(df: DataFrame, name: str, a: str, b: str, least: int = 8) -> DataFrame:
    """``df`` with the likeness, 0 to 1, of the fingerprints in its columns ``a`` and ``b``, which come from one table of documents."""
    part = lambda f, i: F.regexp_extract_all(F.split_part(f, F.lit("|"), F.lit(i)), F.lit("[0-9A-Fa-f]{8}"), F.lit(0))
    parts = {f"_{f}{i}": part(F.col(f), i) for f in {a, b} for i in (1, 2)}
    return _near(df.withColumns(parts), name, (f"_{a}1", f"_{a}2"), (f"_{b}1", f"_{b}2"), least).drop(*parts)


def fingerprints(docs: DataFrame, low_idf: float = 3.0, lexicon: int = 500_000, least: int = 8) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of ``docs``.

    The edited text has the last quarter of its code points replaced by as many of the next document's first.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    known = lexicon_of(docs, low_idf, lexicon)
    order = Window.partitionBy("bucket").orderBy("wrap", "doc_id", "own")
    rows = _placed(docs).select("bucket", "ghost", "doc_id", "text", F.row_number().over(order).alias("at"), F.lead("text").over(order).alias("next"))
    info = F.struct("ghost", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    edited = F.expr("concat(substring(text, 1, length(text) - length(text) div 4), substring(coalesce(next, ''), 1, cast(length(text) div 4 as int)))")
    rows = rows.withColumn("edited", edited).select("bucket", "at", info.alias("info"), digests(F.col("text")).alias("d0"), digests(F.col("edited")).alias("d1"))
    parts = _entries(rows.select("bucket", "at", "info", _sampled("d0").alias("s0"), _sampled("d1").alias("s1")), known)
    after = Window.partitionBy("bucket").orderBy("at")
    out = parts.select("bucket", "at", "info.*", "band_0", "all_0", "band_1", "all_1", F.lead("band_0").over(after).alias("band_2"), F.lead("all_0").over(after).alias("all_2")).where(~F.col("ghost"))
    for name, k in (("near_edited", 1), ("near_next", 2)):
        out = _near(out, name, ("band_0", "all_0"), (f"band_{k}", f"all_{k}"), least)
    return out.select("doc_id", "n_chars", "edited_sha256", written("band_0", "all_0").alias("fingerprint"), written("band_1", "all_1").alias("edited_fingerprint"), "near_edited", "near_next")
