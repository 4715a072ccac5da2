"""Bursting n-grams: document frequency by year, burst score, greedy removal of contained terms, coverage."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from ..functions.textnorm import STOP_WORDS, Grams, cut, grams_of, mixed, normalise_ascii, runs, token_runs
from ..schema import bounded_batches
from ..taxonomy import Taxonomy
from .match import concepts_of


#: Cells of the sketch: a document's share, the least, and the most (a bit each when broadcast).
CELLS_A_DOCUMENT, LEAST_CELLS, MOST_CELLS = 1024, 1 << 20, 1 << 28
#: Cells of a row of the sketch, tasks whose rows of a block are added up at once, and cells that a task holds before it sends them.
CELLS_A_ROW, TASKS_A_SHARD, CELLS_HELD = 1 << 16, 64, 1 << 21
#: Times the most cells that the documents would need, from which on too few cells would stay below the least frequency.
CROWDED = 8
TERMS = "source string, year int, term string"
#: Documents of a partition of ``by_source_year``.
DOCS_A_PARTITION = 8192


#: Bytes of texts that are cut into tokens at once: some 10 times as many are held while they are.
BYTES_AT_ONCE = 1 << 20


def _cut(batches):
    """The batches with tokens; texts in lower case are cut here, some at a time, which costs less than to send each token."""
    for batch in batches:
        if "tokens" in batch.schema.names:
            yield batch
            continue
        low = batch.column("low")
        for a, b in runs(np.asarray(pc.fill_null(pc.binary_length(low), 0), np.int64), BYTES_AT_ONCE):
            some = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([some.column("source"), some.column("year"), cut(some.column("low"))], ["source", "year", "tokens"])


def _parts(batches):
    """The batches in parts of a bounded number of tokens, so that a task's memory follows neither rows nor their length."""
    for batch in _cut(batches):
        for a, b in token_runs(batch.column("tokens")):
            yield batch.slice(a, b - a)


def _cells(batch: pa.RecordBatch, longest: int, cells: int) -> tuple[Grams, np.ndarray]:
    """The n-grams of a batch, and the cell of each under its source and year."""
    g = grams_of(batch.column("tokens"), longest, STOP_WORDS)
    year = np.asarray(batch.column("year").fill_null(-1), np.int64).astype(np.uint64)
    source = np.fromiter((xxh3_64_intdigest((s or "").encode()) for s in batch.column("source").to_pylist()), np.uint64, batch.num_rows)
    return g, (mixed(g.hashes() ^ mixed(source + year)[g.owner]) % np.uint64(cells)).astype(np.int64)


def _packed(place: np.ndarray, n: np.ndarray) -> bytes:
    """Places of a row in order, as steps, and what each holds."""
    return zlib.compress(np.diff(place, prepend=0).astype("<u2").tobytes() + n.astype(np.uint8).tobytes(), 1)


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = zlib.decompress(raw)
    k = len(data) // 3
    return np.cumsum(np.frombuffer(data, "<u2", k), dtype=np.int64), np.frombuffer(data, np.uint8, k, 2 * k)


def _sketched(batches, longest: int, cells: int):
    """What the cells that some n-grams of this task fall into hold, up to 255; sent whenever ``CELLS_HELD`` are held."""
    shard = TaskContext.get().partitionId() // TASKS_A_SHARD

    def sent(held: list[np.ndarray]) -> pa.RecordBatch:
        every = np.concatenate(held)
        held.clear()
        every.sort()
        first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]).astype(np.int32)
        cell = every[first]
        n = np.minimum(np.diff(first, append=np.int32(len(every))), 255).astype(np.uint8)
        head = np.flatnonzero(np.diff(cell // CELLS_A_ROW, prepend=np.int32(-1)))
        rows = [_packed(cell[a:b] % CELLS_A_ROW, n[a:b]) for a, b in zip(head, [*head[1:], len(cell)])]
        return pa.RecordBatch.from_pydict({"block": pa.array(cell[head] // CELLS_A_ROW, pa.int32()), "shard": pa.array([shard] * len(rows), pa.int32()), "cells": pa.array(rows, pa.binary())})

    held: list[np.ndarray] = []
    for batch in _parts(batches):
        held.append(_cells(batch, longest, cells)[1].astype(np.int32))
        if sum(map(len, held)) >= CELLS_HELD:
            yield sent(held)
    if sum(map(len, held)):
        yield sent(held)


def _added(table: pa.Table, full: int | None = None) -> pa.Table:
    """The sum of a block's rows, up to 255; or whether each cell reaches ``full``, a bit each."""
    total = np.zeros(CELLS_A_ROW, np.uint16)
    for raw in table.column("cells"):
        place, n = _unpacked(raw.as_py())
        total[place] = np.minimum(total[place] + n, 255)
    there = np.flatnonzero(total)
    out = _packed(there, total[there]) if full is None else np.packbits(total >= full).tobytes()
    return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "cells": pa.array([out], pa.binary())})


def _frequent(texts: DataFrame, min_df: int, longest: int, cells: int) -> np.ndarray:
    """A bit a cell: whether the n-grams in it can reach ``min_df``. A cell counts all its n-grams, so none that does is lost."""
    parts = texts.mapInArrow(lambda it: _sketched(it, longest, cells), "block int, shard int, cells binary")
    some = parts.groupBy("block", "shard").applyInArrow(lambda t: _added(t), "block int, cells binary")
    bits = np.zeros(cells // 8, np.uint8)
    for r in some.groupBy("block").applyInArrow(lambda t: _added(t, min_df), "block int, cells binary").collect():  # cells / 8 bytes
        bits[r.block * CELLS_A_ROW // 8 :][: CELLS_A_ROW // 8] = np.frombuffer(r.cells, np.uint8)
    return bits


def _kept(batches, longest: int, cells: int, bits):
    """source, year and term of the n-grams whose cell is frequent."""
    for batch in _parts(batches):
        g, cell = _cells(batch, longest, cells)
        kept = np.flatnonzero(bits.value[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1)
        owner = pa.array(g.owner[kept])
        yield pa.RecordBatch.from_arrays([batch.column("source").take(owner), batch.column("year").take(owner), g.joined(kept)], ["source", "year", "term"])


def _every(batches, longest: int):
    """source, year and term of all n-grams."""
    for batch in _parts(batches):
        g = grams_of(batch.column("tokens"), longest, STOP_WORDS)
        owner = pa.array(g.owner)
        yield pa.RecordBatch.from_arrays([batch.column("source").take(owner), batch.column("year").take(owner), g.joined()], ["source", "year", "term"])


def by_source_year(docs: DataFrame) -> DataFrame:
    """``docs`` with those of a source and year side by side, in partitions of ``DOCS_A_PARTITION`` or one a core.

    A task of ``ngram_df`` then adds up most of a term before it sends it. Partitions are ranges, so a large source-year is
    several and small ones share one; within a source-year documents keep their place.
    """
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-docs.count() // DOCS_A_PARTITION))
    return docs.withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(parts, "source", "year", "_place").drop("_place")


def ngram_df(docs: DataFrame, min_df: int = 5, longest: int = 3, text: str = "text", cells: int | None = None) -> DataFrame:
    """source, year, term, df. Terms below ``min_df`` in a source-year go before years are added up.

    Most n-grams stand in a document or two. So a first scan counts cells of a count-min sketch over source, year and
    term, whose size follows the documents up to a fixed one; a second scan sends on only n-grams whose cell reaches
    ``min_df``, and these are counted exactly. Where the sketch would be crowded, all are sent. ``docs`` are read twice, so
    they are best kept by the caller, and dealt by ``by_source_year``.
    """
    bounded_batches(docs.sparkSession)
    low = docs.select("source", "year", F.lower(text).alias("low"))
    if cells is None:
        n = docs.count()
        cells = min(MOST_CELLS, max(LEAST_CELLS, 1 << (CELLS_A_DOCUMENT * n).bit_length()))
        cells = 0 if n * CELLS_A_DOCUMENT > CROWDED * cells or min_df < 2 else cells
    if cells and min_df <= 255:
        bits = docs.sparkSession.sparkContext.broadcast(_frequent(low, min_df, longest, cells))
        terms = low.mapInArrow(lambda it: _kept(it, longest, cells, bits), TERMS)
    else:
        terms = low.mapInArrow(lambda it: _every(it, longest), TERMS)
    return terms.groupBy("source", "year", "term").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)


def burst_scores(df: DataFrame, analysed: DataFrame, as_of_year: int, width: int = 3, min_recent_df: int = 15) -> DataFrame:
    """Growth of each term's document share, recent against prior window, weighted by ln(1 + recent df).

    ``analysed`` (source, year, n): documents in the domain; its complete years give the windows. A source without a
    prior window has no rows.
    """
    years = analysed.where(F.col("year") != as_of_year).withColumn("age", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("year"))))
    recent, prior = F.col("age") <= width, F.col("age").between(width + 1, 2 * width)
    span = lambda w: F.concat_ws("-", F.min(F.when(w, F.col("year"))).cast("string"), F.max(F.when(w, F.col("year"))).cast("string"))
    size = lambda w: F.coalesce(F.nullif(F.sum(F.when(w, F.col("n"))), F.lit(0)), F.lit(1))
    per_source = years.groupBy("source").agg(size(recent).alias("n_rec"), size(prior).alias("n_pri"), span(recent).alias("recent_years"), span(prior).alias("prior_years"), F.max("age").alias("oldest")).where(F.col("oldest") > width)
    both = lambda w: F.coalesce(F.sum(F.when(w, F.col("df"))), F.lit(0))
    terms = df.join(years.select("source", "year", "age"), ["source", "year"]).groupBy("source", "term").agg(both(recent).alias("recent_df"), both(prior).alias("prior_df")).where(F.col("recent_df") >= min_recent_df)
    r, p, eps = F.col("recent_df") / F.col("n_rec"), F.col("prior_df") / F.col("n_pri"), 1.0 / F.col("n_pri")
    ratio = (r + eps) / (p + eps)
    return terms.join(per_source, "source").select(
        "source", "term", "recent_df", "prior_df", (100 * r).alias("recent_share_pct"), (100 * p).alias("prior_share_pct"), ratio.alias("growth_ratio"), (F.ln(ratio) * F.log1p("recent_df")).alias("score"), "recent_years", "prior_years"
    )


def _greedy(top: int, overlap: float):
    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        """The rows already ``held``, and what of the others, all behind them, stays beside them."""
        rows = rows.sort_values(["held", "score", "term"], ascending=[False, False, True])
        kept: list[tuple[str, int]] = []
        taken = []
        for i, (held, term, df) in enumerate(zip(rows["held"], rows["term"], rows["recent_df"])):
            if held or len(kept) < top and not any(term in longer and n >= overlap * df for longer, n in kept):
                kept.append((term, df))
                taken.append(i)
        return rows.iloc[taken].drop(columns="held")

    return keep


def without_contained(scores: DataFrame, top: int = 80, overlap: float = 0.7, block: int = 2048) -> DataFrame:
    """The best ``top`` terms of each source; a term inside a better one of ``overlap`` times its frequency goes.

    A task gets the next ``block`` terms of a source by rank and the at most ``top`` kept before. Whether a term stays depends
    on the kept terms before it alone, and once ``top`` are kept none behind can join them; so reading by falling rank in
    blocks gives what one reading of all terms gives, and terms below the last block read change nothing. Another block is
    read only for sources with fewer than ``top`` kept and terms left, mostly for none.
    """
    scores = scores.persist()
    order = Window.partitionBy("source").orderBy(F.desc("score"), "term")
    kept, rest = scores.limit(0), scores
    while True:
        ranked = rest.withColumn("place", F.row_number().over(order)).where(F.col("place") <= block)
        both = ranked.drop("place").withColumn("held", F.lit(False)).unionByName(kept.withColumn("held", F.lit(True)))
        kept = both.groupBy("source").applyInPandas(_greedy(top, overlap), scores.schema).persist()
        full = kept.groupBy("source").agg(F.count("*").alias("n")).where(F.col("n") >= top).select("source")
        ends = ranked.where(F.col("place") == block).select("source", F.struct((-F.col("score")).alias("s"), F.col("term").alias("t")).alias("last"))
        more = ends.join(full, "source", "left_anti").collect()  # a row a source that goes on
        if not more:
            return kept
        behind = F.struct((-F.col("score")).alias("s"), F.col("term").alias("t")) > F.col("last")
        rest = scores.join(scores.sparkSession.createDataFrame(more, ends.schema), "source").where(behind).select(scores.columns)


def with_coverage(terms: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """covered_by: the concepts that the taxonomy finds in the term itself, comma-joined. N-grams are ASCII without entities."""
    return terms.withColumn("covered_by", F.array_join(F.array_sort(concepts_of(normalise_ascii(F.col("term")), taxonomy)), ","))
