"""Mixing sources to target weights, by DataFrame functions alone.

A source of n tokens gets a weight in proportion to n**t. The exponent t in [0, 1] is the smallest for which no source
is read more than ``repeats`` times and, if ``entropy`` is given, the largest for which the weights' entropy reaches
that share of its maximum. It is found by bisection in sections of 64: each round evaluates the conditions for 65
exponents in one aggregation over the sources and keeps the section where they change; after 6 rounds it is known to
1e-10, so that a source at its limit gets whole readings.

Without a ``budget`` in tokens, it is the smallest at which every document is used: the source with the least weight per
token is read once. With one, a source gets its weight's share of the budget, which may be less than one reading; a
budget above ``repeats`` times all tokens is cut to that. A source is read in whole epochs and a last part. Documents are dealt by hash to ``blocks`` blocks of their source; each
epoch has its own permutation of the blocks, and the last part goes through whole blocks in that order and takes each
that still fits the source's remaining budget. So a hot source is many blocks, and per source at most ``blocks`` rows are ever ordered.

Tokens are words without ASCII white space. A null source counts as the source named by the empty string. Sources
without tokens are read once, and a block without tokens is never part of a last part. Null doc_ids are dealt by their texts. Repeated rows are documents of their own, read
alike. Columns of ``docs`` pass through whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import bounded_batches, stored

#: A plan of at most so many rows (of some 50 bytes) is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 100_000


def conditions(sources: DataFrame, exponents: list[float], budget: float | None = None) -> dict[float, tuple[float, float]]:
    """exponent -> (entropy as a share of its maximum, most readings of a source); without a budget the largest source is read once."""
    n, t = F.col("tokens").cast("double"), F.col("t")
    rows = (
        sources.where("tokens > 0")
        .select("tokens", F.explode(F.array(*map(F.lit, exponents))).alias("t"))
        .groupBy("t")
        .agg(F.sum(F.pow(n, t)).alias("s"), F.sum(F.pow(n, t) * F.ln(n)).alias("l"), F.count("*").alias("k"), F.min(n).alias("low"), F.max(n).alias("high"))
        .collect()  # a row for each exponent
    )
    out = {}
    for r in rows:
        h = math.log(r.s) - r.t * r.l / r.s
        most = (r.high / r.low) ** (1 - r.t) if budget is None else budget * r.low ** (r.t - 1) / r.s
        out[r.t] = (h / math.log(r.k) if r.k > 1 else 1.0, most)
    return out


def _bisect(sources: DataFrame, holds, low_side: bool, budget: float | None = None, rounds: int = 6, sections: int = 64) -> float:
    """The end of the exponents for which ``holds`` (true below the end if ``low_side``, else above it)."""
    a, b = 0.0, 1.0
    for _ in range(rounds):
        grid = [a + (b - a) * i / sections for i in range(sections + 1)]
        found = conditions(sources, grid, budget)
        good = [t for t in grid if holds(*found[t])] if found else grid
        if not good:
            return b if not low_side else a
        if low_side:
            t = max(good)
            a, b = t, min(b, t + (b - a) / sections)
        else:
            t = min(good)
            a, b = max(a, t - (b - a) / sections), t
    return a if low_side else b


def exponent(sources: DataFrame, repeats: float, entropy: float | None, budget: float | None = None) -> float:
    t = _bisect(sources, lambda h, r: r <= repeats * (1 + 1e-12), low_side=False, budget=budget)
    return max(t, _bisect(sources, lambda h, r: h >= entropy, low_side=True)) if entropy is not None else t


def planned(docs: DataFrame, repeats: float, entropy: float | None, budget: float | None, blocks: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(row, mix_source, mix_block and mix_tokens of each document; readings of each block as mix_copies, one at least)."""
    text = docs["text"].cast("string")
    tokens = F.coalesce(F.regexp_count(text, F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")
    place = F.xxhash64(F.lit(seed), F.coalesce(docs["doc_id"].cast("long"), F.xxhash64(text)))
    dealt = docs.select(F.struct("*").alias("row"), F.coalesce(docs["source"].cast("string"), F.lit("")).alias("mix_source"), F.pmod(place, F.lit(blocks)).cast("int").alias("mix_block"), tokens.alias("mix_tokens"))
    per_block = stored(dealt.groupBy("mix_source", "mix_block").agg(F.sum("mix_tokens").alias("tokens")), "blocks")
    sources = stored(per_block.groupBy("mix_source").agg(F.sum("tokens").alias("tokens")), "sources")
    top = sources.agg(F.max("tokens").alias("high"), F.sum("tokens").alias("every")).first()
    budget = None if budget is None else min(float(budget), repeats * (top.every or 0))
    t = exponent(sources, repeats, entropy, budget)
    n = F.col("tokens").cast("double")
    if budget is None:
        each = F.pow(F.lit(float(top.high or 1)) / n, F.lit(1 - t))
    else:
        whole = sources.where("tokens > 0").agg(F.sum(F.pow(n, F.lit(t))).alias("s")).first().s or 1.0
        each = F.pow(n, F.lit(t - 1)) * (budget / whole)
    ratio = F.when(F.col("tokens") > 0, each).otherwise(1.0)
    target = sources.select("mix_source", F.floor(ratio + 1e-7).cast("int").alias("whole"), ((ratio - F.floor(ratio + 1e-7)) * n).alias("rest"))
    # at most ``blocks`` rows a source
    order = F.xxhash64(F.lit(seed), "mix_source", "whole", "mix_block")
    plan = per_block.join(target, "mix_source").groupBy("mix_source", "whole", "rest").agg(F.array_sort(F.collect_list(F.struct(order.alias("place"), "mix_block", "tokens"))).alias("blocks"))

    def take(acc: Column, x: Column) -> Column:
        fits = (x["tokens"] > 0) & (acc["used"] + x["tokens"] <= F.col("rest"))
        row = F.struct(x["mix_block"].alias("mix_block"), (F.col("whole") + fits.cast("int")).alias("mix_copies"))
        return F.struct((acc["used"] + F.when(fits, x["tokens"]).otherwise(F.lit(0))).cast("long").alias("used"), F.concat(acc["out"], F.array(row)).alias("out"))

    none = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<mix_block:int,mix_copies:int>>").alias("out"))
    plan = plan.select("mix_source", F.explode(F.aggregate("blocks", none, take, lambda acc: acc["out"])).alias("x"))
    return dealt, stored(plan.select("mix_source", "x.mix_block", "x.mix_copies").where("mix_copies > 0"), "plan")


def readings(docs: DataFrame, repeats: float = 2.0, entropy: float | None = None, budget: float | None = None, blocks: int = 256, seed: int = 11) -> DataFrame:
    """row (all columns of ``docs``), mix_source, mix_block, mix_tokens and mix_epoch of each reading; epochs count from 0."""
    bounded_batches(docs.sparkSession)
    dealt, plan = planned(docs, repeats, entropy, budget, blocks, seed)
    side = F.broadcast(plan) if plan.count() <= BROADCAST_ROWS else plan
    return dealt.join(side, ["mix_source", "mix_block"]).withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), F.col("mix_copies") - 1))).drop("mix_copies")


def mixed(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` with each row as often as it is read."""
    return readings(docs, **parameters).select("row.*")


def mix_report(docs: DataFrame, seed: int = 11, **parameters) -> DataFrame:
    """doc_id, source, epoch, block, place (the block's key in its epoch's permutation) and tokens of each reading."""
    out = readings(docs.select("doc_id", "source", "text"), seed=seed, **parameters)
    place = F.xxhash64(F.lit(seed), "mix_source", "mix_epoch", "mix_block")
    return out.select("row.doc_id", F.col("mix_source").alias("source"), F.col("mix_epoch").alias("epoch"), F.col("mix_block").alias("block"), place.alias("place"), F.col("mix_tokens").alias("tokens"))
