"""The queries behind a report, over result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def head_per_source(table: DataFrame, n: int, *order) -> DataFrame:
    return table.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(*order))).where(F.col("rank") <= n)


def kpis(total: DataFrame, concept: DataFrame) -> DataFrame:
    """source, in_domain, concept_docs: documents in the domain and concept hits of each source."""
    hits = concept.groupBy("source").agg(F.sum("docs_raw").alias("concept_docs"))
    return total.groupBy("source").agg(F.sum("in_domain").alias("in_domain"), F.sum("fetched").alias("fetched")).join(hits, "source", "left")


def risers_and_fallers(growth: DataFrame, source: str, risers: int = 5, fallers: int = 4, least: int = 20) -> DataFrame:
    """The concepts with the most and the least growth among those with ``least`` documents in both windows together."""
    rows = growth.where((F.col("source") == source) & (F.col("docs_recent") + F.col("docs_prior") >= least))
    up = rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("growth_ratio"), "concept"))).where(F.col("rank") <= risers).withColumn("side", F.lit("up"))
    down = rows.withColumn("rank", F.row_number().over(Window.orderBy("growth_ratio", "concept"))).where(F.col("rank") <= fallers).withColumn("side", F.lit("down"))
    return up.unionByName(down).select("side", "rank", "concept", "growth_ratio")


def growth_bars(growth: DataFrame, source: str, n: int = 30, least: int = 20) -> DataFrame:
    """log2 of the ratio of the lowest n / 2 and the highest n concepts, each once."""
    rows = growth.where((F.col("source") == source) & (F.col("docs_recent") + F.col("docs_prior") >= least))
    w = Window.orderBy("growth_ratio", "concept")
    place = rows.withColumn("low", F.row_number().over(w)).withColumn("high", F.row_number().over(Window.orderBy(F.desc("growth_ratio"), F.desc("concept"))))
    return place.where((F.col("low") <= n // 2) | (F.col("high") <= n)).select("concept", F.log2(F.greatest("growth_ratio", F.lit(0.05))).alias("log2_ratio"))


def volume_by_source(total: DataFrame, sources: list[str]) -> DataFrame:
    return total.groupBy("year").pivot("source", sources).agg(F.sum("in_domain")).fillna(0.0)


def abstract_rates(total: DataFrame, sources: list[str]) -> DataFrame:
    return total.groupBy("year").pivot("source", sources).agg(F.first("abstract_rate"))


def line_table(concept: DataFrame, keys: list[str]) -> DataFrame:
    """Shares of some concepts with the volume that orders the legend and the last complete value that labels the line."""
    rows = concept.where(F.col("concept").isin(keys))
    w = Window.partitionBy("source", "concept")
    last = F.max_by("share_pct", F.when(~F.col("partial_year"), F.col("year"))).over(w)
    return rows.select("source", "concept", "year", "share_pct", "partial_year", F.sum("docs_raw").over(w).alias("volume"), last.alias("last_share"))


def labelled_lines(lines: DataFrame, n: int = 4) -> DataFrame:
    """The n concepts of largest last value in each source."""
    one = lines.groupBy("source", "concept").agg(F.first("last_share").alias("last_share"))
    return head_per_source(one, n, F.desc("last_share"), "concept")


def ruler(growth: DataFrame, source: str, last_year: int) -> DataFrame:
    """First appearance, end and peak of each concept that ever appeared."""
    return growth.where((F.col("source") == source) & F.col("first_year_ge3").isNotNull()).select("concept", F.col("first_year_ge3").alias("first_year"), F.lit(last_year).alias("end_year"), "peak_year")


def panels(concept: DataFrame) -> DataFrame:
    """Concepts with any document, by category and falling volume."""
    return concept.groupBy("category", "concept").agg(F.sum("docs_raw").alias("volume")).where("volume > 0").orderBy("category", F.desc("volume"), "concept")


def heatmap(concept: DataFrame, source: str) -> DataFrame:
    """Share of each concept and year over the concept's largest share, with the concept's volume."""
    w = Window.partitionBy("concept")
    rows = concept.where(F.col("source") == source).withColumn("top", F.max("share_pct").over(w)).withColumn("volume", F.sum("docs_raw").over(w))
    return rows.where("volume > 0").select("concept", "year", "volume", F.when(F.col("top") > 0, F.col("share_pct") / F.col("top")).otherwise(0.0).alias("level"))


def heatmap_pivot(concept: DataFrame, source: str, years: list[int]) -> DataFrame:
    return heatmap(concept, source).groupBy("concept", "volume").pivot("year", years).agg(F.first("level")).fillna(0.0)


def surface_forms(synonyms: DataFrame, concept: str, top: int = 7) -> DataFrame:
    """Yearly mix of a concept's synonyms in percent, the less frequent folded into ``other``, with the running base of a stack."""
    rows = synonyms.where(F.col("concept") == concept)
    place = rows.groupBy("synonym").agg(F.sum("docs").alias("all_docs")).withColumn("place", F.row_number().over(Window.orderBy(F.desc("all_docs"), "synonym")))
    other = F.col("place") > top
    named = rows.join(place, "synonym").select("year", F.when(other, "other").otherwise(F.col("synonym")).alias("form"), F.least("place", F.lit(top + 1)).alias("place"), "docs")
    one = named.groupBy("year", "form", "place").agg(F.sum("docs").alias("docs"))
    pct = one.withColumn("pct", 100.0 * F.col("docs") / F.sum("docs").over(Window.partitionBy("year")))
    below = Window.partitionBy("year").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return pct.withColumn("base_pct", F.coalesce(F.sum("pct").over(below), F.lit(0.0))).select("year", "form", "docs", "pct", "base_pct")


def cooccurrence_head(pairs: DataFrame, n: int = 15) -> DataFrame:
    return head_per_source(pairs, n, F.desc("docs_both"), "concept_a", "concept_b")


def emerging_head(terms: DataFrame, n: int = 40) -> DataFrame:
    return head_per_source(terms, n, F.desc("score"), "term").withColumn("uncovered", F.col("covered_by") == "")


def example_list(examples: DataFrame) -> DataFrame:
    return examples.orderBy("source", "concept", "rank")
