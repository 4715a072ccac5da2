"""Trend tables over matched documents.

``matched`` has source, year, id, in_domain, concepts (array) and, where a table needs them, hits, has_abstract, cited,
title, url. A document counts once for each row it has, so multi-tag documents are exploded to one row a tag before.
Everything is keyed by source, year and concept; dimensions (sources x years, concepts) are small and made by
aggregation, and AQE broadcasts them where their size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..taxonomy import Taxonomy
from .match import long_hits, pairs_of

NAN = float("nan")


def first_wins(docs: DataFrame, *order: Column, by: tuple[str, ...] = ("year", "id")) -> DataFrame:
    """One row a key: the first in the given order."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return docs.withColumn("first_rank", rank).where("first_rank = 1").drop("first_rank")


def merged_retrieval(docs: DataFrame, *order: Column, by: tuple[str, ...] = ("year", "id"), column: str = "retrieved_for") -> DataFrame:
    """First row a key, with the sorted set of all rows' ``column``; nulls and empty keys are left out."""
    every = F.array_sort(F.array_remove(F.collect_set(column).over(Window.partitionBy(*by)), ""))
    return first_wins(docs.withColumn("merged", every), *order, by=by).drop(column).withColumnRenamed("merged", column)


def by_tag(docs: DataFrame, tags: str = "sources") -> DataFrame:
    """A row for each tag of a document, under ``source``."""
    return docs.withColumn("source", F.explode(tags)).drop(tags) if tags != "source" else docs.withColumn("source", F.explode("source"))


def year_counts(matched: DataFrame) -> DataFrame:
    """source, year, analysed, in_domain_analysed, abstract_rate."""
    return matched.groupBy("source", "year").agg(
        F.count("*").alias("analysed"),
        F.count_if("in_domain").alias("in_domain_analysed"),
        F.avg(F.col("has_abstract").cast("double")).alias("abstract_rate"),
    )


def totals(counts: DataFrame, as_of_year: int, meta: DataFrame | None = None) -> DataFrame:
    """Plain totals: the denominator is what was analysed in the domain; ``meta`` (source, year, total) scales it."""
    base = counts.join(meta.select("source", "year", "total"), ["source", "year"], "left") if meta is not None else counts.withColumn("total", F.lit(None).cast("long"))
    return _totals(base.withColumn("in_domain", F.col("in_domain_analysed").cast("double")).withColumn("source_total", F.coalesce("total", "analysed").cast("double")), as_of_year)


def sampled_totals(sample: DataFrame, tags: list[str], year_meta: DataFrame, as_of_year: int, tag_column: str = "sources") -> DataFrame:
    """Totals of a sampled corpus: a year's domain_total times the share of the sample with the tag (and in the domain).

    ``year_meta`` (year, domain_total) decides which years there are; a tag without documents has zero totals.
    """
    whole = sample.join(year_meta.select("year"), "year", "left_semi").groupBy("year").agg(F.count("*").alias("sample_n"))
    tag = sample.withColumn("source", F.explode(F.array_distinct(tag_column))).where(F.col("source").isin(tags))
    years = year_meta.select("year", "domain_total", F.explode(F.array(*map(F.lit, tags))).alias("source"))
    base = years.join(whole, "year", "left").join(year_counts(tag), ["source", "year"], "left").fillna(0, ["sample_n", "analysed", "in_domain_analysed"])
    part = lambda c: F.when(F.col("sample_n") > 0, F.col("domain_total") * F.col(c) / F.col("sample_n")).otherwise(0.0)
    return _totals(base.withColumn("in_domain", part("in_domain_analysed")).withColumn("source_total", part("analysed")), as_of_year)


def _totals(base: DataFrame, as_of_year: int) -> DataFrame:
    return base.select(
        "source", "year", F.col("analysed").alias("fetched"), "in_domain", "in_domain_analysed", "source_total",
        F.when(F.col("analysed") > 0, F.col("source_total") / F.col("analysed")).otherwise(1.0).alias("scale"),
        F.coalesce("abstract_rate", F.lit(NAN)).alias("abstract_rate"), (F.col("year") == as_of_year).alias("partial_year"),
    )


def concept_counts(matched: DataFrame, weights: DataFrame | None = None, gate: str | None = None) -> DataFrame:
    """source, year, concept, docs (weighted), docs_raw.

    ``weights`` (concept, year, total, fetched) counts a document total / fetched times where that was cut short.
    ``gate`` names an array column of concepts a document may count for.
    """
    keys = F.array_intersect("concepts", gate) if gate else F.col("concepts")
    one = matched.where(F.size("concepts") > 0).select("source", "year", F.explode(keys).alias("concept")).groupBy("source", "year", "concept").agg(F.count("*").alias("docs_raw"))
    if weights is None:
        return one.withColumn("docs", F.col("docs_raw").cast("double"))
    weight = F.when((F.col("fetched") > 0) & (F.col("total") > F.col("fetched")), F.col("total") / F.col("fetched")).otherwise(1.0)
    return one.join(weights.select("concept", "year", "total", "fetched"), ["concept", "year"], "left").withColumn("docs", F.col("docs_raw") * F.coalesce(weight, F.lit(1.0))).drop("total", "fetched")


def concept_year(counts: DataFrame, total: DataFrame, taxonomy: Taxonomy, weighted: bool = False) -> DataFrame:
    """Every concept for every source-year, zero where nothing matched; counts are rounded half to even."""
    concepts = F.array(*(F.struct(F.lit(c.category).alias("category"), F.lit(c.key).alias("concept"), F.lit(c.label).alias("label")) for c in taxonomy.concepts))
    grid = total.withColumn("c", F.explode(concepts)).select("source", "year", "partial_year", "scale", F.col("in_domain").alias("in_domain_total"), "c.category", "c.concept", "c.label")
    full = grid.join(counts, ["source", "year", "concept"], "left").fillna(0, ["docs", "docs_raw"])
    n = F.col("docs")
    return full.select(
        "source", "category", "concept", "label", "year", F.bround(n, 2).alias("docs"), F.col("docs_raw").cast("long").alias("docs_raw"), "in_domain_total",
        F.when(F.col("in_domain_total") > 0, 100.0 * n / F.col("in_domain_total")).otherwise(0.0).alias("share_pct"),
        F.bround(n * (1.0 if weighted else F.col("scale")), 1).alias("est_docs"), "partial_year",
    )


def with_all_sources(concept: DataFrame, total: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with the sums over all sources as source ``all``: shares anew, scale 1, no abstract rate."""
    cy = concept.groupBy("category", "concept", "label", "year", "partial_year").agg(*(F.sum(c).alias(c) for c in ("docs", "docs_raw", "in_domain_total", "est_docs")))
    cy = cy.withColumn("source", F.lit("all")).withColumn("share_pct", F.when(F.col("in_domain_total") > 0, 100.0 * F.col("docs") / F.col("in_domain_total")).otherwise(0.0))
    t = total.groupBy("year", "partial_year").agg(*(F.sum(c).alias(c) for c in ("fetched", "in_domain", "in_domain_analysed", "source_total")))
    t = t.withColumns({"source": F.lit("all"), "scale": F.lit(1.0), "abstract_rate": F.lit(NAN)})
    return concept.unionByName(cy.select(concept.columns)), total.unionByName(t.select(total.columns))


def synonym_year(with_hits: DataFrame, gate: str | None = None) -> DataFrame:
    """Documents (not occurrences) for each source, concept, synonym and year."""
    keep = ("source", "year") + ((gate,) if gate else ())
    hits = long_hits(with_hits, *keep)
    if gate:
        hits = hits.where(F.array_contains(gate, F.col("concept")))
    return hits.groupBy("source", "concept", "synonym", "year").agg(F.count("*").alias("docs"))


def windows(concept: DataFrame, as_of_year: int, width: int) -> DataFrame:
    """source, year, age of the complete years present: 1 for the latest."""
    years = concept.where(F.col("year") != as_of_year).select("source", "year").distinct()
    return years.withColumn("age", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("year")))).withColumn("win", F.when(F.col("age") <= width, "recent").when(F.col("age") <= 2 * width, "prior"))


def growth(concept: DataFrame, as_of_year: int, width: int = 3) -> DataFrame:
    """Recent against prior window for each source and concept, with slope, first and peak year."""
    win = windows(concept, as_of_year, width)
    span = lambda w: F.concat_ws("-", F.min(F.when(F.col("win") == w, F.col("year"))).cast("string"), F.max(F.when(F.col("win") == w, F.col("year"))).cast("string"))
    spans = win.groupBy("source").agg(span("recent").alias("recent_years"), span("prior").alias("prior_years"))
    rows = concept.join(win, ["source", "year"], "left")
    inside = lambda w, c: F.coalesce(F.sum(F.when(F.col("win") == w, F.col(c))), F.lit(0.0))
    complete = F.col("age").isNotNull()
    share, year = F.when(complete, F.col("share_pct")), F.when(complete, F.col("year"))
    agg = rows.groupBy("source", "category", "concept", "label").agg(
        F.sum("docs").alias("all_docs"), inside("recent", "docs").alias("rec"), inside("prior", "docs").alias("pri"),
        inside("recent", "in_domain_total").alias("rec_n"), inside("prior", "in_domain_total").alias("pri_n"),
        F.count(year).alias("points"), F.regr_slope(share, year.cast("double")).alias("slope"),
        F.min(F.when(complete & (F.col("docs_raw") >= 3), F.col("year"))).alias("first_year_ge3"),
        F.max(share).alias("top"), F.max_by(F.col("year"), F.when(complete, F.struct("share_pct", -F.col("year")))).alias("peak"),
    )
    recent, prior = 100.0 * F.col("rec") / F.greatest(F.col("rec_n"), F.lit(1.0)), 100.0 * F.col("pri") / F.greatest(F.col("pri_n"), F.lit(1.0))
    eps = 100.0 / F.greatest(F.col("pri_n"), F.lit(1.0))
    whole = lambda c: F.bround(c, 0).cast("long")
    return agg.join(spans, "source", "left").select(
        "source", "category", "concept", "label", whole("all_docs").alias("docs_total"), whole("rec").alias("docs_recent"), whole("pri").alias("docs_prior"),
        recent.alias("share_recent_pct"), prior.alias("share_prior_pct"), ((recent + eps) / (prior + eps)).alias("growth_ratio"), (recent - prior).alias("delta_pp"),
        F.when(F.col("points") >= 3, F.col("slope")).otherwise(NAN).alias("slope_pp_per_year"), "first_year_ge3", F.when(F.col("top") > 0, F.col("peak")).alias("peak_year"),
        F.coalesce("recent_years", F.lit("")).alias("recent_years"), F.coalesce("prior_years", F.lit("")).alias("prior_years"),
    )


def cooccurrence(matched: DataFrame, concept: DataFrame, total: DataFrame, gate: str | None = None) -> DataFrame:
    """Concept pairs of documents with lift and Jaccard. Pairs take all concepts of a document unless ``gate`` is given."""
    keys = F.array_intersect("concepts", gate) if gate else F.col("concepts")
    pair = matched.where(F.size("concepts") > 1).select("source", F.explode(pairs_of(keys)).alias("p")).groupBy("source", F.col("p.a").alias("concept_a"), F.col("p.b").alias("concept_b")).agg(F.count("*").alias("docs_both"))
    n = concept.groupBy("source", "concept").agg(F.sum("docs_raw").alias("n"))
    dom = total.groupBy("source").agg(F.sum("in_domain").alias("in_domain"))
    out = pair.join(n.select("source", F.col("concept").alias("concept_a"), F.col("n").alias("docs_a")), ["source", "concept_a"]).join(n.select("source", F.col("concept").alias("concept_b"), F.col("n").alias("docs_b")), ["source", "concept_b"]).join(dom, "source")
    both, a, b = F.col("docs_both"), F.col("docs_a"), F.col("docs_b")
    return out.select("source", "concept_a", "concept_b", "docs_both", "docs_a", "docs_b", "in_domain", (both * F.col("in_domain") / F.greatest(a * b, F.lit(1))).alias("lift"), (both / F.greatest(a + b - both, F.lit(1))).alias("jaccard"))


def examples(matched: DataFrame, as_of_year: int, k: int = 3, gate: str | None = None) -> DataFrame:
    """The k most cited recent documents of each source and concept, one row an id."""
    keys = F.array_intersect("concepts", gate) if gate else F.col("concepts")
    rows = matched.where((F.size("concepts") > 0) & (F.col("year") >= as_of_year - 3)).select("source", "year", "id", "title", "url", "cited", F.explode(keys).alias("concept"))
    order = [F.desc(c) for c in ("cited", "year", "id", "title", "url")]
    best = rows.groupBy("source", "concept", "id").agg(F.max(F.struct("cited", "year", "title", "url")).alias("b")).select("source", "concept", "b.year", "id", "b.title", "b.url", "b.cited")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("source", "concept").orderBy(*order))).where(F.col("rank") <= k)


def summary(total: DataFrame, two_pool: bool = False) -> DataFrame:
    """docs_analysed, docs_in_domain_analysed, corpus_in_domain_est, years: one row over the base source (or sources)."""
    base = (F.col("source") == "all") if two_pool else (F.col("source") != "all")
    part = lambda c: F.coalesce(F.sum(F.when(base, F.col(c))), F.lit(0))
    return total.agg(
        part("fetched").cast("long").alias("docs_analysed"), part("in_domain_analysed").cast("long").alias("docs_in_domain_analysed"),
        part("in_domain").cast("double").alias("corpus_in_domain_est"), F.array_sort(F.collect_set("year")).alias("years"),
    )
