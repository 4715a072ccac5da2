"""The analyses: plain sources, and two pools with sampled denominators.

``matched`` is the one expensive table; it is persisted once and all trend tables share it.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.textnorm import normalise
from ..operators import emerging as em
from ..operators import match, measures
from ..schema import citations, full_text, has_abstract
from ..sources import jsonl
from ..taxonomy import Taxonomy


def prepared(docs: DataFrame) -> DataFrame:
    """Documents with text (normalised), has_abstract, cited and sources (their tags)."""
    return docs.select(
        "source", "id", "title", "year", "url", normalise(full_text(F.col("title"), F.col("abstract"))).alias("text"), has_abstract(F.col("abstract")).alias("has_abstract"),
        citations(F.col("extra")).alias("cited"), F.coalesce("extra.sources", F.array("source")).alias("sources"), F.col("extra.retrieved_for").alias("retrieved_for"), *(c for c in ("file_rank", "line_key") if c in docs.columns),
    )


def order_of(docs: DataFrame) -> list:
    return [F.col(c) for c in ("file_rank", "line_key", "title", "url") if c in docs.columns]


#: table -> columns it is written in order of, with * before falling ones
ORDER = {
    "totals": ("source", "year"), "concept_year": ("source", "category", "concept", "year"), "synonym_year": ("source", "concept", "year", "*docs", "synonym"),
    "growth": ("source", "*growth_ratio", "concept"), "cooccurrence": ("source", "*docs_both", "concept_a", "concept_b"), "examples": ("source", "concept", "rank"), "emerging": ("source", "*score", "term"),
}


def in_order(df: DataFrame, name: str) -> DataFrame:
    """A result table in the order of its kind."""
    out = df.orderBy(*(F.desc(c[1:]) if c[0] == "*" else F.asc(c) for c in ORDER[name]))
    return out.drop("rank") if name == "examples" else out


def write_ordered(df: DataFrame, name: str, path: str) -> None:
    """A result table as one CSV file with a header, in the order of its kind."""
    in_order(df, name).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_matches(matched: DataFrame, folder: str, *more: str) -> None:
    """The documents with a concept, by source and year as Parquet, by source as JSON with a map of synonyms."""
    found = matched.where(F.size("concepts") > 0).select("source", "year", "id", "hits", "cited", "title", "url", *(c for c in more if c in matched.columns))
    found.write.mode("overwrite").partitionBy("source", "year").parquet(f"{folder}/matches.parquet")
    found.withColumn("concepts", match.hit_map(F.col("hits"))).drop("hits").write.mode("overwrite").partitionBy("source").json(f"{folder}/matches.json")


@dataclass
class Result:
    matched: DataFrame
    totals: DataFrame
    concept_year: DataFrame
    synonym_year: DataFrame
    growth: DataFrame
    cooccurrence: DataFrame
    examples: DataFrame
    emerging: DataFrame
    two_pool: bool
    as_of_year: int
    recent_window: int

    def summary(self) -> DataFrame:
        return measures.summary(self.totals, self.two_pool).withColumns({"partial_year": F.lit(self.as_of_year), "recent_window": F.lit(self.recent_window), "mode": F.lit("two-pool" if self.two_pool else "plain")})

    def write(self, folder: str) -> None:
        """Each table as Parquet and as one CSV file, the matches by source and year as Parquet and JSON, and summary.json."""
        for name in ORDER:
            getattr(self, name).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
            write_ordered(getattr(self, name), name, f"{folder}/{name}.csv")
        write_matches(self.matched, folder, *(["sources", "retrieved_for"] if self.two_pool else []))
        jsonl.write_text(self.matched.sparkSession, f"{folder}/summary.json", json.dumps(self.summary().first().asDict(), indent=2))


def _matched(docs: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    return match.matched(docs, taxonomy).persist(StorageLevel.MEMORY_AND_DISK)


def kept_ngrams(docs: DataFrame, min_df: int, keep: str, *parts: object) -> DataFrame:
    """``ngram_df`` of ``docs``, kept in ``keep`` by source and year.

    A source-year is known by the number of its documents and two sums over hashes of their ids and texts, and by whatever
    ``parts`` the documents were chosen by. Only source-years that are not there yet are counted.
    """
    spark, own = docs.sparkSession, ("id", "text")
    marked = docs.groupBy("source", "year").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*own)).alias("x"), F.sum(F.pmod(F.xxhash64(*own, F.lit(1)), F.lit(1 << 31))).alias("s"))
    marks = {hashlib.sha256(repr((min_df, parts, tuple(r))).encode()).hexdigest()[:20]: (r.source, r.year) for r in marked.collect()}  # a row a source-year

    def counted(missing: list[str]) -> DataFrame:
        # a row a source-year, sent to all tasks: dealing the texts out by it would put each source-year into one task
        of = F.broadcast(spark.createDataFrame([(*marks[m], m) for m in missing], "source string, year int, mark string"))
        return em.ngram_df(docs.join(F.broadcast(of.select("source", "year")), ["source", "year"], "left_semi"), min_df).join(of, ["source", "year"])

    schema = em.ngram_df(docs.limit(0), min_df, cells=0).withColumn("mark", F.lit("")).schema
    return jsonl.kept_parts(spark, f"{keep}/ngrams", sorted(marks), schema, counted).drop("mark")


def _emerging(docs: DataFrame, counts: DataFrame, taxonomy: Taxonomy, as_of_year: int, width: int, min_df: int, keep: str | None = None) -> DataFrame:
    inside = docs.where("in_domain")  # the domain gate feeds the counts, so its terms are part of their key
    df = kept_ngrams(inside, min_df, keep, taxonomy.domain_terms) if keep else em.ngram_df(inside, min_df)
    scores = em.burst_scores(df, counts.select("source", "year", F.col("in_domain_analysed").alias("n")), as_of_year, width)
    return em.with_coverage(em.without_contained(scores), taxonomy)


def plain(docs: DataFrame, taxonomy: Taxonomy, as_of_year: int, recent_window: int = 3, meta: DataFrame | None = None, min_df: int = 5, keep: str | None = None) -> Result:
    """Every document of each source-year is there; with more than one source, ``all`` sums them up."""
    m = _matched(measures.first_wins(prepared(docs), *order_of(docs), by=("source", "year", "id")), taxonomy)
    counts = measures.year_counts(m)
    total = measures.totals(counts, as_of_year, meta)
    cy = measures.concept_year(measures.concept_counts(m), total, taxonomy)
    examples, synonyms = measures.examples(m, as_of_year), measures.synonym_year(m)
    pairs = measures.cooccurrence(m, cy, total)
    terms = _emerging(m, counts, taxonomy, as_of_year, recent_window, min_df, keep)
    if total.select("source").distinct().limit(2).count() > 1:
        cy, total = measures.with_all_sources(cy, total)
    return Result(m, total, cy, synonyms, measures.growth(cy, as_of_year, recent_window), pairs, examples, terms, False, as_of_year, recent_window)


def two_pool(sample: DataFrame, pool: DataFrame, taxonomy: Taxonomy, year_meta: DataFrame, cut: DataFrame, as_of_year: int, tags: tuple[str, ...] = ("all", "ieee", "arxiv"), ngram_tags: tuple[str, ...] = ("all", "ieee"), recent_window: int = 3, min_df: int = 5, pairs: str = "all", keep: str | None = None) -> Result:
    """A sample gives denominators, pools by concept give numerators, weighted where a query was cut short.

    A pool document counts for a concept only if that concept's query returned it; with ``pairs="all"`` pairs count all
    concepts it matches, with ``"gated"`` only those. Years are those of ``year_meta``.
    """
    if pairs not in ("all", "gated"):
        raise ValueError(pairs)
    s = match.with_matches(measures.first_wins(prepared(sample), *order_of(sample)).join(year_meta.select("year"), "year", "left_semi"), taxonomy).persist(StorageLevel.MEMORY_AND_DISK)
    total = measures.sampled_totals(s, list(tags), year_meta, as_of_year)
    one = measures.merged_retrieval(prepared(pool), *order_of(pool)).join(year_meta.select("year"), "year", "left_semi")
    own = _matched(one, taxonomy).drop("source")
    m = own.withColumn("source", F.explode("sources")).where(F.col("source").isin(*tags))
    gate = "retrieved_for"
    cy = measures.concept_year(measures.concept_counts(m, cut, gate), total, taxonomy, weighted=True)
    both = measures.cooccurrence(m, cy, total, gate if pairs == "gated" else None)
    tagged = measures.by_tag(s.drop("source")).where(F.col("source").isin(*ngram_tags))
    terms = _emerging(tagged, measures.year_counts(tagged), taxonomy, as_of_year, recent_window, min_df, keep)
    return Result(m, total, cy, measures.synonym_year(m, gate), measures.growth(cy, as_of_year, recent_window), both, measures.examples(m, as_of_year, gate=gate), terms, True, as_of_year, recent_window)
