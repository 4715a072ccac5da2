"""Taxonomy matching.

All concepts without raw patterns, and the domain's terms, are extracted in one scan of a text (``scan``). Concepts with
raw patterns are column expressions: one look for any synonym, then which matched how often, only where one did. The veto
of ``exclude`` and the demand of ``require`` are asked only of texts where the concept was found.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import bounded_batches
from ..taxonomy import Concept, Taxonomy, pattern, presence
from . import scan


def in_domain(text: Column, taxonomy: Taxonomy) -> Column:
    return text.rlike(presence(list(taxonomy.domain_terms))) if taxonomy.domain_terms else F.lit(False)


def has_concept(text: Column, concept: Concept) -> Column:
    return text.rlike(presence(list(concept.synonyms))) & passes(text, concept)


def passes(text: Column, concept: Concept) -> Column:
    """Whether neither the veto nor the demand of a concept keeps it from a text."""
    out = F.lit(True)
    if concept.exclude:
        out = out & ~text.rlike(pattern(concept.exclude))
    if concept.require:
        out = out & text.rlike(pattern(concept.require))
    return out


def concepts_of(text: Column, taxonomy: Taxonomy) -> Column:
    """Keys of the concepts of a text, in the taxonomy's order."""
    flags = [F.when(has_concept(text, c), F.lit(c.key)) for c in taxonomy.concepts]
    return F.array_compact(F.array(*flags)) if flags else F.array().cast("array<string>")


def synonym_hits(text: Column, concept: Concept) -> Column:
    """array<struct<synonym, n>> of the concept's synonyms in the text, in list order."""
    found = [
        F.struct(F.lit(s).alias("synonym"), F.size(F.filter(F.regexp_extract_all(text, F.lit(concept.alternation), F.lit(g)), lambda x: x != "")).alias("n"))
        for s, g in zip(concept.synonyms, concept.groups)
    ]
    return F.filter(F.array(*found), lambda h: h["n"] > 0)


HIT = "struct<concept:string,synonyms:array<struct<synonym:string,n:int>>>"


def matched(docs: DataFrame, taxonomy: Taxonomy, text: str = "text", gated: bool = True) -> DataFrame:
    """``docs`` with in_domain, concepts and hits: array<struct<concept, synonyms: array<struct<synonym, n>>>>.

    Both arrays are in the taxonomy's order; ``gated`` gives documents outside the domain none.
    """
    bounded_batches(docs.sparkSession)
    plain = [c for c in taxonomy.concepts if scan.searchable(c.synonyms)]
    rest = [c for c in taxonomy.concepts if c not in plain]
    raw_terms = [t for t in taxonomy.domain_terms if not scan.searchable((t,))]
    lexicon = scan.Lexicon([tuple(t for t in taxonomy.domain_terms if t not in raw_terms), *(c.synonyms for c in plain)])
    keys, early = [c.key for c in plain], gated and not raw_terms

    @F.arrow_udf(scan.FOUND)
    def found(texts: pa.Array) -> pa.Array:
        return scan.as_found(lexicon, keys, texts, early)

    t, hits = F.col(text), F.col("found.hits")
    out = docs.withColumn("found", found.asNondeterministic()(t))  # or a filter on its result would run it again
    inside = F.col("found.inside") | t.rlike("|".join(map(pattern, raw_terms))) if raw_terms else F.col("found.inside")
    out = out.withColumn("in_domain", inside)
    if rest:
        more = [F.when(has_concept(t, c), F.struct(F.lit(c.key).alias("concept"), synonym_hits(t, c).alias("synonyms"))) for c in rest]
        both = F.concat(hits, F.array_compact(F.array(*more)))
        hits = F.array_compact(F.transform(F.array(*map(F.lit, taxonomy.keys)), lambda k: F.get(F.filter("all_hits", lambda h: h["concept"] == k), 0)))
        out = out.withColumn("all_hits", both)
    ruled = [c for c in plain if c.exclude or c.require]
    if ruled:
        has = lambda c: F.exists("found.hits", lambda h: h["concept"] == c.key)
        out = out.withColumn("ruled_out", F.array_compact(F.array(*(F.when(has(c) & ~passes(t, c), F.lit(c.key)) for c in ruled))))
        allowed = lambda h: ~F.array_contains("ruled_out", h["concept"])
        hits = F.filter(hits, allowed)
    none = F.array().cast(f"array<{HIT}>")
    out = out.withColumn("hits", F.coalesce(F.when(F.col("in_domain"), hits).otherwise(none) if gated else hits, none))
    return out.drop("found", "all_hits", "ruled_out").withColumn("concepts", F.transform("hits", lambda h: h["concept"]))


def with_matches(docs: DataFrame, taxonomy: Taxonomy, text: str = "text", gated: bool = True) -> DataFrame:
    """``docs`` with in_domain and concepts; ``gated`` gives documents outside the domain no concepts."""
    return matched(docs, taxonomy, text, gated).drop("hits")


def long_hits(hits: DataFrame, *keep: str) -> DataFrame:
    """A row for each document, concept and synonym with its occurrences n."""
    one = hits.select(*keep, F.explode("hits").alias("h")).select(*keep, F.col("h.concept").alias("concept"), F.explode("h.synonyms").alias("s"))
    return one.select(*keep, "concept", F.col("s.synonym").alias("synonym"), F.col("s.n").alias("n"))


def hit_map(hits: Column) -> Column:
    """map<concept, map<synonym, n>>."""
    return F.map_from_entries(F.transform(hits, lambda h: F.struct(h["concept"], F.map_from_entries(h["synonyms"]))))


def pairs_of(concepts: Column) -> Column:
    """All unordered pairs of a document's concepts, as structs a < b."""
    keys = F.array_sort(concepts)
    return F.flatten(F.transform(keys, lambda a, i: F.transform(F.slice(keys, i + 2, F.size(keys)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
