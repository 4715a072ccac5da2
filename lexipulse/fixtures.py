"""The driver's tables seen as dated documents, with small taxonomies that match them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .taxonomy import Taxonomy, from_dict, linear_presence

AS_OF_LINES, AS_OF_DOCS = 2001, 2026

PARTS: Taxonomy = from_dict({
    "domain_terms": ["hot", "cold", "new", "old", "red", "small"],
    "categories": {
        "shape": {
            "GEAR": {"label": "Gears", "synonyms": ["gear"]},
            "WIDGET": {"label": "Widgets", "synonyms": ["widget", "gizmo"]},
            "ROUND": {"label": "Round parts", "synonyms": ["ring", "rod"]},
            "FLAT": {"label": "Flat parts", "synonyms": ["plate", "bolt"]},
        },
        "finish": {
            "HOT": {"label": "Hot parts", "synonyms": ["hot-ring", "hot rods", "hot"], "exclude": "gizmo"},
            "COLD": {"label": "Cold parts", "synonyms": ["cold"], "exclude": "anvil"},
            "AGED": {"label": "Aged gears", "synonyms": ["old", "new"], "require": "gear"},
            "NONE": {"label": "Never there", "synonyms": ["unobtainium"]},
        },
    },
})

PROSE: Taxonomy = from_dict({
    "domain_terms": ["the", "die", "la", "le"],
    "categories": {
        "licence": {"MIT": {"label": "MIT", "synonyms": ["MIT"]}, "GNU": {"label": "GNU", "synonyms": ["GNU", "GPL"]}},
        "word": {"THAT": {"label": "that", "synonyms": ["that", "this"]}, "WITH": {"label": "with", "synonyms": ["with"], "exclude": "from"}, "UND": {"label": "und", "synonyms": ["und"], "require": "der"}},
    },
})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("text"))


def line_docs(spark: SparkSession, sf_dir: str, part: DataFrame | None = None) -> DataFrame:
    """Order lines as documents: the part's name is the text, the return flag the source, the ship year the year.

    Further columns of ``part`` come along: what depends on the text alone is best found once a part.
    """
    part = part if part is not None else part_texts(spark, sf_dir)
    line = table(spark, sf_dir, "lineitem")
    return line.join(part, line["l_partkey"] == part["p_partkey"]).select(
        F.col("l_returnflag").alias("source"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"), F.year("l_shipdate").alias("year"),
        "text", F.col("text").alias("title"), F.lit("").alias("url"), F.col("l_quantity").cast("long").alias("cited"), (F.col("l_linestatus") == "F").alias("has_abstract"),
        F.col("l_extendedprice").alias("price"), F.col("l_linenumber").cast("int").alias("line"), *(c for c in part.columns if c not in ("p_partkey", "text")),
    )


DL = """dl AS (SELECT l_returnflag AS source, concat(CAST(l_orderkey AS VARCHAR), '-', CAST(l_linenumber AS VARCHAR)) AS id, CAST(year(l_shipdate) AS INTEGER) AS year,
 p_name AS text, CAST(l_quantity AS BIGINT) AS cited, l_linestatus = 'F' AS has_abstract, l_extendedprice AS price, CAST(l_linenumber AS INTEGER) AS line
 FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def prose_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, spread over years by id; every document has the tags all and its language."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.col("doc_id").cast("string").alias("id"), (2014 + F.col("doc_id") % 13).cast("int").alias("year"), "text", F.array(F.lit("all"), F.col("lang")).alias("sources"), F.col("n_chars").alias("cited"))


DD = "dd AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, CAST(2014 + doc_id % 13 AS INTEGER) AS year, text, ['all', lang] AS sources, n_chars AS cited FROM documents)"


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_flag(taxonomy: Taxonomy, key: str) -> str:
    """Presence of a concept in DuckDB, whose patterns have no look-around."""
    c = taxonomy.by_key[key]
    out = f"regexp_matches(text, {sql_text(linear_presence(list(c.synonyms)))})"
    if c.exclude:
        out += f" AND NOT regexp_matches(text, {sql_text(linear_presence([c.exclude]))})"
    if c.require:
        out += f" AND regexp_matches(text, {sql_text(linear_presence([c.require]))})"
    return out


def sql_domain(taxonomy: Taxonomy) -> str:
    return f"regexp_matches(text, {sql_text(linear_presence(list(taxonomy.domain_terms)))})"


def sql_hits(taxonomy: Taxonomy, source: str = "m", gated: bool = True) -> str:
    """The rows of ``source`` with concept, one for each concept of the document."""
    where = "in_domain AND " if gated else ""
    return "hits AS (" + " UNION ALL ".join(f"SELECT *, {sql_text(k)} AS concept FROM {source} WHERE {where}{sql_flag(taxonomy, k)}" for k in taxonomy.keys) + ")"


def sql_dim(taxonomy: Taxonomy) -> str:
    return "dim(category, concept, label) AS (VALUES " + ", ".join(f"({sql_text(c.category)}, {sql_text(c.key)}, {sql_text(c.label)})" for c in taxonomy.concepts) + ")"


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)
