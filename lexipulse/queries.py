"""One query for each operator over the driver's tables, and the DuckDB SQL with the same rows.

DuckDB knows neither HTML entities nor NFKC: the SQL of full normalisation replaces the entities that the driver's tables
hold, whose other characters NFKC leaves alone; other texts are covered by the tests.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .fixtures import AS_OF_DOCS, AS_OF_LINES, DD, DL, PARTS, PROSE, line_docs, part_texts, prose_docs, r6, sql_dim, sql_domain, sql_flag, sql_hits, sql_text, table
from .functions import textnorm
from .operators import emerging, match, measures
from .plans import analysis, views
from .schema import as_docs
from .scratch import scratch
from .sources import jsonl, records
from .taxonomy import linear_presence, load_shared

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, tuple[Query, str | None]] = {}


def _query(sql: str | None = None):
    def add(f: Query) -> Query:
        _ALL[f.__name__] = (f, sql)
        return f

    return add


# --- shared parts -------------------------------------------------------------------------------

M = f"{DL}, m AS (SELECT *, {sql_domain(PARTS)} AS in_domain FROM dl)"
H = f"{M}, {sql_hits(PARTS)}"
T = f"""t AS (SELECT source, year, count(*) AS fetched, CAST(count(*) FILTER (WHERE in_domain) AS DOUBLE) AS in_domain, count(*) FILTER (WHERE in_domain) AS in_domain_analysed,
 CAST(count(*) AS DOUBLE) AS source_total, CAST(1.0 AS DOUBLE) AS scale, avg(CASE WHEN has_abstract THEN 1.0 ELSE 0.0 END) AS abstract_rate, year = {AS_OF_LINES} AS partial_year FROM m GROUP BY source, year)"""
C = f"""{sql_dim(PARTS)}, n AS (SELECT source, year, concept, count(*) AS docs_raw FROM hits GROUP BY source, year, concept),
 cy AS (SELECT t.source, category, dim.concept, label, t.year, CAST(coalesce(docs_raw, 0) AS DOUBLE) AS docs, CAST(coalesce(docs_raw, 0) AS BIGINT) AS docs_raw, t.in_domain AS in_domain_total,
 CASE WHEN t.in_domain > 0 THEN 100.0 * coalesce(docs_raw, 0) / t.in_domain ELSE 0.0 END AS share_pct, CAST(coalesce(docs_raw, 0) AS DOUBLE) AS est_docs, partial_year
 FROM t CROSS JOIN dim LEFT JOIN n ON n.source = t.source AND n.year = t.year AND n.concept = dim.concept)"""
CY = f"WITH {H}, {T}, {C}"
W = f"""y AS (SELECT source, year, row_number() OVER (PARTITION BY source ORDER BY year DESC) AS age FROM (SELECT DISTINCT source, year FROM cy WHERE year <> {AS_OF_LINES})),
 g0 AS (SELECT cy.*, age FROM cy LEFT JOIN y ON y.source = cy.source AND y.year = cy.year),
 g1 AS (SELECT source, category, concept, label, CAST(sum(docs) AS BIGINT) AS docs_total, coalesce(sum(docs) FILTER (WHERE age <= 3), 0) AS rec, coalesce(sum(docs) FILTER (WHERE age BETWEEN 4 AND 6), 0) AS pri,
 coalesce(sum(in_domain_total) FILTER (WHERE age <= 3), 0) AS rec_n, coalesce(sum(in_domain_total) FILTER (WHERE age BETWEEN 4 AND 6), 0) AS pri_n,
 regr_slope(share_pct, year) FILTER (WHERE age IS NOT NULL) AS slope, min(year) FILTER (WHERE age IS NOT NULL AND docs_raw >= 3) AS first_year_ge3,
 max(share_pct) FILTER (WHERE age IS NOT NULL) AS top FROM g0 GROUP BY source, category, concept, label),
 pk AS (SELECT source, concept, year AS peak_year FROM (SELECT source, concept, year, share_pct, row_number() OVER (PARTITION BY source, concept ORDER BY share_pct DESC, year) AS r FROM g0 WHERE age IS NOT NULL) WHERE r = 1 AND share_pct > 0),
 g2 AS (SELECT *, 100.0 * rec / greatest(rec_n, 1) AS rs, 100.0 * pri / greatest(pri_n, 1) AS ps, 100.0 / greatest(pri_n, 1) AS eps FROM g1),
 g AS (SELECT g2.source, category, g2.concept, label, docs_total, CAST(rec AS BIGINT) AS docs_recent, CAST(pri AS BIGINT) AS docs_prior, rs AS share_recent_pct, ps AS share_prior_pct,
 (rs + eps) / (ps + eps) AS growth_ratio, rs - ps AS delta_pp, slope AS slope_pp_per_year, first_year_ge3, peak_year FROM g2 LEFT JOIN pk ON pk.source = g2.source AND pk.concept = g2.concept)"""
G = f"{CY}, {W}"
P = """p AS (SELECT a.source, a.concept AS concept_a, b.concept AS concept_b, count(*) AS docs_both FROM hits a JOIN hits b ON a.rid = b.rid AND a.concept < b.concept GROUP BY a.source, a.concept, b.concept)"""
RID = DL.replace("SELECT l_returnflag", "SELECT row_number() OVER () AS rid, l_returnflag")
HR = f"{RID}, m AS (SELECT *, {sql_domain(PARTS)} AS in_domain FROM dl), {sql_hits(PARTS)}"


def matched_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_docs(spark, sf_dir, match.matched(part_texts(spark, sf_dir), PARTS))


def _totals(m: DataFrame) -> DataFrame:
    return measures.totals(measures.year_counts(m), AS_OF_LINES)


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matched, totals, concept_year) of the order lines."""
    m = matched_lines(spark, sf_dir)
    total = _totals(m)
    return m, total, measures.concept_year(measures.concept_counts(m), total, PARTS)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


# --- scans and projections ------------------------------------------------------------------------


@_query("SELECT CAST(doc_id AS VARCHAR) AS id, CAST(2014 + doc_id % 13 AS INTEGER) AS year, length(text) AS text_chars, length(trim(text)) > 0 AS has_abstract, CAST(coalesce(nullif(n_chars, 0), 0) AS BIGINT) AS cited FROM documents")
def doc_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .schema import citations, has_abstract

    d = table(spark, sf_dir, "documents")
    docs = as_docs(d, source=F.lit("documents"), id=F.col("doc_id"), abstract=F.col("text"), year=2014 + F.col("doc_id") % 13, extra_cited_by=F.col("n_chars"))
    return docs.select("id", "year", F.length("abstract").cast("long").alias("text_chars"), has_abstract(F.col("abstract")).alias("has_abstract"), citations(F.col("extra")).alias("cited"))


@_query(f"WITH {DD}, e AS (SELECT year, unnest(sources) AS source FROM dd) SELECT source, year, count(*) AS docs FROM e GROUP BY source, year")
def tag_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.by_tag(prose_docs(spark, sf_dir)).groupBy("source", "year").agg(F.count("*").alias("docs"))


@_query(f"WITH {DL} SELECT id, year, text, price FROM (SELECT *, row_number() OVER (PARTITION BY year, id ORDER BY price, text, source, cited) AS r FROM dl) WHERE r = 1")
def first_wins_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.first_wins(line_docs(spark, sf_dir), *map(F.col, ("price", "text", "source", "cited"))).select("id", "year", "text", "price")


@_query("SELECT conv_id, min(turn) AS turn, list_aggregate(list_sort(list(DISTINCT role)), 'string_agg', ',') AS roles FROM conversations GROUP BY conv_id")
def retrieved_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("retrieved_for"))
    return measures.merged_retrieval(c, F.col("turn"), by=("conv_id",)).select("conv_id", "turn", F.array_join("retrieved_for", ",").alias("roles"))


@_query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_valid(props)")
def tolerant_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("p"))
    return e.where("p is not null and p._bad is null").select("event_id", F.col("p.k").alias("k"))


@_query("SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM benchmark")
def inverted_index_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")).alias("p", "w"))
    index = b.groupBy("item_id", "w").agg(F.collect_list("p").alias("ps")).groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("m"))
    return index.select("item_id", records.inverted_index_text(F.col("m")).alias("text"))


@_query("SELECT doc_id, lang FROM documents WHERE CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 10 = 0")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.hash_sample(table(spark, sf_dir, "documents"), "doc_id", 10).select("doc_id", "lang")


@_query("""SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(year(o_orderdate) AS INTEGER) AS year, list_aggregate(CASE WHEN o_orderpriority LIKE '1-%' THEN ['all', 'ieee'] ELSE ['all'] END || CASE WHEN o_orderstatus = 'F' THEN ['arxiv'] ELSE [] END, 'string_agg', ',') AS tags,
 CASE WHEN o_orderpriority LIKE '1-%' THEN concat('https://doi.org/10.1109/', o_orderkey) WHEN o_orderstatus = 'F' THEN concat('https://arxiv.org/abs/', o_orderkey) ELSE concat('https://www.semanticscholar.org/paper/', o_orderkey) END AS url FROM orders""")
def api_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as API records: identifiers give the tags and the URL."""
    key = F.col("o_orderkey").cast("string")
    ids = F.struct(F.when(F.col("o_orderpriority").startswith("1-"), F.concat(F.lit("10.1109/"), key)).alias("DOI"), F.when(F.col("o_orderstatus") == "F", key).alias("ArXiv"))
    null = lambda kind: F.lit(None).cast(kind)
    rec = table(spark, sf_dir, "orders").select(
        key.alias("paperId"), null("string").alias("title"), null("string").alias("abstract"), F.year("o_orderdate").alias("year"), null("string").alias("publicationDate"), ids.alias("externalIds"), null("string").alias("venue"),
        null("struct<name:string>").alias("publicationVenue"), null("long").alias("citationCount"), null("array<string>").alias("publicationTypes"),
    )
    return records.from_semantic_scholar(rec, "sample").select("id", "year", F.array_join("extra.sources", ",").alias("tags"), "url")


@_query("""SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(year(o_orderdate) AS INTEGER) AS year, strftime(o_orderdate, '%Y-%m-%d') AS date, CASE WHEN o_orderstatus = 'F' THEN 'G03F,H01L' ELSE 'H01L' END AS venue FROM orders WHERE o_orderstatus <> 'P' AND year(o_orderdate) BETWEEN 1996 AND 1999""")
def warehouse_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as patent rows: range, class, language and kind filters, then the projection."""
    text = lambda s: F.array(F.struct(F.lit("texte").alias("text"), F.lit("fr").alias("language")), F.struct(F.lit(s).alias("text"), F.lit("en").alias("language")))
    codes = F.when(F.col("o_orderstatus") == "F", F.array(F.struct(F.lit("H01L21/02").alias("code")), F.struct(F.lit("G03F7/20").alias("code")), F.struct(F.lit("H01L29/78").alias("code")))).otherwise(F.array(F.struct(F.lit("H01L29/78").alias("code"))))
    day = F.date_format("o_orderdate", "yyyyMMdd").cast("long")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("publication_number"), F.lit("US").alias("country_code"), F.when(F.col("o_orderstatus") == "P", "S1").otherwise("B2").alias("kind_code"), day.alias("priority_date"), day.alias("filing_date"), day.alias("publication_date"),
        text("title").alias("title_localized"), text("abstract").alias("abstract_localized"), codes.alias("cpc"),
    )
    kept = records.warehouse_filter(rows, 19960101, 19991231, "H01L|G03F", ["A1", "A", "B1", "B2", "A2"])
    return records.from_warehouse(kept).select("id", "year", "date", "venue")


_SHORT = "regexp_extract_all(text, '[A-Za-z]+')"


@_query(f"""SELECT CASE WHEN item_id % 3 = 0 THEN concat('https://arxiv.org/abs/', item_id) WHEN item_id % 2 = 0 THEN concat('https://doi.org/10.1/', item_id) ELSE concat('https://openalex.org/W', item_id) END AS id,
 CAST(CASE WHEN item_id % 5 = 0 THEN 0 ELSE 2000 + item_id % 20 END AS INTEGER) AS year, md5(array_to_string({_SHORT}, ' ')) AS digest, CASE WHEN item_id % 2 = 0 THEN concat('https://doi.org/10.1/', item_id) ELSE concat('https://openalex.org/W', item_id) END AS url,
 CAST(coalesce(CASE WHEN item_id % 4 = 0 THEN NULL ELSE item_id END, 0) AS BIGINT) AS cited FROM benchmark""")
def openalex_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as records with an inverted index: identifiers, landing pages, years and counts that may be missing."""
    key = F.col("item_id").cast("string")
    b = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode_outer(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("p", "w"))
    index = b.groupBy("item_id", "w").agg(F.collect_list("p").alias("ps")).groupBy("item_id").agg(F.map_from_entries(F.filter(F.collect_list(F.struct("w", "ps")), lambda e: e["w"].isNotNull())).alias("abstract_inverted_index"))
    landing = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("https://arxiv.org/abs/"), key)).otherwise("https://example.org")
    rec = index.select(
        F.concat(F.lit("https://openalex.org/W"), key).alias("id"), F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("https://doi.org/10.1/"), key)).otherwise("").alias("doi"), F.lit(None).cast("string").alias("title"),
        F.when(F.col("item_id") % 5 != 0, 2000 + F.col("item_id") % 20).cast("int").alias("publication_year"), F.lit("2020-01-01").alias("publication_date"), "abstract_inverted_index",
        F.struct(landing.alias("landing_page_url"), F.struct(F.lit("venue").alias("display_name")).alias("source")).alias("primary_location"), F.lit("article").alias("type"),
        F.when(F.col("item_id") % 4 != 0, F.col("item_id")).cast("long").alias("cited_by_count"), F.struct(F.lit(None).cast("string").alias("pmid")).alias("ids"),
    )
    out = records.from_openalex(rec, "arxiv")
    return out.select("id", "year", F.md5("abstract").alias("digest"), "url", F.col("extra.cited_by").alias("cited"))


@_query("""SELECT CAST(l_orderkey AS VARCHAR) AS id, CAST(year AS INTEGER) AS year, date, concat('https://patents.google.com/patent/', l_orderkey) AS url, CAST(l_linenumber AS VARCHAR) AS title FROM (
 SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate) AS r FROM (SELECT l_orderkey, l_linenumber, l_shipdate, year(l_shipdate) AS year, strftime(l_shipdate, '%d/%m/%Y') AS date FROM lineitem WHERE l_linenumber % 3 <> 1)) WHERE r = 1""")
def patent_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as rows of a patent export: rows without a date go, then the first row of an id stays."""
    line = table(spark, sf_dir, "lineitem")
    rows = line.select(
        (F.col("l_linenumber") * 100_000 + F.datediff("l_shipdate", F.lit("1990-01-01"))).cast("long").alias("k"), F.concat(F.lit(" "), F.col("l_orderkey").cast("string")).alias("id"), F.col("l_linenumber").cast("string").alias("title"), F.lit("x").alias("assignee"),
        F.when(F.col("l_linenumber") % 3 != 1, F.date_format("l_shipdate", "dd/MM/yyyy")).otherwise("none").alias("filing/creation date"), F.lit("19990101").alias("publication date"), F.lit("").alias("result link"), F.lit("a.csv").alias("file"),
    )
    return records.from_patent_csv(rows).select("id", "year", "date", "url", "title")


@_query("""SELECT concat(c_custkey, 'v2') AS id, c_name || ' ' || c_mktsegment AS title, CAST(1990 + c_custkey % 30 AS INTEGER) AS year, concat(1990 + c_custkey % 30, '-05-06') AS date, CASE WHEN c_custkey % 2 = 0 THEN 'cs.AI,' || c_mktsegment ELSE '' END AS venue FROM customer""")
def feed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as entries of a feed: ids from URLs, titles on one line, years from timestamps, tags that may be missing."""
    c, year = table(spark, sf_dir, "customer"), (1990 + F.col("c_custkey") % 30).cast("string")
    rec = c.select(
        F.concat(F.lit("http://arxiv.org/abs/"), F.col("c_custkey").cast("string"), F.lit("v2")).alias("id"), F.concat(F.lit("\n  "), "c_name", F.lit("\n "), "c_mktsegment").alias("title"), F.lit(None).cast("string").alias("summary"),
        F.concat(year, F.lit("-05-06T07:08:09Z")).alias("published"), F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("cs.AI"), F.col("c_mktsegment"))).alias("tags"), F.lit("cs.AI").alias("primary_category"),
    )
    return records.from_arxiv(rec).select("id", "title", "year", "date", "venue")


@_query("SELECT doc_id, CAST(CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN 2014 + doc_id % 13 WHEN doc_id % 4 = 2 THEN 1999 ELSE NULL END AS INTEGER) AS year FROM documents")
def year_of_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The year of raw lines before they are parsed: the first four digits after the key, or none."""
    from .sources.jsonl import year_of_line as year

    d = table(spark, sf_dir, "documents").withColumn("k", F.col("doc_id") % 4)
    number = (2014 + F.col("doc_id") % 13).cast("string")
    line = F.when(F.col("k") == 0, F.lit('{"id": "a"}')).when(F.col("k") == 1, F.concat(F.lit('{"id": "a", "year":  '), number, F.lit("}"))).when(F.col("k") == 2, F.lit('{"year":1999, "x": {"year": 2001}}')).otherwise('{"year": 12}')
    return d.select("doc_id", year(line).alias("year"))


# --- text -----------------------------------------------------------------------------------------

_BLANKS = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _sql_replace(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, {sql_text(pattern)}, {sql_text(by)}, 'g')"


def _sql_latex(x: str) -> str:
    for k, v in textnorm.LATEX_SYMBOLS.items():
        x = f"replace({x}, {sql_text(k)}, {sql_text(v)})"
    for _ in range(2):
        x = _sql_replace(x, r"\\(?:" + "|".join(textnorm.LATEX_COMMANDS) + r")\s*\{([^{}]*)\}", r"\1")
    x = _sql_replace(x, r"_\{?(\p{Nd}+(?:\.\p{Nd}+)?)\}?", r"\1")
    x = _sql_replace(x, r"\^\{?([^{}\s]{1,6})\}?", r" \1 ")
    return _sql_replace(x, r"\$+|[{}]", "")


def _sql_plain(x: str) -> str:
    t = textnorm
    source = t.DASHES + t.SUBSCRIPTS + t.SUPERSCRIPTS + t.SPACE + t.QUOTES + t.VANISHING
    x = f"translate({x}, {sql_text(source)}, {sql_text('-' * len(t.DASHES) + t.DIGITS * 2 + ' ' + t.PLAIN_QUOTES)})"
    for k, v in t.LIGATURES.items():
        x = f"replace({x}, {sql_text(k)}, {sql_text(v)})"
    return x


_NORM = f"trim({_sql_replace(_sql_latex(_sql_replace(_sql_plain('text'), '<[^>]{1,40}>', ' ')), _BLANKS + '+', ' ')})"
_TOKENS = f"regexp_extract_all(lower(text), {sql_text(textnorm.TOKEN)})"


@_query(f"SELECT doc_id, length({_NORM}) AS chars, md5({_NORM}) AS digest FROM documents")
def normalise_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = textnorm.normalise_ascii(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(n).cast("long").alias("chars"), F.md5(n).alias("digest"))


_ENTITIES = {"&copy;": "©", "&middot;": "·", "&quot;": '"', "&lt;": "<", "&gt;": ">"}
_UNESCAPED = "text"
for _k, _v in _ENTITIES.items():
    _UNESCAPED = f"replace({_UNESCAPED}, {sql_text(_k)}, {sql_text(_v)})"
_UNESCAPED = f"regexp_replace({_UNESCAPED}, '&amp;?', '&', 'g')"


@_query(f"WITH d AS (SELECT doc_id, text FROM documents UNION ALL SELECT page_id, html FROM pages), u AS (SELECT doc_id, {_UNESCAPED} AS text FROM d) SELECT doc_id, md5({_NORM}) AS digest FROM u")
def normalise_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text").union(table(spark, sf_dir, "pages").select("page_id", "html"))
    return d.select("doc_id", F.md5(textnorm.normalise(F.col("text"))).alias("digest"))


@_query(f"SELECT doc_id, len({_TOKENS}) AS n, md5(array_to_string({_TOKENS}, ' ')) AS digest FROM documents")
def tokenise(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = textnorm.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.md5(F.array_join(t, " ")).alias("digest"))


@_query("SELECT page_id, md5(regexp_replace(html, '<[^>]{1,40}>', ' ', 'g')) AS digest FROM pages")
def strip_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(textnorm.strip_tags(F.col("html"))).alias("digest"))


@_query(f"SELECT page_id, md5({_sql_latex('html')}) AS digest FROM pages")
def latex_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(textnorm.latex_unwrap(F.col("html"))).alias("digest"))


_STOPS = ", ".join(sql_text(w) for w in sorted(textnorm.STOP_WORDS))
_NUM = sql_text(textnorm.NUMERIC)
_GRAMS = f"""tk AS (SELECT doc_id, year, {_TOKENS} AS ts FROM dd), t1 AS (SELECT doc_id, year, unnest(ts) AS a, generate_subscripts(ts, 1) AS i FROM tk),
 t2 AS (SELECT *, lead(a, 1) OVER w AS b, lead(a, 2) OVER w AS c FROM t1 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
 f AS (SELECT *, regexp_matches(b, {_NUM}) AS bn, regexp_matches(c, {_NUM}) AS cn FROM t2 WHERE a NOT IN ({_STOPS}) AND NOT regexp_matches(a, {_NUM}) AND length(a) >= 3),
 gr AS (SELECT DISTINCT doc_id, year, a AS term FROM f WHERE length(a) >= 4 UNION SELECT DISTINCT doc_id, year, a || ' ' || b FROM f WHERE b IS NOT NULL AND NOT bn AND b NOT IN ({_STOPS}) AND length(b) >= 2
 UNION SELECT DISTINCT doc_id, year, a || ' ' || b || ' ' || c FROM f WHERE c IS NOT NULL AND NOT bn AND NOT cn AND c NOT IN ({_STOPS}) AND length(c) >= 2)"""


@_query(f"WITH {DD}, {_GRAMS} SELECT d.doc_id, count(g.term) AS grams FROM documents d LEFT JOIN gr g ON g.doc_id = d.doc_id GROUP BY d.doc_id")
def doc_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(textnorm.ngrams(F.col("text"))).cast("long").alias("grams"))


_ODD = ("CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS title", "CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN '' ELSE text END AS abstract")


@_query(f"SELECT doc_id, md5(concat(coalesce(title, ''), '. ', coalesce(abstract, ''))) AS digest FROM (SELECT doc_id, {", ".join(_ODD)} FROM documents)")
def text_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and abstract as one text; null parts count as empty."""
    from .schema import full_text

    d = table(spark, sf_dir, "documents").selectExpr("doc_id", *_ODD)
    return d.select("doc_id", F.md5(full_text(F.col("title"), F.col("abstract"))).alias("digest"))


# --- matching -------------------------------------------------------------------------------------


@_query(f"WITH {M} SELECT source, year, count(*) AS docs, count(*) FILTER (WHERE in_domain) AS inside FROM m GROUP BY source, year")
def in_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched_lines(spark, sf_dir).groupBy("source", "year").agg(F.count("*").alias("docs"), F.count_if("in_domain").alias("inside"))


@_query(f"WITH {DL}, m AS (SELECT * FROM dl), {sql_hits(PARTS, gated=False)} SELECT concept, text, count(*) AS docs FROM hits GROUP BY concept, text")
def concept_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = match.with_matches(line_docs(spark, sf_dir), PARTS, gated=False)
    return m.select("text", F.explode("concepts").alias("concept")).groupBy("concept", "text").agg(F.count("*").alias("docs"))


def _one_concept(key: str) -> tuple[Query, str]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return line_docs(spark, sf_dir).where(match.has_concept(F.col("text"), PARTS.by_key[key])).groupBy("text").agg(F.count("*").alias("docs"))

    return run, f"WITH {DL} SELECT text, count(*) AS docs FROM dl WHERE {sql_flag(PARTS, key)} GROUP BY text"


_ALL["concept_exclude"], _ALL["concept_require"] = _one_concept("HOT"), _one_concept("AGED")


@_query(f"WITH {DD}, m AS (SELECT * FROM dd), {sql_hits(PROSE, gated=False)} SELECT concept, year, count(*) AS docs FROM hits GROUP BY concept, year")
def phrase_vs_acronym(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = match.with_matches(prose_docs(spark, sf_dir), PROSE, gated=False)
    return m.select("year", F.explode("concepts").alias("concept")).groupBy("concept", "year").agg(F.count("*").alias("docs"))


@_query("SELECT p_name AS text, count(*) AS parts FROM part WHERE regexp_matches(p_name, '(?i)(?:^|[^a-z0-9])hot[ -]*(?:rings?|ringes|rods?|rodes)(?:$|[^a-z0-9])') GROUP BY p_name")
def plural_and_hyphen(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .taxonomy import presence

    return table(spark, sf_dir, "part").where(F.col("p_name").rlike(presence(["hot-ring", "Hot rod"]))).groupBy(F.col("p_name").alias("text")).agg(F.count("*").alias("parts"))


_RAW = ("re:(?i)HO[T]\\s+r\\w+", "re:(?:gizmo|widget)$", "cold gear")


@_query(f"WITH {DL} SELECT text, count(*) AS docs FROM dl WHERE regexp_matches(text, {sql_text('(?i:HO[T]' + chr(92) + 's+r' + chr(92) + 'w+)')}) OR regexp_matches(text, '(?:gizmo|widget)$') OR regexp_matches(text, {sql_text(linear_presence(['cold gear']))}) GROUP BY text")
def raw_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A concept whose synonyms are raw patterns, one of them in any case, beside a plain one."""
    from .taxonomy import Concept

    raw = Concept("RAW", "raw", "x", _RAW)
    return line_docs(spark, sf_dir).where(match.has_concept(F.col("text"), raw)).groupBy("text").agg(F.count("*").alias("docs"))


_SYN = " UNION ALL ".join(
    f"SELECT *, {sql_text(c.key)} AS concept, CASE " + " ".join(f"WHEN regexp_matches(text, {sql_text(linear_presence([s]))}) THEN {sql_text(s)}" for s in c.synonyms) + f" END AS synonym FROM m WHERE in_domain AND {sql_flag(PARTS, c.key)}" for c in PARTS.concepts
)


@_query(f"WITH {M}, s AS ({_SYN}) SELECT concept, synonym, text, count(*) AS docs, count(*) AS occurrences FROM s GROUP BY concept, synonym, text")
def synonym_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = match.long_hits(matched_lines(spark, sf_dir), "text")
    return hits.groupBy("concept", "synonym", "text").agg(F.count("*").alias("docs"), F.sum("n").alias("occurrences"))


@_query(f"WITH {M}, s AS ({_SYN}) SELECT concept, synonym, count(*) AS docs, count(*) AS occurrences FROM s GROUP BY concept, synonym")
def hit_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits of a document as a map of maps, read key by key."""
    m = matched_lines(spark, sf_dir).select(F.explode(match.hit_map(F.col("hits"))).alias("concept", "m"))
    return m.select("concept", F.explode("m").alias("synonym", "n")).groupBy("concept", "synonym").agg(F.count("*").alias("docs"), F.sum("n").alias("occurrences"))


@_query(f"WITH m AS (SELECT item_id, text FROM benchmark), {sql_hits(PROSE, gated=False)} SELECT item_id, concept FROM hits")
def keyword_tester(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").withColumn("text", F.col("text"))
    return match.with_matches(b, PROSE, gated=False).select("item_id", F.explode("concepts").alias("concept"))


# --- measures -------------------------------------------------------------------------------------


@_query(f"WITH {M}, {T} SELECT source, year, fetched, in_domain, in_domain_analysed, source_total, scale, round(abstract_rate, 6) AS abstract_rate, partial_year FROM t")
def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_totals(matched_lines(spark, sf_dir)), "abstract_rate")


@_query(f"""WITH {M}, {T}, mt AS (SELECT DISTINCT source, year, 1000 * (year - 1990) AS total FROM t WHERE source <> 'R')
 SELECT t.source, t.year, fetched, in_domain, CAST(coalesce(total, fetched) AS DOUBLE) AS source_total, round(CAST(coalesce(total, fetched) AS DOUBLE) / fetched, 6) AS scale FROM t LEFT JOIN mt ON mt.source = t.source AND mt.year = t.year""")
def totals_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals scaled to what the sources report; a source without a report keeps what was analysed."""
    counts = measures.year_counts(matched_lines(spark, sf_dir))
    meta = counts.where("source <> 'R'").select("source", "year", (1000 * (F.col("year") - 1990)).alias("total"))
    return rounded(measures.totals(counts, AS_OF_LINES, meta).select("source", "year", "fetched", "in_domain", "source_total", "scale"), "scale")


@_query(f"WITH {M} SELECT source, year, count(*) AS docs FROM m WHERE year IN (1994, 1996, 1998) GROUP BY source, year")
def years_of_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only years that the metadata know count."""
    years = spark.createDataFrame([(1994,), (1996,), (1998,), (2050,)], "year int")
    return matched_lines(spark, sf_dir).join(F.broadcast(years), "year", "left_semi").groupBy("source", "year").agg(F.count("*").alias("docs"))


_SAMPLED = f"""s AS (SELECT *, unnest([source, 'all']) AS tag FROM m), yn AS (SELECT year, count(*) AS sample_n FROM m GROUP BY year), sd AS (SELECT s.tag AS source, s.year, count(*) AS fetched, count(*) FILTER (WHERE in_domain) AS in_domain_analysed,
 1000.0 * (s.year - 1990) * count(*) FILTER (WHERE in_domain) / max(sample_n) AS in_domain, 1000.0 * (s.year - 1990) * count(*) / max(sample_n) AS source_total FROM s JOIN yn ON yn.year = s.year WHERE s.tag IN ('all', 'A', 'R') GROUP BY s.tag, s.year)"""


def _year_meta(docs: DataFrame) -> DataFrame:
    return docs.select("year").distinct().withColumn("domain_total", 1000 * (F.col("year") - 1990))


def _sample(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m = matched_lines(spark, sf_dir).withColumn("sources", F.array("source", F.lit("all"))).drop("source")
    return m, measures.sampled_totals(m, ["all", "A", "R"], _year_meta(m), AS_OF_LINES)


@_query(f"WITH {M}, {_SAMPLED} SELECT source, year, fetched, in_domain_analysed, round(in_domain, 6) AS in_domain, round(source_total, 6) AS source_total, round(source_total / fetched, 6) AS scale FROM sd")
def scaled_denominator(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _sample(spark, sf_dir)[1].select("source", "year", "fetched", "in_domain_analysed", "in_domain", "source_total", "scale")
    return rounded(out, "in_domain", "source_total", "scale")


@_query(f"{CY} SELECT source, category, concept, label, year, docs, docs_raw, in_domain_total, round(share_pct, 6) AS share_pct, est_docs, partial_year FROM cy")
def concept_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_tables(spark, sf_dir)[2], "share_pct")


_CUT = "CASE WHEN concept IN ('GEAR', 'HOT') AND year >= 1998 THEN 3.0 ELSE 1.0 END"
_GATE = f"CASE line % 3 WHEN 0 THEN ['GEAR', 'COLD'] WHEN 1 THEN ['HOT', 'ROUND'] ELSE ['FLAT', 'WIDGET', 'AGED'] END"


@_query(f"""WITH {H}, {_SAMPLED}, {sql_dim(PARTS)}, e AS (SELECT *, unnest([source, 'all']) AS tag FROM hits WHERE list_contains({_GATE}, concept)),
 n AS (SELECT tag AS source, year, concept, count(*) AS docs_raw, sum({_CUT}) AS docs FROM e GROUP BY tag, year, concept)
 SELECT sd.source, dim.concept, sd.year, CAST(coalesce(docs, 0) AS DOUBLE) AS docs, CAST(coalesce(docs_raw, 0) AS BIGINT) AS docs_raw, round(100.0 * coalesce(docs, 0) / sd.in_domain, 6) AS share_pct
 FROM sd CROSS JOIN dim LEFT JOIN n ON n.source = sd.source AND n.year = sd.year AND n.concept = dim.concept""")
def concept_year_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, total = _sample(spark, sf_dir)
    gate = F.when(F.col("line") % 3 == 0, F.array(F.lit("GEAR"), F.lit("COLD"))).when(F.col("line") % 3 == 1, F.array(F.lit("HOT"), F.lit("ROUND"))).otherwise(F.array(*map(F.lit, ("FLAT", "WIDGET", "AGED"))))
    cut = spark.createDataFrame([(k, y, 300, 100) for k in ("GEAR", "HOT") for y in range(1998, 2010)], "concept string, year int, total long, fetched long")
    tagged = measures.by_tag(m.withColumn("retrieved_for", gate))
    out = measures.concept_year(measures.concept_counts(tagged, cut, "retrieved_for"), total, PARTS, weighted=True)
    return rounded(out.select("source", "concept", "year", "docs", "docs_raw", "share_pct"), "share_pct")


@_query(f"""{CY} SELECT 'all' AS source, concept, year, sum(docs) AS docs, CAST(sum(docs_raw) AS BIGINT) AS docs_raw, round(100.0 * sum(docs) / sum(in_domain_total), 6) AS share_pct FROM cy GROUP BY concept, year
 UNION ALL SELECT source, concept, year, docs, docs_raw, round(share_pct, 6) FROM cy""")
def concept_year_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, total, cy = _tables(spark, sf_dir)
    return rounded(measures.with_all_sources(cy, total)[0].select("source", "concept", "year", "docs", "docs_raw", "share_pct"), "share_pct")


@_query(f"WITH {M}, s AS ({_SYN}) SELECT source, concept, synonym, year, count(*) AS docs FROM s GROUP BY source, concept, synonym, year")
def synonym_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.synonym_year(matched_lines(spark, sf_dir))


_GROWTH = ("share_recent_pct", "share_prior_pct", "growth_ratio", "delta_pp")


def _growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.growth(_tables(spark, sf_dir)[2], AS_OF_LINES)


@_query(f"{G} SELECT source, category, concept, docs_total, docs_recent, docs_prior, {', '.join(f'round({c}, 6) AS {c}' for c in _GROWTH)} FROM g")
def growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_growth(spark, sf_dir).select("source", "category", "concept", "docs_total", "docs_recent", "docs_prior", *_GROWTH), *_GROWTH)


@_query(f"{G} SELECT source, concept, round(slope_pp_per_year, 6) AS slope_pp_per_year FROM g")
def growth_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_growth(spark, sf_dir).select("source", "concept", "slope_pp_per_year"), "slope_pp_per_year")


@_query(f"{G} SELECT source, concept, first_year_ge3, peak_year FROM g")
def first_peak_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _growth(spark, sf_dir).select("source", "concept", "first_year_ge3", "peak_year")


@_query(f"""{G}, sp AS (SELECT source, concat(min(year) FILTER (WHERE age <= 3), '-', max(year) FILTER (WHERE age <= 3)) AS recent_years, concat(min(year) FILTER (WHERE age BETWEEN 4 AND 6), '-', max(year) FILTER (WHERE age BETWEEN 4 AND 6)) AS prior_years FROM y GROUP BY source)
 SELECT g.source, concept, recent_years, prior_years FROM g JOIN sp ON sp.source = g.source""")
def growth_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _growth(spark, sf_dir).select("source", "concept", "recent_years", "prior_years")


_LIFT = f"""WITH {HR}, {P}, k AS (SELECT source, concept, count(*) AS n FROM hits GROUP BY source, concept), dm AS (SELECT source, CAST(count(*) FILTER (WHERE in_domain) AS DOUBLE) AS in_domain FROM m GROUP BY source),
 co AS (SELECT p.source, concept_a, concept_b, docs_both, ka.n AS docs_a, kb.n AS docs_b, dm.in_domain, docs_both * dm.in_domain / greatest(ka.n * kb.n, 1) AS lift, docs_both * 1.0 / greatest(ka.n + kb.n - docs_both, 1) AS jaccard
 FROM p JOIN k ka ON ka.source = p.source AND ka.concept = concept_a JOIN k kb ON kb.source = p.source AND kb.concept = concept_b JOIN dm ON dm.source = p.source)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, total, cy = _tables(spark, sf_dir)
    return measures.cooccurrence(m, cy, total)


@_query(f"WITH {HR}, {P} SELECT source, concept_a, concept_b, docs_both FROM p")
def cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("source", "concept_a", "concept_b", "docs_both")


@_query(f"{_LIFT} SELECT source, concept_a, concept_b, docs_both, docs_a, docs_b, in_domain, round(lift, 6) AS lift, round(jaccard, 6) AS jaccard FROM co")
def lift_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_pairs(spark, sf_dir), "lift", "jaccard")


@_query(f"""WITH {H}, b AS (SELECT source, concept, id, cited, year, text, row_number() OVER (PARTITION BY source, concept, id ORDER BY cited DESC, year DESC, text DESC) AS r FROM hits WHERE year >= {AS_OF_LINES - 3}),
 x AS (SELECT *, CAST(row_number() OVER (PARTITION BY source, concept ORDER BY cited DESC, year DESC, id DESC, text DESC) AS INTEGER) AS rank FROM b WHERE r = 1) SELECT source, concept, year, id, text AS title, cited, rank FROM x WHERE rank <= 3""")
def examples_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.examples(matched_lines(spark, sf_dir), AS_OF_LINES).drop("url")


@_query(f"""WITH {H}, b AS (SELECT source, concept, id, cited, year, text, row_number() OVER (PARTITION BY source, concept, id ORDER BY cited DESC, year DESC, text DESC) AS r FROM hits WHERE year >= {AS_OF_LINES - 3}),
 x AS (SELECT *, row_number() OVER (PARTITION BY source, concept ORDER BY cited DESC, year DESC, id DESC, text DESC) AS rank FROM b WHERE r = 1) SELECT CAST(row_number() OVER (ORDER BY source, concept, rank) AS INTEGER) AS line, source, concept, id FROM x WHERE rank <= 3""")
def example_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of examples with the line that each stands on; it has three rows a source and concept."""
    rows = views.example_list(measures.examples(matched_lines(spark, sf_dir), AS_OF_LINES))
    return rows.select(F.row_number().over(Window.orderBy("source", "concept", "rank")).alias("line"), "source", "concept", "id")


@_query(f"WITH {M}, {T} SELECT CAST(sum(fetched) AS BIGINT) AS docs_analysed, CAST(sum(in_domain_analysed) AS BIGINT) AS docs_in_domain_analysed, sum(in_domain) AS corpus_in_domain_est, list_aggregate(list_sort(list(DISTINCT year)), 'string_agg', ',') AS years FROM t")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = measures.summary(_totals(matched_lines(spark, sf_dir)))
    return out.withColumn("years", F.array_join(F.col("years").cast("array<string>"), ","))


@_query("SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS source, count(*) AS fetched, round(avg(CASE WHEN o_totalprice > 100000 THEN 1.0 ELSE 0.0 END), 6) AS abstract_rate FROM orders GROUP BY 1, 2")
def order_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("source"), (F.col("o_totalprice") > 100000).alias("has_abstract"), F.lit(False).alias("in_domain"))
    return rounded(measures.year_counts(o).select("year", "source", F.col("analysed").alias("fetched"), "abstract_rate"), "abstract_rate")


_SAID = [(c.key, s, sorted({f + p for p in ("", "s", "es") for f in [s]}) if any(x.islower() for x in s) else [s, s + "s"], any(x.islower() for x in s)) for c in PROSE.concepts for s in c.synonyms]


@_query(f"""WITH {DD}, m AS (SELECT * FROM dd), {sql_hits(PROSE, gated=False)}, syn(concept, synonym, forms, fold) AS (VALUES {", ".join(f"({sql_text(k)}, {sql_text(s)}, [{', '.join(map(sql_text, forms))}], {str(fold).lower()})" for k, s, forms, fold in _SAID)}),
 o AS (SELECT year, hits.concept, synonym, len(list_filter(string_split_regex(CASE WHEN fold THEN lower(text) ELSE text END, '[^A-Za-z0-9]+'), lambda t: list_contains(forms, t))) AS n FROM hits JOIN syn ON syn.concept = hits.concept)
 SELECT concept, synonym, year, count(*) AS docs, CAST(sum(n) AS BIGINT) AS occurrences, CAST(max(n) AS INTEGER) AS most FROM o WHERE n > 0 GROUP BY concept, synonym, year""")
def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each synonym stands in the documents of a year; prose repeats its words, so occurrences exceed documents."""
    m = match.matched(prose_docs(spark, sf_dir), PROSE, gated=False)
    return match.long_hits(m, "year").groupBy("concept", "synonym", "year").agg(F.count("*").alias("docs"), F.sum("n").alias("occurrences"), F.max("n").alias("most"))


# --- emerging terms -------------------------------------------------------------------------------

_EMD = f"md AS (SELECT *, {sql_domain(PROSE)} AS in_domain FROM dd), dn AS (SELECT year, count(*) AS n FROM md WHERE in_domain GROUP BY year)"
_DF = f"WITH {DD}, {_EMD}, {_GRAMS.replace('FROM dd)', 'FROM md WHERE in_domain)')}, ndf AS (SELECT 'all' AS source, year, term, count(*) AS df FROM gr GROUP BY year, term HAVING count(*) >= 5)"
_BURST = f"""{_DF}, yy AS (SELECT year, n, row_number() OVER (ORDER BY year DESC) AS age FROM dn WHERE year <> {AS_OF_DOCS}), ns AS (SELECT sum(n) FILTER (WHERE age <= 3) AS n_rec, sum(n) FILTER (WHERE age BETWEEN 4 AND 6) AS n_pri FROM yy),
 tt AS (SELECT term, CAST(coalesce(sum(df) FILTER (WHERE age <= 3), 0) AS BIGINT) AS recent_df, CAST(coalesce(sum(df) FILTER (WHERE age BETWEEN 4 AND 6), 0) AS BIGINT) AS prior_df FROM ndf JOIN yy ON yy.year = ndf.year GROUP BY term),
 bs AS (SELECT 'all' AS source, term, recent_df, prior_df, (recent_df * 1.0 / n_rec + 1.0 / n_pri) / (prior_df * 1.0 / n_pri + 1.0 / n_pri) AS growth_ratio FROM tt CROSS JOIN ns WHERE recent_df >= 15), b AS MATERIALIZED (SELECT *, ln(growth_ratio) * ln(1.0 + recent_df) AS score FROM bs)"""


def _prose_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In the domain or not. The dealt texts are written once, as the counts and both scans for n-grams read them: kept by
    ``persist`` they fill the executors' heaps, and beyond those lie on disk uncompressed."""
    docs = emerging.by_source_year(prose_docs(spark, sf_dir).select(F.lit("all").alias("source"), "year", "id", "text"))
    docs.write.parquet(path := scratch(spark, "texts"), compression="zstd")
    return spark.read.parquet(path).withColumn("in_domain", match.in_domain(F.col("text"), PROSE))  # nothing here reads concepts


def _ngram_df(m: DataFrame) -> DataFrame:
    return emerging.ngram_df(m.where("in_domain"))


def _bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _prose_matched(spark, sf_dir)
    counts = m.where("in_domain").groupBy("source", "year").agg(F.count("*").alias("n"))
    return emerging.burst_scores(_ngram_df(m), counts, AS_OF_DOCS)


@_query(f"{_DF} SELECT source, year, term, df FROM ndf")
def ngram_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ngram_df(_prose_matched(spark, sf_dir))


@_query(f"{_BURST} SELECT source, term, recent_df, prior_df, round(growth_ratio, 6) AS growth_ratio, round(score, 6) AS score FROM b")
def burst_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_bursts(spark, sf_dir).select("source", "term", "recent_df", "prior_df", "growth_ratio", "score"), "growth_ratio", "score")


_DEDUP = _BURST.replace("WITH ", "WITH RECURSIVE ", 1) + """, rk AS MATERIALIZED (SELECT term, recent_df, row_number() OVER (ORDER BY round(score, 9) DESC, term) AS rn FROM b), wk(rn, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS STRUCT(t VARCHAR, d BIGINT)[]) UNION ALL
 SELECT r.rn, CASE WHEN len(w.kept) >= 80 OR len(list_filter(w.kept, lambda k: contains(k.t, r.term) AND k.d >= 0.7 * r.recent_df)) > 0 THEN w.kept ELSE list_append(w.kept, {'t': r.term, 'd': r.recent_df}) END FROM wk w JOIN rk r ON r.rn = w.rn + 1),
 fin AS (SELECT unnest(kept) AS k FROM (SELECT kept FROM wk ORDER BY rn DESC LIMIT 1)), kp AS (SELECT k.t AS term, k.d AS recent_df FROM fin)"""


def _kept_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emerging.without_contained(_bursts(spark, sf_dir).withColumn("score", F.round("score", 9)))


@_query(f"{_DEDUP} SELECT 'all' AS source, term, recent_df FROM kp")
def emerging_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept_terms(spark, sf_dir).select("source", "term", "recent_df")


@_query(f"{_DEDUP}, m AS (SELECT term, term AS text FROM kp), {sql_hits(PROSE, gated=False)} SELECT m.term, coalesce(string_agg(concept, ',' ORDER BY concept), '') AS covered_by FROM m LEFT JOIN hits ON hits.term = m.term GROUP BY m.term")
def emerging_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emerging.with_coverage(_kept_terms(spark, sf_dir), PROSE).select("term", "covered_by")


# --- files: written, and read again ---------------------------------------------------------------


def _orders_as_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return as_docs(o, source=F.lit("orders"), id=F.col("o_orderkey"), title=F.concat(F.lit('say "'), "o_orderpriority", F.lit('",\n\\ ü')), year=F.year("o_orderdate"), date=F.date_format("o_orderdate", "yyyy-MM-dd"), extra_cited_by=F.col("o_custkey"))


@_query("SELECT CAST(o_orderkey AS VARCHAR) AS id, concat('say \"', o_orderpriority, '\",', chr(10), chr(92), ' ü') AS title, CAST(year(o_orderdate) AS INTEGER) AS year, strftime(o_orderdate, '%Y-%m-%d') AS date, o_custkey AS cited FROM orders")
def strict_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as JSON lines and back by the strict scan: quotes, line breaks, backslashes and other alphabets."""
    path = scratch(spark, "lines")
    jsonl.write_jsonl(_orders_as_docs(spark, sf_dir), path)
    return jsonl.read_strict(spark, path).select("id", "title", "year", "date", F.col("extra.cited_by").alias("cited"))


@_query("SELECT id, year, file FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY file) AS r FROM (SELECT CAST(o_custkey AS VARCHAR) AS id, CAST(min(year(o_orderdate)) AS INTEGER) AS year, CAST(ascii(o_orderstatus) % 3 AS INTEGER) AS file FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 GROUP BY o_custkey, ascii(o_orderstatus) % 3)) WHERE r = 1")
def tolerant_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three folders of lines, some cut short, some without a year; the first file in the given order keeps an id."""
    o = table(spark, sf_dir, "orders").withColumn("file", F.ascii("o_orderstatus") % 3)
    years = o.where("o_orderkey % 7 <> 0 and o_orderkey % 5 <> 0").groupBy("o_custkey", "file").agg(F.min(F.year("o_orderdate")).alias("year"))
    whole = years.select("file", F.to_json(F.struct(F.lit("x").alias("source"), F.col("o_custkey").cast("string").alias("id"), "year")).alias("value"))
    cut = o.where("o_orderkey % 7 = 0").select("file", F.concat(F.lit('{"source":"x","id":"'), "o_custkey", F.lit('","year":19')).alias("value"))
    none = o.where("o_orderkey % 7 <> 0 and o_orderkey % 5 = 0").select("file", F.to_json(F.struct(F.col("o_custkey").cast("string").alias("id"))).alias("value"))
    path = scratch(spark, "tolerant")
    whole.union(cut).union(none).repartition(3, "file").write.partitionBy("file").text(path)
    files = sorted((p, name) for k in range(3) for name, (p, _, _) in jsonl.listing(spark, f"{path}/file={k}").items() if name.startswith("part-"))
    docs = jsonl.read_tolerant(spark, [p for p, _ in files])
    first = measures.first_wins(docs, F.col("file_rank"), by=("id",))
    number = F.element_at(F.array(*(F.lit(int(p.rsplit("/file=", 1)[1][0])) for p, _ in files)), F.col("file_rank") + 1) if files else F.lit(0)
    return first.select("id", "year", number.cast("int").alias("file"))


@_query(f"WITH {H} SELECT source, year, concept, count(*) AS docs, CAST(sum(cited) AS BIGINT) AS cited FROM hits GROUP BY source, year, concept")
def match_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches written by source and year as Parquet and as JSON, and read again from both."""
    path = scratch(spark, "matches")
    analysis.write_matches(matched_lines(spark, sf_dir), path)
    kept = spark.read.parquet(f"{path}/matches.parquet").select("source", "year", "cited", F.explode("hits.concept").alias("concept"))
    lines = spark.read.schema("source string, concepts map<string,map<string,int>>").json(f"{path}/matches.json").select("source", F.explode(F.map_keys("concepts")).alias("concept"))
    both = lines.groupBy("source", "concept").agg(F.count("*").alias("lines"))
    one = kept.groupBy("source", "year", "concept").agg(F.count("*").alias("docs"), F.sum("cited").alias("cited"))
    agree = one.groupBy("source", "concept").agg(F.sum("docs").alias("lines")).join(both, ["source", "concept", "lines"])
    return one.join(agree, ["source", "concept"], "left_semi")


@_query(f"{_DF} SELECT source, year, term, df FROM ndf")
def kept_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N-gram counts kept by source-year: half of the years counted by a first run, the others by a second, all read by a third."""
    m, path = _prose_matched(spark, sf_dir).where("in_domain"), scratch(spark, "kept")
    for part in (m.where("year % 2 = 0"), m):
        analysis.kept_ngrams(part, 5, path, PROSE.domain_terms).count()
    return analysis.kept_ngrams(m, 5, path, PROSE.domain_terms)


@_query(f"{G}, o AS (SELECT row_number() OVER (ORDER BY source, round(growth_ratio, 6) DESC, concept) AS line, * FROM g) SELECT line, source, concept, docs_total, round(growth_ratio, 6) AS growth_ratio, first_year_ge3 FROM o")
def table_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The growth table as one CSV file in its order, read again with the line each row stands on."""
    g, path = _growth(spark, sf_dir).withColumn("growth_ratio", F.round("growth_ratio", 6)), scratch(spark, "table")
    analysis.write_ordered(g.select("source", "concept", "docs_total", "growth_ratio", "first_year_ge3"), "growth", path)
    rows = jsonl.read_table(spark, path, "source string, concept string, docs_total long, growth_ratio double, first_year_ge3 int")
    return rows.withColumn("line", F.monotonically_increasing_id() + 1)  # one file, one task


def _nations(spark: SparkSession, sf_dir: str) -> dict:
    """A taxonomy of the nations by region, by their names and keys."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_nationkey", "n_name").orderBy("n_nationkey").collect()  # 25 rows in every size
    out: dict = {"domain_terms": ["customer"], "categories": {}}
    for r in n:
        out["categories"].setdefault(r.r_name, {})[f"N{r.n_nationkey}"] = {"label": r.n_name, "synonyms": [r.n_name.title()]}
    return out


@_query("SELECT r_name AS category, 'N' || n_nationkey AS concept, n_name AS label, count(*) AS docs FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def taxonomy_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A taxonomy written to a file, read again, and found in a sentence about each customer."""
    path = f"{scratch(spark, 'taxonomy')}/t.json"
    jsonl.write_text(spark, path, json.dumps(_nations(spark, sf_dir), ensure_ascii=False))
    tax = load_shared(spark, path)
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    m = match.matched(c.select(F.concat_ws(" ", F.lit("A customer from"), "n_name", "c_name").alias("text")), tax)
    return m.select(F.explode("concepts").alias("concept")).groupBy("concept").agg(F.count("*").alias("docs")).join(tax.frame(spark), "concept").select("category", "concept", "label", "docs")


# --- views ----------------------------------------------------------------------------------------


@_query(f"{CY} SELECT s.source, s.in_domain, s.fetched, CAST(h.concept_docs AS BIGINT) AS concept_docs FROM (SELECT source, sum(in_domain) AS in_domain, CAST(sum(fetched) AS BIGINT) AS fetched FROM t GROUP BY source) s JOIN (SELECT source, sum(docs_raw) AS concept_docs FROM cy GROUP BY source) h ON h.source = s.source")
def kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, total, cy = _tables(spark, sf_dir)
    return views.kpis(total, cy)


@_query(f"""{G}, q AS (SELECT concept, growth_ratio, row_number() OVER (ORDER BY round(growth_ratio, 9) DESC, concept) AS u, row_number() OVER (ORDER BY round(growth_ratio, 9), concept) AS d FROM g WHERE source = 'A' AND docs_recent + docs_prior >= 20)
 SELECT 'up' AS side, CAST(u AS INTEGER) AS rank, concept, round(growth_ratio, 6) AS growth_ratio FROM q WHERE u <= 5 UNION ALL SELECT 'down', CAST(d AS INTEGER), concept, round(growth_ratio, 6) FROM q WHERE d <= 4""")
def headline_risers(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _growth(spark, sf_dir).withColumn("growth_ratio", F.round("growth_ratio", 9))
    return rounded(views.risers_and_fallers(g, "A"), "growth_ratio")


@_query(f"{CY}, h AS (SELECT concept, year, share_pct, max(share_pct) OVER (PARTITION BY concept) AS top, sum(docs_raw) OVER (PARTITION BY concept) AS volume FROM cy WHERE source = 'A') SELECT concept, CAST(volume AS BIGINT) AS volume, " + ", ".join(f'round(coalesce(max(CASE WHEN year = {y} THEN share_pct / top END), 0.0), 6) AS y{y}' for y in range(1995, 2002)) + " FROM h WHERE volume > 0 GROUP BY concept, volume")
def heatmap_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = list(range(1995, 2002))
    return views.heatmap_pivot(_tables(spark, sf_dir)[2], "A", years).select("concept", "volume", *(r6(F.col(str(y))).alias(f"y{y}") for y in years))


@_query(f"""WITH {M}, s AS ({_SYN}), k AS (SELECT year, synonym, count(*) AS docs FROM s WHERE concept = 'HOT' AND source = 'A' GROUP BY year, synonym), z AS (SELECT synonym, row_number() OVER (ORDER BY sum(docs) DESC, synonym) AS place FROM k GROUP BY synonym),
 o AS (SELECT year, CASE WHEN place > 2 THEN 'other' ELSE k.synonym END AS form, least(place, 3) AS place, CAST(sum(docs) AS BIGINT) AS docs FROM k JOIN z ON z.synonym = k.synonym GROUP BY 1, 2, 3), pc AS (SELECT *, 100.0 * docs / sum(docs) OVER (PARTITION BY year) AS pct FROM o)
 SELECT year, form, docs, round(pct, 6) AS pct, round(coalesce(sum(pct) OVER (PARTITION BY year ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 6) AS base_pct FROM pc""")
def surface_form_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    syn = measures.synonym_year(matched_lines(spark, sf_dir)).where("source = 'A'")
    return rounded(views.surface_forms(syn, "HOT", top=2), "pct", "base_pct")


@_query(f"WITH {M}, {T} SELECT year, " + ", ".join(f"coalesce(sum(in_domain) FILTER (WHERE source = '{s}'), 0.0) AS {s}" for s in "ANR") + " FROM t GROUP BY year")
def volume_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.volume_by_source(_totals(matched_lines(spark, sf_dir)), ["A", "N", "R"])


@_query(f"WITH {M}, {T} SELECT year, " + ", ".join(f"round(max(abstract_rate) FILTER (WHERE source = '{s}'), 6) AS {s}" for s in "ANR") + " FROM t GROUP BY year")
def abstract_rate_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(views.abstract_rates(_totals(matched_lines(spark, sf_dir)), ["A", "N", "R"]), "A", "N", "R")


@_query(f"{G} SELECT concept, first_year_ge3 AS first_year, CAST(2001 AS INTEGER) AS end_year, peak_year FROM g WHERE source = 'N' AND first_year_ge3 IS NOT NULL")
def ruler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.ruler(_growth(spark, sf_dir), "N", 2001)


@_query(f"{_LIFT}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY docs_both DESC, concept_a, concept_b) AS INTEGER) AS rank FROM co) SELECT source, concept_a, concept_b, docs_both, rank FROM r WHERE rank <= 15")
def cooc_head15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.cooccurrence_head(_pairs(spark, sf_dir)).select("source", "concept_a", "concept_b", "docs_both", "rank")


@_query(f"{_DEDUP} SELECT term, recent_df FROM kp JOIN (SELECT term AS bt, round(score, 9) AS score FROM b) ON bt = term ORDER BY score DESC, term LIMIT 40")
def emerging_head40(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.emerging_head(emerging.with_coverage(_kept_terms(spark, sf_dir), PROSE)).select("term", "recent_df")


@_query(f"{CY} SELECT category, concept, CAST(sum(docs_raw) AS BIGINT) AS volume FROM cy GROUP BY category, concept HAVING sum(docs_raw) > 0")
def category_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.panels(_tables(spark, sf_dir)[2])


@_query(f"{G} SELECT concept, round(log2(greatest(growth_ratio, 0.05)), 6) AS log2_ratio FROM g WHERE source = 'R' AND docs_recent + docs_prior >= 20")
def growth_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(views.growth_bars(_growth(spark, sf_dir), "R"), "log2_ratio")


@_query(f"""{CY}, v AS (SELECT source, concept, CAST(sum(docs_raw) AS BIGINT) AS volume FROM cy GROUP BY source, concept), l AS (SELECT source, concept, share_pct AS last_share FROM (SELECT *, row_number() OVER (PARTITION BY source, concept ORDER BY year DESC) AS r FROM cy WHERE NOT partial_year) WHERE r = 1)
 SELECT cy.source, cy.concept, year, round(share_pct, 6) AS share_pct, partial_year, volume, round(last_share, 6) AS last_share FROM cy JOIN v ON v.source = cy.source AND v.concept = cy.concept JOIN l ON l.source = cy.source AND l.concept = cy.concept WHERE cy.concept IN ('GEAR', 'HOT')""")
def headline_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(views.line_table(_tables(spark, sf_dir)[2], ["GEAR", "HOT"]), "share_pct", "last_share")


@_query(f"""{CY}, l AS (SELECT source, concept, share_pct AS last_share FROM (SELECT *, row_number() OVER (PARTITION BY source, concept ORDER BY year DESC) AS r FROM cy WHERE NOT partial_year) WHERE r = 1),
 k AS (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY round(last_share, 9) DESC, concept) AS INTEGER) AS rank FROM l) SELECT source, concept, rank, round(last_share, 6) AS last_share FROM k WHERE rank <= 4""")
def labelled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = views.line_table(_tables(spark, sf_dir)[2], PARTS.keys).withColumn("last_share", F.round("last_share", 9))
    return rounded(views.labelled_lines(lines), "last_share").select("source", "concept", "rank", "last_share")


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _ALL.items() if s}
