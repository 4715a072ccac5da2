"""Records of the sources' APIs and exports, projected to documents by built-in expressions."""

from __future__ import annotations

import csv
import io
import itertools
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import as_docs
from .jsonl import with_file_rank

S2_RECORD = "paperId string, title string, abstract string, year int, publicationDate string, externalIds struct<DOI:string,ArXiv:string>, venue string, publicationVenue struct<name:string>, citationCount long, publicationTypes array<string>"
OPENALEX_RECORD = "id string, doi string, title string, publication_year int, publication_date string, abstract_inverted_index map<string,array<int>>, primary_location struct<landing_page_url:string,source:struct<display_name:string>>, type string, cited_by_count long, ids struct<pmid:string>"
IEEE_RECORD = "article_number string, title string, abstract string, publication_year string, publication_date string, publication_title string, content_type string, citing_paper_count long, doi string, html_url string"
ARXIV_RECORD = "id string, title string, summary string, published string, tags array<string>, primary_category string"
WAREHOUSE_RECORD = "publication_number string, country_code string, kind_code string, priority_date long, filing_date long, publication_date long, title_localized array<struct<text:string,language:string>>, abstract_localized array<struct<text:string,language:string>>, cpc array<struct<code:string>>"
CSV_DATES = ("priority date", "filing/creation date", "filing date", "publication date", "grant date")


def filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def source_tags(doi: Column, venue: Column, arxiv: Column) -> Column:
    """all, and ieee by publisher prefix or venue, and arxiv if there is an arXiv id."""
    ieee = F.coalesce(F.lower(doi).startswith("10.1109"), F.lit(False)) | F.coalesce(F.contains(F.lower(venue), F.lit("ieee")), F.lit(False))
    return F.array_compact(F.array(F.lit("all"), F.when(ieee, F.lit("ieee")), F.when(filled(arxiv).isNotNull(), F.lit("arxiv"))))


def from_semantic_scholar(records: DataFrame, pool: str, year: Column | None = None, retrieved_for: Column | None = None) -> DataFrame:
    """``year`` stands in for records without one; ``retrieved_for`` is the concept whose query gave the record."""
    doi, arxiv = F.coalesce("externalIds.DOI", F.lit("")), F.coalesce("externalIds.ArXiv", F.lit(""))
    venues = F.concat_ws(" ", "venue", "publicationVenue.name")
    url = F.coalesce(F.concat(F.lit("https://doi.org/"), filled(doi)), F.concat(F.lit("https://arxiv.org/abs/"), filled(arxiv)), F.concat(F.lit("https://www.semanticscholar.org/paper/"), F.col("paperId")))
    return as_docs(
        records, source=F.lit("s2"), id=F.col("paperId"), title=F.col("title"), abstract=F.col("abstract"), year=F.coalesce(F.nullif("year", F.lit(0)), *([year] if year is not None else [])), date=F.col("publicationDate"),
        venue=F.col("venue"), doc_type=F.lit("paper"), url=url, extra_pool=F.lit(pool), extra_sources=source_tags(doi, venues, arxiv), extra_doi=doi, extra_arxiv=arxiv,
        extra_cited_by=F.coalesce("citationCount", F.lit(0)), extra_types=F.coalesce("publicationTypes", F.array().cast("array<string>")),
        **({"extra_retrieved_for": retrieved_for} if retrieved_for is not None else {}),
    )


def inverted_index_text(index: Column) -> Column:
    """The text of a map word -> positions: words by position, then by word."""
    placed = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.coalesce(F.array_join(F.transform(F.array_sort(placed), lambda x: x["w"]), " "), F.lit(""))


def from_openalex(records: DataFrame, source: str) -> DataFrame:
    """For arxiv the landing page on arXiv is the id where there is one."""
    landing, own = F.col("primary_location.landing_page_url"), F.coalesce(filled(F.col("doi")), F.col("id"))
    arxiv = F.when(F.contains(landing, F.lit("arxiv.org")), landing)
    return as_docs(
        records, source=F.lit(source), id=F.coalesce(arxiv, own) if source == "arxiv" else own, title=F.col("title"), abstract=inverted_index_text(F.col("abstract_inverted_index")), year=F.coalesce("publication_year", F.lit(0)),
        date=F.col("publication_date"), venue=F.col("primary_location.source.display_name"), doc_type=F.lit("paper"), url=own,
        extra_openalex_id=F.col("id"), extra_type=F.col("type"), extra_cited_by=F.coalesce("cited_by_count", F.lit(0)), extra_pmid=F.col("ids.pmid"),
    )


def from_ieee(records: DataFrame, year: Column | None = None) -> DataFrame:
    return as_docs(
        records, source=F.lit("ieee"), id=F.coalesce(filled(F.col("doi")), F.col("article_number")), title=F.col("title"), abstract=F.col("abstract"),
        year=F.coalesce(F.regexp_extract("publication_year", r"(\d{4})", 1).try_cast("int"), *([year] if year is not None else [])), date=F.col("publication_date"), venue=F.col("publication_title"),
        doc_type=F.lit("paper"), url=F.col("html_url"), extra_content_type=F.col("content_type"), extra_citing_paper_count=F.col("citing_paper_count"),
    )


def from_arxiv(entries: DataFrame) -> DataFrame:
    """Feed entries: id (a URL), title, summary, published, tags (array), primary_category. The id is the URL's last segment, version included."""
    line = lambda c: F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"(?U)\s+", " "))
    return as_docs(
        entries, source=F.lit("arxiv"), id=F.substring_index("id", "/", -1), title=line("title"), abstract=line("summary"), year=F.substring("published", 1, 4).try_cast("int"), date=F.substring("published", 1, 10),
        venue=F.array_join(F.coalesce("tags", F.array().cast("array<string>")), ","), doc_type=F.lit("paper"), url=F.col("id"), extra_primary_category=F.col("primary_category"),
    )


FEED = "id string, title string, summary string, published string, category array<struct<_term:string>>, primary_category struct<_term:string>"


def read_feed(spark, paths: str | list[str]) -> DataFrame:
    """Entries of Atom files as ``from_arxiv`` takes them; namespaces are ignored."""
    xml = spark.read.schema(FEED).option("rowTag", "entry").option("ignoreNamespace", True).format("xml").load(paths)
    return xml.select("id", "title", "summary", "published", F.transform("category", lambda c: c["_term"]).alias("tags"), F.col("primary_category._term").alias("primary_category"))


def iso_date(yyyymmdd: Column) -> Column:
    s = yyyymmdd.cast("string")
    return F.when(F.length(s) == 8, F.concat_ws("-", F.substring(s, 1, 4), F.substring(s, 5, 2), F.substring(s, 7, 2))).otherwise("")


def warehouse_filter(rows: DataFrame, first: int, last: int, cpc_prefix: str, kinds: list[str], share: int = 1) -> DataFrame:
    """Rows by priority date, class prefix, English abstract and kind; ``share`` n keeps a fixed n-th of them by hash."""
    keep = (
        F.col("priority_date").between(first, last)
        & F.exists("cpc", lambda c: c["code"].rlike(f"^(?:{cpc_prefix})"))
        & F.exists("abstract_localized", lambda a: a["language"] == "en")
        & F.col("kind_code").isin(kinds)
    )
    out = rows.where(keep)
    return hash_sample(out, "publication_number", share) if share > 1 else out


def hash_sample(rows: DataFrame, key: str, share: int) -> DataFrame:
    """The same n-th of all keys in every run and every engine with MD5: by the first eight hexadecimal digits."""
    return rows.where(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long") % share == 0)


def from_warehouse(rows: DataFrame) -> DataFrame:
    """Patents by priority date; rows without an English title are left out."""
    english = lambda c: F.get(F.filter(c, lambda x: x["language"] == "en"), 0)["text"]
    codes = F.transform(F.coalesce("cpc", F.array().cast("array<struct<code:string>>")), lambda c: c["code"])
    return as_docs(
        rows.where(english("title_localized").isNotNull()), source=F.lit("google_patents"), id=F.col("publication_number"), title=english("title_localized"), abstract=english("abstract_localized"),
        year=F.substring(F.col("priority_date").cast("string"), 1, 4).try_cast("int"), date=iso_date(F.col("priority_date")),
        venue=F.array_join(F.array_sort(F.array_distinct(F.transform(codes, lambda c: F.left(c, F.lit(4))))), ","), doc_type=F.lit("patent"), url=F.concat(F.lit("https://patents.google.com/patent/"), F.col("publication_number")),
        extra_country=F.col("country_code"), extra_kind=F.col("kind_code"), extra_cpc=F.slice(codes, 1, 20),
    )


#: Columns of an export that documents are made of; others are left.
CSV_COLUMNS = ("id", "title", "abstract", "assignee", "result link")


def _export_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each whole file, read by its own header: the first of the first two lines that begins with id, or the first."""
    for batch in batches:
        for rank, path, text in zip(*(batch.column(c).to_pylist() for c in ("file_rank", "path", "value"))):
            lines = enumerate(csv.reader(io.StringIO((text or "").removeprefix("\ufeff"), newline="")))
            head = list(itertools.islice(((k, line) for k, line in lines if line), 2))
            at = next((i for i, (_, line) in enumerate(head) if line[0].strip().lower() == "id"), 0)
            names: dict[str, int] = {}
            for i, name in enumerate(head[at][1] if head else ()):
                names.setdefault(name.strip().lower(), i)
            dated = next((c for c in CSV_DATES if c in names), None)
            out: dict[str, list] = {c: [] for c in ("k", *CSV_COLUMNS, "dated")}
            for k, line in (*head[at + 1 :], *lines):
                if line and line[0].strip().lower() != "id":
                    cell = lambda c: line[names[c]] if c in names and names[c] < len(line) else None  # noqa: B023, E731
                    for c, v in (("k", k), *((c, cell(c)) for c in CSV_COLUMNS), ("dated", cell(dated))):
                        out[c].append(v)
            n = len(out["k"])
            kinds = {"k": pa.int64()}
            columns = {"file_rank": pa.array([rank] * n, pa.int32())} | {c: pa.array(v, kinds.get(c, pa.string())) for c, v in out.items()}
            yield pa.RecordBatch.from_pydict(columns | {"file": pa.array([unquote(path.rsplit("/", 1)[-1])] * n, pa.string())})


def read_patent_csv(spark, paths: str | list[str]) -> DataFrame:
    """The rows of exports with or without a preamble line, in the order of ``paths``, under lower-case header names.

    All files are one scan; quoted fields may hold line breaks, so a file is read whole, in one task, by its own header. k
    orders rows within a file, file_rank files; file is the file's name; dated is the date column that comes first
    among those the file has. Columns that a file lacks are null.
    """
    every = [paths] if isinstance(paths, str) else list(paths)
    schema = "file_rank int, k long, " + ", ".join(f"`{c}` string" for c in (*CSV_COLUMNS, "dated", "file"))
    if not every:
        return spark.createDataFrame([], schema)
    whole = spark.read.text(every, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_path").alias("name"), "value")
    ranked = with_file_rank(whole, every).select("file_rank", F.col("name").alias("path"), "value")
    return ranked.mapInArrow(_export_rows, schema)


def from_patent_csv(rows: DataFrame) -> DataFrame:
    """Rows of ``read_patent_csv``: the first date column that is there gives the year; rows without one go, then the first row of an id over all files stays."""
    pick = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit("")) if c in rows.columns else F.lit("")
    date = pick("dated" if "dated" in rows.columns else next((c for c in CSV_DATES if c in rows.columns), "no date"))
    order = F.struct(*(c for c in ("file_rank", "k") if c in rows.columns))
    year = F.regexp_extract(date, r"(\d{4})", 1).try_cast("int")
    dated = rows.withColumns({"csv_year": year, "csv_date": date, "id": F.trim("id")}).where("csv_year is not null and id <> ''")
    firsts = dated.groupBy("id").agg(F.min_by(F.struct("*"), order).alias("r")).select("r.*")
    return as_docs(
        firsts, source=F.lit("google_patents"), id=F.col("id"), title=pick("title"), abstract=pick("abstract"), year=F.col("csv_year"), date=F.col("csv_date"), venue=F.lit("csv-export"), doc_type=F.lit("patent"),
        url=F.coalesce(filled(pick("result link")), F.concat(F.lit("https://patents.google.com/patent/"), F.col("id"))), extra_assignee=pick("assignee"), extra_file=F.col("file"),
    )
