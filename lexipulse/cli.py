"""Command line: fetch, analyze, report, all, test-keywords.

Fetching needs a client from outside (``--client module:function``): the engine makes the queries, keeps the ledger and
takes the waits; the client sends one request and gives back a page (``sources.fetch``).
"""

from __future__ import annotations

import argparse
import datetime
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.textnorm import normalise
from .operators import match
from .plans import analysis, report
from .sources import fetch, jsonl, search
from .taxonomy import Taxonomy, load


def session(workers: int | None = None) -> SparkSession:
    """A session; ``workers`` threads of this machine where no cluster is named."""
    b = SparkSession.builder.appName("lexipulse").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    return (b.master(f"local[{workers}]") if workers else b).getOrCreate()


#: Folder of fetched pages in a raw folder.
PAGES = "pages"


def work_of(via: str, sources: list[str], taxonomy: Taxonomy, years: range, sample_pages: int = 10, concept_pages: int = 3, most: int = 0, seed: int = 42, share: tuple[int, int] = (0, 1)) -> list[dict]:
    """The queries of a route: two pools for s2, else one a source and year; google_patents come from exports and the warehouse."""
    if via == "s2":
        return fetch.two_pool_work(taxonomy, years, sample_pages, concept_pages, share)
    return fetch.plain_work(via, [s for s in sources if s != "google_patents"], taxonomy, years, most, seed, share)


def analysed(spark: SparkSession, folder: str, taxonomy: Taxonomy, as_of_year: int, window: int, wanted: list[str] | None, keep: str | None = None, stage: str | None = None) -> analysis.Result:
    """Runs the analysis that the raw files of a folder call for.

    N-gram counts are kept in ``keep`` by source and year, documents by file, source and year in ``stage``: a later run
    parses only files that have changed, and counts only source-years whose documents have.
    """

    def read(paths: list[str], **own) -> DataFrame:
        return jsonl.staged(spark, stage, paths, **own) if stage else jsonl.read_tolerant(spark, paths).withColumns(own)

    found = jsonl.discover(spark, folder, wanted)
    pages = f"{folder}/{PAGES}"
    kinds = {r.kind for r in fetch.ledger(spark, pages).select("kind").distinct().collect()} if fetch.waves(spark, pages) else set()
    if {"concept", "sample"} <= kinds and wanted and {"arxiv", "ieee"} & set(wanted):
        raise ValueError("the fetched pools hold arxiv and ieee already: ask for s2, or use another folder")
    if {"concept", "sample"} <= kinds and (not wanted or "s2" in wanted):
        sample, pool, years, cut = fetch.two_pools(spark, pages, taxonomy)
        return analysis.two_pool(sample, pool, taxonomy, years, cut, as_of_year, recent_window=window, keep=keep)
    plain = fetch.plain_docs(spark, pages, taxonomy, wanted) if "year" in kinds else None
    if not found and plain is None:
        raise SystemExit(f"no raw documents in {folder}")
    if "s2" in found:
        metas = [json.loads(jsonl.read_text(spark, path)) for n, (path, _, _) in sorted(jsonl.listing(spark, folder).items()) if n.startswith("s2_meta") and n.endswith(".json")]
        years, cut = jsonl.pool_meta(spark, metas)
        return analysis.two_pool(read([f"{folder}/s2_sample.jsonl"]), read(found["s2"]), taxonomy, years, cut, as_of_year, recent_window=window, keep=keep)
    docs, meta = plain or (None, None)
    for source, paths in found.items():
        one = read(paths, source=F.lit(source))
        total = jsonl.year_totals(spark, source, jsonl.sidecar(spark, paths[0]))
        docs, meta = (one, total) if docs is None else (docs.unionByName(one, allowMissingColumns=True), meta.unionByName(total))
    return analysis.plain(docs, taxonomy, as_of_year, window, meta, keep=keep)


def tested(spark: SparkSession, taxonomy: Taxonomy, text: str) -> dict[str, dict[str, int]]:
    """Concepts and synonyms of one text, whether or not it lies in the domain."""
    one = spark.createDataFrame([(text,)], "text string").select(normalise(F.col("text")).alias("text"))
    row = match.matched(one, taxonomy, gated=False).select("hits").first()
    return {h.concept: {s.synonym: s.n for s in h.synonyms} for h in row.hits}


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="lexipulse")
    p.add_argument("--taxonomy", required=True)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("fetch", "analyze", "report", "all"):
        c = sub.add_parser(name)
        c.add_argument("raw")
        if name in ("fetch", "all"):
            c.add_argument("--client", required=name == "fetch", help="module:function that sends one request")
            c.add_argument("--via", choices=["s2", "openalex", "direct"], default="s2", help="s2: two pools; openalex; direct: each source's own service")
            c.add_argument("--source", nargs="+", default=["ieee", "arxiv"], choices=["arxiv", "ieee", "google_patents"])
            c.add_argument("--years", default="2014-2026")
            c.add_argument("--max-per-year", type=int, default=0, help="openalex: a sample of that many a source and year; 0: all")
            c.add_argument("--seed", type=int, default=42, help="of that sample")
            c.add_argument("--sample-pages", type=int, default=10, help="s2: pages of the domain's query a year")
            c.add_argument("--max-pages-concept", type=int, default=3, help="s2: pages of a concept's query a year")
            c.add_argument("--lanes", type=int, default=3, help="requests at a time")
            c.add_argument("--pause", type=float, default=1.0, help="seconds between pages of a query")
            c.add_argument("--shard", default="0/1", help="part i of n, as i/n")
        if name == "fetch":
            continue
        c.add_argument("out")
        c.add_argument("--workers", type=int, help="threads of this machine; without it, the session's own master")
        c.add_argument("--sources", nargs="*")
        c.add_argument("--recent-window", type=int, default=3)
        c.add_argument("--as-of-year", type=int, default=datetime.date.today().year)
        c.add_argument("--main-source", default="all")
        c.add_argument("--keep", help="folder for n-gram counts kept between runs")
        c.add_argument("--stage", help="folder for documents by source and year kept between runs")
    sub.add_parser("test-keywords").add_argument("text")
    a = p.parse_args(argv)
    taxonomy = load(a.taxonomy)
    spark = session(getattr(a, "workers", None))
    if getattr(a, "client", None):
        index, _, of = a.shard.partition("/")
        work = work_of(a.via, a.source, taxonomy, search.year_range(a.years), a.sample_pages, a.max_pages_concept, a.max_per_year, a.seed, (int(index), int(of or 1)))
        print(fetch.fetch(spark, a.client, f"{a.raw}/{PAGES}", work, a.lanes, pause=a.pause), "queries done")
    if a.command == "fetch":
        return
    if a.command == "test-keywords":
        print(tested(spark, taxonomy, a.text))
        return
    result = analysed(spark, a.raw, taxonomy, a.as_of_year, a.recent_window, a.sources, a.keep, a.stage)
    if a.command in ("analyze", "all"):
        result.write(a.out)
    if a.command in ("report", "all"):
        report.build(result, a.main_source, a.out if a.command == "report" else f"{a.out}/report.html")


if __name__ == "__main__":
    main()
