"""Fetching by a client from outside: a data source whose tasks ask page by page, and the ledger of what is done.

A piece of work is one query for one year: of the domain (kind ``sample``, or ``year`` for plain sources) or of a concept
(kind ``concept``). The data source makes a few lanes of them, each a task that asks its pieces one after the other, with
the waits of the route; a piece gives a row a record and, at its end, one row with the query's total and the number of
records. Work is done in waves. A wave is one folder, written by Spark and whole once its success marker is there, so the
waves are their own ledger: records and totals are committed together, and a wave that was cut short does not exist.
Before each wave the open work is an anti join of all work with the whole waves, which other shards may have written
meanwhile. A changed query is other work; rows of queries no longer asked for are not read.
"""

from __future__ import annotations

import importlib
import json
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..taxonomy import Taxonomy
from . import records, search
from .jsonl import hadoop_path, is_whole

#: A piece of work: which query, how many pages and records at most (0: all), the seed of a sample drawn by the server.
WORK = "route string, kind string, key string, year int, query string, pages int, most int, seed int"
#: A record as JSON text, or null in the last row of a piece, which has its total and what was fetched.
PAGE = "route string, kind string, key string, year int, query string, total long, fetched long, record string"
WHAT = ("route", "kind", "key", "year", "query")

#: One page: {route, kind, key, query, year, token, most, seed} -> {total, records, token} or {wait: seconds or None}.
Client = Callable[[dict], dict]


def client_of(path: str) -> Client:
    """The function of ``module:function``."""
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def asked(client: Client, item: dict, pause: float = 0.0, sleep: Callable[[float], None] = time.sleep) -> Iterator[tuple]:
    """The rows of a piece of work."""
    what, token, total, n, page = tuple(item[c] for c in WHAT), None, 0, 0, 0

    def once():
        got = client({c: item[c] for c in (*WHAT, "most", "seed")} | {"token": token})
        return ("records" in got), got, got.get("wait")

    while True:
        got = search.BACKOFF[item["route"]].call(once, sleep)
        total, page = max(total, int(got.get("total") or 0)), page + 1
        for record in got["records"]:
            if item["most"] and n >= item["most"]:
                break
            n += 1
            yield (*what, None, None, json.dumps(record, ensure_ascii=False))
        token = got.get("token")
        if token is None or not got["records"] or item["pages"] and page >= item["pages"] or item["most"] and n >= item["most"]:
            break
        sleep(pause)
    yield (*what, total, n, None)


class Pages(DataSource):
    """Options: client (module:function), work (JSON list), lanes, pause."""

    @classmethod
    def name(cls) -> str:
        return "lexipulse_pages"

    def schema(self) -> str:
        return PAGE

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.client, self.pause = options["client"], float(options.get("pause", "0"))
        self.work, self.lanes = json.loads(options["work"]), int(options.get("lanes", "3"))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(part) for i in range(self.lanes) if (part := self.work[i :: self.lanes])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        client = client_of(self.client)
        for item in partition.value:
            yield from asked(client, item, self.pause)


def waves(spark: SparkSession, folder: str) -> list[str]:
    """The whole waves of a folder."""
    fs, where = hadoop_path(spark, folder)
    names = sorted(s.getPath().toString() for s in fs.listStatus(where)) if fs.exists(where) else []
    return [p for p in names if p.rsplit("/", 1)[-1].startswith("wave-") and is_whole(spark, p)]


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of all whole waves."""
    found = waves(spark, folder)
    return spark.read.schema(PAGE).parquet(*found) if found else spark.createDataFrame([], PAGE)


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """route, kind, key, year, query, total, fetched of all work that is done; should two shards have done the same, the larger counts."""
    done = pages(spark, folder).where("record is null")
    return done.groupBy(*WHAT).agg(F.max(F.struct("total", "fetched")).alias("t")).select(*WHAT, "t.*")


def fetch(spark: SparkSession, client: str, folder: str, work: list[dict], lanes: int = 3, wave: int | None = None, pause: float = 0.0) -> int:
    """Does the open work in waves of ``wave`` pieces; returns how many were done. ``folder`` may lie on any file system."""
    spark.dataSource.register(Pages)
    every = spark.createDataFrame([tuple(w[c.split()[0]] for c in WORK.split(", ")) + (i,) for i, w in enumerate(work)], WORK + ", at int")
    n = 0
    while True:
        todo = every.join(pages(spark, folder).where("record is null").select(*WHAT), list(WHAT), "left_anti").orderBy("at").limit(wave or lanes).collect()
        if not todo:
            return n
        items = json.dumps([work[r["at"]] for r in todo], ensure_ascii=False)
        read = spark.read.format(Pages.name()).option("client", client).option("work", items).option("lanes", str(lanes)).option("pause", str(pause)).load()
        read.write.parquet(f"{folder}/wave-{time.time_ns():020d}-{uuid.uuid4().hex}")
        n += len(todo)


def _piece(route: str, kind: str, key: str, year: int, query: str, pages: int = 0, most: int = 0, seed: int = 0) -> dict:
    return {"route": route, "kind": kind, "key": key, "year": year, "query": query, "pages": pages, "most": most, "seed": seed}


def two_pool_work(taxonomy: Taxonomy, years: range, sample_pages: int = 10, concept_pages: int = 3, share: tuple[int, int] = (0, 1)) -> list[dict]:
    """A sample of the domain's query by year, and each concept's query by year.

    ``share`` (index, of) is one worker's part of the concepts, by their place in the taxonomy; worker 0 samples.
    """
    domain = search.bulk_query(taxonomy.domain_terms)
    out = [_piece("s2", "sample", "domain", y, domain, sample_pages) for y in years] if share[0] == 0 else []
    for c in search.shard(list(taxonomy.concepts), *share):
        if query := search.concept_query(c.synonyms, c.s2_extra):
            out += [_piece("s2", "concept", c.key, y, query, concept_pages) for y in years]
    return out


def plain_work(route: str, sources: list[str], taxonomy: Taxonomy, years: range, most: int = 0, seed: int = 42, share: tuple[int, int] = (0, 1)) -> list[dict]:
    """The domain's query by source and year; ``most`` asks the server for a sample of that size, drawn with ``seed``."""
    build = {"openalex": search.openalex_query, "ieee": search.ieee_query, "arxiv": search.arxiv_query}
    return search.shard([_piece(r, "year", s, y, build[r](taxonomy.domain_terms), 0, most, seed) for s in sources for r in [route if route != "direct" else s] for y in years], *share)


QUERY = ("route", "kind", "key", "query")


def _asked_for(rows: DataFrame, work: list[dict]) -> DataFrame:
    """The rows of the queries of ``work``, whatever the year; rows of queries that have changed since go."""
    queries = {tuple(w[c] for c in QUERY) for w in work}
    return rows.join(rows.sparkSession.createDataFrame(sorted(queries), "route string, kind string, key string, query string"), list(QUERY), "left_semi")


def _records(spark: SparkSession, folder: str, work: list[dict], kind: str) -> DataFrame:
    rows = pages(spark, folder).where((F.col("kind") == kind) & F.col("record").isNotNull())
    return _asked_for(rows, work).select("route", "key", F.col("year").alias("asked"), "record")


def two_pools(spark: SparkSession, folder: str, taxonomy: Taxonomy) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(sample, pool, year_meta, cut) as the two-pool analysis takes them."""
    work = two_pool_work(taxonomy, range(1))

    def docs(kind: str, **more) -> DataFrame:
        r = _records(spark, folder, work, kind).select("key", "asked", F.from_json("record", records.S2_RECORD).alias("r")).select("key", "asked", "r.*")
        return records.from_semantic_scholar(r, kind, F.col("asked"), **more)

    done = _asked_for(ledger(spark, folder), work)
    years = done.where("kind = 'sample'").select("year", F.col("total").alias("domain_total"))
    cut = done.where("kind = 'concept'").select(F.col("key").alias("concept"), "year", "total", "fetched")
    return docs("sample"), docs("concept", retrieved_for=F.col("key")), years, cut


def plain_docs(spark: SparkSession, folder: str, taxonomy: Taxonomy, wanted: list[str] | None = None) -> tuple[DataFrame, DataFrame] | None:
    """(documents, source-year totals) as the plain analysis takes them, or None where no plain source was asked."""
    done = ledger(spark, folder).where("kind = 'year'")
    made = sorted((r.route, r.key) for r in done.select("route", "key").distinct().collect() if not wanted or r.key in wanted)  # a row a source
    work = [w for route, source in made for w in plain_work(route, [source], taxonomy, range(1))]
    rows, out = _records(spark, folder, work, "year"), None
    kinds = {"openalex": records.OPENALEX_RECORD, "ieee": records.IEEE_RECORD, "arxiv": records.ARXIV_RECORD}
    for route, source in made:
        r = rows.where((F.col("route") == route) & (F.col("key") == source)).select("asked", F.from_json("record", kinds[route]).alias("r")).select("asked", "r.*")
        one = records.from_openalex(r, source) if route == "openalex" else records.from_ieee(r, F.col("asked")) if route == "ieee" else records.from_arxiv(r)
        out = one if out is None else out.unionByName(one)
    return (out, _asked_for(done, work).groupBy(F.col("key").alias("source"), "year").agg(F.max("total").alias("total"))) if made else None
