"""JSON-lines documents: strict and tolerant scans, staging by year, sidecars, file discovery, sinks."""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import DOC


def read_strict(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Documents of well-formed files; a malformed line ends the job, blank lines do not count."""
    return spark.read.schema(DOC).option("mode", "FAILFAST").json(paths)


def full_paths(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths as scans report them: with scheme and authority, escaped."""
    fs, _ = hadoop_path(spark, ".")
    home, root = fs.getWorkingDirectory().toString(), fs.getUri().toString().rstrip("/")
    plain = lambda p: p if re.match(r"[A-Za-z][\w+.-]*:", p) else root + p if p.startswith("/") else f"{home}/{p}"
    whole = (re.sub("^file:/+", "file:/", plain(p)) for p in paths)
    return [f"{s}:{quote(rest, safe=SAFE)}" for s, _, rest in (p.partition(":") for p in whole)]


#: Characters that a path keeps unescaped.
SAFE = "/:@!$&'()*+,;=~-._"
#: Files whose places are broadcast at most; more are joined as any table.
MOST_PATHS = 100_000


def with_file_rank(rows: DataFrame, paths: list[str]) -> DataFrame:
    """``rows`` with file_rank, the place in ``paths`` of the file in column ``path``, which goes."""
    place: dict[str, int] = {}
    for i, p in enumerate(full_paths(rows.sparkSession, paths)):
        place.setdefault(p, i)
    ranks = rows.sparkSession.createDataFrame(list(place.items()), "path string, file_rank int")
    at = rows.withColumn("path", F.regexp_replace("path", "^file:/+", "file:/"))
    return at.join(F.broadcast(ranks) if len(place) <= MOST_PATHS else ranks, "path", "left").fillna(len(paths), ["file_rank"]).drop("path")


def read_tolerant(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Documents with file_rank (place of the file in ``paths``) and line_key (order key of the line in its file).

    Malformed lines, such as the last of a file still being written, and lines without a four-digit year are left out.
    All files are one scan. A line's key is the start of its split and a number that grows within a task.
    """
    lines = spark.read.text(paths) if paths else spark.createDataFrame([], "value string").withColumn("_metadata", F.struct(F.lit("").alias("file_path"), F.lit(0).cast("long").alias("file_block_start")))
    lines = lines.select(F.col("_metadata.file_path").alias("path"), F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("n")).alias("line_key"), "value")
    lines = with_file_rank(lines, paths)
    bad = T.StructType([*DOC.fields, T.StructField("_bad", T.StringType())])
    parsed = lines.withColumn("d", F.from_json("value", bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return parsed.where("d is not null and d._bad is null and d.id is not null and d.year between 1000 and 9999").select("d.*", "file_rank", "line_key").drop("_bad")


def year_of_line(line: Column) -> Column:
    """The first "year" of a raw line, or null: decides the partition before the line is parsed."""
    return F.regexp_extract(line, r'"year":\s*(\d{4})', 1).try_cast("int")


def tagged(docs: DataFrame) -> DataFrame:
    """The documents' tags as ``sources``: those of extra, else the source alone."""
    return docs.withColumn("sources", F.coalesce("extra.sources", F.array("source")))


def stage(docs: DataFrame, path: str) -> None:
    """Writes documents by source and year; later scans read only the partitions they need."""
    docs.write.mode("overwrite").partitionBy("source", "year").parquet(path)


def staged(spark: SparkSession, folder: str, paths: list[str], **own: Column) -> DataFrame:
    """The documents of the files, as ``read_tolerant`` gives them, by source and year in ``folder``.

    Each file is kept under its name, size and time of change, so only files that are new or have changed are parsed,
    all of them in one scan. ``own`` columns stand in for those of the lines.
    """
    keys = [fingerprint(spark, [p], *sorted(own)) for p in paths]

    def parsed(missing: list[str]) -> DataFrame:
        docs = read_tolerant(spark, [paths[keys.index(k)] for k in missing]).withColumns(own)
        return docs.withColumn("mark", F.element_at(F.array(*map(F.lit, missing)), F.col("file_rank") + 1)).drop("file_rank")

    schema = read_tolerant(spark, []).drop("file_rank").withColumn("mark", F.lit("")).schema
    rows = kept_parts(spark, f"{folder}/documents", list(dict.fromkeys(keys)), schema, parsed, "source", "year")
    place = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "mark string, file_rank int").dropDuplicates(["mark"])
    return rows.join(place, "mark").drop("mark").select(*DOC.names, "file_rank", "line_key")


def kept_parts(spark: SparkSession, folder: str, marks: list[str], schema: T.StructType, make: Callable[[list[str]], DataFrame], *by: str) -> DataFrame:
    """The rows of all ``marks`` (column mark): those that ``folder`` holds, and those of ``make(missing)``, written there first.

    A part is one write of some marks, partitioned by mark and ``by``. It counts once its list of marks stands beside it,
    which is written last, so a part cut short is not there; of parts with the same mark the first counts. Reading
    touches only the partitions of the marks asked for.
    """
    have: dict[str, str] = {}
    for name, (path, _, _) in sorted(listing(spark, folder).items()):
        if name.endswith(".marks"):
            for m in json.loads(read_text(spark, path)):
                have.setdefault(m, path.removesuffix(".marks"))
    if missing := [m for m in marks if m not in have]:
        part = f"{folder}/part-{time.time_ns():020d}-{uuid.uuid4().hex}"
        make(missing).write.partitionBy("mark", *by).parquet(part)
        write_text(spark, f"{part}.marks", json.dumps(missing))
        have |= dict.fromkeys(missing, part)
    rows = spark.createDataFrame([], schema)
    for part in sorted({have[m] for m in marks}):
        rows = rows.unionByName(spark.read.schema(schema).parquet(part).where(F.col("mark").isin([m for m in marks if have[m] == part])))
    return rows


def fingerprint(spark: SparkSession, paths: list[str], *parts: object) -> str:
    """A key of raw files (path, size, time of change) and whatever else a derived table depends on."""
    files = []
    for p in sorted(paths):
        fs, where = hadoop_path(spark, p)
        status = fs.getFileStatus(where)
        files.append((where.toString(), status.getLen(), status.getModificationTime()))
    return hashlib.sha256(json.dumps([files, [str(x) for x in parts]]).encode()).hexdigest()[:20]


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of any path that Spark can read."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def is_whole(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    fs, where = hadoop_path(spark, f"{path}/_SUCCESS")
    return fs.exists(where)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, on any file system that Spark writes to."""
    fs, where = hadoop_path(spark, path)
    out = fs.create(where, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """One small file, from any file system that Spark reads."""
    fs, where = hadoop_path(spark, path)
    stream = fs.open(where)
    try:
        return str(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def listing(spark: SparkSession, folder: str) -> dict[str, tuple[str, int, int]]:
    """name -> (path, bytes, time of change) of what lies in a folder, a folder in it by what it holds; none if it is not there."""
    fs, where = hadoop_path(spark, folder)
    if not fs.exists(where):
        return {}
    size = lambda x: fs.getContentSummary(x.getPath()).getLength() if x.isDirectory() else x.getLen()
    return {x.getPath().getName(): (x.getPath().toString(), size(x), x.getModificationTime()) for x in fs.listStatus(where)}


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_table(df: DataFrame, path: str, *order) -> None:
    """A small result table as one CSV file with a header, in the given order."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of ``write_table``; a missing or empty folder gives an empty table."""
    if not any(n.endswith(".csv") and size > 5 for n, (_, size, _) in listing(spark, path).items()):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).csv(path)


def sidecar(spark: SparkSession, path: str) -> dict:
    """<stem>_meta.json beside a raw file, or an empty dict."""
    meta = path.rsplit(".", 1)[0] + "_meta.json"
    fs, where = hadoop_path(spark, meta)
    return json.loads(read_text(spark, meta)) if fs.exists(where) else {}


def year_totals(spark: SparkSession, source: str, meta: dict) -> DataFrame:
    """source, year, total of a plain sidecar."""
    rows = [(source, int(y), int(v["total"])) for y, v in meta.get("years", {}).items()]
    return spark.createDataFrame(rows, "source string, year int, total long")


def pool_meta(spark: SparkSession, metas: list[dict]) -> tuple[DataFrame, DataFrame]:
    """(year, domain_total) and (concept, year, total, fetched) of two-pool sidecars; a later file wins a concept-year."""
    years = {int(y): int(v["domain_total"]) for m in metas[:1] for y, v in m.get("years", {}).items()}
    cut = {(k, int(y)): (int(v.get("total", 0)), int(v.get("fetched", 0))) for m in metas for k, d in m.get("concepts", {}).items() for y, v in d.items()}
    return spark.createDataFrame(list(years.items()), "year int, domain_total long"), spark.createDataFrame([(*k, *v) for k, v in cut.items()], "concept string, year int, total long, fetched long")


#: source -> raw files in order of preference when equally new
CANDIDATES = {"arxiv": ("arxiv_direct.jsonl", "openalex_arxiv.jsonl"), "ieee": ("ieee_direct.jsonl", "openalex_ieee.jsonl"), "google_patents": ("google_patents.jsonl",)}


def discover(spark: SparkSession, folder: str, wanted: list[str] | None = None) -> dict[str, list[str]]:
    """source -> raw files. The two-pool set counts if concepts, sample and sidecar are there; then it stands for arxiv and ieee.

    Asking for arxiv or ieee beside a two-pool set is ambiguous and refused.
    """
    filled = {n: x for n, x in sorted(listing(spark, folder).items()) if x[1] > 0}
    out: dict[str, list[str]] = {}
    pools = [path for n, (path, _, _) in filled.items() if re.fullmatch(r"s2_concepts.*\.jsonl", n)]
    if pools and "s2_sample.jsonl" in filled and "s2_meta.json" in filled and (not wanted or {"s2", "arxiv", "ieee"} & set(wanted)):
        if wanted and {"arxiv", "ieee"} & set(wanted):
            raise ValueError("the two-pool data hold arxiv and ieee already: ask for s2, or move its files")
        out["s2"] = pools
    for source, names in CANDIDATES.items():
        if (wanted and source not in wanted) or ("s2" in out and source in ("arxiv", "ieee")):
            continue
        if found := [filled[n] for n in names if n in filled]:
            out[source] = [max(found, key=lambda x: x[2])[0]]
    return out
