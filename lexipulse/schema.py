"""Row types of documents, scale metadata and taxonomies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys of ``extra`` over all sources; a source leaves the others null.
EXTRA = T.StructType([
    T.StructField("pool", T.StringType()),
    T.StructField("sources", T.ArrayType(T.StringType())),
    T.StructField("doi", T.StringType()),
    T.StructField("arxiv", T.StringType()),
    T.StructField("cited_by", T.LongType()),
    T.StructField("types", T.ArrayType(T.StringType())),
    T.StructField("retrieved_for", T.StringType()),
    T.StructField("openalex_id", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("pmid", T.StringType()),
    T.StructField("content_type", T.StringType()),
    T.StructField("citing_paper_count", T.LongType()),
    T.StructField("primary_category", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("cpc", T.ArrayType(T.StringType())),
    T.StructField("assignee", T.StringType()),
    T.StructField("file", T.StringType()),
])

TEXTS = ("source", "id", "title", "abstract")
DETAILS = ("date", "venue", "doc_type", "url")
DOC = T.StructType([*(T.StructField(c, T.StringType()) for c in TEXTS), T.StructField("year", T.IntegerType()), *(T.StructField(c, T.StringType()) for c in DETAILS), T.StructField("extra", EXTRA)])


def as_docs(df: DataFrame, **columns: Column) -> DataFrame:
    """Projects ``df`` to DOC: named columns where given, empty text or null elsewhere; keys of extra are ``extra_<key>``."""
    extra = F.struct(*(columns.get(f"extra_{f.name}", F.lit(None)).cast(f.dataType).alias(f.name) for f in EXTRA))
    text = {c: F.coalesce(columns.get(c, F.lit("")).cast("string"), F.lit("")) for c in (*TEXTS, *DETAILS)}
    return df.select(*(text[c].alias(c) for c in TEXTS), columns["year"].cast("int").alias("year"), *(text[c].alias(c) for c in DETAILS), extra.alias("extra"))


def full_text(title: Column, abstract: Column) -> Column:
    """Title, stop, abstract; a null part counts as empty."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.coalesce(abstract, F.lit("")))


def has_abstract(abstract: Column) -> Column:
    return F.length(F.trim(F.regexp_replace(F.coalesce(abstract, F.lit("")), r"(?U)\s+", " "))) > 0


def citations(extra: Column) -> Column:
    """The first count that is there and not zero, else zero."""
    return F.coalesce(F.nullif(extra["cited_by"], F.lit(0)), F.nullif(extra["citing_paper_count"], F.lit(0)), F.lit(0)).cast("long")


#: Rows and bytes of an Arrow batch that goes to Python, whatever the length of its texts.
BATCH_ROWS, BATCH_BYTES = 4096, 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches that later plans of this session send to Python; the settings stay, as results are lazy."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def spread(docs: DataFrame) -> DataFrame:
    """``docs`` in as many partitions as there are cores, where a scan has fewer: one small file would be one task."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs
