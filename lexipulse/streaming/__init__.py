"""Optional streaming: additive counts kept up to date while raw files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import match, measures
from ..plans.analysis import prepared
from ..schema import DOC
from ..taxonomy import Taxonomy


def document_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """New JSON-lines files of a folder as documents; malformed lines have no id and are left out."""
    return spark.readStream.schema(DOC).option("maxFilesPerTrigger", files_per_trigger).json(folder).where("id is not null and year is not null")


def additive(docs: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """source, year, concept (null for totals), docs, in_domain: the counts that sums of batches keep right."""
    m = match.with_matches(prepared(docs), taxonomy)
    total = m.groupBy("source", "year").agg(F.count("*").alias("docs"), F.count_if("in_domain").alias("in_domain")).withColumn("concept", F.lit(None).cast("string"))
    hits = measures.concept_counts(m).select("source", "year", "concept", F.col("docs_raw").alias("docs"), F.col("docs_raw").alias("in_domain"))
    return total.select("source", "year", "concept", "docs", "in_domain").unionByName(hits)


def start(stream: DataFrame, taxonomy: Taxonomy, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes each batch's counts under its number; a repeated batch overwrites itself, so sums count every file once."""

    def write(batch: DataFrame, number: int) -> None:
        additive(batch, taxonomy).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current(spark: SparkSession, out: str) -> DataFrame:
    """The sums over all batches."""
    return spark.read.parquet(out).groupBy("source", "year", "concept").agg(F.sum("docs").alias("docs"), F.sum("in_domain").alias("in_domain"))
