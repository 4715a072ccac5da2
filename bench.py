"""Times the headline queries and prints one JSON line; each figure also goes to the error output as it comes.

``end_to_end`` is a whole analysis of all documents under a taxonomy of 47 concepts, 437 synonyms and 57 domain terms, in
documents a second; it is no part of ``value``, and null if it takes more than ``BENCH_MOST`` seconds (300).
"""

from __future__ import annotations

import itertools
import json
import os
import sys
import threading
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lexipulse.fixtures import prose_docs
from lexipulse.functions.textnorm import normalise
from lexipulse.operators import emerging, match, measures
from lexipulse.queries import queries
from lexipulse.schema import spread
from lexipulse.taxonomy import Taxonomy, from_dict

HEADLINE = ("concept_year", "growth", "lift_jaccard", "examples_top3", "synonym_year", "phrase_vs_acronym", "normalise_full", "tokenise", "ngram_df", "burst_scores")


def taxonomy_47() -> Taxonomy:
    """Words of two and three syllables, dealt to 47 concepts."""
    parts = ("er", "an", "on", "th", "in", "re", "at", "ou", "ble", "tion", "ing", "he")
    words = [*map("".join, itertools.product(parts, parts)), *map("".join, itertools.product(parts, parts, parts))]
    domain, words = words[:57], words[57 : 57 + 437]
    return from_dict({"domain_terms": ["the", "die", "la", "le", *domain[4:]], "categories": {"c": {f"K{k}": {"synonyms": words[k::47]} for k in range(47)}}})


def end_to_end(spark: SparkSession, folder: str) -> float:
    """Documents a second of normalising, matching, counting concepts and synonyms, and n-grams."""
    taxonomy, began = taxonomy_47(), time.perf_counter()
    docs = spread(prose_docs(spark, folder)).withColumns({"source": F.lit("all"), "text": normalise(F.col("text"))})
    m = match.matched(docs, taxonomy).persist()
    for out in (measures.concept_counts(m), measures.synonym_year(m), emerging.ngram_df(m.where("in_domain"))):
        out.write.format("noop").mode("overwrite").save()
    n = m.count()
    m.unpersist()
    return n / (time.perf_counter() - began)


def bounded(spark: SparkSession, most: float, work) -> float | None:
    """What ``work`` returns, or None if its jobs had to be cancelled after ``most`` seconds."""
    timer = threading.Timer(most, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        return work()
    except Exception as e:
        print("stopped:", str(e)[:200], file=sys.stderr)
        return None
    finally:
        timer.cancel()


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.files.maxPartitionBytes", "4m").config("spark.log.level", "ERROR").getOrCreate()
    )
    known, took = queries(), {}
    for name in HEADLINE:
        began = time.perf_counter()
        known[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    rate = bounded(spark, float(os.environ.get("BENCH_MOST", "300")), lambda: round(end_to_end(spark, folder), 1))
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "end_to_end": {"docs_per_sec": rate, "concepts": 47, "synonyms": 437}}))


if __name__ == "__main__":
    main()
