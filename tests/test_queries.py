import glob
import math
import os

import duckdb
import pytest

from lexipulse.queries import oracle_sql, queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple("nan" if isinstance(r[i], float) and math.isnan(r[i]) else r[i] for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = queries()[name](spark, FOLDER)
    got = duck.execute(oracle_sql()[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    want = rows_of(got.fetchall(), columns)
    have = rows_of([tuple(r) for r in df.collect()], df.columns)
    assert have == [tuple(float(v) if isinstance(h, float) and not isinstance(v, str) else v for v, h in zip(w, r)) for w, r in zip(want, have)] and len(want) == len(have)


def test_emerging_terms_read_documents_by_source_year(spark):
    """What all queries of emerging terms read: a year is on few partitions, so tasks add up its terms."""
    from lexipulse.queries import _prose_matched

    m = _prose_matched(spark, FOLDER)
    try:
        years = [r.n for r in m.selectExpr("year", "spark_partition_id() AS p").distinct().groupBy("p").agg({"year": "count"}).toDF("p", "n").collect()]
    finally:
        m.unpersist()
    assert len(years) > 1 and sum(years) <= 13 + len(years) - 1


def test_emerging_terms_match_no_concepts(spark):
    """Only the domain is asked of the texts that are kept, and the JVM asks it: no worker holds batches of texts for it."""
    from lexipulse.queries import _prose_matched

    m = _prose_matched(spark, FOLDER)
    try:
        assert "ArrowEvalPython" not in m._jdf.queryExecution().executedPlan().toString()
    finally:
        m.unpersist()


def test_emerging_texts_stay_out_of_the_heap(spark):
    """All texts, read by several scans, are written once: nothing of them is kept in the executors' memory."""
    from lexipulse.queries import _prose_matched

    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    m = _prose_matched(spark, FOLDER)
    want = spark.read.parquet(f"{FOLDER}/documents.parquet").selectExpr("cast(2014 + doc_id % 13 as int) AS year", "cast(doc_id as string) AS id", "text")
    assert sorted(map(str, m.select("year", "id", "text").collect())) == sorted(map(str, want.collect()))
    assert not m.storageLevel.useMemory and "InMemoryTableScan" not in m._jdf.queryExecution().executedPlan().toString()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_coverage_needs_no_python(spark):
    """N-grams are ASCII without entities: their concepts are found by the JVM, with no worker beside those of the scans."""
    from lexipulse.fixtures import PROSE
    from lexipulse.operators import emerging

    want = {"mit": "", "this year": "THAT", "with from": "", "und der that": "THAT,UND", "und": "", "withal": "", "with-x v2.5": "WITH"}  # acronyms match their case alone
    out = emerging.with_coverage(spark.createDataFrame([(t,) for t in want], "term string").coalesce(1), PROSE)
    assert dict(map(tuple, out.collect())) == want
    assert "ArrowEvalPython" not in out._jdf.queryExecution().executedPlan().toString()
