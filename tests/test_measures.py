import math
import random

import pytest
from pyspark.sql import functions as F

from lexipulse.operators import emerging, measures
from lexipulse.plans import analysis
from lexipulse.schema import DOC
from lexipulse.taxonomy import from_dict

TAX = from_dict({"domain_terms": ["chip"], "categories": {"c": {"GAN": {"synonyms": ["GaN"]}, "SIC": {"synonyms": ["SiC"]}, "ZERO": {"synonyms": ["nothing at all"]}}}})


def doc(source, i, title, year, cited=0, sources=None, retrieved=None, abstract="a chip"):
    extra = {f.name: None for f in DOC["extra"].dataType.fields} | {"cited_by": cited, "sources": sources, "retrieved_for": retrieved}
    return (source, i, title, abstract, year, "", "", "", f"u{i}", tuple(extra.values()))


def test_growth_cases(spark):
    rows = []
    for y, (d, n) in {2015: (1, 10), 2016: (2, 10), 2018: (4, 20), 2019: (9, 20), 2020: (9, 20), 2021: (5, 10), 2022: (99, 100)}.items():
        rows += [("s", "c", "A", "A", y, float(d), d, float(n), 100.0 * d / n, float(d), y == 2022), ("s", "c", "Z", "Z", y, 0.0, 0, float(n), 0.0, 0.0, y == 2022)]
    cy = spark.createDataFrame(rows, "source string, category string, concept string, label string, year int, docs double, docs_raw long, in_domain_total double, share_pct double, est_docs double, partial_year boolean")
    got = {r.concept: r for r in measures.growth(cy, 2022).collect()}
    a, z = got["A"], got["Z"]
    assert (a.recent_years, a.prior_years) == ("2019-2021", "2015-2018")  # windows are years present
    assert (a.docs_total, a.docs_recent, a.docs_prior) == (129, 23, 7)
    rec, pri, eps = 100 * 23 / 50, 100 * 7 / 40, 100 / 40
    assert math.isclose(a.growth_ratio, (rec + eps) / (pri + eps)) and math.isclose(a.delta_pp, rec - pri)
    assert a.first_year_ge3 == 2018 and a.peak_year == 2021
    assert z.peak_year is None and z.first_year_ge3 is None and z.growth_ratio == 1.0
    few = measures.growth(cy.where("year > 2020"), 2022).where("concept = 'A'").first()
    assert math.isnan(few.slope_pp_per_year) and few.prior_years == "" and few.docs_prior == 0
    assert math.isclose(few.growth_ratio, (50 + 100) / 100)  # no prior denominator
    tie = measures.growth(cy.where("year in (2018, 2016)"), 2022).where("concept = 'A'").first()
    assert tie.peak_year == 2016


def test_plain_run(spark):
    docs = [doc("x", "1", "GaN one", 2019, 5), doc("x", "1", "GaN again", 2019, 9), doc("x", "1", "GaN later", 2020, 1), doc("x", "2", "GaN and SiC", 2020, 7), doc("x", "3", "plain", 2020), doc("x", "4", "GaN", 2020, abstract=None), doc("y", "5", "SiC", 2020, 2)]
    df = spark.createDataFrame(docs, DOC).withColumn("file_rank", F.lit(0)).withColumn("line_key", F.monotonically_increasing_id())
    r = analysis.plain(df, TAX, 2021)
    t = {(x.source, x.year): x for x in r.totals.collect()}
    assert (t["x", 2020].fetched, t["x", 2020].in_domain_analysed, t["x", 2020].abstract_rate) == (4, 3, 0.75)
    assert t["all", 2020].fetched == 5 and math.isnan(t["all", 2020].abstract_rate)
    cy = {(x.source, x.concept, x.year): x.docs_raw for x in r.concept_year.collect()}
    assert cy["x", "GAN", 2019] == 1 and cy["x", "GAN", 2020] == 2 and cy["all", "SIC", 2020] == 2 and cy["y", "ZERO", 2020] == 0
    co = r.cooccurrence.collect()
    assert [(c.source, c.concept_a, c.concept_b, c.docs_both, c.docs_a, c.docs_b) for c in co] == [("x", "GAN", "SIC", 1, 3, 1)]
    ex = [(e.id, e.year, e.cited) for e in analysis.in_order(r.examples, "examples").where("source = 'x' and concept = 'GAN'").collect()]
    assert ex == [("2", 2020, 7), ("1", 2019, 5)]  # one row an id, the first of its copies
    s = r.summary().first()
    assert (s.docs_analysed, s.docs_in_domain_analysed, s.years) == (6, 5, [2019, 2020])
    assert r.emerging.count() == 0


def test_empty_corpus(spark):
    r = analysis.plain(spark.createDataFrame([], DOC), TAX, 2021)
    for name in analysis.ORDER:
        assert analysis.in_order(getattr(r, name), name).count() == 0


def test_two_pool(spark):
    sample = [doc("s2", "a", "x", 2020, sources=["all", "ieee"]), doc("s2", "b", "x", 2020, sources=["all"]), doc("s2", "c", "x", 2020, sources=["all"], abstract=""), doc("s2", "d", "x", 2021, sources=["all"]), doc("s2", "e", "x", 1999, sources=["all"])]
    pool = [
        doc("s2", "p", "GaN SiC", 2020, 3, ["all", "ieee"], "GAN"), doc("s2", "p", "GaN SiC", 2020, 3, ["all", "ieee"], "SIC"), doc("s2", "q", "GaN SiC", 2020, 1, ["all"], "GAN"),
        doc("s2", "r", "GaN", 2020, 1, ["all"], "SIC"), doc("s2", "o", "GaN", 2020, 1, ["all"], "GAN", abstract="no"), doc("s2", "z", "GaN", 1999, 1, ["all"], "GAN"),
    ]
    years = spark.createDataFrame([(2020, 300), (2021, 50)], "year int, domain_total long")
    cut = spark.createDataFrame([("GAN", 2020, 10, 4), ("SIC", 2020, 0, 0)], "concept string, year int, total long, fetched long")
    frame = lambda rows: spark.createDataFrame(rows, DOC)
    r = analysis.two_pool(frame(sample), frame(pool), TAX, years, cut, 2022)
    t = {(x.source, x.year): x for x in r.totals.collect()}
    assert t["all", 2020].in_domain == 200.0 and t["ieee", 2020].in_domain == 100.0 and t["arxiv", 2020].source_total == 0.0 and t["all", 2021].in_domain == 50.0
    cy = {(x.source, x.concept, x.year): x for x in r.concept_year.collect()}
    assert cy["all", "GAN", 2020].docs == 5.0 and cy["all", "GAN", 2020].docs_raw == 2 and cy["all", "SIC", 2020].docs_raw == 1  # weight 10 / 4; q not retrieved for SIC
    assert cy["ieee", "GAN", 2020].docs == 2.5 and cy["all", "GAN", 2021].docs == 0.0 and cy["arxiv", "GAN", 2020].share_pct == 0.0
    both = {c.source: c.docs_both for c in r.cooccurrence.collect()}
    assert both == {"all": 2, "ieee": 1}
    gated = analysis.two_pool(frame(sample), frame(pool), TAX, years, cut, 2022, pairs="gated")
    assert {c.source: c.docs_both for c in gated.cooccurrence.collect()} == {"all": 1, "ieee": 1}
    with pytest.raises(ValueError):
        analysis.two_pool(frame(sample), frame(pool), TAX, years, cut, 2022, pairs="none")


def test_bursts_and_greedy(spark):
    df = spark.createDataFrame([("s", y, t, n) for t, ys in {"grow": {2018: 6, 2021: 30}, "old": {2017: 9}, "tie a": {2021: 20}, "tie b": {2021: 20}, "tie": {2021: 28}, "ties": {2021: 14}}.items() for y, n in ys.items()], "source string, year int, term string, df long")
    n = spark.createDataFrame([("s", y, 100) for y in range(2016, 2023)], "source string, year int, n long")
    got = {r.term: r for r in emerging.burst_scores(df, n, 2022).collect()}
    assert set(got) == {"grow", "tie a", "tie b", "tie"}
    g = got["grow"]
    ratio = (30 / 300 + 1 / 300) / (6 / 300 + 1 / 300)
    assert math.isclose(g.growth_ratio, ratio) and math.isclose(g.score, math.log(ratio) * math.log1p(30)) and (g.recent_years, g.prior_years) == ("2019-2021", "2016-2018")
    rows = [("s", t, d, 0, 0.0, 0.0, 1.0, s, "", "") for t, d, s in (("deep net", 70, 9.0), ("net", 100, 8.0), ("net", 101, 7.0), ("b", 5, 6.0), ("a", 5, 6.0), ("deep net two", 70, 5.0))]
    scores = spark.createDataFrame(rows, emerging.burst_scores(df, n, 2022).schema)
    kept = [(r.term, r.recent_df) for r in emerging.without_contained(scores).collect()]
    assert ("net", 100) not in kept and ("net", 101) in kept and ("deep net two", 70) in kept  # 0.70 and 0.69; longer, lower ones stay
    assert [r.term for r in emerging.without_contained(scores, top=2).collect()] == ["deep net", "net"]
    assert emerging.burst_scores(df, n.where("year > 2019"), 2022).count() == 0  # no prior window


def test_report_tables_are_whole(spark):
    from lexipulse.plans import report

    assert report.grid(spark.range(700)).count("<tr>") == 701


@pytest.mark.parametrize("block", [7, 50, 1000])
def test_greedy_removal_in_blocks(spark, block):
    """Blocks of any size give what one reading of all terms gives."""
    rng = random.Random(2)
    words = ["ab", "bc", "abc", "cd", "abcd", "de"]
    rows = [(s, " ".join(rng.choices(words, k=rng.randrange(1, 4))), rng.randrange(15, 60), float(rng.randrange(12))) for s in "xyz" for _ in range({"x": 120, "y": 30, "z": 5}[s])]
    rows = list({r[:2]: r for r in rows}.values())
    want = set()
    for s in "xyz":
        kept = []
        for _, term, n, score in sorted((r for r in rows if r[0] == s), key=lambda r: (-r[3], r[1])):
            if len(kept) < 12 and not any(term in k and m >= 0.7 * n for k, m in kept):
                kept.append((term, n))
                want.add((s, term, n, score))
    scores = spark.createDataFrame(rows, "source string, term string, recent_df long, score double")
    got = emerging.without_contained(scores, top=12, block=block).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
