import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lexipulse import cli, streaming
from lexipulse.plans import report
from lexipulse.sources import fetch, jsonl, records, search
from lexipulse.taxonomy import from_dict, load
from tests import fake_client

TAX = {"domain_terms": ["chip"], "categories": {"c": {"GAN": {"synonyms": ["GaN"]}, "SIC": {"synonyms": ["SiC"]}}}}


def line(i, year, title="GaN chip", **extra):
    return json.dumps({"source": "arxiv", "id": i, "title": title, "abstract": "text", "year": year, "date": "", "venue": "", "doc_type": "", "url": "", "extra": extra})


def test_tolerant_scan_and_stage(spark, tmp_path):
    a, b = tmp_path / "a.jsonl", tmp_path / "b.jsonl"
    a.write_text("\n".join([line("1", 2020, cited_by=3), "", line("2", 2021), '{"id": "no year"}', '{"id": "cut", "year": 20']))
    b.write_text(line("1", 2020, title="second file"))
    docs = jsonl.read_tolerant(spark, [str(a), str(b)])
    assert sorted((r.file_rank, r.id, r.year) for r in docs.collect()) == [(0, "1", 2020), (0, "2", 2021), (1, "1", 2020)]
    with pytest.raises(Exception):
        jsonl.read_strict(spark, str(a)).collect()
    jsonl.stage(docs, str(tmp_path / "staged"))
    assert spark.read.parquet(str(tmp_path / "staged")).where("year = 2021").count() == 1
    jsonl.write_jsonl(docs.select("id"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    assert spark.createDataFrame([(line("9", 2019),)], "v string").select(jsonl.year_of_line(F.col("v"))).first()[0] == 2019


def test_discovery_and_sidecars(spark, tmp_path):
    (tmp_path / "openalex_arxiv.jsonl").write_text("x")
    (tmp_path / "arxiv_direct.jsonl").write_text("")
    assert jsonl.discover(spark, str(tmp_path))["arxiv"][0].endswith("/openalex_arxiv.jsonl")
    for n in ("s2_concepts.jsonl", "s2_concepts.1.jsonl", "s2_sample.jsonl", "s2_meta.json"):
        (tmp_path / n).write_text("{}")
    found = jsonl.discover(spark, str(tmp_path))
    assert list(found) == ["s2"] and [p.rsplit("/", 1)[1] for p in found["s2"]] == ["s2_concepts.1.jsonl", "s2_concepts.jsonl"]
    with pytest.raises(ValueError):
        jsonl.discover(spark, str(tmp_path), ["arxiv"])
    years, cut = jsonl.pool_meta(spark, [{"years": {"2020": {"domain_total": 9}}, "concepts": {"A": {"2020": {"total": 5, "fetched": 1}}}}, {"concepts": {"A": {"2020": {"total": 6, "fetched": 2}}}}])
    assert [tuple(r) for r in years.collect()] == [(2020, 9)] and [tuple(r) for r in cut.collect()] == [("A", 2020, 6, 2)]
    assert jsonl.sidecar(spark, str(tmp_path / "none.jsonl")) == {} and jsonl.year_totals(spark, "x", {}).count() == 0


def test_records(spark):
    s2 = spark.createDataFrame([("p1", "T", None, 2020, None, ("10.1109/x", None), "", None, 4, None), ("p2", None, "A", None, None, ("", "2001.1"), "IEEE Access", ("n",), None, ["Review"]), ("p3", "T", "A", 2019, "2019-01-02", None, None, ("Proc. ieee",), 0, None)], records.S2_RECORD)
    got = {r.id: r for r in records.from_semantic_scholar(s2, "sample", F.lit(2000)).collect()}
    assert got["p1"].url == "https://doi.org/10.1109/x" and got["p1"].extra.sources == ["all", "ieee"] and got["p1"].abstract == ""
    assert got["p2"].url == "https://arxiv.org/abs/2001.1" and got["p2"].extra.sources == ["all", "ieee", "arxiv"] and got["p2"].year == 2000
    assert got["p3"].url.endswith("/p3") and got["p3"].extra.sources == ["all", "ieee"]
    oa = spark.createDataFrame([("W1", "https://doi.org/1", "T", 2020, None, {"b": [1, 3], "a": [0], "c": [2]}, ("https://arxiv.org/abs/1", None), "article", 3, None), ("W2", None, None, None, None, None, None, None, None, None)], records.OPENALEX_RECORD)
    rows = {r.extra.openalex_id: r for r in records.from_openalex(oa, "arxiv").collect()}
    assert rows["W1"].abstract == "a b c b" and rows["W1"].id == "https://arxiv.org/abs/1" and rows["W2"].id == "W2" and rows["W2"].abstract == "" and rows["W2"].year == 0
    assert records.from_openalex(oa, "ieee").where("id = 'https://doi.org/1'").count() == 1
    arx = spark.createDataFrame([("http://arxiv.org/abs/cs/01v2", "A\n  b", " s ", "2020-05-06T00", ["cs.AI", "cs.LG"], "cs.AI")], "id string, title string, summary string, published string, tags array<string>, primary_category string")
    r = records.from_arxiv(arx).first()
    assert (r.id, r.title, r.date, r.venue) == ("01v2", "A b", "2020-05-06", "cs.AI,cs.LG")
    pat = spark.createDataFrame([("US-1", "US", "B2", 20200102, 0, 0, [("de", "de"), ("T", "en")], [("A", "en")], [("H01L21/02",), ("H01L29/1",), ("G03F7",)]), ("US-2", "US", "S1", 20200102, 0, 0, [], [("A", "en")], [("H01L",)]), ("US-3", "US", "A1", 20200102, 0, 0, [("x", "fr")], [("A", "en")], [("H01L",)])], records.WAREHOUSE_RECORD)
    kept = records.warehouse_filter(pat, 20200101, 20201231, "H01L|G03F", ["A1", "B2"])
    assert sorted(r.publication_number for r in kept.collect()) == ["US-1", "US-3"]
    r = records.from_warehouse(kept).collect()
    assert [(x.id, x.title, x.venue, x.date, x.extra.cpc) for x in r] == [("US-1", "T", "G03F,H01L", "2020-01-02", ["H01L21/02", "H01L29/1", "G03F7"])]
    ie = spark.createDataFrame([("7", "T", "A", "Jan. 2018", "", "V", "Journals", 2, "", "h")], records.IEEE_RECORD)
    assert [(x.id, x.year, x.extra.citing_paper_count) for x in records.from_ieee(ie).collect()] == [("7", 2018, 2)]


def test_patent_csv(spark, tmp_path):
    f = tmp_path / "export.csv"
    f.write_text('﻿search URL:,https://x\nID,Title,Assignee,Priority Date,Result Link\nA,"one, two",acme,2019-03-04,\nA,later,acme,2020-01-01,\nB,no date,acme,,\nC,three,acme,in 2021,http://r\n', encoding="utf-8")
    got = sorted((r.id, r.title, r.year, r.url, r.extra.file) for r in records.from_patent_csv(records.read_patent_csv(spark, str(f))).collect())
    assert got == [("A", "one, two", 2019, "https://patents.google.com/patent/A", "export.csv"), ("C", "three", 2021, "http://r", "export.csv")]


def test_patent_csv_files_in_order(spark, tmp_path):
    a, b, c = (tmp_path / n for n in ("a.csv", "b.csv", "c.csv"))
    a.write_text('search URL:,https://x\nID,Title,Filing Date,Grant Date\nA,"two\nlines, ""quoted""",2018-01-01,2000\nB,early,,2019\n', encoding="utf-8")
    b.write_text("\ufeffid,title,grant date,Abstract\nA,second file,2017,x\nB,B of b,2016-02-03,text\nid,title,grant date,Abstract\n", encoding="utf-8")
    c.write_text("", encoding="utf-8")
    got = sorted((r.id, r.title, r.year, r.abstract, r.extra.file) for r in records.from_patent_csv(records.read_patent_csv(spark, [str(a), str(b), str(c)])).collect())
    assert got == [("A", 'two\nlines, "quoted"', 2018, "", "a.csv"), ("B", "B of b", 2016, "text", "b.csv")]
    assert records.from_patent_csv(records.read_patent_csv(spark, [])).count() == 0


def test_feed_file(spark, tmp_path):
    (tmp_path / "feed.xml").write_text(
        '<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom"><title>q</title>'
        '<entry><id>http://arxiv.org/abs/2001.1v1</id><title>A &amp; b\n  c</title><summary> s </summary><published>2020-05-06T07:08:09Z</published>'
        '<arxiv:primary_category term="cs.AI"/><category term="cs.AI"/><category term="cs.LG"/></entry>'
        "<entry><id>http://arxiv.org/abs/2001.2v3</id><title>T</title><published>2021-01-01T00:00:00Z</published></entry></feed>"
    )
    got = sorted((r.id, r.title, r.abstract, r.year, r.venue, r.extra.primary_category) for r in records.from_arxiv(records.read_feed(spark, str(tmp_path / "feed.xml"))).collect())
    assert got == [("2001.1v1", "A & b c", "s", 2020, "cs.AI,cs.LG", "cs.AI"), ("2001.2v3", "T", "", 2021, "", None)]


def once_each(spark, folder):
    """Every piece of work was committed once."""
    done = fetch.pages(spark, folder).where("record is null").groupBy(*fetch.WHAT).count()
    return done.where("count > 1").count() == 0 and done.count()


def test_pages_of_a_query():
    item = fetch.two_pool_work(from_dict(TAX), range(2020, 2021), sample_pages=2)[0]
    slept, answers = [], iter([{"wait": 9.0}, {"wait": None}])
    client = lambda request: next(answers, None) or fake_client.s2(request)
    rows = list(fetch.asked(client, item, 0.5, slept.append))
    assert slept == [9.0, 7.2, 0.5] and len(rows) == 5 and rows[-1][5:] == (fake_client.total_of(item), 4, None) and all(r[5:7] == (None, None) for r in rows[:-1])
    item |= {"pages": 0, "most": 3}
    assert [r[-1] is None for r in fetch.asked(fake_client.s2, item, sleep=slept.append)] == [False] * 3 + [True]


def test_two_pools_by_shards(spark, tmp_path):
    """Interleaved shards, a wave cut short, a task that fails, a changed query: nothing is done twice, nothing is left out."""
    tax, folder = from_dict(TAX), str(tmp_path / "raw dir" / cli.PAGES)
    years, s2 = range(2019, 2022), "tests.fake_client:s2"
    first, second = (cli.work_of("s2", [], tax, years, 2, 1, share=(i, 2)) for i in (0, 1))
    assert [w["kind"] for w in first] == ["sample"] * 3 + ["concept"] * 3 and {w["key"] for w in second} == {"SIC"}
    assert fetch.fetch(spark, s2, folder, first[:2]) == 2
    assert fetch.fetch(spark, s2, folder, second[:1]) == 1
    with pytest.raises(Exception, match="service is gone"):
        fetch.fetch(spark, "tests.fake_client:failing", folder, second)
    assert once_each(spark, folder) == 3 and len(fetch.waves(spark, folder)) == 2  # the wave that failed is not there
    assert fetch.fetch(spark, s2, folder, first) == 4
    (Path(fetch.waves(spark, folder)[-1].removeprefix("file:")) / "_SUCCESS").unlink()  # as if killed before the last wave's end
    both = cli.work_of("s2", [], tax, years, 2, 1)
    assert fetch.fetch(spark, s2, folder, both) == 3 and fetch.fetch(spark, s2, folder, both) == 0
    assert once_each(spark, folder) == len(both) == 9
    sample, pool, meta, cut = fetch.two_pools(spark, folder, tax)
    assert {(r.year, r.domain_total) for r in meta.collect()} == {(w["year"], fake_client.total_of(w)) for w in both if w["kind"] == "sample"}
    assert {tuple(r) for r in cut.collect()} == {(w["key"], w["year"], fake_client.total_of(w), 2) for w in both if w["kind"] == "concept"}
    assert sample.count() == sum(min(4, fake_client.total_of(w)) for w in both if w["kind"] == "sample") and {r.extra.retrieved_for for r in pool.collect()} == {"GAN", "SIC"}
    assert {r.year for r in sample.collect()} == set(years)  # records without a year have the query's
    other = from_dict(TAX | {"domain_terms": ["chip", "wafer"]})
    assert fetch.fetch(spark, s2, folder, cli.work_of("s2", [], other, years, 2, 1)) == 3  # the samples alone
    assert fetch.two_pools(spark, folder, tax)[2].count() == 3 == fetch.two_pools(spark, folder, other)[2].count()


def test_all_by_the_default_route(spark, tmp_path):
    raw = tmp_path / "raw"
    (tmp_path / "t.json").write_text(json.dumps(TAX))
    tax = load(tmp_path / "t.json")
    fetch.fetch(spark, "tests.fake_client:s2", f"{raw}/{cli.PAGES}", cli.work_of("s2", [], tax, range(2015, 2021), 1, 1), lanes=2, wave=9)
    r = cli.analysed(spark, str(raw), tax, 2021, 3, None, str(tmp_path / "kept"))
    totals = {(t.source, t.year): t for t in r.totals.collect()}
    assert r.two_pool and {y for _, y in totals} == set(range(2015, 2021)) and all(t.scale != 1 for t in totals.values() if t.source == "all")
    found = r.matched.where("year = 2016 and source = 'all'").collect()
    assert found and all(set(x.retrieved_for) == {"GAN", "SIC"} for x in found)
    assert r.concept_year.where("docs > docs_raw").count() > 0 and r.growth.count() > 0
    r.write(str(tmp_path / "out"))
    with pytest.raises(ValueError):
        cli.analysed(spark, str(raw), tax, 2021, 3, ["arxiv"])
    with pytest.raises(SystemExit):
        cli.analysed(spark, str(tmp_path), tax, 2021, 3, None)


@pytest.mark.parametrize("via, sources, client", [("openalex", ["ieee", "arxiv"], "openalex"), ("direct", ["arxiv"], "arxiv")])
def test_plain_routes(spark, tmp_path, via, sources, client):
    tax, raw = from_dict(TAX), str(tmp_path)
    work = cli.work_of(via, [*sources, "google_patents"], tax, range(2018, 2021), most=4 if via == "openalex" else 0, seed=5)
    assert fetch.fetch(spark, f"tests.fake_client:{client}", f"{raw}/{cli.PAGES}", work) == 3 * len(sources)
    r = cli.analysed(spark, raw, tax, 2021, 3, None)
    want = {(w["key"], w["year"]): (fake_client.total_of(w), min(w["most"] or 99, fake_client.total_of(w))) for w in work}
    got = {(t.source, t.year): (int(t.source_total), t.fetched) for t in r.totals.where("source <> 'all'").collect()}
    assert got == want


def test_formats():
    assert [report.shown(v, c) for v, c in ((12.346, "share_pct"), (0.5, "growth_ratio"), (2.0, "growth_ratio"), (0.1234, "slope_pp_per_year"), (1234567, "docs"), (None, "x"), (float("nan"), "pct"))] == ["12.35%", "▼ 0.50×", "▲ 2.00×", "+0.123", "1,234,567", "–", "–"]


def test_queries_and_retries(spark):
    assert search.bulk_query(['"quoted term"', " x "]) == '"quoted term" | x'
    assert search.concept_query(["nano sheet"], ["nano sheet", "re:raw"]) == '"nano sheet" | nanosheet | "re:raw"'
    assert sum(search.BACKOFF["arxiv"].waits()) >= 300 and sum(search.BACKOFF["arxiv"].waits()[:-1]) < 300
    assert search.bulk_query(["GaN", "thin film", "III-V"]) == 'GaN | "thin film" | "III V"'
    assert search.concept_query(["nano sheet", "re:x+", "nanosheet", "3D IC"], ["Nano-Sheet", "extra one"]) == '"nano sheet" | nanosheet | "3D IC" | "extra one"'
    assert search.openalex_query(["a", "b c"]) == 'a OR "b c"' and search.ieee_query(["a"]) == '"a"' and search.arxiv_query(["a", "b c"]) == '(abs:a OR abs:"b c")'
    assert list(search.year_range("2019-2021")) == [2019, 2020, 2021] and list(search.year_range("2020")) == [2020] and search.shard(list("abcde"), 1, 2) == ["b", "d"]
    slept, answers = [], iter([(False, None, None), (False, None, 100.0), (True, "ok", None)])
    assert search.Backoff(4, 2, 60, 5).call(lambda: next(answers), slept.append) == "ok" and slept == [4, 60]
    with pytest.raises(TimeoutError):
        search.Backoff(1, 1, 1, 2).call(lambda: (False, None, None), slept.append)
    work = spark.createDataFrame([("A", 2020, "q"), ("A", 2021, "q"), ("B", 2020, "new")], "concept string, year int, query string")
    done = spark.createDataFrame([("A", 2020, "q"), ("B", 2020, "old")], "concept string, year int, query string")
    assert sorted(tuple(r)[:2] for r in search.open_work(work, done).collect()) == [("A", 2021), ("B", 2020)]


def test_run_report_tester_and_stream(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "arxiv_direct.jsonl").write_text("\n".join(line(str(i), 2015 + i % 6, "GaN SiC chip" if i % 2 else "SiC chip", cited_by=i) for i in range(60)))
    (tmp_path / "t.json").write_text(json.dumps(TAX))
    tax = load(tmp_path / "t.json")
    r = cli.analysed(spark, str(raw), tax, 2021, 3, None, str(tmp_path / "kept"))
    terms = sorted(map(tuple, r.emerging.collect()))
    again = cli.analysed(spark, str(raw), tax, 2021, 3, None, str(tmp_path / "kept"))
    assert sorted(map(tuple, again.emerging.collect())) == terms and len(list((tmp_path / "kept" / "ngrams").glob("*.marks"))) == 1
    cli.analysed(spark, str(raw), from_dict(TAX | {"domain_terms": ["chip", "other"]}), 2021, 3, None, str(tmp_path / "kept"))
    assert len(list((tmp_path / "kept" / "ngrams").glob("*.marks"))) == 2  # the gate is part of the key
    r.write(str(tmp_path / "out"))
    assert json.loads((tmp_path / "out" / "summary.json").read_text())["docs_analysed"] == 60
    assert jsonl.read_table(spark, str(tmp_path / "out" / "growth.csv"), "source string, category string, concept string").count() == 2
    assert jsonl.read_table(spark, str(tmp_path / "none"), "a int").count() == 0
    report.build(r, "arxiv", str(tmp_path / "r.html"))
    text = (tmp_path / "r.html").read_text()
    assert "<svg" in text and "Emerging terms" in text
    assert cli.tested(spark, from_dict(TAX), "GaN and GaN, SiC") == {"GAN": {"GaN": 2}, "SIC": {"SiC": 1}}
    q = streaming.start(streaming.document_stream(spark, str(raw)), tax, str(tmp_path / "counts"), str(tmp_path / "check"))
    q.awaitTermination(60)
    got = {(x.year, x.concept): x.docs for x in streaming.current(spark, str(tmp_path / "counts")).collect()}
    assert sum(n for (_, c), n in got.items() if c is None) == 60 and sum(n for (_, c), n in got.items() if c == "GAN") == 30


def test_many_exports_are_one_scan(spark, tmp_path):
    paths = []
    for i in range(60):
        (tmp_path / f"e{i}.csv").write_text(f"ID,Title,{['Priority Date', 'Grant Date'][i % 2]}\nX{i % 40},title {i},20{10 + i % 10}-01-01\n")
        paths.append(str(tmp_path / f"e{i}.csv"))
    random.Random(1).shuffle(paths)
    before = spark.sparkContext.statusTracker().getJobIdsForGroup()
    rows = records.read_patent_csv(spark, paths)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup()) <= len(before) + 1  # the listing, no job a file
    assert rows._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    got = {r.id: r.title for r in records.from_patent_csv(rows).collect()}
    first = {}
    for p in paths:
        i = int(Path(p).stem[1:])
        first.setdefault(f"X{i % 40}", f"title {i}")
    assert got == first and len(got) == 40


def test_order_of_nested_files_and_many_paths(spark, tmp_path):
    """A path that ends like another, escaped names, and thousands of places."""
    (tmp_path / "b" / "a").mkdir(parents=True)
    (tmp_path / "a").mkdir()
    names = ["b/a/x.jsonl", "a/x.jsonl", "a/odd name +%.jsonl"]
    for n in names:
        (tmp_path / n).write_text(line(n, 2020))
    for order in (names, names[::-1]):
        got = {r.id: r.file_rank for r in jsonl.read_tolerant(spark, [str(tmp_path / n) for n in order]).collect()}
        assert got == {n: i for i, n in enumerate(order)}
    rows = spark.createDataFrame([(f"file:///many/{i}.jsonl",) for i in (0, 77, 4999)] + [("file:/not/there",)], "path string").withColumn("i", F.col("path"))
    ranked = jsonl.with_file_rank(rows, [f"/many/{i}.jsonl" for i in range(5000)])
    assert sorted(r.file_rank for r in ranked.collect()) == [0, 77, 4999, 5000]


def test_a_new_year_touches_only_its_own_parts(spark, tmp_path):
    """Files staged and source-years counted before are not read again; results are those of a run without anything kept."""
    raw, tax = tmp_path / "raw", from_dict(TAX)
    raw.mkdir()
    year = lambda y, n=12: "\n".join(line(f"{y}-{i}", y, f"GaN chip of kind alpha{y % 3}") for i in range(n)) + "\n"
    (raw / "arxiv_direct.jsonl").write_text("".join(map(year, range(2015, 2021))))
    (raw / "google_patents.jsonl").write_text("".join(map(year, range(2015, 2021))))
    keep, stage = str(tmp_path / "keep"), str(tmp_path / "stage")
    run = lambda **how: cli.analysed(spark, str(raw), tax, 2023, 3, None, **how)
    rows = lambda r: [sorted(map(str, t.collect())) for t in (r.totals, r.concept_year, r.emerging, r.examples)]
    assert rows(run(keep=keep, stage=stage)) == rows(run())
    marks = lambda kind: [json.loads(p.read_text()) for p in sorted((tmp_path / kind).glob("*/*.marks"))]
    assert [len(m) for m in marks("keep")] == [12] and [len(m) for m in marks("stage")] == [1, 1]
    with (raw / "arxiv_direct.jsonl").open("a") as out:
        out.write(year(2021))
    assert rows(run(keep=keep, stage=stage)) == rows(run())
    assert [len(m) for m in marks("keep")] == [12, 1] and [len(m) for m in marks("stage")] == [1, 1, 1]
    before = marks("keep"), marks("stage")
    assert rows(run(keep=keep, stage=stage)) == rows(run()) and (marks("keep"), marks("stage")) == before
    plan = jsonl.staged(spark, stage, [f"{raw}/google_patents.jsonl"], source=F.lit("google_patents")).where("year = 2016")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "2016" in plan
