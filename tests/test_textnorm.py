import itertools
import random
import re
import tracemalloc
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexipulse.functions import textnorm as tn
from lexipulse.operators import emerging
from lexipulse.plans import analysis


#: text -> what normalisation makes of it, written by hand
CASES = [
    (None, ""), ("", ""), ("  ", ""),
    ("gate‐all‑around ‒ – — ― −", "gate-all-around - - - - -"),
    ("soft­hyphen", "soft-hyphen"),
    ("Ga₂O₃ 10¹²", "Ga2O3 1012"),
    ("ﬁeld ﬂow", "field flow"),
    ("a b​c﻿", "a bc"),
    ("don’t ‘x’ “y”", "don't 'x' \"y\""),
    (r"$\mathrm{Ga_2O_3}$", "Ga2O3"),
    (r"\textbf{\textit{deep}} one", "deep one"),
    ("x_{2} y_3.5 10^{12} 10^7", "x2 y3.5 10 12 10 7"),
    ("<b>bold</b> a < b > c", "bold a c"),
    ("&lt;i&gt; &amp;amp; &eacute; &#8322;", "&amp; é 2"),
    (r"\beta \alpha 5\% a\_b \AA", "beta alpha 5% a_b A"),
    (r"a\,b\;c\!d", "a b cd"),
    ("one\x1ctwo\x85three　four", "one two three four"),
    ("<" + "x" * 41 + ">", "<" + "x" * 41 + ">"),
    ("<" + "x" * 40 + ">", ""),
    ("１２３ ｋｍ", "123 km"),
]


def test_normalise_by_hand(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string")
    got = {r.i: r.n for r in df.select("i", tn.normalise(F.col("t")).alias("n")).collect()}
    assert got == {i: n for i, (_, n) in enumerate(CASES)}


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=60), min_size=1, max_size=30))
def test_normal_texts_have_no_odd_parts(spark, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tn.normalise(F.col("t")).alias("n"), tn.normalise_ascii(F.col("t")).alias("a"))
    for r in df.collect():
        assert r.n == " ".join(r.n.split()) and not set(r.n) & set("{}$" + tn.DASHES + tn.SUBSCRIPTS + tn.QUOTES + tn.SPACE + tn.VANISHING)
        if texts[r.i].isascii() and "&" not in texts[r.i]:
            assert r.n == r.a


def spans(text, longest):
    """All runs of tokens that pass what is asked of their ends and insides."""
    toks = re.findall(tn.TOKEN, text.lower())
    number = [re.search(tn.NUMERIC, t) is not None for t in toks]
    stop = [t in tn.STOP_WORDS for t in toks]
    runs = itertools.combinations(range(len(toks) + 1), 2)
    asked = (
        lambda i, j: j - i <= longest,
        lambda i, j: not any(number[i:j]),
        lambda i, j: not stop[i] and not stop[j - 1],
        lambda i, j: len(toks[i]) >= (4 if j - i == 1 else 3),
        lambda i, j: len(toks[j - 1]) >= 2,
    )
    return {" ".join(toks[i:j]) for i, j in runs if all(rule(i, j) for rule in asked)}


#: text -> n-grams, written by hand
GRAMS = {
    "The RISC-V core of 3D NAND at 7 nm": {"risc-v", "risc-v core", "core", "core of 3d", "nand"},
    "of the and": set(),
    "a 12 bc def ghij": {"def ghij", "ghij"},
    "state of the art memory": {"state", "art memory", "memory"},
    "": set(),
    "x.y.z 3.14 mos2 ga2o3-based": {"x.y.z", "mos2", "mos2 ga2o3-based", "ga2o3-based"},
    "deep deep deep learning": {"deep", "deep deep", "deep deep deep", "deep deep learning", "deep learning", "learning"},
}


def test_tokens_and_ngrams(spark):
    rng = random.Random(2)
    more = [" ".join(rng.choice(["gate", "of", "the", "12", "3.5", "ab", "fin", "x", "oxide-based", "at"]) for _ in range(rng.randrange(40))) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in [*GRAMS, *more, None]], "t string").repartition(3)
    for longest in (1, 2, 3, 4):
        for r in df.select("t", tn.tokens(F.col("t")).alias("k"), tn.ngrams(F.col("t"), longest).alias("g")).collect():
            if r.t is None:
                assert r.g is None
                continue
            assert r.k == re.findall(tn.TOKEN, r.t.lower())
            assert set(r.g) == spans(r.t, longest) and len(set(r.g)) == len(r.g)
            if longest == 3 and r.t in GRAMS:
                assert set(r.g) == GRAMS[r.t]
    assert df.where("false").select(tn.ngrams(F.col("t"))).count() == 0


def test_sketch_loses_no_frequent_term(spark):
    """Any number of cells gives the table of all n-grams; few cells only send more."""
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "of", "2.5", "x-ray", "gan", "é"]
    rows = [(rng.choice(["a", "b", None]), rng.choice([2020, 2021, None]), " ".join(rng.choices(words, k=rng.randrange(0, 30))) if i % 17 else None) for i in range(300)]
    docs = spark.createDataFrame(rows, "source string, year int, text string").repartition(5)
    want = sorted(map(str, emerging.ngram_df(docs, 4, cells=0).collect()))
    assert len(want) > 50
    for cells in (emerging.CELLS_A_ROW, 1 << 18, None):
        assert sorted(map(str, emerging.ngram_df(docs, 4, cells=cells).collect())) == want
    assert emerging.ngram_df(docs.limit(0), 4).count() == 0


def test_sketch_halves_what_is_shuffled(spark):
    rng = random.Random(4)
    rows = [("s", 2020, " ".join(f"w{min(int(rng.expovariate(0.004)), 5000)}" for _ in range(60))) for _ in range(400)]
    docs = spark.createDataFrame(rows, "source string, year int, text string").repartition(4).cache()
    bits = spark.sparkContext.broadcast(emerging._frequent(docs.select("source", "year", tn.tokens(F.col("text")).alias("tokens")), 5, 3, 1 << 20))
    sent = docs.select("source", "year", tn.tokens(F.col("text")).alias("tokens")).mapInArrow(lambda it: emerging._kept(it, 3, 1 << 20, bits), "source string, year int, term string").count()
    every = docs.select(F.explode(tn.ngrams(F.col("text")))).count()
    assert emerging.ngram_df(docs).count() > 100 and sent < 0.5 * every


def test_memory_of_ngrams_follows_no_batch():
    """A batch of any number of texts is worked in parts, with the n-grams of the whole."""
    rng = random.Random(5)
    toks = [None, [], *([f"w{min(int(rng.expovariate(0.004)), 5000)}" for _ in range(300)] for _ in range(2000)), ["long"] * 200_000, ["w1", "w2"]]
    n = len(toks)
    batch = pa.RecordBatch.from_pydict({"source": ["s"] * n, "year": pa.array([2020] * n, pa.int32()), "tokens": pa.array(toks, pa.list_(pa.string()))})
    bits = types.SimpleNamespace(value=np.full(emerging.LEAST_CELLS // 8, 255, np.uint8))
    tracemalloc.start()
    rows = sum(b.num_rows for b in emerging._kept([batch], 3, emerging.LEAST_CELLS, bits))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 96e6  # the whole batch at once takes 178 MB
    whole = tn.grams_of(batch.column("tokens"), 3, tn.STOP_WORDS)
    assert rows == len(whole.owner) and tn.token_ngrams(batch.column("tokens"), 3, tn.STOP_WORDS).flatten().equals(whole.joined())


def test_sketch_is_sent_in_bounded_parts(monkeypatch):
    """Whatever a task holds at once, the rows of its cells add up to the counts of all its n-grams."""
    monkeypatch.setattr(emerging, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 130)))
    monkeypatch.setattr(tn.token_runs, "__defaults__", (500,))
    rng, cells = random.Random(6), emerging.CELLS_A_ROW * 4
    toks = [[f"w{min(int(rng.expovariate(0.02)), 900)}" for _ in range(60)] for _ in range(300)] + [["same"]] * 600
    batch = pa.RecordBatch.from_pydict({"source": ["s"] * 900, "year": pa.array([2020, 2021] * 450, pa.int32()), "tokens": toks})
    want = np.minimum(np.bincount(emerging._cells(batch, 3, cells)[1], minlength=cells), 255)
    for held in (1, 3000, 1 << 21):
        monkeypatch.setattr(emerging, "CELLS_HELD", held)
        out = pa.Table.from_batches(list(emerging._sketched([batch], 3, cells)))
        assert set(out["shard"].to_pylist()) == {2} and out.num_rows >= 4 * (1 + (held < 1 << 21))
        for b in range(4):
            rows = out.filter(pa.compute.equal(out["block"], b))
            own = want[b * emerging.CELLS_A_ROW :][: emerging.CELLS_A_ROW]
            once = emerging._added(rows)
            place, n = emerging._unpacked(once["cells"][0].as_py())
            assert (place == np.flatnonzero(own)).all() and (n == own[own > 0]).all() and 255 in want
            assert emerging._added(once, 5)["cells"][0].as_py() == np.packbits(own >= 5).tobytes()


def test_source_years_lie_side_by_side(spark):
    rows = [(("a", "b", None)[i % 3], 2020 + i % 4, f"t{i}") for i in range(600)]
    out = emerging.by_source_year(spark.createDataFrame(rows, "source string, year int, text string").repartition(7))
    where = out.select("source", "year", "text", F.spark_partition_id().alias("p")).collect()
    assert sorted(map(str, (tuple(r)[:3] for r in where))) == sorted(map(str, rows))
    each = [{(r.source, r.year) for r in where if r.p == p} for p in {r.p for r in where}]
    assert len(each) > 1 and sum(map(len, each)) <= 12 + len(each) - 1  # ranges share a source-year at their edges alone


def test_kept_counts_deal_no_texts_out(spark, tmp_path, monkeypatch):
    """Texts of the source-years to be counted stay where they are, whatever may be broadcast by size; no source-year is one task."""
    docs = spark.createDataFrame([("s", 2020 + i % 3, str(i), "alpha beta gamma") for i in range(90)], "source string, year int, id string, text string").repartition(6)
    plans, counted = [], emerging.ngram_df

    def seen(d, *more, **named):
        plans.append(d._jdf.queryExecution().executedPlan().toString())
        return counted(d, *more, **named)

    monkeypatch.setattr(emerging, "ngram_df", seen)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = {tuple(r) for r in analysis.kept_ngrams(docs, 5, f"file://{tmp_path}").select("year", "term", "df").collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows == {(y, t, 30) for y in (2020, 2021, 2022) for t in ("alpha", "beta", "gamma", "alpha beta", "beta gamma", "alpha beta gamma")}
    assert any("BroadcastHashJoin" in p for p in plans) and not any("hashpartitioning" in p for p in plans)


def test_texts_are_cut_on_arrays():
    """Tokens of whole batches, at the edges of texts and of parts, are those of the pattern."""
    rng = random.Random(7)
    texts = ["", None, "-", ".-a", "a.-", "--a.b--c..", "é-a", "aé.b", "a", "9.5 ab.c 12-", *("".join(rng.choice("ab1-. é\n") for _ in range(rng.randrange(12))) for _ in range(2000))]
    want = [None if t is None else re.findall(tn.TOKEN, t) for t in texts]
    assert tn.cut(pa.array(texts)).to_pylist() == want and tn.cut(pa.array(["zz", *texts], pa.large_string()).slice(1)).to_pylist() == want
    assert all(tn.cut(pa.array(t, pa.string())).to_pylist() == [None if x is None else [] for x in t] for t in ([], [None], [""]))


def test_ngrams_send_texts_to_python_not_tokens(spark):
    """Tokens as arrays of strings would be made by the JVM and sent one by one, in both scans."""
    rows = [("s", 2020, t) for t in ("Alpha-Beta GAMMA. 12", "alpha-beta gamma", None, "É gamma")]
    docs = spark.createDataFrame(rows, "source string, year int, text string")
    df = emerging.ngram_df(docs, 2)
    assert sorted(tuple(r)[2:] for r in df.collect()) == [("alpha-beta", 2), ("alpha-beta gamma", 2), ("gamma", 3)]
    assert "regexp_extract_all" not in df._jdf.queryExecution().toString()


def test_memory_of_the_sketch(monkeypatch):
    """A task's sketch holds its cells once, not several times over."""
    monkeypatch.setattr(emerging, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 0)))
    rng = np.random.default_rng(8)
    cells = [rng.integers(0, 1 << 28, 1 << 17) for _ in range(16)]
    monkeypatch.setattr(emerging, "_parts", lambda batches: batches)
    monkeypatch.setattr(emerging, "_cells", lambda batch, longest, n: (None, batch))
    tracemalloc.start()
    rows = sum(b.num_rows for b in emerging._sketched(iter(cells), 3, 1 << 28))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 4096 and most < 64e6  # 86 MB where np.unique sorts and counts in eight bytes
