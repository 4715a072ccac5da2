import random
import re
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexipulse.operators import match, scan
from lexipulse.taxonomy import Concept, from_dict, python_pattern

SPEC = {
    "domain_terms": ["wafer", "FET"],
    "categories": {
        "a": {
            "NANO": {"label": "Nano sheets", "synonyms": ["nano sheet", "NSFET"], "require": "re:(?i)transistor|FET"},
            "MEM": {"synonyms": ["HBM", r"re:HBM[1-4](?!\d)", "high-bandwidth memory"]},
            "GAA": {"synonyms": ["GAA", "GAA nanosheet"]},
            "NODE": {"synonyms": [r"re:(?i)\b(\d+)\s*nm\b(?= node)"], "exclude": "micro nm"},
        },
        "b": {"INFO": {"synonyms": ["InFO"]}},
    },
}
TEXTS = [
    "nano-sheet FETs and nanosheets, nano sheetes", "nanosheet on a wafer", "nano sheet transistor", "xnanosheet FET", "NSFETs NSFETes nsfet", "HBM HBM2 HBM3 HBM33 high bandwidth memories",
    "high-bandwidth memorys; highbandwidthmemory", "GAA nanosheet FET GAA", "gaa FET", "7 nm node, 5nm node and 3 nm nodes", "7 nm node micro-nm", "more info please", "", "wafer wafer", "the HBM, HBM", "FETs",
]


def by_hand(concept: Concept, text: str) -> dict[str, int]:
    found, joined = {}, "|".join(f"(?P<s{i}>{python_pattern(s)})" for i, s in enumerate(concept.synonyms))
    for m in re.finditer(joined, text):
        s = concept.synonyms[next(int(k[1:]) for k, v in m.groupdict().items() if v is not None and k[0] == "s")]
        found[s] = found.get(s, 0) + 1
    if concept.exclude and re.search(python_pattern(concept.exclude), text) or concept.require and not re.search(python_pattern(concept.require), text):
        return {}
    return found


def test_hits_equal_python(spark):
    tax = from_dict(SPEC)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string")
    rows = match.matched(df, tax, gated=False).collect()
    seen = 0
    for r in rows:
        got = {h.concept: {s.synonym: s.n for s in h.synonyms} for h in r.hits}
        want = {c.key: h for c in tax.concepts if (h := by_hand(c, TEXTS[r.i]))}
        assert got == want, TEXTS[r.i]
        assert r.concepts == list(want)
        seen += len(want)
    assert seen >= 10


def test_rules(spark):
    tax = from_dict(SPEC)
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    rows = {r.text: r for r in match.matched(df, tax).collect()}
    assert rows["nano sheet transistor"].concepts == [] and not rows["nano sheet transistor"].in_domain  # outside the domain
    assert rows["nanosheet on a wafer"].concepts == []  # context missing
    assert rows["GAA nanosheet FET GAA"].hits[-1].synonyms[0].n == 2  # the earlier synonym shadows the longer one
    assert rows["gaa FET"].concepts == []
    assert tax.by_key["INFO"].warnings == ["InFO"] and by_hand(tax.by_key["INFO"], "more info please")


def test_pairs_and_empty_taxonomy(spark):
    df = spark.createDataFrame([(["b", "c", "a"],), ([],), (["x"],)], "concepts array<string>")
    got = [[(p.a, p.b) for p in r.p] for r in df.select(match.pairs_of(F.col("concepts")).alias("p")).collect()]
    assert got == [[("a", "b"), ("a", "c"), ("b", "c")], [], []]
    with pytest.raises(ValueError):
        from_dict({"domain_terms": [], "categories": {"a": {"K": {"synonyms": []}}}})


MIXED = {
    "domain_terms": ["the", "power amp", "β-oxide", "FET"],
    "categories": {
        "c": {
            "HOT": {"synonyms": ["hot-ring", "hot rods", "hot", "hot ring road"]},
            "CXX": {"synonyms": ["C++", "C", "c# code"]},
            "GREEK": {"synonyms": ["β-oxide", "oxide", "α"]},
            "ACRO": {"synonyms": ["MIT", "MI T", "GaN HEMT", "GAN"], "exclude": "hot"},
            "CASE": {"synonyms": ["kiss", "silk kiss", "ißl"], "require": "the"},
            "CAFE": {"synonyms": ["café au lait", "3.5 mm", "3.5"]},
            "LONG": {"synonyms": ["a b c d", "a b", "b c", "d"]},
            "TURK": {"synonyms": ["ısı pompa"]},
        }
    },
}
PIECES = ["hot", "ring", "rods", "road", "HOT", "C", "++", "c#", "code", "β", "Β", "oxide", "α", "MIT", "MI", "T", "Mit", "GaN", "HEMT", "GAN", "kiss", "KISS", "Kiſſ", "kıss", "silk", "SİLK", "ißl", "IẞL", "café", "CAFÉ", "au", "lait", "3.5", "3", ".5", "mm", "a", "b", "c", "d", "power", "amp", "the", "x", "s", "es", "ısı", "ISI", "pompa", "é", "9"]


def random_texts(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) + rng.choice(["", "", " ", " ", "-", " - ", "s ", "es ", "\n", ".", "\xa0"]) for _ in range(rng.randrange(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("gated", [True, False])
def test_one_scan_equals_patterns(spark, gated):
    """Each concept's own pattern, run by the JVM over the whole text, is the measure."""
    tax = from_dict(MIXED)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(random_texts(4, 3000) + ["", " "])], "i int, text string").repartition(3)
    own = [F.when(match.has_concept(F.col("text"), c), F.struct(F.lit(c.key).alias("concept"), match.synonym_hits(F.col("text"), c).alias("synonyms"))) for c in tax.concepts]
    inside = match.in_domain(F.col("text"), tax)
    want = df.withColumns({"inside": inside, "want": F.when(inside | F.lit(not gated), F.array_compact(F.array(*own))).otherwise(F.array().cast(f"array<{match.HIT}>"))})
    rows = match.matched(want, tax, gated=gated).collect()
    assert len(rows) == 3002
    for r in rows:
        assert (r.in_domain, r.hits) == (r.inside, r.want), r.text
        assert r.concepts == [h.concept for h in r.hits]
    seen = {(h.concept, s.synonym, min(s.n, 3)) for r in rows for h in r.hits for s in h.synonyms}
    assert {(k, n) for k, _, n in seen} >= {(c.key, n) for c in tax.concepts if c.key != "TURK" for n in (1, 2)} and ("TURK", "ısı pompa", 1) in seen


def test_null_texts_and_no_concepts(spark):
    df = spark.createDataFrame([(None,), ("the",)], "text string")
    got = sorted(map(tuple, match.matched(df, from_dict(MIXED)).select("text", "in_domain", "hits", "concepts").collect()), key=str)
    assert got == [("the", True, [], []), (None, None, [], [])] or got == [(None, None, [], []), ("the", True, [], [])]
    none = from_dict({"domain_terms": [], "categories": {}})
    assert [tuple(r) for r in match.matched(df, none, gated=False).select("in_domain", "hits").collect()] == [(None, []), (False, [])]


def test_raw_domain_terms(spark):
    tax = from_dict({"domain_terms": [r"re:\bchip\d+", "wafer"], "categories": {"c": {"A": {"synonyms": ["gate"]}, "B": {"synonyms": ["re:g[aei]te"]}}}})
    df = spark.createDataFrame([("chip7 gate",), ("wafer gite gate",), ("gate",)], "text string")
    got = {r.text: (r.in_domain, [(h.concept, [tuple(s) for s in h.synonyms]) for h in r.hits]) for r in match.matched(df, tax).collect()}
    assert got == {"chip7 gate": (True, [("A", [("gate", 1)]), ("B", [("re:g[aei]te", 1)])]), "wafer gite gate": (True, [("A", [("gate", 1)]), ("B", [("re:g[aei]te", 2)])]), "gate": (False, [])}


def test_memory_of_matching_follows_no_batch():
    """A batch of any number of texts is searched in parts, with the hits of each text alone."""
    rng = random.Random(8)
    lexicon, keys = scan.Lexicon([("wafer", "FET"), ("nano sheet", "NSFET"), ("GAA", "GAA nanosheet")]), ["NANO", "GAA"]
    texts = [" ".join(rng.choices(["wafer", "nano", "sheets", "GAA", "nanosheet", "for", "w12", "FETs"], k=rng.randrange(600))) for _ in range(4000)]
    batch = pa.array([None, "", *texts, "GAA wafer " * 300_000, None])
    tracemalloc.start()
    got = scan.as_found(lexicon, keys, batch, True)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 160e6  # the whole batch at once takes 269 MB
    assert len(got) == len(batch) and got[2].is_valid and not got[0]["inside"].is_valid
    for i in (0, 1, 2, 1500, 4001, 4003):
        assert got[i] == scan.as_found(lexicon, keys, batch.slice(i, 1), True)[0]
