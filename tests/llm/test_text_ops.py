"""BPE, token files, PII, quality rules and toxicity against brute force."""

import collections
import hashlib
import math
import random
import re
import statistics
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexipulse.llm import bpe, mixing, pii, quality, token_store, toxicity
from lexipulse.llm.queries import VOCABULARY

DOC = "doc_id long, text string, lang string, source string, n_chars long, decoded string, hashes string"
ODD = [
    None, "", " ", "\n\t", "Hello, world!", "a\x1cb c\x1d", "İstanbul ΣΑΣ Σ", "x<|endoftext|>y <|startoftext|> <|endof", "it's DON'T we'll !'s 'S", "é é ñandú Ünïté", "가 한국어 日本語 🙂🙂 \xa0\x85x", "１２３ ½ ²", "aaaaaaaa" * 40,
    "ab" * 3000 + "!?" * 500, "\x00\x07﻿​", "Word, word. WORD; word!? naïve, naïve.", "word " * 3000,
]


def frame(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", 0, "clash", "clash") for i, t in enumerate(texts)], DOC)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_bpe_equals_library(spark, library):
    got = {r.doc_id: r for r in bpe.bpe_digests(frame(spark, ODD), VOCABULARY).collect()}
    full = {r.doc_id: r for r in bpe.bpe_encode(frame(spark, ODD), VOCABULARY).collect()}
    for i, t in enumerate(ODD):
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(text.encode())), repr(t)[:60]
        assert full[i].ids == ids and full[i].decoded == text
    assert bpe.bpe_digests(frame(spark, []), VOCABULARY).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=8))
def test_bpe_on_any_text(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    library = Tokenizer.from_file(VOCABULARY)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for enc in (bpe.encoder(VOCABULARY), token_store.LibraryEncoder(VOCABULARY)):
        ids, n = enc.encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])][: len(texts)] == want


def test_small_cache_and_one_at_a_time_give_the_same():
    texts = ["the theory of thethe", "aaa aaaa", "banana bandana"] * 3
    whole = bpe.encoder(VOCABULARY)
    small = bpe.Encoder(bpe.Bpe(VOCABULARY), most=2)
    single = bpe.Encoder(bpe.Bpe(VOCABULARY))
    single.bpe.at_once = False
    for enc in (small, single):
        for _ in range(2):
            assert enc.encode(texts)[0].tolist() == whole.encode(texts)[0].tolist()


def test_token_files(spark, library):
    docs = frame(spark, ODD).union(spark.createDataFrame([(None, "no id", "en", "s", 0, "", ""), (3, "again", "en", "s", 0, "", "")], DOC))
    for most in (1, 8 << 20):
        folder = token_store.write_tokens(docs, VOCABULARY, 1, shard_tokens=most)
        rows = token_store.read_tokens(spark, folder).collect()
        rows.sort(key=lambda r: r.start)
        assert [r.doc_id for r in rows] == [None, 0, 1, 2, 3, 3, *range(4, len(ODD))]
        at = 0
        for r in rows:
            text = {None: "no id"}.get(r.doc_id, ODD[r.doc_id] if r.doc_id is not None else "")
            ids = library.encode(text or "", add_special_tokens=False).ids + [1]
            if r.doc_id != 3:
                assert r.ids == ids
            assert r.start == at and r.n_tokens == len(r.ids)
            at += r.n_tokens
        crc = {r.start: r.ids_crc32 for r in token_store.read_tokens(spark, folder, digest=True).collect()}
        assert crc == {r.start: zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in rows}
    empty = token_store.write_tokens(frame(spark, []), VOCABULARY, 1)
    assert token_store.read_manifest(empty)["shards"] == [] and token_store.read_tokens(spark, empty).count() == 0


def test_random_access():
    rng = random.Random(5)
    ids = np.array([rng.choice([0, 255, 256, 65535, 65536, 2**31, rng.randrange(70000)]) for _ in range(5000)], np.uint64)
    f = token_store.TokenFile(token_store.encode_file([7, None], np.array([2000, 3000]), ids))
    assert f.depth == 4 and f.doc_ids == [7, None] and f.document(1).tolist() == ids[2000:].tolist()
    assert all(f.token(i) == ids[i] for i in range(0, 5000, 7))
    for _ in range(50):
        a = rng.randrange(5001)
        b = rng.randrange(a, 5001)
        assert f.slice(a, b).tolist() == ids[a:b].tolist()
    with pytest.raises(IndexError):
        f.token(5000)


PII = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")), ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile("[0-9]([\x20-]?[0-9])+")), ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]


def luhn(d):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, p) in enumerate(PII):
        for m in p.finditer(text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_pii_equals_plain_patterns(spark):
    rng = random.Random(3)
    texts = [None, "", "a@b.c.d@e.f x_@y.z_q@r.s @", "é🙂 1.2.3.4.5 999.1.2.3 0.00.255.256 010.0.0.255", "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 1" + "1" * 30, "+1 (444) 555-3382 +1 +12345678 +1234567890123456 +1-2-3-4-5-6-7-8-9-", "9" * 50000, "a" * 50000 + "@", "1." * 20000, "x@y.z, " * 300]
    texts += ["".join(rng.choice("0123456789.@+- ()ab_é🙂") for _ in range(rng.randrange(200))) for _ in range(300)]
    for r in pii.pii_report(frame(spark, texts)).collect():
        want = base_spans(texts[r.doc_id])
        assert r.base_sha256 == sha(want.encode()), repr(texts[r.doc_id])[:200]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(want.count(k + ":") for k, _ in PII)
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))


def test_pii_added_and_redacted(spark):
    texts = ["pay to IBAN GB82 WEST 1234 5698 7654 32 now", "GB82 WEST 1234 5698 7654 33", "bank account 123456789 ok", "number 123456789 ok", "mail a@b.co, a@b.co; +1 (444) 555-3382!", None, "clean"]
    rows = {r.doc_id: r.spans for r in pii.pii_report(frame(spark, texts)).collect()}
    assert rows[0] == "iban:12:39" and rows[1] == "" and rows[2] == "account:13:22" and rows[3] == ""
    got = {r.doc_id: (r.text, r.decoded) for r in pii.redacted(frame(spark, texts)).collect()}
    assert got[4] == ("mail [EMAIL], [EMAIL]; [PHONE]!", "clash") and got[5][0] is None and got[6][0] == "clean"
    assert pii.redacted(frame(spark, [])).columns == frame(spark, []).columns


def test_iban_before_upper_case_words_digits_and_another(spark):
    one, other = "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"
    texts = [f"IBAN {one} BIC NWBKGB2L", f"{one.replace(' ', '')} 2024-05-01", f"{one} {other} {one}", f"{other} XY12 {one}", "GB82 WEST 1234 5698 7654 33 BIC", "XX90 0000 0000 0000 000"]
    rows = {r.doc_id: r.spans for r in pii.pii_report(frame(spark, texts)).collect()}
    assert [rows[i] for i in range(6)] == ["iban:5:32", "iban:0:22", "iban:0:27,iban:28:50,iban:51:78", "iban:0:22,iban:28:55", "", "iban:0:23"]
    assert {r.doc_id: r.text for r in pii.redacted(frame(spark, texts)).collect()}[2] == "[IBAN] [IBAN] [IBAN]"


def test_quality_rules(spark):
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "été", "x#", "$$", "|"]
    texts = [None, "", "a b c\na b c\n\n \na b c", "one two", "a\x1cb\x85c d"] + [rng.choice(" \n\t").join(rng.choice(words) for _ in range(rng.randrange(120))) for _ in range(80)]
    texts += [" ".join(rng.choice(words) + str(rng.randrange(10**6)) for _ in range(80)) for _ in range(40)]
    got = {r.doc_id: r for r in quality.quality(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = re.findall("[^\x20\x09-\x0d]+", t or "")
        count = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {j + k for j in range(len(w) - 2) if count[tuple(w[j : j + 3])] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, repr(t)[:80]
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.base_failed and r.kept)
    kept = quality.kept_documents(frame(spark, texts))
    assert kept.columns == frame(spark, []).columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
    assert quality.quality(frame(spark, [])).count() == 0


def test_noise_lies_outside_the_band(spark):
    rng = random.Random(2)
    prose = [" ".join(rng.choice(["the", "and", "of", "that", "with", "from", "this", "are"]) + " " + "".join(rng.choice(["er", "th", "in", "on", "at"]) for _ in range(3)) for _ in range(60)) for _ in range(200)]
    noise = " ".join("".join(rng.choice("zqxjkvßœñ#*<>;:çù1") for _ in range(6)) for _ in range(200))
    rows = {r.doc_id: r for r in quality.quality(frame(spark, [*prose, noise])).collect()}
    assert not rows[200].base_failed and not rows[200].kept and sum(r.kept for r in rows.values()) == 200


@pytest.mark.parametrize("letters", ["abcdefgh", "абвгдежз"])
def test_junk_of_known_words_lies_outside_the_band(spark, letters):
    rng = random.Random(6)
    common, rare = (["".join(rng.choice(letters) for _ in range(k)) for _ in range(n)] for k, n in ((3, 20), (6, 3000)))
    prose = [[rng.choice(rng.choice([common, rare])) for _ in range(120)] for _ in range(300)]
    texts = [" ".join(w) for w in prose] + [" ".join(x + rng.choice(["$$$", "%%%", "&&&"]) for x in prose[0]), " | ".join(rng.sample(rare, 80))]
    rows = {r.doc_id: r for r in quality.quality(frame(spark, texts)).collect()}  # at production parameters
    assert not any(r.base_failed for r in rows.values()) and [i for i, r in rows.items() if not r.kept] == [300, 301]
    assert len({r.lower for r in rows.values()}) == 1 and all(r.kept == (r.lower <= r.log_perplexity <= r.upper) for r in rows.values())


def test_no_partitioning_changes_a_verdict(spark):
    rng = random.Random(12)
    docs = frame(spark, [" ".join(rng.choice(["in", "over", "the", "land", "wörter", "$"]) + str(rng.randrange(50)) for _ in range(rng.randrange(50, 90))) for _ in range(400)])
    before, out = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (1, 4, 60):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            out.append({tuple(r) for r in quality.quality(docs.repartition(n)).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert out[0] == out[1] == out[2] and len(out[0]) == 400


def test_real_words():
    texts = [None, "", "a", " a  b\t|| $$x é\n", "||", "\x1c", "漢字 ， 1", "x" * 99, "| a"]
    want = [sum(bool(re.search(r"[A-Za-z0-9\x80-\U0010ffff]", w)) for w in re.findall("[^\x20\x09-\x0d]+", t or "")) for t in texts]
    assert quality.real_words(texts).tolist() == want and quality.real_words([]).tolist() == []


def test_kneser_ney_sums_to_one():
    texts = ["the cat sat on the mat. the dog!", "été 12 #x"] * 3
    code, _ = quality.codes(texts, 3)
    m = quality.KneserNey(*np.unique(code, return_counts=True), 3)
    for context in (0, int(code[5] >> 6), 64 * 63 + 9):
        assert abs(np.exp(m.score(np.arange(64) + context * 64)).sum() - 1) < 1e-9


def test_toxicity_held_out(spark):
    rng = random.Random(4)
    clean, bad = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)], ["vile", "rotten", "foul"]
    rows, labels = [], []
    for i in range(1500):
        toxic = i % 5 == 0
        w = [rng.choice(clean) for _ in range(40)]
        if toxic:
            w[5:5] = rng.sample(bad, 2)
        rows.append((i, " ".join(w), "en", "s", 0, "", ""))
        labels.append((i, 1, int(toxic)))
    rows += [(None, None, "en", "s", 0, "", ""), (9999, "", "en", "s", 0, "", "")]
    lab = spark.createDataFrame(labels + [(0, 1, None), (77777, 1, 1)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, DOC)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, lab, bits=18).collect()}
    held = [i for i in range(1500) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out for i in held) and not got[None].held_out and got[None].score == got[9999].score
    assert np.mean([got[i].predicted == (i % 5 == 0) for i in held]) > 0.97
    flipped = lab.withColumn("toxic", lab["toxic"]).where("crc32(cast(doc_id as string)) % 3 <> 1")
    again = {r.doc_id: r.score for r in toxicity.toxicity(docs, flipped, bits=18).collect()}
    assert again == {k: r.score for k, r in got.items()}  # held-out labels change nothing
    none = toxicity.toxicity(docs, lab.where("false"), bits=18).select("score").distinct().collect()
    assert [r.score for r in none] == [0.5]


def test_letters_of_whole_words_have_the_same_lower_case():
    letters = [chr(c) for c in [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x250)] if re.fullmatch("[A-Za-zÀ-ÖØ-öø-įı-ɏ]", chr(c))]
    assert pa.compute.utf8_lower(pa.array(letters)).to_pylist() == [x.lower() for x in letters]
    assert all(unicodedata.normalize("NFC", x + y) == x + y for x in letters for y in "aé.!")


def test_rows_of_one_id_have_one_order(spark):
    rows = [(7, f"text {i % 9}") for i in range(60)] + [(None, f"none {i}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [sorted((r.start, r.ids_crc32) for r in token_store.read_tokens(spark, token_store.write_tokens(d, VOCABULARY, 1), digest=True).collect()) for d in (docs, docs.orderBy("text"), docs.repartition(3))]
    assert len(got[0]) == 80 and got[0] == got[1] == got[2]


def skip_grams(text, bits):
    """Places of words, pairs and pairs with one word between, by their definition, in plain integers."""
    m = (1 << 64) - 1
    k = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)

    def mix(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & m
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & m
        return x ^ x >> 31

    h = [xxhash.xxh3_64_intdigest(w.encode()) for w in re.findall(r"\w+", (text or "").lower())]
    out = [mix(x) for x in h]
    for gap in (1, 2):
        out += [mix((a * k[gap - 1] + (b ^ k[2]) * k[gap]) & m) for a, b in zip(h, h[gap:])]
    return {x >> (64 - bits) for x in out}


def test_features_equal_plain_integers():
    texts = [None, "", "one", "one two", "A b c a B", "x " * 9, "été naïve 12 _y"]
    doc, place = toxicity.features(texts, 18)
    for i, t in enumerate(texts):
        assert set(place[doc == i].tolist()) == skip_grams(t, 18)


def test_ftrl_equals_plain_python():
    rng = random.Random(8)
    rows = [(float(rng.random() < 0.4), np.array(sorted(rng.sample(range(12), rng.randrange(0, 6))), np.int64)) for _ in range(150)]
    alpha, beta, l1, l2 = 0.7, 1.0, 0.3, 0.1
    z, n = collections.defaultdict(float), collections.defaultdict(float)  # "b" is the bias, without L1

    def weight(k):
        cut = 0.0 if k == "b" else l1
        return 0.0 if abs(z[k]) <= cut else -(z[k] - math.copysign(cut, z[k])) / ((beta + math.sqrt(n[k])) / alpha + l2)

    for _ in range(2):
        for label, at in rows:
            keys = ["b", *at.tolist()]
            w = {k: weight(k) for k in keys}
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            for k in keys:
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / alpha * w[k]
                n[k] += g * g
    model = toxicity.fitted(rows, 5, 2, alpha, beta, l1, l2)
    assert np.allclose(model.weights(np.arange(12)), [weight(k) for k in range(12)]) and math.isclose(model.bias, weight("b"), rel_tol=1e-9)
    assert (model.weights(np.arange(12, 32)) == 0).all()


def test_toxicity_bound_and_repeats(spark):
    """At most ``most`` documents train, one row each, however often an id or a label is there."""
    rng = random.Random(5)
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1][:200]
    text = {i: " ".join(rng.choice(["vile", "rotten"] if i % 4 == 0 and rng.random() < 0.3 else ["mild", "soft", "kind", "calm"]) for _ in range(30)) for i in ids}
    docs = spark.createDataFrame([(i, t) for i, t in text.items()] * 1, "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(i % 4 == 0)) for i in ids] * 3 + [(10**6 + i, 1) for i in range(500)], "doc_id long, label int")
    once = toxicity.train(docs, lab, bits=16, most=120, l1=0.2)
    many = toxicity.train(docs.union(docs).union(docs.limit(50)), lab, bits=16, most=120, l1=0.2)
    assert len(once[0]) and all(np.array_equal(a, b) for a, b in zip(once, many))
    other = toxicity.train(docs.union(spark.createDataFrame([(ids[0], "")], "doc_id long, text string")), lab, bits=16, most=120, l1=0.2)
    assert len(other[0])
    scored = toxicity.toxicity(docs.union(docs), lab.selectExpr("doc_id", "label as toxic"), bits=16).collect()
    assert len(scored) == 400 and len({(r.doc_id, r.score) for r in scored}) == 200
    long = spark.createDataFrame([(ids[0], " ".join(f"w{i}" for i in range(9000))), (ids[1], "mild " * 50)], "doc_id long, text string")
    assert len(toxicity.train(long, spark.createDataFrame([(ids[0], 1), (ids[1], 0)], "doc_id long, label int"), bits=16, places=100, l1=0.0)[0]) <= 100 + 3


def character_losses(texts, order=3):
    """Log loss of each text by interpolated modified Kneser-Ney, with dictionaries of strings."""
    table = quality.symbol_table()
    rows = [[0] * (order - 1) + [int(table[ord(c)]) for c in t or ""] for t in texts]
    top = collections.Counter(tuple(r[i - order + 1 : i + 1]) for r in rows for i in range(order - 1, len(r)))
    counts = {order: top}
    for k in range(order - 1, 0, -1):
        counts[k] = collections.Counter(g[-k:] for g in counts[k + 1])
    cut = {}
    for k, c in counts.items():
        n = [sum(v == x for v in c.values()) for x in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        raw = [1 - 2 * y * n[2] / n[1] if n[1] else 0.5, 2 - 3 * y * n[3] / n[2] if n[2] else 1.0, 3 - 4 * y * n[4] / n[3] if n[3] else 1.5]
        cut[k] = [0.0] + [min(max(d, 0.05), i - 0.05) for i, d in enumerate(raw, 1)]
    after = {k: collections.defaultdict(list) for k in counts}
    for k, c in counts.items():
        for g, v in c.items():
            after[k][g[:-1]].append(v)

    def p(g):
        if not g:
            return 1 / 64
        k, seen = len(g), after[len(g)].get(g[:-1])
        if not seen:
            return p(g[1:])
        v = counts[k].get(g, 0)
        return (v - cut[k][min(v, 3)] + sum(cut[k][min(x, 3)] for x in seen) * p(g[1:])) / sum(seen)

    return [-sum(math.log(p(tuple(r[i - order + 1 : i + 1]))) for i in range(order - 1, len(r))) if len(r) >= order else None for r in rows]


def test_quality_verdict_by_brute_force(spark):
    """log_perplexity, band and kept of every row, from the definitions; languages, nulls, repeats and odd columns."""
    rng = random.Random(11)
    vocabulary = {"en": [f"{a}{b}er" for a in "bcdfg" for b in "aeiou"], "de": [f"{a}ö{b}en" for a in "klmnp" for b in "rstvw"], None: ["x", "yz", "zzy", "w"]}
    rows = []
    for i in range(150):
        lang = rng.choice(["en", "en", "de", None])
        w = [rng.choice(vocabulary[lang]) for _ in range(rng.randrange(40, 120))]
        if i % 25 == 7:
            w = [x + rng.choice(["$$$", "%%%"]) for x in w]
        rows.append((i if i % 40 else None, " ".join(w), lang))
    rows += [(200, None, "en"), (201, "", None), (202, "b" * 40_000, "en"), rows[7], rows[7], (7, rows[8][1], "en")]
    names = ["row", "key", "doc", "slot", "tongue", "kept", "median", "lower", "quality_slot"]
    docs = spark.createDataFrame([(*r, *["c"] * len(names)) for r in rows], "doc_id long, text string, lang string, " + ", ".join(f"{c} string" for c in names))
    got = quality.quality(docs).collect()
    assert len(got) == len(rows)
    loss, band = {}, {}
    for lang in ("en", "de", None):
        at = [i for i, r in enumerate(rows) if r[2] == lang]
        for i, x in zip(at, character_losses([rows[i][1] for i in at])):
            real = sum(bool(re.search(r"[A-Za-z0-9\x80-\U0010ffff]", w)) for w in (rows[i][1] or "").split())
            loss[i] = None if x is None else round(x / max(real, 1), 6)
        have = [min(loss[i], 1000) for i in at if loss[i] is not None]
        m = statistics.median(round(x, 3) for x in have)
        wide = 10 * 1.4826 * statistics.median(round(min(abs(loss[i] - m), 1000), 3) for i in at if loss[i] is not None)
        band[lang] = (m - wide, m + wide)
    want, rejected = collections.Counter(), 0
    for i, (d, t, lang) in enumerate(rows):
        w = (t or "").split()
        c = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {j + k for j in range(len(w) - 2) if c[tuple(w[j : j + 3])] > 1 for k in range(3)}
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        inside = loss[i] is None or band[lang][0] <= loss[i] <= band[lang][1]
        rejected += not failed and not inside
        want[d, len(w), failed, not failed and inside, None if loss[i] is None else round(loss[i], 4)] += 1
    have = collections.Counter((r.doc_id, r.n_words, r.base_failed, r.kept, None if r.log_perplexity is None else round(r.log_perplexity, 4)) for r in got)
    assert have == want and rejected >= 5
    kept = quality.kept_documents(docs)
    assert kept.columns == docs.columns
    assert collections.Counter((r.doc_id, len((r.text or "").split())) for r in kept.collect()) == collections.Counter((k[0], k[1]) for k, n in want.items() for _ in range(n) if k[3])


def test_stages_pass_any_columns(spark):
    """Every working name as a column of its own, with null and repeated ids: rows and columns come through whole."""
    names = ["row", "base", "found", "email", "iban", "account", "pii_email", "mix_source", "mix_block", "mix_tokens", "mix_epoch", "mix_copies", "Found", "place", "tokens", "whole", "rest", "blocks", "a.b", "x y"][:-2]
    names.remove("Found")
    rows = [(None, "mail a@b.co", "s"), (1, "mail a@b.co", "s"), (1, "clean", None), (1, "mail a@b.co", "s"), (None, None, "t"), (2, "", "t")]
    docs = spark.createDataFrame([(*r, *[f"{c}!" for c in names], "dot") for r in rows], "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in names) + ", `a.b` string")
    clean = pii.redacted(docs)
    assert clean.columns == docs.columns
    got = clean.collect()
    assert sorted(map(repr, got)) == sorted(repr(r) for r in spark.createDataFrame([(d, t and t.replace("a@b.co", "[EMAIL]"), s, *[f"{c}!" for c in names], "dot") for d, t, s in rows], docs.schema).collect())
    found = pii.find_pii(docs)
    assert found.columns == [c for c in docs.columns if c not in ("base", "found")] + ["base", "found"] and found.count() == 6
    twice = mixing.mixed(docs, repeats=1.0)
    assert twice.columns == docs.columns and sorted(map(repr, twice.collect())) == sorted(map(repr, docs.collect()))


def test_null_ids_repeats_and_long_texts(spark, library):
    long = " ".join(f"word{i % 977}, a@b{i}.org 10.0.{i % 300}.7" for i in range(6000))
    rows = [(None, "no id"), (None, None), (4, long), (4, long), (4, "other x@y.zz"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in bpe.bpe_digests(docs, VOCABULARY).collect())
    ids = [library.encode(t or "", add_special_tokens=False).ids for _, t in rows]
    assert got == collections.Counter((d, len(x), sha(np.array(x, "<u4").tobytes())) for (d, _), x in zip(rows, ids))
    found = collections.Counter((r.doc_id, r.n_email, r.n_ip, r.base_sha256) for r in pii.pii_report(docs).collect())
    want = [base_spans(t) for _, t in rows]
    assert found == collections.Counter((d, w.count("email:"), w.count("ip:"), sha(w.encode())) for (d, _), w in zip(rows, want)) and want[2].count("ip:") > 5000
