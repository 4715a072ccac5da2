"""Fingerprints, spelling variants and ranked search against brute force."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from lexipulse.llm import imatch, maxscore, variants, workspace
from lexipulse.llm.queries import oracle_sql, queries

DOC = "doc_id long, text string, lang string, bucket string, term string, at int, next string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "clash", "clash", 0, "clash") for i, t in rows], DOC)


@pytest.fixture
def parts(spark):
    """Sets the number of shuffle partitions, and puts it back."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.shuffle.partitions", before)


def prose(seed, n=120, vocabulary=500):
    """Texts of words of several alphabets, copies, near copies, repeated words, texts without a term, empty ones."""
    rng = random.Random(seed)
    word = ["".join(rng.choice("abcdeñéÀß") for _ in range(rng.randrange(1, 12))) for _ in range(vocabulary)]
    out = [None, "", " ,.", "a", "A a", "x1-y2 漢字", "\U0001f600 emoji", "one two three"]
    for i in range(n):
        w = [word[min(int(rng.expovariate(0.02)), vocabulary - 1)] for _ in range(rng.choice([3, 40, 200, 700]))]
        out.append(out[-1] if i % 9 == 4 else " ".join(w[:-2]) if i % 9 == 5 else rng.choice([" ", ", ", "-"]).join(w).capitalize())
    return out


# --- fingerprints

def term_digests(text):
    words = set(re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)))
    return {int(hashlib.md5(w.encode()).hexdigest()[:15], 16) for w in words}


def print_of(text, lexicon):
    """level -> subset -> hash, with and without the band."""
    terms = term_digests(text)
    least = max(6, (len(terms) - 1).bit_length() if terms else 0)
    out = []
    for some in (terms & lexicon, terms):
        sets = collections.defaultdict(list)
        for level in (least, least + 1):
            for h in sorted(some):
                if h % 2**level < 64:
                    sets[level, h % 2**level].append(str(h))
        out.append({k: hashlib.md5(" ".join(v).encode()).hexdigest()[:4] for k, v in sets.items()})
    return out


def alike(a, b, least):
    if a == b:
        return 1.0
    x, y = (a[0], b[0]) if min(len(a[0]), len(b[0])) >= least else (a[1], b[1])
    common = {k for k, _ in x} & {k for k, _ in y}
    x, y = ({p: v for p, v in s.items() if p[0] in common} for s in (x, y))
    return sum(y.get(p) == v for p, v in x.items()) / len({*x, *y}) if x or y else 0.0


def shown(p):
    return "|".join("".join(f"{k:02X}{c:02X}{v}" for (k, c), v in sorted(part.items())) for part in p)


@pytest.mark.parametrize("seed, n_parts, most", [(0, 4, 10**6), (1, 23, 10**6), (2, 1, 100)])
def test_fingerprints(spark, parts, seed, n_parts, most):
    parts(n_parts)
    texts = prose(seed)
    random.Random(seed).shuffle(texts)
    rows = [(i * 7 - 50, t) for i, t in enumerate(texts)]
    df = collections.Counter(h for t in texts for h in term_digests(t or ""))
    band = {h: n for h, n in df.items() if 2 <= n <= max(2, len(texts) / math.exp(2.0))}
    lo = next(2**k for k in range(1, 64) if sum(n >= 2**k for n in band.values()) <= most)
    lexicon = {h for h, n in band.items() if n >= lo}
    assert lexicon and (lo > 2) == (most == 100)
    got = {r.doc_id: r for r in imatch.fingerprints(frame(spark, rows[::-1]), low_idf=2.0, lexicon=most, least=4).collect()}
    assert len(got) == len(rows)
    shown_by = []
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        own, other, late = (print_of(x, lexicon) for x in (t, edited, after))
        shown_by.append((shown(own), shown(other), alike(own, other, 4)))
        want = (i, len(t), hashlib.sha256(edited.encode()).hexdigest(), shown(own), shown(other), alike(own, other, 4), alike(own, late, 4))
        assert tuple(got[i]) == want
    pairs = spark.createDataFrame(shown_by, "x string, y string, want double")
    assert all(r.near == r.want for r in imatch.with_likeness(pairs, "near", "x", "y", least=4).collect())


def test_fingerprints_of_few_null_and_repeated_rows(spark, parts):
    assert imatch.fingerprints(frame(spark, [])).collect() == []
    one = imatch.fingerprints(frame(spark, [(5, "abcdefgh")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one.near_next == 1.0
    parts(7)
    rows = [(None, "null " * 9), (None, "other"), (1, None), (1, "same words here"), (1, "same words here"), (2, "w " * 300_000), (3, "")]
    got = imatch.fingerprints(frame(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_chars) for r in got) == [(False, 1, 0), (False, 1, 15), (False, 1, 15), (False, 2, 600_000), (False, 3, 0), (True, 0, 5), (True, 0, 45)]
    by_text = collections.defaultdict(set)
    for r in got:
        by_text[r.doc_id, r.n_chars].add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert by_text[3, 0] == by_text[1, 0] == {"|"}


def test_fingerprints_tell_copies_from_others(spark):
    rng = random.Random(8)
    word = [f"w{k}" for k in range(3000)]
    texts = [" ".join(rng.choices(word, k=n)) for n in (20, 200, 2000) for _ in range(40)]
    got = imatch.fingerprints(frame(spark, enumerate(texts))).collect()
    assert sum(r.near_edited > 0.3 for r in got) >= 0.95 * len(got)
    assert sum(r.near_next < 0.3 for r in got) >= 0.95 * len(got)


# --- spelling variants

RUN = "[A-Za-zÀ-ÿ]+"


def words_by_hand(rows, least=7, often=2, every=31):
    n = collections.Counter()
    for i, t in rows:
        for run in re.findall(RUN, t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= least and k >= often}


def apart_by_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_hand(rows, **how):
    n = words_by_hand(rows, **how)
    near = {w: [x for x in n if x != w and apart_by_one(w, x)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 10 * n[w]:
            form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def misspelt(seed, n=400):
    """Words in the thousands and their slips, slips of slips, anagrams, doubled and accented letters, very long runs."""
    rng = random.Random(seed)
    stem = ["".join(rng.choice("abcÀéßzZ") for _ in range(rng.randrange(6, 13))) for _ in range(25)] + ["aaaaaaaa", "abababab", "babababa", "aabbaabb"]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randrange(0, 60)):
            x = list(stem[min(int(rng.expovariate(0.2)), len(stem) - 1)])
            for _ in range(rng.choice([0] * 12 + [1, 1, 2])):
                p, kind = rng.randrange(len(x)), rng.randrange(4)
                x[p : p + 1] = [[], [x[p], rng.choice("abñ")], [rng.choice("abcÿ")], x[p : p + 2][::-1]][kind] or []
            w.append("".join(x))
        rows.append((i * 3 - 9, rng.choice([" ", "1", "，", "-", "Ā"]).join(w)))
    long = "".join(rng.choice("xyé") for _ in range(5000))
    chain = [(100, "kaaaaaaak " * 300), (101, "kaaaaaaakl " * 25), (102, "kaaaaaaaklm " * 2)]
    return [*rows, *chain, (7, None), (8, ""), (9, "short"), (None, "nullified nullified"), (1, "repeated repeated"), (1, "repeated repeated"), (2, long), (3, long + " " + long[:-1] + " " + long[:-1])]


@pytest.mark.parametrize("seed", [0, 1])
def test_variants(spark, seed):
    rows = misspelt(seed)
    want = variants_by_hand(rows)
    assert any(f and r != f for _, f, r, *_ in want)  # a chain of forms
    got = variants.variants(frame(spark, rows)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_variants_other_bounds_and_no_words(spark):
    rows = misspelt(5, 60)
    got = variants.variants(frame(spark, rows), least=3, often=1, every=2).collect()
    assert {tuple(r) for r in got} == variants_by_hand(rows, least=3, often=1, every=2)
    assert variants.variants(frame(spark, [])).collect() == [] == variants.variants(frame(spark, [(1, None), (2, "a b")])).collect()


def test_roots_of_a_chain(spark):
    links = spark.createDataFrame([(f"w{i:02}", f"w{i + 1:02}") for i in range(19)] + [("x", "w05")], "word string, form string")
    assert {r.root for r in variants.roots(links).collect()} == {"w19"}


def test_checksums_of_pairs_equal_the_library():
    rng = random.Random(3)
    heads, tails = [f"{i}:".encode() for i in range(20)], [rng.randbytes(n) for n in (0, 1, 7, 63, 64, 65, 400)]
    pairs = [(a, b) for a in range(20) for b in range(7)]
    got = variants.joined_crc(np.array([zlib.crc32(h) for h in heads], np.uint32), np.array([a for a, _ in pairs]), tails, np.array([b for _, b in pairs]))
    assert got.tolist() == [zlib.crc32(heads[a] + tails[b]) for a, b in pairs]


# --- ranked search

TERM = "[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"


def terms_by_hand(text):
    return re.findall(TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked_by_hand(rows, items, k=10):
    docs = [(i, collections.Counter(terms_by_hand(t))) for i, t in rows]
    n, length = sum(bool(c) for _, c in docs), sum(c.total() for _, c in docs)
    df = collections.Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in docs:
            m = 10 + 90 * c.total() * n // max(length, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms_by_hand(text)) if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def asked(spark, items):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in items], "item_id long, text string, doc_id string, rank int")


@pytest.mark.parametrize("seed, k, block, rows_a_batch", [(0, 10, 1 << 22, 4096), (1, 3, 200, 4096), (2, 1, 1 << 22, 7)])
def test_ranked_search(spark, seed, k, block, rows_a_batch, monkeypatch):
    monkeypatch.setattr(workspace, "BATCH_ROWS", rows_a_batch)  # many small shards, so thresholds go from one to the next
    rng = random.Random(seed)
    texts = prose(seed, 300)
    rows = [*((i * 5 - 40, t) for i, t in enumerate(texts)), (None, texts[40]), (None, texts[60]), (3, texts[40]), (3, texts[40])]
    rng.shuffle(rows)
    items = [(i, " ".join(rng.sample((texts[rng.randrange(8, len(texts))] or "").split() or ["x"], 1) + (texts[rng.randrange(8, len(texts))] or "").split()[: rng.randrange(1, 40)])) for i in range(30)]
    items += [(90, None), (91, ""), (92, "nowhere"), (93, items[0][1]), (93, items[0][1]), (None, "one two three x1 漢字"), (94, "one one ONE two")]
    got = maxscore.search(frame(spark, rows).repartition(3), asked(spark, items), k=k, block=block).collect()
    assert sorted(map(tuple, got), key=str) == ranked_by_hand(rows, dict.fromkeys(items), k)


def test_ranked_search_edges(spark):
    some = frame(spark, [(1, "a b c"), (2, "a a a"), (3, None), (4, "...")])
    assert maxscore.search(some, asked(spark, [])).collect() == [] == maxscore.search(frame(spark, []), asked(spark, [(1, "a")])).collect()
    rows = [(1, "a b"), (1, "a c"), (2, "a")]  # one id with two texts: two answers
    got = maxscore.search(some, asked(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == ranked_by_hand([(1, "a b c"), (2, "a a a"), (3, None), (4, "...")], rows)
    long = [(i, "w " * 200_000 if i == 7 else f"w{i} common " * (i + 1)) for i in range(20)]
    assert sorted(map(tuple, maxscore.search(frame(spark, long), asked(spark, [(5, "w common w3")])).collect()), key=str) == ranked_by_hand(long, [(5, "w common w3")])


def test_non_essential_postings_are_probed_only_where_a_document_can_qualify():
    rng = np.random.default_rng(4)
    everywhere, rare = np.arange(4096), np.sort(rng.choice(4096, 30, replace=False))
    lists = [(everywhere, rng.integers(1, 100, 4096)), (rare, rng.integers(900, 1000, 30))]
    full = np.zeros(4096, np.int64)
    for places, c in lists:
        full[places] += c
    for least, most in ((1, 4126), (200, 60), (950, 60), (1200, 0)):
        places, score, looked = maxscore.rank_shard(lists, 4096, least)
        assert places.tolist() == np.flatnonzero(full >= least).tolist() and score.tolist() == full[full >= least].tolist() and looked <= most
    assert maxscore.rank_shard([], 5, 1)[0].tolist() == []


# --- all queries

@pytest.mark.parametrize("name", ["op11_imatch", "op12_variants", "op13_maxscore"])
@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_query_equals_sql(spark, name):
    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    df, want = queries()[name](spark, folder), con.execute(oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)
