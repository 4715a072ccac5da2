"""Joins, language model, mixing, substring de-duplication and neighbours against brute force."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions

from lexipulse.llm import ann, graph, jaccard, lm, mixing, substring, workspace
from lexipulse.llm.queries import oracle_sql, queries

DOC = "doc_id long, text string, lang string, source string, n_chars long, block string, hashes string"


def frame(spark, texts, source=None):
    return spark.createDataFrame([(i, t, "en", source(i) if source else "s", 0, "clash", "clash") for i, t in enumerate(texts)], DOC)


def corpus(seed, n=150, vocabulary=400):
    """Unique texts, exact copies, near copies, a common passage, empty and short texts."""
    rng = random.Random(seed)
    word = [f"W{rng.randrange(10**6)}" for _ in range(vocabulary)]
    text = lambda k: [rng.choice(word) for _ in range(k)]
    passage, base = text(30), text(120)
    out = [None, "", " \n", "one", "one", "One", "two words", "a b c", "A B C", "\x1cx y"]
    for i in range(n):
        kind = i % 6
        w = text(rng.randrange(3, 160))
        if kind == 1:
            w = list(base)
            for _ in range(rng.randrange(0, 9)):
                w[rng.randrange(len(w))] = rng.choice(word)
        elif kind == 2:
            w[len(w) // 2 : len(w) // 2] = passage
        elif kind == 3 and i > 20:
            out.append(out[rng.randrange(10, len(out))])
            continue
        elif kind == 4:
            w = passage + text(rng.randrange(4))
        out.append(rng.choice([" ", "\n", "  "]).join(w))
    return out


def components(texts, k, num, den):
    sets = []
    for t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in range(len(sets))}


@pytest.mark.parametrize("seed,k,num,den", [(1, 3, 90, 100), (2, 5, 80, 100), (3, 3, 50, 100), (4, 2, 1, 1)])
def test_jaccard_components(spark, seed, k, num, den):
    texts = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(frame(spark, texts), k, num, den).collect()}
    assert got == components(texts, k, num, den)


def test_jaccard_edges(spark):
    assert jaccard.jaccard_components(frame(spark, [])).count() == 0
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_components(frame(spark, [None, ""])).collect()} == {0: 0, 1: 1}
    rows = [(5, "a b c d"), (None, "a b c d"), (7, "a b c d"), (7, "x y z"), (9, "x y z"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in jaccard.jaccard_components(df).collect()), key=repr)
    assert got == sorted([(5, 5), (None, 5), (7, 5), (7, 7), (9, 7), (None, None)], key=repr)


def test_components_of_a_chain(spark):
    n = 40
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, n)] + [(100, 101), (101, 100), (200, 200)], "u long, v long")
    got = {r.node: r.label for r in graph.components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, n + 1)}, 100: 100, 101: 100}


@pytest.mark.parametrize("seed", [4, 5])
def test_substring(spark, seed):
    texts = corpus(seed)
    got = {r.doc_id: r for r in substring.substring_dedup(frame(spark, texts)).collect()}
    digest = {r.doc_id: r.kept_sha256 for r in substring.substring_dedup(frame(spark, texts), digest=True).collect()}
    first, removed = {}, 0
    for i, t in enumerate(texts):
        w, gone = re.findall("[^\x20\x09-\x0d]+", t or ""), set()
        for j in range(len(w) - 12):
            if first.setdefault(tuple(w[j : j + 13]), i) < i:
                gone |= set(range(j, j + 13))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept) == (len(w), len(gone), kept)
        assert digest[i] == hashlib.sha256(kept.encode()).hexdigest()
        removed += len(gone)
    assert removed > 500 and substring.substring_dedup(frame(spark, [])).count() == 0
    rows = spark.createDataFrame([(None, "w " * 13), (2, "w " * 13), (2, "w " * 13)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_removed) for r in substring.substring_dedup(rows).collect()) == [("2", 0), ("2", 0), ("None", 13)]


def test_lm_scores(spark):
    texts = corpus(6, n=90)
    words = [re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    grams = lambda w, k: collections.Counter(zip(*(w[i:] for i in range(k))))
    every = [sum((grams(w, k) for w in words), collections.Counter()) for k in (1, 2, 3)]
    total = sum(map(len, words))
    got = {r.doc_id: r for r in lm.backoff_scores(frame(spark, texts)).collect()}
    for i, w in enumerate(words):
        own = [grams(w, k) for k in (1, 2, 3)]
        f = lambda g: every[len(g) - 1][g] - own[len(g) - 1][g]

        def score(g):
            if f(g) > 0:
                return f(g) / (f(g[:-1]) if len(g) > 1 else total - len(w))
            return 0.4 * (score(g[1:]) if len(g) > 1 else 1 / (total - len(w)))

        want = sum(math.log(score(tuple(w[max(0, j - 2) : j + 1]))) for j in range(len(w)))
        assert got[i].n_words == len(w) and math.isclose(got[i].log_score, want, rel_tol=1e-9, abs_tol=1e-9)
        assert got[i].mean_log_score is None if not w else math.isclose(got[i].mean_log_score, want / len(w))
    assert lm.backoff_scores(frame(spark, [])).count() == 0 and lm.backoff_scores(frame(spark, [None, ""])).count() == 2


def test_lm_scores_of_lone_blocks(spark):
    texts = ["a b c d", "d x b y a z", "q r s", "a b c e"]
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        got = []
        for n in ("1", "64"):  # all in one block; about one document a block
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append({r.doc_id: r.log_score for r in lm.backoff_scores(frame(spark, texts)).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert got[0] == pytest.approx(got[1], abs=1e-9)
    # no pair of the third text occurs elsewhere: each word backs off from as many orders as it has words before it
    assert got[1][2] == pytest.approx(3 * math.log(0.4 / 14) + 3 * math.log(0.4))


def test_lm_scores_of_repeated_and_null_ids(spark):
    rows = [(None, "a b c"), (None, "a b d"), (1, "a b c"), (1, "x y"), (1, None)]
    one = sorted((r.n_words, round(r.log_score, 9)) for r in lm.backoff_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    two = sorted((r.n_words, round(r.log_score, 9)) for r in lm.backoff_scores(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")).collect())
    assert one == two and len(one) == 5


def test_mixing(spark):
    rng = random.Random(7)
    size = {"big": 300, "mid": 60, "small": 20, None: 10}
    rows = [(s, "w " * rng.randrange(1, 60)) for s, n in size.items() for _ in range(n)] + [("empty", None), ("empty", "")]
    docs = spark.createDataFrame([(i, t, "en", s, 0, "", "") for i, (s, t) in enumerate(rows)], DOC)
    for repeats in (1.0, 2.0, 3.5):
        got = mixing.mix_report(docs, repeats=repeats, blocks=16).collect()
        again = mixing.mix_report(docs, repeats=repeats, blocks=16).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, again))
        copies = collections.Counter(r.doc_id for r in got)
        assert set(copies) == set(range(len(rows))) and len({(r.doc_id, r.epoch) for r in got}) == len(got)
        have = collections.Counter()
        for s, t in rows:
            have[s or ""] += len((t or "").split())
        used = collections.Counter()
        for r in got:
            used[r.source] += r.tokens
        ratio = {s: (max(have.values()) / n) for s, n in have.items() if n}
        t = 1 - math.log(repeats) / math.log(max(ratio.values()))
        for s, x in ratio.items():
            want = x ** (1 - max(t, 0)) * have[s]
            assert used[s] <= want * 1.001 and used[s] >= min(want, have[s]) - 1e-6 and used[s] > want - 0.6 * have[s]
        blocks = {(r.source, r.block, r.doc_id): None for r in got}
        for (s, b, d) in blocks:  # a block is read as a whole
            assert len({copies[x.doc_id] for x in got if (x.source, x.block) == (s, b)}) == 1 or s == "empty"
            break
    assert mixing.mix_report(docs.where("false")).count() == 0
    sources = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 0)], "mix_source string, tokens long")
    h = lambda t: (lambda p: -sum(x * math.log(x) for x in p) / math.log(2))([1000**t / (1000**t + 10**t), 10**t / (1000**t + 10**t)])
    t = mixing.exponent(sources, 1000.0, 0.9)
    assert abs(h(t) - 0.9) < 1e-3 and mixing.exponent(sources, 10.0, None) == pytest.approx(0.5, abs=1e-4)


def mixed_by_hand(have, repeats, budget):
    """source -> tokens wanted, for sources with tokens: the definition, by halving."""
    n = {s: x for s, x in have.items() if x}
    total = min(budget, repeats * sum(n.values())) if budget else None

    def want(t):
        s = sum(x**t for x in n.values())
        return {k: total * x**t / s if total else x**t * max(n.values()) ** (1 - t) for k, x in n.items()}

    low, high = 0.0, 1.0
    for _ in range(60):
        t = (low + high) / 2
        low, high = (low, t) if max(w / n[k] for k, w in want(t).items()) <= repeats else (t, high)
    return want(low if max(w / n[k] for k, w in want(low).items()) <= repeats else high)


@pytest.mark.parametrize("repeats,budget", [(1.0, None), (2.0, None), (3.5, None), (2.0, 3000), (4.0, 20000), (2.0, 10**9)])
def test_every_block_of_a_mix(spark, repeats, budget):
    rng = random.Random(9)
    size = {"big": 200, "mid": 50, "small": 15, None: 6}
    rows = [(s, "w " * rng.randrange(1, 60)) for s, n in size.items() for _ in range(n)] + [("empty", None), ("empty", "")]
    rows += rows[-30:]  # repeated rows
    ids = [None if i % 17 == 3 else i if i < 250 else i - 100 for i in range(len(rows))]  # null and repeated ids
    docs = spark.createDataFrame([(d, t, "en", s, 0, "", "") for d, (s, t) in zip(ids, rows)], DOC)
    got = mixing.mix_report(docs, repeats=repeats, budget=budget, blocks=16).collect()
    have = collections.Counter()
    for s, t in rows:
        have[s or ""] += len((t or "").split())
    want = mixed_by_hand(have, repeats, budget)
    # readings of each block in each epoch, and the key of its place there
    read, place, tokens = collections.Counter(), {}, collections.Counter()
    for r in got:
        read[r.source, r.epoch, r.block] += r.tokens
        place[r.source, r.epoch, r.block] = r.place
    assert len(place) == len(set(place.values()))
    for s, n in have.items():
        if not n:
            assert sorted(r.epoch for r in got if r.source == s) == [0] * sum((x or "") == s for x, _ in rows)
            continue
        ratio = want[s] / n
        whole = math.floor(ratio + 1e-7)
        every = {b: x for (src, e, b), x in read.items() if src == s and e == 0}
        if whole:
            assert sum(every.values()) == n
            for e in range(1, whole):
                assert {b: x for (src, e_, b), x in read.items() if (src, e_) == (s, e)} == every
        # the last part: blocks by place, each that still fits
        last = {b: x for (src, e, b), x in read.items() if (src, e) == (s, whole)}
        assert not any(e > whole for (src, e, _) in read if src == s)
        if whole:
            key = spark.createDataFrame([(s, whole, b) for b in every], "s string, e int, b int").select("b", functions.xxhash64(functions.lit(11), "s", "e", "b").alias("p"))
            order, used, take = sorted((r.p, r.b) for r in key.collect()), 0, {}
            for _, b in order:
                if every[b] and used + every[b] <= (ratio - whole) * n + 0.5:
                    used, take[b] = used + every[b], every[b]
            assert last == take
        assert sum(last.values()) <= (ratio - whole) * n + 0.5
    if budget is None:
        assert collections.Counter(r.doc_id for r in got if r.epoch == 0) == collections.Counter(ids)
    else:
        total = sum(r.tokens for r in got)
        asked = min(budget, repeats * sum(have.values()))
        assert total <= asked + 1 and total > asked - sum(max((x for (src, _, b), x in read.items() if src == s), default=n) for s, n in have.items())


def test_mixing_goes_past_a_block_that_does_not_fit(spark):
    rows = [("big", "w " * 30000)] + [("small", "w " * 20) for _ in range(300)] + [("small", "w " * 10000)]
    for first, null in ((0, False), (1, False), (2, False), (3, False), (0, True)):  # null doc_ids lie in one block
        docs = spark.createDataFrame([(None if null and len(t) > 10000 or null and i % 2 else i, t, "en", s, 0, "", "") for i, (s, t) in enumerate(rows)], DOC)
        got = mixing.mix_report(docs, repeats=1.5, seed=first).where("source = 'small'").groupBy().sum("tokens").first()[0]
        # 16000 tokens, wanted 1.5 times; all blocks but the long document's and, with nulls, its companions' fit
        fit = sum(len(t.split()) for i, (s, t) in enumerate(rows) if s == "small" and len(t) < 1000 and not (null and i % 2))
        assert 16000 + 0.95 * fit <= got <= 1.5 * 16000 + 1
    assert rows


def exact(x, q, k):
    s = x.astype(float) @ x[q].astype(float)
    s[q] = -np.inf
    return np.lexsort((np.arange(len(x)), -s))[:k], s


def test_neighbours(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[5] = x[6] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1020, []), (1040, [0.0] * 16), (1060, [float("nan")] * 16), (1080, [None] * 16), (1100, [1.0] * 3), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "id long, vector array<float>")
    got = collections.defaultdict(list)
    for r in ann.search(df, lambda i: i % 20 == 0, k=20, cells=8, piece=64, block=10, wave=20).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert sorted(got) == list(range(0, 900, 20))
    hit = 0
    for q, found in got.items():
        found.sort()
        want, s = exact(x, q, 20)
        assert [r for r, *_ in found] == list(range(1, 21)) and q not in [v for _, v, _ in found]
        assert all(math.isclose(c, s[v], rel_tol=1e-12) for _, v, c in found)
        assert [(-c, v) for _, v, c in found] == sorted((-c, v) for _, v, c in found)
        hit += len({v for _, v, _ in found} & set(want.tolist()))
    assert hit / 20 / len(got) >= 0.9
    few = ann.search(df.where("id < 4"), lambda i: i == 0, k=20)
    assert few.count() == 3 and ann.search(df.where("id >= 1000"), lambda i: i % 20 == 0).count() == 0


def test_neighbours_at_production_parameters(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(300, 32))
    share = {}
    for kind, n in (("loose", 2_400), ("loose", 12_000), ("clusters", 2_400), ("clusters", 12_000)):
        x = (rng.normal(size=(n, 32)) if kind == "loose" else centre[rng.integers(0, 300, n)] + 0.3 * rng.normal(size=(n, 32))).astype(np.float32)
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>")
        index = ann.Index(df, lambda i: i % 20 == 0, 20, 64, 16_384, 12, 0.95, 64, 8_192, 7)
        share[kind, n] = index.want / n
        got = collections.defaultdict(set)
        for r in ann.answers(index, 20, 1_024, 32_768).collect():
            got[r.query_id].add(r.vec_id)
        hit = [len(got[q] & set(exact(x, q, 20)[0].tolist())) / 20 for q in range(0, n, 20)]
        assert len(got) == len(hit) and np.mean(hit) >= 0.9
    # the walk is a falling share of the table, and a small one where vectors have clusters
    assert share["loose", 12_000] < 0.95 * share["loose", 2_400] and share["clusters", 12_000] < 0.15 and share["clusters", 12_000] < 0.8 * share["clusters", 2_400]


def test_neighbours_of_repeated_ids_and_doubles(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 4))
    rows = [(i % 40, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist())] * 2  # ids 0 to 19 twice; one row three times
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(df, lambda i: i % 20 == 0, k=3, recall=1.0, cells=4).collect())
    want = []
    for q in (0, 20, 40):
        s = x @ x[q]
        s[q] = -np.inf
        order = sorted(range(60), key=lambda j: (-s[j], j % 40))[:3]
        want += [(q % 40, k + 1, j % 40, s[j]) for k, j in enumerate(order)]
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)] and np.allclose([g[3] for g in got], [w[3] for w in sorted(want)], rtol=1e-12)


def by_brute_force(x, q, k):
    """Inner products summed as the operator does, ties to the smaller id."""
    score = (x * x[q]).sum(1)
    score[q] = -np.inf
    best = np.lexsort((np.arange(len(x)), -score))[:k]
    return [(int(i), float(score[i])) for i in best]


@pytest.mark.parametrize("size", [1.0, 1e3, 1e8])
def test_neighbours_among_near_ties(spark, size):
    """Vectors that differ in their last digits alone: rough scores say nothing about their order."""
    rng = np.random.default_rng(3)
    x = size * (1 + 1e-13 * rng.integers(-50, 50, (400, 32)))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    got = collections.defaultdict(list)
    for r in ann.search(rows, lambda i: i % 10 == 0, k=20, recall=1.0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert all(got[q] == by_brute_force(x, q, 20) for q in range(0, 400, 10))


def test_neighbours_of_rows_repeated_25_times(spark):
    """A third of the rows are copies of one vector, the others come 25 times each: answers are those of single rows."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    one = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>")
    many = functions.explode(functions.sequence(functions.lit(1), functions.when(functions.col("id") == 7, 3000).otherwise(25)))
    answer = lambda df: sorted(map(tuple, ann.search(df, lambda i: i % 20 == 0, k=20).collect()))
    want = answer(one)
    assert len(want) == 15 * 20 and answer(one.withColumn("copy", many).drop("copy")) == want


def templated(n, own):
    rng, page = random.Random(1), [f"c{i}" for i in range(102)]
    for _ in range(n):
        w = list(page)
        for _ in range(own):
            w.insert(rng.randrange(len(w) + 1), f"u{rng.randrange(10**12)}")
        yield " ".join(w)


def test_common_page_without_links_costs_no_pairs(spark):
    """Unique words amid one page of 100 shingles: candidates must not grow with the square of the rows."""
    candidates = {}
    for n in (250, 1000):
        join = jaccard.Join(frame(spark, list(templated(n, 3))), 3, 90, 100)
        shared = join.shared()
        label = graph.components(join.verify(join.star_pairs(shared)))
        candidates[n] = join.cross_pairs(shared, label)[0].count() + join.star_pairs(shared).count()
        assert shared.count() > n
    assert candidates[1000] <= 1000
    texts = list(templated(120, 2)) + list(templated(60, 1))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(frame(spark, texts)).collect()}
    assert got == components(texts, 3, 90, 100)


def test_near_duplicates_by_row(spark):
    """Nothing but copies goes: neither rows that share a doc_id nor columns of working names are lost."""
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    near = a.replace("a39", "z")
    rows = [(1, a, "1"), (5, a, "2"), (5, b, "3"), (None, a, "4"), (None, " ".join(f"n{i}" for i in range(9)), "5"), (7, b, "6"), (9, near, "7"), (5, b, "8"), (11, None, "9"), (11, "", "9"), (11, None, "9")]
    names = ["row", "key", "doc", "node", "grp", "n", "label", "first", "salt", "stays", "rows", "comp", "tok"]
    df = spark.createDataFrame([(*r, *[r[2]] * len(names)) for r in rows], "doc_id long, text string, " + ", ".join(f"{c} string" for c in ["n_chars", *names]))
    out = jaccard.without_near_duplicates(df)
    got = out.collect()
    assert got and df.columns == out.columns
    kept = sorted((r.n_chars for r in got))
    assert kept in (["1", "3", "5", "9", "9", "9"], ["1", "5", "8", "9", "9", "9"]) and all(set(r[3:]) == {r.n_chars} for r in got)
    assert jaccard.without_near_duplicates(df.where("false")).count() == 0


def test_packed_hashes_and_words():
    rng = np.random.default_rng(9)
    for n in (0, 1, 2, 1000):
        h = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
        assert workspace.unpack_sorted(workspace.pack_sorted(h)).tolist() == h.tolist()
    c = rng.integers(0, 2**40, 500)
    assert lm.unpack_counts(lm.pack_counts(c)).tolist() == c.tolist()
    texts = [None, "", "  A b", "b  a\x1cc\n", "x" * 5000 + " a", "é É"]
    h, n = workspace.hashed_words(texts, lower=True)
    words = [w for t in texts for w in (t or "").encode().lower().split()]
    assert n.tolist() == [len((t or "").encode().split()) for t in texts] and len(set(zip(words, h.tolist()))) == len(set(words)) == len(set(h.tolist()))


def test_every_operator_has_a_query():
    names = queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and set(oracle_sql()) <= set(names)
