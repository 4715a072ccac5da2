"""Exact n-gram Jaccard join: grouped prefix join with connected components.

A document's set holds the hashes of its distinct word shingles. Sets are put in one order, rare shingles first, taken
from a counting sketch of fixed size over all documents (any order gives right results; this one keeps frequent
passages out of prefixes). Two sets of Jaccard similarity t or more share a shingle of their prefixes, the first
n - ceil(t n) + 1 of each. Words are told apart by 64-bit hashes.

1. Documents of equal sets form one node; nodes of equal size and prefix form one group.
2. Blocks of groups send their prefix shingles, keyed with the size band, to ranges of the hash space and learn which
   are shared. Groups meet the pivot of each shared key, so that a key of k groups gives k pairs. Pairs pass the size and position filters, are expanded to members, pass a bound on the
   symmetric difference from 1024 parity bits, and are verified on the whole sets.
3. Verified links give components. Pairs inside a component need no check; where a shingle meets several components,
   every member outside the largest of them is paired with all members of other components, and these pairs take the
   same filters and the same verification. So no link between components is lost, and a group of k copies costs k.

Equal 64-bit set hashes are taken for equal sets: at n distinct sets, odds n**2 / 2**65 of one mistake.

Null, empty and blank texts have no shingles and link to nothing. Texts with fewer words than a shingle have one, the
whole sequence. Rows of equal doc_id count as documents of their own; rows with a null doc_id give no component_id to
others, and have their own only through others. An empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .bpe import slices
from .graph import components
from .substring import _among, _joined, _rows, _shared_anchors
from .workspace import bounded_batches, bucket_edges, buckets, dropped, hashed_words, mix64, only_cache, pack_sorted, reclaim, shuffle_parts, split_by, stored, unpack_sorted, window_hashes

CELLS, SLICES = 1 << 22, 64
PARITY = 16
FLAGS = 1 << 22
#: Pairs of one node that one task verifies.
PAIRS = 64


def shingles(texts: list[str | None], k: int) -> list[np.ndarray]:
    """The shingle hashes of each text, in text order, repeats included."""
    h, size = hashed_words(texts, lower=True)
    start = np.cumsum(size) - size
    full = window_hashes(h, k)
    return [full[s : s + n - k + 1] if n >= k else window_hashes(h[s : s + n], n) if n else full[:0] for s, n in zip(start.tolist(), size.tolist())]


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def node_of(s: np.ndarray) -> int:
    v = xxh3_64_intdigest(s.tobytes())
    return v - (1 << 64) if v >> 63 else v


def prefix_length(n: int, num: int, den: int) -> int:
    return n + (-num * n) // den + 1


def _sketch(batches, k: int, parts: int):
    only_cache("powers")
    cells = np.zeros(CELLS, np.uint32)
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for a, b in slices(texts):
            h = np.concatenate(shingles(texts[a:b], k))
            at, n = np.unique(h & np.uint64(CELLS - 1), return_counts=True)
            cells[at] += n.astype(np.uint32)
    yield pa.RecordBatch.from_pydict({"part": pa.array(range(parts), pa.int32()), "cells": pa.array([_deflated(c) for c in np.split(cells, parts)], pa.binary())})


def _deflated(cells: np.ndarray) -> bytes:
    """Counts byte by byte, deflated: most are small."""
    return zlib.compress(cells.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _inflated(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _add_cells(table: pa.Table) -> pa.Table:
    total = np.zeros(CELLS // SLICES, np.uint64)
    for raw in table.column("cells").to_pylist():
        total += _inflated(raw)
    total = np.minimum(total, np.uint64(2**32 - 1))
    return pa.table({"part": table.column("part").slice(0, 1), "cells": pa.array([_deflated(total)], pa.binary())})


def shingle_counts(text: DataFrame, k: int, parts: int = SLICES) -> np.ndarray:
    """How many shingles fall in each of CELLS cells, over all documents: an array of fixed size."""
    rows = text.select("text").mapInArrow(lambda it: _sketch(it, k, parts), "part int, cells binary").groupBy("part").applyInArrow(_add_cells, "part int, cells binary").collect()
    out = np.zeros(CELLS, np.uint32)
    for r in rows:
        c = _inflated(r.cells)
        out[r.part * len(c) : (r.part + 1) * len(c)] = c
    return out


def _features(batches, k: int, num: int, den: int, counts):
    """Node and group of each document; the prefix and the parity bits only where the task meets the node first."""
    only_cache("powers")
    seen: set[int] = set()
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for a, b in slices(texts):
            node, size, group, prefix, parity = [], [], [], [], []
            for h in shingles(texts[a:b], k):
                s = np.unique(h)
                size.append(len(s))
                if not len(s):
                    node.append(None), group.append(None), prefix.append(None), parity.append(None)
                    continue
                node.append(node_of(s))
                cells = counts.value[(s & np.uint64(CELLS - 1)).astype(np.int64)]
                first = s[np.lexsort((s, cells))[: prefix_length(len(s), num, den)]]
                bits = np.bincount((mix64(s) >> np.uint64(54)).astype(np.int64), minlength=64 * PARITY) & 1
                group.append(node_of(np.r_[first, np.uint64(len(s))]))
                again = node[-1] in seen
                seen.add(node[-1])
                prefix.append(None if again else signed(first))
                parity.append(None if again else np.packbits(bits.astype(np.uint8)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).slice(a, b - a) for c in ("doc_id", "key")), pa.array(size, pa.int64()), pa.array(node, pa.int64()), pa.array(group, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(parity, pa.list_(pa.int64()))],
                ["doc_id", "key", "n", "node", "grp", "prefix", "parity"],
            )


def _sets(batches, k: int, flags):
    only_cache("powers")
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for a, b in slices(texts):
            node, packed = [], []
            for h in shingles(texts[a:b], k):
                if len(h):
                    s = np.unique(h)
                    x = node_of(s)
                    cell = x % FLAGS
                    if flags.value[cell >> 6] >> (cell & 63) & 1:
                        node.append(x)
                        packed.append(pack_sorted(s))
            yield pa.RecordBatch.from_pydict({"node": pa.array(node, pa.int64()), "hashes": pa.array(packed, pa.binary())})


def _groups(table: pa.Table) -> pa.Table:
    """One row a group, with the number m of its nodes: a node has a row for each task that met it."""
    grp, node = (np.asarray(table.column(c), np.int64) for c in ("grp", "node"))
    _, first = np.unique(grp, return_index=True)
    pair = np.lexsort((node, grp))
    new = np.r_[True, (grp[pair][1:] != grp[pair][:-1]) | (node[pair][1:] != node[pair][:-1])]
    _, m = np.unique(grp[pair][new], return_counts=True)
    return table.take(pa.array(first)).append_column("m", pa.array(m))


def _entries(table: pa.Table, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, row, position) of each prefix shingle, under the size band of its set and under the next one.

    Sets whose sizes can be near enough lie in one band or in neighbouring ones, so they share a key of each common
    shingle; sets of other sizes share none.
    """
    flat = table.column("prefix").combine_chunks()
    values = np.asarray(flat.flatten(), np.int64).view(np.uint64)
    length = np.diff(np.asarray(flat.offsets, np.int64))
    row = np.repeat(np.arange(len(length)), length)
    at = np.arange(len(values)) - np.repeat(np.cumsum(length) - length, length)
    size = np.asarray(table.column("n"), np.float64)
    band = (np.floor(np.log(size) / (np.log(den / num) * 1.0001)) if num < den else size).astype(np.uint64)[row]  # equal sets have one size
    key = np.r_[mix64(values + mix64(band + np.uint64(1))), mix64(values + mix64(band + np.uint64(2)))]
    return key, np.r_[row, row], np.r_[at, at]


def _ask_prefixes(table: pa.Table, ranges: int, num: int, den: int) -> pa.Table:
    """The block's distinct keys, and a bit for those of two of its nodes."""
    table = _groups(table)
    key, row, _ = _entries(table, num, den)
    weight = np.asarray(table.column("m"), np.int64)[row]
    key, at = np.unique(key, return_inverse=True)
    several = np.bincount(at, weights=weight) > 1
    edge = bucket_edges(key, ranges)
    used = [k for k in range(ranges) if edge[k] < edge[k + 1]]
    return _rows([table.column("block")[0].as_py()] * len(used), used, {"hashes": [pack_sorted(key[edge[k] : edge[k + 1]]) for k in used], "extra": [np.packbits(several[edge[k] : edge[k + 1]]).tobytes() for k in used]})


def _shared_prefixes(table: pa.Table, known: pa.Table, num: int, den: int) -> pa.Table:
    """The block's entries under shared keys."""
    if table.num_rows and known.num_rows:
        table = _groups(table)
        key, row, at = _entries(table, num, den)
        hit = _among(key, _joined(known)) >= 0
        key, row, at = signed(key[hit]), row[hit], at[hit]
    else:
        key, row, at = (np.zeros(0, np.int64) for _ in range(3))
    return pa.table({"tok": key, **{c: np.asarray(table.column(c), np.int64)[row] if len(row) else row for c in ("grp", "n", "m")}, "pos": at.astype(np.int32)})


def _verified(batches, num: int, den: int):
    """The pairs whose sets are similar enough."""
    last, known = None, None
    for batch in batches:
        u, v, x, y = (batch.column(c).to_pylist() for c in ("u", "v", "hashes_u", "hashes_v"))
        keep = []
        for i, (p, q) in enumerate(zip(x, y)):
            if u[i] != last:
                last, known = u[i], unpack_sorted(p)
            other = unpack_sorted(q)
            at = np.minimum(np.searchsorted(known, other), len(known) - 1)
            both = int((known[at] == other).sum())
            keep.append(den * both >= num * (len(known) + len(other) - both))
        yield pa.RecordBatch.from_pydict({"u": pa.array([a for a, k in zip(u, keep) if k], pa.int64()), "v": pa.array([b for b, k in zip(v, keep) if k], pa.int64())})


def _near(n1: str, p1: str, n2: str, p2: str, num: int, den: int):
    """Size and position filters of two prefix entries of the same shingle."""
    a, b = F.col(n1), F.col(n2)
    bound = F.least(a - F.col(p1), b - F.col(p2))  # shingles from here on
    return (den * F.least(a, b) >= num * F.greatest(a, b)) & ((num + den) * bound >= num * (a + b))


def row_key(docs: DataFrame) -> Column:
    """A 64-bit hash of doc_id and text: rows of one key are alike."""
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string")).alias("key")


class Join:
    """The steps over the stored features of one table."""

    def __init__(self, docs: DataFrame, k: int, num: int, den: int):
        self.spark: SparkSession = docs.sparkSession
        bounded_batches(self.spark)
        self.k, self.num, self.den = k, num, den
        self.text = docs.select(docs["doc_id"].cast("long").alias("doc_id"), row_key(docs), docs["text"].cast("string").alias("text"))
        counts = self.spark.sparkContext.broadcast(shingle_counts(self.text, k))
        self.features = stored(
            self.text.mapInArrow(lambda it: _features(it, k, num, den, counts), "doc_id long, key long, n long, node long, grp long, prefix array<long>, parity array<long>"), "sets"
        )
        self.members = self.features.where("node is not null").select("node", "grp", "n").distinct()

    def shared(self) -> DataFrame:
        """tok, grp, n, pos and the pivot's p_grp, p_n, p_pos for prefix shingles that two nodes of near size hold.

        The pivot is the group with the fewest rarer shingles before it: the one that others were most likely made from.
        """
        parts, ranges, num, den = shuffle_parts(self.spark), buckets(self.spark), self.num, self.den
        base = self.features.where("prefix is not null").select(F.pmod(F.xxhash64("grp"), F.lit(parts)).cast("int").alias("block"), "grp", "n", "node", "prefix").repartition(parts, "block")
        asked = base.groupBy("block").applyInArrow(lambda t: _ask_prefixes(t, ranges, num, den), "block int, bucket int, hashes binary, extra binary")
        known = asked.groupBy("bucket").applyInArrow(_shared_anchors, "block int, bucket int, hashes binary")
        tokens = base.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(lambda a, b: _shared_prefixes(a, b, num, den), "tok long, grp long, n long, m long, pos int")
        # read twice rather than dealt by tok once: the pivots have partial aggregates, and Spark can split a hot key of the join
        pivot = tokens.groupBy("tok").agg(F.min(F.struct("pos", "grp", "n")).alias("p"))
        return stored(tokens.join(pivot.select("tok", F.col("p.grp").alias("p_grp"), F.col("p.n").alias("p_n"), F.col("p.pos").alias("p_pos")), "tok"), "shared")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """The links among node pairs (u, v)."""
        spark, num, den, k = self.spark, self.num, self.den, self.k
        parity = self.features.where("parity is not null").select("node", "n", "parity").dropDuplicates(["node"])
        side = lambda c: parity.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("parity").alias(f"b_{c}"))
        apart = sum((F.bit_count(F.col("b_u")[i].bitwiseXOR(F.col("b_v")[i])) for i in range(PARITY)), F.lit(0))
        close = pairs.distinct().join(side("u"), "u").join(side("v"), "v").where((num + den) * apart <= (den - num) * (F.col("n_u") + F.col("n_v")))
        close = stored(close.select("u", "v"), "pairs")
        cell = close.select(F.explode(F.array("u", "v")).alias("node")).select(F.pmod("node", F.lit(FLAGS)).alias("cell"))
        word = cell.groupBy(F.expr("cast(cell div 64 as int)").alias("word")).agg(F.expr("bit_or(shiftleft(cast(1 as bigint), cast(cell % 64 as int)))").alias("bits"))
        flags = np.zeros(FLAGS // 64, np.uint64)  # a filter of fixed size; what it lets through for nothing costs no error
        got = word.toPandas()
        flags[got["word"].to_numpy()] = got["bits"].to_numpy(np.int64).view(np.uint64)
        shared = spark.sparkContext.broadcast(flags.tolist())
        sets = self.text.select("text").mapInArrow(lambda it: _sets(it, k, shared), "node long, hashes binary").dropDuplicates(["node"])  # shuffled once for both joins
        # a node with many pairs is copied, so that its pairs are dealt to several tasks
        many = stored(close.groupBy("u").agg(F.ceil(F.count("*") / PAIRS).cast("int").alias("parts")).where("parts > 1"), "many")
        salted = close.join(many, "u", "left").select("u", "v", F.pmod(F.xxhash64("v"), F.coalesce("parts", F.lit(1))).cast("int").alias("salt"))
        copies = sets.select(F.col("node").alias("u"), F.col("hashes").alias("hashes_u")).join(many, "u", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        with_v = salted.join(sets.select(F.col("node").alias("v"), F.col("hashes").alias("hashes_v")), "v")
        both = with_v.join(copies, ["u", "salt"]).select("u", "v", "hashes_u", "hashes_v")
        links = stored(both.mapInArrow(lambda it: _verified(it, num, den), "u long, v long"), "links")
        dropped(close, many)
        return links

    def star_pairs(self, shared: DataFrame) -> DataFrame:
        """Members of each group against the smallest node of its pivots' groups, after the group filters."""
        near = shared.where(_near("n", "pos", "p_n", "p_pos", self.num, self.den) & ((F.col("grp") != F.col("p_grp")) | (F.col("m") > 1)))
        lead = self.members.groupBy("grp").agg(F.min("node").alias("u")).withColumnRenamed("grp", "p_grp")
        return near.select("grp", "p_grp").distinct().join(lead, "p_grp").join(self.members.select("grp", F.col("node").alias("v")), "grp").where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))

    def cross_pairs(self, shared: DataFrame, label: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(All pairs of nodes that share a prefix shingle, pass the filters and lie in different components; the table they come from.)

        The filters see size and position alone, so they are put to classes of entries first: only entries of two
        classes that pass are paired, and a shingle that many sets hold too late to be similar costs its classes.
        """
        node = self.members.join(label, "node", "left").select("grp", "node", F.coalesce("label", "node").alias("comp"))
        held = shared.select("tok", "grp", "n", "pos").join(node, "grp")
        kind = held.groupBy("tok", "comp", "n", "pos").agg(F.count("*").alias("k"))
        per = kind.groupBy("tok", "comp").agg(F.sum("k").alias("k")).groupBy("tok").agg(F.count("*").alias("comps"), F.max(F.struct("k", "comp")).alias("most")).where("comps > 1")
        held = stored(held.join(per.select("tok", F.col("most.comp").alias("most")), "tok").select("tok", "node", "n", "pos", "comp", "most"), "held")
        other = lambda df, *names: df.select("tok", *(F.col(c).alias(f"{c}_a") for c in names))
        every = held.groupBy("tok", "n", "pos").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
        small = held.where("comp <> most").groupBy("tok", "n", "pos").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
        apart = ~((F.col("low") == F.col("high")) & (F.col("low_a") == F.col("high_a")) & (F.col("low") == F.col("low_a")))
        near = other(small, "n", "pos", "low", "high").join(every, "tok").where(_near("n_a", "pos_a", "n", "pos", self.num, self.den) & apart)
        near = near.select("tok", "n_a", "pos_a", "n", "pos")
        lone = other(held.where("comp <> most"), "node", "n", "pos", "comp").join(near, ["tok", "n_a", "pos_a"])
        pair = lone.join(held, ["tok", "n", "pos"]).where((F.col("comp_a") != F.col("comp")) & ((F.col("comp") == F.col("most")) | (F.col("node_a") < F.col("node"))))
        return pair.select(F.least("node_a", "node").alias("u"), F.greatest("node_a", "node").alias("v")), held

    def labels(self) -> DataFrame:
        """node, label of every node with a link."""
        reclaim(self.spark)
        shared = self.shared()
        reclaim(self.spark)
        links = self.verify(self.star_pairs(shared))
        label = components(links)
        reclaim(self.spark)
        pairs, held = self.cross_pairs(shared, label)
        more = self.verify(pairs)
        dropped(shared, held)
        if more.isEmpty():
            return label
        return components(links.union(more))


#: Keys that a component's answer is copied to, so that a component with a third of all nodes is dealt to as many tasks.
SALTS = 32


def _components(join: Join) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, n, node of every row; node and first of every node with a set).

    first is (no doc_id, doc_id, key) of the component's first row, by that order.
    """
    held = join.features.select("doc_id", "key", "n", "node")
    own = held.where("node is not null").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "key")).alias("own"))
    node = stored(own.join(join.labels(), "node", "left"), "nodes")  # as many rows as distinct sets
    linked = node.where("label is not null")
    first = linked.groupBy("label").agg(F.min("own").alias("first")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    answered = linked.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(first, ["label", "salt"]).select("node", "first")
    return held, node.where("label is null").select("node", F.col("own").alias("first")).union(answered)


def jaccard_components(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links of similarity num / den or more)."""
    held, node = _components(Join(docs, k, num, den))
    least = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    return held.join(node, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), least.alias("component_id"))


def without_near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the row of smallest doc_id stays, whole.

    The choice is by row: rows of one doc_id with different texts are rows of their own, equal ids are told apart by a
    hash of the text, a null doc_id comes last, and of rows with equal doc_id and text one stays. Rows without words are
    linked with nothing and all stay. Columns pass through whatever their names.
    """
    held, node = _components(Join(docs, k, num, den))
    doc = F.coalesce(F.col("doc_id"), F.lit(0)).alias("doc")
    per = held.where("node is not null").groupBy("node", "key", doc).agg(F.count("*").alias("rows")).join(node, "node")
    per = stored(per.select("key", "doc", (F.col("key") == F.col("first.key")).alias("stays"), "rows"), "choice")
    rows = docs.select(F.struct("*").alias("row"), row_key(docs), F.coalesce(docs["doc_id"].cast("long"), F.lit(0)).alias("doc"))
    gone = per.where("not stays or rows > 1").select("key", "doc")
    again = per.where("stays and rows > 1").select("key", "doc")
    clear, maybe = split_by(rows, gone, ("key", "doc"))  # what is in again is in gone; neither has a bound, so neither is broadcast
    single = maybe.join(again.hint("merge"), ["key", "doc"], "left_semi").groupBy("key", "doc").agg(F.first("row").alias("row"))
    return clear.select("row.*").union(maybe.join(gone.hint("merge"), ["key", "doc"], "left_anti").select("row.*")).union(single.select("row.*"))
