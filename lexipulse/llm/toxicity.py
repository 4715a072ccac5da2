"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the presence of lower-cased words, word pairs and pairs with one word between, hashed to ``2**bits``
places. Training sees a bounded sample: of the labelled training documents those ``most`` of smallest (hash of doc_id,
doc_id), of each the first ``places`` features in the order of their hashes, ``passes`` times in that order. Scores are
calibrated (Platt) by ``folds``-fold cross-validation on these rows: each fold's margins come from a model that never
saw it. Per-coordinate
learning rates and the L1 term leave few non-zero weights, which alone are broadcast (at most ``2**bits`` by
construction, some thousands in practice). Scoring covers all documents without a shuffle; labels, lang, source and
doc_id are no inputs of a score.

A null or empty text has no features: its score is that of the bias. A null doc_id counts as not held out. Documents
labelled more than once train with the largest label, null labels with none; of rows of one doc_id one trains, that with
the text of smallest hash, and each is scored by its own text; labels without a document do not count towards
``most``; without any label every score is 0.5.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .bpe import slices
from .workspace import CACHES, WordHashes, bounded_batches, mix64, only_cache

_WORD = re.compile(r"\w+")
_K = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


class TextHashes(WordHashes):
    def __missing__(self, word: str) -> int:
        v = self[word] = xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return v


_HASHES = TextHashes()
CACHES["toxicity"] = _HASHES.clear


def features(texts: list[str | None], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, place) of each occurrence of a feature, in any order."""
    words = [_WORD.findall(t.lower()) if t else [] for t in texts]
    n = np.fromiter(map(len, words), np.int64, len(words))
    only_cache("toxicity")
    _HASHES.trim()
    h = _HASHES.of([w for ws in words for w in ws])
    doc = np.repeat(np.arange(len(words)), n)
    shift = np.uint64(64 - bits)
    docs, places = [doc], [mix64(h) >> shift]
    for gap in (1, 2):
        same = doc[gap:] == doc[:-gap] if len(doc) > gap else np.zeros(0, bool)
        pair = h[:-gap][same] * _K[gap - 1] + (h[gap:][same] ^ _K[2]) * _K[gap] if len(same) else np.zeros(0, np.uint64)
        docs.append(doc[:-gap][same] if len(same) else np.zeros(0, np.int64))
        places.append(mix64(pair) >> shift)
    return np.concatenate(docs), np.concatenate(places).astype(np.int64)


class Ftrl:
    """FTRL-proximal for binary features; place 0 of ``bias`` is the intercept, which has no L1 term."""

    def __init__(self, size: int, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = np.zeros(size, np.float64), np.zeros(size, np.float64)
        self.bias_z = self.bias_n = 0.0
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    @property
    def bias(self) -> float:
        return -self.bias_z / ((self.beta + self.bias_n**0.5) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, label: float) -> None:
        w, b = self.weights(at), self.bias
        g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g
        self.bias_z += g - ((self.bias_n + g * g) ** 0.5 - self.bias_n**0.5) / self.alpha * b
        self.bias_n += g * g


def platt(margin: np.ndarray, positive: np.ndarray, least: int = 20) -> tuple[float, float]:
    """(scale, shift) of the margins for which they are log odds, by Newton steps with smoothed targets; (1, 0) for few rows."""
    n = int(positive.sum())
    if min(n, len(positive) - n) < least:
        return 1.0, 0.0
    target = np.where(positive, (n + 1) / (n + 2), 1 / (len(positive) - n + 2))
    x, w = np.stack([margin, np.ones(len(margin))], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), x.T @ (p - target) + 1e-3 * (w - [1.0, 0.0]))
        w = w - np.clip(step, -1, 1)
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def fitted(rows: list[tuple[float, np.ndarray]], bits: int, passes: int, alpha: float, beta: float, l1: float, l2: float) -> Ftrl:
    """The model of (label, places) rows, learned ``passes`` times in their order."""
    model = Ftrl(1 << bits, alpha, beta, l1, l2)
    for _ in range(passes):
        for label, at in rows:
            model.learn(at, label)
    return model


def _places(batches, bits: int, most: int):
    """The distinct places of each text's features: the ``most`` first by hash, in rising order."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for a, b in slices(texts):
            doc, place = features(texts[a:b], bits)
            pair = np.unique(doc << bits | place)
            own = np.split((pair & (1 << bits) - 1).astype(np.int32), np.searchsorted(pair, np.arange(1, b - a) << bits))
            own = [p if len(p) <= most else np.sort(p[np.argsort(mix64(p.astype(np.uint64)))[:most]]) for p in own]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in ("place", "doc_id", "label")), pa.array(own, pa.list_(pa.int32()))], ["place", "doc_id", "label", "features"])


def _train(batches, bits: int, folds: int, *parameters):
    """Model 0 learns all rows and gives its weights; model k the rows outside fold k, and gives the margins of those inside."""
    held: dict[int, list] = {}
    for batch in batches:
        model, label = (batch.column(c).to_pylist() for c in ("model", "label"))
        order = zip(batch.column("place").to_pylist(), batch.column("doc_id").to_pylist())
        column = batch.column("features")
        own = np.split(np.asarray(column.flatten(), np.int32), np.asarray(column.offsets, np.int64)[1:-1] - column.offsets[0].as_py())
        for k, *row in zip(model, order, label, own):
            held.setdefault(k, []).append(row)
    for k, rows in held.items():
        rows.sort(key=lambda r: r[0])
        learned = [(float(label > 0), at) for _, label, at in rows]
        model = fitted([r for i, r in enumerate(learned) if not k or i % folds != k - 1], bits, *parameters)
        at, margin = np.zeros(0, np.int64), []
        if k:
            margin = [(model.weights(at_).sum() + model.bias, label) for label, at_ in learned[k - 1 :: folds]]
        else:
            at = np.flatnonzero(model.weights(np.arange(1 << bits)))
        yield pa.RecordBatch.from_pydict({
            "model": pa.array([k], pa.int32()), "at": pa.array([at], pa.list_(pa.int64())), "weight": pa.array([model.weights(at)], pa.list_(pa.float64())), "bias": [model.bias],
            "margin": pa.array([[float(m) for m, _ in margin]], pa.list_(pa.float64())), "positive": pa.array([[label > 0 for _, label in margin]], pa.list_(pa.bool_())),
        })


def train(
    docs: DataFrame, labels: DataFrame, bits: int = 22, most: int = 20_000, places: int = 5_000, passes: int = 4, folds: int = 3, alpha: float = 1.5, beta: float = 1.0, l1: float = 2.0, l2: float = 0.1
) -> tuple[np.ndarray, np.ndarray, float]:
    """(places, weights, bias) from ``labels`` (doc_id, label): at most ``most`` documents of at most ``places`` features."""
    place = F.struct(F.xxhash64("doc_id").alias("hash"), "doc_id")
    known = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    # ``most`` rows of two numbers, a fixed bound; only their texts are looked at, and of each id one is kept
    sample = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(place).limit(most)
    text = docs.select("doc_id", docs["text"].cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    one = text.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).withColumn("place", F.xxhash64("doc_id"))
    found = one.mapInArrow(lambda it: _places(it, bits, places), "place long, doc_id long, label int, features array<int>")
    models = found.withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(folds)))).repartitionById(folds + 1, F.col("model"))
    schema = "model int, at array<long>, weight array<double>, bias double, margin array<double>, positive array<boolean>"
    rows = models.mapInArrow(lambda it: _train(it, bits, folds, passes, alpha, beta, l1, l2), schema).collect()  # a row a model
    full = [r for r in rows if r.model == 0]
    if not full:  # no labelled document
        return np.zeros(0, np.int64), np.zeros(0), 0.0
    scale, shift = platt(np.array([x for r in rows for x in r.margin]), np.array([x for r in rows for x in r.positive], bool))
    return np.array(full[0].at, np.int64), np.array(full[0].weight) * scale, float(full[0].bias) * scale + shift


def _score(batches, model, bits: int):
    at, weight, bias = model.value
    dense = np.zeros(1 << bits)
    dense[at] = weight
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for a, b in slices(texts):
            doc, place = features(texts[a:b], bits)
            hit = dense[place] != 0
            pair = np.unique(doc[hit] << bits | place[hit])
            total = bias + np.bincount(pair >> bits, weights=dense[pair & (1 << bits) - 1], minlength=b - a)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in ("doc_id", "held_out")), pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], ["doc_id", "held_out", "score"])


def toxicity(docs: DataFrame, labels: DataFrame, bits: int = 22, threshold: float = 0.7, **training) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; trains on rows that are not held out."""
    spark = docs.sparkSession
    bounded_batches(spark)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = spark.sparkContext.broadcast(train(docs, labels.where(~held).select("doc_id", F.col("toxic").alias("label")), bits, **training))
    scored = docs.select("doc_id", held.alias("held_out"), docs["text"].cast("string").alias("text")).mapInArrow(lambda it: _score(it, model, bits), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
