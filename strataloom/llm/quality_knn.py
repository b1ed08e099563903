"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

A text becomes two blocks of numbers: its terms, hashed into ``TERMS`` slots and weighted by log frequency and by how few documents of the
sample hold them; and its form (pairs of character classes, word lengths, size, repetition). Both are projected together on the leading
singular directions of a sample of labelled documents. The sample's vectors and labels are broadcast (``max_train`` vectors of
``dims`` numbers, a fixed size); each batch of documents is compared with all of them by blocked matrix products, exactly, and its
nearest neighbours vote with weights that grow with cosine similarity.

Documents are read twice (vectors of the sample, scores) and never shuffled; the sample, at most ``max_train`` labelled documents chosen
by a hash of their id, is the only thing that is bounded. A worker holds one Arrow batch. The model is the same however the
documents are partitioned.

Defined cases: null or empty text: scored like any other, by neighbours of next to no length. Very long texts are read whole. Null
doc_id: not held out, and never in the sample. Without any label, or any document that has one, all scores are 0.5. Repeated rows
give repeated results; repeated labels of a document count by their largest value. Of neighbours at one distance, those first in the
order of their vectors vote. Other columns, whatever their names, are left out. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

SCORES = "doc_id long, score double"
_GROUPS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c", "\n", ".", ",", "!", "?", ";:", "'\"`", "()[]{}", "*", "$", "%", "#", "&", "|", "<>", "-_=+~", "/\\@^"]
_KINDS = len(_GROUPS) + 2  # and other ASCII, and all beyond
_KIND = np.full(256, _KINDS - 2, np.int64)
for _i, _g in enumerate(_GROUPS):
    _KIND[[ord(c) for c in _g]] = _i
_KIND[128:] = _KINDS - 1
_LENGTHS, _SIZES, _RATIOS = 24, 24, 3
#: Slots that terms are hashed into, and what their block weighs beside the form's.
TERMS, TERM_WEIGHT = 2048, 8.0
_slots: dict[bytes, int] = {}


def _slot(words: list[bytes]) -> np.ndarray:
    """Each word's slot; remembers short ones, up to a fixed number."""
    if len(_slots) > 300_000:
        _slots.clear()
    found = list(map(_slots.get, words))
    if None in found:
        for i, x in enumerate(found):
            if x is None:
                found[i] = zlib.crc32(words[i]) % TERMS
                if len(words[i]) < 40:
                    _slots[words[i]] = found[i]
    return np.fromiter(found, np.int64, len(found))


def features(text: bytes | None) -> np.ndarray:
    """Log counts of the hashed terms, then the form: class pairs, word lengths, ten-part shares of repetition, size of the text."""
    text = text or b""
    kinds = _KIND[np.frombuffer(text, np.uint8)]
    pairs = np.bincount(kinds[:-1] * _KINDS + kinds[1:], minlength=_KINDS * _KINDS) if len(kinds) > 1 else np.zeros(_KINDS * _KINDS)
    words = text.split()
    n = len(words)
    terms = np.bincount(_slot(words), minlength=TERMS)
    lengths = np.bincount(np.minimum(np.fromiter(map(len, words), np.int64, n), _LENGTHS - 1), minlength=_LENGTHS)
    size = np.zeros(_SIZES)
    size[min(_SIZES - 1, len(text).bit_length())] = 1
    distinct = len(set(words)) / n if n else 1.0
    same = sum(map(bytes.__eq__, words[1:], words)) / (n - 1) if n > 1 else 0.0
    lines = text.split(b"\n")
    again = 1 - len(set(lines)) / len(lines)
    ratios = np.zeros((_RATIOS, 11))
    for k, v in enumerate((distinct, same, again)):
        ratios[k, int(10 * v)] = 1
    form = [pairs / max(1, len(text)), lengths / max(1, n)]
    return np.concatenate([np.log1p(terms), *(np.log1p(200 * c) for c in form), 2 * ratios.ravel(), 0.5 * size]).astype(np.float16)


def leading_directions(x: np.ndarray, dims: int, rounds: int = 8, spare: int = 16) -> np.ndarray:
    """The first right singular vectors of x, as columns, by subspace iteration from a fixed start."""
    q = np.random.default_rng(7).standard_normal((x.shape[1], min(dims + spare, x.shape[1]))).astype(x.dtype)
    for _ in range(rounds):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    y = x @ q
    _, _, turn = np.linalg.svd(y.T @ y)
    return (q @ turn.T)[:, :dims]


def nearest(cos: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of each row's k largest; of those that tie for the last places, the first columns."""
    n = cos.shape[1]
    k = min(k, n)
    least = np.partition(cos, n - k, axis=1)[:, n - k, None]
    above, tied = cos > least, cos == least
    taken = above | (tied & (np.cumsum(tied, axis=1) <= k - above.sum(axis=1, keepdims=True)))
    near = np.nonzero(taken)[1].reshape(len(cos), k)
    return near, np.take_along_axis(cos, near, axis=1)


class Model:
    """Term weights, projection, labelled vectors and how they vote."""

    def __init__(self, x: np.ndarray, y: np.ndarray, dims: int, neighbours: int, power: float) -> None:
        self.neighbours, self.power = neighbours, power
        self.rarity = np.log((1 + len(x)) / (1 + (x[:, :TERMS] > 0).sum(axis=0))).astype(np.float32)
        weighed = self.weigh(x)
        self.mean = weighed.mean(axis=0, dtype=np.float64).astype(np.float32)
        self.axes = leading_directions(weighed - self.mean, dims)
        self.vectors, self.labels = self.project(weighed), y.astype(np.float32)
        self.prior = float((y.sum() + 1) / (len(y) + 2))

    def weigh(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float32)
        terms = x[:, :TERMS] * self.rarity
        x[:, :TERMS] = TERM_WEIGHT * terms / np.maximum(np.linalg.norm(terms, axis=1, keepdims=True), 1e-9)
        return x

    def project(self, weighed: np.ndarray) -> np.ndarray:
        v = (weighed - self.mean) @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def score(self, texts: list[bytes | None], block: int = 256) -> np.ndarray:
        out = []
        for at in range(0, len(texts), block):
            v = self.project(self.weigh(np.stack([features(t) for t in texts[at : at + block]])))
            near, cos = nearest((v @ self.vectors.T).round(6), self.neighbours)  # so that equal vectors tie wherever they stand
            w = np.maximum(cos, 0) ** self.power
            out.append(((w * self.labels[near]).sum(axis=1) + 0.1 * self.prior) / (w.sum(axis=1) + 0.1))
        return np.concatenate(out) if out else np.empty(0)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether a row is kept out of all learning."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, part: int, max_train: int) -> DataFrame:
    """(text as bytes, y) of at most ``max_train`` labelled documents that aren't held out, chosen by a hash of their id."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"), parts, part)).groupBy("doc_id").agg(F.max(label).alias("y"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "y")  # bounded by max_train


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 3, part: int = 1, max_train: int = 4000, dims: int = 64, neighbours: int = 15, power: float = 8.0) -> Model | None:
    """The model of a bounded sample of labelled documents; None without any."""
    small_batches(docs.sparkSession)
    rows = sample(docs, labels, label, parts, part, max_train)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = [features(t).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary()), b.column("y").cast(pa.int32())], ["v", "y"])

    got = rows.mapInArrow(vectors, "v binary, y int").collect()  # max_train vectors of one size
    if not got:
        return None
    got.sort(key=lambda r: (bytes(r.v), r.y))
    x = np.stack([np.frombuffer(r.v, np.float16) for r in got])
    return Model(x, np.array([r.y for r in got]), dims, neighbours, power)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score) for each document."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = b.column("text").to_pylist()
            s = np.full(len(texts), 0.5) if m is None else np.clip(m.score(texts), 0, 1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(s, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(rows, SCORES)
