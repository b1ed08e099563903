"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are partitioned by size: by shingle length (items shorter than a shingle are one shingle of all their words) and
by the power of two that bounds their number of distinct shingles. A partition's sketch keeps the k smallest hashes of
each item, k being one more than the shingles that an item of the partition's largest size may lack. A document that
contains enough of an item therefore holds at least one hash of its sketch: the search misses nothing, and longer items
don't make short ones' sketches longer.

Sketches are a table. A document's shingle hashes that pass a bit filter of all sketch hashes are joined with it; the filter is all that
is broadcast, ``filter_bits`` bits at most. A larger benchmark makes it let more hashes through, which the join then drops, so nothing
is lost and nothing goes through the driver but the filter's words. Candidates are verified on the shingles themselves: a
document meets ``chunk`` of its candidates' texts at a time.

Documents are read twice, each as a whole, however long. A hash, item or document with a large share of the candidates is
a skewed key of a plain join.

Defined cases: null or empty texts (documents or items) hold no shingle and match nothing. Repeated documents give a
row each; repeated items too. Null ids come back as they are. Documents of one id and text are told apart by nothing and all go.
Other columns, whatever their names, come back from clean() as they were. Empty tables give an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, row_key, small_batches, store

SHINGLE, SIMILARITY = 5, 0.8
LEAKS = "doc_id long, item_id long, item_shingles long, found_shingles long, containment double"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_known: dict[bytes, int] = {}


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased."""
    return (text or b"").lower().split()


def _word_hashes(words: list[bytes]) -> np.ndarray:
    """A hash of each word, the same in all processes; remembers short ones, up to a fixed number."""
    if len(_known) > 300_000:
        _known.clear()
    found = list(map(_known.get, words))
    if None in found:
        from xxhash import xxh3_64_intdigest as digest

        for i, x in enumerate(found):
            if x is None:
                found[i] = digest(words[i])
                if len(words[i]) < 40:
                    _known[words[i]] = found[i]
    return np.fromiter(found, np.uint64, len(found))


def _hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all shingles of words with the hashes h."""
    n = len(h) - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = h[:n].copy()
    with np.errstate(over="ignore"):
        for i in range(1, size):
            out = (out ^ (out >> np.uint64(31))) * _MIX + h[i : i + n]
    return out ^ (out >> np.uint64(32))


def _shingles(words: list[bytes], size: int) -> dict[bytes, None]:
    """The distinct shingles, in order."""
    return dict.fromkeys(b" ".join(words[a : a + size]) for a in range(len(words) - size + 1))


def _need(shingles: int, similarity: float) -> int:
    return int(np.ceil(similarity * shingles - 1e-9))


def sketches(items: DataFrame, similarity: float, size: int) -> DataFrame:
    """(k, h, item): the sketch of each item's text. items: (item, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, int, int]] = []
            for item, text in zip(b.column("item").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = words_of(text)
                if not words:
                    continue
                k = min(size, len(words))
                distinct = np.unique(_hashes(_word_hashes(words), k))
                largest = 1 << (len(distinct) - 1).bit_length()
                out += [(k, h, item) for h in distinct[: largest - _need(largest, similarity) + 1].view(np.int64).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], kind) for j, kind in enumerate((pa.int32(), pa.int64(), pa.int64()))], ["k", "h", "item"])

    return items.select("item", "text").mapInArrow(rows, "k int, h long, item long")


def bit_filter(sketch: DataFrame, filter_bits: int) -> tuple[np.ndarray, list[int]]:
    """Words of a filter with two bits for each hash, sixty-four bits a hash but 2 ** ``filter_bits`` at most; the shingle lengths there are."""
    n, lengths = sketch.agg(F.count("*"), F.collect_set("k")).first()
    bits = max(6, min(filter_bits, (64 * max(1, n) - 1).bit_length()))
    at = F.explode(F.array(*[F.shiftrightunsigned("h", s).bitwiseAND((1 << bits) - 1) for s in (0, 32)])).alias("at")
    # bounded: a number for each word of the filter
    words = sketch.select(at).select(F.shiftrightunsigned("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 AS int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out.view(np.uint64), sorted(lengths)


def _passing(h: np.ndarray, words: np.ndarray) -> np.ndarray:
    mask = np.uint64(64 * len(words) - 1)
    ok = np.ones(len(h), bool)
    for shift in (0, 32):
        at = (h >> np.uint64(shift)) & mask
        ok &= (words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return h[ok]


def candidates(keyed: DataFrame, items: DataFrame, similarity: float, size: int, filter_bits: int) -> DataFrame:
    """(did, th, item): documents that hold a hash of an item's sketch."""
    spark = keyed.sparkSession
    sketch, _ = store(sketches(items, similarity, size), "sketches")
    words, lengths = bit_filter(sketch, filter_bits)
    shared = spark.sparkContext.broadcast(words)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in batches:
            at, ks, hs = [], [], []
            for i, text in enumerate(b.column("text")):
                own = _word_hashes(words_of(text.as_py()))
                for k in lengths:
                    found = np.unique(_passing(_hashes(own, k), bits))
                    at += [i] * len(found)
                    ks += [k] * len(found)
                    hs.append(found)
            h = np.concatenate(hs) if hs else np.empty(0, np.uint64)
            did, th = (b.column(c).to_numpy(zero_copy_only=False)[np.array(at, np.int64)] for c in ("did", "th"))
            yield pa.RecordBatch.from_arrays([pa.array(did, pa.int64()), pa.array(th, pa.int64()), pa.array(ks, pa.int32()), pa.array(h.view(np.int64))], ["did", "th", "k", "h"])

    hits, _ = store(keyed.select("did", "th", "text").mapInArrow(rows, "did long, th long, k int, h long"), "sketch-hits")
    return hits.join(sketch, ["k", "h"]).select("did", "th", "item").distinct()


def search(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE, filter_bits: int = 26, chunk: int = 64) -> DataFrame:
    """A row of LEAKS for each document and item of which it contains at least ``similarity``."""
    spark = docs.sparkSession
    small_batches(spark)
    did, th = row_key()
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), did.alias("did"), th.alias("th"), text.alias("text"))
    named, _ = store(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64("text").alias("item"), text.alias("text")), "items")
    items = named.groupBy("item").agg(F.min("text").alias("text"))
    near = candidates(keyed, items, similarity, size, filter_bits)
    nth = F.row_number().over(Window.partitionBy("did", "th").orderBy("item"))
    lists = near.withColumn("nth", F.floor((nth - 1) / chunk)).join(items.withColumnRenamed("text", "said"), "item").groupBy("did", "th", "nth").agg(F.collect_list(F.struct("item", "said")).alias("near"))
    lists, _ = store(lists, "candidates")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc_id, text, near_ in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("near").to_pylist(), strict=True):
                words = words_of(text.as_py())
                own: dict[int, set[bytes]] = defaultdict(set)
                for item in near_:
                    theirs = words_of(item["said"])
                    k = min(size, len(theirs))
                    if k not in own:
                        own[k] = set(_shingles(words, k))
                    distinct = _shingles(theirs, k)
                    n = len(own[k] & distinct.keys())
                    if n >= _need(len(distinct), similarity):
                        out.append((doc_id, item["item"], len(distinct), n, n / len(distinct)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], kind) for j, kind in enumerate(kinds)], [c.split()[0] for c in found.split(", ")])

    found = LEAKS.replace("item_id", "item")
    verified = keyed.join(lists, ["did", "th"]).select("doc_id", "text", "near").mapInArrow(rows, found)
    return verified.join(named.select("item_id", "item"), "item").select(*[c.split()[0] for c in LEAKS.split(", ")])


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents that contain no item, with all their columns."""
    key = free_names(docs.columns, "_sl_did", "_sl_th")
    own = docs.withColumns(dict(zip(key, row_key(), strict=True)))
    bare = own.select(F.xxhash64(*key).alias("doc_id"), "text")  # what names a row's content stands for its id
    leaks = search(bare, benchmark, **how).select("doc_id").distinct()
    (mark,) = free_names(own.columns, "_sl_mark")
    return own.withColumn(mark, F.xxhash64(*key)).join(leaks.toDF(mark), mark, "left_anti").select(*docs.columns)
