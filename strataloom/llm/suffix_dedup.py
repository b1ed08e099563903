"""Suffix-array dedup: remove every byte covered by a string of ``length`` bytes that starts elsewhere too.

Sorting every suffix would move many times the input. Instead each window of ``length`` bytes has an anchor, its leftmost
64-byte gram of least hash; equal windows have theirs at the same place, so only suffixes at anchors matter: about one in
sixty. Anchors whose gram occurs once are dropped. The others are classed by their whole context, the bytes that any
window with that anchor could cover; of a class, two places at most go on, so a passage that many documents share is two rows.

These suffixes are sorted, distributed: tasks cut them from the texts and exchange them as sorted, front-coded runs (the shared
prefix's length and the rest), and receivers merge the runs with a loser tree that carries common-prefix lengths, so no known
prefix is compared again. In the merged order suffixes of one gram are neighbours, and the common prefixes tell how much of each
window two contexts share from the anchor on; what stands before the anchor is compared by hashes and then byte by byte. As all windows of an anchor overlap in its gram, what they cover is one span around it.

A gram with very many classes (where a passage in a large share of all documents begins or ends) isn't gathered in one task: its
window columns are parted until no task has more than ``crowd``: at the ends of what all its contexts share, by their common prefixes.
The windows of fewer columns have more bytes in common, their core: contexts that differ there part ways, those that differ
only beyond the columns' reach fall together. They go through the same merge, behind their columns.

Defined cases: null or empty text: no bytes, nothing removed. Texts under ``length`` bytes lose nothing; very long ones are taken whole. Null
ids and repeated rows: each row counts as a place of its own, and rows of the same id and text have the same result. Nothing hangs on
the order of ties. Other columns, whatever their names, are left out. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from os.path import commonprefix

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, row_key, small_batches, store
from .repeats import anchors

LENGTH, GRAM = 200, 64
ANCHORS = "did long, th long, pos int, l int, r int, kh long, ch long"


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, did, th, text) with text as bytes; (did, th) names a row's content."""
    did, th = row_key()
    return docs.select("doc_id", did.alias("did"), th.alias("th"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of a binary column, and each value's start and end."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(column) or at[0] == at[-1]:
        return np.empty(0, np.uint8), at[:-1] - at[:1], at[1:] - at[:1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at[:-1] - at[0], at[1:] - at[0]


def _batch(arrays: list, schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(a, kinds[k]) for a, (_, k) in zip(arrays, fields, strict=True)], [n for n, _ in fields])


def anchor_table(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """A row of ANCHORS for each anchor: its place, how far its context goes left and right, and the hashes of gram and context."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest as digest

        for b in batches:
            data, starts, ends = _bytes(b.column("text"))
            at, no = anchors(data, starts, ends, length, gram)
            left, right = np.minimum(at - starts[no], length - gram), np.minimum(ends[no] - at, length)
            raw = data.tobytes()
            kh = np.fromiter((digest(raw[a : a + gram]) for a in at.tolist()), np.uint64, len(at))
            ch = np.fromiter((digest(raw[a - x : a + y], x) for a, x, y in zip(at.tolist(), left.tolist(), right.tolist(), strict=True)), np.uint64, len(at))
            did, th = (b.column(k).to_numpy(zero_copy_only=False)[no] for k in ("did", "th"))
            yield _batch([did, th, (at - starts[no]), left, right, kh.view(np.int64), ch.view(np.int64)], ANCHORS)

    return keyed.select("did", "th", "text").mapInArrow(rows, ANCHORS)


RUNS = "bucket int, run long, nth int, shared int, rest binary, before binary, core long, sub long"
_BUCKET, _SUFFIX, _BEFORE, _CORE, _SUB = range(5)


def common_prefixes(suffixes: list[bytes]) -> list[int]:
    """Length of the prefix that each of the sorted strings shares with the one before."""
    out = [0] if suffixes else []
    for a, b in zip(suffixes, suffixes[1:], strict=False):
        out.append(shared_from(a, b, 0))
    return out


def shared_from(a: bytes, b: bytes, p: int) -> int:
    """Length of the common prefix of a and b, of which p bytes are known to agree."""
    n = min(len(a), len(b))
    step = 64
    while step:
        while p + step <= n and a[p : p + step] == b[p : p + step]:
            p += step
        step //= 4 if step > 1 else 2
    return p


class LoserTree:
    """Merges sorted runs of (shared, rest, payload), front-coded, into (shared with the one before, suffix, payload)."""

    def __init__(self, runs: list[Iterator[tuple[int, bytes, object]]]) -> None:
        self.runs = runs
        self.k = len(runs)
        self.now: list[bytes | None] = [b""] * self.k
        self.load: list[object] = [None] * self.k
        self.lcp = [0] * self.k
        self.losers = [-1] * max(1, self.k)
        for i in range(self.k):
            self._next(i)
        self.winner = self._build(1) if self.k > 1 else 0

    def _next(self, i: int) -> None:
        try:
            shared, rest, self.load[i] = next(self.runs[i])
            self.now[i] = self.now[i][:shared] + rest
            self.lcp[i] = shared
        except StopIteration:
            self.now[i] = None

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, self.losers[node] = self._play(a, b)
        return win

    def _play(self, i: int, j: int) -> tuple[int, int]:
        """(winner, loser). Both know what they share with the last one out: who shares more is smaller; else only the bytes beyond count."""
        a, b = self.now[i], self.now[j]
        if b is None:
            return i, j
        if a is None:
            return j, i
        x, y = self.lcp[i], self.lcp[j]
        if x != y:
            return (i, j) if x > y else (j, i)
        p = shared_from(a, b, x)
        win, lose = (i, j) if a[p : p + 1] < b[p : p + 1] or (len(a) == p and i < j) else (j, i)
        self.lcp[lose] = p
        return win, lose

    def __iter__(self) -> Iterator[tuple[int, bytes, object]]:
        while self.k and self.now[self.winner] is not None:
            w = self.winner
            yield self.lcp[w], self.now[w], self.load[w]
            self._next(w)
            node = (w + self.k) // 2
            while node:
                w, self.losers[node] = self._play(w, self.losers[node])
                node //= 2
            self.winner = w


SPANS = "core long, sub long, l int, r int"


def shared_windows(before: np.ndarray, shared: np.ndarray, lo: np.ndarray, left: np.ndarray, right: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, left, right) of the contexts with windows that another one has too, and what those windows cover.

    Contexts come in the order of their suffixes, which begin ``lo`` bytes before the anchor. ``shared`` is how many bytes a suffix has in common with the one
    before, ``before`` (n, length - gram) what stands in front of the suffixes, ``left`` and ``right`` how far the contexts reach to either side of the anchor.
    A window that begins ``a`` bytes before the anchor holds length - a + lo bytes of the suffix, of which the order tells who has them too; the
    a - lo bytes in front are compared, by their hashes and then byte by byte.
    """
    n, reach = before.shape
    powers = np.cumprod(np.full(reach, 0x9E3779B97F4A7C15, np.uint64))
    hashes = np.zeros((n, reach + 1), np.uint64)
    np.cumsum((before[:, ::-1].astype(np.uint64) + np.uint64(1)) * powers, axis=1, out=hashes[:, 1:])
    at, least, most = np.arange(reach), np.full(n, -1), np.full(n, -1)
    for a in range(reach + 1):
        front = a - lo
        group = np.cumsum(shared < length - front)
        rows = np.flatnonzero((front >= 0) & (a <= left) & (length - a <= right))
        if len(rows) < 2:
            continue
        key = hashes[rows, front[rows]] + group[rows].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        order = np.argsort(key, kind="stable")
        key, rows = key[order], rows[order]
        same = key[1:] == key[:-1]
        p, q = rows[:-1][same], rows[1:][same]
        if not len(p):
            continue
        equal = (group[p] == group[q]) & ((before[p] == before[q]) | (at < reach - front[p][:, None])).all(axis=1)
        if not equal.all():  # hashes that collide: decided by the bytes alone
            whole = [(int(group[r]), before[r, reach - front[r] :].tobytes()) for r in rows]
            often = Counter(whole)
            twice = rows[[often[w] > 1 for w in whole]]
        else:
            twice = np.union1d(p, q)
        least[twice] = np.where(least[twice] < 0, a, least[twice])
        most[twice] = a
    hit = np.flatnonzero(most >= 0)
    return hit, most[hit], length - least[hit]


def _tagged(lo: int, hi: int, suffix: bytes) -> bytes:
    """A suffix behind its columns, so that only suffixes for the same columns are neighbours."""
    return bytes((lo, hi)) + suffix


class _RunWriter:
    """Gathers suffixes and gives them out as sorted, front-coded runs of about ``run_bytes``."""

    def __init__(self, run_bytes: int) -> None:
        from pyspark import TaskContext

        self.run_bytes, self.run = run_bytes, (TaskContext.get().partitionId() + 1) << 24
        self.held: list[tuple[int, bytes, bytes, int, int]] = []
        self.size = 0

    def add(self, *row: object) -> None:
        self.held.append(row)
        self.size += 64 + len(row[_SUFFIX]) + len(row[_BEFORE])

    def full(self) -> bool:
        return self.size > self.run_bytes

    def flush(self) -> pa.RecordBatch:
        held = sorted(self.held, key=lambda x: (x[_BUCKET], x[_SUFFIX]))
        shared = common_prefixes([x[_SUFFIX] for x in held])
        for i in range(1, len(held)):
            if held[i][_BUCKET] != held[i - 1][_BUCKET]:
                shared[i] = 0
        out = [[x[_BUCKET] for x in held], [self.run] * len(held), range(len(held)), shared, [x[_SUFFIX][p:] for x, p in zip(held, shared, strict=True)], *([x[k] for x in held] for k in (_BEFORE, _CORE, _SUB))]
        self.held, self.size, self.run = [], 0, self.run + 1
        return _batch(out, RUNS)


def _at_rows(keyed: DataFrame, wanted: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(text, places): the rows of documents with places wanted in them."""
    by_row = wanted.groupBy("did", "th").agg(F.collect_list(F.struct("pos", "l", "r", *columns)).alias("places"))
    return keyed.join(by_row, ["did", "th"]).select("text", "places")


def suffix_runs(keyed: DataFrame, wanted: DataFrame, buckets: int, length: int, gram: int, run_bytes: int = 16 << 20) -> DataFrame:
    """Front-coded sorted RUNS of the wanted anchors' suffixes, for all columns. wanted: (did, th, pos, l, r, kh, ch)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _RunWriter(run_bytes)
        for b in batches:
            for text, places in zip(b.column("text"), b.column("places").to_pylist(), strict=True):
                text = text.as_py()
                for p in places:
                    a = p["pos"]
                    out.add(p["kh"] % buckets, _tagged(0, length - gram, text[a : a + p["r"]]), text[a - p["l"] : a], p["kh"], p["ch"])
                    if out.full():
                        yield out.flush()
        yield out.flush()

    return _at_rows(keyed, wanted, ("kh", "ch")).mapInArrow(rows, RUNS)


def merged_spans(runs: DataFrame, buckets: int, length: int, gram: int, chunk: int = 4096) -> DataFrame:
    """A row of SPANS for each class that shares a window with another of its core, or occurs twice."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for b in batches:
            cols = [b.column(k).to_pylist() for k in ("bucket", "run", "shared", "rest", "before", "core", "sub")]
            for row in zip(*cols, strict=True):
                if row[0] != bucket:
                    yield from merge(held)
                    bucket, held = row[0], []
                held.append(row[1:])
        yield from merge(held)

    def merge(held: list) -> Iterator[pa.RecordBatch]:
        by_run: dict[int, list] = {}
        for run, shared, rest, before, core, sub in held:
            by_run.setdefault(run, []).append((shared, rest, (before, core, sub)))
        waiting: list[tuple] = []
        for shared, suffix, (before, core, sub) in LoserTree([iter(r) for r in by_run.values()]):
            lo, hi = suffix[0], suffix[1]
            if shared < 2 + length - (hi - lo) and waiting:  # another core begins: no window is shared with what came before
                if len(waiting) >= chunk:
                    yield from windows(waiting)
                    waiting = []
            waiting.append((shared - 2, lo, before, len(before) + lo, len(suffix) - 2 - lo, core, sub, shared < 2 + length - (hi - lo)))
        if waiting:
            yield from windows(waiting)

    def windows(waiting: list) -> Iterator[pa.RecordBatch]:
        reach = length - gram
        # a context that is alone in its core shares none
        new = np.array([w[7] for w in waiting])
        new[0] = True
        alone = new & np.append(new[1:], True)
        waiting = [w for w, out in zip(waiting, alone, strict=True) if not out]
        if not waiting:
            return
        begins = new[~alone]
        before = np.frombuffer(b"".join(w[2].rjust(reach, b"\0") for w in waiting), np.uint8).reshape(len(waiting), reach)
        shared, lo, left, right = (np.fromiter((w[k] for w in waiting), np.int64, len(waiting)) for k in (0, 1, 3, 4))
        shared[begins] = -1
        hit, l, r = shared_windows(before, shared, lo, left, right, length, gram)
        yield _batch([[waiting[i][5] for i in hit], [waiting[i][6] for i in hit], l, r], SPANS)

    small_batches(runs.sparkSession, 20_000)
    dealt = runs.repartition(buckets, "bucket").sortWithinPartitions("bucket", "run", "nth")
    return dealt.select("bucket", "run", "shared", "rest", "before", "core", "sub").mapInArrow(rows, SPANS)


UNITS = "core long, sub long, w int, lo int, hi int, l int, r int, ctx binary"


def contexts(keyed: DataFrame, wanted: DataFrame, length: int, gram: int) -> DataFrame:
    """A row of UNITS for each wanted class, for all columns. wanted: (did, th, pos, l, r, kh, ch, w)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [
                (p["kh"], p["ch"], p["w"], 0, length - gram, p["l"], p["r"], text.as_py()[p["pos"] - p["l"] : p["pos"] + p["r"]])
                for text, places in zip(b.column("text"), b.column("places").to_pylist(), strict=True)
                for p in places
            ]
            yield _batch(list(zip(*out, strict=True)) if out else [[]] * 8, UNITS)

    return _at_rows(keyed, wanted, ("kh", "ch", "w")).mapInArrow(rows, UNITS)


def parted(units: DataFrame, length: int) -> DataFrame:
    """UNITS for parts of the columns of units, which are (pcore, psub) there: contexts are cut to what a part's windows cover, and have a longer core in common.

    The columns whose windows lie within what all contexts of a core share, by the common prefixes of the least and the greatest to either side,
    are one part; those to its left and right are others, of which each window holds a byte in which the contexts part ways. Where all have too
    little in common for that, the columns are halved.
    """

    @F.pandas_udf("int")
    def common(a: pd.Series, b: pd.Series) -> pd.Series:
        """Bytes that two strings in hexadecimal begin with."""
        return pd.Series([len(commonprefix([x, y])) // 2 for x, y in zip(a, b, strict=True)], dtype="int32")

    right, left = F.hex(F.substring("ctx", F.col("l") + 1, F.col("r"))), F.reverse(F.hex(F.substring("ctx", F.lit(1), F.col("l"))))
    bounds = units.groupBy("core").agg(F.min(right).alias("r0"), F.max(right).alias("r1"), F.min(left).alias("l0"), F.max(left).alias("l1"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    known = bounds.select("core", "lo", "hi", F.greatest("lo", length - common("r0", "r1")).alias("a"), F.least("hi", common("l0", "l1")).alias("z"))
    half = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    part = lambda a, z: F.struct(a.cast("int").alias("a"), z.cast("int").alias("z"))
    three = F.array(part(F.col("lo"), F.col("a") - 1), part(F.col("a"), F.col("z")), part(F.col("z") + 1, F.col("hi")))
    two = F.array(part(F.col("lo"), half), part(half + 1, F.col("hi")))
    wide = 4 * (F.col("z") - F.col("a") + 1) >= F.col("hi") - F.col("lo") + 1
    parts, _ = store(known.select("core", F.filter(F.when(wide, three).otherwise(two), lambda p: p["a"] <= p["z"]).alias("parts")), "parts")
    some = units.join(parts, "core").withColumn("part", F.explode("parts"))
    lo, hi = F.col("part.a"), F.col("part.z")
    left_, right_ = F.least(hi, F.col("l")), F.least(length - lo, F.col("r"))
    own = some.where(left_ + right_ >= length).select(F.col("core").alias("pcore"), F.col("sub").alias("psub"), "w", lo.alias("lo"), hi.alias("hi"), left_.alias("l"), right_.alias("r"), F.substring("ctx", F.col("l") - left_ + 1, left_ + right_).alias("ctx"))
    core = F.xxhash64(F.substring("ctx", F.col("l") - F.col("lo") + 1, F.lit(length) - F.col("hi") + F.col("lo")), "lo", "hi")
    return own.select(core.alias("core"), F.xxhash64("ctx", "l").alias("sub"), *[c.split()[0] for c in UNITS.split(", ")[2:]], "pcore", "psub")


def split_crowds(units: DataFrame, crowd: int, length: int) -> tuple[DataFrame | None, list[DataFrame]]:
    """Cores of more than ``crowd`` contexts, split by parts of their window columns until none is: suffixes that need a merge, and level by level
    which units (pcore, psub) they stand for.

    With fewer columns, contexts have more bytes in common or part ways; many fall together, and the next level has each of them once. A single column's core is its window.
    """
    settled, links = [], []
    spark = units.sparkSession
    now, old = units, None
    while now.take(1):
        parts, first = store(parted(now, length), "column-parts")
        subs, second = store(parts.groupBy("core", "sub").agg(F.least(F.sum("w"), F.lit(2)).cast("int").alias("w"), F.min(F.struct("lo", "hi", "l", "r", "ctx")).alias("at")), "subs")
        sizes, third = store(subs.groupBy("core").agg(F.sum("w").alias("m"), ((F.first("at.lo") == F.first("at.hi")) | (F.count("*") == 1)).alias("last")).where("m > 1").withColumn("done", (F.col("m") <= crowd) | F.col("last")), "cores")
        links.append(store(parts.select("core", "sub", "pcore", "psub").join(sizes.select("core"), "core", "left_semi"), "links")[0])
        settled.append(store(subs.join(sizes.where("done").select("core"), "core").select("core", "sub", F.col("w").alias("n"), "at.*"), "settled")[0])
        now, new = store(subs.join(sizes.where("NOT done").select("core"), "core", "left_semi").select("core", "sub", "w", "at.*"), "crowded")
        drop_stored(spark, first, second, third, *([old] if old else []))
        old = new
    return reduce(DataFrame.unionByName, settled) if settled else None, links


def handed_down(partial: DataFrame, links: list[DataFrame]) -> DataFrame:
    """(core, sub, l, r): what the windows of each class cover, from the spans of parts: from the last level of the split to the first, each part once."""
    widest = lambda df: store(df.groupBy("core", "sub").agg(F.max("l").alias("l"), F.max("r").alias("r")), "covered")
    now, path = widest(partial)
    for level in reversed(links):
        up = now.join(level, ["core", "sub"]).select(F.col("pcore").alias("core"), F.col("psub").alias("sub"), "l", "r")
        after, new = widest(now.unionByName(up))
        drop_stored(partial.sparkSession, path)
        now, path = after, new
    return now


def context_runs(settled: DataFrame, buckets: int, run_bytes: int = 16 << 20) -> DataFrame:
    """RUNS of contexts that are cut already, each as often as it was found, twice at most. settled: (core, sub, n, lo, hi, l, r, ctx)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _RunWriter(run_bytes)
        for b in batches:
            for core, sub, n, lo, hi, l, ctx in zip(*(b.column(k).to_pylist() for k in ("core", "sub", "n", "lo", "hi", "l", "ctx")), strict=True):  # noqa: E741
                for _ in range(n):
                    out.add(core % buckets, _tagged(lo, hi, ctx[l - lo :]), ctx[: l - lo], core, sub)
                if out.full():
                    yield out.flush()
        yield out.flush()

    return settled.mapInArrow(rows, RUNS)


def spans(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = 1024) -> DataFrame:
    """(did, th, spans): each row's spans as start << 32 | end, not merged; rows that lose nothing are absent."""
    spark = keyed.sparkSession
    small_batches(spark)
    all_, first = store(anchor_table(keyed, length, gram), "anchors")
    # stored, so that the join is of two plain shuffles, which AQE splits at grams of very many anchors
    again, second = store(all_.groupBy("kh").agg(F.count("*").alias("n")).where("n > 1").select("kh"), "grams-again")
    known, _ = store(all_.join(again, "kh", "left_semi"), "anchors-again")
    drop_stored(spark, first, second)
    place = F.struct("did", "th", "pos", "l", "r")
    classes, _ = store(known.groupBy("kh", "ch").agg(F.least(F.count("*"), F.lit(2)).cast("int").alias("w"), F.min(place).alias("at"), F.max(place).alias("to")), "classes")
    sizes, _ = store(classes.groupBy("kh").agg(F.sum("w").alias("m")), "grams")
    sized = classes.join(sizes, "kh")
    n = sizes.agg(F.sum("m")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 50_000)
    wanted = sized.where(F.col("m") <= crowd).select("kh", "ch", F.explode(F.array_distinct(F.array("at", "to"))).alias("at")).select("kh", "ch", "at.*")
    runs = suffix_runs(keyed, wanted, buckets, length, gram)
    links: list[DataFrame] = []
    if sizes.where(F.col("m") > crowd).take(1):
        crowded, _ = store(contexts(keyed, sized.where(F.col("m") > crowd).select("kh", "ch", "w", "at.*"), length, gram), "contexts")
        settled, links = split_crowds(crowded, crowd, length)
        runs = runs.unionByName(context_runs(settled, buckets))
    small_batches(spark)
    partial, _ = store(merged_spans(runs, buckets, length, gram), "spans")
    # all windows of an anchor overlap in its gram, so what they cover is one span
    covered = handed_down(partial, links).select(F.col("core").alias("kh"), F.col("sub").alias("ch"), F.col("l").alias("cl"), F.col("r").alias("cr"))
    small_batches(spark)
    found = known.join(covered, ["kh", "ch"]).select("did", "th", (F.shiftleft((F.col("pos") - F.col("cl")).cast("long"), 32) + F.col("pos") + F.col("cr")).alias("span"))
    return store(found.groupBy("did", "th").agg(F.sort_array(F.collect_set("span")).alias("spans")), "row-spans")[0]


def merged(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs that the spans (sorted) cover."""
    if not len(packed):
        return packed, packed
    start, end = packed >> 32, np.maximum.accumulate(packed & 0xFFFFFFFF)
    fresh = np.concatenate([[True], start[1:] > end[:-1]])
    return start[fresh], end[np.concatenate([np.flatnonzero(fresh)[1:] - 1, [len(end) - 1]])]


REPORT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _kept(text: bytes, start: np.ndarray, end: np.ndarray) -> list[bytes]:
    cuts = [0, *np.stack([start, end], axis=1).ravel().tolist(), len(text)]
    return [text[a:z] for a, z in zip(cuts[::2], cuts[1::2], strict=True)]


def report(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = 1024) -> DataFrame:
    """A row of REPORT for each document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, text, packed in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("spans"), strict=True):
                text = text.as_py()
                start, end = merged(np.asarray(packed.values.to_numpy() if packed.is_valid else [], np.int64))
                digest = hashlib.sha256()
                for part in _kept(text, start, end):
                    digest.update(part)
                out.append((i, len(text), int((end - start).sum()), len(start), digest.hexdigest()))
            yield _batch(list(zip(*out, strict=True)) if out else [[]] * 5, REPORT)

    keyed = _keyed(docs)
    found = spans(keyed, length, gram, crowd)
    return keyed.join(found, ["did", "th"], "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "spans").mapInArrow(rows, REPORT)


def strip(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = 1024) -> DataFrame:
    """(doc_id, kept): what is left of each document's bytes. Cuts may fall inside a character."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [b"".join(_kept(t.as_py(), *merged(np.asarray(p.values.to_numpy() if p.is_valid else [], np.int64)))) for t, p in zip(b.column("text"), b.column("spans"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(kept, pa.binary())], ["doc_id", "kept"])

    keyed = _keyed(docs)
    found = spans(keyed, length, gram, crowd)
    return keyed.join(found, ["did", "th"], "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "spans").mapInArrow(rows, "doc_id long, kept binary")
