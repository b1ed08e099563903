"""Hard-negative mining by Fagin's threshold algorithm.

Vectors are quantised to integers, so every score is an exact inner product. An anchor's positives are its best rows of the
same label; for each of them, its hard negatives are the best rows of other labels whose score lies in the positive's window.

Candidates lie in blocks of bounded size, sorted by label. A block is stored once with its rows in order of each dimension (the
sorted lists). For an anchor, lists are read from the end that its component's sign favours, all to the same depth; rows met are
scored at once by random access to the block's matrix. The threshold is the anchor's product with the values at that depth, which
no row still unmet can exceed. A block is done with an anchor once the threshold is strictly below each window's kth score, or below the
window's floor while it isn't full: a tie could still matter by its id, a lower score can't.

* Anchors are the query set: packed in chunks of at most ``chunk`` rows, which meet all blocks one chunk at a time. What is broadcast is
  one chunk (4,096 anchors of 64 components: 1 MB); a chunk's results are stored before the next.
* A block answers with at most k rows for each window. They are ranked by anchor after a limit within each task.
* Nothing is grouped by label, so a label of a third of all rows is only more blocks.

Defined cases: rows with a null label, id or vector, or with a null or non-finite component take no part. A shorter vector's missing components are
zero; an empty one scores 0 with all. Ties go to the smaller id; repeated ids are rows of their own. Scores are exact as long as they fit a long;
components whose quantised value passes 2^31 stop the job. Other columns are left out, whatever their names. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stored, new_path, settings, store

#: Rows of a block and of a chunk of anchors.
BLOCK, CHUNK = 4096, 4096
PACKED = "block long, n int, dims int, rids binary, ids binary, labels binary, matrix binary, lists binary"
FOUND = "anchor long, anchor_id long, positive_id long, window int, positive_score long, id long, score long"


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vectors (vec_id, label, embedding) as stored (rid, id, label, q): components as floor(scale * x), rows that take no part left out."""
    x = F.transform("embedding", lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))
    sound = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(sound, F.lit(False)))
    found = rows.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), x.alias("q"))
    return store(found.withColumn("rid", F.monotonically_increasing_id()), "vectors")[0]


def _pack(size: int, dims: int, lists: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (rid, id, label, q) of a partition as packed blocks of at most ``size`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def made(table: pa.Table) -> pa.RecordBatch:
            n, q = len(table), table["q"].combine_chunks()
            sizes, values = np.diff(q.offsets.to_numpy()), q.flatten().to_numpy()
            m = np.zeros((n, dims), np.int64)
            m[np.repeat(np.arange(n), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
            if np.abs(m).max(initial=0) >= 1 << 31:
                raise OverflowError("a component is too large for exact scores")
            rids, ids, labels = (table[c].to_numpy().astype(np.int64) for c in ("rid", "id", "label"))
            order = np.argsort(m, axis=0, kind="stable").T.astype(np.int32) if lists else np.zeros(0, np.int32)
            row = {"block": [int(rids[0])], "n": [n], "dims": [dims], "rids": [rids.tobytes()], "ids": [ids.tobytes()], "labels": [labels.tobytes()], "matrix": [m.astype(np.int32).tobytes()], "lists": [np.ascontiguousarray(order).tobytes()]}
            types = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row.values(), types, strict=True)], names=list(row))

        for batch in batches:
            held.append(batch)
            while sum(map(len, held)) >= size:
                whole = pa.Table.from_batches(held)
                yield made(whole.slice(0, size).combine_chunks())
                held = whole.slice(size).to_batches()
        if sum(map(len, held)):
            yield made(pa.Table.from_batches(held).combine_chunks())

    return run


def threshold_search(m: np.ndarray, lists: np.ndarray, a: np.ndarray, fits: np.ndarray, ids: np.ndarray, windows: list[tuple[float, float]], k: int) -> list[np.ndarray]:
    """For each window (low, high): the rows of the block that are among its first k by (score descending, id).

    ``m`` rows by dimensions, ``lists`` dimensions by rows (ascending by value), ``fits`` the rows that may be taken.
    """
    n, signed = len(m), np.flatnonzero(a)
    up, down = np.flatnonzero(a > 0), np.flatnonzero(a < 0)
    open_rows = fits.copy()
    best = [(np.zeros(0, np.int64), np.zeros(0, m.dtype)) for _ in windows]
    depth = 0
    while depth < n:
        at = min(n, max(32, depth + depth // 2))
        met = np.zeros(n, bool)
        if len(signed):
            met[lists[up, n - at : n - depth]] = True  # largest first
            met[lists[down, depth:at]] = True  # smallest first
        else:
            met[:] = True
        new = np.flatnonzero(met & open_rows)
        open_rows[new] = False
        depth = at
        scores = m[new] @ a
        top = a[up] @ m[lists[up, n - at], up] + a[down] @ m[lists[down, at - 1], down]
        bound = np.inf
        for w, (low, high) in enumerate(windows):
            within = (scores >= low) & (scores <= high)
            rows, held = np.concatenate([best[w][0], new[within]]), np.concatenate([best[w][1], scores[within]])
            first = np.lexsort((ids[rows], -held))[:k]
            best[w] = rows[first], held[first]
            bound = min(bound, held[first][-1] if len(first) == k else low)
        if top < bound:
            break
    return [rows for rows, _ in best]


def _mine(k: int, same: bool, share: tuple[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of a block joined with a chunk of anchors -> FOUND, by the threshold algorithm in each block.

    ``same``: the anchor's own label, in one window without ends; else other labels, in a window for each positive.
    """
    part, whole = share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n, dims = row["n"], row["dims"]
                ids, rids, labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "rids", "labels"))
                m = np.frombuffer(row["matrix"], np.int32).reshape(n, dims)
                lists = np.frombuffer(row["lists"], np.int32).reshape(dims, n)
                a_ids, a_rids, a_labels = (np.frombuffer(row[c], np.int64) for c in ("a_ids", "a_rids", "a_labels"))
                anchors = np.frombuffer(row["a_matrix"], np.int32).reshape(len(a_ids), dims)
                # products of doubles are exact below 2^53
                kind = np.float64 if dims * float(np.abs(m).max(initial=0)) * float(np.abs(anchors).max(initial=0)) < 2.0**53 else np.int64
                m, anchors = m.astype(kind), anchors.astype(kind)
                wanted: dict[int, list[dict]] = {}
                for t in row.get("targets") or []:
                    wanted.setdefault(t["anchor"], []).append(t)
                out: list[tuple] = []
                for i, rid in enumerate(a_rids.tolist()):
                    fits = (labels == a_labels[i]) & (rids != rid) if same else labels != a_labels[i]
                    goals = [{"window": 0, "id": None, "score": None}] if same else wanted.get(rid, [])
                    if not goals or not fits.any():
                        continue
                    # part * positive <= whole * score <= whole * positive
                    windows = [(-np.inf, np.inf)] if same else [(-(-part * g["score"] // whole), g["score"]) for g in goals]
                    for goal, rows in zip(goals, threshold_search(m, lists, anchors[i], fits, ids, windows, k), strict=True):
                        scores = m[rows] @ anchors[i]
                        out += [(rid, int(a_ids[i]), goal["id"], goal["window"], goal["score"], int(ids[r]), int(v)) for r, v in zip(rows, scores, strict=True)]
                names = [c.split()[0] for c in FOUND.split(", ")]
                types = [pa.int32() if c.endswith(" int") else pa.int64() for c in FOUND.split(", ")]
                for start in range(0, len(out), 50_000):
                    columns = zip(*out[start : start + 50_000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return run


def _met(blocks: DataFrame, one: DataFrame, search: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Every block with the one packed row of a chunk, which is broadcast, searched."""
    return blocks.crossJoin(F.broadcast(one)).mapInArrow(search, FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first k of each anchor's window, with ``rank`` from 1; Spark limits each task's rows before it shuffles them."""
    order = Window.partitionBy("anchor", "window").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100), scale: int = 256, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors``: a condition on vec_id (as column ``id``). ``share`` (part, whole): a negative's score times ``whole`` is at least ``part`` times the positive's, and at
    most ``whole`` times it.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors, scale)
    n, dims = rows.agg(F.count("*"), F.coalesce(F.max(F.size("q")), F.lit(0))).first()
    n_blocks = max(1, -(-n * 5 // (block * 4)))  # ranges are not quite even: most fit one block
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=str(block), spark__sql__execution__arrow__maxBytesPerBatch="16m"):
        blocks, _ = store(rows.repartitionByRange(n_blocks, "label", "id", "rid").sortWithinPartitions("label", "id", "rid").mapInArrow(_pack(block, dims, True), PACKED), "blocks")
        asked = rows.where(anchors)
        # chunks are groups by a hash, so that their number doesn't hang on the session's partitions
        n_chunks = max(1, -(-asked.count() * 5 // (chunk * 4)))
        dealt = asked.withColumn("chunk", F.pmod(F.xxhash64("rid"), F.lit(n_chunks)))
        packed, _ = store(dealt.groupBy("chunk").applyInArrow(lambda t: pa.Table.from_batches(_pack(len(t), dims, False)(iter(t.combine_chunks().to_batches()))), PACKED), "anchors")
    packed = packed.select(F.col("block").alias("chunk"), F.col("rids").alias("a_rids"), F.col("ids").alias("a_ids"), F.col("labels").alias("a_labels"), F.col("matrix").alias("a_matrix"))
    paths = []
    # a block and a chunk at a time in a worker, and no more than a block in a scan's task
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="1", spark__sql__files__maxPartitionBytes=str(block * 600), spark__sql__files__openCostInBytes=str(block * 300)):
        for at in [r.chunk for r in packed.select("chunk").orderBy("chunk").collect()]:
            one = packed.where(F.col("chunk") == at)
            found, path = store(_first(_met(blocks, one, _mine(positives, True, share)), positives), "positives")
            goals = found.where(F.col("score") >= 0).agg(F.collect_list(F.struct("anchor", (F.col("rank") - 1).alias("window"), "id", "score")).alias("targets"))  # at most ``positives`` for each anchor of the chunk
            paths.append(store(_first(_met(blocks, one.crossJoin(goals), _mine(negatives, False, share)), negatives), "negatives")[1])
            drop_stored(spark, path)
    out = spark.read.schema(FOUND + ", rank int").parquet(*paths) if paths else spark.createDataFrame([], FOUND + ", rank int")
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
