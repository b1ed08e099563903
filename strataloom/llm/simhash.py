"""SimHash near-dedup: 64-bit fingerprints linked at a few differing bits by a binary trie self-join.

Fingerprints are made distinct first, so a group of exact copies, however large, is one trie leaf. With an error budget
of k bits, at least one of k + 1 equal blocks of two linked fingerprints is the same; for each block, fingerprints are
turned so that it comes first and are dealt by it. What shares a block is one trie below the block's node: sorted
fingerprints, whose ranges are its nodes. Node pairs are traversed together, bit by bit and many at a time, adding up
the bits in which their paths differ, and are dropped when these exceed the budget or when both nodes already lie in
one component, which keeps dense groups of near copies from costing the square of their size.

A block value that very many fingerprints share is split: its trie's node pairs of a deeper level, dealt by further bits
of the fingerprint, become tasks of their own. Each task emits a spanning forest, at most one link a leaf, never the
pairs. Components of the links are joined up by distributed alternation.

Defined cases: null text or no words: fingerprint zero, linked like any other. Fewer words than a shingle: one shingle of
them all. Rows with a null doc_id take part and come back; a component of such rows alone has a null component_id.
Repeated rows give repeated results; one_of_each() keeps one of them, and of rows of one component the first by doc_id and then by a
hash of the text. Other columns, whatever their names, come back from one_of_each() as they were. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, free_names, row_key, settings, small_batches, store

BITS = 64
SEED = 42


def fingerprint(text: bytes | None, size: int = 3) -> int:
    """SimHash of the word shingles, repeats included: a bit is set if it is in over half of their XXH64 hashes."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - size + 1)
    last = ends[min(size, len(words)) - 1 :]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        spans = zip(starts[at : min(n, at + (1 << 16))].tolist(), last[at : at + (1 << 16)].tolist(), strict=True)
        hashes = np.array([digest(line[a:z], SEED) for a, z in spans], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, did, th, fp) for each row; fp holds the 64 bits as a signed long, (did, th) names the row's content."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), size) for t in b.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(k).cast(pa.int64()) for k in ("doc_id", "did", "th")), pa.array(fps)], ["doc_id", "did", "th", "fp"])

    small_batches(docs.sparkSession)
    did, th = row_key()
    return docs.select("doc_id", did.alias("did"), th.alias("th"), F.col("text").cast("binary").alias("text")).mapInArrow(rows, "doc_id long, did long, th long, fp long")


class _Forest:
    """Union-find over 0..n-1 with whole arrays of links at a time; root is each one's smallest member."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root[:] = up


def trie_links(keys: np.ndarray, group: np.ndarray, budget: int, first_bit: int, chunk: int | None = None) -> np.ndarray:
    """Each position's component root, linking positions of one group that differ in at most ``budget`` bits.

    keys (uint64) are distinct within a group and sorted by (group, key); all in a group agree above ``first_bit`` (63 is the
    highest bit). A trie node is a range of positions. Node pairs go down level by level, in chunks where they are many.
    """
    n = len(keys)
    chunk = chunk or max(1 << 13, n >> 3)  # small chunks link early and prune more; each costs a pass over the labels
    forest = _Forest(n)
    if n < 2:
        return forest.root
    edges = np.flatnonzero(np.diff(group)) + 1
    lo, hi = np.concatenate([[0], edges]), np.concatenate([edges, [n]])
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    stack = [(first_bit, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    while stack:
        bit, a0, a1, b0, b1, spent = stack.pop()
        if len(a0) > chunk:
            stack.append((bit, *(x[chunk:] for x in (a0, a1, b0, b1, spent))))
            a0, a1, b0, b1, spent = (x[:chunk] for x in (a0, a1, b0, b1, spent))
        # both nodes in one component already: nothing to gain from the pair
        change = np.concatenate([[0], np.cumsum(forest.root[1:] != forest.root[:-1])])
        same = (change[a0] == change[a1 - 1]) & (change[b0] == change[b1 - 1]) & (forest.root[a0] == forest.root[b0])
        leaves = (a1 - a0 == 1) & (b1 - b0 == 1)
        pair = leaves & ~same & (a0 != b0)
        if pair.any():
            i, j = a0[pair], b0[pair]
            near = np.bitwise_count(keys[i] ^ keys[j]) <= budget
            forest.link(i[near], j[near])
        go = ~leaves & ~same
        if bit < 0 or not go.any():
            continue
        a0, a1, b0, b1, spent = a0[go], a1[go], b0[go], b1[go], spent[go]
        am, bm = _split(keys, a0, a1, bit), _split(keys, b0, b1, bit)
        own = a0 == b0
        every = np.ones(len(a0), bool)
        grown = []
        for take, p0, p1, q0, q1, more in ((every, a0, am, b0, bm, 0), (every, am, a1, bm, b1, 0), (every, a0, am, bm, b1, 1), (~own, am, a1, b0, bm, 1)):
            take = take & (p1 > p0) & (q1 > q0) & (spent + more <= budget)
            grown.append([x[take] for x in (p0, p1, q0, q1, spent + np.int8(more))])
        pairs = [np.concatenate(x) for x in zip(*grown, strict=True)]
        if len(pairs[0]) > chunk:  # pairs that differ least go down first: they link most, and prune the rest
            order = np.argsort(pairs[4], kind="stable")
            pairs = [x[order] for x in pairs]
        if len(pairs[0]):
            stack.append((bit - 1, *pairs))
    return forest.root


def _split(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """Where the keys of each range get a 1 in ``bit``, given that they agree above it: a binary search of all ranges at once."""
    lo, hi = lo.copy(), hi.copy()
    one = np.uint64(1 << bit)
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) // 2
        set_ = (keys[np.minimum(mid, len(keys) - 1)] & one) != 0
        hi = np.where(open_ & set_, mid, hi)
        lo = np.where(open_ & ~set_, mid + 1, lo)


def turned(fps: np.ndarray, block: int, blocks: int) -> np.ndarray:
    """Fingerprints rotated so that a block comes first."""
    by = np.uint64(block * (BITS // blocks))
    return fps if not by else (fps << by) | (fps >> (np.uint64(BITS) - by))


def links(fps: DataFrame, budget: int = 3, node_rows: int = 1_000_000) -> DataFrame:
    """fps (fp long, distinct) -> (a, b): links that join up all fingerprints within ``budget`` bits, at most one a leaf and task.

    Blocks are k + 1 equal parts of the 64 bits for a budget of k (so k + 1 must divide 64). A block value with more than ``node_rows`` fingerprints is split
    by ``d`` further bits, spread over the rest of the fingerprint: a task is a pair of values of those bits that differ
    in at most ``budget`` places, so that every link is in at least one task.
    """
    blocks = budget + 1
    if BITS % blocks:
        raise ValueError("budget + 1 must divide 64")
    width = BITS // blocks
    spark = fps.sparkSession
    dealt = fps.select("fp", F.explode(F.array(*[F.lit(i) for i in range(blocks)])).alias("block"))
    part = F.when(F.col("block") == 0, F.shiftrightunsigned("fp", BITS - width))
    for i in range(1, blocks):
        part = part.when(F.col("block") == i, F.shiftrightunsigned("fp", BITS - width * (i + 1)).bitwiseAND((1 << width) - 1))
    dealt = dealt.withColumn("key", part)
    crowded = dealt.groupBy("block", "key").agg(F.count("*").alias("n")).where(F.col("n") > node_rows)
    if crowded.take(1):
        marked = dealt.join(crowded, ["block", "key"], "left")
    else:
        marked = dealt.withColumn("n", F.lit(None).cast("long"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Give each row of a crowded block the tasks it belongs to."""
        for b in batches:
            cols = {k: b.column(k).to_numpy(zero_copy_only=False) for k in ("fp", "block", "key")}
            n = b.column("n").fill_null(0).to_numpy(zero_copy_only=False)
            plain = n == 0
            out = [[cols["fp"][plain]], [cols["block"][plain]], [cols["key"][plain]], [np.zeros(plain.sum(), np.int64)]]
            for i in np.flatnonzero(~plain):
                d = min(16, int(np.ceil(np.log2(n[i] / node_rows))) + 1)
                tasks = _tasks(int(cols["fp"][i]) & ((1 << BITS) - 1), int(cols["block"][i]), width, d, budget)
                for kept, x in zip(out, (cols["fp"][i], cols["block"][i], cols["key"][i]), strict=False):
                    kept.append(np.full(len(tasks), x))
                out[3].append(np.array(tasks, np.int64))
            arrays = [np.concatenate(x) for x in out]
            yield pa.RecordBatch.from_arrays([pa.array(arrays[0], pa.int64()), pa.array(arrays[1], pa.int32()), pa.array(arrays[2], pa.int64()), pa.array(arrays[3], pa.int64())], ["fp", "block", "key", "task"])

    tasks = marked.select("fp", "block", "key", "n").mapInArrow(spread, "fp long, block int, key long, task long")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = tasks.repartition(n, "block", "key", "task").sortWithinPartitions("block", "key", "task")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole (block, key, task) groups, many at a time; the last group of a batch waits for its rest."""
        rest: np.ndarray | None = None
        for b in batches:
            rows = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("block", "key", "task", "fp")])
            rows = rows if rest is None else np.concatenate([rest, rows], axis=1)
            cut = np.flatnonzero((np.diff(rows[:3]) != 0).any(axis=0))
            if not len(cut):
                rest = rows
                continue
            end = cut[-1] + 1
            rest = rows[:, end:]
            yield from found(rows[:, :end])
        if rest is not None:
            yield from found(rest)

    def found(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        for block in range(blocks):
            own = rows[:, rows[0] == block]
            if own.shape[1] < 2:
                continue
            group = np.concatenate([[0], np.cumsum((np.diff(own[1:3]) != 0).any(axis=0))])
            keys = turned(own[3].view(np.uint64) if own[3].flags.c_contiguous else own[3].copy().view(np.uint64), block, blocks)
            order = np.lexsort((keys, group))
            keys, group, fp = keys[order], group[order], own[3][order]
            root = trie_links(keys, group, budget, BITS - width - 1)
            child = root != np.arange(len(root))
            if child.any():
                yield pa.RecordBatch.from_arrays([pa.array(fp[child]), pa.array(fp[root[child]])], ["a", "b"])

    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="100000"):  # four numbers a row
        return store(ordered.select("block", "key", "task", "fp").mapInArrow(joined, "a long, b long"), "links")[0]


def _tasks(fp: int, block: int, width: int, d: int, budget: int) -> list[int]:
    """The node pairs, as numbers, that a fingerprint of a split block belongs to."""
    from itertools import combinations

    free = BITS - width
    # d of the bits outside the block, evenly spread
    places = [((block + 1) * width + (i * free) // d) % BITS for i in range(d)]
    own = sum(((fp >> (BITS - 1 - p)) & 1) << i for i, p in enumerate(places))
    found = {own}
    for k in range(1, budget + 1):
        for flips in combinations(range(d), k):
            found.add(own ^ sum(1 << f for f in flips))
    return [1 + (min(own, x) << 20 | max(own, x)) for x in found]


def _rooted(docs: DataFrame, size: int, budget: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of all rows, and each distinct one's root, copies and first row."""
    fps, _ = store(fingerprints(docs, size), "fingerprints")
    nodes, _ = store(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.min(F.struct("did", "th")).alias("row"), F.count("*").alias("copies")), "nodes")
    roots = components(links(nodes.select("fp"), budget)).withColumnRenamed("node", "fp")
    tied, _ = store(nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "roots")
    return fps, tied


def near_duplicates(docs: DataFrame, size: int = 3, budget: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id, copies) for each row of docs; copies: rows of the same fingerprint."""
    fps, tied = _rooted(docs, size, budget)
    smallest = tied.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = tied.join(smallest, "root").select("fp", "component_id", "copies")
    return fps.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "copies")


def one_of_each(docs: DataFrame, size: int = 3, budget: int = 3) -> DataFrame:
    """The documents that are first of their component, by doc_id and then by a hash of the text, with all their columns."""
    fps, tied = _rooted(docs, size, budget)
    kept = tied.groupBy("root").agg(F.min("row").alias("row")).select("row.did", "row.th")
    kept, _ = store(kept, "kept-rows")
    key = free_names(docs.columns, "_sl_did", "_sl_th")
    own = docs.withColumns(dict(zip(key, row_key(), strict=True)))
    out = own.join(kept.toDF(*key), key, "left_semi")
    if fps.join(kept, ["did", "th"], "left_semi").groupBy("did", "th").count().where("count > 1").take(1):  # one of the repeated rows stays
        out = out.dropDuplicates(key)
    return out.select(*docs.columns)
