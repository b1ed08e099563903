"""Line dedup, native: levelled sorted runs of line hashes.

Documents come in batches by doc_id. Each batch's distinct line keys are merge-anti-joined with the runs of all earlier
batches, and those that are new become a run of their own, sorted by hash, with the document that holds the key first.
Once a level has ``fanout`` runs, they are compacted into one of the next level, so a key is rewritten a logarithmic
number of times. A line goes if the runs name an earlier document for its key.

A run is a table of one sorted file for each bucket of the key's hash. A batch is shuffled and sorted once; the runs are
read in their buckets and order, so neither the anti-joins nor the compaction (a full outer merge join) shuffle or sort them.

A key is 128 bits of XXH64 hashes of the line, stripped and lower-cased. Keys are combined map-side before they are
shuffled, so a line that a third of all documents hold is one row of each task; the last join, from lines to runs, is
one that AQE splits at such keys. Texts are shuffled once, to meet their document's list of dropped lines.

Defined cases: null or empty text: one empty line. A null doc_id comes after all others; all rows of one doc_id are one
document, each row keeping its own text; ties and repeated rows of one doc_id thus keep all their lines. Very long texts and lines are
taken whole. Other columns, whatever their names, come back as they were. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LAST_ID, SPACE, drop_stored, free_names, lower_az, new_path, settings, store

KEY = ["h1", "h2"]


def _order() -> object:
    return F.coalesce("doc_id", F.lit(LAST_ID))


def long_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(did, th, pos, h1, h2) of every line whose key has at least ``min_chars`` code points. th: hash of the row's text."""
    text = F.coalesce("text", F.lit(""))
    lines = docs.select(_order().alias("did"), F.xxhash64(text).alias("th"), F.posexplode(F.split(lower_az(text), "\n", -1)).alias("pos", "line"))
    key = F.btrim("line", F.lit(SPACE))
    return lines.withColumn("key", key).where(F.char_length("key") >= min_chars).select("did", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.concat(F.lit("2:"), "key")).alias("h2"))


class Runs:
    """The levelled runs: level -> [(table name, path)]. Each run has a row (h1, h2, first) for each key it was the first to see."""

    SCHEMA = "h1 long, h2 long, first long"

    def __init__(self, spark: SparkSession, fanout: int = 3) -> None:
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[str, str]]] = []

    def _push(self, df: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        name, path = f"strataloom_run_{uuid.uuid4().hex}", new_path(self.spark, f"run-{level}")
        # the order of a bucket of one file holds for the joins that read it
        with settings(self.spark, spark__sql__legacy__bucketedTableScan__outputOrdering="true"):
            df.write.format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", path).saveAsTable(name)
        self.levels[level].append((name, path))

    def add(self, batch: DataFrame) -> None:
        """batch (h1, h2, did): what the earlier runs don't hold becomes a run; full levels are compacted."""
        fresh = batch.groupBy(*KEY).agg(F.min("did").alias("first"))
        for name, _ in (run for level in self.levels for run in level):
            fresh = fresh.join(self.spark.table(name).select(*KEY), KEY, "left_anti")
        self._push(fresh, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            tables = [self.spark.table(name) for name, _ in old]
            whole = reduce(lambda a, b: a.join(b.withColumnRenamed("first", "other"), KEY, "full").select(*KEY, F.coalesce("first", "other").alias("first")), tables)
            self._push(whole, level + 1)
            self._forget(old)
            drop_stored(self.spark, *(path for _, path in old))
            level += 1

    def _forget(self, runs: list[tuple[str, str]]) -> None:
        for name, _ in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")  # the files stay

    def close(self) -> DataFrame:
        """All runs as plain files, so that a join on a hot key can be split; their names leave the catalog."""
        held = [run for level in self.levels for run in level]
        self._forget(held)
        return self.spark.read.schema(self.SCHEMA).parquet(*(path for _, path in held))


def dropped_lines(docs: DataFrame, batches: int = 4, fanout: int = 3, min_chars: int = 10) -> DataFrame:
    """(did, th, dropped): the sorted positions of the lines that each row loses; rows that lose none are absent."""
    edges = docs.agg(F.percentile_approx(_order(), [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    cuts = sorted(set(edges))
    lines, _ = store(long_lines(docs, min_chars).withColumn("batch", reduce(lambda a, b: a + b, [F.when(F.col("did") > c, 1).otherwise(0) for c in cuts], F.lit(0)).cast("int")), "lines", ["batch"])
    runs = Runs(docs.sparkSession, fanout)
    for i in range(len(cuts) + 1):
        runs.add(lines.where(F.col("batch") == i))
    lost = lines.join(runs.close(), KEY).where(F.col("first") < F.col("did"))
    return lost.groupBy("did", "th").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))


def dedup(docs: DataFrame, **how) -> DataFrame:
    """docs with ``text`` less its dropped lines, plus n_lines (before) and n_dropped; where docs has such columns, ours get a ``_`` behind."""
    did, th, gone_, lines_, n_lines, n_dropped = free_names(docs.columns, "_sl_did", "_sl_th", "_sl_gone", "_sl_lines", "n_lines", "n_dropped")
    text = F.coalesce("text", F.lit(""))
    own = docs.withColumns({did: _order(), th: F.xxhash64(text)})
    met = own.join(dropped_lines(docs, **how).toDF(did, th, gone_), [did, th], "left")
    lines, gone = F.split(text, "\n", -1), F.col(gone_)
    # runs of kept lines between dropped ones: linear, however many of a long text's lines go
    at = lambda k: F.when(k < F.size(gone), F.get(gone, k)).otherwise(F.size(F.col(lines_)))
    since = lambda k: F.when(k > 0, F.get(gone, k - 1) + 1).otherwise(F.lit(0))
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), lambda k: F.slice(F.col(lines_), since(k) + 1, at(k) - since(k))))
    n = (F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    met = met.withColumn(lines_, F.when(gone.isNotNull(), lines))
    out = met.withColumns({"text": F.when(gone.isNotNull(), F.array_join(kept, "\n")).otherwise(F.col("text")), n_lines: n, n_dropped: F.when(gone.isNotNull(), F.size(gone)).otherwise(0).cast("long")})
    return out.select(*docs.columns, n_lines, n_dropped)
