"""Shared pieces of the training-data operators: shared storage, row keys, graph components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space, tab, LF, VT, FF, CR.
SPACE = " \t\n\x0b\x0c\r"
#: Stands for a null doc_id wherever ids are compared: such rows come last.
LAST_ID = (1 << 63) - 1


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, each with underscores added until no column has it (names are compared as Spark does, without case)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (dots as ``__``) for the jobs that run inside; what was set before comes back."""
    keys = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def small_batches(spark: SparkSession, rows: int = 2000, size: str = "8m") -> None:
    """Bound what one Arrow batch holds, so that long texts can't fill a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session, or one of our own where unset (tests)."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="strataloom-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def new_path(spark: SparkSession, label: str) -> str:
    """Where a table of this application goes that nothing else uses."""
    return f"{shared_dir(spark)}/strataloom/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def store(df: DataFrame, label: str, partition_by: list[str] | None = None) -> tuple[DataFrame, str]:
    """Write df as a table in the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_stored(spark: SparkSession, *paths: str) -> None:
    """Delete tables of store() that nothing reads any more."""
    for path in paths:
        with contextlib.suppress(Exception):
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clean_up(spark: SparkSession) -> None:
    """Delete all that this application has stored. Results of the operators read such tables: write them first."""
    drop_stored(spark, f"{shared_dir(spark)}/strataloom/{spark.sparkContext.applicationId}")


def row_key() -> tuple[Column, Column]:
    """(doc_id with nulls last, hash of the text): names a row of documents by what it holds, so that it is the same in every pass."""
    return F.coalesce("doc_id", F.lit(LAST_ID)).cast("long"), F.xxhash64(F.coalesce("text", F.lit("")))


def lower_az(c):
    """A-Z lower-cased, all else as it is: lower() would change letters outside ASCII too."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Connected components of edges (a long, b long) as (node, root), root the smallest node reached.

    Alternates large-star and small-star steps (Kiveris et al., Connected Components in MapReduce and Beyond) until
    the edge set no longer changes; each round's edges are a stored table. Nodes without an edge don't appear.
    Hot nodes: min() is combined map-side, and the joins on the hot node are AQE skew joins.
    """
    spark = edges.sparkSession
    both = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, path = store(both, "cc")
    before = None
    for _ in range(max_rounds):
        sides = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sides.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a != b").distinct()
        after, new = store(small, "cc")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_stored(spark, path)
        now, path = after, new
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).distinct()
