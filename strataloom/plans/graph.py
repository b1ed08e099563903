"""Connected components of an edge list, as rounds of stored tables."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for what runs inside; what was set before comes back."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; one of our own where it is unset, in local mode only."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="strataloom-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def own_folder(spark: SparkSession) -> str:
    """The folder of all that this application stores."""
    return f"{shared_dir(spark)}/strataloom/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{own_folder(spark)}/{label}-{uuid.uuid4().hex}"


def clean_up(spark: SparkSession) -> None:
    """Delete all that this application has stored, once the results that read it are written."""
    where = spark._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written to the application's folder and read again: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored = path
    return out


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out by its keys to all shuffle partitions: left to itself, Spark makes one task of many where they have few bytes, and masks, compressed, have next to none."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def shuffled(df: DataFrame, *keys: str) -> DataFrame:
    """df as the side of a join on keys that is dealt() and never broadcast: stored files are far smaller than their rows, and rows that explode() makes aren't estimated at all."""
    return dealt(df, *keys).hint("merge")


def forget(df: DataFrame) -> None:
    """Delete what stored() wrote, once nothing reads it any more."""
    with contextlib.suppress(Exception):
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(df._stored)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def min_labels(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """edges (image_id, a, b) -> (image_id, node, root): the least node reached.

    Each round every node takes the least label among its neighbours', then its label's label; both are aggregations with
    map-side combine. For images whose graph outgrows one task.
    """
    key = ["image_id"]
    both = stored(edges.select(*key, F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(*key, F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), "edges")
    label = stored(both.groupBy(*key, F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("root")), "labels")
    for _ in range(max_rounds):
        near = both.join(label.select(*key, F.col("node").alias("v"), "root").hint("merge"), [*key, "v"]).groupBy(*key, F.col("u").alias("node")).agg(F.min("root").alias("low"))
        step = label.join(near.hint("merge"), [*key, "node"]).select(*key, "node", F.least("root", "low").alias("root"))
        step = stored(step, "labels")
        jump = step.select(*key, F.col("node").alias("root"), F.col("root").alias("up"))
        new = stored(step.join(jump.hint("merge"), [*key, "root"], "left").select(*key, "node", F.coalesce("up", "root").alias("root")), "labels")
        moved = new.join(label.withColumnRenamed("root", "was").hint("merge"), [*key, "node"]).where("root <> was").limit(1).count()
        forget(step)
        forget(label)
        label = new
        if not moved:
            return label
    raise RuntimeError(f"labels didn't settle in {max_rounds} rounds")
