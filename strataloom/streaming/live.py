"""Streams of label edits and of evaluations: the latest edit of a pixel wins, metrics are windowed by event time."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.graph import stored

EDITS = "layer string, x int, y int, seq long, after int, ts timestamp"


def edit_stream(spark: SparkSession, path: str, schema: str = EDITS, files_per_trigger: int = 8) -> DataFrame:
    """A folder of Parquet files of edits, as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def latest(edits: DataFrame) -> DataFrame:
    """Each pixel's last value; state is one number a pixel."""
    return edits.groupBy("layer", "x", "y").agg(F.max_by("after", "seq").alias("value"), F.max("seq").alias("seq"))


def activity(events: DataFrame, watermark: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Events by type and tumbling window; rows later than the watermark are left out, and state is dropped behind it."""
    return events.withWatermark("ts", watermark).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def run_to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Start a query that writes what is there and ends."""
    return df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_latest(edits: DataFrame, path: str, checkpoint: str, parts: int = 64):
    """Keep latest() as a table in ``parts`` partitions by the pixel's hash: a micro-batch merges with the partitions it touches and replaces these alone.

    Merging takes each pixel's highest seq, so a batch that is run again after a failure changes nothing. Read the table with read_latest().
    """
    part = F.pmod(F.xxhash64("layer", "x", "y"), F.lit(parts)).cast("int")

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy("layer", "x", "y").agg(F.max_by("after", "seq").alias("value"), F.max("seq").alias("seq")).withColumn("part", part)
        new = stored(new, "micro-batch")
        touched = [r.part for r in new.select("part").distinct().collect()]  # at most ``parts``
        if not touched:
            return
        try:
            old = spark.read.schema(new.schema).parquet(path).where(F.col("part").isin(touched))
            new = stored(new.unionByName(old).groupBy("layer", "x", "y").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq")).withColumn("part", part), "merged")
        except AnalysisException as e:  # no table yet
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        new.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)

    return edits.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """(layer, x, y, value, seq) of a table of upsert_latest()."""
    return spark.read.parquet(path).drop("part")
