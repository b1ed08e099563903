"""Drawn lines, their bands and the negatives, kept by tiles: an edit recomputes only the tiles it can change.

A store holds, for each tile, the set pixels of the drawn lines and the pixels of what is derived from them: the band (the reference line
widened by a square) and the negatives (the negative line widened, less the band). An edit's dirty rectangle names the tiles whose lines
change; the rectangle widened by the radius names those whose derived pixels may change, and these widened by it those whose lines are read
for that. Only these are read, computed and written, as partitions that replace the old ones; counts follow by tile, so that the count of an
image's negatives is a sum over tiles, never over pixels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .edits import bounds

#: Edge of a tile that is read, computed and replaced as one.
EDIT_TILE = 256
#: A batch that touches more tiles than this isn't listed on the driver but joined.
LISTED_TILES = 5_000
LINES, BANDS, COUNTS = "layer string, x int, y int", "x int, y int, ref int, neg int", "image_id long, cell string, version int, ref long, neg long"


def _cell(image: str, ty: Column, tx: Column) -> Column:
    return F.concat_ws("_", F.col(image), ty, tx)


def tiles_of(rects: DataFrame, reach: int, width: int, height: int, tile: int = EDIT_TILE) -> DataFrame:
    """(image_id, cell, tx, ty): the tiles that rectangles (image_id, x0, y0, x1, y1) widened by ``reach`` touch inside the image."""
    span = lambda a, b, n: F.explode(F.sequence(F.floor(F.greatest(F.lit(0), F.col(a) - reach) / tile), F.floor(F.least(F.lit(n - 1), F.col(b) + reach) / tile)))
    inside = rects.where((F.col("x1") + reach >= 0) & (F.col("y1") + reach >= 0) & (F.col("x0") - reach < width) & (F.col("y0") - reach < height))
    each = inside.withColumn("tx", span("x0", "x1", width)).withColumn("ty", span("y0", "y1", height))
    return each.select("image_id", _cell("image_id", F.col("ty"), F.col("tx")).alias("cell"), "tx", "ty").distinct()


def widened(points: DataFrame, radius: int, width: int, height: int) -> DataFrame:
    """points (image_id, layer, x, y) widened by a square, along x and then along y; each pixel once."""
    for axis, n in (("x", width), ("y", height)):
        points = points.withColumn(axis, F.explode(F.sequence(F.greatest(F.lit(0), F.col(axis) - radius), F.least(F.lit(n - 1), F.col(axis) + radius)))).distinct()
    return points


def bands_of(lines: DataFrame, radius: int, width: int, height: int) -> DataFrame:
    """(image_id, x, y, ref, neg) of the pixels that are band or negative: the band excludes the negative."""
    wide = widened(lines, radius, width, height)
    has = lambda layer: F.max((F.col("layer") == layer).cast("int"))
    return wide.groupBy("image_id", "x", "y").agg(has("reference").alias("ref"), has("negative").alias("_n")).select("image_id", "x", "y", "ref", F.when(F.col("ref") == 1, 0).otherwise(F.col("_n")).alias("neg"))


class LabelStore:
    """The label layers of an image set in a folder. One writer at a time; readers see whole tiles."""

    def __init__(self, spark: SparkSession, path: str, width: int, height: int, radius: int = 2, tile: int = EDIT_TILE) -> None:
        self.spark, self.path, self.width, self.height, self.radius, self.tile = spark, path, width, height, radius, tile
        self.version = 0
        #: cells read and replaced by the last batch, None if it was joined instead of listed
        self.last: dict[str, list[str] | None] = {}
        self.empty = True

    def _read(self, what: str, schema: str) -> DataFrame:
        if self.empty:
            return self.spark.createDataFrame([], schema + ", cell string")
        return self.spark.read.schema(schema + ", cell string").parquet(f"{self.path}/{what}")

    def _of(self, table: DataFrame, cells: DataFrame, what: str) -> DataFrame:
        """The rows of some tiles: by partition names where these are few, else by a join that prunes partitions as it runs."""
        found = [r.cell for r in cells.select("cell").distinct().limit(LISTED_TILES + 1).collect()]
        listed = len(found) <= LISTED_TILES
        self.last[what] = sorted(found) if listed else None
        return table.where(F.col("cell").isin(found)) if listed else table.join(cells.select("cell").distinct(), "cell", "left_semi")

    def _replace(self, what: str, rows: DataFrame, cells: DataFrame, columns: list[str]) -> None:
        """Write tiles in place of what they held; each has a row without coordinates, so that one without pixels is replaced too."""
        marks = cells.select("cell").distinct().select(*[F.lit(-1).alias(c) if c in ("x", "y") else F.lit(None).alias(c) for c in columns], "cell")
        whole = rows.select(*columns, "cell").unionByName(marks)
        whole.repartition("cell").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cell").parquet(f"{self.path}/{what}")

    def _tile(self) -> Column:
        return _cell("image_id", F.floor(F.col("y") / self.tile), F.floor(F.col("x") / self.tile))

    def _image(self, rows: DataFrame) -> DataFrame:
        return rows.where("x >= 0").withColumn("image_id", F.split_part("cell", F.lit("_"), F.lit(1)).cast("long"))

    def lines(self) -> DataFrame:
        """(image_id, layer, x, y) of all set pixels of the drawn lines."""
        return self._image(self._read("lines", LINES)).select("image_id", "layer", "x", "y")

    def masks(self) -> DataFrame:
        """(image_id, x, y, ref, neg) of all pixels that are band or negative."""
        return self._image(self._read("bands", BANDS)).select("image_id", "x", "y", "ref", "neg")

    def counts(self) -> DataFrame:
        """(image_id, ref, neg): pixels of the band and negatives, from the tiles' counts alone."""
        if self.empty:
            return self.spark.createDataFrame([], "image_id long, ref long, neg long")
        log = self.spark.read.schema(COUNTS).parquet(f"{self.path}/counts")
        now = log.groupBy("image_id", "cell").agg(F.max_by("ref", "version").alias("ref"), F.max_by("neg", "version").alias("neg"))
        return now.groupBy("image_id").agg(F.sum("ref").alias("ref"), F.sum("neg").alias("neg"))

    def apply(self, deltas: DataFrame) -> None:
        """A batch of deltas (image_id, seq, layer, x, y, after): a pixel's last one counts. What lies outside the image is left out."""
        from ..plans.graph import stored

        inside = (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") < self.width) & (F.col("y") < self.height)
        d = stored(deltas.where(inside).select(F.col("image_id").cast("long").alias("image_id"), "seq", "layer", "x", "y", "after"), "deltas")
        rects = stored(bounds(d, "image_id").drop("changed"), "bounds")
        near = lambda reach: tiles_of(rects, reach, self.width, self.height, self.tile)
        edited = d.groupBy("image_id", "layer", "x", "y").agg(F.max_by("after", "seq").alias("after"))
        own, target = near(0), near(self.radius)
        # the lines that the bands of those tiles can come from, with the edit
        t = self.tile
        whole = target.select("image_id", (F.col("tx") * t).alias("x0"), (F.col("ty") * t).alias("y0"), (F.col("tx") * t + t - 1).alias("x1"), (F.col("ty") * t + t - 1).alias("y1"))
        source = self._image(self._of(self._read("lines", LINES), tiles_of(whole, self.radius, self.width, self.height, t), "read")).select("image_id", "layer", "x", "y")
        lines = stored(source.join(edited, ["image_id", "layer", "x", "y"], "left_anti").unionByName(edited.where("after = 1").drop("after")).withColumn("cell", self._tile()), "lines")
        bands = bands_of(lines.drop("cell"), self.radius, self.width, self.height).withColumn("cell", self._tile())
        bands = stored(self._of(bands, target, "replaced"), "bands")
        self._replace("lines", lines.join(own.select("cell"), "cell", "left_semi"), own, ["layer", "x", "y"])
        self._replace("bands", bands, target, ["x", "y", "ref", "neg"])
        self.version += 1
        n = bands.groupBy("cell").agg(F.sum("ref").cast("long").alias("ref"), F.sum("neg").cast("long").alias("neg"))
        log = target.select("image_id", "cell").join(n, "cell", "left").select("image_id", "cell", F.lit(self.version).alias("version"), F.coalesce("ref", F.lit(0)).alias("ref"), F.coalesce("neg", F.lit(0)).alias("neg"))
        log.coalesce(1).write.mode("append").parquet(f"{self.path}/counts")
        self.empty = False


def undone(deltas: DataFrame, to_seq: int) -> DataFrame:
    """The deltas that take a log (image_id, seq, layer, x, y, after) back to the state at ``to_seq``: only pixels that were edited since."""
    order = Window.partitionBy("image_id", "layer", "x", "y")
    w = deltas.withColumns({"_was": F.max_by("after", F.when(F.col("seq") <= to_seq, F.col("seq"))).over(order), "_last": F.max("seq").over(order)})
    since = w.where((F.col("seq") == F.col("_last")) & (F.col("seq") > to_seq))
    return since.select("image_id", F.col("seq").alias("seq"), "layer", "x", "y", F.coalesce("_was", F.lit(0)).alias("after"))
