"""Bit-packed masks, project and diagnostic documents, stored ZIP archives, images and the autosave table."""

from __future__ import annotations

import datetime as dt
import io
import json
import struct
import zipfile
import zlib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .labels import BOUNDARY_RGB

PROJECT_FORMAT, PROJECT_VERSION = "strataloom-project", 1
#: Characters of a packed mask that are decoded as one: a multiple of 4, so that each piece is whole bytes (384 pixels).
PIECE = 64


def pack_mask(px: DataFrame, mask: str) -> DataFrame:
    """(image_id, packed): the mask in raster order, eight pixels a byte, lowest bit first, as base64. Needs w.

    Only bytes with a set bit are shuffled; each image's string is put together from them.
    """
    p = F.col("y").cast("long") * F.col("w") + F.col("x")
    bits = px.groupBy("image_id", F.floor(p / 8).alias("i")).agg(F.sum(F.col(mask) * F.pow(F.lit(2), p % 8).cast("int")).cast("int").alias("b"))
    g = bits.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("i", "b"))).alias("bytes"))
    text = F.array_join(F.transform("bytes", lambda v: F.lpad(F.hex(v["b"]), 2, "0")), "")
    return g.select("image_id", F.translate(F.base64(F.unhex(text)), "\r\n", "").alias("packed"))  # base64() breaks lines


def unpack_mask(packed: DataFrame) -> DataFrame:
    """(image_id, y, x, bit) of packed (image_id, packed, w, h); bits that a string doesn't have are null.

    A string is cut once into pieces of PIECE characters, which are dealt out and decoded on their own, so that a pixel carries a piece and not the image.
    """
    bits = PIECE * 6
    n = F.ceil(F.col("w").cast("long") * F.col("h") / bits).cast("int")
    cut = F.concat(F.regexp_extract_all(F.translate("packed", "\r\n", ""), F.lit(f".{{1,{PIECE}}}"), F.lit(0)), F.array_repeat(F.lit(""), n))
    pieces = packed.select("image_id", "w", "h", F.posexplode(cut).alias("_i", "_piece")).where(F.col("_i").cast("long") * bits < F.col("w").cast("long") * F.col("h"))
    pieces = pieces.repartition(int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions")), "image_id", "_i")
    raw = pieces.select("image_id", "w", "h", (F.col("_i").cast("long") * bits).alias("_from"), F.hex(F.unbase64("_piece")).alias("hex"))
    last = F.least(F.lit(bits), F.col("w").cast("long") * F.col("h") - F.col("_from")) - 1
    p = raw.select("image_id", "w", "hex", "_from", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_p")).withColumn("p", F.col("_from") + F.col("_p"))
    at = F.conv(F.col("hex").substr((F.floor(F.col("_p") / 8) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
    bit = F.floor(at / F.pow(F.lit(2), F.col("_p") % 8)).cast("int") % 2
    return p.select("image_id", F.floor(F.col("p") / F.col("w")).cast("int").alias("y"), (F.col("p") % F.col("w")).cast("int").alias("x"), bit.alias("bit"))


def project_documents(masks: DataFrame, settings: dict, extra: list[str] | None = None) -> DataFrame:
    """(image_id, document): a project document as JSON for each image. masks: packed columns and other parts by name."""
    parts = [c for c in masks.columns if c != "image_id" and c not in (extra or [])]
    doc = F.struct(F.lit(PROJECT_FORMAT).alias("format"), F.lit(PROJECT_VERSION).alias("formatVersion"), F.lit(json.dumps(settings, sort_keys=True)).alias("settings"), F.struct(*parts).alias("masks"), *(extra or []))
    return masks.select("image_id", F.to_json(doc).alias("document"))


def read_projects(documents: DataFrame, schema: str) -> DataFrame:
    """Documents parsed by a schema, with ``error`` where format or version are wrong (null where usable). projects.restore() checks image and size too."""
    d = documents.withColumn("p", F.from_json("document", schema))
    error = F.when(F.col("p").isNull() | F.col("p.format").isNull(), "not a project").when(F.col("p.format") != PROJECT_FORMAT, "another format").when(~F.col("p.formatVersion").eqNullSafe(PROJECT_VERSION), "another version")
    return d.withColumn("error", error)


def autosave(documents: DataFrame, path: str) -> None:
    """Upsert (key, document) into a table partitioned by the key's first character: only the partitions written change."""
    spark = documents.sparkSession
    new = documents.withColumn("prefix", F.substring("key", 1, 1))
    try:
        old = spark.read.parquet(path).join(new.select("prefix").distinct(), "prefix", "left_semi").join(new.select("key"), "key", "left_anti").select(*new.columns)
        new = new.unionByName(old)
        from ..plans.graph import stored

        new = stored(new, "autosave")
    except Exception as e:  # no table yet
        if "PATH_NOT_FOUND" not in str(e) and "does not exist" not in str(e):
            raise
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("prefix").parquet(path)


def load_autosave(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Point lookup: one partition is read."""
    return spark.read.parquet(path).where((F.col("prefix") == key[:1]) & (F.col("key") == key)).select("key", "document")


def delete_autosave(spark: SparkSession, path: str, key: str) -> None:
    from ..plans.graph import stored

    left = stored(spark.read.parquet(path).where((F.col("prefix") == key[:1]) & (F.col("key") != key)), "autosave")
    if left.limit(1).count():
        left.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("prefix").parquet(path)
    else:
        gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/prefix={key[:1]}")
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)


def dos_time(ts: Column) -> Column:
    """A timestamp as the 32-bit DOS date and time: years 1980 to 2107, two-second steps."""
    year = F.least(F.greatest(F.year(ts), F.lit(1980)), F.lit(2107)) - 1980
    date = F.shiftleft(year, 9).bitwiseOR(F.shiftleft(F.month(ts), 5)).bitwiseOR(F.dayofmonth(ts))
    time = F.shiftleft(F.hour(ts), 11).bitwiseOR(F.shiftleft(F.minute(ts), 5)).bitwiseOR(F.floor(F.second(ts) / 2).cast("int"))
    return date.cast("long") * 65536 + time


def zip_problems(entries: DataFrame) -> DataFrame:
    """Why entries (name, size) don't fit a plain archive: one row a problem."""
    twice = entries.groupBy("name").count().where("count > 1").select(F.concat(F.lit("duplicate name: "), "name").alias("problem"))
    bad = entries.where((F.col("name") == "") | F.col("name").isNull()).select(F.lit("empty name").alias("problem"))
    big = entries.where(F.col("size") > 0xFFFFFFFF).select(F.concat(F.lit("too large: "), "name").alias("problem"))
    many = entries.agg(F.count("*").alias("n")).where("n > 65535").select(F.lit("too many entries").alias("problem"))
    return twice.unionByName(bad).unionByName(big).unionByName(many)


def stored_zip(entries: Iterable[tuple[str, bytes]], when: dt.datetime) -> bytes:
    """An uncompressed archive of one bundle's entries; names are unique."""
    out, names = io.BytesIO(), set()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in entries:
            if not name or name in names:
                raise ValueError(f"entry name {name!r}")
            names.add(name)
            year = min(2107, max(1980, when.year))
            z.writestr(zipfile.ZipInfo(name, (year, when.month, when.day, when.hour, when.minute, when.second)), data)
    return out.getvalue()


def png(width: int, height: int, rgba: bytes) -> bytes:
    """An RGBA raster as PNG."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + rgba[y * width * 4 : (y + 1) * width * 4] for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def image_rows(px: DataFrame, rgba: str = "rgba") -> DataFrame:
    """(image_id, y, row): each row's colours (hex) as one string, the unit that image writers stream over."""
    g = px.groupBy("image_id", "y").agg(F.array_sort(F.collect_list(F.struct("x", rgba))).alias("r"))
    return g.select("image_id", "y", F.array_join(F.transform("r", lambda v: v[rgba]), "").alias("row"))


def write_pngs(px: DataFrame, path: str, rgba: str = "rgba") -> DataFrame:
    """A table (image_id, png) of each image's PNG, one image in a task at a time."""
    import pandas as pd

    kind = dict(px.dtypes)["image_id"]

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("y")
        data = bytes.fromhex("".join(rows["row"]))
        return pd.DataFrame({"image_id": [rows["image_id"].iloc[0]], "png": [png(len(rows["row"].iloc[0]) // 8, len(rows), data)]})

    out = image_rows(px, rgba).groupBy("image_id").applyInPandas(draw, f"image_id {kind}, png binary")
    out.write.mode("overwrite").parquet(path)
    return px.sparkSession.read.parquet(path)


def gray(value: Column) -> Column:
    """A byte as an opaque grey."""
    h = F.lower(F.lpad(F.hex(value), 2, "0"))
    return F.concat(h, h, h, F.lit("ff"))


def boundary_overlay(mask: Column, opacity: float = 0.9) -> Column:
    """Colour (rgba in hex) of a boundary pixel, clear elsewhere. mask: a condition."""
    return F.when(mask, f"{BOUNDARY_RGB}{int(opacity * 255 + 0.5):02x}").otherwise("00000000")


def diagnostic_report(**parts: DataFrame) -> DataFrame:
    """(report): one JSON document from small aggregates, each gathered under its name."""
    out = None
    for name, df in parts.items():
        part = df.agg(F.sort_array(F.collect_list(F.to_json(F.struct(*sorted(df.columns))))).alias(name))
        out = part if out is None else out.join(F.broadcast(part))
    doc = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{n}":['), F.concat_ws(",", F.col(n)), F.lit("]")) for n in parts]), F.lit("}"))
    return out.select(doc.alias("report"))
