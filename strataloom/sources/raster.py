"""Rasters as pixel relations (image_id, y, x, r, g, b), from tables and from bitmap files."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

KEY = ["image_id", "y", "x"]


def _above(c: Column, cuts: list, lo: int = 0) -> Column:
    """How many of the sorted cuts lie below a value, by halving."""
    if not cuts:
        return F.lit(lo)
    mid = len(cuts) // 2
    return F.when(c <= cuts[mid], _above(c, cuts[:mid], lo)).otherwise(_above(c, cuts[mid + 1 :], lo + mid + 1))


def numbered(df: DataFrame, group: str, order: str, out: str, rows_per_part: int = 250_000, most_parts: int = 512) -> DataFrame:
    """df with the rank of each row in its group from 0, by an order without ties in a group (nulls first).

    Ranges of the order, cut at its quantiles, are numbered on their own and set off by the counts of earlier ones, so that the largest
    sort has a range's rows of one group and not the group; what is counted is a row for each group and range.
    """
    parts = min(most_parts, -(-df.count() // rows_per_part))
    cuts = []
    if parts > 1:
        cuts = sorted({c for c in df.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 100 * parts)).first()[0] if c is not None})
    df = df.withColumn("_part", _above(F.col(order), cuts) if cuts else F.lit(0))
    place = F.row_number().over(Window.partitionBy(group, "_part").orderBy(order)) - 1
    if not cuts:
        return df.withColumn(out, place).drop("_part")
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(group, "_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    counts = counts.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), "_before")
    met = df.withColumn("_place", place).join(F.broadcast(counts), F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return met.withColumn(out, (F.col("_place") + F.col("_before")).cast("int")).drop("_part", "_p", "_g", "_place", "_before")


def from_embeddings(embeddings: DataFrame, width: int = 64) -> DataFrame:
    """One image for each label: a vector is a row of pixels, green and blue are the vector turned by a third."""
    level = F.transform("embedding", lambda v: F.floor(F.least(F.greatest((v.cast("double") + 0.5) * 255, F.lit(0.0)), F.lit(255.0))).cast("int"))
    rows = numbered(embeddings.select("label", "vec_id", level.alias("v")), "label", "vec_id", "y").select(F.col("label").alias("image_id"), "y", "v")
    at = lambda shift: F.get("v", (F.col("x") + shift) % width)
    return rows.select("image_id", "y", "v", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x")).select("image_id", "y", "x", at(0).alias("r"), at(width // 3).alias("g"), at(2 * width // 3).alias("b"))


def from_lineitem(lineitem: DataFrame, width: int = 128, height: int = 96) -> DataFrame:
    """One image for each return flag: parts and suppliers are dealt to pixels, whose colours are means of the figures."""
    return (
        lineitem.groupBy(F.col("l_returnflag").alias("image_id"), (F.col("l_suppkey") % height).cast("int").alias("y"), (F.col("l_partkey") % width).cast("int").alias("x"))
        .agg(F.floor(F.avg("l_quantity") * 5).cast("int").alias("r"), F.floor(F.avg("l_discount") * 2550).cast("int").alias("g"), F.floor(F.avg("l_tax") * 3000).cast("int").alias("b"))
    )


def with_size(px: DataFrame) -> DataFrame:
    """Pixels with their image's width and height; the sizes are one row an image."""
    size = px.groupBy("image_id").agg((F.max("x") + 1).cast("int").alias("w"), (F.max("y") + 1).cast("int").alias("h"))
    return px.join(F.broadcast(size), "image_id")


def preview_size(width: int, height: int, max_width: int = 1800, max_height: int = 1400) -> tuple[int, int]:
    scale = min(1.0, max_width / width, max_height / height)
    half_up = lambda v: int(v + 0.5)
    return max(1, half_up(width * scale)), max(1, half_up(height * scale))


def sampled(px: DataFrame, width: int, height: int, to_width: int, to_height: int) -> DataFrame:
    """The preview's pixels: each takes the source pixel nearest its centre. An equi-join on the few coordinates needed."""
    spark = px.sparkSession

    def axis(n: int, to: int, name: str) -> DataFrame:
        return spark.range(to).select(F.least(F.lit(n - 1), F.floor((F.col("id") + 0.5) * n / to)).cast("int").alias(name), F.col("id").cast("int").alias(f"t{name}"))

    return px.join(axis(width, to_width, "x"), "x").join(axis(height, to_height, "y"), "y").select("image_id", F.col("ty").alias("y"), F.col("tx").alias("x"), "r", "g", "b")


class BmpError(ValueError):
    """A file that is no uncompressed 24- or 32-bit bitmap."""


def parse_header(head: bytes, size: int) -> dict[str, object]:
    """The header's fields, checked."""
    if len(head) < 54:
        raise BmpError("too short for a header")
    if head[:2] != b"BM":
        raise BmpError("not a BM file")
    declared, offset = struct.unpack_from("<I4xI", head, 2)
    dib, width, signed_height, planes, depth, compression = struct.unpack_from("<IiiHHI", head, 14)
    if dib < 40 or planes != 1 or width <= 0 or signed_height == 0:
        raise BmpError("unsupported header")
    if depth not in (24, 32):
        raise BmpError(f"{depth} bits a pixel")
    if compression != 0:
        raise BmpError(f"compression {compression}")
    height, stride = abs(signed_height), (depth * width + 31) // 32 * 4
    if offset + stride * height > size:
        raise BmpError("truncated pixels")
    return {"width": width, "height": height, "signedHeight": signed_height, "topDown": signed_height < 0, "bitDepth": depth, "bytesPerPixel": depth // 8, "compression": compression, "compressionName": "BI_RGB", "pixelOffset": offset, "rowStride": stride, "dibSize": dib, "declaredFileSize": declared, "actualFileSize": size, "expectedPixelBytes": stride * height}


HEADER_SCHEMA = "path string, width int, height int, signedHeight int, topDown boolean, bitDepth int, bytesPerPixel int, compression long, compressionName string, pixelOffset long, rowStride long, dibSize long, declaredFileSize long, actualFileSize long, expectedPixelBytes long, error string"


class Ranges:
    """Byte ranges of one file, wherever it lies: local paths and the schemes that Arrow's file systems know (file, s3, gs, abfs, hdfs). Counts what it reads."""

    def __init__(self, path: str) -> None:
        from pyarrow import fs

        scheme, _, rest = path.partition(":")
        if scheme == "file" or "/" in scheme or not rest:
            where, at = fs.LocalFileSystem(), "/" + rest.lstrip("/") if scheme == "file" else path
        else:
            where, at = fs.FileSystem.from_uri(path)
        self.file = where.open_input_file(at)
        self.size = self.file.size()
        self.bytes_read = 0

    def __enter__(self) -> Ranges:
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()

    def read(self, start: int, n: int) -> bytes:
        data = self.file.read_at(max(0, min(n, self.size - start)), start)
        self.bytes_read += len(data)
        return data


def fingerprint_ranges(size: int, part: int = 65536) -> list[tuple[int, int]]:
    """(start, bytes) of the first, middle and last part of a file."""
    return [(0, min(size, part)), (max(0, size // 2 - part // 2), min(part, size)), (max(0, size - part), min(size, part))]


def bitmaps(spark: SparkSession, path: str, fingerprint: bool = False, part: int = 65536) -> DataFrame:
    """A row of HEADER_SCHEMA for each *.bmp file, with ``fingerprint`` (null unless asked for) and the ``bytes_read`` for it.

    Files are listed by Spark, which opens none; a header takes 256 bytes of a file, a fingerprint three ranges more, whatever the file's size.
    """
    import pandas as pd

    names = [c.split()[0] for c in HEADER_SCHEMA.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, length in zip(b["path"], b["length"], strict=True):
                row = {"path": p, "actualFileSize": int(length), "error": None, "fingerprint": None}
                with Ranges(p) as f:
                    try:
                        row |= parse_header(f.read(0, 256), f.size)
                        if fingerprint:
                            meta = "|".join(str(row[c]) for c in ("actualFileSize", "width", "height", "bitDepth"))
                            row["fingerprint"] = hashlib.sha256(meta.encode() + b"".join(f.read(*r) for r in fingerprint_ranges(f.size, part))).hexdigest()
                    except BmpError as e:
                        row["error"] = str(e)
                    rows.append(row | {"bytes_read": f.bytes_read})
            yield pd.DataFrame(rows, columns=[*names, "fingerprint", "bytes_read"]).astype(object).where(lambda d: d.notna(), None)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bmp").load(path)
    return files.select("path", "length").mapInPandas(parse, HEADER_SCHEMA + ", fingerprint string, bytes_read long")


def bmp_headers(spark: SparkSession, path: str) -> DataFrame:
    """A row of HEADER_SCHEMA for each *.bmp file; ``error`` says why a file can't be read (null if it can)."""
    return bitmaps(spark, path).drop("fingerprint", "bytes_read")


def fingerprints(spark: SparkSession, path: str, part: int = 65536) -> DataFrame:
    """(path, fingerprint): SHA-256 over ``size|width|height|bits`` and the first, middle and last 64 KiB of each bitmap; null where the header is none."""
    return bitmaps(spark, path, True, part).select("path", "fingerprint")


class _Rows(InputPartition):
    def __init__(self, path: str, first: int, last: int) -> None:
        self.path, self.first, self.last = path, first, last


class _BmpReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.paths = [p for p in options["path"].split(",") if p]
        self.max = int(options.get("maxWidth", 1800)), int(options.get("maxHeight", 1400))
        self.rows = int(options.get("rowsPerPartition", 256))

    def partitions(self) -> list[_Rows]:
        out = []
        for p in self.paths:
            with Ranges(p) as f:
                h = parse_header(f.read(0, 256), f.size)
            _, th = preview_size(h["width"], h["height"], *self.max)
            out += [_Rows(p, a, min(th, a + self.rows)) for a in range(0, th, self.rows)]
        return out

    def read(self, partition: _Rows) -> Iterator[object]:
        import numpy as np
        import pyarrow as pa

        with Ranges(partition.path) as f:
            h = parse_header(f.read(0, 256), f.size)
            w, height, n = h["width"], h["height"], h["bytesPerPixel"]
            tw, th = preview_size(w, height, *self.max)
            xs = np.minimum(w - 1, ((np.arange(tw) + 0.5) * w / tw).astype(int))
            for ty in range(partition.first, partition.last):
                y = min(height - 1, int((ty + 0.5) * height / th))
                row = f.read(h["pixelOffset"] + (y if h["topDown"] else height - 1 - y) * h["rowStride"], w * n)
                b, g, r = np.frombuffer(row, np.uint8).reshape(w, n)[xs, :3].astype(np.int32).T
                columns = [pa.array([partition.path] * tw), pa.array(np.full(tw, ty, np.int32)), pa.array(np.arange(tw, dtype=np.int32)), pa.array(r), pa.array(g), pa.array(b)]
                yield pa.RecordBatch.from_arrays(columns, names=["image_id", "y", "x", "r", "g", "b"])


class BmpSource(DataSource):
    """``spark.read.format("bmp_preview")``: a bitmap's preview, of which only the sampled rows are read, in parallel by row ranges."""

    @classmethod
    def name(cls) -> str:
        return "bmp_preview"

    def schema(self) -> str:
        return "image_id string, y int, x int, r int, g int, b int"

    def reader(self, schema: object) -> DataSourceReader:
        return _BmpReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BmpSource)


def fingerprint_of(content: Column, length: Column, part: int = 65536, meta: Column | None = None) -> Column:
    """SHA-256 of a description (the length unless given) and three parts of a binary or string."""
    middle = F.greatest(F.lit(0), F.floor(length / 2) - part // 2)
    last = F.greatest(F.lit(0), length - part)
    head = (meta if meta is not None else length).cast("string")
    parts = [content.substr((a + 1).cast("int"), F.lit(part)).cast("binary") for a in (F.lit(0), middle, last)]
    return F.sha2(F.concat(head.cast("binary"), *parts), 256)
