"""Connected components of masks by two levels: runs of each tile are labelled there, then labels are united along the tiles' borders.

A tile of 256 pixels is one Arrow group whatever the image's size. What leaves it are its runs with the label of their part; parts
that touch across a seam between tiles are edges, found by equi-joins on the seam's pixels and united in distributed rounds. No group
holds an image, a row of it, or all its labels.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pixel import edge_bits
from ..plans.graph import dealt, min_labels, shuffled, stored
from ..plans.tiles import TILE


def _roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least node of each of n nodes' component under the edges u-v."""
    root = np.arange(n)
    while True:
        ru, rv = root[u], root[v]
        apart = ru != rv
        if not apart.any():
            return root
        u, v = u[apart], v[apart]
        np.minimum.at(root, np.maximum(ru, rv)[apart], np.minimum(ru, rv)[apart])
        while not (root[root] == root).all():
            root = root[root]


def tile_runs(y: np.ndarray, x: np.ndarray, connectivity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(y, a, b, root) of the runs of set pixels; root is the index of the first run of the part. 8 counts corners, 4 doesn't."""
    order = np.lexsort((x, y))
    y, x = y[order].astype(np.int64), x[order].astype(np.int64)
    first = np.ones(len(y), bool)
    first[1:] = (y[1:] != y[:-1]) | (x[1:] != x[:-1] + 1)
    last = np.append(first[1:], True)
    y, a, b = y[first], x[first], x[last]
    slack, low = int(connectivity == 8), a.min(initial=0)
    wide = int(b.max(initial=0) - low) + 4
    place = lambda row, col: row * wide + (col - low + 1)  # noqa: E731  one number for a row and column, with room for the slack at both ends
    begin = np.searchsorted(place(y, b), place(y - 1, a - slack), "left")
    end = np.searchsorted(place(y, a), place(y - 1, b + slack), "right")
    many = np.maximum(0, end - begin)
    here = np.repeat(np.arange(len(y)), many)
    above = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin, many)
    return y, a, b, _roots(len(y), here, above)


def parts(px: DataFrame, on: Column, connectivity: int, tile: int = TILE) -> DataFrame:
    """(image_id, y, a, b, run, part): the runs of each tile where ``on`` holds; ``part`` is the first run of what touches within the tile. With w and h where px has them."""
    size = [c for c in ("w", "h") if c in px.columns]
    kinds = dict(px.dtypes)
    cell = lambda c: F.floor(F.col(c) / tile).cast("int")
    at = px.where(on).select("image_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *size, cell("y").alias("ty"), cell("x").alias("tx"))

    def label(rows: pd.DataFrame) -> pd.DataFrame:
        y, a, b, root = tile_runs(rows["y"].to_numpy(), rows["x"].to_numpy(), connectivity)
        run = (y << 32) | a
        out = pd.DataFrame({"image_id": [rows["image_id"].iloc[0]] * len(y), "y": y.astype(np.int32), "a": a.astype(np.int32), "b": b.astype(np.int32), "run": run, "part": run[root]})
        for c in size:
            out[c] = rows[c].iloc[0]
        return out

    schema = f"image_id {kinds['image_id']}, y int, a int, b int, run long, part long" + "".join(f", {c} {kinds[c]}" for c in size)
    return dealt(at, "image_id", "ty", "tx").groupBy("image_id", "ty", "tx").applyInPandas(label, schema)


def seams(r: DataFrame, connectivity: int, tile: int = TILE) -> DataFrame:
    """(image_id, a, b): parts that touch across the border of two tiles, each pair once for each tile row or column it touches in."""
    reach = [-1, 0, 1] if connectivity == 8 else [0]
    near = F.explode(F.array(*[F.lit(i) for i in reach]))
    # across a vertical border: the last pixel of a run that ends there, and the first one of a run that begins behind it
    left = r.where(F.col("b") % tile == tile - 1).select("image_id", (F.col("b") + 1).alias("x"), near.alias("_d"), "y", F.col("part").alias("p")).withColumn("y", F.col("y") + F.col("_d")).drop("_d")
    right = r.where((F.col("a") % tile == 0) & (F.col("a") > 0)).select("image_id", F.col("a").alias("x"), "y", F.col("part").alias("q"))
    # across a horizontal one: the pixels of the runs in the row above and below it
    upper = r.where(F.col("y") % tile == tile - 1).select("image_id", (F.col("y") + 1).alias("y"), F.explode(F.sequence(F.col("a") + min(reach), F.col("b") + max(reach))).alias("x"), F.col("part").alias("p"))
    lower = r.where((F.col("y") % tile == 0) & (F.col("y") > 0)).select("image_id", "y", F.explode(F.sequence("a", "b")).alias("x"), F.col("part").alias("q"))
    met = left.join(right.hint("merge"), ["image_id", "y", "x"]).select("image_id", "p", "q").unionByName(upper.join(lower.hint("merge"), ["image_id", "y", "x"]).select("image_id", "p", "q"))
    return met.select("image_id", F.col("p").alias("a"), F.col("q").alias("b")).distinct()


def labelled_runs(px: DataFrame, on: Column, connectivity: int = 8, tile: int = TILE) -> DataFrame:
    """Runs (image_id, y, a, b, run) with ``root``, the first run of their component; runs end at tile borders. Images of one tile have no seams."""
    r = stored(parts(px, on, connectivity, tile), "parts")
    far = r.agg(F.max(F.greatest("y", "b"))).first()[0]
    if far is None or far < tile:
        return r.withColumnRenamed("part", "root")
    roots = min_labels(seams(r, connectivity, tile)).select("image_id", F.col("node").alias("part"), "root")
    return r.join(roots, ["image_id", "part"], "left").withColumn("root", F.coalesce("root", "part")).drop("part")


def pixels_of(r: DataFrame, *columns: str) -> DataFrame:
    """(image_id, y, x, columns) of runs: labels go back to pixels without a join."""
    return r.select("image_id", "y", F.explode(F.sequence("a", "b")).alias("x"), *columns)


def runs_at(points: DataFrame, r: DataFrame, also: tuple[str, ...] = (), tile: int = TILE) -> DataFrame:
    """points (image_id, also, y, x) with ``root`` of the run they lie in; others are dropped. An equi-join, as runs end at tile borders."""
    own = r.select("image_id", *also, "y", "a", "b", "root", F.floor(F.col("a") / tile).alias("_tx"))
    met = points.withColumn("_tx", F.floor(F.col("x") / tile)).join(shuffled(own, "image_id", *also, "y", "_tx"), ["image_id", *also, "y", "_tx"])
    return met.where((F.col("a") <= F.col("x")) & (F.col("b") >= F.col("x"))).drop("a", "b", "_tx")


def layered_runs(px: DataFrame, layer: str, connectivity: int = 4) -> DataFrame:
    """labelled_runs() of the pixels of several layers of each image at once. px (image_id, layer, y, x, w, h); the runs keep ``layer``."""
    kinds = dict(px.dtypes)
    keyed = px.select(F.concat_ws(":", layer, "image_id").alias("image_id"), "y", "x", "w", "h")
    r = labelled_runs(keyed, F.lit(True), connectivity)
    rest = F.expr("substr(image_id, instr(image_id, ':') + 1)").cast(kinds["image_id"])
    return r.select(rest.alias("image_id"), F.split_part("image_id", F.lit(":"), F.lit(1)).cast(kinds[layer]).alias(layer), "y", "a", "b", "root", "w", "h")


def label_pixels(px: DataFrame, on: Column, connectivity: int = 8) -> DataFrame:
    """Pixels where ``on`` holds with ``root``; px's other columns are kept."""
    own = pixels_of(labelled_runs(px, on, connectivity), "root")
    rest = [c for c in px.columns if c not in ("image_id", "y", "x")]
    return px.join(shuffled(own, "image_id", "y", "x"), ["image_id", "y", "x"]).select("image_id", "y", "x", *rest, "root") if rest else own


def sizes(px: DataFrame, on: Column, connectivity: int = 8) -> DataFrame:
    """(image_id, root, size) straight from the runs."""
    return labelled_runs(px, on, connectivity).groupBy("image_id", "root").agg(F.sum(F.col("b") - F.col("a") + 1).alias("size"))


def numbered(components: DataFrame, band: int = 256) -> DataFrame:
    """Components with dense labels from 1 in raster order of their first pixel: counted by bands of rows first, so no task numbers a whole image."""
    c = components.withColumn("_band", F.floor(F.shiftright("root", 32) / band))
    before = F.sum("_many").over(Window.partitionBy("image_id").orderBy("_band").rowsBetween(Window.unboundedPreceding, -1))
    bands = c.groupBy("image_id", "_band").agg(F.count("*").alias("_many")).withColumn("_before", F.coalesce(before, F.lit(0))).drop("_many")
    nth = F.row_number().over(Window.partitionBy("image_id", "_band").orderBy("root"))
    return c.withColumn("_nth", nth).join(F.broadcast(bands), ["image_id", "_band"]).withColumn("label", (F.col("_nth") + F.col("_before")).cast("int")).drop("_band", "_nth", "_before")


def index_of(r: DataFrame, *also: str) -> DataFrame:
    """(image_id, also, root, size, edge_mask, first_p) of labelled runs with w and h."""
    edges = F.when(F.col("a") == 0, 1).otherwise(0) + F.when(F.col("y") == 0, 2).otherwise(0) + F.when(F.col("b") == F.col("w") - 1, 4).otherwise(0) + F.when(F.col("y") == F.col("h") - 1, 8).otherwise(0)
    return r.groupBy("image_id", *also, "root").agg(F.sum(F.col("b") - F.col("a") + 1).alias("size"), F.bit_or(edges).alias("edge_mask"), F.min(F.col("y") * F.col("w") + F.col("a")).cast("long").alias("first_p"))


def component_index(px: DataFrame, on: Column, min_pixels: int = 1, connectivity: int = 4) -> DataFrame:
    """(image_id, root, size, edge_mask, first_p, active, label), from the runs alone. Needs w and h."""
    return numbered(index_of(labelled_runs(px, on, connectivity)).withColumn("active", F.col("size") >= min_pixels))


def labels_and_index(px: DataFrame, on: Column, connectivity: int = 4, extra: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Labelled pixels (key, root, extra columns) and (image_id, root, size, edge_mask), from one stored pass. Needs w and h."""
    r = stored(labelled_runs(px.select("image_id", "y", "x", "w", "h", on.alias("_on"), *extra), F.col("_on"), connectivity), "labels")
    lab = pixels_of(r, "root")
    if extra:
        lab = stored(px.select("image_id", "y", "x", *extra).join(shuffled(lab, "image_id", "y", "x"), ["image_id", "y", "x"]), "labelled")
    return lab, index_of(r).drop("first_p")


def sized_runs(px: DataFrame, on: Column, connectivity: int = 8) -> DataFrame:
    """Labelled runs with the ``size`` of their component."""
    r = stored(labelled_runs(px, on, connectivity), "labels")
    return r.join(shuffled(r.groupBy("image_id", "root").agg(F.sum(F.col("b") - F.col("a") + 1).alias("size")), "image_id", "root"), ["image_id", "root"])


def min_component(px: DataFrame, mask: str, out: str, least: int) -> DataFrame:
    """Keep supported pixels whose 8-connected component has ``least`` pixels; 1 or less skips the components."""
    from .windows import supported

    df = supported(px, mask, "_sup")
    if least <= 1:
        return df.withColumn(out, F.col("_sup")).drop("_sup")
    df = stored(df, "support")
    kept = pixels_of(sized_runs(df.select("image_id", "y", "x", "_sup"), F.col("_sup") == 1).where(F.col("size") >= least)).withColumn(out, F.lit(1))
    return df.join(shuffled(kept, "image_id", "y", "x"), ["image_id", "y", "x"], "left").withColumn(out, F.coalesce(out, F.lit(0))).drop("_sup")


def hotspots(df: DataFrame, kinds: list[str], features: list[str], per_kind: int = 16, limit: int = 24) -> DataFrame:
    """The largest 8-connected blobs of each error mask, with bounds and mean features as shares of 255: a top-k report."""
    out = None
    for k in kinds:
        lab = label_pixels(df, F.col(k) == 1, 8)
        g = lab.groupBy("image_id", "root").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count("*").alias("pixels"), *[(F.avg(f) / 255).alias(f) for f in features]).withColumn("kind", F.lit(k))
        out = g if out is None else out.unionByName(g)
    best = F.row_number().over(Window.partitionBy("image_id", "kind").orderBy(F.desc("pixels"), "root"))
    top = out.withColumn("_r", best).where(F.col("_r") <= per_kind)
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("pixels"), "kind", "root"))
    return top.withColumn("rank", rank).where(F.col("rank") <= limit).drop("_r", "root")


def closed_regions(px: DataFrame, safety: int) -> tuple[DataFrame, DataFrame]:
    """The labelled runs of what isn't reference, stored, and region_index() of them. Needs ref, w and h."""
    r = stored(labelled_runs(px, F.col("ref") == 0, 4), "regions")
    return r, stored(region_index(px, safety, r), "region-index")


def region_index(px: DataFrame, safety: int, r: DataFrame | None = None) -> DataFrame:
    """Closed-region index of what isn't reference: component_index() with edge pixels, reference contacts (by adjacency) and safe pixels. Needs ref, w and h."""
    from .windows import along_x, down_columns

    r = labelled_runs(px, F.col("ref") == 0, 4) if r is None else r
    reach = max(0, safety)
    df = px.select("image_id", "y", "x", "w", "h", F.col("ref").cast("int").alias("ref"))
    df = dealt(df, "image_id", "y").withColumns({"_row": F.max("ref").over(along_x(-reach, reach)), "_nx": F.sum("ref").over(along_x(-1, 1))})
    # of pixels that are no reference themselves, the sums along both axes are their contacts
    df = down_columns(df, {"_safe": ("_row", reach, F.max), "_ny": ("ref", 1, F.sum)}).withColumns({"_touch": F.col("_nx") + F.col("_ny"), "_e": edge_bits(F.col("w"), F.col("h"))})
    lab = df.where("ref = 0").join(shuffled(pixels_of(r, "root"), "image_id", "y", "x"), ["image_id", "y", "x"])
    c = lab.groupBy("image_id", "root").agg(F.count("*").alias("size"), F.bit_or("_e").alias("edge_mask"), F.count_if(F.col("_e") > 0).alias("edge_pixels"), F.sum("_touch").alias("contacts"), F.count_if(F.col("_safe") == 0).alias("safe_size"))
    return numbered(c)
