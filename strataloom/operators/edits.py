"""Annotation editing as an event log: strokes make delta rows, the current state is the latest delta up to a cursor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pixel import clamp, js_round


#: Segments that one task draws.
SEGMENTS = 25_000


def stroke_points(segments: DataFrame) -> DataFrame:
    """segments (seq, layer, x0, y0, x1, y1) with their rasterised points (x, y, step), half again as dense as the longer side.

    Many segments are dealt out by seq, SEGMENTS to a task, before they are drawn: what counts points of a seq then needs no shuffle of points, and holds a task's alone.
    """
    far = F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0")))
    n = F.greatest(F.lit(1), F.ceil(far * 1.5).cast("int"))
    few = -(-segments.count() // SEGMENTS)
    s = (segments.repartition(few, "seq") if few > 1 else segments).withColumn("_n", n).withColumn("step", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    t = F.col("step") / F.col("_n")
    at = lambda a, b: js_round(F.col(a) + (F.col(b) - F.col(a)) * t).cast("int")
    return s.withColumns({"x": at("x0", "x1"), "y": at("y0", "y1")}).drop("_n", "x0", "y0", "x1", "y1")


def disk(points: DataFrame, radius: int) -> DataFrame:
    """Every point within a radius of the points, once for each seq."""
    span = [(dx, dy) for dx in range(-radius, radius + 1) for dy in range(-radius, radius + 1) if dx * dx + dy * dy <= radius * radius]
    off = F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in span])).alias("o")
    return points.select("*", off).withColumns({"x": F.col("x") + F.col("o.dx"), "y": F.col("y") + F.col("o.dy")}).drop("o", "step").distinct()


def stroke_deltas(segments: DataFrame, radius: int) -> DataFrame:
    """Painting: the stroke's points are set in its layer and cleared, as a disk of ``radius``, in the other; an erasing stroke clears a disk in its own."""
    pts = stroke_points(segments)
    paint = pts.where("NOT erase").select("seq", "layer", "x", "y", F.lit(1).alias("after")).distinct()
    wiped = disk(pts.where("NOT erase"), max(1, radius)).select("seq", F.when(F.col("layer") == "positive", "negative").otherwise("positive").alias("layer"), "x", "y", F.lit(0).alias("after"))
    erased = disk(pts.where("erase"), radius).select("seq", "layer", "x", "y", F.lit(0).alias("after"))
    return paint.unionByName(wiped).unionByName(erased).distinct()


def compact(changes: DataFrame) -> DataFrame:
    """changes (seq, layer, x, y, ord, before, after) as one delta a pixel and seq: first before, last after, without what ends as it was."""
    g = changes.groupBy("seq", "layer", "x", "y").agg(F.min_by("before", "ord").alias("before"), F.max_by("after", "ord").alias("after"))
    return g.where("before <> after")


def bounds(deltas: DataFrame, *also: str) -> DataFrame:
    """The dirty rectangle of each seq and layer, and of other columns."""
    return deltas.groupBy(*also, "seq", "layer").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count("*").alias("changed"))


def replay(deltas: DataFrame, cursor: int | None = None) -> DataFrame:
    """Set pixels (layer, x, y) after all deltas with seq up to the cursor: undo and redo only move it."""
    d = deltas if cursor is None else deltas.where(F.col("seq") <= cursor)
    return d.groupBy("layer", "x", "y").agg(F.max_by("after", "seq").alias("v")).where("v = 1").select("layer", "x", "y")


def replays(deltas: DataFrame, cursors: list[int]) -> DataFrame:
    """(cursor, layer, x, y): replay() at several cursors, from one pass over the log."""
    at = lambda c: F.max_by("after", F.when(F.col("seq") <= c, F.col("seq")))
    g = deltas.groupBy("layer", "x", "y").agg(F.array(*[F.struct(F.lit(c).cast("long").alias("cursor"), at(c).alias("v")) for c in cursors]).alias("s"))
    return g.select("layer", "x", "y", F.explode("s").alias("s")).where("s.v = 1").select("s.cursor", "layer", "x", "y")


def clear_all(state: DataFrame, seq: int) -> DataFrame:
    """The deltas that empty all layers of a state (layer, x, y) at once; an empty layer has none."""
    return state.select(F.lit(seq).cast("long").alias("seq"), "layer", "x", "y", F.lit(1).alias("before"), F.lit(0).alias("after"))


def cursor_after(commands: DataFrame) -> DataFrame:
    """Per session, the state of the two stacks after its commands (session, ord, command, seq): edit, undo, redo.

    A new edit drops what was undone. Folded over each session's commands in order; a session is one person's clicks.
    """
    g = commands.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("ord", "command", "seq"))).alias("c"))
    empty = F.struct(F.array().cast("array<bigint>").alias("done"), F.array().cast("array<bigint>").alias("undone"))

    def step(acc, v):
        edit, undo, redo = (v["command"] == k for k in ("edit", "undo", "redo"))
        can_undo, can_redo = undo & (F.size(acc["done"]) > 0), redo & (F.size(acc["undone"]) > 0)
        front = lambda a: F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))
        last = lambda a: F.slice(a, F.greatest(F.size(a), F.lit(1)), 1)
        done = F.when(edit, F.concat(acc["done"], F.array(v["seq"]))).when(can_undo, front(acc["done"])).when(can_redo, F.concat(acc["done"], last(acc["undone"]))).otherwise(acc["done"])
        undone = F.when(edit, F.array().cast("array<bigint>")).when(can_undo, F.concat(acc["undone"], last(acc["done"]))).when(can_redo, front(acc["undone"])).otherwise(acc["undone"])
        return F.struct(done.alias("done"), undone.alias("undone"))

    return g.select("session", F.aggregate("c", empty, step).alias("s")).select("session", "s.done", "s.undone")


def moved_rect(mode: Column, dx: Column, dy: Column, width: int, height: int) -> dict[str, Column]:
    """A rectangle (x0, y0, x1, y1) after dragging it or one of its handles: sides swap if they cross, all stay inside."""
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    w, h = x1 - x0, y1 - y0
    mx, my = F.least(F.greatest(x0 + dx, F.lit(0)), F.lit(width - 1) - w), F.least(F.greatest(y0 + dy, F.lit(0)), F.lit(height - 1) - h)
    a, b = F.when(mode.isin("w", "nw", "sw"), x0 + dx).otherwise(x0), F.when(mode.isin("e", "ne", "se"), x1 + dx).otherwise(x1)
    c, d = F.when(mode.isin("n", "nw", "ne"), y0 + dy).otherwise(y0), F.when(mode.isin("s", "sw", "se"), y1 + dy).otherwise(y1)
    move = mode == "move"
    return {"x0": F.when(move, mx).otherwise(clamp(F.least(a, b), 0, width - 1)), "y0": F.when(move, my).otherwise(clamp(F.least(c, d), 0, height - 1)), "x1": F.when(move, mx + w).otherwise(clamp(F.greatest(a, b), 0, width - 1)), "y1": F.when(move, my + h).otherwise(clamp(F.greatest(c, d), 0, height - 1))}


def history_tail(history: DataFrame, n: int, by: list[str], group: list[str] | None = None) -> DataFrame:
    """The newest ``n`` rows, newest first: a top-k, of each group where one is given."""
    order = [F.desc(c) for c in by]
    if not group:
        return history.orderBy(*order).limit(n)
    return history.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_r") <= n).drop("_r")
