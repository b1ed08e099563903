"""Merkle manifest of a dataset: nested-interval labels.

Every row is a leaf; the leaves of a group (here a language) have ranks by their order, and every node of the group's tree
carries the half-open interval of leaf ranks that it covers. ``fanout`` consecutive nodes become their parent, until one
is left: the group's subroot. The subroots, ordered by group, are the leaves of one more tree of the same kind, whose top is the
root. A proof is what a verifier needs to fold a leaf up to the root: the siblings at each level.

* Ranks. Rows are range-partitioned and sorted by (group, order, digest); a row's place in its partition, less where its group
  begins there, plus what earlier partitions hold of its group, is its rank. No window sees more than counts of partitions.
* Ancestors. Levels are tables bucketed by (group, start of the interval of the level's width). From the top down, a level's nodes are joined
  with the level above where bucket and containment of the intervals agree. A parent has at most ``fanout`` children, so no join key is hot,
  whatever a group's size; the leaves themselves aren't joined at all: they travel inside their first parent.
* Siblings. A parent knows its children's intervals; those in the difference of its interval and the child's are the siblings,
  parted into what lies before and behind.

What is shuffled: each row's digest and key twice (ranges, first parents), then an eighth of that for each level and each first
parent's siblings. Texts are hashed where they are read. Each level is a stored table.

Defined cases: null fields are hashed as ``-``; a null group is a group of its own, before all others; null order values come first; ties
of the order are ordered by digest, so that equal rows may change places and nothing else changes. Empty and very long texts are
hashed whole. Columns that aren't named are left out, whatever they are called. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import store

FANOUT = 8
STEP = "array<struct<before: binary, behind: binary>>"
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def field(c: Column) -> Column:
    """``-`` for null, else the value's UTF-8 bytes counted, ``:`` and the value."""
    value = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(*fields: Column | str) -> Column:
    """Digest of a row: 32 bytes."""
    return F.unhex(F.sha2(F.concat(*(field(F.col(c) if isinstance(c, str) else c) for c in fields)).cast("binary"), 256))


def text_of(digest: Column) -> Column:
    """Digests as the hex text that nodes and proofs are made of."""
    return F.lower(F.hex(digest))


def _node(digests: Column) -> Column:
    return F.unhex(F.sha2(F.array_join(F.transform(digests, text_of), "").cast("binary"), 256))


def _joined(digests: Column) -> Column:
    return F.aggregate(digests, F.lit(b""), lambda a, x: F.concat(a, x))


def _start(rank: str, width: int) -> Column:
    """Where the interval of ``width`` ranks begins that a rank lies in."""
    return F.col(rank) - F.col(rank) % width


def _step(kids: Column, lo: Column, hi: Column) -> Column:
    """The siblings of the child [lo, hi): the difference of the parent's interval and its own."""
    before = F.filter(kids, lambda k: k["hi"] <= lo)
    behind = F.filter(kids, lambda k: k["lo"] >= hi)
    return F.struct(_joined(F.transform(before, lambda k: k["digest"])).alias("before"), _joined(F.transform(behind, lambda k: k["digest"])).alias("behind"))


def ranked(items: DataFrame) -> tuple[DataFrame, int]:
    """items (grp, ord, digest, own) with their rank in the group and the group's size ``n``; the largest group's size."""
    order = ["grp", "ord", "digest"]
    rows, _ = store(items.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "merkle-rows")
    part = F.shiftright("at", 33)
    held, _ = store(rows.groupBy("grp", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("held")), "merkle-counts")
    each = Window.partitionBy("grp")
    earlier = each.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select("grp", "part", (F.col("first") - F.coalesce(F.sum("held").over(earlier), F.lit(0))).alias("base"), F.sum("held").over(each).alias("n"))
    most = held.groupBy("grp").agg(F.sum("held").alias("n")).agg(F.max("n")).first()[0] or 0
    return rows.withColumn("part", part).join(starts, ["grp", "part"]).select("grp", "ord", "digest", "own", (F.col("at") - F.col("base")).alias("rank"), "n"), most


def levels(rows: DataFrame, most: int, fanout: int = FANOUT) -> list[DataFrame]:
    """Stored tables of the parents, level by level: (grp, n, lo, hi, kids, digest).

    The first level's kids also hold ``ord`` and ``own``. A group of one leaf has one node there, which is the leaf itself.
    """
    kid = F.struct(F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "digest", "ord", "own")
    now = rows.select("grp", "n", _start("rank", fanout).alias("bucket"), kid.alias("kid"))
    out, width = [], fanout
    while True:
        made = now.groupBy("grp", "bucket").agg(F.max("n").alias("n"), F.array_sort(F.collect_list("kid"), lambda a, b: F.when(a["lo"] < b["lo"], -1).otherwise(1)).alias("kids"))
        digests = F.transform("kids", lambda k: k["digest"])
        digest = F.when(F.col("n") == 1, F.get(digests, F.lit(0))).otherwise(_node(digests))
        out.append(store(made.select("grp", "n", F.get("kids", F.lit(0))["lo"].alias("lo"), F.element_at("kids", -1)["hi"].alias("hi"), "kids", digest.alias("digest")), "merkle-level")[0])
        if width >= most:
            return out
        width *= fanout
        kid = F.struct("lo", "hi", "digest")
        now = out[-1].where(F.col("hi") - F.col("lo") < F.col("n")).select("grp", "n", _start("lo", width).alias("bucket"), kid.alias("kid"))


def _tops(tables: list[DataFrame]) -> DataFrame:
    """(grp, subroot): the one node of each group that covers all its ranks."""
    out = None
    for t in tables:
        top = t.where((F.col("lo") == 0) & (F.col("hi") == F.col("n"))).select("grp", F.col("digest").alias("subroot"))
        out = top if out is None else out.unionByName(top)
    return out


def _proofs(tables: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """The first parents with ``path``, the steps from them to the root; tops (grp, subroot, root, path) says how it goes on at each group's top."""
    above = None
    for level in range(len(tables), 0, -1):
        t, width = tables[level - 1], fanout ** (level + 1)
        whole = F.col("hi") - F.col("lo") == F.col("n")
        here = t.where(whole).join(tops, "grp").select("grp", "lo", "hi", "n", "kids", "subroot", "root", "path")
        if above is not None:
            up = above.select("grp", _start("lo", width).alias("bucket"), F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"), F.col("kids").alias("p_kids"), "subroot", "root", F.col("path").alias("p_path"))
            under = t.where(~whole).withColumn("bucket", _start("lo", width)).join(up, ["grp", "bucket"]).where((F.col("p_lo") <= F.col("lo")) & (F.col("hi") <= F.col("p_hi")))
            path = F.concat(F.array(_step(F.col("p_kids"), F.col("lo"), F.col("hi"))), "p_path")
            here = here.unionByName(under.select("grp", "lo", "hi", "n", "kids", "subroot", "root", path.alias("path")))
        above = here
    return above


def manifest(docs: DataFrame, digest: Column | None = None, group: str = "lang", order: str = "doc_id", own: dict[str, Column] | None = None, fanout: int = FANOUT) -> DataFrame:
    """(group, order, rank, leaf, subroot, root, path, own...) of each row; digests are binary, ``path`` the steps from leaf to root.

    ``own``: further values of a row that come along under the names given.
    """
    digest = digest if digest is not None else leaf(*COLUMNS)
    extra = F.struct(*(c.alias(k) for k, c in own.items())) if own else F.struct(F.lit(None).cast("string").alias("_none"))
    # a byte before the group's own keeps the null group apart and first
    grp = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    rows, most = ranked(docs.select(grp.alias("grp"), F.col(order).alias("ord"), digest.alias("digest"), extra.alias("own")))
    tables = levels(rows, most, fanout)
    subroots, _ = store(_tops(tables), "merkle-subroots")
    crown, n = ranked(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("ord"), F.col("subroot").alias("digest"), F.struct(F.lit(0).alias("_none")).alias("own")))
    higher = levels(crown, n, fanout)
    end = _tops(higher).select("grp", "subroot", F.col("subroot").alias("root"), F.array().cast(STEP).alias("path"))
    tops = _leaves(_proofs(higher, end, fanout)).select(F.col("ord").alias("grp"), F.col("digest").alias("subroot"), "root", "path")
    out = _leaves(_proofs(tables, store(tops, "merkle-tops")[0], fanout))
    name = F.when(F.col("grp") != "", F.expr("substr(grp, 2)"))
    return out.select(name.alias("group"), F.col("ord").alias("order"), "rank", F.col("digest").alias("leaf"), "subroot", "root", "path", *(F.col("own")[k].alias(k) for k in own or {}))


def _leaves(parents: DataFrame) -> DataFrame:
    """One row for each leaf of the first parents, with its own step before the parent's."""
    each = parents.select("grp", "n", "kids", "subroot", "root", "path", F.explode("kids").alias("kid"))
    step = F.array(_step(F.col("kids"), F.col("kid.lo"), F.col("kid.hi")))
    return each.select("grp", "kid.ord", "kid.digest", "kid.own", F.col("kid.lo").alias("rank"), "subroot", "root", F.when(F.col("n") == 1, F.col("path")).otherwise(F.concat(step, "path")).alias("path"))


def fold(leaf_digest: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf_digest, lambda a, s: F.unhex(F.sha2(F.concat(text_of(s["before"]), text_of(a), text_of(s["behind"])).cast("binary"), 256)))


def proof(path: Column) -> Column:
    """Digest (hex) of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(text_of(s["before"]), text_of(s["behind"]))), "").cast("binary"), 256)


class Manifest:
    """A manifest written to a folder: what is needed to tell whether another copy of the data is the same, and where it isn't."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.rows = spark.read.parquet(path)

    @staticmethod
    def write(docs: DataFrame, path: str, **how: object) -> Manifest:
        manifest(docs, **how).write.parquet(path)
        return Manifest(docs.sparkSession, path)

    def differing(self, docs: DataFrame, columns: Sequence[str] = COLUMNS, group: str = "lang", order: str = "doc_id") -> DataFrame:
        """(group, order, change): rows that don't fold to the root any more (``changed``), that are new, or gone."""
        now = docs.select(F.col(group).cast("string").alias("group"), F.col(order).alias("order"), leaf(*columns).alias("now"))
        copy = lambda digest: F.row_number().over(Window.partitionBy("group", "order").orderBy(digest))
        was, now = self.rows.withColumn("copy", copy("leaf")), now.withColumn("copy", copy("now"))
        met = was.alias("w").join(now.alias("n"), [F.col(f"w.{c}").eqNullSafe(F.col(f"n.{c}")) for c in ("group", "order", "copy")], "full")
        change = F.when(F.col("root").isNull(), "new").when(F.col("now").isNull(), "gone").when(fold(F.col("now"), F.col("path")) != F.col("root"), "changed")
        return met.select(F.coalesce("w.group", "n.group").alias("group"), F.coalesce("w.order", "n.order").alias("order"), change.alias("change")).where(F.col("change").isNotNull())
