"""URL filter: a path-template tree per host, judged by smoothed labelled purity, under a list of fixed rules.

Urls are first counted by (host, path), so a host or url with a third of the rows is combined map-side. The tree is then built node by
node from the root: what all paths of a node go on with alike is skipped in one step. Large nodes are rounds of DataFrame operators; a node
with few urls (most hosts, and soon each branch of the large ones) is finished in the task that holds it, by the same rule, so a chain of
branchings costs no rounds. At a branching, the next segment becomes
``*`` where it varies (it looks like a number, date or hash; or the position is open: surely most of its urls have a segment of their
own, by the Wilson bound of that share) and where its branch is shown to be like its siblings (the shares of bad labels are
equal to within ``margin``, at a confidence of ``z``). All other branches stay as they are, those without labels too.

A node's share of bad labels is smoothed towards its parent's, that of a root towards the share of all hosts.

Defined cases: null url or no ``://``: host and path empty; such rows are a host like any other. Hosts and branches without labels have
their parent's share. Very long urls are taken whole. Ties don't arise: all choices are tests against numbers. Null page_id and repeated
rows give a row each; repeated labels of a page count by their largest value. Other columns, whatever their names, are left
out. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import groupby
from operator import itemgetter
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_az, store

#: Segments that vary by page: numbers, dates, hashes, uuids, with or without a file ending.
VARIABLE = r"^([0-9][0-9._-]*|[0-9a-fA-F]{8,}|[0-9a-fA-F]{8}-[0-9a-fA-F-]{27})(\.[A-Za-z0-9]{1,5})?$"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substr({0}, {1})".format("url", "instr(url, '://') + 3"))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return lower_az(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict (null if none fits). rules: (verdict, host and path prefix)."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, slash, prefix = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + prefix)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def smoothed(bad: Column, labelled: Column, towards: Column, prior: float) -> Column:
    return (bad + prior * towards) / (labelled + prior)


#: What one task finishes of a node at once: urls, and characters of their paths.
LOCAL_URLS, LOCAL_CHARS = 10_000, 8_000_000
ENDED = "host string, path string, template string, purity double"


def subtree(node: str, share: float, urls: list[tuple[str, int, int, list[str]]], prior: float, z: float, margin: float) -> Iterator[tuple[str, str, float]]:
    """(path, template, purity) of the urls (path, labelled, bad, rest) of a node, by the rule of templates()."""
    even = lambda bad, labelled, towards: (bad + prior * towards) / (labelled + prior)
    todo = [(node, share, urls)]
    while todo:
        node, share, urls = todo.pop()
        rests = [u[3] for u in urls]
        lo, hi = min(rests), max(rests)
        common = len(commonprefix([lo, hi]))
        if common:
            node = f"{node}/{'/'.join(lo[:common])}"
        ended = [u for u in urls if len(u[3]) == common]
        purity = share if lo == hi else even(sum(u[2] for u in ended), sum(u[1] for u in ended), share)
        yield from ((u[0], node, purity) for u in ended)
        children: dict[str, list] = {}
        for u in urls:
            if len(u[3]) > common:
                children.setdefault(u[3][common], []).append((*u[:3], u[3][common + 1 :]))
        n, labelled, bad = (sum(f(c) for c in children.values()) for f in (len, lambda c: sum(u[1] for u in c), lambda c: sum(u[2] for u in c)))
        singles = sum(1 for seg, c in children.items() if len(c) == 1 and seg)
        branches: dict[str, list] = {}
        for seg, c in children.items():
            star = seg == "*" or (seg and ((len(c) == 1 and _wilson(singles / n, n, z) >= 0.5) or _like(sum(u[1] for u in c), sum(u[2] for u in c), labelled, bad, z, margin)))
            branches.setdefault("*" if star else seg, []).extend(c)
        todo += [(f"{node}/{name}", even(sum(u[2] for u in c), sum(u[1] for u in c), share), c) for name, c in branches.items()]


def _wilson(p: float, n: int, z: float) -> float:
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def _like(l: int, b: int, w_l: int, w_b: int, z: float, margin: float) -> bool:  # noqa: E741
    if not l or l == w_l:
        return False
    gap = abs((b + 0.5) / (l + 1) - (w_b - b + 0.5) / (w_l - l + 1))
    pooled = (w_b + 1) / (w_l + 2)
    return gap + z * math.sqrt(pooled * (1 - pooled) * (1 / l + 1 / (w_l - l))) <= margin


def _finished(small: DataFrame, prior: float, z: float, margin: float) -> DataFrame:
    """subtree() of each small node: nodes come sorted, a node at a time."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("host", "node", "share", "path", "labelled", "bad", "rest")), strict=True))
        out: list[tuple] = []
        for (host, node), group in groupby(each, itemgetter(0, 1)):
            urls = list(group)
            out += [(host, *found) for found in subtree(node, urls[0][2], [u[3:] for u in urls], prior, z, margin)]
            if len(out) >= 10_000:
                yield _ended(out)
                out = []
        yield _ended(out)

    dealt = small.repartition("host", "node").sortWithinPartitions("host", "node")
    return dealt.select("host", "node", "share", "path", "labelled", "bad", "rest").mapInArrow(rows, ENDED)


def _ended(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*[pa.string()] * 3, pa.float64()], strict=True)], names=["host", "path", "template", "purity"])


def templates(urls: DataFrame, prior: float = 4.0, z: float = 2.0, margin: float = 0.25, local_urls: int = LOCAL_URLS) -> DataFrame:
    """urls (host, path, n, labelled, bad), one row for each host and path, with their ``template`` and its ``purity``, the smoothed share of bad labels.

    Nodes of up to ``local_urls`` urls are finished by the task that holds them.
    """
    every = urls.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("b"), F.coalesce(F.sum("labelled"), F.lit(0)).alias("l")).first()
    hosts = urls.groupBy("host").agg(smoothed(F.sum("bad"), F.sum("labelled"), F.lit((every.b + 0.5) / (every.l + 1)), prior).alias("share"))
    segments = F.transform(F.split(F.regexp_replace("path", "^/", ""), "/", -1), lambda s: F.when(s.rlike(VARIABLE), F.lit("*")).otherwise(s))
    start = urls.join(hosts, "host").select("host", "path", "labelled", "bad", "share", F.lit("").alias("node"), F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(segments).alias("rest"))
    now, _ = store(start, "url-tree")
    ended = []
    while now.take(1):
        sizes = now.groupBy("host", "node").agg((F.count("*") > local_urls).alias("many"), (F.sum(F.char_length("path")) > LOCAL_CHARS).alias("long"))
        marked, _ = store(now.join(sizes, ["host", "node"]).withColumn("large", F.col("many") | F.col("long")).drop("many", "long"), "url-sized")
        ended.append(store(_finished(marked.where("NOT large"), prior, z, margin), "url-ended")[0])
        now = marked.where("large").drop("large")
        if not now.take(1):
            break
        # what all rests of a node begin with is what the least and the greatest begin with
        bounds = now.groupBy("host", "node").agg(F.min("rest").alias("lo"), F.max("rest").alias("hi"))
        apart = F.array_position(F.zip_with("lo", "hi", lambda a, b: ~a.eqNullSafe(b)), True)
        common = F.when(apart > 0, apart - 1).otherwise(F.size("lo")).cast("int")
        skip = bounds.select("host", "node", F.slice("lo", F.lit(1), common).alias("alike"), (apart == 0).alias("alone"))
        seen = now.join(skip, ["host", "node"])
        longer = F.concat("node", F.when(F.size("alike") > 0, F.concat(F.lit("/"), F.array_join("alike", "/"))).otherwise(F.lit("")))
        left = F.slice("rest", F.size("alike") + 1, F.size("rest"))
        seen, _ = store(seen.select("host", "path", "labelled", "bad", "share", longer.alias("node"), left.alias("rest"), "alone"), "url-nodes")
        stop = seen.where(F.size("rest") == 0)
        # paths that end where others go on are a branch of their own
        own = stop.groupBy("host", "node").agg(F.sum("labelled").alias("o_l"), F.sum("bad").alias("o_b"))
        purity = F.when(F.col("alone"), F.col("share")).otherwise(smoothed(F.col("o_b"), F.col("o_l"), F.col("share"), prior))
        ended.append(stop.join(own, ["host", "node"]).select("host", "path", F.col("node").alias("template"), purity.alias("purity")))
        rows = seen.where(F.size("rest") > 0).withColumn("seg", F.get("rest", F.lit(0)))
        child = rows.groupBy("host", "node", "seg").agg(F.count("*").alias("urls"), F.sum("labelled").alias("l"), F.sum("bad").alias("b"), F.max("share").alias("share"))
        child, _ = store(child, "url-children")
        whole = child.groupBy("host", "node").agg(F.sum("urls").alias("w_urls"), F.sum("l").alias("w_l"), F.sum("b").alias("w_b"), F.count_if((F.col("urls") == 1) & (F.col("seg") != "")).alias("singles"))
        chosen = child.join(whole, ["host", "node"]).withColumn("branch", F.when(_varies(z) | _alike(z, margin), F.lit("*")).otherwise(F.col("seg")))
        branches = chosen.groupBy("host", "node", "branch").agg(smoothed(F.sum("b"), F.sum("l"), F.max("share"), prior).alias("next"))
        to = chosen.select("host", "node", "seg", "branch").join(branches, ["host", "node", "branch"])
        moved = rows.drop("share").join(to, ["host", "node", "seg"])
        now, _ = store(moved.select("host", "path", "labelled", "bad", F.col("next").alias("share"), F.concat("node", F.lit("/"), "branch").alias("node"), F.slice("rest", F.lit(2), F.size("rest")).alias("rest")), "url-tree")
    return reduce(DataFrame.unionByName, ended) if ended else urls.select("host", "path", F.lit("").alias("template"), F.lit(0.0).alias("purity"))


def _varies(z: float) -> Column:
    """Whether a segment varies: by its looks, or as one url's own segment at a place where the Wilson bound of such urls' share is half or more."""
    p, n = F.col("singles") / F.col("w_urls"), F.col("w_urls")
    low = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    return (F.col("seg") == "*") | ((F.col("seg") != "") & (F.col("urls") == 1) & (low >= 0.5))


def _alike(z: float, margin: float) -> Column:
    """Whether a branch is shown to have the share of bad labels that its siblings have; never without labels on both sides."""
    l, b = F.col("l"), F.col("b")  # noqa: E741
    rest_l, rest_b = F.col("w_l") - l, F.col("w_b") - b
    gap = F.abs((b + 0.5) / (l + 1) - (rest_b + 0.5) / (rest_l + 1))
    pooled = (F.col("w_b") + 1) / (F.col("w_l") + 2)
    spread = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1), l) + F.try_divide(F.lit(1), rest_l)))
    return (F.col("seg") != "") & F.coalesce(gap + z * spread <= margin, F.lit(False))


def judge(pages: DataFrame, rules: list[tuple[str, str]], labels: DataFrame | None = None, reject_at: float = 0.5, **tree) -> DataFrame:
    """pages (page_id, url) with host, path, rule, verdict, template and purity (the smoothed share of bad labels).

    A rule's verdict holds where one fits. Else the template's: a purity of ``reject_at`` or more is blocked.
    labels (page_id, bad 0/1) are known verdicts of pages; pages under a rule count as labelled by it as well.
    """
    p = pages.select("page_id", "url")
    host, path = host_and_path(F.col("url"))
    p = p.select("page_id", host.alias("host"), path.alias("path"))
    rule, by_rule = rule_of(F.col("host"), F.col("path"), rules)
    p = p.withColumns({"rule": rule, "by_rule": by_rule})
    known = p.withColumn("mark", F.when(F.col("by_rule") == "block", 1).when(F.col("by_rule") == "allow", 0))
    if labels is not None:
        marks = labels.groupBy("page_id").agg(F.max("bad").alias("own"))
        known = known.join(marks, "page_id", "left").withColumn("mark", F.coalesce("own", "mark")).drop("own")
    urls = known.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("mark").alias("labelled"), F.coalesce(F.sum("mark"), F.lit(0)).alias("bad"))
    found = templates(urls, **tree)
    verdict = F.coalesce("by_rule", F.when(F.col("purity") >= reject_at, "block").otherwise("allow"))
    return p.join(found, ["host", "path"], "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
