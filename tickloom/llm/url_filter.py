"""URL filter: host and path rules first, then a path-template tree, in DataFrame operations only.

URLs that a rule decides are the labelled ones. The paths of each host form a tree of segments. Level by level from
the root, a segment that stands for less than ``RARE`` of its node's pages and has fewer than ``SUPPORT`` labelled
ones is variable and becomes ``*``; how many siblings it has does not count. Branches whose labelled block rate does not differ from that of their siblings together
(two-proportion z below ``SIMILAR``) are merged into ``*`` as well, from the leaves up. A template whose smoothed
block rate, (blocked + STRENGTH * rate of all labelled) / (labelled + STRENGTH), is at least ``REJECT`` is blocked.

Everything is counted on distinct (host, path) first and then on template rows; all steps are aggregations that
combine before the shuffle, so a hot host adds rows to no task beyond one per task and template.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.session import pin

RARE = 0.02
SUPPORT = 5  # labelled pages that a rare segment must have to be judged by its own
SIMILAR = 2.5
STRENGTH = 20.0
REJECT = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str]  # verdict, host and path as one text


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where it is null or has no ``://``."""
    has = F.coalesce(url.contains("://"), F.lit(False))
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(""), F.when(has, path).otherwise("")


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits.

    A rule is a host with its subdomains and the beginning of the path. The list of rules is part of the plan and
    meant to be short; of rules of equal length the last listed wins.
    """
    name = verdict = F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        own, _, tail = text.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit("/" + tail))
        name, verdict = F.when(fits, text).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def segments(path: Column) -> Column:
    """All segments of a path."""
    return F.split(F.regexp_replace(path, "^/", ""), "/")


def _generalised(paths: DataFrame) -> tuple[DataFrame, int]:
    """Rows (host, path, t, labelled, blocked) with ``t``, the template as an array, and the number of levels walked.

    A path that is alone below its node leaves the walk: nothing can make its other segments variable, and as only
    branches of their nodes they would all merge into ``*``, so they are written as ``*`` at once. The walk ends when
    no path is left, so it takes as many levels as the longest template that several paths share, and one more.
    """
    none = F.array().cast("array<string>")
    active, done, level = paths.withColumn("t", none), [], 0

    def leave(rows: DataFrame, tail: Column) -> None:
        done.append(rows.select("host", "path", F.concat("t", F.array_repeat(F.lit("*"), tail)).alias("t"), "labelled", "blocked"))

    while True:  # every level is written down, or plans would double with each
        leave(active.where(F.size("s") <= level), F.lit(0))
        active = active.where(F.size("s") > level).withColumn("_seg", F.get("s", F.lit(level)))
        children = pin(active.groupBy("host", "t", "_seg").agg(F.sum("pages").alias("pages"), F.sum("labelled").alias("known"), F.count(F.lit(1)).alias("paths")))
        if children.isEmpty():
            break
        # The node's own totals: one row per node.
        nodes = children.groupBy("host", "t").agg(F.sum("pages").alias("total"), (F.sum("paths") == 1).alias("_alone"))
        stable = children.join(nodes, ["host", "t"]).where((F.col("pages") >= RARE * F.col("total")) | (F.col("known") >= SUPPORT))
        kept = stable.select("host", "t", "_seg", F.lit(True).alias("_kept"), "_alone")
        rows = pin(active.join(kept, ["host", "t", "_seg"], "left"))
        alone = F.coalesce(F.col("_alone"), F.lit(False))
        leave(rows.where(alone), F.size("s") - level)
        step = F.array(F.when(F.col("_kept"), F.col("_seg")).otherwise("*"))
        active, level = rows.where(~alone).withColumn("t", F.concat("t", step)).drop("_seg", "_kept", "_alone"), level + 1
    return reduce(DataFrame.unionAll, done), level


def _merged(templates: DataFrame, levels: int) -> DataFrame:
    """Add ``m``: the template with statistically similar branches merged, from the leaves up; below ``levels`` all is merged."""
    rows = templates.withColumn("m", F.col("t"))
    for level in range(levels, 0, -1):
        at = F.get("m", F.lit(level - 1))
        around = F.transform("m", lambda x, i: F.when(i == level - 1, F.lit("*")).otherwise(x))
        rows = rows.withColumn("_parent", around).withColumn("_branch", at)
        branch = rows.where("_branch is not null").groupBy("host", "_parent", "_branch").agg(F.sum("labelled").alias("n"), F.sum("blocked").alias("b"))
        branch = pin(branch)
        pooled = branch.groupBy("host", "_parent").agg(F.sum("n").alias("pn"), F.sum("b").alias("pb"))
        n, b, pn, pb = (F.col(c).cast("double") for c in ("n", "b", "pn", "pb"))
        p = (pb + 1) / (pn + 2)
        z = F.abs((b + p) / (n + 1) - (pb - b + p) / (pn - n + 1)) / F.sqrt(p * (1 - p) * (1 / (n + 1) + 1 / (pn - n + 1)))
        alike = branch.join(pooled, ["host", "_parent"]).where(z < SIMILAR).select("host", "_parent", "_branch", F.lit(True).alias("_alike"))
        rows = rows.join(alike, ["host", "_parent", "_branch"], "left")
        rows = pin(rows.withColumn("m", F.when(F.col("_alike"), F.col("_parent")).otherwise(F.col("m"))).drop("_parent", "_branch", "_alike"))
    return rows


def judge(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per page: page_id, host, path, ``rule``, ``verdict``, ``template`` and ``purity``.

    The rule's verdict stands; else the template's. Null urls and urls without ``://`` have an empty host and path,
    no rule, and form the template of the empty host. Without any labelled url everything is allowed. Repeated rows
    are rows of their own; an empty table gives an empty one; other columns are ignored.
    """
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": name, "ruled": verdict})
    paths = pin(rows.groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("pages"), F.count("ruled").alias("labelled"), F.count(F.when(F.col("ruled") == "block", 1)).alias("blocked"),
    ))
    tree, levels = _generalised(paths.select("host", "path", segments(F.col("path")).alias("s"), "pages", "labelled", "blocked"))
    tree = pin(tree)
    templates = pin(tree.groupBy("host", "t").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")))
    merged = _merged(templates, levels).select("host", "t", "m", "labelled", "blocked")
    whole = merged.agg(F.coalesce(F.sum("labelled"), F.lit(0)).alias("n"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("b")).first()
    rate = whole["b"] / whole["n"] if whole["n"] else 0.0
    purity = (F.sum("blocked") + F.lit(STRENGTH * rate)) / (F.sum("labelled") + F.lit(STRENGTH))
    judged = merged.join(merged.groupBy("host", "m").agg(purity.alias("purity")), ["host", "m"]).select("host", "t", "m", "purity")
    known = tree.select("host", "path", "t").join(judged, ["host", "t"]).select("host", "path", F.concat_ws("/", "m").alias("template"), "purity")
    by_method = F.when(F.col("purity") >= REJECT, "block").otherwise("allow")
    return rows.join(known, ["host", "path"]).select("page_id", "host", "path", "rule", F.coalesce("ruled", by_method).alias("verdict"), "template", "purity")
