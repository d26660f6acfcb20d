"""URL filters by a path-template tree, in DataFrame operations alone.

Explicit rules (a host and a path prefix, with a verdict) come first; the longest that fits wins. Urls that
a rule judges are the labelled ones from which the tree learns about the rest. Per host, the tree's levels
are all segments of the path, two at least; slashes at the end add no level. A segment is variable, and
becomes `*`, if it holds a digit, or if it has less than the share `rare` of its branch's urls and its
labelled share of blocked urls doesn't differ, by a z-test, from its branch's. What decides is a segment's
share alone, so a branch may have any number of values. Sibling branches with labelled urls whose share of blocked ones doesn't
differ, by the same test, from that of all siblings together are merged, and share counts; a branch without labelled urls
shows no likeness to any, and has its parent's purity. A template's purity
is the share of blocked urls at or below it, smoothed towards that of its parent, the host's towards that of its parent
domain (the host without its first label), and that towards the share of all labelled urls. Templates of at least `reject` purity are blocked.

Null urls and urls without :// have an empty host and path, fit no rule and belong to the template of no
host. Repeated urls count repeatedly. Empty tables give empty results, and without labelled urls
everything is allowed. Only the url and the key are read.

All aggregates are keyed by host and template and combine before the shuffle, so a host with a third of all
rows costs one row a task. A segment's template depends on those before it, so levels from the third on are a pass
each over the urls of branches that have more than 1 / rare urls as deep. The table of templates joins the urls as Spark sees fit: it is broadcast if
small, else a hot host's partition is split by adaptive execution.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickspark.llm.common import written

RARE, WEIGHT, REJECT, Z = 0.01, 4.0, 0.5, 1.96
#: Levels of any path; a shorter one is filled with empty segments.
LEVELS = 2
#: Host, path and verdict of each rule.
Rule = tuple[str, str, str]


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    u = F.coalesce(F.col(url), F.lit(""))
    after = F.when(F.instr(u, "://") > 0, F.expr(f"substr(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    return lower_ascii(F.regexp_extract(after, r"^([^/?#]*)", 1)), F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(rules: Sequence[Rule]) -> Column:
    """Struct of the longest rule that fits columns host and path: name and verdict; null without one."""
    fits = F.lit(None).cast("struct<name:string,verdict:string>")
    for host, path, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        right = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        fits = F.when(right, F.struct(F.lit(host + path).alias("name"), F.lit(verdict).alias("verdict"))).otherwise(fits)
    return fits


def counted(urls: DataFrame, *keys: str) -> DataFrame:
    return urls.groupBy(*keys).agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))


def segments(path: str) -> Column:
    """The path's segments without empty ones at its end, LEVELS at least."""
    parts = F.split(F.expr(f"trim(TRAILING '/' FROM {path})"), "/")
    parts = F.slice(parts, F.lit(2), F.size(parts) - 1)
    return F.concat(parts, F.array_repeat(F.lit(""), F.greatest(F.lit(0), F.lit(LEVELS) - F.size(parts))))


def generalised(urls: DataFrame, level: int, rare: float, z: float) -> DataFrame:
    """urls with its template longer by the segment of this level: itself, or * if it holds a digit, or is rare and like its branch."""
    part = F.element_at("parts", level)
    urls = urls.withColumn("segment", F.when(part.rlike("[0-9]"), F.lit("*")).otherwise(part))
    branch = ["host", "template"]
    values = urls.groupBy(*branch, "segment").agg(F.count("*").alias("size"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    joint = values.groupBy(*branch).agg(F.sum("size").alias("size_all"), F.sum("labelled").cast("double").alias("n_all"), F.sum("bad").cast("double").alias("b_all"))
    own = values.join(joint, branch).where((F.col("size") >= F.lit(rare) * F.col("size_all")) | differs(z)).select(*branch, "segment", F.col("segment").alias("own"))
    return urls.join(own, [*branch, "segment"], "left").withColumn("template", F.concat("template", F.lit("/"), F.coalesce("own", F.lit("*")))).drop("segment", "own")


def templated(rows: DataFrame, rare: float, z: float) -> DataFrame:
    """rows with the template of their whole path.

    A branch of at most 1 / rare urls has no rare segment, and neither has any below it, so its urls need no more counts: their segments
    stay, or become * for a digit. Only larger branches go on to the next level, so a few urls may be as deep as they like.
    """
    rows = rows.withColumn("template", F.lit(""))
    for level in range(1, LEVELS + 1):
        rows = generalised(rows, level, rare, z)
    # the tree looks at the rows and its leaves again and again, so both are written: plans stay small
    rows, level, depth = written(rows, "urls"), LEVELS, F.size("parts")
    if (rows.agg(F.max(depth)).first()[0] or 0) <= LEVELS:
        return rows
    done: DataFrame | None = None
    while True:
        branch = ["host", "template"]
        large = rows.where(depth > level).groupBy(*branch).agg(F.count("*").alias("under")).where(F.lit(rare) * F.col("under") > 1).select(*branch, F.lit(True).alias("large"))
        rows = written(rows.join(large, branch, "left").withColumn("large", (depth > level) & F.col("large").isNotNull()), "urls")
        rest = F.transform(F.slice("parts", F.lit(level + 1), F.greatest(depth - level, F.lit(0))), lambda x: F.concat(F.lit("/"), F.when(x.rlike("[0-9]"), "*").otherwise(x)))
        settled = rows.where(~F.col("large")).withColumn("template", F.concat("template", F.array_join(rest, ""))).drop("large")
        done = settled if done is None else done.unionByName(settled)
        rows = rows.where("large").drop("large")
        if rows.isEmpty():
            return done
        level += 1
        rows = generalised(rows, level, rare, z)


def judge_urls(pages: DataFrame, rules: Sequence[Rule], key: str = "page_id", url: str = "url", rare: float = RARE, weight: float = WEIGHT, reject: float = REJECT, z: float = Z) -> DataFrame:
    """(key, host, path, rule, verdict, template, purity) of each row; purity is null where no label is known at all."""
    host, path = host_and_path(url)
    rows = pages.select(F.col(key), host.alias("host"), path.alias("path")).withColumn("found", fitting_rule(rules))
    rows = rows.withColumns({"labelled": F.when(F.col("found").isNotNull(), F.lit(1)).otherwise(0), "bad": F.when(F.col("found.verdict") == "block", F.lit(1)).otherwise(0)})
    rows = rows.withColumns({"domain": F.regexp_extract("host", r"^[^.]*\.(.*)$", 1), "parts": segments("path")})
    rows = templated(rows, rare, z)
    leaves = written(counted(rows, "domain", "host", "template"), "leaves")
    # a leaf counts in each of the tree's nodes on its path; a node is its parent's template and its own segment
    part = F.split("template", "/")
    steps = leaves.select("*", F.posexplode(F.slice(part, F.lit(2), F.size(part) - 1)).alias("level", "branch"))
    steps = steps.withColumn("parent", F.array_join(F.slice(part, F.lit(1), F.col("level") + 1), "/"))
    nodes = merged(counted(steps, "domain", "host", "level", "parent", "branch"), ["domain", "host", "level", "parent"], "branch", z)
    hosts = counted(leaves, "domain", "host")
    domains = counted(hosts, "domain")
    every = domains.agg(F.sum("labelled").alias("n0"), F.sum("bad").alias("b0"))

    def smooth(bad: Column, n: Column, above: Column) -> Column:
        return (bad + F.lit(weight) * above) / (n + F.lit(weight))

    tree = steps.select("host", "template", "level", "parent", "branch").join(nodes, ["host", "level", "parent", "branch"])
    tree = tree.groupBy("domain", "host", "template").agg(F.array_sort(F.collect_list(F.struct("level", F.col("pooled_bad").cast("double").alias("b"), F.col("pooled_labelled").cast("double").alias("n")))).alias("way"))
    tree = tree.join(hosts.select("host", F.col("bad").alias("b2"), F.col("labelled").alias("n2")), ["host"])
    tree = tree.join(domains.select("domain", F.col("bad").alias("b1"), F.col("labelled").alias("n1")), ["domain"])
    tree = tree.crossJoin(F.broadcast(every))  # one row
    tree = tree.withColumn("purity", F.when(F.col("n0") > 0, F.col("b0") / F.col("n0")))
    for i in (1, 2):
        tree = tree.withColumn("purity", smooth(F.col(f"b{i}"), F.col(f"n{i}"), F.col("purity")))
    tree = tree.select("host", "template", F.aggregate("way", F.col("purity"), lambda above, x: smooth(x["b"], x["n"], above)).alias("purity"))
    out = rows.join(tree, ["host", "template"])
    verdict = F.when(F.col("found").isNotNull(), F.col("found.verdict")).when(F.col("purity") >= reject, F.lit("block")).otherwise(F.lit("allow"))
    return out.select(key, "host", "path", F.col("found.name").alias("rule"), verdict.alias("verdict"), "template", F.round("purity", 6).alias("purity"))


def differs(z: float) -> Column:
    """Whether a branch's labelled share of bad ones differs from its siblings' joint one, p.

    With n labelled urls and b bad ones it does if (b - n p)^2 > z^2 n p (1 - p).
    """
    n, b, na, ba = (F.col(c) for c in ("labelled", "bad", "n_all", "b_all"))
    # both sides times n_all squared, so that no division is needed
    return (b * na - n * ba) * (b * na - n * ba) > F.lit(z * z) * n * ba * (na - ba)


def merged(counts: DataFrame, parent: Sequence[str], branch: str, z: float) -> DataFrame:
    """counts with pooled_labelled and pooled_bad: those of all merged siblings, or of the branch if it stands alone, being different or without labels."""
    joint = counts.groupBy(*parent).agg(F.sum("labelled").cast("double").alias("n_all"), F.sum("bad").cast("double").alias("b_all"))
    rows = counts.join(joint, list(parent)).withColumn("alone", differs(z) | (F.col("labelled") == 0))
    n, b = F.col("labelled"), F.col("bad")
    pool = rows.where(~F.col("alone")).groupBy(*parent).agg(F.sum("labelled").alias("n_pool"), F.sum("bad").alias("b_pool"))
    rows = rows.join(pool, list(parent), "left")
    return rows.select(*parent, branch, "labelled", "bad", F.when(F.col("alone"), n).otherwise(F.col("n_pool")).alias("pooled_labelled"), F.when(F.col("alone"), b).otherwise(F.col("b_pool")).alias("pooled_bad"))
