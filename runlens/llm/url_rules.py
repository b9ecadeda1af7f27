"""Verdicts on URLs by rules and by a tree of path templates (operator 6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import sent
from .workspace import Workspace, without_ascii_case

#: (verdict, host, path): the rules of the query.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Children of a node from which a segment counts as variable; weight of the parent's purity in a node's; z score below
#: which two branches, or a branch and its parent, are no different; purity from which a template is rejected.
VARIABLE, WEIGHT, Z, REJECT = 10, 8.0, 1.96, 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z) and path of a URL; both empty without `://` or for null."""
    found = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return (without_ascii_case(F.coalesce(F.regexp_extract(url, found, 1), F.lit(""))), F.coalesce(F.regexp_extract(url, found, 2), F.lit("")))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as host + path, and its verdict; null if none fits."""
    rule = verdict = F.lit(None).cast("string")
    for kind, own_host, own_path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(own_path)
        rule, verdict = F.when(fits, own_host + own_path).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def _shape(segment: Column) -> Column:
    """A segment with every number as one wildcard."""
    return F.regexp_replace(segment, r"[0-9]+", "*")


def template_tree(paths: DataFrame, variable: int = VARIABLE) -> DataFrame:
    """(host, shape, n, n_labelled, n_block) → the same rows with `nodes`, the templates from the host down to the leaf.

    Numbers in segments are wildcards at once; where a node has `variable` or more different children, the child segment
    becomes one too.
    """
    segments = paths.withColumn("segments", F.filter(F.split("shape", "/"), lambda s: s != ""))
    steps = segments.select("host", "shape", F.posexplode("segments").alias("level", "segment"), F.col("segments").alias("all"))
    steps = steps.withColumn("parent", F.array_join(F.slice("all", F.lit(1), F.col("level")), "/")).drop("all")
    wide = steps.groupBy("host", "parent").agg(F.count_distinct("segment").alias("children"))
    named = steps.join(wide, ["host", "parent"]).select("host", "shape", "level", F.when(F.col("children") >= variable, "*").otherwise(F.col("segment")).alias("part"))
    templates = named.groupBy("host", "shape").agg(F.transform(F.array_sort(F.collect_list(F.struct("level", "part"))), lambda x: x["part"]).alias("parts"))
    parts = F.coalesce("parts", F.array().cast("array<string>"))
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), k), "/")))
    return paths.join(templates, ["host", "shape"], "left").select(*paths.columns, prefixes.alias("nodes"))


def merged_branches(stats: DataFrame, z: float = Z) -> DataFrame:
    """(host, parent, node, n_labelled, n_block) of a tree's nodes → (host, node, n_labelled, n_block) with the sums of the branches that each is merged with.

    Sisters stand in the order of their share of blocked rows. Neighbours whose shares a test of two proportions can't tell apart are one
    branch. A branch without labels is alone.
    """
    n, block = F.col("n_labelled"), F.col("n_block")
    told = stats.where(n > 0).withColumn("share", block / n)
    row = Window.partitionBy("host", "parent").orderBy("share", "node")
    before = told.withColumns({"_n": F.lag(n).over(row), "_b": F.lag(block).over(row), "_share": F.lag("share").over(row)})
    pooled = (block + F.col("_b")) / (n + F.col("_n"))
    spread = F.sqrt(pooled * (1 - pooled) * (1 / n + 1 / F.col("_n")))
    apart = F.when(F.col("_n").isNull() | (F.col("share") - F.col("_share") <= z * spread), 0).otherwise(1)
    grouped = before.withColumn("_apart", apart).withColumn("_branch", F.sum("_apart").over(row.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("host", "parent", "_branch")
    merged = grouped.select("host", "node", F.sum(n).over(whole).alias("n_labelled"), F.sum(block).over(whole).alias("n_block"))
    return merged.unionByName(stats.where(n == 0).select("host", "node", "n_labelled", "n_block"))


def template_purity(tree: DataFrame, weight: float = WEIGHT, z: float = Z) -> DataFrame:
    """(host, shape, template, purity): smoothed share of blocked rows among a template's labelled rows.

    From the top down: all rows, the registered domain (last two labels), the host, then the template's prefixes as merged with their
    sisters. A node's share is smoothed with `weight` rows of its parent's purity. A branch whose share is statistically like its parent's
    is merged into it and has the parent's purity. The steps of one template are folded in its row, however deep it is.
    """
    sums = [F.sum("n_labelled").alias("n_labelled"), F.sum("n_block").alias("n_block")]
    hosts = tree.groupBy("host").agg(*sums).withColumn("domain", F.substring_index("host", ".", -2))
    domains = hosts.groupBy("domain").agg(*sums)
    total = domains.agg(F.coalesce(F.sum("n_block"), F.lit(0)), F.coalesce(F.sum("n_labelled"), F.lit(0))).first()
    top = (total[0] + 1) / (total[1] + 2)
    above = hosts.join(domains.select("domain", F.struct("n_labelled", "n_block").alias("d")), "domain").select("host", F.array("d", F.struct("n_labelled", "n_block")).alias("above"))
    steps = tree.select("host", "shape", "n_labelled", "n_block", F.posexplode("nodes").alias("depth", "node"), F.col("nodes").alias("all")).where("depth > 0")
    steps = steps.withColumn("parent", F.expr("all[depth - 1]")).drop("all")
    merged = merged_branches(steps.groupBy("host", "parent", "node").agg(*sums), z)
    below = steps.select("host", "shape", "depth", "node").join(merged, ["host", "node"]).groupBy("host", "shape").agg(F.array_sort(F.collect_list(F.struct("depth", "n_labelled", "n_block"))).alias("below"))

    def smooth(parent: Column, x: Column) -> Column:
        n, block = x["n_labelled"], x["n_block"]
        spread = F.sqrt(parent * (1 - parent) / F.greatest(n, F.lit(1)))
        alike = (n == 0) | (F.abs(block / F.greatest(n, F.lit(1)) - parent) <= z * spread)
        return F.when(alike, parent).otherwise((block + weight * parent) / (n + weight))

    own = F.transform(F.coalesce("below", F.array().cast("array<struct<depth:int,n_labelled:bigint,n_block:bigint>>")), lambda x: F.struct(x["n_labelled"].alias("n_labelled"), x["n_block"].alias("n_block")))
    rows = tree.select("host", "shape", F.element_at("nodes", -1).alias("template")).join(above, "host").join(below, ["host", "shape"], "left")
    return rows.select("host", "shape", "template", F.aggregate(F.concat("above", own), F.lit(float(top)), smooth).alias("purity"))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url", id_: str = "page_id", block_label: Column | None = None, reject: float = REJECT) -> DataFrame:
    """Per row: id, host, path, rule, verdict, then template and purity.

    Rows with a rule take its verdict. Labels of the tree are the verdicts of rules, or `block_label` (boolean, null:
    unlabelled) if given; other rows are blocked if their template's purity reaches `reject`. Rows join on (host, shape)
    with one row per template, sent to all tasks if there are few. A null or odd url has empty host and path
    and is judged like any other; equal rows and null ids stay; a long url is one row, and other columns of pages don't matter.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(id_), host.alias("host"), path.alias("path"), (block_label if block_label is not None else F.lit(None).cast("boolean")).alias("label"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": verdict, "shape": _shape(F.col("path"))})
    label = F.col("label") if block_label is not None else F.col("ruled") == "block"
    paths = rows.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count(label).alias("n_labelled"), F.count_if(label).alias("n_block"))
    work = Workspace(pages.sparkSession)
    tree = work.keep(template_tree(work.keep(paths, "url-shapes")), "url-templates")
    judged = sent(work.keep(template_purity(tree), "url-purity"))
    by_tree = F.when(F.col("purity") >= reject, "block").otherwise("allow")
    return rows.join(judged, ["host", "shape"], "left").select(id_, "host", "path", "rule", F.coalesce("ruled", by_tree).alias("verdict"), "template", "purity")
