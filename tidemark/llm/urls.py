"""URL filter: explicit rules, and a path-template tree for the rest.

Each host's paths form a tree of segments. Segments that look variable
(numbers, hexadecimal ids, long mixed tokens) become wildcards at once; a level
with many rarely repeated children becomes a wildcard by its counts. Sibling
branches of the same depth whose labelled rates do not differ are merged. A
template with enough labelled pages is rejected if the smoothed share of
blocked ones reaches a half. All of it is counted by Spark per template, with
copies combined before they move; only template statistics are joined back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import written

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A host with its subdomains, and the start of a path."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class TreeSettings:
    depth: int = 6           # segments told apart; deeper ones share one tail
    max_children: int = 24   # more literal children than this ...
    min_repeat: float = 8.0  # ... seen fewer times each than this make a wildcard
    z: float = 2.0           # branches within so many standard errors of the pooled rate are merged
    weight: float = 2.0      # pages that the prior counts for
    min_labels: int = 3
    reject: float = 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://``: the host, A-Z lower-cased, and the path; both empty without one."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return (F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UP, _LOW), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1))


def matching_rule(host: Column, path: Column, rules: list[Rule], what: str) -> Column:
    """Name or verdict of the longest rule that fits, else null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, getattr(rule, what)).otherwise(found)
    return found


def skeleton(path: Column, depth: int) -> Column:
    """The path's segments with variable ones as wildcards; beyond ``depth`` one ``**``."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")

    def mask(s: Column) -> Column:
        return (F.when(s.rlike("^[0-9]+([.][A-Za-z]+)?$"), F.concat(F.lit("{n}"), F.regexp_extract(s, "[.][A-Za-z]+$", 0)))
                .when(s.rlike("^[0-9a-fA-F-]{8,}$"), "{hex}")
                .when(s.rlike("[0-9]") & (F.length(s) > 12) | (F.length(s) > 40), "{id}")
                .otherwise(s))

    head = F.transform(F.slice(parts, 1, depth), mask)
    return F.when(F.size(parts) > depth, F.concat(head, F.array(F.lit("**")))).otherwise(head)


def judge_templates(pages: DataFrame, settings: TreeSettings = TreeSettings()) -> DataFrame:
    """``host, segments, template, verdict`` from rows of ``host, segments, blocked``.

    ``blocked`` is 1 or 0 for labelled pages and null for others. Pages without
    labels on their template are allowed.
    """
    leaf = pages.groupBy("host", "segments").agg(
        F.count(F.lit(1)).alias("n"), F.count("blocked").alias("labels"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("bad"))
    tree = written(leaf.withColumn("template", F.lit("")), "url-tree")
    deepest = tree.agg(F.max(F.size("segments"))).first()[0] or 0
    for level in range(1, deepest + 1):
        # Rows that ended above this level keep their template.
        here = tree.withColumn("segment", F.try_element_at("segments", F.lit(level)))
        child = here.filter("segment IS NOT NULL").groupBy("host", "template", "segment").agg(
            F.sum("n").alias("n"), F.sum("labels").alias("labels"), F.sum("bad").alias("bad"),
            F.min(F.size("segments")).alias("low"), F.max(F.size("segments")).alias("high"))
        parent = child.groupBy("host", "template").agg(
            F.count(F.lit(1)).alias("children"), F.sum("n").alias("all_n"), F.sum("labels").alias("all_labels"),
            F.sum("bad").alias("all_bad"), F.min("low").alias("all_low"), F.max("high").alias("all_high"))
        rate = F.col("all_bad") / F.col("all_labels")
        error = F.sqrt(F.greatest(rate * (1 - rate), F.lit(0.01)) / F.col("labels"))
        alike = ((F.col("labels") > 0) & (F.col("low") == F.col("all_low")) & (F.col("high") == F.col("all_high"))
                 & (F.abs(F.col("bad") / F.col("labels") - rate) <= settings.z * error) & (F.col("children") > 1))
        many = (F.col("children") > settings.max_children) & (F.col("all_n") < settings.min_repeat * F.col("children"))
        named = child.join(parent, ["host", "template"]).select(
            "host", "template", "segment",
            F.when(many, "{*}").when(alike, "{~}").otherwise(F.col("segment")).alias("name"))
        tree = written(here.join(named, ["host", "template", "segment"], "left").select(
            "host", "segments", "n", "labels", "bad",
            F.concat("template", F.coalesce(F.concat(F.lit("/"), "name"), F.lit(""))).alias("template")), "url-tree")
    whole = tree.agg(F.sum("labels").alias("whole_labels"), F.sum("bad").alias("whole_bad"))
    hosts = tree.groupBy("host").agg(F.sum("labels").alias("host_labels"), F.sum("bad").alias("host_bad"))
    w = settings.weight
    prior = (F.col("host_bad") + w * F.coalesce(F.col("whole_bad") / F.col("whole_labels"), F.lit(0.0))) / (F.col("host_labels") + w)
    share = (F.col("sum_bad") + w * prior) / (F.col("sum_labels") + w)
    judged = (tree.groupBy("host", "template").agg(F.sum("labels").alias("sum_labels"), F.sum("bad").alias("sum_bad"))
              .join(hosts, "host").join(F.broadcast(whole), F.lit(True)).select(
        "host", "template", F.when((F.col("sum_labels") >= settings.min_labels) & (share >= settings.reject), "block")
        .otherwise("allow").alias("verdict")))
    return tree.select("host", "segments", "template").join(judged, ["host", "template"])


def filter_urls(pages: DataFrame, key: str, url: str, rules: list[Rule], settings: TreeSettings = TreeSettings()) -> DataFrame:
    """Key, ``host, path, rule, verdict, template`` of each page.

    The rules' verdicts are the labels that the tree learns from. Null urls and
    urls without ``://`` have an empty host and path and are allowed. Repeated
    rows stay repeated.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    rows = rows.select("*", skeleton(F.col("path"), settings.depth).alias("segments"),
                       matching_rule(F.col("host"), F.col("path"), rules, "name").alias("rule"),
                       matching_rule(F.col("host"), F.col("path"), rules, "verdict").alias("ruled"))
    judged = judge_templates(rows.select("host", "segments", F.when(F.col("ruled") == "block", 1).when(
        F.col("ruled") == "allow", 0).alias("blocked")), settings)
    return rows.join(judged, ["host", "segments"], "left").select(
        F.col("key").alias(key), "host", "path", "rule", F.coalesce("ruled", "verdict", F.lit("allow")).alias("verdict"), "template")
