"""Readers for small text resources: dictionaries, rules, link lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import lexicon as lex
from tidemark.functions.normalize import normalize_unicode, plain_value, repair_mojibake
from tidemark.functions.text import strip_space


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a small text file with their number, byte-order mark removed."""
    whole = spark.read.option("wholetext", True).text(path)
    text = F.regexp_replace("value", F.lit("^\\ufeff"), F.lit(""))
    return whole.select(F.posexplode(F.split(text, r"\r?\n")).alias("line_no", "line"))


def dictionary_entries(lines: DataFrame, line: str = "line", order: str = "line_no") -> DataFrame:
    """``source, target`` of two-column lines; ``#`` comments and half lines go.

    The separator is the first tab, else the first whitespace run. Both sides
    are normalised and lower-cased; of equal sources the last line wins.
    """
    text = strip_space(repair_mojibake(F.col(line)))
    kept = lines.withColumn("_l", text).filter((F.col("_l") != "") & ~F.col("_l").startswith("#"))
    tabbed = F.col("_l").contains("\t")
    side = lambda i: F.when(tabbed, F.regexp_extract("_l", "(?s)^([^\t]*)\t(.*)$", i)).otherwise(
        F.regexp_extract("_l", r"(?sU)^(\S+)\s+(.+)$", i))
    clean = lambda c: strip_space(F.lower(normalize_unicode(F.col(c))))
    sides = kept.select(order, strip_space(side(1)).alias("_a"), strip_space(side(2)).alias("_b"))
    pairs = sides.filter((F.col("_a") != "") & (F.col("_b") != "")).select(
        order, clean("_a").alias("source"), clean("_b").alias("target"))
    return pairs.groupBy("source").agg(F.max_by("target", order).alias("target"))


def load_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """``source, target`` of a dictionary file, for ``phrase_replacer``."""
    return dictionary_entries(numbered_lines(spark, path))


def load_hashtags(spark: SparkSession, path: str) -> DataFrame:
    """``tag`` of noise hashtags, one per line, with or without ``#``, for ``hashtag_resolver``; ``//`` starts a comment."""
    lines = numbered_lines(spark, path).select(strip_space(F.col("line")).alias("tag"))
    return lines.filter((F.col("tag") != "") & ~F.col("tag").startswith("//"))


def keyed_entries(table: DataFrame, key: str, value: str, group: str | None = None,
                  wanted: str | None = None) -> DataFrame:
    """Key and value of a dictionary table, only those of one group if asked."""
    chosen = table if group is None else table.filter(F.col(group) == wanted)
    return chosen.select(F.col(key).alias("key"), F.col(value).alias("value"))


def rule_rows(lines: DataFrame, line: str = "line") -> DataFrame:
    """``raw, emotion, label`` of ``label, emotion, [raw, ...]`` lines; others are ignored.

    The emotion itself counts as a raw value. ``raw`` is accent- and case-free.
    """
    pattern = r"^\s*(\d+)\s*,\s*([^,]+?)\s*,\s*\[(.*?)\]\s*$"
    part = lambda i: F.trim(F.regexp_extract(line, pattern, i))
    rules = lines.filter(F.col(line).rlike(pattern)).select(
        part(1).alias("label"), part(2).alias("emotion"),
        F.explode(F.concat(F.array(part(2)), F.split(part(3), ","))).alias("_raw"))
    return rules.filter(F.trim("_raw") != "").select(plain_value(F.col("_raw")).alias("raw"), "emotion", "label").distinct()


def require_rules(rules: DataFrame, what: str) -> DataFrame:
    if not rules.limit(1).count():
        raise ValueError(f"Could not parse label rules from {what}")
    return rules


def emotion_rules(spark: SparkSession, text: str = lex.EMOTION_RULES) -> DataFrame:
    lines = spark.createDataFrame([(t,) for t in text.strip().splitlines()], "line string")
    return require_rules(rule_rows(lines), "the emotion rules")


def kept_lines(lines: DataFrame, default: str, line: str = "line", order: str = "line_no") -> DataFrame:
    """Trimmed lines without blanks and ``#`` comments; the default when none is left."""
    text = strip_space(F.col(line))
    kept = lines.select(F.col(order).alias("line_no"), text.alias("line")).filter(
        (F.col("line") != "") & ~F.col("line").startswith("#"))
    if kept.isEmpty():
        return lines.sparkSession.createDataFrame([(-1, default)], "line_no int, line string")
    return kept.select(F.col("line_no").cast("int").alias("line_no"), "line")
