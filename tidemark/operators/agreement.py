"""Annotator agreement: label counts, count matrices and Cohen's kappa.

One pass over the rows builds the count matrix of every pair (map-side combined,
so a dominant class or type does not skew it); everything after that runs on the
few rows of the matrix.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import lexicon as lex
from tidemark.functions.text import is_blank

OVERALL = "overall"


def _label(column: str) -> Column:
    return F.when(is_blank(F.col(f"`{column}`")), F.lit("")).otherwise(F.trim(F.col(f"`{column}`").cast("string")))


def unpivot_labels(df: DataFrame, group: str, models: Sequence[str]) -> DataFrame:
    """One row per row and model: group, model, label (blank when missing)."""
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), _label(m).alias("label")) for m in models])
    return df.select(F.col(group), F.explode(pairs).alias("p")).select(group, "p.model", "p.label")


def with_overall(counts: DataFrame, group: str, keys: Sequence[str], count: str) -> DataFrame:
    """Add each count a second time under the group ``overall``, which no group itself may be called."""
    taken = F.raise_error(F.lit(f"{group} holds the reserved name {OVERALL!r}"))
    own = F.when(F.col(group).cast("string") == OVERALL, taken).otherwise(F.col(group).cast("string"))
    both = F.explode(F.array(own, F.lit(OVERALL)))
    return counts.withColumn(group, both).groupBy(group, *keys).agg(F.sum(count).alias(count))


def label_counts(df: DataFrame, group: str, models: Sequence[str]) -> DataFrame:
    """Counts per group, model and label, plus the overall counts."""
    counted = (unpivot_labels(df, group, models).filter(F.col("label") != "")
               .groupBy(group, "model", "label").count())
    names = F.create_map(*[F.lit(x) for k, v in lex.LABEL_NAMES.items() for x in (str(k), v)])
    return with_overall(counted, group, ["model", "label"], "count").withColumn(
        "label_name", F.coalesce(F.try_element_at(names, F.col("label")), F.lit("")))


def pair_matrix(df: DataFrame, group: str, models: Sequence[str]) -> DataFrame:
    """``group, model_a, model_b, a, b, n`` for all model pairs, and ``overall``."""
    pairs = F.array(*[
        F.struct(F.lit(x).alias("model_a"), F.lit(y).alias("model_b"), _label(x).alias("a"), _label(y).alias("b"))
        for x, y in combinations(models, 2)])
    keys = ["model_a", "model_b", "a", "b"]
    cells = (df.select(F.col(group).cast("string").alias(group), F.explode(pairs).alias("p"))
             .groupBy(group, *[F.col(f"p.{k}").alias(k) for k in keys]).agg(F.count("*").alias("n")))
    return with_overall(cells, group, keys, "n")


def kappa_from_matrix(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Agreement figures of count matrices with columns ``a, b, n``.

    No comparable rows give zeros; an expected agreement of one gives one if the
    observed agreement is one, else zero.
    """
    both = (F.col("a") != "") & (F.col("b") != "")
    n, none = F.col("n"), F.lit(0).cast("bigint")
    shared = F.when(both, n).otherwise(none)
    agreed = F.when(both & (F.col("a") == F.col("b")), n).otherwise(none)
    entry = lambda label, *values: F.struct(label.alias("label"), *[
        v.alias(k) for k, v in zip(("rows", "shared", "agreed", "na", "nb"), values)])
    by_label = (cells.select(*keys, F.explode(F.array(
        entry(F.col("a"), n, shared, agreed, shared, none),
        entry(F.col("b"), none, none, none, none, shared))).alias("m"))
        .groupBy(*keys, "m.label")
        .agg(*[F.sum(f"m.{c}").alias(c) for c in ("rows", "shared", "agreed", "na", "nb")]))
    joined = by_label.groupBy(*keys).agg(
        F.sum("rows").alias("rows"), F.sum("shared").alias("comparable_rows"),
        F.sum("agreed").alias("agree_count"), F.sum(F.col("na").cast("double") * F.col("nb")).alias("_cross"))
    n = F.col("comparable_rows").cast("double")
    observed = F.when(n > 0, F.col("agree_count") / n).otherwise(0.0)
    expected = F.when(n > 0, F.col("_cross") / (n * n)).otherwise(0.0)
    kappa = (F.when(n == 0, 0.0)
             .when(F.col("expected_agreement") == 1.0, F.when(F.col("observed_agreement") == 1.0, 1.0).otherwise(0.0))
             .otherwise((F.col("observed_agreement") - F.col("expected_agreement"))
                        / (1.0 - F.col("expected_agreement"))))
    return (joined
            .withColumn("disagree_count", F.col("comparable_rows") - F.col("agree_count"))
            .withColumn("observed_agreement", observed)
            .withColumn("expected_agreement", expected)
            .withColumn("cohen_kappa", kappa)
            .select(*keys, "rows", "comparable_rows", "agree_count", "disagree_count",
                    "observed_agreement", "expected_agreement", "cohen_kappa"))


def pairwise_report(df: DataFrame, group: str, models: Sequence[str]) -> DataFrame:
    """Agreement of all model pairs per group and overall."""
    return kappa_from_matrix(pair_matrix(df, group, models), [group, "model_a", "model_b"])


def cohen_kappa(df: DataFrame, a: str, b: str, by: str | None = None) -> DataFrame:
    """Kappa of two label columns, per group or over all rows."""
    cells = df.groupBy(*([by] if by else [F.lit(OVERALL).alias("scope")]), _label(a).alias("a"), _label(b).alias("b")).agg(
        F.count("*").alias("n"))
    return kappa_from_matrix(cells, [by or "scope"])


def two_file_agreement(compared: DataFrame) -> DataFrame:
    """Agreement of joined label tables; no comparable row is an error."""
    report = cohen_kappa(compared, "label_a", "label_b").drop("scope")
    return report.withColumn("comparable_rows", F.when(
        F.col("comparable_rows") == 0,
        F.raise_error(F.lit("No comparable rows after filtering labels.")).cast("bigint"))
        .otherwise(F.col("comparable_rows")))


def confusion_report(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Nested JSON per key: outer key = label of b, inner key = label of a."""
    both = cells.filter((F.col("a") != "") & (F.col("b") != ""))
    inner = both.groupBy(*keys, "b").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("a", "n")))).alias("_row"))
    return inner.groupBy(*keys).agg(F.to_json(F.map_from_entries(
        F.sort_array(F.collect_list(F.struct("b", F.to_json("_row").alias("row")))))).alias("confusion_matrix"))


def status_counts(df: DataFrame, status: str, names: Sequence[str]) -> DataFrame:
    """Rows per status; known statuses with no row count zero."""
    counted = df.select(F.col(status).alias("status"), F.lit(1).alias("n"))
    known = df.sparkSession.createDataFrame([(s,) for s in names], "status string").select("status", F.lit(0).alias("n"))
    return counted.unionByName(known).groupBy("status").agg(F.sum("n").alias("n"))
