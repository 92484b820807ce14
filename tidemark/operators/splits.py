"""Deterministic stratified train/validation/test splits.

Rows of a stratum are ordered by a seeded hash of their key and cut at rounded
fractions. The cut points are found from counts per hash prefix plus one look at
the few rows that share the prefix of a cut, so the rows themselves are never
shuffled and no stratum is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.labels import label_name_vi, strict_code
from tidemark.functions.text import squash
from tidemark.operators.ranking import digest, digest_bucket
from tidemark.session import written

STRATEGIES = {
    "label": ["label_id"],
    "label_data_type": ["label_id", "data_types"],
    "label_data_type_emotion": ["label_id", "data_types", "emotion"],
}
BROADCAST_STRATA = 50_000


def prepare(df: DataFrame, text: str, label: str) -> DataFrame:
    """Clean text, drop empty texts and null labels, add ``label_id`` and ``label_name``."""
    filled = df.filter(F.col(text).rlike(r"(?U)[^\s\x1c-\x1f]") & F.col(label).isNotNull())
    coded = filled.withColumn(text, squash(F.col(text))).withColumn("label_id", strict_code(F.col(label)))
    return coded.withColumn("label_name", label_name_vi(F.col("label_id")))


def require_classes(df: DataFrame, label: str = "label_id", classes: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """``df`` itself, or an error naming the classes without rows."""
    seen = {r[0] for r in df.filter(F.col(label).isin(*classes)).select(label).distinct().collect()}
    missing = sorted(set(classes) - seen)
    if missing:
        raise ValueError(f"Missing labels {missing}; need all labels {list(classes)}.")
    return df


def stratum(columns: Sequence[str]) -> Column:
    return F.concat_ws("||", *[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in columns])


def strategy_columns(df: DataFrame, strategy: str) -> list[str]:
    """Columns of a strategy; if one is missing, the label alone."""
    wanted = STRATEGIES[strategy]
    return wanted if all(c in df.columns for c in wanted) else ["label_id"]


def usable_strata(df: DataFrame, columns: Sequence[str], keep: float) -> tuple[list[str], int, bool]:
    """The columns if every stratum has two rows, else the label alone, else an error.

    Also gives the number of strata and whether every stratum still has two rows
    after the share ``keep`` is taken out. One aggregate, three numbers to the driver.
    """
    for names in dict.fromkeys([tuple(columns), ("label_id",)]):
        counts = df.groupBy(stratum(names).alias("s")).count()
        rest = F.col("count") - F.floor(F.col("count") * keep + 0.5 + 1e-9)
        low, strata, left = counts.agg(F.min("count"), F.count("*"), F.min(rest)).first()
        if low is not None and low >= 2:
            return list(names), strata, left >= 2
    raise ValueError("Cannot stratify: at least one label has fewer than 2 rows.")


def cut(df: DataFrame, columns: Sequence[str], key: str, fractions: Sequence[float], names: Sequence[str],
        seed: int = 42, into: str = "split", strata: int | None = None, narrow: DataFrame | None = None) -> DataFrame:
    """Name each row by the piece of its stratum it falls into.

    ``fractions`` are the cumulative cut points, one fewer than ``names``.
    ``narrow`` holds only the key and the stratum columns of the same rows.
    """
    at = F.struct(digest(F.col(key), seed).alias("d"), F.col(key).alias("k"))
    keyed = df.withColumns({"_s": stratum(columns), "_at": at})
    place = (df if narrow is None else narrow).select(stratum(columns).alias("_s"), at.alias("_at")).withColumn(
        "_b", digest_bucket(F.col("_at.d")))
    counts = place.groupBy("_s", "_b").agg(F.count("*").alias("_n"))
    by = Window.partitionBy("_s")
    placed = counts.withColumns({
        "_before": F.coalesce(F.sum("_n").over(by.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_all": F.sum("_n").over(by)})
    wanted = F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.floor(F.col("_all") * f + 0.5 + 1e-9).cast("bigint").alias("rank"))
        for i, f in enumerate(fractions)]))
    edges = (placed.select("_s", "_b", "_before", "_n", wanted.alias("_w"))
             .filter((F.col("_w.rank") > F.col("_before")) & (F.col("_w.rank") <= F.col("_before") + F.col("_n")))
             .select("_s", "_b", F.col("_w.i").alias("_i"), (F.col("_w.rank") - F.col("_before")).alias("_r")))
    small = F.broadcast if strata is not None and strata <= BROADCAST_STRATA else (lambda d: d)
    inside = place.join(small(edges.select("_s", "_b").distinct()), ["_s", "_b"], "left_semi")
    ranked = inside.withColumn("_r", F.row_number().over(Window.partitionBy("_s", "_b").orderBy("_at")))
    limits = (ranked.join(edges, ["_s", "_b", "_r"]).groupBy("_s")
              .agg(*[F.max(F.when(F.col("_i") == i, F.col("_at"))).alias(f"_l{i}") for i in range(len(fractions))]))
    joined = keyed.join(small(limits), "_s", "left")
    piece = F.lit(names[-1])
    for i in reversed(range(len(fractions))):
        piece = F.when(F.col("_at") <= F.col(f"_l{i}"), names[i]).otherwise(piece)
    return joined.select(*df.columns, piece.alias(into))


def stratified_split(df: DataFrame, key: str, strategy: str = "label_data_type", val: float = 0.15,
                     test: float = 0.15, seed: int = 42) -> DataFrame:
    """Add ``split``: ``train``, ``val`` or ``test``.

    If the chosen strata are too small for the second cut, that cut uses the
    label alone.
    """
    if val <= 0 or test <= 0 or val + test >= 1:
        raise ValueError("val and test must be > 0 and sum to < 1")
    wanted = strategy_columns(df, strategy)
    narrow = written(df.select(key, *dict.fromkeys(wanted + ["label_id"])), "strata")
    columns, strata, roomy = usable_strata(narrow, wanted, 1 - val - test)
    if roomy or columns == ["label_id"]:
        return cut(df, columns, key, [1 - val - test, 1 - test], ["train", "val", "test"], seed, strata=strata, narrow=narrow)
    first = cut(df, columns, key, [1 - val - test], ["train", "rest"], seed, strata=strata, narrow=narrow)
    second = cut(first.filter("split = 'rest'").drop("split"), ["label_id"], key, [val / (val + test)],
                 ["val", "test"], seed, strata=3)
    return first.filter("split = 'train'").unionByName(second)
