"""Profiles, dashboard figures, distributions and vocabularies."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import lexicon as lex
from tidemark.functions.text import is_blank, words
from tidemark.operators.columns import importance_name, label_bucket, topic_name
from tidemark.operators.filters import IMPORTANT, OPEN, live


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts per value with ``<NA>`` and ``<BLANK>`` buckets."""
    c = F.col(column)
    shown = F.when(c.isNull(), "<NA>").when(is_blank(c), "<BLANK>").otherwise(F.trim(c.cast("string")))
    return df.groupBy(shown.alias("value")).count()


def column_profile(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Rows, distinct non-null values and missing or blank rows per column."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    figures = df.agg(F.count("*").alias("_rows"), *[
        x for c in columns for x in (distinct(c).alias("_d_" + c), F.count_if(is_blank(F.col(c))).alias("_m_" + c))])
    entry = lambda c: F.struct(F.lit(c).alias("column"), F.col("_rows").alias("rows"),
                               F.col("_d_" + c).alias("unique_values"), F.col("_m_" + c).alias("missing_or_blank"))
    return figures.select(F.explode(F.array(*[entry(c) for c in columns])).alias("e")).select("e.*")


def empty_results(df: DataFrame, has_result: Column) -> DataFrame:
    """One row: the rows without a result, and all rows; a row of which it is not known (null) is not counted as empty."""
    return df.agg(F.count_if(~has_result).alias("empty_rows"), F.count("*").alias("rows"))


def summary(news: DataFrame, today: date) -> DataFrame:
    """Total, today, important, pending and analysed items in one pass."""
    return live(news).agg(
        F.count("*").alias("total"),
        F.count_if(F.to_date("created_at") == F.lit(today)).alias("today"),
        F.count_if(F.col("importance_level").isin(IMPORTANT)).alias("important"),
        F.count_if(F.col("status").isin(OPEN)).alias("pending"),
        F.count_if(F.col("voted_label").isNotNull()).alias("analyzed"))


def trend(news: DataFrame, today: date, days: int = 14, fill: bool = False) -> DataFrame:
    """Items per day over the trailing days; with ``fill`` empty days count zero."""
    first = F.date_sub(F.lit(today), days - 1)
    recent = live(news).filter(F.col("created_at") >= first.cast("timestamp_ntz"))
    counts = recent.groupBy(F.to_date("created_at").alias("day")).count()
    if not fill:
        return counts.orderBy("day")
    calendar = news.sparkSession.range(1).select(F.explode(F.sequence(first, F.lit(today))).alias("day"))
    return calendar.join(counts, "day", "left").select("day", F.coalesce("count", F.lit(0)).alias("count")).orderBy("day")


def distributions(news: DataFrame) -> DataFrame:
    """Counts by topic, importance and voted label, null buckets named."""
    parts = F.explode(F.array(
        F.struct(F.lit("topics").alias("kind"), topic_name(F.col("topic")).alias("name")),
        F.struct(F.lit("importance").alias("kind"), importance_name(F.col("importance_level")).alias("name")),
        F.struct(F.lit("sentiments").alias("kind"), label_bucket(F.col("voted_label")).alias("name"))))
    counts = live(news).groupBy("topic", "importance_level", "voted_label").count()
    return (counts.select(parts.alias("p"), "count")
            .groupBy("p.kind", "p.name").agg(F.sum("count").alias("value")))


def table_counts(**tables: DataFrame) -> DataFrame:
    """One row per table with its number of rows."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


# --- splits --------------------------------------------------------------------

def split_distribution(df: DataFrame, split: str = "split", label: str = "label_id",
                       classes: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """Count and share per split and class; classes without rows count zero."""
    counts = df.groupBy(split).agg(F.count("*").alias("_n"), *[
        F.count_if(F.col(label) == c).alias(f"_{c}") for c in classes])
    entry = lambda c: F.struct(
        F.lit(c).alias("label_id"), F.lit(lex.LABEL_NAMES_VI[c]).alias("label_name"), F.col(f"_{c}").alias("count"),
        (F.col(f"_{c}") / F.greatest(F.col("_n"), F.lit(1))).alias("ratio"))
    return counts.select(split, F.explode(F.array(*[entry(c) for c in classes])).alias("e")).select(split, "e.*")


def split_distribution_by(df: DataFrame, extra: str, split: str = "split", label: str = "label_id") -> DataFrame:
    """Count per split, extra column and class."""
    from tidemark.functions.labels import label_name_vi

    return df.groupBy(split, extra, label).count().withColumn("label_name", label_name_vi(F.col(label)))


def length_summary(df: DataFrame, text: str, split: str = "split") -> DataFrame:
    """Word and character length statistics per split.

    Lengths are counted first, so quantiles and deviations from the mean run
    over distinct lengths only.
    """
    units = F.explode(F.array(
        F.struct(F.lit("words").alias("unit"), F.size(words(F.col(text))).alias("size")),
        F.struct(F.lit("chars").alias("unit"), F.length(text).alias("size"))))
    sizes = df.select(split, units.alias("u")).groupBy(split, "u.unit", "u.size").agg(F.count("*").alias("n"))
    n, s = F.col("n"), F.col("size")
    total = F.sum(n).cast("double")
    means = sizes.groupBy(F.col(split).alias("_split"), F.col("unit").alias("_unit")).agg((F.sum(n * s) / total).alias("mean"))
    same = F.col(split).eqNullSafe(F.col("_split")) & (F.col("unit") == F.col("_unit"))
    return sizes.join(means, same).groupBy(split, "unit").agg(
        F.sum(n).alias("count"), F.first("mean").alias("mean"),
        F.sqrt(F.sum(n * (s - F.col("mean")) * (s - F.col("mean"))) / (total - 1)).alias("std"),
        F.min(s).alias("min"), F.percentile(s, 0.5, n).alias("median"),
        F.max(s).alias("max"), F.percentile(s, 0.95, n).alias("p95"))


def length_sketches(df: DataFrame, text: str, by: list[str], k: int = 800) -> DataFrame:
    """Word and character lengths of each group as KLL sketches, to be stored per day or batch and merged later."""
    sizes = F.explode(F.array(
        F.struct(F.lit("words").alias("unit"), F.size(words(F.col(text))).cast("bigint").alias("size")),
        F.struct(F.lit("chars").alias("unit"), F.length(text).cast("bigint").alias("size"))))
    return df.filter(F.col(text).isNotNull()).select(*by, sizes.alias("u")).groupBy(*by, "u.unit").agg(
        F.kll_sketch_agg_bigint("u.size", k).alias("sketch"))


def merged_lengths(sketches: DataFrame, by: list[str], k: int = 800) -> DataFrame:
    """``count, median, p95`` per group and unit from stored sketches; ranks are within 0.5 % at ``k`` 800."""
    merged = sketches.groupBy(*by, "unit").agg(F.kll_merge_agg_bigint("sketch", k).alias("s"))
    quantile = lambda q: F.kll_sketch_get_quantile_bigint("s", F.lit(q))
    return merged.select(*by, "unit", F.kll_sketch_get_n_bigint("s").alias("count"), quantile(0.5).alias("median"), quantile(0.95).alias("p95"))


# --- vocabulary ----------------------------------------------------------------

def vocabulary(df: DataFrame, text: str, order: str, max_size: int = 30000, min_count: int = 2,
               tokens=words) -> DataFrame:
    """``token, id, freq`` of the most frequent tokens; 0 and 1 are pad and unknown.

    Ties keep the token that is seen first. Only the kept tokens, at most
    ``max_size``, are numbered.
    """
    seen = df.select(F.col(order).alias("_row"), F.posexplode(tokens(F.col(text))).alias("_pos", "token"))
    # one decimal for row and position keeps the aggregate hash-based (a struct would sort all tokens)
    place = F.col("_row").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("_pos")
    counts = seen.groupBy("token").agg(F.count("*").alias("freq"), F.min(place).alias("first"))
    kept = (counts.filter((F.col("freq") >= min_count) & ~F.col("token").isin(lex.PAD, lex.UNK))
            .orderBy(F.col("freq").desc(), "first").limit(max(0, max_size - 2)))
    rank = F.row_number().over(Window.orderBy(F.col("freq").desc(), "first"))
    return kept.select("token", (rank + 1).cast("int").alias("id"), "freq")


def encode(df: DataFrame, key: str, text: str, vocab: DataFrame, max_length: int = 128, tokens=words) -> DataFrame:
    """``key, ids, length``: padded ids of the first ``max_length`` tokens.

    The vocabulary has at most its own size cap of rows, so every task looks the
    tokens up in a broadcast copy and no row moves.
    """
    known = df.sparkSession.sparkContext.broadcast({r["token"]: r["id"] for r in vocab.select("token", "id").collect()})

    @F.arrow_udf("array<int>")
    def look_up(heads: pa.Array) -> pa.Array:
        ids = [known.value.get(t, 1) for t in heads.flatten().to_pylist()]
        ends = np.cumsum([0, *pc.fill_null(pc.list_value_length(heads), 0).to_pylist()])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))

    coded = df.select(key, look_up(F.slice(tokens(F.col(text)), 1, max_length)).alias("_e"))
    pad = F.array_repeat(F.lit(0), F.lit(max_length) - F.size("_e"))
    return coded.select(key, F.concat("_e", pad).alias("ids"), F.greatest(F.size("_e"), F.lit(1)).alias("length"))
