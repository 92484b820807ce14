"""Predicates and row filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.parse import naive_time
from tidemark.functions.text import clean_post, hashtags, is_blank, is_post_code, validity

IMPORTANT = ["high", "critical"]
OPEN = ["new", "pending"]


def live(df: DataFrame) -> DataFrame:
    """Rows that are not soft-deleted."""
    return df.filter(F.col("deleted_at").isNull())


def text_search(query: str, columns: Sequence[str] = ("content", "normalized_content")) -> Column:
    """Case-insensitive substring match in any of the columns."""
    hit = F.lit(False)
    for name in columns:
        hit = hit | F.col(name).ilike(f"%{query}%")
    return hit


def select_news(df: DataFrame, search: str | None = None, source_id: int | None = None,
                status: str | None = None, topic: str | None = None, importance: str | None = None,
                voted_label: int | None = None, date_from: datetime | None = None,
                date_to: datetime | None = None, columns: Sequence[str] = ("content", "normalized_content")) -> DataFrame:
    """Live items that meet every condition that is given; dates are inclusive."""
    equal: Mapping[str, object] = {
        "source_id": source_id or None, "status": status or None, "topic": topic or None,
        "importance_level": importance or None, "voted_label": voted_label}
    conditions = [F.col(name) == value for name, value in equal.items() if value is not None]
    if search:
        conditions.append(text_search(search, columns))
    created = F.col("created_at")
    if date_from:
        conditions.append(created >= naive_time(date_from))
    if date_to:
        conditions.append(created <= naive_time(date_to))
    out = live(df)
    for condition in conditions:
        out = out.filter(condition)
    return out


def longer_than(df: DataFrame, column: str, length: int = 20) -> DataFrame:
    """Rows whose text is longer than ``length``; null never is."""
    return df.filter(F.length(F.coalesce(F.col(column), F.lit(""))) > length)


def with_clean_text(df: DataFrame, text: str = "content") -> DataFrame:
    """Add ``content_clean``, ``is_valid`` and ``invalid_reason``."""
    cleaned = df.withColumn("content_clean", clean_post(F.col(text)))
    judged = cleaned.withColumn("_v", validity(F.col("content_clean")))
    return judged.select(
        *cleaned.columns, F.col("_v.is_valid").alias("is_valid"), F.col("_v.reason").alias("invalid_reason"))


def unprocessed(df: DataFrame, column: str = "content_clean") -> DataFrame:
    return df.filter(F.col(column).isNull())


def not_in_store(df: DataFrame, store: DataFrame, key: Column, store_key: Column) -> DataFrame:
    """Rows whose key the store does not hold."""
    known = store.select(store_key.alias("_known")).distinct()
    return df.join(known, key == F.col("_known"), "left_anti")


def with_hashtag_kind(df: DataFrame, text: str) -> DataFrame:
    """Add ``has_any`` (any hashtag) and ``has_real`` (one that is no post code)."""
    tagged = df.withColumn("_tags", hashtags(F.col(text)))
    return tagged.select(
        *df.columns, (F.size("_tags") > 0).alias("has_any"),
        F.exists("_tags", lambda t: ~is_post_code(t)).alias("has_real"))


def real_hashtag_rows(df: DataFrame, text: str) -> DataFrame:
    return with_hashtag_kind(df, text).filter("has_real").drop("has_any", "has_real")


def hashtag_counters(df: DataFrame, text: str) -> DataFrame:
    """Rows in total, with any hashtag, kept, and with post codes only."""
    return with_hashtag_kind(df, text).agg(
        F.count("*").alias("total_rows"), F.count_if("has_any").alias("any_rows"),
        F.count_if("has_real").alias("kept_rows"),
        F.count_if(F.col("has_any") & ~F.col("has_real")).alias("ignored_only_rows"))


def missing_label(df: DataFrame, label: str, key: str = "id") -> DataFrame:
    """Rows that have a key but no label."""
    return df.filter(~is_blank(F.col(key)) & is_blank(F.col(label)))


def comparable(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.filter(~is_blank(F.col(a)) & ~is_blank(F.col(b)))
