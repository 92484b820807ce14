"""Union of differently shaped sources into the canonical labelled table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.normalize import plain_text, plain_value
from tidemark.functions.parse import clean_id
from tidemark.functions.text import strip_space
from tidemark.operators.columns import find_column, with_record_key
from tidemark.operators.joins import map_labels
from tidemark.operators.ranking import numbered

TEXT_NAMES = ["content_anonymized", "sentences", "sentence", "content"]
LABEL_NAMES = ["label", "sentiment", "emotion", "cảm xúc", "cam xuc"]
CANONICAL = ["data_types", "record_key", "id", "content_anonymized", "emotion", "label"]
POSITION_BITS = 8
SQL_SPACES = " \t\n\f\r"


def tag_union(parts: Mapping[str, DataFrame], tag: str = "data_type") -> DataFrame:
    """Union by name with the name of each part as a column."""
    out = None
    for name, df in parts.items():
        one = df.withColumn(tag, F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def positions(df: DataFrame, order: str, name: str) -> DataFrame:
    """1-based position along an integer order; equal orders share theirs out, missing ones come last.

    Rows move once, with their texts, so buckets are small: 256 values of the order.
    """
    placed = df.withColumn("_place_of", F.coalesce(F.col(order).cast("bigint"), F.lit(2**63 - 1)))
    return numbered(placed, "_place_of", (), name, POSITION_BITS).drop("_place_of")


def canonical_rows(source: str, df: DataFrame, rules: DataFrame, order: str, otherwise: str | None = None) -> DataFrame | None:
    """Six canonical columns of one source; None when it has no text or label column.

    A blank text and an unknown label are errors; a blank id is replaced by the position. With ``otherwise`` no row is an error:
    texts only lose SQL's white space and may be blank or missing, own ids stay as they are, and an unknown label stays as its
    code, with ``otherwise`` as emotion. ``order`` is the integer row order of the source.
    """
    text, label = find_column(df, TEXT_NAMES), find_column(df, LABEL_NAMES)
    if not text or not label:
        return None
    strict, has_id = otherwise is None, "id" in df.columns
    if strict:
        content = strip_space(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
        content = F.when(content == "", F.raise_error(F.lit(f"Blank content in {source}"))).otherwise(content)
    else:
        content = F.btrim(F.col(f"`{text}`").cast("string"), F.lit(SQL_SPACES))
    own = [F.col("id").cast("string").alias("_own")] if has_id else []
    placed = df.select(F.col(f"`{order}`").alias("_order"), content.alias("_content"), F.col(f"`{label}`").cast("string").alias("_value"), *own,
                       *[c for c in ("data_types", "record_key") if c in df.columns])
    if strict or not has_id:
        placed = positions(placed, "_order", "_position")
    position = F.col("_position").cast("string") if "_position" in placed.columns else None
    if has_id:
        row_id = F.when(clean_id(F.col("_own")) == "", position).otherwise(clean_id(F.col("_own"))) if strict else F.col("_own")
    else:
        row_id = position
    coded = plain_text(label) == "label"
    known = rules.select(F.col("label").alias("raw"), "emotion", "label").distinct() if coded else rules
    key = clean_id(F.col("_value")) if coded else plain_value(F.col("_value"))
    unknown = None if strict else {"_emotion": F.lit(otherwise), "_label": F.when(F.col("_value").isNotNull(), clean_id(F.col("_value")))}
    mapped = map_labels(placed.withColumn("_row_id", row_id), "_value", known, key, "raw", {"emotion": "_emotion", "label": "_label"}, unknown)
    keyed = with_record_key(mapped, F.lit(source), F.coalesce("_row_id", F.lit("")))
    return keyed.select("data_types", "record_key", F.col("_row_id").alias("id"), F.col("_content").alias("content_anonymized"),
                        F.col("_emotion").alias("emotion"), F.col("_label").alias("label"))


def harmonize(sources: Mapping[str, DataFrame], rules: DataFrame, order: str = "row_order", otherwise: str | None = None) -> DataFrame:
    """Canonical rows of all sources that have a text and a label column; ``otherwise`` as in ``canonical_rows``."""
    parts = [p for n, df in sources.items() if (p := canonical_rows(n, df, rules, order, otherwise)) is not None]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
