"""Work lists for labelling and resuming from earlier output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.labels import is_unfinished, repaired_status
from tidemark.functions.text import squash
from tidemark.operators.ranking import numbered

OUTPUTS = {"sentiment_label": "string", "sentiment_score": "double", "sentiment_raw_label": "string",
           "sentiment_raw_scores": "string", "status": "string"}


def with_outputs(df: DataFrame) -> DataFrame:
    """Add missing output columns and repair the status."""
    for name, kind in OUTPUTS.items():
        value = F.col(name) if name in df.columns else F.lit(None)
        empty = F.lit(0.0) if kind == "double" else F.lit("")
        df = df.withColumn(name, F.coalesce(value.try_cast(kind), empty))
    return df.withColumn("status", repaired_status(F.col("status"), F.col("sentiment_raw_label")))


def _work(df: DataFrame, order: str, text: str, start: int = 0, limit: int | None = None,
          min_length: int = 1, again: bool = False) -> DataFrame:
    """``order, work`` of each row; texts are measured where they are and do not move."""
    narrow = df.select(order, is_unfinished(F.col("status"), again).alias("_open"), (F.length(squash(F.col(text))) < min_length).alias("_short"))
    placed = numbered(narrow, order, name="_no")
    todo = (F.col("_no") > start) & F.col("_open")
    if limit is not None:
        todo = todo & (F.col("_no") <= start + limit)
    return placed.select(order, F.when(todo & F.col("_short"), "skip").when(todo, "label").alias("work"))


def mark_work(df: DataFrame, order: str, text: str, **window) -> DataFrame:
    """Add ``work``: ``label``, ``skip`` (too short) or null (finished or outside the window).

    The window is ``start`` and ``limit`` in rows, with ``min_length`` and ``again``.
    """
    return df.join(_work(df, order, text, **window), order)


def work_batches(df: DataFrame, order: str, text: str, size: int = 30, **window) -> DataFrame:
    """Rows to label, packed into requests of at most ``size`` entries; keys are numbered, then texts joined once."""
    keys = _work(df, order, text, **window).filter(F.col("work") == "label").select(order)
    placed = numbered(keys, order, name="_n").join(df.select(order, squash(F.col(text)).alias("text")), order)
    batch = F.floor((F.col("_n") - 1) / size).alias("batch_no")
    item = F.struct(F.col(order).alias("row_id"), "text")
    return placed.groupBy(batch).agg(F.sort_array(F.collect_list(item)).alias("items"))


def resume(df: DataFrame, previous: DataFrame | None, key: str) -> DataFrame:
    """Take outputs over from an earlier run of the same size, matched by key."""
    if previous is None or previous.count() != df.count():
        return with_outputs(df)
    have = [c for c in OUTPUTS if c in previous.columns]
    plain = df.drop(*have)
    return with_outputs(plain.join(previous.select(key, *have), key, "left"))


def apply_predictions(df: DataFrame, predictions: DataFrame, key: str, names: Sequence[str] = tuple(OUTPUTS)) -> DataFrame:
    """Write predictions over the rows they belong to."""
    new = predictions.select(key, *[F.col(n).alias("_n_" + n) for n in names], F.lit(True).alias("_hit"))
    joined = df.join(new, key, "left")
    return joined.select(*[
        F.when(F.col("_hit"), F.col("_n_" + c)).otherwise(F.col(c)).alias(c) if c in names else F.col(c)
        for c in df.columns])
