"""Joins by keys of which a few may hold most rows, and rows told apart by their place in files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import written

SHARE = 1000  # a key with more than a thousandth of all rows is hot, so there are less than 1,000 of them


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Inner join of ``left`` with ``right``, one row a key, where ``count`` is the key's number of rows in ``left``.

    ``total`` is the sum of the counts. Hot keys are less than 1,000 by
    definition, so their rows of ``right`` are broadcast; no other key has more
    than a thousandth of the rows, so those are joined by a shuffle.
    ``left`` is read twice and should be a written table.
    """
    hot = right.filter(F.col(count) * SHARE > total)
    cold = right.filter(F.col(count) * SHARE <= total)
    some = F.broadcast(hot.select(*keys))
    rest = left.join(some, keys, "left_anti").join(cold, keys)
    return left.join(F.broadcast(hot), keys).unionByName(rest)


def with_place(rows: DataFrame) -> DataFrame:
    """The rows with ``__file`` and ``__row``, their place in Parquet files, which no later job can change.

    Rows that are not read from Parquet as they are get written once.
    """
    if rows._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation":
        try:
            return rows.select("*", F.xxhash64("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
        except AnalysisException:  # another format
            pass
    return with_place(written(rows, "rows"))
