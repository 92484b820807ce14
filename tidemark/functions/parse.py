"""Parsing of counts, times and keys."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import squash, strip_space


def parse_count(text: Column) -> Column:
    """``1.2K`` to 1200, ``3 trieu`` to 3000000, ``12 binh luan`` to 12.

    A comma counts as a point. The unit is read directly after the number, so a
    later word that merely holds the letter does not scale the value.
    """
    clean = strip_space(F.replace(text.cast("string"), F.lit(","), F.lit(".")))
    number = F.regexp_extract(clean, r"([\d.]+)", 1).try_cast("double")
    unit = F.lower(F.regexp_extract(clean, r"(?iU)[\d.]+\s*(ngan|trieu|[km])(?!\w)", 1))
    scale = F.when(unit.isin("k", "ngan"), 1e3).when(unit.isin("m", "trieu"), 1e6).otherwise(1.0)
    return (number * scale).cast("bigint")


def parse_digits(text: Column) -> Column:
    """All digits joined into one number; none gives null."""
    return F.nullif(F.regexp_replace(text.cast("string"), F.lit(r"\D"), F.lit("")), F.lit("")).try_cast("bigint")


def parse_timestamp(text: Column) -> Column:
    """``yyyy-MM-dd[ |T]HH:mm:ss`` or ``yyyy-MM-dd`` over the first 19 characters."""
    head = F.substring(strip_space(text.cast("string")), 1, 19)
    forms = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd"]
    return F.coalesce(*[F.try_to_timestamp(head, F.lit(f)) for f in forms]).cast("timestamp_ntz")


def naive_time(value: datetime) -> Column:
    """A literal without time zone, whatever the zones of session and process."""
    return F.lit(str(value)).cast("timestamp_ntz")


def content_hash(*parts: Column) -> Column:
    """sha256 over the parts joined by a bar; a null part counts as empty."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.sha2(F.concat_ws("|", *texts), 256)


def post_hash(source_url: Column, external_id: Column, text: Column, posted_at: Column) -> Column:
    return content_hash(source_url, external_id, text, posted_at)


def comment_hash(post_key: Column, text: Column) -> Column:
    return content_hash(post_key, text)


def text_key(text: Column) -> Column:
    """Key under which two texts are exact duplicates."""
    return F.lower(squash(text))


def record_key(data_type: Column, row_id: Column) -> Column:
    return F.concat_ws(":", data_type, row_id.cast("string"))


def clean_id(value: Column) -> Column:
    """Collapsed text; an integer written as ``12.0`` loses its fraction."""
    return F.regexp_replace(squash(value.cast("string")), F.lit(r"^(\d+)\.0$"), F.lit("$1"))
