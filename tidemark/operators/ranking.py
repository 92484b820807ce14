"""Numbering, running values, top rows and samples that never gather one big group.

A window over a hot key (or over no key at all) would send its whole group to
one task. ``prefix_scan`` cuts each group into ordered buckets, scans inside the
buckets in parallel, and adds the totals of the earlier buckets. Those totals are
one small row per bucket and are scanned the same way, so sparse orders with
very many buckets are safe too.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import written

BUCKET_BITS = 20
TOP_BITS = 22


def integer_bucket(order: Column, bits: int = BUCKET_BITS) -> Column:
    """Bucket of a unique integer order: at most ``2**bits`` rows each."""
    return F.shiftright(order.cast("bigint"), bits)


def digest(key: Column, seed: int | str) -> Column:
    """Hex text that orders rows by a seeded hash of their key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def digest_bucket(hashed: Column, digits: int = 4) -> Column:
    """Bucket of a hashed order: its first hex digits."""
    return F.substring(hashed, 1, digits)


def pack(names: Sequence[str], *more: Column) -> Column:
    """One key column over several; null parts compare as equal."""
    return F.struct(*[F.col(n) for n in names], *more) if names or more else F.struct(F.lit(0).alias("all"))


def prefix_scan(df: DataFrame, by: Sequence[str], order: Sequence[str], bucket: Column,
                sums: Mapping[str, Column] | None = None, maxima: Mapping[str, Column] | None = None,
                exclusive: bool = False, nested: bool = True) -> DataFrame:
    """Running sums and maxima within ``by`` in the given order.

    ``bucket`` is an integer that does not decrease along the order; with
    ``exclusive`` a row's own value is left out. One shuffle of the rows, by group
    and bucket; the totals are joined on the same keys.

    With 64-bit orders a bucket holds at most ``2**BUCKET_BITS`` rows, a bucket of
    totals ``2**TOP_BITS``, and so does the last scan over those.
    """
    sums, maxima = dict(sums or {}), dict(maxima or {})
    group, place = ("_group", "_place") if nested else ("_group2", "_place2")
    keyed = df.withColumn(group, pack(by, bucket.alias(place)))
    running = Window.partitionBy(group).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1 if exclusive else 0)
    local = keyed.select(
        "*", *[F.sum(c).over(running).alias(n) for n, c in sums.items()],
        *[F.max(c).over(running).alias(n) for n, c in maxima.items()])
    totals = keyed.groupBy(group).agg(
        *[F.sum(c).alias("_t_" + n) for n, c in sums.items()],
        *[F.max(c).alias("_t_" + n) for n, c in maxima.items()])
    flat = totals.select(F.col(group).alias(group + "_of"), F.col(f"{group}.{place}").alias(place),
                         *[F.col(f"{group}.{b}").alias(b) for b in by], *["_t_" + n for n in [*sums, *maxima]])
    before = {"_o_" + n: F.col("_t_" + n) for n in sums}, {"_o_" + n: F.col("_t_" + n) for n in maxima}
    if nested:
        offsets = prefix_scan(flat, by, [place], F.shiftright(place, TOP_BITS), *before, exclusive=True, nested=False)
    else:
        earlier = Window.partitionBy(*by).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
        offsets = flat.select(group + "_of", *[F.sum(c).over(earlier).alias(n) for n, c in before[0].items()],
                              *[F.max(c).over(earlier).alias(n) for n, c in before[1].items()])
    offsets = offsets.select(group + "_of", *["_o_" + n for n in [*sums, *maxima]])
    joined = local.join(offsets, F.col(group) == F.col(group + "_of"), "left")
    total = lambda n: F.coalesce(F.col(n), F.lit(0)) + F.coalesce(F.col("_o_" + n), F.lit(0))
    return joined.select(
        *df.columns, *[total(n).alias(n) for n in sums],
        *[F.greatest(F.col(n), F.col("_o_" + n)).alias(n) for n in maxima])


def numbered(df: DataFrame, order: str, by: Sequence[str] = (), name: str = "row_no",
             bits: int = BUCKET_BITS) -> DataFrame:
    """1-based number within ``by`` along a unique integer column."""
    return prefix_scan(df, by, [order], integer_bucket(F.col(order), bits), {name: F.lit(1).cast("bigint")})


def occurrence(df: DataFrame, key: str, order: str, name: str = "occurrence") -> DataFrame:
    """0-based occurrence number of each key along a unique integer column."""
    out = numbered(df, order, [key], name)
    return out.withColumn(name, F.col(name) - 1)


def duplicate_flag(df: DataFrame, keys: Sequence[str], name: str = "is_duplicate") -> DataFrame:
    """Whether a row's key occurs more than once; keys travel as 256-bit hashes."""
    keyed = df.withColumn("_key", F.sha2(F.to_json(F.struct(*[F.col(k) for k in keys])), 256))
    counts = keyed.groupBy("_key").agg((F.count("*") > 1).alias(name))
    return keyed.join(counts, "_key").select(*df.columns, name)


def chunked(df: DataFrame, order: str, size: int, name: str = "part", by: Sequence[str] = ()) -> DataFrame:
    """1-based number of the fixed-size chunk a row falls into."""
    if size <= 0:
        raise ValueError("chunk size must be greater than 0")
    out = numbered(df, order, by, "_row_no")
    return out.withColumn(name, (F.floor((F.col("_row_no") - 1) / size) + 1).cast("bigint")).drop("_row_no")


def duplicate_streaks(df: DataFrame, by: Sequence[str], order: str, is_known: Column,
                      threshold: int = 10, carried: DataFrame | None = None) -> DataFrame:
    """Run length of known rows up to each row; rows after the first run that
    reaches ``threshold`` are cut. A new row resets the run.

    ``carried`` continues an earlier input: ``by``, ``streak`` and ``stopped``,
    one row per group. The numbered rows and the runs are written once each, since
    later steps read them several times; pass only the columns that are needed.
    """
    flagged = df.withColumns({"_new": F.when(is_known, 0).otherwise(1), "_key": pack(by)})
    counted = written(numbered(flagged, order, ["_key"], "_n"), "streak-rows")
    runs = prefix_scan(counted, ["_key"], [order], integer_bucket(F.col(order)),
                       maxima={"_last_new": F.when(F.col("_new") == 1, F.col("_n")).otherwise(0)})
    streak = F.col("_n") - F.col("_last_new")
    if carried is not None:
        before = carried.select(pack(by).alias("_key"), F.col("streak").alias("_carry"), "stopped")
        runs = runs.join(before, "_key", "left").filter(~F.coalesce("stopped", F.lit(False)))
        streak = streak + F.when(F.col("_last_new") == 0, F.coalesce("_carry", F.lit(0))).otherwise(0)
    runs = written(runs.withColumn("streak", streak).select(*df.columns, "_key", "_n", "streak"), "streak-runs")
    stops = runs.filter(F.col("streak") == threshold).groupBy("_key").agg(F.min("_n").alias("_stop"))
    kept = runs.join(stops, "_key", "left").filter(F.col("_stop").isNull() | (F.col("_n") <= F.col("_stop")))
    return kept.select(*df.columns, "streak")


# --- sorting, pages, samples --------------------------------------------------

SORTABLE = ("created_at", "posted_at", "importance_level", "voted_label")


def sort_keys(spec: str, tie: str = "id", default: str = "created_at") -> list[Column]:
    """``-column`` sorts down; a column that is not allowed falls back to the default."""
    name = spec.lstrip("-")
    column = F.col(name if name in SORTABLE else default)
    return [column.desc() if spec.startswith("-") else column.asc(), F.col(tie).asc()]


def page(df: DataFrame, spec: str = "-created_at", number: int = 1, size: int = 20, tie: str = "id") -> DataFrame:
    """One page in sort order; the sort keeps only the rows up to the page's end."""
    return df.orderBy(*sort_keys(spec, tie)).offset((number - 1) * size).limit(size)


def page_with_total(df: DataFrame, spec: str = "-created_at", number: int = 1, size: int = 20,
                    tie: str = "id") -> tuple[DataFrame, DataFrame]:
    """The page and a one-row frame with the number of matching rows."""
    return page(df, spec, number, size, tie), df.agg(F.count("*").alias("total"))


def newest(df: DataFrame, order: str, limit: int, tie: str = "id") -> DataFrame:
    return df.orderBy(F.col(order).desc(), F.col(tie).desc()).limit(limit)


def audit_sample(df: DataFrame, key: str, size: int = 200, seed: int = 42, verdict: str = "dung_khong") -> DataFrame:
    """At most ``size`` rows in seeded hash order with a blank verdict column.

    Only keys are sorted; the chosen ones (at most ``size``, so broadcast) pick their rows.
    """
    chosen = df.select(key).orderBy(digest(F.col(key), seed), key).limit(size)
    return df.join(F.broadcast(chosen), key, "left_semi").withColumn(verdict, F.lit(""))


def stratified_sample(df: DataFrame, key: str, label: str, size: int = 1000, classes: int = 3,
                      seed: int = 42, verdicts: Sequence[str] = ("nhan_dung_khong", "nhan_dung_neu_sai")) -> DataFrame:
    """At most ``size / classes`` rows per label in seeded hash order; keys must be unique.

    Counts per label and digest prefix tell which prefixes hold the first rows;
    only the keys of these are ranked, and rows are picked by key at the end.
    """
    each = max(1, size // classes)
    narrow = df.select(key, label, digest(F.col(key), seed).alias("_digest")).withColumn("_bucket", digest_bucket(F.col("_digest")))
    earlier = Window.partitionBy(label).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = (narrow.groupBy(label, "_bucket").agg(F.count("*").alias("_n"))
             .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).filter(F.col("_before") < each)
             .select(F.col(label).alias("_l"), F.col("_bucket").alias("_b")))
    near = narrow.join(first, F.col(label).eqNullSafe(F.col("_l")) & (F.col("_bucket") == F.col("_b")), "left_semi")
    rank = F.row_number().over(Window.partitionBy(label).orderBy("_digest", key))
    picked = df.join(near.withColumn("_rank", rank).filter(F.col("_rank") <= each).select(key), key, "left_semi")
    for verdict in verdicts:
        picked = picked.withColumn(verdict, F.lit(""))
    return picked
