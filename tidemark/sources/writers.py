"""Writers: tables, numbered chunks, reports, nested batches and split manifests."""

from __future__ import annotations

import json
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import lexicon as lex
from tidemark.functions.parse import comment_hash, content_hash, naive_time, parse_digits, parse_timestamp
from tidemark.functions.text import squash
from tidemark.operators.filters import live
from tidemark.operators.joins import children_of
from tidemark.operators.ranking import chunked, newest


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; quotes are doubled, line breaks stay inside quotes."""
    df.write.mode("overwrite").options(header=True, quote='"', escape='"').csv(path)


def label_chunks(df: DataFrame, key: str = "id", text: str = "content_anonymized", size: int = 1000) -> DataFrame:
    """Key, text and an empty label with the number of the chunk to label.

    Only the keys, which are unique, are numbered; the text is joined once.
    """
    placed = chunked(df.select(key), key, size)
    return df.select(key, text).join(placed, key).select(
        key, text, F.lit("").alias("label"), F.format_string("%03d", "part").alias("part"))


def write_label_chunks(df: DataFrame, path: str, **options) -> None:
    """One folder per numbered chunk."""
    parts = label_chunks(df, **options)
    parts.repartition("part").write.mode("overwrite").options(
        header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).partitionBy("part").csv(path)


def write_json_report(report: DataFrame, path: str) -> None:
    """One JSON object per row (reports are small aggregates)."""
    report.select(F.to_json(F.struct(*report.columns)).alias("value")).repartition(1).write.mode("overwrite").text(path)


def report_rows(news: DataFrame, date_from: datetime | None = None, date_to: datetime | None = None) -> DataFrame:
    """Live items of the period, newest first, under the report's headings."""
    rows = live(news)
    if date_from:
        rows = rows.filter(F.col("created_at") >= naive_time(date_from))
    if date_to:
        rows = rows.filter(F.col("created_at") <= naive_time(date_to))
    ordered = rows.orderBy(F.col("created_at").desc(), F.col("id").desc())
    return ordered.select(*[F.col(c).alias(h) for c, h in lex.REPORT_COLUMNS.items()])


def write_report(news: DataFrame, folder: str, report_id: int, **period) -> DataFrame:
    """Write the extract and two ledger rows: running, then completed with the path."""
    spark = news.sparkSession
    ledger, path = f"{folder}/ledger", f"{folder}/ctsv_report_{report_id}"

    def log(step: int, status: str, where: str | None) -> None:
        row = [(report_id, step, status, where)]
        spark.createDataFrame(row, "report_id long, step int, status string, file_path string").write.mode(
            "overwrite").parquet(f"{ledger}/report={report_id}/step={step}")

    log(0, "running", None)
    write_csv(report_rows(news, **period), path)
    log(1, "completed", path)
    return latest_reports(spark, folder)


def latest_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Newest state of each report."""
    schema = "report_id long, status string, file_path string, report int, step int"
    rows = spark.read.option("basePath", f"{folder}/ledger").schema(schema).parquet(f"{folder}/ledger")
    return rows.groupBy("report_id").agg(F.max_by(F.struct("status", "file_path"), "step").alias("s")).select("report_id", "s.*")


def build_batch(posts: DataFrame, comments: DataFrame, source_url: str, batch_id: str, limit: int = 500,
                clean=lambda c: c, chunk: int = 1000) -> DataFrame:
    """Payload rows of the newest posts: parsed figures, hashes and comment arrays.

    Blank posts are dropped. A post with more than ``chunk`` comments is carried
    by several rows with the same hash, which ingest merges again.
    """
    top = newest(posts, "id", limit)
    cleaned = comments.withColumn("content", clean(F.col("content")))
    notes = cleaned.withColumn("normalized_content", squash(F.col("content"))).withColumn(
        "content_hash", comment_hash(F.col("post_id"), F.col("normalized_content")))
    fields = ["content", "normalized_content", "collected_at", "content_hash"]
    rows = children_of(top, notes, "id", "post_id", "comment_id", fields, "comments", chunk)
    url = F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit(source_url))
    prepared = rows.withColumn("content", clean(F.col("content"))).withColumn("normalized_content", squash(F.col("content")))
    kept = prepared.filter(F.col("normalized_content") != "")
    return kept.select(
        F.lit(batch_id).alias("batch_id"), F.concat(F.lit("local-post-"), F.col("id")).alias("external_id"),
        url.alias("url"), "content", "normalized_content", parse_timestamp(F.col("posted_at")).alias("posted_at"),
        parse_timestamp(F.col("collected_at")).alias("collected_at"),
        parse_digits(F.col("like_count")).alias("like_count"), parse_digits(F.col("comment_count")).alias("comment_count"),
        content_hash(url, F.col("id"), F.col("normalized_content"), F.col("posted_at")).alias("content_hash"),
        F.create_map(F.lit("local_sqlite_id"), F.col("id").cast("string")).alias("raw_payload_json"), "comments", "part")


def write_batches(payload: DataFrame, path: str, source: dict[str, str], rows_per_batch: int = 500) -> None:
    """JSON lines of nested batches, ``rows_per_batch`` rows per line in the mean.

    The parts of a post with very many comments are dealt like other rows.
    """
    total = max(1, -(-payload.count() // rows_per_batch))
    spread = payload.withColumn("_slot", F.pmod(F.xxhash64("content_hash", "part"), F.lit(total)))
    src = F.struct(*[F.lit(v).alias(k) for k, v in source.items()])
    posts = F.struct(*[c for c in payload.columns if c not in ("batch_id", "part")])
    lines = spread.groupBy("batch_id", "_slot").agg(F.collect_list(posts).alias("posts")).select(
        F.concat_ws("-", "batch_id", "_slot").alias("batch_id"), src.alias("source"), "posts")
    lines.write.mode("overwrite").json(path)


# --- saved splits ------------------------------------------------------------------

SPLITS = ("train", "val", "test")


def _exists(spark: SparkSession, path: str) -> bool:
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()).exists(location)


def _published(spark: SparkSession, folder: str) -> tuple[int, str | None]:
    """Number and version of the newest complete pointer of a folder; 0 and nothing if there is none."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/current")
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(root)] if files.exists(root) else []
    numbers = [int(n.split("=")[1]) for n in names if n.startswith("n=") and _exists(spark, f"{folder}/current/{n}/_SUCCESS")]
    if not numbers:
        return 0, None
    return max(numbers), spark.read.text(f"{folder}/current/n={max(numbers)}").first()[0]


def _publish(spark: SparkSession, folder: str, fresh: DataFrame, note: dict[str, str]) -> str:
    """Write splits and manifest as a version of their own, and then the pointer that puts it in force."""
    version = f"version-{uuid.uuid4().hex}"
    for name in SPLITS:
        fresh.filter(F.col("split") == name).write.parquet(f"{folder}/{version}/{name}")
    one = lambda text: spark.createDataFrame([(text,)], "value string").coalesce(1).write
    one(json.dumps(note, sort_keys=True)).text(f"{folder}/{version}/manifest")
    number, _ = _published(spark, folder)
    one(version).mode("overwrite").text(f"{folder}/current/n={number + 1}")
    return version


def saved_or_new_splits(spark: SparkSession, folder: str, make, strategy: str, reload=lambda df: df,
                        rebuild: bool = False, **manifest) -> DataFrame:
    """Splits from ``folder`` if they were saved under the same strategy, else made and saved.

    Each set of splits is a version, which counts once a pointer to it is
    complete: a run that ends in between leaves the earlier set in force, or
    none. A published set that lacks a part, or another strategy, is an error
    unless ``rebuild``. Earlier versions stay, as readers may still follow them.
    ``reload`` cleans and labels rows that come from disk.
    """
    _, version = _published(spark, folder)
    if version is not None and not rebuild:
        found = [s for s in SPLITS if _exists(spark, f"{folder}/{version}/{s}/_SUCCESS")]
        if len(found) < len(SPLITS):
            raise ValueError(f"{folder} has partial splits: {found}; pass rebuild=True to make them again.")
        old = json.loads(spark.read.text(f"{folder}/{version}/manifest").first()[0]).get("split_strategy", "label")
        if old != strategy:
            raise ValueError(f"Splits in {folder} were built with {old!r}, not {strategy!r}; pass rebuild=True.")
    else:
        version = _publish(spark, folder, make(), {"split_strategy": strategy, **{k: str(v) for k, v in manifest.items()}})
    return reload(spark.read.parquet(*[f"{folder}/{version}/{s}" for s in SPLITS]))
