"""Two-pass external shuffle of documents into shards.

Pass one scatters whole rows, texts included, by seeded hashes: the shard is the
one whose hash with the id is highest, so the id and the shard count alone
decide and one more shard takes rows only into itself. Each shard is cut into
as many buckets as its rows and bytes need; the bucket is a hash of id, text
and row number, so that rows of one id or one text spread over all buckets of
their shard. Pass two gathers each bucket in memory, puts it in order by a
seeded Fisher-Yates shuffle and writes it. A shard's files, in the order of
their names, hold its buckets one after the other; the rows before a bucket and
the place in it give each record its slot. Nothing is joined by id. Rows are
kept in one struct, so their columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tidemark.session import scratch_path, written

SIZE_BYTES = 16  # beside the text


def shard_of(key: Column, shards: int, seed: int = 0) -> Column:
    """The shard with the highest seeded hash (ties to the higher number); a null key has one shard too."""
    tries = [F.struct(F.xxhash64(F.lit(seed), key, F.lit(s)).alias("h"), F.lit(s).alias("s")) for s in range(shards)]
    return F.array_max(F.array(*tries))["s"]


def shuffle_shards(docs: DataFrame, key: str, text: str, shards: int, path: str, seed: int = 0, bucket_rows: int = 1 << 16,
                   bucket_bytes: int = 4 << 20, task_bytes: int = 64 << 20) -> None:
    """Write every row whole, as ``row`` with ``bucket`` and ``place``, to Parquet folders ``shard=N``; ``read_shards`` reads them.

    Null and repeated keys and texts are rows like others. A bucket holds at
    most ``bucket_rows`` rows and ``bucket_bytes`` of text in the mean, a task
    about ``task_bytes`` of it.
    """
    shard = shard_of(F.col(key), shards, seed)
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + SIZE_BYTES
    cuts, whole = [1] * shards, 0
    for r in docs.select(shard.alias("shard"), size.alias("size")).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b")).collect():
        cuts[r["shard"]] = max(-(-r["n"] // bucket_rows), -(-r["b"] // bucket_bytes))
        whole += r["b"]
    deal = F.xxhash64(F.lit(~seed), F.col(key), F.col(text), F.monotonically_increasing_id())
    rows = docs.select(F.struct(*docs.columns).alias("row"), shard.alias("shard"), deal.alias("deal")).select(
        "row", "shard", F.pmod("deal", F.element_at(F.array(*map(F.lit, cuts)), F.col("shard") + 1)).cast("long").alias("bucket"))
    dealt = rows.repartitionByRange(max(shards, whole // task_bytes), "shard", "bucket")
    buckets = dealt.groupBy("shard", "bucket").agg(F.collect_list("row").alias("rows"))
    mixed = buckets.select("shard", "bucket", F.posexplode(F.shuffle("rows", seed)).alias("place", "row"))
    mixed.sortWithinPartitions("shard", "bucket", "place").write.partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, schema: StructType, max_broadcast: int = 1 << 20) -> DataFrame:
    """``row, shard, slot`` of the written rows; ``schema`` is that of the documents.

    Up to ``max_broadcast`` buckets, their offsets are broadcast; beyond, they are joined.
    """
    rows = spark.read.schema(StructType([StructField("row", schema), StructField("bucket", LongType()), StructField("place", IntegerType()),
                                         StructField("shard", IntegerType())])).parquet(path)
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = written(counts.select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("before")), "shard-offsets")
    placed = rows.join(F.broadcast(offsets) if offsets.count() <= max_broadcast else offsets, ["shard", "bucket"])
    return placed.select("row", "shard", (F.col("before") + F.col("place")).alias("slot"))


def assign(docs: DataFrame, key: str, text: str, shards: int, seed: int = 0, bucket_rows: int = 1 << 16) -> DataFrame:
    """Key, ``size``, ``text_crc32``, ``shard``, ``slot`` and ``grown_shard`` (with one shard more) of each row in the shards.

    The shards are written under the shared folder and all of it is taken from
    what is read back. Null texts count as empty. Rows that repeat a key share
    its shard and each have a slot. An empty table gives no rows.
    """
    spark, path = docs.sparkSession, scratch_path(docs.sparkSession, "shards")
    docs = docs.select(key, text)
    shuffle_shards(docs, key, text, shards, path, seed, bucket_rows)
    return digests(read_shards(spark, path, docs.schema), key, text, shards, seed)


def digests(rows: DataFrame, key: str, text: str, shards: int, seed: int = 0) -> DataFrame:
    """Key, ``size``, ``text_crc32``, ``shard``, ``slot`` and ``grown_shard`` of what ``read_shards`` gives."""
    key_column, body = F.col("row")[key], F.coalesce(F.col("row")[text], F.lit(""))
    return rows.select(
        key_column.alias(key), (F.octet_length(body) + SIZE_BYTES).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
        "shard", "slot", shard_of(key_column, shards + 1, seed).alias("grown_shard"))
