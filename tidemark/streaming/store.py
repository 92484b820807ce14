"""An append-only store of table changes, one folder per micro-batch.

Replaying a micro-batch overwrites only its own folders, and the state it is
judged against is everything before it, so a replay gives the same tables. The
ledger is written last.

When the history is folded into a base, its keys are also laid out by hash
prefix, in as many folders as keep ``PREFIX_KEYS`` keys each. A micro-batch then
reads the prefixes that its own keys fall into, and the keys of the micro-batches
since the base, so what it reads does not grow with the history.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

KEYS = {"sources": ["url"], "posts": ["content_hash"], "comments": ["post_hash", "content_hash"],
        "ledger": ["batch_id"], "rejected": ["raw"], "items": ["content_hash"], "analyses": ["content_hash", "provider", "model_name"]}

SCHEMAS = {
    "sources": "url string, name string, source_type string, platform string, is_active boolean, "
               "metadata_json map<string,string>",
    "posts": "content_hash string, source_url string, external_id string, url string, content string, "
             "normalized_content string, posted_at timestamp_ntz, collected_at timestamp_ntz, like_count long, "
             "comment_count long, raw_payload_json map<string,string>, action string",
    "comments": "post_hash string, content_hash string, content string, normalized_content string, "
                "collected_at timestamp_ntz",
    "ledger": "batch_id string, total_received long, inserted long, updated long, skipped long, failed long, "
              "status string, errors array<string>",
    "rejected": "raw string",
    "items": "content_hash string, topic string, importance_level string, status string, gemini_label int, phobert_label int, "
             "simcse_label int, bgem3_label int, voted_label int, label_status string, label_error_json map<string,string>, "
             "labeled_at timestamp",
    "analyses": "content_hash string, summary string, category string, importance_score double, "
                "attention_required boolean, suggested_action string, sentiment_label string, sentiment_code int, "
                "status_label string, provider string, model_name string, fallback_from string, fallback_reason string",
}


#: Tables whose keys every micro-batch is compared with.
INDEXED = ("ledger", "posts", "comments")
PREFIX_KEYS = 50_000


class ChangeStore:
    """Reads and writes the change folders under one path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folders(self, path: str, complete: bool = True) -> list[str]:
        """Names of the folders below a path, or only of those whose writing was completed."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(path)
        files = root.getFileSystem(conf)
        if not files.exists(root):
            return []
        found = [s.getPath() for s in files.listStatus(root)]
        return [p.getName() for p in found if not complete or files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]

    def _base(self, table: str, before: int | None) -> int | None:
        """The newest complete base that folds only micro-batches before the given one."""
        bases = [int(n.split("=")[1]) for n in self._folders(f"{self.path}/_base/{table}")]
        return max((b for b in bases if before is None or b <= before), default=None)

    def changes(self, table: str, before: int | None = None) -> DataFrame:
        """All changes of a table, or those of earlier micro-batches only: the base, and the micro-batches it does not hold."""
        schema = StructType.fromDDL(SCHEMAS[table])
        base = self._base(table, before)
        epochs = [int(n.split("=")[1]) for n in self._folders(f"{self.path}/{table}")]
        wanted = [e for e in epochs if (base is None or e >= base) and (before is None or e < before)]
        parts = [] if base is None else [self.spark.read.schema(schema).parquet(f"{self.path}/_base/{table}/upto={base}").withColumn(
            "epoch", F.lit(base - 1).cast("bigint"))]
        if wanted:
            rows = self.spark.read.schema(schema.add("epoch", "long")).option("basePath", f"{self.path}/{table}")
            parts.append(rows.parquet(*[f"{self.path}/{table}/epoch={e}" for e in wanted]))
        if not parts:
            return self.spark.createDataFrame([], schema).withColumn("epoch", F.lit(0).cast("bigint"))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def _prefix(self, table: str, prefixes: int) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k) for k in KEYS[table]]), F.lit(prefixes))

    def _index(self, table: str, base: int) -> tuple[int, str] | None:
        """Number of prefixes and folder of the key index of a base."""
        for name in self._folders(f"{self.path}/_keys/{table}"):
            upto, prefixes = name.split("=")[1].split(".")
            if int(upto) == base:
                return int(prefixes), f"{self.path}/_keys/{table}/{name}"
        return None

    def keys(self, table: str, before: int | None = None) -> Callable[[DataFrame], DataFrame]:
        """What reads the stored keys that some input's keys may match: the input's prefixes of the base, and all micro-batches since.

        Of the input, only the numbers of its prefixes come to the driver: no
        more than it has keys, nor than there are prefixes.
        """
        columns = KEYS[table]
        base = self._base(table, before)
        index = None if base is None else self._index(table, base)
        if index is None:
            return lambda incoming: self.changes(table, before).select(*columns)
        prefixes, folder = index
        schema = StructType([f for f in StructType.fromDDL(SCHEMAS[table]) if f.name in columns])

        def read(incoming: DataFrame) -> DataFrame:
            touched = {r[0] for r in incoming.select(self._prefix(table, prefixes)).distinct().collect()}
            there = [n for n in self._folders(folder, complete=False) if "=" in n and int(n.split("=")[1]) in touched]
            found = self.spark.createDataFrame([], schema)
            if there:
                found = self.spark.read.schema(schema).parquet(*[f"{folder}/{n}" for n in there])
            epochs = [int(n.split("=")[1]) for n in self._folders(f"{self.path}/{table}")]
            since = [f"{self.path}/{table}/epoch={e}" for e in epochs if e >= base and (before is None or e < before)]
            return found.unionByName(self.spark.read.schema(schema).parquet(*since)) if since else found

        return read

    def append(self, table: str, df: DataFrame, epoch: int) -> None:
        columns = StructType.fromDDL(SCHEMAS[table]).names
        df.select(*columns).write.mode("overwrite").parquet(f"{self.path}/{table}/epoch={epoch}")

    def current(self, table: str, before: int | None = None) -> DataFrame:
        """Latest version of each key."""
        keys = KEYS[table]
        rows = self.changes(table, before)
        rest = [c for c in rows.columns if c not in keys and c != "epoch"]
        if not rest:
            return rows.select(*keys).distinct()
        latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("_row"))
        return latest.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])

    def compact(self, table: str, epoch: int) -> None:
        """Fold what was written before ``epoch`` into one base.

        The base is a folder of its own, which counts once it is complete; the
        micro-batches it holds are deleted after that. ``epoch`` itself and later
        ones may still be replayed: they are judged against the base.
        """
        base = f"{self.path}/_base/{table}/upto={epoch}"
        if f"upto={epoch}" not in self._folders(f"{self.path}/_base/{table}"):
            self.current(table, epoch).write.mode("overwrite").parquet(base)
        if table in INDEXED and self._index(table, epoch) is None:
            keys = self.spark.read.schema(SCHEMAS[table]).parquet(base).select(*KEYS[table])
            prefixes = max(1, -(-keys.count() // PREFIX_KEYS))
            keys.withColumn("prefix", self._prefix(table, prefixes)).repartition("prefix").write.mode("overwrite").partitionBy(
                "prefix").parquet(f"{self.path}/_keys/{table}/upto={epoch}.{prefixes}")
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in (f"{self.path}/{table}", f"{self.path}/_base/{table}", f"{self.path}/_keys/{table}"):
            for folder in self._folders(path):
                if int(folder.split("=")[1].split(".")[0]) < epoch:
                    gone = jvm.org.apache.hadoop.fs.Path(f"{path}/{folder}")
                    gone.getFileSystem(conf).delete(gone, True)
