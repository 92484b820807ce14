"""Duplicate removal, upserts and the idempotent batch step."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.parse import comment_hash, post_hash
from tidemark.functions.text import squash
from tidemark.operators.joins import unique_keys


# --- duplicates ------------------------------------------------------------------

def first_per_key(df: DataFrame, key: Column, order: Sequence[str]) -> DataFrame:
    """The first row of each key; copies are combined before the shuffle.

    Along one column (unique, without nulls) only keys and places are grouped,
    and the winners' rows are picked by a semi-join. Hash long text keys.
    """
    if len(order) == 1:
        winners = df.groupBy(key.alias("_key")).agg(F.min(order[0]).alias(order[0])).select(order[0])
        return df.join(winners, order[0], "left_semi")
    rest = [c for c in df.columns if c not in order]
    row = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest])
    return df.groupBy(key.alias("_key")).agg(F.min_by(row, F.struct(*order)).alias("_row")).select(
        *[F.col(f"_row.`{c}`").alias(c) for c in df.columns])


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in rest])
    return df.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("_row")).select(
        *[F.col(c) if c in keys else F.col(f"_row.`{c}`").alias(c) for c in df.columns])


def first_by_prefix(df: DataFrame, text: str, order: str, width: int = 80) -> DataFrame:
    """Keep the first row among those that share their first ``width`` characters."""
    return first_per_key(df, F.sha2(F.substring(text, 1, width), 256), [order])


def distinct_comments(df: DataFrame, parent: str, text: str, order: str, shortest: int = 2) -> DataFrame:
    """One comment per parent and text; shorter texts are dropped."""
    long_enough = df.filter(F.length(F.coalesce(F.col(text), F.lit(""))) >= shortest)
    return first_per_key(long_enough, F.struct(F.col(parent), F.sha2(F.col(text), 256)), [order])


def new_comments(incoming: DataFrame, stored: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Comments whose key is neither stored nor seen earlier in the same input."""
    fresh = incoming.join(stored.select(*keys).distinct(), list(keys), "left_anti")
    return first_per_key(fresh, F.struct(*keys), [order])


# --- upserts ------------------------------------------------------------------------

def upsert(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], action: str = "action") -> DataFrame:
    """Table after the upsert: incoming values win, also as nulls; columns the input
    lacks keep the stored value. ``action`` is ``inserted``, ``updated`` or ``kept``.
    A key that comes twice in the input is an error."""
    incoming = unique_keys(incoming, keys, "input")
    new_columns = [c for c in incoming.columns if c not in keys]
    old = stored.withColumn("_old", F.lit(True))
    new = incoming.select(*keys, *[F.col(c).alias("_n_" + c) for c in new_columns], F.lit(True).alias("_new"))
    joined = old.join(new, list(keys), "full_outer")
    is_new, is_old = F.col("_new").isNotNull(), F.col("_old").isNotNull()
    value = lambda c: F.when(is_new, F.col("_n_" + c)).otherwise(F.col(c)) if c in new_columns else F.col(c)
    what = F.when(~is_new, "kept").when(is_old, "updated").otherwise("inserted")
    return joined.select(*[F.col(c) if c in keys else value(c).alias(c) for c in stored.columns], what.alias(action))


def set_status(df: DataFrame, ids: Sequence[int], status: str, key: str = "id") -> DataFrame:
    return df.withColumn("status", F.when(F.col(key).isin(list(ids)), F.lit(status)).otherwise(F.col("status")))


def update_fields(df: DataFrame, where: Column, **values) -> DataFrame:
    """Set only the given fields of the matching rows."""
    return df.withColumns({c: F.when(where, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def soft_delete(df: DataFrame, where: Column, at: Column) -> DataFrame:
    return df.withColumn("deleted_at", F.when(where & F.col("deleted_at").isNull(), at).otherwise(F.col("deleted_at")))


# --- batches --------------------------------------------------------------------------

BATCH_SCHEMA = """
batch_id string, client_job_id string,
source struct<name:string,url:string,source_type:string,platform:string,is_active:boolean,
              metadata_json:map<string,string>>,
posts array<struct<external_id:string,url:string,content:string,normalized_content:string,
  posted_at:timestamp_ntz,collected_at:timestamp_ntz,like_count:string,comment_count:string,
  content_hash:string,raw_payload_json:map<string,string>,
  comments:array<struct<content:string,normalized_content:string,collected_at:timestamp_ntz,content_hash:string>>>>
"""


@dataclass(frozen=True)
class Changes:
    """What a set of batches adds: new sources, posts and comments, and ledger rows."""

    sources: DataFrame
    posts: DataFrame
    comments: DataFrame
    ledger: DataFrame


#: Stored keys, or what reads those of them that may match some input.
Stored = DataFrame | Callable[[DataFrame], DataFrame]


def matching(stored: Stored, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The stored keys that the input asks for, each once.

    The store is first reduced to the input's keys: a small input is broadcast
    and the stored keys are only scanned, not shuffled. An index reads no more
    of them than the parts that the input's keys fall into.
    """
    stored = stored if isinstance(stored, DataFrame) else stored(incoming)
    return stored.select(*keys).join(incoming.select(*keys).distinct(), list(keys), "left_semi").distinct()


def with_arrival(batches: DataFrame) -> DataFrame:
    """The batches with an ``arrival`` to order them by; without one, ids decide."""
    return batches if "arrival" in batches.columns else batches.withColumn("arrival", F.lit(None).cast("timestamp"))


def fresh_batches(batches: DataFrame, ledger: Stored, unique: bool = False) -> DataFrame:
    """Batches that were not processed before, each id once: the first to arrive, then by the digest of its posts.

    Rows without an id (unreadable input) are left out. ``unique`` says that no
    id comes twice, which saves moving the payloads.
    """
    named = with_arrival(batches).filter(F.col("batch_id").isNotNull())
    known = matching(ledger, named, ["batch_id"])
    fresh = named.join(known, "batch_id", "left_anti")
    if unique:
        return fresh
    first = Window.partitionBy("batch_id").orderBy("arrival", F.xxhash64(F.to_json("posts")))
    return fresh.withColumn("_place", F.row_number().over(first)).filter("_place = 1").drop("_place")


def repeated_results(batches: DataFrame, ledger: DataFrame) -> DataFrame:
    """Result rows of batches that were processed before: everything skipped."""
    known = ledger.select("batch_id", "total_received")
    return batches.select("batch_id").distinct().join(known, "batch_id").select(
        "batch_id", "total_received", *[F.lit(0).cast("bigint").alias(c) for c in ("inserted", "updated")],
        F.col("total_received").alias("skipped"), F.lit(0).cast("bigint").alias("failed"), F.lit("repeated").alias("status"))


def posts_of(batches: DataFrame) -> DataFrame:
    """One row per post with its text key, hash and place; blank posts have none.

    A post without content ``is_failed``; whether it is blank is then null.
    """
    flat = with_arrival(batches).select("arrival", "batch_id", F.col("source.url").alias("source_url"), F.posexplode("posts").alias("pos", "p"))
    from tidemark.functions.parse import parse_count

    text = squash(F.coalesce(F.nullif(F.col("p.normalized_content"), F.lit("")), F.col("p.content")))
    named = flat.withColumn("normalized_content", text).withColumn("is_blank_post", F.when(F.col("p.content").isNotNull(), squash(F.col("p.content")) == ""))
    external = F.coalesce(F.nullif(F.col("p.external_id"), F.lit("")), F.col("p.url"))
    made = post_hash(F.col("source_url"), external, F.col("normalized_content"), F.col("p.posted_at"))
    return named.select(
        "arrival", "batch_id", "source_url", "pos", "is_blank_post", F.col("p.content").isNull().alias("is_failed"),
        F.coalesce(F.nullif(F.col("p.content_hash"), F.lit("")), made).alias("content_hash"),
        F.col("p.external_id").alias("external_id"), F.col("p.url").alias("url"), F.col("p.content").alias("content"),
        "normalized_content", F.col("p.posted_at").alias("posted_at"), F.col("p.collected_at").alias("collected_at"),
        parse_count(F.col("p.like_count")).alias("like_count"),
        parse_count(F.col("p.comment_count")).alias("comment_count"),
        F.col("p.raw_payload_json").alias("raw_payload_json"), F.col("p.comments").alias("comments"))


def comments_of(posts: DataFrame) -> DataFrame:
    """One row per comment of the posts, keyed by post and comment hash."""
    flat = posts.filter(~F.col("is_blank_post")).select(
        "arrival", "batch_id", "pos", F.col("content_hash").alias("post_hash"), F.col("collected_at").alias("post_collected_at"),
        F.posexplode("comments").alias("cpos", "c"))
    text = squash(F.coalesce(F.nullif(F.col("c.normalized_content"), F.lit("")), F.col("c.content")))
    named = flat.withColumn("normalized_content", text).filter(F.col("normalized_content") != "")
    made = comment_hash(F.col("post_hash"), F.col("normalized_content"))
    return named.select(
        "arrival", "batch_id", "pos", "cpos", "post_hash",
        F.coalesce(F.nullif(F.col("c.content_hash"), F.lit("")), made).alias("content_hash"),
        F.col("c.content").alias("content"), "normalized_content",
        F.coalesce(F.col("c.collected_at"), F.col("post_collected_at")).alias("collected_at"))


POST_COLUMNS = ["content_hash", "source_url", "external_id", "url", "content", "normalized_content", "posted_at",
                "collected_at", "like_count", "comment_count", "raw_payload_json"]
COMMENT_COLUMNS = ["post_hash", "content_hash", "content", "normalized_content", "collected_at"]


def batch_changes(batches: DataFrame, ledger: Stored, post_keys: Stored, comment_keys: Stored,
                  unique: bool = False, stage: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> Changes:
    """Classify a set of batches against the stored keys.

    Posts: a key that is stored, or came earlier in the set, is an update; the
    last version to arrive wins (ties by batch id). Comments: stored or earlier
    keys are dropped. Blank posts are skipped; posts without content fail, which
    the ledger counts and lists. Batches already in the ledger change nothing.
    ``stage`` may write the flat posts once, since several results are derived
    from them.
    """
    fresh = fresh_batches(batches, ledger, unique)
    posts = stage(posts_of(fresh), "posts")
    usable = posts.filter(~F.col("is_blank_post"))
    place = F.struct("arrival", "batch_id", "pos")
    # Keys and places only; the winners' rows are fetched by place.
    versions = usable.select("content_hash", place.alias("_p")).groupBy("content_hash").agg(F.min("_p").alias("_first"), F.max("_p").alias("_last"))
    stored = matching(post_keys, usable, ["content_hash"]).withColumn("_stored", F.lit(True))
    judged = versions.join(stored, "content_hash", "left").withColumn("_is_new", F.col("_stored").isNull())
    winners = judged.select("_last.batch_id", "_last.pos", F.when(F.col("_is_new"), "inserted").otherwise("updated").alias("action"))
    current = usable.join(winners, ["batch_id", "pos"]).select(*POST_COLUMNS, "action")

    inserted = judged.filter("_is_new").groupBy(F.col("_first.batch_id").alias("batch_id")).agg(F.count("*").alias("inserted"))
    received = posts.groupBy("batch_id").agg(
        F.count("*").alias("total_received"), F.count_if("is_blank_post").alias("skipped"), F.count_if("is_failed").alias("failed"),
        F.sort_array(F.collect_list(F.when(F.col("is_failed"), F.struct(
            "pos", F.format_string("post[%d]: content is missing", F.col("pos") + 1).alias("error")))))["error"].alias("errors"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    counted = (fresh.select("batch_id").join(received, "batch_id", "left").join(inserted, "batch_id", "left")
               .select("batch_id", zero("total_received").alias("total_received"), zero("inserted").alias("inserted"),
                       zero("skipped").alias("skipped"), zero("failed").alias("failed"), "errors"))
    new_ledger = counted.select(
        "batch_id", "total_received", "inserted",
        (F.col("total_received") - F.col("inserted") - F.col("skipped") - F.col("failed")).alias("updated"), "skipped", "failed",
        F.when(F.col("failed") > 0, "partial_failed").otherwise("success").alias("status"),
        F.coalesce("errors", F.array().cast("array<string>")).alias("errors"))

    notes = comments_of(posts)
    keys = ["post_hash", "content_hash"]
    known = matching(comment_keys, notes, keys)
    where = ["batch_id", "pos", "cpos"]
    first = (notes.join(known, keys, "left_anti").groupBy(*keys).agg(F.min(F.struct("arrival", *where)).alias("_p"))
             .select(*[F.col(f"_p.{c}").alias(c) for c in where]))
    added = notes.join(first, where).select(*COMMENT_COLUMNS)

    sources = last_per_key(fresh.select("arrival", "batch_id", "source.*"), ["url"], ["arrival", "batch_id"]).drop("arrival", "batch_id")
    return Changes(sources, current, added, new_ledger)
