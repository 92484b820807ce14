"""Queries for sources, sinks, batch ingest and streams."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import filters as flt
from tidemark.operators import splits as sp
from tidemark.operators import upsert as up
from tidemark.plans.base import Tables, query
from tidemark.plans.labels import RULES
from tidemark.plans.relational import SPLIT_SQL, SQUASH, STREAK_SQL, _labelled
from tidemark.session import scratch_path, written
from tidemark.sources import tables as src
from tidemark.sources import writers as wr
from tidemark.streaming import ingest as st
from tidemark.streaming.store import ChangeStore

DOCUMENTS = "SELECT doc_id, text, lang, source, n_chars FROM documents"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


# --- sources and sinks ---------------------------------------------------------------

@query("src1_csv_round_trip", DOCUMENTS)
def _(t):
    path = scratch_path(t.spark, "csv")
    wr.write_csv(t.documents, path)
    return src.read_csv(t.spark, path, SCHEMA)


@query("src2_mixed_encodings", "SELECT doc_id, lang, text FROM documents")
def _(t):
    path = scratch_path(t.spark, "encodings")
    rows = t.documents.select("doc_id", "lang", "text")
    # Latin-1 characters and what the same bytes mean in windows-1258.
    latin, meant = bytes(range(0x80, 0x100)).decode("latin-1"), bytes(range(0x80, 0x100)).decode("cp1258", "replace")
    pairs = [(m, a) for a, m in zip(latin, meant) if m not in (a, "\ufffd")]
    bytes_1258 = rows.filter("lang = 'de'").withColumn("text", F.translate("text", *map("".join, zip(*pairs))))
    for encoding, part in (("UTF-8", rows.filter("lang <> 'de'")), ("ISO-8859-1", bytes_1258)):
        part.write.mode("append").options(header=True, quote='"', escape='"', encoding=encoding).csv(path)
    return src.read_csv_any_encoding(t.spark, path, "doc_id long, lang string, text string")


@query("src3_label_folder", """
SELECT id, content_anonymized, ann_b AS "3.5 Flash", nullif(ann_c, '') AS "3.1 Pro" FROM (SELECT id, content_anonymized, nullif(trim(ann_b), '') AS ann_b, ann_c FROM {annotators})""")
def _(t):
    path = scratch_path(t.spark, "labels")
    for folder, label in (("answers", F.trim("ann_b")), ("answers_v2", F.col("ann_c"))):
        wr.write_csv(t.annotators.select("id", "content_anonymized", F.nullif(label, F.lit("")).alias("label")), f"{path}/{folder}")
    return src.read_label_folder(t.spark, path)


@query("src4_alternative_label_names", """
SELECT id, content_anonymized, ann_a AS "GPT5.5_Medium" FROM {annotators} UNION ALL SELECT id, content_anonymized, ann_c FROM {annotators}""")
def _(t):
    path = scratch_path(t.spark, "labels")
    for name, column in (("GPT5.5_Medium", "ann_a"), ("label", "ann_c")):
        texts = ("content_anonymized", "id") if name == "label" else ("id", "content_anonymized")  # two headers, in two orders
        t.annotators.select(*texts, F.col(column).alias(name)).write.mode("append").options(header=True, quote='"', escape='"').csv(path)
    return src.read_label_tables(t.spark, path)


@query("src5_table_scan", """
SELECT p.id, p.like_count, count(c.comment_id) AS comments FROM {raw_posts} p LEFT JOIN {comments} c ON c.post_id = p.id GROUP BY ALL""")
def _(t):
    counts = t.comments.groupBy("post_id").agg(F.count("*").alias("n"))
    return t.raw_posts.join(counts, F.col("id") == F.col("post_id"), "left").select(
        "id", "like_count", F.coalesce("n", F.lit(0)).alias("comments"))


@query("src6_incremental_scan", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND n_chars > 0")
def _(t):
    done = t.documents.join(t.labels.select("doc_id", F.col("quality").alias("content_clean")), "doc_id", "left")
    waiting = flt.unprocessed(done)
    return flt.not_in_store(waiting, t.labels, F.col("doc_id"), F.col("doc_id")).select("doc_id")


@query("src6_high_water_mark", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1 WHEN event_id % 3 = 1 THEN 2 ELSE 3 END AS run FROM events""")
def _(t):
    """Three parts of the events come one after the other; each run reads only what is new."""
    feed, ledger, out = (scratch_path(t.spark, name) for name in ("feed", "ledger", "runs"))
    for run in range(1, 4):
        t.events.filter(F.col("event_id") % 3 == run - 1).select("event_id").write.parquet(f"{feed}/{run}")
        folder = src.IncrementalFolder(t.spark, feed, ledger, "event_id long")
        folder.pending().withColumn("run", F.lit(run)).write.parquet(f"{out}/{run}")
        folder.commit()
    return t.spark.read.schema("event_id long, run int").parquet(*[f"{out}/{run}" for run in range(1, 4)])


@query("snk2_label_chunks", """
SELECT doc_id AS id, '' AS label, sha256(text) AS text_sha256,
    printf('%03d', (row_number() OVER (ORDER BY doc_id) - 1) // (SELECT greatest(1, count(*) // 1100) FROM documents) + 1) AS part
FROM documents""")
def _(t):
    path = scratch_path(t.spark, "chunks")
    rows = t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("content_anonymized"))
    wr.write_label_chunks(rows, path, size=max(1, t.documents.count() // 1100))  # about 1,100 chunks
    back = t.spark.read.schema("id long, content_anonymized string, label string, part string").options(
        header=True, multiLine=True, escape='"').csv(path)
    return back.select("id", F.coalesce("label", F.lit("")).alias("label"), F.sha2("content_anonymized", 256).alias("text_sha256"), "part")


@query("snk3_json_report", """
SELECT lang, count(*) AS n FROM documents GROUP BY lang""")
def _(t):
    path = scratch_path(t.spark, "report")
    wr.write_json_report(t.documents.groupBy("lang").agg(F.count("*").alias("n")), path)
    return t.spark.read.schema("lang string, n long").json(path)


@query("snk4_report_extract", """
SELECT id AS "ID", source_id AS "Nguon", content AS "Noi dung", topic AS "Chu de", importance_level AS "Muc do", status AS "Trang thai", collected_at AS "Ngay thu thap"
FROM {news} WHERE deleted_at IS NULL AND created_at >= TIMESTAMP '2024-01-05 00:00:00' AND created_at <= TIMESTAMP '2024-01-12 00:00:00'""")
def _(t):
    return wr.report_rows(t.news, datetime(2024, 1, 5), datetime(2024, 1, 12))


@query("snk4_report_ledger", "SELECT CAST(7 AS BIGINT) AS report_id, 'completed' AS status, count(*) AS rows FROM {news} WHERE deleted_at IS NULL")
def _(t):
    folder = scratch_path(t.spark, "reports")
    ledger = wr.write_report(t.news, folder, 7)
    written = src.read_csv(t.spark, ledger.first()["file_path"]).agg(F.count("*").alias("rows"))
    return written.select(F.lit(7).cast("bigint").alias("report_id"), "rows").join(
        ledger.select("report_id", "status"), "report_id").select("report_id", "status", "rows")


@query("snk5_saved_splits", "WITH " + SPLIT_SQL + " SELECT doc_id, split FROM sp")
def _(t):
    folder = scratch_path(t.spark, "splits")

    def make():
        return sp.stratified_split(sp.prepare(_labelled(t), "text", "label"), "doc_id", "label_data_type")

    def reload(df):
        return sp.prepare(df.drop("label_id", "label_name"), "text", "label")

    wr.saved_or_new_splits(t.spark, folder, make, "label_data_type", reload, seed=42)
    again = wr.saved_or_new_splits(t.spark, folder, lambda: None, "label_data_type", reload)
    return again.select("doc_id", "split")


BATCH_SQL = """
WITH top AS (SELECT * FROM {raw_posts} ORDER BY id DESC LIMIT 500),
many AS (SELECT * EXCLUDE (post_id), CASE WHEN post_id % 3 = 0 THEN post_id ELSE (SELECT max(id) FROM {raw_posts}) END AS post_id FROM {comments}),
n AS (SELECT post_id, comment_id, """ + SQUASH.format(c="content") + """ AS txt, row_number() OVER (PARTITION BY post_id ORDER BY comment_id) AS rn FROM many),
g AS (SELECT post_id, (rn - 1) // 100 AS part, string_agg(sha256(concat(post_id, '|', txt)), ' ' ORDER BY comment_id) AS notes FROM n GROUP BY ALL)
SELECT concat('local-post-', id) AS external_id, coalesce(source, 'https://page') AS url, """ + SQUASH.format(c="content") + """ AS normalized_content,
CASE id % 4 WHEN 0 THEN TIMESTAMP '2024-05-01 10:00:00' WHEN 1 THEN TIMESTAMP '2024-05-01 11:00:00' WHEN 2 THEN TIMESTAMP '2024-05-02 00:00:00' END AS posted_at,
CAST(CASE id % 3 WHEN 0 THEN 12 WHEN 1 THEN 37 END AS BIGINT) AS like_count, id % 9 AS comment_count,
sha256(concat(coalesce(source, 'https://page'), '|', id, '|', """ + SQUASH.format(c="content") + """, '|', posted_at)) AS content_hash, coalesce(part, 0) AS part, coalesce(notes, '') AS notes
FROM top LEFT JOIN g ON post_id = id WHERE trim(content) <> ''"""


@query("snk6_build_batch", BATCH_SQL)
def _(t):
    newest = t.raw_posts.agg(F.max("id")).first()[0]
    many = t.comments.withColumn("post_id", F.when(F.col("post_id") % 3 == 0, F.col("post_id")).otherwise(F.lit(newest)))
    rows = wr.build_batch(t.raw_posts, many, "https://page", "desktop-1", chunk=100)
    return rows.select(
        "external_id", "url", "normalized_content", "posted_at", "like_count", "comment_count", "content_hash", "part",
        F.array_join(F.transform("comments", lambda c: c["content_hash"]), " ").alias("notes"))


@query("snk6_write_batches", """
SELECT count(*) AS posts, count(DISTINCT external_id) AS ids FROM (SELECT id AS external_id FROM {raw_posts} ORDER BY id DESC LIMIT 500)""")
def _(t):
    path = scratch_path(t.spark, "payload")
    source = {"name": "page", "url": "https://page", "source_type": "facebook_page", "platform": "facebook"}
    wr.write_batches(wr.build_batch(t.raw_posts, t.comments, "https://page", "desktop-1"), path, source, 50)
    posts = up.posts_of(src.read_batches(t.spark, path))
    return posts.agg(F.count("*").alias("posts"), F.count_distinct("external_id").alias("ids"))


# --- ingest --------------------------------------------------------------------------

def batches(t: Tables) -> DataFrame:
    """Every document as a post, a hundred posts per batch, each with two comments.

    Batches arrive in the opposite order of their ids; some posts have no content.
    """
    note = lambda text: F.struct(text.alias("content"), F.lit(None).cast("string").alias("normalized_content"),
                                 F.lit(None).cast("timestamp_ntz").alias("collected_at"), F.lit(None).cast("string").alias("content_hash"))
    none = lambda kind: F.lit(None).cast(kind)
    post = F.struct(
        F.col("doc_id").cast("string").alias("external_id"), none("string").alias("url"),
        F.when(F.col("doc_id") % 41 == 5, none("string")).when(F.col("doc_id") % 37 == 0, F.lit("  \n ")).otherwise(F.col("text")).alias("content"),
        none("string").alias("normalized_content"), none("timestamp_ntz").alias("posted_at"), none("timestamp_ntz").alias("collected_at"),
        F.concat(F.col("doc_id") % 7, F.lit("K")).alias("like_count"), none("string").alias("comment_count"),
        F.sha2("text", 256).alias("content_hash"), none("map<string,string>").alias("raw_payload_json"),
        F.array(note(F.concat(F.lit(" hay  "), "lang")), note(F.concat(F.lit("hay "), "lang")), note(F.col("source"))).alias("comments"))
    number = F.floor(F.col("doc_id") / 100)
    rows = t.documents.select(number.alias("no"), F.struct("doc_id", post.alias("p")).alias("e"))
    order = lambda a, b: F.when(a["doc_id"] < b["doc_id"], -1).otherwise(1)
    packed = rows.groupBy("no").agg(F.array_sort(F.collect_list("e"), order).alias("es"))
    source = F.struct(
        F.concat(F.lit("page "), "no").alias("name"), F.concat(F.lit("https://p/"), F.col("no") % 3).alias("url"),
        F.lit("facebook_page").alias("source_type"), F.lit("facebook").alias("platform"), F.lit(True).alias("is_active"),
        F.lit(None).cast("map<string,string>").alias("metadata_json"))
    return packed.select(
        F.concat(F.lit("b"), F.lpad((999999999999 - F.col("no")).cast("string"), 12, "0")).alias("batch_id"), F.lit(None).cast("string").alias("client_job_id"),
        source.alias("source"), F.transform("es", lambda e: e["p"]).alias("posts"), F.timestamp_seconds("no").alias("arrival"))


FEED = """
d AS (SELECT doc_id, doc_id // 100 AS no, concat('b', lpad(CAST(999999999999 - doc_id // 100 AS VARCHAR), 12, '0')) AS batch_id, sha256(text) AS h,
             doc_id % 41 = 5 AS failed, doc_id % 41 <> 5 AND (doc_id % 37 = 0 OR trim(regexp_replace(text, '\\s+', ' ', 'g')) = '') AS blank, lang, source, text FROM documents)"""


def _state(t):
    known = batches(t).filter(F.substring("batch_id", -1, 1) == "4")
    ledger = known.select("batch_id", F.size("posts").cast("bigint").alias("total_received"))
    stored = t.documents.filter("source = 'src0'").select(F.sha2("text", 256).alias("content_hash"))
    notes = t.documents.filter("source = 'src0'").select(
        F.sha2("text", 256).alias("post_hash"), F.sha2(F.concat(F.sha2("text", 256), F.lit("|src0")), 256).alias("content_hash"))
    return ledger, stored, notes


def _changes(t):
    return up.batch_changes(batches(t), *_state(t), stage=written)


FRESH = FEED + """,
f AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY no, doc_id) AS place, row_number() OVER (PARTITION BY h ORDER BY no DESC, doc_id DESC) AS back
      FROM d WHERE NOT blank AND NOT failed AND right(batch_id, 1) <> '4'),
old AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE source = 'src0')"""


@query("ups2_upsert_posts", "WITH " + FRESH + """
SELECT h AS content_hash, CAST(doc_id AS VARCHAR) AS external_id, (doc_id % 7) * 1000 AS like_count,
CASE WHEN h IN (SELECT h FROM old) THEN 'updated' ELSE 'inserted' END AS action FROM f WHERE back = 1""")
def _(t):
    return _changes(t).posts.select("content_hash", "external_id", "like_count", "action")


@query("agg22_batch_counters", "WITH " + FRESH + """,
a AS (SELECT batch_id, count(*) AS total_received, count(*) FILTER (blank) AS skipped, count(*) FILTER (failed) AS failed,
      coalesce(string_agg(concat('post[', doc_id - no * 100 + 1, ']: content is missing'), ' ' ORDER BY doc_id) FILTER (failed), '') AS errors
      FROM d WHERE right(batch_id, 1) <> '4' GROUP BY ALL),
i AS (SELECT batch_id, count(*) AS inserted FROM f WHERE place = 1 AND h NOT IN (SELECT h FROM old) GROUP BY ALL)
SELECT batch_id, total_received, coalesce(inserted, 0) AS inserted, total_received - skipped - failed - coalesce(inserted, 0) AS updated, skipped, failed,
CASE WHEN failed > 0 THEN 'partial_failed' ELSE 'success' END AS status, errors FROM a LEFT JOIN i USING (batch_id)""")
def _(t):
    return _changes(t).ledger.withColumn("errors", F.array_join("errors", " "))


@query("ups4_repeated_batches", "WITH " + FEED + """
SELECT batch_id, count(*) AS total_received, CAST(0 AS BIGINT) AS inserted, CAST(0 AS BIGINT) AS updated, count(*) AS skipped, CAST(0 AS BIGINT) AS failed, 'repeated' AS status
FROM d WHERE right(batch_id, 1) = '4' GROUP BY ALL""")
def _(t):
    return up.repeated_results(batches(t), _state(t)[0])


NOTES = """
c AS (SELECT h AS post_hash, unnest([concat('hay ', lang), source]) AS txt FROM f),
k AS (SELECT DISTINCT post_hash, sha256(concat(post_hash, '|', txt)) AS content_hash, txt FROM c)"""


@query("ded4_ingest_comments", "WITH " + FRESH + "," + NOTES + """
SELECT post_hash, content_hash, txt AS normalized_content FROM k
WHERE NOT (txt = 'src0' AND post_hash IN (SELECT h FROM old))""")
def _(t):
    return _changes(t).comments.select("post_hash", "content_hash", "normalized_content")


@query("ups1_source_upsert", "WITH " + FEED + """
SELECT concat('https://p/', no % 3) AS url, arg_max(concat('page ', no), no) AS name FROM d WHERE right(batch_id, 1) <> '4' GROUP BY ALL""")
def _(t):
    return _changes(t).sources.select("url", "name")


@query("src7_nested_batches", "WITH " + FEED + """
SELECT batch_id, doc_id - no * 100 AS pos, CAST(doc_id AS VARCHAR) AS external_id, h AS content_hash, CASE WHEN NOT failed THEN blank END AS is_blank_post FROM d""")
def _(t):
    raw = batches(t).select(F.to_json(F.struct("*")).alias("value"))
    posts = up.posts_of(src.parse_batches(raw))
    return posts.select("batch_id", F.col("pos").cast("bigint").alias("pos"), "external_id", "content_hash", "is_blank_post")


# --- streams ---------------------------------------------------------------------------

def _drained_store(t) -> ChangeStore:
    """Write the batches as JSON, twice, and drain them through the ingest stream in several micro-batches.

    Each part is as many files as it has tasks, of bounded size, and one or more micro-batches.
    """
    feed, root = scratch_path(t.spark, "feed"), scratch_path(t.spark, "store")
    made = written(batches(t).drop("arrival"), "batches")
    store = ChangeStore(t.spark, root)
    for part in (made.filter("substring(batch_id, -1, 1) < '5'"), made.filter("substring(batch_id, -1, 1) >= '5'"), made):
        part.write.mode("append").json(feed)
        st.start_ingest(st.read_batch_stream(t.spark, feed, 1000), store, f"{root}/_checkpoint").awaitTermination()
    return store


ALL_POSTS = FEED + ", p AS (SELECT h, max(doc_id) AS doc_id FROM d WHERE NOT blank AND NOT failed GROUP BY h)"


@query("str1_streaming_ingest", "WITH " + ALL_POSTS + """
SELECT 'posts' AS name, count(*) AS rows FROM p
UNION ALL SELECT 'sources', count(DISTINCT no % 3) FROM d
UNION ALL SELECT 'comments', count(*) FROM (SELECT DISTINCT h, unnest([concat('hay ', lang), source]) FROM d WHERE NOT blank AND NOT failed)
UNION ALL SELECT 'ledger', count(DISTINCT batch_id) FROM d""")
def _(t):
    store = _drained_store(t)
    from tidemark.operators.aggregates import table_counts

    return table_counts(**{n: store.current(n) for n in ("posts", "sources", "comments", "ledger")}).withColumnRenamed("table_name", "name")


@query("str2_streaming_dedup", "SELECT DISTINCT lang, sha256(text) AS h FROM documents")
def _(t):
    root = scratch_path(t.spark, "dedup")
    schema = t.documents.schema
    stream = t.spark.readStream.schema(schema).parquet(f"{t.folder}/document[s].parquet").select("lang", F.sha2("text", 256).alias("h"))
    unique = st.distinct_stream(stream.withColumn("k", F.concat_ws("|", "lang", "h")), "k").drop("k")
    unique.writeStream.option("checkpointLocation", f"{root}/_checkpoint").option("path", f"{root}/rows").trigger(
        availableNow=True).format("parquet").start().awaitTermination()
    return t.spark.read.schema(unique.schema).parquet(f"{root}/rows")


@query("str2_watermarked_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def _(t):
    root = scratch_path(t.spark, "dedup")
    stream = t.spark.readStream.schema(t.events.schema).parquet(f"{t.folder}/event[s].parquet").select(
        "user_id", "event_type", F.col("ts").cast("timestamp").alias("at"), F.concat_ws("|", "user_id", "event_type").alias("k"))
    # Longer than the events' span, so that every repeat meets its first row; state older than that is dropped.
    unique = st.distinct_stream(stream, "k", "at", "400 days").select("user_id", "event_type")
    unique.writeStream.option("checkpointLocation", f"{root}/_checkpoint").option("path", f"{root}/rows").trigger(
        availableNow=True).format("parquet").start().awaitTermination()
    return t.spark.read.schema(unique.schema).parquet(f"{root}/rows")


@query("str2_evicting_dedup", """
WITH RECURSIVE d AS (SELECT DISTINCT user_id, event_type, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 5 AS slice FROM events),
r AS (SELECT user_id, event_type, min(slice) AS slice FROM d GROUP BY ALL
  UNION ALL SELECT r.user_id, r.event_type, min(d.slice) FROM r JOIN d USING (user_id, event_type) WHERE d.slice >= r.slice + 3 GROUP BY r.user_id, r.event_type)
SELECT user_id, event_type, CAST(slice AS INT) AS slice FROM r""")
def _(t):
    """Slices of five days arrive one by one. A key's state ends five days after its first row, once the watermark,
    five days behind the latest slice, is there: three slices later the key is new again."""
    feed, root = scratch_path(t.spark, "feed"), scratch_path(t.spark, "dedup")
    days = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    rows = t.events.select("user_id", "event_type", F.floor(days / 5).cast("int").alias("slice")).distinct().select(
        "*", F.date_add(F.lit("2024-01-01").cast("date"), F.col("slice") * 5).cast("timestamp").alias("at"),
        F.concat_ws("|", "user_id", "event_type").alias("k"))
    rows = written(rows, "slices")
    stream = st.distinct_stream(t.spark.readStream.schema(rows.schema).parquet(f"{feed}/*"), "k", "at", "5 days")
    low, high = rows.agg(F.min("slice"), F.max("slice")).first()
    for part in range(low, high + 1) if low is not None else []:
        rows.filter(F.col("slice") == part).write.parquet(f"{feed}/{part}")
        stream.select("user_id", "event_type", "slice").writeStream.option("checkpointLocation", f"{root}/_checkpoint").option(
            "path", f"{root}/rows").trigger(availableNow=True).format("parquet").start().awaitTermination()
    return t.spark.read.schema("user_id bigint, event_type string, slice int").parquet(f"{root}/rows")


@query("str3_streaming_streak", "WITH " + STREAK_SQL)
def _(t):
    """Drained in three micro-batches, each started anew from the checkpoint."""
    feed, root = scratch_path(t.spark, "feed"), scratch_path(t.spark, "streak")
    rows = t.events.selectExpr("user_id % 40 AS src", "event_id", "event_id % 4 <> 0 AND event_id % 9 <> 0 AS known")
    highest = rows.agg(F.max("event_id")).first()[0] or 0
    stream = t.spark.readStream.schema(rows.schema).parquet(f"{feed}/*")
    for part in range(3):
        some = rows.filter((F.col("event_id") > highest * part // 3) & (F.col("event_id") <= highest * (part + 1) // 3))
        if part == 0:
            some = some.unionByName(rows.filter("event_id <= 0"))
        some.write.parquet(f"{feed}/{part}")
        st.start_streaks(stream, root, f"{root}/_checkpoint", "src", "event_id", "known", 5).awaitTermination()
    return t.spark.read.parquet(f"{root}/rows").select("src", "event_id", "known", "streak")


@query("str4_label_on_ingest", "WITH " + ALL_POSTS.lstrip() + "," + RULES.replace("{social}", "documents").lstrip() + """
SELECT h AS content_hash, category, sentiment_code, 'mock' AS provider, 'no answer' AS fallback_reason, category AS topic,
CASE WHEN importance_score >= 0.8 THEN 'high' ELSE 'normal' END AS importance_level, status_label AS status, CAST(NULL AS INT) AS voted_label,
'failed' AS label_status, 'no answer' AS gemini_error FROM p JOIN a USING (doc_id)""")
def _(t):
    store = _drained_store(t)
    items = store.current("items").select("content_hash", "topic", "importance_level", "status", "voted_label", "label_status",
                                          F.col("label_error_json")["gemini"].alias("gemini_error"))
    return store.current("analyses").select("content_hash", "category", "sentiment_code", "provider", "fallback_reason").join(items, "content_hash")


@query("str5_scheduled_run", "SELECT event_type, count(*) AS n FROM events GROUP BY ALL")
def _(t):
    root = scratch_path(t.spark, "schedule")
    stream = t.spark.readStream.schema(t.events.schema).parquet(f"{t.folder}/event[s].parquet").groupBy("event_type").agg(F.count("*").alias("n"))

    def keep(df, epoch):
        df.write.mode("overwrite").parquet(f"{root}/rows")

    writer = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{root}/_checkpoint").foreachBatch(keep)
    st.start_on_schedule(writer, "daily:22:00").awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{root}/rows")
