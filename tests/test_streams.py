"""Streams drained in several micro-batches, and replays."""

from pyspark.sql import functions as F

from tidemark.operators import ranking as rk
from tidemark.operators.upsert import BATCH_SCHEMA, batch_changes
from tidemark.streaming import ingest as st
from tidemark.streaming.store import KEYS, ChangeStore


def batch(number, posts, url="https://p"):
    made = [dict(external_id=str(i), content=text, content_hash=None, comments=[{"content": c} for c in notes])
            for i, text, notes in posts]
    return dict(batch_id=f"b{number}", source={"name": f"page {number}", "url": url, "is_active": True}, posts=made)


def frame(spark, *batches):
    import json

    lines = spark.createDataFrame([(json.dumps(b),) for b in batches], "value string")
    return lines.select(F.from_json("value", BATCH_SCHEMA).alias("b")).select("b.*")


FIRST = batch(1, [(1, "one", ["hi", "hi ", ""]), (2, "two", []), (3, "  ", ["lost"])])
SECOND = batch(2, [(1, "one", ["hi", "new"]), (4, "khieu nai gap", [])])


def ledger(store):
    return {r["batch_id"]: (r["total_received"], r["inserted"], r["updated"], r["skipped"]) for r in store.current("ledger").collect()}


def state(store):
    return (ledger(store), sorted(r["content"] for r in store.current("posts").collect()),
            sorted(r["normalized_content"] for r in store.current("comments").collect()),
            sorted((r["category"], r["sentiment_code"]) for r in store.current("analyses").collect()),
            [(r["url"], r["name"]) for r in store.current("sources").collect()])


EXPECTED = ({"b1": (3, 2, 0, 1), "b2": (2, 1, 1, 0)}, ["khieu nai gap", "one", "two"], ["hi", "new"],
            [("canh_bao", 1), ("doi_song_sinh_vien", 1), ("doi_song_sinh_vien", 1)], [("https://p", "page 2")])


def test_ingest_twice_is_ingest_once(spark, tmp_path):
    store = ChangeStore(spark, str(tmp_path / "store"))
    st.apply_batches(store, frame(spark, FIRST), 0)
    st.apply_batches(store, frame(spark, FIRST, SECOND), 1)
    assert state(store) == EXPECTED
    st.apply_batches(store, frame(spark, FIRST, SECOND), 1)  # replay of the micro-batch
    assert state(store) == EXPECTED
    st.apply_batches(store, frame(spark, SECOND, FIRST), 2)  # the client sends all again
    assert state(store) == EXPECTED


def test_compaction_keeps_the_state(spark, tmp_path):
    store = ChangeStore(spark, str(tmp_path / "store"))
    st.apply_batches(store, frame(spark, FIRST), 0)
    st.apply_batches(store, frame(spark, SECOND), 1)
    for table in KEYS:
        store.compact(table, 2)
    assert state(store) == EXPECTED


def test_replay_after_compaction_gives_the_same_state(spark, tmp_path):
    store = ChangeStore(spark, str(tmp_path / "store"))
    st.apply_batches(store, frame(spark, FIRST), 0)
    for _ in range(2):  # the second run is a replay of a micro-batch that folded the history before it
        st.apply_batches(store, frame(spark, SECOND), 1, compact_every=1)
        assert state(store) == EXPECTED
    for table in KEYS:
        store.compact(table, 2)
    st.apply_batches(store, frame(spark, SECOND, FIRST), 2)
    assert state(store) == EXPECTED


def test_key_index_reads_no_more_as_the_history_grows(spark, tmp_path, monkeypatch):
    import os

    from tidemark.streaming import store as module

    monkeypatch.setattr(module, "PREFIX_KEYS", 50)
    store = ChangeStore(spark, str(tmp_path / "store"))
    empty = spark.createDataFrame([], module.SCHEMAS["posts"])
    asked = spark.createDataFrame([(f"key {i}",) for i in (3, 77, 100_000)], "content_hash string")
    read = []
    for epoch, upto in ((0, 400), (1, 1600), (2, 6400)):
        rows = spark.range(0 if epoch == 0 else upto // 4, upto).select(F.format_string("key %d", "id").alias("content_hash"))
        store.append("posts", rows.unionByName(empty, allowMissingColumns=True), epoch)
        store.compact("posts", epoch + 1)
        stored = store.keys("posts", epoch + 1)(asked)
        read.append(sum(os.path.getsize(f.removeprefix("file://")) for f in stored.inputFiles()))
        assert {r[0] for r in asked.join(stored, "content_hash", "left_semi").collect()} == {"key 3", "key 77"}
        assert store.changes("posts", epoch + 1).count() == upto
    assert max(read) < 1.6 * read[0] and stored.count() < 400
    store.append("posts", asked.unionByName(empty, allowMissingColumns=True), 3)  # later micro-batches are read whole
    assert asked.join(store.keys("posts", 4)(asked), "content_hash", "left_anti").count() == 0
    assert asked.join(store.keys("posts", 3)(asked), "content_hash", "left_anti").count() == 1


def test_bad_input_is_counted(spark, tmp_path):
    import json

    feed = tmp_path / "feed"
    feed.mkdir()
    odd = batch(1, [(1, "one", []), (2, None, []), (3, " ", [])])
    (feed / "a.json").write_text(json.dumps(odd) + "\n{broken\n" + json.dumps({"source": None, "posts": []}) + "\n")
    store = ChangeStore(spark, str(tmp_path / "store"))
    st.start_ingest(st.read_batch_stream(spark, str(feed)), store, str(tmp_path / "cp")).awaitTermination()
    (row,) = store.current("ledger").collect()
    assert (row["total_received"], row["inserted"], row["updated"], row["skipped"], row["failed"], row["status"], row["errors"]) == (
        3, 1, 0, 1, 1, "partial_failed", ["post[2]: content is missing"])
    assert sorted(r["raw"][:7] for r in store.current("rejected").collect()) == ["no batc", "{broken"]


def test_the_last_to_arrive_wins_whatever_its_id(spark, tmp_path):
    late, early = batch(1, [(7, "same", [])]), batch(2, [(8, "same", [])])
    both = frame(spark, late, early)
    arrival = F.when(F.col("batch_id") == "b1", F.timestamp_seconds(F.lit(20))).otherwise(F.timestamp_seconds(F.lit(10)))
    changes = batch_changes(both.withColumn("arrival", arrival), *(spark.createDataFrame([], d) for d in (
        "batch_id string", "content_hash string", "post_hash string, content_hash string")))
    assert {r["name"] for r in changes.sources.collect()} == {"page 1"}


def test_streaks_across_micro_batches(spark, tmp_path):
    feed, root = str(tmp_path / "feed"), str(tmp_path / "out")
    schema = "src string, at long, known boolean"
    rows = [(f"s{i % 3}", i, (i // 3) % 7 > 1) for i in range(60)] + [("late", 100 + i, True) for i in range(3)]
    (tmp_path / "feed").mkdir()
    everything = spark.createDataFrame(rows, schema)
    stream = spark.readStream.schema(schema).parquet(feed)
    for part in range(4):
        spark.createDataFrame([r for r in rows if r[1] % 1000 // 16 == part or (part == 3 and r[1] >= 64)], schema).coalesce(1).write.mode("append").parquet(feed)
        st.start_streaks(stream, root, f"{root}/_checkpoint", "src", "at", "known", 4).awaitTermination()
    got = {(r["src"], r["at"], r["streak"]) for r in spark.read.parquet(f"{root}/rows").collect()}
    want = {(r["src"], r["at"], r["streak"]) for r in rk.duplicate_streaks(everything, ["src"], "at", F.col("known"), 4).collect()}
    assert got == want


def test_streak_state_is_typed_and_kept_in_the_checkpoint(spark, tmp_path):
    feed, root = str(tmp_path / "feed"), str(tmp_path / "out")
    (tmp_path / "feed").mkdir()
    schema = "src string, at long, known boolean"
    stream = spark.readStream.schema(schema).parquet(feed)
    parts = [[("a", 1, True), ("a", 2, True), (None, 1, True)], [("a", 4, True), ("a", 3, True), ("b", 1, None), (None, 2, False)], [("a", 5, True), ("b", 2, True), (None, 3, True)]]
    for part in parts:
        spark.createDataFrame(part, schema).write.mode("append").parquet(feed)
        st.start_streaks(stream, root, f"{root}/_checkpoint", "src", "at", "known", 4).awaitTermination()
    got = sorted(((r["src"] or "", r["at"], r["streak"]) for r in spark.read.parquet(f"{root}/rows").collect()))
    assert got == [("", 1, 1), ("", 2, 0), ("", 3, 1), ("a", 1, 1), ("a", 2, 2), ("a", 3, 3), ("a", 4, 4), ("b", 1, 0), ("b", 2, 1)]
    state = spark.read.format("statestore").option("path", f"{root}/_checkpoint").option("stateVarName", "run").load()
    held = {r["key"]["src"]: (r["value"]["streak"], r["value"]["stopped"]) for r in state.collect()}
    assert held == {"a": (4, True), "b": (1, False), None: (1, False)}
    assert "RocksDB" not in (spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") or "")


def test_dedup_stream_with_watermark(spark, tmp_path):
    feed, out = str(tmp_path / "feed"), str(tmp_path / "out")
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 01:00:00"), ("b", "2024-01-01 00:30:00")]
    spark.createDataFrame(rows, "k string, at string").select("k", F.to_timestamp("at").alias("at")).write.parquet(feed)
    stream = spark.readStream.schema("k string, at timestamp").parquet(feed)
    (st.distinct_stream(stream, "k", "at", "1 day").writeStream.option("checkpointLocation", out + "/_c").option("path", out + "/rows")
     .format("parquet").trigger(availableNow=True).start().awaitTermination())
    assert sorted(r["k"] for r in spark.read.schema("k string, at timestamp").parquet(out + "/rows").collect()) == ["a", "b"]


def test_state_is_evicted_and_late_rows_are_counted(spark, tmp_path):
    """Hourly batches with a delay of two hours: the state holds the keys of a few hours only, and a late row is dropped and counted."""
    feed, root = str(tmp_path / "feed"), str(tmp_path / "out")
    stream = st.distinct_stream(spark.readStream.schema("k string, at timestamp").parquet(f"{feed}/*"), "k", "at", "2 hours")
    sizes, late = [], 0
    for hour in range(12):
        rows = [(f"k{hour}-{i}", f"2024-01-01 {hour:02d}:00:00") for i in range(50)] + [("again", f"2024-01-01 {hour:02d}:00:00")]
        if hour == 8:
            rows.append(("late", "2024-01-01 01:00:00"))
        spark.createDataFrame(rows, "k string, at string").withColumn("at", F.col("at").cast("timestamp")).write.parquet(f"{feed}/{hour}")
        query = stream.writeStream.option("checkpointLocation", f"{root}/c").option("path", f"{root}/rows").trigger(availableNow=True).format("parquet").start()
        query.awaitTermination()
        size, dropped = st.state_and_late_rows(query)
        sizes.append(size)
        late += dropped
    assert max(sizes) <= 5 * 51 and sizes[-1] <= 5 * 51 and sum(sizes) > 0
    assert late == 1
    got = [r["k"] for r in spark.read.schema("k string, at timestamp").parquet(f"{root}/rows").collect()]
    assert got.count("again") == 3 and "late" not in got and len(set(got)) == 12 * 50 + 1 and len(got) == 12 * 50 + 3


def test_merged_sketches_hold_their_ranks(spark):
    from tidemark.operators import aggregates as agg

    rows = spark.range(4000).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("split"), (F.col("id") % 8).alias("day"),
                                    F.when(F.col("id") < 10, None).otherwise(F.repeat(F.lit("x "), (F.col("id") % 997).cast("int"))).alias("text"))
    sketches = agg.length_sketches(rows, "text", ["split", "day"])
    assert sketches.count() == 16
    for r in agg.merged_lengths(sketches, ["split"]).collect():
        assert r["count"] == 1995
        if r["unit"] == "chars":
            assert abs(r["median"] - 997) < 60 and abs(r["p95"] - 1892) < 60
    assert agg.merged_lengths(agg.length_sketches(rows.limit(0), "text", ["split"]), ["split"]).count() == 0


def test_feed_is_written_by_many_tasks(spark, monkeypatch):
    import glob
    from types import SimpleNamespace

    from tidemark.plans import flows
    from tidemark.plans.base import Tables

    feeds, files = [], []
    monkeypatch.setattr(flows.st, "read_batch_stream", lambda s, path, n=100: feeds.append(path))
    monkeypatch.setattr(flows.st, "start_ingest", lambda *a: SimpleNamespace(
        awaitTermination=lambda: files.append(len(glob.glob(f"{feeds[-1]}/*.json")))))
    monkeypatch.setattr(flows, "written", lambda df, name: df.repartition(4))
    flows._drained_store(Tables(spark, "/root/testdata/sf0.01"))
    # Three parts, one after the other, each in several files.
    assert len(files) == 3 and files[0] >= 2 and files[1] >= files[0] + 2 and files[2] >= files[1] + 3
