"""Streaming ingest, duplicate removal, streak detection and schedules."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.operators.triage import EXTERNAL, analyze_items
from tidemark.operators.upsert import batch_changes
from tidemark.session import written
from tidemark.sources.tables import FILE_SCHEMA, arrived
from tidemark.streaming.store import KEYS, ChangeStore


def read_batch_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """JSON batches as they arrive in a folder."""
    return arrived(spark.readStream.schema(FILE_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(path))


Answers = Callable[[DataFrame], DataFrame]


def no_answers(posts: DataFrame) -> DataFrame:
    """The answers of a provider that gave none: the rules judge every post."""
    return posts.sparkSession.createDataFrame([], f"content_hash string, answer struct<{EXTERNAL.replace(' ', ':').replace(',:', ',')}>, error string")


def apply_batches(store: ChangeStore, batches: DataFrame, epoch: int, label: bool = True, compact_every: int = 50,
                  answers: Answers = no_answers, models: Answers | None = None) -> None:
    """Write what one micro-batch changes; the same epoch again gives the same tables.

    The flat posts are written once under the shared folder, since several tables
    are derived from them. New and changed posts are analysed: ``answers`` gives
    an external provider's answers for posts, ``models`` the other models' label
    codes, both by ``content_hash``. Input without a batch id goes to ``rejected``. Every
    ``compact_every`` micro-batches the history before this one is folded.
    """
    if compact_every and epoch and epoch % compact_every == 0:
        for table in KEYS:
            store.compact(table, epoch)
    raw = F.col("_corrupt_record") if "_corrupt_record" in batches.columns else F.to_json(F.struct("source", "posts"))
    store.append("rejected", batches.filter("batch_id IS NULL").select(F.coalesce(raw, F.lit("no batch id")).alias("raw")), epoch)
    ids = batches.groupBy("batch_id").count().agg(F.max("count")).first()[0]
    changes = batch_changes(
        batches, store.keys("ledger", epoch), store.keys("posts", epoch), store.keys("comments", epoch),
        unique=ids in (None, 1), stage=written)
    store.append("sources", changes.sources, epoch)
    store.append("posts", changes.posts, epoch)
    store.append("comments", changes.comments, epoch)
    if label:
        new_posts = store.changes("posts").filter(F.col("epoch") == epoch)
        posts = new_posts.select("content_hash", "content")
        judged = analyze_items(posts, answers(posts), None if models is None else models(posts), "content_hash")
        judged = written(judged.withColumn("labeled_at", F.current_timestamp()), "analyses")
        store.append("analyses", judged, epoch)
        store.append("items", judged, epoch)
    store.append("ledger", changes.ledger, epoch)


def start_ingest(stream: DataFrame, store: ChangeStore, checkpoint: str, label: bool = True, answers: Answers = no_answers,
                 models: Answers | None = None, **trigger) -> StreamingQuery:
    """Continuous ingest with an effect of exactly once per batch id."""
    return (stream.writeStream.option("checkpointLocation", checkpoint)
            .foreachBatch(lambda df, epoch: apply_batches(store, df, epoch, label, answers=answers, models=models))
            .trigger(**(trigger or {"availableNow": True})).start())


def distinct_stream(stream: DataFrame, key: str, event_time: str | None = None, delay: str = "7 days") -> DataFrame:
    """First row of each key. With an event time the key state is dropped after
    ``delay``; without one it grows with the number of keys."""
    if event_time is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def state_and_late_rows(query: StreamingQuery) -> tuple[int, int]:
    """Rows in the state after the last micro-batch, and rows that came after the watermark and were dropped, by the query's progress."""
    last, late = 0, 0
    for progress in query.recentProgress:
        for operator in progress.stateOperators:
            last = operator.numRowsTotal
            late += operator.numRowsDroppedByWatermark
    return last, late


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Streaks(StatefulProcessor):
    """Run length of known rows of one source across micro-batches; after a run of ``threshold`` the source gives no more rows."""

    def __init__(self, order: str, known: str, threshold: int, idle_ms: int | None):
        self.order, self.known, self.threshold, self.idle_ms = order, known, threshold, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "streak bigint, stopped boolean", self.idle_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        streak, stopped = self.run.get() if self.run.exists() else (0, False)
        if stopped:
            return
        frame = pd.concat(list(rows)).sort_values(self.order)
        is_new = ~frame[self.known].fillna(False).astype(bool).to_numpy()
        place = np.arange(len(frame))
        last_new = np.maximum.accumulate(np.where(is_new, place, -1))
        runs = place - last_new + np.where(last_new < 0, streak, 0)
        hits = np.flatnonzero(runs >= self.threshold)
        end = hits[0] + 1 if len(hits) else len(frame)
        self.run.update((int(runs[end - 1]), bool(len(hits))))
        yield frame.iloc[:end].assign(streak=runs[:end])

    def close(self) -> None:
        pass


def streaks(stream: DataFrame, by: str, order: str, known: str, threshold: int = 10, idle_days: int | None = None) -> DataFrame:
    """The stream's rows with the ``streak`` of known rows of their source, by typed state in Spark's state store.

    Rows of a source must arrive in order from one micro-batch to the next;
    inside one they are sorted. With ``idle_days`` the state of a source that
    sends nothing for so long expires, and its next row starts anew.
    """
    rows = stream.select(by, order, known)
    schema = StructType([*rows.schema.fields, StructField("streak", LongType())])
    idle = None if idle_days is None else idle_days * 86_400_000
    return rows.groupBy(by).transformWithStateInPandas(
        Streaks(order, known, threshold, idle), schema, "Append", "None" if idle is None else "ProcessingTime")


def start_streaks(stream: DataFrame, path: str, checkpoint: str, by: str, order: str, known: str,
                  threshold: int = 10, idle_days: int | None = None, **trigger) -> StreamingQuery:
    """Write ``streaks`` to ``path/rows``; state and output go on from the checkpoint, each row once.

    The state lies in RocksDB, which only this query is started with.
    """
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name, None)
    conf.set(name, ROCKSDB)
    try:
        return (streaks(stream, by, order, known, threshold, idle_days).writeStream.option("checkpointLocation", checkpoint)
                .option("path", f"{path}/rows").format("parquet").trigger(**(trigger or {"availableNow": True})).start())
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


# --- schedules -------------------------------------------------------------------

def parse_schedule(text: str) -> tuple[str, str]:
    """``daily:HH:MM`` or ``hours:N``; a bare value is a daily time, empty is 22:00."""
    value = text.strip()
    for kind in ("daily", "hours"):
        if value.startswith(kind + ":"):
            return kind, value.split(":", 1)[1]
    return "daily", value or "22:00"


def trigger_of(schedule: str) -> dict[str, object]:
    """Stream trigger of a schedule: an interval, or one run over what is available."""
    kind, value = parse_schedule(schedule)
    return {"processingTime": f"{int(value)} hours"} if kind == "hours" else {"availableNow": True}


def next_run(schedule: str, now: datetime) -> datetime:
    """When a schedule is due next."""
    kind, value = parse_schedule(schedule)
    if kind == "hours":
        return now + timedelta(hours=int(value))
    if not re.fullmatch(r"\d{1,2}:\d{2}", value):
        raise ValueError("Use daily:HH:MM or hours:N")
    hour, minute = (int(p) for p in value.split(":"))
    due = now.replace(hour=hour, minute=minute, second=0, microsecond=0)
    return due if due > now else due + timedelta(days=1)


def start_on_schedule(writer: DataStreamWriter, schedule: str) -> StreamingQuery:
    return writer.trigger(**trigger_of(schedule)).start()
