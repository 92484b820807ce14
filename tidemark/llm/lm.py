"""Scoring of whole documents by a gated recurrent language model.

Spark counts every word of the training documents. The most frequent words are
the network's symbols; every other word stands for a type by its last two
bytes, and is scored as p(type in context) times its share of the type's
counts. The network is trained in rounds: each document belongs to one round,
each trainer starts from the round's weights and runs once over its documents by
truncated backpropagation, and the trainers' weights are averaged by Spark,
weighted by tokens. So the weights see every training document once, and what
comes to the driver is one set of weights a round, whatever the input. The
number of trainers follows from the tokens, and hashes of id and text deal the
documents to them and order them there, so the files and partitions of the
input decide neither how many trainers there are nor what each of them sees.

Counts of the ``frequent`` most frequent words are broadcast (a fixed size);
counts of all others are joined by word, as rows of words of a document.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import gru
from tidemark.llm.words import Words, segments
from tidemark.session import written

TYPES = 64
PIECE = 4 << 20  # bytes of text that the network looks at together
BLOCK = 4096     # weights of a row when tasks' weights are averaged


@dataclass(frozen=True)
class Settings:
    symbols: int = 959      # words with a symbol of their own; with the types and the end 1024 symbols
    frequent: int = 1 << 18
    hidden: int = 16
    rounds: int = 3
    trainer_tokens: int = 1 << 21  # a trainer has about this many tokens a round at least
    trainers: int = 4096    # at most so many side by side; beyond, each has more tokens
    rows: int = 512         # rows trained side by side
    score_rows: int = 1024
    steps: int = 32
    rate: float = 0.01
    seed: int = 7


@dataclass
class Model:
    """Counts and weights; arrays of words are sorted by word."""

    words: np.ndarray         # ids of the frequent words
    counts: np.ndarray        # their counts
    symbols: np.ndarray       # their symbols, or -1
    rank_of_type: np.ndarray  # symbols of the types
    end: int                  # symbol of the end
    end_count: int
    total: int                # N
    distinct: int             # V
    type_mass: np.ndarray     # per type, sum of count + 1 over its words
    weights: dict | None
    key: str = ""


def word_types(w: Words) -> np.ndarray:
    last = w.data[w.ends - 1].astype(np.int64)
    return (last * 31 + w.data[np.maximum(w.ends - 2, w.starts)].astype(np.int64) * 17) % TYPES


def _merge(parts: list[tuple]) -> list[tuple]:
    ids, kind, n = (np.concatenate(c) for c in zip(*parts))
    found, first, where = np.unique(ids, return_index=True, return_inverse=True)
    return [(found, kind[first], np.bincount(where, n).astype(np.int64))]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``word, kind, n`` of a task, at most some million words at a time."""
    parts: list[tuple] = []

    def rows(parts):
        ids, kind, n = parts[0]
        return pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(kind), pa.array(n)], ["word", "kind", "n"])

    for batch in batches:
        for w in segments(batch.column(0), True):
            ids, first, n = np.unique(w.ids, return_index=True, return_counts=True)
            parts.append((ids, word_types(w)[first], n))
            if sum(len(p[0]) for p in parts) > 2_000_000:
                parts = _merge(parts)
                if len(parts[0][0]) > 1_000_000:
                    yield rows(parts)
                    parts = []
    if parts:
        yield rows(_merge(parts))


def _shared(value):
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession().sparkContext.broadcast(value)


def count_words(training: DataFrame, text: str) -> DataFrame:
    """``word, kind, n`` of the training documents."""
    rows = training.select(F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(_word_counts, "word bigint, kind bigint, n bigint")
    return written(rows.groupBy("word").agg(F.max("kind").alias("kind"), F.sum("n").alias("n")), "lm-words")


def _frequent(counts: DataFrame, most: int) -> pd.DataFrame:
    """Words whose count is in the highest brackets that hold ``most`` words at most, by falling count.

    Only bracket sizes and the chosen words come to the driver.
    """
    bracket = F.floor(F.log2("n") * 32).cast("int")
    sizes = counts.groupBy(bracket.alias("bracket")).count().toPandas().sort_values("bracket", ascending=False)
    kept = sizes[sizes["count"].cumsum() <= most]["bracket"]
    chosen = counts.filter(bracket >= int(kept.min())) if len(kept) else counts.limit(0)
    return chosen.toPandas().sort_values(["n", "word"], ascending=[False, True]).reset_index(drop=True)


def _vocabulary(counts: DataFrame, documents: int, settings: Settings) -> Model:
    top = _frequent(counts, settings.frequent)
    kinds = counts.groupBy("kind").agg(F.sum("n").alias("n"), F.sum(F.col("n") + 1).alias("mass"), F.count(F.lit(1)).alias("words")).toPandas()
    own = top.head(settings.symbols)
    by_type = np.zeros((3, TYPES), np.int64)
    for row, column in enumerate(("n", "mass", "words")):
        by_type[row, kinds["kind"]] = kinds[column]
        minus = own["n"] if column == "n" else own["n"] + 1 if column == "mass" else np.ones(len(own), np.int64)
        np.subtract.at(by_type[row], own["kind"].to_numpy(np.int64), minus.to_numpy(np.int64) if hasattr(minus, "to_numpy") else minus)
    # Symbols by rank: own words, types, the end.
    mass = np.concatenate([own["n"].to_numpy(np.int64), by_type[0], [documents]])
    rank = np.empty(len(mass), np.int64)
    rank[np.argsort(-mass, kind="stable")] = np.arange(len(mass))
    symbols = np.full(len(top), -1, np.int64)
    symbols[:len(own)] = rank[:len(own)]
    order = np.argsort(top["word"].to_numpy(np.int64).view(np.uint64))
    model = Model(top["word"].to_numpy(np.int64).view(np.uint64)[order], top["n"].to_numpy(np.int64)[order], symbols[order],
                  rank[len(own):len(own) + TYPES], int(rank[-1]), documents, int(kinds["n"].sum()) + documents,
                  int(kinds["words"].sum()) + (documents > 0), by_type[1], None)
    model.weights = gru.start(np.sort(mass)[::-1], settings.hidden, settings.seed) if documents else None
    return model


def _lookup(w: Words, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count (or -1 if not frequent), symbol and type of each word."""
    kind = word_types(w)
    if not len(model.words):
        return np.full(len(w.ids), -1, np.int64), model.rank_of_type[kind], kind
    at = np.searchsorted(model.words, w.ids)
    at[at == len(model.words)] = 0
    known = model.words[at] == w.ids
    symbol = np.where(known, model.symbols[at], -1)
    return np.where(known, model.counts[at], -1), np.where(symbol >= 0, symbol, model.rank_of_type[kind]), np.where(symbol >= 0, -1, kind)


def _train_round(model: Model, settings: Settings):
    """Rows ``block, tokens, values`` of a trainer's weights after its documents."""
    shared = _shared(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        trainer = gru.Trainer({k: v.copy() for k, v in m.weights.items()}, settings.rate, settings.steps)
        for batch in batches:
            for w in segments(batch.column(0), True, PIECE):
                trainer.learn(gru.Documents(_lookup(w, m)[1], w.bounds, m.end, settings.rows), m.end, settings.rows)
        if trainer.seen:
            flat = np.concatenate([trainer.w[k].ravel() for k in sorted(trainer.w)])
            cut = range(0, len(flat), BLOCK)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(cut)), pa.int64()), pa.array([trainer.seen] * len(cut), pa.int64()),
                                              pa.array([flat[i:i + BLOCK].tobytes() for i in cut], pa.binary())], ["block", "tokens", "values"])

    return run


def _average(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["tokens", "values"])
    total = sum(np.frombuffer(v, np.float32).astype(np.float64) * t for v, t in zip(rows["values"], rows["tokens"]))
    return pd.DataFrame({"block": rows["block"].iloc[:1], "values": [(total / rows["tokens"].sum()).astype(np.float32).tobytes()]})


def fit(docs: DataFrame, key: str, text: str, usable: Column, settings: Settings = Settings()) -> tuple[Model, DataFrame]:
    """The model, and the table of word counts, from the rows for which ``usable`` holds."""
    training = docs.filter(usable)
    documents = training.count()
    counts = count_words(training, text)
    model = _vocabulary(counts, documents, settings)
    body = F.coalesce(F.col(text), F.lit(""))
    texts = training.select(body.alias("text"), F.xxhash64(F.lit(settings.seed), F.col(key), body).alias("order"))
    trainers = max(1, min(settings.trainers, round(model.total / settings.rounds / settings.trainer_tokens)))
    for number in range(settings.rounds if documents else 0):
        model.key = uuid.uuid4().hex
        own = texts.filter(F.pmod("order", F.lit(settings.rounds)) == number).repartition(trainers, F.shiftright("order", 8))
        rows = own.sortWithinPartitions("order", "text").select("text").mapInArrow(
            _train_round(model, settings), "block bigint, tokens bigint, values binary")
        blocks = rows.groupBy("block").applyInPandas(_average, "block bigint, values binary").collect()
        if blocks:
            flat = np.concatenate([np.frombuffer(r["values"], np.float32) for r in sorted(blocks, key=lambda r: r["block"])])
            at = 0
            for k in sorted(model.weights):
                size = model.weights[k].size
                model.weights[k] = flat[at:at + size].reshape(model.weights[k].shape).copy()
                at += size
    model.key = uuid.uuid4().hex
    return model, counts


SCORED = ("n_tokens bigint, n_known bigint, base double, model double, "
          "rare array<struct<word:bigint,kind:bigint,k:bigint>>")


def _score_rows(model: Model, settings: Settings):
    shared = _shared(model)
    item = pa.struct([("word", pa.int64()), ("kind", pa.int64()), ("k", pa.int64())])

    @F.arrow_udf(f"struct<{','.join(p.strip().replace(' ', ':', 1) for p in SCORED.split(', '))}>")
    def run(column: pa.Array) -> pa.Array:
        m = shared.value
        parts = []
        for w in segments(column, True, PIECE):
            count, symbol, kind = _lookup(w, m)
            frequent = count >= 0
            n = np.diff(w.bounds) + 1
            end_known = m.end_count > 0
            known = np.bincount(w.row[frequent], minlength=w.rows) + end_known
            base = np.bincount(w.row[frequent], np.log10(count[frequent] + 1.0), w.rows) + np.log10(m.end_count + 1.0)
            share = frequent & (kind >= 0)
            value = np.zeros(w.rows) + np.bincount(w.row[share], np.log10(count[share] + 1.0), w.rows)
            typed = kind >= 0
            value -= np.bincount(w.row[typed], np.log10(m.type_mass[kind[typed]] + 1.0), w.rows)
            if m.weights is not None:
                value += gru.score(m.weights, gru.Documents(symbol, w.bounds, m.end, settings.score_rows)) / np.log(10)
            # Words whose counts have to be joined: one entry a document and word.
            rare = np.flatnonzero(~frequent)
            order = rare[np.lexsort((w.ids[rare], w.row[rare]))]
            row, ids = w.row[order], w.ids[order]
            new = np.ones(len(order), bool)
            new[1:] = (row[1:] != row[:-1]) | (ids[1:] != ids[:-1])
            at = np.flatnonzero(new)
            entries = pa.StructArray.from_arrays([pa.array(ids[at].view(np.int64)), pa.array(kind[order][at]),
                                                  pa.array(np.diff(np.append(at, len(order))), pa.int64())], fields=list(item))
            offsets = np.searchsorted(row[at], np.arange(w.rows + 1))
            parts.append(pa.StructArray.from_arrays(
                [pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(value, pa.float64()),
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), entries)], ["n_tokens", "n_known", "base", "model", "rare"]))
        kind_ = pa.struct([("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("model", pa.float64()), ("rare", pa.list_(item))])
        return pa.concat_arrays(parts) if parts else pa.array([], kind_)

    return run


def score(docs: DataFrame, key: str, text: str, model: Model, counts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Key, ``n_tokens, n_known, train_tokens, base_score, score`` of each row.

    Null and empty texts are the end alone. Repeated rows and keys keep a row
    each. Without training documents ``score`` has no network part, and every
    token is unknown.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("place"), F.col(key).alias("key"),
                       _score_rows(model, settings)(F.coalesce(F.col(text), F.lit(""))).alias("s")).select("place", "key", "s.*")
    rows = written(rows, "lm-scores")
    rare = rows.select("place", F.explode("rare").alias("r")).select("place", "r.*")
    c = F.coalesce(F.col("n"), F.lit(0))
    sums = rare.join(counts.select("word", "n"), "word", "left").groupBy("place").agg(
        F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("rare_known"), F.sum(F.col("k") * F.log10(c + 1.0)).alias("rare_log"))
    joined = rows.drop("rare").join(sums, "place", "left")
    extra = F.coalesce("rare_log", F.lit(0.0))
    return joined.select(
        F.col("key").alias(key), "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + extra - F.col("n_tokens") * F.lit(float(np.log10(model.total + model.distinct + 1.0)))).alias("base_score"),
        (F.col("model") + extra).alias("score"))
