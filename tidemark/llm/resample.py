"""Importance resampling of documents towards a target, by hashed n-gram features of deduplicated segments.

Newlines never lie inside a word, so they cut a text into lines whose words,
one line after the other, are the text's. Lines are grouped first: the features
of a distinct line are hashed once, and its bucket counts are multiplied by its
occurrences. The n-grams that reach over a line's end are added for each
document on its own, from the first and last ``n - 1`` words of its lines. The
features of each distinct line are written once; corpus counts, gains and the
documents' weights are all taken from that table, so no text is hashed again.

A document's weight is the floored mean of its features' gains, its score adds
a Gumbel draw from a hash of its key, and the highest scores are drawn: sampling
without replacement in proportion to the exponentiated weights.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.decontaminate import normal_words
from tidemark.llm.hot import join_counted
from tidemark.operators.ranking import prefix_scan
from tidemark.session import written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    """The lines that hold a word, with A-Z in lower case; null text has none."""
    lines = F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UP, _LOW), "\n", -1)
    return F.filter(lines, lambda line: line.rlike(WORD))


def grams(words: list[bytes], n: int, buckets: int) -> list[int]:
    """Buckets of the runs of 1 to ``n`` words."""
    found = [h % buckets for h in map(zlib.crc32, words)]
    for k in range(2, n + 1):
        found += [zlib.crc32(b" ".join(words[i:i + k])) % buckets for i in range(len(words) - k + 1)]
    return found


def crossing(lines: list[list[bytes]], n: int, buckets: int) -> list[int]:
    """Buckets of the runs of 2 to ``n`` words that reach over the end of a line.

    Of each line only the first and last ``n - 1`` words matter. Between them
    lies a gap in long lines, but no run of up to ``n`` words holds both that
    gap and a line's end.
    """
    words, of = [], []
    for no, line in enumerate(lines):
        kept = line if len(line) <= 2 * (n - 1) else line[:n - 1] + line[1 - n:]
        words += kept
        of += [no] * len(kept)
    return [zlib.crc32(b" ".join(words[i:i + k])) % buckets for k in range(2, n + 1)
            for i in range(len(words) - k + 1) if of[i] != of[i + k - 1]]


_FEATURES = pa.struct([("words", pa.int32()), ("features", pa.list_(pa.int32()))])


def _lists(found: list[list[int]]) -> pa.Array:
    values = np.fromiter(itertools.chain.from_iterable(found), np.int32)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(values))


def line_features(line: Column, n: int, buckets: int) -> Column:
    """Number of words of a line, and its buckets."""

    @F.arrow_udf("struct<words:int,features:array<int>>")
    def run(column: pa.Array) -> pa.Array:
        words = [normal_words(t) for t in column.to_pylist()]
        found = _lists([grams(w, n, buckets) for w in words])
        return pa.StructArray.from_arrays([pa.array([len(w) for w in words], pa.int32()), found], fields=list(_FEATURES))

    return run(line)


def crossing_features(text: Column, n: int, buckets: int) -> Column:
    @F.arrow_udf("array<int>")
    def run(column: pa.Array) -> pa.Array:
        return _lists([crossing([normal_words(line) for line in (t or "").split("\n")], n, buckets) for t in column.to_pylist()])

    return run(text)


def _line_key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def segment_features(docs: DataFrame, text: str, n: int, buckets: int) -> DataFrame:
    """Distinct lines: ``line`` (128 bits of hash), ``occurrences``, their ``features`` (buckets) and number of ``words``; written once."""
    lines = docs.select(F.explode(lines_of(F.col(text))).alias("line")).groupBy("line").agg(F.count(F.lit(1)).alias("occurrences"))
    found = lines.select(_line_key(F.col("line")).alias("key"), "occurrences", line_features(F.col("line"), n, buckets).alias("f"))
    return written(found.select(F.col("key").alias("line"), "occurrences", "f.*"), "segment-features")


def document_lines(docs: DataFrame, key: str, text: str, n: int, buckets: int) -> DataFrame:
    """A row a document: ``row``, its key as ``key``, the keys of its ``lines`` and the buckets ``crossing`` lines; written once."""
    lines = lines_of(F.col(text))
    over = crossing_features(F.col(text).cast("string"), n, buckets) if n > 1 else F.array().cast("array<int>")
    return written(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.transform(lines, _line_key).alias("lines"),
        over.alias("crossing")), "document-lines")


def bucket_counts(segments: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """``bucket, n`` over all documents: lines times their occurrences, and what crosses lines."""
    counted = segments.select(F.explode("features").alias("bucket"), "occurrences").groupBy("bucket").agg(F.sum("occurrences").alias("n"))
    if n > 1:
        over = rows.select(F.explode("crossing").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
        counted = counted.unionByName(over).groupBy("bucket").agg(F.sum("n").alias("n"))
    return counted


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """``bucket, gain`` of all buckets: thousandths of the log ratio of smoothed target and source shares, floored."""
    both = source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = both.join(source.select("bucket", F.col("n").alias("s")), "bucket", "left").join(target.select("bucket", F.col("n").alias("t")), "bucket", "left")
    both = both.select("bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t")])
    totals = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    # One row of totals.
    return both.crossJoin(totals).select("bucket", F.floor(1000 * F.log(
        (F.col("t") + 1) * (F.col("all_s") + buckets) / ((F.col("s") + 1) * (F.col("all_t") + buckets)))).alias("gain"))


def sum_of(buckets: Column, values: np.ndarray) -> Column:
    """Sum of the values of an array of buckets."""

    @F.arrow_udf("bigint")
    def run(lists: pa.Array) -> pa.Array:
        total = np.append(0, np.cumsum(values[lists.flatten().to_numpy(zero_copy_only=False)]))
        ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        return pa.array(np.diff(total[ends], prepend=0), pa.int64())

    return run(buckets)


def _floor_div(a: Column, b: Column) -> Column:
    """Exact floored quotient of two whole numbers, the second above 0."""
    return F.call_function("div", a - F.pmod(a, b), b)


def weights(docs: DataFrame, key: str, text: str, target: DataFrame, target_text: str, n: int = 1, buckets: int = 10000) -> DataFrame:
    """``row``, the key, ``n_words``, ``n_features`` and ``weight`` of each document; ``target`` shows the wanted distribution.

    Null and empty texts have no features and weight 0. Rows are told apart by
    place, so repeated keys and rows keep a row each.
    """
    segments, rows = segment_features(docs, text, n, buckets), document_lines(docs, key, text, n, buckets)
    wanted = target.select(F.col(target_text).alias("text"))
    to, to_rows = segment_features(wanted, "text", n, buckets), document_lines(wanted.select(F.lit(None).cast("long").alias("key"), "text"), "key", "text", n, buckets)
    gains = bucket_gains(bucket_counts(segments, rows, n), bucket_counts(to, to_rows, n), buckets)
    gain = np.zeros(buckets, np.int64)
    for r in gains.collect():  # as many numbers as there are buckets, a parameter
        gain[r["bucket"]] = r["gain"]
    total = lambda c: sum_of(c, gain)
    lines = segments.select("line", "occurrences", F.size("features").alias("n"), "words", total(F.col("features")).alias("g"))
    places = rows.select("row", F.explode("lines").alias("line"))
    count = segments.agg(F.sum("occurrences")).first()[0] or 0
    sums = join_counted(places, lines, ["line"], "occurrences", count).groupBy("row").agg(
        F.sum("words").alias("n_words"), F.sum("n").alias("n"), F.sum("g").alias("g"))
    over = rows.select("row", "key", F.size("crossing").alias("over_n"), total(F.col("crossing")).alias("over_g"))
    both = over.join(sums, "row", "left").select(
        "row", "key", F.coalesce("n_words", F.lit(0)).cast("long").alias("n_words"),
        (F.coalesce("n", F.lit(0)) + F.col("over_n")).cast("long").alias("n_features"), (F.coalesce("g", F.lit(0)) + F.col("over_g")).alias("g"))
    return both.select("row", F.col("key").alias(key), "n_words", "n_features", F.when(
        F.col("n_features") > 0, _floor_div(F.col("g"), F.col("n_features"))).otherwise(0).cast("long").alias("weight"))


def gumbel(key: Column, seed: int) -> Column:
    """Thousandths of a Gumbel draw from a hash of seed and key, floored; a null key reads as empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def draw(scored: DataFrame, key: str, eligible: Column, share: int, of: int) -> DataFrame:
    """All rows with ``rank``: the highest scores among the ``eligible``, ``share`` in ``of`` (floored), ties to the smaller key, nulls last.

    ``scored`` has whole-number ``score`` and is read several times. Scores are
    counted first, which tells the lowest score drawn; only rows from there on
    are ranked, score by score, and equal rows are folded before they meet.
    """
    rows = scored.withColumn("__in", F.coalesce(eligible, F.lit(False)))
    counts = rows.filter("__in").groupBy("score").agg(F.count(F.lit(1)).alias("n")).withColumn("down", -F.col("score"))
    counts = written(prefix_scan(counts, [], ["down"], F.shiftright("down", 8), {"upto": F.col("n")}), "score-counts")
    size = (counts.agg(F.sum("n")).first()[0] or 0) * share // of
    lowest = counts.filter(F.col("upto") - F.col("n") < size).agg(F.min("score")).first()[0] if size else None
    if lowest is None:
        return rows.withColumn("rank", F.lit(None).cast("long")).drop("__in")
    chosen = F.col("__in") & (F.col("score") >= lowest)
    names = [c for c in scored.columns if c != key]
    folded = rows.filter(chosen).groupBy(key, *names).agg(F.count(F.lit(1)).alias("__m"))
    placed = folded.join(counts.select("score", (F.col("upto") - F.col("n")).alias("__before")), "score")
    inside = Window.partitionBy("score").orderBy(F.col(key).asc_nulls_last(), *names).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("__first", F.col("__before") + F.sum("__m").over(inside) - F.col("__m"))
    # Copies of a row come back a thousand at a time.
    some = placed.withColumn("__at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__m") - 1, F.lit(1000).cast("long"))))
    each = some.withColumn("__no", F.explode(F.sequence(F.col("__at"), F.least(F.col("__at") + 999, F.col("__m") - 1))))
    rank = F.col("__first") + F.col("__no") + 1
    drawn = each.select(*scored.columns, F.when(rank <= size, rank).alias("rank"))
    return drawn.unionByName(rows.filter(~chosen).select(*scored.columns, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, key: str, text: str, target: DataFrame, target_text: str, n: int = 1, buckets: int = 10000, seed: int = 2024,
             least_words: int = 20, share: int = 10, of: int = 100) -> DataFrame:
    """Key, ``n_words, n_features, weight, score, rank`` of each row; ``rank`` is null where a row is not drawn.

    Rows of fewer than ``least_words`` words are not eligible. Empty tables give
    no rows; an empty target favours what is rare. Other columns are ignored.
    """
    found = weights(docs, key, text, target, target_text, n, buckets).drop("row")
    found = written(found.withColumn("score", F.col("weight") + gumbel(F.col(key), seed)), "resample-scores")
    return draw(found, key, F.col("n_words") >= least_words, share, of)
