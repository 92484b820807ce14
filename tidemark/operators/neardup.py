"""Near-duplicate rule: texts whose sets of word shingles are similar, found by MinHash bands and checked exactly.

Equal sets fold to one class first, so copies meet nobody. Each class gets
``BANDS`` values of ``ROWS`` minima; two classes that share a value in a band are
candidates, and every candidate that counts is checked on the whole sets. With 20
bands of 5 rows a pair at similarity 0.9 is missed with a chance of 2 in 10^8
(0.8: 4 in 10^4), and what is found is always right.

What is asked for is the first text that each text is similar to. So a bucket
(the classes with one value in a band) is first compared with its own first class
only: one comparison a member, however large the family of near copies. Others
in the bucket are looked at just where that one is not similar, and only those
that come before the first similar one known by then.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.parse import text_key
from tidemark.functions.regex import let
from tidemark.session import written

BANDS, ROWS = 20, 5
FEW = 2_000_000


def shingles(text: Column, words: int = 5) -> Column:
    """Sorted distinct 64-bit hashes of the runs of ``words`` words, case and white space apart; a shorter text is one run, an empty one has none."""
    def runs(parts: Column) -> Column:
        last = F.greatest(F.size(parts) - (words - 1), F.lit(1))
        return F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.array_join(F.slice(parts, i, words), " ")))

    key = text_key(text)
    found = let(F.split(key, " ", -1), lambda parts: F.array_sort(F.array_distinct(runs(parts))))
    return F.when(F.coalesce(key, F.lit("")) != "", found)


def band_values(hashes: Column, bands: int = BANDS, rows: int = ROWS, seed: int = 7) -> Column:
    """One value a band: a digest of the least of each of its ``rows`` seeded permutations of the hashes."""
    rng = np.random.default_rng(seed)
    factors = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    terms = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    @F.arrow_udf("array<bigint>")
    def run(lists: pa.Array) -> pa.Array:
        starts = lists.offsets.to_numpy()[:-1].astype(np.int64) - (lists.offsets[0].as_py() if len(lists) else 0)
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        found = np.zeros((len(lists), bands), np.uint64)
        for i in range(bands * rows if len(flat) else 0):
            mixed = flat * factors[i] + terms[i]
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            least = np.minimum.reduceat(mixed, starts)
            found[:, i // rows] = found[:, i // rows] * np.uint64(0x9E3779B97F4A7C15) + least
        values = pa.array(found.view(np.int64).reshape(-1))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1) * bands, pa.int32()), values)

    return run(hashes)


def _similar(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The written pairs ``a, b`` of classes with ``similar``; sizes that rule it out are not compared.

    Few classes are in any pair, and only their sets move: up to ``FEW`` classes are
    broadcast, as 64-bit hashes, to where the sets are read.
    """
    wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("class")).select(F.xxhash64("class").alias("c")).distinct(), "shingle-wanted")
    few = wanted.count() <= FEW
    sets = sets.join(F.broadcast(wanted), F.xxhash64("class") == F.col("c"), "left_semi") if few else sets
    left = sets.select(F.col("class").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("class").alias("b"), F.col("hashes").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    n, m = F.size("x"), F.size("y")
    close = den * F.least(n, m) >= num * F.greatest(n, m)
    shared = F.size(F.array_intersect("x", "y"))
    ok = F.when(close, let(shared, lambda s: den * s >= num * (n + m - s))).otherwise(False)
    return both.select("a", "b", ok.alias("similar"))


def near_duplicates(df: DataFrame, key: str, text: str, num: int = 9, den: int = 10, words: int = 5) -> DataFrame:
    """Key, ``first_key`` and ``is_near_duplicate`` of each row.

    ``first_key`` is the least key among the rows whose similarity to this one is
    ``num / den`` or more, itself included. Rows without words are only similar to
    themselves. Keys should be unique; a null key comes after all others.
    """
    rows = written(df.select(F.col(key).alias("key"), shingles(F.col(text), words).alias("hashes")).withColumns(
        {"h": F.xxhash64("hashes"), "g": F.xxhash64(F.lit(1), "hashes")}), "shingle-sets")
    some = rows.filter("hashes IS NOT NULL")
    folded = some.groupBy("h", "g").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key")).alias("id"), F.any_value("hashes").alias("hashes"))
    # A class is named by its first key, so classes compare as their keys do.
    sets = written(folded.select(F.struct("id.none", "id.key", "h", "g").alias("class"), "hashes"), "shingle-classes")
    banded = sets.select("class", F.posexplode(band_values(F.col("hashes"))).alias("band", "value"))
    banded = written(banded, "shingle-bands")
    first = banded.groupBy("band", "value").agg(F.min("class").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    buckets = written(banded.withColumnRenamed("class", "a").join(first, ["band", "value"]), "shingle-buckets")
    leaders = written(buckets.filter("a <> b").select("a", "b").distinct(), "shingle-pairs")
    led = written(_similar(leaders, sets, num, den), "shingle-leaders")
    known = led.filter("similar").groupBy("a").agg(F.min("b").alias("least"))
    open_ = buckets.filter("n > 2").join(led.filter("NOT similar").select("a", "b"), ["a", "b"]).join(known, "a", "left")
    others = banded.withColumnRenamed("class", "c").join(open_, ["band", "value"])
    others = others.filter((F.col("c") > F.col("b")) & (F.col("c") < F.coalesce("least", "a"))).select("a", F.col("c").alias("b")).distinct()
    others = written(others, "shingle-pairs")
    more = _similar(others, sets, num, den).filter("similar").select("a", "b")
    least = led.filter("similar").select("a", "b").unionByName(more).groupBy("a").agg(F.min("b").alias("b"))
    linked = sets.select(F.col("class").alias("a")).join(least, "a", "left").select("a.h", "a.g", F.least("a", F.coalesce("b", "a")).alias("f"))
    found = rows.select("key", "h", "g", F.col("hashes").isNotNull().alias("some")).join(
        linked.withColumn("some", F.lit(True)), ["h", "g", "some"], "left")
    least_key = F.when(F.col("f").isNull() | F.col("f.none"), F.col("key")).otherwise(F.col("f.key"))
    return found.select(F.col("key").alias(key), least_key.alias("first_key"), F.coalesce(~F.col("key").eqNullSafe(least_key), F.lit(False)).alias("is_near_duplicate"))
