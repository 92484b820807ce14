"""Quality rules: word statistics, and perplexity bands of an n-gram model per language.

The model is a modified Kneser-Ney model of n-grams of ``ORDER`` UTF-8 bytes, so
every character of every script counts as it is. Spark counts the n-grams of every
whole text; the lower orders' continuation counts are Spark aggregates of these.
The model is kept and looked up as sorted arrays of n-grams (the packed bytes)
and of their contexts, with log probabilities and back-off weights; it grows with
the distinct n-grams of a language. n-grams of one document only are left to the
lower orders, as each text is scored by a model that has counted it. Its bands are the median perplexity of the
language's documents, in log10 a character, plus and minus a multiple of the
quartile distance, wider for short texts, whose mean varies more; texts outside
are rejected.

The ``max_languages`` - 1 most frequent languages (by documents, ties by code)
have a model of their own, all others share one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import SEPARATOR, Words, grams, segments
from tidemark.session import file_system, scratch_path

CLASSES = 256  # values of a byte
ORDER = 5  # bytes of an n-gram
HELD = 2_000_000  # n-grams that a task counts before it hands them on
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
OTHER = "*"
RESULT = ("struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,"
          "log_perplexity:double,base_failed:boolean,kept:boolean>")


def byte_grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The ``ORDER`` bytes that end at each byte, as one number; texts begin after white space."""
    row = np.repeat(offsets[:-1], np.diff(offsets))
    into = np.arange(len(data)) - row  # bytes of the text before
    made = data.astype(np.int64)
    for back in range(1, ORDER):
        one = np.full(len(data), ord(" "), np.int64)
        one[back:] = data[:-back]
        one[into < back] = ord(" ")
        made += one << 8 * back
    return made


def characters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Code points of each row."""
    return np.diff(np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets])


def numbered(w: Words, langs: list) -> tuple[list, np.ndarray, np.ndarray]:
    """Languages of the rows, each byte's n-gram as a number, and the numbers' n-grams, with the place of their language above the ``ORDER`` bytes."""
    names = sorted(set(langs))
    place = {n: i for i, n in enumerate(names)}
    own = np.repeat(np.array([place[n] for n in langs], np.int64), np.diff(w.offsets))
    codes, distinct = pd.factorize(byte_grams(w.data, w.offsets) + (own << 8 * ORDER))
    return names, codes, distinct


@dataclass(frozen=True)
class Bands:
    below: float = 6.0  # quartile distances under the median
    above: float = 3.5
    even_chars: int = 400  # a text of a quarter of these has a band twice as wide
    least_chars: int = 100  # shorter texts are not judged by perplexity
    least_spread: float = 0.005  # quartile distance in log10 that is taken at least


@dataclass
class Model:
    """Per language: sorted hashes and log10 probabilities by order, and the band."""

    languages: list[str]
    hashes: dict[str, list[np.ndarray]]
    logs: dict[str, list[np.ndarray]]
    contexts: dict[str, list[np.ndarray]]
    backoff: dict[str, list[np.ndarray]]
    bands: dict[str, tuple[float, float]] = field(default_factory=dict)
    key: str = ""

    def values(self, lang: str, key: np.ndarray, order: int = ORDER) -> np.ndarray:
        """log10 probability of the n-grams' last byte after the others, from the sorted arrays of the orders."""
        value = np.full(len(key), -np.log10(CLASSES))
        for n in range(1, order + 1):
            h, p, seen, b = (x[lang][n - 1] for x in (self.hashes, self.logs, self.contexts, self.backoff))
            if not len(h):
                continue
            gram = key % CLASSES ** n
            # Known context: its back-off weight times the lower order's value; then known n-grams.
            at = np.searchsorted(seen, gram // CLASSES).clip(max=len(seen) - 1)
            value = np.where(seen[at] == gram // CLASSES, value + b[at], value)
            at = np.searchsorted(h, gram).clip(max=len(h) - 1)
            value = np.where(h[at] == gram, p[at], value)
        return value

    def table(self, lang: str) -> np.ndarray:
        """log10 probability of every trigram of bytes, by the model's third order."""
        return self.values(lang, np.arange(CLASSES ** 3), 3)


def _kneser_ney(key: np.ndarray, count: np.ndarray, alone: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, ...]:
    """n-grams that are not ``alone`` (of one document) with log10 probabilities, and their contexts with back-off weights, both sorted.

    ``lower`` has each n-gram's lower-order probability. Those alone are
    discounted whole, so a text is no evidence for itself.
    """
    n = [int((count == i).sum()) for i in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    cut = np.array([0.0] + [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.0), i) if n[i - 1] else 0.5 * y for i in (1, 2, 3)])
    less = np.where(alone, count, cut[np.minimum(count, 3)])
    context, where = np.unique(key // CLASSES, return_inverse=True)
    total = np.bincount(where, count)
    held = np.maximum(np.bincount(where, less), 1e-9)
    p = (count - less) / total[where] + (held / total)[where] * lower
    used = np.bincount(where, ~alone) > 0
    return key[~alone], np.log10(p[~alone]), context[used], np.log10(held / total)[used]


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-gram counts of one task by language, summed up to ``HELD`` of them at a time."""

    def out() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            columns = _summed(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(columns[0])), *map(pa.array, columns)], ["lang", "gram", "n", "low", "high"])

    held: dict[str, list] = {}
    waiting, document = 0, TaskContext.get().partitionId() << 40
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for w in segments(batch.column("text"), False):
            names, codes, distinct = numbered(w, langs[w.first:w.first + w.rows])
            row = np.repeat(np.arange(w.rows), np.diff(w.offsets)) + document + w.first
            low, high = np.zeros((2, len(distinct)), np.int64)
            high[codes], low[codes[::-1]] = row, row[::-1]  # of several writes the last one counts
            count = np.bincount(codes, minlength=len(distinct))
            for i, lang in enumerate(names):
                own = distinct >> 8 * ORDER == i
                held.setdefault(lang, []).append((distinct[own] & (CLASSES ** ORDER - 1), count[own], low[own], high[own]))
            waiting += len(distinct)
            if waiting > HELD:
                held = {lang: [_summed(parts)] for lang, parts in held.items()}
                waiting = sum(len(parts[0][0]) for parts in held.values())
                if 2 * waiting > HELD:
                    yield from out()
                    held, waiting = {}, 0
        document += batch.num_rows
    yield from out()


def _summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Distinct n-grams, their counts, and the first and last document of each."""
    key, count, low, high = (np.concatenate(c) for c in zip(*parts))
    codes, distinct = pd.factorize(key)
    first, last = np.full(len(distinct), np.iinfo(np.int64).max), np.full(len(distinct), -1)
    np.minimum.at(first, codes, low)
    np.maximum.at(last, codes, high)
    return distinct, np.bincount(codes, count, len(distinct)).astype(np.int64), first, last


def _counted(path: str, lang: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A language's sorted n-grams, their counts, and whether they are of one document; read as files, so that no rows pass the driver's JVM."""
    system, root = file_system(path)
    found = pq.read_table(root, columns=["gram", "n", "low", "high"], use_threads=False, filesystem=system, filters=[("lang", "==", lang)])
    key, count, low, high = (found[c].to_numpy() for c in found.column_names)
    order = np.argsort(key)
    return key[order], count[order], (low == high)[order]


def language(lang: Column, own: list[str]) -> Column:
    return F.when(lang.isin(own), lang).otherwise(OTHER) if own else F.lit(OTHER)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", bands: Bands = Bands(), max_languages: int = 16) -> Model:
    """The model and bands of all documents; null languages and texts are allowed."""
    own = [r[0] for r in docs.groupBy(F.col(lang).alias("lang")).count().filter("lang IS NOT NULL")
           .orderBy(F.desc("count"), "lang").limit(max_languages - 1).collect()]
    rows = docs.select(language(F.col(lang), own).alias("lang"), F.col(text).alias("text"))
    partial = rows.mapInArrow(_partial_counts, "lang string, gram bigint, n bigint, low bigint, high bigint")
    # An n-gram of one document has that as its lowest and highest.
    ends = F.min("low").alias("low"), F.max("high").alias("high")
    frame, paths = partial.groupBy("lang", "gram").agg(F.sum("n").alias("n"), *ends), []
    for n in range(ORDER, 0, -1):
        paths.insert(0, scratch_path(docs.sparkSession, "quality-grams"))
        frame.write.parquet(paths[0])
        counted = docs.sparkSession.read.schema(frame.schema).parquet(paths[0])
        # Lower orders count the distinct n-grams above.
        shorter = F.pmod("gram", F.lit(CLASSES ** (n - 1))).alias("gram")
        frame = counted.groupBy("lang", shorter).agg(F.count(F.lit(1)).alias("n"), *ends)
    model = Model([*own, OTHER], {}, {}, {}, {}, key=uuid.uuid4().hex)
    for name in [r[0] for r in counted.select("lang").distinct().orderBy("lang").collect()]:
        arrays = model.hashes, model.logs, model.contexts, model.backoff
        for found in arrays:
            found[name] = []
        for order, path in enumerate(paths, 1):
            key, count, alone = _counted(path, name)
            lower = 10.0 ** model.values(name, key, order - 1)
            for found, made in zip(arrays, _kneser_ney(key, count, alone, lower)):
                found[name].append(made)
    scored = docs.select(language(F.col(lang), own).alias("lang"), log_perplexity(F.col(text), F.col(lang), model).alias("v"),
                         F.char_length(F.col(text)).alias("chars"))
    quartiles = scored.filter(F.col("chars") >= bands.least_chars).groupBy("lang").agg(
        F.percentile_approx("v", [0.25, 0.5, 0.75], 10000).alias("q")).collect()
    for r in quartiles:
        low, middle, high = r["q"]
        spread = max(high - low, bands.least_spread)
        model.bands[r["lang"]] = (middle, spread)
    return model


def _perplexities(w: Words, langs: list, model: Model) -> np.ndarray:
    """log10 perplexity of each row, a code point; 0 for empty ones."""
    names, codes, distinct = numbered(w, langs)
    values = np.zeros(len(distinct))
    for i, lang in enumerate(names):
        if lang in model.hashes:
            own = distinct >> 8 * ORDER == i
            values[own] = model.values(lang, distinct[own] & (CLASSES ** ORDER - 1))
    total = np.concatenate([[0.0], np.cumsum(values[codes])])
    return -np.diff(total[w.offsets]) / np.maximum(characters(w.data, w.offsets), 1)


def log_perplexity(text: Column, lang: Column, model: Model) -> Column:
    shared = _shared(model)

    @F.arrow_udf("double")
    def run(column: pa.Array, names: pa.Array) -> pa.Array:
        langs = names.to_pylist()
        parts = [_perplexities(w, langs[w.first:w.first + w.rows], shared.value) for w in segments(column, False)]
        return pa.array(np.concatenate(parts) if parts else [], pa.float64())

    return run(text, language(lang, model.languages[:-1]))


def _shared(model: Model):
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession().sparkContext.broadcast(model)


def repeat_words(w: Words, n: int) -> np.ndarray:
    """Per row, the words inside windows of ``n`` words that occur twice or more in the row."""
    gram, first = grams(w, n)
    if not len(gram):
        return np.zeros(w.rows, np.int64)
    key = gram ^ (w.row[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    step = np.zeros(len(w.ids) + 1, np.int64)
    np.add.at(step, first[twice], 1)
    np.add.at(step, first[twice] + n, -1)
    inside = np.cumsum(step[:-1]) > 0
    return np.bincount(w.row[inside], minlength=w.rows)


def repeat_lines(texts: pa.Array) -> np.ndarray:
    found = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts.to_pylist()):
        if t and "\n" in t:
            lines = [x for x in t.encode("utf-8").split(b"\n") if x.strip()]
            found[i] = len(lines) - len(set(lines))
    return found


def quality(text: Column, lang: Column, model: Model, bands: Bands = Bands()) -> Column:
    """Struct of the statistics, ``base_failed`` and ``kept``.

    Null and empty texts have no words and fail the base. Texts of fewer than
    ``least_chars`` characters, and languages without a model, pass the band.
    """
    shared = _shared(model)

    @F.arrow_udf(RESULT)
    def run(column: pa.Array, names: pa.Array) -> pa.Array:
        langs = names.to_pylist()
        parts = []
        for w in segments(column, False):
            own = langs[w.first:w.first + w.rows]
            solid = np.concatenate([[0], np.cumsum(~SEPARATOR[w.data] & ((w.data & 0xC0) != 0x80))])
            marks = np.concatenate([[0], np.cumsum(SYMBOLS[w.data])])
            value = _perplexities(w, own, shared.value)
            words, again = np.diff(w.bounds), repeat_words(w, 5)
            failed = (words < 10) | (100 * again > 20 * words)
            chars = characters(w.data, w.offsets)
            middle, spread = np.array([shared.value.bands.get(n, (0.0, np.inf)) for n in own]).T
            spread = spread * np.sqrt(np.maximum(1, bands.even_chars / np.maximum(chars, 1)))
            outside = (chars >= bands.least_chars) & ((value < middle - bands.below * spread) | (value > middle + bands.above * spread))
            parts.append([words, np.diff(solid[w.offsets]), np.diff(marks[w.offsets]), repeat_lines(column.slice(w.first, w.rows)),
                          again, value, failed, ~failed & ~outside])
        kinds = [pa.int64()] * 5 + [pa.float64(), pa.bool_(), pa.bool_()]
        names_ = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_perplexity", "base_failed", "kept"]
        joined = [np.concatenate(c) for c in zip(*parts)] if parts else [[] for _ in kinds]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(joined, kinds)], names_)

    return run(text, language(lang, model.languages[:-1]))
