"""Dictionaries of any length, matched by a trie over tokens.

The dictionary is a table. It is written to the shared folder once, and each
worker builds its trie from there, so that no entry passes through the driver
or stands in a plan. Its bytes are counted first; a larger one than a worker
should hold is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.parquet as pq
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.functions.batches import map_texts, slices
from tidemark.functions.normalize import after_abbreviations, before_hashtags, unicodedata_key
from tidemark.session import file_system, scratch_path

_WORD = r"[\p{Alphabetic}\p{M}\p{Nd}\p{Pc}\p{Join_Control}]"  # as (?U)\w in Java
_TOKEN = regex.compile(rf"(?s){_WORD}+|.")
_IS_WORD = regex.compile(_WORD)
_HASHTAG = regex.compile(rf"#{_WORD}+")
_RUN = regex.compile(rf"((?![\p{{Nd}}_]){_WORD})\1{{2,}}")
_END = ""  # no token is empty


def _saved(rows: DataFrame, name: str, limit: int) -> str:
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, name)
    rows.write.parquet(path)
    stored = spark.read.schema(rows.schema).parquet(path)
    size = stored.agg(F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in rows.columns), F.lit(0)))).first()[0] or 0
    if size > limit:
        raise ValueError(f"the dictionary has {size} bytes, more than the {limit} a worker may hold; raise max_bytes or join instead")
    return path


def _read(path: str) -> dict[str, list]:
    system, root = file_system(path)
    return pq.read_table(root, filesystem=system).to_pydict()


@lru_cache(maxsize=2)
def _trie(path: str) -> dict:
    root: dict = {}
    table = _read(path)
    for source, target in zip(table["source"], table["target"]):
        if not source or target is None:
            continue
        node = root
        for token in _TOKEN.findall(source):
            node = node.setdefault(token, {})
        node[_END] = max(target, node.get(_END, target))
    return root


@lru_cache(maxsize=2)
def _tags(path: str) -> frozenset[str]:
    return frozenset(unicodedata_key(t) for t in _read(path)["tag"] if t)


def replace_phrases(text: str, trie: dict) -> str:
    """Whole keys replaced from left to right, the longest that fits first."""
    tokens = _TOKEN.findall(text)
    words = [_IS_WORD.match(t) is not None for t in tokens]
    out, i, n = [], 0, len(tokens)
    while i < n:
        node, j, found = trie.get(tokens[i]), i + 1, None
        if node is not None and (words[i] or i == 0 or not words[i - 1]):
            while node is not None:
                if _END in node and (words[j - 1] or j == n or not words[j]):
                    found = (j, node[_END])
                node = node.get(tokens[j]) if j < n else None
                j += 1
        if found:
            i = found[0]
            out.append(found[1])
        else:
            out.append(tokens[i])
            i += 1
    return "".join(out)


def resolve_tags(text: str, banned: frozenset[str]) -> str:
    words = lambda m: " " if unicodedata_key(m[0]) in banned else f" {m[0][1:].replace('_', ' ')} "
    return _HASHTAG.sub(words, text) if "#" in text else text


def phrase_replacer(entries: DataFrame, max_bytes: int = 64 << 20) -> Callable[[Column], Column]:
    """A column function that replaces whole keys by the table ``source, target``, case-sensitive.

    A key has no word character directly before or after it; of several keys at
    one place the longest is taken. Null and empty sources and null targets
    are no entries, of equal sources the greatest target counts; null texts stay null.
    """
    path = _saved(entries.select("source", "target"), "phrases", max_bytes)

    @F.arrow_udf(StringType())
    def replace(text: pa.Array) -> pa.Array:
        trie = _trie(path)
        return map_texts(text, lambda t: replace_phrases(t, trie))

    return replace


def hashtag_resolver(noise: DataFrame, tag: str = "tag", max_bytes: int = 64 << 20) -> Callable[[Column], Column]:
    """A column function: hashtags of the table vanish, others become their words; case and accents don't count."""
    path = _saved(noise.select(F.col(tag).alias("tag")), "hashtags", max_bytes)

    @F.arrow_udf(StringType())
    def resolve(text: pa.Array) -> pa.Array:
        banned = _tags(path)
        return map_texts(text, lambda t: resolve_tags(t, banned))

    return resolve


def preprocess_rows(rows: DataFrame, text: str, target: str, entries: DataFrame, noise: DataFrame, max_bytes: int = 64 << 20) -> DataFrame:
    """The whole preprocessing chain with dictionary tables; ``target`` is added, or replaced.

    Hashtags, repeated letters and phrases are one pass in Python between the
    steps before and after, which stay in the JVM.
    """
    phrases, tags = _saved(entries.select("source", "target"), "phrases", max_bytes), _saved(noise.select("tag"), "hashtags", max_bytes)
    ready = rows.withColumn(target, before_hashtags(F.col(text)))
    place = ready.columns.index(target)

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, banned = _trie(phrases), _tags(tags)
        for batch in batches:
            for a, b in slices(batch.column(place)):
                part = batch.slice(a, b - a)
                done = map_texts(part.column(place), lambda t: replace_phrases(_RUN.sub(r"\1", resolve_tags(t, banned)), trie))
                yield part.set_column(place, target, done)

    done = ready.mapInArrow(replace, ready.schema)
    return done.withColumn(target, after_abbreviations(F.col(target)))
