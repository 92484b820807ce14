"""Ranked lexical search by hybrid term-at-a-time and document-at-a-time evaluation.

The documents are indexed in segments of bounded size: for each term of the
items, the segment's documents that hold it (rising) and how often. Segments
are written once; document counts and lengths over all of them give each term's
weight and each posting's impact, in whole numbers.

Each segment answers every item exactly. Its short lists are added up term at a
time into accumulators. These then act as one more list, sorted by document and
bounded by the largest sum, beside the long lists, which are read document at a
time, in blocks of documents. Lists are ordered by bound. Those whose bounds add
up to less than the lowest score still of use bring no candidates by
themselves; they are only looked up, by binary search, for candidates that the
remaining bounds could still lift, and the rest of them is skipped. The best of
all segments are merged by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from tidemark.llm import words
from tidemark.session import written

#: Terms are runs of digits, letters A-Z and a-z and bytes beyond ASCII.
SEPARATOR = np.array([not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b > 127) for b in range(256)])
SEGMENT_ROWS = 1 << 14
SEGMENT_POSTINGS = 1 << 21
ITEM_BYTES = 4 << 20  # text of the items that are answered together
SHORT = 16  # a list is short if it holds less than one in so many of the segment's documents
BLOCK = 4096  # documents looked at together


def item_terms(texts: pa.Array) -> list[np.ndarray]:
    """The term ids of each text, repeats included."""
    found = []
    for w in words.segments(texts, True, separator=SEPARATOR):
        found += np.split(w.ids, w.bounds[1:-1])
    return found


class Builder:
    """Collects documents and gives them as segments."""

    def __init__(self, vocabulary: np.ndarray, schema: pa.Schema):
        self.vocabulary, self.schema = vocabulary, schema
        self._clear()

    def _clear(self) -> None:
        self.rows, self.postings, self.keys, self.lengths, self.parts = 0, 0, [], [], []

    def add(self, keys: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        size = len(self.vocabulary)
        for w in words.segments(texts, True, separator=SEPARATOR):
            self.keys.append(keys.slice(w.first, w.rows))
            self.lengths.append(np.diff(w.bounds))
            at = np.minimum(np.searchsorted(self.vocabulary, w.ids), size - 1)
            known = np.flatnonzero(self.vocabulary[at] == w.ids) if size else np.zeros(0, np.int64)
            pair, tf = np.unique(at[known] * np.int64(w.rows) + w.row[known], return_counts=True)
            self.parts.append((pair // w.rows, pair % w.rows + self.rows, tf))
            self.rows += w.rows
            self.postings += len(pair)
            if self.rows >= SEGMENT_ROWS or self.postings >= SEGMENT_POSTINGS:
                yield self.take()

    def take(self) -> pa.RecordBatch:
        """The segment of what has been added since the last one."""
        term, doc, tf = (np.concatenate([p[i] for p in self.parts]) for i in range(3))
        order = np.argsort(term, kind="stable")  # documents rise already
        term, doc, tf = term[order], doc[order], tf[order]
        first = np.flatnonzero(np.diff(term, prepend=-1))
        lengths = np.concatenate(self.lengths)
        keys = pa.concat_arrays(self.keys)
        one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        columns = [pa.array([int((lengths > 0).sum())], pa.int64()), pa.array([int(lengths.sum())], pa.int64()), one(keys),
                   *[one(pa.array(a, t)) for a, t in ((lengths, pa.int32()), (term[first], pa.int32()), (np.diff(np.append(first, len(term))), pa.int32()),
                                                      (doc, pa.int32()), (tf, pa.int32()))]]
        self._clear()
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)


def build_index(docs: DataFrame, key: str, text: str, vocabulary: np.ndarray) -> DataFrame:
    """One row a segment; every document is in one, with its length, also those without any of the terms."""
    kind = docs.schema[key].dataType
    out = StructType([StructField("n_docs", LongType()), StructField("n_terms", LongType()), StructField("keys", ArrayType(kind)),
                      StructField("lengths", ArrayType(IntegerType())), StructField("terms", ArrayType(IntegerType())),
                      StructField("sizes", ArrayType(IntegerType())), StructField("docs", ArrayType(IntegerType())), StructField("tfs", ArrayType(IntegerType()))])
    schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Builder(vocabulary, schema)
        for b in batches:
            yield from made.add(b.column(0), b.column(1))
        if made.rows:
            yield made.take()

    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, out)


class Segment:
    """A segment with its impacts."""

    def __init__(self, row: dict, n_docs: int, n_terms: int):
        self.keys = row["keys"]
        # Ties go to the smaller key, nulls last.
        self.place = np.empty(len(self.keys), np.int64)
        self.place[pc.sort_indices(self.keys, null_placement="at_end").to_numpy()] = np.arange(len(self.keys))
        m = 25 + (75 * row["lengths"].astype(np.int64) * n_docs) // max(n_terms, 1)
        self.docs, tfs = row["docs"], row["tfs"].astype(np.int64)
        self.impact = (1_000_000_000 * tfs) // (1000 * tfs + 8 * m[self.docs])
        self.ends = np.cumsum(row["sizes"], dtype=np.int64)
        self.starts = self.ends - row["sizes"]
        self.best = np.maximum.reduceat(self.impact, self.starts) if len(self.starts) else np.zeros(0, np.int64)
        self.at = {t: i for i, t in enumerate(row["terms"].tolist())}

    def lists(self, terms: np.ndarray, weights: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int, int]]:
        """Documents, impacts, weight and bound of each term that is here."""
        found = []
        for t, w in zip(terms.tolist(), weights.tolist()):
            i = self.at.get(t)
            if i is not None and w > 0 and self.best[i] > 0:
                part = slice(self.starts[i], self.ends[i])
                found.append((self.docs[part], self.impact[part], w, w * int(self.best[i])))
        return found


class Best:
    """The best ``k`` so far, by score and then by place."""

    def __init__(self, k: int, place: np.ndarray):
        self.k, self.place = k, place
        self.docs, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.lowest = 0  # a score below it is of no use

    def add(self, docs: np.ndarray, scores: np.ndarray) -> None:
        some = scores >= max(self.lowest, 1)
        docs, scores = np.concatenate([self.docs, docs[some]]), np.concatenate([self.scores, scores[some]])
        order = np.lexsort((self.place[docs], -scores))[:self.k]
        self.docs, self.scores = docs[order], scores[order]
        self.lowest = max(self.lowest, int(self.scores[-1])) if len(order) == self.k else self.lowest


def look_up(docs: np.ndarray, impacts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Impact of each wanted document in a list, 0 where it is not in it."""
    at = np.searchsorted(docs, wanted)
    at[at == len(docs)] = 0
    return np.where(docs[at] == wanted, impacts[at], 0)


def hybrid(segment: Segment, terms: np.ndarray, weights: np.ndarray, k: int, short: int = SHORT, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """The best ``k`` documents of a segment for one item, and their scores."""
    best = Best(k, segment.place)
    rows = len(segment.keys)
    lists = segment.lists(terms, weights)
    brief = [x for x in lists if len(x[0]) * short < rows]
    long = [x for x in lists if len(x[0]) * short >= rows]
    if brief:  # term at a time
        docs, at = np.unique(np.concatenate([d for d, *_ in brief]), return_inverse=True)
        sums = np.zeros(len(docs), np.int64)
        np.add.at(sums, at, np.concatenate([i * w for _, i, w, _ in brief]))
        if not long:
            best.add(docs, sums)
            return best.docs, best.scores
        # The largest accumulators in full give a first lower limit.
        some = np.sort(np.argpartition(sums, -k)[-k:]) if len(sums) > k else np.arange(len(sums))
        full = sums[some] + sum(look_up(d, i, docs[some]) * w for d, i, w, _ in long)
        if len(some) == k:
            best.lowest = int(full.min())
        long.append((docs, sums, 1, int(sums.max())))
    long.sort(key=lambda x: x[3])
    below = np.cumsum([0] + [x[3] for x in long])  # below[j]: bounds of the first j lists
    for low in range(0, rows, block):  # document at a time
        leads = int(np.searchsorted(below[1:], best.lowest, "left"))  # lists before this one bring no candidates
        if leads == len(long):
            break
        pieces = []
        for d, i, w, _ in long[leads:]:
            a, b = np.searchsorted(d, (low, low + block))
            pieces.append((d[a:b], i[a:b] * w))
        docs = np.concatenate([d for d, _ in pieces])
        if not len(docs):
            continue
        sums, here = np.zeros(block, np.int64), np.zeros(block, bool)
        for d, s in pieces:
            sums[d - low] += s  # a document occurs once in a list
            here[d - low] = True
        docs = np.flatnonzero(here)
        sums, docs = sums[docs], docs + low
        for j in range(leads - 1, -1, -1):
            keep = sums + below[j + 1] >= best.lowest
            docs, sums = docs[keep], sums[keep]
            if not len(docs):
                break
            d, i, w, _ = long[j]
            sums = sums + look_up(d, i, docs) * w
        best.add(docs, sums)
    return best.docs, best.scores


def _answer(index: DataFrame, kind, items: list[tuple[int, np.ndarray, np.ndarray]], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """``no, key, score`` of the best ``k`` of each segment for each item ``(no, terms, weights)``."""
    out = StructType([StructField("no", IntegerType()), StructField("key", kind), StructField("score", LongType())])
    schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                row = {n: b.column(i)[r].values for i, n in enumerate(b.schema.names)}
                row = {n: v if n == "keys" else v.to_numpy() for n, v in row.items()}
                segment = Segment(row, n_docs, n_terms)
                nos, docs, scores = [], [], []
                for no, terms, weights in items:
                    d, s = hybrid(segment, terms, weights, k)
                    nos.append(np.full(len(d), no, np.int32))
                    docs.append(d)
                    scores.append(s)
                if nos:
                    keys = segment.keys.take(pa.array(np.concatenate(docs), pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nos)), keys.cast(schema.field("key").type), pa.array(np.concatenate(scores))], schema=schema)

    return index.select("keys", "lengths", "terms", "sizes", "docs", "tfs").mapInArrow(run, out)


def _search_block(docs: DataFrame, key: str, text: str, items: list[tuple], item_key: str, item_type, k: int) -> DataFrame:
    spark = docs.sparkSession
    found = item_terms(pa.array([t for _, t in items], pa.string()))
    vocabulary = np.unique(np.concatenate([*found, np.zeros(0, np.uint64)]))
    index = written(build_index(docs, key, text, vocabulary), "search-index")
    n_docs, n_terms = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    held = index.select(F.explode(F.arrays_zip("terms", "sizes")).alias("x")).groupBy("x.terms").agg(F.sum("x.sizes").alias("df"))
    df = np.zeros(len(vocabulary), np.float64)
    for r in held.collect():  # one row a term of these items
        df[r["terms"]] = r["df"]
    weight = np.floor(1000 * np.log((2.0 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    asked = []
    for no, ids in enumerate(found):
        terms, times = np.unique(np.searchsorted(vocabulary, ids), return_counts=True)
        asked.append((no, terms, times * weight[terms]))
    parts = _answer(index, docs.schema[key].dataType, asked, n_docs, n_terms, k)
    order = Window.partitionBy("no").orderBy(F.col("score").desc(), F.col("key").asc_nulls_last())
    top = parts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    names = spark.createDataFrame([(no, i) for no, (i, _) in enumerate(items)], StructType([StructField("no", IntegerType()), StructField(item_key, item_type)]))
    return top.join(F.broadcast(names), "no").select(item_key, "rank", F.col("key").alias(key), "score")


def search(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, k: int = 10) -> DataFrame:
    """The ``k`` best documents with a score above 0 for each item: item key, ``rank``, document key, ``score``.

    Null and empty texts hold no terms: such documents are never found, such
    items find nothing. Rows that repeat a key are documents or items of their
    own; equal scores go by key, nulls last. An empty table gives no rows. Items
    are answered ``ITEM_BYTES`` of text at a time, all documents for each; other
    columns are ignored.
    """
    asked = items.select(F.col(item_key).alias("key"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text"))
    size = asked.agg(F.sum(F.octet_length("text").cast("long") + 16)).first()[0] or 0
    blocks = max(1, -(-size // ITEM_BYTES))
    if blocks > 1:
        asked = written(asked.withColumn("block", F.pmod(F.xxhash64("key", "text", F.monotonically_increasing_id()), F.lit(blocks))), "search-items")
    found = None
    for b in range(blocks):
        rows = [(r["key"], r["text"]) for r in (asked.filter(F.col("block") == b) if blocks > 1 else asked).collect()]
        part = _search_block(docs, key, text, rows, item_key, items.schema[item_key].dataType, k)
        found = part if found is None else found.unionByName(part)
    return found
