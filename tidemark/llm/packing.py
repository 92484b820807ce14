"""Packing of token sequences by Karmarkar-Karp multiway differencing.

A document's tokens (with a closing id) are cut into full windows, which stand
alone, and a rest. The rests are dealt by hash into batches of about ``windows``
windows. A batch is partitioned into k near-equal windows by multiway
differencing: partial partitions wait in a heap by the difference of their
largest and smallest sum; the two largest are merged, largest sums of one with
smallest of the other. Rests stay whole, but for the longest in a batch, one for
every four windows: they are halved down to pieces of ``least`` tokens, unlike
sizes with which the differences cancel. If a window exceeds the capacity, k
rises by one; if that does not do, twice as many rests are halved, and once all
are, k rises on. The ids of pieces travel with them, full windows excepted,
which stay where they are; each window is written as one sequence of ids with
its list of pieces.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.tokens import encoder
from tidemark.session import scratch_path

PIECES = "struct<tokens:bigint,pieces:array<struct<start:bigint,length:bigint,ids:binary>>>"
_PIECE = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])
_PIECES = pa.struct([("tokens", pa.int64()), ("pieces", pa.list_(_PIECE))])
BATCH_BYTES = 16 << 20  # of ids in a task that packs
#: A sequence: its token ids (little-endian, 4 bytes each) and where each piece stands in it.
SEQUENCES = """sequence_id bigint, ids binary,
    pieces array<struct<key:string,start:bigint,length:bigint,doc_tokens:bigint,offset:bigint>>"""
_PLACES = pa.list_(pa.struct([("key", pa.string())] + [(name, pa.int64()) for name in ("start", "length", "doc_tokens", "offset")]))


def halves(tokens: int, least: int) -> list[int]:
    """Lengths of the pieces of a rest: halves of what is left, down to ``least`` tokens."""
    found = []
    while tokens:
        size = tokens if tokens <= least else (tokens + 1) // 2
        found.append(size)
        tokens -= size
    return found


def cut_pieces(text: Column, path: str, end_id: int, capacity: int) -> Column:
    """Token count of each text with its closing id, its full windows with their ids and its rest with ids as narrow as the encoder's."""
    @F.arrow_udf(PIECES)
    def run(column: pa.Array) -> pa.Array:
        coder = encoder(path)
        kind = f"<u{coder.width}"
        closing = np.array([end_id], kind).tobytes()
        tokens, bounds, start, length, pieces = [], [0], [], [], []
        for raw in coder.narrow_ids(column.to_pylist()):
            raw += closing
            n = len(raw) // coder.width
            tokens.append(n)
            full = n - n % capacity
            if full:
                wide = np.frombuffer(raw, kind, full).astype("<u4").tobytes()
                start += range(0, full, capacity)
                length += [capacity] * (full // capacity)
                pieces += [wide[4 * at:4 * (at + capacity)] for at in range(0, full, capacity)]
            if full < n:
                start.append(full)
                length.append(n - full)
                pieces.append(raw[coder.width * full:])
            bounds.append(len(start))
        ids = pa.array(pieces, pa.binary())
        rows = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(length, pa.int64()), ids], fields=list(_PIECE))
        return pa.StructArray.from_arrays([pa.array(tokens, pa.int64()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), rows)], fields=list(_PIECES))

    return run(text)


def differencing(lengths: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Window of each item and the windows' sums, by multiway differencing into ``k`` windows.

    A partial partition is a vector of k sums in falling order; merging two adds
    one's to the other's in reverse. Ties go by the order of making. Which item
    lies where is read back from the merges at the end.
    """
    n = len(lengths)
    heap = []
    for i, size in enumerate(lengths.tolist()):
        sums = np.zeros(k, np.int64)
        sums[0] = size
        heap.append((-size, i, sums))
    heapq.heapify(heap)
    merges = []
    while len(heap) > 1:
        _, a, left = heapq.heappop(heap)
        _, b, right = heapq.heappop(heap)
        sums = left + right[::-1]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), n + len(merges), sums))
        merges.append((a, b, order))
    # place[x][p]: the window of the p-th sum of partial partition x.
    place = {n + len(merges) - 1: np.arange(k)} if merges else {0: np.arange(k)}
    for made in range(len(merges) - 1, -1, -1):
        a, b, order = merges[made]
        joined = np.empty(k, np.int64)
        joined[order] = place.pop(n + made)
        place[a], place[b] = joined, joined[::-1]
    window = np.array([place[i][0] for i in range(n)], np.int64)
    return window, np.bincount(window, lengths, k).astype(np.int64)


def pack_batch(rests: np.ndarray, capacity: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rest of each piece, the piece's length, and its window.

    ``rests`` are lengths in falling order, none above the capacity, which no
    window exceeds. Pieces of a rest follow one another.
    """
    fewest = max(1, -(-int(rests.sum()) // capacity))
    cut = max(1, fewest // 4)
    while True:
        parts = [halves(n, least) if i < cut else [n] for i, n in enumerate(rests.tolist())]
        rest = np.repeat(np.arange(len(rests)), [len(p) for p in parts])
        lengths = np.array([n for p in parts for n in p], np.int64)
        order = np.argsort(-lengths, kind="stable")
        for k in range(fewest, fewest + 2):
            window, sums = differencing(lengths[order], k)
            if sums.max() <= capacity:
                placed = np.empty(len(order), np.int64)
                placed[order] = window
                return rest, lengths, placed
        # The window count rises on only where cutting more cannot help.
        fewest += cut >= len(rests)
        cut *= 2


def pack_pieces(batch: int, rests: pa.Table, capacity: int, least: int) -> pa.Table:
    """The sequences of a batch of rests."""
    rests = rests.sort_by([("length", "descending"), ("key", "ascending"), ("start", "ascending"), ("ids", "ascending")]).combine_chunks()
    rest, lengths, window = pack_batch(rests["length"].to_numpy().astype(np.int64), capacity, least)
    inside = np.cumsum(lengths) - lengths
    inside -= inside[np.searchsorted(rest, rest)]  # from its rest's first token
    order = np.argsort(window, kind="stable")
    rest, lengths, inside, window = rest[order], lengths[order], inside[order], window[order]
    first = np.flatnonzero(np.diff(window, prepend=-1))
    ends = np.cumsum(lengths)
    begins = ends - lengths
    bodies = rests["ids"].to_pylist()
    width = len(bodies[0]) // rests["length"][0].as_py()  # bytes an id
    ids = b"".join([bodies[r][width * a:width * (a + n)] for r, a, n in zip(rest.tolist(), inside.tolist(), lengths.tolist())])
    ids = np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes()
    bounds = 4 * np.append(begins[first], ends[-1])
    offset = begins - begins[first][np.searchsorted(first, np.arange(len(window)), "right") - 1]
    of = rests.take(pa.array(rest)).combine_chunks()
    start = of["start"].to_numpy() + inside
    columns = [of["key"].chunk(0), pa.array(start), pa.array(lengths), of["doc_tokens"].chunk(0), pa.array(offset)]
    places = pa.StructArray.from_arrays([c.cast(f.type) for c, f in zip(columns, _PLACES.value_type, strict=True)], fields=list(_PLACES.value_type))
    return pa.table({
        "sequence_id": pa.array((int(batch) << 24) + window[first], pa.int64()),
        "ids": pa.array([ids[x:y] for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary()),
        "pieces": pa.ListArray.from_arrays(pa.array(np.append(first, len(window)), pa.int32()), places)})


def write_sequences(docs: DataFrame, key: str, text: str, path: str, out: str, capacity: int = 2048, end_id: int = 1,
                    least: int = 16, windows: int = 128) -> None:
    """Write all documents as sequences of token ids (``SEQUENCES``) to the folder ``out``; keys become strings.

    Null and empty texts hold the closing id alone. Rows are packed one by one,
    so repeated keys and texts each have their pieces. Sequence ids are unique,
    not gapless. A batch holds ``windows`` windows in the mean.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("string").alias("key"), cut_pieces(F.col(text).cast("string"), path, end_id, capacity).alias("d"))
    rows = rows.select("key", F.col("d.tokens").alias("doc_tokens"), F.explode("d.pieces").alias("p")).select("key", "doc_tokens", "p.*")
    once = scratch_path(spark, "pack-pieces")
    rows.write.parquet(once)
    pieces = spark.read.schema(rows.schema).parquet(once)
    rest = pieces.filter(F.col("length") < capacity)
    total = rest.agg(F.sum("length")).first()[0] or 0
    batches = max(1, round(total / (windows * capacity)))
    # The row number deals out copies too.
    salted = rest.withColumn("batch", F.pmod(F.xxhash64("key", "start", F.monotonically_increasing_id()), F.lit(batches)))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * total // BATCH_BYTES))
    placed = salted.repartition(tasks, "batch").groupBy("batch").applyInArrow(lambda k, table: pack_pieces(k[0].as_py(), table, capacity, least), SEQUENCES)
    # Full windows have negative sequence ids.
    alone = pieces.filter(F.col("length") == capacity).select(
        (-1 - F.monotonically_increasing_id()).alias("sequence_id"), "ids",
        F.array(F.struct("key", "start", "length", "doc_tokens", F.lit(0).cast("long").alias("offset"))).alias("pieces"))
    placed.unionByName(alone).write.option("compression", "zstd").parquet(out)


def read_sequences(spark: SparkSession, out: str) -> DataFrame:
    """The sequences of a folder."""
    return spark.read.schema(SEQUENCES).parquet(out)


def pack(docs: DataFrame, key: str, text: str, path: str, capacity: int = 2048, end_id: int = 1, least: int = 16,
         windows: int = 128, with_ids: bool = False) -> DataFrame:
    """One row a piece: key, ``start, length, ids_crc32, doc_tokens, sequence_id, offset``, and its ``ids`` on request.

    The sequences are written under the shared folder by ``write_sequences``;
    all columns are taken from what is read back.
    """
    spark, out = docs.sparkSession, scratch_path(docs.sparkSession, "sequences")
    write_sequences(docs, key, text, path, out, capacity, end_id, least, windows)
    rows = read_sequences(spark, out).select("sequence_id", "ids", F.explode("pieces").alias("p"))
    ids = F.substring("ids", (4 * F.col("p.offset") + 1).cast("int"), (4 * F.col("p.length")).cast("int"))
    return rows.select(
        F.col("p.key").cast(docs.schema[key].dataType).alias(key), "p.start", "p.length", F.crc32(ids).alias("ids_crc32"),
        "p.doc_tokens", "sequence_id", "p.offset", *[ids.alias("ids")] * with_ids)
