"""Removal of repeated byte strings by a distributed, sparse suffix array.

A byte goes if it lies in a string of ``length`` bytes that also starts
elsewhere. Sorting every suffix would move hundreds of bytes for each byte of
text, so suffixes are sampled by content: each window of ``length`` bytes is
assigned to the suffix that starts, inside it, at its least ``GRAM``-byte gram
by hash (the first of equal ones). Equal windows pick the same suffix at the same
offset, so windows need only be compared with those of suffixes that begin with
the same gram, the suffix's leading token. Consecutive windows with the same
suffix form one span of text.

* Suffixes whose leading token occurs once are dropped by an aggregate over
  64-bit hashes. Spans that are equal as a whole are folded to one, and all their
  windows are repeats.
* The other spans are range-partitioned by leading token, with splitters that
  Spark samples. Each bucket sorts its suffixes, and their left contexts read
  backwards, by multikey quicksort over 8-byte tokens. Neighbours' common
  lengths then tell, for each offset, which windows are equal, byte by byte.
* A leading token can straddle buckets (that is how a hot one is split). The
  spans of the first and last token of each bucket are therefore compared across
  buckets. For ranges of offsets, short ones where a context ends and longer ones
  between, the bytes that all windows of a range share are hashed and counted
  over all buckets. Ranges that occur twice are hashed with all bytes of their
  windows (128 bits); those that differ there are cut and compared again.

Only narrow rows are joined to the spans; texts move twice, compressed, to where
their spans are cut out and where their repeats are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm import words
from tidemark.llm.hot import join_counted, with_place
from tidemark.session import written

GRAM = 32
BUCKET_BYTES = 8 << 20  # of spans in a bucket
PARTS = 4  # of a range of distances that is compared again
_U = np.uint64
_LOW = _U((1 << 31) - 1)
SPANS = "array<struct<lo:int,windows:int,off:int,lead:bigint,k1:bigint,k2:bigint,times:int>>"
_SPAN = pa.struct([("lo", pa.int32()), ("windows", pa.int32()), ("off", pa.int32()), ("lead", pa.int64()), ("k1", pa.int64()),
                   ("k2", pa.int64()), ("times", pa.int32())])


def gram_size(length: int) -> int:
    return max(1, min(GRAM, length // 4))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values, by doubling."""
    step = 1
    least = values
    while 2 * step <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    rest = width - step
    return np.minimum(least[:len(least) - rest], least[rest:]) if rest else least


def spans_of(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Spans of the rows whose bytes are ``data``, by row: where each row's spans begin, and their fields.

    A span's windows start at ``lo .. lo + windows - 1`` of its row, its suffix
    at ``lo + off``; ``lead`` is the hash of the leading token, ``k1, k2`` that of
    the span's bytes. ``times`` equal spans in a row, as in periodic text, are one.
    """
    gram = gram_size(length)
    n = len(data)
    names = ("lo", "windows", "off", "lead", "k1", "k2", "times")
    if n < length:
        return np.zeros(len(offsets), np.int64), {f: np.zeros(0, np.int64) for f in names}
    power, inverse = words._power(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(words._TABLE[data] * power[:n], out=total[1:])
    hashes = words.mix((total[gram:] - total[:-gram]) * inverse[:n - gram + 1])
    # Position in the low bits: of equal hashes the first is least. 31 bits always, so that the choice does not depend on what else is in the batch.
    at = np.arange(len(hashes), dtype=np.uint64)
    anchor = (sliding_least((hashes & ~_LOW) | at, length - gram + 1) & _LOW).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:len(anchor)]
    valid = np.arange(len(anchor)) + length <= offsets[row + 1]
    change = np.ones(len(anchor), bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | ~valid[:-1]
    lo = np.flatnonzero(change & valid)
    ends = np.zeros(len(anchor) + 1, bool)
    ends[1:-1] = change[1:] | ~valid[1:]
    ends[-1] = True
    stop = np.flatnonzero(ends)
    stop = stop[np.searchsorted(stop, lo, "right")] if len(lo) else lo
    view = memoryview(data)
    keys = np.frombuffer(b"".join([xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(lo.tolist(), (stop + length - 1).tolist())]), "<i8").reshape(-1, 2)
    windows, off, lead = stop - lo, anchor[lo] - lo, hashes[anchor[lo]].view(np.int64)
    # Equal spans one right after the other.
    new = np.ones(len(lo), bool)
    if len(lo):
        new[1:] = (lo[1:] != stop[:-1]) | (row[lo[1:]] != row[lo[:-1]]) | (keys[1:] != keys[:-1]).any(axis=1) | (off[1:] != off[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(lo)))
    lo, of = lo[first], row[lo[first]]
    found = {"lo": lo - offsets[of], "windows": windows[first], "off": off[first], "lead": lead[first], "k1": keys[first, 0], "k2": keys[first, 1], "times": times}
    return np.searchsorted(of, np.arange(len(offsets))), found


def find_spans(text: Column, length: int) -> Column:
    @F.arrow_udf(SPANS)
    def run(column: pa.Array) -> pa.Array:
        data, offsets = words.text_bytes(column)
        bounds, parts, rows, at, seen = [np.zeros(1, np.int64)], [], len(column), 0, 0
        while at < rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + words.SEGMENT, "right")) - 1)
            found, fields = spans_of(data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at], length)
            bounds.append(found[1:] + seen)
            seen += len(fields["lo"])
            parts.append(fields)
            at = to
        columns = [pa.array(np.concatenate([p[f.name] for p in parts] or [np.zeros(0, np.int64)]), f.type) for f in _SPAN]
        return pa.ListArray.from_arrays(pa.array(np.concatenate(bounds), pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_SPAN)))

    return run(text)


def packed(text: Column) -> Column:
    """The text's UTF-8 bytes, compressed."""

    @F.arrow_udf("binary")
    def run(column: pa.Array) -> pa.Array:
        press = zstandard.ZstdCompressor(level=1)
        return pa.array([press.compress((t or "").encode("utf-8")) for t in column.to_pylist()], pa.binary())

    return run(text)


def cut_spans(body: Column, spans: Column, length: int) -> Column:
    """The bytes of each span of a packed text."""

    @F.arrow_udf("array<binary>")
    def run(bodies: pa.Array, lists: pa.Array) -> pa.Array:
        press = zstandard.ZstdDecompressor()
        found = []
        for b, spans in zip(bodies.to_pylist(), lists.to_pylist()):
            raw = press.decompress(b)
            found.append([raw[s["lo"]:s["lo"] + s["windows"] + length - 1] for s in spans])
        return pa.array(found, pa.list_(pa.binary()))

    return run(body, spans)


def multikey_quicksort(tokens: np.ndarray) -> np.ndarray:
    """Order of the rows of a token matrix, by three-way partitions of all groups at once.

    Each round splits every unsorted group by the token at its depth into less
    than, equal to and greater than its middle row's; the equal part goes on with
    the next token. Groups of one row and groups without tokens left are done.
    """
    n, depth_end = tokens.shape
    order, start = np.arange(n), np.zeros(n, np.int64)  # start: where a row's group begins in the order
    depth = np.zeros(n, np.int64)
    open_ = np.arange(n) if n > 1 and depth_end else np.zeros(0, np.int64)  # places whose group is unsorted
    while len(open_):
        rows, group = order[open_], start[open_]
        head = np.flatnonzero(np.diff(group, prepend=-1))
        sizes = np.diff(np.append(head, len(group)))
        level = depth[open_]
        values = tokens[rows, level]
        pivot = np.repeat(values[head + sizes // 2], sizes)
        side = (values > pivot).astype(np.int8) - (values < pivot)
        moved = np.lexsort((side, group))
        order[open_] = rows[moved]
        side = side[moved]
        depth[open_] = level + (side == 0)  # a group has one depth
        new = np.ones(len(open_), bool)
        new[1:] = (side[1:] != side[:-1]) | (group[1:] != group[:-1])
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(open_)))
        start[open_] = np.repeat(open_[first], sizes)
        go_on = (np.repeat(sizes, sizes) > 1) & (depth[open_] < depth_end)
        open_ = open_[go_on]
    return order


def _common(tokens: np.ndarray, order: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Bytes that each row in order has in common with the one before (0 for the first), within both rows' ``known`` bytes."""
    n = len(order)
    found = np.zeros(n, np.int64)
    for a in range(1, n, 4096):
        x, y = tokens[order[a - 1:min(a + 4095, n - 1)]], tokens[order[a:a + 4096]]
        differ = x != y
        at = np.where(differ.any(axis=1), differ.argmax(axis=1), tokens.shape[1])
        inside = np.minimum(at, tokens.shape[1] - 1)
        bits = x[np.arange(len(x)), inside] ^ y[np.arange(len(y)), inside]
        byte = np.zeros(len(x), np.int64)
        for k in range(1, 8):
            byte += bits < (_U(1) << _U(64 - 8 * k))
        found[a:a + 4096] = np.where(at < tokens.shape[1], 8 * at + byte, 8 * at)
    both = known[order].copy()
    both[1:] = np.minimum(both[1:], known[order[:-1]])
    return np.minimum(found, both)


def _matrix(pieces: list[bytes], width: int) -> np.ndarray:
    """The pieces, filled up with zeros, as rows of big-endian 8-byte tokens."""
    width = -(-max(width, 1) // 8) * 8
    return np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), ">u8").reshape(len(pieces), -1).astype(np.uint64)


def repeated_windows(bodies: list[bytes], off: np.ndarray, windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For spans and their windows (by distance to the suffix): how often the window's bytes occur among the spans, and the first span that has them.

    Both are matrices of span and distance ``0 .. longest off``; 0 and -1 where a
    span has no such window. Shorter contexts sort before longer ones with the
    same bytes, so rows with the same known bytes are neighbours.
    """
    n = len(bodies)
    far = int(off.max()) if n else 0
    right = [b[o:o + length] for b, o in zip(bodies, off.tolist())]
    left = [b[o - 1::-1] if o else b"" for b, o in zip(bodies, off.tolist())]
    classes = []
    for pieces, width in ((right, length), (left, far)):
        known = np.array([len(p) for p in pieces], np.int64)
        tokens = np.concatenate([_matrix(pieces, width), known[:, None].astype(np.uint64)], axis=1)  # of equal padded bytes the shorter first
        order = multikey_quicksort(tokens)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        classes.append((place, _common(tokens[:, :-1], order, known)))
    (right_place, right_common), (left_place, left_common) = classes
    count, first = np.zeros((n, far + 1), np.int32), np.full((n, far + 1), -1, np.int32)
    for distance in range(far + 1):
        some = np.flatnonzero((off >= distance) & (off - distance < windows))
        if not len(some):
            continue
        a = np.cumsum(right_common < length - distance)[right_place[some]]
        b = np.cumsum(left_common < distance)[left_place[some]]
        _, head, back, times = np.unique(a * np.int64(n + 1) + b, return_index=True, return_inverse=True, return_counts=True)
        count[some, distance], first[some, distance] = times[back], some[head][back]
    return count, first


def offset_ranges(length: int) -> list[tuple[int, int]]:
    """Ranges of a window's distance to its suffix, ``low <= distance < high``: of 1, 1, 2, 4 ... from both ends."""
    top, low, step = length - gram_size(length) + 1, [0], 1
    while 2 * (low[-1] + step) <= top:
        low.append(low[-1] + step)
        step = low[-1]
    bounds = sorted({*low, *(top - x for x in low)})
    return list(zip(bounds, bounds[1:]))


#: Of a bucket: runs of repeated windows ``first .. last`` of a span, or (``h1, h2`` given) a range of distances and the hash of what its windows share.
FOUND = "k1 bigint, k2 bigint, first int, last int, h1 bigint, h2 bigint"
_FOUND = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())])


def sort_bucket(bucket: pa.Table, length: int) -> Iterator[pa.RecordBatch]:
    """Repeated windows of a bucket's spans, and what the windows of its first and last leading token share by range."""
    bodies = bucket["body"].to_pylist()
    off, windows, lead, k1, k2 = (bucket[c].to_numpy().astype(np.int64) for c in ("off", "windows", "lead", "k1", "k2"))
    count, first = repeated_windows(bodies, off, windows, length)
    repeats = np.zeros((len(bodies), count.shape[1] + 2), bool)
    repeats[:, 1:-1] = count > 1
    edge = np.diff(repeats.astype(np.int8), axis=1)
    row, begin = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)  # by row and then distance, as the beginnings are
    # A distance d from the suffix is window off - d.
    n = len(row)
    empty = lambda kind, n: pa.nulls(n, kind)
    yield pa.RecordBatch.from_arrays([
        pa.array(k1[row]), pa.array(k2[row]), pa.array(off[row] - (end - 1), pa.int32()), pa.array(off[row] - begin, pa.int32()),
        empty(pa.int64(), n), empty(pa.int64(), n)], schema=_FOUND)
    ends = np.flatnonzero((lead == lead.min()) | (lead == lead.max()))
    own = first[ends] == ends[:, None]  # one span stands for equal windows
    for low, high in offset_ranges(length):
        some = ends[own[:, low:high].any(axis=1)]
        if not len(some):
            continue
        digest = b"".join([xxhash.xxh3_128_digest(bodies[i][o - low:o - high + 1 + length]) for i, o in zip(some.tolist(), off[some].tolist())])
        h = np.frombuffer(digest, "<i8").reshape(-1, 2)
        same = lambda x: pa.array(np.full(len(some), x), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(k1[some]), pa.array(k2[some]), same(low), same(high), pa.array(h[:, 0]), pa.array(h[:, 1])], schema=_FOUND)


def _equal_ranges(spans: DataFrame, ranges: DataFrame, length: int) -> DataFrame:
    """``k1, k2, first, last``: windows of the spans that are equal to another span's, within the ranges of distances ``k1, k2, low, high``.

    Windows of a range are all equal if all their bytes are, and all unequal if
    the bytes they share are not. What lies between is cut in ``PARTS`` and
    compared again; of spans with the same bytes one goes on for all, so that rows
    follow from where contexts end and not from the number of windows.
    """
    size, low, high = F.col("high") - F.col("low") - 1, F.col("low"), F.col("high")
    whole = (F.col("off") >= high - 1) & (F.col("off") - low < F.col("windows"))  # the span has all windows of the range
    common = F.substring(F.col("body"), F.col("off") - low + 1, length - size)
    every = F.substring(F.col("body"), F.col("off") - high + 2, length + size)
    digest = lambda body: (F.xxhash64(body), F.xxhash64(F.lit(1), body))
    own = lambda hashed, key: F.when(whole, hashed).otherwise(F.col(key))
    group, kind = ["low", "high", "a", "b"], ["low", "high", "a", "b", "c", "d"]
    found, widest = None, max(y - x for x, y in offset_ranges(length))
    while True:
        (a, b), (c, d) = digest(common), digest(every)
        rows = written(spans.join(ranges, ["k1", "k2"]).select(
            "k1", "k2", "off", "windows", "low", "high", whole.alias("whole"), a.alias("a"), b.alias("b"), own(c, "k1").alias("c"), own(d, "k2").alias("d")), "suffix-ranges")
        kinds = written(rows.groupBy(*kind).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "off", "windows")).alias("one")), "suffix-kinds")
        several = kinds.filter("n > 1")
        total = several.agg(F.sum("n")).first()[0] or 0
        equal = join_counted(rows, several.select(*kind, F.col("n").alias("times")), kind, "times", total).select(
            "k1", "k2", (F.col("off") - F.col("high") + 1).alias("first"), (F.col("off") - F.col("low")).alias("last"))
        found = equal if found is None else found.unionByName(equal)
        if widest == 1:
            return found
        mixed = kinds.filter("high - low > 1").groupBy(*group).agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
        total = mixed.agg(F.sum("times")).first()[0] or 0
        if not total:
            return found
        step = F.ceil((F.col("high") - F.col("low")) / PARTS).cast("int")
        parts = F.transform(F.sequence(F.col("low"), F.col("high") - 1, step), lambda x: F.struct(x.alias("low"), F.least(x + step, F.col("high")).alias("high")))
        cut = join_counted(kinds, mixed, group, "times", total).select("one.*", F.explode(parts).alias("part"))
        ranges = cut.filter((F.col("off") >= F.col("part.low")) & (F.col("off") - F.col("part.high") + 1 < F.col("windows"))).select("k1", "k2", "part.*")
        widest = -(-widest // PARTS)


def _partial_repeats(spans: DataFrame, length: int) -> DataFrame:
    """``k1, k2, first, last``: repeated windows of distinct spans ``lead, k1, k2, off, windows, body``."""
    size = spans.agg(F.sum(F.octet_length("body").cast("long"))).first()[0] or 0
    kind = pa.schema([("lead", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("off", pa.int32()), ("windows", pa.int32()), ("body", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = pa.Table.from_batches([pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(b.columns, kind, strict=True)], schema=kind) for b in batches], kind)
        if bucket.num_rows:
            yield from sort_bucket(bucket.combine_chunks(), length)

    # Equal leading tokens may be cut by the key, so no bucket grows with them.
    buckets = spans.select(*kind.names).repartitionByRange(max(1, -(-size // BUCKET_BYTES)), "lead", "k1", "k2")
    found = written(buckets.mapInArrow(run, StructType.fromDDL(FOUND)), "suffix-buckets")
    inside = found.filter("h1 IS NULL").select("k1", "k2", "first", "last")
    edges = found.filter("h1 IS NOT NULL")
    shared = ["h1", "h2", "first"]
    twice = edges.groupBy(*shared).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*shared)
    ranges = edges.join(twice, shared).select("k1", "k2", F.col("first").alias("low"), F.col("last").alias("high"))
    return inside.unionByName(_equal_ranges(spans, ranges, length)) if not twice.isEmpty() else inside


def repeats(rows: DataFrame, text: str, length: int) -> DataFrame:
    """``__file, __row, start, stop``: byte ranges of the rows (``with_place``) that repeated windows cover; they may overlap."""
    spans = rows.filter(F.octet_length(text) >= length).select("__file", "__row", F.explode(find_spans(F.col(text), length)).alias("s"))
    spans = written(spans.select("__file", "__row", "s.*"), "suffix-spans")
    leads = spans.groupBy("lead").agg(F.sum("times").alias("n"), F.count(F.lit(1)).alias("rows"), F.min("k1").alias("a"), F.max("k1").alias("b"))
    leads = written(leads.filter("n > 1").selectExpr("lead", "rows", "a <> b AS mixed"), "suffix-leads")
    total = leads.agg(F.sum("rows")).first()[0] or 0
    some = written(join_counted(spans, leads, ["lead"], "rows", total).drop("rows"), "suffix-candidates")
    whole = F.col("windows") * F.col("times") + (length - 1)
    # All spans of a token that are not mixed are equal.
    alike = some.filter("NOT mixed").select("__file", "__row", F.col("lo").alias("start"), (F.col("lo") + whole).alias("stop"))
    mixed = some.filter("mixed").drop("mixed")
    # With one of each span, so that no later step moves all copies of a span to one task.
    one = [F.first(c).alias(c) for c in ("__file", "__row", "lo", "windows", "off", "lead")]
    keys = written(mixed.groupBy("k1", "k2").agg(F.sum("times").alias("n"), F.count(F.lit(1)).alias("rows"), *one), "suffix-keys")
    total = keys.agg(F.sum("rows")).first()[0] or 0
    equal = join_counted(mixed, keys.filter("n > 1").select("k1", "k2", "rows"), ["k1", "k2"], "rows", total).select(
        "__file", "__row", F.col("lo").alias("start"), (F.col("lo") + whole).alias("stop"))
    # One of each span is cut out of its text.
    wanted = keys.groupBy("__file", "__row").agg(F.collect_list(F.struct("lo", "windows", "off", "lead", "k1", "k2")).alias("spans"))
    texts = rows.filter(F.octet_length(text) >= length).select("__file", "__row", packed(F.col(text)).alias("body"))
    cut = texts.join(wanted, ["__file", "__row"]).select("spans", cut_spans(F.col("body"), F.col("spans"), length).alias("bodies"))
    cut = written(cut.select(F.explode(F.arrays_zip("spans", "bodies")).alias("x")).select("x.spans.*", F.col("x.bodies").alias("body")), "suffix-bodies")
    partial = _partial_repeats(cut, length)
    # Spans that occur once; those that occur more often are covered as a whole.
    single = keys.filter("n = 1").select("__file", "__row", "lo", "k1", "k2")
    part = partial.join(single, ["k1", "k2"]).select(
        "__file", "__row", (F.col("lo") + F.col("first")).alias("start"), (F.col("lo") + F.col("last") + length).alias("stop"))
    return alike.unionByName(equal).unionByName(part)


REMOVED = "struct<n_bytes:bigint,kept:binary,kept_sha256:string,spans:array<struct<start:bigint,stop:bigint>>>"


def remove(body: Column, ranges: Column, with_kept: bool) -> Column:
    """The packed text without the byte ranges: its size before, what is left (on request) with its digest, and the ranges merged."""

    @F.arrow_udf(REMOVED)
    def run(bodies: pa.Array, lists: pa.Array) -> pa.Array:
        press, found = zstandard.ZstdDecompressor(), []
        for b, ranges in zip(bodies.to_pylist(), lists.to_pylist()):
            raw, merged = press.decompress(b), []
            for r in sorted((r["start"], r["stop"]) for r in ranges or ()):
                if merged and r[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], r[1])
                else:
                    merged.append(list(r))
            kept, at = [], 0
            for start, stop in merged:
                kept.append(raw[at:start])
                at = stop
            kept = b"".join([*kept, raw[at:]])
            found.append({"n_bytes": len(raw), "kept": kept if with_kept else None, "kept_sha256": hashlib.sha256(kept).hexdigest(),
                          "spans": [{"start": a, "stop": b} for a, b in merged]})
        return pa.array(found, pa.struct([("n_bytes", pa.int64()), ("kept", pa.binary()), ("kept_sha256", pa.string()),
                                          ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))]))

    return run(body, ranges)


def dedup(docs: DataFrame, key: str, text: str, length: int = 400, with_kept: bool = False) -> DataFrame:
    """The key, ``n_bytes``, ``kept_sha256``, the removed ``spans`` (byte ranges) and, on request, the ``kept`` bytes of each row.

    Null texts are empty; texts of fewer than ``length`` bytes lose nothing. Rows
    are told apart by their place, so repeated keys and rows each count: every
    copy of a text of ``length`` bytes or more is removed. What is left may be cut
    inside a character, so it is bytes. Other columns are ignored.
    """
    rows = with_place(docs).select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), "__file", "__row")
    found = repeats(rows, "text", length).groupBy("__file", "__row").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    whole = rows.select("key", "__file", "__row", packed(F.col("text")).alias("body"))
    out = whole.join(found, ["__file", "__row"], "left").select("key", remove(F.col("body"), F.col("ranges"), with_kept).alias("r"))
    return out.select(F.col("key").alias(key), "r.n_bytes", "r.kept_sha256", "r.spans", *["r.kept"] * with_kept)
