"""Resampling, search and suffix dedup against brute force and in odd cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hot, resample, search, suffixes

DOCS = "doc_id long, text string, row string, line string, score int, lead long"
SYLLABLES = ["the", "on", "er", "ti", "ou", "sh", "é", "an", "ble", "ña", "日本", "0"]


def prose(rng, n, marks=" "):
    return "".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 2))) + rng.choice(marks) for _ in range(n))


def sample(spark, rows):
    """Documents with columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "r", "l", 5, 7) for i, t in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randint(1, 90), [" ", " ", ", ", "\n", "\n\n", "-"])) for i in range(50)]
    shared = prose(rng, 12)
    rows += [(50 + i, f"{prose(rng, 5)}\n{shared}\n{prose(rng, rng.randint(0, 30))}") for i in range(40)]
    rows += [(90, None), (91, ""), (92, " \n\t"), (93, rows[3][1]), (93, rows[3][1]), (93, rows[3][1]), (94, prose(rng, 6000, [" ", "\n"])), (95, "x" * 700),
             (96, rows[4][1].upper()), (97, "ab" * 300 + "\n" * 50), (None, rows[5][1]), (None, None), (None, rows[5][1]), (98, "a\0b " * 40), (99, "\n".join(["the on"] * 60))]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return sample(spark, corpus)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


ITEMS = [(0, "The on, TI ou sh"), (1, "the the the onon\néti"), (2, None), (3, ""), (4, "日本 0 zzz"), (4, "er"), (None, "an ble"), (6, "qqqq")]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- resampling -------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_resample(rows, target, n, buckets, least, share):
    def features(text):
        w = WORD.findall(lower(text))
        return len(w), [zlib.crc32(" ".join(w[i:i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    found = [(i, *features(t)) for i, t in rows]
    s = Counter(b for *_, f in found for b in f)
    t = Counter(b for x in target for b in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets)))) for b in range(buckets)}
    scored = []
    for i, words, f in found:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        scored.append((i, words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((x for x in scored if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0], x[1], x[2]))
    size = len(order) * share // 100
    return Counter((*x, r + 1) for r, x in enumerate(order[:size])) + Counter((*x, None) for x in [*order[size:], *(x for x in scored if x[1] < least)])


@pytest.mark.parametrize("n, buckets, share", [(1, 10000, 10), (3, 50, 60), (2, 1000, 100)])
def test_resample(docs, items, corpus, n, buckets, share):
    got = resample.resample(docs, "doc_id", "text", items, "text", n, buckets, least_words=5, share=share)
    got = Counter((r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in got.collect())
    assert got == brute_resample(corpus, [t for _, t in ITEMS], n, buckets, 5, share)


def test_resample_of_nothing(docs, items, none):
    assert resample.resample(none, "doc_id", "text", items, "text").count() == 0
    got = resample.resample(docs, "doc_id", "text", items.limit(0), "text", least_words=10 ** 6)
    assert got.filter("rank IS NOT NULL").count() == 0 and got.count() == docs.count()


def test_segments_are_counted_once(docs):
    rows = resample.segment_features(docs, "text", 2, 100).collect()
    assert max(r["occurrences"] for r in rows) >= 60
    assert len({(r["line"]["a"], r["line"]["b"]) for r in rows}) == len(rows)


def test_hot_keys_join_once(spark):
    left = spark.createDataFrame([(1, i) for i in range(3000)] + [(i, 0) for i in range(2, 2000)], "k int, v int")
    right = left.groupBy("k").agg(F.count("*").alias("n"))
    got = hot.join_counted(left, right, ["k"], "n", left.count())
    assert sorted((r["k"], r["v"], r["n"]) for r in got.collect()) == sorted((k, v, 3000 if k == 1 else 1) for k, v in [(r["k"], r["v"]) for r in left.collect()])


# --- search -----------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_search(rows, asked, k):
    docs = [(i, Counter(lower(w) for w in TERM.findall(t or ""))) for i, t in rows]
    n_docs, total = sum(bool(c) for _, c in docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(w for _, c in docs for w in c)
    found = []
    for item, text in asked:
        best = []
        for i, c in docs:
            m = 25 + 75 * sum(c.values()) * n_docs // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10 ** 9 * c[w] // (1000 * c[w] + 8 * m))
                        for w in map(lower, TERM.findall(text or "")) if c[w])
            if score > 0:
                best.append((-score, i is None, i if i is not None else 0))
        found += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(best)[:k])]
    return Counter(found)


@pytest.mark.parametrize("k, rows, short, block", [(10, 1 << 14, 16, 4096), (3, 20, 3, 7), (2, 1000, 10 ** 9, 16), (4, 50, 0, 3)])
def test_search(docs, items, corpus, monkeypatch, k, rows, short, block):
    import tidemark.llm.search as module

    monkeypatch.setattr(module, "SEGMENT_ROWS", rows)
    found = module.item_terms(__import__("pyarrow").array([t or "" for _, t in ITEMS]))
    assert [len(f) for f in found] == [len(TERM.findall(t or "")) for _, t in ITEMS]
    plain = module.hybrid
    monkeypatch.setattr(module, "hybrid", lambda s, t, w, k: plain(s, t, w, k, short, block))
    got = module.search(docs, "doc_id", "text", items, "item_id", "text", k)
    assert Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got.collect()) == brute_search(corpus, ITEMS, k)


def test_search_in_blocks_of_items(docs, items, corpus, monkeypatch):
    monkeypatch.setattr(search, "ITEM_BYTES", 60)
    got = search.search(docs, "doc_id", "text", items, "item_id", "text", 5)
    assert Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got.collect()) == brute_search(corpus, ITEMS, 5)


def test_search_of_nothing(docs, items, none):
    assert search.search(none, "doc_id", "text", items, "item_id", "text").count() == 0
    assert search.search(docs, "doc_id", "text", items.limit(0), "item_id", "text").count() == 0


def test_hybrid_skips_and_is_exact():
    rng = np.random.default_rng(1)
    lengths = rng.integers(5, 400, 5000)
    lists = [np.sort(rng.choice(5000, size, replace=False)) for size in (3, 20, 150, 900, 2500, 4900)]
    row = {"keys": __import__("pyarrow").array(rng.permutation(5000)), "lengths": lengths, "terms": np.arange(6), "sizes": np.array([len(x) for x in lists]),
           "docs": np.concatenate(lists), "tfs": np.concatenate([rng.integers(1, 9, len(x)) for x in lists])}
    segment = search.Segment(row, 5000, int(lengths.sum()))
    for short in (0, 16, 10 ** 9):
        for weights in ([9000, 5000, 3000, 900, 90, 9], [1, 10, 100, 1000, 100, 10], [0, 0, 5, 5, 5, 5], [7] * 6):
            full = np.zeros(5000, np.int64)
            for a, b, w in zip(segment.starts, segment.ends, weights):
                full[segment.docs[a:b]] += segment.impact[a:b] * w
            order = np.lexsort((segment.place, -full))[:10]
            docs, scores = search.hybrid(segment, np.arange(6), np.array(weights), 10, short, 256)
            assert docs.tolist() == order.tolist() and scores.tolist() == full[order].tolist()


# --- suffix array -----------------------------------------------------------------


def brute_dedup(rows, length):
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(r[i:i + length] for r in raws for i in range(len(r) - length + 1))
    found = []
    for (key, _), r in zip(rows, raws):
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(r, gone) if not g)
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        found.append((key, len(r), hashlib.sha256(kept).hexdigest(), tuple(spans)))
    return Counter(found)


@pytest.mark.parametrize("length, bucket", [(40, 1 << 20), (12, 2000), (13, 1500), (300, 500)])
def test_suffix_dedup(docs, corpus, length, bucket, monkeypatch):
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", bucket)
    got = suffixes.dedup(docs, "doc_id", "text", length, with_kept=True).collect()
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got)
    assert Counter((r["doc_id"], r["n_bytes"], r["kept_sha256"], tuple((s["start"], s["stop"]) for s in r["spans"])) for r in got) == brute_dedup(corpus, length)


def test_suffix_dedup_of_shifted_passages(spark, monkeypatch):
    """One passage in many contexts, which straddles buckets, and matches that differ on either side."""
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", 4000)
    rng = random.Random(8)
    passage = prose(rng, 60)
    rows = [(i, prose(rng, rng.randint(0, 20)) + passage[rng.randint(0, 40):len(passage) - rng.randint(0, 40)] + prose(rng, rng.randint(0, 20))) for i in range(150)]
    got = suffixes.dedup(sample(spark, rows), "doc_id", "text", 64).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["kept_sha256"], tuple((s["start"], s["stop"]) for s in r["spans"])) for r in got) == brute_dedup(rows, 64)


def test_comparing_across_buckets_takes_few_rows_a_span(spark, monkeypatch):
    """Many near copies of one passage: rows follow from the edits, not from the number of windows."""
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", 20000)
    taken, keep = [], suffixes.written

    def counted(frame, name):
        made = keep(frame, name)
        if name in ("suffix-windows", "suffix-ranges"):
            taken.append(made.count())
        return made

    monkeypatch.setattr(suffixes, "written", counted)
    rng = random.Random(9)
    passage = prose(rng, 300).split()
    rows = []
    for i in range(200):
        copy = list(passage)
        copy[rng.randrange(len(copy))] = f"w{i}"
        rows.append((i, " ".join(copy)))
    got = suffixes.dedup(sample(spark, rows), "doc_id", "text", 400).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["kept_sha256"], tuple((s["start"], s["stop"]) for s in r["spans"])) for r in got) == brute_dedup(rows, 400)
    assert 0 < sum(taken) < 20 * len(rows), taken


def test_copies_of_a_span_are_not_joined_one_by_one(spark, monkeypatch):
    """A passage in all documents, at times edited: plain joins, which send a span to one task, take no row for each of its copies."""
    rng = random.Random(10)
    passage = prose(rng, 80).split()
    rows = []
    for i in range(300):
        copy = list(passage)
        if i % 30 == 0:
            copy[rng.randrange(len(copy))] = f"w{i}"
        rows.append((i, f"{prose(rng, 4)}{' '.join(copy)} {prose(rng, 4)}"))
    docs = sample(spark, rows)
    most, inside, join, join_counted = [], [], type(docs).join, suffixes.join_counted

    def seen(left, right, on=None, how=None):
        if on == ["k1", "k2"] and not inside:
            most.extend(side.groupBy(on).count().agg(F.max("count")).first()[0] or 0 for side in (left, right))
        return join(left, right, on, how)

    def counted(*args):  # broadcasts what is hot
        inside.append(1)
        try:
            return join_counted(*args)
        finally:
            inside.pop()

    monkeypatch.setattr(type(docs), "join", seen)
    monkeypatch.setattr(suffixes, "join_counted", counted)
    got = suffixes.dedup(docs, "doc_id", "text", 64).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["kept_sha256"], tuple((s["start"], s["stop"]) for s in r["spans"])) for r in got) == brute_dedup(rows, 64)
    assert 0 < max(most) <= 64 - suffixes.gram_size(64) + 1, most


def test_offset_ranges_cover_every_distance():
    for length in (1, 2, 5, 12, 13, 64, 400):
        top = length - suffixes.gram_size(length) + 1
        assert [d for low, high in suffixes.offset_ranges(length) for d in range(low, high)] == list(range(top))


def test_suffix_dedup_of_nothing(none):
    assert suffixes.dedup(none, "doc_id", "text").count() == 0


def test_multikey_quicksort():
    rng = np.random.default_rng(2)
    for n, width, top in ((0, 3, 2), (1, 3, 2), (500, 4, 2), (800, 3, 2 ** 63), (300, 5, 1)):
        tokens = rng.integers(0, top, (n, width), dtype=np.uint64) if n else np.zeros((0, width), np.uint64)
        order = suffixes.multikey_quicksort(tokens)
        assert sorted(order.tolist()) == list(range(n))
        assert [tuple(x) for x in tokens[order].tolist()] == sorted(map(tuple, tokens.tolist()))


@pytest.mark.parametrize("length", [5, 16, 400])
def test_equal_windows_pick_equal_suffixes(length):
    rng = random.Random(length)
    part = prose(rng, 200).encode()
    rows = [b"x" * 50 + part, part, b"", part[3:], b"ab" * 500]
    data, offsets = np.frombuffer(b"".join(rows), np.uint8), np.cumsum([0] + [len(r) for r in rows])
    bounds, spans = suffixes.spans_of(data, offsets, length)
    picked = {}
    for i, r in enumerate(rows):
        covered = []
        for j in range(bounds[i], bounds[i + 1]):
            for t in range(spans["windows"][j] * spans["times"][j]):
                at = spans["lo"][j] + t
                covered.append(at)
                offset = spans["off"][j] - t % spans["windows"][j]
                assert 0 <= offset <= length - suffixes.gram_size(length)
                assert picked.setdefault(r[at:at + length], offset) == offset
        assert covered == list(range(max(0, len(r) - length + 1)))
