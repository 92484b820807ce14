"""The pipeline operators against brute force and in odd cases: nulls, empty and long texts, repeated rows, extra columns, empty tables."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, gru, lm, ngramjoin, packing, plans, quality, sharding, tokens, toxicity, urls, warc, words
from tidemark.llm.graph import connected_components

WORD = re.compile("[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, node string, key string, label int"
SYLLABLES = ["the", "on", "er", "ti", "ou", "sh", "é", "an", "ble", "ña"]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sample(spark, rows):
    """Documents with columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, g, "x", "y", 1) for i, t, g in rows], DOCS).repartition(3)


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randint(1, 120)), rng.choice(["en", "fr", None])) for i in range(60)]
    for i in range(60, 100):  # near copies of a few documents, one word changed
        base = rows[rng.choice([3, 5, 7])][1].split()
        base[rng.randrange(len(base))] = "other"
        rows.append((i, " ".join(base), "en"))
    rows += [(100, None, "en"), (101, "", None), (102, " \t\n\x0b", "fr"), (103, rows[3][1], "en"), (103, rows[3][1], "en"),
             (104, prose(rng, 5000), "en"), (105, "x" * 5000, "en"), (106, rows[5][1].upper(), "en"), (107, "ab cd", "en"), (108, "AB CD", None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return sample(spark, corpus)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_words_agree_with_python():
    texts = ["Ab  cd\tAB", None, "", " x ", "é\x1cü \x85", "a" * 3000 + " b"]
    got = [[w.data[a:b].tobytes().decode() for a, b in zip(w.starts[c:d], w.ends[c:d])]
           for w in words.segments(pa.array(texts), False, 1) for c, d in zip(w.bounds, w.bounds[1:])]
    assert got == [WORD.findall(t or "") for t in texts]
    ids = [list(w.ids) for w in words.segments(pa.array(["ab", "AB x ab"]), True)]
    assert ids[0][0] == ids[0][1] == ids[0][3] != ids[0][2]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 40), (40, 45), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["label"] for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(31)} | {50: 40, 40: 40, 45: 40}
    assert connected_components(edges.limit(0)).count() == 0


def brute_components(rows, n, num, den):
    sets = []
    for _, t, *_ in rows:
        w = WORD.findall(lower(t))
        sets.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return Counter((r[0], len(sets[i]), least[find(i)]) for i, r in enumerate(rows))


@pytest.mark.parametrize("block", [1000, 4])
def test_ngram_join(docs, corpus, block, monkeypatch):
    monkeypatch.setattr(ngramjoin, "BLOCK_ROWS", block)
    got = ngramjoin.components(docs, "doc_id", "text", 4, 85, 100)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute_components(corpus, 4, 85, 100)


def test_ngram_join_odd_tables(spark, none):
    assert ngramjoin.components(none, "doc_id", "text").count() == 0
    rows = [(None, "a b c d e f", "en"), (4, "a b c d e f", "en"), (None, "z", None)]
    got = {(r["doc_id"], r["component_id"]) for r in ngramjoin.components(sample(spark, rows), "doc_id", "text").collect()}
    assert got == {(None, 4), (4, 4), (None, None)}


def test_signature_tree_finds_every_link():
    rng = np.random.default_rng(5)
    base = [np.unique(rng.integers(0, 400, 120)).astype(np.uint64) for _ in range(4)]
    sets = [np.unique(np.where(rng.random(len(b)) < 0.06, rng.integers(0, 400, len(b)), b).astype(np.uint64)) for b in base for _ in range(30)]
    tree = ngramjoin.Tree(sets, np.arange(len(sets)), 85, 100)
    tree.join()
    rows = [(i, " ".join(f"w{x}" for x in s.tolist())) for i, s in enumerate(sets)]
    want = {k[0]: k[2] for k in brute_components(rows, 1, 85, 100)}
    assert tree.roots().tolist() == [want[i] for i in range(len(sets))]


def library_ids():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(plans.tokenizer_file())
    return lambda t: library.encode(t or "", add_special_tokens=False).ids


ODD_TEXTS = ["Hello,World. a.b 5,5 '.s don't. it's, <|endoftext|>, <|ENDOFTEXT|> x,. y!, É. \x1c\x1d x \u0301a é.", "ＡＢ １２.", "a\u200b. b", "ß. İ ǅ ẞ",
             "x" * 300]


@pytest.mark.parametrize("sizes", [{}, {"huge": 200, "chunk": 64, "overlap": 8}])
def test_token_counts(spark, docs, corpus, sizes):
    extra = [(200 + i, t, "en") for i, t in enumerate(ODD_TEXTS)]
    ids = library_ids()
    got = tokens.count_tokens(docs.unionByName(sample(spark, extra)), "doc_id", "text", plans.tokenizer_file(), **sizes)
    want = Counter((i, len((t or "").encode()), len(ids(t))) for i, t, _ in corpus + extra)
    assert Counter(tuple(r) for r in got.collect()) == want


def test_parts_give_the_library_ids():
    """Random mixtures of letters, marks, digits and contractions, part by part against the whole text."""
    ids, rng = library_ids(), random.Random(9)
    pool = ["a", "Zz", "é", "É", "ß", "ÿ", "ñ", "×", "÷", ".", ",", "'s", "'", "'LL", "$$", "%", "3", "42", "<|", "<|endoftext|>", "…", "\u0301", "=\u0338", "日", "_", "-", "!?", "İ", "\u00a0"]
    texts = ["".join(rng.choice(pool) + rng.choice(["", "", " ", "\n"]) for _ in range(rng.randint(1, 30))) for _ in range(1500)]
    got = tokens.encoder(plans.tokenizer_file()).ids(texts)
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == [list(ids(t)) for t in texts]


def test_other_tokenizers_encode_whole_texts(spark):
    from tokenizers import Tokenizer

    path = plans.tokenizer_file().replace("word_bpe_49k", "byte_bpe_50k")
    texts = ["Hello  world \n\n x", None, ""]
    library = Tokenizer.from_file(path)
    got = tokens.count_tokens(sample(spark, [(i, t, "en") for i, t in enumerate(texts)]), "doc_id", "text", path)
    assert {r["doc_id"]: r["n_tokens"] for r in got.collect()} == {i: len(library.encode(t or "").ids) for i, t in enumerate(texts)}


def test_packing_holds_every_id_once(docs, corpus, none):
    ids = library_ids()
    got = packing.pack(docs, "doc_id", "text", plans.tokenizer_file(), capacity=64, windows=8).collect()
    every = {i: np.array([*ids(t), 1], "<u4") for i, t, _ in corpus}  # rows with one id have one text here
    held = Counter((r["doc_id"], at) for r in got for at in range(r["start"], r["start"] + r["length"]))
    assert held == Counter((i, at) for i, *_ in corpus for at in range(len(every[i])))
    for r in got:
        assert r["doc_tokens"] == len(every[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(every[r["doc_id"]][r["start"]:r["start"] + r["length"]].tobytes())
    fitting = [i for i, *_ in corpus if len(every[i]) <= 64]
    assert sum(len(every[r["doc_id"]]) <= 64 for r in got) < 2.5 * len(fitting)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by) <= 1.1 * sum(r["length"] for r in got) / 64 + 2
    assert packing.pack(none, "doc_id", "text", plans.tokenizer_file()).count() == 0


def test_sequences_hold_the_token_ids(spark, docs, corpus, none):
    ids = library_ids()
    out = f"{warc.archive_folder(spark)}-sequences"
    packing.write_sequences(docs, "doc_id", "text", plans.tokenizer_file(), out, capacity=64, windows=8)
    wrote = [(np.frombuffer(r["ids"], "<u4").tolist(), r["pieces"]) for r in packing.read_sequences(spark, out).collect()]
    assert all(len(s) <= 64 and sum(p["length"] for p in pieces) == len(s) for s, pieces in wrote)
    want = Counter((i, at, token) for i, t, _ in corpus for at, token in enumerate([*ids(t), 1]))
    got = Counter((int(p["key"]), p["start"] + j, token) for s, pieces in wrote for p in pieces
                  for j, token in enumerate(s[p["offset"]:p["offset"] + p["length"]]))
    assert got == want
    rows = packing.pack(docs, "doc_id", "text", plans.tokenizer_file(), capacity=64, windows=8, with_ids=True).collect()
    assert Counter((r["doc_id"], r["start"] + j, token) for r in rows for j, token in enumerate(np.frombuffer(r["ids"], "<u4").tolist())) == want
    packing.write_sequences(none, "doc_id", "text", plans.tokenizer_file(), out + "-none")
    assert packing.read_sequences(spark, out + "-none").count() == 0


def test_differencing_balances():
    lengths = np.array([8, 7, 6, 5, 4])
    window, sums = packing.differencing(lengths, 2)
    assert sorted(sums.tolist()) == [14, 16] and sums.tolist() == np.bincount(window, lengths).astype(int).tolist()
    assert packing.pack_batch(np.array([5, 5, 5]), 9, 5)[2].max() == 2  # k rises until all fit
    rest, sizes, window = packing.pack_batch(np.array([60, 60, 50, 40, 40, 30]), 64, 4)
    assert np.bincount(rest, sizes).tolist() == [60, 60, 50, 40, 40, 30] and np.bincount(window, sizes).max() <= 64 and window.max() < 6
    assert packing.differencing(np.array([3]), 2)[0].tolist() == [0]


def pages(spark):
    html = ["<a>", "<b>é</b>", "<a>", None, "", "<a>", "x" * 70_000, "<c>"]
    return [(i, f"http://h/{i}\r\nX: y" if i else None, h) for i, h in enumerate(html)]


def test_warc_round_trip(spark):
    rows = pages(spark)
    table = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, payload string").repartition(2)
    folder = warc.archive_folder(spark)
    index = warc.write_bundles(warc.plan_records(table, "page_id", "url", "html"), folder, frame_bytes=100, bundle_bytes=1000)
    got = {r["id"]: r for r in warc.read_bundles(index, folder).collect()}
    body = {i: (h or "").encode() for i, _, h in rows}
    keeper = {b: max(i for i in body if body[i] == b) for b in body.values()}
    assert set(got) == set(body)
    for i, b in body.items():
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if keeper[b] == i else ("revisit", keeper[b]))
        assert r["payload"] == (b if keeper[b] == i else None)
    some = index.filter("id = 6")
    assert [r["id"] for r in warc.read_bundles(some, folder).collect()] == [6]
    system, root = warc.file_system(folder)
    for name in {r["file"] for r in index.collect()}:
        with system.open_input_file(f"{root}/{name}") as f:
            data = f.read()
        frames = warc.read_seek_table(data)
        tail = 8 + 8 * len(frames) + 9
        assert sum(a for a, _ in frames) + tail == len(data)
    empty = warc.plan_records(table.limit(0), "page_id", "url", "html")
    assert warc.read_bundles(warc.write_bundles(empty, warc.archive_folder(spark)), folder).count() == 0


def test_pages_without_id_have_records(spark):
    given = [(None, "u", "a"), (None, "u", "a"), (1, "u", "a"), (2, "u", "a"), (None, None, "b"), (None, "u", "b"), (None, None, None)]
    table = spark.createDataFrame(given, "page_id long, url string, html string")
    folder = warc.archive_folder(spark)
    got = warc.read_bundles(warc.write_bundles(warc.plan_records(table, "page_id", "url", "html"), folder), folder).collect()
    assert Counter((r["id"], r["record_type"], r["refers_to"], r["payload"]) for r in got) == Counter([
        (None, "revisit", 2, None), (None, "revisit", 2, None), (1, "revisit", 2, None), (2, "response", None, b"a"),
        (None, "response", None, b"b"), (None, "response", None, b"b"), (None, "response", None, b"")])


def test_small_payloads_are_all_responses(spark):
    table = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    got = {r["id"]: r["refers_to"] for r in warc.plan_records(table, "page_id", "url", "html", 3).collect()}
    assert got == {1: None, 2: None, 3: 4, 4: None}


def brute_quality(text):
    w = WORD.findall(text or "")
    five = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    count = Counter(five)
    inside = {j for i, g in enumerate(five) if count[g] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside),
            len(w) < 10 or 100 * len(inside) > 20 * len(w))


def test_quality_statistics(spark, docs, corpus, none):
    rows = corpus + [(300, "a b c d e f\na b c d e f\n\n \na b c d e f | # x", "de"), (301, "é\n" * 30, "de"), (302, "a b c d e " * 9, None)]
    table = docs.unionByName(sample(spark, rows[len(corpus):]))
    model = quality.fit(table)
    got = table.select("doc_id", quality.quality(F.col("text"), F.col("lang"), model).alias("q")).select("doc_id", "q.*").collect()
    want = Counter((i, *brute_quality(t)) for i, t, _ in rows)
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == want
    assert all(not r["kept"] for r in got if r["base_failed"])
    empty = quality.fit(none)
    assert none.select(quality.quality(F.col("text"), F.col("lang"), empty)).count() == 0


def test_perplexity_is_a_distribution_and_rejects_noise(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, 80), "en") for i in range(150)]
    rows += [(1000, "".join(rng.choice("|#%~qxz@^=0123456789") + rng.choice(" #|") for _ in range(500)), "en")]
    table = sample(spark, rows)
    model = quality.fit(table)
    for lang in model.hashes:
        p = 10.0 ** model.table(lang).astype(np.float64).reshape(-1, quality.CLASSES)
        seen = np.unique(model.hashes[lang][2] // quality.CLASSES)
        assert np.allclose(p[seen].sum(axis=1), 1, atol=1e-3)
    kept = {r["doc_id"]: r["k"] for r in table.select("doc_id", quality.quality(F.col("text"), F.col("lang"), model)["kept"].alias("k")).collect()}
    assert not kept[1000] and sum(kept.values()) >= 147


def test_characters_are_told_apart(spark):
    """Each byte counts as it is, and a text is no evidence for itself: random digits and letters of any script are rejected."""
    data = np.frombuffer("aé \n日".encode(), np.uint8)
    bounds = np.array([0, 3, 3, len(data)])
    want = [(b" " * 5 + t[:i + 1])[-5:] for t in ("aé".encode(), " \n日".encode()) for i in range(len(t))]
    assert [int(g).to_bytes(5, "big") for g in quality.byte_grams(data, bounds)] == want
    rng = random.Random(6)
    rows = [(i, prose(rng, 80), "en") for i in range(150)]
    for i, letters in enumerate(["0123456789", "".join(map(chr, range(0x410, 0x450))), "abcdefghijklmnopqrstuvwxyz"] * 3):
        rows.append((1000 + i, " ".join("".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(80)), "en"))
    table = sample(spark, rows)
    kept = {r["doc_id"]: r["k"] for r in table.select("doc_id", quality.quality(F.col("text"), F.col("lang"), quality.fit(table))["kept"].alias("k")).collect()}
    assert not any(k for i, k in kept.items() if i >= 1000) and sum(kept.values()) >= 147


def test_quality_counts_do_not_pass_the_jvm(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    def refused(*_):
        raise AssertionError("n-grams are read as files")

    monkeypatch.setattr(DataFrame, "toPandas", refused)
    monkeypatch.setattr(DataFrame, "toArrow", refused)
    rng = random.Random(2)
    model = quality.fit(sample(spark, [(i, prose(rng, 40), ("en", None)[i % 2]) for i in range(40)]))
    assert sorted(model.hashes) == ["*", "en"] and all(len(h) and (np.diff(h) > 0).all() for h in model.hashes["en"])


def test_levenshtein_matches_agree_with_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    terms = [toxicity.Term("idiot", False), toxicity.Term("worthless", False), toxicity.Term("scum", False), toxicity.Term("lowei", True)]
    matcher = toxicity.Matcher(terms)
    rng = random.Random(2)
    tried = ["", "idiot", "idot", "idioot", "1diot", "1di0t", "wrthles", "worthlesses", "scun", "loweix", "lowe", "scum"]
    for t in terms:
        for _ in range(200):
            w = list(t.text)
            for _ in range(rng.randint(0, 3)):
                k = rng.randrange(len(w) + 1)
                w[k:k + rng.randint(0, 1)] = rng.choice(["", "a", "t", "x"])
            tried.append("".join(w))
    for w in tried:
        best = min(distance(w, t.text) if distance(w, t.text) <= t.errors else 9 for t in terms if not t.stem)
        want = 1 if w.startswith("lowei") or best == 0 else 2 if best < 9 else 0
        assert matcher.match(w) == want, w


def test_toxicity_learns_and_separates_quotes(spark, none):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(300):
        w = prose(rng, 40).split()
        bad = i % 3 == 0
        if bad:
            w[10] = rng.choice(["Grumpft!", "grumpft,", "snorkel" + rng.choice(["a", "o", "u", "en", "ing", "ers"])])
        rows.append((i, " ".join(w), "en"))
        labels.append((i, int(bad), 1))
    rows += [(900, "they " * 12 + "grumpfft " + "they " * 12, "en"), (901, "he said " + '"you grumpft you" ' + "they " * 12, "en"), (902, None, "en"), (903, "", None)]
    labels += [(5000, None, 1), (None, 1, 1)]
    table, known = sample(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int, text int")
    usable = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    model = toxicity.fit(table, known, "doc_id", "text", "toxic", usable)
    assert {"grumpft", "snorkel"} <= {t.text for t in model.terms}
    got = {r["doc_id"]: r for r in table.select("doc_id", toxicity.features(F.col("text"), model).alias("f"), toxicity.score(
        toxicity.features(F.col("text"), model), model).alias("s")).collect()}
    wrong = sum((got[i]["s"] >= 0.3) != (i % 3 == 0) for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2)
    assert wrong <= 2
    assert got[900]["f"]["near_open"] == 1 and got[901]["f"]["exact_quoted"] == 1
    assert got[902]["s"] == got[903]["s"] < 0.3
    blank = toxicity.fit(none, known.limit(0), "doc_id", "text", "toxic", usable)
    assert none.select(toxicity.features(F.col("text"), blank)).count() == 0
    assert table.select(toxicity.score(toxicity.features(F.col("text"), blank), blank).alias("s")).agg(F.max("s")).first()[0] == 0.5


def test_sharding_laws(docs, corpus, none, spark):
    got = sharding.assign(docs, "doc_id", "text", 5, bucket_rows=4).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in corpus)
    for s in range(5):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert all(r["grown_shard"] in (r["shard"], 5) for r in got)
    grown = {r["doc_id"]: r["shard"] for r in sharding.assign(docs, "doc_id", "text", 6).collect()}
    assert all(grown[r["doc_id"]] == r["grown_shard"] for r in got)
    assert sharding.assign(none, "doc_id", "text", 5).count() == 0


def test_shards_hold_every_row_once(spark):
    same = [(None, f"t{i % 3}", "en") for i in range(40)] + [(7, "again", "en")] * 30 + [(i, None if i % 5 == 0 else f"w{i}", "fr") for i in range(30)]
    rows = sample(spark, same)
    path = f"{warc.archive_folder(spark)}-rows"
    sharding.shuffle_shards(rows, "doc_id", "text", 4, path, bucket_rows=8)
    back = sharding.read_shards(spark, path, rows.schema)
    assert back.columns == ["row", "shard", "slot"] and back.select("row.*").columns == rows.columns
    assert Counter((r["doc_id"], r["text"], r["lang"]) for r in back.select("row.*").collect()) == Counter(same)
    joined = sharding.read_shards(spark, path, rows.schema, max_broadcast=0)
    assert joined.exceptAll(back).count() == 0 and joined.count() == back.count()
    for s in range(4):
        slots = sorted(r["slot"] for r in back.filter(F.col("shard") == s).select("slot").collect())
        assert slots == list(range(len(slots)))
    # One key has one shard, but many buckets, none of them large.
    raw = spark.read.parquet(path)
    assert raw.filter("row.doc_id = 7").select("shard").distinct().count() == 1
    assert raw.filter("row.doc_id = 7").select("bucket").distinct().count() > 1
    assert raw.groupBy("shard", "bucket").count().agg(F.max("count")).first()[0] < 30
    # Places in a bucket are a permutation.
    for r in raw.groupBy("shard", "bucket").agg(F.sort_array(F.collect_list("place")).alias("p")).collect():
        assert r["p"] == list(range(len(r["p"])))


def test_shards_of_clashing_columns(spark):
    names = ["doc_id", "text", "shard", "bucket", "place", "row", "slot", "before", "rows", "Deal", "__rank"]
    rows = spark.createDataFrame([(i, f"t{i}", *map(str, range(9))) for i in range(50)], ", ".join(f"`{n}` {'long' if n == 'doc_id' else 'string'}" for n in names))
    path = f"{warc.archive_folder(spark)}-clash"
    sharding.shuffle_shards(rows, "doc_id", "text", 3, path, bucket_rows=5)
    back = sharding.read_shards(spark, path, rows.schema).select("row.*")
    assert back.columns == names and sorted(back.collect()) == sorted(rows.collect())
    assert sharding.assign(rows, "doc_id", "text", 3).count() == 50


def test_shuffled_buckets_are_mixed(spark):
    """Every place of a bucket takes early and late rows alike."""
    rows, path = sample(spark, [(i, f"t{i}", "en") for i in range(4000)]), f"{warc.archive_folder(spark)}-mixed"
    sharding.shuffle_shards(rows, "doc_id", "text", 1, path, bucket_rows=1000)
    places = {r["doc_id"]: (r["place"], r["bucket"]) for r in spark.read.parquet(path).select("row.doc_id", "place", "bucket").collect()}
    for low in range(0, 4000, 1000):
        part = [places[i][0] for i in range(low, low + 1000)]
        assert 400 < sum(part) / 1000 < 600


def test_sharding_query_writes_texts(spark, monkeypatch):
    wrote = []
    monkeypatch.setattr(plans, "scratch_path", lambda s, name: wrote.append(f"{warc.archive_folder(s)}-{name}") or wrote[-1])
    got = plans.op8(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    back = spark.read.parquet(wrote[0])
    assert back.select("row.*").exceptAll(docs).count() == 0 and back.count() == docs.count() == got.count()


def test_contamination_spans_and_slices(spark):
    rng = random.Random(6)
    item = prose(rng, 20).replace("é", "e").replace("ñ", "n")
    bench = spark.createDataFrame([(10, item, 1), (9, "Short, ITEM!", 2), (None, "x y", 3), (8, None, 4), (7, " .. ", 5), (10, "tail end", 6)],
                                  "item_id long, text string, n_words int")
    texts = ["Begin " + item.upper().replace(" ", " -\n") + " end", "a short/item b", "shortitem", None, "", "x y", "tail END " * 30]
    table = sample(spark, [(i, t, "en") for i, t in enumerate(texts)])
    for size in (4 << 20, 30):
        found = decontaminate.contamination(F.col("text"), bench, slice_bytes=size)
        got = {r["doc_id"]: r["f"] for r in table.select("doc_id", found.alias("f")).collect()}
        assert (got[0]["n_words"], got[0]["n_hit"], got[0]["items"]) == (22, 20, ["10"])
        (span,) = got[0]["spans"]
        assert texts[0][span["start"]:span["end"]].lower().replace(" -\n", " ") == item
        assert got[1]["items"] == ["9"] and [tuple(s) for s in got[1]["spans"]] == [(2, 12)]
        assert [got[i]["n_hit"] for i in (2, 3, 4, 5)] == [0, 0, 0, 0] and got[6]["n_hit"] == 60
    blank = decontaminate.contamination(F.col("text"), bench.limit(0))
    assert table.select(blank["n_hit"].alias("n")).agg(F.sum("n")).first()[0] == 0


@pytest.mark.parametrize("url,host,path", [
    ("HTTP://WWW.Ex.com/A/b?x#y", "www.ex.com", "/A/b"), ("http://a.b", "a.b", ""), ("x://a?p=/q", "a", ""), ("a/b", "", ""), (None, "", ""), ("http://a#/b", "a", ""),
    ("r://h/p?u=http://z/", "h", "/p"), ("", "", "")])
def test_url_parts(spark, url, host, path):
    h, p = urls.host_and_path(F.col("u"))
    assert tuple(spark.createDataFrame([(url,)], "u string").select(h, p).first()) == (host, path)


def test_url_rules_and_templates(spark):
    rules = plans.URL_RULES
    rows = [(1, "http://example.com/en/1"), (2, "http://www.example.com/en/1"), (3, "http://a.net/es/2"), (4, "http://net/fr/"), (5, "http://anet/fr/"),
            (6, None), (7, "http://x.com"), (8, "http://y.org/q/1"), (8, "http://y.org/q/1")]
    table = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, host string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.filter_urls(table, "page_id", "url", rules).collect()}
    assert got == {1: ("example.com/en/", "block"), 2: ("www.example.com/en/", "allow"), 3: ("net/es/", "block"), 4: ("net/fr/", "block"),
                   5: (None, "allow"), 6: (None, "allow"), 7: (None, "allow"), 8: (None, "allow")}
    assert urls.filter_urls(table.limit(0), "page_id", "url", rules).count() == 0


def test_templates_reject_by_purity(spark):
    rows = [("h", ["ads", "{n}"], 1)] * 8 + [("h", ["ads", "{n}"], None)] * 3 + [("h", ["news", "{n}"], 0)] * 8 + [("h", ["misc", "{n}"], None)]
    rows += [("h", ["blog", f"slug-{c}{d}"], None) for c in "abcdefg" for d in "hijklm"]
    got = urls.judge_templates(spark.createDataFrame(rows, "host string, segments array<string>, blocked int"))
    found = {tuple(r["segments"]): (r["template"], r["verdict"]) for r in got.collect()}
    assert found[("ads", "{n}")] == ("/ads/{n}", "block") and found[("news", "{n}")][1] == "allow" and found[("misc", "{n}")][1] == "allow"
    assert found[("blog", "slug-ah")][0] == "/blog/{*}"


def test_language_model(spark, docs, corpus, none):
    usable = F.coalesce(F.col("doc_id") % 7 != 2, F.lit(False))
    settings = lm.Settings(symbols=30, frequent=50, rounds=2, hidden=8)
    model, counts = lm.fit(docs, "doc_id", "text", usable, settings)
    got = lm.score(docs, "doc_id", "text", model, counts, settings).collect()
    split = [(i, WORD.findall(lower(t))) for i, t, _ in corpus]
    count = Counter(w for i, ws in split if i % 7 != 2 for w in ws)
    ends = sum(i % 7 != 2 for i, _ in split)
    total = sum(count.values()) + ends
    z = math.log10(total + len(count) + 1 + 1)
    want = Counter((i, len(ws) + 1, sum(count[w] > 0 for w in ws) + 1, round(sum(math.log10(count[w] + 1) - z for w in ws) + math.log10(ends + 1) - z, 6))
                   for i, ws in split)
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["train_tokens"] == total and r["score"] < 0 for r in got)
    # The model is the same however the input is cut, and more than one trainer takes part.
    small = lm.Settings(symbols=30, frequent=50, rounds=2, hidden=8, trainer_tokens=total // 6)
    scores = []
    for parts in (1, 7):
        model, counts = lm.fit(docs.repartition(parts), "doc_id", "text", usable, small)
        scores.append(sorted(r["score"] for r in lm.score(docs.coalesce(1), "doc_id", "text", model, counts, small).collect()))
    assert scores[0] == pytest.approx(scores[1], rel=1e-4)
    model, counts = lm.fit(none, "doc_id", "text", usable, settings)
    blank = lm.score(docs, "doc_id", "text", model, counts, settings).collect()
    assert all(r["n_known"] == 0 and math.isfinite(r["score"]) for r in blank)
    assert lm.score(none, "doc_id", "text", model, counts, settings).count() == 0


def test_frequent_words_are_the_highest_brackets(spark):
    counts = spark.createDataFrame([(i, 0, n) for i, n in enumerate([1, 1, 1, 9, 500, 9, 70])], "word long, kind long, n long")
    assert lm._frequent(counts, 4)["n"].tolist() == [500, 70, 9, 9]
    assert lm._frequent(counts, 3)["n"].tolist() == [500, 70]
    assert len(lm._frequent(counts, 0)) == 0 and len(lm._frequent(counts, 7)) == 7


def test_network_is_a_distribution_and_its_gradients_are_right():
    rng = np.random.default_rng(0)
    w = gru.start(np.arange(64, 0, -1), 5, 1)
    h = rng.standard_normal((1, 5)).astype(np.float32) * 0.5
    p = [np.exp(gru.log_probabilities(w, h, np.array([s]))[0][0]) for s in range(64)]
    assert abs(sum(p) - 1) < 1e-4
    inputs, targets = rng.integers(0, 64, (6, 3)), rng.integers(0, 64, (6, 3))
    caught = {}
    trainer = gru.Trainer({k: v.astype(np.float32) for k, v in w.items()}, 0.0)
    trainer._update = lambda grads, n: caught.update(grads)
    state = np.zeros((3, 5), np.float32)
    trainer._window(inputs, targets, np.ones((6, 3), bool), state, -1)

    def loss(name, at, step):
        v = {k: x.copy() for k, x in w.items()}
        v[name][at] += step
        states, _ = gru.run(v, inputs, state)
        return -gru.log_probabilities(v, states.reshape(-1, 5), targets.ravel())[0].sum(dtype=np.float64)

    for name, at in [("state", (1, 2)), ("state", (0, 12)), ("table", (int(inputs[0, 0]), 7)), ("to_class", (2, 0)), ("to_member", (0, 3, 5)), ("member_bias", (1, 4))]:
        numeric = (loss(name, at, 0.02) - loss(name, at, -0.02)) / 0.04
        assert abs(numeric - caught[name][at]) < 0.02 + 0.03 * abs(numeric), name


def test_network_learns_across_windows():
    symbols = np.tile(np.array([1, 2, 3, 4, 5, 6, 7, 8]), 2000)
    docs = gru.Documents(symbols, np.arange(0, 16001, 160), 0, 64)
    w = gru.start(np.bincount(docs.target, minlength=32), 12, 3)
    before = gru.score(w, docs).sum()
    trainer = gru.Trainer(w, 0.02, 8)
    for _ in range(5):
        trainer.learn(docs, 0, 32)
    after = gru.score(trainer.w, docs, 8).sum()
    assert after > 0.3 * before and abs(gru.score(trainer.w, docs, 64).sum() - after) < 1e-2 * abs(after)


def test_pipeline_keeps_what_it_should(spark, tmp_path):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = {r[0] for r in docs.select("doc_id").collect()}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{tmp_path}/{name}"
        stage(spark, docs, folder).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        if number < 4:
            assert docs.columns == before.columns
            now = {r[0] for r in docs.select("doc_id").collect()}
            assert now <= ids and len(now) >= 0.8 * len(ids), name
            ids = now
        if name == "near_duplicates":
            rows = [tuple(r) for r in before.select("doc_id", "text").collect()]
            assert ids == {k[2] for k in brute_components(rows, 5, 80, 100)}
    assert {r[0] for r in docs.select("doc_id").collect()} == ids


@pytest.mark.parametrize("stored", [False, True])
def test_near_duplicates_are_removed_by_row(spark, tmp_path, stored):
    import corpus_pipeline

    rng = random.Random(8)
    a, b, c, d = (prose(rng, 60) for _ in range(4))
    rows = [(1, a), (5, a + " more"), (5, b), (9, c), (9, c), (9, c), (None, d), (None, d + " more"), (None, a), (7, None), (7, None), (None, "")]
    docs = sample(spark, [(i, t, "en") for i, t in rows])
    if stored:
        docs.write.parquet(f"{tmp_path}/docs")
        docs = spark.read.parquet(f"{tmp_path}/docs")
    got = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert got.columns == docs.columns
    found = Counter((r["doc_id"], r["text"]) for r in got.collect())
    last = [k for k in found if k[0] is None and k[1] in (d, d + " more")]
    assert len(last) == 1
    assert found == Counter([(1, a), (5, b), (9, c), *last, (7, None), (7, None), (None, "")])


def test_stages_stand_empty_documents(spark, none):
    import corpus_pipeline

    docs = none.select("doc_id", "text", "lang", F.lit(None).cast("string").alias("source"), F.lit(0).cast("long").alias("n_chars"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "/root/testdata/sf0.001").count() == 0
