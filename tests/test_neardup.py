"""Near duplicates against brute force, and the chance of a miss."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import neardup as nd

WORDS = ["lua", "mua", "hoc", "phi", "gap", "nhieu", "ban", "truong", "di", "nhe"]


def sets(rows, words):
    found = []
    for key, text in rows:
        w = (text or "").lower().split()
        found.append((key, {tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()))
    return found


def brute(rows, num, den, words):
    found, order = {}, lambda k: (k is None, k or 0)
    every = sets(rows, words)
    for key, s in every:
        linked = [k for k, o in every if s and den * len(s & o) >= num * len(s | o)]
        found[key] = min([*linked, key], key=order)
    return found


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choice(WORDS) + str(rng.randint(0, 30)) for _ in range(n))
    found = [(i, prose(rng.randint(1, 80))) for i in range(60, 90)]
    base = prose(120)
    for i in range(60):  # a family: each differs from the base in a few words, so not all are similar to each other
        w = base.split()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"x{i}"
        found.append((i, " ".join(w)))
    found += [(100, None), (101, ""), (102, " \t "), (103, base.upper()), (104, "  " + base.replace(" ", "\n")), (105, "mot hai"), (106, "Mot  HAI"), (None, base + " het")]
    return found


@pytest.mark.parametrize("num, den, words", [(9, 10, 5), (8, 10, 5), (9, 10, 2)])
def test_first_similar_text(spark, rows, num, den, words):
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "id long, text string, h string, band int").repartition(3)
    got = {r["id"]: (r["first_key"], r["is_near_duplicate"]) for r in nd.near_duplicates(df, "id", "text", num, den, words).collect()}
    want = brute(rows, num, den, words)
    assert got == {k: (f, f != k) for k, f in want.items()}
    assert sum(d for _, d in got.values()) > 20


def test_empty_table(spark):
    assert nd.near_duplicates(spark.createDataFrame([], "id long, text string"), "id", "text").count() == 0


def test_band_values_are_equal_in_proportion(spark):
    """Sets with a similarity of 0.9 share a band nearly always, those of 0.3 hardly ever."""
    rng = random.Random(1)
    rows = []
    for i in range(300):
        base = [rng.getrandbits(62) for _ in range(190)]
        rows.append((i, base, base[:180] + [rng.getrandbits(62) for _ in range(10)], base[:88] + [rng.getrandbits(62) for _ in range(102)]))
    df = spark.createDataFrame(rows, "i int, a array<bigint>, b array<bigint>, c array<bigint>")
    share = lambda x, y: F.size(F.filter(F.zip_with(x, y, lambda p, q: p == q), lambda e: e)) > 0
    got = df.select(nd.band_values(F.col("a")).alias("a"), nd.band_values(F.col("b")).alias("b"), nd.band_values(F.col("c")).alias("c")).agg(
        F.count_if(share("a", "b")).alias("near"), F.count_if(share("a", "c")).alias("far")).first()
    assert got["near"] == 300 and got["far"] < 40


def test_only_sets_in_pairs_move(spark, monkeypatch):
    from tidemark.operators import neardup as nd

    sets = spark.createDataFrame([(i, list(range(i, i + 20 - i % 2))) for i in range(200)], "class long, hashes array<long>")
    pairs = spark.createDataFrame([(2, 1), (9, 8), (150, 7)], "a long, b long")
    want = {(2, 1): False, (9, 8): True, (150, 7): False}
    found = nd._similar(pairs, sets, 9, 10)
    assert {(r["a"], r["b"]): r["similar"] for r in found.collect()} == want
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(nd, "FEW", 2)  # too many to broadcast: all sets move, with the same result
    assert {(r["a"], r["b"]): r["similar"] for r in nd._similar(pairs, sets, 9, 10).collect()} == want
