"""Dictionary tables against the column forms, which hold every entry in the plan."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import normalize as nz
from tidemark.functions import phrases as ph
from tidemark.sources import dictionaries as dic

SOURCE = "source string, target string"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    parts = ["a", "b", "ab", "à", "é", "ko", "_", "-", ".", "#", " ", " ", " ", "  ", "1", "\n"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(400)] + ["", "a b a b a", "x" * 50_000]


def test_phrases_equal_the_longest_first_pattern(spark, value, texts):
    rng = random.Random(4)
    keys = {" ".join(rng.choice(["a", "b", "ab", "à", "ko"]) for _ in range(rng.randint(1, 4))) for _ in range(60)}
    table = {k: f"<{i}>" for i, k in enumerate(sorted(keys | {".", "-a", "a.", "a  b"}))}
    entries = spark.createDataFrame(list(table.items()) + [("", "none"), (None, "none"), ("zz", None)], SOURCE)
    assert value(ph.phrase_replacer(entries), texts) == value(lambda c: nz.expand_abbreviations(c, table), texts)


def test_hashtags_equal_the_list_form(spark, value, texts):
    given = [*texts, "#Kò #ko_a x#AB", "#", "##a"]
    noise = spark.createDataFrame([("KO",), ("#àb",), (None,), ("",)], "tag string")
    assert value(ph.hashtag_resolver(noise), given) == value(lambda c: nz.resolve_hashtags(c, ["KO", "#àb"]), given)


def test_empty_tables_and_nulls(spark):
    rows = spark.createDataFrame([(1, "k #a đđđ", "x"), (2, None, "y")], "id int, text string, target string")
    none, tags = spark.createDataFrame([], SOURCE), spark.createDataFrame([], "tag string")
    assert [r[0] for r in rows.orderBy("id").select(ph.phrase_replacer(none)(F.col("text"))).collect()] == ["k #a đđđ", None]
    got = {r["id"]: r["target"] for r in ph.preprocess_rows(rows, "text", "target", none, tags).collect()}
    assert got == {1: "k a đ", 2: ""}
    assert ph.preprocess_rows(rows.limit(0), "text", "out", none, tags).count() == 0


def test_a_dictionary_too_large_for_a_worker_is_an_error(spark):
    with pytest.raises(ValueError, match="max_bytes"):
        ph.phrase_replacer(spark.createDataFrame([("k", "không")], SOURCE), max_bytes=3)


def test_files_with_keys_of_several_words(spark, value, tmp_path):
    lines = ["# comment", "thank you\tcảm ơn", "thank you very much\trất cảm ơn", "k không", "k\tko", "half"] + [f"w{i} x\tv{i}" for i in range(400)]
    (tmp_path / "d.txt").write_text("﻿" + "\n".join(lines))
    (tmp_path / "h.txt").write_text("// none\n#Nhiễu\nspam\n")
    expand = ph.phrase_replacer(dic.load_dictionary(spark, str(tmp_path / "d.txt")))
    assert value(expand, ["thank you very much k", "thank you very", "w7 x w399 x w400 x"]) == ["rất cảm ơn ko", "cảm ơn very", "v7 v399 w400 x"]
    assert value(ph.hashtag_resolver(dic.load_hashtags(spark, str(tmp_path / "h.txt"))), ["#nhieu a #SPAM b #c_d"]) == ["  a   b  c d "]
