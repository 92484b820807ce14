"""Folders of files with mixed encodings and headers, and incremental reading."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.sources import tables as src


def write(folder, name, text, encoding="utf-8"):
    (folder / name).write_bytes(text.encode(encoding))


def test_each_file_has_its_encoding_and_header(spark, tmp_path):
    folder = tmp_path / "two words"
    folder.mkdir()
    write(folder, "a.csv", 'id,content_anonymized,GPT5.5_Medium\n1,"một, ""hai""\nba",2\n', "utf-8-sig")
    write(folder, "b.csv", "label,id,extra,content_anonymized\n0,2,x,đương\n,3,,\"\"\n", "cp1258")
    (folder / "c.csv").write_bytes(b"content_anonymized,label,id\ncaf\xe9 \x8d,1,4\r\n")
    write(folder, "empty.csv", "")
    write(folder, "head.csv", "id,content_anonymized,label\n")
    got = {r["id"]: (r["content_anonymized"], r["GPT5.5_Medium"]) for r in src.read_label_tables(spark, str(folder)).collect()}
    assert got == {1: ('một, "hai"\nba', "2"), 2: ("đương", "0"), 3: ("", None), 4: ("café \x8d", "1")}


@pytest.mark.parametrize("text, fault", [("id,text\n1,a\n", "no column"), ("id,content_anonymized,label\n1,a\n", "CSV parse error"),
                                         ("id,content_anonymized,label\nx,a,1\n", "CAST_INVALID_INPUT")])
def test_faulty_files_are_named(spark, tmp_path, text, fault):
    write(tmp_path, "bad.csv", text)
    with pytest.raises(Exception, match=fault) as caught:
        src.read_label_tables(spark, str(tmp_path)).collect()
    assert fault == "CAST_INVALID_INPUT" or "bad.csv" in str(caught.value)


def test_long_values_and_many_files(spark, tmp_path):
    for i in range(40):
        write(tmp_path, f"{i}.csv", f'id,v\n{i},"{"x" * 3_000_000 if i == 7 else "y"}"\n')
    got = src.read_csv_any_encoding(spark, str(tmp_path), "id long, v string").select("id", F.length("v").alias("n")).collect()
    assert {r["id"]: r["n"] for r in got} == {i: 3_000_000 if i == 7 else 1 for i in range(40)}


@pytest.mark.parametrize("encoding, letter", [("utf-8", "đ"), ("cp1258", "đ"), ("latin-1", "\x8d")])
def test_rows_longer_than_a_block_and_bounded_memory(tmp_path, encoding, letter):
    values = [letter * n for n in (3, 5_000_000, 7, 0, 200, 9_000_000, 1)] + ["y" * 1000 + "\n"] * 40_000
    with open(tmp_path / "a.csv", "w", encoding=encoding, newline="") as sink:
        sink.write("id,v\n")
        for i, v in enumerate(values):
            sink.write(f'{i},"{v}"\n')
    got, most = [], 0
    for batch in src._csv_rows(str(tmp_path / "a.csv"), {"id": ["id"], "v": ["v"]}):
        got += [(int(i), len(v)) for i, v in zip(batch.column("id").to_pylist(), batch.column("v").to_pylist())]
        most = max(most, batch.nbytes)
    assert got == [(i, len(v)) for i, v in enumerate(values)]
    assert most < 9 * src.BLOCK


def ids(folder):
    rows = folder.pending()
    return sorted(r["id"] for r in rows.collect()), rows


def test_high_water_mark(spark, tmp_path):
    feed, ledger = str(tmp_path / "feed"), str(tmp_path / "ledger")
    open_folder = lambda: src.IncrementalFolder(spark, feed, ledger, "id long")
    first = open_folder()
    assert ids(first)[0] == []  # no folder yet
    first.commit()
    spark.range(4).coalesce(1).write.parquet(f"{feed}/a")
    spark.range(4, 6).coalesce(1).write.parquet(f"{feed}/b")
    for root, _, names in os.walk(feed):
        for name in names:
            os.utime(os.path.join(root, name), (1_700_000_000, 1_700_000_000))
    crashed = open_folder()
    assert ids(crashed)[0] == list(range(6))
    second = open_folder()  # no commit: the same rows again
    assert ids(second)[0] == list(range(6))
    second.commit()
    with pytest.raises(ValueError):
        second.commit()
    assert ids(open_folder())[0] == []
    # A file of the mark's own time, and a later one; files below the mark are not even listed.
    for name, low, at in (("c", 6, 1_700_000_000), ("d", 8, 1_700_000_500)):
        spark.range(low, low + 2).coalesce(1).write.parquet(f"{feed}/{name}")
        for root, _, names in os.walk(f"{feed}/{name}"):
            for n in names:
                os.utime(os.path.join(root, n), (at, at))
    third = open_folder()
    got, _ = ids(third)
    assert got == [6, 7, 8, 9]
    # What comes between reading and commit is left for the next run.
    spark.range(20, 21).coalesce(1).write.parquet(f"{feed}/e")
    third.commit()
    last = open_folder()
    got, rows = ids(last)
    assert got == [20]
    assert not any("/a/" in f or "/b/" in f for f in rows.inputFiles())
    last.commit()
    assert ids(open_folder())[0] == []
