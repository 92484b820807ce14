"""Published agreement figures from count matrices, and invariants."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import agreement as ag
from tidemark.operators import votes as vt


def matrix(spark, table):
    """Cells ``(b, a, n)`` of a table keyed by b, then by a."""
    rows = [("x", a, b, n) for b, row in table.items() for a, n in row.items()]
    return spark.createDataFrame(rows, "scope string, a string, b string, n long")


FIRST = {"0": {"0": 1234, "1": 13, "2": 12}, "1": {"0": 6201, "1": 4975, "2": 891}, "2": {"0": 99, "1": 89, "2": 283}}
SECOND = {"neg": {"neg": 1185, "neu": 267, "pos": 44}, "neu": {"neg": 231, "neu": 111, "pos": 12},
          "pos": {"neg": 6118, "neu": 4699, "pos": 1130}}


@pytest.mark.parametrize("table, kappa", [(FIRST, 0.15339928794780516), (SECOND, 0.03821885790851635)])
def test_published_kappa(spark, table, kappa):
    row = ag.kappa_from_matrix(matrix(spark, table), ["scope"]).first()
    assert row["comparable_rows"] == 13797
    assert row["cohen_kappa"] == pytest.approx(kappa, abs=1e-14)


def test_published_agreement_parts(spark):
    row = ag.kappa_from_matrix(matrix(spark, FIRST), ["scope"]).first()
    assert row["observed_agreement"] == pytest.approx(0.4705370732767993, abs=1e-15)
    assert row["expected_agreement"] == pytest.approx(0.3746013685250029, abs=1e-15)


def test_kappa_from_rows_is_symmetric_and_by_group(spark):
    rows = [(g, a, b) for g, shift in (("c", 0), ("p", 1)) for b, r in FIRST.items() for a, n in r.items() for _ in range(n // 10 + shift)]
    df = spark.createDataFrame(rows, "g string, x string, y string")
    one = {r["g"]: r["cohen_kappa"] for r in ag.cohen_kappa(df, "x", "y", "g").collect()}
    two = {r["g"]: r["cohen_kappa"] for r in ag.cohen_kappa(df, "y", "x", "g").collect()}
    assert one == pytest.approx(two)
    assert set(one) == {"c", "p"}


def test_kappa_edges(spark):
    df = spark.createDataFrame([("a", None, "1"), ("b", "1", "1"), ("b", "1", "1")], "g string, x string, y string")
    got = {r["g"]: (r["rows"], r["comparable_rows"], r["cohen_kappa"]) for r in ag.cohen_kappa(df, "x", "y", "g").collect()}
    assert got == {"a": (1, 0, 0.0), "b": (2, 2, 1.0)}
    empty = df.filter("g = 'a'").select(F.col("x").alias("label_a"), F.col("y").alias("label_b"))
    with pytest.raises(Exception, match="No comparable rows"):
        ag.two_file_agreement(empty).collect()


def test_votes(spark):
    df = spark.createDataFrame(
        [("1", "1", "2"), ("0", "1", "2"), ("", "1", "1"), ("", "", "1"), (None, "2", "2")], "a string, b string, c string")
    got = [r[0] for r in df.select(vt.majority([F.col("a"), F.col("b"), F.col("c")])).collect()]
    assert got == ["1", "", "1", "", "2"]


def test_plurality_ties(spark):
    df = spark.createDataFrame(
        [(0, 1, 1, 0), (None, 2, 1, 1), (None, None, None, None), (2, 0, 1, None), (None, None, 1, 2)],
        "gemini int, phobert int, simcse int, bgem3 int")
    votes = {c: F.col(c) for c in df.columns}
    assert [r[0] for r in df.select(vt.plurality(votes)).collect()] == [0, 1, None, 2, 1]
    assert [r[0] for r in df.select(vt.completeness(votes)).collect()] == ["complete", "partial", "failed", "partial", "partial"]


def test_consensus(spark):
    df = spark.createDataFrame([("1.0", "1"), ("", ""), ("0", "1"), (None, "1")], "a string, b string")
    got = [(r["is_human"], r["label"]) for r in vt.consensus(df, "a", "b").collect()]
    assert got == [(False, "1"), (True, ""), (True, ""), (True, "")]
