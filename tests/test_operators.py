"""Guards, skewed keys, splits and invariants."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import aggregates as agg
from tidemark.operators import columns as cols
from tidemark.operators import joins as jn
from tidemark.operators import ranking as rk
from tidemark.operators import splits as sp
from tidemark.operators import upsert as up
from tidemark.sources import writers as wr
from tidemark.streaming import ingest as st


def test_numbering_with_a_hot_key_and_small_buckets(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 40).alias("k"))
    got = rk.numbered(rows, "id", ["k"], bits=6).collect()
    seen: dict = {}
    for r in sorted(got, key=lambda r: r["id"]):
        seen[r["k"]] = seen.get(r["k"], 0) + 1
        assert r["row_no"] == seen[r["k"]]
    assert len(got) == 5000
    assert [r["row_no"] for r in sorted(rk.numbered(rows, "id", bits=4).collect())] == list(range(1, 5001))


def test_running_values_over_sparse_orders(spark, monkeypatch):
    monkeypatch.setattr(rk, "TOP_BITS", 3)
    rows = spark.range(400).select((F.col("id") * F.col("id") * 977).alias("at"), (F.col("id") % 3).alias("k"), (F.col("id") % 11).alias("v"))
    got = rk.prefix_scan(rows, ["k"], ["at"], F.shiftright("at", 8), {"total": F.col("v")}, {"top": F.col("v")}).collect()
    assert len(got) == 400
    state: dict = {}
    for r in sorted(got, key=lambda r: r["at"]):
        total, top = state.get(r["k"], (0, 0))
        state[r["k"]] = (total + r["v"], max(top, r["v"]))
        assert (r["total"], r["top"]) == state[r["k"]]


def test_hot_key_is_split_before_the_window(spark):
    plan = rk.numbered(spark.range(10).withColumn("k", F.lit(1)), "id", ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_group" in plan and "SinglePartition" not in plan


def test_split_sizes_are_exact_and_disjoint(spark):
    rows = spark.range(3000).select("id", (F.col("id") % 3).cast("int").alias("label_id"), F.when(F.col("id") < 2000, "big").otherwise("small").alias("data_types"))
    split = sp.stratified_split(rows, "id", "label_data_type")
    assert split.count() == 3000 and split.select("id").distinct().count() == 3000
    again = sp.stratified_split(rows.repartition(7), "id", "label_data_type")
    assert split.select("id", "split").exceptAll(again.select("id", "split")).count() == 0
    for r in split.groupBy("label_id", "data_types").pivot("split", ["train", "val", "test"]).count().collect():
        n = r["train"] + r["val"] + r["test"]
        assert abs(r["train"] - 0.7 * n) <= 1 and abs(r["val"] - 0.15 * n) <= 1


def test_split_errors(spark):
    one = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "id long, label_id int")
    with pytest.raises(ValueError, match="fewer than 2"):
        sp.stratified_split(one, "id", "label")
    with pytest.raises(ValueError):
        sp.stratified_split(one, "id", "label", 0.6, 0.6)
    with pytest.raises(ValueError, match="Missing labels"):
        sp.require_classes(one)


def test_small_rest_uses_the_label_for_the_second_cut(spark):
    rows = spark.range(80).select("id", F.lit(0).alias("label_id"), (F.col("id") % 20).cast("string").alias("data_types"))
    split = sp.stratified_split(rows, "id", "label_data_type", 0.15, 0.15)
    counts = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    assert counts == {"train": 60, "val": 10, "test": 10}


def test_saved_splits_contract(spark, tmp_path):
    rows = spark.range(100).select("id", (F.col("id") % 3).cast("int").alias("label_id"))
    make = lambda: sp.stratified_split(rows, "id", "label")
    folder = str(tmp_path / "s")
    assert wr.saved_or_new_splits(spark, folder, make, "label").count() == 100
    with pytest.raises(ValueError, match="built with"):
        wr.saved_or_new_splits(spark, folder, make, "label_data_type")
    (version,) = (tmp_path / "s").glob("version-*")
    (version / "val" / "_SUCCESS").unlink()
    with pytest.raises(ValueError, match="partial"):
        wr.saved_or_new_splits(spark, folder, make, "label")
    assert wr.saved_or_new_splits(spark, folder, make, "label", rebuild=True).count() == 100


@pytest.mark.parametrize("ends_at", range(1, 6))
def test_a_crash_leaves_the_old_splits_in_force(spark, tmp_path, monkeypatch, ends_at):
    from pyspark.sql.readwriter import DataFrameWriter

    split = lambda n: spark.range(n).select("id", F.element_at(F.array(*map(F.lit, wr.SPLITS)), (F.col("id") % 3 + 1).cast("int")).alias("split"))
    folder, writes = str(tmp_path / "s"), []
    assert wr.saved_or_new_splits(spark, folder, lambda: split(90), "label").count() == 90

    def ends(plain):
        def write(self, path, *args, **kwargs):
            writes.append(path)
            if len(writes) == ends_at:
                raise RuntimeError("lost")
            return plain(self, path, *args, **kwargs)
        return write

    with monkeypatch.context() as m:
        m.setattr(DataFrameWriter, "parquet", ends(DataFrameWriter.parquet))
        m.setattr(DataFrameWriter, "text", ends(DataFrameWriter.text))
        with pytest.raises(RuntimeError, match="lost"):
            wr.saved_or_new_splits(spark, folder, lambda: split(30), "label", rebuild=True)
    assert wr.saved_or_new_splits(spark, folder, lambda: None, "label").count() == 90
    assert wr.saved_or_new_splits(spark, folder, lambda: split(30), "label", rebuild=True).count() == 30
    assert wr.saved_or_new_splits(spark, folder, lambda: None, "label").count() == 30


def test_streak_cut(spark):
    known = [1, 1, 0, 1, 1, 1, 1, 0, 1]
    rows = spark.createDataFrame([("s", i, bool(k)) for i, k in enumerate(known)], "src string, at long, known boolean")
    got = rk.duplicate_streaks(rows, ["src"], "at", F.col("known"), 3).orderBy("at").collect()
    assert [r["streak"] for r in got] == [1, 2, 0, 1, 2, 3]


def test_guards(spark):
    twice = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id long, v string")
    for broken in (jn.unique_keys(twice, ["id"], "table"), jn.outer_merge(twice, twice, ["id"]), jn.fill_missing(twice, twice, "id", "v"),
                   jn.inner_on_shared_key(twice, twice, "v"), up.upsert(twice.filter("id = 2"), twice, ["id"])):
        with pytest.raises(Exception, match="duplicate keys"):
            broken.collect()
    assert jn.unique_keys(twice.filter("v <> 'a'"), ["id"], "table").count() == 2
    with pytest.raises(ValueError, match="equal lengths"):
        jn.positional_join(twice, twice.limit(2), "id", "id", strict=True)
    left, right = twice.filter("id = 1").limit(1).select("id"), twice.filter("id = 2").select("id")
    with pytest.raises(ValueError, match="differ"):
        jn.require_matched(jn.outer_merge(left, right, ["id"]))
    with pytest.raises(ValueError):
        cols.first_column(twice, "zzz", [])
    with pytest.raises(ValueError):
        cols.require_columns(twice, ["zzz"], "table")
    with pytest.raises(ValueError):
        rk.chunked(twice, "id", 0)


def test_alignment_by_occurrence(spark):
    train = spark.createDataFrame([("1", 0, "post"), ("1", 1, "comment"), ("2", 2, "post")], "id string, row_order long, data_type string")
    answers = spark.createDataFrame([("2", 0, "x"), ("1.0", 1, "y"), ("1", 2, "z"), ("9", 3, "w")], "id string, row_order long, v string")
    got = {r["v"]: r["data_type"] for r in jn.align_answers(train, answers).collect()}
    assert got == {"x": "post", "y": "post", "z": "comment", "w": None}
    same = jn.align_answers(train, train.drop("data_type")).collect()
    assert {r["key_alignment"] for r in same} == {"copied_data_type_from_training_row_order"}


def test_children_of_a_hot_parent_come_in_parts(spark):
    notes = spark.range(2500).select(F.lit(1).cast("long").alias("post_id"), F.col("id").alias("comment_id"))
    posts = spark.createDataFrame([(1,), (2,)], "id long")
    got = jn.children_of(posts, notes, "id", "post_id", "comment_id", ["comment_id"]).orderBy("id", "part").collect()
    assert [(r["id"], r["part"], len(r["children"])) for r in got] == [(1, 0, 1000), (1, 1, 1000), (1, 2, 500), (2, 0, 0)]
    assert [c["comment_id"] for r in got for c in r["children"]] == list(range(2500))


def test_upsert_and_keep_first(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", None), ("c", 3)], "k string, v int")
    got = {r["k"]: (r["v"], r["action"]) for r in up.upsert(old, new, ["k"]).collect()}
    assert got == {"a": (1, "kept"), "b": (None, "updated"), "c": (3, "inserted")}
    rows = spark.createDataFrame([(3, "x" * 90 + "1"), (1, "x" * 90 + "2"), (2, "y")], "at int, t string")
    assert sorted(r["at"] for r in up.first_by_prefix(rows, "t", "at").collect()) == [1, 2]


def test_vocabulary_and_encoding(spark):
    texts = spark.createDataFrame([(0, "b a b"), (1, "a c c d"), (2, "")], "id long, t string")
    vocab = agg.vocabulary(texts, "t", "id", max_size=4, min_count=2)
    assert {r["token"]: r["id"] for r in vocab.collect()} == {"b": 2, "a": 3}
    got = {r["id"]: (r["ids"], r["length"]) for r in agg.encode(texts, "id", "t", vocab, 3).collect()}
    assert got == {0: ([2, 3, 2], 3), 1: ([3, 1, 1], 3), 2: ([1, 0, 0], 1)}


def test_schedules():
    assert st.parse_schedule("hours:4") == ("hours", "4")
    assert st.parse_schedule(" 21:15 ") == ("daily", "21:15")
    assert st.parse_schedule("") == ("daily", "22:00")
    assert st.trigger_of("hours:4") == {"processingTime": "4 hours"}
    now = datetime(2024, 1, 1, 22, 30)
    assert st.next_run("daily:22:00", now) == datetime(2024, 1, 2, 22, 0)
    assert st.next_run("hours:4", now) == datetime(2024, 1, 2, 2, 30)
    with pytest.raises(ValueError):
        st.next_run("daily:soon", now)


def test_text_classifier_is_selected_on_validation(spark):
    from tidemark.operators import models as md

    texts = ["tệ quá kém", "bình thường thôi", "tuyệt vời tốt"]
    rows = spark.createDataFrame([(i, f"{texts[i % 3]} w{i % 7}", i % 3) for i in range(90)], "id int, text string, y int")
    train, val = rows.filter("id % 4 <> 0"), rows.filter("id % 4 = 0")
    model, table = md.select_text(train, val, "text", "y", (100.0, 1e-3), max_iter=20)
    tried = {r["reg_param"]: (r["f1"], r["chosen"]) for r in table.collect()}
    assert set(tried) == {100.0, 1e-3} and tried[1e-3] == (1.0, True) and not tried[100.0][1]
    found = md.predict(model, val, {0: "a", 1: "b", 2: "c"}, text="text")
    assert found.filter("pred_label_id <> y").count() == 0
    with pytest.raises(ValueError):
        md.select_text(train, val.limit(0), "text", "y", (1e-3,), max_iter=2)


def test_row_numbers_carry_no_texts(spark):
    from tidemark.operators.columns import with_row_id

    rows = [(i, "b" if i % 3 else None, "x" * 10, " " if i % 2 else f"{i}.0") for i in range(0, 3_000_000, 100_000)]
    df = spark.createDataFrame(rows, "o long, sheet string, text string, id string")
    got = {r["o"]: (r["row_id"], r["text"]) for r in with_row_id(df, "id", "o", ["sheet"]).collect()}
    seen = {}
    for o, sheet, text, own in rows:
        seen[sheet] = seen.get(sheet, 0) + 1
        assert got.pop(o) == (own.removesuffix(".0") if own.strip() else str(seen[sheet]), text)
    assert not got
    plan = with_row_id(df, "id", "o", ["sheet"])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if " Window " in line or line.startswith("Window ")]
    assert windows and not any("text" in line for line in windows)
    assert all("text" not in line for line in plan[plan.index("Window "):].splitlines() if "LogicalRDD" not in line and "Project" in line)


def test_text_classifier_splits_once(spark, monkeypatch):
    from tidemark.plans import all_queries, learning
    from tidemark.plans.base import Tables

    names, keep = [], learning.written
    monkeypatch.setattr(learning, "written", lambda df, name: names.append(name) or keep(df, name))
    assert all_queries()["m8_text_classifier"].build(Tables(spark, "/root/testdata/sf0.001")).count() == 1
    assert names == ["split"]


def test_harmonize_is_strict_unless_told(spark):
    from tidemark.operators.harmonize import harmonize
    from tidemark.sources.dictionaries import emotion_rules

    rules = emotion_rules(spark)
    rows = lambda *r: {"a": spark.createDataFrame(r, "row_order long, id string, `my.note` string, content string, label string")}
    got = harmonize(rows((7, " ", "n", " b\u00a0", "1.0"), (7, None, "n", "c", "0"), (2, "k ", "n", "a", "2")), rules).collect()
    assert sorted((r["record_key"], r["content_anonymized"], r["emotion"]) for r in got if r["id"] == "k") == [("a:k", "a", "Positive")]
    assert sorted((r["id"], r["record_key"]) for r in got) == [("2", "a:2"), ("3", "a:3"), ("k", "a:k")]
    assert sorted(r["content_anonymized"] for r in got) == ["a", "b", "c"]
    for text, label, message in (("\u00a0", "1", "Blank content in a"), (None, "1", "Blank content in a"), ("a", "7", "Unknown value: 7"), ("a", None, "Unknown value: null")):
        with pytest.raises(Exception, match=message):
            harmonize(rows((1, "1", "n", text, label)), rules).collect()


def test_empty_results_of_the_chain(spark):
    from tidemark.functions.normalize import preprocess
    from tidemark.operators.aggregates import empty_results

    texts = ["", None, " \n", "https://abc.com", "#dntu", "É.", "😍", "12", "xD", "a"]
    done = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select(preprocess(F.col("t"), {}, ["dntu"]).alias("p"))
    assert [tuple(r) for r in empty_results(done, F.col("p") != "").collect()] == [(5, 10)]
    assert [tuple(r) for r in empty_results(done.limit(0), F.col("p") != "").collect()] == [(0, 0)]
