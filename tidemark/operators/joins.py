"""Joins of annotator tables, parents and children, dictionaries and stores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.labels import class_code
from tidemark.functions.parse import clean_id, text_key
from tidemark.functions.text import is_blank
from tidemark.operators.ranking import numbered, occurrence

KEY_NAMES = ("id", "comment_id", "post_id")


# --- guards ---------------------------------------------------------------------

def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).count().filter(F.col("count") > 1)


def unique_keys(df: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """``df``, whose evaluation fails if a key (null is one too) comes twice.

    No job is run here: the keys alone are counted beside the rows, and the
    (usually empty) table of repeated ones is joined back.
    """
    marks = [f"_twice_{i}" for i in range(len(keys))]
    twice = duplicate_keys(df, keys).select(*[F.col(f"`{k}`").alias(m) for k, m in zip(keys, marks)], "count")
    same = reduce(lambda a, b: a & b, [df[f"`{k}`"].eqNullSafe(twice[m]) for k, m in zip(keys, marks)])
    fault = F.raise_error(F.concat(F.lit(f"{what} has duplicate keys {list(keys)}: "), F.to_json(F.struct(*marks))))
    checked = df.join(twice.withColumnRenamed("count", "_times"), same, "left")
    return checked.filter(F.when(F.col("_times").isNotNull(), fault.cast("boolean")).otherwise(F.lit(True))).select(*[df[f"`{c}`"] for c in df.columns])


def require_matched(merged: DataFrame, side: str = "side") -> DataFrame:
    """``merged`` itself, or an error with the number of unmatched rows per side."""
    counts = {r[side]: r["count"] for r in merged.filter(F.col(side) != "both").groupBy(side).count().collect()}
    if counts:
        raise ValueError(f"Keys differ between the tables: {counts}")
    return merged


# --- one-to-one merges ------------------------------------------------------------

def outer_merge(left: DataFrame, right: DataFrame, on: Sequence[str],
                suffixes: tuple[str, str] = ("_left", "_right"), side: str = "side") -> DataFrame:
    """One-to-one full outer merge with a side column: ``both``, ``left_only`` or ``right_only``.

    Columns of the same name keep both versions under the suffixes. A key that
    comes twice on a side is an error.
    """
    left, right = unique_keys(left, on, "left table"), unique_keys(right, on, "right table")
    shared = [c for c in left.columns if c in right.columns and c not in on]
    name = lambda c, s: c + s if c in shared else c
    a = left.select(*on, *[F.col(f"`{c}`").alias(name(c, suffixes[0])) for c in left.columns if c not in on],
                    F.lit(True).alias("_l"))
    b = right.select(*on, *[F.col(f"`{c}`").alias(name(c, suffixes[1])) for c in right.columns if c not in on],
                     F.lit(True).alias("_r"))
    where = (F.when(F.col("_l").isNull(), "right_only").when(F.col("_r").isNull(), "left_only").otherwise("both"))
    return a.join(b, list(on), "full_outer").withColumn(side, where).drop("_l", "_r")


def combine_first(df: DataFrame, name: str, sources: Sequence[str]) -> DataFrame:
    """First non-null of the sources under one name; the sources go."""
    return df.withColumn(name, F.coalesce(*[F.col(f"`{s}`") for s in sources])).drop(
        *[s for s in sources if s != name])


def content_mismatches(merged: DataFrame, a: str, b: str, side: str = "side") -> DataFrame:
    """One row: matched rows whose two texts differ (null counts as empty)."""
    differ = F.coalesce(F.col(a), F.lit("")) != F.coalesce(F.col(b), F.lit(""))
    return merged.agg(F.count_if((F.col(side) == "both") & differ).alias("mismatches"))


def status_merge(training: DataFrame, answers: DataFrame, keys: Sequence[str] = ("data_type", "id"),
                 names: tuple[str, str, str] = ("both_input_files", "only_training_file", "only_llm_file"),
                 ) -> DataFrame:
    """Outer merge on type and id with a named ``merge_status``."""
    merged = outer_merge(training, answers, keys, side="_side")
    status = F.when(F.col("_side") == "both", names[0]).when(
        F.col("_side") == "left_only", names[1]).otherwise(names[2])
    return merged.withColumn("merge_status", status).drop("_side")


def merge_keys(a: DataFrame, b: DataFrame, key: str = "id", text: str = "content_anonymized") -> list[str]:
    """Id and text when both tables have the text, else the id."""
    if key not in a.columns or key not in b.columns:
        raise ValueError(f"Both tables need a column {key!r}.")
    return [key, text] if text in a.columns and text in b.columns else [key]


MODEL_FIELDS = {"label": "sentiment_label", "score": "sentiment_score",
                "raw_label": "sentiment_raw_label", "raw_scores": "sentiment_raw_scores"}


def model_side(df: DataFrame, model: str, keys: Sequence[str], metadata: Sequence[str]) -> DataFrame:
    """Keys, metadata suffixed by the model and the model's prefixed outputs."""
    out = [F.col(k) for k in keys]
    out += [F.col(c).alias(f"{c}__{model}") for c in metadata if c in df.columns]
    for short, column in MODEL_FIELDS.items():
        value = F.col(column) if column in df.columns else F.lit(None).cast("string")
        out.append((class_code(value) if short == "label" else value).alias(f"{model}_{short}"))
    return df.select(*out)


def model_merge(a: DataFrame, b: DataFrame, names: tuple[str, str], data_type: str,
                metadata: Sequence[str] = ()) -> DataFrame:
    """One-to-one outer merge of two models' outputs with agreement flag and merge status."""
    keys = merge_keys(a, b)
    a, b = (unique_keys(df, keys, name) for df, name in zip((a, b), names))
    meta = [c for c in metadata if c not in keys and (c in a.columns or c in b.columns)]
    sides = [model_side(df, n, keys, meta) for df, n in zip((a, b), names)]
    merged = sides[0].join(sides[1], keys, "full_outer")
    for column in meta:
        merged = combine_first(merged, column, [f"{column}__{n}" for n in names if f"{column}__{n}" in merged.columns])
    out = merged.withColumns({
        "data_type": F.lit(data_type),
        "record_key": F.concat(F.lit(data_type + ":"), F.col("id").cast("string")),
    })
    return with_model_status(out, *names)


def with_model_status(df: DataFrame, x: str, y: str) -> DataFrame:
    """``models_agree`` (null unless both labelled) and ``merge_status``."""
    has_x, has_y = ~is_blank(F.col(f"{x}_label")), ~is_blank(F.col(f"{y}_label"))
    status = (F.when(has_x & has_y, "both_models").when(has_x, f"only_{x}")
              .when(has_y, f"only_{y}").otherwise("no_label"))
    agree = F.when(has_x & has_y, F.col(f"{x}_label") == F.col(f"{y}_label"))
    return df.withColumns({"models_agree": agree, "merge_status": status})


# --- filling and alignment ----------------------------------------------------------

def fill_missing(target: DataFrame, source: DataFrame, key: str, column: str) -> DataFrame:
    """Overwrite blank values of ``column`` from the source row with the same key.

    Adds ``was_filled``; a key that comes twice in the source is an error.
    """
    values = unique_keys(source.select(F.col(key), F.col(column).alias("_new")), [key], "source")
    fill = is_blank(F.col(column)) & ~is_blank(F.col("_new"))
    joined = target.join(values, key, "left")
    return joined.select(
        *[F.when(fill, F.col("_new")).otherwise(F.col(c)).alias(c) if c == column else F.col(c)
          for c in target.columns],
        fill.alias("was_filled"))


def fill_report(filled: DataFrame, column: str) -> DataFrame:
    return filled.agg(
        F.count("*").alias("target_rows"), F.count_if("was_filled").alias("filled_rows"),
        F.count_if(is_blank(F.col(column))).alias("remaining_rows"))


def shared_key(a: DataFrame, b: DataFrame, names: Sequence[str] = KEY_NAMES) -> str | None:
    return next((n for n in names if n in a.columns and n in b.columns), None)


def inner_on_shared_key(a: DataFrame, b: DataFrame, label: str) -> DataFrame:
    """Inner join of two label tables on the first shared key, unique in both: key, label_a, label_b."""
    key = shared_key(a, b)
    if key is None:
        raise ValueError(f"No shared key among {KEY_NAMES}")
    side = lambda df, n: unique_keys(df.select(F.col(key).alias("key"), F.col(label).alias(n)), ["key"], n)
    return side(a, "label_a").join(side(b, "label_b"), "key")


def occurrence_join(left: DataFrame, right: DataFrame, key: str, left_order: str, right_order: str,
                    how: str = "left") -> DataFrame:
    """The nth row of a key on the left meets the nth row of that key on the right."""
    a = occurrence(left, key, left_order)
    b = occurrence(right, key, right_order)
    return a.join(b, [key, "occurrence"], how)


def positional_join(left: DataFrame, right: DataFrame, left_order: str, right_order: str, strict: bool = False) -> DataFrame:
    """Row n of the left meets row n of the right; unequal lengths give null sides, or with ``strict`` an error."""
    if strict and (sizes := (left.count(), right.count()))[0] != sizes[1]:
        raise ValueError(f"Tables without a shared key need equal lengths; got {sizes[0]} and {sizes[1]} rows")
    a = numbered(left, left_order, name="position")
    b = numbered(right, right_order, name="position")
    return a.join(b, "position", "full_outer")


def ids_in_same_order(left: DataFrame, right: DataFrame, key: str, left_order: str, right_order: str) -> bool:
    """Whether both tables hold the same keys in the same order."""
    a, b = left.select(F.col(key).alias("_a"), left_order), right.select(F.col(key).alias("_b"), F.col(right_order).alias("_ro"))
    both = positional_join(a, b, left_order, "_ro")
    return both.filter(~F.col("_a").eqNullSafe(F.col("_b"))).limit(1).count() == 0


def align_answers(training: DataFrame, answers: DataFrame, key: str = "id", order: str = "row_order") -> DataFrame:
    """Give answers the ``data_type`` of the training row they belong to.

    Kept if the answers have one; else by row order when the ids match in order;
    else by occurrence of the id. ``key_alignment`` says which way was taken.
    """
    if "data_type" in answers.columns:
        return answers.withColumn("key_alignment", F.lit("llm_file_had_data_type"))
    train = training.select(clean_id(F.col(key)).alias(key), F.col(order).alias("_order"), "data_type")
    named = answers.withColumn(key, clean_id(F.col(key)))
    if ids_in_same_order(train, named, key, "_order", order):
        joined = positional_join(named, train.drop(key), order, "_order").drop("position")
        how = "copied_data_type_from_training_row_order"
    else:
        joined = occurrence_join(named, train, key, order, "_order").drop("occurrence")
        how = "copied_data_type_from_training_id_occurrence"
    return joined.drop("_order").withColumn("key_alignment", F.lit(how))


# --- parents and children --------------------------------------------------------------

def gather_children(children: DataFrame, parent: str, order: str, fields: Sequence[str],
                    name: str = "children", chunk: int = 1000) -> DataFrame:
    """Children of each parent as ordered arrays of at most ``chunk`` entries.

    A parent with more children gives several rows, numbered by ``part`` from
    zero, so one very popular parent never becomes one oversized value.
    """
    placed = numbered(children, order, [parent], "_n").withColumn("part", F.floor((F.col("_n") - 1) / chunk))
    entries = F.sort_array(F.collect_list(F.struct("_n", *fields)))
    grouped = placed.groupBy(parent, "part").agg(entries.alias("_e"))
    return grouped.select(parent, "part", F.transform(
        "_e", lambda e: F.struct(*[e[f].alias(f) for f in fields])).alias(name))


def children_of(parents: DataFrame, children: DataFrame, key: str, parent: str, order: str,
                fields: Sequence[str], name: str = "children", chunk: int = 1000) -> DataFrame:
    """Selected parents with their children; parents without any get an empty array."""
    mine = children.join(parents.select(F.col(key).alias(parent)).distinct(), parent, "left_semi")
    packed = gather_children(mine, parent, order, fields, name, chunk).withColumnRenamed(parent, key)
    joined = parents.join(packed, key, "left")
    empty = F.array().cast(packed.schema[name].dataType)
    return joined.withColumns({name: F.coalesce(F.col(name), empty), "part": F.coalesce("part", F.lit(0))})


def item_detail(items: DataFrame, comments: DataFrame, results: DataFrame, key: str = "id",
                parent: str = "news_item_id", chunk: int = 1000) -> DataFrame:
    """Items with their comments and analysis results, two array columns side by side."""
    selected = items.select(F.col(key).alias(parent))
    pick = lambda df: df.join(selected, parent, "left_semi")
    notes = gather_children(pick(comments), parent, "id", ["id", "content"], "comments", chunk)
    found = gather_children(pick(results), parent, "id", ["id", "category", "sentiment_code"], "ai_results", chunk)
    packed = notes.join(found, [parent, "part"], "full_outer").withColumnRenamed(parent, key)
    return items.join(packed, key, "left").withColumn("part", F.coalesce("part", F.lit(0)))


# --- dictionaries and stores -------------------------------------------------------------

def map_labels(df: DataFrame, column: str, rules: DataFrame, key: Column, rule_key: str,
               fields: Mapping[str, str], unknown: Mapping[str, Column] | None = None) -> DataFrame:
    """Look up ``fields`` of a small rule table; an unknown value is an error, or gets the fields of ``unknown``."""
    small = rules.select(F.col(rule_key).alias("_rk"), *[F.col(s).alias(t) for s, t in fields.items()])
    joined = df.withColumn("_k", key).join(F.broadcast(small), F.col("_k") == F.col("_rk"), "left")
    message = F.concat(F.lit("Unknown value: "), F.coalesce(F.col(column).cast("string"), F.lit("null")))
    checked = {t: F.when(F.col("_rk").isNull(), unknown[t] if unknown else F.raise_error(message)).otherwise(F.col(t)) for t in fields.values()}
    return joined.withColumns(checked).drop("_k", "_rk")


def not_yet_stored(incoming: DataFrame, store: DataFrame, text: str = "content") -> DataFrame:
    """Rows whose normalised text is not in the store; only hashes of the texts are shuffled."""
    key = F.sha2(text_key(F.col(text)), 256)
    known = store.select(key.alias("_known")).distinct()
    return incoming.withColumn("_key", key).join(known, F.col("_key") == F.col("_known"), "left_anti").drop("_key")
