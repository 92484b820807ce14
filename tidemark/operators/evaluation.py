"""Classifier evaluation from a count matrix, and training-log tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLASSES = (0, 1, 2)


def confusion_matrix(df: DataFrame, true: str, pred: str, by: Sequence[str] = (),
                     classes: Sequence[int] = CLASSES) -> DataFrame:
    """``true_id, pred_id, n`` for every pair of classes, zeros included."""
    inside = df.filter(F.col(true).isin(*classes) & F.col(pred).isin(*classes))
    counts = inside.groupBy(*by).agg(*[
        F.count_if((F.col(true) == t) & (F.col(pred) == p)).alias(f"_{t}_{p}") for t in classes for p in classes])
    entries = F.array(*[
        F.struct(F.lit(t).alias("true_id"), F.lit(p).alias("pred_id"), F.col(f"_{t}_{p}").alias("n"))
        for t in classes for p in classes])
    return counts.select(*by, F.explode(entries).alias("c")).select(*by, "c.true_id", "c.pred_id", "c.n")


def confusion_table(cells: DataFrame, names: dict[int, str], by: Sequence[str] = ()) -> DataFrame:
    """Wide form: one row per true class, one ``pred_<name>`` column per class."""
    label = F.create_map(*[F.lit(x) for k, v in names.items() for x in (k, v)])
    wide = [F.sum(F.when(F.col("pred_id") == i, F.col("n")).otherwise(0)).alias(f"pred_{name}")
            for i, name in names.items()]
    return cells.groupBy(*by, F.concat(F.lit("true_"), label[F.col("true_id")]).alias("true_label")).agg(*wide)


def normalized_confusion(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of each row of the matrix; an empty row gives zeros."""
    totals = cells.groupBy(*by, "true_id").agg(F.sum("n").alias("_total"))
    joined = cells.join(totals, [*by, "true_id"])
    return joined.withColumn("share", F.col("n") / F.greatest(F.col("_total"), F.lit(1))).drop("_total")


def class_report(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class; a zero divisor gives zero."""
    sides = F.explode(F.array(
        F.struct(F.col("true_id").alias("class_id"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("guessed"),
                 F.when(F.col("true_id") == F.col("pred_id"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("pred_id").alias("class_id"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("guessed"),
                 F.lit(0).cast("bigint").alias("hit"))))
    per = (cells.select(*by, sides.alias("s")).groupBy(*by, F.col("s.class_id").alias("class_id"))
           .agg(*[F.sum(f"s.{c}").alias(c) for c in ("support", "guessed", "hit")]))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    hit = F.col("hit").cast("double")
    per = per.withColumns({"precision": safe(hit, F.col("guessed")), "recall": safe(hit, F.col("support"))})
    total = F.col("precision") + F.col("recall")
    return per.withColumn("f1", safe(2.0 * F.col("precision") * F.col("recall"), total))


def metrics(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy and macro and weighted averages.

    Macro averages run over the classes that occur as a true or predicted label.
    """
    per = class_report(cells, by).filter((F.col("support") > 0) | (F.col("guessed") > 0))
    rows = F.sum("support")
    figures = ("precision", "recall", "f1")
    return per.groupBy(*by).agg(
        (F.sum("hit") / rows).alias("accuracy"),
        *[F.avg(c).alias(f"{c}_macro") for c in figures],
        *[(F.sum(F.col(c) * F.col("support")) / rows).alias(f"{c}_weighted") for c in figures])


def full_report(cells: DataFrame, names: dict[int, str], by: Sequence[str] = ()) -> DataFrame:
    """Class rows, then ``accuracy``, ``macro avg`` and ``weighted avg`` rows."""
    per = class_report(cells, by)
    label = F.create_map(*[F.lit(x) for k, v in names.items() for x in (k, v)])
    cols = ["precision", "recall", "f1", "support"]
    classes = per.select(*by, label[F.col("class_id")].alias("label"), *cols)
    rows = F.sum("support")
    summary = per.groupBy(*by).agg(rows.alias("support"), (F.sum("hit") / rows).alias("accuracy"), *[
        x for c in cols[:3] for x in (F.avg(c).alias("m_" + c), (F.sum(F.col(c) * F.col("support")) / rows).alias("w_" + c))])
    line = lambda name, p, r, f: F.struct(F.lit(name).alias("label"), F.col(p).alias("precision"),
                                          F.col(r).alias("recall"), F.col(f).alias("f1"), "support")
    averages = summary.select(*by, F.explode(F.array(
        line("accuracy", *["accuracy"] * 3),
        line("macro avg", "m_precision", "m_recall", "m_f1"),
        line("weighted avg", "w_precision", "w_recall", "w_f1"))).alias("s")).select(*by, "s.*")
    return classes.unionByName(averages)


def log_loss(df: DataFrame, probabilities: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean negative log of the true class's share; shares are clipped away from 0 and 1."""
    tiny = 2.220446049250313e-16
    p = F.element_at(F.col(probabilities), F.col(label).cast("int") + 1).cast("double")
    mean = F.avg(-F.log(F.least(F.greatest(p, F.lit(tiny)), F.lit(1 - tiny))))
    return df.groupBy(*by).agg(mean.alias("log_loss"))


def class_weights(df: DataFrame, label: str, classes: Sequence[int] = CLASSES) -> DataFrame:
    """Balanced weight ``rows / (classes * count)`` per class."""
    counts = df.agg(F.count("*").alias("_rows"), *[F.count_if(F.col(label) == c).alias(f"_{c}") for c in classes])
    entry = lambda c: F.struct(F.lit(c).alias("label_id"), F.col(f"_{c}").alias("n"),
                               (F.col("_rows") / (len(classes) * F.greatest(F.col(f"_{c}"), F.lit(1)))).alias("weight"))
    return counts.select(F.explode(F.array(*[entry(c) for c in classes])).alias("e")).select("e.*")


def epoch_losses(logs: DataFrame, run: Sequence[str] = ()) -> DataFrame:
    """Mean training and validation loss per epoch (rounded up), gaps kept.

    A run without step losses falls back to its last ``train_loss`` per epoch.
    Columns read: ``step, epoch, loss, train_loss, eval_loss``.
    """
    epoch = F.greatest(F.lit(1), F.ceil(F.col("epoch") - 1e-8)).cast("int")
    seen = logs.filter(F.col("epoch") > 0).withColumn("_e", epoch)
    per = seen.groupBy(*run, "_e").agg(
        F.avg("loss").alias("_loss"), F.max_by("train_loss", F.when(F.col("train_loss").isNotNull(), F.col("step"))).alias("_last"),
        F.avg("eval_loss").alias("val_loss"))
    have = per.groupBy(*run).agg(
        F.max("_e").alias("_max"), F.count("_loss").alias("_steps"),
        (F.count("_loss") + F.count("_last") + F.count("val_loss")).alias("_any"))
    scaffold = have.filter(F.col("_any") > 0).select(
        *run, "_steps", F.explode(F.sequence(F.lit(1), F.col("_max"))).alias("epoch"))
    joined = scaffold.join(per.withColumnRenamed("_e", "epoch"), [*run, "epoch"], "left")
    train = F.when(F.col("_steps") > 0, F.col("_loss")).otherwise(F.col("_last"))
    return joined.select(*run, "epoch", train.alias("train_loss"), "val_loss")


def loss_curve(history: DataFrame, classes: int = 3, columns: Sequence[str] = ("train_loss", "val_loss")) -> DataFrame:
    """Raw losses and losses divided by the log of the number of classes."""
    scale = math.log(max(2, classes))
    out = history
    for c in columns:
        out = out.withColumn(f"raw_{c}", F.col(c)).withColumn(c, F.col(c) / scale)
    return out


def prefixed(df: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    """Metric columns renamed to ``<prefix>_<name>``."""
    return df.select(*keep, *[F.col(c).alias(f"{prefix}_{c}") for c in df.columns if c not in keep])


def prediction_columns(df: DataFrame, probabilities: str, names: dict[int, str]) -> DataFrame:
    """Predicted id, name and one ``prob_<name>`` column per class."""
    from tidemark.functions.vectors import argmax

    label = F.create_map(*[F.lit(x) for k, v in names.items() for x in (k, v)])
    with_id = df.withColumn("pred_label_id", argmax(F.col(probabilities)))
    return with_id.withColumns({
        "pred_label_name": F.try_element_at(label, F.col("pred_label_id")),
        **{f"prob_{n}": F.element_at(F.col(probabilities), i + 1) for i, n in names.items()}})
