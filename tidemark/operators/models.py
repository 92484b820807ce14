"""Classifiers on embeddings and on text with Spark ML."""

from __future__ import annotations

import io
from collections.abc import Sequence

import numpy as np
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import CountVectorizer, HashingTF
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import words
from tidemark.operators.evaluation import class_weights, confusion_matrix, metrics, prediction_columns
from tidemark.session import file_system, written


def weighted(df: DataFrame, label: str, classes: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """Add the balanced class weight of each row (a table of one row per class)."""
    weights = class_weights(df, label, classes).select(F.col("label_id").alias(label), "weight")
    return df.join(F.broadcast(weights), label)


def with_features(df: DataFrame, vector: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))


def fit_linear(train: DataFrame, vector: str, label: str, classes: Sequence[int] = (0, 1, 2),
               max_iter: int = 100, c: float = 1.0, balanced: bool = True) -> Model:
    """Multinomial logistic regression with an L2 penalty of ``1 / (C * rows)``."""
    data = weighted(train, label, classes) if balanced else train.withColumn("weight", F.lit(1.0))
    featured = with_features(data, vector)
    rows = max(1, train.count())
    model = LogisticRegression(family="multinomial", labelCol=label, weightCol="weight", maxIter=max_iter,
                               regParam=1.0 / (c * rows), probabilityCol="_probability", predictionCol="_prediction",
                               rawPredictionCol="_raw")
    return model.fit(featured)


def fit_network(train: DataFrame, vector: str, label: str, width: int, classes: int = 3, hidden: int = 256,
                max_iter: int = 100, seed: int = 42) -> Model:
    """Perceptron with one hidden layer."""
    network = MultilayerPerceptronClassifier(
        layers=[width, hidden, classes], labelCol=label, maxIter=max_iter, seed=seed, probabilityCol="_probability",
        predictionCol="_prediction", rawPredictionCol="_raw", blockSize=128)
    return network.fit(with_features(train, vector))


def fit_text(train: DataFrame, text: str, label: str, max_vocab: int = 30000, min_count: int = 2,
             hashed_features: int | None = None, max_iter: int = 50) -> PipelineModel:
    """Bag of words and logistic regression; hashing instead of a vocabulary if asked."""
    tokens = train.withColumn("_tokens", words(F.col(text)))
    counts = (HashingTF(inputCol="_tokens", outputCol="features", numFeatures=hashed_features) if hashed_features
              else CountVectorizer(inputCol="_tokens", outputCol="features", vocabSize=max_vocab, minTF=1.0, minDF=min_count))
    head = LogisticRegression(family="multinomial", labelCol=label, maxIter=max_iter, regParam=1e-3,
                              probabilityCol="_probability", predictionCol="_prediction", rawPredictionCol="_raw")
    return Pipeline(stages=[counts, head]).fit(tokens)


def select_text(train: DataFrame, val: DataFrame, text: str, label: str, penalties: Sequence[float] = (1e-4, 1e-3, 1e-2, 1e-1),
                classes: Sequence[int] = (0, 1, 2), max_vocab: int = 30000, min_count: int = 2, max_iter: int = 50) -> tuple[PipelineModel, DataFrame]:
    """The text classifier whose penalty has the best weighted F1 on the validation split, and ``reg_param, f1, chosen`` of all.

    The vocabulary is counted once on the training split, and both splits are
    turned into vectors once. Classes are balanced by weights; ties go to the
    smaller penalty. An empty validation split is an error.
    """
    tokens = lambda df: df.withColumn("_tokens", words(F.col(text)))
    counts = CountVectorizer(inputCol="_tokens", outputCol="features", vocabSize=max_vocab, minTF=1.0, minDF=min_count).fit(tokens(train))
    fitting = written(counts.transform(tokens(weighted(train, label, classes))).select(label, "weight", "features"), "text-train")
    judging = written(counts.transform(tokens(val)).select(label, "features"), "text-val")
    if judging.isEmpty():
        raise ValueError("the validation split is empty")
    judge = MulticlassClassificationEvaluator(labelCol=label, predictionCol="_prediction", metricName="f1")
    tried = []
    for penalty in sorted(penalties):
        head = LogisticRegression(family="multinomial", labelCol=label, weightCol="weight", maxIter=max_iter, regParam=penalty,
                                  probabilityCol="_probability", predictionCol="_prediction", rawPredictionCol="_raw").fit(fitting)
        tried.append((judge.evaluate(head.transform(judging)), penalty, head))
    best = max(tried, key=lambda r: (r[0], -r[1]))
    table = train.sparkSession.createDataFrame([(p, f1, p == best[1]) for f1, p, _ in tried], "reg_param double, f1 double, chosen boolean")
    return PipelineModel([counts, best[2]]), table


def predict(model: Model, df: DataFrame, names: dict[int, str], vector: str | None = None,
            text: str | None = None) -> DataFrame:
    """Input rows with predicted id, name and class probabilities."""
    ready = with_features(df, vector) if vector else df.withColumn("_tokens", words(F.col(text)))
    scored = model.transform(ready).withColumn("probabilities", vector_to_array("_probability"))
    kept = scored.select(*df.columns, "probabilities")
    return prediction_columns(kept, "probabilities", names)


def evaluate(predictions: DataFrame, label: str, by: Sequence[str] = (), classes: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """Accuracy and averaged figures of a prediction table."""
    return metrics(confusion_matrix(predictions, label, "pred_label_id", by, classes), by)


def score_foreign(df: DataFrame, vector: str, make_predict, width: int, classes: int, batch: int = 32,
                  names: dict[int, str] | None = None) -> DataFrame:
    """Scores from any batch prediction function, loaded once per Python worker."""
    from pyspark.sql.types import ArrayType, DoubleType

    scorer = predict_batch_udf(make_predict, return_type=ArrayType(DoubleType()), batch_size=batch, input_tensor_shapes=[[width]])
    scored = df.withColumn("probabilities", scorer(F.col(vector).cast("array<double>")))
    return prediction_columns(scored, "probabilities", names or {i: str(i) for i in range(classes)})


def load_and_score(path: str, df: DataFrame, names: dict[int, str], vector: str | None = None,
                   text: str | None = None) -> DataFrame:
    """Batch scoring with a saved pipeline."""
    return predict(PipelineModel.load(path), df, names, vector, text)


def save_network(path: str, hidden: np.ndarray, out: np.ndarray) -> None:
    """Weights of a network with one rectified hidden layer as one file that all workers can open."""
    system, place = file_system(path)
    packed = io.BytesIO()
    np.savez(packed, hidden=hidden, out=out)
    with system.open_output_stream(place) as sink:
        sink.write(packed.getvalue())


def network_from_file(path: str):
    """For ``score_foreign``: the file is read once by each Python worker."""

    def make_predict():
        system, place = file_system(path)
        with system.open_input_file(place) as source:
            weights = np.load(io.BytesIO(source.readall()))
            hidden, out = weights["hidden"], weights["out"]

        def run(batch: np.ndarray) -> np.ndarray:
            scores = np.maximum(batch @ hidden, 0.0) @ out
            raised = np.exp(scores - scores.max(axis=1, keepdims=True))
            return raised / raised.sum(axis=1, keepdims=True)

        return run

    return make_predict
