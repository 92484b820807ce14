"""Queries for tokens, vectors and classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions import vectors as vec
from tidemark.operators import aggregates as agg
from tidemark.operators import evaluation as ev
from tidemark.operators import models as md
from tidemark.operators import splits as sp
from tidemark.functions.lexicon import LABEL_NAMES_VI
from tidemark.plans.base import query
from tidemark.plans.relational import METRICS, VOCAB_SQL, metrics_sql
from tidemark.plans.text import squash_sql
from tidemark.session import scratch_path, written


@query("m1_words", f"""
SELECT doc_id, array_to_string(string_split({squash_sql('text')}, ' '), '|') AS tokens, CAST(len(string_split({squash_sql('text')}, ' ')) AS INT) AS n FROM {{social}}""")
def _(t):
    out = t.social.select("doc_id", tx.words(F.col("text")).alias("w"))
    return out.select("doc_id", F.array_join("w", "|").alias("tokens"), F.size("w").alias("n"))


@query("m1_words_and_marks", f"""
SELECT doc_id, array_to_string(regexp_extract_all(lower({squash_sql('text')}), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+|[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]'), '|') AS tokens FROM {{social}}""")
def _(t):
    return t.social.select("doc_id", F.array_join(tx.words_and_marks(F.col("text")), "|").alias("tokens"))


@query("m3_segmented_text", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'a_b' ELSE upper(source) END AS text FROM documents")
def _(t):
    stored = F.expr("CASE doc_id % 3 WHEN 0 THEN 'a_b' WHEN 1 THEN '  ' END")
    return t.documents.select("doc_id", tx.segmented(stored, F.col("source"), F.upper).alias("text"))


@query("l14_argmax", """
SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS best, round(list_max(embedding)::DOUBLE, 6) AS top FROM embeddings""")
def _(t):
    e = F.col("embedding")
    return t.embeddings.select("vec_id", vec.argmax(e).alias("best"), F.round(F.array_max(e).cast("double"), 6).alias("top"))


@query("l15_softmax", """
WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: exp(x::DOUBLE - list_max(embedding)::DOUBLE)) AS e FROM embeddings)
SELECT vec_id, array_to_string(list_transform(e, lambda x: CAST(CAST(round(x / list_sum(e) * 1e6) AS BIGINT) AS VARCHAR)), ',') AS p FROM s""")
def _(t):
    p = vec.softmax(F.col("embedding"))
    return t.embeddings.select("vec_id", F.array_join(F.transform(p, lambda x: F.round(x * 1e6).cast("bigint")), ",").alias("p"))


@query("l16_prediction_columns", """
WITH s AS (SELECT vec_id, list_transform(embedding[1:3], lambda x: exp(x::DOUBLE)) AS e FROM embeddings),
p AS (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS p FROM s)
SELECT vec_id, CAST(list_position(p, list_max(p)) - 1 AS INT) AS pred_label_id,
CASE list_position(p, list_max(p)) WHEN 1 THEN 'tieu_cuc' WHEN 2 THEN 'trung_lap' ELSE 'tich_cuc' END AS pred_label_name,
round(p[1], 6) AS prob_tieu_cuc, round(p[2], 6) AS prob_trung_lap, round(p[3], 6) AS prob_tich_cuc FROM p""")
def _(t):
    probs = t.embeddings.select("vec_id", vec.softmax(F.slice("embedding", 1, 3)).alias("p"))
    out = ev.prediction_columns(probs, "p", LABEL_NAMES_VI)
    return out.drop("p").withColumns({f"prob_{n}": F.round(f"prob_{n}", 6) for n in LABEL_NAMES_VI.values()})


@query("m4_unit_length", """
WITH n AS (SELECT vec_id, embedding AS e, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))) AS n FROM embeddings)
SELECT vec_id, array_to_string(list_transform(e, lambda x: CAST(CAST(round(x::DOUBLE / n * 1e6) AS BIGINT) AS VARCHAR)), ',') AS v FROM n""")
def _(t):
    v = vec.unit_length(F.col("embedding"))
    return t.embeddings.select("vec_id", F.array_join(F.transform(v, lambda x: F.round(x * 1e6).cast("bigint")), ",").alias("v"))


@query("m4_masked_mean", """
SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CAST(CAST(round(x::DOUBLE * CASE WHEN label % 2 = 0 THEN 1.5 ELSE 1 END * 1e6) AS BIGINT) AS VARCHAR)), ',') AS v FROM embeddings""")
def _(t):
    e = F.col("embedding").cast("array<double>")
    tokens = F.array(e, F.transform(e, lambda x: x * 2), F.transform(e, lambda x: x * 9))
    mask = F.array(F.lit(1), F.when(F.col("label") % 2 == 0, 1).otherwise(0), F.lit(0))
    v = vec.masked_mean(tokens, mask)
    return t.embeddings.select("vec_id", F.array_join(F.transform(v, lambda x: F.round(x * 1e6).cast("bigint")), ",").alias("v"))


@query("m5_feature_dropout", """
SELECT vec_id, array_to_string(list_transform(range(0, len(embedding)), lambda i: CASE WHEN
 CAST(concat('0x', substr(md5(concat('42:', vec_id, ':', i)), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE >= 0.3
 THEN CAST(CAST(round(embedding[i + 1]::DOUBLE / (1.0 - 0.3)::DOUBLE * 1e6) AS BIGINT) AS VARCHAR) ELSE '0' END), ',') AS v FROM embeddings""")
def _(t):
    v = vec.feature_dropout(F.col("embedding"), F.col("vec_id"), 0.3, 42)
    return t.embeddings.select("vec_id", F.array_join(F.transform(v, lambda x: F.round(x * 1e6).cast("bigint")), ",").alias("v"))


def _vectors(t):
    """Embeddings with a three-class label and a split."""
    data = t.embeddings.select("vec_id", "embedding", (F.col("label") % 3).cast("int").alias("label_id"))
    return sp.stratified_split(data, "vec_id", "label")


def _scored(t, model):
    data = _vectors(t).filter("split <> 'train'")
    scored = md.predict(model, data, LABEL_NAMES_VI, vector="embedding")
    return md.evaluate(scored, "label_id", ["split"])


@query("m6_linear_classifier")
def _(t):
    return _scored(t, md.fit_linear(_vectors(t).filter("split = 'train'"), "embedding", "label_id", max_iter=30))


@query("m7_network_classifier")
def _(t):
    width = 64
    model = md.fit_network(_vectors(t).filter("split = 'train'"), "embedding", "label_id", width, hidden=256, max_iter=15)
    return _scored(t, model)


@query("m8_text_classifier")
def _(t):
    texts = t.documents.select("doc_id", "text", F.expr("CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END").alias("label_id"))
    split = written(sp.stratified_split(texts, "doc_id", "label"), "split")  # the fit reads it several times
    model = md.fit_text(split.filter("split = 'train'"), "text", "label_id", max_vocab=5000, max_iter=10)
    scored = md.predict(model, split.filter("split = 'test'"), LABEL_NAMES_VI, text="text")
    return md.evaluate(scored, "label_id")


@query("m8_selected_text_classifier", """
SELECT count(*) AS documents, 3 AS tried, 1 AS chosen, true AS best_chosen, true AS beats_majority, true AS sums_to_one FROM documents""")
def _(t):
    """The penalty is selected on the validation split; what holds for any sound fit is compared."""
    texts = t.documents.select("doc_id", "text", F.expr("CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END").alias("label_id"))
    split = written(sp.stratified_split(texts, "doc_id", "label"), "split")
    model, table = md.select_text(split.filter("split = 'train'"), split.filter("split = 'val'"), "text", "label_id", (1e-3, 1e-1, 10.0), max_vocab=2000, max_iter=10)
    scored = md.predict(model, split, LABEL_NAMES_VI, text="text")
    right = F.avg(F.when(F.col("split") == "test", (F.col("pred_label_id") == F.col("label_id")).cast("int")))
    shares = F.greatest(*[F.avg(F.when(F.col("split") == "test", (F.col("label_id") == c).cast("int"))) for c in range(3)])
    total = F.aggregate("probabilities", F.lit(0.0), lambda x, y: x + y)
    held = scored.agg(F.count("*").alias("documents"), (right > shares).alias("beats_majority"), F.bool_and(F.abs(total - 1) < 1e-9).alias("sums_to_one"))
    tried = table.collect()  # one row a penalty
    best = max(r["f1"] for r in tried)
    return held.select("*", F.lit(len(tried)).alias("tried"), F.lit(sum(r["chosen"] for r in tried)).alias("chosen"),
                       F.lit(all(r["f1"] == best for r in tried if r["chosen"])).alias("best_chosen"))


@query("m9_test_predictions")
def _(t):
    data = _vectors(t)
    model = md.fit_linear(data.filter("split = 'train'"), "embedding", "label_id", max_iter=10)
    scored = md.predict(model, data.filter("split = 'test'"), LABEL_NAMES_VI, vector="embedding")
    return scored.select("vec_id", F.col("label_id").alias("true_label_id"), "pred_label_id", "pred_label_name",
                         *[f"prob_{n}" for n in LABEL_NAMES_VI.values()])


@query("m9_prefixed_metrics", "WITH " + metrics_sql("{predictions}", "true_id", "pred_id").replace(" AS accuracy", " AS val_accuracy")
       .replace(" AS precision_", " AS val_precision_").replace(" AS recall_", " AS val_recall_").replace(" AS f1_", " AS val_f1_"))
def _(t):
    out = ev.metrics(ev.confusion_matrix(t.predictions, "true_id", "pred_id"))
    return ev.prefixed(out, "val").select(*[F.round(f"val_{m}", 9).alias(f"val_{m}") for m in METRICS])


@query("m10_saved_model_scoring")
def _(t):
    from pyspark.ml import PipelineModel

    path = scratch_path(t.spark, "model")
    model = md.fit_linear(_vectors(t).filter("split = 'train'"), "embedding", "label_id", max_iter=10)
    PipelineModel([model]).write().overwrite().save(path)
    return md.load_and_score(path, t.embeddings, LABEL_NAMES_VI, vector="embedding").drop("embedding", "probabilities")


@query("m10_saved_equals_fitted", "SELECT count(*) AS rows, count(*) AS same, count(*) AS sums_to_one FROM embeddings")
def _(t):
    from pyspark.ml import PipelineModel

    path = scratch_path(t.spark, "model")
    model = md.fit_linear(_vectors(t).filter("split = 'train'"), "embedding", "label_id", max_iter=10)
    PipelineModel([model]).write().overwrite().save(path)
    fitted = md.predict(model, t.embeddings, LABEL_NAMES_VI, vector="embedding").select("vec_id", F.col("probabilities").alias("p"), F.col("pred_label_id").alias("a"))
    saved = md.load_and_score(path, t.embeddings, LABEL_NAMES_VI, vector="embedding").select("vec_id", F.col("probabilities").alias("q"), F.col("pred_label_id").alias("b"))
    near = F.forall(F.zip_with("p", "q", lambda x, y: F.abs(x - y) < 1e-9), lambda ok: ok) & (F.col("a") == F.col("b"))
    total = F.aggregate("p", F.lit(0.0), lambda x, y: x + y)
    return fitted.join(saved, "vec_id").agg(F.count("*").alias("rows"), F.count_if(near).alias("same"), F.count_if(F.abs(total - 1) < 1e-9).alias("sums_to_one"))


@query("m10_foreign_model_scoring", """
SELECT vec_id, CASE WHEN embedding[1] >= embedding[2] AND embedding[1] >= embedding[3] THEN 0
                    WHEN embedding[2] >= embedding[3] THEN 1 ELSE 2 END AS pred_label_id FROM embeddings""")
def _(t):
    def make_predict():
        import numpy as np

        def run(batch: np.ndarray) -> np.ndarray:
            raised = np.exp(batch[:, :3])
            return raised / raised.sum(axis=1, keepdims=True)

        return run

    return md.score_foreign(t.embeddings, "embedding", make_predict, 64, 3).select("vec_id", "pred_label_id")


@query("m10_network_from_file", "WITH " + VOCAB_SQL + """,
h AS (SELECT doc_id, pos, coalesce(id, 1) AS id FROM tok LEFT JOIN voc USING (token) WHERE pos <= 64),
g AS (SELECT doc_id, list(id ORDER BY pos) AS x FROM h GROUP BY doc_id),
hidden AS (SELECT doc_id, list_transform(range(8), lambda j: greatest(0, list_sum(list_transform(range(len(x)), lambda i: ((i * 7 + j * 13) % 11 - 5) * x[i + 1])))) AS y FROM g),
scores AS (SELECT doc_id, list_transform(range(3), lambda c: list_sum(list_transform(range(8), lambda j: ((j * 5 + c * 3) % 7 - 3) * y[j + 1]))) AS s FROM hidden)
SELECT doc_id, CAST(list_position(s, list_max(s)) - 1 AS INT) AS pred_label_id FROM scores""")
def _(t):
    """Token ids of every document through a saved two-layer network."""
    path = scratch_path(t.spark, "network")
    i, j, c = np.arange(64)[:, None], np.arange(8), np.arange(3)
    md.save_network(path, (i * 7 + j * 13) % 11 - 5.0, (j[:, None] * 5 + c * 3) % 7 - 3.0)
    vocab = agg.vocabulary(t.documents, "text", "doc_id", max_size=500)
    ids = agg.encode(t.documents, "doc_id", "text", vocab, 64)
    return md.score_foreign(ids, "ids", md.network_from_file(path), 64, 3).select("doc_id", "pred_label_id")
