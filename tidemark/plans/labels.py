"""Queries for label normalisation, model answers, triage and work lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import labels as lb
from tidemark.functions import lexicon as lex
from tidemark.functions.parse import clean_id
from tidemark.operators import labeling as lab
from tidemark.operators import triage as tri
from tidemark.plans.base import query
from tidemark.plans.relational import VOTES

# value, class word, class code, strict code, vote code, raw label
VARIANTS = [
    ("LABEL_0", "negative", "0", 0, None, "LABEL_0"),
    ("neg", "negative", "0", 0, None, "LABEL_0"),
    ("NEUTRAL", "neutral", "1", 1, 1, "LABEL_1"),
    ("positive", "positive", "2", 2, 2, "LABEL_2"),
    ("Pos", "positive", "2", 2, None, "LABEL_2"),
    ("1.0", "1.0", "1", 1, None, "1.0"),
    ("2", "2", "2", 2, 2, "2"),
    ("tich_cuc", "tich_cuc", "tich_cuc", 2, 2, "tich_cuc"),
]


def _pick(column: int, key: str = "event_id") -> str:
    arms = []
    for i, row in enumerate(VARIANTS):
        value = row[column]
        shown = "NULL" if value is None else (f"'{value}'" if isinstance(value, str) else str(value))
        arms.append(f"WHEN {i} THEN {shown}")
    return f"CASE {key} % {len(VARIANTS)} {' '.join(arms)} END"


def _labels(t):
    return t.events.select("event_id", F.expr(_pick(0)).alias("label"))


@query("l1_class_words", f"SELECT event_id, {_pick(1)} AS word, {_pick(2)} AS code, {_pick(5)} AS raw FROM events")
def _(t):
    c = F.col("label")
    return _labels(t).select("event_id", lb.class_word(c).alias("word"), lb.class_code(c).alias("code"), lb.raw_label(c).alias("raw"))


@query("l2_strict_codes", f"SELECT event_id, CAST({_pick(3)} AS INT) AS code FROM events")
def _(t):
    return _labels(t).select("event_id", lb.strict_code(F.col("label")).alias("code"))


@query("l2_foreign_classes", """
SELECT vec_id, CASE label % 3 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END AS code FROM embeddings""")
def _(t):
    codes = lb.check_foreign_classes({0: "Tích cực", 1: "NEG", 2: "trung lap"})
    table = F.create_map(*[F.lit(x) for p in codes.items() for x in p])
    return t.embeddings.select("vec_id", table[F.col("label") % 3].alias("code"))


@query("l3_vote_codes", f"""
SELECT event_id, CAST({_pick(4)} AS INT) AS code, CASE {_pick(4)} WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' WHEN 2 THEN 'positive' ELSE 'unknown' END AS name,
CAST(coalesce({_pick(4)}, 1) AS INT) AS filled, CASE WHEN floor(value) IN (0, 1, 2) THEN CAST(floor(value) AS INT) END AS numeric_code FROM events""")
def _(t):
    code = lb.vote_code(F.expr(_pick(0)))
    return t.events.select("event_id", code.alias("code"), lb.code_name(code).alias("name"),
                           lb.sentiment_code(F.expr(_pick(0))).alias("filled"), lb.numeric_vote_code(F.col("value")).alias("numeric_code"))


@query("l4_clean_ids", """
SELECT event_id, CASE event_id % 3 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN concat('a ', event_id, '.0') ELSE '' END AS id FROM events""")
def _(t):
    raw = F.expr("CASE event_id % 3 WHEN 0 THEN concat(' ', event_id, '.0 ') WHEN 1 THEN concat('a  ', event_id, '.0') END")
    return t.events.select("event_id", clean_id(raw).alias("id"))


ANSWER = """CASE event_id % 4
 WHEN 0 THEN concat('```json', chr(10), '{"label": "POS", "scores": [{"label": "LABEL_2", "score": ', round(value / 100, 4), '}, {"label": "neg", "score": 1.5}]}', chr(10), '```')
 WHEN 1 THEN concat('Sure: {"label": "neutral", "scores": []} done ', event_id)
 WHEN 2 THEN concat('no answer ', event_id)
 ELSE concat('{"label": "odd", "scores": [], "n": ', event_id, '}') END"""


@query("l5_answer_json", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'POS' WHEN 1 THEN 'neutral' WHEN 3 THEN 'odd' END AS label FROM events""")
def _(t):
    found = lb.answer_json(F.expr(ANSWER))
    return t.events.select("event_id", F.get_json_object(found, "$.label").alias("label"))


@query("l6_answer_label", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'LABEL_2' WHEN 1 THEN 'LABEL_0' WHEN 2 THEN 'LABEL_1' END AS label FROM events""")
def _(t):
    text = F.expr("""CASE event_id % 4 WHEN 0 THEN concat('answer label_2 for ', event_id) WHEN 1 THEN concat('It is Negative, not pos ', event_id)
        WHEN 2 THEN concat('neu! ', props) ELSE concat('negatively ', event_id) END""")
    return t.events.select("event_id", lb.answer_label(text).alias("label"))


@query("l7_normalize_scores", """
WITH v AS (SELECT event_id, round(value / 100, 4)::DOUBLE AS s, event_id % 3 AS k FROM events),
c AS (SELECT event_id, least(1.0, greatest(0.0, s)) AS s, k FROM v)
SELECT event_id, CASE WHEN k = 0 THEN CASE WHEN s > 0.5 THEN 'LABEL_1' ELSE 'LABEL_0' END WHEN k = 1 THEN 'LABEL_2' ELSE 'LABEL_0' END AS top,
round(CASE WHEN k = 0 THEN greatest(s, 0.5) WHEN k = 1 THEN 1.0 ELSE 1.0 END, 6) AS top_score,
round(CASE WHEN k = 0 THEN s + 0.5 WHEN k = 1 THEN 1.0 ELSE 1.0 + s END, 6) AS total FROM c""")
def _(t):
    score = F.expr("double(round(value / 100, 4))")
    item = lambda name, s: F.struct(F.lit(name).alias("label"), s.cast("double").alias("score"))
    k = F.col("event_id") % 3
    scores = (F.when(k == 0, F.array(item("NEU", score), item("negative", F.lit(0.5)), item("other", F.lit(9))))
              .when(k == 1, F.array(item("LABEL_0", F.lit(-2)), item("LABEL_1", F.lit(0))))
              .otherwise(F.array(item("LABEL_1", F.lit(3)), item("LABEL_0", F.lit(7)), item("LABEL_1", score))))
    out = t.events.select("event_id", lb.normalize_scores(scores, F.lit("LABEL_2")).alias("s"))
    return out.select("event_id", F.col("s")[0]["label"].alias("top"), F.round(F.col("s")[0]["score"], 6).alias("top_score"),
                      F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + x["score"]), 6).alias("total"))


@query("l8_prediction_record", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'positive' WHEN 1 THEN 'neutral' END AS sentiment_label,
round(CASE event_id % 4 WHEN 0 THEN least(1.0, greatest(0.0, round(value / 100, 4)::DOUBLE)) WHEN 1 THEN 1.0 END, 6) AS sentiment_score,
CASE event_id % 4 WHEN 0 THEN 'LABEL_2' WHEN 1 THEN 'LABEL_1' END AS sentiment_raw_label, CASE WHEN event_id % 4 < 2 THEN 'done' END AS status FROM events""")
def _(t):
    out = t.events.select("event_id", lb.prediction(F.expr(ANSWER)).alias("p"))
    return out.select("event_id", "p.sentiment_label", F.round("p.sentiment_score", 6).alias("sentiment_score"), "p.sentiment_raw_label", "p.status")


STATES = "CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN ' Pending ' WHEN 2 THEN 'processing' WHEN 3 THEN 'error' WHEN 4 THEN 'DONE' WHEN 5 THEN 'skipped' ELSE 'odd' END"
RAW = "CASE WHEN event_id % 2 = 0 THEN 'LABEL_1' ELSE ' ' END"
REPAIRED = """CASE WHEN event_id % 2 = 0 THEN CASE WHEN event_id % 7 IN (0, 1, 2, 3, 4) THEN 'done' WHEN event_id % 7 = 5 THEN 'skipped' ELSE 'odd' END
 ELSE CASE event_id % 7 WHEN 0 THEN 'pending' WHEN 1 THEN 'pending' WHEN 2 THEN 'processing' WHEN 3 THEN 'error' WHEN 4 THEN 'pending' WHEN 5 THEN 'skipped' ELSE 'odd' END END"""


@query("l9_status_repair", f"""
SELECT event_id, {REPAIRED} AS status, {REPAIRED} NOT IN ('done', 'skipped') AS unfinished FROM events""")
def _(t):
    out = t.events.select("event_id", lb.repaired_status(F.expr(STATES), F.expr(RAW)).alias("status"))
    return out.withColumn("unfinished", lb.is_unfinished(F.col("status")))


@query("l10_work_batches", """
WITH w AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS no, text FROM documents),
k AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM w WHERE no > 10 AND doc_id % 3 <> 0
      AND length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) >= 50)
SELECT (n - 1) // 30 AS batch_no, count(*) AS items, min(doc_id) AS first_row, max(doc_id) AS last_row FROM k GROUP BY ALL""")
def _(t):
    d = t.documents.select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, "done").otherwise("pending").alias("status"))
    out = lab.work_batches(d, "doc_id", "text", 30, start=10, min_length=50)
    return out.select(F.col("batch_no").cast("bigint").alias("batch_no"), F.size("items").cast("bigint").alias("items"),
                      F.col("items")[0]["row_id"].alias("first_row"), F.element_at("items", -1)["row_id"].alias("last_row"))


@query("l20_resume", """
SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN 'positive' WHEN doc_id % 2 = 0 THEN 'negative' ELSE '' END AS sentiment_label,
CASE WHEN doc_id % 5 = 1 OR doc_id % 2 = 0 THEN 'done' ELSE 'pending' END AS status FROM documents""")
def _(t):
    base = t.documents.select("doc_id", "text")
    done = F.col("doc_id") % 2 == 0
    earlier = base.select("doc_id", F.when(done, "negative").alias("sentiment_label"), F.when(done, 0.5).alias("sentiment_score"),
                          F.when(done, "LABEL_0").alias("sentiment_raw_label"), F.when(~done, "processing").alias("status"))
    new = base.filter("doc_id % 5 = 1").select(
        "doc_id", F.lit("positive").alias("sentiment_label"), F.lit(0.9).alias("sentiment_score"), F.lit("LABEL_2").alias("sentiment_raw_label"),
        F.lit("[]").alias("sentiment_raw_scores"), F.lit("done").alias("status"))
    out = lab.apply_predictions(lab.resume(base, earlier, "doc_id"), new, "doc_id")
    return out.select("doc_id", "sentiment_label", F.when(F.col("status") == "processing", "pending").otherwise(F.col("status")).alias("status"))


# --- triage -----------------------------------------------------------------------

def _any(words, c="l"):
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


RULES = f"""
r AS (SELECT doc_id, text, lower(text) AS l FROM {{social}}),
f AS (SELECT doc_id, text, {_any(lex.URGENT_WORDS)} AS u, {_any(lex.STUDY_WORDS)} AS st, {_any(lex.ACTIVITY_WORDS)} AS ac,
             {_any(lex.NEGATIVE_WORDS)} AS ng, {_any(lex.POSITIVE_WORDS)} AS ps FROM r),
a AS (SELECT doc_id, text, u AS attention_required,
      CASE WHEN st THEN 'hoc_tap' WHEN ac THEN 'hoat_dong' WHEN u THEN 'canh_bao' ELSE 'doi_song_sinh_vien' END AS category,
      CASE WHEN u THEN 0.88 WHEN ng THEN 0.62 WHEN ps THEN 0.38 ELSE 0.5 END AS importance_score,
      CASE WHEN u THEN '{lex.ACTION_URGENT}' ELSE '{lex.ACTION_WATCH}' END AS suggested_action,
      CASE WHEN ng THEN 'negative' WHEN ps THEN 'positive' ELSE 'neutral' END AS sentiment_label,
      CASE WHEN ng THEN 0 WHEN ps THEN 2 ELSE 1 END AS sentiment_code,
      CASE WHEN u THEN 'needs_attention' ELSE 'analyzed' END AS status_label FROM f)"""


@query("l11_rule_triage", "WITH " + RULES + """
SELECT doc_id, category, CAST(importance_score AS DOUBLE) AS importance_score, attention_required, suggested_action, sentiment_label, sentiment_code, status_label FROM a""")
def _(t):
    return tri.triage(t.social.select("doc_id", "text"), "text").drop("text", "summary", "provider", "model_name")


@query("l11_rule_triage_whole_words", """
SELECT doc_id, regexp_matches(lower(text), '(^|[^\\p{L}\\p{M}\\p{N}_])(te|thi|hay)($|[^\\p{L}\\p{M}\\p{N}_])') AS hit FROM {social}""")
def _(t):
    return t.social.select("doc_id", tri.mentions(F.col("text"), ["te", "thi", "hay"], whole_words=True).alias("hit"))


@query("l12_apply_analysis", "WITH " + RULES + """
SELECT doc_id, category AS topic, CASE WHEN importance_score >= 0.8 THEN 'high' ELSE 'normal' END AS importance_level, status_label AS status FROM a""")
def _(t):
    return tri.apply_analysis(tri.triage(t.social.select("doc_id", "text"), "text")).select("doc_id", "topic", "importance_level", "status")


EXTERNAL = f"""from_json(CASE doc_id % 4 WHEN 0 THEN concat('{{"summary": "", "importance_score": ', doc_id, ', "sentiment_label": "POSITIVE", "sentiment_code": 9}}')
 WHEN 1 THEN '{{"category": "x", "attention_required": true, "importance_score": -1, "sentiment_code": 0}}' END, '{tri.EXTERNAL}')"""


@query("l13_external_result", """
SELECT doc_id, CASE WHEN doc_id % 4 IN (0, 1) THEN left(text, 220) END AS summary, CASE doc_id % 4 WHEN 0 THEN 'chua_phan_loai' WHEN 1 THEN 'x' END AS category,
CASE doc_id % 4 WHEN 0 THEN least(1.0, doc_id)::DOUBLE WHEN 1 THEN 0.0 END AS importance_score, CASE doc_id % 4 WHEN 0 THEN 'positive' WHEN 1 THEN 'neutral' END AS sentiment_label,
CAST(CASE doc_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 0 END AS INT) AS sentiment_code, CASE doc_id % 4 WHEN 0 THEN 'analyzed' WHEN 1 THEN 'needs_attention' END AS status_label FROM documents""")
def _(t):
    out = t.documents.select("doc_id", tri.external_result(F.expr(EXTERNAL), F.col("text")).alias("r"))
    return out.select("doc_id", *[f"r.{c}" for c in ("summary", "category", "importance_score", "sentiment_label", "sentiment_code", "status_label")])


@query("l17_fallback", "WITH " + RULES + """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'chua_phan_loai' WHEN 1 THEN 'x' ELSE category END AS category,
CASE WHEN doc_id % 4 < 2 THEN 'gemini' ELSE 'mock' END AS provider, CASE WHEN doc_id % 4 >= 2 THEN 'gemini' END AS fallback_from,
CASE doc_id % 4 WHEN 2 THEN 'timeout' WHEN 3 THEN 'no answer' END AS fallback_reason FROM a""")
def _(t):
    external = t.documents.filter("doc_id % 4 < 3").select("doc_id", F.expr(EXTERNAL).alias("answer"), F.expr("if(doc_id % 4 = 2, 'timeout', NULL)").alias("error"))
    out = tri.enrich(t.social.select("doc_id", "text"), external, "doc_id", "text")
    return out.select("doc_id", "category", "provider", "fallback_from", "fallback_reason")


@query("l18_error_map", """
SELECT id, nullif(concat_ws(';', CASE WHEN bgem3_label IS NULL THEN 'bgem3=bgem3 label unavailable' END,
CASE WHEN gemini_label IS NULL THEN concat('gemini=', status) END, CASE WHEN phobert_label IS NULL THEN 'phobert=phobert label unavailable' END,
CASE WHEN simcse_label IS NULL THEN 'simcse=simcse label unavailable' END), '') AS errors FROM {news}""")
def _(t):
    out = tri.label_item(t.news, VOTES, {"gemini": "status"})
    parts = F.transform(F.array_sort(F.map_entries("label_error_json")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return out.select("id", F.array_join(parts, ";").alias("errors"))


@query("l19_complete_analysis", "WITH " + RULES + """,
m AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 0 END AS g, CASE WHEN doc_id % 5 <> 0 THEN doc_id % 3 END AS s, CASE WHEN doc_id % 7 <> 0 THEN doc_id % 2 END AS h FROM documents),
v AS (SELECT doc_id, unnest([g, h, s]) AS code, unnest([1, 2, 3]) AS pr FROM m),
c AS (SELECT doc_id, code, count(*) AS n, min(pr) AS pr FROM v WHERE code IS NOT NULL GROUP BY ALL),
w AS (SELECT doc_id, code FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pr) = 1)
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'chua_phan_loai' WHEN 1 THEN 'x' ELSE category END AS topic,
CASE WHEN doc_id % 4 = 0 AND doc_id > 0 OR doc_id % 4 >= 2 AND importance_score >= 0.8 THEN 'high' ELSE 'normal' END AS importance_level,
CASE doc_id % 4 WHEN 0 THEN 'analyzed' WHEN 1 THEN 'needs_attention' ELSE status_label END AS status, CAST(g AS INT) AS gemini_label, CAST(w.code AS INT) AS voted_label,
CASE WHEN g IS NULL AND s IS NULL AND h IS NULL THEN 'failed' ELSE 'partial' END AS label_status,
concat_ws(';', 'bgem3=bgem3 label unavailable', CASE doc_id % 4 WHEN 2 THEN 'gemini=timeout' WHEN 3 THEN 'gemini=no answer' END,
CASE WHEN h IS NULL THEN 'phobert=phobert label unavailable' END, CASE WHEN s IS NULL THEN 'simcse=simcse label unavailable' END) AS errors
FROM a JOIN m USING (doc_id) LEFT JOIN w USING (doc_id)""")
def _(t):
    external = t.documents.filter("doc_id % 4 < 3").select("doc_id", F.expr(EXTERNAL).alias("answer"), F.expr("if(doc_id % 4 = 2, 'timeout', NULL)").alias("error"))
    models = t.documents.selectExpr("doc_id", "int(if(doc_id % 5 <> 0, doc_id % 3, NULL)) AS simcse_label", "int(if(doc_id % 7 <> 0, doc_id % 2, NULL)) AS phobert_label")
    out = tri.analyze_items(t.social.select("doc_id", "text"), external, models, "doc_id", "text")
    parts = F.transform(F.array_sort(F.map_entries("label_error_json")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return out.select("doc_id", "topic", "importance_level", "status", "gemini_label", "voted_label", "label_status", F.array_join(parts, ";").alias("errors"))


@query("l19_analyze_newest", "WITH " + RULES + """
SELECT doc_id AS id, category AS topic, CASE WHEN importance_score >= 0.8 THEN 'high' ELSE 'normal' END AS importance_level, status_label AS status
FROM a ORDER BY doc_id DESC LIMIT 50""")
def _(t):
    items = t.social.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("created_at"), F.col("text").alias("content"), F.lit(None).cast("timestamp").alias("deleted_at"))
    return tri.analyze_newest(items).select("id", "topic", "importance_level", "status")
