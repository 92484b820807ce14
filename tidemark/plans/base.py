"""Query registry, the given tables, and the roles they play.

A role is a view over the given tables in SQL that both engines read, so a
query and its reference SQL start from the same rows. Every role covers whole
tables and whole texts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

# Openings put before the documents, so that texts hold what the operators look for.
OPENINGS = [
    "#Cfs2295_DNTU Nhaaa k vui 😍 100k!!! https://abc.com",
    "#24399: mng đi 3 bước nhaaa :)))",
    "#thấygớm quá tr ơi 😡",
    "Hùng Minh môn hiểu biết về DNTU:)))???",
    "Các bạn có biết thầy Lê Nhật Tùng không?",
    "tui không biết cô nguyễn thị liệu",
    "sinh viên phạm thế an là ai?",
    "Nguyễn Tuấn Kiệt trường mình có 12 bình luận",
    "XEM THÊM bình luận ở đây",
    "gọi 0912345678 hoặc +84912345678 www.abc.vn/x",
    "DNTU - Confession",
    "@[1000:0:Nguyễn Văn A] facebook.com/abc.def xin chào",
    "buồnnnnn VUIIII hahahaha huhuhu !!!!!",
    "k đc r bn ơi, ng ta đi ik",
    "❤️🔥 <3 :( =)) xD T_T ✅",
    "diem thi hoc phi gap",
    "canh bao lua dao nguy hiem",
    "tinh nguyen su kien that vong",
    "cam on rat tot",
    "cao 1m65 lúc 7h30 được 50% 12.5 a15 2tr 15đ b2b3 007",
    "4 tháng 11, 2025",
    "1,2K comments",
    "Tất cả cảm xúc: 3,4K",
    "#a_b #DNTU #Cfs1_dntuchào",
    "hỏi cô: nguyễn thị liệu nhé",
    'gặp thầy "lê văn an" ở đây',
    "cô nguyễn và bạn",
]


def _cases(key: str, values: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {key} % {len(values)} {arms} END"


ROLES = {
    "social": f"""
        SELECT doc_id, lang, source, n_chars,
               concat({_cases('doc_id', OPENINGS)}, chr(10), text) AS text
        FROM {{documents}}""",
    "news": """
        SELECT event_id AS id, user_id AS source_id, ts AS created_at, ts AS posted_at, ts AS collected_at,
               props AS content, concat(event_type, ' ', props) AS normalized_content,
               CASE WHEN event_type = 'signup' THEN NULL ELSE event_type END AS topic,
               CASE event_id % 7 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN NULL ELSE 'normal' END
                 AS importance_level,
               CASE event_id % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'pending' ELSE 'analyzed' END AS status,
               CASE WHEN event_id % 13 = 0 THEN ts END AS deleted_at,
               CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(event_id % 3 AS INT) END AS gemini_label,
               CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST((event_id + user_id) % 3 AS INT) END AS simcse_label,
               CASE WHEN event_id % 22 = 0 THEN NULL ELSE CAST(user_id % 3 AS INT) END AS phobert_label,
               CASE WHEN event_id % 2 = 0 THEN NULL ELSE CAST((event_id * 7) % 3 AS INT) END AS bgem3_label,
               CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(user_id % 3 AS INT) END AS voted_label
        FROM {events}""",
    "annotators": """
        SELECT doc_id AS id, lang AS data_type, text AS content_anonymized,
               CASE WHEN doc_id % 29 = 0 THEN NULL ELSE CAST(n_chars % 3 AS STRING) END AS ann_a,
               CASE WHEN doc_id % 17 = 0 THEN ' ' WHEN doc_id % 5 = 0 THEN CAST((n_chars + 1) % 3 AS STRING)
                    ELSE CAST(n_chars % 3 AS STRING) END AS ann_b,
               CASE WHEN doc_id % 11 = 0 THEN '' ELSE CAST((n_chars + doc_id) % 3 AS STRING) END AS ann_c
        FROM {documents}""",
    "predictions": """
        SELECT doc_id, lang, CAST(n_chars % 3 AS INT) AS true_id,
               CASE WHEN doc_id % 4 = 0 THEN CAST((n_chars + 1) % 3 AS INT) ELSE CAST(n_chars % 3 AS INT) END AS pred_id
        FROM {documents}""",
    "comments": """
        SELECT conv_id * 1000 + turn AS comment_id, conv_id AS post_id, text AS content, role,
               '2024-01-02 03:04:05' AS collected_at
        FROM {conversations} WHERE turn > 0""",
    "raw_posts": """
        SELECT conv_id AS id, text AS content, CASE WHEN conv_id % 3 = 0 THEN NULL ELSE concat('https://s/', role) END AS source,
               CASE conv_id % 4 WHEN 0 THEN '2024-05-01 10:00:00' WHEN 1 THEN '2024-05-01T11:00:00Z'
                    WHEN 2 THEN '2024-05-02' ELSE 'hôm qua' END AS posted_at,
               CASE conv_id % 3 WHEN 0 THEN '1,2K' WHEN 1 THEN '37' ELSE '' END AS like_count,
               concat(CAST(conv_id % 9 AS STRING), ' bình luận') AS comment_count,
               '2024-05-03 00:00:00' AS collected_at
        FROM {conversations} WHERE turn = 0""",
}


class Tables:
    """The given tables and roles of one scale factor as frames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            rows = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            # Test tables are one row group, which one task reads; the bench asks for more tasks.
            even = name == "documents" and self.spark.conf.get("spark.tidemark.rebalance", "false") == "true"
            return rows.hint("rebalance") if even else rows
        if name in ROLES:
            sql = ROLES[name]
            used = [t for t in TABLES if "{" + t + "}" in sql]
            return self.spark.sql(sql, **{t: getattr(self, t) for t in used})
        raise AttributeError(name)


def reference_sql(sql: str) -> str:
    """Put the role definitions in place of ``{role}`` names."""
    for name, body in ROLES.items():
        if "{" + name + "}" in sql:
            for table in TABLES:
                body = body.replace("{" + table + "}", table)
            sql = sql.replace("{" + name + "}", f"({body})")
    return sql


@dataclass(frozen=True)
class Query:
    build: Callable[[Tables], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, if there is one, the SQL that gives the same rows."""

    def add(build):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(build, None if sql is None else reference_sql(sql))
        return build

    return add
