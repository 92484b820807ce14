"""Queries of the operators in this folder, and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, lm, ngramjoin, packing, quality, resample, search, sharding, suffixes, tokens, toxicity, urls, warc
from tidemark.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLE[name] = sql
        return build

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ITEM_WORDS = f"regexp_extract_all(translate(text, '{_UP}', '{_LOW}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query("op9_decontaminate", f"""
    WITH items AS (SELECT CAST(item_id AS VARCHAR) AS id, {_ITEM_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
    grams AS (
        SELECT DISTINCT id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
        FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
    docs AS (SELECT doc_id, coalesce({_ITEM_WORDS}, []) AS w FROM documents),
    places AS (
        SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
              FROM docs CROSS JOIN (SELECT DISTINCT n FROM grams) WHERE len(w) >= n)),
    found AS (SELECT p.doc_id, p.i, p.n, q.id FROM places p JOIN grams q ON p.n = q.n AND p.g = q.g),
    hits AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY 1),
    who AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
            FROM (SELECT DISTINCT doc_id, id FROM found) GROUP BY 1)
    SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
    FROM docs d LEFT JOIN hits USING (doc_id) LEFT JOIN who USING (doc_id)""")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark words of every document."""
    found = decontaminate.contamination(F.col("text"), table(spark, folder, "benchmark"))
    rows = table(spark, folder, "documents").select("doc_id", found.alias("found"))
    return rows.select(
        "doc_id", "found.n_words", "found.n_hit", F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        decontaminate.is_contaminated(F.col("found")).alias("contaminated"))


@query("op8_sharding")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """All documents written whole into 40 shards by key and read back."""
    docs, path = table(spark, folder, "documents"), scratch_path(spark, "shards")
    sharding.shuffle_shards(docs, "doc_id", "text", 40, path)
    rows = sharding.digests(sharding.read_shards(spark, path, docs.schema), "doc_id", "text", 40)
    return rows.withColumn("law", F.lit("key"))


URL_RULES = [urls.Rule("allow", "com", "/"), urls.Rule("block", "example.com", "/en/"), urls.Rule("allow", "www.example.com", "/en/"),
             urls.Rule("block", "net", "/es/"), urls.Rule("block", "net", "/fr/")]


@query("op10_url_filter")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's url by rules and templates."""
    return urls.filter_urls(table(spark, folder, "pages"), "page_id", "url", URL_RULES)


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_SHA1_32 = " || ".join(
    f"substr('{_BASE32}', ((CAST(concat('0x', substr(h, {10 * g + 1}, 10)) AS BIGINT) >> {35 - 5 * i}) & 31)::INT + 1, 1)"
    for g in range(4) for i in range(8))


@query("op4_warc", f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
    d AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS h,
                 max(page_id) OVER (PARTITION BY body) AS keeper FROM p)
    SELECT page_id, payload_bytes, {_SHA1_32} AS payload_digest,
           CASE WHEN keeper IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN keeper IS DISTINCT FROM page_id THEN keeper END AS refers_to FROM d""")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Every page written to bundles and read back."""
    path = warc.archive_folder(spark)
    index = warc.write_bundles(warc.plan_records(table(spark, folder, "pages"), "page_id", "url", "html"), path)
    return warc.read_bundles(index, path, payload=False).select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op2_token_counts")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document."""
    rows = tokens.count_tokens(table(spark, folder, "documents"), "doc_id", "text", tokenizer_file())
    return rows.withColumn("over_limit", F.col("n_tokens") > 2048)


@query("op3_packing")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    return packing.pack(table(spark, folder, "documents"), "doc_id", "text", tokenizer_file())


@query("op5_quality")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Word statistics and perplexity bands of every document."""
    docs = table(spark, folder, "documents")
    found = quality.quality(F.col("text"), F.col("lang"), quality.fit(docs))
    return docs.select("doc_id", found.alias("found")).select("doc_id", "found.*")


def toxicity_model(spark: SparkSession, folder: str, docs: DataFrame) -> toxicity.Model:
    """Learned from the labelled documents whose id has another crc32 remainder than 2."""
    usable = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    return toxicity.fit(docs, table(spark, folder, "labels"), "doc_id", "text", "toxic", usable)


@query("op7_toxicity")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, folder, "documents")
    model = toxicity_model(spark, folder, docs)
    rows = docs.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"),
                       toxicity.features(F.col("text"), model).alias("found"))
    rows = rows.select("doc_id", "held_out", toxicity.score(F.col("found"), model).alias("score"), "found.*")
    return rows.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query("op1_ngram_join")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents that share most of their 4-word shingles."""
    return ngramjoin.components(table(spark, folder, "documents"), "doc_id", "text", 4, 85, 100).drop("node")


@query("op6_language_model")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Log-likelihood of every document; remainder 2 of 7 is held out."""
    docs = table(spark, folder, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    model, counts = lm.fit(docs, "doc_id", "text", ~held_out)
    return lm.score(docs, "doc_id", "text", model, counts).withColumn("held_out", held_out)


# CRC-32 of a word's UTF-8 bytes in SQL: the table of its polynomial, then a step for each byte.
_CRC_TABLE = """(SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
    lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM (SELECT unnest(range(256)) AS i)))"""
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(w)),
    lambda j: CAST('0x' || substr(hex(encode(w)), 2 * j + 1, 2) AS BIGINT))), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295::BIGINT)"""


@query("op11_resample", f"""
    WITH words AS (
        SELECT src, doc_id, unnest({_ITEM_WORDS}) AS w
        FROM (SELECT 0 AS src, doc_id, text FROM documents UNION ALL SELECT 1, NULL, text FROM benchmark)),
    hashed AS (SELECT w, {_CRC} % 10000 AS bucket FROM (SELECT DISTINCT w FROM words) CROSS JOIN {_CRC_TABLE}),
    counts AS (
        SELECT bucket, CAST(count(*) FILTER (src = 0) AS DOUBLE) AS s, CAST(count(*) FILTER (src = 1) AS DOUBLE) AS t
        FROM words JOIN hashed USING (w) GROUP BY 1),
    totals AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM counts),
    gains AS (
        SELECT bucket, CAST(floor(1000 * ln((t + 1) * (all_s + 10000) / ((s + 1) * (all_t + 10000)))) AS BIGINT) AS gain
        FROM counts CROSS JOIN totals),
    sums AS (
        SELECT doc_id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS g
        FROM words JOIN hashed USING (w) JOIN gains USING (bucket) WHERE src = 0 GROUP BY 1),
    scored AS (
        SELECT doc_id, coalesce(n, 0) AS n_features, coalesce((g - ((g % n + n) % n)) // n, 0) AS weight,
               CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS h
        FROM documents LEFT JOIN sums USING (doc_id)),
    final AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM scored),
    ranked AS (
        SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS all_n FROM final WHERE n_features >= 20)
    SELECT doc_id, n_features, weight, score, CASE WHEN r <= all_n * 10 // 100 THEN r END AS rank
    FROM final LEFT JOIN ranked USING (doc_id)""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """A tenth of the documents, drawn towards the benchmark's words."""
    rows = resample.resample(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "benchmark"), "text")
    return rows.drop("n_words")


_TERMS = f"regexp_extract_all(translate(text, '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@query("op12_search", f"""
    WITH terms AS (SELECT doc_id, unnest({_TERMS}) AS w FROM documents),
    lengths AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY 1),
    totals AS (SELECT count(*) AS all_n, CAST(sum(n) AS BIGINT) AS all_l FROM lengths),
    asked AS (SELECT item_id, unnest({_TERMS}) AS w FROM benchmark),
    tfs AS (SELECT doc_id, w, count(*) AS tf FROM terms WHERE w IN (SELECT w FROM asked) GROUP BY 1, 2),
    weights AS (
        SELECT w, CAST(floor(1000 * ln((2 * all_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS weight
        FROM (SELECT w, count(*) AS df FROM tfs GROUP BY 1) CROSS JOIN totals),
    impacts AS (
        SELECT doc_id, w, weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * all_n) // all_l))) AS part
        FROM tfs JOIN lengths USING (doc_id) JOIN weights USING (w) CROSS JOIN totals),
    scores AS (SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM asked JOIN impacts USING (w) GROUP BY 1, 2 HAVING sum(part) > 0)
    SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores) WHERE rank <= 10""")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return search.search(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "benchmark"), "item_id", "text")


@query("op13_suffix_dedup")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """What repeated strings of 400 bytes leave of every document."""
    rows = suffixes.dedup(table(spark, folder, "documents"), "doc_id", "text")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
