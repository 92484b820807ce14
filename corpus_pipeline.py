"""The corpus pipeline: stages over documents, each written as Parquet and read by the next.

Quality rules and toxicity drop the documents they reject, the n-gram join
keeps one row of each near-duplicate group (the one with the smallest id),
decontamination drops documents whose words are a twentieth or more benchmark
text, and packing lays what is left into sequences. Each stage learns and
counts over all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, ngramjoin, packing, plans, quality, toxicity
from tidemark.session import scratch_path, written

ORACLE_SQL = None  # perplexity bands and a learned lexicon have no SQL


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie inside their language's perplexity band."""
    return docs.filter(quality.quality(F.col("text"), F.col("lang"), quality.fit(docs))["kept"])


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.3."""
    model = plans.toxicity_model(spark, sf_dir, docs)
    return docs.filter(toxicity.score(toxicity.features(F.col("text"), model), model) < 0.3)


def with_place(docs: DataFrame) -> DataFrame:
    """The rows with ``__file`` and ``__row``, their place in Parquet files, which no later job can change.

    Documents that are not read from Parquet as they are get written once.
    """
    if docs._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation":
        try:
            return docs.select("*", F.xxhash64("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
        except AnalysisException:  # another format
            pass
    return with_place(written(docs, "pipeline-rows"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by 5-word shingles at a Jaccard similarity of 0.8 or more.

    The row with the smallest id stays (nulls last, then by its place in the
    files); ids may repeat or be null. Rows without words stay.
    """
    rows = with_place(docs)
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("__file").alias("file"), F.col("__row").alias("row"))
    kept = ngramjoin.components(rows.select(key.alias("place"), "text"), "place", "text", 5, 80, 100)
    gone = kept.filter("place.file <> component_id.file OR place.row <> component_id.row").select(
        F.col("place.file").alias("__file"), F.col("place.row").alias("__row"))
    return rows.join(gone, ["__file", "__row"], "left_anti").select(*docs.columns)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items."""
    found = decontaminate.contamination(F.col("text"), plans.table(spark, sf_dir, "benchmark"))
    return docs.filter(~decontaminate.is_contaminated(found))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, with their token ids, in sequences of at most 2048 tokens."""
    return packing.pack(docs, "doc_id", "text", plans.tokenizer_file(), with_ids=True)


STAGES = [("quality", quality_stage), ("toxicity", toxicity_stage), ("near_duplicates", near_duplicate_stage),
          ("decontamination", decontaminate_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
