"""Rule-based triage, external analyses and the fallback between them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import lexicon as lex
from tidemark.functions.labels import sentiment_code
from tidemark.functions.regex import any_of, let
from tidemark.functions.text import truncate
from tidemark.operators.ranking import newest
from tidemark.operators.votes import completeness, error_map, plurality


def mentions(text: Column, words: Sequence[str], whole_words: bool = False) -> Column:
    """Whether lower-cased text holds one of the words, anywhere or as whole words."""
    pattern = rf"(?U)(?<!\w)(?:{any_of(words)})(?!\w)" if whole_words else f"(?:{any_of(words)})"
    return F.lower(text).rlike(pattern)


def rule_triage(text: Column, whole_words: bool = False) -> Column:
    """``struct`` of summary, category, score, attention, action, sentiment and status.

    Study beats activity beats alert beats student life.
    """
    flags = F.struct(*[mentions(text, words, whole_words).alias(name) for name, words in (
        ("urgent", lex.URGENT_WORDS), ("study", lex.STUDY_WORDS), ("activity", lex.ACTIVITY_WORDS),
        ("negative", lex.NEGATIVE_WORDS), ("positive", lex.POSITIVE_WORDS))])

    def answer(f: Column) -> Column:
        category = (F.when(f["study"], "hoc_tap").when(f["activity"], "hoat_dong")
                    .when(f["urgent"], "canh_bao").otherwise("doi_song_sinh_vien"))
        sentiment = F.when(f["negative"], "negative").when(f["positive"], "positive").otherwise("neutral")
        score = F.when(f["urgent"], 0.88).when(f["negative"], 0.62).when(f["positive"], 0.38).otherwise(0.5)
        code = F.when(f["negative"], 0).when(f["positive"], 2).otherwise(1)
        return F.struct(
            category.alias("category"), score.cast("double").alias("importance_score"),
            f["urgent"].alias("attention_required"),
            F.when(f["urgent"], lex.ACTION_URGENT).otherwise(lex.ACTION_WATCH).alias("suggested_action"),
            sentiment.alias("sentiment_label"), code.alias("sentiment_code"),
            F.when(f["urgent"], "needs_attention").otherwise("analyzed").alias("status_label"))

    return let(flags, answer)


RESULT_FIELDS = ["summary", "category", "importance_score", "attention_required", "suggested_action",
                 "sentiment_label", "sentiment_code", "status_label"]


def triage(df: DataFrame, text: str = "content") -> DataFrame:
    """Add the rule results as columns."""
    out = df.withColumn("_t", rule_triage(F.col(text)))
    return out.select(*df.columns, truncate(F.col(text), empty=lex.EMPTY_SUMMARY).alias("summary"), "_t.*",
                      F.lit(lex.RULE_PROVIDER).alias("provider"), F.lit(lex.RULE_MODEL).alias("model_name"))


EXTERNAL = ("summary string, category string, importance_score double, attention_required boolean, "
            "suggested_action string, sentiment_label string, sentiment_code int, status_label string")


def external_result(answer: Column, text: Column) -> Column:
    """A parsed external answer with defaults, a clamped score and a code that fits the label."""
    filled = lambda c, default: F.coalesce(F.nullif(c, F.lit("")), default)

    def clean(r: Column) -> Column:
        label = F.lower(F.coalesce(r["sentiment_label"], F.lit("neutral")))
        code = F.coalesce(r["sentiment_code"], sentiment_code(label))
        attention = F.coalesce(r["attention_required"], F.lit(False))
        return F.struct(
            filled(r["summary"], F.substring(text, 1, lex.SUMMARY_LENGTH)).alias("summary"),
            filled(r["category"], F.lit(lex.UNSORTED_TOPIC)).alias("category"),
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(r["importance_score"], F.lit(0.5)))).alias("importance_score"),
            attention.alias("attention_required"),
            filled(r["suggested_action"], F.lit(lex.ACTION_WATCH)).alias("suggested_action"),
            label.alias("sentiment_label"),
            F.when(code.isin(0, 1, 2), code).otherwise(sentiment_code(label)).alias("sentiment_code"),
            filled(r["status_label"], F.when(attention, "needs_attention").otherwise("analyzed")).alias("status_label"))

    return F.when(answer.isNotNull(), let(answer, clean))


def enrich(items: DataFrame, external: DataFrame, key: str = "id", text: str = "content",
           provider: str = "gemini", model: str = "gemini-3.5-flash") -> DataFrame:
    """External result where there is one, else the rules, with where and why it fell back.

    ``external`` has the key, ``answer`` (a struct of ``EXTERNAL``, null if it
    failed) and ``error``.
    """
    joined = items.join(external.select(key, "answer", "error"), key, "left")
    judged = triage(joined.withColumn("_x", external_result(F.col("answer"), F.col(text))), text)
    ok = F.col("_x").isNotNull()
    either = lambda c: F.when(ok, F.col(f"_x.{c}")).otherwise(F.col(c)).alias(c)
    return judged.select(
        *items.columns, *[either(c) for c in RESULT_FIELDS],
        F.when(ok, provider).otherwise(F.col("provider")).alias("provider"),
        F.when(ok, model).otherwise(F.col("model_name")).alias("model_name"),
        F.when(~ok, provider).alias("fallback_from"),
        F.when(~ok, F.coalesce("error", F.lit("no answer"))).alias("fallback_reason"))


def label_item(df: DataFrame, votes: Mapping[str, str], errors: Mapping[str, str]) -> DataFrame:
    """Voted label, completeness and error map from one label column per source."""
    columns = {s: F.col(c) for s, c in votes.items()}
    failed = {s: F.when(F.col(votes[s]).isNull(), F.coalesce(F.col(errors[s]), F.lit(f"{s} label unavailable")))
              if s in errors else F.when(F.col(votes[s]).isNull(), F.lit(f"{s} label unavailable")) for s in votes}
    return df.withColumns({
        "voted_label": plurality(columns), "label_status": completeness(columns), "label_error_json": error_map(failed)})


def apply_analysis(df: DataFrame) -> DataFrame:
    """Topic, importance and status of an item after its analysis."""
    return df.withColumns({
        "topic": F.col("category"),
        "importance_level": F.when(F.col("importance_score") >= 0.8, "high").otherwise("normal"),
        "status": F.col("status_label")})


MODEL_LABELS = {"gemini": "gemini_label", "phobert": "phobert_label", "simcse": "simcse_label", "bgem3": "bgem3_label"}
ITEM_FIELDS = ["topic", "importance_level", "status", *MODEL_LABELS.values(), "voted_label", "label_status", "label_error_json"]


def analyze_items(items: DataFrame, external: DataFrame, models: DataFrame | None = None, key: str = "id",
                  text: str = "content", provider: str = "gemini", model: str = "gemini-3.5-flash") -> DataFrame:
    """The complete analysis of items: external answer or rules, all models' labels, vote, status and errors.

    ``external`` is as in ``enrich``. ``models`` has the key and label codes under
    the names of ``MODEL_LABELS`` other than the external provider's; missing
    ones count as unavailable. The external label is a vote only if it did not
    fall back; the reason is then its error.
    """
    judged = enrich(items, external, key, text, provider, model)
    own = MODEL_LABELS[provider]
    judged = judged.withColumn(own, F.when(F.col("fallback_from").isNull(), F.col("sentiment_code")))
    others = [c for c in MODEL_LABELS.values() if c != own]
    given = [] if models is None else [c for c in others if c in models.columns]
    if given:
        judged = judged.join(models.select(key, *given), key, "left")
    judged = judged.withColumns({c: F.lit(None).cast("int") for c in others if c not in given})
    return apply_analysis(label_item(judged, MODEL_LABELS, {provider: "fallback_reason"}))


def analyze_newest(items: DataFrame, limit: int = 50, text: str = "content") -> DataFrame:
    """Triage of the newest items with their updated columns."""
    live = items.filter(F.col("deleted_at").isNull())
    return apply_analysis(triage(newest(live, "created_at", limit), text))
