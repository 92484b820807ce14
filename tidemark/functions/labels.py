"""Label normalisation, model answers, score vectors and label states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import lexicon as lex
from tidemark.functions.parse import clean_id
from tidemark.functions.regex import let, literal_map
from tidemark.functions.text import is_blank, squash, strip_space

SCORES = "array<struct<label:string,score:double>>"


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(literal_map(table), key)


def class_word(label: Column) -> Column:
    """``negative``/``neutral``/``positive`` of a known name; others pass through."""
    table = {**lex.CLASS_WORDS, **{w: w for w in lex.LABEL_NAMES.values()}}
    return F.coalesce(_lookup(table, label), _lookup(table, F.upper(label)), label)


def class_code(label: Column) -> Column:
    """``0``/``1``/``2`` of a known name; others pass through; null gives empty."""
    text = squash(label.cast("string"))
    table = {**lex.CLASS_CODES, "negative": "0", "neutral": "1", "positive": "2"}
    return F.coalesce(_lookup(table, text), _lookup(table, F.upper(text)), text)


def raw_label(label: Column) -> Column:
    """``LABEL_n`` of a class; unknown labels pass through."""
    table = dict(zip(lex.LABEL_NAMES.values(), lex.RAW_LABELS))
    return F.coalesce(_lookup(table, class_word(label)), label)


def strict_code(label: Column) -> Column:
    """0, 1 or 2; an unknown or missing label is an error."""
    key = F.lower(squash(label.cast("string")))
    code = _lookup(lex.TRAINING_ALIASES, key)
    message = F.concat(F.lit("Invalid label: "), F.coalesce(label.cast("string"), F.lit("null")))
    return F.when(label.isNull() | code.isNull(), F.raise_error(message).cast("int")).otherwise(code).cast("int")


def vote_code(label: Column) -> Column:
    """0, 1 or 2, else null."""
    return _lookup(lex.VOTE_ALIASES, F.lower(strip_space(label.cast("string")))).cast("int")


def numeric_vote_code(value: Column) -> Column:
    """Truncated number as a class code, else null."""
    code = value.cast("int")
    return F.when(code.isin(0, 1, 2), code)


def sentiment_code(label: Column) -> Column:
    """As ``vote_code``, with neutral for anything unknown."""
    return F.coalesce(vote_code(F.coalesce(label, F.lit(""))), F.lit(1))


def code_name(code: Column) -> Column:
    """Class name of a code; null is ``unknown``, any other code ``neutral``."""
    names = F.create_map(*[F.lit(x) for p in lex.LABEL_NAMES.items() for x in p])
    return F.when(code.isNull(), F.lit("unknown")).otherwise(
        F.coalesce(F.try_element_at(names, code.cast("int")), F.lit("neutral")))


def label_name_vi(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for p in lex.LABEL_NAMES_VI.items() for x in p])
    return F.try_element_at(names, code.cast("int"))


def check_foreign_classes(names: dict[int, str]) -> dict[int, int]:
    """Class codes of a foreign model's outputs; a name without one is an error."""
    codes = {i: lex.FOREIGN_CLASS_NAMES.get(str(n).strip().lower()) for i, n in names.items()}
    unknown = [(i, names[i]) for i, code in codes.items() if code is None]
    if unknown:
        raise ValueError(f"Model classes without a sentiment code: {unknown}")
    return codes


def clean_label(label: Column) -> Column:
    return clean_id(label)


# --- model answers -------------------------------------------------------------

def answer_json(answer: Column) -> Column:
    """The outermost ``{...}`` of an answer, code fences removed; null if none."""
    text = F.regexp_replace(strip_space(answer), F.lit(r"(?i)^`+(?:json)?|`+$"), F.lit(""))
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def answer_label(answer: Column) -> Column:
    """``LABEL_n`` named in free text, else the class of the first class word."""
    text = strip_space(answer)
    direct = F.nullif(F.regexp_extract(F.upper(text), r"(?U)\b(LABEL_[012])\b", 1), F.lit(""))
    word = F.nullif(
        F.regexp_extract(text, r"(?iU)\b(negative|neutral|positive|neg|neu|pos)\b", 1), F.lit(""))
    return F.coalesce(direct, raw_label(word))


def normalize_scores(scores: Column, chosen: Column) -> Column:
    """Exactly three labels, scores in [0,1], highest first.

    Unknown labels are dropped, the last entry of a label wins, and when nothing
    is positive the chosen label gets one.
    """

    named = F.transform(scores, lambda s: F.struct(
        raw_label(F.coalesce(s["label"], F.lit(""))).alias("label"), s["score"].alias("score")))
    last = lambda all_scores, name: F.coalesce(
        F.try_element_at(F.filter(all_scores, lambda s: s["label"] == name), F.lit(-1))["score"], F.lit(0.0))

    def ranked(raw: Column) -> Column:
        empty = F.array_max(raw) <= 0
        made = [F.struct(
            (-F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(empty & (chosen == name), 1.0).otherwise(raw[i])))).alias("down"),
            F.lit(i).alias("rank"), F.lit(name).alias("label")) for i, name in enumerate(lex.RAW_LABELS)]
        return F.transform(F.array_sort(F.array(*made)), lambda s: F.struct(
            s["label"].alias("label"), (-s["down"] + 0.0).alias("score")))

    return let(let(named, lambda all_scores: F.array(*[last(all_scores, n) for n in lex.RAW_LABELS])), ranked)


def prediction(answer: Column) -> Column:
    """Label, score, raw label, raw scores and status of one model answer.

    An answer whose label is not one of the three classes gives null.
    """
    return let(F.from_json(answer_json(answer), f"label string, scores {SCORES}"), _prediction)


def _prediction(parsed: Column) -> Column:
    label = raw_label(F.coalesce(parsed["label"], F.lit("")))

    def record(scores: Column) -> Column:
        own = F.filter(scores, lambda s: s["label"] == label)
        return F.struct(
            class_word(label).alias("sentiment_label"),
            F.get(own, F.lit(0))["score"].alias("sentiment_score"),
            label.alias("sentiment_raw_label"),
            F.to_json(scores).alias("sentiment_raw_scores"),
            F.lit("done").alias("status"),
        )

    scores = normalize_scores(F.coalesce(parsed["scores"], F.array().cast(SCORES)), label)
    return F.when(label.isin(lex.RAW_LABELS), let(scores, record))


def repaired_status(status: Column, label: Column) -> Column:
    """Status after repair: labelled rows are done, done rows without label wait."""
    now = F.lower(strip_space(F.coalesce(status, F.lit(""))))
    labelled = ~is_blank(label)
    filled = F.when(now == "", F.lit("pending")).otherwise(now)
    done = F.when(labelled & now.isin(lex.REPAIRABLE_STATUS), F.lit("done")).otherwise(filled)
    return F.when((done == "done") & ~labelled, F.lit("pending")).otherwise(done)


def is_unfinished(status: Column, again: bool = False) -> Column:
    return F.lit(True) if again else ~F.lower(strip_space(F.coalesce(status, F.lit("")))).isin(lex.FINISHED_STATUS)
