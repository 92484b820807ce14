"""Masking of person names as column expressions over character spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import lexicon as lex
from tidemark.functions.regex import any_caseless, any_of, cut_at, let, literal, replace_all

SPANS = "array<struct<start:int,end:int>>"
_WORD = r"[\w\x{00C0}-\x{1EF9}]*"
_CAPITAL_RUN = rf"(?U)^[{lex.NAME_UPPER}]{_WORD}(?:\s+[{lex.NAME_UPPER}]{_WORD}){{0,3}}"


def mask_mentions(text: Column, mask: str = lex.NAME_TAG) -> Column:
    """Mask ``@[id:n:name]`` mentions and profile links."""
    return replace_all(text, [
        (r"@\[\d+:\d+:[^\]]+\]", mask),
        (r"(?iU)(?:https?://)?(?:www\.)?facebook\.com/\S+", mask),
    ])


def mask_name_at_start(text: Column, mask: str = lex.NAME_TAG) -> Column:
    """Mask a surname-led run of two to four capitalised words at the very start."""
    names = "|".join(lex.SURNAMES)
    pattern = rf"(?U)^(?:{names})(?:\s+[{lex.NAME_UPPER}]{_WORD}){{1,3}}"
    masked = rf"(?U)^\s*{literal(mask)}"
    return let(text, lambda t: F.when(t.rlike(masked), t).otherwise(
        F.regexp_replace(t, F.lit(pattern), F.lit(mask))))


def _lower_case_run(after: Column) -> Column:
    """A surname-led run of two or three words that holds no function word, with the marks and digits before it."""
    word = r"[^\W\d_]+"
    stop = any_of(lex.FUNCTION_WORDS)
    follow = rf"\s+(?!(?:{stop})(?![^\W\d_])){word}"
    return F.regexp_extract(
        after, rf"(?iU)^[\W\d_]*(?:{any_of(lex.SURNAMES)})(?![^\W\d_])(?:{follow}){{1,2}}", 0)


def honorific_spans(text: Column) -> Column:
    """Spans (0-based, end exclusive) of the names that follow an honorific."""
    return let(text, _honorific_spans)


def _honorific_spans(text: Column) -> Column:
    title = any_caseless(lex.HONORIFICS) + r"\b"
    sizes = F.transform(cut_at(text, "(?U)", title), lambda p, i: F.struct(
        F.length(p).alias("n"), (i % 2 == 1).alias("hit")))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends"))

    def step(acc: Column, piece: Column) -> Column:
        at = acc["at"] + piece["n"]
        ends = F.when(piece["hit"], F.array_append(acc["ends"], at)).otherwise(acc["ends"])
        return F.struct(at.alias("at"), ends.alias("ends"))

    ends = F.aggregate(sizes, begin, step, lambda acc: acc["ends"])

    def span(end: Column) -> Column:
        def name_in(after: Column) -> Column:
            start = F.length(text) - F.length(after)
            upper = F.nullif(F.regexp_extract(after, _CAPITAL_RUN, 0), F.lit(""))
            size = F.length(F.coalesce(upper, _lower_case_run(after)))
            return F.struct(start.cast("int").alias("start"), (start + size).cast("int").alias("end"))

        rest = F.substring(text, end + 1, F.length(text))
        return let(F.regexp_replace(rest, F.lit(r"(?U)^\s+"), F.lit("")), name_in)

    return F.filter(F.transform(ends, span), lambda s: s["end"] > s["start"])


def mask_titled_names(text: Column, mask: str = lex.NAME_TAG) -> Column:
    """Mask the names after an honorific from left to right, capitalised runs first.

    A title inside a name that is masked already is part of that name, unlike in
    ``honorific_spans``, where it begins a span of its own that joins the other's.
    """
    title = rf"(?U)({any_caseless(lex.HONORIFICS)})\b"
    letter, family = r"[^\W\d_]", any_caseless([s.lower() for s in lex.SURNAMES])
    stop = any_caseless(lex.FUNCTION_WORDS)
    run = rf"[{lex.NAME_UPPER}]{_WORD}(?:\s+[{lex.NAME_UPPER}]{_WORD}){{0,3}}"
    follow = rf"\s+(?!{stop}(?!{letter})){letter}+"
    return replace_all(text, [
        (rf"{title}(\s+){run}", f"$1$2{mask}"),
        (rf"{title}(\s*+)[\W\d_]*+{family}(?!{letter})(?:{follow}){{1,2}}", f"$1$2{mask}"),
    ])


def token_honorific_phrases(tokens: Column) -> Column:
    """Names after an honorific token in ``array<struct<token,tag>>``.

    The capitalised start of the next token wins; else up to three plain words
    from the following tokens, surname first, stopping at function words.
    """
    stop = rf"(?iU)^(?:{any_of(lex.FUNCTION_WORDS)})$"
    titles = [t for t in lex.TOKEN_HONORIFICS]

    def lower_name(i: Column) -> Column:
        following = F.slice(tokens, i + 2, F.lit(3))
        flat = F.flatten(F.transform(following, lambda t: F.split(t["token"], " ")))
        words = F.slice(flat, 1, 3)
        bad = F.array_position(
            F.transform(words, lambda w: ~w.rlike(r"(?U)^[^\W\d_]+$") | w.rlike(stop)), True)
        kept = F.when(bad == 0, words).otherwise(F.slice(words, F.lit(1), (bad - 1).cast("int")))
        led = F.lower(F.get(kept, 0)).isin([s.lower() for s in lex.SURNAMES])
        return F.when((F.size(kept) >= 2) & led, F.array_join(kept, " ")).otherwise(F.lit(""))

    def phrase(token: Column, i: Column) -> Column:
        nxt = F.get(tokens, i + 1)["token"]
        run = F.coalesce(F.regexp_extract(nxt, _CAPITAL_RUN, 0), F.lit(""))
        named = F.when(run != "", run).otherwise(lower_name(i))
        return F.when(F.lower(token["token"]).isin(titles) & nxt.isNotNull(), named).otherwise(F.lit(""))

    return F.filter(F.transform(tokens, phrase), lambda p: p != "")


def tagged_phrases(tokens: Column, extend: bool = True) -> Column:
    """Person-tagged tokens; with ``extend`` also the capitalised first word of a
    following untagged multi-word token."""

    def phrases(token: Column, i: Column) -> Column:
        person = token["tag"].isin("B-PER", "I-PER")
        nxt = F.get(tokens, i + 1)
        first = F.split(nxt["token"], " ")[0]
        swallowed = ((nxt["tag"] == "O") & nxt["token"].contains(" ") & first.rlike(r"(?U)^\p{Lu}"))
        both = F.array(token["token"], first)
        one = F.array(token["token"])
        more = F.when(F.coalesce(swallowed, F.lit(False)), both).otherwise(one) if extend else one
        return F.when(person, more).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(tokens, phrases))


def phrase_spans(text: Column, phrases: Column) -> Column:
    """Span of the first occurrence of each phrase; absent phrases give none."""
    return let(text, lambda t: _phrase_spans(t, phrases))


def _phrase_spans(text: Column, phrases: Column) -> Column:
    spans = F.transform(phrases, lambda p: F.struct(
        (F.position(p, text) - 1).cast("int").alias("start"),
        (F.position(p, text) - 1 + F.length(p)).cast("int").alias("end")))
    return F.filter(spans, lambda s: s["start"] >= 0)


def replace_spans(text: Column, spans: Column, mask: str = lex.NAME_TAG, bridge_gaps: bool = True) -> Column:
    """Mask the union of the spans; with ``bridge_gaps`` spans split only by
    whitespace are one."""
    return let(text, lambda t: let(spans, lambda s: _replace_spans(t, s, mask, bridge_gaps)))


def _replace_spans(text: Column, spans: Column, mask: str, bridge_gaps: bool) -> Column:
    ordered = F.array_sort(F.coalesce(spans, F.array().cast(SPANS)))
    begin = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"), F.lit(False).alias("open"))

    def step(acc: Column, span: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(span["start"] - acc["at"], F.lit(0)))
        joined = span["start"] <= acc["at"]
        if bridge_gaps:
            joined = joined | gap.rlike(r"(?U)^\s*$")
        same = acc["open"] & joined
        done = F.when(same, acc["done"]).otherwise(F.concat(acc["done"], gap, F.lit(mask)))
        return F.struct(done.alias("done"), F.greatest(span["end"], acc["at"]).alias("at"),
                        F.lit(True).alias("open"))

    def finish(acc: Column) -> Column:
        return F.concat(acc["done"], F.substring(text, acc["at"] + 1, F.length(text)))

    return F.when(F.size(ordered) == 0, text).otherwise(F.aggregate(ordered, begin, step, finish))


def anonymize(text: Column, ner_spans: Column | None = None, mask: str = lex.NAME_TAG,
              bridge_gaps: bool = True, in_order: bool = False) -> Column:
    """Mentions, then honorific and recogniser spans, then a name at the start.

    ``ner_spans`` are offsets into the text after ``mask_mentions``. With
    ``in_order`` (and no ``ner_spans``) honorific names are masked from left to
    right by ``mask_titled_names``; else overlapping spans are one.
    """
    if in_order and ner_spans is not None:
        raise ValueError("recogniser spans are joined with honorific spans; they have no order")

    def mask_names(masked: Column) -> Column:
        if in_order:
            return mask_titled_names(masked, mask)
        spans = honorific_spans(masked)
        if ner_spans is not None:
            spans = F.concat(spans, F.coalesce(ner_spans, F.array().cast(SPANS)))
        return replace_spans(masked, spans, mask, bridge_gaps)

    return mask_name_at_start(let(mask_mentions(text, mask), mask_names), mask)


def anonymize_tokens(text: Column, tokens: Column, extend: bool = True, mask: str = lex.NAME_TAG) -> Column:
    """The same over tagged tokens of the masked text; first occurrences only."""
    phrases = F.concat(tagged_phrases(tokens, extend), token_honorific_phrases(tokens))
    masked = let(mask_mentions(text, mask), lambda t: replace_spans(t, phrase_spans(t, phrases), mask))
    return mask_name_at_start(masked, mask)
