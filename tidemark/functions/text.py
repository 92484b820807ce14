"""Text cleaning as column expressions: whitespace, interface noise, emoji, validity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import lexicon as lex
from tidemark.functions.regex import (
    any_caseless, first_letters, holds_any, in_lines, independent_runs, let, literal, only_if, replace_all, replace_words,
    replace_words_any_case, whole_word)

SPACE = r"(?U)[\s\x1c-\x1f]+"
SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def squash(text: Column) -> Column:
    """Collapse all whitespace to single spaces and trim; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), F.lit(SPACE), F.lit(" ")))


def strip_space(text: Column) -> Column:
    """Trim every kind of whitespace from both ends."""
    return F.btrim(text, F.lit(SPACES))


def is_blank(text: Column) -> Column:
    """True for null, empty or whitespace-only values."""
    return strip_space(F.coalesce(text.cast("string"), F.lit(""))) == ""


def tidy_layout(text: Column) -> Column:
    """At most one empty line, single spaces, no tabs, no outer whitespace."""
    for needed, pattern, to in (("\n\n\n", r"\n{3,}", "\n\n"), ("  ", r" {2,}", " "), ("\t", r"\t", " ")):
        text = only_if(text, lambda t, n=needed: t.contains(n), lambda t, p=pattern, o=to: replace_all(t, [(p, o)]))
    return strip_space(text)


def _patterns(kinds) -> list[str]:
    return [p for kind, p in lex.UI_PATTERNS if kind in kinds]


def drop_interface_text(text: Column) -> Column:
    """Blank out buttons, relative times, reaction counts and page names."""
    steps = [(f"(?iU){p}", " ") for p in _patterns(lex.UI_KINDS)]
    return only_if(text, lambda t: holds_any(t, lex.UI_WORDS), lambda t: replace_all(t, steps))


def drop_urls(text: Column) -> Column:
    steps = [(f"(?iU){p}", " ") for p in _patterns(["url"])]
    return only_if(text, lambda t: holds_any(t, ["://", "www."]), lambda t: replace_all(t, steps))


def drop_phone_numbers(text: Column) -> Column:
    steps = [(p, " ") for p in _patterns(["phone_number"])]
    return only_if(text, lambda t: t.contains("0") | t.contains("+84"), lambda t: replace_all(t, steps))


def drop_hashtags(text: Column) -> Column:
    """Blank out post codes first, then every other hashtag."""
    steps = [(f"(?iU){p}", " ") for p in _patterns(["hashtag_confession"])] + [(r"(?U)#\w+", " ")]
    return only_if(text, lambda t: t.contains("#"), lambda t: replace_all(t, steps))


def mask_surname_led_names(text: Column) -> Column:
    """Mask ``surname Given Name`` runs and merge neighbouring masks."""
    word = f"[{lex.NAME_START_VI}][a-z{lex.VI_LOWER}]+"
    named = rf"(?U)\b(?:{'|'.join(lex.CLEANING_SURNAMES)})\s+{word}(?:\s+{word})*"
    tag = literal(lex.NAME_TAG_VI)
    steps = [(named, lex.NAME_TAG_VI), (rf"(?U)(?:{tag}\s*){{2,}}", lex.NAME_TAG_VI + " ")]
    words = [*lex.CLEANING_SURNAMES, lex.NAME_TAG_VI]
    return only_if(text, lambda t: holds_any(t, words), lambda t: replace_all(t, steps))


def _table(block: str) -> dict[str, str]:
    return dict(line.split(" ", 1) for line in block.strip().splitlines())


def emoji_to_words(text: Column) -> Column:
    """Put the feeling word of each known emoji, between spaces, in its place."""
    table = {e: f" {w} " for e, w in _table(lex.EMOJI_WORDS).items()}
    some = f"(?s){first_letters(table)}."
    return in_lines(text, lambda t: t.rlike(some), lambda t: replace_words(t, table, flags="", left="", right=""))


def shorten_lengthened(text: Column) -> Column:
    """Runs of three or more letters keep two; repeated marks and laughter shrink."""
    runs = [
        (rf"(\S)\1{{2,}}(?<=[a-z{lex.VI_LOWER}])", "$1$1"),
        (rf"(\S)\1{{2,}}(?<=[{lex.REPEATABLE_UPPER}])", "$1$1"),
        (r"([!?.])\1{2,}", "$1"),
    ]
    laughter = [(f"({syllable}){{3,}}", syllable * 2) for syllable in ("ha", "he", "hi", "hu")]
    shorter = only_if(text, lambda t: t.rlike(r"(\S)\1\1"), lambda t: replace_all(t, runs))
    return only_if(shorter, lambda t: t.rlike("h([aeiu])h\\1h\\1"), lambda t: replace_all(t, laughter))


def expand_safe_abbreviations(text: Column, table=None) -> Column:
    """Whole-word, case-insensitive expansion, entry after entry."""
    pairs = lex.SAFE_ABBREVIATIONS if table is None else list(table)
    keys = {k for k, _ in pairs}
    any_key = rf"(?U){any_caseless(keys, r'(?<!\w)')}(?!\w)"

    def expand(t: Column) -> Column:
        for run in independent_runs(pairs):
            key = next(iter(run))
            if len(run) > 1:
                t = replace_words_any_case(t, run)
            else:
                one = [(whole_word(key), run[key])]
                t = only_if(t, lambda c, k=key: holds_any(c, [k]), lambda c, o=one: replace_all(c, o))
        return t

    return only_if(text, lambda t: t.rlike(any_key), expand)


def clean_post(text: Column) -> Column:
    """The nine cleaning steps of a collected post, in order."""
    for step in (drop_interface_text, drop_urls, drop_phone_numbers, drop_hashtags,
                 mask_surname_led_names, emoji_to_words, shorten_lengthened,
                 expand_safe_abbreviations, tidy_layout):
        text = step(text)
    return text


def validity(text: Column, min_length: int = lex.MIN_LENGTH,
             max_special: float = lex.MAX_SPECIAL_RATIO) -> Column:
    """``struct(is_valid, reason)``; the first rule that fails gives the reason."""
    # plain letters go first with a quick class, so the long one sees little text
    rest = F.regexp_replace(text, F.lit(r"(?U)[a-zA-Z0-9\s\x1c-\x1f]+"), F.lit(""))
    special = F.length(F.regexp_replace(rest, F.lit(f"[{lex.VI_LOWER}{lex.VI_UPPER}]+"), F.lit("")))
    untagged = F.length(strip_space(F.replace(text, F.lit(lex.NAME_TAG_VI), F.lit(""))))
    facts = F.struct(text.alias("t"), F.length(text).alias("n"), special.alias("k"), untagged.alias("u"))

    def said(template: str, f: Column) -> Column:
        out = F.replace(F.lit(template), F.lit("{n}"), f["n"].cast("string"))
        return F.replace(out, F.lit("{k}"), f["k"].cast("string"))

    def reason(f: Column) -> Column:
        return (F.when(f["n"] < min_length, said(lex.REASON_SHORT, f))
                .when((f["n"] > 0) & (f["k"] / f["n"] > max_special), said(lex.REASON_SPECIAL, f))
                .when(f["u"] < min_length, F.lit(lex.REASON_ONLY_TAG))
                .when(f["t"].rlike(r"(?U)^[\d\s\.,]+$"), F.lit(lex.REASON_DIGITS))
                .when(f["t"].rlike(r"(?U)^[\s\W]+$"), F.lit(lex.REASON_PUNCT))
                .otherwise(F.lit(lex.REASON_OK)))

    return let(let(facts, reason), lambda r: F.struct((r == lex.REASON_OK).alias("is_valid"), r.alias("reason")))


def content_lines(text: Column) -> Column:
    """Keep the lines that are content: no blanks, buttons, counters, dates or prompts."""
    trimmed = F.transform(F.split(text, "\n"), strip_space)

    def is_content(line: Column) -> Column:
        prompt = F.lit(False)
        for start in lex.COMPOSER_PROMPTS:
            prompt = prompt | line.startswith(start)
        return ((line != "") & ~line.isin(lex.NOISE_LINES) & ~line.rlike(r"(?U)^\d+$")
                & ~line.rlike(f"(?iU){lex.DATE_LINE}") & ~prompt)

    return F.array_join(F.filter(trimmed, is_content), "\n")


def looks_like_date(text: Column) -> Column:
    """Short text that names a date or a relative time."""
    line = strip_space(text)
    return (line != "") & (F.length(line) <= 40) & line.rlike(f"(?i)(?u){lex.DATE_WORDS}")


def comment_count_text(text: Column) -> Column:
    """The count, as written, before ``bình luận`` or ``comments``."""
    return strip_space(F.regexp_extract(
        squash(text), rf"(?iu)({lex.COUNT_TEXT})\s*(?:bình luận|comments?)(?![A-Za-z0-9_])", 1))


def reaction_total_text(text: Column) -> Column:
    """The total, as written, after ``Tất cả cảm xúc`` or ``All reactions``."""
    return strip_space(F.regexp_extract(
        squash(text), rf"(?iu)(?:Tất cả cảm xúc|All reactions)[:\s]*({lex.COUNT_TEXT})", 1))


def truncate(text: Column, limit: int = lex.SUMMARY_LENGTH, empty: str = "") -> Column:
    """One-line start of ``text`` with dots when the text is longer than ``limit``."""
    start = F.substring(F.replace(strip_space(text), F.lit("\n"), F.lit(" ")), 1, limit)
    dots = F.when(F.length(text) > limit, F.lit("...")).otherwise(F.lit(""))
    return F.coalesce(F.nullif(F.concat(start, dots), F.lit("")), F.lit(empty))


def segmented(segments: Column, text: Column, segment: Callable[[Column], Column] = lambda c: c) -> Column:
    """The segmented text, made from ``text`` where the stored one is blank."""
    return F.when(is_blank(segments), segment(text)).otherwise(segments)


def words(text: Column) -> Column:
    """Whitespace tokens; a text without any gives one unknown token."""
    return F.split(F.coalesce(F.nullif(squash(text), F.lit("")), F.lit(lex.UNK)), " ")


def words_and_marks(text: Column, lower: bool = True) -> Column:
    """Words and single punctuation marks."""
    clean = F.lower(squash(text)) if lower else squash(text)
    return F.regexp_extract_all(clean, F.lit(r"(?U)\w+|[^\w\s]"), F.lit(0))


def hashtags(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)(?<!\w)#\w+"), F.lit(0))


def is_post_code(tag: Column) -> Column:
    hit = F.lit(False)
    for pattern in lex.IGNORED_HASHTAGS:
        hit = hit | tag.rlike(f"(?iU){pattern}")
    return hit
