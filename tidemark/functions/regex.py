"""Building blocks for regular-expression work on columns.

Java patterns are ASCII by default; the ``(?U)`` prefix gives ``\\w \\d \\s \\b``
their Unicode meaning and ``(?iU)`` also folds case in every script.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPECIAL = re.compile(r"([\\^$.|?*+()\[\]{}\-#&~ ])")


def literal(text: str) -> str:
    """``text`` escaped for a Java pattern."""
    return _SPECIAL.sub(r"\\\1", text)


def any_of(words) -> str:
    """Alternation of literal words, the longest first; single characters as a class."""
    longest = sorted(set(words), key=lambda w: (-len(w), w))
    choices = [literal(w) for w in longest if len(w) > 1]
    singles = "".join(f"\\x{{{ord(w):X}}}" for w in longest if len(w) == 1)
    return "|".join(choices + ([f"[{singles}]"] if singles else []))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def replace_all(text: Column, steps) -> Column:
    """Apply ``(pattern, replacement)`` steps one after the other."""
    for pattern, replacement in steps:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(replacement))
    return text


MARK = "\ufdd0"  # a code point that is never a character


def cut_at(text: Column, flags: str, pattern: str) -> Column:
    """The text in pieces: odd positions (from zero) are the matches of ``pattern``."""
    plain = F.translate(text, MARK, "\ufffd")
    return F.split(F.regexp_replace(plain, F.lit(f"{flags}(?:{pattern})"), F.lit(f"{MARK}$0{MARK}")), MARK)


def replace_with(text: Column, flags: str, pattern: str, replace: Callable[[Column], Column]) -> Column:
    """Replace each match of ``pattern`` by a column computed from the match."""
    pieces = cut_at(text, flags, pattern)
    return F.array_join(F.transform(
        pieces, lambda p, i: F.when(i % 2 == 1, replace(p)).otherwise(p)), "")


def first_letters(words) -> str:
    """Look-ahead for the first character of any of the words.

    Put before a look-behind or a long alternation, it settles most positions
    with one class test; many characters are tested as one range.
    """
    firsts = sorted({w[0] for w in words if w})
    if len(firsts) > 30:
        return f"(?=[\\x{{{ord(firsts[0]):X}}}-\\x{{{ord(firsts[-1]):X}}}])"
    return "(?=[" + "".join(f"\\x{{{ord(c):X}}}" for c in firsts) + "])"


@lru_cache(maxsize=None)
def _cases(char: str) -> str:
    same = {c for c in map(chr, range(0x3000)) if c.lower() == char.lower() or c.upper() == char.upper()}
    return "".join(sorted(same | {char}))


def caseless(word: str) -> str:
    """A word in any case, as character classes; Java tests these much faster than ``(?i)``."""
    return "".join("[" + "".join(f"\\x{{{ord(c):X}}}" for c in _cases(char)) + "]" for char in word)


def any_caseless(words, left: str = "") -> str:
    """Alternation of words in any case, the longest first, with a quick test of
    the first letter before the condition ``left``."""
    longest = sorted(set(words), key=lambda w: (-len(w), w))
    firsts = first_letters({c for w in longest for c in _cases(w[0])})
    return f"{firsts}{left}(?:{'|'.join(caseless(w) for w in longest)})"


def whole_word(word: str) -> str:
    """A word in any case with no word character on either side.

    The word comes first and the look-behind after it, which Java tests much
    faster than a look-behind at every position.
    """
    return rf"(?sU){caseless(word)}(?<!\w.{{{len(word)}}})(?!\w)"


def holds_any(text: Column, words) -> Column:
    """Whether the text holds one of the words in any case (a cheap pre-check)."""

    def found(folded: Column) -> Column:
        hit = F.lit(False)
        for word in words:
            hit = hit | folded.contains(word.upper().lower())
        return hit

    return let(F.lower(F.upper(text)), found)


def only_if(text: Column, check: Callable[[Column], Column], change: Callable[[Column], Column]) -> Column:
    """``change`` where ``check`` holds; other texts pass through untouched."""
    return let(text, lambda t: F.when(check(t), change(t)).otherwise(t))


def in_lines(text: Column, check: Callable[[Column], Column], change: Callable[[Column], Column]) -> Column:
    """``change`` line by line where ``check`` holds, for a change that neither looks nor reaches over a line break."""
    return only_if(text, check, lambda t: F.array_join(F.transform(F.split(t, "\n", -1), lambda line: F.when(check(line), change(line)).otherwise(line)), "\n"))


def literal_map(table: Mapping[str, str]) -> Column:
    """A constant map column."""
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def replace_words(text: Column, table: Mapping[str, str], flags: str = "(?U)",
                  left: str = r"(?<!\w)", right: str = r"(?!\w)") -> Column:
    """Replace whole keys of ``table`` in one pass, the longest key first."""
    if not table:
        return text
    lookup = literal_map(table)
    pattern = f"{first_letters(table)}{left}(?:{any_of(table)}){right}"
    return replace_with(text, flags, pattern, lambda p: F.coalesce(F.try_element_at(lookup, p), p))


def independent_runs(pairs) -> list[dict[str, str]]:
    """Cut an ordered replacement list into runs that one pass each can apply.

    Inside a run no result holds a key and every key is one word, so the order
    of its entries does not matter; a key of several words is a run of its own.
    """
    runs: list[dict[str, str]] = []
    for key, value in pairs:
        last = runs[-1] if runs else None
        made = {w for v in (last or {}).values() for w in v.split()}
        open_run = (last is not None and " " not in key and not any(" " in k for k in last)
                    and key not in last and key not in made and not set(value.split()) & (set(last) | {key}))
        if open_run:
            last[key] = value
        else:
            runs.append({key: value})
    return runs


def replace_words_any_case(text: Column, table: Mapping[str, str]) -> Column:
    """One pass over whole words in any case; keys are lower-case."""
    pattern = any_caseless(table, r"(?<!\w)") + r"(?!\w)"
    lookup = literal_map(table)
    return replace_with(text, "(?U)", pattern, lambda p: F.coalesce(F.try_element_at(lookup, F.lower(p)), p))
