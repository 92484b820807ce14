"""Voting over annotator labels, row by row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import lexicon as lex
from tidemark.functions.labels import clean_label
from tidemark.functions.regex import let


def majority(labels: Sequence[Column]) -> Column:
    """The label with at least two votes, else blank.

    Equal counts keep the annotator order, which matters beyond three votes.
    """
    votes = F.filter(F.array(*[F.trim(F.coalesce(c.cast("string"), F.lit(""))) for c in labels]), lambda x: x != "")

    def pick(all_votes: Column) -> Column:
        count = lambda x: F.size(F.filter(all_votes, lambda y: y == x))
        top = F.array_max(F.transform(all_votes, count))
        winners = F.filter(all_votes, lambda x: count(x) == top)
        return F.when(top >= 2, F.get(winners, F.lit(0))).otherwise(F.lit(""))

    return F.coalesce(let(votes, pick), F.lit(""))


def consensus(df: DataFrame, a: str, b: str) -> DataFrame:
    """Two equal labels give an automatic label; all other rows go to a person."""
    x, y = clean_label(F.col(a)), clean_label(F.col(b))
    agreed = (x != "") & (x == y)
    return df.withColumns({"is_human": ~agreed, "label": F.when(agreed, x).otherwise(F.lit(""))})


def plurality(votes: Mapping[str, Column], priority: Sequence[str] = tuple(lex.VOTE_PRIORITY)) -> Column:
    """The most frequent code; a tie goes to the first source in ``priority`` that
    voted for a winner; null without votes."""
    count = lambda c: sum((F.when(v == c, 1).otherwise(0) for v in votes.values()), F.lit(0))
    mine = {s: F.when(votes[s].isNotNull(), count(votes[s])) for s in priority}
    top = F.greatest(F.lit(0), *mine.values())
    return F.coalesce(*[F.when(mine[s] == top, votes[s]) for s in priority])


def completeness(votes: Mapping[str, Column]) -> Column:
    """``complete``, ``partial`` or ``failed`` by the number of votes."""
    given = sum((v.isNotNull().cast("int") for v in votes.values()), F.lit(0))
    return F.when(given == len(votes), "complete").when(given > 0, "partial").otherwise("failed")


def error_map(errors: Mapping[str, Column]) -> Column:
    """Only the sources that failed; null if none did."""
    pairs = F.create_map(*[x for n, e in errors.items() for x in (F.lit(n), e.cast("string"))])
    return let(F.map_filter(pairs, lambda k, v: v.isNotNull()), lambda m: F.when(F.size(m) > 0, m))
