"""Benchmark decontamination with one Aho-Corasick automaton.

Texts and benchmark items are normalised alike: A-Z to lower case, words are
runs of digits, letters a-z and characters beyond ASCII. The automaton holds
every window of ``window`` consecutive item words (a shorter item is one
window) and reads each normalised text once. Hits are mapped back to offsets
in the original text.

The automaton's size follows the benchmark, not the documents. A benchmark of
more than ``slice_bytes`` is cut into slices of items by hash; each worker then
holds one slice's automaton at a time.
"""

from __future__ import annotations

import re
import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.worker import keep

WORD = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
RESULT = "struct<n_words:bigint,n_hit:bigint,items:array<string>,spans:array<struct<start:int,end:int>>>"


def normal_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_NORMAL).split()


def windows(text: str, window: int) -> list[bytes]:
    """The item's windows, as normalised words between single spaces."""
    words = normal_words(text)
    if not words:
        return []
    n = min(window, len(words))
    return [b" " + b" ".join(words[i:i + n]) + b" " for i in range(len(words) - n + 1)]


def automaton(items: list[tuple[str, str]], window: int) -> tuple:
    """An automaton over all windows; a match gives the window's length in words and bytes, and its items."""
    owners: dict[bytes, set[str]] = {}
    for item, text in items:
        for key in windows(text, window):
            owners.setdefault(key, set()).add(item)
    if not owners:
        return None
    made = ahocorasick.Automaton()
    for key, who in owners.items():
        made.add_word(key.decode("latin-1"), (key.count(b" ") - 1, len(key), sorted(who)))
    made.make_automaton()
    return made


def _slice(shared, window: int, key: str):
    """The automaton of one slice; a worker keeps the last one it built."""
    return keep(f"automaton {key}", lambda: automaton(shared.value, window))


def _spans(text: str, hit: np.ndarray) -> list[dict]:
    """Runs of hit words as code point ranges of the original text."""
    found = [m.span() for m in WORD.finditer(text)]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [{"start": found[a][0], "end": found[b - 1][1]} for a, b in zip(edge[::2], edge[1::2])]


def judge_text(text: str | None, machines: list) -> dict:
    """Word count, hit words, matching items and original spans of one text."""
    words = normal_words(text or "")
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    hit = items = at = None
    for machine in machines:
        if machine is None or not words:
            continue
        for end, (n, size, who) in machine.iter(line):
            if hit is None:
                hit, items = np.zeros(len(words), bool), set()
                at = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
            first = int(np.searchsorted(at, end - size + 1))
            hit[first:first + n] = True
            items.update(who)
    if hit is None:
        return {"n_words": len(words), "n_hit": 0, "items": [], "spans": []}
    return {"n_words": len(words), "n_hit": int(hit.sum()), "items": sorted(items), "spans": _spans(text, hit)}


def contamination(text: Column, benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = 13,
                  slice_bytes: int = 4 << 20) -> Column:
    """Struct of ``n_words``, ``n_hit``, ``items`` (sorted as strings) and ``spans`` for each text.

    Null and empty texts have no words. Items without an id or without words
    match nothing; rows that repeat an item id belong to one item.
    """
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("words")).dropna()
    size = rows.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    slices = 1 + size // slice_bytes
    shared = [(spark.sparkContext.broadcast([tuple(r) for r in rows.filter(F.pmod(F.xxhash64("item"), F.lit(slices)) == i).collect()]),
               uuid.uuid4().hex) for i in range(slices)]

    @F.arrow_udf(RESULT)
    def scan(column: pa.Array) -> pa.Array:
        texts = column.to_pylist()
        if len(shared) == 1:
            machine = _slice(shared[0][0], window, shared[0][1])
            found = [judge_text(t, [machine]) for t in texts]
        else:
            parts = [[judge_text(t, [_slice(b, window, key)]) for t in texts] for b, key in shared]
            found = [_merge(t, p) for t, p in zip(texts, zip(*parts))]
        return pa.array(found, pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
                                          ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]))

    return scan(text)


def _merge(text: str | None, parts: tuple) -> dict:
    """One verdict from those of several slices."""
    hits = [p for p in parts if p["n_hit"]]
    if len(hits) < 2:
        return hits[0] if hits else parts[0]
    found = np.array([m.span() for m in WORD.finditer(text)])
    hit = np.zeros(len(found), bool)
    for p in hits:
        for s in p["spans"]:
            hit |= (found[:, 0] >= s["start"]) & (found[:, 1] <= s["end"])
    return {"n_words": parts[0]["n_words"], "n_hit": int(hit.sum()), "items": sorted(set().union(*(p["items"] for p in hits))),
            "spans": _spans(text, hit)}


def is_contaminated(found: Column) -> Column:
    """At least a twentieth of the words is hit."""
    return (found["n_hit"] > 0) & (20 * found["n_hit"] >= found["n_words"])
