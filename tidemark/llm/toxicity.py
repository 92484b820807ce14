"""Toxicity by a lexicon that tolerates misspellings, and the hits' contexts.

The lexicon is learned from labelled rows: words and stems whose share among
toxic documents is ``lift`` times that among others. It is kept as a trie. The
Levenshtein automata of all terms are intersected with the trie as sets of
(node, errors) states; sets and steps are remembered, so a word is matched by
one table step a letter. Terms that are whole words allow ``errors`` edits by
their length, stems only exact starts.

A hit counts as quoted if quotation marks stand on both sides of it within a
window of words. A logistic model over exact and misspelled hits, quoted and
open, and the densest stretch of hits gives the score.

Labels are used from about ``max_toxic`` toxic and ``max_clean`` other rows at
most (where there are more, those below a hash threshold); everything else
covers all rows.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.worker import keep
from tidemark.llm.words import Words, segments

MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”„«»‘’…¡¿"
QUOTES = ('"', "“", "”", "„", "«", "»")
FEATURES = "struct<exact_open:int,exact_quoted:int,near_open:int,near_quoted:int,dense:int>"
_FEATURES = pa.struct([(n, pa.int32()) for n in ("exact_open", "exact_quoted", "near_open", "near_quoted", "dense")])
CAP = 8          # hits of one kind that are told apart
CONTEXT = 8      # words on each side that may hold the quotation marks
STRETCH = 20     # words of a dense stretch
KNOWN = 300_000  # words that a worker remembers


def bare(word: str) -> str:
    return word.lower().strip(MARKS)


@dataclass(frozen=True)
class Term:
    text: str
    stem: bool

    @property
    def errors(self) -> int:
        return 0 if self.stem or len(self.text) < 5 else 1 if len(self.text) < 9 else 2


class Matcher:
    """The lexicon trie with its Levenshtein automata, made deterministic as words are read."""

    def __init__(self, terms: list[Term]):
        self.child: list[dict[str, int]] = [{}]
        self.end: list[Term | None] = [None]
        self.allow = [0]
        for t in terms:
            node = 0
            path = [0]
            for c in t.text:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.end.append(None)
                    self.allow.append(0)
                node = self.child[node][c]
                path.append(node)
            old = self.end[node]
            self.end[node] = t if old is None or t.stem else old
            for n in path:
                self.allow[n] = max(self.allow[n], t.errors)
        self.numbers: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.open: list[int] = []  # errors of the best stem that ends here, or -1
        self.whole: list[int] = []  # the same for whole words
        self.first = self._state({(0, 0)})

    def _state(self, found: set) -> int:
        """The state of these trie places, with letters of terms left out at a cost."""
        todo = list(found)
        while todo:
            node, e = todo.pop()
            for n in self.child[node].values():
                if e < self.allow[n] and (n, e + 1) not in found:
                    found.add((n, e + 1))
                    todo.append((n, e + 1))
        key = frozenset(found)
        if key not in self.numbers:
            self.numbers[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            ends = [(self.end[n], e) for n, e in key if self.end[n] is not None and e <= self.end[n].errors]
            self.open.append(min((e for t, e in ends if t.stem), default=-1))
            self.whole.append(min((e for t, e in ends if not t.stem), default=-1))
        return self.numbers[key]

    def _step(self, state: int, c: str) -> int:
        found = set()
        for node, e in self.sets[state]:
            if e < self.allow[node]:
                found.add((node, e + 1))  # a letter too many
            for letter, n in self.child[node].items():
                if letter == c:
                    found.add((n, e))
                elif e < self.allow[n]:
                    found.add((n, e + 1))  # a wrong letter
        made = self.steps[state][c] = self._state(found) if found else -1
        return made

    def match(self, word: str) -> int:
        """0 for no hit, 1 for an exact one, 2 for a misspelled one."""
        state = self.first
        for c in word:
            step = self.steps[state].get(c)
            state = self._step(state, c) if step is None else step
            if state < 0:
                return 0
            if self.open[state] == 0:
                return 1
        errors = self.whole[state]
        return 0 if errors < 0 or not word else 1 if errors == 0 else 2


@dataclass
class Model:
    terms: list[Term]
    weights: list[float] = field(default_factory=lambda: [0.0] * 6)
    key: str = ""


class _Worker:
    """A matcher and the words that it has judged."""

    def __init__(self, terms: list[Term]):
        self.matcher, self.known = Matcher(terms), {}

    def codes(self, w: Words) -> np.ndarray:
        ids, first, back = np.unique(w.ids, return_index=True, return_inverse=True)
        keys = ids.tolist()
        found = [self.known.get(k) for k in keys]
        missing = [i for i, v in enumerate(found) if v is None]
        if missing:
            if len(self.known) > KNOWN:
                self.known = {}
            data, starts, ends = w.data.tobytes(), w.starts[first].tolist(), w.ends[first].tolist()
            for i in missing:
                word = data[starts[i]:ends[i]].decode("utf-8", "replace")
                found[i] = self.known[keys[i]] = self.matcher.match(bare(word))
        return np.array(found, np.int8)[back] if len(keys) else np.zeros(0, np.int8)


def _worker(model: Model) -> _Worker:
    return keep(f"lexicon {model.key}", lambda: _Worker(model.terms))


def _features(w: Words, codes: np.ndarray) -> np.ndarray:
    """Rows of hits by kind, and most hits in a stretch; counts up to CAP."""
    out = np.zeros((w.rows, 5), np.int32)
    at = np.flatnonzero(codes)
    for i in at.tolist():
        row = w.row[i]
        low, high = max(i - CONTEXT, w.bounds[row]), min(i + CONTEXT, w.bounds[row + 1] - 1)
        before = w.data[w.starts[low]:w.ends[i]].tobytes().decode("utf-8", "replace").rstrip("".join(QUOTES))
        after = w.data[w.starts[i]:w.ends[high]].tobytes().decode("utf-8", "replace").lstrip("".join(QUOTES))
        quoted = any(q in before for q in QUOTES) and any(q in after for q in QUOTES)
        out[row, (0 if codes[i] == 1 else 2) + quoted] += 1
    if len(at):
        near = np.searchsorted(at, np.minimum(at + STRETCH, w.bounds[w.row[at] + 1])) - np.arange(len(at))
        np.maximum.at(out[:, 4], w.row[at], near.astype(np.int32))
    return np.minimum(out, CAP)


def features(text: Column, model: Model) -> Column:
    """Struct of the hits of each text; empty and null texts have none."""
    shared = _shared(model)

    @F.arrow_udf(FEATURES)
    def run(column: pa.Array) -> pa.Array:
        worker = _worker(shared.value)
        parts = [_features(w, worker.codes(w)) for w in segments(column, True)]
        rows = np.concatenate(parts) if parts else np.zeros((0, 5), np.int32)
        return pa.StructArray.from_arrays([pa.array(rows[:, i], pa.int32()) for i in range(5)], [f.name for f in _FEATURES])

    return run(text)


def _shared(value):
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession().sparkContext.broadcast(value)


def score(found: Column, model: Model) -> Column:
    """The logistic model's probability."""
    total = F.lit(model.weights[5])
    for name, weight in zip((f.name for f in _FEATURES), model.weights):
        total = total + F.log1p(found[name].cast("double")) * F.lit(weight)
    return 1 / (1 + F.exp(-total))


@dataclass(frozen=True)
class Settings:
    max_toxic: int = 20_000
    max_clean: int = 40_000
    least: int = 4        # letters of a term at least ...
    most: int = 16        # ... and at most
    support: int = 5      # toxic documents that have it, at least ...
    share: float = 0.002  # ... and at least this share of them
    lift: float = 20.0
    terms: int = 2000
    ridge: float = 0.1


def _keys(text: str | None, settings: Settings) -> set[str]:
    """Bare words (with a closing blank) and their starts."""
    found = set()
    for word in {bare(w) for w in (text or "").split()}:
        if settings.least <= len(word):
            found.add(word[:settings.most] + (" " if len(word) <= settings.most else ""))
            found.update(word[:n] for n in range(settings.least, min(len(word), settings.most) + 1))
    return found


def _count(rows: DataFrame, settings: Settings, wanted=None) -> DataFrame:
    """``key, n``: documents that hold each key; counted in each task first, a bounded number of keys at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = None if wanted is None else wanted.value
        counts: Counter = Counter()
        for batch in batches:
            for t in batch.column("text").to_pylist():
                found = _keys(t, settings)
                counts.update(found if keep is None else found & keep)
                if len(counts) > 1_000_000:
                    yield pa.RecordBatch.from_pydict({"key": list(counts), "n": list(counts.values())})
                    counts.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["key", "n"])

    return rows.mapInArrow(run, "key string, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def choose_terms(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int, settings: Settings) -> list[Term]:
    """Shortest stems with enough lift, each grown while one longer form has nearly all its documents."""
    def lift(k: str) -> float:
        return (toxic[k] + 0.5) / (n_toxic + 1) / ((clean.get(k, 0) + 0.5) / (n_clean + 1))

    good = {k for k in toxic if lift(k) >= settings.lift}
    longer: dict[str, list[str]] = {}
    for k in good:
        longer.setdefault(k[:-1], []).append(k)
    terms = []
    for k in sorted(good, key=lambda k: (len(k), k)):
        if any(k[:n] in good for n in range(settings.least, len(k))):
            continue
        grown, base = k, toxic[k]
        while True:
            more = [x for x in longer.get(grown, []) if toxic[x] >= 0.9 * base]
            if not more or grown.endswith(" "):
                break
            grown = max(more, key=lambda x: (toxic[x], x))
        terms.append((toxic[k], Term(grown.rstrip(), not grown.endswith(" "))))
    return [t for _, t in sorted(terms, key=lambda x: (-x[0], x[1].text))[:settings.terms]]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; the last column of ``x`` is the constant."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + penalty * w
        bend = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def training_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, usable: Column, settings: Settings) -> DataFrame:
    """``text, toxic`` of the bounded sample; of contradicting labels the toxic one counts, null labels do not."""
    spark = docs.sparkSession
    known = labels.filter(usable & F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("sample_key")).agg(
        F.max(F.col(label).cast("int")).alias("toxic"))
    sizes = known.agg(F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("toxic") != 1).alias("clean")).first()
    below = lambda n, most: F.lit(int((1 << 30) * min(1.0, most / max(n, 1))))
    limit = F.when(F.col("toxic") == 1, below(sizes["toxic"], settings.max_toxic)).otherwise(below(sizes["clean"], settings.max_clean))
    picked = known.filter(F.pmod(F.xxhash64("sample_key"), F.lit(1 << 30)) < limit)
    chosen = spark.createDataFrame([tuple(r) for r in picked.collect()], picked.schema)
    return docs.select(F.col(key).alias("sample_key"), F.col(text).alias("text")).join(F.broadcast(chosen), "sample_key")


def fit(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, usable: Column, settings: Settings = Settings()) -> Model:
    """Lexicon and weights from the labelled rows for which ``usable`` (of the key) holds.

    Without labelled rows of both kinds the lexicon is empty and every text
    has the score of the constant.
    """
    rows = training_rows(docs, labels, key, text, label, usable, settings)
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sum(n for k, n in sizes.items() if k != 1)
    model = Model([], key=uuid.uuid4().hex)
    if n_toxic and n_clean:
        enough = max(settings.support, settings.share * n_toxic)
        toxic = {r["key"]: r["n"] for r in _count(rows.filter("toxic = 1"), settings).filter(F.col("n") >= enough).collect()}
        wanted = _shared(set(toxic))
        clean = {r["key"]: r["n"] for r in _count(rows.filter("toxic <> 1"), settings, wanted).collect()}
        model.terms = choose_terms(toxic, clean, n_toxic, n_clean, settings)
    table = rows.select((F.col("toxic") == 1).cast("int").alias("toxic"), features(F.col("text"), model).alias("f")).groupBy("toxic", "f").count().collect()
    if table:
        x = np.array([[*np.log1p(list(r["f"])), 1.0] for r in table])
        y, weight = np.array([r["toxic"] for r in table], float), np.array([r["count"] for r in table], float)
        model.weights = logistic(x, y, weight, settings.ridge).tolist()
    return model
