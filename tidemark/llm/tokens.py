"""Token ids and counts by public tokenizers, without cutting any text.

Tokenizers whose pre-tokenizer never joins text across ASCII white space, and
whose normaliser works within such parts, give the same ids for a text as for
its white-space-delimited parts one after the other. ``part_safe`` proves that
from the tokenizer's own description; then each worker encodes a part once and
keeps its ids in a table of bounded size. Other tokenizers encode whole texts.

Huge texts are encoded by overlapping chunks with offsets, in parallel
(``count_tokens``): two neighbours are spliced at a token that starts, in both
encodings, at the same place right after white space, with the same ids before
and after it. Where no such place is in the overlap, the chunks of that text
are laid again with an overlap four times as wide; once that reaches the whole
text, it is one chunk.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.worker import keep
from tidemark.session import written

CACHE_PARTS = 700_000  # parts that a worker keeps
_SPLITS = {"'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}  # patterns none of whose matches holds white space
# An ASCII mark (apostrophes excepted) after a letter a-z, a digit or a small Latin-1 letter.
_MARK = re.compile(rb"([!-&(-/:-@\[-`{-~])(?:(?<=[a-z0-9].)|(?<=\xc3[\x9f-\xb6\xb8-\xbf].))")


def part_safe(description: dict) -> bool:
    """Whether white-space-delimited parts can be encoded on their own (see above)."""
    norm = description.get("normalizer") or {}
    steps = norm.get("normalizers", [norm] if norm else [])
    for s in steps:
        blank = s["type"] == "Replace" and s["pattern"] == {"Regex": "\\s+"} and s["content"] == " "
        if not (blank or s["type"] in ("NFC", "Lowercase")):
            return False
    pre = description.get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [{}])[0]
    if not (first.get("type") == "Split" and first["pattern"].get("Regex") in _SPLITS and first["behavior"] == "Removed" and first["invert"]):
        return False
    if not any(x["type"] == "Lowercase" for x in steps):
        return False
    if any(p["type"] != "ByteLevel" or p["add_prefix_space"] for p in pre["pretokenizers"][1:]):
        return False
    return all(not (a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"]) and not set(a["content"]) & set(" \t\n\r\x0b\x0c")
               for a in description.get("added_tokens", []))


class Parts(dict):
    """Ids by part, found when first asked for."""

    def __init__(self, find: Callable[[bytes], bytes]):
        super().__init__()
        self.find = find

    def __missing__(self, part: bytes) -> bytes:
        found = self[part] = self.find(part)
        return found


class Encoder:
    """A tokenizer in a worker, with the ids of parts seen before."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.parts = part_safe(json.load(f))
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.kind = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.width = 2 if self.kind == "H" else 4
        self.known = Parts(self.part_ids)
        if self.parts:
            # Letters that neither normaliser nor splitter changes, in the form the model reads.
            letters = [chr(c) for c in (*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100))]
            self.letters = {ord(c): self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in letters}
            self.plain = re.compile(f"[{''.join(letters)}]+").fullmatch

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, f"<u{self.width}").tobytes()

    def part_ids(self, part: bytes) -> bytes:
        """The ids of one part: a word of plain letters by the model itself."""
        text = part.decode("utf-8")
        low = text.lower()
        if part.isalpha():  # ASCII letters are read as they are
            return array(self.kind, [x.id for x in self.model.tokenize(low)]).tobytes()
        if self.plain(low):
            return array(self.kind, [x.id for x in self.model.tokenize(low.translate(self.letters))]).tobytes()
        return self._whole(text)

    def _parts(self, text: str | None) -> list[bytes]:
        """Parts whose ids, one after the other, are the text's.

        A mark after a letter or digit begins a part of its own, and A-Z can be
        lower-cased here, as the tokenizer does both (unless an added token could
        come of it).
        """
        raw = (text or "").encode("utf-8")
        return (raw if b"<|" in raw else _MARK.sub(rb" \1", raw.lower())).split()

    def ids(self, texts: list[str | None]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text; a null text is empty."""
        for raw in self.narrow_ids(texts):
            yield np.frombuffer(raw, f"<u{self.width}").astype("<u4").tobytes()

    def narrow_ids(self, texts: list[str | None]) -> Iterator[bytes]:
        """Little-endian ids of ``width`` bytes, the fewest that hold the vocabulary."""
        if not self.parts:
            for t in texts:
                yield self._whole(t or "")
            return
        for t in texts:
            if len(self.known) > CACHE_PARTS:
                self.known.clear()
            yield b"".join(map(self.known.__getitem__, self._parts(t)))

    def offsets(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and the code point where each token starts."""
        found = self.tokenizer.encode(text, add_special_tokens=False)
        return np.array(found.ids, np.int64), np.array([o[0] for o in found.offsets], np.int64)


def encoder(path: str) -> Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return keep(f"encoder {path}", lambda: Encoder(path))


def token_ids(text: Column, path: str) -> Column:
    """The text's ids as little-endian 32-bit numbers in a binary column."""

    @F.arrow_udf("binary")
    def run(column: pa.Array) -> pa.Array:
        return pa.array(list(encoder(path).ids(column.to_pylist())), pa.binary())

    return run(text)


def token_count(text: Column, path: str) -> Column:
    """Number of tokens of texts of ordinary length."""

    @F.arrow_udf("bigint")
    def run(column: pa.Array) -> pa.Array:
        coder = encoder(path)
        return pa.array([len(b) // coder.width for b in coder.narrow_ids(column.to_pylist())], pa.int64())

    return run(text)


CHUNK = "struct<n:bigint,head:array<struct<at:bigint,no:bigint,sign:bigint>>,tail:array<struct<at:bigint,no:bigint,sign:bigint>>>"
_PLACES = pa.list_(pa.struct([("at", pa.int64()), ("no", pa.int64()), ("sign", pa.int64())]))
_CHUNK = pa.struct([("n", pa.int64()), ("head", _PLACES), ("tail", _PLACES)])


def boundaries(text: str, ids: np.ndarray, starts: np.ndarray, low: int, high: int) -> list[dict]:
    """Tokens that start right after white space within ``low <= place < high``.

    ``sign`` digests the ids of the two tokens before and after the place.
    """
    found = []
    for no in range(2, len(ids) - 1):
        at = int(starts[no])
        if low <= at < high and at and text[at - 1] in " \t\n\r\x0b\x0c" and starts[no - 1] < at:
            sign = 0
            for i in ids[no - 2:no + 2]:
                sign = (sign * 1000003 + int(i)) & 0x7FFFFFFFFFFFFFFF
            found.append({"at": at, "no": no, "sign": sign})
    return found


def encode_chunks(path: str, overlap: int) -> Column:
    @F.arrow_udf(CHUNK)
    def run(text: pa.Array, start: pa.Array) -> pa.Array:
        rows = []
        for t, s in zip(text.to_pylist(), start.to_pylist()):
            ids, starts = encoder(path).offsets(t)
            mark = lambda low, high: [m | {"at": m["at"] + s} for m in boundaries(t, ids, starts, low, high)]
            rows.append({"n": len(ids), "head": mark(0, overlap), "tail": mark(len(t) - overlap, len(t))})
        return pa.array(rows, _CHUNK)

    return run(F.col("chunk"), F.col("start"))


def _count_huge(rows: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """``row, n_tokens`` of rows ``row, text``; null where neighbours could not be spliced."""
    size, step = F.length("text"), chunk
    # Chunk i reads [i * step, (i + 1) * step + overlap).
    chunks = rows.select("row", "text", F.explode(F.sequence(F.lit(0), F.greatest(
        F.ceil((size - overlap) / F.lit(step)).cast("int") - 1, F.lit(0)))).alias("no"))
    chunks = chunks.select("row", "no", (F.col("no") * step).cast("long").alias("start"),
                           F.substring("text", F.col("no") * step + 1, F.lit(step + overlap)).alias("chunk"))
    coded = chunks.repartition("row", "no").select("row", "no", encode_chunks(path, overlap).alias("c"))
    coded = written(coded.select("row", "no", "c.*"), "token-chunks")
    left = coded.select("row", F.col("no").alias("no"), "tail")
    right = coded.select("row", (F.col("no") - 1).alias("no"), "head")
    # The first place with the same signature on both sides; tokens before it count left, from it on right.
    same = F.filter(F.col("tail"), lambda a: F.exists(F.col("head"), lambda b: (a["at"] == b["at"]) & (a["sign"] == b["sign"])))
    cut = F.try_element_at(same, F.lit(1))
    seam = left.join(right, ["row", "no"]).select("row", cut["no"].alias("left_no"), F.try_element_at(F.filter(
        F.col("head"), lambda b: b["at"] == cut["at"]), F.lit(1))["no"].alias("right_no"), F.col("no").alias("seam"))
    # n = sum of the chunks' tokens, less what each seam counts twice.
    whole = coded.groupBy("row").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("chunks"))
    last = coded.select("row", F.col("no").alias("seam"), "n")
    lost = seam.join(last, ["row", "seam"]).groupBy("row").agg(
        F.sum(F.col("n") - F.col("left_no") + F.col("right_no")).alias("twice"), F.count("left_no").alias("seams"))
    return whole.join(lost, "row", "left").select("row", F.when(
        F.coalesce("seams", F.lit(0)) == F.col("chunks") - 1, F.col("n") - F.coalesce("twice", F.lit(0))).alias("n_tokens"))


def count_tokens(docs: DataFrame, key: str, text: str, path: str, huge: int = 1 << 16, chunk: int = 1 << 15,
                 overlap: int = 1 << 10) -> DataFrame:
    """Key, ``n_bytes`` and ``n_tokens`` of each row.

    Null and empty texts have none. Rows are told apart by their place, so
    repeated keys and rows keep a row each. Texts over ``huge`` characters go
    by chunks.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    size = F.octet_length("text").cast("long").alias("n_bytes")
    short = rows.filter(F.length("text") <= huge).select(F.col("key"), size, token_count(F.col("text"), path).alias("n_tokens"))
    # Huge rows are written once, so that their numbers hold for all that follows.
    long = written(rows.filter(F.length("text") > huge).withColumn("row", F.monotonically_increasing_id()), "token-rows")
    names = long.select("row", "key", size)
    longest = long.agg(F.max(F.length("text"))).first()[0]
    counted, left = [], long.select("row", "text")
    while longest is not None:
        width = max(chunk, 2 * overlap)
        done = written(_count_huge(left, path, width, overlap), "token-counts")
        counted.append(done.filter("n_tokens IS NOT NULL"))
        missing = done.filter("n_tokens IS NULL").select("row")
        if overlap >= longest or missing.isEmpty():
            break
        left, overlap = left.join(missing, "row", "left_semi"), overlap * 4
    for done in counted:
        short = short.unionByName(names.join(done, "row").select("key", "n_bytes", "n_tokens"))
    return short.select(F.col("key").alias(key), "n_bytes", "n_tokens")
