"""Readers for tables, label folders and nested batches."""

from __future__ import annotations

import codecs
import csv
import io
import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.csv as pacsv
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidemark.operators.upsert import BATCH_SCHEMA
from tidemark.session import file_system

RAW_POSTS = ("id long, content string, source string, posted_at string, like_count string, "
             "comment_count string, collected_at string")
RAW_COMMENTS = "id long, post_id long, content string, source string, collected_at string"


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: str | StructType | None = None,
             encoding: str = "UTF-8", multi_line: bool = True) -> DataFrame:
    """CSV with a header, quoted multi-line values and doubled quotes.

    Multi-line files are read whole, one task per file; where no value holds a
    line break, ``multi_line=False`` lets Spark split big files.

    Without a schema every column is read as text, from the header only; no
    pass over the data is spent on guessing types.
    """
    reader = spark.read.options(header=True, multiLine=multi_line, quote='"', escape='"', encoding=encoding,
                                ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.csv(path if isinstance(path, str) else list(path))


def read_csv_any_encoding(spark: SparkSession, path: str, schema: str | StructType,
                          names: Mapping[str, Sequence[str]] | None = None, recursive: bool = False) -> DataFrame:
    """The CSV files of a folder, each in its own encoding and with its own header.

    Spark lists the files and deals them to tasks; each task opens its files,
    one at a time and block by block, and finds the encoding and the header there: UTF-8,
    with or without a byte-order mark, else windows-1258, else (bytes that has
    no character for) ISO-8859-1. Columns of ``schema`` are found by name, in
    any order, or by the first of their other ``names`` that the header holds.
    Empty unquoted values are null; a column that no name finds is an error
    that names the file, as are rows longer or shorter than the header, and so
    is a value that its type cannot take. Files without a header line give nothing.
    """
    wanted = _struct(spark, schema)
    options = {f.name: [f.name, *(names or {}).get(f.name, ())] for f in wanted}
    texts = StructType([StructField(f.name, StringType()) for f in wanted])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("path").to_pylist():
                yield from _csv_rows(file, options)

    # Paths only: a batch of contents could hold thousands of files.
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path).select(F.col("_metadata.file_path").alias("path"))
    return files.mapInArrow(parse, texts).select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in wanted])


def _struct(spark: SparkSession, schema: str | StructType) -> StructType:
    return schema if isinstance(schema, StructType) else spark.createDataFrame([], schema).schema


BLOCK = 4 << 20  # bytes of a file that are parsed at a time; more where one row is longer


def encoding_of(source) -> str | None:
    """UTF-8, else windows-1258, else ISO-8859-1, by a file's bytes, read piece by piece; None of a blank file."""
    tried, text, blank = codecs.getincrementaldecoder("utf-8-sig")(), "utf-8", True
    while True:
        piece = source.read(BLOCK)
        blank = blank and not piece.removeprefix(codecs.BOM_UTF8).strip()
        if text == "utf-8":
            try:
                tried.decode(piece, not piece)
            except UnicodeDecodeError:
                source.seek(0)
                text = "cp1258"
                continue
        elif text == "cp1258":
            try:
                piece.decode("cp1258")
            except UnicodeDecodeError:
                return "latin-1"  # such bytes are not blank
        if not piece:
            return None if blank else text


class _Recoded(io.RawIOBase):
    """A file read as UTF-8; it is in that or in a single-byte encoding."""

    def __init__(self, source, encoding: str):
        self.source, self.encoding, self.rest = source, encoding, b""

    def readable(self) -> bool:
        return True

    def read(self, size: int = -1) -> bytes:
        while size < 0 or len(self.rest) < size:
            piece = self.source.read(BLOCK)
            if not piece:
                break
            self.rest += piece if self.encoding == "utf-8" else piece.decode(self.encoding).encode()
        size = len(self.rest) if size < 0 else size
        found, self.rest = self.rest[:size], self.rest[size:]
        return found

    read1 = read

    def close(self) -> None:
        self.source.close()
        super().close()


def _csv_rows(file: str, options: Mapping[str, Sequence[str]]) -> Iterator[pa.RecordBatch]:
    system, place = file_system(file)
    with system.open_input_file(place) as source:
        encoding = encoding_of(source)
    if encoding is None:
        return
    opened = lambda: _Recoded(system.open_input_file(place), encoding)
    try:
        with io.TextIOWrapper(opened(), "utf-8-sig", newline="") as lines:
            header = next(csv.reader(lines), [])
        columns = [next((n for n in other if n in header), None) for other in options.values()]
        if None in columns:
            missing = [name for name, c in zip(options, columns) if c is None]
            raise ValueError(f"no column for {missing}; the header is {header}")
        done, block = 0, BLOCK
        while block:
            # Arrow reads ahead in a thread of its own, so each attempt has its own file.
            try:
                with pacsv.open_csv(
                        pa.PythonFile(opened(), "r"), pacsv.ReadOptions(block_size=block, use_threads=False), pacsv.ParseOptions(newlines_in_values=True),
                        pacsv.ConvertOptions(column_types={n: pa.string() for n in header}, strings_can_be_null=True, quoted_strings_can_be_null=False, null_values=[""])) as reader:
                    seen = 0
                    for batch in reader:
                        new = batch.slice(min(max(done - seen, 0), batch.num_rows))
                        seen += batch.num_rows
                        if new.num_rows:
                            done = seen
                            yield pa.RecordBatch.from_arrays([new.column(header.index(c)) for c in columns], names=list(options))
                block = 0
            except pa.ArrowInvalid as fault:
                # A row longer than the block: again with larger ones, from the first row that is not given yet.
                if "straddl" not in str(fault) or block >= 1 << 30:
                    raise
                block = min(8 * block, 1 << 30)
    except (pa.ArrowInvalid, ValueError) as fault:
        raise ValueError(f"{file}: {fault}") from fault


def read_label_folder(spark: SparkSession, path: str, first: str = "3.5 Flash", second: str = "3.1 Pro",
                      marker: str = "_v2") -> DataFrame:
    """Label files whose name, or folder below ``path``, tells the model: ``marker`` is the second.

    Both models' rows are merged on id, one column per model; an id that comes
    twice for one model is an error.
    """
    reader = spark.read.schema("id string, content_anonymized string, label string").options(
        header=True, multiLine=True, escape='"', recursiveFileLookup=True)
    below = F.substring_index("_metadata.file_path", "/" + path.rstrip("/").rsplit("/", 1)[-1] + "/", -1)
    rows = reader.csv(path).select(
        F.col("id").cast("bigint").alias("id"), "content_anonymized", "label",
        F.lower(below).contains(marker).alias("_second"))

    def side(wanted: bool):
        fault = F.raise_error(F.concat(F.lit(f"{second if wanted else first} has an id twice: "), F.col("id").cast("string")))
        return F.when(F.count_if(F.col("_second") == wanted) > 1, fault).otherwise(F.max(F.when(F.col("_second") == wanted, F.col("label"))))

    text = F.coalesce(F.max(F.when(~F.col("_second"), F.col("content_anonymized"))), F.max("content_anonymized"))
    return rows.groupBy("id").agg(
        text.alias("content_anonymized"), side(False).alias(first), side(True).alias(second))


def union_label_tables(tables: Sequence[DataFrame], names: Sequence[str], target: str) -> DataFrame:
    """Union of label tables that name their label column differently; ids become bigint."""
    parts = []
    for df in tables:
        name = next((n for n in names if n in df.columns), None)
        if name is None or "id" not in df.columns or "content_anonymized" not in df.columns:
            raise ValueError(f"Need id, content_anonymized and one of {list(names)}; got {df.columns}")
        parts.append(df.select(F.col("id").cast("bigint").alias("id"), "content_anonymized", F.col(f"`{name}`").alias(target)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def read_label_tables(spark: SparkSession, path: str, names: Sequence[str] = ("GPT5.5_Medium", "label"),
                      target: str = "GPT5.5_Medium") -> DataFrame:
    """The same for a folder of CSV files, whose headers and encodings may differ."""
    schema = f"id bigint, content_anonymized string, `{target}` string"
    return read_csv_any_encoding(spark, path, schema, {target: names})


@dataclass(frozen=True)
class Mark:
    """Files read so far: the latest modification time (in milliseconds), and the files that have it."""

    time_ms: int = -1
    files: tuple[str, ...] = ()


class IncrementalFolder:
    """A folder of Parquet files that is read from a high-water mark on.

    The mark is kept in a ledger in a folder of its own, one file for each
    commit, so a crash before ``commit`` leaves the earlier mark and the files
    are given again. Files older than the mark are dropped when the folder is
    listed, and only those of the mark's own time are told apart by name, so the
    ledger does not grow with the files. ``commit`` writes the mark of what
    ``pending`` saw, not of files that came since. A file that is written anew
    comes again.
    """

    def __init__(self, spark: SparkSession, path: str, ledger: str, schema: str | StructType):
        self.spark, self.path, self.ledger, self.schema, self.seen = spark, path, ledger, _struct(spark, schema), None

    def mark(self) -> Mark:
        system, root = file_system(self.ledger)
        system.create_dir(root, recursive=True)
        done = [f.path for f in system.get_file_info(fs.FileSelector(root)) if f.base_name.endswith(".json")]
        if not done:
            return Mark()
        with system.open_input_file(max(done)) as source:
            found = json.loads(source.read())
        return Mark(found["time_ms"], tuple(found["files"]))

    def pending(self) -> DataFrame:
        """Rows of the files that are not below the mark; ``commit`` after they are stored."""
        at = self.mark()
        reader = self.spark.read.schema(self.schema).options(recursiveFileLookup=True, pathGlobFilter="*.parquet")
        if at.time_ms >= 0:
            # Spark takes files strictly after this, to the second.
            before = datetime.fromtimestamp(at.time_ms // 1000 - 1, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S")
            reader = reader.option("modifiedAfter", before).option("timeZone", "UTC")
        try:
            rows = reader.parquet(self.path)
        except AnalysisException as fault:
            if fault.getCondition() != "PATH_NOT_FOUND":
                raise
            self.seen = at
            return self.spark.createDataFrame([], self.schema)
        # One row a file; columns of files are none of their rows'.
        path, time = F.col("_metadata.file_path"), F.unix_millis("_metadata.file_modification_time")
        fresh = (time > at.time_ms) | ((time == at.time_ms) & ~path.isin(list(at.files)))
        listed = reader.schema("path string, modificationTime timestamp, length bigint, content binary").format("binaryFile").load(self.path)
        files = listed.filter(fresh).select(path.alias("path"), time.alias("time"))
        top = files.agg(F.max("time")).first()[0]
        if top is None:
            self.seen = at
            return self.spark.createDataFrame([], self.schema)
        last = {r["path"] for r in files.filter(F.col("time") == top).select("path").collect()}
        self.seen = Mark(top, tuple(sorted(last | set(at.files if top == at.time_ms else ()))))
        return rows.filter(fresh & (time <= top)).select(*self.schema.names)

    def commit(self) -> None:
        if self.seen is None:
            raise ValueError("nothing was read since the last commit")
        system, root = file_system(self.ledger)
        name = f"{root}/{self.seen.time_ms + 1:020d}-{len(self.seen.files):09d}.json"
        with system.open_output_stream(f"{name}.tmp") as sink:
            sink.write(json.dumps({"time_ms": self.seen.time_ms, "files": self.seen.files}).encode())
        system.move(f"{name}.tmp", name)
        self.seen = None


def read_database_table(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int,
                        partitions: int = 64, **options: str) -> DataFrame:
    """A JDBC table read in parallel key ranges; filters and columns are pushed down."""
    return spark.read.jdbc(url, table, column=key, lowerBound=lower, upperBound=upper,
                           numPartitions=partitions, properties=options)


def parse_batches(raw: DataFrame, column: str = "value") -> DataFrame:
    """Nested ingest batches from JSON text."""
    return raw.select(F.from_json(column, BATCH_SCHEMA).alias("b")).select("b.*")


#: Batches as read from files: a line that is no JSON is kept as text, without an id.
FILE_SCHEMA = BATCH_SCHEMA.rstrip() + ",\n_corrupt_record string"


def arrived(lines: DataFrame) -> DataFrame:
    """Batches read from files, ordered by the time when their file was written."""
    return lines.select("*", F.col("_metadata.file_modification_time").alias("arrival"))


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    return arrived(spark.read.schema(FILE_SCHEMA).json(path))
