"""Sources: CSV with blanks kept, JSON, arrays, discovery by header and checksum. All reads go through Spark."""

from __future__ import annotations

import gzip
import hashlib
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed format: the observation table's columns, in order.
OBSERVATION = (
    "run_id cell_id experiment_stage repeat model_name model_id model_provider prompt_family prompt_question full_prompt x_group_id x_group_name news_source "
    "news_source_link news_author news_published_utc news_modified_utc news_retrieved_utc news_word_count y_group_dimension y_group_id y_group_name response "
    "response_word_count captured_utc requested_word_range length_status thread_deleted"
).split()
INTEGERS = ("repeat", "news_word_count", "response_word_count")


def read_csv(spark: SparkSession, path: str, columns: list[str] | tuple[str, ...] = tuple(OBSERVATION), integers: tuple[str, ...] = INTEGERS) -> DataFrame:
    """All columns as strings with blanks kept (never null), then strict casts; quoted line breaks and ``.gz`` are read.

    A header other than ``columns`` is an error.
    """
    options = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "encoding": "UTF-8", "enforceSchema": False}
    rows = spark.read.options(**options).csv(path, schema=T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    rows = rows.select([F.coalesce(c, F.lit("")).alias(c) for c in columns])
    return rows.withColumns({c: F.col(c).cast("int") for c in integers if c in columns})


def read_csv_if_there(spark: SparkSession, path: str, columns: list[str], required: bool = False) -> DataFrame:
    """As ``read_csv`` with strings only; a missing file is an empty table unless ``required``."""
    if required or exists(spark, path):
        return read_csv(spark, path, columns, ())
    return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in columns]))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_csv_or_gzip(spark: SparkSession, path: str, columns: list[str] | tuple[str, ...] = tuple(OBSERVATION), integers: tuple[str, ...] = INTEGERS) -> DataFrame:
    """``path``, or ``path``.gz where only that is there; Spark decompresses it in one task, as gzip can't be split."""
    return read_csv(spark, path if exists(spark, path) else f"{path}.gz", columns, integers)


def with_row_index(rows: DataFrame, name: str = "row_ix") -> DataFrame:
    """Zero-based position in the order of the files and their rows: the row's place in its partition and the sizes of
    the partitions before, of which the driver gets one number each. ``rows`` must be read alike twice, as files are."""
    at = rows.withColumn("_at", F.monotonically_increasing_id())
    number, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r[0], r[1]) for r in at.groupBy(number.alias("p")).agg(F.count("*")).collect())
    before, total = [], 0
    for part, n in sizes:
        before.append((part, total))
        total += n
    offsets = rows.sparkSession.createDataFrame(before or [(0, 0)], "_p long, _o long")
    return at.withColumn("_p", number).join(offsets, "_p").select(*rows.columns, (place + F.col("_o")).alias(name))


def read_json(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def checksums(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, length, sha256, content_sha256) of files: of their bytes, and of the decompressed bytes of ``.gz`` ones.

    A file is one value of at most 2 GB; it is decompressed 1 MB at a time.
    """
    schema = pa.schema([("path", pa.string()), ("length", pa.int64()), ("sha256", pa.string()), ("content_sha256", pa.string())])

    def run(batches):
        for batch in batches:
            for path, length, content in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "content")), strict=True):
                raw = hashlib.sha256(content).hexdigest()
                inner = hashlib.sha256()
                if path.endswith(".gz"):
                    with gzip.open(io.BytesIO(content)) as f:
                        while part := f.read(1 << 20):
                            inner.update(part)
                yield pa.RecordBatch.from_pydict({"path": [path], "length": [length], "sha256": [raw], "content_sha256": [inner.hexdigest() if path.endswith(".gz") else raw]}, schema=schema)

    files = spark.read.format("binaryFile").load(pattern).select("path", "length", "content")
    return files.mapInArrow(run, "path string, length long, sha256 string, content_sha256 string")


def read_npz(spark: SparkSession, path: str, array: str = "embeddings", rows: int = 4096) -> DataFrame:
    """(row_ix, v) of a two-dimensional array in an ``.npz`` file, ``rows`` at a time as Arrow lists."""

    def run(batches):
        for batch in batches:
            for content in batch.column("content").to_pylist():
                values = np.load(io.BytesIO(content))[array]
                for k in range(0, len(values), rows):
                    part = np.ascontiguousarray(values[k : k + rows], np.float32)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * part.shape[1], pa.int32()), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, k + len(part))), lists], names=["row_ix", "v"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "row_ix long, v array<float>")


def header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(path).limit(0).columns


def files_below(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """Paths of all files under ``folder`` whose name fits ``pattern``, at any depth, sorted; none where it is missing."""
    if not exists(spark, folder):
        return []
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return sorted(r[0] for r in found.select("path").collect())


def resolved(spark: SparkSession, path: str) -> str:
    """The one name of a path: its file system's, absolute."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.resolvePath(p).toString() if system.exists(p) else system.makeQualified(p).toString()


def discover(spark: SparkSession, candidates: list[str], columns: list[str], sha256: str | None = None, below: str | None = None, pattern: str = "*.csv*") -> str:
    """The first candidate path, then the first file ``below`` a folder, with exactly this header and, if given, this
    checksum of its (decompressed) bytes; a file named twice is looked at once. An error says how many had the header."""
    matched, seen = 0, set()
    for path in [*candidates, *(files_below(spark, below, pattern) if below else [])]:
        if not exists(spark, path) or (name := resolved(spark, path)) in seen:
            continue
        seen.add(name)
        if header(spark, path) == list(columns):
            matched += 1
            if sha256 is None or checksums(spark, path).first()["content_sha256"] == sha256:
                return path
    raise FileNotFoundError(f"no source fits; {matched} had the header")
