"""Files as rows: texts with an encoding fallback, manifests, JSON sets, and report sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Encodings tried in order; a file that none can read has NULL text.
ENCODINGS = ("utf-8", "gbk")
GOLDEN = "id string, question string, golden_answer string, kb_id string, source_file string, context_chunks array<struct<text: string, source: string, score: double, rank: int>>"


def decode(raw: bytes | None) -> tuple[str | None, str | None]:
    for name in ENCODINGS:
        try:
            return (raw or b"").decode(name), name
        except UnicodeDecodeError:
            continue
    return None, None


def _decode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        read = [decode(x) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([t for t, _ in read], pa.string()), pa.array([e for _, e in read], pa.string())], names=["path", "size", "text", "encoding"])


def binary_files(spark: SparkSession, folder: str) -> DataFrame:
    """path (relative), filename, size, content of every file below a folder; names that begin with a dot are left out, folders too, and so are files without a byte."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = F.lit(folder.rstrip("/").removeprefix("file://") + "/")
    relative = F.element_at(F.split(F.col("path"), root), -1)
    return rows.select(relative.alias("path"), F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("size"), "content").where(~F.col("path").rlike(r"(^|/)\."))


def is_text(content: F.Column) -> F.Column:
    """Whether the first 8,192 bytes look like text: not empty and without a zero byte."""
    head = F.substring(content, 1, 8192)
    return (F.length(content) > 0) & ~F.hex(head).rlike("^(..)*?00")


def text_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, size, text and the encoding it was read with."""
    return binary_files(spark, folder).select("path", "size", "content").mapInArrow(_decode_batches, "path string, size bigint, text string, encoding string")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """path, filename, checksum (SHA-256 of the bytes) and size of every file below a folder."""
    return manifest_of(binary_files(spark, folder).select("path", "content"))


def manifest_of(contents: DataFrame) -> DataFrame:
    """The manifest of rows of path and content; hidden files and folders are left out."""
    seen = contents.where(~F.col("path").rlike(r"(^|/)\."))
    return seen.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), F.sha2("content", 256).alias("checksum"), F.length("content").cast("bigint").alias("size"))


def golden_set(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """A golden set from a JSON array; a ``limit`` of 0 means all."""
    rows = spark.read.schema(GOLDEN).json(path, multiLine=True)
    return rows.limit(limit) if limit else rows


def documents_map(spark: SparkSession, path: str) -> DataFrame:
    """filename and text from one JSON object of texts by name."""
    return map_entries(spark.read.text(path, wholetext=True))


def map_entries(texts: DataFrame) -> DataFrame:
    """filename and text of each entry of JSON objects (``value``)."""
    return texts.select(F.explode(F.from_json("value", "map<string,string>")).alias("filename", "text"))


def write_report(items: DataFrame, path: str) -> None:
    """Items as JSON lines, one folder a report."""
    items.write.mode("overwrite").json(path)
