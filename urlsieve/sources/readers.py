"""Thin file readers; the parsing lives in ``feeds``."""

from __future__ import annotations

import gzip
import io
import zipfile
import zlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlsieve.functions.text import strip

LABELLED_SCHEMA = "url string, label tinyint"


def read_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """value: the lines of text files (``.gz`` is unpacked by the reader)."""
    return spark.read.text(path if isinstance(path, str) else list(path))


def read_documents(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """value: each file as one document, for JSON feeds."""
    return spark.read.text(path if isinstance(path, str) else list(path), wholetext=True)


def read_lists(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """value, category: several lists at once, named after their files."""
    name = F.substring_index(F.col("_metadata.file_name"), ".", 1)
    return spark.read.text(list(paths)).select("value", name.alias("category"))


def read_header_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("escape", '"').csv(path)


def read_labelled(
    spark: SparkSession, path: str, limit: int | None = None
) -> DataFrame:
    """url, label from quoted CSV with a header; rows without either are dropped."""
    rows = spark.read.schema(LABELLED_SCHEMA).options(
        header=True, quote='"', escape='"', multiLine=False
    ).csv(path).dropna(subset=["url", "label"])
    return rows if limit is None else rows.limit(limit)


def read_raw_rows(spark: SparkSession, path: str) -> DataFrame:
    """url, label as text, for validation."""
    return spark.read.schema("url string, label string").options(
        header=True, quote='"', escape='"'
    ).csv(path)


def read_html_table(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """html, label of page tables; only these two columns are read."""
    return spark.read.parquet(*([path] if isinstance(path, str) else path)).select("html", "label")


def read_html_folder(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """path, html, error: every .html/.htm file of a folder; bytes that are no text are dropped."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{html,htm,HTML,HTM}").option(
        "recursiveFileLookup", str(recursive).lower()
    ).load(path)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            html, error = [], []
            for content in batch["content"]:
                try:
                    html.append(bytes(content).decode("utf-8", errors="ignore"))
                    error.append(None)
                except Exception as problem:  # noqa: BLE001
                    html.append(None)
                    error.append(f"{type(problem).__name__}: {problem}")
            yield pd.DataFrame({"path": batch["path"], "html": html, "error": error})

    return files.select("path", "content").mapInPandas(
        decode, "path string, html string, error string")


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """value: seeds or URLs to score, without blank and ``#`` lines."""
    line = strip(F.col("value"))
    return read_lines(spark, path).select(line.alias("value")).where(
        (F.col("value") != "") & ~F.col("value").startswith("#"))


def archive_lines(files: DataFrame) -> DataFrame:
    """path, value: lines of (path, content) files; a ZIP gives its first member.

    One file is one record, so files are the unit of parallelism; lines leave the worker in
    batches, never as one list of the whole archive.
    """

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                raw = io.BytesIO(bytes(content))
                if bytes(content[:2]) == b"PK":
                    archive = zipfile.ZipFile(raw)
                    raw = archive.open(archive.namelist()[0])
                lines = io.TextIOWrapper(raw, encoding="utf-8", errors="replace")
                chunk: list[str] = []
                for line in lines:
                    chunk.append(line.rstrip("\r\n"))
                    if len(chunk) == 10_000:
                        yield pd.DataFrame({"path": path, "value": chunk})
                        chunk = []
                yield pd.DataFrame({"path": [path] * len(chunk), "value": pd.Series(chunk, dtype=str)})

    return files.select("path", "content").mapInPandas(unpack, "path string, value string")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    return archive_lines(spark.read.format("binaryFile").load(path))


def decode_documents(files: DataFrame) -> DataFrame:
    """path, text of (path, content) files, gzip recognised by its first bytes, and error (NULL where it went well)."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, errors = [], []
            for content in batch["content"]:
                data, wrong = bytes(content), None
                try:
                    if data[:2] == b"\x1f\x8b":
                        data = gzip.decompress(data)
                    texts.append(data.decode("utf-8", errors="ignore"))
                except (OSError, EOFError, zlib.error) as broken:
                    texts.append(None)
                    wrong = f"{type(broken).__name__}: {broken}"
                errors.append(wrong)
            yield pd.DataFrame({"path": batch["path"], "text": texts, "error": errors})

    return files.select("path", "content").mapInPandas(decode, "path string, text string, error string")


def read_sitemaps(spark: SparkSession, path: str) -> DataFrame:
    return decode_documents(spark.read.format("binaryFile").load(path))
