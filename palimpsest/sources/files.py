"""Source trees as rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.text import code_chunk_id
from palimpsest.operators.chunking import chunk_code
from palimpsest.schema import EXTENSIONS, MAX_FILE_LENGTH, SKIPPED_NAMES, SKIPPED_SUFFIXES


def read_tree(spark: SparkSession, root: str, extensions: list[str] | None = None) -> DataFrame:
    """path, rel_path, content of the files under root that count; what can't be read or is empty is left out, what is no UTF-8 is replaced.

    Names and sizes are listed first, and only the files that code_files() could keep are opened. Spark's file index holds
    the names of all files anyway, so the list of those kept is no more.
    """
    options = {"recursiveFileLookup": "true", "ignoreCorruptFiles": "true", "ignoreMissingFiles": "true"}
    path = F.regexp_replace("path", "^[a-z]+:/*", "/")
    base = root.split(":", 1)[-1].rstrip("/")
    rel = relative(F.regexp_replace(path, "^" + "".join("\\" + c if not c.isalnum() else c for c in "/" + base.lstrip("/")) + "/", ""))
    listed = spark.read.format("binaryFile").options(**options).load(root).select("path", "length", rel.alias("rel_path"))
    wanted = listed.where(kept(F.col("rel_path"), extensions) & (F.col("length") <= 4 * MAX_FILE_LENGTH))  # a character has at most four bytes
    paths = [_escaped(r.path) for r in wanted.select("path").toLocalIterator()]
    if not paths:
        return spark.createDataFrame([], "path string, rel_path string, content string")
    files = spark.read.format("binaryFile").options(**options).load(paths)
    return files.select(path.alias("path"), rel.alias("rel_path"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def _escaped(path: str) -> str:
    """A path as a pattern that matches only it."""
    return re.sub(r"([*?\[\]{}\\])", r"\\\1", path)


def relative(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    """In lower case; a leading dot makes no extension."""
    return F.lower(F.regexp_extract(name_of(path), r"^.+\.([^.]*)$", 1))


def walked(rel_path: Column) -> Column:
    """No part of the path is skipped or hidden."""
    return ~F.exists(F.split(rel_path, "/"), lambda p: p.isin(SKIPPED_NAMES) | p.startswith("."))


def kept_name(rel_path: Column) -> Column:
    return ~F.rlike(name_of(rel_path), F.lit("|".join(SKIPPED_SUFFIXES)))


def kept(rel_path: Column, extensions: list[str] | None = None) -> Column:
    """The names that count: walked, not skipped, of a wanted extension."""
    wanted = [e.lower().removeprefix(".") for e in extensions or []] or EXTENSIONS
    return walked(rel_path) & kept_name(rel_path) & extension(rel_path).isin(wanted)


def code_files(files: DataFrame, extensions: list[str] | None = None, rel_path: str = "rel_path", content: str = "content") -> DataFrame:
    """The files that count: walked, not skipped by name, of a wanted extension, within the length limit."""
    return files.where(kept(F.col(rel_path), extensions) & (F.length(content) <= MAX_FILE_LENGTH))


def code_chunks(files: DataFrame, now_ms: int, path: str = "path", rel_path: str = "rel_path", content: str = "content", topic: str = "topic") -> DataFrame:
    """Chunk rows of the files: id, document, source_url, platform, topic, timestamp_ms, file_path."""
    name = F.coalesce(topic, F.lit("Generale"))
    rows = files.select(name.alias("topic"), F.col(path).alias("path"), F.col(rel_path).alias("file_path"), F.posexplode(chunk_code(F.col(rel_path), F.col(content))).alias("index", "document"))
    return rows.select(
        code_chunk_id(F.col("topic"), F.col("file_path"), F.col("index")).alias("id"), "document", F.concat(F.lit("file://"), "path").alias("source_url"),
        F.lit("codebase").alias("platform"), "topic", F.lit(now_ms).cast("bigint").alias("timestamp_ms"), "file_path",
    )


def chunk_counts(files: DataFrame, rel_path: str = "rel_path", content: str = "content") -> DataFrame:
    """Number of chunks over all files, as progress counts them: at least 1."""
    n = F.sum(F.size(chunk_code(F.col(rel_path), F.col(content))))
    return files.agg(F.greatest(F.coalesce(n, F.lit(0)), F.lit(1)).cast("bigint").alias("total"))


