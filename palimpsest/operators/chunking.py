"""Messages and source files into chunks; folds over arrays, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.text import trim
from palimpsest.schema import CHUNK_OVERLAP, CHUNK_SIZE, OVERLAP_LINES


def _empty() -> Column:
    return F.array().cast("array<string>")


def _windows(paragraph: Column, size: int, overlap: int) -> Column:
    last = F.ceil(F.length(paragraph) / (size - overlap)).cast("int") - 1
    return F.transform(F.sequence(F.lit(0), last), lambda k: paragraph.substr(k * (size - overlap) + 1, F.lit(size)))


def chunk_message(full: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Chunks of a text with its role's header.

    A text within the size stays as it is. Else paragraphs, split at runs of line breaks, are packed greedily and joined
    by two breaks; a paragraph beyond the size is cut into windows that overlap. Blank chunks are dropped.
    """

    def step(state: Column, para: Column) -> Column:
        cur, out = state["cur"], state["out"]
        fits = F.length(cur) + 2 + F.length(para) <= size
        flushed = F.when(cur != "", F.concat(out, F.array(cur))).otherwise(out)
        long = F.length(para) > size
        return F.struct(
            F.when(fits, F.when(cur == "", para).otherwise(F.concat(cur, F.lit("\n\n"), para))).when(long, F.lit("")).otherwise(para).alias("cur"),
            F.when(fits, out).when(long, F.concat(flushed, _windows(para, size, overlap))).otherwise(flushed).alias("out"),
        )

    def finish(state: Column) -> Column:
        return F.when(state["cur"] != "", F.concat(state["out"], F.array(state["cur"]))).otherwise(state["out"])

    start = F.struct(F.lit("").alias("cur"), _empty().alias("out"))
    packed = F.aggregate(F.split(full, r"\n{2,}", -1), start, step, finish)
    chunks = F.when(F.length(full) <= size, F.array(full)).otherwise(packed)
    return F.filter(chunks, lambda c: trim(c) != "")


def chunk_code(rel_path: Column, content: Column, size: int = CHUNK_SIZE, lines: int = OVERLAP_LINES) -> Column:
    """Chunks of a file, each under a header with its path.

    Lines are added until the next would exceed the size; then the buffer is given out, trimmed, and goes on with the
    header, its last lines and that line. The size is no bound: overlap and line are not measured again.
    """
    header = F.concat(F.lit("[FILE: "), rel_path, F.lit("]"))
    top = F.concat(header, F.lit("\n"))

    def step(state: Column, line: Column) -> Column:
        cur, out = state["cur"], state["out"]
        flush = (F.length(cur) + F.length(line) + 1 > size) & (trim(cur) != header)
        parts = F.split(cur, "\n", -1)
        tail = F.array_join(F.slice(parts, F.greatest(F.size(parts) - lines, F.lit(1)), F.lit(lines + 1)), "\n")
        return F.struct(
            F.when(flush, F.concat(top, tail, F.lit("\n"), line, F.lit("\n"))).otherwise(F.concat(cur, line, F.lit("\n"))).alias("cur"),
            F.when(flush, F.concat(out, F.array(trim(cur)))).otherwise(out).alias("out"),
        )

    def finish(state: Column) -> Column:
        rest = trim(state["cur"])
        return F.when((rest != "") & (rest != header), F.concat(state["out"], F.array(rest))).otherwise(state["out"])

    return F.aggregate(F.split(content, "\n", -1), F.struct(top.alias("cur"), _empty().alias("out")), step, finish)
