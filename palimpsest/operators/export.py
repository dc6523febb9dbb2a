"""Ordered text from chunks: Markdown, context blocks, briefings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import file_name, render_ms
from palimpsest.operators.joins import salted
from palimpsest.operators.ranking import position_by_range
from palimpsest.schema import DEFAULT_PLATFORM


def markdown_entry() -> Column:
    """One chunk as Markdown: heading, source line if there is a source, body, rule."""
    source = F.when(F.coalesce("source_url", F.lit("")) != "", F.concat(F.lit("*Source: "), F.col("source_url"), F.lit("*\n\n"))).otherwise("")
    head = F.concat(F.lit("## ["), F.coalesce("platform", F.lit(DEFAULT_PLATFORM)), F.lit("] — "), render_ms(F.col("timestamp_ms")), F.lit("\n\n"))
    return F.concat(head, source, F.col("document"), F.lit("\n\n---\n"))


def export_entries(chunks: DataFrame) -> DataFrame:
    """topic, timestamp_ms, id, entry: to be read in the order of timestamp and id."""
    return chunks.select("topic", F.coalesce("timestamp_ms", F.lit(0)).alias("timestamp_ms"), "id", markdown_entry().alias("entry"))


def export_header(chunks: DataFrame, exported: str) -> DataFrame:
    """topic, file_name, header of each topic's export."""
    counted = chunks.groupBy("topic").agg(F.count("*").alias("total"))
    header = F.concat(F.lit("# "), F.col("topic"), F.lit(f"\n\nExported: {exported}\nChunks: "), F.col("total").cast("string"), F.lit("\n\n---\n"))
    return counted.select("topic", F.concat(F.lit("export_"), file_name(F.col("topic")), F.lit(".md")).alias("file_name"), header.alias("header"))


def write_markdown(chunks: DataFrame, topic: str, path: str, exported: str) -> None:
    """The export of one topic as text files, to be concatenated in the order of their names; range-sorted, so it is never collected."""
    own = chunks.where(F.col("topic") == topic)
    head = export_header(own, exported).select(F.lit(-1).cast("bigint").alias("at"), F.lit("").alias("id"), F.col("header").alias("value"))
    if head.isEmpty():
        raise KeyError(f"no topic {topic!r}")
    body = export_entries(own).select(F.col("timestamp_ms").alias("at"), "id", F.col("entry").alias("value"))
    head.unionByName(body).orderBy("at", "id").select("value").write.mode("overwrite").text(path)


def documents(headers: DataFrame, entries: DataFrame, separator: str = "") -> DataFrame:
    """topic, at, text: one document a topic in rows, the header at 0 and the entries in the order of timestamp and id after it.

    headers has topic and header, entries topic, timestamp_ms, id and entry. The separator ends every entry but the last.
    Entries are ranked by ranges, so a topic of any size is never in one task.
    """
    ranked = position_by_range(entries, ["topic"], ["timestamp_ms", "id"], "at")
    last = entries.groupBy("topic").agg((F.count("*") - 1).alias("__last"))
    ranked = salted(ranked, last, "topic", "id") if separator else ranked.withColumn("__last", F.lit(None))
    text = F.when(F.col("at") < F.col("__last"), F.concat("entry", F.lit(separator))).otherwise(F.col("entry")) if separator else F.col("entry")
    body = ranked.select("topic", (F.col("at") + 1).cast("bigint").alias("at"), text.alias("text"))
    return headers.select("topic", F.lit(0).cast("bigint").alias("at"), F.col("header").alias("text")).unionByName(body)


def markdown(chunks: DataFrame, exported: str) -> DataFrame:
    """topic, at, text: the Markdown export of every topic, to be read in the order of at."""
    return documents(export_header(chunks, exported), export_entries(chunks))


def briefing_documents(delivered: DataFrame) -> DataFrame:
    """topic, at, text: the briefing of every topic that delivers something, to be read in the order of at."""
    headers, entries = briefing(delivered)
    total = F.col("total").cast("string")
    header = F.concat(F.lit("# "), "topic", F.lit("\nChunks: "), total, F.lit(" | Platforms: "), "platforms", F.lit("\nMode: "), "mode", F.lit("\n\n"), "instruction", F.lit("\n\n---\n\n## Chunks ("), total, F.lit(")\n\n"))
    return documents(headers.select("topic", header.alias("header")), entries, "\n\n---\n\n")


def context_block(hits: DataFrame, prompt: str, begin: str = "[memory]", end: str = "[/memory]") -> DataFrame:
    """One row with the numbered hits (rank, label) between marks and the prompt after them; no row without hits."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: F.concat(F.lit("["), x["rank"].cast("string"), F.lit("] "), x["label"])), "\n")
    made = hits.agg(F.count("*").alias("n"), lines.alias("body")).where("n > 0")
    return made.select(F.concat(F.lit(f"{begin}\n"), "body", F.lit(f"\n{end}\n\n{prompt}")).alias("block"))


def briefing(delivered: DataFrame, first: str = "Read what follows and keep it in mind.", later: str = "What follows is new since the last time.") -> tuple[DataFrame, DataFrame]:
    """(headers, entries) of a sync: topic, total, platforms, mode and instruction; topic, timestamp_ms, id, entry."""
    header = delivered.groupBy("topic", "mode").agg(F.count("*").alias("total"), F.array_join(F.array_sort(F.collect_set("platform")), ", ").alias("platforms"))
    header = header.withColumn("instruction", F.when(F.col("mode") == "incremental", later).otherwise(first))
    entry = F.concat(F.lit("### ["), F.coalesce("platform", F.lit(DEFAULT_PLATFORM)), F.lit("] — "), render_ms(F.col("timestamp_ms")), F.lit("\n\n"), F.col("document"))
    return header, delivered.select("topic", F.coalesce("timestamp_ms", F.lit(0)).alias("timestamp_ms"), "id", entry.alias("entry"))
