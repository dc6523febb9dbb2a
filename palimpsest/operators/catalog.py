"""Catalog views of the chunk store: statistics, topic lists, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.schema import DEFAULT_PLATFORM, DEFAULT_TOPIC


def topic() -> Column:
    return F.coalesce(F.col("topic"), F.lit(DEFAULT_TOPIC)).alias("topic")


def platform() -> Column:
    return F.coalesce(F.col("platform"), F.lit(DEFAULT_PLATFORM)).alias("platform")


def stats_by_topic(chunks: DataFrame) -> DataFrame:
    """topic, chunks, sources, last_timestamp; newest topic first. Empty topics are a group of their own."""
    sources = F.count_distinct(F.nullif(F.col("source_url"), F.lit("")))
    last = F.greatest(F.max(F.coalesce("timestamp_ms", F.lit(0))), F.lit(0))
    return chunks.groupBy(topic()).agg(F.count("*").alias("chunks"), sources.alias("sources"), last.alias("last_timestamp")).orderBy(F.desc("last_timestamp"), "topic")


def platforms_by_topic(chunks: DataFrame) -> DataFrame:
    """topic, platform, chunks: most frequent platform of a topic first."""
    return chunks.groupBy(topic(), platform()).agg(F.count("*").alias("chunks")).orderBy("topic", F.desc("chunks"), "platform")


def platform_maps(chunks: DataFrame) -> DataFrame:
    """topic, platforms: map of platform to chunks. The platforms of a topic are counted before they are collected."""
    counted = platforms_by_topic(chunks)
    return counted.groupBy("topic").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("platform", "chunks")))).alias("platforms"))


def totals(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("total_chunks"), F.count_distinct(topic()).alias("total_topics"))


def totals_rollup(chunks: DataFrame) -> DataFrame:
    """Counts per topic and over all (topic null, total 1), in one pass."""
    return chunks.select(topic()).rollup("topic").agg(F.count("*").alias("chunks"), F.grouping("topic").cast("int").alias("total"))


def topics(chunks: DataFrame) -> DataFrame:
    """Sorted topics, without null and empty ones."""
    return chunks.where("topic is not null and topic <> ''").select("topic").distinct().orderBy("topic")


def topics_or_default(chunks: DataFrame) -> DataFrame:
    """The same, or the default topic alone if there is none."""
    found = topics(chunks)
    spare = chunks.sparkSession.createDataFrame([(DEFAULT_TOPIC,)], "topic string").join(found.limit(1).select(F.lit(1).alias("some")), how="left").where("some is null").select("topic")
    return found.unionByName(spare).orderBy("topic")


def platforms(chunks: DataFrame) -> DataFrame:
    return chunks.where("platform is not null and platform <> ''").select("platform").distinct().orderBy("platform")


def browse(chunks: DataFrame, of_topic: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of the newest chunks; an empty topic means all topics."""
    if offset < 0 or limit < 0:
        raise ValueError("limit and offset must not be negative")
    limit = min(limit or 50, 500)
    rows = chunks.where(F.col("topic") == of_topic) if of_topic else chunks
    return rows.orderBy(F.desc(F.coalesce("timestamp_ms", F.lit(0))), "id").offset(offset).limit(limit)


def browse_total(chunks: DataFrame, of_topic: str | None = None) -> DataFrame:
    rows = chunks.where(F.col("topic") == of_topic) if of_topic else chunks
    return rows.agg(F.count("*").alias("total"))


def newest(chunks: DataFrame, n: int = 20) -> DataFrame:
    """The n newest chunks of every topic, as the dashboard shows them."""
    key = F.struct((-F.coalesce("timestamp_ms", F.lit(0))).alias("age"), F.col("id"))
    ranked = chunks.select(topic(), "id", F.coalesce("timestamp_ms", F.lit(0)).alias("timestamp_ms"), F.row_number().over(Window.partitionBy(topic()).orderBy(key)).alias("rank"))
    return ranked.where(F.col("rank") <= n)
