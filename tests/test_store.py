import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import catalog, export, search, store, sync
from palimpsest.operators.joins import salted
from palimpsest.operators.ranking import position, position_by_range
from palimpsest.schema import CHUNK
from palimpsest.streaming import ingest

LOG = "seq bigint, id string, document string, source_url string, platform string, topic string, timestamp_ms bigint, file_path string"


def log(spark, rows):
    return spark.createDataFrame(rows, LOG)


@pytest.fixture
def rows(spark):
    return log(spark, [
        (1, "a", "one", "u", "P", "T", 10, None), (2, "b", "two", "u", "P", "T", 10, None), (3, "a", "one again", "u", "P", "S", 20, None),
        (4, "c", "x", "", None, None, None, None), (5, "d", "y", "", "Q", "", 0, None), (5, "d", "y", "", "Q", "", 0, None), (6, "e", None, None, None, "t", 30, "f"),
    ])


def test_last_row_of_an_id_counts(rows):
    got = {r.id: (r.seq, r.document, r.topic) for r in store.latest(rows).collect()}
    assert got == {"a": (3, "one again", "S"), "b": (2, "two", "T"), "c": (4, "x", None), "d": (5, "y", ""), "e": (6, None, "t")}


def test_upsert_twice_is_once(rows):
    assert sorted(store.latest(rows.union(rows)).collect(), key=str) == sorted(store.latest(rows).collect(), key=str)


def test_stale_tail(rows):
    assert [r.id for r in store.stale(store.latest(rows)).collect()] == ["b"]
    assert store.without_stale(store.latest(rows)).count() == 4


def test_deletion_is_literal(rows):
    live = store.latest(rows)
    assert {r.id for r in store.delete_topic(live, "T").collect()} == {"a", "c", "d", "e"}
    assert store.deleted_count(live, "T").first().deleted == 1


def test_store_round_trip(spark, rows, tmp_path):
    s = store.ChunkStore(spark, f"file://{tmp_path}/store")
    chunks = rows.select(*CHUNK.fieldNames())
    assert s.read().count() == 0
    s.append(chunks.where("timestamp_ms = 10"), 0)
    s.append(chunks.where("timestamp_ms = 20"), 1)
    s.append(chunks.where("timestamp_ms = 20"), 1)  # a replay replaces itself
    assert {r.id: r.topic for r in s.read().collect()} == {"a": "S", "b": "T"}
    assert s.delete("T", 2) == 1
    with pytest.raises(KeyError):
        s.delete("T", 3)
    s.compact()
    assert {r.id: r.document for r in s.read().collect()} == {"a": "one again"}
    s.append(chunks.where("id = 'b'"), 4)
    assert {r.id for r in s.read().collect()} == {"a", "b"}


def test_writers_share_a_store(spark, rows, tmp_path):
    """Two writers with the same batch numbers, a batch written again, and one that is in the base already."""
    s = store.ChunkStore(spark, f"file://{tmp_path}/store")
    chunk = lambda i, text: spark.createDataFrame([(i, text, "u", "P", "T", 1, None)], CHUNK)
    assert s.append(chunk("a", "1"), 0, writer="x") and s.append(chunk("b", "2"), 0, writer="y") and s.append(chunk("a", "3"), 1, writer="y")
    assert s.append(chunk("a", "1 again"), 0, writer="x")  # keeps its place before y's
    assert {r.id: r.document for r in s.read().collect()} == {"a": "3", "b": "2"}
    s.compact()
    assert not s.append(chunk("a", "late"), 0, writer="x") and not s.append(chunk("b", "late"), 1, writer="y")
    assert s.append(chunk("b", "4"), 2, writer="y") and s.append(chunk("c", "5"), 1, writer="x") and s.append(chunk("d", "6"), 0, writer="z")
    assert {r.id: r.document for r in s.read().collect()} == {"a": "3", "b": "4", "c": "5", "d": "6"}
    s.compact()
    s.compact()
    assert s.read().count() == 4


def test_order_within_a_batch_is_the_columns(spark, tmp_path):
    s = store.ChunkStore(spark, f"file://{tmp_path}/store")
    df = spark.range(1000).select(F.lit("a").alias("id"), F.col("id").cast("string").alias("document"), *(F.lit(None).cast("string").alias(c) for c in ("source_url", "platform", "topic", "file_path")), F.lit(1).cast("bigint").alias("timestamp_ms"), ((F.col("id") * 7) % 1000).alias("seq"))
    s.append(df.repartition(7), 0, order="seq")
    assert s.read().first().document == str(next(i for i in range(1000) if i * 7 % 1000 == 999))


def test_streams_into_one_store(spark, rows, tmp_path):
    """Two streams, and one of them again with a new checkpoint: nothing is overwritten."""
    s = store.ChunkStore(spark, f"file://{tmp_path}/store")
    for k, topic in enumerate(("S", "T")):
        rows.where(F.col("topic") == topic).write.parquet(f"{tmp_path}/in{k}")
    for k, at in ((0, "c0"), (1, "c1"), (1, "c1"), (0, "c2")):
        source = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in{k}")
        ingest.drain(ingest.into_store(source, s, f"{tmp_path}/{at}", order="seq"))
    assert {(r.id, r.topic) for r in s.read().collect()} == {("a", "S"), ("b", "T")}
    assert len(s._commits()) == 3


def test_cursors_are_saved_after_the_delivery(spark, rows, tmp_path):
    at = sync.CursorStore(spark, f"file://{tmp_path}/cursors")
    live = store.latest(rows)
    assert at.version() == 0 and at.read().count() == 0
    first = at.version()
    sent = sync.delivered(live, at.read(first))
    assert at.commit(sent, first) == 1 and {r.topic: r.cursor_ms for r in at.read().collect()} == {"T": 10, "S": 20, "t": 30}
    with pytest.raises(RuntimeError):
        at.commit(sent, first)  # another delivery was faster
    assert sync.delivered(live, at.read()).count() == 0 and at.read(1).count() == 3


def test_a_source_with_half_of_the_rows(spark):
    """No task gets all rows of the hot key."""
    rows = spark.range(4000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("source_url"), (F.col("id") % 100).alias("timestamp_ms"))
    joined = salted(rows, rows.groupBy("source_url").agg(F.max("timestamp_ms").alias("newest")), "source_url", "id")
    assert joined.count() == 4000 and store.stale(rows).count() == 1960
    spread = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(16))).groupBy("source_url", "salt").count().agg(F.max("count")).first()[0]
    assert spread < 2000 / 8


def test_stats(rows):
    got = {r.topic: (r.chunks, r.sources, r.last_timestamp) for r in catalog.stats_by_topic(store.latest(rows)).collect()}
    assert got == {"S": (1, 1, 20), "T": (1, 1, 10), "Generale": (1, 0, 0), "": (1, 0, 0), "t": (1, 0, 30)}
    assert catalog.totals(rows.where("false")).first().total_chunks == 0
    assert [r.topic for r in catalog.topics_or_default(rows.where("false")).collect()] == ["Generale"]
    assert [r.topic for r in catalog.topics_or_default(rows).collect()] == ["S", "T", "t"]
    assert {r.topic: r.platforms for r in catalog.platform_maps(rows).collect()}["T"] == {"P": 2}


def test_browse(rows):
    live = store.latest(rows)
    assert [r.id for r in catalog.browse(live, limit=2, offset=1).collect()] == ["a", "b"]
    assert catalog.browse(live, "").count() == 5
    assert [r.id for r in catalog.browse(live, "T").collect()] == ["b"]
    with pytest.raises(ValueError):
        catalog.browse(live, offset=-1)


def test_sync(spark, rows):
    live = store.latest(rows)
    cursors = spark.createDataFrame([("T", 10), ("S", 5), ("t", 0)], "topic string, cursor_ms bigint")
    assert {(r.id, r["mode"]) for r in sync.delivered(live, cursors).collect()} == {("a", "incremental"), ("e", "first")}
    assert {(r.id, r["mode"]) for r in sync.delivered(live, cursors, full=True).collect()} == {("a", "full"), ("b", "full"), ("e", "full")}
    after = {r.topic: r.cursor_ms for r in sync.advanced(sync.delivered(live, cursors), cursors).collect()}
    assert after == {"T": 10, "S": 20, "t": 30}
    assert sync.delivered(live, spark.createDataFrame(list(after.items()), "topic string, cursor_ms bigint")).count() == 0


def test_seq_delivers_each_row_once(rows):
    log_rows = rows.dropDuplicates(["seq"])
    seen, last = [], 0
    while batch := sync.after_seq(log_rows, last, 2).collect():
        seen += [r.seq for r in batch]
        last = seen[-1]
    assert seen == [1, 2, 3, 4, 5, 6]


def test_similar_and_missing_topics(spark, rows):
    wanted = spark.createDataFrame([("TX",), ("zzz",), ("T",)], "wanted string")
    cursors = spark.createDataFrame([("T", 99)], "topic string, cursor_ms bigint")
    got = {r.wanted: r.message for r in sync.nothing_new(store.latest(rows), cursors, wanted).collect()}
    assert got == {"TX": "similar: T, t", "zzz": "topics: S, T, t", "T": "nothing new"}
    assert {r.message for r in sync.nothing_new(rows.where("false"), cursors, wanted.where("wanted = 'zzz'")).collect()} == {sync.EMPTY}
    assert sync.listing_text(rows.where("false")).first().text == sync.EMPTY and sync.listing_text(store.latest(rows)).first().text.startswith("1. **S**\n2. **T**")


def test_search(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], "A"), (2, [1.0, 0.0], "B"), (3, [0.0, 0.0], "A"), (4, None, "A"), (5, [0.25, (1 - 0.0625) ** 0.5], "A"), (6, [-1.0, 0.0], "A"), (7, [float("nan"), 1.0], "A"), (8, [1.0], "A")], "seq int, embedding array<double>, topic string")
    assert [r.seq for r in search.topk(rows, [2.0, 0.0], "seq").collect()] == [1, 2, 5]  # a distance of just 0.75 counts
    assert [r.seq for r in search.topk(rows, [2.0, 0.0], "seq", topic="B").collect()] == [2]
    assert search.topk(rows, [2.0, 0.0], "seq", topic="Generale").count() == search.topk(rows, [2.0, 0.0], "seq", topic="").count() == 3
    got = search.batch_topk(rows.where("seq < 3"), rows, "seq", k=2, dims=2).collect()
    assert sorted((r.query, r.neighbour, r["rank"]) for r in got) == [(1, 1, 1), (1, 2, 2), (2, 1, 1), (2, 2, 2)]
    assert search.batch_topk(rows.where("false"), rows, "seq", dims=2).count() == 0


def test_approximate_search_recall(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) + 4 * (j == i % 8) for j in range(16)]) for i in range(800)]
    df = spark.createDataFrame(rows, "seq int, embedding array<double>")
    hits = 0
    for i in (3, 100, 222, 555):
        want = {r.seq for r in search.topk(df, rows[i][1], "seq", k=10, most=2).collect()}
        hits += len(want & {r.seq for r in search.approx_topk(df, rows[i][1], "seq", k=10).collect()})
    assert hits >= 36


def test_export(spark, rows, tmp_path):
    live = store.latest(rows)
    hits = spark.createDataFrame([(2, "two"), (1, "one")], "rank int, label string")
    assert export.context_block(hits, "q?").first().block == "[memory]\n[1] one\n[2] two\n[/memory]\n\nq?"
    assert export.context_block(hits.where("false"), "q?").count() == 0
    export.write_markdown(live, "S", f"{tmp_path}/md", "now")
    text = "\n".join(r.value for r in spark.read.text(f"{tmp_path}/md", wholetext=True).collect())
    assert "# S" in text and "one again" in text and "*Source: u*" in text
    with pytest.raises(KeyError):
        export.write_markdown(live, "none", f"{tmp_path}/md2", "now")
    text = [r.text for r in export.markdown(rows.where("topic = 'T'").unionByName(rows.where("topic = 'S'").withColumn("topic", F.lit("T"))), "now").orderBy("at").collect()]
    assert text[0].startswith("# T") and [t.split("\n\n")[2] for t in text[1:]] == ["one", "two", "one again"]
    brief = [r.text for r in export.briefing_documents(sync.delivered(live, spark.createDataFrame([], "topic string, cursor_ms bigint")).where("topic in ('S', 't')")).orderBy("topic", "at").collect()]
    assert "Mode: first" in brief[0] and brief[1].endswith("\n\none again") and "[unknown]" in export.briefing(rows.withColumn("mode", F.lit("first")))[1].where("id = 'c'").first().entry


def test_position_in_large_and_small_groups(spark):
    df = spark.range(1000).select((F.col("id") % 2 * F.col("id") % 3).alias("g"), F.col("id").alias("n"), F.when(F.col("id") % 7 > 0, F.col("id")).alias("extra"))
    got = position(df, ["g"], ["n"], F.floor(F.col("n") / 10), "at").collect()
    groups = {}
    for r in sorted(got, key=lambda r: r.n):
        assert r["at"] == groups.get(r.g, 0)
        groups[r.g] = r["at"] + 1
    assert len(got) == 1000
    whole = {r.n: r["at"] for r in position_by_range(df, ["g"], ["n"], "at").collect()}
    assert whole == {r.n: r["at"] for r in got}
