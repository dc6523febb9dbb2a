"""Queries over the tables of TESTDATA.md, one or more for each operator."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.functions.register import register, register_search
from palimpsest.functions.vectors import cosine_distance, hashed_embedding, usable
from palimpsest.operators import catalog, export, search, store, sync
from palimpsest.operators.chunking import chunk_code, chunk_message
from palimpsest.operators.ranking import position
from palimpsest.plans.oracle import ORACLE
from palimpsest.sources import files, html, records
from palimpsest.streaming import ingest
from palimpsest.session import cut, ensure_checkpoint_dir, spread, table

NOW_MS = 1_800_000_000_000
EXPORTED = "2027-01-15T08:00:00Z"
PREFIX = r"C:\work"
TOPIC = "Thread"


def _messages(spark: SparkSession, d: str) -> DataFrame:
    """Repeats are exact, so a row of each id is enough, and columns that a query doesn't use aren't read."""
    return spread(table(spark, d, "messages")).dropDuplicates(["message_id"])


def _captures(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "captures").dropDuplicates()


def _chunks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The live chunks: the last row of each id. With columns, seq, id and these only are read and shuffled."""
    log = table(spark, d, "chunks")
    return store.latest(log.select("seq", "id", *columns) if columns else log)


def _files(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "source_files")).dropDuplicates(["file_id"]).withColumn("rel_path", files.relative(F.col("file_path")))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text").where("text is not null"))


# Sources


def record_requests(spark: SparkSession, d: str) -> DataFrame:
    return records.accepted(_captures(spark, d), _messages(spark, d))


def record_chunks(spark: SparkSession, d: str) -> DataFrame:
    return records.record_chunks(_captures(spark, d), _messages(spark, d), NOW_MS)


def file_filter(spark: SparkSession, d: str) -> DataFrame:
    return files.code_files(_files(spark, d)).select("file_id", "rel_path")


def file_filter_custom(spark: SparkSession, d: str) -> DataFrame:
    return files.code_files(_files(spark, d), [".PY", "sql"]).select("file_id", "rel_path")


def file_extensions(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).groupBy(files.extension(F.col("rel_path")).alias("extension")).agg(F.count("*").alias("n"))


def host_path_translate(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select("file_id", X.translate_host_path(F.col("path"), PREFIX).alias("mounted"))


def detect_platform(spark: SparkSession, d: str) -> DataFrame:
    """Captures have invented hosts; every other one gets a registry host in front."""
    hosts = F.element_at(F.array(*(F.lit(h) for h in ("chat.openai.com", "chatgpt.com", "gemini.google.com", "claude.ai", "chat.deepseek.com", "example.org"))), (F.col("capture_id") % 6 + 1).cast("int"))
    url = F.when(F.col("capture_id") % 2 == 0, F.concat(F.lit("https://"), hosts, F.lit("/c/"), F.col("capture_id").cast("string"))).otherwise(F.col("source_url"))
    return _captures(spark, d).select("capture_id", url.alias("url"), X.detect_platform(url).alias("detected"))


def extract_messages(spark: SparkSession, d: str) -> DataFrame:
    """Each message as a page of its own, with its text escaped in the platform's markup, and read again."""
    kept = _messages(spark, d).where("text is not null")
    body = X.html_escape(F.col("text"))
    page = F.concat(F.lit("<html><body><p>menu<div data-message-author-role='"), X.html_escape(F.coalesce("role", F.lit(""))), F.lit("'><span>x</span><div class='a markdown'>"), body, F.lit("</div></div><script>var s = '</p>';</script>"))
    found = html.extract_messages(kept.select("message_id", page.alias("html"), F.lit("ChatGPT").alias("platform")), "message_id")
    return found.select("message_id", "turn", "role", F.regexp_replace("text", X.BLANK + "+", "").alias("letters"))


def extract_messages_manual(spark: SparkSession, d: str) -> DataFrame:
    """Pages of unknown platforms: two long messages and a short one in the innermost container."""
    long = _messages(spark, d).where(F.length(X.trim(F.col("text"))) > 20)
    item = F.concat(F.lit("<li>"), X.html_escape(F.col("text")), F.lit("</li>"))
    page = F.concat(F.lit("<body><section><ul>"), item, F.lit("<li>an answer of more than twenty letters</li><li>ok</li></ul></section><footer>by</footer>"))
    found = html.extract_messages(long.select("message_id", page.alias("html"), F.lit("none").alias("platform")), "message_id")
    return found.select("message_id", "turn", "role", F.regexp_replace("text", X.BLANK + "+", "").alias("letters"))


PAGE_TURNS = 10


def extract_platforms(spark: SparkSession, d: str) -> DataFrame:
    """Pages of all four platforms with up to PAGE_TURNS turns of a capture each, line breaks kept."""
    kept = _messages(spark, d).where("text is not null")
    # A carriage return is none in a page, as its reader would make a line break of it.
    body = F.replace(X.html_escape(F.replace("text", F.lit("\r"), F.lit(""))), F.lit("\n"), F.lit("<br>"))
    page_no = F.floor(F.col("turn") / PAGE_TURNS)
    platform = F.element_at(F.array(*(F.lit(x) for x in ("ChatGPT", "Gemini", "Claude", "DeepSeek"))), (F.pmod(F.col("capture_id") + page_no, F.lit(4)) + 1).cast("int"))
    user = F.coalesce(F.col("role"), F.lit("")) == "user"
    tag = lambda opening, closing: F.concat(F.lit(opening), body, F.lit(closing))
    item = (
        F.when(platform == "ChatGPT", F.concat(F.lit("<div data-message-author-role='"), F.when(user, "user").otherwise("assistant"), F.lit("'><div class='markdown'>"), body, F.lit("</div></div>")))
        .when(platform == "Gemini", F.when(user, tag("<div class='user-request-interior-slot'>", "</div>")).otherwise(tag("<message-content>", "</message-content>")))
        .when(platform == "Claude", F.when(user, tag("<div class='human-turn'>", "</div>")).otherwise(tag("<div class='font-claude-message'>", "</div>")))
        .otherwise(F.concat(F.lit("<div class='message-item"), F.when(user, " user-message").otherwise(""), F.lit("'><b>now</b><div class='message-content'>"), body, F.lit("</div></div>")))
    )
    items = kept.select("capture_id", page_no.alias("page"), platform.alias("platform"), F.struct("turn", "message_id", item.alias("item")).alias("x"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["item"]), "")
    pages = items.groupBy("capture_id", "page", "platform").agg(joined.alias("html"))  # a page holds few turns
    key = F.concat_ws("/", "capture_id", "page")
    return html.extract_messages(pages.select(key.alias("page_id"), F.concat(F.lit("<body><nav>menu<p>x</nav>"), "html").alias("html"), "platform"), "page_id")


def health(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1).select(F.lit(True).alias("ok"))


# Projections


def messages_normalized(spark: SparkSession, d: str) -> DataFrame:
    rows = _messages(spark, d).where(F.length("text") > 2)
    return rows.select("message_id", "capture_id", "turn", X.with_role(F.col("role"), F.col("text")).alias("full_text"))


def chunk_messages(spark: SparkSession, d: str) -> DataFrame:
    return records.message_chunks(_messages(spark, d)).select("message_id", F.col("pos").cast("bigint").alias("pos"), "document")


def chunk_paragraph_packing(spark: SparkSession, d: str) -> DataFrame:
    full = F.concat(F.lit("[USER] "), F.replace("text", F.lit("\n"), F.lit("\n\n")))
    rows = _documents(spark, d).select("doc_id", F.posexplode(chunk_message(full)).alias("pos", "document"))
    return rows.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "document")


def chunk_code_files(spark: SparkSession, d: str) -> DataFrame:
    rows = _files(spark, d).select("file_id", F.posexplode(chunk_code(F.col("rel_path"), F.col("content"))).alias("pos", "document"))
    return rows.select("file_id", F.col("pos").cast("bigint").alias("pos"), "document")


def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    return records.record_chunks(_captures(spark, d), _messages(spark, d), NOW_MS, with_document=False).select("capture_id", "id")


def code_chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    return files.code_chunks(files.code_files(_files(spark, d)), NOW_MS).select("id", "source_url", "platform", "topic", "file_path")


def code_chunk_total(spark: SparkSession, d: str) -> DataFrame:
    return files.chunk_counts(files.code_files(_files(spark, d)))


def hashed_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Dimensions that are not zero."""
    rows = _messages(spark, d).where("text is not null").select("message_id", F.posexplode(hashed_embedding(F.col("text"))).alias("dim", "value"))
    return rows.where("value <> 0").select("message_id", F.col("dim").cast("bigint").alias("dim"), F.round("value", 6).alias("value"))


def result_labels(spark: SparkSession, d: str) -> DataFrame:
    return _captures(spark, d).select("capture_id", X.result_label(F.col("platform"), F.col("topic"), F.lit("text")).alias("label"))


def rendered_dates(spark: SparkSession, d: str) -> DataFrame:
    return _captures(spark, d).select("capture_id", X.render_ms(F.col("timestamp_ms")).alias("rendered"))


def safe_names(spark: SparkSession, d: str) -> DataFrame:
    return _captures(spark, d).where("topic is not null").select("topic", X.file_name(F.col("topic")).alias("file_name"), X.wiki_name(F.col("topic")).alias("wiki_name")).distinct()


def html_escape(spark: SparkSession, d: str) -> DataFrame:
    return _messages(spark, d).select("message_id", X.html_escape(F.col("text")).alias("escaped"))


def platform_badges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("platform").distinct().select("platform", X.badge(F.col("platform")).alias("badge"))


def progress_percent(spark: SparkSession, d: str) -> DataFrame:
    """How far the messages of a capture are through at each turn."""
    n = _messages(spark, d).groupBy("capture_id").agg(F.count("*").alias("total"), F.max("turn").alias("done"))
    return n.select("capture_id", X.percent(F.col("done"), F.col("total")).alias("percent"))


def resolved_topics(spark: SparkSession, d: str) -> DataFrame:
    return _captures(spark, d).select("capture_id", X.resolve_topic(F.col("topic")).alias("topic"))


def parsed_extensions(spark: SparkSession, d: str) -> DataFrame:
    lists = F.concat(F.lit(" ."), F.upper(files.extension(F.col("rel_path"))), F.lit(" ,, js,"))
    return _files(spark, d).select("file_id", F.array_join(X.parse_extensions(lists), "|").alias("extensions"))


def page_limits(spark: SparkSession, d: str) -> DataFrame:
    """Numbers, numbers before letters, negative ones and none."""
    n = (F.col("capture_id") % 700).cast("string")
    asked = F.when(F.col("capture_id") % 5 == 0, "x").when(F.col("capture_id") % 5 == 1, F.concat(F.lit(" "), n, F.lit("abc"))).when(F.col("capture_id") % 5 == 2, F.concat(F.lit("-"), n)).otherwise(n)
    return _captures(spark, d).select("capture_id", X.page_limit(asked).alias("page_limit"), X.page_offset(asked).alias("page_offset"))


def decoded_topics(spark: SparkSession, d: str) -> DataFrame:
    """Topics as a page sends them in its address, read again."""
    return _captures(spark, d).where("topic is not null").select("topic").distinct().select("topic", X.decoded_topic(F.replace(F.url_encode("topic"), F.lit("+"), F.lit("%20"))).alias("decoded"))


def platform_labels(spark: SparkSession, d: str) -> DataFrame:
    return _captures(spark, d).select("capture_id", X.platform_label(F.col("source_url")).alias("label"))


# Store


def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d)


def stale_tail(spark: SparkSession, d: str) -> DataFrame:
    return store.stale(_chunks(spark, d, "source_url", "timestamp_ms")).select("id", "source_url", "timestamp_ms")


def replace_source(spark: SparkSession, d: str) -> DataFrame:
    return store.without_stale(_chunks(spark, d, "source_url", "timestamp_ms")).select("id", "seq")


def delete_topic_remaining(spark: SparkSession, d: str) -> DataFrame:
    return store.delete_topic(_chunks(spark, d, "topic"), TOPIC).select("id", "topic")


def delete_topic_count(spark: SparkSession, d: str) -> DataFrame:
    return store.deleted_count(_chunks(spark, d, "topic"), TOPIC)


# Catalog


def stats_by_topic(spark: SparkSession, d: str) -> DataFrame:
    return catalog.stats_by_topic(_chunks(spark, d, "topic", "source_url", "timestamp_ms"))


def stats_topic_platform(spark: SparkSession, d: str) -> DataFrame:
    return catalog.platforms_by_topic(_chunks(spark, d, "topic", "platform"))


def stats_platform_maps(spark: SparkSession, d: str) -> DataFrame:
    joined = F.array_join(F.transform(F.array_sort(F.map_entries("platforms")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), "; ")
    return catalog.platform_maps(_chunks(spark, d, "topic", "platform")).select("topic", joined.alias("platforms"))


def stats_totals(spark: SparkSession, d: str) -> DataFrame:
    return catalog.totals(_chunks(spark, d, "topic"))


def stats_rollup(spark: SparkSession, d: str) -> DataFrame:
    return catalog.totals_rollup(_chunks(spark, d, "topic"))


def topics_list(spark: SparkSession, d: str) -> DataFrame:
    return catalog.topics_or_default(_chunks(spark, d, "topic"))


def platforms_list(spark: SparkSession, d: str) -> DataFrame:
    return catalog.platforms(_chunks(spark, d, "platform"))


def browse_page(spark: SparkSession, d: str) -> DataFrame:
    return catalog.browse(_chunks(spark, d, "document", "timestamp_ms"), limit=20, offset=40).select("id", "document", "timestamp_ms")


def browse_topic(spark: SparkSession, d: str) -> DataFrame:
    return catalog.browse(_chunks(spark, d, "topic", "document", "timestamp_ms"), TOPIC).select("id", "document", "timestamp_ms")


def browse_total(spark: SparkSession, d: str) -> DataFrame:
    return catalog.browse_total(_chunks(spark, d, "topic"), TOPIC)


def dashboard_newest(spark: SparkSession, d: str) -> DataFrame:
    return catalog.newest(_chunks(spark, d, "topic", "timestamp_ms"))


# Export


def export_entries(spark: SparkSession, d: str) -> DataFrame:
    return export.export_entries(_chunks(spark, d, "topic", "platform", "source_url", "document", "timestamp_ms"))


def export_headers(spark: SparkSession, d: str) -> DataFrame:
    return export.export_header(_chunks(spark, d, "topic"), EXPORTED)


def export_markdown(spark: SparkSession, d: str) -> DataFrame:
    """One document a topic, in rows."""
    return export.markdown(_chunks(spark, d, "topic", "platform", "source_url", "document", "timestamp_ms"), EXPORTED)


# Search


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors with their chunk's topic; vectors of a chunk delivered twice count once."""
    return table(spark, d, "chunk_vectors").join(table(spark, d, "chunks").select("seq", "topic").dropDuplicates(["seq"]), "seq")


def _labelled(spark: SparkSession, d: str, hits: DataFrame) -> DataFrame:
    """The at most k hits with the labels of their chunks."""
    label = X.result_label(F.col("platform"), F.col("topic"), F.col("document")).alias("label")
    chunks = table(spark, d, "chunks").join(F.broadcast(hits.select("seq", "distance")), "seq").dropDuplicates(["seq"])
    return chunks.select("seq", "distance", label)


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    """That of the first usable row."""
    return table(spark, d, "chunk_vectors").where(usable(F.col("embedding"), 64)).orderBy("seq").first()["embedding"]


def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    hits = search.topk(table(spark, d, "chunk_vectors"), _query_vector(spark, d), "seq")
    return _labelled(spark, d, hits).select("seq", F.round("distance", 6).alias("distance"), "label")


def knn_topk_topic(spark: SparkSession, d: str) -> DataFrame:
    return search.topk(_vectors(spark, d), _query_vector(spark, d), "seq", topic=TOPIC, k=10).select("seq", F.round("distance", 6).alias("distance"))


def knn_default_topic_wildcard(spark: SparkSession, d: str) -> DataFrame:
    return search.topk(table(spark, d, "chunk_vectors"), _query_vector(spark, d), "seq", topic="Generale", k=10).select("seq", F.round("distance", 6).alias("distance"))


def knn_within_distance(spark: SparkSession, d: str) -> DataFrame:
    q = F.array(*(F.lit(float(x)) for x in _query_vector(spark, d)))
    rows = table(spark, d, "chunk_vectors").where(usable(F.col("embedding"), 64)).select("seq", F.round(cosine_distance(F.col("embedding"), q), 6).alias("distance"))
    return rows.where("distance <= 0.75")


def knn_batch(spark: SparkSession, d: str) -> DataFrame:
    """Every row whose id is divisible by 50 is a query, against all rows."""
    vectors = table(spark, d, "chunk_vectors")
    found = search.batch_topk(vectors.where("seq % 50 = 0"), vectors, "seq")
    return found.select("query", "neighbour", F.round("distance", 6).alias("distance"), F.col("rank").cast("bigint").alias("rank"))


def knn_approx(spark: SparkSession, d: str) -> DataFrame:
    return search.approx_topk(table(spark, d, "chunk_vectors"), _query_vector(spark, d), "seq").select("seq", F.round("distance", 6).alias("distance"))


def knn_approx_recall(spark: SparkSession, d: str) -> DataFrame:
    """Share of the nearest of ten queries that the approximate search finds, against the exact one: is it 0.9 or more?"""
    vectors = table(spark, d, "chunk_vectors")
    queries = vectors.where(usable(F.col("embedding"), 64)).orderBy(F.xxhash64("seq"), "seq").limit(10).collect()
    both = [(search.topk(vectors, q.embedding, "seq", k=10, most=2.0), search.approx_topk(vectors, q.embedding, "seq", k=10)) for q in queries]
    found = [exact.select("seq").join(near.select("seq", F.lit(1).alias("hit")), "seq", "left") for exact, near in both]
    return reduce(DataFrame.unionByName, found).agg((F.count("hit") >= 0.9 * F.count("*")).alias("enough"))


def table_search(spark: SparkSession, d: str) -> DataFrame:
    """The same search as text_search within the threshold, through the table function."""
    register(spark)
    cut(_chunks(spark, d, "document", "platform", "topic").withColumn("embedding", hashed_embedding(F.col("document")))).createOrReplaceTempView("__chunks_to_search")
    register_search(spark, "__chunks_to_search")
    return spark.sql("SELECT rank, id, round(distance, 6) AS distance, label FROM search('why did the parser block the cache', '', 10)")


def text_search(spark: SparkSession, d: str) -> DataFrame:
    """The chunks nearest to a text under the hashed embedder."""
    rows = _chunks(spark, d, "document").withColumn("embedding", hashed_embedding(F.col("document")))
    return search.text_topk(rows, "why did the parser block the cache", hashed_embedding, "id", k=10, most=2.0).select("id", F.round("distance", 6).alias("distance"))


def context_block(spark: SparkSession, d: str) -> DataFrame:
    hits = _labelled(spark, d, search.topk(table(spark, d, "chunk_vectors"), _query_vector(spark, d), "seq"))
    ranked = hits.select(F.row_number().over(Window.orderBy("distance", "seq")).alias("rank"), "label")  # at most k rows
    return export.context_block(ranked, "What did we decide?")


# Sync


def sync_incremental(spark: SparkSession, d: str) -> DataFrame:
    return sync.delivered(_chunks(spark, d, "topic", "timestamp_ms"), table(spark, d, "sync_cursors")).select("id", "topic", "timestamp_ms", "mode")


def sync_full(spark: SparkSession, d: str) -> DataFrame:
    return sync.delivered(_chunks(spark, d, "topic", "timestamp_ms"), table(spark, d, "sync_cursors"), full=True).select("id", "topic", "timestamp_ms", "mode")


def sync_first(spark: SparkSession, d: str) -> DataFrame:
    return sync.delivered(_chunks(spark, d, "topic", "timestamp_ms"), table(spark, d, "sync_cursors").where("false")).select("id", "topic", "timestamp_ms", "mode")


def cursor_advance(spark: SparkSession, d: str) -> DataFrame:
    cursors = table(spark, d, "sync_cursors")
    return sync.advanced(sync.delivered(_chunks(spark, d, "topic", "timestamp_ms"), cursors), cursors)


def sync_by_seq(spark: SparkSession, d: str) -> DataFrame:
    """What a cursor of timestamps would lose: rows that came after a later one of their topic."""
    log = table(spark, d, "chunks").dropDuplicates(["seq"])
    half = log.agg(F.floor(F.max("seq") / 2).cast("bigint")).first()[0]
    return sync.after_seq(log, half).select("seq", "id")


def similar_topics(spark: SparkSession, d: str) -> DataFrame:
    names = catalog.topics(_chunks(spark, d, "topic"))
    wanted = table(spark, d, "sync_cursors").where("topic <> ''").select(F.col("topic").alias("wanted")).distinct()
    return sync.similar(names, wanted)


def sync_nothing_new(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "sync_cursors").where("topic <> ''").select(F.concat("topic", F.lit(" x")).alias("wanted")).distinct()
    wanted = wanted.unionByName(table(spark, d, "sync_cursors").select(F.col("topic").alias("wanted")).distinct())
    return sync.nothing_new(_chunks(spark, d, "topic", "timestamp_ms"), table(spark, d, "sync_cursors"), wanted)


def cursor_save(spark: SparkSession, d: str) -> DataFrame:
    """Cursors saved, a delivery, its commit, and what is saved then."""
    ensure_checkpoint_dir(spark)
    at = sync.CursorStore(spark, f"{spark.sparkContext.getCheckpointDir()}/cursors-{uuid.uuid4().hex}")
    version = at.save(table(spark, d, "sync_cursors").groupBy("topic").agg(F.max("cursor_ms").alias("cursor_ms")), 0)
    at.commit(sync.delivered(_chunks(spark, d, "topic", "timestamp_ms"), at.read(version)), version)
    return at.read()


def topic_listing_text(spark: SparkSession, d: str) -> DataFrame:
    return sync.listing_text(_chunks(spark, d, "topic"))


def topic_listing(spark: SparkSession, d: str) -> DataFrame:
    return sync.listing(_chunks(spark, d, "topic"))


def briefing_headers(spark: SparkSession, d: str) -> DataFrame:
    return export.briefing(sync.delivered(_chunks(spark, d, "topic", "platform", "document", "timestamp_ms"), table(spark, d, "sync_cursors")))[0]


def briefing_entries(spark: SparkSession, d: str) -> DataFrame:
    return export.briefing(sync.delivered(_chunks(spark, d, "topic", "platform", "document", "timestamp_ms"), table(spark, d, "sync_cursors")))[1]


def briefing_body(spark: SparkSession, d: str) -> DataFrame:
    """The whole briefing of every topic, in rows."""
    return export.briefing_documents(sync.delivered(_chunks(spark, d, "topic", "platform", "document", "timestamp_ms"), table(spark, d, "sync_cursors")))


def job_states(spark: SparkSession, d: str) -> DataFrame:
    """Captures as jobs: without messages failed, the last third still running."""
    n = _messages(spark, d).groupBy("capture_id").agg(F.count("*").alias("total"))
    rows = _captures(spark, d).join(n, "capture_id", "left").select(
        F.col("capture_id").alias("job_id"), F.coalesce("total", F.lit(0)).alias("total"),
        F.when(F.col("capture_id") % 3 == 2, F.floor(F.coalesce("total", F.lit(0)) / 2)).otherwise(F.coalesce("total", F.lit(0))).cast("bigint").alias("done"),
        F.when(F.col("total").isNull(), "no messages").alias("error"), F.when(F.col("capture_id") % 3 != 2, F.lit(NOW_MS) - F.col("capture_id") * 10_000).alias("ended_ms"),
    )
    return ingest.jobs(rows, NOW_MS)


# SQL functions


def _sql(spark: SparkSession, query: str, **views: DataFrame) -> DataFrame:
    register(spark)
    for name, rows in views.items():
        rows.createOrReplaceTempView(f"__{name}")
    return spark.sql(query)


def sql_sanitize_id(spark: SparkSession, d: str) -> DataFrame:
    return _sql(spark, "SELECT capture_id, sanitize_id(coalesce(topic, '') || '/' || coalesce(source_url, 'null')) AS id FROM __captures", captures=_captures(spark, d))


def sql_detect_platform(spark: SparkSession, d: str) -> DataFrame:
    return _sql(spark, "SELECT capture_id, url, detect_platform(url) AS detected FROM __urls", urls=detect_platform(spark, d).select("capture_id", "url"))


def sql_cosine_distance(spark: SparkSession, d: str) -> DataFrame:
    q = ", ".join(f"{float(x)!r}D" for x in _query_vector(spark, d))
    rows = table(spark, d, "chunk_vectors").where(usable(F.col("embedding"), 64)).select("seq", F.col("embedding").cast("array<double>").alias("v"))
    return _sql(spark, f"SELECT * FROM (SELECT seq, round(cosine_distance(v, array({q})), 6) AS distance FROM __vectors) WHERE distance <= 0.75", vectors=rows)


def sql_chunk_messages(spark: SparkSession, d: str) -> DataFrame:
    rows = _messages(spark, d).where("text is not null").select("message_id", X.with_role(F.col("role"), F.col("text")).alias("t"))
    return _sql(spark, "SELECT message_id, CAST(pos AS BIGINT) AS pos, document FROM (SELECT message_id, chunk_message(t) AS c FROM __messages) LATERAL VIEW posexplode(c) AS pos, document", messages=rows)


def sql_chunk_code(spark: SparkSession, d: str) -> DataFrame:
    return _sql(spark, "SELECT file_id, CAST(pos AS BIGINT) AS pos, document FROM (SELECT file_id, chunk_code(rel_path, content) AS c FROM __files) LATERAL VIEW posexplode(c) AS pos, document", files=_files(spark, d).select("file_id", "rel_path", "content"))


def sql_extract_messages(spark: SparkSession, d: str) -> DataFrame:
    """Chat pages of one message each through the table function."""
    page = F.concat(F.lit("<body><div class='human-turn'>"), X.html_escape(F.col("text")), F.lit("</div></body>"))
    rows = _messages(spark, d).where("text is not null").select("message_id", page.alias("page"))
    return _sql(spark, f"SELECT message_id, role, regexp_replace(m.text, r'{X.BLANK}+', '') AS letters FROM __pages, LATERAL extract_messages(page, 'Claude') m", pages=rows)


# Streams


def stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The chunk log as a stream into a store, and its live rows."""
    ensure_checkpoint_dir(spark)
    root = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    log = table(spark, d, "chunks")
    source = spark.readStream.schema(log.schema).parquet(f"{d}/chunks.parquet*")
    at = store.ChunkStore(spark, f"{root}/store")
    ingest.drain(ingest.into_store(source, at, f"{root}/offsets", order="seq"))
    return at.read().select("id", "topic", "timestamp_ms")


def store_two_writers(spark: SparkSession, d: str) -> DataFrame:
    """The log in two halves by two writers with the same batch numbers, compacted in between, the second half replayed."""
    ensure_checkpoint_dir(spark)
    at = store.ChunkStore(spark, f"{spark.sparkContext.getCheckpointDir()}/store-{uuid.uuid4().hex}")
    log = table(spark, d, "chunks")
    half = log.agg(F.floor(F.max("seq") / 2)).first()[0]
    first, second = log.where(F.col("seq") <= half), log.where(F.col("seq") > half)
    at.append(first, 0, writer="a", order="seq")
    at.compact()
    at.append(second, 0, writer="b", order="seq")
    at.append(second, 0, writer="b", order="seq")
    at.append(first, 0, writer="a", order="seq")  # in the base already
    return at.read().select("id", "document", "topic", "timestamp_ms")


def stream_cursor(spark: SparkSession, d: str) -> DataFrame:
    """Events as a stream, delivered past each user's cursor."""
    ensure_checkpoint_dir(spark)
    root = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    events = table(spark, d, "events")
    source = spark.readStream.schema(events.schema).parquet(f"{d}/events.parquet*").select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))
    out = ingest.cursor_stream(source, "user_id", "ts_ms").writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/offsets").outputMode("append").trigger(availableNow=True).start()
    ingest.drain(out)
    return spark.read.parquet(f"{root}/out")


def stream_cursor_late(spark: SparkSession, d: str) -> DataFrame:
    """The same in two batches, of which the second holds late rows: what is at or before the first one's cursor isn't delivered."""
    ensure_checkpoint_dir(spark)
    root = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    events = table(spark, d, "events").select("event_id", "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))
    for part in ("event_id % 3 = 0", "event_id % 3 <> 0"):
        events.where(part).write.mode("append").parquet(f"{root}/in")
        source = spark.readStream.schema("event_id bigint, user_id bigint, ts_ms bigint").parquet(f"{root}/in")
        out = ingest.cursor_stream(source.select("user_id", "ts_ms"), "user_id", "ts_ms").writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/offsets")
        ingest.drain(out.outputMode("append").trigger(availableNow=True).start())
    return spark.read.parquet(f"{root}/out")


def message_positions(spark: SparkSession, d: str) -> DataFrame:
    """Position of each message in its capture."""
    rows = _messages(spark, d).select("message_id", "capture_id", "turn")
    return position(rows, ["capture_id"], ["turn", "message_id"], F.floor(F.col("turn") / records.TURNS), "at").select("message_id", F.col("at").cast("bigint").alias("at"))


HELPERS = {"queries", "oracle_sql"}


def queries():
    return {k: f for k, f in globals().items() if callable(f) and not k.startswith("_") and k not in HELPERS and getattr(f, "__module__", "") == __name__}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
