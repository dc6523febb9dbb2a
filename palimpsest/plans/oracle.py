"""The same results in SQL, as DuckDB runs it over the same tables."""

from __future__ import annotations

from palimpsest.schema import EXTENSIONS, PLATFORMS, SKIPPED_NAMES, SKIPPED_SUFFIXES

NOW_MS = 1_800_000_000_000
#: White space with no-break space and byte order mark, for RE2, whose \s lacks the vertical tab.
BLANK = r"[\s\x{000b}\x{00a0}\x{feff}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def trim(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^{BLANK}+|{BLANK}+$')}, '', 'g')"


MESSAGES = "msg AS (SELECT DISTINCT * FROM messages)"
CAPTURES = "cap AS (SELECT DISTINCT * FROM captures)"
CHUNKS = "live AS (SELECT * FROM (SELECT DISTINCT * FROM chunks) QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1)"
FILES = "fil AS (SELECT *, replace(file_path, '\\', '/') AS rel_path FROM (SELECT * FROM source_files QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY path) = 1))"
EXT = "lower(regexp_extract(regexp_extract(rel_path, '([^/]*)$', 1), '^.+\\.([^.]*)$', 1))"
TOPIC, PLATFORM = "coalesce(topic, 'Generale')", "coalesce(platform, 'unknown')"


def kept(extensions: list[str]) -> str:
    names = ", ".join(map(q, SKIPPED_NAMES))
    suffix = q("|".join(SKIPPED_SUFFIXES))
    return (
        f"len(list_filter(string_split(rel_path, '/'), lambda p: p IN ({names}) OR starts_with(p, '.'))) = 0 "
        f"AND NOT regexp_matches(regexp_extract(rel_path, '([^/]*)$', 1), {suffix}) AND {EXT} IN ({', '.join(map(q, extensions))}) AND length(content) <= 200000"
    )


def packing(source: str, key: str) -> str:
    """Recursive CTEs over (key, full_text) rows of source; result: packed(key, pos, document)."""
    return f"""
src AS ({source}),
fold AS (
  SELECT {key}, string_split_regex(full_text, '\\n{{2,}}') AS p, 0 AS i, '' AS cur, []::VARCHAR[] AS out FROM src WHERE length(full_text) > 800
  UNION ALL
  SELECT {key}, p, i + 1,
    CASE WHEN fits THEN CASE WHEN cur = '' THEN para ELSE cur || chr(10) || chr(10) || para END WHEN length(para) > 800 THEN '' ELSE para END,
    CASE WHEN fits THEN out ELSE list_concat(CASE WHEN cur <> '' THEN list_append(out, cur) ELSE out END,
      CASE WHEN length(para) > 800 THEN list_transform(range(0, CAST(ceil(length(para) / 720.0) AS BIGINT)), lambda k: substr(para, 1 + 720 * k, 800)) ELSE []::VARCHAR[] END) END
  FROM (SELECT *, p[i + 1] AS para, length(cur) + 2 + length(p[i + 1]) <= 800 AS fits FROM fold WHERE i < len(p))
),
lists AS (
  SELECT {key}, CASE WHEN cur <> '' THEN list_append(out, cur) ELSE out END AS out FROM fold WHERE i = len(p)
  UNION ALL SELECT {key}, [full_text] FROM src WHERE length(full_text) <= 800
),
kept AS (SELECT {key}, list_filter(out, lambda c: {trim('c')} <> '') AS out FROM lists),
packed AS (SELECT {key}, unnest(range(0, len(out))) AS pos, unnest(out) AS document FROM kept)"""


MESSAGE_SOURCE = "SELECT message_id, '[' || upper(coalesce(role, 'unknown')) || '] ' || text AS full_text FROM msg WHERE text IS NOT NULL"
CODE = f"""
cfold AS (
  SELECT file_id, '[FILE: ' || rel_path || ']' AS header, string_split(content, chr(10)) AS p, 0 AS i, '[FILE: ' || rel_path || ']' || chr(10) AS cur, []::VARCHAR[] AS out FROM picked
  UNION ALL
  SELECT file_id, header, p, i + 1,
    CASE WHEN flush THEN header || chr(10) || array_to_string(string_split(cur, chr(10))[-6:], chr(10)) || chr(10) || line || chr(10) ELSE cur || line || chr(10) END,
    CASE WHEN flush THEN list_append(out, {trim('cur')}) ELSE out END
  FROM (SELECT *, p[i + 1] AS line, length(cur) + length(p[i + 1]) + 1 > 800 AND {trim('cur')} <> header AS flush FROM cfold WHERE i < len(p))
),
clists AS (SELECT file_id, CASE WHEN {trim('cur')} NOT IN ('', header) THEN list_append(out, {trim('cur')}) ELSE out END AS out FROM cfold WHERE i = len(p)),
coded AS (SELECT file_id, unnest(range(0, len(out))) AS pos, unnest(out) AS document FROM clists)"""

NUMBERED = f"""WITH RECURSIVE {MESSAGES}, {CAPTURES}, {packing(MESSAGE_SOURCE, 'message_id')},
numbered AS (SELECT capture_id, document, row_number() OVER (PARTITION BY capture_id ORDER BY turn, message_id, pos) - 1 AS i FROM packed JOIN (SELECT message_id, capture_id, turn FROM msg) USING (message_id))"""
RECORD_ID = "regexp_replace(coalesce(source_url, 'null') || '_' || i, '[^a-zA-Z0-9_-]', '_', 'g')"
VECTOR = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
VECTORS = f"vec AS (SELECT * FROM chunk_vectors WHERE embedding IS NOT NULL AND {VECTOR})"
QUERY = "qv AS (SELECT embedding AS qe FROM vec ORDER BY seq LIMIT 1)"
META = "meta AS (SELECT * FROM (SELECT DISTINCT seq, document, platform, topic FROM chunks) QUALIFY row_number() OVER (PARTITION BY seq ORDER BY document) = 1)"
DISTANCE = "list_cosine_distance(embedding::DOUBLE[], qe::DOUBLE[])"
LABEL = "'[' || coalesce(platform, '?') || ' — ' || coalesce(topic, '?') || ']' || chr(10) || document"
RENDER = "strftime(make_timestamp(timestamp_ms * 1000), '%-d/%-m/%Y, %H:%M:%S')"
WORDS = "list_filter(string_split_regex(lower(document), '[^a-z0-9]+'), lambda w: w <> '')"
BUCKET = "CAST(('0x' || substr(md5(w), 1, 8)) AS BIGINT) % 64"


def nearest(topic: str | None, k: int, columns: str) -> str:
    where = f"AND topic = {q(topic)}" if topic else ""
    return f"WITH {VECTORS}, {META}, {QUERY}, hit AS (SELECT *, {DISTANCE} AS dist FROM vec JOIN meta USING (seq), qv WHERE {DISTANCE} <= 0.75 {where} ORDER BY dist, seq LIMIT {k}) SELECT {columns} FROM hit"


def delivered(cursors: str, full: bool = False) -> str:
    keep = "TRUE" if full else "cursor_ms IS NULL OR timestamp_ms > cursor_ms"
    mode = "'full'" if full else "CASE WHEN cursor_ms IS NULL THEN 'first' ELSE 'incremental' END"
    return f"""{CHUNKS}, known AS (SELECT topic, max(cursor_ms) AS cursor_ms FROM {cursors} WHERE cursor_ms > 0 GROUP BY topic),
sent AS (SELECT live.*, {mode} AS mode FROM live LEFT JOIN known USING (topic) WHERE live.topic IS NOT NULL AND live.topic <> '' AND ({keep}))"""


ENTRY = f"'## [' || {PLATFORM} || '] — ' || CASE WHEN coalesce(timestamp_ms, 0) = 0 THEN '?' ELSE {RENDER} END || chr(10) || chr(10) || CASE WHEN coalesce(source_url, '') <> '' THEN '*Source: ' || source_url || '*' || chr(10) || chr(10) ELSE '' END || document || chr(10) || chr(10) || '---' || chr(10)"
BRIEF = f"'### [' || {PLATFORM} || '] — ' || CASE WHEN coalesce(timestamp_ms, 0) = 0 THEN '?' ELSE {RENDER} END || chr(10) || chr(10) || document"
HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1))"
ESCAPED = "replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"
HOSTS = "['chat.openai.com', 'chatgpt.com', 'gemini.google.com', 'claude.ai', 'chat.deepseek.com', 'example.org']"
PLAIN_PATH = "lower(regexp_replace(replace(path, '\\', '/'), '/+$', ''))"

ORACLE: dict[str, str] = {
    "record_requests": f"WITH {MESSAGES}, {CAPTURES}, n AS (SELECT capture_id, count(*) AS n FROM msg GROUP BY 1) SELECT capture_id, coalesce(n, 0) AS n_messages, CAST(CASE WHEN coalesce(n, 0) > 0 THEN 202 ELSE 400 END AS INTEGER) AS status FROM cap LEFT JOIN n USING (capture_id)",
    "record_chunks": f"{NUMBERED} SELECT {RECORD_ID} AS id, document, coalesce(source_url, '') AS source_url, {PLATFORM} AS platform, {TOPIC} AS topic, coalesce(timestamp_ms, {NOW_MS}) AS timestamp_ms, CAST(NULL AS VARCHAR) AS file_path, capture_id FROM numbered JOIN cap USING (capture_id)",
    "file_filter": f"WITH {FILES} SELECT file_id, rel_path FROM fil WHERE {kept(EXTENSIONS)}",
    "file_filter_custom": f"WITH {FILES} SELECT file_id, rel_path FROM fil WHERE {kept(['py', 'sql'])}",
    "file_extensions": f"WITH {FILES} SELECT {EXT} AS extension, count(*) AS n FROM fil GROUP BY 1",
    "host_path_translate": f"WITH {FILES} SELECT file_id, CASE WHEN {PLAIN_PATH} = 'c:/work' THEN '/workspace' WHEN starts_with({PLAIN_PATH}, 'c:/work/') THEN '/workspace' || substr(replace(path, '\\', '/'), 8) ELSE path END AS mounted FROM fil",
    "detect_platform": f"WITH {CAPTURES}, u AS (SELECT capture_id, CASE WHEN capture_id % 2 = 0 THEN 'https://' || {HOSTS}[capture_id % 6 + 1] || '/c/' || capture_id ELSE source_url END AS url FROM cap) SELECT capture_id, url, CASE {' '.join(f'WHEN contains({HOST}, {q(h)}) THEN {q(n)}' for h, n in PLATFORMS)} END AS detected FROM u",
    "extract_messages": f"WITH {MESSAGES}, t AS (SELECT message_id, CASE WHEN coalesce(role, '') = '' THEN 'unknown' ELSE role END AS role, {trim('text')} AS body FROM msg WHERE text IS NOT NULL), u AS (SELECT message_id, role, CASE WHEN body = '' THEN 'x' ELSE body END AS body FROM t) SELECT message_id, CAST(0 AS BIGINT) AS turn, role, regexp_replace(body, {q(BLANK + '+')}, '', 'g') AS letters FROM u WHERE length(body) > 2",
    "extract_messages_manual": f"""WITH {MESSAGES}, t AS (SELECT message_id, regexp_replace(text, {q(BLANK + '+')}, '', 'g') AS body FROM msg WHERE length({trim('text')}) > 20)
SELECT message_id, CAST(0 AS BIGINT) AS turn, 'unknown' AS role, body AS letters FROM t UNION ALL SELECT message_id, 1, 'unknown', 'ananswerofmorethantwentyletters' FROM t""",
    "health": "SELECT TRUE AS ok",
    "messages_normalized": f"WITH {MESSAGES} SELECT message_id, capture_id, turn, '[' || upper(coalesce(role, 'unknown')) || '] ' || text AS full_text FROM msg WHERE length(text) > 2",
    "chunk_messages": f"WITH RECURSIVE {MESSAGES}, {packing(MESSAGE_SOURCE, 'message_id')} SELECT message_id, pos, document FROM packed",
    "chunk_paragraph_packing": f"""WITH RECURSIVE {packing("SELECT doc_id, '[USER] ' || replace(text, chr(10), chr(10) || chr(10)) AS full_text FROM documents WHERE text IS NOT NULL", 'doc_id')} SELECT doc_id, pos, document FROM packed""",
    "chunk_code_files": f"WITH RECURSIVE {FILES}, picked AS (SELECT * FROM fil), {CODE} SELECT file_id, pos, document FROM coded",
    "chunk_ids": f"{NUMBERED} SELECT capture_id, {RECORD_ID} AS id FROM numbered JOIN cap USING (capture_id)",
    "code_chunk_ids": f"WITH RECURSIVE {FILES}, picked AS (SELECT * FROM fil WHERE {kept(EXTENSIONS)}), {CODE} SELECT regexp_replace('codebase_' || {TOPIC} || '_' || rel_path, '[^a-zA-Z0-9_-]', '_', 'g') || '_' || pos AS id, 'file://' || path AS source_url, 'codebase' AS platform, {TOPIC} AS topic, rel_path AS file_path FROM coded JOIN fil USING (file_id)",
    "code_chunk_total": f"WITH RECURSIVE {FILES}, picked AS (SELECT * FROM fil WHERE {kept(EXTENSIONS)}), {CODE} SELECT greatest(count(*), 1) AS total FROM coded",
    "hashed_embeddings": f"WITH {MESSAGES}, w AS (SELECT message_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> '')) AS w FROM msg WHERE text IS NOT NULL), b AS (SELECT message_id, {BUCKET} AS dim, count(*) AS n FROM w GROUP BY ALL) SELECT message_id, dim, round(n / sqrt(sum(n * n) OVER (PARTITION BY message_id)), 6) AS value FROM b",
    "result_labels": f"WITH {CAPTURES} SELECT capture_id, '[' || coalesce(platform, '?') || ' — ' || coalesce(topic, '?') || ']' || chr(10) || 'text' AS label FROM cap",
    "rendered_dates": f"WITH {CAPTURES} SELECT capture_id, CASE WHEN coalesce(timestamp_ms, 0) = 0 THEN '?' ELSE {RENDER} END AS rendered FROM cap",
    "safe_names": f"WITH {CAPTURES} SELECT DISTINCT topic, regexp_replace(topic, {q(BLANK + '+')}, '_', 'g') AS file_name, regexp_replace(topic, {q(BLANK[:-1] + chr(92) + '/' + chr(92) * 2 + ':*?<>|' + chr(34) + ']')}, '_', 'g') AS wiki_name FROM cap WHERE topic IS NOT NULL",
    "html_escape": f"WITH {MESSAGES} SELECT message_id, {ESCAPED} AS escaped FROM msg",
    "platform_badges": "SELECT DISTINCT platform, CASE WHEN platform = 'codebase' THEN 'codebase' WHEN starts_with(platform, 'Manual') THEN 'manual' ELSE '' END AS badge FROM chunks",
    "progress_percent": f"WITH {MESSAGES} SELECT capture_id, CASE WHEN count(*) > 0 THEN CAST(floor(max(turn) * 100.0 / count(*) + 0.5) AS BIGINT) ELSE 0 END AS percent FROM msg GROUP BY 1",
    "resolved_topics": f"WITH {CAPTURES} SELECT capture_id, coalesce(nullif({trim('topic')}, ''), 'Generale') AS topic FROM cap",
    "parsed_extensions": f"WITH {FILES} SELECT file_id, CASE WHEN {EXT} = '' THEN '|js' ELSE {EXT} || '|js' END AS extensions FROM fil",
    "page_limits": f"WITH {CAPTURES} SELECT capture_id, CAST(least(CASE WHEN capture_id % 5 IN (0, 2) OR capture_id % 700 = 0 THEN 50 ELSE capture_id % 700 END, 500) AS INTEGER) AS page_limit, CASE WHEN capture_id % 5 IN (0, 2) THEN 0 ELSE capture_id % 700 END AS page_offset FROM cap",
    "decoded_topics": f"WITH {CAPTURES} SELECT DISTINCT topic, topic AS decoded FROM cap WHERE topic IS NOT NULL",
    "platform_labels": f"WITH {CAPTURES}, u AS (SELECT capture_id, source_url AS url FROM cap) SELECT capture_id, coalesce(CASE {' '.join(f'WHEN contains({HOST}, {q(h)}) THEN {q(n)}' for h, n in PLATFORMS)} END, 'Manual:' || {HOST}) AS label FROM u",
    "extract_platforms": f"""WITH {MESSAGES}, t AS (SELECT *, turn // 10 AS page, {trim("replace(text, chr(13), '')")} AS body FROM msg WHERE text IS NOT NULL)
SELECT capture_id || '/' || page AS page_id, row_number() OVER (PARTITION BY capture_id, page ORDER BY turn, message_id) - 1 AS turn, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS role, body AS text FROM t WHERE length(body) > 2""",
    "upsert_latest": f"WITH {CHUNKS} SELECT * FROM live",
    "stale_tail": f"WITH {CHUNKS} SELECT id, source_url, timestamp_ms FROM (SELECT *, max(timestamp_ms) OVER (PARTITION BY source_url) AS newest FROM live WHERE source_url <> '') WHERE timestamp_ms < newest",
    "replace_source": f"WITH {CHUNKS} SELECT id, seq FROM (SELECT *, max(CASE WHEN source_url <> '' THEN timestamp_ms END) OVER (PARTITION BY source_url) AS newest FROM live) WHERE newest IS NULL OR timestamp_ms IS NULL OR timestamp_ms >= newest",
    "delete_topic_remaining": f"WITH {CHUNKS} SELECT id, topic FROM live WHERE topic IS DISTINCT FROM 'Thread'",
    "delete_topic_count": f"WITH {CHUNKS} SELECT count(DISTINCT id) AS deleted FROM live WHERE topic = 'Thread'",
    "stats_by_topic": f"WITH {CHUNKS} SELECT {TOPIC} AS topic, count(*) AS chunks, count(DISTINCT nullif(source_url, '')) AS sources, greatest(max(coalesce(timestamp_ms, 0)), 0) AS last_timestamp FROM live GROUP BY 1",
    "stats_topic_platform": f"WITH {CHUNKS} SELECT {TOPIC} AS topic, {PLATFORM} AS platform, count(*) AS chunks FROM live GROUP BY 1, 2",
    "stats_platform_maps": f"WITH {CHUNKS}, n AS (SELECT {TOPIC} AS topic, {PLATFORM} AS platform, count(*) AS chunks FROM live GROUP BY 1, 2) SELECT topic, string_agg(platform || '=' || chunks, '; ' ORDER BY platform) AS platforms FROM n GROUP BY 1",
    "stats_totals": f"WITH {CHUNKS} SELECT count(*) AS total_chunks, count(DISTINCT {TOPIC}) AS total_topics FROM live",
    "stats_rollup": f"WITH {CHUNKS}, t AS (SELECT {TOPIC} AS topic FROM live) SELECT topic, count(*) AS chunks, CAST(grouping(topic) AS INTEGER) AS total FROM t GROUP BY ROLLUP (topic)",
    "topics_list": f"WITH {CHUNKS} SELECT DISTINCT topic FROM live WHERE topic <> ''",
    "platforms_list": f"WITH {CHUNKS} SELECT DISTINCT platform FROM live WHERE platform <> ''",
    "browse_page": f"WITH {CHUNKS} SELECT id, document, timestamp_ms FROM live ORDER BY coalesce(timestamp_ms, 0) DESC, id LIMIT 20 OFFSET 40",
    "browse_topic": f"WITH {CHUNKS} SELECT id, document, timestamp_ms FROM live WHERE topic = 'Thread' ORDER BY coalesce(timestamp_ms, 0) DESC, id LIMIT 50",
    "browse_total": f"WITH {CHUNKS} SELECT count(*) AS total FROM live WHERE topic = 'Thread'",
    "dashboard_newest": f"WITH {CHUNKS} SELECT * FROM (SELECT {TOPIC} AS topic, id, coalesce(timestamp_ms, 0) AS timestamp_ms, CAST(row_number() OVER (PARTITION BY {TOPIC} ORDER BY coalesce(timestamp_ms, 0) DESC, id) AS INTEGER) AS rank FROM live) WHERE rank <= 20",
    "export_entries": f"WITH {CHUNKS} SELECT topic, coalesce(timestamp_ms, 0) AS timestamp_ms, id, {ENTRY} AS entry FROM live",
    "export_markdown": f"WITH {CHUNKS}, h AS (SELECT topic, '# ' || topic || chr(10) || chr(10) || 'Exported: 2027-01-15T08:00:00Z' || chr(10) || 'Chunks: ' || count(*) || chr(10) || chr(10) || '---' || chr(10) AS header FROM live GROUP BY topic) SELECT topic, row_number() OVER (PARTITION BY topic ORDER BY coalesce(timestamp_ms, 0), id) AS at, {ENTRY} AS text FROM live UNION ALL SELECT topic, 0, header FROM h",
    "export_headers": f"WITH {CHUNKS} SELECT topic, 'export_' || regexp_replace(topic, {q(BLANK + '+')}, '_', 'g') || '.md' AS file_name, '# ' || topic || chr(10) || chr(10) || 'Exported: 2027-01-15T08:00:00Z' || chr(10) || 'Chunks: ' || count(*) || chr(10) || chr(10) || '---' || chr(10) AS header FROM live GROUP BY topic",
    "knn_topk": nearest(None, 4, f"seq, round(dist, 6) AS distance, {LABEL} AS label"),
    "knn_topk_topic": nearest("Thread", 10, "seq, round(dist, 6) AS distance"),
    "knn_default_topic_wildcard": nearest(None, 10, "seq, round(dist, 6) AS distance"),
    "knn_within_distance": f"WITH {VECTORS}, {QUERY} SELECT seq, round({DISTANCE}, 6) AS distance FROM vec, qv WHERE round({DISTANCE}, 6) <= 0.75",
    "knn_batch": f"WITH {VECTORS}, qs AS (SELECT seq AS query, embedding AS qe FROM vec WHERE seq % 50 = 0) SELECT * FROM (SELECT query, seq AS neighbour, round({DISTANCE}, 6) AS distance, row_number() OVER (PARTITION BY query ORDER BY round({DISTANCE}, 9), seq) AS rank FROM qs, vec) WHERE rank <= 4",
    "text_search": f"""WITH {CHUNKS}, t AS (SELECT id, document FROM live UNION ALL SELECT NULL, 'why did the parser block the cache'),
w AS (SELECT id, unnest({WORDS}) AS w FROM t), b AS (SELECT id, {BUCKET} AS dim, count(*) AS n FROM w GROUP BY ALL), qn AS (SELECT dim, n FROM b WHERE id IS NULL),
s AS (SELECT b.id, sqrt(sum(b.n * b.n)) AS size, coalesce(sum(b.n * qn.n), 0) AS product FROM b LEFT JOIN qn USING (dim) WHERE b.id IS NOT NULL GROUP BY b.id)
SELECT id, round(1 - product / (size * (SELECT sqrt(sum(n * n)) FROM qn)), 6) AS distance FROM s ORDER BY round(1 - product / (size * (SELECT sqrt(sum(n * n)) FROM qn)), 12), id LIMIT 10""",
    "table_search": f"""WITH {CHUNKS}, t AS (SELECT id, document FROM live UNION ALL SELECT NULL, 'why did the parser block the cache'),
w AS (SELECT id, unnest({WORDS}) AS w FROM t), b AS (SELECT id, {BUCKET} AS dim, count(*) AS n FROM w GROUP BY ALL), qn AS (SELECT dim, n FROM b WHERE id IS NULL),
s AS (SELECT b.id, sqrt(sum(b.n * b.n)) AS size, coalesce(sum(b.n * qn.n), 0) AS product FROM b LEFT JOIN qn USING (dim) WHERE b.id IS NOT NULL GROUP BY b.id),
r AS (SELECT id, 1 - product / (size * (SELECT sqrt(sum(n * n)) FROM qn)) AS distance FROM s),
k AS (SELECT *, row_number() OVER (ORDER BY round(distance, 12), id) AS rank FROM r WHERE distance <= 0.75)
SELECT CAST(rank AS INTEGER) AS rank, id, round(distance, 6) AS distance, {LABEL} AS label FROM k JOIN live USING (id) WHERE rank <= 10""",
    "context_block": nearest(None, 4, f"'[memory]' || chr(10) || string_agg('[' || r || '] ' || {LABEL}, chr(10) ORDER BY r) || chr(10) || '[/memory]' || chr(10) || chr(10) || 'What did we decide?' AS block").replace("FROM hit", "FROM (SELECT *, row_number() OVER (ORDER BY dist, seq) AS r FROM hit) HAVING count(*) > 0"),
    "sync_incremental": f"WITH {delivered('sync_cursors')} SELECT id, topic, timestamp_ms, mode FROM sent",
    "sync_full": f"WITH {delivered('sync_cursors', True)} SELECT id, topic, timestamp_ms, mode FROM sent",
    "sync_first": f"WITH {CHUNKS} SELECT id, topic, timestamp_ms, 'first' AS mode FROM live WHERE topic <> ''",
    "cursor_advance": f"WITH {delivered('sync_cursors')}, top AS (SELECT topic, max(coalesce(timestamp_ms, 0)) AS sent_ms FROM sent GROUP BY 1 HAVING sent_ms > 0), old AS (SELECT topic, max(cursor_ms) AS cursor_ms FROM sync_cursors GROUP BY 1) SELECT topic, coalesce(sent_ms, cursor_ms) AS cursor_ms FROM old FULL JOIN top USING (topic)",
    "cursor_save": f"WITH {delivered('sync_cursors')}, top AS (SELECT topic, max(coalesce(timestamp_ms, 0)) AS sent_ms FROM sent GROUP BY 1 HAVING sent_ms > 0), old AS (SELECT topic, max(cursor_ms) AS cursor_ms FROM sync_cursors GROUP BY 1) SELECT topic, coalesce(sent_ms, cursor_ms) AS cursor_ms FROM old FULL JOIN top USING (topic)",
    "sync_by_seq": "SELECT DISTINCT seq, id FROM chunks WHERE seq > (SELECT CAST(floor(max(seq) / 2) AS BIGINT) FROM chunks)",
    "similar_topics": f"WITH {CHUNKS}, t AS (SELECT DISTINCT topic FROM live WHERE topic <> ''), w AS (SELECT DISTINCT topic AS wanted FROM sync_cursors WHERE topic <> '') SELECT wanted, topic FROM w, t WHERE contains(lower(topic), lower(wanted)) OR contains(lower(wanted), lower(topic))",
    "sync_nothing_new": f"""WITH {delivered('sync_cursors')}, wanted AS (SELECT DISTINCT topic || ' x' AS wanted FROM sync_cursors WHERE topic <> '' UNION ALL SELECT DISTINCT topic FROM sync_cursors),
none AS (SELECT wanted FROM wanted WHERE wanted IS NULL OR wanted NOT IN (SELECT topic FROM sent)), t AS (SELECT DISTINCT topic FROM live WHERE topic <> ''),
close AS (SELECT wanted, string_agg(DISTINCT topic, ', ' ORDER BY topic) AS close FROM none, t WHERE contains(lower(topic), lower(wanted)) OR contains(lower(wanted), lower(topic)) GROUP BY 1)
SELECT none.wanted, CASE WHEN cursor_ms IS NOT NULL THEN 'nothing new' WHEN close IS NOT NULL THEN 'similar: ' || close ELSE (SELECT coalesce('topics: ' || string_agg(topic, ', ' ORDER BY topic), 'nothing is stored yet') FROM t) END AS message FROM none LEFT JOIN known ON known.topic = none.wanted LEFT JOIN close ON close.wanted = none.wanted""",
    "knn_approx_recall": "SELECT TRUE AS enough",
    "topic_listing_text": f"WITH {CHUNKS}, t AS (SELECT DISTINCT topic FROM live WHERE topic <> ''), n AS (SELECT row_number() OVER (ORDER BY topic) AS number, topic FROM t) SELECT coalesce(string_agg(number || '. **' || topic || '**', chr(10) ORDER BY number), 'nothing is stored yet') AS text FROM n",
    "topic_listing": f"WITH {CHUNKS}, t AS (SELECT DISTINCT topic FROM live WHERE topic <> '') SELECT row_number() OVER (ORDER BY topic) AS number, topic FROM t",
    "briefing_headers": f"WITH {delivered('sync_cursors')} SELECT topic, mode, count(*) AS total, string_agg(DISTINCT platform, ', ' ORDER BY platform) AS platforms, CASE WHEN mode = 'incremental' THEN 'What follows is new since the last time.' ELSE 'Read what follows and keep it in mind.' END AS instruction FROM sent GROUP BY topic, mode",
    "briefing_entries": f"WITH {delivered('sync_cursors')} SELECT topic, coalesce(timestamp_ms, 0) AS timestamp_ms, id, {BRIEF} AS entry FROM sent",
    "briefing_body": f"""WITH {delivered('sync_cursors')}, e AS (SELECT topic, {BRIEF} AS entry, row_number() OVER w AS at, row_number() OVER w = count(*) OVER (PARTITION BY topic) AS is_last FROM sent WINDOW w AS (PARTITION BY topic ORDER BY coalesce(timestamp_ms, 0), id)),
h AS (SELECT topic, mode, count(*) AS total, string_agg(DISTINCT platform, ', ' ORDER BY platform) AS platforms FROM sent GROUP BY topic, mode)
SELECT topic, e."at" AS at, entry || CASE WHEN is_last THEN '' ELSE chr(10) || chr(10) || '---' || chr(10) || chr(10) END AS text FROM e
UNION ALL SELECT topic, 0, '# ' || topic || chr(10) || 'Chunks: ' || total || ' | Platforms: ' || platforms || chr(10) || 'Mode: ' || mode || chr(10) || chr(10) || CASE WHEN mode = 'incremental' THEN 'What follows is new since the last time.' ELSE 'Read what follows and keep it in mind.' END || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## Chunks (' || total || ')' || chr(10) || chr(10) FROM h""",
    "job_states": f"""WITH {MESSAGES}, {CAPTURES}, n AS (SELECT capture_id, count(*) AS n FROM msg GROUP BY 1),
j AS (SELECT capture_id AS job_id, coalesce(n, 0) AS total, CASE WHEN capture_id % 3 = 2 THEN coalesce(n, 0) // 2 ELSE coalesce(n, 0) END AS done, n IS NULL AS failed, CASE WHEN capture_id % 3 <> 2 THEN {NOW_MS} - capture_id * 10000 END AS ended_ms FROM cap LEFT JOIN n USING (capture_id))
SELECT job_id, CASE WHEN failed THEN 'error' WHEN ended_ms IS NOT NULL THEN 'done' ELSE 'processing' END AS status, done, total, CASE WHEN total > 0 THEN CAST(floor(done * 100.0 / total + 0.5) AS BIGINT) ELSE 0 END AS percent FROM j WHERE ended_ms IS NULL OR ended_ms + 600000 > {NOW_MS}""",
    "stream_upsert": f"WITH {CHUNKS} SELECT id, topic, timestamp_ms FROM live",
    "store_two_writers": f"WITH {CHUNKS} SELECT id, document, topic, timestamp_ms FROM live",
    "stream_cursor": "SELECT user_id, count(*) AS n, max(epoch_us(ts) // 1000) AS cursor_ms FROM events GROUP BY 1",
    "stream_cursor_late": """WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms FROM events), a AS (SELECT user_id, count(*) AS n, max(ms) AS cursor_ms FROM e WHERE event_id % 3 = 0 GROUP BY 1)
SELECT * FROM a UNION ALL SELECT e.user_id, count(*), max(ms) FROM e LEFT JOIN a USING (user_id) WHERE event_id % 3 <> 0 AND ms > coalesce(cursor_ms, 0) GROUP BY 1""",
    "message_positions": f"WITH {MESSAGES} SELECT message_id, row_number() OVER (PARTITION BY capture_id ORDER BY turn, message_id) - 1 AS at FROM msg",
}

# The SQL functions give what the expressions give.
ORACLE |= {sql: ORACLE[name] for sql, name in (("sql_detect_platform", "detect_platform"), ("sql_cosine_distance", "knn_within_distance"), ("sql_chunk_messages", "chunk_messages"), ("sql_chunk_code", "chunk_code_files"))}
ORACLE["sql_sanitize_id"] = f"WITH {CAPTURES} SELECT capture_id, regexp_replace(coalesce(topic, '') || '/' || coalesce(source_url, 'null'), '[^a-zA-Z0-9_-]', '_', 'g') AS id FROM cap"
ORACLE["sql_extract_messages"] = f"WITH {MESSAGES}, t AS (SELECT message_id, {trim('text')} AS body FROM msg WHERE text IS NOT NULL) SELECT message_id, 'user' AS role, regexp_replace(body, {q(BLANK + '+')}, '', 'g') AS letters FROM t WHERE length(body) > 2"
