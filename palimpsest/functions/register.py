"""SQL functions."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from palimpsest.functions.text import BLANK
from palimpsest.schema import CHUNK_OVERLAP, CHUNK_SIZE, DEFAULT_TOPIC, MAX_DISTANCE, OVERLAP_LINES, PLATFORMS
from palimpsest.sources import html



def _trim(x: str) -> str:
    return f"regexp_replace({x}, r'^{BLANK}+|{BLANK}+$', '')"


_STEP = CHUNK_SIZE - CHUNK_OVERLAP
_EMPTY = "cast(array() AS ARRAY<STRING>)"
_FITS = f"length(s.cur) + 2 + length(p) <= {CHUNK_SIZE}"
_FLUSHED = "if(s.cur <> '', concat(s.out, array(s.cur)), s.out)"
_FLUSH = f"length(s.cur) + length(p) + 1 > {CHUNK_SIZE} AND {_trim('s.cur')} <> concat('[FILE: ', path, ']')"
_HEAD = "concat('[FILE: ', path, ']\\n')"
_TAIL = f"array_join(slice(split(s.cur, '\\n', -1), greatest(size(split(s.cur, '\\n', -1)) - {OVERLAP_LINES}, 1), {OVERLAP_LINES + 1}), '\\n')"

#: name -> parameters, result, body
FUNCTIONS = {
    "sanitize_id": ("s STRING", "STRING", "regexp_replace(s, '[^a-zA-Z0-9_-]', '_')"),
    "cosine_distance": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "1 - try_divide(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x), sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)))"),
    "hashed_bucket": ("w STRING", "INT", "CAST(pmod(CAST(conv(substring(md5(w), 1, 8), 16, 10) AS BIGINT), 64) AS INT)"),
    "hashed_embedding": (
        "t STRING",
        "ARRAY<DOUBLE>",
        "element_at(transform(array(transform(sequence(0, 63), b -> CAST(size(filter(transform(filter(split(lower(t), '[^a-z0-9]+'), w -> w <> ''), w -> pmod(CAST(conv(substring(md5(w), 1, 8), 16, 10) AS BIGINT), 64)), p -> p = b)) AS DOUBLE))), "
        "c -> transform(c, x -> coalesce(try_divide(x, sqrt(aggregate(c, 0D, (s, y) -> s + y * y))), 0D))), 1)",
    ),
    "detect_platform": (
        "url STRING",
        "STRING",
        "CASE " + " ".join(f"WHEN contains(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1)), '{h}') THEN '{n}'" for h, n in PLATFORMS) + " END",
    ),
    "chunk_message": (
        "full_text STRING",
        "ARRAY<STRING>",
        f"filter(if(length(full_text) <= {CHUNK_SIZE}, array(full_text), aggregate(split(full_text, '\\\\n{{2,}}', -1), named_struct('cur', '', 'out', {_EMPTY}), (s, p) -> named_struct("
        f"'cur', CASE WHEN {_FITS} THEN if(s.cur = '', p, concat(s.cur, '\\n\\n', p)) WHEN length(p) > {CHUNK_SIZE} THEN '' ELSE p END, "
        f"'out', CASE WHEN {_FITS} THEN s.out WHEN length(p) > {CHUNK_SIZE} THEN concat({_FLUSHED}, transform(sequence(0, cast(ceil(length(p) / {_STEP}) AS INT) - 1), k -> substr(p, k * {_STEP} + 1, {CHUNK_SIZE}))) ELSE {_FLUSHED} END), "
        f"s -> {_FLUSHED})), c -> {_trim('c')} <> '')",
    ),
    "chunk_code": (
        "path STRING, content STRING",
        "ARRAY<STRING>",
        f"aggregate(split(content, '\\n', -1), named_struct('cur', {_HEAD}, 'out', {_EMPTY}), (s, p) -> named_struct('cur', if({_FLUSH}, concat({_HEAD}, {_TAIL}, '\\n', p, '\\n'), concat(s.cur, p, '\\n')), "
        f"'out', if({_FLUSH}, concat(s.out, array({_trim('s.cur')})), s.out)), s -> if({_trim('s.cur')} IN ('', concat('[FILE: ', path, ']')), s.out, concat(s.out, array({_trim('s.cur')}))))",
    ),
}


def register_search(spark: SparkSession, view: str, name: str = "search") -> None:
    """The table function name(query, topic, k) over a view of chunks (id, document, platform, topic, embedding): rank, id, distance, label.

    The view's embeddings are those of hashed_embedding(), or of any model if a function hashed_embedding of its own is there.
    Empty and default topics mean all topics. Ranks above k are dropped before the rows of all tasks meet.
    """
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(query STRING, wanted STRING, k INT) RETURNS TABLE (rank INT, id STRING, distance DOUBLE, label STRING)
RETURN SELECT rank, id, distance, label FROM (SELECT row_number() OVER (ORDER BY distance, id) AS rank, id, distance, label FROM (
SELECT id, cosine_distance(embedding, q) AS distance, concat('[', coalesce(platform, '?'), ' — ', coalesce(topic, '?'), ']\\n', document) AS label
FROM {view} CROSS JOIN (SELECT hashed_embedding(query) AS q) WHERE coalesce(wanted, '') IN ('', '{DEFAULT_TOPIC}') OR topic = wanted) WHERE distance <= {MAX_DISTANCE}) WHERE rank <= k""")


def register(spark: SparkSession) -> None:
    """The functions above as temporary SQL functions, and the table function extract_messages(html, platform)."""
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")

    @udtf(returnType="turn int, role string, text string")
    class ExtractMessages:
        def eval(self, page: str, platform: str):
            for i, (role, text) in enumerate(html.read_page(page, platform)):
                yield i, role, text

    spark.udtf.register("extract_messages", ExtractMessages)
