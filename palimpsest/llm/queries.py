"""Queries and SQL of the operators for training data, over the tables of TESTDATA.md."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm import leaks, neardups, neighbours, packing, personal, pieces, provenance, scans, secrets, subjects
from palimpsest.operators.ranking import position_by_range
from palimpsest.session import cut, spread, table


def _texts(spark: SparkSession, sf_dir: str, conversations: bool = False) -> DataFrame:
    """src, item_key, text of messages and stored chunks; of conversations only, if so asked."""
    messages = table(spark, sf_dir, "messages").select(F.lit("messages").alias("src"), F.col("message_id").alias("item_key"), "text")
    chunks = table(spark, sf_dir, "chunks")
    chunks = chunks.where("file_path is null") if conversations else chunks
    chunks = chunks.select(F.lit("chunks").alias("src"), F.col("seq").alias("item_key"), F.col("document").alias("text"))
    return spread(messages).unionByName(spread(chunks))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scans.defects(table(spark, sf_dir, "messages"))
    return found.where("kind <> 'compound'").select("message_id", F.col("kind").alias("defect")).distinct()


def p1_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.defects(table(spark, sf_dir, "messages"))


def p1_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.repaired(table(spark, sf_dir, "messages"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _texts(spark, sf_dir, conversations=True)
    return personal.kinds_found(texts, ["src", "item_key"])


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.personal(_texts(spark, sf_dir, conversations=True).dropDuplicates(["src", "item_key"]), ["src", "item_key"])


def _code(spark: SparkSession, sf_dir: str) -> list[tuple[DataFrame, bool]]:
    """src, item_key, text of files and of all chunks; whether a text may be the middle of a key block."""
    files = table(spark, sf_dir, "source_files").select(F.lit("source_files").alias("src"), F.col("file_id").alias("item_key"), F.col("content").alias("text"))
    chunks = table(spark, sf_dir, "chunks").select(F.lit("chunks").alias("src"), F.col("seq").alias("item_key"), F.col("document").alias("text"))
    return [(spread(files), False), (spread(chunks), True)]


def p2_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in which an e-mail address, a number, a street or a titled name is found after redaction: none."""
    texts = personal.personal(_texts(spark, sf_dir, conversations=True).dropDuplicates(["src", "item_key"]), ["src", "item_key"])
    seen, _ = personal.scanned(texts.select("src", "item_key", "text"), ["src", "item_key"], "text", with_text=False)
    return seen.where(F.size("__spans") > 0).agg(F.count("*").alias("residue"))


def p3_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a credential after redaction, and texts whose number of lines redaction changed: none."""
    out, changed = [], []
    for df, bare in _code(spark, sf_dir):
        before = df.dropDuplicates(["src", "item_key"])
        after = cut(secrets.redacted(before, ["src", "item_key"], "text", bare))
        out.append(secrets.secrets(after, ["src", "item_key"], "text", bare).select("line_no"))
        lines = lambda x: F.regexp_count("text", F.lit("\n")).alias(x)
        both = before.select("src", "item_key", lines("a")).join(after.select("src", "item_key", lines("b")), ["src", "item_key"])
        changed.append(both.where("a <> b").select(F.lit(0).cast("bigint").alias("line_no")))
    return reduce(DataFrame.unionByName, out + changed).agg(F.count("*").alias("residue"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, chunks = (secrets.secrets(df, ["src", "item_key"], "text", bare) for df, bare in _code(spark, sf_dir))
    return files.unionByName(chunks).select("src", "item_key", "line_no").distinct()


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, chunks = (secrets.redacted(df.dropDuplicates(["src", "item_key"]), ["src", "item_key"], "text", bare) for df, bare in _code(spark, sf_dir))
    return files.unionByName(chunks)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neighbours.neighbours(table(spark, sf_dir, "chunk_vectors"))
    return found.select(F.least("key", "neighbour").alias("seq_a"), F.greatest("key", "neighbour").alias("seq_b")).distinct()


def p4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form for searches: every row whose id is divisible by 50 is a query, against all rows."""
    vectors = table(spark, sf_dir, "chunk_vectors")
    found = neighbours.neighbours(vectors, queries=vectors.where("seq % 50 = 0"))
    return found.select(F.col("key").alias("seq"), "neighbour", "rank", F.round("similarity", 6).alias("similarity"))


def _conversation_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").where("file_path is null").select("seq", "document")


#: Rows of classes of copies are paired where their ranks in their classes differ by at most this.
RANKS = 2


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of rows, copies of one text too.

    At every size a copy is paired with its class's first row, and rows of one class or of two linked ones where their
    ranks (by seq) differ by at most RANKS. So up to three copies of a text come out with all their pairs, of many copies no
    row comes out with more than a few, and every link between different texts comes out.
    """
    members, links = neardups.near_pairs(_conversation_chunks(spark, sf_dir), "seq", "document")
    ranked = cut(position_by_range(members, ["rep"], ["key"], "rank"))  # one class may hold any share of the rows
    near = ranked.withColumn("other", F.explode(F.sequence(F.greatest(F.col("rank") - RANKS, F.lit(0)), F.col("rank") + RANKS)))
    right = ranked.select(F.col("rep").alias("rep_b"), F.col("rank").alias("other"), F.col("key").alias("key_b"))
    between = near.withColumnsRenamed({"rep": "rep_a", "key": "key_a"}).join(links.select("rep_a", "rep_b"), "rep_a").join(right, ["rep_b", "other"]).select("key_a", "key_b")
    within = near.where("other > rank").select(F.col("rep").alias("rep_b"), "other", F.col("key").alias("key_a")).join(right, ["rep_b", "other"]).select("key_a", "key_b")
    first = members.where("rep <> key").select(F.col("rep").alias("key_a"), F.col("key").alias("key_b"))
    pairs = between.unionByName(within).unionByName(first)
    return pairs.select(F.least("key_a", "key_b").alias("seq_a"), F.greatest("key_a", "key_b").alias("seq_b")).distinct()


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, its class, and the number of other classes linked to it."""
    members, links = neardups.near_pairs(_conversation_chunks(spark, sf_dir), "seq", "document")
    ends = links.select(F.col("rep_a").alias("rep")).unionByName(links.select(F.col("rep_b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("n_links"))
    return members.join(ends, "rep", "left").select(F.col("key").alias("seq"), F.col("rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = _texts(spark, sf_dir).where(F.length("text") > pieces.LIMIT)
    cut = pieces.pieces(long, ["src", "item_key"], with_text=False)
    return cut.groupBy("src", "item_key").agg(F.when(F.bool_or("forced"), "forced").otherwise("natural").alias("cut_kind"))


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.pieces(_texts(spark, sf_dir).dropDuplicates(["src", "item_key"]), ["src", "item_key"])


def p6_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each text the characters that its pieces cover, each counted once; are all within the limit and equal to the text there?"""
    texts = _texts(spark, sf_dir).where("text is not null").dropDuplicates(["src", "item_key"])
    cut_up = pieces.pieces(texts, ["src", "item_key"]).join(texts, ["src", "item_key"])
    before = F.lag("end_pos", 1, 0).over(Window.partitionBy("src", "item_key").orderBy("piece_no"))
    same = (F.length("piece") <= pieces.LIMIT) & (F.col("piece") == F.substring(F.col("text"), F.col("start_pos") + 1, F.col("end_pos") - F.col("start_pos"))) & (F.col("start_pos") <= before)
    rows = cut_up.select("src", "item_key", (F.col("end_pos") - before).alias("new"), same.alias("same"))
    return rows.groupBy("src", "item_key").agg(F.sum("new").alias("n_chars"), F.bool_and("same").alias("same"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.provenance(table(spark, sf_dir, "source_files"), every=False).select("file_id").distinct()


def p7_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.provenance(table(spark, sf_dir, "source_files"))


def p7_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored chunks made from files, each with the kinds of its file; kinds is empty for hand-written ones."""
    files = table(spark, sf_dir, "source_files")
    kinds = provenance.provenance(files).groupBy("file_id").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    paths = files.select("file_id", F.concat(F.lit("file://"), "path").alias("source_url")).distinct().join(kinds, "file_id")
    chunks = table(spark, sf_dir, "chunks").where("file_path is not null").select("seq", "source_url").distinct()
    return chunks.join(paths, "source_url", "left").select("seq", F.array_join(F.coalesce("kinds", F.array()), ", ").alias("kinds"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.assign(spread(table(spark, sf_dir, "documents")))
    return placed.groupBy("doc_id").agg(F.min("container_id").alias("first"), F.max("container_id").alias("last")).where("first < last").select("doc_id")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.assign(spread(table(spark, sf_dir, "documents")))
    return placed.where("container_id is not null").groupBy("container_id").agg(F.count("*").alias("n_items"), F.sum("length").alias("tokens"))


def p8_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tokens placed; is no container over its capacity, no item of the texts missing, and are there at most 2 % (and 2) more containers than the tokens fill?"""
    placed = packing.assign(spread(table(spark, sf_dir, "documents"))).where("container_id is not null")
    fill = placed.groupBy("container_id").agg(F.sum("length").alias("tokens"))
    enough = F.count("*") <= F.ceil(F.sum("tokens") / packing.CAPACITY) * 1.02 + 2
    return fill.agg(F.sum("tokens").alias("tokens"), (F.max("tokens") <= packing.CAPACITY).alias("within"), enough.alias("enough"))


def p8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", packing.n_tokens(F.col("text")).alias("n_tokens"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks.leaks(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "eval_items"))
    return found.select("doc_id", "item_id").distinct()


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks.leaks(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "eval_items"))
    return found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("shared_words").alias("most_shared_words"), F.count_if("answer_found").alias("n_with_answer"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [r.subject for r in table(spark, sf_dir, "subjects").select("subject").orderBy("subject").collect()]
    found = subjects.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_labels"), names, quoted=table(spark, sf_dir, "eval_items").select("passage"))
    return found.select("doc_id", "subject").distinct()


def queries():
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit()}


_BLANK = r"\s\x{000b}\x{001c}-\x{001f}\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_TOKENS = rf"len(regexp_extract_all(coalesce(text, ''), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{_BLANK}]+'))"
_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
_USABLE = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"


def oracle_sql() -> dict[str, str]:
    """The queries that SQL can express on whole tables."""
    tokens = f"SELECT doc_id, {_TOKENS} AS n_tokens FROM documents"
    windows = "list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))"
    return {
        "p4_found": f"""WITH v AS (SELECT seq, embedding::DOUBLE[] AS e FROM chunk_vectors WHERE embedding IS NOT NULL AND {_USABLE}),
near AS (SELECT a.seq AS x, b.seq AS y FROM v a, v b WHERE a.seq <> b.seq QUALIFY row_number() OVER (PARTITION BY a.seq ORDER BY list_cosine_similarity(a.e, b.e) DESC, b.seq) <= 5)
SELECT DISTINCT least(x, y) AS seq_a, greatest(x, y) AS seq_b FROM near""",
        "p5_found": f"""WITH c AS (SELECT DISTINCT seq, {_WORDS.format('document')} AS w FROM chunks WHERE file_path IS NULL AND document IS NOT NULL),
s AS (SELECT DISTINCT seq, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS g FROM c WHERE len(w) >= 40),
n AS (SELECT seq, count(*) AS n FROM s GROUP BY 1), common AS (SELECT a.seq AS seq_a, b.seq AS seq_b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.seq < b.seq GROUP BY 1, 2)
SELECT seq_a, seq_b FROM common JOIN n a ON a.seq = seq_a JOIN n b ON b.seq = seq_b WHERE k >= 0.6 * (a.n + b.n - k)""",
        "p4_neighbours": f"""WITH v AS (SELECT seq, embedding::DOUBLE[] AS e FROM chunk_vectors WHERE embedding IS NOT NULL AND {_USABLE})
SELECT a.seq AS seq, b.seq AS neighbour, CAST(row_number() OVER (PARTITION BY a.seq ORDER BY list_cosine_similarity(a.e, b.e) DESC, b.seq) AS INTEGER) AS rank, round(list_cosine_similarity(a.e, b.e), 6) AS similarity
FROM v a, v b WHERE a.seq % 50 = 0 AND a.seq <> b.seq QUALIFY rank <= 5""",
        "p5_classes": f"""WITH t AS (SELECT DISTINCT seq, document FROM chunks WHERE file_path IS NULL AND document IS NOT NULL AND len({_WORDS.format('document')}) >= 40),
m AS (SELECT seq, min(seq) OVER (PARTITION BY document) AS class_id FROM t),
s AS (SELECT DISTINCT seq, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS g FROM (SELECT t.seq, {_WORDS.format('document')} AS w FROM t JOIN m ON t.seq = m.seq AND t.seq = m.class_id)),
n AS (SELECT seq, count(*) AS n FROM s GROUP BY 1), common AS (SELECT a.seq AS x, b.seq AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.seq < b.seq GROUP BY 1, 2),
link AS (SELECT x, y FROM common JOIN n a ON a.seq = x JOIN n b ON b.seq = y WHERE k >= 0.6 * (a.n + b.n - k)),
ends AS (SELECT rep, count(*) AS n_links FROM (SELECT x AS rep FROM link UNION ALL SELECT y FROM link) GROUP BY 1)
SELECT seq, class_id, coalesce(n_links, 0) AS n_links FROM m LEFT JOIN ends ON rep = class_id""",
        "p6_found": f"""WITH t AS (SELECT DISTINCT 'messages' AS src, message_id AS item_key, text FROM messages UNION SELECT DISTINCT 'chunks', seq, document FROM chunks)
SELECT src, item_key, CASE WHEN list_max(list_transform(string_split_regex(text, '[{_BLANK}]+'), lambda x: length(x))) > 800 THEN 'forced' ELSE 'natural' END AS cut_kind FROM t WHERE length(text) > 800""",
        "p2_residue": "SELECT 0 AS residue",
        "p3_residue": "SELECT 0 AS residue",
        "p6_covered": "WITH t AS (SELECT DISTINCT 'messages' AS src, message_id AS item_key, text FROM messages UNION SELECT DISTINCT 'chunks', seq, document FROM chunks) SELECT src, item_key, length(text) AS n_chars, TRUE AS same FROM t WHERE text IS NOT NULL",
        "p8_space": f"SELECT CAST(sum(n_tokens) AS BIGINT) AS tokens, TRUE AS within, TRUE AS enough FROM ({tokens})",
        "p9_report": f"""WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents), i AS (SELECT item_id, answer, {_WORDS.format('passage')} AS w FROM eval_items),
dw AS (SELECT doc_id, unnest(range(0, len(w) - 11)) AS p, unnest({windows}) AS g FROM d WHERE len(w) >= 12), iw AS (SELECT DISTINCT item_id, unnest({windows}) AS g FROM i WHERE len(w) >= 12),
hit AS (SELECT DISTINCT doc_id, item_id, p FROM dw JOIN iw USING (g)), run AS (SELECT doc_id, item_id, p - row_number() OVER (PARTITION BY doc_id, item_id ORDER BY p) AS island FROM hit),
best AS (SELECT doc_id, item_id, max(n) + 11 AS words FROM (SELECT doc_id, item_id, count(*) AS n FROM run GROUP BY doc_id, item_id, island) GROUP BY 1, 2),
place AS (SELECT doc_id, item_id, greatest(0, min(p) - 50) AS a, max(p) + 62 AS b FROM hit GROUP BY 1, 2),
near AS (SELECT doc_id, item_id, len(i.answer_words) > 0 AND contains(' ' || array_to_string(d.w[a + 1:b], ' ') || ' ', ' ' || array_to_string(i.answer_words, ' ') || ' ') AS found
FROM place JOIN d USING (doc_id) JOIN (SELECT item_id, coalesce({_WORDS.format('answer')}, []) AS answer_words FROM eval_items) i USING (item_id))
SELECT item_id, count(*) AS n_docs, CAST(max(words) AS INTEGER) AS most_shared_words, count(*) FILTER (found) AS n_with_answer FROM best JOIN near USING (doc_id, item_id) GROUP BY 1""",
        "p8_found": f"SELECT doc_id FROM ({tokens}) WHERE n_tokens > 1024",
        "p8_tokens": tokens,
        "p9_found": f"""WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents), i AS (SELECT item_id, {_WORDS.format('passage')} AS w FROM eval_items),
dw AS (SELECT DISTINCT doc_id, unnest({windows}) AS g FROM d WHERE len(w) >= 12), iw AS (SELECT DISTINCT item_id, unnest({windows}) AS g FROM i WHERE len(w) >= 12)
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (g)""",
    }
