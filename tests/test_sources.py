import random
import time

from pyspark.sql import functions as F

from palimpsest.functions.register import register, register_search
from palimpsest.operators.chunking import chunk_code, chunk_message
from palimpsest.sources import files, html, records
from palimpsest.streaming import ingest


def test_file_rules(spark):
    paths = ["a.py", "node_modules/a.py", "src/build/x.js", "build", "x/.hidden/a.py", "x/yarn.lock", "my-package-lock.json", "x.min.js", "x.MIN.js", "a.PY", "noext", ".env", "dir/a.b.sql", "out.js", "a.chunk.js"]
    df = spark.createDataFrame([(p, "x") for p in paths] + [("long.py", "x" * 200_001), ("full.py", "x" * 200_000), ("none.py", None), (None, "x")], "rel_path string, content string")
    assert {r.rel_path for r in files.code_files(df).collect()} == {"a.py", "x.MIN.js", "a.PY", "dir/a.b.sql", "out.js", "full.py"}
    assert {r.rel_path for r in files.code_files(df, [".SQL"]).collect()} == {"dir/a.b.sql"}
    assert files.code_files(df, []).count() == 6


def test_tree(spark, tmp_path):
    (tmp_path / "src" / "dist").mkdir(parents=True)
    (tmp_path / "src" / "a.py").write_text("print('é')\n")
    (tmp_path / "src" / "dist" / "b.js").write_text("x")
    tree = files.read_tree(spark, str(tmp_path))
    assert {r.rel_path: r.content for r in tree.collect()} == {"src/a.py": "print('é')\n"}
    got = files.code_chunks(files.code_files(tree).withColumn("topic", F.lit(None).cast("string")), 5).collect()
    assert [(r.id, r.platform, r.topic, r.file_path) for r in got] == [("codebase_Generale_src_a_py_0", "codebase", "Generale", "src/a.py")]
    assert files.chunk_counts(files.code_files(tree)).first().total == 1
    assert files.chunk_counts(tree.where("false")).first().total == 1


def test_tree_of_odd_files(spark, tmp_path):
    """Other encodings don't abort the job; what can't count isn't opened; names may hold pattern signs."""
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "x.js").write_text("x")
    (tmp_path / "latin.py").write_bytes("caf\xe9 = 1\n".encode("latin-1"))
    (tmp_path / "a [1]{2}.py").write_text("y")
    (tmp_path / "empty.sql").write_text("")
    (tmp_path / "big.py").write_bytes(b"x" * 900_000)
    (tmp_path / "picture.png").write_bytes(bytes(range(256)))
    got = {r.rel_path: r.content for r in files.read_tree(spark, str(tmp_path)).collect()}
    assert got == {"latin.py": "caf\ufffd = 1\n", "a [1]{2}.py": "y"}  # empty files are no rows
    assert {r.rel_path for r in files.read_tree(spark, str(tmp_path), ["png"]).collect()} == {"picture.png"}
    assert files.read_tree(spark, str(tmp_path), ["none"]).count() == 0


def test_one_capture_with_most_messages(spark):
    """Numbers go on over all parts of a capture."""
    captures = spark.createDataFrame([(1, "u", "T", "P", 7), (2, "v", "T", "P", 8)], "capture_id bigint, source_url string, topic string, platform string, timestamp_ms bigint")
    messages = spark.range(3000).select(F.col("id").alias("message_id"), F.when(F.col("id") < 2600, 1).otherwise(2).cast("bigint").alias("capture_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.when(F.col("id") % 9 == 0, F.repeat(F.lit("word "), 400)).otherwise("short").alias("text"))
    got = [r.id for r in records.record_chunks(captures, messages, 99).collect()]
    pieces = len(chunks_of(spark, "[USER] " + "word " * 400))
    for url, low, high in (("u", 0, 2600), ("v", 2600, 3000)):
        n = sum(pieces if i % 9 == 0 else 1 for i in range(low, high))
        assert sorted(int(x.split("_")[1]) for x in got if x.startswith(url)) == list(range(n))
    assert sorted(got) == sorted(r.id for r in records.record_chunks(captures, messages, 99, with_document=False).collect())


def chunks_of(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(chunk_message(F.col("t")).alias("c")).first().c


def test_records(spark):
    captures = spark.createDataFrame([(1, None, None, None, None), (2, "u", "", "P", 7), (3, "v", "T", "P", 8)], "capture_id bigint, source_url string, topic string, platform string, timestamp_ms bigint")
    messages = spark.createDataFrame([(1, 1, 0, "user", "hello"), (2, 1, 1, None, "x" * 900), (3, 2, 0, "ocr", "t"), (4, 2, 1, "user", None)], "message_id bigint, capture_id bigint, turn bigint, role string, text string")
    assert {r.capture_id: r.status for r in records.accepted(captures, messages).collect()} == {1: 202, 2: 202, 3: 400}
    got = {r.id: r for r in records.record_chunks(captures, messages, 99).collect()}
    assert set(got) == {"null_0", "null_1", "null_2", "u_0"}
    assert (got["null_0"].topic, got["null_0"].platform, got["null_0"].source_url, got["null_0"].timestamp_ms) == ("Generale", "unknown", "", 99)
    assert got["u_0"].topic == "" and got["u_0"].document == "[OCR] t"


def test_records_from_json_and_images(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"messages":[{"role":"user","text":"hi"}],"topic":"T","metadata":{"source_url":"u","platform":"P","timestamp":5},"imageBase64":"IGFiYyA="}\n{"messages":[],"imageBase64":null}')
    df = records.read_records(spark, str(tmp_path))
    assert {len(r.messages) for r in records.with_ocr(df).collect()} == {0, 1}
    read = records.with_ocr(df, lambda image: image.cast("string")).collect()
    assert sorted([m.role for m in r.messages] for r in read) == [[], ["user", "ocr"]]
    assert {m.text for r in read for m in r.messages} == {"hi", "abc"}


PAGE = """<body><nav>menu</nav><p>one<p>two
<div data-message-author-role="user"><div class="whitespace-pre-wrap">hello &amp; bye</div></div>
<div data-message-author-role="assistant"><div><div class="markdown"><p>first</p><p>second</p><script>x = '</div>'</script></div></div></div>
<div data-message-author-role="user">ok</div></body>"""


def test_platform_pages():
    assert html.messages(PAGE, "ChatGPT") == [("user", "hello & bye"), ("assistant", "first\nsecond")]
    assert html.messages("<message-content>answer</message-content><div class='user-request-interior-slot'>asked</div>", "Gemini") == [("assistant", "answer"), ("user", "asked")]
    assert html.messages("<div class='human-turn'>asked</div><div data-is-streaming=false>answer</div>", "Claude") == [("user", "asked"), ("assistant", "answer")]
    assert html.messages("<div class='message-item user-message'><b>x</b><div class='message-content'>asked</div></div>", "DeepSeek") == [("user", "asked")]


def test_manual_pages():
    page = "<body><div><ul><li><span>a first message of some length</span></li><li>a second message of some length</li><li>no</li></ul></div></body>"
    assert [t for _, t in html.manual_messages(page)] == ["a first message of some length", "a second message of some length"]
    assert html.manual_messages("") == html.manual_messages("<p>short") == []


def test_deep_and_broken_pages(spark):
    deep = "<div>" * 5000 + "a text of more than twenty letters" + "</div>" * 5000
    items = "<ul>" + "<li>an item of more than twenty letters" * 5000 + "</ul>"
    assert html.Tree(deep).root.text() == "a text of more than twenty letters"
    assert len(html.manual_messages(f"<body><div>{items}</div></body>")) == 5000 and html.manual_messages(deep) == []
    assert html.messages(f"<div class='human-turn'>{deep}</div>", "Claude")[0][0] == "user"
    page = "<body><table><tr><td>one cell of more than twenty letters<td>another cell of more than twenty letters</table><div id='box'><p>first text of the chosen container<p>second text of the chosen container</div></body>"
    assert [t[:6] for _, t in html.manual_messages(page, "box")] == ["first ", "second"] and html.manual_messages(page, "none") == []
    df = spark.createDataFrame([(1, deep, "Claude", None), (2, "<![bad <div class='human-turn'>x", "Claude", None), (3, page, "other", "box")], "k int, html string, platform string, start string")
    assert {(r.k, r.turn) for r in html.extract_messages(df, "k", start="start").collect()} == {(3, 0), (3, 1)}


def test_pages_as_rows(spark):
    df = spark.createDataFrame([(1, PAGE, "ChatGPT", "extra"), (2, None, "Claude", ""), (3, "", None, None)], "page_id bigint, html string, platform string, turn string")
    assert [(r.page_id, r.turn, r.role) for r in html.extract_messages(df, "page_id").orderBy("turn").collect()] == [(1, 0, "user"), (1, 1, "assistant")]
    assert html.extract_messages(df.where("false"), "page_id").count() == 0


def test_sql_functions(spark):
    register(spark)
    assert spark.sql("SELECT sanitize_id('a/b c')").first()[0] == "a_b_c"
    assert spark.sql("SELECT cosine_distance(array(1D, 0D), array(0D, 1D))").first()[0] == 1.0
    assert spark.sql("SELECT cosine_distance(array(0D, 0D), array(0D, 1D))").first()[0] is None
    assert spark.sql("SELECT detect_platform('https://x.claude.ai/c'), detect_platform('https://a.example/claude.ai')").first() == ("Claude", None)
    assert spark.sql("SELECT text FROM extract_messages('<div class=\"human-turn\">asked</div>', 'Claude')").first()[0] == "asked"


def test_jobs(spark):
    df = spark.createDataFrame([(1, 1, 3, None, None), (2, 3, 3, None, 1000), (3, 0, 0, "bad", 1000), (4, 3, 3, None, 1)], "job_id int, done bigint, total bigint, error string, ended_ms bigint")
    assert {r.job_id: (r.status, r.percent) for r in ingest.jobs(df, 600_500).collect()} == {1: ("processing", 33), 2: ("done", 100), 3: ("error", 0)}


def test_feed_of_jobs(spark, tmp_path):
    feed = ingest.JobFeed(lambda: 1000)
    spark.streams.addListener(feed)
    try:
        spark.range(5).write.parquet(f"{tmp_path}/in")
        q = spark.readStream.schema("id bigint").parquet(f"{tmp_path}/in").writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
        ingest.drain(q)
        for _ in range(100):
            if feed.rows and all(r["ended_ms"] for r in feed.rows.values()):
                break
            time.sleep(0.1)
        row = ingest.jobs(feed.frame(spark), 1001).collect()
    finally:
        spark.streams.removeListener(feed)
    assert [(r.status, r.done, r.percent) for r in row] == [("done", 5, 100)] and len(row[0].job_id) == 8


def test_search_function(spark):
    register(spark)
    spark.createDataFrame([("a", "the red cat", "P", "T"), ("b", "a blue dog", None, "U"), ("c", "the red red cat", "P", None)], "id string, document string, platform string, topic string").createOrReplaceTempView("raw_chunks")
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW embedded_chunks AS SELECT *, hashed_embedding(document) AS embedding FROM raw_chunks")
    register_search(spark, "embedded_chunks")
    assert [(r["rank"], r.id, r.label) for r in spark.sql("SELECT * FROM search('the red cat', 'Generale', 2)").collect()] == [(1, "a", "[P — T]\nthe red cat"), (2, "c", "[P — ?]\nthe red red cat")]
    assert [r.id for r in spark.sql("SELECT * FROM search('blue dog', 'U', 5)").collect()] == ["b"]


def test_cursor_stream(spark, tmp_path):
    schema = "user string, ts_ms bigint"
    for i, rows in enumerate([[("a", 5), ("b", 1)], [("a", 5), ("a", 4), ("a", 9)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.01 * i)
    out = ingest.cursor_stream(ingest.file_stream(spark, f"{tmp_path}/in", schema, 1), "user", "ts_ms")
    q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at").outputMode("append").trigger(availableNow=True).start()
    assert ingest.drain(q)
    got = sorted((r.user, r.n, r.cursor_ms) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert sum(n for u, n, _ in got if u == "a") in (2, 3) and max(c for *_, c in got) == 9 and ("b", 1, 1) in got


def test_sql_chunkers_are_those_of_the_expressions(spark):
    register(spark)
    rng = random.Random(4)
    texts = ["", " ", "x" * 801, "a\n\n\nb" * 300, *("\n\n".join("word " * rng.randint(0, 200) for _ in range(5)) for _ in range(20)), *("\n".join("line " * rng.randint(0, 30) for _ in range(40)) for _ in range(20))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select(chunk_message(F.col("t")).alias("a"), F.expr("chunk_message(t)").alias("b"), chunk_code(F.lit("a.py"), F.col("t")).alias("c"), F.expr("chunk_code('a.py', t)").alias("d")).collect():
        assert r.a == r.b and r.c == r.d
