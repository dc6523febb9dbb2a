from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.functions.vectors import cosine_distance, hashed_embedding


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x")).alias("y")).first().y


def test_ids_meet(spark):
    make = lambda c: X.code_chunk_id(F.lit("t"), c, F.lit(0))
    assert one(spark, "a/b.js", make) == one(spark, "a_b.js", make) == "codebase_t_a_b_js_0"
    assert one(spark, None, lambda c: X.record_chunk_id(c, F.lit(3))) == "null_3"


def test_names(spark):
    assert one(spark, "a  b\u00a0c", X.file_name) == "a_b_c"
    assert one(spark, 'a  b/c:"d', X.wiki_name) == "a__b_c__d"
    assert one(spark, "<a href=\"x\">'&'", X.html_escape) == "&lt;a href=&quot;x&quot;&gt;&#39;&amp;&#39;"


def test_dates(spark):
    assert one(spark, 1735689601000, X.render_ms, "bigint") == "1/1/2025, 00:00:01"
    assert one(spark, 0, X.render_ms, "bigint") == one(spark, None, X.render_ms, "bigint") == "?"


def test_platforms(spark):
    for url, name in (("https://chatgpt.com/c/1", "ChatGPT"), ("https://x.claude.ai:443/c", "Claude"), ("https://evil.example/claude.ai", None), (None, None), ("https://claude.ai.evil.example/", "Claude"), ("https://u@gemini.google.com/", "Gemini")):
        assert one(spark, url, X.detect_platform) == name


def test_host_paths(spark):
    make = lambda prefix: lambda c: X.translate_host_path(c, prefix)
    assert one(spark, r"c:\WORK\a\b.py", make(r"C:\work")) == "/workspace/a/b.py"
    assert one(spark, r"C:\work\\", make(r"C:\work")) == "/workspace"
    assert one(spark, r"C:\works\a", make(r"C:\work")) == r"C:\works\a"
    assert one(spark, r"C:\work\a", make("C:/work/")) == "/workspacea"
    assert one(spark, "/x", make("")) == "/x"


def test_small_ones(spark):
    assert one(spark, " .PY ,, js", X.parse_extensions) == ["py", "js"]
    assert [one(spark, v, X.page_limit) for v in ("0", "x", None, "7", "900", "12abc", " 9", "-3", "99999999999")] == [50, 50, 50, 7, 500, 12, 9, 50, 500]
    assert [one(spark, v, X.page_offset) for v in ("0", "x", None, "70", "12abc", "-3")] == [0, 0, 0, 70, 12, 0]
    assert [one(spark, v, X.decoded_topic) for v in ("a%20b", "a+b", "%C3%A8", "100%", None)] == ["a b", "a+b", "è", "100%", None]
    assert [one(spark, v, X.platform_label) for v in ("https://claude.ai/x", "https://Some.example:80/x", None)] == ["Claude", "Manual:some.example", None]
    assert [one(spark, v, X.resolve_topic) for v in (None, " ", " a ")] == ["Generale", "Generale", "a"]
    assert one(spark, 1, lambda c: X.percent(c, F.lit(3)), "int") == 33
    assert one(spark, 1, lambda c: X.percent(c, F.lit(0)), "int") == 0
    assert one(spark, "Manual:x", X.badge) == "manual"


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(cosine_distance(F.col("a"), F.col("b"))).collect()] == [1.0, None, None]
    v = one(spark, "the cat, the dog", hashed_embedding)
    assert len(v) == 64 and abs(sum(x * x for x in v) - 1) < 1e-12
    assert sum(one(spark, "--", hashed_embedding)) == 0
