"""The folds against plain Python models, on made-up edge cases."""

import random
import re

from pyspark.sql import functions as F

from palimpsest.functions.text import with_role
from palimpsest.operators.chunking import chunk_code, chunk_message

BLANKS = " \t\n\r\f\v\u00a0\ufeff"


def model_message(full: str) -> list[str]:
    if len(full) <= 800:
        out = [full]
    else:
        out, cur = [], ""
        for para in re.split("\n{2,}", full):
            if len(cur) + 2 + len(para) <= 800:
                cur = f"{cur}\n\n{para}" if cur else para
                continue
            if cur:
                out.append(cur)
            cur = para
            if len(para) > 800:
                out += [para[i : i + 800] for i in range(0, len(para), 720)]
                cur = ""
        if cur:
            out.append(cur)
    return [c for c in out if c.strip(BLANKS)]


def model_code(path: str, content: str) -> list[str]:
    head = f"[FILE: {path}]"
    cur, out = head + "\n", []
    for line in content.split("\n"):
        if len(cur) + len(line) + 1 > 800 and cur.strip(BLANKS) != head:
            out.append(cur.strip(BLANKS))
            cur = "\n".join([head, *cur.split("\n")[-6:], line, ""])
        else:
            cur += line + "\n"
    rest = cur.strip(BLANKS)
    return out + ([rest] if rest and rest != head else [])


def texts() -> list[str]:
    rng = random.Random(1)
    out = ["", "  ", "\n\n", "a\n\n\n\nb", "x" * 792, "x" * 793, "x" * 794, "x" * 1432, "x" * 1512, "x" * 1513, "a😀b" * 400, "y" * 900 + "\n\n" + "z" * 10, "\u00a0" * 900, "end\n\n", "w" * 850 + "\n\n"]
    for _ in range(60):
        out.append(rng.choice(["\n\n", "\n\n\n", "\n"]).join("word " * rng.randint(0, 220) for _ in range(rng.randint(1, 9))))
    return out


def test_message_chunks(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "i int, text string").select("i", chunk_message(with_role(F.lit("user"), F.col("text"))).alias("c"))
    for r in df.collect():
        assert r.c == model_message("[USER] " + rows[r.i][1])


def test_overlap_only_inside_long_paragraphs(spark):
    rng = random.Random(2)
    text = "".join(rng.choice("abcdef ") for _ in range(3000))
    got = spark.createDataFrame([(text,)], "t string").select(chunk_message(F.col("t")).alias("c")).first().c
    assert text == got[0] + "".join(c[80:] for c in got[1:])


def test_role_header(spark):
    df = spark.createDataFrame([("user", "a"), (None, "b"), ("", "c")], "role string, text string")
    assert [r[0] for r in df.select(with_role(F.col("role"), F.col("text"))).collect()] == ["[USER] a", "[UNKNOWN] b", "[] c"]


def test_code_chunks(spark):
    rng = random.Random(3)
    files = ["", "\n\n", "x" * 3000, "\n".join("y" * 300 for _ in range(10)), "a\r\nb\r\n" * 200, "\n".join("l" * rng.randint(0, 120) for _ in range(300)), "one\n" * 3, "\u00a0" * 1000, *("\n".join("t" * rng.randint(0, 400) for _ in range(rng.randint(1, 40))) for _ in range(40))]
    rows = [(i, "dir/é.py", c) for i, c in enumerate(files)]
    for r in spark.createDataFrame(rows, "i int, p string, c string").select("i", chunk_code(F.col("p"), F.col("c")).alias("out")).collect():
        assert r.out == model_code("dir/é.py", files[r.i])


def test_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(None,)], "t string")
    assert df.select(chunk_message(F.col("t")).alias("c")).first().c is None
    assert df.where("false").select(chunk_message(F.col("t")).alias("c")).count() == 0
