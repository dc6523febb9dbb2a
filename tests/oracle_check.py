"""python tests/oracle_check.py [SF_DIR] [NAME...]: run queries and their SQL side by side and compare the rows."""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def plain(v):
    if v is None or isinstance(v, bool | str):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return str(v) if not isinstance(v, int) else v


def rows(columns: list[str], data) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(hashlib.md5(repr([plain(r[i]) for i in order]).encode()).hexdigest() for r in data)


def compare(spark, sf_dir: str, name: str, query, sql: str) -> str:
    """Empty if equal, else what differs."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}{'/*.parquet' if f.is_dir() else ''}')")
    df = query(spark, sf_dir)
    ours = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    columns, theirs = [d[0] for d in cur.description], cur.fetchall()
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} {sorted(columns)}"
    a, b = rows(df.columns, ours), rows(columns, theirs)
    if a != b:
        extra = [r for r in ours if rows(df.columns, [r]).keys() - b.keys()][:2]
        missing = [r for r in theirs if rows(columns, [r]).keys() - a.keys()][:2]
        return f"{sum((a - b).values())} extra, {sum((b - a).values())} missing of {len(theirs)}: {str(extra)[:500]} {str(missing)[:500]}"
    return ""


if __name__ == "__main__":
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    os.chdir(Path(__file__).resolve().parent.parent)
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir, names = (sys.argv[1:2] or ["/root/testdata/sf0.01"])[0], sys.argv[2:]
    made, sql = entry.queries(), entry.oracle_sql()
    for n in names or made:
        t = time.time()
        try:
            said = compare(spark, sf_dir, n, made[n], sql[n]) if n in sql else f"no SQL, {made[n](spark, sf_dir).count()} rows"
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{'ok' if not said else 'no SQL' if said.startswith('no SQL') else 'DIFFERS':8}{n:30}{time.time() - t:6.1f} s  {said}", flush=True)
