"""Problem 8: fill containers of fixed capacity with whole documents.

Length-histogram planning: best fit (longest first) runs over the counts of the at most `capacity` lengths on the
driver, not over documents. The plan says, for each length, which ranks go to which containers; documents take their
places by their rank within their length. A length has as many salts as it has multiples of RANKED rows; ranks are counted
within (length, salt) and shifted by the sizes of the salts before, so that one length may hold any share of the rows.

Defined results: null texts count no tokens; items of no tokens go to no container (container_id null); documents over
the capacity are cut into full pieces and a rest; repeated ids are separate items.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.session import cut

CAPACITY = 1024
#: Rows of one length that are ranked in one task, about.
RANKED = 100_000
#: White space as in Python's str.isspace for the regular expressions of the JVM (fixed values).
BLANK = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
TOKEN = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{BLANK}]+"


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("bigint")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """(length, first rank, places, first container) runs: of a length, rank r of a run is in container first + r - first rank.

    Containers with the same contents are one group, so the work depends on the number of lengths, not of items.
    """
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)  # space left -> (contents, how many)
    spaces: list[int] = []

    def put(space: int, contents: tuple[int, ...], n: int) -> None:
        if not groups[space]:
            bisect.insort(spaces, space)
        groups[space].append((contents, n))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect.bisect_left(spaces, length)
            if at == len(spaces):
                fit = capacity // length
                if left >= fit:
                    put(capacity - fit * length, (length,) * fit, left // fit)
                if left % fit:
                    put(capacity - left % fit * length, (length,) * (left % fit), 1)
                break
            space = spaces[at]
            contents, n = groups[space].pop()
            if not groups[space]:
                spaces.pop(at)
            fit = min(space // length, left)
            take = min(n, left // fit)
            put(space - fit * length, contents + (length,) * fit, take)
            if n > take:
                put(space, contents, n - take)
            left -= take * fit
    runs, used, container = [], defaultdict(int), 0
    for space in sorted(groups):
        for contents, n in groups[space]:
            for length in contents:
                runs.append((length, used[length], n, container))
                used[length] += n
            container += n
    return runs


def items(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """key, n_tokens of the text, piece_no, first_token and length of each item to be placed."""
    full = F.col("n_tokens") - F.col("first_token")
    counted = df.select(F.col(key), n_tokens(F.col(text)).alias("n_tokens"))
    return (
        counted.select(key, "n_tokens", F.posexplode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("n_tokens") - 1, F.lit(0)), F.lit(capacity).cast("bigint"))).alias("piece_no", "first_token"))
        .withColumn("length", F.least(full, F.lit(capacity)))
    )


def assign(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """items() and container_id."""
    spark = df.sparkSession
    todo = cut(items(df, key, text, capacity))
    many = F.broadcast(todo.where("length > 0").groupBy("length").agg(F.ceil(F.count("*") / RANKED).cast("int").alias("salts")))  # at most capacity rows
    todo = todo.join(many, "length", "left").withColumn("salt", F.pmod(F.xxhash64(key, "piece_no"), F.coalesce("salts", F.lit(64)))).drop("salts")
    sizes = todo.where("length > 0").groupBy("length", "salt").count()  # at most capacity rows, and one for RANKED items
    have = [(r.length, r.salt, r["count"]) for r in sizes.collect()]
    counts: dict[int, int] = defaultdict(int)
    starts = []
    for length, salt, n in sorted(have):
        starts.append((length, salt, counts[length]))
        counts[length] += n
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for length, first, _, container in plan(counts, capacity):
        runs[length].append((first, container))
    offsets = spark.createDataFrame(starts, "length bigint, salt bigint, before bigint")
    places = spark.createDataFrame(sorted(runs.items()), "length bigint, runs array<struct<first: bigint, container: bigint>>")
    within = Window.partitionBy("length", "salt").orderBy(key, "piece_no")
    ranked = (
        todo.withColumn("rank", F.row_number().over(within))
        .join(F.broadcast(offsets), ["length", "salt"], "left")
        .withColumn("rank", F.col("rank") - 1 + F.col("before"))
        .join(F.broadcast(places), "length", "left")
    )
    # Runs stand in the order of their first rank, so the last that begins at or before the rank holds it.
    run = F.expr("element_at(filter(runs, x -> x.first <= rank), -1)")
    return ranked.withColumn("run", run).select(key, "n_tokens", "piece_no", "first_token", "length", (F.col("run.container") + F.col("rank") - F.col("run.first")).alias("container_id"))
