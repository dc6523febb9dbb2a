"""Problem 4: the k most similar vectors of every vector.

Vectors are normalised and assigned to the nearest of some centroids, fitted on a bounded sample; cells hold about CELL
vectors, more only where their number would exceed SPREAD times the square root of the vectors'. More than FITTED cells
are fitted by the executors in parts, each on the sampled vectors nearest to one of a few first centroids, so the driver
holds SAMPLE vectors and the centroids at most, and of products with the centroids HELD numbers at a time. What is left after
taking away the centroid is normalised and rotated at random; its signs are the code, one bit a dimension, and its inner
product with the code's vector is the correction scalar. A query is rotated likewise and its residual quantised to QBITS
bits, whose planes meet the packed codes with AND and popcount. That estimates the inner product; for given data the
error of the estimate is bounded by EPSILON standard deviations. Reranked, exactly, are the vectors whose upper bound
reaches the query's k-th best lower bound, or its k-th best similarity so far.

A query looks into its nearest cells, at least PROBES (ASKED, if only some rows are queries) and as many as TUNE held-out
queries, compared with all vectors, need to find RECALL of their true neighbours. If all rows are queries, what a query
finds counts for both: also reranked are vectors among whose own k best the query may be. Neighbouring cells are one
group, so a query is sent once to a group. Groups of more than BLOCK vectors, and their queries, are split into blocks,
and each pair of blocks meets in a task of its own; the k best of all are merged at the end.

Defined results: vectors that are null, of another length than `dims`, all zero, or hold null, NaN or infinity are not
usable and have no row; equal similarities are ordered by key; of repeated keys one row counts; with fewer than k
others there are fewer neighbours.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.session import cut, spread

K, DIMS, PROBES, ASKED, CELL, SPREAD, GROUP, BLOCK = 5, 64, 12, 32, 256, 4, 4096, 8192
#: Vectors sampled for the centroids on the driver, and by executors for each cell; held-out queries, and the share of neighbours that they must find.
SAMPLE, SAMPLE_OF_CELL, TUNE, RECALL = 20_000, 16, 256, 0.98
QBITS, EPSILON = 4, 2.2
#: Cells that the driver fits itself; numbers of a matrix of products that are held at a time.
FITTED, HELD = 1024, 1 << 21
#: From one in so many pairs on, a matrix product is less work than the pairs one by one.
DENSE = 24


def usable(column: str, dims: int):
    v = F.col(column)
    return v.isNotNull() & (F.size(v) == dims) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def rotation(dims: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(4).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def blocks(rows: int, columns: int) -> list[slice]:
    """Parts of the rows whose products with so many columns are HELD numbers at most."""
    step = max(1, HELD // max(1, columns))
    return [slice(i, i + step) for i in range(0, rows, step)]


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Number of the centroid nearest to each vector."""
    out = np.zeros(len(x), np.int32)
    for b in blocks(len(x), len(c)):
        out[b] = (x[b] @ c.T).argmax(1)
    return out


def centroids(x: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means."""
    c = x[np.random.default_rng(5).choice(len(x), n, replace=False)]
    for _ in range(rounds):
        near = nearest(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        full = np.bincount(near, minlength=n) > 0
        c[full] = unit(sums[full])
    return c


def pack(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as words of 64."""
    padded = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), np.uint8)
    padded[:, : bits.shape[1]] = bits
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


class Codes:
    """One-bit codes of the vectors of a cell."""

    def __init__(self, x: np.ndarray, centre: np.ndarray, turn: np.ndarray):
        self.dims = x.shape[1]
        residual = (x - centre) @ turn.T
        self.length = np.linalg.norm(residual, axis=1)
        direction = residual / np.where(self.length > 0, self.length, 1)[:, None]
        bits = direction > 0
        self.code = pack(bits)
        self.ones = bits.sum(1)
        # inner product of each direction with its code's unit vector; 1 where there is no residual
        self.fit = np.where(self.length > 0, np.abs(direction).sum(1) / np.sqrt(self.dims), 1)
        self.offset = x @ centre

    def bounds(self, query: np.ndarray, centre: np.ndarray, turn: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
        """Upper bounds of <x, query> for each query (row) and vector (column), and twice the error."""
        q = (query - centre) @ turn.T
        low, high = q.min(1), q.max(1)
        step = np.where(high > low, (high - low) / ((1 << QBITS) - 1), 1)
        levels = np.rint((q - low[:, None]) / step[:, None]).astype(np.uint8)
        met = np.zeros((len(q), len(self.code)), np.uint16)
        for b in reversed(range(QBITS)):
            plane = pack(levels >> b & 1)
            met <<= 1
            for w in range(self.code.shape[1]):
                met += np.bitwise_count(plane[:, w, None] & self.code[None, :, w])
        # <x, q> = <x - c, q - c> + <x, c> + <c, q> - <c, c>, and x - c is estimated as weight (2 bits - 1) in each dimension:
        # all but the counts of common bits is a product of a few columns and rows.
        weight = self.length / self.fit / np.sqrt(self.dims)
        spread = self.length * np.sqrt(np.maximum(1 - self.fit**2, 0)) / self.fit * epsilon / np.sqrt(self.dims - 1)
        norm = np.linalg.norm(q, axis=1)
        error = np.stack([norm, step], 1).astype(np.float32) @ np.stack([spread, self.length * 0.5]).astype(np.float32)
        left = np.stack([2 * low, -(step * levels.sum(1) + low * self.dims), np.ones(len(q)), query @ centre - centre @ centre], 1)
        right = np.stack([weight * self.ones, weight, self.offset, np.ones(len(weight))])
        upper = left.astype(np.float32) @ right.astype(np.float32)
        upper += error
        upper += met * (2 * step).astype(np.float32)[:, None] * weight.astype(np.float32)
        error *= 2
        return upper, error


class Best:
    """The k best (key, similarity) of each row so far."""

    def __init__(self, n: int, k: int):
        self.k, self.keys, self.sims = k, np.zeros((n, k), np.int64), np.full((n, k), -9.0)

    @property
    def floor(self) -> np.ndarray:
        return self.sims[:, -1]

    def add(self, rows: np.ndarray, keys: np.ndarray, sims: np.ndarray) -> None:
        if not len(rows):
            return
        touched = np.unique(rows)
        r = np.concatenate([np.repeat(touched, self.k), rows])
        keys, sims = np.concatenate([self.keys[touched].ravel(), keys]), np.concatenate([self.sims[touched].ravel(), sims])
        order = np.lexsort((keys, -sims, r))
        r, keys, sims = r[order], keys[order], sims[order]
        at = np.arange(len(r)) - np.searchsorted(r, r)
        keep = at < self.k
        self.keys[r[keep], at[keep]], self.sims[r[keep], at[keep]] = keys[keep], sims[keep]

    def rows(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r, c = np.nonzero(self.sims > -9)
        return own[r], self.keys[r, c], self.sims[r, c]


def kth(lower: np.ndarray, k: int, axis: int) -> np.ndarray:
    if lower.shape[axis] < k:
        return np.full(lower.shape[1 - axis], -9.0)
    return np.take(np.partition(lower, -k, axis=axis), -k, axis=axis)


def search_cell(query: np.ndarray, query_keys: np.ndarray, at: np.ndarray, found: Best, x: np.ndarray, keys: np.ndarray, centre: np.ndarray, turn: np.ndarray, back: Best | None, back_at: np.ndarray) -> None:
    """Add to found (in rows at) the cell's vectors that may be among the queries' best, and to back the queries, seen from the vectors."""
    codes = Codes(x, centre, turn)
    k = found.k
    for i in range(0, len(query), 512):
        q, own = query[i : i + 512], at[i : i + 512]
        upper, twice = codes.bounds(q, centre, turn)
        same = query_keys[i : i + 512, None] == keys[None, :]
        lower = upper - twice
        lower[same] = -9
        may = upper >= np.maximum(kth(lower, k, 1), found.floor[own] - 1e-6)[:, None]
        if back is not None:
            may |= upper >= np.maximum(kth(lower, k, 0), back.floor[back_at] - 1e-6)[None, :]
        may &= ~same
        exact = lower  # its place is used again
        exact.fill(-9)
        rows, cols = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
        # Exact products: of the pairs alone if they are few, else of the rows and columns that hold them, in one matrix product.
        r, c = np.nonzero(may)
        if len(r) * DENSE < len(rows) * len(cols):
            sims = np.einsum("ij,ij->i", q[r], x[c])
        else:
            block = np.zeros_like(exact)
            block[np.ix_(rows, cols)] = q[rows] @ x[cols].T
            sims = block[r, c]
        exact[r, c] = sims
        near = sims >= np.maximum(kth(exact, k, 1), found.floor[own])[r]
        found.add(own[r[near]], keys[c[near]], sims[near])
        if back is not None:
            near = sims >= np.maximum(kth(exact, k, 0), back.floor[back_at])[c]
            back.add(back_at[c[near]], query_keys[i : i + 512][r[near]], sims[near])


def matrix(column: pd.Series) -> np.ndarray:
    return unit(np.frombuffer(b"".join(column), np.float32).reshape(len(column), -1).astype(np.float64))


def sampled(clean: DataFrame, n: int, size: int) -> DataFrame:
    """About so many of the n rows, always the same."""
    return clean if size >= n else clean.where(F.xxhash64("key") < int(-(2**63) + 2**64 * (size / n)))


def fitted(clean: DataFrame, n: int, cells: int, sample: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The cells' centroids, and the group of each."""
    x = matrix(sample["v"])
    if cells <= FITTED:
        centres = centroids(x, max(1, min(cells, len(x) // 4)))
        return centres, nearest(centres, centroids(centres, max(1, min(len(centres), n // GROUP))))
    first = clean.sparkSession.sparkContext.broadcast(centroids(x, max(1, min(int(cells**0.5), len(x) // 4))))
    share = SAMPLE_OF_CELL * cells / n

    def near(pdfs):
        for pdf in pdfs:
            if len(pdf):
                yield pdf.assign(part=nearest(matrix(pdf["v"]), first.value))

    def fit(pdf):
        own = matrix(pdf.sort_values("key")["v"])
        c = centroids(own, max(1, len(own) // SAMPLE_OF_CELL))
        groups = centroids(c, max(1, min(len(c), round(len(own) / share / GROUP))))
        return pd.DataFrame({"part": pdf["part"].iloc[0], "grp": nearest(c, groups), "cell": np.arange(len(c)), "v": [r.tobytes() for r in c.astype(np.float32)]})

    parts = sampled(clean, n, SAMPLE_OF_CELL * cells).mapInPandas(near, "key bigint, v binary, part int")
    got = parts.groupBy("part").applyInPandas(fit, "part int, grp int, cell int, v binary").toPandas().sort_values(["part", "cell"])  # a row for each cell
    return matrix(got["v"]), np.unique(got[["part", "grp"]].to_numpy(np.int64) @ [1 << 32, 1], return_inverse=True)[1]


def probes_needed(clean: DataFrame, sample: pd.DataFrame, cells: np.ndarray, k: int, both: bool, dims: int) -> int:
    """How many cells the first TUNE rows of the sample must look into to find RECALL of their k best among all rows."""
    held = matrix(sample["v"][:TUNE])
    ids = sample["key"].to_numpy()[:TUNE]
    asked = clean.sparkSession.sparkContext.broadcast((held.astype(np.float32), ids))

    def look(pdfs):
        q, own = asked.value
        best = Best(len(q), k)
        vectors: dict[int, bytes] = {}
        for pdf in pdfs:
            if len(pdf):
                keys = pdf["key"].to_numpy()
                sims = q @ matrix(pdf["v"]).astype(np.float32).T
                sims[own[:, None] == keys[None, :]] = -9
                r, c = np.nonzero(sims >= np.maximum(kth(sims, min(k, sims.shape[1]), 1), best.floor)[:, None])
                best.add(r, keys[c], sims[r, c].astype(np.float64))
                vectors |= dict(zip(keys[c].tolist(), pdf["v"].to_numpy()[c]))
        r, c = np.nonzero(best.sims > -9)
        keys = best.keys[r, c]
        yield pd.DataFrame({"row": r.astype(np.int32), "key": keys, "similarity": best.sims[r, c], "v": [vectors[x] for x in keys.tolist()]})

    near = clean.mapInPandas(look, "row int, key bigint, similarity double, v binary")
    order = Window.partitionBy("row").orderBy(F.desc("similarity"), "key")
    got = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("row", "v").toPandas()  # at most TUNE * k rows
    if not len(got):
        return 1
    row, v = got["row"].to_numpy(), matrix(got["v"])
    place = lambda sims, of: (sims > sims[np.arange(len(of)), of][:, None]).sum(1)
    at = np.zeros(len(row), np.int64)
    for b in blocks(len(row), len(cells)):
        mine, theirs = held[row[b]] @ cells.T, v[b] @ cells.T
        at[b] = place(mine, theirs.argmax(1))
        at[b] = np.minimum(at[b], place(theirs, mine.argmax(1))) if both else at[b]
    return int(np.sort(at)[min(len(at) - 1, int(np.ceil(RECALL * len(at))) - 1)]) + 1


def neighbours(df: DataFrame, key: str = "seq", vector: str = "embedding", k: int = K, dims: int = DIMS, probes: int | None = None, queries: DataFrame | None = None) -> DataFrame:
    """key, neighbour, similarity, rank: the k most similar others of each query (by default of each row). probes: cells to look into, None: as needed."""
    spark = df.sparkSession

    def floats(pdfs):
        for pdf in pdfs:
            yield pd.DataFrame({"key": pdf["key"], "v": [r.astype(np.float32).tobytes() for r in pdf["v"]]})

    def pick(x: DataFrame) -> DataFrame:
        rows = spread(x.where(F.col(key).isNotNull() & usable(vector, dims)).select(F.col(key).cast("bigint").alias("key"), F.col(vector).cast("array<double>").alias("v")))
        return cut(rows.mapInPandas(floats, "key bigint, v binary").dropDuplicates(["key"]))

    clean = pick(df)
    n = clean.count()
    schema = "key bigint, neighbour bigint, similarity double, rank int"
    if not n:
        return spark.createDataFrame([], schema)
    cells = max(1, min(n // CELL, int(SPREAD * n**0.5)))
    # A filter, since an order with a limit has each partition send as many rows as the limit; some more than needed, as their number varies.
    sample = sampled(clean, n, SAMPLE * 21 // 20).withColumn("at", F.xxhash64("key")).toPandas().sort_values(["at", "key"], ignore_index=True)[:SAMPLE]
    centres, group_of = fitted(clean, n, cells, sample)
    turn = rotation(dims)
    both = queries is None
    if probes is None:
        least = PROBES if both else ASKED
        probes = least if len(centres) <= least else max(least, probes_needed(clean, sample, centres, k, both, dims))
    shared = spark.sparkContext.broadcast((centres, centres.astype(np.float32), group_of.astype(np.int32)))

    def data(pdfs):
        _, c, group = shared.value
        for pdf in pdfs:
            if len(pdf):
                cell = nearest(matrix(pdf["v"]).astype(np.float32), c)
                yield pd.DataFrame({"grp": group[cell], "cell": cell, "key": pdf["key"].to_numpy(), "v": pdf["v"]})

    def asked(pdfs):
        """A row for each query and group that holds some of its cells, with these cells."""
        _, c, group = shared.value
        most = min(probes, len(c))
        for pdf in pdfs:
            if len(pdf):
                x = matrix(pdf["v"]).astype(np.float32)
                far, of = np.zeros(len(x) * most, np.float32), np.zeros(len(x) * most, np.int64)
                for b in blocks(len(x), len(c)):
                    less = -(x[b] @ c.T)
                    top = np.argpartition(less, most - 1, axis=1)[:, :most]
                    to = slice(b.start * most, b.stop * most)
                    far[to], of[to] = np.take_along_axis(less, top, 1).ravel(), top.ravel()
                rows = np.repeat(np.arange(len(x)), most)
                order = np.lexsort((far, group[of], rows))  # the nearest of a group first
                rows, of = rows[order], of[order]
                first = np.flatnonzero(np.r_[True, (np.diff(rows) != 0) | (np.diff(group[of]) != 0)])
                parts = np.split(of.astype(np.int32), first[1:])
                yield pd.DataFrame({"grp": group[of[first]], "cells": parts, "key": pdf["key"].to_numpy()[rows[first]], "v": pdf["v"].to_numpy()[rows[first]]})

    there = cut(clean.mapInPandas(data, "grp int, cell int, key bigint, v binary"))
    here = (clean if both else pick(queries)).mapInPandas(asked, "grp int, cells array<int>, key bigint, v binary")
    # Numbers of blocks by group: a row for each group, and there are no more groups than cells, so at most SPREAD * sqrt(n).
    sizes = there.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    if both:  # a group's queries are at most all rows of the groups around it; as many blocks as its own rows need do
        sizes = sizes.withColumn("q_blocks", F.col("blocks"))
    else:
        here = cut(here)
        sizes = sizes.join(here.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("q_blocks")), "grp")
    sizes = F.broadcast(cut(sizes))
    block = lambda c: F.pmod(F.xxhash64("key"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    there = there.join(sizes, "grp").select("grp", block("blocks").alias("block"), every("q_blocks").alias("q_block"), "cell", "key", "v")
    here = here.join(sizes, "grp").select("grp", every("blocks").alias("block"), block("q_blocks").alias("q_block"), *(F.col(c).alias(c) for c in ("cells", "key", "v")))

    def meet(left, right):
        out = []
        if len(left) and len(right):
            centre = shared.value[0]
            q, q_keys, x, keys = matrix(left["v"]), left["key"].to_numpy(), matrix(right["v"]), right["key"].to_numpy()
            order = np.argsort(right["cell"].to_numpy(), kind="stable")
            cell = right["cell"].to_numpy()[order]
            lists = left["cells"].to_numpy()
            lengths = np.array([len(c) for c in lists])
            rows, of = np.repeat(np.arange(len(left)), lengths), np.concatenate(lists)
            first = np.zeros(len(of), bool)
            first[np.cumsum(lengths) - lengths] = True
            found, back = Best(len(q), k), Best(len(x), k) if both else None
            for part in (first, ~first):  # first each query's nearest cell, so that little of the others is reranked
                by_cell = np.flatnonzero(part)[np.argsort(of[part], kind="stable")]
                r, at = rows[by_cell], of[by_cell]
                for c in np.unique(cell):
                    mine, theirs = order[np.searchsorted(cell, c) : np.searchsorted(cell, c, "right")], r[np.searchsorted(at, c) : np.searchsorted(at, c, "right")]
                    if len(theirs):
                        search_cell(q[theirs], q_keys[theirs], theirs, found, x[mine], keys[mine], centre[c], turn, back, mine)
            out = [found.rows(q_keys)] + ([back.rows(keys)] if both else [])
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pd.DataFrame({"key": cols[0], "neighbour": cols[1], "similarity": cols[2]})

    by = ["grp", "block", "q_block"]
    met = here.groupBy(*by).cogroup(there.groupBy(*by)).applyInPandas(meet, "key bigint, neighbour bigint, similarity double")
    met = met.repartition("key").groupBy("key", "neighbour").agg(F.max("similarity").alias("similarity"))
    ranked = Window.partitionBy("key").orderBy(F.desc("similarity"), "neighbour")
    return met.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
