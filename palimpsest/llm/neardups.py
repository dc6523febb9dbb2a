"""Problem 5: records that share most of their content but differ by small edits.

Equal texts are one class, whose row with the least key represents it, and texts are sets of word shingles. Each
representative gets a sketch of BITS one-bit minhashes and bands of ROWS minhashes each; representatives that share a
band are candidates. Candidates are compared bit-sliced: a block of sketches is stored once as bit planes (a plane holds
one sketch position of 64 texts in a word), planes shifted against themselves or against a query give the differences of
64 pairs in a word, carry-save adders count them, and after every few planes the words all of whose pairs exceed the
radius are abandoned. What stays within the radius is verified on the shingle sets themselves.

A band that many texts share is split into blocks, and pairs of blocks are compared in tasks of their own, so no band
is capped. Bands that hold a share of all texts are seen in a sample before the shuffle, so that not even their rows
come together in one task; the sample decides only by which of two ways a band is compared. At the default values a pair of similarity 0.6 shares no band with probability 0.0011 and exceeds the
radius with probability 0.0002; at 0.7 and more both are below 0.0001.

Defined results: null texts and texts under `min_words` words belong to no class; repeated rows of one key count once;
copies are linked through their class.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.batches import map_lists
from palimpsest.session import cut

SHINGLE, THRESHOLD, MIN_WORDS = 3, 0.6, 40
BITS, BANDS, ROWS = 128, 28, 3
BLOCK = 2048  # of one band's texts that are compared in one task
#: One of SAMPLE_OF texts is looked at for bands of at least LARGE_SHARE of them, and LARGE_LEAST.
SAMPLE_OF, LARGE_SHARE, LARGE_LEAST = 64, 0.01, 64
STEP = 32  # planes between two looks at the radius
WORD = re.compile(r"[^\W_]+")
_A = np.random.default_rng(7).integers(1, 1 << 63, BITS, dtype=np.uint64) | np.uint64(1)
_B = np.random.default_rng(8).integers(0, 1 << 63, BITS, dtype=np.uint64)


def radius(threshold: float, bits: int = BITS, sigmas: float = 3.6) -> int:
    """One-bit minhashes of texts of similarity s agree with probability (1 + s) / 2."""
    p = (1 - threshold) / 2
    return int(bits * p + sigmas * (bits * p * (1 - p)) ** 0.5)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Shingle sets as sorted 64-bit hashes; word hashes are kept for a task, up to a bound."""

    def __init__(self, n: int = SHINGLE, keep: int = 200_000):
        self.n, self.keep, self.hash = n, keep, {}

    def __call__(self, text: str, min_words: int = 0) -> np.ndarray | None:
        words = WORD.findall(text.lower())
        if len(words) < max(min_words, self.n):
            return None
        known = self.hash
        if len(known) > self.keep:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        h = np.array([known[w] for w in words], np.uint64)
        out = np.zeros(len(h) - self.n + 1, np.uint64)
        for j in range(self.n):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - self.n + 1 + j])
        return np.unique(out)


def minhashes(shingles: np.ndarray) -> np.ndarray:
    return ((shingles[:, None] * _A + _B) >> np.uint64(16)).min(0)


def sketch(mins: np.ndarray) -> tuple[int, int]:
    bits = np.packbits((mix(mins) & np.uint64(1)).astype(np.uint8)).view(np.int64)
    return int(bits[0]), int(bits[1])


def band_keys(mins: np.ndarray) -> np.ndarray:
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + mins[j : BANDS * ROWS : ROWS])
    return keys.view(np.int64)


def planes_of(sketches: np.ndarray) -> np.ndarray:
    """Sketches (two words a row) stored vertically: plane p holds bit p of all rows, 64 rows in a word, and a word of padding."""
    n = len(sketches)
    bits = np.unpackbits(np.ascontiguousarray(sketches).view(np.uint8).reshape(n, BITS // 8), axis=1)
    out = np.zeros((BITS, (-(-n // 64) + 1) * 8), np.uint8)
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    out[:, : packed.shape[1]] = packed
    return out.view(np.uint64)


def add_up(rows: list[list[np.ndarray]]) -> list[list[np.ndarray]]:
    """Carry-save: rows[k] are planes of weight 2 ** k; three of one weight become a sum and a carry, until one is left of each."""
    out, k = [], 0
    while k < len(rows):
        now = np.concatenate(rows[k]) if rows[k] else None
        carries = []
        while now is not None and len(now) > 1:
            t = len(now) // 3
            if t:
                a, b, c = now[:t], now[t : 2 * t], now[2 * t : 3 * t]
                half = a ^ b
                carries.append((a & b) | (c & half))
                now = np.concatenate([half ^ c, now[3 * t :]])
            else:
                carries.append(now[:1] & now[1:])
                now = now[:1] ^ now[1:]
        out.append([now] if now is not None else [])
        if carries:
            if k + 1 == len(rows):
                rows = [*rows, []]
            rows[k + 1] = [*rows[k + 1], *carries]
        k += 1
    return out


def within(differences, n_words: int, limit: int, wanted: np.ndarray) -> np.ndarray:
    """Of words of 64 pairs: the pairs whose planes of differences add up to at most limit, among the wanted.

    differences(first, last, words) gives the planes first to last of some words. After every STEP planes the words all of
    whose wanted pairs exceed the limit are abandoned.
    """
    alive = np.flatnonzero(wanted)
    counters: list[list[np.ndarray]] = []
    out = np.zeros(n_words, np.uint64)
    for first in range(0, BITS, STEP):
        if not len(alive):
            return out
        rows = [list(c) for c in counters] or [[]]
        rows[0] = [*rows[0], differences(first, first + STEP, alive)]
        counters = add_up(rows)
        over, equal = np.zeros(len(alive), np.uint64), np.full(len(alive), ~np.uint64(0))
        for k in reversed(range(max(len(counters), limit.bit_length()))):
            bit = counters[k][0][0] if k < len(counters) and counters[k] else np.zeros(len(alive), np.uint64)
            if limit >> k & 1:
                equal &= bit
            else:
                over |= equal & bit
                equal &= ~bit
        near = wanted[alive] & ~over
        left = near != 0
        alive, near, counters = alive[left], near[left], [[c[0][:, left]] if c else [] for c in counters]
    out[alive] = near
    return out


def lanes(words: np.ndarray) -> np.ndarray:
    """Numbers of the set bits."""
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def pack(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(-(-len(flags) // 64) * 8, np.uint8)
    packed = np.packbits(flags, bitorder="little")
    out[: len(packed)] = packed
    return out.view(np.uint64)


def close_within(sketches: np.ndarray, sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows within consecutive groups of the given sizes that are within the limit.

    The planes are stored once. For every distance d they are shifted by d rows, so that each row meets the d-th after it,
    64 pairs in a word; groups stand in the order of their size, so only the rows of groups of more than d are looked at.
    """
    starts = np.cumsum(sizes) - sizes
    by_size = np.argsort(-sizes, kind="stable")
    sizes, starts = sizes[by_size], starts[by_size]
    ends = np.cumsum(sizes)
    inside = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
    order = np.repeat(starts, sizes) + inside
    after = np.repeat(sizes, sizes) - inside - 1  # rows of the group that follow
    planes = planes_of(sketches[order])
    left, right = [], []
    for d in range(1, int(sizes[0])):
        n = int(ends[np.searchsorted(-sizes, -d) - 1])  # rows in groups of more than d
        wanted = pack(after[:n] >= d)
        skip, shift = d // 64, np.uint64(d % 64)

        def differences(first: int, last: int, words: np.ndarray) -> np.ndarray:
            part = planes[first:last]
            top = part.shape[1] - 1
            other = part[:, np.minimum(words + skip, top)] >> shift
            if shift:
                other |= part[:, np.minimum(words + skip + 1, top)] << (np.uint64(64) - shift)
            return other ^ part[:, words]

        i = lanes(within(differences, len(wanted), limit, wanted))
        left.append(order[i])
        right.append(order[i + d])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


def close_between(a: np.ndarray, b: np.ndarray, limit: int, rows: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) of sketches a[i] and b[j] within the limit: every row of a is a query to the planes of b."""
    planes = planes_of(b)[:, :-1]
    asked = np.unpackbits(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), BITS // 8), axis=1).T.astype(np.uint64) * ~np.uint64(0)
    width = planes.shape[1]
    one = pack(np.ones(len(b), bool))
    left, right = [], []
    for first in range(0, len(a), rows):
        q = asked[:, first : first + rows]

        def differences(low: int, high: int, words: np.ndarray) -> np.ndarray:
            return planes[low:high, words % width] ^ q[low:high, words // width]

        n = q.shape[1]
        found = within(differences, n * width, limit, np.tile(one, n))
        at = lanes(found)
        left.append(first + at // (64 * width))
        right.append(at % (64 * width))
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _emit(ids: np.ndarray, i: np.ndarray, j: np.ndarray):
    """The pairs of rows as pairs of ids, each once, as a batch."""
    x, y = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
    pairs = np.unique(np.stack([x, y], 1)[x != y], axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], schema=PAIR)


def sketches(df: DataFrame, min_words: int) -> DataFrame:
    """key, s0, s1, bands of (key, text) rows with enough words."""

    def make():
        shingler = Shingler()

        def run(keys, texts):
            out = [], [], [], []
            for k, t in zip(keys, texts):
                s = shingler(t, min_words)
                if s is not None:
                    m = minhashes(s)
                    for c, v in zip(out, (k, *sketch(m), band_keys(m))):
                        c.append(v)
            return out

        return run

    return map_lists(df, make, "key bigint, s0 bigint, s1 bigint, bands array<bigint>")


def large_bands(rows: DataFrame, min_words: int) -> DataFrame:
    """band: at most BANDS / LARGE_SHARE rows."""
    sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE_OF)) == 0).groupBy("text").agg(F.min("key").alias("key")).select("key", "text")
    bands = cut(sketches(sample, min_words).select(F.explode("bands").alias("band")))
    least = max(LARGE_LEAST, bands.count() / BANDS * LARGE_SHARE)
    return cut(bands.groupBy("band").count().where(F.col("count") >= least).select("band"))


def near_pairs(df: DataFrame, key: str, text: str, threshold: float = THRESHOLD, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """(members, links): members has key and rep; links has rep_a, rep_b, similarity for each pair of classes at or above the threshold."""
    rows = df.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).where(F.col("key").isNotNull() & (F.length("text") >= 2 * max(min_words, SHINGLE) - 1))
    same = F.md5("text").alias("same")
    ids = cut(rows.where(F.regexp_count("text", F.lit(r"[\p{L}\p{N}]+")) >= max(min_words, SHINGLE)).select("key", same))
    members = ids.distinct().join(ids.groupBy("same").agg(F.min("key").alias("rep")), "same").select("key", "rep")
    # The only shuffle of texts: each class keeps its representative's.
    texts = rows.groupBy(same).agg(F.min(F.struct("key", "text")).alias("x")).select("x.*")
    banded = sketches(texts, min_words).select(F.explode("bands").alias("band"), "key", "s0", "s1")
    large = large_bands(rows, min_words)
    limit = radius(threshold)
    rest, known = banded, None
    if not large.isEmpty():
        rest = banded.join(F.broadcast(large), "band", "left_anti")
        known = cut(banded.join(F.broadcast(large), "band"))
        known = known.join(F.broadcast(known.groupBy("band").agg(F.count("*").alias("n"))), "band").where("n > 1")
    # One shuffle by band; bands of one text are dropped at once, and the rest is cut so that large bands can be split.
    sized = cut(rest.withColumn("n", F.count("*").over(Window.partitionBy("band"))).where("n > 1"))

    def small(batches):
        held: list[np.ndarray] = []
        count = 0

        def flush(rows: np.ndarray):
            change = np.flatnonzero(np.r_[True, np.diff(rows[:, 0]) != 0])
            return _emit(rows[:, 1], *close_within(np.ascontiguousarray(rows[:, 2:4]), np.diff(np.r_[change, len(rows)]), limit))

        for batch in batches:
            if batch.num_rows:
                held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1))
                count += batch.num_rows
            if count > 20_000:
                rows_ = np.concatenate(held)
                before = np.flatnonzero(rows_[:, 0] != rows_[-1, 0])  # the last band may go on in the next batch
                last = int(before[-1]) + 1 if len(before) else 0
                if last:
                    yield flush(rows_[:last])
                held, count = [rows_[last:]], len(rows_) - last
        if count:
            yield flush(np.concatenate(held))

    few = sized.where(F.col("n") <= BLOCK).sortWithinPartitions("band").select("band", "key", "s0", "s1").mapInArrow(small, "a bigint, b bigint")
    # Large bands: block i against block j for all i <= j, each pair of blocks a group.
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("key"), blocks).cast("int")
    many = sized.where(F.col("n") > BLOCK)
    many = many if known is None else many.unionByName(known.select(*many.columns))
    many = (
        many.withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("band", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "key", "s0", "s1")
    )

    def block_pairs(pdf):
        ids, sk = pdf["key"].to_numpy(), np.ascontiguousarray(pdf[["s0", "s1"]].to_numpy())
        own = pdf["mine"].to_numpy()
        if pdf["i"].iat[0] == pdf["j"].iat[0]:
            i, j = close_between(sk, sk, limit)
        else:
            p, q = np.flatnonzero(own == pdf["i"].iat[0]), np.flatnonzero(own == pdf["j"].iat[0])
            i, j = close_between(sk[p], sk[q], limit)
            i, j = p[i], q[j]
        return _emit(ids, i, j).to_pandas()

    far = many.groupBy("band", "i", "j").applyInPandas(block_pairs, "a bigint, b bigint")
    close = cut(few.unionByName(far).distinct())
    links = verify(close, df, key, text, threshold)
    return members, links


def verify(close: DataFrame, df: DataFrame, key: str, text: str, threshold: float) -> DataFrame:
    """rep_a, rep_b, similarity of the pairs (a, b) whose shingle sets are similar enough."""
    texts = df.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    wanted = close.select(F.col("a").alias("key")).union(close.select("b")).distinct()
    texts = cut(texts.join(wanted, "key", "left_semi").dropDuplicates(["key"]))
    both = close.join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")

    def make():
        shingler = Shingler()

        def run(a, b, ta, tb):
            out = [], [], []
            for row in zip(a, b, ta, tb):
                x, y = shingler(row[2]), shingler(row[3])
                common = len(np.intersect1d(x, y, assume_unique=True))
                s = common / (len(x) + len(y) - common)
                if s >= threshold:
                    for c, v in zip(out, (row[0], row[1], s)):
                        c.append(v)
            return out

        return run

    return map_lists(both.select("a", "b", "text_a", "text_b"), make, "rep_a bigint, rep_b bigint, similarity double")
