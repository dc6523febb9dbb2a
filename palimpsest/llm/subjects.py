"""Problem 10: the subjects of each document.

A word's vector is the sum of its own embedding and the mean of those of its character n-grams (hashed into one table);
a sentence's vector is the mean over its words, and every subject has an independent logistic output on it. Training:
the labelled documents lie in partitions; in every step each partition computes the gradient of its sentences, the
driver adds the gradients up and takes one step, so the result does not depend on the partitioning. A sentence's
targets are its document's subjects, and after a few steps only the one of them that the model finds likeliest.
Scoring: the outputs are linear in the word vectors, so a word's contribution to each subject is computed once in a
task; a sentence treats its best subject if it is sure enough, and a document the subjects of enough sentences, a share of
all sure ones or close to each other, but always at least one. Sentences of which more than half stands in a stretch of QUOTED words or more of
quoted texts (test items, say) count neither in training nor in scoring.

Defined results: null or wordless texts get no subject; labels of unknown documents and repeated labels are ignored;
with no labels at all every text gets nothing. The labels of at most MAX_LABELLED documents are used, the first by the
hash of their id; every document is scored. Quoted texts are collected, so they must be a bounded set, as test items are.
"""

from __future__ import annotations

import pickle
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.batches import map_lists
from palimpsest.session import cut, spread

BUCKETS, DIMS, STEPS, WARM_UP, RATE, DECAY, MAX_LABELLED, PER_PART, MAX_WORDS = 1 << 15, 16, 30, 12, 0.07, 1e-5, 20_000, 1_500, 500_000
NGRAMS = (3, 5)
WORD = re.compile(r"[^\W\d_]+")
#: Words, and the signs that end a sentence.
TOKEN = re.compile(r"[^\W\d_]+|[.!?](?=\s)|\n")
#: A sentence treats its best subject if the output is at least SURE; a document's subjects have MANY such sentences, and
#: SHARE of all such or MANY within CLOSE sentences.
SURE, MANY, SHARE, CLOSE = 0.6, 3, 0.1, 6
#: Texts that are scored at a time.
TOGETHER = 100
#: Words in a row that make a quotation.
QUOTED = 8


def features(word: str) -> tuple[int, list[int]]:
    """Places of the word and of its n-grams in the table."""
    marked = f"<{word}>"
    grams = [marked[i : i + n] for n in range(NGRAMS[0], NGRAMS[1] + 1) for i in range(len(marked) - n + 1)]
    return zlib.crc32(word.encode()) % BUCKETS, [zlib.crc32(b"#" + g.encode()) % BUCKETS for g in grams]


class Vocabulary:
    """Words met so far, as rows of word vectors."""

    def __init__(self):
        self.row: dict[str, int] = {}
        self.own: list[int] = []
        self.grams: list[list[int]] = []

    def ids(self, words: list[str]) -> list[int]:
        row = self.row
        try:
            return [*map(row.__getitem__, words)]
        except KeyError:
            for w in words:
                if w not in row:
                    row[w] = len(self.own)
                    own, grams = features(w)
                    self.own.append(own)
                    self.grams.append(grams)
            return [*map(row.__getitem__, words)]

    def vectors(self, table: np.ndarray, start: int = 0) -> np.ndarray:
        own, grams = self.own[start:], self.grams[start:]
        sizes = np.array([len(g) for g in grams])
        flat = np.concatenate([np.array(g) for g in grams])
        return table[own] + np.add.reduceat(table[flat], np.cumsum(sizes) - sizes) / sizes[:, None]


class Reader:
    """Texts as sentences of word numbers, without what is quoted from some texts (given as lists of words)."""

    def __init__(self, quotes: list[list[str]]):
        self.vocabulary = Vocabulary()
        self.vocabulary.ids(["."])
        self.vocabulary.row |= dict.fromkeys(".!?\n", 0)  # 0: a sentence ends
        parts = [self.codes(self.vocabulary.ids(q)) for q in quotes if len(q) >= QUOTED]
        self.known = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)

    @staticmethod
    def codes(ids: list[int]) -> np.ndarray:
        """Of every three words in a row."""
        a = np.array(ids, np.int64)
        return (a[:-2] << 42) | (a[1:-1] << 21) | a[2:]

    def read(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(word numbers, sizes of the sentences)"""
        tokens = np.array(self.vocabulary.ids(TOKEN.findall(text.lower())), np.int64)
        words = tokens > 0
        ids, ends = tokens[words], np.cumsum(words)[~words]
        sizes = np.diff(ends, prepend=0, append=len(ids))
        sizes = sizes[sizes > 0]
        if len(self.known) and len(ids) >= QUOTED:
            codes = self.codes(ids)
            hit = self.known[np.minimum(np.searchsorted(self.known, codes), len(self.known) - 1)] == codes
            if hit.any():
                edges = np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0]))
                inside = np.zeros(len(ids), bool)
                for first, last in zip(edges[::2], edges[1::2]):
                    if last - first >= QUOTED - 2:
                        inside[first : last + 2] = True
                keep = 2 * np.add.reduceat(inside, np.cumsum(sizes) - sizes, dtype=np.int64) <= sizes
                if keep.any():
                    ids, sizes = ids[np.repeat(keep, sizes)], sizes[keep]
        return ids, sizes


class Part:
    """The labelled sentences of one partition, ready for gradients."""

    def __init__(self, texts: list[str], labels: list[list[int]], n_subjects: int, quotes: list[list[str]] = []):  # noqa: B006
        reader = Reader(quotes)
        read = [(*reader.read(t), ks) for t, ks in zip(texts, labels)]
        read = [x for x in read if len(x[1])]
        # Words of this part's sentences only, numbered anew.
        used, flat = np.unique(np.concatenate([ids for ids, _, _ in read] or [np.zeros(0, np.int64)]), return_inverse=True)
        vocabulary = Vocabulary()
        vocabulary.own, vocabulary.grams = [reader.vocabulary.own[i] for i in used], [reader.vocabulary.grams[i] for i in used]
        self.sizes = np.concatenate([sizes for _, sizes, _ in read] or [np.zeros(0)]).astype(np.int32)
        self.n, self.flat = len(self.sizes), flat.astype(np.int32)
        self.labels = np.zeros((self.n, n_subjects), np.float32)
        at = 0
        for _, sizes, ks in read:
            self.labels[at : at + len(sizes), ks] = 1
            at += len(sizes)
        self.own = np.array(vocabulary.own, np.int32)
        self.gram_sizes = np.array([len(g) for g in vocabulary.grams], np.int32)
        self.grams = np.array([g for gs in vocabulary.grams for g in gs], np.int32)
        self.rows = np.unique(np.concatenate([self.own, self.grams]))  # of the table, that this part has any gradient for

    def gradient(self, table: np.ndarray, out: np.ndarray, bias: np.ndarray, one: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Of the summed logistic losses, for table, outputs and biases; and the loss. one: only the likeliest of the labels is the target."""
        at = lambda sizes: np.cumsum(sizes) - sizes
        vectors = table[self.own] + np.add.reduceat(table[self.grams], at(self.gram_sizes)) / self.gram_sizes[:, None]
        x = np.add.reduceat(vectors[self.flat], at(self.sizes)) / self.sizes[:, None]
        z = x @ out + bias
        y = self.labels
        if one:
            y = np.zeros_like(y)
            y[np.arange(self.n), np.where(self.labels > 0, z, -np.inf).argmax(1)] = 1
            y *= self.labels
        p = 1 / (1 + np.exp(-z))
        d = p - y
        by_word = np.zeros_like(vectors)
        np.add.at(by_word, self.flat, np.repeat((d @ out.T) / self.sizes[:, None], self.sizes, axis=0))
        g = np.zeros_like(table)
        np.add.at(g, self.own, by_word)
        np.add.at(g, self.grams, np.repeat(by_word / self.gram_sizes[:, None], self.gram_sizes, axis=0))
        return g, x.T @ d, d.sum(0), float(-np.log(np.where(y > 0, p, 1 - p) + 1e-9).sum())


class Adam:
    def __init__(self, rate: float):
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def __call__(self, name: str, x: np.ndarray, g: np.ndarray) -> np.ndarray:
        m = self.m[name] = 0.9 * self.m.get(name, 0) + 0.1 * g
        v = self.v[name] = 0.99 * self.v.get(name, 0) + 0.01 * g * g
        return x - self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-8)


def fit(gradients, n_sentences: int, n_subjects: int, steps: int = STEPS, warm_up: int = WARM_UP):
    """gradients(table, out, bias, one) -> those of the partitions; returns the trained (table, out, bias)."""
    rng = np.random.default_rng(0)
    table, out, bias = (x.astype(np.float32) for x in (rng.uniform(-1, 1, (BUCKETS, DIMS)) / DIMS, rng.uniform(-1, 1, (DIMS, n_subjects)), np.full(n_subjects, -2.0)))
    step = Adam(RATE)
    for t in range(steps if n_sentences else 0):
        g = [sum(x) / n_sentences for x in zip(*(g[:3] for g in gradients(table, out, bias, t >= warm_up)))]
        step.t += 1
        table, out, bias = (step(*x).astype(np.float32) for x in (("table", table, g[0] + DECAY * table), ("out", out, g[1]), ("bias", bias, g[2])))
    return table, out, bias


class Scorer:
    def __init__(self, params, quotes: list[list[str]] = []):  # noqa: B006
        self.table, self.out, self.bias = params
        self.quotes = quotes
        self.clear()

    def clear(self) -> None:
        self.reader, self.known = Reader(self.quotes), 0
        self.logits = np.zeros((1024, self.out.shape[1]))

    def outputs(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each sentence the sums of its words' contributions, and its outputs."""
        n = len(self.reader.vocabulary.own)
        if self.known < n:
            if n > len(self.logits):
                self.logits = np.concatenate([self.logits[: self.known], np.zeros((2 * n - self.known, self.out.shape[1]))])
            self.logits[self.known : n] = self.reader.vocabulary.vectors(self.table, self.known) @ self.out
            self.known = n
        sums = np.add.reduceat(self.logits[ids], np.cumsum(sizes) - sizes)
        return sums, 1 / (1 + np.exp(-(sums / sizes[:, None] + self.bias)))

    def subjects(self, texts: list[str], sure: float = SURE, many: int = MANY, share: float = SHARE, close: int = CLOSE) -> list[list[tuple[int, int, float]]]:
        """For each text (subject, sentences that treat it, output for the whole text)."""
        if self.known > MAX_WORDS:
            self.clear()
        read = [self.reader.read(t) for t in texts]
        some = [i for i, (_, sizes) in enumerate(read) if len(sizes)]
        out: list[list[tuple[int, int, float]]] = [[] for _ in texts]
        if not some:
            return out
        sizes = np.concatenate([read[i][1] for i in some])
        sums, by_sentence = self.outputs(np.concatenate([read[i][0] for i in some]), sizes)
        n_sentences = np.array([len(read[i][1]) for i in some])
        starts = np.cumsum(n_sentences) - n_sentences
        whole = 1 / (1 + np.exp(-(np.add.reduceat(sums, starts) / np.add.reduceat(sizes, starts)[:, None] + self.bias)))
        best = np.where(by_sentence.max(1) >= sure, by_sentence.argmax(1), -1)
        n = np.zeros(whole.shape, np.int64)
        at = np.flatnonzero(best >= 0)
        np.add.at(n, (np.repeat(np.arange(len(some)), n_sentences)[at], best[at]), 1)
        often = n >= many
        keep = often & (n >= share * n.sum(1, keepdims=True))
        for d, k in zip(*np.nonzero(often & ~keep)):  # few of all, but maybe close to each other
            places = np.flatnonzero(best[starts[d] : starts[d] + n_sentences[d]] == k)
            keep[d, k] = (places[many - 1 :] - places[: len(places) - many + 1] < close).any()
        for d in np.flatnonzero(~keep.any(1)):
            keep[d, np.lexsort((whole[d], n[d]))[-1]] = True
        for d, k in zip(*np.nonzero(keep)):
            out[some[d]].append((int(k), int(n[d, k]), float(whole[d, k])))
        return out


def quotations(texts: DataFrame | None) -> list[list[str]]:
    """The words of a bounded set of texts (of one column)."""
    return [WORD.findall(r[0].lower()) for r in (texts.where(F.col(texts.columns[0]).isNotNull()).distinct().collect() if texts is not None else [])]


def train(docs: DataFrame, labels: DataFrame, subjects: list[str], key: str = "doc_id", text: str = "text", subject: str = "subject", quotes: list[list[str]] = []):  # noqa: B006
    """The parameters, or None without subjects or labels."""
    if not subjects:
        return None
    sc = docs.sparkSession.sparkContext
    place = F.create_map(*(F.lit(x) for k, s in enumerate(subjects) for x in (s, k)))
    named = labels.where(F.col(subject).isin(subjects)).groupBy(key).agg(F.sort_array(F.collect_set(place[F.col(subject)])).alias("__labels"))
    named = cut(named.orderBy(F.xxhash64(key), key).limit(MAX_LABELLED))
    most = named.count()
    if not most:
        return None
    chosen = docs.select(key, text).where(F.col(text).isNotNull()).join(F.broadcast(named), key).dropDuplicates([key])
    chosen = chosen.select(F.col(text).alias("text"), "__labels")
    n = len(subjects)

    def prepare(batches):
        texts, ks = [], []
        for b in batches:
            texts += b.column(0).to_pylist()
            ks += b.column(1).to_pylist()
        part = Part(texts, ks, n, quotes) if texts else None
        if part and part.n:
            yield pa.RecordBatch.from_pydict({"part": pa.array([pickle.dumps(vars(part))], pa.binary()), "n": pa.array([part.n], pa.int64())})

    parts = cut(chosen.repartition(max(4, -(-most // PER_PART))).mapInArrow(prepare, "part binary, n bigint"))
    total = sum(r.n for r in parts.select("n").collect())

    def gradients(table, out, bias, one):
        sent = sc.broadcast((table, out, bias, one))

        def run(batches):
            for b in batches:
                for blob in b.column(0).to_pylist():
                    part = Part.__new__(Part)
                    vars(part).update(pickle.loads(blob))
                    g, *rest = part.gradient(*sent.value)
                    yield pa.RecordBatch.from_pydict({"g": pa.array([pickle.dumps((part.rows, g[part.rows], *rest))], pa.binary())})

        got = [pickle.loads(r.g) for r in parts.select("part").mapInArrow(run, "g binary").collect()]
        sent.destroy()
        whole = np.zeros_like(table)
        for rows, g, *_ in got:
            whole[rows] += g
        return [(whole, sum(x[2] for x in got), sum(x[3] for x in got))]

    return fit(gradients, total, n) if total else None


def classify(docs: DataFrame, labels: DataFrame, subjects: list[str], key: str = "doc_id", text: str = "text", params=None, quoted: DataFrame | None = None) -> DataFrame:
    """key, subject, sentences, score: the subjects of each document. quoted: texts whose sentences don't count."""
    known = quotations(quoted)
    params = params or train(docs, labels, subjects, key, text, quotes=known)
    sent = docs.sparkSession.sparkContext.broadcast((params, known))

    def make():
        scorer = Scorer(*sent.value) if sent.value[0] else None

        def run(keys, texts):
            out = []
            for i in range(0, len(keys) if scorer else 0, TOGETHER):
                found = scorer.subjects([t or "" for t in texts[i : i + TOGETHER]])
                out += [(k, subjects[j], n, p) for k, ks in zip(keys[i : i + TOGETHER], found) for j, n, p in ks]
            return list(zip(*out)) or [()] * 4

        return run

    return map_lists(spread(docs.select(key, text)), make, f"`{key}` {dict(docs.dtypes)[key]}, subject string, sentences int, score double")
