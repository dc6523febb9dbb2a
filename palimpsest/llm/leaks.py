"""Problem 9: passages of held-out items inside the corpus.

The items make a BM25 inverted index whose terms are pairs of neighbouring words (single words are too common to tell
passages apart) and whose postings carry the exact contribution of a term to an item; items are grouped into blocks
that keep the maximum per term (block-max). Every window of `SPAN` words of every document is a query:
windows whose sum of term maxima stays under every item's threshold are skipped, then blocks, then items (WAND on
whole texts, in vectors). An item's threshold is the least score that any of its own windows of `SPAN` words has as a
query, so no shared window can be missed. What is left is verified word by word, and the answer is looked for among the
words of the quoted stretch and NEAR words before and after it.

Defined results: null texts and passages give nothing, nor do passages under SPAN words; repeated rows repeat; a null
answer gives a null answer_found. Items are indexed and broadcast in parts of about MAX_ITEMS, and the documents are
searched with each part.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.batches import map_lists

SPAN, BLOCK, MAX_ITEMS, NEAR = 12, 16, 20_000, 50
#: Windows that are scored at a time, so a matrix has so many rows and a column for each item of a part at most.
SCORED = 256
K1, B = 1.2, 0.75
WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class Postings:
    """For each term the sorted groups (items or blocks of items) that hold it, with the largest score in the group."""

    def __init__(self, terms: np.ndarray, group: np.ndarray, score: np.ndarray, n_terms: int):
        order = np.lexsort((group, terms))
        terms, group, score = terms[order], group[order], score[order]
        first = np.flatnonzero(np.r_[True, (np.diff(terms) > 0) | (np.diff(group) > 0)]) if len(terms) else np.zeros(0, int)
        self.group = group[first]
        self.score = np.maximum.reduceat(score, first) if len(first) else np.zeros(0)
        self.start = np.searchsorted(terms[first], np.arange(n_terms + 2))

    def dense(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The groups that hold any of the terms, and their scores, a row for each term."""
        sizes = self.start[terms + 1] - self.start[terms]
        row = np.repeat(np.arange(len(terms)), sizes)
        at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.start[terms], sizes)
        groups, col = np.unique(self.group[at], return_inverse=True)
        out = np.zeros((len(terms), len(groups)))
        out[row, col] = self.score[at]
        return groups, out


class Index:
    """BM25 index of the items, for queries that are windows of `span` words."""

    def __init__(self, items: list[tuple[int, str, str | None]], span: int = SPAN, block: int = BLOCK):
        self.span = span
        rows = [(i, w, a) for i, p, a in items if len(w := words(p)) >= span]
        self.ids = [i for i, *_ in rows]
        self.words = [w for _, w, _ in rows]
        self.answers = [a for *_, a in rows]
        self.word = {t: k for k, t in enumerate(dict.fromkeys(t for w in self.words for t in w), 1)}  # 0: in no item
        own = [self.pairs(w) for w in self.words]
        self.codes = np.unique(np.concatenate(own)) if own else np.zeros(0, np.int64)
        own = [self.terms(w) for w in self.words]
        n, mean = len(rows), (sum(map(len, own)) / len(rows)) if rows else 1.0
        holds = np.bincount(np.concatenate([np.unique(o) for o in own]), minlength=len(self.codes) + 1) if own else np.zeros(1)
        idf = np.log(1 + (n - holds + 0.5) / (holds + 0.5))
        rows_, items_, scores_, least = [], [], [], []
        for k, o in enumerate(own):
            terms, at, tf = np.unique(o, return_inverse=True, return_counts=True)
            score = idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(o) / mean))
            rows_.append(terms), items_.append(np.full(len(terms), k)), scores_.append(score)
            least.append(self.sums(score[at][:, None])[:, 0].min() - 1e-6)  # sums in another order differ in the last digits
        self.least = np.array(least)
        terms, item, score = (np.concatenate(x) if x else np.zeros(0, int) for x in (rows_, items_, scores_))
        self.items = Postings(terms, item, score, len(self.codes))
        self.blocks = Postings(terms, item // block, score, len(self.codes))
        self.block = block
        self.block_least = np.minimum.reduceat(self.least, np.arange(0, n, block)) if n else np.zeros(0)
        self.max = np.zeros(len(self.codes) + 1)
        np.maximum.at(self.max, terms, score)
        self.min_least = self.least.min() if n else np.inf
        self.windows: dict[tuple[str, ...], list[int]] = {}
        for k, w in enumerate(self.words):
            for j in range(len(w) - span + 1):
                self.windows.setdefault(tuple(w[j : j + span]), []).append(k)

    def pairs(self, w: list[str]) -> np.ndarray:
        get = self.word.get
        ids = np.fromiter((get(t, 0) for t in w), np.int64, len(w))
        return np.where((ids[:-1] > 0) & (ids[1:] > 0), ids[:-1] * (len(self.word) + 1) + ids[1:], 0)

    def terms(self, w: list[str]) -> np.ndarray:
        """The pairs' places in the index, 0 for what no item has."""
        out = np.zeros(max(0, len(w) - 1), np.int64)
        if len(self.codes) and len(w) > 1:
            codes = self.pairs(w)
            some = np.flatnonzero(codes)
            at = np.minimum(np.searchsorted(self.codes, codes[some]), len(self.codes) - 1)
            out[some] = np.where(self.codes[at] == codes[some], at + 1, 0)
        return out

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Of each window of `span` words, so of span - 1 pairs."""
        c = np.zeros((len(values) + 1, values.shape[1]))
        np.cumsum(values, 0, out=c[1:])
        return c[self.span - 1 :] - c[: 1 - self.span]

    def retrieve(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """(window, item) with a score of at least the item's threshold; ids: the document's terms."""
        if len(ids) < self.span - 1 or not ids.any() or not self.ids:
            return []
        known = np.flatnonzero(self.sums(self.max[ids][:, None])[:, 0] >= self.min_least)
        if not len(known):
            return []
        out = []
        # Runs of windows that are left, each scored by blocks and then by items.
        runs = (run[i : i + SCORED] for run in np.split(known, np.flatnonzero(np.diff(known) > 1) + 1) for i in range(0, len(run), SCORED))
        for run in runs:
            part = ids[run[0] : run[-1] + self.span - 1]
            at, dense = self.blocks.dense(part)
            blocks = at[(self.sums(dense) >= self.block_least[at]).any(0)]
            if len(blocks):
                at, dense = self.items.dense(part)
                keep = np.isin(at // self.block, blocks)
                at, dense = at[keep], dense[:, keep]
                out += [(int(run[0] + w), int(at[i])) for w, i in zip(*np.nonzero(self.sums(dense) >= self.least[at]))]
        return out

    def search(self, text: str) -> list[tuple[int, int, bool | None]]:
        """(item, longest shared run of words, whether the answer stands near it) of each item that the text quotes."""
        w = words(text)
        found = self.retrieve(self.terms(w))
        got: dict[int, set[int]] = {}
        for at, k in found:
            if k in self.windows.get(tuple(w[at : at + self.span]), ()):
                got.setdefault(k, set()).add(at)
        out = []
        for k, at in got.items():
            longest = run = 0
            for a in sorted(at):
                run = run + 1 if a - 1 in at else 1
                longest = max(longest, run)
            answer = words(self.answers[k])
            near = f" {' '.join(w[max(0, min(at) - NEAR) : max(at) + self.span + NEAR])} "
            out.append((self.ids[k], longest + self.span - 1, f" {' '.join(answer)} " in near if answer else None))
        return out


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", passage: str = "passage", answer: str = "answer", span: int = SPAN) -> DataFrame:
    """key, item_key, shared_words, answer_found: one row per document and item of which it has `span` consecutive words."""
    items = items.select(item_key, passage, answer)
    parts = -(-max(1, items.count()) // MAX_ITEMS)
    kind = dict(docs.dtypes)[key]

    def searched(part: DataFrame) -> DataFrame:
        index = docs.sparkSession.sparkContext.broadcast(Index([tuple(r) for r in part.collect()], span))

        def make():
            ix = index.value

            def run(keys, texts):
                out = [(k, *hit) for k, t in zip(keys, texts) if t for hit in ix.search(t)]
                return list(zip(*out)) or [(), (), (), ()]

            return run

        return map_lists(docs.select(key, text), make, f"`{key}` {kind}, `{item_key}` {dict(items.dtypes)[item_key]}, shared_words int, answer_found boolean")

    own = F.pmod(F.xxhash64(item_key, passage), F.lit(parts))
    return reduce(DataFrame.unionByName, (searched(items.where(own == k) if parts > 1 else items) for k in range(parts)))
