"""Vectors, near-duplicates, provenance, packing, leaks, subjects."""

import itertools
import random
import re
import time
import tracemalloc
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import leaks, neardups, neighbours, packing, provenance, subjects

WORDS = [f"w{i}" for i in range(400)]
NAMES = ["".join(x) for x in itertools.product("abcdefgh", "aeiou", "klmnr", "aeiou")][::2]

# Nearest vectors


def brute(rows, k):
    keys = [i for i, _ in rows]
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -9)
    return {(keys[i], keys[j]) for i in range(len(keys)) for j in np.argsort(-s[i], kind="stable")[:k]}


def test_neighbours_recall(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 64))
    rows = [(int(i), [float(v) for v in (centres[i % 20] + rng.normal(size=64)).astype(np.float32)]) for i in range(3000)]
    df = spark.createDataFrame(rows, "seq bigint, embedding array<float>")
    got = {(r.key, r.neighbour) for r in neighbours.neighbours(df, probes=2).collect()}
    want = brute(rows, 5)
    assert len(got) == 15_000 and len(got & want) / len(want) >= 0.9
    assert {(r.key, r.neighbour) for r in neighbours.neighbours(df).collect()} == want  # all cells probed


def test_bounds_hold():
    rng = np.random.default_rng(2)
    x, q = neighbours.unit(rng.normal(size=(500, 64))), neighbours.unit(rng.normal(size=(50, 64)))
    centre, turn = x.mean(0), neighbours.rotation(64)
    upper, twice = neighbours.Codes(x, centre, turn).bounds(q, centre, turn)
    true = q @ x.T
    assert (true <= upper + 1e-6).mean() > 0.97 and (true >= upper - twice - 1e-6).mean() > 0.97
    assert abs((upper - twice / 2 - true).mean()) < 0.01


def test_unusable_vectors_ties_and_small_tables(spark):
    v = [1.0] + [0.0] * 63
    rows = [(1, v), (2, v), (2, v), (3, v), (4, None), (5, [0.0] * 64), (6, [float("nan")] * 64), (7, [1.0]), (8, [None] * 64), (9, [float("inf")] + v[1:])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "seq bigint, embedding array<double>, cell string, rank int")
    assert sorted((r.key, r.neighbour, r["rank"]) for r in neighbours.neighbours(df).collect()) == [(1, 2, 1), (1, 3, 2), (2, 1, 1), (2, 3, 2), (3, 1, 1), (3, 2, 2)]
    assert neighbours.neighbours(df.where("seq > 3")).count() == 0
    assert neighbours.neighbours(df, queries=df.where("seq = 1")).count() == 2


def test_products_with_centroids_are_made_in_parts():
    x = neighbours.unit(np.random.default_rng(3).normal(size=(20_000, 16)))
    tracemalloc.start()
    c = neighbours.centroids(x, 1000, rounds=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6  # all products at once are 160 MB
    assert (neighbours.nearest(x[:500], c) == (x[:500] @ c.T).argmax(1)).all()


def test_many_cells_are_fitted_by_executors(spark, monkeypatch):
    for name, value in (("SAMPLE", 500), ("FITTED", 8), ("CELL", 32), ("GROUP", 300), ("HELD", 1000)):
        monkeypatch.setattr(neighbours, name, value, raising=False)
    on_driver, matrix = [], neighbours.matrix
    monkeypatch.setattr(neighbours, "matrix", lambda column: (on_driver.append(len(column)), matrix(column))[1])
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 64))
    rows = [(int(i), [float(v) for v in (centres[i % 20] + rng.normal(size=64)).astype(np.float32)]) for i in range(3000)]
    df = spark.createDataFrame(rows, "seq bigint, embedding array<float>")
    want = brute(rows, 5)
    assert {(r.key, r.neighbour) for r in neighbours.neighbours(df, probes=1000).collect()} == want  # all cells
    assert max(on_driver) <= 500
    got = {(r.key, r.neighbour) for r in neighbours.neighbours(df).collect()}
    assert len(got) == 15_000 and len(got & want) / len(want) >= 0.95


# Near-duplicates


def shingles(text):
    w = re.findall(r"[^\W_]+", text.lower())
    return set(zip(w, w[1:], w[2:]))


def test_near_duplicates(spark, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(40, 90))) for _ in range(150)]
    for t in texts[:60]:
        w = t.split()
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        texts.append(" ".join(w[rng.randint(0, 3) :]).upper())
    texts += [texts[0]] * 5 + ["too short"] * 4 + ["", None, "a " * 60]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(*r, 1, "x") for r in [*rows, rows[0]]], "seq bigint, document string, key int, words string")
    sets = {i: shingles(t) for i, t in rows if t and len(re.findall(r"[^\W_]+", t)) >= 40}
    want = {(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.6 * len(sets[i] | sets[j])}

    def found():
        members, links = neardups.near_pairs(df, "seq", "document")
        of = {}
        for r in members.collect():
            of.setdefault(r.rep, []).append(r.key)
        assert sorted(k for v in of.values() for k in v) == sorted(sets)
        pairs = {tuple(sorted((a, b))) for v in of.values() for a in v for b in v if a < b}
        return pairs | {tuple(sorted((a, b))) for r in links.collect() for a in of[r.rep_a] for b in of[r.rep_b]}

    assert found() == want
    monkeypatch.setattr(neardups, "BLOCK", 1)  # every band is split into blocks
    assert found() == want
    monkeypatch.setattr(neardups, "BLOCK", 16)
    for name, value in (("SAMPLE_OF", 1), ("LARGE_SHARE", 0), ("LARGE_LEAST", 2)):  # most bands count as large
        monkeypatch.setattr(neardups, name, value)
    assert found() == want


def test_many_copies_come_out_in_the_same_form(spark, tmp_path):
    """100 copies: each with the first, ranks up to RANKS apart with each other; one link to another text."""
    from palimpsest.llm import queries

    rng = random.Random(8)
    text = " ".join(rng.choices(WORDS, k=60))
    rows = [(i, text, None) for i in range(100)] + [(100, text + " more", None), (101, " ".join(rng.choices(WORDS, k=60)), None)] + [(102, "in a file " * 20, "f")] * 2
    spark.createDataFrame(rows, "seq bigint, document string, file_path string").write.parquet(f"{tmp_path}/chunks.parquet")
    got = {tuple(r) for r in queries.p5_found(spark, str(tmp_path)).collect()}
    copies = {(a, b) for a in range(100) for b in range(a + 1, 100) if a == 0 or b - a <= queries.RANKS}
    assert got == copies | {(k, 100) for k in range(queries.RANKS + 1)}


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (None, "x " * 90)], "seq bigint, document string")
    members, links = neardups.near_pairs(df, "seq", "document")
    assert members.count() == 0 and links.count() == 0


def test_bit_sliced_comparison():
    rng = np.random.default_rng(4)
    for n in (1, 2, 63, 64, 65, 300):
        rows = np.packbits((rng.random((n, neardups.BITS)) < rng.random((n, 1))).astype(np.uint8), axis=1).view(np.int64)
        far = np.bitwise_count((rows[:, None] ^ rows[None]).view(np.uint64)).sum(2)
        for limit in (0, 17, 42, 64, 127, 128):
            i, j = neardups.close_between(rows, rows, limit)
            assert sorted(zip(i, j)) == sorted(zip(*np.nonzero(far <= limit)))
            sizes = rng.multinomial(n, rng.dirichlet(np.ones(max(1, n // 7))))
            sizes = sizes[sizes > 0]
            group = np.repeat(np.arange(len(sizes)), sizes)
            i, j = neardups.close_within(rows, sizes, limit)
            assert sorted(zip(i, j)) == sorted(zip(*np.nonzero((far <= limit) & (group[:, None] == group[None]) & np.triu(np.ones((n, n), bool), 1))))


# Provenance


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=120))
def test_grammar_gives_the_sequence_back(seq):
    g = provenance.Grammar(seq, 5)
    assert [t for s in g.symbols for t in g.expand(s)] == seq
    left = Counter(zip(g.symbols, g.symbols[1:]))
    assert all(n < 3 for n in left.values())


def own_file(seed):
    rng = random.Random(seed)
    return "\n".join(f"def {rng.choice(NAMES)}_{rng.choice(NAMES)}({rng.choice(NAMES)}, {rng.choice(NAMES)}):\n    {rng.choice(NAMES)} = {rng.choice(NAMES)}.{rng.choice(NAMES)}({rng.choice(NAMES)})\n    return {rng.choice(NAMES)}" for _ in range(25))


def test_provenance(spark):
    lib = own_file(99)
    patched = lib.replace("return", "return not", 2)
    rng = random.Random(1)
    rows = [
        (1, "a", "\n".join(f"exports.Item{i} = __def('item', {i}, {i * 8});" for i in range(80))), (2, "a", "X = [" + ", ".join(hex(rng.randrange(256)) for _ in range(600)) + "]"),
        (3, "a", "B = '" + "".join(rng.choices("ABCDEFGHabcdefgh0123456789+/", k=3000)) + "'"), (4, "b", ";".join(f"a{i}.b(function(c){{for(var d={i};e<f;g++)h+=i.j{i}}})" for i in range(60))),
        (5, "a", lib), (6, "b", "# patched\n" + patched), (7, "c", own_file(7)), (8, "c", own_file(7)), (9, "b", own_file(9)), (10, None, None), (11, "a", ""), (12, "a", "x = 1"), (5, "a", lib),
    ]
    df = spark.createDataFrame([(*r, "k") for r in rows], "file_id bigint, project string, content string, kind string")
    got = {}
    for r in provenance.provenance(df).collect():
        got.setdefault(r.file_id, set()).add(r.kind)
    assert got == {1: {"generated"}, 2: {"data"}, 3: {"data"}, 4: {"minified"}, 5: {"third_party"}, 6: {"third_party"}}
    assert provenance.provenance(df.where("false")).count() == 0


def test_copies_inside_longer_files_and_among_many(spark):
    lib = own_file(50)
    rows = [(i, f"p{i}", own_file(100 + i)) for i in range(20)]  # unrelated
    rows += [(100 + i, "own", own_file(200 + i)) for i in range(30)]
    for i in range(30):  # a whole file in a bundle of twenty, each in another project
        rows.append((200 + i, "bundler", "\n".join([*(own_file(1000 + 20 * i + j) for j in range(10)), own_file(200 + i), *(own_file(1010 + 20 * i + j) for j in range(10))])))
    header = " ".join(f"word{i}" for i in range(60)) + "\n"  # shared by all: its first and last file are no copies
    rows += [(500 + i, f"q{i}", header + (lib if i in (4, 5) else own_file(5000 + i)) + ("\npass" if i == 4 else "")) for i in range(10)]
    got = {r.file_id for r in provenance.provenance(spark.createDataFrame(rows, "file_id bigint, project string, content string")).collect() if r.kind == "third_party"}
    assert got == {*range(100, 130), 504, 505}


def test_copies_in_slices_that_leave_no_files_behind(spark, monkeypatch):
    for name, value in (("SLICED", 1), ("PAIRS", 0), ("LEAST_PAIRS", 5), ("MOST", 3)):
        monkeypatch.setattr(provenance, name, value, raising=False)
    rows = [(i, f"p{i}", own_file(3000 + i)) for i in range(150)] + [(500 + i, "own", own_file(200 + i)) for i in range(20)]
    rows += [(700 + i, "other", "\n".join([own_file(200 + i), *(own_file(1000 + 5 * i + j) for j in range(5))])) for i in range(20)]
    texts = sum(len(r[2]) for r in rows)
    df = spark.createDataFrame(rows, "file_id bigint, project string, content string").repartition(4).checkpoint()
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    folder = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))

    def disk():
        files = blocks.getAllFiles()
        shuffled = [Path(files.apply(i).getPath()) for i in range(files.size())]
        return sum(f.stat().st_size for f in [*shuffled, *folder.rglob("*")] if f.is_file())

    before = disk()
    found = provenance.provenance(df)
    for _ in range(20):  # shuffle files are removed in the background
        if disk() - before < texts / 4:
            break
        time.sleep(0.5)
    assert disk() - before < texts / 4
    assert {r.file_id for r in found.collect() if r.kind == "third_party"} == set(range(500, 520))


def test_places_as_gaps():
    places = provenance.windows(own_file(3))[3]
    assert len(places) > 50 and provenance.from_gaps(provenance.gaps(places)) == places and provenance.from_gaps(provenance.gaps([])) == []


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=80), st.lists(st.integers(0, 30), max_size=400), st.lists(st.integers(0, 3), min_size=24, max_size=24))
def test_every_common_run_holds_a_common_window(left, right, run):
    a, b = (provenance.windows(" ".join(f"w{chr(97 + t)}" for t in x))[2] for x in (left + run, right + run + left))
    assert set(a) & set(b)


# Packing


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=40))
def test_plan_places_every_item(counts):
    fill, ranks = Counter(), Counter()
    for length, first, n, container in packing.plan(counts, 64):
        assert first == ranks[length]
        ranks[length] += n
        for i in range(n):
            fill[container + i] += length
    assert ranks == Counter(counts) and all(v <= 64 for v in fill.values())
    assert len(fill) < 2 or sum(sorted(fill.values())[:2]) > 64  # a container is opened only for what fits in no other


def test_containers(spark):
    rng = random.Random(2)
    rows = [(i, "a " * rng.choice([5, 5, 5, rng.randint(1, 500), 1024])) for i in range(400)] + [(1000, "b, " * 1500), (1001, None), (1002, ""), (1003, "   "), (1004, "c " * 1025), (1005, "é_1 ± 😀")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, salt int, length int")
    got = packing.assign(df).collect()
    fill = Counter()
    for r in got:
        if r.length:
            fill[r.container_id] += r.length
        else:
            assert r.container_id is None
    tokens = {i: len(re.findall(r"\w+|[^\w\s]+", t or "")) for i, t in rows}
    assert {r.doc_id: r.n_tokens for r in got} == tokens and max(fill.values()) <= 1024
    assert Counter(r.doc_id for r in got)[1000] == 3 and Counter(r.doc_id for r in got)[1004] == 2 and Counter(r.doc_id for r in got)[3] == 1
    assert sum(fill.values()) == sum(tokens.values()) and len(fill) <= 1.05 * sum(tokens.values()) / 1024 + 2
    assert packing.assign(df.where("false")).count() == 0


def test_one_length_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 7)
    df = spark.createDataFrame([(i, "a " * (1024 if i % 2 else 300)) for i in range(200)], "doc_id bigint, text string")
    got = packing.assign(df).collect()
    fill = Counter()
    for r in got:
        fill[r.container_id] += r.length
    assert len(got) == 200 and max(fill.values()) <= 1024 and len(fill) == 100 + 34


# Leaks


def test_leaks(spark):
    rng = random.Random(6)
    items = [(i, " ".join(rng.choices(WORDS, k=40)), "w1 w2" if i % 2 else None) for i in range(60)] + [(90, "the " * 30, None), (91, "too short", None), (92, None, None)]
    docs = []
    for i in range(300):
        w = rng.choices(WORDS, k=200)
        if i % 3 == 0:
            p = items[rng.randrange(60)][1].split()
            n = rng.choice([10, 11, 12, 13, 40])
            at = rng.randint(0, 40 - n)
            w[50:50] = p[at : at + n]
        docs.append((i, ", ".join(w).title()))
    docs += [(900, None), (901, ""), (902, "The the THE " * 10), (0, docs[0][1])]
    windows = {}
    for i, p, _ in items:
        w = leaks.words(p)
        for j in range(len(w) - 11):
            windows.setdefault(tuple(w[j : j + 12]), set()).add(i)
    want = {(d, i) for d, t in docs for w in [leaks.words(t)] for j in range(len(w) - 11) for i in windows.get(tuple(w[j : j + 12]), ())}
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, item_id int")
    ev = spark.createDataFrame(items, "item_id bigint, passage string, answer string")
    got = leaks.leaks(df, ev).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and (902, 90) in want
    assert all(r.shared_words >= 12 for r in got)
    assert leaks.leaks(df, ev.where("false")).count() == 0 and leaks.leaks(df.where("false"), ev).count() == 0


def test_items_in_parts(spark, monkeypatch):
    """More items than one part holds: the same rows; the answer must stand near the quotation."""
    rng = random.Random(9)
    items = [(i, " ".join(rng.choices(WORDS, k=30)), "blue moon" if i < 3 else None) for i in range(20)]
    docs = [(i, f"{' '.join(rng.choices(WORDS, k=100))} {items[i][1]} {'so the blue moon rose' if i == 0 else ''} {' '.join(rng.choices(WORDS, k=100))} {'blue moon' if i == 1 else ''}") for i in range(20)]
    df, ev = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, passage string, answer string")
    whole = sorted(tuple(r) for r in leaks.leaks(df, ev).collect())
    assert [r[:2] for r in whole] == [(i, i) for i in range(20)] and [r[3] for r in whole[:4]] == [True, False, False, None]
    monkeypatch.setattr(leaks, "MAX_ITEMS", 3)
    monkeypatch.setattr(leaks, "SCORED", 2)
    assert sorted(tuple(r) for r in leaks.leaks(df, ev).collect()) == whole


# Subjects


def test_subjects_on_held_out_documents(spark):
    rng = random.Random(8)
    names = ["art", "law", "sea"]
    topical = {n: [f"{n}{w}" for w in WORDS[:30]] for n in names}

    def doc(of):
        return " ".join(" ".join(rng.choices(topical[n], k=4) + rng.choices(WORDS, k=4)) + "." for n in of for _ in range(6))

    truth = {i: rng.sample(names, rng.choice([1, 1, 2])) for i in range(240)}
    docs = [(i, doc(of)) for i, of in truth.items()] + [(900, None), (901, "...")]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, subject string")
    labels = spark.createDataFrame([(i, n) for i in range(120) for n in truth[i]] + [(5, truth[5][0]), (7777, "art"), (3, "unknown")], "doc_id bigint, subject string")
    got = {}
    for r in subjects.classify(df, labels, names).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    right = sum(got[i] == set(truth[i]) for i in range(120, 240))
    assert right >= 0.9 * 120 and 900 not in got and 901 not in got
    assert subjects.classify(df, labels.where("false"), names).count() == 0
    assert subjects.classify(df.where("false"), labels, names).count() == 0
    assert subjects.classify(df, labels, []).count() == 0


def test_gradient_is_that_of_the_loss():
    part = subjects.Part(["red cat. blue dog", "red dog"], [[0], [1]], 2)
    rng = np.random.default_rng(0)
    table, out, bias = rng.normal(size=(subjects.BUCKETS, subjects.DIMS)), rng.normal(size=(subjects.DIMS, 2)), np.zeros(2)
    g, go, gb, loss = part.gradient(table, out, bias, False)
    at = int(np.abs(g).sum(1).argmax())
    for x, grad, i in ((table, g, (at, 3)), (out, go, (2, 1)), (bias, gb, (0,))):
        old = x[i]
        x[i] = old + 1e-4
        more = part.gradient(table, out, bias, False)[3]
        x[i] = old - 1e-4
        less = part.gradient(table, out, bias, False)[3]
        x[i] = old
        assert abs((more - less) / 2e-4 - grad[i]) < 1e-3
