import random
import re

import numpy as np
import pytest

from livgrid.llm import components as C
from livgrid.llm import jaccard_join as J
from livgrid.llm.components import components
from livgrid.llm.storage import Work


def shingles(text, k=4):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def plain(rows, k=4, percent=85):
    """doc_id -> (set size, component), by comparing all pairs."""
    sets = {i: shingles(t, k) for i, t in rows if i is not None}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        p = rng.randrange(len(words))
        match rng.randrange(3):
            case 0:
                words[p] = f"e{rng.randrange(10**6)}"
            case 1:
                words.insert(p, f"i{rng.randrange(10**6)}")
            case _ if len(words) > 1:
                del words[p]
    return words


def corpus(seed, bases, copies, lengths):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    out = []
    for _ in range(bases):
        words = [rng.choice(vocabulary) for _ in range(rng.choice(lengths))]
        if rng.random() < 0.5:
            words = words[: len(words) // 2] + passage + words[len(words) // 2 :]
        out.append(words)
        for _ in range(rng.randrange(copies)):
            out.append(edited(rng, rng.choice(out[-3:]), rng.randrange(1 + len(words) // 40 + 1)))
    rng.shuffle(out)
    return [(i, " ".join(w)) for i, w in enumerate(out)]


@pytest.mark.parametrize(("seed", "bases", "copies", "lengths"), [(1, 60, 6, (4, 7, 9, 12, 15, 18)), (2, 40, 6, (20, 30, 60, 90)), (3, 15, 8, (150, 400)), (4, 3, 120, (60, 150))])
def test_components_equal_comparing_all_pairs(spark, seed, bases, copies, lengths, monkeypatch):
    monkeypatch.setattr(J, "STAR", 7)
    monkeypatch.setattr(J, "BLOCK", 16)
    rows = corpus(seed, bases, copies, lengths)
    rows += [(10_000, None), (10_001, ""), (10_002, "  "), (10_003, rows[0][1].upper()), (10_004, "one two"), (10_005, "One  two"), (10_006, "one")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, d string, component_id int")
    got = J.join(df, Work(spark, "t")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == plain(rows) and len(got) == len(rows)


def test_repeated_rows_null_ids_and_no_rows(spark):
    text = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(5, text), (5, text), (7, text + " x"), (None, text), (None, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in J.join(df, Work(spark, "t")).collect())
    assert got == [(-1, -1), (-1, -1), (5, 5), (5, 5), (7, 5)]
    assert J.join(df.limit(0), Work(spark, "t")).count() == 0


def test_linking_sets_share_a_key():
    rng = np.random.default_rng(0)
    measure = J.Measure()
    for boundary in (5, 8, 13):
        for size in [*range(1, 40), 77, 150, 333]:
            for _ in range(6):
                a = rng.integers(1, 1 << 62, size, dtype=np.uint64)
                drop = int(rng.integers(0, measure.deletions(size) + 1))
                most = max(x for x in range(size) if 100 * (size - drop) >= 85 * (size + x)) if 100 * (size - drop) >= 85 * size else -1
                if most < 0:
                    continue
                b = np.concatenate([a[drop:], rng.integers(1, 1 << 62, most, dtype=np.uint64)])
                key, owner = J.list_keys(measure, boundary, np.concatenate([np.sort(a), np.sort(b)]), np.array([0, len(a), len(a) + len(b)]))
                assert set(key[owner == 0].tolist()) & set(key[owner == 1].tolist()), (boundary, size, drop, most)


@pytest.mark.parametrize("task", [250_000, 40])
def test_components(spark, task, monkeypatch):
    monkeypatch.setattr(C, "TASK_PAIRS", task)
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000 + rng.randrange(300), 1000 + rng.randrange(300)) for _ in range(200)] + [(5000, x) for x in range(5001, 5300)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = {r["node"]: r["component"] for r in components(df, Work(spark, "t")).collect()}
    assert got == {x: find(x) for x in up if find(x) != x}
    assert components(df.limit(0), Work(spark, "t")).count() == 0


def test_outlines_never_rule_out_a_link():
    rng = np.random.default_rng(2)
    for percent in (80, 85):
        measure = J.Measure(5, percent)
        for size in (1, 2, 5, 9, 40, 63, 64, 65, 127, 130, 500, 1025):
            a = np.unique(rng.integers(1, 1 << 62, size, dtype=np.uint64))
            for drop in range(measure.deletions(size) + 1):
                more = max((x for x in range(size) if 100 * (size - drop) >= percent * (size + x)), default=-1)
                if more < 0:
                    continue
                b = np.concatenate([a[drop:], rng.integers(1, 1 << 62, more, dtype=np.uint64)])
                assert J.may_link(measure, [J.outline(a), J.outline(b)], [1, 2]).all()
                assert not J.may_link(measure, [J.outline(a), J.outline(b)], [1, 1]).any()
    far = [J.outline(rng.integers(1, 1 << 62, 600, dtype=np.uint64)) for _ in range(50)]
    assert not J.may_link(J.Measure(5, 80), far, list(range(50))).any()


def test_long_texts_and_rows_that_share_an_id(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 8)
    rng = random.Random(12)
    long = [f"w{rng.randrange(10**6)}" for _ in range(60_000)]
    rows = [(i, " ".join(long[: 60_000 - 300 * i])) for i in range(6)] + [(10 + i, " ".join(f"v{rng.randrange(10**6)}" for _ in range(30_000))) for i in range(3)]
    rows += [(20, "a b c d e f g"), (20, "other words of the same id here"), (21, "other words of the same id here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in J.join(df, Work(spark, "t")).collect()}
    assert all(c == (0 if i < 6 else 20 if i >= 20 else i) for (i, _), c in got.items())
    groups = {}
    for r in J.grouped(df, Work(spark, "t")).collect():
        groups.setdefault(r["component"], set()).add((r["doc_id"], r["n_shingles"]))
    assert sorted(sorted(g) for g in groups.values() if any(i >= 20 for i, _ in g)) == [[(20, 4)], [(20, 4), (21, 4)]] and len(groups) == 6
