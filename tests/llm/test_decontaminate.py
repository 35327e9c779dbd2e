import random
import re

import pytest

from livgrid.llm import decontaminate as D


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def shingles(w, k):
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def plain(docs, items):
    out = []
    for i, t in docs:
        for j, b in items:
            w = words(b)
            if not w:
                continue
            k = min(5, len(w))
            own = shingles(w, k)
            common = len(own & shingles(words(t), k))
            if 100 * common >= 80 * len(own):
                out.append((i, j, common, len(own)))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "ß"]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(text(rng.choice((6, 10, 25, 40, 90))))) for i in range(25)] + [(100, "Two Words"), (101, None), (102, ""), (103, "a b c d"), (25, "x y z x y z x y z x")]
    docs = []
    for i in range(120):
        body = text(rng.choice((0, 3, 50, 400, 3000)))
        for _ in range(rng.randrange(3)):
            part = words(rng.choice(items)[1])
            for _ in range(rng.choice((0, 0, 1, 2))):
                if part:
                    part[rng.randrange(len(part))] = "edit"
            at = rng.randrange(len(body) + 1)
            if rng.random() < 0.3:  # in two pieces
                body = part[: len(part) // 2] + body[:at] + [w.upper() for w in part[len(part) // 2 :]] + body[at:]
            else:
                body = body[:at] + part + body[at:]
        docs.append((i, rng.choice((" ", "\n", "  ")).join(body)))
    return [*docs, (500, None), (501, ""), (502, items[0][1]), (502, items[0][1]), (None, items[1][1])], items


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("block", [1_000_000, 150])
def test_pairs_equal_comparing_everything(spark, seed, block, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_SHINGLES", block)
    docs, items = corpus(seed)
    a = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, D.contained(a, b).collect()), key=str)
    assert got == plain(docs, items)
    dirty = {p[0] for p in got if p[0] is not None}
    kept = D.clean(a, b).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted(d for d in docs if d[0] is not None and d[0] not in dirty)


def test_empty_tables(spark):
    a = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contained(a, none).count() == 0 and D.clean(a, none).count() == 1 and D.contained(a.limit(0), none).count() == 0


def test_sketch_never_misses():
    for n in range(1, 600):
        assert sum(1 for _ in range(D.sketch_size(n, 80))) >= min(n, n - -(-80 * n // 100) + 1)
