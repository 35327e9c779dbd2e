import math

import numpy as np
import pytest

from livgrid.llm import embedding_dedup as E
from livgrid.llm.hnsw import Hnsw
from livgrid.llm.storage import Work

SCHEMA = "vec_id long, embedding array<float>, label int, node string"


def clusters(seed, sizes, dim=16, spread=0.05):
    rng = np.random.default_rng(seed)
    out = []
    for label, size in enumerate(sizes):
        centre = rng.normal(size=(max(1, size // 12), dim))
        own = centre[rng.integers(0, len(centre), size)]
        out += [(label % 3, x) for x in own + rng.normal(size=own.shape) * spread * rng.integers(0, 6, (size, 1))]
    order = rng.permutation(len(out))
    return [(i * 2, [float(x) for x in out[j][1].astype(np.float32)], out[j][0]) for i, j in enumerate(order)]


def plain(rows, least=0.93):
    up = {r[0]: r[0] for r in rows}
    n = dict.fromkeys(up, 0)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x, p) in enumerate(rows):
        for b, y, q in rows[i + 1 :]:
            if p == q and np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y)) >= least:
                n[a] += 1
                n[b] += 1
                s, t = sorted((find(a), find(b)))
                up[t] = s
    return {i: (n[i], find(i)) for i in up}


@pytest.mark.parametrize(("shard", "queries"), [(8192, 32768), (60, 32768), (60, 70)])
def test_links_equal_comparing_all_pairs(spark, shard, queries, monkeypatch):
    monkeypatch.setattr(E, "SHARD", shard)
    monkeypatch.setattr(E, "QUERIES", queries)
    rows = clusters(1, (150, 90, 40, 60))
    rows += [(10_001, rows[0][1], rows[0][2]), (10_003, rows[0][1], rows[0][2]), (10_005, [2 * x for x in rows[0][1]], rows[0][2])]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = E.links(df, Work(spark, "t"), 0.93).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == plain(rows)
    assert len(got) == len(rows) and all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_shards_without_vectors(spark, monkeypatch):
    monkeypatch.setattr(E, "SHARD", 1)
    monkeypatch.setattr(E, "QUERIES", 3)
    rows = clusters(2, (12,))
    got = E.links(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA), Work(spark, "t")).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == plain(rows)


def test_vectors_that_link_with_nothing(spark):
    ok = [1.0, 2.0, 3.0]
    rows = [(1, ok, 0), (2, ok, None), (3, None, 0), (4, [0.0] * 3, 0), (5, [1.0, None, 3.0], 0), (6, [1.0, math.nan, 3.0], 0), (7, [1.0, math.inf, 3.0], 0), (8, [], 0), (None, ok, 0), (9, ok, 1), (10, [1.0, 2.0], 0), (1, ok, 0), (12, ok, 0)]
    got = E.links(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA), Work(spark, "t")).collect()
    assert len(got) == len(rows)
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got if r["vec_id"] in (1, 12)) == [(1, 2, 1), (1, 2, 1), (12, 2, 1)]
    assert all(r["n_links"] == 0 and r["component_id"] == r["vec_id"] and r["kept"] for r in got if r["vec_id"] not in (1, 12))
    assert E.links(spark.createDataFrame([], SCHEMA), Work(spark, "t")).count() == 0


def test_recall_of_the_graph():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    graph = Hnsw(x, np.arange(3000))
    hit = sum(len(set(np.argsort(-(x @ x[i]))[:10].tolist()) & {j for _, j in graph._layer(x[i], graph._down(x[i], 0), 64, 0)[:10]}) for i in range(0, 3000, 30))
    assert hit / 1000 >= 0.9


def test_audits_widen_the_beam_until_recall_is_met(monkeypatch):
    monkeypatch.setattr(E, "BEAM", 1)
    rows = clusters(5, (400,), spread=0.02)
    ids, raw = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    shard = E.Shard(ids, raw, np.ones(len(ids), np.int64), 0.93)
    found = shard.ask(ids, raw)
    unit = raw / np.linalg.norm(raw, axis=1)[:, None]
    true = (unit @ unit.T >= 0.93).sum() - len(ids)
    assert sum(map(len, found)) >= 0.97 * true and shard.recalls[-1] >= E.LEAST_RECALL
