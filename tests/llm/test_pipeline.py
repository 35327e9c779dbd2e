import re

import public_tokenizers as P
import pytest
import tiktoken
from test_decontaminate import shingles as plain_shingles
from test_decontaminate import words
from test_jaccard_join import plain as plain_components
from test_pii import plain_spans
from test_toxicity import plain_score

import __spark_entry__ as entry
import corpus_pipeline as C
from livgrid.llm import bpe, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in texts], SCHEMA)


def kept(rows):
    return sorted((r["doc_id"], r["text"]) for r in rows)


ODD = [(900, None), (901, ""), (902, " \n")]


def test_registered():
    assert entry.queries()["pipeline"] is C.run and [n for n, _ in C.STAGES][0] == "toxicity"


def test_near_copies_equal_comparing_all_pairs(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()][:120]
    base = " ".join(f"w{i}" for i in range(100))
    rows += [(1000, base), (1001, base + " more words here"), (1002, base.replace("w50", "x")), (1003, base), *ODD]
    out = C.drop_near_copies(spark, frame(spark, rows), sf)
    component = plain_components(rows, 5, 80)
    assert out.columns == C.COLUMNS
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(i for i, _ in rows if component[i][1] == i)


def test_near_copies_of_repeated_rows(spark, sf):
    df = frame(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")]).union(spark.createDataFrame([(None, "a b c d e f", None, None, None, None)], SCHEMA))
    assert sorted((r["doc_id"] or 0) for r in C.drop_near_copies(spark, df, sf).collect()) == [0, 1]


def test_rows_that_share_an_id(spark, sf):
    a, b, c, d = (" ".join(f"{k}{i}" for i in range(30)) for k in "abcd")
    rows = [(1, a), (1, b), (2, c), (3, c), (3, d), (3, d), (4, b + " x"), (5, None), (5, None)]
    for parts in (1, 7):
        out = [(r["doc_id"], r["text"]) for r in C.drop_near_copies(spark, frame(spark, rows).repartition(parts), sf).collect()]
        assert sorted(out, key=str) == sorted([(1, a), (1, b), (2, c), (3, d), (5, None), (5, None)], key=str)


def test_many_near_copies_in_one_group(spark, sf):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base) if i % 2 else " ".join([*base, f"x{i}"])) for i in range(5000)] + [(9000 + i, f"own {i} text that is like no other {i * i}") for i in range(50)]
    out = C.drop_near_copies(spark, frame(spark, rows), sf)
    assert sorted(r["doc_id"] for r in out.collect()) == [0, *range(9000, 9050)]


def test_benchmark_equals_plain_search(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    own = [plain_shingles(words(t), 5) for t in items]
    clean = [(i, t) for i, t in docs if not any(len(o & plain_shingles(words(t), 5)) * 100 >= 80 * len(o) for o in own)]
    out = C.drop_benchmark(spark, frame(spark, docs + ODD), sf).collect()
    assert len(clean) < len(docs) and kept(r for r in out if r["doc_id"] < 900) == sorted(clean) and len(out) == len(clean) + 3


def test_toxic_go_and_others_stay(spark, sf):
    rows = [(2000, "you idiot, you stupid moron, worthless scum"), (2001, "a calm and friendly note about rivers"), *ODD]
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = {r["doc_id"] for r in C.drop_toxic(spark, frame(spark, docs + rows), sf).collect()}
    assert 2000 not in out and {2001, 900, 901, 902} <= out
    benign = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").filter("toxic = 0").collect()}
    assert len(benign - out) <= 0.02 * len(benign)


def test_toxicity_equals_a_plain_scorer(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    df = frame(spark, docs + ODD)
    lexicon = toxicity.learn(df, spark.read.parquet(f"{sf}/labels.parquet"))
    out = C.drop_toxic(spark, df, sf).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(i for i, t in docs + ODD if plain_score(t, lexicon) < 0.5)


def test_personal_data_equals_a_plain_version(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    changed = 0
    for r in C.replace_pii(spark, frame(spark, list(docs.items()) + ODD), sf).collect():
        old = docs.get(r["doc_id"])
        if r["doc_id"] >= 900:
            assert r["text"] == dict(ODD)[r["doc_id"]]
            continue
        pieces, at = [], 0
        for a, b, _ in plain_spans(old):
            pieces.append(re.escape(old[at:a]))
            at = b
        # what stands between the entities stays, and the entities don't
        m = re.fullmatch("(.+?)".join([*pieces, re.escape(old[at:])]), r["text"], re.S)
        assert m and r["n_chars"] == len(r["text"]) and all(old[a:b] not in m.groups() for a, b, _ in plain_spans(old))
        changed += bool(pieces)
    assert changed


def test_personal_data_and_tokens(spark, sf):
    rows = [(1, "write to a.b@c.org now"), (2, "nothing"), *ODD]
    df = C.replace_pii(spark, frame(spark, rows), sf)
    out = {r["doc_id"]: r for r in df.collect()}
    assert re.fullmatch(r"write to [a-z]\.[a-z]@[a-z]{10}\.example now", out[1]["text"]) and out[1]["n_chars"] == len(out[1]["text"])
    assert df.columns == C.COLUMNS and out[2]["text"] == "nothing" and out[900]["text"] is None
    ranks = bpe.read_ranks(P.path(C.VOCABULARY))
    real = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in C.encode(spark, df, sf).collect():
        assert r["ids"] == real.encode_ordinary(out[r["doc_id"]]["text"] or "") and r["n_tokens"] == len(r["ids"]) and r["intact"]


@pytest.mark.parametrize("k", range(5))
def test_stages_take_an_empty_table(spark, sf, k):
    assert C.STAGES[k][1](spark, frame(spark, [(1, "x")]).limit(0), sf).count() == 0


def test_run(spark, sf):
    out = C.run(spark, sf)
    rows = out.collect()
    ids = [r["doc_id"] for r in rows]
    assert 0 < len(ids) == len(set(ids)) < 200 and all(r["intact"] for r in rows)
