import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from livgrid.llm import passage_dedup as P
from livgrid.llm import queries, wordhash
from livgrid.llm.storage import Work

SCHEMA = "doc_id long, text string"


def kept_words(words, spans):
    """The words that no span of word numbers holds."""
    gone = {k for a, b in spans for k in range(a, b)}
    return [x for k, x in enumerate(words) if k not in gone]


def plain(rows, line_words=1, passages=True):
    """(doc_id, text) -> the words that are left: units and lines one after the other in the order of ranks, digests as tuples of words."""
    ranked = sorted({(i, t or "") for i, t in rows if i is not None}, key=lambda r: (r[0], queries_hash(r[1])))
    seen, out = set(), {}
    for i, text in ranked:
        w = wordhash.words(*wordhash.text_buffer(pa.array([text])))
        words = text.lower().split() if text.isascii() else [x for x in "".join(c.lower() if c.isascii() else c for c in text).replace("\n", " ").replace("\t", " ").split(" ") if x]
        at, late, spans = 0, [], []
        for line in text.split("\n"):
            n = len(P.wordhash.words(*wordhash.text_buffer(pa.array([line]))).hash)
            if n >= line_words and n:
                if (k := ("line", *words[at : at + n])) in seen:
                    spans.append((at, at + n))
                seen.add(k)
            at += n
        if passages:
            _, _, start, n = P.units(w)
            for a, m in zip(start.tolist(), n.tolist(), strict=True):
                if (k := ("unit", *words[a : a + m])) in seen:
                    late.append((a, a + m))
                seen.add(k)
            run = None
            for a, b in late:
                if run and a < run[1]:
                    run[1] = max(run[1], b)
                else:
                    run = [a, b]
                    spans.append(run)
            spans = [s for s in spans if isinstance(s, tuple) or s[1] - s[0] >= P.RUN_WORDS]
        if spans:
            out[i, text] = kept_words(words, spans)
    return out


def queries_hash(text):
    return HASHES[text]


HASHES: dict = {}


def check(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", digest string").repartition(5)
    HASHES.clear()
    HASHES.update({r["text"] or "": r["h"] for r in df.selectExpr("text", "xxhash64(text) AS h").collect()})
    out = P.removed(df, Work(spark, "t"), **how).collect()
    texts = {}
    for r in out:
        originals = [t for i, t in rows if i == r["doc_id"] and rebuilt(t, r["spans"]) == r["text"]]
        assert originals
        texts.setdefault(r["doc_id"], set()).update(originals)
    want = plain(rows, **how)
    got = {}
    for r in out:
        for t in texts[r["doc_id"]]:
            if rebuilt(t, r["spans"]) == r["text"] and (r["doc_id"], t) in want:
                got[r["doc_id"], t] = [x for x in "".join(c.lower() if c.isascii() else c for c in r["text"]).replace("\n", " ").split(" ") if x]
    assert got == want
    assert len(out) == sum((i, t or "") in want for i, t in rows)
    return out


def rebuilt(text, spans):
    left, at = "", 0
    for s in spans:
        left, at = left + (text or "")[at : s["start"]], s["end"]
    return left + (text or "")[at:]


def shares(rows, n):
    """Ids of documents that hold n words in a row of an earlier one or twice."""
    seen, out = set(), set()
    for i, text in sorted((i, t) for i, t in rows if i is not None):
        w = (text or "").lower().split()
        for j in range(len(w) - n + 1):
            if (x := tuple(w[j : j + n])) in seen:
                out.add(i)
            seen.add(x)
    return out


def corpus(seed, lengths):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(2000)] + ["ß", "É", "😀"]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [text(rng.choice(lengths)) for _ in range(8)]
    rows = []
    for i in range(150):
        words = text(rng.choice((0, 5, 60, 300)))
        for _ in range(rng.choice((0, 0, 1, 2))):
            words += rng.choice(passages) + text(rng.choice((1, 5, 40)))
        rows.append((i * 3, "".join(w + rng.choice((" ", " ", " ", "\n", "  ")) for w in words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_passages_over_50_words_are_removed_but_once(spark, seed):
    rows = corpus(seed, (51, 55, 70, 120))
    rows += [(1, rows[3][1]), (100_000, rows[5][1]), (7, None), (10, ""), (None, rows[3][1]), (13, "er " * 300), (16, rows[4][1] + rows[4][1])]
    out = check(spark, rows, line_words=15)
    assert shares(rows, 51) <= {r["doc_id"] for r in out} and shares(rows, 51)
    left = {r["doc_id"]: r["text"] for r in out}
    assert not shares([(i, left.get(i, t)) for i, t in rows], 51)


@pytest.mark.parametrize("how", [{}, {"line_words": 3}, {"line_words": 1, "passages": False}, {"line_words": 15}])
def test_equals_the_plain_version_on_the_whole_table(spark, sf, how):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert check(spark, rows, **how)


def test_short_passages_stay(spark):
    rows = corpus(9, (10, 20, 30))
    assert P.removed(spark.createDataFrame(rows, SCHEMA), Work(spark, "t"), line_words=15).count() == 0


def test_rows_that_share_an_id(spark):
    rng = random.Random(8)
    text = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    p, own, other = text(80), text(200), text(200)
    rows = [(1, f"{p} one"), (7, own), (7, f"{p} {other}"), (7, own), (7, "short"), (8, own)]
    out = {(r["doc_id"], r["text"]) for r in check(spark, rows)}
    assert (8, "") in out and not any(i == 7 and t.split()[:3] == own.split()[:3] for i, t in out)
    # rows of one id that share a passage: it stays in one of them
    out = P.removed(spark.createDataFrame([(3, f"{p} a"), (3, f"{p} b"), (3, f"{p} a")], SCHEMA), Work(spark, "t")).collect()
    assert len({r["text"] for r in out}) == 1 and all(len(r["text"].split()) < 20 for r in out)


def test_lines_are_removed_but_once_also_inside_a_document(spark):
    rows = [(1, "One line here\nand  ANOTHER\n\none   line HERE\nlast"), (2, "and another\nnew\nlast"), (3, "x one line here")]
    out = {r["doc_id"]: r for r in check(spark, rows)}
    assert out[1]["text"] == "One line here\nand  ANOTHER\n\nlast" and out[2]["text"] == "new\n" and 3 not in out
    assert [(s["start"], s["end"]) for s in out[1]["spans"]] == [(28, 44)]


def test_words_in_another_order_are_another_line(spark):
    assert not check(spark, [(1, "a b a c a"), (2, "a c a b a")])


def test_repeated_rows_and_no_rows(spark):
    text = " ".join(f"w{i}" for i in range(80))
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (2, text), (2, "short")], SCHEMA)
    out = P.removed(df, Work(spark, "t")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in out) == [(2, ""), (2, "")]
    assert P.removed(df.limit(0), Work(spark, "t")).count() == 0


def test_a_very_long_text(spark):
    rng = random.Random(3)
    p = " ".join(f"p{i}" for i in range(60))
    long = " ".join(f"v{rng.randrange(10**7)}" for _ in range(400_000))
    out = P.removed(spark.createDataFrame([(1, p), (2, f"{long} {p} tail\n" + f"{p}\n" * 500)], SCHEMA), Work(spark, "t"), line_words=15).collect()
    assert len(out) == 1 and out[0]["text"].split()[:400_000] == long.split() and len(out[0]["text"].split()) < 400_030


def test_units_do_not_depend_on_the_batch():
    texts = ["a b c d e f g h i j k l m n o p\nq r", "", "x y", "er " * 40, "one\n\ntwo three"]
    data, offsets = wordhash.text_buffer(pa.array(texts))
    w = wordhash.words(data, offsets)
    for make in (lambda w, data: P.units(w), lambda w, data: P.lines(w, data, 1)):
        both = make(w, data)
        for t, text in enumerate(texts):
            own, ends = wordhash.text_buffer(pa.array([text]))
            alone = make(wordhash.words(own, ends), own)
            assert np.array_equal(alone[0], both[0][both[1] == t]) and np.array_equal(alone[2], both[2][both[1] == t])


def test_repeats_do_not_depend_on_the_batch():
    rng = random.Random(5)
    rows = sorted((rng.randrange(4), rng.randrange(3), rng.randrange(2), rng.choice((1, -1)) * rng.randrange(1, 6)) for _ in range(200))
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["key", "doc_id", "row", "at"])
    first = {}
    want = sorted((*r[1:3], ~r[3]) if r[3] < 0 else r[1:] for r in rows if r[3] < 0 or first.setdefault(r[0], r[1:]) != r[1:])
    for size in (1, 7, 200):
        got = [tuple(x.values()) for b in P._repeats(iter([batch.slice(a, size) for a in range(0, 200, size)])) for x in b.to_pylist()]
        assert sorted(got) == want


def test_a_line_of_all_documents_is_one_row_a_batch(spark):
    df = spark.createDataFrame([(i, f"the line that every document of the corpus has\nown {i}") for i in range(3000)], SCHEMA).coalesce(2)
    rows = P.occurrences(df, "doc_id", "text", passages=False).filter("at >= 0")
    assert rows.groupBy("key").count().agg({"count": "max"}).first()[0] <= 4


def test_the_query_of_lines_equals_its_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = sorted(tuple(r) for r in queries.line_dedup(spark, sf).collect())
    assert got == sorted(con.sql(queries.ORACLES["line_dedup"]).fetchall()) and got
