import math
import re
import time

from livgrid.llm import queries, toxicity


def plain_score(text, lexicon):
    """The score of a text, each word held against each entry."""
    folded = toxicity.fold(text)
    hits = {}
    for m in re.finditer(r"\S+", folded):
        for entry, weight in lexicon.weights.items():
            e = toxicity.fold(entry.rstrip("$")).strip()
            if m[0] == e if entry.endswith("$") else m[0].startswith(e):
                hits[m.start()] = max(weight, hits.get(m.start(), 0.0))
    for phrase in map(toxicity.fold, lexicon.exceptions):
        for i in range(len(folded)):
            if folded.startswith(phrase, i):
                hits = {k: w for k, w in hits.items() if not i < k < i + len(phrase)}
    total = math.fsum(hits.values())
    z = lexicon.curve[0] + lexicon.curve[1] * math.log(1 + total) + lexicon.curve[2] * math.sqrt(total / (len(folded.split()) + 10))
    return 1 / (1 + math.exp(-z))


def test_query_equals_a_plain_scorer_on_the_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    lexicon = toxicity.learn(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = queries.op8_toxicity(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert abs(r["score"] - plain_score(texts[r["doc_id"]], lexicon)) < 1e-9 and r["predicted"] == (r["score"] >= 0.5)


def test_held_out_labels_are_told_apart(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [(r["predicted"], labels[r["doc_id"]]) for r in queries.op8_toxicity(spark, sf).filter("held_out").collect() if r["doc_id"] in labels]
    assert sum(p for p, y in rows if y) >= 0.9 * sum(y for _, y in rows) and sum(p for p, y in rows if not y) <= 0.02 * len(rows)


def test_very_long_texts():
    machine = toxicity.Lexicon().automaton()

    def seconds(n):
        text = "trash can idiot m0r0n river " * n
        began = time.perf_counter()
        assert toxicity.features(text, machine)[2] == 2 * n
        return time.perf_counter() - began

    seconds(100)
    assert seconds(80_000) < 8 * seconds(20_000) + 1


def test_a_document_id_of_several_texts(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.training_rows(docs, labels).count() <= 2


def test_folding():
    assert toxicity.fold("ІDI0T, 5tup1d! lo$er").split() == ["idiot", "stupid", "loser"]
    assert toxicity.fold("m​oron ｓｃｕｍ").split() == ["moron", "scum"]
    assert toxicity.fold("in 2024 we had 100 items").split() == ["in", "we", "had", "items"]
    assert toxicity.fold(None).split() == []


def test_matches_and_exception_phrases():
    machine = toxicity.Lexicon().automaton()
    hits = lambda t: toxicity.features(t, machine)[2]
    assert hits("You IDI0T and m0r0n") == 2
    assert hits("put it in the trash can") == 0 and hits("trash and a trash can") == 1
    assert hits("idiotic") == 0 and hits("") == 0 and hits(None) == 0
    assert hits("scumbags") == 1


def test_scores_fall_with_length():
    machine, curve = toxicity.Lexicon().automaton(), toxicity.PRIOR
    score = lambda t: toxicity.probability(*toxicity.features(t, machine)[:2], curve)
    assert score("you idiot, you moron") > score("you idiot, you moron" + " word" * 500) > score("word " * 500)


def test_learning_without_labels_and_with_odd_rows(spark):
    docs = spark.createDataFrame([(1, "you idiot moron loser scum"), (2, None), (3, ""), (3, ""), (None, "x")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(1, 1, None), (None, 1, 1), (3, 1, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, odd):
        lexicon = toxicity.learn(docs, labels)
        assert lexicon.curve == toxicity.PRIOR
        rows = toxicity.score(docs.withColumn("score", docs.doc_id * 0), lexicon).collect()
        assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
        assert max(rows, key=lambda r: r["score"])["doc_id"] == 1


def test_learned_entries_beat_chance_and_the_query_separates(spark, sf):
    filler = ["the house on the hill", "a river runs by", "we walked home slowly", "many trees stood there"]
    docs = [(i, f"{filler[i % 4]} {'zorgat' + 'abcdefgh'[i % 8] if i % 3 == 0 else 'lamp'} {filler[(i + 1) % 4]} zor{i}x") for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    lexicon = toxicity.learn(df, labels)
    assert any(k.startswith("zorga") for k in lexicon.weights)
    rows = toxicity.score(df, lexicon).collect()
    assert all((r["score"] >= 0.5) == (r["doc_id"] % 3 == 0) for r in rows)
    out = queries.op8_toxicity(spark, sf)
    assert {"doc_id", "held_out", "score", "predicted"} <= set(out.columns) and out.count() == 200
