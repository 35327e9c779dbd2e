"""The SQL of queries against them on rows that the given tables don't have."""

import math

import duckdb

from livgrid.llm import queries


def both(spark, folder, name, **tables):
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{table}.parquet")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = queries.QUERIES[name](spark, str(folder)).toPandas()
    want = con.sql(queries.ORACLES[name]).df()
    plain = lambda df: sorted(map(str, df[sorted(got.columns)].astype(object).values.tolist()))
    assert plain(got) == plain(want)
    return got


def test_vectors_that_link_with_nothing(spark, tmp_path):
    rows = [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], None), (3, None, 0), (4, [0.0, 0.0], 0), (5, [1.0, None], 0), (6, [math.nan, 1.0], 0), (7, [math.inf, 1.0], 0), (8, [], 0), (9, [1.0, 2.01], 0), (10, [1.0, 2.0, 3.0], 0), (11, [1e30, 2e30], 0), (12, [1e-30, 2e-30], 0)]
    got = both(spark, tmp_path, "op9_embedding_dedup", embeddings=(rows, "vec_id long, embedding array<double>, label int"))
    assert {r.vec_id for r in got.itertuples() if r.n_links == 3} == {1, 9, 11, 12}


def test_short_items(spark, tmp_path):
    docs = [(1, "One two three four five six"), (2, "x one  two\ty"), (3, "onetwo"), (4, None), (5, ""), (6, "ONE TWO")]
    items = [(1, "one two"), (2, None), (3, ""), (4, "two three four five six seven"), (5, "one two three four five"), (6, " x ")]
    got = both(spark, tmp_path, "op5_decontamination", documents=(docs, "doc_id long, text string"), benchmark=(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.itertuples()} == {(1, 1), (2, 1), (6, 1), (1, 5), (2, 6)}


def test_lines(spark, tmp_path):
    docs = [(1, "A b\n\nc"), (2, "a  B\nd\r\na b"), (3, None), (4, ""), (5, "\n"), (6, "a b c"), (7, "A B\nC")]
    got = both(spark, tmp_path, "line_dedup", documents=(docs, "doc_id long, text string"))
    assert dict(zip(got.doc_id, got.words, strict=True)) == {2: "d", 7: ""}
