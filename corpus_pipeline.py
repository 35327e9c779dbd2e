"""The corpus pipeline: five stages over `documents`, each one operator of livgrid.llm, each written and read again.

A stage gets what its predecessor kept and returns the columns of documents; its decisions take effect in the rows
and texts that it returns. The last returns the token ids.

Defined cases, for every stage: an empty table gives an empty one; null and empty texts, null ids and other columns pass through (they are neither toxic
nor copies, hold no benchmark item and no personal data, and have no tokens); rows that share an id and have different texts are judged
apart; columns beyond those of documents are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from livgrid.llm import bpe, decontaminate, jaccard_join, pii, storage, toxicity
from livgrid.llm.queries import PII_KEY, VOCABULARY
from livgrid.llm.skew import join_unique
from livgrid.llm.storage import Work
from livgrid.sources.tables import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon's curve calls toxic go; the curve is learned from labelled rows of this stage's input. Rows that share an id are
    scored each by its own text; rows that repeat a text have its score."""
    docs = docs.select(*COLUMNS)
    lexicon = toxicity.learn(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, lexicon, out="__score", matches="__matches").filter("__score < 0.5").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by 5-word shingles at a similarity of 0.8 or more, the one with the smallest doc_id stays (of rows with one id, that
    with the smallest hash of its text; of rows that repeat id and text, one, with the least of the other columns). Rows are told apart
    by id and text, so another text with the id of a copy stays. Texts without words, and rows without an id, link with nothing and stay."""
    docs = docs.select(*COLUMNS).withColumn("row", F.xxhash64("text"))
    work = Work(spark, "near")
    rows = jaccard_join.grouped(docs, work, jaccard_join.Measure(5, 80)).filter("component IS NOT NULL").select("doc_id", "row", "component")
    rows = work.write(rows, "grouped")
    least = work.write(rows.groupBy("component").agg(F.min(F.struct("doc_id", "row")).alias("least")), "least-rows")
    judged = join_unique(rows, least, ["component"], work, "least-rows")
    gone = work.write(judged.filter(F.struct("doc_id", "row") != F.col("least")).select("doc_id", "row").distinct(), "gone")
    again = work.write(rows.groupBy("doc_id", "row").count().filter("count > 1").select("doc_id", "row"), "again")
    small = lambda df: F.broadcast(df) if df.count() <= jaccard_join.BROADCAST_IDS else df
    kept = docs.join(small(gone), ["doc_id", "row"], "left_anti")
    if again.isEmpty():
        return kept.select(*COLUMNS)
    again = small(again)
    one = kept.join(again, ["doc_id", "row"], "left_semi").groupBy("doc_id", "row").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("r"))
    return kept.join(again, ["doc_id", "row"], "left_anti").select(*COLUMNS).union(one.select("doc_id", "r.*"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go; rows that share an id are searched each for itself."""
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by surrogates, the same ones in all rows; n_chars is that of the new text where it changed."""
    made = pii.replace(docs.select(*COLUMNS), Work(spark, "pii"), PII_KEY, found="__entities")
    changed = F.size("__entities") > 0
    return made.withColumn("n_chars", F.when(changed, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every text (none for a null one), decoded again to check them: doc_id, lang, source, n_tokens, ids, intact; a row for each row."""
    # other stages' workers stand beside this one's: a smaller memo
    coder = bpe.encoder(public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, memo_size=200_000)
    return bpe.encode_checked(docs.select("doc_id", "lang", "source", "text"), coder).select("doc_id", "lang", "source", "n_tokens", "ids", "intact")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("benchmark", drop_benchmark),
    ("personal data", replace_pii),
    ("tokens", encode),
]

#: No SQL expresses the first, fourth and fifth stage; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written in the shared folder and read again, and what it wrote on its way is deleted then."""
    work = Work(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        begun = storage.mark()
        docs = work.write(stage(spark, docs, sf_dir), f"stage-{k}")
        storage.drop_since(begun)
        if k:
            work.drop(f"stage-{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
