"""The queries over the operators of this package, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from livgrid.llm import arc_warc, bpe, decontaminate, embedding_dedup, html_text, jaccard_join, passage_dedup, pii, secret_scan, toxicity
from livgrid.llm.storage import Work
from livgrid.sources.tables import table

#: The key of the surrogates. A production run passes its own secret.
PII_KEY = "livgrid surrogates 1"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Least words of a line that op3 takes as a unit: shorter ones (formulas, headings, greetings) come back without being copies.
LINE_WORDS = 15
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document; a null text is an empty one, of no tokens."""
    coder = bpe.encoder(public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), coder)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document; null and empty texts are scored as texts without words, a null doc_id is held out."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.learn(documents, table(spark, sf_dir, "labels"))
    scored = toxicity.score(documents, lexicon)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_matches")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each vector; those that can't be compared, and those without a label, are their own component."""
    return embedding_dedup.links(table(spark, sf_dir, "embeddings"), Work(spark, "vectors"), 0.93)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document; null and empty texts have no spans (the digest is that of nothing)."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return secret_scan.digest_rows(secret_scan.scan(documents, Work(spark, "secrets")))


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document with its text rewritten; a null text stays null."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace(documents, Work(spark, "pii"), PII_KEY).select("doc_id", "text", F.size("entities").cast("bigint").alias("n_entities"), "entities")


def op3_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that lose lines or passages, to earlier documents or to their own text; those that aren't listed stay as they are."""
    return passage_dedup.removed(table(spark, sf_dir, "documents").select("doc_id", "text"), Work(spark, "passages"), line_words=LINE_WORDS)


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator with every line as a unit, of one word or more, and no other units: what SQL can express. Of each document that loses
    lines the number of words left, and these with single spaces."""
    left = passage_dedup.removed(table(spark, sf_dir, "documents").select("doc_id", "text"), Work(spark, "lines"), passages=False)
    words = F.trim(F.regexp_replace(F.translate("text", UPPER, UPPER.lower()), r"[\x20\x09-\x0D]+", " "))
    return left.select("doc_id", F.when(words == "", 0).otherwise(F.size(F.split(words, " "))).cast("bigint").alias("n_words"), words.alias("words"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each page; null and empty pages, and those without text outside links, give an empty text."""
    return html_text.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op7_arc_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each page; a null page is an empty payload, and pages of less than 100 bytes are responses all."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return arc_warc.archive_and_read(pages, Work(spark, "warc")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and item that it holds; null and empty items are in none."""
    return decontaminate.contained(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document; those without words are their own component."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.join(documents, Work(spark, "jaccard"), jaccard_join.Measure(4, 85))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_pii_surrogates": op2_pii_surrogates,
    "op3_passage_dedup": op3_passage_dedup,
    "line_dedup": line_dedup,
    "op4_html_text": op4_html_text,
    "op5_decontamination": op5_decontamination,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_arc_warc": op7_arc_warc,
    "op8_toxicity": op8_toxicity,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_secret_scan": op10_secret_scan,
}

ORACLES: dict[str, str] = {
    "line_dedup": r"""
WITH l AS (SELECT doc_id, unnest(string_split(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(10))) AS l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents),
w AS (SELECT doc_id, n, list_filter(regexp_split_to_array(l, '[ \x09-\x0D]+'), lambda x: x <> '') AS w FROM l),
k AS (SELECT doc_id, n, w, row_number() OVER (PARTITION BY array_to_string(w, ' ') ORDER BY doc_id, n) > 1 AS late FROM w WHERE len(w) > 0)
SELECT doc_id, CAST(coalesce(sum(len(w)) FILTER (NOT late), 0) AS BIGINT) AS n_words, coalesce(string_agg(array_to_string(w, ' '), ' ' ORDER BY n) FILTER (NOT late), '') AS words FROM k GROUP BY doc_id HAVING bool_or(late)""",
    "op9_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
k AS (SELECT *, len(e) AS size FROM v WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM k a JOIN k b ON a.label = b.label AND a.size = b.size AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT c.a AS vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, c.a = c.component_id AS kept FROM c LEFT JOIN n ON n.a = c.a""",
    "op5_decontamination": r"""
WITH t AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (SELECT side, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \x09-\x0D]+'), lambda x: x <> '') AS w FROM t),
s AS (SELECT side, id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [] END)) AS sh FROM w),
n AS (SELECT id, count(*) AS n_item FROM s WHERE side = 1 GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, CAST(count(*) AS BIGINT) AS n_common, CAST(any_value(n_item) AS BIGINT) AS n_item
FROM s d JOIN s b ON d.sh = b.sh AND d.side = 0 AND b.side = 1 JOIN n ON n.id = b.id GROUP BY d.id, b.id HAVING 100 * count(*) >= 80 * any_value(n_item)
UNION ALL SELECT d.id, b.id, CAST(1 AS BIGINT), CAST(1 AS BIGINT) FROM w d, w b WHERE d.side = 0 AND b.side = 1 AND len(b.w) BETWEEN 1 AND 4 AND contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || array_to_string(b.w, ' ') || ' ')""",
    "op6_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS MATERIALIZED (SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles FROM s),
e AS MATERIALIZED (SELECT doc_id, unnest(s) AS sh FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM e a JOIN e b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * common >= 85 * (x.n_shingles + y.n_shingles - common)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT n.doc_id, n.n_shingles, m.component_id FROM n JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) m ON m.a = n.doc_id""",
    "op7_arc_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT *, min(CASE WHEN payload_bytes >= 100 THEN page_id END) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first_id THEN first_id END AS refers_to FROM f""",
}
