"""Secret scan with corpus-wide ownership frequency, in DataFrame expressions alone.

Each text gives candidate spans: the base kinds (assign, access, hex) and wider ones (provider keys, tokens,
private key headers, long mixed strings). Candidates' SHA-256 digests are counted over the corpus by distinct owners,
repositories and texts. A value with EXAMPLE_OWNERS owners or EXAMPLE_TEXTS different texts is a widely copied example;
one with a single owner that looks random is a live-looking credential; the rest is shared. Base spans are
always reported, with their verdict; wider ones only if they look random, aren't widely copied, and are apart from base spans.
Verdicts go back to the candidates by a join that takes frequent values apart (skew.join_unique).

Defined cases: a null or empty text has no spans; a null owner is an owner of its own; every row gives a row, repeated
ones too (they count as one repository); other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from livgrid.llm.native import apart, spans
from livgrid.llm.skew import join_unique
from livgrid.llm.storage import Work

#: Base kinds in the order listed: pattern, the group that is the value, and its least length.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: A private key's header line, and the rest of its block: through the END line, or the lines of base64 if that is missing.
_HEADER = r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----"
_REST = r"(?:[^-]*+(?:-(?!----)[^-]*+){0,16}+-----END (?:[A-Z]+ ){0,3}PRIVATE KEY-----|(?:\s{1,4}[A-Za-z0-9+/=]{16,}+)*+)"
#: Wider kinds: provider prefixes, signed web tokens, private key headers, and long strings that mix letters and digits. A header is
#: the span, but its value (group 1) is the whole block, as headers of a type are all alike.
WIDER = (
    ("provider", r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{40,}|xox[abposr]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|ASIA[A-Z0-9]{16}|sk_live_[A-Za-z0-9]{16,}|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})"),
    ("private", f"(?=({_HEADER}{_REST})){_HEADER}"),
    ("mixed", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[A-Za-z0-9+/_=-]{24})[A-Za-z0-9+/_-]{24,}+={0,2}(?![A-Za-z0-9])"),
)
KINDS = tuple(k for k, *_ in BASE + WIDER)
#: From so many owners, or different texts (exact copies of a document count once), a value is widely copied.
EXAMPLE_OWNERS, EXAMPLE_TEXTS = 3, 20
#: A live-looking value has at least so many different characters and none of these words (fixed values).
LEAST_DIFFERENT = 8
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|your[_-]?|xxxx|test|1234567|abcdef|(.)\1{5}"


def _found(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    matches = spans(text, pattern, tuple(sorted({0, group})))
    value = lambda x: x[f"g{group}"]
    # the same key however its lines are broken; its randomness isn't read, as a long body has any word by chance
    counted = lambda x: F.regexp_replace(value(x), r"\s", "") if kind == "private" else value(x)
    judged = lambda x: x["g0"] if kind == "private" else value(x)
    return F.transform(
        F.filter(matches, lambda x: F.length(value(x)) >= least),
        lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end"), F.sha2(counted(x), 256).alias("digest"), _random(judged(x)).alias("random")),
    )


def _random(value: Column) -> Column:
    return (F.size(F.array_distinct(F.split(value, ""))) >= LEAST_DIFFERENT) & ~value.rlike(PLACEHOLDER)


def candidates(df: DataFrame, text: str, owner: str, repository: str, keep: list[str]) -> DataFrame:
    """A row for each text: `keep`, owner, repository, body (a hash of the text), row_id, and arrays base and wider of structs (start, kind, end, digest, random)."""
    body = F.coalesce(F.col(text), F.lit(""))
    base = F.concat(*(_found(body, k, p, g, n) for k, p, g, n in BASE))
    out = df.select(*keep, F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), F.xxhash64(body).alias("body"), F.monotonically_increasing_id().alias("row_id"), F.array_sort(base).alias("base"), *(_found(body, k, p, int(k == "private"), 1).alias(k) for k, p in WIDER))
    wider: list[str] = []
    for k, _ in WIDER:  # a wider span is apart from base spans and from the wider kinds before it
        out = out.withColumn(k, apart(F.col(k), F.concat("base", *wider)))
        wider.append(k)
    return out.withColumn("wider", F.concat(*wider)).drop(*wider)


def ownership(each: DataFrame) -> DataFrame:
    """By digest of candidates (digest, owner, repository, body): how many owners, repositories and different texts have it. Spark counts them over
    (digest, value) first, so a value copied everywhere costs one row a task at the end."""
    number = lambda c: F.count_distinct(F.coalesce(F.concat(F.lit("="), c), F.lit("")))
    return each.groupBy("digest").agg(number("owner").alias("owners"), number("repository").alias("repositories"), F.count_distinct("body").alias("texts"))


def verdict() -> Column:
    """example: widely copied, over owners or over different texts. live: one owner's, and it looks random. shared: the rest."""
    copied = (F.col("owners") >= EXAMPLE_OWNERS) | (F.col("texts") >= EXAMPLE_TEXTS)
    return F.when(copied, "example").when((F.col("owners") == 1) & F.col("random"), "live").otherwise("shared")


def scan(df: DataFrame, work: Work, text: str = "text", owner: str = "source", repository: str = "doc_id", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each row of df: `keep`, and `spans`: structs (start, kind, end, digest, verdict, owners, repositories, is_base) in order.

    The candidates are written once; the texts are read once.
    """
    found = work.write(candidates(df, text, owner, repository, list(keep)), "candidates")
    flagged = lambda side, is_base: F.transform(side, lambda c: F.struct(c.alias("c"), F.lit(is_base).alias("is_base")))
    each = found.select("row_id", "owner", "repository", "body", F.explode(F.concat(flagged("base", True), flagged("wider", False))).alias("x")).select("row_id", "owner", "repository", "body", "x.c.*", "x.is_base")
    owned = work.write(ownership(each), "owned")
    judged = join_unique(each.drop("owner", "repository", "body"), owned, ["digest"], work, "owned").withColumn("verdict", verdict())
    judged = judged.filter(F.col("is_base") | (F.col("verdict") != "example") & F.col("random"))
    listed = judged.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "digest", "verdict", "owners", "repositories", "is_base"))).alias("spans"))
    none = F.array().cast(listed.schema["spans"].dataType)
    return found.join(listed, "row_id", "left").select(*keep, F.coalesce("spans", none).alias("spans"))


def joined(array: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    name = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(array, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest_rows(scanned: DataFrame) -> DataFrame:
    """scan's rows with the columns that are compared: counts of the base kinds, the digest of the base spans, all spans as text."""
    base = F.filter("spans", lambda s: s["is_base"])
    count = lambda test: F.size(F.filter("spans", test)).cast("bigint")
    of_kind = lambda i: count(lambda s: s["kind"] == i)
    return scanned.select(
        "doc_id",
        *(of_kind(i).alias(f"n_{k}") for i, (k, *_) in enumerate(BASE)),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        count(lambda s: s["verdict"] == "live").alias("n_live"),
        count(lambda s: s["verdict"] == "example").alias("n_example"),
    )
