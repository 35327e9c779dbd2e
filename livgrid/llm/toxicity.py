"""Toxicity scores: a weighted lexicon matched by Aho-Corasick over folded text, normalised by length.

Folding: NFKC, lower case, zero-width characters removed, Cyrillic and Greek look-alikes and accented ASCII look-alikes of
leetspeak (digits and signs inside a word that has letters) turned into Latin letters, every other non-letter into a
space. Lexicon entries match at the start of a word (`stem`) or as a whole word (`word$`); the heaviest entry of a word
counts. Words inside an exception phrase don't count. A document's features are the logarithm of its summed weights
and those weights a word, and a logistic curve over them is the score.

The lexicon starts from SEEDS and is widened by entries learned from labelled rows: document counts of word
starts and whole words by label, kept if their share of toxic rows is beyond chance over all entries tested.
Labels serve training alone. The sample is bounded: at most about MOST_POSITIVE toxic and MOST_NEGATIVE
other labelled rows, chosen by a hash of doc_id; a doc_id with contradicting labels is left out, and one that several documents
have counts with the least of their texts.

Defined cases: a null or empty text scores as a text without words; every row gives a row, repeated ones too; with no
labelled rows, or labels of one kind, the seeds and PRIOR are used.
"""

from __future__ import annotations

import bisect
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from livgrid.llm.storage import bound_batches
from livgrid.llm.wordhash import chunks

MOST_POSITIVE, MOST_NEGATIVE = 4_000, 8_000
STEM_CHARS = range(3, 9)
SEED_WEIGHT = 4.0
#: Least ratio of the odds that a text with an entry is toxic to those of any text.
LEAST_RATIO = 5
#: General insults, and phrases in which such a word is harmless.
SEEDS = (
    "idiot$ idiots$ moron$ morons$ imbecile$ stupid$ stupidity$ loser$ losers$ scum$ scumbag trash$ garbage$ worthless$ pathetic$ disgusting$ "
    "clown$ clowns$ dumbass jackass asshole bastard bitch bullshit cunt$ dickhead douchebag fuck motherfuck shithead retard$ retarded$ slut$ whore$ vermin$ filth$"
).split()
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "garbage can", "garbage truck", "garbage collection", "garbage collector", "clown fish", "circus clown", "sore loser", "pond scum")
#: Intercept and slopes without training rows.
PRIOR = (-3.0, 1.0, 6.0)
#: Look-alikes in the order of the Latin letters that they stand for.
_HOMOGLYPHS = {"а": "a", "в": "b", "с": "c", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x"}
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l"})
_LEET_WORD = re.compile(r"[a-z]+[0134578@$!|](?=[0134578@$!|a-z]*[a-z])[0-9a-z@$!|]*|[0134578@$][0134578@$!|]*[a-z][0-9a-z@$!|]*[a-z]")
_HIDDEN = re.compile("[​-‏⁠﻿­]")


class _Letters(dict):
    """For str.translate: letters stay, look-alikes change, all else becomes a space."""

    def __missing__(self, code: int) -> int | str:
        c = chr(code)
        self[code] = out = _HOMOGLYPHS.get(c) or (code if c.isalpha() else " ")
        return out


_TABLE = _Letters()


def fold(text: str | None) -> str:
    """The folded text, its words between single or more spaces, a space at both ends."""
    text = (text or "").lower()
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text))
    text = _LEET_WORD.sub(lambda m: m[0].translate(_LEET), text)
    return f" {text.translate(_TABLE)} "


@dataclass
class Lexicon:
    """Weights by entry, exception phrases, and the curve's parameters."""

    weights: dict[str, float] = field(default_factory=lambda: dict.fromkeys(SEEDS, SEED_WEIGHT))
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = PRIOR

    def automaton(self) -> ahocorasick.Automaton:
        out: dict[str, tuple[float, int]] = {}
        for entry, weight in self.weights.items():
            out[" " + fold(entry.rstrip("$")).strip() + " " * entry.endswith("$")] = (weight, 0)
        for phrase in self.exceptions:
            out[fold(phrase)] = (0.0, 1)
        machine = ahocorasick.Automaton()
        for pattern, (weight, exception) in out.items():
            machine.add_word(pattern, (weight, exception, len(pattern)))
        machine.make_automaton()
        return machine


def features(text: str | None, machine: ahocorasick.Automaton) -> tuple[float, float, int]:
    """The summed weights of the words matched, the same a word (for texts of a length), and the number of matches."""
    folded = fold(text)
    hits: dict[int, float] = {}
    spans = []
    for end, (weight, exception, length) in machine.iter(folded):
        start = end - length + 1
        if exception:
            spans.append((start, end))
        elif weight > hits.get(start, 0.0):
            hits[start] = weight
    for a, b in spans:
        for start in range(a, b):
            hits.pop(start, None)
    total = math.fsum(hits.values())
    return total, total / (len(folded.split()) + 10) if hits else 0.0, len(hits)


def _inputs(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), np.log1p(x[:, 0]), np.sqrt(x[:, 1])])


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> tuple[float, float, float]:
    """Logistic regression with a small penalty, by Newton's method; both labels weigh the same."""
    a = _inputs(x)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (weight * (p - y)) + ridge * w
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def probability(total: float, density: float, curve: tuple[float, float, float]) -> float:
    z = curve[0] + curve[1] * math.log1p(total) + curve[2] * math.sqrt(density)
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def held_out(doc_id: str = "doc_id"):
    """Rows that training never sees."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _entries(text: str | None) -> set[str]:
    """The word starts and whole words of a text."""
    out: set[str] = set()
    for word in set(fold(text).split()):
        out.update(word[:k] for k in STEM_CHARS if len(word) >= k)
        if 2 < len(word) <= 40:
            out.add(word + "$")
    return out


def _counted(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition: how many texts of either label hold each entry. Its size is bounded by the sample's."""
    total: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for batch in rows:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total[toxic].update(_entries(text))
    names = list(set(total[0]) | set(total[1]))
    for i in range(0, len(names), 50_000):
        part = names[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array([c[n] for n in part], pa.int64()) for c in (total[1], total[0]))], ["entry", "pos", "neg"])


def training_rows(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic: the bounded sample of labelled rows outside the held-out ones."""
    y = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("__most")).filter("toxic = __most").drop("__most")
    n = {r["toxic"]: r["count"] for r in y.groupBy("toxic").count().collect()}
    share = lambda k, most: min(1.0, most / max(1, n.get(k, 0)))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003.0
    y = y.filter(draw <= F.when(F.col("toxic") == 1, share(1, MOST_POSITIVE)).otherwise(share(0, MOST_NEGATIVE)))
    # the sample's ids are bounded by the two parameters, whatever the corpus: broadcast them, and no text is shuffled
    texts = documents.select("doc_id", "text").join(F.broadcast(y), "doc_id").select("doc_id", "text", F.col("toxic").cast("int"))
    rows, ids = texts.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if rows > ids:  # ids of several rows: the aggregation would change nothing else
        texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic"))
    return texts.select("text", "toxic")


def learn(documents: DataFrame, labels: DataFrame) -> Lexicon:
    """A lexicon from the seeds and the sample of labelled rows. What reaches the driver: the entries that
    tell the labels of the sample apart beyond chance, and three numbers a sampled row."""
    bound_batches(documents.sparkSession)
    lexicon = Lexicon()
    sample = training_rows(documents, labels).persist()
    try:
        sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
        n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
        if not n_pos or not n_neg:
            return lexicon
        counted = sample.mapInArrow(_counted, "entry string, pos long, neg long").groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        base = n_pos / (n_pos + n_neg)
        n = F.col("pos") + F.col("neg")
        share = F.col("pos") / n
        # Kullback-Leibler divergence of the entry's share of toxic texts from the sample's, times the texts
        gain = n * (share * F.log(share / base) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0))
        found = (
            counted.filter((F.col("pos") >= 3) & (F.col("pos") > LEAST_RATIO * base / (1 - base) * F.col("neg")))
            .withColumn("gain", gain)
            .filter(F.col("gain") >= math.log(1e6))
            .orderBy(F.desc("gain"), F.length("entry"), "entry")
            .select("entry", "pos", "neg")
            .collect()
        )
        ordered = sorted(found, key=lambda r: r["entry"])
        names = [r["entry"] for r in ordered]
        kept: set[str] = set()
        for r in found:  # by evidence: a start that is kept covers its longer forms
            word = r["entry"].rstrip("$")
            if any(word[:k] in kept for k in STEM_CHARS if k <= len(word)):
                continue
            kept.add(r["entry"] if r["entry"].endswith("$") else word)
            # the longest form that holds nearly all of its texts is the entry
            longer = ordered[bisect.bisect_left(names, word) : bisect.bisect_left(names, word + "\U0010ffff")]
            best = max((x for x in longer if x["pos"] >= 0.9 * r["pos"] and x["neg"] <= r["neg"]), key=lambda x: (len(x["entry"]), x["entry"]))
            lexicon.weights[best["entry"]] = min(8.0, math.log((best["pos"] + 0.5) / (n_pos + 1)) - math.log((best["neg"] + 0.5) / (n_neg + 1)))
        held = sample.sparkSession.sparkContext.broadcast(lexicon)

        def measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine = held.value.automaton()
            for batch in batches:
                x = [features(t, machine) for t in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in x], pa.float64()), pa.array([f[1] for f in x], pa.float64()), batch.column(1)], ["total", "density", "toxic"])

        rows = sample.mapInArrow(measured, "total double, density double, toxic int").collect()
        rows.sort()
        lexicon.curve = fit_curve(np.array([[r[0], r[1]] for r in rows]), np.array([r[2] for r in rows]))
    finally:
        sample.unpersist()
    return lexicon


def score(df: DataFrame, lexicon: Lexicon, text: str = "text", out: str = "score", matches: str = "n_matches") -> DataFrame:
    """df with the score of each text and the number of lexicon matches; columns of those names are replaced."""
    bound_batches(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(lexicon)  # bounded by the sample
    kept = [f for f in df.schema.fields if f.name not in (out, matches)]
    schema = T.StructType([*kept, T.StructField(out, T.DoubleType()), T.StructField(matches, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = held.value.automaton()
        for batch in chunks(batches, text):
            at = batch.schema.get_field_index
            x = [features(t, machine) for t in batch.column(at(text)).to_pylist()]
            arrays = [batch.column(at(f.name)) for f in kept] + [pa.array([probability(a, b, held.value.curve) for a, b, _ in x], pa.float64()), pa.array([n for *_, n in x], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [f.name for f in schema])

    return df.mapInArrow(run, schema)
