"""Toxicity by gradient-boosted trees over a few dense features of a whole text, calibrated by isotonic regression.

The lexicon is learned: how many toxic and other documents of a labelled sample have each word, or each beginning of one,
as stems are toxic where their forms are too many to be seen. Features are densities of lexicon words, how near they stand to the
second person, capitals, punctuation and obfuscation. Labelled rows are judged without their own share of the lexicon's
counts, so they look like unseen ones. Two models of trees learn from a half each; what each says of the other half fits the
calibration, and their mean is calibrated to the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept, octets, quoted, read, slices, staged, unpacked

#: The sample's bound: so many labelled documents, the first in the order of a hash of their ids.
MAX_ROWS = 10_000
#: The lexicon's bound, and bytes of a word's beginnings. A term is in it if so many toxic documents have it.
MAX_TERMS, STEM, LEAST = 20_000, range(3, 9), 2
#: Log-likelihood ratios from which a word is mildly, and strongly, toxic.
MILD, STRONG = 1.5, 3.0
#: Words on either side of a strong one that are looked at for the second person.
NEAR = 4
TREES, DEPTH, STEP = 20, 3, 0.3
THRESHOLD = 0.7
FOLDS, HELD_OUT = 3, 1
#: Words that a task remembers.
CACHE = 1 << 18

# The second person in some languages, and signs that stand for letters.
YOU = {w.encode() for w in "you your yours yourself u ur du dich dir dein deine deinen ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split()}
SIGNS = bytes.maketrans(b"01345789@$!", b"oieastbgasi")

UPPER, LETTERS = bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
PUNCTUATION, SYMBOLS, DIGITS = b".,;:!?'\"()[]{}-_/\\|", b"#$%&*@^~+=<>", b"0123456789"
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))
SHOUTED, MASKED, DRAWN = re.compile(rb"\b[A-Z]{3,}\b"), re.compile(rb"[A-Za-z]+[0-9@$!*]+(?:[A-Za-z0-9@$!*]*[A-Za-z])"), re.compile(rb"([A-Za-z])\1\1")

FEATURES = [
    "worst", "worst_three", "strong", "strong_count", "mild", "strong_words", "near_you", "you", "capitals", "shouted", "punctuation", "calls", "symbols",
    "digits", "masked", "drawn", "masked_worst", "words",
]


def terms_of(words: set[bytes]) -> set[bytes]:
    """Words, and their beginnings with a mark."""
    return words | {b"^" + w[:n] for w in words for n in STEM if n <= len(w)}


class Lexicon(dict):
    """A word's evidence: the largest log-likelihood ratio, toxic to other, of the word and its beginnings. `own` is the
    label of a document of the sample, which is judged without itself."""

    def __init__(self, counts: dict[bytes, tuple[int, int]], sizes: tuple[int, int], own: int | None = None):
        super().__init__()
        self.counts, self.minus = counts, (own == 1, own == 0)
        self.base = math.log(max(1, sizes[1] - self.minus[1]) + 1) - math.log(max(1, sizes[0] - self.minus[0]) + 1)

    def __missing__(self, word: bytes) -> float:
        most = 0.0
        for term in (word, *(b"^" + word[:n] for n in STEM if n <= len(word))):
            if got := self.counts.get(term):
                most = max(most, math.log((got[0] - self.minus[0] + 0.5) / (got[1] - self.minus[1] + 0.5)) + self.base)
        if len(self) >= CACHE:
            self.clear()
        self[word] = most
        return most


def features(text: bytes, lexicon: Lexicon) -> list[float]:
    """The FEATURES of a text's bytes; an empty text has zeros."""
    words = text.translate(WORDS).split()
    if not words:
        return [0.0] * len(FEATURES)
    worth = np.fromiter(map(lexicon.__getitem__, words), np.float64, len(words))
    strong, n, size = np.flatnonzero(worth >= STRONG), len(words), len(text)
    you = np.array([i for i, w in enumerate(words) if w in YOU], np.int64)
    near = 0
    if len(strong) and len(you):
        k = np.searchsorted(you, strong)
        gap = np.minimum(np.abs(you[np.minimum(k, len(you) - 1)] - strong), np.abs(you[np.maximum(k - 1, 0)] - strong))
        near = int((gap <= NEAR).sum())
    masked = MASKED.findall(text)
    plain = max((lexicon[w] for m in masked for w in (m.translate(SIGNS).replace(b"*", b"").lower(), m.replace(b"*", b"").lower())), default=0.0)
    letters, amount = size - len(text.translate(None, LETTERS)), lambda signs: (size - len(text.translate(None, signs))) / size
    top = np.partition(worth, max(0, n - 3))[max(0, n - 3) :]
    return [
        worth.max(), top.mean(), len(strong) / n, math.log1p(len(strong)), ((worth >= MILD) & (worth < STRONG)).sum() / n, math.log1p(len({words[i] for i in strong})), near / max(1, len(strong)),
        len(you) / n, (size - len(text.translate(None, UPPER))) / max(1, letters), len(SHOUTED.findall(text)) / n, amount(PUNCTUATION), amount(b"!?"), amount(SYMBOLS), amount(DIGITS),
        len(masked) / n, len(DRAWN.findall(text)) / n, plain, math.log1p(n),
    ]


def sample(docs: DataFrame, told: DataFrame, max_rows: int, *, id_col: str, text_col: str) -> DataFrame:
    """(id, y, octets) of the first max_rows of told (id, y) that docs has, by a hash of the id. Only ids meet the labels."""
    ids = docs.select(quoted(id_col).alias("id")).distinct().join(told, "id")
    chosen = ids.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    return docs.select(quoted(id_col).alias("id"), octets(quoted(text_col)).alias("octets")).join(F.broadcast(chosen), "id").select("id", "y", "octets")


def lexicon_counts(texts: DataFrame, max_terms: int = MAX_TERMS) -> dict[bytes, tuple[int, int]]:
    """How many toxic and other texts of (y, octets) have each term: those that LEAST toxic ones have and that are likelier there,
    max_terms at most, the ones that most toxic texts have first."""

    def count(batches):
        for b in slices(batches, 1 << 21):
            seen: tuple = (Counter(), Counter())
            for y, t in zip(b["y"].to_pylist(), b["octets"].to_pylist(), strict=True):
                seen[y].update(terms_of(set(t.translate(WORDS).split())))
            for y in (0, 1):
                yield pa.RecordBatch.from_arrays([pa.array(list(seen[y]), pa.binary()), *(pa.array(list(seen[y].values()) if k == y else [0] * len(seen[y]), pa.int64()) for k in (1, 0))], ["term", "t", "c"])

    sizes = {r["y"]: r["n"] for r in texts.groupBy("y").agg(F.count("*").alias("n")).collect()}
    both = texts.select("y", "octets").mapInArrow(count, "term binary, t long, c long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    likelier = (F.col("t") + 0.5) * (sizes.get(0, 0) + 1) > F.lit(math.e) * (F.col("c") + 0.5) * (sizes.get(1, 0) + 1)
    rows = both.where((F.col("t") >= LEAST) & likelier).orderBy(F.desc("t"), "c", "term").limit(max_terms).collect()
    return {bytes(r["term"]): (r["t"], r["c"]) for r in rows}


def with_features(rows: DataFrame, counts: dict, sizes: tuple[int, int], own: bool = False) -> DataFrame:
    """rows without their last column, a text's bytes, and `x`, its features. `own`: y is the label that each row gave to
    the counts."""
    held, names = rows.sparkSession.sparkContext.broadcast(counts), rows.columns[:-1]

    def run(batches):
        lexica = {y: Lexicon(held.value, sizes, y) for y in (None, 0, 1)}
        for b in slices(batches, 1 << 21):
            mine = b["y"].to_pylist() if own else [None] * len(b)
            x = [features(t, lexica[y]) for t, y in zip(b.column(b.num_columns - 1).to_pylist(), mine, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(x, pa.list_(pa.float64()))], [*names, "x"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField("x", T.ArrayType(T.DoubleType()))]))


def _margin(rows: DataFrame, model, name: str) -> DataFrame:
    raw = model.setFeaturesCol("x").setRawPredictionCol("_raw").setPredictionCol("").setProbabilityCol("")
    return raw.transform(rows).withColumn(name, vector_to_array("_raw")[1]).drop("_raw")


class Model:
    """Lexicon, two models of trees and the calibration; where the sample lacks a class, the share of toxic rows alone."""

    def __init__(self, texts: DataFrame, max_terms: int = MAX_TERMS):
        n = {r["y"]: r["n"] for r in texts.groupBy("y").agg(F.count("*").alias("n")).collect()}
        self.sizes, self.trees = (n.get(1, 0), n.get(0, 0)), []
        self.share = self.sizes[0] / max(1, sum(self.sizes))
        if min(self.sizes) < 2:
            return
        self.counts = lexicon_counts(texts, max_terms)
        half = (F.row_number().over(W.partitionBy("y").orderBy(F.xxhash64("id"), "id", F.xxhash64("octets"))) % 2).alias("half")  # of the sample
        rows = with_features(texts.select("id", "y", half, "octets"), self.counts, self.sizes, own=True)
        rows = staged(rows.select("half", "y", "x").repartitionByRange(4, "half", "x")).select("half", F.col("y").cast("double").alias("label"), array_to_vector("x").alias("x"))
        learner = GBTClassifier(featuresCol="x", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, minInstancesPerNode=2, seed=1)
        self.trees = [learner.fit(rows.where(F.col("half") == h)) for h in (0, 1)]
        other = [_margin(rows.where(F.col("half") != h), self.trees[h], "margin").select("label", "margin") for h in (0, 1)]
        self.scale = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="score").fit(other[0].unionByName(other[1]))

    def scored(self, rows: DataFrame) -> DataFrame:
        """rows (kept, a text's bytes last) with a score in place of the text."""
        if not self.trees:
            return rows.select(*rows.columns[:-1], F.lit(float(self.share)).alias("score"))
        x = with_features(rows, self.counts, self.sizes).withColumn("x", array_to_vector("x"))
        x = _margin(_margin(x, self.trees[0], "_a"), self.trees[1], "_b").withColumn("margin", (F.col("_a") + F.col("_b")) / 2)
        return self.scale.transform(x).select(*rows.columns[:-1], F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)).alias("score"))


def toxicity(docs: DataFrame, labels: DataFrame, *, keep: tuple, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS, max_terms: int = MAX_TERMS, threshold: float = THRESHOLD) -> DataFrame:
    """One row for every row of docs: the columns of `keep`, held_out, score (0 to 1) and predicted (1 from `threshold`).

    labels (doc_id, toxic): a document is toxic if any of its labels says 1; null labels say nothing. The model learns from
    at most max_rows labelled documents that aren't held out: those whose id's CRC-32, in decimal, doesn't leave 1 by 3
    (a null id is neither labelled nor held out). Scores depend on the text alone. Null and empty texts have features of 0,
    and are scored too; very long ones are read whole. Repeated rows get equal scores. Where the sample has not two rows of
    either class, every score is its share of toxic rows, 0 if it has none. An empty table gives no rows. Other columns
    don't matter; a kept one that has a result's name comes back as kept_<name>.
    """
    out = lambda c: F.crc32(c.cast("string").cast("binary")) % FOLDS == HELD_OUT
    told = labels.where(F.col("toxic").isNotNull() & ~out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").cast("int").alias("y"))
    model = Model(staged(sample(docs, told, max_rows, id_col=id_col, text_col=text_col), "zstd"), max_terms)
    rows = docs.select(kept(keep), F.coalesce(out(quoted(id_col)), F.lit(False)).alias("held_out"), octets(quoted(text_col)).alias("octets"))
    found = model.scored(rows).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    return unpacked(found, ("held_out", "score", "predicted"))


def op12_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), keep=("doc_id",))
