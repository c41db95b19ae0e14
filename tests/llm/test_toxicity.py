"""Toxicity: what it learns from, features against loops, odd rows, and accuracy on documents that were held out."""

import math
import os
import zlib
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parents[2]}:{os.environ.get('PYTHONPATH', '')}"
from seqloom.llm import toxicity as t  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 3 == 1


def labelled(spark, n=240):
    """Documents of which every third insults, by words or by a stem with many endings; and their labels."""
    said = lambda i, word: "You said at noon, number {}, that ".format("i" * (i % 9)) + "plans and trees " * (i * 7 % 11) + word + "!" * (i % 4)
    clean = [said(i, "apples") for i in range(n)]
    rude = [said(i, "buffoon" if i % 2 else "grokk" + chr(97 + i % 26) + chr(97 + i // 26)) for i in range(n)]
    rows = [(i, rude[i] if i % 3 == 0 else clean[i], "s", 9, "own") for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, y int, score string")
    return docs, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(n)], "doc_id long, toxic int")


def test_features():
    lex = t.Lexicon({b"buffoon": (40, 0), b"^gro": (20, 1)}, (50, 400))
    text = b"You BUFFOON, buff00n!! growl GROATS and your soooo fine b*ffoon"
    got = dict(zip(t.FEATURES, t.features(text, lex), strict=True))
    words = [w for w in "you buffoon buff n growl groats and your soooo fine b ffoon".split()]
    base = math.log(401) - math.log(51)
    worth = {"buffoon": math.log(40.5 / 0.5) + base, "growl": math.log(20.5 / 1.5) + base, "groats": math.log(20.5 / 1.5) + base}
    assert math.isclose(got["worst"], worth["buffoon"]) and math.isclose(got["worst_three"], sum(sorted(worth.values())) / 3)
    assert math.isclose(got["strong"], 3 / len(words)) and math.isclose(got["strong_words"], math.log1p(3)) and math.isclose(got["strong_count"], math.log1p(3))
    assert math.isclose(got["near_you"], 3 / 3) and math.isclose(got["you"], 2 / len(words)) and math.isclose(got["words"], math.log1p(len(words)))
    assert math.isclose(got["shouted"], 2 / len(words)) and math.isclose(got["drawn"], 1 / len(words)) and math.isclose(got["masked"], 2 / len(words))
    assert math.isclose(got["masked_worst"], worth["buffoon"]) and math.isclose(got["calls"], 2 / len(text)) and math.isclose(got["digits"], 2 / len(text))
    letters = [c for c in text.decode() if c.isalpha()]
    assert math.isclose(got["capitals"], sum(c.isupper() for c in letters) / len(letters))
    assert t.features(b"", lex) == [0.0] * len(t.FEATURES) == t.features(b" 12 ", lex)


def test_own_label_does_not_count():
    counts = {b"w": (2, 1)}
    plain, toxic, other = (t.Lexicon(counts, (9, 9), own)[b"w"] for own in (None, 1, 0))
    assert toxic == pytest.approx(max(0, math.log(1.5 / 1.5) + math.log(10) - math.log(9))) and toxic < plain < other


def test_lexicon_counts(spark):
    rows = [(1, b"Grr grump x"), (1, b"grr grr y"), (1, b""), (0, b"x y"), (0, b"x grump"), (0, b"y"), (0, b"z")]
    counts = t.lexicon_counts(spark.createDataFrame(rows, "y int, octets binary").repartition(3))
    assert counts == {b"grr": (2, 0), b"^grr": (2, 0)}


def test_accuracy_folds_and_odd_rows(spark):
    docs, labels = labelled(spark)
    odd = spark.createDataFrame([(None, None, None, None, None), (1000, "", None, None, None), (1001, "you buffoon " * 30_000, None, None, None), (3, docs.where("doc_id = 3").first().text, "s", 9, "own")], docs.schema)
    both = docs.unionByName(odd).repartition(3)
    more = labels.unionByName(spark.createDataFrame([(5, None), (3, 0), (None, 1)], labels.schema))
    out = t.toxicity(both, more, keep=("doc_id", "score"))
    assert out.columns == ["doc_id", "kept_score", "held_out", "score", "predicted"]
    got = out.collect()
    assert len(got) == 244 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == held(r.doc_id) for r in got)
    scores = {r.doc_id: r.predicted for r in got}
    assert all(scores[i] == (i % 3 == 0) for i in range(240)) and scores[1001] == 1 and scores[1000] == scores[None] == 0
    assert len({r.score for r in got if r.doc_id == 3}) == 1
    flipped = more.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = t.toxicity(both.drop("source").withColumn("lang", F.lit("xx")), flipped, keep=("doc_id",)).collect()
    assert sorted((str(r.doc_id), r.score) for r in again) == sorted((str(r.doc_id), r.score) for r in got)


def test_without_both_classes(spark):
    docs, labels = labelled(spark, 30)
    calm = t.toxicity(docs, labels.withColumn("toxic", F.lit(0)), keep=("doc_id",)).collect()
    rude = t.toxicity(docs, labels.withColumn("toxic", F.lit(1)), keep=("doc_id",)).collect()
    none = t.toxicity(docs, labels.limit(0), keep=("doc_id",)).collect()
    assert ({r.score for r in calm}, {r.score for r in rude}, {r.score for r in none}) == ({0.0}, {1.0}, {0.0})
    assert t.toxicity(docs.limit(0), labels, keep=("doc_id",)).collect() == []


def test_held_out_documents(spark):
    told = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = t.op12_toxicity(spark, SF).collect()
    assert len(got) == 1000
    out = [(told[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in told]
    assert sum(p for y, p in out if y) >= 0.7 * sum(y for y, _ in out) and sum(p for y, p in out if not y) <= 0.02 * len(out)
