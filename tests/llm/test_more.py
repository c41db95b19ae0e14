"""Byte-level BPE of every code point, decontamination by join with clashing names, quality by loops and by other partitions, stages
of no documents."""

import base64
import hashlib
import math
import os
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parents[2]}:{os.environ.get('PYTHONPATH', '')}"
sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
from seqloom.llm import bpe, decontaminate, kneser_ney, warc  # noqa: E402
from seqloom.llm.common import ALNUM  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def test_every_code_point():
    """Alone between letters, twice between spaces: the pattern is passed over for letters that Python knows."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(P.path("byte_bpe_50k.tiktoken")).read_bytes().splitlines())}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = bpe.codec(bpe.default_path(), bpe.default_pattern())
    for at in range(0, 0x32000, 0x800):
        if not 0xD800 <= at < 0xE000:
            text = "".join(f"x{chr(k)}y {chr(k)}{chr(k)} " for k in range(at, at + 0x800))
            assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode_ordinary(text), hex(at)


def test_decontamination_by_join_keeps_clashing_names(spark):
    clash = ("item_id", "w", "g", "id", "n_hit", "hit")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", *(F.lit(f"own-{c}").alias(c) for c in clash))
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").withColumn("text2", F.lit("x"))
    ways = [decontaminate.contamination(docs, bench, keep=("doc_id", *clash), block=b) for b in (100_000, 40)]
    one, two = ({r.doc_id: tuple(r) for r in w.collect()} for w in ways)
    assert ways[0].columns == ways[1].columns and one == two
    assert all("own-item_id" in r and "own-g" in r for r in one.values())


def test_quality_does_not_depend_on_partitions(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    one, many = (sorted((r.doc_id, r.n_bytes, round(r.perplexity or 0, 4), r.accepted) for r in kneser_ney.quality(docs.repartition(n), labels, keep=("doc_id",)).collect()) for n in (1, 7))
    assert one == many


def test_audit_of_pages_with_clashing_names(spark):
    clash = ("id", "file", "ordinal", "offset", "length", "digest", "_r", "status")
    pages = spark.createDataFrame([(k, f"u{k}", f"body {k}") for k in range(40)] + [(None, None, None), (7, "u7", "body 7")], "page_id long, url string, html string")
    told = pages.select("*", *(F.lit("own").alias(c) for c in clash))
    plain, clashing = (sorted(map(tuple, warc.archive(p, fanout=3, levels=2).collect()), key=str) for p in (pages, told))
    assert plain == clashing
    other = told.withColumn("html", F.when(F.col("page_id") == 11, "changed").otherwise(F.col("html")))
    found = warc.audit(warc.archive(told, fanout=3, levels=2), warc.archive(other, fanout=3, levels=2), fanout=3, levels=2).collect()
    assert [r.status for r in found if r.status == "altered"] == ["altered"]


def test_toxicity_of_quality_by_loops(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    told: dict = {}
    for r in labels.collect():
        told[r.doc_id] = max(told.get(r.doc_id, 0), r.toxic or 0)
    words = {i: set(t.translate(ALNUM).split()) for i, t in texts.items()}
    sizes = [sum(told[i] == k for i in told if i in texts) for k in (1, 0)]
    n = {k: Counter(w for i in told if told[i] == k and i in texts for w in words[i]) for k in (1, 0)}
    some = {w for w, t in n[1].items() if t >= 2 and (t + 0.5) * (sizes[1] + 1) > n[0][w] * (sizes[0] + 1)}

    def worst(i):
        own = [told.get(i) == k for k in (1, 0)]
        base = math.log(sizes[1] + 1 - own[1]) - math.log(sizes[0] + 1 - own[0])
        return max([0.0, *(math.log((n[1][w] - own[0] + 0.5) / (n[0][w] - own[1] + 0.5)) + base for w in words[i] & some)])

    got = {r.doc_id: r for r in kneser_ney.quality(docs, labels, keep=("doc_id",)).collect()}
    want = {i: worst(i) for i in texts}
    assert sizes[0] > 5 and some and all(got[i].toxicity == pytest.approx(x, abs=1e-9) for i, x in want.items())
    cut = np.quantile([round(want[i], 3) for i in texts if told.get(i) == 0], kneser_ney.CLEAN)
    assert {i for i, r in got.items() if r.toxic} == {i for i, x in want.items() if round(x, 3) > cut} != set()


def test_stages_of_no_documents(spark):
    import corpus_pipeline

    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, SF)
        assert out.count() == 0, name
        assert stage is corpus_pipeline.STAGES[-1][1] or out.columns == none.columns, name


def test_joined_perplexities_of_odd_rows(spark):
    model = kneser_ney.train(spark.createDataFrame([(b"abracadabra",)], "t binary"))
    rows = spark.createDataFrame([(1, None, "x"), (2, b"", "y"), (3, b"abra", "z")], "uid long, octets binary, g string")
    got = {r.uid: (r.n_bytes, r.perplexity) for r in kneser_ney.joined_perplexities(rows, model).collect()}
    assert got[1] == (None, None) and got[2] == (0, None) and got[3][0] == 4 and got[3][1] > 1
    assert kneser_ney.joined_perplexities(rows.limit(0), model).count() == 0


def test_warc_files_hold_the_manifest(spark, tmp_path):
    bodies = ["plain", None, "", "é\r\n\r\nWARC/1.0\r\n ends in breaks\r\n", "\n", "x" * 100_000, "\r\n" * 3]
    rows = [(k, f"http://ä/{k}" if k % 3 else None, bodies[k % 7], "own") for k in range(60)] + [(7, "u", "again", "own"), (7, "http://ä/7", "plain", "own"), (None, None, None, "own"), (None, "u", "x", "own")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(5)
    warc.write_warc(pages, str(tmp_path / "w"), fanout=3, levels=2)
    data = {int(d.name.split("=")[1]): [f.read_bytes() for f in d.glob("part-*")] for d in (tmp_path / "w").glob("file=*")}
    told = warc.archive(pages, fanout=3, levels=2).collect()
    assert {r.file for r in told} == set(data) and all(len(f) == 1 for f in data.values()) and len(told) == 64
    assert all(hashlib.sha256(data[r.file][0][r.offset : r.offset + r.length]).hexdigest() == r.digest for r in told)
    assert sum(len(f[0]) for f in data.values()) == sum(r.length for r in told)
