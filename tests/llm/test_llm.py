"""The numbered operators against brute force, on the smallest documents and rows that are odd in every way."""

import base64
import hashlib
import math
import os
import re
import zlib
from collections import Counter
from itertools import pairwise
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parents[2]}:{os.environ.get('PYTHONPATH', '')}"
from seqloom.llm import attention, bpe, decontaminate, iblt, kneser_ney, pii, simhash, suffix_dedup, warc, wavelet  # noqa: E402
from seqloom.llm.components import components  # noqa: E402

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, t string, words int"


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    out = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, "x", 1) for r in docs]
    long_ = " ".join(f"w{i % 977} ok{i % 13}." for i in range(30_000))
    extra = [None, "", " \n\t ", "ab", "Hé ÉA x \u0085   don't  'tis 12\n\n", long_, "a" * 400, "x" + "a" * 300, "mail a@b.co 1.2.3.4.5 card 4111 1111 1111 1111 +49 (30) 1234567 DE89 3704 0044 0532 0130 00 bank", "9" * 300 + "@" * 50, out[0][1], out[3][1] + " tail"]
    return out + [(1000 + i, t, None, None, None, None, None) for i, t in enumerate(extra)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def by_id(df, key="doc_id"):
    out = {r[key]: r for r in df.collect()}
    return out


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def test_decontamination(spark, docs, rows):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + [(900, "ok5"), (901, None), (None, "ok7"), (902, "w5 ok5"), (902, "w5 ok5")]
    table = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    wins = {(tuple(w[i : i + 13]), str(k)) for k, t in items if k is not None and (w := words(t)) for i in range(max(1, len(w) - 12))}
    index = {}
    for w, k in wins:
        index.setdefault(w, set()).add(k)
    for block in (100_000, 40):
        got = by_id(decontaminate.contamination(docs, table, block=block))
        for i, t, *_ in rows:
            w, hit, who = words(t), set(), set()
            for n in {len(x) for x in index}:
                for a in range(len(w) - n + 1):
                    if k := index.get(tuple(w[a : a + n])):
                        who |= k
                        hit |= set(range(a, a + n))
            r = got[i]
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), len(hit), len(who), sha(",".join(sorted(who))), bool(hit) and 20 * len(hit) >= len(w))


def test_fingerprints(docs, rows):
    got = by_id(iblt.compared(docs).select(F.col("id").alias("doc_id"), "n_chars", "edited", "keys", iblt.difference(F.col("keys"), F.col("edited_keys"), F.col("cells"), F.col("edited_cells")).alias("d1"), iblt.difference(F.col("keys"), F.col("next_keys"), F.col("cells"), F.col("next_cells")).alias("d2"), "edited_keys", "next_keys"))
    order = sorted((i, t or "") for i, t, *_ in rows)
    for n, (i, t) in enumerate(order):
        q, nxt = len(t) // 3, order[n - 1][1]
        r = got[i]
        assert (r.n_chars, r.edited) == (len(t), t[: len(t) - q] + nxt[:q])
        for d, other in ((r.d1, r.edited_keys), (r.d2, r.next_keys)):
            assert {x.k for x in d if x.c == 1} == set(r["keys"]) - set(other) and {x.k for x in d if x.c == -1} == set(other) - set(r["keys"])


def test_wavelet(docs, rows):
    from tokenizers import Tokenizer

    library, start = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0
    got = by_id(wavelet.read_shards(wavelet.write_shards(docs, shard=5000)))
    for i, t, *_ in sorted(rows):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@pytest.mark.parametrize("n", [0, 1, 511, 512, 2000])
def test_wavelet_lookup(n):
    ids = np.random.default_rng(n).integers(0, 50, n).astype(np.uint16)
    m, docs, lengths = wavelet.from_file(wavelet.to_file(ids, [3, None], np.array([n, 0]), 6))
    assert docs == [3, None] and (m.decode() == ids).all()
    assert n == 0 or (m.access(np.arange(n)) == ids).all()
    for s in (0, 7, 49, 60):
        places = np.flatnonzero(ids == s)
        assert m.count(s) == len(places) and all(m.select(s, j) == p for j, p in enumerate(places)) and m.rank(s, n // 2) == (places < n // 2).sum()


def test_bpe(docs, rows):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(P.path("byte_bpe_50k.tiktoken")).read_bytes().splitlines())}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(bpe.encoded(docs, piece=7))
    for i, t, *_ in rows:
        ids = np.array(library.encode_ordinary(t or ""), "<u4")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(ids.tobytes()), sha(t or ""))


def test_stream_decoding_cuts_between_characters():
    c = bpe.codec(bpe.default_path(), bpe.default_pattern())
    text = "añ€𝄞x" * 9
    parts = list(c.decoder.stream(np.frombuffer(c.encode(text), "<u4")[i : i + 1] for i in range(len(c.encode(text)) // 4)))
    assert "".join(p.decode() for p in parts) == text


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 0])
def test_suffix_dedup(docs, rows, hot):
    got, first = by_id(suffix_dedup.deduplicated(docs, hot=hot), "id"), {}
    texts = sorted((i, (t or "").encode()) for i, t, *_ in rows)
    for i, t in texts:
        for p in range(len(t) - 49):
            first.setdefault(t[p : p + 50], i)
    for i, t in texts:
        m = bytearray(len(t))
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < i:
                m[p : p + 50] = b"\1" * 50
        runs = sum(b > a for a, b in pairwise([0, *m]))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) == (len(t), sum(m), runs, bytes(c for c, x in zip(t, m, strict=True) if not x))


def test_pii(docs, rows):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    digits = lambda s: re.sub("[^0-9]", "", s)
    keep = {"email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")), "card": lambda s: 13 <= len(digits(s)) <= 19 and pii.luhn(digits(s)), "phone": lambda s: 9 <= len(digits(s)) <= 15}
    got = by_id(pii.personal_data(docs))
    for i, t, *_ in rows:
        want = [(k, *m.span()) for k, p in kinds.items() for m in re.finditer(p, t or "") if keep[k](m[0])]
        assert [(s.kind, s.start, s.end) for s in got[i].spans if s.kind in kinds] == want
    assert "[IBAN]" in got[1008].redacted and "[CARD]" in got[1008].redacted and got[1000].redacted is None


def test_simhash(docs, rows):
    def fp(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    want = {i: fp(t) for i, t, *_ in rows}
    name = {i: i for i in want}
    changed = True
    while changed:
        changed = False
        for a in want:
            low = min(name[b] for b in want if (want[a] ^ want[b]).bit_count() <= 3)
            if low < name[a]:
                name[a], changed = low, True
    got = by_id(simhash.near_duplicates(docs), "id")
    assert {i: (r.fp % (1 << 64), r.component) for i, r in got.items()} == {i: (want[i], name[i]) for i in want}


def test_masks_cover_every_triple():
    m = simhash.masks(3)
    assert len(m) == 15 and all(any(not (x & (1 << a | 1 << b | 1 << c)) for x in m) for a in range(64) for b in range(a + 1, 64) for c in range(b + 1, 64))


def test_links_in_blocks(spark):
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 1 << 62))
    fps = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 30, (200, 2))} | {int(x) for x in rng.integers(0, 1 << 62, 50)})
    got = components(simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), 3, 16)).collect()
    root = {r.node: r.root for r in got}
    near = [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3]
    assert all(root[a] == root[b] for a, b in near) and len({root[x] for p in near for x in p}) >= 1


def test_lm(docs, rows):
    got = by_id(attention.scored(docs), "id")
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)) for i, t, *_ in rows}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in words}
    c = Counter(x for i, w in words.items() if not held[i] for x in w)
    ends = sum(not h for h in held.values())
    n, v = c.total() + ends, len(c) + 1
    for i, w in words.items():
        base = sum(math.log10((x + 0.5) / (n + 0.5 * (v + 1))) for x in (*(c[y] for y in w), ends))
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w) + 1, sum(y in c for y in w) + 1, n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and -1e7 < r.score < 0


def test_quality(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    full = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    m = kneser_ney.quality(full, labels, keep=("doc_id",)).join(labels, "doc_id").collect()
    good, bad = [r.accepted for r in m if r.quality and not r.toxic], [r.accepted for r in m if not r.quality]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.1 * len(bad)
    odd = by_id(kneser_ney.quality(docs, labels.limit(0), keep=("doc_id",)).where("doc_id >= 1000"))
    assert odd[1000].accepted is False and odd[1003].accepted is True


def test_kneser_ney_sums_to_one(spark):
    texts = spark.createDataFrame([(b"abracadabra",), (b"abc abd",)], "t binary")
    r = kneser_ney.train(texts).toPandas()
    model = kneser_ney.Table(r["n"].to_numpy(np.int64), r["g"].to_numpy(np.int64), r["p"].to_numpy(float), r["bow"].to_numpy(float))
    for ctx in (b"abra", b"zzzz", b"\n\n\nb", b" abd"[-4:]):
        codes = np.array([int.from_bytes(ctx + bytes([c]), "big") for c in range(256)], np.int64)
        assert math.isclose((10.0 ** model.score(codes)).sum(), 1, rel_tol=1e-4)


def test_warc(spark):
    pages = spark.createDataFrame([(i, f"u{i}", "x" * (i % 7)) for i in range(300)] + [(None, None, None)], "page_id long, url string, html string")
    first = warc.archive(pages, fanout=4, levels=2)
    assert warc.audit(first, first, fanout=4, levels=2).count() == 0
    second = first.where("id is null or id != 40").withColumn("digest", F.when(F.col("id") == 33, "0").otherwise(F.col("digest")))
    got = {(r.file, r.ordinal): r.status for r in warc.audit(first, second, fanout=4, levels=2).collect()}
    assert got == {(2, 1): "altered", (2, 8): "missing"}


def test_empty(spark, docs):
    none = docs.limit(0)
    items = spark.createDataFrame([], "item_id long, text string")
    for df in (decontaminate.contamination(none, items), iblt.compared(none), wavelet.read_shards(wavelet.write_shards(none)), bpe.encoded(none), suffix_dedup.deduplicated(none), pii.personal_data(none), simhash.near_duplicates(none), attention.scored(none), kneser_ney.quality(none, spark.read.parquet(f"{SF}/labels.parquet"), keep=("doc_id",))):
        assert df.count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    assert 0 < out.count() < 200 and out.select("doc_id").distinct().count() == out.count()
