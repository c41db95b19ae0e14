"""The pipeline's stages and the language model on planted rows, against brute force."""

import math
import os
import re
import zlib
from collections import Counter
from itertools import pairwise
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import SparkSession

os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parents[2]}:{os.environ.get('PYTHONPATH', '')}"
from seqloom.llm import attention, kneser_ney, simhash, vocab  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def kept_by_pairs(texts):
    """Ids of the smallest document of each component of Jaccard 0.8 or more on five-word shingles."""
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets[i] = {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    name, todo = {}, sorted(sets)
    for i in todo:
        if i in name:
            continue
        name[i], ball = i, [i]
        while ball:
            a = ball.pop()
            for b in todo:
                if b not in name and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])):
                    name[b] = i
                    ball.append(b)
    return {i for i in name if name[i] == i}


def test_near_copies_of_the_stage(spark):
    rng = np.random.default_rng(5)
    texts = {}
    for g in range(60):
        words = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(8, 400)))]
        for _ in range(int(rng.integers(1, 6))):
            own = list(words)
            for at in rng.integers(0, len(own), int(rng.integers(0, 1 + len(own) // 35))):
                own[at] = f"x{rng.integers(0, 10**9)}"
            texts[len(texts)] = " ".join(own)
    hub = [f"h{x}" for x in range(200)]
    for _ in range(60):  # a large group whose members are further from each other than from their source
        own = list(hub)
        for at in rng.integers(0, 200, 3):
            own[at] = f"y{rng.integers(0, 10**9)}"
        texts[len(texts)] = " ".join(own)
    texts |= {len(texts) + k: t for k, t in enumerate([None, "", "  ", "a b", "A  b", texts[0].upper()])}
    docs = spark.createDataFrame([(i, t, "en", "x", 1) for i, t in texts.items()], SCHEMA).repartition(5)
    got = {r.doc_id for r in simhash.stage_simhash(spark, docs, "").collect()}
    want = kept_by_pairs(texts)
    assert got == want and len(want) < len(texts) - 100


def test_near_copies_are_proposed_by_fingerprints(spark, monkeypatch):
    """Without a band in common, pairs are found whose fingerprints differ in three bits or less, and no others."""
    monkeypatch.setattr(simhash, "_bands", lambda own: [xxhash.xxh64_intdigest(own.tobytes(), i) for i in range(16)])
    rng = np.random.default_rng(6)
    texts, want = [], set()
    for g in range(30):
        words = [f"w{x}" for x in rng.integers(0, 5000, 1500)]
        own = list(words)
        own[700] = "x"
        texts += [" ".join(words), " ".join(own)]
        one, two = (simhash.simhash(simhash._spread(simhash.shingle_set(t.encode(), 5))) for t in texts[-2:])
        want |= {2 * g} if (one ^ two).bit_count() <= 3 else {2 * g, 2 * g + 1}
    docs = spark.createDataFrame([(i, t, "en", "x", 1) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    assert {r.doc_id for r in simhash.stage_simhash(spark, docs, "").collect()} == want and 30 <= len(want) < 50


def test_toxic_documents_are_rejected(spark):
    rng = np.random.default_rng(8)
    vocab = [f"{a}{b}{c}" for a in "bdgklmnprst" for b in "aeiou" for c in ("n", "r", "st", "l")]
    bad = ["moron", "scum", "trash"]
    rows, labels = [], []
    for i in range(900):
        words = [vocab[x] for x in rng.integers(0, len(vocab), 150)]
        toxic = i % 9 == 0
        for _ in range(3 if toxic else 0):
            words.insert(int(rng.integers(0, 150)), bad[int(rng.integers(0, 3))])
        rows.append((i, " ".join(words), "en", "x", 1))
        if i < 450:
            labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.accepted for r in kneser_ney.quality(docs, labels, keep=("doc_id",)).collect()}
    assert not any(got[i] for i in range(900) if i % 9 == 0)  # labelled or not
    assert sum(got[i] for i in range(900) if i % 9) >= 0.96 * 800
    none = kneser_ney.quality(docs, labels.where("toxic = 0"), keep=("doc_id",))
    assert none.where("toxic").count() == 0


def forward(model, seq, pairs, follow, less=0):
    """ln p of each id, by loops: attention in windows that overlap, their first places for context alone."""
    out = []
    w, size = model.w, attention.WINDOW
    for i, y in enumerate(seq):
        first = 0 if i < size else (i - attention.OVERLAP) // (size - attention.OVERLAP) * (size - attention.OVERLAP)
        x = [model.start if j == 0 else seq[j - 1] for j in range(first, i + 1)]
        p0 = float(model.base[y])
        total = num = 0.0
        for d, j in enumerate(reversed(range(len(x)))):
            e = math.exp(float(w["q"][x[-1]] @ w["k"][x[j]]) + float(w["b"][d]))
            if d:
                value = float(model.far[y, model.cls[x[j]]])
            else:
                after = follow.get(x[-1], {})
                taken = sum(n - attention.DISCOUNT for n in after.values())
                c = sum(after.values())
                value = max(after.get(y, 0) - attention.DISCOUNT, 0) / max(c, 1) + (1 - taken / c if c else 1) * p0
            num, total = num + e * value, total + e
        s = math.exp(float(w["s"][x[-1]]))
        out.append(math.log((num + s * p0) / (total + s)))
    return out


def test_lm_score_by_hand(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 120 or doc_id % 7 = 0")
    rows = docs.select("doc_id", "text").collect()
    library = vocab.word_ids(vocab.default_path())
    seqs = {r.doc_id: [*np.frombuffer(b, "<u2").tolist(), 49407] for r, b in zip(rows, library.encode([(r.text or "").encode() for r in rows]), strict=True)}
    train = [i for i in seqs if zlib.crc32(str(i).encode()) % 5 != 1]
    words = Counter(w for r in rows if r.doc_id in set(train) for w in re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(LOW)))
    table = spark.createDataFrame([(bytearray(np.array(seqs[i], "<u2").tobytes()),) for i in train], "ids binary").repartition(3)
    model, _ = attention.trained(table, vocab.default_path(), ([w.encode() for w in words], list(words.values())))
    assert model.seen == sum(len(seqs[i]) for i in train)  # every window trains
    follow = {}
    for i in train:
        for x, y in pairwise([49407, *seqs[i]]):
            follow.setdefault(x, Counter())[y] += 1
    starts = Counter()

    def units(seq):
        """Chunks of words, words as tuples of ids."""
        out, word, now = [], [], []
        for n, y in enumerate(seq):
            word.append(y)
            if library.ends[y] or n == len(seq) - 1:
                now.append(tuple(word))
                key = attention.rolled(np.array(word, np.uint64), np.array([0]))[0]
                if (int(key) >> 40) % attention.CHUNK == 0 or n == len(seq) - 1:
                    out.append(tuple(now))
                    now = []
                word = []
        return out

    known = Counter()
    for w, n in words.items():
        ids = np.frombuffer(library.encode([w.encode()])[0], "<u2").tolist()
        for chunk in units(ids):
            for u in chunk:
                known[u] += n * (len(u) > 1)
    cut = Counter(c for i in train for c in units(seqs[i]))
    for c, n in cut.items():
        for u in c:
            starts[u[0]] += n * (len(u) > 1)
    taken = Counter()
    for u, n in known.items():
        taken[u[0]] += max(n - attention.DISCOUNT, 0)
    once, twice, all_ = sum(n == 1 for n in cut.values()), sum(n == 2 for n in cut.values()), cut.total()
    less = once / (once + 2 * twice)
    got = {r.id: r for r in attention.scored(docs).collect()}
    for i in [*train[:12], *(i for i in seqs if i not in set(train))][:30]:
        p, at, want = forward(model, seqs[i], None, follow), 0, 0.0
        for chunk in units(seqs[i]):
            low = 0.0
            for u in chunk:
                one, rest, at = p[at], sum(p[at + 1 : at + len(u)]), at + len(u)
                if len(u) > 1:
                    c = max(starts[u[0]], 1)
                    bow = 1 - taken[u[0]] / c if starts[u[0]] else 1
                    low += one + math.log(max(known[u] - attention.DISCOUNT, 0) / c + bow * math.exp(rest))
                else:
                    low += one
            n = cut[chunk]
            own = (n - less) / all_ if n else 0
            want += math.log10(own + less * len(cut) / all_ * 10 ** (low / math.log(10))) if own else low / math.log(10) + math.log10(less * len(cut) / all_)
        assert math.isclose(got[i].score, want, rel_tol=2e-4), i


def test_lm_mixture_sums_to_one():
    rng = np.random.default_rng(3)
    seqs = [rng.integers(0, 60, n) for n in rng.integers(1, 90, 80)]
    target, lengths = np.concatenate(seqs), np.array([len(s) for s in seqs])
    n = np.bincount(target, minlength=200)
    key, c = np.unique(attention.shifted(target, lengths, 199) * 200 + target, return_counts=True)
    model = attention.Model(n, (key // 200, key % 200, c), 199, rng.random(200) < 0.4)
    model.set_far(np.bincount(target * 32 + model.cls[attention.shifted(target, lengths, 199, 3)], minlength=6400).reshape(200, 32))
    assert model.step(model.gradient(target, lengths)) == len(target)
    for ctx in ([], [5], [7, 150, 3], rng.integers(0, 200, 40).tolist()):
        every = np.array([[*ctx, y] for y in range(200)]).ravel()
        p = model.tokens(every, np.full(200, len(ctx) + 1)).reshape(200, -1)[:, -1]
        assert math.isclose(np.exp(p.astype(float)).sum(), 1, rel_tol=1e-4)


def test_lm_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    two, seven = ({r.id: r.score for r in attention.scored(docs.repartition(n, "text")).collect()} for n in (2, 7))
    assert two.keys() == seven.keys() and all(math.isclose(two[i], seven[i], rel_tol=1e-5) for i in two)


def test_lm_counts_that_no_task_holds_count_too(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 120")
    want = {r.id: (r.base_score, r.score) for r in attention.scored(docs).collect()}
    monkeypatch.setattr(attention, "PAIRS", 300)
    monkeypatch.setattr(attention, "WORDS", 60)
    got = {r.id: (r.base_score, r.score) for r in attention.scored(docs).collect()}
    assert got.keys() == want.keys() and all(math.isclose(a, b, rel_tol=1e-5) for i in want for a, b in zip(got[i], want[i], strict=True))


def test_lm_blocks_hold_words_once_and_no_texts(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 120").coalesce(1)
    want = {r.id: (r.n_tokens, r.n_known, r.base_score, r.score) for r in attention.scored(docs).collect()}
    monkeypatch.setattr(attention, "BLOCK", 20_000)  # many blocks; scores don't depend on them
    got = {r.id: (r.n_tokens, r.n_known, r.base_score, r.score) for r in attention.scored(docs).collect()}
    assert got.keys() == want.keys() and all(math.isclose(a, b, rel_tol=1e-6) for i in want for a, b in zip(got[i], want[i], strict=True))
    rows, counts = attention.prepared(docs, vocab.default_path(), id_col="doc_id", text_col="text")
    found = rows.collect()
    assert "t" not in rows.columns and len(found) > 2 and all(len(r.w) == len(set(r.w)) for r in found)
    texts, often = {r.doc_id: r.text or "" for r in docs.collect()}, Counter()
    for r in found:
        no = np.frombuffer(r.no, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()
        for i, held, part in zip(r.id, r.held_out, np.split(no, np.cumsum(r.size)[:-1]), strict=True):
            words = re.findall(r"[^\x20\x09-\x0D]+", texts.pop(i).translate(LOW))
            assert [bytes(r.w[n]).decode() for n in part] == [*words, ""]
            often.update(words if not held else [])
    assert not texts and {bytes(r.w).decode(): r.c for r in counts.collect()} == often


def test_merges_give_the_librarys_ids():
    texts = [r["text"] for r in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).to_pylist()]
    words = {w.encode() for t in texts[:300] if t for w in t.translate(LOW).split()}
    words |= {w.encode() for w in "\u0130stanbul \ufb01ne \u03a3\u039f\u03a6\u038c\u03a3 stra\u00dfe STRASSE \u00c5NGSTR\u00d6M e\u0301te\u0301 \u0401\u043b\u043a\u0430 \u65e5\u672c \u00b5m \u0149a aaaa aaaaaaa abababab a hello, don't x'll (a) 123".split()}
    words |= {w.capitalize() for w in words}
    mine = vocab.WordIds(vocab.default_path(), merges=True)
    order, some = sorted(words), [w for w in words if w.isalpha()]
    want = [np.array(e.ids, "<u2").tobytes() for e in mine.library.encode_batch([w.decode() for w in order], add_special_tokens=False)]
    assert mine.each(order) == want
    assert mine._merged(some) and len(some) > 1000  # by merges alone


def test_lm_pruned_counts_leave_their_share(spark):
    rows = spark.createDataFrame([(i, 1 + i % 9) for i in range(1000)], "key long, c long")
    kept = attention.most(rows, 400)
    assert kept.count() <= 400 and kept.agg({"c": "min"}).first()[0] > 5
    assert attention.most(rows, 1000).count() == 1000


def test_a_long_text_leaves_the_sample_to_others(spark):
    docs = spark.createDataFrame([(i, "x" * (5000 if i % 2 else 90), "en", "x", 1) for i in range(40)], SCHEMA)
    good = docs.selectExpr("doc_id AS _good")
    got = [len(r.t) for r in kneser_ney.sample(docs, good, 100, 1000, id_col="doc_id", text_col="text").collect()]
    assert got == [90] * 11
    with pytest.raises(ValueError):
        kneser_ney.sample(docs, good, 100, 80, id_col="doc_id", text_col="text")


def test_lm_classes_count_every_pair(monkeypatch):
    """Ids whose neighbours are not frequent either get a class by these, and frequent ids are told apart by them too."""
    monkeypatch.setattr(attention, "FREQUENT", 40)
    rng, counts = np.random.default_rng(4), np.r_[np.arange(140, 100, -1), np.ones(60, int)]
    near = rng.integers(0, 60, (40, 40))
    x, y = np.divmod(np.flatnonzero(near), 40)
    n = near[x, y]
    pairs = lambda more: tuple(np.r_[a, b].astype(float if k == 2 else int) for k, (a, b) in enumerate(zip((x, y, n), zip(*more, strict=True), strict=True)))
    model = attention.Model(counts, pairs([(5, 50, 9)]), 99, rng.random(100) < 0.4)
    lead = int(np.flatnonzero(model.cls[:40])[0])
    model = attention.Model(counts, pairs([(lead, 50, 9), (50, 51, 1), (51, 50, 1)]), 99, rng.random(100) < 0.4)
    assert model.cls[50] == model.cls[lead] == model.cls[51]
    order, rank = attention.frequent(counts)
    a, b, c = pairs([(lead, 50, 4), (3, 51, 5), (52, 53, 2)])
    one = attention.Model(counts, (a, b, c), 99, np.zeros(100, bool))
    two = attention.Model(counts, (a, b, c), 99, np.zeros(100, bool), near=(attention.merged(rank, a), attention.merged(rank, b), c))
    assert (one.cls[order] == two.cls[order]).all()


def test_lm_classes_by_all_pairs_that_no_task_holds(spark, monkeypatch):
    monkeypatch.setattr(attention, "FREQUENT", 60)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 120")
    want = {r.id: r.score for r in attention.scored(docs).collect()}
    monkeypatch.setattr(attention, "PAIRS", 300)
    got = {r.id: r.score for r in attention.scored(docs).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-5) for i in want)
