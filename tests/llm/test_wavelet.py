"""Lookups in shard files against the ids themselves."""

import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parents[2]))

import public_tokenizers as P  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

from seqloom.llm import wavelet  # noqa: E402
from seqloom.llm.vocab import WordIds  # noqa: E402

TEXTS = [(5, "the cat saw the dog. the end"), (None, "a null id, the text"), (1, None), (2, ""), (7, "the " * 900), (7, "the same id again"), (9, "Hé ÉA 12\n\nzebra")]


@pytest.fixture(scope="module")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="module")
def shards(spark):
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in TEXTS], "doc_id long, text string, part int, file int").repartition(3)
    return wavelet.write_shards(docs, shard=9)


@pytest.fixture(scope="module")
def encoded():
    """(doc_id, ids) in the files' order: null first, equal ids by their texts."""
    words = WordIds(P.path("word_bpe_49k.json"))
    order = sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    return [(d, [*np.frombuffer(words.encode([(t or "").encode()])[0], "<u2").tolist(), 1]) for d, t in order]


def test_documents(shards, encoded):
    want, start = [], 0
    for d, ids in encoded:
        want.append((d, start, len(ids), ids[0], ids.count(ids[0])))
        start += len(ids)
    got = [(r.doc_id, r.start, r.n_tokens, r.first_id, r.n_first) for r in wavelet.read_shards(shards).collect()]
    assert shards.count() > 3 and sorted(got, key=lambda r: r[1]) == want


def test_counts_and_occurrences(shards, encoded):
    ids = [1, encoded[-3][1][0], encoded[-1][1][0], 40_000, 1, 1 << 20]
    counts = {r.id: (r.n, r.n_docs) for r in wavelet.token_counts(shards, ids).collect()}
    assert counts == {i: (sum(x.count(i) for _, x in encoded), sum(i in x for _, x in encoded)) for i in ids}
    start, want = 0, []
    for d, x in encoded:
        want += [(i, d, start, p) for i in set(ids) for p, y in enumerate(x) if y == i]
        start += len(x)
    for most in (7, 1 << 16):
        assert sorted(map(tuple, wavelet.occurrences(shards, ids, most).collect()), key=str) == sorted(want, key=str)


def test_tokens_at(spark, shards, encoded):
    flat = [y for _, x in encoded for y in x]
    rng = np.random.default_rng(1)
    asked = [0, len(flat) - 1, len(flat), -1, None, *rng.integers(0, len(flat), 300).tolist()]
    got = sorted(map(tuple, wavelet.tokens_at(shards, spark.createDataFrame([(a, 0) for a in asked], "`where` long, part int"), col="where").collect()))
    assert got == sorted({(a, flat[a]) for a in asked if a is not None and 0 <= a < len(flat)})


def test_no_shards(spark):
    none = wavelet.write_shards(spark.createDataFrame([], "doc_id long, text string"))
    places = spark.createDataFrame([(1,)], "position long")
    assert not any(df.count() for df in (wavelet.read_shards(none), wavelet.token_counts(none, [1]), wavelet.occurrences(none, [1]), wavelet.tokens_at(none, places)))


def test_wide_ids_and_chunks(monkeypatch):
    """Ids of over 16 bits, and lookups that inflate few chunks."""
    monkeypatch.setattr(wavelet, "CHUNK", 128)
    ids = np.random.default_rng(3).integers(0, 1 << 20, 9000).astype(np.uint32)
    ids[::7] = 77_777
    file = wavelet.to_file(ids, [1], np.array([9000]), 20)
    matrix = wavelet.from_file(file)[0]
    assert matrix.access(4321)[0] == ids[4321]
    assert 0 < sum(p.open.sum() for p in matrix.planes) <= 3 * 20 < sum(len(p.chunks) for p in matrix.planes)
    at = np.flatnonzero(ids == 77_777)
    assert matrix.count(77_777) == len(at) and (matrix.select(77_777, np.arange(len(at))) == at).all()
    assert (matrix.decode() == ids).all()
    with pytest.raises(IndexError):
        matrix.select(77_777, len(at))


def test_width_of_ids():
    assert WordIds(P.path("word_bpe_49k.json"), None).dtype.itemsize == 2


def test_words_are_looked_up_once():
    """Ids and ends of texts as the library gives them, with one lookup for each different word of all texts and one for the ends."""

    class Counted(dict):
        n = 0

        def __getitem__(self, word):
            Counted.n += 1
            return super().__getitem__(word)

    rng = np.random.default_rng(5)
    made = ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(1, 12))) for _ in range(3000)]
    odd = ["a.", "..", ".a", "a.b", "it's", "don't!!", "é", "É.", "é'", "naïve,", "x1", "1,", "a\tb", "İx", "é", "中文。", "ß$", "ǅ", "a b", "'", "a'", " ", "ab\x00"]
    texts = [(" ".join(rng.choice(made + odd, 2000)) + "\n\n  The END. ").encode() for _ in range(20)] + [b"", b" ", b"the", b"\n"]
    words = WordIds(P.path("word_bpe_49k.json"))
    words.ended(texts, 1)
    words.known = Counted(words.known)
    ids, lengths = words.ended(texts, 1)
    assert 0 < Counted.n <= len({w for t in texts for w in t.lower().replace(b"\n", b" ").split(b" ")}) + 1  # and the ends
    want = [[*words.library.encode(t.decode(), add_special_tokens=False).ids, 1] for t in texts]
    assert lengths.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])
    assert words.encode(texts) == [np.array(w[:-1], "<u2").tobytes() for w in want] and words.encode([]) == []
