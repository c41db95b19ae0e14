"""What a task of op5 works on at once, and its steps against loops."""

import sys
from pathlib import Path

import numpy as np
import pyarrow as pa

sys.path.insert(0, str(Path(__file__).parents[2]))

from seqloom.llm import suffix_dedup as S  # noqa: E402

RNG = np.random.default_rng(11)
TEXTS = [bytes(RNG.choice(list(b"abc "), n).tolist()) for n in RNG.integers(0, 300, 90)] + [b"", b"the same line of more than fifty bytes, again and again. " * 5] * 3


def test_small_batches_are_one_slice():
    """However few rows the session's batches have, a slice has about the bytes that it may: fewer packets a bucket."""
    batches = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array([t], pa.binary())], ["k", "t"]) for i, t in enumerate(TEXTS)]
    whole = sum(map(len, TEXTS))
    assert [b.num_rows for b in S._gathered(iter(batches), whole)] == [len(TEXTS)]
    got = list(S._gathered(iter(batches), 4000))
    assert len(got) < whole / 1500 and [x for b in got for x in b["t"].to_pylist()] == TEXTS
    assert all(sum(map(len, b["t"].to_pylist())) <= 4000 for b in got) and not list(S._gathered(iter([]), 9))


def test_strings_are_hashed_in_their_stretches_alone(monkeypatch):
    """Only the bytes of the stretches asked for are hashed, and strings get the hashes that they have in whole texts."""
    _, doc, start, end = S._all(TEXTS, 50, 24)
    some, hashed, grams = np.arange(0, len(doc), 7), [], S._grams
    monkeypatch.setattr(S, "_grams", lambda data, k: hashed.append(len(data)) or grams(data, k))
    g, which, at = S._strings(TEXTS, doc[some], start[some], end[some], 50)
    assert sum(hashed) == (end - start)[some].sum() < sum(map(len, TEXTS))
    want = [(n, p) for n, i in enumerate(some) for p in range(start[i], end[i] - 49)]
    assert list(zip(which.tolist(), at.tolist(), strict=True)) == want
    assert g.tolist() == [int((grams(np.frombuffer(TEXTS[doc[some[n]]], np.uint8)[p : p + 50], 50) * S.MIX)[0]) for n, p in want]
    none = np.empty(0, np.int64)
    assert not any(len(x) for x in S._strings(TEXTS, none, none, none, 50))


def test_intervals_by_loops():
    """Whole strings are in one interval where they are equal, and in no other."""
    text = np.frombuffer(b"\0".join(TEXTS) + b"\0", np.uint8)
    for length in (50, 24, 9):
        order, first = S.common_prefix_intervals(text, length)
        group = np.empty(len(text), np.int64)
        group[order] = np.cumsum(first)
        seen: dict = {}
        for i in range(len(text) - length + 1):
            s = text[i : i + length].tobytes()
            if b"\0" not in s:
                assert seen.setdefault(s, group[i]) == group[i]
        assert len(set(seen.values())) == len(seen) > 100
