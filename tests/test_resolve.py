"""Fuzzy matching of names against all pairs."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import SparkSession

from seqloom.operators import curate, resolve


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def score(a, b):
    return 1 - edits(a, b) / max(len(a), len(b))


@settings(max_examples=400, deadline=None)
@given(st.text("abc", min_size=1, max_size=14), st.text("abc", min_size=1, max_size=14), st.sampled_from([0.51, 0.6, 0.75, 0.8, 0.9, 1.0]))
def test_near_names_share_a_key(a, b, least):
    if score(a, b) >= least - 1e-12:
        assert set(resolve._pieces(b, least)) & set(resolve._probes(a, least))


@pytest.mark.parametrize("length", range(1, 40))
@pytest.mark.parametrize("least", [0.51, 0.75, 0.9, 1.0])
def test_pieces_make_the_name(length, least):
    got = resolve.segments(length, least)
    assert [a for a, _ in got] == [sum(n for _, n in got[:k]) for k in range(len(got))] and sum(n for _, n in got) == length and all(n for _, n in got)


def names(seed, n):
    r = np.random.default_rng(seed)
    genus = ["Solanum", "Solanium", "Carex", "Carexa", "Rosa", "Aster"]
    out = []
    for _ in range(n):
        name = f"{genus[r.integers(0, 6)]} {''.join(r.choice(list('aeilnrst'), r.integers(3, 9)))}"
        for _ in range(r.integers(0, 3)):
            at = int(r.integers(0, len(name)))
            name = name[:at] + str(r.choice(["", "x", name[at] * 2])) + name[at + 1 :]
        out.append(name)
    return out


@pytest.mark.parametrize("least", [0.6, 0.85])
def test_same_matches_as_all_pairs(spark, least):
    """A genus that most names have, repeated and blank names, nulls."""
    asked, known = [*names(1, 150), "", "Rosa", "Rosa"], [*names(2, 300), "", "Rosas", "Rose"]
    s = spark.createDataFrame([(x,) for x in [*asked, None]], "name_submitted string").repartition(3)
    b = spark.createDataFrame([(x,) for x in [*known, None]], "name string").repartition(3)
    got = {(r.name_submitted, r.name): r.score for r in resolve.near_names(s, b, least).collect()}
    want = {(x, y): z for x in set(asked) for y in set(known) if x and y and (z := score(x, y)) >= least - 1e-12}
    assert got == {k: pytest.approx(v) for k, v in want.items()} and len(want) >= 5


def test_recheck_looks_beyond_the_block(spark):
    backbone = spark.createDataFrame([("Quercus robur", "Quercus robur", "species", "Accepted"), ("Quercus rubra", "Quercus rubra", "species", "Accepted")], "name string, accepted_name string, accepted_rank string, status string")
    asked = spark.createDataFrame([("Kuercus robur",), ("Quercus rubra",), ("Nothing like it",)], "name string")
    first = resolve.resolved(asked, backbone, least=0.9)
    assert [r.name_matched for r in first.collect()] == ["Quercus rubra"]
    again = {r.name_submitted: r.name_matched for r in resolve.rechecked(asked, backbone, first, 0.9).collect()}
    assert again == {"Quercus rubra": "Quercus rubra", "Kuercus robur": "Quercus robur"}
    with pytest.raises(ValueError, match="over 0.5"):
        resolve.near_names(asked, backbone, 0.5)


def test_numbers_of_names(spark):
    got = curate.numbered(spark.createDataFrame([(f"n{k:03}",) for k in range(300)], "organism string").repartition(7), "organism").collect()
    assert sorted((r.id, r.organism) for r in got) == [(k + 1, f"n{k:03}") for k in range(300)]
