"""Markov clustering in blocks of columns against matrices."""

import numpy as np
import pytest
from pyspark.sql import SparkSession

from seqloom.operators import graph

EDGES = "graph_id string, i string, j string"


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def clusters(df):
    out = df.collect()
    got = {(r.graph_id, r.node): r.cluster for r in out}
    assert len(got) == len(out)
    return got


def test_blocks_and_matrices_agree(spark):
    """Several graphs at once, that end after different rounds; hubs, lone nodes and weights."""
    r = np.random.default_rng(6)
    edges = {("a", x, y) for x, y in r.integers(0, 120, (260, 2)).tolist()} | {("b", 0, y) for y in range(1, 60)} | {("b", x, x + 1) for x in range(1, 90)} | {("c", 1, 2)}
    e = spark.createDataFrame([(g, f"{x:03}", f"{y:03}") for g, x, y in edges], EDGES).repartition(3)
    weight = lambda k: 1 + k * 7 % 5 + (300 if k == 11 else 0)
    nodes = spark.createDataFrame([(g, f"{k:03}", weight(k)) for g, n in (("a", 125), ("b", 91), ("c", 4)) for k in range(n)], "graph_id string, i string, n long")
    want = clusters(graph.markov_clusters(e, nodes))
    assert clusters(graph.markov_clusters(e, nodes, dense=0, block=16)) == want and len(set(want.values())) > 20


def test_a_weight_is_so_many_nodes(spark):
    """Nodes of a class have the same neighbours and each other; one row for all of them gives what each has."""
    r = np.random.default_rng(2)
    weights = r.integers(1, 9, 30).tolist() + [1200]
    classes = {(a, b) for a, b in r.integers(0, 31, (40, 2)).tolist() if a != b}
    near = classes | {(k, k) for k in range(31)}
    names = [[f"{k:02}-{c:04}" for c in range(w)] for k, w in enumerate(weights)]
    each = spark.createDataFrame([("g", x, y) for a, b in near if weights[a] * weights[b] < 10_000 for x in names[a] for y in names[b] if x != y], EDGES)
    small = [k for k in range(30)]
    told = spark.createDataFrame([("g", names[k][0], weights[k]) for k in small], "graph_id string, i string, n long")
    e = spark.createDataFrame([("g", names[a][0], names[b][0]) for a, b in classes if max(a, b) < 30], EDGES)
    each = each.where("i < '30' and j < '30'")
    by_class = clusters(graph.markov_clusters(e, told))
    all_ = clusters(graph.markov_clusters(each, spark.createDataFrame([("g", x) for k in small for x in names[k]], "graph_id string, i string")))
    assert all_ == {("g", x): by_class["g", names[k][0]] for k in small for x in names[k]}


def test_one_component_of_20000_nodes(spark):
    """A chain of cliques of four and five: as a matrix has it for a shorter chain, whose middle sees no end."""

    def chain(n):
        cliques, at = [], 0
        for k in range(n):
            size = 4 + k % 3 % 2
            cliques.append(list(range(at, at + size)))
            at += size
        pairs = [(x, y) for c in cliques for x in c for y in c if x < y] + [(a[-1], b[0]) for a, b in zip(cliques, cliques[1:], strict=False)]
        return cliques, pairs, at

    def run(n, **how):
        cliques, pairs, nodes = chain(n)
        e = spark.createDataFrame([("g", f"{x:06}", f"{y:06}") for x, y in pairs], EDGES)
        got = clusters(graph.markov_clusters(e, **how))
        assert len(got) == nodes
        return cliques, {int(x): int(c) for (_, x), c in got.items()}

    short, by_matrix = run(60)
    long_, by_blocks = run(4620, block=2048)
    assert len(by_blocks) == 20_020
    shift = long_[3000][0] - short[30][0]  # both in the middle, at the same place of the pattern
    for k in range(-9, 9):
        for x in short[30 + k]:
            assert by_blocks[x + shift] == by_matrix[x] + shift


def test_queries_meet_in_one_cluster(spark):
    e = spark.createDataFrame([("g", "a", "b")], EDGES)
    nodes = spark.createDataFrame([("h", "x"), ("g", "a")], "graph_id string, i string")
    assert clusters(graph.markov_clusters(e, nodes, dense=0)) == {("g", "a"): "a", ("g", "b"): "a", ("h", "x"): "x"}
    assert graph.markov_clusters(e.limit(0), nodes.limit(0)).collect() == []
