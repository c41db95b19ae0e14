"""Markov clustering of many graphs at once: small ones a matrix each, large ones as blocks of sparse columns."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """df written as a table into the session's checkpoint folder and read again, so that its lineage ends there, a lost
    executor costs a re-read, and plans know its size. Where no folder is named, a local session, whose tasks run in this process,
    gets one of this machine's own; any other is an error. The files go when the session's JVM ends."""
    spark = df.sparkSession
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    path = f"{at.rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


#: Nodes of a graph that is clustered as one matrix in a task (8 MB); larger ones go round as blocks of BLOCK columns.
DENSE, BLOCK = 1_000, 256
#: Products of entries that a task makes at once.
AT_ONCE = 1 << 21
ENTRIES = "col array<long>, row array<long>, row_block array<int>, weight array<double>, value array<double>"


def _clustered(weight: np.ndarray, cells: np.ndarray, inflation: float, rounds: int, prune: float) -> np.ndarray:
    """For each node of one graph the least attractor of its columns; cells are pairs of numbers, the diagonal among them."""
    m = np.zeros((len(weight), len(weight)))
    m[cells[:, 0], cells[:, 1]] = 1
    m /= weight @ m
    for _ in range(rounds):
        new = ((m * weight) @ m) ** inflation
        new /= weight @ new
        new[(new < prune) & (new < new.max(0))] = 0
        change, m = np.abs(new - m).max(), new
        if change <= 1e-8 + 1e-5 * new.max():
            break
    reached = (m > 0) & (m.diagonal() > 0)[:, None]
    return np.where(reached.any(0), reached.argmax(0), -1)


def _small_graphs(cells: DataFrame, inflation: float, rounds: int, prune: float) -> DataFrame:
    graph_type, node_type = cells.schema["graph_id"].dataType.simpleString(), cells.schema["i"].dataType.simpleString()

    def one(table: pa.Table) -> pa.Table:
        weights = dict(zip(table["i"].to_pylist(), table["n"].to_pylist(), strict=True))
        names = sorted(weights)
        number = {x: k for k, x in enumerate(names)}
        pairs = np.array([[number[x] for x in table[c].to_pylist()] for c in ("i", "j")]).T
        least = _clustered(np.array([weights[x] for x in names], float), pairs, inflation, rounds, prune)
        some = np.flatnonzero(least >= 0).tolist()
        graph = pa.array([table["graph_id"][0].as_py()] * len(some), table["graph_id"].type)
        return pa.table({"graph_id": graph, "node": pa.array([names[k] for k in some], table["i"].type), "cluster": pa.array([names[least[k]] for k in some], table["i"].type)})

    return cells.groupBy("graph_id").applyInArrow(one, f"graph_id {graph_type}, node {node_type}, cluster {node_type}")


def markov_clusters(edges: DataFrame, nodes: DataFrame | None = None, inflation: float = 2.0, rounds: int = 100, prune: float = 1e-3, dense: int = DENSE, block: int = BLOCK) -> DataFrame:
    """(graph_id, node, cluster) of undirected edges (graph_id, i, j): the diagonal is 1, columns are normalised; each round
    squares the matrix, raises it to `inflation`, normalises and prunes what is small but for each column's maximum.
    A graph whose entries change by no more than 1e-8 and 1e-5 of its greatest one leaves the loop. A cluster is named by its
    least attractor. nodes (graph_id, i) names nodes that may have no edge: these are clusters of their own. With a column
    n, a node stands for so many that have the same neighbours and each other: the result is theirs, as if each were a node.

    Graphs of up to `dense` nodes are matrices in a task each; larger ones are sparse, in blocks of about `block` columns.
    """
    e = edges.select("graph_id", "i", "j").where("i != j")
    both = e.unionByName(e.select("graph_id", F.col("j").alias("i"), F.col("i").alias("j"))).distinct()
    loops = edges.select("graph_id", F.explode(F.array("i", "j")).alias("i"), F.lit(1.0).alias("n"))
    if nodes is not None:
        loops = loops.unionByName(nodes.select("graph_id", "i", (F.col("n") if "n" in nodes.columns else F.lit(1)).cast("double").alias("n")))
    loops = cut(loops.groupBy("graph_id", "i").agg(F.max("n").alias("n")))
    size = cut(loops.groupBy("graph_id").agg(F.count("*").alias("of")))
    small = size.where(F.col("of") <= dense).select("graph_id")
    cells = cut(both.unionByName(loops.select("graph_id", "i", F.col("i").alias("j"))))
    found = _small_graphs(cells.join(small, "graph_id", "left_semi").join(loops, ["graph_id", "i"]), inflation, rounds, prune)
    large = size.where(F.col("of") > dense)
    return found if large.isEmpty() else found.unionByName(_large_graphs(cells, loops, large, inflation, rounds, prune, block))


def _summed(col: np.ndarray, row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries by column and row, each place once; which entry of the input a place has come from first, and its sum."""
    rows, at = np.unique(row, return_inverse=True)
    cols, of = np.unique(col, return_inverse=True)
    _, first, place = np.unique(of.astype(np.int64) * len(rows) + at, return_index=True, return_inverse=True)
    return first, np.bincount(place, value, len(first)), of[first]


def _arrays(table: pa.Table, names: tuple) -> list[np.ndarray]:
    return [table[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in names]


def _multiplied(parts: pa.Table, held: pa.Table) -> pa.Table:
    """Products of one block's columns with the entries that other blocks have in its rows; a row for each of these blocks."""
    out = []
    if len(held) and len(parts):
        col, row, block, weight, value = _arrays(held, ("col", "row", "row_block", "weight", "value"))
        order = np.argsort(col, kind="stable")
        col, row, block, weight, value = (x[order] for x in (col, row, block, weight, value))
        for k in range(len(parts)):
            one = parts.slice(k, 1)
            to, by, scale = _arrays(one, ("col", "row", "value"))
            a, z = np.searchsorted(col, by), np.searchsorted(col, by, "right")
            upto = np.cumsum(z - a)
            sums, at = [], 0
            while at < len(by):
                end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + AT_ONCE, "right")))
                n = (z - a)[at:end]
                src = np.repeat(a[at:end] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                c, v = np.repeat(to[at:end], n), value[src] * np.repeat(scale[at:end], n)
                first, total, _ = _summed(c, row[src], v)
                sums.append((c[first], row[src][first], block[src][first], weight[src][first], total))
                at = end
            c, r, b, w, v = (np.concatenate(x) for x in zip(*sums, strict=True))
            out.append((one["graph_id"][0], one["block"][0].as_py(), c, r, b, w, v))
    return state_rows(parts.schema.field("graph_id").type, out)


def state_rows(graph_type: pa.DataType, rows: list, **more) -> pa.Table:
    names, kinds = ("col", "row", "row_block", "weight", "value"), (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64())
    lists = {n: pa.array([r[2 + k] for r in rows], pa.list_(t)) for k, (n, t) in enumerate(zip(names, kinds, strict=True))}
    return pa.table({"graph_id": pa.array([r[0].as_py() for r in rows], graph_type), "block": pa.array([r[1] for r in rows], pa.int32()), **lists, **{k: pa.array(v, pa.float64()) for k, v in more.items()}})


def _large_graphs(cells: DataFrame, loops: DataFrame, large: DataFrame, inflation: float, rounds: int, prune: float, block: int) -> DataFrame:
    """Sparse matrices in blocks of columns, all graphs at once. In a round each block hands every entry to the block that has the
    entry's row as a column; that multiplies, and products go back and are summed, inflated, normalised and pruned."""
    graph_type = cells.schema["graph_id"].dataType.simpleString()
    numbered = in_blocks(loops.join(large, "graph_id"), block)
    rows = numbered.select("graph_id", F.col("i"), F.col("uid").alias("row"), F.col("block").alias("row_block"), F.col("n").alias("weight"))
    cols = numbered.select("graph_id", F.col("i").alias("j"), F.col("uid").alias("col"), "block")
    entries = cells.join(rows, ["graph_id", "i"]).join(cols, ["graph_id", "j"])
    state = f"graph_id {graph_type}, block int, {ENTRIES}"

    def begun(table: pa.Table) -> pa.Table:
        col, row, of, weight = (table[c].to_numpy() for c in ("col", "row", "row_block", "weight"))
        _, at = np.unique(col, return_inverse=True)
        value = 1 / np.bincount(at, weight)[at]
        return state_rows(table.schema.field("graph_id").type, [(table["graph_id"][0], table["block"][0].as_py(), col, row, of, weight, value)])

    return sparse_rounds(cut(entries.groupBy("graph_id", "block").applyInArrow(begun, state)), numbered, inflation, rounds, prune)


def in_blocks(nodes: DataFrame, block: int) -> DataFrame:
    """nodes (graph_id, of: the graph's number of nodes) with uid, a number, and block, one of so many columns, about."""
    numbered = cut(nodes.withColumn("uid", F.monotonically_increasing_id()))
    return numbered.withColumn("block", F.pmod(F.xxhash64("uid"), F.ceil(F.col("of") / F.lit(block))).cast("int"))


def sparse_rounds(m: DataFrame, numbered: DataFrame, inflation: float = 2.0, rounds: int = 100, prune: float = 1e-3) -> DataFrame:
    """(graph_id, node, cluster) of matrices in blocks of columns, a row each with ENTRIES, and their nodes of in_blocks() (i: the name)."""
    graph_type = m.schema["graph_id"].dataType.simpleString()
    state = f"graph_id {graph_type}, block int, {ENTRIES}"

    def handed(batches):
        for b in batches:
            for k in range(len(b)):
                one = pa.Table.from_batches([b.slice(k, 1)])
                col, row, of, weight, value = _arrays(one, ("col", "row", "row_block", "weight", "value"))
                got = [(one["graph_id"][0], one["block"][0].as_py(), col[of == x], row[of == x], of[of == x], weight[of == x], (weight * value)[of == x]) for x in np.unique(of)]
                out = state_rows(one.schema.field("graph_id").type, got).append_column("other", pa.array([int(x[4][0]) for x in got], pa.int32()))
                yield from out.to_batches()

    def finished(sums: pa.Table, old: pa.Table) -> pa.Table:
        col, row, of, weight, value = _arrays(sums, ("col", "row", "row_block", "weight", "value"))
        first, value, at = _summed(col, row, value)
        col, row, of, weight = (x[first] for x in (col, row, of, weight))
        value = value**inflation
        value /= np.bincount(at, value * weight)[at]
        most = np.zeros(at.max() + 1)
        np.maximum.at(most, at, value)
        keep = (value >= prune) | (value == most[at])
        col, row, of, weight, value = (x[keep] for x in (col, row, of, weight, value))
        before = _arrays(old, ("col", "row", "value"))
        _, change, _ = _summed(np.r_[col, before[0]], np.r_[row, before[1]], np.r_[value, -before[2]])
        return state_rows(sums.schema.field("graph_id").type, [(sums["graph_id"][0], sums["block"][0].as_py(), col, row, of, weight, value)], change=[np.abs(change).max()], top=[value.max()])

    done = []
    for _ in range(rounds):
        parts = m.mapInArrow(handed, f"{state}, other int")
        sums = parts.groupBy("graph_id", "other").cogroup(m.groupBy("graph_id", F.col("block").alias("other"))).applyInArrow(_multiplied, state)
        new = cut(sums.groupBy("graph_id", "block").cogroup(m.groupBy("graph_id", "block")).applyInArrow(finished, f"{state}, change double, top double"))
        moving = new.groupBy("graph_id").agg(F.max("change").alias("d"), F.max("top").alias("t")).where("d > 1e-8 + 1e-5 * t").select("graph_id")
        new = new.drop("change", "top")
        done.append(new.join(moving, "graph_id", "left_anti"))
        m = new.join(moving, "graph_id", "left_semi")
        if moving.isEmpty():
            break
    final = reduce(DataFrame.unionByName, [*done, m])
    cell = final.select("graph_id", F.explode(F.arrays_zip("col", "row")).alias("x")).select("graph_id", "x.col", "x.row")
    attractors = cell.where("col = row").select("graph_id", "row").join(numbered.select("graph_id", F.col("uid").alias("row"), F.col("i").alias("attractor")), ["graph_id", "row"])
    least = cell.join(attractors, ["graph_id", "row"]).groupBy("graph_id", "col").agg(F.min("attractor").alias("cluster"))
    return least.join(numbered.select("graph_id", F.col("uid").alias("col"), F.col("i").alias("node")), ["graph_id", "col"]).select("graph_id", "node", "cluster")


def cluster_representatives(clusters: DataFrame, rows: DataFrame, key: str, order: list) -> DataFrame:
    """Of each cluster (graph_id, node, cluster) the first of its rows, which carry the node as `key`, in the given order."""
    w = W.partitionBy("graph_id", "cluster").orderBy(*order, key)
    both = clusters.join(rows.withColumnRenamed(key, "node"), "node").withColumnRenamed("node", key)
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
