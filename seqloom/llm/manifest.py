"""Merkle manifest of a dataset: a tree of fixed fanout over each group's rows, and one over the groups.

Rows are ordered by one range shuffle of their digests alone. Each group's leaves are cut into partitions, aligned runs of
FANOUT ** HEIGHT leaves, whose own trees a task builds. Upper proofs come from a butterfly exchange: in each round the
aligned groups of FANOUT subtrees meet, each partition with its counterpart in every other subtree of its group; they swap
subtree roots, and each hashes their parent for itself. After the last round every partition has the root and all that
stands beside its path, so no pass leads down again, and no key of an exchange has more than FANOUT rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept, quoted, read, staged, unpacked

FANOUT = 3
#: A partition has FANOUT ** HEIGHT leaves of one group; its last one may have fewer.
HEIGHT = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SIDES = "array<struct<left:string,right:string>>"


def leaf(values: list[Column]) -> Column:
    """The digest, in hex, of a row's values: each its UTF-8 bytes' number, a colon and itself, or - where it is null."""
    told = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in told)), 256)


def folded(digest: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its proof (see manifest()) lead to."""
    return F.aggregate(proof, digest, lambda h, p: F.sha2(F.concat(p["left"], h, p["right"]), 256))


def _ordered(leaves: DataFrame, per: int) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): each row's group as an ordinal `s` and its rank there, and each group's number of partitions
    (`blocks`) and of partitions before it (`lo`). Ranks come from the counts of each range's pieces of groups, so a group
    of any size is many tasks' work; totals run over ranges, as many as there are shuffle partitions."""
    by = ["g", "id", "leaf", "nth"]
    rows = staged(leaves.withColumn("nth", F.monotonically_increasing_id()))  # a last tie-break: equal rows too can be dealt out
    rows = staged(rows.repartitionByRange(*by).sortWithinPartitions(*by).drop("nth").select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    pieces = staged(rows.groupBy("part", "g").agg(F.count("*").alias("n"), F.min("at").alias("first")))
    groups = pieces.groupBy("g").agg(F.sum("n").alias("n"), F.min("part").alias("part")).withColumn("blocks", F.ceil(F.col("n") / F.lit(per)).cast("long"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    ranges = groups.groupBy("part").agg(F.count("*").alias("k"), F.sum("blocks").alias("b")).select("part", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("k"), F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b"))
    own = W.partitionBy("part").orderBy("g")
    s = (F.col("k") + F.row_number().over(own) - 1).alias("s")
    groups = staged(groups.join(ranges, "part").select("g", s, "blocks", (F.col("b") + F.sum("blocks").over(own.rowsBetween(W.unboundedPreceding, 0)) - F.col("blocks")).alias("lo")))
    earlier = F.coalesce(F.sum("n").over(W.partitionBy("g").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.withColumn("base", earlier - F.col("first")).join(groups, "g").select("part", "g", "s", "blocks", "base")
    rank = F.col("at") + F.col("base")
    rows = rows.join(pieces, ["part", "g"]).select("s", F.floor(rank / F.lit(per)).alias("block"), "blocks", (rank % per).alias("place"), "kept", "leaf", "other")
    return staged(rows), groups.drop("g")


def _levels(nodes: list[str], fanout: int, height: int | None) -> list[list[str]]:
    """From the leaves up: `height` levels, or with None up to one node."""
    out = [nodes]
    while len(out[-1]) > 1 if height is None else len(out) <= height:
        below = out[-1]
        out.append([hashlib.sha256("".join(below[i : i + fanout]).encode()).hexdigest() for i in range(0, len(below), fanout)])
    return out


def _sorted_leaves(rows: pa.Table, fanout: int, height: int) -> tuple[pa.Table, list[list[str]]]:
    rows = rows.sort_by("place")
    return rows, _levels([x.hex() for x in rows["leaf"].to_pylist()], fanout, None if rows["blocks"][0].as_py() == 1 else height)


def _swapped(nodes: DataFrame, group: list[str], child: Column, place: Column, size: Column, width: Column, more: Column) -> DataFrame:
    """One round. A partition is the place-th of its subtree's (`child` of a group, of `size` partitions), and meets those
    of the same place in the group's other subtrees. The widest has `width`; where a subtree is narrower, its partitions
    stand in for the missing places, so each place has one root of every subtree. Unless there are `more` subtrees than
    one at this level, a partition keeps what it has."""
    told = nodes.select("*", child.alias("c"), place.alias("m"), F.explode(F.sequence(place, width - 1, size)).alias("col"), more.alias("more"))
    own = F.when(F.col("col") == F.col("m"), F.struct("s", "block", "blocks", "c", "path", "subroot", "more", F.col("node").alias("was")))
    met = told.groupBy(*group, "col").agg(F.array_sort(F.collect_list(F.struct("c", "node"))).alias("run"), F.collect_list(own).alias("members"))
    beside = lambda keep: F.array_join(F.transform(F.filter("run", keep), lambda x: x["node"]), "")
    met = met.select("run", F.explode("members").alias("x")).select("run", "x.*")
    sides = F.struct(beside(lambda x: x["c"] < F.col("c")).alias("left"), beside(lambda x: x["c"] > F.col("c")).alias("right"))
    up = F.sha2(F.array_join(F.transform("run", lambda x: x["node"]), ""), 256)
    return met.select("s", "block", "blocks", F.when(F.col("more"), up).otherwise(F.col("was")).alias("node"), F.when(F.col("more"), F.concat("path", F.array(sides))).otherwise(F.col("path")).alias("path"), "subroot")


def _butterfly(roots: DataFrame, groups: DataFrame, fanout: int) -> DataFrame:
    """roots (s, block, blocks, node) with subroot, root and path: what stands left and right at each level above."""
    most = groups.agg(F.max("blocks").alias("b"), F.count("*").alias("s")).first()
    nodes = roots.withColumns({"path": F.array().cast(SIDES), "subroot": F.lit(None).cast("string")})
    full = 1
    while full < (most["b"] or 0):  # within groups, whose partitions are numbered
        child = F.floor(F.col("block") / F.lit(full))
        first = F.floor(child / F.lit(fanout)) * fanout * full
        size, width = (F.least(F.lit(full).cast("long"), F.col("blocks") - x) for x in (child * full, first))
        nodes = _swapped(nodes.withColumn("up", F.floor(child / F.lit(fanout))), ["s", "up"], child, F.col("block") % full, size, width, F.col("blocks") > full)
        full *= fanout
    nodes, full = nodes.withColumn("subroot", F.col("node")), 1
    if most["s"] > 1:
        nodes = staged(nodes)
    while full < most["s"]:  # between groups, whose subtrees have as many partitions as their groups together
        child = F.floor(F.col("s") / F.lit(full)).cast("long")
        trees = groups.groupBy(child.alias("c")).agg(F.min("lo").alias("from"), F.sum("blocks").alias("size"))
        widest = trees.groupBy(F.floor(F.col("c") / F.lit(fanout)).alias("up")).agg(F.max("size").alias("width"))
        shape = groups.select("s", "lo", child.alias("c")).join(trees, "c").withColumn("up", F.floor(F.col("c") / F.lit(fanout))).join(widest, "up").select("s", "up", "c", (F.col("lo") - F.col("from")).alias("lead"), "size", "width")
        nodes = _swapped(nodes.join(shape.withColumnRenamed("c", "tree"), "s"), ["up"], F.col("tree"), F.col("lead") + F.col("block"), F.col("size"), F.col("width"), F.lit(True))
        full *= fanout
    return nodes.withColumnRenamed("node", "root")


def manifest(docs: DataFrame, *, keep: tuple, fields: tuple = FIELDS, group_col: str = "source", id_col: str = "doc_id", changed: dict[str, Column] | None = None, proofs: bool = False, fanout: int = FANOUT, height: int = HEIGHT) -> DataFrame:
    """One row for every row of docs: the columns of `keep`, leaf, subroot (of its group's tree), root, proof_sha256 (of all
    siblings on its path, level by level, from left to right), folded_root and verified.

    Leaves are digests of `fields`, in each group by id, nulls first, then by digest; groups by name, null first. Of nodes
    that are more than one every `fanout` consecutive ones become one, a last run of one too. `changed` gives fields other
    values, by which a row's leaf is made again and folded with the untouched siblings: verified tells whether that is
    still the root. With `proofs` there is a column `proof`, what stands left and right of each level; see folded().
    Nulls, empty and very long values are values of their own. Repeated rows have equal leaves and
    places of their own; an empty table gives no rows. Other columns don't matter; a kept one that has a result's name
    comes back as kept_<name>.
    """
    g = F.coalesce(F.concat(F.lit("1"), quoted(group_col).cast("string")), F.lit("0"))  # null first
    own = [quoted(c) for c in fields]
    leaves = docs.select(kept(keep), g.alias("g"), quoted(id_col).alias("id"), F.unhex(leaf(own)).alias("leaf"), F.unhex(leaf([(changed or {}).get(c, x) for c, x in zip(fields, own, strict=True)])).alias("other"))
    rows, groups = _ordered(leaves, fanout**height)
    names = ["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", *(["proof"] if proofs else [])]
    made = T._parse_datatype_string(f"leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, proof {SIDES}").fields[: len(names)]

    def top(part: pa.Table) -> pa.Table:
        one, levels = _sorted_leaves(part, fanout, height)
        return pa.table({"s": one["s"][:1], "block": one["block"][:1], "blocks": one["blocks"][:1], "node": [levels[-1][0]]})

    def told(part: pa.Table, above: pa.Table) -> pa.Table:
        one, levels = _sorted_leaves(part, fanout, height)
        over = [(x["left"], x["right"]) for x in above["path"][0].as_py()]
        rest, root = "".join(a + z for a, z in over), above["root"][0].as_py()
        cells: list = [[], [], []]
        for i, other in enumerate(one["other"].to_pylist()):
            path, at = [], i
            for nodes in levels[:-1]:
                a, at = at - at % fanout, at // fanout
                run = nodes[a : a + fanout]
                path.append(("".join(run[: i - a]), "".join(run[i - a + 1 :])))
                i = at
            proof, h = "".join(a + z for a, z in path) + rest, other.hex()
            for a, z in path + over:
                h = hashlib.sha256((a + h + z).encode()).hexdigest()
            cells[0].append(hashlib.sha256(proof.encode()).hexdigest())
            cells[1].append(h)
            if proofs:
                cells[2].append([{"left": a, "right": z} for a, z in path + over])
        n = len(cells[0])
        subroot = above["subroot"][0].as_py()
        out = [pa.array(levels[0], pa.string()), pa.array([subroot] * n), pa.array([root] * n), pa.array(cells[0]), pa.array(cells[1]), pa.array([h == root for h in cells[1]])]
        if proofs:
            out.append(pa.array(cells[2], pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))))
        return pa.Table.from_arrays([one["kept"].combine_chunks(), *out], ["kept", *names])

    roots = staged(rows.groupBy("s", "block").applyInArrow(top, "s long, block long, blocks long, node string"))
    above = _butterfly(roots, groups, fanout).select("s", "block", "subroot", "root", "path")
    both = rows.groupBy("s", "block").cogroup(above.groupBy("s", "block")).applyInArrow(told, T.StructType([rows.schema["kept"], *made]))
    return unpacked(both, names)


def op11_manifest(spark, sf_dir: str) -> DataFrame:
    """Every document's leaf and proof. Where 2 divides the id's CRC-32, the tampered text has lost its line feeds."""
    text = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return manifest(read(spark, sf_dir, "documents"), keep=("doc_id",), changed={"text": text})


#: CRC-32 of a decimal number, bit by bit.
CRC_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, (a & 1) * 3988292384))), 4294967295)"""

OP11_SQL = """
WITH RECURSIVE d AS (SELECT *, CASE WHEN {crc} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS altered FROM documents),
l AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, {leaf} AS leaf, {other} AS other FROM d),
t AS (SELECT 0 AS lv, source, i, leaf AS h FROM l
  UNION ALL SELECT lv + 1, source, i // 3, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY source) AS n FROM t) WHERE n > 1 GROUP BY lv, source, i // 3),
s AS (SELECT source, max(lv) AS height, arg_max(h, lv) AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i FROM t GROUP BY source),
u AS (SELECT 0 AS lv, i, subroot AS h FROM s
  UNION ALL SELECT lv + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS n FROM u) WHERE n > 1 GROUP BY lv, i // 3),
a AS (SELECT l.doc_id, t.lv AS step, CASE WHEN t.i < l.i // (3 ** t.lv)::BIGINT THEN 0 WHEN t.i = l.i // (3 ** t.lv)::BIGINT THEN 1 ELSE 2 END AS side, t.i, t.h
  FROM l JOIN s ON s.source IS NOT DISTINCT FROM l.source JOIN t ON t.source IS NOT DISTINCT FROM l.source AND t.lv < s.height AND t.i // 3 = l.i // (3 ** (t.lv + 1))::BIGINT
  UNION ALL SELECT l.doc_id, 1000 + u.lv, CASE WHEN u.i < s.i // (3 ** u.lv)::BIGINT THEN 0 WHEN u.i = s.i // (3 ** u.lv)::BIGINT THEN 1 ELSE 2 END, u.i, u.h
  FROM l JOIN s ON s.source IS NOT DISTINCT FROM l.source JOIN u ON u.lv < (SELECT max(lv) FROM u) AND u.i // 3 = s.i // (3 ** (u.lv + 1))::BIGINT),
b AS (SELECT doc_id, step, coalesce(string_agg(h, '' ORDER BY i) FILTER (side = 0), '') AS x, coalesce(string_agg(h, '' ORDER BY i) FILTER (side = 2), '') AS y FROM a GROUP BY doc_id, step),
p AS (SELECT doc_id, string_agg(x || y, '' ORDER BY step) AS proof, list(x || '-' || y ORDER BY step) AS sides FROM b GROUP BY doc_id),
f AS (SELECT l.doc_id, leaf, subroot, (SELECT arg_max(h, lv) FROM u) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
  list_reduce(list_prepend(other, coalesce(sides, [])), lambda h, x: sha256(split_part(x, '-', 1) || h || split_part(x, '-', 2))) AS folded_root
  FROM l JOIN s ON s.source IS NOT DISTINCT FROM l.source LEFT JOIN p USING (doc_id))
SELECT *, folded_root = root AS verified FROM f
""".format(
    crc=CRC_SQL.format("doc_id"),
    **{n: "sha256(" + " || ".join(f"coalesce(strlen({v}::VARCHAR) || ':' || {v}, '-')" for v in (*FIELDS[:-1], t)) + ")" for n, t in (("leaf", "text"), ("other", "altered"))},
)
