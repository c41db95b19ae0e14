"""Species names against a backbone of accepted names."""

from __future__ import annotations

from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def segments(length: int, least: float) -> list[tuple[int, int]]:
    """(start, size) of the pieces of a name of so many letters, one more than edits it may differ by from a name that it
    scores `least` with: one of the pieces is then in that name, unchanged."""
    pieces = int((1 - least) * length / least + 1e-9) + 1
    size, more = divmod(length, pieces)
    out, at = [], 0
    for k in range(pieces):
        out.append((at, size + (k >= pieces - more)))
        at += out[-1][1]
    return out


def _pieces(name: str, least: float):
    """Keys of a name of the backbone: its length, a piece's number and the piece."""
    return ((len(name), k, name[a : a + n]) for k, (a, n) in enumerate(segments(len(name), least)))


def _probes(name: str, least: float):
    """Keys of all pieces, near their places, of names that may score `least` with this one."""
    size = len(name)
    for length in range(max(1, ceil(least * size - 1e-9)), int(size / least + 1e-9) + 1):
        off = int((1 - least) * max(size, length) + 1e-9)
        for k, (a, n) in enumerate(segments(length, least)):
            for at in range(max(0, a - off), min(size - n, a + off) + 1):
                yield length, k, name[at : at + n]


def near_names(submitted: DataFrame, names: DataFrame, least: float) -> DataFrame:
    """(name_submitted, name, score) of every pair with 1 - edit distance / the longer length of `least` or more.

    Only names that share a piece at about its place, and as long as they may be, are compared: with few edits one of
    a name's pieces is left as it is. `least` must be over 0.5; nulls and blank names have no match.
    """
    if not 0.5 < least <= 1:
        raise ValueError("the least score must be over 0.5")

    def keyed(rows: DataFrame, column: str, keys) -> DataFrame:
        def run(batches):
            for b in batches:
                got = [(x, *k) for x in b[0].to_pylist() for k in dict.fromkeys(keys(x, least))]
                cells = list(zip(*got, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.string(), pa.int32(), pa.int32(), pa.string()), strict=True)], [column, "l", "k", "piece"])

        return rows.select(column).where(F.length(column) > 0).distinct().mapInArrow(run, f"{column} string, l int, k int, piece string")

    met = keyed(submitted, "name_submitted", _probes).join(keyed(names, "name", _pieces), ["l", "k", "piece"]).select("name_submitted", "name").distinct()
    longer = F.greatest(F.length("name_submitted"), F.length("name"))
    return met.withColumn("score", 1 - F.levenshtein("name_submitted", "name") / longer).where(F.col("score") >= least - 1e-12)


def resolved(submitted: DataFrame, backbone: DataFrame, matches: str = "best", least: float = 0.0, block=lambda name: F.substring_index(name, " ", 1)) -> DataFrame:
    """(name_submitted, accepted_name, accepted_rank, status, score): exact matches score 1; what has none is compared with
    the names of its block, its genus if nothing else is said, 1 - edit distance / the longer length. With block=None it is compared
    with all names by near_names(), and `least` must be over 0.5. The best of each name (ties by name), or all."""
    s = submitted.select(F.trim(F.replace("name", F.lit("|"), F.lit(""))).alias("name_submitted")).distinct()
    b = backbone.select("name", "accepted_name", "accepted_rank", "status")
    exact = s.join(b, s.name_submitted == b.name).withColumn("score", F.lit(1.0))
    open_ = s.join(b, s.name_submitted == b.name, "left_anti")
    if block is None:
        near = near_names(open_, b, least).join(b, "name")
    else:
        near = open_.withColumn("g", block(F.col("name_submitted"))).join(b.withColumn("g", block(F.col("name"))), "g").drop("g")
        near = near.withColumn("score", 1 - F.levenshtein("name_submitted", "name") / F.greatest(F.length("name_submitted"), F.length("name")))
    out = exact.unionByName(near.select(exact.columns)).where(F.col("score") >= least)
    if matches == "best":
        out = out.withColumn("_n", F.row_number().over(W.partitionBy("name_submitted").orderBy(F.desc("score"), "name"))).where("_n = 1").drop("_n")
    return out.select("name_submitted", F.col("name").alias("name_matched"), "accepted_name", "accepted_rank", "status", "score")


def rechecked(submitted: DataFrame, backbone: DataFrame, found: DataFrame, least: float) -> DataFrame:
    """found, and in place of results that score under `least`, over 0.5, and of names without any, the best among all
    names of the backbone; what still scores less goes."""
    good = found.where(F.col("score") >= least)
    names = submitted.select(F.trim(F.replace("name", F.lit("|"), F.lit(""))).alias("name_submitted")).distinct()
    again = names.join(good.select("name_submitted"), "name_submitted", "left_anti").select(F.col("name_submitted").alias("name"))
    return good.unionByName(resolved(again, backbone, least=least, block=None))


def accepted(found: DataFrame, accuracy: float = 0.9, genus_too: bool = False) -> DataFrame:
    ok = (F.col("score") >= accuracy) & (F.coalesce("accepted_name", F.lit("")) != "") & F.col("status").isin("Accepted", "Synonym")
    return found.where(ok if genus_too else ok & (F.col("accepted_rank") != "genus"))


def substituted(records: DataFrame, found: DataFrame, how: str = "left") -> DataFrame:
    """Records with the accepted name as organism; unresolved ones have none, or go with how='inner'."""
    names = found.select(F.col("name_submitted").alias("_n"), F.col("accepted_name").alias("_a"))
    return records.withColumn("_t", F.trim("organism")).join(names, F.col("_t") == F.col("_n"), how).withColumn("organism", F.col("_a")).drop("_t", "_n", "_a")


def synonyms(backbone: DataFrame, name: str) -> DataFrame:
    return backbone.where((F.col("accepted_name") == name) & (F.col("name") != name)).select("name")
