"""Markers joined to one partitioned matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.sources.files import write_fasta

from .alignment import boundary_trim, gap_trimmed
from .curate import first_of


def replaced(primary: DataFrame, secondary: DataFrame, key: str | list = "taxon") -> DataFrame:
    """All primary rows, and the secondary ones of taxa that the primary lacks."""
    keys = [key] if isinstance(key, str) else key
    return primary.unionByName(secondary.join(primary.select(*keys).distinct(), keys, "left_anti"))


def length_status(markers: DataFrame) -> DataFrame:
    """Of each marker its sequences' common length, or -1 where they differ."""
    n = F.length("seq")
    return markers.groupBy("marker").agg(F.when(F.min(n) == F.max(n), F.min(n)).otherwise(-1).alias("status"))


def completed(markers: DataFrame) -> DataFrame:
    """Every taxon with every marker; gaps of the marker's length where it has none, three where its lengths differ. A
    marker of empty sequences goes. The grid is the result's own size: each taxon is exploded by the list of markers,
    which is a small one."""
    n = F.length("seq")
    per = markers.groupBy("marker").agg(F.when(F.min(n) == F.max(n), F.min(n)).otherwise(3).alias("n")).where("n > 0")
    lists = per.agg(F.array_sort(F.collect_list(F.struct("marker", "n"))).alias("all"))
    grid = markers.select("taxon").distinct().join(F.broadcast(lists)).select("taxon", F.explode("all").alias("m")).select("taxon", "m.marker", "m.n")
    return grid.join(markers, ["taxon", "marker"], "left").select("taxon", "marker", F.coalesce("seq", F.repeat(F.lit("-"), F.col("n"))).alias("seq"))


def refuse_uneven(complete: DataFrame) -> DataFrame:
    """complete, or an error where a marker's sequences differ in length, lacks a taxon or has one twice."""
    n = F.length("seq")
    per = complete.groupBy("marker").agg(F.min(n).alias("lo"), F.max(n).alias("hi"), F.count("*").alias("n"), F.countDistinct("taxon").alias("taxa"))
    taxa = complete.select("taxon").distinct().count()
    if bad := [r.marker for r in per.where((F.col("lo") != F.col("hi")) | (F.col("n") != taxa) | (F.col("taxa") != taxa)).orderBy("marker").limit(20).collect()]:
        raise ValueError(f"not aligned, or not of all taxa: {', '.join(bad)}")
    return complete


def matrix(primary: DataFrame, secondary: DataFrame, threshold: float = 0.025, gt: float | None = None, cons: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(joined, parts): primary markers (marker, taxon, seq) filled up from secondary ones, ends trimmed by their gaps, or,
    with `gt`, columns by gap_trimmed(), names without spaces, the first of equal names, every taxon with every marker,
    joined in order of marker; and where each marker lies."""
    rows = replaced(primary, secondary, ["marker", "taxon"]).withColumn("accession", F.col("taxon"))
    trimmed = (boundary_trim(rows, "marker", threshold) if gt is None else gap_trimmed(rows, "marker", gt, cons)).withColumn("taxon", F.replace("taxon", F.lit(" "), F.lit("_")))
    complete = refuse_uneven(completed(first_of(trimmed, ["marker", "taxon"], ["accession"]).select("marker", "taxon", "seq")))
    return concatenated(complete), partitions(complete)


def partitions(markers: DataFrame) -> DataFrame:
    """Start and end of each marker in the joined sequence, markers in order of name."""
    per = markers.groupBy("marker").agg(F.max(F.length("seq")).alias("n"))
    upto = F.sum("n").over(W.orderBy("marker").rowsBetween(W.unboundedPreceding, 0))  # a row a marker
    return per.select("marker", (upto - F.col("n") + 1).alias("start"), upto.alias("end"))


def concatenated(complete: DataFrame) -> DataFrame:
    return complete.groupBy("taxon").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("marker", "seq"))), lambda x: x["seq"]), "").alias("seq"))


def partition_lines(parts: DataFrame, by_codon: bool = False) -> DataFrame:
    """Lines of a partition file; a marker's three codon positions apart if asked for."""
    if not by_codon:
        return parts.select(F.format_string("DNA, %s = %d-%d", "marker", "start", "end").alias("line"))
    p = parts.withColumn("k", F.explode(F.array(*map(F.lit, (0, 1, 2)))))
    return p.select(F.format_string("DNA, %s_pos%d = %d-%d\\3", "marker", F.col("k") + 1, F.col("start") + F.col("k"), "end").alias("line"))


def write_matrix(joined: DataFrame, parts: DataFrame, path: str) -> None:
    """The matrix as PHYLIP and FASTA, and its partitions by marker and by codon position, in a folder each. Rows of
    different lengths are refused before anything is written."""
    phylip = phylip_lines(joined)
    phylip.coalesce(1).write.text(f"{path}/phylip")  # one file, as its header has to come first
    write_fasta(joined.select(F.col("taxon").alias("header"), "seq"), f"{path}/fasta")
    for name, by_codon in (("partitions", False), ("codons", True)):
        partition_lines(parts, by_codon).coalesce(1).write.text(f"{path}/{name}")


def phylip_lines(matrix: DataFrame) -> DataFrame:
    """Header and rows in order; rejects rows of different lengths."""
    size = matrix.agg(F.count("*").alias("n"), F.min(F.length("seq")).alias("lo"), F.max(F.length("seq")).alias("hi")).first()
    if size["lo"] != size["hi"]:
        raise ValueError("sequences are not aligned")
    rows = matrix.select(F.lit(1).alias("o"), "taxon", F.concat_ws(" ", "taxon", "seq").alias("line"))
    head = matrix.sparkSession.createDataFrame([(0, "", f" {size['n']}  {size['lo']}")], rows.schema)
    return head.unionByName(rows).orderBy("o", "taxon").select("line")
