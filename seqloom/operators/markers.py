"""Many markers in one run: the marker is part of every key, so all of them share each step's shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions.names import accession, species_of_header
from seqloom.sources.files import write_fasta

from .alignment import extension_controlled
from .curate import reduced

MARKER = ("marker",)
CONTROL, REDUCE, BOTH = 1, 2, 3


def run(records: DataFrame, hits: DataFrame, action: int, *, threshold: float = 0.5, least: int = 0, min_records: int = 4) -> DataFrame:
    """Aligned records (marker, accession, header, organism, specimen_voucher, journal, date, seq) of all markers, curated:
    CONTROL cuts off extensions of mostly gaps, REDUCE keeps one record of each species and marker, BOTH does one after
    the other. hits (marker, accession, s_start, s_end, sum_hits_score, source_round) has each record's best hit.

    What a marker keeps does not depend on the others: ranks, consensus and duplicates are its own. After CONTROL alone
    sequences have no gaps; for REDUCE what is cut becomes gaps, so that rows stay aligned.
    """
    if action not in (CONTROL, REDUCE, BOTH):
        raise ValueError("the action is 1 (control), 2 (reduce) or 3 (both)")
    if action != REDUCE:
        records = extension_controlled(records, hits.select("marker", "accession", "s_start", "s_end"), threshold, MARKER, aligned=action == BOTH)
    if action == CONTROL:
        return records
    return reduced(records, hits.select("marker", "accession", "sum_hits_score", "source_round"), least, min_records, MARKER)


def aggregated(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(marker, header, seq) with the species as header, and (marker, accession, species), of records (marker, header, seq)
    whose header tells a species."""
    told = records.where(F.size(F.split("header", r"\|")) >= 2).select("marker", accession(F.col("header")).alias("accession"), F.trim(species_of_header(F.col("header"))).alias("species"), "seq")
    return told.select("marker", F.col("species").alias("header"), "seq"), told.select("marker", "accession", "species")


def write_aggregated(records: DataFrame, path: str) -> None:
    """A folder of FASTA and one of tables for each marker."""
    sequences, table = aggregated(records)
    write_fasta(sequences, f"{path}/fasta", "marker")
    table.repartition("marker").write.partitionBy("marker").option("header", True).csv(f"{path}/tables")
