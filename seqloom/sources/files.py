"""FASTA, GenBank, search-result XML, marker parameters and tables as DataFrames, and FASTA back to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.bases import location_parts
from seqloom.functions.names import accession, species_of_header

HIT = """Hit_id string, Hit_def string, Hit_accession string, Hit_hsps struct<Hsp: array<struct<`Hsp_bit-score`: double, Hsp_evalue: double,
  `Hsp_query-from`: int, `Hsp_query-to`: int, `Hsp_hit-from`: int, `Hsp_hit-to`: int, Hsp_identity: int, Hsp_gaps: int, `Hsp_align-len`: int>>>"""


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(file, header, seq) of every record; sequences may be wrapped."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_name").alias("file"), "value")
    return fasta_fields(raw.where("trim(regexp_replace(value, '^>', '')) != ''"), "value")


def fasta_fields(raw: DataFrame, record: str, *more: str) -> DataFrame:
    """(file, header, seq) of records' texts, and the columns named beside."""
    raw = raw.withColumn("v", F.regexp_replace(record, "^>", ""))
    return raw.select("file", F.trim(F.regexp_replace(F.split_part("v", F.lit("\n"), F.lit(1)), "\r", "")).alias("header"), F.regexp_replace(F.regexp_extract("v", r"(?s)^[^\n]*\n?(.*)$", 1), r"\s", "").alias("seq"), *more)


def markers(spark: SparkSession, path: str) -> DataFrame:
    """(marker, accession, species, header, seq) of the records of many markers' files; the marker is the file's name without
    its ending."""
    marker = F.regexp_replace("file", r"\.[^.]*$", "")
    return fasta(spark, path).select(marker.alias("marker"), accession(F.col("header")).alias("accession"), species_of_header(F.col("header")).alias("species"), "header", "seq")


def write_fasta(records: DataFrame, path: str, by: str | None = None) -> None:
    """One record a header line and a sequence line; a folder for each value of `by`."""
    lines = records.select(*([by] if by else []), F.concat(F.lit(">"), "header", F.lit("\n"), "seq").alias("value"))
    (lines.repartition(by).write.partitionBy(by) if by else lines.write).text(path)


def genbank(spark: SparkSession, path: str) -> DataFrame:
    """(file, accession, keywords, organism, date, journals, features, seq, has_body) of every record; features are arrays
    of (type, location, parts, qualifiers)."""
    raw = spark.read.option("lineSep", "\n//").text(path).select(F.col("_metadata.file_name").alias("file"), "value")
    return genbank_fields(raw.where(F.contains("value", F.lit("LOCUS"))), "value")


def genbank_fields(raw: DataFrame, record: str, *more: str) -> DataFrame:
    """The fields of records' texts, each up to the line that ends it, and the columns named beside."""
    raw = raw.withColumn("v", F.split_part(F.replace(record, F.lit("\r"), F.lit("")), F.lit("\n//"), F.lit(1)))
    block = F.regexp_extract("v", r"(?s)\nFEATURES[^\n]*\n(.*?)(?:\nORIGIN|$)", 1)
    chunks = F.regexp_extract_all(F.concat(F.lit("\n"), block), F.lit(r"(?s)\n {5}(\S.*?)(?=\n {5}\S|$)"), F.lit(1))

    def feature(c):
        head = F.regexp_replace(F.split_part(c, F.lit("\n                     /"), F.lit(1)), r"\s+", " ")
        location = F.replace(F.regexp_extract(head, r"^\S+ (.*)$", 1), F.lit(" "), F.lit(""))
        quals = F.transform(F.regexp_extract_all(c, F.lit(r'(?s)/(\w+="?.*?"?)(?=\n {21}/|$)'), F.lit(1)), lambda q: F.struct(F.split_part(q, F.lit("="), F.lit(1)).alias("name"), F.regexp_replace(F.regexp_replace(q, r'(?s)^\w+="?|"$', ""), r"\s+", " ").alias("value")))
        return F.struct(F.regexp_extract(c, r"^(\S+)", 1).alias("type"), location.alias("location"), location_parts(location).alias("parts"), quals.alias("qualifiers"))

    journals = F.filter(F.transform(F.regexp_extract_all("v", F.lit(r"(?s)\n  JOURNAL   (.*?)(?=\n {0,3}\S)"), F.lit(1)), lambda j: F.regexp_replace(j, r"\s+", " ")), lambda j: ~F.contains(j, F.lit("Unpublished")))
    origin = F.regexp_extract("v", r"(?s)\nORIGIN[^\n]*\n(.*)$", 1)
    return raw.select(
        "file", F.regexp_extract("v", r"ACCESSION\s+(\S+)", 1).alias("accession"), F.regexp_extract("v", r"KEYWORDS\s+([^\n]*)", 1).alias("keywords"), F.regexp_extract("v", r"ORGANISM\s+([^\n]*)", 1).alias("organism"),
        F.regexp_extract("v", r"LOCUS[^\n]*(\d{2}-[A-Z]{3}-\d{4})", 1).alias("date"), journals.alias("journals"), F.transform(chunks, feature).alias("features"), F.upper(F.regexp_replace(origin, r"[\s\d]", "")).alias("seq"), F.regexp_like("v", F.lit(r"(?m)^ORIGIN.*\n\s*\S")).alias("has_body"), *more,
    )


def hit_xml(spark: SparkSession, path: str) -> DataFrame:
    """One row for each HSP of each definition of a hit; the request id is the file name's."""
    hits = spark.read.option("rowTag", "Hit").schema(HIT).xml(path)
    h = hits.select(F.regexp_extract(F.input_file_name(), r"([^/]+)_XML\.txt$", 1).alias("rid"), F.posexplode(F.split("Hit_def", " ?>")).alias("no", "hit_def"), F.col("Hit_id").alias("hit_id"), F.col("Hit_hsps.Hsp").alias("hsps"))
    h = h.where((F.col("no") == 0) | (F.size(F.split("hit_def", r"\|")) == 5)).select("rid", "hit_id", "hit_def", "no", F.explode("hsps").alias("h"))
    take = {"q_start": "Hsp_query-from", "q_end": "Hsp_query-to", "s_start": "Hsp_hit-from", "s_end": "Hsp_hit-to", "n_identity": "Hsp_identity", "gap_opens": "Hsp_gaps", "alignment_length": "Hsp_align-len", "evalue": "Hsp_evalue", "bit_score": "Hsp_bit-score"}
    return h.select("rid", "hit_id", "hit_def", *(F.col("h").getField(f).alias(n) for n, f in take.items()))


def marker_parameters(spark: SparkSession, path: str) -> DataFrame:
    """(file, params): a map of each file's keys to lists, split at bars, semicolons and commas."""
    rows = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.split("value", "\t").alias("p")).where("size(p) >= 2")
    return rows.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct(F.trim(F.col("p")[0]), F.transform(F.split(F.col("p")[1], r"[|;,]"), lambda x: F.trim(x))))).alias("params"))


def table(spark: SparkSession, path: str, schema: str, sep: str = "\t") -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("sep", sep).csv(path)


def write_table(rows: DataFrame, path: str, sep: str = ",") -> None:
    rows.write.option("header", True).option("sep", sep).csv(path)


def accession_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("accession")).where("accession != ''")


def split_rejects(rows: DataFrame, reason: str = "reject_reason") -> tuple[DataFrame, DataFrame]:
    return rows.where(F.col(reason).isNull()).drop(reason), rows.where(F.col(reason).isNotNull())
