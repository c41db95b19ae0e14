"""Tables of the shapes that the operators work on, derived from the given ones. VIEWS is SQL that Spark and DuckDB both
run; {re_all} and {date} stand for the two places where their dialects differ."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "dna": """SELECT doc_id, concat('D', doc_id, '.1') AS accession, translate(regexp_replace(lower(text), '[^a-z]', ''{re_all}), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTARYCGTACNGTACGTMAN') AS seq FROM documents""",
    "aln": """SELECT doc_id, concat('D', doc_id, '.1') AS accession, concat('Genus', doc_id % 13, ' species', doc_id % 5) AS organism, translate(concat(md5(concat(lang, doc_id % 65)), md5(text)), '0123456789abcdef', 'ACGTACGTACGTRYN-') AS seq FROM documents""",
    "info": """SELECT concat('D', doc_id, '.1') AS accession,
  CASE WHEN doc_id % 11 = 0 THEN concat('Genus', doc_id % 13, ' sp. ', doc_id % 7) WHEN doc_id % 17 = 0 THEN concat('Genus', doc_id % 13, ' x hybrid', doc_id % 5)
       WHEN doc_id % 9 = 0 THEN concat('Genus', doc_id % 13, ' species', doc_id % 5, ' var. alba') WHEN doc_id % 9 = 1 THEN concat('Genus', doc_id % 13, ' species', doc_id % 5, ' subsp. nova')
       ELSE concat('Genus', doc_id % 13, ' species', doc_id % 5) END AS organism,
  concat('Order', doc_id % 2, '|Family', doc_id % 4, '|Genus', doc_id % 13) AS lineage, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE concat('V', doc_id % 50) END AS specimen_voucher,
  CASE WHEN doc_id % 3 = 0 THEN 'Unpublished' ELSE concat('Journal ', doc_id % 8) END AS journal, {date} AS date FROM documents""",
    "hits": """SELECT concat('Q', l_orderkey % 7) AS query_acc, concat('S', l_orderkey % 400) AS subject_acc, concat(l_orderkey, '-', l_linenumber) AS hsp_id,
  CAST(1 + (l_partkey * 7) % 600 AS INT) AS q_start, CAST(41 + (l_partkey * 7) % 600 + (l_suppkey * 13) % 300 AS INT) AS q_end,
  CAST(CASE WHEN l_returnflag = 'R' THEN 5040 + (l_partkey * 11) % 900 + (l_suppkey * 13) % 300 ELSE 5000 + (l_partkey * 11) % 900 END AS INT) AS s_start,
  CAST(CASE WHEN l_returnflag = 'R' THEN 5000 + (l_partkey * 11) % 900 ELSE 5040 + (l_partkey * 11) % 900 + (l_suppkey * 13) % 300 END AS INT) AS s_end,
  CAST(41 + (l_suppkey * 13) % 300 AS INT) AS alignment_length, CAST(l_quantity AS INT) AS n_identity, CAST(l_extendedprice AS DOUBLE) AS bit_score, CAST(1 + l_suppkey % 4 AS INT) AS source_round FROM lineitem""",
    "rounds": """SELECT concat('Q', l_orderkey % 7) AS query_acc, concat('S', l_orderkey % 400) AS subject_acc, CAST(l_quantity AS INT) AS n_identity,
  CAST(1 + greatest((l_orderkey % 400) % 6, l_suppkey % 4) AS INT) AS source_round FROM lineitem""",
    "requests": """SELECT DISTINCT concat('Q', l_orderkey % 7) AS query_acc, CAST(900 + 50 * (l_orderkey % 7) AS INT) AS query_len FROM lineitem WHERE l_orderkey % 7 <> 3""",
    "located": """SELECT concat('D', doc_id, '.1') AS genome, CASE doc_id % 4 WHEN 0 THEN concat('complement(join(', 1 + doc_id % 5, '..', 9 + doc_id % 5, ',', 13 + doc_id % 5, '..', 19 + doc_id % 5, '))')
    WHEN 1 THEN concat('join(complement(', 1 + doc_id % 5, '..', 9 + doc_id % 5, '),', 13 + doc_id % 5, '..', 19 + doc_id % 5, ')')
    WHEN 2 THEN concat('join(', 1 + doc_id % 5, '..', 9 + doc_id % 5, ',', 13 + doc_id % 5, '..', 19 + doc_id % 5, ')')
    ELSE concat('complement(<', 1 + doc_id % 5, '..', 9 + doc_id % 5, ')') END AS location FROM documents""",
    "inserted": """SELECT concat('D', doc_id, '.1') AS accession, concat('Genus', doc_id % 13, ' species', doc_id % 5) AS organism,
  translate(concat(md5(concat(lang, doc_id % 65)), CASE WHEN doc_id % 61 = 0 THEN substr(md5(concat('i', doc_id)), 1, 24) ELSE repeat('f', 24) END, substr(md5(text), 1, 8)), '0123456789abcdef', 'ACGTACGTACGTRYN-') AS seq FROM documents""",
    "headers": """SELECT doc_id, concat('D', doc_id, '.1|', substr(text, 1, 40)) AS header FROM documents""",
    "genome_seqs": """SELECT concat('G', o_orderkey) AS genome, translate(concat(md5(concat('a', o_orderkey)), md5(concat('b', o_orderkey))), '0123456789abcdef', 'ACGTACGTACGTACGN') AS seq FROM orders""",
    "genomes": """SELECT concat('G', o_orderkey) AS genome, concat('Genus', o_custkey % 13, CASE WHEN o_orderkey % 19 = 0 THEN ' sp. ' WHEN o_orderkey % 29 = 0 THEN ' x species' ELSE ' species' END, o_custkey % 29) AS organism,
  CASE WHEN o_orderkey % 23 = 0 THEN 'UNVERIFIED' ELSE '.' END AS keywords, CAST(o_orderdate AS DATE) AS date, CASE WHEN o_orderpriority LIKE '1%' THEN '' ELSE concat('Journal ', o_custkey % 8) END AS journals,
  100000 + CAST(floor(o_totalprice) AS BIGINT) % 60000 AS length, o_custkey % 90 AS cds_count FROM orders""",
    "features": """SELECT concat('G', l_orderkey) AS genome, CASE WHEN l_linenumber % 5 = 4 THEN 'tRNA' WHEN l_linenumber % 5 = 0 THEN 'rRNA' WHEN l_linenumber % 2 = 0 THEN 'gene' ELSE 'CDS' END AS type,
  concat('gene', l_partkey % 20, CASE WHEN l_suppkey % 6 = 0 THEN 'S' ELSE '' END) AS gene_alias, l_partkey * 3 AS start_pos, l_partkey * 3 + 90 + (l_suppkey * 17) % 1500 AS end_pos, l_linenumber AS feature_no FROM lineitem""",
    "annotations": """SELECT concat('G', l_orderkey) AS genome, CASE WHEN l_linenumber % 5 = 4 THEN 'tRNA' WHEN l_linenumber % 5 = 0 THEN 'rRNA' WHEN l_linenumber % 3 = 2 THEN 'gene' ELSE 'CDS' END AS type,
  CASE WHEN l_partkey % 9 = 0 THEN NULL WHEN l_partkey % 13 = 0 THEN concat('orf', l_partkey % 20) ELSE concat('gene', l_partkey % 20, CASE WHEN l_suppkey % 6 = 0 THEN 'S' ELSE '' END) END AS gene_alias,
  CASE WHEN l_suppkey % 5 = 0 THEN 'hypothetical' WHEN l_suppkey % 5 = 1 THEN NULL ELSE concat('gene', l_suppkey % 20) END AS product, CAST(1 + l_partkey % 20 AS INT) AS a, CAST(l_suppkey % 4 AS INT) AS form,
  CASE l_suppkey % 4 WHEN 0 THEN concat('complement(join(', 1 + l_partkey % 20, '..', 9 + l_partkey % 20, ',', 13 + l_partkey % 20, '..', 19 + l_partkey % 20, '))')
    WHEN 1 THEN concat('join(complement(', 1 + l_partkey % 20, '..', 9 + l_partkey % 20, '),', 13 + l_partkey % 20, '..', 19 + l_partkey % 20, ')')
    WHEN 2 THEN concat('join(', 1 + l_partkey % 20, '..', 9 + l_partkey % 20, ',', 13 + l_partkey % 20, '..', 19 + l_partkey % 20, ')')
    ELSE concat('complement(<', 1 + l_partkey % 20, '..', 9 + l_partkey % 20, ')') END AS location FROM lineitem""",
    "backbone": """SELECT DISTINCT concat('Genus', doc_id % 13, ' species', doc_id % 5) AS name, CASE WHEN doc_id % 5 = 4 THEN concat('Genus', doc_id % 13, ' species0') ELSE concat('Genus', doc_id % 13, ' species', doc_id % 5) END AS accepted_name,
  'species' AS accepted_rank, CASE WHEN doc_id % 5 = 4 THEN 'Synonym' WHEN doc_id % 13 = 12 THEN 'No opinion' ELSE 'Accepted' END AS status FROM documents
  UNION ALL SELECT DISTINCT concat('Genus', doc_id % 13), concat('Genus', doc_id % 13), 'genus', 'Accepted' FROM documents""",
    "aliases": """SELECT concat('gene', k, s) AS gene_alias, concat('gene', k) AS gene FROM (SELECT DISTINCT l_partkey % 20 AS k FROM lineitem) a CROSS JOIN (SELECT '' AS s UNION ALL SELECT 'S') b""",
    "reference": """SELECT DISTINCT concat('gene', l_partkey % 20) AS gene, 600 + 10 * (l_partkey % 20) AS ref_len FROM lineitem WHERE l_partkey % 20 <> 7""",
    "markers": """SELECT concat('Genus', doc_id % 13, ' species', doc_id % 29) AS taxon, concat('m', doc_id % 5) AS marker, min(translate(concat(md5(text), md5(lang)), '0123456789abcdef', 'ACGTACGTACGTRYN-')) AS seq FROM documents GROUP BY 1, 2""",
}
#: As info, with vouchers and journals that are none in every form.
VIEWS["vouched"] = (
    VIEWS["info"]
    .replace("WHEN doc_id % 4 = 0 THEN NULL ELSE concat('V'", "WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 7 = 3 THEN 'unknown' WHEN doc_id % 7 = 4 THEN 'Unknown' ELSE concat('V'")
    .replace("WHEN doc_id % 3 = 0 THEN 'Unpublished'", "WHEN doc_id % 3 = 0 THEN 'Unpublished' WHEN doc_id % 15 = 1 THEN 'Unpublished (2019)' WHEN doc_id % 15 = 2 THEN 'Published Only in Database (2005) In press' WHEN doc_id % 15 = 4 THEN NULL WHEN doc_id % 15 = 5 THEN 'UNKNOWN'")
)
#: As aln, with rows that have no place in common and species of one record.
VIEWS["patchy"] = """SELECT doc_id, accession, CASE WHEN doc_id % 41 = 0 THEN concat('Lone', doc_id) ELSE organism END AS organism,
  CASE doc_id % 7 WHEN 0 THEN concat(substr(seq, 1, 24), repeat('-', 40)) WHEN 1 THEN concat(repeat('-', 40), substr(seq, 1, 24)) ELSE seq END AS seq FROM (@aln) a""".replace("@aln", VIEWS["aln"])
NEEDS = {"vouched": ["documents"], "patchy": ["documents"], "annotations": ["lineitem"], "aln": ["documents"], "dna": ["documents"], "info": ["documents"], "backbone": ["documents"], "markers": ["documents"], "hits": ["lineitem"], "rounds": ["lineitem"], "requests": ["lineitem"], "located": ["documents"], "inserted": ["documents"], "headers": ["documents"], "genome_seqs": ["orders"], "features": ["lineitem"], "aliases": ["lineitem"], "reference": ["lineitem"], "genomes": ["orders"]}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name].format(re_all="", date="date_add(DATE'2010-01-01', CAST(doc_id % 4000 AS INT))")
    return spark.sql(text.replace(f"FROM {NEEDS[name][0]}", "FROM {src}"), src=spark.read.parquet(f"{sf_dir}/{NEEDS[name][0]}.parquet"))


def duck(*names: str) -> str:
    """The views as the head of a DuckDB query."""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names).format(re_all=", 'g'", date="DATE '2010-01-01' + CAST(doc_id % 4000 AS INTEGER)")
