"""The registered queries of the library's own operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.functions import bases, names
from seqloom.operators import alignment, curate, genomes, graph, hits, markers, resolve, select, supermatrix

from .views import duck, view

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Reference and maximum length of the hits view.
QLEN, MAXLEN = 1000, 1200


def query(name: str, *views: str, sql: str | None = None):
    """Registers a function of the views as a query, with the SQL that follows their definitions."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(*(view(spark, sf_dir, v) for v in views))
        if sql:
            SQL[name] = duck(*views) + sql
        return f

    return add


@query("header_fields", "info", sql="""
SELECT accession, header, replace(organism, ' ', '_') AS species, CAST(regexp_extract(header, ':([0-9]+)-', 1) AS INT) AS first, CAST(regexp_extract(header, ':[0-9]+-([0-9]+)', 1) AS INT) AS last, accession LIKE 'D%7.1' AS reversed,
  regexp_replace(header, ':[0-9]+-[0-9]+', ':5-9') AS moved
FROM (SELECT accession, organism, concat(accession, ':', greatest(1, len(organism) - 15), '-', greatest(1, len(organism) - 15) + len(lineage) - 1, CASE WHEN accession LIKE '%7.1' THEN '_reverse_complement' ELSE '' END, '|', replace(organism, ' ', '_'), '|', journal) AS header FROM info)""")
def header_fields(info):
    h = info.withColumn("header", names.compose(F.col("accession"), F.length("organism") - 15, F.col("lineage"), F.col("accession").like("%7.1"), F.col("organism"), F.col("journal")))
    first, last, back = names.header_range(F.col("header"))
    return h.select(names.accession(F.col("header")).alias("accession"), "header", names.species_of_header(F.col("header")).alias("species"), first.alias("first"), last.alias("last"), back.alias("reversed"), names.with_range(F.col("header"), F.lit(5), F.lit(9)).alias("moved"))


@query("species_core", "info", sql="""
SELECT accession, trim(regexp_replace(lower(organism), '(^| )(var\\.|subsp\\.|ssp\\.|f\\.|fma\\.|x)( .*)?$', '')) AS core FROM info""")
def species_core(info):
    return info.select("accession", names.species_core(F.col("organism")).alias("core"))


@query("infraspecific_merge", "info", sql="""
SELECT accession, CASE WHEN contains(organism, ' subsp. ') THEN split_part(organism, ' subsp. ', 1) WHEN contains(organism, ' var. ') THEN split_part(organism, ' var. ', 1) ELSE organism END AS organism FROM info""")
def infraspecific_merge(info):
    return info.select("accession", names.merged(names.without_apostrophes(F.col("organism"))).alias("organism"))


@query("lineage_units", "vouched", sql="""
SELECT accession, split_part(lineage, '|', 3) AS genus, split_part(lineage, '|', 2) AS parent, journal IS NOT NULL AND NOT regexp_matches(lower(journal), 'unknown|unpublished|published only in database') AS published, split_part(organism, ' ', 1) || ' ' || split_part(organism, ' ', 2) AS two_words FROM vouched""")
def lineage_units(info):
    parts = F.split("lineage", r"\|")
    return info.select("accession", names.genus_of(parts).alias("genus"), names.parent_unit(parts, names.genus_of(parts)).alias("parent"), names.published(F.col("journal")).alias("published"), names.first_two_words(F.col("organism")).alias("two_words"))


@query("parsed_dates", "info", sql="""
SELECT accession, date AS day, CAST(NULL AS DATE) AS broken FROM info""")
def parsed_dates(info):
    text = F.when(F.pmod(F.length("accession"), F.lit(2)) == 0, F.date_format("date", "dd-MMM-yyyy")).otherwise(F.date_format("date", "dd/MM/yyyy"))
    return info.select("accession", names.parsed_date(text).alias("day"), names.parsed_date(F.col("journal")).alias("broken"))


@query("base_composition", "dna", sql="""
SELECT accession, len(regexp_replace(seq, '[^ACGT]', '', 'g')) AS n_plain, len(seq) - len(regexp_replace(seq, '[^ACGT]', '', 'g')) AS n_other, len(regexp_replace(seq, '[RYKMSWBDHVN-]', '', 'g')) AS n_unambiguous,
  CASE WHEN len(seq) > 0 THEN round(1 - len(regexp_replace(seq, '[^ACGT]', '', 'g')) / len(seq), 9) END AS other_ratio FROM dna""")
def base_composition(dna):
    n, plain = F.length("seq"), bases.n_plain(F.col("seq"))
    return dna.select("accession", plain.cast("bigint").alias("n_plain"), (n - plain).cast("bigint").alias("n_other"), bases.n_unambiguous(F.col("seq")).cast("bigint").alias("n_unambiguous"), F.when(n > 0, F.round(1 - plain / n, 9)).alias("other_ratio"))


@query("reverse_complement", "dna", sql="""
SELECT accession, reverse(translate(seq, 'ACGTRYMN', 'TGCAYRKN')) AS rc FROM dna""")
def reverse_complement(dna):
    return dna.select("accession", bases.reverse_complement(F.col("seq")).alias("rc"))


CHAIN = """, r AS (SELECT *, row_number() OVER (PARTITION BY query_acc, subject_acc ORDER BY bit_score DESC, alignment_length DESC, n_identity DESC, s_start, q_start, hsp_id) AS n,
  CASE WHEN s_end > s_start THEN 1 ELSE -1 END AS sd, CASE WHEN q_end > q_start THEN 1 ELSE -1 END AS qd FROM hits),
seed AS (SELECT query_acc, subject_acc, hsp_id AS seed_id, s_start AS s1, s_end AS s2, q_start AS q1, q_end AS q2, sd AS sd0, qd AS qd0 FROM r WHERE n = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY query_acc, subject_acc ORDER BY n) AS m FROM r JOIN seed USING (query_acc, subject_acc) WHERE sd = sd0 AND qd = qd0 AND sign(q_start - q1) = sign(q_end - q2)
  AND sign(s_start - s1) = sign(s_end - s2) AND sign(s_start - s1) * sd * qd = sign(q_start - q1)),
w AS (SELECT query_acc, subject_acc, CAST(1 AS BIGINT) AS m, s1 AS ss, s2 AS se, q1 AS qs, q2 AS qe FROM seed UNION ALL
  SELECT query_acc, subject_acc, m, CASE WHEN ok THEN ns ELSE ss END, CASE WHEN ok THEN ne ELSE se END, CASE WHEN ok AND ns <> ss THEN q_start ELSE qs END, CASE WHEN ok AND ne <> se THEN q_end ELSE qe END
  FROM (SELECT *, abs(ns - ne) + 1 <= 1050 AS ok FROM (SELECT w.query_acc, w.subject_acc, k.m, ss, se, qs, qe, q_start, q_end, CASE WHEN (s_start - ss) * sd < 0 THEN s_start ELSE ss END AS ns, CASE WHEN (s_end - se) * sd > 0 THEN s_end ELSE se END AS ne
    FROM w JOIN k ON w.query_acc = k.query_acc AND w.subject_acc = k.subject_acc AND k.m = w.m + 1))),
sums AS (SELECT query_acc, subject_acc, count(*) AS hits_num, sum(alignment_length) AS sum_hits_alignlen, round(sum(bit_score), 2) AS sum_hits_score FROM k GROUP BY 1, 2),
chained AS (SELECT query_acc, subject_acc, seed_id AS hsp_id, qs AS q_start, qe AS q_end, ss AS s_start, se AS s_end, qd0 > 0 AS q_strand, sd0 > 0 AS s_strand, CAST(hits_num AS INT) AS hits_num, CAST(sum_hits_alignlen AS BIGINT) AS sum_hits_alignlen, sum_hits_score
  FROM sums JOIN w USING (query_acc, subject_acc) JOIN seed USING (query_acc, subject_acc) WHERE m = hits_num)"""


def _chained(h):
    return hits.chain(h, MAXLEN, F.lit(QLEN)).withColumn("sum_hits_score", F.round("sum_hits_score", 2))


@query("hsp_chain", "hits", sql=CHAIN + "SELECT * FROM chained")
def hsp_chain(h):
    return _chained(h)


@query("extend_hits", "hits", sql=CHAIN + """, best AS (SELECT *, q_start - 1 AS l, greatest(1000 - q_end, 0) AS r, 1200 - abs(s_end - s_start) - 1 AS budget FROM chained
  QUALIFY row_number() OVER (PARTITION BY subject_acc ORDER BY sum_hits_score DESC, sum_hits_alignlen DESC, query_acc) = 1),
y AS (SELECT *, CAST(floor(l * CASE WHEN l + r > budget THEN greatest(budget, 0) / (l + r) ELSE 1.0 END) AS INT) AS extension_left, CAST(floor(r * CASE WHEN l + r > budget THEN greatest(budget, 0) / (l + r) ELSE 1.0 END) AS INT) AS extension_right FROM best),
z AS (SELECT *, greatest(1, CASE WHEN s_start <= s_end THEN s_start - extension_left ELSE s_start + extension_left END) AS a, greatest(1, CASE WHEN s_start <= s_end THEN s_end + extension_right ELSE s_end - extension_right END) AS b FROM y)
SELECT query_acc, subject_acc, hsp_id, hits_num, sum_hits_score, s_start, s_end, extension_left, extension_right, least(a, b) AS first, greatest(a, b) AS last, CASE WHEN a <= b THEN 1 ELSE 2 END AS strand FROM z""")
def extend_hits(h):
    out = hits.fetch_range(hits.extend(hits.best_per_subject(_chained(h)), F.lit(QLEN), MAXLEN))
    return out.select("query_acc", "subject_acc", "hsp_id", "hits_num", "sum_hits_score", "s_start", "s_end", "extension_left", "extension_right", F.col("start").alias("first"), F.col("end").alias("last"), "strand")


@query("query_lengths", "hits", "requests", sql="SELECT hsp_id, query_acc, query_len FROM hits JOIN requests USING (query_acc)")
def query_lengths(h, requests):
    return hits.with_length(h, requests).select("hsp_id", "query_acc", "query_len")


SUMS = """, sums AS (SELECT query_acc, subject_acc, sum(alignment_length) AS sum_hits_alignlen, round(sum(bit_score), 2) AS sum_hits_score, min(source_round) AS source_round FROM hits GROUP BY 1, 2)"""


def _sums(h):
    return h.groupBy("query_acc", "subject_acc").agg(F.sum("alignment_length").alias("sum_hits_alignlen"), F.round(F.sum("bit_score"), 2).alias("sum_hits_score"), F.min("source_round").alias("source_round"))


@query("best_hit_per_subject", "hits", sql=SUMS + """
SELECT query_acc, subject_acc, CAST(sum_hits_alignlen AS BIGINT) AS sum_hits_alignlen, sum_hits_score, source_round FROM sums QUALIFY row_number() OVER (PARTITION BY subject_acc ORDER BY sum_hits_score DESC, sum_hits_alignlen DESC, query_acc) = 1""")
def best_hit_per_subject(h):
    return hits.best_per_subject(_sums(h))


@query("extension_arithmetic", "hits", sql="""
, x AS (SELECT *, q_start - 1 AS l, greatest(1000 - q_end, 0) AS r, 1200 - abs(s_end - s_start) - 1 AS budget FROM hits),
y AS (SELECT *, CAST(floor(l * CASE WHEN l + r > budget THEN greatest(budget, 0) / (l + r) ELSE 1.0 END) AS INT) AS el, CAST(floor(r * CASE WHEN l + r > budget THEN greatest(budget, 0) / (l + r) ELSE 1.0 END) AS INT) AS er FROM x)
SELECT hsp_id, abs(s_end - s_start) + 1 AS hit_len, 1200 - abs(s_end - s_start) - 1 AS max_extension, l AS auto_extension_left, r AS auto_extension_right, 0 AS extra_extension_left, 0 AS extra_extension_right, q_start - el AS q_extstart, q_end + er AS q_extend, el AS extension_left, er AS extension_right, greatest(1, CASE WHEN s_start <= s_end THEN s_start - el ELSE s_start + el END) AS s_extstart, greatest(1, CASE WHEN s_start <= s_end THEN s_end + er ELSE s_end - er END) AS s_extend FROM y""")
def extension_arithmetic(h):
    return hits.extend(h, F.lit(QLEN), MAXLEN).select("hsp_id", "hit_len", "max_extension", *(f"{a}_extension_{b}" for a in ("auto", "extra") for b in ("left", "right")), "q_extstart", "q_extend", "extension_left", "extension_right", "s_extstart", "s_extend")


@query("iqr_band", "hits", sql=SUMS + """
, q AS (SELECT query_acc, quantile_cont(sum_hits_score, 0.25) AS a, quantile_cont(sum_hits_score, 0.75) AS b FROM sums GROUP BY 1)
SELECT query_acc, subject_acc, sum_hits_score FROM sums JOIN q USING (query_acc) WHERE sum_hits_score BETWEEN a AND b""")
def iqr_band(h):
    return hits.quartile_band(_sums(h)).select("query_acc", "subject_acc", "sum_hits_score")


@query("hash_sample", "hits", sql=SUMS + """
SELECT query_acc, subject_acc FROM sums QUALIFY row_number() OVER (PARTITION BY query_acc ORDER BY md5('1' || subject_acc), subject_acc) <= 5""")
def hash_sample(h):
    return hits.sampled(_sums(h), "query_acc", "subject_acc", 5).select("query_acc", "subject_acc")


@query("new_accessions", "rounds", sql="""
SELECT DISTINCT subject_acc FROM rounds WHERE source_round = 4 AND subject_acc NOT IN (SELECT subject_acc FROM rounds WHERE source_round < 4)""")
def new_accessions(r):
    return hits.new_accessions(r.where("source_round = 4"), r.where("source_round < 4"))


ROUNDS = """, f AS (SELECT subject_acc, min(source_round) AS source_round, max(CASE WHEN n_identity >= 48 THEN 1 ELSE 0 END) AS ok FROM rounds GROUP BY 1),
p AS (SELECT source_round, count(*) AS n_new, sum(ok) AS n_passing FROM f GROUP BY 1), s AS (SELECT *, sum(n_new) OVER (ORDER BY source_round) AS n_total, lag(n_passing) OVER (ORDER BY source_round) AS prev FROM p)"""
STOPS = ROUNDS + """, t AS (SELECT *, n_total > 1.2 * 200 OR (n_passing < 3 AND coalesce(prev < 3, false)) AS stops FROM s)"""


@query("round_summary", "rounds", sql=ROUNDS + " SELECT source_round, n_new, CAST(n_passing AS BIGINT) AS n_passing, CAST(n_total AS BIGINT) AS n_total FROM s")
def round_summary(r):
    return hits.round_summary(r, F.col("n_identity") >= 48)


@query("saturation", "rounds", sql=STOPS + """
SELECT source_round, n_new, CAST(n_passing AS BIGINT) AS n_passing, CAST(n_total AS BIGINT) AS n_total, stops FROM t WHERE source_round <= coalesce((SELECT min(source_round) FROM t WHERE stops), 99)""")
def saturation(r):
    return hits.saturation(r, F.col("n_identity") >= 48, 200)


@query("mining_rounds", "rounds", sql="""
, f AS (SELECT subject_acc, min(source_round) AS source_round FROM rounds GROUP BY 1), o AS (SELECT subject_acc, source_round, max(n_identity) >= 48 AS ok FROM f JOIN rounds USING (subject_acc, source_round) GROUP BY 1, 2),
p AS (SELECT source_round, count(*) AS n_new, count(*) FILTER (ok) AS n_passing FROM o GROUP BY 1), s AS (SELECT *, sum(n_new) OVER (ORDER BY source_round) AS n_total, lag(n_passing) OVER (ORDER BY source_round) AS prev FROM p)
SELECT subject_acc, source_round, ok FROM o WHERE source_round <= coalesce((SELECT min(source_round) FROM s WHERE n_total > 1.2 * 200 OR (n_passing < 3 AND coalesce(prev < 3, false))), 99)""")
def mining_rounds(r):
    return hits.mined(lambda n, found: r.where(F.col("source_round") == n) if n <= 6 else None, F.col("n_identity") >= 48, 200, cut=graph.cut)


BAND = CHAIN + """, q AS (SELECT query_acc, quantile_cont(sum_hits_score, 0.25) AS a, quantile_cont(sum_hits_score, 0.75) AS b FROM chained GROUP BY 1),
band AS (SELECT chained.* FROM chained JOIN q USING (query_acc) WHERE sum_hits_score BETWEEN a AND b)"""


@query("radius_edges", "hits", sql=BAND + """
SELECT a.query_acc, a.hsp_id AS i, b.hsp_id AS j FROM band a JOIN band b ON a.query_acc = b.query_acc AND a.hsp_id < b.hsp_id WHERE (a.q_start - b.q_start) ** 2 + (a.q_end - b.q_end) ** 2 <= 10000""")
def radius_edges(h):
    return hits.radius_edges(hits.quartile_band(_chained(h)), F.lit(QLEN), 0.1)


def _used(h):
    """Subjects that were queries before, and a query of two hits alone."""
    return h.where("subject_acc LIKE '%7'").select("subject_acc").distinct(), h.where("query_acc != 'Q5' OR subject_acc IN ('S5', 'S12', 'S26')")


@query("position_clusters", "hits")
def position_clusters(h):
    used, open_ = _used(h)
    return select.position_clusters(_chained(open_), F.lit(QLEN), used).select("query_acc", "cluster", "hsp_id", "subject_acc")


@query("position_representatives", "hits")
def position_representatives(h):
    used, open_ = _used(h)
    return select.position_representatives(_chained(open_), F.lit(QLEN), used).select("query_acc", "cluster", "hsp_id", "subject_acc", "sum_hits_alignlen", "sum_hits_score")


@query("annotation_filter", "info", sql="""
SELECT accession FROM info WHERE NOT (contains(lower(replace(organism, ' ', '')), 'hybrid') OR contains(lower(replace(journal, ' ', '')), 'hybrid') OR contains(lower(replace(organism, ' ', '')), 'sp.0') OR contains(lower(replace(journal, ' ', '')), 'sp.0'))
  AND (contains(lower(replace(organism, ' ', '')), 'species') OR contains(lower(replace(journal, ' ', '')), 'journal5') OR contains(lower(replace(organism, ' ', '')), 'journal5'))""")
def annotation_filter(info):
    return info.where(curate.annotation_passes(F.array("organism", "journal"), ["Species", "journal 5"], ["hybrid", "sp. 0"])).select("accession")


@query("taxonomy_whitelist", "info", sql="""
SELECT accession FROM info WHERE lower(split_part(lineage, '|', 3)) = 'genus3' OR lower(split_part(lineage, '|', 2)) = 'genus3' OR trim(regexp_replace(lower(organism), '(^| )(var\\.|subsp\\.|ssp\\.|f\\.|fma\\.|x)( .*)?$', '')) IN ('genus5 species1', 'genus3')""")
def taxonomy_whitelist(info):
    return info.where(curate.taxonomy_passes(F.split("lineage", r"\|"), F.col("organism"), ["Genus3", "Genus5 species1"])).select("accession")


@query("exceptional_names", "info", sql="""
SELECT accession, organism FROM info WHERE NOT regexp_matches(organism, ' (sp\\.|sp|cf\\.|cf|aff\\.|aff|x\\.|x)( |$)')""")
def exceptional_names(info):
    return info.where(~names.exceptional(F.col("organism"))).select("accession", "organism")


@query("low_quality", "dna", sql="""
, n AS (SELECT accession, seq, len(regexp_replace(seq, '[^ACGT]', '', 'g')) AS p FROM dna), r AS (SELECT DISTINCT seq AS s FROM dna WHERE accession LIKE '%5.1')
SELECT accession, CASE WHEN p < 160 THEN 'short' WHEN p < 0.995 * len(seq) THEN 'ambiguous' WHEN s IS NOT NULL THEN 'duplicate' END AS reject_reason FROM n LEFT JOIN r ON seq = s""")
def low_quality(dna):
    return curate.low_quality(dna, 800, dna.where("accession LIKE '%5.1'")).select("accession", "reject_reason")


RECORDS = """, rec AS (SELECT i.accession, i.organism, i.specimen_voucher, i.journal, i.date, d.seq, d.doc_id FROM info i JOIN dna d USING (accession))"""


def _records(info, dna):
    return info.select("accession", "organism", "specimen_voucher", "journal", "date").join(dna, "accession")


@query("dedup_voucher", "info", "dna", sql=RECORDS + """
SELECT min(accession) AS accession, organism, specimen_voucher FROM rec GROUP BY organism, specimen_voucher, seq""")
def dedup_voucher(info, dna):
    return curate.dedup_by_voucher(_records(info, dna)).select("accession", "organism", "specimen_voucher")


@query("query_dedup", "info", "dna", sql=RECORDS + """
, h AS (SELECT concat(organism, '|', journal, '|', specimen_voucher, '|', len(seq)) AS header, min_by(accession, accession) AS accession, min_by(seq, accession) AS seq FROM rec GROUP BY 1)
SELECT min(accession) AS accession FROM h GROUP BY seq""")
def query_dedup(info, dna):
    header = F.concat("organism", F.lit("|"), "journal", F.lit("|"), F.coalesce("specimen_voucher", F.lit("")), F.lit("|"), F.length("seq").cast("string"))
    return curate.dedup_queries(_records(info, dna).withColumn("header", header)).select("accession")


PUBLISHED = "(journal IS NULL OR NOT regexp_matches(lower(journal), 'unknown|unpublished|published only in database'))"
NO_VOUCHER = "(specimen_voucher IS NULL OR lower(specimen_voucher) = 'unknown')"
EVAL = RECORDS.replace("FROM info", "FROM vouched") + """, ev AS (SELECT accession, organism, specimen_voucher, journal, date, len(seq) AS record_length, CASE WHEN doc_id % 31 <> 0 THEN doc_id % 97 END AS sum_hits_score, 1 + doc_id % 4 AS source_round, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id % 10 END AS consensus_value FROM rec),
rk AS (SELECT *, CASE WHEN sum_hits_score IS NOT NULL THEN rank() OVER (ORDER BY sum_hits_score DESC NULLS LAST) + (count(*) OVER (PARTITION BY sum_hits_score) - 1) / 2 END AS rank_score, rank() OVER (ORDER BY source_round) + (count(*) OVER (PARTITION BY source_round) - 1) / 2 AS rank_source,
  rank() OVER (ORDER BY record_length DESC) + (count(*) OVER (PARTITION BY record_length) - 1) / 2 AS rank_length FROM ev),
sr AS (SELECT *, coalesce(rank_score, 0) + rank_length AS sum_of_rank FROM rk)"""


def _evaluated(info, dna):
    r, n = _records(info, dna), F.col("doc_id")
    return r.select("accession", "organism", "specimen_voucher", "journal", "date", F.length("seq").alias("record_length"), F.when(n % 31 != 0, n % 97).alias("sum_hits_score"), (1 + n % 4).alias("source_round"), F.when(n % 5 != 0, n % 10).alias("consensus_value"))


@query("average_rank", "vouched", "dna", sql=EVAL + "SELECT accession, rank_score, rank_source, rank_length, sum_of_rank FROM sr")
def average_rank(info, dna):
    return curate.ranked(_evaluated(info, dna)).select("accession", "rank_score", "rank_source", "rank_length", "sum_of_rank")


@query("representative_per_species", "vouched", "dna", sql=EVAL + f"""
SELECT organism, accession FROM sr QUALIFY row_number() OVER (PARTITION BY organism ORDER BY sum_of_rank, consensus_value DESC NULLS LAST, {NO_VOUCHER}, NOT {PUBLISHED}, date DESC NULLS LAST, accession) = 1""")
def representative_per_species(info, dna):
    return curate.representatives(curate.ranked(_evaluated(info, dna))).select("organism", "accession")


def _by_source(steps):
    """The choice without ranks first, by the steps alone."""
    return lambda info, dna: curate.representatives(curate.ranked(_evaluated(info, dna)), steps).select("organism", "accession")


for _name, _steps, _order in (("voucher_first", ("voucher", "published", "newest"), f"{NO_VOUCHER}, NOT {PUBLISHED}, date DESC NULLS LAST"), ("published_first", ("published", "newest"), f"NOT {PUBLISHED}, date DESC NULLS LAST"), ("newest_first", ("newest",), "date DESC NULLS LAST")):
    query(_name, "vouched", "dna", sql=EVAL + f" SELECT organism, accession FROM sr QUALIFY row_number() OVER (PARTITION BY organism ORDER BY {_order}, sum_of_rank, accession) = 1")(_by_source(_steps))


@query("curate_marker", "vouched", "dna", sql=EVAL + f"""
, m AS (SELECT * REPLACE (CASE WHEN contains(organism, ' subsp. ') THEN split_part(organism, ' subsp. ', 1) WHEN contains(organism, ' var. ') THEN split_part(organism, ' var. ', 1) ELSE organism END AS organism) FROM sr WHERE record_length >= 100),
k AS (SELECT * FROM m WHERE NOT regexp_matches(organism, ' (sp\\.|sp|cf\\.|cf|aff\\.|aff|x\\.|x)( |$)'))
SELECT organism, accession FROM k QUALIFY row_number() OVER (PARTITION BY organism ORDER BY sum_of_rank, {NO_VOUCHER}, NOT {PUBLISHED}, date DESC, accession) = 1""")
def curate_marker(info, dna):
    rows = curate.ranked(_evaluated(info, dna)).withColumn("organism", names.merged(F.col("organism"))).withColumn("consensus_value", F.lit(None).cast("double"))
    return curate.representatives(rows.where((F.col("record_length") >= 100) & ~names.exceptional(F.col("organism")))).select("organism", "accession")


@query("longest_per_taxon", "info", "dna", sql=RECORDS + "SELECT organism, accession, CAST(len(seq) AS INT) AS length FROM rec QUALIFY row_number() OVER (PARTITION BY organism ORDER BY len(seq) DESC, accession) = 1")
def longest_per_taxon(info, dna):
    return curate.longest(_records(info, dna).withColumn("length", F.length("seq")), ["organism"], "length", ["accession"]).select("organism", "accession", "length")


@query("length_tiers", "info", "dna", sql=RECORDS + """
, t AS (SELECT accession, split_part(organism, ' ', 1) AS genus, len(seq) AS length FROM rec), n AS (SELECT *, row_number() OVER (PARTITION BY genus ORDER BY length DESC, accession) AS n FROM t),
c AS (SELECT *, min(CASE WHEN n <= 20 THEN length END) OVER (PARTITION BY genus) AS cut FROM n) SELECT accession, genus, CASE WHEN n <= 20 THEN 1 WHEN length > cut / 2 THEN 2 ELSE 3 END AS tier FROM c""")
def length_tiers(info, dna):
    rows = _records(info, dna).select("accession", F.substring_index("organism", " ", 1).alias("genus"), F.length("seq").alias("length"))
    return curate.length_tiers(rows, "genus", 20).select("accession", "genus", "tier")


@query("even_subsets", "info", sql="""
, n AS (SELECT accession, split_part(organism, ' ', 1) AS genus, row_number() OVER (PARTITION BY split_part(organism, ' ', 1) ORDER BY accession) - 1 AS n, count(*) OVER (PARTITION BY split_part(organism, ' ', 1)) AS c FROM info)
SELECT accession, genus, CAST(n % CAST(ceil(c / 20) AS BIGINT) AS INT) + 1 AS subset FROM n""")
def even_subsets(info):
    return curate.even_subsets(info.select("accession", F.substring_index("organism", " ", 1).alias("genus")), "genus", 20).select("accession", "genus", "subset")


CELLS = """, cells AS (SELECT organism, accession, p AS pos, substr(seq, p, 1) AS base, p BETWEEN len(seq) - len(ltrim(seq, '-')) + 1 AND len(rtrim(seq, '-')) AS inside FROM aln, unnest(range(1, 65)) AS t(p)),
cols AS (SELECT organism, pos, count(*) AS n_rows, count(*) FILTER (base = '-') AS n_gaps FROM cells GROUP BY 1, 2)"""
SETS = "(VALUES " + ", ".join(f"('{c}', '{b}', {alignment.VOTE[len(bs)]})" for c, bs in {**bases.IUPAC, "-": "-"}.items() for b in bs) + ") AS s(code, b, v)"
CODES = "(VALUES " + ", ".join(f"('{b}', '{c}')" for c, b in bases.IUPAC.items()) + ") AS k(won, code)"


@query("column_gaps", "aln", sql=CELLS + "SELECT organism, CAST(pos AS INT) AS pos, n_rows, n_gaps, round(n_gaps / n_rows, 9) AS gap_fraction FROM cols")
def column_gaps(aln):
    return alignment.column_counts(aln, "organism").withColumn("gap_fraction", F.round("gap_fraction", 9))


@query("consensus", "patchy", sql=CELLS.replace("FROM aln", "FROM patchy") + f""", v AS (SELECT organism, pos, b, round(sum(CASE WHEN inside THEN v ELSE 0 END), 9) AS v FROM cells JOIN {SETS} ON base = code GROUP BY 1, 2, 3),
w AS (SELECT organism, pos, max(best) AS best, string_agg(b, '' ORDER BY b) AS won FROM (SELECT *, max(v) OVER (PARTITION BY organism, pos) AS best FROM v) WHERE v = best GROUP BY 1, 2),
c AS (SELECT organism, string_agg(CASE WHEN best = 0 THEN 'N' WHEN w.won = '-' THEN '-' WHEN contains(w.won, '-') THEN 'N' ELSE code END, '' ORDER BY pos) AS consensus FROM w LEFT JOIN {CODES} ON w.won = k.won GROUP BY 1)
SELECT organism, CASE WHEN count(*) = 1 THEN max(seq) ELSE max(consensus) END AS consensus FROM patchy JOIN c USING (organism) GROUP BY 1""")
def consensus(aln):
    return alignment.consensus(aln, "organism").select("organism", "consensus")


@query("boundary_trim", "aln", sql=CELLS + """, b AS (SELECT organism, min(pos) AS f, max(pos) AS l FROM cols WHERE n_gaps / n_rows < 0.025 GROUP BY 1)
SELECT accession, CASE WHEN f IS NULL THEN seq ELSE substr(seq, f, l - f + 1) END AS seq FROM aln LEFT JOIN b USING (organism)""")
def boundary_trim(aln):
    return alignment.boundary_trim(aln, "organism").select("accession", "seq")


@query("common_ends", "aln", sql=CELLS + "SELECT organism, CAST(min(CASE WHEN n_gaps = 0 THEN pos END) AS INT) AS first, CAST(max(CASE WHEN n_gaps = 0 THEN pos END) + 1 AS INT) AS last FROM cols GROUP BY 1")
def common_ends(aln):
    return alignment.common_ends(aln, "organism")


RUNS = CELLS.replace("FROM aln", "FROM inserted") + """, o AS (SELECT organism, pos, pos - row_number() OVER (PARTITION BY organism ORDER BY pos) AS i FROM cols WHERE n_rows - n_gaps <= 1),
runs AS (SELECT organism, CAST(min(pos) AS INT) AS first, CAST(max(pos) AS INT) AS last FROM o GROUP BY organism, i HAVING max(pos) - min(pos) >= 19)"""


@query("rare_insertions", "inserted", sql=RUNS + "SELECT organism, first, last FROM runs")
def rare_insertions(aln):
    return alignment.rare_insertions(aln, "organism", 1, 20)


@query("without_insertions", "inserted", sql=RUNS + """SELECT accession, coalesce(string_agg(base, '' ORDER BY pos) FILTER (first IS NULL), '') AS seq FROM cells c LEFT JOIN runs r ON r.organism = c.organism AND pos BETWEEN first AND last GROUP BY 1""")
def without_insertions(aln):
    return alignment.without_insertions(aln, "organism", 1, 20).select("accession", "seq")


@query("gap_trim", "aln", sql=CELLS + """SELECT organism, CAST(pos AS INT) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY organism ORDER BY n_gaps / n_rows, pos) AS n FROM cols) WHERE 1 - n_gaps / n_rows >= 0.95 OR n <= 32""")
def gap_trim(aln):
    return alignment.gap_trim(aln, "organism", 0.95, 50)


EQ = "(VALUES " + ", ".join(f"('{x}{y}', {bases.equality(x, y)!r})" for x in bases.IUPAC for y in bases.IUPAC if bases.equality(x, y)) + ") AS e(xy, v)"
PAIRS = CELLS + """, ends AS (SELECT *, len(seq) - len(ltrim(seq, '-')) + 1 AS f, len(rtrim(seq, '-')) AS l FROM aln),
prs AS (SELECT a.organism, a.accession AS a1, b.accession AS a2, a.seq AS s1, b.seq AS s2, greatest(a.f, b.f) AS f, least(a.l, b.l) AS l FROM ends a JOIN ends b ON a.organism = b.organism AND a.accession < b.accession)"""


@query("avg_identity", "patchy", sql=PAIRS.replace("FROM aln", "FROM patchy") + f""", pi AS (SELECT organism, a1, a2, sum(coalesce(v, 0)) / count(*) AS pi FROM (SELECT organism, a1, a2, substr(s1, p, 1) AS x, substr(s2, p, 1) AS y FROM prs, unnest(range(f, l + 1)) AS t(p)) LEFT JOIN {EQ} ON xy = x || y WHERE NOT (x = '-' AND y = '-') GROUP BY 1, 2, 3)
SELECT organism, round(avg(coalesce(pi, 0)), 9) AS avg_pi, count(*) AS n_pairs FROM prs LEFT JOIN pi USING (organism, a1, a2) GROUP BY 1""")
def avg_identity(aln):
    return alignment.average_identity(aln, "organism").withColumn("avg_pi", F.round("avg_pi", 9))


@query("p_distance_edges", "aln", sql=PAIRS + """, h AS (SELECT organism, a1, a2, len(list_filter(range(1, 65), lambda p: substr(s1, p, 1) <> substr(s2, p, 1))) / 64 AS distance FROM prs)
SELECT organism, a1 AS accession, a2 AS accession_2, distance FROM h WHERE distance <= 0.6""")
def p_distance_edges(aln):
    return alignment.p_distance_edges(aln, "organism", 0.6)


@query("sum_of_pairs", "aln", sql=CELLS + f""", c AS (SELECT organism, pos, base, count(*) AS n FROM cells WHERE base <> '-' GROUP BY 1, 2, 3),
m AS (SELECT a.organism, sum(CASE WHEN a.base = b.base THEN a.n * (a.n - 1) / 2 ELSE a.n * b.n END * coalesce(v, -2)) AS m FROM c a JOIN c b ON a.organism = b.organism AND a.pos = b.pos AND a.base <= b.base LEFT JOIN {EQ} ON xy = a.base || b.base GROUP BY 1),
g AS (SELECT organism, sum(len(regexp_replace(trim(seq, '-'), '[^-]', '', 'g')) + len(regexp_extract_all(trim(seq, '-'), '-+'))) AS cost FROM aln GROUP BY 1)
SELECT organism, round(coalesce(m, 0) - cost, 6) AS sp_score FROM g LEFT JOIN m USING (organism)""")
def sum_of_pairs(aln):
    return alignment.sum_of_pairs(aln, "organism").withColumn("sp_score", F.round("sp_score", 6))


@query("extension_control", "aln", sql="""
, x AS (SELECT accession, seq, CASE WHEN len(regexp_replace(substr(seq, 1, 4), '[^-]', '', 'g')) / 4 > 0.25 THEN 4 ELSE 0 END AS a, CASE WHEN len(regexp_replace(substr(seq, 61), '[^-]', '', 'g')) / 4 > 0.25 THEN 4 ELSE 0 END AS b FROM aln)
SELECT accession, a AS cut_left, b AS cut_right, substr(seq, a + 1, 64 - a - b) AS seq FROM x""")
def extension_control(aln):
    return alignment.control_extension(aln, F.lit(4), F.lit(4), 0.25).select("accession", "cut_left", "cut_right", "seq")


@query("controlled_extensions", "aln", sql="""
, x AS (SELECT accession, seq, replace(seq, '-', '') AS raw, 100 + doc_id % 7 AS r1, 99 + doc_id % 7 + len(replace(seq, '-', '')) AS r2, doc_id % 9 AS a, doc_id % 5 AS b, list_filter(range(1, 65), lambda i: substr(seq, i, 1) <> '-') AS p FROM aln),
y AS (SELECT *, CASE WHEN a > 0 AND 1 - a / (p[a + 1] - p[1]) > 0.1 THEN a ELSE 0 END AS ca, CASE WHEN b > 0 AND 1 - b / (p[len(p)] - p[len(p) - b]) > 0.1 THEN b ELSE 0 END AS cb FROM x)
SELECT accession, concat(accession, ':', r1 + ca, '-', r2 - cb, '|x') AS header, substr(raw, CAST(1 + ca AS BIGINT), CAST(len(raw) - ca - cb AS BIGINT)) AS seq FROM y""")
def controlled_extensions(aln):
    r1 = (100 + F.col("doc_id") % 7).cast("int")
    r2 = (r1 - 1 + F.length(F.replace("seq", F.lit("-"), F.lit("")))).cast("int")
    records = aln.select("accession", "seq", F.concat("accession", F.lit(":"), r1.cast("string"), F.lit("-"), r2.cast("string"), F.lit("|x")).alias("header"))
    found = aln.select("accession", (r1 + F.col("doc_id") % 9).cast("int").alias("s_start"), (r2 - F.col("doc_id") % 5).cast("int").alias("s_end"))
    return alignment.extension_controlled(records, found, 0.1)


@query("genome_search", "genomes", sql="""
SELECT genome FROM genomes WHERE regexp_matches(organism, '^Genus[135] ') AND NOT contains(journals, '3') AND length BETWEEN 110000 AND 150000 AND date BETWEEN DATE '1993-01-01' AND DATE '1996-12-31'""")
def genome_search(g):
    title = F.when(F.contains("journals", F.lit("3")), "a mitochondrial chloroplast").otherwise("Chloroplast genome")
    return g.where(names.genome_record(F.col("organism"), title, F.col("length"), F.col("date"), ["Genus1", "Genus3", "Genus5"], 110_000, 150_000, "1993-01-01", "1996-12-31")).select("genome")


@query("kmer_similarity", "dna", sql="""
, u AS (SELECT min(accession) AS sid, regexp_replace(seq, '[^ACGT]', '', 'g') AS seq FROM dna GROUP BY dna.seq),
k AS (SELECT sid, substr(seq, p, 24) AS kmer, count(*) AS c FROM u, unnest(range(1, len(seq) - 22)) AS t(p) GROUP BY 1, 2),
s AS (SELECT a.sid, b.sid AS sid_2, sum(least(a.c, b.c)) AS shared FROM k a JOIN k b ON a.kmer = b.kmer AND a.sid < b.sid GROUP BY 1, 2)
SELECT s.sid, sid_2, CAST(shared AS BIGINT) AS shared, round(shared / least(len(x.seq) - 23, len(y.seq) - 23), 9) AS similarity FROM s JOIN u x ON x.sid = s.sid JOIN u y ON y.sid = sid_2""")
def kmer_similarity(dna):
    return alignment.kmer_similarity(dna, 24)[0].withColumn("similarity", F.round("similarity", 9))


@query("kmer_classes", "dna", sql="SELECT accession, min(accession) OVER (PARTITION BY seq) AS sid FROM dna")
def kmer_classes(dna):
    return alignment.sequence_classes(dna)


@query("mcl_clusters", "aln")
def mcl_clusters(aln):
    return select.near_clusters(aln, "organism", 0.6).select(F.col("organism").alias("graph_id"), F.col("accession").alias("node"), "cluster")


@query("sequence_clusters", "patchy")
def sequence_clusters(aln):
    return select.sequence_representatives(aln, "organism", 0.6).select(F.col("organism").alias("graph_id"), "cluster", "accession", "seq_len")


REDUCED = CELLS.replace("FROM aln", "FROM kp") + f""", v AS (SELECT organism, pos, b, round(sum(CASE WHEN inside THEN v ELSE 0 END), 9) AS v FROM cells JOIN {SETS} ON base = code GROUP BY 1, 2, 3),
wn AS (SELECT organism, pos, max(best) AS best, string_agg(b, '' ORDER BY b) AS won FROM (SELECT *, max(v) OVER (PARTITION BY organism, pos) AS best FROM v) WHERE v = best GROUP BY 1, 2),
cons AS (SELECT organism, pos, CASE WHEN best = 0 THEN 'N' WHEN wn.won = '-' THEN '-' WHEN contains(wn.won, '-') THEN 'N' ELSE code END AS c FROM wn LEFT JOIN {CODES} ON wn.won = k.won),
pi AS (SELECT organism, accession, sum(coalesce(e.v, 0)) / count(*) AS pi FROM cells JOIN cons USING (organism, pos) LEFT JOIN @EQ ON xy = base || c WHERE NOT (base = '-' AND c = '-') AND organism IN (SELECT organism FROM kp GROUP BY 1 HAVING count(*) >= 4) GROUP BY 1, 2),
sm AS (SELECT query_acc, subject_acc, sum(alignment_length) AS al, round(sum(bit_score), 2) AS sum_hits_score, min(source_round) AS source_round FROM hits GROUP BY 1, 2),
bs AS (SELECT * FROM sm QUALIFY row_number() OVER (PARTITION BY subject_acc ORDER BY sum_hits_score DESC, al DESC, query_acc) = 1),
ev AS (SELECT kp.*, len(regexp_replace(seq, '[RYKMSWBDHVN-]', '', 'g')) AS record_length, coalesce(pi, -1) AS cv, sum_hits_score FROM kp JOIN bs USING (subject_acc) LEFT JOIN pi USING (organism, accession)),
rk AS (SELECT *, rank() OVER (PARTITION BY marker ORDER BY sum_hits_score DESC) + (count(*) OVER (PARTITION BY marker, sum_hits_score) - 1) / 2 + rank() OVER (PARTITION BY marker ORDER BY record_length DESC) + (count(*) OVER (PARTITION BY marker, record_length) - 1) / 2 AS rs FROM ev),
one AS (SELECT * FROM rk QUALIFY row_number() OVER (PARTITION BY organism ORDER BY rs, round(cv, 9) DESC, {NO_VOUCHER}, NOT {PUBLISHED}, date DESC NULLS LAST, accession) = 1)
""".replace("@EQ", EQ)
SPECIES = "CASE WHEN contains(i.organism, ' subsp. ') THEN split_part(i.organism, ' subsp. ', 1) WHEN contains(i.organism, ' var. ') THEN split_part(i.organism, ' var. ', 1) ELSE i.organism END"
KEPT = """, kp AS (SELECT * FROM nm WHERE NOT regexp_matches(organism, ' (sp\\.|sp|cf\\.|cf|aff\\.|aff|x\\.|x)( |$)') AND len(replace(seq, '-', '')) >= 58 QUALIFY row_number() OVER (PARTITION BY organism, seq, specimen_voucher ORDER BY accession) = 1)
"""


@query("reduce_dataset", "vouched", "aln", "hits", sql=f"""
, nm AS (SELECT '' AS marker, accession, {SPECIES} AS organism, specimen_voucher, journal, date, seq, 'S' || a.doc_id % 400 AS subject_acc FROM vouched i JOIN aln a USING (accession))
""" + KEPT + REDUCED + "SELECT organism, accession, seq FROM one")
def reduce_dataset(info, aln, h):
    records = info.drop("lineage").join(aln.select("accession", "doc_id", "seq"), "accession")
    best = hits.best_per_subject(_sums(h)).select("subject_acc", "sum_hits_score", "source_round")
    own = records.select("accession", F.concat(F.lit("S"), (F.col("doc_id") % 400).cast("string")).alias("subject_acc")).join(best, "subject_acc").drop("subject_acc")
    return curate.reduced(records.drop("doc_id"), own, 58).select("organism", "accession", "seq")


MARKED = ", mk AS (SELECT *, 'm' || doc_id % 5 AS marker FROM aln UNION ALL SELECT * REPLACE (reverse(seq) AS seq), 'm' || (doc_id + 2) % 5 AS marker FROM aln)"


def _marked(info, aln, h):
    """Each record in two of five markers, as it is and reversed; and each record's best hit."""
    n = F.col("doc_id")
    two = aln.select("accession", "doc_id", "seq", F.concat(F.lit("m"), (n % 5).cast("string")).alias("marker"))
    two = two.unionByName(aln.select("accession", "doc_id", F.reverse("seq").alias("seq"), F.concat(F.lit("m"), ((n + 2) % 5).cast("string")).alias("marker")))
    records = info.drop("lineage").join(two, "accession").withColumn("header", F.concat("accession", F.lit(":101-"), (100 + F.length(F.replace("seq", F.lit("-"), F.lit("")))).cast("string"), F.lit("|x")))
    best = hits.best_per_subject(_sums(h)).select("subject_acc", "sum_hits_score", "source_round")
    own = records.select("marker", "accession", F.lit(109).alias("s_start"), F.lit(150).alias("s_end"), F.concat(F.lit("S"), (n % 400).cast("string")).alias("subject_acc")).join(best, "subject_acc", "left").drop("subject_acc")
    return records.drop("doc_id"), own


@query("marker_runs", "vouched", "aln", "hits", sql=MARKED + f"""
, nm AS (SELECT marker, accession, marker || '/' || {SPECIES} AS organism, specimen_voucher, journal, date, seq, 'S' || a.doc_id % 400 AS subject_acc FROM vouched i JOIN mk a USING (accession))
""" + KEPT + REDUCED + "SELECT marker, split_part(organism, '/', 2) AS organism, accession, seq FROM one")
def marker_runs(info, aln, h):
    records, own = _marked(info, aln, h)
    return markers.run(records, own.where("sum_hits_score IS NOT NULL"), markers.REDUCE, least=58).select("marker", "organism", "accession", "seq")


@query("marker_control", "vouched", "aln", "hits", sql=MARKED + """
, pl AS (SELECT marker, accession, seq, list_filter(range(1, 65), lambda p: substr(seq, p, 1) <> '-') AS b FROM mk), q AS (SELECT *, len(b) AS n FROM pl),
g AS (SELECT *, 1 - 8 / abs(b[9] - b[1]) > 0.05 AS l, CASE WHEN n > 50 THEN 1 - (n - 50) / abs(b[50] - b[n]) > 0.05 ELSE false END AS r FROM q),
h AS (SELECT *, CASE WHEN l THEN 109 ELSE 101 END AS a, CASE WHEN r THEN 150 ELSE 100 + n END AS z, replace(seq, '-', '') AS raw FROM g)
SELECT marker, accession, concat(accession, ':', a, '-', z, '|x') AS header, CASE WHEN l OR r THEN substr(raw, a - 100, z - a + 1) ELSE raw END AS seq FROM h""")
def marker_control(info, aln, h):
    records, own = _marked(info, aln, h)
    return markers.run(records, own, markers.CONTROL, threshold=0.05).select("marker", "accession", "header", "seq")


@query("spliced_genes", "located", "dna", sql="""
, p AS (SELECT genome, CAST(regexp_extract(genome, 'D([0-9]+)', 1) AS BIGINT) AS d, seq FROM located JOIN dna ON genome = accession), q AS (SELECT genome, d, substr(seq, 1 + d % 5, 9) AS a, substr(seq, 13 + d % 5, 7) AS b FROM p),
r AS (SELECT *, reverse(translate(a, 'ACGTRYMN', 'TGCAYRKN')) AS ra, reverse(translate(b, 'ACGTRYMN', 'TGCAYRKN')) AS rb FROM q)
SELECT genome, CASE d % 4 WHEN 0 THEN rb || ra WHEN 1 THEN ra || b WHEN 2 THEN a || b ELSE ra END AS seq FROM r""")
def spliced_genes(located, dna):
    return genomes.spliced(located, dna.select(F.col("accession").alias("genome"), "seq")).select("genome", "seq")


@query("encodable_headers", "headers", sql=r"""
SELECT doc_id, CASE WHEN NOT regexp_matches(header, '^[\x20-\x7E]*\z') THEN 'encoding' END AS reject_reason FROM headers""")
def encodable_headers(h):
    return curate.encodable(h).select("doc_id", "reject_reason")


@query("filter_counters", "headers", sql=r"""
SELECT count(*) AS n_total, count(*) FILTER (regexp_matches(header, '^[\x20-\x7E]*\z')) AS n_kept, count(*) FILTER (NOT regexp_matches(header, '^[\x20-\x7E]*\z')) AS n_rejected FROM headers""")
def filter_counters(h):
    return curate.counted(curate.encodable(h))


@query("clade_reference", "info", sql="""
, g AS (SELECT split_part(lineage, '|', 3) AS genus, max(split_part(lineage, '|', 2)) AS family, count(*) AS n FROM info GROUP BY 1), f AS (SELECT genus, concat('Family', len(genus) + CAST(right(genus, 1) AS INT) % 3) AS family FROM g),
r AS (SELECT * FROM f WHERE CAST(right(genus, 1) AS INT) % 2 = 1)
SELECT genus, family, coalesce((SELECT min(genus) FROM r WHERE r.family = f.family AND r.genus <> f.genus), (SELECT min(genus) FROM r WHERE r.genus <> f.genus)) AS reference FROM f""")
def clade_reference(info):
    genus = info.select(F.split("lineage", r"\|")[2].alias("genus")).distinct()
    digit = F.right("genus", F.lit(1)).cast("int")
    small = genus.select("genus", F.concat(F.lit("Family"), (F.length("genus") + digit % 3).cast("string")).alias("family"))
    return curate.clade_reference(small, small.where(digit % 2 == 1))


@query("genome_prefilter", "genomes", sql="""
SELECT genome, CASE WHEN keywords = 'UNVERIFIED' THEN 'unverified' WHEN contains(organism, ' sp.') THEN 'sp.' WHEN contains(organism, ' x ') THEN 'hybrid' END AS reject_reason FROM genomes""")
def genome_prefilter(g):
    return g.select("genome", genomes.reject_reason(F.col("organism"), F.col("keywords")).alias("reject_reason"))


ORDER = "CASE WHEN trim(journals) = '' OR regexp_matches(lower(journals), 'unknown|unpublished|published only in database') THEN 1 ELSE 0 END, cds_count DESC NULLS LAST, length DESC, date DESC NULLS LAST, genome"


@query("topn_distinct_dates", "genomes", sql=f"""
, d AS (SELECT * FROM genomes QUALIFY row_number() OVER (PARTITION BY organism, date ORDER BY {ORDER}) = 1)
SELECT organism, genome, CAST(row_number() OVER (PARTITION BY organism ORDER BY {ORDER}) AS INT) AS choice FROM d QUALIFY choice <= 3""")
def topn_distinct_dates(g):
    return genomes.newest_distinct(g).select("organism", "genome", "choice")


@query("marker_counts", "genomes", sql="""
, q AS (SELECT * FROM (VALUES ('early', DATE '1900-01-01', DATE '1994-12-31'), ('late', DATE '1995-01-01', DATE '2100-01-01'), ('none', DATE '2101-01-01', DATE '2102-01-01')) AS t(marker, a, b))
SELECT marker, count(genome) AS n_records FROM q LEFT JOIN (SELECT * FROM genomes WHERE regexp_matches(organism, '^Genus[135] ') AND length BETWEEN 100000 AND 150000) g ON g.date BETWEEN a AND b GROUP BY 1""")
def marker_counts(g):
    q = g.sparkSession.sql("SELECT marker, CAST(a AS DATE) AS a, CAST(b AS DATE) AS b FROM VALUES ('early', '1900-01-01', '1994-12-31'), ('late', '1995-01-01', '2100-01-01'), ('none', '2101-01-01', '2102-01-01') AS t(marker, a, b)")
    wanted = names.marker_record(F.col("organism"), F.col("length").between(100000, 150000), F.col("date"), ["Genus1", "Genus3", "Genus5"])
    found = g.where(wanted).groupBy("date").agg(F.count("*").alias("n"))
    return F.broadcast(q).join(found, found.date.between(F.col("a"), F.col("b")), "left").groupBy("marker").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_records"))


RESOLVED = """, s AS (SELECT DISTINCT trim(replace(organism, '|', '')) AS n FROM info), ex AS (SELECT n, b.*, 1.0 AS score FROM s JOIN backbone b ON n = name),
fz AS (SELECT n, b.*, 1 - levenshtein(n, name) / greatest(len(n), len(name)) AS score FROM s JOIN backbone b ON split_part(n, ' ', 1) = split_part(name, ' ', 1) WHERE n NOT IN (SELECT n FROM ex)),
res AS (SELECT * FROM (SELECT * FROM ex UNION ALL SELECT * FROM fz) QUALIFY row_number() OVER (PARTITION BY n ORDER BY score DESC, name) = 1)"""


GENES = """, f AS (SELECT * FROM features JOIN aliases USING (gene_alias)),
genes AS (SELECT genome, gene, count(*) AS n, string_agg(concat(start_pos, '..', end_pos), '|' ORDER BY start_pos, concat(start_pos, '..', end_pos)) AS locations, max(end_pos - start_pos) AS length FROM f WHERE type IN ('CDS', 'rRNA') GROUP BY 1, 2)"""


def _genes(features, aliases):
    return genomes.gene_table(genomes.standard_gene(features, aliases))


@query("gene_matrix", "features", "aliases", sql=GENES + "SELECT genome, gene, n, locations, length FROM genes")
def gene_matrix(features, aliases):
    return _genes(features, aliases)


SPLICED = """, st AS (SELECT * FROM (SELECT n.*, CASE WHEN n.gene_alias IS NOT NULL THEN coalesce(g.gene, n.gene_alias) ELSE coalesce(p.gene, 'unknown') END AS gene FROM annotations n LEFT JOIN aliases g ON g.gene_alias = n.gene_alias LEFT JOIN aliases p ON p.gene_alias = n.product) x WHERE gene IN (SELECT gene FROM aliases)),
xy AS (SELECT genome, type, gene, location, form, substr(seq, a, 9) AS x, substr(seq, a + 12, 7) AS y FROM st JOIN genome_seqs USING (genome)), rc AS (SELECT *, reverse(translate(x, 'ACGT', 'TGCA')) AS rx, reverse(translate(y, 'ACGT', 'TGCA')) AS ry FROM xy),
sp AS (SELECT DISTINCT gene, genome, concat(genome, '|', location) AS header, CASE form WHEN 0 THEN ry || rx WHEN 1 THEN rx || y WHEN 2 THEN x || y ELSE rx END AS seq FROM rc WHERE type IN ('CDS', 'rRNA'))"""


@query("gene_sequences", "annotations", "aliases", "genome_seqs", sql=SPLICED + "SELECT gene, genome, header, seq FROM sp")
def gene_sequences(notes, aliases, seqs):
    return genomes.gene_sequences(genomes.known_genes(notes, aliases), seqs)


@query("genome_qc", "features", "aliases", sql=GENES + """
SELECT genome, count(*) FILTER (type = 'gene') AS n_genes, count(*) FILTER (type = 'CDS') AS n_cds, count(*) FILTER (type = 'tRNA') AS n_trna, count(*) FILTER (type = 'rRNA') AS n_rrna, count(DISTINCT CASE WHEN type = 'CDS' THEN gene END) AS n_distinct_cds, count(*) FILTER (type = 'CDS') < 2 AS flagged FROM f GROUP BY 1""")
def genome_qc(features, aliases):
    return genomes.feature_counts(genomes.standard_gene(features, aliases), 2)


@query("length_bounds", "features", "aliases", "reference", sql=GENES + "SELECT genome, gene, length FROM genes LEFT JOIN reference USING (gene) WHERE ref_len IS NULL OR length BETWEEN 0.8 * ref_len AND 1.2 * ref_len")
def length_bounds(features, aliases, reference):
    return genomes.within_reference(_genes(features, aliases), reference, 0.8, 1.2).select("genome", "gene", "length")


@query("species_gene_set", "features", "aliases", "genomes", sql=GENES + """, t AS (SELECT genome, sum(length) AS total_length, count(*) AS n_genes FROM genes GROUP BY 1)
SELECT organism, genome, CAST(total_length AS BIGINT) AS total_length, n_genes FROM t JOIN genomes USING (genome) QUALIFY row_number() OVER (PARTITION BY organism ORDER BY total_length DESC, genome) = 1""")
def species_gene_set(features, aliases, g):
    return genomes.per_species(_genes(features, aliases), g.withColumnRenamed("length", "genome_length")).select("organism", "genome", "total_length", "n_genes")


WANTED = [f"gene{i}" for i in range(20)]


@query("genome_counts", "genomes", "features", "aliases", sql=GENES + """
SELECT genome, organism, n FROM (SELECT genome, count(*) AS n FROM f GROUP BY 1) LEFT JOIN (SELECT * FROM genomes WHERE keywords <> 'UNVERIFIED') USING (genome)""")
def genome_counts(g, features, aliases):
    counts = genomes.standard_gene(features, aliases).groupBy("genome").agg(F.count("*").alias("n"))
    return genomes.with_counts(g.where("keywords != 'UNVERIFIED'").select("genome", "organism"), counts)


@query("genome_quality", "features", "aliases", "genome_seqs", sql=GENES + """, c AS (SELECT genome, count(*) FILTER (type = 'CDS') AS n_cds FROM f GROUP BY 1)
SELECT genome, coalesce(n_cds, 0) AS n_cds, len(seq) - len(replace(seq, 'N', '')) AS unclear_bases, coalesce(n_cds, 0) < 2 OR (len(seq) - len(replace(seq, 'N', ''))) / len(seq) > 0.08 AS flagged FROM genome_seqs LEFT JOIN c USING (genome)""")
def genome_quality(features, aliases, seqs):
    return genomes.quality(genomes.feature_counts(genomes.standard_gene(features, aliases), 2), seqs, 0.08).select("genome", "n_cds", F.col("unclear_bases").cast("bigint").alias("unclear_bases"), "flagged")


@query("genome_gene_set", "genomes", "features", "genome_seqs", "aliases", "reference", sql=f"""
, d AS (SELECT * FROM genomes WHERE keywords <> 'UNVERIFIED' AND NOT contains(organism, ' sp.') AND NOT contains(organism, ' x ') QUALIFY row_number() OVER (PARTITION BY organism, date ORDER BY {ORDER}) = 1),
ch AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY organism ORDER BY {ORDER}) <= 3),
ow AS (SELECT * FROM features JOIN aliases USING (gene_alias) WHERE genome IN (SELECT genome FROM ch)), ct AS (SELECT genome, count(*) FILTER (type = 'CDS') AS n_cds FROM ow GROUP BY 1),
gd AS (SELECT genome FROM genome_seqs JOIN ct USING (genome) WHERE n_cds >= 1 AND (len(seq) - len(replace(seq, 'N', ''))) / len(seq) <= 0.08),
gn AS (SELECT genome, gene, max(end_pos - start_pos) AS length FROM ow WHERE type IN ('CDS', 'rRNA') AND genome IN (SELECT genome FROM gd) GROUP BY 1, 2), bd AS (SELECT gn.* FROM gn LEFT JOIN reference USING (gene) WHERE ref_len IS NULL OR length BETWEEN 0.5 * ref_len AND 1.5 * ref_len),
tt AS (SELECT genome, sum(length) AS total_length, count(*) AS n_genes, list(gene) AS h FROM bd GROUP BY 1)
SELECT organism, genome, CAST(total_length AS BIGINT) AS total_length, n_genes, coalesce((SELECT string_agg(w, ',' ORDER BY w) FROM unnest({WANTED}) AS x(w) WHERE NOT list_contains(h, w)), '') AS missing
FROM tt JOIN ch USING (genome) QUALIFY row_number() OVER (PARTITION BY organism ORDER BY total_length DESC, genome) = 1""")
def genome_gene_set(g, features, seqs, aliases, reference):
    return genomes.gene_set(g.withColumnRenamed("length", "genome_length").withColumn("length", F.col("genome_length")), features, seqs, aliases, reference, WANTED, least_cds=1, most_unclear=0.08, low=0.5, high=1.5)


@query("species_gene_sequences", "genomes", "annotations", "genome_seqs", "aliases", "backbone", sql=RESOLVED.replace("FROM info", "FROM genomes") + SPLICED.replace("FROM annotations", "FROM (SELECT * FROM annotations WHERE genome NOT LIKE '%3' UNION ALL SELECT * REPLACE (CASE WHEN type = 'tRNA' THEN 'CDS' ELSE type END AS type) FROM annotations WHERE genome LIKE '%3')") + f"""
, d AS (SELECT * FROM genomes WHERE keywords <> 'UNVERIFIED' AND NOT contains(organism, ' sp.') AND NOT contains(organism, ' x ') QUALIFY row_number() OVER (PARTITION BY organism, date ORDER BY {ORDER}) = 1),
ch AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY organism ORDER BY {ORDER}) <= 3),
ct AS (SELECT genome, count(*) FILTER (type = 'CDS') AS n_cds FROM st WHERE genome IN (SELECT genome FROM ch) GROUP BY 1),
gd AS (SELECT genome FROM genome_seqs JOIN ct USING (genome) WHERE n_cds >= 1 AND (len(seq) - len(replace(seq, 'N', ''))) / len(seq) <= 0.08),
gn AS (SELECT * FROM sp WHERE genome IN (SELECT genome FROM gd) AND (gene = 'gene7' OR len(seq) BETWEEN 0.5 * 16 AND 0.9 * 16) QUALIFY row_number() OVER (PARTITION BY genome, gene ORDER BY len(seq) DESC, header) = 1),
nm AS (SELECT genome, accepted_name AS organism FROM ch JOIN res ON trim(organism) = n WHERE score >= 0.6 AND accepted_name <> '' AND status IN ('Accepted', 'Synonym') AND accepted_rank <> 'genus'),
tt AS (SELECT genome, sum(len(seq)) AS total FROM gn GROUP BY 1), one AS (SELECT organism, genome FROM tt JOIN nm USING (genome) QUALIFY row_number() OVER (PARTITION BY organism ORDER BY total DESC, genome) = 1)
SELECT organism, gene, header, seq FROM one JOIN gn USING (genome)""")
def species_gene_sequences(g, notes, seqs, aliases, backbone):
    old, newer = notes.where("genome NOT LIKE '%3'"), notes.where("genome LIKE '%3'").withColumn("type", F.when(F.col("type") == "tRNA", "CDS").otherwise(F.col("type")))
    reference = aliases.select("gene", F.lit(16).alias("ref_len")).distinct().where("gene != 'gene7'")
    found = resolve.accepted(resolve.resolved(g.select(F.col("organism").alias("name")), backbone), 0.6)
    stale = old.unionByName(newer.limit(0)).unionByName(notes.where("genome LIKE '%3'"))
    return genomes.gene_sequence_set(g, stale, seqs, aliases, reference, WANTED, newer=newer, accepted=found, least_cds=1, most_unclear=0.08, low=0.5, high=0.9)[1]


@query("missing_genes", "features", "aliases", sql=GENES + f"""
SELECT genome, coalesce((SELECT string_agg(w, ',' ORDER BY w) FROM unnest({WANTED}) AS x(w) WHERE NOT list_contains(h, w)), '') AS missing FROM (SELECT genome, list(DISTINCT gene) AS h FROM genes GROUP BY 1)""")
def missing_genes(features, aliases):
    return genomes.missing_genes(_genes(features, aliases), WANTED)


@query("duplicate_report", "genomes", sql="SELECT organism, count(*) AS n FROM genomes GROUP BY 1 HAVING count(*) > 1")
def duplicate_report(g):
    return g.groupBy("organism").agg(F.count("*").alias("n")).where("n > 1")


@query("resolve_names", "info", "backbone", sql=RESOLVED + "SELECT n AS name_submitted, name AS name_matched, accepted_name, accepted_rank, status, round(score, 9) AS score FROM res")
def resolve_names(info, backbone):
    return resolve.resolved(info.select(F.col("organism").alias("name")), backbone).withColumn("score", F.round("score", 9))


@query("accepted_names", "info", "backbone", sql=RESOLVED + "SELECT accession, accepted_name AS organism FROM info LEFT JOIN (SELECT * FROM res WHERE score >= 0.6 AND accepted_name <> '' AND status IN ('Accepted', 'Synonym') AND accepted_rank <> 'genus') r ON trim(organism) = n")
def accepted_names(info, backbone):
    found = resolve.accepted(resolve.resolved(info.select(F.col("organism").alias("name")), backbone), 0.6)
    return resolve.substituted(info, found).select("accession", "organism")


@query("rechecked_names", "info", "backbone", sql=RESOLVED + """, ag AS (SELECT n FROM s WHERE n NOT IN (SELECT n FROM res WHERE score >= 0.9)),
wd AS (SELECT n, b.*, 1 - levenshtein(n, name) / greatest(len(n), len(name)) AS score FROM ag CROSS JOIN backbone b),
w1 AS (SELECT * FROM wd WHERE score >= 0.9 QUALIFY row_number() OVER (PARTITION BY n ORDER BY score DESC, name) = 1)
SELECT n AS name_submitted, name AS name_matched, round(score, 9) AS score FROM (SELECT * FROM res WHERE score >= 0.9 UNION ALL SELECT * FROM w1)""")
def rechecked_names(info, backbone):
    submitted = info.select(F.col("organism").alias("name"))
    return resolve.rechecked(submitted, backbone, resolve.resolved(submitted, backbone), 0.9).select("name_submitted", "name_matched", F.round("score", 9).alias("score"))


@query("near_names", "info", "backbone", sql="""
, s AS (SELECT DISTINCT substr(organism, 2) AS n FROM info), b AS (SELECT DISTINCT name FROM backbone)
SELECT n AS name_submitted, name, round(1 - levenshtein(n, name) / greatest(len(n), len(name)), 9) AS score FROM s CROSS JOIN b WHERE 1 - levenshtein(n, name) / greatest(len(n), len(name)) >= 0.85 - 1e-12""")
def near_names(info, backbone):
    submitted = info.select(F.expr("substring(organism, 2)").alias("name_submitted"))
    return resolve.near_names(submitted, backbone, 0.85).withColumn("score", F.round("score", 9))


@query("distinct_organisms", "info", sql="SELECT organism, row_number() OVER (ORDER BY organism) AS id FROM (SELECT DISTINCT organism FROM info)")
def distinct_organisms(info):
    return curate.numbered(info.select("organism").distinct(), "organism")


@query("replacement", "markers", sql="""
, a AS (SELECT taxon, seq FROM markers WHERE marker = 'm1'), b AS (SELECT taxon, seq FROM markers WHERE marker = 'm2') SELECT * FROM a UNION ALL SELECT * FROM b WHERE taxon NOT IN (SELECT taxon FROM a)""")
def replacement(m):
    return supermatrix.replaced(m.where("marker = 'm1'").select("taxon", "seq"), m.where("marker = 'm2'").select("taxon", "seq"))


GRID = """, grid AS (SELECT t.taxon, m.marker, coalesce(seq, repeat('-', n)) AS seq FROM (SELECT DISTINCT taxon FROM markers) t CROSS JOIN (SELECT marker, max(len(seq)) AS n FROM markers GROUP BY 1) m LEFT JOIN markers x ON x.taxon = t.taxon AND x.marker = m.marker)"""


@query("taxon_completion", "markers", sql=GRID + "SELECT taxon, marker, seq FROM grid")
def taxon_completion(m):
    return supermatrix.completed(m)


@query("concatenate", "markers", sql=GRID + "SELECT taxon, string_agg(seq, '' ORDER BY marker) AS seq FROM grid GROUP BY 1")
def concatenate(m):
    return supermatrix.concatenated(supermatrix.completed(m))


@query("supermatrix", "markers", sql="""
, a AS (SELECT * FROM markers WHERE taxon NOT LIKE '%7'), rp AS (SELECT * FROM a UNION ALL SELECT taxon, marker, reverse(seq) FROM markers m WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.taxon = m.taxon AND a.marker = m.marker)),
cl AS (SELECT marker, p, avg(CASE WHEN substr(seq, p, 1) = '-' THEN 1.0 ELSE 0 END) AS g FROM rp, unnest(range(1, 65)) AS t(p) GROUP BY 1, 2), bd AS (SELECT marker, min(p) AS f, max(p) AS l FROM cl WHERE g < 0.1 GROUP BY 1),
tr AS (SELECT replace(taxon, ' ', '_') AS taxon, marker, CASE WHEN f IS NULL THEN seq ELSE substr(seq, f, l - f + 1) END AS seq FROM rp LEFT JOIN bd USING (marker)),
gr AS (SELECT t.taxon, m.marker, coalesce(seq, repeat('-', n)) AS seq FROM (SELECT DISTINCT taxon FROM tr) t CROSS JOIN (SELECT marker, max(len(seq)) AS n FROM tr GROUP BY 1) m LEFT JOIN tr x ON x.taxon = t.taxon AND x.marker = m.marker)
SELECT taxon, string_agg(seq, '' ORDER BY marker) AS seq FROM gr GROUP BY 1""")
def supermatrix_(m):
    return supermatrix.matrix(m.where("taxon NOT LIKE '%7'"), m.withColumn("seq", F.reverse("seq")), 0.1)[0]


@query("supermatrix_columns", "markers", sql="""
, a AS (SELECT * FROM markers WHERE taxon NOT LIKE '%7'), rp AS (SELECT * FROM a UNION ALL SELECT taxon, marker, reverse(seq) FROM markers m WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.taxon = m.taxon AND a.marker = m.marker)),
cl AS (SELECT marker, p, count(*) FILTER (substr(seq, p, 1) = '-') / count(*) AS g FROM rp, unnest(range(1, 65)) AS t(p) GROUP BY 1, 2),
kc AS (SELECT marker, p FROM (SELECT *, row_number() OVER (PARTITION BY marker ORDER BY g, p) AS n FROM cl) WHERE 1 - g >= 0.955 OR n <= 16),
tr AS (SELECT replace(taxon, ' ', '_') AS taxon, marker, string_agg(substr(seq, p, 1), '' ORDER BY p) AS seq FROM rp JOIN kc USING (marker) GROUP BY 1, 2),
gr AS (SELECT t.taxon, m.marker, coalesce(seq, repeat('-', n)) AS seq FROM (SELECT DISTINCT taxon FROM tr) t CROSS JOIN (SELECT marker, max(len(seq)) AS n FROM tr GROUP BY 1) m LEFT JOIN tr x ON x.taxon = t.taxon AND x.marker = m.marker)
SELECT taxon, string_agg(seq, '' ORDER BY marker) AS seq FROM gr GROUP BY 1""")
def supermatrix_columns(m):
    return supermatrix.matrix(m.where("taxon NOT LIKE '%7'"), m.withColumn("seq", F.reverse("seq")), gt=0.955, cons=25)[0]


@query("partitions", "markers", sql="""
, p AS (SELECT marker, max(len(seq)) AS n FROM markers GROUP BY 1), q AS (SELECT marker, n, sum(n) OVER (ORDER BY marker) AS e FROM p)
SELECT concat('DNA, ', marker, '_pos', k + 1, ' = ', CAST(e - n + 1 + k AS BIGINT), '-', CAST(e AS BIGINT), '\\3') AS line FROM q, unnest([0, 1, 2]) AS t(k)""")
def partitions(m):
    return supermatrix.partition_lines(supermatrix.partitions(m), True)


@query("length_status", "markers", sql="SELECT marker, CAST(CASE WHEN min(len(seq)) = max(len(seq)) THEN min(len(seq)) ELSE -1 END AS INT) AS status FROM markers GROUP BY 1")
def length_status(m):
    return supermatrix.length_status(m)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
