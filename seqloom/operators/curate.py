"""Record curation: filters, duplicates, ranking, one representative per species."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.functions import bases, names


def annotation_passes(features: Column, keys: list[str], excludes: list[str]) -> Column:
    """No excluded term in any feature value, and some key term if there are any; case and spaces do not matter."""
    flat = F.transform(features, lambda f: F.replace(F.lower(f), F.lit(" "), F.lit("")))
    some = lambda terms: F.exists(flat, lambda f: reduce(Column.__or__, (F.contains(f, F.lit(t.lower().replace(" ", ""))) for t in terms)))
    bad = some(excludes) if excludes else F.lit(False)
    return ~bad & (some(keys) if keys else F.lit(True))


def taxonomy_passes(lineage: Column, organism: Column, allowed: list[str]) -> Column:
    """The lineage meets the allowed list, or the organism's species core is one of theirs."""
    if not allowed:
        raise ValueError("no taxa allowed")
    low = [a.strip().lower() for a in allowed]
    return F.arrays_overlap(F.transform(lineage, lambda x: F.lower(x)), F.array(*map(F.lit, low))) | names.species_core(organism).isin(*low)


def low_quality(records: DataFrame, max_length: int, references: DataFrame | None = None) -> DataFrame:
    """reject_reason: short (plain bases under 0.2 * max_length), ambiguous (under 0.995 of the length), duplicate (a
    reference has the sequence), or null."""
    plain = bases.n_plain(F.col("seq"))
    reason = F.when(plain < 0.2 * max_length, "short").when(plain < 0.995 * F.length("seq"), "ambiguous")
    if references is None:
        return records.withColumn("reject_reason", reason)
    known = references.select(F.sha2("seq", 256).alias("_h")).distinct().withColumn("_known", F.lit(True))
    out = records.withColumn("_h", F.sha2("seq", 256)).join(known, "_h", "left").withColumn("reject_reason", reason.when(F.col("_known"), "duplicate"))
    return out.drop("_h", "_known")


def first_of(rows: DataFrame, by: list, order: list) -> DataFrame:
    """One row of each group, the first in the given order."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def dedup_by_voucher(records: DataFrame, by: tuple = ()) -> DataFrame:
    """One record of each (organism, sequence, voucher): the least accession. `by`: columns that keep records apart, such as
    a marker, here and in what follows."""
    return first_of(records.withColumn("_h", F.sha2("seq", 256)), [*by, "organism", "_h", "specimen_voucher"], ["accession"]).drop("_h")


def dedup_queries(records: DataFrame) -> DataFrame:
    """Without records whose header, and then whose sequence, an earlier accession has."""
    by_header = first_of(records, ["header"], ["accession"])
    return first_of(by_header.withColumn("_h", F.sha2("seq", 256)), ["_h"], ["accession"]).drop("_h")


def longest(rows: DataFrame, by: list, length: str, tie: list) -> DataFrame:
    return first_of(rows, by, [F.desc(length), *tie])


def average_rank(rows: DataFrame, column: str, descending: bool, name: str, buckets: int = 64, by: tuple = ()) -> DataFrame:
    """Ties share the mean of their ranks; the column is a number, and where it is null there is no rank. Counts by value
    are summed within ranges of values, and ranges by their sums, so neither rows nor values meet in one task."""
    return rows.join(_ranks(rows, column, descending, name, buckets, by), [*by, column], "left")


def _ranks(rows: DataFrame, column: str, descending: bool, name: str, buckets: int = 64, by: tuple = ()) -> DataFrame:
    """The rank of each value."""
    per = rows.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("_c"))
    told = running(per, column, list(by), descending, buckets).withColumn(name, F.col("_upto") - F.col("_c") + (F.col("_c") + 1) / 2)
    return told.select(*by, column, name)


def running(per: DataFrame, column: str, by: list[str], descending: bool = False, buckets: int = 64) -> DataFrame:
    """Counts of values (by, column, _c) with `_upto`, the sum of those up to the value in its group. Values are summed in
    ranges, `buckets` at most, and ranges by their sums: no task sorts more than a range of a group's values."""
    key = F.col(column).cast("double")
    edges = sorted(set(per.select(key.alias("_v")).approxQuantile("_v", [i / buckets for i in range(1, buckets)], 1 / (4 * buckets))))
    bucket = (F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= key)) if edges else F.lit(0)) * (-1 if descending else 1)
    per = per.withColumn("_b", bucket)
    order = F.desc(column) if descending else F.asc(column)
    within = F.sum("_c").over(W.partitionBy(*by, "_b").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    sums = per.groupBy(*by, "_b").agg(F.sum("_c").alias("_s"))  # `buckets` rows a group at most, and so is what its window sorts
    below = sums.withColumn("_s", F.sum("_s").over(W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, 0)) - F.col("_s"))
    return per.join(below, [*by, "_b"]).withColumn("_upto", F.col("_s") + within).drop("_b", "_s")


def quantiles(rows: DataFrame, column: str, by: list[str], at: list[float], buckets: int = 64) -> DataFrame:
    """(by, q), exact quantiles of each group's values, nulls left out, between two values in proportion. By counts in
    ranges, so no task holds a group's values."""
    per = rows.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("_c"))
    told = running(per, column, by, False, buckets)
    size = told.groupBy(*by).agg(F.max("_upto").alias("_n"))
    ends = []
    for k, q in enumerate(at):
        place = (F.col("_n") - 1) * F.lit(q)
        for n, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            ends.append(F.min(F.when(F.col("_upto") > rank, F.col(column).cast("double"))).alias(f"_{n}{k}"))
    found = told.join(size, by).groupBy(*by, "_n").agg(*ends)
    share = lambda q: (F.col("_n") - 1) * F.lit(q) - F.floor((F.col("_n") - 1) * F.lit(q))
    return found.select(*by, F.array(*(F.col(f"_lo{k}") + (F.col(f"_hi{k}") - F.col(f"_lo{k}")) * share(q) for k, q in enumerate(at))).alias("q"))


def numbered(rows: DataFrame, column: str) -> DataFrame:
    """rows (one a value of a text column) with id, from 1 in the order of the values: each range of values is numbered by
    itself, after as many as the ranges before have."""
    from .graph import cut

    dealt = cut(rows.repartitionByRange(column).withColumn("_p", F.spark_partition_id()))
    size = dealt.groupBy("_p").agg(F.count("*").alias("_s"))  # a row a range
    before = size.select("_p", (F.sum("_s").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, 0)) - F.col("_s")).alias("_s"))
    own = F.row_number().over(W.partitionBy("_p").orderBy(column))
    return dealt.withColumn("_n", own).join(before, "_p").withColumn("id", (F.col("_s") + F.col("_n")).cast("long")).drop("_p", "_n", "_s")


def ranked(rows: DataFrame, by: tuple = ()) -> DataFrame:
    """Ranks by score, round and length, and the sum of those by score and length; what has no value has no rank, and adds
    nothing to the sum."""
    from .graph import cut

    out = rows = cut(rows)  # each rank is counted from the same rows, made once
    for column, descending, name in (("sum_hits_score", True, "rank_score"), ("source_round", False, "rank_source"), ("record_length", True, "rank_length")):
        out = out.join(_ranks(rows, column, descending, name, by=by), [*by, column], "left")
    return out.withColumn("sum_of_rank", F.coalesce("rank_score", F.lit(0.0)) + F.coalesce("rank_length", F.lit(0.0)))


#: The steps by which one of a species' rows is chosen, in this order.
STEPS = ("consensus", "voucher", "published", "newest")


def representatives(rows: DataFrame, steps: tuple = STEPS, blank: tuple = ("unknown",), unpublished: tuple = names.UNPUBLISHED, by: tuple = ("organism",)) -> DataFrame:
    """One row a species (or other key, `by`). The steps narrow one after another, and each only if some row passes: that is one
    lexicographic order with missing values last.

    consensus: the least sum of ranks, and of these the highest consensus. voucher: any but null, blank and `blank` ones,
    whatever their case. published: a journal without any word of `unpublished`; one that is null is no objection. newest: the last
    date. A step that isn't named is left out. What still ties goes by the sum of ranks, then the accession.
    """
    if set(steps) - set(STEPS):
        raise ValueError(f"steps are {', '.join(STEPS)}")
    voucher = F.lower(F.trim("specimen_voucher"))
    order = {
        "consensus": [F.asc_nulls_last("sum_of_rank"), F.desc_nulls_last("consensus_value")],
        "voucher": [F.coalesce(~voucher.isin("", *blank), F.lit(False)).desc()],
        "published": [names.published(F.col("journal"), unpublished, missing=True).desc()],
        "newest": [F.desc_nulls_last("date")],
    }
    return first_of(rows, list(by), [o for s in STEPS if s in steps for o in order[s]] + [F.asc_nulls_last("sum_of_rank"), F.asc("accession")])


def evaluated(records: DataFrame, hits: DataFrame, min_records: int = 4, by: tuple = ()) -> DataFrame:
    """records (accession, organism, aligned seq and what else they hold) with the sums of their best hit (accession,
    sum_hits_score, source_round), record_length without gaps and ambiguity codes, and consensus_value: the identity to the species'
    consensus over the whole width, -1 where it has fewer than min_records records. Records without a hit go."""
    from .alignment import consensus, whole_identity

    records = records.withColumn("_of", F.struct(*by, "organism"))
    common = consensus(records, "_of", min_records).select("_of", "consensus")
    value = F.coalesce(F.when(F.col("consensus").isNotNull(), whole_identity(F.col("seq"), F.col("consensus"))), F.lit(-1.0))
    rows = records.join(common, "_of", "left").withColumn("consensus_value", value).drop("consensus", "_of")
    return rows.withColumn("record_length", bases.n_unambiguous(F.col("seq"))).join(hits, [*by, "accession"])


def reduced(records: DataFrame, hits: DataFrame, least: int = 0, min_records: int = 4, by: tuple = ()) -> DataFrame:
    """One record of each species: names without apostrophes and ranks below species; without names that are not one
    species' and records under `least` bases; one of each (organism, sequence, voucher); evaluated, ranked and chosen."""
    from .graph import cut

    named = records.withColumn("organism", names.merged(names.without_apostrophes(F.col("organism"))))
    kept = cut(dedup_by_voucher(named.where(~names.exceptional(F.col("organism")) & long_enough(F.col("seq"), least)), by))  # read four times
    chosen = representatives(ranked(evaluated(kept, hits, min_records, by), by), by=(*by, "organism"))
    return kept.join(chosen.select(*by, "accession"), [*by, "accession"], "left_semi")


def query_set(records: DataFrame) -> DataFrame:
    """dedup_queries(), of which two must be left."""
    out = dedup_queries(records)
    if len(out.select("accession").take(2)) < 2:
        raise ValueError("fewer than two different queries")
    return out


def counted(rows: DataFrame, reason: str = "reject_reason", by: str | None = None) -> DataFrame:
    """How many rows there are, are kept and are rejected."""
    told = [F.count("*").alias("n_total"), F.count_if(F.col(reason).isNull()).alias("n_kept"), F.count_if(F.col(reason).isNotNull()).alias("n_rejected")]
    return (rows.groupBy(by) if by else rows.groupBy()).agg(*told)


def encodable(headers: DataFrame, column: str = "header", allowed: str = r"\x20-\x7E") -> DataFrame:
    """reject_reason: 'encoding' where a header has a character that is not allowed."""
    return headers.withColumn("reject_reason", F.when(~F.regexp_like(F.col(column), F.lit(rf"^[{allowed}]*\z")), "encoding"))


def clade_reference(small: DataFrame, ready: DataFrame) -> DataFrame:
    """For each genus of small (genus, family) the ready alignment (genus, family) to add it to: of its family, the least by
    name, or else the least of all. It is never its own. The least two of all and of each family are enough to tell."""
    w = W.partitionBy("family").orderBy("genus")
    firsts = ready.withColumn("_n", F.row_number().over(w)).where("_n <= 2")
    own = small.alias("s").join(firsts.alias("r"), (F.col("s.family") == F.col("r.family")) & (F.col("s.genus") != F.col("r.genus")), "left")
    own = own.groupBy(F.col("s.genus").alias("genus"), F.col("s.family").alias("family")).agg(F.min("r.genus").alias("_own"))
    two = ready.select("genus").orderBy("genus").limit(2).agg(F.sort_array(F.collect_list("genus")).alias("_all"))  # one row
    other = F.try_element_at(F.filter("_all", lambda g: g != F.col("genus")), F.lit(1))
    return own.join(F.broadcast(two)).select("genus", "family", F.coalesce("_own", other).alias("reference"))


def length_tiers(rows: DataFrame, by: str, backbone: int = 100) -> DataFrame:
    """tier 1: the longest ones; 2: over half of the last of these; 3: the rest."""
    n = F.row_number().over(W.partitionBy(by).orderBy(F.desc("length"), "accession"))
    out = rows.withColumn("_n", n).withColumn("_cut", F.min(F.when(F.col("_n") <= backbone, F.col("length"))).over(W.partitionBy(by)))
    return out.withColumn("tier", F.when(F.col("_n") <= backbone, 1).when(F.col("length") > F.col("_cut") / 2, 2).otherwise(3)).drop("_n", "_cut")


def length_split(rows: DataFrame, by: str, share: float = 0.6) -> DataFrame:
    """longer: whether a row has at least `share` of its group's greatest length."""
    most = rows.groupBy(by).agg(F.max("length").alias("_m"))
    return rows.join(most, by).withColumn("longer", F.col("length") >= share * F.col("_m")).drop("_m")


def long_enough(seq: Column, least: int, ignore_gaps: bool = True) -> Column:
    return F.length(F.replace(seq, F.lit("-"), F.lit("")) if ignore_gaps else seq) >= least


def without_duplicates(rows: DataFrame, key: str, policy: str = "keep_longest", length: str = "length", tie: str = "accession") -> DataFrame:
    """Rows whose key occurs once, and of keys that occur more than once the longest row (keep_longest) or none (skip); with
    'error' such keys are one."""
    if policy == "keep_longest":
        return longest(rows, [key], length, [tie])
    if policy not in ("skip", "error"):
        raise ValueError("the policy must be keep_longest, skip or error")
    twice = rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)
    if policy == "error" and (some := [r[0] for r in twice.orderBy(key).limit(5).collect()]):
        raise ValueError(f"occur more than once: {', '.join(map(str, some))}")
    return rows.join(twice, key, "left_anti")


def even_subsets(rows: DataFrame, by: str, most: int = 200) -> DataFrame:
    """Numbered subsets of each group, of sizes that differ by one at most and do not exceed `most`."""
    w = W.partitionBy(by)
    out = rows.withColumn("_c", F.count("*").over(w)).withColumn("_n", F.row_number().over(w.orderBy("accession")) - 1)
    return out.withColumn("subset", F.pmod(F.col("_n"), F.ceil(F.col("_c") / most)).cast("int") + 1).drop("_c", "_n")
