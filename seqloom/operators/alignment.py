"""Aligned sequences of a group: columns, consensus, identity, trimming. Columns are counted before anything is joined."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.functions.bases import CODE_OF, IUPAC, aligned_place, ends, equality, equality_of
from seqloom.functions.names import header_range, with_range

from . import compare
from .graph import cut

# What a code of one, two, three or four bases gives each of them in a vote.
VOTE = {1: 1.0, 2: 0.5, 3: 0.33333, 4: 0.25}


def long_form(aln: DataFrame, group: str) -> DataFrame:
    """(group, accession, pos, base): one row a place, and whether it lies within the sequence's ends."""
    first, last = ends(F.col("seq"))
    cells = aln.select(group, "accession", first.alias("_f"), last.alias("_l"), F.posexplode(F.filter(F.split(F.upper("seq"), ""), lambda c: c != "")).alias("p", "base"))
    return cells.select(group, "accession", (F.col("p") + 1).alias("pos"), "base", F.coalesce((F.col("p") + 1).between(F.col("_f"), F.col("_l")), F.lit(False)).alias("inside"))


def column_counts(aln: DataFrame, group: str) -> DataFrame:
    """(group, pos, n_rows, n_gaps, gap_fraction)."""
    cols = long_form(aln, group).groupBy(group, "pos").agg(F.count("*").alias("n_rows"), F.count_if(F.col("base") == "-").alias("n_gaps"))
    return cols.withColumn("gap_fraction", F.col("n_gaps") / F.col("n_rows"))


def consensus(aln: DataFrame, group: str, min_records: int = 1) -> DataFrame:
    """The consensus of each group of min_records or more: the winners of each column's votes as one code; a tie with a gap
    gives N, a gap alone -, and a column that lies outside all ends N. A group of one record has that as it is."""
    cells = long_form(aln, group)
    counts = cells.groupBy(group, "pos", "base").agg(F.count_if("inside").alias("n"))
    votes = F.create_map(*(x for c, b in {**IUPAC, "-": "-"}.items() for x in (F.lit(c), F.array(*(F.struct(F.lit(y).alias("b"), F.lit(VOTE[len(b)]).alias("v")) for y in b)))))
    cast = counts.select(group, "pos", "n", F.explode(votes[F.col("base")]).alias("x")).groupBy(group, "pos", F.col("x.b").alias("b")).agg(F.round(F.sum(F.col("n") * F.col("x.v")), 9).alias("v"))
    top = cast.groupBy(group, "pos").agg(F.max("v").alias("best"), F.array_sort(F.collect_list(F.struct("b", "v"))).alias("all"))
    won = F.array_join(F.transform(F.filter("all", lambda x: x["v"] == F.col("best")), lambda x: x["b"]), "")
    code = F.create_map(*(F.lit(x) for p in CODE_OF.items() for x in p))
    base = F.when(F.col("best") == 0, "N").when(won == "-", "-").when(F.contains(won, F.lit("-")), "N").otherwise(code[won])
    n = aln.groupBy(group).agg(F.count("*").alias("n_records"), F.max("seq").alias("_only")).where(F.col("n_records") >= min_records)
    out = top.select(group, "pos", base.alias("base")).groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "base"))), lambda x: x["base"]), "").alias("consensus"))
    return n.join(out, group, "left").select(group, F.when(F.col("n_records") == 1, F.col("_only")).otherwise(F.coalesce("consensus", F.lit(""))).alias("consensus"), "n_records")


def _overlap(a: Column, b: Column) -> tuple[Column, Column]:
    (f1, l1), (f2, l2) = ends(a), ends(b)
    return F.greatest(f1, f2), F.least(l1, l2)


def identity(a: Column, b: Column) -> Column:
    """Mean agreement of two aligned sequences between their common ends, without columns in which both have gaps; 0 where
    nothing is left, null where either is."""
    start, stop = _overlap(a, b)
    cut = lambda s: F.split(F.substring(F.upper(s), start, stop - start + 1), "")
    pairs = F.filter(F.zip_with(cut(a), cut(b), lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda p: (p["x"] != "") & ~((p["x"] == "-") & (p["y"] == "-")))
    total = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + equality_of(p["x"], p["y"]))
    return F.when((start <= stop) & (F.size(pairs) > 0), total / F.size(pairs)).when(a.isNotNull() & b.isNotNull(), 0.0)


def whole_identity(a: Column, b: Column) -> Column:
    """identity() over the whole width, ends or not."""
    cut = lambda s: F.split(F.upper(s), "")
    cells = F.filter(F.zip_with(cut(a), cut(b), lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda p: (p["x"] != "") & ~((p["x"] == "-") & (p["y"] == "-")))
    return F.when(F.size(cells) > 0, F.aggregate(cells, F.lit(0.0), lambda s, p: s + equality_of(p["x"], p["y"])) / F.size(cells))


def distinct_rows(aln: DataFrame, group: str) -> DataFrame:
    """(group, seq, accession, n): each different sequence of a group once, with its least accession and how many have it."""
    return aln.groupBy(group, "seq").agg(F.min("accession").alias("accession"), F.count("*").alias("n"))


def average_identity(aln: DataFrame, group: str) -> DataFrame:
    """(group, avg_pi, n_pairs) over all pairs of rows, those without a common place at 0: different sequences are compared
    once, block against block, and counted by their copies."""
    sums = compare.average_identity(distinct_rows(aln, group), group).groupBy(group).agg(F.sum("total").alias("total"), F.sum("n").alias("n_pairs"))
    return sums.where("n_pairs > 0").select(group, (F.col("total") / F.col("n_pairs")).alias("avg_pi"), "n_pairs")


def sum_of_pairs(aln: DataFrame, group: str, conservative: bool = True) -> DataFrame:
    """By counts of bases in columns, not pairs of rows: each pair's agreement, or where it is 0 a penalty of 2 (1 if not
    `conservative`); inner gaps cost 2 to open and 1 to go on."""
    counts = long_form(aln, group).where("base != '-'").groupBy(group, "pos", "base").agg(F.count("*").alias("n"))
    other = counts.select(group, "pos", F.col("base").alias("b2"), F.col("n").alias("n2"))
    both = counts.join(other, [group, "pos"]).where("base <= b2")
    number = F.when(F.col("base") == F.col("b2"), F.col("n") * (F.col("n") - 1) / 2).otherwise(F.col("n") * F.col("n2"))
    table = {f"{x}{y}": equality(x, y) or (-2.0 if conservative else -1.0) for x in IUPAC for y in IUPAC}
    value = F.create_map(*(F.lit(v) for p in table.items() for v in p))[F.concat("base", "b2")]
    match = both.groupBy(group).agg(F.sum(number * value).alias("match"))
    inner = F.regexp_replace(F.regexp_replace("seq", "^-+", ""), "-+$", "")
    gaps, runs = F.length(F.regexp_replace(inner, "[^-]", "")), F.size(F.regexp_extract_all(inner, F.lit("-+"), F.lit(0)))
    cost = aln.groupBy(group).agg(F.sum(gaps + runs).alias("cost"))
    return cost.join(match, group, "left").select(group, (F.coalesce("match", F.lit(0.0)) - F.col("cost")).alias("sp_score"))


def boundaries(aln: DataFrame, group: str, threshold: float = 0.025) -> DataFrame:
    """First and last column with a gap fraction under the threshold."""
    return column_counts(aln, group).where(F.col("gap_fraction") < threshold).groupBy(group).agg(F.min("pos").alias("first"), F.max("pos").alias("last"))


def boundary_trim(aln: DataFrame, group: str, threshold: float = 0.025) -> DataFrame:
    """Every row cut to its group's boundaries; groups without any stay as they are."""
    out = aln.join(boundaries(aln, group, threshold), group, "left")
    return out.withColumn("seq", F.when(F.col("first").isNotNull(), F.substring("seq", F.col("first"), F.col("last") - F.col("first") + 1)).otherwise(F.col("seq"))).drop("first", "last")


def common_ends(aln: DataFrame, group: str, rows: int | None = None) -> DataFrame:
    """First column without gaps, and one past the last; nulls where there is none. `rows`: only the first so many of each
    group, by accession, are looked at."""
    if rows:
        aln = aln.withColumn("_n", F.row_number().over(W.partitionBy(group).orderBy("accession"))).where(F.col("_n") <= rows).drop("_n")
    full = F.when(F.col("n_gaps") == 0, F.col("pos"))
    return column_counts(aln, group).groupBy(group).agg(F.min(full).alias("first"), (F.max(full) + 1).alias("last"))


def without_columns(aln: DataFrame, group: str, drop: DataFrame) -> DataFrame:
    """Rows without the columns (group, pos) of drop, which stay one list a group."""
    lists = drop.groupBy(group).agg(F.collect_set("pos").alias("_drop"))
    kept = F.array_join(F.filter(F.filter(F.split("seq", ""), lambda c: c != ""), lambda c, i: ~F.array_contains(F.col("_drop"), (i + 1))), "")
    out = aln.join(lists.withColumn("_drop", F.col("_drop").cast("array<int>")), group, "left")
    return out.withColumn("seq", F.when(F.col("_drop").isNull(), F.col("seq")).otherwise(kept)).drop("_drop")


def rare_insertions(aln: DataFrame, group: str, rare: int = 1, run: int = 20) -> DataFrame:
    """(group, first, last) of runs of at least `run` columns in which all but `rare` rows or fewer have gaps."""
    odd = column_counts(aln, group).where(F.col("n_rows") - F.col("n_gaps") <= rare)
    island = F.col("pos") - F.row_number().over(W.partitionBy(group).orderBy("pos"))
    runs = odd.withColumn("_i", island).groupBy(group, "_i").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    return runs.where(F.col("last") - F.col("first") + 1 >= run).drop("_i")


def without_insertions(aln: DataFrame, group: str, rare: int = 1, run: int = 20) -> DataFrame:
    """Rows without the columns of their group's rare insertions, of every run of these."""
    runs = rare_insertions(aln, group, rare, run)
    return without_columns(aln, group, runs.select(group, F.explode(F.sequence("first", "last")).alias("pos")))


def gap_trim(aln: DataFrame, group: str, gt: float, cons: float = 0.0) -> DataFrame:
    """Columns to keep: a non-gap fraction of gt or more, and the fullest ones up to `cons` percent of all columns."""
    w = W.partitionBy(group)
    cols = column_counts(aln, group).withColumn("_n", F.row_number().over(w.orderBy("gap_fraction", "pos"))).withColumn("_all", F.count("*").over(w))
    return cols.where((1 - F.col("gap_fraction") >= gt) | (F.col("_n") <= F.ceil(F.col("_all") * cons / 100))).select(group, "pos")


def gap_trimmed(aln: DataFrame, group: str, gt: float, cons: float = 0.0) -> DataFrame:
    """Every row of its group's kept columns (see gap_trim()) alone."""
    return without_columns(aln, group, column_counts(aln, group).select(group, "pos").join(gap_trim(aln, group, gt, cons), [group, "pos"], "left_anti"))


def control_extension(aln: DataFrame, left: Column, right: Column, threshold: float = 0.5) -> DataFrame:
    """Cuts an end off where more than `threshold` of its extension's columns (left, right: how many) are gaps."""
    share = lambda s, n: F.when(n > 0, F.length(F.regexp_replace(s, "[^-]", "")) / n).otherwise(0.0)
    n = F.length("seq")
    a = F.when(share(F.substring("seq", F.lit(1), left), left) > threshold, left).otherwise(0)
    b = F.when(share(F.substring("seq", n - right + 1, right), right) > threshold, right).otherwise(0)
    return aln.withColumn("cut_left", a).withColumn("cut_right", b).withColumn("seq", F.substring("seq", a + 1, n - a - b))


def extension_controlled(records: DataFrame, hits: DataFrame, threshold: float = 0.5, by: tuple = (), aligned: bool = False) -> DataFrame:
    """records (accession, header with a range, aligned seq) without gaps, their extensions cut off where these are mostly
    gaps: (accession, header, seq). hits (accession, s_start, s_end) tells where the hit itself lies.

    An extension's gappiness is the share of gaps among the columns from the record's end to the hit's. Where it is over
    the threshold the record begins, or ends, with the hit, and its header says so. Records without a hit stay whole.
    `by`: columns beside the accession that tell records, such as a marker; all other columns stay too. `aligned`: gaps stay, and
    take the place of what is cut.
    """
    first, last, _ = header_range(F.col("header"))
    rows = records.withColumns({"_r1": F.least(first, last), "_r2": F.greatest(first, last), "_raw": F.replace("seq", F.lit("-"), F.lit(""))})
    rows = rows.join(hits.select(*by, "accession", F.least("s_start", "s_end").alias("_s1"), F.greatest("s_start", "s_end").alias("_s2")), [*by, "accession"], "left")
    left, right = F.col("_s1") - F.col("_r1"), F.col("_r2") - F.col("_s2")

    def gappy(bases_, from_left):
        a, b = (aligned_place(F.col("seq"), n, from_left) for n in (F.greatest(bases_ + 1, F.lit(1)), F.lit(1)))
        return F.coalesce(F.when(a != b, 1 - bases_ / F.abs(a - b)), F.lit(0.0)) > threshold

    rows = rows.withColumn("_n1", F.when(gappy(left, True), F.col("_s1")).otherwise(F.col("_r1"))).withColumn("_n2", F.when(gappy(right, False), F.col("_s2")).otherwise(F.col("_r2")))
    cut = (F.col("_n1") != F.col("_r1")) | (F.col("_n2") != F.col("_r2"))
    kept = F.substring("_raw", F.col("_n1") - F.col("_r1") + 1, F.col("_n2") - F.col("_n1") + 1)
    header = F.when(cut, with_range(F.col("header"), F.col("_n1"), F.col("_n2"))).otherwise(F.col("header"))
    if aligned:
        width = F.length("seq")
        begin = F.coalesce(aligned_place(F.col("seq"), F.col("_n1") - F.col("_r1") + 1), F.lit(1))
        stop = F.coalesce(aligned_place(F.col("seq"), F.col("_r2") - F.col("_n2") + 1, False), width)
        middle = F.concat(F.repeat(F.lit("-"), begin - 1), F.substring("seq", begin, stop - begin + 1))
        seq = F.when(cut, F.rpad(middle, width, "-")).otherwise(F.col("seq"))
    else:
        seq = F.when(cut, kept).otherwise(F.col("_raw"))
    return rows.select(*(header.alias("header") if c == "header" else seq.alias("seq") if c == "seq" else F.col(c) for c in records.columns))


def p_distance_edges(aln: DataFrame, group: str, most: float = 0.3) -> DataFrame:
    """Pairs of a group's rows whose share of differing places is `most` or less; ambiguity codes are classes of their own.
    The pairs are the result, so they grow with the square of a group; they are made in blocks, copies' at distance 0, and not shuffled."""
    return compare.near_rows(aln, group, most)


def sequence_classes(records: DataFrame) -> DataFrame:
    """(accession, sid): of each record (accession, seq) the least accession that has its sequence, in any case; texts are
    told by digests, so none is shuffled. Nulls are a class."""
    told = records.select("accession", F.coalesce(F.unhex(F.sha2(F.upper("seq"), 256)), F.lit(b"")).alias("_d"))
    return told.join(told.groupBy("_d").agg(F.min("accession").alias("sid")), "_d").select("accession", "sid")


def kmer_similarity(records: DataFrame, k: int, ambiguity: str = "drop") -> tuple[DataFrame, DataFrame]:
    """(pairs, members): sid, sid_2, shared and similarity of different sequences with common k-mers, the multisets'
    intersection by the smaller one's size; and the sequence, sid, of each accession (its least accession). Pairs without
    a common k-mer are absent; copies are one sequence, so they make no pairs.

    Ambiguity codes are dropped before k-mers are cut, or else ('expand') a k-mer counts for every plain one that it may
    stand for. K-mers meet in stretches of neighbours, at four bases a byte; those of one sequence alone go before sequences
    meet, block against block. Null sequences have no k-mers.
    """
    if not 0 < k <= 31 or ambiguity not in ("drop", "expand"):
        raise ValueError("k must be 1 to 31, and ambiguity drop or expand")
    rows = records.select("accession", F.upper("seq").alias("seq")).where("seq is not null")
    sequences = rows.groupBy("seq").agg(F.min("accession").alias("sid"))
    numbered = cut(sequences.withColumn("uid", F.monotonically_increasing_id()))
    parts = sorted(numbered.groupBy(F.shiftright("uid", 33)).count().collect())  # a row a partition
    begin = records.sparkSession.createDataFrame(list(zip((p for p, _ in parts), accumulate((n for _, n in parts), initial=0))), "_p long, _from long")
    numbered = numbered.withColumn("_p", F.shiftright("uid", 33)).join(F.broadcast(begin), "_p").select("sid", "seq", (F.col("uid") - F.shiftleft("_p", 33) + F.col("_from")).alias("uid"))
    names = cut(compare.kmer_sizes(numbered, k, ambiguity))
    buckets = 1 + (names.agg(F.sum("n")).first()[0] or 0) // compare.KMERS
    lists = cut(compare.stretch_lists(compare.kmer_stretches(numbered, k, ambiguity, buckets), k))
    return compare.shared_kmers(lists, names), sequence_classes(records)
