"""Hit tables: chaining, best hits, extension, accumulation until saturation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .curate import quantiles


def chain(hits: DataFrame, max_len: int, query_len: Column) -> DataFrame:
    """One row for each (query, subject): the span that its best HSP and those in line with it cover, their number and the
    sums of their lengths and scores.

    The best HSP by score, length, identity (then places and id) is the seed. Others need its strands on query and
    subject, and must be shifted against it the same way at both ends of the query, at both ends of the subject, and
    alike on both as the strands have it. The span widens greedily in that order while it stays within
    min(1.05 * query length, max_len); a query end follows only where the subject's end on its side does.

    Seeds are found first, as a least row; then only the HSPs in line with theirs are sent and ordered.
    """
    row = F.struct(
        (-F.col("bit_score")).alias("r1"), (-F.col("alignment_length")).alias("r2"), (-F.col("n_identity")).alias("r3"),
        F.col("s_start").alias("ss"), F.col("q_start").alias("qs"), F.col("hsp_id").alias("hsp"), F.col("q_end").alias("qe"), F.col("s_end").alias("se"),
        F.when(F.col("s_end") > F.col("s_start"), 1).otherwise(-1).alias("s"), F.when(F.col("q_end") > F.col("q_start"), 1).otherwise(-1).alias("q"),
        F.col("alignment_length").alias("len"), F.col("bit_score").alias("score"),
    )
    limit = F.least(F.lit(1.05) * query_len, F.lit(float(max_len)))
    rows = hits.select("query_acc", "subject_acc", limit.alias("_limit"), row.alias("h"))
    seeds = rows.groupBy(F.col("query_acc").alias("_q"), F.col("subject_acc").alias("_s")).agg(F.min("h").alias("seed"), F.max("_limit").alias("_most"))
    met = rows.join(seeds, F.col("query_acc").eqNullSafe(F.col("_q")) & F.col("subject_acc").eqNullSafe(F.col("_s")))

    def shift(h, end):
        return F.signum(h[end] - F.col(f"seed.{end}"))

    def in_line(h):
        same = (h["s"] == F.col("seed.s")) & (h["q"] == F.col("seed.q"))
        ends = (shift(h, "qs") == shift(h, "qe")) & (shift(h, "ss") == shift(h, "se"))
        return same & ends & (shift(h, "ss") * F.col("seed.s") * F.col("seed.q") == shift(h, "qs"))

    kept = met.groupBy("query_acc", "subject_acc").agg(F.array_sort(F.collect_list(F.when(in_line(F.col("h")), F.col("h")))).alias("kept"), F.min("seed").alias("seed"), F.max("_most").alias("_limit"))

    def width(span):
        return F.abs(span["ss"] - span["se"]) + 1

    def widen(span, h):
        before, after = (h["ss"] - span["ss"]) * F.col("seed.s") < 0, (h["se"] - span["se"]) * F.col("seed.s") > 0
        ends = {c: F.when(wider, h[c]).otherwise(span[c]).alias(c) for c, wider in (("ss", before), ("se", after), ("qs", before), ("qe", after))}
        wide = F.struct(*(ends[c] for c in ("ss", "se", "qs", "qe")))
        return F.when(width(wide) <= F.col("_limit"), wide).otherwise(span)

    start = F.struct(*(F.col(f"seed.{c}").alias(c) for c in ("ss", "se", "qs", "qe")))

    fits = F.abs(F.col("seed.ss") - F.col("seed.se")) + 1 <= F.col("_limit")
    out = kept.withColumn("span", F.when(fits, F.aggregate("kept", start, widen)).otherwise(start))
    length = F.aggregate("kept", F.lit(0).cast("bigint"), lambda a, h: a + h["len"])
    score = F.aggregate("kept", F.lit(0.0), lambda a, h: a + h["score"].cast("double"))
    return out.select(
        "query_acc", "subject_acc", F.col("seed.hsp").alias("hsp_id"), F.col("span.qs").alias("q_start"), F.col("span.qe").alias("q_end"),
        F.col("span.ss").alias("s_start"), F.col("span.se").alias("s_end"), (F.col("seed.q") > 0).alias("q_strand"), (F.col("seed.s") > 0).alias("s_strand"),
        F.size("kept").alias("hits_num"), length.alias("sum_hits_alignlen"), score.alias("sum_hits_score"),
    )


def with_length(hits: DataFrame, requests: DataFrame) -> DataFrame:
    """hits with query_len, by their query; hits of queries that were not asked for go."""
    return hits.join(requests.select("query_acc", "query_len"), "query_acc")


def best_per_subject(joined: DataFrame) -> DataFrame:
    """For each subject the row with the highest summed score, then length, then the least query."""
    w = W.partitionBy("subject_acc").orderBy(F.desc("sum_hits_score"), F.desc("sum_hits_alignlen"), "query_acc")
    return joined.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def extend(joined: DataFrame, query_len: Column, max_len: int, missing_left: Column | int = 0, missing_right: Column | int = 0) -> DataFrame:
    """Where the record around a hit should be read: the query's unmatched ends (auto_extension) plus what the reference
    itself lacks (extra_extension), scaled down to what max_len leaves of the hit's length (max_extension): extension_left
    and _right, and with them the places on the query (q_extstart, q_extend) and the subject (s_extstart, s_extend)."""
    own_left, own_right = F.col("q_start") - 1, F.greatest(query_len - F.col("q_end"), F.lit(0))
    budget = F.lit(max_len) - F.abs(F.col("s_end") - F.col("s_start")) - 1
    left, right = own_left + missing_left, own_right + missing_right
    scale = F.when(left + right > budget, F.greatest(budget, F.lit(0)) / (left + right)).otherwise(F.lit(1.0))
    short = F.lit(max_len) <= query_len  # only the query's own ends then
    out = joined.withColumn("extension_left", F.when(short, own_left).otherwise(F.floor(left * scale)).cast("int")).withColumn("extension_right", F.when(short, own_right).otherwise(F.floor(right * scale)).cast("int"))
    up = F.col("s_start") <= F.col("s_end")
    begin = F.when(up, F.col("s_start") - F.col("extension_left")).otherwise(F.col("s_start") + F.col("extension_left"))
    stop = F.when(up, F.col("s_end") + F.col("extension_right")).otherwise(F.col("s_end") - F.col("extension_right"))
    told = {"hit_len": F.abs(F.col("s_end") - F.col("s_start")) + 1, "auto_extension_left": own_left, "auto_extension_right": own_right}
    for side, n in (("left", missing_left), ("right", missing_right)):
        told[f"extra_extension_{side}"] = F.lit(n) if isinstance(n, int) else n
    told |= {"max_extension": F.lit(max_len) - told["hit_len"], "q_extstart": F.col("q_start") - F.col("extension_left"), "q_extend": F.col("q_end") + F.col("extension_right")}
    return out.withColumns(told | {"s_extstart": F.greatest(begin, F.lit(1)), "s_extend": F.greatest(stop, F.lit(1))})


def fetch_range(extended: DataFrame) -> DataFrame:
    """start, end and strand (1 or 2) to read, by the extension or else the hit."""
    a, b = F.coalesce("s_extstart", "s_start"), F.coalesce("s_extend", "s_end")
    return extended.withColumn("start", F.least(a, b)).withColumn("end", F.greatest(a, b)).withColumn("strand", F.when(a <= b, 1).otherwise(2))


def reference_shortfall(aligned_query: Column) -> tuple[Column, Column]:
    """Places of an aligned query before its first and after its last plain base."""
    left = F.length(F.regexp_extract(aligned_query, "^[^ACGT]*", 0))
    return left, F.length(F.regexp_extract(aligned_query, "[^ACGT]*$", 0))


def quartile_band(joined: DataFrame) -> DataFrame:
    """Rows of each query whose score lies between the quartiles, these included."""
    q = quantiles(joined, "sum_hits_score", ["query_acc"], [0.25, 0.75])
    return joined.join(q, "query_acc").where(F.col("sum_hits_score").between(F.col("q")[0], F.col("q")[1])).drop("q")


def sampled(rows: DataFrame, by: str, key: str, n: int, seed: str = "1") -> DataFrame:
    """At most n rows of each group, the first by a seeded hash: the same ones each time."""
    w = W.partitionBy(by).orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def new_accessions(round_hits: DataFrame, before: DataFrame) -> DataFrame:
    return round_hits.select("subject_acc").distinct().join(before.select("subject_acc"), "subject_acc", "left_anti")


def pending(wanted: DataFrame, done: DataFrame, failed: DataFrame, key: str = "subject_acc") -> DataFrame:
    return wanted.join(done.select(key), key, "left_anti").join(failed.select(key), key, "left_anti")


def round_summary(hits: DataFrame, passing: Column) -> DataFrame:
    """For each round how many subjects it is the first to find, how many of these pass, and the total so far."""
    first = hits.withColumn("_ok", passing).groupBy("subject_acc").agg(F.min("source_round").alias("source_round"), F.max("_ok").alias("ok"))
    per = first.groupBy("source_round").agg(F.count("*").alias("n_new"), F.count_if("ok").alias("n_passing"))
    return per.withColumn("n_total", F.sum("n_new").over(W.orderBy("source_round").rowsBetween(W.unboundedPreceding, 0)))  # a row a round


def saturation(hits: DataFrame, passing: Column, expected: int, few: int = 3) -> DataFrame:
    """The summary's rounds up to the one at which mining stops: the total is over 1.2 * expected, or two rounds running
    bring fewer than `few` that pass."""
    s = round_summary(hits, passing)
    w = W.orderBy("source_round")  # a row a round
    stop = (F.col("n_total") > 1.2 * expected) | (F.col("n_passing") < few) & F.coalesce(F.lag("n_passing").over(w) < few, F.lit(False))
    s = s.withColumn("stops", stop)
    return s.withColumn("_b", F.sum(F.col("stops").cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1))).where("coalesce(_b, 0) = 0").drop("_b")


def mined(find_round, passing: Column, expected: int, few: int = 3, rounds: int = 100, cut=lambda df: df) -> DataFrame:
    """Rounds of hits until no more are worth having: (subject_acc, source_round, ok) of every subject found.

    find_round(n, found) gives round n's hits (subject_acc and what `passing` looks at), or None where there are no new
    queries; found is what the rounds before it brought. The loop ends after the round at which the total is over
    1.2 * expected, or the second one running with fewer than `few` new subjects that pass, or without any query.
    cut() stores what has been found, so that no round's plan holds the earlier ones'.
    """
    found, before, total = None, few, 0
    for n in range(1, rounds + 1):
        hits = find_round(n, found)
        if hits is None:
            break
        new = hits.withColumn("_ok", passing).groupBy("subject_acc").agg(F.lit(n).alias("source_round"), F.max("_ok").alias("ok"))
        found = cut(new if found is None else found.unionByName(new.join(found.select("subject_acc"), "subject_acc", "left_anti")))
        told = found.where(F.col("source_round") == n).agg(F.count("*").alias("new"), F.count_if("ok").alias("good")).first()
        total += told["new"]
        if total > 1.2 * expected or told["good"] < few and before < few:
            break
        before = told["good"]
    return found


def radius_edges(hits: DataFrame, query_len: Column, share: float = 0.1) -> DataFrame:
    """Pairs of a query's hits whose (q_start, q_end) are within share * query length of each other: each looks only into
    its own cell of a grid of that width and the eight around. Hits at one place are best told apart by place_classes()
    first, and its representatives paired: then no number of copies makes more pairs."""
    r = query_len * share
    p = hits.select("query_acc", F.col("hsp_id").alias("i"), F.col("q_start").alias("x"), F.col("q_end").alias("y"), r.alias("r"))
    p = p.withColumn("cx", F.floor(F.col("x") / F.col("r"))).withColumn("cy", F.floor(F.col("y") / F.col("r")))
    near = p.withColumn("dx", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn("dy", F.explode(F.array(*map(F.lit, (-1, 0, 1)))))
    near = near.select("query_acc", F.col("i").alias("j"), F.col("x").alias("x2"), F.col("y").alias("y2"), (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"))
    both = p.join(near, ["query_acc", "cx", "cy"]).where("i < j")
    return both.where(F.pow(F.col("x") - F.col("x2"), 2) + F.pow(F.col("y") - F.col("y2"), 2) <= F.pow("r", 2)).select("query_acc", "i", "j")


def place_classes(hits: DataFrame) -> DataFrame:
    """Hits with `place`, the least hsp_id of those that have their query, q_start and q_end."""
    least = hits.groupBy("query_acc", "q_start", "q_end").agg(F.min("hsp_id").alias("place"))
    return hits.join(least, ["query_acc", "q_start", "q_end"])
