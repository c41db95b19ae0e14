"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in DataFrame functions alone.

A text's paragraphs (lines, cut further after sentence ends) are hashed; equal paragraphs count once. A sketch has three
parts of `third` cells; a digest goes to one cell of each part, which adds one to its count and folds the digest and a
check of it in by exclusive or. The cells of two versions subtract, what both hold cancels, and peeling recovers the
rest: a cell that holds one digest gives it up, which leaves others with one. Where peeling gets stuck, it is retried on
sketches that are larger: the digests are dealt to more sketches, and each that fails again is doubled with other seeds.
A share of digests that fails all TRIES times is compared as it is, so that every difference is whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import read, staged

#: Cells of each of a fingerprint's three parts, and the digests that share a sketch when it is retried larger.
THIRD, SHARE, TRIES = 8, 12, 8
PARAGRAPH_END = r"\n+|(?<=[.!?])\s+"
DIFFERENCE = "array<struct<k:bigint,c:int>>"


def digests(text: Column) -> Column:
    """The distinct paragraphs' hashes; none for null and blank texts."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), PARAGRAPH_END), lambda p: F.trim(p) != "")
    return F.array_distinct(F.transform(parts, lambda p: F.xxhash64(p)))


def _check(k: Column) -> Column:
    return F.xxhash64(k, F.lit(99)).bitwiseAND(F.lit(0xFFFFFFFF))


def _places(k: Column, third: Column, seed: Column) -> Column:
    """A digest's cells, one in each part."""
    wide = third.cast("bigint")
    return F.transform(F.array(F.xxhash64(k, seed)), lambda p: F.array(*((F.pmod(F.shiftrightunsigned(p, 16 * i), wide) + wide * i).cast("int") for i in range(3))))[0]


def _entry(k: Column, third: Column, seed: Column) -> Column:
    return F.struct(k.alias("k"), _places(k, third, seed).alias("at"), _check(k).alias("h"))


def _put(cell: Column, e: Column, count: Column) -> Column:
    return F.struct((cell["c"] + count).alias("c"), cell["k"].bitwiseXOR(e["k"]).alias("k"), cell["h"].bitwiseXOR(e["h"]).alias("h"))


def sketch(keys: Column, third: Column, seed: Column) -> Column:
    """3 * third cells (count, digests, checks) of an array of digests."""
    none = F.struct(F.lit(0).alias("c"), F.lit(0).cast("bigint").alias("k"), F.lit(0).cast("bigint").alias("h"))

    def cells(entries):
        def part(i):
            return F.transform(F.sequence(third * i, third * (i + 1) - 1), lambda j: F.aggregate(F.filter(entries, lambda e: e["at"][i] == j), none, lambda cell, e: _put(cell, e, F.lit(1))))

        return F.concat(*(part(i) for i in range(3)))

    return F.element_at(F.transform(F.array(F.transform(keys, lambda k: _entry(k, third, seed))), cells), 1)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["c"] - y["c"]).alias("c"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["h"].bitwiseXOR(y["h"]).alias("h")))


def peel(cells: Column, third: Column, seed: Column) -> Column:
    """The digests that only the first (c = 1) or only the second (c = -1) version has, or null where some stay hidden."""

    def pure(now):
        single = F.filter(now, lambda x: (F.abs(x["c"]) == 1) & (x["h"] == _check(x["k"])))
        return F.array_distinct(F.transform(single, lambda x: F.struct(x["k"].alias("k"), _places(x["k"], third, seed).alias("at"), x["h"].alias("h"), x["c"].alias("c"))))

    def state(now, out):
        return F.element_at(F.transform(F.array(now), lambda n: F.struct(n.alias("cells"), pure(n).alias("pure"), out.alias("out"))), 1)

    def round_(s, _):
        now = F.transform(s["cells"], lambda x, j: F.aggregate(F.filter(s["pure"], lambda e: F.array_contains(e["at"], j)), x, lambda cell, e: _put(cell, e, -e["c"])))
        told = F.concat(s["out"], F.transform(s["pure"], lambda e: F.struct(e["k"].alias("k"), e["c"].alias("c"))))
        return F.when(F.size(s["pure"]) == 0, s).otherwise(state(now, told))

    def done(s):
        left = F.exists(s["cells"], lambda x: (x["c"] != 0) | (x["k"] != 0) | (x["h"] != 0))
        return F.when(~left, s["out"])

    return F.aggregate(F.sequence(F.lit(1), third * 3), state(cells, F.array().cast(DIFFERENCE)), round_, done)


def _retried(a: Column, b: Column, shares: Column) -> Column:
    """The difference of two arrays of digests, by sketches of a share of them each."""

    def share(keys, g):
        return F.filter(keys, lambda k: F.pmod(F.call_function("shiftrightunsigned", k, F.lit(40)), shares.cast("bigint")) == g)

    def attempt(x, y, i):
        third, seed = F.call_function("shiftleft", F.lit(THIRD), i - 1), i
        return peel(subtract(sketch(x, third, seed), sketch(y, third, seed)), third, seed)

    def one(g):
        def tried(pair):
            got = F.aggregate(F.sequence(F.lit(1), F.lit(TRIES)), F.lit(None).cast(DIFFERENCE), lambda r, i: F.when(r.isNotNull(), r).otherwise(attempt(pair["x"], pair["y"], i)))
            exact = F.concat(F.transform(F.array_except(pair["x"], pair["y"]), lambda k: F.struct(k.alias("k"), F.lit(1).alias("c"))), F.transform(F.array_except(pair["y"], pair["x"]), lambda k: F.struct(k.alias("k"), F.lit(-1).alias("c"))))
            return F.coalesce(got, exact)

        return F.element_at(F.transform(F.array(F.struct(share(a, g).alias("x"), share(b, g).alias("y"))), tried), 1)

    return F.flatten(F.transform(F.sequence(F.lit(0).cast("bigint"), shares.cast("bigint") - 1), one))


def difference(a: Column, b: Column, a_cells: Column, b_cells: Column) -> Column:
    """The paragraph digests in which two versions differ, from their fingerprints' cells; larger sketches of the digests
    where these are too small."""
    third, seed = F.lit(THIRD), F.lit(0)
    shares = F.greatest(F.lit(1), F.ceil((F.size(a) + F.size(b)) / SHARE).cast("int"))
    return F.coalesce(peel(subtract(a_cells, b_cells), third, seed), _retried(a, b, shares))


def likeness(n_a: Column, n_b: Column, n_diff: Column) -> Column:
    """Paragraphs in both by paragraphs in either, by the sizes of both and of the recovered difference; 1 for two empty
    texts. The last is used twice, so it should be a column."""
    both = (n_a + n_b - n_diff) / 2
    return F.when(n_a + n_b == 0, F.lit(1.0)).otherwise(both / (n_a + n_b - both))


def cells_of(keys: Column) -> Column:
    return sketch(keys, F.lit(THIRD), F.lit(0))


def as_text(keys: Column, cells: Column) -> Column:
    """A fingerprint: how many digests, then each cell in hexadecimal digits."""
    told = F.transform(cells, lambda x: F.concat(F.lpad(F.hex(x["c"]), 4, "0"), F.lpad(F.hex(x["k"]), 16, "0"), F.lpad(F.hex(x["h"]), 8, "0")))
    return F.lower(F.concat(F.size(keys).cast("string"), F.lit(":"), F.array_join(told, "")))


def following(docs: DataFrame) -> DataFrame:
    """(k, next): for each distinct key the next smaller one, for the smallest the largest. Keys alone are sorted, by
    ranges; between ranges one row each decides."""
    ranged = staged(docs.select("k").distinct().repartitionByRange("k").select("k", F.spark_partition_id().alias("part")))
    heads = ranged.groupBy("part").agg(F.max("k").alias("head")).orderBy("part").collect()  # one row a partition
    before = {r["part"]: heads[i - 1]["head"] for i, r in enumerate(heads)}
    within = F.lag("k").over(W.partitionBy("part").orderBy("k"))
    if not before:
        return ranged.select("k", F.col("k").alias("next"))
    edge = F.create_map(*(F.lit(x) for pair in before.items() for x in pair))
    return ranged.select("k", F.coalesce(within, edge[F.col("part")]).alias("next"))


def compared(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for every row of docs: id, n_chars, edited (the last floor(n_chars / 3) code points replaced by the first as
    many, or all, of the next document's), keys, edited_keys, next_keys, and the fingerprints' cells of each.

    The next document is the one with the next smaller id, after the smallest the largest. A null text counts as empty,
    a null id as the least. Of rows with equal ids each is compared, and the greatest text stands for them as a next
    document. A table of one document has itself as next; an empty table gives an empty result. Very long texts count
    whole. Other columns of docs don't matter, whatever their names. The text is shuffled once, by id, and its second use reads
    the same exchange.
    """
    least = -(1 << 63)
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(least)).alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    asked = own.groupBy("k").agg(F.floor(F.max(F.length("text")) / 3).cast("int").alias("want"))
    asked = asked.join(following(own), "k").select(F.col("k").alias("asker"), "want", F.col("next").alias("k"))
    told = own.join(asked, "k").select("asker", F.struct("text", F.expr("left(text, want)").alias("head"), digests(F.col("text")).alias("keys")).alias("n"))
    told = told.groupBy(F.col("asker").alias("k")).agg(F.max(F.struct(F.col("n.head"), F.col("n.keys"))).alias("n"))
    n = F.length("text")
    rows = own.join(told, "k").select("k", n.cast("long").alias("n_chars"), digests(F.col("text")).alias("keys"), F.concat(F.expr("left(text, cast(length(text) - floor(length(text) / 3) as int))"), F.expr("left(n.head, cast(floor(length(text) / 3) as int))")).alias("edited"), F.col("n.keys").alias("next_keys"))
    rows = rows.withColumn("edited_keys", digests(F.col("edited")))
    for c in ("keys", "edited_keys", "next_keys"):
        rows = rows.withColumn(c.replace("keys", "cells"), cells_of(F.col(c)))
    return rows.withColumn("id", F.when(F.col("k") != least, F.col("k")))


def op2_fingerprint(spark, sf_dir: str) -> DataFrame:
    rows = compared(read(spark, sf_dir, "documents"))
    for c in ("edited", "next"):
        rows = rows.withColumn(f"{c}_differ", F.size(difference(F.col("keys"), F.col(f"{c}_keys"), F.col("cells"), F.col(f"{c}_cells"))))
    size = {c: F.size(c) for c in ("keys", "edited_keys", "next_keys")}
    return rows.select(
        F.col("id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("keys"), F.col("cells")).alias("fingerprint"), as_text(F.col("edited_keys"), F.col("edited_cells")).alias("edited_fingerprint"),
        likeness(size["keys"], size["edited_keys"], F.col("edited_differ")).alias("near_edited"),
        likeness(size["keys"], size["next_keys"], F.col("next_differ")).alias("near_next"),
    )
