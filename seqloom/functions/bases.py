"""Nucleotide strings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The IUPAC codes and the bases each stands for.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "M": "AC", "K": "GT", "S": "CG", "W": "AT", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
#: The same by set of bases.
CODE_OF = {v: k for k, v in IUPAC.items()}


def complement(seq: Column) -> Column:
    other = str.maketrans("ACGT", "TGCA")
    of = {c: CODE_OF["".join(sorted(bases.translate(other)))] for c, bases in IUPAC.items()}
    return F.translate(seq, "".join(of), "".join(of.values()))


def reverse_complement(seq: Column | str) -> Column:
    return F.reverse(complement(seq))


def location_parts(location: Column) -> Column:
    """A feature's parts (start and end, 0-based and half open, and strand), in the order in which they are read, of its
    location text: each part has its own strand, and a complement around a join turns its order too."""
    plain = F.regexp_replace(F.regexp_replace(location, r"\s", ""), r"[A-Za-z][A-Za-z0-9_.]*:", "")
    whole = F.regexp_like(plain, F.lit(r"^complement\((join|order)\("))

    def part(p):
        first = F.regexp_extract(p, r"(\d+)", 1).cast("int")
        last = F.regexp_extract(p, r"(\d+)$", 1).cast("int")
        return F.struct((first - 1).alias("start"), last.alias("end"), F.when(whole != F.startswith(p, F.lit("complement")), -1).otherwise(1).alias("strand"))

    parts = F.transform(F.regexp_extract_all(plain, F.lit(r"(?:complement\()?[<>]?\d+(?:(?:\.\.|\^)[<>]?\d+)?"), F.lit(0)), part)
    return F.when(whole, F.reverse(parts)).otherwise(parts)


def splice(seq: Column, parts: Column) -> Column:
    """Joins 0-based half-open parts (start, end, strand) as listed; one on strand -1 is reverse-complemented."""

    def one(p):
        piece = F.substring(seq, p["start"] + 1, p["end"] - p["start"])
        return F.when(p["strand"] == -1, reverse_complement(piece)).otherwise(piece)

    return F.array_join(F.transform(parts, one), "")


def n_plain(seq: Column) -> Column:
    """A, C, G and T."""
    return F.length(F.regexp_replace(F.upper(seq), "[^ACGT]", ""))


def n_unambiguous(seq: Column) -> Column:
    """Length without ambiguity codes and gaps."""
    return F.length(F.translate(F.upper(seq), "RYKMSWBDHVN-", ""))


def kmers(seq: Column, k: int) -> Column:
    """All k-mers in order; none of sequences that are too short."""
    n = F.length(seq) - k + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(seq, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def kmer_index(kmer: Column) -> Column:
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("bigint")


def expanded(kmer: Column) -> Column:
    """Every plain k-mer that an ambiguous one stands for."""
    choices = F.create_map(*(F.lit(x) for c, b in IUPAC.items() for x in (c, b)))
    start = F.array(F.lit(""))
    return F.aggregate(F.split(kmer, ""), start, lambda acc, c: F.when(c == "", acc).otherwise(F.flatten(F.transform(acc, lambda a: F.transform(F.split(choices[c], ""), lambda b: F.concat(a, b))))))


def equality(a: str, b: str) -> float:
    """How far two codes agree: a code by the bases it stands for; two different ambiguous ones only by way of N."""
    if "-" in (a, b):
        return float(a == b)
    x, y = IUPAC[a], IUPAC[b]
    if a == b:
        return 1 / len(x)
    if "N" in (a, b):
        return 0.25
    if min(len(x), len(y)) == 1 and set(x) & set(y):
        return 1 / max(len(x), len(y))
    return 0.0


def equality_of(a: Column, b: Column) -> Column:
    table = {f"{x}{y}": e for x in IUPAC for y in IUPAC if (e := equality(x, y))}
    return F.coalesce(F.create_map(*(F.lit(v) for p in table.items() for v in p))[F.concat(a, b)], F.lit(0.0))


def ends(seq: Column) -> tuple[Column, Column]:
    """First and last place (from 1) that is no gap; null for gaps alone."""
    first = F.length(seq) - F.length(F.regexp_replace(seq, "^-+", "")) + 1
    last = F.length(F.regexp_replace(seq, "-+$", ""))
    return F.when(last > 0, first), F.when(last > 0, last)


def aligned_place(seq: Column, n: Column, from_left: bool = True) -> Column:
    """The column (from 1, from the left) of base number n of an aligned sequence, counted from either end; null where it
    has fewer."""
    length = F.length(seq)
    every = F.when(length > 0, F.sequence(F.lit(1), length)).otherwise(F.array().cast("array<int>"))
    places = F.filter(every, lambda i: F.substring(seq, i, F.lit(1)) != "-")
    return F.when(n > 0, F.try_element_at(places, (n if from_left else -n).cast("int")))
