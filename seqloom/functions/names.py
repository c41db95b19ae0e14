"""Headers, species names, lineages and dates as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What marks a rank below species, and names that are not those of one species.
RANKS = {"subsp": (" subsp. ", " subsp ", " ssp. ", " ssp "), "var": (" var. ", " var "), "f": (" f. ", " f ")}
EXCEPTIONAL = {"sp": ("sp.", "sp"), "cf": ("cf.", "cf"), "aff": ("aff.", "aff"), "x": ("x.", "x")}
CORE_ENDS = ("var.", "subsp.", "ssp.", "f.", "fma.", "x")
UNPUBLISHED = ("unknown", "unpublished", "published only in database")
DATE_FORMS = ("dd-MMM-yyyy", "dd/MM/yyyy", "yyyy/MM/dd")


def accession(header: Column) -> Column:
    return F.split_part(F.split_part(F.split_part(header, F.lit(" "), F.lit(1)), F.lit("|"), F.lit(1)), F.lit(":"), F.lit(1))


def species_of_header(header: Column) -> Column:
    parts = F.split(header, r"\|")
    return F.when(F.size(parts) >= 2, parts[1]).otherwise(header)


def header_range(header: Column) -> tuple[Column, Column, Column]:
    """Start, end and whether it is reversed; nulls where the header has no range."""
    start = F.regexp_extract(header, r":([0-9]+)-([0-9]+)", 1).try_cast("int")
    end = F.regexp_extract(header, r":([0-9]+)-([0-9]+)", 2).try_cast("int")
    return start, end, F.contains(header, F.lit("_reverse_complement"))


def with_range(header: Column, start: Column, end: Column) -> Column:
    """The header with its first range replaced."""
    at = F.regexp_extract(header, r"^(.*?):[0-9]+-[0-9]+", 1)
    rest = F.regexp_extract(header, r"^.*?:[0-9]+-[0-9]+(.*)$", 1)
    return F.when(F.regexp_like(header, F.lit(":[0-9]+-[0-9]+")), F.concat(at, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"), rest)).otherwise(header)


def compose(acc: Column, start: Column, seq: Column, reverse: Column, organism: Column, description: Column) -> Column:
    first = F.greatest(start, F.lit(1))
    place = F.concat(acc, F.lit(":"), first.cast("string"), F.lit("-"), (first + F.length(seq) - 1).cast("string"), F.when(reverse, "_reverse_complement").otherwise(""))
    return F.concat_ws("|", place, F.replace(organism, F.lit(" "), F.lit("_")), description)


def species_core(name: Column) -> Column:
    """Lower case, × as x, cut before the first word that opens a rank below species or a hybrid."""
    words = F.filter(F.split(F.translate(F.lower(F.trim(name)), "×", "x"), r"\s+"), lambda w: w != "")
    stop = F.array_position(F.transform(words, lambda w: w.isin(*CORE_ENDS)), True)
    return F.array_join(F.when(stop > 0, F.slice(words, F.lit(1), F.greatest(stop.cast("int") - 1, F.lit(0)))).otherwise(words), " ")


def merged(name: Column, groups: tuple = ("subsp", "var", "f")) -> Column:
    """The species of an infraspecific name: cut at the first mark of the chosen groups that occurs, in their order."""
    marks = [m for g in groups for m in RANKS[g]]
    cut = reduce(lambda out, m: out.when(F.contains(name, F.lit(m)), F.substring_index(name, m, 1)), marks[1:], F.when(F.contains(name, F.lit(marks[0])), F.substring_index(name, marks[0], 1)))
    return cut.otherwise(name)


def exceptional(name: Column, groups: tuple = ("sp", "cf", "aff", "x")) -> Column:
    """Whether any word but the first marks the name as not one species'."""
    words = F.split(F.replace(name, F.lit("_"), F.lit(" ")), " ")
    return F.arrays_overlap(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), F.array(*(F.lit(w) for g in groups for w in EXCEPTIONAL[g])))


def without_apostrophes(name: Column) -> Column:
    return F.replace(name, F.lit("'"), F.lit(""))


def genus_of(lineage: Column) -> Column:
    """The last element without a space."""
    return F.element_at(F.filter(lineage, lambda x: ~F.contains(x, F.lit(" "))), -1)


def parent_unit(lineage: Column, genus: Column) -> Column:
    at = F.array_position(lineage, genus).cast("int")
    return F.when(at > 1, F.element_at(lineage, F.greatest(at - 1, F.lit(1))))


def first_two_words(name: Column) -> Column:
    return F.substring_index(name, " ", 2)


def published(journal: Column, unpublished: tuple = UNPUBLISHED, missing: bool = False) -> Column:
    """Whether no word of `unpublished` is a part of it, whatever its case; null and blank ones count as `missing` says."""
    low = F.lower(F.trim(journal))
    part = reduce(Column.__or__, (F.contains(low, F.lit(w)) for w in unpublished), F.lit(False))
    return F.when(journal.isNull() | (low == ""), F.lit(missing)).otherwise(~part)


def parsed_date(text: Column) -> Column:
    """The day in any of the known forms, null otherwise."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)).cast("date") for f in DATE_FORMS))


def subject_of_hit(hit_id: Column) -> Column:
    """The last part between bars; a tail of one or two characters names a chain of the part before."""
    parts = F.filter(F.split(hit_id, r"\|"), lambda p: p != "")
    last = F.element_at(parts, -1)
    return F.when((F.length(last) <= 2) & (F.size(parts) > 1), F.concat_ws("_", F.try_element_at(parts, F.lit(-2)), last)).otherwise(last)


def picked(qualifiers: Column, name: str, default: str = "unknown") -> Column:
    """The first value of a qualifier, or the default; qualifiers are a map of lists."""
    return F.coalesce(F.get(F.try_element_at(qualifiers, F.lit(name)), F.lit(0)), F.lit(default))


def content_key(*columns: Column) -> Column:
    """A hash of inputs, the same for the same ones; nulls are told from blanks."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns)), 256)


def published_between(date: Column, first: str | None, last: str | None) -> Column:
    """Within the days, from 1900 on where none is given; any day without a last one."""
    if not last:
        return F.lit(True)
    return date.between(F.lit(first or "1900-01-01").cast("date"), F.lit(last).cast("date"))


def marker_record(organism: Column, qualifier: Column, date: Column, taxa: list[str], first: str | None = None, last: str | None = None) -> Column:
    """Of one of the taxa (any where none is listed; an organism's first words, or an element of its lineage), with the
    marker's qualifier, in the span of publication."""
    some = reduce(Column.__or__, ((organism == t) | F.startswith(organism, F.lit(f"{t} ")) for t in taxa), F.lit(not taxa))
    return some & qualifier & published_between(date, first, last)


def genome_record(organism: Column, title: Column, length: Column, date: Column, taxa: list[str], least: int = 100_000, most: int = 300_000, first: str | None = None, last: str | None = None) -> Column:
    """A chloroplast genome of one of the taxa: its title names the plastid and no other source, its length is within bounds."""
    low = F.lower(title)
    plastid = F.contains(low, F.lit("plastid")) | F.contains(low, F.lit("chloroplast"))
    other = reduce(Column.__or__, (F.contains(low, F.lit(w)) for w in ("mitochondrion", "mitochondrial", "chromosome")))
    return marker_record(organism, plastid & ~other & length.between(least, most), date, taxa, first, last)
