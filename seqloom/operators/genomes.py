"""Annotated genomes: rejection, choice, quality, genes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.functions import bases, names


def reject_reason(organism: Column, keywords: Column) -> Column:
    """The first that holds: unverified, no certain species, hybrid; else null."""
    return F.when(F.contains(keywords, F.lit("UNVERIFIED")), "unverified").when(F.contains(organism, F.lit(" sp.")), "sp.").when(F.contains(organism, F.lit(" x ")), "hybrid")


def newest_distinct(genomes: DataFrame, keep: int = 3) -> DataFrame:
    """At most `keep` genomes of each organism: published first, then more genes, longer, newer; one a date."""
    order = [names.published(F.col("journals")).desc(), F.desc_nulls_last("cds_count"), F.desc("length"), F.desc_nulls_last("date"), F.asc("genome")]
    one = genomes.withColumn("_d", F.row_number().over(W.partitionBy("organism", "date").orderBy(*order))).where("_d = 1")
    return one.withColumn("choice", F.row_number().over(W.partitionBy("organism").orderBy(*order))).where(F.col("choice") <= keep).drop("_d")


def feature_counts(features: DataFrame, least_cds: int = 80) -> DataFrame:
    kinds = {"genes": "gene", "cds": "CDS", "trna": "tRNA", "rrna": "rRNA"}
    out = features.groupBy("genome").agg(*(F.count_if(F.col("type") == t).alias(f"n_{n}") for n, t in kinds.items()), F.countDistinct(F.when(F.col("type") == "CDS", F.col("gene"))).alias("n_distinct_cds"))
    return out.withColumn("flagged", F.col("n_cds") < least_cds)


def quality(counts: DataFrame, sequences: DataFrame, most_unclear: float = 0.2) -> DataFrame:
    """feature_counts() with sequence_length, unclear_bases and unclear_ratio of each genome's sequence; flagged too where the
    ratio is over most_unclear. A genome without features has none of each and is flagged."""
    n = F.length("seq")
    unclear = n - F.length(F.regexp_replace(F.upper("seq"), "[^ACGT]", ""))
    made = sequences.select("genome", n.alias("sequence_length"), unclear.alias("unclear_bases"), F.when(n > 0, unclear / n).otherwise(0.0).alias("unclear_ratio"))
    out = made.join(counts, "genome", "left").withColumn("flagged", F.coalesce("flagged", F.lit(True)) | (F.col("unclear_ratio") > most_unclear))
    return out.na.fill(0, [c for c in counts.columns if c.startswith("n_")])


def standard_gene(features: DataFrame, aliases: DataFrame) -> DataFrame:
    """gene: the standard name of each feature's alias; features of unknown genes go."""
    return features.join(aliases, "gene_alias")


def named_gene(features: DataFrame, aliases: DataFrame) -> DataFrame:
    """gene: the standard name of gene_alias, or the alias itself where it is none; without an alias that of the product, or
    else unknown."""
    by = aliases.select("gene_alias", "gene")
    out = features.join(by.toDF("gene_alias", "_g"), "gene_alias", "left").join(by.toDF("product", "_p"), "product", "left")
    gene = F.when(F.col("gene_alias").isNotNull(), F.coalesce("_g", "gene_alias")).otherwise(F.coalesce("_p", F.lit("unknown")))
    return out.withColumn("gene", gene).drop("_g", "_p")


#: Features that are a gene's product; its own and introns' spans are others.
CODING = ("CDS", "rRNA")


def known_genes(features: DataFrame, aliases: DataFrame, types: tuple = CODING) -> DataFrame:
    """named_gene() of features of the given types, without genes that no alias stands for."""
    return named_gene(features.where(F.col("type").isin(*types)), aliases).join(aliases.select("gene").distinct(), "gene", "left_semi")


def gene_sequences(genes: DataFrame, sequences: DataFrame) -> DataFrame:
    """(gene, genome, header, seq) of genes (genome, gene, location): what their location text names, which the header has
    too. A genome's sequence meets the list of its genes once, so long sequences aren't copied for each; genes of a place are one,
    and empty ones none."""
    lists = genes.groupBy("genome").agg(F.collect_set(F.struct("gene", "location")).alias("_f"))  # a genome's features
    joined = sequences.select("genome", F.upper("seq").alias("_s")).join(lists, "genome")
    cut = F.transform("_f", lambda f: F.struct(f["gene"].alias("gene"), F.concat(F.col("genome"), F.lit("|"), f["location"]).alias("header"), bases.splice(F.col("_s"), bases.location_parts(f["location"])).alias("seq")))
    return joined.select("genome", F.explode(cut).alias("x")).select("x.gene", "genome", "x.header", "x.seq").where("seq != ''")


def renewed(features: DataFrame, newer: DataFrame) -> DataFrame:
    """Features of genomes that were annotated again from there, all others as they were."""
    return features.join(newer.select("genome").distinct(), "genome", "left_anti").unionByName(newer.select(*features.columns))


def gene_table(features: DataFrame, types: tuple = CODING) -> DataFrame:
    """(genome, gene, n, locations, length) of features of the given types: locations joined by bars in order of place; length
    is the longest copy's."""
    features = features.where(F.col("type").isin(*types))
    place = F.struct("start_pos", F.concat(F.col("start_pos").cast("string"), F.lit(".."), F.col("end_pos").cast("string")).alias("p"))
    return features.groupBy("genome", "gene").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["p"]), "|").alias("locations"), F.max(F.col("end_pos") - F.col("start_pos")).alias("length"))


def within_reference(genes: DataFrame, reference: DataFrame, low: float, high: float) -> DataFrame:
    """Genes whose length is within bounds of the reference's, or that have none."""
    if not 0 < low < high <= 3:
        raise ValueError("bounds must be in (0, 3], the low one less")
    return genes.join(reference, "gene", "left").where(F.col("ref_len").isNull() | F.col("length").between(low * F.col("ref_len"), high * F.col("ref_len"))).drop("ref_len")


def per_species(genes: DataFrame, genomes: DataFrame) -> DataFrame:
    """The genome with the greatest total gene length of each organism."""
    total = genes.groupBy("genome").agg(F.sum("length").alias("total_length"), F.countDistinct("gene").alias("n_genes"))
    w = W.partitionBy("organism").orderBy(F.desc("total_length"), "genome")
    return total.join(genomes.select("genome", "organism"), "genome").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def missing_genes(genes: DataFrame, wanted: list[str]) -> DataFrame:
    """Of each genome the wanted genes it lacks, sorted and comma-joined."""
    have = genes.groupBy("genome").agg(F.collect_set("gene").alias("h"))
    return have.select("genome", F.array_join(F.array_sort(F.array_except(F.array(*map(F.lit, wanted)), "h")), ",").alias("missing"))


def spliced(features: DataFrame, sequences: DataFrame) -> DataFrame:
    """features (genome, location) with seq, the bases their location text names."""
    joined = features.join(sequences.select("genome", F.upper("seq").alias("_s")), "genome")
    return joined.withColumn("seq", bases.splice(F.col("_s"), bases.location_parts(F.col("location")))).drop("_s")


def with_counts(info: DataFrame, counts: DataFrame) -> DataFrame:
    """Every row of counts, with what is known of its genome."""
    return info.join(counts, "genome", "right")


def gene_set(genomes: DataFrame, features: DataFrame, sequences: DataFrame, aliases: DataFrame, reference: DataFrame, wanted: list[str], *, keep: int = 3, least_cds: int = 80, most_unclear: float = 0.2, low: float = 0.8, high: float = 1.2) -> DataFrame:
    """From genomes to one gene set a species: (organism, genome, total_length, n_genes, missing).

    Rejected genomes go, at most `keep` of an organism stay, those whose quality is flagged go; genes get their standard
    names, the longest copy of each counts if it is within the reference's bounds, and each organism gets the genome with
    the greatest total length and the list of the wanted genes it lacks.
    """
    chosen = newest_distinct(genomes.where(reject_reason(F.col("organism"), F.col("keywords")).isNull()), keep)
    own = standard_gene(features, aliases).join(chosen.select("genome"), "genome", "left_semi")
    good = quality(feature_counts(own, least_cds), sequences.join(chosen.select("genome"), "genome", "left_semi"), most_unclear).where("not flagged")
    genes = within_reference(gene_table(own.join(good.select("genome"), "genome", "left_semi")), reference, low, high)
    one = per_species(genes, chosen).select("organism", "genome", "total_length", "n_genes")
    return one.join(missing_genes(genes, wanted), "genome")


def gene_sequence_set(genomes: DataFrame, features: DataFrame, sequences: DataFrame, aliases: DataFrame, reference: DataFrame, wanted: list[str], *, newer: DataFrame | None = None, accepted: DataFrame | None = None, keep: int = 3, least_cds: int = 80, most_unclear: float = 0.2, low: float = 0.8, high: float = 1.2) -> tuple[DataFrame, DataFrame]:
    """From genomes to one set of gene sequences a species: (organism, genome, total_length, n_genes, missing), and
    (organism, gene, header, seq).

    Features (genome, type, gene_alias, product, location) of genomes annotated again come from `newer`. Rejected genomes
    go, at most `keep` of an organism stay, those whose quality is flagged go. Coding features of known genes
    are spliced; copies whose length is not within bounds of the reference's go, and of each gene the longest counts. An organism has its
    accepted name (name_submitted, accepted_name), and those without one go; each gets the genome with the greatest total length.
    """
    from .curate import first_of
    from .graph import cut
    from .resolve import substituted

    chosen = cut(newest_distinct(genomes.where(reject_reason(F.col("organism"), F.col("keywords")).isNull()), keep))
    among = lambda rows: rows.join(chosen.select("genome"), "genome", "left_semi")
    own, sequences = among(features) if newer is None else renewed(among(features), among(newer)), among(sequences)  # before anything is shuffled
    counts = feature_counts(known_genes(own, aliases, ("gene", "CDS", "tRNA", "rRNA")), least_cds)
    good = quality(counts, sequences, most_unclear).where("not flagged")
    seqs = gene_sequences(known_genes(own.join(good.select("genome"), "genome", "left_semi"), aliases), sequences)
    copies = within_reference(seqs.withColumn("length", F.length("seq")), reference, low, high)
    genes = first_of(copies, ["genome", "gene"], [F.desc("length"), F.asc("header")])
    named = chosen.select("genome", "organism") if accepted is None else substituted(chosen.select("genome", "organism"), accepted, "inner").where("organism is not null")
    one = per_species(genes, named).select("organism", "genome", "total_length", "n_genes")
    return one.join(missing_genes(genes, wanted), "genome"), one.select("organism", "genome").join(genes, "genome").select("organism", "gene", "header", "seq")


def merged_annotations(old: DataFrame, new: DataFrame) -> DataFrame:
    """The new features of a genome where there are any, and with them its new topology and date; its other fields stay."""
    taken = [c for c in ("features", "topology", "date") if c in old.columns and c in new.columns]
    out = old.join(new.select("genome", *(F.col(c).alias(f"_{c}") for c in taken)), "genome", "left")
    return out.withColumns({c: F.coalesce(f"_{c}", c) for c in taken}).drop(*(f"_{c}" for c in taken))
