"""How far the sources of a language diverge in their words, and which words tell a source from its language.

Tasks count in Arrow's own compute functions: texts are lowered and split, terms become dictionary codes, and hash
aggregations count them by document and then by group. Spark merges the partial counts, and what a language keeps of its
terms goes, as columns, to shards by a term's hash. A shard's counts make a matrix of terms and sources, in which
divergences are sums over columns; a shard sends on sums and its best terms alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import quoted, read, slices, staged

#: A language keeps the terms of so many of its documents.
LEAST_DOCS = 10
#: Ranks of a group's terms.
TOP = 10
SCALE = 1_000_000_000
#: What separates terms.
SPLIT = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Text bytes that are split at once, and rows of counts that a task holds before it sends them.
AT_ONCE, HELD = 1 << 20, 1 << 20
#: Counts in a shard, about, and sources that one takes as rows of its matrix.
SHARD, SOURCES = 500_000, 256
#: Cells of a shard's matrix that are worked on at once.
CELLS = 1 << 20

KEYS = ["lang", "source", "term"]


def _counted(batch: pa.RecordBatch) -> pa.Table:
    """(lang, source, term, n, df) of a batch of (lang, source, text)."""
    words = pc.split_pattern_regex(pc.ascii_lower(batch["text"]), SPLIT)
    cells = pa.table({"row": pc.list_parent_indices(words), "term": pc.list_flatten(words)})
    cells = cells.filter(pc.not_equal(cells["term"], ""))
    coded = cells["term"].combine_chunks().dictionary_encode()
    docs = pa.table({"row": cells["row"], "code": coded.indices}).group_by(["row", "code"], use_threads=False).aggregate([([], "count_all")])
    at = pa.table({"row": np.arange(len(batch)), "lang": batch["lang"], "source": batch["source"]}).group_by(["lang", "source"], use_threads=False).aggregate([("row", "list")])
    of = np.empty(len(batch), np.int32)
    rows = at["row_list"].combine_chunks()
    of[rows.flatten().to_numpy()] = rows.value_parent_indices().to_numpy()
    sums = pa.table({"g": of[docs["row"].to_numpy()], "code": docs["code"], "n": docs["count_all"]}).group_by(["g", "code"], use_threads=False).aggregate([("n", "sum"), ("n", "count")])
    return pa.table({"lang": at["lang"].take(sums["g"]), "source": at["source"].take(sums["g"]), "term": coded.dictionary.take(sums["code"]), "n": sums["n_sum"], "df": sums["n_count"]})


def _merged(tables: list[pa.Table]) -> pa.Table:
    sums = pa.concat_tables(tables).group_by(KEYS, use_threads=False).aggregate([("n", "sum"), ("df", "sum")])
    return sums.select([*KEYS, "n_sum", "df_sum"]).rename_columns([*KEYS, "n", "df"])


def term_counts(texts: DataFrame) -> DataFrame:
    """(lang, source, term, n, df) of texts (lang, source, text) without nulls: how often a group has a term, and in how
    many of its rows."""

    def count(batches):
        held, size = [], 0
        for b in slices(batches, AT_ONCE):
            held.append(_counted(b))
            size += len(held[-1])
            if size > HELD:
                held = [_merged(held)]
                if len(held[0]) > HELD // 2:  # what one document has goes; frequent terms are summed further
                    rare = pc.equal(held[0]["df"], 1)
                    yield from held[0].filter(rare).to_batches(1 << 14)
                    held = [held[0].filter(pc.invert(rare))]
                    if len(held[0]) > HELD // 2:
                        yield from held[0].to_batches(1 << 14)
                        held = []
                    pa.default_memory_pool().release_unused()
                size = sum(map(len, held))
        if held:
            yield from _merged(held).to_batches(1 << 14)

    return texts.mapInArrow(count, "lang string, source string, term string, n long, df long").groupBy(*KEYS).agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def share(count: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kept)), in long division, so that no product leaves 64 bits."""
    of = np.asarray(total, np.int64) + 2 * kept
    if (of >= 1 << 53).any():
        raise ValueError("too many terms to divide exactly")
    out, rest = np.divmod(np.asarray(count, np.int64) + 2, of)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, of)
        out = out * 1000 + digit
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def _shard(terms: pa.Table, groups: pa.Table) -> pa.Table:
    """Partial results (lang, source, part, item, value) of a shard's terms, for the sources of one block, against all
    sources of the language."""
    groups = groups.sort_by("source")
    names, n, kept, total = groups["source"].combine_chunks(), groups["n"].to_numpy(), groups["terms"][0].as_py(), groups["total"][0].as_py()
    own = np.flatnonzero(groups["own"].to_numpy(zero_copy_only=False))
    sums = np.zeros((len(own), len(names)), np.int64)
    none = pa.table({c: pa.array([], t) for c, t in (("source", pa.string()), ("item", pa.string()), ("value", pa.int64()))})
    best = none
    if len(terms):
        terms = terms.sort_by("term")  # by bytes
        cells = terms["cells"].combine_chunks()
        row, cell = cells.value_parent_indices().to_numpy(), cells.flatten()
        col = pc.index_in(cell.field("source"), names).to_numpy()
        p = share(cell.field("n").to_numpy(), n[col], kept)
        base = share(np.zeros(len(n)), n, kept)
        step, begins = max(1, CELLS // len(n)), np.searchsorted(row, np.arange(len(terms) + 1))
        for a in range(0, len(terms), step):
            z = min(a + step, len(terms))
            i = slice(begins[a], begins[z])
            matrix = np.tile(base[:, None], z - a)  # a source a row
            matrix[col[i], row[i] - a] = p[i]
            for k, s in enumerate(own):
                sums[k] += distance(matrix[s], matrix).sum(1)
        q = share(terms["n"].to_numpy(), total, kept)[row]
        some = np.flatnonzero((p > q) & np.isin(col, own))
        f = distance(p[some], q[some])
        order = np.lexsort((row[some], -f, col[some]))
        some, f = some[order], f[order]
        first = np.searchsorted(col[some], col[some])
        top = np.arange(len(some)) - first < TOP
        best = pa.table({"source": names.take(col[some[top]]), "item": terms["term"].take(row[some[top]]), "value": f[top]})
    a, b = (x.ravel() for x in np.meshgrid(own, np.arange(len(names)), indexing="ij"))
    pairs = pa.table({"source": names.take(a), "item": names.take(b), "value": sums.ravel()}).filter(pa.array(a != b))
    told = pa.concat_tables([pairs.append_column("part", pa.array(["pair"] * len(pairs), pa.string())), best.cast(none.schema).append_column("part", pa.array(["term"] * len(best), pa.string()))])
    return told.append_column("lang", pa.array([groups["lang"][0].as_py()] * len(told), pa.string())).select(["lang", "source", "part", "item", "value"])


def divergences(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST_DOCS, shard: int = SHARD, sources: int = SOURCES) -> DataFrame:
    """(lang, source, part, item, value, rank): for every group of documents, a language's source, its divergence from each
    other source of the language (part pair, item the other), and its TOP terms that diverge most from the language
    (part term). Ranks go by value, the largest first, then by item.

    Terms are runs of letters and of all beyond ASCII, with A-Z lowered; a language keeps those of `least` of its
    documents or more. All arithmetic is exact. Nulls count as empty texts and names. A group without terms has pairs, a
    language without terms pairs of value 0, a lone source no pairs. Repeated rows are documents of their own; very long texts
    count whole; an empty table gives no rows. Other columns don't matter, whatever their names.
    Tasks hold about `shard` counts of terms by sources, and a term's counts in all sources of its language.
    """
    text, lang, source = (F.coalesce(quoted(c).cast("string"), F.lit("")) for c in (text_col, lang_col, source_col))
    named = [lang.alias("lang"), source.alias("source")]
    cells = F.collect_list(F.struct("source", "n")).alias("cells")
    kept = term_counts(docs.select(*named, text.alias("text"))).groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"), cells)
    kept = staged(kept.where(F.col("df") >= least).drop("df"))
    known = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("total"), F.sum(F.size("cells")).alias("cells"))
    counts = kept.select("lang", F.explode("cells").alias("c")).groupBy("lang", "c.source").agg(F.sum("c.n").alias("n"))
    groups = docs.select(*named).distinct().join(counts, ["lang", "source"], "left")
    langs = groups.groupBy("lang").agg(F.count("*").alias("of")).join(known, "lang", "left").na.fill(0)
    up = lambda c, n: F.greatest(F.ceil(F.col(c) / F.lit(n)), F.lit(1)).cast("long")
    langs = staged(langs.select("lang", "terms", "total", up("cells", shard).alias("shards"), up("of", sources).alias("blocks")))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    block = F.pmod(F.xxhash64("source"), F.col("blocks"))
    groups = groups.na.fill(0).join(langs, "lang")
    groups = groups.select("*", every("shards").alias("shard")).select("*", every("blocks").alias("block")).select("lang", "shard", "block", "source", "n", "terms", "total", (block == F.col("block")).alias("own"))
    terms = kept.join(langs.select("lang", "shards", "blocks"), "lang").withColumn("shard", F.pmod(F.xxhash64("term"), F.col("shards")))
    terms = terms.select("*", every("blocks").alias("block")).select("lang", "shard", "block", "term", "n", "cells")
    key = ["lang", "shard", "block"]
    found = terms.groupBy(*key).cogroup(groups.groupBy(*key)).applyInArrow(_shard, "lang string, source string, part string, item string, value long")
    found = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return found.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= TOP))


def op13_source_divergence(spark, sf_dir: str) -> DataFrame:
    return divergences(read(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS no, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT lang, source, no, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT no) AS df FROM w GROUP BY ALL),
k AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY ALL HAVING sum(df) >= 10),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
m AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source)::HUGEINT AS total FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT m.lang, m.source, m.term, m.n, 1 + 1000000000 * (m.n + 2) // (m.total + 2 * v) AS p FROM m JOIN v USING (lang)),
q AS (SELECT k.lang, k.term, 1 + 1000000000 * (k.n + 2) // (v.total + 2 * v) AS q FROM k JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT p.lang, p.source, 'term', p.term, (p - q) * (p - q) // (p + q) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
x AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r)
SELECT lang, source, part, item, value::BIGINT AS value, rank FROM x WHERE part = 'pair' OR rank <= 10
"""
