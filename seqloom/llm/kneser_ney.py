"""Quality by an interpolated modified Kneser-Ney model of byte n-grams, trained on trusted text.

Counting is Spark's: n-grams are codes in longs, an order's counts are combined per task and then shuffled by code,
lower orders get continuation counts, and each order's probabilities come from joins of counts with their contexts'
totals and with the order below. The finished table is bounded by the bound on the training text, so tasks hold it
whole and score documents without a shuffle.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, kept, octets, quoted, read, slices, staged, unpacked

ORDER = 5
#: The training sample's bound: so many trusted documents, in the order of a hash of their ids, and so many bytes of whole texts.
MAX_DOCS, MAX_BYTES = 4_000, 4_000_000
#: A document is rejected where its perplexity is over SLACK times this quantile of its language's trusted documents.
QUANTILE, SLACK = 0.98, 1.25
#: Languages with fewer trusted documents than this share one threshold.
LEAST_TRUSTED = 50
#: Thresholds come from perplexities rounded to so many decimals: a language's different values then fit one task.
DECIMALS = 3
#: Words are told toxic by so many labelled documents a class and so many bytes of them, in the order of a hash of their ids.
TOXIC_DOCS, TOXIC_BYTES = 4_000, 16_000_000
#: A document is toxic where its worst word is over this quantile of all documents that are labelled, and not as toxic.
CLEAN = 0.995
#: Text bytes that a task works on at once.
AT_ONCE = 1 << 19
#: Stands before each text, so that its first bytes have contexts.
PAD = b"\n" * (ORDER - 1)


def _codes(data: np.ndarray, order: int) -> np.ndarray:
    """code[i] = the n-gram that ends at byte i + order - 1; the last byte is the lowest."""
    out = data[: len(data) - order + 1].astype(np.int64)
    for k in range(1, order):
        out = (out << 8) | data[k : len(data) - order + 1 + k]
    return out


def sample(docs: DataFrame, good: DataFrame, max_docs: int, max_bytes: int, *, id_col: str, text_col: str) -> DataFrame:
    """Ids and whole texts (t) of trusted documents, the first by a hash of the id, each that still fits into the
    bounds. Where none with a byte fits, that is an error. Only ids meet the labels; the chosen ones, max_docs at most, are then sent to the texts."""
    ids = docs.select(F.col(id_col).alias("id")).join(good, F.col("id") == good["_good"], "left_semi").distinct()
    chosen = ids.select(F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(max_docs).select("id")
    texts = docs.select(F.col(id_col).alias("id"), octets(text_col).alias("t")).join(F.broadcast(chosen), "id")
    some = texts.select(F.xxhash64("id").alias("h"), "id", "t").orderBy("h", "id", "t").limit(max_docs)
    some = staged(some.withColumn("no", F.row_number().over(W.orderBy("h", "id", "t"))))  # of max_docs rows at most
    left, fits, full = max_bytes, [], 0
    for r in some.select("no", F.length("t").alias("n")).orderBy("no").collect():
        full = max(full, r["n"])
        if r["n"] <= left:
            left -= r["n"]
            fits.append(r["no"])
    if full and left == max_bytes:
        raise ValueError(f"no labelled text fits into {max_bytes} bytes")
    return some.where(F.col("no").isin(fits)).select("id", "t")


def top_counts(texts: DataFrame, order: int) -> DataFrame:
    """(g, c) of the highest order."""

    def count(batches):
        for b in batches:
            parts = [_codes(np.frombuffer(PAD + t + b"\n", np.uint8), order) for t in b[0].to_pylist() if t]
            g, c = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.empty(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(c, pa.int64())], ["g", "c"])

    return texts.mapInArrow(count, "g long, c long").groupBy("g").agg(F.sum("c").alias("c"))


def _discounts(counts: DataFrame) -> list[float]:
    """D1, D2, D3+ from the counts of counts; where these are too few to tell, 0.5, 1 and 1.5."""
    n = {r.c: r.n for r in counts.where("c <= 4").groupBy("c").agg(F.count("*").alias("n")).collect()}
    n1, n2, n3, n4 = (n.get(k, 0) for k in (1, 2, 3, 4))
    if not (n1 and n2 and n3 and n4):
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1)]


def train(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(n, g, p, bow): for each order n the seen n-grams' probabilities, and the weight that g, as a context, leaves to
    the order below. n = 0 is the uniform distribution over 256 bytes."""
    counts = {order: staged(top_counts(texts, order))}
    for n in range(order - 1, 0, -1):  # how many bytes come before each shorter n-gram
        counts[n] = staged(counts[n + 1].groupBy(F.col("g").bitwiseAND(F.lit((1 << 8 * n) - 1)).alias("g")).agg(F.count("*").alias("c")))
    lower, out = None, []
    for n in range(1, order + 1):
        d1, d2, d3 = _discounts(counts[n])
        own = counts[n].withColumn("ctx", F.shiftright("g", 8)).withColumn("d", F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3))
        ctx = own.groupBy("ctx").agg(F.sum("c").alias("total"), F.sum("d").alias("left"))
        ctx = ctx.select("ctx", "total", (F.col("left") / F.col("total")).alias("bow"))
        got = own.join(ctx, "ctx").select("g", "ctx", ((F.col("c") - F.col("d")) / F.col("total")).alias("seen"), "bow")
        if n == 1:
            p = got.select("g", (F.col("seen") + F.col("bow") / 256).alias("p"))
        else:
            below = lower.select(F.col("g").alias("short"), F.col("p").alias("q"))
            p = got.withColumn("short", F.col("g").bitwiseAND(F.lit((1 << 8 * (n - 1)) - 1))).join(below, "short").select("g", (F.col("seen") + F.col("bow") * F.col("q")).alias("p"))
        lower = staged(p)
        out += [lower.select(F.lit(n).alias("n"), "g", "p", F.lit(None).cast("double").alias("bow")), ctx.select(F.lit(n - 1).alias("n"), F.col("ctx").alias("g"), F.lit(None).cast("double").alias("p"), "bow")]
    return reduce(DataFrame.unionByName, out).groupBy("n", "g").agg(F.max("p").alias("p"), F.max("bow").alias("bow"))


class Table:
    """The model in open-addressed arrays: log10 p and log10 bow by (order, code)."""

    def __init__(self, n: np.ndarray, g: np.ndarray, p: np.ndarray, bow: np.ndarray, order: int = ORDER):
        self.order, self.bits = order, max(4, (len(n) * 3 // 2).bit_length())  # two thirds full at most
        self.keys, self.logs = np.full(1 << self.bits, -1, np.int64), np.zeros((1 << self.bits, 2), np.float32)
        with np.errstate(divide="ignore", invalid="ignore"):
            values = np.stack([np.nan_to_num(np.log10(x), nan=np.nan, neginf=np.nan) for x in (p, bow)], 1)
        values[:, 1] = np.nan_to_num(values[:, 1], nan=0.0)  # an unseen context leaves all to the order below
        keys = (n.astype(np.int64) << 48) | g
        at = self._slot(keys)
        todo = np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[at[todo]] == -1]
            _, first = np.unique(at[free], return_index=True)
            placed = free[first]
            self.keys[at[placed]], self.logs[at[placed]] = keys[placed], values[placed]
            todo = np.setdiff1d(todo, placed, assume_unique=True)
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, n: int, codes: np.ndarray) -> np.ndarray:
        """log10 (p, bow) of each code; (nan, 0) where it is unseen."""
        keys = codes | (n << 48)
        at = self._slot(keys)
        got = self.keys[at]
        out = self.logs[at]
        odd = np.flatnonzero(got != keys)
        while len(odd):
            empty = got[odd] == -1
            out[odd[empty]] = (np.nan, 0.0)
            odd = odd[~empty]
            at[odd] = (at[odd] + 1) & ((1 << self.bits) - 1)
            got[odd] = self.keys[at[odd]]
            out[odd] = self.logs[at[odd]]
            odd = odd[got[odd] != keys[odd]]
        return out

    def score(self, codes: np.ndarray) -> np.ndarray:
        """log10 p of each code's last byte after the ones before it."""
        out = self.find(self.order, codes)[:, 0].astype(np.float64)
        todo, spent = np.flatnonzero(np.isnan(out)), None
        spent = np.zeros(len(todo))
        for n in range(self.order - 1, -1, -1):
            if not len(todo):
                break
            spent += self.find(n, (codes[todo] >> 8) & ((1 << 8 * n) - 1))[:, 1]
            p = self.find(n, codes[todo] & ((1 << 8 * n) - 1))[:, 0].astype(np.float64) if n else np.full(len(todo), -np.log10(256))
            seen = ~np.isnan(p)
            out[todo[seen]] = p[seen] + spent[seen]
            todo, spent = todo[~seen], spent[~seen]
        return out


class Words:
    """How many toxic and other documents of a labelled sample have each word. A document of the sample is judged without
    its own share of the counts, so labelled documents are judged like unseen ones."""

    def __init__(self, counts: dict[bytes, tuple[int, int]], sizes: tuple[int, int], own: dict):
        self.counts, self.sizes, self.own = counts, sizes, own

    def worst(self, text: bytes, id_) -> float:
        """The largest log-likelihood ratio (toxic to other) of a word of the text; 0 where no word has a positive one."""
        if not self.counts:
            return 0.0
        label, most = self.own.get(id_), 0.0
        minus = (label == 1, label == 0)
        base = math.log(self.sizes[1] + 1 - minus[1]) - math.log(self.sizes[0] + 1 - minus[0])
        for w in self.counts.keys() & set(text.translate(ALNUM).split()):
            t, c = self.counts[w]
            most = max(most, math.log((t - minus[0] + 0.5) / (c - minus[1] + 0.5)) + base)
        return most


def toxic_words(docs: DataFrame, told: DataFrame, *, id_col: str, text_col: str, max_docs: int = TOXIC_DOCS, max_bytes: int = TOXIC_BYTES) -> Words:
    """Of told (_good, t: 1 for toxic), a bounded sample of each class; words that two toxic documents have and that are
    likelier in these. Without documents of both classes there are none."""

    def count(batches):
        for b in batches:
            seen: Counter = Counter()
            for t in b["t"].to_pylist():
                seen.update(set(t.translate(ALNUM).split()))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["w", "n"])

    parts, own, sizes = [], {}, []
    for label in (1, 0):
        part = staged(sample(docs, told.where(F.col("t") == label).select("_good"), max_docs, max_bytes, id_col=id_col, text_col=text_col))
        ids = [r["id"] for r in part.select("id").collect()]  # max_docs at most
        own |= dict.fromkeys(ids, label)
        sizes.append(len(ids))
        found = part.mapInArrow(count, "w binary, n long")
        parts.append(found.select("w", *((F.col("n") if k == label else F.lit(0).cast("long")).alias(f"n{k}") for k in (1, 0))))
    if not all(sizes):
        return Words({}, (0, 0), {})
    both = parts[0].unionByName(parts[1]).groupBy("w").agg(F.sum("n1").alias("t"), F.sum("n0").alias("c"))
    rows = both.where((F.col("t") >= 2) & ((F.col("t") + 0.5) * (sizes[1] + 1) > F.col("c") * (sizes[0] + 1))).collect()  # words of the sample's bytes
    return Words({bytes(r["w"]): (r["t"], r["c"]) for r in rows}, tuple(sizes), own)


def perplexities(rows: DataFrame, model: Table, words: Words) -> DataFrame:
    """rows without their last column, a text's bytes, and n_bytes, perplexity (by byte, its end included) of the whole
    text, null where it is empty, and toxicity, its worst word's. rows has the documents' id."""
    held = rows.sparkSession.sparkContext.broadcast((model, words))
    made, names = T._parse_datatype_string("n_bytes long, perplexity double, toxicity double"), rows.columns[:-1]

    def score(batches):
        table, words = held.value
        for b in slices(batches, AT_ONCE):
            texts = b.column(b.num_columns - 1).to_pylist()
            some = [i for i, t in enumerate(texts) if t]
            total, at, size, group = np.zeros(len(texts)), 0, 0, []
            for i in some:
                full = PAD + texts[i] + b"\n"
                for at in range(table.order - 1, len(full), AT_ONCE):  # a very long text in pieces with their contexts
                    group.append((i, _codes(np.frombuffer(full[at - table.order + 1 : at + AT_ONCE], np.uint8), table.order)))
                    size += len(group[-1][1])
                    if size > AT_ONCE or i == some[-1] and at + AT_ONCE >= len(full):
                        sums = np.add.reduceat(table.score(np.concatenate([c for _, c in group])), np.r_[0, np.cumsum([len(c) for _, c in group])[:-1]])
                        np.add.at(total, [g for g, _ in group], sums)
                        group, size = [], 0
            ppl = [10 ** (-total[i] / (len(t) + 1)) if t else None for i, t in enumerate(texts)]
            worst = [words.worst(t, i) for t, i in zip(texts, b["id"].to_pylist(), strict=True)]
            cells = [pa.array(list(map(len, texts)), pa.int64()), pa.array(ppl, pa.float64()), pa.array(worst, pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cells], [*names, *made.names])

    return rows.mapInArrow(score, T.StructType([*rows.schema.fields[:-1], *made]))


def joined_perplexities(rows: DataFrame, model: DataFrame, order: int = ORDER) -> DataFrame:
    """(uid, n_bytes, perplexity) of rows (uid, octets) by count joins alone: each document's different n-grams, with how
    often it has them, are joined to the model's table (n, g, p, bow), which Spark shards by n-gram; those that are not
    there go on to the order below with what their context leaves to it, and the logarithms are summed by document.

    uid is each row's own. Null and empty texts have a null perplexity; no rows give none; other columns of rows don't
    matter; very long texts count whole. No task holds the model. The rows of (document, n-gram) that are shuffled are several times the text, so quality()
    scores by the bounded table instead; both give the same perplexities.
    """

    def grams(batches):
        for b in slices(batches, AT_ONCE):
            for u, t in zip(b["uid"].to_pylist(), b["octets"].to_pylist(), strict=True):
                if t:
                    g, c = np.unique(_codes(np.frombuffer(PAD + t + b"\n", np.uint8), order), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), u)), pa.array(g), pa.array(c)], ["uid", "g", "c"])

    open_ = staged(rows.select("uid", "octets").mapInArrow(grams, "uid long, g long, c long").withColumn("spent", F.lit(0.0)))
    parts = []
    for n in range(order, 0, -1):
        seen = model.where(F.col("n") == n).select("g", F.log10("p").alias("p")).where("p is not null")
        left = model.where(F.col("n") == n - 1).select(F.col("g").alias("ctx"), F.log10("bow").alias("b")).where("b is not null")
        met = open_.join(seen, "g", "left")
        parts.append(met.where("p is not null").select("uid", (F.col("c") * (F.col("p") + F.col("spent"))).alias("x")))
        rest = met.where("p is null").drop("p").withColumn("ctx", F.shiftright("g", 8)).join(left, "ctx", "left")
        short = F.col("g").bitwiseAND(F.lit((1 << 8 * (n - 1)) - 1)).alias("g")
        open_ = staged(rest.select("uid", short, "c", (F.col("spent") + F.coalesce("b", F.lit(0.0))).alias("spent")))
    parts.append(open_.select("uid", (F.col("c") * (F.col("spent") - math.log10(256))).alias("x")))
    total = reduce(DataFrame.unionByName, parts).groupBy("uid").agg(F.sum("x").alias("x"))
    size = rows.select("uid", F.length("octets").cast("long").alias("n_bytes"))
    return size.join(total, "uid", "left").select("uid", "n_bytes", F.pow(F.lit(10.0), -F.col("x") / (F.col("n_bytes") + 1)).alias("perplexity"))


def quality(docs: DataFrame, labels: DataFrame, *, keep: tuple, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES, quantile: float = QUANTILE, slack: float = SLACK, least: int = LEAST_TRUSTED, clean: float = CLEAN) -> DataFrame:
    """One row for every row of docs: the columns of `keep`, n_bytes, perplexity, toxicity, threshold, toxic and accepted.

    Trusted are documents that any label calls quality 1 and none calls toxic. The model learns from a bounded sample of
    them (max_docs, max_bytes); the thresholds cover all of them, by language. Rejected are null and empty
    texts, those over their threshold, and toxic ones: a text whose worst word, by its likelihood among toxic documents
    against others, is over the `clean` quantile of all documents labelled, and not as toxic. Rows with a null or rare language have the threshold of all trusted
    documents. Without any trusted document nothing but null and empty texts is rejected. Repeated rows give a row each;
    repeated labels count once. Very long texts are scored whole, in pieces; an empty table gives an empty result.
    Columns that aren't kept don't matter; a kept one that has a result's name comes back as kept_<name>.
    """
    found = _judged(docs, labels, keep, id_col, text_col, lang_col, max_docs, max_bytes, quantile, slack, least, clean)
    return unpacked(found, ("n_bytes", "perplexity", "toxicity", "threshold", "toxic", "accepted"))


def _judged(docs: DataFrame, labels: DataFrame, keep: tuple, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES, quantile: float = QUANTILE, slack: float = SLACK, least: int = LEAST_TRUSTED, clean: float = CLEAN) -> DataFrame:
    told = labels.groupBy("doc_id").agg(F.max("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).withColumnRenamed("doc_id", "_good")
    good = told.where("q = 1 and t = 0").select("_good")
    texts = sample(docs, good, max_docs, max_bytes, id_col=id_col, text_col=text_col)
    rows = train(texts.select("t")).toPandas()  # at most 5 n-grams a byte of the sample
    model = Table(rows["n"].to_numpy(np.int64), rows["g"].to_numpy(np.int64), rows["p"].to_numpy(float), rows["bow"].to_numpy(float))
    rows = docs.select(kept(keep), quoted(id_col).alias("id"), quoted(lang_col).alias("lang"), octets(quoted(text_col)).alias("octets"))
    scored = staged(perplexities(rows, model, toxic_words(docs, told, id_col=id_col, text_col=text_col)), "zstd")
    known = scored.where("perplexity is not null").select("id", "lang", F.round("perplexity", DECIMALS).alias("x")).join(good, F.col("id") == good["_good"], "left_semi")
    known = staged(known.groupBy("lang", "x").agg(F.count("*").alias("n")))
    cut = F.percentile("x", F.lit(quantile), F.col("n")) * slack
    limits = known.groupBy("lang").agg(cut.alias("_cut"), F.sum("n").alias("_n")).where(F.col("_n") >= least).select(F.col("lang").alias("_of"), "_cut")
    limit = F.lit(known.agg(cut.alias("cut")).first()["cut"]).cast("double")
    scored = scored.join(limits, F.col("lang") == F.col("_of"), "left").withColumn("threshold", F.coalesce("_cut", limit)).drop("_of", "_cut")
    others = scored.select("id", F.round("toxicity", DECIMALS).alias("x")).join(told.where("t = 0"), F.col("id") == F.col("_good"), "left_semi")
    worst = others.groupBy("x").agg(F.count("*").alias("n")).agg(F.percentile("x", F.lit(clean), F.col("n")).alias("cut")).first()["cut"]
    toxic = F.lit(False) if worst is None else F.round("toxicity", DECIMALS) > F.lit(worst)
    good_enough = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return scored.withColumn("toxic", toxic).withColumn("accepted", good_enough & ~F.col("toxic"))


def op9_quality(spark, sf_dir: str) -> DataFrame:
    found = quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), keep=("doc_id", "lang"))
    return found.select("doc_id", "lang", "n_bytes", "perplexity", "threshold", "accepted")


def stage_quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier accepts, every column as it was, whatever its name. Null and empty texts go;
    of repeated rows all stay or none; an empty table gives an empty one."""
    return _judged(docs, read(spark, sf_dir, "labels"), tuple(docs.columns)).where("accepted").select("kept.*")
