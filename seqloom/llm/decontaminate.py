"""Benchmark decontamination by a prefix-filtered containment join.

A benchmark item is a set of windows of `window` consecutive words (an item of fewer words is one window). A window is
contained in a document where its words occur consecutively. Containment needs every shingle of the window, so one
shingle is a sufficient prefix: all shingles are ordered by how often they occur in the documents, and only the rarest
of each window is joined. A candidate passes a length bound (the document has as many words as the window), a
positional bound (the shingle's offset must leave room on both sides), and then the words themselves are compared.

A benchmark of one block is an index that every task holds; a larger one is joined by its prefixes' hashes in Spark, and
tasks hold a bitmap of these. Both give the same rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, arrow_type, kept, octets, quoted, read, slices, staged, unpacked

SHINGLE = 3
#: Windows of a benchmark that every worker holds (about 100 MB at most); larger ones are joined.
BLOCK = 100_000
#: Bits of a bitmap of hashes (16 MB); where it fills up, more rows are joined.
BITS = 27
#: Text bytes that a task works on at once.
AT_ONCE = 1 << 21


def windows_of(words: list, window: int) -> set:
    return {tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1))} if words else set()


def shingles_of(words: list, width: int):
    return zip(*(words[i:] for i in range(width)), strict=False)


def benchmark_windows(items: DataFrame, window: int, item_col: str, text_col: str) -> DataFrame:
    """Distinct (window, item). Items without id or words give none."""

    def make(batches):
        for b in batches:
            out = [(b" ".join(w), i) for i, t in zip(b[0].to_pylist(), b[1].to_pylist(), strict=True) for w in windows_of(t.translate(ALNUM).split(), window)]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in out], pa.binary()), pa.array([i for _, i in out], pa.string())], ["words", "item"])

    rows = items.select(F.col(item_col).cast("string").alias("i"), octets(text_col).alias("t")).where("i is not null")
    return rows.mapInArrow(make, "words binary, item string").distinct()


def _widths(shingles) -> dict[int, frozenset]:
    by = defaultdict(set)
    for s in shingles:
        by[len(s)].add(s)
    return {w: frozenset(s) for w, s in by.items()}


def _frequencies(texts: DataFrame, shingles: set) -> dict[tuple, int]:
    """Documents that hold each of the block's shingles."""
    held = texts.sparkSession.sparkContext.broadcast(_widths(shingles))

    def count(batches):
        seen: Counter = Counter()
        for b in batches:
            for t in b[0].to_pylist():
                words = t.translate(ALNUM).split()
                for width, some in held.value.items():
                    seen.update(some.intersection(shingles_of(words, width)))
        yield pa.RecordBatch.from_arrays([pa.array([b" ".join(s) for s in seen], pa.binary()), pa.array(list(seen.values()), pa.int64())], ["s", "n"])

    rows = texts.mapInArrow(count, "s binary, n long").groupBy("s").agg(F.sum("n").alias("n")).collect()
    return {tuple(bytes(r.s).split()): r.n for r in rows}


def _prefix_index(rows: list[tuple[tuple, str]], often: dict[tuple, int], width: int) -> dict[int, dict[tuple, list]]:
    """Shingle width -> rarest shingle -> [(offset in the window, window, items)]."""
    items = defaultdict(list)
    for w, item in rows:
        items[w].append(item)
    index: dict = defaultdict(lambda: defaultdict(list))
    for w, who in items.items():
        own = list(shingles_of(w, min(width, len(w))))
        at = min(range(len(own)), key=lambda i: (often.get(own[i], 0), own[i]))
        if often.get(own[at], 0):  # a shingle of no document rules its window out
            index[len(own[at])][own[at]].append((at, w, tuple(who)))
    return {k: dict(v) for k, v in index.items()}


def _matches(words: list, index: dict, keys: dict) -> tuple[list[tuple[int, int]], set]:
    spans, found, n = [], set(), len(words)
    for width, some in keys.items():
        if here := some.intersection(shingles_of(words, width)):
            for i, s in enumerate(shingles_of(words, width)):
                if s in here:
                    for offset, w, items in index[width][s]:
                        start, end = i - offset, i - offset + len(w)
                        if 0 <= start and end <= n and tuple(words[start:end]) == w:
                            spans.append((start, end))
                            found.update(items)
    return spans, found


def _told(text: bytes, spans: list, items: list, fraction: int) -> tuple:
    n = len(text.translate(ALNUM).split())
    mask = bytearray(n)
    for start, end in zip(spans[::2], spans[1::2], strict=True):
        mask[start:end] = b"\1" * (end - start)
    hit = sum(mask)
    return n, hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), hit > 0 and fraction * hit >= n


RESULTS = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _contamination(docs: DataFrame, items: DataFrame, keep: tuple, text_col: str, item_col: str, item_text_col: str, window: int, shingle: int, fraction: int, block: int) -> DataFrame:
    sc = docs.sparkSession.sparkContext
    texts = docs.select(octets(quoted(text_col)).alias("t"))
    windows = staged(benchmark_windows(items, window, item_col, item_text_col))
    if windows.count() > block:
        return _joined(docs, windows, keep, text_col, window, shingle, fraction)
    state = docs.select(kept(keep), octets(quoted(text_col)).alias("octets"))
    rows = [(tuple(bytes(r.words).split()), r.item) for r in windows.collect()]
    often = _frequencies(texts, {s for w in {w for w, _ in rows} for s in shingles_of(w, min(shingle, len(w)))})
    index = _prefix_index(rows, often, shingle)
    return _reported(state, sc.broadcast(index) if index else None, fraction)


def _reported(state: DataFrame, held, fraction: int) -> DataFrame:
    """kept and the results of (kept, octets), by an index of the whole benchmark."""
    results = T._parse_datatype_string(RESULTS)

    def step(batches):
        index = held.value if held else {}
        keys = {w: frozenset(x) for w, x in index.items()}
        for b in slices(batches, AT_ONCE):
            rows = []
            for t in b["octets"].to_pylist():
                got, who = _matches(t.translate(ALNUM).split(), index, keys) if keys else ((), ())
                rows.append(_told(t, [x for g in got for x in g], sorted(who), fraction))
            yield pa.RecordBatch.from_arrays([b["kept"], *(pa.array([r[x] for r in rows], arrow_type(f.dataType)) for x, f in enumerate(results))], ["kept", *results.names])

    return state.mapInArrow(step, T.StructType([state.schema["kept"], *results]))


def _hash(words) -> int:
    return xxhash.xxh64_intdigest(b" ".join(words), len(words))


def _hashes(words: list, width: int) -> np.ndarray:
    return np.fromiter(map(_hash, shingles_of(words, width)), np.uint64, max(0, len(words) - width + 1))


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """2 ** BITS bits, those of the hashes (h) set: rows of 64 bits each are combined before and after the shuffle."""
    place = F.shiftrightunsigned(F.col("h"), 64 - BITS + 6).alias("place")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(F.col("h"), 64 - BITS).bitwiseAND(F.lit(63)).cast("int"))
    rows = hashes.select(place, bit.alias("bit")).groupBy("place").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.uint64)
    out[rows["place"].to_numpy()] = rows["bit"].to_numpy().view(np.uint64)
    return out


def _among(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    place = h >> np.uint64(64 - BITS)
    return (bitmap[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def _joined(docs: DataFrame, windows: DataFrame, keep: tuple, text_col: str, window: int, shingle: int, fraction: int) -> DataFrame:
    """kept and the results, for a benchmark of any size: nothing of it goes through the driver but bitmaps of hashes."""
    sc = docs.sparkSession.sparkContext
    state = staged(docs.select(kept(keep), octets(quoted(text_col)).alias("octets")).withColumn("uid", F.monotonically_increasing_id()))

    def cut(batches):
        for b in batches:
            rows = [(w, _hash(x) - (1 << 63), i, len(words)) for w in b["words"].to_pylist() for words in [w.split()] for i, x in enumerate(shingles_of(words, min(shingle, len(words))))]
            kinds = (pa.binary(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["words", "h", "at", "n"])

    own = staged(windows.select("words").distinct().mapInArrow(cut, "words binary, h long, at int, n int"))
    widths = [r["w"] for r in own.select(F.least("n", F.lit(shingle)).alias("w")).distinct().collect()]  # `shingle` at most
    every = sc.broadcast(_bitmap(own.select(_raw("h").alias("h"))))

    def count(batches):
        for b in slices(batches, AT_ONCE):
            found = [np.empty(0, np.uint64)]
            for t in b["octets"].to_pylist():
                words = t.translate(ALNUM).split()
                found += [np.unique(h[_among(every.value, h)]) for w in widths for h in [_hashes(words, w)]]
            h, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((h ^ np.uint64(1 << 63)).view(np.int64)), pa.array(n, pa.int64())], ["h", "often"])

    often = state.select("octets").mapInArrow(count, "h long, often long").groupBy("h").agg(F.sum("often").alias("often"))
    rarest = F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "h", "at")).alias("x")
    prefix = own.join(often, "h", "left").groupBy("words", "n").agg(rarest).where("x.often > 0")  # a shingle of no document rules its window out
    prefix = staged(prefix.select("words", "n", "x.h", "x.at"))
    some = sc.broadcast(_bitmap(prefix.select(_raw("h").alias("h"))))

    def propose(batches):
        for b in slices(batches, AT_ONCE):
            rows = []
            for u, t in zip(b["uid"].to_pylist(), b["octets"].to_pylist(), strict=True):
                words = t.translate(ALNUM).split()
                for w in widths:
                    h = _hashes(words, w)
                    for i in np.flatnonzero(_among(some.value, h)).tolist():
                        first = max(0, i - window + 1)
                        rows.append((u, int(h[i]) - (1 << 63), i, i - first, b" ".join(words[first : i + window])))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["uid", "h", "i", "before", "near"])

    met = state.select("uid", "octets").mapInArrow(propose, "uid long, h long, i int, before int, near binary").join(prefix, "h").where("before >= at")

    def confirm(batches):
        for b in batches:
            ok = [n.split()[e - a : e - a + k] == w.split() for n, e, a, k, w in zip(*(b[c].to_pylist() for c in ("near", "before", "at", "n", "words")), strict=True)]
            start = pa.array(np.array(b["i"].to_pylist(), np.int64) - np.array(b["at"].to_pylist(), np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([b["uid"], start, b["n"], b["words"]], ["uid", "start", "n", "words"]).filter(pa.array(ok, pa.bool_()))

    hits = staged(met.mapInArrow(confirm, "uid long, start long, n int, words binary").distinct())
    spans = hits.select("uid", "start", "n").distinct().groupBy("uid").agg(F.flatten(F.collect_list(F.array("start", F.col("start") + F.col("n")))).alias("spans"))
    who = hits.select("uid", "words").distinct().join(windows, "words").select("uid", "item").distinct().groupBy("uid").agg(F.array_sort(F.collect_list("item")).alias("items"))
    results = T._parse_datatype_string(RESULTS)

    def report(batches):
        for b in slices(batches, AT_ONCE, "octets"):
            rows = [_told(t, x or [], i or [], fraction) for t, x, i in zip(*(b[c].to_pylist() for c in ("octets", "spans", "items")), strict=True)]
            yield pa.RecordBatch.from_arrays([b["kept"], *(pa.array([r[x] for r in rows], arrow_type(f.dataType)) for x, f in enumerate(results))], ["kept", *results.names])

    both = state.join(spans, "uid", "left").join(who, "uid", "left").select("kept", "octets", "spans", "items")
    return both.mapInArrow(report, T.StructType([state.schema["kept"], *results]))


def _raw(h: str):
    """A hash as its bits, from the signed number that orders alike."""
    return F.col(h).bitwiseXOR(F.lit(-(1 << 63)))


def contamination(docs: DataFrame, items: DataFrame, *, text_col: str = "text", keep: tuple = ("doc_id",), item_col: str = "item_id", item_text_col: str = "text", window: int = 13, shingle: int = SHINGLE, fraction: int = 20, block: int = BLOCK) -> DataFrame:
    """One row for every row of docs: the columns of `keep`, n_words, n_hit (words inside a contained window), n_items,
    items_sha256 (of the sorted, comma-joined item ids) and contaminated (n_hit > 0 and fraction * n_hit >= n_words).

    A benchmark of up to `block` (window, item) rows is broadcast, and takes one pass for frequencies and one for the join
    without a shuffle; a larger one is joined by its windows' rarest shingles, of which tasks hold a bitmap. Null and empty texts have no words and no hits; very long ones are searched
    whole. Repeated documents give a row each; repeated items count once. Items with a null id are left out. An empty
    table gives an empty result, an empty benchmark no hits. Columns of docs that are not in `keep` do not matter,
    whatever their names; a kept one that has a result's name comes back as kept_<name>.
    """
    found = _contamination(docs, items, keep, text_col, item_col, item_text_col, window, shingle, fraction, block)
    return unpacked(found, found.columns[1:])


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def stage_decontaminate(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not contaminated by the contract's rule (windows of 13 words, a twentieth of the words), every
    column as it was, whatever its name. Null and empty texts stay; of repeated rows all stay or none. An
    empty table gives an empty one, and an empty benchmark takes nothing away."""
    found = _contamination(docs, read(spark, sf_dir, "benchmark"), tuple(docs.columns), "text", "item_id", "text", 13, SHINGLE, 20, BLOCK)
    return found.where("not contaminated").select("kept.*")


#: The windows as strings, and every window length that the benchmark has, against all runs of as many document words.
OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, least(13, len(w)) AS k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s FROM b, unnest(range(1, greatest(2, len(w) - 11))) AS t(i) WHERE len(w) > 0),
dw AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM d, (SELECT DISTINCT k FROM bw), unnest(range(1, len(w) - k + 2)) AS t(i)),
hits AS (SELECT doc_id, i, dw.k, item FROM dw JOIN bw ON dw.k = bw.k AND dw.s = bw.s),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + k)) AS t(p) GROUP BY doc_id),
x AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN x USING (doc_id)
"""
