"""Removal of byte strings that an earlier document has, by intervals of a Burrows-Wheeler transform.

Strings of `length` bytes are dealt to buckets by their least hash of K bytes (a minimizer), so equal strings meet in one
bucket whatever documents they come from. A first pass counts minimizers and leaves a bitmap of those that two documents
have; a second one sends the stretches around these. In a bucket, a Burrows-Wheeler transform of the different
stretches is extended backwards level by level: common prefixes come out by increasing value, and what has none of less
than `length` bytes stays together as one interval, whose smallest document keeps its string.
"""

from __future__ import annotations

import hashlib
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import octets, quoted, read, slices

LENGTH, K = 50, 24
#: Text bytes to a bucket; most bits of the bitmap (32 MB), in which collisions only let more stretches through.
BUCKET, MOST_BITS = 1 << 22, 28
#: Strings of one stretch at most; text bytes that a task works on at once.
RUN, AT_ONCE = 64, 1 << 23
#: A minimizer that more slices have than this is hot: of its stretches only strings that two documents have are sent.
HOT = 128
MIX, ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
BYTES = (np.arange(1, 257, dtype=np.uint64) * ODD) ^ ((np.arange(1, 257, dtype=np.uint64) * MIX) >> np.uint64(31))


def _grams(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k bytes, from those of halves."""
    h, width = BYTES[data], 1
    while width < k:
        step = min(width, k - width)
        h = (h[:-step] * MIX) + (h[step:] * ODD)
        h ^= h >> np.uint64(29)
        width += step
    return h


def stretches(data: np.ndarray, lengths: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of runs of strings with one minimizer hash, in texts that lie end to end in data."""
    none = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    if len(data) < length:
        return none
    least, width = _grams(data, k), 1
    want = length - k + 1
    while width < want:
        step = min(width, want - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    ends = np.cumsum(lengths)
    mark = np.zeros(len(data) + 1, np.int32)
    np.add.at(mark, np.maximum(ends - lengths, ends - length + 1), 1)
    np.add.at(mark, ends, -1)
    valid = np.cumsum(mark[: len(least)]) == 0
    other = np.r_[True, least[1:] != least[:-1]]
    first = np.flatnonzero(valid & (other | ~np.r_[False, valid[:-1]]))
    last = np.flatnonzero(valid & (np.r_[other[1:], True] | ~np.r_[valid[1:], False]))
    pieces = (last - first) // RUN + 1
    if len(pieces) and pieces.max() > 1:
        within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first, last = np.repeat(first, pieces) + within * RUN, np.repeat(last, pieces)
        last = np.minimum(last, first + RUN - 1)
    return least[first] * MIX, first, last + length


def _batches(texts: list, most: int = 1 << 19):
    """(first text, data, lengths) of groups of texts."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most or i == len(texts) - 1:
            yield start, np.frombuffer(b"".join(texts[start : i + 1]), np.uint8), np.array([len(x) for x in texts[start : i + 1]], np.int64)
            start, size = i + 1, 0


def _gathered(batches, most: int, column: int | str = -1):
    """Batches put together to about `most` bytes of the texts in a column, and those of more cut: a slice tells of its
    hashes, and packs a bucket's stretches, once, however few rows the session's batches have."""
    held, size = [], 0
    for b in slices(batches, most, column):
        n = pc.sum(pc.binary_length(b.column(b.num_columns - 1 if column == -1 else column))).as_py() or 0
        if held and size + n > most:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(b)
        size += n
    if held:
        yield pa.concat_batches(held)


def _all(texts: list, length: int, k: int):
    """(hash, text number, start, end) of all stretches of a batch."""
    parts = []
    for at, data, lengths in _batches(texts):
        h, a, e = stretches(data, lengths, length, k)
        begin = np.cumsum(lengths) - lengths
        doc = np.searchsorted(begin, a, "right") - 1
        parts.append((h, doc + at, a - begin[doc], e - begin[doc]))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.uint64),) + (np.empty(0, np.int64),) * 3


def _rest(h: np.ndarray, bits: int) -> np.ndarray:
    """The 40 bits after the bucket's."""
    return (h << np.uint64(bits)) >> np.uint64(24)


def _pack5(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpack5(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.reshape(-1).view("<u8")


class Bits:
    """A bitmap that travels compressed: a broadcast lies on the disk of every executor, and few bits are set."""

    def __init__(self, bitmap: np.ndarray):
        self.blob = zstandard.ZstdCompressor(level=3).compress(bitmap.tobytes())

    @cached_property
    def map(self) -> np.ndarray:
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(self.blob), np.uint8)


def _probes(rest: np.ndarray, slice_bits: int) -> tuple[np.ndarray, np.ndarray]:
    return rest >> np.uint64(40 - slice_bits), (rest * MIX) >> np.uint64(64 - slice_bits)


def _lit(bitmap: np.ndarray, h: np.ndarray, bits: int, slice_bits: int) -> np.ndarray:
    """Which hashes have all their bits in a bitmap."""
    bucket, rest, out = h >> np.uint64(64 - bits), _rest(h, bits), np.ones(len(h), bool)
    for p in _probes(rest, slice_bits):
        at = (bucket << np.uint64(slice_bits)) | p
        out &= (bitmap[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1
    return out


def _bitmaps(texts: DataFrame, found, bits: int, slice_bits: int, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits, by bucket, for each hash that two documents have, and for each that more than `hot` slices tell of. found(texts)
    gives the hashes and the texts they come from. A slice tells of each of its hashes once, and twice if it has it in
    two documents."""

    def told(batches):
        for b in _gathered(batches, AT_ONCE):
            key = b[0].to_numpy()
            h, doc = found(b[1].to_pylist())
            order = np.argsort(h, kind="stable")
            h, who = h[order], key[doc[order]]
            new = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.empty(0, np.int64)
            two = np.maximum.reduceat(who, new) != np.minimum.reduceat(who, new) if len(h) else np.empty(0, bool)
            h = np.repeat(h[new], 1 + two)
            cuts = np.searchsorted(h >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
            have = np.flatnonzero(np.diff(cuts))
            yield pa.RecordBatch.from_arrays([pa.array(have, pa.int32()), pa.array([_pack5(_rest(h[cuts[x] : cuts[x + 1]], bits)) for x in have], pa.binary())], ["bucket", "rest"])

    def met(table: pa.Table) -> pa.Table:
        values, n = np.unique(np.concatenate([_unpack5(x.as_py()) for x in table["rest"]]), return_counts=True)
        cells = []
        for some in (values[n > 1], values[n > 2 * hot]):
            flags = np.zeros(1 << slice_bits, bool)
            for p in _probes(some, slice_bits):
                flags[p] = True
            cells.append(pa.array([np.packbits(flags).tobytes() if len(some) else None], pa.binary()))
        return pa.table({"bucket": table["bucket"].slice(0, 1).cast(pa.int32()), "flags": cells[0], "hot": cells[1]})

    shared, often = (np.zeros((1 << bits, max(1, (1 << slice_bits) // 8)), np.uint8) for _ in range(2))
    for r in texts.mapInArrow(told, "bucket int, rest binary").groupBy("bucket").applyInArrow(met, "bucket int, flags binary, hot binary").toLocalIterator():
        for out, flags in ((shared, r["flags"]), (often, r["hot"])):
            if flags is not None:
                out[r["bucket"]] = np.frombuffer(flags, np.uint8)
    return shared.reshape(-1), often.reshape(-1)


def _strings(texts: list, doc: np.ndarray, start: np.ndarray, end: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, stretch number, start) of every string of stretches."""
    count = end - start - length + 1
    which = np.repeat(np.arange(len(doc)), count)
    within = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    hashes, least = [], 0
    while least < len(doc):  # the stretches alone, about 1 MB at once
        most = max(1, int(np.searchsorted(np.cumsum((end - start)[least : least + (1 << 15)]), 1 << 20)))
        d, a, z = (x[least : least + most] for x in (doc, start, end))
        data = np.frombuffer(b"".join([texts[i][j:k] for i, j, k in zip(d.tolist(), a.tolist(), z.tolist(), strict=True)]), np.uint8)
        begin, n = np.cumsum(z - a) - (z - a), count[least : least + most]
        skip = int(count[:least].sum())
        hashes.append(_grams(data, length)[np.repeat(begin, n) + within[skip : skip + int(n.sum())]] * MIX)
        least += most
    return np.concatenate(hashes) if hashes else np.empty(0, np.uint64), which, start[which] + within


def _narrowed(texts: list, h, doc, start, end, narrow: np.ndarray, test, length: int):
    """The stretches, those marked in `narrow` cut down to their strings that pass a test of hashes."""
    g, which, at = _strings(texts, doc[narrow], start[narrow], end[narrow], length)
    ok = test(g)
    which, at = np.flatnonzero(narrow)[which[ok]], at[ok]
    fresh = np.flatnonzero(np.r_[True, (which[1:] != which[:-1]) | (at[1:] != at[:-1] + 1)]) if len(which) else np.empty(0, np.int64)
    last = np.r_[fresh[1:], len(which)] - 1 if len(fresh) else fresh
    of = which[fresh]
    return tuple(np.concatenate([x[~narrow], y]) for x, y in ((h, h[of]), (doc, doc[of]), (start, at[fresh]), (end, at[last] + length)))


def _send(held, bits: int, slice_bits: int, length: int, k: int):
    """Stretches with a shared minimizer, packed by bucket. Of equal stretches of a batch those of its smallest document
    go, the others are decided here: bucket -1 holds their spans."""

    def send(batches):
        shared, often, strings = (x and x.map for x in held.value)
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for b in _gathered(batches, AT_ONCE):
            key, row, texts = b["k"].to_numpy(), b["u"].to_numpy(), b["t"].to_pylist()
            h, doc, start, end = _all(texts, length, k)
            some = _lit(shared, h, bits, slice_bits)
            h, doc, start, end = h[some], doc[some], start[some], end[some]
            if strings is not None:
                h, doc, start, end = _narrowed(texts, h, doc, start, end, _lit(often, h, bits, slice_bits), lambda g: _lit(strings, g, bits, slice_bits), length)
            bucket, rest = h >> np.uint64(64 - bits), _rest(h, bits)
            keep = np.lexsort((key[doc], h))
            least, gone = {}, np.zeros(len(h), bool)
            more = np.r_[False, h[keep][1:] == h[keep][:-1], False]
            several = keep[more[1:] | more[:-1]]  # those of one minimizer; none else are equal
            for i, d, s, e, k_ in zip(*(x.tolist() for x in (several, doc[several], start[several], end[several], key[doc[several]])), strict=True):
                if least.setdefault(texts[d][s:e], k_) < k_:
                    gone[i] = True
            del least
            go, done, cells = keep[~gone[keep]], keep[gone[keep]], [[], []]
            cuts = np.searchsorted(bucket[go], np.arange((1 << bits) + 1, dtype=np.uint64))
            for x in np.flatnonzero(np.diff(cuts)):
                i = go[cuts[x] : cuts[x + 1]]
                size = (end[i] - start[i]).astype(np.uint8)
                body = b"".join(texts[d][s:e] for d, s, e in zip(doc[i].tolist(), start[i].tolist(), end[i].tolist(), strict=True))
                cells[0].append(x)
                cells[1].append(squeeze(np.int64(len(i)).tobytes() + _pack5(rest[i]) + key[doc[i]].tobytes() + row[doc[i]].tobytes() + start[i].astype("<u4").tobytes() + size.tobytes() + body))
            for at in range(0, len(done), 1 << 16):
                j = done[at : at + (1 << 16)]
                cells[0].append(-1)
                cells[1].append(np.stack([key[doc[j]], row[doc[j]], start[j], end[j]], 1).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cells[0], pa.int32()), pa.array(cells[1], pa.binary())], ["bucket", "body"])

    return send


def _opened(blob: bytes):
    n, at, out = int(np.frombuffer(blob, "<i8", 1)[0]), 8, []
    out.append(_unpack5(blob[8 : 8 + 5 * n]))
    at += 5 * n
    for kind in ("<i8", "<i8", "<u4", np.uint8):
        out.append(np.frombuffer(blob, kind, n, at))
        at += n * np.dtype(kind).itemsize
    ends = np.cumsum(out[-1].astype(np.int64)) + at
    return (*out, [blob[e - s : e] for s, e in zip(out[-1].tolist(), ends.tolist(), strict=True)])


def common_prefix_intervals(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): the text's suffixes in the order of their first `length` bytes, and where an interval of suffixes
    begins that share all of these.

    The transform is extended backwards level by level. At level v the boundaries whose common prefix is v are known;
    a suffix's boundary with the one before it is v + 1 where a boundary of v lies between the places of the byte that
    comes before both. What no level below `length` has reached shares `length` bytes or more.
    """
    n = len(text)
    rank, width = text.astype(np.int64), 1
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = text
    code = padded[:n].copy()
    for i in range(1, 8):
        code = (code << np.uint64(8)) | padded[i : n + i]
    order = np.argsort(code)  # equal prefixes in any order: what follows asks for no more than where they begin
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.r_[False, code[order][1:] != code[order][:-1]])
    width = 8
    while width < length:
        step = min(width, length - width)
        ahead = np.full(n, -1, np.int64)
        ahead[: n - step] = rank[step:]
        code = (rank << 32) + ahead + 1
        order = np.argsort(code)
        now = code[order]
        rank[order] = np.cumsum(np.r_[False, now[1:] != now[:-1]])
        width += step
    bwt = text[order - 1]  # the first suffix follows the last byte, a separator
    by = np.argsort(bwt, kind="stable")  # by[i]: the place of the byte that leads to suffix i
    before = np.r_[-1, by[:-1]]
    head = np.r_[True, bwt[by][1:] != bwt[by][:-1]]  # the first suffix of each first byte: common prefix 0
    reached = head.copy()
    todo, fresh = np.flatnonzero(~reached), np.flatnonzero(head)
    one = by[todo] == before[todo] + 1  # a single place to look at, which most have
    near, todo = todo[one], todo[~one]
    at, place, prior = by[near], by[todo], before[todo]
    for _ in range(1, length):
        met = reached[at]
        if 8 * len(todo) > n:
            upto = np.cumsum(reached, dtype=np.int32)
            hit = upto[place] != upto[prior]
        else:  # older boundaries have told already
            hit = np.searchsorted(fresh, place, "right") != np.searchsorted(fresh, prior, "right")
        fresh = np.sort(np.concatenate([np.compress(met, near), np.compress(hit, todo)]))
        if not len(fresh):
            break
        reached[fresh] = True
        rest, far = np.flatnonzero(~met), np.flatnonzero(~hit)
        near, at, todo, place, prior = near[rest], at[rest], todo[far], place[far], prior[far]
    return order, reached


def _settled(bucket: list[bytes], length: int):
    """(document, row, start, end) of the strings of a bucket that a smaller document has."""
    rest, key, row, start, size, body = (np.concatenate(x) if isinstance(x[0], np.ndarray) else [s for y in x for s in y] for x in zip(*(_opened(b) for b in bucket), strict=True))
    number: dict[bytes, int] = {}
    kind = np.fromiter((number.setdefault(s, len(number)) for s in body), np.int64, len(body))
    names = list(number)
    least = np.full(len(names), np.iinfo(np.int64).max)
    np.minimum.at(least, kind, key)
    group = np.zeros(len(names), np.uint64)
    group[kind] = rest
    _, back, n = np.unique(group, return_inverse=True, return_counts=True)
    alone = n[back] == 1  # the only stretch with its minimizer
    i = np.flatnonzero(alone[kind] & (key > least[kind]))
    begin = start.astype(np.int64)
    out = [np.stack([key[i], row[i], begin[i], begin[i] + size[i]], 1)]
    if len(odd := np.flatnonzero(~alone)):
        text = np.frombuffer(b"\xff".join(names[x] for x in odd) + b"\xff", np.uint8)
        text = np.where(text == 255, 0, text + np.uint8(1)).astype(np.uint8)  # no UTF-8 text has byte 255; the separator is least
        order, first = common_prefix_intervals(text, length)
        ends = np.flatnonzero(text == 0)
        own = np.searchsorted(ends, np.arange(len(text)))
        whole = np.arange(len(text)) + length <= ends[own]
        k = np.where(whole, least[odd][own], np.iinfo(np.int64).max)[order]
        at = np.flatnonzero(first)
        smallest = np.empty(len(text), np.int64)
        smallest[order] = np.repeat(np.minimum.reduceat(k, at), np.diff(np.r_[at, len(text)]))
        begins = np.r_[0, ends[:-1] + 1]
        place = np.full(len(names), -1)
        place[odd] = begins
        i = np.flatnonzero(~alone[kind])
        count = size[i].astype(np.int64) - length + 1
        which = np.repeat(np.arange(len(i)), count)  # every string of every such row
        offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        gone = smallest[place[kind[i]][which] + offset] < key[i][which]
        which, offset = which[gone], offset[gone]
        if len(which):
            fresh = np.r_[True, (which[1:] != which[:-1]) | (offset[1:] != offset[:-1] + 1)]
            a, z = np.flatnonzero(fresh), np.r_[np.flatnonzero(fresh)[1:], len(which)] - 1
            r = i[which[a]]
            out.append(np.stack([key[r], row[r], begin[r] + offset[a], begin[r] + offset[z] + length], 1))
    return np.concatenate(out)


def _spans(data: np.ndarray) -> pa.Table:
    return pa.table({n: pa.array(data[:, i], t) for i, (n, t) in enumerate((("k", pa.int64()), ("u", pa.int64()), ("s", pa.int32()), ("e", pa.int32())))})


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = K, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): docs as (id, k, u, t) and the bytes [s, e) of rows (k, u) that a smaller document has too. Spans of a
    row may touch and overlap; nulls, ties, empty and very long texts are as in deduplicated(), and other columns don't matter.

    A minimizer of a line that very many documents have has a stretch a document at the line's borders, most of them of
    strings that no other has. Where there are such minimizers, their strings are counted in a pass of their own, so
    that what meets in one bucket is what really repeats.
    """
    rows = docs.select(quoted(id_col).cast("long").alias("id"), octets(quoted(text_col)).alias("t")).withColumn("k", F.coalesce("id", F.lit((1 << 63) - 1))).withColumn("u", F.xxhash64("k", "t"))
    spark = docs.sparkSession
    total = rows.agg(F.sum(F.length("t"))).first()[0] or 1
    bits = max(4, (total // BUCKET).bit_length())
    slice_bits = max(3, min(MOST_BITS, total.bit_length()) - bits)
    shared, often = _bitmaps(rows.select("k", "t"), lambda texts: _all(texts, length, k)[:2], bits, slice_bits, hot)
    strings = None
    if often.any():
        told = spark.sparkContext.broadcast(Bits(often))

        def hot_strings(texts):
            h, doc, start, end = _all(texts, length, k)
            some = _lit(told.value.map, h, bits, slice_bits)
            g, which, _ = _strings(texts, doc[some], start[some], end[some], length)
            return g, doc[some][which]

        strings = _bitmaps(rows.select("k", "t"), hot_strings, bits, slice_bits, 1 << 60)[0]
    held = spark.sparkContext.broadcast((Bits(shared), Bits(often), None if strings is None else Bits(strings)))
    sent = rows.select("k", "u", "t").mapInArrow(_send(held, bits, slice_bits, length, k), "bucket int, body binary")
    salted = sent.withColumn("part", F.when(F.col("bucket") < 0, F.xxhash64("body")).otherwise(F.col("bucket").cast("long")))

    def settle(table: pa.Table) -> pa.Table:
        bodies = [x.as_py() for x in table["body"]]
        if table["bucket"][0].as_py() < 0:
            return _spans(np.concatenate([np.frombuffer(x, "<i8").reshape(-1, 4) for x in bodies]))
        open_ = zstandard.ZstdDecompressor().decompress
        return _spans(_settled([open_(x) for x in bodies], length))

    return rows, salted.groupBy("part").applyInArrow(settle, "k long, u long, s int, e int")


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """One row for every row of docs: id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes): each byte
    is removed that is in a string of `length` bytes which also starts in a document with a smaller id.

    Null and empty texts have no strings. Rows with equal ids are one document for this, and lose nothing to each other;
    a null id is larger than any. Repeats within a document stay. What is removed is judged on the input. Very long texts
    count whole; an empty table gives an empty result; other columns of docs don't matter, whatever their names.
    """
    rows, spans = repeated_spans(docs, id_col=id_col, text_col=text_col, length=length, hot=hot)
    found = spans.groupBy("k", "u").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("spans"))
    kind = T._parse_datatype_string("id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")

    def cut(batches):
        for b in batches:
            out = []
            for i, t, spans in zip(b["id"].to_pylist(), b["t"].to_pylist(), b["spans"], strict=True):
                kept, at, n, removed = [], 0, 0, 0
                if spans.is_valid:
                    pairs = spans.values
                    for s, e in zip(pairs.field("s").to_pylist(), pairs.field("e").to_pylist(), strict=True):
                        if s > at or not n:
                            kept.append(t[at:s])
                            n, at = n + 1, s
                        removed += max(0, e - at)
                        at = max(at, e)
                left = b"".join(kept) + t[at:]
                out.append((i, len(t), removed, n, hashlib.sha256(left).hexdigest(), left))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[x] for r in out], t) for x, t in enumerate(kinds)], kind.names)

    return rows.join(found, ["k", "u"], "left").select("id", "t", "spans").mapInArrow(cut, kind)


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    found = deduplicated(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


OP5_SQL = r"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, b, substring(h, 512 * b + 1, 610) AS p FROM (SELECT *, unnest(range(0, (length(h) + 511) // 512)) AS b FROM h)),
s AS (SELECT doc_id, 256 * b + i AS i, substring(p, 2 * i + 1, 100) AS g FROM (SELECT *, unnest(range(0, least(256, (length(p) - 98) // 2))) AS i FROM c)),
f AS (SELECT g, min(doc_id) AS first FROM s GROUP BY g HAVING min(doc_id) < max(doc_id)),
r AS (SELECT s.doc_id, s.i FROM s JOIN f ON s.g = f.g WHERE f.first < s.doc_id),
o AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS fresh FROM r),
n AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM o),
x AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS z FROM n GROUP BY doc_id, run),
y AS (SELECT *, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY run), 0) AS upto FROM x),
k AS (SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, max(z) AS last, string_agg(substring(h, 2 * upto + 1, 2 * (a - upto)), '' ORDER BY run) AS head FROM y JOIN h USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substring(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM h LEFT JOIN k USING (doc_id)
"""
