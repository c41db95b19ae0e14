"""Token ids in wavelet matrices: one compressed file a shard, with access, count and occurrence lookup."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_type, octets, quoted, read, staged
from .vocab import default_path, groups, word_ids

MAGIC = b"WVM2"
#: Tokens of one shard, to the end of the document that reaches it.
SHARD = 1 << 21
#: Bits between two counts of a rank directory, bytes of a plane (a multiple of 8) that are compressed together, lookups done at once.
BLOCK, CHUNK, AT_ONCE = 512, 1 << 15, 1 << 12


class Plane:
    """The packed bits of a plane, of which a lookup inflates the chunks it meets."""

    def __init__(self, size: int, chunks: list[bytes]):
        self.size, self.chunks = size, chunks
        self.data, self.open = np.zeros(size + -size % 8, np.uint8), np.zeros(len(chunks), bool)

    @classmethod
    def of(cls, data: np.ndarray) -> Plane:
        out = cls(len(data), [])
        out.data[: len(data)] = data
        return out

    def _inflate(self, which) -> None:
        for c in which:
            part = zstandard.ZstdDecompressor().decompress(self.chunks[c])
            self.data[c * CHUNK : c * CHUNK + len(part)] = np.frombuffer(part, np.uint8)
            self.open[c] = True

    def _meet(self, at: np.ndarray) -> None:
        if not self.open.all():
            met = np.zeros(len(self.chunks), bool)
            met[at // CHUNK] = True
            self._inflate(np.flatnonzero(met & ~self.open))

    def bits(self, i: np.ndarray) -> np.ndarray:
        self._meet(i >> 3)
        return (self.data[i >> 3] >> (7 - (i & 7)).astype(np.uint8)) & 1

    def words(self, at: np.ndarray) -> np.ndarray:
        """64 bits each, the first one highest."""
        self._meet(at * 8)
        return self.data.view(">u8")[at].astype(np.uint64)

    def whole(self) -> np.ndarray:
        self._inflate(np.flatnonzero(~self.open))
        return self.data[: self.size]


class WaveletMatrix:
    """Bit-planes from the highest bit down; each plane orders the next, zeros before ones.

    `planes[k]` has a plane's packed bits, `counts[k]` the ones in each block of BLOCK bits. Lookups take numbers or arrays.
    """

    def __init__(self, n: int, planes: list[Plane], counts: np.ndarray):
        self.n, self.planes, self.counts = n, planes, counts
        self.ranks = np.concatenate([np.zeros((len(planes), 1), np.int64), np.cumsum(counts, 1, dtype=np.int64)], 1)
        self.zeros = n - self.ranks[:, -1]

    @classmethod
    def build(cls, ids: np.ndarray, width: int) -> WaveletMatrix:
        planes, counts, now = [], [], ids
        for b in range(width - 1, -1, -1):
            ones = (now & now.dtype.type(1 << b)) != 0
            planes.append(np.packbits(ones))
            counts.append(np.bitwise_count(np.pad(planes[-1], (0, -len(planes[-1]) % (BLOCK // 8)))).reshape(-1, BLOCK // 8).sum(1, dtype=np.uint16))
            now = np.concatenate([np.compress(~ones, now), np.compress(ones, now)])
        return cls(len(ids), [Plane.of(p) for p in planes], np.array(counts, np.uint16).reshape(width, -1))

    def _rank1(self, k: int, i) -> np.ndarray:
        """Ones before position i of plane k: those before its block, then those of the block's bytes."""
        i = np.asarray(i, np.int64)
        flat, plane = i.reshape(-1), self.planes[k]
        out = self.ranks[k][flat // BLOCK]
        for at in range(0, len(flat) if plane.size else 0, AT_ONCE):
            x = flat[at : at + AT_ONCE]
            last = np.minimum(x // 64, len(plane.data) // 8 - 1)
            for back in range(1, BLOCK // 64):  # whole words between the block's start and i
                some = np.flatnonzero(x // 64 - back >= x // BLOCK * (BLOCK // 64))
                out[at + some] += np.bitwise_count(plane.words(x[some] // 64 - back))
            odd = x & 63
            out[at : at + AT_ONCE] += np.where(odd > 0, np.bitwise_count(plane.words(last) >> (64 - np.maximum(odd, 1)).astype(np.uint64)), 0)
        return out.reshape(i.shape)

    def access(self, i) -> np.ndarray:
        """The ids at positions i."""
        i = np.atleast_1d(np.asarray(i, np.int64))
        out = np.zeros(len(i), np.int64)
        for k, plane in enumerate(self.planes):
            bit, ones = plane.bits(i), self._rank1(k, i)
            out = (out << 1) | bit
            i = np.where(bit, self.zeros[k] + ones, i - ones)
        return out

    def _down(self, symbol: np.ndarray, *at: np.ndarray) -> list[np.ndarray]:
        """Where boundaries of the first plane lie below the last one, on a symbol's way down."""
        for k, b in enumerate(range(len(self.planes) - 1, -1, -1)):
            one = symbol >> b & 1
            ranks = [self._rank1(k, x) for x in at]
            at = [np.where(one, self.zeros[k] + r, x - r) for x, r in zip(at, ranks, strict=True)]
        return list(at)

    def rank(self, symbol, i) -> np.ndarray:
        """How often the symbol occurs before position i."""
        symbol, i = np.broadcast_arrays(np.asarray(symbol, np.int64), np.asarray(i, np.int64))
        lo, hi = self._down(symbol, np.zeros_like(i), i)
        return np.where(symbol >> len(self.planes) == 0, hi - lo, 0)[()]

    def within(self, symbol, begin, end) -> np.ndarray:
        """How often a symbol that occurs is in [begin, end)."""
        begin, end = self._down(np.asarray(symbol, np.int64), np.asarray(begin, np.int64), np.asarray(end, np.int64))
        return end - begin

    def count(self, symbol) -> np.ndarray:
        return self.rank(symbol, self.n)

    def select(self, symbol, j) -> np.ndarray:
        """The position of the symbol's occurrence number j, from 0."""
        symbol, j = np.broadcast_arrays(np.asarray(symbol, np.int64), np.asarray(j, np.int64))
        if (j < 0).any() or (j >= self.count(symbol)).any():
            raise IndexError(j)
        at = self._down(symbol, np.zeros_like(j))[0] + j
        for k in range(len(self.planes) - 1, -1, -1):
            one = symbol >> (len(self.planes) - 1 - k) & 1
            want = np.where(one, at - self.zeros[k], at)
            lo, hi = np.zeros_like(at), np.full_like(at, self.n)  # the least i with want + 1 such bits up to it
            while (lo < hi).any():
                mid = (lo + hi) // 2
                r = self._rank1(k, np.minimum(mid + 1, self.n))
                enough = np.where(one, r, mid + 1 - r) > want
                lo, hi = np.where(enough | (lo >= hi), lo, mid + 1), np.where(enough, mid, hi)
            at = lo
        return at[()]

    def decode(self, dtype=np.uint32) -> np.ndarray:
        """All ids: the last plane's order is undone first."""
        now = np.zeros(self.n, dtype)
        for k in range(len(self.planes) - 1, -1, -1):
            ones = np.unpackbits(self.planes[k].whole(), count=self.n).view(bool)
            now[self.zeros[k] :] |= now.dtype.type(1 << (len(self.planes) - 1 - k))
            back = np.empty_like(now)
            back[np.flatnonzero(~ones)], back[np.flatnonzero(ones)] = now[: self.zeros[k]], now[self.zeros[k] :]
            now = back
        return now


def to_file(ids: np.ndarray, doc_ids: list, lengths: np.ndarray, width: int) -> bytes:
    """Header and sizes; documents' ids (a null is the least long), their lengths and the rank directory; then the planes,
    in chunks. Each part is compressed by itself."""
    squeeze, matrix = zstandard.ZstdCompressor(level=1).compress, WaveletMatrix.build(ids, width)
    docs = np.array([-(1 << 63) if d is None else d for d in doc_ids], "<i8")
    parts = [squeeze(docs.tobytes()), squeeze(np.asarray(lengths, "<i8").tobytes()), squeeze(matrix.counts.astype("<u2").tobytes())]
    for plane in matrix.planes:
        parts += [squeeze(plane.data[at : at + CHUNK].tobytes()) for at in range(0, plane.size, CHUNK)]
    return MAGIC + struct.pack("<QQB", len(ids), len(docs), width) + struct.pack(f"<{len(parts)}Q", *map(len, parts)) + b"".join(parts)


def from_file(data: bytes) -> tuple[WaveletMatrix, list, np.ndarray]:
    """The matrix, whose planes are still compressed, the documents' ids, their lengths."""
    if data[:4] != MAGIC:
        raise ValueError("not a shard file")
    n, docs, width = struct.unpack_from("<QQB", data, 4)
    size = -(-n // 8)
    each = -(-size // CHUNK)
    sizes = struct.unpack_from(f"<{width * each + 3}Q", data, 21)
    ends = np.cumsum((21 + 8 * len(sizes), *sizes)).tolist()
    parts, open_ = [data[a:z] for a, z in zip(ends[:-1], ends[1:], strict=True)], zstandard.ZstdDecompressor().decompress
    ids = [None if d == -(1 << 63) else d for d in np.frombuffer(open_(parts[0]), "<i8").tolist()]
    counts = np.frombuffer(open_(parts[2]), "<u2").reshape(width, -1)
    return WaveletMatrix(n, [Plane(size, parts[3 + k * each : 3 + (k + 1) * each]) for k in range(width)], counts), ids, np.frombuffer(open_(parts[1]), "<i8")


def write_shards(docs: DataFrame, *, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, width: int | None = None, shard: int = SHARD) -> DataFrame:
    """Encodes every row's whole text, ends it with end_id, and writes the ids in ascending order of documents as shard
    files in the shared folder: rows of part, shard, start (tokens of the part before it), n_tokens, file. Ids have as many
    bits as the vocabulary needs, where no width is given.

    Documents are range-partitioned by id, so parts are in order and none depends on another; a null id comes first,
    equal ids lie together, in the order of their texts; null and empty texts are an end alone. A very long text is
    encoded whole, in the shard that it fills. A task holds one shard. An empty table gives no shards. Other columns of
    docs don't matter, whatever their names.
    """
    path = path or default_path()

    def pack(batches):
        words, part, start, no = word_ids(path, None), TaskContext.get().partitionId(), 0, 0
        wide = width or max(end_id, len(words.ends) - 1).bit_length()
        held, ids, lengths, size = [], [], [], 0

        def out():
            cells = [[part], [no], [start], [size], [to_file(np.concatenate(held), ids, np.concatenate(lengths), wide)]]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], ["part", "shard", "start", "n_tokens", "file"])

        for b in batches:
            who, texts = b[0].to_pylist(), b[1].to_pylist()
            for lo, hi in groups(texts, 1 << 22):
                got, many = words.ended(texts[lo:hi], end_id)
                ends, at = np.cumsum(many), 0
                while at < hi - lo:  # documents to the one that fills the shard, or all
                    skip = ends[at] - many[at]
                    z = min(int(np.searchsorted(ends, skip + shard - size)) + 1, hi - lo)
                    held.append(got[skip : ends[z - 1]])
                    ids += who[lo + at : lo + z]
                    lengths.append(many[at:z])
                    size, at = size + int(ends[z - 1] - skip), z
                    if size >= shard:
                        yield out()
                        start, no = start + size, no + 1
                        held, ids, lengths, size = [], [], [], 0
        if ids:
            yield out()

    rows = docs.select(quoted(id_col).cast("long").alias("id"), octets(quoted(text_col)).alias("t")).repartitionByRange("id").sortWithinPartitions("id", "t")
    return staged(rows.mapInArrow(pack, "part int, shard int, start long, n_tokens long, file binary"), "none")


def _starts(shards: DataFrame) -> dict[int, int]:
    """Tokens before each part, from a sum over one row a part."""
    before, upto = {}, 0
    for r in shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():  # as many as partitions
        before[r.part], upto = upto, upto + r.n
    return before


def _opened(shards: DataFrame, work, kind: str) -> DataFrame:
    """work(matrix, document ids, lengths, tokens before the shard) for every file: columns as kind names them."""
    before, made = _starts(shards), T._parse_datatype_string(kind)
    kinds = [arrow_type(f.dataType) for f in made]

    def run(batches):
        for b in batches:
            for part, start, data in zip(b["part"].to_pylist(), b["start"].to_pylist(), b["file"], strict=True):
                cells = work(*from_file(data.as_py()), before[part] + start)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], made.names)

    return shards.select("part", "start", "file").mapInArrow(run, kind)


def read_shards(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, first_id, n_first) of each document, from the files alone: first_id is looked
    up by access, n_first, its occurrences in the document, by ranks. No shards give no rows."""

    def told(matrix, ids, lengths, before):
        ends = np.cumsum(lengths)
        first = matrix.access(ends - lengths)
        often = matrix.within(first, ends - lengths, ends)
        tokens = memoryview(matrix.decode(np.uint16 if len(matrix.planes) <= 16 else np.uint32).astype("<u4").tobytes())
        crcs = [zlib.crc32(tokens[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
        return ids, ends - lengths + before, lengths, crcs, first, often

    return _opened(shards, told, "doc_id long, start long, n_tokens long, ids_crc32 long, first_id long, n_first long")


def token_counts(shards: DataFrame, ids: list[int]) -> DataFrame:
    """(id, n, n_docs) of each of a short list of ids: its occurrences, and the documents that have it. Ids that no document has
    count 0; repeats in the list are one; no shards give no rows."""
    wanted = np.unique(np.array(ids, np.int64))

    def told(matrix, _, lengths, before):
        ends = np.cumsum(lengths)
        upto = matrix.rank(wanted[:, None], np.r_[0, ends][None])
        return wanted, upto[:, -1], (np.diff(upto, axis=1) > 0).sum(1)

    return _opened(shards, told, "id long, n long, n_docs long").groupBy("id").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def occurrences(shards: DataFrame, ids: list[int], most: int = 1 << 16) -> DataFrame:
    """(id, doc_id, start, place) of every occurrence of each of a short list of ids: the document's id and the place of its
    first token among all, and the occurrence's own place in it, by select, `most` occurrences at once. A document of a null
    id keeps it; ids that no document has give no rows, nor do repeats in the list."""
    wanted, before = np.unique(np.array(ids, np.int64)), _starts(shards)

    def find(batches):
        for b in batches:
            for part, start, data in zip(b["part"].to_pylist(), b["start"].to_pylist(), b["file"], strict=True):
                matrix, docs, lengths = from_file(data.as_py())
                ends = np.cumsum(lengths)
                for s, n in zip(wanted.tolist(), matrix.count(wanted).tolist(), strict=True):
                    for lo in range(0, n, most):
                        at = matrix.select(s, np.arange(lo, min(n, lo + most)))
                        own = np.searchsorted(ends, at, "right")
                        first = ends[own] - lengths[own]
                        cells = [np.full(len(at), s), [docs[x] for x in own.tolist()], first + before[part] + start, at - first]
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cells], ["id", "doc_id", "start", "place"])

    return shards.select("part", "start", "file").mapInArrow(find, "id long, doc_id long, start long, place long")


def tokens_at(shards: DataFrame, places: DataFrame, *, col: str = "position") -> DataFrame:
    """(position, id) of each different position of a column, counted over all tokens; those past the last token, negative ones and
    nulls give no rows.

    Positions meet shards by equal numbers of a grid as wide as the mean shard, and are read by access, a shard a group. A group has at
    most one row a token of its shard, which is what a task holds anyway.
    """
    spark, before = shards.sparkSession, _starts(shards)
    size = shards.agg(F.avg("n_tokens")).first()[0]
    if not size:
        return spark.createDataFrame([], "position long, id long")
    parts, grid = spark.createDataFrame(list(before.items()), "part int, before long"), int(size) + 1
    where = shards.where("n_tokens > 0").join(parts, "part").select("part", "shard", (F.col("before") + F.col("start")).alias("begin"), "n_tokens")
    where = where.withColumn("cell", F.explode(F.sequence(F.floor(F.col("begin") / grid), F.floor((F.col("begin") + F.col("n_tokens") - 1) / grid))))
    asked = places.select(quoted(col).cast("long").alias("position")).where("position is not null").distinct().withColumn("cell", F.floor(F.col("position") / grid))
    met = asked.join(where, "cell").where("position >= begin and position < begin + n_tokens").select("part", "shard", "position", (F.col("position") - F.col("begin")).alias("at"))

    def look(asked: pa.Table, file: pa.Table) -> pa.Table:
        at = asked["at"].to_numpy()
        ids = from_file(file["file"][0].as_py())[0].access(at) if len(at) else at
        return pa.table({"position": asked["position"].combine_chunks().cast(pa.int64()), "id": pa.array(ids, pa.int64())})

    files = shards.join(met.select("part", "shard").distinct(), ["part", "shard"], "left_semi").select("part", "shard", "file").toDF("p", "s", "file")
    return met.groupBy("part", "shard").cogroup(files.groupBy("p", "s")).applyInArrow(look, "position long, id long")


def op3_wavelet(spark, sf_dir: str) -> DataFrame:
    return read_shards(write_shards(read(spark, sf_dir, "documents")))
