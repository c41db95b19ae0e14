"""SimHash near-duplicates by covering locality-sensitive hashing.

Every fingerprint bit gets a non-zero vector of r + 1 bits, and every non-zero vector v of r + 1 bits makes a table whose
mask holds the bits whose vector has an odd product with v. Up to r differing bits span at most r dimensions, so some v
is orthogonal to all of them: in that table the pair has equal masked values. Every pair within the radius collides, by
construction and not by chance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACED, octets, quoted, read, slices, staged
from .components import components

RADIUS = 3
#: The pipeline's stage: documents whose sets of so many words' shingles have this Jaccard similarity are near copies.
SHINGLE, ALIKE = 5, 0.8
#: Candidates share one of BANDS groups of ROWS least hashes: at similarity 0.8 all but (1 - 0.8 ** 4) ** 16 = 0.02%.
BANDS, ROWS = 16, 4
#: Vertices, and bytes of their sets, of one bucket that are compared in one place; larger buckets are split into blocks.
TOGETHER, TOGETHER_BYTES = 512, 1 << 23
#: Pairs of places that are counted at once.
CELLS = 1 << 20
#: Fingerprints of one bucket that are compared in one place; larger buckets are compared block against block.
BLOCK = 2048
#: Text bytes that a task works on at once.
AT_ONCE = 1 << 22


def masks(radius: int) -> list[int]:
    """The bit masks of all tables: 2 ** (radius + 1) - 1 of them."""
    n = 2 ** (radius + 1)
    vectors = [1 + i % (n - 1) for i in range(64)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, n)]


def shingles(text: bytes, shingle: int) -> np.ndarray:
    """A hash of every `shingle` words; of all words where there are fewer."""
    words = text.translate(SPACED).split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = ends - np.fromiter(map(len, words), np.int64, len(words))
    k = min(shingle, len(words))
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], 42) for a, b in spans), np.uint64, len(words) - k + 1)


def fingerprint(text: bytes, shingle: int) -> int:
    return simhash(shingles(text, shingle))


def simhash(part: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    n, total = len(part), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        total += np.unpackbits(part[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long. A null or blank text has fingerprint 0."""

    def make(batches):
        for b in slices(batches, AT_ONCE):
            fps = np.array([fingerprint(t, shingle) for t in b[1].to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b[0], pa.array(fps, pa.int64())], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), octets(text_col).alias("t")).mapInArrow(make, "id long, fp long")


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that connect what is within the radius: a breadth-first forest, each fingerprint reached once."""
    left, edges = np.unique(fps), []
    while len(left):
        ball, left = left[:1], left[1:]
        while len(ball) and len(left):
            head, ball = ball[0], ball[1:]
            near = np.bitwise_count((left ^ head).view(np.uint64)) <= radius
            edges += [(int(head), int(x)) for x in left[near]]
            ball, left = np.concatenate([ball, left[near]]), left[~near]
    return edges


def links(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(u, v): enough pairs of fingerprints within the radius to connect all that such pairs connect.

    distinct: fp, each value once, none null; other columns don't matter; no rows give no links. Buckets of one fingerprint go first, by a count that Spark combines before it
    shuffles. A bucket of more than `block` is split by hash into blocks, and each pair of blocks is compared by
    itself, so no task holds more than about two blocks of one bucket. Within a group a breadth-first forest is given,
    not all pairs.
    """
    tables = F.array(*(F.struct(F.lit(i).alias("no"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("key")) for i, m in enumerate(masks(radius))))
    keyed = distinct.select("fp", F.explode(tables).alias("t")).select("fp", "t.no", "t.key")
    shared = keyed.groupBy("no", "key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int")
    grouped = (
        keyed.join(shared, ["no", "key"])
        .withColumn("blocks", blocks)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("fp", F.xxhash64("no", "key", F.least("own", "other"), F.greatest("own", "other")).alias("g"))
    )

    def compare(batches):
        rest_g, rest_f = np.empty(0, np.int64), np.empty(0, np.int64)

        def told(g, f):
            cuts = np.flatnonzero(np.r_[True, g[1:] != g[:-1], True]) if len(g) else [0]
            edges = [e for a, z in zip(cuts[:-1], cuts[1:], strict=True) if z - a > 1 for e in _forest(f[a:z], radius)]
            return pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], ["u", "v"])

        for b in batches:
            g, f = np.concatenate([rest_g, b["g"].to_numpy()]), np.concatenate([rest_f, b["fp"].to_numpy()])
            if not len(g):
                continue
            last = np.searchsorted(g, g[-1])  # the last group may go on
            yield told(g[:last], f[:last])
            rest_g, rest_f = g[last:], f[last:]
        yield told(rest_g, rest_f)

    return grouped.repartition("g").sortWithinPartitions("g").mapInArrow(compare, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """One row for every row of docs: id, fp (signed long), component (the smallest id whose fingerprint a chain of
    links reaches, its own included).

    Equal fingerprints are one vertex, so copies are never paired. Documents without words have fingerprint 0 and link
    like any other. Rows with equal ids are one document with several fingerprints in the result, each linked by its
    own; a null id never is a component's name, and a component of null ids alone has none. Very long texts are hashed
    whole, empty tables give empty results. Other columns of docs don't matter, whatever their names.
    """
    all_fps = staged(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle))
    least = staged(all_fps.groupBy("fp").agg(F.min("id").alias("least")))
    found = components(links(least.select("fp"), radius))  # node, root
    names = least.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    component = names.groupBy("root").agg(F.min("least").alias("component"))
    return all_fps.join(names.join(component, "root").select("fp", "component"), "fp")


def as_hex(fp: Column | str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), as_hex("fp").alias("fingerprint"), F.col("component").alias("component_id"))


def _bands(own: np.ndarray) -> list[int]:
    """A key of each band of a set's least hashes."""
    rng = np.random.default_rng(11)
    mix, odd = (rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64)[:, None] * np.uint64(2) + np.uint64(1) for _ in range(2))
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(own), 1 << 13):
        x = (own[None, at : at + (1 << 13)] ^ mix) * odd
        x = (x ^ (x >> np.uint64(32))) * mix
        least = np.minimum(least, x.min(1))
    return [xxhash.xxh64_intdigest(least[i * ROWS : (i + 1) * ROWS].tobytes(), i) for i in range(BANDS)]


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """The text's different shingles, in order, by 40 bits of their hashes: two sets of 2,000 that have no shingle in common
    seem to have one with a chance of 4 in a million."""
    return np.unique(shingles(text, shingle) >> np.uint64(24))


def _pack5(own: np.ndarray) -> bytes:
    return own.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpack5(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.reshape(-1).view("<u8")


def _spread(own: np.ndarray) -> np.ndarray:
    """64 bits of each of a set's 40-bit hashes."""
    x = (own + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(29))


def _name(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes())


def signatures(rows: DataFrame, shingle: int) -> DataFrame:
    """(id, tk, v, fp, keys) of rows (id, tk, t): a name of the text's set of shingles, the set's fingerprint and its bands' keys."""

    def make(batches):
        for b in slices(batches, AT_ONCE):
            own = [shingle_set(t, shingle) for t in b["t"].to_pylist()]
            fps = np.array([simhash(_spread(x)) for x in own], np.uint64).view(np.int64)
            name = np.array([_name(x) for x in own], np.uint64).view(np.int64)
            keys = np.array([_bands(x) for x in own], np.uint64).reshape(-1).view(np.int64)
            held = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * BANDS, pa.int32()), pa.array(keys, pa.int64()))
            yield pa.RecordBatch.from_arrays([b["id"], b["tk"], pa.array(name, pa.int64()), pa.array(fps, pa.int64()), held], ["id", "tk", "v", "fp", "keys"])

    return rows.mapInArrow(make, "id long, tk long, v long, fp long, keys array<long>")


def sets_of(rows: DataFrame, shingle: int) -> DataFrame:
    """(v, h): the sets themselves of rows (id, tk, t), each once."""

    def make(batches):
        for b in slices(batches, AT_ONCE):
            own = [shingle_set(t, shingle) for t in b["t"].to_pylist()]
            name = np.array([_name(x) for x in own], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(name, pa.int64()), pa.array([_pack5(x) for x in own], pa.binary())], ["v", "h"])

    return rows.mapInArrow(make, "v long, h binary").dropDuplicates(["v"])


def _alike(pairs: DataFrame, sets: DataFrame, alike: float) -> DataFrame:
    """The pairs (u, v) whose sets have the similarity, each pair counted exactly."""

    def confirm(batches):
        for b in batches:
            ok = []
            for x, y in zip(b["a"].to_pylist(), b["b"].to_pylist(), strict=True):
                x, y = _unpack5(x), _unpack5(y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= alike * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([b["u"], b["v"]], ["u", "v"]).filter(pa.array(ok, pa.bool_()))

    one = sets.select(F.col("v").alias("u"), F.col("h").alias("a"))
    two = sets.select("v", F.col("h").alias("b"))
    sized = F.least(F.length("a"), F.length("b")) >= alike * F.greatest(F.length("a"), F.length("b")) - 1e-6
    return pairs.distinct().join(one, "u").join(two, "v").where(sized).select("u", "v", "a", "b").mapInArrow(confirm, "u long, v long")


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many members each two sets share: by products of rows for what many of them have, by pairs for the rest."""
    n, size = len(sets), np.array([len(x) for x in sets])
    out, row = np.zeros((n, n), np.float32), np.repeat(np.arange(n), size)
    _, back, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = times > 32
    number = np.cumsum(often) - 1
    some = often[back]
    col, who = number[back[some]], row[some]
    for at in range(0, int(often.sum()), 2048):
        here = (col >= at) & (col < at + 2048)
        x = np.zeros((n, 2048), np.float32)
        x[who[here], col[here] - at] = 1
        out += x @ x.T
    order = np.argsort(back, kind="stable")
    starts = np.cumsum(times) - times
    for k in range(2, 33):
        if len(first := starts[times == k]):
            for at in range(0, len(first), step := max(1, CELLS // (k * k))):
                lists = row[order[first[at : at + step, None] + np.arange(k)]]
                out += np.bincount((lists[:, :, None] * n + lists[:, None, :]).ravel(), minlength=n * n).reshape(n, n)
    np.fill_diagonal(out, size)
    return out


def joining(v: np.ndarray, root: np.ndarray, sets: list[np.ndarray], alike: float) -> list[tuple[int, int]]:
    """Enough pairs with the similarity to join all components that such pairs join."""
    both, size = common_counts(sets), np.array([len(x) for x in sets])
    near = both >= alike * (size[:, None] + size[None] - both) - 1e-9
    label, edges = np.unique(root, return_inverse=True)[1], []
    for i in range(len(v)):
        other = np.flatnonzero(near[i] & (label != label[i]))
        for j in other[np.unique(label[other], return_index=True)[1]]:
            edges.append((int(v[i]), int(v[j])))
            label[label == label[j]] = label[i]
    return edges


def _joined(members: DataFrame, sets: DataFrame, alike: float) -> DataFrame:
    """(u, v): pairs with the similarity that join members (key, v, root) of one bucket whose roots differ. A large bucket
    is split into blocks, and each pair of blocks is compared by itself; only what joins comes out, not all pairs."""
    held = members.join(sets, "v")
    size = held.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / TOGETHER, F.sum(F.length("h")) / TOGETHER_BYTES)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("v", F.lit(5)), F.col("blocks")).cast("int")
    dealt = held.join(size, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("g"), "v", "root", "h")

    def compare(batches):
        rest = None

        def told(t):
            g, edges = t["g"].to_numpy(), []
            cuts = np.flatnonzero(np.r_[True, g[1:] != g[:-1], True]) if len(g) else [0]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                part = t.slice(a, z - a)
                v, first = np.unique(part["v"].to_numpy(), return_index=True)
                root = part["root"].to_numpy()[first]
                if len(np.unique(root)) > 1:
                    hashes = part["h"].to_pylist()
                    edges += joining(v, root, [_unpack5(hashes[i]) for i in first], alike)
            return pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], ["u", "v"])

        for b in batches:
            t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            g = t["g"].to_numpy()
            last = int(np.searchsorted(g, g[-1])) if len(g) else 0  # the last group may go on
            yield told(t.slice(0, last))
            rest = t.slice(last)
        if rest is not None:
            yield told(rest)

    return dealt.repartition("g").sortWithinPartitions("g").mapInArrow(compare, "u long, v long").distinct()


def proposed(vertices: DataFrame, radius: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """Of sets' names and fingerprints (v, fp): (key, v) of the groups that fingerprints within the radius link, of two sets or
    more, and (u, v) of the links, each between the least names of two fingerprints, and of the sets of equal ones."""
    least = vertices.groupBy("fp").agg(F.min("v").alias("v"))
    near = staged(links(least.select("fp"), radius))
    ends = near.join(least.toDF("u", "a"), "u").join(least.toDF("v", "b"), "v").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    equal = vertices.join(least.withColumnRenamed("v", "u"), "fp").where("u != v").select("u", "v")
    roots = components(near).toDF("fp", "root")
    groups = vertices.join(roots, "fp", "left").select(F.xxhash64(F.lit("simhash"), F.coalesce("root", "fp")).alias("key"), "v")
    several = groups.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    return groups.join(several, "key"), ends.unionByName(equal).where("u != v").distinct()


def near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, alike: float = ALIKE) -> DataFrame:
    """One row for every row of docs: id and component (the smallest id that a chain of documents reaches, each with a
    Jaccard similarity of `alike` or more to the next).

    Equal sets are one vertex, so copies are never paired. Candidates are vertices that share a bucket: first the groups that
    SimHash fingerprints within RADIUS bits link, found by covering masks, whose links are compared as they are; then, as sets
    of similarity 0.8 mostly differ in more bits than masks can cover, bands of least hashes. A bucket's members are
    compared with one of them, which makes a star of a group of near copies; then, in buckets whose members
    are still apart, blocks of members against blocks. Every link is confirmed on the whole sets. Fingerprints miss no pair
    within the radius; beyond it, bounds of recall are the bands'. Sets are made again for those vertices alone that share a bucket. Null and blank texts have the empty
    set, and are copies of each other; very long texts count whole. A null id never names a component, and a component
    of null ids alone has none. Repeated rows have a row each. An empty table gives an empty result.
    """
    rows = docs.select(quoted(id_col).cast("long").alias("id"), octets(quoted(text_col)).alias("t")).select("id", F.xxhash64("t").alias("tk"), "t")
    full = staged(signatures(rows, shingle))
    keyed = full.select("v", F.explode("keys").alias("key")).distinct()
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    groups, near = proposed(staged(full.select("v", "fp").distinct()))
    members = staged(keyed.join(shared, "key").unionByName(groups))
    one = full.join(members.select("v").distinct(), "v", "left_semi").groupBy("v").agg(F.min(F.struct("id", "tk")).alias("x")).select("x.id", "x.tk")
    asked = one.select(F.col("id").alias("_i"), F.col("tk").alias("_k")).distinct()
    sets = staged(sets_of(rows.join(asked, rows["id"].eqNullSafe(F.col("_i")) & (rows["tk"] == F.col("_k")), "left_semi"), shingle), "none")
    center = members.groupBy("key").agg(F.min_by("v", F.xxhash64("v")).alias("u"))
    met = members.join(center, "key").where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    stars = staged(_alike(met.unionByName(near), sets, alike))
    named = members.join(components(stars).withColumnRenamed("node", "v"), "v", "left").withColumn("root", F.coalesce("root", "v"))
    apart = named.groupBy("key").agg((F.min("root") != F.max("root")).alias("apart")).where("apart").select("key")
    more = _joined(named.join(apart, "key", "left_semi"), sets, alike)
    found = components(stars.unionByName(more)).withColumnRenamed("node", "v")
    names = full.select("id", "v").join(found, "v", "left").withColumn("root", F.coalesce("root", "v"))
    least = names.groupBy("root").agg(F.min("id").alias("component"))
    return names.select("id", "root").join(least, "root").select("id", "component")


def stage_simhash(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8), the document with the smallest doc_id; documents
    without an id stay. Of repeated rows with the kept id all stay. Null and empty texts are copies of each other. Other
    columns are as they were, whatever their names. An empty table gives an empty one."""
    kept = near_copies(docs).where("id = component").select("id").distinct()
    return docs.join(kept, docs.doc_id == kept.id, "left_semi").unionByName(docs.where("doc_id is null"))
