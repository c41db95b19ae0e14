"""Merkle fixity audit of WARC replicas.

Records lie in files at ordered offsets. Each record's digest is a leaf; a node covers FANOUT consecutive leaves or
nodes, an ordered range of offsets, up to one root a file. An audit compares roots, and level by level looks only at the
children of nodes that differ, down to the records.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import quoted, read, staged

#: FANOUT ** LEVELS records to a file.
FANOUT, LEVELS = 16, 3


def record(url: Column, name: Column, body: Column) -> Column:
    """A WARC resource record as text; nulls count as empty."""
    url, body = F.coalesce(url, F.lit("")), F.coalesce(body, F.lit(""))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), url, F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(name.cast("string"), F.lit("none")))
    return F.concat(head, F.lit(">\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def archive(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """The manifest (id, file, ordinal, offset, length, digest) of the pages' records, written to files of
    fanout ** levels consecutive ids each, ordered by id, then digest. Rows with equal ids are records of their own.
    Rows with a null id are dealt by digest to files below 0. Null addresses and bodies count as empty, very long bodies
    whole; an empty table gives an empty manifest. Other columns of pages don't matter, whatever their names."""
    per = fanout**levels
    text = record(F.col(url_col), F.col(id_col), F.col(body_col))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), text.alias("_r")).select("id", F.octet_length("_r").cast("long").alias("length"), F.sha2("_r", 256).alias("digest"))
    rows = rows.withColumn("file", F.coalesce(F.floor(F.col("id") / F.lit(per)), -1 - F.pmod(F.xxhash64("digest"), F.lit(per))).cast("long"))
    order = W.partitionBy("file").orderBy("id", "digest")
    upto = F.sum("length").over(order.rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("ordinal", (F.row_number().over(order) - 1).cast("long")).withColumn("offset", upto - F.col("length")).select("id", "file", "ordinal", "offset", "length", "digest")


def write_warc(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", fanout: int = FANOUT, levels: int = LEVELS) -> None:
    """The records as uncompressed WARC files, path/file=<file>/part-*, in the order and at the offsets that archive() tells of them, through
    Spark's text writer: a line's end is the second of the two that end a record. A task streams one file after another
    and holds none whole. Nulls, repeated rows, long bodies and other columns as in archive(); an empty table gives no files."""
    per = fanout**levels
    text = record(quoted(url_col), quoted(id_col), quoted(body_col))
    rows = pages.select(quoted(id_col).cast("long").alias("id"), text.alias("r")).withColumn("digest", F.sha2("r", 256))
    rows = rows.withColumn("file", F.coalesce(F.floor(F.col("id") / F.lit(per)), -1 - F.pmod(F.xxhash64("digest"), F.lit(per))).cast("long"))
    lines = rows.repartition("file").sortWithinPartitions("file", "id", "digest").select("file", F.left("r", F.length("r") - 2).alias("value"))
    lines.write.partitionBy("file").option("lineSep", "\r\n").text(path)


def _parents(nodes: DataFrame, fanout: int) -> DataFrame:
    """(file, node, offset, length, digest) of one level up. A node has at most `fanout` children, so its list is short."""
    child = F.struct("node", F.concat_ws(":", F.col("offset").cast("string"), F.col("length").cast("string"), "digest").alias("told"))
    up = nodes.groupBy("file", F.floor(F.col("node") / F.lit(fanout)).cast("long").alias("node")).agg(F.min("offset").alias("offset"), (F.max(F.col("offset") + F.col("length")) - F.min("offset")).alias("length"), F.array_sort(F.collect_list(child)).alias("c"))
    return up.select("file", "node", "offset", "length", F.sha2(F.array_join(F.transform("c", lambda c: c["told"]), ","), 256).alias("digest"))


def tree(manifest: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> list[DataFrame]:
    """Level by level from the records to the roots; a file of more records has more levels' worth under one root."""
    out = [manifest.select("file", F.col("ordinal").alias("node"), "offset", "length", "digest")]
    for _ in range(levels):
        out.append(staged(_parents(out[-1], fanout)))
    return out


def audit(first: DataFrame, second: DataFrame, *, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """Where two replicas' manifests differ: file, ordinal, first_offset, first_length, second_offset, second_length,
    status (altered, moved, missing, extra; as seen from the first).

    Roots are compared for all files, lower levels only under nodes that differ. Equal replicas, and two empty ones,
    give no rows; a record of only one side is missing or extra. Manifests come from archive(), or any table of
    (file, ordinal, offset, length, digest) in which an ordinal occurs once a file.
    """
    one, two = tree(first, fanout, levels), tree(second, fanout, levels)
    key, odd = ["file", "node"], None
    for level in range(levels, -1, -1):
        a, b = one[level], two[level]
        if odd is not None:
            within = odd.select("file", F.col("node").alias("parent"))
            a, b = (x.withColumn("parent", F.floor(F.col("node") / F.lit(fanout)).cast("long")).join(within, ["file", "parent"], "left_semi").drop("parent") for x in (a, b))
        a = a.select(*key, *(F.col(c).alias(f"first_{c}") for c in ("offset", "length", "digest")))
        b = b.select(*key, *(F.col(c).alias(f"second_{c}") for c in ("offset", "length", "digest")))
        same = reduce(lambda x, y: x & y, (F.col(f"first_{c}").eqNullSafe(F.col(f"second_{c}")) for c in ("offset", "length", "digest")))
        odd = a.join(b, key, "full").where(~same)
        if level:
            odd = staged(odd.select(*key))
    status = F.when(F.col("second_digest").isNull(), "missing").when(F.col("first_digest").isNull(), "extra").when(F.col("first_digest") != F.col("second_digest"), "altered").otherwise("moved")
    return odd.select("file", F.col("node").alias("ordinal"), "first_offset", "first_length", "second_offset", "second_length", status.alias("status"))


def decayed(pages: DataFrame) -> DataFrame:
    """A replica with faults by rule: of pages whose id leaves 13 by 97 the body's first character is lost and an x put
    at its end, of those that leave 5 by 89 the address's last character becomes an x."""
    body = F.coalesce("html", F.lit(""))
    return pages.withColumn("html", F.when(F.col("page_id") % 97 == 13, F.concat(F.expr("substring(coalesce(html, ''), 2)"), F.lit("x"))).otherwise(body)).withColumn("url", F.when(F.col("page_id") % 89 == 5, F.concat(F.expr("left(url, length(url) - 1)"), F.lit("x"))).otherwise(F.col("url")))


def op10_warc_fixity(spark, sf_dir: str) -> DataFrame:
    """Every record's place, and what the audit of its replica found there."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    first, second = staged(archive(pages)), staged(archive(decayed(pages)))
    found = audit(first, second).select("file", "ordinal", "status")
    return first.join(found, ["file", "ordinal"], "left").select(F.col("id").alias("page_id"), "file", "ordinal", "offset", "length", "digest", F.coalesce("status", F.lit("same")).alias("status"))


OP10_SQL = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, CASE WHEN page_id % 97 = 13 THEN coalesce(html, '')[2:] || 'x' ELSE coalesce(html, '') END AS html2, CASE WHEN page_id % 89 = 5 THEN left(url, length(url) - 1) || 'x' ELSE url END AS url2 FROM pages),
r AS (SELECT page_id, page_id // 4096 AS file,
  'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS a,
  'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url2 || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html2) || chr(13) || chr(10) || chr(13) || chr(10) || html2 || chr(13) || chr(10) || chr(13) || chr(10) AS b FROM p),
o AS (SELECT *, sum(strlen(a)) OVER w - strlen(a) AS oa, sum(strlen(b)) OVER w - strlen(b) AS ob, row_number() OVER w - 1 AS ordinal FROM r WINDOW w AS (PARTITION BY file ORDER BY page_id))
SELECT page_id, CAST(file AS BIGINT) AS file, CAST(ordinal AS BIGINT) AS ordinal, CAST(oa AS BIGINT) AS "offset", CAST(strlen(a) AS BIGINT) AS length, sha256(a) AS digest,
  CASE WHEN a <> b THEN 'altered' WHEN oa <> ob THEN 'moved' ELSE 'same' END AS status FROM o
"""
