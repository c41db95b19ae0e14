"""Flat files of records as a data source of Spark: partitions are ranges of bytes, and a record belongs to the range in
which it begins, whose task reads on to its end. So a file is cut anywhere, and no record is lost, doubled or joined to another.

Records come as text with the reason, if any, not to take them; fields are read from the text by column expressions, of
which Spark leaves out what a query does not use.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.fs as pfs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import fasta_fields, genbank_fields

#: How a record begins, at the start of a line, and the line that ends it, if one does.
KINDS = {"fasta": (b">", None), "genbank": (b"LOCUS", b"//")}
#: Bytes of a partition, and of what is read at once.
SPLIT, READ = 64 << 20, 1 << 20
PACKED = {"gz": "gzip", "bgz": "gzip", "bz2": "bz2", "zst": "zstd"}
SCHEMA = "file string, offset long, record string, reject_reason string"


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int | None):
        self.path, self.start, self.end = path, start, end


def _split(uri: str) -> tuple[pfs.FileSystem, str]:
    return pfs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def spans(chunks, mark: bytes, start: int, end: int | None):
    """(offset, bytes) of every record that begins at or after `start` and before `end`. chunks: the file's bytes from the
    one before `start` on, or from `start` where it is 0. What stands before the first record of a file is one too, if not blank."""
    held, at, begun = (b"\n" if start == 0 else b""), start - 1, None  # at: the place of held's first byte
    sign, done = b"\n" + mark, False
    for chunk in chunks:
        look = max(0, len(held) - len(sign))  # a sign may lie across two chunks
        held += chunk
        while (i := held.find(sign, look)) >= 0:
            place = at + i + 1
            if begun is None and start == 0 and held[: i + 1].strip():
                yield 0, held[1 : i + 1]
            elif begun is not None:
                yield begun, held[: i + 1]
            held, at, look = held[i + 1 :], place, 0
            if end is not None and place >= end:
                done = True
                break
            begun = place
        if done:
            return
        if begun is None and end is not None and at + len(held) - len(sign) >= end and start != 0:
            return  # no record begins here
        if begun is None and start != 0:
            at, held = at + max(0, len(held) - len(sign)), held[max(0, len(held) - len(sign)) :]
    if begun is not None:
        yield begun, held
    elif start == 0 and held.strip():
        yield 0, held[1:]


def reason(record: bytes, kind: str) -> str | None:
    """Why a record is none: stray, encoding, header, sequence (FASTA), accession, end (GenBank); else null."""
    mark, last = KINDS[kind]
    if not record.startswith(mark):
        return "stray"
    try:
        text = record.decode()
    except UnicodeDecodeError:
        return "encoding"
    if kind == "fasta":
        head, _, rest = text[1:].partition("\n")
        return "header" if not head.strip() else "sequence" if not rest.strip() else None
    lines = text.splitlines()
    if not any(x.startswith("ACCESSION") and x[9:].strip() for x in lines):
        return "accession"
    return None if any(x.rstrip() == last.decode() for x in lines) else "end"


class RecordReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.kind, self.size = options["path"], options.get("kind", "fasta"), int(options.get("split", SPLIT))
        if self.kind not in KINDS or self.size < 1:
            raise ValueError(f"the kind is {' or '.join(KINDS)}, and split at least a byte")

    def partitions(self) -> list[Range]:
        fs, path = _split(self.path)
        info = fs.get_file_info(path)
        if info.type == pfs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.type == pfs.FileType.File else sorted((x for x in fs.get_file_info(pfs.FileSelector(path, recursive=True)) if x.type == pfs.FileType.File and not x.base_name.startswith((".", "_"))), key=lambda x: x.path)
        out = []
        for f in files:
            if f.extension in PACKED:  # has to be read from its beginning
                out.append(Range(f.path, 0, None))
            else:
                out += [Range(f.path, a, min(a + self.size, f.size)) for a in range(0, f.size, self.size)]
        return out

    def read(self, part: Range):
        fs, _ = _split(self.path)
        if part.end is None:
            stream = fs.open_input_stream(part.path, compression=PACKED[part.path.rsplit(".", 1)[-1]])
        else:
            stream = fs.open_input_file(part.path)
            stream.seek(max(0, part.start - 1))
        name, rows, size = part.path.rsplit("/", 1)[-1], [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], ["file", "offset", "record", "reject_reason"])

        with stream:
            for offset, record in spans(iter(lambda: stream.read(READ), b""), KINDS[self.kind][0], part.start, part.end):
                rows.append((name, offset, record.decode(errors="replace"), reason(record, self.kind)))
                size += len(record)
                if size > READ:
                    yield batch()
                    rows, size = [], 0
            if rows:
                yield batch()


class Records(DataSource):
    """Options: kind (fasta or genbank), split (bytes of a partition). The path is a file or a folder; hidden files are passed
    over, and packed ones (gz, bgz, bz2, zst) are a partition each."""

    @classmethod
    def name(cls) -> str:
        return "sequence-records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RecordReader:
        return RecordReader(self.options)


def records(spark: SparkSession, path: str, kind: str, split: int = SPLIT) -> DataFrame:
    """(file, offset, record, reject_reason) of every record, good or bad."""
    spark.dataSource.register(Records)
    return spark.read.format(Records.name()).option("kind", kind).option("split", split).load(path)


def fasta_records(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """(file, header, seq, offset, reject_reason); files.split_rejects() tells good from bad."""
    return fasta_fields(records(spark, path, "fasta", split), "record", "offset", "reject_reason")


def genbank_records(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """As files.genbank() has it, with offset and reject_reason."""
    return genbank_fields(records(spark, path, "genbank", split), "record", "offset", "reject_reason")
