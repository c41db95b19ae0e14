"""Shared helpers: reading tables, durable stages, columns carried along, and the word rules of the contracts."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Rows of an Arrow batch, where the session has Spark's own number, 10,000: a batch of whole texts is in memory several
#: times over, in Spark and in Python.
BATCH = 2_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which every executor reaches. Where none is set, a local session, whose tasks
    run in this process, has one of this machine's own; any other is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def passing(spark: SparkSession, path: str) -> str:
    """path, whose files go when the session's JVM ends."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def staged(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """df, written once as Parquet into the shared folder and read again: its lineage ends there, and a lost executor
    costs a re-read. The files go when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(passing(spark, path))


def octets(text: Column | str) -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def slices(batches, most: int, column: int | str = -1):
    """The batches in slices of about `most` bytes of the texts in a column."""
    for b in batches:
        texts = b.column(b.num_columns - 1 if column == -1 else column)
        place = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // most
        cuts = [*np.flatnonzero(np.diff(np.r_[-1, place])).tolist(), b.num_rows]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            yield b.slice(a, z - a)


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def kept(keep) -> Column:
    """The columns that go along with a row, in one struct, so that their names meet no others."""
    return F.struct(*(quoted(c) for c in keep)).alias("kept")


def beside(rows: DataFrame, results: str, work, most: int = 1 << 21) -> DataFrame:
    """All columns of rows but the last, which is a text, and the results that `work` makes of lists of texts: a list for
    each result. Texts come in slices of about `most` bytes, so a task holds one slice's results."""
    made, held = T._parse_datatype_string(results), rows.columns[:-1]
    kinds = [arrow_type(f.dataType) for f in made]

    def run(batches):
        for b in slices(batches, most):
            out = work(b.column(b.num_columns - 1).to_pylist())
            cells = [x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cells], [*held, *made.names])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], *made]))


def arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def unpacked(df: DataFrame, results) -> DataFrame:
    """The kept columns and then the results. A kept column that has a result's name comes back as kept_<name>."""
    taken = {r.lower() for r in results}
    names = [f.name for f in df.schema["kept"].dataType]
    return df.select(*(F.col("kept").getField(c).alias(f"kept_{c}" if c.lower() in taken else c) for c in names), *(quoted(r) for r in results))


def _table(separators) -> bytes:
    lower = {c: c + 32 for c in range(65, 91)}
    return bytes(32 if c in separators else lower.get(c, c) for c in range(256))


#: Lower-cases A-Z and turns every byte that is not part of a word into a space.
ALNUM = _table([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
#: The same, where only ASCII white space separates words.
SPACED = _table([0x20, *range(0x09, 0x0E)])
