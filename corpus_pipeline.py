"""The corpus pipeline: each stage takes (spark, docs, sf_dir), works on all that the one before kept, and gives the
columns of documents; the last gives token ids. Each result is written as Parquet into the shared folder, where it stays
until the session ends, and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from seqloom.llm.bpe import stage_bpe
from seqloom.llm.common import passing, read, shared_dir
from seqloom.llm.decontaminate import stage_decontaminate
from seqloom.llm.kneser_ney import stage_quality
from seqloom.llm.pii import stage_pii
from seqloom.llm.simhash import stage_simhash

STAGES = [
    ("quality classifier", stage_quality),
    ("SimHash near-dedup", stage_simhash),
    ("benchmark decontamination", stage_decontaminate),
    ("PII", stage_pii),
    ("byte-level BPE encoding and decoding", stage_bpe),
]

#: The model's arithmetic, components, regular expressions with checksums and BPE are beyond SQL; tests/llm holds
#: each stage against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs, at = read(spark, sf_dir, "documents"), passing(spark, f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
    return docs
