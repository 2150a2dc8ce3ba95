"""What the text operators share: ASCII folding, Arrow batches as bytes, row tags."""

from __future__ import annotations

import string
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the decontamination and licence operators: digits, a-z, all beyond ASCII.
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: White space that line keys and shingle words are cut at.
BLANKS = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(col: Column) -> Column:
    """A-Z to a-z, all else as it is."""
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


def texts_of(batch: pa.RecordBatch, column: int) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    return pc.cast(batch.column(column), pa.large_binary()).to_pylist()


def batches(rows: Iterator[pa.RecordBatch], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` bytes, so that a task's Python lists stay small."""
    for batch in rows:
        step = max(1, int(batch.num_rows * most / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
