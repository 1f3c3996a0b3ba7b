"""Helpers that every operator of this subpackage shares.

Conventions, valid for all operators here:

* Input columns are picked by name and renamed at once, so extra columns, whatever
  they are called, can't clash with the operator's own.
* A null text counts as an empty text. Rows are never dropped because a column is null.
* Repeated rows are separate rows: each gets its own result row.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a numpy kernel works on at once; one longer text is worked on alone. A kernel
#: takes some 50 times these bytes, so a task's memory is that of the slice or of its longest text.
SLICE_BYTES = 256 << 10
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else one in the warehouse, which they share too."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_written").rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there, and an executor's
    loss costs no recomputation of what came before. The files stay until clear()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/recordloom/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Remove what stored() wrote so far; results that were not fetched yet can't be fetched after it."""
    while _written:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(name: str) -> str:
    """A column name that no table has."""
    return f"{name}_{uuid.uuid4().hex}"


def picked(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and text (null: empty) alone."""
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and key. Rows of one key have the same id and the same text, thus the same results."""
    one = picked(df, id_col, text_col)
    return one.withColumn("key", F.md5(F.concat_ws("\x00", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("text"))))


def offsets(column: pa.Array) -> np.ndarray:
    """The n + 1 byte offsets of a string column."""
    if not len(column):
        return np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    return np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in row order, in slices of at most limit bytes of text (or of one row)."""
    ends = offsets(batch.column(column))
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1)
        yield batch.slice(at, upto - at)
        at = upto


def mapped(df: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, column: str = "text") -> DataFrame:
    """mapInArrow of a kernel over bounded slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, column):
                yield kernel(part)

    return df.mapInArrow(run, schema)


def sorted_join(values: Column) -> Column:
    """Distinct strings of an array, sorted and comma-joined."""
    return F.array_join(F.array_sort(F.array_distinct(values)), ",")


def bitmap(values: DataFrame, column: str, n: int, each: int, least: int, most: int) -> bytes:
    """Bits of a column of longs, each bits for each of its n values, from least to most bits in all; at most
    most / 64 numbers reach the driver, whatever n is."""
    size = min(most, max(least, 1 << (each * n).bit_length()))
    at, v = F.expr(f"cast(pmod({column}, {size}) / 64 as int)"), F.expr(f"shiftleft(1L, cast(pmod({column}, {size}) % 64 as int))")
    rows = values.select(at.alias("at"), v.alias("v")).groupBy("at").agg(F.bit_or("v").alias("v")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[rows["at"].to_numpy()] = rows["v"].to_numpy()
    return out.tobytes()


def marked(values: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which 64-bit values have their bit in a bitmap."""
    at = (values & np.uint64(64 * len(bits) - 1)).astype(np.int64)
    return (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
