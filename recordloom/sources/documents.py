"""Documents from files and from bytes: doc_id, path, content (binary, decompressed)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"


def inflated(content: bytes) -> bytes:
    """content, decompressed if it starts like a zstd frame. Raises XmlError of kind Io."""
    if content[:4] != ZSTD_MAGIC:
        return content
    import zstandard

    from ..functions.errors import XmlError

    out = []
    try:
        while content:
            frame = zstandard.ZstdDecompressor().decompressobj()
            out.append(frame.decompress(content))
            if not frame.eof:
                raise XmlError("Io", cause="the compressed data end early")
            content = frame.unused_data
    except zstandard.ZstdError as e:
        raise XmlError("Io", cause=str(e)) from None
    return b"".join(out)


def read_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row a file: doc_id (hash of the path), path, content. Compressed files are told by their first bytes, when they are scanned."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", "content")


def from_bytes(spark: SparkSession, documents: list[bytes | str]) -> DataFrame:
    """doc_id by position, and content."""
    rows = [(i, d.encode() if isinstance(d, str) else d) for i, d in enumerate(documents)]
    return spark.createDataFrame(rows, "doc_id long, content binary")


def from_column(df: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """doc_id and content of any table with a string or binary column."""
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{content_col}`").cast("binary").alias("content"))


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, bytes]]:
    """(doc_id, content) of Arrow batches; a null content is an empty document."""
    for batch in batches:
        for i, c in zip(batch.column("doc_id").to_pylist(), batch.column("content"), strict=True):
            yield i, c.as_py() or b""
