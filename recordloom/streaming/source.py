"""Records with bounded memory: a Python data source that frames files while it reads them, as a table
or as a stream.

Paths may have a scheme that Arrow's file systems know (file, hdfs, s3, gs); others are read by
read_documents(), which is Spark's own. A file is one task, since where a record begins isn't known
before all that stands before it is framed; work grows with the number of files."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from ..functions.framing import Framer
from ..operators.apply import for_each
from ..plans.options import XmlOptions
from ..sources.documents import ZSTD_MAGIC

CHUNK, BATCH = 64 << 10, 256
_SCHEMA = "path string, rec_index long, start long, end long, xml string, entities map<string,string>, namespaces map<string,string>"
_MAP = pa.map_(pa.string(), pa.string())


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def files_of(path: str) -> list[fs.FileInfo]:
    """Files under a folder, at any depth, or the file itself; hidden ones (., _) aside; by name."""
    system, at = located(path)
    info = system.get_file_info(at)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
    hidden = lambda f: any(p.startswith(("_", ".")) for p in f.path[len(at) :].split("/") if p)
    return sorted((f for f in found if f.type == fs.FileType.File and not hidden(f)), key=lambda f: f.path)


def chunked(path: str, chunk: int = CHUNK, base: str = "") -> Iterator[bytes]:
    """A file in chunks, decompressed on the way if it starts like a zstd frame; base: a path of its file system."""
    system = located(base)[0] if base else located(path)[0]
    path = path if base else located(path)[1]
    with system.open_input_stream(path, compression=None) as first:
        head = first.read(4)
    with system.open_input_stream(path, compression=None) as source:
        if head == ZSTD_MAGIC:
            import zstandard

            source = zstandard.ZstdDecompressor().stream_reader(source, read_across_frames=True)
        while data := source.read(chunk):
            yield data


def stream_records(chunks: Iterator[bytes], record_path: tuple[str, ...] = (), lenient: bool = True) -> Iterator[tuple[Framer, int, int, int, bytes]]:
    """(framer, index, start, end, bytes) as records close; namespaces are those seen by then."""
    framer = Framer(record_path, lenient)
    for data in chunks:
        framer.push(data)
        for r in framer.take():
            yield (framer, *r)
        if framer.finished and lenient:
            return
    for r in framer.finish():
        yield (framer, *r)


class _Read:
    """What the table and the stream have in common. options: path, recordPath (a/b), chunk (bytes), strict (true or false)."""

    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}
        self.path = self.options["path"]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is None or partition.value is None:  # an empty folder
            return
        path = tuple(x for x in self.options.get("recordpath", "").split("/") if x)
        rows: list[tuple] = []
        chunks = chunked(partition.value, int(self.options.get("chunk", CHUNK)), self.path)
        for framer, i, a, b, x in stream_records(chunks, path, self.options.get("strict", "false").lower() != "true"):
            rows.append((partition.value, i, a, b, x.decode("utf-8", "replace"), list(framer.entities.items()), list(framer.namespaces.items())))
            if len(rows) == BATCH:
                yield self._batch(rows)
                rows = []
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), _MAP, _MAP]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["path", "rec_index", "start", "end", "xml", "entities", "namespaces"])


class _Reader(_Read, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f.path) for f in files_of(self.path)] or [InputPartition(None)]


class _StreamReader(_Read, DataSourceStreamReader):
    """Offsets are times of modification in nanoseconds: a batch has the files changed after the one and up to the other."""

    def initialOffset(self) -> dict:
        return {"changed": 0}

    def latestOffset(self) -> dict:
        return {"changed": max((f.mtime_ns for f in files_of(self.path)), default=0)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [InputPartition(f.path) for f in files_of(self.path) if start["changed"] < f.mtime_ns <= end["changed"]] or [InputPartition(None)]

    def commit(self, end: dict) -> None:
        pass


class XmlRecords(DataSource):
    """spark.read.format("xml_records").option("recordPath", "a/b").load(path), or spark.readStream: one task a file, on a
    path that executors can open."""

    @classmethod
    def name(cls) -> str:
        return "xml_records"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema: object) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))


def register_source(spark: SparkSession) -> None:
    spark.dataSource.register(XmlRecords)


def read_record_stream(spark: SparkSession, path: str, options: XmlOptions = XmlOptions(lenient=True)) -> DataFrame:
    """A streaming DataFrame of the records of files as they arrive in a folder, and doc_id, a hash of the path. Memory is
    bounded by a record, whatever the size of a file; namespaces are those seen before the record ends."""
    register_source(spark)
    source = spark.readStream.format("xml_records").option("recordPath", "/".join(options.record_path)).option("strict", str(not options.lenient))
    return source.load(path).select(F.xxhash64("path").alias("doc_id"), "*")


def stream_for_each(spark: SparkSession, path: str, function: Callable[[Row], None], checkpoint: str, options: XmlOptions = XmlOptions(lenient=True)) -> StreamingQuery:
    """Call a function for every record of the files in a folder and of those that arrive, where the record is, in no order.
    Returns the running query of all files there are now; what was handed over before an error stays handed over."""
    records = read_record_stream(spark, path, options)
    return records.writeStream.foreachBatch(lambda batch, _: for_each(batch, function)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
