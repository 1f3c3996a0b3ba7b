"""Token ids as Parquet list columns that can be read selectively.

Layout: files in ascending document order (range partitions, sorted inside), one row a document:
doc_id, n_tokens, ids. Ids are a list<int32> column, dictionary-encoded (a page falls back to
plain or, under writer version 2, to delta encoding where the dictionary would not pay), in row
groups and pages of set size with page indexes, so a reader of doc_id and n_tokens alone touches
no id page, and a reader of a doc_id range only the pages that the index names.

Defined cases: a null text has the end id alone; null doc_ids come first; rows of equal doc_id
keep the order in which the table is read; an empty table gives an empty table; a text longer than
ENCODE_BYTES is encoded alone, whole.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import picked, shared_dir, text_slices
from .textvec import flat

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
#: Parts of words kept with their ids in each Python worker, and the longest kept. Results don't depend on them.
CACHED, CACHED_BYTES = 500_000, 48
#: Bytes of text encoded at once: the more, the fewer look-ups.
ENCODE_BYTES = 4 << 20
ROW_GROUP_BYTES, PAGE_BYTES = 32 << 20, 256 << 10
#: ASCII marks but the apostrophe, which begins pre-tokens such as 's.
_MARKS = "".join(chr(b) for b in range(0x21, 0x7F) if not chr(b).isalnum() and b != 0x27)
_ONLY_MARKS = re.compile(b"[" + re.escape(_MARKS).encode() + b"]+")
#: Letters of Latin-1 that lower-casing and normal form C leave as they are.
_LETTERS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
#: Last bytes of Latin-1's letters beyond ASCII, all of two bytes and a first one of C3.
_LATIN = np.array([0x80 <= b <= 0xBF and b not in (0x97, 0xB7) for b in range(256)])
_ALNUM = np.array([chr(b).isalnum() and b < 0x80 for b in range(256)])


def _splits_plain_words(spec: dict) -> bool:
    """Whether a vocabulary's rules are known to lower-case A-Z, to cut runs of letters from runs
    of marks, and to leave both as they are otherwise. By other rules every word is encoded whole."""
    norm, pre = spec["normalizer"] or {}, spec["pre_tokenizer"] or {}
    kinds = [x["type"] for x in norm.get("normalizers", [])]
    cuts = pre.get("pretokenizers", [])
    return (
        kinds == ["NFC", "Replace", "Lowercase"]
        and norm["normalizers"][1]["pattern"] == {"Regex": r"\s+"}
        and [x["type"] for x in cuts] == ["Split", "ByteLevel"]
        and cuts[0]["pattern"] == {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
        and not cuts[1]["add_prefix_space"]
        and not cuts[1]["use_regex"]
        and not spec["model"].get("dropout")
    )


def _gathered(table: np.ndarray, size: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of table that index names, one after the other, and the size of each; table: runs of size."""
    start, sizes = np.cumsum(size) - size, size[index]
    shift = np.repeat(start[index] - np.cumsum(sizes) + sizes, sizes)
    shift += np.arange(len(shift), dtype=shift.dtype)
    return table[shift], sizes


class WordBpe:
    """Texts to ids by the tokenizers library, one call for each part of a word not met before.

    The vocabulary's normaliser and pre-tokeniser never join characters over white space, so a
    text's ids are those of its words, in order; and ASCII marks at a word's end are a pre-token
    of their own where a letter or digit stands before them. Words and then their parts are
    numbered by Arrow; only distinct parts are looked up, and ids are gathered by number."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.splits = _splits_plain_words(json.loads(self.tokenizer.to_str()))
        self.letters = dict(enumerate(byte_letters()))
        self.cache: dict[bytes, bytes] = {}

    def _one_pre_token(self, part: bytes) -> bytes | None:
        """part, lower-cased, if it is sure to be one pre-token: marks, or letters of Latin-1."""
        if part.isalpha():
            return part.lower()
        if _ONLY_MARKS.fullmatch(part):
            return part
        try:
            low = part.decode().encode("latin-1").decode("latin-1").lower()
        except UnicodeEncodeError:
            return None
        return low.encode() if _LETTERS.fullmatch(low) else None

    def _new(self, parts: list[bytes]) -> dict[bytes, bytes]:
        """Ids of parts. Of a pre-token the library's model alone has the ids, from its bytes as
        letters, without an Encoding for each."""
        out, direct, tokenize = {}, [], self.tokenizer.model.tokenize
        for p in parts:
            one = self._one_pre_token(p) if self.splits else None
            if one is None:
                direct.append(p)
            else:
                out[p] = array("I", [t.id for t in tokenize(one.decode("latin-1").translate(self.letters))]).tobytes()
        found = self.tokenizer.encode_batch_fast([p.decode() for p in direct], add_special_tokens=False)
        out.update((p, array("I", x.ids).tobytes()) for p, x in zip(direct, found, strict=True))
        return out

    def _looked_up(self, parts: list[bytes]) -> list[bytes]:
        """Ids of distinct parts."""
        ids = list(map(self.cache.get, parts))
        if None in ids:
            found = self._new([p for p, i in zip(parts, ids, strict=True) if i is None])
            ids = [found[p] if i is None else i for p, i in zip(parts, ids, strict=True)]
            if len(self.cache) > CACHED:
                self.cache.clear()
            self.cache.update((p, i) for p, i in found.items() if len(p) <= CACHED_BYTES)
        return ids

    def _parts(self, words: pa.Array) -> pa.Array:
        """Two parts of each word, in turn: what stands before its marks, and the marks; or the word and nothing."""
        if self.splits:  # A-Z is lower-cased anyway, and in ASCII nothing composes
            words = pc.if_else(pc.string_is_ascii(words), pc.ascii_lower(words), words)
        data, at = flat(words)
        cut = at[1:].copy()
        if self.splits and len(data):
            stem = pc.binary_length(pc.ascii_rtrim(words, characters=_MARKS)).to_numpy()
            last, before = data[at[:-1] + np.maximum(stem, 1) - 1], data[at[:-1] + np.maximum(stem, 2) - 2]
            ends = (stem == 0) | _ALNUM[last] | (_LATIN[last] & (before == 0xC3) & (stem > 1))
            cut = np.where(ends, at[:-1] + stem, cut)
        ends = np.zeros(2 * len(words) + 1, np.int32)
        ends[1::2], ends[2::2] = cut, at[1:]
        return pa.Array.from_buffers(pa.binary(), 2 * len(words), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])

    def encode_column(self, texts: pa.Array, end: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with end behind it, and the n + 1 offsets of the texts."""
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        parts = self._parts(words.dictionary).dictionary_encode()
        known = self._looked_up(parts.dictionary.to_numpy(zero_copy_only=False).tolist())
        table, sizes = _gathered(np.frombuffer(b"".join(known), "<u4"), np.fromiter(map(len, known), np.int64, len(known)) // 4, parts.indices.to_numpy())
        table, sizes = np.r_[table, np.array(end, "<u4")], np.r_[sizes.reshape(-1, 2).sum(1), len(end)]
        last = split.offsets.to_numpy()[1:] - split.offsets[0].as_py()
        ids, sizes = _gathered(table, sizes, np.insert(words.indices.to_numpy(), last, len(sizes) - 1))
        return ids, np.r_[0, np.cumsum(sizes)[last + np.arange(len(last))]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        ids, at = self.encode_column(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


@cache
def loaded(vocabulary: str) -> WordBpe:
    """One for each Python worker, for all its tasks. A function of the module is sent by name; a
    dictionary that a task's own function reads would be sent along, new and empty for each task."""
    return WordBpe(vocabulary)


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = END_ID, partitions: int | None = None) -> None:
    """Encode every text, append end_id, and write the files under path.

    One shuffle, of the texts, by range of doc_id; the row number breaks ties, so that no run of
    equal ids has to fit in one task."""
    vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)
    one = picked(docs, id_col, text_col).withColumn("tie", F.monotonically_increasing_id())
    kind = one.schema["doc_id"].dataType.simpleString()
    by = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    dealt = (one.repartitionByRange(partitions, *by) if partitions else one.repartitionByRange(*by)).sortWithinPartitions(*by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)
        for batch in batches:
            for part in text_slices(batch, limit=ENCODE_BYTES):
                ids, at = bpe.encode_column(part.column("text"), (end_id,))
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.view("<i4")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(at)), lists], ["doc_id", "n_tokens", "ids"])

    (
        dealt.drop("tie")
        .mapInArrow(run, f"doc_id {kind}, n_tokens long, ids array<int>")
        .write.option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "true")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.page.row.count.limit", 1000)
        .option("parquet.page.write-checksum.enabled", "true")
        .option("compression", "zstd")
        .parquet(path)
    )


def read(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """doc_id, n_tokens and file, row (their order), with ids only if asked for."""
    found = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    return found if ids else found.drop("ids")


def read_documents(spark: SparkSession, path: str, low: int, high: int, ids: bool = True) -> DataFrame:
    """read() of the documents low <= doc_id <= high: row groups and pages whose bounds are outside aren't read."""
    return read(spark, path, ids).where(F.col("doc_id").between(low, high))


def read_tokens(spark: SparkSession, path: str, low: int, high: int) -> DataFrame:
    """doc_id, start, ids of the tokens low <= place < high of all files in order, cut at both ends: place by place as they
    were written. Sizes of all documents are read, ids of those alone that hold such a place (and of others between
    their doc_ids, where ids are equal or null)."""
    sizes = read(spark, path, ids=False)
    held = offsets(sizes, sizes).where((F.col("start") < high) & (F.col("start") + F.col("n_tokens") > low))
    ends = held.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count_if(F.col("doc_id").isNull()).alias("none")).first()
    found = read(spark, path)
    if not ends["none"]:
        found = found.where(F.col("doc_id").between(ends["low"], ends["high"])) if ends["low"] is not None else found.limit(0)
    begin = F.greatest(F.lit(low) - F.col("start"), F.lit(0))
    end = F.least(F.lit(high) - F.col("start"), F.col("n_tokens"))
    met = found.join(held.select("file", "row", "start"), ["file", "row"])
    return met.select("doc_id", (F.col("start") + begin).alias("start"), F.slice("ids", begin.cast("int") + 1, (end - begin).cast("int")).alias("ids"))


def offsets(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Adds start, the ids before each row in file order: a running sum within each file, and the
    sums of the files before it, of which there is one row a file. sizes: file, n_tokens of the rows."""
    files = sizes.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    # By part number: as text, part-100000 would come before part-99999.
    part = F.regexp_extract("file", r"^part-(\d+)", 1).cast("long")
    before = files.select("file", F.coalesce(F.sum("total").over(Window.orderBy(part, "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("row")) - F.col("n_tokens")
    return rows.withColumn("inside", inside).join(before, "file").withColumn("start", F.col("before") + F.col("inside")).drop("inside", "before")


def index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    rows = read(spark, path)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            at, flat = np.asarray(lists.offsets), np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<u4"))
            view = memoryview(flat).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_tokens"), batch.column("file"), batch.column("row"), pa.array(crc, pa.int64())], ["doc_id", "n_tokens", "file", "row", "ids_crc32"])

    found = rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, file string, row long, ids_crc32 long")
    # The sums of files read no ids.
    return offsets(found, read(spark, path, ids=False)).select("doc_id", "start", "n_tokens", "ids_crc32")


def encode_to_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, **options: object) -> DataFrame:
    """write() and then index() of what was written; path: by default a new one in the shared folder."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/recordloom/tokens-{uuid.uuid4().hex}"
    write(docs, path, id_col, text_col, **options)
    return index(spark, path)
