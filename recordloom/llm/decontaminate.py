"""Benchmark decontamination by winnowing.

Both sides are cut into k-grams of words; of every GAP consecutive k-gram hashes the least is kept,
so any WINDOW = K + GAP - 1 words that two texts share have a kept k-gram in common, at the same
place. Training fingerprints pass a bitmap of the benchmark's, of BITS_EACH bits for each of its
fingerprints (up to MOST_BITS in all, beyond which it lets more through and the joins do more), and
then join them; each hit is extended to the windows that hold it, and these are joined as text, so
that hash collisions can't add hits. An item shorter than a window is one window by itself, found
by its own length of k-gram.

Defined cases: null or empty texts have no words, hit nothing, and an item without words is no
item; repeated rows each get their result; ids may be null; an empty benchmark hits nothing; a very
long text is worked on whole, in memory of some 50 times its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bitmap, fresh, keyed, marked, picked, stored, text_slices
from .textvec import ALNUM, FOLD, Hasher, flat, grams, runs, winnow

WINDOW, K = 10, 5
GAP = WINDOW - K + 1
#: Bits of the bitmap that fingerprints pass before the join: for each of the benchmark's, and at least and at most (8 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 1024, 1 << 16, 1 << 26
#: The benchmark's windows are broadcast up to so many bytes of text, else both sides are shuffled.
BROADCAST_BYTES = 16 << 20


def _word_table(texts: pa.Array):
    data, offsets = flat(texts)
    words = runs(data, offsets, ALNUM)
    return FOLD[data], words, Hasher(data, FOLD).ranges(words.start, words.end)


def _text(folded: np.ndarray, words, first: int, n: int) -> str:
    return b" ".join(folded[a:b].tobytes() for a, b in zip(words.start[first : first + n].tolist(), words.end[first : first + n].tolist(), strict=True)).decode()


def _item_windows(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(window text, n, items: the ids as strings) and (n, fp), distinct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                folded, words, hashes = _word_table(part.column("text"))
                item, window, size, prints = [], [], [], []
                bounds = np.searchsorted(words.row, np.arange(part.num_rows + 1))
                for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    n = min(WINDOW, b - a)
                    for first in range(a, b - n + 1 if n else a):
                        item.append(i)
                        window.append(_text(folded, words, first, n))
                        size.append(n)
                        k = K if n == WINDOW else n
                        h, _ = grams(hashes[first : first + n], words.row[first : first + n], k)
                        prints.append([int(h.min().view(np.int64))])
                ids = part.column("doc_id").take(pa.array(item, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(window, pa.string()), pa.array(size, pa.int32()), pa.array(prints, pa.list_(pa.int64()))], ["item_id", "window", "n", "fps"])

    kind = items.schema["doc_id"].dataType.simpleString()
    rows = stored(items.mapInArrow(run, f"item_id {kind}, window string, n int, fps array<long>"), "benchmark-windows")
    windows = rows.groupBy("window", "n").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    return stored(windows, "benchmark-index"), stored(rows.select("n", F.explode("fps").alias("fp")).distinct(), "benchmark-fps")


def hits(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, at, n, items) for each occurrence of a benchmark window, and docs' (doc_id, key, n_words).

    docs: doc_id, text, key; items: doc_id, text."""
    windows, fps = _item_windows(items)
    sizes = {r["n"]: r["count"] for r in fps.groupBy("n").count().collect()}  # WINDOW rows at most
    bits_sent = docs.sparkSession.sparkContext.broadcast(bitmap(fps, "fp", sum(sizes.values()), BITS_EACH, LEAST_BITS, MOST_BITS))
    short = sorted(n for n in sizes if n < WINDOW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bits_sent.value, np.uint64)
        for batch in batches:
            for part in text_slices(batch):
                folded, words, hashes = _word_table(part.column("text"))
                row = words.row
                bounds = np.searchsorted(row, np.arange(part.num_rows + 1))
                found = []  # (first word of a candidate window, its words, fingerprint)
                h, at = grams(hashes, row, K)
                chosen = winnow(h, row[at], GAP)
                chosen = chosen[marked(h[chosen], bits)]
                for p, fp in zip(at[chosen].tolist(), h[chosen].view(np.int64).tolist(), strict=True):
                    r = row[p]
                    found += [(first, WINDOW, fp) for first in range(max(int(bounds[r]), p - GAP + 1), min(p, int(bounds[r + 1]) - WINDOW) + 1)]
                for n in short:
                    h, at = grams(hashes, row, n)
                    ok = marked(h, bits)
                    found += zip(at[ok].tolist(), [n] * int(ok.sum()), h[ok].view(np.int64).tolist(), strict=True)
                first = np.array([f[0] for f in found], np.int64)
                keys = part.column("key")
                yield pa.RecordBatch.from_arrays([part.column("key"), *(pa.nulls(part.num_rows, t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.string())), pa.array(np.diff(bounds))], ["key", "at", "n", "fp", "window", "n_words"])
                if found:
                    rows = row[first]
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows)), pa.array(first - bounds[rows]), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.int64()), pa.array([_text(folded, words, a, n) for a, n, _ in found]), pa.nulls(len(found), pa.int64())], ["key", "at", "n", "fp", "window", "n_words"])

    out = stored(docs.select("key", "text").mapInArrow(run, "key string, at long, n int, fp long, window string, n_words long"), "decontaminate-hits")
    index = windows if (windows.agg(F.sum(F.octet_length("window") + 24 * F.size("items") + 32)).first()[0] or 0) > BROADCAST_BYTES else F.broadcast(windows)
    # Training fingerprints join the benchmark's: what only collided in the bitmap goes. Then windows join windows.
    seeds = out.where("fp is not null").join(fps, ["n", "fp"], "left_semi")
    return seeds.select("key", "at", "n", "window").distinct().join(index, ["n", "window"]).select("key", "at", "n", "items"), out.where("n_words is not null").select("key", "n_words")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted ids as strings), contaminated; one row for each row of docs."""
    rows = keyed(docs, id_col, text_col)
    found, sizes = hits(rows, picked(benchmark, item_id, item_text))
    before = Window.partitionBy("key").orderBy("at", "n").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("at") + F.col("n")
    new = found.withColumn("done", F.coalesce(F.max(end).over(before), F.lit(0))).withColumn("new", F.greatest(F.lit(0), end - F.greatest("at", "done")))
    per_key = new.groupBy("key").agg(F.sum("new").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    per_key = sizes.distinct().join(per_key, "key", "left")
    none = F.array().cast("array<string>")
    return rows.select("doc_id", "key").join(per_key, "key").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items")).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs in which no benchmark window occurs, with their columns."""
    rows = keyed(docs, id_col, text_col)
    found, _ = hits(rows, picked(benchmark, item_id, item_text))
    key = F.md5(F.concat_ws("\x00", F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("-")), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    lost = found.select(F.col("key").alias(own := fresh("key"))).distinct()
    return docs.join(lost, key == F.col(own), "left_anti")
