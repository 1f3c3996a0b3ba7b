"""Line dedup by pairwise alignment.

A document is aligned with earlier documents that share lines with it, and lines in aligned common
blocks go from the later one (of the larger id). Overlapping documents are found through hashes of
lines and of runs of consecutive lines. Of a rare hash, one with at most RARE holders, each is
paired with all earlier holders; of another each holder is paired with the first one, so a line held
by a third of all documents makes as many pairs as it has holders, not their square; and where such
a frequent line or run has MIN_WORDS words, it is a common block with its first holder by itself, so
that no order of other lines can save it. The second time that a document has a line or a run is
another hash than the first, held by documents that have it twice, and so on. Runs are the
shortest ones of MIN_WORDS words from each line on and up to each line, so every line of a block
that two documents share is in a run of that block; and each line with the next. Of a pair only the
lines that both hold are brought together, whatever the length of the documents. Unique lines anchor
the patience diff: of the lines once in both documents the longest increasing run is kept, blocks
grow from these anchors over equal neighbours, and gaps are aligned in the same way. Blocks of fewer
than MIN_WORDS words stay.

A deleted line always remains in the document of the least id that holds it. Lines are whole
(between newlines) and compared by 64-bit hashes; lines without a word never pair documents.
Defined cases: null and empty texts have no lines and stay as they are; rows of equal id and text
are copies and none of them is the later, so all of them lose the same lines; an id may have
several texts, none of which is the later of another; rows of null id are aligned with nothing and
stay as they are; an empty table gives an empty table; columns may have any names; a very long text
is cut into lines whole, in memory of some 50 times its bytes.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, stored, text_slices
from .textvec import _ODD, _ODD_INVERSE, GRAPH, NOT_NEWLINE, Hasher, _power, flat, mix, runs

MIN_WORDS, RARE = 5, 8


def nth(key: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Hashes that tell apart the first, second, … time that a row has a key; those of the first times are the keys."""
    order = np.lexsort((np.arange(len(key)), key, row))
    new = np.r_[True, (key[order][1:] != key[order][:-1]) | (row[order][1:] != row[order][:-1])][: len(key)]
    at = np.arange(len(key))
    times = np.zeros(len(key), np.uint64)
    times[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return np.where(times > 0, mix(key + times * np.uint64(_ODD)), key)


def run_hashes(h: np.ndarray, count: np.ndarray, row: np.ndarray, no: np.ndarray, min_words: int) -> list[pa.Array]:
    """Of each line: hashes of the shortest runs of min_words words from it on and up to it, and of it and the next line,
    and the numbers of the lines of the first two runs. Null where the row has no such run or it is the line alone."""
    n, at = len(h), np.arange(len(h))
    total, sums = np.r_[0, np.cumsum(count)], np.zeros(n + 1, np.uint64)
    np.cumsum(h * _power(_ODD, n), out=sums[1:])
    out, numbers = [], []
    for low, high in ((at, np.searchsorted(total, total[:-1] + min_words)), (np.searchsorted(total, total[1:] - min_words, side="right") - 1, at + 1), (at, at + 2)):
        ok = (low >= 0) & (high <= n) & (high - low > 1)
        low, high = np.where(ok, low, 0), np.where(ok, high, 1)
        ok &= row[low] == row[high - 1]
        key = mix((sums[high] - sums[low]) * _power(_ODD_INVERSE, n + 1)[low] + (high - low).astype(np.uint64))
        out.append(pa.array(nth(key, np.where(ok, row, -1)).view(np.int64), mask=~ok))
        size = np.where(ok, high - low, 0)
        upto = np.cumsum(size)
        of = no[np.repeat(low - upto + size, size) + np.arange(upto[-1] if n else 0)]
        numbers.append(pa.ListArray.from_arrays(pa.array(np.r_[0, upto], pa.int32()), pa.array(of.astype(np.int32))))
    return out + numbers[:2]


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, sig (of the text), no (the line's number), at (among lines with a word), h, words, line (nth() of h), and onward, upto, two,
    onward_no, upto_no of run_hashes(): a row for each line with a word."""
    one = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).where("doc_id is not null").withColumn("sig", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                data, offsets = flat(part.column("text"))
                lines, words = runs(data, offsets, NOT_NEWLINE), runs(data, offsets, GRAPH)
                count = np.searchsorted(words.start, lines.end) - np.searchsorted(words.start, lines.start)
                newlines = np.r_[0, np.cumsum(data == 0x0A)]
                no = newlines[lines.start] - newlines[offsets[lines.row]]
                some = count > 0
                start, end, row = lines.start[some], lines.end[some], lines.row[some]
                at = np.arange(len(row)) - np.searchsorted(row, row)
                ids = pa.array(row)
                h = Hasher(data).ranges(start, end)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(ids), part.column("sig").take(ids), pa.array(no[some].astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(count[some].astype(np.int32)), pa.array(nth(h, row).view(np.int64)), *run_hashes(h, count[some], row, no[some], min_words)], ["doc_id", "sig", "no", "at", "h", "words", "line", "onward", "upto", "two", "onward_no", "upto_no"])

    return one.mapInArrow(run, f"doc_id {one.schema['doc_id'].dataType.simpleString()}, sig long, no int, at int, h long, words int, line long, onward long, upto long, two long, onward_no array<int>, upto_no array<int>")


def shared_lines(lines: DataFrame, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """doc_id, sig, h, words, places (at and no of each time the text has the line) of the lines that several ids hold; the
    pairs to align: doc_id, partner (the lesser id); and doc_id, sig, partner, cut: blocks of frequent lines and runs by themselves."""
    key = F.explode(F.array_distinct(F.array_compact(F.array("line", "onward", "upto", "two")))).alias("key")
    held = lines.select("doc_id", key).groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first <> last").select("key", "first", "n")
    # Written, so that the joins deal both sides out themselves and may split the lines that very many documents hold.
    held = stored(held, "line-holders")
    met = lines.select("doc_id", key).join(held, "key")
    among = F.transform("ids", lambda x: F.struct(x.alias("doc_id"), F.filter("ids", lambda y: y < x).alias("before")))
    few = met.where(F.col("n") <= RARE).groupBy("key").agg(F.collect_set("doc_id").alias("ids")).select(F.explode(among).alias("p")).select("p.doc_id", F.explode("p.before").alias("partner"))
    later = (F.col("n") > RARE) & (F.col("doc_id") != F.col("first"))
    many = met.where(later).select("doc_id", F.col("first").alias("partner"))
    pairs = stored(few.unionByName(many).distinct(), "line-pairs")
    some = lines.select("doc_id", "sig", "h", "words", "at", "no").join(held.select(F.col("key").alias("h")), "h").distinct()
    shared = some.groupBy("doc_id", "sig", "h", "words").agg(F.sort_array(F.collect_list(F.struct("at", "no"))).alias("places"))
    long = F.when(F.col("words") >= min_words, F.struct(F.col("line").alias("key"), F.array("no").alias("cut")))
    run = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("key"), F.col(f"{c}_no").alias("cut")))
    blocks = lines.select("doc_id", "sig", F.explode(F.array_compact(F.array(long, run("onward"), run("upto")))).alias("b")).select("doc_id", "sig", "b.key", "b.cut")
    alone = blocks.join(held.where(F.col("n") > RARE), "key").where(later).select("doc_id", "sig", F.col("first").alias("partner"), "cut")
    return stored(shared, "shared-lines"), pairs, alone


def _anchors(a: list[int], b: list[int], count_a: Counter, count_b: Counter) -> list[tuple[int, int]]:
    """Positions of lines once in each, in the longest run that increases in both."""
    at = {h: j for j, h in enumerate(b) if count_b[h] == 1}
    match = [(i, at[h]) for i, h in enumerate(a) if h in at and count_a[h] == 1]
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(match)
    for n, (_, j) in enumerate(match):
        k = bisect_left(tails, j)
        back[n] = ends[k - 1] if k else -1
        tails[k : k + 1], ends[k : k + 1] = [j], [n]
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        out.append(match[n])
        n = back[n]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions (i, j), increasing in both, found from unique common lines recursively."""
    done: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            done.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            done.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        x, y = a[a0:a1], b[b0:b1]
        found = _anchors(x, y, Counter(x), Counter(y))
        i, j = a0, b0
        for p, q in found:
            p, q = a0 + p, b0 + q
            done.append((p, q))
            todo.append((i, p, j, q))
            i, j = p + 1, q + 1
        if found:
            todo.append((i, a1, j, b1))
    return sorted(done)


def common_lines(later: list[tuple[int, int, int, int]], first: list[tuple[int, int, int, int]], min_words: int = MIN_WORDS) -> list[int]:
    """Numbers of later's lines inside aligned common blocks of min_words words or more; both: (at, no, h, words) in order."""
    out: list[int] = []
    block: list[int] = []
    last = (-2, -2)
    for i, j in [*patience([x[2] for x in later], [x[2] for x in first]), (-1, -1)]:
        here = (later[i][0], first[j][0]) if i >= 0 else (-9, -9)
        if here != (last[0] + 1, last[1] + 1):
            if sum(later[k][3] for k in block) >= min_words:
                out += [later[k][1] for k in block]
            block = []
        block.append(i)
        last = here
    return out


def deletions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, sig, cut (sorted numbers of the lines to delete), partners (ids aligned with, sorted) of the documents that lose lines."""
    shared, pairs, alone = shared_lines(stored(line_table(docs, id_col, text_col, min_words), "lines"), min_words)
    kind = shared.schema["doc_id"].dataType.simpleString()
    first = shared.select(F.col("doc_id").alias("partner"), F.col("sig").alias("partner_sig"), "h", F.col("places").alias("b"))
    met = shared.join(pairs, "doc_id").join(first, ["partner", "h"])
    both = met.groupBy("doc_id", "sig", "partner", "partner_sig").agg(F.collect_list(F.struct("h", "words", F.col("places").alias("a"), "b")).alias("lines"))

    def sides(lines: pa.StructArray) -> tuple[list, list]:
        h, words = (lines.field(c).to_pylist() for c in ("h", "words"))
        out = []
        for c in "ab":
            places = lines.field(c)
            size = np.diff(places.offsets.to_numpy())
            at, no = (x.to_pylist() for x in places.flatten().flatten())
            line = np.repeat(np.arange(len(size)), size).tolist()
            out.append(sorted((p, n, h[k], words[k]) for p, n, k in zip(at, no, line, strict=True)))
        return out[0], out[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [common_lines(*sides(x.values), min_words) for x in batch.column("lines")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("sig"), batch.column("partner"), pa.array([c or None for c in cut], pa.list_(pa.int32()))], ["doc_id", "sig", "partner", "cut"])

    found = both.select("doc_id", "sig", "partner", "lines").mapInArrow(run, f"doc_id {kind}, sig long, partner {kind}, cut array<int>").where("cut is not null").unionByName(alone)
    return found.groupBy("doc_id", "sig").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("cut")))).alias("cut"), F.array_sort(F.collect_set("partner")).alias("partners"))


def without_lines(text: F.Column, lines: F.Column) -> F.Column:
    """text without the lines of the given numbers."""
    split = F.split(text, "\n", -1)
    keep = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), lines)
    return F.array_join(F.transform(keep, lambda i: F.get(split, i)), "\n")


def _with_cuts(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> tuple[DataFrame, F.Column, F.Column]:
    """docs with the columns of deletions() under names of their own, which are returned: cut, partners."""
    cut = deletions(docs, id_col, text_col, min_words)
    names = {c: fresh(c) for c in cut.columns}
    cut = cut.withColumnsRenamed(names)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    joined = docs.join(cut, (F.col(f"`{id_col}`") == F.col(names["doc_id"])) & (F.xxhash64(text) == F.col(names["sig"])), "left")
    return joined, F.col(names["cut"]), F.col(names["partners"])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with texts cut; all rows and columns stay."""
    joined, cut, _ = _with_cuts(docs, id_col, text_col, min_words)
    text = F.col(f"`{text_col}`")
    left = F.when(cut.isNull(), text).otherwise(without_lines(text, cut))
    return joined.select(*(left.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines, n_deleted, deleted (line numbers), partners, text_sha256 of what is left; one row for each row of docs."""
    one = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows, cut, partners = _with_cuts(one, "doc_id", "text", min_words)
    deleted = F.coalesce(cut, F.array().cast("array<int>"))
    left = F.when(cut.isNull(), F.col("text")).otherwise(without_lines(F.col("text"), cut))
    ids = f"array<{one.schema['doc_id'].dataType.simpleString()}>"
    return rows.select("doc_id", F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"), F.size(deleted).cast("long").alias("n_deleted"), deleted.alias("deleted"), F.coalesce(partners, F.array().cast(ids)).alias("partners"), F.sha2(left, 256).alias("text_sha256"))
