"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints of 3-word shingles link at distance 2 or less. Two such fingerprints agree on two of
four 16-bit blocks, so each of the six block pairs deals fingerprints out by 32 shared bits; a
large group is dealt out again by two of the four 8-bit blocks of what is left, after which a
group has 65,536 members at most, whatever the data. In a group the index is built: fingerprints
sorted by Gray rank, leaves of neighbours, and above them nodes that keep the bits their children
share, each bit pattern once, in the highest node where it is common. A search adds up the
differences from the top and drops a whole node when they pass the distance. Only the links of a
spanning forest leave a group, and components come from rounds of minimum labels over them.

Defined cases: no words (null, empty, white space): fingerprint zero, linked like any other; equal
fingerprints are one class whatever the texts; null ids take part but are never a component's id
unless all of its ids are null; an id may have several texts, rows of their own; an empty table gives
an empty table; a very long text is hashed whole, in memory of some 50 times its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, picked, stored, text_slices

SHINGLE, SEED, DISTANCE = 3, 42, 2
#: A group of more fingerprints than this is dealt out again by further bits.
GROUP = 4096
LEAF, FANOUT = 16, 8


def fingerprint(text: str) -> int:
    """64 bits; a bit is 1 if it is set in over half of the shingles' hashes."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    line, k = b" ".join(words), min(SHINGLE, len(words))
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.r_[0, end[:-1] + 1]
    hash_ = xxhash.xxh64_intdigest
    n = len(words) - k + 1
    h = np.fromiter((hash_(line[a:b], SEED) for a, b in zip(start[:n].tolist(), end[k - 1 :].tolist(), strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        ones += np.unpackbits(h[at : at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sig (hash of the text) and fp, the fingerprint as a signed long. A narrow map."""
    one = picked(docs, id_col, text_col).withColumn("sig", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                fp = np.array([fingerprint(t.as_py()) for t in part.column("text")], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("sig"), pa.array(fp)], ["doc_id", "sig", "fp"])

    return one.mapInArrow(run, f"doc_id {one.schema['doc_id'].dataType.simpleString()}, sig long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Levels from the leaves up: of each node the bits shared below it and not already above."""

    def __init__(self, fps: np.ndarray):
        self.order = np.argsort(gray_rank(fps), kind="stable")
        self.fps = fps[self.order]
        mask, pattern, width, levels = np.full(len(fps), ~np.uint64(0)), self.fps, LEAF, []
        while True:
            at = np.arange(0, len(pattern), width)
            both = np.bitwise_and.reduceat(mask, at)
            ones, any_ = np.bitwise_and.reduceat(pattern | ~mask, at), np.bitwise_or.reduceat(pattern & mask, at)
            mask = both & ~(ones ^ any_)
            pattern = any_ & mask
            levels.append((mask, pattern, width))
            if len(mask) == 1:
                break
            width = FANOUT
        self.levels, above = [], np.zeros(1, np.uint64)
        for depth, (mask, pattern, width) in enumerate(reversed(levels)):
            if depth:
                above = np.repeat(above, self.levels[-1][2])[: len(mask)]
            self.levels.append((mask & ~above, pattern & mask & ~above, width))
            above = mask
        self.leaf_mask = above

    def near(self, queries: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (index into queries, index into the fingerprints given) within distance."""
        q, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        diff = np.zeros(len(queries), np.int64)
        for depth, (mask, pattern, width) in enumerate(self.levels):
            diff = diff + np.bitwise_count((queries[q] & mask[node]) ^ pattern[node])
            keep = diff <= distance
            q, node, diff = q[keep], node[keep], diff[keep]
            size = len(self.levels[depth + 1][0]) if depth + 1 < len(self.levels) else len(self.fps)
            child = (node[:, None] * width + np.arange(width)).ravel()
            q, diff = np.repeat(q, width), np.repeat(diff, width)
            rest = np.repeat(self.leaf_mask[node], width) if depth + 1 == len(self.levels) else None
            keep = child < size
            q, node, diff = q[keep], child[keep], diff[keep]
        left = ~rest[keep]
        keep = diff + np.bitwise_count((queries[q] ^ self.fps[node]) & left) <= distance
        return q[keep], self.order[node[keep]]


def forest(fps: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """For each fingerprint of a group the least member of its component inside the group."""
    index, n = GrayIndex(fps), len(fps)
    label = np.full(n, -1, np.int64)
    for seed in np.argsort(fps, kind="stable"):
        if label[seed] >= 0:
            continue
        label[seed] = seed
        front = np.array([seed])
        while len(front):
            found = []
            for at in range(0, len(front), 256):
                _, hit = index.near(fps[front[at : at + 256]], distance)
                hit = np.unique(hit)
                hit = hit[label[hit] < 0]
                label[hit] = seed
                found.append(hit)
            front = np.concatenate(found)
    return fps[label]


def _masked(fp: Column, blocks: tuple[int, ...], bits: int, ranks: list[int]) -> Column:
    """The named blocks of fp, kept in place; ranks: the lowest bit of each block."""
    mask = sum(((1 << bits) - 1) << ranks[b] for b in blocks)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))


def _links(groups: DataFrame) -> DataFrame:
    """a, b: spanning links inside each group; groups: columns keys..., fp, sorted into one task by group."""
    keys = [c for c in groups.columns if c != "fp"]
    dealt = groups.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        last: tuple | None = None
        out: list[np.ndarray] = []

        def close() -> None:
            fps = np.concatenate(held).astype(np.int64).view(np.uint64)
            if len(fps) > 1:
                root = forest(fps)
                out.append(np.stack([root, fps])[:, root != fps])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy() for c in keys]
            fps = batch.column("fp").to_numpy()
            new = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in cols], axis=0)])
            for a, b in zip(new.tolist(), [*new[1:].tolist(), len(fps)], strict=True):
                key = tuple(c[a] for c in cols)
                if key != last and held:
                    close()
                    held = []
                last = key
                held.append(fps[a:b])
            if out:
                both = np.concatenate(out, axis=1).view(np.int64)
                out = []
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])
        if held:
            close()
        if out:
            both = np.concatenate(out, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def links(fps: DataFrame, group: int = GROUP) -> DataFrame:
    """a, b: links that connect exactly what distances of 2 or less connect, far fewer than all of them.

    fps: distinct fingerprints, column fp."""
    pairs = list(combinations(range(4), 2))
    sixteen = [48, 32, 16, 0]
    fp = F.col("fp")
    wide = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("p"), _masked(fp, p, 16, sixteen).alias("k")) for i, p in enumerate(pairs)))).alias("g")).select("fp", "g.p", "g.k")
    counts = wide.groupBy("p", "k").agg(F.count("*").alias("n")).where("n > 1")
    met = stored(wide.join(counts, ["p", "k"]), "simhash-groups")
    small = met.where(F.col("n") <= group).select("p", "k", F.lit(0).alias("s"), F.lit(0).cast("long").alias("t"), "fp")
    again = []
    for i, p in enumerate(pairs):
        eight = [sixteen[b] + h for b in range(4) if b not in p for h in (8, 0)]
        again += [F.when(F.col("p") == i, F.struct(F.lit(j).alias("s"), _masked(fp, q, 8, eight).alias("t"))) for j, q in enumerate(pairs)]
    parts = F.filter(F.array(*again), lambda x: x.isNotNull())
    large = met.where(F.col("n") > group).select("p", "k", F.explode(parts).alias("g"), "fp").select("p", "k", "g.s", "g.t", "fp")
    return _links(small.unionByName(large))


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node that each linked node reaches, by rounds of minimum labels with
    shortcuts. Each round is written to the shared folder."""
    edges = stored(edges.select("a", "b"), "simhash-links")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "simhash-label")
    while True:
        # The least label of a node's neighbours and its own, then the label of that label.
        near = both.join(label.withColumnsRenamed({"node": "b"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = label.join(near, "node").select("node", F.least("root", "near").alias("mid"), F.col("root").alias("was"))
        jump = label.select(F.col("node").alias("mid"), F.col("root").alias("far"))
        step = stored(step.join(jump, "mid").select("node", F.least("mid", "far").alias("root"), "was"), "simhash-label")
        label = step.select("node", "root")
        if not step.where("root <> was").head(1):
            return label


def _classed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """doc_id, sig, fp of every row; and fp, root (of its component), component_id."""
    rows = stored(fingerprints(docs, id_col, text_col), "simhash-fps")
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(least.select("fp")))
    classes = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows, classes.join(ids, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, fp; one row for each row of docs."""
    rows, of = _classed(docs, id_col, text_col)
    return rows.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that of the least id (null ids last), then of the least hash of its
    text; of rows that are equal in both, any one. Rows are told apart by id and text, columns stay as they are."""
    rows, of = _classed(docs, id_col, text_col)
    who = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sig")
    each = stored(rows.join(of, "fp").groupBy("root", who.alias("who")).agg(F.count("*").alias("n")), "simhash-members")
    # Written, so that the join may split a component that holds very many rows.
    first = stored(each.groupBy("root").agg(F.min("who").alias("least")), "simhash-first")
    told = each.join(first, "root")
    same = F.col("who").eqNullSafe(F.col("least"))
    id_, sig = fresh("id"), fresh("sig")
    key = [F.col("who.doc_id").alias(id_), F.col("who.sig").alias(sig)]
    text = F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    here = F.col(f"`{id_col}`").eqNullSafe(F.col(id_)) & (text == F.col(sig))
    kept = docs.join(told.where(~same).select(key), here, "left_anti")
    twice = stored(told.where(same & (F.col("n") > 1)).select(key), "simhash-twice")
    if twice.isEmpty():
        return kept
    one = kept.join(twice, here, "left_semi").withColumn(sig, text).dropDuplicates([id_col, sig]).drop(sig)
    return kept.join(twice, here, "left_anti").unionByName(one)
