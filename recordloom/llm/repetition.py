"""Quality rules from a suffix array: repeated passages inside a document.

For every slice of texts one suffix array over the words of all its documents is built by prefix
doubling, ranks starting from (document, word), so suffixes of different documents never mix. The
longest common prefixes of neighbours make LCP intervals, each a maximal repeated substring with
all places where it starts. The union of the spans of those with REPEAT_WORDS words or more is the covered
part, the largest LCP the longest repeat. A document fails if the covered fraction or the longest
repeat is over its limit, or a base rule fails (fewer than 50 words, or over half of the words
inside 3-word windows that occur twice or more).

Words and prefixes are compared by 64-bit hashes. Defined cases: null and empty texts have no words
and fail (n_words < 50); texts without repeats have no covered words; memory is linear in a slice or
in one longer text, which is worked on whole; repeated rows each get their result; an empty table
gives an empty table; columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, picked, text_slices
from .textvec import GRAPH, NOT_NEWLINE, Hasher, flat, per_row, runs

MIN_WORDS, BASE_WINDOW = 50, 3
#: A repeated substring counts from so many words; limits on the covered fraction and the longest repeat in words.
REPEAT_WORDS, MAX_COVERED, MAX_LONGEST = 8, 0.3, 150
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat", "n_repeats"]


def intervals(lcp: np.ndarray, least: int) -> np.ndarray:
    """(length, first, last) of the LCP intervals of least words or more: suffixes first..last of the array, and no
    others, begin with the same length words, and not all of them with one more. lcp[i]: of suffixes i and i + 1."""
    out: list[tuple[int, int, int]] = []
    open_: list[tuple[int, int]] = []
    at = np.flatnonzero(lcp >= least)
    before = -2
    for i, v in zip(at.tolist(), lcp[at].tolist(), strict=True):
        if i != before + 1:
            out += [(size, first, before + 1) for size, first in reversed(open_)]
            open_ = []
        first = i
        while open_ and open_[-1][0] > v:
            size, first = open_.pop()
            out.append((size, first, i))
        if not open_ or open_[-1][0] < v:
            open_.append((v, first))
        before = i
    out += [(size, first, before + 1) for size, first in reversed(open_)]
    return np.array(out, np.int64).reshape(-1, 3)


def repeats(words: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array, and the LCP of each suffix and the next one, in words; 0 where their rows differ."""
    n = len(words)
    lcp = np.zeros(max(n - 1, 0), np.int64)
    if n < 2:
        return np.arange(n), lcp
    row_end = np.searchsorted(row, row, side="right")
    # Prefix hashes for LCPs of neighbours: common length by binary search.
    odd = 0xD6E8FEB86659FD93
    power = np.cumprod(np.r_[np.uint64(1), np.full(n, odd, np.uint64)], dtype=np.uint64)
    sums = np.r_[np.uint64(0), np.cumsum(words * power[:n], dtype=np.uint64)]
    order = np.lexsort((words, row))
    same = (words[order][1:] == words[order][:-1]) & (row[order][1:] == row[order][:-1])
    rank = np.empty(n, np.int64)
    new = np.r_[True, ~same]
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    tied = np.zeros(n, bool)
    tied[1:] |= same
    tied[:-1] |= same
    # Places of the order still tied, and groups; each round sorts the tied ones by the rank k ahead.
    place, k = np.flatnonzero(tied), 1
    while len(place):
        at = order[place]
        ahead = at + k
        nxt = np.where(ahead < row_end[at], rank[np.minimum(ahead, n - 1)] + 1, 0)
        group = rank[at]
        by = np.lexsort((nxt, group))
        at, nxt, group = at[by], nxt[by], group[by]
        order[place] = at
        differs = np.r_[True, (group[1:] != group[:-1]) | (nxt[1:] != nxt[:-1])]
        # A rank is the place of the group's first member, so splits keep the order of all ranks.
        first_of_group = np.r_[True, group[1:] != group[:-1]]
        idx = np.arange(len(place))
        base = idx[first_of_group][np.cumsum(first_of_group) - 1]
        sub = idx[differs][np.cumsum(differs) - 1]
        rank[at] = group + (sub - base)
        tie = ~differs
        keep = tie.copy()
        keep[:-1] |= tie[1:]
        place = place[keep]
        k *= 2
    a, b = order[:-1], order[1:]
    near = np.flatnonzero((row[a] == row[b]) & (words[a] == words[b]))
    a, b = a[near], b[near]
    low, high = np.ones(len(a), np.int64), np.minimum(row_end[a] - a, row_end[b] - b)
    while len(a) and (open_ := low < high).any():
        mid = np.where(open_, (low + high + 1) // 2, low)
        shift = b - a
        left, right = sums[a + mid] - sums[a], sums[b + mid] - sums[b]
        hit = np.where(shift >= 0, left * power[np.maximum(shift, 0)] == right, right * power[np.maximum(-shift, 0)] == left)
        low = np.where(open_ & hit, mid, low)
        high = np.where(open_ & ~hit, mid - 1, high)
    lcp[near] = low
    return order, lcp


def covered(length: np.ndarray, least: int) -> np.ndarray:
    """Which positions lie in a span [i, i + length[i]) with length[i] >= least."""
    n = len(length)
    at = np.flatnonzero(length >= least)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + length[at], -1)
    return np.cumsum(edge[:n]) > 0


def measures(texts: pa.Array) -> list[np.ndarray]:
    """COLUMNS for each text."""
    n, (data, offsets) = len(texts), flat(texts)
    hasher = Hasher(data)
    words = runs(data, offsets, GRAPH)
    hashes = hasher.ranges(words.start, words.end)
    starts = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    order, lcp = repeats(hashes, words.row)
    # The longest repeat that begins at a word is that of the innermost interval which holds its suffix.
    longest = np.zeros(len(hashes), np.int64)
    longest[order] = np.maximum(np.r_[0, lcp], np.r_[lcp, 0])[: len(order)]
    found = intervals(lcp, REPEAT_WORDS)
    base = covered(np.where(longest >= BASE_WINDOW, longest, 0), BASE_WINDOW)
    spans = covered(longest, REPEAT_WORDS)
    lines = runs(data, offsets, NOT_NEWLINE)
    first = np.searchsorted(words.start, lines.start)
    some = first < np.searchsorted(words.start, lines.end)
    line, line_row = hasher.ranges(lines.start[some], lines.end[some]), lines.row[some]
    by = np.lexsort((line, line_row))
    again = (line[by][1:] == line[by][:-1]) & (line_row[by][1:] == line_row[by][:-1])
    symbols = np.r_[0, np.cumsum(_SYMBOL[data])]
    top = np.zeros(n, np.int64)
    np.maximum.at(top, words.row, longest)
    return [
        per_row(np.ones(len(words.row)), words.row, n),
        per_row(starts[words.end] - starts[words.start], words.row, n),
        symbols[offsets[1:]] - symbols[offsets[:-1]],
        per_row(np.ones(int(again.sum())), line_row[by][1:][again], n),
        per_row(base, words.row, n),
        per_row(spans, words.row, n),
        top,
        per_row(np.ones(len(found)), words.row[order[found[:, 1]]], n),
    ]


def with_measures(docs: DataFrame, text_col: str = "text", name: str = "measures") -> DataFrame:
    """docs as they are, with one more column, a struct of COLUMNS. A narrow map."""
    schema = docs.select("*", F.lit(None).cast(f"struct<{','.join(f'{c}:bigint' for c in COLUMNS)}>").alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index(text_col)
            column = batch.column(at)
            filled = column.fill_null("") if column.null_count else column
            one = pa.RecordBatch.from_arrays([*batch.columns, filled], [*map(str, range(batch.num_columns)), "text"])
            for part in text_slices(one):
                q = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in measures(part.column("text"))], COLUMNS)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], q], schema.names)

    return docs.mapInArrow(run, schema)


def base_failed(q: str) -> F.Column:
    """Base rule over the struct of with_measures()."""
    return (F.col(f"{q}.n_words") < MIN_WORDS) | (100 * F.col(f"{q}.n_repeat_words") > 50 * F.col(f"{q}.n_words"))


def kept(q: str) -> F.Column:
    """The verdict: the base rule and the method's limits."""
    return ~base_failed(q) & (F.col(f"{q}.covered_words") <= MAX_COVERED * F.col(f"{q}.n_words")) & (F.col(f"{q}.longest_repeat") <= MAX_LONGEST)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, COLUMNS, base_failed, kept; one row for each row of docs."""
    rows = with_measures(picked(docs, id_col, text_col), name="q").drop("text")
    return rows.select("doc_id", *(F.col(f"q.{c}") for c in COLUMNS), base_failed("q").alias("base_failed"), kept("q").alias("kept"))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that are kept, with their columns."""
    return with_measures(docs, text_col, name := fresh("measures")).where(kept(name)).drop(name)
