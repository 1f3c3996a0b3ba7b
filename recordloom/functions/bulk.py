"""Whole documents at once: tags as arrays, for documents without comments, CDATA, processing
instructions or doubtful quotes after the root's tag.

Such a document's tags are where < and > alternate; their depth is a running sum, a record is a tag
at the records' depth and the next tag that returns to it, and events are laid out by sums of the
number each tag gives. Whatever looks unusual, errors included, gives None: then the token by token
framer and parser speak, so both ways have the same results."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

from .errors import XmlError
from .framing import Framer
from .lexer import NAME, SPACE, attributes, unescape

#: Shorter documents are faster token by token.
LEAST_BYTES = 2048
_BYTE = np.arange(256)
_NAME_START = ((_BYTE | 32 >= ord("a")) & (_BYTE | 32 <= ord("z")) & (_BYTE < 0x80)) | (_BYTE == ord("_")) | (_BYTE == ord(":")) | (_BYTE >= 0x80)
_FILLED = ~np.isin(_BYTE, list(SPACE))
_LT, _GT, _SLASH, _QUOTES = 60, 62, 47, (34, 39)


class Tags(NamedTuple):
    """Tags behind the root's: first byte, byte behind, kind, and depth before and after (the root's content is 1)."""

    start: np.ndarray
    end: np.ndarray
    closing: np.ndarray
    empty: np.ndarray
    before: np.ndarray
    after: np.ndarray


class Framed(NamedTuple):
    framer: Framer
    tags: Tags
    first: np.ndarray  # tag that begins each record
    last: np.ndarray  # tag that ends it

    @property
    def starts(self) -> np.ndarray:
        return self.tags.start[self.first]

    @property
    def ends(self) -> np.ndarray:
        return self.tags.end[self.last]


def tags(content: bytes, at: int) -> Tags | None:
    """The tags from at on, if they are sure to be what the tokens are."""
    if content.find(b"<!", at) >= 0 or content.find(b"<?", at) >= 0:
        return None
    data = np.frombuffer(content, np.uint8)
    lt, gt = (at + np.flatnonzero(data[at:] == c) for c in (_LT, _GT))
    if not len(lt) or len(lt) != len(gt) or (lt > gt).any() or (gt[:-1] > lt[1:]).any():
        return None
    second = data[lt + 1]
    closing = second == _SLASH
    if not (closing | _NAME_START[second]).all():
        return None
    quotes = []
    for q in _QUOTES:
        pos = at + np.flatnonzero(data[at:] == q)
        tag = np.searchsorted(lt, pos, side="right") - 1
        quotes.append(np.bincount(tag[(tag >= 0) & (pos < gt[tag])], minlength=len(lt)))
    # With one kind of quotes, an even number of them, a tag's > is outside.
    if ((quotes[0] | quotes[1]) & 1).any() or ((quotes[0] > 0) & (quotes[1] > 0)).any():
        return None
    empty = ~closing & (data[gt - 1] == _SLASH)
    step = np.where(closing, -1, np.where(empty, 0, 1))
    after = 1 + np.cumsum(step)
    return Tags(lt, gt + 1, closing, empty, after - step, after)


def framed(content: bytes, path: tuple[str, ...], lenient: bool) -> Framed | None:
    """The records of a document by the rules of Framer; None where that one has to look."""
    if len(content) < LEAST_BYTES:
        return None
    framer = Framer(path, lenient)
    try:
        framer.push(content)
        framer.to_root()
    except XmlError:
        return None
    if framer.root is None or framer.finished:
        return None
    t = tags(content, framer.at)
    if t is None or t.after[-1] != 0 or (t.after[:-1] < 1).any() or content[t.end[-1] :].strip(SPACE):
        return None
    name = NAME.match(content, int(t.start[-1]) + 2)
    if not name or name[0] != framer.root:
        return None
    filled = np.r_[0, np.cumsum(_FILLED[np.frombuffer(content, np.uint8)])]
    text_from = np.r_[framer.at, t.end[:-1]]
    spans, merged = [(0, len(t.start) - 1)], []
    firsts, lasts = [], []
    for depth, wanted in enumerate([*framer.path, None], 1):
        inner = []
        for low, high in spans:
            here = low + np.flatnonzero(t.before[low : high + 1] == depth)
            if (filled[t.start[here]] != filled[text_from[here]]).any():
                return None
            opened = here[:-1]  # the last one closes the span
            ends = opened.copy()
            ends[~t.empty[opened]] = low + np.flatnonzero((t.after[low:high] == depth) & t.closing[low:high])
            if wanted is None:
                firsts.append(opened)
                lasts.append(ends)
                continue
            for a, b in zip(opened.tolist(), ends.tolist(), strict=True):
                name = NAME.match(content, int(t.start[a]) + 1)
                if not name:
                    return None
                if name[0] == wanted:
                    merged.append((int(t.start[a]), int(t.end[a])))
                    if b > a:
                        inner.append((a + 1, b))
        spans = inner
    try:
        for a, b in sorted(merged):
            framer.merge(content[a:b])
    except XmlError:
        return None
    first, last = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (firsts, lasts))
    framer.finished, framer.count = True, len(first)
    return Framed(framer, t, first, last)


class _Parsed(NamedTuple):
    tag: np.ndarray  # indices of the tags inside records
    record: np.ndarray  # of each
    names: list[bytes]
    spans: list[tuple[int, int]]  # of the attributes
    text: np.ndarray  # whether a text stands before the tag, inside the record
    text_from: np.ndarray


def _parsed(content: bytes, f: Framed) -> _Parsed | None:
    t = f.tags
    size = f.last - f.first + 1
    upto = np.cumsum(size)
    record = np.repeat(np.arange(len(size)), size)
    tag = np.repeat(f.first - upto + size, size) + np.arange(len(record))
    start, end, closing, empty = t.start[tag], t.end[tag], t.closing[tag], t.empty[tag]
    names, spans = [], []
    for a, b, c, e in zip(start.tolist(), end.tolist(), closing.tolist(), empty.tolist(), strict=True):
        if c:
            names.append(content[a + 2 : b - 1].rstrip(SPACE))
            spans.append((b, b))
        else:
            m = NAME.match(content, a + 1)
            names.append(m[0])
            spans.append((m.end(), b - 2 if e else b - 1))
    # The end of an element is the next closing tag at its level.
    level = np.where(closing, t.after[tag], t.before[tag])
    paired = np.flatnonzero(~empty)
    order = paired[np.argsort(level[paired], kind="stable")].tolist()
    if any(names[a] != names[b] for a, b in zip(order[::2], order[1::2], strict=True)):
        return None
    text_from = np.r_[0, end[:-1]]
    inside = np.r_[False, record[1:] == record[:-1]] if len(record) else np.zeros(0, bool)
    return _Parsed(tag, record, names, spans, inside & (start > text_from), text_from)


def _attributes(content: bytes, p: _Parsed, entities: dict[str, str]) -> dict[int, list[dict]]:
    """Of the tags that have some, by place in p."""
    return {k: attributes(raw, entities, int(p.record[k])) for k, (a, b) in enumerate(p.spans) if b > a and (raw := content[a:b]).strip(SPACE)}


def sizes(content: bytes, f: Framed) -> np.ndarray | None:
    """Bytes of start names, attribute values and texts of each record."""
    p = _parsed(content, f)
    if p is None:
        return None
    t, entities = f.tags, f.framer.entities
    own = np.where(t.closing[p.tag], 0, np.fromiter(map(len, p.names), np.int64, len(p.names)))
    own += np.where(p.text, t.start[p.tag] - p.text_from, 0)
    try:
        content.decode()
        for k, found in _attributes(content, p, entities).items():
            own[k] += sum(len(x["value"].encode()) for x in found)
        if b"&" in content:
            for k in np.flatnonzero(p.text).tolist():
                raw = content[p.text_from[k] : t.start[p.tag[k]]]
                if b"&" in raw:
                    own[k] += len(unescape(raw.decode(), entities).encode()) - len(raw)
    except (XmlError, KeyError, UnicodeDecodeError):
        return None
    return np.bincount(p.record, weights=own, minlength=len(f.first)).astype(np.int64)


_KINDS = pa.array(["Start", "End", "Text"])
_ATTR = pa.struct([("key", pa.string()), ("value", pa.string())])


def events(content: bytes, f: Framed) -> list[pa.Array] | None:
    """rec_index, ev_index, kind, name, attrs, text, depth, raw_attrs of all records' events, in order."""
    p = _parsed(content, f)
    if p is None:
        return None
    t, entities = f.tags, f.framer.entities
    closing, empty = t.closing[p.tag], t.empty[p.tag]
    each = 1 + p.text + empty  # events that a tag gives, with the text before it
    upto = np.cumsum(each)
    n = int(upto[-1]) if len(upto) else 0
    main = upto - 1 - empty
    kind, depth = np.full(n, 1, np.int8), np.zeros(n, np.int32)
    base = t.before[f.first][p.record]
    kind[main[~closing]] = 0
    depth[main] = np.where(closing, t.after[p.tag], t.before[p.tag]) - base
    depth[(main + 1)[empty]] = (t.before[p.tag] - base)[empty]
    texts = np.flatnonzero(p.text)
    kind[(main - 1)[texts]] = 2
    depth[(main - 1)[texts]] = (t.before[p.tag] - base)[texts]
    name, text, raw_attrs = (np.full(n, None, object) for _ in range(3))
    name[main] = p.names
    name[(main + 1)[empty]] = name[main[empty]]
    try:
        content.decode()
        said = [content[a:b].decode() for a, b in zip(p.text_from[texts].tolist(), t.start[p.tag[texts]].tolist(), strict=True)]
        text[(main - 1)[texts]] = [unescape(x, entities) if "&" in x else x for x in said] if b"&" in content else said
        found = _attributes(content, p, entities)
    except (XmlError, KeyError, UnicodeDecodeError):
        return None
    raw_attrs[main[~closing]] = [content[a:b].decode() if b > a else "" for (a, b), c in zip(p.spans, closing.tolist(), strict=True) if not c]
    counts = np.zeros(n, np.int64)
    place = np.fromiter(found, np.int64, len(found))
    counts[main[place]] = [len(x) for x in found.values()]
    pairs = [x for xs in found.values() for x in xs]
    items = pa.StructArray.from_arrays([pa.array([x["key"] for x in pairs], pa.string()), pa.array([x["value"] for x in pairs], pa.string())], fields=list(_ATTR))
    starts = kind == 0
    attrs = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), items, mask=pa.array(~starts))
    record = np.repeat(p.record, each)
    ev_index = np.arange(n) - (np.searchsorted(record, np.arange(len(f.first)))[record] if n else 0)
    return [pa.array(record, pa.int64()), pa.array(ev_index, pa.int32()), _KINDS.take(pa.array(kind)), pa.array(name, pa.string()), attrs, pa.array(text, pa.string()), pa.array(depth), pa.array(raw_attrs, pa.string())]
