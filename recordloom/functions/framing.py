"""An incremental framer: bytes in chunks of any size in, record ranges out.

It holds the open record or token and nothing that lies before it: skipped siblings, comments
between records and whatever was handed out are let go. Whole documents are one chunk."""

from __future__ import annotations

import re
from collections.abc import Iterator

from .errors import XmlError
from .lexer import DOCTYPE, NAME, SPACE, TOKEN, entities_of, namespaces, utf8

_ENCODING = re.compile(rb"""encoding[ \t\r\n]*=[ \t\r\n]*(?:"([^"]*)"|'([^']*)')""")


class Framer:
    """push() bytes, then take() records; finish() at the end of the input."""

    def __init__(self, record_path: tuple[str, ...] = (), lenient: bool = False):
        self.path = [p.encode() for p in record_path]
        self.target, self.lenient = len(self.path) + 1, lenient
        self.buffer, self.base, self.at = b"", 0, 0  # base: offset of the buffer in the document
        self.root: bytes | None = None
        self.entities: dict[str, str] = {}
        self.namespaces: dict[str, str] = {}
        self.depth = self.skip = 0
        self.start: int | None = None  # of the open record, in the buffer
        self.until: bytes | None = None  # end of a long span outside records
        self.finished = self.ended = self.begun = False
        self.count = 0

    def push(self, chunk: bytes) -> None:
        keep = self.at if self.start is None else self.start
        if keep:
            self.buffer, self.base, self.at = self.buffer[keep:], self.base + keep, self.at - keep
            self.start = None if self.start is None else 0
        self.buffer += chunk

    @property
    def held(self) -> int:
        """Bytes kept for what is to come."""
        return len(self.buffer) - (self.at if self.start is None else self.start)

    def _bad(self) -> XmlError:
        return XmlError("Malformed", self.base + self.at)

    def _name(self, tag: bytes, skip: int) -> bytes:
        m = NAME.match(tag, skip)
        if not m:
            raise self._bad()
        return m[0]

    def _prolog_start(self) -> bool:
        head = self.buffer[:4]
        if head[:2] in (b"\xff\xfe", b"\xfe\xff"):
            raise XmlError("Encoding")
        if len(head) < 4 and not self.ended and (not head or b"\xef\xbb\xbf<".startswith(head)):
            return False
        self.at = 3 if head[:3] == b"\xef\xbb\xbf" else 0
        self.begun = True
        return True

    def _next(self) -> re.Match | None:
        """The next token, or None if more input is needed."""
        if self.until:
            end = self.buffer.find(self.until, self.at)
            if end < 0:
                self.at = max(self.at, len(self.buffer) - len(self.until) + 1)
                if self.ended:
                    raise self._bad()
                return None
            self.at, self.until = end + len(self.until), None
        if self.at >= len(self.buffer):
            return None
        m = TOKEN.match(self.buffer, self.at)
        if not m and self.root is None and self.buffer.startswith(b"<!DOCTYPE", self.at):
            m = DOCTYPE.match(self.buffer, self.at)
        if m:
            return m
        rest = self.buffer[self.at : self.at + 9]
        open_ = [(b"<!--", b"-->"), (b"<![CDATA[", b"]]>"), (b"<?", b"?>")]
        for opener, closer in open_:
            if rest.startswith(opener):
                if self.ended:
                    raise self._bad()
                if self.start is None and self.root is not None:
                    self.at, self.until = self.at + len(opener), closer
                    return self._next()
                return None
        could = rest in b"<" or any(o.startswith(rest) for o, _ in open_) or (self.root is None and b"<!DOCTYPE"[: len(rest)] == rest) or rest[:2] == b"</" or (rest[:1] == b"<" and NAME.match(rest, 1))
        if self.ended or not could:
            raise self._bad()
        return None

    def to_root(self) -> None:
        """Up to the end of the root's tag, as far as the input goes."""
        for _ in self._taken(only_root=True):
            pass

    def take(self) -> Iterator[tuple[int, int, int, bytes]]:
        """(index, start, end, bytes) of each record that is complete."""
        return self._taken()

    def _taken(self, only_root: bool = False) -> Iterator[tuple[int, int, int, bytes]]:
        if not self.begun and not self._prolog_start():
            return
        while not (self.finished and self.lenient) and not (only_root and self.root is not None):
            m = self._next()
            if m is None:
                return
            kind, end = m.lastgroup, m.end()
            if "outer" in m.re.groupindex:
                self.entities |= entities_of(m, self.lenient)
            elif self.root is None:
                self._before_root(kind, m[0])
            elif self.finished:
                if kind not in ("comment", "pi") and not (kind == "text" and not m[0].strip(SPACE)):
                    raise self._bad()
            elif kind == "start":
                self._open(m[0])
            elif kind == "end":
                self._close(m[0])
            elif kind == "text" and not self.skip and self.start is None and m[0].strip(SPACE):
                raise self._bad()
            self.at = end
            if self.start is not None and self.depth == self.target:
                yield self.count, self.base + self.start, self.base + end, self.buffer[self.start : end]
                self.count += 1
                self.start = None

    def _before_root(self, kind: str, token: bytes) -> None:
        if kind == "pi":
            if token[:5] == b"<?xml" and token[5:6] in (b" ", b"\t", b"\r", b"\n", b"?") and (m := _ENCODING.search(token)):
                if (m[1] or m[2] or b"").lower() not in (b"utf-8", b"us-ascii"):
                    raise XmlError("Encoding")
        elif kind == "start":
            self.root = self._name(token, 1)
            utf8(self.root)
            self.merge(token)
            self.depth = 1
            self.finished = token[-2:] == b"/>"
        elif kind != "comment" and not (kind == "text" and not token.strip(SPACE)):
            raise self._bad()

    def merge(self, tag: bytes) -> None:
        """Take up the namespaces that a tag declares."""
        span = tag[1 + len(self._name(tag, 1)) : -1]
        try:
            self.namespaces |= namespaces(span)
        except XmlError as e:
            raise (self._bad() if e.kind == "Malformed" else e) from None

    def _open(self, tag: bytes) -> None:
        closed = tag[-2:] == b"/>"
        if self.skip or self.start is not None:
            if self.skip:
                self.skip += not closed
            else:
                self.depth += not closed
        elif self.depth == self.target:
            self.start = self.at
            self.depth += not closed
        elif self._name(tag, 1) == self.path[self.depth - 1]:
            self.merge(tag)
            self.depth += not closed
        else:
            self.skip = int(not closed)

    def _close(self, tag: bytes) -> None:
        if self.skip:
            self.skip -= 1
            return
        self.depth -= 1
        if not self.depth:
            if self._name(tag, 2) != self.root or self.start is not None:
                raise self._bad()
            self.finished = True

    def finish(self) -> Iterator[tuple[int, int, int, bytes]]:
        """The rest, after the last chunk."""
        self.ended = True
        yield from self.take()
        if not self.finished:
            raise self._bad()

    def prelude(self) -> dict:
        return {"encoding": "UTF-8", "root_name": self.root.decode() if self.root else None, "namespaces": list(self.namespaces.items()), "entities": list(self.entities.items())}
