"""Events of a record or of a whole document: Start, End, Text and Cdata in document order.

Comments and processing instructions are dropped but part a text in two; an empty element gives
Start and End; CDATA is not decoded."""

from __future__ import annotations

from collections.abc import Iterator

from .errors import XmlError
from .lexer import DOCTYPE, NAME, TOKEN, attributes, entities_of, unescape, utf8

#: kind, name, attrs, text, depth, raw
Event = tuple[str, str | None, list[dict] | None, str | None, int, str | None]
_EMPTY: list[dict] = []


def events(xml: bytes, entities: dict[str, str], rec_index: int = 0, whole: bool = False) -> Iterator[Event]:
    """whole: a document; its DOCTYPE's entities are taken up on the way, leniently."""
    at, stack, n = (3 if whole and xml[:3] == b"\xef\xbb\xbf" else 0), [], len(xml)
    entities = dict(entities) if whole else entities
    wrong = lambda why: XmlError("Malformed", at) if whole and why == "syntax" else XmlError("RecordError", rec_index=rec_index, cause=why)
    while at < n:
        m = TOKEN.match(xml, at) or (DOCTYPE.match(xml, at) if whole else None)
        if not m:
            raise wrong("syntax")
        kind, token = m.lastgroup, m[0]
        if "outer" in m.re.groupindex:
            entities |= entities_of(m, True)
        elif kind == "text":
            try:
                text = unescape(utf8(token), entities)
            except KeyError as e:
                raise wrong(f"unknown entity {e.args[0]}") from None
            except XmlError:
                raise wrong("invalid UTF-8") from None
            yield "Text", None, None, text, len(stack), None
        elif kind == "start":
            name = NAME.match(token, 1)
            closed = token[-2:] == b"/>"
            raw = token[name.end() : -2 if closed else -1]
            said = utf8(name[0])
            yield "Start", said, attributes(raw, entities, rec_index) if raw.strip() else _EMPTY, None, len(stack), raw.decode("utf-8", "replace")
            if closed:
                yield "End", said, None, None, len(stack), None
            else:
                stack.append(name[0])
        elif kind == "end":
            name = token[2:-1].rstrip(b" \t\r\n")
            if not stack or stack.pop() != name:
                raise wrong("syntax")
            yield "End", utf8(name), None, None, len(stack), None
        elif kind == "cdata":
            yield "Cdata", None, None, token[9:-3].decode("utf-8", "replace"), len(stack), None
        at = m.end()
    if stack:
        raise wrong("syntax")
