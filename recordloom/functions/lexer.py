"""Tokens of XML bytes, entities and attributes.

One compiled pattern cuts markup and text; all repeated parts are possessive or lazy, so no input
makes it backtrack over a token."""

from __future__ import annotations

import re

from .errors import XmlError
from .names import PREDEFINED

SPACE = b" \t\r\n"
_QUOTED = rb"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+"""
TOKEN = re.compile(rb"(?P<comment><!--[\s\S]*?-->)|(?P<cdata><!\[CDATA\[[\s\S]*?\]\]>)|(?P<pi><\?[\s\S]*?\?>)|(?P<end></" + _QUOTED + rb">)|(?P<start><[A-Za-z_:\x80-\xff]" + _QUOTED + rb">)|(?P<text>[^<]++)")
NAME = re.compile(rb"[A-Za-z_:\x80-\xff][A-Za-z0-9_:.\x80-\xff-]*+")
_ATTRIBUTE = re.compile(rb"""[ \t\r\n]*+([^= \t\r\n"'/>]++)[ \t\r\n]*+=[ \t\r\n]*+(?:"([^"]*+)"|'([^']*+)')""")
_REFERENCE = re.compile(r"&([^;&]*+)(;?)")
_SUBSET = rb"""(?:"[^"]*+"|'[^']*+'|<!--[\s\S]*?-->|[^\]"'<]|<(?!!--))*+"""
_OUTER = rb"""(?:"[^"]*+"|'[^']*+'|<!--[\s\S]*?-->|[^\[>"'<]|<(?!!--))*+"""
DOCTYPE = re.compile(rb"<!DOCTYPE(?P<outer>" + _OUTER + rb")(?:\[(?P<subset>" + _SUBSET + rb")\](?P<after>[^>]*+))?>")
_ENTITY = re.compile(rb"""<!--[\s\S]*?-->|<!ENTITY[ \t\r\n]+(?:(%)|([^ \t\r\n"'>]++)[ \t\r\n]++(?:"([^"]*+)"|'([^']*+)')?)""")
_LOOSE_ENTITY = re.compile(rb"""<!ENTITY[ \t\r\n]+([^ \t\r\n"'>%]++)[ \t\r\n]++(?:"([^"]*+)"|'([^']*+)')""")


def utf8(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        raise XmlError("Encoding") from None


def unescape(text: str, entities: dict[str, str]) -> str:
    """References replaced in one pass: what they stand for is not looked at again. Raises KeyError if unknown."""
    if "&" not in text:
        return text

    def one(m: re.Match) -> str:
        name, closed = m.groups()
        if not closed:
            raise KeyError(name)
        if name[:1] == "#":
            try:
                code = int(name[2:], 16) if name[1:2] in "xX" else int(name[1:])
                if not code or 0xD800 <= code < 0xE000:
                    raise KeyError(name)
                return chr(code)
            except (ValueError, OverflowError):
                raise KeyError(name) from None
        return PREDEFINED[name] if name in PREDEFINED else entities[name]

    return _REFERENCE.sub(one, text)


def attributes(raw: bytes, entities: dict[str, str], rec_index: int = 0) -> list[dict]:
    """Ordered key and value pairs of an attribute span; keys are lexical and may repeat."""
    out, at = [], 0
    while True:
        rest = raw[at:].lstrip(SPACE)
        if not rest or rest[:1] == b"/":
            return out
        m = _ATTRIBUTE.match(raw, at)
        if not m:
            raise XmlError("Malformed", len(raw) - len(rest))
        value = utf8(m[2] if m[2] is not None else m[3])
        try:
            out.append({"key": utf8(m[1]), "value": unescape(value, entities)})
        except KeyError as e:
            raise XmlError("RecordError", rec_index=rec_index, cause=f"unknown entity {e.args[0]}") from None
        at = m.end()


def namespaces(raw: bytes) -> dict[str, str]:
    """xmlns declarations of a tag's attribute span: '' for the default one. URIs stay raw."""
    out, at = {}, 0
    if b"xmlns" not in raw and not raw.strip(SPACE + b"/"):
        return out
    while raw[at:].strip(SPACE + b"/"):
        m = _ATTRIBUTE.match(raw, at)
        if not m:
            raise XmlError("Malformed", at)
        key = utf8(m[1])
        if key == "xmlns" or key.startswith("xmlns:"):
            out[key[6:]] = utf8(m[2] if m[2] is not None else m[3])
        at = m.end()
    return out


def entities_of(doctype: re.Match, lenient: bool) -> dict[str, str]:
    """Entity declarations of a DOCTYPE; of equal names the last holds."""
    out = {}
    if lenient:
        for m in _LOOSE_ENTITY.finditer(doctype[0]):
            out[utf8(m[1])] = utf8(m[2] if m[2] is not None else m[3])
        return out
    outer = re.sub(rb"<!--[\s\S]*?-->", b"", doctype["outer"] + (doctype["after"] or b""))
    if b"SYSTEM" in outer or b"PUBLIC" in outer:
        raise XmlError("UnsupportedDtd")
    for m in _ENTITY.finditer(doctype["subset"] or b""):
        if m[0].startswith(b"<!--"):
            continue
        if m[1] or (m[3] is None and m[4] is None):
            raise XmlError("UnsupportedDtd")
        out[utf8(m[2])] = utf8(m[3] if m[3] is not None else m[4])
    return out
