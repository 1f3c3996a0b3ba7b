"""Errors of scanning and parsing."""

from __future__ import annotations

#: Spark type of an error column.
ERROR = "struct<kind:string,pos:bigint,rec_index:bigint,message:string>"


class XmlError(Exception):
    """kind: Malformed, Encoding, Io, UnsupportedDtd or RecordError."""

    def __init__(self, kind: str, pos: int | None = None, rec_index: int | None = None, cause: XmlError | str | None = None):
        self.kind, self.pos, self.rec_index, self.cause = kind, pos, rec_index, cause
        said = {
            "Malformed": f"malformed XML at byte {pos}",
            "Encoding": "unsupported encoding",
            "Io": f"I/O error: {cause}",
            "UnsupportedDtd": "unsupported DTD",
            "RecordError": f"error in record {rec_index}: {cause}",
        }
        super().__init__(said[kind])

    def row(self) -> dict:
        return {"kind": self.kind, "pos": self.pos, "rec_index": self.rec_index, "message": str(self)}
