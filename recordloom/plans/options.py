"""Options of a scan."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class XmlOptions:
    """record_path: names of nested containers under the root whose children are records.

    lenient: the rules of incremental reading: external DTDs are ignored, what follows the root is
    not looked at, and records before a malformed place are kept. permissive: errors become rows
    of errors() instead of failing the query. parallel_threshold (bytes) and min_records: below either,
    sized() puts documents in one partition."""

    record_path: tuple[str, ...] = ()
    lenient: bool = False
    permissive: bool = False
    parallel_threshold: int = 4 << 20
    min_records: int = 64

    def with_path(self, *names: str) -> XmlOptions:
        return replace(self, record_path=names)
