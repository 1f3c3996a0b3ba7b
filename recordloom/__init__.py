"""Record-oriented XML on Spark: documents to records, events and typed rows as DataFrames."""

from .functions.errors import XmlError
from .functions.names import resolve_entity, resolve_namespace
from .operators.apply import for_each, map_collect, try_for_each, try_map_collect
from .operators.documents import counts, errors, events, index, preludes, records, sequential_events, sized, typed, workload
from .plans.options import XmlOptions
from .sources.documents import from_bytes, read_documents
from .streaming.source import read_record_stream, register_source, stream_for_each

__all__ = [
    "XmlError", "XmlOptions", "counts", "errors", "events", "for_each", "from_bytes", "index", "map_collect", "preludes", "read_documents",
    "read_record_stream", "records", "register_source", "resolve_entity", "resolve_namespace", "sequential_events", "sized", "stream_for_each", "try_for_each", "try_map_collect", "typed", "workload",
]
