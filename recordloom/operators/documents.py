"""Operators over documents (doc_id, content): all are narrow maps, so a plan shuffles only where
the query that follows does. Rows leave a task in bounded Arrow batches as they are framed."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bulk
from ..functions.errors import ERROR, XmlError
from ..functions.events import events as parse
from ..functions.framing import Framer
from ..functions.names import PREDEFINED
from ..plans.options import XmlOptions
from ..sources.documents import inflated, rows_of

_BATCH = 4096
_ERROR = pa.struct([("kind", pa.string()), ("pos", pa.int64()), ("rec_index", pa.int64()), ("message", pa.string())])
_MAP = pa.map_(pa.string(), pa.string())
_ATTRS = pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))
_RANGE = [("rec_index", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]
_EVENT = [("ev_index", pa.int32()), ("kind", pa.string()), ("name", pa.string()), ("attrs", _ATTRS), ("text", pa.string()), ("depth", pa.int32()), ("raw_attrs", pa.string())]
_EVENT_DDL = "ev_index int, kind string, name string, attrs array<struct<key:string,value:string>>, text string, depth int, raw_attrs string"
_RANGE_DDL = "rec_index long, start long, end long"


def _emit(rows: Iterable[tuple], fields: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == _BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held, strict=True), fields, strict=True)], [n for n, _ in fields])
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held, strict=True), fields, strict=True)], [n for n, _ in fields])


def _scan(docs: DataFrame, each: Callable[[object, bytes], Iterator[tuple]], fields: list[tuple[str, pa.DataType]], ddl: str, options: XmlOptions | None = None, at_once: Callable[[bytes, bulk.Framed], list[pa.Array] | None] | None = None) -> DataFrame:
    """each: (doc_id, content) to rows that end with an error struct or None; at_once: the same rows of a document that bulk
    can frame, as columns, or None."""
    one = docs.select("doc_id", F.col("content").cast("binary").alias("content"))
    kind = one.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(n for n, _ in fields), "error"]

    def columns(content: bytes) -> list[pa.Array] | None:
        try:
            content = inflated(content)
        except XmlError:
            return None
        found = bulk.framed(content, options.record_path, options.lenient)
        return None if found is None else at_once(content, found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            fields_ = [("doc_id", id_type), *fields, ("error", _ERROR)]
            rest = []
            for i, content in rows_of(iter([batch])):
                found = columns(content) if at_once and len(content) >= bulk.LEAST_BYTES else None
                if found is None:
                    rest.append((i, content))
                    continue
                n = len(found[0])
                whole = pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(i, id_type), n), *found, pa.nulls(n, _ERROR)], names)
                for at in range(0, n, 4 * _BATCH):
                    yield whole.slice(at, 4 * _BATCH)
            yield from _emit(((i, *row) for i, content in rest for row in each(i, content)), fields_)

    return one.mapInArrow(run, f"doc_id {kind}, {ddl}, error {ERROR}")


def framed(content: bytes, options: XmlOptions) -> tuple[Framer, list[tuple[int, int, int, bytes]], XmlError | None]:
    """Resident rules: an error anywhere leaves no record; lenient ones keep those before it."""
    framer = Framer(options.record_path, options.lenient)
    found: list[tuple[int, int, int, bytes]] = []
    try:
        framer.push(inflated(content))
        found.extend(framer.take())
        found.extend(framer.finish())
    except XmlError as e:
        return framer, found if options.lenient else [], e
    return framer, found, None


def _checked(df: DataFrame, options: XmlOptions) -> DataFrame:
    """Without the error column: rows in error fail the query, or, if permissive, are left out."""
    if options.permissive:
        return df.where("error is null").drop("error")
    first = df.columns[0]
    said = F.concat(F.lit("XmlError "), F.col("error.kind"), F.lit(": "), F.col("error.message"))
    return df.withColumn(first, F.when(F.col("error").isNotNull(), F.raise_error(said).cast(df.schema[first].dataType)).otherwise(F.col(first))).drop("error")


def index(docs: DataFrame, options: XmlOptions = XmlOptions()) -> DataFrame:
    """doc_id, rec_index, start, end: byte ranges of the records in document order; nothing is parsed."""

    def each(_: object, content: bytes) -> Iterator[tuple]:
        _, found, error = framed(content, options)
        yield from ((i, a, b, None) for i, a, b, _ in found)
        if error:
            yield None, None, None, error.row()

    def at_once(_: bytes, f: bulk.Framed) -> list[pa.Array]:
        return [pa.array(range(len(f.first)), pa.int64()), pa.array(f.starts), pa.array(f.ends)]

    return _checked(_scan(docs, each, _RANGE, _RANGE_DDL, options, at_once), options)


def records(docs: DataFrame, options: XmlOptions = XmlOptions()) -> DataFrame:
    """doc_id, rec_index, start, end, xml, entities, namespaces."""

    def each(_: object, content: bytes) -> Iterator[tuple]:
        framer, found, error = framed(content, options)
        maps = [list(m.items()) for m in (framer.entities, framer.namespaces)]
        yield from ((i, a, b, x.decode("utf-8", "replace"), *maps, None) for i, a, b, x in found)
        if error:
            yield None, None, None, None, None, None, error.row()

    def at_once(content: bytes, f: bulk.Framed) -> list[pa.Array] | None:
        try:
            content.decode()
        except UnicodeDecodeError:
            return None
        n, starts, ends = len(f.first), f.starts, f.ends
        xml = pa.array([content[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.string())
        maps = [pa.repeat(pa.scalar(list(m.items()), _MAP), n) if m else pa.MapArray.from_arrays(pa.array([0] * (n + 1), pa.int32()), *(pa.array([], pa.string()),) * 2) for m in (f.framer.entities, f.framer.namespaces)]
        return [pa.array(range(n), pa.int64()), pa.array(starts), pa.array(ends), xml, *maps]

    fields = [*_RANGE, ("xml", pa.string()), ("entities", _MAP), ("namespaces", _MAP)]
    return _checked(_scan(docs, each, fields, f"{_RANGE_DDL}, xml string, entities map<string,string>, namespaces map<string,string>", options, at_once), options)


def preludes(docs: DataFrame, options: XmlOptions = XmlOptions()) -> DataFrame:
    """doc_id, encoding, root_name, namespaces, entities, n_records; a row for each document without an error."""

    def each(_: object, content: bytes) -> Iterator[tuple]:
        framer, found, error = framed(content, options)
        yield (*framer.prelude().values(), len(found), error.row() if error else None)

    def at_once(_: bytes, f: bulk.Framed) -> list[pa.Array]:
        return [pa.array([v], t) for v, (_, t) in zip((*f.framer.prelude().values(), len(f.first)), fields, strict=True)]

    fields = [("encoding", pa.string()), ("root_name", pa.string()), ("namespaces", _MAP), ("entities", _MAP), ("n_records", pa.int64())]
    return _checked(_scan(docs, each, fields, "encoding string, root_name string, namespaces map<string,string>, entities map<string,string>, n_records long", options, at_once), options)


def sized(docs: DataFrame, options: XmlOptions = XmlOptions()) -> DataFrame:
    """docs in one partition where they have fewer bytes than parallel_threshold or fewer records than min_records, so that one
    task reads them; else as they are. The rows are the same. Counts bytes, and records where there are bytes enough."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("content")), F.lit(0))).first()[0]
    few = size < options.parallel_threshold or (counts(docs, options).agg(F.coalesce(F.sum("n_records"), F.lit(0))).first()[0] < options.min_records)
    return docs.coalesce(1) if few else docs


def counts(docs: DataFrame, options: XmlOptions = XmlOptions()) -> DataFrame:
    """doc_id, n_records, is_empty; documents without records too."""
    return preludes(docs, options).select("doc_id", "n_records", (F.col("n_records") == 0).alias("is_empty"))


def events(docs: DataFrame, options: XmlOptions = XmlOptions()) -> DataFrame:
    """doc_id, rec_index, ev_index, kind, name, attrs, text, depth, raw_attrs: framed and parsed in one pass.

    A record in error gives no event after the error's place; the others are not touched."""

    def each(_: object, content: bytes) -> Iterator[tuple]:
        framer, found, error = framed(content, options)
        for i, _, _, x in found:
            try:
                for n, e in enumerate(parse(x, framer.entities, i)):
                    yield (i, n, *e, None)
            except XmlError as e:
                yield (i, *[None] * 7, {**e.row(), "rec_index": i})
        if error:
            yield (*[None] * 8, error.row())

    return _checked(_scan(docs, each, [_RANGE[0], *_EVENT], f"rec_index long, {_EVENT_DDL}", options, bulk.events), options)


def sequential_events(docs: DataFrame, options: XmlOptions = XmlOptions()) -> DataFrame:
    """Events of whole documents, root and text beside it included; rec_index is null."""

    def each(_: object, content: bytes) -> Iterator[tuple]:
        try:
            for n, e in enumerate(parse(inflated(content), {}, 0, whole=True)):
                yield (None, n, *e, None)
        except XmlError as e:
            yield (*[None] * 8, e.row())

    return _checked(_scan(docs, each, [_RANGE[0], *_EVENT], f"rec_index long, {_EVENT_DDL}"), options)


def errors(docs: DataFrame, options: XmlOptions = XmlOptions(), parse_records: bool = True) -> DataFrame:
    """doc_id, kind, pos, rec_index, message: a row for each error, of documents and, if asked, of records."""

    def each(_: object, content: bytes) -> Iterator[tuple]:
        framer, found, error = framed(content, options)
        if error:
            yield (error.row(),)
        for i, _, _, x in found if parse_records else ():
            try:
                for _ in parse(x, framer.entities, i):
                    pass
            except XmlError as e:
                yield ({**e.row(), "rec_index": i},)

    one = docs.select("doc_id", F.col("content").cast("binary").alias("content"))
    kind = one.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = ((i, *r) for i, c in rows_of(iter([batch])) for r in each(i, c))
            yield from _emit(rows, [("doc_id", batch.schema.field("doc_id").type), ("error", _ERROR)])

    return one.mapInArrow(run, f"doc_id {kind}, error {ERROR}").select("doc_id", "error.*")


def workload(docs: DataFrame, options: XmlOptions = XmlOptions()) -> DataFrame:
    """doc_id, rec_index, size: bytes of start names, attribute values, texts and CDATA of each record."""

    def each(_: object, content: bytes) -> Iterator[tuple]:
        framer, found, error = framed(content, options)
        if error:
            yield None, None, error.row()
        for i, _, _, x in found:
            try:
                size = 0
                for kind, name, attrs, text, _, _ in parse(x, framer.entities, i):
                    size += len(name.encode()) if kind == "Start" else len((text or "").encode())
                    for a in attrs or ():
                        size += len(a["value"].encode())
                yield i, size, None
            except XmlError as e:
                yield i, None, {**e.row(), "rec_index": i}

    def at_once(content: bytes, f: bulk.Framed) -> list[pa.Array] | None:
        size = bulk.sizes(content, f)
        return None if size is None else [pa.array(range(len(size)), pa.int64()), pa.array(size)]

    return _checked(_scan(docs, each, [_RANGE[0], ("size", pa.int64())], "rec_index long, size long", options, at_once), options)


def expanded(xml: Column, entities: Column) -> Column:
    """xml with references to a document's own entities replaced by their text, escaped, in one pass: what they stand for is
    not looked at again, predefined names keep their meaning, and CDATA, comments and processing instructions stay as they are."""
    token = r"(?s)<!\[CDATA\[.*?\]\]>|<!--.*?-->|<\?.*?\?>|<?[^<]+|<"

    def said(value: Column) -> Column:
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
            value = F.replace(value, F.lit(a), F.lit(b))
        return value

    def one(part: Column) -> Column:
        name = F.substring_index(part, ";", 1)
        known = (F.instr(part, ";") > 0) & ~name.isin(*PREDEFINED) & F.map_contains_key(entities, name)
        return F.when(known, F.concat(said(F.try_element_at(entities, name)), F.substr(part, F.length(name) + 2))).otherwise(F.concat(F.lit("&"), part))

    def text(t: Column) -> Column:
        parts = F.split(t, "&", -1)
        return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), one), ""))

    raw = lambda t: t.startswith("<![CDATA[") | t.startswith("<!--") | t.startswith("<?")
    tokens = F.regexp_extract_all(xml, F.lit(f"({token})"), 1)
    return F.when((F.size(entities) > 0) & xml.contains("&"), F.array_join(F.transform(tokens, lambda t: F.when(raw(t), t).otherwise(text(t))), "")).otherwise(xml)


def typed(found: DataFrame, schema: str, keep: list[str | Column] | None = None, permissive: bool = False) -> DataFrame:
    """Columns of a schema from records() by the native XML functions; character data is what the native reader makes of it
    (trimmed). A record that it can't read fails the query, or, if permissive, has nulls."""
    mode = {"mode": "PERMISSIVE" if permissive else "FAILFAST"}
    xml = expanded(F.col("xml"), F.col("entities"))
    rows = found.select(*(keep or ["doc_id", "rec_index"]), F.from_xml(xml, schema, mode).alias("from_xml"))
    return rows.select(*(F.col(f"`{c}`") for c in rows.columns[:-1]), "from_xml.*")
