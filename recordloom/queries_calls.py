"""Queries over the driver's tables through files, streams, SQL, entities and functions over records, and plain SQL for the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .functions.errors import XmlError
from .functions.names import resolve_entity, resolve_namespace
from .functions.udtf import register_udtf
from .operators.apply import for_each, map_collect, try_for_each, try_map_collect
from .operators.documents import counts, events, records, sized, typed
from .plans.options import XmlOptions
from .queries import by_key, doc_sql, documents, nth_sql, table
from .sources.documents import read_documents
from .streaming.source import read_record_stream, register_source


def written(docs: DataFrame, name: str) -> str:
    """A folder of the documents, each a file of its own, where all executors can read it."""
    spark = docs.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/recordloom/{name}-{uuid.uuid4().hex}"
    docs.write.partitionBy("doc_id").text(path)
    return path


def customer_documents(spark: SparkSession, sf_dir: str, head: str = "<r>") -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return documents(c, by_key("c_custkey"), "c_custkey", F.format_string('<c id="%d">%s</c>', "c_custkey", "c_name"), head)


def from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files, read whole."""
    found = records(read_documents(spark, written(customer_documents(spark, sf_dir), "whole") + "/*/*"))
    return typed(found, "_id long, _VALUE string").select(F.col("_id").alias("c_custkey"), F.col("_VALUE").alias("c_name"))


def from_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files, read in chunks of a few bytes, so that prolog, tags and texts are cut anywhere."""
    register_source(spark)
    path = written(customer_documents(spark, sf_dir, "<?xml version='1.0'?><!-- > --><!DOCTYPE r [<!ENTITY e 'x>'>]><r xmlns:p='urn:p'>"), "chunks")
    found = spark.read.format("xml_records").option("chunk", 7).load(path)
    keep = ["rec_index", resolve_entity(F.col("entities"), "e").alias("e"), resolve_namespace(F.col("namespaces"), "p").alias("p")]
    return typed(found, "_id long, _VALUE string", keep).select(F.col("_id").alias("c_custkey"), "rec_index", F.col("_VALUE").alias("c_name"), "e", "p")


def from_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files, read by a stream of records to its end."""
    name = f"stream_{uuid.uuid4().hex}"
    rows = read_record_stream(spark, written(customer_documents(spark, sf_dir), "stream"))
    typed(rows, "_id long, _VALUE string").writeStream.format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select(F.col("_id").alias("c_custkey"), "rec_index", F.col("_VALUE").alias("c_name"))


def from_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compressed documents, told by their first bytes."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([zstandard.compress(x.as_py().encode()) for x in b.column("content")], pa.binary())], ["doc_id", "content"])

    docs = customer_documents(spark, sf_dir).mapInArrow(packed, "doc_id long, content binary")
    return counts(docs).select("doc_id", "n_records", "is_empty")


def each_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function called for every record, where the record is."""
    n, at = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def seen(r: Row) -> None:
        n.add(1)
        at.add(r["rec_index"])

    for_each(records(customer_documents(spark, sf_dir)), seen)
    return spark.createDataFrame([(n.value, at.value)], "n long, indices long")


def ordered_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = records(sized(customer_documents(spark, sf_dir)))
    return map_collect(found, F.length("xml").cast("long").alias("size"))


def _failing(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column, Column]:
    """Rows, a number of each, and what is wrong with it."""
    c = table(spark, sf_dir, "customer")
    value = F.when(F.col("c_custkey") % 50 == 49, F.lit("none")).otherwise(F.col("c_custkey").cast("string"))
    rows = typed(records(documents(c, by_key("c_custkey"), "c_custkey", F.concat(F.lit("<c>"), value, F.lit("</c>")))), "_VALUE string")
    number = F.expr("try_cast(_VALUE as bigint)")
    return rows, number, F.when(number.isNull(), F.lit("not a number"))


def first_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first record, in document order, for which a function fails, by both fallible calls."""
    rows, number, error = _failing(spark, sf_dir)
    found = []
    for name, call in (("each", lambda: try_for_each(rows, error)), ("map", lambda: try_map_collect(rows, number, error))):
        try:
            call()
        except XmlError as e:
            found.append((name, e.kind, e.rec_index))
    return spark.createDataFrame(found, "call string, kind string, rec_index long")


def fallible_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, number, error = _failing(spark, sf_dir)
    return try_map_collect(rows.where("_VALUE <> 'none'"), number, error).select("doc_id", "rec_index", F.col("value").alias("c_custkey"))


def entities_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of a document with an external DTD, by lenient rules; predefined names come first."""
    r = table(spark, sf_dir, "region")
    docs = r.select(F.col("r_regionkey").cast("long").alias("doc_id"), F.format_string("<!DOCTYPE r SYSTEM 'r.dtd' [<!ENTITY name '%s'> <!ENTITY lt 'own'> <!ENTITY %% p 'q'>]><r><a>&name;&lt;</a></r>", "r_name").alias("content"))
    found = records(docs, XmlOptions(lenient=True))
    return found.select("doc_id", *(resolve_entity(F.col("entities"), n).alias(f"e_{n}") for n in ("name", "lt", "amp", "none")))


def entities_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed rows of records with entities: references are read once, predefined names keep their meaning."""
    c = table(spark, sf_dir, "customer")
    head = "<!DOCTYPE r [ <!ENTITY lt 'LT'> <!ENTITY seg 'a &amp;lt; b'> <!ENTITY q '\"<x>'> ]><r>"
    record = F.format_string("<c id='%d' at='&q;'><a>1 &lt; 2 &amp;lt; 3</a><b>&seg;</b><d><![CDATA[&seg;]]></d></c>", "c_custkey")
    found = typed(records(documents(c, by_key("c_custkey"), "c_custkey", record, head)), "_id long, _at string, a string, b string, d string")
    return found.select(F.col("_id").alias("c_custkey"), F.col("_at").alias("quoted"), "a", "b", "d")


def attrs_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    docs = documents(n, F.col("n_regionkey").cast("long"), "n_nationkey", F.format_string("<n key='%d' name = \"%s &amp; more\"><x/></n>", "n_nationkey", "n_name"))
    return events(docs).where("kind = 'Start' and name = 'n'").select("doc_id", "rec_index", "raw_attrs")


def sql_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by the SQL table function."""
    register_udtf(spark)
    view = f"documents_{uuid.uuid4().hex}"
    customer_documents(spark, sf_dir).createOrReplaceTempView(view)
    return spark.sql(f"SELECT d.doc_id, e.kind, count(*) AS n, max(e.attrs[0].value) AS last_id FROM {view} d, LATERAL xml_events(d.content, '', false) e GROUP BY d.doc_id, e.kind")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (from_files, from_chunks, from_stream, from_zstd, each_record, ordered_map, first_failure, fallible_map, entities_resolve, entities_typed, attrs_raw, sql_events)}

_DOC, _NTH = doc_sql("c_custkey"), nth_sql(doc_sql("c_custkey"), "c_custkey")
_REGION = "CAST(n_regionkey AS BIGINT)"
ORACLE_SQL = {
    "from_files": "SELECT c_custkey, c_name FROM customer",
    "from_chunks": f"SELECT c_custkey, {_NTH} AS rec_index, c_name, 'x>' AS e, 'urn:p' AS p FROM customer",
    "from_stream": f"SELECT c_custkey, {_NTH} AS rec_index, c_name FROM customer",
    "from_zstd": f"SELECT {_DOC} AS doc_id, count(*) AS n_records, false AS is_empty FROM customer GROUP BY 1",
    "each_record": f"SELECT count(*) AS n, CAST(sum(i) AS BIGINT) AS indices FROM (SELECT {_NTH} AS i FROM customer)",
    "ordered_map": f"SELECT {_DOC} AS doc_id, {_NTH} AS rec_index, CAST(length(c_name) + length(CAST(c_custkey AS VARCHAR)) + 13 AS BIGINT) AS size FROM customer",
    "first_failure": f"WITH r AS (SELECT {_DOC} AS d, {_NTH} AS i, c_custkey FROM customer) SELECT c.call AS call, 'RecordError' AS kind, (SELECT i FROM r WHERE c_custkey % 50 = 49 ORDER BY d, i LIMIT 1) AS rec_index FROM (VALUES ('each'), ('map')) c(call)",
    "fallible_map": f"SELECT d AS doc_id, i AS rec_index, c_custkey FROM (SELECT {_DOC} AS d, {_NTH} AS i, c_custkey FROM customer) WHERE c_custkey % 50 <> 49",
    "entities_resolve": "SELECT CAST(r_regionkey AS BIGINT) AS doc_id, r_name AS e_name, '<' AS e_lt, '&' AS e_amp, CAST(NULL AS VARCHAR) AS e_none FROM region",
    "entities_typed": "SELECT c_custkey, '\"<x>' AS quoted, '1 < 2 &lt; 3' AS a, 'a &amp;lt; b' AS b, '&seg;' AS d FROM customer",
    "attrs_raw": f"SELECT {_REGION} AS doc_id, {nth_sql('n_regionkey', 'n_nationkey')} AS rec_index, ' key=' || chr(39) || n_nationkey || chr(39) || ' name = \"' || n_name || ' &amp; more\"' AS raw_attrs FROM nation",
    "sql_events": f"SELECT {_DOC} AS doc_id, k.kind AS kind, count(*) AS n, CASE k.kind WHEN 'Start' THEN max(CAST(c_custkey AS VARCHAR)) END AS last_id FROM customer, (VALUES ('Start'), ('Text'), ('End')) k(kind) GROUP BY 1, 2",
}
