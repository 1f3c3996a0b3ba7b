"""Queries over the driver's tables: XML is written from a table by column expressions, run through
the operators, and compared with plain SQL over the table. Documents hold DOC_KEYS keys each, so
their number, not their size, grows with the data (those of nations and regions, of which there is a
fixed number, aside)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.names import resolve_namespace
from .operators.documents import counts, errors, events, index, preludes, records, sequential_events, typed, workload
from .plans.options import XmlOptions

DOC_KEYS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def documents(df: DataFrame, doc: Column, order: str, record: Column, head: str = "<r>", tail: str = "</r>", between: str = "") -> DataFrame:
    """doc_id and content: records of a document in order inside head and tail."""
    parts = df.select(doc.alias("doc_id"), F.col(order).alias("o"), record.alias("x")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("o", "x"))).alias("xs"))
    return parts.select("doc_id", F.concat(F.lit(head), F.array_join(F.col("xs.x"), between), F.lit(tail)).alias("content"))


def by_key(name: str) -> Column:
    return F.floor(F.col(name) / DOC_KEYS).cast("long")


def attr(name: str) -> Column:
    return F.expr(f"filter(attrs, a -> a.key = '{name}')[0].value")


def order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    record = F.format_string('<order id="%d" cust="%d"><price>%s</price><status>%s</status></order>', "o_orderkey", "o_custkey", F.col("o_totalprice").cast("string"), "o_orderstatus")
    return documents(o, by_key("o_orderkey"), "o_orderkey", record, "<trades>\n", "\n</trades>", "\n")


def trades_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame, parse, cast and sum."""
    found = records(order_documents(spark, sf_dir))
    rows = typed(found, "_id long, price double, status string")
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("total"), F.max("_id").alias("last_id"))


def frame_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts(order_documents(spark, sf_dir)).select("doc_id", "n_records")


def frame_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = index(documents(table(spark, sf_dir, "customer"), by_key("c_custkey"), "c_custkey", F.format_string("<c>%s é</c>", "c_name")))
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("start").alias("first_start"), F.sum(F.col("end") - F.col("start")).alias("bytes"), F.max("end").alias("last_end"))


def records_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = events(order_documents(spark, sf_dir)).where("kind = 'Start' and name = 'order'")
    return found.select("doc_id", "rec_index", attr("id").cast("long").alias("o_orderkey"))


def record_path_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records two containers down, beside decoys of the same names."""
    c = table(spark, sf_dir, "customer")
    head = "<root><manifest><objects><object>decoy</object></objects> free text</manifest><body><note a='>'/><objects>"
    docs = documents(c, by_key("c_custkey"), "c_custkey", F.format_string("<p:object><id>%d</id></p:object>", "c_custkey"), head, "</objects><objects/></body><objects><object/></objects></root>")
    found = typed(records(docs, XmlOptions(("body", "objects"))), "id long")
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("id").alias("ids"), F.max("rec_index").alias("last_index"))


def multi_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    docs = documents(s, by_key("s_suppkey"), "s_suppkey", F.format_string("<o xmlns:k='urn:%d'><s>%d</s></o>", "s_nationkey", "s_suppkey"), "<root>", "</root>")
    found = typed(records(docs, XmlOptions(("o",))), "_VALUE long")
    return found.select("doc_id", "rec_index", F.col("_VALUE").alias("s_suppkey"))


def lookalikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    record = F.format_string("<!-- <p>no</p> --><p q='a > b'>%d</p><?p <p>no</p>?><![CDATA[</r><p>no</p>]]>", "p_partkey")
    return counts(documents(p, by_key("p_partkey"), "p_partkey", record)).select("doc_id", "n_records")


def self_closing_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    found = events(documents(n, F.col("n_regionkey").cast("long"), "n_nationkey", F.format_string('<nation key="%d" name = \'%s\' />', "n_nationkey", "n_name")))
    return found.where("kind = 'Start'").select("doc_id", "rec_index", attr("key").cast("int").alias("n_nationkey"), attr("name").alias("n_name"))


def attrs_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    name = F.concat("p_name", F.lit(" & \"<'>"))
    found = events(documents(p, by_key("p_partkey"), "p_partkey", F.concat(F.lit('<p id="'), F.col("p_partkey").cast("string"), F.lit('" name="'), escaped(name), F.lit('"/>'))))
    return found.where("kind = 'Start'").select(attr("id").cast("long").alias("p_partkey"), attr("name").alias("name"))


def text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    docs = documents(d, by_key("doc_id"), "doc_id", F.concat(F.lit("<d id='"), F.col("doc_id").cast("string"), F.lit("'>"), escaped(F.col("text")), F.lit("</d>")))
    found = events(docs).groupBy(F.col("doc_id").alias("part"), "rec_index").agg(F.max(attr("id").cast("long")).alias("doc_id"), F.max("text").alias("text"))
    return found.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def char_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    coded = F.array_join(F.transform(F.split("s_name", ""), lambda c: F.concat(F.lit("&#"), F.ascii(c).cast("string"), F.lit(";"))), "")
    docs = documents(s, by_key("s_suppkey"), "s_suppkey", F.concat(F.lit("<s>"), coded, F.lit("&#x1F600;&#233;</s>")))
    return events(docs).where("kind = 'Text'").select("doc_id", "rec_index", F.col("text").alias("s_name"))


def custom_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    head = '<!DOCTYPE r [ <!ENTITY seg0 "old"> <!ENTITY seg1 \'MACHINERY &amp; more\'> <!ENTITY seg0 "BUILDING"> ]><r>'
    ref = F.when(F.col("c_mktsegment") == "BUILDING", "&seg0;").when(F.col("c_mktsegment") == "MACHINERY", "&seg1;").otherwise("&lt;other&gt;")
    docs = documents(c, by_key("c_custkey"), "c_custkey", F.concat(F.lit("<c>"), ref, F.lit("</c>")), head)
    return events(docs).where("kind = 'Text'").groupBy("text").agg(F.count("*").alias("n"))


def cdata_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    docs = documents(e, by_key("event_id"), "event_id", F.concat(F.lit("<e>"), F.lit("<![CDATA["), F.coalesce("props", F.lit("")), F.lit("&amp;<x>]]></e>")))
    return events(docs).where("kind = 'Cdata'").select("doc_id", "rec_index", F.col("text").alias("props"))


def text_run_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    docs = documents(n, F.col("n_regionkey").cast("long"), "n_nationkey", F.format_string("<n>%s &amp; more<!-- c -->%d<?pi?>&lt;end</n>", "n_name", "n_nationkey"))
    return events(docs).where("kind = 'Text'").select("doc_id", "rec_index", "ev_index", "text")


def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(order_documents(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("n"))


def seq_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    docs = documents(n, F.col("n_regionkey").cast("long"), "n_nationkey", F.format_string("<n>%s</n>", "n_name"), "<r> ", "</r>")
    return sequential_events(docs).groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.max("depth").alias("depth"))


def namespaces_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region")
    docs = r.select(F.col("r_regionkey").cast("long").alias("doc_id"), F.format_string("<r xmlns='urn:d' xmlns:p='urn:%s'><o xmlns:q=\"urn:q\"><a/></o></r>", "r_name").alias("content"))
    found = preludes(docs, XmlOptions(("o",)))
    names = {"d": "", "p": "p", "q": "q", "z": "z"}
    return found.select("doc_id", *(resolve_namespace(F.col("namespaces"), p).alias(f"uri_{n}") for n, p in names.items()))


def prelude_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region")
    docs = r.select(F.col("r_regionkey").cast("long").alias("doc_id"), F.concat(F.lit('﻿<?xml version="1.0" encoding="utf-8"?><!-- x --><root_'), F.col("r_regionkey").cast("string"), F.lit("/>")).alias("content"))
    return preludes(docs).select("doc_id", "encoding", "root_name", "n_records")


def bad_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    record = F.when(F.col("c_custkey") % 7 == 0, "<c><a></b></c>").when(F.col("c_custkey") % 11 == 0, "<c>&nope;</c>").otherwise("<c>x</c>")
    found = errors(documents(c, by_key("c_custkey"), "c_custkey", record))
    return found.groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.min("rec_index").alias("first_index"))


def bad_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    made = ["<r><a/></r>", "<r><a>", "<r><a/></x>", "<r>junk<a/></r>", "<!DOCTYPE r SYSTEM 'x'><r/>", "<?xml version='1.0' encoding='ISO-8859-1'?><r/>", "", "<r/>x"]
    docs = n.select(F.col("n_nationkey").cast("long").alias("doc_id"), F.element_at(F.array(*map(F.lit, made)), F.col("n_nationkey") % 8 + 1).alias("content"))
    return errors(docs).select("doc_id", "kind")


def typed_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    record = F.format_string("<l><q>%s</q><p>%s</p><f>%s</f></l>", F.col("l_quantity").cast("string"), F.col("l_extendedprice").cast("string"), "l_returnflag")
    docs = documents(li.withColumn("n", F.col("l_orderkey") * 10 + F.col("l_linenumber")), by_key("l_orderkey"), "n", record)
    rows = typed(records(docs), "q double, p double, f string")
    return rows.groupBy(F.col("f").alias("l_returnflag")).agg(F.round(F.sum("q"), 2).alias("sum_qty"), F.round(F.sum("p"), 1).alias("sum_price"), F.count("*").alias("n"))


def join_after_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = typed(records(order_documents(spark, sf_dir)), "_id long, _cust long, price double")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return rows.join(c, F.col("_cust") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("price"), 1).alias("total"))


def workload_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    record = F.format_string('<order id="%d" cust="%d"><price>%.2f</price><status>%s</status></order>', "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    return workload(documents(o, by_key("o_orderkey"), "o_orderkey", record, "<trades>\n", "\n</trades>", "\n")).groupBy("doc_id").agg(F.sum("size").alias("bytes"))


def lenient_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incremental rules: what follows the root, and an external DTD, do no harm."""
    docs = order_documents(spark, sf_dir).select("doc_id", F.concat(F.lit("<!DOCTYPE trades SYSTEM 'x.dtd'>"), F.col("content"), F.lit("<junk")).alias("content"))
    return counts(docs, XmlOptions(lenient=True, permissive=True)).select("doc_id", "n_records")


_ORDER_DOC = f"CAST(floor(o_orderkey / {DOC_KEYS}.0) AS BIGINT)"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (trades_xml, frame_count, frame_ranges, records_in_order, record_path_two, multi_container, lookalikes, self_closing_records, attrs_decode, text_roundtrip, char_refs, custom_entities, cdata_raw, text_run_breaks, event_counts, seq_events, namespaces_resolve, prelude_rows, bad_records, bad_documents, typed_agg, join_after_parse, workload_checksum, lenient_frame)
}


def doc_sql(key: str) -> str:
    return f"CAST(floor({key} / {DOC_KEYS}.0) AS BIGINT)"


def nth_sql(doc: str, key: str) -> str:
    return f"CAST(row_number() OVER (PARTITION BY {doc} ORDER BY {key}) - 1 AS BIGINT)"


_REGION = "CAST(n_regionkey AS BIGINT)"
ORACLE_SQL = {
    "trades_xml": "SELECT o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total, max(o_orderkey) AS last_id FROM orders GROUP BY 1",
    "frame_count": f"SELECT {_ORDER_DOC} AS doc_id, count(*) AS n_records FROM orders GROUP BY 1",
    "frame_ranges": f"SELECT {doc_sql('c_custkey')} AS doc_id, count(*) AS n, CAST(3 AS BIGINT) AS first_start, CAST(sum(strlen(c_name) + 10) AS BIGINT) AS bytes, CAST(3 + sum(strlen(c_name) + 10) AS BIGINT) AS last_end FROM customer GROUP BY 1",
    "records_in_order": f"SELECT {_ORDER_DOC} AS doc_id, {nth_sql(_ORDER_DOC, 'o_orderkey')} AS rec_index, o_orderkey FROM orders",
    "record_path_two": f"SELECT {doc_sql('c_custkey')} AS doc_id, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS ids, count(*) - 1 AS last_index FROM customer GROUP BY 1",
    "multi_container": f"SELECT {doc_sql('s_suppkey')} AS doc_id, {nth_sql(doc_sql('s_suppkey'), 's_suppkey')} AS rec_index, s_suppkey FROM supplier",
    "lookalikes": f"SELECT {doc_sql('p_partkey')} AS doc_id, count(*) AS n_records FROM part GROUP BY 1",
    "self_closing_records": f"SELECT {_REGION} AS doc_id, {nth_sql('n_regionkey', 'n_nationkey')} AS rec_index, n_nationkey, n_name FROM nation",
    "attrs_decode": "SELECT p_partkey, p_name || ' & \"<''>' AS name FROM part",
    "text_roundtrip": "SELECT doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents",
    "char_refs": f"SELECT {doc_sql('s_suppkey')} AS doc_id, {nth_sql(doc_sql('s_suppkey'), 's_suppkey')} AS rec_index, s_name || chr(128512) || chr(233) AS s_name FROM supplier",
    "custom_entities": "SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 'BUILDING' WHEN 'MACHINERY' THEN 'MACHINERY &amp; more' ELSE '<other>' END AS text, count(*) AS n FROM customer GROUP BY 1",
    "cdata_raw": f"SELECT {doc_sql('event_id')} AS doc_id, {nth_sql(doc_sql('event_id'), 'event_id')} AS rec_index, coalesce(props, '') || '&amp;<x>' AS props FROM events",
    "text_run_breaks": f"WITH n AS (SELECT {_REGION} AS doc_id, {nth_sql('n_regionkey', 'n_nationkey')} AS rec_index, n_name, n_nationkey FROM nation) SELECT doc_id, rec_index, CAST(1 AS INTEGER) AS ev_index, n_name || ' & more' AS text FROM n UNION ALL SELECT doc_id, rec_index, CAST(2 AS INTEGER), CAST(n_nationkey AS VARCHAR) FROM n UNION ALL SELECT doc_id, rec_index, CAST(3 AS INTEGER), '<end' FROM n",
    "event_counts": "SELECT 'Start' AS kind, 3 * count(*) AS n FROM orders UNION ALL SELECT 'End', 3 * count(*) FROM orders UNION ALL SELECT 'Text', 2 * count(*) FROM orders",
    "seq_events": f"SELECT {_REGION} AS doc_id, k.kind AS kind, count(*) + 1 AS n, CAST(max(k.depth) AS INTEGER) AS depth FROM nation, (VALUES ('Start', 1), ('End', 1), ('Text', 2)) k(kind, depth) GROUP BY 1, 2",
    "namespaces_resolve": "SELECT CAST(r_regionkey AS BIGINT) AS doc_id, 'urn:d' AS uri_d, 'urn:' || r_name AS uri_p, 'urn:q' AS uri_q, CAST(NULL AS VARCHAR) AS uri_z FROM region",
    "prelude_rows": "SELECT CAST(r_regionkey AS BIGINT) AS doc_id, 'UTF-8' AS encoding, 'root_' || r_regionkey AS root_name, CAST(0 AS BIGINT) AS n_records FROM region",
    "bad_records": f"WITH c AS (SELECT {doc_sql('c_custkey')} AS doc_id, {nth_sql(doc_sql('c_custkey'), 'c_custkey')} AS i, c_custkey FROM customer) SELECT doc_id, 'RecordError' AS kind, count(*) AS n, min(i) AS first_index FROM c WHERE c_custkey % 7 = 0 OR c_custkey % 11 = 0 GROUP BY 1",
    "bad_documents": "SELECT CAST(n_nationkey AS BIGINT) AS doc_id, CASE n_nationkey % 8 WHEN 4 THEN 'UnsupportedDtd' WHEN 5 THEN 'Encoding' ELSE 'Malformed' END AS kind FROM nation WHERE n_nationkey % 8 <> 0",
    "typed_agg": "SELECT l_returnflag, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 1) AS sum_price, count(*) AS n FROM lineitem GROUP BY 1",
    "join_after_parse": "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 1) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
    # Names take 16 bytes: order, price, status.
    "workload_checksum": f"SELECT {_ORDER_DOC} AS doc_id, CAST(sum(16 + length(CAST(o_orderkey AS VARCHAR)) + length(CAST(o_custkey AS VARCHAR)) + length(CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR)) + length(o_orderstatus)) AS BIGINT) AS bytes FROM orders GROUP BY 1",
    "lenient_frame": f"SELECT {_ORDER_DOC} AS doc_id, count(*) AS n_records FROM orders GROUP BY 1",
}
