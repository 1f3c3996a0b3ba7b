"""xml_events(content, record_path, lenient): events as a SQL table function."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


class XmlEvents:
    def eval(self, content: str, record_path: str, lenient: bool = False) -> Iterator[tuple]:
        from recordloom.functions.events import events
        from recordloom.operators.documents import framed
        from recordloom.plans.options import XmlOptions

        framer, found, error = framed((content or "").encode(), XmlOptions(tuple(x for x in (record_path or "").split("/") if x), bool(lenient)))
        if error and not lenient:
            raise error
        for i, _, _, x in found:
            for n, (kind, name, attrs, text, depth, _) in enumerate(events(x, framer.entities, i)):
                yield i, n, kind, name, attrs, text, depth


def register_udtf(spark: SparkSession) -> None:
    spark.udtf.register("xml_events", udtf(XmlEvents, returnType="rec_index long, ev_index int, kind string, name string, attrs array<struct<key:string,value:string>>, text string, depth int"))
