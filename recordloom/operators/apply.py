"""Functions over records: unordered, in document order, and fallible."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.errors import XmlError

ORDER = ["doc_id", "rec_index"]


def for_each(found: DataFrame, function: Callable[[Row], None]) -> None:
    """Call a function for every row where the row is; no order."""

    def run(rows: object) -> None:
        for r in rows:
            function(r)

    found.foreachPartition(run)


def map_collect(found: DataFrame, *columns: Column | str) -> DataFrame:
    """Expressions over rows, in document order."""
    return found.select(*ORDER, *columns).orderBy(*ORDER)


def try_map_collect(found: DataFrame, value: Column, error: Column) -> DataFrame:
    """doc_id, rec_index, value in document order. Where error is not null for a row, the row with the
    least doc_id and rec_index is raised as XmlError instead."""
    rows = found.select(*ORDER, value.alias("value"), error.alias("said"))
    first = rows.where("said is not null").orderBy(*ORDER).limit(1).collect()
    if first:
        raise XmlError("RecordError", rec_index=first[0]["rec_index"], cause=first[0]["said"])
    return rows.drop("said").orderBy(*ORDER)


def try_for_each(found: DataFrame, error: Column) -> None:
    """Evaluate an error expression for every row; the first that is not null, by order, is raised."""
    first = found.select(*ORDER, error.alias("said")).where("said is not null").orderBy(*ORDER).limit(1).collect()
    if first:
        raise XmlError("RecordError", rec_index=first[0]["rec_index"], cause=first[0]["said"])


def as_written(events: DataFrame) -> DataFrame:
    """doc_id, rec_index, said: events in short form, S:name E:name T:text C:cdata."""
    mark = F.concat(F.substring("kind", 1, 1), F.lit(":"), F.coalesce("name", "text"))
    return events.groupBy(*ORDER).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ev_index", mark.alias("s")))), lambda x: x["s"]), " ").alias("said"))
