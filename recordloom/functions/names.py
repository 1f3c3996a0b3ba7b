"""Look-ups in the maps of a prelude, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The entities that every document has.
PREDEFINED = {"lt": "<", "gt": ">", "amp": "&", "apos": "'", "quot": '"'}


def resolve_namespace(namespaces: Column, prefix: Column | str) -> Column:
    """The URI of a prefix ('' is the default namespace); null if not declared."""
    return F.try_element_at(namespaces, prefix if isinstance(prefix, Column) else F.lit(prefix))


def resolve_entity(entities: Column, name: Column | str) -> Column:
    """An entity's text: predefined ones first, then the document's; null if unknown."""
    name = name if isinstance(name, Column) else F.lit(name)
    fixed = F.create_map(*(F.lit(x) for pair in PREDEFINED.items() for x in pair))
    return F.coalesce(F.try_element_at(fixed, name), F.try_element_at(entities, name))
