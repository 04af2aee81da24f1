"""Stage documents whose fields drift: JSON as VARIANT, read by declared kinds.

Stages write a JSON document per scan, and versions differ: fields are missing,
null, or of another type. Documents are parsed once to VARIANT; every field is
then taken by path as the kind that is declared for it, with a state that says
why it has its value, and a default where it has none. Nothing is inferred
from a sample and no schema has to be changed when documents do.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of a field: its SQL type, and how the types of values that are taken for it begin. Numbers are taken for text, never text for numbers.
KINDS = {
    "long": ("bigint", ("BIGINT",)),
    "double": ("double", ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT")),
    "boolean": ("boolean", ("BOOLEAN",)),
    "string": ("string", ("STRING", "BIGINT", "DOUBLE", "DECIMAL", "FLOAT")),
    "object": ("variant", ("OBJECT",)),
    "array": ("variant", ("ARRAY",)),
}


@dataclass(frozen=True)
class Field:
    """One field of a document: its path, its kind, and the value where a document has none of that kind."""

    name: str
    path: str
    kind: str
    default: Any = None


def parsed(rows: DataFrame, column: str = "document") -> DataFrame:
    """``rows`` with ``document`` as VARIANT and ``readable``; null and broken text is a null document that isn't readable."""
    return rows.withColumn(column, F.try_parse_json(F.col(column).cast("string"))).withColumn("readable", F.col(column).isNotNull())


def state(document: Column, field: Field) -> Column:
    """'ok', 'missing', 'null' or 'mistyped': what a document holds at a field's path."""
    found = F.variant_get(document, field.path, "variant")
    kind = F.schema_of_variant(found)
    fits = [kind.startswith(k) for k in KINDS[field.kind][1]]
    ok = fits[0]
    for other in fits[1:]:
        ok = ok | other
    return F.when(found.isNull(), "missing").when(F.is_variant_null(found), "null").when(ok, "ok").otherwise("mistyped")


def value(document: Column, field: Field) -> Column:
    """A field's value as its kind, the default where it isn't there or isn't of that kind."""
    kind = KINDS[field.kind][0]
    taken = F.when(state(document, field) == "ok", F.try_variant_get(document, field.path, kind))
    if field.default is None:
        return taken
    standing = F.parse_json(F.lit(field.default)) if kind == "variant" else F.lit(field.default).cast(kind)
    return F.coalesce(taken, standing)


def fields(documents: DataFrame, wanted: list[Field], column: str = "document") -> DataFrame:
    """``documents`` with each field's value and ``<name>_state`` in place of the document."""
    document = F.col(column)
    taken = [c for f in wanted for c in (value(document, f).alias(f.name), state(document, f).alias(f"{f.name}_state"))]
    return documents.select(*(c for c in documents.columns if c != column), *taken)


def items(documents: DataFrame, path: str, wanted: list[Field], keys: list[str], column: str = "document") -> DataFrame:
    """(keys..., pos, fields...): one row an element of the array at ``path``, with the fields of each.

    A document without that array gives no row; an element that isn't an
    object gives one whose fields are missing.
    """
    array = value(F.col(column), Field("items", path, "array"))
    held = documents.select(*keys, array.alias("_items")).filter("_items is not null")
    each = held.lateralJoin(held.sparkSession.tvf.variant_explode(F.col("_items").outer())).select(*keys, F.col("pos").cast("long").alias("pos"), F.col("value").alias("_item"))
    return fields(each, wanted, "_item")


def drift(documents: DataFrame, wanted: list[Field], by: list[str], column: str = "document") -> DataFrame:
    """(by..., field, n, ok, missing, nulls, mistyped): how many documents hold each field, in one pass."""
    document = F.col(column)
    states = F.array(*(F.struct(F.lit(f.name).alias("field"), state(document, f).alias("state")) for f in wanted))
    each = documents.select(*by, F.explode(states).alias("_s")).select(*by, "_s.*")
    count = lambda s: F.count_if(F.col("state") == s)
    return each.groupBy(*by, "field").agg(F.count("*").alias("n"), count("ok").alias("ok"), count("missing").alias("missing"), count("null").alias("nulls"), count("mistyped").alias("mistyped"))


def schemas(documents: DataFrame, by: list[str], column: str = "document") -> DataFrame:
    """(by..., n, layout): the common schema of a group's documents as Spark merges it; clashing types are VARIANT."""
    return documents.groupBy(*by).agg(F.count("*").alias("n"), F.schema_of_variant_agg(column).alias("layout"))
