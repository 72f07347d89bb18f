"""Documents without a declared shape: parsed to Variant, their shape found from the data, paths shredded into typed columns.

    documents = parse_open(events, "props", "document")
    shape = found_shape(documents, "document")
    shred(documents, "document", shape)

A path that holds one kind of value everywhere gets its type; one that holds several, or lists, stays a Variant. Whatever the shape
misses is still in the document. Malformed text is no document: its Variant is NULL and the text stays beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parse_open(df: DataFrame, column: str, into: str) -> DataFrame:
    """``df`` with the document of a text column, and ``malformed``: there is text, but it is no JSON."""
    document = F.try_parse_json(F.col(column))
    return df.withColumn(into, document).withColumn(
        "malformed", F.col(column).isNotNull() & F.col(into).isNull())


def is_object(document: str) -> Column:
    """The document is an object, not a list or a single value."""
    return F.coalesce(F.startswith(F.schema_of_variant(F.col(document)), F.lit("OBJECT<")), F.lit(False))


def found_shape(df: DataFrame, document: str) -> T.StructType:
    """The fields that the objects of a column have, from all of them in one aggregation; one text comes to the driver, as long
    as the number of different paths."""
    shape = df.where(is_object(document)).agg(F.schema_of_variant_agg(F.col(document))).first()[0]
    found = T.DataType.fromDDL(shape.replace("OBJECT<", "STRUCT<")) if shape and shape.startswith("OBJECT<") else T.StructType()
    return found if isinstance(found, T.StructType) else T.StructType()


def paths(shape: T.StructType, above: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], T.DataType]]:
    """The leaves of a shape with their types, by name. A name with both kinds of quotes is no path; it stays in the document."""
    out = []
    for field in sorted(shape.fields, key=lambda f: f.name):
        at = (*above, field.name)
        if "'" in field.name and '"' in field.name:
            continue
        if isinstance(field.dataType, T.StructType) and field.dataType.fields:
            out += paths(field.dataType, at)
        elif isinstance(field.dataType, (T.ArrayType, T.StructType, T.NullType)):
            out.append((at, T.VariantType()))
        else:
            out.append((at, field.dataType))
    return out


def _path(at: tuple[str, ...]) -> str:
    return "$" + "".join(f'["{name}"]' if "'" in name else f"['{name}']" for name in at)


def shred(df: DataFrame, document: str, shape: T.StructType, separator: str = "_") -> DataFrame:
    """``df`` with a column for every leaf of the shape, named by its path; NULL where a document has none or another kind.

    Paths whose names fall together, with one another or with a column, are told apart by a number.
    """
    columns, taken = {}, set(df.columns)
    for at, kind in paths(shape):
        name, n = separator.join(at), 1
        while name in taken:
            n += 1
            name = f"{separator.join(at)}{separator}{n}"
        taken.add(name)
        value = F.try_variant_get(F.col(document), _path(at), kind.simpleString())
        columns[name] = F.when(is_object(document), value)
    return df.withColumns(columns) if columns else df
