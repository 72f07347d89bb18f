"""JSON documents in and out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waybill.functions.expressions import iso_timestamp, to_camel, to_snake
from waybill.session import fresh_folder, shuffles_removed

CORRUPT = "_corrupt_record"
PRESENT = "present_fields"


def payload_schema(table_schema: T.StructType, skip: tuple[str, ...] = ()) -> T.StructType:
    """The camelCase schema of the documents that describe rows of a table."""
    return T.StructType([
        T.StructField(to_camel(f.name), f.dataType) for f in table_schema.fields
        if f.name not in skip
    ])


def read_payloads(source: DataFrame | str, schema: T.StructType, spark: SparkSession | None = None,
                  column: str = "payload", once: bool = False) -> tuple[DataFrame, DataFrame]:
    """Parse JSON documents into ``(rows, malformed)``.

    ``source`` is a frame with a text column, or a path of line-delimited JSON. Rows have the
    fields of ``schema`` in snake_case, next to the other columns of the frame and
    ``present_fields``: the (snake_case) names the document held, which tells an explicit NULL
    from an absent field. Malformed documents keep their text. With ``once`` the documents are parsed at once and written
    to the shared folder, for callers that go over the rows more than once.
    """
    if isinstance(source, str):
        source = spark.read.text(source).withColumnRenamed("value", column)
    wanted = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
    others = [c for c in source.columns if c != column]
    # Parsed by a generator, whose output filters cannot be pushed below: a filter that could be
    # would parse the document again for every field it looks at.
    parsed = source.select("*", F.explode(F.array(F.struct(
        F.from_json(column, wanted, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("doc"),
        F.json_object_keys(F.col(column)).alias("present"),
    ))).alias("_parsed"))
    broken = F.col("_parsed.doc").isNull() | F.col(f"_parsed.doc.{CORRUPT}").isNotNull()
    names = F.transform("_parsed.present", _known_snake([f.name for f in schema.fields]))
    read = parsed.select(*others, broken.alias("_broken"), F.when(broken, F.col(column)).alias(column),
                         *[F.col(f"_parsed.doc.{f.name}").alias(f"_field{i}") for i, f in enumerate(schema.fields)],
                         names.alias(PRESENT))
    if once:
        folder = fresh_folder(source.sparkSession, "payloads")
        with shuffles_removed(source.sparkSession):
            read.write.parquet(folder)
        read = source.sparkSession.read.schema(read.schema).parquet(folder)
    rows = read.where(~F.col("_broken")).select(
        *others, *[F.col(f"_field{i}").alias(to_snake(f.name)) for i, f in enumerate(schema.fields)], PRESENT)
    return rows, read.where("_broken").select(*others, column)


def _known_snake(names: list[str]) -> Callable[[Column], Column]:
    """Names of the schema are looked up; only others are worked out from their letters."""
    known = [F.lit(text) for n in names if n.isascii() for text in (n, to_snake(n))]
    if not known:
        return _snake_text
    return lambda name: F.coalesce(F.try_element_at(F.create_map(*known), name), _snake_text(name))


def _snake_text(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "([A-Z])", "_$1"))


def parse_json_column(column: Column | str, ddl: str, current: T.DataType | None = None) -> Column:
    """A document column as typed values; bad or missing JSON becomes the empty value.

    Pass the column's ``current`` type when it may already be an object: it is then only cast.
    """
    column = F.col(column) if isinstance(column, str) else column
    target = T.StructType.fromDDL(f"v {ddl}")["v"].dataType
    parsed = column if current is not None and not isinstance(current, T.StringType) \
        else F.from_json(column, target)
    if isinstance(target, T.ArrayType):
        empty = F.array().cast(target)
    elif isinstance(target, T.MapType):
        empty = F.map_from_arrays(F.array(), F.array()).cast(target)
    else:
        empty = F.from_json(F.lit("{}"), target)
    return F.coalesce(parsed.cast(target), empty)


def serialise_column(column: Column | str) -> Column:
    return F.to_json(column)


def to_document(df: DataFrame, name: str = "document", keep: tuple[str, ...] = ()) -> DataFrame:
    """One JSON document per row: camelCase keys, ISO timestamps, NULLs written out."""
    fields = [_document_value(F.col(f.name), f.dataType).alias(to_camel(f.name))
              for f in df.schema.fields]
    document = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return df.select(*keep, document.alias(name))


def _document_value(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return iso_timestamp(value)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return F.transform(value, lambda item: _document_struct(item, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), _document_struct(value, kind))
    return value


def _document_struct(value: Column, kind: T.StructType) -> Column:
    return F.struct(*[_document_value(value[f.name], f.dataType).alias(f.name)
                      for f in kind.fields])
