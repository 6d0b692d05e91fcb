"""Documents parsed once into VARIANT, read under a schema, and whatever did not fit it."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import (
    ArrayType, BooleanType, DataType, DecimalType, DoubleType, LongType, NullType, StringType, StructField, StructType,
)

RESCUED = "_rescued_data"
_OBJECT, _UNPARSED = "_object", "_unparsed"


def parse_objects(texts: DataFrame) -> DataFrame:
    """Rows of whole JSON texts in column ``value``: an object is one row, an array many.

    ``_object`` is the object as a VARIANT; ``_unparsed`` the whole text where that is no JSON, has a key twice in one
    object or is beyond the size of a VARIANT (128 MB). Other columns of ``texts`` are kept.
    """
    others = [c for c in texts.columns if c != "value"]
    document = F.col("_document")
    is_array = F.ltrim("value", F.lit(" \t\r\n")).startswith("[")
    piece = lambda v, text: F.struct(v.alias(_OBJECT), text.alias(_UNPARSED))
    nothing = F.lit(None).cast("string")
    # The text of a broken document travels in the array it is replaced by: every object of a sound one would copy it.
    pieces = (
        F.when(document.isNull(), F.array(piece(document, F.col("value"))))
        .when(is_array, F.transform(F.try_variant_get(document, "$", "array<variant>"), lambda v: piece(v, nothing)))
        .otherwise(F.array(piece(document, nothing)))
    )
    parsed = texts.withColumn("_document", F.try_parse_json("value"))
    return parsed.select(*others, F.explode(pieces).alias("_piece")).select(*others, f"_piece.{_OBJECT}", f"_piece.{_UNPARSED}")


def seen_schema(objects: DataFrame) -> DataType:
    """The merged type of all objects of ``parse_objects``, in one aggregate; ``VARIANT`` where they conflict."""
    text = objects.agg(F.schema_of_variant_agg(_OBJECT)).first()[0]
    plain = re.sub(r"`(?:[^`]|``)*`|OBJECT<", lambda m: "STRUCT<" if m[0] == "OBJECT<" else m[0], text or "VOID")
    return StructType.fromDDL(f"value {plain}")[0].dataType


def inferred(kind: DataType) -> DataType | None:
    """The type a table keeps for a seen type: text for conflicts and fields always null, nothing for empty objects."""
    if isinstance(kind, StructType):
        fields = [(f.name, inferred(f.dataType)) for f in kind]
        return StructType([StructField(n, t) for n, t in fields if t is not None]) if any(t for _, t in fields) else None
    if isinstance(kind, ArrayType):
        return ArrayType(inferred(kind.elementType) or StringType())
    if isinstance(kind, DecimalType):
        return DoubleType()
    return kind if isinstance(kind, (LongType, DoubleType, BooleanType, StringType)) else StringType()


def covers(kind: DataType, seen: DataType) -> bool:
    """Whether values of the seen type lose nothing under ``kind``."""
    if isinstance(seen, NullType) or isinstance(kind, StringType):
        return True
    if isinstance(kind, StructType):
        known = {f.name: f.dataType for f in kind}
        return isinstance(seen, StructType) and all(f.name in known and covers(known[f.name], f.dataType) for f in seen)
    if isinstance(kind, ArrayType):
        return isinstance(seen, ArrayType) and covers(kind.elementType, seen.elementType)
    if isinstance(kind, DoubleType):
        return isinstance(seen, (LongType, DecimalType, DoubleType))
    return kind == seen


def read_objects(objects: DataFrame, schema: StructType, clean: bool = False) -> DataFrame:
    """The objects of ``parse_objects`` under ``schema``, and ``_rescued_data``.

    ``_rescued_data`` holds, as JSON, undeclared fields and fields whose value does not fit the declared type, at any
    depth: a top-level field is kept whole where something inside is lost. For text that is no JSON object it holds the
    text. ``clean`` tells that ``schema`` covers the merged type of all objects, so that nothing has to be looked for.
    """
    others = [c for c in objects.columns if c not in (_OBJECT, _UNPARSED)]
    value = F.col(_OBJECT)
    typed = F.try_variant_get(value, "$", schema.simpleString() if _plain(schema) else _ddl(schema))
    if clean:
        rows = objects.select(*others, typed.alias("_typed"), F.col(_UNPARSED).alias(RESCUED))
    else:
        raw = F.try_variant_get(value, "$", "map<string,variant>")
        kinds = {f.name: f.dataType for f in schema}
        rows = objects.withColumns({"_raw": raw, "_text": F.coalesce(F.col(_UNPARSED), F.to_json(value))})
        # Declared fields in their order, then the others by name: a VARIANT does not keep the order of the text.
        own = F.array(*[F.struct(F.lit(n).alias("key"), F.element_at("_raw", F.lit(n)).alias("value")) for n in kinds])
        own = F.filter(own, lambda e: e["value"].isNotNull() & _lost_field(kinds, e["key"], e["value"]))
        other = F.map_entries(F.map_filter("_raw", lambda key, v: ~key.isin(*kinds) & ~F.is_variant_null(v)))
        left = F.map_from_entries(F.concat(own, other) if kinds else other)
        left = F.nullif(F.to_json(F.transform_values(left, lambda _, v: v.cast("string"))), F.lit("{}"))
        fields = [_read(F.element_at("_raw", F.lit(n)), k).alias(n) for n, k in kinds.items()]
        rescued = F.when(F.col("_raw").isNull(), F.col("_text")).otherwise(left)
        rows = rows.select(*others, F.struct(*fields).alias("_typed"), rescued.alias(RESCUED))
    return rows.select(*[F.col(f"_typed.`{f.name}`").alias(f.name) for f in schema], RESCUED, *others)


def parse_documents(texts: DataFrame, schema: StructType) -> DataFrame:
    """``read_objects`` of the JSON texts in column ``value``."""
    return read_objects(parse_objects(texts), schema)


def _plain(schema: StructType) -> bool:
    """Whether no name at any depth needs quoting."""
    return re.fullmatch(r"[\w<>,:]*", schema.simpleString()) is not None


def _ddl(kind: DataType) -> str:
    if isinstance(kind, StructType):
        return "struct<" + ",".join(f"`{f.name.replace('`', '``')}`:{_ddl(f.dataType)}" for f in kind) + ">"
    return f"array<{_ddl(kind.elementType)}>" if isinstance(kind, ArrayType) else kind.simpleString()


def _lost_field(kinds: dict[str, DataType], key: Column, value: Column) -> Column:
    """Whether the field ``key`` of an object has a value its kind does not hold, or no kind."""
    lost = F.lit(True)
    for name, kind in kinds.items():
        lost = F.when(key == name, _lost(value, kind)).otherwise(lost)
    return ~F.is_variant_null(value) & lost


def _lost(value: Column, kind: DataType) -> Column:
    if isinstance(kind, StringType):
        return F.lit(False)
    if isinstance(kind, StructType):
        fields, kinds = F.try_variant_get(value, "$", "map<string,variant>"), {f.name: f.dataType for f in kind}
        some = F.map_filter(fields, lambda k, v: _lost_field(kinds, k, v))
        return F.when(fields.isNull(), ~F.is_variant_null(value)).otherwise(F.size(some) > 0)
    if isinstance(kind, ArrayType):
        items = F.try_variant_get(value, "$", "array<variant>")
        return F.when(items.isNull(), ~F.is_variant_null(value)).otherwise(F.exists(items, lambda v: _lost(v, kind.elementType)))
    return ~F.is_variant_null(value) & ~_fits(value, kind)


def _fits(value: Column, kind: DataType) -> Column:
    """Whether a scalar is written as its kind: no text counts as a number, no fraction as a whole number."""
    seen = F.schema_of_variant(value)
    if isinstance(kind, DoubleType):
        return seen.isin("BIGINT", "DOUBLE", "FLOAT") | seen.startswith("DECIMAL")
    names = {"bigint": "BIGINT", "boolean": "BOOLEAN"}
    known = names.get(kind.simpleString())
    return seen == known if known else F.try_variant_get(value, "$", kind.simpleString()).isNotNull()


def _read(value: Column, kind: DataType) -> Column:
    """The value under its kind; null where a scalar does not fit."""
    if isinstance(kind, StructType):
        fields = F.try_variant_get(value, "$", "map<string,variant>")
        inner = F.struct(*[_read(F.element_at(fields, F.lit(f.name)), f.dataType).alias(f.name) for f in kind])
        return F.when(fields.isNotNull(), inner)
    if isinstance(kind, ArrayType):
        return F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda v: _read(v, kind.elementType))
    read = F.try_variant_get(value, "$", kind.simpleString())
    return read if isinstance(kind, StringType) else F.when(_fits(value, kind), read)
