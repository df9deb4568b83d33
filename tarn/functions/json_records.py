"""JSON text to typed structs, driven by a JSON schema."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# JSON schema scalar types and their Spark types.
SCALARS = {
    "string": T.StringType(),
    "integer": T.LongType(),
    "number": T.DoubleType(),
    "boolean": T.BooleanType(),
}
CORRUPT = "_corrupt"


def struct_type(schema: dict) -> T.DataType:
    """Spark type of a JSON schema (objects, arrays and scalars)."""
    kind = schema.get("type", "object")
    if kind in SCALARS:
        return SCALARS[kind]
    if kind == "array":
        return T.ArrayType(struct_type(schema["items"]))
    if kind == "object":
        return T.StructType(
            [T.StructField(n, struct_type(s)) for n, s in schema["properties"].items()]
        )
    raise ValueError(f"unsupported JSON schema type: {kind}")


def violations(record: Column, schema: dict) -> Column:
    """Array of ``missing:<field>`` / ``enum:<field>`` marks of a struct column."""
    marks = [
        F.when(record[field].isNull(), F.lit(f"missing:{field}"))
        for field in schema.get("required", [])
    ]
    marks += [
        F.when(~record[field].isin(*spec["enum"]), F.lit(f"enum:{field}"))
        for field, spec in schema["properties"].items()
        if "enum" in spec
    ]
    return F.array_compact(F.array(*marks)) if marks else F.array().cast("array<string>")


def parse_record(text: Column | str, schema: dict) -> Column:
    """``struct<record, errors>`` of a JSON text; errors is empty for a conforming record."""
    shape = struct_type(schema)
    with_corrupt = T.StructType([*shape.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_json(text, with_corrupt, {"columnNameOfCorruptRecord": CORRUPT})
    record = F.struct(*[parsed[f.name].alias(f.name) for f in shape.fields])
    errors = F.when(
        parsed[CORRUPT].isNotNull() | parsed.isNull(), F.array(F.lit("malformed"))
    ).otherwise(violations(record, schema))
    return F.struct(record.alias("record"), errors.alias("errors"))
