"""Metadata encode / decode (T8, T9) on VARIANT columns.

Stored metadata is a VARIANT object. ``encode`` reproduces the store's rule that list and dict
values are kept as JSON text (scalars unchanged); ``decode`` is the read-side rule that turns every
string that parses as JSON back into a value (so "123" becomes 123 and "null" becomes null - kept
as the compatible behaviour; callers that want types preserved simply skip ``decode``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def encode(struct_col: Column, schema: T.StructType) -> Column:
    """STRUCT -> VARIANT object with ARRAY/MAP/STRUCT fields written as JSON strings."""
    fields = []
    for f in schema.fields:
        v = struct_col[f.name]
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            v = F.to_json(v)
        fields.append(v.alias(f.name))
    return F.to_variant_object(F.struct(*fields))


def decode(meta: Column) -> Column:
    """VARIANT object -> VARIANT object where string values that are valid JSON are parsed."""
    m = meta.cast("map<string,variant>")
    parsed = F.transform_values(
        m,
        lambda k, v: F.when(
            F.schema_of_variant(v) == "STRING",
            F.coalesce(F.try_parse_json(v.cast("string")), v),
        ).otherwise(v),
    )
    return F.to_variant_object(parsed)
