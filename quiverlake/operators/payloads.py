"""Payloads of unlike shapes in one struct column.

Struct fields are merged by name, numbers widened; a field whose values have no common type becomes a variant,
which keeps every value's own type for filters and reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WHOLE = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()]


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    if a.simpleString() == b.simpleString() or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        more = {f.name: f.dataType for f in b.fields}
        fields = [T.StructField(f.name, common_type(f.dataType, more.pop(f.name, f.dataType))) for f in a.fields]
        return T.StructType(fields + [T.StructField(name, kind) for name, kind in more.items()])
    if a in _WHOLE and b in _WHOLE:
        return max(a, b, key=_WHOLE.index)
    if all(isinstance(x, T.NumericType) and not isinstance(x, T.DecimalType) for x in (a, b)):
        return T.DoubleType()
    return T.VariantType()


def shaped(c: Column, have: T.DataType, want: T.DataType) -> Column:
    """c, of type have, as a value of the common type want."""
    if have.simpleString() == want.simpleString():
        return c
    if isinstance(have, T.StructType) and isinstance(want, T.StructType):
        held = {f.name: f.dataType for f in have.fields}
        fields = [(shaped(c[f.name], held[f.name], f.dataType) if f.name in held else F.lit(None).cast(f.dataType)).alias(f.name) for f in want.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(want, T.VariantType) and isinstance(have, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_variant_object(c)
    return c.cast(want)


def united(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """The rows of both, with ``column`` in the common type."""
    kinds = a.schema[column].dataType, b.schema[column].dataType
    want = common_type(*kinds)
    a, b = (df.withColumn(column, shaped(F.col(column), kind, want)) for df, kind in zip((a, b), kinds, strict=True))
    return a.unionByName(b)


def plain(value: object) -> object:
    """A payload as read, in dicts and lists; null keys are left out."""
    if isinstance(value, Row):
        return {k: plain(v) for k, v in value.asDict().items() if v is not None}
    if isinstance(value, T.VariantVal):
        return value.toPython()
    return [plain(v) for v in value] if isinstance(value, list) else value
