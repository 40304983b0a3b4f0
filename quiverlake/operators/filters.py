"""The payload filter language, compiled to a two-valued Catalyst predicate.

A filter is {"must": [...], "should": [...], "must_not": [...]}; a condition is {"key", "match"},
{"key", "range": {"gt", "gte", "lt", "lte"}}, {"hasId": [...]} or a filter again. Conditions on a missing
key, a missing payload, another type or a NaN are false, and ``must_not`` of them true, so the predicate is
never null. As built-in expressions over plain columns they reach the Parquet scan.
"""

from __future__ import annotations

import math
from decimal import Decimal
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import FilterError

_BOUNDS = {"gt": lambda c, x: c > x, "gte": lambda c, x: c >= x, "lt": lambda c, x: c < x, "lte": lambda c, x: c <= x}
_PARTS = ("must", "should", "must_not")
#: How a variant is read as a value of each kind, and the types it must then have.
_VARIANTS = {str: ("string", "^STRING$"), bool: ("boolean", "^BOOLEAN$"), float: ("double", "^(BIGINT|FLOAT|DOUBLE|DECIMAL.*)$")}


def _bad(why: str) -> FilterError:
    return FilterError("INVALID_CONDITION", why)


def _number(x: object) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def _kind(kind: T.DataType | None) -> type | None:
    if isinstance(kind, T.StringType):
        return str
    if isinstance(kind, T.BooleanType):
        return bool
    return float if isinstance(kind, T.NumericType) else None


class _Compiler:
    def __init__(self, schema: T.StructType, id_col: str, payload: str | None):
        self.id_col, self.payload = id_col, payload
        held = schema[payload].dataType if payload else schema
        self.types = {f.name: f.dataType for f in held.fields}
        self.id_type = schema[id_col].dataType if id_col in schema.names else None

    def column(self, key: str, kind: type) -> Column | None:
        """The key's column, if it is of that kind."""
        own = self.types.get(key)
        mixed = isinstance(own, T.VariantType)
        if not mixed and _kind(own) is not kind or (self.payload is None and key == self.id_col):
            return None
        c = F.col(self.payload)[key] if self.payload else F.col(f"`{key}`")
        if not mixed:
            return c
        name, pattern = _VARIANTS[kind]
        return F.when(F.schema_of_variant(c).rlike(pattern), F.try_variant_get(c, "$", name))

    def has_id(self, ids: list) -> Column:
        """Ids of another type than the column's match nothing."""
        if isinstance(self.id_type, T.StringType):
            ids = [i for i in ids if isinstance(i, str)]
        elif isinstance(self.id_type, (T.IntegralType, T.DecimalType)):
            most = 2**63 if isinstance(self.id_type, T.IntegralType) else 10**38
            whole = [int(i) for i in ids if isinstance(i, Decimal) and i == int(i) or _number(i) and math.isfinite(i) and i == int(i)]
            ids = [Decimal(i) if most > 2**63 else i for i in whole if abs(i) < most]
        elif isinstance(self.id_type, T.NumericType):
            ids = [float(i) for i in ids if _number(i)]
        return F.coalesce(F.col(self.id_col).isin(ids), F.lit(False)) if ids else F.lit(False)

    def condition(self, c: object) -> Column:
        if not isinstance(c, dict):
            raise _bad(f"a condition is an object, got {c!r}")
        if "match" in c:
            return self.match(c.get("key"), c["match"])
        if "range" in c:
            return self.range(c.get("key"), c["range"])
        if "hasId" in c:
            ids = c["hasId"]
            if not isinstance(ids, (list, tuple)) or not ids:
                raise _bad("hasId needs at least one id")
            return self.has_id(list(ids))
        if c and set(c) <= set(_PARTS):
            return self.filter(c)
        raise _bad(f"no condition has the shape {sorted(c)}")

    def match(self, key: object, value: object) -> Column:
        if not isinstance(key, str) or not isinstance(value, (str, bool, int, float)):
            raise _bad("match needs a key and a string, number or boolean")
        column = self.column(key, float if _number(value) else type(value))
        if column is None or value != value:
            return F.lit(False)
        return F.coalesce(column == F.lit(value), F.lit(False))

    def range(self, key: object, bounds: object) -> Column:
        if not isinstance(key, str) or not isinstance(bounds, dict):
            raise _bad("range needs a key and bounds")
        given = {b: bounds[b] for b in _BOUNDS if bounds.get(b) is not None}
        if not given or not all(map(_number, given.values())):
            raise _bad("range needs a numeric bound")
        low, high = given.get("gt", given.get("gte")), given.get("lt", given.get("lte"))
        if low is not None and high is not None and (low > high or low == high and ("gt" in given or "lt" in given)):
            raise _bad(f"nothing lies in the range {given}")
        column = self.column(key, float)
        if column is None:
            return F.lit(False)
        inside = reduce(and_, (_BOUNDS[b](column, F.lit(x)) for b, x in given.items()))
        whole = isinstance(self.types[key], T.IntegralType)
        return F.coalesce(inside if whole else inside & ~F.isnan(column.cast("double")), F.lit(False))

    def filter(self, f: dict) -> Column:
        every, some, none = ([self.condition(c) for c in f.get(p) or []] for p in _PARTS)
        parts = every + [~c for c in none]
        if some:
            parts.append(reduce(or_, some))
        return reduce(and_, parts) if parts else F.lit(True)


def compile_filter(f: dict | None, schema: T.StructType, id_col: str = "id", payload: str | None = None) -> Column:
    """schema: of the rows; payload: the struct column that holds the keys, else they are columns."""
    if f is None:
        return F.lit(True)
    if not isinstance(f, dict) or not set(f) <= set(_PARTS):
        raise _bad("a filter has must, should and must_not")
    return _Compiler(schema, id_col, payload).filter(f)
