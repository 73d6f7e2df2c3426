"""Constants and payload values as typed Spark columns, with the rules of coercion.

A value is a pair: the column of the coerced value, and a column that is true
where the raw value is there but can't be coerced.
"""

from __future__ import annotations

import json
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mapweave.functions import exact, numbers


def _floats(value: Any) -> Any:
    if isinstance(value, Decimal):
        return int(value) if value == value.to_integral_value() and value.as_tuple().exponent >= 0 else float(value)
    if isinstance(value, dict):
        return {k: _floats(v) for k, v in value.items()}
    return [_floats(v) for v in value] if isinstance(value, (list, tuple)) else value


def to_json_text(value: Any, **options) -> str:
    """JSON of a constant; numbers with a fraction become doubles."""
    return json.dumps(_floats(value), ensure_ascii=False, **options)


def literal(value: Any) -> Column:
    """A constant as a column: scalars by type, objects and arrays as Variant."""
    if value is None:
        return F.lit(None).cast("string")
    if isinstance(value, (dict, list)):
        return F.parse_json(F.lit(to_json_text(value)))
    if isinstance(value, bool) or isinstance(value, str):
        return F.lit(value)
    if isinstance(value, int):
        return F.lit(value).cast("long") if -(1 << 63) <= value < 1 << 63 else F.lit(Decimal(value))
    if isinstance(value, Decimal):
        digits, exponent = value.as_tuple().digits, value.as_tuple().exponent
        return F.lit(value) if max(len(digits), -exponent) <= 38 and exponent <= 0 else F.lit(float(value))
    return F.lit(float(value))


def coerce_constant(value: Any, kind: str) -> Any:
    """A default or derived constant in a declared type; raises BuiltinError."""
    if kind == "string":
        return exact.text_of(value)
    if kind == "number":
        return exact.number_of(value) if not isinstance(value, float) else value
    if kind == "integer":
        number = exact.number_of(value)
        if number != number.to_integral_value() or not -(1 << 63) <= number < 1 << 63:
            raise exact.BuiltinError(f"not a 64-bit integer: {exact.text_of(value)}")
        return int(number)
    if kind == "boolean":
        if isinstance(value, bool):
            return value
        if exact.text_of(value).lower() in ("true", "false"):
            return exact.text_of(value).lower() == "true"
        raise exact.BuiltinError(f"not a boolean: {exact.text_of(value)}")
    if not isinstance(value, dict if kind == "object" else list):
        raise exact.BuiltinError(f"not of type {kind}")
    return value


def _from_text(text: Column, kind: str) -> tuple[Column, Column]:
    """Text in a declared scalar type; numbers as Variants of their exact value."""
    if kind == "boolean":
        low = F.lower(text)
        return F.when(low == "true", True).when(low == "false", False), ~low.isin("true", "false")
    out = numbers.variant_of(text) if kind == "number" else numbers.long_of(text)
    return out, out.isNull()


def coerce_typed(raw: Column, source: T.DataType, kind: str) -> tuple[Column, Column]:
    """A typed payload column in a declared type."""
    never, always = F.lit(False), raw.isNotNull()
    nested = isinstance(source, (T.StructType, T.MapType, T.ArrayType))
    if isinstance(source, T.VariantType):
        return coerce_variant(raw, kind)
    if kind == "string":
        return (F.to_json(raw, {"ignoreNullFields": "false"}) if nested else raw.cast("string")), never
    if kind == "object":
        return (raw, never) if isinstance(source, (T.StructType, T.MapType)) else (F.lit(None).cast("string"), always)
    if kind == "array":
        return (raw, never) if isinstance(source, T.ArrayType) else (F.lit(None).cast("string"), always)
    if isinstance(source, T.BooleanType):
        return (raw, never) if kind == "boolean" else (F.lit(None).cast("double"), always)
    if isinstance(source, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        if kind == "boolean":
            return F.lit(None).cast("boolean"), always
        return raw.cast("long"), never
    if isinstance(source, (T.FloatType, T.DoubleType)):
        if kind == "boolean":
            return F.lit(None).cast("boolean"), always
        real = raw.cast("double")
        finite = ~(F.isnan(real) | (F.abs(real) == float("inf")))
        if kind == "number":
            return real, ~finite
        out = F.when(finite, real.try_cast("long"))
        return out, out.isNull() | (out.cast("double") != real)
    if isinstance(source, T.DecimalType):
        if kind == "boolean":
            return F.lit(None).cast("boolean"), always
        if kind == "number":
            return raw, never
        out = raw.try_cast("long")
        return out, out.isNull() | (out.cast("decimal(38,0)") != raw)
    if nested:
        return F.lit(None).cast("string"), always
    return _from_text(raw.cast("string"), kind)


def coerce_variant(raw: Column, kind: str, shape: Column | None = None) -> tuple[Column, Column]:
    """A Variant in a declared type; Variant casts are too lenient, so its own type decides.

    Numbers stay Variants, so whole ones print as such.
    """
    shape = F.schema_of_variant(raw) if shape is None else shape
    get = lambda t: F.try_variant_get(raw, "$", t)
    is_object, is_array = shape.startswith("OBJECT"), shape.startswith("ARRAY")
    if kind == "object":
        return F.when(is_object, raw), ~is_object
    if kind == "array":
        return F.when(is_array, raw), ~is_array
    text = F.when(is_object | is_array, F.to_json(raw)).otherwise(get("string"))
    if kind == "string":
        return text, F.lit(False)
    is_text, is_boolean = shape.startswith("STRING"), shape.startswith("BOOLEAN")
    if kind == "boolean":
        out = F.when(is_boolean | is_text, _from_text(text, "boolean")[0])
        return out, out.isNull()
    is_double = shape.startswith("DOUBLE") | shape.startswith("FLOAT")
    if kind == "number":
        number = F.when(is_text, _from_text(text, "number")[0]).when(~(is_object | is_array | is_boolean), raw)
        return number, number.isNull()
    real = get("double")
    from_double = F.when((F.floor(real) == real) & (F.abs(real) <= float(1 << 63)), real.try_cast("long"))
    out = F.when(is_object | is_array | is_boolean, F.lit(None).cast("long")).when(is_double, from_double).otherwise(_from_text(text, "integer")[0])
    plain = shape == "BIGINT"  # the usual case needs no detour
    return F.when(plain, get("bigint")).otherwise(out), ~plain & out.isNull()
