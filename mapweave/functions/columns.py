"""The builtin functions as Spark columns: clocks and random values, and functions of data."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import exact, numbers
from .exact import BuiltinError

ARITHMETIC = ("add", "subtract", "multiply", "divide", "min", "max", "abs")
_CONTROL = "[\\x00-\\x20]+"


def _utc_now() -> Column:
    return F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())


def generated(name: str, args: list) -> Column:
    """A builtin of RANDOM.  The clock is one for a whole query."""
    if name == "date":
        return F.date_format(_utc_now(), exact.text_of(args[0]) if args and args[0] is not None else "yyyy-MM-dd'T'HH:mm:ss'Z'")
    if name == "date_utc":
        return F.date_format(_utc_now(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    if name == "date_now_millis":
        return F.unix_millis(F.current_timestamp())
    if name == "pos_int":
        n = exact.whole_of(args[0]) if args else 1
        if n <= 0:
            raise BuiltinError("pos_int needs a positive length")
        prefix = exact.text_of(args[1]) if len(args) > 1 and args[1] is not None else ""
        return F.concat(F.lit(prefix), *[F.floor(F.rand() * 10).cast("string") for _ in range(n)])
    if name == "pos_int_between":
        exact.need(args, 2, name)
        low, high = exact.whole_of(args[0]), exact.whole_of(args[1])
        if low > high:
            raise BuiltinError("pos_int_between needs min <= max")
        span = high - low + 1
        if span <= 1 << 50:
            return (F.floor(F.rand() * span) + low).cast("long")
        return (F.pmod(F.xxhash64(F.uuid()).cast("decimal(38,0)"), F.lit(span).cast("decimal(38,0)")) + F.lit(low)).cast("long")
    if name == "uuid":
        return F.uuid()
    if name == "uuid_compact":
        return F.replace(F.uuid(), F.lit("-"), F.lit(""))
    if name == "uuid_urn":
        return F.concat(F.lit("urn:uuid:"), F.uuid())
    raise BuiltinError(f"unknown builtin {name}")


def _text(x: Any) -> Column:
    return x.cast("string") if isinstance(x, Column) else F.lit(exact.text_of(x))


def _or_empty(x: Any) -> Column:
    return F.coalesce(_text(x), F.lit("")) if x is not None else F.lit("")


def _length_arg(x: Any, kind: T.DataType | None) -> tuple[Column, Column]:
    """(length, failed): numbers are cut, texts must be whole."""
    if not isinstance(x, Column):
        return F.lit(exact.whole_of(x)), F.lit(False)
    text = x.cast("string")
    if isinstance(kind, (T.StringType, T.VariantType)):
        n = F.when(text.rlike(r"\A[+-]?[0-9]+\z"), text.try_cast("int"))
        if isinstance(kind, T.VariantType):
            n = F.when(F.schema_of_variant(x).startswith("STRING"), n).otherwise(F.try_variant_get(x, "$", "int"))
    else:
        n = x.try_cast("int")
    return n, n.isNull()


def of_columns(name: str, args: list, kinds: list[T.DataType | None]) -> tuple[Column, Column | None]:
    """(value, failed) of a builtin of CONSTANT with columns among its arguments; kinds: the types of those."""
    none = None
    if name in ("uppercase", "lowercase", "trim"):
        exact.need(args, 1, name)
        text = _or_empty(args[0])
        return {"uppercase": F.upper, "lowercase": F.lower, "trim": lambda t: F.regexp_replace(t, f"^{_CONTROL}|{_CONTROL}$", "")}[name](text), none
    if name == "concat":
        return F.concat_ws("", *[_text(a) for a in args if a is not None]), none
    if name in ("pad_left", "pad_right"):
        exact.need(args, 2, name)
        text = F.coalesce(_text(args[0]), F.lit("null"))
        n, failed = _length_arg(args[1], kinds[1])
        fill = args[2] if len(args) > 2 and args[2] is not None else " "
        if isinstance(fill, Column):
            fill = F.coalesce(fill.cast("string"), F.lit(" "))
            failed = failed | (fill == "")
        else:
            fill = F.lit(exact.pad_args(["", 0, fill], name)[2])
        padded = (F.lpad if name == "pad_left" else F.rpad)(text, n, F.substring(fill, 1, 1))
        return F.when(F.length(text) >= n, text).otherwise(padded), failed
    if name == "lookup":
        exact.need(args, 1, name)
        table = args[1] if len(args) > 1 else {}
        if not isinstance(table, dict):
            raise BuiltinError("lookup needs a map")
        default = _text(args[2]) if len(args) > 2 and args[2] is not None else F.lit(None).cast("string")
        if not table:
            return default, none
        pairs = F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, None if v is None else exact.text_of(v))])
        return F.coalesce(F.element_at(pairs, _text(args[0])), default), none
    exact.need(args, 2 if name in ("add", "subtract", "multiply", "divide") else 1, name)
    used = args[: 1 if name == "abs" else None]
    pairs = list(zip(used, kinds, strict=False))
    constants = [None if isinstance(a, Column) else format(exact.number_of(a), "f") for a in used]
    texts = [numbers.text_of(a, k) if isinstance(a, Column) else F.lit(c) for (a, k), c in zip(pairs, constants, strict=True)]
    small = [numbers.small_whole(a, k) if isinstance(a, Column) else F.lit(float(c) if re.fullmatch("-?[0-9]{1,15}", c) else None).cast("double") for (a, k), c in zip(pairs, constants, strict=True)]
    quick = numbers.quickly(name, small)
    value = F.when(quick.isNotNull(), quick).otherwise(numbers.exactly(name, texts))
    return F.abs(value) if name == "abs" else value, value.isNull()
