"""Exact decimal numbers as columns: nothing is rounded before a result is reduced to a double.

A number is a pair of columns, `u` (decimal(38,0), without trailing zeros) and
`s`, its scale: the value is u / 10**s.  Where 38 digits don't hold a value or
an intermediate result, u is null, never a rounded number.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import exact

NUMERIC = rf"\A(?:{exact.NUMERIC.pattern})\z"
#: Whole numbers that need no detour.
_SHORT = r"\A[+-]?[0-9]{1,18}\z"
DIGITS, SURE, SAFE = 38, 15, float(1 << 53)
_WHOLE = f"decimal({DIGITS},0)"


def bind(value: Column, body) -> Column:
    """body(value), with value worked out once: expressions that use it often stay small."""
    return F.get(F.transform(F.array(value), body), 0)


def _digits_of(text: Column) -> Column:
    """Numeric text as struct: sign, significant digits, and how many of them stand before the point; null where it isn't numeric."""
    low = F.lower(text)
    exponent = F.when(F.contains(low, F.lit("e")), F.substring_index(low, "e", -1).try_cast("int")).otherwise(0)
    mantissa = F.ltrim(F.substring_index(low, "e", 1), F.lit("+-"))
    whole = F.substring_index(mantissa, ".", 1)
    fraction = F.when(F.contains(mantissa, F.lit(".")), F.substring_index(mantissa, ".", -1)).otherwise("")
    raw = F.concat(whole, fraction)
    cut = F.ltrim(raw, F.lit("0"))
    before = F.length(whole).cast("long") + exponent.cast("long") - (F.length(raw) - F.length(cut))
    sign = F.when(text.startswith("-"), "-").otherwise("")
    # an exponent beyond an int is beyond every number that is held
    return F.when(text.rlike(NUMERIC) & exponent.isNotNull(), F.struct(sign.alias("sign"), F.rtrim(cut, F.lit("0")).alias("digits"), before.alias("before")))


def _written(x: Column) -> Column:
    """_digits_of without exponent and spare zeros; null where that takes more than 38 digits."""
    digits, before, n = x["digits"], x["before"], F.length(x["digits"])
    short = lambda k: F.greatest(F.lit(0), F.least(k, F.lit(DIGITS))).cast("int")
    zeros = lambda k: F.repeat(F.lit("0"), short(k))
    return (
        F.when(digits == "", F.lit("0"))
        .when(F.greatest(before, n - before, n.cast("long")) > DIGITS, F.lit(None).cast("string"))
        .when(before <= 0, F.concat(x["sign"], F.lit("0."), zeros(-before), digits))
        .when(before >= n, F.concat(x["sign"], digits, zeros(before - n)))
        .otherwise(F.concat(x["sign"], F.substring(digits, F.lit(1), short(before)), F.lit("."), F.substring(digits, short(before) + 1, F.lit(DIGITS))))
    )


def variant_of(text: Column) -> Column:
    """Numeric text as a Variant of just its value; null where it isn't numeric or neither 38 digits nor a double hold it.

    A double holds up to 15 digits with any exponent in its range.
    """
    real = text.try_cast("double")

    def slow(x):
        far = F.when((F.length(x["digits"]) <= SURE) & (F.abs(real) != float("inf")) & (real != 0), real.cast("variant"))
        return F.coalesce(F.try_parse_json(_written(x)), far)

    return F.when(text.rlike(_SHORT), text.try_cast("long").cast("variant")).otherwise(bind(_digits_of(text), slow))


def long_of(text: Column) -> Column:
    """Numeric text as a long; null where it has a fraction, is too large or isn't numeric."""
    whole = lambda plain: F.when(~F.contains(plain, F.lit(".")), plain.try_cast(_WHOLE).try_cast("long"))
    return F.when(text.rlike(_SHORT), text.try_cast("long")).otherwise(bind(_digits_of(text), lambda x: bind(_written(x), whole)))


class Number(NamedTuple):
    u: Column
    s: Column


def _power(k: Column) -> Column:
    """10**k; null where it is beyond 37 or below 0."""
    return F.when((k >= 0) & (k < DIGITS), F.concat(F.lit("1"), F.repeat(F.lit("0"), F.greatest(k, F.lit(0)).cast("int"))).try_cast(_WHOLE))


def _pair(x: Number) -> Column:
    return F.struct(x.u.cast(_WHOLE).alias("u"), x.s.cast("long").alias("s"))


def of_text(text: Column) -> Column:
    """Text as a struct of u and s."""

    def slow(x):
        u = F.when(x["digits"] == "", F.lit("0")).otherwise(F.concat(x["sign"], x["digits"])).try_cast(_WHOLE)
        return _pair(Number(u, F.when(x["digits"] == "", F.lit(0)).otherwise(F.length(x["digits"]) - x["before"])))

    return F.when(text.rlike(_SHORT), _pair(Number(text.try_cast(_WHOLE), F.lit(0)))).otherwise(bind(_digits_of(text), slow))


def text_of(c: Column, kind: T.DataType) -> Column:
    """A column as numeric text; null where it can't be one."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(F.abs(c) < float("inf"), c.cast("double").cast("string"))
    return c.cast("string")


def small_whole(c: Column, kind: T.DataType) -> Column:
    """A column as a double where it is a whole number that a double counts exactly; null elsewhere."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        return c.cast("double")
    if not isinstance(kind, (T.LongType, T.FloatType, T.DoubleType)):
        return F.lit(None).cast("double")
    real = c.cast("double")
    return F.when((F.abs(real) < SAFE) & (F.floor(real) == real), real)


def _aligned(a: Number, b: Number) -> tuple[Column, Column, Column]:
    s = F.greatest(a.s, b.s)
    up = lambda x: F.when(x.s == s, x.u).otherwise(F.try_multiply(x.u, _power(s - x.s)).try_cast(_WHOLE))
    return up(a), up(b), s


def add(a: Number, b: Number) -> Number:
    x, y, s = _aligned(a, b)
    return Number(F.try_add(x, y).try_cast(_WHOLE), s)


def subtract(a: Number, b: Number) -> Number:
    x, y, s = _aligned(a, b)
    return Number(F.try_subtract(x, y).try_cast(_WHOLE), s)


def multiply(a: Number, b: Number) -> Number:
    return Number(F.try_multiply(a.u, b.u).try_cast(_WHOLE), a.s + b.s)


def _length(u: Column) -> Column:
    return F.length(F.abs(u).cast("string"))


def divide(a: Number, b: Number) -> Number:
    """The quotient where it has an end within 32 digits, else null.

    The dividend gets as many zeros as leave room, which takes out the factors 2
    and 5 of the divisor; what then leaves a remainder has another factor.
    """
    room = F.greatest(F.lit(0), F.least(F.lit(DIGITS) - _length(a.u), F.lit(31) + _length(b.u) - _length(a.u))).cast("long")
    top = F.try_multiply(a.u, _power(room)).try_cast(_WHOLE)
    quotient = F.try_divide(top, b.u).try_cast(_WHOLE)
    exact_one = F.try_multiply(quotient, b.u).try_cast(_WHOLE) == top
    # without the zeros that weren't needed, so that what follows has room
    text = F.rtrim(quotient.cast("string"), F.lit("0"))
    zero = quotient == 0
    short = F.when(zero, F.lit(0).cast(_WHOLE)).otherwise(text.try_cast(_WHOLE))
    spare = F.when(zero, F.lit(0)).otherwise(F.length(quotient.cast("string")) - F.length(text))
    return Number(F.when(exact_one & (b.u != 0), short), F.when(zero, F.lit(0).cast("long")).otherwise(a.s - b.s + room - spare))


def double_of(x: Number) -> Column:
    return F.concat(x.u.cast("string"), F.lit("e"), (-x.s).cast("string")).try_cast("double")


def _chosen(least: bool, a: Number, b: Number) -> Number:
    x, y, _ = _aligned(a, b)
    # beyond 38 digits doubles tell which is less
    less = F.coalesce(x < y, double_of(a) < double_of(b))
    first = less if least else ~less
    both = a.u.isNotNull() & b.u.isNotNull()
    return Number(F.when(both, F.when(first, a.u).otherwise(b.u)), F.when(first, a.s).otherwise(b.s))


_OPERATIONS = {"add": add, "subtract": subtract, "multiply": multiply, "divide": divide, "min": lambda a, b: _chosen(True, a, b), "max": lambda a, b: _chosen(False, a, b)}


def exactly(name: str, texts: list[Column]) -> Column:
    """The operation over numeric texts, reduced to a double; null where one isn't a number or 38 digits don't hold a result."""

    def step(value, rest):
        if not rest:
            return double_of(Number(value["u"], value["s"]))
        return bind(of_text(rest[0]), lambda x: bind(_pair(_OPERATIONS[name](Number(value["u"], value["s"]), Number(x["u"], x["s"]))), lambda v: step(v, rest[1:])))

    return bind(of_text(texts[0]), lambda v: step(v, texts[1:]))


def quickly(name: str, values: list[Column]) -> Column:
    """The operation over small whole numbers as doubles; null where a result may not be exact."""
    native = {"add": lambda a, b: a + b, "subtract": lambda a, b: a - b, "multiply": lambda a, b: a * b, "divide": F.try_divide, "min": F.least, "max": F.greatest}
    out = values[0]
    for x in values[1:]:
        # least and greatest pass over nulls
        made = F.when(out.isNotNull() & x.isNotNull(), native[name](out, x))
        sure = F.abs(made) < SAFE
        out = F.when(sure & (made * x == out) & (F.floor(made) == made) if name == "divide" else sure, made)
    return out
