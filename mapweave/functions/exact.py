"""The builtin functions on constants, evaluated exactly on the driver.

Numbers are Python ints and Decimals, so that nothing is rounded before the
result is reduced: whole results that fit 64 bits become ints, all others
doubles.
"""

from __future__ import annotations

import re
from decimal import MAX_EMAX, MIN_EMIN, Context, Decimal
from fractions import Fraction
from typing import Any

NUMERIC = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
#: Numbers have fewer digits than this before and after the point.
FAR = 2000
_WIDE = Context(prec=2000, Emax=MAX_EMAX, Emin=MIN_EMIN)
RANDOM = ("date", "date_utc", "date_now_millis", "pos_int", "pos_int_between", "uuid", "uuid_compact", "uuid_urn")
CONSTANT = ("uppercase", "lowercase", "trim", "concat", "pad_left", "pad_right", "lookup", "add", "subtract", "multiply", "divide", "min", "max", "abs")
BUILTINS = (*RANDOM, *CONSTANT)


class BuiltinError(ValueError):
    """A builtin can't be evaluated for these arguments."""


def text_of(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, dict):
        return "{" + ", ".join(f"{k}={text_of(v)}" for k, v in value.items()) + "}"
    return "[" + ", ".join(map(text_of, value)) + "]" if isinstance(value, list) else str(value)


def number_of(value: Any) -> Decimal:
    if isinstance(value, (int, Decimal, float)) and not isinstance(value, bool):
        return Decimal(str(value)) if isinstance(value, float) else Decimal(value)
    if value is not None and NUMERIC.fullmatch(text_of(value)):
        number = _WIDE.create_decimal(text_of(value))
        if abs(number.adjusted()) > FAR:
            raise BuiltinError(f"a number out of range: {text_of(value)}")
        return number
    raise BuiltinError(f"not a number: {text_of(value)}")


def whole_of(value: Any) -> int:
    """An int argument: numbers are cut, texts must be whole."""
    if isinstance(value, (int, Decimal, float)) and not isinstance(value, bool):
        return int(value)
    if re.fullmatch(r"[+-]?[0-9]+", text_of(value)):
        return int(text_of(value))
    raise BuiltinError(f"not a whole number: {text_of(value)}")


def reduced(value: Decimal | Fraction) -> int | float:
    exact = Fraction(value)
    if exact.denominator == 1 and -(1 << 63) <= exact.numerator < 1 << 63:
        return exact.numerator
    return float(value)


def need(args: list, n: int, name: str) -> None:
    if len(args) < n:
        raise BuiltinError(f"{name} takes {n} arguments or more")


def merged(call: tuple, own: tuple) -> list:
    return [*call, *own] if call else list(own)


def _divide(args: list) -> Fraction:
    found = Fraction(number_of(args[0]))
    for x in args[1:]:
        by = Fraction(number_of(x))
        if not by:
            raise BuiltinError("division by zero")
        found /= by
        rest = found.denominator
        for p in (2, 5):
            while rest % p == 0:
                rest //= p
        if rest != 1:
            raise BuiltinError("the quotient has no end")
    return found


def pad_args(args: list, name: str) -> tuple[str, int, str]:
    need(args, 2, name)
    fill = " " if len(args) < 3 or args[2] is None else text_of(args[2])
    if not fill:
        raise BuiltinError(f"{name} needs a character to fill with")
    return text_of(args[0]), whole_of(args[1]), fill[0]


def evaluate(name: str, args: list) -> Any:
    """Value of a builtin of CONSTANT for constant arguments."""
    if name in ("uppercase", "lowercase", "trim"):
        need(args, 1, name)
        text = "" if args[0] is None else text_of(args[0])
        return {"uppercase": text.upper, "lowercase": text.lower, "trim": lambda: text.strip("".join(map(chr, range(33))))}[name]()
    if name == "concat":
        return "".join("" if a is None else text_of(a) for a in args)
    if name in ("pad_left", "pad_right"):
        text, n, fill = pad_args(args, name)
        return fill * (n - len(text)) + text if name == "pad_left" else text + fill * (n - len(text))
    if name == "lookup":
        need(args, 1, name)
        table = args[1] if len(args) > 1 else {}
        if not isinstance(table, dict):
            raise BuiltinError("lookup needs a map")
        found = table.get(args[0]) if isinstance(args[0], str) else None
        return found if found is not None else (args[2] if len(args) > 2 else None)
    if name in ("add", "subtract", "multiply", "divide"):
        need(args, 2, name)
        if name == "divide":
            return reduced(_divide(args))
        found = number_of(args[0])
        for x in args[1:]:
            found = {"add": _WIDE.add, "subtract": _WIDE.subtract, "multiply": _WIDE.multiply}[name](found, number_of(x))
        return reduced(found)
    if name in ("min", "max"):
        need(args, 1, name)
        return reduced((min if name == "min" else max)(map(number_of, args)))
    if name == "abs":
        need(args, 1, name)
        return reduced(abs(number_of(args[0])))
    raise BuiltinError(f"{name} isn't constant")
