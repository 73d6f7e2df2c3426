"""Numbers keep every digit or are refused; nothing is rounded in between."""

import json
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mapweave import Mapping
from mapweave.functions import exact, numbers
from mapweave.functions.exact import BuiltinError
from mapweave.queries import builtin, derived, document

TEXTS = ["1", "+1", "-0", "007", ".5", "1.", "-1.50", "1e3", "1.5E-7", "2.00000000001", "0.12345678912345", "0.123456789012345678901234567890", "123456789012345678901234567890", "0.0001e4", "9223372036854775807", "9223372036854775808", "-9223372036854775808", "1.234567890123456789e5", "0.0", "1e-20", "1e300"]
REFUSED = ["12345678901234567890123456789012345678901", "1e400", "1e-400", "1e99999999999", "x", " 1", "", "1,5", "0x1", "1_0"]


@pytest.mark.parametrize("mode", ["typed", "json"])
def test_texts_as_numbers_and_integers(spark, mode):
    df = spark.createDataFrame([(t, json.dumps({"v": t})) for t in TEXTS + REFUSED], "v string, payload string")
    for kind in ("number", "integer"):
        m = Mapping.from_dict(document("$VARIABLES.v", {"v": {"type": kind}}))
        out = m.to_json_df(df, on_error="quarantine", **({"payload": "payload"} if mode == "json" else {}), **({"keep": ["v"]})).collect()
        assert len(out) == len(TEXTS + REFUSED)
        for r in out:
            value = Decimal(r.v) if r.v in TEXTS else None
            if value is not None and kind == "integer" and (value != value.to_integral_value() or not -(1 << 63) <= value < 1 << 63):
                value = None
            if value is None:
                assert r.output is None and [d.code for d in r["_diagnostics"]] == ["VARIABLE_TYPE"], r
            else:
                assert Decimal(r.output) == value, r


def test_json_numbers_as_integers(spark):
    texts = ["2.0", "2.0000000000001", "2", "1e2", "1.5e1", "9007199254740993", "9223372036854775808", "1e19", "-3.000", "0.99999999999999999999"]
    df = spark.createDataFrame([(t, f'{{"v": {t}}}') for t in texts], "t string, payload string")
    m = Mapping.from_dict(document("$VARIABLES.v", {"v": {"type": "integer"}}))
    got = {r.t: r.output for r in m.apply(df, payload="payload", on_error="quarantine").collect()}
    for t in texts:
        value = Decimal(t)
        assert got[t] == (int(value) if value == value.to_integral_value() and value < 1 << 63 else None), t


PAIRS = [("1", "8192"), ("1", "3"), ("10", "4"), ("0.1", "0.2"), ("50", "7"), ("1e20", "1e-10"), ("0.12345678912345", "2"), ("99999999999999999999", "3"), ("6", "0"), ("0", "5"), ("7", "-2"), ("1", "1024000"), ("123456789.123456789", "1000000000"), ("x", "1"), ("-2.5", "-2.50"), ("9007199254740993", "9007199254740996")]


@pytest.mark.parametrize("name", ["add", "subtract", "multiply", "divide", "min", "max"])
def test_arithmetic_of_columns_equals_that_of_constants(spark, name):
    def want(a, b):
        try:
            return float(exact.evaluate(name, [a, b]))
        except BuiltinError:
            return None

    df = spark.createDataFrame(PAIRS, "a string, b string")
    rows = df.select("a", "b", numbers.exactly(name, [F.col("a"), F.col("b")]).alias("v")).collect()
    assert [r.v for r in rows] == [want(r.a, r.b) for r in rows]
    real = spark.createDataFrame([(1.0, 8192.0), (0.1, 0.2), (2.0, 3.0), (5.0, 0.0), (9007199254740992.0, 1.0), (3.5, 0.5), (0.30000000000000004, 3.0)], "a double, b double")
    config = document("$VARIABLES.x", {"a": {"type": "number"}, "b": {"type": "number"}, "x": derived("number", "f", "$VARIABLES.a", "$VARIABLES.b")}, {"f": builtin(name)})
    out = Mapping.from_dict(config).apply(real, on_error="quarantine", resolve_derive_args=True).collect()
    for r in out:
        assert r.output == want(r.a, r.b) and [d.code for d in r["_diagnostics"]] == ([] if r.output is not None else ["VARIABLE_DERIVE"]), r


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.decimals(allow_nan=False, allow_infinity=False, places=6, min_value=-(10**9), max_value=10**9), min_size=3, max_size=3))
def test_sums_of_three_keep_every_digit(spark, values):
    texts = [format(v, "f") for v in values]
    df = spark.createDataFrame([texts], "a string, b string, c string")
    for name in ("add", "multiply"):
        assert df.select(numbers.exactly(name, [F.col(c) for c in "abc"])).first()[0] == float(exact.evaluate(name, texts))


def test_padding_to_the_length_of_a_column(spark):
    df = spark.createDataFrame([("a", 3, "3", "-"), ("abcd", 2, "x", "+-"), (None, 6, "6.0", ""), ("b", None, "2", None)], "t string, n int, s string, f string")
    names = {"t": "string", "n": "integer", "s": "string", "f": "string"}

    def run(fn, *args):
        config = document("$VARIABLES.x", {k: {"type": v} for k, v in names.items()} | {"x": derived("string", "p", *args)}, {"p": builtin(fn)})
        rows = Mapping.from_dict(config).apply(df, on_error="quarantine", resolve_derive_args=True).collect()
        assert all((r.output is None) == ([d.code for d in r["_diagnostics"]] == ["VARIABLE_DERIVE"]) for r in rows)
        return [r.output for r in rows]

    v = "$VARIABLES."
    assert run("pad_left", v + "t", v + "n", "*") == ["**a", "abcd", "**null", None]
    assert run("pad_right", v + "t", v + "s") == ["a  ", None, None, "b "]
    assert run("pad_right", v + "t", 3, v + "f") == ["a--", "abcd", None, "b  "]


def test_numbers_out_of_range_are_refused_at_once():
    with pytest.raises(BuiltinError):
        exact.evaluate("add", ["1", "1e99999999999"])
