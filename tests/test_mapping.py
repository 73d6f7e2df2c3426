import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from mapweave import Mapping, MappingError
from mapweave.queries import builtin, derived, document
from mapweave.sources.io import one_payload

FUNCTIONS = {"up": builtin("uppercase"), "pad": builtin("pad_left"), "sum": builtin("add"), "between": builtin("pos_int_between", 5, 3), "caps": {"type": "regex", "pattern": "^[A-Z]+$"}, "short": {"type": "regex", "pattern": ".{1,2}"}, "uuid": builtin("uuid")}


def run(spark, config, payload=None, **options):
    options.setdefault("payload", "payload")
    return json.loads(Mapping.from_dict(config).to_json_df(one_payload(spark, payload), **options).first().output)


def codes(spark, config, payload=None, **options):
    out = Mapping.from_dict(config).apply(one_payload(spark, payload), payload="payload", on_error="quarantine", **options).first()
    assert (out.output is None) == bool(out["_diagnostics"])
    return [d.code for d in out["_diagnostics"]]


def one(spec, **functions):
    return document({"v": "$VARIABLES.v"}, {"v": spec}, FUNCTIONS | functions)


def test_weather_report(spark):
    """Most kinds of nodes in one document."""
    config = document(
        ["$MAPPINGS.place", {"readings": "$VARIABLES.readings", "unit": "$INPUT.unit", "mean": "$VARIABLES.mean", "checked": True}, "$VARIABLES.note"],
        {
            "station": {"type": "string", "required": True, "constraints": ["$FUNCTIONS.caps"]},
            "height": {"type": "integer"},
            "readings": {"type": "array", "required": True},
            "mean": derived("number", "half", 9),
            "note": derived("string", "up", "dry"),
            "unused": {"type": "boolean", "required": True},
        },
        FUNCTIONS | {"half": builtin("divide", 2)},
        {"unit": {"type": "string", "default": "K"}, "decade": {"type": "integer", "required": True}},
        place={"name": "$VARIABLES.station", "above": {"sea": "$VARIABLES.height"}, "since": "$INPUT.decade"},
    )
    payload = {"station": "OSLO", "height": "23", "readings": [271.5, None, {"gust": 4}], "more": [1]}
    assert run(spark, config, payload, inputs={"decade": 1990.0}) == [{"name": "OSLO", "above": {"sea": 23}, "since": 1990}, {"readings": [271.5, None, {"gust": 4}], "unit": "K", "mean": 4.5, "checked": True}, "DRY"]
    assert run(spark, config, payload | {"note": "wet"}, inputs={"decade": "2000", "unit": "C"})[2] == "wet"
    with pytest.raises(MappingError) as e:
        run(spark, config, payload)
    assert e.value.code == "INPUT_REQUIRED"
    with pytest.raises(MappingError) as e:
        Mapping.from_dict(document("$INPUT.n", inputs={"n": {"type": "integer"}})).apply(spark.range(1), inputs={"n": "2.5"})
    assert e.value.code == "INPUT_TYPE"


@pytest.mark.parametrize(
    "kind, value, want",
    [
        ("string", 1, "1"), ("string", True, "true"), ("string", {"a": 1}, '{"a":1}'), ("number", "1.50", 1.5), ("number", 2, 2), ("number", ".5e1", 5), ("integer", 2.0, 2), ("integer", "2.0", 2), ("integer", "-7", -7),
        ("boolean", "TRUE", True), ("boolean", False, False), ("object", {"a": None}, {"a": None}), ("array", [1, "a"], [1, "a"]), ("integer", 9223372036854775807, 9223372036854775807),
    ],
)
def test_coercion(spark, kind, value, want):
    assert run(spark, one({"type": kind}), {"v": value}) == {"v": want}


@pytest.mark.parametrize("kind, value", [("number", "x"), ("number", " 1"), ("number", True), ("number", [1]), ("integer", 2.5), ("integer", "9223372036854775808"), ("integer", "1e30"), ("boolean", 1), ("boolean", "yes"), ("object", "x"), ("object", [1]), ("array", {"a": 1})])
def test_coercion_failures(spark, kind, value):
    assert codes(spark, one({"type": kind}), {"v": value}) == ["VARIABLE_TYPE"]


def test_default_before_derive_and_required(spark):
    assert run(spark, one(derived("string", "up", "x") | {"default": "d"}), {"v": None}) == {"v": "d"}
    assert run(spark, one(derived("string", "up", "x"))) == {"v": "X"}
    assert run(spark, one({"type": "string"})) == {"v": None}
    assert codes(spark, one({"type": "string", "required": True}), {"v": None}) == ["VARIABLE_REQUIRED"]
    assert codes(spark, one({"type": "integer", "default": "2.5"})) == ["VARIABLE_TYPE"]
    assert run(spark, one({"type": "integer", "default": "2.5"}), {"v": 1}) == {"v": 1}
    assert codes(spark, one(derived("integer", "between"))) == ["VARIABLE_DERIVE"]
    assert codes(spark, one(derived("string", "caps"))) == ["VARIABLE_DERIVE"]


def test_constraints_in_order(spark):
    spec = {"type": "string", "constraints": ["$FUNCTIONS.up", "$FUNCTIONS.caps", "$FUNCTIONS.short"]}
    assert run(spark, one(spec), {"v": "AB"}) == {"v": "AB"} and run(spark, one(spec)) == {"v": None}
    out = Mapping.from_dict(one(spec)).apply(one_payload(spark, {"v": "abc"}), payload="payload", on_error="quarantine").first()["_diagnostics"]
    assert [(d.code, d.pointer, d.details["function"]) for d in out] == [("VARIABLE_CONSTRAINT", "/VARIABLES/v", "caps")] and "abc" in out[0].message and "^[A-Z]+$" in out[0].message
    assert codes(spark, one(spec), {"v": "AB\n"}) == ["VARIABLE_CONSTRAINT"]
    assert codes(spark, one({"type": "integer", "constraints": ["$FUNCTIONS.caps"]}), {"v": 1}) == ["VARIABLE_CONSTRAINT"]


def test_fail_policy_stops_and_laziness_spares_unused(spark):
    config = document({"a": "$VARIABLES.a"}, {"a": {"type": "string"}, "b": {"type": "string", "required": True}})
    assert run(spark, config, {"a": "x"}) == {"a": "x"}
    with pytest.raises(Exception, match="VARIABLE_REQUIRED"):
        run(spark, config, {"a": "x"}, with_variables=True)
    with pytest.raises(Exception, match="VARIABLE_REQUIRED"):
        run(spark, one({"type": "string", "required": True}))


def test_first_diagnostic_follows_the_document(spark):
    config = document({"z": "$VARIABLES.z", "m": "$MAPPINGS.m"}, {"a": {"type": "string", "required": True}, "z": {"type": "integer"}}, m=["$VARIABLES.a"])
    assert codes(spark, config, {"z": "x"}) == ["VARIABLE_TYPE", "VARIABLE_REQUIRED"]


def test_literals_arrays_and_roots(spark):
    assert run(spark, document({"n": None, "i": 1, "f": 1.25, "s": "$FUNCTIONS.x", "o": {}, "a": [], "mixed": [1, "a", None, [True], {"k": None}]})) == {"n": None, "i": 1, "f": 1.25, "s": "$FUNCTIONS.x", "o": {}, "a": [], "mixed": [1, "a", None, [True], {"k": None}]}
    assert run(spark, document(["x"])) == ["x"] and run(spark, document(3)) == 3 and run(spark, document(None)) is None
    assert run(spark, document("$MAPPINGS.b", b={"REF": "r", "MAP": "text"})) == {"REF": "r", "MAP": "text"}
    with pytest.raises(MappingError):
        Mapping.from_bytes(json.dumps(document({"a": 1})).replace('{"a": 1}', '{"a": 1, "a": 2}'))


def test_random_values_are_drawn_once(spark):
    config = document({"a": "$VARIABLES.u", "b": ["$VARIABLES.u"], "m": "$MAPPINGS.m"}, {"u": derived("string", "uuid")}, FUNCTIONS, m="$VARIABLES.u")
    df = spark.range(50)
    rows = Mapping.from_dict(config).apply(df).collect()
    assert all(r.output.a == r.output.b[0] == r.output.m for r in rows) and len({r.output.a for r in rows}) == 50


def test_large_shared_mappings_get_one_column(spark):
    big = {f"f{k}": "$VARIABLES.v" for k in range(200)}
    m = Mapping.from_dict(document({"x": "$MAPPINGS.big", "y": "$MAPPINGS.big"}, {"v": {"type": "string"}}, big=big))
    out = m.apply(spark.createDataFrame([("a",)], "v string"))
    assert out.first().output.x == out.first().output.y and out.first().output.x.f199 == "a"


def test_typed_payloads_with_odd_names(spark):
    df = spark.createDataFrame([(1, Decimal("2.50"), 1.5, "x", [1], {"k": 1}), (None,) * 6], "`a.b` int, `c-d` decimal(10,2), e double, f string, g array<int>, h map<string,int>")
    kinds = {"a.b": "integer", "c-d": "number", "e": "number", "f": "string", "g": "array", "h": "object"}
    m = Mapping.from_dict(document({k: f"$VARIABLES.{k}" for k in kinds}, {k: {"type": t} for k, t in kinds.items()}))
    rows = [json.loads(r.output) for r in m.to_json_df(df, keep=[]).collect()]
    assert rows == [{"a.b": 1, "c-d": 2.5, "e": 1.5, "f": "x", "g": [1], "h": {"k": 1}}, dict.fromkeys(kinds)]
    assert set(m.apply(df).columns) == {*df.columns, "output"}
    wrong = Mapping.from_dict(document({"v": "$VARIABLES.f"}, {"f": {"type": "object"}}))
    assert wrong.apply(df, on_error="quarantine").first()["_diagnostics"][0].code == "VARIABLE_TYPE"


def test_typed_object_default_and_snapshot(spark):
    df = spark.createDataFrame([(1, (5,)), (2, None)], "id int, o struct<k:int>")
    config = document({"o": "$VARIABLES.o"}, {"o": {"type": "object", "default": {"k": 9}}, "id": {"type": "integer"}})
    out = Mapping.from_dict(config).to_json_df(df, with_variables=True).collect()
    assert [json.loads(r.output) for r in out] == [{"o": {"k": 5}}, {"o": {"k": 9}}]
    assert [json.loads(r.variables_json) for r in out] == [{"o": {"k": 5}, "id": 1}, {"o": {"k": 9}, "id": 2}]


def test_malformed_json_payload(spark):
    df = spark.createDataFrame([('{"v": "a"}',), ("{",), (None,), ("null",)], "payload string")
    rows = Mapping.from_dict(one({"type": "string"})).to_json_df(df, payload="payload", on_error="quarantine").collect()
    assert [r.output for r in rows] == ['{"v":"a"}', None, '{"v":null}', '{"v":null}'] and rows[1]["_diagnostics"][0].code == "PAYLOAD_FORMAT"
    with pytest.raises(Exception, match="PAYLOAD_FORMAT"):
        Mapping.from_dict(one({"type": "string"})).apply(df, payload="payload").collect()


def test_plan_is_narrow_and_pruned(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).select("id", F.lit("x").alias("used"), F.lit("y").alias("unused")).write.parquet(path)
    config = document({"v": "$VARIABLES.used"}, {"used": {"type": "string", "required": True, "constraints": ["$FUNCTIONS.c"]}, "unused": {"type": "string", "required": True}}, {"c": {"type": "regex", "pattern": "x"}})
    out = Mapping.from_dict(config).apply(spark.read.parquet(path), keep=["id"]).filter("id > 3")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    assert "GreaterThan(id,3)" in plan and "unused" not in plan.split("ReadSchema")[1]
