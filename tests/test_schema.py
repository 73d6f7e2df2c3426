import json

import pytest
from pyspark.sql import functions as F

from mapweave import ConfigValidationError, Mapping, MappingError
from mapweave.queries import builtin, document
from mapweave.schema import validate as js
from mapweave.schema.generator import generate_json_schema, spark_schema

CASES = [
    ({"type": "object", "required": ["a"], "properties": {"a": {"type": "string", "pattern": "b"}}}, [{"a": "abc"}, {"a": "x"}, {"a": None}]),
    ({"properties": {"a": {"enum": ["abc", None]}}}, [{"a": "abc"}, {"a": "x"}, {"a": None}]),
    ({"properties": {"a": {"const": "x"}}, "additionalProperties": False}, [{"a": "abc"}, {"a": "x"}, {"a": None}]),
    ({"properties": {"a": {"minLength": 2, "maxLength": 3, "type": ["string", "null"]}}}, [{"a": "abc"}, {"a": "x"}, {"a": "abcd"}, {"a": None}]),
    ({"properties": {"n": {"type": "integer", "minimum": 2, "exclusiveMaximum": 5}}}, [{"n": 2}, {"n": 1}, {"n": 5}, {"n": 4}]),
    ({"properties": {"n": {"type": "string"}}}, [{"n": 2}]),
    ({"additionalProperties": False}, [{"n": 2}]),
    ({"additionalProperties": {"type": "number", "maximum": 1}}, [{"n": 2}, {"n": 1}]),
    ({"required": ["other"]}, [{"n": 2}]),
    ({"properties": {"xs": {"type": "array", "minItems": 1, "maxItems": 3, "uniqueItems": True, "items": {"type": "string", "maxLength": 1}}}}, [{"xs": ["a"]}, {"xs": []}, {"xs": ["a", "a"]}, {"xs": ["ab"]}, {"xs": ["a", "b", "c", "d"]}]),
    ({"allOf": [{"properties": {"n": {"minimum": 1}}}, {"properties": {"n": {"maximum": 3}}}]}, [{"n": 0}, {"n": 2}, {"n": 4}]),
    ({"properties": {"n": {"anyOf": [{"maximum": 1}, {"minimum": 3}]}}}, [{"n": 0}, {"n": 2}, {"n": 4}]),
    ({"properties": {"n": {"oneOf": [{"maximum": 3}, {"minimum": 2}]}}}, [{"n": 0}, {"n": 2}, {"n": 4}]),
    ({"properties": {"n": {"not": {"minimum": 2}}}}, [{"n": 0}, {"n": 2}]),
    ({"definitions": {"small": {"maximum": 1}}, "properties": {"n": {"$ref": "#/definitions/small"}}}, [{"n": 0}, {"n": 2}]),
    ({"properties": {"o": {"type": "object", "properties": {"k": {"type": "string"}}, "required": ["k"]}}}, [{"o": {"k": "x"}}, {"o": {"k": None}}, {"o": None}]),
    (True, [{"n": 1}]),
    ({"properties": {"n": False}}, [{"n": 1}]),
    ({"properties": {"n": {"multipleOf": 0.5}}}, [{"n": 1.5}, {"n": 1.25}, {"n": 2}]),
    ({"properties": {"n": {"multipleOf": 3}}}, [{"n": 9}, {"n": 10}, {"n": 0}]),
    ({"patternProperties": {"^n": {"minimum": 1}}, "additionalProperties": False}, [{"n": 1}, {"n": 0}, {"a": "x"}]),
    ({"propertyNames": {"maxLength": 1}}, [{"n": 1}, {"xs": ["a"]}]),
    ({"minProperties": 2}, [{"n": 1}]),
    ({"maxProperties": 1, "properties": {"o": {"maxProperties": 0}}}, [{"n": 1}, {"o": {"k": "x"}}]),
    ({"if": {"properties": {"n": {"minimum": 5}}}, "then": {"properties": {"n": {"multipleOf": 5}}}, "else": {"properties": {"n": {"multipleOf": 2}}}}, [{"n": 10}, {"n": 7}, {"n": 4}, {"n": 3}]),
    ({"properties": {"xs": {"contains": {"const": "a"}}}}, [{"xs": ["b", "a"]}, {"xs": ["b"]}, {"xs": []}]),
    ({"properties": {"xs": {"items": [{"const": "a"}, {"minLength": 2}], "additionalItems": {"maxLength": 1}}}}, [{"xs": ["a", "bb", "c"]}, {"xs": ["a"]}, {"xs": ["b", "x", "yy"]}]),
    ({"properties": {"xs": {"items": [True], "additionalItems": False}}}, [{"xs": ["a"]}, {"xs": ["a", "b"]}]),
    ({"dependencies": {"n": ["a"], "o": {"required": ["xs"]}}}, [{"n": 1}, {"a": "x"}, {"o": {"k": "y"}}]),
    ({"properties": {"o": {"const": {"k": "x"}}, "xs": {"enum": [["a"], ["b", "c"]]}}}, [{"o": {"k": "x"}}, {"o": {"k": "y"}}, {"xs": ["b", "c"]}, {"xs": ["c", "b"]}]),
    ({"definitions": {"word": {"$id": "#w", "pattern": r"^\p{L}+$"}}, "properties": {"a": {"$ref": "#w", "maxLength": 1}}}, [{"a": "été"}, {"a": "x1"}]),
]
TYPES = {"a": "string", "n": "double", "xs": "array<string>", "o": "struct<k:string>"}


@pytest.mark.parametrize("schema, values", CASES)
def test_columns_agree_with_plain_validation(spark, schema, values):
    read = js.read_schema(schema)
    for name in {k for v in values for k in v}:
        texts = [json.dumps(v) for v in values if name in v]
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        typed = df.withColumn("v", F.from_json("t", f"struct<{name}:{TYPES[name]}>"))
        for d in (typed, df.withColumn("v", F.parse_json("t")), df.select("t", F.from_json("t", f"struct<{name}:variant>").alias("v"))):
            out = d.select("t", js.error_column(F.col("v"), d.schema["v"].dataType, F.col("t"), read).alias("e"))
            assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
            for r in out.collect():
                assert [(x.path, x.message) for x in r.e] == js.errors_of(json.loads(r.t), read), (r.t, d.schema)


def test_documents_in_a_variant(spark):
    schema = {"type": "object", "required": ["id"], "properties": {"id": {"type": "integer"}, "tags": {"type": "array", "items": {"type": "string", "pattern": "^[a-z]+$"}}, "at": {"type": ["string", "null"]}}, "patternProperties": {"^x-": {"type": "boolean"}}, "additionalProperties": {"type": "number", "maximum": 10}}
    values = [{"id": 1}, {"id": 2.0, "tags": ["a", "B", 3]}, {"id": 2.00000000001}, {"tags": None}, {"id": 1, "x-a": 1, "x-b": True, "n": 11, "m": 2, "at": None}, [1], "text", None, {"id": 10**25}, {"id": 1e30}]
    read = js.read_schema(schema)
    df = spark.createDataFrame([(json.dumps(v),) for v in values], "t string").withColumn("v", F.parse_json("t"))
    for r in df.select("t", js.error_column(F.col("v"), df.schema["v"].dataType, F.col("t"), read).alias("e")).collect():
        assert [(x.path, x.message) for x in r.e] == js.errors_of(json.loads(r.t), read), r.t


def test_a_schema_that_refers_to_itself(spark):
    read = js.read_schema({"type": "object", "properties": {"value": {"type": "integer"}, "next": {"$ref": "#"}}, "additionalProperties": False})
    assert js.refers_to_itself(read)
    values = [{"value": 1, "next": {"value": 2, "next": {"value": "x"}}}, {"value": 1, "next": {}}]
    df = spark.createDataFrame([(json.dumps(v),) for v in values], "t string").withColumn("v", F.parse_json("t"))
    got = df.select(js.error_column(F.col("v"), df.schema["v"].dataType, F.col("t"), read).alias("e")).collect()
    assert [[tuple(x) for x in r.e] for r in got] == [[("$.next.next.value", "type must be integer")], []]


def test_dialects(spark):
    assert js.dialect_of({}, None) == "draft-07" and js.dialect_of({"$schema": "https://json-schema.org/draft/2020-12/schema"}, None) == "2020-12" and js.dialect_of({"$schema": "x"}, "draft-04") == "draft-04"
    bounds = {"minimum": 2, "exclusiveMinimum": True, "maximum": 5, "exclusiveMaximum": False}
    old = js.read_schema(bounds, "draft-04")
    assert [bool(js.errors_of(n, old)) for n in (2, 3, 5, 6)] == [True, False, False, True]
    df = spark.createDataFrame([(2.0,), (3.0,), (5.0,), (6.0,)], "n double")
    assert [bool(r.e) for r in df.select(js.error_column(F.col("n"), df.schema["n"].dataType, F.col("n").cast("string"), old).alias("e")).collect()] == [True, False, False, True]
    # keywords that a dialect doesn't have yet, or no longer
    assert not js.errors_of("a", js.read_schema({"const": "b"}, "draft-04")) and js.errors_of("a", js.read_schema({"const": "b"}, "draft-06"))
    assert not js.errors_of(1, js.read_schema({"if": True, "then": False}, "draft-06")) and js.errors_of(1, js.read_schema({"if": True, "then": False}, "draft-07"))
    assert not js.errors_of({"a": 1}, js.read_schema({"dependencies": {"a": ["b"]}}, "2020-12")) and js.errors_of({"a": 1}, js.read_schema({"dependentRequired": {"a": ["b"]}}, "2020-12"))
    assert js.errors_of([1, "x"], js.read_schema({"prefixItems": [{"type": "integer"}], "items": {"type": "integer"}}, "2020-12")) and not js.errors_of([1, "x"], js.read_schema({"prefixItems": [{"type": "integer"}]}, "2020-12"))
    # what stands beside a reference counts from 2019-09 on
    beside = {"$defs": {"n": {"type": "integer"}}, "properties": {"v": {"$ref": "#/$defs/n", "maximum": 3}}}
    assert not js.errors_of({"v": 5}, js.read_schema(beside, "draft-07")) and js.errors_of({"v": 5}, js.read_schema(beside, "2019-09"))
    counted = js.read_schema({"contains": {"type": "string"}, "minContains": 2, "maxContains": 2}, "2019-09")
    assert [bool(js.errors_of(x, counted)) for x in (["a"], ["a", "b"], ["a", "b", "c"])] == [True, False, True]


def test_unknown_keywords_and_references_are_errors(spark, tmp_path):
    for bad in ({"minimun": 1}, {"properties": {"a": {"unevaluatedProperties": False}}}, {"items": [1]}, 3, {"$ref": "#/nope"}, {"$ref": "http://elsewhere/x"}, {"$ref": "#anchor"}):
        with pytest.raises(ConfigValidationError):
            js.read_schema(bad)
    (tmp_path / "parts.json").write_text(json.dumps({"definitions": {"code": {"type": "string", "pattern": "^[A-Z]{2}$"}, "both": {"$ref": "#/definitions/code"}}}))
    (tmp_path / "main.json").write_text(json.dumps({"properties": {"v": {"$ref": "parts.json#/definitions/both"}}}))
    config = document({"v": "$VARIABLES.v"}, {"v": {"type": "string"}}, schemas={"s": {"ref": "classpath:main.json"}}, validation={"r": {"schema": "s", "phase": "post-map"}})
    m = Mapping.from_dict(config, schema_roots=[str(tmp_path)])
    df = spark.createDataFrame([("AB",), ("abc",)], "v string")
    assert [[d.code for d in r["_diagnostics"]] for r in m.apply(df, on_error="quarantine").collect()] == [[], ["RESULT_SCHEMA_VALIDATION"]]
    (tmp_path / "main.json").write_text(json.dumps({"properties": {"v": {"pattern": "("}}}))
    with pytest.raises(MappingError) as e:
        m.apply(df)
    assert e.value.code == "CONFIG_ERROR"


def test_result_validation(spark, tmp_path):
    (tmp_path / "out.json").write_text(json.dumps({"type": "object", "properties": {"v": {"pattern": "^[A-Z]+$"}}}))
    config = document({"v": "$VARIABLES.v"}, {"v": {"type": "string"}}, schemas={"s": {"ref": "classpath:/out.json"}}, validation={"r": {"schema": "s", "phase": "post-map"}}, engine={"validation": "$SCHEMA.s"})
    df = spark.createDataFrame([("OK",), ("bad",)], "v string")
    m = Mapping.from_dict(config, schema_roots=[str(tmp_path)])
    rows = m.apply(df, on_error="quarantine").collect()
    assert rows[0].output.v == "OK" and rows[1].output is None
    assert [d.pointer for d in rows[1]["_diagnostics"]] == ["/ENGINE/validation", "/VALIDATION/r"]
    assert rows[1]["_diagnostics"][0].code == "RESULT_SCHEMA_VALIDATION" and json.loads(rows[1]["_diagnostics"][0].details["errors"])[0]["path"] == "$.v"
    with pytest.raises(Exception, match="RESULT_SCHEMA_VALIDATION"):
        m.apply(df).collect()
    assert m.apply(df, validate=False).count() == 2
    with pytest.raises(ConfigValidationError):
        Mapping.from_dict(config).apply(df)
    with pytest.raises(MappingError):
        Mapping.from_dict(document({}, engine={"validation": "nope"})).apply(df)


LOANS = document(
    "x",
    {
        "shelf": {"type": "string", "required": True, "constraints": ["$FUNCTIONS.shelfmark"], "description": "where it stands"},
        "medium": {"type": "string", "enum": ["paper", "audio"], "nullable": True},
        "genre": {"type": "string", "enum": ["novel", "verse"], "default": "novel"},
        "title": {"type": " String ", "minLength": 1, "maxLength": 90, "constraints": ["$FUNCTIONS.shelfmark", "$FUNCTIONS.ends", "$FUNCTIONS.stamp", "unlisted", "unlisted"]},
        "due": {"type": "string", "derive": {"function": "$FUNCTIONS.stamp"}},
        "reader": {"type": "object", "fields": {"card": {"type": "integer", "required": True}, "names": {"type": "array", "maxItems": 3, "items": {"type": "string"}}, "fee": {"type": "number"}, "age": {"type": "Enum", "values": ["adult", "child"]}}, "requiredFields": ["names", "card"]},
        "notes": {"type": "object"},
        "marks": {"type": "array", "minItems": 2, "maxItems": 5},
    },
    {"shelfmark": {"type": "regex", "pattern": "^[A-F][0-9]{3}"}, "ends": {"type": "regex", "pattern": "[a-z]$"}, "stamp": builtin("date_utc")},
)


def test_generated_schema():
    got = generate_json_schema(json.dumps(LOANS))
    p = got["properties"]
    assert got["$schema"].startswith("http://json-schema.org/draft-07") and got["title"] == "query" and got["x-targetAspect"] == "urn:mapweave:query"
    assert got["type"] == "object" and got["required"] == ["shelf"] and got["additionalProperties"] is False and list(p) == list(LOANS["VARIABLES"])
    assert p["shelf"] == {"type": "string", "pattern": "^[A-F][0-9]{3}", "description": "where it stands"}
    assert p["medium"] == {"type": ["string", "null"], "enum": ["paper", "audio", None]}
    assert p["genre"] == {"type": "string", "enum": ["novel", "verse"], "default": "novel"}
    assert p["title"] == {"type": "string", "minLength": 1, "maxLength": 90, "allOf": [{"pattern": "^[A-F][0-9]{3}"}, {"pattern": "[a-z]$"}], "x-constraints": ["$FUNCTIONS.stamp", "unlisted"]}
    assert p["due"] == {"type": "string", "readOnly": True}
    assert p["reader"] == {"type": "object", "properties": {"card": {"type": "integer"}, "names": {"type": "array", "maxItems": 3, "items": {"type": "string"}}, "fee": {"type": "number"}, "age": {"type": "string", "enum": ["adult", "child"]}}, "required": ["names", "card"], "additionalProperties": False}
    assert p["notes"] == {"type": "object"} and p["marks"] == {"type": "array", "minItems": 2, "maxItems": 5}


def test_spark_schema_and_errors():
    s = spark_schema(json.dumps(LOANS))
    assert s["reader"].dataType.simpleString() == "struct<card:bigint,names:array<string>,fee:variant,age:string>" and not s["shelf"].nullable and s["medium"].nullable
    assert s["notes"].dataType.simpleString() == "variant" and s["marks"].dataType.simpleString() == "array<variant>"
    for spec in ({"type": "array", "items": {"x": 1}}, {"type": "date"}):
        with pytest.raises(ConfigValidationError):
            generate_json_schema(json.dumps(document("x", {"v": spec})))
