import io
import json

import pytest

from mapweave import ConfigValidationError, Mapping, MappingError
from mapweave.queries import builtin, derived, document

GOOD = document({"id": "$VARIABLES.id"}, {"id": {"type": "string", "required": True}}, inputs={"a": {"type": "string"}})


def broken(**changes):
    return {k: changes.get(k, v) for k, v in GOOD.items() if changes.get(k, v) is not None}


@pytest.mark.parametrize(
    "document_",
    [
        broken(MAPPINGS=None),
        GOOD | {"EXTRA": {}},
        broken(META={"dslVersion": "v2", "targetAspect": "x"}),
        broken(META={"dslVersion": 2, "name": "n", "targetAspect": "x"}),
        broken(ENGINE={"api": "v2"}),
        broken(ENGINE={"api": "v2", "output": "x", "more": "y"}),
        broken(FUNCTIONS={"f": {"pattern": "x"}}),
        broken(FUNCTIONS={"f": {"type": "regex"}}),
        broken(FUNCTIONS={"f": {"type": "builtin", "pattern": "x"}}),
        broken(FUNCTIONS={"f": {"type": "other"}}),
        broken(FUNCTIONS={"bad name": builtin("uuid")}),
        broken(VARIABLES={"v": {}}),
        broken(VARIABLES={"v": {"type": "string", "maxLength": "3"}}),
        broken(VARIABLES={"v": {"type": "string", "constraints": [1]}}),
        broken(VARIABLES={"v": {"type": "string", "source": "x"}}),
        broken(VARIABLES={"v": {"type": "string", "derive": {"args": []}}}),
        broken(MAPPINGS={"m": {"MAP": {}}}),
        broken(MAPPINGS={"m": {"REF": "m"}}),
        broken(VALIDATION={"r": {"schema": "s", "phase": "later"}}),
        broken(VALIDATION={"r": {"phase": "pre-map"}}),
        broken(SCHEMA={"s": {"dialect": "x"}}),
        broken(SCHEMA={"s": {"ref": "x", "strict": "yes"}}),
        broken(INPUT={"i": {"required": True}}),
        broken(INPUT=[]),
        [],
    ],
)
def test_structural_check(document_):
    with pytest.raises(ConfigValidationError):
        Mapping.from_bytes(json.dumps(document_))


def test_duplicate_sections_and_malformed_text():
    text = json.dumps(GOOD)
    with pytest.raises(ConfigValidationError):
        Mapping.from_bytes(text[:-1] + ', "META": {}}')
    with pytest.raises(ConfigValidationError):
        Mapping.from_bytes(text[:-1])


@pytest.mark.parametrize(
    "code, document_",
    [
        ("REFERENCE_UNKNOWN_VARIABLE", document({"x": "$VARIABLES.nope"})),
        ("REFERENCE_UNKNOWN_INPUT", document({"x": ["$INPUT.nope"]})),
        ("REFERENCE_UNKNOWN_MAPPING", document("$MAPPINGS.nope")),
        ("REFERENCE_CYCLE", document({}, a="$MAPPINGS.b", b={"x": "$MAPPINGS.a"})),
        ("REFERENCE_CYCLE", document("$MAPPINGS.root")),
        ("REFERENCE_UNKNOWN_FUNCTION", document({}, {"v": derived("string", "nope")})),
        ("REFERENCE_FORMAT", document({}, {"v": {"type": "string", "constraints": ["f"]}})),
        ("REFERENCE_UNKNOWN_SCHEMA", document({}, validation={"r": {"schema": "nope", "phase": "pre-map"}})),
        ("CONFIG_ERROR", document({}, {"v": {"type": "date"}})),
        ("CONFIG_ERROR", document({}, functions={"f": builtin("nope")})),
    ],
)
def test_reference_errors(code, document_):
    with pytest.raises(MappingError) as e:
        Mapping.from_dict(document_)
    assert e.value.code == code and e.value.pointer.startswith("/")


def test_duplicate_identifiers():
    text = json.dumps(GOOD).replace('"INPUT": {', '"INPUT": {"a": {"type": "string"}, ')
    with pytest.raises(MappingError, match="duplicate"):
        Mapping.from_bytes(text)


def test_bad_pattern(spark):
    with pytest.raises(MappingError, match="pattern"):
        Mapping.from_dict(document({}, functions={"f": {"type": "regex", "pattern": "("}}))


def test_sources_and_introspection(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps(GOOD))
    for m in (Mapping.from_path(str(path)), Mapping.from_stream(io.BytesIO(path.read_bytes())), Mapping.from_bytes(path.read_bytes())):
        assert m.input_fields == ["a"] and m.output_name() == "root"
    with pytest.raises(OSError):
        Mapping.from_path(str(tmp_path / "none"))
    with pytest.raises(MappingError) as e:
        m.output_name("nope")
    assert e.value.code == "MAPPING_UNKNOWN"
    with pytest.raises(KeyError):
        m.mapping_metrics("nope")
    assert Mapping.from_dict(broken(META=None), check=False).metrics["root"] == {"nodes": 2, "kinds": {"object": 1, "variable_ref": 1}, "fields": 1, "literals": 0, "mappings": []}


def test_a_long_diamond_of_references_is_no_cycle():
    maps = {f"m{k}": [f"$MAPPINGS.m{k + 1}", f"$MAPPINGS.m{k + 1}"] for k in range(12)} | {"m12": {"end": 1}}
    assert Mapping.from_dict(document("$MAPPINGS.m0", **maps)).reached("root")["mapping"] == ["root", *[f"m{k}" for k in range(13)]]
