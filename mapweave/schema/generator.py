"""A JSON Schema (draft-07), and a Spark schema, from the variables of a configuration."""

from __future__ import annotations

from typing import Any

from pyspark.sql import types as T

from mapweave.errors import ConfigValidationError
from mapweave.plans import config as cfg

_LIMITS = {"string": ("minLength", "maxLength"), "array": ("minItems", "maxItems")}


def _limits(entry: dict, kind: str) -> dict:
    return {k: entry[k] for k in _LIMITS.get(kind, ()) if k in entry}


def _enum(entry: dict) -> list | None:
    return entry.get("values") if entry.get("type", "").strip().lower() == "enum" and "values" in entry else entry.get("enum")


def _required(entry: dict) -> list[str]:
    listed = entry.get("required") if isinstance(entry.get("required"), list) else entry.get("requiredFields")
    return list(listed or [])


def _constraints(entry: dict, kind: str, functions: dict) -> dict:
    patterns, others = [], []
    for name in entry.get("constraints", ()):
        f = functions.get(name.removeprefix("$FUNCTIONS."))
        if f and f.get("type") == "regex" and kind == "string":
            patterns.append(f["pattern"])
        elif name not in others:
            others.append(name)
    out: dict[str, Any] = {"pattern": patterns[0]} if len(patterns) == 1 else {"allOf": [{"pattern": p} for p in patterns]} if patterns else {}
    return out | ({"x-constraints": others} if others else {})


def convert(name: str, entry: dict, functions: dict) -> dict:
    """The schema of one variable or nested field."""
    if not isinstance(entry, dict) or "type" not in entry:
        raise ConfigValidationError(f"{name} misses the required field type")
    declared = str(entry["type"]).strip().lower()
    kind = "string" if declared == "enum" else declared
    if kind not in cfg.TYPES:
        raise ConfigValidationError(f"{name} has the unknown type {entry['type']}")
    nullable = entry.get("nullable") is True
    out: dict[str, Any] = {"type": [kind, "null"] if nullable else kind} | _limits(entry, kind)
    values = _enum(entry)
    if values is not None and kind == "string":
        out["enum"] = list(values) + ([None] if nullable and None not in values else [])
    if kind == "object" and isinstance(entry.get("fields"), dict):
        out["properties"] = {k: convert(f"{name}.{k}", v, functions) for k, v in entry["fields"].items()}
        needed = _required(entry) + [k for k, v in entry["fields"].items() if v.get("required") is True]
        out |= {"required": list(dict.fromkeys(needed))} if needed else {}
        out["additionalProperties"] = False
    if kind == "array" and isinstance(entry.get("items"), dict):
        out["items"] = convert(f"{name}[]", entry["items"], functions)
    out |= _constraints(entry, kind, functions)
    if "default" in entry:
        out["default"] = entry["default"]
    if "derive" in entry:
        out["readOnly"] = True
    if "description" in entry:
        out["description"] = entry["description"]
    return out


def _sections(text: str | bytes) -> dict:
    document = cfg.load_pairs(text)
    cfg.check(document)
    return cfg.plain(document)


def generate_json_schema(text: str | bytes) -> dict:
    """Closed object schema of a configuration's variables."""
    sections = _sections(text)
    meta, variables = sections["META"], sections["VARIABLES"]
    out = {"$schema": "http://json-schema.org/draft-07/schema#", "title": meta["name"], "type": "object"}
    out |= {"description": meta["description"]} if "description" in meta else {}
    out["x-targetAspect"] = meta["targetAspect"]
    out["properties"] = {k: convert(k, v, sections["FUNCTIONS"]) for k, v in variables.items()}
    needed = [k for k, v in variables.items() if v.get("required") is True]
    return out | ({"required": needed} if needed else {}) | {"additionalProperties": False}


def _spark_type(name: str, entry: dict) -> T.DataType:
    kind = str(entry.get("type", "")).strip().lower()
    if kind == "object":
        fields = entry.get("fields")
        if not isinstance(fields, dict):
            return T.VariantType()
        needed = _required(entry)
        return T.StructType([T.StructField(k, _spark_type(f"{name}.{k}", v), not (v.get("required") is True or k in needed)) for k, v in fields.items()])
    if kind == "array":
        return T.ArrayType(_spark_type(f"{name}[]", entry["items"]) if isinstance(entry.get("items"), dict) else T.VariantType())
    simple = {"string": T.StringType(), "enum": T.StringType(), "number": T.VariantType(), "integer": T.LongType(), "boolean": T.BooleanType()}
    if kind not in simple:
        raise ConfigValidationError(f"{name} has the unknown type {entry.get('type')}")
    return simple[kind]


def spark_schema(text: str | bytes) -> T.StructType:
    """The Spark schema of payloads that fit a configuration."""
    return T.StructType([T.StructField(k, _spark_type(k, v), v.get("required") is not True) for k, v in _sections(text)["VARIABLES"].items()])
