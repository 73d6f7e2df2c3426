"""Configuration documents: structural check, parsing into dataclasses, reference resolution.

Everything here runs once on the driver.  Objects are kept as lists of pairs
until they are checked, so duplicate keys are seen.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from decimal import Decimal
from typing import Any

from mapweave.errors import ConfigValidationError, MappingError

SECTIONS = ("META", "ENGINE", "INPUT", "SCHEMA", "FUNCTIONS", "VARIABLES", "MAPPINGS", "VALIDATION")
TYPES = ("string", "number", "integer", "boolean", "object", "array")
_NAME = re.compile(r"[A-Za-z0-9_.-]+")


class Pairs(list):
    """A JSON object as written: (key, value) pairs in order."""


def load_pairs(text: str | bytes) -> Any:
    try:
        return json.loads(text, parse_float=Decimal, object_pairs_hook=Pairs)
    except (ValueError, UnicodeDecodeError) as e:
        raise ConfigValidationError(f"configuration isn't JSON: {e}") from e


def plain(value: Any) -> Any:
    """Pairs as dicts; the last of equal keys wins."""
    if isinstance(value, Pairs):
        return {k: plain(v) for k, v in value}
    return [plain(v) for v in value] if isinstance(value, list) else value


# ---- structural check: one table of fields for each kind of entry

_KINDS = {
    "string": lambda v: isinstance(v, str),
    "boolean": lambda v: isinstance(v, bool),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool),
    "array": lambda v: isinstance(v, list) and not isinstance(v, Pairs),
    "strings": lambda v: isinstance(v, list) and not isinstance(v, Pairs) and all(isinstance(x, str) for x in v),
    "object": lambda v: isinstance(v, Pairs),
    "any": lambda v: True,
}
_META = {k: "string" for k in ("dslVersion", "name", "targetAspect", "description", "owner", "lastUpdated")}
_ENGINE = {"api": "string", "output": "string", "validation": "string"}
_ENTRIES: dict[str, tuple[dict[str, str], tuple[str, ...]]] = {
    "INPUT": ({"type": "string", "required": "boolean", "nullable": "boolean", "default": "any", "description": "string"}, ("type",)),
    "SCHEMA": ({"ref": "string", "dialect": "string", "strict": "boolean"}, ("ref",)),
    "FUNCTIONS": ({"type": "string", "pattern": "string", "fn": "string", "args": "array", "description": "string"}, ("type",)),
    "VARIABLES": (
        {"type": "string", "required": "boolean", "nullable": "boolean", "constraints": "strings", "default": "any", "derive": "object", "description": "string", "enum": "array", "items": "object", "fields": "object", "requiredFields": "strings"}
        | {k: "integer" for k in ("maxLength", "minLength", "minItems", "maxItems")},
        ("type",),
    ),
    "MAPPINGS": ({"REF": "string", "MAP": "any"}, ("REF", "MAP")),
    "VALIDATION": ({"schema": "string", "phase": "string"}, ("schema", "phase")),
}


def _fields(where: str, pairs: Any, allowed: dict[str, str], required: tuple[str, ...]) -> dict:
    if not isinstance(pairs, Pairs):
        raise ConfigValidationError(f"{where} must be an object")
    for key, value in pairs:
        if key not in allowed:
            raise ConfigValidationError(f"unknown field {key} in {where}")
        if not _KINDS[allowed[key]](value):
            raise ConfigValidationError(f"{where}.{key} must be of kind {allowed[key]}")
    found = dict(pairs)
    if lacking := [k for k in required if k not in found]:
        raise ConfigValidationError(f"{where} lacks {', '.join(lacking)}")
    return found


def check(document: Any) -> None:
    """Raise ConfigValidationError unless the document has the eight sections in their form."""
    if not isinstance(document, Pairs):
        raise ConfigValidationError("the document must be an object")
    names = [k for k, _ in document]
    for name in names:
        if name not in SECTIONS:
            raise ConfigValidationError(f"unknown section {name}")
        if names.count(name) > 1:
            raise ConfigValidationError(f"section {name} stands twice")
    if lacking := [s for s in SECTIONS if s not in names]:
        raise ConfigValidationError(f"missing sections: {', '.join(lacking)}")
    sections = dict(document)
    _fields("META", sections["META"], _META, ("dslVersion", "name", "targetAspect"))
    _fields("ENGINE", sections["ENGINE"], _ENGINE, ("api", "output"))
    for section, (allowed, required) in _ENTRIES.items():
        if not isinstance(sections[section], Pairs):
            raise ConfigValidationError(f"section {section} must be an object")
        for name, entry in sections[section]:
            where = f"{section}.{name}"
            if not _NAME.fullmatch(name):
                raise ConfigValidationError(f"invalid identifier in {section}: {name}")
            found = _fields(where, entry, allowed, required)
            if section == "FUNCTIONS":
                if found["type"] not in ("regex", "builtin"):
                    raise ConfigValidationError(f"{where}.type must be regex or builtin")
                needed = "pattern" if found["type"] == "regex" else "fn"
                if needed not in found:
                    raise ConfigValidationError(f"{where} lacks {needed}")
            if section == "VARIABLES" and "derive" in found:
                _fields(f"{where}.derive", found["derive"], {"function": "string", "args": "array"}, ("function",))
            if section == "VALIDATION" and found["phase"] not in ("pre-map", "post-map"):
                raise ConfigValidationError(f"{where}.phase must be pre-map or post-map")


# ---- model


@dataclass(frozen=True)
class Literal:
    value: Any


@dataclass(frozen=True)
class Ref:
    """A reference to a variable, an input or a mapping."""

    kind: str
    name: str


@dataclass(frozen=True)
class Obj:
    fields: tuple[tuple[str, Any], ...]


@dataclass(frozen=True)
class Arr:
    items: tuple[Any, ...]


PREFIXES = {"$VARIABLES.": "variable", "$INPUT.": "input", "$MAPPINGS.": "mapping"}


def parse_node(value: Any, pointer: str) -> Any:
    if isinstance(value, Pairs):
        keys = [k for k, _ in value]
        if len(set(keys)) < len(keys):
            raise MappingError("CONFIG_ERROR", "a MAP object has a field twice", pointer)
        return Obj(tuple((k, parse_node(v, f"{pointer}/{k}")) for k, v in value))
    if isinstance(value, list):
        return Arr(tuple(parse_node(v, f"{pointer}/{k}") for k, v in enumerate(value)))
    if isinstance(value, str):
        for prefix, kind in PREFIXES.items():
            if value.startswith(prefix):
                return Ref(kind, value[len(prefix) :])
    return Literal(value)


def references(node: Any):
    """All Refs below a node, in document order."""
    if isinstance(node, Ref):
        yield node
    for child in [v for _, v in node.fields] if isinstance(node, Obj) else node.items if isinstance(node, Arr) else ():
        yield from references(child)


def size_of(node: Any) -> int:
    return 1 + sum(size_of(c) for c in ([v for _, v in node.fields] if isinstance(node, Obj) else node.items if isinstance(node, Arr) else ()))


@dataclass(frozen=True)
class Function:
    name: str
    kind: str
    pattern: str | None
    fn: str | None
    args: tuple


@dataclass(frozen=True)
class Variable:
    name: str
    type: str
    required: bool = False
    nullable: bool = False
    default: Any = None
    derive: tuple[str, tuple] | None = None
    constraints: tuple[str, ...] = ()


@dataclass(frozen=True)
class Config:
    meta: dict
    engine: dict
    inputs: dict[str, Variable] = field(default_factory=dict)
    schemas: dict[str, dict] = field(default_factory=dict)
    functions: dict[str, Function] = field(default_factory=dict)
    variables: dict[str, Variable] = field(default_factory=dict)
    mappings: dict[str, tuple[str, Any]] = field(default_factory=dict)
    validation: dict[str, tuple[str, str]] = field(default_factory=dict)


def _entries(sections: dict, name: str, unique: bool = True):
    pairs = sections.get(name, Pairs())
    keys = [k for k, _ in pairs]
    for k in keys:
        if unique and keys.count(k) > 1:
            raise MappingError("CONFIG_ERROR", f"duplicate identifier {k}", f"/{name}")
    for k, v in pairs:
        yield k, dict(v) if isinstance(v, Pairs) else v


def function_name(ref: Any, pointer: str) -> str:
    if ref is None:
        raise MappingError("REFERENCE_NULL", "a function reference is missing", pointer)
    if not ref.startswith("$FUNCTIONS."):
        raise MappingError("REFERENCE_FORMAT", f"{ref} isn't of the form $FUNCTIONS.name", pointer)
    return ref[len("$FUNCTIONS.") :]


def parse(document: Pairs, builtins) -> Config:
    """Dataclasses of a document, with every reference resolved."""
    sections = dict(document)

    def variable(name: str, v: dict, section: str) -> Variable:
        kind = str(v.get("type", "")).lower()
        if kind not in TYPES:
            raise MappingError("CONFIG_ERROR", f"unknown type {v.get('type')}", f"/{section}/{name}")
        derive = dict(v["derive"]) if v.get("derive") is not None else None
        made = derive and (function_name(derive.get("function"), f"/{section}/{name}/derive"), tuple(plain(derive.get("args") or [])))
        constraints = tuple(function_name(c, f"/{section}/{name}/constraints") for c in v.get("constraints", ()))
        return Variable(name, kind, bool(v.get("required")), bool(v.get("nullable")), plain(v.get("default")), made, constraints)

    functions = {k: Function(k, v["type"], v.get("pattern"), v.get("fn"), tuple(plain(v.get("args") or []))) for k, v in _entries(sections, "FUNCTIONS")}
    for f in functions.values():
        if f.kind == "builtin" and f.fn not in builtins:
            raise MappingError("CONFIG_ERROR", f"unknown builtin {f.fn}", f"/FUNCTIONS/{f.name}")
    config = Config(
        plain(sections.get("META", Pairs())),
        plain(sections.get("ENGINE", Pairs())),
        {k: variable(k, v, "INPUT") for k, v in _entries(sections, "INPUT")},
        {k: plain(Pairs(v.items())) for k, v in _entries(sections, "SCHEMA")},
        functions,
        {k: variable(k, v, "VARIABLES") for k, v in _entries(sections, "VARIABLES")},
        {k: (v["REF"], parse_node(v["MAP"], f"/MAPPINGS/{k}/MAP")) for k, v in _entries(sections, "MAPPINGS")},
        {k: (v["schema"], v["phase"]) for k, v in _entries(sections, "VALIDATION", unique=False)},
    )
    _resolve(config)
    return config


def schema_name(ref: str) -> str:
    return ref.removeprefix("$SCHEMA.")


def _resolve(config: Config) -> None:
    for v in config.variables.values():
        for name in ([v.derive[0]] if v.derive else []) + list(v.constraints):
            if name not in config.functions:
                raise MappingError("REFERENCE_UNKNOWN_FUNCTION", f"unknown function {name}", f"/VARIABLES/{v.name}")
    known = {"variable": config.variables, "input": config.inputs, "mapping": config.mappings}
    for name, (_, node) in config.mappings.items():
        for ref in references(node):
            if ref.name not in known[ref.kind]:
                raise MappingError(f"REFERENCE_UNKNOWN_{ref.kind.upper()}", f"unknown {ref.kind} {ref.name}", f"/MAPPINGS/{name}")
    for name, (schema, _) in config.validation.items():
        if schema_name(schema) not in config.schemas:
            raise MappingError("REFERENCE_UNKNOWN_SCHEMA", f"unknown schema {schema}", f"/VALIDATION/{name}")
    done: set[str] = set()
    for start in config.mappings:
        path: list[str] = []
        stack = [(start, False)]
        while stack:
            name, leave = stack.pop()
            if leave:
                path.pop()
                done.add(name)
            elif name in path:
                raise MappingError("REFERENCE_CYCLE", " -> ".join([*path[path.index(name) :], name]), f"/MAPPINGS/{name}")
            elif name not in done:
                path.append(name)
                stack.append((name, True))
                stack += [(r.name, False) for r in references(config.mappings[name][1]) if r.kind == "mapping"][::-1]
