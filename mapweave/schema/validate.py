"""JSON-Schema validation: in Python for constants, as Spark columns for outputs.

`read_schema` turns a schema of any dialect into one form: dictionaries whose
keywords mean the same everywhere, with references replaced by what they name.
Keywords that a dialect doesn't have are left out, as it says; keywords that
none has are errors, so that nothing passes unchecked by a slip.

`error_column` checks a Spark column, typed or Variant, by expressions alone.
Patterns are Java's and searched, not matched whole.  Only a schema that refers
to itself over a Variant, which may be of any depth, is checked in Python on
Arrow batches; there patterns are those of the regex module.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from decimal import Decimal
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mapweave.errors import ConfigValidationError
from mapweave.functions.numbers import bind

try:
    import regex as _regex
except ImportError:
    _regex = re

DIALECTS = ("draft-04", "draft-06", "draft-07", "2019-09", "2020-12")
#: Keywords and the first dialect that has them: fixed values.
_SINCE = {
    0: "type required properties additionalProperties patternProperties pattern enum minLength maxLength minimum maximum exclusiveMinimum exclusiveMaximum multipleOf minItems maxItems items additionalItems uniqueItems minProperties maxProperties dependencies allOf anyOf oneOf not $ref",
    1: "const contains propertyNames",
    2: "if then else",
    3: "minContains maxContains dependentRequired dependentSchemas",
    4: "prefixItems",
}
SINCE = {k: n for n, keys in _SINCE.items() for k in keys.split()}
#: The last dialect that has them.
_UNTIL = {"dependencies": 2, "additionalItems": 3}
ANNOTATIONS = frozenset("$schema $id id $anchor title description default examples $comment definitions $defs format readOnly writeOnly deprecated contentEncoding contentMediaType".split())
_ONE, _MANY, _NAMED = ("items", "contains", "not", "additionalProperties", "propertyNames", "if", "then", "else"), ("allOf", "anyOf", "oneOf"), ("properties", "patternProperties", "dependentSchemas")
ERRORS = "array<struct<path:string,message:string>>"


def dialect_of(schema: Any, named: str | None) -> str:
    """The dialect named by the configuration, else by $schema, else draft-07."""
    for text in (named, schema.get("$schema") if isinstance(schema, dict) else None):
        if text:
            for d in DIALECTS:
                if d in text:
                    return d
    return "draft-07"


class _Reader:
    def __init__(self, root: Any, dialect: str, fetch: Callable[[str], Any] | None):
        self.documents, self.level, self.fetch, self.known = {"": root}, DIALECTS.index(dialect), fetch, {}

    def refer(self, ref: str, document: str) -> dict:
        name, _, fragment = ref.partition("#")
        name = name or document
        if name not in self.documents:
            if "://" in name and not name.startswith("file:") or self.fetch is None:
                raise ConfigValidationError(f"a reference to another document that can't be read: {ref}")
            self.documents[name] = self.fetch(name)
        if (name, fragment) not in self.known:
            self.known[name, fragment] = out = {}
            out.update(self.read(self.lookup(name, fragment, ref), name, ref))
        return self.known[name, fragment]

    def lookup(self, name: str, fragment: str, ref: str) -> Any:
        found = self.documents[name]
        if fragment and not fragment.startswith("/"):
            found = next(self.anchored(found, fragment), None)
            if found is None:
                raise ConfigValidationError(f"reference without target: {ref}")
            return found
        for part in filter(None, fragment.split("/")):
            key = part.replace("~1", "/").replace("~0", "~").replace("%25", "%")
            if isinstance(found, list) and key.isdigit() and int(key) < len(found):
                found = found[int(key)]
            elif isinstance(found, dict) and key in found:
                found = found[key]
            else:
                raise ConfigValidationError(f"reference without target: {ref}")
        return found

    def anchored(self, node: Any, name: str):
        if isinstance(node, dict):
            if node.get("$anchor") == name or node.get("$id") == f"#{name}" or node.get("id") == f"#{name}":
                yield node
            for child in node.values():
                yield from self.anchored(child, name)
        elif isinstance(node, list):
            for child in node:
                yield from self.anchored(child, name)

    def read(self, raw: Any, document: str, pointer: str) -> dict:
        if isinstance(raw, bool):
            return {} if raw else {"never": True}
        if not isinstance(raw, dict):
            raise ConfigValidationError(f"schema at {pointer or '/'} must be an object or boolean")
        for key in raw:
            if key not in SINCE and key not in ANNOTATIONS and not key.startswith("x-"):
                raise ConfigValidationError(f"unsupported schema keyword {key} at {pointer or '/'}")
        has = {k: v for k, v in raw.items() if k in SINCE and SINCE[k] <= self.level <= _UNTIL.get(k, 9)}
        if "$ref" in has and self.level <= 2:
            has = {"$ref": has["$ref"]}  # what stands beside a reference is ignored
        inside = lambda v, *at: self.read(v, document, "/".join([pointer, *map(str, at)]))
        out: dict[str, Any] = {}
        if "$ref" in has:
            out["ref"] = self.refer(has.pop("$ref"), document)
        if self.level == 0:
            for low, high in (("minimum", "exclusiveMinimum"), ("maximum", "exclusiveMaximum")):
                if has.pop(high, False) is True and low in has:
                    has[high] = has.pop(low)
        if isinstance(has.get("items"), list):
            has["prefixItems"] = has.pop("items")
            has["items"] = has.pop("additionalItems", True)
        has.pop("additionalItems", None)
        for key, wanted in has.pop("dependencies", {}).items():
            has.setdefault("dependentRequired" if isinstance(wanted, list) else "dependentSchemas", {})[key] = wanted
        for key, v in has.items():
            if key in _ONE:
                out[key] = inside(v, key)
            elif key in _MANY or key == "prefixItems":
                out[key] = [inside(s, key, k) for k, s in enumerate(v)]
            elif key in _NAMED:
                out[key] = {n: inside(s, key, n) for n, s in v.items()}
            else:
                out[key] = [v] if key == "type" and isinstance(v, str) else v
        return out


def read_schema(schema: Any, dialect: str | None = None, fetch: Callable[[str], Any] | None = None) -> dict:
    """The schema in the one form; dialect as `dialect_of` names it, fetch reads other documents by name."""
    return _Reader(schema, dialect or dialect_of(schema, None), fetch).read(schema, "", "")


def _below(s: dict):
    if "ref" in s:
        yield s["ref"]
    for k in _ONE:
        if k in s:
            yield s[k]
    for k in (*_MANY, "prefixItems"):
        yield from s.get(k, ())
    for k in _NAMED:
        yield from s.get(k, {}).values()


def patterns(schema: dict) -> set[str]:
    """All regular expressions of a read schema."""
    found, seen, todo = set(), set(), [schema]
    while todo:
        s = todo.pop()
        if id(s) not in seen:
            seen.add(id(s))
            found |= {s["pattern"]} if "pattern" in s else set()
            found |= set(s.get("patternProperties", ()))
            todo += _below(s)
    return found


def refers_to_itself(schema: dict) -> bool:
    path: set[int] = set()
    done: set[int] = set()

    def walk(s):
        if id(s) in path:
            return True
        if id(s) in done:
            return False
        path.add(id(s))
        found = any(walk(x) for x in _below(s))
        path.discard(id(s))
        done.add(id(s))
        return found

    return walk(schema)


# ---- in Python


def _is(value: Any, kind: str) -> bool:
    number = isinstance(value, (int, float, Decimal)) and not isinstance(value, bool)
    return {
        "string": isinstance(value, str),
        "number": number,
        "integer": number and value == int(value),
        "boolean": isinstance(value, bool),
        "object": isinstance(value, dict),
        "array": isinstance(value, list),
        "null": value is None,
    }[kind]


def _canonical(value: Any) -> str:
    if isinstance(value, (float, Decimal)):
        value = int(value) if value == int(value) else float(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k)}:{_canonical(v)}" for k, v in sorted(value.items())) + "}"
    return "[" + ",".join(map(_canonical, value)) + "]" if isinstance(value, list) else json.dumps(value)


def errors_of(value: Any, s: dict, path: str = "$") -> list[tuple[str, str]]:
    """(path, message) of every violation of a read schema, by path."""
    if s.get("never"):
        return [(path, "nothing is allowed here")]
    out: list[tuple[str, str]] = []
    say = lambda text: out.append((path, text))
    inside = lambda sub, v=value, p=path: errors_of(v, sub, p)
    outside = lambda low, high, n: n < s.get(low, n) or n > s.get(high, n)
    if "ref" in s:
        out += inside(s["ref"])
    if "type" in s and not any(_is(value, k) for k in s["type"]):
        say(_type_text(s))
    if "enum" in s and _canonical(value) not in map(_canonical, s["enum"]):
        say("value isn't in enum")
    if "const" in s and _canonical(value) != _canonical(s["const"]):
        say("value isn't the constant")
    if isinstance(value, str):
        if "pattern" in s and not _regex.search(s["pattern"], value):
            say(f"doesn't match {s['pattern']}")
        if outside("minLength", "maxLength", len(value)):
            say("length is out of bounds")
    if _is(value, "number"):
        if outside("minimum", "maximum", value) or ("exclusiveMinimum" in s and value <= s["exclusiveMinimum"]) or ("exclusiveMaximum" in s and value >= s["exclusiveMaximum"]):
            say("number is out of bounds")
        if "multipleOf" in s and Decimal(str(value)) % Decimal(str(s["multipleOf"])):
            say(f"isn't a multiple of {s['multipleOf']}")
    if isinstance(value, list):
        if outside("minItems", "maxItems", len(value)):
            say("number of items is out of bounds")
        if s.get("uniqueItems") and len(set(map(_canonical, value))) < len(value):
            say("items must be unique")
        first = s.get("prefixItems", [])
        for k, v in enumerate(value):
            sub = first[k] if k < len(first) else s.get("items", {})
            out += inside(sub, v, f"{path}[{k}]")
        if "contains" in s:
            n = sum(not inside(s["contains"], v) for v in value)
            if n < s.get("minContains", 1) or n > s.get("maxContains", n):
                say("number of contained items is out of bounds")
    if isinstance(value, dict):
        for name in s.get("required", ()):
            if name not in value:
                say(f"required property {name} is missing")
        if outside("minProperties", "maxProperties", len(value)):
            say("number of properties is out of bounds")
        for name, v in value.items():
            matched = [sub for p, sub in s.get("patternProperties", {}).items() if _regex.search(p, name)]
            if name in s.get("properties", {}):
                matched.append(s["properties"][name])
            rest = s.get("additionalProperties", {})
            if not matched and rest.get("never"):
                say(f"property {name} isn't defined")
            elif not matched:
                matched = [rest]
            for sub in matched:
                out += inside(sub, v, f"{path}.{name}")
            if "propertyNames" in s and inside(s["propertyNames"], name):
                say(f"property name {name} isn't allowed")
        for name, needed in s.get("dependentRequired", {}).items():
            if name in value and not set(needed) <= set(value):
                say(f"property {name} needs {', '.join(needed)}")
        for name, sub in s.get("dependentSchemas", {}).items():
            if name in value:
                out += inside(sub)
    for sub in s.get("allOf", ()):
        out += inside(sub)
    if "anyOf" in s and all(inside(x) for x in s["anyOf"]):
        say("matches none of anyOf")
    if "oneOf" in s and sum(not inside(x) for x in s["oneOf"]) != 1:
        say("must match one of oneOf")
    if "not" in s and not inside(s["not"]):
        say("matches what it must not")
    if "if" in s:
        out += inside(s.get("else", {}) if inside(s["if"]) else s.get("then", {}))
    return sorted(out)


def _type_text(s: dict) -> str:
    return f"type must be {s['type'][0] if len(s['type']) == 1 else s['type']}"


# ---- as columns

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_NUMBERS = (*_INTEGRAL, T.FloatType, T.DoubleType, T.DecimalType)


class View:
    """What a check asks of a column, typed or Variant.  Nothing it gives is null, but for values that aren't of the kind."""

    def __init__(self, c: Column, t: T.DataType, path: Column):
        self.c, self.t, self.path = c, t, path
        self.dynamic = isinstance(t, T.VariantType)
        self.shape = F.coalesce(F.schema_of_variant(c), F.lit("VOID")) if self.dynamic else None

    def kind(self) -> str:
        for kind, types in {"string": T.StringType, "boolean": T.BooleanType, "number": _NUMBERS, "object": (T.StructType, T.MapType), "array": T.ArrayType}.items():
            if isinstance(self.t, types):
                return kind
        return "string"  # dates and such are written as text

    def is_(self, kind: str) -> Column:
        if not self.dynamic:
            if kind == "null":
                return self.c.isNull()
            if kind != "integer":
                return self.c.isNotNull() & F.lit(self.kind() == kind)
            if self.kind() != "number":
                return F.lit(False)
            whole = F.floor if isinstance(self.t, T.DecimalType) else F.rint
            return self.c.isNotNull() if isinstance(self.t, _INTEGRAL) else F.coalesce(whole(self.c) == self.c, F.lit(False))
        starts = {"string": ["STRING"], "boolean": ["BOOLEAN"], "object": ["OBJECT"], "array": ["ARRAY"], "null": ["VOID"], "integer": ["BIGINT"], "number": ["BIGINT", "DECIMAL", "DOUBLE", "FLOAT"]}[kind]
        found = F.lit(False)
        for x in starts:
            found = found | self.shape.startswith(x)
        if kind == "integer":
            exact, real = F.try_variant_get(self.c, "$", "decimal(38,18)"), F.try_variant_get(self.c, "$", "double")
            found = found | F.when(self.shape.startswith("DECIMAL"), F.coalesce(F.floor(exact) == exact, F.rint(real) == real)).when(self.shape.startswith("DOUBLE"), F.rint(real) == real).otherwise(False)
        return F.coalesce(found, F.lit(False))

    def text(self) -> Column:
        return F.try_variant_get(self.c, "$", "string") if self.dynamic else self.c.cast("string")

    def number(self) -> Column:
        return F.try_variant_get(self.c, "$", "double") if self.dynamic else self.c

    def decimal(self) -> Column:
        return self.text().try_cast("decimal(38,18)")

    def items(self) -> tuple[Column, T.DataType]:
        return (F.try_variant_get(self.c, "$", "array<variant>"), T.VariantType()) if self.dynamic else (self.c, self.t.elementType)

    def keys(self) -> Column:
        if self.dynamic:
            return F.json_object_keys(F.to_json(self.c))
        return F.map_keys(self.c) if isinstance(self.t, T.MapType) else F.array(*[F.lit(n) for n in self.t.fieldNames()])

    def has(self, name: str) -> Column:
        if not self.dynamic and isinstance(self.t, T.StructType):
            return F.lit(name in self.t.fieldNames())
        return F.coalesce(F.array_contains(self.keys(), name), F.lit(False))

    def get(self, name: str) -> tuple[Column, T.DataType]:
        if self.dynamic:
            quoted = name.replace("\\", "\\\\").replace("'", "\\'")
            return F.try_variant_get(self.c, f"$['{quoted}']", "variant"), self.t
        return (F.element_at(self.c, name), self.t.valueType) if isinstance(self.t, T.MapType) else (self.c.getField(name), self.t[name].dataType)

    def entries(self) -> tuple[Column, T.DataType]:
        """Name and value of properties that aren't known beforehand, as array of (key, value)."""
        found = F.try_variant_get(self.c, "$", "map<string,variant>") if self.dynamic else self.c
        return F.map_entries(found), T.VariantType() if self.dynamic else self.t.valueType

    def json(self) -> Column:
        if self.dynamic:
            return F.to_json(self.c)
        return F.to_json(F.to_variant_object(self.c) if self.kind() in ("object", "array") else self.c.cast("variant"))


def _all(parts: list[Column]) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def _none() -> Column:
    return F.array().cast(ERRORS)


def errors_at(v: View, s: dict) -> Column:
    """Violations of a read schema by a column, as an array of (path, message)."""
    said: list[Column] = []
    nested: list[Column] = []

    def say(text: str | Column, bad: Column) -> None:
        said.append(F.when(F.coalesce(bad, F.lit(False)), F.struct(v.path.alias("path"), (text if isinstance(text, Column) else F.lit(text)).alias("message"))))

    def valid(sub: dict, c: Column = v.c, t: T.DataType = v.t) -> Column:
        return F.size(errors_at(View(c, t, F.lit("$")), sub)) == 0

    def child(c: Column, t: T.DataType, path: Column, sub: dict, when: Column) -> None:
        if sub:
            nested.append(F.when(when, bind(c, lambda x: errors_at(View(x, t, path), sub)) if v.dynamic else errors_at(View(c, t, path), sub)).otherwise(_none()))

    if s.get("never"):
        return F.array(F.struct(v.path.alias("path"), F.lit("nothing is allowed here").alias("message"))).cast(ERRORS)
    if "ref" in s:
        nested.append(errors_at(v, s["ref"]))
    if "type" in s:
        say(_type_text(s), _all([~v.is_(k) for k in s["type"]]))
    for key, values in (("enum", s.get("enum")), ("const", [s["const"]] if "const" in s else None)):
        if values is not None:
            say("value isn't in enum" if key == "enum" else "value isn't the constant", _all([~_same(v, x) for x in values]))
    possible = lambda kind: v.dynamic or v.kind() == kind
    between = lambda n, low, high: (n < s.get(low, 0)) | (n > s.get(high, 1 << 60))
    if possible("string") and {"pattern", "minLength", "maxLength"} & s.keys():
        is_text, text = v.is_("string"), v.text()
        if "pattern" in s:
            say(f"doesn't match {s['pattern']}", is_text & ~text.rlike(s["pattern"]))
        if "minLength" in s or "maxLength" in s:
            say("length is out of bounds", is_text & between(F.length(text), "minLength", "maxLength"))
    if possible("number") and {"minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf"} & s.keys():
        is_number, n = v.is_("number"), v.number()
        bad = F.lit(False)
        for key, test in (("minimum", n.__lt__), ("maximum", n.__gt__), ("exclusiveMinimum", n.__le__), ("exclusiveMaximum", n.__ge__)):
            bad = bad | test(F.lit(s[key])) if key in s else bad
        say("number is out of bounds", is_number & bad)
        if "multipleOf" in s:
            unit = Decimal(str(s["multipleOf"]))
            rest = F.coalesce(v.decimal() % F.lit(unit) != 0, v.number().cast("double") % float(unit) != 0)
            say(f"isn't a multiple of {s['multipleOf']}", is_number & rest)
    if possible("array") and {"minItems", "maxItems", "uniqueItems", "prefixItems", "items", "contains"} & s.keys():
        here = v.is_("array")
        items, kind = v.items()
        if "minItems" in s or "maxItems" in s:
            say("number of items is out of bounds", here & between(F.size(items), "minItems", "maxItems"))
        if s.get("uniqueItems"):
            same = F.transform(items, lambda x: View(x, kind, F.lit("$")).json())
            say("items must be unique", here & (F.size(F.array_distinct(same)) < F.size(items)))
        first = s.get("prefixItems", [])
        for k, sub in enumerate(first):
            child(F.get(items, k), kind, F.concat(v.path, F.lit(f"[{k}]")), sub, here & (F.size(items) > k))
        if s.get("items"):

            def one(x, k):
                found = errors_at(View(x, kind, F.concat(v.path, F.lit("["), k.cast("string"), F.lit("]"))), s["items"])
                return F.when(k >= len(first), found).otherwise(_none())

            nested.append(F.when(here, F.flatten(F.transform(items, one))).otherwise(_none()))
        if "contains" in s:
            n = F.size(F.filter(items, lambda x: valid(s["contains"], x, kind)))
            say("number of contained items is out of bounds", here & ((n < s.get("minContains", 1)) | (n > s.get("maxContains", 1 << 60))))
    if possible("object"):
        here = v.is_("object")
        for name in s.get("required", ()):
            say(f"required property {name} is missing", here & ~v.has(name))
        if "minProperties" in s or "maxProperties" in s:
            say("number of properties is out of bounds", here & between(F.size(v.keys()), "minProperties", "maxProperties"))
        properties, by_pattern, rest = s.get("properties", {}), s.get("patternProperties", {}), s.get("additionalProperties", {})
        known = not v.dynamic and isinstance(v.t, T.StructType)
        for name in v.t.fieldNames() if known else properties:
            matched = [sub for p, sub in by_pattern.items() if _java_search(p, name)] if known else []
            if name in properties:
                matched.append(properties[name])
            elif known and not matched:
                if rest.get("never"):
                    say(f"property {name} isn't defined", here)
                else:
                    matched.append(rest)
            c, t = v.get(name)
            for sub in matched:
                child(c, t, F.concat(v.path, F.lit(f".{name}")), sub, here & (F.lit(True) if known else v.has(name)))
        if not known and (by_pattern or rest):
            pairs, kind = v.entries()

            def entry(e):
                name, value = e["key"], e["value"]
                path = F.concat(v.path, F.lit("."), name)
                parts, other = [], ~name.isin(*properties) if properties else F.lit(True)
                for p, sub in by_pattern.items():
                    parts.append(F.when(name.rlike(p), errors_at(View(value, kind, path), sub)).otherwise(_none()))
                    other = other & ~name.rlike(p)
                if rest.get("never"):
                    wrong = F.array(F.struct(v.path.alias("path"), F.concat(F.lit("property "), name, F.lit(" isn't defined")).alias("message"))).cast(ERRORS)
                    parts.append(F.when(other, wrong).otherwise(_none()))
                elif rest:
                    parts.append(F.when(other, errors_at(View(value, kind, path), rest)).otherwise(_none()))
                return F.concat(*parts)

            nested.append(F.when(here, F.flatten(F.transform(pairs, entry))).otherwise(_none()))
        if s.get("propertyNames"):
            wrong = F.filter(v.keys(), lambda k: ~valid(s["propertyNames"], k, T.StringType()))
            named = F.transform(wrong, lambda k: F.struct(v.path.alias("path"), F.concat(F.lit("property name "), k, F.lit(" isn't allowed")).alias("message")))
            nested.append(F.when(here, named).otherwise(_none()).cast(ERRORS))
        for name, needed in s.get("dependentRequired", {}).items():
            say(f"property {name} needs {', '.join(needed)}", here & v.has(name) & ~_all([v.has(n) for n in needed]))
        for name, sub in s.get("dependentSchemas", {}).items():
            nested.append(F.when(here & v.has(name), errors_at(v, sub)).otherwise(_none()))
    for sub in s.get("allOf", ()):
        nested.append(errors_at(v, sub))
    if "anyOf" in s:
        say("matches none of anyOf", _all([~valid(x) for x in s["anyOf"]]))
    if "oneOf" in s:
        say("must match one of oneOf", sum((valid(x).cast("int") for x in s["oneOf"]), F.lit(0)) != 1)
    if "not" in s:
        say("matches what it must not", valid(s["not"]))
    if "if" in s:
        nested.append(F.when(valid(s["if"]), errors_at(v, s.get("then", {}))).otherwise(errors_at(v, s.get("else", {}))))
    own = F.array_compact(F.array(*said)).cast(ERRORS) if said else _none()
    return F.concat(own, *nested) if nested else own


def _java_search(pattern: str, text: str) -> bool:
    """Whether a pattern is found in a constant, as Java sees it where a classic session runs here."""
    from pyspark import SparkContext

    context = SparkContext._active_spark_context
    if context is not None and context._jvm is not None:
        return bool(context._jvm.java.util.regex.Pattern.compile(pattern).matcher(text).find())
    return bool(_regex.search(pattern, text))


def _same(v: View, x: Any) -> Column:
    """Whether a column equals a JSON constant."""
    if x is None:
        return v.is_("null")
    if isinstance(x, (dict, list)):
        kind = "object" if isinstance(x, dict) else "array"
        return v.is_(kind) & (v.json() == F.to_json(F.parse_json(F.lit(json.dumps(x))))) if v.dynamic or v.kind() == kind else F.lit(False)
    if isinstance(x, bool):
        flag = F.try_variant_get(v.c, "$", "boolean") if v.dynamic else v.c
        return F.coalesce(v.is_("boolean") & (flag == x), F.lit(False)) if v.dynamic or v.kind() == "boolean" else F.lit(False)
    kind = "string" if isinstance(x, str) else "number"
    if not v.dynamic and v.kind() != kind:
        return F.lit(False)
    return F.coalesce(v.is_(kind) & ((v.text() if kind == "string" else v.number()) == F.lit(x)), F.lit(False))


def holds_variant(t: T.DataType) -> bool:
    if isinstance(t, T.StructType):
        return any(holds_variant(f.dataType) for f in t.fields)
    if isinstance(t, T.ArrayType):
        return holds_variant(t.elementType)
    return holds_variant(t.valueType) if isinstance(t, T.MapType) else isinstance(t, T.VariantType)


def error_column(c: Column, t: T.DataType, json_text: Column, schema: dict) -> Column:
    """Violations of a read schema by path, as an array column."""
    if not refers_to_itself(schema):
        return F.array_sort(errors_at(View(c, t, F.lit("$")), schema)).cast(ERRORS)
    # typed columns are of a certain depth, but a schema that refers to itself has none

    @F.pandas_udf("string")
    def check(texts: pd.Series) -> pd.Series:
        found = ([] if text is None else errors_of(json.loads(text, parse_float=Decimal), schema) for text in texts)
        return pd.Series([json.dumps([{"path": p, "message": m} for p, m in x]) for x in found], dtype=object)

    return F.from_json(check(json_text), ERRORS)
