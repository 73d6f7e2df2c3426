"""Compiled mappings: one narrow projection over a DataFrame of payloads."""

from __future__ import annotations

import logging
import os
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mapweave.errors import ConfigValidationError, MappingError
from mapweave.functions import exact
from mapweave.operators.build import Builder, as_variant, types_of
from mapweave.operators.resolve import DIAGNOSTIC, Variables, diagnostic, payload_fields, resolve_inputs
from mapweave.schema import validate as js
from mapweave.sources import io

from . import config as cfg

log = logging.getLogger("mapweave")
#: The environment variable that turns records of compiled mappings on, and who else is told of them.
RECORD_SWITCH = "MAPWEAVE_METRICS"
recorders: list[Callable[[dict], None]] = []
#: A mapping of more nodes that is used more than once gets a column of its own.
SHARE_ABOVE = 128


def json_text(c: Column, t: T.DataType, pretty: bool = False) -> Column:
    """JSON of any value; nulls are written, decimals without padding."""

    def slim(v: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.DecimalType):
            return v.cast("variant")
        if isinstance(kind, T.StructType) and any(_holds_decimal(f.dataType) for f in kind.fields):
            made = F.struct(*[slim(v.getField(f.name), f.dataType).alias(f.name) for f in kind.fields])
            return F.when(v.isNotNull(), made)
        if isinstance(kind, T.ArrayType) and _holds_decimal(kind.elementType):
            return F.transform(v, lambda x: slim(x, kind.elementType))
        return v

    c = slim(c, t) if isinstance(t, (T.StructType, T.ArrayType)) else c if isinstance(t, (T.MapType, T.VariantType)) else c.cast("variant")
    options = {"ignoreNullFields": "false"} | ({"pretty": "true"} if pretty else {})
    return F.coalesce(F.to_json(c, options), F.lit("null"))


def _holds_decimal(t: T.DataType) -> bool:
    if isinstance(t, T.StructType):
        return any(_holds_decimal(f.dataType) for f in t.fields)
    return _holds_decimal(t.elementType) if isinstance(t, T.ArrayType) else isinstance(t, T.DecimalType)


@dataclass(frozen=True)
class Mapping:
    """A checked configuration and the schemas it names; `apply` runs it."""

    config: cfg.Config
    schema_roots: tuple[str, ...] = ()

    # ---- construction

    @classmethod
    def from_bytes(cls, text: str | bytes, check: bool = True, schema_roots=()) -> Mapping:
        document = cfg.load_pairs(text)
        if check:
            cfg.check(document)
        elif not isinstance(document, cfg.Pairs):
            raise ConfigValidationError("the document must be an object")
        made = cls(cfg.parse(document, exact.BUILTINS), tuple(schema_roots))
        for f in made.config.functions.values():
            if f.kind == "regex":
                made._check_pattern(f.pattern, f"/FUNCTIONS/{f.name}")
        made._record()
        return made

    @classmethod
    def from_path(cls, path: str, **options) -> Mapping:
        return cls.from_bytes(io.read_bytes(path), **options)

    @classmethod
    def from_stream(cls, stream, **options) -> Mapping:
        return cls.from_bytes(stream.read(), **options)

    @classmethod
    def from_dict(cls, document: dict, **options) -> Mapping:
        import json

        return cls.from_bytes(json.dumps(document, default=float), **options)

    @staticmethod
    def _check_pattern(pattern: str, pointer: str) -> None:
        """Patterns are Java's; they are compiled by it where a session runs here."""
        from pyspark import SparkContext

        context = SparkContext._active_spark_context
        if context is not None and context._jvm is not None:
            try:
                context._jvm.java.util.regex.Pattern.compile(pattern)
            except Exception as e:
                raise MappingError("CONFIG_ERROR", f"bad pattern: {pattern}", pointer) from e

    # ---- introspection

    @property
    def input_fields(self) -> list[str]:
        return list(self.config.inputs)

    def _record(self) -> None:
        """One record for each mapping, to the log and to `recorders`, if RECORD_SWITCH is set or there are recorders."""
        if os.environ.get(RECORD_SWITCH, "").lower() in ("1", "true", "yes") or recorders:
            for name, found in self.metrics.items():
                record = {"config": self.config.meta.get("name"), "mapping": name, **found}
                log.info("compiled %s", record)
                for r in recorders:
                    r(record)

    @cached_property
    def _uses(self) -> Counter:
        return Counter(r.name for _, node in self.config.mappings.values() for r in cfg.references(node) if r.kind == "mapping")

    @cached_property
    def metrics(self) -> dict[str, dict]:
        return {name: self.mapping_metrics(name) for name in self.config.mappings}

    def mapping_metrics(self, name: str) -> dict:
        """Nodes by kind, literals, field names and mappings referred to, of one mapping."""
        if name not in self.config.mappings:
            raise KeyError(name)
        kinds: Counter = Counter()
        fields, literals, refs = set(), set(), []

        def walk(node):
            kinds[f"{node.kind}_ref" if isinstance(node, cfg.Ref) else {cfg.Literal: "literal", cfg.Obj: "object", cfg.Arr: "array"}[type(node)]] += 1
            if isinstance(node, cfg.Literal):
                literals.add(repr(node.value))
            if isinstance(node, cfg.Ref) and node.kind == "mapping":
                refs.append(node.name)
            if isinstance(node, cfg.Obj):
                fields.update(k for k, _ in node.fields)
            for child in [v for _, v in node.fields] if isinstance(node, cfg.Obj) else node.items if isinstance(node, cfg.Arr) else ():
                walk(child)

        walk(self.config.mappings[name][1])
        return {"nodes": sum(kinds.values()), "kinds": dict(kinds), "fields": len(fields), "literals": len(literals), "mappings": sorted(set(refs))}

    def output_name(self, mapping: str | None = None) -> str:
        name = mapping if mapping is not None else self.config.engine.get("output", "").removeprefix("$MAPPINGS.")
        if name not in self.config.mappings:
            raise MappingError("MAPPING_UNKNOWN", f"unknown mapping {name}", "/MAPPINGS")
        return name

    def reached(self, mapping: str) -> dict[str, list[str]]:
        """Names of each kind that a mapping uses, in the order of first use."""
        found: dict[str, list[str]] = {"variable": [], "input": [], "mapping": [mapping]}

        def walk(name):
            for r in cfg.references(self.config.mappings[name][1]):
                if r.name not in found[r.kind]:
                    found[r.kind].append(r.name)
                    if r.kind == "mapping":
                        walk(r.name)

        walk(mapping)
        return found

    def checks(self) -> list[tuple[str, str, str, Any]]:
        """(pointer, schema name, ref, schema) of the output checks, in order; pre-map rules aren't run."""
        wanted = [("/ENGINE/validation", self.config.engine["validation"])] if self.config.engine.get("validation") else []
        wanted += [(f"/VALIDATION/{k}", s) for k, (s, phase) in self.config.validation.items() if phase == "post-map"]
        out = []
        for pointer, name in wanted:
            name = cfg.schema_name(name)
            if name not in self.config.schemas:
                raise MappingError("REFERENCE_UNKNOWN_SCHEMA", f"unknown schema {name}", pointer)
            spec = self.config.schemas[name]
            roots = list(self.schema_roots)
            schema = io.load_schema(spec["ref"], roots)
            read = js.read_schema(schema, js.dialect_of(schema, spec.get("dialect")), lambda ref: io.load_schema(ref, roots))
            for pattern in js.patterns(read):
                self._check_pattern(pattern, f"/SCHEMA/{name}")
            out.append((pointer, name, spec["ref"], read))
        return out

    # ---- execution

    def apply(
        self,
        df: DataFrame,
        mapping: str | None = None,
        inputs: dict[str, Any] | None = None,
        *,
        payload: str | None = None,
        on_error: str = "fail",
        validate: bool = True,
        with_variables: bool = False,
        resolve_derive_args: bool = False,
        unwrap_ref_map: bool = False,
        keep: list[str] | None = None,
        output: str = "output",
    ) -> DataFrame:
        """The kept columns of df and `output`, one document for each row.

        Payload values are df's columns of the variables' names, or with
        `payload` the fields of that JSON or Variant column.  A row that
        breaks a rule stops the query ("fail") or gets a null output and its
        diagnostics in `_diagnostics` ("quarantine"), the first being the one
        that would have stopped it.  The mapping's REF is the output column's
        metadata field "ref".  `with_variables` resolves all variables
        and adds `variables_json`.
        """
        if on_error not in ("fail", "quarantine"):
            raise ValueError("on_error must be fail or quarantine")
        name = self.output_name(mapping)
        uses = self.reached(name)
        constants = resolve_inputs(self.config, inputs or {}, uses["input"])
        if resolve_derive_args:
            for k in self.input_fields:
                if k not in constants and (inputs or {}).get(k, self.config.inputs[k].default) is not None:
                    constants |= resolve_inputs(self.config, inputs or {}, [k])
        keep = [c for c in df.columns if c != output] if keep is None else keep
        used = uses["variable"] + ([v for v in self.config.variables if v not in uses["variable"]] if with_variables else [])
        # 1: the payload, parsed once
        bad_payload = None
        if payload is not None and df.schema[payload].dataType != T.VariantType():
            text = F.col(f"`{payload}`")
            df = df.withColumn("__payload", F.try_parse_json(text))
            bad_payload = text.isNotNull() & F.col("__payload").isNull()
        elif payload is not None:
            df = df.withColumn("__payload", F.col(f"`{payload}`"))
        if payload is not None:
            df = payload_fields(df, "__payload", list(self.config.variables) if resolve_derive_args else used)
        # 2: variables; random ones are drawn here, below their uses
        source = Variables(self.config, df, payload is not None, constants, resolve_derive_args)
        names, problems, columns = {}, {}, []
        for k, v in enumerate(used):
            r = source.resolve(v)
            names[v], problems[v] = f"__v{k}", f"__d{k}"
            columns += [r.value.alias(f"__v{k}"), r.problem.alias(f"__d{k}")]
        step = df.select("*", *columns)
        if on_error == "fail":
            stop = {v: F.raise_error(self._message(F.col(problems[v]))) for v in used}
            guarded = {names[v]: F.when(F.col(problems[v]).isNotNull(), stop[v]).otherwise(F.col(names[v])) for v in used}
            step = step.withColumns({k: c.alias(k) for k, c in guarded.items()}) if guarded else step
        # 3: the document
        shared: dict[str, str] = {}
        for k, m in enumerate(reversed(uses["mapping"])):
            if m != name and self._uses[m] > 1 and cfg.size_of(self.config.mappings[m][1]) > SHARE_ABOVE:
                made = Builder(self.config, step, names, constants, shared, unwrap_ref_map).mapping(m)
                step = step.withColumn(f"__m{k}", made)
                shared[m] = f"__m{k}"
        document = Builder(self.config, step, names, constants, shared, unwrap_ref_map).mapping(name)
        step = step.withColumn("__out", document)
        kind = step.schema["__out"].dataType
        # 4: checks of the document
        found = [F.col(problems[v]) for v in used]
        if bad_payload is not None:
            wrong = F.when(bad_payload, diagnostic("PAYLOAD_FORMAT", "the payload isn't JSON", "/"))
            step = step.withColumn("__bad", wrong)
            found.insert(0, F.col("__bad"))
        for k, (pointer, schema, ref, body) in enumerate(self.checks() if validate else []):
            step = step.withColumn(f"__e{k}", js.error_column(F.col("__out"), kind, json_text(F.col("__out"), kind), body))
            errors = F.col(f"__e{k}")
            broken = diagnostic("RESULT_SCHEMA_VALIDATION", F.concat_ws("; ", F.transform(errors, lambda e: F.concat(e["path"], F.lit(": "), e["message"]))), pointer, schema=schema, ref=ref, errors=F.to_json(errors))
            found.append(F.when(F.size(errors) > 0, broken))
        result = F.col("__out")
        extra = []
        if on_error == "fail":
            first = found[:1] if bad_payload is not None else []
            checks = F.coalesce(*first, *found[len(used) + len(first) :]) if first or found[len(used) :] else None
            if checks is not None:
                result = F.when(checks.isNotNull(), F.raise_error(self._message(checks))).otherwise(result)
        else:
            earlier = found[: len(used) + (bad_payload is not None)]
            ok = F.size(F.array_compact(F.array(*earlier))) == 0 if earlier else F.lit(True)
            late = [F.when(ok, c) for c in found[len(earlier) :]]
            diagnostics = F.array_compact(F.array(*earlier, *late)) if found else F.array().cast(f"array<{DIAGNOSTIC}>")
            step = step.withColumn("_diagnostics", diagnostics)
            result = F.when(F.size("_diagnostics") == 0, result)
            extra.append(F.col("_diagnostics"))
        if with_variables:
            every = [F.col(names[v]).alias(v) for v in self.config.variables]
            kinds = types_of(step, [F.struct(*every)])
            snapshot = json_text(F.struct(*every), kinds[0])
            extra.insert(0, (snapshot if on_error == "fail" else F.when(F.size("_diagnostics") == 0, snapshot)).alias("variables_json"))
        return step.select(*[F.col(f"`{c}`") for c in keep if c in df.columns], result.alias(output, metadata={"ref": self.config.mappings[name][0]}), *extra)

    @staticmethod
    def _message(problem: Column) -> Column:
        return F.concat(problem["code"], F.lit(" at "), problem["pointer"], F.lit(": "), problem["message"])

    def to_json_df(self, df: DataFrame, *args, pretty: bool = False, **options) -> DataFrame:
        """As apply, with the document as JSON text."""
        out = self.apply(df, *args, **options)
        name = options.get("output", "output")
        kind = out.schema[name].dataType
        text = json_text(F.col(name), kind, pretty)
        if options.get("on_error") == "quarantine":
            text = F.when(F.size("_diagnostics") == 0, text)
        return out.withColumn(name, text.alias(name, metadata=out.schema[name].metadata))

    def variant(self, df: DataFrame, *args, **options) -> DataFrame:
        """As apply, with the document as Variant: one type whatever the configuration."""
        out = self.apply(df, *args, **options)
        name = options.get("output", "output")
        return out.withColumn(name, as_variant(F.col(name), out.schema[name].dataType).alias(name, metadata=out.schema[name].metadata))

    def explain(self, df: DataFrame, *args, **options) -> str:
        return self.apply(df, *args, **options)._jdf.queryExecution().explainString(self._mode(df))

    @staticmethod
    def _mode(df: DataFrame):
        return df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
