"""Variables and inputs: lookup, default, derivation, coercion, constraints.

A resolved variable is two columns, its value and its diagnostic (null where
all is well).  They live in one projection below the output, so a random
value is drawn once however often it is used, and Spark prunes what no output
refers to.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.errors import MappingError
from mapweave.functions import columns, exact
from mapweave.functions.exact import BuiltinError
from mapweave.plans.config import PREFIXES, Config, Variable

from .build import types_of
from .values import coerce_constant, coerce_typed, coerce_variant, literal

DIAGNOSTIC = "struct<code:string,message:string,pointer:string,details:map<string,string>>"


def diagnostic(code: str, message: Column | str, pointer: str, **details: Column | str) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    made = F.create_map(*[as_column(x).cast("string") for k, v in details.items() for x in (k, v)]) if details else F.create_map().cast("map<string,string>")
    return F.struct(F.lit(code).alias("code"), as_column(message).alias("message"), F.lit(pointer).alias("pointer"), made.alias("details")).cast(DIAGNOSTIC)


def none() -> Column:
    return F.lit(None).cast(DIAGNOSTIC)


@dataclass
class Resolved:
    value: Column
    problem: Column


def resolve_inputs(config: Config, given: dict[str, Any], names) -> dict[str, Any]:
    """Host parameters that are used, as constants of their types; raises coded errors."""
    found = {}
    for name in names:
        spec, value = config.inputs[name], given.get(name)
        value = spec.default if value is None else value
        if value is None:
            if spec.required:
                raise MappingError("INPUT_REQUIRED", f"input {name} is required", f"/INPUT/{name}")
            found[name] = None
            continue
        try:
            found[name] = coerce_constant(value, spec.type)
        except BuiltinError as e:
            raise MappingError("INPUT_TYPE", str(e), f"/INPUT/{name}", {"type": spec.type}) from e
    return found


def payload_fields(df: DataFrame, payload: str, names) -> DataFrame:
    """df with each named field of a Variant payload as __p_name and its type as __t_name, so that each is read once."""

    def field(name):
        quoted = name.replace("\\", "\\\\").replace("'", "\\'")
        return F.try_variant_get(F.col(payload), f"$['{quoted}']", "variant")

    df = df.withColumns({f"__p_{n}": field(n) for n in names})
    return df.withColumns({f"__t_{n}": F.schema_of_variant(F.col(f"`__p_{n}`")) for n in names})


class Variables:
    """Resolves the variables of one configuration against one DataFrame of payloads (json: laid out by payload_fields)."""

    def __init__(self, config: Config, df: DataFrame, json: bool, inputs: dict[str, Any], resolve_derive_args: bool):
        self.config, self.df, self.inputs, self.json, self.bind = config, df, inputs, json, resolve_derive_args
        self.fields = {f.name: f.dataType for f in df.schema.fields}

    def raw(self, name: str):
        """(is null, coerce) of the payload value; None where there is no such column."""
        if self.json:
            v, shape = F.col(f"`__p_{name}`"), F.col(f"`__t_{name}`")
            return shape.isNull() | (shape == "VOID"), lambda kind: coerce_variant(v, kind, shape)
        if name not in self.fields:
            return None
        c, source = F.col("`" + name.replace("`", "``") + "`"), self.fields[name]
        missing = c.isNull() | F.is_variant_null(c) if source.typeName() == "variant" else c.isNull()
        return missing, lambda kind: coerce_typed(c, source, kind)

    def _derived(self, v: Variable) -> Resolved:
        """The value a variable has when payload and default are null."""
        where = f"/VARIABLES/{v.name}"
        fail = lambda code, text: Resolved(literal(None), diagnostic(code, text, where))
        if v.default is not None:
            made: Any = v.default
        elif v.derive:
            function = self.config.functions[v.derive[0]]
            if function.kind == "regex":
                return fail("VARIABLE_DERIVE", f"regex function {function.name} can't derive")
            args = exact.merged(v.derive[1], function.args)
            try:
                if function.fn in exact.RANDOM:
                    value = columns.generated(function.fn, args)
                    source = "long" if function.fn in ("date_now_millis", "pos_int_between") else "string"
                    return self._generated(v, value, source)
                bound = [self._bound(a) for a in args] if self.bind else args
                if any(isinstance(a, Column) for a in bound):
                    value, failed = columns.of_columns(function.fn, bound, self._kinds(bound))
                    out = self._generated(v, value, "double" if function.fn in columns.ARITHMETIC else "string")
                    if failed is not None:
                        out.problem = F.when(F.coalesce(failed, F.lit(True)), diagnostic("VARIABLE_DERIVE", f"{function.fn} failed", where)).otherwise(out.problem)
                        if function.fn not in columns.ARITHMETIC:  # which gives null where it fails
                            out.value = F.when(~F.coalesce(failed, F.lit(True)), out.value)
                    return out
                made = exact.evaluate(function.fn, bound)
            except BuiltinError as e:
                return fail("VARIABLE_DERIVE", str(e))
        else:
            made = None
        if made is None:
            return fail("VARIABLE_REQUIRED", f"variable {v.name} is required") if v.required else Resolved(literal(None), none())
        try:
            return Resolved(literal(coerce_constant(made, v.type)), none())
        except BuiltinError as e:
            return fail("VARIABLE_TYPE", str(e))

    def _generated(self, v: Variable, value: Column, source: str) -> Resolved:
        from pyspark.sql.types import DoubleType, LongType, StringType

        out, bad = coerce_typed(value, {"long": LongType(), "double": DoubleType(), "string": StringType()}[source], v.type)
        return Resolved(out, F.when(bad, diagnostic("VARIABLE_TYPE", f"variable {v.name} isn't of type {v.type}", f"/VARIABLES/{v.name}")))

    def _kinds(self, args: list) -> list:
        """Types of the columns among arguments, by analysis."""
        found = iter(types_of(self.df, [a for a in args if isinstance(a, Column)]))
        return [next(found) if isinstance(a, Column) else None for a in args]

    def _bound(self, arg: Any) -> Any:
        """Extension: references in derive arguments stand for their values."""
        if isinstance(arg, str):
            for prefix, kind in PREFIXES.items():
                name = arg[len(prefix) :]
                if arg.startswith(prefix) and kind == "variable" and name in self.config.variables:
                    raw = self.raw(name)
                    return F.lit(None).cast("string") if raw is None else raw[1](self.config.variables[name].type)[0]
                if arg.startswith(prefix) and kind == "input" and name in self.inputs:
                    return self.inputs[name]
        return arg

    def resolve(self, name: str) -> Resolved:
        v, where = self.config.variables[name], f"/VARIABLES/{name}"
        rest, raw = self._derived(v), self.raw(name)
        if raw is None:
            value, problem = rest.value, rest.problem
        else:
            missing, coerce = raw
            own, bad = coerce(v.type)
            wrong = diagnostic("VARIABLE_TYPE", f"variable {name} isn't of type {v.type}", where, type=v.type)
            if v.default is not None and v.type in ("object", "array") and not self.json and self.fields[name].typeName() in ("struct", "map", "array"):
                own = F.to_variant_object(own)  # the default is a Variant
            if v.type == "number" and (self.json or self.fields[name].typeName() in ("string", "variant")):
                rest = Resolved(rest.value.cast("variant"), rest.problem)
            value = own if v.default is None and not v.derive else F.when(missing, rest.value).otherwise(own)
            problem = F.when(missing, rest.problem).when(bad, wrong)
        checks = none()
        for c in reversed(v.constraints):
            function = self.config.functions[c]
            if function.kind == "regex":  # builtin constraints check nothing
                text = value.cast("string")
                ok = text.rlike(rf"\A(?:{function.pattern})\z") if v.type == "string" else F.lit(False)
                message = F.concat(F.lit(f"variable {name} with value '"), text if v.type not in ("object", "array") else F.lit(v.type), F.lit(f"' doesn't match '{function.pattern}'"))
                checks = F.when(value.isNotNull() & ~ok, diagnostic("VARIABLE_CONSTRAINT", message, where, function=c)).otherwise(checks)
        return Resolved(value, F.coalesce(problem, checks) if v.constraints else F.coalesce(problem, none()))
