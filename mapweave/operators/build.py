"""Output documents: nodes of the MAP language as Spark columns."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mapweave.plans.config import Arr, Config, Literal, Obj, Ref

from .values import literal

_NESTED = (T.StructType, T.MapType, T.ArrayType)


def as_variant(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.VariantType):
        return c
    if isinstance(kind, T.StructType) and not kind.fields:
        return F.parse_json(F.lit("{}"))
    return F.to_variant_object(c) if isinstance(kind, _NESTED) else c.cast("variant")


def types_of(df: DataFrame, parts: list[Column]) -> list[T.DataType]:
    """Types of expressions over df, by analysis alone."""
    return [f.dataType for f in df.select(*[p.alias(f"x{k}") for k, p in enumerate(parts)]).schema.fields]


def unified(df: DataFrame, parts: list[Column], nulls: list[bool]) -> list[Column]:
    """Columns of one type: their own where it is one, else Variant."""
    kinds = types_of(df, parts)
    own = {k.json() for k, null in zip(kinds, nulls, strict=True) if not null}
    if len(own) <= 1:
        kind = next((k for k, null in zip(kinds, nulls, strict=True) if not null), T.StringType())
        return [F.lit(None).cast(kind) if null else p for p, null in zip(parts, nulls, strict=True)]
    return [F.lit(None).cast("variant") if null else as_variant(p, k) for p, k, null in zip(parts, kinds, nulls, strict=True)]


class Builder:
    """Builds nodes over a DataFrame that holds the resolved variables."""

    def __init__(self, config: Config, df: DataFrame, variables: dict[str, str], inputs: dict[str, Any], shared: dict[str, str], unwrap: bool = False):
        self.config, self.df, self.variables, self.inputs, self.shared, self.unwrap = config, df, variables, inputs, shared, unwrap

    def mapping(self, name: str) -> Column:
        if name in self.shared:
            return F.col(self.shared[name])
        return self.node(self.config.mappings[name][1])

    def node(self, node: Any) -> Column:
        if isinstance(node, Literal):
            return literal(node.value)
        if isinstance(node, Ref):
            if node.kind == "variable":
                return F.col(self.variables[node.name])
            return literal(self.inputs[node.name]) if node.kind == "input" else self.mapping(node.name)
        if isinstance(node, Obj):
            if self.unwrap and [k for k, _ in node.fields] == ["REF", "MAP"]:
                return self.node(node.fields[1][1])
            return F.struct(*[self.node(v).alias(k) for k, v in node.fields])
        assert isinstance(node, Arr)
        if not node.items:
            return F.array().cast("array<string>")
        parts = [self.node(v) for v in node.items]
        return F.array(*unified(self.df, parts, [isinstance(v, Literal) and v.value is None for v in node.items]))
