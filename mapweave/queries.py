"""One query for each operator of the mapping engine, over the star-schema tables, with the SQL that states it."""

from __future__ import annotations

import json
import os
import tempfile
from io import BytesIO
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.errors import ConfigValidationError, MappingError
from mapweave.plans.mapping import Mapping, recorders
from mapweave.schema.generator import generate_json_schema, spark_schema
from mapweave.sources.io import one_payload, write_document

QUERIES: dict[str, Any] = {}
ORACLE_SQL: dict[str, str] = {}

KEYS = {"orders": "o_orderkey", "nation": "n_nationkey", "customer": "c_custkey", "part": "p_partkey", "events": "event_id", "lineitem": "l_orderkey", "documents": "doc_id", "supplier": "s_suppkey", "embeddings": "vec_id"}


def document(root: Any, variables=None, functions=None, inputs=None, schemas=None, validation=None, engine=None, **mappings) -> dict:
    return {
        "META": {"dslVersion": "v2", "name": "query", "targetAspect": "urn:mapweave:query"},
        "ENGINE": {"api": "v2", "output": "$MAPPINGS.root"} | (engine or {}),
        "INPUT": inputs or {},
        "SCHEMA": schemas or {},
        "FUNCTIONS": functions or {},
        "VARIABLES": variables or {},
        "MAPPINGS": {"root": {"REF": "root", "MAP": root}} | {k: {"REF": k, "MAP": v} for k, v in mappings.items()},
        "VALIDATION": validation or {},
    }


def builtin(fn: str, *args) -> dict:
    return {"type": "builtin", "fn": fn} | ({"args": list(args)} if args else {})


def derived(kind: str, function: str, *args) -> dict:
    return {"type": kind, "derive": {"function": f"$FUNCTIONS.{function}", "args": list(args)}}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def register(name: str, sql: str | None, table: str, config: dict, source=None, inputs=None, flatten: bool = True, keep=None, finish=None, **options) -> None:
    """A query that applies a configuration to a whole table and spreads the document into columns."""
    keep = keep if keep is not None else [KEYS[table]]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = read(spark, sf_dir, table)
        df = source(df) if source else df
        if flatten:
            out = Mapping.from_dict(config).apply(df, inputs=inputs, keep=keep, **options)
            rest = [c for c in out.columns if c not in (*keep, "output")]
            out = out.select(*keep, "output.*", *rest)
        else:
            out = Mapping.from_dict(config).to_json_df(df, inputs=inputs, keep=keep, **options)
        return finish(out) if finish else out

    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


# ---- documents

_ORDER = {"o_orderkey": {"type": "integer", "required": True}, "o_orderstatus": {"type": "string", "required": True}}
register("map_literal", "SELECT n_nationkey, 'fixed' AS text, CAST(7 AS BIGINT) AS n, true AS flag FROM nation", "nation", document({"text": "fixed", "n": 7, "flag": True}))
register("map_variable_ref", "SELECT o_orderkey, o_orderkey AS \"key\", o_orderstatus AS status FROM orders", "orders", document({"key": "$VARIABLES.o_orderkey", "status": "$VARIABLES.o_orderstatus"}, _ORDER))
register(
    "map_input_ref",
    "SELECT n_nationkey, 'T-1' AS tenant, 'EU' AS region, CAST(3 AS BIGINT) AS n FROM nation",
    "nation",
    document({"tenant": "$INPUT.tenant", "region": "$INPUT.region", "n": "$INPUT.n"}, inputs={"tenant": {"type": "string", "required": True}, "region": {"type": "string", "default": "EU"}, "n": {"type": "integer"}}),
    inputs={"tenant": "T-1", "n": "3"},
)
register(
    "map_mapping_ref",
    "SELECT o_orderkey, {'status': o_orderstatus}.status AS a, o_orderstatus AS b FROM orders",
    "orders",
    document({"x": "$MAPPINGS.part", "y": "$MAPPINGS.part"}, _ORDER, part={"status": "$VARIABLES.o_orderstatus"}),
    finish=lambda df: df.select("o_orderkey", F.col("x.status").alias("a"), F.col("y.status").alias("b")),
)
register(
    "map_object_json",
    "SELECT o_orderkey, to_json({'key': o_orderkey, 'inner': {'status': o_orderstatus, 'none': NULL}, 'source': 'orders'})::VARCHAR AS output FROM orders",
    "orders",
    document({"key": "$VARIABLES.o_orderkey", "inner": {"status": "$VARIABLES.o_orderstatus", "none": None}, "source": "orders"}, _ORDER),
    flatten=False,
)
register(
    "map_array",
    "SELECT o_orderkey, '[' || to_json(o_orderstatus)::VARCHAR || ',\"x\"]' AS same, '[' || o_orderkey || ',' || to_json(o_orderstatus)::VARCHAR || ',true,null]' AS mixed FROM orders",
    "orders",
    document({"same": ["$VARIABLES.o_orderstatus", "x"], "mixed": ["$VARIABLES.o_orderkey", "$VARIABLES.o_orderstatus", True, None]}, _ORDER),
    finish=lambda df: df.select("o_orderkey", F.to_json("same", {"ignoreNullFields": "false"}).alias("same"), F.to_json("mixed").alias("mixed")),
)
register(
    "map_nested_ref_map",
    "SELECT o_orderkey, 'Nested' AS ref, o_orderstatus AS status FROM orders",
    "orders",
    document({"nested": {"REF": "Nested", "MAP": {"status": "$VARIABLES.o_orderstatus"}}}, _ORDER),
    finish=lambda df: df.select("o_orderkey", F.col("nested.REF").alias("ref"), F.col("nested.MAP.status").alias("status")),
)
register("map_unwrap_ref_map", "SELECT o_orderkey, o_orderstatus AS status FROM orders", "orders", document({"REF": "r", "MAP": {"status": "$VARIABLES.o_orderstatus"}}, _ORDER), unwrap_ref_map=True)
register("map_scalar_root", "SELECT o_orderkey, to_json(o_orderstatus)::VARCHAR AS output FROM orders", "orders", document("$VARIABLES.o_orderstatus", _ORDER), flatten=False)
register("map_select_by_name", "SELECT o_orderkey, 'other' AS which FROM orders", "orders", document({"which": "root"}, other={"which": "other"}), mapping="other")
register("map_unknown_prefix_literal", "SELECT n_nationkey, '$FUNCTIONS.x' AS a, '$PAYLOAD.y' AS b FROM nation", "nation", document({"a": "$FUNCTIONS.x", "b": "$PAYLOAD.y"}))

# ---- variables

_SOME = lambda df: df.withColumn("v", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")))
_SQL_SOME = "(SELECT *, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS v FROM orders)"
_UP = {"up": builtin("uppercase")}
register("var_default", f"SELECT o_orderkey, coalesce(v, 'none') AS v FROM {_SQL_SOME}", "orders", document({"v": "$VARIABLES.v"}, {"v": {"type": "string", "default": "none"}}), _SOME)
register("var_default_over_derive", f"SELECT o_orderkey, coalesce(v, 'default') AS v FROM {_SQL_SOME}", "orders", document({"v": "$VARIABLES.v"}, {"v": derived("string", "up", "derived") | {"default": "default"}}, _UP), _SOME)
register("var_derive", f"SELECT o_orderkey, coalesce(v, 'BOX') AS v FROM {_SQL_SOME}", "orders", document({"v": "$VARIABLES.v"}, {"v": derived("string", "up", "box")}, _UP), _SOME)
register("var_optional_null", f"SELECT o_orderkey, v, CAST(NULL AS VARCHAR) AS absent FROM {_SQL_SOME}", "orders", document({"v": "$VARIABLES.v", "absent": "$VARIABLES.absent"}, {"v": {"type": "string"}, "absent": {"type": "string"}}), _SOME)
_codes = lambda df: df.withColumn("code", F.get(F.col("_diagnostics.code"), 0)).drop("_diagnostics")
register(
    "var_required_quarantine",
    f"SELECT o_orderkey, v, CASE WHEN v IS NULL THEN 'VARIABLE_REQUIRED' END AS code FROM {_SQL_SOME}",
    "orders",
    document({"v": "$VARIABLES.v"}, {"v": {"type": "string", "required": True}}),
    _SOME,
    on_error="quarantine",
    finish=_codes,
)
register("fn_arg_merge", "SELECT n_nationkey, 'BA' AS v FROM nation", "nation", document({"v": "$VARIABLES.x"}, {"x": derived("string", "c", "B")}, {"c": builtin("concat", "A")}))
register("derive_args_stay_text", "SELECT n_nationkey, '$VARIABLES.N_NAME' AS v FROM nation", "nation", document({"v": "$VARIABLES.x"}, {"x": derived("string", "up", "$VARIABLES.n_name"), "n_name": {"type": "string"}}, _UP))
register("lazy_unreferenced_required", "SELECT n_nationkey, n_name AS v FROM nation", "nation", document({"v": "$VARIABLES.n_name"}, {"n_name": {"type": "string"}, "missing": {"type": "string", "required": True}}))
register("memoized_uuid", "SELECT n_nationkey, true AS same FROM nation", "nation", document({"a": "$VARIABLES.u", "b": "$VARIABLES.u"}, {"u": derived("string", "u")}, {"u": builtin("uuid")}), finish=lambda df: df.select("n_nationkey", (F.col("a") == F.col("b")).alias("same")))
register(
    "variables_snapshot",
    "SELECT o_orderkey, to_json({'o_orderkey': o_orderkey, 'o_orderstatus': o_orderstatus, 'extra': 'x'})::VARCHAR AS variables_json FROM orders",
    "orders",
    document({"k": "$VARIABLES.o_orderkey"}, _ORDER | {"extra": {"type": "string", "default": "x"}}),
    with_variables=True,
    finish=lambda df: df.select("o_orderkey", "variables_json"),
)

# ---- coercion: over texts and numbers made from the tables

_TEXTS = lambda df: df.withColumn("t", F.when(F.col("event_id") % 5 == 0, F.lit("2.5")).when(F.col("event_id") % 5 == 1, F.lit("yes")).when(F.col("event_id") % 5 == 2, F.lit("True")).when(F.col("event_id") % 5 == 3, F.col("user_id").cast("string")).otherwise(F.lit(" 7")))
_SQL_TEXTS = "(SELECT *, CASE event_id % 5 WHEN 0 THEN '2.5' WHEN 1 THEN 'yes' WHEN 2 THEN 'True' WHEN 3 THEN CAST(user_id AS VARCHAR) ELSE ' 7' END AS t FROM events)"
_TYPE = "CASE WHEN {0} IS NULL THEN 'VARIABLE_TYPE' END AS code"
for _kind, _cast in (
    ("number", r"CASE WHEN regexp_full_match(t, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN CAST(t AS DOUBLE) END"),
    ("integer", "CASE WHEN regexp_full_match(t, '[+-]?[0-9]+') THEN CAST(CAST(t AS BIGINT) AS VARCHAR) END"),
    ("boolean", "CASE WHEN lower(t) IN ('true', 'false') THEN lower(t) END"),
):
    register(
        f"coerce_{_kind}",
        f"SELECT event_id, {_cast} AS v, {_TYPE.format(_cast)} FROM {_SQL_TEXTS}",
        "events",
        document({"v": "$VARIABLES.t"}, {"t": {"type": _kind}}),
        _TEXTS,
        on_error="quarantine",
        finish=lambda df, t="double" if _kind == "number" else "string": _codes(df).withColumn("v", F.col("v").cast(t)),
    )
register("coerce_string", "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS v, o_orderstatus AS s FROM orders", "orders", document({"v": "$VARIABLES.o_orderkey", "s": "$VARIABLES.o_orderstatus"}, {"o_orderkey": {"type": "string"}, "o_orderstatus": {"type": "string"}}))
register("coerce_integer_from_double", "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, CASE WHEN l_discount <> round(l_discount) THEN 'VARIABLE_TYPE' END AS code FROM lineitem", "lineitem", document({"q": "$VARIABLES.l_quantity", "d": "$VARIABLES.l_discount"}, {"l_quantity": {"type": "integer"}, "l_discount": {"type": "integer"}}), on_error="quarantine", keep=["l_orderkey", "l_linenumber", "l_quantity"], finish=lambda df: _codes(df).select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("q"), "code"))
register("coerce_object", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events", "events", document({"p": "$VARIABLES.p"}, {"p": {"type": "object", "required": True}}), lambda df: df.withColumn("p", F.from_json("props", "struct<k:bigint>")), finish=lambda df: df.select("event_id", F.col("p.k").alias("k")))
register("coerce_array", "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n FROM embeddings", "embeddings", document({"e": "$VARIABLES.embedding"}, {"embedding": {"type": "array", "required": True}}), finish=lambda df: df.select("vec_id", F.size("e").cast("long").alias("n")))

# values with more places than a double or a short decimal holds
_LONG = ["0.12345678912345", "2.00000000001", "123456789012345678901234567890", "0.123456789012345678901234567890", "-7.000", "1e-20"]
_PLAIN = ["0.12345678912345", "2.00000000001", "123456789012345678901234567890", "0.12345678901234567890123456789", "-7", "0.00000000000000000001"]
_PICK = lambda df: df.withColumn("t", F.element_at(F.array(*map(F.lit, _LONG)), F.pmod("event_id", F.lit(len(_LONG))).cast("int") + 1))
_SQL_PICK = f"CASE event_id % {len(_LONG)} " + " ".join(f"WHEN {k} THEN {{{k}}}" for k in range(len(_LONG))) + " END"
_quoted = lambda values: _SQL_PICK.format(*[f"'{v}'" if v is not None else "NULL" for v in values])
register("coerce_number_long", f"SELECT event_id, {_quoted(_PLAIN)} AS v FROM events", "events", document("$VARIABLES.t", {"t": {"type": "number"}}), _PICK, flatten=False, finish=lambda df: df.withColumnRenamed("output", "v"))
register(
    "coerce_integer_long_fraction",
    f"SELECT event_id, CAST({_quoted([None, None, None, None, '-7', None])} AS VARCHAR) AS v, {_quoted(['VARIABLE_TYPE'] * 4 + [None, 'VARIABLE_TYPE'])} AS code FROM events",
    "events",
    document({"v": "$VARIABLES.t"}, {"t": {"type": "integer"}}),
    _PICK,
    on_error="quarantine",
    finish=lambda df: _codes(df).withColumn("v", F.col("v").cast("string")),
)
register(
    "coerce_integer_json_fraction",
    f"SELECT event_id, CAST({_quoted([None, None, None, None, '-7', None])} AS VARCHAR) AS v, {_quoted(['VARIABLE_TYPE'] * 4 + [None, 'VARIABLE_TYPE'])} AS code FROM events",
    "events",
    document({"v": "$VARIABLES.t"}, {"t": {"type": "integer"}}),
    lambda df: _PICK(df).withColumn("p", F.concat(F.lit('{"t": '), F.col("t"), F.lit("}"))),
    payload="p",
    on_error="quarantine",
    finish=lambda df: _codes(df).withColumn("v", F.col("v").cast("string")),
)

# ---- predicates

_REGEX = {"caps": {"type": "regex", "pattern": "[A-Z0-9-]+"}, "high": {"type": "regex", "pattern": "[1-3]-.*"}, "noop": builtin("uppercase")}
_CONSTRAINT = "CASE WHEN NOT regexp_full_match(o_orderpriority, '{0}') THEN 'VARIABLE_CONSTRAINT' END AS code"


def _constrained(*names):
    return document({"p": "$VARIABLES.o_orderpriority"}, {"o_orderpriority": {"type": "string", "constraints": [f"$FUNCTIONS.{n}" for n in names]}}, _REGEX)


register("constraint_regex_fullmatch", f"SELECT o_orderkey, CASE WHEN regexp_full_match(o_orderpriority, '[1-3]-.*') THEN o_orderpriority END AS p, {_CONSTRAINT.format('[1-3]-.*')} FROM orders", "orders", _constrained("high"), on_error="quarantine", finish=_codes)
register("constraint_builtin_noop", "SELECT o_orderkey, o_orderpriority AS p FROM orders", "orders", _constrained("noop"))
register("constraint_multi", "SELECT o_orderkey, CASE WHEN regexp_full_match(o_orderpriority, '[A-Z0-9-]+') AND regexp_full_match(o_orderpriority, '[1-3]-.*') THEN o_orderpriority END AS p, CASE WHEN NOT regexp_full_match(o_orderpriority, '[A-Z0-9-]+') THEN 'caps' WHEN NOT regexp_full_match(o_orderpriority, '[1-3]-.*') THEN 'high' END AS failed FROM orders", "orders", _constrained("caps", "high"), on_error="quarantine", finish=lambda df: df.select("o_orderkey", "p", F.get("_diagnostics", 0)["details"]["function"].alias("failed")))

# ---- builtins on constants

_CONSTANTS = {
    "uppercase": (["straße"], "string", "'STRASSE'"),
    "lowercase": (["ÅNGSTRÖM"], "string", "'ångström'"),
    "trim": (["\t a b \n"], "string", "'a b'"),
    "concat": (["id-", None, 70, False], "string", "'id-70false'"),
    "pad_left": (["907", 6, "."], "string", "'...907'"),
    "pad_right": (["907", 6, "xy"], "string", "'907xxx'"),
    "lookup": (["se", {"no": "Norway", "se": "Sweden"}, "?"], "string", "'Sweden'"),
    "add": ([55, "11.5", 0.5], "integer", "CAST(67 AS BIGINT)"),
    "subtract": ([30, 4.5, 0.5], "integer", "CAST(25 AS BIGINT)"),
    "multiply": ([12, "0.25"], "integer", "CAST(3 AS BIGINT)"),
    "divide": ([91, 2, 7], "number", "6.5"),
    "min": ([8, "-4", 0], "integer", "CAST(-4 AS BIGINT)"),
    "max": ([8, "19", 0], "integer", "CAST(19 AS BIGINT)"),
    "abs": ([-31], "integer", "CAST(31 AS BIGINT)"),
}
for _fn, (_args, _kind, _sql) in _CONSTANTS.items():
    register(f"fn_{_fn}", f"SELECT n_nationkey, {_sql} AS v FROM nation", "nation", document({"v": "$VARIABLES.x"}, {"x": derived(_kind, "f", *_args)}, {"f": builtin(_fn)}))

# ---- builtins on columns (extension: references in derive arguments are bound)

_V = "$VARIABLES."
_COLUMNS = {
    "uppercase": ("part", ["p_name"], [_V + "p_name"], "string", "upper(p_name)"),
    "lowercase": ("part", ["p_type"], [_V + "p_type"], "string", "lower(p_type)"),
    "trim": ("part", ["p_name"], [_V + "p_name"], "string", r"regexp_replace(p_name, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"),
    "concat": ("part", ["p_brand", "p_size"], [_V + "p_brand", "-", None, _V + "p_size"], "string", "p_brand || '-' || CAST(p_size AS VARCHAR)"),
    "pad_left": ("part", ["p_size"], [_V + "p_size", 4, "0"], "string", "CASE WHEN length(CAST(p_size AS VARCHAR)) >= 4 THEN CAST(p_size AS VARCHAR) ELSE lpad(CAST(p_size AS VARCHAR), 4, '0') END"),
    "pad_right": ("part", ["p_brand"], [_V + "p_brand", 3, "*"], "string", "CASE WHEN length(p_brand) >= 3 THEN p_brand ELSE rpad(p_brand, 3, '*') END"),
    "lookup": ("orders", ["o_orderstatus"], [_V + "o_orderstatus", {"F": "final", "O": "open"}, "other"], "string", "CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE 'other' END"),
    "add": ("lineitem", ["l_quantity", "l_linenumber"], [_V + "l_quantity", _V + "l_linenumber", 1], "number", "l_quantity + l_linenumber + 1"),
    "subtract": ("lineitem", ["l_quantity", "l_linenumber"], [_V + "l_quantity", _V + "l_linenumber"], "number", "l_quantity - l_linenumber"),
    "multiply": ("lineitem", ["l_quantity", "l_linenumber"], [_V + "l_quantity", _V + "l_linenumber"], "number", "l_quantity * l_linenumber"),
    "divide": ("lineitem", ["l_quantity"], [_V + "l_quantity", 4], "number", "l_quantity / 4"),
    "min": ("lineitem", ["l_quantity", "l_linenumber"], [_V + "l_quantity", _V + "l_linenumber", 3], "number", "least(l_quantity, l_linenumber, 3)"),
    "max": ("lineitem", ["l_quantity", "l_linenumber"], [_V + "l_quantity", _V + "l_linenumber"], "number", "greatest(l_quantity, l_linenumber)"),
    "abs": ("customer", ["c_acctbal"], [_V + "c_acctbal"], "number", "abs(c_acctbal)"),
}
_TYPES_OF = {"p_size": "integer", "l_linenumber": "integer", "l_quantity": "number", "c_acctbal": "number"}
for _fn, (_table, _used, _args, _kind, _sql) in _COLUMNS.items():
    _keys = [KEYS[_table]] + (["l_linenumber"] if _table == "lineitem" else [])
    _variables = {c: {"type": _TYPES_OF.get(c, "string")} for c in _used} | {"x": derived(_kind, "f", *_args)}
    register(f"fn_{_fn}_col", f"SELECT {', '.join(_keys)}, {f'CAST({_sql} AS DOUBLE)' if _kind == 'number' else _sql} AS v FROM {_table}", _table, document({"v": "$VARIABLES.x"}, _variables, {"f": builtin(_fn)}), keep=_keys, resolve_derive_args=True)

_EIGHTHS = {"n": {"type": "number"}, "x": derived("number", "f", _V + "n", 8192)}
register("fn_divide_exact_col", "SELECT l_orderkey, l_linenumber, l_linenumber / 8192 AS v FROM lineitem", "lineitem", document({"v": "$VARIABLES.x"}, _EIGHTHS, {"f": builtin("divide")}), lambda df: df.withColumn("n", F.col("l_linenumber").cast("double")), keep=["l_orderkey", "l_linenumber"], resolve_derive_args=True)
register(
    "fn_divide_endless_col",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 7 = 0 THEN l_linenumber / 7 END AS v, CASE WHEN l_linenumber % 7 <> 0 THEN 'VARIABLE_DERIVE' END AS code FROM lineitem",
    "lineitem",
    document({"v": "$VARIABLES.x"}, {"l_linenumber": {"type": "integer"}, "x": derived("number", "f", _V + "l_linenumber", 7)}, {"f": builtin("divide")}),
    keep=["l_orderkey", "l_linenumber"],
    resolve_derive_args=True,
    on_error="quarantine",
    finish=lambda df: _codes(df.select("l_orderkey", F.col("l_linenumber"), "v", "_diagnostics")),
)
register(
    "fn_add_text_col",
    "SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS DECIMAL(38, 20)) + 0.00000000000001 = CAST(l_linenumber || '.00000000000001' AS DECIMAL(38, 20)) AS same FROM lineitem",
    "lineitem",
    document({"v": "$VARIABLES.x", "w": "$VARIABLES.w"}, {"n": {"type": "string"}, "w": {"type": "number"}, "x": derived("number", "f", _V + "n", "0.00000000000001")}, {"f": builtin("add")}),
    lambda df: df.withColumn("n", F.col("l_linenumber").cast("string")).withColumn("w", F.concat("n", F.lit(".00000000000001"))),
    keep=["l_orderkey", "l_linenumber"],
    resolve_derive_args=True,
    finish=lambda df: df.select("l_orderkey", "l_linenumber", (F.col("v") == F.col("w").cast("double")).alias("same")),
)
for _fn, _side in (("pad_left", "lpad"), ("pad_right", "rpad")):
    register(
        f"fn_{_fn}_len_col",
        f"SELECT p_partkey, CASE WHEN length(p_brand) >= p_size THEN p_brand ELSE {_side}(p_brand, p_size, '.') END AS v FROM part",
        "part",
        document({"v": "$VARIABLES.x"}, {"p_brand": {"type": "string"}, "p_size": {"type": "integer"}, "x": derived("string", "f", _V + "p_brand", _V + "p_size", ".")}, {"f": builtin(_fn)}),
        resolve_derive_args=True,
    )

# ---- clocks and random values: what must hold of them

_RANDOM = {
    "date": ([], r"v rlike r'^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$'"),
    "date_utc": ([], r"v rlike r'^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}Z$'"),
    "date_now_millis": ([], "abs(cast(v as bigint) - unix_millis(current_timestamp())) < 60000"),
    "pos_int": ([6, "N-"], "v rlike '^N-[0-9]{6}$'"),
    "pos_int_between": ([5, 9], "cast(v as bigint) between 5 and 9"),
    "uuid": ([], "v rlike '^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$'"),
    "uuid_compact": ([], "v rlike '^[0-9a-f]{32}$'"),
    "uuid_urn": ([], "v rlike '^urn:uuid:[0-9a-f-]{36}$'"),
}
for _fn, (_args, _holds) in _RANDOM.items():
    register(f"fn_{_fn}", "SELECT n_nationkey, true AS holds FROM nation", "nation", document({"v": "$VARIABLES.x"}, {"x": derived("string", "f", *_args)}, {"f": builtin(_fn)}), finish=lambda df, holds=_holds: df.select("n_nationkey", F.expr(holds).alias("holds")))

# ---- output validation, by schema/examples/segment.json

_CUSTOMER = document({"segment": "$VARIABLES.c_mktsegment", "balance": "$VARIABLES.c_acctbal"}, {"c_mktsegment": {"type": "string"}, "c_acctbal": {"type": "number"}})


def _validated(name: str, sql: str, rule: dict, engine: dict, validate: bool = True) -> None:
    config = _CUSTOMER | {"SCHEMA": {"s": {"ref": "classpath:segment.json"}}, "VALIDATION": rule, "ENGINE": _CUSTOMER["ENGINE"] | engine}

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        mapping = Mapping.from_dict(config, schema_roots=[_SCHEMAS])
        out = mapping.apply(read(spark, sf_dir, "customer"), keep=["c_custkey"], on_error="quarantine", validate=validate)
        return _codes(out.select("c_custkey", F.col("output.segment").alias("segment"), "_diagnostics"))

    QUERIES[name], ORACLE_SQL[name] = run, sql


def _schema_folder() -> str:
    return os.path.join(os.path.dirname(os.path.abspath(__file__)), "schema", "examples")


_SCHEMAS = _schema_folder()
_BAD = "c_mktsegment NOT SIMILAR TO '[AB].*' OR c_acctbal < 0"
_BAD_SQL = f"SELECT c_custkey, CASE WHEN NOT ({_BAD}) THEN c_mktsegment END AS segment, CASE WHEN {_BAD} THEN 'RESULT_SCHEMA_VALIDATION' END AS code FROM customer"
_ALL_SQL = "SELECT c_custkey, c_mktsegment AS segment, CAST(NULL AS VARCHAR) AS code FROM customer"
_validated("result_validation_quarantine", _BAD_SQL, {"r": {"schema": "s", "phase": "post-map"}}, {})
_validated("result_validation_engine", _BAD_SQL, {}, {"validation": "s"})
_validated("validation_disabled", _ALL_SQL, {"r": {"schema": "s", "phase": "post-map"}}, {}, validate=False)
_validated("premap_ignored", _ALL_SQL, {"r": {"schema": "s", "phase": "pre-map"}}, {})



def _checked(name: str, sql: str, schema: dict, config: dict, table: str, **options) -> None:
    """A query whose outputs are checked by a schema that is read from a file; the code of the first error is kept."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with tempfile.TemporaryDirectory() as folder:  # read on the driver while the plan is made
            with open(os.path.join(folder, "s.json"), "w", encoding="utf-8") as f:
                json.dump(schema, f)
            full = config | {"SCHEMA": {"s": {"ref": "classpath:s.json"}}, "VALIDATION": {"r": {"schema": "s", "phase": "post-map"}}}
            out = Mapping.from_dict(full, schema_roots=[folder]).apply(read(spark, sf_dir, table), keep=[KEYS[table]], on_error="quarantine", **options)
        return out.select(KEYS[table], F.get(F.col("_diagnostics.code"), 0).alias("code"))

    QUERIES[name], ORACLE_SQL[name] = run, sql


_WRONG = "CASE WHEN {0} THEN 'RESULT_SCHEMA_VALIDATION' END AS code"
_BALANCE = document({"b": "$VARIABLES.c_acctbal", "s": "$VARIABLES.c_mktsegment"}, {"c_acctbal": {"type": "number"}, "c_mktsegment": {"type": "string"}})
_ODD = "(c_mktsegment LIKE 'A%' AND c_acctbal < 0) OR (c_mktsegment NOT LIKE 'A%' AND c_acctbal > 9000) OR CAST(round(c_acctbal * 100) AS BIGINT) % 2 <> 0"
_checked("schema_draft04", f"SELECT c_custkey, {_WRONG.format('c_acctbal <= 1000 OR c_acctbal > 8000')} FROM customer", {"$schema": "http://json-schema.org/draft-04/schema#", "properties": {"b": {"minimum": 1000, "exclusiveMinimum": True, "maximum": 8000, "exclusiveMaximum": False}, "s": {"const": "left out by this dialect"}}}, _BALANCE, "customer")
_checked(
    "schema_keywords",
    f"SELECT c_custkey, {_WRONG.format(_ODD)} FROM customer",
    {"minProperties": 2, "propertyNames": {"maxLength": 1}, "patternProperties": {"^b$": {"multipleOf": 0.02}}, "if": {"properties": {"s": {"pattern": "^A"}}}, "then": {"properties": {"b": {"minimum": 0}}}, "else": {"properties": {"b": {"maximum": 9000}}}},
    _BALANCE,
    "customer",
)
_checked(
    "schema_json_mode",
    f"SELECT event_id, {_WRONG.format('CAST(json_extract(props, $$$.k$$) AS BIGINT) >= 50')} FROM events",
    {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "exclusiveMaximum": 50}, "name": {"type": ["string", "null"], "pattern": r"^\p{L}+$"}}, "additionalProperties": False},
    document({"k": "$VARIABLES.k", "name": "$VARIABLES.name"}, {"k": {"type": "number"}, "name": {"type": "string"}}),
    "events",
    payload="props",
)

# ---- JSON payloads

register(
    "json_mode_events",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 'none' AS other FROM events",
    "events",
    document({"k": "$VARIABLES.k", "other": "$VARIABLES.other"}, {"k": {"type": "integer", "required": True}, "other": {"type": "string", "default": "none"}}),
    payload="props",
)
register(
    "json_mode_malformed",
    "SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN CAST(json_extract(props, '$.k') AS VARCHAR) END AS k, CASE WHEN event_id % 4 = 0 THEN 'PAYLOAD_FORMAT' END AS code FROM events",
    "events",
    document({"k": "$VARIABLES.k"}, {"k": {"type": "integer"}}),
    lambda df: df.withColumn("p", F.when(F.col("event_id") % 4 == 0, F.lit("{broken")).otherwise(F.col("props"))),
    payload="p",
    on_error="quarantine",
    finish=lambda df: _codes(df).withColumn("k", F.col("k").cast("string")),
)

# ---- surfaces and execution

_NATION = document({"name": "$VARIABLES.n_name", "unit": "$INPUT.unit"}, {"n_name": {"type": "string", "required": True}}, inputs={"unit": {"type": "string", "default": "K"}, "spare": {"type": "string", "required": True}})
_SQL_NATION = "SELECT n_nationkey, n_name AS name, 'K' AS unit FROM nation"


def _surface(name: str, sql: str, run) -> None:
    QUERIES[name], ORACLE_SQL[name] = (lambda spark, sf_dir: run(spark, read(spark, sf_dir, "nation"))), sql


def _spread(m: Mapping, df: DataFrame, **options) -> DataFrame:
    return m.apply(df, keep=["n_nationkey"], **options).select("n_nationkey", "output.*")


def _from_path(spark: SparkSession, df: DataFrame) -> DataFrame:
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "config.json")
        write_document(json.dumps(_NATION), path)
        return _spread(Mapping.from_path(path), df)


_surface("config_from_path", _SQL_NATION, _from_path)
_surface("config_from_stream", _SQL_NATION, lambda spark, df: _spread(Mapping.from_stream(BytesIO(json.dumps(_NATION).encode())), df))
_surface("config_from_bytes", _SQL_NATION, lambda spark, df: _spread(Mapping.from_bytes(json.dumps(_NATION).encode()), df))
_surface("config_unchecked", _SQL_NATION, lambda spark, df: _spread(Mapping.from_dict({k: v for k, v in _NATION.items() if k != "META"} | {"ENGINE": _NATION["ENGINE"] | {"more": 1}}, check=False), df))
_surface("input_lazy", _SQL_NATION, lambda spark, df: _spread(Mapping.from_dict(_NATION), df, inputs={"unused": 1}))
_surface("reset_per_execution", "SELECT n_nationkey, n_name AS name, u.unit FROM nation CROSS JOIN (VALUES ('K'), ('C')) u(unit)", lambda spark, df: (lambda m: _spread(m, df).unionByName(_spread(m, df, inputs={"unit": "C"})))(Mapping.from_dict(_NATION)))
_surface("output_variant", "SELECT n_nationkey, to_json({'name': n_name, 'unit': 'K'})::VARCHAR AS output FROM nation", lambda spark, df: Mapping.from_dict(_NATION).variant(df, keep=["n_nationkey"]).withColumn("output", F.to_json("output")))
_surface("pretty_print", "SELECT n_nationkey, '{' || chr(10) || '  \"name\" : \"' || n_name || '\",' || chr(10) || '  \"unit\" : \"K\"' || chr(10) || '}' AS output FROM nation", lambda spark, df: Mapping.from_dict(_NATION).to_json_df(df, keep=["n_nationkey"], pretty=True))
_surface("payload_in_memory", "SELECT 'Norway' AS name, 'K' AS unit", lambda spark, df: Mapping.from_dict(_NATION).apply(one_payload(spark, {"n_name": "Norway", "more": [1]}), payload="payload", keep=[]).select("output.*"))
_surface("mapping_ref_metadata", "SELECT n_nationkey, 'root' AS ref FROM nation", lambda spark, df: (lambda out: out.select("n_nationkey", F.lit(out.schema["output"].metadata["ref"]).alias("ref")))(Mapping.from_dict(_NATION).apply(df, keep=["n_nationkey"])))
register(
    "regex_in_derive",
    "SELECT n_nationkey, CAST(NULL AS VARCHAR) AS v, 'VARIABLE_DERIVE' AS code FROM nation",
    "nation",
    document({"v": "$VARIABLES.x"}, {"x": derived("string", "caps")}, _REGEX),
    on_error="quarantine",
    finish=_codes,
)

# ---- configuration alone: the code or class of the error that each case raises, else "ok"

_GOOD = document({"x": "$VARIABLES.v"}, {"v": {"type": "string"}})


def _with(**changes) -> dict:
    return {k: changes.get(k, v) for k, v in _GOOD.items() if changes.get(k, v) is not None}


_TWICE = json.dumps(_GOOD)
_CASES: dict[str, list[tuple[str, Any, str]]] = {
    "config_sections": [("whole", _GOOD, "ok"), ("missing", _with(MAPPINGS=None), "ConfigValidationError"), ("unknown", _GOOD | {"EXTRA": {}}, "ConfigValidationError"), ("twice", _TWICE[:-1] + ', "META": {}}', "ConfigValidationError"), ("broken", _TWICE[:-1], "ConfigValidationError"), ("list", "[]", "ConfigValidationError")],
    "config_meta": [("no name", _with(META={"dslVersion": "v2", "targetAspect": "x"}), "ConfigValidationError"), ("number", _with(META={"dslVersion": 2, "name": "n", "targetAspect": "x"}), "ConfigValidationError"), ("all", _with(META={"dslVersion": "v2", "name": "n", "targetAspect": "x", "owner": "o", "description": "d", "lastUpdated": "l"}), "ok")],
    "config_engine": [("no output", _with(ENGINE={"api": "v2"}), "ConfigValidationError"), ("more", _with(ENGINE={"api": "v2", "output": "x", "more": "y"}), "ConfigValidationError"), ("validation", _with(ENGINE={"api": "v2", "output": "x", "validation": "s"}), "ok")],
    "config_input": [("no type", _with(INPUT={"i": {"required": True}}), "ConfigValidationError"), ("list", _with(INPUT=[]), "ConfigValidationError"), ("whole", _with(INPUT={"i": {"type": "STRING", "required": True, "nullable": False, "default": 1}}), "ok")],
    "config_schema": [("no ref", _with(SCHEMA={"s": {"dialect": "x"}}), "ConfigValidationError"), ("strict", _with(SCHEMA={"s": {"ref": "x", "strict": "yes"}}), "ConfigValidationError"), ("whole", _with(SCHEMA={"s": {"ref": "x", "strict": True}}), "ok")],
    "config_functions": [("no type", _with(FUNCTIONS={"f": {"pattern": "x"}}), "ConfigValidationError"), ("no pattern", _with(FUNCTIONS={"f": {"type": "regex"}}), "ConfigValidationError"), ("no fn", _with(FUNCTIONS={"f": {"type": "builtin"}}), "ConfigValidationError"), ("kind", _with(FUNCTIONS={"f": {"type": "other"}}), "ConfigValidationError"), ("unknown builtin", _with(FUNCTIONS={"f": builtin("nope")}), "CONFIG_ERROR")],
    "config_variables": [("no type", _with(VARIABLES={"v": {}}), "ConfigValidationError"), ("length", _with(VARIABLES={"v": {"type": "string", "maxLength": "3"}}), "ConfigValidationError"), ("source", _with(VARIABLES={"v": {"type": "string", "source": "x"}}), "ConfigValidationError"), ("unknown type", _with(VARIABLES={"v": {"type": "date"}}), "CONFIG_ERROR")],
    "config_derive": [("no function", _with(VARIABLES={"v": {"type": "string", "derive": {"args": []}}}), "ConfigValidationError"), ("text", _with(VARIABLES={"v": {"type": "string", "derive": "f"}}), "ConfigValidationError")],
    "config_mappings": [("no REF", _with(MAPPINGS={"m": {"MAP": {}}}), "ConfigValidationError"), ("no MAP", _with(MAPPINGS={"m": {"REF": "m"}}), "ConfigValidationError"), ("list", _with(MAPPINGS={"m": {"REF": "m", "MAP": [1]}}), "ok")],
    "config_validation": [("phase", _with(VALIDATION={"r": {"schema": "s", "phase": "later"}}), "ConfigValidationError"), ("no schema", _with(VALIDATION={"r": {"phase": "pre-map"}}), "ConfigValidationError")],
    "config_identifiers": [("blank", _with(FUNCTIONS={"bad name": builtin("uuid")}), "ConfigValidationError"), ("signs", _with(FUNCTIONS={"a_b.c-9": builtin("uuid")}), "ok"), ("empty", _with(INPUT={"": {"type": "string"}}), "ConfigValidationError")],
    "config_duplicates": [("input", _TWICE.replace('"INPUT": {', '"INPUT": {"a": {"type": "string"}, "a": {"type": "string"}'), "CONFIG_ERROR"), ("field", _TWICE.replace('{"x": "$VARIABLES.v"}', '{"x": 1, "x": 2}'), "CONFIG_ERROR")],
    "config_function_refs": [("unknown", document({}, {"v": derived("string", "nope")}), "REFERENCE_UNKNOWN_FUNCTION"), ("form", document({}, {"v": {"type": "string", "constraints": ["f"]}}), "REFERENCE_FORMAT")],
    "config_refs": [("variable", document({"x": "$VARIABLES.nope"}), "REFERENCE_UNKNOWN_VARIABLE"), ("input", document({"x": ["$INPUT.nope"]}), "REFERENCE_UNKNOWN_INPUT"), ("mapping", document("$MAPPINGS.nope"), "REFERENCE_UNKNOWN_MAPPING")],
    "config_schema_refs": [("unknown", document({}, validation={"r": {"schema": "nope", "phase": "pre-map"}}), "REFERENCE_UNKNOWN_SCHEMA"), ("known", document({}, schemas={"s": {"ref": "x"}}, validation={"r": {"schema": "$SCHEMA.s", "phase": "pre-map"}}), "ok")],
    "config_cycles": [("two", document({}, a="$MAPPINGS.b", b={"x": "$MAPPINGS.a"}), "REFERENCE_CYCLE"), ("self", document("$MAPPINGS.root"), "REFERENCE_CYCLE"), ("diamond", document(["$MAPPINGS.a", "$MAPPINGS.a"], a={"x": 1}), "ok")],
    "config_patterns": [("open", document({}, functions={"f": {"type": "regex", "pattern": "("}}), "CONFIG_ERROR"), ("letters", document({}, functions={"f": {"type": "regex", "pattern": r"\p{L}+"}}), "ok")],
}


def _outcome(case: Any) -> str:
    try:
        Mapping.from_bytes(case if isinstance(case, str) else json.dumps(case))
        return "ok"
    except MappingError as e:
        return e.code
    except ConfigValidationError:
        return "ConfigValidationError"


def _config_query(name: str, sql: str, rows) -> None:
    QUERIES[name] = lambda spark, sf_dir: spark.createDataFrame(rows(), "k string, v string")
    ORACLE_SQL[name] = sql


def _values(rows) -> str:
    text = lambda x: "'" + x.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join(f"({text(k)}, {text(v)})" for k, v in rows) + ") t(k, v)"


for _name, _cases in _CASES.items():
    _config_query(_name, _values([(k, want) for k, _, want in _cases]), lambda cases=_cases: [(k, _outcome(case)) for k, case, _ in cases])


def _unknown_mapping() -> str:
    try:
        Mapping.from_dict(_GOOD).output_name("nope")
        return "ok"
    except MappingError as e:
        return e.code


_config_query("mapping_unknown", _values([("nope", "MAPPING_UNKNOWN")]), lambda: [("nope", _unknown_mapping())])


def _recorded() -> list[tuple[str, str]]:
    found: list[dict] = []
    recorders.append(found.append)
    try:
        Mapping.from_dict(document("$MAPPINGS.part", part={"a": 1}))
    finally:
        recorders.remove(found.append)
    return [(r["mapping"], str(r["nodes"])) for r in found]


_config_query("metrics_recorder", _values([("root", "1"), ("part", "2")]), _recorded)
_CONTRACT = document({"a": "$VARIABLES.id"}, {"id": {"type": "string", "required": True, "constraints": ["$FUNCTIONS.caps"]}, "n": {"type": "integer"}, "tags": {"type": "array", "items": {"type": "string"}, "minItems": 1}}, _REGEX, inputs={"tenant": {"type": "string"}, "batch": {"type": "string"}})
_config_query("input_fields", _values([("tenant", "0"), ("batch", "1")]), lambda: [(k, str(n)) for n, k in enumerate(Mapping.from_dict(_CONTRACT).input_fields)])
_config_query(
    "schema_generator",
    _values([("id", '{"type": "string", "pattern": "[A-Z0-9-]+"}'), ("n", '{"type": "integer"}'), ("tags", '{"type": "array", "minItems": 1, "items": {"type": "string"}}')]),
    lambda: [(k, json.dumps(v)) for k, v in generate_json_schema(json.dumps(_CONTRACT))["properties"].items()],
)
_FACETS = document(
    {},
    {
        "plain": {"type": "string", "minLength": 2, "maxLength": 5, "description": "d"},
        "choice": {"type": "string", "enum": ["a", "b"], "nullable": True, "default": "a"},
        "made": derived("string", "caps"),
        "box": {"type": "object", "fields": {"n": {"type": "number", "required": True}, "kind": {"type": "enum", "values": ["x"]}}, "requiredFields": ["kind"]},
        "list": {"type": "array", "maxItems": 3, "required": True},
    },
    _REGEX,
)
_config_query(
    "schema_generator_facets",
    _values(
        [
            ("plain", '{"type": "string", "minLength": 2, "maxLength": 5, "description": "d"}'),
            ("choice", '{"type": ["string", "null"], "enum": ["a", "b", null], "default": "a"}'),
            ("made", '{"type": "string", "readOnly": true}'),
            ("box", '{"type": "object", "properties": {"n": {"type": "number"}, "kind": {"type": "string", "enum": ["x"]}}, "required": ["kind", "n"], "additionalProperties": false}'),
            ("list", '{"type": "array", "maxItems": 3}'),
            ("required", '["list"]'),
        ]
    ),
    lambda: (lambda got: [(k, json.dumps(v)) for k, v in got["properties"].items()] + [("required", json.dumps(got["required"]))])(generate_json_schema(json.dumps(_FACETS))),
)
_config_query("spark_schema", _values([("id", "string"), ("n", "bigint"), ("tags", "array<string>")]), lambda: [(f.name, f.dataType.simpleString()) for f in spark_schema(json.dumps(_CONTRACT)).fields])
_config_query("metrics", _values([("object", "1"), ("variable_ref", "1")]), lambda: [(k, str(n)) for k, n in Mapping.from_dict(_CONTRACT).mapping_metrics("root")["kinds"].items()])
_config_query("introspection", _values([("variable", "id"), ("input", ""), ("mapping", "root")]), lambda: [(k, ",".join(v)) for k, v in Mapping.from_dict(_CONTRACT).reached("root").items()])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slice of the build plan: orders with a checked status, host input and literal."""
    functions = {"caps": {"type": "regex", "pattern": "^[A-Z]+$"}}
    variables = {"o_orderkey": {"type": "integer", "required": True}, "o_orderstatus": {"type": "string", "required": True, "constraints": ["$FUNCTIONS.caps"]}}
    root = {"key": "$VARIABLES.o_orderkey", "status": "$VARIABLES.o_orderstatus", "source": "orders", "tenant": "$INPUT.tenantId"}
    config = document(root, variables, functions, {"tenantId": {"type": "string", "required": True}})
    return Mapping.from_dict(config).apply(read(spark, sf_dir, "orders"), inputs={"tenantId": "T-1"}, keep=[]).select("output.*")


QUERIES["flagship"] = flagship
ORACLE_SQL["flagship"] = "SELECT o_orderkey AS \"key\", o_orderstatus AS status, 'orders' AS source, 'T-1' AS tenant FROM orders"
