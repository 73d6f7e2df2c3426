"""Chat formatting: layouts told apart by schema fingerprints, turned into one template and back.

Tables: `table_fingerprint` hashes the nested field paths of a schema, as far as
any declared layout knows them, so extra columns don't matter.  `TABLES`
declares for each fingerprint how rows become canonical turns (conv_id, turn,
role, text); `canonical_table` selects and applies it, and raises ValueError
for a layout it doesn't know.

JSON records, each in a layout of its own: `fingerprint` hashes the field paths
of each record, again as far as any declared layout knows them (types, order
and further fields left out), `LAYOUTS` declares the mappings and
`canonical_turns` selects one for each record.  A record with an empty list has
no turns and gives no row.  Records of an unknown layout give one row with null
turn, role and text, so that nothing is guessed.

`format_turns` writes a conversation's turns in a ChatML-like template

    <|im_start|>role\\ntext<|im_end|>\\n

Inside roles and texts the first character of every control string of common
templates, and every backslash, is replaced by a backslash and a letter, so no
text can hold a marker and `parse` gives back exactly what went in.  The
result is cut in segments, each in or out of the loss: exactly the assistant
texts are in.  `loss_spans` gives the loss mask as places in the formatted
text, and `masked_text` reads what stands under a mask back from there.

Everything is a Spark expression.  Turns are escaped row by row before they
are grouped.  Groups are joined in two steps, by runs of RUN turns and then by
conversation, so that a conversation with a third of all rows is put together
by many tasks; the last step holds one formatted conversation per row.

Null text counts as empty, a null role as an empty one; a null turn number
comes last.  Turns with one number are ordered by role and text.  Repeated rows
are turns of their own.  Rows without conversation id can't be told to belong
together: each is a conversation of one turn.  An empty table gives no rows.
Texts of any length stay whole.  Further columns and their names don't matter.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound

RUN, PIECE = 64, 192
START, END = "<|im_start|>", "<|im_end|>\n"
#: Control strings of common templates: fixed values.
CONTROL = [
    "<|im_start|>",
    "<|im_end|>",
    "<|endoftext|>",
    "<|begin_of_text|>",
    "<|end_of_text|>",
    "<|start_header_id|>",
    "<|end_header_id|>",
    "<|eot_id|>",
    "<|system|>",
    "<|user|>",
    "<|assistant|>",
    "<|end|>",
    "<s>",
    "</s>",
    "[INST]",
    "[/INST]",
    "<<SYS>>",
    "<</SYS>>",
]
#: What stands for an escaped character.
ESCAPES = [("\\", "\\b"), ("<", "\\l"), ("[", "\\k"), ("\n", "\\j")]


def escape(text: Column, line_breaks: bool = False) -> Column:
    """Text without control strings; line_breaks: without line breaks too (roles)."""
    out = F.replace(text, F.lit("\\"), F.lit("\\b"))
    for first, code in (("<", "l"), ("[", "k")):
        rest = "|".join(c[1:].replace("|", r"\|").replace("[", r"\[").replace("]", r"\]") for c in CONTROL if c[0] == first)
        pattern = ("\\" if first == "[" else "") + f"{first}(?={rest})"
        out = F.when(F.contains(out, F.lit(first)), F.regexp_replace(out, pattern, "\\\\" + code)).otherwise(out)
    return F.replace(out, F.lit("\n"), F.lit("\\j")) if line_breaks else out


def unescape(text: Column) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[1]), F.lit(e[0])), reversed(ESCAPES), text)


def format_turns(turns: DataFrame, id_column="conv_id", turn_column="turn", role_column="role", text_column="text") -> DataFrame:
    """(id, segments) per conversation; segments: array of (text, loss), whose texts joined are the formatted conversation."""
    role, text = F.coalesce(F.col(role_column), F.lit("")), F.coalesce(F.col(text_column), F.lit(""))
    turn = F.col(turn_column).cast("long")
    own = F.when(F.col(id_column).isNull(), F.monotonically_increasing_id())
    rows = turns.select(F.col(id_column).alias("id"), own.alias("own"), turn.alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.select("id", "own", F.col("turn").isNull().alias("late"), F.floor(F.col("turn") / RUN).alias("run"), F.struct("turn", "role", F.col("text").alias("raw"), escape(F.col("text")).alias("text")).alias("t"))
    runs = rows.groupBy("id", "own", "late", "run").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def pieces(t):
        head = F.concat(F.lit(START), escape(t["role"], True), F.lit("\n"))
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(t["text"].alias("text"), (t["role"] == "assistant").alias("loss")),
            F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")),
        )

    parts = runs.select("id", "own", "late", "run", F.flatten(F.transform("turns", pieces)).alias("segments"))
    whole = parts.groupBy("id", "own").agg(F.sort_array(F.collect_list(F.struct("late", "run", "segments"))).alias("runs"))
    return whole.select("id", F.flatten(F.col("runs.segments")).alias("segments"))


def formatted(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def parse(text: Column) -> Column:
    """Array of (role, text) from a formatted conversation."""
    turns = F.split(text, r"<\|im_end\|>\n")
    turns = F.slice(turns, 1, F.size(turns) - 1)

    def one(t):
        at = F.locate("\n", t)
        role = F.substring(t, F.lit(len(START) + 1), at - len(START) - 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substring(t, at + 1, F.length(t))).alias("text"))

    return F.transform(turns, one)


def loss_spans(segments: Column) -> Column:
    """The loss mask as array of (start, end) in code points of the formatted text.

    Spans are first found inside pieces of PIECE segments and then moved by
    the lengths of the pieces before, as an array that grows by one costs its length.
    """
    spans = "array<struct<start:int,end:int>>"
    none = F.struct(F.lit(0).alias("at"), F.array().cast(spans).alias("spans"))

    def step(acc, s):
        end = acc["at"] + F.length(s["text"])
        span = F.struct(acc["at"].alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(s["loss"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    def moved(pieces):
        offsets = F.aggregate(pieces, F.array(F.lit(0)), lambda acc, p: F.array_append(acc, F.element_at(acc, -1) + p["at"]))
        shift = lambda off: lambda p, k: F.transform(p["spans"], lambda x: F.struct((x["start"] + F.get(off, k)).alias("start"), (x["end"] + F.get(off, k)).alias("end")))
        return bound(offsets, lambda off: F.flatten(F.transform(pieces, shift(off))))

    firsts = F.sequence(F.lit(0), F.greatest(F.size(segments) - 1, F.lit(0)), F.lit(PIECE))
    pieces = F.transform(firsts, lambda k: F.aggregate(F.slice(segments, k + 1, F.lit(PIECE)), none, step))
    return bound(pieces, moved)


def masked_text(whole: Column, spans: Column) -> Column:
    """What stands in a formatted text under a mask, unescaped, nothing between.

    Read from four bytes a code point, so that a place is found without counting up to it.
    A letter goes ahead of what is decoded, where a U+FEFF would be taken for a byte order mark.
    """

    def part(wide, x):
        taken = F.substring(wide, x["start"] * 4 + 1, (x["end"] - x["start"]) * 4)
        return F.substring(F.decode(F.concat(F.encode(F.lit("x"), "UTF-32"), taken), "UTF-32"), F.lit(2), x["end"] - x["start"])

    return bound(F.encode(whole, "UTF-32"), lambda wide: F.array_join(F.transform(spans, lambda x: unescape(part(wide, x))), ""))


def _hash_paths(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def field_paths(record: Column) -> Column:
    """The field paths of a JSON text that some layout knows, in the order of KNOWN; null where it isn't a JSON object."""
    value = F.try_parse_json(record)
    has_key = lambda field: lambda m: F.map_contains_key(m, field)

    def paths(v):
        has = []
        for path in KNOWN:
            name, _, field = path.partition("[].")
            if path.endswith("[]"):
                found = F.schema_of_variant(F.try_variant_get(v, f"$.{path[:-2]}", "variant")).startswith("ARRAY")
            elif field:
                rows = F.from_json(F.get_json_object(record, f"$.{name}"), "array<map<string,string>>")
                found = F.exists(rows, has_key(field))
            else:
                found = F.try_variant_get(v, f"$.{path}", "variant").isNotNull()
            has.append(F.when(F.coalesce(found, F.lit(False)), F.lit(path)))
        return F.when(F.schema_of_variant(v).startswith("OBJECT"), F.array_join(F.array_compact(F.array(*has)), "\n"))

    return bound(value, paths)


def fingerprint(record: Column) -> Column:
    return F.sha2(field_paths(record), 256)


def _turn(role, path):
    return ("one", role, path)


def _list(path, roles, texts, names=()):
    return ("list", path, roles, texts, dict(names))


_SYSTEM = _turn("system", "$.system")
_SHARED = _list("$.conversations", "from", "value", [("human", "user"), ("gpt", "assistant")])
#: Field paths of a layout -> its turns in order: fixed values.
LAYOUTS = [
    (("prompt", "completion"), [_turn("user", "$.prompt"), _turn("assistant", "$.completion")]),
    (("prompt", "response"), [_turn("user", "$.prompt"), _turn("assistant", "$.response")]),
    (("question", "answer"), [_turn("user", "$.question"), _turn("assistant", "$.answer")]),
    (("instruction", "output"), [_turn("user", "$.instruction"), _turn("assistant", "$.output")]),
    (("instruction", "input", "output"), [_turn("user", ("$.instruction", "$.input")), _turn("assistant", "$.output")]),
    (("system", "instruction", "output"), [_SYSTEM, _turn("user", "$.instruction"), _turn("assistant", "$.output")]),
    (("system", "instruction", "input", "output"), [_SYSTEM, _turn("user", ("$.instruction", "$.input")), _turn("assistant", "$.output")]),
    (("system", "prompt", "response"), [_SYSTEM, _turn("user", "$.prompt"), _turn("assistant", "$.response")]),
    (("system", "prompt", "completion"), [_SYSTEM, _turn("user", "$.prompt"), _turn("assistant", "$.completion")]),
    (("messages[]", "messages[].role", "messages[].content"), [_list("$.messages", "role", "content")]),
    (("system", "messages[]", "messages[].role", "messages[].content"), [_SYSTEM, _list("$.messages", "role", "content")]),
    (("conversations[]", "conversations[].from", "conversations[].value"), [_SHARED]),
    (("system", "conversations[]", "conversations[].from", "conversations[].value"), [_SYSTEM, _SHARED]),
    (("dialog[]", "dialog[].role", "dialog[].text"), [_list("$.dialog", "role", "text")]),
]
#: Every path that a layout knows, a list ahead of its fields.
KNOWN = sorted({p for paths, _ in LAYOUTS for p in paths})


def _record_marks() -> dict[str, list]:
    """Turns by fingerprint; a layout's list may be empty, and then its fields aren't seen."""
    marks = {}
    for paths, parts in LAYOUTS:
        marks[_hash_paths(paths)] = parts
        if any(p.endswith("[]") for p in paths):
            marks.setdefault(_hash_paths([p for p in paths if "[]." not in p]), parts)
    return marks


def _turns_in(record: Column, path: str, role: str, text: str, names: dict) -> Column:
    rows = F.from_json(F.get_json_object(record, path), f"array<struct<`{role}`:string,`{text}`:string>>")

    def one(r):
        named = reduce(lambda c, n: F.when(r[role] == n[0], n[1]).otherwise(c), names.items(), r[role])
        return F.struct(named.alias("role"), r[text].alias("text"))

    return F.transform(rows, one)


def _turns_of(record: Column, parts) -> Column:
    found = []
    for kind, *spec in parts:
        if kind == "one":
            role, path = spec
            texts = [F.get_json_object(record, p) for p in ((path,) if isinstance(path, str) else path)]
            text = F.array_join(F.filter(F.array(*texts), lambda t: t != ""), "\n")
            found.append(F.array(F.struct(F.lit(role).alias("role"), text.alias("text"))))
        else:
            found.append(_turns_in(record, *spec))
    return F.concat(*found)


def canonical_turns(records: DataFrame, record_column: str, id_column: str = "conv_id") -> DataFrame:
    """(conv_id, turn, role, text) of JSON records in any declared layout; one row with a null turn for an unknown one."""
    record, turns = F.col(record_column), F.lit(None).cast("array<struct<role:string,text:string>>")
    for mark, parts in _record_marks().items():
        turns = F.when(F.col("__mark") == mark, _turns_of(record, parts)).otherwise(turns)
    found = records.select(F.col(id_column).alias("conv_id"), record.alias(record_column), fingerprint(record).alias("__mark")).select("conv_id", turns.alias("turns"))
    found = found.filter("turns is null or size(turns) > 0")
    return found.select("conv_id", F.posexplode_outer("turns").alias("turn", "t")).select("conv_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text")


_NAMES = {"human": "user", "gpt": "assistant"}
#: Field paths of a table -> how its rows become turns: fixed values.
TABLES = [
    (("conv_id", "turn", "role", "text"), ("rows", "conv_id", "turn", "role", "text")),
    (("conv_id", "turn", "role", "content"), ("rows", "conv_id", "turn", "role", "content")),
    (("conv_id", "messages[].role", "messages[].content"), ("list", "conv_id", "messages", "role", "content", {})),
    (("conv_id", "conversations[].from", "conversations[].value"), ("list", "conv_id", "conversations", "from", "value", _NAMES)),
    (("conv_id", "prompt", "response"), ("turns", "conv_id", (("user", "prompt"), ("assistant", "response")))),
    (("conv_id", "prompt", "completion"), ("turns", "conv_id", (("user", "prompt"), ("assistant", "completion")))),
    (("conv_id", "question", "answer"), ("turns", "conv_id", (("user", "question"), ("assistant", "answer")))),
    (("conv_id", "instruction", "output"), ("turns", "conv_id", (("user", "instruction"), ("assistant", "output")))),
    (("conv_id", "system", "prompt", "response"), ("turns", "conv_id", (("system", "system"), ("user", "prompt"), ("assistant", "response")))),
]


def schema_paths(kind: T.DataType, path: str = "") -> list[str]:
    """The nested field paths of a type; a list's elements are marked by []."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in schema_paths(f.dataType, f"{path}.{f.name}".lstrip("."))]
    return schema_paths(kind.elementType, f"{path}[]") if isinstance(kind, T.ArrayType) else [path]


def table_fingerprint(schema: T.StructType) -> str:
    known = {p for paths, _ in TABLES for p in paths}
    return _hash_paths(known.intersection(schema_paths(schema)))


def canonical_table(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of a table in any declared layout."""
    layouts = {_hash_paths(paths): spec for paths, spec in TABLES}
    mark = table_fingerprint(df.schema)
    if mark not in layouts:
        raise ValueError(f"unknown layout: {', '.join(sorted(schema_paths(df.schema)))}")
    kind, key, *spec = layouts[mark]
    if kind == "rows":
        turn, role, text = spec
        return df.select(F.col(key).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    if kind == "turns":
        turns = F.array(*[F.struct(F.lit(role).alias("role"), F.col(column).cast("string").alias("text")) for role, column in spec[0]])
    else:
        path, role, text, names = spec
        turns = F.transform(path, lambda m: F.struct(reduce(lambda c, n: F.when(m[role] == n[0], n[1]).otherwise(c), names.items(), m[role]).alias("role"), m[text].alias("text")))
    return df.select(F.col(key).alias("conv_id"), F.posexplode(turns).alias("turn", "t")).select("conv_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    hostile = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    turns = canonical_table(spark.read.parquet(f"{sf_dir}/conversations.parquet")).unionByName(canonical_table(hostile))
    out = format_turns(turns).select("id", formatted(F.col("segments")).alias("whole"), loss_spans(F.col("segments")).alias("mask"))
    # from here on all is read from the formatted text and its mask
    read = out.select("id", F.length("whole").cast("long").alias("formatted_chars"), parse(F.col("whole")).alias("turns"), masked_text(F.col("whole"), F.col("mask")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


_SQL_TURNS = """
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
"""
_SQL_ESCAPED = "replace(text, chr(92), chr(92) || 'b')"
for _first, _code in (("<", "l"), ("[", "k")):
    for _c in CONTROL:
        if _c[0] == _first:
            _SQL_ESCAPED = f"replace({_SQL_ESCAPED}, '{_c}', chr(92) || '{_code}{_c[1:]}')"
ORACLE_SQL = f"""
WITH t AS (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS own FROM ({_SQL_TURNS}))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum({len(START) + len(END) + 1} + length(role) + length({_SQL_ESCAPED})) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id, own
"""
