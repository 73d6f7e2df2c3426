"""Line deduplication with a log-template tree of fixed depth.

Each line goes down a tree: by its number of tokens (runs of characters other
than \\x20 and \\x09-\\x0D), then by its first DEPTH tokens, where a token with a
digit counts as the wildcard <*>.  In a leaf, lines with the same tokens after
masking share a template.

A leaf may hold several families of templates that differ in other fields, and
any number of lines that belong to none.  Two templates that agree at SIMILAR of
all positions are linked; the lines of templates that links connect, directly or
by others, are a family.  Every link between different families would be found:
the positions after the leading ones are cut into one part more than may differ,
so linked templates agree in one part at least, and the templates with one part
in common are a bucket.  (Where only one position may differ, a bucket has all
positions but one in common, so that all in it are linked.)  Each bucket's center,
its template with the most documents, is compared with all others there.  Of what
is still apart in a bucket, each template takes as many of its positions as parts,
those whose tokens the fewest have at this place: linked templates have one of
them in common, and are compared if they do.

A template or family recurs from MIN_DOCS documents on; documents with the
same text count as one, so whole copies are left to near-duplicate removal.
What stands in two texts by chance recurs from SHORT_DOCS on: families of lines
of fewer than LONG tokens, which one token may tell apart, and lines of fewer
than MIN_TOKENS.  The latter have a leaf by the tokens there are and no
families.  One that is all wildcards keeps its tokens as they are, or any two
numbers would be alike.

What recurs stays at its first place (by document id, then text hash, then
line) and goes everywhere else; documents with that first text are treated
alike.  A document that thereby loses every line goes, because all of it stands
elsewhere; one that had no line to lose, such as an empty one, stays.

All steps are Spark expressions over hashes of lines (two 64-bit hashes make
a template's name): line texts travel only for leaves with several templates,
documents only if they lose a line, and each is split once.  Hot templates are
added up before they move; what aggregates give is written before it is
joined, so that adaptive execution can split a hot key in the join.

Null text stays null; empty and blank lines never go.  Rows without id take
part, after all others.  Repeated rows are treated alike.  Texts of any length
are read whole.  An empty table stays empty.  All columns pass through,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK, Scratch, bound, components, likely_in

MIN_TOKENS, DEPTH, SIMILAR = 3, 3, 0.75
LONG, MIN_DOCS, SHORT_DOCS = 8, 2, 3
_ENDS = " \t\n\x0b\f\r"


def _split(line):
    return F.split(F.trim(line, F.lit(_ENDS)), f"[{BLANK}]+")


def tokens(line):
    """Tokens of a line; those with a digit are masked."""
    masked = F.when(line.rlike("[0-9]"), F.regexp_replace(line, rf"(?<![^{BLANK}])[^{BLANK}0-9]*+[0-9][^{BLANK}]*+", "<*>")).otherwise(line)
    return _split(masked)


def _located(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"), F.xxhash64(text_column).alias("key"))


def _cut(n):
    """One more than the positions of n that may differ."""
    return F.floor(n * (1 - SIMILAR)).cast("int") + 1


def _parts(tokens):
    """A hash of the tokens in each part of the positions after the leading ones; where one may differ, of all but each."""
    n = F.size(tokens)
    cut = _cut(n)
    start = lambda k: F.lit(DEPTH) + F.floor(k * (n - DEPTH) / cut).cast("int")
    parts = F.transform(F.sequence(F.lit(0), cut - 1), lambda k: F.xxhash64(k, F.slice(tokens, start(k) + 1, start(k + 1) - start(k))))
    others = F.transform(F.sequence(F.lit(DEPTH), n - 1), lambda k: F.xxhash64(k, F.slice(tokens, 1, k), F.slice(tokens, k + 2, n)))
    return F.when(cut == 2, others).otherwise(parts)


def _linked(pairs: DataFrame, spelled: DataFrame) -> DataFrame:
    """Of pairs (leaf, template, other, ...), those that agree at SIMILAR of all positions."""
    words = spelled.select("leaf", "template", "tokens")
    pairs = pairs.join(words, ["leaf", "template"])
    pairs = pairs.join(words.withColumnsRenamed({"template": "other", "tokens": "others"}), ["leaf", "other"])
    same = F.size(F.filter("tokens", lambda t, i: t == F.get("others", i)))
    return pairs.filter(same >= SIMILAR * F.size("tokens")).drop("tokens", "others")


def _pairs_apart(members: DataFrame, spelled: DataFrame, scratch: Scratch) -> DataFrame:
    """(leaf, template, other, part, other_part) of all pairs in different parts that may be linked; members: (leaf, template, part).

    Linked templates differ in fewer than cut positions, so they have one of the
    cut first in common, in any order of tokens and places that holds for the leaf.
    """
    words = spelled.select("leaf", "template", _cut(F.col("size")).alias("cut"), F.slice("tokens", F.lit(DEPTH + 1), F.col("size")).alias("tokens"))
    at = members.join(words, ["leaf", "template"]).select("leaf", "template", "part", "cut", F.posexplode("tokens").alias("pos", "token"))
    at = scratch.store(at.select("leaf", "template", "part", "cut", F.xxhash64("pos", "token").alias("at")))
    counts = scratch.store(at.groupBy("leaf", "at").agg(F.count("*").alias("n")))
    rare = at.join(counts, ["leaf", "at"]).groupBy("leaf", "template", "part", "cut").agg(F.sort_array(F.collect_list(F.struct("n", "at"))).alias("ats"))
    rare = rare.select("leaf", "template", "part", F.explode(F.slice("ats", F.lit(1), F.col("cut"))).alias("x")).filter("x.n > 1")
    rare = scratch.store(rare.select("leaf", "template", "part", "x.at"))
    by_part = rare.groupBy("leaf", "at", "part").agg(F.count("*").alias("n"))
    # each outside the largest part of its bucket meets all in other parts
    largest = by_part.groupBy("leaf", "at").agg(F.max(F.struct("n", "part")).alias("m"), F.count("*").alias("parts")).filter("parts > 1")
    largest = scratch.store(largest.select("leaf", "at", F.col("m.part").alias("main")))
    held = scratch.store(rare.join(largest, ["leaf", "at"]))
    others = held.drop("main").withColumnsRenamed({"template": "other", "part": "other_part"})
    pairs = held.filter("part != main").join(others, ["leaf", "at"]).filter("part != other_part and (other_part = main or template < other)")
    return pairs.select("leaf", "template", "other", "part", "other_part").distinct()


def _families(spelled: DataFrame, scratch: Scratch) -> DataFrame:
    """(leaf, template, size, family) of the templates that are linked; spelled: (leaf, template, n_docs, size, tokens)."""
    rank = F.struct((-F.col("n_docs")).alias("n"), "template")
    dealt = spelled.select("leaf", rank.alias("rank"), F.explode(_parts(F.col("tokens"))).alias("bucket"))
    dealt = scratch.store(dealt)
    centers = dealt.groupBy("leaf", "bucket").agg(F.min("rank").alias("center"), F.count("*").alias("n")).filter("n > 1")
    centers = scratch.store(centers.select("leaf", "bucket", F.col("center.template").alias("other")))
    shared = dealt.join(centers, ["leaf", "bucket"]).select("leaf", "bucket", F.col("rank.template").alias("template"), "other").filter("template != other")
    shared = scratch.store(shared)
    # tokens meet tokens once for each template and center
    links = _linked(shared.select("leaf", "template", "other").distinct(), spelled)
    stars = components(links.select(F.col("template").alias("a"), F.col("other").alias("b")), scratch).withColumnsRenamed({"node": "of", "root": "part"})
    # members that no center connects, the centers aside
    placed = shared.join(stars, shared.template == stars.of, "left").select("leaf", "bucket", "template", F.coalesce("part", "template").alias("part"))
    placed = scratch.store(placed)
    mixed = placed.groupBy("leaf", "bucket").agg(F.min("part").alias("least"), F.max("part").alias("most")).filter("least != most")
    mixed = scratch.store(mixed.select("leaf", "bucket"))
    apart = scratch.store(placed.join(mixed, ["leaf", "bucket"]).select("leaf", "template", "part").distinct())
    found = spelled.select("leaf", "template", "size").join(stars, F.col("template") == stars.of, "left").withColumn("family", F.col("part"))
    if not apart.isEmpty():
        links = _linked(_pairs_apart(apart, spelled, scratch), spelled)
        joined = components(links.select(F.col("part").alias("a"), F.col("other_part").alias("b")), scratch)
        found = found.join(joined, F.coalesce("part", "template") == joined.node, "left").withColumn("family", F.coalesce("root", "part"))
    return scratch.store(found.filter("family is not null").select("leaf", "template", "size", "family"))


def recurring_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", scratch: Scratch | None = None, min_docs: int = MIN_DOCS, short_docs: int = SHORT_DOCS) -> DataFrame:
    """(id, key, pos, leaf, template, general, n_docs, first) of each line that recurs.

    key is the text's xxhash64; template is one of the family where general,
    else the line's own; first is the first place.
    """
    scratch = scratch or Scratch(docs.sparkSession, "line-dedup")
    base = _located(docs, id_column, text_column)
    lines = base.select("id", "key", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    # blank lines are told by the line, as a filter on its tokens would work them out once more
    lines = lines.filter(F.trim("line", F.lit(_ENDS)) != "").withColumn("tokens", tokens(F.col("line")))
    bare = (F.size("tokens") < MIN_TOKENS) & (F.size(F.array_remove("tokens", "<*>")) == 0)
    lines = lines.withColumn("tokens", F.when(bare, _split(F.col("line"))).otherwise(F.col("tokens")))
    leaf = F.xxhash64(F.size("tokens"), F.slice("tokens", 1, DEPTH))
    seen = scratch.store(lines.select("id", "key", "pos", leaf.alias("leaf"), F.xxhash64("tokens").alias("template"), F.size("tokens").alias("size")))
    place = F.struct(F.col("id").isNull().alias("unnamed"), "id", "key", "pos")
    needed_docs = lambda short: F.when(F.col("size") < short, short_docs).otherwise(min_docs)
    names = ["leaf", "template", "size"]
    by_text = seen.groupBy(*names, "key").agg(F.min(place).alias("first"))
    templates = scratch.store(by_text.groupBy(*names).agg(F.count("*").alias("n_docs"), F.min("first").alias("first")))

    several = templates.filter(f"size >= {MIN_TOKENS}").groupBy("leaf", "size").agg(F.count("*").alias("n"), F.sum("n_docs").alias("d"))
    several = scratch.store(several.filter((F.col("n") > 1) & (F.col("d") >= needed_docs(LONG))).select("leaf"))
    open_ones = templates.join(several, "leaf").select("leaf", "template", "n_docs", "first", "first.id", "first.key", "first.pos")
    places = open_ones.groupBy(F.col("id").alias("at_id"), F.col("key").alias("at_key")).agg(F.collect_list(F.struct("first", "leaf", "template", "n_docs")).alias("places"))  # lines of one text
    places = scratch.store(places)
    needed = likely_in(base, F.xxhash64("id", "key"), places.select(F.xxhash64("at_id", "at_key").alias("key")))
    texts = needed.join(places, needed.id.eqNullSafe(places.at_id) & (needed.key == places.at_key)).dropDuplicates(["id", "key"])
    line_of = bound(F.split("text", "\n"), lambda all_lines: F.transform("places", lambda p: F.struct(p["leaf"].alias("leaf"), p["template"].alias("template"), p["n_docs"].alias("n_docs"), F.get(all_lines, p["first"]["pos"]).alias("line"))))
    spelled = texts.select(F.explode(line_of).alias("x")).select("x.leaf", "x.template", "x.n_docs", tokens(F.col("x.line")).alias("tokens"))
    alike = _families(scratch.store(spelled.withColumn("size", F.size("tokens"))), scratch)

    members = scratch.store(seen.drop("size").join(alike, ["leaf", "template"]).select("id", "key", "pos", "leaf", F.col("family").alias("template"), "size"))
    general = members.groupBy("leaf", "template", "size", "key").agg(F.min(place).alias("first")).groupBy("leaf", "template", "size").agg(F.count("*").alias("n_docs"), F.min("first").alias("first"))
    general = scratch.store(general.filter(F.col("n_docs") >= needed_docs(LONG)).drop("size"))
    part = members.join(general, ["leaf", "template"]).withColumn("general", F.lit(True))
    taken = alike.join(general.select("leaf", F.col("template").alias("family")), ["leaf", "family"], "left_semi").select("leaf", "template")
    own = templates.filter(F.col("n_docs") >= needed_docs(MIN_TOKENS)).join(taken, ["leaf", "template"], "left_anti")
    own = scratch.store(own.select("leaf", "template", "n_docs", "first"))
    alone = seen.join(own, ["leaf", "template"]).withColumn("general", F.lit(False))
    columns = ["id", "key", "pos", "leaf", "template", "general", "n_docs", "first"]
    return part.select(*columns).unionByName(alone.select(*columns))


def without_lines(text, gone):
    """Text without the lines at some places, an array; null where none is left."""

    def left(lines):
        return bound(
            F.concat(F.array(F.lit(-1)), F.array_sort(gone), F.array(F.size(lines))),
            lambda g: F.flatten(F.transform(F.sequence(F.lit(1), F.size(g) - 1), lambda k: F.slice(lines, F.get(g, k - 1) + 2, F.get(g, k) - F.get(g, k - 1) - 1))),
        )

    return bound(F.split(text, "\n"), lambda lines: bound(left(lines), lambda kept: F.when(F.size(kept) > 0, F.array_join(kept, "\n"))))


def drop_recurring_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", report: bool = False, scratch: Scratch | None = None, **thresholds) -> DataFrame:
    """The documents without recurring lines.  report: also n_lines_dropped, and the documents that go stay, with an empty text."""
    scratch = scratch or Scratch(docs.sparkSession, "line-dedup")
    found = recurring_lines(docs, id_column, text_column, scratch, **thresholds)
    gone = found.filter((F.col("key") != F.col("first.key")) | (F.col("pos") != F.col("first.pos")))
    gone = gone.groupBy(F.col("id").alias("__id"), F.col("key").alias("__key")).agg(F.collect_set("pos").alias("__gone"))
    gone = scratch.store(gone)
    marks = scratch.store(gone.select(F.xxhash64("__id", "__key").alias("key")))
    mark = F.xxhash64(F.col(id_column).cast("long"), F.xxhash64(text_column))
    kept = docs.columns
    touched = likely_in(docs, mark, marks).withColumn("__text_key", F.xxhash64(text_column))
    joined = touched.join(gone, F.col(id_column).cast("long").eqNullSafe(F.col("__id")) & (F.col("__text_key") == F.col("__key")), "left")
    # dropping: where the text is null beside places that go, no line is left
    changed = joined.withColumn("__left", F.when(F.col("__gone").isNotNull(), without_lines(F.col(text_column), F.col("__gone"))).otherwise(F.col(text_column)))
    if report:
        changed = changed.withColumn("__left", F.when(F.col("__gone").isNotNull(), F.coalesce("__left", F.lit(""))).otherwise(F.col("__left")))
    else:
        changed = changed.filter("__gone is null or __left is not null")
    n_dropped = [F.coalesce(F.size("__gone"), F.lit(0)).alias("n_lines_dropped")] if report else []
    changed = changed.select(*[F.col("__left").alias(c) if c == text_column else F.col(c) for c in kept], *n_dropped)
    rest = likely_in(docs, mark, marks, inside=False)
    return changed.unionByName(rest.withColumn("n_lines_dropped", F.lit(0)) if report else rest)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_recurring_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), report=True)
    return out.select("doc_id", F.length("text").cast("long").alias("n_chars_left"), F.col("n_lines_dropped").cast("long").alias("n_lines_dropped"), "text")


ORACLE_SQL = rf"""
WITH lines AS (
       SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
     words AS (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS raw FROM lines),
     masked AS (SELECT *, list_transform(raw, lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS mask FROM words WHERE len(raw) > 0),
     seen AS MATERIALIZED (
       SELECT doc_id, text, pos, tokens, len(tokens) AS n, [CAST(len(tokens) AS VARCHAR)] || tokens[1:{DEPTH}] AS leaf
       FROM (SELECT *, CASE WHEN len(raw) < {MIN_TOKENS} AND len(list_filter(mask, lambda t: t <> '<*>')) = 0 THEN raw ELSE mask END AS tokens FROM masked)),
     templates AS MATERIALIZED (
       SELECT leaf, tokens, n, count(DISTINCT text) AS n_docs, arg_min(text, doc_id * 1000000 + pos) AS first_text, min(doc_id * 1000000 + pos) % 1000000 AS first_pos, min(doc_id * 1000000 + pos) AS place
       FROM seen GROUP BY leaf, tokens, n),
     several AS (SELECT leaf FROM templates WHERE n >= {MIN_TOKENS} GROUP BY leaf, n HAVING count(*) > 1 AND sum(n_docs) >= CASE WHEN n < {LONG} THEN {SHORT_DOCS} ELSE {MIN_DOCS} END),
     spelled AS MATERIALIZED (SELECT *, CAST(floor(n * {1 - SIMILAR}) AS INT) + 1 AS cut FROM templates JOIN several USING (leaf)),
     dealt AS MATERIALIZED (
       SELECT leaf, tokens, n, {{'n': -n_docs, 'place': place}} AS rank, k, tokens[{DEPTH} + (k * (n - {DEPTH})) // cut + 1:{DEPTH} + ((k + 1) * (n - {DEPTH})) // cut] AS part
       FROM (SELECT *, unnest(range(cut)) AS k FROM spelled)),
     centers AS MATERIALIZED (
       SELECT leaf, k, part, arg_min(tokens, rank) AS center, min(rank) AS center_rank
       FROM dealt GROUP BY leaf, k, part HAVING count(*) > 1),
     chosen AS MATERIALIZED (
       SELECT leaf, tokens, arg_min(center, center_rank) AS family FROM dealt JOIN centers USING (leaf, k, part)
       WHERE len(list_filter(range(1, n + 1), lambda i: tokens[i] = center[i])) >= {SIMILAR} * n GROUP BY leaf, tokens),
     alike AS MATERIALIZED (SELECT leaf, tokens, family FROM chosen JOIN (SELECT leaf, family FROM chosen GROUP BY leaf, family HAVING count(*) > 1) USING (leaf, family)),
     general AS MATERIALIZED (
       SELECT leaf, family, arg_min(text, doc_id * 1000000 + pos) AS first_text, min(doc_id * 1000000 + pos) % 1000000 AS first_pos
       FROM seen JOIN alike USING (leaf, tokens) GROUP BY leaf, family HAVING count(DISTINCT text) >= CASE WHEN any_value(n) < {LONG} THEN {SHORT_DOCS} ELSE {MIN_DOCS} END),
     found AS (
       SELECT s.doc_id, s.text, s.pos, g.first_text, g.first_pos FROM seen AS s JOIN alike USING (leaf, tokens) JOIN general AS g USING (leaf, family)
       UNION ALL
       SELECT s.doc_id, s.text, s.pos, t.first_text, t.first_pos FROM seen AS s JOIN templates AS t USING (leaf, tokens)
       WHERE t.n_docs >= CASE WHEN t.n < {MIN_TOKENS} THEN {SHORT_DOCS} ELSE {MIN_DOCS} END AND NOT EXISTS (SELECT 1 FROM alike AS a JOIN general AS g USING (leaf, family) WHERE a.leaf = s.leaf AND a.tokens = s.tokens)),
     gone AS (SELECT doc_id, list(DISTINCT pos) AS gone FROM found WHERE NOT (text = first_text AND pos = first_pos) GROUP BY doc_id),
     kept AS (
       SELECT d.doc_id, coalesce(len(gone), 0) AS n,
              CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(gone, i - 1)), chr(10)) END AS text
       FROM documents AS d LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars_left, CAST(n AS BIGINT) AS n_lines_dropped, text FROM kept
"""
