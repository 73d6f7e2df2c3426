"""Mixing sources to target weights: capped water-filling and seeded repetition.

Sources are ordered by code point, null last, and weighted in turn.  Their
targets share BUDGET times all words by weight; a source above its cap of
EPOCHS times its own size is clamped there and the excess goes to the others
by weight, until none is above (`water_fill`).

A source with target t and size s repeats each document floor(t / s) times
and once more for the documents whose seeded hash is low, up to a threshold
found so that the words taken come as near to t as whole documents allow.
The threshold is found without sorting a source: words are summed by the
hash's leading bits (2**LEVEL cells a source, combined before the shuffle),
the cell that crosses the rest is opened ROUNDS - 1 times in that way, and what
then shares the leading bits is walked in order.  Rows with one id share a
hash and fall together.

Up to MAX_SOURCES sources their sizes are collected, and one row for each
source is broadcast.  More than that stay on the cluster: they are ranked by
a sort, the water level is found by sums over the sources, and documents join
their source's row, sources with a thousandth of all words or more, of which
there are a thousand at most, by broadcast and the others by shuffle.  Both
ways give the same mix.  Only sizes are written and shuffled otherwise; texts
are read once to count words and once to give the result.

Null text has size 0, as an empty one.  Sources without words have target 0.
Rows without id take part with the hash of null, repeated rows all alike.
Empty tables give an empty result.  Texts of any length count whole.  Columns
named like the result's (size, source_size, target, repetitions, taken) are
replaced, all others pass through.  A source whose share is its cap exactly is
clamped, which gives the same target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLANK, Scratch

WEIGHTS, BUDGET, EPOCHS, SEED = (5, 2, 1), 1.5, 2, 42
LEVEL, ROUNDS, MAX_SOURCES = 8, 4, 100_000
_SIGN = -(1 << 63)


def water_fill(sizes: list[int], weights: list[float], total: float, epochs: float) -> list[float]:
    """Targets that share total by weight, none above epochs times its size."""
    caps = [epochs * s for s in sizes]
    targets, free = [0.0] * len(sizes), {k for k, s in enumerate(sizes) if s > 0 and weights[k] > 0}
    left = min(float(total), float(sum(caps[k] for k in free)))
    while free:
        weight = sum(weights[k] for k in free)
        above = {k for k in free if left * weights[k] / weight >= caps[k]}
        if not above:
            for k in free:
                targets[k] = left * weights[k] / weight
            break
        for k in above:
            targets[k] = float(caps[k])
            left -= caps[k]
        free -= above
    return targets


def n_words(text):
    """Number of runs of characters other than blanks; 0 for null."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, f"[{BLANK}]+"))).cast("long")


def _hash(id_column: str, seed: int):
    return F.xxhash64(F.lit(seed), F.col(id_column).cast("string"))


def _ranked(totals: DataFrame, scratch: Scratch) -> DataFrame:
    """totals with each source's place by code point, null last; without a task that holds them all."""
    placed = totals.orderBy(F.col("source").asc_nulls_last()).select("*", F.monotonically_increasing_id().alias("place"))
    placed = scratch.store(placed.withColumns({"part": F.shiftright("place", 33), "place": F.col("place").bitwiseAND(F.lit((1 << 33) - 1))}))
    counts = sorted((r.part, r["count"]) for r in placed.groupBy("part").count().collect())  # one row for each task of the sort
    before = [(part, sum(c for _, c in counts[:k])) for k, (part, _) in enumerate(counts)]
    starts = totals.sparkSession.createDataFrame(before, "part long, start long")
    return placed.join(F.broadcast(starts), "part").select("source", "size", (F.col("start") + F.col("place")).alias("place"))


def _targets(totals: DataFrame, weights, budget: float, epochs: float, scratch: Scratch, n: int) -> DataFrame:
    """(source, source_size, target) of each source."""
    if n <= MAX_SOURCES:
        rows = sorted(((r.source, r["size"]) for r in totals.collect()), key=lambda r: (r[0] is None, r[0] or ""))
        sizes = [s for _, s in rows]
        targets = water_fill(sizes, [weights[k % len(weights)] for k in range(len(sizes))], budget * sum(sizes), epochs)
        return totals.sparkSession.createDataFrame([(src, s, float(t)) for (src, s), t in zip(rows, targets, strict=True)], "source string, source_size long, target double")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights)).cast("int"))
    weighed = _ranked(totals, scratch).select("source", F.col("size").alias("source_size"), weight.alias("w"), (F.col("size") * float(epochs)).alias("cap"))
    weighed = scratch.store(weighed)
    able = weighed.filter("source_size > 0 and w > 0")
    whole = weighed.agg(F.sum("source_size").alias("size")).first()["size"] * float(budget)
    level, clamped = 0.0, -1
    while True:  # the level rises, and each time it does a source more is clamped
        over = F.col("cap") <= F.col("w") * level
        r = able.agg(F.sum(F.when(over, F.col("cap")).otherwise(0.0)).alias("caps"), F.sum(F.when(over, 0.0).otherwise(F.col("w"))).alias("w"), F.count_if(over).alias("n")).first()
        if r.n == clamped or not r.w:
            break
        clamped, level = r.n, (whole - r.caps) / r.w
    target = F.when((F.col("source_size") > 0) & (F.col("w") > 0), F.least(F.col("cap"), F.col("w") * level) if r.w else F.col("cap")).otherwise(0.0)
    return scratch.store(weighed.select("source", "source_size", target.alias("target")))


def _by_source(df: DataFrame, table: DataFrame, key: str, n: int, hot: DataFrame | None) -> DataFrame:
    """df with the columns of its source's row of table (named __source); rows without one are left out."""
    on = lambda t: F.col(key).eqNullSafe(t["__source"])
    if n <= MAX_SOURCES:
        return df.join(F.broadcast(table), on(table))
    marked = df.join(F.broadcast(hot.withColumnRenamed("source", "__hot_source").withColumn("__hot", F.lit(True))), F.col(key).eqNullSafe(F.col("__hot_source")), "left").drop("__hot_source")
    few = table.join(F.broadcast(hot), table["__source"].eqNullSafe(hot.source), "left_semi")
    rest = marked.filter("__hot is null")
    return marked.filter("__hot").join(F.broadcast(few), on(few)).unionByName(rest.join(table, on(table))).drop("__hot")


def plan(docs: DataFrame, id_column="doc_id", text_column="text", source_column="source", weights=WEIGHTS, budget=BUDGET, epochs=EPOCHS, seed=SEED, scratch: Scratch | None = None):
    """((source, source_size, target, whole repetitions, hash limit or null) of each source, their number, the hot ones)."""
    scratch = scratch or Scratch(docs.sparkSession, "mixing")
    sized = docs.select(F.col(source_column).cast("string").alias("source"), _hash(id_column, seed).alias("h"), n_words(F.col(text_column)).alias("size"))
    sized = scratch.store(sized)
    totals = scratch.store(sized.groupBy("source").agg(F.sum("size").alias("size")))
    n = totals.count()
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(epochs)))).otherwise(0).cast("int")
    table = _targets(totals, weights, budget, epochs, scratch, n).withColumn("whole", whole)
    table = scratch.store(table.withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")))
    hot = None
    if n > MAX_SOURCES:
        least = (totals.agg(F.sum("size").alias("size")).first()["size"] or 0) / 1000
        hot = scratch.store(totals.filter((F.col("size") >= least) & (F.col("size") > 0)).select("source"))
    # open the crossing cell level by level: `need` becomes what is still to be taken from the cell
    cells, bits = table.filter("need > 0.5").select(F.col("source").alias("__source"), "need", F.lit(0).cast("long").alias("path")), 0
    for _ in range(ROUNDS):
        inside = _by_source(sized, cells, "source", n, hot)
        if bits:
            inside = inside.filter(F.shiftrightunsigned("h", 64 - bits) == F.col("path"))
        bits += LEVEL
        summed = inside.groupBy("__source", "need", F.shiftrightunsigned("h", 64 - bits).alias("path")).agg(F.sum("size").alias("size"))
        order = Window.partitionBy("__source").orderBy("path")  # 2**LEVEL rows of a source at most
        upto = summed.withColumn("upto", F.sum("size").over(order)).withColumn("before", F.col("upto") - F.col("size"))
        cells = scratch.store(upto.filter("before <= need and upto > need").select("__source", (F.col("need") - F.col("before")).alias("need"), "path"))
    last = _by_source(sized, cells, "source", n, hot).filter(F.shiftrightunsigned("h", 64 - bits) == F.col("path"))
    # unsigned order of h: equal leading bits, so the rest orders as a positive number
    rest = last.groupBy("__source", "need", "path", F.col("h").bitwiseAND(F.lit((1 << (64 - bits)) - 1)).alias("rest")).agg(F.sum("size").alias("size"))
    order = Window.partitionBy("__source").orderBy("rest")
    walked = rest.withColumn("upto", F.sum("size").over(order))
    nearest = walked.filter(F.col("upto") - F.col("size") / 2 <= F.col("need")).groupBy("__source", "path").agg(F.max("rest").alias("rest"))
    # flipping the sign bit turns unsigned order into signed order
    flipped = lambda x: x.bitwiseXOR(F.lit(_SIGN))
    path = F.shiftleft(cells.path, 64 - bits)
    limit = F.when(F.col("rest").isNotNull(), flipped(path.bitwiseOR(F.col("rest")))).when(cells.path > 0, flipped(path) - 1)
    nearest = nearest.select(F.col("__source").alias("of"), "rest")
    limits = cells.join(nearest, cells["__source"].eqNullSafe(nearest.of), "left").select(cells["__source"].alias("of"), limit.alias("limit"))
    out = table.join(limits, table.source.eqNullSafe(limits.of), "left").select("source", "source_size", "target", "whole", "limit")
    return scratch.store(out), n, hot


def mix(docs: DataFrame, id_column="doc_id", text_column="text", source_column="source", **options) -> DataFrame:
    """docs with size, source_size, target, repetitions and taken (words, repeats counted); helper columns replace those of the same name."""
    seed = options.get("seed", SEED)
    made = ["size", "source_size", "target", "repetitions", "taken"]
    table, n, hot = plan(docs, id_column, text_column, source_column, **options)
    table = table.withColumnsRenamed({"source": "__source", "whole": "__whole", "limit": "__limit"})
    kept = [c for c in docs.columns if c not in made]
    place = _hash(id_column, seed).bitwiseXOR(F.lit(_SIGN))
    sized = docs.select(*kept, n_words(F.col(text_column)).alias("size"), F.col(source_column).cast("string").alias("__of"), place.alias("__place"))
    joined = _by_source(sized, table, "__of", n, hot)
    times = F.col("__whole") + F.when(F.col("__place") <= F.col("__limit"), 1).otherwise(0)
    return joined.withColumn("repetitions", times).select(*kept, "size", "source_size", "target", "repetitions", (F.col("size") * times).alias("taken"))


def repeated(mixed: DataFrame) -> DataFrame:
    """One row for each repetition of a mixed document."""
    return mixed.filter("repetitions > 0").withColumn("repetition", F.explode(F.sequence(F.lit(1), F.col("repetitions"))))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
