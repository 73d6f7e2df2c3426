"""Document fingerprints: one-permutation MinHash, optimal densification, packed low-order bits.

Everything is a Spark expression.  A text's words (A-Z folded) are hashed
once, five neighbouring word hashes give a shingle hash, and its upper eight
bits name one of BINS bins.  Sorting the hashes together with one sentinel
for each bin leaves each bin's least value, or the sentinel where the bin is
empty.  An empty bin b takes the value of the full bin j with the least
rank(b, j), a fixed pseudo-random order: the first PROBES places of that
order are tried one by one, the rest by a minimum over the full bins.

A fingerprint keeps four low-order bits of each bin, a hexadecimal digit
each, taken from a hash of value and bin, so that one value in many bins of a
short text doesn't agree by chance in all of them at once.  Bins of unlike texts agree by chance once in 16, which `likeness`
corrects: (equal / BINS - 1/16) / (1 - 1/16), held within 0 and 1.

Text of one to four words has one shingle, its whole sequence.  Text without
words, null or empty, has the empty fingerprint, alike to itself (1) and to
nothing else (0).  Repeated rows have equal fingerprints, an empty table gives
no rows, texts of any length are read whole; of bins of equal rank the lower
number wins.  `with_fingerprint` keeps all columns but one of the result's name
(and helpers named __<name>_*); `compare_edits` reads id and text only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLANK, Scratch, fold

BINS, BITS, PROBES, SHINGLE = 256, 4, 8, 5
_LOW = 56
_SENTINEL = (1 << _LOW) - 1
_PRIME = (1 << 31) - 1


def rank(b, j):
    """Place of bin j in the order of bin b; for ints and columns alike."""
    x = (b * BINS + j) * 48271 % _PRIME
    x = (x * x % _PRIME * x + 1103515245) % _PRIME
    return x * x % _PRIME * 69621 % _PRIME


def _first_probes() -> list[list[int]]:
    order = [sorted(range(BINS), key=lambda j: (rank(b, j), j))[:PROBES] for b in range(BINS)]
    return [[order[b][k] for b in range(BINS)] for k in range(PROBES)]


def _int_array(values: list[int]) -> Column:
    return F.from_json(F.lit(str(values)), "array<int>")


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with the fingerprint of a text column; helper columns of the form __name_* come and go."""
    c = lambda x: f"__{name}_{x}"
    col = lambda x: F.col(c(x))
    kept = df.columns
    clean = F.trim(fold(F.coalesce(F.col(text), F.lit(""))), F.lit(" \t\n\x0b\f\r"))
    words = F.split(clean, f"[{BLANK}]+")
    df = df.withColumn(c("w"), F.when(clean != "", F.transform(words, lambda w: F.xxhash64(w))).otherwise(F.array().cast("array<bigint>")))
    n = F.size(col("w"))
    runs = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*[F.get(col("w"), i + k) for k in range(SHINGLE)]))
    few = F.when(n > 0, F.array(F.xxhash64(col("w"), n))).otherwise(F.array().cast("array<bigint>"))
    ends = F.transform(F.sequence(F.lit(-BINS // 2).cast("bigint"), F.lit(BINS // 2 - 1).cast("bigint")), lambda b: F.shiftleft(b, _LOW).bitwiseOR(F.lit(_SENTINEL)))
    df = df.withColumn(c("s"), F.sort_array(F.concat(F.when(n >= SHINGLE, runs).otherwise(few), ends)))
    bin_of = lambda x: F.shiftright(x, _LOW)
    df = df.withColumn(c("m"), F.filter(col("s"), lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(col("s"), i - 1)))))
    full = lambda x: x.bitwiseAND(F.lit(_SENTINEL)) != _SENTINEL
    at = lambda j: F.get(col("m"), j)
    df = df.withColumn(c("f"), F.filter(F.transform(col("m"), lambda x, j: F.when(full(x), j)), lambda j: j.isNotNull()))
    probes = [_int_array(p) for p in _first_probes()]

    def filled(x, b):
        tries = [F.when(full(at(F.get(p, b))), at(F.get(p, b))) for p in probes]
        nearest = F.array_min(F.transform(col("f"), lambda j: rank(b.cast("bigint"), j.cast("bigint")) * BINS + j))
        return F.when(full(x), x).otherwise(F.coalesce(*tries, at((nearest % BINS).cast("int"))))

    digits = F.transform(F.transform(col("m"), filled), lambda x, b: F.substring(F.lit("0123456789abcdef"), F.xxhash64(x, b).bitwiseAND(F.lit(15)).cast("int") + 1, F.lit(1)))
    return df.withColumn(name, F.when(F.size(col("f")) > 0, F.array_join(digits, "")).otherwise("")).select(*kept, name)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the texts behind two fingerprints."""
    equal = F.size(F.filter(F.arrays_zip(F.split(a, "").alias("x"), F.split(b, "").alias("y")), lambda z: z["x"] == z["y"]))
    by_chance = 1 / (1 << BITS)
    value = (equal / BINS - by_chance) / (1 - by_chance)
    held = F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))
    return F.when(a.isNotNull() & b.isNotNull(), F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(held))


def successors(ids: DataFrame, widths=(14, 25)) -> DataFrame:
    """(id, next_id) for distinct ids of type long; the greatest id has null.

    Ids are dealt by their upper bits, so a window holds 2**14 ids at most;
    the least id of the next bucket follows a bucket's greatest, and buckets
    are chained in the same way, twice.
    """

    def chain(df: DataFrame, level: int) -> DataFrame:
        if level == len(widths):
            return df.withColumn("next_id", F.lead("id").over(Window.orderBy("id")))
        df = df.withColumn("bucket", F.shiftright("id", widths[level]))
        inside = df.withColumn("next_id", F.lead("id").over(Window.partitionBy("bucket").orderBy("id")))
        least = df.groupBy("bucket").agg(F.min("id").alias("least"))
        follow = chain(least.select(F.col("bucket").alias("id")), level + 1).withColumnsRenamed({"id": "bucket", "next_id": "next_bucket"})
        entry = follow.join(least.withColumnsRenamed({"bucket": "next_bucket"}), "next_bucket").select("bucket", "least")
        return inside.join(entry, "bucket", "left").select("id", F.coalesce("next_id", "least").alias("next_id"))

    return chain(ids.select("id"), 0)


def compare_edits(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has the last floor(n / 4) code points replaced by the
    first as many of the next document, by ascending id (after the last: the
    first).  Among repeated rows of one id, the next document is the row with
    the least text hash.  Rows without id have no next document: their edited
    text is cut, near_next is null.
    """
    scratch = Scratch(docs.sparkSession, "fingerprint")
    base = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    named = base.filter("id is not null")
    ids = named.groupBy("id").agg(F.min(F.xxhash64("text")).alias("key"), F.max(F.length("text")).alias("n"))
    ids = scratch.store(ids)
    least = ids.agg(F.min("id").alias("x")).first().x
    order = scratch.store(successors(ids).withColumn("next_id", F.coalesce("next_id", F.lit(least))))
    asked = (
        order.join(ids.select("id", F.floor(F.col("n") / 4).cast("int").alias("need")), "id")
        .withColumnsRenamed({"id": "for_id", "next_id": "id"})
        .join(ids.select("id", "key"), "id")
    )
    asked = asked.withColumnRenamed("id", "of_id")
    same = ~((F.xxhash64("text") < F.col("key")) | (F.xxhash64("text") > F.col("key")))  # not an equality: texts are dealt by id alone, once
    heads = named.join(asked, (named.id == asked.of_id) & same).select("for_id", F.col("of_id").alias("next_id"), F.expr("left(text, need)").alias("head"))
    heads = heads.groupBy("for_id").agg(F.any_value("next_id").alias("next_id"), F.any_value("head").alias("head"))
    joined = named.join(heads, named.id == heads.for_id, "left").drop("for_id")
    joined = joined.unionByName(base.filter("id is null"), allowMissingColumns=True)
    n = F.length("text")
    edited = F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 4) as int))"), F.expr("left(coalesce(head, ''), cast(floor(length(text) / 4) as int))"))
    joined = joined.select("id", "next_id", "text", edited.alias("edited"))
    both = with_fingerprint(with_fingerprint(joined, "text", "fingerprint"), "edited", "edited_fingerprint")
    both = both.select("id", "next_id", F.xxhash64("text").alias("key"), n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint")
    both = scratch.store(both)
    following = both.join(ids.select("id", "key"), ["id", "key"]).groupBy("id").agg(F.any_value("fingerprint").alias("next_fingerprint")).withColumnRenamed("id", "next_id")
    out = both.join(following, "next_id", "left")
    return out.select(
        "id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edits(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
