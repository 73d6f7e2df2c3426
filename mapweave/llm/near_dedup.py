"""Near-duplicate documents: one-permutation hashing, banded buckets, star edges.

A document's set holds its distinct five-word shingles (`textkernel`).  Equal
sets collapse into one class first, so groups of exact copies never meet in a
bucket.  Each class hashes its shingles once into BINS bins, keeps each bin's
least value, fills empty bins by optimal densification (an empty bin takes
the value of the first full one in its own fixed random order) and joins the
bins in bands of ROWS.  Classes in one bucket are tied to the bucket's
smallest member: star edges, at most one per class and band.

Every star edge is judged first: a center and its members are dealt in chunks
of about CHUNK members, so a hot center is judged by many tasks, and all pairs
of a chunk that aren't yet connected are judged with it.  What is linked is
joined to parts (connected components).  A bucket whose members are all in one
part is done, and nearly all are.  In the others every pair of different parts
is judged: the members outside the bucket's largest part are dealt in blocks,
and each block meets the other such blocks and those of the largest part,
which don't meet one another.  Pairs are judged by the sketches of both first
and by the full sets where these leave room; pairs already connected are
skipped; a task emits a spanning forest of the links it found, never pairs.
Work is thus in proportion to the members and to what stands outside the
largest part of its bucket, not to the square of a group.

At a similarity of exactly 0.75 a pair misses all 32 bands with probability
below 6e-6 and the sketch test with probability below 1e-8; no candidate is
capped or sampled.

What aggregates give is written before it is joined, so that adaptive execution
can split a hot key in the join.

Results: null or wordless text has an empty set, is linked with nothing and
is its own component.  Rows without id can't be named as a component: they
keep a null component and are kept.  Repeated rows share a class; all rows of
the smallest id stay `kept`, as the contract says.  An empty table gives no
rows; texts of any length are read whole; ties don't arise.  Other columns and
their names don't matter, the operator reads id and text only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as K
from .common import Scratch, components, likely_in
from .decontaminate import SQL_SETS, SQL_SHINGLES

BINS, ROWS = 128, 4
BANDS = BINS // ROWS
#: Least equal bins (of BINS) for a pair to be judged on the full sets, and the set size up to which sketches don't matter.
LIKELY, SMALL = 64, 64
#: Classes and shingles that one block holds on average, at most.
BLOCK, BLOCK_SHINGLES = 256, 1_000_000
#: Members of a center that one task judges, on average, at most.
CHUNK = 256

_EMPTY = np.uint64(2**64 - 1)
_SHIFT = np.uint64(64 - BINS.bit_length() + 1)
_ROW_SEEDS = K.seeds(ROWS, 5)
_BAND_SEEDS = K.seeds(BANDS, 9)


def _probe_order() -> np.ndarray:
    """For each bin, all bins in a fixed random order: where it looks for a full one."""
    return np.argsort(K.mix(np.arange(BINS * BINS, dtype=np.uint64)).reshape(BINS, BINS), axis=1)


def bin_minima(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Densified bins of each sorted set h[first[i]:first[i + 1]]; empty sets stay empty."""
    n = len(first) - 1
    row = np.repeat(np.arange(n), np.diff(first))
    cell = row * BINS + (h >> _SHIFT).astype(np.int64)
    least = np.ones(len(h), bool)
    least[1:] = cell[1:] != cell[:-1]
    found = np.full(n * BINS, _EMPTY)
    found[cell[least]] = h[least]
    found = found.reshape(n, BINS)
    full = found != _EMPTY
    dense, order = found.copy(), _probe_order()
    rows, bins = np.nonzero(~full & (np.diff(first) > 0)[:, None])
    for step in range(BINS):
        if not len(rows):
            break
        at = order[bins, step]
        hit = full[rows, at]
        dense[rows[hit], bins[hit]] = found[rows[hit], at[hit]]
        rows, bins = rows[~hit], bins[~hit]
    return dense


def band_keys(dense: np.ndarray) -> np.ndarray:
    key = np.zeros((len(dense), BANDS), np.uint64)
    for k in range(ROWS):
        key += K.mix(dense[:, k::ROWS] * _ROW_SEEDS[k])
    return K.mix(key + _BAND_SEEDS)


def _signatures(batches):
    for batch in batches:
        for part in K.pieces(batch, "text"):
            h, first = K.shingle_sets(K.words(part.column("text")))
            size = np.diff(first)
            keys = band_keys(bin_minima(h, first)).view(np.int64)
            sums = []
            for x in (h, K.mix(h ^ np.uint64(0x5851F42D4C957F2D))):
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
                sums.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
            at = np.concatenate([[0], np.cumsum(np.where(size > 0, BANDS, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("text_key"), pa.array(size, pa.int64()), pa.array(sums[0]), pa.array(sums[1]), pa.ListArray.from_arrays(pa.array(at), pa.array(keys[size > 0].ravel()))],
                names=["id", "text_key", "n_shingles", "sum_a", "sum_b", "bands"],
            )


class _Sets:
    """The sets of one chunk or pair of blocks."""

    def __init__(self, ids: np.ndarray, part: np.ndarray, side: np.ndarray, texts: pa.Array):
        parts, sizes, sketches = [], [], []
        for piece in K.pieces(pa.RecordBatch.from_arrays([texts], ["text"]), "text"):
            h, first = K.shingle_sets(K.words(piece.column(0)))
            parts.append(h)
            sizes.append(np.diff(first))
            sketches.append((bin_minima(h, first) & np.uint64(255)).astype(np.uint8))
        self.ids, self.side = ids, side
        #: Numbers of the parts that are connected beforehand.
        self.part = np.unique(part, return_inverse=True)[1]
        self.h, self.size = np.concatenate(parts), np.concatenate(sizes)
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        self.sketch = np.concatenate(sketches)

    def linked_to(self, a: int, others: np.ndarray) -> np.ndarray:
        """Of others, those with 100 * intersection >= 75 * union, by the full sets."""
        mine = self.h[self.first[a] : self.first[a + 1]]
        at = self.first[others]
        sizes = self.size[others]
        ends = np.cumsum(sizes)
        take = np.arange(ends[-1]) + np.repeat(at - (ends - sizes), sizes)
        theirs = self.h[take]
        place = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
        total = np.concatenate([[0], np.cumsum(mine[place] == theirs)])
        both = total[ends] - total[ends - sizes]
        return others[100 * both >= 75 * (len(mine) + sizes - both)]

    def forest(self, across: bool):
        """(id, id) links that connect what is connected; across: only pairs of different sides count."""
        n = len(self.ids)
        root = self.part.copy()
        for a in range(n - 1):
            b = np.arange(a + 1, n)
            small, large = np.minimum(self.size[b], self.size[a]), np.maximum(self.size[b], self.size[a])
            ok = (root[b] != root[a]) & (100 * small >= 75 * large)
            if across:
                ok &= self.side[b] != self.side[a]
            b, large = b[ok], large[ok]
            if len(b):
                b = b[(large <= SMALL) | (np.count_nonzero(self.sketch[b] == self.sketch[a], axis=1) >= LIKELY)]
            for start in range(0, len(b), 256):
                some = b[start : start + 256]
                some = some[root[some] != root[a]]
                for x in self.linked_to(a, some) if len(some) else ():
                    if root[x] != root[a]:
                        yield self.ids[a], self.ids[x]
                        root[root == root[x]] = root[a]


def _verify(batches):
    """Rows come sorted by (group, i, j); each such run is one chunk, or one pair of blocks where i and j differ."""
    keys, held = None, []

    def judged():
        t = pa.Table.from_batches(held).combine_chunks()
        ids, part, side = (t.column(c).to_numpy() for c in ("rep", "part", "block"))
        links = list(_Sets(ids, part, side, t.column("text").combine_chunks()).forest(across=keys[1] != keys[2]))
        if links:
            a, b = (np.array(x, np.int64) for x in zip(*links, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy() for c in ("group", "i", "j")]
        cut = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])) + 1
        for s, e in zip([0, *cut], [*cut, batch.num_rows], strict=True):
            now = tuple(int(c[s]) for c in cols)
            if held and now != keys:
                yield from judged()
                held = []
            keys = now
            held.append(batch.slice(s, e - s))
    if held:
        yield from judged()


def _judge(asked: DataFrame, rows: DataFrame, reps: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) among what is asked: (group, i, j, rep, part, block), one row for each member of each chunk or pair of blocks."""
    asked = scratch.store(asked)
    wanted = scratch.store(asked.select("rep").distinct().join(reps.select("rep", "text_key"), "rep"))
    needed = likely_in(rows, F.xxhash64("id", "text_key"), wanted.select(F.xxhash64("rep", "text_key").alias("key")))
    wanted = wanted.withColumnsRenamed({"rep": "of", "text_key": "of_key"})
    texts = needed.join(wanted, (needed.id == wanted.of) & (needed.text_key == wanted.of_key)).dropDuplicates(["of"]).select("of", "text")
    dealt = asked.join(texts, asked.rep == texts.of).select("group", "i", "j", "rep", "part", "block", "text")
    dealt = dealt.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j")
    return scratch.store(dealt.mapInArrow(_verify, "a long, b long"))


def _blocks(n, n_shingles, size: int | None = None):
    """How many blocks of size (or BLOCK) members and BLOCK_SHINGLES shingles on average, at most."""
    return F.greatest(F.lit(1), F.ceil(n / (size or BLOCK)), F.ceil(n_shingles / BLOCK_SHINGLES)).cast("long")


def _block(salt: int, n):
    return F.pmod(F.xxhash64(F.lit(salt), "rep"), n)


def _links(classes: DataFrame, reps: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b) that connect the classes that are linked."""
    spread = scratch.store(classes.select(F.col("rep.id").alias("rep"), "n_shingles", F.explode("bands").alias("bucket")))
    centers = scratch.store(spread.groupBy("bucket").agg(F.min("rep").alias("center"), F.count("*").alias("n")).filter("n > 1").select("bucket", "center"))
    shared = scratch.store(spread.join(centers, "bucket"))
    # 1: the star edges, by chunks of a center's members
    stars = scratch.store(shared.filter("rep != center").select("center", "rep", "n_shingles").distinct())
    sizes = scratch.store(stars.groupBy("center").agg(_blocks(F.count("*"), F.sum("n_shingles"), CHUNK).alias("n_chunks")))
    chunk = _block(1, F.col("n_chunks"))
    asked = stars.join(sizes, "center").select(F.col("center").alias("group"), chunk.alias("i"), "rep")
    heads = sizes.select(F.col("center").alias("group"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_chunks") - 1)).alias("i"), F.col("center").alias("rep"))
    asked = asked.unionByName(heads).select("group", "i", F.col("i").alias("j"), "rep", F.col("rep").alias("part"), F.lit(0).cast("long").alias("block"))
    first = _judge(asked, rows, reps, scratch)
    parts = components(first, scratch).withColumnsRenamed({"node": "of", "root": "part"})
    # 2: buckets whose members are in several parts; buckets of the same members count once
    placed = shared.join(parts, shared.rep == parts.of, "left").select("bucket", "rep", "n_shingles", F.coalesce("part", "rep").alias("part"))
    placed = scratch.store(placed)
    mixed = placed.groupBy("bucket").agg(F.min("part").alias("least"), F.max("part").alias("most"), F.count("*").alias("n"), *[F.bit_xor(F.xxhash64(F.lit(k), "rep")).alias(f"x{k}") for k in (0, 1)]).filter("least != most")
    mixed = scratch.store(mixed.groupBy("n", "x0", "x1").agg(F.min("bucket").alias("bucket")).select("bucket"))
    open_ones = scratch.store(placed.join(mixed, "bucket"))
    by_part = scratch.store(open_ones.groupBy("bucket", "part").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s")))
    most = by_part.groupBy("bucket").agg(F.max(F.struct("n", "part")).alias("m"), F.sum("n").alias("n"), F.sum("s").alias("s"))
    most = most.join(by_part.select("bucket", F.struct("n", "part").alias("m"), F.col("s").alias("main_s")), ["bucket", "m"])
    main_n = F.col("m.n")
    plan = most.select("bucket", F.col("m.part").alias("main"), _blocks(F.col("n"), F.col("s")).alias("n_all"), _blocks(F.col("n") - main_n, F.col("s") - F.col("main_s")).alias("n_out"), _blocks(main_n, F.col("main_s")).alias("n_main"))
    plan = scratch.store(plan)
    members = open_ones.join(plan, "bucket")
    zero = F.lit(0).cast("long")
    small = members.filter("n_all = 1").select(F.col("bucket").alias("group"), zero.alias("i"), zero.alias("j"), "rep", "part", zero.alias("block"))
    # blocks outside the largest part are 0 to n_out - 1, those of the largest part follow
    large = members.filter("n_all > 1").withColumn("out", F.col("part") != F.col("main"))
    own = F.when(F.col("out"), _block(2, F.col("n_out"))).otherwise(F.col("n_out") + _block(3, F.col("n_main")))
    meets = F.when(F.col("out"), F.sequence(zero, F.col("n_out") + F.col("n_main") - 1)).otherwise(F.sequence(zero, F.col("n_out") - 1))
    large = large.select("bucket", "rep", "part", own.alias("block"), F.explode(meets).alias("other"))
    large = large.select(F.col("bucket").alias("group"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "rep", "part", "block")
    return first.unionByName(_judge(small.unionByName(large), rows, reps, scratch))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, text_key, n_shingles, component_id, kept) per row; text_key is xxhash64 of the text."""
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).withColumn("text_key", F.xxhash64("text"))
    sig = scratch.store(rows.mapInArrow(_signatures, "id long, text_key long, n_shingles long, sum_a long, sum_b long, bands array<long>"))
    key = ["n_shingles", "sum_a", "sum_b"]
    named = sig.filter("n_shingles > 0 and id is not null")
    classes = named.groupBy(*key).agg(F.min(F.struct("id", "text_key")).alias("rep"), F.any_value("bands").alias("bands"))
    reps = scratch.store(named.groupBy(*key).agg(F.min(F.struct("id", "text_key")).alias("rep")).select(*key, F.col("rep.id").alias("rep"), F.col("rep.text_key").alias("text_key")))
    linked = components(_links(classes, reps, rows, scratch), scratch).withColumnsRenamed({"node": "of", "root": "component_id"})
    found = scratch.store(reps.join(linked, reps.rep == linked.of, "left").select(*key, F.coalesce("component_id", "rep").alias("component_id")))
    out = sig.drop("bands").join(found, key, "left")
    component = F.when(F.col("id").isNotNull() & (F.col("n_shingles") > 0), F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id"), "text_key", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents with one row of each group left: that of the smallest id.

    Rows that agree in id and text are one document, of which one row stays, whichever other columns it has; rows without id all stay.
    """
    found = near_duplicates(docs, id_column, text_column)
    gone = found.filter("not kept").select(F.col("id").alias("__gone_id"), F.col("text_key").alias("__gone_key")).distinct()
    keyed = docs.withColumn("__text_key", F.xxhash64(text_column))
    left = keyed.join(gone, (F.col(id_column) == F.col("__gone_id")) & (F.col("__text_key") == F.col("__gone_key")), "left_anti")
    # rows of one id and one text are one document; rows without id can't be told to be
    once = left.withColumn("__nth", F.when(F.col(id_column).isNull(), F.monotonically_increasing_id()))
    return once.dropDuplicates([id_column, "__text_key", "__nth"]).select(*docs.columns)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


ORACLE_SQL = f"""
WITH RECURSIVE d AS MATERIALIZED ({SQL_SETS.format(SQL_SHINGLES.format(id="doc_id", table="documents"))}),
     n AS MATERIALIZED (SELECT id, count(*) AS n FROM d GROUP BY id),
     links AS MATERIALIZED (
       SELECT x.id AS a, y.id AS b FROM d AS x JOIN d AS y ON x.s = y.s AND x.id <> y.id JOIN n AS p ON p.id = x.id JOIN n AS q ON q.id = y.id
       GROUP BY x.id, y.id, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))),
     reach(id, other) AS (SELECT id, id FROM n UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.other)
SELECT documents.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component, documents.doc_id) AS component_id, documents.doc_id = coalesce(c.component, documents.doc_id) AS kept
FROM documents LEFT JOIN n ON n.id = doc_id LEFT JOIN (SELECT id, min(other) AS component FROM reach GROUP BY id) AS c ON c.id = doc_id
"""
