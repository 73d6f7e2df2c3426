"""Benchmark decontamination: size-partitioned MinHash containment search.

A test item with q distinct shingles (`textkernel`: five words) is contained in
a document that has 75% of them or more.  An item of one to four words is
contained where its words stand in a row.  The Jaccard similarity of a short
item and a long document is tiny, so fixed signatures of both sides would miss
it.  Instead each item keeps a bottom-k MinHash sketch, its k least shingle
hashes, and the document is asked for all of its own.

Items are partitioned by size, [2^(p-1), 2^p) shingles a partition, and k goes
by the partition: an item of the partition's greatest size may lack
2^p - 1 - ceil(0.75 (2^p - 1)) shingles, and k is that and SPARE[p] more.  A
document that contains an item of q shingles thus holds at least
min(k, q) - (q - ceil(0.75 q)) values of its sketch, one for the least items
and more for the larger ones, which spares verifications.  The search loses
nothing.

Candidates are verified by exact containment: first the item's whole hash set
against the document's, then the word sequences themselves.

A benchmark of BLOCK_BYTES of text or less is broadcast as one index, and
documents are read in one pass that shuffles nothing.  A larger one isn't:
a bitmap of its sketches of 2^MOST_BITS bits at most is broadcast, documents
send the shingles that it lets through, these are joined with the sketches,
and the texts of candidates alone are joined with the items' for verification.
Both ways give the same rows.

Null or wordless texts contain and are contained in nothing.  Equal items of
one id count once, also if the id is null; items without id are reported with
null.  Repeated documents are reported each.  Empty tables give no rows.
Ties don't arise: every item that is contained is reported.  Texts of any
length are read whole.  Documents pass through with all their columns,
whatever their names.

`drop_contaminated` drops documents that contain an item of five words or
more, or whose words are just those of a shorter item: a phrase of up to four
words stands in clean text by chance.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as K
from .common import Scratch, likely_in

SHARE = 75
BLOCK_BYTES = 8 << 20
_BITS, MOST_BITS = 20, 30

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: str) -> list[str]:
    return _WORD.findall((text or "").translate(_FOLD))


def word_shingles(text: str) -> set[tuple[str, ...]]:
    words, n = words_of(text), K.SHINGLE
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} - {()}


def _missing(q: int) -> int:
    """Shingles that a text which contains an item of q may lack."""
    return q - -(-q * SHARE // 100)


def sketch_size(q: int) -> int:
    """k of the partition that items of q shingles are in."""
    p = q.bit_length()
    return _missing((1 << p) - 1) + max(1, min(4, p - 3))


def needed(q: int) -> int:
    """Values of its sketch that a text which contains an item of q shingles holds."""
    return min(sketch_size(q), q) - _missing(q)


class Index:
    """Sketches and whole sets of items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.texts = [i for i, _ in items], [t for _, t in items]
        w = K.words(pa.array(self.texts, pa.string()))
        n_words = np.diff(w.first)
        self.h, self.first = K.shingle_sets(w)
        self.size = np.diff(self.first)
        #: Numbers of words of the items that are shorter than a shingle.
        self.short = sorted(set(n_words[(n_words > 0) & (n_words < K.SHINGLE)].tolist()))
        self.need = np.array([needed(int(q)) if q else 1 for q in self.size], np.int64)
        self.tables = []
        self.bitmap = np.zeros(1 << _BITS, bool)
        parts = np.array([int(q).bit_length() for q in self.size])
        for part in np.unique(parts[self.size > 0]):
            keys, owners = [], []
            for item in np.flatnonzero(parts == part):
                keys.append(self.h[self.first[item] : self.first[item] + min(sketch_size(int(self.size[item])), int(self.size[item]))])
                owners.append(np.full(len(keys[-1]), item))
            keys, owners = np.concatenate(keys), np.concatenate(owners)
            order = np.argsort(keys, kind="stable")
            self.tables.append((keys[order], owners[order]))
            self.bitmap[keys >> np.uint64(64 - _BITS)] = True

    def candidates(self, rows: np.ndarray, h: np.ndarray):
        """Distinct (row, item) of which the row holds enough values of the item's sketch."""
        near = self.bitmap[h >> np.uint64(64 - _BITS)]
        rows, h = rows[near], h[near]
        order = np.lexsort((h, rows))
        rows, h = rows[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
        rows, h = rows[new], h[new]
        found = [np.zeros(0, np.int64)]
        for keys, owners in self.tables:
            low, high = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
            n = high - low
            hit = n > 0
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n[hit]) - n[hit], n[hit]) + np.repeat(low[hit], n[hit])
            found.append(np.repeat(rows[hit], n[hit]) * len(self.ids) + owners[at])
        pairs, hits = np.unique(np.concatenate(found), return_counts=True)
        row, item = pairs // max(1, len(self.ids)), pairs % max(1, len(self.ids))
        enough = hits >= self.need[item] if len(item) else np.zeros(0, bool)
        return row[enough], item[enough]

    def search(self, texts: pa.Array):
        """(row, item, shared) of every item contained in a text."""
        rows, h = _hashes(texts, self.short)
        doc, item = self.candidates(rows, h)
        last, own, text = -1, None, None
        for d, i in zip(doc.tolist(), item.tolist(), strict=True):
            if d != last:
                last, text = d, Spelled(texts[d].as_py())
                own = np.unique(h[np.searchsorted(rows, d) : np.searchsorted(rows, d, "right")])
            whole = self.h[self.first[i] : self.first[i + 1]]
            place = np.minimum(np.searchsorted(own, whole), len(own) - 1)
            if 100 * np.count_nonzero(own[place] == whole) >= SHARE * len(whole):
                shared, size = text.shared(self.texts[i])
                if 100 * shared >= SHARE * size:
                    yield d, i, shared

    def short_item(self, i: int) -> bool:
        return len(words_of(self.texts[i])) < K.SHINGLE


def _hashes(texts: pa.Array, short: list[int]):
    """(row, hash) of all shingles of each text, and of its runs of few words as far as items have them; by row."""
    w = K.words(texts)
    parts = [K.shingles(w), *(K.runs(w, n) for n in short)]
    rows, h = (np.concatenate(x) for x in zip(*parts, strict=True))
    if (np.diff(rows) < 0).any():
        order = np.argsort(rows, kind="stable")
        rows, h = rows[order], h[order]
    return rows, h


class Spelled:
    """The word sequences of one text."""

    def __init__(self, text: str):
        self.words, self.sets = words_of(text), {}

    def runs(self, n: int) -> set:
        if n not in self.sets:
            self.sets[n] = {tuple(self.words[i : i + n]) for i in range(len(self.words) - n + 1)}
        return self.sets[n]

    def shared(self, item: str) -> tuple[int, int]:
        """(shared, all) shingles of an item."""
        wanted = word_shingles(item)
        return len(wanted & self.runs(len(next(iter(wanted))))), len(wanted)


_FOUND = "id long, item_id long, item_shingles long, shared_shingles long"


def _items(benchmark: DataFrame, item_column: str, text_column: str) -> DataFrame:
    return benchmark.select(F.col(item_column).cast("long").alias("item"), F.col(text_column).alias("text")).filter("text is not null").distinct()


def _index(items: DataFrame) -> Index | None:
    """The index of a small benchmark; None where it is larger than BLOCK_BYTES."""
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    if total > BLOCK_BYTES:
        return None
    rows = sorted(items.collect(), key=lambda r: (r.item is None, r.item or 0, r.text))
    return Index([(r.item, r.text) for r in rows])


def _sketches(batches):
    for batch in batches:
        w = K.words(batch.column("text"))
        h, first = K.shingle_sets(w)
        size = np.diff(first)
        k = np.array([min(sketch_size(int(q)), int(q)) if q else 0 for q in size], np.int64)
        at = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(first[:-1], k)
        row = np.repeat(np.arange(len(k)), k)
        n_words = np.diff(w.first)
        rest = [pa.array(x[row], pa.int64()) for x in (np.array([needed(int(q)) if q else 1 for q in size], np.int64), np.where(n_words < K.SHINGLE, n_words, 0))]
        yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), batch.column("item_key").take(pa.array(row)), *rest], names=["key", "item_key", "need", "short"])


def _large_search(rows: DataFrame, items: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, text_key, item_id, item_shingles, shared_shingles, short) for distinct texts of an id; nothing but a bitmap is broadcast."""
    spark = rows.sparkSession
    items = scratch.store(items.withColumn("item_key", F.xxhash64("item", "text")))
    sketches = scratch.store(items.mapInArrow(_sketches, "key long, item_key long, need long, short long"))
    n_keys = sketches.count()
    bits = min(MOST_BITS, max(15, (16 * n_keys).bit_length()))
    spot = F.shiftrightunsigned("key", 64 - bits) + 1
    maps = sketches.groupBy(F.bitmap_bucket_number(spot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("map"))
    bitmap = np.zeros((1 << bits) // 8, np.uint8)
    for r in maps.toLocalIterator():  # of a size fixed by `bits`
        part = np.frombuffer(r.map, np.uint8)
        bitmap[(r.bucket - 1) * 4096 : (r.bucket - 1) * 4096 + len(part)] = part
    short = [r.short for r in sketches.filter("short > 0").select("short").distinct().collect()]
    shared = spark.sparkContext.broadcast(bitmap)

    def near(batches):
        for batch in batches:
            for part in K.pieces(batch, "text"):
                row, h = _hashes(part.column("text"), short)
                at = (h >> np.uint64(64 - bits)).astype(np.int64)
                some = (shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
                row, h = row[some], h[some]
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(row)), part.column("text_key").take(pa.array(row)), pa.array(h.view(np.int64))], names=["id", "text_key", "key"])

    hits = rows.mapInArrow(near, "id long, text_key long, key long").distinct().join(sketches, "key")
    pairs = hits.groupBy("id", "text_key", "item_key").agg(F.count("*").alias("n"), F.first("need").alias("need")).filter("n >= need").select("id", "text_key", "item_key")
    pairs = scratch.store(pairs)
    wanted = likely_in(rows, F.xxhash64("id", "text_key"), pairs.select(F.xxhash64("id", "text_key").alias("key"))).dropDuplicates(["id", "text_key"])
    spelled = pairs.join(items.withColumnsRenamed({"text": "item_text", "item": "item_id"}), "item_key").withColumnsRenamed({"id": "of_id", "text_key": "of_key"})
    both = wanted.join(spelled, wanted.id.eqNullSafe(spelled.of_id) & (wanted.text_key == spelled.of_key)).select("id", "text_key", "item_id", "text", "item_text")

    def verify(batches):
        last, text = None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if last is None or r["text"] != last:
                    last, text = r["text"], Spelled(r["text"])
                n, size = text.shared(r["item_text"])
                if 100 * n >= SHARE * size:
                    out.append((r["id"], r["text_key"], r["item_id"], size, n, len(words_of(r["item_text"])) < K.SHINGLE))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.bool_() if k == 5 else pa.int64()) for k in range(6)], names=["id", "text_key", "item_id", "item_shingles", "shared_shingles", "short"])

    return scratch.store(both.mapInArrow(verify, f"id long, text_key long, {_FOUND.partition(', ')[2]}, short boolean"))


def contained_items(docs: DataFrame, benchmark: DataFrame, id_column="doc_id", text_column="text", item_column="item_id", item_text_column="text") -> DataFrame:
    """(id, item_id, item_shingles, shared_shingles) of every item contained in a document."""
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    items = _items(benchmark, item_column, item_text_column)
    ix = _index(items)
    if ix is None:
        rows = rows.withColumn("text_key", F.xxhash64("text"))
        found = _large_search(rows, items, Scratch(docs.sparkSession, "decontaminate"))
        times = likely_in(rows, F.xxhash64("id", "text_key"), found.select(F.xxhash64("id", "text_key").alias("key"))).groupBy("id", "text_key").count()
        times = times.withColumnsRenamed({"id": "of_id", "text_key": "of_key"})
        out = found.join(times, found.id.eqNullSafe(times.of_id) & (found.text_key == times.of_key))
        return out.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), "count"))).select("id", "item_id", "item_shingles", "shared_shingles")
    index = docs.sparkSession.sparkContext.broadcast(ix)

    def search(batches):
        ix = index.value
        for batch in batches:
            for part in K.pieces(batch, "text"):
                hits = list(ix.search(part.column("text")))
                ids = part.column("id").take(pa.array([d for d, _, _ in hits], pa.int64()))
                rest = [[ix.ids[i] for _, i, _ in hits], [int(ix.size[i]) for _, i, _ in hits], [s for _, _, s in hits]]
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in rest)], names=["id", "item_id", "item_shingles", "shared_shingles"])

    return rows.mapInArrow(search, _FOUND)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_column="doc_id", text_column="text", item_column="item_id", item_text_column="text") -> DataFrame:
    """The documents that contain no item of five words or more and aren't a shorter one."""
    items = _items(benchmark, item_column, item_text_column)
    ix = _index(items)
    if ix is None:
        rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"), F.xxhash64(text_column).alias("text_key"))
        found = _large_search(rows, items, Scratch(docs.sparkSession, "decontaminate"))
        long_ones = found.filter("not short").select(F.col("id").alias("__id"), F.col("text_key").alias("__key")).distinct()
        left = docs.join(long_ones, F.col(id_column).cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(text_column) == F.col("__key")), "left_anti")
        # what is just a short item is told by its folded words
        plain = lambda c: F.trim(F.regexp_replace(F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]+", " "))
        few = items.select(plain(F.col("text")).alias("__words")).filter(f"__words != '' and size(split(__words, ' ')) < {K.SHINGLE}").distinct()
        return left.join(few, plain(F.col(text_column)) == F.col("__words"), "left_anti").select(*docs.columns)
    index = docs.sparkSession.sparkContext.broadcast(ix)

    def clean(batches):
        ix = index.value
        for batch in batches:
            for part in K.pieces(batch, text_column):
                texts = part.column(text_column)
                keep = np.ones(part.num_rows, bool)
                keep[[d for d, i, _ in ix.search(texts) if not ix.short_item(i) or words_of(texts[d].as_py()) == words_of(ix.texts[i])]] = False
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(clean, docs.schema)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contained_items(docs, benchmark).withColumnRenamed("id", "doc_id")


SQL_SHINGLES = r"""
  SELECT {id} AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM {table}
"""
SQL_SETS = """
  SELECT DISTINCT id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                             WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM ({0})
"""
#: Beside the sets, the documents' runs of as many words as items of one to four words have.
ORACLE_SQL = f"""
WITH dw AS ({SQL_SHINGLES.format(id="doc_id", table="documents")}),
     iw AS ({SQL_SHINGLES.format(id="item_id", table="benchmark")}),
     few AS (SELECT DISTINCT len(ws) AS k FROM iw WHERE len(ws) BETWEEN 1 AND 4),
     d AS ({SQL_SETS.format("FROM dw").replace("(FROM dw)", "dw")}
           UNION SELECT id, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) FROM dw CROSS JOIN few WHERE len(ws) >= k),
     i AS ({SQL_SETS.format("FROM iw").replace("(FROM iw)", "iw")}),
     n AS (SELECT id, count(*) AS n FROM i GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, any_value(n.n) AS item_shingles, count(*) AS shared_shingles
FROM d JOIN i USING (s) JOIN n ON n.id = i.id GROUP BY d.id, i.id HAVING 100 * count(*) >= 75 * any_value(n.n)
"""
