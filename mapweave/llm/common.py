"""Scratch tables in the folder that driver and executors share, and connected components."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}

#: The characters that part words, as a Java character class body.
BLANK = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, one temporary folder of this process, in local mode alone."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if "dir" not in _own:
            _own["dir"] = tempfile.mkdtemp(prefix="scratch-")
        found = _own["dir"]
    return found


class Scratch:
    """Written tables of one run.  They cut lineage and outlive the loss of executors.

    They go when `clear` is called, or with the process: what reads them is lazy.
    """

    open: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        Scratch.open.append(self)

    def store(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def store_bucketed(self, df: DataFrame, column: str, n: int) -> DataFrame:
        """As store; joins and groups by the column read the table without an exchange."""
        self.n += 1
        name = f"scratch_{uuid.uuid4().hex}"
        df.write.bucketBy(n, column).option("path", f"{self.root}/{self.n}").saveAsTable(name)
        try:
            return self.spark.table(name)
        finally:
            self.spark.sql(f"DROP TABLE {name}")  # the name alone: the files are outside the catalog

    def clear(self) -> None:
        """Delete the tables; nothing may read them any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
        if self in Scratch.open:
            Scratch.open.remove(self)

    @classmethod
    def clear_since(cls, n: int) -> None:
        """Delete the tables of all runs begun since n were open."""
        for one in cls.open[n:]:
            one.clear()


@atexit.register
def _clear_all() -> None:
    for one in list(Scratch.open):
        with contextlib.suppress(Exception):  # the session may be gone
            one.clear()
    if "dir" in _own:
        shutil.rmtree(_own["dir"], ignore_errors=True)


def fold(text):
    """Lower-case A-Z alone."""
    return F.translate(text, UPPER, LOWER)


def bound(value, body):
    """body(value), with value worked out once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


#: Bits of the bitmap of likely_in, at most: 32 MB.
MOST_BITS = 28


def likely_in(df: DataFrame, key, keys: DataFrame, inside: bool = True, bits: int | None = None) -> DataFrame:
    """The rows of df whose hash key (a long column expression) may be among keys.key: a filter ahead of a shuffle.

    With inside=False the rows that surely aren't, which are all others.  A
    bitmap with 16 bits a key, up to 2**MOST_BITS bits, is broadcast in rows
    of 4 KB, so its size is bounded however many keys there are.  Rows are
    let through without need as it fills up, but none is lost.
    """
    if bits is None:
        bits = min(MOST_BITS, max(15, (16 * keys.count()).bit_length()))
    spot = lambda c: F.pmod(c, F.lit(1 << bits)) + 1
    maps = keys.select(spot(F.col("key")).alias("spot")).groupBy(F.bitmap_bucket_number("spot").alias("__bucket"))
    maps = maps.agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("__map"))
    at = F.bitmap_bit_position(spot(key))
    byte = F.conv(F.hex(F.substring(F.col("__map"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    found = df.join(F.broadcast(maps), (F.bitmap_bucket_number(spot(key)) == F.col("__bucket")) & (F.getbit(byte, (at % 8).cast("int")) == 1), "inner" if inside else "left_anti")
    return found.drop("__bucket", "__map") if inside else found


def crc_mod(column, n: int):
    """crc32 of the value as text, modulo n; null for null."""
    return F.crc32(F.col(column).cast("string")) % n


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of undirected edges (a, b); root is the smallest node reachable.

    Contraction: each node points at its smallest smaller neighbour; pointers
    are doubled until they end at nodes without a smaller neighbour; edges are
    renamed by them and shrink until none is left.  A round at least halves
    the nodes of a component, and doubling takes the logarithm of the longest
    path, so sorted chains end as soon as stars.  The smallest node of a
    component is never renamed, so it is what remains.  Each step is a join of
    the edges still left and is written, so lost executors cost one step.
    """
    e = scratch.store(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).filter("u < v").distinct())
    labels = scratch.store(e.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    labels = labels.withColumn("root", F.col("node"))
    while not e.isEmpty():
        up = e.groupBy("v").agg(F.min("u").alias("p"))
        jump = scratch.store(up.select(F.col("v").alias("was"), F.col("p").alias("now"), F.lit(True).alias("moved")))
        while not jump.filter("moved").isEmpty():
            far = jump.select(F.col("was").alias("now"), F.col("now").alias("then"))
            jump = scratch.store(jump.join(far, "now", "left").select("was", F.coalesce("then", "now").alias("now"), F.col("then").isNotNull().alias("moved")))
        jump = jump.drop("moved")
        e = (
            e.join(jump.withColumnsRenamed({"was": "u", "now": "nu"}), "u", "left")
            .join(jump.withColumnsRenamed({"was": "v", "now": "nv"}), "v", "left")
            .select(F.coalesce("nu", "u").alias("a"), F.coalesce("nv", "v").alias("b"))
            .select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
            .filter("u < v")
            .distinct()
        )
        e = scratch.store(e)
        labels = scratch.store(labels.join(jump, labels.root == jump.was, "left").select("node", F.coalesce("now", "root").alias("root")))
    return labels
