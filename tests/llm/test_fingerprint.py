import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from mapweave.llm import fingerprint as fp


def words(t):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.fixture(scope="module")
def result(spark, docs_of):
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = [(i * 97 + 5, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([1, 3, 5, 30, 200, 900])))) for i in range(120)]
    rows += [(-4, "Straße 😀 é " * 40), (1 << 60, "same " * 3), (2 << 60, "same " * 3), (77777777, ""), (88888888, None), (99999999, " \t ")]
    docs = docs_of(rows).withColumn("id", F.lit("clash")).withColumn("key", F.lit(1)).repartition(3)
    return rows, {r.id: r for r in fp.compare_edits(docs).collect()}


def test_edits_follow_the_contract(result):
    rows, got = result
    rows = sorted(rows)
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        m = len(t) // 4
        edited = t[: len(t) - m] + nxt[:m]
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest(), i


def test_likeness_estimates_jaccard(result):
    rows, got = result
    rows = sorted(rows)
    off = []
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        m = len(t) // 4
        if shingles(t):
            off += [abs(got[i].near_edited - jaccard(t, t[: len(t) - m] + nxt[:m])), abs(got[i].near_next - jaccard(t, nxt))]
    assert sum(off) / len(off) < 0.03 and max(off) < 0.25


def test_equal_texts_and_edge_cases(result):
    _, got = result
    assert got[1 << 60].fingerprint == got[2 << 60].fingerprint != ""
    for i in (77777777, 88888888, 99999999):
        assert got[i].fingerprint == ""
    assert got[77777777].near_next == 1.0
    assert all(len(r.fingerprint) in (0, fp.BINS) for r in got.values())


def test_short_texts_are_densified_evenly(spark):
    one, seven = " ".join(f"t{i}" for i in range(5)), " ".join(f"t{i}" for i in range(11))
    df = spark.createDataFrame([(one, seven)], "a string, b string")
    df = fp.with_fingerprint(fp.with_fingerprint(df, "a", "fa"), "b", "fb")
    near = df.select(fp.likeness(F.col("fa"), F.col("fb")).alias("x")).collect()[0].x
    assert abs(near - 1 / 7) < 0.12


def test_repeated_rows_null_ids_and_empty_table(docs_of):
    docs = docs_of([(1, "a b c d e f g h"), (1, "a b c d e f g h"), (None, "a b c d"), (2, "x y")])
    rows = fp.compare_edits(docs).collect()
    assert len(rows) == 4
    assert next(r for r in rows if r.id is None).near_next is None
    assert fp.compare_edits(docs_of([])).collect() == []


def test_no_python_in_the_plan(docs_of):
    plan = fp.with_fingerprint(docs_of([(1, "a")]), "text", "f")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def plain(spark, text):
    """The fingerprint by its definition, one text at a time; hashes alone are Spark's."""
    w = words(text)
    if not w:
        return ""
    hash_of = lambda *parts: spark.sql(f"SELECT xxhash64({', '.join(parts)}) AS h").first().h
    hw = [r.h for r in spark.createDataFrame([(k, x) for k, x in enumerate(w)], "k int, w string").orderBy("k").select(F.xxhash64("w").alias("h")).collect()]
    if len(w) < 5:
        runs = [hash_of(f"array({', '.join(f'{x}L' if x != -(1 << 63) else 'bigint(\'-9223372036854775808\')' for x in hw)})", str(len(hw)))]
    else:
        rows = [(hw[i : i + 5]) for i in range(len(hw) - 4)]
        runs = [r.h for r in spark.createDataFrame(rows, "a long, b long, c long, d long, e long").select(F.xxhash64("a", "b", "c", "d", "e").alias("h")).collect()]
    bins = [None] * fp.BINS
    for x in runs:
        if x & fp._SENTINEL != fp._SENTINEL:
            b = (x >> 56) + fp.BINS // 2
            bins[b] = x if bins[b] is None else min(bins[b], x)
    full = [j for j, x in enumerate(bins) if x is not None]
    dense = [x if x is not None else bins[min(full, key=lambda j: (fp.rank(b, j), j))] for b, x in enumerate(bins)]
    low = spark.createDataFrame(list(enumerate(dense)), "b int, x long").orderBy("b").select(F.xxhash64("x", "b").bitwiseAND(F.lit(15)).alias("d")).collect()
    return "".join("0123456789abcdef"[r.d] for r in low)


def test_fingerprints_against_their_definition(spark, docs_of, result):
    rows, got = result
    ordered = sorted(rows)
    for k in (0, 3, 7, 20, 55, len(ordered) - 1):
        i, t = ordered[k]
        t, nxt = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        m = len(t) // 4
        assert got[i].fingerprint == plain(spark, t)
        assert got[i].edited_fingerprint == plain(spark, t[: len(t) - m] + nxt[:m]), i
