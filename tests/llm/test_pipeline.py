import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from mapweave.llm import decontaminate as dc
from test_line_dedup import brute as brute_lines
from test_near_dedup import brute as brute_near


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rnd = random.Random(12)
    folder = str(tmp_path_factory.mktemp("sf"))
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 9))) for _ in range(3000)]
    sentence = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n)) + "."
    items = [(k, sentence(30)) for k in range(5)]
    passage = sentence(60)
    docs, labels = [], []
    for i in range(400):
        lines = [sentence(rnd.randrange(12, 30)) for _ in range(rnd.randrange(2, 5))]
        good = i % 4 != 0
        if not good:
            lines = [" ".join(w.upper() + "!!" for w in x.split()) for x in lines]
        if good and i % 20 == 1:
            lines.insert(1, passage)
        if good and i % 30 == 2:
            lines.append(rnd.choice(items)[1])
        docs.append((i, "\n".join(lines), rnd.choice(["en", None]), f"src{i % 3}" if i % 50 else None))
        labels.append((i, int(good), i % 2))
    for k in range(12):  # near copies, each of another document
        words = docs[100 + 4 * k + 1][1].split(" ")
        words[3] = "edited"
        docs.append((1000 + k, " ".join(words), "en", "src0"))
    docs += [(2000, None, None, None), (2001, "", "en", "src1"), docs[5]]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    df.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, items, passage


def test_each_stage_against_brute_force(spark, tables):
    folder, items, passage = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet").cache()
    columns = docs.columns
    rows = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    order = lambda x: sorted(x, key=str)

    kept = cp.quality_classifier(spark, docs, folder).cache()
    assert kept.columns == columns
    have = {i for i, _ in rows(kept)}
    assert {i for i in range(400) if i % 4} <= have and not {i for i in range(400) if i % 4 == 0} & have

    before = rows(kept)
    lines = cp.line_deduplication(spark, kept, folder).cache()
    assert lines.columns == columns
    want = [(i, t) for (i, was), (_, t, n) in zip(before, brute_lines(before), strict=True) if not n or t is not None]
    assert order(rows(lines)) == order(want) and sum(passage in (t or "") for _, t in want) == 1
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in lines.collect())

    before = rows(lines)
    near = cp.near_deduplication(spark, lines, folder).cache()
    assert near.columns == columns
    kept_ids = {x[0] for x in brute_near(before) if x[3]}
    assert order(rows(near)) == order({(i, t) for i, t in before if i in kept_ids})

    clean = cp.benchmark_decontamination(spark, near, folder).cache()
    assert clean.columns == columns

    def leaks(text):
        have = dc.word_shingles(text)
        return any(100 * len(dc.word_shingles(x) & have) >= 75 * len(dc.word_shingles(x)) for _, x in items)

    assert order(rows(clean)) == order([(i, t) for i, t in rows(near) if not leaks(t)]) and clean.count() < near.count()

    mixed = cp.source_mixing(spark, clean, folder)
    assert order(rows(mixed)) == order(rows(clean)) and {"target", "taken", "repetitions"} <= set(mixed.columns)


def test_run_is_the_stages_in_order(spark, tables):
    folder, _, _ = tables
    assert [n for n, _ in cp.STAGES] == ["quality_classifier", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "source_mixing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, folder)
    want = sorted((r.doc_id, r.taken) for r in docs.collect() if r.doc_id is not None)
    assert sorted((r.doc_id, r.taken) for r in cp.run(spark, folder).collect() if r.doc_id is not None) == want


def test_last_stage_carries_the_mix_out(spark):
    """300 words in three sources of ten documents of 10 words: targets 200 (its cap), 166.7 and 83.3."""
    docs = [(100 * k + i, "w " * 10, s) for k, s in enumerate("abc") for i in range(10)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = Counter(r.doc_id for r in cp.STAGES[-1][1](spark, df, "").collect())
    times = lambda k: sorted(got[100 * k + i] for i in range(10))
    assert times(0) == [2] * 10 and times(1) == [1] * 3 + [2] * 7 and times(2) == [0] * 2 + [1] * 8
    assert got == Counter({r.doc_id: r.repetitions for r in cp.source_mixing(spark, df, "").collect() if r.repetitions})


def test_empty_tables_go_through_every_stage(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    folder = str(tmp_path)
    spark.createDataFrame([], schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert cp.run(spark, folder).collect() == []


def test_nulls_and_odd_texts_go_through_every_stage(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    folder = str(tmp_path)
    rows = [(None, None, None, None, None), (1, None, "en", "a", None), (2, "", None, "a", 0), (3, " \n\t", "en", None, 3), (4, "x " * 200000, "en", "a", 400000), (None, "no id but some words of text", "en", "b", 28), (5, "a\x00b \u2028 é", "fr", "b", 8), (5, "a\x00b \u2028 é", "fr", "b", 8)]
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "some item that nothing holds at all")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = Counter(r.doc_id for r in cp.run(spark, folder).collect())
    assert got[4] >= 1 and got[5] <= 2
