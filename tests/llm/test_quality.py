import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mapweave.llm import quality as q


def make(n=900, seed=1):
    rnd = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 9))) for _ in range(rnd.randrange(5, 120))]
        good = rnd.random() < 0.7
        if not good:
            kind = rnd.randrange(3)
            words = [w.upper() + "!!" for w in words] if kind == 0 else [w + "###" for w in words] if kind == 1 else [w for w in words[:4] for _ in range(20)]
        docs.append((i, " ".join(words) + "."))
        labels.append((i, int(good), rnd.randrange(2)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = make()
    docs += [(5000, None), (5001, ""), (None, "a b c"), (3, docs[3][1]), (5002, "long " * 60000)]
    labels += [(5000, None, 0), (6000, 1, 0), (7, 0, 0), (7, 1, 0), (None, 1, 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("upper", F.lit(1)).repartition(3)
    return docs, labels, d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_defined_edges(tables):
    docs, labels, d, lab = tables
    model = q.fit(d, lab)
    assert 0 < len(model.rules) < 100
    rows = q.score_quality(d, model, name="p").collect()
    assert len(rows) == len(docs) and all(0 <= r.p <= 1 for r in rows)
    truth = {i: y for i, y, _ in labels if i is not None and i < 900 and i != 7}
    held = [r for r in rows if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([(r.p >= 0.5) == truth[r.doc_id] for r in held]) > 0.97
    assert next(r.p for r in rows if r.doc_id == 5000) == next(r.p for r in rows if r.doc_id == 5001)
    left = q.drop_low_quality(d, lab)
    assert left.columns == d.columns and {r.doc_id for r in left.collect()} == {r.doc_id for r in rows if r.p >= 0.5}


def test_compiled_rules_equal_the_model(tables):
    _, _, d, lab = tables
    model = q.fit(d, lab)
    rows = q.with_statistics(d, "text").withColumn("p", model.score()).collect()
    x = np.array([[r[f"__s_{k}"] for k in q.STATISTICS] for r in rows])
    assert np.allclose([r.p for r in rows], 1 / (1 + np.exp(-model.logit(x))))


def by_hand(t):
    """The statistics of one text in plain Python."""
    t = t or ""
    w = re.split(r"[\x20\x09-\x0D]+", t.strip(" \t\n\x0b\f\r"))
    lines, n = t.split("\n"), len(t)
    share = lambda x, of: x / of if of else 0.0
    return [
        math.log1p(n), share(n, len(w)), share(len(set(w)), len(w)), share(sum(a == b for a, b in zip(w, w[1:], strict=False)), len(w)), share(len(set(lines)), len(lines)), math.log1p(share(n, len(lines))),
        share(len(re.findall("[A-Z]", t)), n), share(len(re.findall("[0-9]", t)), n), share(len(re.findall(r"[#$%&*+/<=>@^_`{|}~\[\]\\]", t)), n), *(share(t.count(c), len(w)) for c in "!.,|"),
    ]


def test_scores_against_brute_force(tables):
    """Every score from the texts alone: statistics, rules and weights worked out one document at a time."""
    docs, _, d, lab = tables
    model = q.fit(d, lab)
    want = []
    for i, t in docs:
        x = by_hand(t)
        logit = model.bias + sum(w for r, w in model.rules if all((x[k] > at) == above for k, above, at in r.tests))
        want.append((str(i), len(t or ""), round(1 / (1 + math.exp(-logit)), 9)))
    got = [(str(r.doc_id), len(r.text or ""), round(r.p, 9)) for r in q.score_quality(d, model, name="p").collect()]
    assert sorted(got) == sorted(want)


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in q.op1(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    model = q.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    assert len(rows) == len(docs)
    for d in docs:
        x = by_hand(d.text)
        logit = model.bias + sum(w for r, w in model.rules if all((x[k] > at) == above for k, above, at in r.tests))
        r = rows[d.doc_id]
        assert r.score == pytest.approx(1 / (1 + math.exp(-logit))) and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(d.doc_id).encode()) % 3 == 1)


def test_weights_are_at_the_minimum():
    """No weight can be moved to a lower penalised loss: the gradient is within the penalty, and meets it where a weight isn't zero."""
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(3000, len(q.STATISTICS)))
    y = (x[:, 0] + 0.5 * x[:, 3] + rnd.normal(size=3000) > 0).astype(float)
    model = q.fit_rules(x, y)
    off = 1 / (1 + np.exp(-model.logit(x))) - y
    assert model.rules and abs(off.mean()) < 2e-3
    for r, w in model.rules:
        assert np.mean(off * r.holds(x)) + q.PENALTY * np.sign(w) == pytest.approx(0, abs=2e-3)


def test_learns_from_no_held_out_label(tables):
    _, labels, d, lab = tables
    flipped = lab.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert q.fit(d, flipped) == q.fit(d, lab)
    assert q.fit(d, lab, max_rows=200) == q.fit(d.repartition(2), lab, max_rows=200)


def test_without_labels_or_documents(spark, tables):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    _, _, d, lab = tables
    assert {r.p for r in q.score_quality(d, q.fit(d, none), name="p").collect()} == {0.5}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert q.score_quality(empty, q.fit(empty, lab)).collect() == []
    one = lab.withColumn("quality", F.lit(1))
    assert min(r.p for r in q.score_quality(d, q.fit(d, one), name="p").collect()) > 0.99


def test_statistics_by_hand(spark):
    r = q.with_statistics(spark.createDataFrame([("Ab ab ab 12!\nx|y #",)], "t string"), "t").collect()[0]
    assert r["__s_distinct_words"] == pytest.approx(5 / 6)
    assert r["__s_repeated_words"] == pytest.approx(1 / 6) and r["__s_upper"] == pytest.approx(1 / 18) and r["__s_symbols"] == pytest.approx(2 / 18)
