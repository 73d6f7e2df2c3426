import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from mapweave.llm import mixing


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_water_fill():
    assert mixing.water_fill([10, 10, 10], [5, 2, 1], 45, 2) == pytest.approx([20, 50 / 3, 25 / 3])
    assert mixing.water_fill([1, 100], [5, 2], 150, 2) == pytest.approx([2, 148])
    assert mixing.water_fill([], [], 0, 2) == []
    assert mixing.water_fill([0, 4], [5, 2], 6, 2) == [0, 6]
    assert mixing.water_fill([1, 1], [1, 1], 100, 2) == [2, 2]


def make(n, seed=1):
    rnd = random.Random(seed)
    sources = ["b", "a", "é", "Z", None, "a2"]
    return [(i, " ".join("w" for _ in range(rnd.choice([0, 1, 7, 40, 300]))) + rnd.choice(["", " \n", "\t"]), rnd.choice(sources)) for i in range(n)]


@pytest.mark.parametrize("most", [mixing.MAX_SOURCES, 2])
def test_targets_and_words_taken(spark, monkeypatch, most):
    monkeypatch.setattr(mixing, "MAX_SOURCES", most)
    rows = make(3000) + [(None, "x y", "a"), (-1, None, "b"), (-2, "", None), (5000, "z " * 9, "only")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("path", F.lit(0)).repartition(4)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    total, largest = defaultdict(int), defaultdict(int)
    for i, t, s in rows:
        total[s] += size(t)
        largest[s] = max(largest[s], size(t))
    order = sorted(total, key=lambda s: (s is None, s or ""))
    # brute force: clamp and reshare until nothing is above its cap
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left, free = {}, 1.5 * sum(total.values()), set(order)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * total[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2 * total[s]
            left -= target[s]
            free.remove(s)
    taken = defaultdict(int)
    for r in got:
        taken[r.source] += r.taken
        assert r.size == size(r.text) and r.source_size == total[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken <= 2 * r.size and r.taken == r.repetitions * r.size
    for s in order:
        assert abs(taken[s] - target[s]) <= largest[s], (s, taken[s], target[s])
    again = mixing.mix(docs.repartition(2)).collect()
    assert sorted((r.doc_id or 0, r.taken) for r in again) == sorted((r.doc_id or 0, r.taken) for r in got)
    assert mixing.repeated(mixing.mix(docs)).count() == sum(r.repetitions for r in got)


def test_empty_table_and_repeated_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(docs).collect() == []
    docs = spark.createDataFrame([(1, "a b c", "s")] * 50 + [(2, "d", "t")], "doc_id long, text string, source string")
    rows = mixing.mix(docs).collect()
    assert len(rows) == 51 and len({r.taken for r in rows if r.doc_id == 1}) == 1


def test_many_sources_give_the_same_mix_by_either_way(spark, monkeypatch):
    rnd = random.Random(4)
    rows = [(i, "w " * rnd.choice([1, 5, 60]), f"s{rnd.randrange(400)}" if rnd.random() < 0.7 else "hot") for i in range(3000)] + [(-1, "v " * 900000, "long"), (-2, None, "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    result = lambda: sorted((r.doc_id, r.source_size, round(r.target, 6), r.taken) for r in mixing.mix(docs).collect())
    small = result()
    monkeypatch.setattr(mixing, "MAX_SOURCES", 10)
    assert result() == small and len(small) == len(rows)
