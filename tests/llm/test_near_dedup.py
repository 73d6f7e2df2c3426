import random

import pytest
from pyspark.sql import functions as F

from mapweave.llm import near_dedup as nd
from mapweave.llm.common import Scratch, components
from mapweave.llm.decontaminate import word_shingles


def brute(rows):
    """(id, set size, component, kept) by comparing all pairs."""
    sets = {}
    for i, t in rows:
        if i is not None and word_shingles(t):
            sets.setdefault(frozenset(word_shingles(t)), []).append(i)
    keys = list(sets)
    root = list(range(len(keys)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(keys)):
        for b in range(a):
            both = len(keys[a] & keys[b])
            if 100 * both >= 75 * (len(keys[a]) + len(keys[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for k, s in enumerate(keys):
        least[find(k)] = min([least.get(find(k), 1 << 62), *sets[s]])
    by_set = {s: least[find(k)] for k, s in enumerate(keys)}
    out = []
    for i, t in rows:
        s = frozenset(word_shingles(t))
        c = by_set[s] if s and i is not None else i
        out.append((i, len(s), c, True if i is None else i == c))
    return sorted(out, key=str)


def make(seed=11):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    rows, i = [], 1000
    for _ in range(40):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([2, 6, 8, 12, 60, 300]))]
        for _ in range(rnd.choice([1, 2, 3, 12])):
            words = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 6])):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            rows.append((i - rnd.randrange(2) * 500, " ".join(words).replace("w1", "W1" if rnd.random() < 0.3 else "w1")))
            i += 1
    # a chain: each is near the next one only
    words = [f"c{k}" for k in range(80)]
    for k in range(30):
        rows.append((5000 - k, " ".join(words)))
        words[2 * k : 2 * k + 1] = [f"d{k}"]
    rows += [(9000, None), (9001, ""), (9002, " \n"), (None, rows[0][1]), (None, None), rows[3], rows[3], (9003, "one"), (9004, "ONE"), (9005, "x y " * 30000)]
    return rows


@pytest.mark.parametrize("block", [nd.BLOCK, 3])
def test_against_all_pairs(docs_of, monkeypatch, block):
    monkeypatch.setattr(nd, "BLOCK", block)
    monkeypatch.setattr(nd, "CHUNK", min(block, nd.CHUNK))
    rows = make()
    docs = docs_of(rows).withColumn("id", F.lit("clash")).withColumn("rep", F.lit(1)).repartition(4)
    got = sorted(((r.id, r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(docs).collect()), key=str)
    assert got == brute(rows)


def test_one_document_of_each_group_stays(docs_of):
    rows = make(3)
    docs = docs_of(rows).withColumn("id", F.lit("clash"))
    left = nd.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    kept = {x[0] for x in brute(rows) if x[3]}
    got = [(r.doc_id, r.text) for r in left.collect()]
    named = [x for x in got if x[0] is not None]
    assert {i for i, _ in named} == kept - {None} and len(named) == len(set(named)) and set(named) <= {x for x in rows if x[0] in kept}
    assert sorted(map(str, (x for x in got if x[0] is None))) == sorted(map(str, (x for x in rows if x[0] is None)))


@pytest.mark.parametrize("block", [nd.BLOCK, 4])
def test_parts_that_share_buckets(docs_of, monkeypatch, block):
    """A large part around a center, a second part and single texts in its buckets that the center isn't like, in blocks of any size."""
    monkeypatch.setattr(nd, "BLOCK", block)
    monkeypatch.setattr(nd, "CHUNK", min(block, nd.CHUNK))
    rnd = random.Random(9)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for i in range(40):  # near the base
        words = list(base)
        words[rnd.randrange(60)] = f"x{i}"
        rows.append((100 + i, " ".join(words)))
    for i in range(12):  # near one another, and to the base in part
        words = base[:36] + [f"y{k}" for k in range(24)]
        words[40 + rnd.randrange(20)] = f"z{i}"
        rows.append((200 + i, " ".join(words)))
    for i in range(10):
        rows.append((300 + i, " ".join(base[:45] + [f"w{i}_{k}" for k in range(15)])))
    got = sorted(((r.id, r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(docs_of(rows).repartition(3)).collect()), key=str)
    assert got == brute(rows)


def test_empty_table_and_components(spark, docs_of):
    assert nd.near_duplicates(docs_of([])).collect() == []
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 60)] + [(100, 200), (300, 200), (7, 7)], "a long, b long")
    found = {r.node: r.root for r in components(edges, Scratch(spark, "test")).collect()}
    assert all(found[k] == 1 for k in range(1, 61)) and {found[x] for x in (100, 200, 300)} == {100}
