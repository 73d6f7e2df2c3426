import random

import duckdb
from pyspark.sql import functions as F

from mapweave.llm import decontaminate as dc


def make(seed=2):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    draw = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(draw(rnd.choice([1, 3, 5, 6, 8, 9, 30, 70])))) for k in range(60)]
    docs = []
    for i in range(250):
        body = draw(rnd.choice([0, 3, 50, 800]))
        if i % 3 == 0:
            words = rnd.choice(items)[1].split()
            for _ in range(rnd.choice([0, 0, 1, 2, 4])):
                words[rnd.randrange(len(words))] = "changed"
            if rnd.random() < 0.5:
                words = [w.upper() for w in words]
            at = rnd.randrange(len(body) + 1)
            body[at:at] = words
        docs.append((i, " \n".join(body)))
    docs += [(300, None), (301, ""), (302, "w1"), (None, items[10][1]), (303, items[10][1]), (303, items[10][1]), (304, "pad " * 40000 + items[11][1])]
    items += [(100, None), (101, ""), (10, items[10][1]), (102, "Changed")]
    return docs, items


def brute(docs, items):
    out, wanted = [], {(k, x): dc.word_shingles(x) for k, x in items if x}
    for i, t in docs:
        words = dc.words_of(t)
        runs = {n: {tuple(words[a : a + n]) for a in range(len(words) - n + 1)} for n in range(1, 6)}
        for (k, _), want in wanted.items():
            for n in {len(g) for g in want}:
                have = runs[n]
                if 100 * len(want & have) >= 75 * len(want):
                    out.append((i, k, len(want), len(want & have)))
    return sorted(out, key=str)


def dropped(docs, items):
    """Places of the documents that go."""
    found = {(i, k) for i, k, _, _ in brute(docs, [x for x in items if len(dc.words_of(x[1])) >= 5])}
    few = [dc.words_of(x) for _, x in items if 0 < len(dc.words_of(x)) < 5]
    return {p for p, (i, t) in enumerate(docs) if i in {d for d, _ in found} or dc.words_of(t) in few}


def test_against_brute_force_broadcast_and_joined(docs_of, monkeypatch):
    docs, items = make()
    want = brute(docs, items)
    assert len(want) > 200 and {len(dc.words_of(dict(items)[k])) for _, k, _, _ in want} >= {1, 3, 5, 30, 70}
    table = docs_of(docs).withColumn("item_id", F.lit("clash")).withColumn("text_key", F.lit(1)).repartition(3)
    bench = docs_of(items, "item_id long, text string")
    gone = dropped(docs, items)
    for size in (dc.BLOCK_BYTES, 3000):
        monkeypatch.setattr(dc, "BLOCK_BYTES", size)
        assert sorted(map(tuple, dc.contained_items(table, bench).collect()), key=str) == want
        left = dc.drop_contaminated(table, bench)
        assert left.columns == table.columns
        assert sorted((str(r.doc_id), r.text or "") for r in left.collect()) == sorted((str(i), t or "") for p, (i, t) in enumerate(docs) if p not in gone)


def test_sketches_lose_nothing():
    for q in range(1, 3000):
        assert 1 <= dc.needed(q) <= dc.sketch_size(q)
        # with as many shingles missing as may be, all of them in the sketch, enough are left
        assert min(dc.sketch_size(q), q) - (q - -(-q * 75 // 100)) >= dc.needed(q)
    assert dc.needed(5000) > dc.needed(5)


def test_query_with_a_short_item_against_its_sql(spark, docs_of, tmp_path):
    docs, items = make(7)
    docs, items = [d for d in docs if d[0] is not None and len(d[1] or "") < 10_000], [x for x in items if x[0] != 10]
    docs_of(docs).write.parquet(str(tmp_path / "documents.parquet"))
    docs_of(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(f"SELECT doc_id, item_id, item_shingles, shared_shingles FROM ({dc.ORACLE_SQL})").fetchall()
    assert len(want) > 100 and sorted(set(map(tuple, dc.op2(spark, str(tmp_path)).collect()))) == sorted(want)


def test_one_pass_over_the_documents(docs_of):
    docs, items = make()
    plan = dc.drop_contaminated(docs_of(docs), docs_of(items, "item_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan


def test_empty_tables(docs_of):
    none, bench = docs_of([]), docs_of([], "item_id long, text string")
    assert dc.contained_items(none, bench).collect() == []
    assert dc.contained_items(none, docs_of([(1, "a b c d e f")], "item_id long, text string")).collect() == []
    assert dc.drop_contaminated(docs_of([(1, "a")]), bench).count() == 1
