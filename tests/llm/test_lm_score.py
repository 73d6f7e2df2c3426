import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from mapweave.llm import lm_score


def tokens(t):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + ["</s>"]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


class Plain:
    """The automaton of the whole corpus in dictionaries: arcs[state][word] -> (weight, state), fail[state] -> (weight, state)."""

    def __init__(self, rows, order):
        grams = [Counter() for _ in range(order + 1)]
        for i, t in rows:
            if not held(i):
                s = ["<s>", *tokens(t)]
                for k in range(1, order + 1):
                    grams[k].update(tuple(s[x : x + k]) for x in range(len(s) - k + 1))
        starts = grams[1].pop(("<s>",), 0)
        self.n, self.v = sum(grams[1].values()), len(grams[1])
        total, types = Counter(), Counter()
        for k in range(2, order + 1):
            for g, c in grams[k].items():
                total[g[:-1]] += c
                types[g[:-1]] += 1
        assert total["<s>",] == (starts if order > 1 else 0)
        once = [sum(c == 1 for c in g.values()) for g in grams]
        twice = [sum(c == 2 for c in g.values()) for g in grams]
        d = [min(lm_score.MOST_D, max(lm_score.LEAST_D, a / (a + 2 * b))) if a else lm_score.PLAIN_D for a, b in zip(once, twice, strict=True)]
        self.root = lambda w: (grams[1][w,] + 1) / (self.n + self.v + 1)
        self.counts, self.states = grams[1], {(), *total}
        p = {g: self.root(g[0]) for g in grams[1]}
        self.arcs, self.fail = defaultdict(dict), {}
        for k in range(2, order + 1):
            rest = {h: d[k] * types[h] / total[h] for h in total if len(h) == k - 1}
            for h, x in rest.items():
                self.fail[h] = math.log10(x), h[1:]
            for g, c in grams[k].items():
                p[g] = (c - d[k]) / total[g[:-1]] + rest[g[:-1]] * p[g[1:]]
                self.arcs[g[:-1]][g[-1]] = math.log10(p[g]), self.longest(g, order - 1)

    def longest(self, g, most):
        return next(g[x:] for x in range(max(0, len(g) - most), len(g) + 1) if g[x:] in self.states)

    def score(self, words, order):
        state, out = self.longest(("<s>",), order - 1), 0.0
        for w in words:
            while state and w not in self.arcs[state]:
                weight, state = self.fail[state]
                out += weight
            if state:
                weight, state = self.arcs[state][w]
            else:
                weight, state = math.log10(self.root(w)), self.longest((w,), order - 1)
            out += weight
        return out


def make(seed=5, n=150):
    rnd = random.Random(seed)
    words = ["a", "B", "b", "c\t", "dé", "x\n", "long" * 9]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 2, 5, 60])))) for i in range(n)]
    return rows + [(None, "a b"), (1510, None), (3, "a b"), (3, "a b"), (1520, "   "), (1530, "q " * 5000), (1541, "q a " * 900)]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_against_an_automaton_walked_arc_by_arc(docs_of, order, monkeypatch):
    monkeypatch.setattr(lm_score, "RANGE_TOKENS", 700)
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(lm_score, "LANE", 16)
    rows = make()
    got = lm_score.lm_scores(docs_of(rows).repartition(3), order=order).collect()
    plain = Plain(rows, order)
    want = []
    for i, t in rows:
        w = tokens(t)
        want.append((i, held(i), len(w), sum(plain.counts[x,] > 0 for x in w), plain.n, sum(math.log10(plain.root(x)) for x in w), plain.score(w, order)))
    key = lambda r: tuple((x is None, x) for x in r[:4])
    assert sum(held(i) for i, _ in rows) > 5
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert tuple(g)[:5] == w[:5]
        assert g.base_score == pytest.approx(w[5], rel=1e-9) and g.score == pytest.approx(w[6], rel=1e-9)


@pytest.mark.parametrize("order", [2, 3])
def test_weights_of_a_state_sum_to_one(order):
    rows = [(i, t) for i, t in make() if not held(i)]
    plain = Plain(rows, order)
    words = {w for _, t in rows for w in tokens(t)}
    for state in plain.states - {()}:
        if state[-1] != "</s>":

            def one(w, s=state):
                out = 0.0
                while s and w not in plain.arcs[s]:
                    out, s = out + plain.fail[s][0], plain.fail[s][1]
                return 10 ** (out + (plain.arcs[s][w][0] if s else math.log10(plain.root(w))))

            assert sum(map(one, words)) + one("never seen") == pytest.approx(1.0)


SQL = r"""
WITH t AS (
       SELECT doc_id, crc = 2 AS held_out, ['<s>', '<s>'] || list_transform(ws, lambda w: 'w' || w) || ['</s>'] AS s FROM (
         SELECT doc_id, crc, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM docs)),
     g AS MATERIALIZED (SELECT doc_id, held_out, s[i] AS w, s[i - 1] AS v, s[i - 2] AS u, i > 3 AS deep FROM (SELECT *, unnest(range(3, len(s) + 1)) AS i FROM t)),
     c1 AS (SELECT w, count(*) AS c FROM g WHERE NOT held_out GROUP BY w),
     c2 AS (SELECT v, w, count(*) AS c FROM g WHERE NOT held_out GROUP BY v, w),
     c3 AS (SELECT u, v, w, count(*) AS c FROM g WHERE NOT held_out AND deep GROUP BY u, v, w),
     n AS (SELECT sum(c) AS n, count(*) AS nv FROM c1),
     h2 AS (SELECT v, sum(c) AS c, count(*) AS t FROM c2 GROUP BY v),
     h3 AS (SELECT u, v, sum(c) AS c, count(*) AS t FROM c3 GROUP BY u, v),
     d2 AS (SELECT least(0.95, greatest(0.05, sum((c = 1)::INT) / (sum((c = 1)::INT) + 2 * sum((c = 2)::INT)))) AS d FROM c2),
     d3 AS (SELECT least(0.95, greatest(0.05, sum((c = 1)::INT) / (sum((c = 1)::INT) + 2 * sum((c = 2)::INT)))) AS d FROM c3),
     p AS (
       SELECT doc_id, held_out, c1.c AS known, (coalesce(c1.c, 0) + 1) / (n.n + n.nv + 1) AS p1, coalesce((greatest(0, coalesce(c2.c, 0) - d2.d)) / h2.c, 0) AS a2, coalesce(d2.d * h2.t / h2.c, 1) AS r2,
              coalesce((greatest(0, coalesce(c3.c, 0) - d3.d)) / h3.c, 0) AS a3, coalesce(d3.d * h3.t / h3.c, 1) AS r3, n.n
       FROM g CROSS JOIN n CROSS JOIN d2 CROSS JOIN d3 LEFT JOIN c1 USING (w) LEFT JOIN c2 USING (v, w) LEFT JOIN c3 ON deep AND c3.u = g.u AND c3.v = g.v AND c3.w = g.w LEFT JOIN h2 USING (v) LEFT JOIN h3 ON deep AND h3.u = g.u AND h3.v = g.v)
SELECT doc_id, held_out, count(*), count(known), any_value(n), sum(log10(p1)), sum(log10(a3 + r3 * (a2 + r2 * p1))) FROM p GROUP BY doc_id, held_out ORDER BY doc_id
"""


def test_query_against_sql(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").toPandas()
    docs["crc"] = [zlib.crc32(str(i).encode()) % 7 for i in docs.doc_id]
    want = duckdb.sql(SQL).fetchall()
    got = sorted(map(tuple, lm_score.op9(spark, "/root/testdata/sf0.001").collect()))
    assert len(got) == len(want) > 100
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)


def test_empty_table_and_clashing_columns(docs_of):
    assert lm_score.lm_scores(docs_of([])).collect() == []
    docs = docs_of([(1, "a b a")]).withColumn("block", F.lit(1)).withColumn("held", F.lit("x")).withColumn("id", F.lit("clash"))
    assert len(lm_score.lm_scores(docs).collect()) == 1
    nothing = lm_score.lm_scores(docs_of([(1, "a b")]), held_out=F.lit(True)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in nothing] == [(3, 0, 0, 0.0, 0.0)]


def test_texts_that_occur_twice_score_higher(docs_of):
    rnd = random.Random(2)
    text = lambda: " ".join("".join(rnd.choice("abcdefg") for _ in range(2)) for _ in range(120))
    pairs = [text() for _ in range(20)]
    rows = [(i, text()) for i in range(60)] + [(100 + 2 * i + k, t) for i, t in enumerate(pairs) for k in (0, 1)]
    got = {r.id: r.score / r.n_tokens for r in lm_score.lm_scores(docs_of(rows), held_out=F.lit(False)).collect()}
    assert max(got[i] for i in range(60)) < min(got[i] for i in range(100, 140))
