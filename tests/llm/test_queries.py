"""The queries themselves on the smallest tables: against their SQL, or against their contract by brute force."""

import hashlib
import re
from collections import defaultdict

import duckdb
import pytest

from mapweave.llm import chat_format, fingerprint, line_dedup, mixing, pii, registry

FOLDER = "/root/testdata/sf0.001"
TABLES = ["documents", "benchmark", "pages", "conversations", "labels"]


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    for t in TABLES:
        made.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return made


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, con, name):
    got = registry.QUERIES[name](spark, FOLDER)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and want


def test_sql_on_lines_and_turns_made_for_it(spark, tmp_path):
    docs = [(1, "we thank you dear readers of this page today\nmine"), (2, "we thank you dear friends of this page today\nyours"), (3, "we thank you all\nLes."), (4, "we thank you both\nLes."), (5, "we thank you now\nLes.\n7"), (6, ""), (7, None), (8, "7\n8 9"), (9, "7"), (10, "7")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    turns = [(1, 0, "user", "a"), (None, 0, "user", "x"), (None, 1, "assistant", "y"), (2, None, None, None), (2, 1, "assistant", "<s>\\")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    local = duckdb.connect()
    for t in ("documents", "conversations"):
        local.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for query, sql in ((line_dedup.op10, line_dedup.ORACLE_SQL), (chat_format.op6, chat_format.ORACLE_SQL)):
        got = query(spark, str(tmp_path))
        want = local.execute(f"SELECT {', '.join(got.columns)} FROM ({sql})").fetchall()
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_mixing_keeps_its_contract(spark, documents):
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", d.text or "")) for i, d in documents.items()}
    by_source, largest = defaultdict(int), defaultdict(int)
    for i, d in documents.items():
        by_source[d.source] += size[i]
        largest[d.source] = max(largest[d.source], size[i])
    order = sorted(by_source, key=lambda s: (s is None, s or ""))
    targets = dict(zip(order, mixing.water_fill([by_source[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))], 1.5 * sum(by_source.values()), 2), strict=True))
    taken = defaultdict(int)
    rows = mixing.op3(spark, FOLDER).collect()
    assert sorted(r.doc_id for r in rows) == sorted(documents)
    for r in rows:
        s = documents[r.doc_id].source
        assert (r["size"], r.source_size) == (size[r.doc_id], by_source[s]) and r.target == pytest.approx(targets[s]) and r.taken <= 2 * r["size"]
        taken[s] += r.taken
    assert all(abs(taken[s] - targets[s]) <= largest[s] for s in order) and all(t <= 2 * by_source[s] for s, t in targets.items())
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.op3(spark, FOLDER).collect()))


def test_fingerprints_keep_their_contract(spark, documents):
    ids = sorted(documents)
    rows = {r.doc_id: r for r in fingerprint.op7(spark, FOLDER).collect()}
    assert sorted(rows) == ids
    same = defaultdict(set)
    for k, i in enumerate(ids):
        text, after = documents[i].text or "", documents[ids[(k + 1) % len(ids)]].text or ""
        m, r = len(text) // 4, rows[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256((text[: len(text) - m] + after[:m]).encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        same[text].add(r.fingerprint)
    assert all(len(x) == 1 for x in same.values())


def test_personal_data_keeps_its_contract(spark, documents):
    for r in pii.op4(spark, FOLDER).collect():
        base = pii.base_spans(documents[r.doc_id].text or "")
        assert r.base_sha256 == hashlib.sha256(pii.written(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, k, _ in base) for x in range(4)]
        assert set(filter(None, pii.written(base).split(","))) <= set(r.spans.split(","))
