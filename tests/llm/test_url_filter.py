from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from mapweave.llm import url_filter as uf


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:end])
    path = rest[end:]
    stop = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return host, path[:stop]


def fitting(host, path):
    best = None
    for verdict, name, start in uf.RULES:
        if (host == name or host.endswith("." + name)) and path.startswith(start) and (best is None or len(name + start) > len(best[0])):
            best = (name + start, verdict)
    return best


def ranks(edges, seeds):
    """PageRank by definition, one kind."""
    total = sum(seeds.values())
    jump = {h: n / total for h, n in seeds.items()} if total else {}
    out = Counter()
    for (a, _), n in edges.items():
        out[a] += n
    rank = dict(jump)
    for _ in range(uf.STEPS):
        new = defaultdict(float, {h: (1 - uf.DAMPING) * s for h, s in jump.items()})
        for (a, b), n in edges.items():
            if a in rank:
                new[b] += uf.DAMPING * rank[a] * n / out[a]
        rank = new
    return rank


def link(*hosts):
    return "".join(f'<a href="{h}">x</a>' for h in hosts)


PAGES = [
    (1, "http://A.example.com/en/12?x#y", link("//b.org/1", "https://good.net/", "/local")),
    (2, "https://example.com/en/7/a", link("http://Friend.io/x", "http://friend.io/y")),
    (3, "https://x.example.net/de/8", None),
    (4, "https://x.example.net/de/9#f", link("http://friend.io")),
    (5, "ftp://b.org/es/1", ""),
    (6, "http://suspect.io/a", link("http://b.org/q", "http://a.example.com")),
    (7, "http://friend.io", ""),
    (8, "no url", link("http://b.org")),
    (9, None, None),
    (10, "://", ""),
    (11, "http://b.org?x=http://y.com/en/", ""),
    (12, "http://friendexample.com/en/7", ""),
    (12, "http://friendexample.com/en/7", ""),
    (13, "http://unknown.io/x://y/en/", "<a href='//unknown.io/a'>"),
    (None, "http://m.b.org/es/", link("http://suspect.io")),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("kind", F.lit(1)).repartition(3)


def test_rules_and_parts(pages):
    got = uf.judge_pages(pages).collect()
    want = []
    for i, url, _ in PAGES:
        host, path = parse(url)
        rule = fitting(host, path)
        want.append((str(i), host, path, rule and rule[0], rule and rule[1]))
    assert sorted((str(r.id), r.host, r.path, r.rule, r.verdict if r.rule else None) for r in got) == sorted(want)
    method = {r.host: r.verdict for r in got if not r.rule}
    assert method["suspect.io"] == "block" and method["friend.io"] == "allow" and method["unknown.io"] == "allow" and method[""] == "allow"


def test_ranks_against_definition(pages):
    edges, seeds = Counter(), {"trust": Counter(), "distrust": Counter()}
    for _, url, html in PAGES:
        host, path = parse(url)
        rule = fitting(host, path)
        if rule:
            seeds["trust" if rule[1] == "allow" else "distrust"][host] += 1
        targets = {parse("http:" + x.split(":", 1)[-1])[0] for x in (html or "").replace("'", '"').split('"')[1::2] if "//" in x}
        for t in targets - {host, ""}:
            if host:
                edges[host, t] += 1
    trust, distrust = ranks(edges, seeds["trust"]), ranks(Counter({(b, a): n for (a, b), n in edges.items()}), seeds["distrust"])
    for r in uf.host_verdicts(pages).collect():
        assert r.trust == pytest.approx(trust.get(r.host, 0)) and r.distrust == pytest.approx(distrust.get(r.host, 0)), r


def test_long_texts_ties_and_shares(spark):
    long = "x" * 300_000
    rows = [(1, f"http://long.io/{long}", link("http://end.io/") + f"<p>{long}" * 5), (2, f"http://{long}.io/a", None), (3, "http://b.org/es/1", ""), (4, "http://long.io/", link("http://b.org"))]
    got = {r.id: r for r in uf.judge_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].path == "/" + long and got[2].host == long + ".io" and got[1].verdict == "block" and got[2].verdict == "allow"
    tied = [("block", "io", "/ab"), ("allow", "a.io", "/"), ("block", "a.io", "/a")]
    pages = spark.createDataFrame([(1, "http://a.io/ab", ""), (2, "http://a.io/c", "")], "page_id long, url string, html string")
    assert {r.id: (r.rule, r.verdict) for r in uf.judge_pages(pages, [tied[0], ("allow", "a.io", "/"), tied[2]]).collect()} == {1: ("a.io/a", "block"), 2: ("a.io/", "allow")}
    assert {r.id: r.rule for r in uf.judge_pages(pages, [("block", "a.io", "/a"), ("allow", "a.io", "/a")]).collect()} == {1: "a.io/a", 2: None}
    # one allowed page of four in all and one blocked of one: the host's share of the blocked is the larger
    mixed = [(k, f"http://h{k % 4}.net/de/", "") for k in range(4)] + [(9, "http://h0.net/de/8x", ""), (10, "http://h0.net/other", "")]
    rules = [("allow", "net", "/de/"), ("block", "net", "/de/8")]
    assert {r.id: r.verdict for r in uf.judge_pages(spark.createDataFrame(mixed, "page_id long, url string, html string"), rules).collect()}[10] == "block"


def test_empty_table(spark):
    assert uf.judge_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_ranks_converge_beyond_eight_links(spark):
    """A chain of 12 links up to a blocked host, and a ring beside it, against the solution of the linear equations."""
    names = [f"h{k}.io" for k in range(12)]
    pages = [(k, f"http://{h}/", link(f"http://{names[k + 1]}/" if k < 11 else "http://bad.org/")) for k, h in enumerate(names)]
    pages += [(20, "http://bad.org/es/1", ""), (21, "http://good.net/de/1", link("http://r1.io")), (22, "http://r1.io/", link("http://r2.io")), (23, "http://r2.io/", link("http://r1.io", "http://good.net", *[f"http://end{k}.io" for k in range(8)]))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.host: r for r in uf.host_verdicts(df).collect()}
    # distrust goes against the chain, undivided: 0.15 * 0.85^n at n links
    for n, h in enumerate(reversed(names), 1):
        assert got[h].blocked and got[h].distrust == pytest.approx(0.15 * 0.85**n) and got[h].trust == 0
    # g = 0.15 + 0.85 r2 / 10, r1 = 0.85 (g + r2 / 10), r2 = 0.85 r1
    r1 = 0.85 * 0.15 / (1 - 0.85**2 / 10 - 0.85**3 / 10)
    want = {"good.net": 0.15 + 0.85**2 * r1 / 10, "r1.io": r1, "r2.io": 0.85 * r1}
    assert all(got[h].trust == pytest.approx(t, rel=1e-5) and not got[h].blocked for h, t in want.items())
