"""URL filter: rules first, then trust and distrust carried over the host graph.

Host edges are the links of the pages' HTML: from a page's host to the host
of each absolute link (http, https or protocol-relative), weighted by how
many pages link so.  Links within a host say nothing about other hosts and
are left out.  Seeds come from the rules' own verdicts: a host is trusted by
its pages that a rule allows and blocked by those that a rule blocks, each
in proportion to its share of them.

Trust is the personalised PageRank of the trusted seeds along the links,
distrust that of the blocked seeds against them: who links to bad hosts is
suspect, whom good hosts link to is not.  Both run as one iteration over
(kind, host, rank) of damping DAMPING, until no new host is reached and no
host's rank changes by more than TOLERANCE of itself, so the summed change is
below TOLERANCE too and far hosts with little rank are settled as well.  A
host is blocked where distrust / (trust + distrust) is THRESHOLD or more; a
host that neither reaches is allowed, as is one whose ranks are too small for
a double.

Trust and distrust are shares: the trusted seeds hold 1 together, and so do the
blocked ones, whatever their numbers.  On a host with seeds of both kinds the
comparison is thus between its share of all allowed and of all blocked pages,
not between its own counts.

All is DataFrame code.  Pages are added up by host, and links by pair of
hosts, before anything is joined, so a host with a third of all pages is one
row.  Each step is written, so the lineage stays short; nothing about hosts is
collected or broadcast by hint.  At the end pages that no rule fits meet the
blocked hosts in a plain join, which adaptive execution splits where one host
holds many of them.

Null urls or urls without "://" have an empty host and path, which no rule
fits; they are allowed.  Null HTML has no links, as an empty one.  Urls and
HTML of any length are read whole.  Repeated pages count each.  Of rules of
equal length that fit, the one declared last wins.  An empty table gives no
rows.  Only id, url and HTML are read, so other columns and their names don't
matter; a null id stays null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fold

#: (verdict, host, path): fixed rules.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
DAMPING, TOLERANCE, THRESHOLD = 0.85, 1e-6, 0.5
#: The steps that ORACLE_SQL writes out; enough where no chain of links is longer.
STEPS = 8


def url_host(url):
    rest = F.regexp_extract(url, r"(?s)\A.*?://(.*)\z", 1)
    return fold(F.coalesce(F.regexp_extract(rest, r"\A[^/?#]*", 0), F.lit("")))


def url_path(url):
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host, path, rules):
    """The longest fitting rule as struct (rule, verdict), or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_links(pages: DataFrame, url_column: str, html_column: str) -> DataFrame:
    """(a, b, n): pages of host a with a link to another host b."""
    pattern = r"""(?i)\b(?:href|src)\s*+=\s*+["']?(?:https?:)?//([^"'\s<>/?#]++)"""
    links = F.array_distinct(F.transform(F.regexp_extract_all(html_column, F.lit(pattern), F.lit(1)), fold))
    pairs = pages.select(url_host(F.col(url_column)).alias("a"), F.explode(links).alias("b"))
    return pairs.filter("a != '' and b != '' and a != b").groupBy("a", "b").agg(F.count("*").alias("n"))


def host_verdicts(pages: DataFrame, rules=RULES, url_column="url", html_column="html", scratch: Scratch | None = None) -> DataFrame:
    """(host, trust, distrust, blocked) of every host that a page or a link names and a seed reaches."""
    scratch = scratch or Scratch(pages.sparkSession, "url-filter")
    seen = pages.select(url_host(F.col(url_column)).alias("host"), url_path(F.col(url_column)).alias("path"))
    verdict = rule_for(F.col("host"), F.col("path"), rules)["verdict"]
    marked = seen.filter("host != ''").groupBy("host").agg(*[F.sum((verdict == v).cast("long")).alias(v) for v in ("allow", "block")])
    seeds = marked.select("host", F.explode(F.create_map(F.lit("trust"), "allow", F.lit("distrust"), "block")).alias("kind", "n")).filter("n > 0")
    seeds = scratch.store(seeds)
    total = seeds.groupBy("kind").agg(F.sum("n").alias("total"))  # two rows at most
    seeds = scratch.store(seeds.join(F.broadcast(total), "kind").select("kind", "host", (F.col("n") / F.col("total")).alias("seed")))

    links = scratch.store(host_links(pages, url_column, html_column))
    along = links.select(F.lit("trust").alias("kind"), "a", "b", "n").unionByName(links.select(F.lit("distrust").alias("kind"), F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    out = along.groupBy("kind", "a").agg(F.sum("n").alias("out"))
    edges = scratch.store(along.join(out, ["kind", "a"]).select("kind", "a", "b", (F.col("n") / F.col("out")).alias("share")))

    rank = seeds.withColumnRenamed("seed", "rank")
    if not edges.isEmpty():
        jump = seeds.select("kind", "host", ((1 - DAMPING) * F.col("seed")).alias("rank"))
        fresh = F.lit(0.0).alias("was")
        changed = F.abs(F.col("rank") - F.col("was")) > TOLERANCE * F.col("rank")
        while True:
            moved = rank.join(edges, (rank.kind == edges.kind) & (rank.host == edges.a)).select(edges.kind, F.col("b").alias("host"), (DAMPING * F.col("rank") * F.col("share")).alias("rank"), fresh)
            before = rank.select("kind", "host", F.lit(0.0).alias("rank"), F.col("rank").alias("was"))
            step = jump.select("*", fresh).unionByName(moved).unionByName(before)
            step = scratch.store(step.groupBy("kind", "host").agg(F.sum("rank").alias("rank"), F.sum("was").alias("was")))
            rank = step.select("kind", "host", "rank")
            if step.filter(changed).isEmpty():
                break
    part = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0)).alias(kind)
    hosts = rank.groupBy("host").agg(part("trust"), part("distrust"))
    return hosts.withColumn("blocked", (F.col("distrust") > 0) & (F.col("distrust") >= THRESHOLD * (F.col("trust") + F.col("distrust"))))


def judge_pages(pages: DataFrame, rules=RULES, id_column="page_id", url_column="url", html_column="html") -> DataFrame:
    """(id, host, path, rule, verdict) of each page."""
    scratch = Scratch(pages.sparkSession, "url-filter")
    hosts = scratch.store(host_verdicts(pages, rules, url_column, html_column, scratch).filter("blocked").select(F.col("host").alias("of_host"), "blocked"))
    seen = pages.select(F.col(id_column).alias("id"), url_host(F.col(url_column)).alias("host"), url_path(F.col(url_column)).alias("path"))
    judged = seen.withColumn("found", rule_for(F.col("host"), F.col("path"), rules)).join(hosts, (F.col("host") == F.col("of_host")) & F.col("found").isNull(), "left")
    verdict = F.coalesce(F.col("found.verdict"), F.when(F.col("blocked"), "block").otherwise("allow"))
    return judged.select("id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumnRenamed("id", "page_id")


def _oracle_sql() -> str:
    """The same in SQL; the steps of the iteration are written out."""
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format
    fits = [(v, h, p, f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')") for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))]
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{h}{p}'" for _, h, p, c in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for v, _, _, c in fits) + " END"
    link = r"""(?i)\b(?:href|src)\s*=\s*["'']?(?:https?:)?//([^"''\s<>/?#]+)"""
    steps = "".join(
        f""",
     r{k} AS MATERIALIZED (
       SELECT kind, host, sum(rank) AS rank FROM (
         SELECT kind, host, {1 - DAMPING} * seed AS rank FROM seeds UNION ALL
         SELECT kind, b, {DAMPING} * rank * share FROM r{k - 1} JOIN edges USING (kind) WHERE host = a) GROUP BY kind, host)"""
        for k in range(1, STEPS + 1)
    )
    return f"""
WITH parts AS MATERIALIZED (
       SELECT page_id, html, {lower(r"coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
     judged AS MATERIALIZED (SELECT page_id, html, host, path, {rule} AS rule, {verdict} AS verdict FROM parts),
     marked AS (SELECT CASE verdict WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*) AS n FROM judged WHERE verdict IS NOT NULL AND host <> '' GROUP BY 1, 2),
     seeds AS MATERIALIZED (SELECT kind, host, n / sum(n) OVER (PARTITION BY kind) AS seed FROM marked),
     named AS (SELECT DISTINCT page_id, host AS a, {lower("unnest(regexp_extract_all(html, '" + link + "', 1))")} AS b FROM judged),
     links AS MATERIALIZED (SELECT a, b, count(*) AS n FROM named WHERE a <> '' AND b <> '' AND a <> b GROUP BY a, b),
     along AS (SELECT 'trust' AS kind, a, b, n FROM links UNION ALL SELECT 'distrust', b, a, n FROM links),
     edges AS MATERIALIZED (SELECT kind, a, b, n / sum(n) OVER (PARTITION BY kind, a) AS share FROM along),
     r0 AS (SELECT kind, host, seed AS rank FROM seeds){steps},
     hosts AS (SELECT host, coalesce(sum(rank) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(rank) FILTER (kind = 'distrust'), 0) AS distrust FROM r{STEPS} GROUP BY host)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN distrust >= {THRESHOLD} * (trust + distrust) THEN 'block' ELSE 'allow' END) AS verdict
FROM judged LEFT JOIN hosts USING (host)
"""


ORACLE_SQL = _oracle_sql()
