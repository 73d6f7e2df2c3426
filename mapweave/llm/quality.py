"""Quality classifier: a sparse rule ensemble over text statistics.

`STATISTICS` are Spark expressions over a whole text.  `fit_rules` boosts
shallow regression trees on their values for a bounded sample of labelled
rows, takes every path from a root to a node as a conjunctive rule, and fits
one weight for each rule by logistic regression with an L1 penalty (proximal
gradient), which leaves most weights zero.  `RuleModel.score` compiles the
rules that are left into one Spark expression, so that scoring is a single
narrow pass over the texts.

Training takes at most MAX_ROWS labelled rows (those with the least hash of
the id), which bounds what is broadcast (their ids) and collected (their
statistics).  An id with contradictory labels, without label or without
document isn't learned from.  Without any label the score is 0.5, with one
kind alone it is that label's share.

Null text counts as empty; an empty text has all statistics zero (but
for its one empty line) and gets the score the rules give it.  Texts of any
length are read whole.  Repeated rows are scored alike; a row without id is
scored and isn't held out.  A score of just 0.5 is on the side of label 1.  An
empty table gives no rows.  Other columns pass through; helper columns take the
names __t, __w, __l, __passed and __s_*, and a column of such a name is lost.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK, crc_mod

MAX_ROWS = 20_000
TREES, DEPTH, RATE, LEAST_ROWS, BINS = 12, 3, 0.5, 20, 48
PENALTY, STEPS = 0.0006, 200

_ENDS = " \t\n\x0b\f\r"


def with_statistics(df: DataFrame, text_column: str) -> DataFrame:
    """df with one double column for each statistic; names in STATISTICS."""
    kept = df.columns
    text = F.coalesce(F.col(text_column), F.lit(""))
    df = df.withColumn("__t", text).withColumn("__w", F.split(F.trim("__t", F.lit(_ENDS)), f"[{BLANK}]+")).withColumn("__l", F.split("__t", "\n"))
    t, w, lines = F.col("__t"), F.col("__w"), F.col("__l")
    n, n_words, n_lines = F.length(t), F.size(w), F.size(lines)
    share = lambda x, of: F.when(of > 0, x / of).otherwise(0.0).cast("double")
    without = lambda pattern: n - F.length(F.regexp_replace(t, pattern, ""))
    count = lambda s: n - F.length(F.replace(t, F.lit(s), F.lit("")))
    found = {
        "length": F.log1p(n.cast("double")),
        "word_length": share(n, n_words),
        "distinct_words": share(F.size(F.array_distinct(w)), n_words),
        "repeated_words": share(F.size(F.filter(w, lambda x, i: (i > 0) & (x == F.get(w, i - 1)))), n_words),
        "distinct_lines": share(F.size(F.array_distinct(lines)), n_lines),
        "line_length": F.log1p(share(n, n_lines)),
        "upper": share(without("[A-Z]+"), n),
        "digits": share(without("[0-9]+"), n),
        "symbols": share(without(r"[#$%&*+/<=>@^_`{|}~\[\]\\]+"), n),
        "exclamations": share(count("!"), n_words),
        "stops": share(count("."), n_words),
        "commas": share(count(","), n_words),
        "bars": share(count("|"), n_words),
    }
    assert list(found) == STATISTICS
    return df.select(*kept, *[x.alias(f"__s_{k}") for k, x in found.items()])


STATISTICS = ["length", "word_length", "distinct_words", "repeated_words", "distinct_lines", "line_length", "upper", "digits", "symbols", "exclamations", "stops", "commas", "bars"]


@dataclass(frozen=True)
class Rule:
    """All of: statistic at most (or above) threshold."""

    tests: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k, above, at in self.tests:
            out &= (x[:, k] > at) == above
        return out

    def column(self) -> Column:
        parts = [(F.col(f"__s_{STATISTICS[k]}") > at) if above else (F.col(f"__s_{STATISTICS[k]}") <= at) for k, above, at in self.tests]
        return reduce(lambda a, b: a & b, parts)


@dataclass(frozen=True)
class RuleModel:
    bias: float
    rules: tuple[tuple[Rule, float], ...] = ()

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.bias + sum((w * r.holds(x) for r, w in self.rules), np.zeros(len(x)))

    def score(self) -> Column:
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(), weight).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _tree_paths(x, binned, cuts, gradient, hessian):
    """One regression tree by Newton steps; (rule tests, rows, value) of every node below the root."""
    nodes, leaves = [((), np.arange(len(x)))], []
    found = []
    for _ in range(DEPTH):
        split = []
        for tests, rows in nodes:
            g, h = gradient[rows], hessian[rows]
            best = (1e-6, None)
            base = g.sum() ** 2 / (h.sum() + 1)
            for k in range(x.shape[1]):
                size = len(cuts[k]) + 1
                sums = [np.cumsum(np.bincount(binned[rows, k], weight, size)) for weight in (g, h, None)]
                left_g, left_h, left_n = (s[:-1] for s in sums)
                right_g, right_h, right_n = (s[-1] - s[:-1] for s in sums)
                gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - base
                gain[(left_n < LEAST_ROWS) | (right_n < LEAST_ROWS)] = 0
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), (k, int(gain.argmax())))
            if best[1] is None:
                leaves.append((tests, rows))
                continue
            k, at = best[1]
            above = binned[rows, k] > at
            for side in (False, True):
                child = ((*tests, (k, side, float(cuts[k][at]))), rows[above == side])
                found.append(child[0])
                split.append(child)
        nodes = split
    return found, [(t, r, -gradient[r].sum() / (hessian[r].sum() + 1)) for t, r in nodes + leaves]


def fit_rules(x: np.ndarray, y: np.ndarray) -> RuleModel:
    """Sparse rule ensemble for statistics x (rows by statistics) and labels y of 0 and 1."""
    if not len(y):
        return RuleModel(0.0)
    prior = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    bias = float(np.log(prior / (1 - prior)))
    if y.min() == y.max():
        return RuleModel(bias)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
    logit, paths = np.full(len(y), bias), {}
    for _ in range(TREES):
        p = _sigmoid(logit)
        found, leaves = _tree_paths(x, binned, cuts, p - y, p * (1 - p))
        paths |= dict.fromkeys(Rule(t) for t in found)
        for _, rows, value in leaves:
            logit[rows] += RATE * value
    rules, columns, seen = [], [], set()
    for r in paths:
        c = r.holds(x)
        if 0 < c.sum() < len(y) and (name := c.tobytes()) not in seen:
            seen.add(name)
            rules.append(r)
            columns.append(c)
    if not rules:
        return RuleModel(bias)
    a = np.stack(columns, axis=1).astype(np.float32)
    # the greatest curvature of the mean logistic loss, with the bias as one more column
    step = 4 * len(y) / (float(np.linalg.eigvalsh(a.T.astype(float) @ a.astype(float))[-1]) + len(y))
    weights, ahead, momentum = np.zeros(len(rules), np.float32), np.zeros(len(rules), np.float32), 1.0
    for _ in range(STEPS):
        off = _sigmoid(bias + a @ ahead) - y
        bias -= step * float(off.mean())
        new = ahead - step * (a.T @ off.astype(np.float32)) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - step * PENALTY, 0)
        after = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        ahead, weights, momentum = new + (momentum - 1) / after * (new - weights), new, after
    return RuleModel(bias, tuple((r, float(w)) for r, w in zip(rules, weights, strict=True) if w))


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", max_rows: int = MAX_ROWS) -> RuleModel:
    """Learn from labelled documents whose crc32(id as text) mod 3 isn't 1."""
    given = labels.select(F.col(id_column).cast("long").alias("__id"), F.col(label_column).cast("int").alias("__y")).filter("__id is not null and __y in (0, 1)")
    given = given.filter(crc_mod("__id", 3) != 1).groupBy("__id").agg(F.min("__y").alias("__y"), F.max("__y").alias("__y2")).filter("__y = __y2")
    chosen = given.orderBy(F.xxhash64("__id"), "__id").limit(max_rows).select("__id", "__y")
    texts = docs.select(F.col(id_column).cast("long").alias("__doc"), F.col(text_column).alias("__text"))
    joined = texts.join(F.broadcast(chosen), F.col("__doc") == F.col("__id"))
    values = with_statistics(joined, "__text").drop("__text", "__doc").groupBy("__id").agg(F.min("__y").alias("__y"), *[F.min(f"__s_{k}").alias(f"__s_{k}") for k in STATISTICS])
    rows = sorted(values.collect())
    data = np.array([r[1:] for r in rows], float).reshape(len(rows), 1 + len(STATISTICS))
    return fit_rules(data[:, 1:], data[:, 0])


def score_quality(docs: DataFrame, model: RuleModel, text_column: str = "text", name: str = "score") -> DataFrame:
    """docs with the score of each text, 0 to 1."""
    rest = [c for c in docs.columns if c != name]
    return with_statistics(docs, text_column).select(*rest, model.score().alias(name))


def drop_low_quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: float = 0.5) -> DataFrame:
    """The documents that score at least `least`."""
    model = fit(docs, labels, id_column, text_column)
    # a generator, not a filter: a filter would be pushed below the statistics and compute them anew for each rule
    passed = F.explode(F.array_compact(F.array(F.when(model.score() >= least, 1))))
    return with_statistics(docs, text_column).select(*docs.columns, passed.alias("__passed")).select(*docs.columns)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_quality(docs, fit(docs, labels))
    held = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
