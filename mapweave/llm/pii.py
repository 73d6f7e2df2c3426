"""Personal data: fixed patterns and a semi-Markov conditional random field.

`base_spans` finds e-mail addresses, IP addresses, card and phone numbers by
their exact definitions.  `SemiMarkov` adds spans in other spellings:
spelled-out addresses ("ann (at) host (dot) org"), phone numbers without "+",
cards and IP addresses with other separators.

The field labels candidate segments.  Numbers: on one line, runs of digit
groups parted by up to four of `` ()./[]-`` are a cluster, and every run of
groups in it with up to MAX_GROUPS groups and LEAST to MOST digits (or four
octets) is a candidate for an IP address, card or phone.  Addresses: at each
"@", bracketed or spelled "at", the local part and one to MAX_LABELS labels
after it.  All else is outside.  A candidate is scored by features of the whole
span (lengths and pattern of its groups, separators, checksum, cue words
before it, what touches it) and, in a cluster, by the kind of the entity
before.  Dynamic programming over the ends chooses boundaries and kinds
together.  Candidates that can't raise any labelling's score are dropped
before it, which changes nothing.

Weights maximise the conditional likelihood (forward-backward, AdaGrad) of
text made by rule from a seed, once a process, in seconds on the driver; the
same seed gives the same model.

Base spans stay as they are: the field doesn't see them, so nothing it adds
overlaps one, and no span goes across a line break.  Secrets such as keys and
passwords belong to none of the four kinds and are left.

Time is linear in the text: candidates are bounded a group, and are scored
in arrays of CHUNK at most.  Null text counts as empty, an empty one has no
spans; very long texts are read whole.  Repeated rows are read each.  Ties
between labellings go to fewer, earlier spans.  Only id and text are read, so
other columns and their names don't matter; an empty table gives no rows.
Positions are code points, end exclusive.
"""

from __future__ import annotations

import functools
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as K

KINDS = ["email", "ip", "card", "phone"]
MAX_GROUPS, LEAST, MOST, MAX_LABELS, SEED = 19, 9, 19, 8, 7
CHUNK = 1 << 17

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A digit run is taken whole, so that a failure isn't tried again inside it.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(text: str):
    at, floor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            floor = found.end()
            yield start, floor
        else:
            # the next match can't begin before this "@"
            floor = at + 1
        at = text.find("@", max(floor, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base definitions, in order."""
    found = [(s, 0, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_DIGIT.findall(m[0])) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


# ---- candidates

_NUMBERS = re.compile(r"[0-9]++(?:[\x20().\[\]/-]{1,4}+[0-9]++)*+")
_DIGITS = re.compile(r"[0-9]+")
_AT = re.compile(r"@|[\[({<]\x20?(?:at|@)\x20?[\])}>]|(?<=\x20)at(?=\x20)", re.I)
_DOT = re.compile(r"\.|\x20?[\[({<]\x20?(?:dot|\.)\x20?[\])}>]\x20?|\x20dot\x20", re.I)
_LABEL = re.compile(r"[A-Za-z0-9-]+")
_MATES_AFTER, _MATES_BEFORE = re.compile(r"\x20*[,;|\t:]\s*[0-9]|\x20*\t"), re.compile(r"[0-9]\x20*[,;|\t:]\x20*\Z|\t\x20*\Z")
_WORD = re.compile(r"[^\W\d_]+")
#: Words before a span that name its kind: fixed values.
_CUES = [
    frozenset("mail email e-mail contact write courriel correo".split()),
    frozenset("ip host server address addr adresse dirección gateway router".split()),
    frozenset("card visa mastercard amex credit debit carte tarjeta karte kreditkarte".split()),
    frozenset("phone tel telephone call fax mobile cell whatsapp téléphone appelez teléfono llame móvil telefon handy anruf hotline".split()),
]
_TOPS = frozenset("com org net edu gov info io de fr es uk eu at ch it nl".split())
#: Separators between digit groups that have a feature of their own: fixed values.
_GAPS = [" ", "-", ".", "/", "  ", " . ", "[.]", ". ", ") ", ")", ")-"]
_GAP_CODE = {g: k for k, g in enumerate(_GAPS)}
N_FEATURES = 56


class Candidates:
    """Segments (start, end) of one text with their features, by cluster; numbers have kinds 1 to 3, addresses kind 0."""

    def __init__(self, cluster, start, end, x, address):
        self.cluster, self.start, self.end, self.x, self.address = cluster, start, end, x, address


def _cue(text: str, at: int) -> int:
    """Which cues stand in the three words before, on the line, as bits."""
    words = _WORD.findall(text[max(text.rfind("\n", 0, at) + 1, at - 40) : at].lower())[-3:]
    return sum(1 << k for k, cue in enumerate(_CUES) if not cue.isdisjoint(words))


def _numbers(text: str):
    """Chunks of candidates among the digit groups of a text."""
    starts, ends, regions, gaps, about = [], [], [], [], []
    for m in _NUMBERS.finditer(text):
        s, e = m.span()
        if e - s < 7:
            continue
        spans = [(s, e)] if m[0].isdigit() else [d.span() for d in _DIGITS.finditer(text, s, e)]
        n_digits = sum(b - a for a, b in spans)
        if n_digits < LEAST and not (len(spans) >= 4 and "." in m[0]):
            continue
        left, right = text[s - 1 : s], text[e : e + 1]
        opens = left in ("(", "+") and left
        outer = text[s - 2 : s - 1] if opens else left
        bad = outer.isalnum() or outer in tuple("@=#_.,:$€%-/+\\") and outer != "" and not (outer == ":" and not opens)
        bad_after = right.isalnum() or right in ("%", "_", "@", "=") or (right in (".", ",", ":", "-") and text[e + 1 : e + 2].isalnum() and right != "")
        mates = bool(_MATES_AFTER.match(text, e)) or bool(_MATES_BEFORE.search(text[max(0, s - 4) : s]))
        line = text.rfind("\n", max(0, s - 4), s) >= 0 or s <= 3
        alone = line and not text[max(0, s - 3) : s].strip(" (+\n") and (not right or not text[e : e + 3].split("\n")[0].strip(" )."))
        flags = [bool(bad), bool(bad_after), mates, bool(alone), opens == "+"]
        cue = _cue(text, s)
        flags += [bool(cue >> k & 1) for k in (1, 2, 3)]
        region = len(about)
        about.append(flags)
        for k, (a, b) in enumerate(spans):
            starts.append(a)
            ends.append(b)
            regions.append(region)
            gaps.append(_GAP_CODE.get(text[b : spans[k + 1][0]], len(_GAPS)) if k + 1 < len(spans) else -1)
    if not starts:
        return
    start, end, region, gap = (np.array(x, np.int64) for x in (starts, ends, regions, gaps))
    about = np.array(about, bool)
    size = end - start
    n = len(start)
    before = np.cumsum(size) - size
    cum = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    of_gap = [cum(gap == c) for c in range(len(_GAPS))]
    parens = cum((gap >= 8) & (gap < len(_GAPS)))
    octet = cum([b - a <= 3 and int(text[a:b]) <= 255 for a, b in zip(starts, ends, strict=True)])
    of_size = {k: cum(size == k) for k in (1, 2, 3, 4)}
    zero = np.array([text[a] == "0" for a in starts])
    book = np.array([text[a : a + 3] in ("978", "979") for a in starts])
    opening = np.array([text[a - 1 : a] == "(" for a in starts])
    # Luhn sums over all digits, doubling those at odd or at even places
    digits = np.frombuffer("".join(text[a:b] for a, b in zip(starts, ends, strict=True)).encode(), np.uint8).astype(np.int64) - 48
    twice = digits * 2 - 9 * (digits > 4)
    odd = np.arange(len(digits)) % 2 == 1
    sums = [cum(np.where(odd, twice, digits)), cum(np.where(odd, digits, twice))]
    first, last = np.searchsorted(region, region, "left"), np.searchsorted(region, region, "right") - 1
    step = max(1, CHUNK // MAX_GROUPS)
    for low in range(0, n, step):
        a_parts, b_parts = [], []
        for d in range(MAX_GROUPS):
            a = np.arange(low, min(low + step, n - d))
            if not len(a):
                break
            a = a[last[a] >= a + d]
            total = before[a + d] + size[a + d] - before[a]
            ok = (total >= LEAST) & (total <= MOST) | ((octet[a + d + 1] - octet[a] == 4) & (d == 3))
            a_parts.append(a[ok])
            b_parts.append(a[ok] + d)
        a, b = np.concatenate(a_parts), np.concatenate(b_parts)
        if not len(a):
            continue
        groups, total = b - a + 1, before[b] + size[b] - before[a]
        info = about[region[a]]
        at_first, at_last = a == first[a], b == last[a]
        uniform = [(c[b] - c[a] == groups - 1) & (groups > 1) for c in of_gap]
        final = before[b] + size[b] - 1
        check = np.where(final % 2 == 0, sums[0][final + 1] - sums[0][before[a]], sums[1][final + 1] - sums[1][before[a]]) % 10 == 0
        paren = opening[a] & (gap[a] >= 8) & (gap[a] < len(_GAPS)) & (groups > 1)
        apart = (at_first | (gap[np.maximum(a - 1, 0)] == len(_GAPS))) & (at_last | (gap[b] == len(_GAPS)))
        plus = at_first & info[:, 4]
        three = (groups == 3) & (size[a] == 3) & (size[np.minimum(a + 1, b)] == 3) & (size[b] == 4)
        plain_parens = parens[b] - parens[a] - paren
        cues = [info[:, 5 + k] & at_first for k in range(3)]
        dashed, spaced, dotted = (uniform[1], uniform[0], uniform[2])
        bare = groups == 1
        x = [
            np.ones(len(a), bool), bare, (total == 9), (total == 10), (total >= 11) & (total <= 13), (total >= 14) & check, (total >= 14) & ~check, total < 9,
            three & dashed, three & dotted, three & spaced, three & paren, three & uniform[3],
            (of_size[4][b + 1] - of_size[4][a] == groups) & (groups == 4) & check, (of_size[1][b + 1] - of_size[1][a] == groups) & (groups >= 14) & check,
            (of_size[2][b + 1] - of_size[2][a] == groups) & (groups == 5) & zero[a], (of_size[3][b + 1] - of_size[3][a] == groups) & (groups == 3),
            (octet[b + 1] - octet[a] == 4) & (groups == 4), *uniform[:8],
            ~at_first | ~at_last, at_first & info[:, 0], at_last & info[:, 1], info[:, 2], info[:, 3],
            plus, paren, (plain_parens > 0) | (opening[a] & ~paren), *cues, (groups > 1) & ~np.logical_or.reduce(uniform) & ~paren,
            bare & ~(cues[0] | cues[1] | cues[2]), spaced & ~(cues[0] | cues[1] | cues[2]),
            (octet[b + 1] - octet[a] == 4) & (groups == 4) & (uniform[5] | uniform[6]), (octet[b + 1] - octet[a] == 4) & (groups == 4) & uniform[7] & cues[0],
            ~apart, (groups > 5) & (total >= 9), book[a] & (total == 13), (groups > 1) & (gap[np.minimum(a, b - 1)] == len(_GAPS)),
        ]
        whole = np.zeros((len(a), N_FEATURES), bool)
        whole[:, : len(x)] = np.stack(x, axis=1)
        yield Candidates(region[a], start[a] - (paren | plus), end[b], whole, False)


_ADDRESS = 45


def _addresses(text: str):
    """Candidates around each "@" and spelled "at"."""
    found, floor = [], 0
    for cluster, m in enumerate(_AT.finditer(text)):
        s, e = m.span()
        plain = m[0].lower() == "at"
        close = s - (text[s - 1 : s] == " ")
        begin = close
        while begin > floor and text[begin - 1] in _LOCAL:
            begin -= 1
        floor = e
        while begin < close and text[begin] in ".-%+":
            begin += 1
        if begin == close:
            continue
        at = e + (text[e : e + 1] == " ")
        spelled = False
        labels = 0
        label = _LABEL.match(text, at)
        local, bits = text[begin:close], _cue(text, begin)
        ends = []
        while label and labels < MAX_LABELS:
            labels += 1
            end = label.end()
            dot = _DOT.match(text, end)
            following = _LABEL.match(text, dot.end()) if dot else None
            ends.append((labels, label[0].lower(), end, spelled, following is not None))
            if not following:
                break
            spelled |= dot[0] != "."
            label = following
        for labels, name, end, spelled, more in ends:
            if labels < 2:
                continue
            x = np.zeros(N_FEATURES, bool)
            x[0] = True
            for k, on in enumerate([plain, m[0] == "@", not plain and m[0] != "@", spelled, name in _TOPS, 2 <= len(name) <= 4 and name.isalpha(), not name.isalpha(), more, bool(bits & 1), plain and not spelled]):
                x[_ADDRESS + k] = on
            found.append((cluster, begin, end, x))
    if found:
        cluster, begin, end, x = zip(*found, strict=True)
        yield Candidates(np.array(cluster), np.array(begin), np.array(end), np.stack(x), True)


def _without(text: str, base) -> str:
    """Text with the base spans blanked out, at the same positions."""
    out, at = [], 0
    for s, _, e in base:
        if e > at:
            out += [text[at : max(s, at)], "\x00" * (e - max(s, at))]
            at = e
    return "".join(out) + text[at:] if out else text


def candidates(text: str, base):
    text = _without(text, base)
    if _DIGIT.search(text):
        yield from _numbers(text)
    if _AT.search(text):
        yield from _addresses(text)


# ---- the field


class SemiMarkov:
    """weights[kind][feature] of segments; moves[a][b] of kind b after kind a in a cluster (the last: none before)."""

    def __init__(self, weights=None, moves=None):
        n = len(KINDS)
        self.weights = np.zeros((n, N_FEATURES)) if weights is None else np.asarray(weights, float)
        self.moves = np.zeros((n + 1, n)) if moves is None else np.asarray(moves, float)

    def scores(self, c: Candidates) -> np.ndarray:
        """Score of each candidate as each kind; minus infinity where the kind isn't for it."""
        out = c.x @ self.weights.T
        out[:, 1:] = -np.inf if c.address else out[:, 1:]
        out[:, 0] = out[:, 0] if c.address else -np.inf
        return out

    def hopeful(self, score: np.ndarray) -> np.ndarray:
        """Candidates that raise the score of some labelling: what a segment adds is its score and at most the gain in moves."""
        n = len(KINDS)
        gain = np.array([max([self.moves[p, k] + max(0.0, *(self.moves[k, q] - self.moves[p, q] for q in range(n))) for p in range(n + 1)]) for k in range(n)])
        return (score + gain).max(axis=1) > 0

    def decode(self, spans: list[tuple[int, int]], score: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the best set of segments that don't overlap, in one cluster."""
        n = len(KINDS)
        order = sorted(range(len(spans)), key=lambda i: (spans[i][1], spans[i][0]))
        # best[k]: over all labellings of what ends so far, the last entity being of kind k; kept at each end
        ends, tables, back = [-1], [np.array([-np.inf] * n + [0.0])], [[None] * (n + 1)]
        for i in order:
            s, e = spans[i]
            if ends[-1] != e:
                ends.append(e)
                tables.append(tables[-1].copy())
                back.append(list(back[-1]))
            at = next(j for j in range(len(ends) - 1, -1, -1) if ends[j] <= s)
            for k in range(n):
                if score[i, k] > -np.inf:
                    values = tables[at] + self.moves[:, k] + score[i, k]
                    p = int(values.argmax())
                    if values[p] > tables[-1][k]:
                        tables[-1][k], back[-1][k] = values[p], (i, at, p)
        k, j, found = int(np.lexsort((-np.arange(n + 1), tables[-1]))[-1]), len(ends) - 1, []
        if tables[-1][n] >= tables[-1][k]:
            k = n
        while back[j][k] is not None:
            i, j, p = back[j][k]
            found.append((spans[i][0], k, spans[i][1]))
            k = p
        return found[::-1]

    def expected(self, spans: list[tuple[int, int]], score: np.ndarray):
        """Probability of each (segment, kind), expected moves, and log of the sum over all labellings, of one cluster."""
        n = len(KINDS)
        bounds = sorted({x for s in spans for x in s})
        place = {x: j for j, x in enumerate(bounds)}
        at = [(place[s], place[e]) for s, e in spans]
        alpha = np.full((len(bounds) + 1, n + 1), -np.inf)
        alpha[0, n] = 0.0
        beta = np.full((len(bounds), n + 1), -np.inf)
        beta[-1] = 0.0
        by_end = sorted(range(len(spans)), key=lambda i: at[i][1])
        steps = lambda i: alpha[at[i][0]][:, None] + self.moves + score[i]
        done = 0
        for j in range(1, len(bounds)):
            alpha[j] = np.logaddexp(alpha[j], alpha[j - 1])
            while done < len(by_end) and at[by_end[done]][1] == j:
                i = by_end[done]
                alpha[j, :n] = np.logaddexp(alpha[j, :n], np.logaddexp.reduce(steps(i), axis=0))
                done += 1
        by_start = sorted(range(len(spans)), key=lambda i: -at[i][0])
        done = 0
        for j in range(len(bounds) - 2, -1, -1):
            beta[j] = beta[j + 1]
            while done < len(by_start) and at[by_start[done]][0] == j:
                i = by_start[done]
                beta[j] = np.logaddexp(beta[j], np.logaddexp.reduce(self.moves + score[i] + beta[at[i][1], :n], axis=1))
                done += 1
        whole = float(np.logaddexp.reduce(alpha[len(bounds) - 1]))
        shares = [np.exp(steps(i) + beta[at[i][1], :n] - whole) for i in range(len(spans))]
        return np.array([x.sum(axis=0) for x in shares]), sum(shares), whole


def _clusters(c: Candidates):
    for cut in np.split(np.arange(len(c.cluster)), np.flatnonzero(np.diff(c.cluster)) + 1):
        yield cut


def _sentences(rnd: random.Random, n: int):
    """Made-up text with marked spans: (text, [(start, kind, end)])."""
    letters = "abcdefghilmnoprstuvéü"
    word = lambda: "".join(rnd.choice(letters) for _ in range(rnd.randrange(2, 9)))
    name = lambda: "".join(rnd.choice("abcdefghilmnoprst") for _ in range(rnd.randrange(2, 9)))
    digits = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    cues = [sorted(x) for x in _CUES]

    def card():
        body = rnd.choice("3456") + digits(14)
        full = next(body + d for d in "0123456789" if luhn(body + d))
        return rnd.choice(["/", ".", "  "]).join(full[k : k + 4] for k in range(0, 16, 4))

    def email():
        at, dot = rnd.choice([(" (at) ", " (dot) "), ("(at)", "."), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" @ ", "."), (" at ", " dot "), ("<at>", "<dot>"), ("{at}", "."), ("@", "[.]"), ("@", " (dot) ")])
        local = ".".join(name() for _ in range(rnd.choice([1, 1, 2]))) + rnd.choice(["", "", digits(2), "_" + name()])
        return local + at + dot.join([*(name() for _ in range(rnd.choice([1, 1, 2]))), rnd.choice(sorted(_TOPS))])

    def phone():
        a, b, c = str(rnd.randrange(2, 10)) + digits(2), digits(3), digits(4)
        return rnd.choice([f"({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", "0" + " ".join([digits(1), *(digits(2) for _ in range(4))]), f"({a}) {b} {c}", f"{a}/{b}/{c}"])

    def cued_phone():
        return rnd.choice([f"{digits(3)} {digits(3)} {digits(4)}", f"{digits(3)} {digits(3)} {digits(3)}", f"0{digits(2)}/{digits(7)}", f"0{digits(9)}", f"0{digits(3)}-{digits(6)}", f"{digits(3)}-{digits(4)}-{digits(4)}"])

    def ip():
        return rnd.choice([" . ", "[.]"]).join(str(rnd.randrange(256)) for _ in range(4))

    def other():
        many = lambda k, sep: sep.join(digits(rnd.randrange(1, 8)) for _ in range(k))
        return rnd.choice([
            f"{digits(1)}.{digits(1)}", digits(4), f"v{digits(1)}.{digits(1)}.{digits(1)}", f"20{digits(2)}-0{digits(1)}-1{digits(1)}", f"20{digits(2)}-0{digits(1)}-1{digits(1)} 1{digits(1)}:{digits(2)}:{digits(2)}", f"20{digits(2)}/0{digits(1)}/1{digits(1)} {digits(4)}",
            f"{digits(1)},{digits(3)}.{digits(2)}", "AKIA" + name().upper() + digits(3) + name().upper(), "password=" + digits(4) + name()[:2] + digits(9), f"no. {digits(rnd.randrange(6, 12))}", digits(rnd.randrange(8, 14)), digits(16),
            f"{name()}{digits(2)}", f"@{name()}", f"{name()} @ {digits(2)}", f"{digits(3)}.{digits(3)}", f"{digits(3)} {digits(3)}", f"{digits(5)}-{digits(4)}", f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", f"978{digits(10)}", f"{rnd.randrange(1, 10)} {digits(3)} {digits(3)} {digits(3)}",
            many(rnd.randrange(2, 12), " "), many(rnd.randrange(2, 12), " "), many(rnd.randrange(2, 10), "."), many(rnd.randrange(2, 10), "/"), many(rnd.randrange(2, 10), "-"), many(rnd.randrange(2, 10), ", "), many(rnd.randrange(2, 10), "  "), many(rnd.randrange(2, 8), " | "),
            ". ".join(str(k) for k in range(1, rnd.randrange(5, 9))), " ".join(digits(3) for _ in range(rnd.randrange(3, 9))), " ".join(digits(4) for _ in range(rnd.randrange(3, 9))), " ".join(digits(1) for _ in range(rnd.randrange(9, 25))), "/".join(digits(4) for _ in range(4)),
            f"meet {name()} at {name()} dot", f"look at {name()}.{name()} now", f"{name()} at {name()}. {name()} dot", f"{digits(1)}.{digits(7)} {digits(1)}.{digits(7)}", f"0.{digits(12)}", f"-{digits(2)}.{digits(8)}", f"{digits(3)}.{digits(3)}.{digits(4)}.{digits(2)}",
            f"{name()}@{name()}", f"@{name()}.{name()}", f"{name()} (at) {name()}",
        ])

    makers = [email, ip, card, phone]
    for _ in range(n):
        text, spans = "", []
        for _ in range(rnd.randrange(1, 4)):
            if rnd.random() < 0.15:
                rows, columns, sep = rnd.randrange(2, 5), rnd.randrange(2, 9), rnd.choice([" ", "  ", "\t", ",", " | ", "/", "."])
                text += "\n" + "\n".join(sep.join(digits(rnd.randrange(1, 7)) for _ in range(columns)) for _ in range(rows)) + "\n"
                continue
            text += " ".join(word() for _ in range(rnd.randrange(1, 4))) + " "
            kind = rnd.randrange(9)
            if kind < 5:
                cued = kind == 4
                kind = min(kind, 3)
                if cued or rnd.random() < 0.3:
                    text += rnd.choice(cues[kind]) + rnd.choice([" ", ": ", " : "])
                made = cued_phone() if cued else makers[kind]()
                spans.append((len(text), kind, len(text) + len(made)))
                if kind == 3 and rnd.random() < 0.1:
                    text += made + " / "
                    made = phone()
                    spans.append((len(text), kind, len(text) + len(made)))
            else:
                made = other()
            text += made + rnd.choice([" ", ", ", ". ", "\n"])
        yield text, spans


@functools.lru_cache(maxsize=4)
def train(seed: int = SEED, n: int = 700, rounds: int = 5, rate: float = 0.5) -> SemiMarkov:
    """The model of a seed; made once a process."""
    model, rnd = SemiMarkov(), random.Random(seed)
    data = []
    for text, spans in _sentences(rnd, n):
        base = base_spans(text)
        gold = {(s, e): k for s, k, e in spans}
        for c in candidates(text, base):
            for rows in _clusters(c):
                at = [(int(c.start[i]), int(c.end[i])) for i in rows]
                # of segments at one place one is the truth
                labels = [gold.get(x, -1) for x in at]
                data.append((Candidates(None, None, None, c.x[rows].astype(float), c.address), at, np.array(labels)))
    squares, square_moves = np.zeros_like(model.weights), np.zeros_like(model.moves)
    for _ in range(rounds):
        rnd.shuffle(data)
        for c, at, labels in data:
            share, moves, _ = model.expected(at, model.scores(c))
            seen = np.flatnonzero(labels >= 0)
            share[seen, labels[seen]] -= 1
            last = len(KINDS)
            for i in sorted(seen, key=lambda i: at[i]):
                moves[last, labels[i]] -= 1
                last = labels[i]
            for table, total, g in ((model.weights, squares, share.T @ c.x), (model.moves, square_moves, moves)):
                g = g + 0.0005 * table
                total += g * g
                table -= rate * g / np.sqrt(1e-2 + total)
    return model


def added_spans(text: str, base: list[tuple[int, int, int]], model: SemiMarkov) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the spans the field finds between the base spans."""
    found: list[tuple[int, int, int]] = []
    left: dict = {}
    for c in candidates(text, base):
        score = model.scores(c)
        for i in np.flatnonzero(model.hopeful(score)):
            spans, scores = left.setdefault((c.address, int(c.cluster[i])), ([], []))
            spans.append((int(c.start[i]), int(c.end[i])))
            scores.append(score[i])
    for spans, scores in left.values():
        found += model.decode(spans, np.array(scores))
    # an address and a number may claim one place: the address, which holds the more, stays
    taken, out = 0, []
    for s, k, e in sorted(found, key=lambda x: (x[0], -x[2])):
        if s >= taken:
            out.append((s, k, e))
            taken = e
    return out


def written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def find_pii(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", model: SemiMarkov | None = None) -> DataFrame:
    """(id, base, added) per row, base and added arrays of (start, kind, end)."""
    model = model or train()
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))

    def find(batches):
        for batch in batches:
            for part in K.pieces(batch, "text"):
                base, added = [], []
                for text in part.column("text").to_pylist():
                    text = text or ""
                    one = base_spans(text)
                    base.append([{"start": s, "kind": KINDS[k], "end": e} for s, k, e in one])
                    added.append([{"start": s, "kind": KINDS[k], "end": e} for s, k, e in added_spans(text, one, model)])
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(base, kind), pa.array(added, kind)], names=["id", "base", "added"])

    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    spans = "array<struct<start:int,kind:string,end:int>>"
    return rows.mapInArrow(find, f"id long, base {spans}, added {spans}")


def masked(text: str, spans) -> str:
    """Text with each span replaced by its kind in angle brackets; overlapping spans merge into the first."""
    out, at = [], 0
    for s, k, e in sorted(spans):
        if s >= at:
            out += [text[at:s], f"<{KINDS[k]}>"]
        at = max(at, e)
    return "".join(out) + text[at:]


def digest_text(spans):
    """Spans as kind:start:end by start and then kind as listed, comma-joined; for array columns."""
    order = F.create_map(*[x for k, name in enumerate(KINDS) for x in (F.lit(name), F.lit(k))])
    ranked = F.sort_array(F.transform(spans, lambda x: F.struct(x["start"].alias("s"), F.element_at(order, x["kind"]).alias("k"), x["end"].alias("e"), x["kind"].alias("name"))))
    return F.array_join(F.transform(ranked, lambda x: F.concat_ws(":", x["name"], x["s"], x["e"])), ",")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(k) for k in KINDS]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(digest_text(F.col("base")), 256).alias("base_sha256"), digest_text(F.concat("base", "added")).alias("spans"))
