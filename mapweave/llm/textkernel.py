"""Vectorised tokenising and hashing of Arrow string batches.

All functions work on UTF-8 bytes with numpy and never look at one row at a
time.  Words are the maximal runs of bytes outside ``\\x20`` and
``\\x09-\\x0D``; A-Z is folded to a-z; every other byte is kept as it is, so
words equal under this rule have equal hashes whatever the batch they came in.

Memory is bounded by ``PIECE`` bytes of text at a time (a longer run without
any separator is taken whole) plus eight bytes for each word of the batch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
SHINGLE = 5

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint64) + np.uint64(1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1, dtype=np.uint64) + np.uint64(1)

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least n of each."""
    if len(_powers[0]) < n:
        size = 1 << max(PIECE.bit_length(), (n - 1).bit_length())
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64, so that every bit depends on every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def mix_int(x: int) -> int:
    return int(mix(np.array([x & _MASK], np.uint64))[0])


def seeds(n: int, salt: int) -> np.ndarray:
    """n fixed odd multipliers, made by rule from a salt."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(salt)) | np.uint64(1)


_SHINGLE_SEEDS = seeds(SHINGLE, 17)
_FEW = np.uint64(0xA24BAED4963EE407)


@dataclass
class Words:
    """Word hashes of a batch; those of row i are hashes[first[i]:first[i + 1]]."""

    hashes: np.ndarray
    first: np.ndarray

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def buffers(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string array; null counts as empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    if text.null_count:
        text = text.fill_null("")
    wide = pa.types.is_large_string(text.type)
    _, offsets, data = text.buffers()
    n = len(text)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[text.offset : text.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def words(text: pa.Array) -> Words:
    data, offsets = buffers(text)
    found, starts = [], []
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    pos, n = 0, len(data)
    while pos < n:
        end = min(n, pos + PIECE)
        if end < n:
            gaps = np.flatnonzero(_SEPARATOR[data[pos:end]])
            if len(gaps):
                end = pos + int(gaps[-1]) + 1
            else:
                while end < n and not _SEPARATOR[data[end]]:
                    gaps = np.flatnonzero(_SEPARATOR[data[end : end + PIECE]])
                    end = end + int(gaps[0]) if len(gaps) else min(n, end + PIECE)
        part = data[pos:end]
        inside = ~_SEPARATOR[part]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[pos + 1 : end]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | edge[pos + 1 : end]
        s, e = np.flatnonzero(begins), np.flatnonzero(ends)
        up, down = _power_tables(len(part))
        total = np.cumsum(_FOLD[part] * up[: len(part)], dtype=np.uint64)
        before = np.where(s > 0, total[np.maximum(s, 1) - 1], np.uint64(0))
        found.append(mix((total[e] - before) * down[s] + (e - s).astype(np.uint64)))
        starts.append(s + pos)
        pos = end
    hashes = np.concatenate(found) if found else np.zeros(0, np.uint64)
    at = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return Words(hashes, np.searchsorted(at, offsets))


def shingles(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of five words; a row of one to four words gives one for its whole sequence."""
    h, n = w.hashes, np.diff(w.first)
    row = w.row_of()
    if len(h) >= SHINGLE:
        m = len(h) - SHINGLE + 1
        run = np.zeros(m, np.uint64)
        for k in range(SHINGLE):
            run += h[k : k + m] * _SHINGLE_SEEDS[k]
        whole = row[:m] == row[SHINGLE - 1 :]
        rows, out = row[:m][whole], mix(run[whole])
    else:
        rows, out = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    few = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(few):
        short = np.zeros(len(few), np.uint64)
        for k in range(SHINGLE - 1):
            has = n[few] > k
            short[has] += h[w.first[few[has]] + k] * _SHINGLE_SEEDS[k]
        short = mix(short + n[few].astype(np.uint64) * _FEW)
        rows, out = np.concatenate([rows, few]), np.concatenate([out, short])
    return rows, out


def runs(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of n words, n below five; the hash is that of a whole text of these words."""
    m = len(w.hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row = w.row_of()
    run = np.zeros(m, np.uint64)
    for k in range(n):
        run += w.hashes[k : k + m] * _SHINGLE_SEEDS[k]
    whole = row[:m] == row[n - 1 :]
    return row[:m][whole], mix(run[whole] + np.uint64(n) * _FEW)


def shingle_sets(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash), by row and then hash; and where each row's set begins."""
    rows, h = shingles(w)
    order = np.lexsort((h, rows))
    rows, h = rows[order], h[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (h[1:] != h[:-1])
        rows, h = rows[new], h[new]
    return h, np.searchsorted(rows, np.arange(len(w.first)))


def pieces(batch: pa.RecordBatch, text: str, limit: int = 4 << 20):
    """Slices of a batch with at most `limit` bytes of text each, or one row."""
    _, offsets = buffers(batch.column(text))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield batch.slice(i, min(n, j) - i)
        i = min(n, j)
