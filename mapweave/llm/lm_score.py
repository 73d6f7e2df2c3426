"""Language-model scoring with a weighted backoff automaton.

The model is an n-gram model with absolute discounting.  Over the training
documents, each a start symbol, its words and one end token, let c(g) count
the n-gram g, C(h) and T(h) the tokens and the distinct tokens that follow the
history h, and D(k) the discount of order k, n1 / (n1 + 2 n2) by the numbers of
k-grams that occur once and twice.  Then

    p1(w)     = (c(w) + 1) / (N + V + 1)
    pk(w | h) = max(0, c(h w) - D(k)) / C(h) + D(k) T(h) / C(h) * p(k-1)(w | h')

where h' is h without its first token.  As an automaton (`Automaton`): a state
is a history of up to order - 1 tokens that occurs; its arcs are the tokens
seen after it, with weight log10 pk, and lead to the longest state that ends
the history so far; its failure arc leads to the state of h' with weight
log10(D(k) T(h) / C(h)) and is taken where there is no arc.  The root has an
arc for every token.  `Automaton.walk` goes over the tokens once from left to
right, carries the state and adds up the weights.  Documents are walked side
by side; a long one is cut into lanes, each begun order - 1 tokens early,
after which the state no longer depends on where the walk began.

Nothing is cut off: all n-grams of all training documents count, and the
automaton is never in one place: a block of documents walks the part of it
that its own n-grams can reach.  Documents are packed once into blocks of a
few megabytes (token numbers and the block's word hashes), written as a table
bucketed by block, which later passes read without moving it.  Rounds of asking gather
what a block needs: it sends its distinct n-grams with its own counts by hash
range, each range adds up the counts of all blocks and answers in the order
in which it was asked.  An n-gram whose first or last part occurs no more
often in all, held-out documents included, than the n-gram does in the block
has no other occurrence and isn't asked.  Each range names one block the owner of an n-gram, so that
blocks can add up T(h) by the n-grams they own; where C(h) = 1, T(h) is 1.
A word of every block costs one entry a block, however often it occurs.

At scale: what is sent is linear in the input, as a message holds one distinct
n-gram or more.  Ranges grow in number with the input and each is one task by
its number, of RANGE_TOKENS entries or fewer; at most STATE of a block and one
range's entries are in memory at a time.  Nothing but a few sums is collected.

Results: null text counts as empty and has the end token alone.  A document
without id isn't held out.  Repeated rows count and are scored each.  An empty
table gives no rows; without training documents every token has weight 0.
Very long texts are one block each.  Only id and text are read, so other
columns and their names don't matter.  There are no ties to break.  N-grams
are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as K
from .common import Scratch, crc_mod

#: Bytes of text in a block, at most (or one document); tokens of the input for each range of a kind.
BLOCK_BYTES, RANGE_TOKENS = 6 << 20, 2_500_000
#: Tokens of a document that one lane walks.
LANE = 256
START, END = np.uint64(K.mix_int(0x73746172740001)), np.uint64(K.mix_int(0x656E6400000002))
ORDER = 3
#: Bounds of the discounts, and the discount where no n-gram occurs once.
LEAST_D, MOST_D, PLAIN_D = 0.05, 0.95, 0.5

_STATE = "n_tokens long, ids array<long>, held array<boolean>, lengths array<int>, tokens binary, n_words long, words binary"
_ASKED = "slot int, kind int, range int, block long, n long, keys binary, counts binary, others binary, once long, twice long"
_ANSWER = "kind int, range int, block long, n long, totals binary, others binary, types long, tokens long, once long, twice long"


def pack(values: np.ndarray) -> bytes:
    """Integers by byte planes, compressed; what is small or alike takes little room."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def _pack_some(values: np.ndarray) -> bytes:
    """As pack; nothing where all are 0."""
    return pack(values) if values.any() else b""


def unpack(blob: bytes, n: int, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(blob, n * width, codec="zstd"), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpack(blob, n, np.uint64), dtype=np.uint64)


def sort_hashes(keys: np.ndarray) -> np.ndarray:
    """The stable order of hashes: upper bits and place are sorted as one number; where upper bits don't tell, all bits are."""
    bits = np.uint64(max(1, len(keys)).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    packed = np.sort((keys & ~low) | np.arange(len(keys), dtype=np.uint64))
    order = (packed & low).astype(np.int64)
    upper, found = packed >> bits, keys[order]
    alike = (upper[1:] == upper[:-1]) & (found[1:] != found[:-1])
    return np.argsort(keys, kind="stable") if alike.any() else order


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes, and the number of each."""
    order = sort_hashes(keys)
    found = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = found[1:] != found[:-1]
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return found[new], number


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_()), "array<int>": pa.list_(pa.int32())}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[k]) for x, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _pack_documents(batches):
    for batch in batches:
        for part in K.pieces(batch, "text", BLOCK_BYTES):
            w = K.words(part.column("text"))
            n = np.diff(w.first)
            # each document: the start symbol, its words, the end token
            hashes = np.insert(w.hashes, np.repeat(w.first[1:], 2) if len(n) else [], np.tile([END, START], len(n)))
            hashes = np.concatenate([[START], hashes[:-1]]).astype(np.uint64)
            known, number = distinct(hashes)
            yield _batch(_STATE, [[len(hashes)], [part.column("id").to_pylist()], [part.column("held_out").to_pylist()], [(n + 2).tolist()], [pack(number.astype(np.uint32))], [len(known)], [pack_sorted(known)]])


_NOTHING = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


class Level:
    """The distinct k-grams of a block: sorted keys, the number of each, and what they begin and end with."""

    def __init__(self, keys: np.ndarray, at: np.ndarray, prefix, suffix, own: np.ndarray, other: np.ndarray):
        #: at: for each token the k-gram that ends there, or -1; prefix, suffix: numbers of the (k-1)-grams without the last and the first token;
        #: own, other: how often they stand in the block's training and held-out documents; total, elsewhere: in all blocks'.
        self.keys, self.at, self.prefix, self.suffix, self.own, self.other = keys, at, prefix, suffix, own, other
        self.total: np.ndarray | None = None
        self.elsewhere: np.ndarray | None = None
        self.owned: np.ndarray | None = None
        self.types: np.ndarray | None = None


class Block:
    """A packed block of documents and its distinct n-grams of each order, with what is known of them so far."""

    def __init__(self, row: dict, order: int):
        self.ids, self.held = row["ids"], np.array(row["held"], bool)
        self.lengths = np.array(row["lengths"], np.int64)
        self.number = unpack(row["tokens"], row["n_tokens"], np.uint32).astype(np.int64)
        words = unpack_sorted(row["words"], row["n_words"])
        self.first = np.cumsum(self.lengths) - self.lengths
        place = np.arange(len(self.number)) - np.repeat(self.first, self.lengths)
        learned = np.repeat(~self.held, self.lengths)
        self.start, self.end = int(np.searchsorted(words, START)), int(np.searchsorted(words, END))
        mine = words[self.number]
        count = lambda number, of, n: (np.bincount(number[of], minlength=n), np.bincount(number[~of], minlength=n))
        self.levels = [Level(words, self.number, None, None, *count(self.number, learned, len(words)))]
        self.last = [np.arange(len(words))]
        key = mine
        for k in range(2, order + 1):
            key = np.concatenate([np.zeros(1, np.uint64), key[:-1]])
            key = K.mix(key * np.uint64(0x9E3779B97F4A7C15) + mine + np.uint64(k))
            there = np.flatnonzero(place >= k - 1)
            keys, number = distinct(key[there])
            below = self.levels[-1].at
            prefix, suffix, last = (np.empty(len(keys), np.int64) for _ in range(3))
            prefix[number], suffix[number], last[number] = below[there - 1], below[there], self.number[there]
            at = np.full(len(mine), -1)
            at[there] = number
            self.levels.append(Level(keys, at, prefix, suffix, *count(number, learned[there], len(keys))))
            self.last.append(last)

    def asked(self, k: int) -> np.ndarray:
        """The k-grams whose total can't be told without the other blocks."""
        level = self.levels[k - 1]
        if k <= 2:
            return np.ones(len(level.keys), bool)
        below = self.levels[k - 2].total + self.levels[k - 2].elsewhere
        return np.minimum(below[level.prefix], below[level.suffix]) > level.own + level.other

    def histories(self, k: int) -> np.ndarray:
        """The k-grams that are states with more than one token after them."""
        return (self.levels[k - 1].total > 1) & (self.last[k - 1] != self.end)

    def learn(self, answers: dict[int, np.ndarray]) -> None:
        """Take the answers by kind: 2k for counts of k-grams, 2k + 1 for distinct tokens after k-grams."""
        for k, level in enumerate(self.levels, 1):
            if 2 * k in answers or (k > 2 and self.levels[k - 2].total is not None and f"asked{k}" in answers):
                mask, (found, elsewhere) = self.asked(k), answers.get(2 * k, _NOTHING)
                level.total, level.elsewhere, level.owned = level.own.copy(), level.other.copy(), level.own > 0
                level.total[mask], level.elsewhere[mask], level.owned[mask] = found >> np.uint64(1), elsewhere, (found & np.uint64(1)) > 0
            if f"types{k}" in answers:
                mask = self.histories(k)
                level.types = np.minimum(level.total, 1)
                level.types[mask] = answers.get(2 * k + 1, _NOTHING)[0] >> np.uint64(1)


def rounds(order: int) -> list[list[int]]:
    """Kinds that are asked in each round: what later ones need comes first."""
    out = [[2 * k for k in (1, 2) if k <= order]]
    for r in range(2, order + 1):
        out.append([2 * (r + 1)] * (r < order) + [2 * (r - 1) + 1])
    return out


def _known(answers: pa.Table, done: list[int]) -> dict:
    """Answers by kind in the order in which they were asked."""
    rows = sorted(answers.to_pylist(), key=lambda x: (x["kind"], x["range"]))
    found: dict = {f"asked{k // 2}" if k % 2 == 0 else f"types{k // 2}": True for k in done}
    for kind in {r["kind"] for r in rows}:
        found[kind] = tuple(np.concatenate([unpack(r[c], r["n"], np.uint64) if r[c] else np.zeros(r["n"], np.uint64) for r in rows if r["kind"] == kind]) for c in ("totals", "others"))
    return found


def _messages(block: Block, number: int, kinds: list[int], n_ranges: int):
    starts = np.array([(x << 64) // n_ranges for x in range(n_ranges)], np.uint64)
    for place, kind in enumerate(kinds):
        k = kind // 2
        level = block.levels[k - 1]
        if kind % 2 == 0:
            mask, counts, others = block.asked(k), level.own, level.other
            alone = level.own[~mask]
        else:
            above = block.levels[k]
            mask, alone = block.histories(k), np.zeros(0, np.int64)
            counts = np.bincount(above.prefix[above.owned], minlength=len(level.keys))
            others = np.zeros_like(counts)
        keys, counts, others = level.keys[mask], counts[mask].astype(np.uint32), others[mask].astype(np.uint32)
        cut = np.append(np.searchsorted(keys, starts), len(keys))
        full = np.flatnonzero(np.diff(cut))
        single = [int((alone == x).sum()) for x in (1, 2)]
        if not len(full) and any(single):
            full = np.zeros(1, np.int64)
        some = len(full)
        parts = [[f(x[cut[r] : cut[r + 1]]) for r in full] for f, x in ((pack_sorted, keys), (pack, counts), (_pack_some, others))]
        alone_of = [[s] + [0] * (some - 1) if some else [] for s in single]
        yield _batch(_ASKED, [full + place * n_ranges, [kind] * some, full, [number] * some, np.diff(cut)[full], *parts, *alone_of])


def _first_round(order: int, kinds: list[int], n_ranges: int):
    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield from _messages(Block(row, order), row["block"], kinds, n_ranges)

    return ask


def _next_round(order: int, done: list[int], kinds: list[int], n_ranges: int):
    def ask(state: pa.Table, answers: pa.Table) -> pa.Table:
        row = state.to_pylist()[0]
        block = Block(row, order)
        block.learn(_known(answers, done))
        return pa.Table.from_batches(_messages(block, row["block"], kinds, n_ranges))

    return ask


def _add_up(rows: list[dict]) -> pa.RecordBatch:
    """All that is asked of one range: totals over the blocks, in each block's order; the last bit names the first block that has the n-gram its owner."""
    n = np.array([r["n"] for r in rows])
    keys = np.concatenate([unpack_sorted(r["keys"], r["n"]) for r in rows])
    counts, others = (np.concatenate([unpack(r[c], r["n"], np.uint32) if r[c] else np.zeros(r["n"], np.uint32) for r in rows]).astype(np.uint64) for c in ("counts", "others"))
    order = sort_hashes(keys)
    keys, counts, others = keys[order], counts[order], others[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    group = np.cumsum(new) - 1
    total, elsewhere = (np.add.reduceat(x, np.flatnonzero(new)) if len(keys) else x for x in (counts, others))
    has = np.flatnonzero(counts > 0)
    owners = has[np.unique(group[has], return_index=True)[1]]
    answer, rest = np.empty(len(keys), np.uint64), np.empty(len(keys), np.uint64)
    bit = np.zeros(len(keys), np.uint64)
    bit[owners] = 1
    answer[order], rest[order] = total[group] * np.uint64(2) + bit, elsewhere[group]
    ends = np.cumsum(n)
    head = lambda x: [int(x)] + [0] * (len(rows) - 1)
    alone = [sum(r[x] for r in rows) for x in ("once", "twice")]
    # the start symbol isn't a token
    start = total[group[np.searchsorted(keys, START)]] if rows[0]["kind"] == 2 and START in keys else 0
    return _batch(
        _ANSWER,
        [[r["kind"] for r in rows], [r["range"] for r in rows], [r["block"] for r in rows], n, *([f(x[e - m : e]) for e, m in zip(ends, n, strict=True)] for f, x in ((pack, answer), (_pack_some, rest)))]
        + [head(np.count_nonzero(total) - (start > 0)), head(int(total.sum()) - int(start)), head((total == 1).sum() + alone[0]), head((total == 2).sum() + alone[1])],
    )


def _answers(batches):
    """Rows come sorted by slot; each run of one slot is one range of one kind."""
    slot, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row["slot"] != slot:
                yield _add_up(held)
                held = []
            slot = row["slot"]
            held.append(row)
    if held:
        yield _add_up(held)


class Automaton:
    """States, arcs and failure arcs over the n-grams of one block; discounts[k - 2] is D(k)."""

    def __init__(self, block: Block, n_tokens: int, n_types: int, discounts: list[float]):
        levels, self.n_words = block.levels, len(block.levels[0].keys)
        order = len(levels)
        # states: the root, then the words, then the longer histories by length
        offset = np.cumsum([1, *(len(level.keys) for level in levels[: order - 1])])
        n_states = int(offset[-1])
        self.fail_to, self.fail = np.zeros(n_states, np.int64), np.zeros(n_states)
        p = (levels[0].total + 1.0) / (n_tokens + n_types + 1.0)
        self.base = np.log10(p)
        is_state = [(level.total > 0) & (last != block.end) for level, last in zip(levels, block.last, strict=True)]
        target = np.where(is_state[0], offset[0] + np.arange(self.n_words), 0) if order > 1 else np.zeros(self.n_words, np.int64)
        self.root_to = target
        keys, weights, targets = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int64)]
        for k in range(2, order + 1):
            level, below, d = levels[k - 1], levels[k - 2], discounts[k - 2]
            many = np.maximum(below.total, 1)
            rest = np.where(is_state[k - 2], d * below.types / many, 1.0)
            states = offset[k - 2] + np.arange(len(below.keys))
            self.fail[states] = np.log10(np.maximum(rest, 1e-300))
            if k > 2:
                self.fail_to[states] = offset[k - 3] + below.suffix
            seen = np.flatnonzero(level.total)
            prefix, suffix = level.prefix[seen], level.suffix[seen]
            p_new = np.zeros(len(level.keys))
            p_new[seen] = (level.total[seen] - d) / many[prefix] + rest[prefix] * p[suffix]
            keys.append((offset[k - 2] + prefix) * self.n_words + block.last[k - 1][seen])
            weights.append(np.log10(p_new[seen]))
            if k < order:
                target = np.where(is_state[k - 1], offset[k - 1] + np.arange(len(level.keys)), target[level.suffix])
                targets.append(target[seen])
            else:
                targets.append(target[suffix])
            p = p_new
        key = np.concatenate(keys)
        by = np.argsort(key)
        self.keys, self.weights, self.targets = key[by], np.concatenate(weights)[by], np.concatenate(targets)[by]
        self.arcs = np.searchsorted(self.keys, np.arange(n_states + 1) * self.n_words)
        self.begin = int(self.root_to[block.start]) if order > 1 and len(block.ids) else 0
        self.memory = order - 1

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next state, weight) of reading one word in each state, over failure arcs where there is no arc."""
        weight, then = np.zeros(len(state)), np.zeros(len(state), np.int64)
        left = np.arange(len(state))
        while len(left):
            at_root = state[left] == 0
            done = left[at_root]
            weight[done] += self.base[word[done]]
            then[done] = self.root_to[word[done]]
            left = left[~at_root]
            if not len(left):
                break
            at = state[left]
            wanted = at * self.n_words + word[left]
            arc = self.arcs[at]
            several = np.flatnonzero(self.arcs[at + 1] - arc > 1)
            arc[several] = np.searchsorted(self.keys, wanted[several])
            arc = np.minimum(arc, max(0, len(self.keys) - 1))
            hit = self.keys[arc] == wanted if len(self.keys) else np.zeros(len(left), bool)
            done, arc = left[hit], arc[hit]
            weight[done] += self.weights[arc]
            then[done] = self.targets[arc]
            left = left[~hit]
            weight[left] += self.fail[state[left]]
            state = state.copy()
            state[left] = self.fail_to[state[left]]
        return then, weight

    def walk(self, number: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Total weight of each document: one pass from left to right over lanes of LANE tokens."""
        n = lengths - 1  # the start symbol isn't read
        lanes = -(-n // LANE)
        doc = np.repeat(np.arange(len(n)), lanes)
        lane = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        early = np.where(lane > 0, self.memory, 0)
        begin = first[doc] + 1 + lane * LANE - early
        size = np.minimum(n[doc] - lane * LANE, LANE) + early
        by = np.argsort(-size, kind="stable")
        doc, begin, size, early, lane = doc[by], begin[by], size[by], early[by], lane[by]
        state = np.where(lane == 0, self.begin, 0)
        total = np.zeros(len(doc))
        for t in range(int(size[0]) if len(size) else 0):
            m = int(np.searchsorted(-size, -t, "left"))  # lanes longer than t come first
            state[:m], weight = self.step(state[:m], number[begin[:m] + t])
            total[:m] += np.where(t >= early[:m], weight, 0.0)
        return np.bincount(doc, total, minlength=len(n))


def _score(order: int, done: list[int], n_tokens: int, n_types: int, discounts: list[float]):
    def score(state: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(state.to_pylist()[0], order)
        block.learn(_known(answers, done))
        automaton = Automaton(block, n_tokens, n_types, discounts)
        weight = automaton.walk(block.number, block.first, block.lengths)
        token = np.ones(len(block.number), bool)
        token[block.first] = False
        doc = np.repeat(np.arange(len(block.lengths)), block.lengths)[token]
        number = block.number[token]
        per_doc = lambda x: np.bincount(doc, x[number], minlength=len(block.lengths))
        return pa.table(
            {
                "id": pa.array(block.ids, pa.int64()),
                "held_out": block.held,
                "n_tokens": block.lengths - 1,
                "n_known": per_doc(block.levels[0].total > 0).astype(np.int64),
                "train_tokens": np.full(len(block.lengths), n_tokens),
                "base_score": per_doc(automaton.base),
                "score": weight,
            }
        )

    return score


def lm_scores(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", order: int = ORDER, held_out=None, discounts: list[float] | None = None) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row; trained on the rows that aren't held out."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    held = F.coalesce(crc_mod(id_column, 7) == 2 if held_out is None else held_out, F.lit(False))
    rows = docs.select(F.col(id_column).cast("long").alias("id"), held.alias("held_out"), F.col(text_column).alias("text"))
    packed = rows.mapInArrow(_pack_documents, _STATE).withColumn("block", F.monotonically_increasing_id())
    state = scratch.store_bucketed(packed, "block", int(spark.conf.get("spark.sql.shuffle.partitions")))
    size = state.agg(F.sum("n_tokens").alias("n")).first().n or 0
    n_ranges = max(1, -(-size // RANGE_TOKENS))
    answers, done = None, []
    for kinds in rounds(order):
        if answers is None:
            asked = state.mapInArrow(_first_round(order, kinds, n_ranges), _ASKED)
        else:
            asked = state.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_next_round(order, list(done), kinds, n_ranges), _ASKED)
        dealt = asked.repartitionById(len(kinds) * n_ranges, "slot").sortWithinPartitions("slot")
        answer = scratch.store(dealt.mapInArrow(_answers, _ANSWER))
        answers = answer if answers is None else answers.unionByName(answer)
        done += kinds
    sums = {r.kind: r for r in answers.groupBy("kind").agg(*[F.sum(c).alias(c) for c in ("types", "tokens", "once", "twice")]).collect()}
    if discounts is None:
        counts = [sums.get(2 * k) for k in range(2, order + 1)]
        discounts = [min(MOST_D, max(LEAST_D, r.once / (r.once + 2 * r.twice))) if r is not None and r.once else PLAIN_D for r in counts]
    words = sums.get(2)
    score = _score(order, done, words.tokens if words else 0, words.types if words else 0, discounts)
    return state.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")

