"""Language-model scores by a hierarchical Pitman-Yor process.

A token is drawn in the restaurant of its context, the word before it (or the start of the text); all contexts share
their parent, the root, whose base is uniform over the training words and one unknown word.  Seating arrangements are
sampled by Gibbs steps that revisit every customer of every dish: it sits at a table of the dish by its size less the
discount, or at a new one by the parent's probability; every table is a customer of the root.  Only the number of tables
matters to a probability, so dishes of up to ``EXACT`` customers draw it from its distribution given all else
(generalised Stirling numbers); in larger ones all customers rise and sit down again in ``ROUNDS`` random groups.
Seating starts from one table a dish.  A pass is ``SWEEPS`` steps of all customers; after ``BURN_IN`` passes, the
predictive probabilities of ``SAMPLES`` more are averaged.  Discounts are estimated once from the numbers of dishes with
one and two customers, the strength is a constant.

On a cluster, pairs (word, context) are dealt out by ranges of the word's hash, so that a shard seats all dishes of its
words and their root.  Words that make up at least 1 / ``HOT`` of all tokens (at most 2 * ``HOT`` words, a list that is
broadcast) are dealt by pair instead, as one of them may be a large part of the corpus; their root is seated from the sum
over the shards.  What a step needs of other shards is how many tables each context has: a table of the size of the
distinct pairs, summed by context and sent back after every pass.  Within a pass, other shards' tables are held fixed.
Probabilities are taken with the sums of the very arrangement that they are made of, so those of a context add up to 1.

Texts are tokenised once, in blocks; a block sends each shard the distinct pairs that it needs with its training counts,
packed, and gets their probabilities back.  Contexts are known by 40 bits of their hash.  Everything that depends on the
size of the vocabulary or of the corpus stays in such shards and blocks.

Defined cases: a null text is empty and has the end token alone; without training rows every token is unknown and has
probability 1; equal rows are scored alike; a null key counts as the empty text when rows are held out.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake.llm.common import chunks_of, drop_saved, mix, run_hashes, runs, saved, strings

#: Characters of a block, and of the corpus for each shard.
BLOCK_CHARS, SHARD_CHARS = 4_000_000, 12_000_000
STRENGTH = 1.0
HOT = 4096
#: Most customers of a dish whose tables are drawn at once; groups in which the customers of larger ones move.
EXACT, ROUNDS = 1024, 4
BURN_IN, SAMPLES, SWEEPS, STEPS = 1, 2, 2, 1
END = mix(np.array([0xE0D], np.uint64))[0]


def _table() -> tuple[np.ndarray, np.ndarray]:
    """For each byte: its lower case, and whether it is white space."""
    low, space = np.arange(256, dtype=np.uint8), np.zeros(256, bool)
    low[65:91] += 32
    space[[0x20, *range(0x09, 0x0E)]] = True
    return low, space


_LOW, _SPACE = _table()


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every token of all texts, in order, and the number of tokens of each text; an end token closes a text."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    buffer = _LOW[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
    at = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    start, end = runs(~_SPACE[buffer])
    owner = np.searchsorted(at, start, side="right") - 1
    hashes = np.full(len(start) + len(texts), END, np.uint64)
    hashes[np.arange(len(start)) + owner] = run_hashes(buffer, start, end)
    return hashes, np.bincount(owner, minlength=len(texts)) + 1


def _pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def _unpack(b: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def _pack40(a: np.ndarray) -> bytes:
    return a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpack40(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(b, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _pack_halves(a: np.ndarray) -> bytes:
    """Numbers below 2**32 that are mostly small: low halves, then high halves."""
    a = a.astype(np.uint32)
    return _pack(np.concatenate([a & 0xFFFF, a >> 16]).astype(np.uint16))


def _unpack_halves(b: bytes) -> np.ndarray:
    low, high = _unpack(b, np.uint16).reshape(2, -1).astype(np.int64)
    return low | high << 16


# --- blocks of texts -------------------------------------------------------------------------------------------------

_BLOCK_ROW = "block long, ids array<long>, held array<boolean>, words binary, count binary, token binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of texts: their words, the number of tokens of each text, and each token's place among the words."""
    from pyspark import TaskContext

    def one(block: int, ids: list, held: list[bool], texts: list[str]) -> pa.RecordBatch:
        hashes, count = (np.concatenate(x) for x in zip(*(tokens(texts[lo:hi]) for lo, hi in chunks_of(texts)), strict=True))
        words, token, n = np.unique(hashes, return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")  # frequent words have small numbers
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        words, token = words[order], rank[token]
        row = [pa.array([block], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_()))]
        row += [pa.array([x], pa.binary()) for x in (words.tobytes(), _pack(count.astype(np.uint32)), _pack_halves(token))]
        return pa.RecordBatch.from_arrays(row, ["block", "ids", "held", "words", "count", "token"])

    block, ids, held, texts, size = TaskContext.get().partitionId() << 32, [], [], [], 0
    for batch in batches:
        for i, h, t in zip(batch.column("id").to_pylist(), batch.column("held").to_pylist(), strings(batch.column("t")), strict=True):
            ids.append(i)
            held.append(h)
            texts.append(t)
            size += len(t)
            if size >= BLOCK_CHARS:
                yield one(block, ids, held, texts)
                block, ids, held, texts, size = block + 1, [], [], [], 0
    if ids:
        yield one(block, ids, held, texts)


@dataclass(frozen=True)
class Block:
    """A block's texts as pairs, ordered by shard, word, context."""

    words: np.ndarray
    sizes: np.ndarray  # tokens of each text
    pair: np.ndarray  # of each token
    word: np.ndarray  # of each pair
    context: np.ndarray
    train: np.ndarray  # count of each pair
    cut: np.ndarray  # pairs of each shard

    @staticmethod
    def of(row: dict, shards: int, hot: np.ndarray) -> Block:
        words, sizes = np.frombuffer(row["words"], np.uint64), _unpack(row["count"], np.uint32).astype(np.int64)
        order = np.argsort(words)
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        words, token = words[order], rank[_unpack_halves(row["token"])]
        before = np.concatenate([[np.searchsorted(words, END)], token[:-1]])  # after an end token: the start of a text
        codes, pair = np.unique(token * len(words) + before, return_inverse=True)
        word, context = codes // len(words), codes % len(words)
        train = np.bincount(pair[np.repeat(~np.array(row["held"]), sizes)], minlength=len(codes)).astype(np.uint32)
        shard = _shard_of(np.where(np.isin(words, hot)[word], mix(words[word] ^ mix(words[context])), words[word]), shards)
        order = np.argsort(shard, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        return Block(words, sizes, place[pair], word[order], context[order], train[order], np.searchsorted(shard[order], np.arange(shards + 1)))

    def part(self, s: int) -> tuple[np.ndarray, np.ndarray]:
        """Words of a shard's pairs, ascending, and how many pairs each has."""
        return np.unique(self.word[self.cut[s] : self.cut[s + 1]], return_counts=True)


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of the hash, so that ordered words have ordered shards."""
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with a share of at least 1 / (2 * HOT) of a block's tokens; and the number of those (word 0)."""
    for batch in batches:
        for row in batch.to_pylist():
            n = np.bincount(_unpack_halves(row["token"]))
            some = np.flatnonzero(n * 2 * HOT >= n.sum())
            words = np.frombuffer(row["words"], np.uint64)[some].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([words, [0]]), pa.int64()), pa.array(np.concatenate([n[some], [n.sum()]]), pa.int64())], ["word", "n"])


_ASK = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("words", pa.binary()), ("per", pa.binary()), ("contexts", pa.binary()), ("train", pa.binary())])


def _asks(shards: int, hot: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A block's pairs for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b, out = Block.of(row, shards, hot), []
                for s in np.flatnonzero(np.diff(b.cut)):
                    words, per = b.part(s)
                    mine = slice(b.cut[s], b.cut[s + 1])
                    out.append({"shard": int(s), "block": row["block"], "words": b.words[words].tobytes(), "per": _pack(per.astype(np.uint32)), "contexts": _pack40(b.words[b.context[mine]] >> np.uint64(24)), "train": _pack(b.train[mine])})
                yield _batch(out, _ASK)

    return run


# --- seating ---------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=4)
def _stirling(discount: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers of n customers at t tables."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[1, 1] = 0.0
    for n in range(1, EXACT):
        t = np.arange(1, n + 1)
        out[n + 1, 1 : n + 1] = np.log(n - t * discount) + out[n, 1 : n + 1]
        out[n + 1, 1 : n + 2] = np.logaddexp(out[n + 1, 1 : n + 2], out[n, : n + 1])
    return out


class Seating:
    """Customers and tables of many dishes at once.

    Of dishes that may have more than ``EXACT`` customers, the dish and size of each table are kept too, ordered by dish.
    """

    def __init__(self, customers: np.ndarray, possible: np.ndarray, drawn: np.random.Generator) -> None:
        self.customers, self.tables, self.everyone, self.drawn = customers.astype(np.int64), np.ones(len(customers), np.int64), len(customers), drawn
        self.large = np.flatnonzero(possible > EXACT)
        self.is_large = np.zeros(len(customers), bool)
        self.is_large[self.large] = True
        self.target = self.customers[self.large]
        self.dish, self.size = np.arange(len(self.large)), self.target.copy()

    def _seated(self) -> np.ndarray:
        return np.bincount(self.dish, self.size, len(self.target)).astype(np.int64)

    def _shares(self, weight: np.ndarray, n: np.ndarray, replace: bool) -> np.ndarray:
        """n of each dish dealt to its tables: by weight, or without replacement out of weight; by halves of the tables."""
        out = np.zeros(len(self.dish), np.int64)
        total = np.concatenate([[0], np.cumsum(weight)])
        ends = np.cumsum(np.bincount(self.dish, minlength=len(self.target)))
        lo, hi = np.concatenate([[0], ends[:-1]]), ends
        while True:
            some = n > 0
            lo, hi, n = lo[some], hi[some], n[some]
            leaf = hi - lo == 1
            out[lo[leaf]] += n[leaf]
            lo, hi, n = lo[~leaf], hi[~leaf], n[~leaf]
            if not len(n):
                return out
            mid = (lo + hi) // 2
            a, b = total[mid] - total[lo], total[hi] - total[mid]
            first = self.drawn.binomial(n, np.clip(a / (a + b), 0.0, 1.0)) if replace else self.drawn.hypergeometric(a, b, n)
            lo, hi, n = np.concatenate([lo, mid]), np.concatenate([mid, hi]), np.concatenate([first, n - first])

    def _sit(self, n: np.ndarray, new: np.ndarray, discount: float, still: np.ndarray) -> np.ndarray:
        """n more customers of each dish, in groups of a third of those there; ``still`` with a 0 for each new table."""
        left = n.copy()
        while left.any():
            there, t = self._seated(), np.bincount(self.dish, minlength=len(self.target))
            group = np.minimum(left, np.maximum(1, there // 3))
            weight = np.maximum(0.0, there - discount * t) + new
            # the mean over the group, whose later members find more customers
            chance = np.where(group > 1, new * np.log1p(group / np.maximum(weight - 0.5, weight / 2)) / np.maximum(1, group), new / weight)
            opens = np.where(there == 0, group, self.drawn.binomial(group, np.clip(chance, 0.0, 1.0)))
            self.size = self.size + self._shares(self.size - discount, group - opens, True)
            dishes = np.repeat(np.arange(len(opens)), opens)
            at = np.searchsorted(self.dish, dishes, side="right")
            self.dish, self.size, still = np.insert(self.dish, at, dishes), np.insert(self.size, at, 1), np.insert(still, at, 0)
            left -= group
        return still

    def _leave(self, n: np.ndarray, still: np.ndarray) -> np.ndarray:
        """n random customers of each dish go, of those counted in ``still``; what is left of these."""
        gone = self._shares(still, n, False)
        self.size, still = self.size - gone, still - gone
        keep = self.size > 0
        self.dish, self.size = self.dish[keep], self.size[keep]
        return still[keep]

    def step(self, new: np.ndarray, discount: float) -> None:
        """A Gibbs step of every customer; new: (strength + discount * tables) * the parent's probability."""
        self.tables[(self.customers == 1) & ~self.is_large] = 1
        small = np.flatnonzero((self.customers > 1) & ~self.is_large)
        small = small[np.argsort(self.customers[small], kind="stable")]
        cut = np.flatnonzero(np.diff(self.customers[small])) + 1
        for dishes in np.split(small, cut) if len(small) else []:
            n = self.customers[dishes[0]]
            for part in np.array_split(dishes, 1 + len(dishes) * n // 1_000_000):
                log = _stirling(discount)[n, 1 : n + 1] + np.log(new[part])[:, None] * np.arange(1, n + 1)
                odds = np.cumsum(np.exp(log - log.max(axis=1, keepdims=True)), axis=1)
                self.tables[part] = 1 + (odds < self.drawn.random((len(part), 1)) * odds[:, -1:]).sum(axis=1)
        if not len(self.large):
            return
        for _ in range(STEPS):
            still = self.size.copy()  # customers that have not moved yet
            for k in range(ROUNDS, 0, -1):
                group = -(-np.bincount(self.dish, still, len(self.target)).astype(np.int64) // k)
                still = self._sit(group, new[self.large], discount, self._leave(group, still))
        self.tables[self.large] = np.bincount(self.dish, minlength=len(self.target))

    def recount(self, customers: np.ndarray, new: np.ndarray, discount: float) -> None:
        """Customers that came or left; those of large dishes are seated or sent away."""
        self.customers, self.target = customers, customers[self.large]
        if len(self.large):
            n = self._seated()
            self._leave(np.maximum(0, n - self.target), self.size.copy())
            self._sit(np.maximum(0, self.target - n), new[self.large], discount, self.size.copy())
            self.tables[self.large] = np.bincount(self.dish, minlength=len(self.target))


@dataclass(frozen=True)
class Sums:
    """What all shards know: discounts of contexts and root, training words and tokens, customers and tables of the root, and those of the hot words."""

    discounts: tuple[float, float]
    vocabulary: int
    tokens: int
    customers: float
    tables: float
    hot: np.ndarray
    hot_count: np.ndarray
    hot_customers: np.ndarray
    hot_tables: np.ndarray

    def new_at_root(self) -> float:
        """The weight of a new table of any word at the root."""
        return (STRENGTH + self.discounts[1] * self.tables) / (self.vocabulary + 1)

    def root(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        return (np.maximum(0.0, customers - self.discounts[1] * tables) + self.new_at_root()) / (STRENGTH + self.customers)


def _within(per: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Numbers that ascend within each word, from their steps."""
    total = np.cumsum(steps)
    first = np.cumsum(per) - per
    return total - np.repeat(total[first] - steps[first], per)


@dataclass(frozen=True)
class Shard:
    """The pairs of a shard that some block asks for."""

    number: int
    words: np.ndarray  # ascending hashes
    word: np.ndarray  # of each pair, an index into words
    contexts: np.ndarray  # ascending
    context: np.ndarray  # of each pair, an index into contexts
    count: np.ndarray  # training count of each pair, may be 0

    @staticmethod
    def of(row: dict) -> Shard:
        per = _unpack(row["a"], np.uint32).astype(np.int64)
        return Shard(row["shard"], np.frombuffer(row["b"], np.uint64), np.repeat(np.arange(len(per)), per), _unpack40(row["c"]), _within(per, _unpack_halves(row["d"])), _unpack(row["e"], np.uint32).astype(np.int64))

    def row(self) -> dict:
        per = np.bincount(self.word, minlength=len(self.words)).astype(np.uint32)
        first = np.concatenate([[True], self.word[1:] != self.word[:-1]])
        steps = np.where(first, self.context, np.diff(self.context, prepend=0))
        return _row(SHARD, self.number, a=_pack(per), b=self.words.tobytes(), c=_pack40(self.contexts), d=_pack_halves(steps), e=_pack(self.count.astype(np.uint32)))


#: Kinds of rows: a shard's pairs, what a block asks, an arrangement, tables by context (of a shard; summed), numbers to add up.
SHARD, ASKED, SEATED, TABLES, SUMMED, NUMBERS = range(6)
_MESSAGE = pa.schema([("kind", pa.int32()), ("shard", pa.int64()), ("other", pa.int64()), *((c, pa.binary()) for c in "abcdef"), ("x", pa.float64()), ("y", pa.float64())])
_MESSAGE_ROW = "kind int, shard long, other long, a binary, b binary, c binary, d binary, e binary, f binary, x double, y double"
#: Numbers that are added up besides those of the hot words: root, counts of counts of contexts and of the root, words and tokens.
ROOT, ONES, ROOT_ONES, WORDS = -1, -2, -3, -4


def _row(kind: int, shard: int, other: int = 0, x: float = 0.0, y: float = 0.0, **packed: bytes) -> dict:
    return {"kind": kind, "shard": shard, "other": other, "x": float(x), "y": float(y)} | dict.fromkeys("abcdef") | packed


def _messages(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, _MESSAGE)


def _gather(group: pa.Table) -> pa.Table:
    """A shard's pairs from what blocks ask, and each block's pairs as places among them."""
    rows = group.to_pylist()
    words, word_at = np.unique(np.concatenate([np.frombuffer(r["words"], np.uint64) for r in rows]), return_inverse=True)
    contexts, context = np.unique(np.concatenate([_unpack40(r["contexts"]) for r in rows]), return_inverse=True)
    per = np.concatenate([_unpack(r["per"], np.uint32) for r in rows]).astype(np.int64)
    codes, at = np.unique(np.repeat(word_at, per) * len(contexts) + context, return_inverse=True)
    count = np.bincount(at, np.concatenate([_unpack(r["train"], np.uint32) for r in rows]), len(codes)).astype(np.int64)
    shard = Shard(rows[0]["shard"], words, codes // len(contexts), contexts, codes % len(contexts), count)
    ends = np.concatenate([[0], np.cumsum([len(r["contexts"]) // 5 for r in rows])])
    steps = [np.diff(at[a:b], prepend=0) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return _messages([shard.row(), *(_row(ASKED, shard.number, r["block"], a=_pack_halves(s)) for r, s in zip(rows, steps, strict=True))])


class Restaurants:
    """The dishes of a shard and their root."""

    def __init__(self, shard: Shard, sums: Sums, drawn: np.random.Generator) -> None:
        self.shard, self.sums = shard, sums
        self.pairs = np.flatnonzero(shard.count)  # trained ones
        count, word = shard.count[self.pairs], shard.word[self.pairs]
        place = np.minimum(np.searchsorted(sums.hot, shard.words), max(0, len(sums.hot) - 1))
        self.is_hot = sums.hot[place] == shard.words if len(sums.hot) else np.zeros(len(shard.words), bool)
        self.hot = np.where(self.is_hot, place, -1)
        self.seats = Seating(count, count, drawn)
        every = np.bincount(word, count, len(shard.words))
        self.rooted = np.flatnonzero((every > 0) & ~self.is_hot)
        self.root = Seating(self._root_customers()[self.rooted], every[self.rooted], drawn)

    def _root_customers(self) -> np.ndarray:
        return np.bincount(self.shard.word[self.pairs], self.seats.tables, len(self.shard.words)).astype(np.int64)

    def restore(self, row: dict) -> None:
        for seats, (t, dish, size) in ((self.seats, "abc"), (self.root, "def")):
            seats.tables, seats.dish, seats.size = (_unpack(row[c], np.uint32).astype(np.int64) for c in (t, dish, size))
        self.root.customers = self._root_customers()[self.rooted]
        self.root.target = self.root.customers[self.root.large]

    def row(self) -> dict:
        packed = {c: _pack(x.astype(np.uint32)) for c, x in zip("abcdef", (self.seats.tables, self.seats.dish, self.seats.size, self.root.tables, self.root.dish, self.root.size), strict=True)}
        return _row(SEATED, self.shard.number, **packed)

    def root_probability(self) -> np.ndarray:
        """Of each word of the shard."""
        customers, tables = np.zeros(len(self.shard.words)), np.zeros(len(self.shard.words))
        customers[self.rooted], tables[self.rooted] = self.root.customers, self.root.tables
        if self.is_hot.any():
            customers[self.is_hot], tables[self.is_hot] = self.sums.hot_customers[self.hot[self.is_hot]], self.sums.hot_tables[self.hot[self.is_hot]]
        return self.sums.root(customers, tables)

    def sweep(self, context_tables: np.ndarray) -> None:
        """A step of every customer of every dish, then of the root's, given how many tables each context has."""
        d0, d1 = self.sums.discounts
        p = self.root_probability()[self.shard.word[self.pairs]]
        self.seats.step((STRENGTH + d0 * context_tables[self.shard.context[self.pairs]]) * p, d0)
        new = np.full(len(self.rooted), self.sums.new_at_root())
        self.root.recount(self._root_customers()[self.rooted], new, d1)
        self.root.step(new, d1)

    def by_context(self) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables of each context, of this shard's words."""
        at, n = self.shard.context[self.pairs], len(self.shard.contexts)
        return np.bincount(at, self.shard.count[self.pairs], n), np.bincount(at, self.seats.tables, n)

    def messages(self, shards: int) -> list[dict]:
        """The arrangement, and its sums for others."""
        customers, tables = self.by_context()
        ranges = np.searchsorted(_shard_of(self.shard.contexts << np.uint64(24), shards), np.arange(shards + 1))
        out = [self.row()]
        for s in np.flatnonzero(np.diff(ranges)):
            mine = slice(ranges[s], ranges[s + 1])
            out.append(_row(TABLES, int(s), self.shard.number, a=_pack40(self.shard.contexts[mine]), b=_pack(customers[mine].astype(np.uint32)), c=_pack(tables[mine].astype(np.uint32))))
        out.append(_row(NUMBERS, 0, ROOT, self.root.customers.sum(), self.root.tables.sum()))
        hot = self._root_customers()
        counts = np.bincount(self.shard.word, self.shard.count, len(self.shard.words))
        return out + [_row(NUMBERS, 0, int(self.hot[i]), hot[i], counts[i]) for i in np.flatnonzero(self.is_hot)]

    def first_numbers(self) -> list[dict]:
        """Counts of counts, words and tokens; the hot words are counted where their sums are."""
        count, root = self.shard.count[self.pairs], self.root.customers
        hot = self.is_hot[self.shard.word[self.pairs]]
        return [_row(NUMBERS, 0, k, x, y) for k, x, y in ((ONES, (count == 1).sum(), (count == 2).sum()), (ROOT_ONES, (root == 1).sum(), (root == 2).sum()), (WORDS, len(self.rooted), count[~hot].sum()))]


def _context_sums(group: pa.Table) -> pa.Table:
    """Customers and tables of each context of a range over all shards, for each shard in the order it sent them."""
    rows = group.sort_by("other").to_pylist()
    contexts, at = np.unique(np.concatenate([_unpack40(r["a"]) for r in rows]), return_inverse=True)
    customers, tables = (np.bincount(at, np.concatenate([_unpack(r[c], np.uint32) for r in rows]), len(contexts)).astype(np.uint64) for c in "bc")
    ends = np.concatenate([[0], np.cumsum([len(r["a"]) // 5 for r in rows])])
    return _messages([_row(SUMMED, r["other"], r["shard"], b=_pack(customers[at[a:b]]), c=_pack(tables[at[a:b]])) for r, a, b in zip(rows, ends[:-1], ends[1:], strict=True)])


def _summed(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Customers and tables of a shard's contexts."""
    rows = sorted(rows, key=lambda r: r["other"])
    return tuple(np.concatenate([_unpack(r[c], np.uint64) for r in rows]).astype(float) for c in "bc")


def _start(shards: int, hot: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One table for each dish."""
    none = np.zeros(len(hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                at = Restaurants(Shard.of(batch.slice(i, 1).to_pylist()[0]), Sums((0.5, 0.5), 0, 0, 0.0, 0.0, hot, none, none, none), np.random.default_rng(0))
                yield from _messages(at.messages(shards) + at.first_numbers()).to_batches()

    return run


def _pass(shards: int, sums: Sums, seed: int) -> Callable[[pa.Table], pa.Table]:
    """All customers of a shard move, SWEEPS times."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        shard = Shard.of(next(r for r in rows if r["kind"] == SHARD))
        at = Restaurants(shard, sums, np.random.default_rng([seed, shard.number]))
        at.restore(next(r for r in rows if r["kind"] == SEATED))
        _, tables = _summed([r for r in rows if r["kind"] == SUMMED])
        own = at.by_context()[1]
        for _ in range(SWEEPS):
            at.sweep(np.maximum(0.0, tables - own + at.by_context()[1]))
        return _messages(at.messages(shards))

    return run


def _answers(samples: list[Sums]) -> Callable[[pa.Table], pa.Table]:
    """For each block's pairs: log10 of the averaged predictive probability; for each of its words: the training count."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        shard = Shard.of(next(r for r in rows if r["kind"] == SHARD))
        total = np.zeros(len(shard.count))
        for n, sums in enumerate(samples):
            at = Restaurants(shard, sums, np.random.default_rng(0))
            at.restore(next(r for r in rows if r["kind"] == SEATED and r["sample"] == n))
            customers, tables = _summed([r for r in rows if r["kind"] == SUMMED and r["sample"] == n])
            own = np.zeros(len(shard.count))
            own[at.pairs] = np.maximum(0.0, shard.count[at.pairs] - sums.discounts[0] * at.seats.tables)
            total += (own + ((STRENGTH + sums.discounts[0] * tables)[shard.context]) * at.root_probability()[shard.word]) / (STRENGTH + customers)[shard.context]
        log = np.log10(total / len(samples))
        count = np.bincount(shard.word, shard.count, len(shard.words))
        count[at.is_hot] = samples[0].hot_count[at.hot[at.is_hot]]
        out = []
        for r in rows:
            if r["kind"] == ASKED:
                place = np.cumsum(_unpack_halves(r["a"]))
                out.append({"block": r["other"], "shard": shard.number, "log": log[place].astype(np.float32).tobytes(), "count": _pack(count[np.unique(shard.word[place])].astype(np.uint64))})
        return pa.Table.from_pylist(out, pa.schema([("block", pa.int64()), ("shard", pa.int64()), ("log", pa.binary()), ("count", pa.binary())]))

    return run


_ROW = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(shards: int, hot: np.ndarray, train_tokens: int, vocabulary: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The documents of a block from the answers of all shards."""

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        r, got = block.to_pylist()[0], {x["shard"]: x for x in answers.to_pylist()}
        b = Block.of(r, shards, hot)
        asked = np.flatnonzero(np.diff(b.cut))
        log = np.concatenate([np.frombuffer(got[s]["log"], np.float32) for s in asked]).astype(float)
        count = np.concatenate([np.repeat(_unpack(got[s]["count"], np.uint64).astype(float), b.part(s)[1]) for s in asked])
        base = np.log10((count + 1) / (train_tokens + vocabulary + 1))
        first = np.concatenate([[0], np.cumsum(b.sizes)[:-1]])
        add = lambda x: np.add.reduceat(x[b.pair], first)
        return pa.table({
            "doc_id": pa.array(r["ids"], pa.int64()), "held_out": pa.array(r["held"], pa.bool_()), "n_tokens": pa.array(b.sizes), "n_known": pa.array(add((count > 0).astype(np.int64))),
            "train_tokens": pa.array([train_tokens] * len(b.sizes), pa.int64()), "base_score": pa.array(add(base)), "score": pa.array(add(log)),
        })

    return run


# --- passes ----------------------------------------------------------------------------------------------------------


def _numbers(messages: DataFrame, hot: np.ndarray, seed: int, before: Sums | None) -> Sums:
    """The sums of an arrangement: a few rows and at most 2 * HOT of the hot words; their root tables are drawn here."""
    added = {r["other"]: (r["x"], r["y"]) for r in messages.where(F.col("kind") == NUMBERS).groupBy("other").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).collect()}
    customers, count = (np.array([added.get(i, (0.0, 0.0))[k] for i in range(len(hot))]) for k in (0, 1))
    root, root_tables = added.get(ROOT, (0.0, 0.0))
    there = np.flatnonzero(customers)
    if before is None:
        share = lambda x: float(np.clip(x[0] / max(1.0, x[0] + 2 * x[1]), 0.05, 0.95))
        words, tokens_ = added.get(WORDS, (0.0, 0.0))
        ones = added.get(ROOT_ONES, (0.0, 0.0))
        discounts = share(added.get(ONES, (0.0, 0.0))), share((ones[0] + (customers == 1).sum(), ones[1] + (customers == 2).sum()))
        before = Sums(discounts, int(words) + len(there), int(tokens_ + count.sum()), root, root_tables + len(there), hot, count, customers, (customers > 0).astype(float))
    tables = np.zeros(len(hot))
    if len(there):
        seats = Seating(customers[there], customers[there], np.random.default_rng(seed))
        for _ in range(SWEEPS):
            seats.step(np.full(len(there), before.new_at_root()), before.discounts[1])
        tables[there] = seats.tables
    return Sums(before.discounts, before.vocabulary, before.tokens, root + customers.sum(), root_tables + tables.sum(), hot, count, customers, tables)


@dataclass(frozen=True)
class Model:
    """The pairs by shard, and the arrangements that are averaged with their sums."""

    shards: int
    hot: np.ndarray
    pairs: DataFrame
    seated: list[DataFrame]
    summed: list[DataFrame]
    sums: list[Sums]

    def answers(self) -> DataFrame:
        """block, shard, log, count: for every block and shard."""
        rows = self.pairs.withColumn("sample", F.lit(-1))
        for n, (a, b) in enumerate(zip(self.seated, self.summed, strict=True)):
            rows = rows.unionByName(a.unionByName(b).withColumn("sample", F.lit(n)))
        return rows.groupBy("shard").applyInArrow(_answers(self.sums), "block long, shard long, log binary, count binary")

    def drop(self) -> None:
        """Delete the tables of the model."""
        for made in (self.pairs, *self.seated, *self.summed):
            drop_saved(made)


def _forget(spark) -> None:
    """Let the driver's collector find shuffles that nothing refers to, whose files are then deleted; it takes two rounds."""
    for _ in range(2):
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def learn(blocks: DataFrame, shards: int, seed: int = 1) -> Model:
    """Gather the pairs of ``blocks`` and sample seating arrangements of the trained ones."""
    spark = blocks.sparkSession
    frequent = blocks.select("words", "token").mapInArrow(_frequent, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    total = frequent.where("word = 0").agg(F.max("n")).first()[0] or 0
    hot = np.sort(np.array([r["word"] for r in frequent.where((F.col("word") != 0) & (F.col("n") * HOT >= total)).collect()], np.int64).view(np.uint64))
    asks = blocks.mapInArrow(_asks(shards, hot), "shard long, block long, words binary, per binary, contexts binary, train binary")
    pairs = saved(asks.groupBy("shard").applyInArrow(_gather, _MESSAGE_ROW), "pairs")
    _forget(spark)
    own = pairs.where(F.col("kind") == SHARD)

    def arranged(made: DataFrame, n: int, before: Sums | None) -> tuple[DataFrame, DataFrame, Sums]:
        """An arrangement, its tables by context and its sums."""
        messages = saved(made, "messages")
        summed = saved(messages.where(F.col("kind") == TABLES).groupBy("shard").applyInArrow(_context_sums, _MESSAGE_ROW), "contexts")
        seated = saved(messages.where(F.col("kind") == SEATED), "seated")
        sums = _numbers(messages, hot, seed + n, before)
        drop_saved(messages)
        _forget(spark)
        return seated, summed, sums

    now = arranged(own.mapInArrow(_start(shards, hot), _MESSAGE_ROW), 0, None)
    samples = []
    for n in range(1, BURN_IN + SAMPLES + 1 if now[2].tokens else 1):
        rows = own.unionByName(now[0]).unionByName(now[1])
        after = arranged(rows.groupBy("shard").applyInArrow(_pass(shards, now[2], seed + n), _MESSAGE_ROW), n, now[2])
        if n > BURN_IN:
            samples.append(after)
        if n - 1 <= BURN_IN:
            drop_saved(now[0])
            drop_saved(now[1])
        now = after
    samples = samples or [now]
    return Model(shards, hot, pairs, *map(list, zip(*samples, strict=True)))


def score(docs: DataFrame, held_out: Column, text: str = "text", key: str = "doc_id", seed: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; rows not held out are learned from."""
    shards = 1 + (docs.agg(F.sum(F.length(text))).first()[0] or 0) // SHARD_CHARS
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text).alias("t"))
    blocks = saved(rows.mapInArrow(_blocks, _BLOCK_ROW), "blocks")
    model = learn(blocks, shards, seed)
    answers = saved(model.answers(), "answers")
    model.drop()
    _forget(docs.sparkSession)
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(shards, model.hot, model.sums[0].tokens, model.sums[0].vocabulary), _ROW)
