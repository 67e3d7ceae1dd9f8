"""Language-model scores by logistic mixing of hashed-context bit predictors.

A text is coded as its tokens (words in lower case, then one end), each by a few binary decisions:

* A: is it a token that has followed the two tokens before it? Asked where these two have been seen; if so, which of them, by counts.
* B: else, is it a known token? If so, which, by counts.
* else it is spelled: its bytes and a blank (the end: one zero byte), each by the bits of a Huffman code.

Every decision and every bit of the spelling is predicted by several predictors that look up how often it was 0 and 1
after their context, each hashed into a table: for decisions what the two tokens before have seen, the last
outcomes, the token before, the share of unknown tokens so far; for spelling the last one, two, three or four bytes of the token or
all of it so far. Their log odds are mixed by weights of a gate, and the mixed
probability is refined by an adaptive map (gate and log odds to what was observed). The decisions' tables, weights and map are learned online over
the training texts of each block (some MB of texts, dealt by hash); the tables and maps of all blocks are summed, their weights averaged by their decisions, and every
text is scored by the whole (`learned`), from its decisions, which each block stores as it learns. Weights and map go on learning while a
text is scored, from `CHUNK` decisions to the next, and start from the whole's with each text. Each bit is a
probability given what stands before it, so the probabilities of all token sequences sum to at most one.

Counts: of tokens, and of tokens after two others, over all training texts (they grow with the corpus, in shards); to these
come those of the text itself so far. A training text is scored by the counts without itself, so a text that occurs once and one that was held out are alike, and
copies show.

Work is done in blocks of rows and in shards of the counts. A block asks every shard for the counts of its distinct tokens and
(two tokens, token) keys, in one row for each shard, and brings its own counts along; the shard sums them and answers. A hot token is one entry of each block.
The tables of spelling are sums over all shards and have a fixed size (`TABLE_BITS`, 46 MB
whatever the corpus); they alone are broadcast. Spelling is learned from the table of distinct tokens, each once, as only tokens never seen are spelled;
its weights are learned online over that table, shard by shard, each occurrence being predicted from the counts without itself, and averaged.

Null text counts as empty: its only token is the end. Null ids count as the empty id (held out as crc32 0 mod
`folds` says). Texts are read whole, however long. Repeated rows each train and each get a row. Without a training row every count is 0. An empty table gives an empty table.
Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entloom.llm.common import blocks_for, id_crc, let_go, lower_words_of, released, stored
from entloom.llm.trie_join import mix64

#: The end of a text as a token; no word has white space.
END = b"\n"
#: Slots of the spelling predictors' tables, as powers of two: contexts of 1, 2, 3, 4 bytes and of the whole prefix.
TABLE_BITS = (16, 19, 20, 21, 21)
ORDERS = len(TABLE_BITS)
PLACES, LEVELS, MAP_CELLS = 8, 6, 24
GATES = PLACES * LEVELS
RANGE_BITS = 16  # slots of a table that are summed together
_M = np.uint64(0x9E3779B97F4A7C15)

# Decisions: predictors, slots of their tables, gates and how many of a text's decisions pass between two steps of learning.
DECIDERS, SLOT_BITS, SEEN_LEVELS = 4, 14, 8
DECISION_GATES = SEEN_LEVELS + 16
CHUNK = 32
#: The two tokens before a text's first.
_START = np.uint64(0xD1B54A32D192ED03)


# -- spelling ------------------------------------------------------------------------------


def huffman(counts: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each byte the (inner node, bit) on the way to it; every byte has a code."""
    heap = [(int(c) + 1, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    children: dict[int, tuple[int, int]] = {}
    nxt = len(counts)
    while len(heap) > 1:
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        children[nxt] = (x, y)
        heapq.heappush(heap, (a + b, nxt))
        nxt += 1
    paths: list[list[tuple[int, int]]] = [[] for _ in counts]
    stack = [(heap[0][1], [])]
    while stack:
        node, path = stack.pop()
        if node < len(counts):
            paths[node] = path
        else:
            for bit, child in enumerate(children[node]):
                stack.append((child, [*path, (node - len(counts), bit)]))
    return paths


class Code:
    """The paths of all bytes, flattened."""

    def __init__(self, counts: np.ndarray):
        paths = huffman(counts)
        self.length = np.array([len(p) for p in paths], np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.length)[:-1]))
        self.node = np.array([n for p in paths for n, _ in p], np.uint64)
        self.bit = np.array([b for p in paths for _, b in p], np.int8)


class Events:
    """All bits of some tokens: their table slots, places and values."""

    def __init__(self, tokens: list[bytes], code: Code):
        spelled = [b"\0" if t == END else t + b" " for t in tokens]
        data = np.frombuffer(b"".join(spelled), np.uint8)
        lens = np.fromiter(map(len, spelled), np.int64, len(spelled))
        first = np.concatenate(([0], np.cumsum(lens)[:-1]))
        place = np.arange(len(data)) - np.repeat(first, lens)
        with np.errstate(over="ignore"):
            byte = data.astype(np.uint64) + np.uint64(1)
            hashes, h = [], np.zeros(len(data), np.uint64)
            for k in range(1, ORDERS):
                back = np.zeros(len(data), np.uint64)
                back[k:] = byte[:-k]
                back[place < k] = 0
                h = (h + back + np.uint64(k)) * _M
                h = h ^ (h >> np.uint64(29))
                hashes.append(h)
            # The whole prefix: a polynomial in the place, summed within the token.
            power = np.cumprod(np.full(int(lens.max(initial=1)), _M))
            total = np.cumsum(byte * power[place])
            before = np.concatenate((np.zeros(1, np.uint64), total[:-1]))
            prefix = (before - before[np.repeat(first, lens)]) * np.uint64(0xD6E8FEB86659FD93)
            hashes.append(prefix ^ (prefix >> np.uint64(32)) ^ (place == 0))
            reps = code.length[data]
            at = np.repeat(np.arange(len(data)), reps)
            cell = np.arange(len(at)) - np.repeat(np.cumsum(reps) - reps, reps) + code.start[data][at]
            node = (code.node[cell] + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
            self.slots = []
            for bits, h in zip(TABLE_BITS, hashes, strict=True):
                x = (h[at] + node) * _M
                self.slots.append((x >> np.uint64(64 - bits)).astype(np.int64))
        self.bit = code.bit[cell]
        self.place = np.minimum(place, PLACES - 1)[at]
        self.owner = np.repeat(np.arange(len(tokens)), lens)[at]


def stretch(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    prior = np.float32(0.05)
    return np.log((n1 + prior) / (n0 + prior))


def level_of(seen: np.ndarray) -> np.ndarray:
    """How much a context has seen, by powers of two."""
    return np.minimum(LEVELS - 1, np.log2(seen + np.float32(1)).astype(np.int64))


class Lookup:
    """What scoring reads of the tables: each slot's log odds, and the longest context's level."""

    def __init__(self, tables: list[np.ndarray]):
        self.odds = [stretch(t[:, 0].astype(np.float32), t[:, 1].astype(np.float32)) for t in tables]
        self.level = level_of(tables[-1].sum(1, dtype=np.float32)).astype(np.uint8)

    def inputs(self, ev: Events):
        x = np.stack([o[s] for o, s in zip(self.odds, ev.slots, strict=True)], axis=1)
        return x, ev.place * LEVELS + self.level[ev.slots[-1]]


class Mixer:
    """The gates' weights and the map that refines what they give."""

    def __init__(self, weights: np.ndarray | None = None, seen: np.ndarray | None = None):
        self.weights = np.full((GATES, ORDERS), 0.25) if weights is None else weights
        self.seen = np.zeros((GATES, MAP_CELLS, 2)) if seen is None else seen

    @staticmethod
    def inputs(tables, ev: Events):
        """Log odds of each predictor and the gate of each bit, from the counts without the bit's own occurrence."""
        one = ev.bit.astype(np.float32)
        zero = 1 - one
        x = np.empty((len(one), ORDERS), np.float32)
        for k, (table, slots) in enumerate(zip(tables, ev.slots, strict=True)):
            n = table[slots].astype(np.float32)
            n0, n1 = np.maximum(0, n[:, 0] - zero), np.maximum(0, n[:, 1] - one)
            x[:, k] = stretch(n0, n1)
        return x, ev.place * LEVELS + level_of(n0 + n1)

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.clip(np.einsum("ij,ij->i", x, self.weights.astype(np.float32)[gate]), -14, 14)

    @staticmethod
    def cell(z: np.ndarray) -> np.ndarray:
        return np.clip(((z + 12) * (MAP_CELLS / 24)).astype(np.int64), 0, MAP_CELLS - 1)

    def learn(self, x: np.ndarray, gate: np.ndarray, bit: np.ndarray, weight: np.ndarray, rate: float) -> None:
        """One minibatch: predict, count for the map, then step along the gates' mean gradients."""
        z = self.mixed(x, gate)
        p = 1 / (1 + np.exp(-z))
        cell = gate * MAP_CELLS + self.cell(z)
        flat = self.seen.reshape(-1, 2)
        flat[:, 0] += np.bincount(cell, weight * (1 - bit), len(flat))
        flat[:, 1] += np.bincount(cell, weight * bit, len(flat))
        err = (bit - p) * weight
        mass = np.bincount(gate, weight, GATES)
        for k in range(ORDERS):
            self.weights[:, k] += rate * np.bincount(gate, err * x[:, k], GATES) / np.maximum(mass, 1e-9) * (mass > 0)

    def log2(self, x: np.ndarray, gate: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """log2 of the refined probability of each bit."""
        z = self.mixed(x, gate)
        p = 1 / (1 + np.exp(-z))
        seen = self.seen.reshape(-1, 2)
        cell = gate * MAP_CELLS + self.cell(z)
        refined = (seen[:, 1].astype(np.float32)[cell] + 32 * p) / (seen.sum(1).astype(np.float32)[cell] + 32)
        p = np.clip(0.8 * p + 0.2 * refined, 1e-6, 1 - 1e-6)
        return np.log2(np.where(bit == 1, p, 1 - p))


def token_bits(tokens: list[bytes], code: Code, lookup: Lookup, mixer: Mixer, step: int = 4096) -> np.ndarray:
    """Bits of each token."""
    out = np.zeros(len(tokens))
    for lo in range(0, len(tokens), step):
        part = tokens[lo : lo + step]
        ev = Events(part, code)
        x, gate = lookup.inputs(ev)
        out[lo : lo + len(part)] = -np.bincount(ev.owner, mixer.log2(x, gate, ev.bit), len(part))
    return out


# -- counts that grow with the corpus --------------------------------------------------------


def _small(x: np.ndarray) -> bytes:
    """Counts in the narrowest of four widths, which the first byte names, compressed: most are small."""
    top = int(x.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w) or w == 8)
    return bytes([width]) + zlib.compress(x.astype(f"<u{width}").tobytes(), 1)


def _counts(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), f"<u{data[0]}").astype(np.int64)


class Block:
    """The tokens of some texts: `vocab`, `ids` of all positions, `start` of each text; and the keys (two tokens before, token) of all positions."""

    def __init__(self, texts: list, shards: int):
        tokens = [[*lower_words_of(t), END] for t in texts]
        self.length = np.fromiter(map(len, tokens), np.int64, len(tokens))
        total = int(self.length.sum())
        numbered = pa.array(chain.from_iterable(tokens), pa.large_binary(), size=total).dictionary_encode()
        self.vocab, self.ids = numbered.dictionary.to_pylist(), numbered.indices.to_numpy()
        del tokens, numbered
        self.start = np.cumsum(self.length) - self.length
        self.text = np.repeat(np.arange(len(texts), dtype=np.int32), self.length)
        self.place = np.arange(total) - self.start[self.text]
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.vocab), np.uint64, len(self.vocab))
        own = hashes[self.ids]
        self.prev = np.full(total, _START)
        self.prev[1:][self.place[1:] >= 1] = own[:-1][self.place[1:] >= 1]
        before = np.full(total, _START)
        before[2:][self.place[2:] >= 2] = own[:-2][self.place[2:] >= 2]
        with np.errstate(over="ignore"):
            context = mix64(self.prev * _M + mix64(before + np.uint64(1)))
            #: 40 bits of the context and 24 of the token; further bits of the context choose the shard.
            self.key = (context << np.uint64(24)) | (mix64(own * _M) >> np.uint64(40))
            self.shard = ((context >> np.uint64(40)) % np.uint64(shards)).astype(np.int32)
            self.vocab_shard = (hashes % np.uint64(shards)).astype(np.int32)
        self.hashes = hashes

    def pieces(self):
        """For each shard: (shard, numbers of its tokens, positions of its keys sorted by key, first of each distinct key)."""
        by_shard = np.argsort(self.shard, kind="stable")
        by_vocab = np.lexsort((self.hashes, self.vocab_shard))  # an order that doesn't depend on that of the rows
        for s in np.union1d(self.shard, self.vocab_shard).tolist():
            at = by_shard[np.searchsorted(self.shard, s, "left", by_shard) : np.searchsorted(self.shard, s, "right", by_shard)]
            at = at[np.argsort(self.key[at], kind="stable")]
            key = self.key[at]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(at) else np.zeros(0, np.int64)
            which = by_vocab[np.searchsorted(self.vocab_shard, s, "left", by_vocab) : np.searchsorted(self.vocab_shard, s, "right", by_vocab)]
            yield s, which, at, first


def ask(block: int, texts: list, train: np.ndarray, shards: int):
    """What a block asks of the shards: its distinct tokens and keys, with how often its training texts have them."""
    b = Block(texts, shards)
    counted = train[b.text]
    mine = np.bincount(b.ids, weights=counted, minlength=len(b.vocab)).astype(np.int64)
    for s, which, at, first in b.pieces():
        n = np.add.reduceat(counted[at].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
        # The end is a token that holds the separator: it goes first, and is named apart.
        names = [b.vocab[i] for i in which.tolist()]
        has_end = END in names
        if has_end:
            i = names.index(END)
            which = np.concatenate((which[i : i + 1], np.delete(which, i)))
            names.pop(i)
        yield s, block, has_end, b"\n".join(names), _small(mine[which]), b.key[at][first].tobytes(), _small(n)


ASKED = "shard int, block int, has_end boolean, names binary, token_n binary, keys binary, key_n binary"
ANSWERED = "block int, shard int, n long, v long, types binary, token_n binary, key_n binary, seen_n binary, seen_d binary"


def _names(has_end: bool, data: bytes) -> list[bytes]:
    return ([END] if has_end else []) + (data.split(b"\n") if data else [])


def answer(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's sums over all blocks, for each block in the order it asked; and one row (block -1) of totals and of the distinct training tokens."""
    rows = sorted(chain.from_iterable(b.to_pylist() for b in batches), key=lambda r: r["block"])
    shard = key[0].as_py()
    known: dict[bytes, int] = {}
    for r in rows:
        for t, n in zip(_names(r["has_end"], r["names"]), _counts(r["token_n"]).tolist(), strict=True):
            known[t] = known.get(t, 0) + n
    keys = [np.frombuffer(r["keys"], np.uint64) for r in rows]
    own = np.concatenate([_counts(r["key_n"]) for r in rows])
    found, back = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, back, own)
    context = found >> np.uint64(24)
    first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1]))) if len(found) else np.zeros(0, np.int64)
    group = np.cumsum(np.concatenate(([0], context[1:] != context[:-1]))) if len(found) else np.zeros(0, np.int64)
    n = np.add.reduceat(total, first)[group] if len(found) else total
    d = np.add.reduceat((total > 0).astype(np.int64), first)[group] if len(found) else total

    def row(block, n_, v, types, *data):
        return pa.RecordBatch.from_pylist([dict(zip([x.split()[0] for x in ANSWERED.split(", ")], (block, shard, n_, v, types, *data), strict=True))], pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("n", pa.int64()), ("v", pa.int64()), *((c, pa.binary()) for c in ("types", "token_n", "key_n", "seen_n", "seen_d"))]))

    types = sorted(t for t, c in known.items() if c > 0)
    yield row(-1, sum(known.values()), len(types), b" ".join(types), None, None, None, None)
    lo = 0
    for r, k in zip(rows, keys, strict=True):
        at = back[lo : lo + len(k)]
        lo += len(k)
        token_n = np.fromiter((known[t] for t in _names(r["has_end"], r["names"])), np.int64)
        yield row(r["block"], None, None, None, _small(token_n), _small(total[at]), _small(n[at]), _small(d[at]))


# -- decisions -----------------------------------------------------------------------------


def _runs(*keys: np.ndarray) -> np.ndarray:
    """First positions of the runs in which no key changes."""
    change = np.zeros(len(keys[0]), bool)
    change[:1] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(change)


def _before(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of what stands before each position in its run."""
    total = np.cumsum(values) - values
    return total - np.repeat(total[first], np.diff(np.append(first, len(values))))


def _level(n: np.ndarray) -> np.ndarray:
    return np.minimum(SEEN_LEVELS - 1, np.log2(n + 1.0).astype(np.int64))


class Steps:
    """Decisions of texts in their order: text, bit, slots, gate, and step, which counts a text's decisions by `CHUNK`."""

    def __init__(self, text: np.ndarray, bit: np.ndarray, slots: np.ndarray, gate: np.ndarray, texts: int):
        self.text, self.bit, self.slots, self.gate = text, bit, slots, gate
        first = np.searchsorted(text, np.arange(texts))
        self.step = (np.arange(len(text)) - first[text]) // CHUNK

    def steps(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the decisions [lo, hi): where each step begins in an order in which all texts go on together, `CHUNK` decisions at a time; and that order."""
        order = lo + np.argsort(self.step[lo:hi], kind="stable")
        return np.searchsorted(self.step[order], np.arange(int(self.step[lo:hi].max(initial=-1)) + 2)), order

    def pack(self, texts: int) -> tuple[bytes, bytes, bytes]:
        """How many each text has, gates with bits, and the slots, each predictor's by themselves."""
        return np.bincount(self.text, minlength=texts).tobytes(), (self.gate | self.bit << 5).astype(np.uint8).tobytes(), self.slots.T.astype("<u2").tobytes()

    @staticmethod
    def unpack(counts: bytes, marks: bytes, slots: bytes) -> Steps:
        many, mark = np.frombuffer(counts, np.int64), np.frombuffer(marks, np.uint8).astype(np.int64)
        return Steps(np.repeat(np.arange(len(many)), many), mark >> 5, np.frombuffer(slots, "<u2").reshape(DECIDERS, -1).T, mark & 31, len(many))


class Decisions(Steps):
    """All decisions of a block's texts in their order, and what is known of each position.

    token_n: of each of the vocabulary; key_n, seen_n, seen_d: of each position, over all training texts: the key's count, and how many tokens and
    distinct ones its context has seen. The text's own counts are taken out of a training text's, and those of the text so far come in.
    """

    def __init__(self, b: Block, train: np.ndarray, total: int, token_n: np.ndarray, key_n: np.ndarray, seen_n: np.ndarray, seen_d: np.ndarray):
        size, counted = len(b.ids), train[b.text]
        ones = np.ones(size, np.int64)

        def of_runs(order, *keys):
            first = _runs(*(k[order] for k in keys))
            length = np.diff(np.append(first, size))
            own, before = np.empty(size, np.int64), np.empty(size, np.int64)
            own[order], before[order] = np.repeat(length, length), _before(ones, first)
            return own, before, first

        by_key = np.argsort(b.key, kind="stable")
        own, before, _ = of_runs(by_key, b.key, b.shard, b.text)
        rest = key_n - own * counted
        key_now = rest + before
        context = b.key >> np.uint64(24)
        by_context = np.argsort(context, kind="stable")  # positions, and so texts, stay in order
        own_n, before_n, first = of_runs(by_context, context, b.shard, b.text)
        new = ((rest == 0) & (before == 0)).astype(np.int64)  # the text itself brings this token to the context
        length = np.diff(np.append(first, size))
        own_new, before_new = np.empty(size, np.int64), np.empty(size, np.int64)
        own_new[by_context] = np.repeat(np.add.reduceat(new[by_context], first), length) if size else new
        before_new[by_context] = _before(new[by_context], first)
        n_now = seen_n - own_n * counted + before_n
        d_now = np.maximum(1, seen_d - own_new * counted + before_new)
        by_id = np.argsort(b.ids, kind="stable")
        own_1, before_1, _ = of_runs(by_id, b.ids, b.text)
        others = token_n[b.ids] - own_1 * counted
        token_now = others + before_1
        all_now = total - b.length[b.text] * counted + b.place

        # A block's arrays are most of a task's memory.
        del own, before, rest, context, by_key, by_context, own_n, before_n, first, new, length, own_new, before_new, by_id, own_1, before_1
        asked = n_now > 0
        hit = asked & (key_now > 0)
        known = ~hit & (token_now > 0)
        self.spelled = ~hit & ~known
        self.choice = np.zeros(size)
        self.choice[hit] = -np.log2(key_now[hit] / n_now[hit])
        self.choice[known] = -np.log2(token_now[known] / all_now[known])

        del key_now, token_now, all_now
        outcome = np.where(hit, 0, np.where(known, 1, 2))
        past = []
        for k in (1, 2, 3):
            x = np.full(size, 3)
            x[k:][b.place[k:] >= k] = outcome[:-k][b.place[k:] >= k]
            past.append(x)
        at = np.arange(size)
        stop = np.where(~hit, at, -1)
        last = np.concatenate(([-1], np.maximum.accumulate(stop)[:-1])) if size else stop
        run = np.minimum(15, at - 1 - np.maximum(last, at - b.place - 1))  # hits in a row before
        odd = _before((outcome == 2).astype(np.int64), b.start) if size else outcome
        share = np.minimum(7, 16 * odd // np.maximum(1, b.place))
        del at, stop, last, odd, outcome
        history = past[0] * 4 + past[1]
        seen, kinds = _level(n_now), _level(d_now)
        common = _level(np.concatenate(([0], others[:-1])) * (b.place > 0)) if size else seen

        def slots(tag, *parts):
            h = np.full(size, np.uint64(tag))
            with np.errstate(over="ignore"):
                for x in parts:
                    h = mix64(h * _M + x.astype(np.uint64) + np.uint64(1))
            return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int32)

        a = [slots(1, seen, kinds, np.minimum(n_now - d_now, 3) + 1), slots(2, seen, history, past[2]), slots(3, b.prev), slots(4, common, kinds, run)]
        o = [slots(5, history, past[2]), slots(6, b.prev), slots(7, asked, seen, share), slots(8, _level(b.place), share)]
        pick = np.stack((asked, ~hit), axis=1).ravel()
        two = lambda x, y: np.stack((x, y), axis=1).reshape(2 * size, *x.shape[1:])[pick]
        slots = two(np.stack(a, axis=1).reshape(size, DECIDERS), np.stack(o, axis=1).reshape(size, DECIDERS))
        super().__init__(two(b.text, b.text), two(hit, known).astype(np.int64), slots, two(seen, SEEN_LEVELS + history), len(b.length))


def _odds(table: np.ndarray) -> np.ndarray:
    return np.log((table[..., 1] + 0.4) / (table[..., 0] + 0.4))


def _cell(z: np.ndarray) -> np.ndarray:
    return np.clip(((z + 12) * (MAP_CELLS / 24)).astype(np.int64), 0, MAP_CELLS - 1)


class Decider:
    """Tables of the decisions' predictors, the gates' weights (the last is of a constant) and the map."""

    def __init__(self, tables=None, weights=None, seen=None):
        self.tables = np.zeros((DECIDERS, 1 << SLOT_BITS, 2)) if tables is None else tables
        self.weights = np.full((DECISION_GATES, DECIDERS + 1), 0.3) if weights is None else weights
        self.seen = np.zeros((DECISION_GATES, MAP_CELLS, 2)) if seen is None else seen

    def learn(self, d: Decisions, train: np.ndarray, rate: float = 0.1, batch: int = 2048) -> int:
        """Online, batch by batch, over the training texts: predict from the tables so far, step along the gates' mean gradients, then count."""
        step, order = d.steps(0, len(d.bit))
        order = order[train[d.text[order]]]
        for lo in range(0, len(order), batch):
            at = order[lo : lo + batch]
            slot, gate, bit = d.slots[at], d.gate[at], d.bit[at]
            x = np.ones((len(at), DECIDERS + 1))
            for k in range(DECIDERS):
                x[:, k] = _odds(self.tables[k][slot[:, k]])
            z = np.clip((x * self.weights[gate]).sum(1), -12, 12)
            err = bit - 1 / (1 + np.exp(-z))
            np.add.at(self.seen.reshape(-1), (gate * MAP_CELLS + _cell(z)) * 2 + bit, 1.0)
            mass = np.maximum(1, np.bincount(gate, minlength=DECISION_GATES))
            for k in range(DECIDERS + 1):
                self.weights[:, k] += rate * np.bincount(gate, err * x[:, k], DECISION_GATES) / mass
            for k in range(DECIDERS):
                np.add.at(self.tables[k].reshape(-1), 2 * slot[:, k] + bit, 1.0)
        return len(order)

    def bits(self, d: Decisions, texts: int, rate: float = 0.02, group: int = 2048) -> np.ndarray:
        """Bits of each text's decisions; its own weights and map start from the learned ones and adapt from step to step."""
        out = np.zeros(texts)
        odds = _odds(self.tables)
        total = self.seen.sum(-1)
        scale = 32 / np.maximum(32, total)  # what others saw counts as 32 at most, so that the text is heard
        one, every = self.seen[..., 1] * scale + 0.0, total * scale + 16
        for first in range(0, texts, group):
            n = min(group, texts - first)
            weights = np.tile(self.weights.T, (1, n))  # a row for each predictor, in it the gates of each text
            seen = np.zeros((n * DECISION_GATES * MAP_CELLS, 2))
            bounds, order = d.steps(*np.searchsorted(d.text, (first, first + n)))
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                at = order[lo:hi]
                slot, gate, bit, text = d.slots[at], d.gate[at], d.bit[at], d.text[at] - first
                own = text * DECISION_GATES + gate
                x = np.ones((DECIDERS + 1, len(at)))
                for k in range(DECIDERS):
                    x[k] = odds[k][slot[:, k]]
                z = np.clip((x * weights[:, own]).sum(0), -12, 12)
                p = 1 / (1 + np.exp(-z))
                cell = _cell(z)
                mine = own * MAP_CELLS + cell
                here = seen[mine]
                refined = (one[gate, cell] + here[:, 1] + 16 * p) / (every[gate, cell] + here.sum(1))
                p2 = np.clip(0.5 * p + 0.5 * refined, 1e-6, 1 - 1e-6)
                out[first : first + n] += np.bincount(text, -np.log2(np.where(bit == 1, p2, 1 - p2)), n)
                step = rate * (bit - p)
                for k in range(DECIDERS + 1):
                    np.add.at(weights[k], own, step * x[k])
                np.add.at(seen.reshape(-1), 2 * mine + bit, 1.0)
        return out


# -- training --------------------------------------------------------------------------


def _pack(table: np.ndarray) -> bytes:
    return zlib.compress(table.tobytes(), 1)


def _unpack(data: bytes, dtype=np.float64) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), dtype)


def sum_tables(types: DataFrame, code: Code) -> list[np.ndarray]:
    """The spelling predictors' tables: (slots, 2) counts of 0 and 1, over all rows of `types`. Whole numbers are summed; a float32 holds the sum."""

    def build(batches):
        tables = [np.zeros(2 << bits, np.int64) for bits in TABLE_BITS]
        for batch in batches:
            for data in batch.column(0):
                tokens = types_of(data.as_py())
                for lo in range(0, len(tokens), 4096):
                    ev = Events(tokens[lo : lo + 4096], code)
                    for table, slots in zip(tables, ev.slots, strict=True):
                        np.add.at(table, 2 * slots + ev.bit, 1)
        for k, table in enumerate(tables):
            width = 2 << min(RANGE_BITS, TABLE_BITS[k])
            for r in range(len(table) // width):
                piece = table[r * width : (r + 1) * width]
                if piece.any():
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([r], pa.int32()), pa.array([_pack(piece)], pa.binary())], names=["k", "r", "data"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for data in batch.column("data"):
                piece = _unpack(data.as_py(), np.int64)
                total = piece if total is None else total + piece
        k, r = (x.as_py() for x in key)
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([r], pa.int32()), pa.array([_pack(total.astype(np.float32))], pa.binary())], names=["k", "r", "data"])

    pieces = types.mapInArrow(build, "k int, r int, data binary").groupBy("k", "r").applyInArrow(add, "k int, r int, data binary")
    tables = [np.zeros((1 << bits, 2), np.float32) for bits in TABLE_BITS]
    for row in pieces.toLocalIterator():
        width = 1 << min(RANGE_BITS, TABLE_BITS[row["k"]])
        tables[row["k"]][row["r"] * width : (row["r"] + 1) * width] = _unpack(row["data"], np.float32).reshape(-1, 2)
    return tables


def types_of(data: bytes) -> list[bytes]:
    """The distinct tokens of a shard; the end is its own separator's neighbour and told apart by its byte."""
    return data.split(b" ") if data else []


def _folded(df: DataFrame, columns: list[str]) -> dict[str, np.ndarray]:
    """Sums of packed float64 arrays over all rows (by `block`, in two levels, each in the order of the blocks), for the driver: one row."""
    schema = "block int, " + ", ".join(f"{c} binary" for c in columns)

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(chain.from_iterable(b.to_pylist() for b in batches), key=lambda r: r["block"])
        total = [sum((_unpack(r[c]) for r in rows[1:]), _unpack(rows[0][c])) for c in columns]
        yield pa.RecordBatch.from_arrays([pa.array([rows[0]["block"]], pa.int32()), *(pa.array([_pack(x)], pa.binary()) for x in total)], names=["block", *columns])

    first = df.groupBy(F.expr("block div 64")).applyInArrow(add, schema)
    second = first.groupBy(F.expr("block div 8192")).applyInArrow(add, schema)
    out: dict[str, np.ndarray] = {}
    for row in second.orderBy("block").toLocalIterator():
        for c in columns:
            piece = _unpack(row[c])
            out[c] = piece if c not in out else out[c] + piece
    return out


class Model:
    """What scoring needs of the corpus besides the answers: code, tables, mixer; the number of training tokens and of distinct ones."""

    def __init__(self, byte_counts, tables, mixer, n, v):
        self.byte_counts, self.code, self.tables, self.mixer, self.n, self.v = byte_counts, Code(byte_counts), tables, mixer, n, v

    def pack(self) -> bytes:
        import pickle

        return zlib.compress(pickle.dumps((self.byte_counts, self.tables, self.mixer.weights, self.mixer.seen, self.n, self.v)), 1)

    @staticmethod
    def unpack(data: bytes) -> Model:
        import pickle

        byte_counts, tables, weights, seen, n, v = pickle.loads(zlib.decompress(data))
        return Model(byte_counts, tables, Mixer(weights, seen), n, v)


def _spelling(types: DataFrame, rate: float = 0.05) -> tuple[np.ndarray, list[np.ndarray], Mixer]:
    """Byte counts, tables and mixer, learned from the distinct tokens."""
    spark = types.sparkSession

    def bytes_of(batches):
        total = np.zeros(256, np.int64)
        for batch in batches:
            for data in batch.column(0):
                spelled = b"".join(b"\0" if t == END else t + b" " for t in types_of(data.as_py()))
                total += np.bincount(np.frombuffer(spelled, np.uint8), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(total)], names=["b", "n"])

    byte_counts = np.zeros(256, np.int64)
    for row in types.mapInArrow(bytes_of, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).collect():
        byte_counts[row["b"]] = row["n"]
    tables = sum_tables(types, Code(byte_counts))
    shared = spark.sparkContext.broadcast((byte_counts, tables))

    def learn(batches):
        byte_counts, tables = shared.value
        code = Code(byte_counts)
        for batch in batches:
            for shard, data in zip(batch.column(1).to_pylist(), batch.column(0), strict=True):
                mixer, tokens = Mixer(), types_of(data.as_py())
                tokens = [tokens[i] for i in np.argsort(np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens)))]
                for lo in range(0, len(tokens), 512):
                    ev = Events(tokens[lo : lo + 512], code)
                    x, gate = Mixer.inputs(tables, ev)
                    mixer.learn(x, gate, ev.bit, np.ones(len(ev.bit)), rate)
                mass = np.array([float(len(tokens))])
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *(pa.array([_pack(v)], pa.binary()) for v in (mass, mass * mixer.weights, mixer.seen))], names=["block", "mass", "weights", "seen"])

    got = _folded(types.mapInArrow(learn, "block int, mass binary, weights binary, seen binary"), ["mass", "weights", "seen"])
    if not got or not got["mass"][0]:
        return byte_counts, tables, Mixer()
    return byte_counts, tables, Mixer((got["weights"] / got["mass"][0]).reshape(GATES, ORDERS), got["seen"].reshape(GATES, MAP_CELLS, 2))


# -- scoring ---------------------------------------------------------------------------


class Reader:
    """A block's rows in a fixed order, with the shards' answers."""

    def __init__(self, left: pa.Table, right: pa.Table, shards: int):
        rows = list(zip(left.column("doc_id").to_pylist(), left.column("text").to_pylist(), range(left.num_rows), strict=True))
        self.order = [i for *_, i in sorted(rows, key=lambda r: (str(r[0]), r[1] or b""))]
        self.texts = [rows[i][1] for i in self.order]
        self.train = ~left.column("held_out").to_numpy()[self.order].astype(bool)
        self.block = b = Block(self.texts, shards)
        told = {r["shard"]: r for r in right.to_pylist()}
        self.token_n = np.zeros(len(b.vocab), np.int64)
        at_keys = [np.zeros(len(b.ids), np.int64) for _ in range(3)]
        for s, which, at, first in b.pieces():
            names = [b.vocab[i] for i in which.tolist()]
            if END in names:
                i = names.index(END)
                which = np.concatenate((which[i : i + 1], np.delete(which, i)))
            self.token_n[which] = _counts(told[s]["token_n"])
            many = np.diff(np.append(first, len(at)))
            for column, c in zip(at_keys, ("key_n", "seen_n", "seen_d"), strict=True):
                column[at] = np.repeat(_counts(told[s][c]), many)
        self.key_n, self.seen_n, self.seen_d = at_keys

    def decisions(self, total: int) -> Decisions:
        return Decisions(self.block, self.train, total, self.token_n, self.key_n, self.seen_n, self.seen_d)


#: What a block has learned, and what scoring its texts by the whole model takes: no count is looked up again.
READ = "block int, mass binary, tables binary, weights binary, seen binary, counts binary, marks binary, slots binary, sums binary, odd binary, odd_text binary, odd_id binary"


def read_block(r: Reader, n: int, v: int) -> tuple:
    """`READ` of a block but its number, its rows in the reader's order; n, v: training tokens and distinct ones."""
    b, d, decider, texts = r.block, r.decisions(n), Decider(), len(r.texts)
    mass = np.array([float(decider.learn(d, r.train))])
    base = np.log10(r.token_n + 1.0) - math.log10(n + v + 1)
    letters = np.array([0 if t == END else len(t) for t in b.vocab])
    # Of each text: choices' bits, bytes with blanks and the end, tokens, known ones, the base's score.
    sums = np.stack([np.bincount(b.text, x, texts) for x in (d.choice, letters[b.ids] + 1, np.ones(len(b.ids)), r.token_n[b.ids] > 0, base[b.ids])])
    at = np.flatnonzero(d.spelled)
    odd, which = np.unique(b.ids[at], return_inverse=True)
    names = [b.vocab[i] for i in odd.tolist()]
    # No word has white space, so it parts them; the end, which is white space, is written as a tab.
    spelled = b" ".join(b"\t" if t == END else t for t in names)
    return (*(_pack(x) for x in (mass, decider.tables, mass * decider.weights, decider.seen)), *d.pack(texts), sums.tobytes(), spelled, b.text[at].astype(np.int32).tobytes(), which.astype(np.int32).tobytes())


def learned(read: DataFrame) -> Decider:
    """The decisions' model of all training texts: each block has learned from its own, and what the blocks have learned is put together."""
    names = ["mass", "tables", "weights", "seen"]
    got = _folded(read.select("block", *names), names)
    if not got or not got["mass"][0]:
        return Decider()
    return Decider(got["tables"].reshape(DECIDERS, -1, 2), (got["weights"] / got["mass"][0]).reshape(DECISION_GATES, -1), got["seen"].reshape(DECISION_GATES, MAP_CELLS, 2))


def score(docs: DataFrame, *, folds: int = 7, held: int = 2, block_bytes: int = 6 << 20, shard_bytes: int = 12 << 20) -> DataFrame:
    """Train on the rows whose crc32(doc_id as text) mod `folds` isn't `held`; score all.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) and bits_per_byte.
    """
    spark = docs.sparkSession
    src = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"), (id_crc(F.col("doc_id")) % folds == held).alias("held_out"))
    size = src.agg(F.sum(F.octet_length("text"))).first()[0]
    blocks, shards = blocks_for(size, block_bytes), blocks_for(size, shard_bytes)
    dealt = src.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))

    def asked(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        train = ~table.column("held_out").to_numpy().astype(bool)
        for row in ask(key[0].as_py(), table.column("text").to_pylist(), train, shards):
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.bool_(), *[pa.binary()] * 4), strict=True)], names=[x.split()[0] for x in ASKED.split(", ")])

    told = stored(dealt.groupBy("block").applyInArrow(asked, ASKED).groupBy("shard").applyInArrow(answer, ANSWERED), "told")
    n, v = (x or 0 for x in told.where("block = -1").agg(F.sum("n"), F.sum("v")).first())
    types = told.where("block = -1").select("types", "shard").repartition(shards, "shard")
    answers = told.where("block >= 0")
    rows = dealt.groupBy("block")

    let_go(spark)
    model = Model(*_spelling(types), n, v)
    name = uuid.uuid4().hex
    shared = spark.sparkContext.broadcast(model.pack())
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def read(key, left: pa.Table, right: pa.Table) -> pa.Table:
        r = Reader(left, right, shards)
        ids, held = (pa.array([left.column(c).take(pa.array(r.order)).to_pylist()], pa.list_(left.schema.field(c).type)) for c in ("doc_id", "held_out"))
        cols = zip(READ.split(", "), (left.column("block")[0].as_py(), *read_block(r, n, v)), strict=True)
        named = {c.split()[0]: pa.array([x], pa.int32() if c.endswith(" int") else pa.binary()) for c, x in cols}
        return pa.table({"ids": ids, "held": held, **named})

    blocks_read = stored(rows.cogroup(answers.groupBy("block")).applyInArrow(read, f"ids array<{id_type}>, held array<boolean>, {READ}"), "read", "zstd")
    released(told)
    whole = learned(blocks_read)
    decided = spark.sparkContext.broadcast([_pack(x) for x in (whole.tables, whole.weights, whole.seen)])

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, lookup = unpacked(name, shared)
        tables, weights, seen = map(_unpack, decided.value)
        decider = Decider(tables.reshape(DECIDERS, -1, 2), weights.reshape(DECISION_GATES, -1), seen.reshape(DECISION_GATES, MAP_CELLS, 2))
        for batch in batches:
            for i in range(batch.num_rows):
                at = {c: batch.column(c)[i] for c in batch.schema.names}
                ids, held = at["ids"].values, at["held"].values
                d = Steps.unpack(*(at[c].as_py() for c in ("counts", "marks", "slots")))
                choice, size, length, known, base = np.frombuffer(at["sums"].as_py(), np.float64).reshape(5, len(ids))
                odd, odd_text, odd_id = at["odd"].as_py(), *(np.frombuffer(at[c].as_py(), np.int32) for c in ("odd_text", "odd_id"))
                spelled = token_bits([END if t == b"\t" else t for t in odd.split(b" ")] if odd else [], m.code, lookup, m.mixer)
                bits = decider.bits(d, len(ids)) + choice + np.bincount(odd_text, spelled[odd_id], len(ids))
                cols = [ids, held, pa.array(length.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(np.full(len(ids), m.n)), pa.array(base), pa.array(-bits * math.log10(2)), pa.array(bits / size)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])

    schema = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return blocks_read.select("ids", "held", "counts", "marks", "slots", "sums", "odd", "odd_text", "odd_id").mapInArrow(rate, schema)


_models: dict[str, tuple[Model, Lookup]] = {}


def unpacked(name: str, shared) -> tuple[Model, Lookup]:
    """The broadcast model of that name, unpacked once for each worker process."""
    if name not in _models:
        _models.clear()
        model = Model.unpack(shared.value)
        lookup, model.tables = Lookup(model.tables), None
        _models[name] = model, lookup
    return _models[name]
