"""Mixing sources to target weights.

Each source's documents, in a fixed order, are one stream of words that is packed into
blocks of a fixed length. Output shards of `slots_per_shard` slots draw how many of their slots each
source fills: multinomial counts, conditioned on the sources' totals, so that these are
met exactly. The draws follow from a keyed permutation of all slots (`shard_draws`), so any task can make any shard's draws, at any size of the corpus.
A source's n-th slot reads block `permutation[n mod blocks]`, with another keyed permutation
for each pass over the source; the last slot is cut to the word at which the target is
reached. Slots and blocks are joined on (source, block).

Targets: the sources' weights share the total; one that would pass `max_repeat` times its
size stops there and the excess is shared again by weight. Because each pass is a permutation,
no block is read more than `max_repeat` times.

Null texts and texts without words have size 0 and are never taken. A null source is a
source of its own, the last. Rows that are equal in id and text are separate rows of the
stream. An empty table gives an empty table; a source of no words gets nothing. Other
columns are ignored (`mix_plan`) or kept (`mix_documents`). Texts are counted whole. The sources' summary (name, size) is held by
the driver and broadcast; nothing else is. It is configuration: more than `MAX_SOURCES` sources are an error.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entloom.llm.common import stored, word_array


#: Sources have weights that someone sets; a column with more values (hosts, say) is not one of sources.
MAX_SOURCES = 100_000


def targets(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Shares of `total` by weight, none over `most` times its size; the excess goes to the others by weight."""
    out, open_ = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    left = float(total)
    while open_:
        per = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if per * weights[i] > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = per * weights[i]
            break
        for i in full:
            out[i] = float(most * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def _key(*parts) -> int:
    return int.from_bytes(hashlib.blake2b(":".join(map(str, parts)).encode(), digest_size=8).digest(), "big")


def _feistel(n: int, key: int) -> tuple[np.uint64, np.uint64, list[np.uint64]]:
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    return np.uint64(half), np.uint64((1 << half) - 1), [np.uint64(_key(key, r)) for r in range(4)]


def _round(b: np.ndarray, k: np.uint64, mask: np.uint64) -> np.ndarray:
    h = (b + k) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(32)) & mask


def _walked(x: np.ndarray, n: int, step) -> np.ndarray:
    """`step`, a permutation of more than range(n), until it lands within the range."""
    with np.errstate(over="ignore"):
        out = step(x.astype(np.uint64))
        while (far := out >= n).any():
            out[far] = step(out[far])
    return out.astype(np.int64)


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of range(n): a four-round Feistel network."""
    if n <= 1:
        return np.zeros_like(index)
    half, mask, rounds = _feistel(n, key)

    def step(x):
        a, b = x >> half, x & mask
        for k in rounds:
            a, b = b, a ^ _round(b, k, mask)
        return (a << half) | b

    return _walked(index, n, step)


def place_of(value: np.ndarray, n: int, key: int) -> np.ndarray:
    """The inverse of `permute`."""
    if n <= 1:
        return np.zeros_like(value)
    half, mask, rounds = _feistel(n, key)

    def step(x):
        a, b = x >> half, x & mask
        for k in reversed(rounds):
            a, b = b ^ _round(a, k, mask), a
        return (a << half) | b

    return _walked(value, n, step)


class Source:
    """One source's stream and how much of it the mix takes."""

    def __init__(self, number: int, size: int, target: float, block: int, seed: int):
        self.number, self.size, self.block, self.seed = number, size, block, seed
        self.blocks = -(-size // block)
        self.words = int(target)  # whole words, never above the target
        self.passes, rest = divmod(self.words, size) if size else (0, 0)
        self.slots, self.cut = self.passes * self.blocks, 0
        if rest:  # the last pass: slots until the words are reached; one block of it may be short
            short = size - (self.blocks - 1) * block
            at = int(place_of(np.array([self.blocks - 1]), self.blocks, _key(self.seed, self.number, self.passes))[0])
            whole = at * block  # words before the short block
            if rest <= whole or short == block:
                n = -(-rest // block)
                self.cut = rest - (n - 1) * block
            elif rest <= whole + short:
                n, self.cut = at + 1, rest - whole
            else:
                more = rest - whole - short
                n = at + 1 + -(-more // block)
                self.cut = more - (n - at - 2) * block
            self.slots += n

    def order(self, at: np.ndarray, turn: int) -> np.ndarray:
        return permute(at, self.blocks, _key(self.seed, self.number, turn))

    def read(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pass, block and words taken from the block's start, of slots by their number in the source."""
        turn, at = np.divmod(slot, self.blocks)
        block = np.empty(len(slot), np.int64)
        for t in np.unique(turn):
            block[turn == t] = self.order(at[turn == t], int(t))
        words = np.minimum(self.block, self.size - block * self.block)
        if self.cut:
            words[slot == self.slots - 1] = self.cut
        return turn, block, words


def shard_draws(counts: np.ndarray, shard: int, slots_per_shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """For each slot of a shard its source and its number in the source.

    A keyed permutation deals the places of all slots; each source owns a run of them. How many of a shard's slots a source fills is then a
    multinomial draw given the totals (a hypergeometric one), at any total, and no two slots are the same.
    """
    total = int(counts.sum())
    slots = np.arange(shard * slots_per_shard, min(total, (shard + 1) * slots_per_shard), dtype=np.int64)
    place = permute(slots, total, _key(seed, "slots"))
    stop = np.cumsum(counts)
    which = np.searchsorted(stop, place, "right")
    return which, place - (stop - counts)[which]


def _positions(docs: DataFrame, order: list[str]) -> DataFrame:
    """`docs` (with __source, __size) with __from: the words of its source before it.

    Two levels, so that a hot source is not one task: rows go to (source, bucket) by the hash of their order's
    columns, are summed within it, and the buckets' sums are added up by source.
    """
    n = max(1, math.isqrt(docs.count()) // 3)  # both levels grow with the root of the rows
    dealt = docs.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(n)))
    w = Window.partitionBy("__source", "__bucket").orderBy(*order, "__size")
    inner = dealt.withColumn("__in", F.sum("__size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__size"))
    sums = dealt.groupBy("__source", "__bucket").agg(F.sum("__size").alias("__n"))
    before = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, 0)
    offset = sums.withColumn("__before", F.sum("__n").over(before) - F.col("__n")).drop("__n")
    return inner.join(offset, ["__source", "__bucket"]).withColumn("__from", F.col("__before") + F.col("__in")).drop("__bucket", "__in", "__before")


def mix_slots(docs: DataFrame, weights: tuple[float, ...], *, text: str = "text", source: str = "source", id_col: str = "doc_id", block: int = 1024, slots_per_shard: int = 256, max_repeat: int = 3, total_share: float = 1.0, seed: int = 17):
    """(documents with their place in their source's stream, slots with the block they read).

    Documents: every column of `docs` but the text, with __source (number), __size, __from, __source_size and
    __target. Slots: __shard, __slot, __source, __pass, __block, __words.
    """
    spark = docs.sparkSession
    sized = docs.withColumn("__size", F.size(word_array(F.col(text).cast("string"))).cast("long"))
    found = [r for r in sized.groupBy(F.col(source).alias("s")).agg(F.sum("__size").alias("n")).limit(MAX_SOURCES + 1).collect()]
    if len(found) > MAX_SOURCES:
        raise ValueError(f"{source} has more than {MAX_SOURCES} values")
    found.sort(key=lambda r: (r["s"] is None, r["s"] or ""))  # Python compares strings by code point
    sizes = [r["n"] for r in found]
    share = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], total_share * sum(sizes), max_repeat)
    sources = [Source(i, n, t, block, seed) for i, (n, t) in enumerate(zip(sizes, share, strict=True))]
    listed = spark.createDataFrame([(r["s"], i, sizes[i], share[i]) for i, r in enumerate(found)], T.StructType([T.StructField("__name", docs.schema[source].dataType), T.StructField("__source", T.IntegerType()), T.StructField("__source_size", T.LongType()), T.StructField("__target", T.DoubleType())]))
    numbered = sized.join(F.broadcast(listed), sized[source].eqNullSafe(listed["__name"])).drop("__name")
    counts = np.array([s.slots for s in sources], dtype=np.int64)
    shards = -(-int(counts.sum()) // slots_per_shard) if len(counts) else 0

    def draw(batches):
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                which, number = shard_draws(counts, shard, slots_per_shard, seed)
                if not len(which):
                    continue
                read = [np.empty(len(which), np.int64) for _ in range(3)]
                for k in np.unique(which).tolist():
                    for out, got in zip(read, sources[k].read(number[which == k]), strict=True):
                        out[which == k] = got
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(which), shard)), pa.array(np.arange(len(which))), pa.array(which.astype(np.int32)), *map(pa.array, read)], names=["__shard", "__slot", "__source", "__pass", "__block", "__words"])

    slots = spark.range(shards).mapInArrow(draw, "__shard long, __slot long, __source int, __pass long, __block long, __words long")
    return numbered, slots


def mix_plan(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), **how) -> DataFrame:
    """How many words of each document the mix takes: doc_id, size, source_size, target, taken."""
    block = how.get("block", 1024)
    rows, slots = mix_slots(docs.select("doc_id", "text", "source"), weights, **how)
    # Small from here on: ids and numbers, kept for the three uses below.
    rows = stored(rows.withColumn("__hash", F.xxhash64("text")).drop("text", "source"), "mix")
    placed = _positions(rows, ["doc_id", "__hash"])
    hits = _pieces(placed, slots, block)
    words = F.greatest(F.lit(0), F.least(F.col("__hi"), F.col("__words")) - F.col("__lo"))
    taken = hits.groupBy("__source", "__from").agg(F.sum(words).alias("__taken"))
    # A document without words shares its place with the next one; only that one has pieces.
    out = placed.join(taken, ["__source", "__from"], "left")
    got = F.when(F.col("__size") > 0, F.coalesce("__taken", F.lit(0))).otherwise(0)
    return out.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), got.cast("long").alias("taken"))


def _pieces(placed: DataFrame, slots: DataFrame, block: int) -> DataFrame:
    """Documents cut at block boundaries, joined with the slots that read those blocks.

    __lo and __hi are the piece's words within the block, __start its first word within the document.
    """
    last = (F.col("__from") + F.col("__size") - 1) / block
    cut = placed.where("__size > 0").withColumn("__block", F.explode(F.sequence(F.floor(F.col("__from") / block), F.floor(last))))
    cut = cut.withColumn("__lo", F.greatest(F.lit(0), F.col("__from") - F.col("__block") * block)).withColumn("__hi", F.least(F.lit(block), F.col("__from") + F.col("__size") - F.col("__block") * block))
    # The slots grow with the corpus, which the planner can't see behind the Python step: no broadcast.
    return cut.join(slots.hint("merge"), ["__source", "__block"])


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), **how) -> DataFrame:
    """The mix as documents: for each pass over a source, the runs of each document's words that it takes.

    A document that a pass takes whole keeps its text as it is; of others each run of taken words is a row, cut out of
    the text with the white space within. The columns are those of `docs`; n_chars, where there is one, is counted anew.
    """
    block = how.get("block", 1024)
    keep = docs.columns
    rows, slots = mix_slots(docs, weights, **how)
    rows = stored(rows.withColumn("__hash", F.xxhash64("text")), "mix")
    placed = _positions(rows.select("doc_id", "__hash", "__source", "__size"), ["doc_id", "__hash"])
    hits = _pieces(placed, slots, block).withColumn("__to", F.least("__hi", "__words")).where("__to > __lo")
    start = F.col("__lo") + F.col("__block") * block - F.col("__from")
    runs = hits.groupBy("doc_id", "__hash", "__size", "__from", "__pass").agg(F.array_sort(F.collect_list(F.struct(start.alias("a"), (start + F.col("__to") - F.col("__lo")).alias("b")))).alias("__runs"))
    # Equal rows are interchangeable: number them on both sides and join on the number.
    same = Window.partitionBy("doc_id", "__hash", "__size")
    spans = runs.groupBy("doc_id", "__hash", "__size", "__from").agg(F.collect_list("__runs").alias("__all"))
    spans = spans.withColumn("__nth", F.row_number().over(same.orderBy("__from")))
    whole = rows.withColumn("__nth", F.row_number().over(same.orderBy("__source")))
    joined = whole.join(spans.drop("__from"), ["doc_id", "__hash", "__size", "__nth"])
    fields = docs.schema
    schema = T.StructType([*fields])

    def cut(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                at, texts = [], []
                for k, (body, size, all_runs) in enumerate(zip(part.column("__body").to_pylist(), part.column("__size").to_pylist(), part.column("__all").to_pylist(), strict=True)):
                    for piece in cut_runs(body, size, all_runs):
                        at.append(k)
                        texts.append(piece)
                if not at:
                    continue
                rows_ = part.select(keep).take(pa.array(at))
                cols = {"text": pa.array(texts, pa.string())}
                if "n_chars" in keep:
                    cols["n_chars"] = pa.array([len(t) for t in texts], rows_.schema.field("n_chars").type)
                yield pa.RecordBatch.from_arrays([cols.get(c, rows_.column(c)) for c in keep], names=keep)

    return joined.select(*keep, F.col("text").cast("string").alias("__body"), "__size", "__all").mapInArrow(cut, schema)


def cut_runs(text: str, size: int, passes: list[list[dict]]) -> list[str]:
    """The taken runs of a text's words: neighbouring pieces joined, whole texts as they are."""
    import re

    out, bounds = [], None
    for runs in passes:
        merged = []
        for a, b in sorted((r["a"], r["b"]) for r in runs):
            if merged and merged[-1][1] == a:
                merged[-1][1] = b
            else:
                merged.append([a, b])
        for a, b in merged:
            if a == 0 and b == size:
                out.append(text)
                continue
            bounds = bounds or [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
            out.append(text[bounds[a][0] : bounds[b - 1][1]])
    return out
