"""Substring dedup: passages that recur, nearly or exactly, in other texts.

A text is the sequence of its shingles (five words, lower case). Under one min-hash function, the
Cartesian tree over the shingles' hashes names for each range of positions where its least hash lies; each
node (l, c, r) stands for all subsequences that begin in [l, c] and end in [c, r] and so share that least hash. Only nodes at least as wide as
the shortest passage matter (`compact_windows`): about 2 n / width for each function, whatever the number of subsequences.

A passage that holds c reaches at least half of its width to one side of c. So a window's signatures are its least hash
together with the least hash, by another function, of the half width before c, and of that after c (`side_signatures`). Equal passages
share one of them for certain; texts that only share a frequent phrase rarely do.

Texts of equal words are one class, which its least document stands for; the others of the class recur as a whole. Windows of different
classes that share a signature are joined to the one of the smallest document, the hub, so a passage in many texts makes as many pairs
as texts, not their square. Windows whose place lies in no passage verified so far are then compared with all others of the signature that come
earlier, in chunks, by the shingles beside the place (`neighbours`), and meet the one that agrees best. Those that this explains no more than
the hub did meet the next 8, then the next 64 and so on, until a passage holds their place or all that agree have been met. For each pair of texts an interval
join gathers windows that overlap in both, across the functions. Candidates are
verified on the shingles themselves: the runs in which at least `similarity` of the shingles recur, no shorter than
`min_words`, and whose shingle sets have a Jaccard similarity of at least that.

The result is a row for each recurring passage of a document and an earlier document that has it: document, first word and
end (exclusive) there, the other document and its words; a document equal to an earlier one has one row, for the whole of it. The smallest document of a group
has no row of its own for it. `cut_passages` removes such passages; the hub keeps them.

Signatures are samples, so near passages are found with a probability (README); equal ones always meet.

Null text counts as empty and has no passage. Rows of null or repeated id are documents of their own, told apart by
their text, and come after all others; equal rows (id and text) are one document; ids that aren't whole numbers are ordered by hash. Ties of hashes go to the first position, or, in
texts that repeat themselves so much that the tree would be deep, to a place by hash. Other
columns are ignored, an empty table gives an empty table. Texts are read whole.
"""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entloom.llm.common import lower_words_of, released, stored
from entloom.llm.trie_join import Words, gram_hashes, is_live, live_filter, mix64


def compact_windows(h: np.ndarray, width: int) -> np.ndarray:
    """Rows (l, c, r): the Cartesian tree's nodes that span at least `width` positions; c is the place of the least hash."""
    if len(h) < width:
        return np.zeros((0, 3), np.int32)
    out, stack, work, most = [], [(0, len(h))], 0, 64 * len(h)
    pop, push = stack.pop, stack.append
    while stack:
        lo, hi = pop()
        work += hi - lo
        if work > most:  # many equal hashes; among distinct ones in an order by hash the tree is shallow
            order = np.lexsort((mix64(np.arange(len(h), dtype=np.uint64) + np.uint64(1)), h))
            h, work, most = np.empty(len(h), np.int64), 0, 1 << 62
            h[order] = np.arange(len(h))
            out.clear()
            stack[:] = [(0, len(h))]
            continue
        c = lo + int(h[lo:hi].argmin())
        out += (lo, c, hi - 1)
        if c - lo >= width:
            push((lo, c))
        if hi - c > width:
            push((c + 1, hi))
    return np.array(out, np.int32).reshape(-1, 3)


def signature_hashes(shingles: np.ndarray, functions: int) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        return [mix64(shingles ^ (np.uint64(k + 1) * np.uint64(0x9E3779B97F4A7C15))) for k in range(functions)]


def least_ahead(g: np.ndarray, size: int) -> np.ndarray:
    """The least of each `size` neighbours, by their first position."""
    out, span = g, 1
    while 2 * span <= size:
        out, span = np.minimum(out[:-span], out[span:]), 2 * span
    return np.minimum(out[: len(g) - size + 1], out[size - span :][: len(g) - size + 1])


def side_signatures(h: np.ndarray, least: np.ndarray, at: np.ndarray, half: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the window, signature) for each side of a window (l, c, r) on which it has `half` positions beside c."""
    l, c, r = at.T
    rows, sigs = [], []
    with np.errstate(over="ignore"):
        for side, ok, first in ((1, c - half >= l, c - half), (2, c + half <= r, c + 1)):
            hit = np.flatnonzero(ok)
            x = mix64(h[c[hit]] + least[first[hit]] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(side))
            rows.append(hit)
            sigs.append((x & np.uint64(0x0FFFFFFFFFFFFFFF)).astype(np.int64) * 8 + k)
    return np.concatenate(rows), np.concatenate(sigs)


def join_intervals(rows: list[tuple[int, int, int, int, int]], enough: int) -> list[tuple[int, int, int, int]]:
    """Spans (in the one text, in the other) where windows of `enough` functions overlap in both.

    rows: (function, l, r, l', r') of the windows that two texts share.
    """
    groups: list[list] = []
    done: list[list] = []
    for k, l, r, m, s in sorted(rows, key=lambda x: x[1:]):
        joined, gone = None, False
        if len(groups) > 32:  # what ends before l can't be joined any more
            done += [g for g in groups if g[2] < l]
            groups = [g for g in groups if g[2] >= l]
        for g in groups:
            if l <= g[2] and g[1] <= r and m <= g[4] and g[3] <= s:
                if joined is None:
                    g[0].add(k)
                    g[1:] = min(g[1], l), max(g[2], r), min(g[3], m), max(g[4], s)
                    joined = g
                else:  # it joins two groups
                    joined[0] |= g[0]
                    joined[1:] = min(joined[1], g[1]), max(joined[2], g[2]), min(joined[3], g[3]), max(joined[4], g[4])
                    g[0], gone = None, True
        if joined is None:
            groups.append([{k}, l, r, m, s])
        elif gone:
            groups = [g for g in groups if g[0] is not None]
    return [tuple(g[1:]) for g in [*done, *groups] if len(g[0]) >= enough]


def _sums(hit: np.ndarray, share: float) -> np.ndarray:
    """Prefix sums of scores: a hit counts 1 - share, a miss -share, so a run of which `share` are hits has no negative sum."""
    return np.concatenate(([0.0], np.cumsum(np.where(hit, 1 - share, -share))))


def _longest(hit: np.ndarray, share: float, width: int) -> tuple[int, int]:
    """The longest run [a, b) of which `share` are hits; misses at its ends go as far as `width` positions stay."""
    total = _sums(hit, share)
    # For each start the last stop whose sum is not below: the suffix maxima fall, so it is found by bisection.
    after = np.maximum.accumulate(total[::-1])
    stop = len(hit) - np.searchsorted(after, total - 1e-9)
    a = int((stop - np.arange(len(total))).argmax())
    b = int(stop[a])
    while b - a > width and not hit[b - 1]:
        b -= 1
    while b - a > width and not hit[a]:
        a += 1
    return a, b


def _densest(hit: np.ndarray, share: float, width: int) -> tuple[int, int]:
    """The run [a, b) of the greatest sum: no miss stands at its ends."""
    total = _sums(hit, share)
    b = int((total - np.minimum.accumulate(total)).argmax())
    return int(total[: b + 1].argmin()), b


def dense_runs(hit: np.ndarray, share: float, width: int, pick=_longest) -> list[tuple[int, int]]:
    """Disjoint runs [a, b) of at least `width` positions, of which `share` are hits: the longest, then those beside it."""
    out, stack = [], [(0, len(hit))]
    while stack:
        lo, hi = stack.pop()
        if hi - lo < width:
            continue
        a, b = pick(hit[lo:hi], share, width)
        if b - a < width:
            continue
        out.append((lo + a, lo + b))
        stack += [(lo, lo + a), (lo + b, hi)]
    return out


def _within(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of `a` are in `b`."""
    if not len(b):
        return np.zeros(len(a), bool)
    held = np.sort(b)
    return held[np.minimum(np.searchsorted(held, a), len(held) - 1)] == a


def _counterpart(mine: np.ndarray, b: np.ndarray, share: float, width: int) -> tuple[int, int, float] | None:
    """Where the other text has these shingles, the dense run most like them, and the Jaccard similarity."""
    hit, best = _within(b, mine), None
    for x, y in {*dense_runs(hit, share, width), *dense_runs(hit, share, width, _densest)}:
        other = b[x:y]
        like = len(np.intersect1d(mine, other)) / len(np.union1d(mine, other))
        if best is None or (like, -x, y) > (best[2], -best[0], best[1]):
            best = x, y, like
    return best


def _parts(hit: np.ndarray) -> tuple[list[int], list[int]]:
    """First positions and stops of the unbroken runs of hits."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return edge[::2].tolist(), edge[1::2].tolist()


def verify(a: np.ndarray, b: np.ndarray, similarity: float, width: int) -> list[tuple[int, int, int, int, float]]:
    """Passages (a's first and stop, b's first and stop, similarity) of two shingle sequences.

    Two runs of equal length of which a share of 2 s / (1 + s) recurs have a similarity of s. A run that falls short
    of it as a whole is tried without its outer parts, longest first, and then beside what was found.
    """
    out, share = [], 2 * similarity / (1 + similarity)
    hit = _within(a, b)
    if np.count_nonzero(hit) < share * width - 1e-9:
        return out

    def found(lo: int, hi: int) -> bool:
        other = _counterpart(a[lo:hi], b, share, width)
        if other is None or other[2] < similarity:
            return False
        out.append((lo, hi, *other))
        return True

    for run in dense_runs(hit, share, width):
        if found(*run):
            continue
        start, stop = ([run[0] + x for x in side] for side in _parts(hit[run[0] : run[1]]))
        hits = np.concatenate(([0], np.cumsum(hit[run[0] : run[1]])))
        todo = [(0, len(start))]
        while todo:
            first, last = todo.pop()
            spans = ((i, i + n) for n in range(last - first, 0, -1) for i in range(first, last - n + 1))
            for i, j in spans:
                lo, hi = start[i], stop[j - 1]
                if hi - lo >= width and hits[hi - run[0]] - hits[lo - run[0]] >= share * (hi - lo) - 1e-9 and found(lo, hi):
                    todo += [(first, i), (j, last)]
                    break
    return out


#: Bit masks of the shingles in the two blocks before a signature's place and the two after it.
BLOCKS = ("before2", "before1", "after1", "after2")


def neighbours(s: np.ndarray, at: list[tuple[int, int, int]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each (l, r, c) the masks of the blocks of a third of `width` beside c, within the window, and a bit for each that is whole.

    A passage that holds c has two whole blocks of its width beside c, one after the other or on either side.
    """
    size = max(1, (width - 1) // 3)
    bit = np.uint64(1) << (mix64(s) >> np.uint64(58))
    l, r, c = np.array(at, np.int64).reshape(-1, 3).T
    out = np.zeros((len(at), 4), np.uint64)
    for k, step in enumerate((-2, -1, 1, 2)):
        for i in range(size):
            x = c + (i + 1 + size * (step - 1) if step > 0 else size * (step + 1) - i - 1)
            inside = (x >= l) & (x <= r)
            out[inside, k] |= bit[x[inside]]
    whole = (c - 2 * size >= l) + 2 * (c - size >= l) + 4 * (c + size <= r) + 8 * (c + 2 * size <= r)
    return out.view(np.int64), whole.astype(np.int32)


def alike_beside(one: np.ndarray, whole: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Which pairs of windows (rows of masks) have two whole blocks in a row of whose bits the other has three quarters, and three fifths in each.

    Of a passage at similarity 0.8 eight in nine shingles recur; a changed word takes five of the two blocks' thirty or so.
    """
    size = np.bitwise_count(one).astype(np.int16)
    least = np.maximum(1, size * 3 // 5)
    both = [np.bitwise_count(one[:, k, None] & more[None, :, k]).astype(np.int16) for k in range(4)]
    same = [(both[k] >= least[:, k, None]) & (whole >> k & 1).astype(bool)[:, None] for k in range(4)]
    ok = np.zeros(same[0].shape, bool)
    for k in range(3):
        ok |= same[k] & same[k + 1] & (4 * (both[k] + both[k + 1]) >= 3 * (size[:, k] + size[:, k + 1])[:, None])
    return ok


def meet_next(take: int):
    """Of each open window and the earlier windows of its signature that are alike beside it, the `take` that agree in most bits.

    They are ranked by score and key, and only those behind (`after_score`, `after_key`) count, which the window met last; equal ones of
    the last rank all count. Rows come sorted by (sig, a, b), a group is two chunks at most; the best of several groups are for the caller to choose.
    """

    def pairs_of(t: pa.Table):
        at = {c: t.column(c).to_numpy() for c in ("sig", "a", "b", "mine", "key", "l", "r", "c", "d", "open", "after_score", "after_key")}
        masks = np.stack([t.column(c).to_numpy() for c in BLOCKS], axis=1).view(np.uint64)
        edge = np.flatnonzero(np.concatenate(([True], *((np.any([at[c][1:] != at[c][:-1] for c in ("sig", "a", "b")], axis=0),) if t.num_rows > 1 else ()), [True])))
        some = np.flatnonzero((np.maximum.reduceat(at["open"], edge[:-1]) > 0) & (np.diff(edge) > 1))
        for lo, hi in zip(edge[some].tolist(), edge[some + 1].tolist(), strict=True):
            mine, key = at["mine"][lo:hi], at["key"][lo:hi]
            asks = lo + np.flatnonzero(at["open"][lo:hi] > 0)
            for one in np.array_split(asks, -(-len(asks) // 256) or 1):
                if not len(one):
                    continue
                ok = (key[None, :] < at["key"][one][:, None]) & alike_beside(masks[one], at["open"][one], masks[lo:hi])
                if at["a"][lo] != at["b"][lo]:  # pairs within a chunk are met where both are the same
                    ok &= mine[one - lo][:, None] != mine[None, :]
                whole = at["open"][one]
                score = sum(np.bitwise_count(masks[one][:, k, None] & masks[lo:hi][None, :, k]) * (whole >> k & 1)[:, None].astype(np.uint8) for k in range(4)).astype(np.int32)
                last = at["after_score"][one][:, None]
                ok &= (score < last) | ((score == last) & (key[None, :] > at["after_key"][one][:, None]))
                x, y = np.nonzero(ok)
                if not len(x):
                    continue
                order = np.lexsort((key[y], -score[x, y], x))
                x, y = x[order], y[order]
                first = np.searchsorted(x, np.arange(len(one)))
                end = np.searchsorted(x, np.arange(len(one)), "right")
                bound = np.minimum(first + take, end)[x] - 1  # the last of the window's ranks that count
                stay = (score[x, y] > score[x[bound], y[bound]]) | ((score[x, y] == score[x[bound], y[bound]]) & (key[y] <= key[y[bound]]))
                x, y = x[stay], y[stay]
                i, j = one[x], y + lo
                cols = [at["sig"][i], at["key"][i], at["c"][i], at["d"][i], at["key"][j], score[x, y], *(at[c][n] for n in (i, j) for c in ("l", "r"))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["sig", "key", "c", "d", "other", "score", "l", "r", "m", "s"])

    def run(batches: Iterator[pa.RecordBatch]):
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            last = [t.column(c)[t.num_rows - 1].as_py() for c in ("sig", "a", "b")]
            keys = [t.column(c).to_numpy() for c in ("sig", "a", "b")]
            cut = int(np.flatnonzero(~np.all([k == v for k, v in zip(keys, last, strict=True)], axis=0)).max(initial=-1)) + 1
            if cut:
                yield from pairs_of(t.slice(0, cut).combine_chunks())
            rest = t.slice(cut)
        if rest is not None and rest.num_rows:
            yield from pairs_of(rest.combine_chunks())

    return run


def _whole_number(docs: DataFrame) -> bool:
    return docs.schema["doc_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")


def _odd_key(text: Column) -> Column:
    """A key for rows of null, repeated or other ids: above all whole numbers in use, made of id and text."""
    return F.lit(1 << 62) + F.pmod(F.xxhash64("doc_id", text), F.lit(1 << 62))


def _keyed(docs: DataFrame) -> DataFrame:
    """key, doc_id, text: the id itself where it is a whole number, not null and not repeated; else `_odd_key`."""
    src = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"))
    odd = _odd_key(F.col("text"))
    if not _whole_number(docs):
        return src.withColumn("key", odd).dropDuplicates(["key"])
    again = src.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").select(F.col("doc_id").alias("again"))
    again = stored(again, "again")
    if not again.take(1):
        return src.withColumn("key", F.col("doc_id").cast("long"))
    marked = src.join(again, src["doc_id"].eqNullSafe(again["again"]), "left_semi").withColumn("key", odd).dropDuplicates(["key"])
    return src.join(again, src["doc_id"].eqNullSafe(again["again"]), "left_anti").withColumn("key", F.col("doc_id").cast("long")).unionByName(marked)


def find_passages(docs: DataFrame, *, shingle: int = 5, min_words: int = 50, similarity: float = 0.8, functions: int = 3, bin_rows: int = 20_000, chunk: int = 2048, task_rows: int = 500_000) -> DataFrame:
    """Passages of at least `min_words` words that recur: doc_id, first, stop, other_doc_id, other_first, other_stop, similarity."""
    width = min_words - shingle + 1
    half = max(1, (width - 1) // 2)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    spark = docs.sparkSession
    src = _keyed(docs)

    def shingles_of(text, known: Words) -> np.ndarray:
        words = lower_words_of(text)
        return gram_hashes(words, shingle, known) if len(words) >= shingle else np.zeros(0, np.uint64)

    def index(batches: Iterator[pa.RecordBatch]):
        known = Words()
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                n, cls, sizes, windows, sigs = [], [], [], [], []
                for text in part.column(2):
                    words = lower_words_of(text.as_py())
                    n.append(len(words))
                    cls.append(xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63))
                    s = gram_hashes(words, shingle, known) if len(words) >= shingle else np.zeros(0, np.uint64)
                    sizes.append(0)
                    if len(s) < width:
                        continue
                    with np.errstate(over="ignore"):
                        least = least_ahead(mix64(s + np.uint64(0xD6E8FEB86659FD93)), half)
                    for k, h in enumerate(signature_hashes(s, functions)):
                        at = compact_windows(h, width)
                        which, sig = side_signatures(h, least, at, half, k)
                        windows.append(at[which])
                        sigs.append(sig)
                        sizes[-1] += len(which)
                offsets = pa.array(np.cumsum([0, *sizes]), pa.int32())
                at = np.concatenate(windows) if windows else np.zeros((0, 3), np.int32)
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (np.concatenate(sigs) if sigs else np.zeros(0, np.int64), *(at[:, i].copy() for i in range(3)))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), *lists], names=["key", "doc_id", "n", "cls", "sigs", "l", "c", "r"])

    indexed = stored(src.select("key", "doc_id", "text").mapInArrow(index, f"key long, doc_id {id_type}, n long, cls long, sigs array<long>, l array<int>, c array<int>, r array<int>"), "indexed")
    facts = stored(indexed.select("key", "doc_id", "n", "cls"), "facts")
    first_of = facts.groupBy("cls").agg(F.min("key").alias("first_key"), F.count(F.lit(1)).alias("copies"))
    copies = stored(facts.join(first_of.where("copies > 1"), "cls").where("key != first_key").select("key", "n", F.col("first_key").alias("other")), "copies")
    # Signatures that several classes have, and the least document that has them: one that stands for its class.
    rows = indexed.select("key", "cls", F.explode("sigs").alias("sig"))
    hubs = rows.groupBy("sig").agg(F.min("key").alias("hub"), F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo != hi").select("sig", "hub")
    hubs = stored(hubs, "hubs")
    shared = live_filter(hubs)

    def keep(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            sigs = batch.column(1)
            sig = sigs.flatten().to_numpy()
            hit = np.flatnonzero(is_live(shared.value, sig))
            owner = np.repeat(np.arange(batch.num_rows), np.diff(sigs.offsets.to_numpy()))[hit]
            yield pa.RecordBatch.from_arrays([pa.array(sig[hit]), batch.column(0).take(pa.array(owner)), *(batch.column(i).flatten().take(pa.array(hit)) for i in (2, 3, 4))], names=["sig", "key", "l", "c", "r"])

    met = indexed.select("key", "sigs", "l", "c", "r").mapInArrow(keep, "sig long, key long, l int, c int, r int")
    met = met.hint("merge").join(copies.select("key").hint("merge"), "key", "left_anti").join(hubs.hint("merge"), "sig")
    met = stored(met.select("sig", "key", "l", "c", "r", "hub"), "windows")
    released(indexed, hubs)
    k = F.pmod("sig", F.lit(8)).cast("int").alias("k")
    at_hub = met.where("key = hub").groupBy("sig").agg(F.min(F.struct("l", "r")).alias("o"))
    near = met.where("key != hub").join(at_hub.hint("merge"), "sig").select("key", F.col("hub").alias("other"), k, "l", "r", F.col("o.l").alias("m"), F.col("o.r").alias("s"))

    def gather(table: pa.Table) -> pa.Table:
        at = {c: table.column(c).to_numpy() for c in ("key", "other", "k", "l", "r", "m", "s")}
        order = np.lexsort((at["l"], at["other"], at["key"]))
        key, other = at["key"][order], at["other"][order]
        rows = np.stack([at[c][order] for c in ("k", "l", "r", "m", "s")], axis=1).tolist()
        edge = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (other[1:] != other[:-1]), [True]))) if len(key) else np.zeros(1, np.int64)
        out = [(key[a], other[a], *span) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True) for span in join_intervals(rows[a:b], 1)]
        cols = list(zip(*out, strict=True)) if out else [[]] * 6
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["key", "other", "l", "r", "m", "s"])

    def extract(batches: Iterator[pa.RecordBatch]):
        words = Words()
        last, s = None, None
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                out = []
                for key, text, a, b in zip(part.column(0).to_pylist(), part.column(1), part.column(4).to_pylist(), part.column(5).to_pylist(), strict=True):
                    if key != last:  # rows of a document come together
                        last, s = key, shingles_of(text.as_py(), words)
                    out.append(s[a : b + 1].astype(np.uint32).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(2), part.column(3), part.column(0), part.column(4), pa.array(out, pa.binary())], names=["id", "side", "key", "lo", "grams"])

    def check(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            out = []
            for key, lo, a, more, m, b in zip(*(batch.column(c).to_pylist() for c in ("key0", "lo0", "grams0", "key1", "lo1", "grams1")), strict=True):
                for x, y, u, v, like in verify(np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32), similarity, width):
                    out.append((key, lo + x, lo + y + shingle - 1, more, m + u, m + v + shingle - 1, like))
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if i == 6 else pa.int64()) for i, c in enumerate(cols)], names=["key", "first", "stop", "other", "other_first", "other_stop", "similarity"])

    def verified(pairs: DataFrame) -> DataFrame:
        """Passages of the texts whose windows are paired."""
        bins = F.ceil(F.lit(pairs.count() + 1) / bin_rows)
        found = pairs.groupBy(F.pmod(F.xxhash64("key", "other"), bins)).applyInArrow(gather, "key long, other long, l long, r long, m long, s long")
        found = stored(found.withColumn("id", F.xxhash64("key", "other", "l", "m")), "candidates")
        asked = found.select("id", F.lit(0).alias("side"), "key", F.col("l").alias("lo"), F.col("r").alias("hi")).unionByName(found.select("id", F.lit(1).alias("side"), F.col("other").alias("key"), F.col("m").alias("lo"), F.col("s").alias("hi")))
        spans = src.select("key", "text").hint("merge").join(asked.hint("merge"), "key").select("key", "text", "id", "side", "lo", "hi").mapInArrow(extract, "id long, side int, key long, lo long, grams binary")
        sides = spans.groupBy("id").agg(*(F.max(F.when(F.col("side") == v, F.col(c))).alias(f"{c}{v}") for v in (0, 1) for c in ("key", "lo", "grams")))
        out = stored(sides.mapInArrow(check, "key long, first long, stop long, other long, other_first long, other_stop long, similarity double"), "passages")
        released(found)
        return out

    def sketch(batches: Iterator[pa.RecordBatch]):
        known = Words()
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                rows, masks = [], []
                for key, text, mine in zip(part.column(0).to_pylist(), part.column(1), part.column(2).to_pylist(), strict=True):
                    s = shingles_of(text.as_py(), known)
                    at = [(x["l"], x["r"], x["c"]) for x in mine]
                    mask, whole = neighbours(s, at, width)
                    # Of repeated shingles the windows lie in each other: they count as the outermost, and those of equal neighbours once.
                    outer, once, stay = None, {}, []
                    for i in sorted(range(len(at)), key=lambda i: (mine[i]["sig"], at[i][0], -at[i][1])):
                        sig, (l, r, _) = mine[i]["sig"], at[i]
                        if outer is None or outer[0] != sig or r > outer[2]:
                            outer = sig, l, r
                        seen = sig, key, outer[1], outer[2], int(whole[i]) if mine[i]["open"] else 0, mask[i].tobytes()
                        if seen not in once:
                            stay.append(i)
                        places = once.setdefault(seen, [at[i][2], at[i][2]])
                        places[:] = min(places[0], at[i][2]), max(places[1], at[i][2])
                    rows += [(*seen[:5], *places) for seen, places in once.items()]
                    masks.append(mask[stay])
                if rows:
                    cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), *[pa.int32()] * 5), strict=True)]
                    yield pa.RecordBatch.from_arrays([*cols, *(pa.array(m.copy()) for m in np.concatenate(masks).T)], names=["sig", "key", "l", "r", "open", "c", "d", *BLOCKS])

    def explained(spans: DataFrame, rows: DataFrame, *places: str) -> DataFrame:
        """`rows` with `covered`: verified passages of their document hold each of the places."""
        held = spans.groupBy("key").agg(F.collect_list(F.struct("first", "stop")).alias("spans"))

        def inside(c: str) -> Column:
            return F.exists(F.coalesce("spans", F.expr("array()")), lambda x: (x["first"] <= F.col(c)) & (F.col(c) + shingle <= x["stop"]))

        return rows.join(held.hint("merge"), "key", "left").withColumn("covered", functools.reduce(operator.and_, map(inside, places))).drop("spans")

    def in_chunks(rows: DataFrame) -> DataFrame:
        """The rows of each signature with an open window dealt into chunks, each pair of chunks (a, b) together."""
        parts = rows.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.max("open").alias("any")).where("any > 0").select("sig", "n", F.ceil(F.col("n") / chunk).cast("int").alias("parts"))
        parts = stored(parts, "parts")
        dealt_rows = parts.agg(F.sum(F.col("n") * F.col("parts"))).first()[0] or 0
        out = rows.join(parts.drop("n").hint("merge"), "sig")
        out = out.withColumn("mine", F.pmod(F.xxhash64("key", "l"), F.col("parts")).cast("int")).withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        out = out.withColumn("a", F.least("mine", "theirs")).withColumn("b", F.greatest("mine", "theirs")).drop("parts", "theirs")
        tasks = max(8, spark.sparkContext.defaultParallelism * 4, -(-dealt_rows // task_rows))
        return out.repartition(tasks, "sig", "a", "b").sortWithinPartitions("sig", "a", "b", "key", "l")

    def up_to_last(rows: DataFrame) -> DataFrame:
        """Windows of signatures with an open one that are no later than the last such."""
        last = rows.groupBy("sig").agg(F.max(F.when(F.col("open").cast("int") > 0, F.col("key"))).alias("last"), F.min("key").alias("least")).where("last > least")
        return rows.join(last.select("sig", "last").hint("merge"), "sig").where("key <= last").drop("last")

    # Windows in no verified passage are compared with all earlier ones of their signature but the hub, which they have met, chunk by chunk.
    passages = verified(near)
    others = explained(passages, met.where("key != hub"), "c")
    others = stored(others.select("sig", "key", "l", "c", "r", (~F.col("covered")).alias("open")), "others")
    mine = up_to_last(others).groupBy("key").agg(F.collect_list(F.struct("sig", "l", "c", "r", "open")).alias("mine"))
    texts = src.select("key", "text").hint("merge").join(mine.hint("merge"), "key").select("key", "text", "mine")
    left = texts.mapInArrow(sketch, "sig long, key long, l int, r int, open int, c int, d int, " + ", ".join(f"{c} long" for c in BLOCKS))
    left = stored(left.withColumn("after_score", F.lit((1 << 31) - 1)).withColumn("after_key", F.lit(0).cast("long")), "left")
    window, take = ["sig", "key", "l", "r", "c", "d"], 1
    while True:
        some = in_chunks(left).mapInArrow(meet_next(take), "sig long, key long, c int, d int, other long, score int, l int, r int, m int, s int")
        rank = F.rank().over(Window.partitionBy(*window).orderBy(F.desc("score"), "other"))
        far = stored(some.withColumn("rank", rank).where(F.col("rank") <= take), "pairs")
        if not far.take(1):
            break
        more = verified(far.select("key", "other", k, "l", "r", "m", "s").distinct())
        passages = passages.unionByName(more)
        # What met as many as it asked for and isn't explained yet asks for those behind.
        asks = far.groupBy(*window).agg(F.count(F.lit(1)).alias("n"), F.max_by(F.struct("score", "other"), F.struct(-F.col("score"), "other")).alias("at")).where(F.col("n") >= take)
        asks = stored(explained(more, asks, "c", "d").where("not covered").select(*window, F.col("at.score").alias("score"), F.col("at.other").alias("behind")), "asks")
        if not asks.take(1):
            break
        rows = left.join(asks.hint("merge"), window, "left").withColumn("open", F.when(F.col("score").isNull(), 0).otherwise(F.col("open")))
        rows = rows.withColumn("after_score", F.coalesce("score", "after_score")).withColumn("after_key", F.coalesce("behind", "after_key")).drop("score", "behind")
        before, left = left, stored(up_to_last(rows), "left")
        released(before, far, asks)
        take *= 8
    passages = passages.dropDuplicates()
    whole = copies.where(F.col("n") >= min_words).select("key", F.lit(0).cast("long").alias("first"), F.col("n").alias("stop"), "other", F.lit(0).cast("long").alias("other_first"), F.col("n").alias("other_stop"), F.lit(1.0).alias("similarity"))
    names = facts.select("key", "doc_id")
    out = passages.unionByName(whole).join(names, "key").join(names.select(F.col("key").alias("other"), F.col("doc_id").alias("other_doc_id")), "other")
    return out.select("key", "doc_id", "first", "stop", "other_doc_id", "other_first", "other_stop", "similarity")


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans; the white space before a cut stays."""
    bounds = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    out, at = [], 0
    for first, stop in sorted(spans):
        lo, hi = bounds[first][0], bounds[stop - 1][1]
        if lo > at:
            out.append(text[at:lo])
        at = max(at, hi)
    return "".join([*out, text[at:]])


def cut_passages(docs: DataFrame, **how) -> DataFrame:
    """`docs` without the passages that an earlier document has; documents that are left without a word go.

    Columns stay; n_chars, where there is one, is counted anew where text was cut.
    """
    spans = find_passages(docs, **how).groupBy("key").agg(F.collect_list(F.struct("first", "stop")).alias("__spans"))
    # An equal pair of id and text has one key; null and repeated ids are found by their text again.
    odd = _odd_key(F.col("text").cast("string").cast("binary"))
    plain = F.col("doc_id").cast("long") if _whole_number(docs) else odd
    keyed = docs.withColumn("__plain", plain).withColumn("__odd", odd)
    hit = spans.withColumnRenamed("key", "__key")
    joined = keyed.join(hit, F.when(F.col("__plain").isNull(), F.col("__odd")).otherwise(F.col("__plain")) == F.col("__key"), "left")
    again = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    if again:
        second = spans.select(F.col("key").alias("__key2"), F.col("__spans").alias("__spans2"))
        joined = joined.join(second, F.col("__odd") == F.col("__key2"), "left").withColumn("__spans", F.coalesce("__spans", "__spans2"))
    keep = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            texts = [cut_words(t, [(s["first"], s["stop"]) for s in spans]) for t, spans in zip(batch.column("text").to_pylist(), batch.column("__spans").to_pylist(), strict=True)]
            stay = pa.array([bool(t.split()) for t in texts], pa.bool_())
            cols = {"text": pa.array(texts, pa.string())}
            if "n_chars" in keep:
                cols["n_chars"] = pa.array([len(t) for t in texts], batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([cols.get(c, batch.column(c)) for c in keep], names=keep).filter(stay)

    untouched = joined.where(F.col("__spans").isNull()).select(*keep)
    touched = joined.where(F.col("__spans").isNotNull()).select(*keep, "__spans").mapInArrow(cut, docs.schema)
    return untouched.unionByName(touched)
