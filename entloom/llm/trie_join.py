"""N-gram Jaccard join: sets of word n-grams joined in prefix trees.

The join proper is `TrieJoin`: sets in one global order of their n-grams (by 64-bit hash) are kept in a
path-compressed tree. A set is looked up by walking the tree: paths share their overlap so far, and a subtree is left
when the overlap so far plus what can still come (the shorter of what remains of the set and of the subtree's longest
set) can't reach the threshold for any length in the subtree. A subtree that is already connected with the set is left too.

Which sets meet in one tree is settled by exact filters, so no link is lost:

* Signatures. Two linked sets of sizes a and b differ in at most (1 - t) / (1 + t) of a + b n-grams. If n-grams are dealt
  by hash to more parts than that, one part at least is the same in both. So each set emits a hash of each
  part, for its own class of sizes and the next; sets that share a signature are candidates. Parts that are the same may be empty in both.
  They are the only ones only where all others differ; so empty parts emit nothing unless a set has no more parts with n-grams than it can
  differ in from a linked set. Spare parts, more where many stay empty by chance (`parts_of`), make that rare: else long sets that have nothing in common would meet.
* Sketches. The parity of the n-grams in each of about 2 |set| cells, 8,192 at most: two sets' sketches differ in no more cells than the sets in n-grams.

Candidates meet in three rounds. First each set meets the least set of its signatures that its sketch doesn't rule out
(a star: the hub and up to `chunk` others in one tree; larger stars are dealt into several). What these trees link is
one component. Then, of signatures that sets of several components still share, each set meets the least set of another component that its sketch
allows; and at last all pairs across components that sketches allow meet, again in stars. A group of near copies is thus linked in a number of tree insertions that grows with its
members; pairs are compared (by sketches, in blocks of `group` sets) only where components are still apart.

The words of one document of each set that shares a signature are stored apart, compressed; the rounds shuffle these and make the n-grams where a
tree is built. All other texts stay where they are: a bitmap tells which are needed.

Equal sets are one class throughout; copies are never paired. Links leave the trees as spanning forests, and
components are found in the table of links.

Words are lower-cased (A-Z) and n-grams known by 64-bit hashes; texts are read whole, however long. A text with fewer words than an n-gram is one n-gram; null
and empty texts have no set, link with nothing and are components of their own. Null ids are documents like any
other; a component's id is its smallest id that isn't null. Repeated rows each give a row. Other columns are
ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import bisect
import functools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entloom.llm.common import id_name, lower_words_of, released, stored
from entloom.llm.components import components

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class Words(dict):
    """64-bit hashes of words; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def gram_hashes(words: list[bytes], n: int, known: Words) -> np.ndarray:
    """Hashes of all n-grams in their order; a shorter text is one n-gram."""
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(n, len(words))
    with np.errstate(over="ignore"):
        h = np.full(len(w) - size + 1, np.uint64(size))
        for k in range(size):
            h = mix64(h * _A + w[k : len(w) - size + 1 + k] + np.uint64(k))
    return h


def gram_set(text, n: int, known: Words) -> np.ndarray:
    """The distinct n-grams, sorted."""
    return np.unique(gram_hashes(lower_words_of(text), n, known))


def set_id(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


class Threshold:
    """Similarity of at least num/den, in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def overlap(self, a: int, b: int) -> int:
        """The least intersection of linked sets of these sizes."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def classes(self, largest: int) -> list[int]:
        """First sizes of the size classes: linked sets are of the same class or of two that follow each other."""
        found = [1]
        while found[-1] <= largest:
            found.append(max(found[-1] + 1, (found[-1] - 1) * self.den // self.num + 1))
        return [*found, (found[-1] - 1) * self.den // self.num + 2]

    def parts(self, hi: int) -> int:
        """More parts than two linked sets of up to `hi` n-grams can differ in."""
        return self.differ(2 * hi) + 1

    def differ(self, both: int) -> int:
        """The most n-grams that only one of two linked sets has, which have `both` in all."""
        return (self.den - self.num) * both // (self.num + self.den)


def parts_of(hi: int, t: Threshold, spare: int) -> tuple[int, int]:
    """More parts than two linked sets of up to `hi` n-grams can differ in, and spare ones: as many as stay empty by chance, and four deviations."""
    p = t.parts(hi)
    empty = (p + spare) * math.exp(-hi / (p + spare))
    return p, 0 if p == 1 else max(spare, math.ceil(empty + 4 * math.sqrt(empty)))


def signatures(s: np.ndarray, t: Threshold, classes: list[int], spare: int = 3) -> np.ndarray:
    """A set's signatures, for its size class and the next; the lowest bit is that of the class's number."""
    k = bisect.bisect_right(classes, len(s)) - 1
    out = []
    with np.errstate(over="ignore"):
        deal, body = mix64(s * _B), mix64(s * _C)
        for tag in (k, k + 1):
            # Class `tag` and the one below meet here.
            hi = classes[tag + 1] - 1
            p, z = parts_of(hi, t, spare)
            part = (deal % np.uint64(p + z)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            at = part[order]
            first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            total, which = np.add.reduceat(body[order], first), at[first]
            if len(which) <= t.differ(len(s) + min(hi, len(s) * t.den // t.num)):  # all of them may differ: the empty ones count too
                empty = np.setdiff1d(np.arange(p + z), which)
                total, which = np.concatenate((total, np.zeros(len(empty), np.uint64))), np.concatenate((which, empty))
            out.append(mix64(total * _A + which.astype(np.uint64) + np.uint64(tag) * _B) & ~np.uint64(1) | np.uint64(tag & 1))
    return np.concatenate(out).view(np.int64)


def sketches(s: np.ndarray, classes: list[int]) -> list[np.ndarray]:
    """For the set's size class and the next: the parity of its n-grams in each of about twice as many cells as the class's sizes, 8,192 at most.

    A longer set has more signatures, and its sketch goes with each that is still open. Where the cells are few the sketch rules less out, and the trees decide.
    """
    k = bisect.bisect_right(classes, len(s)) - 1
    with np.errstate(over="ignore"):
        deal = mix64(s * _C + _A)
    out = []
    for tag in (k, k + 1):
        cells = min(8192, -(-classes[tag] // 32) * 64)
        odd = np.bincount((deal % np.uint64(cells)).astype(np.int64), minlength=cells) & 1
        out.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
    return out


# -- the join ------------------------------------------------------------------------------


#: N-grams of a node's step that are counted between two tests of the bound.
PIECE = 64


class _Node:
    __slots__ = ("children", "group", "last", "longest", "sets", "shortest", "step")

    def __init__(self, step: list[int]):
        self.step, self.children, self.sets = step, {}, []
        self.shortest, self.longest, self.group = 1 << 60, 0, -1


class TrieJoin:
    """Components of sets under the threshold. `links` is a spanning forest of the links."""

    def __init__(self, sets: list[np.ndarray], t: Threshold):
        """sets: sorted, each n-gram once."""
        self.t, self.links = t, []
        self.parent = list(range(len(sets)))
        self.root = _Node([])
        for i in sorted(range(len(sets)), key=lambda i: (len(sets[i]), i)):
            path = sets[i].tolist()
            self._probe(i, path)
            self._insert(i, path)

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def _insert(self, i: int, path: list[int]) -> None:
        node, at = self.root, 0
        while True:
            node.shortest, node.longest = min(node.shortest, len(path)), max(node.longest, len(path))
            # group: a set of the only component below; -2 once there are several.
            if node.group == -1:
                node.group = i
            elif node.group >= 0 and self.find(node.group) != self.find(i):
                node.group = -2
            if at == len(path):
                node.sets.append(i)
                return
            child = node.children.get(path[at])
            if child is None:
                child = node.children[path[at]] = _Node(path[at:])
                child.group, child.shortest, child.longest = i, len(path), len(path)
                child.sets.append(i)
                return
            step, n = child.step, 0
            most = min(len(step), len(path) - at)
            while n < most and step[n] == path[at + n]:
                n += 1
            if n < len(step):  # split the step
                upper = _Node(step[:n])
                upper.children[step[n]], child.step = child, step[n:]
                upper.shortest, upper.longest, upper.group = child.shortest, child.longest, child.group
                node.children[path[at]] = upper
                child = upper
            node, at = child, at + n

    def _probe(self, i: int, path: list[int]) -> None:
        mine, size, t = set(path), len(path), self.t
        stack = [(self.root, 0, 0)]
        while stack:
            node, depth, overlap = stack.pop()
            if node.group >= 0 and self.find(node.group) == self.find(i):
                continue
            far = False
            for lo in range(0, len(node.step), PIECE):
                piece = node.step[lo : lo + PIECE]
                overlap += sum(map(mine.__contains__, piece))
                depth += len(piece)
                ahead = size - bisect.bisect_right(path, piece[-1])
                # The bound grows more slowly with the other's length than what it still may bring.
                far = overlap + min(ahead, node.longest - depth) < t.overlap(size, max(node.shortest, depth))
                if far:
                    break
            if far:
                continue
            for j in node.sets:
                a, b = self.find(i), self.find(j)
                if a != b and overlap >= t.overlap(size, depth):
                    self.parent[a] = b
                    self.links.append((i, j))
            stack.extend((c, depth, overlap) for c in node.children.values())


# -- tables --------------------------------------------------------------------------------


def _scan(docs: DataFrame, n: int, t: Threshold, classes: list[int]) -> DataFrame:
    """doc_id, name, hash (of the text), n_shingles, cls (the set's id, null without one), k (its size class), its two sketches and signatures."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        known = Words()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                size, ids, ks, near, far, sigs = [], [], [], [], [], []
                for text in part.column(3):
                    s = gram_set(text.as_py(), n, known)
                    size.append(len(s))
                    ids.append(set_id(s) if len(s) else None)
                    ks.append(bisect.bisect_right(classes, len(s)) - 1 if len(s) else None)
                    one, two = sketches(s, classes) if len(s) else (np.zeros(0, np.int64),) * 2
                    near.append(one)
                    far.append(two)
                    sigs.append(signatures(s, t, classes) if len(s) else np.zeros(0, np.int64))
                lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), pa.array(np.concatenate(x))) for x in (near, far, sigs)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(size, pa.int64()), pa.array(ids, pa.int64()), pa.array(ks, pa.int32()), *lists], names=["doc_id", "name", "hash", "n_shingles", "cls", "k", "near", "far", "sigs"])

    text = F.col("text").cast("string").cast("binary")
    src = docs.select("doc_id", id_name(F.col("doc_id")).alias("name"), F.xxhash64(text).alias("hash"), text.alias("text"))
    return src.mapInArrow(run, f"doc_id {id_type}, name string, hash long, n_shingles long, cls long, k int, near array<long>, far array<long>, sigs array<long>")


#: Cells, as a power of two, of the largest filter that keeps signatures of a single set from being shuffled a second time (16 MB).
FILTER_BITS = 27


def live_filter(sigs: DataFrame):
    """A broadcast bitmap of a table's `sig`: 16 cells or more for each up to `FILTER_BITS`, beyond it lets more through the more there are."""
    bits_log = min(FILTER_BITS, max(16, (16 * sigs.count()).bit_length()))
    cell = F.pmod(F.shiftrightunsigned("sig", 1), F.lit(1 << bits_log))
    words = sigs.select(cell.alias("cell")).groupBy(F.shiftright("cell", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(cell % 64 as int)))").alias("bits")).toArrow()
    bits = np.zeros(1 << (bits_log - 6), np.int64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return sigs.sparkSession.sparkContext.broadcast(bits)


def is_live(bits: np.ndarray, sig: np.ndarray) -> np.ndarray:
    at = (sig.view(np.uint64) >> np.uint64(1)) & np.uint64(64 * len(bits) - 1)
    return bits.view(np.uint64)[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)


def _shared(scanned: DataFrame) -> DataFrame:
    """sig, cls, hub of every signature that several sets have; hub is the least of them."""
    sets = scanned.where("cls is not null")
    # Most signatures are of one text alone: they are counted without their sets, which halves what is shuffled of them. Copies of a set count too; they go below.
    often = stored(sets.select(F.explode("sigs").alias("sig")).groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("sig"), "often")
    shared = live_filter(often)

    def keep(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            sigs = batch.column(1)
            sig = sigs.flatten().to_numpy()
            hit = np.flatnonzero(is_live(shared.value, sig))
            owner = np.repeat(np.arange(batch.num_rows), np.diff(sigs.offsets.to_numpy()))[hit]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(sig[hit])], names=["cls", "sig"])

    rows = stored(sets.select("cls", "sigs").mapInArrow(keep, "cls long, sig long").distinct(), "live")
    hubs = rows.groupBy("sig").agg(F.min("cls").alias("hub"), F.max("cls").alias("top")).where("hub != top").select("sig", "hub")
    out = stored(rows.hint("merge").join(hubs.hint("merge"), "sig").select("sig", "cls", "hub"), "shared")
    released(often, rows)
    return out


_NONE = np.iinfo(np.int64).max


def _cross_pairs(rows: DataFrame, t: Threshold, group: int, least: bool) -> DataFrame:
    """a < b, and b's size: pairs of different roots within a signature that their sketches allow; `least`: of each b only that with the least a. rows: sig, cls, root, size, sketch."""
    count = rows.groupBy("sig").agg(F.count(F.lit(1)).alias("n"))
    bins = F.lit(1) + F.floor(F.lit(rows.count()) / (4 * group))
    dealt = rows.join(count, "sig").withColumn("parts", F.ceil(F.col("n") / group).cast("int")).withColumn("mine", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumn("i", F.least("mine", "theirs")).withColumn("j", F.greatest("mine", "theirs"))
    place = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("sig"), bins)).otherwise(F.xxhash64("sig", "i", "j"))

    def allowed(size: np.ndarray, other: np.ndarray) -> np.ndarray:
        both = size[:, None] + other[None, :]
        return both - 2 * -(-t.num * both // (t.num + t.den))

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        at = {c: table.column(c).to_numpy() for c in ("sig", "cls", "root", "size", "mine", "i", "j")}
        order = np.lexsort((at["j"], at["i"], at["sig"]))
        at = {c: v[order] for c, v in at.items()}
        sketch = table.column("sketch").take(pa.array(order)).to_pylist()
        edge = np.flatnonzero(np.concatenate(([True], (at["sig"][1:] != at["sig"][:-1]) | (at["i"][1:] != at["i"][:-1]) | (at["j"][1:] != at["j"][:-1]), [True])))
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            own = {c: v[lo:hi] for c, v in at.items()}
            bits = np.array(sketch[lo:hi], np.int64).view(np.uint64)
            apart = own["i"][0] != own["j"][0]
            step = max(1, 4_000_000 // (len(bits) * bits.shape[1]))
            for x in range(0, len(bits), step):
                far = np.bitwise_count(bits[x : x + step, None, :] ^ bits[None, :, :]).sum(2, dtype=np.int32)
                ok = (far <= allowed(own["size"][x : x + step], own["size"])) & (own["root"][x : x + step, None] != own["root"][None, :]) & (own["cls"][x : x + step, None] < own["cls"][None, :])
                if apart:  # pairs within a chunk meet where both are the same
                    ok &= own["mine"][x : x + step, None] != own["mine"][None, :]
                if least:
                    to = np.where(ok, own["cls"][x : x + step, None], _NONE).min(0)
                    two = np.flatnonzero(to != _NONE)
                    yield pa.RecordBatch.from_arrays([pa.array(to[two]), pa.array(own["cls"][two]), pa.array(own["size"][two])], names=["a", "b", "size"])
                else:
                    one, two = np.nonzero(ok)
                    yield pa.RecordBatch.from_arrays([pa.array(own["cls"][one + x]), pa.array(own["cls"][two]), pa.array(own["size"][two])], names=["a", "b", "size"])

    met = dealt.select(place.alias("place"), "sig", "cls", "root", "size", "sketch", "mine", "i", "j").groupBy("place").applyInArrow(run, "a long, b long, size long")
    return met.distinct()


def _bearing_texts(src: DataFrame, bearer: DataFrame) -> DataFrame:
    """cls and words (lower case, compressed) of the documents that bear a set, stored. Other texts aren't shuffled, but for a few that the bitmap lets through."""
    wanted = live_filter(bearer.select(F.xxhash64("name", "hash").alias("sig")))

    def keep(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            hit = batch.take(pa.array(np.flatnonzero(is_live(wanted.value, batch.column(0).to_numpy()))))
            words = [zlib.compress(b" ".join(lower_words_of(x.as_py())), 1) for x in hit.column(3)]
            yield pa.RecordBatch.from_arrays([hit.column(1), hit.column(2), pa.array(words, pa.binary())], names=["name", "hash", "words"])

    found = src.select(F.xxhash64("name", "hash").alias("sig"), "name", "hash", "text").mapInArrow(keep, "name string, hash long, words binary")
    return stored(found.hint("merge").join(bearer.select("cls", "name", "hash").hint("merge"), ["name", "hash"]).select("cls", "words"), "texts")


def _star_links(texts: DataFrame, bearer: DataFrame, pairs: DataFrame, n: int, t: Threshold, chunk: int, bin_sets: int, bin_grams: int) -> DataFrame:
    """a, b: links that prefix trees find. texts: cls, words. pairs: hub, cls, size (of the set).

    A tree holds a hub and up to about `chunk` of the sets that are to meet it, or as many as have `bin_grams` n-grams, whichever are fewer. A
    task holds the words of trees of about `bin_sets` sets or `bin_grams` n-grams, and one tree at a time.
    """
    stars = pairs.groupBy("hub").agg(F.ceil(F.greatest(F.count(F.lit(1)) / chunk, F.sum("size") / bin_grams)).alias("parts"))
    placed = pairs.join(stars, "hub").select("hub", "cls", F.xxhash64("hub", F.pmod(F.xxhash64("cls"), F.col("parts"))).alias("place"))
    asked = placed.select("cls", "place").unionByName(placed.select(F.col("hub").alias("cls"), "place").distinct())
    need = stored(asked.join(bearer.select("cls", "size"), "cls"), "need")
    held = need.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    bins = 1 + max(held[0] // bin_sets, held[1] // bin_grams)

    def join(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        places: dict[int, dict[int, bytes]] = {}
        for batch in batches:
            for p, c, w in zip(batch.column("place").to_pylist(), batch.column("cls").to_pylist(), batch.column("words").to_pylist(), strict=True):
                places.setdefault(p, {})[c] = w
        for held in places.values():
            names = sorted(held)
            links = TrieJoin([np.unique(gram_hashes(zlib.decompress(held[c]).split(), n, known)) for c in names], t).links
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i, _ in links], pa.int64()), pa.array([names[j] for _, j in links], pa.int64())], names=["a", "b"])

    # `need` is a stored table, whose size the planner knows: it is broadcast only below Spark's threshold.
    dealt = texts.join(need.drop("size"), "cls").withColumn("bin", F.pmod("place", F.lit(bins)))
    links = stored(dealt.groupBy("bin").applyInArrow(join, "a long, b long"), "links")
    released(need)
    return links


def _linked(docs: DataFrame, *, n: int = 3, num: int = 9, den: int = 10, chunk: int = 256, bin_sets: int = 512, bin_grams: int = 2_000_000, group: int = 2048, longest: int = 1 << 32) -> DataFrame:
    """doc_id, name, hash (of the text), n_shingles and the component's root (null without a set) of every row, stored."""
    t = Threshold(num, den)
    classes = t.classes(longest)
    text = F.col("text").cast("string").cast("binary")
    src = docs.select(id_name(F.col("doc_id")).alias("name"), F.xxhash64(text).alias("hash"), text.alias("text"))
    scanned = stored(_scan(docs, n, t, classes), "scan")
    facts = stored(scanned.select("doc_id", "name", "hash", "n_shingles", "cls"), "facts")
    shared = _shared(scanned)
    # One document of each set that shares a signature brings its words.
    bearing = scanned.where("cls is not null").groupBy("cls").agg(F.min(F.struct("name", "hash")).alias("f")).join(shared.select("cls").distinct(), "cls").select("cls", "f.name", "f.hash")
    borne = scanned.hint("merge").join(bearing.hint("merge"), ["cls", "name", "hash"]).dropDuplicates(["cls"])
    bearer = stored(borne.select("cls", "name", "hash", F.col("n_shingles").alias("size"), "k", "near", "far"), "bearer")
    released(scanned)
    texts = _bearing_texts(src, bearer)

    # First round: each set and the least of the sets that it may be linked to by sketch. Any signature that two sets share names a class in which to compare them.
    side = bearer.select("cls", "size", F.explode(F.array(F.struct(F.pmod("k", F.lit(2)).alias("odd"), F.col("near").alias("sketch")), F.struct(F.pmod(F.col("k") + 1, F.lit(2)).alias("odd"), F.col("far").alias("sketch")))).alias("x")).select("cls", "size", "x.*")
    pairs = shared.where("cls != hub").groupBy("cls", "hub").agg(F.min(F.pmod("sig", F.lit(2)).cast("int")).alias("odd"))
    met = pairs.join(side, ["cls", "odd"]).join(side.select(F.col("cls").alias("hub"), "odd", F.col("size").alias("hub_size"), F.col("sketch").alias("hub_sketch")), ["hub", "odd"])
    differ = F.aggregate(F.zip_with("sketch", "hub_sketch", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda total, x: total + x)
    both = F.col("size") + F.col("hub_size")
    first = met.where(differ <= both - 2 * F.ceil(both * num / (num + den))).groupBy("cls").agg(F.min("hub").alias("hub"), F.max("size").alias("size"))
    links = _star_links(texts, bearer, first, n, t, chunk, bin_sets, bin_grams)

    # Further rounds: across what is still apart, first the least of each set's candidates in a signature, then all.
    found = [links]
    for least in (True, False):
        linked = functools.reduce(DataFrame.unionByName, found)
        roots = components(linked)
        rooted = stored(shared.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("sig", "cls", F.coalesce("root", "cls").alias("root")), "rooted")
        # Of signatures that the same sets share one is enough.
        groups = rooted.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n"), *(F.bit_xor(F.xxhash64(F.lit(i), "cls")).alias(f"h{i}") for i in (0, 1))).where("lo != hi")
        open_ = groups.groupBy("n", "h0", "h1").agg(F.min("sig").alias("sig")).select("sig")
        rows = rooted.join(open_, "sig").withColumn("odd", F.pmod("sig", F.lit(2)).cast("int"))
        rows = stored(rows.join(side, ["cls", "odd"]).select("sig", "cls", "root", "size", "sketch"), "open")
        apart = stored(_cross_pairs(rows, t, group, least).select(F.col("a").alias("hub"), F.col("b").alias("cls"), "size"), "pairs")
        found.append(_star_links(texts, bearer, apart, n, t, chunk, bin_sets, bin_grams))
        released(rooted, rows, apart)

    joined = components(functools.reduce(DataFrame.unionByName, found))
    rooted = facts.join(joined, facts["cls"] == joined["node"], "left")
    out = stored(rooted.select("doc_id", "name", "hash", "n_shingles", F.coalesce("root", "cls").alias("root")), "rooted")
    released(facts, shared, bearer, texts, *found)
    return out


def jaccard_components(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_shingles and component_id of every row; linked: similarity of at least num/den."""
    rooted = _linked(docs, **how)
    least = rooted.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return rooted.join(least, "root", "left").select("doc_id", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """The rows of `docs` without those that are linked to one of a smaller id (null last; then of a smaller hash of the text).

    Of rows of equal id and text one stays; rows without a set all stay.
    """
    rooted = _linked(docs, **how)
    stay = rooted.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "name", "hash")).alias("f")).select(F.col("f.name").alias("__name"), F.col("f.hash").alias("__hash"))
    text = F.col("text").cast("string")
    wordless = docs.where(F.coalesce(~text.rlike("[^\\x20\\x09-\\x0D]"), F.lit(True)))
    named = docs.withColumn("__name", id_name(F.col("doc_id"))).withColumn("__hash", F.xxhash64(text.cast("binary")))
    kept = named.join(stay.hint("merge"), ["__name", "__hash"])
    if rooted.where("root is not null").groupBy("name", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        kept = kept.dropDuplicates(["__name", "__hash"])
    return kept.select(*docs.columns).unionByName(wordless)
