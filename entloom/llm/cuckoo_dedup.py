"""Exact deduplication on a cuckoo-filter index.

The index lives in the shared folder, in shards by digest. A shard has a cuckoo filter (two candidate buckets of four 16-bit
fingerprints for each key) and, in the same buckets, the digests that are live with their texts' sizes, which are the content that hits are verified against. A batch is inserted or
deleted by one task a shard: a digest whose fingerprint is in neither bucket is new, and no content is looked at; a hit is compared with the
bucket's live digests, as other digests share fingerprints. A digest whose last row goes leaves the filter, which a Bloom filter couldn't do.
When an insertion finds no place the shard's filter is doubled and filled anew from the stored digests: fingerprints alone don't tell where they would go.

Rows (id, digest) are kept beside it as a log of batches, so what remains of a digest after deletions is known: the number of its rows and which stays, the
one of the greatest id; null ids are below all others and of equal ids one row stays. Texts are equal when their SHA-256 and their sizes in bytes are.

Copies are counted before they reach a shard: in each scan partition, then by digest and one of 64 groups of partitions, so a group that holds a third of all rows is a few
rows of its shard. Groups of more than one in `SHARE` rows, so fewer than `SHARE` of them, are joined back by broadcast, all others by a shuffle in which no key is
hot. Shards hold about `SHARD_KEYS` digests.

Null texts count as empty and all equal each other; texts of any length count whole. Rows that repeat are copies. An empty table
gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from entloom.llm.common import blocks_for, released, stored

SLOTS = 4
SHARD_KEYS = 100_000
SHARE = 1000
#: Buckets of a shard's first filter; insertions that find no place double it.
FIRST_BUCKETS = 1 << 10
_U64 = (1 << 64) - 1


class CuckooFilter:
    """Fingerprints of live keys in buckets of four; keys are 64-bit numbers that are spread evenly, such as parts of a digest.

    A key's first bucket follows from the key, its other one from the first and the fingerprint, so an entry can move knowing no key.
    """

    def __init__(self, buckets: int = FIRST_BUCKETS, kicks: int = 500):
        if buckets & (buckets - 1):
            raise ValueError("the number of buckets must be a power of two")
        self.buckets, self.kicks, self.live = buckets, kicks, 0
        self.slots = np.zeros((buckets, SLOTS), np.uint16)

    def places(self, key: int) -> tuple[int, int, int]:
        """Fingerprint (never 0, which marks a free slot) and the two buckets."""
        fingerprint = (key >> 48) % 65535 + 1
        first = key & (self.buckets - 1)
        return fingerprint, first, self.other(first, fingerprint)

    def other(self, bucket: int, fingerprint: int) -> int:
        return (bucket ^ ((fingerprint * 0x9E3779B97F4A7C15 & _U64) >> 20)) & (self.buckets - 1)

    def __contains__(self, key: int) -> bool:
        fingerprint, one, two = self.places(key)
        return bool((self.slots[one] == fingerprint).any() or (self.slots[two] == fingerprint).any())

    def _put(self, bucket: int, fingerprint: int) -> bool:
        free = np.flatnonzero(self.slots[bucket] == 0)
        if len(free):
            self.slots[bucket, free[0]] = fingerprint
        return bool(len(free))

    def insert(self, key: int) -> bool:
        """Whether there was a place. Where there was none an entry may be lost: fill a larger filter from the stored keys."""
        fingerprint, one, two = self.places(key)
        if not (self._put(one, fingerprint) or self._put(two, fingerprint)):
            bucket = (one, two)[fingerprint & 1]
            for kick in range(self.kicks):
                slot = (fingerprint + kick) % SLOTS
                fingerprint, self.slots[bucket, slot] = int(self.slots[bucket, slot]), fingerprint
                bucket = self.other(bucket, fingerprint)
                if self._put(bucket, fingerprint):
                    break
            else:
                return False
        self.live += 1
        return True

    def delete(self, key: int) -> bool:
        """Take out one entry of a key that is live; others with its fingerprint and bucket keep theirs."""
        fingerprint, one, two = self.places(key)
        for bucket in (one, two):
            at = np.flatnonzero(self.slots[bucket] == fingerprint)
            if len(at):
                self.slots[bucket, at[0]] = 0
                self.live -= 1
                return True
        return False


class Shard:
    """A filter over a shard's live digests, and these in the filter's buckets (each in its key's first): what hits are verified against."""

    def __init__(self, filter_: CuckooFilter | None = None):
        self.filter = filter_ or CuckooFilter()
        self.live: dict[int, list[list]] = {}  # by bucket: records [digest, bytes, rows, kept id, kept batch, kept row]
        self.resized = self.hits = self.false_hits = 0

    @staticmethod
    def key_of(digest: bytes) -> int:
        return int.from_bytes(digest[8:16], "little")

    def bucket(self, digest: bytes) -> int:
        return self.filter.places(self.key_of(digest))[1]

    def records(self) -> Iterator[list]:
        for found in self.live.values():
            yield from found

    def known(self, digest: bytes, size: int) -> list | None:
        """The live record of a digest: looked for only where the filter has its fingerprint."""
        key = self.key_of(digest)
        if key not in self.filter:
            return None
        self.hits += 1
        for record in self.live.get(self.bucket(digest), ()):
            if record[0] == digest and record[1] == size:
                return record
        self.false_hits += 1
        return None

    def restore(self, record: list) -> None:
        """A stored record, whose fingerprint the filter has."""
        self.live.setdefault(self.bucket(record[0]), []).append(record)

    def add(self, digest: bytes, size: int, rows: int, *kept) -> None:
        """`rows` rows more, of which the one to keep is (id, batch, row)."""
        record = self.known(digest, size)
        if record is None:
            self.restore([digest, size, rows, *kept])
            if not self.filter.insert(self.key_of(digest)):
                self.resize()
            return
        record[2] += rows
        if (kept[0] is not None, *kept) > (record[3] is not None, *record[3:]):
            record[3:] = kept

    def remove(self, digest: bytes, size: int, rows: int, *kept) -> None:
        """What is left of a digest: `rows` rows; without any it is dead."""
        record = self.known(digest, size)
        if record is None:
            return
        if rows:
            record[2:] = rows, *kept
            return
        self.filter.delete(self.key_of(digest))
        self.live[self.bucket(digest)].remove(record)

    def resize(self) -> None:
        """Double the filter until all stored digests have a place. Digests of one key share their buckets, which hold eight of them; SHA-256 has no nine such."""
        self.resized += 1
        stored_keys, buckets = list(self.records()), self.filter.buckets
        while True:
            buckets *= 2
            self.filter = CuckooFilter(buckets)
            if all(self.filter.insert(self.key_of(r[0])) for r in stored_keys):
                break
        self.live = {}
        for r in stored_keys:
            self.restore(r)


def text_rows(docs: DataFrame, batch: int) -> DataFrame:
    """doc_id, digest, bytes, batch and row (unique in the batch) of each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = F.monotonically_increasing_id()
    return docs.select("doc_id", F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), F.octet_length(text).cast("long").alias("bytes"), F.lit(batch).alias("batch"), row.alias("row"))


def kept_of(last: str) -> list[Column]:
    return [F.col(f"{last}.doc_id").alias("kept_id"), F.col(f"{last}.batch").alias("kept_batch"), F.col(f"{last}.row").alias("kept_row")]


def shard_of(digest: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(shards)).cast("int")


#: kind 0: a shard's filter; 1: a stored record; 2: what a batch has of a digest; 3: what deletions leave of one.
STATE = "shard int, kind int, buckets long, live long, slots binary, digest binary, bytes long, rows long, kept_id {id}, kept_batch int, kept_row long, resized long, hits long, false_hits long"

RECORD = ("digest", "bytes", "rows", "kept_id", "kept_batch", "kept_row")


def _worked(key: tuple, batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> pa.Table:
    """A shard's state after a batch."""
    shard, kept, work = Shard(), [], []
    for b in batches:
        for r in b.to_pylist():
            record = [r[c] for c in RECORD]
            if r["kind"] == 0:
                shard.filter = CuckooFilter(r["buckets"])
                shard.filter.slots = np.frombuffer(r["slots"], np.uint16).reshape(-1, SLOTS).copy()
                shard.filter.live = r["live"]
            elif r["kind"] == 1:
                kept.append(record)
            else:
                work.append((r["kind"], *record))
    for record in kept:
        shard.restore(record)
    for kind, *rest in work:
        (shard.add if kind == 2 else shard.remove)(*rest)
    f = shard.filter
    out = [{"shard": key[0].as_py(), "kind": 0, "buckets": f.buckets, "live": f.live, "slots": f.slots.tobytes(), "resized": shard.resized, "hits": shard.hits, "false_hits": shard.false_hits}]
    out += [{"shard": key[0].as_py(), "kind": 1, **dict(zip(RECORD, r, strict=True))} for r in shard.records()]
    return pa.Table.from_pylist(out, schema)


class CuckooIndex:
    """Live digests of a growing and shrinking table. Each batch writes the shards' next state, then drops the one before, so a task that is lost is done again from the same state."""

    def __init__(self, spark: SparkSession, shards: int, id_type: str = "long"):
        self.spark, self.shards, self.id_type = spark, shards, id_type
        self.state: DataFrame | None = None
        self.rows: list[DataFrame] = []  # live rows: doc_id, digest, bytes, batch, row
        self.batches = 0

    def _advance(self, work: DataFrame) -> None:
        """work: shard, kind and the columns of a record."""
        layout = STATE.format(id=self.id_type)
        schema = self.spark.createDataFrame([], layout).schema
        arrow = to_arrow_schema(schema)

        def worked(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _worked(key, batches, arrow).to_batches(max_chunksize=10_000)

        full = work.select(*(F.col(f.name) if f.name in work.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))
        before, parts = self.state, full if self.state is None else self.state.unionAll(full)
        self.state = stored(parts.groupBy("shard").applyInArrow(worked, layout), "cuckoo")
        if before is not None:
            released(before)

    def insert(self, docs: DataFrame) -> DataFrame:
        """Add the documents; returns their rows (doc_id, digest, bytes, batch, row)."""
        rows = stored(text_rows(docs, self.batches), "digests")
        self.batches += 1
        self.rows.append(rows)
        # Copies within a group of scan partitions become one row, so a shard gets at most 64 of a digest.
        last = F.max(F.struct("doc_id", "batch", "row")).alias("last")
        some = rows.groupBy("digest", "bytes", (F.shiftright("row", 33) % 64).alias("part")).agg(F.count(F.lit(1)).alias("rows"), last)
        self._advance(some.select(shard_of(F.col("digest"), self.shards).alias("shard"), F.lit(2).alias("kind"), "digest", "bytes", "rows", *kept_of("last")))
        return rows

    def members(self) -> DataFrame:
        out = self.rows[0]
        for r in self.rows[1:]:
            out = out.unionAll(r)
        return out

    def delete(self, docs: DataFrame) -> None:
        """Take out all rows of these ids and texts; what isn't live is ignored."""
        gone = text_rows(docs, 0).select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")).distinct()
        is_gone = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest"))
        members = self.members()
        left = stored(members.join(gone, is_gone, "left_anti"), "digests")
        touched = members.join(gone, is_gone, "left_semi").groupBy("digest", "bytes").agg(F.count(F.lit(1)).alias("gone")).drop("gone")
        some = left.groupBy("digest", "bytes").agg(F.count(F.lit(1)).alias("rows"), F.max(F.struct("doc_id", "batch", "row")).alias("last"))
        work = touched.join(some, ["digest", "bytes"], "left")
        self._advance(work.select(shard_of(F.col("digest"), self.shards).alias("shard"), F.lit(3).alias("kind"), "digest", "bytes", F.coalesce("rows", F.lit(0)).alias("rows"), *kept_of("last")))
        released(*self.rows)
        self.rows = [left]

    def groups(self) -> DataFrame:
        """digest, bytes, rows and the kept row (kept_id, kept_batch, kept_row) of the live digests."""
        return self.state.where("kind = 1").select("digest", "bytes", "rows", "kept_id", "kept_batch", "kept_row")

    def filters(self) -> DataFrame:
        return self.state.where("kind = 0").select("shard", "buckets", "live", "resized", "hits", "false_hits")


def with_groups(rows: DataFrame, groups: DataFrame, n: int) -> DataFrame:
    """Rows beside their digest's group. Fewer than SHARE groups have more than n / SHARE rows: these are broadcast, the others joined by a shuffle."""
    named = groups.select(F.col("digest").alias("__digest"), F.col("rows").alias("group_size"), "kept_id", "kept_batch", "kept_row")
    is_hot = F.col("group_size") * SHARE > n
    same = F.col("digest") == F.col("__digest")
    hot = F.broadcast(named.where(is_hot))
    return rows.join(hot, same).unionAll(rows.join(hot, same, "left_anti").join(named.where(~is_hot), same))


def dedup(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row, through a new index."""
    spark, id_type = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    n = docs.count()
    index = CuckooIndex(spark, shards or blocks_for(n, SHARD_KEYS), id_type)
    rows = index.insert(docs)
    found = with_groups(rows, index.groups(), n)
    return found.select("doc_id", F.col("kept_id").alias("keep_id"), F.col("group_size").cast("long"), ((F.col("row") == F.col("kept_row")) & (F.col("batch") == F.col("kept_batch"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
