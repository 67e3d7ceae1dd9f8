"""Entity tables as versioned Parquet snapshots.

A plain table is a folder for each version. A keyed table lies in buckets by its id's hash, and a version is a manifest: where each bucket's files lie. A merge joins and
rewrites only the buckets that it touches; all others stay where an earlier version wrote them. The number of buckets doubles with the table.

A version is completed by creating one file, after its data are written, so readers never see half a load and a failed one leaves no trace but
an unused folder, which the next load overwrites.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Manifest:
    """A keyed table's version: the number of buckets and of rows, and for each bucket that has rows the version that wrote it."""

    buckets: int
    rows: int
    written: dict[int, int]

    def text(self) -> str:
        return json.dumps({"buckets": self.buckets, "rows": self.rows, "written": self.written})

    @staticmethod
    def of(text: str) -> Manifest:
        found = json.loads(text)
        return Manifest(found["buckets"], found["rows"], {int(k): v for k, v in found["written"].items()})


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _written_by(df: DataFrame):
    """A writer whose tasks move their files into place themselves, not the driver one by one: what a broken write leaves is no version's. Ids and hashes are hexadecimal, of which zstd leaves half."""
    return df.write.option("compression", "zstd").option("mapreduce.fileoutputcommitter.algorithm.version", "2")


class Store:
    """keep: versions of a table that stay readable. bucket_rows: rows of a keyed table's bucket on average, at most."""

    def __init__(self, spark: SparkSession, root: str, keep: int = 2, bucket_rows: int = 500_000):
        self.spark, self.root, self.keep, self.bucket_rows = spark, root.rstrip("/"), keep, bucket_rows

    # -- files ---------------------------------------------------------------------------

    def _path(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}")
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        p, fs = self._path(path)
        return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []

    def _delete(self, path: str) -> None:
        p, fs = self._path(path)
        fs.delete(p, True)

    def _complete(self, table: str, version: int, manifest: Manifest | None = None) -> None:
        """One new file makes the version current. Nothing is deleted before, so a driver that is lost leaves the version before or this one; a second writer of the same version fails."""
        if manifest is not None:
            p, fs = self._path(f"{table}/_manifests/{version}")
            out = fs.create(p, True)
            out.write(manifest.text().encode())
            out.close()
        p, fs = self._path(f"{table}/_versions/{version}")
        fs.create(p, False).close()

    def version(self, table: str) -> int:
        """The current version: the greatest that was completed; 0 if the table doesn't exist."""
        return max(map(int, self._names(f"{table}/_versions")), default=0)

    def manifest(self, table: str, version: int | None = None) -> Manifest | None:
        """A keyed table's manifest; None for a plain table or none."""
        at = self.version(table) if version is None else version
        p, fs = self._path(f"{table}/_manifests/{at}")
        return Manifest.of(bytes(fs.open(p).readAllBytes()).decode()) if at and fs.exists(p) else None

    def _clean(self, table: str, at: int) -> None:
        """Delete the version that is `keep` behind, and of its data what no later one refers to."""
        old = at - self.keep
        if old < 1 or str(old) not in self._names(f"{table}/_versions"):
            return
        manifest = self.manifest(table, old)
        if manifest is None:
            self._delete(f"{table}/v{old}")
        else:
            later = [m for v in range(old + 1, at + 1) if (m := self.manifest(table, v)) is not None]
            used = {(m.buckets, b, v) for m in later for b, v in m.written.items()}
            # A version of which nothing is left is deleted as a whole, not bucket by bucket.
            whole = {v for v in manifest.written.values()} - {v for m in later for v in m.written.values()}
            for v in whole:
                self._delete(f"{table}/v{v}")
            for b, v in manifest.written.items():
                if v not in whole and (manifest.buckets, b, v) not in used:
                    self._delete(f"{table}/v{v}/bucket={b}")
        self._delete(f"{table}/_versions/{old}")
        self._delete(f"{table}/_manifests/{old}")

    # -- tables ---------------------------------------------------------------------------

    def _buckets(self, table: str, manifest: Manifest, only: set[int] | None, schema: T.StructType) -> DataFrame:
        by_version: dict[int, list[int]] = {}
        for b, v in manifest.written.items():
            if only is None or b in only:
                by_version.setdefault(v, []).append(b)
        if not by_version:
            return self.spark.createDataFrame([], schema).limit(0)  # the planner knows that it is empty and drops joins with it
        # A version is read by its folder and the buckets as values that are pruned: paths of their own would each be looked up.
        buckets = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])
        parts = [self.spark.read.schema(buckets).parquet(f"{self.root}/{table}/v{v}").where(F.col("bucket").isin(found)).drop("bucket") for v, found in sorted(by_version.items())]
        return functools.reduce(DataFrame.unionAll, parts)

    def is_empty(self, table: str) -> bool:
        """Whether a keyed table has no rows yet."""
        manifest = self.manifest(table)
        return manifest is not None and not manifest.written

    def read(self, table: str, schema: T.StructType) -> DataFrame:
        """The current version; an empty table if there is none."""
        at = self.version(table)
        manifest = self.manifest(table, at)
        if manifest is not None:
            return self._buckets(table, manifest, None, schema)
        if not at:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{table}/v{at}")

    def write(self, table: str, df: DataFrame, by: tuple[str, ...] = ()) -> int:
        """The next version of a plain table; older ones but `keep` go. `by`: columns whose values have folders of their own, which readers prune."""
        at = self.version(table) + 1
        _written_by(df).mode("overwrite").partitionBy(*by).parquet(f"{self.root}/{table}/v{at}")
        self._complete(table, at)
        self._clean(table, at)
        return at

    def create(self, table: str, buckets: int = 16) -> None:
        """An empty keyed table. The number of buckets is a power of two, so a bucket's rows stay together or split in two when it doubles."""
        if buckets & (buckets - 1):
            raise ValueError("the number of buckets must be a power of two")
        self._complete(table, self.version(table) + 1, Manifest(buckets, 0, {}))

    def merge(self, table: str, schema: T.StructType, new: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame], key: str = "id") -> dict[str, int]:
        """The next version of a keyed table: `combine(old rows, new rows)` of the buckets that the new rows' keys are in.

        `combine` returns the table's columns and __state ('kept', 'updated' or 'inserted'), whose counts are returned. `new` is read twice: give a stored table. If the
        table is empty it is read once.
        """
        at = self.version(table)
        manifest = self.manifest(table, at)
        if manifest is None:
            self.create(table)
            at, manifest = at + 1, Manifest(16, 0, {})
        buckets = manifest.buckets
        # As many numbers as there are buckets, at most.
        touched = {r[0] for r in new.select(bucket_of(F.col(key), buckets)).distinct().collect()} if manifest.written else set(range(buckets))
        if not touched:
            return {"kept": 0, "updated": 0, "inserted": 0}
        seen = Observation()
        counts = [F.count_if(F.col("__state") == s).alias(s) for s in ("kept", "updated", "inserted")]
        merged = combine(self._buckets(table, manifest, touched, schema), new).observe(seen, *counts).drop("__state")
        self._write_buckets(table, at + 1, merged, key, buckets, len(touched))
        found = {k: v or 0 for k, v in seen.get.items()}
        if not (made := self._written(table, at + 1)):
            return found
        written = {b: v for b, v in manifest.written.items() if b not in touched} | {b: at + 1 for b in made}
        rows = manifest.rows + found["inserted"]
        self._complete(table, at + 1, Manifest(buckets, rows, written))
        self._clean(table, at + 1)
        if rows > self.bucket_rows * buckets:
            self._split(table, schema, key, rows)
        return found

    def _write_buckets(self, table: str, version: int, df: DataFrame, key: str, buckets: int, tasks: int) -> None:
        dealt = df.withColumn("bucket", bucket_of(F.col(key), buckets)).repartition(min(tasks, 2000), "bucket")
        _written_by(dealt).mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{table}/v{version}")

    def _written(self, table: str, version: int) -> list[int]:
        return [int(n.split("=")[1]) for n in self._names(f"{table}/v{version}") if n.startswith("bucket=")]

    def _split(self, table: str, schema: T.StructType, key: str, rows: int) -> None:
        """A version with more buckets and the same rows. Done each time the table has doubled, so a row is moved a constant number of times on average."""
        at, manifest = self.version(table) + 1, self.manifest(table)
        buckets = manifest.buckets
        while rows > self.bucket_rows * buckets:
            buckets *= 2
        buckets *= 2
        self._write_buckets(table, at, self._buckets(table, manifest, None, schema), key, buckets, buckets)
        self._complete(table, at, Manifest(buckets, rows, {b: at for b in self._written(table, at)}))
        self._clean(table, at)

    def append(self, table: str, df: DataFrame, by: tuple[str, ...] = ()) -> None:
        """Rows added to a log table, whose files are never rewritten; `by`: columns whose values have folders of their own, which readers prune."""
        df.write.option("compression", "zstd").mode("append").partitionBy(*by).parquet(f"{self.root}/{table}/log")

    def read_log(self, table: str, schema: T.StructType) -> DataFrame:
        p, fs = self._path(f"{table}/log")
        return self.spark.read.schema(schema).parquet(f"{self.root}/{table}/log") if fs.exists(p) else self.spark.createDataFrame([], schema)

    def drop(self, table: str) -> None:
        self._delete(table)
