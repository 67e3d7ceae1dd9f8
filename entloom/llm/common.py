"""Helpers that the corpus operators share.

Nothing outside this subpackage imports it.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that ends a word, as a Java regular expression.
SPACE = "[\\x20\\x09-\\x0D]+"


def words_of(text: str | bytes | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of a text in UTF-8; `bytes.split` cuts at exactly these bytes."""
    if text is None:
        return []
    return (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else bytes(text)).split()


def lower_words_of(text: str | bytes | None) -> list[bytes]:
    """As `words_of` with A-Z in lower case (`bytes.lower` leaves all other letters alone)."""
    if text is None:
        return []
    return (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else bytes(text)).lower().split()


def word_array(text: Column) -> Column:
    """The words of a text column as an array, built by SQL functions; null counts as no text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def id_crc(doc_id: Column) -> Column:
    """crc32 of an id as text; a null id counts as an empty text (crc32 0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def id_name(doc_id: Column) -> Column:
    """An id as text, for joins; a null id has a name that no text has."""
    return F.coalesce(F.concat(F.lit("i"), doc_id.cast("string")), F.lit("n"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where a session on one machine has none (tests) a temporary folder is set; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="entloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Scratch paths of this process. Lazy results may read them until it ends.
_made: list[tuple[SparkSession, str]] = []


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        with contextlib.suppress(Exception):  # the session may have ended
            remove(spark, path)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is deleted when this process ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def let_go(spark: SparkSession) -> None:
    """Shuffle files of finished steps are deleted once the driver's JVM drops what refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage and outlives executors."""
    path = scratch(df.sparkSession, name)
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    let_go(df.sparkSession)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._entloom_path = path
    return out


def released(*tables: DataFrame) -> None:
    """Delete `stored` tables that nothing will read again."""
    for t in tables:
        path = t._entloom_path
        remove(t.sparkSession, path)
        _made[:] = [x for x in _made if x[1] != path]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks_for(total_bytes: int, block_bytes: int) -> int:
    """How many blocks of about `block_bytes` a corpus of `total_bytes` is dealt into."""
    return max(1, -(-int(total_bytes or 0) // block_bytes))
