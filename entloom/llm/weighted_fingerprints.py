"""Document fingerprints by consistent weighted sampling.

A text is its words weighted by their counts. For every sample k each word has, by hash,
two gamma(2,1) variates r and c and a uniform b, the same wherever it occurs. With weight S:

    t = floor(ln S / r + b),   ln y = r (t - b),   ln a = ln c - ln y - r

and the sample is the pair (word, t) of the least a. Two texts agree in a sample with the
probability of their generalised Jaccard similarity (sum of the smaller weights over the sum of the larger).

DataFrame operations only. Rows are dealt by document once; words are counted and their
samples reduced within that dealing, so nothing that was exploded is shuffled. A sample is one
long, the rounded ln a above bits of (word, t): its minimum is the arg min.

Null text counts as empty; the fingerprint of a text without words is all zeros, like only another such.
Rows of equal id are documents of their own; their next document is the first, by its
text's hash, of the next larger id. A null id is larger than any other and ids wrap around. An empty table gives an
empty table. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entloom.llm.common import blocks_for, stored, word_array

#: Most of a sample's bits are ln a, shifted to be positive, in steps of 2 ** -22.
_SHIFT, _STEP, _LOW = 100.0, float(1 << 22), 0xFFFFFFFF


def _unit(h: Column, at: int) -> Column:
    """A number in (0, 1) from 24 bits of a hash."""
    return (F.shiftrightunsigned(h, at).bitwiseAND(F.lit(0xFFFFFF)) + 0.5) * (1.0 / (1 << 24))


def sample(term: Column, log_weight: Column, k: int) -> Column:
    """Sample k of a term: the long whose least value over a text's terms is the text's sample."""
    one, two = F.xxhash64(term, F.lit(2 * k)), F.xxhash64(term, F.lit(2 * k + 1))
    r = -F.log(_unit(one, 0) * _unit(one, 24))
    b = (F.shiftrightunsigned(one, 48) * 65536 + F.shiftrightunsigned(two, 48) + 0.5) * (1.0 / (1 << 32))
    log_c = F.log(-F.log(_unit(two, 0) * _unit(two, 24)))
    t = F.floor(log_weight / r + b)
    log_a = log_c - r * (t - b) - r
    return F.shiftleft(((log_a + _SHIFT) * _STEP).cast("long"), 32).bitwiseOR((term + t * 2654435761).bitwiseAND(F.lit(_LOW)))


def sample_terms(rows: DataFrame, keys: list[str], words: str, samples: int) -> DataFrame:
    """keys and s: the samples (their bits of word and t) of each row's array of words. `keys` must begin with what the rows are dealt by."""
    terms = rows.select(*keys, F.explode(words).alias("__word")).select(*keys, F.xxhash64("__word").alias("__term"))
    weights = terms.groupBy(*keys, "__term").agg(F.count(F.lit(1)).alias("__n")).withColumn("__ln", F.log(F.col("__n").cast("double")))
    mins = weights.groupBy(*keys).agg(*(F.min(sample(F.col("__term"), F.col("__ln"), k)).alias(f"__s{k}") for k in range(samples)))
    return mins.select(*keys, F.array(*(F.col(f"__s{k}").bitwiseAND(F.lit(_LOW)) for k in range(samples))).alias("s"))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples; two texts without words are alike."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.size(a).cast("double")
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same)


def as_text(s: Column, samples: int) -> Column:
    """The samples' term bits in hexadecimal, eight digits each."""
    digits = F.array_join(F.transform(s, lambda x: F.lpad(F.hex(x), 8, "0")), "")
    return F.coalesce(digits, F.lit("0" * 8 * samples))


def next_ids(ids: DataFrame, parts: int) -> DataFrame:
    """id and next_id, the next larger one; the largest's is the smallest. `ids`: distinct ids, nulls last.

    Ids are sorted by ranges; each range looks ahead within itself, its last row to the first of the next range.
    """
    dealt = ids.repartitionByRange(parts, F.col("id").asc_nulls_last()).withColumn("__part", F.spark_partition_id())
    dealt = stored(dealt, "ids")
    inner = Window.partitionBy("__part").orderBy(F.col("id").asc_nulls_last())
    led = dealt.withColumn("__next", F.lead(F.struct("id")).over(inner))
    first = dealt.groupBy("__part").agg(F.min_by(F.struct("id"), F.struct(F.col("id").isNull(), "id")).alias("__first"))
    # As many rows as ranges.
    around = Window.partitionBy(F.lit(0)).orderBy("__part")
    after = first.select("__part", F.coalesce(F.lead("__first").over(around), F.first("__first").over(around)).alias("__after"))
    joined = led.join(after, "__part").select("id", F.coalesce("__next", "__after").alias("__to"), "__quarter")
    return joined.select("id", F.col("__to.id").alias("next_id"), "__quarter")


def _name(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit("null"))


def fingerprints(docs: DataFrame, samples: int = 32, part_bytes: int = 8 << 20) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness.

    The edited text ends in the beginning of the next document: as many code points, a quarter of the text's.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    src = docs.select("doc_id", _name(F.col("doc_id")).alias("__k"), body.alias("__t"))
    parts = blocks_for(src.agg(F.sum(F.octet_length("__t"))).first()[0], part_bytes)
    ids = src.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.floor(F.length("__t") / 4)).alias("__quarter"))
    follow = stored(next_ids(ids, max(1, parts // 8)).select(_name(F.col("id")).alias("__k"), _name(F.col("next_id")).alias("__next"), "__quarter"), "next")

    # Texts are dealt once by id. Equal rows (id and text) are worked on once.
    dealt = src.repartition(parts, "__k").withColumn("__h", F.xxhash64("__t"))
    nth = F.row_number().over(Window.partitionBy("__k", "__h").orderBy("__h"))
    uniq = dealt.select("__k", "__h", "__t", nth.alias("__nth")).where("__nth = 1").drop("__nth")
    # The next document sends its beginning, as much as is asked for.
    asked = follow.select(F.col("__next").alias("__k"), F.col("__k").alias("__to"), "__quarter").repartition(parts, "__k")
    sent = uniq.join(asked, "__k").select(F.col("__to").alias("__k"), F.expr("left(__t, int(__quarter))").alias("__head"), "__h")
    heads = sent.repartition(parts, "__k").groupBy("__k").agg(F.min_by("__head", "__h").alias("__head"))
    both = uniq.join(heads, "__k").withColumn("__n", F.length("__t")).withColumn("__q", F.floor(F.col("__n") / 4).cast("int"))
    both = both.select("__k", "__h", "__n", "__t", F.expr("concat(left(__t, __n - __q), left(__head, __q))").alias("__e"))

    versions = F.array(*(F.struct(F.lit(v).alias("v"), F.col(c).alias("t")) for v, c in enumerate(("__t", "__e"))))
    flat = both.select("__k", "__h", F.explode(versions).alias("x")).select("__k", "__h", F.col("x.v").alias("v"), word_array(F.col("x.t")).alias("w"))
    # One plan for both, so that the dealt texts are shuffled once.
    signed = sample_terms(flat, ["__k", "__h", "v"], "w", samples)
    facts = both.select("__k", "__h", F.lit(2).alias("v"), F.col("__n").cast("long").alias("n_chars"), F.sha2(F.col("__e").cast("binary"), 256).alias("edited_sha256"))
    kept = stored(signed.unionByName(facts, allowMissingColumns=True), "signatures")
    signed, facts = kept.where("v < 2"), kept.where("v = 2").drop("v", "s")

    own = signed.where("v = 0").select("__k", "__h", F.col("s").alias("__own"))
    edited = signed.where("v = 1").select("__k", "__h", F.col("s").alias("__edited"))
    # The next document's own signature: that of the first text of its id.
    first = facts.groupBy("__k").agg(F.min("__h").alias("__h")).join(own, ["__k", "__h"], "left")
    after = follow.select("__k", "__next").join(first.select(F.col("__k").alias("__next"), F.col("__own").alias("__after")), "__next").drop("__next")
    known = facts.join(own, ["__k", "__h"], "left").join(edited, ["__k", "__h"], "left").join(after, "__k")
    every = src.select("doc_id", "__k", F.xxhash64("__t").alias("__h")).join(known, ["__k", "__h"])
    return every.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("__own"), samples).alias("fingerprint"), as_text(F.col("__edited"), samples).alias("edited_fingerprint"),
        likeness(F.col("__own"), F.col("__edited")).alias("near_edited"), likeness(F.col("__own"), F.col("__after")).alias("near_next"),
    )
