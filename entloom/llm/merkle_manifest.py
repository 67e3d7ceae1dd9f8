"""Merkle manifest of a dataset: a hash tree for each group of rows, one over the groups' roots, and a proof for each row.

Bottom-up build: rows become leaves, numbered within their group in the order of their key; every `arity` consecutive nodes
(the last run may have fewer) become one, until a single node is left. Levels are persisted: a stored table holds a
*storey*, blocks of at most `BLOCK` consecutive nodes with their digests, and a block's root is a node of the next storey. So a tree over
10^10 rows has five stored storeys, and the levels within a block are folded in the task that has it.

Top-down push: children join their parent's block; each node prepends the siblings of its run to the proof suffix
that its block's root inherited. The proof of a leaf is checked by folding it: a tampered row doesn't fold to the root.

A leaf is sha256 of the values' encodings, concatenated: `-` for null, else the UTF-8 byte count, `:` and the value. Digests are
lowercase hex texts and are concatenated as such. A row alone in its group is its subroot, a group alone is the root; a run of one node is hashed too while its level has
others. Groups are ordered by value, null first; rows by key, null first, ties by leaf; equal rows have a leaf each, next to each other.
Null and empty texts are values of their own; long texts are hashed whole, in the JVM. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entloom.llm.common import stored
from entloom.operators.numbering import number_rows

#: Nodes of a block at most; a block is one row.
BLOCK = 256
#: A step of a proof: the digests of the siblings before and after the node, each concatenated; a run of one node has neither.
STEP = "struct<before:string,after:string>"


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_digest(values: Sequence[Column]) -> Column:
    texts = [v.cast("string") for v in values]
    return sha(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)))


def height_of(arity: int) -> int:
    """Levels of a block: the most with arity ** levels <= BLOCK."""
    if not 2 <= arity <= BLOCK:
        raise ValueError(f"arity must be from 2 to {BLOCK}")
    levels = 1
    while arity ** (levels + 1) <= BLOCK:
        levels += 1
    return levels


def folded(nodes: Column, arity: int) -> Column:
    """The level above an array of digests: the hash of each run of `arity`."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / arity).cast("int")), lambda r: sha(F.array_join(F.slice(nodes, r * arity + 1, F.lit(arity)), "")))


def storey(nodes: DataFrame, arity: int) -> DataFrame:
    """Blocks of the nodes (g, pos, n, digest, carried): g, block, n, nodes (in order), l1 .. (the levels within the block) and root.

    `n` is the number of the group's nodes. Where they are more than a block, all of its levels are folded; else until one node is left.
    """
    width = arity ** height_of(arity)
    rest = [c for c in nodes.columns if c not in ("g", "pos", "n")]
    one = F.array_sort(F.collect_list(F.struct("pos", *rest)))
    blocks = nodes.groupBy("g", F.floor(F.col("pos") / width).alias("block")).agg(F.first("n").alias("n"), one.alias("nodes"))
    blocks = blocks.withColumn("l0", F.col("nodes.digest"))
    for level in range(height_of(arity)):
        below = F.col(f"l{level}")
        blocks = blocks.withColumn(f"l{level + 1}", F.when((F.col("n") > width) | (F.size(below) > 1), folded(below, arity)).otherwise(below))
    return stored(blocks.withColumn("root", F.element_at(f"l{height_of(arity)}", 1)).drop("l0"), "storey")


def parents(blocks: DataFrame, arity: int) -> DataFrame:
    """The nodes of the next storey: a block's root each."""
    width = arity ** height_of(arity)
    return blocks.select("g", F.col("block").alias("pos"), F.ceil(F.col("n") / width).cast("long").alias("n"), F.col("root").alias("digest"))


def own_steps(index: Column, arity: int) -> Column:
    """The steps of a block's node (by its index) from its level up to the block's root."""
    steps, width = [], arity ** height_of(arity)
    for level in range(height_of(arity)):
        nodes, at = F.col(f"l{level}"), F.floor(index / arity**level).cast("int")
        start = (F.floor(at / arity) * arity).cast("int")
        step = F.struct(
            F.array_join(F.slice(nodes, start + 1, at - start), "").alias("before"),
            F.array_join(F.slice(nodes, at + 2, start + arity - at - 1), "").alias("after"),
        )
        steps.append(F.when((F.col("n") > width) | (F.size(nodes) > 1), step))
    return F.array_compact(F.array(*steps))


def pushed(blocks: DataFrame, above: DataFrame, arity: int) -> DataFrame:
    """A block's nodes with their steps up to the top: its own, then those that its root inherited (`above`: g, pos, steps, subroot)."""
    inherited = above.select(F.col("g").alias("__g"), F.col("pos").alias("__pos"), F.col("steps").alias("__suffix"), "__subroot")
    joined = blocks.join(inherited, F.col("g").eqNullSafe(F.col("__g")) & (F.col("block") == F.col("__pos")))
    nodes = joined.withColumn("l0", F.col("nodes.digest")).select("*", F.posexplode("nodes").alias("__i", "__node"))
    return nodes.select("g", "__node.*", "__subroot", F.concat(own_steps(F.col("__i"), arity), F.col("__suffix")).alias("steps"))


def grow(nodes: DataFrame, arity: int) -> tuple[list[DataFrame], DataFrame]:
    """The stored storeys over `nodes`, lowest first, and each group's root (g, digest)."""
    width, built = arity ** height_of(arity), []
    most = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        built.append(storey(nodes, arity))
        nodes = parents(built[-1], arity)
        if most <= width:
            return built, nodes.select("g", "digest")
        most = -(-most // width)


def fold(digest: Column, steps: Column) -> Column:
    """The digest that a proof leads to."""
    return F.aggregate(steps, digest, lambda d, s: sha(F.concat(s["before"], d, s["after"])))


def manifest(docs: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "lang", key: str = "doc_id", arity: int = 2, changed: tuple[Column, dict[str, Column]] | None = None) -> DataFrame:
    """key, leaf, subroot, root and `steps` (the proof) of each row, and `now`: the leaf that the row has after `changed`.

    changed: a condition and columns' new values where it holds; the proof and the roots are those of the rows before.
    """
    leaf = leaf_digest([F.col(c) for c in columns])
    now = leaf
    if changed is not None:
        where, values = changed
        after = leaf_digest([values.get(c, F.col(c)) for c in columns])
        now = F.when(F.coalesce(where, F.lit(False)), after)
    rows = stored(docs.select(F.col(group).alias("g"), F.col(key).alias("key"), leaf.alias("digest"), now.alias("now")), "leaves")
    numbered = number_rows(rows, ["key", "digest"], ["g"], "pos", "n").withColumn("pos", F.col("pos") - 1)
    storeys, subroots = grow(numbered, arity)

    # The groups' roots are the leaves of the upper tree, which has one group.
    upper = subroots.select(F.lit(0).alias("g"), F.col("g").alias("key"), "digest")
    tops, roots = grow(number_rows(upper, ["key"], ["g"], "pos", "n").withColumn("pos", F.col("pos") - 1), arity)
    root = roots.first()

    above = roots.select("g", F.lit(0).cast("long").alias("pos"), F.array().cast(f"array<{STEP}>").alias("steps"), F.lit(None).cast("string").alias("__subroot"))
    for blocks in reversed(tops):
        above = pushed(blocks, above, arity)
    above = above.select(F.col("key").alias("g"), F.lit(0).cast("long").alias("pos"), "steps", F.col("digest").alias("__subroot"))
    for blocks in reversed(storeys):
        above = pushed(blocks, above, arity)
    return above.select("key", F.col("digest").alias("leaf"), F.col("__subroot").alias("subroot"), F.lit(root and root["digest"]).cast("string").alias("root"), "steps", F.coalesce("now", "digest").alias("now"))


def verified(rows: DataFrame) -> DataFrame:
    """Rows of `manifest` with proof_sha256, folded_root (of the leaf as it is now) and verified."""
    proof = F.array_join(F.transform("steps", lambda s: F.concat(s["before"], s["after"])), "")
    out = rows.select("key", "leaf", "subroot", "root", sha(proof).alias("proof_sha256"), fold(F.col("now"), F.col("steps")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
