"""Alignment of two tokenizers' tokens over the same bytes, in relational steps.

Texts are dealt by the number of their row, encoded there by both tokenizers and stored in buckets, with the ends of each side's tokens as a bit for each byte, in words of 64. The words are laid out as rows (posexplode), and an equi-join on row and
word finds the offsets where tokens of both sides end, the cuts, as the bits that both have. The tokens between two cuts,
a range of positions on either side, are a group. A pair of tokens that end together is a link. Links are counted corpus-wide, and each text gets what
its links have.

Join and aggregation follow in the same dealing, so texts are shuffled and tokens never. A task's rows are words of 64 bytes of text, which are sorted and may spill; of one
text the cuts are one value of half its bytes, and its tokens another. Pairs of ids are counted
after partial sums. They are broadcast up to `SMALL` pairs; beyond, pairs that hold more than one in `SHARE` links, so fewer than `SHARE`, are broadcast and all others joined by a shuffle.

Null and empty texts and texts whose tokens' bytes don't give back the text have no tokens: zeros and an empty `groups_sha256`. Invalid UTF-8 is such a
text. Long texts are encoded whole. Rows that repeat and null ids are rows of their own. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import contextlib
import functools
import hashlib
import itertools
import json
import operator
import os
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from entloom.llm.common import blocks_for, let_go, released, scratch, stored

SMALL = 1_000_000
SHARE = 1000
#: Bytes of text of a task's tokens: a million on either side.
BLOCK_BYTES = 2_500_000


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable Latin-1 ones stand for themselves, the others for letters from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


#: The pattern of a byte-level pre-tokenizer.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs of letters or white space from here on are left to the `tokenizers` library.
LONG_RUN = 500
_WIDE = re.compile(f"\\s{{{LONG_RUN}}}")


@functools.cache
def unsettled() -> re.Pattern:
    """Letters that Unicode's versions don't all put in the same of the pattern's classes (letters, numbers, white space, others): libraries differ in their version."""

    def kind(c: str, tables) -> str:
        found = tables.category(c)
        return found if found == "Cn" or found[0] == "Z" else found[0] if found[0] in "LN" else "other"

    def odd(i: int) -> bool:
        c = chr(i)
        return unicodedata.ucd_3_2_0.category(c) == "Cn" or kind(c, unicodedata.ucd_3_2_0) != kind(c, unicodedata)

    marks = [odd(i) for i in range(0x10000)]
    edge = [i for i in range(1, 0x10000) if marks[i] != marks[i - 1]]
    spans = zip(edge[::2], [*edge[1::2], 0x10000], strict=False)  # U+0000 is settled
    return re.compile("[" + "".join(f"\\u{a:04x}-\\u{b - 1:04x}" for a, b in spans) + "\\U00010000-\\U0010ffff]")


class ByteLevel:
    """A byte-level tokenizer of the `tokenizers` library, from its JSON; it encodes a space and the text. Special tokens' strings in texts are plain text.

    Where each merge makes another token, ids follow the merges' order and the library encodes every token as itself, merging the pair whose joined bytes have the least
    id is the same: two neighbours that make a token are then always the pair of its merge. `tiktoken` does that, in a quarter of the time. Texts with long runs or
    with letters that are new in Unicode go through the library.
    """

    def __init__(self, raw: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(raw.decode())
        self.tokenizer.encode_special_tokens = True
        letters = byte_letters()
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_of[i] = bytes(letters[c] for c in token)
        spec = json.loads(raw)
        pre = spec["pre_tokenizer"] or {}
        plain = spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre["add_prefix_space"]
        #: Every byte is a token and texts aren't changed, so tokens' bytes are the text's.
        self.lossless = plain and {bytes([i]) for i in range(256)} <= set(self.bytes_of)
        self.quick = self._by_rank(spec["model"]) if self.lossless else None
        #: Which tokens begin a word; None where words can't be told apart.
        self.begins = np.array([x.startswith(b" ") for x in self.bytes_of]) if self.quick else None

    def _by_rank(self, model: dict):
        import tiktoken

        ids, plain = model["vocab"], ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
        merged = [ids["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        alone = all(len(self.bytes_of[i]) == 1 for i in set(ids.values()) - set(merged))
        if any(model.get(x) for x in plain) or any(a >= b for a, b in itertools.pairwise(merged)) or not alone:
            return None
        if any([t.id for t in self.tokenizer.model.tokenize(token)] != [i] for token, i in ids.items()):
            return None
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={self.bytes_of[i]: i for i in ids.values()}, special_tokens={})

    def fits(self, t: str) -> bool:
        return self.quick and max(map(len, t.split()), default=0) < LONG_RUN and not _WIDE.search(t) and (t.isascii() or not unsettled().search(t))

    def stands_alone(self, word: str) -> bool:
        """The pattern cuts before the space of a word that no white space begins or ends: its tokens don't depend on other words."""
        return word == word.strip() and self.fits(word)

    def joined(self, words: list[str]) -> list[int]:
        return self.quick.encode_ordinary(" " + " ".join(words))

    def encode(self, texts: list[str]) -> list[list[int]]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        found, rest = [], []
        for i, t in enumerate(texts):
            fits = self.fits(t)
            found.append(self.quick.encode_ordinary(" " + t) if fits else None)
            if not fits:
                rest.append(i)
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([" " + texts[i] for i in rest], add_special_tokens=False), strict=True):
            found[i] = e.ids
        return found


class Pieces:
    """A sentencepiece model, from its file's bytes; it adds the space itself."""

    lossless = False

    def __init__(self, raw: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=raw)
        ids = range(self.model.get_piece_size())
        texts = [self.model.id_to_piece(i) for i in ids]
        self.bytes_of = [bytes([int(t[3:-1], 16)]) if self.model.is_byte(i) else t.replace("\u2581", " ").encode() for i, t in zip(ids, texts, strict=True)]
        self.begins = np.array([t.startswith("\u2581") for t in texts]) if self._by_words(raw, texts) else None

    @staticmethod
    def _by_words(raw: bytes, texts: list[str]) -> bool:
        """No piece goes on after a space into the next word, and texts aren't normalized: a text's pieces are those of its words."""
        try:
            from sentencepiece import sentencepiece_model_pb2
        except ImportError:
            return False
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(raw)
        rules, trained = spec.normalizer_spec, spec.trainer_spec
        plain = rules.add_dummy_prefix and rules.escape_whitespaces and not (rules.remove_extra_whitespaces or rules.precompiled_charsmap or trained.treat_whitespace_as_suffix)
        odd = any(x.type in (x.USER_DEFINED, x.UNUSED) for x in spec.pieces)
        return plain and not odd and trained.model_type == trained.BPE and all("\u2581" not in t[1:] or not t.strip("\u2581") for t in texts)

    def stands_alone(self, word: str) -> bool:
        return "\u2581" not in word

    def joined(self, words: list[str]) -> list[int]:
        return self.model.encode(" ".join(words), num_threads=1)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def tokenizer_of(raw: bytes):
    """By content: JSON is the `tokenizers` library's, all else a sentencepiece model."""
    try:
        json.loads(raw)
    except ValueError:
        return Pieces(raw)
    return ByteLevel(raw)


def _decoded(raw: bytes | None) -> str:
    """A text; null and invalid UTF-8 are none."""
    try:
        return (raw or b"").decode()
    except UnicodeDecodeError:
        return ""


class Encoder:
    """Ids of whole texts; a text that its tokens' bytes don't give back has none."""

    def __init__(self, raw: bytes):
        self.tokenizer = tokenizer_of(raw)
        self.sizes = np.fromiter(map(len, self.tokenizer.bytes_of), np.int32)

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        letters, sure, plain = self.tokenizer.bytes_of, self.tokenizer.lossless, [_decoded(raw) for raw in texts]
        found = [x if t and (sure or b"".join(map(letters.__getitem__, x)) == b" " + t.encode()) else [] for t, x in zip(plain, self.tokenizer.encode(plain), strict=True)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, int(counts.sum())), counts


@functools.lru_cache(maxsize=4)
def encoder_of(raw: bytes) -> Encoder:
    """A Python worker keeps its encoders from task to task."""
    return Encoder(raw)


#: Words whose tokens a worker keeps, and those of the last texts.
KNOWN_WORDS = 400_000
#: What is kept of a word that has no tokens of its own.
_NO_WORD = (b"", b"")


class Pair:
    """Two encoders. The tokens of words, parted by single spaces, are kept for both, where both know words; other texts are encoded whole."""

    def __init__(self, first: bytes, second: bytes):
        self.encoders = [encoder_of(raw) for raw in (first, second)]
        self.sides = [e.tokenizer for e in self.encoders]
        self.by_words = all(side.begins is not None for side in self.sides)
        self.known = {"": _NO_WORD}

    def _learn(self, words: list[str]) -> None:
        """Tokens of words, from one text: each begins with the only token that begins a word."""
        if not words:
            return
        text, cut = b" " + " ".join(words).encode(), []
        for side in self.sides:
            ids = np.array(side.joined(words), np.int32)
            edge = np.append(np.flatnonzero(side.begins[ids]), len(ids))
            # No word has a space: if all bytes are those of the text, each word's tokens are its own.
            if len(edge) == len(words) + 1 and b"".join(map(side.bytes_of.__getitem__, ids.tolist())) == text:
                data, at = ids.tobytes(), (4 * edge).tolist()
                cut.append(map(data.__getitem__, map(slice, at[:-1], at[1:])))
        if len(cut) == 2:
            self.known.update(zip(words, zip(*cut, strict=True), strict=True))
        elif len(words) == 1:
            self.known[words[0]] = _NO_WORD
        else:
            self._learn(words[: len(words) // 2])
            self._learn(words[len(words) // 2 :])

    def _from_words(self, texts: list[str]) -> list[list[tuple[bytes, bytes]]]:
        """Of each text the tokens of its words; an empty list where one has none of its own."""
        if len(self.known) > KNOWN_WORDS:
            self.known = {"": _NO_WORD}
        get, split = self.known.get, [t.split(" ") for t in texts]
        found = [list(map(get, words)) for words in split]
        late = [i for i, x in enumerate(found) if None in x]
        new = dict.fromkeys(w for i in late for w, x in zip(split[i], found[i], strict=True) if x is None)
        alone = [w for w in new if all(side.stands_alone(w) for side in self.sides)]
        self.known.update(dict.fromkeys(new.keys() - set(alone), _NO_WORD))
        self._learn(alone)
        for i in late:
            found[i] = list(map(get, split[i]))
        return [[] if _NO_WORD in x else x for x in found]

    def encode(self, texts: list[bytes | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """As each encoder's `encode`."""
        if not self.by_words:
            return [e.encode(texts) for e in self.encoders]
        words = self._from_words([_decoded(raw) for raw in texts])
        rest, out = [i for i, x in enumerate(words) if not x], []
        for k, encoder in enumerate(self.encoders):
            part = [np.frombuffer(b"".join(map(operator.itemgetter(k), x)), np.int32) for x in words]
            ids, counts = encoder.encode([texts[i] for i in rest])
            for i, x in zip(rest, np.split(ids, np.cumsum(counts)[:-1]) if rest else [], strict=True):
                part[i] = x
            out.append((np.concatenate(part) if part else ids, np.fromiter(map(len, part), np.int64, len(part))))
        return out


@functools.lru_cache(maxsize=2)
def pair_of(first: bytes, second: bytes) -> Pair:
    return Pair(first, second)


#: A token's id is below this; its size in bytes comes above.
_ID_BITS = 20


def _list(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(values))


def end_words(sizes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ends of texts' tokens as words of 64 bits, and how many words each text has. A token that ends with byte i of its text sets bit i."""
    upto, text = np.cumsum(sizes, dtype=np.int64), np.repeat(np.arange(len(counts)), counts)
    total = np.concatenate(([0], upto))[np.concatenate(([0], np.cumsum(counts)))]
    words = -(-np.diff(total) // 64)
    start = np.concatenate(([0], np.cumsum(words)))
    bits = np.zeros(start[-1] * 64, np.uint8)
    bits[upto - 1 + (start[:-1] * 64 - total[:-1])[text]] = 1
    return np.packbits(bits, bitorder="little").view(np.int64), words


def encoded(docs: DataFrame, first: str, second: str, block_bytes: int) -> DataFrame:
    """doc_id, row, the tokens a and b of every text (id and size in one number) and their ends (words of bits), stored in buckets by row: texts are shuffled once, tokens never.

    A text that one side doesn't give back has no tokens on either.
    """
    spark, sides = docs.sparkSession, []
    for path in (first, second):
        with open(path, "rb") as f:
            sides.append(f.read())
    shared = spark.sparkContext.broadcast(sides)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 250):
                piece = batch.slice(lo, 250)
                texts = piece.column(2).to_pylist()
                pair = pair_of(*shared.value)
                encoders, found = pair.encoders, pair.encode(texts)
                both = (found[0][1] > 0) & (found[1][1] > 0)
                tokens, ends = [], []
                for encoder, (ids, counts) in zip(encoders, found, strict=True):
                    ids, counts = ids[np.repeat(both, counts)], np.where(both, counts, 0)
                    sizes = encoder.sizes[ids]
                    tokens.append(_list(ids | sizes << _ID_BITS, counts))
                    ends.append(_list(*end_words(sizes, counts)))
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), *tokens, *ends], names=["doc_id", "row", "a", "b", "a_ends", "b_ends"])

    text = F.col("text").cast("binary")
    # As many buckets as blocks of texts; a catalogue holds 100,000 at most.
    parts = min(100_000, max(blocks_for(docs.agg(F.sum(F.octet_length(text))).first()[0], block_bytes), spark.sparkContext.defaultParallelism))
    dealt = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), text.alias("text")).repartition(parts, "row")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = dealt.mapInArrow(run, f"doc_id {id_type}, row long, a array<int>, b array<int>, a_ends array<long>, b_ends array<long>")
    path = scratch(spark, "tokens")
    name = "tokens_" + path.rsplit("-", 1)[1]
    rows.write.bucketBy(parts, "row").option("path", path).option("compression", "zstd").saveAsTable(name)
    let_go(spark)
    out = spark.table(name)
    out._entloom_path, out._entloom_name = path, name
    return out


def forgotten(rows: DataFrame) -> None:
    """Delete what `encoded` has stored."""
    rows.sparkSession.sql(f"DROP TABLE {rows._entloom_name}")
    released(rows)


def ends(rows: DataFrame, side: str) -> DataFrame:
    """The side's ends as rows: row, word and <side>_bits, of words that have any."""
    return rows.select("row", F.posexplode(f"{side}_ends").alias("word", f"{side}_bits")).where(F.col(f"{side}_bits") != 0)


def cuts(rows: DataFrame) -> DataFrame:
    """row, word and bits of the offsets where tokens of both sides end."""
    # Both sides are dealt by row already; the planner can't know how many rows an array becomes and would broadcast small files' words.
    met = ends(rows, "a").join(ends(rows, "b").hint("merge"), ["row", "word"])
    return met.select("row", "word", F.col("a_bits").bitwiseAND(F.col("b_bits")).alias("bits")).where("bits != 0")


@contextlib.contextmanager
def one_dealing(spark: SparkSession):
    """Within, tables in buckets by row are joined on row and word as they lie; by default the planner would deal both anew by all keys of a join."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: What follows an id in the text of the groups: another of its side, the other side, the next group.
_AFTER = (",", "|", ";")


@functools.cache
def _labels(top: int) -> np.ndarray:
    """The texts of all ids below `top` with each separator; a worker makes them once."""
    return np.array([f"{i}{c}".encode() for i in range(top) for c in _AFTER], object)


def grouped(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, words: np.ndarray, bits: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """Of texts' tokens (id and size) and cuts: how many groups each text has, the digest of their text, and the ids of all links.

    Both sides of a text have the same bytes, so offsets, positions and groups are counted through all texts.
    """
    upto = [np.cumsum(x >> _ID_BITS, dtype=np.int64) for x in (a, b)]
    ids = [x & (1 << _ID_BITS) - 1 for x in (a, b)]
    start = np.concatenate(([0], upto[0]))[np.concatenate(([0], np.cumsum(n_a)))]
    text = np.repeat(np.arange(len(n_words)), n_words)
    bit = np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))
    word, text = words[bit >> 6].astype(np.int64), text[bit >> 6]
    cut = start[text] + word * 64 + (bit & 63) + 1
    n_groups = np.bincount(text, minlength=len(n_words))
    last = [np.searchsorted(x, cut) for x in upto]
    size = [np.diff(x, prepend=-1) for x in last]
    label = np.empty(len(a) + len(b), np.int32)
    # A group's tokens follow those of both sides before it, a's first.
    for side, before in ((0, last[1] + 1 - size[1]), (1, last[0] + 1)):
        place = np.arange(len(ids[side])) + np.repeat(before, size[side])
        label[place] = ids[side] * len(_AFTER)
        label[place[last[side]]] += 1 + side
    known = _labels(1 << int(label.max(initial=0) // len(_AFTER)).bit_length())
    edge = np.concatenate(([0], np.cumsum(n_a + n_b))).tolist()
    digests = [hashlib.sha256(b"".join(known[label[lo:hi]].tolist())[:-1]).hexdigest() if hi > lo else "" for lo, hi in zip(edge[:-1], edge[1:], strict=True)]
    return n_groups, digests, ids[0][last[0]], ids[1][last[1]]


def align(rows: DataFrame) -> DataFrame:
    """Of `encoded` rows: doc_id, row, n_a, n_b, n_groups, groups_sha256 and links (a, b); to be run in `one_dealing`."""
    found = cuts(rows).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("cuts"))
    whole = rows.select("doc_id", "row", "a", "b").join(found.hint("merge"), "row", "left")
    whole = whole.select("doc_id", "row", "a", "b", F.coalesce("cuts", F.array().cast("array<struct<word:int,bits:bigint>>")).alias("cuts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 250):
                piece = batch.slice(lo, 250)
                lists = [piece.column(i) for i in (2, 3, 4)]
                n_a, n_b, n_words = (np.diff(x.offsets.to_numpy()).astype(np.int64) for x in lists)
                a, b = (x.flatten().to_numpy() for x in lists[:2])
                words, bits = (x.to_numpy() for x in lists[2].flatten().flatten())
                n_groups, digests, *ids = grouped(a, b, n_a, n_b, words, bits, n_words)
                links = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n_groups))).astype(np.int32)), pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in ids], names=["a", "b"]))
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), *(pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups)), pa.array(digests, pa.string()), links], names=["doc_id", "row", "n_a", "n_b", "n_groups", "groups_sha256", "links"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return whole.mapInArrow(run, f"doc_id {id_type}, row long, n_a long, n_b long, n_groups long, groups_sha256 string, links array<struct<a:int,b:int>>")


def pair_counts(links: DataFrame) -> DataFrame:
    """How many links hold each pair, and whether that is the most of its b. An id of b has at most as many rows as a has ids."""
    counted = links.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b")))


def with_counts(links: DataFrame, pairs: DataFrame, small: int = SMALL) -> DataFrame:
    """Links beside their pair's n and best."""
    known = pairs.agg(F.count(F.lit(1)).alias("pairs"), F.sum("n").alias("links")).first()
    if known["pairs"] <= small:
        return links.join(F.broadcast(pairs), ["a", "b"])
    is_hot = F.col("n") * SHARE > known["links"]
    hot = F.broadcast(pairs.where(is_hot))
    rest = links.join(hot, ["a", "b"], "left_anti").join(pairs.where(~is_hot), ["a", "b"])
    return links.join(hot, ["a", "b"]).unionByName(rest)


def alignment(docs: DataFrame, first: str, second: str, block_bytes: int = BLOCK_BYTES, small: int = SMALL) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row.

    first, second: tokenizer files, read on the driver and sent to the workers.
    """
    rows = encoded(docs, first, second, block_bytes)
    with one_dealing(docs.sparkSession):
        texts = stored(align(rows), "aligned", "zstd")
    forgotten(rows)
    links = texts.select("row", F.explode("links").alias("link")).select("row", "link.a", "link.b")
    pairs = stored(pair_counts(links), "pairs")
    sums = with_counts(links, pairs, small).groupBy("row").agg(F.count(F.lit(1)).alias("n_links"), F.count_if("best").alias("n_best"), F.sum("n").alias("count_sum"))
    out = texts.drop("links").join(sums, "row", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_links", "n_best", "count_sum")), "groups_sha256")
