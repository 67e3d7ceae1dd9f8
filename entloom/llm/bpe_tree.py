"""Byte-level BPE encoding and decoding as a tree reduction.

Encoding is a homomorphism up to a bounded repair at the seam, so a text can be
halved anywhere, its halves encoded on their own, and the results joined:

* `segments`: cuts before each single space between two characters that aren't white
  space. The pattern takes a space only as a match's first character or within a run of
  white space, so each such cut is a boundary of matches on any side context; a cut of
  a text's halves that is none is undone by joining the two segments beside it.
* `split`: the pattern's matches within a long segment. A match depends on at most `_AHEAD` characters
  after its end, so the matches of the left half that end earlier stay; from the
  first one that may change, a growing window is matched again until one of its
  sure boundaries is also a boundary of the right half. From there on both agree,
  because the pattern has no look-behind.
* `merge`: the ranks' merges within one match; one that is a token as a whole is that token. A sequence of tokens is the encoding
  of its bytes exactly if every two neighbours are the encoding of theirs. So the
  window of tokens around a seam is encoded again and grows until the two pairs at
  its own edges hold that; tokens outside can then no longer change.

Decoding joins the tokens' bytes. The pattern must be free of look-behind.

Null text counts as empty: no tokens. Repeated rows each give a row, other columns
are ignored, an empty table gives an empty table, and a text of any length is
encoded whole.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
import re
from itertools import accumulate, chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters after a match that can still change it: two of a contraction, one of the
#: look-ahead behind white space; one more in reserve.
_AHEAD = 3


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The lines of a rank file: token in base64, rank."""
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in data.splitlines() if line)}


#: A space that begins a match whatever stands around it.
_CUT = re.compile(r"(?<=\S) (?=\S)")


class _Known(dict):
    """Ids of segments seen before, each with the space that it follows. Emptied when full, so memory stays bounded."""

    def __init__(self, encode, most: int):
        super().__init__()
        self._encode, self._most = encode, most

    def __missing__(self, segment: str) -> tuple[int, ...]:
        ids = tuple(self._encode(" " + segment))
        if len(segment) <= 64:
            if len(self) >= self._most:
                self.clear()
            self[segment] = ids
        return ids


class TreeCodec:
    """Encoder and decoder for one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf_chars: int = 2048, leaf_bytes: int = 2, cache: int = 1_000_000):
        self.ranks, self.leaf_chars, self.leaf_bytes = ranks, leaf_chars, leaf_bytes
        self.tokens = {r: t for t, r in ranks.items()}
        self.digits = {r: str(r) for r in ranks.values()}
        self._find = regex.compile(pattern).findall
        self._known = _Known(self._encode_segment, cache)
        self._pairs: dict[tuple[int, int], list[int]] = {}
        self._leaves: dict[bytes, list[int]] = {}
        self._parts: dict[bytes, list[int]] = {}

    # -- segments -----------------------------------------------------------------

    def segments(self, text: str) -> list[str]:
        """The text cut before single spaces, by halves; each segment but the first lacks its space."""
        if len(text) <= self.leaf_chars:
            return _CUT.split(text)
        mid = len(text) // 2
        left, right = self.segments(text[:mid]), self.segments(text[mid:])
        # The seam may hide a cut from both halves, and is none itself: the segments beside it are cut again.
        return left[:-1] + _CUT.split(left[-1] + right[0]) + right[1:]

    # -- matches of the pattern -------------------------------------------------

    def split(self, text: str) -> list[str]:
        if len(text) <= self.leaf_chars:
            return self._find(text)
        mid = len(text) // 2
        return self.join_matches(self.split(text[:mid]), self.split(text[mid:]))

    def join_matches(self, left: list[str], right: list[str]) -> list[str]:
        """Matches of the two halves' concatenation."""
        if not left or not right:
            return left or right
        keep, open_chars = len(left), 0
        while keep and (open_chars < _AHEAD):
            keep -= 1
            open_chars += len(left[keep])
        tail, grow = "".join(left[keep:]), 4
        while True:
            taken = right[:grow]
            window = tail + "".join(taken)
            new = self._find(window)
            sure = len(window) if grow >= len(right) else len(window) - _AHEAD
            bounds = {len(tail) + n: k + 1 for k, n in enumerate(accumulate(map(len, taken)))}
            bounds[len(tail)] = 0
            at = 0
            for k, piece in enumerate(new):
                at += len(piece)
                if at > sure:
                    break
                if at in bounds:
                    return [*left[:keep], *new[: k + 1], *right[bounds[at] :]]
            if grow >= len(right):
                return [*left[:keep], *new]
            grow *= 2

    # -- merges within a match --------------------------------------------------

    def _merge_leaf(self, data: bytes) -> list[int]:
        """Merge the neighbours whose union has the lowest rank, leftmost first, until none has one."""
        if len(data) > 256:
            return self._merge_heap(data)
        get, none = self.ranks.get, 1 << 60
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [get(data[i : i + 2], none) for i in range(len(data) - 1)]
        while pairs:
            best = min(pairs)
            if best == none:
                break
            i = pairs.index(best)
            parts[i] += parts[i + 1]
            del parts[i + 1], pairs[i]
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], none)
        return [self.ranks[p] for p in parts]

    def _merge_heap(self, data: bytes) -> list[int]:
        """The same for long windows: a heap of (rank, place) over a linked list of parts."""
        get, n = self.ranks.get, len(data)
        stop, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(data[i : i + 2])) is not None]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            if (j := stop[i]) < n and (r := get(data[i : stop[j]])) is not None:
                heapq.heappush(heap, (r, i, stop[j]))

        while heap:
            _, i, end = heapq.heappop(heap)
            j = stop[i]
            if j == 0 or j >= n or stop[j] != end:  # one of the two is merged away or has grown
                continue
            stop[i], stop[j] = end, 0
            if end < n:
                before[end] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(self.ranks[data[i : stop[i]]])
            i = stop[i]
        return out

    def merge(self, data: bytes) -> list[int]:
        """Ids of one match's bytes, by halves. Short parts recur in many words and are kept."""
        if len(data) <= self.leaf_bytes:
            return self._leaf(data)
        if (found := self._parts.get(data)) is not None:
            return found
        mid = len(data) // 2
        found = self.join_tokens(self.merge(data[:mid]), self.merge(data[mid:]))
        if len(data) <= 4 * self.leaf_bytes:
            self._keep(self._parts, data, found)
        return found

    def _leaf(self, data: bytes) -> list[int]:
        if len(data) > 16:
            return self._merge_leaf(data)
        if (found := self._leaves.get(data)) is None:
            found = self._keep(self._leaves, data, self._merge_leaf(data))
        return found

    @staticmethod
    def _keep(held: dict, key, value):
        """Bounded memory: a full table is emptied."""
        if len(held) >= 200_000:
            held.clear()
        held[key] = value
        return value

    def _pair(self, a: int, b: int) -> list[int]:
        """Ids of two tokens' bytes."""
        if (found := self._pairs.get((a, b))) is None:
            found = self._keep(self._pairs, (a, b), self._merge_leaf(self.tokens[a] + self.tokens[b]))
        return found

    def _holds(self, a: int, b: int) -> bool:
        found = self._pair(a, b)
        return len(found) == 2 and found[0] == a

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of the concatenation of what two id lists of one match stand for."""
        if not left or not right:
            return left or right
        # The smallest window: the two tokens at the seam.
        window = self._pair(left[-1], right[0])
        if len(window) == 2 and window[0] == left[-1]:
            return left + right
        low = len(left) == 1 or self._holds(left[-2], window[0])
        high = len(right) == 1 or self._holds(window[-1], right[1])
        a = b = 1
        while not (low and high):
            a, b = min(len(left), a if low else 2 * a), min(len(right), b if high else 2 * b)
            window = self._leaf(self.decode(left[len(left) - a :] + right[:b]))
            low = a == len(left) or self._holds(left[-a - 1], window[0])
            high = b == len(right) or self._holds(window[-1], right[b])
        return left[: len(left) - a] + window + right[b:]

    def _encode_segment(self, segment: str) -> list[int]:
        out = []
        for piece in self.split(segment):
            data = piece.encode("utf-8")
            if (whole := self.ranks.get(data)) is not None:
                out.append(whole)
            else:
                out += self.merge(data)
        return out

    # -- texts --------------------------------------------------------------------

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        cut = self.segments(text)
        out = self._encode_segment(cut[0])
        out.extend(chain.from_iterable(map(self._known.__getitem__, cut[1:])))
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_codecs: dict[str, TreeCodec] = {}


def codec_of(data: bytes, pattern: str) -> TreeCodec:
    """One codec for each rank file and worker process."""
    key = hashlib.sha1(data).hexdigest() + pattern
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = TreeCodec(read_ranks(data), pattern)
    return _codecs[key]


def bpe_encode(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", id_col: str = "doc_id", keep_ids: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """Encode and decode every text.

    Returns the id column, the columns of `carry`, n_tokens, ids_sha256 (of the decimal ids joined by commas),
    decoded_sha256 (of the decoded bytes) and, with `keep_ids`, ids and the decoded bytes.
    No shuffle; the rank file (under 1 MB, read by the driver) goes along as a broadcast value.
    """
    spark = docs.sparkSession
    with open(rank_file, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    fields = [*(T.StructField(c, docs.schema[c].dataType) for c in (id_col, *carry)), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if keep_ids:
        fields += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())]

    def run(batches):
        codec = codec_of(shared.value, pattern)
        gc.disable()  # nothing here makes cycles, and the codec's tables are long to walk
        digits = codec.digits
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                n, sums, back, kept, raw = [], [], [], [], []
                for doc in part.column(part.num_columns - 1):
                    ids = codec.encode(doc.as_py())
                    data = codec.decode(ids)
                    n.append(len(ids))
                    sums.append(hashlib.sha256(",".join(map(digits.__getitem__, ids)).encode()).hexdigest())
                    back.append(hashlib.sha256(data).hexdigest())
                    if keep_ids:
                        kept.append(ids)
                        raw.append(data)
                cols = [*part.columns[:-1], pa.array(n, pa.int64()), pa.array(sums, pa.string()), pa.array(back, pa.string())]
                if keep_ids:
                    cols += [pa.array(kept, pa.list_(pa.int32())), pa.array(raw, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    return docs.select(id_col, *carry, F.col(text).cast("string").alias("__text")).mapInArrow(run, T.StructType(fields))
