"""Merkle manifest, token alignment and cuckoo index against plain loops."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import numpy as np
import pytest
from pyspark.sql import functions as F

from entloom.llm import cuckoo_dedup, merkle_manifest, token_alignment

from .conftest import ODD

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


# -- Merkle manifest ------------------------------------------------------------------------


def leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes, arity):
    """The root and each leaf's runs, as (before, after)."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + arity])) for i in range(0, len(last), arity)])
    proofs = []
    for i in range(len(nodes)):
        steps = []
        for level in levels[:-1]:
            start = i // arity * arity
            steps.append(("".join(level[start:i]), "".join(level[i + 1 : start + arity])))
            i //= arity
        proofs.append(steps)
    return levels[-1][0] if nodes else None, proofs


def plain_manifest(rows, arity):
    groups = defaultdict(list)
    for r in rows:
        groups[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf([r[c] for c in ("doc_id", "source", "lang", "n_chars", "text")]), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])], arity) for g in order}
    root, upper = plain_tree([trees[g][0] for g in order], arity)
    for k, g in enumerate(order):
        for (*_, h, r), own in zip(sorted(groups[g], key=lambda x: x[:3]), trees[g][1], strict=True):
            steps, change = [*own, *upper[k]], r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None
            at = leaf([r["doc_id"], r["source"], r["lang"], r["n_chars"] + 1, r["text"]]) if change else h
            for before, after in steps:
                at = sha(before + at + after)
            yield (r["doc_id"], h, trees[g][0], root, sha("".join(b + a for b, a in steps)), at, at == root)


def checked(docs, arity):
    where = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    rows = merkle_manifest.manifest(docs, arity=arity, changed=(where, {"n_chars": F.col("n_chars") + 1}))
    return sorted(map(tuple, merkle_manifest.verified(rows).collect()), key=str)


@pytest.mark.parametrize("arity", [2, 3, 16])
def test_manifest_equals_a_plain_tree(make_docs, arity):
    rng = random.Random(arity)
    rows = [(i, f"text {rng.random()}", ("de", "fr")[i % 7 == 0], f"s{i % 3}") for i in range(1, 700)]
    rows += [(i, t, None, None) for i, t in ODD] + [(9000, "alone", "é", None), (9001, None, "zz", "s"), (5, "two words", "de", "s1"), (5, "two words", "de", "s1")]
    docs = make_docs(rows)
    want = sorted(plain_manifest([r.asDict() for r in docs.collect()], arity), key=str)
    assert checked(docs, arity) == want
    assert sum(not w[-1] for w in want) > 50


def test_manifest_of_few_rows(make_docs):
    for rows in ([], [(1, "one")], [(1, "one"), (2, "two")], [(None, None, None, None)] * 3):
        docs = make_docs(rows)
        assert checked(docs, 2) == sorted(plain_manifest([r.asDict() for r in docs.collect()], 2), key=str)


def test_sizes_around_a_block(make_docs):
    for n in (255, 256, 257, 513):
        docs = make_docs([(i, f"t{i}") for i in range(n)])
        assert checked(docs, 2) == sorted(plain_manifest([r.asDict() for r in docs.collect()], 2), key=str)


def test_a_long_text_and_an_unknown_group(make_docs):
    docs = make_docs([(1, "x" * 3_000_000, "en", "s"), (2, "", "en", "s")]).withColumn("g", F.lit(1))
    assert checked(docs, 2) == sorted(plain_manifest([r.asDict() for r in docs.collect()], 2), key=str)


# -- token alignment ------------------------------------------------------------------------------


def plain_alignment(texts):
    one, two = (token_alignment.tokenizer_of(open(p, "rb").read()) for p in (A, B))
    found = []
    for text in texts:
        ids = [list(t.encode([text])[0]) if text else [] for t in (one, two)]
        if any(b"".join(t.bytes_of[i] for i in x) != b" " + (text or "").encode() for t, x in zip((one, two), ids, strict=True)):
            ids = [[], []]
        at = [list(itertools.accumulate(len(t.bytes_of[i]) for i in x)) for t, x in zip((one, two), ids, strict=True)]
        links = [(a, b) for a, e in zip(ids[0], at[0], strict=True) for b, f in zip(ids[1], at[1], strict=True) if e == f]
        cuts = sorted(set(at[0]) & set(at[1]))
        groups = ["|".join(",".join(str(i) for i, e in zip(x, ends, strict=True) if lo < e <= hi) for x, ends in zip(ids, at, strict=True)) for lo, hi in zip([0, *cuts], cuts, strict=False)]
        found.append((ids, links, groups))
    count = Counter(link for _, links, _ in found for link in links)
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    for ids, links, groups in found:
        yield (len(ids[0]), len(ids[1]), len(groups), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), sha(";".join(groups)) if ids[0] else "")


ALIGNED = [*(t for _, t in ODD), " leading", "trailing ", "  two  spaces\n\nlines\t", "▁ is a space in pieces", "<|endoftext|> <s> </s> <unk>", "naïve café 日本語 \U0001f600‍", "a\u0000b", "ﬁ ligature", "<0x41>", "The quick brown fox; the quick brown fox."]


def test_alignment_equals_a_plain_loop(make_docs):
    rng = random.Random(4)
    texts = ALIGNED + [" ".join(rng.choice(["token", "Tokenizer", "alignment", "über", "3.14159", "fox", "the", "of"]) for _ in range(rng.randrange(60))) for _ in range(40)]
    docs = make_docs([(i, t) for i, t in enumerate(texts)])
    want = [(i, *x) for i, x in enumerate(plain_alignment(texts))]
    for more in ({}, {"block_bytes": 500, "small": 1}):
        got = sorted(map(tuple, token_alignment.alignment(docs, A, B, **more).collect()))
        assert got == want
    assert token_alignment.alignment(make_docs([]), A, B).count() == 0


def test_ids_by_rank_are_the_library_s():
    """The byte-level side takes the quick way where it is proven to agree, and the ids are the library's for letters of all kinds, long runs and white space."""
    with open(A, "rb") as f:
        tokenizer = token_alignment.ByteLevel(f.read())
    assert tokenizer.quick is not None and tokenizer.lossless
    rng = random.Random(11)
    letters = ["a", "the", "'s", "'", " ", "  ", "\n", "\t ", "\x85", "\x1c", "\u3000", "\u200b", "\u0301", "é", "日本", "²", "7", "!?", "_", "<|endoftext|>", "\U0001f600"]
    texts = ["".join(rng.choices(letters, k=rng.randint(1, 15))) for _ in range(2000)]
    texts += ["a1!b ".replace("!", chr(i)) + chr(i) + "1" for i in [*range(1, 0x3100), *range(0xA700, 0xAC00)]] + ["q" * 3000, " " * 3000 + "x", "ab " * 2000]
    want = [e.ids for e in tokenizer.tokenizer.encode_batch([" " + t for t in texts], add_special_tokens=False)]
    assert tokenizer.encode(texts) == want


def test_words_are_encoded_once_and_as_whole_texts_are():
    rng = np.random.default_rng(5)
    letters = list(" \n\tab'sé1中 \u3000\u2581<>😀\x00\x1c")
    texts = ["".join(rng.choice(letters, n)) for n in rng.integers(0, 30, 400)] + ["a  b", " a", "a ", "x\n \ny", "x\n y", "it's 'tis <s>", "<unk> \u2581", "b" * 700 + " c", "plain words, plain words"]
    raw = [x.encode() for x in texts] + [None, b"\xff a"]
    pair = token_alignment.Pair(*(open(p, "rb").read() for p in (A, B)))
    assert pair.by_words and any(pair._from_words(texts[-1:])[0])
    for _ in range(2):
        for got, encoder in zip(pair.encode(raw), pair.encoders, strict=True):
            assert all(np.array_equal(x, y) for x, y in zip(got, encoder.encode(raw), strict=True))
    assert [len(x) for x in pair.encode([])[0]] == [0, 0]
    assert len({"plain", "words,", "words"} & pair.known.keys()) == 3


def test_alignment_of_repeated_rows_and_null_ids(odd_docs):
    texts = [t for _, t in ODD]
    want = sorted(((i, *x) for (i, _), x in zip(ODD, plain_alignment(texts), strict=True)), key=str)
    assert sorted(map(tuple, token_alignment.alignment(odd_docs, A, B).collect()), key=str) == want


def test_alignment_of_a_long_text(make_docs):
    text = " ".join(f"word{i % 977} naïve" for i in range(60_000))
    got = token_alignment.alignment(make_docs([(1, text)]), A, B).first()
    one, two = (token_alignment.tokenizer_of(open(p, "rb").read()) for p in (A, B))
    ids = [t.encode([text])[0] for t in (one, two)]
    at = [set(itertools.accumulate(len(t.bytes_of[i]) for i in x)) for t, x in zip((one, two), ids, strict=True)]
    assert (got["n_a"], got["n_b"], got["n_groups"], got["n_links"]) == (len(ids[0]), len(ids[1]), len(at[0] & at[1]), len(at[0] & at[1]))


def test_alignment_shuffles_no_tokens(spark, make_docs):
    """Windows, join and aggregation follow the buckets."""
    rows = token_alignment.encoded(make_docs([(1, "a b"), (2, "c")]), A, B, 100)
    with token_alignment.one_dealing(spark):
        plan = token_alignment.align(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("SortMergeJoin") == 2
    token_alignment.forgotten(rows)


def test_alignment_sorts_words_of_bits_not_tokens(spark, make_docs):
    """What is laid out, sorted and joined are words of 64 bytes of text: no window, and no more rows than words."""
    text = "the quick brown fox " * 100
    rows = token_alignment.encoded(make_docs([(1, text), (2, None), (3, "x")]), A, B, 1000)
    with token_alignment.one_dealing(spark):
        plan = token_alignment.align(rows)._jdf.queryExecution().executedPlan().toString()
        found = token_alignment.cuts(rows).collect()
    assert "Window" not in plan
    assert len(found) <= len(text) // 64 + 2 and sum(bin(r["bits"] & (1 << 64) - 1).count("1") for r in found) > 300
    token_alignment.forgotten(rows)


# -- cuckoo index ------------------------------------------------------------------------------------


def test_filter_inserts_deletes_and_fills():
    rng = random.Random(3)
    f, keys = cuckoo_dedup.CuckooFilter(64), [rng.getrandbits(64) for _ in range(230)]
    assert all(f.insert(k) for k in keys) and f.live == 230  # nine in ten slots
    assert all(k in f for k in keys)
    assert all(f.delete(k) for k in keys[:100]) and f.live == 130
    assert all(k in f for k in keys[100:]) and sum(k in f for k in keys[:100]) < 3
    assert not all(f.insert(rng.getrandbits(64)) for _ in range(300))
    with pytest.raises(ValueError):
        cuckoo_dedup.CuckooFilter(100)


def test_shard_resizes_and_verifies():
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(9000)]
    shard = cuckoo_dedup.Shard()
    for i, d in enumerate(digests):
        shard.add(d, 1, 1, i, 0, i)
    assert shard.resized >= 2 and len(list(shard.records())) == shard.filter.live == 9000
    twin = digests[0][:8] + digests[0][8:16] + bytes(16)  # the same key, so a hit, but another text
    shard.add(twin, 1, 1, 7, 0, 7)
    assert shard.false_hits >= 1 and shard.known(twin, 1)[3] == 7 and shard.known(digests[0], 1)[3] == 0
    shard.remove(digests[0], 1, 0)
    assert shard.known(digests[0], 1) is None and shard.known(twin, 1) and all(shard.known(d, 1) for d in digests[1:])
    shard.remove(digests[0], 1, 0)  # not live: ignored
    assert shard.filter.live == 9000


def plain_dedup(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    for t, ids in groups.items():
        keep = max(ids, key=lambda i: (i is not None, i or 0))
        at = ids.index(keep)
        yield from ((i, keep, len(ids), k == at, sha(t)) for k, i in enumerate(ids))


def test_dedup_equals_a_plain_loop(make_docs):
    rng = random.Random(6)
    rows = [(i, rng.choice(["hot", f"text {rng.randrange(300)}"])) for i in range(3000)] + [*ODD, (None, "null id here"), (9999, "y" * 2_000_000), (9998, "y" * 2_000_000)]
    for shards in (1, 7):
        got = sorted(map(tuple, cuckoo_dedup.dedup(make_docs(rows).repartition(9), shards).collect()), key=str)
        assert got == sorted(plain_dedup(rows), key=str)
    assert cuckoo_dedup.dedup(make_docs([])).count() == 0


def test_index_over_batches(spark, make_docs):
    """Two batches in, some rows out, one batch in: the groups are those of what is live."""
    rng = random.Random(9)
    one = [(i, f"t{rng.randrange(60)}") for i in range(200)]
    two = [(i, f"t{rng.randrange(80)}") for i in range(200, 400)]
    index = cuckoo_dedup.CuckooIndex(spark, 3)
    index.insert(make_docs(one))
    index.insert(make_docs(two))
    gone = [r for r in one + two if r[0] % 3 == 0 or r[1] == "t7"]
    index.delete(make_docs([*gone, (5000, "t1"), (1, "never was")]))
    three = [(i, f"t{rng.randrange(90)}") for i in range(400, 450)] + [(450, "t7")]
    index.insert(make_docs(three))
    live = [r for r in one + two + three if r not in set(gone)]
    want = {(sha(t), i, n) for _, i, n, kept, _, t in ((*x, t) for x in plain_dedup(live) for t in [next(t for j, t in live if j == x[0])]) if kept}
    got = {(r["digest"].hex(), r["kept_id"], r["rows"]) for r in index.groups().collect()}
    assert got == want
    assert index.filters().agg(F.sum("live")).first()[0] == len(want)
