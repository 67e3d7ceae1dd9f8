"""The n-gram join, passage search, language model and the pipeline against brute force."""

import collections
import math
import bisect
import itertools
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from entloom.llm import common
from entloom.llm import compact_windows as cw
from entloom.llm import context_mixing as cm
from entloom.llm import trie_join as tj
from entloom.llm.components import components
from tests.llm.conftest import ODD

RNG = random.Random(11)
WORDS = [f"v{i}" for i in range(400)]


def prose(n):
    return [RNG.choice(WORDS) for _ in range(n)]


def edited(words, n):
    words = list(words)
    for _ in range(n):
        words[RNG.randrange(len(words))] = RNG.choice(WORDS)
    return words


# -- n-gram join ------------------------------------------------------------------------


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def linked_roots(sets, num, den):
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30), min_size=1, max_size=25), min_size=1, max_size=25), st.sampled_from([(9, 10), (4, 5), (1, 2)]))
def test_trie_equals_all_pairs(sets, t):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    join = tj.TrieJoin(arrays, tj.Threshold(*t))
    roots = linked_roots([frozenset(s) for s in sets], *t)
    same = lambda r: {(i, j) for i in range(len(r)) for j in range(i) if r[i] == r[j]}
    assert same([join.find(i) for i in range(len(sets))]) == same(roots)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 300), st.integers(0, 40), st.integers(0, 40), st.integers(0, 1 << 30), st.sampled_from([(9, 10), (4, 5)]))
def test_linked_sets_share_a_signature(n, more, less, seed, ratio):
    t = tj.Threshold(*ratio)
    classes = t.classes(1000)
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, n).astype(np.uint64)
    b = np.concatenate((a[min(less, n - 1) :], rng.integers(0, 1 << 63, more).astype(np.uint64)))
    a, b = np.unique(a), np.unique(b)
    if ratio[1] * len(np.intersect1d(a, b)) >= ratio[0] * len(np.union1d(a, b)):
        assert np.intersect1d(tj.signatures(a, t, classes), tj.signatures(b, t, classes)).size
    # The sketches of a class in which both meet never differ in more cells than the sets in n-grams.
    differ = len(np.setxor1d(a, b))
    ka, kb = (bisect.bisect_right(classes, len(x)) - 1 for x in (a, b))
    for i, x in enumerate(tj.sketches(a, classes)):
        for j, y in enumerate(tj.sketches(b, classes)):
            if ka + i == kb + j:
                assert int(np.bitwise_count((x ^ y).view(np.uint64)).sum()) <= differ


@pytest.mark.parametrize("size", [300, 1200, 5000, 8000])
def test_long_sets_of_nothing_in_common_do_not_meet(size):
    """Parts that are empty by chance make no candidates, and the sketches of long sets tell them apart."""
    t = tj.Threshold(4, 5)
    classes = t.classes(20_000)
    rng = np.random.default_rng(size)
    sets = [np.unique(rng.integers(0, 1 << 63, size + i).astype(np.uint64)) for i in range(30)]
    seen = np.concatenate([np.unique(tj.signatures(s, t, classes)) for s in sets])
    assert len(np.unique(seen)) > 0.999 * len(seen)
    sketches = [tj.sketches(s, classes)[0] for s in sets if bisect.bisect_right(classes, len(s)) == bisect.bisect_right(classes, size)]
    far = [int(np.bitwise_count((x ^ y).view(np.uint64)).sum()) for x, y in itertools.pairwise(sketches)]
    assert min(far, default=1 << 30) > t.differ(2 * size + 60)


@pytest.mark.parametrize("chunk, group, n, num, den", [(256, 2048, 3, 9, 10), (4, 3, 3, 9, 10), (5, 4, 5, 4, 5), (256, 2048, 5, 4, 5)])
def test_components_of_documents(make_docs, chunk, group, n, num, den):
    rows = []
    for g in range(12):
        base = prose(RNG.randint(20, 200))
        rows += [(100 * g + k, " ".join(edited(base, RNG.randint(0, 6))).upper()) for k in range(RNG.randint(1, 14))]
    rows += ODD
    docs = make_docs(rows)
    got = tj.jaccard_components(docs, chunk=chunk, group=group, bin_sets=16, n=n, num=num, den=den).collect()
    sets = [shingles(t, n) for _, t in rows]
    roots = linked_roots(sets, num, den)
    least = {}
    for (i, _), r in zip(rows, roots, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    want = [(i, len(s), i if not s else least.get(r)) for (i, _), s, r in zip(rows, sets, roots, strict=True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    stay = tj.one_of_each(docs, chunk=chunk, group=group, n=n, num=num, den=den).collect()
    empties = sum(not s for s in sets)
    assert len(stay) == len({r for r, s in zip(roots, sets, strict=True) if s}) + empties


def test_long_sets_leave_a_tree_early():
    """Sets that share nothing are given up within a step, so 600 long ones take time by what a miss costs, not by all they hold."""
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 62, 3000).astype(np.uint64)) for _ in range(600)]
    near = sets[7].copy()
    near[::25] += np.uint64(1)
    sets.append(np.unique(near))
    looked = 0

    class Counted(set):
        def __contains__(self, x):
            nonlocal looked
            looked += 1
            return set.__contains__(self, x)

    tj.set = Counted
    try:
        links = tj.TrieJoin(sets, tj.Threshold(9, 10)).links
    finally:
        del tj.set
    assert [sorted(x) for x in links] == [[7, 600]]
    assert looked < 0.15 * 3000 * 600 * 601 / 2


def test_trees_are_bounded_by_grams(make_docs):
    """A group of long near copies is dealt into trees by its n-grams; the components stay those of all pairs."""
    base = prose(4000)
    rows = [(k, " ".join([*base[:-k], *(f"x{k}y{i}" for i in range(k))])) for k in range(1, 41)]
    rows += [(100 + k, " ".join(prose(3000))) for k in range(20)]
    got = {r["doc_id"]: r["component_id"] for r in tj.jaccard_components(make_docs(rows), n=5, num=4, den=5, bin_grams=10_000).collect()}
    assert got == {i: 1 if i < 100 else i for i, _ in rows}


def test_a_filter_is_as_small_as_its_table(spark):
    sigs = [(int(x),) for x in np.random.default_rng(3).integers(-(1 << 62), 1 << 62, 3000)]
    shared = tj.live_filter(spark.createDataFrame(sigs, "sig long"))
    assert shared.value.nbytes <= 16_384
    assert tj.is_live(shared.value, np.array(sigs).ravel()).all()
    assert tj.is_live(shared.value, np.arange(0, 20_000, 2) << 40).mean() < 0.2


def test_signatures_are_counted_without_their_sets(spark, monkeypatch):
    """Signatures of one set, copies of it included, are not shared; what is counted brings no set along, and only the result stays stored."""
    sets = {1: [10, 20, 30], 2: [20, 41], 3: [30, 41, 20], 4: [50, 60], 5: [70]}
    rows = [(c, s) for c, s in sets.items()] + [(4, sets[4])] * 3 + [(None, [])]
    scanned = spark.createDataFrame(rows, "cls long, sigs array<long>")
    held, made, plain = {}, len(common._made), tj.stored
    monkeypatch.setattr(tj, "stored", lambda df, name: held.setdefault(name, df) and plain(df, name))
    got = tj._shared(scanned)
    owners = {x: sorted(c for c, s in sets.items() if x in s) for s in sets.values() for x in s}
    assert sorted(map(tuple, got.collect())) == sorted((x, c, cs[0]) for x, cs in owners.items() if len(cs) > 1 for c in cs)
    assert len(common._made) == made + 1
    assert all("cls" not in o for o in re.findall(r"HashAggregate\(.*", held["often"]._jdf.queryExecution().optimizedPlan().toString() + held["often"]._jdf.queryExecution().executedPlan().toString()))
    tj.released(got)


def test_join_of_nothing(make_docs):
    assert tj.jaccard_components(make_docs([])).count() == 0
    assert tj.jaccard_components(make_docs([(1, None)])).first()["component_id"] == 1


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert all(got[i] == 0 for i in range(1, 201)) and got[501] == 500


# -- passages ---------------------------------------------------------------------------------


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=60), st.integers(1, 8))
def test_windows_hold_every_subsequence(h, width):
    h = np.array(h, np.uint64)
    nodes = cw.compact_windows(h, width)
    for i in range(len(h)):
        for j in range(i + width - 1, len(h)):
            inside = [n for n in nodes if n[0] <= i <= n[1] <= j <= n[2]]
            assert len(inside) == 1 and h[inside[0][1]] == h[i : j + 1].min()


def test_repeated_hashes_stay_fast():
    """A text of one repeated shingle: the tree stays shallow, and every window's hash is the least of it."""
    h = np.full(300_000, 7, np.uint64)
    h[::1000] = 3
    began = time.time()
    nodes = cw.compact_windows(h, 46)
    assert time.time() - began < 20
    assert all(h[l : r + 1].min() == h[c] and l <= c <= r and r - l >= 45 for l, c, r in nodes[::997].tolist())


def test_dense_runs():
    hit = np.array([0] * 5 + [1] * 10 + [0] + [1] * 10 + [0] * 20 + [1] * 9 + [0] * 3, bool)
    assert sorted(cw.dense_runs(hit, 0.9, 8)) == [(5, 26), (46, 55)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.booleans(), max_size=70), st.lists(st.integers(0, 69), max_size=4), st.integers(1, 30), st.sampled_from([0.5, 0.8, 8 / 9]))
def test_dense_runs_find_the_longest(hit, more, width, share):
    for m in more:  # long stretches of hits
        hit[m:m] = [True] * 12
    hit = np.array(hit, bool)
    runs = [(a, b) for a in range(len(hit)) for b in range(a + width, len(hit) + 1) if hit[a:b].sum() >= share * (b - a) - 1e-9]
    got = cw.dense_runs(hit, share, width)
    assert bool(got) == bool(runs) and set(got) <= set(runs)
    assert all(b <= c for (_, b), (c, _) in zip(sorted(got), sorted(got)[1:]))
    if runs:  # but for misses at its ends
        longest = max(b - a for a, b in runs)
        assert any(b - a == longest and x >= a and y <= b and not hit[a:x].any() and not hit[y:b].any() for a, b in runs for x, y in got)


@pytest.mark.parametrize("seed", range(40))
def test_edited_passages_verify(seed):
    """Passages of 50 to 100 words with one or two words changed, put in or left out, against all pairs of runs."""
    rng = random.Random(seed)
    shingle = lambda w: np.array([zlib.crc32(" ".join(w[i : i + 5]).encode()) for i in range(len(w) - 4)], np.uint32)
    word = lambda: f"r{rng.randrange(10**9)}"
    passage = [word() for _ in range(rng.randint(50, 100))]
    other = list(passage)
    for _ in range(rng.randint(1, 2)):
        at = rng.randrange(len(other))
        other[at : at + rng.randint(0, 1)] = [word()] * rng.randint(0, 1)
    a, b = (shingle([word() for _ in range(20)] + w + [word() for _ in range(20)]) for w in (passage, other))
    place = {s: j for j, s in enumerate(b.tolist())}
    at = [place.get(s) for s in a.tolist()]
    hit = np.array([j is not None for j in at])
    best = 0.0
    for x in np.flatnonzero(hit).tolist():  # all runs of a between two hits, and b's run between their places
        for y in np.flatnonzero(hit).tolist():
            if y - x >= 45 and at[y] - at[x] >= 45:
                both = len(np.intersect1d(a[x : y + 1], b[at[x] : at[y] + 1]))
                n, m = y - x + 1, at[y] - at[x] + 1
                if both >= 8 / 9 * n and both >= 8 / 9 * m:
                    best = max(best, both / (n + m - both))
    got = cw.verify(a, b, 0.8, 46)
    assert all(like >= 0.8 and y - x >= 46 and v - u >= 46 for x, y, u, v, like in got)
    assert got or best < 0.8


def test_a_change_in_the_middle_of_a_short_passage():
    a = np.arange(100, 166, dtype=np.uint32)  # 70 words
    b = a.copy()
    b[30:35] = np.arange(5)
    assert cw.verify(a, b, 0.8, 46) == [(0, 66, 0, 66, 61 / 71)]


def test_passages(make_docs):
    passage, other = prose(60), prose(50)
    rows = [(i, " ".join(prose(RNG.randint(60, 200)))) for i in range(30)]
    for i in (3, 8, 21):
        rows[i] = (i, " ".join(prose(40) + passage + prose(30)))
    for i in (5, 9):
        rows[i] = (i, " ".join(prose(20) + other + prose(20)).upper())
    long = prose(150)
    rows += [(40, " ".join(prose(30) + long)), (41, " ".join(edited(long, 2))), (50, rows[0][1]), *((None if i is None else 500 + i, t) for i, t in ODD if i != 8)]
    docs = make_docs(rows)
    got = cw.find_passages(docs).collect()
    spans = collections.defaultdict(list)
    for r in got:
        assert r["stop"] - r["first"] >= 50 and r["similarity"] >= 0.8
        spans[r["doc_id"]].append((r["first"], r["stop"]))
    for i in (8, 21):
        assert any(a <= 40 and b >= 100 for a, b in spans[i])
    assert any(a <= 20 and b >= 70 for a, b in spans[9])
    assert spans[50] == [(0, len(rows[0][1].split()))] and spans[41]
    assert set(spans) == {8, 21, 9, 41, 50}
    cut = {r["doc_id"]: r for r in cw.cut_passages(docs).collect() if r["doc_id"] is not None}
    assert 50 not in cut and " ".join(passage) not in cut[21]["text"] and " ".join(passage) in cut[3]["text"]
    assert cut[21]["n_chars"] == len(cut[21]["text"]) and cut[1]["text"] == rows[1][1]
    assert cw.cut_passages(docs).columns == docs.columns


def test_all_of_a_group_are_tried(make_docs):
    """Variants that are near the original but not near each other, the original neither hub nor predecessor; and passages around a frequent line."""
    rng = random.Random(3)
    word = lambda: f"g{rng.randrange(10**9)}"
    base, line = [word() for _ in range(120)], [word() for _ in range(12)]
    rows = [(50, " ".join(base))]
    for v, i in enumerate((10, *range(100, 120))):  # each has one word changed in a place of its own: near the original
        mine = list(base)
        for at in (8 + 5 * v, (8 + 5 * v + 55) % 116):
            mine[at] = word()
        rows.append((i, " ".join(mine)))
    for i in range(200, 260):  # the line stands in unrelated texts
        rows.append((i, " ".join([word() for _ in range(30)] + line + [word() for _ in range(30)])))
    around = [word() for _ in range(22)] + line + [word() for _ in range(22)]
    rows += [(i, " ".join([word() for _ in range(20)] + around + [word() for _ in range(20)])) for i in (215000, 235000)]
    rows += [(i, " ".join([word() for _ in range(30)] + line + [word() for _ in range(30)])) for i in range(220000, 220020)]
    gram = lambda t: np.array([zlib.crc32(" ".join(t.split()[k : k + 5]).encode()) for k in range(len(t.split()) - 4)], np.uint32)
    grams = {i: gram(t) for i, t in rows}
    want = {i for i in grams for j in grams if j < i and cw.verify(grams[i], grams[j], 0.8, 46)}
    for chunk in (2048, 8):
        got = cw.find_passages(make_docs(rows), chunk=chunk).collect()
        assert {r["doc_id"] for r in got} == want and {235000, *range(100, 120)} <= want


def test_the_next_best_are_tried(make_docs):
    """The earlier window that agrees best beside the place is in no passage; the one that agrees less well is."""
    rng = random.Random(11)
    words = lambda n: [f"k{rng.randrange(10**9)}" for _ in range(n)]
    line = words(44)  # no passage by itself
    rows = [(i, " ".join(words(30) + line + words(30))) for i in range(30)]
    long = words(6) + line + words(6)
    near = list(long)
    near[20] = words(1)[0]
    rows += [(100, " ".join(words(30) + near + words(30))), (200, " ".join(words(30) + long + words(30)))]
    for chunk in (2048, 8):
        assert {(r["doc_id"], r["other_doc_id"]) for r in cw.find_passages(make_docs(rows), chunk=chunk).collect()} == {(200, 100)}


def test_recall_of_planted_passages(make_docs):
    """Of each kind 150 passages in two texts each: exact, one changed word in 55 or 60, two in 100, three in 150. No text without one is found."""
    rng = random.Random(12)
    words = lambda n: [f"p{rng.randrange(10**9)}" for _ in range(n)]
    rows, kind_of, at = [(i, " ".join(words(120))) for i in range(300)], {}, 1000
    for kind in ((60, 0), (55, 1), (60, 1), (100, 2), (150, 3)):
        for _ in range(150):
            passage = words(kind[0])
            other = list(passage)
            for place in rng.sample(range(kind[0]), kind[1]):
                other[place] = words(1)[0]
            rows += [(at, " ".join(words(40) + passage + words(40))), (at + 1, " ".join(words(30) + other + words(50)))]
            kind_of[at + 1], at = kind, at + 2
    found = {r["doc_id"]: r["other_doc_id"] for r in cw.find_passages(make_docs(rows)).collect()}
    assert all(i in kind_of and j == i - 1 for i, j in found.items())
    share = {k: sum(kind_of[i] == k for i in found) / 150 for k in kind_of.values()}
    least = {(60, 0): 1, (55, 1): 0.9, (60, 1): 0.93, (100, 2): 0.93, (150, 3): 0.93}
    assert all(share[k] >= v for k, v in least.items()), share


def test_a_passage_of_two_frequent_lines(make_docs):
    """Texts with one of the lines are hub and predecessor of nearly every signature; two texts have both lines."""
    rng = random.Random(5)
    words = lambda n: [f"h{rng.randrange(10**9)}" for _ in range(n)]
    lines = [words(30), words(30)]
    rows = [(i, " ".join(words(12) + lines[i % 2] + words(12))) for i in (*range(80), *range(200, 280))]
    rows += [(i, " ".join(words(20) + lines[0] + lines[1] + words(20))) for i in (100, 300)]
    got = cw.find_passages(make_docs(rows)).collect()
    assert {(r["doc_id"], r["other_doc_id"]) for r in got} == {(300, 100)}


def test_repeated_ids_are_documents_of_their_own(make_docs):
    a, b = " ".join(prose(80)), " ".join(prose(80))
    docs = make_docs([(1, a), (2, b), (2, a), (2, b), (None, a)])
    cut = cw.cut_passages(docs).collect()
    assert sorted((r["doc_id"], r["text"]) for r in cut if r["text"]) == [(1, a), (2, b), (2, b)] or sorted((r["doc_id"], r["text"]) for r in cut) == [(1, a), (2, b)]
    assert cw.find_passages(make_docs([])).count() == 0


# -- language model ----------------------------------------------------------------------------------


def test_codes_are_prefix_free():
    paths = cm.huffman(np.array([5, 1, 0, 100] + [0] * 252))
    assert sum(2.0 ** -len(p) for p in paths) == pytest.approx(1)
    assert len(paths[3]) == min(map(len, paths))


def test_next_bytes_sum_to_one():
    """The model's probabilities of all ways to go on after a prefix sum to 1."""
    counts = collections.Counter({b"abc": 5, b"abd": 2, b"x": 9, cm.END: 3})
    byte_counts = np.zeros(256)
    for t, n in counts.items():
        byte_counts += n * np.bincount(np.frombuffer(b"\0" if t == cm.END else t + b" ", np.uint8), minlength=256)
    code = cm.Code(byte_counts)
    tokens = list(counts)
    ev = cm.Events(tokens, code)
    tables = [np.zeros((1 << b, 2), np.float32) for b in cm.TABLE_BITS]
    for t, s in zip(tables, ev.slots, strict=True):
        np.add.at(t, (s, ev.bit), 3)
    # Spell every next byte after "ab": the bits of a token "ab?" without its blank.
    logs = []
    for b in range(256):
        if b in (0x20, *range(9, 14), 0):
            spelled = [b"ab"]
        else:
            spelled = [b"ab" + bytes([b])]
        ev = cm.Events(spelled, code)
        x, gate = cm.Lookup(tables).inputs(ev)
        bits = cm.Mixer().log2(x, gate, ev.bit)
        lo = code.length[ord("a")] + code.length[ord("b")]
        length = code.length[b] if len(spelled[0]) == 3 else code.length[0x20]
        if len(spelled[0]) == 3 or b == 0x20:
            logs.append(bits[lo : lo + length].sum())
    skipped = [b for b in (*range(9, 14), 0)]  # these bytes never stand in a word; their share is what is missing
    assert 0.9 < sum(2.0**v for v in logs) <= 1 + 1e-9 and len(skipped) == 6


def plain_bits(texts, train, which, decider):
    """One text's decisions and choices bit by bit, from dictionaries of counts; spelled tokens cost nothing here."""
    tokens = [[*t.lower().split(), cm.END] for t in texts]
    after, single, n = collections.Counter(), collections.Counter(), 0
    pairs = lambda ts: [((ts[i - 2] if i > 1 else None, ts[i - 1] if i else None), t) for i, t in enumerate(ts)]
    for j, ts in enumerate(tokens):
        if train[j] and j != which:
            after.update(pairs(ts))
            single.update(ts)
            n += len(ts)
    weights, seen = decider.weights.copy(), np.zeros(decider.seen.shape)
    level = lambda x: min(cm.SEEN_LEVELS - 1, int(math.log2(x + 1)))

    def slot(tag, *parts):
        h = np.full(1, tag, np.uint64)
        for x in parts:
            with np.errstate(over="ignore"):
                h = cm.mix64(h * cm._M + np.uint64(x) + np.uint64(1))
        return int(h[0] >> np.uint64(64 - cm.SLOT_BITS))

    total, done, past, run, odd, waiting = 0.0, 0, [], 0, 0, []
    rest = dict(single)
    for i, (context, t) in enumerate(pairs(tokens[which])):
        told = {w: c for (k, w), c in after.items() if k == context and c > 0}
        n_now, d_now, key_now = sum(told.values()), max(1, len(told)), told.get(t, 0)
        token_now, prev = single[t], int(cm._START) if i == 0 else xxhash.xxh3_64_intdigest(tokens[which][i - 1])
        common = level(rest.get(tokens[which][i - 1], 0) if i else 0)
        hit, known = key_now > 0, key_now == 0 and token_now > 0
        h = [past[-k] if len(past) >= k else 3 for k in (1, 2, 3)]
        history, share, asked = h[0] * 4 + h[1], min(7, 16 * odd // max(1, i)), int(n_now > 0)
        if asked:
            waiting.append((level(n_now), int(hit), [slot(1, level(n_now), level(d_now), min(n_now - d_now, 3) + 1), slot(2, level(n_now), history, h[2]), slot(3, prev), slot(4, common, level(d_now), min(15, run))]))
        if not hit:
            waiting.append((cm.SEEN_LEVELS + history, int(known), [slot(5, history, h[2]), slot(6, prev), slot(7, asked, level(n_now), share), slot(8, level(i), share)]))
        total -= math.log2(key_now / n_now) if hit else math.log2(token_now / (n + i)) if known else 0
        outcome = 0 if hit else 1 if known else 2
        past.append(outcome)
        run, odd = (run + 1 if hit else 0), odd + (outcome == 2)
        after[context, t] += 1
        single[t] += 1
    for lo in range(0, len(waiting), cm.CHUNK):
        steps = []
        for gate, bit, slots in waiting[lo : lo + cm.CHUNK]:
            x = [math.log((decider.tables[k][s][1] + 0.4) / (decider.tables[k][s][0] + 0.4)) for k, s in enumerate(slots)] + [1.0]
            z = max(-12.0, min(12.0, sum(a * b for a, b in zip(x, weights[gate], strict=True))))
            p = 1 / (1 + math.exp(-z))
            cell = min(cm.MAP_CELLS - 1, max(0, int(z + 12)))
            there, here = decider.seen[gate, cell], seen[gate, cell]
            scale = 32 / max(32, there.sum())
            refined = (there[1] * scale + here[1] + 16 * p) / (there.sum() * scale + here.sum() + 16)
            p2 = min(1 - 1e-6, max(1e-6, 0.5 * p + 0.5 * refined))
            total -= math.log2(p2 if bit else 1 - p2)
            steps.append((gate, cell, bit, p, x))
        for gate, cell, bit, p, x in steps:
            weights[gate] += 0.02 * (bit - p) * np.array(x)
            seen[gate, cell, bit] += 1
    return total


def test_score_equals_a_plain_loop():
    rng = random.Random(2)
    line = [f"w{rng.randrange(40)}" for _ in range(30)]
    texts = [" ".join(rng.choice([line, line[5:20], [f"w{rng.randrange(60)}" for _ in range(25)]]) + [f"w{rng.randrange(300)}" for _ in range(rng.randrange(60))]).encode() for _ in range(14)]
    texts += [texts[0], b"", b"a a a a a a b a a a", texts[3] + b" " + texts[3]]
    train, shards = np.array([i % 4 != 1 for i in range(len(texts))]), 3
    told, n = [], 0
    asked = [dict(zip([c.split()[0] for c in cm.ASKED.split(", ")], row, strict=True)) for row in cm.ask(0, texts, train, shards)]
    for s in range(shards):
        batch = pa.RecordBatch.from_pylist([r for r in asked if r["shard"] == s])
        rows = [r for out in cm.answer((pa.scalar(s),), iter([batch])) for r in out.to_pylist()]
        n += rows[0]["n"]
        told += rows[1:]
    left = pa.table({"doc_id": list(range(len(texts))), "text": pa.array(texts, pa.binary()), "held_out": [not x for x in train.tolist()]})
    r = cm.Reader(left, pa.Table.from_pylist(told), shards)
    d, decider = r.decisions(n), cm.Decider()
    assert decider.learn(d, r.train) > 0 and n == sum(len(t.split()) + 1 for t, x in zip(texts, train, strict=True) if x)
    got = decider.bits(d, len(texts), group=5) + np.bincount(r.block.text, d.choice, len(texts))
    want = [plain_bits(r.texts, r.train.tolist(), i, decider) for i in range(len(texts))]
    assert got.tolist() == pytest.approx(want, rel=1e-4)
    # Spelling, token by token, equals spelling all at once.
    code = cm.Code(np.bincount(np.frombuffer(b" ".join(texts), np.uint8), minlength=256))
    tables = [np.zeros((1 << b, 2), np.float32) for b in cm.TABLE_BITS]
    tokens = [b"w1", b"w22", b"zebra", cm.END]
    alone = [cm.token_bits([t], code, cm.Lookup(tables), cm.Mixer())[0] for t in tokens]
    assert cm.token_bits(tokens, code, cm.Lookup(tables), cm.Mixer()).tolist() == pytest.approx(alone)


def test_a_block_is_scored_from_what_it_stored():
    """Scoring takes a block's decisions as they were stored, 9 bytes each, and gives the same bits."""
    texts = [" ".join(prose(60)).encode() for _ in range(20)] + [b"", b"a a b a a"]
    train = np.arange(len(texts)) % 3 > 0
    asked = pa.RecordBatch.from_pylist([dict(zip([c.split()[0] for c in cm.ASKED.split(", ")], row, strict=True)) for row in cm.ask(0, texts, train, 1)])
    total, told = list(cm.answer((pa.scalar(0),), iter([asked])))
    left = pa.table({"doc_id": list(range(len(texts))), "text": pa.array(texts, pa.binary()), "held_out": (~train).tolist()})
    r = cm.Reader(left, pa.Table.from_batches([told]), 1)
    n, v = (total.column(c)[0].as_py() for c in "nv")
    d, decider = r.decisions(n), cm.Decider()
    decider.learn(d, r.train)
    row = dict(zip([c.split()[0] for c in cm.READ.split(", ")][1:], cm.read_block(r, n, v), strict=True))
    kept = cm.Steps.unpack(row["counts"], row["marks"], row["slots"])
    assert len(row["marks"]) + len(row["slots"]) == 9 * len(d.bit)
    assert np.array_equal(decider.bits(kept, len(texts)), decider.bits(d, len(texts)))
    choice, size, length, known, base = np.frombuffer(row["sums"]).reshape(5, -1)
    assert length.tolist() == [len(t.split()) + 1 for t in r.texts] and size.tolist() == [sum(len(w) + 1 for w in t.split()) + 1 for t in r.texts]
    assert known.tolist() == [sum(x > 0 for x in r.token_n[r.block.ids[r.block.text == i]]) for i in range(len(texts))]
    assert np.allclose(choice, np.bincount(r.block.text, d.choice, len(texts))) and (base < 0).all()


def test_held_out_texts_beat_the_base_and_copies_show(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = cm.score(docs).where("held_out").selectExpr("sum(score)", "sum(base_score)").first()
    assert held[0] > held[1]


def test_order_counts(make_docs):
    """A text that occurs twice costs little, its words in another order do not."""
    rng = random.Random(8)
    line = [f"n{rng.randrange(10**6)}" for _ in range(60)]
    rows = [(i, " ".join(rng.choice(["the", "of", "and", *(f"w{rng.randrange(300)}" for _ in range(3))]) for _ in range(60))) for i in range(300)]
    train, held = ([i for i in range(1000, 1100) if (zlib.crc32(str(i).encode()) % 7 == 2) == out] for out in (False, True))
    copies, shuffled = (*train[:2], held[0]), held[1]
    rows += [(i, " ".join(line)) for i in copies] + [(shuffled, " ".join(rng.sample(line, len(line))))]
    got = {r["doc_id"]: r["bits_per_byte"] for r in cm.score(make_docs(rows), block_bytes=4096, shard_bytes=8192).collect()}
    assert all(got[i] < 0.3 * got[shuffled] for i in copies)


def test_blocks_decide_alike(make_docs, monkeypatch):
    """The decisions' model is that of all training texts: as many decisions are learned from in many blocks as in one, and every block scores by the same model."""
    rows = [(i, " ".join(prose(40))) for i in range(120)]
    whole, learned = [], cm.learned
    monkeypatch.setattr(cm, "learned", lambda *how: whole.append(learned(*how)) or whole[-1])
    few, many = ({r["doc_id"]: r["score"] for r in cm.score(make_docs(rows), block_bytes=b).collect()} for b in (1 << 20, 2048))
    one, other = (x.tables for x in whole)
    assert one.sum() > 0 and np.array_equal(one, other)
    assert all(abs(few[i] - many[i]) < 0.1 * abs(few[i]) for i in few)


def test_scores(make_docs):
    rows = [(i, " ".join(prose(40))) for i in range(120)] + list(ODD)
    got = cm.score(make_docs(rows), block_bytes=4096).collect()
    tokens = [((t or "").encode().lower().split() + [cm.END]) for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    c = collections.Counter(t for ts, h in zip(tokens, held, strict=True) if not h for t in ts)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), h, len(ts), sum(t in c for t in ts), n, round(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts), 6)) for (i, _), ts, h in zip(rows, tokens, held, strict=True))
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    again = cm.score(make_docs(rows[::-1]), block_bytes=4096).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], round(r["score"], 6)) for r in got) == sorted((str(r["doc_id"]), r["n_tokens"], round(r["score"], 6)) for r in again)
    seen = [r["score"] / r["n_tokens"] for r in got if r["doc_id"] is not None and r["n_tokens"] == 41]
    noise = cm.score(make_docs([*rows, (7000, " ".join("".join(RNG.choice("qxzjk") for _ in range(6)) for _ in range(40)))]), held=zlib.crc32(b"7000") % 7).where("doc_id = 7000").first()
    assert noise["score"] / noise["n_tokens"] < min(seen)
    assert cm.score(make_docs([])).count() == 0


# -- pipeline ----------------------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    prose_docs = [(i, "\n".join(" ".join(prose(12)) for _ in range(12)), "en", f"s{i % 3}", 0) for i in range(90)]
    copies = [(200 + i, prose_docs[i][1], "en", "s0", 0) for i in range(5)]
    junk = [(300, "x### " * 100, "en", "s1", 0), (301, None, "en", "s1", 0), (302, "short", None, None, 0)]
    spark.createDataFrame(prose_docs + copies + junk, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    kept = []
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        kept.append(sorted(r["doc_id"] for r in docs.collect()))
    assert kept[0] == sorted([*range(90), *range(200, 205)])
    assert kept[1] == kept[2] == list(range(90))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} <= set(range(90))
    assert all(r["n_tokens"] == len(r["ids"]) > 0 for r in out)
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
