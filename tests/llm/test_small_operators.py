"""Sharding, mixing, quality rules, classifier, fingerprints: against brute force on small tables."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from entloom.llm import quality_mcd as mcd
from entloom.llm import slot_sharding as sh
from entloom.llm import source_mix as mix
from entloom.llm import subword_quality as sq
from entloom.llm import weighted_fingerprints as wf
from tests.llm.conftest import ODD


def test_table_is_even_and_moves_little():
    names = [f"s{i}" for i in range(10)]
    full = sh.fill_table(names, 1009)
    n = np.bincount(full)
    assert n.max() - n.min() <= 1
    less = sh.fill_table(names[:-1], 1009)
    moved = (full != less) & (full != 9)
    assert moved.mean() < 0.25
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sh.fill_table(bad, 7)
    with pytest.raises(ValueError):
        sh.fill_table(["a"], 8)


def test_shards(odd_docs, make_docs):
    rows = sh.assign_shards(odd_docs, ["a", "b", "c"], slots=101).collect()
    assert len(rows) == len(ODD)
    filled = sh.fill_table(["a", "b", "c"], 101)
    for r in rows:
        key = str(r["doc_id"]) if r["doc_id"] is not None else hashlib.md5(r["text"].encode()).hexdigest() if r["text"] is not None else ""
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 101
        assert (r["__slot"], r["__shard"]) == (slot, filled[slot])
    assert sh.assign_shards(make_docs([]), ["a"], slots=101).count() == 0


def test_targets():
    assert mix.targets([100, 100, 100], [1, 2, 3], 300, 3) == [50, 100, 150]
    got = mix.targets([10, 1000, 0], [3, 1, 2], 1010, 3)
    assert got == [30, 980, 0]


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_permutation(n):
    assert sorted(mix.permute(np.arange(n), n, 5).tolist()) == list(range(n))


@pytest.mark.parametrize("size, target", [(0, 0), (1, 3), (100, 30), (100, 250.7), (95, 94.9), (95, 13), (1000, 2999.9), (10, 10)])
def test_source_takes_its_target(size, target):
    for seed in range(5):
        s = mix.Source(0, size, target, 10, seed)
        if s.slots:
            _, block, words = s.read(np.arange(s.slots))
            assert words.sum() == int(target) and (words > 0).all()
            assert np.bincount(block).max() <= 3


def test_draws_meet_the_totals():
    counts = np.array([500, 0, 300, 77])
    seen = [set() for _ in counts]
    per = []
    for shard in range(-(-int(counts.sum()) // 64)):
        which, number = mix.shard_draws(counts, shard, 64, 5)
        for k, i in zip(which.tolist(), number.tolist(), strict=True):
            assert i not in seen[k]
            seen[k].add(i)
        per.append(np.bincount(which, minlength=4))
    assert [sorted(s) for s in seen] == [list(range(c)) for c in counts]
    # Means and spread of a hypergeometric draw.
    many = np.array([np.bincount(mix.shard_draws(counts, 3, 64, seed)[0], minlength=4) for seed in range(400)])
    share = counts / counts.sum()
    assert np.abs(many.mean(0) - 64 * share).max() < 0.8
    assert many[:, 0].var() == pytest.approx(64 * share[0] * (1 - share[0]) * (877 - 64) / 876, rel=0.3)


@pytest.mark.parametrize("total", [10**9 + 7, 3 * 10**12])
def test_draws_are_random_at_any_size(total):
    """Beyond a billion slots shards still differ from each other and between seeds, and a place is found without a walk."""
    counts = np.array([total // 2, total // 3, total - total // 2 - total // 3])
    draws = {tuple(np.bincount(mix.shard_draws(counts, shard, 256, seed)[0], minlength=3)) for shard in (0, 1, 10**6) for seed in (1, 2, 3)}
    assert len(draws) > 4
    x = np.array([0, 1, total - 1, total // 7])
    assert (mix.place_of(mix.permute(x, total, 9), total, 9) == x).all()
    source = mix.Source(0, total * 1024 - 5, total * 1000.0, 1024, 3)
    assert source.blocks == total and abs(source.slots - total * 1000 / 1024) < 2


def mixed(docs, **how):
    return sorted(map(tuple, mix.mix_plan(docs, block=8, slots_per_shard=4, **how).collect()), key=str)


def test_mix(make_docs, odd_docs):
    rng = random.Random(1)
    rows = [(i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(0, 60))), "en", None if s == 3 else f"s{s}") for s, n in enumerate((5, 30, 60, 20)) for i in range(100 * s, 100 * s + n)]
    got = mixed(make_docs(rows))
    assert got == mixed(make_docs(rows[::-1]))
    source = {r[0]: r[3] for r in rows}
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for doc, n, total, t, k in got:
        s = source[doc]
        size[s] += n
        taken[s] += k
        target[s] = t
        assert 0 <= k <= 3 * n
    assert sum(size.values()) == pytest.approx(sum(target.values()))
    for s in target:
        assert abs(taken[s] - target[s]) < 1
    odd = mixed(odd_docs)
    assert len(odd) == len(ODD)
    assert mixed(make_docs([])) == []


def test_mixed_documents(make_docs):
    rows = [(i, f"a{i} b{i}  c{i}\nd{i}", "en", "x" if i < 3 else "y") for i in range(20)] + [(30, None), (31, ""), (5, "a5 b5  c5\nd5", "en", "y")]
    docs = make_docs(rows)
    out = mix.mix_documents(docs, block=8, slots_per_shard=4)
    assert out.columns == docs.columns
    plan = collections.Counter()
    for doc, *_, k in mixed(docs):
        plan[doc] += k
    texts = {r[0]: r[1] for r in rows}
    got = collections.Counter()
    for r in out.collect():
        assert r["text"] in texts[r["doc_id"]] and r["n_chars"] == len(r["text"])
        got[r["doc_id"]] += len(r["text"].split())
    assert +got == +plan


def brute_stats(text):
    t = text or ""
    w = [x.decode() for x in t.encode().split()]
    lines = [x for x in t.split("\n") if x.encode().split()]
    win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = collections.Counter(win)
    covered = {j for i, x in enumerate(win) if n[x] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_statistics_and_verdicts(make_docs):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 9)))
    clean = [(i, "\n".join(" ".join(word() for _ in range(rng.randint(8, 14))) for _ in range(rng.randint(8, 20))), "en", "s") for i in range(150)]
    junk = [(1000 + i, " ".join(word() + "###" for _ in range(100)), "en", "s") for i in range(10)]
    rows = clean + junk + [(i, t, "en", None) for i, t in ODD] + [(2000, "é a\nb é\né a\n\n é a", "de", "q"), (2001, "a b c a b c a b c " * 30, "de", "q")]
    got = mcd.judge(make_docs(rows)).collect()
    want = sorted(((str(i), *brute_stats(t)) for i, t, *_ in rows))
    assert sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        if r["base_failed"] or r["doc_id"] is not None and 1000 <= r["doc_id"] < 1010:
            assert not r["kept"]
        else:
            assert r["kept"]
    kept = mcd.keep_clean(make_docs(rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(150))
    assert mcd.judge(make_docs([])).count() == 0


def test_chi_square():
    assert mcd.chi2_quantile(0.95, 5) == pytest.approx(11.0705, abs=1e-3)
    assert mcd.chi2_cdf(2.0, 2) == pytest.approx(1 - np.exp(-1))


def test_classifier(spark, make_docs):
    rng = random.Random(4)
    good, bad = ["river", "mountain", "valley", "forest"], ["buy$$$", "cheap###", "click%%", "free&&&"]
    rows = [(i, " ".join(rng.choice(good if i % 2 else bad) + rng.choice(["", "s", "ed"]) for _ in range(30))) for i in range(300)]
    docs = make_docs([*rows, *((1000 + (i or 0), t) for i, t in ODD), (None, "river")])
    labels = spark.createDataFrame([*((i, i % 2) for i in range(300)), (3, None), (None, 1)], "doc_id long, quality int")
    model = sq.train(docs, labels, buckets=1 << 12)
    got = {r["doc_id"]: r for r in sq.score(docs, model).collect()}
    assert sq.score(docs, model).count() == 300 + len(ODD) + 1
    for i in range(300):
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert got[i]["predicted"] == i % 2
        assert 0 <= got[i]["score"] <= 1
    assert got[1001]["score"] == got[1002]["score"] == got[1003]["score"]
    none = sq.train(docs, labels.limit(0), buckets=64)
    assert none.logits()[1] == 0
    assert sq.score(make_docs([]), model).count() == 0


def test_gradients_equal_differences():
    rng = np.random.default_rng(3)
    model = sq.Model(20, 4)
    model.emb, model.out, model.bias = rng.normal(size=(20, 4)), rng.normal(size=(4, 2)), rng.normal(size=2)
    n, labels = np.array([3, 0, 5]), np.array([1, 0, 0])
    idx, w = rng.permutation(20)[: n.sum()], rng.uniform(0.1, 1, n.sum())

    def loss():
        return -np.log(model.forward(idx, w, n)[1][np.arange(3), labels]).mean()

    def slope(at, i):
        was = at[i]
        at[i] = was + 1e-4
        up = loss()
        at[i] = was - 1e-4
        down = loss()
        at[i] = was
        return (up - down) / 2e-4

    out, bias, back = model.gradients(idx, w, n, labels)
    seg = np.repeat(np.arange(3), n)
    for i in np.ndindex(4, 2):
        assert out[i] == pytest.approx(slope(model.out, i), abs=2e-3)
    assert bias.tolist() == pytest.approx([slope(model.bias, i) for i in range(2)], abs=2e-3)
    for j, i in enumerate(idx.tolist()):
        assert (w[j] * back[seg[j]]).tolist() == pytest.approx([slope(model.emb, (i, k)) for k in range(4)], abs=2e-3)


def test_training_stays_finite():
    """Documents that share all of their features, at a high rate; and weights that aren't finite are an error."""
    f = [np.arange(50, dtype=np.int32)] * 200
    w = [np.full(50, 0.02, np.float32)] * 200
    model = sq.Model(64, 8)
    model.fit(f, w, np.arange(200) % 2, epochs=10, rate=50.0)
    assert np.isfinite(model.logits()[0]).all()
    model.out[:] = np.nan
    with pytest.raises(FloatingPointError):
        model.fit(f, w, np.arange(200) % 2, epochs=1)


def test_held_out_quality_of_ten_thousand_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    scored = sq.score(docs, sq.train(docs, labels))
    rows = scored.where("held_out").join(labels.where("quality is not null"), "doc_id").select("score", "quality").collect()
    assert scored.where("isnan(score) or score < 0 or score > 1").count() == 0
    order = sorted(rows, key=lambda r: r["score"])
    ones = [k for k, r in enumerate(order, 1) if r["quality"] == 1]
    auc = (sum(ones) - len(ones) * (len(ones) + 1) / 2) / (len(ones) * (len(order) - len(ones)))
    assert auc > 0.93 and sum((r["score"] >= 0.3) == r["quality"] for r in rows) > 0.94 * len(rows)


def generalised(a, b):
    a, b = (collections.Counter((t or "").encode().split()) for t in (a, b))
    return sum((a & b).values()) / sum((a | b).values()) if a | b else 1.0


def test_fingerprints(make_docs):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(30, 60)))) for i in range(40)]
    rows += [(40, None), (41, ""), (42, rows[0][1]), (42, rows[0][1]), (42, "other text"), (None, "é ü last of all")]
    got = wf.fingerprints(make_docs(rows), samples=32).collect()
    assert len(got) == len(rows)
    order = sorted({i for i, _ in rows if i is not None}) + [None]
    texts = collections.defaultdict(list)
    for i, t in rows:
        texts[i].append(t or "")
    off = []
    for r in got:
        nxt = order[(order.index(r["doc_id"]) + 1) % len(order)]
        options = set()
        for t in texts[r["doc_id"]]:
            if len(t) == r["n_chars"]:
                for x in texts[nxt]:
                    q = len(t) // 4
                    e = t[: len(t) - q] + x[:q]
                    options.add(hashlib.sha256(e.encode()).hexdigest())
                    if len(texts[nxt]) == 1:
                        off += [r["near_edited"] - generalised(t, e), r["near_next"] - generalised(t, x)]
        assert r["edited_sha256"] in options
    assert abs(np.mean(off)) < 0.03 and np.abs(off).max() < 0.4
    prints = {r["doc_id"]: r["fingerprint"] for r in got if r["doc_id"] != 42}
    assert prints[0] in {r["fingerprint"] for r in got if r["doc_id"] == 42}
    assert prints[40] == prints[41] == "0" * 256
    assert wf.fingerprints(make_docs([])).count() == 0


def plain_features(text, buckets):
    """Each feature's share of a document, word by word."""
    def number(data):
        h = 0
        for k, byte in enumerate(data):
            h = (h + (byte + 1) * pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) % (1 << 64)
        return h

    def mixed(h, salt):
        h = (h ^ (h >> 31) ^ salt) * 0xBF58476D1CE4E5B9 % (1 << 64)
        return (h ^ (h >> 29)) % buckets

    words, share = (text or "").encode().lower().split(), collections.defaultdict(float)
    half = 0.5 if len(words) > 1 else 1.0
    for w in words:
        data = b"<" + w + b">"
        features = [mixed(number(data), 1)]
        for n in sq.GRAMS:
            for i in range(len(data) - n + 1):
                h = 0
                for byte in data[i : i + n]:
                    h = (h * 0x9E3779B97F4A7C15 + byte + 1) % (1 << 64)
                features.append(mixed(h, n))
        for f in features:
            share[f] += half / len(words) / len(features)
    for one, two in zip(words, words[1:], strict=False):
        h = (number(b"<" + one + b">") * 0x9E3779B97F4A7C15 + number(b"<" + two + b">")) % (1 << 64)
        share[mixed(h, 2)] += 0.5 / (len(words) - 1)
    return share


def test_scores_equal_a_plain_loop(make_docs):
    rng = random.Random(12)
    texts = [None, "", "one", "One two", "one one one one", "übel wörter über alles", "x" * 5000, *(" ".join(rng.choice(["the", "The", "of", "wörd", "a", "Quality"]) for _ in range(rng.randrange(1, 40))) for _ in range(40))]
    docs = make_docs(list(enumerate(texts)))
    model = sq.Model(1 << 12, 4)
    model.bias[:] = (0.1, 0.4)
    margin = (model.emb.astype(float) @ (model.out[:, 1] - model.out[:, 0]).astype(float)).tolist()
    got = {r["doc_id"]: r["score"] for r in sq.score(docs, model, memory_words=3).collect()}
    for i, text in enumerate(texts):
        share = plain_features(text, 1 << 12)
        found, weights = sq.document_features(text, 1 << 12)
        assert dict(zip(found.tolist(), weights.tolist(), strict=True)) == pytest.approx(dict(share), rel=1e-4, abs=1e-6)
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(sum(margin[f] * w for f, w in share.items()) + 0.3))), abs=1e-5)
