import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import quality, toxicity

WORDS = [f"w{k}" for k in range(400)]


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(5)
    docs, labels = [], []
    for k in range(1200):
        text = [rnd.choice(WORDS) for _ in range(rnd.randrange(20, 120))]
        toxic, good = k % 7 == 0, k % 5 != 0
        if toxic:
            for _ in range(3):
                text.insert(rnd.randrange(len(text)), rnd.choice(["idiot", "scum", "vile"]))
        if not good:
            text = [f"{w.upper()}!!" if k % 2 else f"{w}###" for w in text]
        docs.append((k, " ".join(text)))
        labels.append((k, int(good), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def accuracy(rows, truth, folds, held):
    got = [(r, truth[r.doc_id]) for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    return np.mean([r.predicted == y for r, y in got])


def test_toxicity(corpus):
    docs, labels, truth = corpus
    rows = toxicity.score(docs, labels).collect()
    assert accuracy(rows, {k: t for k, _, t in truth}, 5, 0) > 0.97


def test_quality(corpus):
    docs, labels, truth = corpus
    rows = quality.score(docs, labels).collect()
    assert accuracy(rows, {k: q for k, q, _ in truth}, 3, 1) > 0.97
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.predicted}


def test_quality_from_positives_only(corpus):
    docs, labels, truth = corpus
    model = quality.train(docs, labels.where("quality = 1"), quality.training_fold)
    assert 0.5 < model.prior <= 0.95


def test_held_out_labels_are_not_read(corpus, spark):
    docs, labels, truth = corpus
    turned = [(k, q if zlib.crc32(str(k).encode()) % 3 != 1 else 1 - q, t if zlib.crc32(str(k).encode()) % 5 else 1 - t) for k, q, t in truth]
    other = spark.createDataFrame(turned, "doc_id long, quality int, toxic int")
    for f in (quality.score, toxicity.score):
        assert sorted(f(docs, labels).collect()) == sorted(f(docs, other).collect())


def test_odd_rows(odd, odd_rows, labels, empty):
    for f in (quality.score, toxicity.score):
        rows = f(odd, labels).collect()
        assert len(rows) == len(odd_rows) and all(0 <= r.score <= 1 for r in rows)
        by = {}
        for r in rows:
            by.setdefault(r.doc_id, set()).add(r.score)
        assert len(by[1] | by[2]) == 1 and by[3] == by[4]
        assert f(empty, labels).collect() == []
        assert all(r.score == 0.5 for r in f(odd, labels.limit(0)).collect())


def test_hashes_in_parts(monkeypatch):
    words = [f"w{k % 50}".encode() for k in range(1000)]
    whole = toxicity.distinct(words, toxicity._Hashes())
    monkeypatch.setattr(toxicity, "_PART", 7)
    assert np.array_equal(whole, toxicity.distinct(words, toxicity._Hashes()))


def small(spark, n, seed):
    rnd = random.Random(seed)
    docs, labels = [], []
    for k in range(n):
        toxic, good = rnd.random() < 0.3, rnd.random() < 0.6
        text = [rnd.choice(WORDS[:60]) for _ in range(rnd.randrange(0, 30))] + (rnd.sample(["idiot", "scum", "vile", "fool", "rat"], 2) if toxic else [])
        rnd.shuffle(text)
        docs.append((k, " ".join(w if good else f"{w.upper()}!{k % 10}" for w in text) + ("\n" if k % 3 else "\n\né")))
        labels.append((k, int(good), int(toxic)))
    return docs, labels, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def plain_features(text):
    """Distinct hashes of words, pairs and pairs with one word between, in 64-bit arithmetic on plain integers."""
    words = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", "".join(c.lower() if c.isascii() else c for c in text))
    h, most = [zlib.crc32(w.encode()) for w in words], 2**64 - 1
    raw = [x * 0x9E3779B97F4A7C15 for x in h]
    raw += [a * 0xC2B2AE3D27D4EB4F + b * 0x165667B19E3779F9 + 1 for a, b in zip(h, h[1:], strict=False)]
    raw += [a * 0xD6E8FEB86659FD93 + b * 0xA0761D6478BD642F + 2 for a, b in zip(h, h[2:], strict=False)]
    mixed = [((x & most) ^ ((x & most) >> 32)) * 0xD6E8FEB86659FD93 & most for x in raw]
    return sorted({x >> (64 - toxicity.BITS) for x in mixed})


def plain_ftrl(rows, epochs):
    """The update of one coordinate at a time, in dictionaries."""
    z, n = {}, {}

    def weight(i):
        a, b = z.get(i, 0.0), n.get(i, 0.0)
        l1 = 0.0 if i == "bias" else toxicity.L1
        return 0.0 if abs(a) <= l1 else -math.copysign(abs(a) - l1, a) / ((toxicity.BETA + math.sqrt(b)) / toxicity.ALPHA + toxicity.L2)

    for _ in range(epochs):
        for x, y in rows:
            x = [*x, "bias"]
            w = {i: weight(i) for i in x}
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w.values()))))) - y
            for i in x:
                before = n.get(i, 0.0)
                n[i] = before + g * g
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n[i]) - math.sqrt(before)) / toxicity.ALPHA * w[i]
    return {i: w for i in z if (w := weight(i))}


def test_toxicity_against_loops(spark):
    docs, labels, d, lab = small(spark, 400, 1)
    order = {r.doc_id: r.h for r in d.select("doc_id", F.xxhash64(F.lit(toxicity.SEED + 1), "doc_id").alias("h")).collect()}
    text, toxic = dict(docs), {k: t for k, _, t in labels}
    train = sorted((k for k in text if zlib.crc32(str(k).encode()) % 5), key=lambda k: (order[k], k))
    w = plain_ftrl([(plain_features(text[k]), toxic[k]) for k in train], toxicity.EPOCHS)
    rows = toxicity.score(d, lab).collect()
    assert len(rows) == len(docs) and len(w) > 4
    for r in rows:
        logit = w.get("bias", 0.0) + sum(float(np.float32(w[i])) for i in plain_features(text[r.doc_id]) if i in w)
        assert r.score == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-6)
        assert r.predicted == int(r.score >= 0.5)


def test_all_features_of_all_sampled_rows_count(spark):
    """A long text with tens of thousands of features before and after short ones; repeated ids count once."""
    rnd = random.Random(3)
    long = " ".join(f"x{k}" for k in range(60_000))
    docs = [(k, (long if k == 7 else "") + " ".join(rnd.choice(WORDS) for _ in range(5)) + (" scum" if k % 2 else "")) for k in range(40)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    plain, doubled = (spark.createDataFrame(x, "doc_id long, text string") for x in (docs, docs * 3))
    one, other = (toxicity.train(x, labels, sample=1000, epochs=2) for x in (plain, doubled))
    assert np.array_equal(one.index, other.index) and np.array_equal(one.weight, other.weight) and one.bias == other.bias
    order = {r.doc_id: r.h for r in plain.select("doc_id", F.xxhash64(F.lit(toxicity.SEED + 1), "doc_id").alias("h")).collect()}
    text, train = dict(docs), [k for k, _ in docs if zlib.crc32(str(k).encode()) % 5]
    assert 7 in train
    w = plain_ftrl([(plain_features(text[k]), k % 2) for k in sorted(train, key=lambda k: (order[k], k))], 2)
    assert set(one.index) == {i for i in w if i != "bias"} and one.bias == pytest.approx(w["bias"])


def plain_statistics(text):
    """The surface statistics of a text, counted one character at a time."""
    raw = text.encode()
    if not raw:
        return [0.0] * quality.N_FEATURES
    n, words, lines = len(raw), raw.split(), raw.split(b"\n")
    of = lambda test: math.sqrt(sum(1 for c in raw if test(chr(c) if c < 128 else "")) / n)
    signs = [of(lambda c, s=s: c == s) for s in map(chr, range(32, 127)) if not s.isalnum()]
    m = max(1, len(words))
    kinds = [of(str.isdigit), of(str.isupper), of(str.islower), math.sqrt(sum(c > 127 for c in raw) / n), of(lambda c: c == "\n")]
    return [*signs, *kinds, math.log1p(n) / 10, math.log1p(m) / 10, len(set(words)) / m, math.log1p(m / max(1, len(set(words)))), math.log1p(n / m) / 3, len(set(lines)) / len(lines), math.log1p(len(lines)) / 10]


def plain_fit(positive, unlabelled, prior, steps):
    """Descent on the non-negative risk with loops over rows and features; returns a score function."""
    both, size = positive + unlabelled, len(positive[0])
    mean = [sum(r[j] for r in both) / len(both) for j in range(size)]
    scale = [math.sqrt(sum((r[j] - mean[j]) ** 2 for r in both) / len(both)) + 1e-3 for j in range(size)]
    cut = lambda r: [max(-8.0, min(8.0, (r[j] - mean[j]) / scale[j])) for j in range(size)] + [1.0]
    sigmoid = lambda x: 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))
    p, u = [cut(r) for r in positive], [cut(r) for r in unlabelled]
    w, m, v = [0.0] * size + [math.log(prior / (1 - prior))], [0.0] * (size + 1), [0.0] * (size + 1)
    for t in range(1, steps + 1):
        sp, su = ([sigmoid(sum(a * b for a, b in zip(w, r, strict=True))) for r in rows] for rows in (p, u))
        mean_of = lambda rows, s, j: sum(r[j] * x for r, x in zip(rows, s, strict=True)) / len(rows)
        below = sum(-math.log(max(1 - x, 1e-12)) for x in su) / len(u) - prior * sum(-math.log(max(1 - x, 1e-12)) for x in sp) / len(p)
        for j in range(size + 1):
            rest = mean_of(u, su, j) - prior * mean_of(p, sp, j)
            decay = quality.RIDGE * w[j] if j < size else 0.0
            g = prior * (mean_of(p, sp, j) - mean_of(p, [1.0] * len(p), j)) + rest + decay if below >= 0 else decay - rest
            m[j], v[j] = 0.9 * m[j] + 0.1 * g, 0.999 * v[j] + 0.001 * g * g
        w = [w[j] - quality.RATE * (m[j] / (1 - 0.9**t)) / (math.sqrt(v[j] / (1 - 0.999**t)) + 1e-8) for j in range(size + 1)]
    return lambda r: sigmoid(sum(a * b for a, b in zip(w, cut(r), strict=True)))


def test_quality_against_loops(spark, monkeypatch):
    docs, labels, d, lab = small(spark, 60, 2)
    good = {k: q for k, q, _ in labels}
    steps, whole = 40, quality.fit
    monkeypatch.setattr(quality, "STEPS", steps)
    stats = {k: plain_statistics(t) for k, t in docs}
    train = [k for k, _ in docs if zlib.crc32(str(k).encode()) % 3 != 1]
    prior = sum(good[k] for k in train) / len(train)
    score = plain_fit([stats[k] for k in train if good[k]], [stats[k] for k in train], prior, steps)
    model = whole(np.array([stats[k] for k in train if good[k]]), np.array([stats[k] for k in train]), prior)
    assert all(np.allclose(quality.features(t.encode()), stats[k]) for k, t in docs)
    assert all(model.score(np.array([stats[k]]))[0] == pytest.approx(score(stats[k]), abs=1e-9) for k in stats)
    # The rows that the query samples, and what it fits in a task with all steps.
    monkeypatch.undo()
    full = whole(np.array([stats[k] for k in train if good[k]]), np.array([stats[k] for k in train]), prior)
    got = {r.doc_id: r.score for r in quality.score(d, lab).collect()}
    assert all(got[k] == pytest.approx(full.score(np.array([stats[k]]))[0], abs=1e-6) for k in stats)
