"""Scores of both models against plain loops over dicts; many languages."""

import math
import random
import zlib

import numpy as np

from shelfwise.llm import language_id, linear, quality

MASK = 0xFFFFFFFF
STEMS = ["lamp", "Über", "CASA", "maison", "a1b2", "don't", "x", "straße!", "...", "naïve,", "fox dog", "日本", "42"]


def texts(n=50):
    rng = random.Random(3)
    return [None, "", " \n", "12 !!"] + [rng.choice((" ", "\n", "  ")).join(rng.choice(STEMS) for _ in range(rng.randrange(1, 60))) for _ in range(n - 4)]


def plain_language_grams(text):
    letters = [0] + [ord(c) if c.isalpha() else 0 for c in text.lower()] + [0, 0, 0]
    out = {}
    for a, b, c in zip(letters, letters[1:], letters[2:]):
        two = (a * 0x85EBCA77 + b * 0xC2B2AE3D + 1) & MASK
        for here, h in ((a, a * 0x9E3779B1), (a or b, two), (b, two * 0x27D4EB2F + c * 0x165667B1)):
            if here:
                h &= MASK
                h = ((h ^ h >> 15) * 0x2C1B3C6D & MASK) >> 16
                out[h] = out.get(h, 0) + 1
    return out


def test_language_scores_like_a_plain_loop():
    rng = np.random.default_rng(1)
    idf, weights = rng.random(language_id.SIZE) + 1.0, rng.standard_normal((language_id.SIZE, 3)).astype(np.float32)
    model = language_id.Model(["de", "en", "fr"], idf, weights, 1.7)
    for text in texts():
        counts = plain_language_grams(text or "")
        total = sum(counts.values())
        if not any(map(str.isalpha, text or "")):
            assert model.predict(text) == ("und", 0.0)
            continue
        logits = [sum(language_id.SCALE * n / total * idf[g] * float(weights[g, k]) for g, n in counts.items()) / 1.7 for k in range(3)]
        p = [math.exp(x - max(logits)) for x in logits]
        p = [x / sum(p) for x in p]
        lang, score = model.predict(text)
        assert lang == model.languages[p.index(max(p))] and abs(score - max(p)) < 1e-5


def plain_bucket(h, kind):
    h = (h + kind) * 0x9E3779B1 & MASK
    return quality.FREE + ((h ^ h >> 15) * 0x2C1B3C6D & MASK) % (quality.SIZE - quality.FREE)


def plain_quality_features(text):
    words = (text or "").split()
    hashes = [(0, 0)] + [tuple(zlib.crc32(x.encode()) for x in (w.lower(), quality.shape(w))) for w in words]
    out, pairs = {quality.BIAS: 1.0}, []
    for (w0, s0), (w1, s1) in zip(hashes, hashes[1:]):
        pair, shapes = (w0 * 0x85EBCA77 + w1) & MASK, (s0 * 0x85EBCA77 + s1) & MASK
        pairs.append(pair)
        for h, kind in ((w1, 1), (s1, 2), (pair, 3), (shapes, 4)):
            g = plain_bucket(h, kind)
            out[g] = out.get(g, 0.0) + quality.SCALE / len(words)
    if pairs and len(set(pairs)) < len(pairs):
        out[quality.REPEATED] = quality.SCALE * (1 - len(set(pairs)) / len(pairs))
    return out


def test_quality_scores_like_a_plain_loop():
    rng = np.random.default_rng(2)
    weights = rng.standard_normal((quality.SIZE, 2)).astype(np.float32)
    model = quality.Model(weights, 0.8)
    for text in texts() + ["same words same words same words"]:
        want = plain_quality_features(text)
        ids, values = quality.features(text)
        assert dict(zip(ids.tolist(), np.round(values, 4).tolist())).keys() == want.keys()
        assert all(abs(v - want[i]) < 1e-4 for i, v in zip(ids.tolist(), values.tolist()))
        logit = sum(v * float(weights[i, 1] - weights[i, 0]) for i, v in want.items()) / 0.8
        assert abs(model.score(text) - 1 / (1 + math.exp(-logit))) < 1e-4


def test_a_hundred_languages(make_docs):
    """Every value of lang is learned, however many there are."""
    rng = random.Random(7)
    stems = {}
    for k in range(100):
        few = rng.sample("abcdefghijklmnopqrstuvwxyzäöüéèñçøåß", 6)
        stems[f"l{k:02d}"] = ["".join(rng.choice(few) for _ in range(rng.randrange(3, 8))) for _ in range(12)]
    rows = []
    for k in range(2400):
        lang = f"l{k % 100:02d}"
        rows.append((k, " ".join(rng.choice(stems[lang]) for _ in range(25)), lang))
    truth = {k: lang for k, _, lang in rows}
    got = [r for r in language_id.identify(make_docs(rows, extra=False)).collect() if r["held_out"]]
    assert {r["lang_pred"] for r in got} == set(stems)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in got) >= 0.95 * len(got)


def test_sample_is_bounded(spark):
    rows = spark.range(40_000).selectExpr("id AS doc_id", "CAST(id AS string) AS text", "CAST(id % 200 AS string) AS lang")
    assert 0.8 * 200 * 30 < linear.bounded_sample(rows, "lang", 1500, 40_000).count() < 1.2 * 200 * 30  # LEAST of each
    assert linear.bounded_sample(rows, "lang", 50, 1 << 40).groupBy("lang").count().count() == 200
    assert linear.bounded_sample(rows.where("false"), "lang", 50, 100).count() == 0
    assert linear.bounded_sample(rows, "lang", 50, 100).columns == rows.columns
