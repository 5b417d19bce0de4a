"""The toxicity model against a plain version: log-odds, maximal segments, fitted law, calibration and scores."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from puckspark.llm import text as T
from puckspark.llm import toxicity as tox

CALM = [f"calm{i}" for i in range(60)] + ["the", "of", "and", "house", "river", "walking", "walked"]
RUDE = ["idiots", "idiotic", "scum", "vermin", "filthy", "trash"]


def rows_of(seed=5):
    rng, out = random.Random(seed), []
    for i in range(160):
        y = int(i % 4 == 0)
        words = [rng.choice(CALM) for _ in range(rng.randint(5, 60))]
        for _ in range(rng.randint(2, 6) if y else rng.random() < 0.15):
            words.insert(rng.randint(0, len(words)), rng.choice(RUDE))
        out.append((i, " ".join(words), y))
    return out


def units_of(text):
    """(whole word, its first 6, 5 and 4 letters), of each word."""
    return [((0, w), *((k, w[:k]) for k in tox.STEMS)) for w in re.findall("[0-9a-z]+", text.lower())]


def hash_of(unit):
    k, w = unit
    raw = np.frombuffer(w.encode(), np.uint8)
    hashes = T.word_hashes(raw, np.array([0]), np.array([len(raw)]), tox.STEMS)
    return int(hashes[0 if k == 0 else 1 + tox.STEMS.index(k)][0])


def segments_of(gains, shift=0):
    """By definition: the best stretch, then those of what lies on both sides of it."""
    best = max(((sum(gains[a: b + 1]), -a, b) for a in range(len(gains)) for b in range(a, len(gains))), default=(0, 0, 0), key=lambda s: (round(s[0], 9), s[1], -s[2]))
    if best[0] <= 1e-12:
        return []
    score, a, b = best[0], -best[1], best[2]
    return [*segments_of(gains[:a], shift), score, *segments_of(gains[b + 1:], shift + b + 1)]


def plain_fit(docs):
    """Weights, weight of other words, decay, K, and (label, n, scores of segments)."""
    counts = {}
    for _, text, y in docs:
        for u in {u for us in units_of(text) for u in us}:
            counts.setdefault(u, [0, 0])[y] += 1
    good, bad = (sum(c[y] for c in counts.values()) for y in (0, 1))
    part, weights = bad / (bad + good), {}
    for u, (g, b) in counts.items():
        prior = tox.FLAT + (g + b) * tox.PRIOR / (good + bad)
        odds = math.log((b + prior) / (bad - b + tox.PRIOR)) - math.log((g + prior) / (good - g + tox.PRIOR))
        if b > (g + b) * part:
            ratio = b * math.log(b / ((g + b) * part)) + (g * math.log(g / ((g + b) * (1 - part))) if g else 0)
            if 2 * ratio >= tox.MIN_Z**2:
                weights[u] = (odds, g, b)
    share = {u: (g + 0.5) / (good + 1) for u, (_, g, _) in weights.items()}
    other = max(1 - sum(share.values()), 1e-3)
    mean = sum(w * share[u] for u, (w, _, _) in weights.items())
    rest = math.log(max(1 - sum(b for _, _, b in weights.values()) / bad, 1e-6) / max(1 - sum(g for _, g, _ in weights.values()) / good, 1e-6))
    rest = min(rest, -2 * mean / other, -0.01)
    weights = {u: w for u, (w, _, _) in weights.items()}
    moment = lambda x: sum(share[u] * math.exp(x * w) for u, w in weights.items()) + other * math.exp(x * rest) - 1
    low, high = 1e-6, 1.0
    while moment(high) <= 0:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if moment(mid) <= 0 else (low, mid)
    measured = []
    for _, text, y in docs:
        gains = [next((weights[u] for u in us if u in weights), rest) for us in units_of(text)]
        measured.append((y, len(gains), sorted(segments_of(gains), reverse=True)))
    return weights, rest, high, measured


@pytest.fixture(scope="module")
def fitted(spark):
    docs = rows_of()
    # a copy under another id and a second label of one document change nothing
    table = spark.createDataFrame([*docs, (900, docs[0][1], 1)], "doc_id long, text string, y int")
    labels = table.select("doc_id", F.col("y").alias("toxic"))
    return docs, table.select("doc_id", "text"), tox.fit(table.select("doc_id", "text"), labels)


def test_weights_and_law(fitted):
    docs, _, (law, _) = fitted
    weights, rest, decay, measured = plain_fit(docs)
    assert weights and {hash_of(u): pytest.approx(w) for u, w in weights.items()} == dict(zip(map(int, law.hashes), law.weights))
    assert law.rest == pytest.approx(rest) and law.decay == pytest.approx(decay, rel=1e-6)
    clean = [(n, s[0] if s else None) for y, n, s in measured if not y]
    least = min(weights.values())
    # K where the likelihood of the clean documents is greatest, by trying values
    def likelihood(k):
        return sum((math.log(k * n * decay) - decay * s - k * n * math.exp(-decay * s)) if s is not None else -k * n * math.exp(-decay * least) for n, s in clean)
    assert any(s is not None for _, s in clean) and any(s is None for _, s in clean)
    assert all(likelihood(law.scale) > likelihood(law.scale * f) for f in (0.9, 0.99, 1.01, 1.1))


def test_calibration_and_scores(fitted):
    docs, table, (law, calibration) = fitted
    _, _, decay, measured = plain_fit(docs)
    x, y = [], []
    for label, n, scores in measured:
        sure = [s for s in scores if 1 - math.exp(-law.scale * n * math.exp(-decay * s)) < tox.SIGNIFICANT]
        best = max(0.0, decay * scores[0] - math.log(law.scale * n)) if scores else 0.0
        x.append([best, math.log1p(len(sure)), math.log1p(sum(sure)), math.log1p(scores[0]) if scores else 0.0, 1.0])
        y.append(label)
    x, y, w = np.array(x), np.array(y), np.asarray(calibration)
    p = 1 / (1 + np.exp(-x @ w))
    assert np.abs(x.T @ (y - p) - w * [1, 1, 1, 1, 1e-3]).max() < 1e-5  # the ridge loss has no slope there
    got = {r.id: r for r in tox.score(table, law, calibration).collect()}
    for (i, text, _), (_, n, scores), want in zip(docs, measured, p):
        assert got[i].score == pytest.approx(want, abs=1e-6)
        sure = sorted(s for s in scores if 1 - math.exp(-law.scale * n * math.exp(-decay * s)) < tox.SIGNIFICANT)
        assert sorted(q.score for q in got[i].passages) == pytest.approx(sure)
    assert got[900].score == got[0].score


def test_documents_that_share_a_passage_are_not_copies(spark):
    shared = " ".join(f"s{i}" for i in range(80))
    docs = spark.createDataFrame([(i, f"{shared} own{i} word{i}") for i in range(30)] + [(100 + i, shared) for i in range(5)], "doc_id long, text string")
    labels = docs.select("doc_id", F.lit(1).alias("toxic"))
    kept = tox._labelled(docs, labels, "doc_id", "text", "toxic", None)
    assert sorted(r.id for r in kept.collect()) == [*range(30), 100]
