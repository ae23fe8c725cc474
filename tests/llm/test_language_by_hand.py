"""The language identifier against plain Python: features, FTRL weights, probabilities, temperature."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import language_id as I

MASK = (1 << 32) - 1


def plain_counts(text):
    code = [ord(c) if c.isalpha() else 32 for c in text.lower()]
    two = [(a * 0x9E3779B1 & MASK) ^ (b * 0x85EBCA77 & MASK) for a, b in zip(code, code[1:], strict=False)]
    three = [(a * 0xC2B2AE3D & MASK) ^ (b * 0x27D4EB2F & MASK) for a, b in zip(two, code[2:], strict=False)]
    grams = [c * 0x165667B1 & MASK for c in code] + two + three
    return Counter((g * 0x2C1B3C6D & MASK) >> 17 for g in grams) if any(c.isalpha() for c in text) else None


def plain_fit(sample, alpha, beta, l1, l2, epochs):
    """FTRL-proximal with one dictionary for each label; returns the coefficient of (feature, label) and the idf."""
    labels = sorted({label for label, _ in sample})
    train = [x for k, x in enumerate(sample) if k % 5]
    df = Counter(f for _, c in train for f in c)
    idf = lambda f: math.log((1 + len(train)) / (1 + df[f])) + 1
    z, n = Counter(), Counter()

    def weight(key):
        return 0.0 if abs(z[key]) <= l1 else -math.copysign(abs(z[key]) - l1, z[key]) / ((beta + math.sqrt(n[key])) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(train)):
            label, count = train[k]
            x = {f: math.log1p(c) * idf(f) for f, c in count.items()}
            norm = math.sqrt(sum(v * v for v in x.values()))
            x = {f: v / norm for f, v in x.items()} | {"bias": 1.0}
            w = {(f, y): weight((f, y)) for f in x for y in labels}
            scores = {y: sum(v * w[f, y] for f, v in x.items()) for y in labels}
            top = max(scores.values())
            total = sum(math.exp(s - top) for s in scores.values())
            for y in labels:
                error = math.exp(scores[y] - top) / total - (y == label)
                for f, v in x.items():
                    g = v * error
                    z[f, y] += g - (math.sqrt(n[f, y] + g * g) - math.sqrt(n[f, y])) / alpha * w[f, y]
                    n[f, y] += g * g
    return labels, weight, idf, z


WORDS = {"en": "the of and house water ship".split(), "de": "der und über haus wasser schiff".split(), "fr": "le été et maison eau navire".split()}


@pytest.fixture(scope="module")
def sample():
    rnd = random.Random(5)
    texts = [(lang, " ".join(rnd.choice(WORDS[lang]) for _ in range(rnd.randint(3, 12)))) for lang in rnd.choices(sorted(WORDS), k=60)]
    return [(lang, plain_counts(text)) for lang, text in texts]


def arrays(count):
    index = np.array(sorted(count))
    return index, np.array([count[int(i)] for i in index])


def test_features_are_the_hashed_grams():
    for text in ["Über 12 Häuser!", "a", "ab", "İstanbul ŒUVRE", "x" * 50, "日本 ok"]:
        got = I.counts(text)
        assert {int(k): int(got[k]) for k in np.flatnonzero(got)} == dict(plain_counts(text))
    assert I.counts("12 !?") is None


def test_blocks_of_a_long_text_count_as_the_whole(monkeypatch):
    text = "Das Schiff, über 12 Wasser. " * 40
    whole = I.counts(text)
    monkeypatch.setattr(I, "BLOCK", 17)
    assert (I.counts(text) == whole).all()


def test_weights_probabilities_and_temperature_by_hand(sample):
    parameters = {"alpha": 0.5, "beta": 1.0, "l1": 0.02, "l2": 0.5, "epochs": 2}
    model = I.fit([(label, *arrays(c)) for label, c in sample], **parameters)
    labels, weight, idf, z = plain_fit(sample, **parameters)
    assert model.labels == labels
    for (f, y), _ in z.items():
        own = model.bias[labels.index(y)] if f == "bias" else model.weights[f, labels.index(y)]
        assert own == pytest.approx(weight((f, y)), abs=1e-9)
    used = {f for f, _ in z}
    assert not any(model.weights[f].any() for f in range(I.DIMENSIONS) if f not in used) and (model.weights == 0).mean() > 0.9  # the elastic net leaves it sparse

    def probabilities(count, temperature):
        x = {f: math.log1p(c) * idf(f) for f, c in count.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        s = [(sum(v / norm * weight((f, y)) for f, v in x.items()) + weight(("bias", y))) / temperature for y in labels]
        total = sum(math.exp(v - max(s)) for v in s)
        return [math.exp(v - max(s)) / total for v in s]

    held = [x for k, x in enumerate(sample) if not k % 5]
    loss = lambda t: -sum(math.log(max(probabilities(c, t)[labels.index(label)], 1e-300)) for label, c in held) / len(held)
    choices = np.exp(np.linspace(np.log(0.02), np.log(5), 100)).tolist()
    assert loss(model.temperature) <= min(map(loss, choices)) + 1e-9
    text = "the water und haus"
    p = probabilities(plain_counts(text), model.temperature)
    assert model.predict(text) == (labels[p.index(max(p))], pytest.approx(max(p), abs=1e-9)) and model.predict("42") == ("und", 0.0)
