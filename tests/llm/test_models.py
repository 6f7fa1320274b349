"""The trained operators against numeric gradients and plain scorers."""

import math
import re

import numpy as np
import pytest

from framesift.llm import language_id, mixing, quality, toxicity


def risk(z, n_p, prior):
    """Both parts of the estimator, term by term."""
    l = lambda t: math.log1p(math.exp(-t))  # noqa: E731, E741
    pos = prior * sum(l(t) for t in z[:n_p]) / n_p
    return pos, sum(l(-t) for t in z[n_p:]) / (len(z) - n_p) - prior * sum(l(-t) for t in z[:n_p]) / n_p


@pytest.mark.parametrize("shift", [0.0, 4.0])
def test_nnpu_gradient_is_numeric(shift):
    """Plain where the second part is positive; back along it where it is negative."""
    rng = np.random.default_rng(1)
    z = np.concatenate([rng.normal(shift, 1, 7), rng.normal(-shift, 1, 11)])
    g, negative = toxicity.nnpu_gradient(z, 7, 0.4)
    assert negative == pytest.approx(risk(z, 7, 0.4)[1]) and (negative < 0) == (shift > 0)
    for i in range(len(z)):
        up, down = z.copy(), z.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        (a, b), (c, d) = risk(up, 7, 0.4), risk(down, 7, 0.4)
        want = (a + b - c - d) / 2e-5 if negative >= 0 else -(b - d) / 2e-5
        assert g[i] == pytest.approx(want, abs=1e-8)


def test_negative_risk_is_met_in_training(monkeypatch):
    """With few examples that can be told apart by heart, the second part falls below zero and is brought back."""
    seen, step = [], toxicity.nnpu_gradient

    def watched(*a):
        g, n = step(*a)
        seen.append(n)
        return g, n

    monkeypatch.setattr(toxicity, "nnpu_gradient", watched)
    rng = np.random.default_rng(2)
    text = lambda k, lead: f"{lead} {' '.join(f'w{rng.integers(60)}' for _ in range(k))}".encode()
    toxicity.train_nnpu([text(8, "bad vile") for _ in range(12)], [text(8, "fine") for _ in range(30)], 0.6)
    assert min(seen) < 0 < max(seen) and seen[-1] > -0.2


def test_toxicity_scores_are_plain():
    m = toxicity.train_nnpu([b"bad vile stuff"] * 20 + [b"bad words here"] * 20, [b"good day here"] * 60 + [b"bad vile stuff"] * 5, 0.3)
    assert m.weights
    for t in (b"BAD vile bad", b"", b"unknown only", "é bad".encode(), b"good day here"):
        words = set(re.findall(rb"[a-z0-9\x80-\xff]+", t.lower()))
        z = m.bias + sum(w for k, w in m.weights.items() if k in words)
        assert m.score(t) == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-12)


#: Wide enough for maxima that are held in 32 bits.
STEP = 2e-3


def loss(buf, starts, spans, y, weight, taps, bias, out):
    top, _ = quality.chunk_maxima(buf, starts, taps, bias)
    z = quality.pooled(top, spans) @ out[:-1] + out[-1]
    return float((weight * (np.logaddexp(0, z) - y * z)).mean())


def test_quality_gradient_is_numeric():
    rng = np.random.default_rng(3)
    docs = [bytes(rng.integers(97, 105, n, dtype=np.uint8)) for n in (40, 700, 2500)]
    laid = quality.lay_out(docs)
    y, weight = np.array([1.0, 0.0, 1.0]), np.array([0.7, 1.3, 0.7])
    taps = rng.normal(0, 0.25, (quality.WIDTH, 256, quality.FILTERS))
    bias, out = rng.normal(0, 0.1, quality.FILTERS), rng.normal(0, 0.3, 3 * quality.FILTERS + 1)
    g = quality.gradients(*laid, y, weight, taps, bias, out)
    parts = {"taps": taps, "bias": bias, "out": out}
    tried = 0
    for name, size in (("out", 1), ("bias", 1), ("taps", 1)):
        flat = parts[name].reshape(-1)
        strong = np.argsort(-np.abs(g[name].reshape(-1)))[:: max(1, size)][:12]
        for i in strong:
            kept = flat[i]
            flat[i] = kept + STEP
            up = loss(*laid, y, weight, **parts)
            flat[i] = kept - STEP
            down = loss(*laid, y, weight, **parts)
            flat[i] = kept
            assert g[name].reshape(-1)[i] == pytest.approx((up - down) / (2 * STEP), abs=3e-4, rel=0.02), name
            tried += 1
    assert tried == 36


def test_quality_scores_are_plain():
    """The convolution written out for every place of every chunk."""
    rng = np.random.default_rng(4)
    docs = [bytes(rng.integers(97, 105, n, dtype=np.uint8)) for n in (0, 3, 60, 900)]
    m = quality.train_quality(docs[1:] * 4, np.array([0, 1, 0] * 4), epochs=1)
    got = quality.score_texts(docs, m)
    for d, s in zip(docs, got, strict=True):
        buf, starts, spans = quality.lay_out([d])
        tops = []
        for at in starts:
            places = range(at, at + quality.CHUNK * quality.STRIDE, quality.STRIDE)
            tops.append([math.tanh(max(sum(float(m.taps[j, buf[p + j], k]) for j in range(quality.WIDTH)) for p in places) + float(m.bias[k])) for k in range(quality.FILTERS)])
        t = np.array(tops)
        f = np.concatenate([t.max(0), t.mean(0), t.min(0)])
        z = ((f - m.shift) / m.scale) @ m.out[:-1] + m.out[-1]
        assert s == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-3)


@pytest.mark.parametrize("who", [1, 2, 3, 4, 5])
def test_mix_of_repeated_rows_is_near_its_target(spark, who):
    """60 % of a source are one row: what is taken of it ends in between."""
    rows = [(i, "w " * 10, "s1") for i in range(600)] + [(10_000 + who, "r " * 10, "s1")] * 900 + [(i, "x " * 7, None) for i in range(300)] + [(10_000 + who, "t " * 11, "s1")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    m = mixing.measure(docs, mixing.SEED)
    out = mixing.apply_mix(m, mixing.plan_mix(m))
    again = mixing.apply_mix(m, mixing.plan_mix(m))
    for r in out.groupBy("source").agg({"taken": "sum", "target": "max", "repeats": "max"}).collect():
        assert abs(r["sum(taken)"] - r["max(target)"]) <= 5.5 and r["max(repeats)"] <= 2
    key = lambda df: sorted(map(str, df.collect()))
    assert key(out) == key(again)
    whole = mixing.mix(docs)
    assert {r["source"]: r["t"] for r in whole.groupBy("source").agg({"taken": "sum"}).withColumnRenamed("sum(taken)", "t").collect()} == {r["source"]: r["t"] for r in out.groupBy("source").agg({"taken": "sum"}).withColumnRenamed("sum(taken)", "t").collect()}


def test_model_of_many_languages_is_bounded(spark):
    rng = np.random.default_rng(6)

    def text(k, n):
        own = np.random.default_rng(1000 + k)
        syllables = ["".join(own.choice(list("bcdfghklmnprstvz")) + own.choice(list("aeiou")) for _ in range(2)) for _ in range(40)]
        return " ".join(rng.choice(syllables) + rng.choice(syllables) for _ in range(n))

    rows = [(k * 10 + i, text(k, 120), f"l{k}") for k in range(40) for i in range(3)] + [(9000 + i, text(41, 5), "rare") for i in range(1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = language_id.fit_language(docs, max_languages=40, model_bytes=200_000)
    assert len(m.dictionaries) == 40 and sum(len(x) for _, own in m.dictionaries for x in own) <= 200_000
    coder = language_id.Encoder(m)
    assert coder.known is not None and len(coder.candidates(b"abcd efgh")) == language_id.CANDIDATES
    assert sum(coder.predict(text(k, 60))[0] == f"l{k}" for k in range(40)) >= 38
