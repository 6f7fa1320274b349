"""Quality: a byte-level convolutional network, trained and run in numpy.

Learned filters of ``WIDTH`` bytes slide with a stride over overlapping chunks
that cover the whole document. Each chunk keeps the maximum of every filter;
the maxima are pooled over the chunks (largest, mean and smallest) and a
logistic unit combines them into one probability.

Defined results: a null text is the empty text, which is one chunk of zero
bytes; equal texts get equal scores; other columns pass through; with labels
of one class only, or none, the score is the share of label 1 (0.5 if none).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, short_batches, table, texts

WIDTH, STRIDE, FILTERS = 8, 4, 16
#: Filter positions of a chunk, and by how many the next chunk is further on.
CHUNK, HOP = 96, 80
TILE = 1024


@dataclass(frozen=True)
class QualityModel:
    taps: np.ndarray  # (WIDTH, 256, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    out: np.ndarray  # (3 * FILTERS + 1,)
    shift: np.ndarray  # (3 * FILTERS,)
    scale: np.ndarray  # (3 * FILTERS,)


def lay_out(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all documents one after another, each padded to whole chunks; chunk starts; chunks of each document."""
    spans = [max(1, -(-max(0, -(-len(d) // STRIDE) - CHUNK) // HOP) + 1) for d in docs]
    size = [((n - 1) * HOP + CHUNK) * STRIDE + WIDTH for n in spans]
    buf = np.zeros(sum(size), np.uint8)
    starts, at = [], 0
    for d, n, s in zip(docs, spans, size, strict=True):
        buf[at : at + len(d)] = np.frombuffer(d, np.uint8)
        starts.append(at + np.arange(n) * (HOP * STRIDE))
        at += s
    return buf, np.concatenate(starts), np.array(spans)


def chunk_maxima(buf: np.ndarray, starts: np.ndarray, taps: np.ndarray, bias: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Largest response of each filter in each chunk, tile by tile, and its byte position if asked for."""
    top = np.empty((len(starts), taps.shape[2]), np.float32)
    pos = np.empty(top.shape, np.int64) if where else None
    step = np.arange(CHUNK) * STRIDE
    for i in range(0, len(starts), TILE):
        at = (starts[i : i + TILE, None] + step).ravel()
        a = taps[0].take(buf[at], axis=0)
        for j in range(1, WIDTH):
            a += taps[j].take(buf[at + j], axis=0)
        a = a.reshape(-1, CHUNK, taps.shape[2])
        top[i : i + TILE] = a.max(axis=1)
        if where:
            pos[i : i + TILE] = starts[i : i + TILE, None] + a.argmax(axis=1) * STRIDE
    return np.tanh(top + bias), pos


def pooled(top: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Largest, mean and smallest chunk maximum of every document."""
    first = np.concatenate([[0], np.cumsum(spans)[:-1]])
    return np.concatenate([np.maximum.reduceat(top, first), np.add.reduceat(top, first) / spans[:, None], np.minimum.reduceat(top, first)], axis=1)


def score_texts(docs: list[bytes], m: QualityModel) -> np.ndarray:
    if not docs:
        return np.zeros(0)
    buf, starts, spans = lay_out(docs)
    f = pooled(chunk_maxima(buf, starts, m.taps, m.bias)[0], spans)
    z = (np.round(f.astype(np.float64), 6) - m.shift) / m.scale
    return np.round(1 / (1 + np.exp(-np.clip((z * m.out[:-1]).sum(axis=1) + m.out[-1], -30, 30))), 9)


def gradients(buf: np.ndarray, starts: np.ndarray, spans: np.ndarray, y: np.ndarray, weight: np.ndarray, taps: np.ndarray, bias: np.ndarray, out: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean weighted log loss of a batch of documents, by filters, their bias and the logistic unit."""
    top, pos = chunk_maxima(buf, starts, taps, bias, where=True)
    f = pooled(top, spans)
    p = 1 / (1 + np.exp(-np.clip(f @ out[:-1] + out[-1], -30, 30)))
    g = (p - y) * weight / len(y)
    gf = g[:, None] * out[:-1]
    doc = np.repeat(np.arange(len(y)), spans)
    big, mean, low = gf[:, :FILTERS], gf[:, FILTERS : 2 * FILTERS], gf[:, 2 * FILTERS :]
    # overlapping chunks can share their largest place: they share its gradient too
    first = np.concatenate([[0], np.cumsum(spans)[:-1]])
    held = [top == f[doc, i : i + FILTERS] for i in (0, 2 * FILTERS)]
    most, least = (h / np.add.reduceat(h.astype(np.float64), first)[doc] for h in held)
    g_top = mean[doc] / spans[doc, None] + big[doc] * most + low[doc] * least
    g_top *= 1 - top * top
    grads = {"taps": np.zeros(taps.shape), "bias": g_top.sum(axis=0), "out": np.append(f.T @ g, g.sum())}
    which = np.broadcast_to(np.arange(FILTERS), pos.shape).ravel()
    for j in range(WIDTH):
        flat_at = buf[pos.ravel() + j].astype(np.int64) * FILTERS + which
        grads["taps"][j] = np.bincount(flat_at, weights=g_top.ravel(), minlength=256 * FILTERS).reshape(256, FILTERS)
    return grads


def train_quality(docs: list[bytes], labels: np.ndarray, *, epochs: int = 14, batch: int = 48, rate: float = 0.01, seed: int = 7) -> QualityModel:
    """Train on texts held in memory; the caller bounds their number."""
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, np.float64)
    taps = rng.normal(0, 0.25, (WIDTH, 256, FILTERS)).astype(np.float32)
    bias, out = np.zeros(FILTERS, np.float32), np.zeros(3 * FILTERS + 1)
    flat = QualityModel(taps, bias, out, np.zeros(3 * FILTERS), np.ones(3 * FILTERS))
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or share in (0.0, 1.0):
        out[-1] = np.log(max(1e-3, share) / max(1e-3, 1 - share))
        return flat
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    laid = [lay_out([d]) for d in docs]
    out[: 3 * FILTERS] = rng.normal(0, 0.1, 3 * FILTERS)
    parts = {"taps": taps, "bias": bias, "out": out}
    m1 = {k: np.zeros(v.shape) for k, v in parts.items()}
    m2 = {k: np.zeros(v.shape) for k, v in parts.items()}
    t = 0
    for epoch in range(epochs):
        lr = rate * (1 if epoch < epochs * 0.6 else 0.3)
        for ids in np.array_split(rng.permutation(len(docs)), max(1, len(docs) // batch)):
            buf = np.concatenate([laid[i][0] for i in ids])
            offset = np.concatenate([[0], np.cumsum([len(laid[i][0]) for i in ids])[:-1]])
            starts = np.concatenate([laid[i][1] + o for i, o in zip(ids, offset, strict=True)])
            spans = np.concatenate([laid[i][2] for i in ids])
            grads = gradients(buf, starts, spans, y[ids], weight[ids], taps, bias, out)
            t += 1
            for k, v in parts.items():
                gr = grads[k] + (1e-4 * v if k != "bias" else 0)
                m1[k] = 0.9 * m1[k] + 0.1 * gr
                m2[k] = 0.999 * m2[k] + 0.001 * gr * gr
                v -= (lr * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.999**t)) + 1e-7)).astype(v.dtype)
    # the logistic unit once more, on all pooled features, both classes weighing alike
    f = np.concatenate([np.round(pooled(chunk_maxima(b, s, taps, bias)[0], n).astype(np.float64), 6) for b, s, n in laid])
    shift, scale = f.mean(axis=0), f.std(axis=0) + 1e-3
    z = np.concatenate([(f - shift) / scale, np.ones((len(f), 1))], axis=1)
    w = np.zeros(z.shape[1])
    ridge = np.diag(np.append(np.full(z.shape[1] - 1, 0.02 * len(y) / 10), 1e-6))
    for _ in range(20):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge
        w -= np.linalg.solve(h, z.T @ (weight * (p - y)) + ridge @ w)
    return QualityModel(taps, bias, w, shift, scale)


def fit_quality(docs: DataFrame, labels: DataFrame, *, n_each: int = 1200, max_bytes: int = 16_384) -> QualityModel:
    """Fit from bounded samples: ``n_each`` labelled rows of either class, in the
    order of a hash of doc_id, with texts of at most ``max_bytes`` bytes. The
    caller leaves held-out rows away."""
    order = F.xxhash64("doc_id", F.lit(31))
    known = labels.select("doc_id", "quality").filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("label"))
    ids = [known.filter(F.col("label") == c).orderBy(order, "doc_id").limit(n_each) for c in (0, 1)]
    rows = docs.select("doc_id", "text").filter(F.octet_length("text").between(1, max_bytes))
    got = rows.join(F.broadcast(ids[0].unionAll(ids[1])), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).toPandas().sort_values(["text", "label"])
    return train_quality([x.encode() for x in got["text"]], got["label"].to_numpy())


def score_quality(docs: DataFrame, model: QualityModel, *, score: str = "quality_score") -> DataFrame:
    """Add a double column ``score``; all other columns stay (one of that name is replaced)."""
    short_batches(docs.sparkSession)
    out = T.StructType([f for f in docs.schema.fields if f.name != score] + [T.StructField(score, T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            s = pa.array(score_texts(texts(b), sent.value), pa.float64())
            keep = [n for n in b.schema.names if n != score]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(n)) for n in keep] + [s], names=[*keep, score])

    return docs.mapInArrow(run, out)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; labels of rows with crc32 mod 4 = 2 are never read."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold("doc_id", 4) == 2
    model = fit_quality(docs.filter(~held_out), table(spark, sf_dir, "labels").filter(~held_out))
    scored = score_quality(docs, model, score="score")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
