"""Toxicity: non-negative positive-unlabelled learning.

Confirmed toxic examples (P) and unlabelled text (U) train a linear classifier
over the distinct words of a document. The risk is the class-prior-corrected
estimator of Kiryo et al. (2017):

    R = prior * E_P[l(+z)] + max(0, E_U[l(-z)] - prior * E_P[l(-z)])

with the logistic loss l, minimised by Adam with a soft threshold (an L1
penalty) after each step. Rows that are labelled "not toxic" are never
examples: they count as unlabelled. Their number is used for one thing, the
class prior, which is the share of toxic rows among the labelled ones.

Defined results: a null or empty text, and one without any learned word, gets
the score of the bias alone; equal texts get equal scores; a null doc_id is
never held out; other columns are ignored by the score and kept by
``score_documents``. Without one confirmed toxic row or without unlabelled
rows, every score is the prior. Empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, short_batches, table, texts

WORD = re.compile(rb"[a-z0-9\x80-\xff]+")


@dataclass(frozen=True)
class ToxicityModel:
    bias: float
    weights: dict[bytes, float] = field(default_factory=dict)

    def margin(self, text: bytes) -> float:
        w = self.weights
        return self.bias + sum(sorted(w[t] for t in w.keys() & set(WORD.findall(text.lower()))))

    def score(self, text: bytes) -> float:
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, self.margin(text))))))


def nnpu_gradient(z: np.ndarray, n_p: int, prior: float) -> tuple[np.ndarray, float]:
    """The step's gradient by the margins z (positives first), and the part of the risk that must not be negative.

    Where it is, the step goes back along that part alone: the overfit is undone first."""
    n_u = len(z) - n_p
    s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))  # l(-z)' = s, l(+z)' = s - 1
    soft = np.logaddexp(0, z)  # l(-z)
    negative = soft[n_p:].mean() - prior * soft[:n_p].mean()
    g_neg = np.concatenate([np.full(n_p, -prior / n_p), np.full(n_u, 1 / n_u)]) * s
    g_pos = np.concatenate([prior / n_p * (s[:n_p] - 1), np.zeros(n_u)])
    return (g_pos + g_neg if negative >= 0 else -g_neg), float(negative)


def train_nnpu(positive: list[bytes], unlabelled: list[bytes], prior: float, *, min_df: float = 0.01, steps: int = 300, rate: float = 0.1, l1: float = 5e-5) -> ToxicityModel:
    """Train on texts held in memory; the caller bounds their number.

    Words of fewer than a share ``min_df`` of the positive examples (at least
    3, if there are so many) get no weight. With no
    positives or no unlabelled texts the model is the prior alone."""
    prior = min(0.95, max(1e-3, prior))
    flat = ToxicityModel(float(np.log(prior / (1 - prior))))
    if not positive or not unlabelled:
        return flat
    seen: dict[bytes, int] = {}
    for t in positive:
        for w in set(WORD.findall(t.lower())):
            seen[w] = seen.get(w, 0) + 1
    least = max(min_df * len(positive), min(3, len(positive)))
    vocab = {w: i for i, w in enumerate(sorted(w for w, n in seen.items() if n >= least))}
    if not vocab:
        return flat
    # the words of a text are held one text at a time
    at = [np.array(sorted(vocab[w] for w in vocab.keys() & set(WORD.findall(t.lower()))), np.int64) for ts in (positive, unlabelled) for t in ts]
    row = np.repeat(np.arange(len(at)), [len(x) for x in at])
    col = np.concatenate(at)
    n_p = len(positive)
    w, b = np.zeros(len(vocab)), flat.bias
    m, v = np.zeros(len(vocab) + 1), np.zeros(len(vocab) + 1)
    for step in range(1, steps + 1):
        z = b + np.bincount(row, weights=w[col], minlength=len(at))
        g, _ = nnpu_gradient(z, n_p, prior)
        grad = np.append(np.bincount(col, weights=g[row], minlength=len(vocab)), g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        lr = rate * min(1, 2 * (1 - step / (steps + 1)))
        scale = lr / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
        move = scale * m / (1 - 0.9**step)
        w, b = w - move[:-1], b - move[-1]
        w = np.sign(w) * np.maximum(0, np.abs(w) - l1 * scale[:-1])
    words = list(vocab)
    return ToxicityModel(float(b), {words[i]: float(w[i]) for i in np.flatnonzero(np.abs(w) > 1e-3)})


def sample_texts(docs: DataFrame, ids: DataFrame, n: int, max_bytes: int) -> list[bytes]:
    """At most n whole texts of at most max_bytes bytes for a bounded list of ids, one for each (the first of repeated ones): for training only."""
    rows = docs.filter(F.octet_length("text").between(1, max_bytes)).join(F.broadcast(ids.limit(n)), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    return sorted(x.encode() for x in rows.toPandas()["text"])


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, n_positive: int = 1500, n_unlabelled: int = 4000, max_bytes: int = 32_768) -> ToxicityModel:
    """Fit from confirmed toxic rows of ``labels`` and unlabelled rows of ``docs``.

    The caller leaves held-out rows away. The samples are bounded:
    ``n_positive`` and ``n_unlabelled`` texts, taken in the order of a hash of
    doc_id, of at most ``max_bytes`` bytes each. The class prior is the share
    of toxic rows among all label rows given."""
    order = F.xxhash64("doc_id", F.lit(17))
    known = labels.select("doc_id", "toxic").filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    if prior is None:
        return ToxicityModel(0.0)
    pos = known.filter("toxic = 1").select("doc_id").orderBy(order, "doc_id").limit(n_positive)
    unl = docs.filter(F.col("doc_id").isNotNull() & F.octet_length("text").between(1, max_bytes)).select("doc_id").orderBy(order, "doc_id").limit(n_unlabelled).distinct()
    return train_nnpu(sample_texts(docs, pos, n_positive, max_bytes), sample_texts(docs, unl, n_unlabelled, max_bytes), prior)


def score_documents(docs: DataFrame, model: ToxicityModel, *, score: str = "toxicity") -> DataFrame:
    """Add a double column ``score``; all other columns stay as they are (one of that name is replaced)."""
    short_batches(docs.sparkSession)
    out = T.StructType([f for f in docs.schema.fields if f.name != score] + [T.StructField(score, T.DoubleType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            s = pa.array([model.score(t) for t in texts(b)], pa.float64())
            keep = [n for n in b.schema.names if n != score]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(n)) for n in keep] + [s], names=[*keep, score])

    return docs.mapInArrow(run, out)


HELD_OUT = {"k": 5, "r": 0}


def learn(spark: SparkSession, docs: DataFrame, sf_dir: str) -> ToxicityModel:
    in_fold = fold("doc_id", HELD_OUT["k"]) != HELD_OUT["r"]
    return fit_toxicity(docs.filter(in_fold), table(spark, sf_dir, "labels").filter(in_fold))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; labels of rows with crc32 mod 5 = 0 are never read."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, learn(spark, docs, sf_dir), score="score")
    return scored.select("doc_id", (fold("doc_id", HELD_OUT["k"]) == HELD_OUT["r"]).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
