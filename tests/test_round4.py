"""What the findings of round 4 asked for."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framesift.llm import compact_windows as W
from framesift.operators import cluster as C
from framesift.operators import scoring as S
from framesift.operators import similarity as M
from framesift.plans import learning
from framesift.streaming import library as L


def broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Broadcast")


def test_rows_with_flipped_bits_are_never_broadcast(spark):
    df = spark.createDataFrame([(i, i * 7919) for i in range(200)], "id long, h long")
    assert not broadcasts(M.hamming_pairs(df, 14, probes=F.col("id") < 20))


@pytest.mark.parametrize("asked", [1 << 16, 40, 0])
def test_islands_are_joined_by_near_hashes(spark, monkeypatch, asked):
    """All outside rows at once; only after close hashes have joined islands; by bands."""
    monkeypatch.setattr(C, "ASKED", asked)
    monkeypatch.setattr(C, "COMPARED", 500)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 30)
    rows = []
    for i in range(300):
        h = int(base[rng.integers(30)])
        for bit in rng.choice(64, rng.integers(0, 12), replace=False):
            h ^= 1 << int(bit)
        rows.append((i, None if i % 50 == 49 else h - (1 << 64) if h >= 1 << 63 else h, 0 if i % 3 else i))
    df = spark.createDataFrame(rows, "id long, h long, island long").repartition(3)
    root = {r[2]: r[2] for r in rows}
    for _, x, i in rows:
        for _, y, j in rows:
            if x is not None and y is not None and ((x ^ y) & (1 << 64) - 1).bit_count() <= 14 and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = {k: a if r == b else r for k, r in root.items()}
    got = {r["node"]: r["root"] for r in M.components(C.near_islands(df, 14)).collect()}
    assert {k: got.get(k, k) for k in root} == root and len(set(root.values())) > 2


def test_logs_are_learned_from_in_slices(spark, tmp_path, monkeypatch):
    """Rows of numbers, in several triggers in order of time, and rows with other features or numbers that aren't finite, as one by one; each trigger takes a part."""
    rng = np.random.default_rng(5)
    some = lambda: {k: float(rng.choice([0.0, 0.5, rng.random(), 3.0])) for k in rng.choice(S.NAMES, 12, replace=False)}
    rows = []
    for i in rng.permutation(120).tolist():
        for pos in range(1 + i % 3):
            x = some() | ({"other": 0.3} if i % 20 == 7 else {"sharpness": float("nan")} if i % 20 == 8 else {})
            rows.append((f"c{i % 2}", x, some() if i % 3 else None, bool(i % 5), bool(i % 4), i // 2, i, pos, pos == i % 3))
    log = spark.createDataFrame(rows, S.EVENT)
    triggers = []
    q = L.learner(L.in_slices(log, str(tmp_path), 60)).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/at").foreachBatch(lambda b, i: triggers.append(b.collect())).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["context_key"]: r for b in triggers for r in b}
    assert len([b for b in triggers if b]) > 2 and got.keys() == {"c0", "c1", S.GLOBAL}
    for k, r in got.items():
        m = S.Model()
        for e in sorted(log.collect(), key=lambda e: (e["ts"], e["id"], e["pos"])):
            if k in (e["context_key"], S.GLOBAL):
                m.take(e)
        assert r["n"] == m.n and r["bias"] == pytest.approx(m.bias, abs=1e-10) and r["weights"] == pytest.approx(m.weights, abs=1e-10)


def test_features_are_made_of_photos_of_the_log_only(spark):
    """The joins of the log take no maps of all photos: what is read of them is cut first."""
    assert not [f for f in learning.event_log(spark, "/root/testdata/sf0.001").inputFiles() if "events.parquet" in f]


def test_boxes_of_all_pairs_are_merged_as_those_of_one():
    rng = np.random.default_rng(11)
    at = rng.integers(0, 60, (900, 2))
    rows = np.column_stack([rng.integers(-3, 3, (900, 2)), at[:, 0], at[:, 0] + rng.integers(0, 9, 900), at[:, 1], at[:, 1] + rng.integers(0, 9, 900)])
    rows = rows[rng.random(900) < 0.2 + 0.8 * (rows[:, 0] > 0)]
    want = {(x, y, *box) for x, y in {tuple(r[:2]) for r in rows.tolist()} for box in W.merged(np.unique(rows[(rows[:, :2] == (x, y)).all(axis=1), 2:], axis=0))}
    got = [tuple(r) for r in W.merged_pairs(rows).tolist()]
    assert set(got) == want and len(got) == len(want) > 60


def test_pairs_that_share_too_little_are_passed_over_without_a_loss(monkeypatch):
    rng = np.random.default_rng(12)
    pairs = []
    for i in range(600):
        x = rng.permutation(1000)[: rng.integers(46, 160)].astype(np.uint64)
        y = x[rng.integers(0, 40) :].copy()
        y[rng.random(len(y)) < rng.random() * 0.6] += np.uint64(5000)
        if i % 3 == 0:  # tokens that come again, on one side or both
            x = np.concatenate([x, x[:30]])
        if i % 2 == 0:
            y = np.concatenate([y[:20], y])
        pairs.append((x, y))
    told = [W.passages_of(x, y) for x, y in pairs]
    asked = []
    places = W.places
    monkeypatch.setattr(W, "places", lambda *a: asked.append(1) or places(*a))
    assert told == [W.passages_of(x, y) for x, y in pairs]
    few = len(asked)
    monkeypatch.setattr(W, "LEAST_SHARED", 0)
    assert told == [W.passages_of(x, y) for x, y in pairs] and few < len(asked) - few and 50 < sum(map(bool, told)) < 550
