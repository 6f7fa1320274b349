"""Work of the queries named in the findings of round 3: what grows with the rows, and the same results as before."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framesift.operators import cluster as C
from framesift.operators import groups as G
from framesift.operators import search as S
from framesift.operators import similarity as M
from framesift.plans import library, registry
from framesift.sources import files

SF = "/root/testdata/sf0.001"
QUERIES = registry.queries()


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_frames_of_no_series_are_not_one_tasks(spark):
    """all frames without a series have one group_id, and had met in one task of the join."""
    rows = spark.range(4000).repartition(8).select("id", F.when(F.col("id") % 100 == 0, F.concat(F.lit("g"), F.col("id") % 3)).otherwise("").alias("group_id"), F.lit("selected").alias("status"), F.lit(0).alias("rating"), F.lit(1.0).alias("ai_score"), F.array(F.concat(F.lit("p"), F.col("id"))).alias("persons"), F.array().cast("array<string>").alias("tags"))
    got = files.sidecars(rows, rows)
    assert got.count() == 4000 and got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 1500
    xmp = {r["id"]: r["xmp"] for r in got.filter("id in (0, 1, 300)").collect()}
    assert ">p300<" in xmp[0] and ">p0<" in xmp[300] and ">p1<" in xmp[1] and ">p0<" not in xmp[1]


@pytest.mark.parametrize("by", [None, "user_id"])
def test_moments_by_buckets(spark, by):
    """runs are those of a plain pass, and no window runs over frames."""
    rng, day = random.Random(6), 86_400_000
    times = [-5, -901_000, 0, 899_999, 900_000, 1_800_000, 2_700_001, 12 * day, 12 * day + 900_000, 12 * day + 900_000] + [rng.randrange(-3 * day, 9 * day) for _ in range(1500)]
    rows = [(i, t, rng.choice([None, 1, 2])) for i, t in enumerate(times)] + [(5000, None, 1)]
    rng.shuffle(rows)
    want = {}
    for key in {r[2] if by else 0 for r in rows}:
        runs = []
        for t, i in sorted((r[1], r[0]) for r in rows if r[1] is not None and (not by or r[2] == key)):
            if not runs or t - runs[-1][-1][0] > G.GAP_MS:
                runs.append([])
            runs[-1].append((t, i))
        want |= {i: run[0][1] for run in runs if len(run) >= 4 for _, i in run}
    out = G.stacks(spark.createDataFrame(rows, "id long, captured_at long, user_id long"), by=by)
    assert {r["id"]: r["moment"] for r in out.collect()} == want and want
    assert "Window" not in plan(out)


def test_texts_are_folded_once(spark):
    """the texts of a photo are worked out once for all searches, and places once for each spot."""
    p = plan(QUERIES["search_text"](spark, SF))
    assert p.count("translate(") == 1
    rows = spark.createDataFrame([("IMG_1.jpg", None, ["Ștefan", "Ana"], ["tag1", "snow"], 1_785_283_200_000), ("", "Évora ΣΑΣ", None, ["Texture"], None), ("a", "b", [None], [], 0)], "file_name string, caption string, persons array<string>, tags array<string>, captured_at long")
    queries = [*library.NEEDLES, "", "stef", "ana", "annasnow", "jpg2026", "σας", "2026 iulie", "ab", "pisica", "textura"]
    for labels in (None, library.LABELS_RO):
        old, new = S.search_texts(rows.columns, labels), S.searched_texts(rows.columns, labels)
        got = rows.select(*[(F.coalesce(S.matches(q, old), F.lit(False)) == F.coalesce(S.found_in(q, new), F.lit(False))).alias(f"q{i}") for i, q in enumerate(queries)]).collect()
        assert all(all(r) for r in got)


@pytest.mark.parametrize("bucket, group", [(1 << 18, 1024), (40, 8)])
def test_close_hashes(spark, monkeypatch, bucket, group):
    """pairs and components are those of brute force, also where all hashes share bands and buckets are cut into blocks; no hash is dealt out under flipped bits."""
    monkeypatch.setattr(M, "BUCKET", bucket)
    monkeypatch.setattr(M, "GROUP", group)
    rng = random.Random(8)
    hs = [rng.getrandbits(64) for _ in range(60)]
    hs += [h ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(9))) for h in hs for _ in range(3)]
    hs += [(1 << 63) | sum(1 << b for b in rng.sample(range(12), rng.randrange(7))) for _ in range(150)]
    ids = list(range(100, 100 + len(hs)))
    rng.shuffle(ids)
    rows = dict(zip(ids, hs, strict=True))
    first = {}
    for i in sorted(rows):
        first.setdefault(rows[i], i)
    one = list(first.items())
    df = spark.createDataFrame([(i, h - (1 << 64) if h >> 63 else h) for i, h in rows.items()] + [(1, None)], "id long, h long")
    for radius in (0, 3, 4, 6):
        want = {(min(i, j), max(i, j), d) for k, (h, i) in enumerate(one) for g, j in one[:k] if (d := (h ^ g).bit_count()) <= radius} | {(first[h], i, 0) for i, h in rows.items() if first[h] != i}
        out = M.hamming_pairs(df, radius)
        got = [tuple(r) for r in out.collect()]
        assert len(got) == len(set(got)) and set(got) == want
        root = {i: i for p in want for i in p[:2]}
        for _ in root:
            old = dict(root)
            for a, b, _ in want:
                root[a] = root[b] = min(root[a], root[b])
            if old == root:
                break
        assert {tuple(r) for r in M.hamming_components(df, radius).collect()} == set(root.items())
        assert "xor" not in plan(out) and " ^ " not in plan(out)


@pytest.mark.parametrize("ahead, tile", [(8192, 256), (16, 5)])
def test_faces_meet_seeds_only(spark, monkeypatch, ahead, tile):
    """clusters are those of one greedy pass, also in many rounds and with vectors of zeros, and pairs of faces are not made."""
    monkeypatch.setattr(C, "AHEAD", ahead)
    monkeypatch.setattr(C, "TILE", tile)
    monkeypatch.setattr(M, "cosine_pairs", None)
    monkeypatch.setattr(C, "components", None)
    rng = np.random.default_rng(9)
    m = rng.standard_normal((120, 8))
    m[[7, 50, 51]] = 0
    u = m / np.maximum(np.linalg.norm(m, axis=1), 1e-300)[:, None]
    seeds, label = [], []
    for i in range(len(u)):
        hit = [s for s in seeds if u[s] @ u[i] >= 0.5]
        label.append(hit[0] if hit else i)
        if not hit:
            seeds.append(i)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>").repartition(3)
    for size in (1, 2):
        want = {(i, c) for i, c in enumerate(label) if label.count(c) >= size}
        assert {tuple(r) for r in C.face_clusters(df, 0.5, size).collect()} == want
    assert C.face_clusters(df.limit(0), 0.5).count() == 0


def test_cosines_of_a_tile(spark, monkeypatch):
    """a task holds the cosines of TILE vectors with a block, whatever the block's size; pairs are those of brute force."""
    rng = np.random.default_rng(10)
    m = rng.standard_normal((90, 6))
    u = m / np.linalg.norm(m, axis=1)[:, None]
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if u[i] @ u[j] >= 0.4}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    for tile, blocks in ((7, 1), (7, 3), (1000, 4)):
        monkeypatch.setattr(M, "TILE", tile)
        got = M.cosine_pairs(df, 0.4, blocks=blocks).collect()
        assert len(got) == len(want) and {(r["a"], r["b"]) for r in got} == want
        assert all(abs(r["cosine"] - u[r["a"]] @ u[r["b"]]) < 1e-12 for r in got)
    assert M.TILE * M.BLOCK * 8 <= 64 << 20
