"""Queries that SQL can't express, against plain versions that go row by row."""

import math

import numpy as np
import pytest

from framesift.operators import cluster as C
from framesift.plans import advanced, gallery, registry
from framesift.sources.bindings import photos, table

SF = "/root/testdata/sf0.001"
QUERIES = registry.queries()


def cosine(x, y):
    n = min(len(x), len(y))
    a, b = math.sqrt(sum(v * v for v in x[:n])), math.sqrt(sum(v * v for v in y[:n]))
    return sum(p * q for p, q in zip(x[:n], y[:n])) / (a * b) if a and b else 0.0


def surely(a, b):
    if a["faces"] and b["faces"]:
        return max(cosine(x, y) for x in a["faces"] for y in b["faces"]) >= 0.5
    if a["image"] and b["image"]:
        return cosine(a["image"], b["image"]) >= 0.75
    return None


def maybe(a, b):
    if (s := surely(a, b)) is not None:
        return s
    odd = bool(a["faces"] or a["face_count"]) != bool(b["faces"] or b["face_count"])
    if None in (a["composition_score"], b["composition_score"], a["color_harmony"], b["color_harmony"]):
        return not odd
    x, y = abs(a["composition_score"] - b["composition_score"]) > 0.4, abs(a["color_harmony"] - b["color_harmony"]) > 0.35
    return not ((x or y) if odd else (x and y))


def test_near_duplicate_series(spark):
    rows = sorted((r.asDict() for r in advanced.frames(spark, SF).collect()), key=lambda r: r["id"])
    buckets = []
    close = lambda r, b, ms: r["captured_at"] is not None and any(m["captured_at"] is not None and abs(m["captured_at"] - r["captured_at"]) <= ms for m in b)
    for r in rows:
        for b in buckets:
            d = bin((r["h"] ^ b[0]["h"]) & (1 << 64) - 1).count("1")
            if d <= 14 or d <= 24 and close(r, b, 45_000) or d <= 30 and close(r, b, 480_000) and any(surely(r, m) for m in b):
                b.append(r)
                break
        else:
            buckets.append([r])
    want = set()
    for b in buckets:
        parts = [[m] for m in b] if 2 <= len(b) <= 200 else [b]
        while True:
            pair = next(((i, j) for j in range(len(parts)) for i in range(j) if any(maybe(x, y) for x in parts[i] for y in parts[j])), None) if len(b) <= 200 else None
            if pair is None:
                break
            parts[pair[0]] += parts.pop(pair[1])
        want |= {(m["id"], min(x["id"] for x in p)) for p in parts if len(p) > 1 for m in p}
    got = {tuple(r) for r in QUERIES["near_duplicate_series"](spark, SF).select("id", "series").collect()}
    assert got == want and len({s for _, s in want}) > 10


def test_face_clusters(spark):
    seeds, label = [], {}
    rows = sorted(table(spark, SF, "embeddings").collect(), key=lambda r: r["vec_id"])
    v = {r["vec_id"]: np.array(r["embedding"], float) for r in rows}
    for i, x in v.items():
        hit = next((s for s in seeds if x @ v[s] / np.linalg.norm(x) / np.linalg.norm(v[s]) >= 0.35), None)
        label[i] = i if hit is None else hit
        if hit is None:
            seeds.append(i)
    sizes = list(label.values())
    want = {(i, s) for i, s in label.items() if sizes.count(s) >= 2}
    assert {tuple(r) for r in QUERIES["face_clusters"](spark, SF).select("vec_id" if "vec_id" in QUERIES["face_clusters"](spark, SF).columns else "id", "cluster").collect()} == want and want


def km(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 12742 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


@pytest.fixture(scope="module")
def placed(spark):
    clusters, label = [], {}
    for r in sorted(photos(spark, SF, "id", "lat", "lon").filter("lat is not null").collect(), key=lambda r: r["id"]):
        near = sorted((km(c[0], c[1], r["lat"], r["lon"]), k) for k, c in enumerate(clusters))
        if near and near[0][0] <= 0.4:
            c = clusters[near[0][1]]
            c[2] += 1
            c[0] += (r["lat"] - c[0]) / c[2]
            c[1] += (r["lon"] - c[1]) / c[2]
        else:
            clusters.append(c := [r["lat"], r["lon"], 1, r["id"]])
        label[r["id"]] = c[3]
    return label


def test_proximity_clusters(spark, placed):
    assert {tuple(r) for r in QUERIES["proximity_clusters"](spark, SF).select("id", "place").collect()} == set(placed.items()) and len(set(placed.values())) > 10


def test_locations(spark, placed):
    p = {r["id"]: r for r in photos(spark, SF, "id", "lat", "lon", "captured_at").filter("lat is not null").collect()}
    groups = {}
    for i, place in placed.items():
        groups.setdefault(place, []).append(i)
    cells = {}
    for i in sorted(p):
        cells.setdefault((math.floor(p[i]["lat"] / 0.5), math.floor(p[i]["lon"] / 0.5)), []).append(i)
    home = max(cells.values(), key=lambda c: (len(c), -c[0]))
    mean = lambda ids, k: sum(p[i][k] for i in ids) / len(ids)
    for r in QUERIES["locations"](spark, SF).collect():
        own = groups.pop(r["place"])
        lat, lon = mean(own, "lat"), mean(own, "lon")
        times = [p[i]["captured_at"] for i in own]
        assert r["n"] == len(own) and r["start_ms"] == min(times) and r["end_ms"] == max(times)
        best = min(km(lat, lon, p[i]["lat"], p[i]["lon"]) for i in own)
        assert km(lat, lon, p[r["anchor_id"]]["lat"], p[r["anchor_id"]]["lon"]) == pytest.approx(best, abs=1e-9) and r["anchor_id"] in own
        assert r["home_km"] == pytest.approx(km(mean(home, "lat"), mean(home, "lon"), lat, lon), abs=1e-5)
    assert not groups


def test_person_tracks(spark):
    rows = gallery.seen(spark, SF).filter("nullif(group_id, '') is not null").select("group_id", "id", "faces").collect()
    by = {}
    for r in rows:
        by.setdefault(r["group_id"], []).append(r)
    want = set()
    for series, frames in by.items():
        heads, best, names = [], {}, {}
        for r in sorted(frames, key=lambda r: r["id"]):
            for n, f in enumerate(r["faces"]):
                if r["id"] % 7 == 0:
                    continue
                v = [math.cos(f["similarity"] * k + n) for k in (1, 2, 3)]
                t = max(((cosine(v, h), i) for i, h in enumerate(heads) if cosine(v, h) >= 0.5), default=(0, -1))[1]
                if t < 0:
                    t = len(heads)
                    heads.append(v)
                best[r["id"], t] = max(best.get((r["id"], t), -1), f["smile"])
                if f["name"]:
                    names.setdefault(t, f["name"])
        want |= {(series, t, f, q, names.get(t)) for (f, t), q in best.items()}
    got = {tuple(r) for r in QUERIES["person_tracks"](spark, SF).select("series", "track", "frame", "quality", "name").collect()}
    assert got == want and want


def plain_strip(frames):
    """Frames [(id, faces)] of a series: cells {(track, frame): face} and (match, blinks, named) of each track."""
    if len(frames) < 2 or not frames[0][1]:
        return {}, []
    first, faces = frames[0]
    order = ["position", "embedding", "person"]
    rows = [{"seed": f, "match": "person" if f["person"] else "embedding" if f["v"] else "position", "blinks": int(f["blinking"])} for f in faces]
    cells = {(t, first): f["face"] for t, f in enumerate(faces)}
    for frame, found in frames[1:]:
        taken = set()
        for t, row in enumerate(rows):
            seed, pick, how = row["seed"], None, None
            free = [f for f in found if f["face"] not in taken]
            if seed["person"]:
                pick = next((f for f in free if f["person"] == seed["person"]), None)
                how = "person"
            if pick is None and seed["v"]:
                near = [(cosine(seed["v"], f["v"]), -f["face"], f) for f in free if f["v"] and len(f["v"]) == len(seed["v"])]
                near = [x for x in near if x[0] >= 0.62]
                if near:
                    pick, how = max(near, key=lambda x: x[:2])[2], "embedding"
            if pick is None:
                near = [(math.hypot(seed["x"] - f["x"], seed["y"] - f["y"]), f["face"], f) for f in free]
                near = [x for x in near if x[0] <= 0.18]
                if near:
                    pick, how = min(near, key=lambda x: x[:2])[2], "position"
            cells[t, frame] = pick and pick["face"]
            if pick:
                taken.add(pick["face"])
                row["blinks"] += pick["blinking"]
                row["match"] = min(row["match"], how, key=order.index)
    return cells, [(r["match"], r["blinks"], bool(r["seed"]["name"])) for r in rows]


def test_face_tracks(spark):
    by = {}
    for r in advanced.strip_faces(spark, SF).collect():
        by.setdefault(r["series"], {}).setdefault(r["frame"], [])
        if r["face"] is not None:
            by[r["series"]][r["frame"]].append(r.asDict())
    want = set()
    for series, frames in by.items():
        cells, rows = plain_strip([(k, sorted(v, key=lambda f: f["face"])) for k, v in sorted(frames.items())])
        places = sorted(range(len(rows)), key=lambda t: (-rows[t][1], not rows[t][2], t))
        want |= {(series, t, f, face, rows[t][0], rows[t][1], places.index(t) + 1) for (t, f), face in cells.items()}
    got = {tuple(r) for r in QUERIES["face_tracks"](spark, SF).select("series", "track", "frame", "face", "match", "blink_count", "place").collect()}
    assert got == want and {w[4] for w in want} == {"person", "embedding", "position"} and any(w[3] is None for w in want)


def shows(n, mixed=False):
    """Frames with faces of one or two vectors, pictures, neither; some of no length (never alike) and, if mixed, of several lengths."""
    rng = np.random.default_rng(7)
    vector = lambda: [0.0] * 6 if rng.random() < 0.03 else rng.normal(size=4 + rng.integers(3) if mixed else 6).tolist()
    out = []
    for i in range(n):
        r = {"faces": [vector() for _ in range(1 + i % 2)] if i % 3 == 0 else None, "image": vector() if i % 3 == 1 else None, "composition_score": None if i % 7 == 0 else float(rng.random()), "color_harmony": float(rng.random()), "face_count": i % 2}
        out += [r, dict(r)] if i % 5 == 0 else [r]
    return out


@pytest.mark.parametrize("mixed", [False, True])
def test_a_series_of_any_length_is_split(mixed):
    rows = [r for r in shows(400, mixed) if r["faces"] or r["image"]]  # over 200 of them
    assert len(rows) > 200
    for kept in (rows, shows(60, mixed)):
        root = list(range(len(kept)))
        for i in range(len(kept)):
            for j in range(i):
                if root[i] != root[j] and maybe(kept[i], kept[j]):
                    a, b = sorted((root[i], root[j]))
                    root = [a if r == b else r for r in root]
        assert C.split_series([C.Subject(tuple(r[c] for c in C.SUBJECT_COLUMNS)) for r in kept]) == root


def test_a_long_series_of_two_subjects_is_two(spark):
    rows = [(i, 0, i, [[1.0, 0.0]] if i % 2 else [[0.0, 1.0]]) for i in range(240)]
    photos = spark.createDataFrame(rows, "id long, h long, captured_at long, faces array<array<double>>")
    assert {tuple(r) for r in C.near_duplicate_series(photos).collect()} == {(i, i % 2) for i in range(240)}
