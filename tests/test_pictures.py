"""Kernels, edits and automatic adjustments by hand-made frames, and their queries against plain versions."""

import hashlib
import math

import numpy as np
import pytest

from framesift.operators import autoedit as U
from framesift.operators import edits as E
from framesift.operators import pixels as K
from framesift.plans import pictures, registry
from framesift.sources.bindings import photos

SF = "/root/testdata/sf0.001"
QUERIES = registry.queries()
grey = lambda v: np.repeat(np.asarray(v, np.uint8)[..., None], 3, axis=2)


@pytest.fixture(scope="module")
def made(spark):
    rows = photos(spark, SF, "id", "user_id").collect()
    return {r["id"]: pictures.picture(np.array([r["id"]]), np.array([r["user_id"]]))[0].reshape(16, 24, 3) for r in rows}


# kernels


def plain_area(a, w, h):
    """Each cell by its share of every pixel."""
    out = np.zeros((h, w, 3), np.uint8)
    H, W = a.shape[:2]
    for y in range(h):
        for x in range(w):
            total, n = np.zeros(3), 0.0
            for i in range(H):
                cy = max(0, min((y + 1) * H / h, i + 1) - max(y * H / h, i))
                for j in range(W):
                    c = cy * max(0, min((x + 1) * W / w, j + 1) - max(x * W / w, j))
                    if c:
                        total, n = total + c * a[i, j], n + c
            out[y, x] = np.rint(total / n)
    return out


def test_areas_that_do_not_divide():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, (7, 11, 3)).astype(np.uint8)
    for w, h in ((9, 8), (4, 3), (11, 7), (1, 1)):
        assert np.abs(K.area(a, w, h).astype(int) - plain_area(a, w, h)).max() <= 1
    assert (K.area(a, 11, 7) == a).all()


def test_pyramid(spark, made):
    rows = QUERIES["frame_pyramids"](spark, SF).collect()
    assert len(rows) == 3 * len(made)
    for r in rows[::97]:
        a = made[r["id"]]
        assert (r["width"], r["height"]) == {"thumb": (10, 7), "tiny": (5, 3), "hash": (9, 8)}[r["name"]]
        assert r["digest"] == hashlib.sha256(K.area(a, r["width"], r["height"]).tobytes()).hexdigest()
        y = K.area(a, 9, 8).astype(float) @ [0.299, 0.587, 0.114]
        bits = int("".join(str(int(y[i, j] > y[i, j + 1])) for i in range(8) for j in range(8)), 2)
        assert r["dhash"] & (1 << 64) - 1 == bits
    f = K.pyramid(spark.createDataFrame([(1, 0, 0, b""), (2, 2, 2, b"x"), (3, None, None, None)], "id int, width int, height int, pixels binary"))
    assert [r["levels"] for r in f.collect()] == [None] * 3


def test_kernels_on_hand_made_frames():
    h, w = 60, 80
    y, x = np.mgrid[0:h, 0:w]
    lines = grey(np.where((x + y) % 16 < 8, 40, 200))
    assert K.leading_lines(lines) and not K.leading_lines(grey(np.full((h, w), 90)))
    rng = np.random.default_rng(2)
    assert not K.leading_lines(grey(rng.integers(0, 255, (h, w))))
    half = np.zeros((h, 40))
    half[10:30, 5:20] = 200
    assert K.symmetry(grey(np.concatenate([half, half[:, ::-1]], axis=1)))
    other = np.zeros((h, 40))
    other[40:55, 25:38] = 200
    assert not K.symmetry(grey(np.concatenate([half, other], axis=1))) and not K.symmetry(grey(np.full((h, w), 9)))
    noise = rng.integers(0, 255, (h, w))
    noise[:, 40:] = 120
    assert K.negative_space(grey(noise)) == 0.5 and K.negative_space(grey(np.full((h, w), 9))) == 1.0
    hist = K.histogram(np.array([[[0, 0, 0]] * 4, [[255, 10, 10]] * 4, [[128, 128, 128]] * 4], np.uint8), stride=4)
    assert hist["shadows"] == hist["highlights"] == pytest.approx(1 / 3) and hist["peak"] == 1 and hist["r"][0] == hist["r"][63] == hist["luma"][32] == 1 and sum(hist["luma"]) == 3
    assert K.histogram(np.zeros((1, 4, 3), np.uint8), stride=1)["peak"] == 4


def plain_colours(a):
    """Bins of hue by hand."""
    px = a.reshape(-1, 3)[::2]
    weight, sums, sats = [0.0] * 12, [[0.0] * 3 for _ in range(12)], []
    for r, g, b in px.tolist():
        top, low = max(r, g, b) / 255, min(r, g, b) / 255
        d = top - low
        x, y, z = r / 255, g / 255, b / 255
        hue = 0 if d == 0 else ((y - z) / d) % 6 if top == x else (z - x) / d + 2 if top == y else (x - y) / d + 4
        s = d / top if top else 0
        k = min(11, int(hue * 60 % 360 / 30))
        weight[k] += s * top
        sums[k] = [m + c * s * top for m, c in zip(sums[k], (r, g, b))]
        sats.append(s)
    total, mean = sum(weight), sum(sats) / len(sats)
    order = sorted(range(12), key=lambda k: -weight[k])[:3]
    harmony = 0.85 if mean < 0.12 else min(1, sum(weight[k] for k in order) / total) if total else 0.5
    light = K.exposure(a)
    return math.floor(harmony * 100 + 0.5) / 100, ["#" + "".join(f"{math.floor(v / weight[k] + 0.5):02x}" for v in sums[k]) for k in order if weight[k] > 0], bool(total and (weight[0] + weight[1]) / total > 0.3 and mean > 0.25 and 25 < light < 85)


def test_colours(spark, made):
    rows = QUERIES["frame_colours"](spark, SF).collect()
    assert len(rows) == len(made)
    warm = np.full((20, 20, 3), (200, 120, 60), np.uint8)
    assert K.colours(warm) == {"harmony": 1.0, "dominant": ["#c8783c"], "golden_hour": True} and not K.colours(warm // 4)["golden_hour"] and not K.colours(warm[..., ::-1])["golden_hour"]
    for r in rows[::41]:
        h, d, g = plain_colours(made[r["id"]])
        assert (r["harmony"], r["dominant"], r["golden_hour"]) == (pytest.approx(h, abs=0.011), ",".join(d), g)
    skin = np.full((10, 10, 3), (210, 160, 130), np.uint8)
    assert K.natural_skin(skin, [0.1, 0.1, 0.8, 0.8]) is True
    assert K.natural_skin(np.full((10, 10, 3), (120, 160, 230), np.uint8), [0.0, 0.0, 1.0, 1.0]) is False
    assert K.natural_skin(np.full((10, 10, 3), 128, np.uint8), [0.0, 0.0, 1.0, 1.0]) is None and K.natural_skin(skin, [0.5, 0.5, 0.0, 0.0]) is None


def test_frame_measures(spark, made):
    rows = QUERIES["frame_measures"](spark, SF).collect()
    assert {r["id"] for r in rows} == set(made)
    for r in rows[::37]:
        y = [[0.299 * p[0] + 0.587 * p[1] + 0.114 * p[2] for p in line] for line in made[r["id"]].astype(float)]
        lap = [4 * y[i][j] - y[i - 1][j] - y[i + 1][j] - y[i][j - 1] - y[i][j + 1] for i in range(1, 15) for j in range(1, 23)]
        m = sum(lap) / len(lap)
        assert r["sharpness"] == min(100, math.floor(math.sqrt(sum((v - m) ** 2 for v in lap) / len(lap)) * 2.2 + 0.5))
        flat = [v for line in y for v in line][::4]
        assert r["exposure"] == math.floor(sum(flat) / len(flat) / 255 * 100 + 0.5) and r["highlight_clipping"] == sum(v >= 250 for v in flat) / len(flat)
        bins, total = [0.0] * 18, 0.0
        mag = [[0.0] * 24 for _ in range(16)]
        for i in range(1, 15):
            for j in range(1, 23):
                gx = y[i - 1][j + 1] + 2 * y[i][j + 1] + y[i + 1][j + 1] - y[i - 1][j - 1] - 2 * y[i][j - 1] - y[i + 1][j - 1]
                gy = y[i + 1][j - 1] + 2 * y[i + 1][j] + y[i + 1][j + 1] - y[i - 1][j - 1] - 2 * y[i - 1][j] - y[i - 1][j + 1]
                mag[i][j] = math.hypot(gx, gy)
                if mag[i][j] >= 18:
                    edge = ((math.degrees(math.atan2(gy, gx)) + 180) % 180 + 180) % 180 - 90
                    bins[min(17, max(0, math.floor((edge + 90) / 10)))] += mag[i][j]
                    total += mag[i][j]
        if total:
            assert abs(max(bins) / total - 0.22) < 1e-3 or r["leading_lines"] == (max(bins) / total > 0.22)
        num = a2 = b2 = 0.0
        for by in range(16):
            for bx in range(12):
                a, b = mag[by][bx], mag[by][23 - bx]
                num, a2, b2 = num + a * b, a2 + a * a, b2 + b * b
        assert r["symmetry"] == (a2 >= 1 and b2 >= 1 and num / math.sqrt(a2 * b2) > 0.6)
        empty = []
        for by in range(10):
            for bx in range(10):
                v = [y[i][j] for i in range(by, by + 1) for j in range(bx * 2, bx * 2 + 2)]
                empty.append(sum(x * x for x in v) / len(v) - (sum(v) / len(v)) ** 2 < 60)
        assert r["negative_space"] == pytest.approx(sum(empty) / len(empty))


# edits


def spotted(w, h, cx, cy, r):
    y, x = np.mgrid[0:h, 0:w]
    n = (x * 7 + y * 13) % 11 - 5
    a = np.stack([140 + n, 150 + n, 130 + n], axis=2).astype(float)
    a[(x - cx) ** 2 + (y - cy) ** 2 <= r * r] = (230, 40, 40)
    return a


def test_stroke_masks():
    mask, x0, y0 = E.stroke_mask([(0.5, 0.5)], 0.1, 100, 100)
    assert mask[50 - y0, 50 - x0] == 1 and mask[50 - y0, 60 - x0] < 0.05
    assert E.stroke_mask([], 0.05, 100, 100) is None
    assert E.stroke_mask([(0.4, 0.5), (0.42, 0.5), (0.44, 0.5)], 0.08, 100, 100)[0].max() == 1


def test_a_spot_is_healed_and_nothing_else_touched():
    a = spotted(120, 120, 60, 60, 5)
    out = E.healed(a, [(0.5, 0.5)], 0.06)
    assert abs(out[60, 60, 0] - 140) < 15 and abs(out[60, 60, 1] - 150) < 15 and (out[10, 10] == a[10, 10]).all()
    changed = np.argwhere((out != a).any(axis=2))
    assert np.hypot(*(changed - 60).T).max() <= 0.06 * 120
    b = E.healed(spotted(100, 100, 50, 50, 4), [(0.5, 0.5)], 0.05)
    assert not ((b[..., 0] > 200) & (b[..., 1] < 80)).any()  # the patch comes from the frame as it was


def test_what_cannot_be_healed_stays():
    a = spotted(60, 60, 5, 5, 3)
    assert E.healed(a, [(0.02, 0.02)], 0.9) is a and E.healed(a, [], 0.1) is a


def test_patches_take_the_tone_of_their_place():
    x = np.arange(80)
    a = np.repeat(np.repeat((40 + np.round(x / 79 * 170))[None, :, None], 80, axis=0), 3, axis=2)
    y, xx = np.mgrid[0:80, 0:80]
    spot = a.copy()
    spot[(xx - 60) ** 2 + (y - 40) ** 2 <= 25] = 0
    out = E.healed(spot, [(60 / 80, 0.5)], 0.1)
    assert abs(out[40, 60, 0] - a[40, 60, 0]) < 12


def test_hue_bands():
    w = E.band_weights(np.array([0.0, 30.0, 15.0, 350.0, 90.0]))
    assert w["red"][0] == 1 and w["orange"][1] == 1 and w["red"][2] == pytest.approx(w["orange"][2]) == pytest.approx(0.75) and w["red"][3] > 0.8 and w["green"][4] == w["yellow"][4] == pytest.approx(0.25)
    a = np.array([[[200, 40, 40], [40, 40, 200], [128, 128, 128], [200, 200, 60]]], float)
    out = E.hue_bands(a, {"red": {"hue": 0, "saturation": -100, "luminance": 0}})
    assert len(set(out[0, 0])) == 1 and (out[0, 1:3] == a[0, 1:3]).all()
    assert (E.hue_bands(a, {"red": {"hue": 0, "saturation": 0, "luminance": 0}}) == a).all()
    up = E.hue_bands(a, {"blue": {"hue": 0, "saturation": 0, "luminance": 100}})
    assert up[0, 1].sum() > a[0, 1].sum() and (up[0, 0] == a[0, 0]).all()
    h, s, light = E.to_hsl(a)
    assert np.abs(E.from_hsl(h, s, light) - a).max() <= 1


def test_control_points():
    a = np.full((40, 60, 3), 100.0)
    a[:, 30:] = (220, 40, 40)
    m = E.point_mask(a, 0.25, 0.5, 0.4)
    assert m[20, 15] == 1 and m[20, 5] > 0 and m[:, 30:].max() == 0 and m[20, 14] == pytest.approx(m[20, 16])
    out = E.control_points(a, [{"x": 0.25, "y": 0.5, "radius": 0.4, "brightness": 100, "contrast": 0, "saturation": 0, "structure": 0}], None, 0)
    assert out[20, 15, 0] == 170 and (out[:, 30:] == a[:, 30:]).all()
    assert E.control_points(a, [{"x": 0.2, "y": 0.5, "radius": 0.4, "brightness": 0, "contrast": 0, "saturation": 0, "structure": 0}], None, 0) is a
    u, v = E.to_frame(0.5, 0.5, {"x": 0.25, "y": 0.25, "width": 0.5, "height": 0.5}, 0, 100, 100)
    assert (u, v) == (0.5, 0.5) and E.to_frame(0.25, 0.75, {"x": 0.25, "y": 0.25, "width": 0.5, "height": 0.5}, 0, 100, 100) == (0.0, 1.0)


def plain_blur(y, r):
    h, w = y.shape
    at = lambda i, n: min(n - 1, max(0, i))
    rows = [[sum(y[i][at(j + k, w)] for k in range(-r, r + 1)) / (2 * r + 1) for j in range(w)] for i in range(h)]
    return np.array([[sum(rows[at(i + k, h)][j] for k in range(-r, r + 1)) / (2 * r + 1) for j in range(w)] for i in range(h)])


def test_detail_in_its_order():
    rng = np.random.default_rng(5)
    y = rng.integers(0, 255, (13, 17)).astype(float)
    for r in (2, 10):
        assert E.box_blur(y, r) == pytest.approx(plain_blur(y, r))
    flat = np.full((12, 12, 3), 77.0)
    assert (E.detail(flat, {"noise": 100, "clarity": 100, "sharpen": 100}) == 77).all()
    a = np.repeat(y[..., None], 3, axis=2)
    want = y + (plain_blur(y, 2) - y) * 0.5
    want = want + (want - plain_blur(want, 10)) * 0.4 * 0.6
    p = np.pad(want, 1, mode="edge")
    want = want * (1 + 4 * 0.3) - 0.3 * (p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:])
    got = E.detail(a, {"noise": 50, "clarity": 40, "sharpen": 60})
    assert np.abs(got[..., 0] - np.clip(want, 0, 255)).max() <= 0.5 + 1e-9


def test_vignette_leaves_the_middle():
    a = np.full((100, 100, 3), 200.0)
    out = E.vignette(a, 100)
    y, x = np.mgrid[0:100, 0:100]
    d = np.hypot(x - 50, y - 50) / math.hypot(50, 50)
    assert (out[d <= 0.44] == 200).all() and out[0, 0, 0] == pytest.approx(200 * 0.15, abs=1) and (E.vignette(a, -50)[0, 0] > 200).all()


def test_tones_and_basics():
    a = np.array([[[100, 100, 100]]], float)
    assert E.tones(a, {"temperature": 100}).tolist() == [[[140, 100, 60]]] and E.tones(a, {"tint": 100}).tolist() == [[[80, 140, 80]]]
    assert E.tones(np.full((1, 1, 3), 255.0), {"whites": -100})[0, 0, 0] == 200 and E.tones(np.zeros((1, 1, 3)), {"blacks": 100})[0, 0, 0] == 55 and E.tones(np.zeros((1, 1, 3)), {"shadows": 50})[0, 0, 0] == 30
    assert E.basics(a, {"exposure": 20})[0, 0, 0] == pytest.approx(120) and E.basics(a, {"contrast": 100})[0, 0, 0] == pytest.approx(72.5)
    turned = E.placed(np.arange(300.0).reshape(10, 10, 3), None, 0)
    assert turned == pytest.approx(np.arange(300.0).reshape(10, 10, 3))
    left = E.placed(np.repeat(np.arange(10.0)[None, :, None], 10, axis=0), {"x": 0.0, "y": 0.0, "width": 0.5, "height": 1.0}, 0)
    assert left[0, :, 0] == pytest.approx(np.clip(np.arange(10) / 2 - 0.25, 0, 9))


def test_edited_and_healed_queries(spark, made):
    """Every frame once; those without edits as they were, the others as the steps say one by one."""
    rows = {r["id"]: r["digest"] for r in QUERIES["edited_frames"](spark, SF).collect()}
    given = photos(spark, SF, "id").select("id", *[c.alias(k) for k, c in pictures.edits_of().items()]).collect()
    assert rows.keys() == made.keys() == {r["id"] for r in given}
    digest = lambda a: hashlib.sha256(a.astype(np.uint8).tobytes()).hexdigest()
    seen = set()
    for r in given:
        e, a = r.asDict(recursive=True), made[r["id"]]
        if not any(e.get(k) for k in E.PARTS):
            assert rows[r["id"]] == digest(a)
            continue
        seen |= {k for k in E.PARTS[:4] if e.get(k)} | ({"crop"} if e["crop"] else set())
        if r["id"] % 29:
            continue
        out, s = a.astype(float), e["edits"] or {}
        if s:
            out = E.basics(out, s)
        if e["crop"] or s.get("rotation"):
            out = E.placed(out, e["crop"], s.get("rotation", 0))
        out = E.whole(out)
        out = E.tones(out, s) if s else out
        out = E.hue_bands(out, e["bands"]) if e["bands"] else out
        out = E.curved(out, {k: [(q["x"], q["y"]) for q in v] for k, v in e["curves"].items()}) if e["curves"] else out
        out = E.control_points(out, e["points"], e["crop"], s.get("rotation", 0)) if e["points"] else out
        out = E.vignette(E.detail(out, s), s["vignette"]) if s.get("vignette") else E.detail(out, s) if s else out
        assert rows[r["id"]] == digest(out), r["id"]
    assert seen == {"edits", "bands", "curves", "points", "crop"}
    healed = {r["id"]: r["digest"] for r in QUERIES["healed_frames"](spark, SF).collect()}
    for r in photos(spark, SF, "id").select("id", pictures.strokes().alias("heal")).collect()[::17]:
        out = made[r["id"]].astype(float)
        for q in r["heal"]:
            out = E.healed(out, [(x["x"], x["y"]) for x in q["points"]], q["radius"])
        assert healed[r["id"]] == digest(out)
    broken = spark.createDataFrame([(1, 2, 2, b"abc", {"exposure": 5.0}), (2, 1, 1, b"abc", None), (3, 1, 1, b"abc", {"exposure": 0.0}), (4, None, None, None, {"exposure": 5.0})], "id int, width int, height int, pixels binary, edits map<string,double>")
    assert {r["id"]: r["pixels"] for r in E.edited(broken).collect()} == {1: b"abc", 2: b"abc", 3: b"abc", 4: None}


# automatic adjustments


def auto(spark, frames, **view):
    base = dict(exposure=50, highlight_clipping=None, shadow_clipping=None, face_count=0, thirds=None, horizon_tilt=None, color_harmony=None, golden_hour=None, boxes=[]) | view
    schema = "id int, width int, height int, pixels binary, exposure int, highlight_clipping double, shadow_clipping double, face_count int, thirds double, horizon_tilt double, color_harmony double, golden_hour boolean, boxes array<array<double>>"
    rows = [(i, a.shape[1], a.shape[0], a.astype(np.uint8).tobytes(), *base.values()) for i, a in enumerate(frames)]
    return [r.asDict(recursive=True) for r in U.tones(spark.createDataFrame(rows, schema)).select("id", *U.adjustments()).orderBy("id").collect()]


def test_automatic_adjustments(spark):
    ramp = grey(np.repeat(np.linspace(60, 180, 64)[None, :], 16, axis=0))
    r = auto(spark, [ramp, grey(np.full((16, 16), 128)), np.full((16, 16, 3), (150, 130, 120), np.uint8)])
    assert r[0]["contrast"] == 35 and r[0]["whites"] > 0 > r[0]["blacks"] and r[1]["contrast"] == 0 and r[1]["temperature"] == r[1]["tint"] == 0
    assert r[2]["temperature"] == -30 and r[2]["tint"] == 8
    assert auto(spark, [np.full((16, 16, 3), (150, 130, 120), np.uint8)], golden_hour=True)[0]["temperature"] == -13
    assert [auto(spark, [ramp], exposure=e)[0]["exposure"] for e in (20, 50, 90, None)] == [21, 0, -28, 0]
    a = auto(spark, [ramp], highlight_clipping=0.1, shadow_clipping=0.07, horizon_tilt=-5.4, color_harmony=0.2)[0]
    assert (a["highlights"], a["shadows"], a["rotation"], a["saturation"]) == (-30, 21, 5, -12)
    assert auto(spark, [ramp], horizon_tilt=2.0)[0]["rotation"] == 0 and auto(spark, [ramp], horizon_tilt=9.9)[0]["rotation"] == -8
    dull = np.full((16, 16, 3), (140, 130, 128), np.uint8)
    assert 0 < auto(spark, [dull])[0]["saturation"] <= 16
    dark = np.full((40, 40, 3), 120, np.uint8)
    dark[10:30, 10:30] = 20
    face = dict(face_count=1, boxes=[[0.25, 0.25, 0.5, 0.5]])
    assert auto(spark, [dark], exposure=90, **face)[0]["exposure"] == 28 and auto(spark, [np.full((40, 40, 3), 250, np.uint8)], **face)[0]["exposure"] == -20
    c = auto(spark, [dark], face_count=1, thirds=0.2, boxes=[[0.45, 0.4, 0.1, 0.16]])[0]["crop"]
    assert c["width"] == c["height"] == pytest.approx(0.78) and c["x"] <= 0.33 and c["x"] + c["width"] >= 0.67 and c["y"] + c["height"] >= 0.4 + 0.16 * 3.5 - 1e-9
    assert auto(spark, [dark], face_count=1, thirds=0.5, boxes=[[0.45, 0.4, 0.1, 0.16]])[0]["crop"] is None  # framed well enough
    assert auto(spark, [dark], face_count=1, thirds=0.2, boxes=[[0.2, 0.1, 0.6, 0.6]])[0]["crop"] is None  # too large to cut
    assert auto(spark, [dark], face_count=1, thirds=0.2)[0]["crop"] is None


def test_faces_of_the_query_are_adjusted(spark):
    rows = QUERIES["auto_face_adjustments"](spark, SF).collect()
    assert len(rows) > 500 and any(r["crop_x"] is not None for r in rows) and any(r["exposure"] < 0 for r in rows) and all(r["rotation"] == 0 for r in rows)


def test_kernels_of_stacks():
    """A kernel of many frames tells of each what it tells of that one alone, and numpy runs once for all."""
    rng = np.random.default_rng(5)
    a = np.concatenate([rng.integers(0, 256, (40, 16, 24, 3)), rng.integers(100, 112, (40, 16, 24, 3))]).astype(np.uint8)
    for name in ("dhash", "sharpness", "exposure", "highlight_clipping", "symmetry", "negative_space", "leading_lines", "light_quality", "colours", "histogram"):
        kernel = K.KERNELS[name][1]
        got = kernel.many(K.Frames(a))
        assert list(got) == [kernel(x) for x in a]


def test_strokes_healed_together():
    """Strokes of a stack are healed as each alone: boxes of several sizes, several points, at edges, none."""
    rng = np.random.default_rng(6)
    a = rng.integers(0, 256, (60, 16, 24, 3)).astype(np.uint8)
    strokes = [[(rng.random((rng.integers(0, 4), 2)), rng.choice([0.02, 0.05, 0.08])) for _ in range(rng.integers(0, 3))] for _ in a]
    want = []
    for x, own in zip(a, strokes, strict=True):
        x = x.astype(float)
        for p, r in own:
            x = E.healed(x, [tuple(q) for q in p], r)
        want.append(x)
    flat = [s for own in strokes for s in own]
    points = np.concatenate([p for p, _ in flat])
    E.heal(a, np.array([len(s) for s in strokes]), np.array([r for _, r in flat]), np.array([len(p) for p, _ in flat]), points[:, 0], points[:, 1])
    assert (a == np.stack(want)).all()


def test_pictures_are_made_some_at_a_time():
    """A batch of Arrow is never one array of whole numbers."""
    import tracemalloc

    from framesift.plans.pictures import PICTURES, picture

    tracemalloc.start()
    picture(np.arange(PICTURES), np.arange(PICTURES))
    assert tracemalloc.get_traced_memory()[1] < 32 << 20
    tracemalloc.stop()
