"""Edits of frames: colours, hue bands, curves, control points, detail, healing, crops and a vignette.

A frame is a row with width, height and ``pixels`` as in pixels.py. Its edits
are columns beside it, each of which may lack or be null: ``edits``
(MAP<STRING, DOUBLE>, the sliders from -100 to 100), ``bands`` (MAP<STRING,
STRUCT<hue, saturation, luminance>>), ``curves`` (MAP<STRING, ARRAY<STRUCT<x,
y>>> of all, r, g and b), ``points`` (ARRAY<STRUCT<x, y, radius, brightness,
contrast, saturation, structure>>), ``heal`` (ARRAY<STRUCT<points: ARRAY<STRUCT<x,
y>>, radius>>) and ``crop`` (STRUCT<x, y, width, height>). They are drawn in one
order; after each step pixels are whole again, half to even. Every step is a
numpy function of one frame or of a stack of frames of one size, whose sliders
are then arrays of (n, 1, 1); a step is taken by those frames of a stack that
ask for it. A batch goes to Python once."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pixels import STACK, luma, stacks

TURN_MOST = 8.0


def whole(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x), 0, 255)


def deep(x: float | np.ndarray) -> np.ndarray:
    """A slider beside three colours."""
    return np.asarray(x)[..., None]


def basics(a: np.ndarray, e: dict[str, float]) -> np.ndarray:
    """Brightness, contrast and saturation, one after another."""
    out = np.clip(a * deep(1 + e.get("exposure", 0) / 100), 0, 255)
    out = np.clip((out - 127.5) * deep(1 + e.get("contrast", 0) / 100) + 127.5, 0, 255)
    grey = (out @ np.array([0.213, 0.715, 0.072]))[..., None]
    return np.clip(grey + (out - grey) * deep(1 + e.get("saturation", 0) / 100), 0, 255)


def placed(a: np.ndarray, crop: dict | None, degrees: float) -> np.ndarray:
    """The crop (shares of the frame) drawn over the whole frame, turned a little and enlarged until the corners are filled; between pixels, the mean of the four around."""
    h, w = a.shape[-3:-1]
    c = crop or {"x": 0.0, "y": 0.0, "width": 1.0, "height": 1.0}
    turn = np.radians(np.clip(degrees, -TURN_MOST, TURN_MOST))
    sw, sh, cos, sin = c["width"] * w, c["height"] * h, np.cos(turn), np.sin(turn)
    scale = np.maximum((sw * abs(cos) + sh * abs(sin)) / sw, (sw * abs(sin) + sh * abs(cos)) / sh)
    v, u = np.mgrid[0:h, 0:w] + 0.5
    du, dv = (u - w / 2) / scale, (v - h / 2) / scale
    x = (c["x"] + c["width"] * (0.5 + (du * cos + dv * sin) / w)) * w - 0.5
    y = (c["y"] + c["height"] * (0.5 + (-du * sin + dv * cos) / h)) * h - 0.5
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    x1, y1, fx, fy = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1), (x - x0)[..., None], (y - y0)[..., None]
    own = (np.arange(len(a))[:, None, None],) if a.ndim == 4 else ()
    at = lambda r, k: a[(*own, r, k)]
    return (at(y0, x0) * (1 - fx) + at(y0, x1) * fx) * (1 - fy) + (at(y1, x0) * (1 - fx) + at(y1, x1) * fx) * fy


def to_frame(x: float, y: float, crop: dict | None, degrees: float, w: int, h: int) -> tuple[float, float]:
    """Where a point of the whole picture (shares) is in the frame that is drawn of it."""
    c = crop or {"x": 0.0, "y": 0.0, "width": 1.0, "height": 1.0}
    u, v = (x - c["x"]) / c["width"], (y - c["y"]) / c["height"]
    turn = np.radians(np.clip(degrees, -TURN_MOST, TURN_MOST))
    if turn:
        cos, sin, sw, sh = np.cos(turn), np.sin(turn), c["width"], c["height"]
        scale = max((sw * abs(cos) + sh * abs(sin)) / sw, (sw * abs(sin) + sh * abs(cos)) / sh)
        du, dv = (u - 0.5) * w, (v - 0.5) * h
        u, v = 0.5 + scale * (du * cos - dv * sin) / w, 0.5 + scale * (du * sin + dv * cos) / h
    return float(u), float(v)


#: How far the sliders reach at 100.
WARMTH, TONE, ENDS = 40, 60, 55


def tones(a: np.ndarray, e: dict[str, float]) -> np.ndarray:
    """Temperature and tint, then lights, shadows, whites and blacks by how bright a pixel is."""
    warm, tint = e.get("temperature", 0) / 100 * WARMTH, e.get("tint", 0) / 100 * WARMTH
    out = a + np.stack([warm - tint / 2, tint + 0 * warm, -warm - tint / 2], -1)
    amounts = [e.get(k, 0) / 100 * most for k, most in (("highlights", TONE), ("shadows", TONE), ("whites", ENDS), ("blacks", ENDS))]
    if any(np.any(k) for k in amounts):
        y = luma(out)
        t = np.clip(y / 255, 0, 1)
        weights = [np.maximum(0, (y - 128) / 127), np.maximum(0, (128 - y) / 128), t**3, (1 - t) ** 3]
        out = out + sum(k * v for k, v in zip(amounts, weights, strict=True))[..., None]
    return whole(out)


#: Centres of the hue bands in degrees, how far a band reaches, how far a slider turns a hue, and the saturation below which a pixel is grey.
BANDS = {"red": 0, "orange": 30, "yellow": 60, "green": 120, "aqua": 180, "blue": 240, "purple": 280, "magenta": 320}
BAND_REACH, BAND_TURN, BAND_GREY = 45, 30, 0.04


def band_weights(hue: np.ndarray) -> dict[str, np.ndarray]:
    """How much each band has of a hue: 1 at its centre, 0 from BAND_REACH on, in a cosine's curve; bands overlap."""
    out = {}
    for name, centre in BANDS.items():
        d = np.abs(hue - centre) % 360
        d = np.where(d > 180, 360 - d, d)
        out[name] = np.where(d >= BAND_REACH, 0.0, np.cos(np.minimum(d, BAND_REACH) / BAND_REACH * np.pi / 2) ** 2)
    return out


def to_hsl(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    c = np.asarray(a, float) / 255
    top, low = c.max(-1), c.min(-1)
    d, light = top - low, (top + low) / 2
    safe = np.where(d > 0, d, 1)
    r, g, b = c[..., 0], c[..., 1], c[..., 2]
    h = np.where(top == r, (g - b) / safe + np.where(g < b, 6, 0), np.where(top == g, (b - r) / safe + 2, (r - g) / safe + 4)) * 60
    base = np.where(light > 0.5, 2 - top - low, top + low)
    return np.where(d > 0, h, 0.0), np.where(d > 0, d / np.where(base > 0, base, 1), 0.0), light


def from_hsl(h: np.ndarray, s: np.ndarray, light: np.ndarray) -> np.ndarray:
    q = np.where(light < 0.5, light * (1 + s), light + s - light * s)
    p = 2 * light - q

    def part(t: np.ndarray) -> np.ndarray:
        t = t % 1
        return np.select([t < 1 / 6, t < 1 / 2, t < 2 / 3], [p + (q - p) * 6 * t, q, p + (q - p) * (2 / 3 - t) * 6], p)

    turn = h % 360 / 360
    out = np.stack([part(turn + 1 / 3), part(turn), part(turn - 1 / 3)], -1)
    return np.floor(np.where((s <= 0)[..., None], light[..., None], out) * 255 + 0.5)


def hue_bands(a: np.ndarray, bands: dict[str, dict[str, float]]) -> np.ndarray:
    """Hue, saturation and luminance of each band, by how much of it a pixel has; greys stay."""
    active = {k: v for k, v in bands.items() if k in BANDS and v and any(np.any(x) for x in v.values() if x is not None)}
    if not active:
        return a
    h, s, light = to_hsl(a)
    w = band_weights(h)
    total = sum(w[k] for k in active)
    dh, ds, dl = (sum(w[k] * (0 if v[part] is None else v[part]) / 100 for k, v in active.items()) for part in BAND_PARTS)
    out = from_hsl(h + dh * BAND_TURN, np.clip(s * (1 + ds), 0, 1), np.clip(light + dl * 0.5, 0, 1))
    return np.where(((s < BAND_GREY) | (total <= 0))[..., None], a, out)


@lru_cache(maxsize=1024)
def whole_table(points: tuple[tuple[float, float], ...]) -> np.ndarray:
    return whole(curve_table(list(points)))


def curve_table(points: list[tuple[float, float]]) -> np.ndarray:
    """256 values of a monotone cubic curve through the points (Fritsch and Carlson, 1980)."""
    p = sorted(points)
    x, y = np.array([a for a, _ in p], float), np.array([b for _, b in p], float)
    if len(x) < 2:
        return np.arange(256.0) if not len(x) else np.full(256, y[0])
    d = np.diff(y) / np.diff(x)
    m = np.concatenate([[d[0]], (d[:-1] + d[1:]) / 2, [d[-1]]])
    for i, s in enumerate(d):
        if s == 0:
            m[i] = m[i + 1] = 0
        else:
            r = np.hypot(m[i] / s, m[i + 1] / s)
            if r > 3:
                m[i], m[i + 1] = 3 * m[i] / r, 3 * m[i + 1] / r
    t = np.clip(np.arange(256.0), x[0], x[-1])
    k = np.clip(np.searchsorted(x, t, side="right") - 1, 0, len(x) - 2)
    h = x[k + 1] - x[k]
    u = (t - x[k]) / h
    return np.clip((2 * u**3 - 3 * u**2 + 1) * y[k] + (u**3 - 2 * u**2 + u) * h * m[k] + (3 * u**2 - 2 * u**3) * y[k + 1] + (u**3 - u**2) * h * m[k + 1], 0, 255)


def curved(a: np.ndarray, curves: dict[str, list[tuple[float, float]]]) -> np.ndarray:
    """A curve for all channels, and one for each."""
    at, out = a.astype(int), a
    if curves.get("all"):
        out = whole_table(tuple(curves["all"]))[at]
    for i, k in enumerate("rgb"):
        if curves.get(k):
            out = out.copy()
            out[..., i] = whole_table(tuple(curves[k]))[out[..., i].astype(int)]
    return out


def box_blur(y: np.ndarray, radius: int, axes: tuple[int, int] = (1, 0)) -> np.ndarray:
    """Mean of the square around each pixel, edges repeated: sums along rows, then along columns, of an (h, w, ..) array (or along other ``axes``)."""
    for axis in axes:
        pad = [(0, 0)] * y.ndim
        pad[axis] = (radius + 1, radius)
        c = np.cumsum(np.pad(y, pad, mode="edge"), axis=axis)
        n = y.shape[axis]
        y = (np.take(c, np.arange(2 * radius + 1, 2 * radius + 1 + n), axis) - np.take(c, np.arange(n), axis)) / (2 * radius + 1)
    return y


#: Radii of the blurs, and how strong clarity and sharpening are at 100.
NOISE_RADIUS, CLARITY_RADIUS, CLARITY, SHARPEN = 2, 10, 0.6, 0.5


def detail(a: np.ndarray, e: dict[str, float]) -> np.ndarray:
    """Noise goes, then local contrast, then edges: in this order, so that no noise is sharpened."""
    out = a.astype(float)
    part = lambda k: np.clip(e.get(k, 0) / 100, 0.0, 1.0)
    noise, clarity, sharp = part("noise"), e.get("clarity", 0) / 100, part("sharpen") * SHARPEN
    axes = (a.ndim - 2, a.ndim - 3)
    if np.any(noise):
        out = out + (box_blur(out, NOISE_RADIUS, axes) - out) * deep(noise)
    if np.any(clarity):
        y = luma(out)
        out = out + ((y - box_blur(y, CLARITY_RADIUS, axes)) * clarity * CLARITY)[..., None]
    if np.any(sharp):
        p, sharp = np.pad(out, [*[(0, 0)] * (a.ndim - 3), (1, 1), (1, 1), (0, 0)], mode="edge"), deep(sharp)
        out = out * (1 + 4 * sharp) - sharp * (p[..., :-2, 1:-1, :] + p[..., 2:, 1:-1, :] + p[..., 1:-1, :-2, :] + p[..., 1:-1, 2:, :])
    return whole(out)


#: How far brightness and colour may be from the point's, and what a control point does at 100.
LIKE_LIGHT, LIKE_COLOUR, POINT_LIGHT, POINT_CONTRAST, POINT_STRUCTURE = 90, 60, 70, 0.6, 0.9


def falloff(t: np.ndarray) -> np.ndarray:
    """From 1 at 0 to 0 at 1, flat at both ends."""
    u = 1 - np.clip(t, 0, 1)
    return u * u * (3 - 2 * u)


def point_mask(a: np.ndarray, x: float, y: float, radius: float) -> np.ndarray:
    """How much of a control point each pixel gets: by its distance, and by how like it is to the pixel under the point."""
    h, w = a.shape[-3:-1]
    reach = radius * max(w, h)
    rows, cols = np.mgrid[0:h, 0:w]
    near = falloff(np.hypot(cols - x * w, rows - y * h) / reach)
    inside = (cols >= np.maximum(0, np.floor(x * w - reach))) & (cols < np.minimum(w, np.ceil(x * w + reach))) & (rows >= np.maximum(0, np.floor(y * h - reach))) & (rows < np.minimum(h, np.ceil(y * h + reach)))
    light = luma(a)
    row, col = (np.clip(np.floor(v * n + 0.5), 0, n - 1).astype(int) for v, n in ((y, h), (x, w)))
    at = a[(*((np.arange(len(a))[:, None, None],) if a.ndim == 4 else ()), row, col)].astype(float)
    own = np.array([luma(p) for p in at.reshape(-1, 3)]).reshape(at.shape[:-1])
    colour = np.hypot((a[..., 0] - light) - (at[..., 0] - own), (a[..., 2] - light) - (at[..., 2] - own))
    return np.where(inside, near, 0) * falloff(np.abs(light - own) / LIKE_LIGHT) * falloff(colour / LIKE_COLOUR)


def control_point(a: np.ndarray, p: dict[str, float], blurred: np.ndarray | None) -> np.ndarray:
    """One point's brightness, contrast, saturation and structure, as far as its mask goes."""
    m = point_mask(a, p["x"], p["y"], p["radius"])[..., None]
    get = lambda k: deep((0.0 if p.get(k) is None else p[k]) / 100)
    out = a + get("brightness") * POINT_LIGHT * m
    out = 128 + (out - 128) * (1 + get("contrast") * POINT_CONTRAST * m)
    y = luma(out)[..., None]
    out = y + (out - y) * (1 + get("saturation") * m)
    if np.any(get("structure")) and blurred is not None:
        out = out + (luma(out) - blurred)[..., None] * get("structure") * POINT_STRUCTURE * m
    return np.where(m > 0.001, whole(out), a)


def control_points(a: np.ndarray, points: list[dict], crop: dict | None, degrees: float) -> np.ndarray:
    """All points, one after another; they are given in the whole picture, and go where the crop puts them."""
    active = [p for p in points if any(p.get(k) for k in ("brightness", "contrast", "saturation", "structure"))]
    blurred = box_blur(luma(a), CLARITY_RADIUS) if any(p.get("structure") for p in active) else None
    grown = 2 / (crop["width"] + crop["height"]) if crop else 1.0
    h, w = a.shape[:2]
    for p in active:
        x, y = to_frame(p["x"], p["y"], crop, degrees, w, h)
        a = control_point(a, {**p, "x": x, "y": y, "radius": p["radius"] * grown}, blurred)
    return a


POINT = ("x", "y", "radius", "brightness", "contrast", "saturation", "structure")


def control_points_of(a: np.ndarray, points: list[np.ndarray], crop: dict[str, np.ndarray] | None, degrees: np.ndarray) -> np.ndarray:
    """The same of a stack: ``points`` has an array of POINT for each frame; the first points of all are set together, then the second ones."""
    h, w = a.shape[1:3]
    points = [p[(p[:, 3:] != 0).any(axis=1)] for p in points]
    todo = [k for k, p in enumerate(points) if len(p)]
    if not todo:
        return a
    structured = np.zeros(len(a), bool)
    structured[todo] = [bool(points[k][:, 6].any()) for k in todo]
    blurred = np.zeros(a.shape[:3])
    if structured.any():
        blurred[structured] = box_blur(luma(a[structured]), CLARITY_RADIUS, (2, 1))
    a, i = a.copy(), 0
    while todo:
        own, given = np.array(todo), []
        for k in todo:
            x, y, radius, *rest = points[k][i].tolist()
            c = {n: float(v[k, 0, 0]) for n, v in crop.items()} if crop else None
            x, y = to_frame(x, y, c, float(degrees[k]), w, h)
            given.append((x, y, radius * (2 / (c["width"] + c["height"]) if c else 1.0), *rest))
        p = dict(zip(POINT, np.array(given).T[:, :, None, None], strict=True))
        a[own] = control_point(a[own], p, blurred[own])
        i += 1
        todo = [k for k in todo if len(points[k]) > i]
    return a


#: Directions and distances (in radii of the stroke) in which a patch is looked for, what each further ring costs, the width of the seam, how far tones may be moved, and where a stroke begins to fade.
DIRECTIONS, RINGS, RING_COST, SEAM, SHIFT_MOST, SOFT = 24, (1.15, 1.7, 2.4, 3.2), 0.12, 3, 46, 0.65


def stroke_mask(points: list[tuple[float, float]], radius: float, w: int, h: int) -> tuple[np.ndarray, int, int] | None:
    """(mask, left, top): how much of each pixel around a stroke (circles of ``radius`` times the longer side) is to be healed; overlapping circles don't add up."""
    if not points:
        return None
    r = max(1.0, radius * max(w, h))
    x, y = np.array([p[0] * w for p in points]), np.array([p[1] * h for p in points])
    x0, y0 = int(max(0, np.floor(x.min() - r - 1))), int(max(0, np.floor(y.min() - r - 1)))
    x1, y1 = int(min(w, np.ceil(x.max() + r + 1))), int(min(h, np.ceil(y.max() + r + 1)))
    if x1 <= x0 or y1 <= y0:
        return None
    rows, cols = np.mgrid[y0:y1, x0:x1]
    mask = np.zeros((y1 - y0, x1 - x0))
    for cx, cy in zip(x, y, strict=True):
        d = np.hypot(cols - cx, rows - cy)
        np.maximum(mask, np.where(d >= r, 0, np.where(d <= r * SOFT, 1, 1 - (d - r * SOFT) / (r - r * SOFT))), out=mask)
    return mask, x0, y0


def best_patch(a: np.ndarray, mask: np.ndarray, x0: int, y0: int) -> tuple[int, int, np.ndarray] | None:
    """(dx, dy, seam): where around a stroke the frame is most like the stroke's seam, by squared differences; of equal ones the nearer and earlier."""
    h, w = mask.shape
    rows, cols = np.mgrid[0:h, 0:w]
    seam = (mask <= 0.02) & ((cols < SEAM) | (cols >= w - SEAM) | (rows < SEAM) | (rows >= h - SEAM))
    if not seam.any():
        return None
    own = a[y0 : y0 + h, x0 : x0 + w][seam].astype(float)
    best, least = None, np.inf
    for k, ring in enumerate(RINGS):
        for i in range(DIRECTIONS):
            t = i / DIRECTIONS * 2 * np.pi
            dx, dy = (int(np.floor(f * (max(w, h) / 2) * ring * 2 + 0.5)) for f in (np.cos(t), np.sin(t)))
            if (dx or dy) and x0 + dx >= 0 and y0 + dy >= 0 and x0 + w + dx <= a.shape[1] and y0 + h + dy <= a.shape[0]:
                there = a[y0 + dy : y0 + dy + h, x0 + dx : x0 + dx + w][seam]
                cost = float(((own - there) ** 2).sum()) * (1 + RING_COST * k)
                if cost < least:
                    best, least = (dx, dy, seam), cost
    return best


def healed(a: np.ndarray, points: list[tuple[float, float]], radius: float) -> np.ndarray:
    """A stroke filled with the best patch, moved to the tone of its seam and faded at the edge; as it was, where no patch fits into the frame."""
    found = stroke_mask(points, radius, a.shape[1], a.shape[0])
    patch = best_patch(a, *found) if found else None
    if patch is None:
        return a
    (mask, x0, y0), (dx, dy, seam) = found, patch
    h, w = mask.shape
    here, there = a[y0 : y0 + h, x0 : x0 + w].astype(float), a[y0 + dy : y0 + dy + h, x0 + dx : x0 + dx + w].astype(float)
    shift = np.clip((here[seam] - there[seam]).mean(axis=0), -SHIFT_MOST, SHIFT_MOST)
    out = a.copy()
    out[y0 : y0 + h, x0 : x0 + w] = np.where((mask > 0.002)[..., None], whole(here + (there + shift - here) * mask[..., None]), here)
    return out


@lru_cache(maxsize=4096)
def ring_offsets(longest: int) -> list[tuple[int, int, int]]:
    """(dx, dy, ring): where a patch for a stroke whose box has this longer side is looked for, in their order."""
    out = []
    for k, ring in enumerate(RINGS):
        for i in range(DIRECTIONS):
            t = i / DIRECTIONS * 2 * np.pi
            dx, dy = (int(np.floor(f * (longest / 2) * ring * 2 + 0.5)) for f in (np.cos(t), np.sin(t)))
            if dx or dy:
                out.append((dx, dy, k))
    return out


#: Pixels of the frames whose strokes are healed together, and values of the boxes of strokes that are compared at once, at about.
HEAL_PIXELS, HEAL_STACK = 1 << 22, 1 << 17


def heal(a: np.ndarray, counts: np.ndarray, radius: np.ndarray, sizes: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> None:
    """Heal a stack of frames (whole values) in place, as ``healed`` does one stroke: the first strokes of all, then the second ones, with boxes of one size together.

    counts: strokes of each frame; radius and sizes (points) of each stroke; xs and ys of each point."""
    h, w = a.shape[1:3]
    first, begin = np.cumsum(counts) - counts, np.cumsum(sizes) - sizes
    some = np.flatnonzero(sizes > 0)
    if not len(some):
        return
    r = np.maximum(1.0, radius * max(w, h))
    x, y = xs * w, ys * h

    def bounds(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = np.zeros(len(sizes), int), np.zeros(len(sizes), int)
        lo[some] = np.maximum(0, np.floor(np.minimum.reduceat(v, begin[some]) - r[some] - 1))
        hi[some] = np.minimum(most, np.ceil(np.maximum.reduceat(v, begin[some]) + r[some] + 1))
        return lo, hi

    (x0, x1), (y0, y1) = bounds(x, w), bounds(y, h)
    wide, high = x1 - x0, y1 - y0
    for i in range(int(counts.max(initial=0))):
        own = np.flatnonzero(counts > i)
        k = first[own] + i
        own, k = own[(wide[k] > 0) & (high[k] > 0)], k[(wide[k] > 0) & (high[k] > 0)]
        order = np.lexsort((high[k], wide[k]))
        own, k = own[order], k[order]
        for g in np.split(np.arange(len(k)), np.flatnonzero((np.diff(wide[k]) != 0) | (np.diff(high[k]) != 0)) + 1):
            step = max(1, HEAL_STACK // (3 * int(wide[k[g[0]]] * high[k[g[0]]]))) if len(g) else 1
            for c in (g[j : j + step] for j in range(0, len(g), step)):
                s = k[c]
                rows, cols = np.arange(high[s[0]])[:, None], np.arange(wide[s[0]])
                mask = np.zeros((len(s), len(rows), len(cols)))
                for j in range(int(sizes[s].max())):
                    m = np.flatnonzero(sizes[s] > j)
                    at = lambda v: v[:, None, None]
                    p, reach = begin[s[m]] + j, at(r[s[m]])
                    d = np.hypot(at(x0[s[m]]) + cols - at(x[p]), at(y0[s[m]]) + rows - at(y[p]))
                    mask[m] = np.maximum(mask[m], np.where(d >= reach, 0, np.where(d <= reach * SOFT, 1, 1 - (d - reach * SOFT) / (reach - reach * SOFT))))
                _heal_some(a, own[c], mask, x0[s], y0[s])


def _heal_some(a: np.ndarray, own: np.ndarray, mask: np.ndarray, x0: np.ndarray, y0: np.ndarray) -> None:
    n, h, w = mask.shape
    rows, cols = np.mgrid[0:h, 0:w]
    seam = (mask <= 0.02) & ((cols < SEAM) | (cols >= w - SEAM) | (rows < SEAM) | (rows >= h - SEAM))
    pixels, wide = a.reshape(-1, 3), a.shape[2]
    base = (own * a.shape[1] + y0) * wide + x0
    box = (rows * wide + cols).ravel()

    def boxes(k: np.ndarray, move: int | np.ndarray) -> np.ndarray:
        return pixels[(base[k] + move)[:, None] + box].astype(np.float32)

    # whole values up to 255: sums of their squares are exact
    here, on = boxes(np.arange(n), 0), seam.reshape(n, -1, 1).astype(np.float32)
    some = seam.any(axis=(1, 2))
    least, move, found = np.full(n, np.inf), np.zeros(n, int), np.zeros(n, bool)
    for dx, dy, ring in ring_offsets(max(w, h)):
        k = np.flatnonzero(some & (x0 + dx >= 0) & (y0 + dy >= 0) & (x0 + w + dx <= wide) & (y0 + h + dy <= a.shape[1]))
        if not len(k):
            continue
        apart = ((here[k] - boxes(k, dy * wide + dx)) * on[k]).reshape(len(k), -1)
        cost = np.square(apart, dtype=np.float64).sum(axis=1) * (1 + RING_COST * ring)
        nearer = cost < least[k]
        k = k[nearer]
        least[k], move[k], found[k] = cost[nearer], dy * wide + dx, True
    k = np.flatnonzero(found)
    if not len(k):
        return
    here, there, on, m = here[k].astype(float), boxes(k, move[k]).astype(float), on[k].astype(float), mask[k].reshape(len(k), -1, 1)
    shift = ((here - there) * on).sum(axis=1) / on.sum(axis=1)
    shift = np.clip(shift, -SHIFT_MOST, SHIFT_MOST)[:, None, :]
    pixels[base[k][:, None] + box] = np.where(m > 0.002, whole(here + (there + shift - here) * m), here)


VIGNETTE, CLEAR = 0.85, 0.45


def vignette(a: np.ndarray, amount: float) -> np.ndarray:
    """Darker (or lighter) towards the corners; the inner CLEAR of the way there stays."""
    h, w = a.shape[-3:-1]
    rows, cols = np.mgrid[0:h, 0:w]
    square = ((cols - w / 2) ** 2 + (rows - h / 2) ** 2) / ((w / 2) ** 2 + (h / 2) ** 2)
    d = np.sqrt(np.floor(np.minimum(1, square) * 1024) / 1024)
    return whole(a * np.where(d <= CLEAR, 1, 1 - amount / 100 * VIGNETTE * ((d - CLEAR) / (1 - CLEAR)) ** 2)[..., None])


#: The sliders that are drawn.
BASICS, TONES, DETAIL = ("exposure", "contrast", "saturation"), ("temperature", "tint", "highlights", "shadows", "whites", "blacks"), ("noise", "clarity", "sharpen")
SLIDERS = (*BASICS, *TONES, *DETAIL, "vignette", "rotation")
BAND_PARTS = ("hue", "saturation", "luminance")


def draw(frames: np.ndarray, part: Callable) -> np.ndarray:
    """All edits of a stack of healed frames, in their order.

    ``part(name)``: what the frames have of a kind of edits, None if the table
    has no such column: "edits" (n, SLIDERS), "bands" (n, BANDS, BAND_PARTS),
    "curves" (a dict of points for each frame), "points" (an array of POINT for
    each) and "crop" (n, 4), not a number where there is none."""
    out, n = frames.astype(float), len(frames)
    given = part("edits")
    e = {k: given[:, i] if given is not None else np.zeros(n) for i, k in enumerate(SLIDERS)}

    def step(which: np.ndarray, run: Callable) -> None:
        k = np.flatnonzero(which)
        if len(k):
            out[k] = run(out[k], k)

    asks = lambda names: np.any([e[k] != 0 for k in names], axis=0)
    own = lambda k, names: {x: e[x][k, None, None] for x in names}
    step(asks(BASICS), lambda a, k: basics(a, own(k, BASICS)))
    crop = part("crop")
    crops = np.full((n, 4), np.nan) if crop is None else crop
    cut = ~np.isnan(crops).any(axis=1)
    crops = np.where(cut[:, None], crops, [0.0, 0.0, 1.0, 1.0])
    crop_of = lambda k: dict(zip(("x", "y", "width", "height"), crops[k].T[:, :, None, None], strict=True))
    step(cut | (e["rotation"] != 0), lambda a, k: placed(a, crop_of(k), e["rotation"][k, None, None]))
    out = whole(out)
    step(asks(TONES), lambda a, k: tones(a, own(k, TONES)))
    bands = part("bands")
    if bands is not None:
        active = (bands != 0).any(axis=2)
        for kind in np.unique(active[active.any(axis=1)], axis=0):
            names = [(i, b) for i, b in enumerate(BANDS) if kind[i]]
            step((active == kind).all(axis=1), lambda a, k: hue_bands(a, {b: {p: bands[k, i, j, None, None] for j, p in enumerate(BAND_PARTS)} for i, b in names}))  # noqa: B023
    for k, c in enumerate(part("curves") or []):
        if c:
            out[k] = curved(out[k], c)
    points = part("points")
    if points is not None:
        for has in (False, True):
            k = np.flatnonzero((cut == has) & np.array([len(p) > 0 for p in points], bool))
            if len(k):
                out[k] = control_points_of(out[k], [points[i] for i in k], crop_of(k) if has else None, e["rotation"][k])
    step(asks(DETAIL), lambda a, k: detail(a, own(k, DETAIL)))
    step(e["vignette"] != 0, lambda a, k: vignette(a, e["vignette"][k, None, None]))
    return out.astype(np.uint8)


#: What a style may touch; the rest of a photo's edits stays.
STYLE = ("exposure", "contrast", "saturation", "temperature", "tint", "highlights", "shadows", "whites", "blacks", "clarity", "vignette", "noise")
#: The styles, sliders and hue bands (saturation, luminance).
PRESETS: dict[str, tuple[dict[str, float], dict[str, tuple[float, float]]]] = {
    "natural": ({"contrast": 12, "shadows": 12, "clarity": 10, "blacks": -5}, {}),
    "portrait": ({"temperature": 8, "shadows": 16, "highlights": -8, "clarity": -8, "contrast": 6}, {"orange": (-6, 8), "red": (-4, 0)}),
    "landscape": ({"contrast": 14, "clarity": 18, "whites": 8, "blacks": -8}, {"green": (14, -6), "blue": (16, -8)}),
    "bw": ({"saturation": -100, "contrast": 22, "blacks": -14, "whites": 10, "clarity": 12}, {}),
    "sunset": ({"temperature": 20, "highlights": -14, "shadows": 10, "contrast": 8}, {"orange": (18, 6), "magenta": (10, 0)}),
    "indoor": ({"temperature": -14, "shadows": 22, "blacks": -6, "noise": 25, "contrast": 6}, {}),
}


def preset(edits: Column, name: str) -> tuple[Column, Column]:
    """(edits, bands) after a style: its sliders, 0 for those that it leaves out, and what else there was (crop, rotation, sharpening)."""
    sliders, bands = PRESETS[name]
    kept = F.map_filter(F.coalesce(edits, F.create_map().cast("map<string,double>")), lambda k, _: ~k.isin(*STYLE))
    styled = F.create_map(*[F.lit(x) for k in STYLE for x in (k, float(sliders.get(k, 0)))])
    made = [x for k, (s, l) in bands.items() for x in (F.lit(k), F.struct(F.lit(0.0).alias("hue"), F.lit(float(s)).alias("saturation"), F.lit(float(l)).alias("luminance")))]
    none = F.lit(None).cast("map<string,struct<hue:double,saturation:double,luminance:double>>")
    return F.map_concat(kept, styled), F.create_map(*made).cast("map<string,struct<hue:double,saturation:double,luminance:double>>") if made else none


PARTS = ("edits", "bands", "curves", "points", "heal", "crop")


def neutral(columns: list[str]) -> Column:
    """Nothing of a row's edits changes anything."""
    out = F.lit(True)
    if "edits" in columns:
        out = out & ~F.coalesce(F.exists(F.map_values("edits"), lambda v: F.coalesce(v, F.lit(0.0)) != 0), F.lit(False))
    if "bands" in columns:
        out = out & ~F.coalesce(F.exists(F.map_values("bands"), lambda b: (b["hue"] != 0) | (b["saturation"] != 0) | (b["luminance"] != 0)), F.lit(False))
    if "points" in columns:
        out = out & ~F.coalesce(F.exists("points", lambda q: (q["brightness"] != 0) | (q["contrast"] != 0) | (q["saturation"] != 0) | (q["structure"] != 0)), F.lit(False))
    if "curves" in columns:
        out = out & ~F.coalesce(F.exists(F.map_values("curves"), lambda c: F.exists(c, lambda q: q["x"] != q["y"])), F.lit(False))
    if "heal" in columns:
        out = out & (F.coalesce(F.size("heal"), F.lit(0)) <= 0)
    return out & F.col("crop").isNull() if "crop" in columns else out


def told(name: str) -> list[Column]:
    """The columns that a kind of edits goes to Python as: flat arrays of numbers."""
    number = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    xs = lambda c, k: F.transform(c, lambda q: q[k].cast("double"))
    if name in ("edits", "bands", "curves"):  # once each, so that a map is not made again for each of its keys
        return [F.col(name)]
    if name == "points":
        return [F.flatten(F.transform("points", lambda p: F.array(*[number(p[k]) for k in POINT])))]
    if name == "heal":
        ends = F.coalesce("heal", F.array())
        return [xs(ends, "radius"), *[F.transform(ends, lambda s: xs(F.coalesce(s["points"], F.array()), k)) for k in "xy"]]  # noqa: B023
    return [F.when(F.col("crop").isNotNull(), F.array(*[F.col("crop")[k].cast("double") for k in ("x", "y", "width", "height")]))]


CURVES = ("all", "r", "g", "b")


def rows_of(a: pa.Array) -> list[np.ndarray]:
    """The arrays of a column, an empty one for null."""
    ends = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False)))
    values = a.flatten().to_numpy(zero_copy_only=False)
    return [values[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def entries(maps: pa.MapArray, names: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row, place of the key among ``names`` (-1: none of them) and value of every entry of a column of maps."""
    n = np.diff(maps.offsets.to_numpy())
    lo, size = maps.offsets[0].as_py(), int(n.sum())
    place = pc.fill_null(pc.index_in(maps.keys.slice(lo, size), value_set=pa.array(names)), -1)
    items = maps.items.slice(lo, size)
    # a slice of lists or structs is told apart from what it is cut of
    return np.repeat(np.arange(len(maps)), n), place.to_numpy(zero_copy_only=False), items if lo == 0 and size == len(maps.items) else items.take(pa.array(np.arange(size)))


def taken(name: str, columns: list[pa.Array], k: np.ndarray) -> object:
    """What ``draw`` asks for of a kind of edits, for rows k of a batch."""
    columns = [c.take(pa.array(k)) for c in columns]
    if name in ("edits", "bands", "curves"):
        row, own, items = entries(columns[0], {"edits": SLIDERS, "bands": tuple(BANDS), "curves": CURVES}[name])
        if name == "curves":
            out: list[dict] = [{} for _ in k]
            xs, ys = (rows_of(pa.ListArray.from_arrays(items.offsets, v)) for v in (items.values.field("x").cast(pa.float64()), items.values.field("y").cast(pa.float64())))
            for i, c, x, y in zip(row.tolist(), own.tolist(), xs, ys, strict=True):
                if c >= 0 and len(x):
                    out[i][CURVES[c]] = tuple(zip(x.tolist(), y.tolist(), strict=True))
            return [{c: o[c] for c in CURVES if c in o} for o in out]
        known = own >= 0
        flat = lambda v: np.nan_to_num(pc.fill_null(v.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)[known], posinf=np.inf, neginf=-np.inf)
        shape = (len(k), len(SLIDERS)) if name == "edits" else (len(k), len(BANDS), len(BAND_PARTS))
        out = np.zeros(shape)
        if name == "edits":
            out[row[known], own[known]] = flat(items)
        else:
            for j, v in enumerate(items.flatten()):
                out[row[known], own[known], j] = flat(v)
        return out
    if name == "crop":
        return np.array([r if len(r) else [np.nan] * 4 for r in rows_of(columns[0])])
    if name == "points":
        return [np.nan_to_num(r.reshape(-1, len(POINT))) for r in rows_of(columns[0])]
    if name == "heal":
        counts = lambda c: pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        radius, xs, ys = (c.flatten() for c in columns)
        return counts(columns[0]), radius.to_numpy(zero_copy_only=False), counts(xs), *(v.flatten().to_numpy(zero_copy_only=False) for v in (xs, ys))
    raise ValueError(name)


def edited(frames: DataFrame) -> DataFrame:
    """Replace ``pixels`` by the frame with its edits drawn; broken frames and those without edits stay as they are."""
    have = [c for c in PARTS if c in frames.columns]
    given = {c: told(c) for c in have}
    at, n = {}, 0
    for c in have:
        at[c] = slice(n, n + len(given[c]))
        n += len(given[c])

    @F.arrow_udf("binary")
    def run(pixels: pa.Array, width: pa.Array, height: pa.Array, same: pa.Array, *columns: pa.Array) -> pa.Array:
        drawn, place = [], np.full(len(pixels), -1)
        own = lambda c, k: taken(c, list(columns[at[c]]), k) if c in at else None
        for k, a in stacks(pixels, width, height, ~same.to_numpy(zero_copy_only=False), HEAL_PIXELS if "heal" in at else STACK):
            if "heal" in at:
                heal(a, *own("heal", k))
            place[k] = np.arange(len(drawn), len(drawn) + len(k))
            step = max(1, STACK // (a.shape[1] * a.shape[2]))
            for i in range(0, len(k), step):
                drawn += [x.tobytes() for x in draw(a[i : i + step], lambda c: own(c, k[i : i + step]))]  # noqa: B023
        new = pa.array(drawn, pa.binary()).take(pa.array(place, mask=place < 0))
        return pc.if_else(pa.array(place >= 0), new, pixels)

    return frames.withColumn("pixels", run("pixels", "width", "height", neutral(have), *[c for k in have for c in given[k]]))
