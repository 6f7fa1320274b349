"""Image kernels over rows of RGB pixels, as Arrow batches (edits.py draws on them).

A frame is a row with width, height and ``pixels`` (BINARY, RGB, row by row).
Each kernel is a numpy function over a stack of frames of one size (called with
one (h, w, 3) array, it tells of that one); ``measure`` runs those asked for in
one pass over the batch, so pixels go to Python once. A stack has about STACK
pixels: what a kernel holds is bounded, and numpy is called once for many frames."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache, wraps

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def luma(rgb: np.ndarray) -> np.ndarray:
    return rgb.astype(np.float64) @ np.array([0.299, 0.587, 0.114])


#: Pixels of the frames that are worked on at once, at about.
STACK = 1 << 14


def stacks(pixels: pa.Array, width: pa.Array, height: pa.Array, wanted: np.ndarray | None = None, most: int = STACK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, frames): the whole frames of a batch (of ``wanted`` rows) as (n, h, w, 3) arrays of one size, of about ``most`` pixels."""
    pixels = pixels.cast(pa.large_binary())
    if not len(pixels) or pixels.buffers()[2] is None:
        return
    at = np.frombuffer(pixels.buffers()[1], np.int64)[pixels.offset : pixels.offset + len(pixels) + 1]
    data = np.frombuffer(pixels.buffers()[2], np.uint8)
    w, h = (pc.fill_null(x.cast(pa.int64()), 0).to_numpy(zero_copy_only=False) for x in (width, height))
    fit = (w > 0) & (h > 0) & (np.diff(at) == w * h * 3) & pc.is_valid(pixels).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(fit if wanted is None else fit & wanted)
    order = rows[np.lexsort((h[rows], w[rows]))]
    for own in np.split(order, np.flatnonzero((np.diff(w[order]) != 0) | (np.diff(h[order]) != 0)) + 1):
        if not len(own):
            continue
        size = int(w[own[0]]), int(h[own[0]])
        step = max(1, most // (size[0] * size[1]))
        for i in range(0, len(own), step):
            part = own[i : i + step]
            yield part, np.stack([data[at[k] : at[k + 1]] for k in part]).reshape(len(part), size[1], size[0], 3)


class Frames:
    """A stack of frames, and what several kernels ask of it."""

    def __init__(self, rgb: np.ndarray):
        self.rgb, self.n = rgb, len(rgb)

    @cached_property
    def luma(self) -> np.ndarray:
        return luma(self.rgb)

    @cached_property
    def flat(self) -> np.ndarray:
        return self.luma.reshape(self.n, -1)

    @cached_property
    def sobel(self) -> tuple[np.ndarray, np.ndarray]:
        return sobel(self.luma)

    @cached_property
    def steep(self) -> np.ndarray:
        return np.hypot(*self.sobel)

    @cached_property
    def tiny(self) -> bool:
        return min(self.rgb.shape[1:3]) < 3

    def count(self, which: np.ndarray, at: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
        """(frames, n): a histogram for each frame; ``which`` says whose a value is."""
        return np.bincount(which * n + at, weights, self.n * n).reshape(self.n, n)

    @property
    def places(self) -> np.ndarray:
        return np.arange(self.n)[:, None]


def of_one(many: Callable) -> Callable:
    """A kernel of stacks, to be called with one frame; ``many`` is the kernel itself."""

    @wraps(many)
    def one(rgb: np.ndarray, *args: object, **named: object) -> object:
        out = many(Frames(rgb[None]), *args, **named)
        return out[0].item() if isinstance(out, np.ndarray) else out[0]

    one.many = many
    return one


@lru_cache(maxsize=256)
def area_weights(n: int, m: int) -> np.ndarray:
    """(m, n): how much of each of n cells lies in each of m, as shares of the larger one."""
    edges, at = np.arange(m + 1) * n / m, np.arange(n)
    cover = np.minimum(edges[1:, None], at[None, :] + 1) - np.maximum(edges[:-1, None], at[None, :])
    return np.maximum(0, cover) * m / n


def area(rgb: np.ndarray, w: int, h: int) -> np.ndarray:
    """A frame (or a stack of them) in another size, every pixel the mean of the area that it covers, in whole values."""
    *n, high, wide, _ = rgb.shape
    rows = np.matmul(area_weights(high, h), rgb.reshape(*n, high, wide * 3).astype(np.float64)).reshape(*n, h, wide, 3)
    out = np.matmul(area_weights(wide, w), rows)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


@of_one
def dhash(f: Frames) -> np.ndarray:
    """64 bits: is each of 9x8 areas brighter than the one to its right."""
    return hash_bits(area(f.rgb, 9, 8))


def hash_bits(level: np.ndarray) -> np.ndarray:
    s = luma(level)
    return np.packbits((s[..., :-1] > s[..., 1:]).reshape(len(s), -1), axis=1).view(">u8")[:, 0].astype(np.uint64).view(np.int64)


#: Longest sides of the smaller versions of a frame; the last level is what dhash sees.
THUMB, TINY, HASH_LEVEL = 480, 24, (9, 8)


def pyramid(frames: DataFrame, thumb: int = THUMB, tiny: int = TINY) -> DataFrame:
    """Add ``levels``: an array of (name, width, height, scale, pixels) of the smaller versions of each frame, and ``dhash`` of the last; null for broken frames."""

    named = pa.struct([("name", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("scale", pa.float64()), ("pixels", pa.binary())])

    @F.arrow_udf("levels array<struct<name:string,width:int,height:int,scale:double,pixels:binary>>, dhash bigint")
    def run(pixels: pa.Array, width: pa.Array, height: pa.Array) -> pa.Array:
        places, names, sizes, own, hashes = [], [], [], [], []
        for part, a in stacks(pixels, width, height):
            for k, (name, side) in enumerate((("thumb", thumb), ("tiny", tiny), ("hash", None))):
                if side:
                    scale = min(1.0, side / max(a.shape[1:3]))
                    x, y = (max(1, int(np.floor(n * scale + 0.5))) for n in (a.shape[2], a.shape[1]))
                else:
                    (x, y), scale = HASH_LEVEL, HASH_LEVEL[0] / a.shape[2]
                small = area(a, x, y)
                own += [r.tobytes() for r in small]
                places.append(part * 3 + k)
                names += [name] * len(part)
                sizes += [(x, y, scale)] * len(part)
            hashes.append((part, hash_bits(small)))
        n = len(pixels)
        found, value = np.zeros(n, bool), np.zeros(n, np.int64)
        for part, h in hashes:
            found[part], value[part] = True, h
        w, h, scale = zip(*sizes, strict=True) if sizes else ((), (), ())
        levels = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip((names, w, h, scale, own), named, strict=True)], fields=list(named))
        levels = levels.take(pa.array(np.argsort(np.concatenate(places)) if places else np.zeros(0, np.int64)))
        ends = pa.array(np.append(0, np.cumsum(3 * found)), pa.int32(), mask=np.append(~found, False))
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, levels), pa.array(value, mask=~found)], names=["levels", "dhash"])

    return frames.withColumn("_p", run("pixels", "width", "height")).select("*", "_p.levels", "_p.dhash").drop("_p")


def laplacian(y: np.ndarray) -> np.ndarray:
    return 4 * y[..., 1:-1, 1:-1] - y[..., :-2, 1:-1] - y[..., 2:, 1:-1] - y[..., 1:-1, :-2] - y[..., 1:-1, 2:]


def sobel(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a = y[..., 2:] - y[..., :-2]
    b = y[..., 2:, :] - y[..., :-2, :]
    return a[..., :-2, :] + 2 * a[..., 1:-1, :] + a[..., 2:, :], b[..., :-2] + 2 * b[..., 1:-1] + b[..., 2:]


@of_one
def sharpness(f: Frames) -> np.ndarray:
    if f.tiny:
        return np.zeros(f.n)
    return np.minimum(100, np.floor(np.sqrt(laplacian(f.luma).reshape(f.n, -1).var(axis=1)) * 2.2 + 0.5))


@of_one
def exposure(f: Frames) -> np.ndarray:
    return np.floor(f.flat[:, ::4].mean(axis=1) / 255 * 100 + 0.5)


@of_one
def highlight_clipping(f: Frames) -> np.ndarray:
    """Share of every fourth pixel without detail in the lights."""
    return (f.flat[:, ::4] >= 250).mean(axis=1)


@of_one
def shadow_clipping(f: Frames) -> np.ndarray:
    return (f.flat[:, ::4] <= 5).mean(axis=1)


#: Least gradient, steepest edge in degrees, and least number of edge pixels as a share of the width, of a horizon.
HORIZON_GRADIENT, HORIZON_DEGREES, HORIZON_LENGTH = 18, 45, 0.5


def horizon_tilt(rgb: np.ndarray) -> float | None:
    """Mean direction of nearly horizontal edges in degrees, to a tenth, weighted by gradient; doubled angles make a line and its reverse the same."""
    if min(rgb.shape[:2]) < 3:
        return None
    gx, gy = sobel(luma(rgb))
    m = np.hypot(gx, gy)
    edge = (np.degrees(np.arctan2(gy, gx)) + 180) % 180 - 90
    use = (m >= HORIZON_GRADIENT) & (np.abs(edge) <= HORIZON_DEGREES)
    if use.sum() < HORIZON_LENGTH * rgb.shape[1]:
        return None
    t = np.radians(2 * edge[use])
    mean = np.degrees(np.arctan2((m[use] * np.sin(t)).sum(), (m[use] * np.cos(t)).sum())) / 2
    return float(np.floor(mean * 10 + 0.5) / 10)


#: Gradients from EDGE on are edges; share of one of 18 directions that makes lines lead; likeness of the halves that makes a frame symmetric; variance below which a cell is empty.
EDGE, LEADING, SYMMETRIC, EMPTY = 18, 0.22, 0.6, 60


def block_sums(y: np.ndarray, rows: int, cols: int) -> tuple[np.ndarray, int]:
    """Sums of whole blocks of a grid, for each of a stack, and the pixels of a block; what is left over at the right and below is in none."""
    n, high, wide = y.shape
    bh, bw = max(1, high // rows), max(1, wide // cols)
    r, c = min(rows, high // bh), min(cols, wide // bw)
    return y[:, : r * bh, : c * bw].reshape(n, r, bh, c, bw).sum(axis=(2, 4)).reshape(n, r * c), bh * bw


@of_one
def symmetry(f: Frames, grid: int = 16) -> np.ndarray:
    """Edges of the left half lie as those of the right half do in a mirror."""
    m = np.zeros(f.rgb.shape[:3])  # 0 along the border
    if not f.tiny:
        m[:, 1:-1, 1:-1] = f.steep
    half = m.shape[2] // 2
    if not half:
        return np.zeros(f.n, bool)
    a, b = block_sums(m[..., :half], grid, grid)[0], block_sums(m[..., ::-1][..., :half], grid, grid)[0]
    aa, bb, ab = (a * a).sum(axis=1), (b * b).sum(axis=1), (a * b).sum(axis=1)
    some = (aa >= 1) & (bb >= 1)
    return some & (ab / np.sqrt(np.where(some, aa * bb, 1)) > SYMMETRIC)


@of_one
def negative_space(f: Frames, grid: int = 10) -> np.ndarray:
    """Share of cells in which next to nothing happens."""
    y = f.luma
    total, n = block_sums(y, grid, grid)
    if not total.shape[1]:
        return np.zeros(f.n)
    return (block_sums(y * y, grid, grid)[0] / n - (total / n) ** 2 < EMPTY).mean(axis=1)


@of_one
def leading_lines(f: Frames) -> np.ndarray:
    """One of 18 edge directions holds more than LEADING of all edges, by their strength."""
    if f.tiny:
        return np.zeros(f.n, bool)
    use = np.nonzero(f.steep >= EDGE)
    gx, gy = (g[use] for g in f.sobel)
    along = (np.degrees(np.arctan2(gy, gx)) + 180) % 180
    n = f.count(use[0], np.minimum(17, (along / 10).astype(int)), 18, f.steep[use])
    total = n.sum(axis=1)
    return (total >= 1) & (n.max(axis=1) / np.where(total >= 1, total, 1) > LEADING)


@of_one
def light_quality(f: Frames) -> list[str]:
    """hard, soft or mixed, from how many edges are strong and how far luma spreads; unknown without edges."""
    m = f.steep.reshape(f.n, -1) if not f.tiny else np.zeros((f.n, 0))
    edges, spread = (m > 4).sum(axis=1), f.flat.std(axis=1)
    none = (edges < 0.01 * f.flat.shape[1]) | (edges == 0)
    strong = (m > 90).sum(axis=1) / np.maximum(edges, 1)
    kinds = [none, (strong > 0.1) & (spread > 55), (strong < 0.04) & (spread < 42)]
    return np.select(kinds, ["unknown", "hard", "soft"], "mixed").tolist()


def catchlight(rgb: np.ndarray) -> bool:
    """One bright spot in a picture of an eye: at least 200, and 60 above what lies around it."""
    y = luma(rgb)
    h, w = y.shape
    r, c = np.unravel_index(int(y.argmax()), y.shape)
    rows, cols = np.mgrid[0:h, 0:w]
    around = np.hypot(rows - r, cols - c) > max(1, np.floor(min(h, w) * 0.15 + 0.5))
    return bool(y[r, c] >= 200 and around.any() and y[r, c] - y[around].mean() >= 60)


#: Pixels that a region needs; variance from which a subject is sharp; its least share of the background's; shares of the subject's variance that make the background blurred.
REGION, SHARP, IN_FOCUS, GOOD, AVERAGE = 20, 40, 0.5, 0.35, 0.65


def focus(rgb: np.ndarray, boxes: list[list[float]]) -> tuple[bool | None, str, float | None]:
    """Is the subject in ``boxes`` (shares of the frame) in focus, how good is the blur behind it, and the subject's sharpness; n/a without a region of either."""
    y = luma(rgb)
    h, w = y.shape
    inside = np.zeros((h, w), bool)
    edge = lambda v, most: int(min(most, max(0, np.floor(v * most + 0.5))))
    for x, top, wide, high in boxes:
        inside[edge(top, h) : edge(top + high, h), edge(x, w) : edge(x + wide, w)] = True
    if min(h, w) < 3:
        return None, "n/a", None
    lap, inside = laplacian(y), inside[1:-1, 1:-1]
    if inside.sum() < REGION or (~inside).sum() < REGION:
        return None, "n/a", None
    own, behind = float(lap[inside].var()), float(lap[~inside].var())
    share = behind / max(own, 1.0)
    blur = "n/a" if own < SHARP else "good" if share < GOOD else "average" if share < AVERAGE else "poor"
    return own > SHARP and own >= IN_FOCUS * behind, blur, float(min(100, np.floor(np.sqrt(own) * 2.2 + 0.5)))


def blended_sharpness(whole: float, subject: float | None) -> float:
    return whole if subject is None else float(np.floor(0.7 * subject + 0.3 * whole + 0.5))


def subjects(frames: DataFrame) -> DataFrame:
    """Add a struct ``subject``: in_focus, bokeh and sharpness (of the subject in ``boxes`` and of the frame, blended); null for broken frames."""

    @F.pandas_udf("in_focus boolean, bokeh string, sharpness double")
    def run(pixels: pd.Series, width: pd.Series, height: pd.Series, boxes: pd.Series) -> pd.DataFrame:
        rows = []
        for p, w, h, b in zip(pixels, width, height, boxes, strict=True):
            a = decode(p, w, h)
            sharp, blur, own = (None, None, None) if a is None else focus(a, [] if b is None else [list(x) for x in b])
            rows.append((sharp, blur, None if a is None else blended_sharpness(sharpness(a), own)))
        return pd.DataFrame(rows, columns=["in_focus", "bokeh", "sharpness"])

    return frames.withColumn("subject", run("pixels", "width", "height", "boxes"))


def hue(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    c = rgb.astype(np.float64) / 255
    r, g, b = (np.ascontiguousarray(c[..., i]) for i in range(3))
    top, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    d = np.where(top > low, top - low, 1)
    h = np.where(top == r, (g - b) / d % 6, np.where(top == g, (b - r) / d + 2, (r - g) / d + 4)) * 60
    return np.where(top > low, h, 0), np.where(top > 0, (top - low) / np.where(top > 0, top, 1), 0), top


#: Hue bins; mean saturation below which a frame is grey, and what its harmony counts then; warm share and saturation of a golden hour, and its exposures.
HUES, GREY, GREY_HARMONY, WARM, RICH, LIT = 12, 0.12, 0.85, 0.3, 0.25, (25, 85)


@of_one
def colours(f: Frames) -> list[dict]:
    """harmony (share of the three heaviest hues), dominant (their mean colours) and golden_hour, from every second pixel weighted by saturation and brightness."""
    px = f.rgb.reshape(f.n, -1, 3)[:, ::2]
    h, s, v = hue(px)
    weight = s * v
    at = np.minimum(HUES - 1, (h / (360 / HUES)).astype(int))
    of = np.broadcast_to(f.places, at.shape).ravel()
    count = lambda w: f.count(of, at.ravel(), HUES, w.ravel())
    n = count(weight)
    total, rich = n.sum(axis=1), s.mean(axis=1)
    order = np.argsort(-n, axis=1, kind="stable")[:, :3]
    heavy = np.take_along_axis(n, order, 1)
    sums = np.stack([np.take_along_axis(count(px[..., i] * weight), order, 1) for i in range(3)], axis=2)
    mean = np.floor(sums / np.where(heavy > 0, heavy, 1)[..., None] + 0.5).astype(int)
    some = np.where(total > 0, total, 1)
    harmony = np.where(rich < GREY, GREY_HARMONY, np.where(total > 0, np.minimum(1.0, heavy.sum(axis=1) / some), 0.5))
    lit = exposure.many(f)
    golden = (total > 0) & ((n[:, 0] + n[:, 1]) / some > WARM) & (rich > RICH) & (LIT[0] < lit) & (lit < LIT[1])
    named = [[f"#{r:02x}{g:02x}{b:02x}" for (r, g, b), k in zip(m, there, strict=True) if k] for m, there in zip(mean.tolist(), (heavy > 0).tolist(), strict=True)]
    rounded = np.floor(harmony * 100 + 0.5) / 100
    return [{"harmony": x, "dominant": d, "golden_hour": g} for x, d, g in zip(rounded.tolist(), named, golden.tolist(), strict=True)]


#: Hues of skin, in degrees, and the saturation from which a pixel has one.
SKIN_UPTO, SKIN_FROM, SKIN_SATURATION = 50, 350, 0.08


class Boxes:
    """Boxes (ARRAY<ARRAY<DOUBLE>>: left, top, width and height as shares) of the frames of a batch, and the parts of frames that they cut out."""

    def __init__(self, boxes: pa.Array):
        self.known = pc.is_valid(boxes).to_numpy(zero_copy_only=False)
        self.n = pc.fill_null(pc.list_value_length(boxes), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        inner = boxes.flatten()
        begin = np.append(0, np.cumsum(pc.list_value_length(inner).to_numpy(zero_copy_only=False).astype(np.int64)))[:-1]
        values = inner.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        self.at = values[begin[:, None] + np.arange(4)] if len(begin) else np.zeros((0, 4))
        self.first = np.cumsum(self.n) - self.n

    def parts(self, places: np.ndarray, frames: np.ndarray, edges: Callable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(boxes, parts) of one size, not empty; ``edges``: left, top, right and bottom in pixels of some boxes in frames of a size."""
        of = np.repeat(np.arange(len(places)), self.n[places])
        own = np.concatenate([np.arange(self.first[p], self.first[p] + self.n[p]) for p in places]).astype(np.int64)
        h, w = frames.shape[1:3]
        x0, y0, x1, y1 = (e.astype(np.int64) for e in edges(self.at[own], w, h))
        wide, high = x1 - x0, y1 - y0
        some = np.flatnonzero((wide > 0) & (high > 0))
        order = some[np.lexsort((high[some], wide[some]))]
        for k in np.split(order, np.flatnonzero((np.diff(wide[order]) != 0) | (np.diff(high[order]) != 0)) + 1):
            if len(k):
                rows, cols = np.arange(high[k[0]]), np.arange(wide[k[0]])
                yield own[k], frames[of[k, None, None], (y0[k, None] + rows)[:, :, None], (x0[k, None] + cols)[:, None, :]]


def box_edges(b: np.ndarray, w: int, h: int) -> tuple[np.ndarray, ...]:
    edge = lambda v, n: np.clip(np.floor(v * n + 0.5), 0, n)
    return edge(b[:, 0], w), edge(b[:, 1], h), edge(b[:, 0] + b[:, 2], w), edge(b[:, 1] + b[:, 3], h)


def skin_like(parts: np.ndarray) -> list[bool | None]:
    """Is the mean hue of each of a stack one of skin; None without colour."""
    t, s, v = (x.reshape(len(parts), -1) for x in hue(parts))
    weight = np.where(s >= SKIN_SATURATION, s * v, 0)
    t = np.radians(t)
    mean = np.degrees(np.arctan2((weight * np.sin(t)).sum(axis=1), (weight * np.cos(t)).sum(axis=1))) % 360
    skin = (mean <= SKIN_UPTO) | (mean >= SKIN_FROM)
    return [k if enough else None for k, enough in zip(skin.tolist(), (weight.sum(axis=1) >= 1).tolist(), strict=True)]


def natural_skin(rgb: np.ndarray, box: list[float]) -> bool | None:
    """Is the mean hue in a face's box one of skin; None without colour."""
    x0, y0, x1, y1 = (int(v[0]) for v in box_edges(np.array([box], float), rgb.shape[1], rgb.shape[0]))
    part = rgb[y0:y1, x0:x1]
    return skin_like(part[None])[0] if part.size else None


def skin_tones(frames: DataFrame) -> DataFrame:
    """Add ``natural_skin``: an array of what the boxes of each frame show (null where it can't be told), and ``skin_ratio``, the share that is natural of those that can."""

    @F.arrow_udf("array<boolean>")
    def run(pixels: pa.Array, width: pa.Array, height: pa.Array, boxes: pa.Array) -> pa.Array:
        b, whole = Boxes(boxes), np.zeros(len(pixels), bool)
        told: list[bool | None] = [None] * len(b.at)
        for places, a in stacks(pixels, width, height):
            whole[places] = True
            for own, parts in b.parts(places, a, box_edges):
                for k, x in zip(own.tolist(), skin_like(parts), strict=True):
                    told[k] = x
        return pa.array([told[i : i + n] if k else None for i, n, k in zip(b.first.tolist(), b.n.tolist(), (whole & b.known).tolist(), strict=True)], pa.list_(pa.bool_()))

    known = F.filter("natural_skin", lambda x: x.isNotNull())
    return frames.withColumn("natural_skin", run("pixels", "width", "height", "boxes")).withColumn("skin_ratio", F.when(F.size(known) > 0, F.size(F.filter(known, lambda x: x)) / F.size(known)))


BUCKETS, BLACK, WHITE = 64, 2, 253


@of_one
def histogram(f: Frames, stride: int = 4) -> list[dict]:
    """Counts of every ``stride``-th pixel in BUCKETS of red, green, blue and luma, the highest of the three colours, and the shares without detail at either end."""
    px = f.rgb.reshape(f.n, -1, 3)[:, :: max(1, stride)].astype(int)
    of = np.broadcast_to(f.places, px.shape[:2]).ravel()
    count = lambda v: f.count(of, np.minimum(BUCKETS - 1, (v * BUCKETS / 256).astype(int)).ravel(), BUCKETS)
    r, g, b = (px[..., i] for i in range(3))
    c = {k: count(v) for k, v in zip("rgb", (r, g, b), strict=True)}
    c["luma"] = count((r * 299 + g * 587 + b * 114) / 1000)
    peak = np.maximum(np.maximum(c["r"].max(axis=1), c["g"].max(axis=1)), c["b"].max(axis=1))
    some = px.shape[1] > 0
    shadows = ((r <= BLACK) & (g <= BLACK) & (b <= BLACK)).mean(axis=1) if some else np.zeros(f.n)
    highlights = ((r >= WHITE) | (g >= WHITE) | (b >= WHITE)).mean(axis=1) if some else np.zeros(f.n)
    columns = {**{k: v.tolist() for k, v in c.items()}, "peak": peak.tolist(), "shadows": shadows.tolist(), "highlights": highlights.tolist()}
    return [dict(zip(columns, row, strict=True)) for row in zip(*columns.values(), strict=True)]


KERNELS: dict[str, tuple[str, Callable]] = {
    "dhash": ("bigint", dhash), "sharpness": ("double", sharpness), "exposure": ("double", exposure), "highlight_clipping": ("double", highlight_clipping), "shadow_clipping": ("double", shadow_clipping),
    "horizon_tilt": ("double", horizon_tilt), "symmetry": ("boolean", symmetry), "negative_space": ("double", negative_space), "leading_lines": ("boolean", leading_lines), "light_quality": ("string", light_quality), "catchlight": ("boolean", catchlight), 
    "colours": ("struct<harmony:double,dominant:array<string>,golden_hour:boolean>", colours), "histogram": ("struct<r:array<int>,g:array<int>,b:array<int>,luma:array<int>,peak:int,shadows:double,highlights:double>", histogram),
}


_ints = pa.list_(pa.int32())
#: The same types, as Arrow says them.
TYPES = {n: {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}.get(t) for n, (t, _) in KERNELS.items()} | {
    "colours": pa.struct([("harmony", pa.float64()), ("dominant", pa.list_(pa.string())), ("golden_hour", pa.bool_())]),
    "histogram": pa.struct([*((k, _ints) for k in ("r", "g", "b", "luma")), ("peak", pa.int32()), ("shadows", pa.float64()), ("highlights", pa.float64())]),
}


def decode(pixels: bytes | None, width: int, height: int) -> np.ndarray | None:
    """None for what is no whole frame."""
    if pixels is None or not width or not height or len(pixels) != width * height * 3:
        return None
    return np.frombuffer(pixels, np.uint8).reshape(int(height), int(width), 3)


def measure(frames: DataFrame, *names: str) -> DataFrame:
    """Add a struct ``measures`` with the kernels asked for (all by default); null for broken frames."""
    names = names or tuple(KERNELS)

    @F.arrow_udf(", ".join(f"{n} {KERNELS[n][0]}" for n in names))
    def run(pixels: pa.Array, width: pa.Array, height: pa.Array) -> pa.Array:
        order, cols = [], [[] for _ in names]
        for places, a in stacks(pixels, width, height):
            order.append(places)
            f = Frames(a)
            for c, n in zip(cols, names, strict=True):
                kernel = KERNELS[n][1]
                c.append(pa.array(kernel.many(f) if hasattr(kernel, "many") else [kernel(x) for x in a], TYPES[n]))
        # rows of broken frames are null
        back = np.full(len(pixels), -1)
        if order:
            back[np.concatenate(order)] = np.arange(sum(map(len, order)))
        at = pa.array(back, mask=back < 0)
        return pa.StructArray.from_arrays([pa.chunked_array(c, TYPES[n]).combine_chunks().take(at) for c, n in zip(cols, names, strict=True)], names=list(names))

    return frames.withColumn("measures", run("pixels", "width", "height"))
