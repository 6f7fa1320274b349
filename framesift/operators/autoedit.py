"""Automatic adjustments: what a frame's pixels say is measured once, in Arrow; what follows from it are SQL expressions.

``tones`` adds a struct of whole counts and sums over every fourth pixel:
percentiles of luma, the sums of nearly neutral pixels, the sum of saturations,
and the luma of faces. ``adjustments`` are columns over that struct and the
signals of the photo view, all of them clamped so that an automatic edit is
never a strong one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import clamp, round_half_up
from .pixels import Boxes, Frames, luma, stacks

TONES = "n int, p1 int, p2 int, p10 int, p90 int, p98 int, p99 int, neutral int, neutral_r long, neutral_g long, neutral_b long, coloured int, saturation double, face_n int, face_luma double"
#: Luma and saturation of what counts as neutral, and luma of what counts as coloured.
NEUTRAL_LIGHT, NEUTRAL_SATURATION, COLOURED_LIGHT = (55, 245), 0.28, (30, 235)
#: The part of a face's box that is left out at each side.
INSET = 0.18


def measured(a: np.ndarray) -> list[np.ndarray]:
    """TONES of a stack of frames, but for the faces."""
    f = Frames(a)
    px = a.reshape(f.n, -1, 3)[:, ::4].astype(float)
    y = px @ np.array([0.299, 0.587, 0.114])
    of = np.broadcast_to(f.places, y.shape).ravel()
    h = f.count(of, np.clip(np.floor(y + 0.5), 0, 255).astype(int).ravel(), 256)
    n, up, down = px.shape[1], np.cumsum(h, axis=1), np.cumsum(h[:, ::-1], axis=1)
    at = lambda p: np.argmax(up / n >= p, axis=1)
    r, g, b = (np.ascontiguousarray(px[..., i]) for i in range(3))
    top, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    s = np.where(top > 0, (top - low) / np.where(top > 0, top, 1), 0)
    plain = (y >= NEUTRAL_LIGHT[0]) & (y <= NEUTRAL_LIGHT[1]) & (top > 0) & (s <= NEUTRAL_SATURATION)
    rich = (top > 0) & (y >= COLOURED_LIGHT[0]) & (y <= COLOURED_LIGHT[1])
    sums = [(c * plain).sum(axis=1).astype(np.int64) for c in (r, g, b)]
    saturation = np.array([float(x[k].sum()) for x, k in zip(s, rich, strict=True)])
    return [np.full(f.n, n), at(0.01), at(0.02), at(0.10), at(0.90), 255 - np.argmax(down / n >= 0.02, axis=1), at(0.99), plain.sum(axis=1), *sums, rich.sum(axis=1), saturation]


def inner_edges(b: np.ndarray, w: int, h: int) -> tuple[np.ndarray, ...]:
    """The inner part of boxes, in pixels; nothing of boxes without a size."""
    edge = lambda v, size: np.clip(np.floor(v * size + 0.5), 0, size)
    x, top, wide, high = b.T
    some = (wide > 0) & (high > 0)
    x0, y0 = edge(x + wide * INSET, w), edge(top + high * INSET, h)
    return x0, y0, np.where(some, edge(x + wide * (1 - INSET), w), x0), np.where(some, edge(top + high * (1 - INSET), h), y0)


def tones(frames: DataFrame, boxes: str = "boxes") -> DataFrame:
    """Add a struct ``tones``; null for broken frames. Frames are as large as they are given: shrink large ones first."""
    names = [c.split()[0] for c in TONES.split(", ")]
    types = [{"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}[c.split()[1]] for c in TONES.split(", ")]

    @F.arrow_udf(TONES)
    def run(pixels: pa.Array, width: pa.Array, height: pa.Array, faces: pa.Array) -> pa.Array:
        b = Boxes(faces)
        seen, light = np.zeros(len(b.at), np.int64), np.zeros(len(b.at))
        of = np.repeat(np.arange(len(pixels)), b.n)
        whole, cols = np.zeros(len(pixels), bool), [np.zeros(len(pixels)) for _ in names]
        for places, a in stacks(pixels, width, height):
            whole[places] = True
            for c, v in zip(cols, measured(a), strict=False):
                c[places] = v
            for own, parts in b.parts(places, a, inner_edges):
                seen[own] = parts.shape[1] * parts.shape[2]
                light[own] = luma(parts).reshape(len(own), -1).sum(axis=1) / 255
        cols[-2], cols[-1] = np.bincount(of, seen, len(pixels)), np.bincount(of, light, len(pixels))
        return pa.StructArray.from_arrays([pa.array(c if t == pa.float64() else c.astype(np.int64), t, mask=~whole) for c, t in zip(cols, types, strict=True)], names=names)

    out = frames.withColumn("tones", run("pixels", "width", "height", boxes))
    return out.withColumn("tones", F.when(F.col("tones.n") > 0, F.col("tones")))


def bounded(c: Column, low: float, high: float) -> Column:
    return round_half_up(clamp(c, low, high)).cast("long")


def stronger(a: Column, b: Column) -> Column:
    return F.when(F.abs(a) >= F.abs(b), a).otherwise(b)


#: Targets, slacks and limits of the adjustments.
FLAG, WHITE_AT, BLACK_AT, WHITE_SLACK, BLACK_SLACK, DAMPING, LEVELS_MOST, LEVEL_WEIGHT = 0.06, 248, 6, 236, 16, 0.7, 35, 0.03
DULL, GREY, VIBRANCE_MOST, CRUSHED, COMPRESSED, RECOVERY = 0.16, 0.04, 16, 34, 226, 34
FACE_DARK, FACE_BRIGHT, FACE_MOST, NEUTRAL_LEAST, BALANCE_MOST, GOLDEN = 0.22, 0.88, 30, 0.02, 30, 0.35
CENTRED, CROP, CROP_LITTLE, ARMS, HEAD, BODY, SMALL_FACE, TILT, TURN_MOST, CLASHING, FADE = 0.4, 0.78, 0.92, 1.2, 0.6, 2.5, 0.15, 2, 8, 0.35, -12


def t(name: str) -> Column:
    return F.col(f"tones.{name}")


def contrast() -> Column:
    spread = t("p98") - t("p2")
    return F.when(spread > 0, bounded((clamp(F.lit(200) / spread, 1, 1.6) - 1) * 100, 0, 35)).otherwise(0)


def balance() -> tuple[Column, Column]:
    """Temperature and tint that make nearly neutral pixels neutral, gently in a golden hour."""
    n = t("neutral")
    r, g, b = (t(f"neutral_{c}") / n for c in "rgb")
    k = F.when(F.coalesce("golden_hour", F.lit(False)), F.lit(GOLDEN)).otherwise(F.lit(1.0))
    enough = (n > 0) & (n / t("n") >= NEUTRAL_LEAST)
    warm = bounded(-(r - b) * 1.25 * k, -BALANCE_MOST, BALANCE_MOST)
    tint = bounded(-(g - (r + b) / 2) * (5 / 3) * k, -BALANCE_MOST, BALANCE_MOST)
    return F.when(enough, warm).otherwise(0), F.when(enough, tint).otherwise(0)


def levels() -> tuple[Column, Column]:
    """Whites and blacks that take the ends of the luma near to their targets."""
    up, down = F.pow(t("p99") / 255, F.lit(3.0)), F.pow(1 - t("p1") / 255, F.lit(3.0))
    white = bounded((WHITE_AT - t("p99")) / up / 55 * 100 * DAMPING, 0, LEVELS_MOST)
    black = bounded((BLACK_AT - t("p1")) / down / 55 * 100 * DAMPING, -LEVELS_MOST, 0)
    return F.when((t("p99") < WHITE_SLACK) & (up > LEVEL_WEIGHT), white).otherwise(0), F.when((t("p1") > BLACK_SLACK) & (down > LEVEL_WEIGHT), black).otherwise(0)


def vibrance() -> Column:
    mean = t("saturation") / t("coloured")
    dull = (t("coloured") > 0) & (mean >= GREY) & (mean < DULL)
    return F.when(dull, bounded((DULL - mean) / (DULL - GREY) * VIBRANCE_MOST, 0, VIBRANCE_MOST)).otherwise(0)


def recovery() -> tuple[Column, Column]:
    """Highlights and shadows: of what is clipped and what is only squeezed together, the stronger."""
    high, low = F.coalesce("highlight_clipping", F.lit(0.0)), F.coalesce("shadow_clipping", F.lit(0.0))
    clipped = F.when(high > FLAG, bounded(-(high * 300), -40, -8)).otherwise(0), F.when(low > FLAG, bounded(low * 300, 8, 40)).otherwise(0)
    lights = F.when(t("p90") > COMPRESSED, -bounded((t("p90") - COMPRESSED) / (255 - COMPRESSED) * RECOVERY, 0, RECOVERY)).otherwise(0)
    darks = F.when(t("p10") < CRUSHED, bounded((CRUSHED - t("p10")) / F.lit(CRUSHED) * RECOVERY, 0, RECOVERY)).otherwise(0)
    return stronger(clipped[0], lights), stronger(clipped[1], darks)


def exposure() -> Column:
    """By the faces if they are too dark or too bright, else by the frame."""
    mean = t("face_luma") / t("face_n")
    face = F.when(t("face_n") > 0, F.when(mean < FACE_DARK, bounded((FACE_DARK - mean) * 200, 8, FACE_MOST)).when(mean > FACE_BRIGHT, bounded(-(mean - FACE_BRIGHT) * 200, -FACE_MOST, -8)).otherwise(0)).otherwise(0)
    whole = F.when(F.col("exposure").isNotNull(), bounded(-(F.col("exposure") - 50) * 0.7, -30, 30)).otherwise(0)
    return F.when(face != 0, face).otherwise(whole)


def straighten() -> Column:
    tilt = F.col("horizon_tilt")
    ask = (F.coalesce("face_count", F.lit(0)) == 0) & (F.abs(tilt) > TILT)
    return F.when(ask, bounded(-tilt, -TURN_MOST, TURN_MOST)).otherwise(0)


def saturation() -> Column:
    return F.when(F.col("color_harmony") < CLASHING, F.lit(FADE)).otherwise(vibrance())


def crop(boxes: str = "boxes") -> Column:
    """Struct x, y, width, height (shares) that puts the largest face on the nearest point of thirds, arms, head and body inside; null where none is needed."""
    by_size = F.transform(boxes, lambda b, i: F.struct((b[2] * b[3]).alias("size"), i.alias("i"), b.alias("b")))  # of equal ones the last
    face = F.array_max(by_size)["b"]
    x, y, w, h = (face[i] for i in range(4))
    cx, cy = x + w / 2, y + h / 2
    thirds = F.array(*[F.struct(F.sqrt(F.pow(cx - px, F.lit(2.0)) + F.pow(cy - py, F.lit(2.0))).alias("d"), F.lit(k).alias("k"), F.lit(px).alias("x"), F.lit(py).alias("y")) for k, (px, py) in enumerate((i / 3, j / 3) for j in (1, 2) for i in (1, 2))])
    point = F.array_min(thirds)
    left, right = clamp(x - w * ARMS, 0, 1), clamp(x + w + w * ARMS, 0, 1)
    top, bottom = clamp(y - h * HEAD, 0, 1), F.when(h < SMALL_FACE, F.lit(1.0)).otherwise(clamp(y + h + h * BODY, 0, 1))
    size = F.least(F.lit(1.0), F.greatest(F.lit(CROP), right - left, bottom - top))

    def along(centre: Column, third: Column, low: Column, high: Column) -> Column:
        at = F.least(F.greatest(F.lit(0.0), centre - third * size), 1 - size)
        at = F.least(at, low)
        at = F.when(at + size < high, high - size).otherwise(at)
        return F.greatest(F.lit(0.0), F.least(1 - size, at))

    ask = (F.coalesce("face_count", F.lit(0)) > 0) & (F.coalesce("thirds", F.lit(0.5)) < CENTRED) & (F.size(boxes) > 0) & (size < CROP_LITTLE)
    return F.when(ask, F.struct(along(cx, point["x"], left, right).alias("x"), along(cy, point["y"], top, bottom).alias("y"), size.alias("width"), size.alias("height")))


def adjustments(boxes: str = "boxes") -> list[Column]:
    """All twelve, over a view with tones, exposure, clipping, face_count, thirds, horizon_tilt, color_harmony, golden_hour and boxes."""
    (warm, tint), (white, black), (lights, darks) = balance(), levels(), recovery()
    named = {"exposure": exposure(), "contrast": contrast(), "saturation": saturation(), "temperature": warm, "tint": tint, "highlights": lights, "shadows": darks, "whites": white, "blacks": black, "rotation": straighten()}
    return [*[c.cast("long").alias(k) for k, c in named.items()], crop(boxes).alias("crop")]
