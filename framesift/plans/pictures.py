"""Queries over frames: kernels, smaller versions, colours, edits and automatic adjustments, on pictures made from the events."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import autoedit as U
from ..operators import edits as E
from ..operators import faces as X
from ..operators import pixels as K
from ..operators.similarity import spread
from ..sources.bindings import photos
from .gallery import FACES
from .library import query

#: Size of a picture, and pictures that are made at once.
WIDTH, HEIGHT, PICTURES = 24, 16, 256


def picture(ids: np.ndarray, users: np.ndarray) -> np.ndarray:
    """(n, HEIGHT * WIDTH * 3) bytes: patterns, dark ones, bright ones, and nearly grey ones."""
    i = np.arange(WIDTH * HEIGHT * 3)[None, :]
    k, u = (ids % 17 + 1)[:, None], users[:, None]
    noise = i * k + u
    kinds = [noise % 256, noise % 60, 190 + noise % 66, 100 + (i // 3 * k + u) % 50 + i % 3 * (ids % 5)[:, None]]
    return np.choose((ids % 4)[:, None], kinds).astype(np.uint8)


def pixels_of(id: str, user: str):
    def run(ids: pd.Series, users: pd.Series) -> pd.Series:
        some = lambda i: picture(ids.to_numpy()[i : i + PICTURES], users.to_numpy()[i : i + PICTURES])
        return pd.Series([row.tobytes() for i in range(0, len(ids), PICTURES) for row in some(i)])

    return F.pandas_udf(run, "binary")(id, user)


def pictures(s, d, *columns):
    """A frame of 24 x 16 pixels for every photo, with columns of the view."""
    p = spread(photos(s, d)).withColumn("faces", F.expr(FACES))
    return p.select("id", F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), pixels_of("id", "user_id").alias("pixels"), *columns)


@query("frame_measures")
def frame_measures(s, d):
    """Kernels on every frame."""
    names = ["dhash", "sharpness", "exposure", "highlight_clipping", "leading_lines", "symmetry", "negative_space", "light_quality"]
    return K.measure(pictures(s, d), *names).select("id", *[f"measures.{n}" for n in names])


COUNTS = """+ f as (select id, id % 17 + 1 as k, user_id as u, id % 4 as kind, id % 5 as tilt from photos),
x as (select id, kind, unnest(range(0, 384, 4)) * 3 as i, k, u, tilt from f),
c as (select id, j, case kind when 0 then ((i + j) * k + u) % 256 when 1 then ((i + j) * k + u) % 60 when 2 then 190 + ((i + j) * k + u) % 66 else 100 + (i // 3 * k + u) % 50 + j * tilt end as v, i from x, (values (0), (1), (2)) as w(j)),
px as (select id, i, max(v) filter (j = 0) as r, max(v) filter (j = 1) as g, max(v) filter (j = 2) as b from c group by 1, 2),
"""


@query("frame_histograms", COUNTS + "h as (select id, count(*) filter (r <= 2 and g <= 2 and b <= 2) / count(*) as shadows, count(*) filter (r >= 253 or g >= 253 or b >= 253) / count(*) as highlights from px group by 1), n as (select id, max(n) as peak from (select id, v // 4 as bucket, j, count(*) as n from c group by 1, 2, 3) group by 1), l as (select id, count(*) as lit from px where (299 * r + 587 * g + 114 * b) // 4000 >= 32 group by 1) select h.id, n.peak::int as peak, h.shadows, h.highlights, coalesce(l.lit, 0)::int as lit from h join n using (id) left join l using (id)")
def frame_histograms(s, d):
    """The highest bucket, clipped shares, and how many of the samples are in the brighter half."""
    h = K.measure(pictures(s, d), "histogram").select("id", "measures.histogram.*")
    return h.select("id", "peak", "shadows", "highlights", F.aggregate(F.slice("luma", 33, 32), F.lit(0), lambda a, x: a + x).alias("lit"))


@query("frame_pyramids")
def frame_pyramids(s, d):
    """Smaller versions of every frame, by area, with their digests."""
    p = K.pyramid(pictures(s, d), thumb=10, tiny=5).select("id", "dhash", F.explode("levels").alias("l"))
    return p.select("id", "dhash", "l.name", "l.width", "l.height", F.round("l.scale", 9).alias("scale"), F.sha2("l.pixels", 256).alias("digest"))


@query("frame_colours")
def frame_colours(s, d):
    """Harmony, dominant colours and golden hours, and how natural the skin of the faces looks."""
    p = K.measure(K.skin_tones(pictures(s, d, F.transform("faces", lambda f: f["box"]).alias("boxes"))), "colours")
    return p.select("id", "measures.colours.harmony", F.array_join("measures.colours.dominant", ",").alias("dominant"), "measures.colours.golden_hour", F.round("skin_ratio", 9).alias("skin_ratio"))


SCORED = "+ m as (select *, id % 3 = 0 as lines, id % 5 < 2 as sym, (id % 11) / 10.0::double as bare, case when id % 6 = 0 then null else id % 40 end as youngest, coalesce(thirds, 0.5) as t, (id % 8) / 7.0::double as head from photos) select id, floor(greatest(0::double, least(1::double, case when face_count > 0 then 0.6::double * t + 0.4::double * head else 0.4::double * lines::int + 0.3::double * sym::int + 0.3::double * greatest(0::double, 1 - abs(bare - 0.3::double) / 0.7::double) end)) * 100 + 0.5) / 100 as composition, case when face_count = 0 then scene_type when scene_type = 'portrait' and youngest < 13 then 'child_portrait' when scene_type = 'group' and youngest < 13 then 'family_group' else scene_type end as meaning from m"


@query("composition_scores", SCORED)
def composition_scores(s, d):
    p, n = photos(s, d, "id", "face_count", "thirds", "scene_type"), F.col("id")
    score = X.composition_score(F.col("face_count") > 0, F.coalesce("thirds", F.lit(0.5)), (n % 8) / F.lit(7.0), n % 3 == 0, n % 5 < 2, (n % 11) / F.lit(10.0))
    return p.select("id", score.alias("composition"), X.scene_meaning(F.col("scene_type"), F.col("face_count"), F.when(n % 6 != 0, n % 40)).alias("meaning"))


def edits_of():
    """Sliders, bands, curves, points and crops that differ from photo to photo; a tenth have none."""
    n = F.col("id")
    slider = lambda k, m: ((n * k) % m - m // 2).cast("double")
    some = lambda c, x: F.when(c, x)
    sliders = F.create_map(*[x for name, k, m in (("exposure", 7, 61), ("contrast", 11, 61), ("saturation", 13, 81), ("temperature", 17, 101), ("tint", 19, 61), ("highlights", 23, 121), ("shadows", 29, 121), ("whites", 31, 61), ("blacks", 37, 61), ("clarity", 41, 121), ("vignette", 43, 121)) for x in (F.lit(name), slider(k, m))], F.lit("noise"), ((n * 3) % 101).cast("double"), F.lit("sharpen"), ((n * 5) % 101).cast("double"), F.lit("rotation"), F.when(n % 3 == 0, (n % 9 - 4).cast("double")).otherwise(0.0))
    band = lambda k: F.struct(slider(k, 151).alias("hue"), slider(k + 4, 151).alias("saturation"), slider(k + 8, 151).alias("luminance"))
    at = lambda k: ((n * k) % 97 / F.lit(97.0))
    point = F.struct(at(5).alias("x"), at(7).alias("y"), F.lit(0.4).alias("radius"), slider(3, 141).alias("brightness"), slider(9, 141).alias("contrast"), slider(15, 141).alias("saturation"), slider(21, 141).alias("structure"))
    curve = F.array(*[F.struct(F.lit(x).alias("x"), y.alias("y")) for x, y in ((0.0, F.lit(0.0)), (128.0, 100.0 + n % 60), (255.0, F.lit(255.0)))])
    return {
        "edits": some(n % 10 != 0, sliders), "bands": some(n % 4 == 1, F.create_map(F.lit("red"), band(3), F.lit("blue"), band(5))), "curves": some(n % 5 == 1, F.create_map(F.lit("all"), curve, F.lit("g"), curve)),
        "points": some(n % 4 == 2, F.array(point)), "crop": some(n % 7 == 1, F.struct(F.lit(0.1).alias("x"), F.lit(0.2).alias("y"), F.lit(0.7).alias("width"), F.lit(0.6).alias("height"))),
    }


@query("edited_frames")
def edited_frames(s, d):
    """All kinds of edits, as digests of what they leave."""
    p = pictures(s, d)
    return E.edited(p.select("*", *[c.alias(k) for k, c in edits_of().items()])).select("id", F.sha2("pixels", 256).alias("digest"))


def strokes():
    """One or two strokes of some points."""
    n = F.col("id")
    at = lambda k: F.struct(((n * k) % 23 / F.lit(23.0)).alias("x"), ((n * (k + 2)) % 19 / F.lit(19.0)).alias("y"))
    one = F.struct(F.array(at(3), at(4)).alias("points"), F.lit(0.06).alias("radius"))
    two = F.struct(F.array(at(7)).alias("points"), (F.lit(0.04) + n % 3 * 0.02).alias("radius"))
    return F.when(n % 6 == 0, F.array().cast("array<struct<points:array<struct<x:double,y:double>>,radius:double>>")).when(n % 2 == 0, F.array(one)).otherwise(F.array(two, one))


@query("healed_frames")
def healed_frames(s, d):
    """Spots taken out of every frame."""
    return E.edited(pictures(s, d).withColumn("heal", strokes())).select("id", F.sha2("pixels", 256).alias("digest"))


AUTO = COUNTS.replace("v, i from x", "v, i from x") + f"""q as (select *, 0.299::double * r + 0.587::double * g + 0.114::double * b as y, greatest(r, g, b) as top, least(r, g, b) as low from px),
w as (select *, floor(y + 0.5)::int as lv, case when top > 0 then (top - low) / top else 0 end as sat from q),
o as (select *, row_number() over (partition by id order by lv) as up, row_number() over (partition by id order by lv desc) as down, count(*) over (partition by id) as n from w),
t as (select id, any_value(n) as n, min(lv) filter (up >= 0.01::double * n) as p1, min(lv) filter (up >= 0.02::double * n) as p2, min(lv) filter (up >= 0.10::double * n) as p10, min(lv) filter (up >= 0.90::double * n) as p90, max(lv) filter (down >= 0.02::double * n) as p98, min(lv) filter (up >= 0.99::double * n) as p99,
  count(*) filter (y between 55 and 245 and top > 0 and sat <= 0.28::double) as nn, sum(r) filter (y between 55 and 245 and top > 0 and sat <= 0.28::double) as nr, sum(g) filter (y between 55 and 245 and top > 0 and sat <= 0.28::double) as ng, sum(b) filter (y between 55 and 245 and top > 0 and sat <= 0.28::double) as nb,
  count(*) filter (top > 0 and y between 30 and 235) as cn, sum(sat) filter (top > 0 and y between 30 and 235) as cs from o group by 1),
v as (select t.*, p.exposure as es, p.highlight_clipping as hc, p.shadow_clipping as sc, p.face_count as fc, p.horizon_tilt as tilt, (p.id * 7 % 100) / 100.0::double as harmony, p.id % 6 = 1 as golden, nr / nn as mr, ng / nn as mg, nb / nn as mb, cs / cn as ms, pow(p99 / 255, 3) as wu, pow(1 - p1 / 255, 3) as wd from t join photos p using (id)),
z as (select *, case when nn > 0 and nn / n >= 0.02::double then floor(greatest(-30, least(30, -(mr - mb) * 1.25::double * case when golden then 0.35::double else 1 end)) + 0.5)::bigint else 0 end as temperature,
  case when nn > 0 and nn / n >= 0.02::double then floor(greatest(-30, least(30, -(mg - (mr + mb) / 2) * (5 / 3::double) * case when golden then 0.35::double else 1 end)) + 0.5)::bigint else 0 end as tint,
  case when coalesce(hc, 0) > 0.06 then floor(greatest(-40, least(-8, -(hc * 300))) + 0.5)::bigint else 0 end as ch, case when coalesce(sc, 0) > 0.06 then floor(greatest(8, least(40, sc * 300)) + 0.5)::bigint else 0 end as cl,
  case when p90 > 226 then -floor(greatest(0, least(34, (p90 - 226) / 29::double * 34)) + 0.5)::bigint else 0 end as rh, case when p10 < 34 then floor(greatest(0, least(34, (34 - p10) / 34::double * 34)) + 0.5)::bigint else 0 end as rl,
  case when cn > 0 and ms >= 0.04::double and ms < 0.16::double then floor(greatest(0, least(16, (0.16::double - ms) / (0.16::double - 0.04::double) * 16)) + 0.5)::bigint else 0 end as vib from v)
select id, case when es is not null then floor(greatest(-30, least(30, -(es - 50) * 0.7::double)) + 0.5)::bigint else 0 end as exposure, case when p98 - p2 > 0 then floor(greatest(0, least(35, (greatest(1, least(1.6::double, 200 / (p98 - p2)::double)) - 1) * 100)) + 0.5)::bigint else 0 end as contrast,
  case when harmony < 0.35::double then -12 else vib end as saturation, temperature, tint, case when abs(ch) >= abs(rh) then ch else rh end as highlights, case when abs(cl) >= abs(rl) then cl else rl end as shadows,
  case when p99 < 236 and wu > 0.03::double then floor(greatest(0, least(35, (248 - p99) / wu / 55 * 100 * 0.7::double)) + 0.5)::bigint else 0 end as whites, case when p1 > 16 and wd > 0.03::double then floor(greatest(-35, least(0, (6 - p1) / wd / 55 * 100 * 0.7::double)) + 0.5)::bigint else 0 end as blacks,
  case when fc = 0 and abs(tilt) > 2 then floor(greatest(-8, least(8, -tilt)) + 0.5)::bigint else 0 end as rotation from z where fc = 0"""


def asked(s, d):
    n = F.col("id")
    view = ["exposure", "highlight_clipping", "shadow_clipping", "face_count", "thirds", "horizon_tilt"]
    return pictures(s, d, *view, F.transform("faces", lambda f: f["box"]).alias("boxes"), ((n * 7) % 100 / F.lit(100.0)).alias("color_harmony"), (n % 6 == 1).alias("golden_hour"))


@query("auto_adjustments", AUTO)
def auto_adjustments(s, d):
    """Automatic adjustments of frames without faces (``auto_face_adjustments`` has the others)."""
    a = U.tones(asked(s, d)).filter("face_count = 0")
    return a.select("id", *U.adjustments()).drop("crop")


@query("auto_face_adjustments")
def auto_face_adjustments(s, d):
    """Automatic exposure and crops of frames with faces."""
    a = U.tones(asked(s, d)).filter("face_count > 0").select("id", *U.adjustments())
    r = lambda c: F.round(F.col(f"crop.{c}"), 9).alias(f"crop_{c}")
    return a.select("id", "exposure", "saturation", "rotation", *[r(c) for c in ("x", "y", "width", "height")])
