"""Operators over series and moments: best frame, rescues, inversions, stacks, bands."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import blank_to_null, clamp, clamp01, round_half_up
from .joins import dimension
from .ranks import carried, down, ranked, ranked_within
from .similarity import checkpointed
from .filters import eyes_open, inbox_category, is_decided, subject_rank

GAP_MS = 15 * 60 * 1000


def series(photos: DataFrame) -> DataFrame:
    return photos.filter(blank_to_null("group_id").isNotNull())


def best_of(photos: DataFrame, key: list[str] | str, order: list[Column], name: str = "keep_id") -> DataFrame:
    """One aggregate for the first row of each key: a minimum over a struct, combined before the shuffle."""
    keys = [key] if isinstance(key, str) else key
    return photos.groupBy(*keys).agg(F.min_by("id", F.struct(*order)).alias(name), F.count(F.lit(1)).alias("n"))


def resolve_groups(photos: DataFrame) -> DataFrame:
    """group_id, keep_id, n_reject: the best score of the selected, else of all; ties to the first."""
    p = series(photos)
    order = [(F.col("status") != "selected").cast("int"), -F.col("ai_score"), F.col("id")]
    return best_of(p, "group_id", order).join(p.groupBy("group_id").agg(F.count_if(~is_decided()).alias("_open")), "group_id").join(p.select(F.col("id").alias("keep_id"), is_decided().alias("_kept_decided")), "keep_id").select("group_id", "keep_id", (F.col("_open") - (~F.col("_kept_decided")).cast("int")).alias("n_reject"))


def resolve_with_confidence(photos: DataFrame, gap: int = 10, faces: int = 3) -> DataFrame:
    """resolve_groups and whether the two best scores differ enough and few faces are in the frames."""
    r = series(photos).withColumn("_r", F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("ai_score"), "id")))
    c = r.groupBy("group_id").agg(F.max("face_count").alias("_faces"), F.sort_array(F.collect_list(F.when(F.col("_r") <= 2, F.col("ai_score"))), asc=False).alias("_two"))
    ok = ((F.size("_two") < 2) | (F.element_at("_two", 1) - F.try_element_at("_two", F.lit(2)) >= gap)) & (F.col("_faces") <= faces)
    return resolve_groups(photos).join(c.select("group_id", F.coalesce(ok, F.lit(False)).alias("confident")), "group_id")


def eyes_ratio() -> Column:
    """Share of faces with open eyes, of one face or of a group."""
    one = F.col("all_eyes_open").cast("double")
    return F.when(F.col("face_count") > 1, F.coalesce("group_eyes_open", one)).otherwise(one)


def smile_ratio() -> Column:
    return F.when(F.col("face_count") > 1, F.coalesce("group_smile", "best_smile")).otherwise(F.col("best_smile"))


def frame_score(learned_weight: float = 0.0) -> Column:
    """Weighted quality of a frame, blended with the learned score; not finite is 0."""
    faces = F.when(F.col("face_count") > 0, F.greatest(F.lit(0.0), 0.5 * smile_ratio() + 0.5 * eyes_ratio() - F.coalesce("group_awkward", F.lit(0.0)))).otherwise(F.lit(0.5))
    clarity = F.col("sharpness") / 100 * F.when(F.coalesce(~F.col("subject_in_focus"), F.lit(False)), F.lit(0.6)).otherwise(F.lit(1.0))
    light = 1 - F.abs(F.col("exposure") - 50) / 50
    whole = 1 - clamp(F.coalesce("highlight_clipping", F.lit(0.0)), 0.0, 1.0)
    fixed = 0.35 * clarity + 0.18 * light + 0.07 * whole + 0.18 * F.coalesce("composition_score", F.lit(0.5)) + 0.15 * faces + 0.07 * F.coalesce("avg_eye_contact", F.lit(0.5))
    w = min(1.0, max(0.0, learned_weight))
    s = fixed if w == 0 else (1 - w) * fixed + w * clamp("ai_score", 0, 100) / 100
    return F.when(F.isnan(s), F.lit(0.0)).otherwise(s)


def best_frames(photos: DataFrame, learned_weight: float = 0.0, least: int = 2) -> DataFrame:
    """group_id, keep_id, n of series with at least two frames. Scores are compared to nine digits, ties go to the first."""
    p = series(photos).withColumn("_s", F.round(frame_score(learned_weight), 9))
    return best_of(p, "group_id", [-F.col("_s"), F.col("id")]).filter(F.col("n") >= least)


def highlights(photos: DataFrame, percent: float = 10) -> DataFrame:
    """The best of every series and all single photos, by significance; as many as the percentage of all photos."""
    p = photos.withColumn("_rank", subject_rank())
    best = best_of(series(p), "group_id", [-F.col("ai_score"), F.col("id")]).select(F.col("keep_id").alias("id"))
    pool = p.filter(blank_to_null("group_id").isNull()).unionByName(p.join(best, "id", "left_semi"))
    n = photos.count()
    return ranked(pool, [down("_rank"), down("ai_score"), "id"]).filter(F.col("place") <= max(1, int(n * percent / 100 + 0.5))).select("id", "ai_score")


def unresolved(photos: DataFrame) -> DataFrame:
    return series(photos).groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") != "rejected").alias("live")).filter("n > 1 and live > 1")


def inversions(photos: DataFrame, gap: int = 15) -> DataFrame:
    """Rejected frames that score at least ``gap`` above the best selected one of their series."""
    kept = series(photos).filter("status = 'selected'").groupBy("group_id").agg(F.max("ai_score").alias("best_kept"))
    return series(photos).filter("status = 'rejected'").join(kept, "group_id").withColumn("gap", F.col("ai_score") - F.col("best_kept")).filter(F.col("gap") >= gap).select("id", "group_id", "gap")


def blinks(photos: DataFrame) -> DataFrame:
    """Closed eyes that no frame of the series with as many faces makes up for."""
    clean = series(photos).filter("face_count > 0 and all_eyes_open").select("group_id", "face_count").distinct()
    return photos.filter("face_count > 0 and not all_eyes_open").join(clean, ["group_id", "face_count"], "left_anti")


def blurry(photos: DataFrame) -> DataFrame:
    sharp = series(photos).filter("sharpness >= 60").select("group_id").distinct()
    return photos.filter((F.col("sharpness") < 45) & ~F.coalesce("subject_in_focus", F.lit(False))).join(sharp, "group_id", "left_anti")


def rescue_best(photos: DataFrame, best: DataFrame) -> DataFrame:
    """keep_id of series whose frames are all rejected (best: group_id, keep_id)."""
    lost = series(photos).groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("status") == "rejected").alias("lost")).filter("n >= 2 and lost")
    return best.join(lost.select("group_id"), "group_id").select("group_id", "keep_id")


def after_grouping(photos: DataFrame, best: DataFrame) -> DataFrame:
    """id and status once series are known: a selected frame that is not the best goes to review, and so does the best of a rejected series."""
    lost = rescue_best(photos, best).select(F.col("keep_id").alias("id"), F.lit(True).alias("_rescued"))
    b = best.select("group_id", "keep_id")
    p = photos.join(b, "group_id", "left").join(lost, "id", "left")
    other = (F.col("status") == "selected") & F.col("keep_id").isNotNull() & (F.col("keep_id") != F.col("id"))
    return p.select("id", F.when(other | F.coalesce("_rescued", F.lit(False)), "review").otherwise(F.col("status")).alias("status"))


def stacks(photos: DataFrame, gap_ms: int = GAP_MS, least: int = 4, by: str | None = None) -> DataFrame:
    """id, moment: runs in time with no gap above ``gap_ms``, of at least ``least`` frames. moment is the first frame's id.

    Frames of one bucket of time as wide as the gap are of one run, so runs are
    found on a row for each bucket (``runs_of_buckets``); frames themselves are
    neither sorted nor held, and look up their bucket's run."""
    p = photos.filter("captured_at is not null").withColumn("_b", F.expr(f"(captured_at - pmod(captured_at, {gap_ms + 1})) div {gap_ms + 1}"))
    keys = [by] if by else []
    runs = runs_of_buckets(p, gap_ms, keys).filter(F.col("_n") >= least).select("moment", F.col("_b").alias("_of"), *[F.col(c).alias("_key") for c in keys])
    same = F.col("_b") == F.col("_of")
    return p.join(dimension(runs), same & F.col(by).eqNullSafe(F.col("_key")) if by else same).drop("_b", "_of", "_key")


def runs_of_buckets(p: DataFrame, gap_ms: int, keys: list[str]) -> DataFrame:
    """_b, moment, _n (and the key): for each bucket of time the first frame of its run, and how many frames the run has. Buckets are taken in days, with what the days before end in."""
    ends = p.groupBy(*keys, "_b").agg(F.min("captured_at").alias("_lo"), F.max("captured_at").alias("_hi"), F.min(F.struct("captured_at", "id")).alias("_first"), F.count(F.lit(1)).alias("_c"))
    ends = checkpointed(ends.withColumn("_first", F.col("_first.id")).withColumn("_day", F.expr("_lo div 86400000")))
    days = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_day")
    before = lambda c: F.last(c, ignorenulls=True).over(days.rowsBetween(Window.unboundedPreceding, -1))
    within = Window.partitionBy(*keys, "_day").orderBy("_lo")
    named = [F.col(c).alias(f"_k_{c}") for c in keys]
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys] + [F.col("_day") == F.col("_d")]

    def carried_over(rows: DataFrame, last: Column, name: str) -> DataFrame:
        """Add what the days before a row's day end in."""
        per_day = rows.groupBy(*keys, "_day").agg(last.alias("_last")).select(*named, F.col("_day").alias("_d"), "_last", *keys, "_day")
        ended = per_day.select(*named, "_d", before("_last").alias(name))
        return rows.join(ended, same).drop("_d", *[f"_k_{c}" for c in keys])

    r = carried_over(ends, F.max("_hi"), "_before")
    prev = F.coalesce(F.lag("_hi").over(within), F.col("_before"))
    r = r.withColumn("_start", F.when(prev.isNull() | (F.col("_lo") - prev > gap_ms), F.struct("_lo", "_first"))).drop("_before")
    r = carried_over(r, F.max("_start"), "_carry")
    since = F.last("_start", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0))
    r = checkpointed(r.select(*keys, "_b", "_c", F.coalesce(since, F.col("_carry"))["_first"].alias("moment")))
    size = r.groupBy("moment").agg(F.sum("_c").alias("_n"))
    return r.drop("_c").join(dimension(size), "moment")


def moments(photos: DataFrame, gap_ms: int = GAP_MS, least: int = 4) -> DataFrame:
    return stacks(photos, gap_ms, least).groupBy("moment").agg(F.count(F.lit(1)).alias("n"), F.min("captured_at").alias("start_ms"), F.max("captured_at").alias("end_ms"), F.count_if(F.col("status").isin("pending", "review")).alias("undecided"))


def top_picks(photos: DataFrame, gap_ms: int = GAP_MS, least: int = 4, k: int = 3) -> DataFrame:
    """The k best frames of a moment, one of each series: people before others, documents (as the inbox tells them) last; whoever is known doesn't count."""
    one = F.when(blank_to_null("group_id").isNotNull(), F.col("group_id")).otherwise(F.concat(F.lit("solo:"), F.col("id").cast("string")))
    rank = F.when(inbox_category() == "document", 0).when(F.coalesce("face_count", F.lit(0)) > 0, 2).otherwise(1)
    s = stacks(photos.select("id", "captured_at", "ai_score", rank.alias("_rank"), one.alias("_series")), gap_ms, least)
    best = s.groupBy("moment", "_series").agg(F.min(F.struct((-F.col("_rank")).alias("a"), (-F.col("ai_score")).alias("b"), "id")).alias("o"))
    return best.withColumn("place", F.row_number().over(Window.partitionBy("moment").orderBy("o"))).filter(F.col("place") <= k).select("moment", F.col("o.id").alias("id"), "place")


def band(difficulty: Column) -> Column:
    return F.when(difficulty < 0.35, "easy").when(difficulty < 0.7, "compare").otherwise("hard")


def review_bands(queue: DataFrame, difficulty: Column, order: list[Column], key: str) -> DataFrame:
    """Runs of one band along a queue, for each key: start, count. A key may hold most rows: neighbours meet by joins on their places."""
    q = ranked_within(queue.withColumn("band", band(difficulty)), key, order, "_at").select(key, "band", (F.col("_at") - 1).alias("_at"))
    before = q.select(F.col(key).alias("_k"), (F.col("_at") + 1).alias("_next"), F.col("band").alias("_was"))
    runs = q.join(before, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_at") == F.col("_next")), "left").filter("_was is null or _was <> band").select(key, "band", "_at")
    runs = checkpointed(ranked_within(runs, key, ["_at"], "_run"))
    after = runs.select(F.col(key).alias("_k"), (F.col("_run") - 1).alias("_before"), F.col("_at").alias("_end"))
    whole = q.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_all"))
    j = runs.join(after, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_run") == F.col("_before")), "left").join(whole, F.col(key).eqNullSafe(F.col("_key")))
    return j.select(key, "band", F.col("_at").alias("start_index"), (F.coalesce("_end", "_all") - F.col("_at")).alias("n"))


def row_plan(queue: DataFrame, difficulty: Column, order: list[Column], key: str, columns: int) -> DataFrame:
    """Rows of so many columns along a queue, begun anew where a band of two photos or more begins (where there are two bands at least).

    Adds row_start (the place in the queue of the row's first photo, from 0),
    cell, and heading (the band that the row begins, else null)."""
    k = max(1, columns)
    q = checkpointed(ranked_within(queue.withColumn("_band", band(difficulty)), key, order, "_at").withColumn("_at", F.col("_at") - 1))
    runs = checkpointed(review_bands(queue, difficulty, order, key))
    several = runs.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_bands")).filter("_bands > 1")
    starts = runs.filter("n > 1").join(several, F.col(key).eqNullSafe(F.col("_key")), "left_semi").select(F.col(key).alias("_k"), F.col("start_index").alias("_start"))
    r = q.join(starts, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_at") == F.col("_start")), "left").drop("_k")
    r = carried(r, key, "_at", F.coalesce("_start", F.lit(0)), "_from")
    first = F.col("_from") + F.floor((F.col("_at") - F.col("_from")) / k) * k
    r = r.withColumn("row_start", first).withColumn("cell", F.col("_at") - F.col("row_start"))
    heads = starts.select(F.col("_k").alias("_hk"), F.col("_start").alias("_head"))
    r = r.join(heads, F.col(key).eqNullSafe(F.col("_hk")) & (F.col("row_start") == F.col("_head")), "left")
    return r.withColumn("heading", F.when(F.col("_head").isNotNull() & (F.col("cell") == 0), F.col("_band"))).drop("_at", "_band", "_start", "_from", "_hk", "_head")


def series_percentile(photos: DataFrame) -> DataFrame:
    """Percentile of the score in its series, ties in the middle; null for a single frame."""
    w = Window.partitionBy("group_id")
    n, worse, equal = F.count(F.lit(1)).over(w), F.rank().over(w.orderBy("ai_score")) - 1, F.count(F.lit(1)).over(Window.partitionBy("group_id", "ai_score"))
    p = series(photos).select("id", "group_id", n.alias("n"), worse.alias("worse"), equal.alias("equal"))
    return p.select("id", F.when(F.col("n") >= 2, round_half_up(clamp01((F.col("worse") + (F.col("equal") - 1) / 2) / (F.col("n") - 1)) * 100)).alias("series"))


def compare_in_series(photos: DataFrame, margin: int = 12) -> DataFrame:
    """id, verdict, frames: only eyes open, sharpest, or softer than another frame of the series.

    The best of the others is the group's best, or its second best for the best one: two values a group, no self join."""
    p = series(photos)
    g = p.groupBy("group_id").agg(F.count(F.lit(1)).alias("frames"), F.max("sharpness").alias("_top"), F.count_if(eyes_open() >= 1).alias("_open"))
    second = p.join(g.select("group_id", "_top"), "group_id").groupBy("group_id").agg(F.count_if(F.col("sharpness") == F.col("_top")).alias("_ties"), F.max(F.when(F.col("sharpness") < F.col("_top"), F.col("sharpness"))).alias("_next"))
    other = F.when((F.col("sharpness") == F.col("_top")) & (F.col("_ties") == 1), F.col("_next")).otherwise(F.col("_top"))
    q = p.join(g, "group_id").join(second, "group_id").filter("frames > 1").withColumn("_o", other)
    v = F.when((F.col("face_count") > 0) & (eyes_open() == 1) & (F.col("_open") == 1), "onlyEyesOpen").when(F.col("sharpness") >= F.col("_o") + margin, "sharpest").when(F.col("_o") >= F.col("sharpness") + margin, "softerThanSibling")
    return q.select("id", v.alias("verdict"), "frames").filter("verdict is not null")


def pillars() -> tuple[Column, Column]:
    """Technical and delivery scores."""
    from .filters import effective_sharpness

    s = clamp01(effective_sharpness() / 100)
    hi, lo = F.coalesce("highlight_clipping", F.lit(0.0)), F.coalesce("shadow_clipping", F.lit(0.0))
    eyes, faces = clamp01(eyes_open()), F.col("face_count") > 0
    light, whole = 1 - clamp01(F.abs(F.col("exposure") - 50) / 30), 1 - clamp01((hi + lo) / 0.2)
    base = s * 0.4 + light * 0.25 + whole * 0.2
    technical = F.when(faces, base + eyes * 0.15).otherwise(base / 0.85)
    penalty = (1 - s) * 45 + F.when(F.coalesce(~F.col("subject_in_focus"), F.lit(False)), 25.0).otherwise(0.0) + F.when(faces, (1 - eyes) * 25).otherwise(0.0) + clamp01(hi / 0.2) * 20
    return round_half_up(F.round(technical * 100, 9)), round_half_up(F.round(F.greatest(F.lit(0.0), 100 - penalty), 9))


#: From where a frame is sharp, its faces are framed badly or well, and a face smiles.
SHARP_HIGH, FRAMED_BADLY, FRAMED_WELL, SMILING, ALL_OPEN = 70, 0.35, 0.6, 0.6, 0.999


def summaries() -> tuple[Column, Column, Column]:
    """What there is to say first of a frame's technique, subject and framing, as "group.key"; what is wrong comes before what is right."""
    from .filters import SHARP_LOW, effective_sharpness

    s, off = effective_sharpness(), F.col("exposure") - 50
    clip = lambda c: F.coalesce(c, F.lit(0.0)) > 0.06
    technical = F.when(s < SHARP_LOW, "soft").when(off < -15, "under").when(off > 15, "over").when(clip("highlight_clipping"), "highlights").when(clip("shadow_clipping"), "shadows").when(s >= SHARP_HIGH, "clean").otherwise("fine")
    many = F.col("face_count") > 1
    subject = F.when(eyes_open() < ALL_OPEN, F.when(many, "someBlink").otherwise("blink")).when(smile_ratio() >= SMILING, "smiling").otherwise("eyesOpen")
    half = lambda c: F.coalesce(c, F.lit(0.5))
    faces = F.when(half("headroom") < FRAMED_BADLY, "headroom").when(half("thirds") < FRAMED_BADLY, "centered").when((half("thirds") >= FRAMED_WELL) & (half("headroom") >= FRAMED_WELL), "strong").otherwise("fine")
    yes = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False))
    bare = F.when(yes("symmetry") | yes("leading_lines"), "structure").when(half("negative_space") < FRAMED_BADLY, "crowded").otherwise("fine")
    framing = F.when(F.col("face_count") > 0, faces).otherwise(bare)
    return F.concat(F.lit("technical."), technical), F.concat(F.lit("subject."), subject), F.concat(F.lit("framing."), framing)


def explain_choice(photos: DataFrame, best: DataFrame) -> DataFrame:
    """group_id, reasons (array) and confidence of each kept frame against the best of the others."""
    p = series(photos).join(best.select("group_id", "keep_id"), "group_id")
    mine, other = F.col("id") == F.col("keep_id"), F.col("id") != F.col("keep_id")
    face = F.col("face_count") > 0
    eyes, error = F.when(face, eyes_ratio()), F.abs(F.col("exposure") - 50)
    agg = {}
    for n, c in (("eyes", eyes), ("smile", F.when(face, smile_ratio())), ("sharp", F.col("sharpness")), ("score", F.col("ai_score"))):
        agg[f"k_{n}"], agg[f"o_{n}"] = F.max(F.when(mine, c)), F.max(F.when(other, c))
    agg["k_err"], agg["o_err"] = F.max(F.when(mine, error)), F.min(F.when(other, error))
    g = p.groupBy("group_id", "keep_id").agg(F.count(F.lit(1)).alias("n"), *[v.alias(k) for k, v in agg.items()]).filter("n >= 2")
    reasons = F.array_compact(F.array(
        F.when((F.col("k_eyes") == 1) & (F.col("o_eyes") < 1), F.when(F.col("n") == 2, "eyesOnlyOneOfTwo").otherwise("eyesOnlyOne")).when(F.round(F.col("k_eyes") - F.col("o_eyes"), 9) >= 0.2, "eyesMore"),
        F.when(F.col("k_sharp") - F.col("o_sharp") >= 10, "sharper"), F.when(F.round(F.col("k_smile") - F.col("o_smile"), 9) >= 0.15, "smile"),
        F.when((F.col("k_err") + 8 <= F.col("o_err")) & (F.col("o_err") >= 15), "exposure")))
    gap = F.col("k_score") - F.col("o_score")
    g = g.withColumn("r", reasons)
    said = F.when(F.size("r") > 0, F.array_join("r", ",")).when(gap >= 4, "score").otherwise("tooClose")
    return g.select("group_id", "keep_id", said.alias("reasons"), F.when((F.size("r") > 0) | (gap >= 4), "high").otherwise("low").alias("confidence"))


GAINS = {"exposure": 12, "highlights": 9, "shadows": 9, "straighten": 6, "crop": 5}


def rescue_queue(photos: DataFrame) -> DataFrame:
    """id, fixes, n_fixes, gain of photos that an edit can help; not those selected or too soft."""
    tests = {"exposure": F.abs(F.col("exposure") - 50) >= 18, "highlights": F.coalesce("highlight_clipping", F.lit(0.0)) > 0.06, "shadows": F.coalesce("shadow_clipping", F.lit(0.0)) > 0.06, "straighten": F.abs(F.coalesce("horizon_tilt", F.lit(0.0))) > 2, "crop": (F.col("face_count") > 0) & (F.coalesce("thirds", F.lit(0.5)) < 0.4)}
    fixes = F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]))
    raw = sum((F.when(t, GAINS[k]).otherwise(0) for k, t in tests.items()), F.lit(0))
    q = photos.filter("status <> 'selected' and sharpness >= 45").select("id", fixes.alias("f"), F.least(raw, 100 - F.col("ai_score")).alias("gain"))
    return q.filter("size(f) > 0 and gain > 0").select("id", F.array_join("f", ",").alias("fixes"), F.size("f").alias("n_fixes"), "gain")


def name_parts(name: str | Column) -> tuple[Column, Column]:
    """Base and extension; a dot at the start begins no extension."""
    n = F.col(name) if isinstance(name, str) else name
    ext = F.regexp_extract(n, r"(?s)^.+(\.[^.]*)$", 1)
    return F.substring(n, F.lit(1), F.length(n) - F.length(ext)), ext


def sequence_numbers(photos: DataFrame, folder: str, order: list[Column]) -> DataFrame:
    """Sequence number in a folder, and a file name that no other photo of the folder has: in order, each takes its own name or the first free 'base (n).ext', n from 2.

    Names can only meet others of their family, which end alike and begin alike
    but for numbers in brackets. In a family of one name numbers are places,
    taken by ranges; in one of several names they depend on what was free, so
    such a family is one task's: names stream through, and for each name the
    first number that may be free is held."""
    p = checkpointed(ranked_within(photos, folder, order, "seq"))
    base, ext = name_parts("file_name")
    p = p.withColumn("_ext", ext).withColumn("_root", F.regexp_replace(base, r"( \(\d+\))+$", ""))
    family = [folder, "_root", "_ext"]
    kinds = p.groupBy(*[F.col(c).alias(f"_f{i}") for i, c in enumerate(family)]).agg(F.min("file_name").alias("_least"), F.max("file_name").alias("_most"))
    same = F.lit(True)
    for i, c in enumerate(family):
        same = same & F.col(c).eqNullSafe(F.col(f"_f{i}"))
    p = checkpointed(p.join(kinds, same).withColumn("_one", F.col("_least").eqNullSafe(F.col("_most"))).drop("_f0", "_f1", "_f2", "_least", "_most"))
    one = ranked_within(p.filter("_one").withColumn("_named", F.struct(folder, "file_name")), "_named", [F.col("seq")], "_k")
    base, ext = name_parts("file_name")
    one = one.withColumn("out_name", F.when(F.col("_k") == 1, F.col("file_name")).otherwise(F.concat(base, F.lit(" ("), F.col("_k").cast("string"), F.lit(")"), ext))).drop("_named", "_k")
    many = p.filter("not _one")
    dealt = many.select(*family, "seq", "file_name").repartition(*family).sortWithinPartitions(*family, "seq")
    key = p.schema[folder].dataType.simpleString()
    named = dealt.mapInPandas(_first_free(family), f"_folder {key}, _seq long, out_name string")
    many = many.join(named, F.col(folder).eqNullSafe(F.col("_folder")) & (F.col("seq") == F.col("_seq"))).drop("_folder", "_seq")
    return one.unionByName(many).drop("_ext", "_root", "_one")


def _first_free(family: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, used, after = None, set(), {}
        for pdf in batches:
            out = []
            for *key, seq, name in pdf[[*family, "seq", "file_name"]].itertuples(index=False):
                if key != at:
                    at, used, after = key, set(), {}
                took = name
                if took in used:
                    base, ext = name[: len(name) - len(key[2])], key[2]
                    n = after.get(name, 2)
                    while (took := f"{base} ({n}){ext}") in used:
                        n += 1
                    after[name] = n + 1
                used.add(took)
                out.append((key[0], seq, took))
            yield pd.DataFrame(out, columns=["_folder", "_seq", "out_name"])

    return run
