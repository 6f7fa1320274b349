"""Scoring and the preference learner: features, prediction, replay of decisions."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import round_half_up
from .similarity import spread

#: Weight of each feature before anything is learned.
PRIOR = {
    "sharpness": 0.9, "exposureBalance": 0.5, "bestSmile": 0.7, "allEyesOpen": 0.8, "knownFaceRatio": 0.6, "strangerPenalty": -0.5, "faceScore": 0.4, "faceCount": 0.1,
    "subjectProminence": 0.45, "ruleOfThirds": 0.3, "headroom": 0.25, "groupEyesOpenRatio": 0.5, "groupSmileRatio": 0.4, "groupAwkwardRatio": -0.3, "bodyCroppedAtEdge": -0.3,
    "groupGenuineSmileRatio": 0.25, "groupCatchlightRatio": 0.15, "groupSkinToneNaturalRatio": 0.3, "avgEyeContact": 0.35, "contentAffinity": 0.2, "subjectAffinity": 0.2, "textCoverage": -0.3,
    "noCameraMetadata": -0.5, "avgEngagement": 0.3, "highlightClipping": -0.4, "shadowClipping": -0.3, "horizonLevel": 0.25, "isoPenalty": -0.15, "apertureRaw": 0.0, "shutterSpeedRaw": 0.0,
    "focalLengthRaw": 0.0, "flashFired": 0.0, "deliberateSettings": 0.15, "compositionScore": 0.3, "leadingLines": 0.15, "symmetry": 0.1, "negativeSpace": 0.0, "lightHard": 0.0, "lightSoft": 0.0,
    "goldenHour": 0.2, "subjectInFocus": 0.6, "bokehQuality": 0.2, "colorHarmony": 0.25,
}
#: Mean and standard deviation of each feature in an ordinary library.
ORDINARY = {
    "sharpness": (0.65, 0.18), "exposureBalance": (0.72, 0.18), "exposureRaw": (0.5, 0.2), "highlightClipping": (0.05, 0.08), "shadowClipping": (0.05, 0.08), "isoPenalty": (0.15, 0.15),
    "apertureRaw": (0.5, 0.25), "shutterSpeedRaw": (0.5, 0.25), "focalLengthRaw": (0.25, 0.15), "flashFired": (0.12, 0.33), "deliberateSettings": (0.05, 0.22), "compositionScore": (0.5, 0.2),
    "leadingLines": (0.25, 0.43), "symmetry": (0.25, 0.43), "negativeSpace": (0.3, 0.2), "lightHard": (0.25, 0.43), "lightSoft": (0.25, 0.43), "goldenHour": (0.12, 0.33), "colorHarmony": (0.6, 0.2),
    "bestSmile": (0.4, 0.3), "allEyesOpen": (0.75, 0.43), "faceCount": (0.2, 0.15), "knownFaceRatio": (0.15, 0.3), "strangerPenalty": (0.7, 0.35), "faceScore": (0.7, 0.2), "ruleOfThirds": (0.5, 0.2),
    "headroom": (0.5, 0.2), "groupEyesOpenRatio": (0.75, 0.3), "groupSmileRatio": (0.4, 0.3), "groupAwkwardRatio": (0.15, 0.3), "bodyCroppedAtEdge": (0.1, 0.3), "groupGenuineSmileRatio": (0.25, 0.35),
    "groupCatchlightRatio": (0.4, 0.35), "groupSkinToneNaturalRatio": (0.7, 0.3), "avgEyeContact": (0.5, 0.25), "avgEngagement": (0.5, 0.25), "subjectInFocus": (0.7, 0.46), "bokehQuality": (0.5, 0.3),
    "horizonLevel": (0.7, 0.25), "contentAffinity": (0.5, 0.15), "subjectAffinity": (0.5, 0.15), "textCoverage": (0.08, 0.16), "subjectProminence": (0.25, 0.15), "noCameraMetadata": (0.25, 0.43),
}
#: Features without a direction of taste to tell of: in no summary and no shift.
SILENT = {"exposureBalance", "faceScore", "faceCount", "bodyCroppedAtEdge", "contentAffinity", "subjectAffinity", "textCoverage"}
GLOBAL = "__global__"
#: Learning rate, its factor when the model was wrong, pull towards the prior, and how far weights may go.
RATE, SURPRISE, PULL, REACH, LIMIT = 0.35, 1.6, 0.02, 1.5, 4.0
BLEND, VAR_FLOOR, Z_LIMIT, PRIOR_N = 12, 0.0225, 3.0, 6
COLD, WARM, SHIFT = 8, 40, 0.03
#: A face of this share of the frame makes it a picture of somebody.
PROMINENT = 0.004


def feature_columns(columns: Iterable[str], *, enrolled: bool = True) -> dict[str, Column]:
    """Every feature as an expression over a photo view with ``columns``, null where it is absent.

    A column that the view lacks is one that no photo has: its features take
    the neutral value or are absent, as for a null. Features of faces are
    absent without faces, the horizon with a prominent one, and who is known
    while nobody is ``enrolled``."""
    have = set(columns)
    c = lambda name: F.col(name) if name in have else F.lit(None)
    num = lambda name: c(name).cast("double")
    yes = lambda test: F.when(test, 1.0).otherwise(0.0)
    # of a known value; greatest and least pass over nulls
    unit = lambda known, x: F.when(known.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))
    # true, false or unknown
    maybe = lambda name: F.coalesce(c(name).cast("boolean").cast("double"), F.lit(0.5))
    neutral = lambda name: F.coalesce(num(name), F.lit(0.5))
    area = F.array_max(F.transform("faces", lambda f: f["box"][2] * f["box"][3])) if "faces" in have else F.lit(None).cast("double")
    anyone = F.col("face_count") > 0
    someone = anyone & F.coalesce(area >= PROMINENT, F.lit(True))
    faces = F.coalesce(F.col("faces"), F.array()) if "faces" in have else None
    focal = F.coalesce(num("focal_35mm"), num("focal_mm"), num("focal"))
    taken_with = [c(n) for n in ("camera_make", "camera", "iso", "f_number", "exposure_s", "focal_mm", "focal")]
    light, bokeh = c("light_quality").cast("string"), c("bokeh_quality").cast("string")
    strangers = num("stranger_count") if "stranger_count" in have else F.col("face_count") - num("known_face_count")
    out = {
        "sharpness": F.when(someone, num("sharpness") / 100).otherwise(F.pow(F.greatest(F.lit(0.0), num("sharpness")) / 100, F.lit(0.6))),
        "exposureBalance": 1 - F.abs(num("exposure") - 50) / 50,
        "exposureRaw": num("exposure") / 100,
        "highlightClipping": F.coalesce(num("highlight_clipping"), F.lit(0.0)),
        "shadowClipping": F.coalesce(num("shadow_clipping"), F.lit(0.0)),
        "isoPenalty": F.coalesce(unit(num("iso"), F.log2(F.greatest(num("iso"), F.lit(50.0)) / 100) / 6), F.lit(0.0)),
        "apertureRaw": F.coalesce(unit(num("f_number"), (num("f_number") - 1) / 21), F.lit(0.5)),
        "shutterSpeedRaw": F.when(num("exposure_s") > 0, unit(num("exposure_s"), F.log2(F.greatest(1 / num("exposure_s"), F.lit(1.0))) / 13)).otherwise(0.5),
        "focalLengthRaw": F.coalesce(unit(focal, F.log2(F.greatest(focal, F.lit(10.0)) / 10) / 8), F.lit(0.5)),
        "flashFired": yes(c("flash").cast("boolean")),
        "deliberateSettings": yes((F.abs(num("exposure_bias")) >= 0.3) | (c("white_balance").cast("string") == "manual")),
        "compositionScore": neutral("composition_score"),
        "leadingLines": maybe("leading_lines"),
        "symmetry": maybe("symmetry"),
        "negativeSpace": neutral("negative_space"),
        "lightHard": yes(light == "hard"),
        "lightSoft": yes(light == "soft"),
        "goldenHour": yes(c("golden_hour").cast("boolean")),
        "colorHarmony": neutral("color_harmony"),
        "contentAffinity": num("content_affinity"),
        "subjectAffinity": num("subject_affinity"),
        "textCoverage": num("text_coverage"),
        "noCameraMetadata": yes(F.coalesce(*[x.cast("string") for x in taken_with]).isNull()),
        "subjectProminence": F.when(area > 0, F.least(F.lit(1.0), F.sqrt(area) / 0.5)),
        "bestSmile": num("best_smile"),
        "allEyesOpen": yes(c("all_eyes_open").cast("boolean")),
        "faceCount": F.least(F.col("face_count"), F.lit(6)) / 6,
        "knownFaceRatio": num("known_face_count") / F.col("face_count") if enrolled else F.lit(None),
        "strangerPenalty": strangers / F.col("face_count") if enrolled else F.lit(None),
        "faceScore": F.when(F.size(faces) > 0, F.aggregate(faces, F.lit(0.0), lambda t, f: t + f["face_score"]) / F.size(faces)).otherwise(0.0) if faces is not None else F.lit(0.0),
        "ruleOfThirds": neutral("thirds"),
        "headroom": neutral("headroom"),
        "groupEyesOpenRatio": neutral("group_eyes_open"),
        "groupSmileRatio": neutral("group_smile"),
        "groupAwkwardRatio": neutral("group_awkward"),
        "groupGenuineSmileRatio": neutral("group_genuine_smile"),
        "groupCatchlightRatio": neutral("group_catchlight"),
        "groupSkinToneNaturalRatio": neutral("group_skin_tone_natural"),
        "avgEyeContact": neutral("avg_eye_contact"),
        "avgEngagement": neutral("avg_engagement"),
        "subjectInFocus": maybe("subject_in_focus"),
        "bokehQuality": F.when(bokeh == "good", 1.0).when(bokeh == "poor", 0.0).otherwise(0.5),
        "bodyCroppedAtEdge": maybe("body_cropped_at_edge"),
        "horizonLevel": F.when(~someone & (num("horizon_tilt").isNotNull() | ~anyone), F.coalesce(unit(num("horizon_tilt"), 1 - F.abs(num("horizon_tilt")) / 15), F.lit(0.5))),
    }
    of_faces = list(out)[list(out).index("subjectProminence") : list(out).index("horizonLevel")]
    return {k: (F.when(anyone, v) if k in of_faces else v).cast("double") for k, v in out.items()}


def features(columns: Iterable[str], *, enrolled: bool = True) -> Column:
    """MAP of the features that there are, over a photo view with ``columns``."""
    pairs = [x for k, v in feature_columns(columns, enrolled=enrolled).items() for x in (F.lit(k), v)]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def context_key(genre: str | None = None) -> Column:
    """[genre:]scene[:known|strangers|mixed], the scene as it is stored (scene_type)."""
    faces = F.when(F.col("face_count") == 0, "").when(F.col("stranger_count") == 0, ":known").when(F.col("known_face_count") == 0, ":strangers").otherwise(":mixed")
    named = F.trim(F.coalesce(F.col(genre), F.lit(""))) if genre else F.lit("")
    return F.concat(F.when(named == "", "").otherwise(F.concat(named, F.lit(":"))), F.col("scene_type"), faces)


def seeds() -> dict[str, list[float]]:
    """n, mean and m2 of each feature, as if PRIOR_N ordinary photos had been seen."""
    return {k: [float(PRIOR_N), mean, std * std * (PRIOR_N - 1)] for k, (mean, std) in ORDINARY.items()}


@dataclass
class Model:
    """Weights, bias and running feature statistics (n, mean, m2) of one context."""

    weights: dict[str, float] = field(default_factory=lambda: dict(PRIOR))
    bias: float = 0.0
    stats: dict[str, list[float]] = field(default_factory=seeds)
    n: int = 0

    def repaired(self) -> Model:
        """What isn't finite starts anew."""
        whole = all(v is not None and math.isfinite(v) for v in self.weights.values())
        return Model(self.weights if whole else dict(PRIOR), self.bias if math.isfinite(self.bias) else 0.0, self.stats or seeds(), max(0, self.n))

    def observe(self, x: dict[str, float]) -> None:
        for k, v in x.items():
            if math.isfinite(v):
                n, mean, m2 = self.stats.get(k, (0.0, 0.0, 0.0))
                moved = mean + (v - mean) / (n + 1)
                self.stats[k] = [n + 1, moved, m2 + (v - mean) * (v - moved)]

    def z(self, x: dict[str, float]) -> dict[str, float]:
        """Distances from the mean in deviations of 0.15 at least; plain values until three photos are known."""
        out = {}
        for k, v in x.items():
            n, mean, m2 = self.stats.get(k, (0.0, 0.0, 0.0))
            far = v if n <= 2 else (v - mean) / math.sqrt(max(VAR_FLOOR, m2 / (n - 1)))
            out[k] = max(-Z_LIMIT, min(Z_LIMIT, far)) if math.isfinite(v) else 0.0
        return out

    def chance(self, z: dict[str, float], bias: float) -> float:
        t = bias + sum(self.weights.get(k, 0.0) * v for k, v in z.items())
        return 0.5 if not math.isfinite(t) else 1 / (1 + math.exp(-t)) if t > -700 else 0.0

    def step(self, z: dict[str, float], error: float, rate: float) -> None:
        for k, v in z.items():
            w, anchor = self.weights.get(k, 0.0), PRIOR.get(k, 0.0)
            new = w - rate * (error * v + PULL * (w - anchor))
            low, high = max(-LIMIT, anchor - REACH), min(LIMIT, anchor + REACH)
            self.weights[k] = max(low, min(high, new)) if math.isfinite(new) else anchor

    def learn(self, x: dict[str, float], label: bool, wrong: bool) -> None:
        self.observe(x)
        z = self.z(x)
        error = self.chance(z, self.bias) - float(label)
        rate = RATE / math.sqrt(self.n + 1) * (SURPRISE if wrong else 1.0)
        self.step(z, error, rate)
        self.bias -= rate * error
        self.n += 1

    def pair(self, winner: dict[str, float], loser: dict[str, float]) -> None:
        """A step on the difference of two frames of a series; the bias stays, features alike say nothing."""
        self.observe(winner)
        self.observe(loser)
        a, b = self.z(winner), self.z(loser)
        d = {k: v for k in [*a, *(k for k in b if k not in a)] if (v := a.get(k, 0.0) - b.get(k, 0.0))}
        self.step(d, self.chance(d, 0.0) - 1, RATE / math.sqrt(self.n + 1))

    def prefer(self, winner: dict[str, float], losers: list[dict[str, float]]) -> None:
        """A step for each loser, one decision in all."""
        for loser in losers:
            self.pair(winner, loser)
        self.n += bool(losers)

    def take(self, r: tuple) -> None:
        """A row of a log: a decision, or one pair of a choice (the last one counts the choice)."""
        if r.rival is None:
            self.learn(dict(r.features), bool(r.user_decision), bool(r.ai_decision) != bool(r.user_decision))
        else:
            self.pair(dict(r.features), dict(r.rival))
            self.n += bool(r.last)


#: Features of a fixed place in rows of numbers; rows of a log of which the statistics are worked out at once.
NAMES, AHEAD = [*PRIOR, *(k for k in ORDINARY if k not in PRIOR)], 512


#: A log of which features and rival are numbers in the order of NAMES, as bytes of doubles (NaN where there is none): x, and y of a choice. Rows with other features, or with numbers that aren't finite, have no bytes but their maps.
NUMBERS = "context_key string, x binary, y binary, choice boolean, features map<string,double>, rival map<string,double>, ai_decision boolean, user_decision boolean, ts long, id long, pos int, last boolean"


def as_numbers(log: DataFrame) -> DataFrame:
    """Rows of EVENT as rows of NUMBERS; such rows stay as they are."""
    if "x" in log.columns:
        return log
    names, size = pa.array(NAMES), 8 * len(NAMES)

    def numbers(maps: pa.MapArray) -> tuple[np.ndarray, np.ndarray]:
        """A matrix, and which rows are odd."""
        at = maps.offsets.to_numpy()
        flat = slice(at[0], at[-1])
        row = np.repeat(np.arange(len(maps)), np.diff(at))
        place = pc.fill_null(pc.index_in(maps.keys[flat], value_set=names), -1).to_numpy(zero_copy_only=False)
        v = maps.items[flat].to_numpy(zero_copy_only=False)
        out, good = np.full((len(maps), len(NAMES)), np.nan), (place >= 0) & np.isfinite(v)
        out[row[good], place[good]] = v[good]
        return out, np.bincount(row[~good], minlength=len(maps)) > 0

    def packed(m: np.ndarray, there: np.ndarray) -> pa.Array:
        ends = np.append(0, np.cumsum(there * size)).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(there), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(m[there]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = dict(zip(batch.schema.names, batch.columns, strict=True))
            choice = c["rival"].is_valid().to_numpy(zero_copy_only=False)
            (x, odd), (y, also) = numbers(c["features"]), numbers(c["rival"])
            odd = odd | also | c["features"].is_null().to_numpy(zero_copy_only=False)
            kept = pa.array(np.arange(len(odd)), mask=~odd)
            c |= {"x": packed(x, ~odd), "y": packed(y, ~odd & choice), "choice": pa.array(choice), "features": c["features"].take(kept), "rival": c["rival"].take(kept)}
            yield pa.RecordBatch.from_arrays([c[n.split()[0]] for n in NUMBERS.split(", ")], names=[n.split()[0] for n in NUMBERS.split(", ")])

    return log.mapInArrow(run, NUMBERS)


def take_all(m: Model, x: np.ndarray, y: np.ndarray, choice: np.ndarray, user: np.ndarray, ai: np.ndarray, last: np.ndarray) -> None:
    """Model.take for rows of numbers in their order.

    All features are taken at once. Statistics don't depend on weights, so they
    come first for AHEAD rows, by the same operations as in Model.observe: that
    a distance from the mean is nothing at all decides whether a weight is
    pulled back."""
    w, anchor = np.array([m.weights.get(k, 0.0) for k in NAMES]), np.array([PRIOR.get(k, 0.0) for k in NAMES])
    n, mean, m2 = np.array([m.stats.get(k, (0.0, 0.0, 0.0)) for k in NAMES]).T.copy()
    low, high = np.maximum(-LIMIT, anchor - REACH), np.minimum(LIMIT, anchor + REACH)
    known, seen = np.zeros(len(NAMES), bool), np.zeros(len(NAMES), bool)
    bias, count, new = m.bias, m.n, np.empty_like(w)
    for k in range(0, len(x), AHEAD):
        rows = slice(k, min(k + AHEAD, len(x)))
        v = np.stack([x[rows], np.where(choice[rows, None], y[rows], np.nan)], axis=1)  # the winner is observed before the loser
        there = ~np.isnan(v)
        ns = n + np.cumsum(there.reshape(-1, len(NAMES)), axis=0).reshape(there.shape)
        means, m2s = np.empty((len(v), len(NAMES))), np.empty((len(v), len(NAMES)))
        filled, one, over = np.where(there, v, 0.0), there.astype(float), np.maximum(ns, 1)
        for i, two in enumerate(choice[rows].tolist()):
            for j in (0, 1)[: 1 + two]:
                far = (filled[i, j] - mean) * one[i, j]
                mean = mean + far / over[i, j]
                m2 = m2 + far * (filled[i, j] - mean)
            means[i], m2s[i] = mean, m2
        ns = ns[:, 1]
        size = np.sqrt(np.maximum(VAR_FLOOR, m2s / np.maximum(ns - 1, 1)))
        z = np.where(ns[:, None] <= 2, v, (v - means[:, None]) / size[:, None])
        z = np.where(there, np.clip(z, -Z_LIMIT, Z_LIMIT), 0.0)
        of_choice = choice[rows, None]
        d = z[:, 0] - z[:, 1]
        moved = np.where(of_choice, d != 0, there[:, 0])
        for di, mi, c, yes, wrong, end in zip(d, moved, choice[rows].tolist(), user[rows].tolist(), (ai[rows] != user[rows]).tolist(), last[rows].tolist(), strict=True):
            t = float(w @ di) + (0.0 if c else bias)
            chance = 0.5 if not math.isfinite(t) else 1 / (1 + math.exp(-t)) if t > -700 else 0.0
            error, rate = chance - (1.0 if c else float(yes)), RATE / math.sqrt(count + 1) * (SURPRISE if wrong and not c else 1.0)
            np.subtract(w, anchor, out=new)
            new *= PULL
            new += error * di
            new *= -rate
            new += w
            np.minimum(np.maximum(new, low, out=new), high, out=new)
            np.copyto(w, new, where=mi)
            if c:
                count += end
            else:
                bias -= rate * error
                count += 1
        n, mean, m2 = ns[-1], means[-1], m2s[-1]
        known, seen = known | moved.any(axis=0), seen | there.any(axis=(0, 1))
    m.weights |= {NAMES[i]: float(w[i]) for i in np.flatnonzero(known)}
    m.stats |= {NAMES[i]: [float(n[i]), float(mean[i]), float(m2[i])] for i in np.flatnonzero(seen)}
    m.bias, m.n = bias, count


def biggest_shift(before: dict[str, float], after: dict[str, float], x: dict[str, float]) -> tuple[str, float] | None:
    """The feature of this photo whose weight moved most, if by more than SHIFT, and its new weight; ties to the first."""
    moved = [(abs(after.get(k, 0.0) - before.get(k, 0.0)), k) for k in x if k not in SILENT]
    most = max((d for d, _ in moved), default=0.0)
    return next(((k, after.get(k, 0.0)) for d, k in moved if d == most), None) if most > SHIFT else None


MODEL_SCHEMA = "context_key string, weights map<string,double>, bias double, stats map<string,array<double>>, n long"
SHIFT_SCHEMA = "id long, context_key string, feature string, weight double"


#: A log of decisions and choices: a decision has no rival; a choice is a row for each loser, the rival, and the last of them is marked.
EVENT = "context_key string, features map<string,double>, rival map<string,double>, ai_decision boolean, user_decision boolean, ts long, id long, pos int, last boolean"


def as_log(decisions: DataFrame) -> DataFrame:
    """Decisions (context_key, features, ai_decision, user_decision, ts, id) as rows of EVENT; a log stays as it is."""
    missing = {"rival": F.lit(None).cast("map<string,double>"), "pos": F.lit(0), "last": F.lit(True)}
    names = ["context_key", "features", "rival", "ai_decision", "user_decision", "ts", "id", "pos", "last"]
    return decisions.select(*[F.col(n) if n in decisions.columns else missing[n].alias(n) for n in names])


def choice_log(choices: DataFrame, photos: DataFrame) -> DataFrame:
    """A log of choices (winner_id, loser_id, pos, ts): the winner's context, and for each loser the features of both.

    photos: id, context_key, features. Losers that aren't there are passed over, and choices without a loser or a winner.
    Maps of features take many times the bytes of the file that they are made of, so neither side is ever broadcast."""
    w = photos.select(F.col("id").alias("winner_id"), "context_key", "features")
    l = photos.select(F.col("id").alias("loser_id"), F.col("features").alias("rival"))  # noqa: E741
    j = choices.join(w.hint("merge"), "winner_id").join(l.hint("merge"), "loser_id")
    last = j.groupBy("winner_id", "ts").agg(F.max("pos").alias("_last"))
    j = j.join(last.hint("merge"), ["winner_id", "ts"])
    none = F.lit(None).cast("boolean")
    return j.select("features", "rival", none.alias("ai_decision"), none.alias("user_decision"), "ts", F.col("winner_id").alias("id"), F.col("pos").cast("int").alias("pos"), (F.col("pos") == F.col("_last")).alias("last"), "context_key")


def ai_decision(score: str = "ai_score") -> Column:
    """What the model is held to have said: keep from 65 on, whatever the thresholds have moved to."""
    return F.col(score) >= 65


def _in_order(decisions: DataFrame) -> DataFrame:
    return as_log(decisions).repartition("context_key").sortWithinPartitions("context_key", "ts", "id", "pos")


def for_both(decisions: DataFrame) -> DataFrame:
    """Every row for its context and for the global model; what the rows are made of is made once."""
    return decisions.withColumn("context_key", F.explode(F.array("context_key", F.lit(GLOBAL))))


def replay(decisions: DataFrame) -> DataFrame:
    """One model for each context and one over all, by replaying decisions and choices (rows of EVENT, or of decisions alone) in one order.

    The order of a context's decisions is its meaning, so each context is one
    task's, and so is the global one; rows stream through and only the model is
    held."""
    both = _in_order(for_both(decisions))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, m = None, Model()

        def told() -> pd.DataFrame:
            return pd.DataFrame([{"context_key": key, "weights": m.weights, "bias": m.bias, "stats": m.stats, "n": m.n}])

        for pdf in it:
            for r in pdf.itertuples(index=False):
                if r.context_key != key:
                    if m.n:
                        yield told()
                    key, m = r.context_key, Model()
                m.take(r)
        if m.n:
            yield told()

    return both.mapInPandas(run, MODEL_SCHEMA)


def shifts(decisions: DataFrame) -> DataFrame:
    """id, context_key, feature, weight: what a correction (a decision unlike the model's) changed most in its context's model."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, m = None, Model()
        for pdf in it:
            out = []
            for r in pdf.itertuples(index=False):
                if r.context_key != key:
                    key, m = r.context_key, Model()
                if r.rival is not None:
                    m.take(r)
                    continue
                x, wrong, before = dict(r.features), bool(r.ai_decision) != bool(r.user_decision), dict(m.weights)
                m.learn(x, bool(r.user_decision), wrong)
                if wrong and (s := biggest_shift(before, m.weights, x)):
                    out.append((r.id, key, *s))
            yield pd.DataFrame(out, columns=["id", "context_key", "feature", "weight"])

    return _in_order(decisions).mapInPandas(run, SHIFT_SCHEMA)


def predict(photos: DataFrame, models: DataFrame, *, enrolled: bool = True) -> DataFrame:
    """id, score, personal_delta, uncertainty, stage, top: a blend n / (n + 12) of the context's and the global model.

    personal_delta is what learning has added to the score, top the four
    largest contributions. Scoring is built-in functions over arrays in the
    order of the features, into which a model's maps are laid once; models are
    few, and broadcast if a count says so."""
    few = (lambda m: F.broadcast(m)) if models.limit(10_001).count() <= 10_000 else (lambda m: m)
    columns, fresh = feature_columns(photos.columns, enrolled=enrolled), seeds()
    prior = F.array(*[F.lit(float(PRIOR.get(k, 0.0))) for k in columns])
    plain = F.array(*[F.array(*map(F.lit, fresh[k])) if k in fresh else F.lit(None).cast("array<double>") for k in columns])
    laid = lambda m: models.filter(m).select("context_key", F.array(*[F.coalesce(F.try_element_at("weights", F.lit(k)), F.lit(0.0)) for k in columns]).alias("w"), "bias", F.when(F.col("stats").isNotNull(), F.array(*[F.try_element_at("stats", F.lit(k)) for k in columns])).alias("s"), "n")
    x = spread(photos).select("id", context_key().alias("context_key"), F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("k"), v.alias("v")) for i, (k, v) in enumerate(columns.items())]).alias("x"))
    x = x.withColumn("x", F.filter("x", lambda e: e["v"].isNotNull()))
    c = few(laid(F.col("context_key") != GLOBAL).toDF("context_key", "cw", "cb", "cs", "cn"))
    g = laid(F.col("context_key") == GLOBAL).select(F.col("w").alias("gw"), F.col("bias").alias("gb"), F.col("s").alias("gs"))  # one row at most
    j = x.join(c, "context_key", "left").join(F.broadcast(g), how="left")
    j = j.select("id", "x", "cb", "gb", "cn", *[F.coalesce(w, prior).alias(w) for w in ("cw", "gw")], *[F.coalesce(s, plain).alias(s) for s in ("cs", "gs")], prior.alias("prior"))

    def z(e: Column, stats: str) -> Column:
        s = F.get(stats, e["i"])
        n, mean, m2 = s[0], s[1], s[2]
        far = F.when(F.coalesce(n, F.lit(0.0)) <= 2, e["v"]).otherwise((e["v"] - mean) / F.sqrt(F.greatest(F.lit(VAR_FLOOR), m2 / (n - 1))))
        return F.greatest(F.lit(-Z_LIMIT), F.least(F.lit(Z_LIMIT), far))

    n = F.coalesce("cn", F.lit(0))
    j = j.withColumn("a", n / (n + BLEND))
    far = F.transform("x", lambda e: F.struct(e["i"].alias("i"), e["k"].alias("k"), z(e, "cs").alias("z"), z(e, "gs").alias("g")))
    j = j.withColumn("parts", F.transform(far, lambda e: F.struct(e["i"].alias("i"), e["k"].alias("k"), e["z"].alias("z"), (F.col("a") * F.get("cw", e["i"]) * e["z"] + (1 - F.col("a")) * F.get("gw", e["i"]) * e["g"]).alias("c"))))
    total = lambda f: F.aggregate("parts", F.lit(0.0), lambda t, e: t + f(e))
    chance = lambda t: 1 / (1 + F.exp(-t))
    p = chance(F.col("a") * F.coalesce("cb", F.lit(0.0)) + (1 - F.col("a")) * F.coalesce("gb", F.lit(0.0)) + total(lambda e: e["c"]))
    naive = chance(total(lambda e: F.get("prior", e["i"]) * e["z"]))
    j = j.withColumn("p", p).withColumn("naive", naive).withColumn("far", total(lambda e: F.abs(e["z"])) / F.greatest(F.size("parts"), F.lit(1)))
    order = F.array_sort(F.transform("parts", lambda e: F.struct((-F.abs(e["c"])).alias("d"), e["i"].alias("i"), e["k"].alias("feature"), e["c"].alias("contribution"))))
    top = F.transform(F.slice(order, 1, 4), lambda e: F.struct(e["feature"].alias("feature"), e["contribution"].alias("contribution")))
    stage = F.when(n < COLD, "cold").when(n < WARM, "warming").otherwise("trained")
    unsure = F.greatest(1 - F.abs(F.col("p") - 0.5) * 2, F.least(F.lit(1.0), F.col("far") / 1.5))
    return j.select("id", round_half_up(F.col("p") * 100).cast("long").alias("score"), round_half_up((F.col("p") - F.col("naive")) * 100).cast("long").alias("personal_delta"), unsure.alias("uncertainty"), stage.alias("stage"), top.alias("top"))


def model_summary(models: DataFrame, k: int = 4) -> DataFrame:
    """context_key, n, stage and the k largest weights (feature, weight) that tell of a taste, once COLD decisions are there; the global model left out."""
    told = F.filter(F.map_entries("weights"), lambda e: ~e["key"].isin(sorted(SILENT)))
    largest = F.array_sort(F.transform(told, lambda e: F.struct((-F.abs(e["value"])).alias("d"), e["key"].alias("feature"), e["value"].alias("weight"))))
    top = F.transform(F.slice(largest, 1, k), lambda e: F.struct(e["feature"].alias("feature"), e["weight"].alias("weight")))
    stage = F.when(F.col("n") < COLD, "cold").when(F.col("n") < WARM, "warming").otherwise("trained")
    return models.filter(F.col("context_key") != GLOBAL).select("context_key", "n", stage.alias("stage"), F.when(F.col("n") >= COLD, top).otherwise(F.slice(top, 1, 0)).alias("top"))


def learned_weight(models: DataFrame) -> DataFrame:
    return models.filter(F.col("context_key") == GLOBAL).select(F.least(F.lit(1.0), F.col("n") / WARM).alias("learned_weight"))


def counterfactual(score: str, factors: str, select_at: int = 65, reject_at: int = 35) -> Column:
    """The negative factor of smallest weight without which the verdict would differ; null if there is none.

    factors: ARRAY<STRUCT<feature, contribution>>."""
    p = F.greatest(F.lit(0.001), F.least(F.lit(0.999), F.col(score) / 100))
    z = F.ln(p / (1 - p))
    after = lambda f: round_half_up(100 / (1 + F.exp(-(z - f["contribution"]))))
    verdict = lambda f: F.when(after(f) >= select_at, "selected").when((F.col(score) <= reject_at) & (after(f) > reject_at), "rejected")
    hits = F.filter(factors, lambda f: (f["contribution"] < 0) & verdict(f).isNotNull())
    order = F.transform(hits, lambda f: F.struct(F.abs(f["contribution"]).alias("w"), f["feature"].alias("feature"), verdict(f).alias("verdict"), after(f).alias("score")))
    return F.when(F.col(score) < select_at, F.array_min(order))
