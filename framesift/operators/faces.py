"""What the faces of a photo say, as expressions over its array ``faces`` (built-in functions only).

A face is a struct with box (x, y, width, height as shares of the frame),
face_score, smile, eye_left, eye_right, blinking, mouth_open, happy, surprise,
negative, eye_contact, catchlight, name and similarity. Missing signals are
neutral; a photo without faces has null ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A face smiles from SMILES on; it is a genuine smile if the eyes are closed further than EYES; mouth and face area thresholds.
SMILES, EYES, UNEXPLAINED, PROMINENT = 0.4, 0.77, 0.3, 0.004
#: Where a face's top edge should be, as shares of the frame's height.
HEADROOM = (0.04, 0.22, 0.5)
MARGIN, HIDDEN = 0.03, 0.5


def area(face: Column) -> Column:
    return face["box"][2] * face["box"][3]


def prominent(faces: str = "faces") -> Column:
    """The faces that are large enough to be what the photo is of."""
    return F.filter(faces, lambda f: area(f) >= PROMINENT)


def awkward(face: Column) -> Column:
    """An open mouth that neither joy nor surprise explains."""
    none = lambda c: F.coalesce(c, F.lit(0.0)) < UNEXPLAINED
    return F.coalesce(face["mouth_open"], F.lit(False)) & none(face["happy"]) & none(face["surprise"])


def genuine_smile(face: Column) -> Column:
    """A smile that narrows the eyes."""
    return (face["smile"] >= SMILES) & ((face["eye_left"] + face["eye_right"]) / 2 < EYES)


def appearance(blinking: Column, smile: Column, eye_contact: Column, awkward: Column) -> Column:
    """How well a face looks, 0..1: 0 with closed eyes; an awkward moment costs more than a smile brings."""
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    base = 0.55 + 0.3 * unit(smile) + 0.15 * unit(F.coalesce(eye_contact, F.lit(0.5)))
    return F.when(blinking, 0.0).otherwise(unit(F.when(F.coalesce(awkward, F.lit(False)), base - 0.45).otherwise(base)))


def engagement(face: Column) -> Column:
    value = 0.5 + 0.5 * F.coalesce(face["happy"], F.lit(0.0)) + 0.25 * F.coalesce(face["surprise"], F.lit(0.0)) - 0.5 * F.least(F.lit(1.0), F.coalesce(face["negative"], F.lit(0.0)))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def eye_contact(yaw: Column, pitch: Column, gaze: Column) -> Column:
    """0..1 from the angles of the head in radians and how far the irises are off; 0.5 without angles."""
    head = F.greatest(F.lit(0.0), 1 - (F.abs(yaw) + F.abs(pitch) * 0.7) / 0.6)
    eyes = F.greatest(F.lit(0.0), 1 - F.abs(F.coalesce(gaze, F.lit(0.0))) / 0.3)
    return F.when(yaw.isNull() | pitch.isNull(), 0.5).otherwise(0.6 * head + 0.4 * eyes)


def ratio(faces: str, test) -> Column:
    """Share of the faces that pass; null without faces."""
    n = F.size(faces)
    return F.when(n > 0, F.size(F.filter(faces, test)) / n)


def mean(faces: str, value) -> Column:
    n = F.size(faces)
    return F.when(n > 0, F.aggregate(faces, F.lit(0.0), lambda t, f: t + value(f)) / n)


def face_measures(faces: str = "faces", light: str | None = None) -> list[Column]:
    """The aggregates of a photo's faces, named; under hard light eyes narrow by themselves, so genuine smiles are null."""
    n = F.size(faces)
    genuine = ratio(faces, genuine_smile)
    return [
        n.alias("face_count"),
        F.size(F.filter(faces, lambda f: f["name"].isNotNull())).alias("known_face_count"),
        F.size(prominent(faces)).alias("prominent"),
        F.coalesce(F.array_max(F.transform(faces, lambda f: f["smile"])), F.lit(0.0)).alias("best_smile"),
        F.forall(faces, lambda f: ~f["blinking"]).alias("all_eyes_open"),
        ratio(faces, lambda f: ~f["blinking"]).alias("group_eyes_open"),
        ratio(faces, lambda f: f["smile"] >= SMILES).alias("group_smile"),
        ratio(faces, awkward).alias("group_awkward"),
        (F.when(F.coalesce(F.col(light), F.lit("")) != "hard", genuine) if light else genuine).alias("group_genuine_smile"),
        ratio(faces, lambda f: F.coalesce(f["catchlight"], F.lit(False))).alias("group_catchlight"),
        mean(faces, lambda f: F.coalesce(f["eye_contact"], F.lit(0.5))).alias("avg_eye_contact"),
        mean(faces, engagement).alias("avg_engagement"),
    ]


def main_box(faces: str = "faces") -> Column:
    """The largest face's box; of equal ones the last."""
    return F.aggregate(faces, F.lit(None).cast("array<double>"), lambda b, f: F.when(b.isNull() | ~(b[2] * b[3] > area(f)), f["box"]).otherwise(b))


def composition(box: Column) -> list[Column]:
    """thirds and headroom of the main box; 0.5 without one."""
    x, y = box[0] + box[2] / 2, box[1] + box[3] / 2
    near = F.least(*[F.hypot(x - F.lit(a / 3), y - F.lit(b / 3)) for a in (1, 2) for b in (1, 2)])
    low, high, end = HEADROOM
    top = box[1]
    room = F.when(top < low, top / low).when(top > high, F.greatest(F.lit(0.0), 1 - (top - high) / (end - high))).otherwise(1.0)
    furthest = F.hypot(F.lit(0.5 - 1 / 3), F.lit(0.5 - 1 / 3))
    thirds = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - near / furthest))
    return [F.when(box.isNull(), 0.5).otherwise(thirds).alias("thirds"), F.when(box.isNull(), 0.5).otherwise(room).alias("headroom")]


def best_per_name(faces: str = "faces") -> Column:
    """MAP of each known name to its best similarity in the photo."""
    named = F.filter(faces, lambda f: f["name"].isNotNull())
    names = F.array_distinct(F.transform(named, lambda f: f["name"]))
    best = F.transform(names, lambda n: F.array_max(F.transform(F.filter(named, lambda f: f["name"] == n), lambda f: f["similarity"])))
    return F.map_from_arrays(names, best)


def main_object(objects: str = "objects", score: float = 0.3, least: float = 0.03) -> Column:
    """Box of the largest object that is sure and large enough (struct of score and box), else null; of equal ones the last."""
    fit = F.filter(objects, lambda o: (o["score"] >= score) & (o["box"][2] * o["box"][3] >= least))
    return F.aggregate(fit, F.lit(None).cast("array<double>"), lambda b, o: F.when(b.isNull() | ~(b[2] * b[3] > o["box"][2] * o["box"][3]), o["box"]).otherwise(b))


def cropped_at_edge(limbs: str = "limbs", margin: float = MARGIN, hidden: float = HIDDEN) -> Column:
    """A hand or foot (struct of x, y, visibility) that is at the frame's edge and hardly seen."""
    edge = lambda p: (p["x"] < margin) | (p["x"] > 1 - margin) | (p["y"] < margin) | (p["y"] > 1 - margin)
    return F.exists(limbs, lambda p: edge(p) & (F.coalesce(p["visibility"], F.lit(1.0)) < hidden))


def text_coverage(boxes: str, width: str = "width", height: str = "height") -> Column:
    """Share of the frame under boxes of text (x, y, width, height in pixels), 1 at most; 0 for a frame without size."""
    total = F.aggregate(boxes, F.lit(0.0), lambda t, b: t + b[2] * b[3])
    frame = F.col(width) * F.col(height)
    return F.when(frame > 0, F.least(F.lit(1.0), total / frame)).otherwise(0.0)


def composition_score(faces: Column, thirds: Column, headroom: Column, leading_lines: Column, symmetry: Column, negative_space: Column) -> Column:
    """How well a frame is composed, to two digits: by the faces' place, else by lines, symmetry and some, not too much, empty space."""
    bare = F.greatest(F.lit(0.0), 1 - F.abs(negative_space - 0.3) / 0.7)
    yes = lambda c: F.when(c, 1.0).otherwise(0.0)
    score = F.when(faces, 0.6 * thirds + 0.4 * headroom).otherwise(0.4 * yes(leading_lines) + 0.3 * yes(symmetry) + 0.3 * bare)
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)) * 100 + 0.5) / 100


def scene_meaning(scene: Column, face_count: Column, youngest: Column) -> Column:
    """The scene, and whether a child below 13 is in it."""
    child = F.coalesce(youngest < 13, F.lit(False))
    return F.when(face_count == 0, scene).when((scene == "portrait") & child, "child_portrait").when((scene == "group") & child, "family_group").otherwise(scene)
