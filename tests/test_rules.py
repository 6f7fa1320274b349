"""Single rules at the values that tell them from similar ones."""

import pytest
from pyspark.sql import functions as F

from framesift.functions import expr as X
from framesift.operators import aggregates as A
from framesift.operators import cluster as C
from framesift.operators import faces as FX
from framesift.operators import filters as P
from framesift.operators import groups as G
from framesift.sources import files

VIEW = "id long, group_id string, status string, ai_score long, sharpness double, exposure double, face_count int, known_face_count int, stranger_count int, all_eyes_open boolean, group_eyes_open double, group_smile double, group_awkward double, best_smile double, composition_score double, avg_eye_contact double, highlight_clipping double, shadow_clipping double, subject_in_focus boolean, text_coverage double, tags array<string>, persons array<string>, width int, height int, scene_type string, largest_face double, file_name string, captured_at long"
BASE = dict(id=1, group_id="g", status="pending", ai_score=50, sharpness=50.0, exposure=50.0, face_count=0, known_face_count=0, stranger_count=0, all_eyes_open=True, best_smile=0.0, tags=["dog"], persons=[], width=3, height=2, scene_type="detail", file_name="a.jpg", captured_at=0)


@pytest.fixture()
def view(spark):
    names = [c.split()[0] for c in VIEW.split(", ")]
    return lambda *rows: spark.createDataFrame([tuple((BASE | r).get(n) for n in names) for r in rows], VIEW)


def test_landscapes_are_judged_on_a_curve(view):
    got = [r[0] for r in view({"sharpness": 60.0}, {"sharpness": 60.0, "face_count": 1}, {"sharpness": 20.0}, {"sharpness": -1.0}).select(P.effective_sharpness()).collect()]
    assert got == pytest.approx([73.6, 60.0, 38.07, 0.0], abs=0.05)


def test_closed_eyes_of_a_group_are_a_defect(view):
    rows = view({"id": 1, "face_count": 5, "all_eyes_open": False, "group_eyes_open": 0.8}, {"id": 2, "face_count": 5, "group_eyes_open": 0.79}, {"id": 3, "face_count": 1, "all_eyes_open": False}, {"id": 4, "all_eyes_open": False})
    assert {r["id"] for r in rows.filter(P.has_defect()).collect()} == {2, 3}


def test_abstract_tags_are_no_subject(view):
    rows = view({"id": 1, "ai_score": 80, "tags": ["Text", "pattern"]}, {"id": 2, "ai_score": 80, "tags": ["Text", "dog"]}, {"id": 3, "ai_score": 80, "tags": []}, {"id": 4, "ai_score": 80, "tags": [], "face_count": 1})
    assert [r[0] for r in rows.orderBy("id").select(P.decide_status()).collect()] == ["review", "selected", "review", "selected"]


def test_two_faces_are_a_portrait_if_one_is_large(view):
    rows = view({"face_count": 2, "largest_face": 0.041}, {"face_count": 2, "largest_face": 0.04}, {"face_count": 1, "largest_face": 0.001}, {"face_count": 3, "largest_face": 0.5}, {"width": 2, "height": 2}, {"width": 1})
    assert [r[0] for r in rows.select(P.scene_of()).collect()] == ["portrait", "group", "portrait", "group", "landscape", "detail"]


def test_difficulty(spark):
    d = spark.createDataFrame([(40, None), (50, None), (35, None), (80, None), (40, 0.9), (40, float("nan"))], "ai_score int, ai_uncertainty double")
    assert [r[0] for r in d.select(X.review_difficulty()).collect()] == pytest.approx([1 / 3, 1, 0, 0, 0.9, 1 / 3])


@pytest.mark.parametrize(("n", "sizes"), [(17, [3, 3, 3, 3, 3, 2]), (13, [3, 2, 2, 2, 2, 2]), (25, [5, 4, 4, 4, 4, 4]), (12, [2] * 6), (11, [])])
def test_trend_buckets_are_even(spark, n, sizes):
    c = spark.createDataFrame([(i, i, True, i % 2 == 0) for i in range(n)], "id long, ts long, ai_decision boolean, user_decision boolean")
    assert [r["n"] for r in A.agreement_trend(c).orderBy("bucket").collect()] == sizes


def test_rows_begin_anew_with_a_band(spark):
    hard = [0.1] * 4 + [0.5] + [0.9] * 3
    q = spark.createDataFrame([(i, "p", v) for i, v in enumerate(hard)] + [(100 + i, "q", 0.1) for i in range(5)], "id long, key string, d double")
    rows = {r["id"]: (r["row_start"], r["cell"], r["heading"]) for r in G.row_plan(q, F.col("d"), [F.col("id")], "key", 3).collect()}
    assert [rows[i] for i in range(8)] == [(0, 0, "easy"), (0, 1, None), (0, 2, None), (3, 0, None), (3, 1, None), (5, 0, "hard"), (5, 1, None), (5, 2, None)]
    assert [rows[100 + i][:2] for i in range(5)] == [(0, 0), (0, 1), (0, 2), (3, 0), (3, 1)] and rows[100][2] is None


def test_best_frame_counts_groups_and_awkward_moments(view):
    one = dict(face_count=3, group_smile=0.9, group_eyes_open=1.0)
    rows = view({"id": 1, **one, "group_awkward": 0.5}, {"id": 2, **one, "sharpness": 49.0}, {"id": 3, "group_id": "h", "avg_eye_contact": 0.4}, {"id": 4, "group_id": "h"}, {"id": 5, "group_id": "i", "composition_score": 0.6}, {"id": 6, "group_id": "i"})
    assert {r["group_id"]: r["keep_id"] for r in G.best_frames(rows).collect()} == {"g": 2, "h": 4, "i": 5}


def test_more_open_eyes_explain_a_choice(spark, view):
    rows = view({"id": 1, "face_count": 4, "group_eyes_open": 0.75}, {"id": 2, "face_count": 4, "group_eyes_open": 0.5}, {"id": 3, "group_id": "h", "face_count": 1}, {"id": 4, "group_id": "h", "face_count": 1, "all_eyes_open": False})
    best = spark.createDataFrame([("g", 1), ("h", 3)], "group_id string, keep_id long")
    assert {r["group_id"]: r["reasons"] for r in G.explain_choice(rows, best).collect()} == {"g": "eyesMore", "h": "eyesOnlyOneOfTwo"}


def test_top_picks_know_nobody(view):
    rows = view(*[{"id": i, "captured_at": i, "group_id": "", **r} for i, r in enumerate([{"face_count": 1, "known_face_count": 1, "ai_score": 10}, {"face_count": 1, "ai_score": 20}, {"ai_score": 90}, {"text_coverage": 0.2, "tags": [], "ai_score": 99}, {"text_coverage": 0.2, "ai_score": 95}])])
    assert [r["id"] for r in G.top_picks(rows, least=2, k=5).orderBy("place").collect()] == [1, 0, 4, 2, 3]


def names(spark, given):
    p = spark.createDataFrame([(i, "d", n) for i, n in enumerate(given)], "id long, folder string, file_name string")
    return [r["out_name"] for r in G.sequence_numbers(p, "folder", [F.col("id")]).orderBy("seq").collect()]


def plain_names(given):
    used, out = set(), []
    for n in given:
        dot = n.rfind(".")
        base, ext = (n[:dot], n[dot:]) if dot > 0 else (n, "")
        took, k = n, 2
        while took in used:
            took, k = f"{base} ({k}){ext}", k + 1
        used.add(took)
        out.append(took)
    return out


@pytest.mark.parametrize("given", [
    ["a.jpg", "a.jpg", "a (2).jpg"], [".jpg", ".jpg"], ["a (2).jpg", "a.jpg", "a.jpg", "a.jpg"], ["a", "a", "a.b.c", "a.b.c", "a (2)", "a (2)"],
    ["x.jpg"] * 5, ["a (3).jpg", "a.jpg", "a.jpg", "a.jpg", "a (2).jpg", "a (3).jpg", "a (2) (2).jpg"], ["", "", "."," .", "."],
])
def test_export_names_take_the_first_free_number(spark, given):
    assert names(spark, given) == plain_names(given)


def test_labels_and_score_words(view):
    rows = view({"id": 1, "persons": ["C", "A", "B"], "face_count": 3}, {"id": 2, "persons": ["B", "A"], "face_count": 3, "stranger_count": 1}, {"id": 3, "face_count": 1}, {"id": 4, "tags": ["smile", "dog"]}, {"id": 5, "tags": ["smile"], "scene_type": "landscape"}, {"id": 6, "tags": ["smile"]}, {"id": 7, "persons": ["A/B"], "face_count": 1})
    assert [r[0] for r in rows.orderBy("id").select(files.folder_label({"cat": "pisica"})).collect()] == ["A, B și C", "A și B și alții", "Necunoscuți", "Dog", "Peisaje", "Detalii", "A-B"]
    assert [r[0] for r in view({"ai_score": 100}, {"ai_score": 99}, {"ai_score": 0}, {"ai_score": 85}).select(files.score_keyword()).collect()] == ["IA 90-99", "IA 90-99", "IA 0-9", "IA 80-89"]


def test_composites(spark):
    def told(faces, frames=(1, 2)):
        f = spark.createDataFrame([("s", fr, t, q, n) for fr, t, q, n in faces], "series string, frame long, track long, quality double, name string")
        g = spark.createDataFrame([("s", x) for x in frames], "series string, frame long")
        return [(r["base_frame"], [(x["track"], x["from_frame"], round(x["gain"], 6), x["name"]) for x in r["swaps"]]) for r in C.composite_suggestion(f, g).collect()]

    assert told([(1, 0, 0.9, None), (1, 1, 0.2, None), (2, 0, 0.1, None), (2, 1, 0.8, "B")]) == [(1, [(1, 2, 0.6, "B")])]
    assert told([(1, 0, 0.9, None), (1, 1, 0.2, None)], (1,)) == []  # one frame
    assert told([(1, 0, 0.2, None), (2, 0, 0.9, None), (1, 1, 0.9, None)]) == []  # one person in two frames
    assert told([(1, 0, 0.9, None), (1, 1, 0.55, None), (2, 0, 0.1, None), (2, 1, 0.59, None)]) == []  # the other is not good either
    three = [*[(1, t, 0.9, None) for t in (4, 5, 6, 7)], *[(2, t, 0.1, None) for t in (4, 5, 6, 7)], *[(1, t, 0.1, None) for t in range(3)], *[(2, t, 0.9, None) for t in range(3)]]
    assert told(three) == []  # three swaps are too many


def test_appearance(spark):
    rows = spark.createDataFrame([(True, 1.0, 1.0, False), (False, 1.0, 1.0, False), (False, 0.0, None, False), (False, 0.0, 0.0, True)], "b boolean, s double, e double, a boolean")
    assert [r[0] for r in rows.select(FX.appearance(F.col("b"), F.col("s"), F.col("e"), F.col("a"))).collect()] == pytest.approx([0.0, 1.0, 0.625, 0.1])
