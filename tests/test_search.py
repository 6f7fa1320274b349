"""Search, names in order, references in blocks, scans and samples against plain versions."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from framesift.operators import joins as J
from framesift.operators import ranks
from framesift.operators import search as S
from framesift.operators import similarity as M
from framesift.plans import library, registry
from framesift.sources import files

SF = "/root/testdata/sf0.001"
QUERIES = registry.queries()


def test_fold(spark):
    words = ["Pisică", "ȘTEFAN țară", "Évora Ñandú", "ø đ ß", "a\u0301b", "İstanbul", "漢字 Ωmega"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(S.fold("w")).collect()][:5] == ["pisica", "stefan tara", "evora nandu", "ø đ ß", "ab"]
    assert all(len(S.folded(w)) for w in words)


def test_related_words_go_both_ways():
    assert "snow" in S.related("zap") and "snow" in S.related("zapada mare") and S.related("za") == [] and S.related("xyzzy") == []
    assert set(S.related("cop")) == {"person", "child", "boy", "girl", "baby"}


def test_date_words(spark):
    at = 1_785_283_200_000  # 29 July 2026
    ro, en = spark.range(1).select(S.date_words(F.lit(at)), S.date_words(F.lit(at), "en")).first()
    assert ro == "2026 iulie iul. 29 iul. 2026" and en == "2026 July Jul Jul 29, 2026"


def test_places_reach_as_far_as_their_people(spark):
    df = spark.createDataFrame([(0,), (100,), (100_000,), (10_000_000,)], "p int")
    assert [r[0] for r in df.select(S.place_radius_km("p")).collect()] == pytest.approx([3.0, 1.5, 6.0, 12.0])
    said = spark.range(1).select(S.place_label(F.lit("A"), F.lit("RO"), F.lit(1.0), F.lit(3.0)), S.place_label(F.lit("A"), F.lit(""), F.lit(4.0), F.lit(3.0), "en")).first()
    assert tuple(said) == ("A, RO", "near A")


def test_each_kind_of_text_is_found(spark):
    found = Counter(n for r in QUERIES["search_text"](spark, SF).collect() for n in r["found"].split("|"))
    assert set(found) == set(library.NEEDLES[:-1])


def plain_nearest(p, places):
    from math import atan2, cos, radians, sin, sqrt

    lat, lon = p
    band, best = 30 / 110.574, None
    for n, a, o, k in places:
        if lat - band <= a < lat + band:
            d = o - lon
            d = d - 360 if d > 180 else d + 360 if d < -180 else d
            s = ((a - lat) ** 2 + (d * cos(radians(lat))) ** 2, a, k)
            if best is None or s < best[0]:
                best = (s, n, a, o)
    if best is None:
        return None
    _, n, a, o = best
    h = sin(radians(a - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(a)) * sin(radians(o - lon) / 2) ** 2
    return n if 12742 * atan2(sqrt(h), sqrt(1 - h)) <= 30 else None


def test_places_near_poles_and_the_date_line(spark):
    rng = np.random.default_rng(4)
    at = lambda n: [(float(a), float(o)) for a, o in zip(rng.choice([0.0, 44.0, 60.0, 88.0, 89.7, -89.9, -45.0], n) + rng.normal(0, 0.1, n), (rng.choice([-180.0, 179.9, 0.0, 25.0], n) + rng.normal(0, 0.3, n) + 180) % 360 - 180)]
    photos, places = [(min(89.99, max(-89.99, a)), o) for a, o in at(400)], [(f"p{i}", min(89.99, max(-89.99, a)), o, i) for i, (a, o) in enumerate(at(150))]
    got = {r["id"]: r["name"] for r in J.nearest_place(spark.createDataFrame([(i, *p) for i, p in enumerate(photos)], "id long, lat double, lon double"), spark.createDataFrame(places, "name string, lat double, lon double, ordinal int")).collect()}
    want = {i: n for i, p in enumerate(photos) if (n := plain_nearest(p, places))}
    assert got == want and 50 < len(want)


def test_names_as_a_reader_sorts_them(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(["b", "Ábel", "abel", "Abel", "ábel", "Zoë", "zoe", "a", "țară", "tara", "B"])], "id long, file_name string")
    from framesift.operators.filters import reading_order

    got = [r["file_name"] for r in ranks.ranked(df, [reading_order("file_name"), "id"]).orderBy("place").collect()]
    assert got == ["a", "abel", "Abel", "ábel", "Ábel", "b", "B", "tara", "țară", "zoe", "Zoë"]
    rows = QUERIES["names_in_order"](spark, SF).orderBy("place").collect()
    assert [r["place"] for r in rows] == list(range(1, len(rows) + 1)) and rows[0]["file_name"].startswith("abel 0") and rows[-1]["file_name"].startswith("Zoë")


def test_best_match_over_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    people, faces = rng.normal(0, 1, (70, 6)), rng.normal(0, 1, (300, 6))
    people[7] = people[3] * 2  # equally similar: the larger id
    faces[0] = people[3]
    faces[1] = 0
    p = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(people)], "person_id long, embedding array<double>")
    f = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(faces)], "face_id long, embedding array<float>")
    unit = lambda m: m / np.where((n := np.linalg.norm(m, axis=1)) == 0, 1, n)[:, None]
    s = unit(faces) @ unit(people).T
    want = {i: (int(69 - np.round(row, 9)[::-1].argmax()), row.max()) for i, row in enumerate(s) if row.max() >= 0.55}
    for refs, each in ((8192, 1 << 16), (20, 64)):
        monkeypatch.setattr(M, "REFERENCES", refs)
        monkeypatch.setattr(M, "FACES", each)
        got = {r["face_id"]: (r["person_id"], r["similarity"]) for r in M.best_match(f, p).collect()}
        assert got.keys() == want.keys() and all(got[i][0] == want[i][0] or i and abs(got[i][1] - want[i][1]) < 1e-6 for i in got) and got[0][0] == 7


def test_quick_scan(spark):
    rows = [(str(r["doc_id"]), (r["text"] or "").encode()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    sizes = Counter(len(c) for _, c in rows if c)
    by = {}
    for path, c in rows:
        if c and sizes[len(c)] > 1:
            by.setdefault((len(c), hashlib.sha256(c[:65_536] + c[max(0, len(c) - 65_536) :]).hexdigest()), []).append(path)
    got = {(r["size"], r["digest"]): (r["n"], r["first_path"]) for r in QUERIES["quick_duplicates"](spark, SF).collect()}
    assert got == {k: (len(v), min(v)) for k, v in by.items() if len(v) > 1} and got


def test_samples_are_bounded_and_the_same(spark):
    rows = QUERIES["stage_samples"](spark, SF).collect()
    n = Counter(r["stage"] for r in rows)
    total = Counter(r["status"] for r in library.photos(spark, SF, "status").collect())
    assert n == {k: min(200, v) for k, v in total.items()} and sorted(map(tuple, rows)) == sorted(map(tuple, QUERIES["stage_samples"](spark, SF).collect()))


def test_counts_within(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 3, 2), ("b", 2, 7), ("a", 2, 1), (None, 1, 4)], "k string, v int, c int")
    assert sorted((r["k"] or "", r["v"], r["upto"]) for r in ranks.counted_within(df, "k", "v", "c", "upto").collect()) == [("", 1, 4), ("a", 1, 5), ("a", 2, 6), ("a", 3, 8), ("b", 2, 7)]


def test_another_version_of_a_backup_is_an_error(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"version": 3, "photos": []}')
    with pytest.raises(Exception, match="version 1 or 2"):
        files.backup(spark, str(tmp_path)).collect()
