"""The learner against a plain replay of the same decisions, photo by photo."""

import math

import pytest
from pyspark.sql import functions as F

from framesift.operators import scoring as S
from framesift.plans import advanced, registry
from framesift.sources.bindings import photos

SF = "/root/testdata/sf0.001"


def half(v):
    return 0.5 if v is None else v


def plain_features(r):
    """Features of a row of the view (which has no lens, light or face boxes), worked out one by one."""
    n = r["face_count"]
    x = {
        "sharpness": r["sharpness"] / 100 if n else (r["sharpness"] / 100) ** 0.6, "exposureBalance": 1 - abs(r["exposure"] - 50) / 50, "exposureRaw": r["exposure"] / 100,
        "highlightClipping": r["highlight_clipping"] or 0, "shadowClipping": r["shadow_clipping"], "isoPenalty": 0, "apertureRaw": 0.5, "shutterSpeedRaw": 0.5,
        "focalLengthRaw": 0.5 if r["focal"] is None else min(1, math.log2(max(r["focal"], 10) / 10) / 8), "flashFired": 0, "deliberateSettings": 0, "compositionScore": half(r["composition_score"]), "leadingLines": 0.5,
        "symmetry": 0.5, "negativeSpace": 0.5, "lightHard": 0, "lightSoft": 0, "goldenHour": 0, "colorHarmony": 0.5, "noCameraMetadata": float(r["camera"] is None and r["focal"] is None),
    }
    if r["text_coverage"] is not None:
        x["textCoverage"] = r["text_coverage"]
    if n:
        x |= {"bestSmile": r["best_smile"], "allEyesOpen": float(r["all_eyes_open"]), "faceCount": n / 6, "knownFaceRatio": r["known_face_count"] / n, "strangerPenalty": (n - r["known_face_count"]) / n, "faceScore": 0, "ruleOfThirds": 0.5 if r["thirds"] is None else r["thirds"]}
        x |= dict.fromkeys(["headroom", "groupGenuineSmileRatio", "groupCatchlightRatio", "groupSkinToneNaturalRatio", "avgEngagement", "bokehQuality", "bodyCroppedAtEdge"], 0.5)
        x |= {"groupEyesOpenRatio": half(r["group_eyes_open"]), "groupSmileRatio": half(r["group_smile"]), "groupAwkwardRatio": half(r["group_awkward"]), "avgEyeContact": half(r["avg_eye_contact"])}
        x["subjectInFocus"] = 0.5 if r["subject_in_focus"] is None else float(r["subject_in_focus"])
    else:
        x["horizonLevel"] = 0.5 if r["horizon_tilt"] is None else max(0, 1 - abs(r["horizon_tilt"]) / 15)
    return x


class Plain:
    def __init__(self):
        self.w, self.b, self.n = dict(S.PRIOR), 0.0, 0
        self.seen = {k: (6, m, d * d * 5) for k, (m, d) in S.ORDINARY.items()}

    def norm(self, x):
        return {k: max(-3, min(3, (v - self.seen[k][1]) / max(0.15, math.sqrt(self.seen[k][2] / (self.seen[k][0] - 1))))) for k, v in x.items()}

    def learn(self, x, user, ai):
        for k, v in x.items():
            n, mean, m2 = self.seen[k]
            new = mean + (v - mean) / (n + 1)
            self.seen[k] = (n + 1, new, m2 + (v - mean) * (v - new))
        z = self.norm(x)
        err = 1 / (1 + math.exp(-(self.b + sum(self.w.get(k, 0) * v for k, v in z.items())))) - user
        lr = 0.35 / math.sqrt(self.n + 1) * (1.6 if ai != user else 1)
        for k, v in z.items():
            a = S.PRIOR.get(k, 0.0)
            w = self.w.get(k, 0) - lr * (err * v + 0.02 * (self.w.get(k, 0) - a))
            self.w[k] = min(4, a + 1.5, max(-4, a - 1.5, w))
        self.b -= lr * err
        self.n += 1


@pytest.fixture(scope="module")
def replayed(spark):
    view = {r["id"]: r.asDict() for r in photos(spark, SF).withColumn("key", S.context_key()).collect()}
    models = {}
    for d in sorted(advanced.corrections(spark, SF).collect(), key=lambda d: (d["ts"], d["id"])):
        if d["id"] in view:
            for key in (view[d["id"]]["key"], S.GLOBAL):
                models.setdefault(key, Plain()).learn(plain_features(view[d["id"]]), d["user_decision"], d["ai_decision"])
    return view, models


def test_features(spark, replayed):
    view, _ = replayed
    p = photos(spark, SF)
    for r in p.select("id", S.features(p.columns).alias("f")).collect():
        assert r["f"] == pytest.approx(plain_features(view[r["id"]]), abs=1e-12)


def test_replay(spark, replayed):
    _, models = replayed
    got = {r["context_key"]: r for r in S.replay(advanced.decisions(spark, SF)).collect()}
    assert got.keys() == models.keys() and len(got) > 3
    for k, m in models.items():
        assert got[k]["n"] == m.n and got[k]["bias"] == pytest.approx(m.b, abs=1e-9) and got[k]["weights"] == pytest.approx(m.w, abs=1e-9)


def test_rescore(spark, replayed):
    view, models = replayed
    none = Plain()
    got = registry.queries()["rescore"](spark, SF).collect()
    assert len(got) == len(view)
    for r in got:
        x = plain_features(view[r["id"]])
        m, g = models.get(view[r["id"]]["key"], none), models[S.GLOBAL]
        a, zc, zg = m.n / (m.n + 12), m.norm(x), g.norm(x)
        c = {k: a * m.w.get(k, 0) * zc[k] + (1 - a) * g.w.get(k, 0) * zg[k] for k in x}
        p = 1 / (1 + math.exp(-(a * m.b + (1 - a) * g.b + sum(c.values()))))
        prior = 1 / (1 + math.exp(-sum(S.PRIOR.get(k, 0) * z for k, z in zc.items())))
        assert abs(r["score"] - p * 100) <= 0.5 + 1e-6 and abs(r["personal_delta"] - (p - prior) * 100) <= 0.5 + 1e-6
        assert r["uncertainty"] == pytest.approx(max(1 - 2 * abs(p - 0.5), min(1, sum(map(abs, zc.values())) / len(zc) / 1.5)), abs=1e-9)
        assert [t["contribution"] for t in r["top"]] == pytest.approx(sorted(c.values(), key=abs, reverse=True)[:4], abs=1e-9)
        assert r["stage"] == ("cold" if m.n < 8 else "warming" if m.n < 40 else "trained")


def test_summary_and_shifts(spark, replayed):
    view, models = replayed
    for r in registry.queries()["model_summary"](spark, SF).collect():
        m = models[r["context_key"]]
        ranked = sorted((abs(w) for k, w in m.w.items() if k not in S.SILENT), reverse=True)[:4]
        assert r["n"] == m.n and [abs(t["weight"]) for t in r["top"]] == pytest.approx(ranked if m.n >= 8 else [], abs=1e-9)
    told = {r["id"]: r for r in S.shifts(advanced.decisions(spark, SF)).collect()}
    fresh = {}
    for d in sorted(advanced.corrections(spark, SF).collect(), key=lambda d: (d["ts"], d["id"])):
        if d["id"] not in view:
            continue
        m, x = fresh.setdefault(view[d["id"]]["key"], Plain()), plain_features(view[d["id"]])
        before = dict(m.w)
        m.learn(x, d["user_decision"], d["ai_decision"])
        most = max(abs(m.w.get(k, 0) - before.get(k, 0)) for k in x if k not in S.SILENT)
        assert (d["id"] in told) == (d["user_decision"] != d["ai_decision"] and most > 0.03)
        if d["id"] in told:
            k = told[d["id"]]["feature"]
            assert abs(m.w[k] - before.get(k, 0)) == pytest.approx(most, abs=1e-9)


def test_preferences():
    """A pair moves weights by its difference only: no bias, features alike stay, one decision in all."""
    m = S.Model()
    a, b = {"sharpness": 0.9, "exposureRaw": 0.5}, {"sharpness": 0.4, "exposureRaw": 0.5}
    m.prefer(a, [b, b])
    assert m.n == 1 and m.bias == 0 and m.weights["sharpness"] > 0.9 and "exposureRaw" not in m.weights
    m.prefer(a, [])
    assert m.n == 1
    broken = S.Model({"sharpness": math.nan}, math.inf, {}, -3).repaired()
    assert broken.weights == S.PRIOR and broken.bias == 0 and broken.n == 0 and broken.stats == S.seeds()


def test_stream_learns_as_the_replay(spark):
    got = {r["context_key"]: (r["n"], r["bias"]) for r in registry.queries()["stream_learner"](spark, SF).collect()}
    want = {r["context_key"]: (r["n"], r["bias"]) for r in registry.queries()["model_replay"](spark, SF).select("context_key", "n", F.col("bias")).collect()}
    assert got == want
