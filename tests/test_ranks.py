"""Places by ranges of an order."""

from framesift.operators.ranks import down, ranked, ranked_within


def test_places(spark):
    rows = [(i, ["a", None, "b"][i % 3] if i < 40 else "a", None if i % 7 == 0 else (i * 37) % 11) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, k string, v int").repartition(7)
    want = sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
    assert [r["id"] for r in sorted(ranked(df, [down("v"), "id"]).collect(), key=lambda r: r["place"])] == [r[0] for r in want]
    got = {}
    for r in ranked_within(df, "k", [down("v"), "id"]).collect():
        got.setdefault(r["k"], {})[r["place"]] = r["id"]
    for k, places in got.items():
        own = [r[0] for r in want if r[1] == k]
        assert [places[i + 1] for i in range(len(own))] == own and len(places) == len(own)
    assert set(got) == {"a", "b", None} and ranked(df.limit(0), ["id"]).count() == 0
