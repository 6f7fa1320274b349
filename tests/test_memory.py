"""Memories, choices, replayable batches and undo, against plain loops."""

import math
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from framesift.operators import memory as M
from framesift.operators import scoring as S
from framesift.operators import undo as U
from framesift.operators.similarity import shared_folder
from framesift.plans import learning
from framesift.sources.bindings import photos
from framesift.streaming import library as L
from framesift.streaming.decisions import DECISION, DecisionStore

SF = "/root/testdata/sf0.001"
SCHEMA = "id long, ts long, kept boolean, embedding array<float>, tags array<string>"


def plain_affinities(rows, most):
    """As it would be kept by hand: sums that begin anew with another length, and the first tags only."""
    sums, tags, totals, out = {True: ([], 0), False: ([], 0)}, {}, {True: 0, False: 0}, {}

    def cos(a, b):
        n = min(len(a), len(b))
        x, y = math.sqrt(sum(v * v for v in a[:n])), math.sqrt(sum(v * v for v in b[:n]))
        return sum(p * q for p, q in zip(a[:n], b[:n])) / (x * y) if x and y else 0

    for i, ts, kept, v, t in sorted(rows, key=lambda r: (r[1], r[0])):
        content = subject = None
        if v and min(sums[True][1], sums[False][1]) >= 5:
            content = min(1, max(0, 0.5 + 2 * (cos(v, sums[True][0]) - cos(v, sums[False][0]))))
        if t and min(totals.values()) >= 8:
            odds = [math.log((tags[x][0] + 1) / (totals[True] + 2) / ((tags[x][1] + 1) / (totals[False] + 2))) for x in t if x in tags and sum(tags[x]) >= 3]
            subject = 0.5 + 0.5 * math.tanh(sum(odds) / len(odds)) if odds else None
        out[i, ts] = (content, subject)
        if v:
            old, n = sums[kept]
            sums[kept] = ([a + b for a, b in zip(old, v)], n + 1) if len(old) == len(v) and n else (list(v), 1)
        if t:
            totals[kept] += 1
            for x in dict.fromkeys(t):
                if x in tags or len(tags) < most:
                    k = tags.setdefault(x, [0, 0])
                    k[not kept] += 1
    return out


def made(n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        ts = r.randrange(n)
        size = 3 if 150 <= ts % 400 < 240 else 6
        v = None if r.random() < 0.2 else [] if r.random() < 0.02 else [float(np.float32(r.gauss(0, 1))) for _ in range(size)]
        t = None if r.random() < 0.2 else [f"t{r.randrange(12 + i // 20)}" for _ in range(r.randrange(4))]
        rows.append((i % (n - 5), ts, r.random() < 0.4, v, t))
    return rows


@pytest.mark.parametrize(("most", "parts"), [(7, 9), (600, 4), (600, None)])
def test_affinities_are_those_of_the_time(spark, most, parts):
    rows = made(900, most)
    got = {(r["id"], r["ts"]): (r["content_affinity"], r["subject_affinity"]) for r in M.affinities(spark.createDataFrame(rows, SCHEMA).repartition(5), most, parts).collect()}
    want = plain_affinities(rows, most)
    assert got.keys() == want.keys() and sum(a is not None for a, _ in want.values()) > 100 and sum(b is not None for _, b in want.values()) > 100
    for k, (a, b) in want.items():
        assert got[k][0] == (None if a is None else pytest.approx(a, abs=1e-6)) and got[k][1] == (None if b is None else pytest.approx(b, abs=1e-9)), k


def test_no_task_holds_the_history(spark):
    """Each range of decisions is one of several, and passes on one row."""
    ordered = M.ranges(spark.createDataFrame(made(900, 3), SCHEMA).withColumn("embedding", F.col("embedding").cast("array<double>")).repartition(5), 6)
    sizes = [r["count"] for r in ordered.groupBy("part").count().collect()]
    known = M.known_tags(ordered)
    assert len(sizes) > 2 and max(sizes) < 900 and M.summed(ordered, known).count() == len(sizes)


def test_memory_of_all(spark):
    rows = made(500, 4)
    known, state = M.memory_now(spark.createDataFrame(rows, SCHEMA), 20)
    probe = [(10_000 + i, 10**9 + i, True, [0.1 * i, 1.0, -1.0, 0.5, 0.2, 0.3], ["t1", "t2", "zz"]) for i in range(3)]
    p = spark.createDataFrame(probe, SCHEMA)
    got = {r["id"]: (r["content_affinity"], r["subject_affinity"]) for r in M.affinities_now(p, known, state).collect()}
    for x in probe:
        want = plain_affinities([*rows, x], 20)[x[0], x[1]]
        assert got[x[0]] == pytest.approx(want, abs=1e-6)
    known, state = M.memory_now(spark.createDataFrame([], SCHEMA))
    assert state is None and M.affinities_now(p, known, state).filter("content_affinity is not null").count() == 0


def test_memory_replay_is_a_plain_replay(spark):
    rows = {r["id"]: r for r in learning.remembered(spark, SF).collect()}
    told = plain_affinities([(r["id"], r["ts"], r["kept"], list(r["embedding"]) if r["embedding"] else None, r["tags"]) for r in rows.values()], 600)
    view = {r["id"]: r for r in photos(spark, SF).select("id", S.context_key().alias("key"), S.features(photos(spark, SF).columns).alias("f")).collect()}
    models = {}
    for i, r in sorted(rows.items(), key=lambda x: (x[1]["ts"], x[0])):
        if i in view:
            x = dict(view[i]["f"])
            x |= {k: v for k, v in zip(("contentAffinity", "subjectAffinity"), told[i, r["ts"]]) if v is not None}
            for key in (view[i]["key"], S.GLOBAL):
                models.setdefault(key, S.Model()).learn(x, r["user_decision"], r["ai_decision"] != r["user_decision"])
    got = {r["context_key"]: r for r in learning.memory_replay(spark, SF).collect()}
    assert got.keys() == models.keys()
    for k, m in models.items():
        assert got[k]["n"] == m.n and got[k]["bias"] == pytest.approx(m.bias, abs=1e-7)
        assert got[k]["content_weight"] == pytest.approx(m.weights["contentAffinity"], abs=1e-6) and got[k]["subject_weight"] == pytest.approx(m.weights["subjectAffinity"], abs=1e-6)


def plain_models(log):
    """Decisions and whole choices folded one by one."""
    events = {}
    for r in log:
        events.setdefault((r["ts"], r["id"], r["rival"] is not None, r["context_key"]), []).append(r)
    models = {}
    for (_, _, choice, key), rows in sorted(events.items(), key=lambda x: x[0][:2] + (x[1][0]["pos"],)):
        for k in (key, S.GLOBAL):
            m = models.setdefault(k, S.Model())
            if choice:
                m.prefer(dict(rows[0]["features"]), [dict(r["rival"]) for r in sorted(rows, key=lambda r: r["pos"])])
            else:
                m.learn(dict(rows[0]["features"]), rows[0]["user_decision"], rows[0]["ai_decision"] != rows[0]["user_decision"])
    return models


def test_preferences_in_one_log(spark):
    log = learning.event_log(spark, SF).collect()
    assert sum(r["rival"] is not None for r in log) > 50 and sum(r["rival"] is None for r in log) > 50
    want = plain_models(log)
    got = {r["context_key"]: r for r in learning.preference_replay(spark, SF).collect()}
    assert got.keys() == want.keys()
    for k, m in want.items():
        assert got[k]["n"] == m.n and got[k]["bias"] == pytest.approx(m.bias, abs=1e-8) and got[k]["sharpness"] == pytest.approx(m.weights["sharpness"], abs=1e-8)
    stream = {r["context_key"]: (r["n"], r["bias"]) for r in learning.preference_stream(spark, SF).collect()}
    assert stream == {k: (r["n"], r["bias"]) for k, r in got.items()}


def test_a_choice_teaches_by_its_difference_only(spark):
    known = spark.createDataFrame([(1, "c", {"sharpness": 0.9, "exposureRaw": 0.5}), (2, "d", {"sharpness": 0.4, "exposureRaw": 0.5}), (3, "c", {"sharpness": 0.3, "exposureRaw": 0.5})], "id long, context_key string, features map<string,double>")
    chosen = spark.createDataFrame([(1, 2, 1, 10), (1, 3, 2, 10), (1, 99, 3, 10), (98, 1, 1, 11)], "winner_id long, loser_id long, pos int, ts long")
    log = S.choice_log(chosen, known)
    assert sorted((r["id"], r["pos"], r["last"], r["context_key"]) for r in log.collect()) == [(1, 1, False, "c"), (1, 2, True, "c")]
    m = {r["context_key"]: r for r in S.replay(log).collect()}
    assert set(m) == {"c", S.GLOBAL} and m["c"]["n"] == 1 and m["c"]["bias"] == 0 and m["c"]["weights"]["sharpness"] > 0.9 and "exposureRaw" not in m["c"]["weights"]


def store_of(spark, at, scores):
    return DecisionStore(spark, f"{at}/store", scores)


def told(store):
    key = lambda r: tuple(map(str, r))
    return [sorted(map(tuple, df.collect()), key=key) for df in (store.snapshot(), store.log(), store.history())] + [store.cursor()]


@pytest.fixture()
def decided(spark):
    r = random.Random(11)
    rows = [(r.randrange(4), r.randrange(60), r.choice(["selected", "rejected", "candidate", "review"]), 1000 + r.randrange(500), i) for i in range(400)]
    scores = spark.createDataFrame([(i, "pending", i * 2 if i % 5 else None) for i in range(55)], "photo_id long, status string, ai_score long")
    return rows, scores


def test_a_batch_that_dies_is_run_again(spark, decided, monkeypatch):
    rows, scores = decided
    at = f"{shared_folder(spark)}/mu-{uuid.uuid4().hex}"
    for i in range(4):
        spark.createDataFrame(rows[i * 100 : i * 100 + 100], DECISION).coalesce(1).write.mode("append").parquet(f"{at}/in")
    plain = store_of(spark, f"{at}/plain", scores)
    # in the order in which the stream takes its files
    stream = lambda: spark.readStream.schema(DECISION).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    plain.run(stream(), f"{at}/plain-checkpoint").awaitTermination()
    assert len(plain.marks()) == 4
    # killed between the writes, at another one each time
    for dies in ("delta", "log", "history", "mark"):
        store = store_of(spark, f"{at}/{dies}", scores)
        write, left = store._write, [2]

        def half(df, name, batch, write=write, dies=dies, left=left):
            if name == dies and batch == 1 and left[0]:
                left[0] -= 1
                if name != "mark":
                    write(df.limit(3), name, batch)
                raise OSError("lost")
            write(df, name, batch)

        monkeypatch.setattr(store, "_write", half)
        for _ in range(2):
            with pytest.raises(Exception):  # noqa: B017
                store.run(stream(), f"{at}/{dies}-checkpoint").awaitTermination()
        assert [b for b, _ in store.marks()] == [0]
        store.run(stream(), f"{at}/{dies}-checkpoint").awaitTermination()
        assert told(store) == told(plain)
    # a batch with a mark changes nothing when it comes again, whatever it holds
    before = told(plain)
    plain.apply(spark.createDataFrame([(1, 1, "selected", 9999, 9999)], DECISION), 2)
    assert told(plain) == before


def test_store_is_what_one_batch_gives(spark, decided):
    rows, scores = decided
    at = f"{shared_folder(spark)}/mu-{uuid.uuid4().hex}"
    rows = sorted(rows, key=lambda r: (r[3], r[4]))
    many, one = store_of(spark, f"{at}/many", scores), store_of(spark, f"{at}/one", scores)
    for b in range(5):
        many.apply(spark.createDataFrame(rows[b * 80 : b * 80 + 80], DECISION), b)
        if b in (1, 3):
            many.compact()
    one.apply(spark.createDataFrame(rows, DECISION), 0)
    assert told(many) == told(one)
    # by hand
    status, last, log = dict((i, "pending") for i in range(55)), {}, []
    for user, photo, new, ts, seq in rows:
        if new in ("selected", "rejected") and photo < 55 and photo % 5:
            log.append((photo, photo * 2 >= 65, new == "selected", ts, seq))
        if status.get(photo) not in (None, new):
            last.setdefault(user, []).append((user, photo, status[photo], new, ts, seq))
        status[photo] = new
    snapshot, learned, history, cursor = told(many)
    assert {r[0]: r[1] for r in snapshot} == {p: status[p] for p in {r[1] for r in rows}}
    assert sorted(learned) == sorted(log) and sorted(history) == sorted(x for v in last.values() for x in v[-10:]) and cursor == max(r[3] for r in rows)


def test_late_rows_do_not_move_the_cursor_back(spark, decided):
    _, scores = decided
    store = store_of(spark, f"{shared_folder(spark)}/mu-{uuid.uuid4().hex}", scores)
    store.apply(spark.createDataFrame([(1, 7, "selected", 500, 1)], DECISION), 0)
    store.apply(spark.createDataFrame([(1, 7, "rejected", 400, 2), (1, 8, "rejected", 300, 3)], DECISION), 1)
    store.apply(spark.createDataFrame([], DECISION), 2)
    assert store.cursor() == 500 and {r["photo_id"]: r["status"] for r in store.snapshot().collect()} == {7: "selected", 8: "rejected"}


def plain_undo(log):
    out = []
    for user in {r[0] for r in log}:
        single, batch, field = [], [], []
        for _, event, ts, _, kind in sorted((r for r in log if r[0] == user), key=lambda r: (r[2], r[3])):
            if kind == "single":
                single = [*single, (event, ts)][-10:]
            elif kind == "batch":
                batch = [*batch, (event, ts)][-5:]
            elif kind == "field":
                field = [*field, (event, ts)][-5:]
            else:
                a, b, c = (x[-1][1] if x else -1 for x in (single, batch, field))
                stack, name = (field, "field") if c > a and c > b else (batch, "batch") if b > a else (single, "single")
                out.append((user, event, ts, *((stack.pop()[0], name) if stack else (None, None))))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_undo_is_a_state_machine(spark, seed):
    r = random.Random(seed)
    log = [(r.randrange(5), i, r.randrange(300), i, r.choice(["single", "single", "batch", "field", "undo", "undo"] if seed < 2 else ["single", "batch", "field", "undo"])) for i in range(500)]
    schema = "user_id long, event_id long, ts long, seq long, kind string"
    df = spark.createDataFrame(log, schema)
    got = U.undone(df).collect()
    want = plain_undo(log)
    assert sorted(map(tuple, got), key=str) == want and {x[4] for x in want} >= {"single", "batch", "field"} and any(x[3] is None for x in want)
    at = f"{shared_folder(spark)}/undo-{uuid.uuid4().hex}"
    ordered = sorted(log, key=lambda x: (x[2], x[3]))
    for i in range(3):
        spark.createDataFrame(ordered[i * 170 : i * 170 + 170], schema).coalesce(1).write.mode("append").parquet(f"{at}/in{i}")
    name = f"u{uuid.uuid4().hex}"
    for i in range(3):  # a run for each part: state is carried on in the checkpoint
        spark.read.schema(schema).parquet(f"{at}/in{i}").write.mode("append").parquet(f"{at}/in")
        U.undone_stream(spark.readStream.schema(schema).parquet(f"{at}/in")).writeStream.outputMode("append").format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.read.schema(U.UNDONE).parquet(f"{at}/out").collect()), key=str) == want and name


def test_values_after_undo(spark):
    log, changes = learning.undo_log(spark, SF)
    events, own = sorted((tuple(r) for r in log.select("user_id", "event_id", "ts", "seq", "kind").collect()), key=lambda r: (r[2], r[3])), {}
    for c in changes.collect():
        own.setdefault(c["event_id"], []).append(c)
    undone = {u[1]: u[3] for u in plain_undo(events)}
    values = {}
    for _, event, _, _, kind in events:
        for c in own.get(undone[event] if kind == "undo" else event, []):
            values[c["photo_id"], c["field"]] = c["previous"] if kind == "undo" else c["value"]
    got = {(r["photo_id"], r["field"]): r["value"] for r in learning.undo_values(spark, SF).collect()}
    assert got == values and len(got) > 50


def test_photo_stream_is_bounded(spark):
    """Files a trigger bound a batch."""
    at = f"{shared_folder(spark)}/photos-{uuid.uuid4().hex}"
    photos(spark, SF, "id", "captured_at").repartition(6).write.parquet(at)
    sizes = []
    q = L.photo_stream(spark, at, "id long, captured_at long", files=2).writeStream.foreachBatch(lambda b, i: sizes.append(len(b.inputFiles()) or b.count())).option("checkpointLocation", f"{at}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(sizes) == 3


def test_maps_of_features_are_not_broadcast(spark):
    """A small file may hold many maps: none of the joins of the log of decisions and choices is broadcast for its size, and the log is made once for both kinds of models."""
    from framesift.operators import scoring as S
    from framesift.plans.learning import event_log

    log = S.replay(event_log(spark, "/root/testdata/sf0.001"))._jdf.queryExecution()
    plan = log.executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan and plan.count("Scan parquet") <= 10
