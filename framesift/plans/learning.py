"""Queries of the learner's memories, of choices, and of decisions as batches that can be replayed and undone."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import groups as G
from ..operators import memory as M
from ..operators import scoring as S
from ..operators import undo as U
from ..operators.similarity import checkpointed, shared_folder
from ..sources.bindings import COLUMNS, PHOTOS_SQL, corrections, photos, table
from .library import query

AFFINITIES = """+ d as (
  select l.doc_id as id, l.quality = 1 as kept, case when (l.doc_id // 40) % 3 = 1 then e.embedding[1:32] else e.embedding end::double[] as e, p.tags
  from labels l left join embeddings e on e.vec_id = l.doc_id left join photos p on p.id = l.doc_id),
w as (select *, len(e) as dim, lag(len(e)) over (partition by kept order by id) as was from d where e is not null),
v as (select *, sum(coalesce((dim <> was)::int, 0)) over (partition by kept order by id) as run from w),
a as (select v.id, s.kept as side, max(u.id) as last from v cross join (values (true), (false)) s(kept) left join v u on u.kept = s.kept and u.id < v.id group by 1, 2),
r as (select a.*, v.run from a join v on v.id = a.last),
m as (select r.id, r.side, g.i, sum(u.e[g.i]) as x, count(*) as n from r join v u on u.kept = r.side and u.run = r.run and u.id <= r.last, lateral (select unnest(range(1, u.dim + 1)) as i) g group by 1, 2, 3),
c as (select id, side, list(x order by i) as s, max(n) as n from m group by 1, 2),
k as (
  select v.id, max(list_cosine_similarity(v.e[1:least(v.dim, len(c.s))], c.s[1:least(v.dim, len(c.s))])) filter (c.side) as near,
    max(list_cosine_similarity(v.e[1:least(v.dim, len(c.s))], c.s[1:least(v.dim, len(c.s))])) filter (not c.side) as far
  from v join c on c.id = v.id where c.n >= 5 group by 1 having count(*) = 2),
t as (select id, kept, tags, unnest(list_distinct(tags)) as tag from d where len(tags) > 0),
tot as (select d.id, count(*) filter (u.kept) as k, count(*) filter (not u.kept) as r from d join d u on u.id < d.id and len(u.tags) > 0 group by 1),
own as (select id, unnest(tags) as tag from d),
o as (select own.id, own.tag, row_number() over () as line, count(*) filter (t.kept) as k, count(*) filter (not t.kept) as r from (select *, row_number() over () as line from own) own join t on t.tag = own.tag and t.id < own.id group by own.id, own.tag, own.line),
f as (select o.id, avg(ln(((o.k + 1) / (tot.k + 2)) / ((o.r + 1) / (tot.r + 2)))) as odds from o join tot on tot.id = o.id where o.k + o.r >= 3 and tot.k >= 8 and tot.r >= 8 group by 1)
select d.id, case when k.id is not null then round(greatest(0::double, least(1::double, 0.5::double + 2 * (k.near - k.far))), 6) end as content_affinity, round(0.5::double + 0.5::double * tanh(f.odds), 6) as subject_affinity
from d left join k on k.id = d.id left join f on f.id = d.id"""


def remembered(s, d):
    """Decisions with the photo's vector (now and then of another model, and shorter) and tags."""
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    c = corrections(s, d).join(e, "id", "left").join(photos(s, d, "id", "tags"), "id", "left")
    short = F.floor(F.col("id") / 40) % 3 == 1
    return c.select("id", "ts", "ai_decision", "user_decision", F.col("user_decision").alias("kept"), F.when(short, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")).alias("embedding"), "tags")


@query("memory_affinities", AFFINITIES)
def memory_affinities(s, d):
    """How near each decision's photo was to what had been kept and rejected before it."""
    return M.affinities(remembered(s, d)).select("id", F.round("content_affinity", 6).alias("content_affinity"), F.round("subject_affinity", 6).alias("subject_affinity"))


def remembering_decisions(s, d):
    """Decisions with all features, those of memory as they were."""
    told = M.affinities(remembered(s, d)).select("id", "ts", "ai_decision", "user_decision", "content_affinity", "subject_affinity")
    p = told.join(photos(s, d), "id")
    return p.select("id", "ts", "ai_decision", "user_decision", S.context_key().alias("context_key"), S.features(p.columns).alias("features"))


@query("memory_replay")
def memory_replay(s, d):
    """The learner with its memories: models whose features include the affinities of the time."""
    w = lambda k: F.round(F.col("weights")[k], 9)
    return S.replay(remembering_decisions(s, d)).select("context_key", "n", F.round("bias", 9).alias("bias"), w("contentAffinity").alias("content_weight"), w("subjectAffinity").alias("subject_weight"))


@query("memory_rescore")
def memory_rescore(s, d):
    """Scores of all photos under the models and memories after all decisions, thresholds from the scores, and the status that follows."""
    from ..operators import aggregates as A
    from ..operators import filters as P

    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    p = photos(s, d)
    known, state = M.memory_now(remembered(s, d))
    p = M.affinities_now(p.join(e, "id", "left"), known, state).drop("embedding")
    models = checkpointed(S.replay(remembering_decisions(s, d)))
    scored = checkpointed(S.predict(p, models).select("id", "score"))
    at = A.thresholds(scored, "score").first()
    j = p.drop("content_affinity", "subject_affinity").join(scored, "id")
    return j.select("id", "score", P.decide_status("score", at["select_at"], at["reject_at"]).alias("status"))


def choices(s, d):
    """Every series as a choice of its best frame against the others, at the time of its last frame's number. Written once; no side is small, whatever the size of the file says."""
    p = photos(s, d)
    best = G.best_frames(p).select("group_id", F.col("keep_id").alias("winner_id"))
    rest = checkpointed(G.series(p).select("group_id", F.col("id").alias("loser_id")).join(best.hint("merge"), "group_id").filter("loser_id <> winner_id"))
    ends = rest.groupBy("group_id").agg(F.max(F.greatest("loser_id", "winner_id")).alias("ts"))
    place = F.row_number().over(Window.partitionBy("group_id").orderBy("loser_id"))
    return rest.join(ends.hint("merge"), "group_id").select("winner_id", "loser_id", place.alias("pos"), "ts")


def event_log(s, d):
    """Decisions and choices in one log. Features are made of those photos only that are in one of them."""
    made, chosen = corrections(s, d), checkpointed(choices(s, d))
    ids = made.select("id").unionAll(chosen.select("winner_id")).unionAll(chosen.select("loser_id")).distinct()
    e = checkpointed(table(s, d, "events").join(ids.withColumnRenamed("id", "event_id").hint("merge"), "event_id", "left_semi"))
    p = e.select(*[F.expr(x[0]).alias(n) for n, x in COLUMNS.items()])
    known = p.select("id", S.context_key().alias("context_key"), S.features(p.columns).alias("features"))
    scored = p.select("id", "ai_score", S.context_key().alias("context_key"), S.features(p.columns).alias("features"))
    decided = made.join(scored.hint("merge"), "id").withColumn("ai_decision", S.ai_decision())
    return S.as_log(decided).unionByName(S.choice_log(chosen, known))


@query("preference_replay")
def preference_replay(s, d):
    """Models by decisions and by choices within series, in one order."""
    return S.replay(event_log(s, d)).select("context_key", "n", F.round("bias", 9).alias("bias"), F.round(F.col("weights")["sharpness"], 9).alias("sharpness"), F.size("weights").alias("n_weights"))


@query("preference_stream")
def preference_stream(s, d):
    """The same as a stream over a log in files."""
    from ..streaming.library import in_slices, learner

    at = f"{shared_folder(s)}/choices-{uuid.uuid4().hex}"
    q = learner(in_slices(event_log(s, d), at)).writeStream.outputMode("update").option("checkpointLocation", f"{at}/state").foreachBatch(lambda b, i: b.write.mode("append").parquet(f"{at}/out")).trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.parquet(f"{at}/out").groupBy("context_key").agg(F.max("n").alias("n"), F.round(F.max_by("bias", "n"), 9).alias("bias"))


MADE = "select event_id as seq, user_id, (event_id * 7) % 997 + user_id * 1000 as photo_id, case event_id % 5 when 0 then 'rejected' when 1 then 'candidate' when 2 then 'review' else 'selected' end as status, {ms} as ts, case when event_id % 3 > 0 then event_id % 101 end as ai_score, case event_id % 4 when 0 then 'pending' when 1 then 'review' when 2 then 'selected' else 'rejected' end as was from {events}"
STORE = f"""+ e as ({MADE.format(ms="epoch_us(ts) // 1000", events="events")}),
i as (select photo_id, arg_min_null(was, seq) as was, arg_min_null(ai_score, seq) as ai_score from e group by 1)
select i.photo_id, arg_max(e.status, {{'a': e.ts, 'b': e.seq}}) as status, count(*) filter (e.status in ('selected', 'rejected') and i.ai_score is not null) as learned, count(*) filter (e.status = 'selected' and i.ai_score < 65) as surprises
from i join e using (photo_id) group by 1"""


def made_decisions(s, d):
    """Decisions of many users on photos, and the photos as they were imported."""
    table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).createOrReplaceTempView("made_events")
    e = s.sql(MADE.format(ms="unix_millis(ts)", events="made_events"))
    photo = e.groupBy("photo_id").agg(F.min_by("was", "seq").alias("status"), F.min_by("ai_score", "seq").alias("ai_score"))
    return e.select("user_id", "photo_id", "status", "ts", "seq"), photo


@query("decision_batches", STORE)
def decision_batches(s, d):
    """All decisions through the store in micro-batches: status of each photo and what was learned from it."""
    from ..streaming.decisions import DECISION, DecisionStore

    at = f"{shared_folder(s)}/decisions-{uuid.uuid4().hex}"
    e, photo = made_decisions(s, d)
    e.repartitionByRange(4, "seq").write.parquet(f"{at}/in")
    store = DecisionStore(s, f"{at}/store", photo)
    stream = s.readStream.schema(DECISION).option("maxFilesPerTrigger", 2).parquet(f"{at}/in")
    store.run(stream, f"{at}/checkpoint").awaitTermination()
    store.compact()
    n = store.log().groupBy("photo_id").agg(F.count(F.lit(1)).alias("learned"), F.count_if(F.col("user_decision") & ~F.col("ai_decision")).alias("surprises"))
    return store.snapshot().select("photo_id", "status").join(n, "photo_id", "left").select("photo_id", "status", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("learned", "surprises")])


def undo_log(s, d):
    """A log of pushes and undos of each user, and the changes of each push: one photo, or several for a batch."""
    e = table(s, d, "events").select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("seq"))
    kind = F.expr("case event_id % 7 when 0 then 'undo' when 3 then 'undo' when 1 then 'batch' when 2 then 'field' else 'single' end")
    log = e.withColumn("kind", kind)
    n = F.when(F.col("kind") == "single", 1).otherwise(3)
    c = log.filter("kind <> 'undo'").withColumn("k", F.explode(F.sequence(F.lit(1), n)))
    value = lambda x: F.concat(F.lit("v"), (x % 5).cast("string"))
    c = c.select("event_id", (F.col("user_id") * 100 + (F.col("event_id") + F.col("k")) % 10).alias("photo_id"), F.when(F.col("kind") == "field", "rating").otherwise("status").alias("field"), value(F.col("event_id")).alias("previous"), value(F.col("event_id") + F.col("k")).alias("value"))
    return log, c


@query("undo_replay")
def undo_replay(s, d):
    """What each undo undoes."""
    return U.undone(undo_log(s, d)[0])


@query("undo_values")
def undo_values(s, d):
    """Every photo's fields after all that was done and undone."""
    log, changes = undo_log(s, d)
    return U.values_after(log, changes, checkpointed(U.undone(log)))
