"""Queries of similarity, clustering, scoring, files, pixels and streams. Where SQL can say the same it is given."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cluster as C
from ..operators import faces as X
from ..operators import joins as J
from ..operators import pixels as K
from ..operators import scoring as S
from ..operators import similarity as M
from ..operators.filters import ABSTRACT_TAGS
from ..operators.similarity import checkpointed, shared_folder
from ..sources import files
from ..sources.bindings import PHOTOS_SQL, corrections, photos, table
from .library import SUBJECT_TAG, query

#: A 62-bit hash, from bounded products, in which frames of one user are near each other, and a few bits that move.
BASE = "((user_id * 1103515245 + 12345) % 2147483647) * 2147483648 + (user_id * 1284865837 + (user_id % 7) * 40503) % 2147483647"
MOVES = "((event_id * 37) % 61) * 16777216 + (event_id * 11) % 13"
SPARK_HASH = f"({BASE}) ^ ({MOVES})"
DUCK_HASH = f"xor({BASE}, {MOVES})"
HASHES_SQL = f"hashes as (select event_id as id, {DUCK_HASH} as h from events)"
PAIRS_SQL = "+ one as (select h, min(id) as id from hashes group by 1) select least(x.id, y.id) as a, greatest(x.id, y.id) as b, bit_count(xor(x.h, y.h))::int as distance from one x join one y on x.h < y.h and bit_count(xor(x.h, y.h)) <= 6 union all select o.id, p.id, 0 from hashes p join one o using (h) where p.id <> o.id"
COMPONENTS_SQL = "+ p as (select x.id as a, y.id as b from hashes x join hashes y on x.id <> y.id and bit_count(xor(x.h, y.h)) <= 4), r as (select id as a, id as b from hashes union select r.a, p.b from r join p on r.b = p.a) select a as node, min(b) as root from r where a in (select a from p) group by 1"
RECURSIVE_SQL = HASHES_SQL.replace("hashes as", "recursive hashes as")


def hashes(s, d):
    return table(s, d, "events").select(F.col("event_id").alias("id"), F.expr(SPARK_HASH).alias("h"))


@query("hamming_pairs", PAIRS_SQL, HASHES_SQL)
def hamming_pairs(s, d):
    """Pairs among all events: representatives (the first id of each hash) within 6 bits, and each other id with its representative at distance 0."""
    return M.hamming_pairs(hashes(s, d), 6)


@query("hamming_components", COMPONENTS_SQL, RECURSIVE_SQL)
def hamming_components(s, d):
    return M.hamming_components(hashes(s, d), 4)


@query("cosine_pairs", "+ x as (select vec_id, embedding::double[] as e from v) select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(a.e, b.e), 6) as cosine from x a join x b on a.vec_id < b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.35", "v as (select * from embeddings)")
def cosine_pairs(s, d):
    return M.cosine_pairs(table(s, d, "embeddings"), 0.35).select("a", "b", F.round("cosine", 6).alias("cosine"))


@query("best_match", "+ f as (select vec_id as face_id, embedding::double[] as e from embeddings), u as (select label, unnest(embedding::double[]) as x, generate_subscripts(embedding, 1) as i from embeddings), m as (select label, i, avg(x) as x from u group by 1, 2), p as (select label as person_id, list(x order by i) as r from m group by 1), j as (select face_id, person_id, list_cosine_similarity(e, r) as s from f, p), b as (select *, row_number() over (partition by face_id order by s desc, person_id desc) as k from j) select face_id, person_id, round(s, 6) as similarity from b where k = 1 and s >= 0.2", "z as (select 1)")
def best_match(s, d):
    """Every face against all persons; a person's reference is the mean of its vectors."""
    e = table(s, d, "embeddings")
    mean = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    p = mean.groupBy(F.col("label").alias("person_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda v: v["x"]).alias("embedding"))
    return M.best_match(e.withColumnRenamed("vec_id", "face_id"), p, 0.2).withColumn("similarity", F.round("similarity", 6))


@query("face_clusters")
def face_clusters(s, d):
    return C.face_clusters(table(s, d, "embeddings"), 0.35)


def frames(s, d):
    """Events as frames with what they show: vectors of faces or of the picture, or its composition and colours, or nothing."""
    turn = lambda k: F.array(F.cos(k * 0.9), F.sin(k * 0.9))
    e, u = F.col("event_id"), F.col("user_id")
    return table(s, d, "events").select(
        e.alias("id"), F.expr(SPARK_HASH).alias("h"), F.when(e % 10 != 0, F.unix_millis(F.col("ts").cast("timestamp"))).alias("captured_at"),
        F.when(e % 4 == 1, F.array(turn(u % 3 + e % 2))).alias("faces"), F.when(e % 4 == 2, turn(u % 4)).alias("image"),
        F.when(e % 6 != 0, (e % 11) / 10).alias("composition_score"), ((e * 3) % 7 / 6).alias("color_harmony"), (e % 4).cast("int").alias("face_count"),
    )


@query("near_duplicate_series")
def near_duplicate_series(s, d):
    return C.near_duplicate_series(frames(s, d))


@query("proximity_clusters")
def proximity_clusters(s, d):
    return C.proximity_clusters(photos(s, d, "id", "lat", "lon"))


@query("locations")
def locations(s, d):
    """Places with their photos, centroid, the photo nearest to it, and how far from home."""
    from ..functions.expr import haversine_km

    p = photos(s, d, "id", "lat", "lon", "captured_at")
    c = checkpointed(C.proximity_clusters(p)).join(p, "id")
    g = c.groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.avg("lat").alias("clat"), F.avg("lon").alias("clon"), F.min("captured_at").alias("start_ms"), F.max("captured_at").alias("end_ms"))
    near = c.join(g.select("place", "clat", "clon"), "place").groupBy("place").agg(F.min_by("id", F.struct(haversine_km("clat", "clon", "lat", "lon"), "id")).alias("anchor_id"))
    home = J.home_anchor(p.filter("lat is not null"))
    return g.join(near, "place").crossJoin(F.broadcast(home)).select("place", "n", "anchor_id", "start_ms", "end_ms", F.round(haversine_km("home_lat", "home_lon", "clat", "clon"), 6).alias("home_km"))


def decisions(s, d):
    """The view's features and context with the decisions on them."""
    p = photos(s, d)
    return corrections(s, d).join(p.select("id", S.context_key().alias("context_key"), S.features(p.columns).alias("features")), "id")


@query("model_replay")
def model_replay(s, d):
    return S.replay(decisions(s, d)).select("context_key", "n", F.round("bias", 9).alias("bias"), F.size("weights").alias("n_weights"))


@query("rescore")
def rescore(s, d):
    return S.predict(photos(s, d), checkpointed(S.replay(decisions(s, d))))


@query("preference_shifts")
def preference_shifts(s, d):
    """What each correction changed most."""
    return S.shifts(decisions(s, d)).select("id", "context_key", "feature", F.round("weight", 9).alias("weight"))


@query("model_summary")
def model_summary(s, d):
    return S.model_summary(S.replay(decisions(s, d)))


@query("counterfactual", "+ f as (select id, ai_score, unnest([{'feature': 'sharpness', 'contribution': (sharpness - 50) / 40.0::double}, {'feature': 'exposure', 'contribution': -abs(exposure - 50) / 30.0::double}, {'feature': 'smile', 'contribution': best_smile - 0.6::double}]) as f from photos), z as (select id, ai_score, f.feature as feature, f.contribution as c, ln(greatest(0.001::double, least(0.999::double, ai_score / 100)) / (1 - greatest(0.001::double, least(0.999::double, ai_score / 100)))) as z from f), a as (select *, floor(100 / (1 + exp(-(z - c))) + 0.5)::bigint as after from z where c < 0 and ai_score < 65), v as (select *, case when after >= 65 then 'selected' when ai_score <= 35 and after > 35 then 'rejected' end as verdict from a), r as (select *, row_number() over (partition by id order by abs(c), feature, verdict, after) as k from v where verdict is not null) select id, feature, verdict from r where k = 1")
def counterfactual(s, d):
    f = lambda n, c: F.struct(F.lit(n).alias("feature"), c.alias("contribution"))
    factors = F.array(f("sharpness", (F.col("sharpness") - 50) / 40.0), f("exposure", -F.abs(F.col("exposure") - 50) / 30.0), f("smile", F.col("best_smile") - 0.6))
    p = photos(s, d, "id", "ai_score", "sharpness", "exposure", "best_smile").withColumn("factors", factors)
    return p.withColumn("c", S.counterfactual("ai_score", "factors")).filter("c is not null").select("id", "c.feature", "c.verdict")


NAMES = "list_sort(persons)"
LABEL = f"case when len(persons) > 0 then case len(persons) when 1 then persons[1] else array_to_string(({NAMES})[:-2], ', ') || ' și ' || ({NAMES})[-1] end || case when stranger_count > 0 then ' și alții' else '' end when face_count > 0 then 'Necunoscuți' when {SUBJECT_TAG} then upper(left(list_filter(tags, lambda t: lower(t) not in ({', '.join(f"'{t}'" for t in ABSTRACT_TAGS)}))[1], 1)) || substr(list_filter(tags, lambda t: lower(t) not in ({', '.join(f"'{t}'" for t in ABSTRACT_TAGS)}))[1], 2) when scene_type = 'landscape' then 'Peisaje' else 'Detalii' end"


@query("folder_labels", f"select id, {LABEL} as folder from photos where status = 'selected'")
def folder_labels(s, d):
    return files.export_plan(photos(s, d)).drop("file_name")


XMP_PARTS = [x.replace("'", "''") for x in files.XMP.split("%s")]
FACTORS = "case when id % 5 = 0 then [] when id % 2 = 0 then ['Sharp <1> (+)'] else ['Sharp <1> (+)', 'Eyes & light (-)'] end"
SIDECARS_SQL = f"""+ m as (select *, {FACTORS} as factors, case when user_id % 3 = 0 then 'C&' || user_id % 10 end as client, case when user_id % 4 = 0 then 'E' || user_id % 10 end as event, case when user_id % 5 = 1 then 'L' || user_id % 10 end as location, case when id % 6 = 0 then 'On the "way"' end as caption,
  case when id % 7 = 0 then [] else ['k' || id % 3, 'tag1'] end as keywords from photos where status <> 'pending'),
u as (select group_id as g, list_distinct(flatten(list(persons))) as everyone from photos where coalesce(group_id, '') <> '' group by 1),
k as (select m.*, list_concat(list_concat(list_concat(keywords, list_concat(list_sort(coalesce(u.everyone, persons)), tags)), list_concat(['IA ' || greatest(0, least(90, ai_score // 10 * 10)) || '-' || greatest(0, least(90, ai_score // 10 * 10)) + 9], case when coalesce(group_id, '') <> '' then ['Serie ' || group_id] else [] end)), list_filter(['Client: ' || client, 'Event: ' || event, 'Location: ' || location], lambda x: x is not null)) as words from m left join u on m.group_id = u.g),
w as (select *, list_filter(words, lambda x, i: list_position(words, x) = i) as once from k),
e as (select *, replace(replace(replace(replace(client, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') as x_client from w)
select id, '{XMP_PARTS[0]}' || case when status = 'rejected' then -1 when rating > 0 then rating when status = 'selected' then 5 when status = 'candidate' then 3 else 0 end
 || '{XMP_PARTS[1]}' || case status when 'selected' then 'Green' when 'candidate' then 'Blue' when 'rejected' then 'Red' else 'Yellow' end
 || '{XMP_PARTS[2]}' || coalesce(' fs:AIScore="' || ai_score || '"', '') || case when coalesce(group_id, '') <> '' then ' fs:SeriesId="' || group_id || '"' else '' end || coalesce(' fs:Client="' || x_client || '"', '') || '{XMP_PARTS[3]}'
 || '<dc:subject><rdf:Bag>' || array_to_string(list_transform(once, lambda w: '<rdf:li>' || replace(w, '&', '&amp;') || '</rdf:li>'), '') || '</rdf:Bag></dc:subject>'
 || coalesce('<dc:description><rdf:Alt><rdf:li xml:lang="x-default">' || replace(caption, '"', '&quot;') || '</rdf:li></rdf:Alt></dc:description>', '')
 || case when len(factors) > 0 then '<fs:AIFactors><rdf:Bag>' || array_to_string(list_transform(factors, lambda w: '<rdf:li>' || replace(replace(replace(w, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</rdf:li>'), '') || '</rdf:Bag></fs:AIFactors>' else '' end
 || coalesce('<Iptc4xmpCore:Location>' || location || '</Iptc4xmpCore:Location>', '') || coalesce('<Iptc4xmpExt:Event><rdf:Alt><rdf:li xml:lang="x-default">' || event || '</rdf:li></rdf:Alt></Iptc4xmpExt:Event>', '') || '{XMP_PARTS[4]}' as xmp from e"""


@query("sidecars", SIDECARS_SQL)
def sidecars(s, d):
    """All decided photos, rejected, candidates and those to be reviewed too, with what projects, series and users add."""
    p = photos(s, d)
    made = lambda n, k, r, lead: F.when(F.col("user_id") % k == r, F.concat(F.lit(lead), (F.col("user_id") % 10).cast("string"))).alias(n)
    sharp, eyes = F.lit("Sharp <1> (+)"), F.lit("Eyes & light (-)")
    factors = F.when(F.col("id") % 5 == 0, F.array().cast("array<string>")).when(F.col("id") % 2 == 0, F.array(sharp)).otherwise(F.array(sharp, eyes))
    keywords = F.when(F.col("id") % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("k"), (F.col("id") % 3).cast("string")), F.lit("tag1")))
    m = p.select("*", factors.alias("factors"), keywords.alias("keywords"), made("client", 3, 0, "C&"), made("event", 4, 0, "E"), made("location", 5, 1, "L"), F.when(F.col("id") % 6 == 0, 'On the "way"').alias("caption"))
    return files.sidecars(m, p)


@query("export_manifest", "select id // 1000 as part, '[' || string_agg('\"' || file_name || '\"', ',' order by file_name) || ']' as names from photos where status = 'selected' group by 1")
def export_manifest(s, d):
    return files.manifest(photos(s, d, "id", "file_name", "status"))


@query("sniff_formats", "+ b as (select page_id, case page_id % 5 when 0 then 'FFD8FFE0' when 1 then '89504E470D0A1A0A' when 2 then '524946460000000057454250' when 3 then '00000018667479706176696600000000' else '0011' end as h from pages) select page_id, case page_id % 5 when 0 then 'jpeg' when 1 then 'png' when 2 then 'webp' when 3 then 'avif' end as format from b", "z as (select 1)")
def sniff_formats(s, d):
    b = table(s, d, "pages").select("page_id", F.unhex(F.expr("case page_id % 5 when 0 then 'FFD8FFE0' when 1 then '89504E470D0A1A0A' when 2 then '524946460000000057454250' when 3 then '00000018667479706176696600000000' else '0011' end")).alias("content"))
    return b.select("page_id", files.sniff().alias("format"))


COMPOSITES = """+ f as (
  select group_id as series, id as frame, i as track, case when (id + i) % 4 = 1 then 'P' || i end as name,
    case when (id + i) % 5 = 0 then 0::double else greatest(0::double, least(1::double, 0.55::double + 0.3::double * (((id * 7 + i * 3) % 11) / 10.0::double) + 0.15::double * (case when (id + i) % 6 = 0 then 0.5::double else ((id * 11 + i) % 9) / 8.0::double end) - case when (id + i) % 7 = 0 then 0.45::double else 0::double end)) end as quality
  from photos, (values (0), (1), (2)) as v(i) where nullif(group_id, '') is not null and (id + i) % 3 <> 0),
frames as (select group_id as series, id as frame from photos where nullif(group_id, '') is not null),
t as (select series, track, row_number() over (partition by series order by track) - 1 as person, count(*) over (partition by series) as person_count, name from (select series, track, arg_min(name, frame) filter (name is not null) as name from f group by 1, 2 having count(distinct frame) >= 2)),
k as (select * from t where person_count >= 2),
q as (select f.* from f join k using (series, track)),
e as (select n.series, n.frame, count(*) filter (q.quality >= 0.6) as good, round(coalesce(sum(q.quality), 0), 9) as total from frames n left join q on n.series = q.series and n.frame = q.frame where n.series in (select series from k) group by 1, 2),
b as (select series, arg_max(frame, {'a': good, 'b': total, 'c': -frame}) as base_frame from e group by 1 having count(*) >= 2),
o as (select k.*, b.base_frame, coalesce(q.quality, 0) as here from k join b using (series) left join q on q.series = k.series and q.track = k.track and q.frame = b.base_frame),
w as (select o.series, o.base_frame, o.person_count, o.person, o.track, o.name, arg_max(q.frame, {'a': q.quality, 'b': -q.frame}) as from_frame, round(max(q.quality) - any_value(o.here), 9) as gain, max(q.quality) as there
  from o join q on q.series = o.series and q.track = o.track and q.frame <> o.base_frame where o.here < 0.6 group by 1, 2, 3, 4, 5, 6)
select series, base_frame, person_count, count(*)::int as n_swaps, string_agg(person || ':' || track || ':' || from_frame || ':' || cast(round(gain * 1000000) as bigint) || ':' || coalesce(name, ''), ',' order by gain desc, person) as swaps
from w where there >= 0.6 and gain >= 0.25 group by 1, 2, 3 having count(*) <= 2"""


@query("composites", COMPOSITES)
def composites(s, d):
    """Series of which a frame would be better with one or two faces of another."""
    p = photos(s, d, "id", "group_id").filter("nullif(group_id, '') is not null").select(F.col("group_id").alias("series"), F.col("id").alias("frame"))
    f = p.withColumn("track", F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])))
    n = F.col("frame") + F.col("track")
    gaze = F.when(n % 6 != 0, ((F.col("frame") * 11 + F.col("track")) % 9) / F.lit(8.0))
    look = X.appearance(n % 5 == 0, ((F.col("frame") * 7 + F.col("track") * 3) % 11) / F.lit(10.0), gaze, n % 7 == 0)
    f = f.filter(n % 3 != 0).select("series", "frame", "track", look.alias("quality"), F.when(n % 4 == 1, F.concat(F.lit("P"), F.col("track").cast("string"))).alias("name"))
    c = C.composite_suggestion(f, p)
    said = F.transform("swaps", lambda x: F.concat_ws(":", x["person"].cast("string"), x["track"].cast("string"), x["from_frame"].cast("string"), F.round(x["gain"] * 1000000).cast("long").cast("string"), F.coalesce(x["name"], F.lit(""))))
    return c.select("series", "base_frame", "person_count", F.size("swaps").alias("n_swaps"), F.array_join(said, ",").alias("swaps"))


def strip_faces(s, d):
    """Faces of the frames of series: some known, some with vectors, some of both, some with neither."""
    p = photos(s, d, "id", "group_id", "persons").filter("nullif(group_id, '') is not null")
    f = p.select(F.col("group_id").alias("series"), F.col("id").alias("frame"), F.posexplode_outer("persons").alias("face", "who"))
    n, at = F.col("frame"), F.col("face")
    v = F.when(n % 2 == 0, F.array(*[F.cos(F.length("who") + at * 2 + n % 5 * 0.3 + k) for k in (1, 2, 3)]))
    known = F.when(n % 3 != 0, F.col("who"))
    return f.select("series", "frame", at.cast("long").alias("face"), known.alias("person"), F.when(n % 4 != 0, known).alias("name"), ((n + at) % 5 == 0).alias("blinking"), (at * 0.3 + n % 3 * 0.05 + 0.1).alias("x"), (n % 4 * 0.04 + 0.4).alias("y"), v.alias("v"))


@query("face_tracks")
def face_tracks(s, d):
    return C.face_tracks(strip_faces(s, d))


@query("stream_sessions", "+ o as (select *, coalesce((captured_at - lag(captured_at) over (order by captured_at, id) > 900000)::int, 1) as brk from photos), m as (select *, sum(brk) over (order by captured_at, id rows unbounded preceding) as run from o) select count(*) as n, min(captured_at) as first_ms from m group by run", PHOTOS_SQL)
def stream_sessions(s, d):
    """Moments by session windows, over the whole table as a batch (tests/test_streams.py runs them as a stream, by camera)."""
    from ..streaming.library import sessions

    e = table(s, d, "events").select((F.col("ts").cast("timestamp")).alias("ts"))
    return sessions(e, gap="900 seconds 1 milliseconds").select("n", F.unix_millis("first").alias("first_ms"))


@query("stream_learner")
def stream_learner(s, d):
    """The learner as a stream over decisions that were written as files, all that is there in one run."""
    import uuid

    from ..streaming.library import DECISION, learner

    at = f"{shared_folder(s)}/learner-{uuid.uuid4().hex}"
    decisions(s, d).select("context_key", "features", "ai_decision", "user_decision", "ts", "id").repartitionByRange("ts").write.parquet(f"{at}/in")
    q = learner(s.readStream.schema(DECISION).parquet(f"{at}/in")).writeStream.outputMode("update").option("checkpointLocation", f"{at}/state").foreachBatch(lambda b, i: b.write.mode("append").parquet(f"{at}/out")).trigger(availableNow=True).start()
    q.awaitTermination()
    out = s.read.parquet(f"{at}/out")
    return out.groupBy("context_key").agg(F.max("n").alias("n"), F.round(F.max_by("bias", "n"), 9).alias("bias"))
