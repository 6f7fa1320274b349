"""Queries of the device gallery, faces, selections, sessions and library joins, each with the SQL that says the same."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import cluster as C
from ..operators import faces as X
from ..operators import gallery as G
from ..operators import joins as J
from ..operators.ranks import down, ranked
from ..sources.bindings import CORRECTIONS_SQL, PHOTOS_SQL, corrections, photos, table
from .library import query


def duck(sql: str) -> str:
    """The DuckDB spelling of an expression: doubles, and names made of numbers."""
    return re.sub(r"\b(\d+)D\b", r"\1.0::double", sql).replace("as string", "as varchar")


#: A face of a photo, as expressions over the photo's id, how many of its persons are known, and the face's number i.
FACE = {
    "box": "{0}((id + i * 3) % 7) / 10D, ((id * 5 + i) % 6) / 10D, ((id + i) % 5 + 1) / 20D, ((id * 3 + i) % 4 + 1) / 20D{1}", "face_score": "((id + i) % 10 + 1) / 11D",
    "smile": "((id * 7 + i * 3) % 11) / 10D", "eye_left": "((id + i) % 10) / 10D", "eye_right": "((id * 3 + i) % 10) / 10D", "blinking": "(id + i) % 5 = 0", "mouth_open": "(id + i) % 3 = 0",
    "happy": "((id * 2 + i) % 10) / 10D", "surprise": "((id + i * 2) % 8) / 10D", "negative": "((id * 3 + i) % 6) / 5D", "eye_contact": "case when (id + i) % 4 = 0 then null else ((id + i) % 9) / 8D end",
    "catchlight": "(id + i) % 2 = 0", "name": "case when i < known_face_count then concat('P', cast((id + i * 4) % 9 as string)) end", "similarity": "((id * 11 + i * 5) % 100) / 100D",
}
FACES = f"transform(filter(array(0L, 1L, 2L), i -> i < face_count), i -> named_struct({', '.join(f'{k!r}, {v.format('array(', ')')}' for k, v in FACE.items())}))"
FACES_SQL = f"{PHOTOS_SQL}, seen as (select *, list_transform(list_filter([0, 1, 2], lambda i: i < face_count), lambda i: {{{', '.join(f'{k!r}: {duck(v.format('[', ']'))}' for k, v in FACE.items())}}}) as faces from photos)"


def seen(s, d):
    return photos(s, d).withColumn("faces", F.expr(FACES))


def _ratio(test: str) -> str:
    return f"case when len(faces) > 0 then len(list_filter(faces, lambda f: {test})) / len(faces) end"


def _mean(value: str) -> str:
    return f"case when len(faces) > 0 then list_sum(list_transform(faces, lambda f: {value})) / len(faces) end"


@query(
    "face_measures",
    f"select id, len(faces)::int as face_count, len(list_filter(faces, lambda f: f.name is not null))::int as known_face_count, len(list_filter(faces, lambda f: f.box[3] * f.box[4] >= 0.004::double))::int as prominent, "
    f"coalesce(list_max(list_transform(faces, lambda f: f.smile)), 0.0::double) as best_smile, len(list_filter(faces, lambda f: f.blinking)) = 0 as all_eyes_open, {_ratio('not f.blinking')} as group_eyes_open, "
    f"{_ratio('f.smile >= 0.4::double')} as group_smile, {_ratio('f.mouth_open and f.happy < 0.3::double and f.surprise < 0.3::double')} as group_awkward, "
    f"{_ratio('f.smile >= 0.4::double and (f.eye_left + f.eye_right) / 2 < 0.77::double')} as group_genuine_smile, {_ratio('f.catchlight')} as group_catchlight, "
    f"round({_mean('coalesce(f.eye_contact, 0.5::double)')}, 9) as avg_eye_contact, round({_mean('greatest(0, least(1, 0.5 + 0.5 * f.happy + 0.25 * f.surprise - 0.5 * least(1, f.negative)))')}, 9) as avg_engagement from seen",
    FACES_SQL,
)
def face_measures(s, d):
    rounded = {"avg_eye_contact", "avg_engagement"}
    m = seen(s, d).select("id", *X.face_measures())
    return m.select(*[F.round(c, 9).alias(c) if c in rounded else c for c in m.columns])


@query("face_composition", "+ f as (select id, unnest(faces) as f, generate_subscripts(faces, 1) as i from seen), m as (select id, arg_max(f.box, {'a': f.box[3] * f.box[4], 'b': i}) as b from f group by 1), c as (select id, b[1] + b[3] / 2 as x, b[2] + b[4] / 2 as y, b[2] as top from m), z as (select id, least(sqrt((x - 1/3.0::double)**2 + (y - 1/3.0::double)**2), sqrt((x - 2/3.0::double)**2 + (y - 1/3.0::double)**2), sqrt((x - 1/3.0::double)**2 + (y - 2/3.0::double)**2), sqrt((x - 2/3.0::double)**2 + (y - 2/3.0::double)**2)) as near, top from c) select s.id, round(case when near is null then 0.5 else greatest(0, least(1, 1 - near / sqrt(2 * (1/6.0::double)**2))) end, 9) as thirds, round(case when top is null then 0.5 when top < 0.04::double then top / 0.04::double when top > 0.22::double then greatest(0, 1 - (top - 0.22::double) / 0.28::double) else 1 end, 9) as headroom from seen s left join z on s.id = z.id", FACES_SQL)
def face_composition(s, d):
    c = seen(s, d).withColumn("_box", X.main_box()).select("id", *X.composition(F.col("_box")))
    return c.select("id", F.round("thirds", 9).alias("thirds"), F.round("headroom", 9).alias("headroom"))


@query("best_similarity", "+ f as (select id, unnest(faces) as f from seen) select id, f.name as name, max(f.similarity) as similarity from f where f.name is not null group by 1, 2", FACES_SQL)
def best_similarity(s, d):
    """The best similarity of each person in each photo."""
    return seen(s, d).select("id", F.explode(X.best_per_name()).alias("name", "similarity"))


@query("person_tracks")
def person_tracks(s, d):
    """Faces of a series followed by vectors that are made of the event's number."""
    f = seen(s, d).filter("nullif(group_id, '') is not null").select(F.col("group_id").alias("series"), F.col("id").alias("frame"), F.posexplode("faces").alias("face", "f"))
    v = F.when(F.col("frame") % 7 != 0, F.array(*[F.cos(F.col("f.similarity") * k + F.col("face")) for k in (1, 2, 3)]))
    return C.person_tracks(f.select("series", "frame", F.col("face").cast("long").alias("face"), F.col("f.name").alias("name"), F.col("f.smile").alias("quality"), v.alias("v")))


GALLERY = "select id as ordinal, id, coalesce(media_uri, concat('file://', file_name)) as uri, concat('f', cast(user_id % 12 as string)) as folder, case id % 6 when 0 then 0 when 1 then null else captured_at end as taken, captured_at {div} 1000 + 60 as added_s, lat, lon, face_count from photos"
GALLERY_SQL = f"{PHOTOS_SQL}, gallery as ({duck(GALLERY.replace('{div}', '//'))})"


def device(s, d):
    p = photos(s, d, "id", "media_uri", "file_name", "user_id", "captured_at", "lat", "lon", "face_count")
    return p.selectExpr("id as ordinal", "id", "coalesce(media_uri, concat('file://', file_name)) as uri", "concat('f', cast(user_id % 12 as string)) as folder", "case id % 6 when 0 then 0L when 1 then null else captured_at end as taken", "captured_at div 1000 + 60 as added_s", "lat", "lon", "face_count")


@query("gallery_overview", "select count(*) as n, least(min(taken) filter (taken > 0), min(added_s * 1000) filter (added_s > 0)) as earliest, greatest(max(taken) filter (taken > 0), max(added_s * 1000) filter (added_s > 0)) as latest from gallery", GALLERY_SQL)
def gallery_overview(s, d):
    return G.gallery_overview(device(s, d))


@query("gallery_range", "select id from gallery where case when coalesce(taken, 0) > 0 then taken else added_s * 1000 end between 1704900000000 and 1705500000000", GALLERY_SQL)
def gallery_range(s, d):
    return G.photos_in_range(device(s, d), 1_704_900_000_000, 1_705_500_000_000).select("id")


OUT = "folder in ('f3', 'f7', 'f10')"


def shut(s):
    return s.createDataFrame([("f3",), ("f7",), ("f10",), ("f99",)], "folder string")


@query("gallery_folders", f"+ g as (select folder, count(*) as n, min(ordinal) as first from gallery group by 1) select folder, n, {OUT} as excluded, row_number() over (order by {OUT}, n desc, first)::int as place from g", GALLERY_SQL)
def gallery_folders(s, d):
    return G.ordered_folders(G.folders(device(s, d)), shut(s))


@query("gallery_included", f"select count(*) as included from gallery where not {OUT}", GALLERY_SQL)
def gallery_included(s, d):
    return G.included_count(G.ordered_folders(G.folders(device(s, d)), shut(s)))


@query("gallery_folder", "select id, taken from gallery where folder = 'f4'", GALLERY_SQL)
def gallery_folder(s, d):
    return G.in_folder(device(s, d), "f4").select("id", "taken")


@query("gallery_locations", "+ u as (select 'content://' || id as uri from photos) select u.uri, g.lat, g.lon from u left join gallery g on u.uri = g.uri", GALLERY_SQL)
def gallery_locations(s, d):
    """GPS of every uri that a photo could have; a fourth has none in the gallery."""
    asked = photos(s, d, "id").select(F.concat(F.lit("content://"), F.col("id").cast("string")).alias("uri"))
    return G.locations_of(asked, device(s, d))


@query("faces_first", "select id, row_number() over (order by case when ordinal > 150 then 2 when face_count > 0 then 0 else 1 end, ordinal) as place from gallery", GALLERY_SQL)
def faces_first(s, d):
    return G.faces_first(device(s, d))


@query("gallery_new", "select id from gallery where id not in (select id from photos where status in ('selected', 'rejected'))", GALLERY_SQL)
def gallery_new(s, d):
    """Gallery photos that were never decided on."""
    return device(s, d).select("id").join(photos(s, d, "id", "status").filter("status in ('selected', 'rejected')"), "id", "left_anti")


SPAN = "select min(captured_at) as lo, max(captured_at) as hi from photos"


@query("gallery_periods", f"+ m as ({SPAN}), c as (select project, max(captured_at) filter (status <> 'pending') as till from photos group by 1), w as (select project, till, lo, hi, unnest(range(0, least(240, ceil((hi - lo) / 86400000))::bigint)) as i from c, m where lo < hi) select project, lo + i * 86400000 as start, least(lo + (i + 1) * 86400000, hi) as end, least(lo + (i + 1) * 86400000, hi) <= coalesce(till, lo) as covered from w")
def gallery_periods(s, d):
    """The days of the library's span, and for each project whether its decisions have come so far."""
    p = photos(s, d, "project", "status", "captured_at")
    m = p.agg(F.min("captured_at").alias("lo"), F.max("captured_at").alias("hi"))
    till = p.groupBy("project").agg(F.max(F.when(F.col("status") != "pending", F.col("captured_at"))).alias("till"))
    return till.crossJoin(F.broadcast(m)).select("project", F.inline(G.periods(F.col("lo"), F.col("hi"), F.col("till"), 86_400_000)))  # m is one row


@query("gallery_coverage", f"+ m as ({SPAN}), c as (select project, max(captured_at) filter (status <> 'pending') as till from photos group by 1), j as (select project, lo, hi, till, case when till is null then lo else greatest(till, lo) end as st from c, m) select project, case when st < hi then st end as next_start, case when st < hi then least(st + 86400000, hi) end as next_end, cast(floor(case when till is null then 0 else greatest(0, least(till, hi) - lo) end / (hi - lo) * 100 + 0.5) as bigint) as percent from j")
def gallery_coverage(s, d):
    """By project: how far its decisions reach into the library's time, and the next day to look at."""
    p = photos(s, d, "project", "status", "captured_at")
    m = p.agg(F.min("captured_at").alias("lo"), F.max("captured_at").alias("hi"))
    c = p.groupBy("project").agg(F.max(F.when(F.col("status") != "pending", F.col("captured_at"))).alias("till")).crossJoin(F.broadcast(m))
    nxt = G.next_period(F.col("lo"), F.col("hi"), F.col("till"), 86_400_000)
    return c.select("project", nxt["start"].alias("next_start"), nxt["end"].alias("next_end"), G.coverage_percent(F.col("lo"), F.col("hi"), F.col("till")).alias("percent"))


@query("range_select", "+ o as (select id, row_number() over (order by captured_at, id) as r from photos), e as (select min(r) as lo, max(r) as hi from o where id in (17, 113)) select id from o, e where r between lo and hi")
def range_select(s, d):
    return G.select_range(ranked(photos(s, d, "id", "captured_at"), ["captured_at", "id"]), 113, 17)


@query("session_outcomes", "+ g as (select project, count(*) as imported, count(*) filter (status in ('selected', 'rejected')) + 3 as auto, count(distinct group_id) - 40 as series, count(*) filter (abs(ai_score - 50) <= 5) as unsure, max(captured_at) - min(captured_at) as ms from photos group by 1), a as (select *, greatest(0, least(imported, auto)) as ok from g) select project, imported, ok as auto_decided, imported - ok as left_to_review, ok / imported as handled_share, greatest(0, series) as series_found, greatest(0, least(ok, unsure)) as uncertain, ms as duration_ms from a")
def session_outcomes(s, d):
    p = photos(s, d, "project", "status", "group_id", "ai_score", "captured_at")
    g = p.groupBy("project").agg(F.count(F.lit(1)).alias("imported"), (F.count_if(F.col("status").isin("selected", "rejected")) + 3).alias("auto"), (F.count_distinct("group_id") - 40).alias("series"), F.count_if(F.abs(F.col("ai_score") - 50) <= 5).alias("unsure"), (F.max("captured_at") - F.min("captured_at")).alias("ms"))
    return g.select("project", G.session_outcome(*map(F.col, ("imported", "auto", "series", "unsure", "ms"))).alias("o")).select("project", "o.*")


REASON = "case id % 7 when 0 then 'decode' when 1 then 'timeout' when 2 then 'decode' when 3 then 'memory' else 'format' end"


@query("failure_reasons", f"+ f as (select id, {REASON} as reason from photos where status = 'rejected'), g as (select reason, count(*) as n, min(id) as first from f group by 1 order by n desc, first limit 2) select string_agg(reason || ' (x' || n || ')', ' · ' order by n desc, first) as reasons from g")
def failure_reasons(s, d):
    f = photos(s, d, "id", "status").filter("status = 'rejected'").select(F.col("id").alias("ordinal"), F.expr(REASON).alias("reason"))
    return G.top_reasons(f)


@query("sort_queue", "select id, row_number() over (order by coalesce(captured_at, 0), id) as place from photos where status in ('pending', 'review')")
def sort_queue(s, d):
    """What is still to be decided, in time order."""
    p = photos(s, d, "id", "status", "captured_at").filter("status in ('pending', 'review')")
    return ranked(p, [F.coalesce("captured_at", F.lit(0)), "id"]).select("id", "place")


@query("grid_orders", "select id, row_number() over (order by ai_score, id) as by_score, row_number() over (order by rating desc, id) as by_rating_down, row_number() over (order by sharpness desc, id) as by_sharpness_down, row_number() over (order by file_name, id) as by_name from photos")
def grid_orders(s, d):
    """Places in four orders of the grid; ties keep the input order, upwards and downwards."""
    p = photos(s, d, "id", "ai_score", "rating", "sharpness", "file_name")
    for name, order in (("by_score", "ai_score"), ("by_rating_down", down("rating")), ("by_sharpness_down", down("sharpness")), ("by_name", "file_name")):
        p = ranked(p, [order, "id"], name)
    return p.select("id", "by_score", "by_rating_down", "by_sharpness_down", "by_name")


ABSTRACT = ["tag0", "tag2", "tag5"]


@query("natural_tags", f"select id, list_filter(tags, lambda t: t not in ({', '.join(map(repr, ABSTRACT))}))[1] as tag from photos")
def natural_tags(s, d):
    return photos(s, d, "id", "tags").select("id", G.natural_tag("tags", F.array(*map(F.lit, ABSTRACT))).alias("tag"))


@query("places_of_photos")
def places_of_photos(s, d):
    """Photos of a known locality, by it; the others are clustered by proximity (see proximity_clusters)."""
    p = photos(s, d, "id", "lat").filter("lat is not null")
    l = p.select("id", F.expr("case when lat > 45 then concat('T', cast(floor(lat) as string)) when id % 5 = 0 then '' end").alias("locality"))
    return G.best_of_places(C.proximity_clusters(photos(s, d, "id", "lat", "lon")), l)


# library joins


@query("multi_get", "+ k as (select unnest([7, 100000000, 3, 7, 42]) as id, unnest(range(0, 5)) as pos) select k.pos::int as pos, k.id, p.status, p.ai_score from k left join photos p on k.id = p.id")
def multi_get(s, d):
    ids = s.createDataFrame(list(enumerate([7, 100_000_000, 3, 7, 42])), "pos int, id long")
    return J.multi_get(ids, photos(s, d, "id", "status", "ai_score")).select("pos", "id", "status", "ai_score")


ANALYSES = "select id, sharpness, scene_type from photos where id % 3 <> 0"


@query("corrections_view", f"+ a as ({ANALYSES}) select c.id, c.ts, c.user_decision, p.status, a.sharpness, a.scene_type from corrections c join photos p on c.id = p.id left join a on a.id = c.id", f"{PHOTOS_SQL}, {CORRECTIONS_SQL}")
def corrections_view(s, d):
    a = photos(s, d, "id", "sharpness", "scene_type").filter("id % 3 <> 0")
    return J.corrections_view(corrections(s, d), photos(s, d, "id", "status"), a).select("id", "ts", "user_decision", "status", "sharpness", "scene_type")


@query("in_collection", "select id, status from photos where user_id % 4 = 1")
def in_collection(s, d):
    """Members of a collection that was made of every fourth user's photos."""
    p = photos(s, d, "id", "user_id", "status")
    c = p.groupBy(F.concat(F.lit("c"), (F.col("user_id") % 4).cast("string")).alias("name"), F.col("id").alias("_id")).agg(F.array("_id").alias("member_ids"))
    return J.in_collection(p, c, "c1").select("id", "status")


@query("with_projects", "+ j as (select distinct project, 'Client ' || project as client from photos where project in ('p1', 'p2', 'p3')) select p.id, p.project, j.client from photos p left join j on p.project = j.project")
def with_projects(s, d):
    p = photos(s, d, "id", "project")
    j = p.filter("project in ('p1', 'p2', 'p3')").select("project").distinct().withColumn("client", F.concat(F.lit("Client "), "project"))
    return J.with_projects(p, j).select("id", "project", "client")


@query("scoped_queue", "+ k as (select unnest([9, 4, 200000000, 1]) as id, unnest(range(0, 4)) as pos) select k.pos::int as pos, k.id, p.status from k join photos p on k.id = p.id")
def scoped_queue(s, d):
    ids = s.createDataFrame([([9, 4, 200_000_000, 1],)], "ids array<long>")
    return J.scoped_queue(ids, photos(s, d, "id", "status")).select("pos", "id", "status")


@query("new_folders", f"select distinct folder from gallery where not {OUT} and folder not in ('f1', 'f2')", GALLERY_SQL)
def new_folders(s, d):
    return J.new_folders(device(s, d).select("folder").distinct(), s.createDataFrame([("f1",), ("f2",)], "folder string"), shut(s))


@query("related_tags", "+ t as (select id, unnest(tags) as tag from photos) select id, tag from t where tag in ('tag1', 'tag3')")
def related_tags(s, d):
    words = s.createDataFrame([("beach", "tag1"), ("bea", "tag3"), ("be", "tag2"), ("mountain", "tag4")], "word string, tag string")
    # the words that "beac" begins and those that begin it, from three letters on
    return J.related_tags(photos(s, d, "id", "tags").select("id", F.explode("tags").alias("tag")), words.filter("length(word) >= 3"), "beac")


@query("relabel_persons", "+ f as (select id, unnest(persons) as person, generate_subscripts(persons, 1) as i from photos) select id, i::int as i, case person when 'P1' then 'P2' when 'P3' then null else person end as person from f")
def relabel_persons(s, d):
    a = photos(s, d, "id", "persons").select("id", F.transform("persons", lambda p: F.struct(p.alias("person_id"))).alias("faces"))
    m = s.createDataFrame([("P1", "P2"), ("P3", None)], "old_id string, new_id string")
    return J.relabel("faces", m, a).select("id", F.posexplode("faces").alias("i", "f")).select("id", (F.col("i") + 1).alias("i"), F.col("f.person_id").alias("person"))


@query("undo_newest", "select id, case when id % 5 = 2 then 'pending' else status end as status from photos")
def undo_newest(s, d):
    """The newest of three batches is undone: its photos are pending again."""
    p = photos(s, d, "id", "status")
    h = p.filter("id % 5 < 3").select(F.concat(F.lit("b"), (F.col("id") % 5).cast("string")).alias("batch"), (F.col("id") % 5 * 1000).alias("ts"), "id", F.lit("pending").alias("previous"))
    return J.undo_newest(p, h)


@query("delete_rejected", "select id, status from photos where status <> 'rejected'")
def delete_rejected(s, d):
    p = photos(s, d, "id", "status")
    return J.delete(p, p.filter("status = 'rejected'"))


@query("last_of_log", "+ r as (select id, ts, user_decision, row_number() over (partition by user_decision order by ts desc, id desc) as k from corrections) select id, ts, user_decision from r where k <= 10", CORRECTIONS_SQL)
def last_of_log(s, d):
    return J.last_of_log(corrections(s, d), 10, ["user_decision"]).select("id", "ts", "user_decision")


@query("edited_members", "select id, list_sort(list_distinct(list_concat(list_filter(tags, lambda t: t <> 'tag1'), ['kept']))) as tags from photos")
def edited_members(s, d):
    """Members taken out and put in."""
    p = photos(s, d, "id", "tags").withColumn("tags", J.remove_members("tags", F.array(F.lit("tag1"))))
    return p.select("id", F.array_sort(J.add_members("tags", F.array(F.lit("kept")))).alias("tags"))


@query("session_photos", "+ e as (select doc_id as id from labels) select p.id, p.status from e join photos p on e.id = p.id")
def session_photos(s, d):
    """Photos of a list of ids; ids without a photo are dropped."""
    return table(s, d, "labels").select(F.col("doc_id").alias("id")).join(photos(s, d, "id", "status"), "id")
