"""Queries of files that are written and read again, of what protects a photo, of series that are resolved, and of reminders."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.expr import has_real_gps
from ..operators import aggregates as A
from ..operators import filters as P
from ..operators import groups as G
from ..operators import joins as J
from ..operators import scoring as S
from ..operators.similarity import checkpointed, shared_folder
from ..sources import bindings, files
from ..sources.bindings import PHOTOS_SQL, corrections, photos, table
from .library import SERIES, feedback, gazetteer, query


def folder(s, name):
    return f"{shared_folder(s)}/{name}-{uuid.uuid4().hex}"


@query("backup_restored", "select cast(id as varchar) as id, file_name, captured_at, status, rating::int as rating from photos where status <> 'pending' or rating > 0")
def backup_restored(s, d):
    """A backup of all that has been decided, written and read."""
    at = folder(s, "backup")
    files.write_backup(photos(s, d, "id", "file_name", "captured_at", "status", "rating"), at)
    b = files.backup(s, at)
    return b.select("id", F.col("fileName").alias("file_name"), F.col("capturedAt").alias("captured_at"), "status", "rating")


@query("feedback_files", "+ f as (select id as ordinal, case when id % 2 = 0 then id * 3 end as photo_id, 'IMG_' || lpad(cast((id * 5) % 99991 as varchar), 7, '0') || '.jpg' as file_name, case when id % 3 = 0 then 'yes' else 'no' end as verdict from photos) select verdict, count(*) as n, count(photo_id) as by_id, count(distinct file_name) as names from f group by 1")
def feedback_files(s, d):
    """What clients said, written as files and read as they come."""
    at = folder(s, "feedback")
    f = feedback(s, d)
    f.select(F.col("photo_id").cast("string").alias("photoId"), F.col("file_name").alias("fileName"), "verdict").write.json(at)
    return files.client_feedback(s, at).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.count("photoId").alias("by_id"), F.count_distinct("fileName").alias("names"))


@query("place_files", "select n_name as name, 44 + (n_nationkey % 10) * 0.21::double as lat, 25 + (n_nationkey % 5) * 0.17::double as lon, upper(n_name[1:2]) as country, n_nationkey * 2000 as population from nation")
def place_files(s, d):
    """A gazetteer written as lines of text and parsed; lines that are none are left out."""
    at = folder(s, "places")
    g = gazetteer(s, d)
    lines = g.select(F.concat_ws("\t", "name", F.col("lat").cast("string"), F.col("lon").cast("string"), "country", F.col("population").cast("string")).alias("value"))
    broken = g.select(F.explode(F.array(F.lit("no place"), F.concat("name", F.lit("\tx\t1\tXX")))).alias("value"))
    lines.unionAll(broken).write.text(at)
    return files.places(s, at)


PROFILES = "+ e as (select label * 1000000 + vec_id // 20 as id, list({'v': embedding, 'i': vec_id} order by vec_id) as all_ from z group by 1) select cast(id as varchar) as id, 'P' || id as name, len(all_[-12:])::int as kept, all_[-12:][1].i as first_id from e"


@query("person_profiles", PROFILES, "z as (select * from embeddings)")
def person_profiles(s, d):
    """Profiles of persons with the last twelve of their vectors, written and read."""
    at = folder(s, "persons")
    e = table(s, d, "embeddings").select((F.col("label").cast("long") * 1_000_000 + F.floor(F.col("vec_id") / 20)).alias("id"), "vec_id", "embedding")
    # the vector's number goes along as its first component, so that what was kept can be told
    v = F.concat(F.array(F.col("vec_id").cast("float")), "embedding")
    p = e.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("vec_id", v.alias("v")))).alias("all"))
    files.write_persons(p.select(F.col("id").cast("string").alias("id"), F.concat(F.lit("P"), F.col("id").cast("string")).alias("name"), F.transform("all", lambda x: x["v"]).alias("embeddings")), at)
    return files.persons(s, at).select("id", "name", F.size("embeddings").alias("kept"), F.col("embeddings")[0][0].cast("long").alias("first_id"))


@query("recap_plan", f"+ o as (select id, row_number() over (order by ai_score desc, id) as place from photos where status = 'selected') select id, (place - 1) * 1300 as start_ms from o where place <= 1 + (30000 - 1800) // 1300")
def recap_plan(s, d):
    """The best of what was kept, as far as half a minute goes."""
    top = photos(s, d, "id", "ai_score", "status").filter("status = 'selected'").orderBy(F.desc("ai_score"), "id").limit(100)
    return files.recap_plan(top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("ai_score"), "id"))))


@query("photo_view", "+ a as (select id, ai_score, exposure, thirds, scene_type, face_count, all_eyes_open from photos where id % 10 > 0) select p.id, coalesce(a.ai_score, 0) as ai_score, coalesce(a.scene_type, 'detail') as scene_type, coalesce(a.all_eyes_open, true) as all_eyes_open, coalesce(a.exposure, 0)::double as exposure, coalesce(a.thirds, 0.5::double) as thirds, coalesce(a.face_count, 0) as face_count, coalesce(p.rating, 0) as rating from photos p left join a on p.id = a.id")
def photo_view(s, d):
    """Photos joined to their analyses; a tenth has none."""
    analyses = photos(s, d, "id", "ai_score", "exposure", "thirds", "scene_type", "face_count", "all_eyes_open").filter("id % 10 > 0").withColumnRenamed("id", "photo_id").withColumn("exposure", F.col("exposure").cast("double"))
    return bindings.photo_view(photos(s, d, "id", "rating"), analyses).select("id", "ai_score", "scene_type", "all_eyes_open", "exposure", "thirds", "face_count", "rating")


@query("quick_duplicates")
def quick_duplicates(s, d):
    """Documents as files whose size and ends agree."""
    return A.quick_scan(table(s, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content")))


@query("stage_samples")
def stage_samples(s, d):
    """Two hundred timings of each stage."""
    return A.reservoir(photos(s, d, "status", "ai_score", "id").toDF("stage", "ms", "id"), "stage")


@query("sensitive_documents", "select id from photos where text_coverage >= 0.15 and user_id % 6 <> 2 and id % 13 <> 0")
def sensitive_documents(s, d):
    """Photos that are mostly text, neither in the vault nor put aside."""
    p = photos(s, d, "id", "text_coverage", "user_id")
    return P.sensitive_documents(p, p.filter("user_id % 6 = 2").select("id"), p.filter("id % 13 = 0").select("id")).select("id")


@query("protected_photos", "select id, list_has_any(persons, ['P2', 'P7']) as protected from photos where status = 'rejected'")
def protected_photos(s, d):
    """Rejected photos, and whether a person in them protects them from being deleted."""
    return photos(s, d, "id", "persons", "status").filter("status = 'rejected'").select("id", P.protects(["P2", "P7"]).alias("protected"))


FOLDERS = "case user_id % 5 when 0 then 'DCIM/Camera' when 1 then 'Pictures/Screenshots' when 2 then 'WhatsApp Images' when 3 then 'Download' else 'Trip ' || user_id end"


@query("excluded_folders", f"+ f as (select {FOLDERS} as folder from photos) select folder, count(*) as n, regexp_matches(lower(folder), 'screenshot|download|whatsapp|telegram|messenger|screen ?record') as excluded from f group by 1, 3")
def excluded_folders(s, d):
    """Folders and whether the importer passes them over."""
    f = photos(s, d, "user_id").select(F.expr(FOLDERS.replace("|| user_id", "|| cast(user_id as string)")).alias("folder"))
    return f.groupBy("folder").agg(F.count(F.lit(1)).alias("n")).withColumn("excluded", P.excluded_folder())


@query("reminders_due", "+ l as (select user_id, max(captured_at) filter (status <> 'pending') as last, any_value(hi) as hi from photos, (select max(captured_at) as hi from photos) group by 1) select user_id, last is null or hi - last >= 3 * 86400000 as due from l")
def reminders_due(s, d):
    """Users who have decided nothing for three days before the library's end."""
    p = photos(s, d, "user_id", "captured_at", "status")
    end = p.agg(F.max("captured_at")).first()[0]
    last = p.groupBy("user_id").agg(F.max(F.when(F.col("status") != "pending", F.col("captured_at"))).alias("last"))
    return last.select("user_id", P.stale(F.col("last"), F.lit(end), 3).alias("due"))


@query("learned_share", "select least(1.0::double, count(*) / 40.0::double) as learned_weight from labels join photos on photos.id = labels.doc_id")
def learned_share(s, d):
    """How much of a choice within a series the learner has a say in."""
    from .advanced import decisions

    return S.learned_weight(checkpointed(S.replay(decisions(s, d))))


KEPT = f"+ k as (select group_id, id, row_number() over (partition by group_id order by ai_score desc, id) as r, count(*) over (partition by group_id) as n from photos where {SERIES})"


def two_of_each(s, d):
    """The two best frames of series of three and more."""
    p = G.series(photos(s, d, "id", "group_id", "ai_score"))
    w = Window.partitionBy("group_id")
    r = p.withColumn("r", F.row_number().over(w.orderBy(F.desc("ai_score"), "id"))).withColumn("n", F.count(F.lit(1)).over(w))
    return r.filter("n >= 3 and r <= 2").select("group_id", "id")


@query("keep_many_in_groups", KEPT + " select id, group_id, case when r <= 2 then 'selected' else 'rejected' end as status from k where n >= 3")
def keep_many_in_groups(s, d):
    """Series of which two frames are kept."""
    return J.keep_in_groups(photos(s, d, "id", "group_id"), two_of_each(s, d))


@query("group_choices", KEPT + " select x.id as winner_id, y.id as loser_id from k x join k y on x.group_id = y.group_id where x.n >= 3 and x.r <= 2 and y.r > 2")
def group_choices(s, d):
    """What a learner is told of them."""
    return J.choices_of(J.keep_in_groups(photos(s, d, "id", "group_id"), two_of_each(s, d))).select("winner_id", "loser_id")


@query("bulk_fields", "select id, case when user_id % 3 = 0 then least(5, greatest(0, id % 9 - 1))::int else rating::int end as rating, case when user_id % 3 = 0 then 'blue' else color_label end as color_label, case when user_id % 3 = 0 then 'Set together' end as caption from photos")
def bulk_fields(s, d):
    """Stars, colour and caption of many photos set at once."""
    p = photos(s, d, "id", "user_id", "rating", "color_label").select("id", "user_id", F.col("rating").cast("int").alias("rating"), "color_label", F.lit(None).cast("string").alias("caption"))
    return J.bulk_set(p, p.filter("user_id % 3 = 0"), rating=F.col("id") % 9 - 1, color_label=F.lit("blue"), caption=F.lit("Set together")).drop("user_id")


@query("names_in_order")
def names_in_order(s, d):
    """Places of photos by names with accents and both cases, as a reader would sort them."""
    from ..operators.ranks import ranked

    p = photos(s, d, "id").select("id", F.expr("concat(element_at(array('Ábel', 'abel', 'Abel', 'zoe', 'Éva', 'eva', 'Zoë', 'ștefan', 'Stefan', 'țară'), cast(id % 10 as int) + 1), ' ', id div 10 % 50, '.jpg')").alias("file_name"))
    return ranked(p, [P.reading_order("file_name"), "id"]).select("id", "file_name", "place")


@query("located_share", "select count(*) as photos, count(*) filter (lat is not null and lat between -90 and 90 and lon between -180 and 180 and not (lat = 0 and lon = 0)) as located from photos")
def located_share(s, d):
    """How many photos say where they were taken; the others are a group of their own among the places."""
    return photos(s, d, "lat", "lon").agg(F.count(F.lit(1)).alias("photos"), F.count_if(has_real_gps()).alias("located"))


def said(name):
    from .library import EYES, SHARP, SMILE_RATIO

    texts = {
        "technical": f"case when ({SHARP}) < 45 then 'soft' when exposure - 50 < -15 then 'under' when exposure - 50 > 15 then 'over' when coalesce(highlight_clipping, 0) > 0.06 then 'highlights' when coalesce(shadow_clipping, 0) > 0.06 then 'shadows' when ({SHARP}) >= 70 then 'clean' else 'fine' end",
        "subject": f"case when {EYES} < 0.999 then case when face_count > 1 then 'someBlink' else 'blink' end when {SMILE_RATIO} >= 0.6 then 'smiling' else 'eyesOpen' end",
        "framing": "case when face_count > 0 then case when head < 0.35 then 'headroom' when coalesce(thirds, 0.5) < 0.35 then 'centered' when coalesce(thirds, 0.5) >= 0.6 and head >= 0.6 then 'strong' else 'fine' end else case when id % 12 = 0 or id % 20 = 0 then 'structure' when bare < 0.35 then 'crowded' else 'fine' end end",
    }
    return f"'{name}.' || {texts[name]} as {name}"


@query("metric_summaries", f"+ v as (select *, (id % 8) / 7.0::double as head, (id % 11) / 10.0::double as bare from photos) select id, {said('technical')}, {said('subject')}, {said('framing')} from v")
def metric_summaries(s, d):
    """The first thing to say of every photo's technique, subject and framing."""
    n = F.col("id")
    p = photos(s, d).select("*", ((n % 8) / F.lit(7.0)).alias("headroom"), (n % 12 == 0).alias("symmetry"), (n % 20 == 0).alias("leading_lines"), ((n % 11) / F.lit(10.0)).alias("negative_space"))
    return p.select("id", *[c.alias(k) for c, k in zip(G.summaries(), ("technical", "subject", "framing"), strict=True)])


def style_sql():
    from ..operators.edits import PRESETS, STYLE

    names = list(PRESETS)
    of = lambda f: " ".join(f"when {i} then {f(k)}" for i, k in enumerate(names))
    sliders = ", ".join(f"case id % {len(names)} {of(lambda k, x=x: PRESETS[k][0].get(x, 0))} end::double as {x}" for x in STYLE)
    bands = of(lambda k: "'" + ",".join(f"{b}:{float(v[0])}:{float(v[1])}" for b, v in sorted(PRESETS[k][1].items())) + "'")
    return f"select id, {sliders}, (id % 9)::double as sharpen, case id % {len(names)} {bands} end as bands from photos"


@query("styled_edits", style_sql())
def styled_edits(s, d):
    """The edits of every photo after one of the styles; sharpening is none of its business."""
    from ..operators import edits as E

    p = photos(s, d, "id").withColumn("edits", F.create_map(F.lit("exposure"), F.lit(30.0), F.lit("sharpen"), (F.col("id") % 9).cast("double")))
    out = None
    for i, name in enumerate(E.PRESETS):
        edits, bands = E.preset(F.col("edits"), name)
        said_ = F.coalesce(F.array_join(F.transform(F.array_sort(F.map_entries(bands)), lambda b: F.concat_ws(":", b["key"], b["value"]["saturation"].cast("string"), b["value"]["luminance"].cast("string"))), ","), F.lit(""))
        mine = F.struct(edits.alias("e"), said_.alias("bands"))
        out = F.when(F.col("id") % len(E.PRESETS) == i, mine) if out is None else out.when(F.col("id") % len(E.PRESETS) == i, mine)
    q = p.select("id", out.alias("o"))
    return q.select("id", *[F.col("o.e")[k].alias(k) for k in (*E.STYLE, "sharpen")], "o.bands")


MERGED = """+ e as (select label as target, vec_id // 20 as ordinal, vec_id from z), n as (select target, count(distinct ordinal) as n from e group by 1),
k as (select e.*, greatest(1, 60 // n.n) as cap, row_number() over (partition by e.target, ordinal order by vec_id desc) as r from e join n on e.target = n.target),
o as (select target, vec_id, row_number() over (partition by target order by ordinal desc, vec_id desc) as p from k where r <= cap)
select target, count(*)::int as n, min(vec_id) as first_id, max(vec_id) as last_id, cast(sum(vec_id) as bigint) as ids from o where p <= 60 group by 1"""


@query("merged_persons", MERGED, "z as (select * from embeddings)")
def merged_persons(s, d):
    """All profiles of a label made one person's, with some of the vectors of each."""
    e = table(s, d, "embeddings").select(F.col("label").alias("target"), F.floor(F.col("vec_id") / 20).alias("ordinal"), "vec_id", "embedding")
    v = F.concat(F.array(F.col("vec_id").cast("float")), "embedding")  # the number goes along, so that what was kept can be told
    p = e.groupBy("target", "ordinal").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", v.alias("v")))), lambda x: x["v"]).alias("embeddings"))
    ids = F.transform("embeddings", lambda x: x[0].cast("long"))
    return J.merged_profiles(p).select("target", F.size("embeddings").alias("n"), F.array_min(ids).alias("first_id"), F.array_max(ids).alias("last_id"), F.aggregate(ids, F.lit(0).cast("long"), lambda a, x: a + x).alias("ids"))
