"""Queries over the photo view, each beside the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import aggregates as A
from ..operators import filters as P
from ..operators import groups as G
from ..operators import joins as J
from ..operators import search as X_SEARCH
from ..operators.similarity import spread
from ..sources.bindings import CORRECTIONS_SQL, PHOTOS_SQL, corrections, photos

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, source: str = PHOTOS_SQL) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = f"with {source}{',' if sql.lstrip().startswith('+') else ''} {sql.lstrip().removeprefix('+')}"
        return f

    return keep


STATUS = "count(*) as total, count(*) filter (status = 'selected') as selected, count(*) filter (status = 'rejected') as rejected, count(*) filter (status = 'review') as review"
RANK = "case when text_coverage >= 0.15 then 0 when coalesce(known_face_count, 0) > 0 then 3 when coalesce(face_count, 0) > 0 then 2 else 1 end"
SHARP = "case when face_count > 0 then sharpness::double else pow(greatest(0, sharpness::double) / 100, 0.6::double) * 100 end"
EYES = "coalesce(group_eyes_open, all_eyes_open::int::double)"
SUBJECT_TAG = "len(list_filter(tags, lambda t: lower(t) not in (" + ", ".join(f"'{t}'" for t in P.ABSTRACT_TAGS) + "))) > 0"
HARD = "coalesce(ai_uncertainty, greatest(0::double, least(1::double, least(ai_score - 35, 65 - ai_score) / 15.0::double)))"
DEFECT = f"(({SHARP}) < 45 or abs(exposure - 50) > 15 or coalesce(highlight_clipping, 0) > 0.06 or shadow_clipping > 0.06 or coalesce(not subject_in_focus, false) or (face_count > 0 and {EYES} < 0.8::double))"
DECIDED = "status in ('selected', 'rejected', 'candidate')"
SERIES = "nullif(group_id, '') is not null"


@query("library_stats", f"select {STATUS}, count(*) filter (status not in ('selected', 'rejected', 'review')) as pending, {', '.join(f'count(*) filter (rating = {r}) as rating_{r}' for r in range(1, 6))}, count(distinct nullif(group_id, '')) as series, coalesce(cast(floor(avg(ai_score) + 0.5) as bigint), 0) as avg_score from photos")
def library_stats(s, d):
    return A.library_stats(photos(s, d, "status", "rating", "group_id", "ai_score"))


@query("project_stats", f"select coalesce(project, 'none') as project_key, {STATUS}, min(captured_at) as first_at, max(captured_at) as last_at from photos group by 1")
def project_stats(s, d):
    return A.project_stats(photos(s, d, "project", "status", "captured_at"))


@query("status_filter", "select id, status from photos where status in ('selected', 'candidate')")
def status_filter(s, d):
    return photos(s, d, "id", "status").filter(P.user_status(["selected", "candidate"]))


@query("series_order", f"select id, group_id, ai_score from photos where {SERIES}")
def series_order(s, d):
    return G.series(photos(s, d, "id", "group_id", "ai_score")).orderBy("group_id", F.desc("ai_score"), "id")


@query("review_difficulty", f"select id, {HARD} as difficulty from photos where status = 'review'")
def review_difficulty(s, d):
    return photos(s, d, "id", "status", "ai_score", "ai_uncertainty").filter("status = 'review'").select("id", X.review_difficulty().alias("difficulty"))


@query("filtered_preset", "select id from photos where status in ('selected', 'review', 'candidate') and list_contains(tags, 'tag3') and camera = 'Cam 2' and rating >= 2 and coalesce(captured_at, 0) between 1704067200000 and 1706000000000")
def filtered_preset(s, d):
    preset = P.Preset(status=("selected", "review", "candidate"), tag="tag3", camera="Cam 2", min_rating=2, dates=(1704067200000, 1706000000000))
    return P.filtered(photos(s, d), preset).select("id")


@query("person_and_color", "select id from photos where list_contains(persons, 'P4') and coalesce(color_label, 'none') = 'none' and nullif(project, '') is null")
def person_and_color(s, d):
    return photos(s, d, "id", "persons", "color_label", "project").filter(P.has_person("P4") & P.color_is("none") & P.in_project(None)).select("id")


def duck_fold(x):
    return f"strip_accents(lower({x}))"


def duck_months(names):
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


MADE_TEXTS = {
    "caption": "case when {id} % 6 = 0 then 'La plajă cu Ștefan' when {id} % 6 = 1 then 'Évora, é bom' end", "camera_make": "case when {id} % 4 > 0 then 'Canon' end", "lens": "case when {id} % 3 = 0 then 'RF 50mm' end",
}
LABELS_RO = {"tag1": "Pisică", "tag2": "Câine", "Texture": "textură"}
#: A needle for each kind of text, and one for each way in which words are near.
NEEDLES = ["img_00000", "ștefan", "EVORA", "zăpadă", "p4", "Canon Cam 2 RF", "pisic", "ianuarie", "9 ian. 2024", "langa", "iarna", "nothing of this"]


def search_sql():
    now = "make_timestamp(captured_at * 1000)"
    year, month, day = f"year({now})::varchar", f"month({now})", f"day({now})::varchar"
    long, short = (f"{duck_months(X_SEARCH.MONTHS['ro'][k])}[{month}]" for k in (0, 1))
    label = "case " + " ".join(f"when t = '{k}' then '{v}'" for k, v in LABELS_RO.items()) + " else t end"
    radius = "case when population <= 0 then 3.0::double else least(12.0::double, greatest(1.5::double, 0.6::double * sqrt(population / 1000))) end"
    made = ", ".join(f"{v.format(id='p.id')} as {k}" for k, v in MADE_TEXTS.items())
    texts = ", ".join(f"coalesce({duck_fold(c)}, '')" for c in ("file_name", "project", "caption", "place"))
    camera = duck_fold("concat_ws(' ', nullif(camera_make, ''), nullif(camera, ''), nullif(lens, ''))")
    dates = duck_fold(f"concat_ws(' ', {year}, {long}, {short}, {day} || ' ' || {short} || ' ' || {year})")
    hits = []
    for n in NEEDLES:
        q, near = X_SEARCH.folded(n), X_SEARCH.related(X_SEARCH.folded(n))
        more = " or " + " or ".join(f"list_contains(tags, '{t}')" for t in near) if near else ""
        hits.append(f"case when len(list_filter(texts, lambda x: contains(x, '{q}'))) > 0{more} then '{n}' end")
    return f"""+ {PLACES}, j as (select p.id, q.name, q.country, q.population, p.lat, p.lon, q.lat as plat, q.lon as plon, power(q.lat - p.lat, 2) + power((q.lon - p.lon) * cos(radians(p.lat)), 2) as s, q.ordinal from photos p join places q on q.lat >= p.lat - 30.0::double / 110.574::double and q.lat < p.lat + 30.0::double / 110.574::double),
b as (select *, row_number() over (partition by id order by s, plat, ordinal) as r, power(sin((radians(plat) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(plat)) * power(sin(radians(plon - lon) / 2), 2) as h from j),
w as (select id, case when 12742.0::double * atan2(sqrt(h), sqrt(1 - h)) <= {radius} then '' else 'lângă ' end || name || ', ' || country as place from b where r = 1 and 12742.0::double * atan2(sqrt(h), sqrt(1 - h)) <= 30),
v as (select p.* exclude (tags), {made}, case when p.id % 9 = 0 then ['Zăpadă', 'k' || p.id % 3] else ['k' || p.id % 3] end as keywords, list_transform(p.tags, lambda t: case when t = 'tag3' then 'snow' else t end) as tags, w.place from (select * from photos) p left join w on p.id = w.id),
x as (select id, tags, list_concat(list_concat([{texts}, {camera}, {dates}], list_concat(list_transform(persons, lambda t: {duck_fold('t')}), list_transform(keywords, lambda t: {duck_fold('t')}))), list_transform(tags, lambda t: {duck_fold(label)})) as texts from v),
f as (select id, list_filter([{', '.join(hits)}], lambda n: n is not null) as found from x)
select id, array_to_string(found, '|') as found from f where len(found) > 0"""


def searched(s, d):
    """The photo view with captions, keywords, lenses and the names of places."""
    p = spread(photos(s, d))
    made = [F.expr(v.format(id="id")).alias(k) for k, v in MADE_TEXTS.items()]
    keywords = F.expr("case when id % 9 = 0 then array('Zăpadă', concat('k', id % 3)) else array(concat('k', id % 3)) end").alias("keywords")
    near = J.places_of_spots(photos(s, d, "lat", "lon"), gazetteer(s, d))
    place = X_SEARCH.place_label(F.col("name"), F.col("country"), F.col("distance_km"), X_SEARCH.place_radius_km("population"))
    tags = F.transform("tags", lambda t: F.when(t == "tag3", "snow").otherwise(t))
    return p.select("*", *made, keywords).withColumn("tags", tags).join(J.dimension(near.select("lat", "lon", place.alias("place"))), ["lat", "lon"], "left")


def search_text(s, d):
    """What each of twelve searches finds: by name, caption, keyword, person, camera, subject, date, place, and words near a subject."""
    p = searched(s, d)
    # exploded, so that the filter behind is not worked out on the texts' expressions again
    x = p.select("id", "tags", F.explode(F.array(X_SEARCH.searched_texts(p.columns, LABELS_RO))).alias("texts"))
    found = F.concat_ws("|", *[F.when(X_SEARCH.found_in(n, F.col("texts")), F.lit(n)) for n in NEEDLES])
    return x.select("id", found.alias("found")).filter("found <> ''")


def search_first(s, d):
    """The first sixty photos that a search shows, the newest first."""
    p = searched(s, d)
    return p.filter(X_SEARCH.found_in("zăpadă", X_SEARCH.searched_texts(p.columns, LABELS_RO))).orderBy(F.coalesce("captured_at", F.lit(0)).desc(), "id").limit(60).select("id", "captured_at")


@query("real_gps", "select id, lat, lon from photos where lat is not null and lat between -90 and 90 and lon between -180 and 180 and not (lat = 0 and lon = 0)")
def real_gps(s, d):
    return photos(s, d, "id", "lat", "lon").filter(X.has_real_gps())


@query("bulk_reject_targets", f"select id from photos where not {DECIDED} and ai_score < 30")
def bulk_reject_targets(s, d):
    return P.bulk_reject_targets(photos(s, d, "id", "status", "ai_score"), 30).select("id")


@query("named_defects", f"select id from photos where {DEFECT}")
def named_defects(s, d):
    return photos(s, d).filter(P.has_defect()).select("id")


@query("decide_status", f"select id, case when ai_score <= 35 and known_face_count = 0 and {DEFECT} then 'rejected' when ai_score >= 65 and not (coalesce(text_coverage, 0) >= 0.15 or (face_count = 0 and not {SUBJECT_TAG})) and not coalesce(not subject_in_focus, false) then 'selected' else 'review' end as verdict from photos")
def decide_status(s, d):
    return photos(s, d).select("id", P.decide_status().alias("verdict"))


@query("smart_inbox", "+ c as (select id, case when face_count > 0 then 'personal' when coalesce(text_coverage, 0) >= 0.3 and greatest(width, height) / least(width, height) between 1.7 and 2.4 then 'screenshot' when coalesce(text_coverage, 0) >= 0.12 and len(tags) = 0 then 'document' else 'personal' end as category from photos) select category, count(*) as n, min(id) as first_id from c group by 1")
def smart_inbox(s, d):
    return photos(s, d).groupBy(P.inbox_category().alias("category")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@query("significance_top", f"select id, ai_score, {RANK} as subject from photos order by subject desc, ai_score desc, id limit 50")
def significance_top(s, d):
    return photos(s, d, "id", "ai_score", "text_coverage", "known_face_count", "face_count").select("id", "ai_score", P.subject_rank().alias("subject")).orderBy(F.desc("subject"), F.desc("ai_score"), "id").limit(50)


@query("rating_decision", "select id, case when rating >= 4 then true when rating between 1 and 2 then false end as decision from photos")
def rating_decision(s, d):
    return photos(s, d, "id", "rating").select("id", P.rating_decision().alias("decision"))


@query("scene_and_context", "select case when face_count = 0 then case when width >= height then 'landscape' else 'detail' end when face_count = 1 then 'portrait' when face_count >= 3 then 'group' when largest_face > 0.04 then 'portrait' else 'group' end as scene, scene_type || case when face_count = 0 then '' when stranger_count = 0 then ':known' when known_face_count = 0 then ':strangers' else ':mixed' end as context_key, count(*) as n from photos group by 1, 2")
def scene_and_context(s, d):
    from ..operators.scoring import context_key

    return photos(s, d, "face_count", "known_face_count", "stranger_count", "scene_type", "largest_face", "width", "height").groupBy(P.scene_of().alias("scene"), context_key().alias("context_key")).agg(F.count(F.lit(1)).alias("n"))


@query("deletable_rejected", "select (media_uri is not null and media_uri <> '') as deletable, count(*) as n from photos where status = 'rejected' group by 1")
def deletable_rejected(s, d):
    return P.deletable(photos(s, d, "id", "status", "media_uri")).groupBy("deletable").agg(F.count(F.lit(1)).alias("n"))


@query("deletion_risk", "select id, 1 - abs(ai_score - 50) / 50.0::double as risk from photos where status = 'rejected' and media_uri is not null order by risk desc, id limit 20")
def deletion_risk(s, d):
    return P.deletable(photos(s, d, "id", "status", "media_uri", "ai_score")).filter("deletable").select("id", X.uncertainty("ai_score").alias("risk")).orderBy(F.desc("risk"), "id").limit(20)


@query("most_uncertain", f"+ {CORRECTIONS_SQL} select id, ai_score from photos where status in ('selected', 'rejected') and 1 - abs(ai_score - 50) / 50.0::double >= 0.5 and id not in (select id from corrections) order by abs(ai_score - 50), id limit 12")
def most_uncertain(s, d):
    return J.most_uncertain(photos(s, d, "id", "status", "ai_score"), corrections(s, d)).select("id", "ai_score")


@query("agreement", "select count(*) as total, coalesce(avg(case when ai_decision = user_decision then 1.0::double else 0 end), 0) as agreement_rate from corrections", CORRECTIONS_SQL)
def agreement(s, d):
    return A.agreement(corrections(s, d))


@query("agreement_trend", "+ b as (select *, (ntile(6) over (order by ts, id) - 1)::int as bucket, count(*) over () as n_all from corrections) select bucket, count(*) as n, avg(case when ai_decision = user_decision then 1.0::double else 0 end) as agreement_rate from b where n_all >= 12 group by 1", CORRECTIONS_SQL)
def agreement_trend(s, d):
    return A.agreement_trend(corrections(s, d))


@query("accuracy", "+ r as (select *, row_number() over (order by ts desc, id desc) as r, (ai_decision = user_decision)::int::double as same from corrections) select count(*) as total, avg(user_decision::int::double) filter (ai_decision) as keep_precision, avg((not user_decision)::int::double) filter (not ai_decision) as reject_precision, avg(same) as agreement, case when count(*) >= 100 then avg(same) filter (r <= 50) end as recent, case when count(*) >= 100 then avg(same) filter (r between 51 and 100) end as earlier from r having count(*) >= 20", CORRECTIONS_SQL)
def accuracy(s, d):
    return A.accuracy(corrections(s, d))


@query("camera_facet", "select camera, count(*) as n from photos where camera is not null group by 1")
def camera_facet(s, d):
    return A.facet(photos(s, d, "camera"), "camera")


@query("tag_facet", "+ t as (select unnest(tags) as tag from photos) select tag, count(*) as n from t group by 1")
def tag_facet(s, d):
    return A.tag_facet(photos(s, d, "id", "tags")).select("tag", "n")


@query("top_tags", "+ t as (select id, unnest(tags) as tag, unnest(range(len(tags))) as pos from photos) select tag, count(*) as n from t group by 1 order by n desc, min(id * 10 + pos) limit 8")
def top_tags(s, d):
    return A.top_tags(photos(s, d, "id", "tags"))


@query("person_recognition", "+ f as (select unnest(persons) as person_id, (id * 7 % 50) / 100.0::double + 0.5 as similarity from photos) select person_id, count(*) as matches, round(avg(similarity), 9) as avg_similarity from f group by 1")
def person_recognition(s, d):
    faces = photos(s, d, "id", "persons").select(F.explode("persons").alias("person_id"), ((F.col("id") * 7 % 50) / F.lit(100.0) + 0.5).alias("similarity"))
    return A.person_recognition(faces).withColumn("avg_similarity", F.round("avg_similarity", 9))


DUPES = "+ g as (select dhash_key, size_bytes, count(*) as n, arg_min(id, {'a': (status <> 'selected')::int, 'b': coalesce(captured_at, 0), 'c': file_name, 'd': id}) as keep_id from photos where size_bytes > 0 group by 1, 2 having count(*) > 1)"


@query("exact_duplicates", DUPES + " select dhash_key, size_bytes, n, keep_id, size_bytes * (n - 1) as wasted_bytes from g")
def exact_duplicates(s, d):
    return A.exact_duplicates(photos(s, d, "id", "status", "captured_at", "file_name", "dhash_key", "size_bytes"))


@query("duplicate_summary", DUPES + " select count(*) as sets, cast(coalesce(sum(n - 1), 0) as bigint) as duplicates, cast(coalesce(sum(size_bytes * (n - 1)), 0) as bigint) as wasted_bytes from g")
def duplicate_summary(s, d):
    return A.duplicate_summary(exact_duplicates(s, d))


@query("duplicate_ids", DUPES + " select p.id, g.keep_id from photos p join g using (dhash_key, size_bytes) where p.id <> g.keep_id")
def duplicate_ids(s, d):
    return A.duplicate_ids(photos(s, d, "id", "dhash_key", "size_bytes"), exact_duplicates(s, d))


KEEP = f"+ k as (select group_id, arg_min(id, {{'a': (status <> 'selected')::int, 'b': -ai_score, 'c': id}}) as keep_id from photos where {SERIES} group by 1), r as (select k.group_id, k.keep_id, count(*) filter (not {DECIDED} and p.id <> k.keep_id) as n_reject from k join photos p on p.group_id = k.group_id group by 1, 2)"


@query("resolve_series", KEEP + " select * from r")
def resolve_series(s, d):
    return G.resolve_groups(photos(s, d, "id", "group_id", "status", "ai_score"))


@query("resolve_confident", KEEP + f", z as (select group_id, max(face_count) as faces, max(ai_score) filter (rn = 1) as a, max(ai_score) filter (rn = 2) as b from (select *, row_number() over (partition by group_id order by ai_score desc, id) as rn from photos where {SERIES}) group by 1) select r.*, ((b is null or a - b >= 10) and faces <= 3) as confident from r join z using (group_id)")
def resolve_confident(s, d):
    return G.resolve_with_confidence(photos(s, d, "id", "group_id", "status", "ai_score", "face_count"))


EYES_RATIO = "case when face_count > 1 then coalesce(group_eyes_open, all_eyes_open::int::double) else all_eyes_open::int::double end"
SMILE_RATIO = "case when face_count > 1 then coalesce(group_smile, best_smile) else best_smile end"
FRAME = f"0.35::double * (sharpness / 100 * case when coalesce(not subject_in_focus, false) then 0.6::double else 1.0::double end) + 0.18::double * (1 - abs(exposure - 50) / 50) + 0.07::double * (1 - least(1.0::double, coalesce(highlight_clipping, 0))) + 0.18::double * coalesce(composition_score, 0.5::double) + 0.15::double * (case when face_count > 0 then greatest(0, 0.5::double * ({SMILE_RATIO}) + 0.5::double * ({EYES_RATIO}) - coalesce(group_awkward, 0)) else 0.5::double end) + 0.07::double * coalesce(avg_eye_contact, 0.5::double)"
BEST = f"b as (select group_id, arg_min(id, {{'a': -round({FRAME}, 9), 'b': id}}) as keep_id, count(*) as n from photos where {SERIES} group by 1 having count(*) >= 2)"


@query("best_frames", f"+ {BEST} select * from b")
def best_frames(s, d):
    return G.best_frames(photos(s, d))


@query("highlights", f"+ c as (select id from photos where not {SERIES} union all select arg_min(id, {{'a': -ai_score, 'b': id}}) from photos where {SERIES} group by group_id) select id, ai_score from photos where id in (select id from c) order by {RANK} desc, ai_score desc, id limit (select greatest(1, cast(floor(count(*) * 10 / 100.0 + 0.5) as bigint)) from photos)")
def highlights(s, d):
    return G.highlights(photos(s, d, "id", "group_id", "ai_score", "text_coverage", "known_face_count", "face_count"))


@query("unresolved_series", f"select group_id, count(*) as n, count(*) filter (status <> 'rejected') as live from photos where {SERIES} group by 1 having count(*) > 1 and count(*) filter (status <> 'rejected') > 1")
def unresolved_series(s, d):
    return G.unresolved(photos(s, d, "group_id", "status"))


@query("decision_inversions", f"+ k as (select group_id, max(ai_score) as best from photos where {SERIES} and status = 'selected' group by 1) select p.id, p.group_id, p.ai_score - k.best as gap from photos p join k using (group_id) where p.status = 'rejected' and p.ai_score - k.best >= 15")
def decision_inversions(s, d):
    return G.inversions(photos(s, d, "id", "group_id", "status", "ai_score"))


@query("blinks", f"select id from photos p where face_count > 0 and not all_eyes_open and not exists (select 1 from photos q where q.group_id = p.group_id and q.group_id <> '' and q.face_count = p.face_count and q.all_eyes_open)")
def blinks(s, d):
    return G.blinks(photos(s, d, "id", "group_id", "face_count", "all_eyes_open")).select("id")


@query("blurry", "select id from photos p where sharpness < 45 and not coalesce(subject_in_focus, false) and not exists (select 1 from photos q where q.group_id = p.group_id and q.group_id <> '' and q.sharpness >= 60)")
def blurry(s, d):
    return G.blurry(photos(s, d, "id", "group_id", "sharpness", "subject_in_focus")).select("id")


@query("rescue_of_series", f"+ {BEST} select b.group_id, b.keep_id from b join (select group_id from photos where {SERIES} group by 1 having count(*) >= 2 and bool_and(status = 'rejected')) l using (group_id)")
def rescue_of_series(s, d):
    p = photos(s, d)
    return G.rescue_best(p, G.best_frames(p))


@query("status_after_grouping", f"+ {BEST}, l as (select group_id from photos where {SERIES} group by 1 having count(*) >= 2 and bool_and(status = 'rejected')) select p.id, case when (p.status = 'selected' and b.keep_id is not null and b.keep_id <> p.id) or (b.keep_id = p.id and l.group_id is not null) then 'review' else p.status end as status from photos p left join b on p.group_id = b.group_id left join l on p.group_id = l.group_id")
def status_after_grouping(s, d):
    p = photos(s, d)
    return G.after_grouping(p, G.best_frames(p))


STACK = "+ o as (select *, coalesce((captured_at - lag(captured_at) over (order by captured_at, id) > {gap})::int, 1) as brk from photos where captured_at is not null), m as (select *, sum(brk) over (order by captured_at, id rows unbounded preceding) as run from o), t as (select *, first_value(id) over (partition by run order by captured_at, id) as moment, count(*) over (partition by run) as size from m)"


@query("moment_stacks", STACK.format(gap=900000) + " select moment, count(*) as n, min(captured_at) as start_ms, max(captured_at) as end_ms, count(*) filter (status in ('pending', 'review')) as undecided from t where size >= 4 group by 1")
def moment_stacks(s, d):
    return G.moments(photos(s, d, "id", "captured_at", "status"))


@query("moment_top_picks", STACK.format(gap=300000) + f", o2 as (select moment, id, case when face_count = 0 and coalesce(text_coverage, 0) >= 0.12 and not (coalesce(text_coverage, 0) >= 0.3 and greatest(width, height) / least(width, height) between 1.7 and 2.4) and len(tags) = 0 then 0 when face_count > 0 then 2 else 1 end as r, ai_score, case when {SERIES} then group_id else 'solo:' || id end as ser from t where size >= 4), o3 as (select *, row_number() over (partition by moment, ser order by r desc, ai_score desc, id) as k from o2), o4 as (select *, row_number() over (partition by moment order by r desc, ai_score desc, id) as place from o3 where k = 1) select moment, id, place from o4 where place <= 3")
def moment_top_picks(s, d):
    return G.top_picks(photos(s, d), gap_ms=300_000)


@query("review_bands", f"+ q as (select coalesce(project, 'none') as project, id, ai_score, {HARD} as dif from photos where status = 'review'), b as (select *, row_number() over w - 1 as pos, case when dif < 0.35 then 'easy' when dif < 0.7 then 'compare' else 'hard' end as band from q window w as (partition by project order by id)), r as (select *, sum(coalesce((prev <> band)::int, 1)) over (partition by project order by pos) as run from (select *, lag(band) over (partition by project order by pos) as prev from b)) select project, band, min(pos) as start_index, count(*) as n from r group by project, run, band")
def review_bands(s, d):
    q = photos(s, d, "id", "project", "status", "ai_score", "ai_uncertainty").filter("status = 'review'").withColumn("project", F.coalesce("project", F.lit("none")))
    return G.review_bands(q, X.review_difficulty(), [F.col("id")], "project")


ROWS = f"""+ q as (select id, coalesce(project, 'none') as project, {HARD} as dif from photos where status = 'review'),
b as (select *, row_number() over (partition by project order by dif, id) - 1 as pos, case when dif < 0.35 then 'easy' when dif < 0.7 then 'compare' else 'hard' end as band from q),
r as (select *, sum(coalesce((prev <> band)::int, 1)) over (partition by project order by pos) as run from (select *, lag(band) over (partition by project order by pos) as prev from b)),
z as (select *, min(pos) over (partition by project, run) as first, count(*) over (partition by project, run) as n, max(run) over (partition by project) as bands from r),
f as (select *, max(case when n > 1 and bands > 1 then first else 0 end) over (partition by project order by pos) as since, (n > 1 and bands > 1 and pos = first) as head from z),
g as (select *, since + (pos - since) // 5 * 5 as row_start from f)
select id, project, row_start, pos - row_start as cell, case when head then band end as heading from g"""


@query("row_plan", ROWS)
def row_plan(s, d):
    """The review queue of each project, hardest last, in rows of five."""
    q = photos(s, d, "id", "project", "status", "ai_score", "ai_uncertainty").filter("status = 'review'").withColumn("project", F.coalesce("project", F.lit("none")))
    q = q.withColumn("difficulty", X.review_difficulty())
    return G.row_plan(q, F.col("difficulty"), [F.col("difficulty"), F.col("id")], "project", 5).select("id", "project", "row_start", "cell", "heading")


@query("series_percentile", f"+ g as (select id, count(*) over (partition by group_id) as n, rank() over (partition by group_id order by ai_score) - 1 as worse, count(*) over (partition by group_id, ai_score) as eq from photos where {SERIES}) select id, case when n >= 2 then cast(floor(((worse + (eq - 1) / 2) / (n - 1)) * 100 + 0.5) as bigint) end as series from g")
def series_percentile(s, d):
    return G.series_percentile(photos(s, d, "id", "group_id", "ai_score"))


@query("compare_in_series", f"+ g as (select p.id, p.sharpness, p.face_count, p.all_eyes_open, count(*) + 1 as frames, max(q.sharpness) as o, bool_or(coalesce(q.group_eyes_open, q.all_eyes_open::int::double) >= 1) as open, p.group_eyes_open from photos p join photos q on p.group_id = q.group_id and p.id <> q.id where p.group_id <> '' group by all), v as (select id, frames, case when face_count > 0 and coalesce(group_eyes_open, all_eyes_open::int::double) = 1 and not open then 'onlyEyesOpen' when sharpness >= o + 12 then 'sharpest' when o >= sharpness + 12 then 'softerThanSibling' end as verdict from g) select id, verdict, frames from v where verdict is not null")
def compare_in_series(s, d):
    return G.compare_in_series(photos(s, d, "id", "group_id", "sharpness", "face_count", "all_eyes_open", "group_eyes_open"))


@query("pillars", f"+ e as (select *, least(1.0::double, ({SHARP}) / 100) as s, coalesce(highlight_clipping, 0::double) as hi, shadow_clipping as lo, least(1::double, greatest(0::double, {EYES})) as eyes from photos), b as (select *, s * 0.4::double + (1 - least(1.0::double, abs(exposure - 50) / 30)) * 0.25::double + (1 - least(1.0::double, (hi + lo) / 0.2::double)) * 0.2::double as base from e) select id, cast(floor(round(case when face_count > 0 then base + eyes * 0.15::double else base / 0.85::double end * 100, 9) + 0.5) as bigint) as technical, cast(floor(round(greatest(0, 100 - ((1 - s) * 45 + case when coalesce(not subject_in_focus, false) then 25 else 0 end + case when face_count > 0 then (1 - eyes) * 25 else 0 end + least(1.0::double, hi / 0.2::double) * 20)), 9) + 0.5) as bigint) as delivery from b")
def pillars(s, d):
    t, v = G.pillars()
    return photos(s, d).select("id", t.alias("technical"), v.alias("delivery"))


@query("explain_choice", f"+ {BEST}, g as (select b.group_id, b.keep_id, count(*) as n, " + ", ".join(f"max(case when p.id {o} b.keep_id then {c} end) as {k}_{n}" for n, c in (("eyes", f"case when face_count > 0 then {EYES_RATIO} end"), ("smile", f"case when face_count > 0 then {SMILE_RATIO} end"), ("sharp", "sharpness"), ("score", "ai_score")) for k, o in (("k", "="), ("o", "<>"))) + ", max(case when p.id = b.keep_id then abs(exposure - 50) end) as k_err, min(case when p.id <> b.keep_id then abs(exposure - 50) end) as o_err from b join photos p using (group_id) group by 1, 2), r as (select *, list_filter([case when k_eyes = 1 and o_eyes < 1 then case when n = 2 then 'eyesOnlyOneOfTwo' else 'eyesOnlyOne' end when round(k_eyes - o_eyes, 9) >= 0.2 then 'eyesMore' end, case when k_sharp - o_sharp >= 10 then 'sharper' end, case when round(k_smile - o_smile, 9) >= 0.15 then 'smile' end, case when k_err + 8 <= o_err and o_err >= 15 then 'exposure' end], lambda x: x is not null) as l from g) select group_id, keep_id, case when len(l) > 0 then array_to_string(l, ',') when k_score - o_score >= 4 then 'score' else 'tooClose' end as reasons, case when len(l) > 0 or k_score - o_score >= 4 then 'high' else 'low' end as confidence from r")
def explain_choice(s, d):
    p = photos(s, d)
    return G.explain_choice(p, G.best_frames(p))


FIX = {"exposure": "abs(exposure - 50) >= 18", "highlights": "coalesce(highlight_clipping, 0) > 0.06", "shadows": "shadow_clipping > 0.06", "straighten": "abs(coalesce(horizon_tilt, 0)) > 2", "crop": "face_count > 0 and coalesce(thirds, 0.5) < 0.4"}


@query("rescue_queue", "+ q as (select id, list_filter([" + ", ".join(f"case when {v} then '{k}' end" for k, v in FIX.items()) + "], lambda x: x is not null) as f, least(" + " + ".join(f"case when {v} then {G.GAINS[k]} else 0 end" for k, v in FIX.items()) + ", 100 - ai_score) as gain from photos where status <> 'selected' and sharpness >= 45) select id, array_to_string(f, ',') as fixes, len(f)::int as n_fixes, gain from q where len(f) > 0 and gain > 0")
def rescue_queue(s, d):
    return G.rescue_queue(photos(s, d))


EXPORTS = """+ n as (select id, coalesce(project, 'none') as folder, captured_at, 'f' || (id % 5) || case when id % 37 = 0 then ' (2)' when id % 41 = 0 then ' (2) (2)' when id % 43 = 0 then ' (3)' else '' end || '.jpg' as fn from photos),
o as (select id, folder, row_number() over (partition by folder order by captured_at, id) as seq, row_number() over (partition by folder, left(fn, 2) order by captured_at, id) as turn, fn, left(fn, 2) as family from n),
w as (
  select folder, family, 0::bigint as turn, cast([] as varchar[]) as used, null::varchar as out_name
  from o group by folder, family
  union all
  select w.folder, w.family, o.turn, list_append(w.used, x.name), x.name
  from w join o on o.folder = w.folder and o.family = w.family and o.turn = w.turn + 1,
  lateral (select case when not list_contains(w.used, o.fn) then o.fn else left(o.fn, -4) || ' (' || (select min(k) from unnest(range(2, len(w.used) + 3)) u(k) where not list_contains(w.used, left(o.fn, -4) || ' (' || k || ').jpg')) || ').jpg' end as name) x)
select o.id, o.seq, w.out_name from w join o using (folder, family, turn)"""


@query("export_sequence", EXPORTS, "recursive " + PHOTOS_SQL)
def export_sequence(s, d):
    """Names that clash, some of them with brackets that are numbers of others."""
    name = F.concat(F.lit("f"), (F.col("id") % 5).cast("string"), F.expr("case when id % 37 = 0 then ' (2)' when id % 41 = 0 then ' (2) (2)' when id % 43 = 0 then ' (3)' else '' end"), F.lit(".jpg"))
    p = photos(s, d, "id", "project", "captured_at").select("id", "captured_at", F.coalesce("project", F.lit("none")).alias("folder"), name.alias("file_name"))
    return G.sequence_numbers(p, "folder", [F.col("captured_at"), F.col("id")]).select("id", "seq", "out_name")


@query("resumable_projects", f"+ g as (select project, count(*) as total, count(*) filter ({DECIDED}) as decided from photos where nullif(trim(project), '') is not null group by 1) select project, total, decided, total - decided as remaining, cast(floor(decided / total * 100 + 0.5) as bigint) as percent from g where total - decided >= 3 and floor(decided / total * 100 + 0.5) >= 10")
def resumable_projects(s, d):
    return A.resumable_projects(photos(s, d, "project", "status"))


@query("memories", "select year(make_timestamp(captured_at * 1000)) as year, count(*) as n, 2026 - year(make_timestamp(captured_at * 1000)) as years_ago from photos where month(make_timestamp(captured_at * 1000)) = 1 and day(make_timestamp(captured_at * 1000)) = 9 and year(make_timestamp(captured_at * 1000)) < 2026 group by 1")
def memories(s, d):
    return A.memories(photos(s, d, "captured_at"), 2026, 1, 9)


@query("import_streak", "+ d as (select distinct cast(make_timestamp(captured_at * 1000) as date) as day from photos where cast(make_timestamp(captured_at * 1000) as date) <= date '2024-01-20'), r as (select day, day - cast(row_number() over (order by day) as int) as run from d), g as (select run, max(day) as last, count(*) as n from r group by 1) select coalesce(arg_max(n, last), 0) as streak from g where date '2024-01-20' - last <= 1")
def import_streak(s, d):
    return A.import_streak(photos(s, d, "captured_at").select(F.to_date(F.timestamp_millis("captured_at")).alias("day")), "2024-01-20")


@query("feedback_summary", "+ f as (select case id % 5 when 0 then 'wrongPick' when 1 then 'tooSlow' when 2 then 'other' when 3 then 'bogus' else 'wrongReject' end as reason, case when id % 3 = 0 then null else ai_score end as score from photos) select reason, count(*) as n, cast(floor(avg(score) + 0.5) as bigint) as avg_score, cast(list_position(['wrongPick', 'missedDuplicate', 'missedClosedEyes', 'wrongReject', 'tooSlow', 'other'], reason) as bigint) as tie from f where reason <> 'bogus' group by 1")
def feedback_summary(s, d):
    e = photos(s, d, "id", "ai_score").selectExpr("case id % 5 when 0 then 'wrongPick' when 1 then 'tooSlow' when 2 then 'other' when 3 then 'bogus' else 'wrongReject' end as reason", "case when id % 3 = 0 then null else ai_score end as score")
    return A.feedback_summary(e, ["wrongPick", "missedDuplicate", "missedClosedEyes", "wrongReject", "tooSlow", "other"])


@query("outcome_summary", "+ o as (select user_id as ts, count(*) as total, count(*) filter (status = 'rejected') as failed, count(*) filter (status = 'pending') as skipped, case when user_id % 3 = 0 then null else 'r' || user_id end as reasons from photos group by user_id) select count(*) as imports, cast(sum(total) as bigint) as photos, cast(sum(failed) as bigint) as failed, cast(sum(skipped) as bigint) as skipped, arg_max(reasons, ts) filter (reasons is not null) as last_reason, cast(floor(sum(failed) / sum(total) * 100 + 0.5) as bigint) as failure_rate from o")
def outcome_summary(s, d):
    o = photos(s, d, "user_id", "status").groupBy(F.col("user_id").alias("ts")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "rejected").alias("failed"), F.count_if(F.col("status") == "pending").alias("skipped"))
    return A.outcome_summary(o.withColumn("reasons", F.when(F.col("ts") % 3 != 0, F.concat(F.lit("r"), F.col("ts").cast("string")))))


@query("stage_stats", "+ r as (select status as stage, ai_score as ms, row_number() over (partition by status order by ai_score) as r, count(*) over (partition by status) as n from photos) select stage, count(*) as n, cast(sum(ms) as bigint) as total, avg(ms) as mean, max(ms) filter (r = floor(0.5 * (n - 1) + 0.5) + 1) as p50, max(ms) filter (r = floor(0.9::double * (n - 1) + 0.5) + 1) as p90 from r group by 1")
def stage_stats(s, d):
    return A.stage_stats(photos(s, d, "status", "ai_score").toDF("stage", "ms"))


@query("habits", "+ d as (select (status = 'selected')::int as kept, hour(make_timestamp(captured_at * 1000)) as h, tags, focal from photos where status in ('selected', 'rejected')), k as (select kept, 'time' as kind, case when h between 5 and 11 then 'morning' when h between 12 and 16 then 'midday' when h between 17 and 21 then 'evening' else 'night' end as key from d union all select kept, 'focal', case when focal < 24 then 'wide' when focal > 60 then 'tele' else 'normal' end from d where focal is not null union all select kept, 'subject', unnest(list_distinct(tags)) from d), b as (select avg(kept) as baseline, count(*) as n_all from d), g as (select kind, key, avg(kept) as keep_rate, count(*) as n from k group by 1, 2), r as (select *, row_number() over (partition by kind order by abs(keep_rate - baseline) desc, key) as r from g, b where n_all >= 40 and n >= 15 and abs(keep_rate - baseline) >= 0.002) select kind, key, keep_rate, baseline, n from r where r = 1 order by abs(keep_rate - baseline) desc, kind limit 3")
def habits(s, d):
    p = photos(s, d, "status", "captured_at", "tags", "focal").filter("status in ('selected', 'rejected')")
    return A.habits(p.withColumn("kept", F.col("status") == "selected"), deviation=0.002)


TAGS = "+ d as (select (status = 'selected')::int as kept, list_distinct(tags) as tags from photos where status in ('selected', 'rejected') and len(tags) > 0), a as (select sum(kept)::bigint as kept_total, sum(1 - kept)::bigint as rejected_total from d), u as (select kept, unnest(tags) as tag from d), m as (select tag, sum(kept)::bigint as kept, sum(1 - kept)::bigint as rejected, any_value(kept_total) as kept_total, any_value(rejected_total) as rejected_total from u, a group by 1)"


@query("tag_memory", TAGS + " select * from m")
def tag_memory(s, d):
    p = photos(s, d, "status", "tags").filter("status in ('selected', 'rejected')")
    return A.tag_memory(p.withColumn("kept", F.col("status") == "selected"))


@query("tag_affinity", TAGS + ", t as (select id, unnest(tags) as tag from photos) select id, round(0.5 + 0.5 * tanh(avg(ln(((kept + 1) / (kept_total + 2)) / ((rejected + 1) / (rejected_total + 2))))), 9) as affinity from t join m using (tag) where kept_total >= 8 and rejected_total >= 8 and kept + rejected >= 3 group by 1")
def tag_affinity(s, d):
    return A.tag_affinity(photos(s, d, "id", "tags"), tag_memory(s, d)).withColumn("affinity", F.round("affinity", 9))


@query("usage_window", "select count(*) as used from photos where (captured_at // 3600000) * 3600000 > 1705000000000 - 5 * 86400000 and (captured_at // 3600000) * 3600000 <= 1705000000000 + 3600000")
def usage_window(s, d):
    return A.usage_window(photos(s, d, "captured_at").toDF("at_ms"), 1_705_000_000_000, 5)


@query("monthly_usage", "select strftime(make_timestamp(captured_at * 1000), '%Y-%m') as month, count(*) as n from photos group by 1")
def monthly_usage(s, d):
    return A.monthly_usage(photos(s, d, "captured_at").toDF("at_ms"))


@query("score_thresholds", "+ r as (select ai_score as s, row_number() over (order by ai_score) - 1 as i, count(*) over () as n from photos), g as (select max(n) as n, count(*) filter (s >= 65) as hi, count(*) filter (s <= 35) as lo, max(s) filter (i = least(n - 1, floor(n * (1 - 0.2::double)))) as q_hi, max(s) filter (i = greatest(0, ceil(n * 0.2::double) - 1)) as q_lo from r), t as (select case when n >= 150 and (hi / n < 0.06 or hi / n > 0.5) then greatest(55, least(78, q_hi)) else 65 end as select_at, case when n >= 150 and (lo / n < 0.06 or lo / n > 0.5) then greatest(22, least(45, q_lo)) else 35 end as reject_at from g) select *, (select_at <> 65 or reject_at <> 35) as adapted from t")
def score_thresholds(s, d):
    return A.thresholds(photos(s, d, "ai_score"))


@query("home_counters", f"select count(*) as photos, count(*) filter (not {DECIDED}) as undecided, count(*) filter (status = 'selected') as kept, count(*) filter (face_count > 0) as with_faces, count(distinct coalesce(captured_at, 0) // 86400000) as days, cast(sum(size_bytes) as bigint) as bytes from photos")
def home_counters(s, d):
    return A.home_counters(photos(s, d, "status", "face_count", "captured_at", "size_bytes"))


@query("top_percent", f"+ o as (select id, row_number() over (order by {RANK} desc, ai_score desc, id) as r, count(*) over () as n from photos where not {DECIDED}) select id, case when r <= floor(n * 15 / 100.0 + 0.5) then 'selected' else 'rejected' end as status from o")
def top_percent(s, d):
    p = photos(s, d, "id", "status", "ai_score", "text_coverage", "known_face_count", "face_count")
    return J.top_percent(p, 15, [(-P.subject_rank()).alias("a"), (-F.col("ai_score")).alias("b"), F.col("id")])


@query("monthly_recap", f"+ e as (select id, row_number() over (order by {RANK} desc, ai_score desc, id) as r, count(*) over () as n from photos where captured_at >= 1706000000000 - 2592000000 and status <> 'rejected') select id from e where r <= least(40, case when n <= 5 then n else greatest(5, ceil(n / 3.0)) end)")
def monthly_recap(s, d):
    p = photos(s, d).filter("captured_at >= 1706000000000 - 2592000000 and status <> 'rejected'")
    n = p.count()
    return p.orderBy(P.subject_rank().desc(), F.desc("ai_score"), "id").limit(min(40, n if n <= 5 else max(5, -(-n // 3)))).select("id")


@query("grid_sort", "select id, captured_at from photos order by coalesce(captured_at, 0) desc, id limit 100")
def grid_sort(s, d):
    return photos(s, d, "id", "captured_at").orderBy(F.coalesce("captured_at", F.lit(0)).desc(), "id").limit(100)


@query("group_persons", f"+ u as (select group_id, unnest(persons) as p from photos where {SERIES}) select group_id, count(distinct p) as n, min(p) as first_name from u group by 1")
def group_persons(s, d):
    g = G.series(photos(s, d, "group_id", "persons")).select("group_id", F.explode("persons").alias("p"))
    return g.groupBy("group_id").agg(F.count_distinct("p").alias("n"), F.min("p").alias("first_name"))


@query("home_anchor", "+ g as (select floor(lat / 0.5) as a, floor(lon / 0.5) as b, count(*) as n, avg(lat) as la, avg(lon) as lo, min(id) as f from photos where lat is not null group by 1, 2) select round(la, 9) as home_lat, round(lo, 9) as home_lon from g order by n desc, f limit 1")
def home_anchor(s, d):
    return J.home_anchor(photos(s, d, "id", "lat", "lon").filter(X.has_real_gps())).select(F.round("home_lat", 9).alias("home_lat"), F.round("home_lon", 9).alias("home_lon"))


PLACES = "places as (select n_nationkey as ordinal, n_name as name, 44 + (n_nationkey % 10) * 0.21::double as lat, 25 + (n_nationkey % 5) * 0.17::double as lon, upper(n_name[1:2]) as country, n_nationkey * 2000 as population from nation)"


def gazetteer(s, d):
    """Places with their country and population, made from the nations."""
    return s.read.parquet(f"{d}/nation.parquet").selectExpr("n_nationkey as ordinal", "n_name as name", "44 + (n_nationkey % 10) * 0.21D as lat", "25 + (n_nationkey % 5) * 0.17D as lon", "upper(substring(n_name, 1, 2)) as country", "n_nationkey * 2000 as population")


query("search_text", search_sql())(search_text)
query("search_first", search_sql().replace("select id, array_to_string(found, '|') as found from f where len(found) > 0", "select f.id, photos.captured_at from f join photos on f.id = photos.id where list_contains(found, 'zăpadă') order by coalesce(photos.captured_at, 0) desc, f.id limit 60"))(search_first)


@query("nearest_place", f"+ {PLACES}, j as (select p.id, q.name, p.lat, p.lon, q.lat as plat, q.lon as plon, power(q.lat - p.lat, 2) + power((q.lon - p.lon) * cos(radians(p.lat)), 2) as s, q.ordinal from photos p join places q on q.lat >= p.lat - 30.0::double / 110.574::double and q.lat < p.lat + 30.0::double / 110.574::double), b as (select *, row_number() over (partition by id order by s, plat, ordinal) as r, power(sin((radians(plat) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(plat)) * power(sin(radians(plon - lon) / 2), 2) as h from j) select id, name from b where r = 1 and 12742.0::double * atan2(sqrt(h), sqrt(1 - h)) <= 30")
def nearest_place(s, d):
    return J.nearest_place(photos(s, d, "id", "lat", "lon"), gazetteer(s, d)).select("id", "name")


@query("time_band_pairs", "select p.id as a, q.id as b from photos p join photos q on p.user_id = q.user_id and p.id < q.id and abs(p.captured_at - q.captured_at) <= 480000")
def time_band_pairs(s, d):
    return J.time_band_pairs(photos(s, d, "id", "captured_at", "user_id"), 480_000, by="user_id")


@query("client_feedback", "+ f as (select id as ordinal, case when id % 2 = 0 then id * 3 end as photo_id, 'IMG_' || lpad(cast((id * 5) % 99991 as varchar), 7, '0') || '.jpg' as file_name, case when id % 3 = 0 then 'yes' else 'no' end as verdict from photos), m as (select ordinal, photo_id as id, verdict from f where photo_id in (select id from photos) union all select ordinal, p.id, verdict from f join photos p on p.file_name = f.file_name where f.photo_id is null or f.photo_id not in (select id from photos)) select id, arg_min(verdict, ordinal) as verdict from m group by 1")
def client_feedback(s, d):
    """An entry for every photo."""
    return J.apply_feedback(feedback(s, d), photos(s, d, "id", "file_name"))


def feedback(s, d):
    """ordinal, photo_id, file_name, verdict: an entry made from each photo."""
    return photos(s, d, "id").selectExpr("id as ordinal", "case when id % 2 = 0 then id * 3 end as photo_id", "concat('IMG_', lpad(cast((id * 5) % 99991 as string), 7, '0'), '.jpg') as file_name", "case when id % 3 = 0 then 'yes' else 'no' end as verdict")


@query("restore_backup", "+ b as (select file_name, captured_at, case when id % 4 = 0 then 'candidate' when id % 4 = 1 then 'selected' else status end as ns, rating as nr from photos where id % 2 = 1 or id % 4 = 0) select p.id, b.ns as new_status, b.nr as new_rating from photos p join b using (file_name, captured_at) where b.ns in ('selected', 'rejected', 'review', 'pending') and (p.status is distinct from b.ns or p.rating is distinct from b.nr)")
def restore_backup(s, d):
    p = photos(s, d, "id", "file_name", "captured_at", "status", "rating")
    b = p.filter("id % 2 = 1 or id % 4 = 0").withColumn("status", F.expr("case when id % 4 = 0 then 'candidate' when id % 4 = 1 then 'selected' else status end"))
    return J.restore(b, p)


@query("set_status_upsert", "select id, case when ai_score < 20 and status = 'pending' then 'rejected' else status end as status from photos")
def set_status_upsert(s, d):
    p = photos(s, d, "id", "status", "ai_score")
    return J.upsert(p.select("id", "status"), p.filter("ai_score < 20 and status = 'pending'").select("id", F.lit("rejected").alias("status")))


@query("collections_members", "+ c as (select 'c' || user_id % 6 as name, id from photos) select name, count(distinct id) as n from c group by 1")
def collections_members(s, d):
    c = photos(s, d, "id", "user_id").select(F.concat(F.lit("c"), (F.col("user_id") % 6).cast("string")).alias("name"), F.array("id").alias("member_ids"))
    return J.union_of_members(c).select("name", F.size("member_ids").cast("long").alias("n"))


@query("without_vault", "select id from photos where user_id % 6 <> 2")
def without_vault(s, d):
    p = photos(s, d, "id", "user_id")
    c = p.select(F.concat(F.lit("c"), (F.col("user_id") % 6).cast("string")).alias("name"), (F.col("user_id") % 6 == 2).alias("is_private"), F.array("id").alias("member_ids"))
    return J.without_vault(p, c).select("id")


@query("export_names", "select id, replace(coalesce(project, 'none'), '/', '-') || '-' || lpad(cast(id as varchar), greatest(3, len(cast(id as varchar)))::int, '0') as out_name from photos")
def export_names(s, d):
    return photos(s, d, "id", "project").select("id", X.expand_template("{project}-{seq}", {"project": F.coalesce("project", F.lit("none")), "seq": X.zero_pad("id")}).alias("out_name"))
