"""Joins of library tables, and the set operations on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import haversine_km
from .filters import is_decided, uncertain
from .ranks import ranked

#: Rows up to which a dimension is broadcast; it is counted first.
BROADCAST_ROWS = 100_000


def dimension(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a table only if a bounded count shows that it is small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def multi_get(ids: DataFrame, table: DataFrame) -> DataFrame:
    """ids (pos, id) with their rows, misses as nulls; in the order of pos if sorted by it."""
    return ids.join(table, "id", "left")


def corrections_view(corrections: DataFrame, photos: DataFrame, analyses: DataFrame) -> DataFrame:
    return corrections.join(photos, "id").join(analyses, "id", "left")


def apply_feedback(feedback: DataFrame, photos: DataFrame) -> DataFrame:
    """Client feedback (ordinal, photo_id, file_name, verdict) matched by id, else by file name; the first entry of a photo wins."""
    by_id = feedback.join(photos.select(F.col("id").alias("photo_id"), F.col("id").alias("_hit")), "photo_id")
    rest = feedback.join(by_id.select("ordinal"), "ordinal", "left_anti")
    by_name = rest.join(photos.select("file_name", F.col("id").alias("_hit")), "file_name")
    both = by_id.select("ordinal", "_hit", "verdict").unionByName(by_name.select("ordinal", "_hit", "verdict"))
    return both.groupBy(F.col("_hit").alias("id")).agg(F.min_by("verdict", "ordinal").alias("verdict"))


def restore(backup: DataFrame, photos: DataFrame) -> DataFrame:
    """Rows to update: equal file name and time, and status or rating that differ. Only final states are restored."""
    b = backup.filter(F.col("status").isin("selected", "rejected", "review", "pending")).select("file_name", F.coalesce("captured_at", F.lit(0)).alias("_at"), F.col("status").alias("new_status"), F.col("rating").alias("new_rating"))
    p = photos.select("id", "file_name", F.coalesce("captured_at", F.lit(0)).alias("_at"), "status", "rating")
    return p.join(b, ["file_name", "_at"]).filter(~(F.col("status").eqNullSafe(F.col("new_status")) & F.col("rating").eqNullSafe(F.col("new_rating")))).select("id", "new_status", "new_rating")


def most_uncertain(photos: DataFrame, corrections: DataFrame, k: int = 12) -> DataFrame:
    """Machine-decided photos near 50 that nobody has corrected."""
    p = photos.filter(F.col("status").isin("selected", "rejected") & uncertain())
    return p.join(corrections.select("id").distinct(), "id", "left_anti").orderBy(F.abs(F.col("ai_score") - 50), "id").limit(k)


def in_collection(photos: DataFrame, collections: DataFrame, name: str) -> DataFrame:
    ids = collections.filter(F.col("name") == name).select(F.explode("member_ids").alias("id"))
    return photos.join(ids, "id", "left_semi")


def without_vault(photos: DataFrame, collections: DataFrame, unlocked: bool = False) -> DataFrame:
    if unlocked:
        return photos
    return photos.join(collections.filter("is_private").select(F.explode("member_ids").alias("id")), "id", "left_anti")


def with_projects(photos: DataFrame, projects: DataFrame) -> DataFrame:
    return photos.join(dimension(projects), "project", "left")


def scoped_queue(ids: DataFrame, photos: DataFrame) -> DataFrame:
    """Photos of a list of ids, with their position in it."""
    return ids.select(F.posexplode("ids").alias("pos", "id")).join(photos, "id")


def new_folders(folders: DataFrame, imported: DataFrame, excluded: DataFrame) -> DataFrame:
    return folders.join(imported, "folder", "left_anti").join(excluded, "folder", "left_anti")


def related_tags(tags: DataFrame, synonyms: DataFrame, query: str) -> DataFrame:
    """Tags of the dictionary's rows (word, tag) whose word begins with the query or begins it; from three letters on."""
    if len(query) < 3:
        return tags.limit(0)
    q = F.lit(query.lower())
    hit = dimension(synonyms.filter(F.startswith("word", q) | F.startswith(q, F.col("word"))).select("tag").distinct())
    return tags.join(hit, "tag", "left_semi")


def relabel(faces: str, mapping: DataFrame, analyses: DataFrame) -> DataFrame:
    """person_id of every face by a mapping (old_id, new_id); a null new_id clears it. The mapping is one row of a map, checked to be small."""
    if mapping.limit(10_001).count() > 10_000:
        raise ValueError("a relabel mapping has at most 10 000 persons")
    m = mapping.agg(F.map_from_entries(F.collect_list(F.struct("old_id", "new_id"))).alias("_m"))
    new = F.transform(faces, lambda f: f.withField("person_id", F.when(F.map_contains_key("_m", f["person_id"]), F.element_at("_m", f["person_id"])).otherwise(f["person_id"])))
    return analyses.crossJoin(F.broadcast(m)).withColumn(faces, new).drop("_m")


def merged_profiles(profiles: DataFrame, most: int = 60) -> DataFrame:
    """target, embeddings: profiles (target, ordinal, embeddings) that become one person; of each its last vectors, as many as all of them may have, so that none is lost; the last ``most`` in all."""
    n = profiles.groupBy("target").agg(F.count(F.lit(1)).alias("_n"))
    newest = Window.partitionBy("target").orderBy(F.desc("ordinal"))
    p = profiles.join(n, "target").withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= most)  # a profile gives one vector at least
    cap = F.greatest(F.lit(1), F.floor(F.lit(most) / F.col("_n"))).cast("int")
    size = F.size("embeddings")
    own = F.when(size > 0, F.slice("embeddings", F.greatest(F.lit(1), size - cap + 1), cap)).otherwise(F.col("embeddings"))
    g = p.withColumn("_own", own).groupBy("target").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "_own"))), lambda x: x["_own"])).alias("all"))
    return g.select("target", F.slice("all", F.greatest(F.lit(1), F.size("all") - most + 1), F.lit(most)).alias("embeddings"))


def nearest_place(photos: DataFrame, places: DataFrame, km: float = 30.0) -> DataFrame:
    """id, the place's columns, distance_km: the place with the smallest planar score in a latitude band, if the great circle is at most ``km``. It is looked for once for each spot (lat, lon)."""
    near = places_of_spots(photos, places, km)
    return photos.select("id", "lat", "lon").join(dimension(near), ["lat", "lon"]).drop("lat", "lon")


def places_of_spots(photos: DataFrame, places: DataFrame, km: float = 30.0) -> DataFrame:
    """lat, lon, the place's columns, distance_km: the nearest place (see ``nearest_place``) of every different spot of the photos that has one.

    Spots and places (name, lat, lon, ordinal and others) meet in cells of
    latitude, as wide as the band, and of longitude, at least twice as wide in
    every row of cells, so one city is one cell's; where a row is too near to a
    pole it is one cell. The score picks, the distance only gates. Longitudes
    wrap at the antimeridian."""
    band = km / 110.574
    wide = 2 * band
    row = lambda lat: F.floor(lat / band)

    def scale(r: Column) -> Column:
        """Degrees of latitude that a degree of longitude is worth at the row's edge nearer to a pole."""
        edge = F.cos(F.radians(F.least(F.greatest(F.abs(r), F.abs(r + 1)) * band, F.lit(90.0))))
        return F.when(edge < 4 * wide / 360, 0.0).otherwise(edge)

    column = lambda lon, r: F.floor((lon + 180) * scale(r) / wide)
    rest = [c for c in places.columns if c not in ("name", "lat", "lon", "ordinal")]
    p = places.select("name", F.col("lat").alias("plat"), F.col("lon").alias("plon"), "ordinal", *rest)
    near = p.withColumn("_r", F.explode(F.array(*[row(F.col("plat")) + d for d in (-1, 0, 1)])))
    near = near.withColumn("_turn", F.explode(F.array_compact(F.array(F.lit(0), F.when((F.col("plon") - 180) * scale(F.col("_r")) > -2 * wide, -360), F.when((F.col("plon") + 180) * scale(F.col("_r")) < 2 * wide, 360)))))
    near = near.withColumn("_c", F.explode(F.array_distinct(F.array(*[column(F.col("plon") + F.col("_turn"), F.col("_r")) + d for d in (-1, 0, 1)]))))
    q = photos.filter("lat is not null and lon is not null").select("lat", "lon").distinct().withColumn("_r", row(F.col("lat")))
    q = q.withColumn("_c", column(F.col("lon"), F.col("_r")))
    d = F.col("plon") - F.col("lon")
    d = F.when(d > 180, d - 360).when(d < -180, d + 360).otherwise(d) * F.cos(F.radians("lat"))
    j = q.join(near.drop("_turn"), ["_r", "_c"]).filter((F.col("plat") >= F.col("lat") - band) & (F.col("plat") < F.col("lat") + band))
    j = j.withColumn("_score", F.pow(F.col("plat") - F.col("lat"), F.lit(2.0)) + F.pow(d, F.lit(2.0)))
    best = j.groupBy("lat", "lon").agg(F.min_by(F.struct("name", "plat", "plon", *rest), F.struct("_score", "plat", "ordinal")).alias("b"))
    return best.select("lat", "lon", "b.name", *[f"b.{c}" for c in rest], haversine_km("lat", "lon", "b.plat", "b.plon").alias("distance_km")).filter(F.col("distance_km") <= km)


def home_anchor(photos: DataFrame, cell: float = 0.5) -> DataFrame:
    """home_lat, home_lon: mean of the densest cell; of equal ones the first seen."""
    g = photos.groupBy(F.floor(F.col("lat") / cell).alias("a"), F.floor(F.col("lon") / cell).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.avg("lat").alias("home_lat"), F.avg("lon").alias("home_lon"), F.min("id").alias("_first"))
    return g.agg(F.max_by(F.struct("home_lat", "home_lon"), F.struct("n", (-F.col("_first")).alias("o"))).alias("h")).select("h.*")


def time_band_pairs(photos: DataFrame, window_ms: int, by: str | None = None) -> DataFrame:
    """a < b within ``window_ms`` of each other, by an equi join on time buckets of that width and their neighbours."""
    keys = [by] if by else []
    p = photos.filter("captured_at is not null").select("id", "captured_at", *keys).withColumn("_b", F.expr(f"captured_at div {window_ms}"))
    x = p.select(F.col("id").alias("a"), F.col("captured_at").alias("ta"), *keys, F.explode(F.array(F.col("_b"), F.col("_b") + 1)).alias("_b"))
    y = p.select(F.col("id").alias("b"), F.col("captured_at").alias("tb"), *keys, "_b")
    near = x.join(y, ["_b", *keys]).filter((F.abs(F.col("ta") - F.col("tb")) <= window_ms) & (F.col("a") != F.col("b")))
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def union_of_members(collections: DataFrame) -> DataFrame:
    """One row per collection name: all members once."""
    return collections.groupBy("name").agg(F.array_distinct(F.flatten(F.collect_list("member_ids"))).alias("member_ids"))


def add_members(members: str, more: Column) -> Column:
    return F.array_union(members, more)


def remove_members(members: str, gone: Column) -> Column:
    return F.array_except(members, gone)


def upsert(base: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """A new snapshot: rows of ``changes`` win (columns that it lacks are kept), new keys are added."""
    both = base.join(changes.select(key, F.struct(*[c for c in changes.columns if c != key]).alias("_new"), F.lit(True).alias("_hit")), key, "full")
    cols = [F.when(F.col("_hit"), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in changes.columns and c != key else F.col(c) for c in base.columns]
    return both.select(*cols)


def delete(base: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    return base.join(gone.select(key), key, "left_anti")


def undo_newest(base: DataFrame, history: DataFrame) -> DataFrame:
    """Undo the newest batch of a history (batch, ts, id, previous): the earlier statuses come back."""
    newest = history.agg(F.max_by("batch", "ts").alias("batch"))
    old = history.join(F.broadcast(newest), "batch").groupBy("id").agg(F.min_by("previous", "ts").alias("status"))
    return upsert(base, old)


def keep_in_groups(photos: DataFrame, kept: DataFrame) -> DataFrame:
    """id, status of all frames of the groups in ``kept`` (group_id, id; one or several for each): those are selected, the others rejected."""
    g = photos.filter("coalesce(group_id, '') <> ''").join(kept.select("group_id").distinct(), "group_id", "left_semi")
    k = kept.select(F.col("id").alias("_kept")).distinct()
    return g.join(k, F.col("id") == F.col("_kept"), "left").select("id", "group_id", F.when(F.col("_kept").isNotNull(), "selected").otherwise("rejected").alias("status"))


def choices_of(decided: DataFrame) -> DataFrame:
    """winner_id, loser_id, pos: each kept frame against the rejected ones of its group (id, group_id, status); what a learner takes as choices."""
    w = decided.filter("status = 'selected'").select("group_id", F.col("id").alias("winner_id"))
    return w.join(decided.filter("status = 'rejected'").select("group_id", F.col("id").alias("loser_id")), "group_id").select("winner_id", "loser_id", F.col("loser_id").alias("pos"))


def bulk_set(photos: DataFrame, chosen: DataFrame, **values: Column) -> DataFrame:
    """A new snapshot in which the chosen (id) have other values in some columns; ratings are held within 0 and 5."""
    if "rating" in values:
        values["rating"] = F.greatest(F.lit(0), F.least(F.lit(5), F.floor(values["rating"] + 0.5))).cast("int")
    j = photos.join(chosen.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    return j.select(*[F.when(F.col("_hit"), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in photos.columns])


def top_percent(photos: DataFrame, percent: float, order: list[Column]) -> DataFrame:
    """id, status of the undecided: the first percent of them by ``order`` selected, the rest rejected."""
    p = photos.filter(~is_decided())
    k = int(p.count() * percent / 100 + 0.5)
    return ranked(p, order).select("id", F.when(F.col("place") <= k, "selected").otherwise("rejected").alias("status"))


def last_of_log(log: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """The newest k rows (ts, id), for each key or in all."""
    if not by:
        return log.orderBy(F.desc("ts"), F.desc("id")).limit(k)
    w = Window.partitionBy(*by).orderBy(F.desc("ts"), F.desc("id"))
    return log.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")
