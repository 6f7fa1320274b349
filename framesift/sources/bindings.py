"""Photo-library tables bound to the driver's event tables.

``photos`` derives a wide photo view from ``events`` by integer expressions
that Spark and DuckDB evaluate alike; PHOTOS_SQL is the same as a common table
expression. ``photo_view`` builds the same view from real library tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: name -> (Spark expression, DuckDB expression); one expression where both agree.
COLUMNS: dict[str, tuple[str, ...]] = {
    "id": ("event_id",),
    "file_name": ("concat('IMG_', lpad(cast(event_id as string), 7, '0'), '.jpg')", "concat('IMG_', lpad(cast(event_id as varchar), 7, '0'), '.jpg')"),
    "captured_at": ("unix_millis(cast(ts as timestamp))", "epoch_us(ts) // 1000"),
    "status": ("case event_type when 'purchase' then 'selected' when 'signup' then 'candidate' when 'view' then 'review' when 'error' then 'rejected' else 'pending' end",),
    "ai_score": ("cast(floor(value) as bigint) % 101",),
    "sharpness": ("(event_id * 37) % 101",),
    "exposure": ("(event_id * 53 + 17) % 101",),
    "face_count": ("event_id % 4",),
    "known_face_count": ("case when event_id % 4 > 0 then event_id % 2 else 0 end",),
    "rating": ("cast(get_json_object(props, '$.k') as bigint) % 6", "cast(json_extract_string(props, '$.k') as bigint) % 6"),
    "project": ("case when user_id % 10 = 0 then null else concat('p', cast(user_id % 10 as string)) end", "case when user_id % 10 = 0 then null else concat('p', cast(user_id % 10 as varchar)) end"),
    "group_id": ("case when event_id % 3 = 0 then '' else concat('g-', cast(user_id as string), '-', cast(unix_millis(cast(ts as timestamp)) div 21600000 as string)) end", "case when event_id % 3 = 0 then '' else concat('g-', cast(user_id as varchar), '-', cast((epoch_us(ts) // 1000) // 21600000 as varchar)) end"),
    "dhash_key": ("(event_id * 7919) % 1009",),
    "size_bytes": ("1000000 + event_id % 3",),
    "lat": ("case when event_id % 11 = 0 then null else 44 + (user_id % 20) * 0.1D + (event_id % 5) * 0.001D end", "case when event_id % 11 = 0 then null else 44 + (user_id % 20) * 0.1::double + (event_id % 5) * 0.001::double end"),
    "lon": ("case when event_id % 11 = 0 then null else 25 + (user_id % 7) * 0.1D + (event_id % 3) * 0.001D end", "case when event_id % 11 = 0 then null else 25 + (user_id % 7) * 0.1::double + (event_id % 3) * 0.001::double end"),
    "all_eyes_open": ("event_id % 5 <> 0",),
    "subject_in_focus": ("case event_id % 7 when 0 then null when 1 then true when 2 then true else false end",),
    "camera": ("case when user_id % 5 = 0 then null else concat('Cam ', cast(user_id % 5 as string)) end", "case when user_id % 5 = 0 then null else concat('Cam ', cast(user_id % 5 as varchar)) end"),
    "color_label": ("case event_id % 6 when 0 then 'red' when 1 then 'green' when 2 then 'blue' else null end",),
    "scene_type": ("case event_id % 4 when 0 then 'landscape' when 1 then 'portrait' when 2 then 'detail' else 'group' end",),
    "tags": (
        "case when event_id % 16 = 4 then cast(array() as array<string>) else array(case when event_id % 7 = 5 then 'Texture' else concat('tag', cast(event_id % 7 as string)) end, case when user_id % 4 = 2 then 'number' else concat('tag', cast(user_id % 4 as string)) end) end",
        "case when event_id % 16 = 4 then cast([] as varchar[]) else [case when event_id % 7 = 5 then 'Texture' else concat('tag', cast(event_id % 7 as varchar)) end, case when user_id % 4 = 2 then 'number' else concat('tag', cast(user_id % 4 as varchar)) end] end",
    ),
    "persons": ("transform(filter(array(0L, 1L, 2L), i -> i < event_id % 4), i -> concat('P', cast((event_id + i * 3) % 9 as string)))", "list_transform(list_filter([0, 1, 2], lambda i: i < event_id % 4), lambda i: concat('P', cast((event_id + i * 3) % 9 as varchar)))"),
    "text_coverage": ("case when event_id % 9 = 0 then null else ((event_id * 13) % 100) / 200.0D end", "case when event_id % 9 = 0 then null else ((event_id * 13) % 100) / 200.0::double end"),
    "width": ("case event_id % 3 when 0 then 4000 when 1 then 1080 else 3000 end",),
    "height": ("case event_id % 3 when 0 then 3000 when 1 then 2340 else 3000 end",),
    "highlight_clipping": ("case when event_id % 6 = 0 then null else ((event_id * 29) % 100) / 1000.0D end", "case when event_id % 6 = 0 then null else ((event_id * 29) % 100) / 1000.0::double end"),
    "shadow_clipping": ("((event_id * 31) % 90) / 1000.0D", "((event_id * 31) % 90) / 1000.0::double"),
    "horizon_tilt": ("case when event_id % 4 = 1 then null else (event_id % 13 - 6) * 0.5D end", "case when event_id % 4 = 1 then null else (event_id % 13 - 6) * 0.5::double end"),
    "thirds": ("case when event_id % 5 = 1 then null else (event_id % 10) / 10.0D end", "case when event_id % 5 = 1 then null else (event_id % 10) / 10.0::double end"),
    "best_smile": ("(event_id * 17 % 11) / 10.0D", "(event_id * 17 % 11) / 10.0::double"),
    "focal": ("case when event_id % 8 = 0 then null else 18 + (event_id * 7) % 90 end",),
    "media_uri": ("case when event_id % 4 = 3 then null else concat('content://', cast(event_id as string)) end", "case when event_id % 4 = 3 then null else concat('content://', cast(event_id as varchar)) end"),
    "user_id": ("user_id",),
    "stranger_count": ("case when event_id % 4 > 0 then event_id % 4 - event_id % 2 else 0 end",),
    "largest_face": ("case when event_id % 4 > 0 then ((event_id * 19) % 97) / 1000.0D end", "case when event_id % 4 > 0 then ((event_id * 19) % 97) / 1000.0::double end"),
    "ai_uncertainty": ("case when event_id % 3 = 0 then null else ((event_id * 41) % 100) / 100.0D end", "case when event_id % 3 = 0 then null else ((event_id * 41) % 100) / 100.0::double end"),
    "group_eyes_open": ("case when event_id % 4 > 1 and event_id % 7 <> 2 then ((event_id * 7) % 11) / 10.0D end", "case when event_id % 4 > 1 and event_id % 7 <> 2 then ((event_id * 7) % 11) / 10.0::double end"),
    "group_smile": ("case when event_id % 4 > 1 and event_id % 7 <> 3 then ((event_id * 5) % 11) / 10.0D end", "case when event_id % 4 > 1 and event_id % 7 <> 3 then ((event_id * 5) % 11) / 10.0::double end"),
    "group_awkward": ("case when event_id % 4 > 1 and event_id % 3 = 1 then ((event_id * 3) % 5) / 10.0D end", "case when event_id % 4 > 1 and event_id % 3 = 1 then ((event_id * 3) % 5) / 10.0::double end"),
    "composition_score": ("case when event_id % 5 = 2 then null else ((event_id * 23) % 101) / 100.0D end", "case when event_id % 5 = 2 then null else ((event_id * 23) % 101) / 100.0::double end"),
    "avg_eye_contact": ("case when event_id % 4 = 0 or event_id % 9 = 4 then null else ((event_id * 11) % 21) / 20.0D end", "case when event_id % 4 = 0 or event_id % 9 = 4 then null else ((event_id * 11) % 21) / 20.0::double end"),
}

PHOTOS_SQL = "photos as (select " + ", ".join(f"{x[-1]} as {n}" for n, x in COLUMNS.items()) + " from events)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def photos(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """The photo view, or some columns of it; the scan reads only what they need."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return table(spark, sf_dir, "events").select(*[F.expr(COLUMNS[n][0]).alias(n) for n in names or COLUMNS])


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions: what the model said and what the user did, in the order of ts."""
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("ts"), (F.col("toxic") == 0).alias("ai_decision"), (F.col("quality") == 1).alias("user_decision"))


CORRECTIONS_SQL = "corrections as (select doc_id as id, doc_id as ts, toxic = 0 as ai_decision, quality = 1 as user_decision from labels)"


def photo_view(photos_: DataFrame, analyses: DataFrame) -> DataFrame:
    """Library photos left-joined to their analyses, with the view's defaults.

    Missing analyses are neutral: score 0, scene 'detail', eyes open, exposure
    0, framing 0.5. Captions and keywords set by the user win."""
    defaults = {"ai_score": 0, "scene_type": "detail", "all_eyes_open": True, "exposure": 0.0, "thirds": 0.5, "headroom": 0.5, "face_count": 0}
    v = photos_.join(analyses.withColumnRenamed("photo_id", "_photo"), photos_["id"] == F.col("_photo"), "left").drop("_photo")
    for name, value in defaults.items():
        if name in v.columns:
            v = v.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    if "rating" in v.columns:
        v = v.withColumn("rating", F.coalesce("rating", F.lit(0)))
    for mine, theirs in (("caption", "caption_override"), ("keywords", "keywords_override")):
        if mine in v.columns and theirs in v.columns:
            v = v.withColumn(mine, F.coalesce(theirs, mine))
    return v
