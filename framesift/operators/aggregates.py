"""Aggregations over the photo view and its logs: one groupBy each, partial before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import blank_to_null, round_half_up
from .ranks import counted_within, ranked
from .filters import is_decided


def status_counts() -> list[Column]:
    n = [F.count_if(F.col("status") == s).alias(s) for s in ("selected", "rejected", "review")]
    return [F.count(F.lit(1)).alias("total"), *n, F.count_if(~F.col("status").isin("selected", "rejected", "review")).alias("pending")]


def library_stats(photos: DataFrame) -> DataFrame:
    """One row. A candidate counts as pending; '' and null are no series."""
    ratings = [F.count_if(F.col("rating") == r).alias(f"rating_{r}") for r in range(1, 6)]
    mean = F.coalesce(round_half_up(F.avg("ai_score")), F.lit(0)).alias("avg_score")
    return photos.agg(*status_counts(), *ratings, F.count_distinct(blank_to_null("group_id")).alias("series"), mean)


def project_stats(photos: DataFrame, none: str = "none") -> DataFrame:
    return photos.groupBy(F.coalesce("project", F.lit(none)).alias("project_key")).agg(*status_counts()[:4], F.min("captured_at").alias("first_at"), F.max("captured_at").alias("last_at"))


def agreement(corrections: DataFrame) -> DataFrame:
    return corrections.agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.avg((F.col("ai_decision") == F.col("user_decision")).cast("double")), F.lit(0.0)).alias("agreement_rate"))


def agreement_trend(corrections: DataFrame, buckets: int = 6) -> DataFrame:
    """Agreement in so many buckets of equal count, in time order, what is left over one each in the first; nothing below two rows a bucket."""
    n = corrections.count()
    if n < 2 * buckets:
        return corrections.limit(0).select(F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("agreement_rate"))
    size, more = divmod(n, buckets)
    at, wide = F.col("place") - 1, more * (size + 1)
    bucket = F.when(at < wide, F.floor(at / (size + 1))).otherwise(more + F.floor((at - wide) / size)).cast("int")
    same = (F.col("ai_decision") == F.col("user_decision")).cast("double")
    return ranked(corrections, ["ts", "id"]).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg(same).alias("agreement_rate"))


def accuracy(corrections: DataFrame, least: int = 20, recent: int = 50) -> DataFrame:
    """One row, or none below ``least`` decisions. Only the last 2 * recent rows are ranked."""
    same = (F.col("ai_decision") == F.col("user_decision")).cast("double")
    whole = corrections.agg(F.count(F.lit(1)).alias("total"), F.avg(F.when(F.col("ai_decision"), F.col("user_decision").cast("double"))).alias("keep_precision"), F.avg(F.when(~F.col("ai_decision"), (~F.col("user_decision")).cast("double"))).alias("reject_precision"), F.avg(same).alias("agreement"))
    last = corrections.orderBy(F.desc("ts"), F.desc("id")).limit(2 * recent).withColumn("_r", F.row_number().over(Window.orderBy(F.desc("ts"), F.desc("id"))))
    trend = last.agg(F.avg(F.when(F.col("_r") <= recent, same)).alias("recent"), F.avg(F.when(F.col("_r") > recent, same)).alias("earlier"))
    enough = F.col("total") >= 2 * recent
    return whole.filter(F.col("total") >= least).crossJoin(F.broadcast(trend)).select("total", "keep_precision", "reject_precision", "agreement", F.when(enough, F.col("recent")).alias("recent"), F.when(enough, F.col("earlier")).alias("earlier"))


def facet(photos: DataFrame, column: str) -> DataFrame:
    return photos.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def tag_facet(photos: DataFrame, tags: str = "tags") -> DataFrame:
    """Counts every mention, also two in one photo."""
    return photos.select("id", F.posexplode(tags).alias("_pos", "tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "_pos")).alias("_first"))


def top_tags(photos: DataFrame, k: int = 8) -> DataFrame:
    """Ties go to the tag that was seen first."""
    return tag_facet(photos).orderBy(F.desc("n"), "_first").limit(k).select("tag", "n")


def person_recognition(faces: DataFrame) -> DataFrame:
    """person_id, matches and mean similarity, over single faces."""
    return faces.filter("person_id is not null and person_id <> ''").groupBy("person_id").agg(F.count(F.lit(1)).alias("matches"), F.avg("similarity").alias("avg_similarity"))


def exact_duplicates(photos: DataFrame) -> DataFrame:
    """Sets of equal hash and size. The keeper: selected first, then the earliest, then file name and id."""
    rank = F.struct((F.col("status") != "selected").cast("int"), F.coalesce("captured_at", F.col("imported_at") if "imported_at" in photos.columns else F.lit(0)), "file_name", "id")
    p = photos.filter("dhash_key is not null and size_bytes > 0")
    g = p.groupBy("dhash_key", "size_bytes").agg(F.count(F.lit(1)).alias("n"), F.min_by("id", rank).alias("keep_id"))
    return g.filter("n > 1").withColumn("wasted_bytes", F.col("size_bytes") * (F.col("n") - 1))


def duplicate_summary(sets: DataFrame) -> DataFrame:
    return sets.agg(F.count(F.lit(1)).alias("sets"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"), F.coalesce(F.sum("wasted_bytes"), F.lit(0)).alias("wasted_bytes"))


def duplicate_ids(photos: DataFrame, sets: DataFrame) -> DataFrame:
    return photos.join(sets.select("dhash_key", "size_bytes", "keep_id"), ["dhash_key", "size_bytes"]).filter("id <> keep_id").select("id", "keep_id")


def quick_scan(files: DataFrame, least: int = 10, sample: int = 65_536) -> DataFrame:
    """Files (path, content) whose size and digest of the first and last bytes agree. Digests are taken only where a size occurs twice."""
    sized = files.withColumn("size", F.octet_length("content")).filter("size > 0")
    again = sized.groupBy("size").count().filter("count > 1").select("size")
    part = F.concat(F.substring("content", 1, sample), F.expr(f"substring(content, greatest(1, size - {sample - 1}), {sample})"))
    found = sized.join(again, "size").withColumn("digest", F.sha2(part, 256)).groupBy("size", "digest").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path")).filter("n > 1")
    return found.crossJoin(F.broadcast(files.agg(F.count(F.lit(1)).alias("_files")))).filter(F.col("_files") >= least).drop("_files")


def resumable_projects(photos: DataFrame, least: int = 3, percent: int = 10) -> DataFrame:
    name = F.trim("project")
    p = photos.filter(blank_to_null(name).isNotNull()).groupBy(name.alias("project")).agg(F.count(F.lit(1)).alias("total"), F.count_if(is_decided()).alias("decided"))
    p = p.withColumn("remaining", F.col("total") - F.col("decided")).withColumn("percent", round_half_up(F.col("decided") / F.col("total") * 100))
    return p.filter((F.col("remaining") >= least) & (F.col("percent") >= percent))


def memories(photos: DataFrame, year: int, month: int, day: int) -> DataFrame:
    """Photos of this day in earlier years."""
    t = F.timestamp_millis("captured_at")
    p = photos.filter((F.month(t) == month) & (F.dayofmonth(t) == day) & (F.year(t) < year))
    return p.groupBy(F.year(t).alias("year")).agg(F.count(F.lit(1)).alias("n")).withColumn("years_ago", F.lit(year) - F.col("year"))


def import_streak(days: DataFrame, today: str) -> DataFrame:
    """Length of the run of days (column day) that ends today or yesterday; 0 if neither is there."""
    d = days.select("day").distinct().filter(F.col("day") <= F.lit(today).cast("date"))
    runs = d.withColumn("_run", F.date_sub("day", F.row_number().over(Window.orderBy("day")))).groupBy("_run").agg(F.max("day").alias("last"), F.count(F.lit(1)).alias("n"))
    return runs.filter(F.datediff(F.lit(today).cast("date"), "last") <= 1).agg(F.coalesce(F.max_by("n", "last"), F.lit(0)).alias("streak"))


def feedback_summary(entries: DataFrame, order: list[str]) -> DataFrame:
    """reason, n, rounded mean of the scores there are, and the fixed order that breaks ties."""
    at = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("reason"))
    return entries.filter(F.col("reason").isin(*order)).groupBy("reason").agg(F.count(F.lit(1)).alias("n"), round_half_up(F.avg("score")).alias("avg_score")).withColumn("tie", at)


def outcome_summary(outcomes: DataFrame) -> DataFrame:
    t = outcomes.agg(F.count(F.lit(1)).alias("imports"), F.sum("total").alias("photos"), F.sum("failed").alias("failed"), F.sum("skipped").alias("skipped"), F.max_by("reasons", F.when(F.col("reasons").isNotNull(), F.col("ts"))).alias("last_reason"))
    return t.filter("imports > 0").withColumn("failure_rate", F.when(F.col("photos") > 0, round_half_up(F.col("failed") / F.col("photos") * 100)).otherwise(0))


def stage_stats(samples: DataFrame, by: str = "stage", value: str = "ms") -> DataFrame:
    """count, total, mean and the values at index round(p * (n - 1)). Equal values are counted first, so ties cost a row; then ranks come from ranges, each counting with its number."""
    h = samples.groupBy(by, value).agg(F.count(F.lit(1)).alias("_c"))
    r = counted_within(h, by, value, "_c", "_upto")
    n = samples.groupBy(F.col(by).alias("_by")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    at = lambda p: F.min(F.when(F.col("_upto") > round_half_up(F.lit(p) * (F.col("n") - 1)), F.col(value)))
    found = r.join(n, F.col(by).eqNullSafe(F.col("_by"))).groupBy(by).agg(at(0.5).alias("p50"), at(0.9).alias("p90"))
    return found.join(n, F.col(by).eqNullSafe(F.col("_by"))).select(by, "n", "total", "mean", "p50", "p90")


def reservoir(samples: DataFrame, by: str, k: int = 200, seed: int = 11) -> DataFrame:
    """k rows of each stage, by a seeded hash: the same rows each run. Each task keeps its first k of a stage before anything is shuffled (a rank with a limit)."""
    order = F.xxhash64(*samples.columns, F.lit(seed))
    return samples.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(order, *samples.columns))).filter(F.col("_r") <= k).drop("_r")


def habits(decisions: DataFrame, least: int = 15, total: int = 40, deviation: float = 0.18, most: int = 3) -> DataFrame:
    """Where the keep rate by time band, tag or focal band differs most from the baseline; the strongest of each kind.

    decisions: kept, captured_at, tags, focal. A tag counts once per decision."""
    h = F.hour(F.timestamp_millis("captured_at"))
    time = F.when(h.between(5, 11), "morning").when(h.between(12, 16), "midday").when(h.between(17, 21), "evening").otherwise("night")
    lens = F.when(F.col("focal") < 24, "wide").when(F.col("focal") > 60, "tele").otherwise("normal")
    d = decisions.select(F.col("kept").cast("int").alias("kept"), F.when(F.col("captured_at").isNotNull(), time).alias("time"), F.array_distinct("tags").alias("tags"), F.when(F.col("focal").isNotNull(), lens).alias("focal"))
    keys = F.concat(F.array(F.struct(F.lit("time").alias("kind"), F.col("time").alias("key")), F.struct(F.lit("focal").alias("kind"), F.col("focal").alias("key"))), F.transform("tags", lambda t: F.struct(F.lit("subject").alias("kind"), t.alias("key"))))
    base = d.agg(F.avg("kept").alias("baseline"), F.count(F.lit(1)).alias("_all"))
    b = d.select("kept", F.explode(keys).alias("k")).filter("k.key is not null").groupBy("k.kind", "k.key").agg(F.avg("kept").alias("keep_rate"), F.count(F.lit(1)).alias("n"))
    b = b.crossJoin(F.broadcast(base)).filter((F.col("_all") >= total) & (F.col("n") >= least) & (F.abs(F.col("keep_rate") - F.col("baseline")) >= deviation))
    away = F.abs(F.col("keep_rate") - F.col("baseline"))
    best = b.withColumn("_r", F.row_number().over(Window.partitionBy("kind").orderBy(away.desc(), "key"))).filter("_r = 1")
    return best.orderBy(away.desc(), "kind").limit(most).select("kind", "key", "keep_rate", "baseline", "n")


def tag_memory(decisions: DataFrame) -> DataFrame:
    """tag, kept, rejected, and the totals of decisions with tags."""
    d = decisions.filter(F.size("tags") > 0).select(F.col("kept").cast("long").alias("kept"), F.array_distinct("tags").alias("tags"))
    all_ = d.agg(F.sum("kept").alias("kept_total"), F.sum(1 - F.col("kept")).alias("rejected_total"))
    return d.select("kept", F.explode("tags").alias("tag")).groupBy("tag").agg(F.sum("kept").alias("kept"), F.sum(1 - F.col("kept")).alias("rejected")).crossJoin(F.broadcast(all_))


def tag_affinity(photos: DataFrame, memory: DataFrame, least: int = 8, seen: int = 3) -> DataFrame:
    """id and 0.5 + 0.5 tanh(mean smoothed log odds) of the tags that are known well enough."""
    odds = F.ln(((F.col("kept") + 1) / (F.col("kept_total") + 2)) / ((F.col("rejected") + 1) / (F.col("rejected_total") + 2)))
    m = memory.filter((F.col("kept_total") >= least) & (F.col("rejected_total") >= least) & (F.col("kept") + F.col("rejected") >= seen)).select("tag", odds.alias("odds"))
    return photos.select("id", F.explode("tags").alias("tag")).join(m, "tag").groupBy("id").agg((0.5 + 0.5 * F.tanh(F.avg("odds"))).alias("affinity"))


def usage_window(events: DataFrame, now_ms: int, days: int = 30) -> DataFrame:
    """Exports of the last days, counted in hour buckets (cutoff, now + 1 h]."""
    hour = F.expr("at_ms div 3600000 * 3600000")
    return events.withColumn("_h", hour).filter((F.col("_h") > now_ms - days * 86_400_000) & (F.col("_h") <= now_ms + 3_600_000)).agg(F.count(F.lit(1)).alias("used"))


def monthly_usage(events: DataFrame) -> DataFrame:
    return events.groupBy(F.date_format(F.timestamp_millis("at_ms"), "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


def thresholds(photos: DataFrame, score: str = "ai_score") -> DataFrame:
    """One row: select, reject, adapted. Below 150 scores the fixed 65/35; a side whose share is outside 6..50 % moves to the 20 % quantile, within 55..78 or 22..45.

    Scores are counted by value first, so the ranks are taken over a histogram."""
    h = photos.groupBy(F.col(score).alias("s")).agg(F.count(F.lit(1)).alias("c"))
    up = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumn("_cum", F.sum("c").over(up)).withColumn("_n", F.sum("c").over(Window.partitionBy(F.lit(0))))
    n = F.max("_n")
    at = lambda i: F.min(F.when(F.col("_cum") > i, F.col("s")))
    r = h.agg(
        n.alias("n"), F.sum(F.when(F.col("s") >= 65, F.col("c")).otherwise(0)).alias("hi"), F.sum(F.when(F.col("s") <= 35, F.col("c")).otherwise(0)).alias("lo"),
        at(F.least(F.col("_n") - 1, F.floor(F.col("_n") * (1 - F.lit(0.2))))).alias("q_hi"), at(F.greatest(F.lit(0), F.ceil(F.col("_n") * F.lit(0.2)) - 1)).alias("q_lo"),
    )
    off = lambda k: (F.col(k) / F.col("n") < 0.06) | (F.col(k) / F.col("n") > 0.5)
    enough = F.col("n") >= 150
    r = r.select(F.when(enough & off("hi"), F.greatest(F.lit(55), F.least(F.lit(78), "q_hi"))).otherwise(65).cast("long").alias("select_at"), F.when(enough & off("lo"), F.greatest(F.lit(22), F.least(F.lit(45), "q_lo"))).otherwise(35).cast("long").alias("reject_at"))
    return r.withColumn("adapted", (F.col("select_at") != 65) | (F.col("reject_at") != 35))


def home_counters(photos: DataFrame) -> DataFrame:
    """All the counters of the home screen in one pass."""
    c = {"photos": F.count(F.lit(1)), "undecided": F.count_if(~is_decided()), "kept": F.count_if(F.col("status") == "selected"), "with_faces": F.count_if(F.col("face_count") > 0), "days": F.count_distinct(F.expr("coalesce(captured_at, 0) div 86400000")), "bytes": F.coalesce(F.sum("size_bytes"), F.lit(0))}
    return photos.agg(*[v.alias(k) for k, v in c.items()])
