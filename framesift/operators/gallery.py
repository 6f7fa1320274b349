"""The device gallery, its folders and periods, selections, sort orders and summaries of a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import round_half_up
from .ranks import ranked


def taken_or_added(taken: str = "taken", added_s: str = "added_s") -> Column:
    """When a gallery photo was taken; where that is missing or 0, when it was added (in seconds)."""
    return F.when(F.coalesce(F.col(taken), F.lit(0)) > 0, F.col(taken)).otherwise(F.col(added_s) * 1000)


def gallery_overview(gallery: DataFrame) -> DataFrame:
    """n, earliest and latest of the gallery: of real times taken and of times added, together."""
    taken, added = F.when(F.col("taken") > 0, F.col("taken")), F.when(F.col("added_s") > 0, F.col("added_s") * 1000)
    return gallery.agg(F.count(F.lit(1)).alias("n"), F.least(F.min(taken), F.min(added)).alias("earliest"), F.greatest(F.max(taken), F.max(added)).alias("latest"))


def photos_in_range(gallery: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """Photos taken (else added) between both times, these included."""
    return gallery.filter(taken_or_added().between(start_ms, end_ms))


def folders(gallery: DataFrame) -> DataFrame:
    """folder, n, first (the smallest ordinal: the order of first appearance)."""
    return gallery.groupBy("folder").agg(F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("first"))


def ordered_folders(counted: DataFrame, excluded: DataFrame) -> DataFrame:
    """folder, n, excluded, place: included ones first, then by count; ties by first appearance. Folders are few: one row each."""
    e = counted.join(excluded.select("folder").distinct().withColumn("_out", F.lit(True)), "folder", "left").withColumn("excluded", F.coalesce("_out", F.lit(False)))
    return e.withColumn("place", F.row_number().over(Window.orderBy("excluded", F.desc("n"), "first"))).select("folder", "n", "excluded", "place")


def included_count(ordered: DataFrame) -> DataFrame:
    return ordered.agg(F.coalesce(F.sum(F.when(~F.col("excluded"), F.col("n"))), F.lit(0)).alias("included"))


def in_folder(gallery: DataFrame, folder: str) -> DataFrame:
    return gallery.filter(F.col("folder") == folder).orderBy("taken", "ordinal")


def locations_of(uris: DataFrame, gallery: DataFrame) -> DataFrame:
    """uri, lat, lon of the uris asked for; null where the gallery has none."""
    return uris.select("uri").join(gallery.select("uri", "lat", "lon"), "uri", "left")


def faces_first(batch: DataFrame, first: int = 150) -> DataFrame:
    """id, place: among the first so many, photos with faces come first, in input order; the others follow as they were."""
    key = F.when(F.col("ordinal") > first, 2).when(F.col("face_count") > 0, 0).otherwise(1)
    return ranked(batch.withColumn("_key", key), ["_key", "ordinal"]).select("id", "place")


def periods(earliest: Column, now: Column, covered: Column, period_ms: int, most: int = 240) -> Column:
    """ARRAY of start, end and whether it is covered, of at most ``most`` periods from the earliest photo until now."""
    n = F.least(F.lit(most), F.ceil((now - earliest) / period_ms)).cast("int")
    start = lambda i: earliest + i.cast("long") * period_ms
    end = lambda i: F.least(start(i) + period_ms, now)
    each = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.struct(start(i).alias("start"), end(i).alias("end"), (end(i) <= F.coalesce(covered, earliest)).alias("covered")))
    return F.when((earliest < now) & F.lit(period_ms > 0), each).otherwise(F.filter(each, lambda x: F.lit(False)))


def next_period(earliest: Column, now: Column, covered: Column, period_ms: int | None = None) -> Column:
    """start and end of the period after what is covered (all that is left without ``period_ms``); null if nothing is."""
    start = F.when(covered.isNull(), earliest).otherwise(F.greatest(covered, earliest))
    end = now if period_ms is None else F.least(start + period_ms, now)
    return F.when(start < now, F.struct(start.alias("start"), end.alias("end")))


def coverage_percent(earliest: Column, now: Column, covered: Column) -> Column:
    done = F.when(covered.isNull(), 0).otherwise(F.greatest(F.lit(0), F.least(covered, now) - earliest))
    return F.when(now - earliest <= 0, 100).otherwise(round_half_up(done / (now - earliest) * 100)).cast("long")


def select_range(ordered: DataFrame, anchor: int, target: int) -> DataFrame:
    """ids between two rows of an ordered list (id, place), both included, in either direction; the target alone if one isn't there."""
    ends = ordered.filter(F.col("id").isin(anchor, target)).agg(F.min("place").alias("_lo"), F.max("place").alias("_hi"), F.count_distinct("id").alias("_n"))
    both = F.col("_n") == len({anchor, target})
    return ordered.crossJoin(F.broadcast(ends)).filter((both & F.col("place").between(F.col("_lo"), F.col("_hi"))) | (~both & (F.col("id") == target))).select("id")


def session_outcome(imported: Column, auto_decided: Column, series: Column, uncertain: Column, duration_ms: Column) -> Column:
    """Counts of a session, held within each other; null for an empty one."""
    auto = F.greatest(F.lit(0), F.least(imported, auto_decided))
    fields = [
        imported.alias("imported"), auto.alias("auto_decided"), (imported - auto).alias("left_to_review"), (auto / imported).alias("handled_share"),
        F.greatest(F.lit(0), series).alias("series_found"), F.greatest(F.lit(0), F.least(auto, uncertain)).alias("uncertain"), F.greatest(F.lit(0), duration_ms).alias("duration_ms"),
    ]
    return F.when(imported > 0, F.struct(*fields))


def top_reasons(failures: DataFrame, k: int = 2) -> DataFrame:
    """One text of the k most frequent reasons, "reason (xN)"; ties by first appearance (``ordinal``)."""
    counted = failures.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("first"))
    top = counted.orderBy(F.desc("n"), "first").limit(k)
    said = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "first", "reason"))), lambda r: F.concat(r["reason"], F.lit(" (x"), (-r["n"]).cast("string"), F.lit(")")))
    return top.agg(F.array_join(said, " · ").alias("reasons"))


def best_of_places(clusters: DataFrame, labelled: DataFrame) -> DataFrame:
    """id, place: photos of one known locality together; the others by the cluster they are in. clusters: id, place (long); labelled: id, locality."""
    named = labelled.filter(F.coalesce("locality", F.lit("")) != "").select("id", F.concat(F.lit("name:"), "locality").alias("place"))
    rest = clusters.join(named.select("id"), "id", "left_anti").select("id", F.concat(F.lit("at:"), F.col("place").cast("string")).alias("place"))
    return named.unionByName(rest)


def natural_tag(tags: str, abstract: Column) -> Column:
    """The first tag that is no abstract notion, whatever its case; null if there is none."""
    return F.try_element_at(F.filter(tags, lambda t: ~F.array_contains(abstract, F.lower(t))), F.lit(1))
