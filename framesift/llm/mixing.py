"""Mixing sources to target weights: capped water-filling, DataFrame functions only.

``targets`` shares a total among sources in proportion to weights; no source
gets more than ``max_epochs`` times its size, and what it can't take goes to
the others by weight until none is above. That fixed point is found at once:
with the sources in order of cap/weight, a source is capped while the level
that the remaining total gives to the remaining weight is above its ratio.

``mix`` takes floor(target/size) whole repetitions of every document of a
source and one more of the documents that come first in a seeded order, until
the fractional rest is filled. The running sum over a source is taken in two
steps, over hash ranges and then within the one range that holds the border,
so no task sees a whole source. Rows of one doc_id and text share their place
in the order; where the rest ends among such copies, so many of them are taken
as come nearest to it, so a source misses its target by half a row at most.
Those copies are numbered by ranges, as one row may be most of a source.
Sources are ranked in one task, a row for each: some thousands, not millions.

Defined results: null text has size 0; a null source is a source of its own,
last in order; documents of size 0 take nothing; repeated rows are rows of
their own; rows of null doc_id are told apart by their texts; an empty table gives an empty result. Needs no columns but doc_id, source and
text; others pass through ``mix``, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import boxed, cut, small, table

WEIGHTS = (5.0, 2.0, 1.0)
SEED = "mix-1"
#: So many hex digits of the order key make a range: 4096 of them.
RANGE_DIGITS = 3


def words(text: str = "text") -> Column:
    """Number of runs of anything but space, tab, LF, VT, FF, CR; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, *, total_share: float = 1.5, max_epochs: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """source, source_size -> + weight, target. One row for each source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.lit(weights[-1])
    for i, x in enumerate(weights[:-1]):
        w = F.when(F.col("_at") % len(weights) == i, F.lit(x)).otherwise(w)
    s = sizes.withColumn("_at", F.row_number().over(by_name) - 1).withColumn("weight", w).withColumn("_cap", F.col("source_size") * F.lit(max_epochs))
    order = Window.orderBy(F.col("_cap") / F.col("weight"), "_at").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(F.lit(0))
    s = s.select("*", F.sum("_cap").over(order).alias("_caps"), F.sum("weight").over(order).alias("_weights"), F.sum("weight").over(every).alias("_weight"), (F.sum("source_size").over(every) * F.lit(total_share)).alias("_total"))
    level = (F.col("_total") - F.col("_caps") + F.col("_cap")) / (F.col("_weight") - F.col("_weights") + F.col("weight"))
    s = s.withColumn("_level", level).withColumn("_open", F.col("_level") * F.col("weight") < F.col("_cap"))
    final = F.min(F.when(F.col("_open"), F.struct(F.col("_cap") / F.col("weight"), "_at", "_level"))).over(every)["_level"]
    return s.withColumn("_final", final).select("source", "source_size", "weight", F.coalesce(F.least(F.col("_cap"), F.col("_final") * F.col("weight")), F.col("_cap")).alias("target"))


def order_key(seed: str) -> Column:
    """The seeded order key of a row, by its doc_id and text."""
    return F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("~")), F.md5(F.coalesce("text", F.lit("")))))


def measure(docs: DataFrame, seed: str) -> DataFrame:
    """doc_id, source, size and the order key of each row; copies share a key."""
    return docs.select("doc_id", "source", words().alias("size"), order_key(seed).alias("_key"))


def plan_mix(measured: DataFrame, *, total_share: float = 1.5, max_epochs: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """One row for each source: target, whole repetitions, the order key at which the rest ends (what comes before is taken once more), and how many of the copies there are taken."""
    m = measured.select("source", "size", "_key", F.substring("_key", 1, RANGE_DIGITS).alias("_range"))
    ranges = m.groupBy("source", "_range").agg(F.sum("size").alias("_n"))
    plan = targets(ranges.groupBy("source").agg(F.sum("_n").alias("source_size")), total_share=total_share, max_epochs=max_epochs, weights=weights)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = plan.withColumn("_whole", F.floor(ratio)).withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))
    along = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    begun = ranges.withColumn("_before", F.sum("_n").over(along) - F.col("_n")).alias("r").join(small(plan).alias("p"), F.expr("r.source <=> p.source"))
    border = begun.filter("_before <= _rest").groupBy("p.source").agg(*[F.max(c).alias(c) for c in ("source_size", "target", "_whole", "_rest")], F.max_by("_before", "_range").alias("_before"), F.max("_range").alias("_border"))
    border = cut(border, "mix-border")
    inside = m.alias("m").join(small(border).alias("b"), F.expr("m.source <=> b.source and m._range = b._border")).groupBy("b.source", "_key").agg(F.sum("size").alias("_n"), F.count(F.lit(1)).alias("_copies"), F.max("size").alias("_size"), F.first("_before").alias("_before"), F.first("_rest").alias("_rest"))
    by_key = Window.partitionBy("source").orderBy("_key").rowsBetween(Window.unboundedPreceding, 0)
    open_ = inside.withColumn("_from", F.col("_before") + F.sum("_n").over(by_key) - F.col("_n")).filter("_from + _n > _rest")
    last = open_.groupBy("source").agg(F.min(F.struct("_key", "_from", "_size", "_copies", "_rest")).alias("l"))
    take = F.floor((F.col("l._rest") - F.col("l._from")) / F.col("l._size") + 0.5)
    joined = border.alias("b").join(last.alias("l"), F.expr("b.source <=> l.source"), "left")
    return cut(joined.select("b.source", "source_size", "target", "_whole", F.coalesce("l._key", F.lit("~")).alias("_cut"), F.coalesce(take, F.lit(0)).cast("long").alias("_take"), F.coalesce("l._copies", F.lit(0)).alias("_copies")), "mix-plan")


def copy_numbers(rows: DataFrame) -> DataFrame:
    """Add _copy, from 1 within each source: rows are dealt out by ranges of what they hold (equal rows at random), so copies of one row are split too."""
    kinds = [f.dataType.simpleString() for f in rows.schema.fields]
    held = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    order = [F.col("source"), F.xxhash64(F.to_json(held) if any("map<" in k for k in kinds) else held)]
    dealt = rows.withColumn("_salt", F.rand(1)).repartitionByRange(*order, "_salt").drop("_salt").sortWithinPartitions(*order)
    seen = cut(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), "mix-copies")
    spans = seen.groupBy("source", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy("source").orderBy("_part")) - F.col("_rows")
    spans = spans.select(F.col("source").alias("_of"), F.col("_part").alias("_in"), "_first", before.alias("_before"))
    j = seen.join(small(spans), F.col("source").eqNullSafe(F.col("_of")) & (F.col("_part") == F.col("_in")))
    return j.withColumn("_copy", F.col("_at") - F.col("_first") + F.col("_before") + 1).select(*rows.columns, "_copy")


def apply_mix(measured: DataFrame, plan: DataFrame) -> DataFrame:
    """Add source_size, target, repeats and taken to measured rows (all their columns but _key stay)."""
    p = small(plan.select(F.col("source").alias("_source"), *plan.columns[1:]))
    d = measured.join(p, measured["source"].eqNullSafe(F.col("_source")), "left").drop("_source")
    if plan.filter("_copies > 1 AND _take > 0 AND _take < _copies").isEmpty():
        once = (F.col("_key") < F.col("_cut")) | ((F.col("_key") == F.col("_cut")) & (F.col("_take") > 0))
    else:
        at = F.coalesce(F.col("_key") == F.col("_cut"), F.lit(False))
        d = d.filter(~at).withColumn("_copy", F.lit(0).cast("long")).unionByName(copy_numbers(d.filter(at)))
        once = (F.col("_key") < F.col("_cut")) | ((F.col("_key") == F.col("_cut")) & (F.col("_copy") <= F.col("_take")))
    d = d.withColumn("repeats", (F.col("_whole") + once.cast("long")).cast("int"))
    return d.withColumn("taken", F.col("repeats") * F.col("size")).drop("_whole", "_cut", "_take", "_copies", "_copy", "_key")


NEW = ("size", "source_size", "target", "repeats", "taken")


def mix(docs: DataFrame, *, seed: str = SEED, total_share: float = 1.5, max_epochs: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Add size, source_size, target, repeats (times a document is taken) and taken (words).

    Columns of docs with these names are replaced; all others stay."""
    plan = plan_mix(cut(measure(docs, seed), "mix-sizes"), total_share=total_share, max_epochs=max_epochs, weights=weights)
    sized = boxed(docs.drop(*NEW), source=F.col("source"), doc_id=F.col("doc_id"), text=F.col("text"), size=words())
    keyed = sized.select("row", "source", "size", order_key(seed).alias("_key"))
    return apply_mix(keyed, plan).select("row.*", *NEW)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 150 % of their words, sources weighing 5, 2, 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    measured = cut(measure(docs, SEED), "mix-sizes")
    return apply_mix(measured, plan_mix(measured)).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = f"""
WITH m AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
k AS (SELECT doc_id, source, size, md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '~') || '|' || md5(coalesce(text, ''))) AS key FROM m),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source),
n AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS ord, source_size * 2.0::DOUBLE AS cap FROM s),
w AS (SELECT *, CASE ord % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM n),
c AS (
  SELECT *, sum(cap) OVER o AS caps, sum(weight) OVER o AS weights, sum(weight) OVER () AS all_weight,
    CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS total
  FROM w WINDOW o AS (ORDER BY cap / weight, ord ROWS UNBOUNDED PRECEDING)),
l AS (SELECT *, (total - caps + cap) / (all_weight - weights + weight) AS level FROM c),
f AS (SELECT level FROM l WHERE level * weight < cap ORDER BY cap / weight, ord LIMIT 1),
t AS (SELECT l.source, l.source_size, coalesce(least(l.cap, (SELECT level FROM f) * l.weight), l.cap) AS target FROM l),
r AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
g AS (SELECT source, key, sum(size) AS n, max(size) AS own FROM k GROUP BY source, key),
u AS (SELECT *, CAST(sum(n) OVER (PARTITION BY source ORDER BY key ROWS UNBOUNDED PRECEDING) - n AS DOUBLE) AS since FROM g),
c2 AS (SELECT *, row_number() OVER (PARTITION BY source, key) AS copy FROM k)
SELECT k.doc_id, k.size, r.source_size, r.target,
  CAST((r.whole + CASE WHEN u.since + u.n <= r.target - r.whole * r.source_size THEN 1 WHEN k.copy <= floor((r.target - r.whole * r.source_size - u.since) / nullif(u.own, 0) + 0.5) THEN 1 ELSE 0 END) * k.size AS BIGINT) AS taken
FROM c2 k JOIN r ON k.source IS NOT DISTINCT FROM r.source
JOIN u ON k.source IS NOT DISTINCT FROM u.source AND k.key = u.key
"""
