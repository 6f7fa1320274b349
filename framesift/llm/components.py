"""Connected components of a link table, by min-label hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut


def components(links: DataFrame, *, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """node, root: the smallest node reachable, for every node of ``links``.

    Large-star and small-star rounds (Kiveris et al., 2014): in the first, every
    node's larger neighbours, in the second its smaller ones and itself, are
    linked to the smallest neighbour. Rounds end when a round changes nothing;
    they grow with the logarithm of the component size. A hub's neighbours are
    aggregated only to their minimum; the join that gives it to them is on the
    hub's key, of two longs a row, and one that Spark's skew join splits.
    Null nodes and self links are left out; no links, no rows."""
    e = cut(links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    mark = None
    for _ in range(rounds):
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        new = cut(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_cut(e)
        e = new
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
