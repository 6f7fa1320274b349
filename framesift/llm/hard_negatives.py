"""Hard negatives by a kNN join over Voronoi partitions, exact in whole numbers.

Largest inner product becomes smallest distance: with M the largest norm, a
vector s is lengthened by sqrt(M^2 - |s|^2) and an anchor q by 0, so that
d(q, s)^2 = |q|^2 + M^2 - 2 q.s. Every row belongs to the nearest of some
pivots and keeps its distance r to it. Anchors are packed into groups of
neighbouring partitions; of a group the least and greatest distances lo and hi
to each pivot are known, so that d(q, s) lies between max(lo - r, r - hi) and
hi + r for every anchor of the group and row of the partition. A row is sent to
the groups that it may serve:

- for positives, the rows of the anchor's label whose lower bound is at most
  the (POSITIVES + 1)-th least upper bound over all rows (one for the anchor);
- for negatives, all rows whose bounds meet the distances that the anchors'
  bands of scores leave open.

There a local exact join multiplies matrices: candidates pass in batches, and
only the anchors of a group with their best rows so far are held. A group's
candidates are dealt out over as many tasks as their number asks for, whatever
partition or label they are of; the best of all tasks are merged at the end.
Nothing is dropped: bounds leave out only rows that can't be in the result. On
vectors without structure they leave out little, and each group meets all rows.

Defined results: rows with a null vec_id, label or vector, or a component that
is null or not finite (256 times it, too) take no part; a row meets rows of its
own length only; components beyond a long count as its ends, scores beyond
2**62 as 2**62 (they are compared exactly); repeated rows are rows of their
own, so a copy of an anchor may be its positive, and each copy of an anchor has
its result; a positive of negative score has no hard negatives; an empty table
gives an empty result; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut, small, table

POSITIVES, NEGATIVES = 5, 3
#: A negative's score is from LEAST to MOST hundredths of the positive's.
LEAST, MOST = 50, 95
#: Rows drawn as pivots; they go to the driver and to every task.
PIVOTS = 48
#: Anchors of a group, at about, and rows that meet them in one task.
GROUP_ANCHORS, TASK_ROWS = 1024, 1 << 13
#: Candidates that are multiplied at once.
BLOCK = 2048
#: Scores below this are exact in float64 with a column number beside them.
EXACT = 2.0**53 / BLOCK
NONE, TOP = -(1 << 62) - 1, 1 << 62

PLACED = "vec_id long, label long, dim int, v array<long>, cell int, r double, norm double"
KEY = ["dim", "key", "grp", "sub"]
MEET = ["dim", "key", "grp", "sub", "part", "kind", "id", "mark", "label", "v", "aid", "times", "pid", "ps"]
MET = "anchor_id long, aid long, times long, slot int, positive_id long, positive_score long, score long, id long, own boolean"


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, dim, v (components as whole numbers) of the rows that take part; labels as the contract turns them."""
    big = F.lit(float("inf"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * 256 < big))
    rows = embeddings.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine)
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.size("embedding").alias("dim"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long")).alias("v"))


def matrix(batch: pa.RecordBatch, column: str, rows: np.ndarray) -> np.ndarray:
    """Vectors of one length, of some rows of a batch."""
    a = batch.column(batch.schema.get_field_index(column)).take(pa.array(rows))
    return a.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def to_pivots(x: np.ndarray, pivots: np.ndarray, lifted: np.ndarray, most: float, anchor: bool) -> np.ndarray:
    """Distances of vectors (as anchors: lengthened by 0) to all pivots."""
    x = x.astype(float)
    d = min(x.shape[1], pivots.shape[1])
    norm = (x * x).sum(1)
    dot = x[:, :d] @ pivots[:, :d].T
    if anchor:
        square = norm[:, None] + most - 2 * dot
    else:
        square = 2 * most - 2 * (dot + np.sqrt(np.maximum(0, most - norm))[:, None] * lifted)
    return np.sqrt(np.maximum(0, square))


class Pivots:
    """PIVOTS rows drawn by a hash of their ids, in an order in which neighbours are near, and the largest norm of all rows."""

    def __init__(self, rows: DataFrame):
        norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
        self.most = float(rows.agg(F.max(norm)).first()[0] or 0.0)
        drawn = [r[0] for r in rows.select("v", F.xxhash64("vec_id", "label", "v").alias("_h")).orderBy("_h").limit(PIVOTS).collect()]
        m = np.zeros((max(1, len(drawn)), max([len(x) for x in drawn], default=0)))
        for i, x in enumerate(drawn):
            m[i, : len(x)] = x
        m = np.unique(m, axis=0)
        order, left = [0], set(range(1, len(m)))
        while left:
            near = min(left, key=lambda j: (float(((m[order[-1]] - m[j]) ** 2).sum()), j))
            order.append(near)
            left.remove(near)
        self.at = m[order]
        self.lifted = np.sqrt(np.maximum(0, self.most - (self.at**2).sum(1)))
        self.slack = 1e-6 * (1 + float(np.sqrt(self.most)))

    def distances(self, batch: pa.RecordBatch, anchor: bool) -> list[np.ndarray]:
        """Distances to all pivots of every row of a batch with dim and v."""
        dims, out = column(batch, "dim"), [None] * batch.num_rows
        for d in np.unique(dims):
            rows = np.flatnonzero(dims == d)
            m = matrix(batch, "v", rows) if d else np.zeros((len(rows), 0))
            for i, x in zip(rows, to_pivots(m, self.at, self.lifted, self.most, anchor), strict=True):
                out[i] = x
        return out


def placed(rows: DataFrame, pivots: Pivots) -> DataFrame:
    """vec_id, label, dim, v, cell (nearest pivot), r (distance to it), norm, mark (a hash of v), rid (row number), written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = np.array(pivots.distances(b, False)).reshape(b.num_rows, -1)
            cell = d.argmin(1) if len(d) else np.zeros(0, int)
            norm = [float(np.dot(x, x)) for x in (np.asarray(v, float) for v in b.column(3).to_pylist())]
            cols = [*b.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell] if len(d) else np.zeros(0)), pa.array(norm, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "label", "dim", "v", "cell", "r", "norm"])

    out = rows.mapInArrow(run, PLACED)
    return cut(out.select("*", F.xxhash64("v").alias("mark"), F.monotonically_increasing_id().alias("rid")), "mine-rows")


def reaches(anchors: DataFrame, pivots: Pivots) -> DataFrame:
    """dim, key, grp, sub, cell, lo, hi: least and greatest distance of a group's anchors to each pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(4)], pa.array([x.tolist() for x in pivots.distances(b, True)], pa.list_(pa.float64()))], names=[*KEY, "d"])

    each = anchors.select(*KEY, "v").mapInArrow(run, "dim int, key long, grp long, sub long, d array<double>")
    return each.select(*KEY, F.posexplode("d").alias("cell", "d")).groupBy(*KEY, "cell").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))


def grouped(anchors: DataFrame) -> DataFrame:
    """Add grp and sub: anchors of one dim and key in groups of about GROUP_ANCHORS, partitions kept together in the order of the pivots; one that holds more is dealt out."""
    n = anchors.groupBy("dim", "key", "cell").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("dim", "key").orderBy("cell")) - F.col("_n")  # at most PIVOTS rows
    n = n.select("dim", "key", "cell", F.floor(before / GROUP_ANCHORS).alias("grp"), F.ceil(F.col("_n") / GROUP_ANCHORS).alias("_subs"))
    return anchors.join(small(n), ["dim", "key", "cell"]).withColumn("sub", F.pmod(F.col("aid"), F.col("_subs")).cast("long")).drop("_subs")


def joined(anchors: DataFrame, rows: DataFrame, serves: DataFrame, cells: DataFrame, k: int, slots: int) -> DataFrame:
    """The k best rows of each task for every anchor and slot. anchors: MEET's columns from id on and KEY; rows with key; serves: KEY, cell, least, most (of r)."""
    parts = serves.join(cells.select("dim", "key", "cell", "n"), ["dim", "key", "cell"]).groupBy(*KEY).agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / TASK_ROWS)).cast("long").alias("parts"))
    parts = cut(parts, "mine-parts")
    served = serves.join(parts, KEY)
    long, empty = F.lit(None).cast("long"), F.lit(None).cast("array<long>")
    r = rows.alias("r").join(small(served).alias("s"), F.expr("r.dim = s.dim AND r.key = s.key AND r.cell = s.cell AND r.r >= s.least AND r.r <= s.most"))
    r = r.select("s.dim", "s.key", "s.grp", "s.sub", F.pmod(F.xxhash64("r.rid"), F.col("s.parts")).alias("part"), F.lit(1).alias("kind"), F.col("r.vec_id").alias("id"), "r.mark", "r.label", "r.v", long.alias("aid"), long.alias("times"), empty.alias("pid"), empty.alias("ps"))
    a = anchors.join(parts, KEY).select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind")).select(*MEET)
    both = a.unionByName(r).repartition(*KEY, "part").sortWithinPartitions(*KEY, "part", "kind")
    return both.mapInArrow(lambda batches: meet(batches, k, slots), MET)


class Group:
    """Anchors of one group, and the best rows that each has met."""

    def __init__(self, batches: list[tuple[pa.RecordBatch, np.ndarray]], k: int, slots: int):
        cat = lambda c: np.concatenate([b.column(MEET.index(c)).take(pa.array(at)).to_numpy(zero_copy_only=False) for b, at in batches])
        self.id, self.mark, self.label, self.aid, self.times = (cat(c) for c in ("id", "mark", "label", "aid", "times"))
        self.q = np.concatenate([matrix(b, "v", at) for b, at in batches])
        self.k, self.slots, n = k, slots, len(self.id)
        self.score, self.best, self.own = np.full((n, slots, k), NONE), np.full((n, slots, k), TOP), np.zeros((n, slots, k), bool)
        self.pid = self.ps = None
        if slots > 1:
            lists = [(p, s) for b, at in batches for p, s in zip(b.column(MEET.index("pid")).take(pa.array(at)).to_pylist(), b.column(MEET.index("ps")).take(pa.array(at)).to_pylist(), strict=True)]
            self.pid, self.ps = np.full((n, slots), TOP), np.full((n, slots), -1)
            for i, (p, s) in enumerate(lists):
                self.pid[i, : len(p)], self.ps[i, : len(s)] = p, s

    def bands(self, slot: int) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest whole score that a slot takes."""
        if self.ps is None:
            return np.full(len(self.id), -TOP), np.full(len(self.id), TOP)
        s = self.ps[:, slot]
        low, high = np.array([-(-LEAST * x // 100) for x in s.tolist()], np.int64), np.array([MOST * x // 100 for x in s.tolist()], np.int64)
        return np.where(s < 0, TOP, low), np.where(s < 0, -TOP, high)

    def take(self, ids: np.ndarray, marks: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        """A block of rows comes by."""
        order = np.argsort(ids, kind="stable")
        ids, marks, labels, x = ids[order], marks[order], labels[order], x[order]
        most = float(np.abs(self.q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, x.shape[1])
        exact = most < EXACT
        s = self.q.astype(float) @ x.astype(float).T if exact else self.q.astype(object) @ x.astype(object).T
        other = labels[None, :] != self.label[:, None] if self.ps is not None else None
        top = s.max(1) if s.shape[1] else None
        for slot in range(self.slots):
            low, high = self.bands(slot)
            rows = np.flatnonzero(np.array(top >= low, bool))
            if not len(rows):
                continue
            part = s[rows]
            fits = np.array((part >= low[rows, None]) & (part <= high[rows, None]), bool)
            if other is not None:
                fits &= other[rows]
            n = min(self.k, len(ids))
            if exact:
                rank = np.where(fits, part * len(ids) + (len(ids) - 1 - np.arange(len(ids)))[None, :], -np.inf)
                at = np.argpartition(rank, len(ids) - n, axis=1)[:, len(ids) - n :]
            else:
                at = np.array([sorted(range(len(ids)), key=lambda j: (not fits[i, j], -int(part[i, j]), j))[:n] for i in range(len(rows))])  # noqa: B023
            good = np.take_along_axis(fits, at, 1)
            got = np.take_along_axis(part, at, 1)
            got = np.clip(got, -TOP, TOP).astype(np.int64) if not exact else got.astype(np.int64)
            got, who = np.where(good, got, NONE), np.where(good, ids[at], TOP)
            own = good & (ids[at] == self.id[rows, None]) & (marks[at] == self.mark[rows, None])
            score, best, mine = (np.concatenate([a[rows, slot], b], 1) for a, b in ((self.score, got), (self.best, who), (self.own, own)))
            pick = np.lexsort((best, -score), axis=1)[:, : self.k]
            self.score[rows, slot], self.best[rows, slot], self.own[rows, slot] = (np.take_along_axis(a, pick, 1) for a in (score, best, mine))

    def result(self) -> pa.RecordBatch:
        i, slot, j = np.nonzero(self.score != NONE)
        of = lambda a: a[i, slot] if a is not None else np.zeros(len(i), np.int64)
        cols = [self.id[i], self.aid[i], self.times[i], slot.astype(np.int32), of(self.pid), of(self.ps), self.score[i, slot, j], self.best[i, slot, j], self.own[i, slot, j]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=[c.split()[0] for c in MET.split(", ")])


def meet(batches: Iterator[pa.RecordBatch], k: int, slots: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group, part and kind (anchors first): the best rows of every anchor."""
    at, group, first = None, None, []
    for batch in batches:
        cols = np.stack([column(batch, c).astype(np.int64) for c in (*KEY, "part", "kind")])
        edges = np.flatnonzero((cols[:, 1:] != cols[:, :-1]).any(0)) + 1
        for start, end in zip([0, *edges], [*edges, batch.num_rows], strict=True):
            if end == start:
                continue
            key, kind, span = tuple(cols[:5, start]), cols[5, start], np.arange(start, end)
            if key != at:
                if group is not None:
                    yield group.result()
                at, group, first = key, None, []
            if kind == 0:
                first.append((batch, span))
                continue
            if group is None:
                if not first:
                    continue
                group, first = Group(first, k, slots), []
            for i in range(start, end, BLOCK):
                rows = np.arange(i, min(end, i + BLOCK))
                group.take(*[column(batch, c)[rows] for c in ("id", "mark", "label")], matrix(batch, "v", rows))
    if group is not None:
        yield group.result()


def best(met: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k best of all tasks: rank from 1."""
    return met.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), "id"))).filter(F.col("rank") <= k)


def positives(anchors: DataFrame, rows: DataFrame, pivots: Pivots) -> DataFrame:
    """aid, pid, ps: an anchor's first POSITIVES other rows of its label, as arrays of ids and scores."""
    k = POSITIVES + 1
    rows = rows.withColumn("key", F.col("label"))
    near = rows.select("dim", "key", "cell", "r", F.row_number().over(Window.partitionBy("dim", "key", "cell").orderBy("r")).alias("_at")).filter(F.col("_at") <= k)
    near = near.groupBy("dim", "key", "cell").agg(F.collect_list("r").alias("near"))
    cells = cut(rows.groupBy("dim", "key", "cell").agg(F.count(F.lit(1)).alias("n")).join(near, ["dim", "key", "cell"]), "mine-cells")
    a = cut(grouped(anchors.withColumn("key", F.col("label"))), "mine-anchors")
    reach = cut(reaches(a, pivots), "mine-reach")
    there = reach.join(cells, ["dim", "key", "cell"])
    bound = there.select(*KEY, F.explode(F.transform("near", lambda r: F.col("hi") + r)).alias("_up")).groupBy(*KEY).agg(F.sort_array(F.collect_list("_up")).alias("_ups"))  # at most k for each pivot
    bound = bound.select(*KEY, F.coalesce(F.try_element_at("_ups", F.lit(k)), F.lit(float("inf"))).alias("_far"))
    serves = there.join(bound, KEY).select(*KEY, "cell", (F.col("lo") - F.col("_far") - pivots.slack).alias("least"), (F.col("hi") + F.col("_far") + pivots.slack).alias("most"))
    serves = cut(serves, "mine-serves")
    none = F.lit(None).cast("array<long>")
    mine = a.select(*KEY, F.col("vec_id").alias("id"), "mark", "label", "v", "aid", "times", none.alias("pid"), none.alias("ps"))
    met = best(joined(mine, rows, serves, cells, k, 1), ["aid"], k)
    got = met.groupBy("aid").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score", "own"))).alias("b"))
    own = F.array_position(F.transform("b", lambda x: x["own"]), True)
    own = F.when(own == 0, F.lit(k)).otherwise(own)
    rest = F.filter("b", lambda x, i: i + 1 != own)
    out = cut(got.select("aid", F.slice(rest, 1, POSITIVES).alias("b")).select("aid", F.transform("b", lambda x: x["id"]).alias("pid"), F.transform("b", lambda x: x["score"]).alias("ps")), "mine-positives")
    for x in (cells, a, reach, serves):
        drop_cut(x)
    return out


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score over rows of vec_id, embedding, label."""
    whole = whole_vectors(embeddings)
    pivots = Pivots(whole)
    rows = placed(whole, pivots)
    anchors = rows.filter("vec_id % 50 = 0").groupBy("vec_id", "label", "dim", "v", "cell", "norm", "mark").agg(F.count(F.lit(1)).alias("times"))
    anchors = cut(anchors.withColumn("aid", F.xxhash64("vec_id", "label", "v")), "mine-asked")
    found = positives(anchors, rows, pivots)
    # the distances that the bands of a group's anchors leave open
    low, high = F.ceil(F.array_min("ok") * (LEAST / 100)), F.floor(F.array_max("ok") * (MOST / 100))
    asked = anchors.join(found, "aid").withColumn("ok", F.filter("ps", lambda s: s >= 0)).filter("size(ok) > 0").withColumn("key", F.lit(0).cast("long"))
    square = lambda s: F.sqrt(F.greatest(F.lit(0.0), F.col("norm") + pivots.most - 2 * s.cast("double")))
    a = cut(grouped(asked.withColumn("dmax", square(low - 1)).withColumn("dmin", square(high + 1)).drop("ok")), "mine-anchors")
    every = rows.withColumn("key", F.lit(0).cast("long"))
    cells = cut(every.groupBy("dim", "key", "cell").agg(F.count(F.lit(1)).alias("n")), "mine-cells")
    open_ = a.groupBy(*KEY).agg(F.max("dmax").alias("dmax"), F.min("dmin").alias("dmin"))
    least = F.greatest(F.col("lo") - F.col("dmax"), F.col("dmin") - F.col("hi")) - pivots.slack
    serves = cut(reaches(a, pivots).join(open_, KEY).select(*KEY, "cell", least.alias("least"), (F.col("hi") + F.col("dmax") + pivots.slack).alias("most")), "mine-serves")
    mine = a.select(*KEY, F.col("vec_id").alias("id"), "mark", "label", "v", "aid", "times", "pid", "ps")
    met = best(joined(mine, every, serves, cells, NEGATIVES, POSITIVES), ["aid", "slot"], NEGATIVES)
    each = met.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return each.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor of ``embeddings``, against all rows."""
    return hard_negatives(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


OP11_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.rid AS anchor, a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score, r.rid
  FROM v a JOIN v r ON a.rid <> r.rid AND len(a.v) = len(r.v) WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5),
n AS (
  SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor, p.rid ORDER BY s.score DESC, s.id) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON p.anchor = s.anchor AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
