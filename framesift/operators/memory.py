"""What the learner remembers of earlier decisions, as it was at each of them.

A memory of pictures (the sums of the vectors of kept and of rejected ones) and
one of tags (how often each was kept and rejected) grow with every decision;
what a photo's affinity to them was depends on the decisions before. So these
are prefix sums along the order of decisions, with two twists: a sum begins
anew when a vector of another length comes, and only the first TAGS tags are
remembered. They are taken in two levels: decisions are dealt out by ranges of
their order; each range is summed up; one row for each range is scanned; then
each range runs again from what was there before it. No task sees more than a
range, or one row for each, and a task holds one memory: two vectors and at
most TAGS counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .similarity import checkpointed

#: Vectors that either side must have; decisions on either side and mentions of a tag before tags tell; tags that are remembered.
VECTORS, DECISIONS, MENTIONS, TAGS = 5, 8, 3, 600

STATE = "part long, " + ", ".join(f"{s}_first int, {s}_plain boolean, {s}_sum array<double>, {s}_n long, {s}_tags array<long>, {s}_total long" for s in ("kept", "lost"))


class Side:
    """Vectors and tags of one side: the sum since the length last changed, and what came before it in a range."""

    def __init__(self, tags: int):
        self.first, self.plain, self.sum, self.n = 0, True, np.zeros(0), 0
        self.tags, self.total = np.zeros(tags, np.int64), 0

    def add(self, v: np.ndarray) -> None:
        if self.n and len(self.sum) == len(v):
            self.sum, self.n = self.sum + v, self.n + 1
            return
        if self.n:
            self.plain = False
        else:
            self.first = len(v)
        self.sum, self.n = v.copy(), 1

    def follow(self, other: Side) -> None:
        """What ``other`` summed up comes after this."""
        if other.n:
            if not self.n:
                self.first, self.plain, self.sum, self.n = other.first, other.plain, other.sum, other.n
            elif other.plain and len(self.sum) == other.first:
                self.sum, self.n = self.sum + other.sum, self.n + other.n
            else:
                self.plain, self.sum, self.n = False, other.sum, other.n
        self.tags, self.total = self.tags + other.tags, self.total + other.total

    def row(self) -> list:
        return [self.first, self.plain, self.sum.tolist(), self.n, self.tags.tolist(), self.total]

    @classmethod
    def of(cls, row: tuple) -> Side:
        first, plain, sum_, n, tags, total = row
        s = cls(0)
        s.first, s.plain, s.sum, s.n, s.tags, s.total = int(first), bool(plain), np.array(sum_, float), int(n), np.array(tags, np.int64), int(total)
        return s


class Memory:
    """Both sides, and the affinity of a photo to them."""

    def __init__(self, known: list[str], kept: Side | None = None, lost: Side | None = None):
        self.at = {t: i for i, t in enumerate(known)}
        self.kept, self.lost = kept or Side(len(known)), lost or Side(len(known))

    def learn(self, kept: bool, v: np.ndarray | None, tags: list[str] | None) -> None:
        side = self.kept if kept else self.lost
        if v is not None and len(v):
            side.add(v)
        if tags is not None and len(tags):
            side.total += 1
            own = [self.at[t] for t in dict.fromkeys(tags) if t in self.at]
            side.tags[own] += 1

    def content(self, v: np.ndarray | None) -> float | None:
        if v is None or not len(v) or min(self.kept.n, self.lost.n) < VECTORS:
            return None
        near = [_cosine(v, s.sum) for s in (self.kept, self.lost)]
        return float(min(1.0, max(0.0, 0.5 + 2 * (near[0] - near[1]))))

    def subject(self, tags: list[str] | None) -> float | None:
        if tags is None or min(self.kept.total, self.lost.total) < DECISIONS:
            return None
        odds = []
        for i in (self.at[t] for t in tags if t in self.at):
            k, r = int(self.kept.tags[i]), int(self.lost.tags[i])
            if k + r >= MENTIONS:
                odds.append(np.log((k + 1) / (self.kept.total + 2) / ((r + 1) / (self.lost.total + 2))))
        return float(0.5 + 0.5 * np.tanh(sum(odds) / len(odds))) if odds else None


def _cosine(x: np.ndarray, y: np.ndarray) -> float:
    n = min(len(x), len(y))
    size = np.linalg.norm(x[:n]) * np.linalg.norm(y[:n])
    return float(x[:n] @ y[:n] / size) if size else 0.0


def _vector(v: object) -> np.ndarray | None:
    return None if v is None else np.asarray(v, float)


def known_tags(ordered: DataFrame, most: int = TAGS) -> list[str]:
    """The first ``most`` tags by the decision and place in which they first come: the ones that are remembered."""
    first = ordered.select("at", F.posexplode("tags").alias("pos", "tag")).filter("tag IS NOT NULL").groupBy("tag").agg(F.min(F.struct("at", "pos")).alias("first"))
    return [r["tag"] for r in first.orderBy("first", "tag").limit(most).collect()]


def ranges(decisions: DataFrame, parts: int | None = None) -> DataFrame:
    """Decisions with ``at`` (their place in the order of ts and id) and ``part`` (the range that they are in), written once; as many ranges as their size asks for, or ``parts``."""
    dealt = decisions.repartitionByRange(*([parts] if parts else []), "ts", "id").sortWithinPartitions("ts", "id").withColumn("at", F.monotonically_increasing_id())
    return checkpointed(dealt.withColumn("part", F.shiftright("at", 33)))


def summed(ordered: DataFrame, known: list[str]) -> DataFrame:
    """One row of STATE for each range: what its decisions add."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, m, out = None, None, []
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if r.part != part:
                    if m:
                        out.append([part, *m.kept.row(), *m.lost.row()])
                    part, m = r.part, Memory(known)
                m.learn(bool(r.kept), _vector(r.embedding), r.tags)
        if m:
            out.append([part, *m.kept.row(), *m.lost.row()])
        yield pd.DataFrame(out, columns=[c.split()[0] for c in STATE.split(", ")])

    return ordered.select("part", "at", "kept", "embedding", "tags").repartition("part").sortWithinPartitions("part", "at").mapInPandas(run, STATE)


def carried(sums: DataFrame, known: list[str], *, whole: bool = False) -> DataFrame:
    """What was there before each range (or, ``whole``, after the last one: one row at most). A row for each range passes through one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, part = Memory(known), None
        columns = [c.split()[0] for c in STATE.split(", ")]
        for pdf in batches:
            out = []
            for r in pdf[columns].itertuples(index=False):
                part = r[0]
                if not whole:
                    out.append([part, *m.kept.row(), *m.lost.row()])
                m.kept.follow(Side.of(r[1:7]))
                m.lost.follow(Side.of(r[7:13]))
            yield pd.DataFrame(out, columns=columns)
        if whole and part is not None:
            yield pd.DataFrame([[part, *m.kept.row(), *m.lost.row()]], columns=columns)

    return sums.repartition(1).sortWithinPartitions("part").mapInPandas(run, STATE)


def affinities(decisions: DataFrame, most_tags: int = TAGS, parts: int | None = None) -> DataFrame:
    """Decisions (id, ts, kept, embedding, tags and others) with content_affinity and subject_affinity as they were before each; null where memory can't tell."""
    ordered = ranges(decisions.withColumn("embedding", F.transform("embedding", lambda v: v.cast("double"))), parts)
    known = known_tags(ordered, most_tags)
    before = checkpointed(carried(summed(ordered, known), known))
    fields = [c.split()[0] for c in STATE.split(", ")[1:]]
    state = before.select("part", F.lit(-1).cast("long").alias("at"), F.lit(None).cast("boolean").alias("kept"), F.lit(None).cast("array<double>").alias("embedding"), F.lit(None).cast("array<string>").alias("tags"), F.struct(*fields).alias("state"))
    rows = ordered.select("part", "at", "kept", "embedding", "tags", F.lit(None).cast(state.schema["state"].dataType).alias("state"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Memory(known)
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r.at < 0:
                    s = [r.state[f] for f in fields]
                    m = Memory(known, Side.of(s[:6]), Side.of(s[6:]))
                    continue
                v = _vector(r.embedding)
                out.append((r.at, m.content(v), m.subject(r.tags)))
                m.learn(bool(r.kept), v, r.tags)
            yield pd.DataFrame(out, columns=["at", "content_affinity", "subject_affinity"])

    told = state.unionByName(rows).repartition("part").sortWithinPartitions("part", "at").mapInPandas(run, "at long, content_affinity double, subject_affinity double")
    return ordered.join(told, "at").drop("at", "part")


def memory_now(decisions: DataFrame, most_tags: int = TAGS) -> tuple[list[str], tuple | None]:
    """The tags that are remembered, and the one row of STATE after all decisions (None if there are none)."""
    ordered = ranges(decisions.withColumn("embedding", F.transform("embedding", lambda v: v.cast("double"))))
    known = known_tags(ordered, most_tags)
    return known, carried(summed(ordered, known), known, whole=True).first()


def affinities_now(photos: DataFrame, known: list[str], state: tuple | None) -> DataFrame:
    """Photos with content_affinity (of a column embedding) and subject_affinity (of tags) under a memory of two vectors and at most TAGS counts."""
    if state is None:
        return photos.withColumn("content_affinity", F.lit(None).cast("double")).withColumn("subject_affinity", F.lit(None).cast("double"))
    held = [list(state)[1:7], list(state)[7:13]]

    @F.pandas_udf("content_affinity double, subject_affinity double")
    def told(embedding: pd.Series, tags: pd.Series) -> pd.DataFrame:
        m = Memory(known, *map(Side.of, held))
        return pd.DataFrame({"content_affinity": [m.content(_vector(v)) for v in embedding], "subject_affinity": [m.subject(t) for t in tags]}, dtype=float)

    return photos.withColumn("_told", told(F.transform("embedding", lambda v: v.cast("double")), "tags")).select("*", "_told.content_affinity", "_told.subject_affinity").drop("_told")
