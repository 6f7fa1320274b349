"""Undo over three bounded stacks, as a replay of a log.

A log holds, for each user and in order (ts, seq), what was pushed and when
something was undone: single decisions (the last SINGLES can be undone), batches
of decisions and batches of other fields (the last BATCHES each). An undo takes
the newest of the three tops: a field batch only if it is newer than both
others, a decision batch only if it is newer than the single decision. What it
changes back are the rows of the event that it undoes; what a model has learned
stays. Only numbers of events are held, their changes are joined afterwards; a
user's log streams through one task, as its order is its meaning."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SINGLES, BATCHES = 10, 5
#: Kinds of pushes, and how many of each are held.
HELD = {"single": SINGLES, "batch": BATCHES, "field": BATCHES}
UNDONE = "user_id long, undo_id long, ts long, undone_id long, kind string"
STACKS = ", ".join(f"{k}_{c} array<long>" for k in HELD for c in ("id", "ts"))


class Stacks:
    """Numbers and times of what can be undone."""

    def __init__(self, held: dict[str, list[tuple[int, int]]] | None = None):
        self.held = held or {k: [] for k in HELD}

    def push(self, kind: str, event: int, ts: int) -> None:
        self.held[kind] = [*self.held[kind], (event, ts)][-HELD[kind] :]

    def undo(self) -> tuple[int, str] | None:
        last = {k: v[-1][1] if v else -1 for k, v in self.held.items()}
        if max(last.values()) == -1:
            return None
        kind = "field" if last["field"] > max(last["single"], last["batch"]) else "batch" if last["batch"] > last["single"] else "single"
        return (self.held[kind].pop()[0], kind) if self.held[kind] else None

    def step(self, kind: str, event: int, ts: int) -> tuple[int, str] | None:
        if kind != "undo":
            self.push(kind, event, ts)
            return None
        return self.undo()

    def row(self) -> tuple:
        return tuple([x[i] for x in self.held[k]] for k in HELD for i in (0, 1))

    @classmethod
    def of(cls, row: tuple) -> Stacks:
        return cls({k: list(zip(row[2 * i], row[2 * i + 1], strict=True)) for i, k in enumerate(HELD)})


def undone(log: DataFrame) -> DataFrame:
    """user_id, undo_id, ts, undone_id, kind of every undo of a log (user_id, event_id, ts, seq, kind); nulls where there was nothing to undo."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, stacks = None, Stacks()
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r.user_id != user:
                    user, stacks = r.user_id, Stacks()
                hit = stacks.step(r.kind, r.event_id, r.ts)
                if r.kind == "undo":
                    out.append((user, r.event_id, r.ts, *(hit or (None, None))))
            yield pd.DataFrame(out, columns=["user_id", "undo_id", "ts", "undone_id", "kind"]).astype({"undone_id": "Int64"})

    rows = log.select("user_id", "event_id", "ts", "seq", "kind").repartition("user_id").sortWithinPartitions("user_id", "ts", "seq")
    return rows.mapInPandas(run, UNDONE)


def undone_stream(log: DataFrame) -> DataFrame:
    """The same over a stream of the log: three short stacks of each user are state. Within a batch a user's rows are taken in order."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stacks = Stacks.of(tuple(list(x) for x in state.get)) if state.exists else Stacks()
        out = []
        for r in pd.concat(list(batches)).sort_values(["ts", "seq"]).itertuples(index=False):
            hit = stacks.step(r.kind, r.event_id, r.ts)
            if r.kind == "undo":
                out.append((key[0], r.event_id, r.ts, *(hit or (None, None))))
        state.update(stacks.row())
        yield pd.DataFrame(out, columns=["user_id", "undo_id", "ts", "undone_id", "kind"]).astype({"undone_id": "Int64"})

    return log.groupBy("user_id").applyInPandasWithState(step, UNDONE, STACKS, "append", GroupStateTimeout.NoTimeout)


def values_after(log: DataFrame, changes: DataFrame, undos: DataFrame) -> DataFrame:
    """photo_id, field, value after the whole log: the last of what events set and undos set back.

    changes: event_id, photo_id, field, previous, value; several photos for a batch."""
    order = log.select("event_id", "ts", "seq")
    does = changes.join(order, "event_id").select("photo_id", "field", "ts", "seq", F.col("value"))
    at = undos.filter("undone_id IS NOT NULL").select(F.col("undo_id").alias("event_id"), "undone_id").join(order, "event_id").select("undone_id", "ts", "seq")
    back = changes.join(at, F.col("event_id") == F.col("undone_id")).select("photo_id", "field", "ts", "seq", F.col("previous").alias("value"))
    return does.unionByName(back).groupBy("photo_id", "field").agg(F.max_by("value", F.struct("ts", "seq")).alias("value"))
