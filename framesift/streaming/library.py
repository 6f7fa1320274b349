"""Streaming: imports as micro-batches, moments as sessions, and the preference learner as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.scoring import NAMES, NUMBERS, Model, as_log, as_numbers, for_both, take_all
from ..operators.similarity import checkpointed

DECISION = "context_key string, features map<string,double>, ai_decision boolean, user_decision boolean, ts long, id long"
#: Rows of a log that a trigger takes at about; rows of numbers that are taken at once.
SLICE, TAKEN = 1 << 18, 1 << 14
STATE = "weights map<string,double>, bias double, stats map<string,array<double>>, n long"


def photo_stream(spark: SparkSession, path: str, schema: str, files: int = 15) -> DataFrame:
    """A bounded number of new files in each batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def sessions(stream: DataFrame, at: str = "ts", gap: str = "15 minutes", late: str = "1 hour", by: str | None = None) -> DataFrame:
    """Moments as session windows; a session closes once the watermark has passed it. A stream needs a key ``by`` (Spark has no session windows over a stream without one); a batch does not."""
    keys = [by] if by else []
    w = F.session_window(at, gap).alias("moment")
    return stream.withWatermark(at, late).groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))


def hourly_usage(stream: DataFrame, at: str = "ts", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(at, late).groupBy(F.window(at, "30 days", "1 day")).agg(F.count(F.lit(1)).alias("used"))


def learner(decisions: DataFrame) -> DataFrame:
    """Models after each batch of decisions and choices: state is kept for each context and for the global one. Within a batch rows are taken in order of (ts, id); a batch of a context is held whole, as numbers, so bound it by files a trigger."""
    both = for_both(decisions if "x" in decisions.columns else as_numbers(as_log(decisions)))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        m = Model()
        if state.exists:
            w, bias, stats, n = state.get
            m = Model(dict(w), bias, {k: list(v) for k, v in dict(stats).items()}, n).repaired()
        rest, xs, ys = [], [], []
        for pdf in batches:
            for held, name in ((xs, "x"), (ys, "y")):
                there = pdf[name].str.len().to_numpy() > 0
                part = np.full((len(pdf), len(NAMES)), np.nan)
                part[there] = np.frombuffer(b"".join(pdf[name])).reshape(-1, len(NAMES))
                held.append(part)
            rest.append(pdf.assign(plain=pdf["x"].str.len() > 0).drop(columns=["x", "y"]))
        rows = pd.concat(rest, ignore_index=True).sort_values(["ts", "id", "pos"])
        x, y = np.concatenate(xs), np.concatenate(ys)
        xs, ys = None, None
        place, plain = rows.index.to_numpy(), rows["plain"].to_numpy()
        choice, user, ai, last = (rows[c].fillna(False).to_numpy(dtype=bool) for c in ("choice", "user_decision", "ai_decision", "last"))
        ends = np.flatnonzero(np.diff(plain)) + 1
        for lo, hi in zip([0, *ends], [*ends, len(rows)], strict=True):
            if not plain[lo]:
                for r in rows.iloc[lo:hi].itertuples(index=False):
                    m.take(r)
                continue
            for k in range(lo, hi, TAKEN):
                part = slice(k, min(k + TAKEN, hi))
                take_all(m, x[place[part]], y[place[part]], choice[part], user[part], ai[part], last[part])
        state.update((m.weights, m.bias, m.stats, m.n))
        yield pd.DataFrame([{"context_key": key[0], "weights": m.weights, "bias": m.bias, "n": m.n}])

    return both.groupBy("context_key").applyInPandasWithState(step, "context_key string, weights map<string,double>, bias double, n long", STATE, "update", GroupStateTimeout.NoTimeout)


def in_slices(log: DataFrame, path: str, size: int = SLICE) -> DataFrame:
    """The log as a stream of rows of NUMBERS, written so that each trigger takes the next ``size`` rows at about, in order of (ts, id). Rows of one (ts, id) stay together.

    A source takes files by the time at which they were written, so slices are written one after the other."""
    spark, log = log.sparkSession, checkpointed(as_numbers(log))
    log.repartitionByRange(max(1, -(-4 * log.count() // size)), "ts", "id").write.parquet(f"{path}/log")
    files = sorted((r["f"], r["count"]) for r in spark.read.schema(NUMBERS).parquet(f"{path}/log").groupBy(F.input_file_name().alias("f")).count().collect())
    slices: list[list[str]] = []
    n = 0
    for f, count in files:  # named after their range
        if not slices or n + count > size:
            slices.append([])
            n = 0
        slices[-1].append(f)
        n += count
    if len(slices) < 2:
        return spark.readStream.schema(NUMBERS).parquet(f"{path}/log")
    for own in slices:
        spark.read.schema(NUMBERS).parquet(*own).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(NUMBERS).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def import_into(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what is new, run through all that is there, and stop. The checkpoint is the cursor: it moves on only after a write."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_series(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """What a new batch is compared with: itself and the existing photos of no series; a series that there is never grows."""
    return batch.unionByName(existing.filter("group_id is null or group_id = ''").join(batch.select("id"), "id", "left_anti"))
