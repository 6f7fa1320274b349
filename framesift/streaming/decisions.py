"""Decisions as micro-batches that can be replayed: snapshot, log and history, each written under its batch's number.

Nothing is changed in place. A batch writes what it changes (the delta of the
snapshot, the rows of the log, the history of the users that it touches) into
folders named after it, and a mark at the end; readers see batches with a mark
only. A batch that dies in between leaves folders that nobody reads and its
rerun overwrites; one that has its mark is not run again. The snapshot is a
base and the deltas since; ``compact`` folds them into a new base, whenever it
is worth it. The cursor is the largest time seen; late rows never move it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.undo import SINGLES

DECISION = "user_id long, photo_id long, status string, ts long, seq long"
SNAPSHOT = "photo_id long, status string, ts long, seq long"
LOG = "photo_id long, ai_decision boolean, user_decision boolean, ts long, seq long"
HISTORY = "user_id long, photo_id long, previous string, status string, ts long, seq long, batch long"
MARK = "batch long, cursor long, n long"
SELECT_AT = 65


class DecisionStore:
    """A folder of decisions. ``scores`` (photo_id, status, ai_score) are the photos as they were imported."""

    def __init__(self, spark: SparkSession, path: str, scores: DataFrame):
        self.spark, self.path, self.scores = spark, path.rstrip("/"), scores

    def _there(self, name: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _read(self, name: str, schema: str, batches: list[int]) -> DataFrame:
        paths = [f"{self.path}/{name}/{b}" for b in batches]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, name: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/{batch}")

    def marks(self) -> list[tuple[int, int]]:
        """(batch, cursor) of the batches that are whole; a row for each."""
        if not self._there("mark"):
            return []
        return sorted((r["batch"], r["cursor"]) for r in self.spark.read.schema(MARK).option("recursiveFileLookup", "true").parquet(f"{self.path}/mark").collect())

    def base(self) -> int:
        """The last batch that is folded into the base; -1 without one."""
        if not self._there("folded"):
            return -1
        return self.spark.read.schema("batch long").option("recursiveFileLookup", "true").parquet(f"{self.path}/folded").agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0]

    def cursor(self) -> int | None:
        """The largest time seen."""
        return max((c for _, c in self.marks()), default=None)

    def snapshot(self, marks: list[int] | None = None) -> DataFrame:
        """photo_id, status, ts, seq of every photo that has been decided: the newest decision counts, also if it came first."""
        whole = [b for b, _ in self.marks()] if marks is None else marks
        folded = self.base()
        rows = self._read("delta", SNAPSHOT, [b for b in whole if b > folded])
        if folded >= 0:
            rows = rows.unionByName(self._read("base", SNAPSHOT, [folded]))
        return rows.groupBy("photo_id").agg(F.max_by(F.struct("status", "ts", "seq"), F.struct("ts", "seq")).alias("s")).select("photo_id", "s.*")

    def log(self) -> DataFrame:
        return self._read("log", LOG, [b for b, _ in self.marks()])

    def history(self) -> DataFrame:
        """The last SINGLES changes of each user, of the batches in which the user last had some."""
        rows = self._read("history", HISTORY, [b for b, _ in self.marks()])
        last = rows.groupBy("user_id").agg(F.max("batch").alias("batch"))
        return rows.join(last, ["user_id", "batch"]).drop("batch")

    def apply(self, decisions: DataFrame, batch: int) -> None:
        """Take one batch of decisions (DECISION). Run again, it changes nothing."""
        marks = self.marks()
        whole = [b for b, _ in marks]
        if batch in whole or decisions.isEmpty():
            return
        d = decisions.select(*[c.split()[0] for c in DECISION.split(", ")])
        photos = d.select("photo_id").distinct()
        now = photos.join(self.scores, "photo_id", "left").join(self.snapshot(whole).select("photo_id", F.col("status").alias("_now")), "photo_id", "left")
        along = Window.partitionBy("photo_id").orderBy("ts", "seq")
        e = d.join(now.select("photo_id", F.col("ai_score"), F.coalesce("_now", F.col("status")).alias("_was")), "photo_id")
        e = e.withColumn("previous", F.coalesce(F.lag("status").over(along), F.col("_was")))
        self._write(e.groupBy("photo_id").agg(F.max_by(F.struct("status", "ts", "seq"), F.struct("ts", "seq")).alias("s")).select("photo_id", "s.*"), "delta", batch)
        learned = e.filter(F.col("status").isin("selected", "rejected") & F.col("ai_score").isNotNull())
        self._write(learned.select("photo_id", (F.col("ai_score") >= SELECT_AT).alias("ai_decision"), (F.col("status") == "selected").alias("user_decision"), "ts", "seq"), "log", batch)
        changed = e.filter("previous IS NOT NULL AND previous <> status").select("user_id", "photo_id", "previous", "status", "ts", "seq")
        before = self.history().join(changed.select("user_id").distinct(), "user_id", "left_semi")
        newest = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("seq"))
        held = changed.unionByName(before).withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= SINGLES).drop("_r")
        self._write(held.withColumn("batch", F.lit(batch).cast("long")), "history", batch)
        seen = d.agg(F.max("ts").alias("ts"), F.count(F.lit(1)).alias("n")).first()
        cursor = max([seen["ts"], *(c for _, c in marks)])
        self._write(self.spark.createDataFrame([(batch, cursor, seen["n"])], MARK).coalesce(1), "mark", batch)

    def compact(self) -> int:
        """Fold all whole batches into a new base; returns the last of them. Its mark comes last, so that a base half written is never read."""
        whole = [b for b, _ in self.marks()]
        last = max(whole, default=-1)
        if last > self.base():
            self._write(self.snapshot(whole), "base", last)
            self._write(self.spark.createDataFrame([(last,)], "batch long").coalesce(1), "folded", last)
        return last

    def run(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Take all that the stream has, batch by batch, and stop."""
        return stream.writeStream.foreachBatch(lambda d, i: self.apply(d, i)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
