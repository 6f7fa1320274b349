"""Small helpers that every training-data operator uses."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of one Arrow batch: texts are long, so batches are kept short.
ARROW_ROWS = 512
#: A table of at most so many bytes, by the sizes of its values, may be broadcast.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of whole texts takes in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))
    except Exception as e:  # the setting is newer than some Spark versions
        if "CANNOT_MODIFY" not in str(e):
            raise


def many_rows(spark: SparkSession) -> None:
    """Longer Arrow batches, for stages whose rows are a few numbers; bytes are bounded as before."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50000")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, else the session's checkpoint folder. Only a local session gets one of its own where both are unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = at.get() if at.isDefined() else None
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="framesift-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Remove the files behind a table made by cut() once nothing reads it any more."""
    spark = df.sparkSession
    base = shared_dir(spark).rstrip("/")
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        if base.split(":")[-1] in f:
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only where the sizes of all values, summed up, show that the table is small; else Spark shuffles it."""
    size: Column = F.lit(0)
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType):
            size = size + F.lit(16) * F.coalesce(F.size(c), F.lit(0))
        elif isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(c), F.lit(0))
        size = size + F.lit(16)
    return F.broadcast(df) if (df.agg(F.sum(size.cast("long"))).first()[0] or 0) <= most else df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column of df is called so."""
    while name in df.columns:
        name += "_"
    return name


def boxed(docs: DataFrame, **named: Column) -> DataFrame:
    """The rows of docs as one struct ``row``, and columns by name beside it: no column of docs can clash with those of an operator."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(whole.alias("row"), *[c.alias(n) for n, c in named.items()])


def fold(doc_id: str | Column, k: int) -> Column:
    """crc32 of the id as text, mod k: the fold that a contract names."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % F.lit(k), F.lit(-1))


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """Whole texts of a batch as UTF-8 bytes; null is empty."""
    a = batch.column(batch.schema.get_field_index(column))
    return [x or b"" for x in a.cast(pa.binary() if not pa.types.is_large_string(a.type) else pa.large_binary()).to_pylist()]


def batches(table_: dict[str, pa.Array | list | np.ndarray], schema: pa.Schema, rows: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Record batches of at most so many rows, of equally long columns."""
    cols = [x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for f, x in zip(schema, (table_[f.name] for f in schema), strict=True)]
    whole = pa.RecordBatch.from_arrays(cols, schema=schema)
    for i in range(0, max(1, whole.num_rows), rows):
        yield whole.slice(i, rows)


#: Odd constants for multiplicative hashing (splitmix64's published ones).
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of splitmix64, on an array of uint64."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))
