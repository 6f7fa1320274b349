"""Sharding: a Feistel permutation with cycle walking over global row numbers.

Rows get gapless global row numbers from their content alone: identical rows
are counted first, keys are dealt into hash buckets, buckets are numbered by
their counts, and rows by their order within the bucket. A keyed Feistel
network on the smallest even number of bits that holds n, walked until the
value is below n, permutes the numbers; shard = value mod k and
slot = value div k. Shard counts are at most one apart, slots are gapless, and
any row's place follows from its number, n and the seed (``place``).

Defined results: null text is 0 bytes (size 1, crc32 of no bytes); null doc_id
sorts first; repeated rows get different numbers; an empty table gives an
empty result. Other columns are ignored (``shard_documents``) or stay
(``shard_rows``), whatever they are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import boxed, cut, mix, small, table

ROUNDS = 6
#: Keys of one bucket are numbered by one task; so many buckets at least.
BUCKETS = 4096
#: Copies of one row that are numbered in one go.
CHUNK = 100_000


def permute(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Bijection of 0..n-1, elementwise."""
    half = max(1, -(-max(1, int(n - 1).bit_length()) // 2))
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    x = x.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> shift, x[todo] & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        x[todo] = (left << shift) | right
        todo = todo[x[todo] >= n]  # walk on until inside
    return x.astype(np.int64)


def place(row: int, n: int, shards: int, seed: int) -> tuple[int, int]:
    """Shard and slot of a global row number, computed alone."""
    v = int(permute(np.array([row]), n, seed)[0])
    return v % shards, v // shards


def spans_of(rows: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """One row for each key: ``_first``, its first row number, and ``_copies``. The numbers are gapless from 0 and depend on the keys alone."""
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies")).withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    totals = counted.groupBy("_bucket").agg(F.sum("_copies").alias("_n"))
    before = totals.select("_bucket", (F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    own = Window.partitionBy("_bucket").orderBy(*[F.col(k).asc_nulls_first() for k in keys]).rowsBetween(Window.unboundedPreceding, 0)
    first = F.col("_before") + F.sum("_copies").over(own) - F.col("_copies")
    return counted.join(F.broadcast(before), "_bucket").select(*keys, first.alias("_first"), "_copies")  # at most ``buckets`` rows are broadcast


def numbers_in(spans: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """A row with ``row_number`` for each copy. Keys of more than ``chunk`` copies are dealt out in chunks first."""
    every = F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_copies") - 1)).alias("row_number")
    keys = [c for c in spans.columns if c not in ("_first", "_copies")]
    some = spans.filter(F.col("_copies") <= chunk).select(*keys, every)
    at = spans.filter(F.col("_copies") > chunk).select(*keys, "_first", "_copies", F.explode(F.sequence(F.lit(0), F.expr(f"(_copies - 1) div {chunk}"))).alias("_c"))
    parts = at.select(*keys, (F.col("_first") + F.col("_c") * chunk).alias("_first"), F.least(F.lit(chunk), F.col("_copies") - F.col("_c") * chunk).alias("_copies"))
    return some.unionAll(parts.repartition("_first").select(*keys, every))


def shuffle_into(numbered: DataFrame, n: int, shards: int, seed: int, row: str = "row_number") -> DataFrame:
    """Add shard and slot from global row numbers 0..n-1."""

    @F.arrow_udf(T.LongType())
    def value(r: pa.Array) -> pa.Array:
        return pa.array(permute(r.to_numpy(zero_copy_only=False), n, seed))

    out = numbered.withColumn("_value", value(F.col(row)))
    return out.withColumn("shard", (F.col("_value") % shards).cast("int")).withColumn("slot", F.expr(f"_value div {shards}")).drop("_value")


def size_of(text: str | Column = "text") -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.octet_length(c), F.lit(0)).cast("long")


NEW = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def crc_of(text: str = "text") -> Column:
    return F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def _placed(numbered: DataFrame, n: int, shards: int, seed: int) -> DataFrame:
    return shuffle_into(numbered, n, shards, seed).withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int"))


def shard_documents(docs: DataFrame, *, shards: int = 8, seed: int = 20_240_501) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row, under the law ``rows``."""
    keyed = docs.select("doc_id", (size_of() + 1).alias("size"), crc_of().alias("text_crc32"))
    numbered = numbers_in(spans_of(keyed, ["doc_id", "size", "text_crc32"]))
    return _placed(numbered, keyed.count(), shards, seed).select("doc_id", *NEW)


def shard_rows(docs: DataFrame, *, shards: int = 8, seed: int = 20_240_501, hot: int = 1000) -> DataFrame:
    """The rows of docs, whole, with size, text_crc32, law, shard, slot and grown_shard (columns of these names are replaced).

    Keys without the texts are counted and numbered; the rows then meet their
    numbers, which shuffles the corpus once. Rows that are equal in every
    column share a key; those of keys with more than ``hot`` copies don't
    travel: one row of each key does, with its count."""
    own = docs.drop(*NEW)
    whole = F.xxhash64(*[F.col(f"`{c}`") for c in own.columns])
    keyed = boxed(own, id=F.coalesce("doc_id", F.lit(0)).cast("long"), none=F.col("doc_id").isNull(), size=size_of() + 1, text_crc32=crc_of(), whole=whole)
    keys = ["id", "none", "size", "text_crc32", "whole"]
    spans = cut(spans_of(keyed.select(*keys), keys), "spans")
    n = spans.agg(F.sum("_copies")).first()[0] or 0
    copy = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0))) - 1
    numbered = keyed.join(spans.filter(F.col("_copies") <= hot), keys).select("row", "size", "text_crc32", (F.col("_first") + copy).alias("row_number"))
    many = spans.filter(F.col("_copies") > hot)
    if many.limit(1).count():
        rows = keyed.join(small(many.select(*keys)), keys, "left_semi").groupBy(*keys).agg(F.first("row").alias("row"))
        copies = numbers_in(rows.join(many, keys)).select("row", "size", "text_crc32", "row_number")
        numbered = numbered.unionAll(copies)
    return _placed(numbered, n, shards, seed).select("row.*", *NEW)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 8 shards, counts at most one apart."""
    return shard_documents(table(spark, sf_dir, "documents"))
