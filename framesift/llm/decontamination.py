"""Benchmark decontamination by SimHash windows: DataFrame functions only.

Texts are lower-cased words; an item is a benchmark text of n words. A window
of a document can be similar only if it shares a five-word shingle with an
item, so windows are as long as an item and laid so that a shared shingle is at
the item's own place. Every window gets a 64-bit SimHash of its shingles,
weighted by how often each occurs. Fingerprints are cut into RADIUS + 1 blocks:
two within RADIUS bits agree in a whole block, so the join on blocks finds all
of them. At the similarity asked for, blocks are two or three bits wide and
would bring together nearly all windows and items; so an index is kept for each
item, and a window is looked up in those of the items whose shingle laid it.
Candidates are verified by the exact similarity of the weighted shingles, sum
of smaller over sum of larger weights.

Defined results: null or empty texts and items match nothing; fewer than five
words are one shingle; a document shorter than an item is one window; rows are
told apart by doc_id and text, and repeated rows count once; items of one id
and different texts are all looked for; ties go to the most similar, then first
window. Other columns are ignored (``findings``) or pass through (``clean``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import boxed, cut, drop_cut, short_batches, small, table

SHINGLE = 5
#: At a similarity of 3/4 SimHashes differ in 11 bits on average, with a deviation of 3.
RADIUS = 22
GAP = r"[\x20\x09-\x0D]+"


def words(text: str = "text") -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), GAP), "")


def shingles(w: str) -> Column:
    """Hashes of the shingles of an array of words, in order."""
    return F.expr(f"case when size({w}) = 0 then cast(array() as array<bigint>) else transform(sequence(1, greatest(size({w}) - {SHINGLE - 1}, 1)), i -> xxhash64(slice({w}, i, {SHINGLE}))) end")


def weighted(g: str) -> Column:
    """Shingles in order, each tagged with which occurrence it is: a multiset as a set."""
    again = "if(x = s.p and s.k > 0, s.k + 1, 1)"
    return F.expr(f"aggregate(array_sort({g}), named_struct('a', cast(array() as array<bigint>), 'p', 0L, 'k', 0), (s, x) -> named_struct('a', array_append(s.a, xxhash64(x, {again})), 'p', x, 'k', {again}), s -> s.a)")


def simhash(g: str) -> Column:
    """Bit b is set where more than half of the shingles have it set."""
    ones = f"aggregate({g}, 0, (n, x) -> n + cast(shiftrightunsigned(x, b) & 1 as int))"
    return F.expr(f"aggregate(sequence(0, 63), 0L, (f, b) -> f | if(2 * {ones} > size({g}), shiftleft(1L, b), 0L))")


def blocks(f: str) -> Column:
    """The fingerprint's RADIUS + 1 blocks, each as one number with its place."""
    n = RADIUS + 1
    edge = [64 * i // n for i in range(n + 1)]
    return F.array(*[F.expr(f"(shiftrightunsigned({f}, {a}) & {(1 << (b - a)) - 1}) * 64 + {i}") for i, (a, b) in enumerate(zip(edge, edge[1:], strict=False))])


def prepare(benchmark: DataFrame) -> DataFrame:
    """item (a hash of the words), item_id, n_words, shingles g, weighted set s and fingerprint f of each item with words."""
    b = benchmark.select("item_id", words().alias("w")).filter("size(w) > 0").select(F.xxhash64("item_id", "w").alias("item"), "item_id", F.size("w").alias("n_words"), shingles("w").alias("g"))
    return cut(b.dropDuplicates(["item"]).select("*", weighted("g").alias("s"), simhash("g").alias("f")), "items")


def findings(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), item_id, start_word, n_words, similarity: the best window of each document and item."""
    short_batches(docs.sparkSession)
    items = prepare(benchmark)
    seeds = cut(items.select("item", "n_words", F.posexplode("g").alias("o", "x")), "seeds")
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text")
    at = keyed.select("doc_id", "h", words().alias("w")).select("doc_id", "h", F.posexplode(shingles("w")).alias("p", "x"))
    laid = at.join(small(seeds), "x").select("doc_id", "h", F.greatest(F.col("p") - F.col("o"), F.lit(0)).alias("start"), "n_words", "item").distinct()
    laid = cut(laid, "laid")
    places = cut(laid.groupBy("doc_id", "h").agg(F.collect_set(F.struct("start", "n_words")).alias("windows")), "places")
    wide = keyed.alias("k").join(small(places).alias("l"), F.expr("k.doc_id <=> l.doc_id and k.h = l.h")).select("k.doc_id", "k.h", words().alias("w"), "windows").dropDuplicates(["doc_id", "h"])
    one = wide.select("doc_id", "h", "w", F.explode("windows").alias("v")).select("doc_id", "h", "v.start", F.col("v.n_words").alias("n_item"), F.expr("slice(w, v.start + 1, v.n_words)").alias("v"))
    seen = cut(one.filter("size(v) > 0").select("doc_id", "h", "start", "n_item", F.size("v").alias("n_words"), F.xxhash64("v").alias("window"), shingles("v").alias("g")), "windows")
    # equal windows are fingerprinted and compared once
    kinds = seen.groupBy("window").agg(F.first("g").alias("g"))
    kinds = cut(kinds.select("window", weighted("g").alias("s"), simhash("g").alias("f")), "prints")
    of = laid.alias("l").join(seen.alias("w"), F.expr("l.doc_id <=> w.doc_id and l.h = w.h and l.start = w.start and l.n_words = w.n_item"))
    of = cut(of.select("l.doc_id", "l.h", "l.item", "l.start", "w.n_words", "w.window"), "looked-up")
    left = of.select("window", "item").distinct().join(kinds.select("window", "f"), "window").select("window", "item", "f", F.explode(blocks("f")).alias("block"))
    right = items.select("item", F.col("f").alias("fi"), F.explode(blocks("f")).alias("block"))
    near = left.join(small(right), ["item", "block"]).filter(F.bit_count(F.col("f").bitwiseXOR(F.col("fi"))) <= RADIUS).select("window", "item").distinct()
    sets = near.join(kinds.select("window", "s"), "window").join(small(items.select("item", F.col("s").alias("si"))), "item")
    sets = sets.select("window", "item", F.size("s").alias("x"), F.size("si").alias("y"), F.size(F.array_intersect("s", "si")).alias("i"))
    hits = cut(sets.filter("4 * i >= 3 * (x + y - i)").select("window", "item", (F.col("i") / (F.col("x") + F.col("y") - F.col("i"))).alias("similarity")), "hits")
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n_words"))
    found = of.join(small(hits), ["window", "item"]).join(small(items.select("item", "item_id")), "item").groupBy("doc_id", "h", "item_id").agg(best.alias("b"))
    found = cut(found.select("doc_id", "h", "item_id", (-F.col("b.back")).alias("start_word"), "b.n_words", "b.similarity"), "found")
    for done in (seeds, laid, places, seen, kinds, of, hits):
        drop_cut(done)
    return found


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which no item is found; all columns stay."""
    bad = cut(findings(docs.select("doc_id", "text"), benchmark).select("doc_id", "h").distinct(), "leaks")
    boxes = boxed(docs, id=F.col("doc_id"), hash=F.xxhash64(F.coalesce("text", F.lit(""))))
    return boxes.join(small(bad), F.expr("id <=> doc_id and hash = h"), "left_anti").select("row.*")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds an item of the benchmark, with the item and the place."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return findings(docs, table(spark, sf_dir, "benchmark")).drop("h")
