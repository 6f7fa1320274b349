"""N-gram Jaccard self join: exact set similarity by partitioning the universe.

A document's set is its distinct five-word shingles. Two sets with Jaccard
similarity of at least 3/4 and sizes x, y differ in at most (x + y) / 7
elements. The universe of shingles is hashed into segments, their number set by
size band (in the lowest band every shingle is a segment of its own); a set
that may have a partner in the next band is cut up for that band as well.
By the pigeonhole principle at most H = (x + y) / 7 of a set's
non-empty segments differ from the partner's. So, in any order of segment
contents that all sets share, the first H + 1 contents of either set have one
in common: those are indexed. The order is by cost: contents made of very
frequent shingles come last. Candidates are verified on the whole sets.

Large groups: equal sets are one node. In a group of nodes under one content
each is paired with the first, the hub; components of verified pairs follow. A
link that is still to be found joins two nodes that have met one hub, and one
of them is not in the hub's component. So those are compared with all that have
met the hub: once for each hub, however many contents they share, in parts of
STAR_PART, and by parity bitmaps, so that a pair becomes a row only if it can
be a link. No link that joins two components is lost; what lies in the hub's
component, as most near copies do, is not paired among itself. The comparisons
(not the rows) are the product of both sides.

Defined results: null or empty text has the empty set, linked with nothing,
and its component is its own doc_id; fewer than five words are one shingle;
repeated rows are copies; a null doc_id is ignored when a component's smallest
doc_id is sought (a component of nulls has none); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, boxed, cut, drop_cut, many_rows, mix, short_batches, small, table, texts
from .components import components
from .shingles import set_digest, shingle_sets

#: The bands of sizes: below FIRST_BAND, where every shingle is a segment of its own, then each BAND_RATIO times as far.
FIRST_BAND, BAND_RATIO = 512, 8
#: Shingles of a segment, at the upper end of a band. Up to this, a set has many more non-empty segments than can differ.
SEGMENT_FILL = 2.8
#: A shingle is frequent if windows of documents have it so often; at most so many frequent shingles are sent to the tasks, the most frequent first.
FREQUENT_LEAST, FREQUENT_MOST = 32, 1_000_000
#: Distinct documents, and shingles, that are counted together in one task.
WINDOW_DOCS, WINDOW_SHINGLES = 8192, 3_000_000
#: So many nodes outside a hub's component, at about, are compared in one task with all that have met the hub.
STAR_PART = 1024

MEASURED = "doc_id long, h long, n_shingles long, node long, bits array<long>, shingle long, hits long"


def bands_of(n: int) -> list[tuple[int, int, int]]:
    """(band, lower, upper size) of the bands under which a set of n elements is indexed: its own, and the next if a partner can be there."""
    band, low, high = 0, 1, FIRST_BAND - 1
    while n > high:
        band, low, high = band + 1, high + 1, (high + 1) * BAND_RATIO - 1
    out = [(band, low, high)]
    if 4 * n // 3 > high:
        out.append((band + 1, high + 1, (high + 1) * BAND_RATIO - 1))
    return out


def segments_of(s: np.ndarray, band: int, high: int) -> np.ndarray:
    """The number of every shingle's segment under a band."""
    h = mix(s ^ np.uint64(0x5851F42D4C957F2D))
    return h if band == 0 else (h >> np.uint64(32)) % np.uint64(int(high / SEGMENT_FILL))


def signatures(s: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the indexed segment contents of a set (sorted distinct hashes), and a key for each: 2^40 * owned + n.

    ``frequent`` is sorted. ``owned`` is 0 but for a frequent content of the
    lowest band: there it is the number of the set's rare shingles. All rare
    ones are indexed then, so two sets that meet in frequent contents only
    differ in the rare ones of both."""
    n = len(s)
    out, keys = [], []
    rare = np.ones(n, bool)
    if len(frequent):
        rare = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] != s
    for band, _, high in bands_of(n):
        differ = (n + min(4 * n // 3, high)) // 7  # from a partner as large as can be under this band
        seg = segments_of(s, band, high)
        order = np.argsort(seg, kind="stable")
        seg, member = seg[order], s[order]
        first = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
        content = mix(np.add.reduceat(mix(member + np.uint64(band)), first) ^ mix(seg[first] + np.uint64(band)))
        cheap = np.logical_or.reduceat(rare[order], first)
        # the order that all sets share: contents with a rare shingle first, then by hash
        rank = (content >> np.uint64(1)) | np.where(cheap, np.uint64(0), np.uint64(1 << 63))
        pick = np.argpartition(rank, differ)[: differ + 1] if differ + 1 < len(rank) else np.arange(len(rank))
        out.append(content[pick])
        keys.append(np.where(cheap[pick] | (band > 0), 0, int(rare.sum())) * (1 << 40) + n)
    return np.concatenate(out), np.concatenate(keys)


def parity_bits(s: np.ndarray) -> np.ndarray:
    """A bit for each residue of the hashes, set if an odd number of them has it; 2 to 4 bits a shingle, 64 at least.

    Sets that differ in d elements have bitmaps that differ in at most d bits.
    The two halves of a bitmap, by exclusive or, are the one of half the size."""
    size = 1 << max(6, (2 * len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def may_be_link(x: str, y: str) -> str:
    """SQL: sizes and bitmaps (n_shingles and bits of x and y) allow the similarity."""
    folded = lambda b, to: f"zip_with(slice({b}, 1, size({to})), slice({b}, size({to}) + 1, size({to})), (p, q) -> p ^ q)"
    apart = lambda a, b: f"aggregate(zip_with({a}, {b}, (p, q) -> bit_count(p ^ q)), 0, (n, k) -> n + k)"
    a, b, n, m = f"{x}.bits", f"{y}.bits", f"{x}.n_shingles", f"{y}.n_shingles"
    # sizes that fit differ in one doubling of the bitmap at most
    bits = f"case when size({a}) = size({b}) then {apart(a, b)} when size({a}) > size({b}) then {apart(folded(a, b), b)} else {apart(a, folded(b, a))} end"
    return f"case when 4 * {n} >= 3 * {m} and 4 * {m} >= 3 * {n} then {bits} <= floor(({n} + {m}) / 7) else false end"


def measure(docs: DataFrame) -> DataFrame:
    """A row with doc_id, h (a hash of the text), n_shingles and node for every document, and rows with a shingle and in how many documents of a window it is, if in several."""
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("bits", pa.list_(pa.int64())), ("shingle", pa.int64()), ("hits", pa.int64())])

    def counted(window: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        s, hits = np.unique(np.concatenate(window), return_counts=True)
        s, hits = s[hits >= 2], hits[hits >= 2]
        if len(s):
            none = pa.nulls(len(s), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(len(s), pa.list_(pa.int64())), pa.array(s.view(np.int64)), pa.array(hits)], schema=schema)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window: dict[int, np.ndarray] = {}
        held = 0
        for b in it:
            nodes, sizes, bits = [], [], []
            for s in shingle_sets(texts(b)):
                sizes.append(len(s))
                nodes.append(set_digest(s) if len(s) else None)
                bits.append(parity_bits(s) if len(s) else None)
                if len(s) and nodes[-1] not in window:
                    window[nodes[-1]] = s
                    held += len(s)
                    if len(window) >= WINDOW_DOCS or held > WINDOW_SHINGLES:
                        yield from counted(list(window.values()))
                        window, held = {}, 0
            none = pa.nulls(len(nodes), pa.int64())
            ids = b.column(b.schema.get_field_index("doc_id")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([ids, b.column(b.schema.get_field_index("h")), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(bits, pa.list_(pa.int64())), none, none], schema=schema)
        if window:
            yield from counted(list(window.values()))

    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(run, MEASURED)


def index(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """sig, key, node: the indexed contents of every document; copies within a batch once."""
    schema = pa.schema([("sig", pa.int64()), ("key", pa.int64()), ("node", pa.int64())])
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            done: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for s in shingle_sets(texts(b)):
                if len(s) and (node := set_digest(s)) not in done:
                    done[node] = signatures(s, sent.value)
            if done:
                sig = np.concatenate([x for x, _ in done.values()]).view(np.int64)
                key = np.concatenate([k for _, k in done.values()])
                node = np.repeat(np.fromiter(done, np.int64, len(done)), [len(x) for x, _ in done.values()])
                yield from batches({"sig": pa.array(sig), "key": pa.array(key), "node": pa.array(node)}, schema)

    return docs.select("text").mapInArrow(run, "sig long, key long, node long")


def groups(indexed: DataFrame) -> DataFrame:
    """sig, hub, node, with their keys, for every node but the first of each content's group. sig is null if the group is a mere pair.

    Rows of one content come sorted to one task and stream through; only the
    first node of the group at hand, the one with the fewest rare shingles, is
    held. A node of more rare shingles than can differ, with the hub's, from
    any partner is in no pair of this group."""
    names = ("sig", "hub_key", "hub", "key", "node")
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # sig, hub key, hub, node of the row before
        for b in it:
            if not b.num_rows:
                continue
            sig, key, node = (c.to_numpy() for c in b.columns)
            fresh = np.append(last is None or last[0] != sig[0], sig[1:] != sig[:-1])
            first = np.flatnonzero(fresh)
            group = np.cumsum(fresh) - 1  # -1: goes on from the batch before
            of = first[np.maximum(group, 0)] if len(first) else np.zeros(len(sig), np.int64)
            hub = np.where(group >= 0, node[of], last[2] if last else 0)
            hub_key = np.where(group >= 0, key[of], last[1] if last else 0)
            again = np.append(last is not None and last[0] == sig[0] and last[3] == node[0], (sig[1:] == sig[:-1]) & (node[1:] == node[:-1]))
            size = key & ((1 << 40) - 1)
            keep = (node != hub) & ~again & ((hub_key >> 40) + (key >> 40) <= size // 3)
            count = np.bincount(group[keep] + 1, minlength=group[-1] + 2)
            whole = np.ones(len(count), bool)
            whole[0] = whole[-1] = False  # may go on before or after
            pair = (count == 1) & whole
            last = (sig[-1], hub_key[-1], hub[-1], node[-1])
            if keep.any():
                own = pa.array(sig[keep], mask=pair[group[keep] + 1])
                yield pa.RecordBatch.from_arrays([own, *(pa.array(x[keep]) for x in (hub_key, hub, key, node))], schema=schema)

    dealt = indexed.repartition("sig").sortWithinPartitions("sig", "key", "node")
    return dealt.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def may_link(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those pairs (a, b) that their sizes and bitmaps don't rule out."""
    n = nodes.select("node", "n_shingles", "bits")
    both = pairs.select("a", "b").alias("p").join(n.alias("x"), F.expr("p.a = x.node")).join(n.alias("y"), F.expr("p.b = y.node"))
    return both.filter(F.expr(may_be_link("x", "y"))).select("p.a", "p.b")


def across(grouped: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that have met one hub, and that sizes and bitmaps don't rule out."""
    met = grouped.filter("sig is not null").select("hub", "node").distinct()
    r = roots.select(F.col("node").alias("of"), "root")
    met = met.join(r, F.expr("node = of"), "left").select("hub", "node", F.coalesce("root", "node").alias("root"))
    met = cut(met.alias("m").join(r.alias("r"), F.expr("m.hub = r.of"), "left").select("hub", "node", "m.root", F.coalesce("r.root", "hub").alias("home")), "met")
    star = met.groupBy("hub").agg(F.count_if(F.expr("root <> home")).alias("outside"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    star = star.filter("outside > 0 and lo <> hi").select("hub", F.ceil(F.col("outside") / STAR_PART).cast("int").alias("parts"))
    full = met.join(star, "hub").join(nodes.select("node", "n_shingles", "bits"), "node")
    full = cut(full, "stars")
    x = full.filter("root <> home").withColumn("part", F.expr("cast(pmod(xxhash64(node), parts) as int)")).alias("x")
    y = full.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("y")
    can = f"x.hub = y.hub and x.part = y.part and case when x.root <> y.root and (y.root = y.home or x.node < y.node) then {may_be_link('x', 'y')} else false end"
    found = cut(x.join(y, F.expr(can)).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct(), "across")
    drop_cut(met)
    drop_cut(full)
    return found


def node_sets(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """node, elements of the nodes in ``pairs``, from the texts again."""
    wanted = cut(pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct().join(nodes.select("node", "doc_id"), "node"), "wanted")
    schema = pa.schema([("node", pa.int64()), ("elements", pa.list_(pa.int64()))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            sets = [s for s in shingle_sets(texts(b)) if len(s)]
            if sets:
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                flat = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([set_digest(s) for s in sets], pa.int64()), flat], schema=schema)

    w = wanted.select(F.col("doc_id").alias("_id")).distinct()
    texts_of = docs.select("doc_id", "text").join(small(w), F.expr("doc_id <=> _id"), "left_semi")
    return texts_of.mapInArrow(run, "node long, elements array<long>").join(small(wanted.select("node")), "node", "left_semi").dropDuplicates(["node"])


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs (a, b) of nodes whose sets have 100 * intersection >= 75 * union."""
    s = sets.select("node", "elements")
    both = pairs.join(s.select(F.col("node").alias("a"), F.col("elements").alias("ea")), "a").join(s.select(F.col("node").alias("b"), F.col("elements").alias("eb")), "b")
    x, y = F.size("ea"), F.size("eb")
    near = both.filter((4 * x >= 3 * y) & (4 * y >= 3 * x))
    return near.withColumn("_i", F.size(F.array_intersect("ea", "eb"))).filter(100 * F.col("_i") >= 75 * (x + y - F.col("_i"))).select("a", "b")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, and h (xxhash64 of the text) and root (a name of the component; null for empty sets), for every row of docs (columns doc_id, text)."""
    spark = docs.sparkSession
    short_batches(spark)
    measured = cut(measure(docs), "measured")
    rows = measured.filter("n_shingles is not null").select("doc_id", "h", "n_shingles", "node")
    found = measured.filter("shingle is not null").groupBy("shingle").agg(F.sum("hits").alias("hits")).filter(F.col("hits") >= FREQUENT_LEAST)
    frequent = found.orderBy(F.desc("hits"), "shingle").limit(FREQUENT_MOST).select("shingle").toPandas()["shingle"].to_numpy(np.int64)
    nodes = cut(measured.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("bits").alias("bits")), "nodes")
    many_rows(spark)
    grouped = cut(groups(index(docs, np.sort(frequent.view(np.uint64)))), "groups")
    short_batches(spark)
    # every node of a group with its first
    pairs = cut(grouped.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    near = cut(may_link(pairs, nodes), "near")
    sets = cut(node_sets(docs, nodes, near), "sets")
    links = cut(verify(near, sets), "links")
    roots = cut(components(links), "roots")
    # what is left: pairs that have met one hub and lie in different components
    near = across(grouped, nodes, roots)
    more_sets = cut(node_sets(docs, nodes, near), "sets")
    r = roots.select(F.col("node").alias("of"), "root")
    more = verify(near, more_sets).join(r.alias("x"), F.expr("a = x.of"), "left").join(r.alias("y"), F.expr("b = y.of"), "left")
    more = cut(more.select(F.coalesce("x.root", "a").alias("a"), F.coalesce("y.root", "b").alias("b")).distinct(), "links")
    placed = nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    if more.limit(1).count():
        joined = components(more)
        placed = placed.join(joined.toDF("of", "lower"), F.expr("root = of"), "left").select("node", F.coalesce("lower", "root").alias("root"))
    placed = cut(placed, "placed")
    lowest = rows.filter("node is not null").join(placed, "node").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    root_of = cut(placed.join(lowest, "root").select("node", "component_id", "root"), "root-of")
    for done in (grouped, pairs, sets, more_sets, placed):
        drop_cut(done)
    full = rows.filter("node is not null").join(root_of, "node").select("doc_id", "n_shingles", "component_id", "h", "root")
    return full.unionAll(rows.filter("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "h", F.lit(None).cast("long").alias("root")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: one of each component (the smallest doc_id; a null only if there is no other), and all with an empty set. All columns stay."""
    rows = cut(jaccard_components(docs.select("doc_id", "text")), "components")
    first = rows.filter("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("r")).select("r.doc_id", "r.h")
    kept = cut(first.unionAll(rows.filter("root is null").select("doc_id", "h")).distinct(), "kept")
    repeated = cut(rows.filter("root is not null").groupBy("doc_id", "h").count().filter("count > 1").select("doc_id", "h"), "repeated")
    drop_cut(rows)
    boxes = boxed(docs, id=F.col("doc_id"), hash=F.xxhash64("text"))
    stay = boxes.join(small(kept), F.expr("id <=> doc_id and hash = h"), "left_semi")
    twice, again = small(repeated), F.expr("id <=> doc_id and hash = h")
    one = stay.join(twice, again, "left_semi").withColumn("body", F.col("row.text")).dropDuplicates(["id", "body"])
    return stay.join(twice, again, "left_anti").select("row.*").unionAll(one.select("row.*"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: 100 * intersection >= 75 * union of their shingle sets."""
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
l AS (SELECT x, y FROM p UNION SELECT y, x FROM p),
r AS (SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id FROM s JOIN c ON s.doc_id = c.x
"""
