"""Prefix trie of conversations, its subtree totals by leaf-peeling message passing.

Turns are numbered within their conversations and rebuilt (the first few turns
come from the first conversation of their hundred). Every distinct sequence of
first d turns is a node. Nodes are told apart by two 64-bit hashes of the sums
of their turns' hashes, each hashed with its place; sums can be taken in parts,
so no task needs all of a conversation.

Message passing: conversations draw lots (a hash of their ids), and a node
belongs to the path of its member with the smallest lot. A conversation that
owns a node owns all that follows on its way, so paths run to a conversation's
end, and on any way from the root to a leaf the owner changes about ln(members)
times, whatever the shape of the trie. Paths are the nodes that messages pass
between: each holds a counter of the paths that leave it and are not complete.
Those with none left send the totals of their subtree, and the depth at which
they hang, to their parent path; it adds them up and counts down; rounds go on
until the path of the root has finished. Every round's tables are written, so a
lost executor costs a round at most. Then totals of a path's nodes are sums
from its end up to each node, in stretches of depths.

Hot keys: turns are numbered by ranges of (conv_id, turn, role, text), equal
rows dealt at random; sums along a conversation or path are taken by stretches
of STRETCH, then over the stretches; members, children and messages are summed
before they are shuffled; the ids of a node's ends are joined to strings for
each CHUNK of ids and, where there are several, hashed as a stream.

Defined results: a null conv_id names no conversation, its rows are left out;
null turns come first; turns of one number come by role and text; null role or
text is empty; repeated rows are turns of their own; a conversation that is
rebuilt without turns is a member of the root only; an empty table has no
nodes; texts of any length count by their code points; other columns are
ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut, table

#: Turns or nodes that follow each other and are summed up in one window.
STRETCH = 512
#: Bits of an id that are left open within a chunk of 2,048 ids.
CHUNK_BITS = 11
#: Conversations of one hundred share the first turns of its first; at most so many.
BLOCK, SHARED = 100, 6
NO_ENDS = hashlib.sha256(b"").hexdigest()


def running(rows: DataFrame, key: str, at: str, sums: dict[str, str], *, down: bool = False, kind: str = "decimal(38,0)") -> DataFrame:
    """Add running sums of columns along ``at`` (a long, distinct within the key) within each key, the row itself included; {column: name of its sum}."""
    b = F.floor(F.col(at) / STRETCH)
    rows = rows.withColumn("_b", b)
    parts = rows.groupBy(key, "_b").agg(*[F.sum(F.col(c).cast(kind)).cast(kind).alias(f"_{c}") for c in sums])
    order = lambda c: F.col(c).desc() if down else F.col(c)
    before = Window.partitionBy(key).orderBy(order("_b")).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col(key).alias("_key"), F.col("_b").alias("_of"), *[F.coalesce(F.sum(f"_{c}").over(before).cast(kind), F.lit(0).cast(kind)).alias(f"_{c}") for c in sums])
    within = Window.partitionBy(key, "_b").orderBy(order(at)).rowsBetween(Window.unboundedPreceding, 0)
    j = rows.join(parts, (F.col(key) == F.col("_key")) & (F.col("_b") == F.col("_of")))
    return j.select(*[F.col(c) for c in rows.columns if c != "_b"], *[(F.col(f"_{c}") + F.sum(F.col(c).cast(kind)).over(within)).cast(kind).alias(n) for c, n in sums.items()])


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1, in the order of turns), x and y (hashes of role and text), size (code points) of every turn."""
    c = lambda n: F.coalesce(F.col(n).cast("string"), F.lit(""))
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", c("role").alias("role"), c("text").alias("text"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    dealt = rows.withColumn("_salt", F.rand(1)).repartitionByRange(*order, "_salt").sortWithinPartitions(*order)
    x = [F.xxhash64(F.lit(s), "role", "text") for s in (1, 2)]
    seen = cut(dealt.select("conv_id", x[0].alias("x"), x[1].alias("y"), F.char_length("text").cast("long").alias("size"), F.monotonically_increasing_id().alias("at")).withColumn("part", F.shiftright("at", 33)), "trie-turns")
    spans = seen.groupBy("conv_id", "part").agg(F.min("at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("_n")
    spans = spans.select("conv_id", "part", "_first", before.alias("_before"))
    return seen.join(spans, ["conv_id", "part"]).select("conv_id", (F.col("at") - F.col("_first") + F.col("_before") + 1).alias("place"), "x", "y", "size")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, x, y, size of every rebuilt turn; conv_id, n of every conversation, n being its rebuilt turns)."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")).select("conv_id", "own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("base"))
    first = convs.filter("conv_id = base").select(F.col("base").alias("_base"), F.col("own").alias("_there"))
    c = convs.join(first, F.col("base") == F.col("_base"), "left").withColumn("taken", F.least("h", F.coalesce("_there", F.lit(0)))).drop("_base", "_there")
    c = cut(c.withColumn("n", F.when(F.col("conv_id") == F.col("base"), F.col("own")).otherwise(F.col("taken") + F.greatest(F.lit(0), F.col("own") - F.col("h")))), "trie-convs")
    mine = turns.join(c, "conv_id").filter("conv_id = base OR place > h").withColumn("depth", F.expr("if(conv_id = base, place, taken + place - h)"))
    heads = turns.filter((F.col("place") < SHARED) & (F.col("conv_id") % BLOCK == 0)).select(F.col("conv_id").alias("base"), F.col("place").alias("depth"), "x", "y", "size")
    lent = c.filter("conv_id <> base AND taken > 0").join(heads, "base").filter("depth <= taken")
    cols = ["conv_id", "depth", "x", "y", "size", "n"]
    return mine.select(*cols).unionByName(lent.select(*cols)), c.select("conv_id", "n")


def name(depth: Column, p: Column, q: Column) -> list[Column]:
    """Two hashes that name a node."""
    return [F.xxhash64(F.lit(s), depth.cast("long"), p, q) for s in (3, 4)]


def members(steps: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for every conversation and node that it is a member of: a, b name the node, pa, pb its parent."""
    zero = F.lit(0).cast("decimal(38,0)")
    terms = steps.withColumn("p", F.xxhash64("depth", "x")).withColumn("q", F.xxhash64("depth", "y"))
    s = running(terms, "conv_id", "depth", {"p": "ps", "q": "qs"})
    own, up = name(F.col("depth"), F.col("ps"), F.col("qs")), name(F.col("depth") - 1, (F.col("ps") - F.col("p")).cast("decimal(38,0)"), (F.col("qs") - F.col("q")).cast("decimal(38,0)"))
    s = s.select("conv_id", "depth", own[0].alias("a"), own[1].alias("b"), up[0].alias("pa"), up[1].alias("pb"), "size", (F.col("depth") == F.col("n")).alias("ends"))
    root, none = name(F.lit(0), zero, zero), F.lit(None).cast("long")
    roots = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), root[0].alias("a"), root[1].alias("b"), none.alias("pa"), none.alias("pb"), F.lit(0).cast("long").alias("size"), (F.col("n") == 0).alias("ends"))
    return s.unionByName(roots)


def nodes_of(members_: DataFrame) -> DataFrame:
    """A row for every node: its name, smallest member, depth, members, children, path and parent, and what it adds to totals."""
    lot = F.struct(F.xxhash64(F.lit(7), "conv_id").alias("lot"), "conv_id")
    n = cut(members_.groupBy("a", "b").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.max("pa").alias("pa"), F.max("pb").alias("pb"), F.count(F.lit(1)).alias("n_convs"), F.max("size").alias("size"), F.min(lot)["conv_id"].alias("path")), "trie-names")
    up = n.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"), F.col("path").alias("parent_path"))
    kids = n.groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    full = n.join(up, ["pa", "pb"], "left").join(kids, ["a", "b"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    out = cut(full.select("a", "b", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "path", "parent_path", ((F.col("n_convs") - 1) * F.col("size")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaf")), "trie-nodes")
    drop_cut(n)
    return out


def peel(nodes: DataFrame) -> DataFrame:
    """path, depth, leaves, saved: what complete paths have sent to the node of a path at a depth."""
    paths = nodes.groupBy("path").agg(F.min(F.struct("depth", "parent_path")).alias("top"), F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"))
    paths = cut(paths.select("path", F.col("top.parent_path").alias("parent"), (F.col("top.depth") - 1).alias("at"), "leaves", "saved"), "trie-paths")
    left = paths.groupBy(F.col("parent").alias("path")).agg(F.count(F.lit(1)).alias("waits"))
    open_ = cut(paths.join(left, "path", "left").withColumn("waits", F.coalesce("waits", F.lit(0))), "trie-open")
    drop_cut(paths)
    sent = []
    while not open_.isEmpty():
        done = cut(open_.filter("waits = 0").select("parent", "at", "leaves", "saved"), "trie-done")
        if done.isEmpty():
            raise RuntimeError("paths wait for each other: two sequences share a hash")
        sent.append(done)
        came = done.groupBy(F.col("parent").alias("path")).agg(F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"), F.count(F.lit(1)).alias("_came"))
        more = lambda c: (F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c)
        rest = open_.filter("waits > 0").join(came, "path", "left").select("path", "parent", "at", more("leaves"), more("saved"), (F.col("waits") - F.coalesce("_came", F.lit(0))).alias("waits"))
        rest = cut(rest, "trie-open")
        drop_cut(open_)
        open_ = rest
    drop_cut(open_)
    if not sent:
        return nodes.select("path", "depth", F.col("leaf").alias("leaves"), "saved")
    every = sent[0]
    for x in sent[1:]:
        every = every.unionAll(x)
    out = cut(every.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("path"), F.col("at").alias("depth")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), "trie-sent")
    for x in sent:
        drop_cut(x)
    return out


def stream_ends(parts: DataFrame) -> DataFrame:
    """a, b, chunk, ids -> a, b, ends_sha256 over the chunks of each node in order; a task holds one hash and one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, out = None, None, []
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(3)]
            for key, ids in zip(zip(cols[0], cols[1], strict=True), cols[2], strict=True):
                if key != at:
                    if state:
                        out.append((*at, state.hexdigest()))
                    at, state = key, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
        if state:
            out.append((*at, state.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["a", "b", "ends_sha256"])

    sorted_ = parts.repartition("a", "b").sortWithinPartitions("a", "b", "chunk").select("a", "b", "ids")
    return sorted_.mapInArrow(run, "a long, b long, ends_sha256 string")


def ends_of(members_: DataFrame) -> DataFrame:
    """a, b, ends_sha256 of every node at which a conversation ends."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    parts = cut(members_.filter("ends").groupBy("a", "b", F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(ids.alias("ids")), "trie-ends")
    many = parts.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("ids").alias("ids"))
    hot = many.filter("n > 1").select("a", "b")
    return many.filter("n = 1").select("a", "b", F.sha2("ids", 256).alias("ends_sha256")).unionByName(stream_ends(parts.join(hot, ["a", "b"], "left_semi")))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for every node of the trie of rebuilt conversations (conv_id, turn, role, text)."""
    steps, convs = rebuilt(numbered(conversations))
    m = cut(members(steps, convs), "trie-members")
    n = nodes_of(m)
    came = peel(n)
    here = n.join(came.select("path", "depth", F.col("leaves").alias("_leaves"), F.col("saved").alias("_saved")), ["path", "depth"], "left")
    here = here.withColumn("leaf", F.col("leaf") + F.coalesce("_leaves", F.lit(0))).withColumn("saved", F.col("saved") + F.coalesce("_saved", F.lit(0))).drop("_leaves", "_saved")
    whole = running(here, "path", "depth", {"leaf": "n_leaves", "saved": "saved_tokens"}, down=True, kind="long")
    out = whole.join(ends_of(m), ["a", "b"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all conversations."""
    return prefix_trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


OP13_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
digits AS (
  SELECT conv_id, own, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [CAST(ord(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])) AS bits
  FROM (SELECT conv_id, count(*) AS own FROM t GROUP BY conv_id)),
c AS (
  SELECT conv_id, own, conv_id - conv_id % 100 AS base,
    xor(list_reduce(list_prepend(4294967295::BIGINT, bits), lambda crc, x: CASE WHEN xor(crc, x) % 2 = 1 THEN xor(xor(crc, x) >> 1, 3988292384::BIGINT) ELSE xor(crc, x) >> 1 END), 4294967295::BIGINT) % 6 AS h
  FROM digits),
r AS (
  SELECT t.conv_id, h + place AS pos, role, text FROM t JOIN c ON t.conv_id = c.conv_id WHERE place > h
  UNION ALL
  SELECT c.conv_id, place AS pos, role, text FROM c JOIN t ON t.conv_id = c.base WHERE place <= h),
w AS (
  SELECT c.conv_id, coalesce(list(md5(length(role) || ':' || role || text) ORDER BY pos) FILTER (pos IS NOT NULL), []) AS ids, list(length(text) ORDER BY pos) AS sizes
  FROM c LEFT JOIN r ON c.conv_id = r.conv_id GROUP BY c.conv_id),
p AS (SELECT conv_id, ids, sizes, unnest(range(0, len(ids) + 1)) AS depth FROM w),
n AS (
  SELECT array_to_string(ids[1:depth], '') AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(ids[1:depth]) AS way,
    CASE WHEN depth > 0 THEN any_value(sizes[depth]) ELSE 0 END AS size,
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(ids) = depth), '') AS ends
  FROM p GROUP BY 1, 2),
k AS (SELECT array_to_string(way[1:depth - 1], '') AS up, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
m AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k ON n.node = k.up AND n.depth = k.depth),
s AS (
  SELECT array_to_string(way[1:up], '') AS node, up AS depth, sum((n_convs - 1) * size) AS saved, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS leaves
  FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM m) GROUP BY 1, 2)
SELECT m.conv_id, m.depth, o.conv_id AS parent_conv_id, m.n_convs, m.n_children, CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(m.ends) AS ends_sha256
FROM m JOIN s ON m.node = s.node AND m.depth = s.depth
LEFT JOIN n o ON m.depth > 0 AND o.node = array_to_string(m.way[1:m.depth - 1], '') AND o.depth = m.depth - 1
"""
