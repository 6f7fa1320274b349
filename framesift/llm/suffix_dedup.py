"""Suffix-array deduplication of exact repeats of ``length`` bytes.

Suffixes are compared only where an equal partner can be. Every window of
``length`` bytes has an anchor: its leftmost k-gram of smallest hash. Equal
windows have equal anchors at equal offsets, and the windows of one anchor are
a run, so a text of n bytes is about 2 n / length runs. Runs are joined on the
anchor's hash. Anchors seen once need no more; where all runs of an anchor are
the same bytes, all of them repeat. For the others the bytes of each distinct
run are fetched, and blocks of them get a suffix array, built by prefix
doubling. The longest previous factor of a position is the longer match with
the previous or the next smaller position in suffix order: where it reaches
``length`` an earlier copy exists. The previous and next larger positions tell
of later copies alike. ``keep="first"`` removes what has an earlier copy,
``keep="none"`` everything that has any other copy.

An anchor with more distinct runs than ``HOT_RUNS`` goes another exact way,
without suffix arrays: its runs are cut into parts of windows at the same
offsets from the anchor. Windows can be equal only if the bytes are that all
windows of their parts share: parts are dealt out by these. A part alone
repeats nothing; parts with the same bytes throughout repeat whole; the others
are cut into smaller parts, and those that are still open into single windows,
which are counted. So no task gets the whole group, and about ten rows are made
for each place where a repeated passage begins or ends.

Runs, parts and windows are the same if their 64-bit hashes are (two different
ones in a billion agree with a chance of 1 in 40; the hash is a polynomial
modulo 2^64 over mixed bytes, for which a text can be built that fools it).
Within suffix arrays bytes are compared.

Defined results: null text is the empty text; texts shorter than ``length``
keep all; repeated rows are copies of each other; rows are told apart by
doc_id and text, so equal rows get equal results; a null doc_id is a value like
any other; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, cut, drop_cut, mix, short_batches, table
from .shingles import prefix_hash

GRAM = 32
#: Windows are hashed in tiles of so many; positions take 20 bits of a key.
TILE = 1 << 19
HOT_RUNS = 256
#: Windows of a part and of a smaller part, for lengths from four times that.
PART, SMALLER = 25, 5
#: Suffix arrays are built over so many bytes at a time, groups kept whole.
BLOCK = 1 << 19


def runs(text: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """start, count, anchor hash, offset of the anchor, digest of the run's bytes: for all windows of a text."""
    parts = []
    n_windows = len(text) - length + 1
    k = min(GRAM, length)
    for lo in range(0, max(0, n_windows), TILE):
        n = min(TILE, n_windows - lo)
        a = text[lo : lo + n + length - 1]
        p, down = prefix_hash(a)
        gram = mix((p[k:] - p[:-k]) * down[: len(p) - k])
        low = (gram & np.uint64(~0xFFFFF & (1 << 64) - 1)) | np.arange(len(gram), dtype=np.uint64)
        width, have = length - k + 1, 1
        while have < width:  # smallest key of every ``have`` k-grams, doubled
            step = min(have, width - have)
            low = np.minimum(low[: len(low) - step], low[step:])
            have += step
        at = (low & np.uint64(0xFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        count = np.diff(np.append(first, n))
        end = first + count + length - 1
        digest = mix((p[end] - p[first]) * down[first] + mix((at[first] - first).astype(np.uint64) + (count.astype(np.uint64) << np.uint64(32))))
        parts.append((first + lo, count, gram[at[first]], at[first] - first, digest))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else tuple(np.zeros(0, np.int64) for _ in range(5))


#: Never in UTF-8, so no match of valid text crosses it.
SEPARATOR = 255


#: Bytes of the first ranks.
START = 5


def sorted_with(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys below 2^42, and the keys in that order. Few enough are sorted with their places in the low bits."""
    n = len(key)
    if n >= 1 << 20 or int(key.max(initial=0)) >= 1 << 43:
        order = np.argsort(key)
        return order, key[order]
    both = np.sort((key << np.uint64(20)) | np.arange(n, dtype=np.uint64))
    return (both & np.uint64((1 << 20) - 1)).astype(np.int64), both >> np.uint64(20)


def suffix_array(a: np.ndarray, depth: int, keep_ranks: bool = False) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Order of the suffixes of a byte array by their first ``depth`` bytes, and each position's rank: the place in the order
    of the first suffix that agrees with it so far. Behind the end counts as separators.

    Prefix doubling from 5 bytes on; suffixes already told apart from all others are left alone."""
    n = len(a)
    wide = np.concatenate([a, np.full(START - 1, SEPARATOR, np.uint8)])
    key = wide[:n].astype(np.uint64)
    for k in range(1, START):
        key = (key << np.uint64(8)) | wide[k : k + n]
    if depth < START:
        key >>= np.uint64(8 * (START - depth))
    order, key = sorted_with(key)
    fresh = np.append(True, key[1:] != key[:-1])
    head = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[order], rank[n] = head, n
    ranks, have = [(min(START, depth), rank[:n].copy())] if keep_ranks else [], START
    while have < depth:
        step = min(have, depth - have)
        at = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
        if not len(at):
            break
        own = order[at]
        # within the range of each old rank, by the rank ``step`` further on
        by, key = sorted_with((head[at] * (n + 1) + rank[np.minimum(own + step, n)]).astype(np.uint64))
        order[at] = own[by]
        new = np.append(True, key[1:] != key[:-1])
        fresh[at] = new
        head[at] = np.maximum.accumulate(np.where(new, at, 0))
        rank[order[at]] = head[at]
        have += step
        if keep_ranks:
            ranks.append((have, rank[:n].copy()))
    return order, rank[:n], ranks


def smaller_before(x: np.ndarray, strict: bool = True) -> np.ndarray:
    """Index of the nearest value to the left that is smaller (unless ``strict``: or equal), or -1."""
    at = np.arange(len(x)) - 1
    open_ = np.arange(len(x))
    while len(open_):
        here, own = at[open_], x[open_]
        there = x[here]
        open_ = open_[(here >= 0) & ((there >= own) if strict else (there > own))]
        at[open_] = at[at[open_]]
    return at


def previous_factors(a: np.ndarray, depth: int) -> np.ndarray:
    """Longest previous factor of every position of a byte array, up to ``depth``: the longer common prefix with the
    previous or the next smaller position in suffix order. It may overlap the position; nothing crosses a separator."""
    order, _, ranks = suffix_array(a, depth, keep_ranks=True)
    n = len(a)
    end = np.append(np.flatnonzero(a == SEPARATOR), n)
    left = end[np.searchsorted(end, np.arange(n))] - np.arange(n)  # bytes up to the next separator
    out = np.zeros(n, np.int64)
    for side in (smaller_before(order), n - 1 - smaller_before(order[::-1])[::-1]):
        has = np.flatnonzero((side >= 0) & (side < n))
        i, j = order[has], order[side[has]]
        room, match = np.minimum(left[i], left[j]), np.zeros(len(has), np.int64)
        for size, rank in [*reversed(ranks), *[(1, a)] * 8]:
            for _ in range(2 if size == ranks[0][0] else 1):
                x, y = np.minimum(i + match, n - 1), np.minimum(j + match, n - 1)
                match += np.where((match + size <= room) & (rank[x] == rank[y]), size, 0)
        out[i] = np.maximum(out[i], np.minimum(match, depth))
    return out


def matched(order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which positions have a longest previous factor of the depth to which ``rank`` tells suffixes apart.

    The factor is that of the previous or the next smaller position in suffix
    order; it has that length if the ranks are the same."""
    n, hit = len(order), np.zeros(len(order), bool)
    for side in (smaller_before(order), n - 1 - smaller_before(order[::-1])[::-1]):
        has = np.flatnonzero((side >= 0) & (side < n))
        i, j = order[has], order[side[has]]
        hit[i] |= rank[i] == rank[j]
    return hit


def repeated_windows(pieces: list[bytes], counts: list[int], length: int, keep: str) -> list[np.ndarray]:
    """For each piece, which of its first ``counts`` windows occur in an earlier piece or place (keep "first") or elsewhere (keep "none")."""
    size = np.array([len(p) + 1 for p in pieces])
    a = np.frombuffer(b"\xff".join([*pieces, b""]), np.uint8)
    begin = np.cumsum(size) - size
    order, rank, _ = suffix_array(a, length)
    # places of suffixes that are like no other can't match
    open_ = np.flatnonzero(np.append(False, np.diff(rank[order]) == 0) | np.append(np.diff(rank[order]) == 0, False))
    at, dense = np.unique(order[open_], return_inverse=True)
    hit = np.zeros(len(a), bool)
    hit[at] = matched(dense, rank[at])
    if keep == "none":
        # larger positions are smaller ones counted from the end
        hit[at] |= matched(len(at) - 1 - dense, rank[at][::-1])[::-1]
    return [hit[b : b + c] for b, c in zip(begin, counts, strict=True)]


def parts_of(piece: bytes, off: int, count: int, length: int) -> tuple:
    """First window, windows, hash of the shared bytes and hash of all bytes of each part of a run; the smaller parts of each; hash of each window."""
    p, down = prefix_hash(np.frombuffer(piece, np.uint8))
    over = lambda lo, hi: (p[hi] - p[lo]) * down[lo]

    def parts(size: int) -> tuple[np.ndarray, ...]:
        q = np.arange((off - count + 1) // size, off // size + 1)
        low, high = np.maximum(off - count + 1, q * size), np.minimum(off, q * size + size - 1)
        shared = mix(mix(over(off - q * size, off - (q * size + size - 1) + length) + np.uint64(size)) + q.astype(np.uint64))
        return q, low, high, shared

    size = max(1, min(PART, length // 4))
    smaller = max(1, size * SMALLER // PART)
    ratio = size // smaller
    q, low, high, shared = parts(smaller * ratio)
    first, n = off - high, high - low + 1
    whole = mix(mix(over(first, first + n - 1 + length)) + (low.astype(np.uint64) << np.uint64(32)) + high.astype(np.uint64))
    q2, low2, high2, shared2 = parts(smaller)
    of = q2 // ratio - q[0]
    first2 = off - high2 - first[of]
    return first, n, shared, whole, (of, first2, high2 - low2 + 1, shared2), mix((p[length:] - p[:-length]) * down[:count])


def _intervals(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], hit, [0]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


KEY = "doc_id long, h long"
RUN = f"{KEY}, anchor long, digest long, off int, cnt int, starts array<int>"
SPAN = f"{KEY}, lo int, hi int"


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("h"), text.cast("binary").alias("body"))


def find_runs(keyed: DataFrame, length: int) -> DataFrame:
    """The runs of every document; equal ones of a document in one row."""
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("anchor", pa.int64()), ("digest", pa.int64()), ("off", pa.int32()), ("cnt", pa.int32()), ("starts", pa.list_(pa.int32()))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ids, hs, rows, total = b.column(0).to_pylist(), b.column(1).to_pylist(), [], 0
            for i, body in enumerate(b.column(2)):
                raw = body.as_buffer()
                if raw is None or raw.size < length:
                    continue
                start, count, anchor, off, digest = runs(np.frombuffer(raw, np.uint8), length)
                order = np.lexsort((start, digest))
                first = np.flatnonzero(np.append(True, digest[order][1:] != digest[order][:-1]))
                pick = order[first]
                rows.append((i, anchor[pick], digest[pick], off[pick], count[pick], start[order], np.append(first, len(order))))
                total += len(pick)
            if not rows:
                continue
            n = [len(r[1]) for r in rows]
            base = np.concatenate([[0], np.cumsum([len(r[5]) for r in rows])[:-1]])
            ends = np.concatenate([r[6][:-1] + o for r, o in zip(rows, base, strict=True)] + [[sum(len(r[5]) for r in rows)]])
            starts = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([r[5] for r in rows]).astype(np.int32)))
            own = np.repeat([r[0] for r in rows], n)
            whole = lambda k, kind: pa.array(np.concatenate([r[k] for r in rows]).view(np.int64) if kind == pa.int64() else np.concatenate([r[k] for r in rows]).astype(np.int32), kind)  # noqa: E731, B023
            cols = {"doc_id": pa.array([ids[i] for i in own], pa.int64()), "h": pa.array([hs[i] for i in own], pa.int64()), "anchor": whole(1, pa.int64()), "digest": whole(2, pa.int64()), "off": whole(3, pa.int32()), "cnt": whole(4, pa.int32()), "starts": starts}
            yield from batches(cols, schema)

    return keyed.mapInArrow(run, RUN)


def fetch(keyed: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Bytes of the wanted runs (KEY, anchor, at, cnt, off, hot). A hot run comes as its parts instead: shared, whole, windows."""
    per_doc = wanted.groupBy("doc_id", "h").agg(F.collect_list(F.struct("anchor", "at", "cnt", "off", "hot")).alias("runs"))
    rows = keyed.alias("k").join(per_doc.alias("w"), F.expr("k.doc_id <=> w.doc_id and k.h = w.h")).select("k.doc_id", "k.h", "body", "runs")
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("anchor", pa.int64()), ("at", pa.int32()), ("cnt", pa.int32()), ("piece", pa.binary()), ("shared", pa.int64()), ("whole", pa.int64()), ("windows", pa.list_(pa.int64())), ("smaller", pa.list_(pa.struct([("f", pa.int32()), ("n", pa.int32()), ("shared", pa.int64())])))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            got: list[tuple] = []
            held = 0
            for d, h, body, wanted_of in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                raw = body.as_buffer()
                for r in wanted_of.as_py():
                    piece = raw.slice(r["at"], r["cnt"] + length - 1)
                    if r["hot"]:
                        first, n, shared, whole, smaller, win = parts_of(piece, r["off"], r["cnt"], length)
                        own: list[list[dict]] = [[] for _ in first]
                        for o, f, k, x in zip(*(z.tolist() for z in (*smaller[:3], smaller[3].view(np.int64))), strict=True):
                            own[o].append({"f": f, "n": k, "shared": x})
                        for o, f, k, x, y in zip(own, first.tolist(), n.tolist(), shared.view(np.int64).tolist(), whole.view(np.int64).tolist(), strict=True):
                            got.append((d, h, r["anchor"], r["at"] + f, k, None, x, y, win[f : f + k].view(np.int64), o))
                        held += 100 * r["cnt"]
                    else:
                        got.append((d, h, r["anchor"], r["at"], r["cnt"], piece.to_pybytes(), None, None, None, None))
                        held += len(piece)
                    if held > 8 << 20:
                        yield told(got)
                        got, held = [], 0
            if got:
                yield told(got)

    def told(got: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*got, strict=True), schema, strict=True)], schema=schema)

    return rows.mapInArrow(run, f"{KEY}, anchor long, at int, cnt int, piece binary, shared long, whole long, windows array<long>, smaller array<struct<f:int,n:int,shared:long>>")


def match(pieces: DataFrame, length: int, keep: str) -> DataFrame:
    """Spans of windows that repeat, by suffix arrays over whole groups of one anchor."""
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        out = []
        found = repeated_windows([r[4] for r in rows], [r[3] for r in rows], length, keep)
        for (d, h, at, _, _, check), hit in zip(rows, found, strict=True):
            if check:
                out += [(d, h, at + int(x), at + int(y) - 1 + length) for x, y in zip(*_intervals(hit), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], f.type) for i, f in enumerate(schema)], schema=schema)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, last = 0, None
        for b in it:
            for anchor, *row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if size >= BLOCK and anchor != last:
                    yield solve(rows)
                    rows, size = [], 0
                rows.append(tuple(row))
                size += len(row[4]) + 1
                last = anchor
        if rows:
            yield solve(rows)

    dealt = pieces.select("anchor", "doc_id", "h", "at", "cnt", "piece", "check").repartition("anchor").sortWithinPartitions("anchor", "doc_id", "h", "at")
    return dealt.mapInArrow(run, SPAN)


def settled(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of parts (shared, whole, ...) whose shared bytes another part has: those of groups with the same bytes throughout, with the first place ``rep``, and those that are open."""
    met = parts.groupBy("shared").agg(F.count(F.lit(1)).alias("n"), (F.min("whole") == F.max("whole")).alias("alike"), F.min(F.struct("doc_id", "h", "at")).alias("rep")).filter("n > 1").drop("n")
    met = cut(parts.join(met, "shared"), "parts")
    return met.filter("alike"), met.filter("not alike").drop("alike", "rep")


def spans_of(rows: DataFrame, length: int, keep: str) -> DataFrame:
    """The spans of rows (doc_id, h, at, cnt) of a repeated kind; with keep "first", without its first place ``rep``."""
    if keep == "first":
        rows = rows.filter(~F.struct("doc_id", "h", "at").eqNullSafe(F.col("rep")))
    return rows.select("doc_id", "h", F.col("at").alias("lo"), (F.col("at") + F.col("cnt") + (length - 1)).cast("int").alias("hi"))


def repeated_spans(keyed: DataFrame, *, length: int = 400, keep: str = "none") -> DataFrame:
    """doc_id, h, lo, hi: byte spans to remove; they may touch or overlap."""
    if keep not in ("none", "first"):
        raise ValueError("keep is 'none' or 'first'")
    found = cut(find_runs(keyed, length), "runs")
    size = F.size("starts")
    anchors = found.groupBy("anchor").agg(F.sum(size).alias("n"), F.min("digest").alias("lo"), F.max("digest").alias("hi")).filter("n > 1")
    again = cut(found.join(anchors.select("anchor", (F.col("lo") == F.col("hi")).alias("alike")), "anchor"), "again")
    drop_cut(found)
    # distinct runs of an anchor: how often, and where first
    kinds = again.groupBy("anchor", "digest").agg(F.sum(size).alias("n"), F.first("alike").alias("alike"), F.first("off").alias("off"), F.min(F.struct("doc_id", "h", F.array_min("starts").alias("at"), "cnt")).alias("r"))
    kinds = cut(kinds.select("anchor", "digest", "n", "alike", "off", "r.*"), "kinds")
    many = kinds.filter("n > 1").select("anchor", "digest", F.struct("doc_id", "h", "at").alias("rep"))
    copies = again.join(many, ["anchor", "digest"]).withColumn("at", F.explode("starts"))
    spans = spans_of(copies, length, keep)
    # distinct runs that share an anchor with others: only those may match in part
    varied = kinds.filter("not alike")
    hot = varied.groupBy("anchor").agg((F.count(F.lit(1)) > HOT_RUNS).alias("hot"))
    wanted = cut(varied.join(hot, "anchor").select("doc_id", "h", "anchor", "at", "cnt", "off", "hot", (F.lit(keep == "first") | (F.col("n") == 1)).alias("check")), "wanted")
    pieces = cut(fetch(keyed, wanted, length), "pieces")
    checked = pieces.filter("piece is not null").alias("p").join(wanted.filter("not hot").alias("w"), F.expr("p.doc_id <=> w.doc_id and p.h = w.h and p.at = w.at")).select("p.*", "w.check")
    spans = spans.unionAll(match(checked, length, keep))
    # hot anchors: parts, smaller parts of those that are open, and windows of what is open still
    whole, left = settled(pieces.filter("piece is null").select("doc_id", "h", "at", "cnt", "shared", "whole", "windows", "smaller"))
    spans = spans.unionAll(spans_of(whole, length, keep))
    less = left.select("doc_id", "h", "at", "windows", F.explode("smaller").alias("p"))
    less = less.select("doc_id", "h", (F.col("at") + F.col("p.f")).alias("at"), F.col("p.n").alias("cnt"), F.col("p.shared").alias("shared"), F.expr("slice(windows, p.f + 1, p.n)").alias("windows"))
    whole, left = settled(less.withColumn("whole", F.xxhash64("windows")))
    spans = spans.unionAll(spans_of(whole, length, keep))
    windows = left.select("doc_id", "h", "at", F.posexplode("windows").alias("o", "win")).select("doc_id", "h", (F.col("at") + F.col("o")).alias("at"), F.lit(1).alias("cnt"), "win")
    seen = windows.groupBy("win").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "h", "at")).alias("rep")).filter("n > 1").select("win", "rep")
    return spans.unionAll(spans_of(windows.join(seen, "win"), length, keep))


def dedup(docs: DataFrame, *, length: int = 400, keep: str = "none", text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, and (with ``text``) the bytes that stay."""
    short_batches(docs.sparkSession)
    keyed = _keyed(docs)
    spans = cut(repeated_spans(keyed, length=length, keep=keep), "spans")
    per_doc = spans.groupBy("doc_id", "h").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    rows = keyed.alias("k").join(per_doc.alias("s"), F.expr("k.doc_id <=> s.doc_id and k.h = s.h"), "left").select("k.doc_id", "body", "spans")
    kept = [("kept", pa.binary())] if text else []
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))), *kept])

    def one(body: bytes, own: list | None) -> tuple:
        merged: list[list[int]] = []
        for lo, hi in sorted((s["lo"], s["hi"]) for s in own or ()):
            if merged and lo <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], hi)
            else:
                merged.append([lo, hi])
        rest, at = [], 0
        for lo, hi in merged:
            rest.append(body[at:lo])
            at = hi
        left = b"".join([*rest, body[at:]])
        return len(body), len(body) - len(left), len(merged), hashlib.sha256(left).hexdigest(), [{"lo": x, "hi": y} for x, y in merged], *([left] if text else [])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            got = [one(x or b"", s) for x, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *[pa.array([g[i] for g in got], f.type) for i, f in enumerate(list(schema)[1:])]], schema=schema)

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<lo:int,hi:int>>" + (", kept binary" if text else ""))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every byte covered by a 400-byte string that also starts elsewhere, removed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs, length=400, keep="none", text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
