"""op11 to op13 against plain versions: hard rows, ties, repeated rows, empty tables, clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import pytest

from framesift.llm import hard_negatives as H
from framesift.llm.conversation_trie import prefix_trie
from framesift.llm.url_filter import RULES, SCALE, filter_urls


def plain_negatives(rows):
    fine = []
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        fine.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    out = []
    for n, (a, la, va) in enumerate(fine):
        if a % 50:
            continue
        met = sorted(((-sum(x * y for x, y in zip(va, v, strict=True)), i, label) for m, (i, label, v) in enumerate(fine) if m != n and len(v) == len(va)), key=lambda x: x[:2])
        for ps, p in [(-s, i) for s, i, label in met if label == la][:5]:
            fits = [(i, -s) for s, i, label in met if label != la and 50 * ps <= 100 * -s <= 95 * ps]
            out += [(a, p, r + 1, i, ps, s) for r, (i, s) in enumerate(fits[:3])]
    return sorted(out)


def got_negatives(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<double>, score string, aid int")
    out = H.hard_negatives(df)
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in out.collect())


def test_hard_negatives_plain(spark, monkeypatch):
    monkeypatch.setattr(H, "GROUP_ANCHORS", 4)
    monkeypatch.setattr(H, "TASK_ROWS", 64)
    monkeypatch.setattr(H, "PIVOTS", 6)
    monkeypatch.setattr(H, "BLOCK", 16)
    r = random.Random(5)
    rows = []
    for i in range(700):
        centre = i % 4
        v = [r.gauss(2.0 * (j == centre), 0.25) for j in range(5)]
        rows.append((i, r.choice([1, 1, 1, 2, 3]), v if i % 97 else v[:3]))
    rows += [(50 * k, 1, [2.0, 0.0, 0.0, 0.0, 0.0]) for k in (20, 21, 22)] + [(1001 + k, 2, [1.9, 0.0, 0.0, 0.0, 0.0]) for k in range(30)]  # ties
    rows += [rows[50]] * 2 + [rows[51]] * 2 + [(100, 2, [2.0, 1.0, 0.0, 0.0, 0.0])]  # repeated rows, and one id with two vectors
    rows += [(None, 1, [1.0] * 5), (3000, None, [1.0] * 5), (3050, 1, None), (3100, 1, [1.0, None, 0.0, 0.0, 0.0]), (3150, 1, [float("nan")] * 5), (3200, 1, [float("inf")] + [0.0] * 4), (3250, 1, []), (3251, 2, []), (3252, 1, [])]
    assert got_negatives(spark, rows) == plain_negatives(rows)


def test_hard_negatives_large_numbers(spark):
    r = random.Random(6)
    rows = [(i, i % 3, [r.uniform(-3e5, 3e5) for _ in range(4)]) for i in range(160)]
    assert got_negatives(spark, rows) == plain_negatives(rows)


def test_hard_negatives_few_rows(spark):
    assert got_negatives(spark, []) == []
    assert got_negatives(spark, [(50, 1, [1.0, 0.0])]) == []
    rows = [(50, 1, [1.0, 0.0]), (51, 1, [0.9, 0.0]), (52, 2, [0.7, 0.1])]
    assert got_negatives(spark, rows) == plain_negatives(rows) != []


def test_bounds_leave_rows_out(spark):
    """Far clusters are not sent to a group that they can't serve."""
    r = random.Random(7)
    rows = [(i, i % 2, [r.gauss(1.0 if j == i % 8 else 0.0, 0.01) for j in range(8)]) for i in range(800)]
    whole = H.whole_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"))
    pivots = H.Pivots(whole)
    placed = H.placed(whole, pivots)
    assert placed.select("cell").distinct().count() >= 8
    assert got_negatives(spark, rows) == plain_negatives(rows)


def plain_urls(rows, rounds=12, damping=0.85, block_at=0.25):
    lower = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    pages = []
    for page, url, html in rows:
        host = path = ""
        if url is not None and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.split(r"[/?#]", rest, maxsplit=1)[0]
            path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
            host = lower(host)
        fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits)[1:] if fits else (None, None)
        links = {lower(x) for x in re.findall(r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)""", html or "")}
        pages.append((page, host, path, rule[0], rule[1], links))
    n, kinds, w = defaultdict(int), {"allow": defaultdict(int), "block": defaultdict(int)}, defaultdict(int)
    for _, host, _, _, verdict, links in pages:
        if host:
            n[host] += 1
            if verdict:
                kinds[verdict][host] += 1
            for x in links - {host}:
                w[host, x] += 1
    for host in list(n):
        up = host.partition(".")[2]
        if up in n:
            w[host, up] += 1
            w[up, host] += 1

    def spread(edges, seeds):
        every, total = defaultdict(int), defaultdict(int)
        for (a, _), x in edges.items():
            every[a] += x
        moving = {h: math.floor(seeds[h] / n[h] * SCALE) for h in n}
        for r in range(rounds + 1):
            for h, m in moving.items():
                total[h] += m
            new = defaultdict(int)
            for (a, b), x in edges.items():
                new[b] += math.floor(float(moving.get(a, 0)) * (damping * (float(x) / float(every[a]))))
            moving = new
        return total

    trust, distrust = spread(w, kinds["allow"]), spread({(b, a): x for (a, b), x in w.items()}, kinds["block"])
    out = []
    for page, host, path, rule, verdict, _ in pages:
        bad = distrust[host] >= block_at * SCALE and distrust[host] > trust[host]
        out.append((page, host, path, rule, verdict or ("block" if bad else "allow"), trust[host], distrust[host]))
    return out


def got_urls(spark, rows):
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "page_id long, url string, html string, verdict string, host int")
    return [tuple(r) for r in filter_urls(df).collect()]


key = lambda r: tuple((x is not None, x) for x in r)


def test_urls_plain(spark):
    link = lambda *to: "".join(f'<a href="{x}">x</a>' for x in to)
    rows = [
        (1, "https://a.example.net/en/x?y#z", link("http://b.org/fr/", "//c.info/", "/own")),
        (2, "HTTP://A.Example.NET/de/x", link("https://c.info/q", "https://c.info/r", "http://A.example.net/")),
        (3, "http://c.info", link("https://bad.example.com/de/1")),
        (4, "http://c.info?x=1/2", None),
        (5, "http://bad.example.com/de/", ""),
        (6, "http://www.bad.example.com/en/", "<A HREF='http://good.org/fr/'>"),
        (7, "http://good.org/fr/1", link("http://c.info/")),
        (8, "http://good.org/en/1", link("http://d.info/")),
        (9, "http://net/x", None),
        (10, "http://notnet", "href=//e.info"),
        (11, "http://x.net", None),
        (12, None, link("http://d.info")),
        (13, "no scheme", None),
        (14, "://", None),
        (15, "http://ÀB.org/fr/a://b", None),
        (None, "http://d.info/#x", None),
        (16, "http://d.info/a\nb?c", link("http://bad.example.com/")),
    ]
    rows += [(20 + i, "http://hot.info/" + str(i), link("http://bad.example.com/", f"http://h{i % 3}.info/")) for i in range(60)]
    rows += [rows[0], rows[0]]
    assert sorted(got_urls(spark, rows), key=key) == sorted(plain_urls(rows), key=key)
    assert {r[4] for r in got_urls(spark, rows) if r[3] is None} == {"allow", "block"}
    assert got_urls(spark, []) == []


def plain_trie(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in turns.items()}
    convs = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(math.fmod(c, 100))
        convs[c] = tuple(own.get(base, [])[:h] + v[h:])
    nodes = defaultdict(list)
    for c, v in convs.items():
        for d in range(len(v) + 1):
            nodes[v[:d]].append(c)
    kids = defaultdict(list)
    for x in nodes:
        if x:
            kids[x[:-1]].append(x)
    leaves, saved = {}, {}
    for x in sorted(nodes, key=len, reverse=True):
        leaves[x] = sum(leaves[k] for k in kids[x]) or 1
        saved[x] = sum(saved[k] for k in kids[x]) + ((len(nodes[x]) - 1) * len(x[-1][1]) if x else 0)
    out = []
    for x, m in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(convs[c]) == len(x)))
        out.append((min(m), len(x), min(nodes[x[:-1]]) if x else None, len(m), len(kids[x]), leaves[x], saved[x], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def got_trie(spark, rows):
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "conv_id long, turn long, role string, text string, a string, depth int")
    return [tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in prefix_trie(df).collect()]


@pytest.mark.parametrize("shape", ["hard", "snapshots", "copies"])
def test_trie_plain(spark, shape):
    r = random.Random(8)
    if shape == "hard":
        rows = [(c, t, r.choice(["user", "assistant", None]), r.choice(["", "a", "b", "été 😀", None, "x" * 50_000])) for c in (*range(190, 320), -100, -57, -1, 0, 7, 10**12, 10**12 + 3) for t in range(r.randrange(1, 9))]
        rows += [(200, None, "system", "s"), (200, 3, "user", "tie"), (201, None, None, None), (None, 1, "user", "x"), (700, 1, "user", "same"), (700, 1, "user", "same"), (705, 0, "user", "x")]
        rows += [(800, 9, "user", f"{i % 7}") for i in range(900)] + [(804, i, "user", "long") for i in range(1500)]
    elif shape == "snapshots":
        rows = [(100 * c, t, "user", str(t)) for c in range(1, 40) for t in range(c)]
    else:
        rows = [(100 * c, t, "user", str(t)) for c in range(1, 200) for t in range(3)] + [(100 * c + 2048 * 500, t, "user", str(t)) for c in range(1, 60) for t in range(3)]
        rows += [(100 * 205, t, "user", str(t)) for t in range(2)] + [(100 * (300 + k), t, "user", str(t) if t < 2 else str(k)) for k in range(150) for t in range(4)]
    r.shuffle(rows)
    assert sorted(got_trie(spark, rows), key=key) == sorted(plain_trie(rows), key=key)


def test_trie_empty(spark):
    assert got_trie(spark, []) == []
    assert got_trie(spark, [(None, 1, "user", "x")]) == []
