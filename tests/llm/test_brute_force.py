"""Operators and pipeline stages against brute force, on whole small tables and on groups built to be hard."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from framesift.llm import compact_windows, decontamination, language_id, ngram_join, sharding, suffix_dedup, toxicity
from framesift.llm.common import table

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
#: Names that operators use inside, as columns of a user.
CLASHING = ["_id", "_h", "_rid", "_rh", "_key", "_source", "_whole", "_cut", "_row", "_toxicity", "toxicity", "row", "id", "h", "hash", "body", "size", "target", "repeats", "whole", "shard", "x y"]


def words_of(text):
    return [w for w in (text or "").encode().lower().replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").replace(b"\r", b" ").split(b" ") if w]


def shingles(w):
    return [tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def components(sets):
    """The smallest id that each id reaches by links of 100 * intersection >= 75 * union."""
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = {}
    for i, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(i)
    for i, s in sets.items():
        for j in {j for g in s for j in holders[g] if j < i}:
            n = len(s & sets[j])
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: top(i) for i in sets}


def contaminated(docs, bench):
    """doc_id, item_id of every window as long as an item whose weighted shingles are similar to the item's."""
    out = set()
    items = {i: (len(w), Counter(shingles(w))) for i, w in ((i, words_of(t)) for i, t in bench) if w}
    for d, t in docs:
        w = words_of(t)
        own = set(shingles(w))
        for i, (n, c) in items.items():
            if own & c.keys():
                for start in range(max(1, len(w) - n + 1)):
                    v = Counter(shingles(w[start : start + n]))
                    both = sum((v & c).values())
                    if 4 * both >= 3 * sum((v | c).values()):
                        out.add((d, i))
                        break
    return out


def test_suffix_dedup_on_a_whole_table(spark):
    """400-byte strings of all documents of sf0.01, counted."""
    docs = [(r["doc_id"], (r["text"] or "").encode()) for r in table(spark, LARGER, "documents").select("doc_id", "text").collect()]
    seen = Counter(hash(t[i : i + 400]) for _, t in docs for i in range(len(t) - 399))
    want = set()
    for d, t in docs:
        hit = np.zeros(len(t), bool)
        for i in range(len(t) - 399):
            if seen[hash(t[i : i + 400])] > 1:
                hit[i : i + 400] = True
        spans = int((np.diff(np.concatenate([[0], hit.astype(int), [0]])) == 1).sum())
        want.add((d, len(t), int(hit.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~hit].tobytes()).hexdigest()))
    assert {tuple(r) for r in suffix_dedup.op4_suffix_dedup(spark, LARGER).collect()} == want


@pytest.mark.parametrize("keep", ["first", "none"])
def test_suffix_dedup_of_a_hot_passage(spark, keep, monkeypatch):
    """A passage in 300 different surroundings: parts, smaller parts and windows."""
    monkeypatch.setattr(suffix_dedup, "HOT_RUNS", 8)
    rng = random.Random(4)
    passage = bytes(rng.choices(b"abcdefgh ", k=333))
    texts = [bytes(rng.choices(b"xyz", k=rng.randrange(300))) + passage + bytes(rng.choices(b"xyz", k=rng.randrange(300))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffix_dedup.dedup(docs, length=100, keep=keep, text=False).collect()}
    first, n = {}, Counter()
    for d, t in sorted(enumerate(texts)):
        for i in range(len(t) - 99):
            first.setdefault(t[i : i + 100], (d, i))
            n[t[i : i + 100]] += 1
    kept = 0
    for d, t in enumerate(texts):
        hit = np.zeros(len(t), bool)
        for i in range(len(t) - 99):
            if n[t[i : i + 100]] > 1:
                hit[i : i + 100] = True
        if keep == "none":
            assert got[d] == (hit.sum(), (np.diff(np.concatenate([[0], hit.astype(int), [0]])) == 1).sum())
        else:
            assert got[d][0] <= hit.sum()
            kept += int(hit.sum()) - got[d][0]
    # one copy of the passage stays, and little beside it
    assert keep == "none" or 333 <= kept <= 3 * 333


@pytest.mark.parametrize("part", [1024, 3])
def test_join_of_many_variants(spark, part, monkeypatch):
    """Variants of three texts on both sides of the threshold, under one hub, and one line that all texts have."""
    monkeypatch.setattr(ngram_join, "STAR_PART", part)
    rng = random.Random(6)
    line = [f"l{rng.random()}" for _ in range(9)]
    rows = []
    for _ in range(3):
        base = [f"w{rng.random()}" for _ in range(rng.randrange(90, 260))]
        for _ in range(45):
            w = list(base)
            for _ in range(rng.randrange(1, max(2, len(w) // 22))):
                w[rng.randrange(len(w))] = f"z{rng.random()}"
            rows.append((len(rows), " ".join(w + line)))
    want = components({i: set(shingles(words_of(t))) for i, t in rows})
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and 3 < len(set(want.values())) < len(rows)


def test_decontamination_on_whole_tables(spark):
    docs, bench = table(spark, SMALL, "documents"), table(spark, SMALL, "benchmark")
    rng = random.Random(8)
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    for k in range(60):  # items with some words changed, left out or put in, within other words
        w = rng.choice(items)[1].split()
        for _ in range(rng.randrange(len(w) // 12 + 1)):
            at = rng.randrange(len(w))
            w[at : at + rng.randrange(2)] = [f"new{rng.random()}"] * rng.randrange(2)
        rows.append((10_000_000 + k, " ".join([f"a{rng.random()}" for _ in range(rng.randrange(30))] + w + [f"b{rng.random()}" for _ in range(rng.randrange(30))])))
    want = contaminated(rows, items)
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.findings(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got <= want and len(got) >= 0.98 * len(want) and len({d for d, _ in want if d >= 10_000_000}) >= 20


@pytest.mark.parametrize(("groups", "each"), [(25, 8), (3, 100)])
def test_passages_among_near_copies(spark, groups, each):
    """Groups of passages that differ from each other, with a frequent line in each document: pairs of texts with similar passages."""
    rng = random.Random(9)
    line = [f"l{rng.random()}" for _ in range(12)]
    texts, passages = [], []
    for _ in range(groups):
        base = [f"w{rng.random()}" for _ in range(rng.randrange(70, 130))]
        for _ in range(each):
            w = list(base)
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = f"z{rng.random()}"
            before = [f"a{rng.random()}" for _ in range(rng.randrange(5, 80))]
            passages.append((len(before) + len(line), len(w)))
            texts.append(before + line + w + [f"b{rng.random()}" for _ in range(rng.randrange(5, 80))])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {}
    for r in compact_windows.passages(docs).collect():
        found.setdefault(r["doc_id"], np.zeros(len(texts[r["doc_id"]]), bool))[r["first_word"] : r["last_word"] + 1] = True
    sets = [set(shingles([w.encode() for w in texts[i][a : a + n]])) for i, (a, n) in enumerate(passages)]
    hit = want = 0
    for i, (a, n) in enumerate(passages):
        if any(j != i and 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j]) for j in range(i // each * each, i // each * each + each)):
            want += 1
            hit += i in found and found[i][a : a + n].mean() >= 0.9
    print('recall', each, hit, want)
    assert want >= 150 and hit >= 0.9 * want, (hit, want)


def test_letters(spark):
    model = language_id.LanguageModel((("en", (b" the words of it ",)), ("de", (b" der die das ",))))
    rows = [(0, "²"), (1, "½ 12"), (2, "Ⅷ"), (3, "ª"), (4, "漢"), (5, "é"), (6, "_ - 9"), (7, None)]
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert [got[i] == "und" for i in range(8)] == [True, True, True, False, False, False, True, True]


@pytest.fixture(scope="module")
def clashing(spark):
    """sf0.001 with repeated rows, nulls, an empty and a very long text, and columns that are called like an operator's own."""
    docs = table(spark, SMALL, "documents")
    more = docs.limit(3).unionAll(docs.limit(1).select(*[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes]))
    more = more.unionAll(docs.limit(1).withColumn("text", F.lit(""))).unionAll(docs.limit(1).withColumn("text", F.expr("repeat(concat(text, ' '), cast(ceil(1200000 / length(text)) as int))")))
    return docs.unionAll(more).select("*", *[F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in CLASHING]).cache()


def test_stages_on_clashing_names(spark, clashing):
    docs = clashing
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL).cache()
        assert [c for c in docs.columns if c not in sharding.NEW] == [c for c in out.columns if c not in sharding.NEW], name
        wrong = " or ".join(f"`{c}` <> concat('{c}-', coalesce(cast(doc_id as string), '-'))" for c in CLASHING if c not in sharding.NEW)
        assert out.filter(wrong).count() == 0 and 0 < out.count() <= 2 * docs.count(), name
        docs = out
    assert {"text", "shard", "slot"} <= set(docs.columns)


def test_stages_against_plain_versions(spark, clashing):
    docs = clashing
    key = lambda df: Counter((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in df.select("doc_id", "text").collect())
    # toxicity: each kept text scores below a half
    model = toxicity.learn(spark, docs, SMALL)
    kept = corpus_pipeline.drop_toxic(spark, docs, SMALL).cache()
    assert key(kept) == key(docs.filter(F.udf(lambda t: model.score((t or "").encode()) < 0.5, "boolean")("text")))
    # near duplicates: one row of each component, all rows without words
    out = corpus_pipeline.drop_near_duplicates(spark, kept, SMALL).cache()
    rows = [(r["doc_id"], r["text"]) for r in kept.select("doc_id", "text").collect()]
    sets = {i: set(shingles(words_of(t))) for i, (_, t) in enumerate(rows)}
    roots = components({i: s for i, s in sets.items() if s})
    assert out.count() == len(set(roots.values())) + sum(not s for s in sets.values()) and not key(out) - key(kept)
    of = {(d, t): roots[i] for i, (d, t) in enumerate(rows) if i in roots}
    left = [of[r["doc_id"], r["text"]] for r in out.select("doc_id", "text").collect() if (r["doc_id"], r["text"]) in of]
    assert len(left) == len(set(left))
    # benchmark: rows with an item go
    clean = corpus_pipeline.drop_contaminated(spark, out, SMALL).cache()
    rows = [(i, r["doc_id"], r["text"]) for i, r in enumerate(out.select("doc_id", "text").collect())]
    bad = {i for i, _ in contaminated([(i, t) for i, _, t in rows], [(r["item_id"], r["text"]) for r in table(spark, SMALL, "benchmark").collect()])}
    assert key(clean) == Counter((d, hashlib.sha256((t or "").encode()).hexdigest()) for i, d, t in rows if i not in bad) and bad
    # mixing: whole rows, two of each at most, near the targets
    mixed = corpus_pipeline.mix_sources(spark, clean, SMALL).cache()
    assert max(key(mixed).values()) <= 2 * max(key(clean).values()) and not set(key(mixed)) - set(key(clean))
    size = lambda df: Counter({r["source"]: r["n"] for r in df.groupBy("source").agg(F.sum(F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))).alias("n")).collect()})
    have, took = size(clean), size(mixed)
    open_, target, rest, names = dict.fromkeys(have), {}, 1.5 * sum(v or 0 for v in have.values()), sorted(have, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    while open_:
        level = rest / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] > 2 * (have[s] or 0)]
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            target[s] = 2 * (have[s] or 0)
            rest -= target[s]
            del open_[s]
    largest = max(len(words_of(r["text"])) for r in clean.select("text").collect())
    assert all(abs((took[s] or 0) - target[s]) <= largest for s in have)
    # sharding: gapless slots, counts at most one apart, rows whole
    placed = corpus_pipeline.assign_shards(spark, mixed, SMALL)
    assert key(placed) == key(mixed)
    slots = {}
    for r in placed.select("shard", "slot").collect():
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) == set(range(8))
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_place_of_a_row(spark):
    """Shard and slot computed for one row number are those of the whole table."""
    numbered = spark.range(1003).select(F.col("id").alias("row_number"))
    got = {r["row_number"]: (r["shard"], r["slot"]) for r in sharding.shuffle_into(numbered, 1003, 8, 7).collect()}
    assert all(sharding.place(i, 1003, 8, 7) == got[i] for i in range(0, 1003, 17))


@pytest.mark.parametrize(("hot", "chunk"), [(1000, 100_000), (5, 7)])
def test_many_equal_rows(spark, hot, chunk, monkeypatch):
    """A row that is there forty times, and one without id or text: whole rows, gapless slots, the same at any bound."""
    monkeypatch.setattr(sharding.numbers_in, "__defaults__", (chunk,))
    rows = [(1, "a b", "x")] * 40 + [(None, None, "y")] * 30 + [(i, f"t{i}", "z") for i in range(2, 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, own string")
    got = [tuple(r) for r in sharding.shard_rows(docs, hot=hot).select("doc_id", "text", "own", "shard", "slot").collect()]
    assert Counter(r[:3] for r in got) == Counter(rows) and len({r[3:] for r in got}) == len(rows)
    assert sorted(r[3] + 8 * r[4] for r in got) == list(range(len(rows)))
    assert sorted(map(str, got)) == sorted(map(str, [tuple(r) for r in sharding.shard_rows(docs).select("doc_id", "text", "own", "shard", "slot").collect()]))
