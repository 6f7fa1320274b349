"""Queries that take every row, against plain versions."""

from pathlib import Path

import duckdb
import pytest

from framesift.plans import advanced, registry

SF = Path("/root/testdata/sf0.001")
QUERIES = registry.queries()


def read(sql):
    return duckdb.sql(sql.replace("events", f"'{SF}/events.parquet'")).fetchall()


@pytest.fixture(scope="module")
def hashes():
    return {i: h & (1 << 64) - 1 for i, h in read(f"select event_id, {advanced.DUCK_HASH} from events")}


def links(hashes, radius):
    first = {}
    for i in sorted(hashes):
        first.setdefault(hashes[i], i)
    one = list(first.items())
    out = {(min(i, j), max(i, j), d) for k, (h, i) in enumerate(one) for g, j in one[:k] if (d := (h ^ g).bit_count()) <= radius}
    return out | {(first[h], i, 0) for i, h in hashes.items() if first[h] != i}


def test_hamming_pairs_whole(spark, hashes):
    got = [tuple(r) for r in QUERIES["hamming_pairs"](spark, str(SF)).select("a", "b", "distance").collect()]
    assert len(got) == len(set(got)) and set(got) == links(hashes, 6)


def test_hamming_components_whole(spark, hashes):
    root = {}
    near = {}
    for a, b, _ in links(hashes, 4):
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    for i in sorted(near):
        todo = [i]
        while todo:
            if (x := todo.pop()) not in root:
                root[x] = i
                todo += near[x]
    assert {tuple(r) for r in QUERIES["hamming_components"](spark, str(SF)).select("node", "root").collect()} == set(root.items())


@pytest.mark.parametrize("name", ["frame_measures", "edited_frames"])
def test_frames_of_all_events(spark, name):
    got = sorted(r["id"] for r in QUERIES[name](spark, str(SF)).collect())
    assert got == sorted(i for (i,) in read("select event_id from events"))


def test_client_feedback_whole(spark):
    from framesift.sources.bindings import photos

    p = {r["id"]: r["file_name"] for r in photos(spark, str(SF), "id", "file_name").collect()}
    named = {}
    for i, n in p.items():
        named.setdefault(n, []).append(i)
    want = {}
    for i in sorted(p):
        at = i * 3 if i % 2 == 0 else None
        for hit in [at] if at in p else named.get(f"IMG_{(i * 5) % 99991:07d}.jpg", []):
            want.setdefault(hit, "yes" if i % 3 == 0 else "no")
    assert max(p) > 400
    assert {tuple(r) for r in QUERIES["client_feedback"](spark, str(SF)).select("id", "verdict").collect()} == set(want.items())
