import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from llm_data import ODD_TEXTS, documents, groups, odd_rows, sentence, words
from terrastat.llm import simhash
from terrastat.llm.components import components


def fingerprint(text, n=4):
    w = words(text)
    shingles = [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def linked(marks, bits=4):
    return [(a, b) for a, b in combinations(sorted(set(marks)), 2) if (a ^ b).bit_count() <= bits]


def test_fingerprints():
    rng = random.Random(1)
    texts = ODD_TEXTS + [sentence(rng, rng.randint(0, 30), 20) for _ in range(200)]
    assert simhash.fingerprints_of(pa.array(texts)).tolist() == [fingerprint(t) for t in texts]


def test_spark_hashes_shingles_alike(spark):
    got = spark.sql("SELECT xxhash64('a b c d')").first()[0]
    assert got % (1 << 64) == xxhash.xxh64_intdigest(b"a b c d", 42)


def test_close_fingerprints_agree_in_a_mask():
    rng = random.Random(2)
    masks = simhash.block_masks()
    assert len(masks) == 35
    for _ in range(500):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 4):
            b ^= 1 << bit
        assert any(a & m == b & m for m in masks)


def test_connect_reaches_all():
    rng = random.Random(3)
    for _ in range(20):
        marks = sorted({rng.getrandbits(8) for _ in range(60)})
        links = simhash.connect(np.array(marks, np.uint64), 1)
        assert len(links) < len(marks)
        assert groups([(marks[i], marks[j]) for i, j in links], marks) == groups(linked(marks, 1), marks)


@pytest.mark.parametrize("key_rows", [2, 1 << 14])
def test_links_of_crowded_keys(spark, key_rows):
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    marks = {centre}
    for _ in range(150):
        mark = centre
        for bit in rng.sample(range(64), rng.randint(1, 8)):
            mark ^= 1 << bit
        marks.add(mark)
    marks |= {rng.getrandbits(64) for _ in range(50)}
    marks = [m - (1 << 64) if m >> 63 else m for m in marks]
    df = spark.createDataFrame([(m,) for m in marks], "fingerprint bigint")
    got = [tuple(r) for r in simhash.close_links(df, key_rows=key_rows).collect()]
    plain = [m % (1 << 64) for m in marks]
    assert all(((a ^ b) % (1 << 64)).bit_count() <= 4 for a, b in got)
    assert groups([(a % (1 << 64), b % (1 << 64)) for a, b in got], plain) == groups(linked(plain), plain)


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(1000, i) for i in range(1001, 1100)]
    df = spark.createDataFrame(links + links[:10], "a bigint, b bigint")
    nodes = {n for a, b in links if a != b for n in (a, b)}
    got = {r.node: r.root for r in components(df).collect()}
    assert got == groups(links, nodes)
    assert components(df.limit(0)).count() == 0


def expected(rows):
    marks = [fingerprint(t) for _, t, *_ in rows]
    root = groups(linked(marks), set(marks))
    least = {}
    for (i, *_), m in zip(rows, marks):
        if i is not None:
            least[root[m]] = min(least.get(root[m], i), i)
    return sorted(((i, f"{m:016x}", least.get(root[m])) for (i, *_), m in zip(rows, marks)), key=str)


def near_rows():
    rng = random.Random(6)
    rows = odd_rows()
    for base in range(200, 260, 10):
        text = sentence(rng, 400).split()
        for k in range(8):
            copy = list(text)
            for _ in range(k):
                copy[rng.randrange(len(copy))] = "changed"
            rows.append((base + k, " ".join(copy), "en"))
    return rows


def test_groups(spark):
    rows = near_rows()
    got = simhash.simhash_groups(documents(spark, rows))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(rows)
    assert simhash.simhash_groups(documents(spark, rows).limit(0)).count() == 0


def test_one_row_of_each_group_stays(spark):
    rows = near_rows()
    df = documents(spark, rows)
    got = simhash.first_of_groups(df)
    assert got.columns == df.columns
    all_groups = {(m, c) for _, m, c in expected(rows)}
    kept = got.collect()
    marks = {f"{fingerprint(r.text):016x}" for r in kept}
    assert len(kept) == len(marks)
    root = groups(linked([int(m, 16) for m, _ in all_groups]), {int(m, 16) for m, _ in all_groups})
    assert len(kept) == len(set(root.values()))
    assert {root[int(m, 16)] for m in marks} == set(root.values())
