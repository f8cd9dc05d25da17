import random
import zlib
from collections import defaultdict

import pytest

from llm_data import documents, odd_rows, sentence
from terrastat.llm import shards


def check(df, got, count):
    rows = got.collect()
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    texts = [(r.doc_id, (r.text or "").encode()) for r in df.collect()]
    assert sorted([(r.doc_id, r.size, r.text_crc32) for r in rows], key=str) == sorted(
        [(i, len(t) + 8, zlib.crc32(t)) for i, t in texts], key=str
    )
    slots, sizes, kept = defaultdict(list), defaultdict(int), defaultdict(set)
    for r in rows:
        assert (r.law, r.grown_shard) == ("bytes", None) and 0 <= r.shard < count
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
        kept[r.size, r.text_crc32].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sizes, kept


@pytest.mark.parametrize("bins, finish_rows", [(4096, 4096), (16, 20), (3, 1)])
def test_sizes_are_near_equal(spark, bins, finish_rows):
    rng = random.Random(9)
    rows = [(i, sentence(rng, rng.randint(1, 200)), rng.choice(["en", "en", "en", "fr", None])) for i in range(3000)]
    rows += [(3000 + i, "a copied text " * 10, "de") for i in range(100)]
    df = documents(spark, rows).cache()
    sizes, kept = check(df, shards.kd_shards(df, shards=7, bins=bins, finish_rows=finish_rows), 7)
    mean = sum(sizes.values()) / 7
    assert len(sizes) == 7
    assert 0.93 * mean < min(sizes.values()) and max(sizes.values()) < 1.07 * mean
    if finish_rows > 1000:
        assert all(len(s) == 1 for s in kept.values())


def test_all_rows_alike(spark):
    df = spark.range(1000).selectExpr("7 AS doc_id", "'same' AS text", "'en' AS lang", "'s' AS source", "4L AS n_chars", "id AS row")
    sizes, _ = check(df, shards.kd_shards(df, shards=8, finish_rows=10), 8)
    assert {s / 12 for s in sizes.values()} <= {124.0, 125.0, 126.0}


def test_odd_rows_and_few_rows(spark):
    df = documents(spark, odd_rows())
    check(df, shards.kd_shards(df), 24)
    few = documents(spark, odd_rows()[:3])
    check(few, shards.kd_shards(few), 24)
    check(df, shards.kd_shards(df, shards=1), 1)
    assert shards.kd_shards(df.limit(0)).count() == 0


def test_dimensions(spark):
    df = documents(spark, odd_rows())
    check(df, shards.kd_shards(df, ["source"], shards=5), 5)
    with pytest.raises(TypeError):
        shards.kd_shards(df.selectExpr("*", "array(1) AS list"), ["list"])
    with pytest.raises(ValueError):
        shards.kd_shards(df, [])
