import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from llm_data import documents, odd_rows
from terrastat.llm.exact_dedup import PatriciaTrie, exact_dedup, first_copies


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def expected(rows):
    found = defaultdict(list)
    for i, t, *_ in rows:
        found[normal(t)].append(i)
    out = Counter()
    for t, ids in found.items():
        keep = min((i for i in ids if i is not None), default=None)
        digest = hashlib.sha256(t.encode()).hexdigest()
        kept = False
        for i in ids:
            out[(i, keep, len(ids), i == keep and not kept, digest)] += 1
            kept |= i == keep
    return out


@pytest.mark.parametrize("budget", [1, 50, 1 << 20])
def test_odd_rows(spark, budget):
    rows = odd_rows()
    got = exact_dedup(documents(spark, rows), budget=budget)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == expected(rows)


def test_a_text_that_a_third_repeats(spark):
    rng = random.Random(2)
    rows = [(i, "hot text" if i % 3 == 0 else f"prefix {rng.randrange(400)}", None) for i in range(3000)]
    got = exact_dedup(documents(spark, rows).repartition(7), budget=500)
    assert Counter(tuple(r) for r in got.collect()) == expected(rows)


def test_empty_table(spark):
    got = exact_dedup(documents(spark, odd_rows()).limit(0))
    assert got.count() == 0 and len(got.columns) == 5


def test_first_copies_keep_whole_rows(spark):
    rows = odd_rows()
    df = documents(spark, rows)
    got = first_copies(df)
    assert got.schema.names == df.columns
    kept = Counter((r.doc_id, normal(r.text)) for r in got.collect())
    assert kept == Counter({(k[1], t): 1 for t in {normal(r[1]) for r in rows} for k in expected([r for r in rows if normal(r[1]) == t])})


def test_trie_spills_whole_subtrees():
    rng = random.Random(5)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))) for _ in range(300)]
    trie, spilled = PatriciaTrie(), []
    for n, text in enumerate(texts):
        trie.insert(text, n, 1, n)
        if trie.size > 60:
            spilled += [(t, list(node.members)) for t, node in trie.spill_heaviest(30)]
            assert trie.size <= 60
    spilled += [(t, list(node.members)) for t, node in trie.drain()]
    assert trie.size == 0
    assert sorted(n for _, members in spilled for n in members) == list(range(len(texts)))
    assert all(texts[n] == t for t, members in spilled for n in members)
    # In byte order what lies left of the newest string is complete.
    done = Counter()
    for n, text in enumerate(sorted(texts)):
        trie.insert(text, n, 1, n)
        done.update(t for t, _ in trie.spill_complete(text))
    done.update(t for t, _ in trie.drain())
    assert done == Counter(set(texts))


def test_very_many_copies_of_short_texts_in_a_small_budget(spark):
    """Copies are given out as they come: neither a hot text nor short ones outgrow the budget."""
    rows = spark.range(300_000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN '' ELSE CAST(id % 50000 AS STRING) END AS text")
    got = exact_dedup(rows.repartition(3), budget=1 << 20)
    assert got.count() == 300_000
    sizes = {r.text_sha256: (r.n, r.size, r.kept) for r in got.groupBy("text_sha256").agg(F.count("*").alias("n"), F.max("group_size").alias("size"), F.count_if("kept").alias("kept")).collect()}
    assert all(n == size and kept == 1 for n, size, kept in sizes.values())
    assert sizes[hashlib.sha256(b"").hexdigest()][0] == 100_000 and sum(n for n, _, _ in sizes.values()) == 300_000


def test_the_budget_counts_nodes_and_members():
    trie = PatriciaTrie()
    for i in range(2000):
        trie.insert(b"%d" % i, i, 1, i)
    for i in range(1000):
        trie.insert(b"", i, 1, i)
    assert trie.size >= 2000 * 300 + 3000 * 150
    left = {text: node.count for text, node in trie.spill_heaviest(100_000)}
    assert trie.size <= 150 * 1000 + 100_000
    left |= {text: node.count for text, node in trie.drain()}
    assert len(left) == 2001 and left[b""] == 1000 and trie.size == 0
