import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_data import documents, odd_rows, sentence, words
from terrastat.llm import catalog, language_model as lm, packed


def brute(rows, learned):
    counts = Counter()
    for r in rows:
        if learned(r):
            counts.update(words(r[1]) + [None])
    n, v = sum(counts.values()), len(counts)
    out = []
    for r in rows:
        tokens = words(r[1]) + [None]
        base = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)
        out.append((r[0], len(tokens), sum(counts[t] > 0 for t in tokens), n, base))
    return sorted(out, key=str)


@pytest.mark.parametrize("head_words", [0, 5, 1 << 20])
def test_exact_part(spark, head_words):
    rng = random.Random(1)
    rows = odd_rows() + [(1000 + i, sentence(rng, 40, 60), "en") for i in range(50)]
    got = lm.score_texts(documents(spark, rows), F.col("doc_id") % 3 != 0, head_words=head_words).collect()
    want = brute(rows, lambda r: r[0] is not None and r[0] % 3 != 0)
    mine = sorted([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got], key=str)
    assert sorted(m[:4] for m in mine if m[0] is not None) == sorted(w[:4] for w in want if w[0] is not None)
    assert sorted(m[4] for m in mine) == pytest.approx(sorted(w[4] for w in want), rel=1e-12)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_nothing_to_learn_from(spark):
    df = documents(spark, odd_rows())
    got = lm.score_texts(df, F.lit(False)).collect()
    assert len(got) == df.count()
    assert all(r.train_tokens == r.n_known == 0 and r.base_score == pytest.approx(0) for r in got)
    assert lm.score_texts(df.limit(0), F.lit(True)).count() == 0


def test_the_model_knows_what_it_has_seen(spark):
    rng = random.Random(2)
    seen = [sentence(rng, 30, 500) for _ in range(100)]
    shuffled = [" ".join(rng.sample(t.split(), 30)) for t in seen]
    rows = [(i, t, "a") for i, t in enumerate(seen)] + [(i + 1000, t, "b") for i, t in enumerate(shuffled)]
    got = {r.doc_id: r for r in lm.score_texts(documents(spark, rows), F.col("lang") == "a").collect()}
    assert all(got[i].base_score == pytest.approx(got[i + 1000].base_score) for i in range(100))
    assert sum(got[i].score > got[i + 1000].score for i in range(100)) == 100


def test_filter_counts_are_quantised_and_one_sided():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 64, 20_000, dtype=np.uint64))
    counts = rng.geometric(0.3, len(keys)) ** 2
    parts = [lm.segment_of(keys[w], counts[w], 12) for _, w in packed.by_bucket(keys, 5)]
    found = lm.Filter(np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]))
    level = lm.levels(counts)
    got = lm.levels(np.ceil(found.counts(keys)))
    assert (got >= level).all() and (got == level).mean() > 0.95
    other = rng.integers(0, 1 << 64, 20_000, dtype=np.uint64)
    assert (found.counts(other) > 0).mean() < 0.02


def test_no_ngram_is_left_out_however_large_the_filter(spark):
    # 6000 n-grams of 16 KB each: 96 MB of filter.
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(30)), "a") for i in range(100)] + [(1000, "w1x0 w1x1 w2x7 new", "b")]
    got = {r.doc_id: r.score for r in lm.score_texts(documents(spark, rows), F.col("lang") == "a", bits_per_entry=1 << 17).collect()}
    counts, pairs = Counter(), Counter()
    for _, text, lang in rows:
        if lang == "a":
            counts.update(words(text) + [None])
            pairs.update(zip([None] + words(text), words(text) + [None]))
    n, v = sum(counts.values()), len(counts)
    middle = lambda c: 1.5 * 2 ** (c.bit_length() - 1) - 0.5 if c > 1 else c
    for i, text, _ in rows:
        want, before = 0.0, None
        for token in words(text) + [None]:
            alone = (middle(counts[token]) + 0.1) / (n + 0.1 * (v + 1))
            share = min(1, middle(pairs[before, token]) / max(1, middle(counts[before])))
            want += math.log10(0.6 * share + 0.4 * alone if counts[before] else alone)
            before = token
        assert got[i] == pytest.approx(want, rel=1e-9)


def test_many_blocks_and_empty_texts(spark, monkeypatch):
    rng = random.Random(5)
    rows = odd_rows() + [(1000 + i, sentence(rng, 40, 60), "en") for i in range(200)] + [(5000 + i, "", "en") for i in range(50)]
    df, learned = documents(spark, rows), F.col("doc_id") % 3 != 0
    want = sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.score, 9)) for r in lm.score_texts(df, learned).collect())
    monkeypatch.setattr(lm, "READ_BYTES", 100)
    monkeypatch.setattr(lm, "BLOCK_BYTES", 300)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.score, 9)) for r in lm.score_texts(df, learned).collect()) == want


def test_levels():
    assert lm.levels(np.array([1, 2, 3, 4, 7, 8, 1 << 30])).tolist() == [1, 2, 2, 3, 3, 4, 31]


def test_the_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = catalog.QUERIES["op9_language_model"](spark, sf_dir)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    fold = lambda i: zlib.crc32(str(i).encode()) % 10
    want = {w[0]: w for w in brute(rows, lambda r: fold(r[0]) != 0)}
    for r in got.collect():
        assert r.held_out == (fold(r.doc_id) == 0)
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][1:4]
        assert r.base_score == pytest.approx(want[r.doc_id][4], rel=1e-9)
