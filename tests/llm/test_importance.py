import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import pytest

from llm_data import documents, odd_rows, sentence
from terrastat.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def features(text, longest):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def expected(rows, target, longest=1, buckets=10000, least=20, percent=10):
    bucket = lambda f: crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in rows for f in features(t, longest))
    t = Counter(bucket(f) for text in target for f in features(text, longest))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (S + buckets) / ((s[b] + 1.0) * (T + buckets))))
    out = []
    for i, text in rows:
        f = features(text, longest)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0], r[1], r[2]))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = rank
    return [tuple(r[:5]) for r in out]


def key(row):
    return tuple((v is not None, v) for v in row)


def same(df, rows, target, **options):
    return sorted(map(tuple, df.collect()), key=key) == sorted(expected(rows, target, **options), key=key)


def target_table(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "item_id bigint, text string, bucket string")


def corpus(n=400):
    rng = random.Random(1)
    rows = [(i, sentence(rng, rng.randint(0, 80), 300)) for i in range(n)]
    hot = sentence(rng, 40, 300)
    rows += [(5000 + i, hot) for i in range(150)] + [rows[3], rows[3], (None, hot)]
    target = [sentence(rng, 30, 40) for _ in range(20)] + [None, "", "W1 w1"]
    return rows, target


@pytest.mark.parametrize("head", [3, 1 << 15])
@pytest.mark.parametrize("longest", [1, 2])
def test_resample(spark, longest, head):
    rows, target = corpus()
    docs = documents(spark, [(i, t, None) for i, t in rows])
    got = importance.resample(docs, target_table(spark, target), longest=longest, head=head)
    assert same(got, rows, target, longest=longest)
    assert set(got.dtypes) == {(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")}


def test_odd_texts(spark):
    rows = [(i, t) for i, t, _ in odd_rows()]
    got = importance.resample(documents(spark, odd_rows()), target_table(spark, ["a b", None]), least_words=1, percent=50)
    assert same(got, rows, ["a b", None], least=1, percent=50)
    assert importance.resample(documents(spark, odd_rows()).limit(0), target_table(spark, ["a"])).count() == 0
    few = importance.resample(documents(spark, odd_rows()), target_table(spark, []))
    assert same(few, rows, [])


def test_all_and_none_drawn(spark):
    rows, target = corpus(60)
    docs, wanted = documents(spark, [(i, t, None) for i, t in rows]), target_table(spark, target)
    assert same(importance.resample(docs, wanted, percent=100, least_words=0), rows, target, percent=100, least=0)
    assert same(importance.resample(docs, wanted, percent=0), rows, target, percent=0)


def test_words_across_stretches(monkeypatch):
    text = "Aé b-c 日本 _x `y` {z} 09 " * 40
    whole = [w for run in importance.word_runs(text.encode()) for w in run]
    assert [w.decode() for w in whole] == words(text)
    known = importance.Vocabulary([b"b", b"c"], [b"b c"], 997)
    buckets = lambda: sorted(b for _, found in known.text_buckets(text.encode(), 2) for b in found.tolist())
    once = buckets()
    monkeypatch.setattr(importance, "RUN_BYTES", 7)
    assert buckets() == once == sorted(crc32(f.encode()) % 997 for f in features(text, 2))
    assert [w for run in importance.word_runs(b"x" * 50 + b" y") for w in run] == [b"x" * 50, b"y"]
    with pytest.raises(ValueError):
        importance.resample(None, None, longest=3)
