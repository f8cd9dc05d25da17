import random

import numpy as np
import pyarrow as pa
import pytest

from llm_data import ODD_TEXTS, lower as plain_lower, words
from terrastat.llm import common, packed


def test_words_are_those_of_the_pattern():
    data, offsets = common.flat(pa.array(ODD_TEXTS))
    data = common.lower(data)
    starts, ends, first = common.word_spans(data, offsets)
    line = data.tobytes()
    for i, text in enumerate(ODD_TEXTS):
        assert [line[starts[j] : ends[j]].decode() for j in range(first[i], first[i + 1])] == words(text)


def test_slices_and_empty_arrays():
    texts = pa.array(ODD_TEXTS)
    data, offsets = common.flat(texts.slice(6, 3))
    assert [data[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:])] == ODD_TEXTS[6:9]
    data, offsets = common.flat(pa.array([], pa.string()))
    assert len(data) == 0 and common.word_spans(data, offsets)[2].tolist() == [0]


def test_equal_words_hash_alike_wherever_they_are():
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abé") for _ in range(rng.randint(1, 12))) for _ in range(50)) for _ in range(40)]
    data, offsets = common.flat(pa.array(texts))
    starts, ends, _ = common.word_spans(data, offsets)
    hashes = common.word_hashes(data, starts, ends).tolist()
    found = {}
    for word, h in zip([w for t in texts for w in words(t)], hashes):
        assert found.setdefault(word, h) == h
    assert len(set(found.values())) == len(found)


def test_words_that_collide_in_any_polynomial():
    """Thue-Morse words and their complements hash alike in every polynomial modulo 2^64."""
    for n in (10, 11, 12):
        bits = [bin(i).count("1") % 2 for i in range(1 << n)]
        pair = ["".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)]
        data, offsets = common.flat(pa.array([*pair, f"x {pair[0]} y"]))
        starts, ends, _ = common.word_spans(data, offsets)
        first, second, _, again, _ = common.word_hashes(data, starts, ends).tolist()
        assert first != second and first == again


def test_powers_of_long_pieces_are_not_kept():
    common._powers.clear()
    whole = common._power("up", common._BASE, 3 << 20)
    assert len(whole) == 3 << 20 and not common._powers
    assert (common._power("up", common._BASE, 1000) == whole[:1000]).all()
    assert sum(x.nbytes for x in common._powers.values()) <= 1 << 16


def test_pieces_keep_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(ODD_TEXTS))), pa.array(ODD_TEXTS)], ["doc_id", "text"])
    for limit in (1, 100, 10**9):
        parts = list(common.pieces(iter([batch]), limit))
        assert [i for p in parts for i in p.column("doc_id").to_pylist()] == list(range(len(ODD_TEXTS)))


def test_packed_keys_come_back():
    rng = np.random.default_rng(1)
    keys = np.sort(rng.integers(0, 1 << 64, 1000, dtype=np.uint64))
    assert (packed.unpack(packed.pack(keys)) == keys).all()
    assert len(packed.unpack(packed.pack(keys[:0]))) == 0
    parts = list(packed.by_bucket(keys, 7))
    assert [b for b, _ in parts] == list(range(7))
    assert (np.concatenate([keys[w] for _, w in parts]) == keys).all()
    summed, counts = packed.summed(np.array([5, 3, 5], np.uint64), np.array([1, 2, 3]))
    assert summed.tolist() == [3, 5] and counts.tolist() == [2, 4]


def test_a_cluster_needs_a_shared_folder(spark):
    class Session:
        class conf:
            @staticmethod
            def get(key, default):
                return default

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(Session)
    assert common.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_lower_leaves_other_letters_alone():
    text = "AZaz[`{@É"
    assert common.lower(np.frombuffer(text.encode(), np.uint8)).tobytes().decode() == plain_lower(text)
