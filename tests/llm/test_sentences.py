import random

import public_tokenizers
import pytest
import sentencepiece

from llm_data import ODD_TEXTS, documents, odd_rows
from terrastat.llm import sentences

MODEL = public_tokenizers.path("piece_bpe_32k.model")
PIECES = ["a", "b", " ", "  ", "▁", "\n", "é", "th", "<0x0A>", "ing ", "\t", "日", "</s>", "<s>", "\x00", "　"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def odd_texts():
    rng = random.Random(7)
    return ODD_TEXTS + ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40))) for _ in range(3000)]


def test_the_model_is_separable():
    assert sentences.separable(MODEL)


@pytest.mark.parametrize("table_rows", [10, 10**6])
def test_ids_are_those_of_the_library(library, table_rows):
    import pyarrow as pa

    texts = [t or "" for t in odd_texts()]
    regular = [" ".join(w for w in t.replace("▁", "").split(" ") if w) for t in texts]
    for some in (texts, [t for t in regular if t]):
        parts = [some[i : i + 300] for i in range(0, len(some), 300)]
        batches = (pa.RecordBatch.from_arrays([pa.array(range(len(p))), pa.array(p)], ["doc_id", "text"]) for p in parts)
        got = [ids.tolist() for _, each in sentences.encoded(batches, MODEL, table_rows=table_rows) for ids in each]
        assert got == library.encode(some, add_bos=True, add_eos=True)


def test_encode_and_decode(spark, library):
    rows = [(i, t, None) for i, t in enumerate(odd_texts()[:400])]
    ids = sentences.encode(documents(spark, rows), MODEL)
    texts = sentences.decode(ids.withColumnRenamed("ids", "x.y"), MODEL, ids_col="x.y")
    got, plain = {r.doc_id: r.ids for r in ids.collect()}, {r.doc_id: r.text for r in texts.collect()}
    for i, t, _ in rows:
        assert got[i] == library.encode(t or "", add_bos=True, add_eos=True)
        assert plain[i] == library.decode(got[i])
    bare = sentences.encode(documents(spark, rows), MODEL, bounds=False)
    assert {r.doc_id: r.ids for r in bare.collect()} == {i: ids[1:-1] for i, ids in got.items()}


def test_digests(spark, library):
    import hashlib
    from collections import Counter

    import numpy as np

    rows = odd_rows()
    got = Counter(tuple(r) for r in sentences.digests(documents(spark, rows), MODEL).collect())
    want = Counter()
    for i, t, _ in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4")).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += 1
    assert got == want
    assert sentences.digests(documents(spark, rows).limit(0), MODEL, with_ids=True).count() == 0
