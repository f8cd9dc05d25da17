import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from llm_data import ODD_TEXTS, documents, odd_rows
from terrastat.llm import files, token_files

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", "b", " ", "  ", "\xa0", "\n", "é", "th", "'s", "ing ", "\t", "日", "<|endoftext|>", "1", "23", "!!", "\x1c", "\x0b", "￿", " "]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def test_only_byte_level_vocabularies_are_separable():
    assert token_files.separable(VOCABULARY)
    assert not token_files.separable(public_tokenizers.path("word_bpe_49k.json"))


@pytest.mark.parametrize("path", [VOCABULARY, public_tokenizers.path("word_bpe_49k.json")])
def test_ids_are_those_of_the_library(path):
    rng = random.Random(8)
    texts = [t or "" for t in ODD_TEXTS] + ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    regular = [" ".join("".join(rng.choice(PIECES[:2] + PIECES[6:9] + PIECES[13:16]) for _ in range(rng.randint(1, 6))) for _ in range(9)) for _ in range(500)]
    for some in (texts, regular):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(some))), pa.array(some)], ["doc_id", "text"])
        ((_, ids, lengths),) = token_files.token_ids(iter([batch]), path, table_rows=100)
        ends = np.cumsum(lengths)
        got = [ids[e - n : e].tolist() for e, n in zip(ends, lengths)]
        assert got == [x.ids for x in Tokenizer.from_file(path).encode_batch(some, add_special_tokens=False)]


@pytest.mark.parametrize("length", [3, 2048])
def test_written_and_read_back(spark, library, tmp_path, length):
    rows = [(i, t, None) for i, t in enumerate(ODD_TEXTS * 3)]
    random.Random(1).shuffle(rows)
    location = f"file://{tmp_path}/out"
    index = token_files.write_tokens(documents(spark, rows), location, VOCABULARY, end_id=0, length=length)
    got = {r.doc_id: tuple(r)[1:] for r in token_files.read_tokens(index, location).collect()}
    start, everything = 0, []
    for i, t, _ in sorted(rows):
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        assert got[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4")))
        start += len(ids)
        everything += ids
    sequences = token_files.read_sequences(index, location).orderBy("file", "sequence").collect()
    assert all(len(s.ids) == len(s.mask) == length for s in sequences)
    assert [x for s in sequences for x, m in zip(s.ids, s.mask) if m] == everything
    for file in {s.file for s in sequences}:
        mask = [m for s in sequences if s.file == file for m in s.mask]
        assert sum(mask) > 0 and mask == sorted(mask, reverse=True) and mask.count(False) < length


def test_a_mapped_file_gives_views(tmp_path):
    writer = token_files.SequenceWriter(str(tmp_path), 0, pa.uint16(), 4)
    ids = np.arange(4 * token_files.BATCH_ROWS * 2 + 3, dtype=np.uint16)
    for part in np.split(ids, [1, 7, 700]):
        writer.add(part)
    writer.close()
    file = token_files.TokenFile(f"{tmp_path}/{writer.name}")
    assert not file.sequence(5).flags.owndata and file.sequence(5).tolist() == [20, 21, 22, 23]
    assert (file.tokens(0, len(ids)) == ids).all()
    assert (file.tokens(500, 40) == ids[500:540]).all()
    assert len(file.tokens(10, 0)) == 0


def test_null_and_repeated_identifiers(spark, library, tmp_path):
    rows = odd_rows()
    index = token_files.write_tokens(documents(spark, rows), str(tmp_path), VOCABULARY)
    got = sorted((r.start, r.n_tokens) for r in token_files.read_tokens(index, str(tmp_path)).collect())
    assert len(got) == len(rows)
    assert all(a[0] + a[1] == b[0] for a, b in zip(got, got[1:]))


def test_empty_table(spark, tmp_path):
    index = token_files.write_tokens(documents(spark, odd_rows()).limit(0), str(tmp_path), VOCABULARY)
    assert token_files.read_tokens(index, str(tmp_path)).count() == 0
    assert token_files.read_sequences(index, str(tmp_path)).count() == 0


def test_files_take_uris_and_paths(tmp_path):
    for location in (str(tmp_path), f"file://{tmp_path}"):
        with files.create(location, "x.zst") as out:
            out.write(b"as it is")
        assert files.open_mapped(f"{location}/x.zst").read() == b"as it is"
