import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from llm_data import ODD_TEXTS, documents, lower, odd_rows
from terrastat.llm import catalog, decontaminate as dc

SF_DIR = "/root/testdata/sf0.01"


def plain_distance(item: str, text: str) -> int:
    """The least edit distance of ``item`` to any stretch of ``text``."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        last, row = row, [i] + [0] * len(text)
        for j, b in enumerate(text, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (a != b))
    return min(row)


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(200):
        item = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 80)))
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 90)))
        found = dc.best_stretch(item.encode(), text.encode(), len(item))
        assert found[0] == plain_distance(item, text)
        assert plain_distance(item, text[found[1] : found[2]]) == found[0]


def test_normalised_text():
    raw = ODD_TEXTS + [" \t a  B\n\n c ", "x "]
    data, offsets, position = dc.normalised(*dc.flat(pa.array(raw)))
    line = data.tobytes()
    space = " \t\n\x0b\x0c\r"
    for i, text in enumerate(raw):
        plain = " ".join(w for w in "".join(" " if c in space else c for c in lower(text)).split(" ") if w)
        assert line[offsets[i] : offsets[i + 1]].decode() == plain
    assert len(position) == len(line)


def word(rng):
    return "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 8)))


def passage(rng, n):
    return " ".join(word(rng) for _ in range(n))


def planted(share):
    """Texts, each with an item that has this share of its bytes edited, and clean texts."""
    rng, np_rng = random.Random(2), np.random.default_rng(2)
    items = [passage(rng, rng.randint(15, 60)) for _ in range(60)]
    rows = []
    for n, item in enumerate(items):
        edited = dc._edited(item.encode(), int(share * len(item)), np_rng).decode()
        rows.append((n, f"{passage(rng, 50)} {edited}\n{passage(rng, 50)}", "en"))
        rows.append((n + 1000, passage(rng, 150), "en"))
    return items, rows


def benchmark(spark, items):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)], "item_id bigint, text string, row_key string")


@pytest.mark.parametrize("share, least", [(0.0, 1.0), (0.1, 1.0), (0.19, 0.95)])
def test_recall_and_precision(spark, share, least):
    items, rows = planted(share)
    got = {(r.doc_id, r.item_id): r for r in dc.find_items(documents(spark, rows), benchmark(spark, items)).collect()}
    assert all(d < 1000 for d, _ in got)
    assert sum((n, n) in got for n in range(60)) >= least * 60
    for (d, i), r in got.items():
        text = dict((x[0], x[1]) for x in rows)[d]
        assert d == i and r.distance <= 0.2 * len(items[i]) and r.similarity == pytest.approx(1 - r.distance / len(items[i]))
        assert plain_distance(items[i], re.sub(r"\s+", " ", text)) == r.distance
        stretch = text.encode()[r.begin_byte : r.end_byte].decode()
        assert plain_distance(items[i], re.sub(r"\s+", " ", stretch)) == r.distance


def test_blocks_of_items_give_the_same(spark):
    items, rows = planted(0.05)
    df, bench = documents(spark, rows), benchmark(spark, items)
    whole = sorted(tuple(r)[:3] for r in dc.find_items(df, bench).collect())
    assert sorted(tuple(r)[:3] for r in dc.find_items(df, bench, block_bytes=3000).collect()) == whole
    kept = {r.doc_id for r in dc.clean_rows(df, bench, block_bytes=3000).collect()}
    assert kept == {r[0] for r in rows} - {d for d, *_ in whole}


def test_white_space_and_case_do_not_matter(spark):
    rng = random.Random(3)
    item = passage(rng, 30)
    text = "Before.\n" + item.upper().replace(" ", " \n\t ") + "\n\nafter"
    (found,) = dc.find_items(documents(spark, [(1, text, "en")]), benchmark(spark, [item])).collect()
    assert found.distance == 0 and text.encode()[found.begin_byte : found.end_byte].decode() == item.upper().replace(" ", " \n\t ")


def test_several_places_and_repeated_rows(spark):
    rng = random.Random(4)
    item = passage(rng, 30)
    text = " ".join([item, passage(rng, 100), item, passage(rng, 100), item])
    got = dc.find_items(documents(spark, [(1, text, "en"), (1, text, "en"), (None, item, None)]), benchmark(spark, [item, item])).collect()
    assert len(got) == 3 * 2 * 2 + 2


def test_odd_rows(spark):
    df = documents(spark, odd_rows())
    bench = benchmark(spark, [None, "", "a", "ab", "a b c", "x" * 100, "zzzzzz yyyyyy"])
    got = dc.find_items(df, bench).collect()
    assert {r.item_id for r in got} <= {4, 5}
    assert {r.doc_id for r in got if r.item_id == 5 and r.doc_id is not None} == {i for i, t, _ in odd_rows() if t == "x" * 3000}
    assert {r.doc_id for r in got if r.item_id == 4} >= {7, 107, None}
    assert dc.find_items(df.limit(0), bench).count() == 0
    assert dc.find_items(df, bench.limit(0)).count() == 0
    clean = dc.clean_rows(df, bench.limit(0))
    assert clean.columns == df.columns and clean.count() == df.count()


def test_repetitions_reach_the_target():
    rng = random.Random(5)
    items = [passage(rng, 40).encode() for _ in range(30)]
    few, many = dc.repetitions_of(items, 0.95, 0.5)[1], dc.repetitions_of(items, 0.8, 0.99)[1]
    assert 1 <= few <= many <= dc.TRIED
    assert dc.repetitions_of([b"xyz"])[0] == (3, 1)
    assert dc.plan_of(2) is None and dc.plan_of(10**6) == dc.PLANS[0][1:]


def prose(rng, n):
    """Exactly n bytes of words of letters of natural frequency."""
    out = ""
    while len(out) < n:
        out += "".join(rng.choice("eeettaaooiinnsshhrrddlucmfwypvbgk") for _ in range(rng.randint(1, 9))) + " "
    return out[: n - 1] + "e"


@pytest.mark.parametrize("share", [0.1, 0.2])
@pytest.mark.parametrize("length", [40, 60, 80, 100, 130, 260])
def test_recall_by_length(length, share):
    """Whole operator, without Spark: items of one length among items of all others."""
    rng, np_rng = random.Random(length), np.random.default_rng(length)
    items = [prose(rng, length).encode() for _ in range(100)] + [prose(rng, n).encode() for n in (260, 40, 70, 150) for _ in range(20)]
    index = dc.build_index(list(range(len(items))), items, 0.8, 0.95)
    edited = [" ".join(dc._edited(x, int(share * length), np_rng).decode().split()) for x in items[:100]]
    # Where an edit leaves two spaces, one of them goes, which is one edit more.
    able = [i for i in range(100) if dc.best_stretch(items[i], edited[i].encode(), length)[0] <= 0.2 * length]
    assert len(able) > 90
    found = {(text, item) for text, item, *_ in dc.hits(index, pa.array([f"{prose(rng, 300)} {x} {prose(rng, 300)}" for x in edited]))}
    assert sum((i, i) in found for i in able) >= 0.95 * len(able)


def chinese(rng, n):
    return "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(n))


def test_items_behind_quotes_and_in_scripts_without_spaces():
    rng = random.Random(8)
    quoted = [prose(rng, 40) for _ in range(100)]
    long = [chinese(rng, 30) for _ in range(100)]
    items = [x.encode() for x in quoted + long + ["(" + prose(rng, 45) for _ in range(20)]]
    index = dc.build_index(list(range(len(items))), items, 0.8, 0.95)
    texts = [f'{prose(rng, 100)} "{x}" {prose(rng, 100)}' for x in quoted] + [chinese(rng, 200) + x + chinese(rng, 200) for x in long]
    texts += [f'{prose(rng, 50)} "{items[200 + i].decode()})' for i in range(20)]
    found = {(text, item) for text, item, *_ in dc.hits(index, pa.array(texts))}
    assert {(i, i) for i in range(220)} <= found


def test_a_text_that_repeats_itself_in_bounded_memory():
    rng = random.Random(9)
    items = [("a " * 130)[: 200 + i].encode() for i in range(50)] + [prose(rng, 200).encode()]
    text = "a " * 100_000
    index = dc.build_index(list(range(51)), items, 0.8, 0.95)
    tracemalloc.start()
    packed = dc.symbols(np.frombuffer(text.encode(), np.uint8))
    starts = dc.window_starts(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    found = [len(dc.candidates(index, packed, starts[i : i + dc.STARTS])) for i in range(0, len(starts), dc.STARTS)]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 150e6
    # A candidate for each item and cell, at most.
    assert len(found) > 1 and 0 < sum(found) <= 50 * (len(text) // 5 + 100 * len(found))
    got = {item for _, item, *_ in dc.hits(index, pa.array(["a " * 2000 + items[50].decode()]))}
    assert got == set(range(51))


def test_the_query_finds_every_exact_passage(spark):
    got = {(r.doc_id, r.item_id) for r in catalog.QUERIES["op3_decontaminate"](spark, SF_DIR).collect()}
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()
    exact = {(d.doc_id, i.item_id) for i in items for d in docs if i.text in (d.text or "")}
    assert exact and exact <= got
    texts = {d.doc_id: " ".join(lower(d.text).split()) for d in docs}
    names = {i.item_id: " ".join(lower(i.text).split()) for i in items}
    for d, i in got - exact:
        assert plain_distance(names[i], texts[d]) <= 0.2 * len(names[i].encode())
