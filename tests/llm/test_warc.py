import base64
import hashlib

import pytest
import zstandard

from compare import oracle_connection, oracle_result, spark_result
from terrastat.llm import catalog, warc


def pages(spark, rows):
    data = [(*row, "x", "y", "z") for row in rows]
    return spark.createDataFrame(data, "page_id bigint, url string, html string, owner string, digest string, bundle string").repartition(3)


ROWS = [
    (5, "http://a", "<p>same</p>"), (2, "http://b", "<p>same</p>"), (9, None, "<p>same</p>"),
    (1, "http://c\r\nEvil: x", None), (3, "http://d é", ""), (4, "", "é" * 5000), (6, "u", "\r\n\r\nbody\r\n\r\n"),
    (7, "u", "WARC/1.1\r\n"), (8, "u", "<p>other</p>"), (None, "u", "<p>same</p>"), (None, "u", "only"),
]


def expected(rows, least=0):
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    out = []
    for i, _, html in rows:
        payload = (html or "").encode()
        owner = first.get(html or "") if len(payload) >= least else None
        revisit = owner is not None and i != owner
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((i, len(payload), digest, "revisit" if revisit else "response", owner if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("frame_bytes, bundle_bytes, least", [(1, 1, 0), (600, 1000, 5), (1 << 20, 1 << 28, 0)])
def test_round_trip(spark, tmp_path, frame_bytes, bundle_bytes, least):
    index = warc.write_bundles(pages(spark, ROWS), str(tmp_path), least_bytes=least, frame_bytes=frame_bytes, bundle_bytes=bundle_bytes)
    got = warc.read_bundles(index, str(tmp_path)).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == expected(ROWS, least)
    text = {r.page_id: r.payload for r in got if r.record_type == "response"}
    assert text[4] == ("é" * 5000).encode() and text[6] == b"\r\n\r\nbody\r\n\r\n"
    uris = {r.page_id: r.uri for r in got}
    assert uris[1] == "http://c%0D%0AEvil:%20x" and uris[9] == "urn:unknown" and uris[4] == "urn:unknown"


def test_repeated_rows_are_responses(spark, tmp_path):
    rows = [(1, "u", "a"), (1, "u", "a"), (2, "u", "a")]
    index = warc.write_bundles(pages(spark, rows), str(tmp_path))
    got = sorted(tuple(r)[:1] + tuple(r)[3:5] for r in warc.read_bundles(index, str(tmp_path)).collect())
    assert got == [(1, "response", None), (1, "response", None), (2, "revisit", 1)]


ODD = ["None", "", "a b", "x>\r\nWARC-Type: evil", "%41", "A", "<urn:no-page>", "né / ü?#", None, "\u2028", "007", "7"]


def test_identifiers_of_any_text(spark, tmp_path):
    rows = [(i, "u", f"payload {n // 3}") for n, i in enumerate(ODD)]
    df = spark.createDataFrame(rows, "page_id string, url string, html string").repartition(3)
    index = warc.write_bundles(df, str(tmp_path))
    got = [tuple(r)[:5] for r in warc.read_bundles(index, str(tmp_path)).collect()]
    assert sorted(got, key=str) == expected(rows)
    assert sum(r[3] == "revisit" for r in got) == len(ODD) - 4
    for i in ODD:
        head = warc.record_of(i, "u", b"", i, True).partition(b"\r\n\r\n")[0].decode()
        assert len(head.split("\r\n")) == 10 and head.isascii()


@pytest.mark.parametrize("kind", ["tinyint", "int", "bigint"])
def test_identifiers_of_whole_numbers(spark, tmp_path, kind):
    df = spark.range(-3, 4).selectExpr(f"IF(id = 2, NULL, CAST(id AS {kind})) AS page_id", "'u' AS url", "'x' AS html")
    found = warc.read_bundles(warc.write_bundles(df, str(tmp_path)), str(tmp_path))
    assert dict(found.dtypes)["page_id"] == kind
    got = {r.page_id: (r.record_type, r.refers_to) for r in found.collect()}
    assert got == {-3: ("response", None), **{i: ("revisit", -3) for i in (-2, -1, 0, 1, 3, None)}}


@pytest.mark.parametrize("kind", ["double", "decimal(9,2)", "date", "array<int>"])
def test_identifiers_of_other_types_are_refused(spark, tmp_path, kind):
    df = spark.createDataFrame([], f"page_id {kind}, url string, html string")
    with pytest.raises(TypeError, match="whole number or a text"):
        warc.write_bundles(df, str(tmp_path))


def test_empty_table(spark, tmp_path):
    index = warc.write_bundles(pages(spark, ROWS).limit(0), str(tmp_path))
    assert warc.read_bundles(index, str(tmp_path)).count() == 0


def test_any_zstandard_reader_reads_a_bundle(tmp_path):
    writer = warc.BundleWriter(str(tmp_path), 0, 2000)
    records = [warc.record_of(i, "http://x", b"p" * 50 * i, None, False) for i in range(60)]
    places = [writer.add(r) for r in records]
    writer.close()
    with open(f"{tmp_path}/{writer.name}", "rb") as file:
        plain = zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True).read()
    assert plain == b"".join(records)
    reader = warc.BundleReader(f"{tmp_path}/{writer.name}")
    assert len(reader.sizes) > 5
    for (frame, offset), record in reversed(list(zip(places, records))):
        assert reader.frame(frame)[offset : offset + len(record)] == record
    headers, http, body = warc.parse_record(records[3])
    assert headers["warc-type"] == "response" and http["content-length"] == "150" and body == b"p" * 150


def test_a_damaged_frame_is_noticed(tmp_path):
    writer = warc.BundleWriter(str(tmp_path), 0, 10**6)
    writer.add(warc.record_of(1, "u", b"payload " * 100, None, False))
    writer.close()
    data = bytearray(open(f"{tmp_path}/{writer.name}", "rb").read())
    data[40] ^= 255
    (tmp_path / "bad").write_bytes(data)
    with pytest.raises(zstandard.ZstdError):
        warc.BundleReader(f"{tmp_path}/bad").frame(0)
    with pytest.raises(ValueError, match="no seek table"):
        (tmp_path / "none").write_bytes(bytes(data[:-1]))
        warc.BundleReader(f"{tmp_path}/none")


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_queries_match_their_sql(spark, name):
    sf_dir = "/root/testdata/sf0.01"
    expected_rows = oracle_result(oracle_connection(sf_dir), catalog.ORACLE_SQL[name])
    assert spark_result(catalog.QUERIES[name](spark, sf_dir)) == expected_rows and expected_rows[1]


