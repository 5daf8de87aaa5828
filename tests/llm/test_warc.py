import gzip
import io

import pytest

from tessera.llm import warc


def test_round_trip_decisions(spark):
    rows = [(1, "u1", "a"), (2, "u2", "a"), (3, "u3", None), (4, "u4", ""), (5, None, "ä" * 70000), (2, "u2", "b"), (None, "x y\n", "c"), (None, "z", "a")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as payload", "'q' as sha1")
    got = {(r.page_id, r.payload_digest): r for r in warc.archive_round_trip(df).collect()}
    digest = lambda s: warc.sha1_base32(s.encode())
    assert len(got) == 8
    assert got[2, digest("a")].record_type == "response" and got[1, digest("a")].refers_to == 2 and got[None, digest("a")].refers_to == 2
    assert got[4, digest("")].record_type == "response" and got[3, digest("")].refers_to == 4 and got[3, digest("")].payload_bytes == 0
    assert got[5, digest("ä" * 70000)].payload_bytes == 140000
    assert got[2, digest("b")].record_type == "response" and got[None, digest("c")].refers_to is None


def test_min_bytes_and_empty(spark):
    df = spark.createDataFrame([(1, "u", "a"), (2, "u", "a")], "page_id long, url string, html string")
    assert {r.record_type for r in warc.archive_round_trip(df, min_bytes=2).collect()} == {"response"}
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_ties_are_all_responses(spark):
    df = spark.createDataFrame([(1, "u", "a"), (1, "u", "a"), (0, "u", "a")], "page_id long, url string, html string")
    assert sorted((r.page_id, r.record_type) for r in warc.archive_round_trip(df).collect()) == [(0, "revisit"), (1, "response"), (1, "response")]


def test_reader_refuses_damage():
    data = warc.encode_record(1, "u", b"hello", None) + warc.encode_record(2, "u", b"hello", 1)
    assert [(r[0], r[2], r[3], r[4]) for r in warc.read_archive(io.BytesIO(data))] == [(1, "response", None, 5), (2, "revisit", 1, 5)]
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(data[:-9])))
    plain = gzip.decompress(data[: len(warc.encode_record(1, "u", b"hello", None))])
    for bad in (plain.replace(b"hello", b"hellO"), plain.replace(b"\r\n\r\nHTTP", b"\r\n\r\nHTTPS")):
        with pytest.raises(ValueError):
            list(warc.read_archive(io.BytesIO(gzip.compress(bad))))
