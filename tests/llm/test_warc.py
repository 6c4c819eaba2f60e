"""Archives: exact round trips, byte ranges of any size, damaged and misleading bytes."""

import base64
import hashlib
import io

import pytest

from corridor.llm import warc
from corridor.scratch import new_path

PAGES = "page_id long, url string, html string"
ROWS = [
    (1, "http://a", "<p>same</p>"), (2, "http://b", "<p>same</p>"), (3, None, None), (4, "http://d", ""), (5, "x\r\ny", "ü" * 50_000),
    (6, "http://f", "WARC/1.1\r\nWARC-Record-ID: <x>\r\n\r\n\x1f\x8b"), (7, "http://a", "<p>same</p>"), (7, "http://a", "<p>same</p>"), (None, "n", "null id"),
]


def expected(rows, least):
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == data and p is not None]
        first = max(same) if same and len(data) >= least else None
        revisit = first is not None and page != first
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page, len(data), digest, "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize(("range_bytes", "least"), [(1 << 23, 0), (97, 0), (1000, 5)])
def test_round_trip(spark, range_bytes, least):
    pages = spark.createDataFrame(ROWS, PAGES).repartition(3)
    files = warc.write_warc(pages, new_path(spark, "warc"), least=least, file_bytes=400)
    read = warc.read_warc(files, range_bytes).collect()
    number = lambda u: int(u.rsplit(":", 1)[1]) if u and u.rsplit(":", 1)[1] else None
    found = [(number(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, number(r.refers_to_id)) for r in read]
    assert sorted(found, key=str) == expected(ROWS, least)
    payloads = {number(r.record_id): bytes(r.payload) for r in read if r.record_type == "response"}
    for page, _, html in ROWS:
        assert payloads.get(page, (html or "").encode()) == (html or "").encode()


def test_every_cut_reads_each_record_once():
    members = [warc._member(warc._record(str(i), "u", bytes([i]) * (i * 37), None)) for i in range(12)]
    data = members[0] + b"\x1f\x8b\x08garbage" + b"".join(members[1:6]) + members[6][:-9] + b"".join(members[7:])
    for step in (1, 7, 100, 5000):
        ids = [f["warc-record-id"] for a in range(0, len(data), step) for _, f, _ in warc.records_in(io.BytesIO(data), a, min(a + step, len(data)))]
        assert ids == [f"<urn:page:{i}>" for i in range(12) if i != 6]


def test_listed_archives_and_empty_table(spark):
    folder = new_path(spark, "warc")
    files = warc.write_warc(spark.createDataFrame(ROWS, PAGES), folder)
    listed = warc.archive_files(spark, folder)
    assert sorted(r.record_id for r in warc.read_warc(listed).collect()) == sorted(r.record_id for r in warc.read_warc(files).collect())
    assert warc.read_warc(warc.write_warc(spark.createDataFrame([], PAGES), new_path(spark, "warc"))).count() == 0


def test_a_page_without_an_id_repeats_the_largest(spark):
    pages = spark.createDataFrame([(2, "u", "same"), (None, "u", "same"), (1, "u", "same"), (None, "u", "alone"), (None, "u", "alone")], PAGES)
    found = [(r.page_id, r._revisits) for r in warc.marked_revisits(pages).collect()]
    assert sorted(found, key=str) == sorted([(2, None), (None, 2), (1, 2), (None, None), (None, None)], key=str)


def test_extra_columns_with_clashing_names(spark):
    rows = [(i, "u", f"text {i % 2}", "a", "b", 1, "p", b"x") for i in range(6)]
    pages = spark.createDataFrame(rows, PAGES + ", _key string, _first string, _n int, path string, payload binary")
    read = warc.read_warc(warc.write_warc(pages, new_path(spark, "warc"))).collect()
    assert sorted(r.record_type for r in read) == ["response"] * 2 + ["revisit"] * 4
