"""WARC archives: round trips, revisits, rolling and damage."""

from __future__ import annotations

import hashlib
import uuid

import pytest

from askwell.llm import warc
from askwell.llm.common import shared_folder

SF = "/root/testdata/sf0.001"


def expected(rows, least):
    best = {}
    for i, _, html in rows:
        data = (html or "").encode()
        if len(data) >= least and i is not None:
            best[data] = max(i, best.get(data, i))
    out = []
    for i, url, html in rows:
        data = (html or "").encode()
        to = best.get(data) if len(data) >= least else None
        to = None if to == i else to
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=repr)


def read(spark, folder):
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return sorted((tuple(r) for r in warc.read_archive(spark, folder).select(*names).collect()), key=repr)


def odd_pages(spark):
    long = "<p>" + "same text " * 200
    rows = [
        (1, "http://a/é b\nc", long), (2, "http://b/%20", long), (2, "http://b/2", long), (-5, None, long), (None, "http://n/", long),
        (None, None, long), (7, "http://c/", "short"), (8, "http://d/", "short"), (9, "http://e/", None), (10, "http://f/", ""),
        (2**62, "http://g/", "\r\n\r\n" + long * 300), (11, "x" * 3000, "é" * 600),
    ]
    return spark.createDataFrame([(*r, "p", 1) for r in rows], "page_id long, url string, html string, payload string, shard int")


@pytest.mark.parametrize("sizes", [(16 << 20, 32 << 20), (3000, 2000)])
def test_archives_round_trip(spark, sizes):
    for number, pages in enumerate((spark.read.parquet(f"{SF}/pages.parquet"), odd_pages(spark))):
        folder = f"{shared_folder(spark)}/warc-test-{uuid.uuid4().hex}"
        folder = folder if "://" in folder else f"file://{folder}"
        manifest = warc.write_archive(pages, folder, shard_bytes=sizes[0], file_bytes=sizes[1])
        rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
        assert read(spark, folder) == expected(rows, 1000)
        payloads = {bytes(r.payload) for r in warc.read_archive(spark, folder).filter("record_type = 'response'").collect()}
        assert payloads == {(html or "").encode() for _, _, html in rows}
        again = f"{folder}-again"
        second = warc.write_archive(pages.repartition(5), again, shard_bytes=sizes[0], file_bytes=sizes[1])
        assert sorted(manifest.collect()) == sorted(second.collect())  # names, sizes and digests of files
        if sizes[0] < 10000:
            assert manifest.count() > 1


def test_empty_archive_and_ids(spark):
    folder = f"file://{shared_folder(spark).removeprefix('file://')}/warc-test-{uuid.uuid4().hex}"
    assert warc.write_archive(odd_pages(spark).limit(0), folder).count() == 0 and read(spark, folder) == []
    for number in (0, 1, -1, 2**63 - 1, -(2**63), 123456789012345):
        assert warc.page_of(warc.record_id(number, b"")) == number
    assert warc.page_of(warc.record_id(None, b"12345678")) is None


def test_damage_is_found():
    data = warc.page_record(3, "http://a/", b"payload", None)
    good = next(warc.members(data))
    assert warc.parse(good)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse(good.replace(b"payload\r\n\r\n", b"paxload\r\n\r\n"))
    with pytest.raises(ValueError):
        list(warc.members(data[:-5]))


def test_shards_follow_bytes_however_page_numbers_lie(spark):
    html = "<p>" + "x" * 500
    rows = [(i, "http://a/", f"{html}{i}") for i in range(2000)] + [(10**15, "http://far/", html), (-(10**15) + 7, "http://low/", html), (2**62, None, html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    folder = f"file://{shared_folder(spark).removeprefix('file://')}/warc-test-{uuid.uuid4().hex}"
    manifest = warc.write_archive(pages, folder, shard_bytes=50_000, file_bytes=1 << 30).collect()
    assert 20 <= len(manifest) <= 60 and max(r["records"] for r in manifest) <= 110
    assert read(spark, folder) == expected(rows, 1000)
