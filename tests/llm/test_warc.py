import base64
import gzip
import hashlib
import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from ordinate.llm import warc

SCHEMA = "page_id bigint, url string, html string"


def want(rows, smallest=0):
    groups = {}
    for i, _, html in rows:
        if len((html or "").encode()) >= smallest:
            groups.setdefault(html or "", []).append(i)
    out, first = [], {h: min(ids, key=lambda i: (i is None, i)) for h, ids in groups.items()}
    seen = set()
    for i, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (html or "").encode()
        key = html or ""
        again = len(data) >= smallest and key in seen
        seen.add(key)
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first[key] if again else None))
    return sorted(out, key=str)


def read(spark, folder):
    found = warc.records(spark, folder).where("record_type != 'warcinfo'")
    return found.withColumns({"page": warc.page_of("warc-page-id"), "refers": warc.page_of("warc-refers-to-page-id")}).collect()


ROWS = [
    (5, "https://a.org/x", "<p>one</p>"), (3, "https://a.org/y", "<p>one</p>"), (9, "https://a.org/z", "<p>one</p>"), (9, "https://a.org/z", "<p>one</p>"),
    (2, None, None), (1, "https://b.org/ö?q=1\r\nX: y", ""), (7, "u", "<p>" + "long text " * 5000), (8, "u", "grüße \u0000\r\n\r\nWARC/1.1\r\n"),
    (4, "v", "tied"), (4, "v", "tied"), (None, "w", "of nobody"), (None, "w", "of nobody"), (11, "w", "of nobody"), (12, "a", "<p>two</p>"),
]


@pytest.mark.parametrize("zip64,smallest,limit", [(False, 0, 200_000), (True, 0, 0), (True, 5, 200_000)])
def test_round_trip(spark, tmp_path, monkeypatch, zip64, smallest, limit):
    """Copies, ties, nulls, line ends and record starts in texts; both directories, both ways to find copies; small ranges."""
    monkeypatch.setattr(warc, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(warc, "RANGE_BYTES", 700)
    given = spark.createDataFrame(ROWS, SCHEMA).repartition(3).withColumns({"page": F.lit("x"), "same": F.lit(1), "payload": F.lit(2)})
    folder = str(tmp_path / "out")
    warc.write(given, folder, zip64=zip64, smallest=smallest)
    rows = read(spark, folder)
    assert sorted([(r.page, r.payload_bytes, r.payload_digest, r.record_type, r.refers) for r in rows], key=str) == want(ROWS, smallest)
    assert all(r.intact and r.offset > 0 for r in rows)
    texts = {(i, (h or "").encode()) for i, _, h in ROWS}
    assert all((r.page, bytes(r.payload)) in texts for r in rows if r.record_type == "response")
    assert all(bytes(r.payload) == b"" for r in rows if r.record_type == "revisit")
    uris = {r.page: r.target_uri for r in rows}
    assert uris[5] == "https://a.org/x" and uris[1] == "https://b.org/ö?q=1%0D%0AX:%20y" and uris[2].startswith("urn:uuid:")
    responses = {r.record_id for r in rows if r.record_type == "response"}
    assert all(r.headers["warc-refers-to"] in responses for r in rows if r.record_type == "revisit")
    assert len({r.record_id for r in rows}) == len(rows)


@pytest.mark.parametrize("zip64", [False, True])
def test_archives_are_zip_files(spark, tmp_path, zip64):
    """Another reader finds the members, their checksums and the records at the places of the index."""
    warc.write(spark.createDataFrame(ROWS, SCHEMA).repartition(2), str(tmp_path / "out"), zip64=zip64)
    n = 0
    for name in os.listdir(tmp_path / "out"):
        if not name.startswith("part-"):
            continue
        with zipfile.ZipFile(tmp_path / "out" / name) as z:
            assert z.testzip() is None and [i.compress_type for i in z.infolist()] == [0, 0]
            data = z.read(warc.RECORDS)
            for line in gzip.decompress(z.read(warc.INDEX)).splitlines():
                entry = json.loads(line[line.index(b"{") :])
                one = data[int(entry["offset"]) :][: int(entry["length"])]
                assert gzip.decompress(one).startswith(b"WARC/1.1\r\n")
                n += 1
    assert n == len(ROWS)
    places = warc.members(spark, str(tmp_path / "out")).collect()
    assert {r.name for r in places} == {warc.RECORDS, warc.INDEX} and {r.method for r in places} == {0}


def record(kind, page, body, digest=None):
    lines = [b"WARC/1.0", b"WARC-Type: " + kind, b"WARC-Page-ID: %d" % page, b"Content-Length: %d" % len(body)] + ([b"WARC-Payload-Digest: sha1:" + digest] if digest else [])
    return b"\r\n".join(lines) + b"\r\n\r\n" + body + b"\r\n\r\n"


def archive(path, members, prefix=b""):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, body, method in members:
            z.writestr(zipfile.ZipInfo(name), body, method)
        z.comment = b"PK\5\6 a comment that looks like an end"
    path.write_bytes(prefix + data.getvalue())


def test_archives_of_others(spark, tmp_path):
    """Plain and compressed members, with and without an index, several of each, a comment, bytes before the archive, a wrong digest, an empty file."""
    one, two, three = record(b"resource", 1, b"body 1"), record(b"resource", 2, b"", b"WRONG"), record(b"conversion", 3, b"x" * 3000)
    index = b"".join(b'org,a)/ 2024 {"offset": "%d", "length": %d, "filename": "a.warc"}\n' % x for x in ((len(one), len(two)), (0, len(one))))
    other = b'org,b)/ 2024 {"offset": 0, "length": %d, "filename": "b.warc.gz", "x": 1}\nno entry\n' % len(gzip.compress(three, mtime=0))
    stored, folder = zipfile.ZIP_STORED, tmp_path / "in"
    folder.mkdir()
    archive(folder / "a.wacz", [("archive/a.warc", one + two, stored), ("archive/b.warc.gz", gzip.compress(three, mtime=0), stored), ("indexes/a.cdxj", index, stored), ("indexes/b.cdx.gz", gzip.compress(other), stored), ("pages/x.txt", b"y" * 99, zipfile.ZIP_DEFLATED)])
    archive(folder / "b.wacz", [("archive/", b"", stored), ("archive/c.warc.gz", gzip.compress(one) + gzip.compress(three), stored), ("archive/d.warc", two, stored), ("archive/e.warc", b"", stored)], prefix=b"#!/bin/sh\n")
    archive(folder / "c.wacz", [])
    (folder / "d.wacz").write_bytes(b"")
    rows = warc.records(spark, str(folder)).withColumn("page", warc.page_of("warc-page-id")).collect()
    got = sorted((os.path.basename(r.path), r.page, r.payload_bytes, r.intact, r.offset is None) for r in rows)
    assert got == [("a.wacz", 1, 6, None, False), ("a.wacz", 2, 0, False, False), ("a.wacz", 3, 3000, None, False), ("b.wacz", 1, 6, None, True), ("b.wacz", 2, 0, False, True), ("b.wacz", 3, 3000, None, True)]
    assert all(r.payload is None for r in warc.records(spark, str(folder), content=False).collect())


@pytest.mark.parametrize("body,error", [(b"no archive at all", "no end record"), (None, "only stored")])
def test_what_is_no_archive_fails(spark, tmp_path, body, error):
    if body:
        (tmp_path / "x.wacz").write_bytes(body)
    else:
        archive(tmp_path / "x.wacz", [("archive/a.warc", b"z" * 99, zipfile.ZIP_DEFLATED)])
    with pytest.raises(Exception, match=error):
        warc.records(spark, str(tmp_path)).collect()


def test_large_records_and_empty_tables(spark, tmp_path):
    """A record of over 16 MB, whose length has no zero byte at its end; no records at all."""
    given = spark.createDataFrame([(1, "u", "n"), (2, "u", "n")], SCHEMA).withColumn("html", F.repeat(F.lit("0123456789abcdef"), (1_100_000 * F.col("page_id")).cast("int")))
    warc.write(given.coalesce(1), str(tmp_path / "large"))
    assert sorted((r.page, len(r.payload), r.intact) for r in read(spark, str(tmp_path / "large"))) == [(1, 17_600_000, True), (2, 35_200_000, True)]
    warc.write(spark.createDataFrame([], SCHEMA), str(tmp_path / "none"))
    assert read(spark, str(tmp_path / "none")) == []
