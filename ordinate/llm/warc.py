"""WARC records in ZIP-packaged archives: written by Spark's text writer, read by byte ranges.

An archive is a ZIP file whose members are stored, not deflated: records, each compressed by itself, in archive/, and an index of their places in
indexes/. A reader needs a few ranges of it: the end of the file, which names the central directory (by ZIP64 records, where
32 bits don't do), the directory, the index, and then just the records asked for. Nothing is extracted. The directories of all archives are read
by one task each, the records by many, in ranges of bounded size.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, flagged, prepare, written

RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.cdx.gz"
#: Bytes of a range that is read at once, and of the ranges of a task.
RANGE_BYTES, TASK_BYTES = 4 << 20, 32 << 20
#: Fixed values of the ZIP format: signatures; the size of an end record and of the longest comment after it; what stands for "see ZIP64".
LOCAL, DESCRIPTOR, CENTRAL, END, END64, LOCATOR64 = (b"PK" + x for x in (b"\3\4", b"\7\10", b"\1\2", b"\5\6", b"\6\6", b"\6\7"))
END_BYTES, COMMENT_BYTES, FULL16, FULL32 = 22, 65535, 0xFFFF, 0xFFFFFFFF
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# Writing


class Archive:
    """The bytes of one archive, piece by piece. Every piece ends with a zero byte."""

    def __init__(self, zip64: bool) -> None:
        self.at, self.zip64, self.members = 0, zip64, []

    def begin(self, name: str) -> bytes:
        """A member's header; sizes are unknown yet, and follow in a descriptor."""
        self.name, self.start, self.crc = name.encode(), self.at, 0
        head = LOCAL + struct.pack("<HHHHHIIIHH", 45, 8, 0, 0, 33, 0, FULL32, FULL32, len(self.name), 20) + self.name + struct.pack("<HHQQ", 1, 16, 0, 0)
        self.at += len(head)
        self.data = self.at
        return head

    def add(self, data: bytes) -> bytes:
        self.crc = zlib.crc32(data, self.crc)
        self.at += len(data)
        return data

    def end(self) -> bytes:
        size = self.at - self.data
        self.members.append((self.name, self.start, self.crc, size))
        tail = DESCRIPTOR + struct.pack("<IQQ", self.crc, size, size)
        self.at += len(tail)
        return tail

    def directory(self) -> bytes:
        out = b""
        for name, start, crc, size in self.members:
            wide = self.zip64 or max(start, size) >= FULL32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, start) if wide else b""
            small = (FULL32, FULL32) if wide else (size, start)
            out += CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 8, 0, 0, 33, crc, small[0], small[0], len(name), len(extra), 0, 0, 0, 0, small[1]) + name + extra
        at, n, size = self.at, len(self.members), len(out)
        if self.zip64 or at >= FULL32:
            out += END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, at) + LOCATOR64 + struct.pack("<IQI", 0, at + size, 1)
            n, size, at = FULL16, FULL32, FULL32
        return out + END + struct.pack("<HHHHIIH", 0, 0, n, n, size, at, 0)


def _zipped(data: bytes) -> bytes:
    """data as a gzip member whose last byte is zero: one of 16 MB or more is followed by an empty member."""
    return gzip.compress(data, 6, mtime=0) + (gzip.compress(b"", mtime=0) if len(data) >= 1 << 24 else b"")


def _record(kind: str, block: bytes, **headers: str | None) -> bytes:
    """A WARC record; _ stands for - in the headers' names, those without a value are left out."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k.replace('_', '-')}: {v}" for k, v in headers.items() if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _urn(*parts: object) -> str:
    h = hashlib.sha1("\n".join(map(str, parts)).encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-8{h[17:20]}-{h[20:32]}>"


def _quoted(url: str) -> str:
    """url without the characters that would end its header."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _packer(date: str, zip64: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, n, part = Archive(zip64), 0, TaskContext.get().partitionId()
        index, entries = zlib.compressobj(6, zlib.DEFLATED, 31), []
        head = archive.begin(RECORDS) + archive.add(_zipped(_record("warcinfo", b"format: WARC File Format 1.1\r\n", WARC_Record_ID=_urn("info", date), WARC_Date=date, Content_Type="application/warc-fields")))
        yield _piece(head)
        for batch in batches:
            for k in range(batch.num_rows):
                page, url, payload, refers, again, shared = (batch.column(c)[k].as_py() for c in ("page", "url", "payload", "refers", "again", "shared"))
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                url = _quoted(url) if url else _urn("page", page)[1:-1]
                common = {"WARC_Date": date, "WARC_Target_URI": url, "WARC_Payload_Digest": f"sha1:{digest}", "WARC_Page_ID": page, "Content_Type": "application/http; msgtype=response"}
                if again:
                    own = _urn("revisit", page, digest, n, part)
                    data = _record("revisit", http, WARC_Record_ID=own, **common, WARC_Profile=IDENTICAL, WARC_Refers_To=_urn("response", refers, digest), WARC_Refers_To_Page_ID=refers)
                else:
                    own = _urn("response", page, digest) if shared else _urn("response", page, digest, n, part)
                    data = _record("response", http + payload, WARC_Record_ID=own, **common)
                data = _zipped(data)
                entry = {"url": url, "digest": f"sha1:{digest}", "filename": RECORDS.rpartition("/")[2], "offset": str(archive.at - archive.data), "length": str(len(data))}
                entries.append(index.compress(f"{url} {re.sub('[^0-9]', '', date)[:14]} {json.dumps(entry)}\n".encode()))
                n += 1
                yield _piece(archive.add(data))
        entries.append(index.flush())
        yield _piece(archive.end() + archive.begin(INDEX) + archive.add(b"".join(entries)) + archive.end() + archive.directory())

    return run


def _piece(data: bytes) -> pa.RecordBatch:
    """A row of the text writer, which ends each one by a zero byte of its own."""
    assert data[-1] == 0
    return pa.RecordBatch.from_arrays([pa.array([data[:-1]], pa.binary())], names=["value"])


def _copies(keyed: DataFrame) -> DataFrame:
    """(same, least, ties) of each payload that several rows have: its smallest page, and how many rows have that."""
    order = F.struct(F.col("page").isNull().alias("none"), "page", "n")
    by_page = keyed.where("same IS NOT NULL").groupBy("same", "page").agg(F.count("*").alias("n"))
    found = by_page.groupBy("same").agg(F.sum("n").alias("all"), F.min(order).alias("first")).where("all > 1")
    return written(found.select("same", F.col("first.page").alias("least"), F.col("first.n").alias("ties")), "copies")


def _judged(keyed: DataFrame) -> DataFrame:
    """The rows with again, whether one revisits another row, refers, the page of that, and shared, whether others have the payload."""
    copies = _copies(keyed)
    narrow = copies.withColumnRenamed("same", "as_")
    if copies.count() <= BROADCAST_ROWS:  # 50 bytes each
        marked = keyed.join(F.broadcast(narrow), F.col("same") == F.col("as_"), "left")
    else:  # only rows that may have a copy are shuffled
        hit = flagged(keyed, F.xxhash64("same"), copies.select(F.xxhash64("same").alias("h")), "may")
        alone = hit.where("NOT may").select("*", *[F.lit(None).cast(t).alias(c) for c, t in narrow.dtypes])
        marked = alone.unionByName(hit.where("may").join(narrow, F.col("same") == F.col("as_"), "left")).drop("may")
    first = F.col("page").eqNullSafe(F.col("least"))
    columns = ["page", "url", "payload"]
    out = marked.where(F.col("ties").isNull() | (F.col("ties") == 1) | ~first)
    out = out.select(*columns, F.col("least").alias("refers"), (F.col("as_").isNotNull() & ~first).alias("again"), F.col("as_").isNotNull().alias("shared"))
    if copies.where("ties > 1").isEmpty():
        return out
    # Rows that are equal in page and payload: the one written first is kept.
    tied = written(marked.where((F.col("ties") > 1) & first).select(*columns, "same", "least", F.monotonically_increasing_id().alias("row")), "tied")
    kept = tied.groupBy(F.col("same").alias("as_")).agg(F.min("row").alias("kept"))
    tied = tied.join(kept, F.col("same") == F.col("as_"))
    return out.unionByName(tied.select(*columns, F.col("least").alias("refers"), (F.col("row") != F.col("kept")).alias("again"), F.lit(True).alias("shared")))


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", smallest: int = 0, zip64: bool = False) -> None:
    """A record for each row in archives at folder, one archive a task.

    Rows with equal payloads of smallest bytes or more are one response, that of the smallest page_id (null comes last), and revisits, which
    hold no payload. Of rows that are equal in page_id, too, one is the response. A null html is an empty payload; a null url is replaced by a name made from page_id.
    An empty table gives archives without records. zip64: ZIP64 directories even where 32 bits would do. Other columns are not read. A
    record must fit an executor's memory, an archive need not: only the compressed index is held until it ends.
    """
    prepare(pages.sparkSession)
    payload = F.coalesce(F.col(html).cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(page_id).cast("bigint").alias("page"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("same", F.when(F.octet_length("payload") >= smallest, F.unhex(F.sha2("payload", 256))))
    judged = _judged(rows)
    pieces = judged.mapInArrow(_packer(datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), zip64), "value binary")
    pieces.select(F.col("value").cast("string").alias("value")).write.options(lineSep="\0", compression="none").text(folder)


# Reading


def opened(path: str) -> pa.NativeFile:
    """A file for range reads, by what executors have: local and shared folders, and the stores that Arrow knows."""
    from pyarrow import fs

    if path.startswith(("file:", "/")):
        return fs.LocalFileSystem().open_input_file(re.sub(r"^file:/*", "/", path))
    store, at = fs.FileSystem.from_uri(path)
    return store.open_input_file(at)


class Section(io.RawIOBase):
    """A stretch of an open file as a stream."""

    def __init__(self, file: pa.NativeFile, start: int, size: int) -> None:
        self.file, self.at, self.stop = file, start, start + size

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.file.read_at(max(0, min(len(buffer), self.stop - self.at)), self.at)
        buffer[: len(data)] = data
        self.at += len(data)
        return len(data)


def directory(file: pa.NativeFile) -> list[dict]:
    """(name, method, start, size, length) of an archive's members; start is where a member's data begin."""
    whole = file.size()
    tail = file.read_at(min(whole, END_BYTES + COMMENT_BYTES), max(0, whole - END_BYTES - COMMENT_BYTES))
    at = tail.rfind(END)
    while at >= 0 and (len(tail) < at + END_BYTES or struct.unpack_from("<H", tail, at + 20)[0] != len(tail) - at - END_BYTES):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no ZIP archive: it has no end record")
    n, size, start = struct.unpack_from("<HII", tail, at + 10)
    end = whole - len(tail) + at
    if FULL16 == n or FULL32 in (size, start):
        locator = file.read_at(20, end - 20) if end >= 20 else b""
        if locator.startswith(LOCATOR64):
            end = struct.unpack_from("<Q", locator, 8)[0]
            record = file.read_at(56, end)
            if not record.startswith(END64):
                raise ValueError("the ZIP64 locator names no end record")
            n, size, start = struct.unpack_from("<QQQ", record, 32)
    before = end - size - start  # bytes that stand before the archive itself
    data, at, out = file.read_at(size, start + before), 0, []
    for _ in range(n):
        if data[at : at + 4] != CENTRAL:
            raise ValueError("the central directory is damaged")
        method, packed, full = struct.unpack_from("<H8xII", data, at + 10)
        name, extra, comment = struct.unpack_from("<HHH", data, at + 28)
        offset = struct.unpack_from("<I", data, at + 42)[0]
        more, k = data[at + 46 + name : at + 46 + name + extra], 0
        while k + 4 <= len(more):
            tag, length = struct.unpack_from("<HH", more, k)
            if tag == 1:  # only what did not fit, in this order
                wide = list(struct.unpack_from(f"<{length // 8}Q", more, k + 4))
                full = wide.pop(0) if full == FULL32 else full
                packed = wide.pop(0) if packed == FULL32 else packed
                offset = wide.pop(0) if offset == FULL32 else offset
            k += 4 + length
        head = file.read_at(30, offset + before)
        if not head.startswith(LOCAL):
            raise ValueError("a member has no local header")
        begins = offset + before + 30 + sum(struct.unpack_from("<HH", head, 26))
        out.append({"name": data[at + 46 : at + 46 + name].decode("utf-8", "replace"), "method": method, "start": begins, "size": packed, "length": full})
        at += 46 + name + extra + comment
    return out


_MEMBERS = "name string, method int, start bigint, size bigint, length bigint"
_PLACES = pa.schema([("path", pa.string()), ("start", pa.int64()), ("size", pa.int64()), ("scan", pa.bool_()), ("offsets", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))])
_PLACES_SQL = "path string, start bigint, size bigint, scan boolean, offsets array<bigint>, lengths array<bigint>"


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length), without a look into the files."""
    return spark.read.format("binaryFile").load(folder).select("path", "length").where("length > 0")


def members(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, method, start, size, length) of the members of all archives at folder; method 0 is stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with opened(path) as file:
                    rows = [{"path": path} | m for m in directory(file)]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("name", pa.string()), ("method", pa.int32())] + [(c, pa.int64()) for c in ("start", "size", "length")]))

    return _files(spark, folder).select("path").mapInArrow(run, f"path string, {_MEMBERS}")


def _stream(file: pa.NativeFile, start: int, size: int) -> io.BufferedIOBase:
    """The content of a stored member, unpacked if it is compressed by itself."""
    raw = io.BufferedReader(Section(file, start, size), 1 << 20)
    return gzip.GzipFile(fileobj=raw) if raw.peek(2)[:2] == b"\x1f\x8b" else raw


def _indexed(file: pa.NativeFile, index: list[dict]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Offsets and lengths of records by member name, in order, each once."""
    places: dict[str, list[tuple[int, int]]] = {}
    for m in index:
        for line in io.BufferedReader(_stream(file, m["start"], m["size"])):
            brace = line.find(b"{")
            if brace >= 0:
                entry = json.loads(line[brace:])
                if {"filename", "offset", "length"} <= entry.keys():
                    places.setdefault(entry["filename"].rpartition("/")[2], []).append((int(entry["offset"]), int(entry["length"])))
    return {k: tuple(np.unique(np.array(v, np.int64), axis=0).T) for k, v in places.items()}


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records' places in ranges of RANGE_BYTES; a member without an index is one range to scan."""
    for batch in batches:
        for path in batch.column("path").to_pylist():
            rows: list[dict] = []
            with opened(path) as file:
                every = [m for m in directory(file) if m["name"].startswith(("archive/", "indexes/")) and not m["name"].endswith("/")]
                if deflated := [m["name"] for m in every if m["method"]]:
                    raise ValueError(f"{path}: only stored members can be read by ranges, not {deflated[0]}")
                places = _indexed(file, [m for m in every if m["name"].startswith("indexes/")])
            for m in every:
                if not m["name"].startswith("archive/"):
                    continue
                offsets, lengths = places.get(m["name"].rpartition("/")[2], ((), ()))
                if not len(offsets):
                    if m["size"]:
                        rows.append({"path": path, "start": m["start"], "size": m["size"], "scan": True, "offsets": [], "lengths": []})
                    continue
                k = 0
                while k < len(offsets):
                    to = max(k + 1, int(np.searchsorted(offsets, offsets[k] + RANGE_BYTES)))
                    end = int((offsets[k:to] + lengths[k:to]).max())
                    rows.append({"path": path, "start": m["start"] + int(offsets[k]), "size": end - int(offsets[k]), "scan": False, "offsets": (offsets[k:to] - offsets[k]).tolist(), "lengths": lengths[k:to].tolist()})
                    k = to
            yield pa.RecordBatch.from_pylist(rows, schema=_PLACES)


def _next_record(stream: io.BufferedIOBase) -> tuple[dict[str, str], bytes] | None:
    """(headers, block) of the record that begins here; null at the end. Names of headers are lower-cased."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError("no WARC record begins here")
    headers, last = {}, ""
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in " \t" and last:  # goes on
            headers[last] += " " + text.strip()
        else:
            last, _, value = text.partition(":")
            last = last.strip().lower()
            headers[last] = value.strip()
    block = stream.read(int(headers.get("content-length", 0)))
    return headers, block


def _parsed(headers: dict[str, str], block: bytes, content: bool) -> dict:
    """A row of records(): HTTP heads are taken off, and a response's payload is compared with its digest."""
    kind, payload, full = headers.get("warc-type"), block, None
    if headers.get("content-type", "").startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        if kind == "revisit" and (m := re.search(rb"(?im)^content-length:\s*(\d+)", head)):
            full = int(m[1])
    stated = headers.get("warc-payload-digest")
    digest = (stated or "").rpartition(":")[2]
    if kind != "revisit":
        full, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    intact = None if stated is None or not stated.startswith("sha1:") else kind == "revisit" or stated == f"sha1:{digest}"
    return {"record_type": kind, "record_id": headers.get("warc-record-id"), "target_uri": headers.get("warc-target-uri"), "headers": list(headers.items()), "payload_bytes": full, "payload_digest": digest or None, "intact": intact, "payload": payload if content else None}


_RECORDS = pa.schema(
    [("path", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("headers", pa.map_(pa.string(), pa.string()))]
    + [("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("intact", pa.bool_()), ("payload", pa.binary())]
)
_RECORDS_SQL = "path string, offset bigint, record_type string, record_id string, target_uri string, headers map<string, string>, payload_bytes bigint, payload_digest string, intact boolean, payload binary"


def _range_reader(content: bool):
    def rows_of(r: dict) -> Iterator[dict]:
        with opened(r["path"]) as file:
            if r["scan"]:
                stream = _stream(file, r["start"], r["size"])
                while record := _next_record(stream):
                    yield {"path": r["path"], "offset": None} | _parsed(*record, content)
                return
            data = file.read_at(r["size"], r["start"])
        for offset, length in zip(r["offsets"], r["lengths"]):
            own = data[offset : offset + length]
            record = _next_record(io.BytesIO(gzip.decompress(own) if own[:2] == b"\x1f\x8b" else own))
            if record:
                yield {"path": r["path"], "offset": r["start"] + offset} | _parsed(*record, content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                for row in rows_of(r):
                    held.append(row)
                    size += 500 + len(row["payload"] or b"")
                    if size >= RANGE_BYTES:
                        yield pa.RecordBatch.from_pylist(held, schema=_RECORDS)
                        held, size = [], 0
        yield pa.RecordBatch.from_pylist(held, schema=_RECORDS)

    return run


def records(spark: SparkSession, folder: str, content: bool = True) -> DataFrame:
    """The indexed records of all archives at folder, read by ranges.

    (path, offset, record_type, record_id, target_uri, headers, payload_bytes, payload_digest, intact, payload): offset is the record's place in the
    file (null where a member without an index was scanned), headers has lower-case names, payload_bytes and payload_digest are of the full payload,
    intact says whether it has the digest that the record states (null if it states none), payload is what the record holds (null unless content). Archives
    without records give none, as do empty files; files that are no ZIP archives, and deflated members, fail the job.
    """
    prepare(spark)
    files = _files(spark, folder)
    size = files.agg(F.sum("length")).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    places = files.select("path").mapInArrow(_locate, _PLACES_SQL).repartition(parts, "path", "start")
    return places.mapInArrow(_range_reader(content), _RECORDS_SQL)


def page_of(header: str) -> Column:
    """A page's number in the headers of records()."""
    return F.col("headers")[header].cast("bigint")
