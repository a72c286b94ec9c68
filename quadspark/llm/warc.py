"""WARC archives: a writer, and a salvage reader.

The reader checks each record: the gzip member (if there is one) is whole, the version line
and header are in order, the length is the one announced, the digests are right. After a
failed check it searches for the next member or version line that passes, goes on from there,
and logs the bytes between as a gap. Archives are read in ranges by many tasks; a record
belongs to the range in which it starts.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadspark.llm.common import bounded_batches, shared_dir, small_side, written

#: Bytes after which a writer starts another archive; bytes of a range that one task reads.
ROLL, RANGE = 64 << 20, 4 << 20
BLOCK = 256 << 10
#: Tasks that the ranges are dealt to, at most; each reads its ranges one after the other.
MOST_TASKS = 50_000
VERSION = re.compile(rb"WARC/\d\.\d\r\n")
DATE = "2000-01-01T00:00:00Z"
PAGE = "<urn:quadspark:page:{}>"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _clean(value: str) -> str:
    """A header's value: no line ends or other control characters, which would end it early."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value).strip() or "urn:unknown"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [*headers, ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 4) -> bytes:
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, original: int | None, revisit: bool) -> bytes:
    """A response with the payload, or a revisit of the page `original`, without it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    name = lambda i: PAGE.format("" if i is None else i)
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", _clean(url or "")), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}")]
    if revisit:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", name(original))]
    return record(headers, http if revisit else http + payload)


class Damaged(ValueError):
    pass


@dataclass
class Record:
    start: int
    end: int
    headers: dict[str, str]
    block: bytes
    nth: int = 0  # in its gzip member
    lost: str | None = None  # why bytes of its member belong to no record

    def payload(self) -> bytes:
        """Of an HTTP block: what follows its header."""
        if "application/http" not in self.headers.get("content-type", ""):
            return self.block
        _, sep, body = self.block.partition(b"\r\n\r\n")
        return body if sep else b""


def parse(data: bytes) -> tuple[dict[str, str], bytes, int]:
    """Header, block and length of the record at the start of data; Damaged if a check fails."""
    if not VERSION.match(data):
        raise Damaged("no version line")
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise Damaged("header not ended")
    if VERSION.search(data, 1, end + 2):
        raise Damaged("another version line in the header")  # a cut-off header runs into the next record's
    headers = {}
    for line in data[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, sep, value = line.partition(":")
        if not sep:
            raise Damaged("header line without a name")
        headers[name.strip().lower()] = value.strip()
    if not re.fullmatch(r"\d{1,15}", headers.get("content-length", "")):
        raise Damaged("no length")
    n = int(headers["content-length"])
    block, tail = data[end + 4 : end + 4 + n], data[end + 4 + n : end + 8 + n]
    if len(block) < n or tail != b"\r\n\r\n":
        raise Damaged("not of the length announced")
    for name, value in (("warc-block-digest", block), ("warc-payload-digest", Record(0, 0, headers, block).payload())):
        kind, _, digest = headers.get(name, "").partition(":")
        if kind == "sha1" and not (name == "warc-payload-digest" and headers.get("warc-type") == "revisit") and digest.upper() != sha1_base32(value):
            raise Damaged(f"{name} differs")
    return headers, block, end + 8 + n


class Archive:
    """Bytes of a seekable file by place, some blocks held."""

    def __init__(self, file, size: int) -> None:
        self.file, self.size, self.at, self.held = file, size, 0, b""

    def read(self, at: int, n: int) -> bytes:
        if not self.at <= at <= at + n <= self.at + len(self.held):
            self.file.seek(at)
            self.at, self.held = at, self.file.read(max(n, BLOCK))
        return self.held[at - self.at : at - self.at + n]

    def member(self, at: int) -> tuple[bytes, int]:
        """What the gzip member at a place holds, and its end."""
        unpack, out, p = zlib.decompressobj(31), [], at
        while not unpack.eof:
            piece = self.read(p, min(BLOCK, self.size - p)) if p < self.size else b""
            if not piece:
                raise Damaged("member not ended")
            try:
                out.append(unpack.decompress(piece))
            except zlib.error as e:
                raise Damaged(f"member: {e}") from None
            p += len(piece)
        return b"".join(out), p - len(unpack.unused_data)

    def records(self, at: int) -> list[Record]:
        """The record at a place, or those of the member there: most have one, but if a check fails
        in it, or more follows, it is searched for version lines as a plain archive is. All of a
        member's records bear its place."""
        if self.read(at, 2) == b"\x1f\x8b":
            data, end = self.member(at)
            try:
                headers, block, n = parse(data)
                if n == len(data):
                    return [Record(at, end, headers, block)]
            except Damaged as e:
                reason = str(e)
            else:
                reason = "bytes after a record"
            inner = Archive(io.BytesIO(data), len(data))
            found = [x for x in salvage(inner) if isinstance(x, Record)]
            if not found:
                raise Damaged(reason)
            whole = sum(x.end - x.start for x in found) == len(data)
            return [Record(at, end, x.headers, x.block, i, None if whole else f"in the member: {reason}") for i, x in enumerate(found)]
        head = self.read(at, self.header(at))
        length = re.search(rb"\r\ncontent-length:[ \t]*(\d{1,15})", head[:-2], re.I)
        want = len(head) + 4 + int(length[1]) if length else len(head)
        if want > self.size - at:
            raise Damaged("not of the length announced")
        headers, block, n = parse(head if want <= len(head) else self.read(at, want))
        return [Record(at, at + n, headers, block)]

    def header(self, at: int) -> int:
        """Length of the header at a place, however long. Looks no further than the next version line."""
        if not VERSION.match(self.read(at, min(10, self.size - at))):
            raise Damaged("no version line")
        p = at + 1
        while p < self.size:
            piece = self.read(p, min(BLOCK, self.size - p))
            end, other = piece.find(b"\r\n\r\n"), VERSION.search(piece)
            if other and (end < 0 or other.start() < end):
                raise Damaged("another version line in the header")
            if end >= 0:
                return p + end + 4 - at
            if p + len(piece) >= self.size:
                break
            p += max(1, len(piece) - 16)  # either may cross the end of the piece
        raise Damaged("header not ended")

    def search(self, at: int, stop: int) -> int:
        """The next place before stop that looks like a member or a version line; stop if there is none."""
        while at < stop:
            piece = self.read(at, min(BLOCK, self.size - at))
            if m := re.search(rb"\x1f\x8b\x08|WARC/\d\.\d\r\n", piece):
                return min(at + m.start(), stop)
            if at + len(piece) >= self.size:
                break
            at += max(1, len(piece) - 16)  # one may cross the end of the piece
        return stop


def salvage(archive: Archive, start: int = 0, stop: int | None = None) -> Iterator[Record | tuple[int, int, str]]:
    """Records that start in [start, stop), and (start, end, reason) of what was skipped there.
    A range that doesn't begin the file begins with a search."""
    stop = archive.size if stop is None else min(stop, archive.size)
    at, gap, reason = start, None, ""
    if start:
        at, gap, reason = archive.search(start, stop), start, "start of a range"
    while at < stop:
        try:
            found = archive.records(at)
        except Damaged as e:
            if gap is None or reason == "start of a range":
                gap, reason = at if gap is None else gap, str(e)
            at = archive.search(at + 1, stop)
            continue
        if gap is not None and gap < at:
            yield gap, at, reason
        gap = None
        yield from found
        if found[0].lost:  # the bytes themselves can't be told apart: the member is both read and logged
            yield at, found[0].end, found[0].lost
        at = found[0].end
    if gap is not None and gap < stop:
        yield gap, stop, reason


def _open(uri: str):
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    return fs, path


def _write(folder: str, roll: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, base = _open(folder)
        state = {"n": 0, "file": None, "size": 0, "records": 0}
        done: list[tuple[str, int, int]] = []

        def close() -> None:
            if state["file"] is not None:
                state["file"].close()
                done.append((f"{folder}/{state['name']}", state["size"], state["records"]))
                state.update(n=state["n"] + 1, file=None, size=0, records=0)

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "original", "revisit")), strict=True):
                if state["file"] is None:
                    # of one attempt alone: rows may come in another order when a task runs again
                    state["name"] = f"part-{task.partitionId():06d}-{task.stageId()}-{task.taskAttemptId()}-{state['n']:05d}.warc.gz"
                    state["file"] = fs.open_output_stream(f"{base}/{state['name']}", compression=None)  # members are packed already
                data = member(page_record(*row))
                state["file"].write(data)
                state["size"] += len(data)
                state["records"] += 1
                if state["size"] >= roll:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], names=["path", "size", "records"])

    return run


def write_pages(pages: DataFrame, least: int = 0, roll: int = ROLL, folder: str | None = None) -> DataFrame:
    """Writes a record for each row, and returns the manifest of the archives: path, size, records.
    A task's files bear its attempt's number, and only those of attempts that Spark commits are in
    the manifest; what other attempts left is never read.

    Of rows with equal payloads of at least `least` bytes, those with the largest page_id are
    responses and others revisits; shorter ones are all responses. A null html is an empty
    payload; a null page_id is smaller than any other; rows that share the largest page_id are
    all responses. Only digests that several rows have are joined to the rows, and broadcast if
    they are few."""
    spark = pages.sparkSession
    bounded_batches(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    digest = F.when(F.length("payload") >= least, F.sha1("payload"))
    rows = rows.withColumn("digest", digest)
    repeated = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("original")).where("n > 1 AND digest IS NOT NULL")
    repeated = written(repeated.select(F.col("digest").alias("of"), "original", F.lit(True).alias("again")))
    rows = rows.join(small_side(repeated), rows["digest"] == repeated["of"], "left")
    revisit = F.coalesce("again", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("original"))
    folder = folder or shared_dir(spark)
    fs, base = _open(folder)
    fs.create_dir(base)
    return written(rows.select("page_id", "url", "payload", "original", revisit.alias("revisit")).mapInArrow(_write(folder, roll), "path string, size long, records long"))


FIELDS = "path string, start long, stop long, nth int, gap string, record_type string, record_id string, target_uri string, payload_digest string, payload_bytes long, refers_to string, payload binary"


def _read(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, size, low, high in zip(*(b.column(c).to_pylist() for c in ("path", "size", "low", "high")), strict=True):
                fs, name = _open(path)
                rows: list[tuple] = []
                held = 0
                with fs.open_input_file(name) as file:
                    for x in salvage(Archive(file, size), low, high):
                        if isinstance(x, tuple):
                            rows.append((path, x[0], x[1], None, x[2], *[None] * 7))
                            continue
                        h, body = x.headers, x.payload()
                        digest = h.get("warc-payload-digest", "").rpartition(":")[2].upper() if h.get("warc-type") == "revisit" else sha1_base32(body)
                        rows.append((path, x.start, x.end, x.nth, None, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-target-uri"), digest, len(body), h.get("warc-refers-to"), body if with_payload else None))
                        held += len(body) * with_payload + 500
                        if held > 8 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return run


_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    fields = [f.split() for f in FIELDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, _KINDS[t]) for v, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def read_archives(archives: DataFrame, with_payload: bool = True, range_bytes: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """(records, gaps) of archives (path, size). records: path, start, stop, nth (in a gzip member
    of several), record_type, record_id, target_uri, payload_digest, payload_bytes, refers_to,
    payload. gaps: path, start, stop, reason: the quarantined bytes that no record covers, and
    members of which only a part could be read.

    A range may begin inside a record that itself holds archive bytes; what starts inside a
    record that an earlier range has found is no record."""
    bounded_batches(archives.sparkSession)
    ranges = archives.select("path", "size", F.explode(F.sequence(F.lit(0), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(range_bytes))).alias("low")).where("size > 0")
    ranges = ranges.select("path", "size", "low", F.least(F.col("low") + range_bytes, F.col("size")).alias("high"))
    found = written(ranges.repartition(max(1, min(MOST_TASKS, ranges.count())), "path", "low").mapInArrow(_read(with_payload), FIELDS))
    before = F.coalesce(F.max("stop").over(Window.partitionBy("path").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = found.where("gap IS NULL AND nth = 0").select("path", "start", "stop").withColumn("before", before)
    nested = written(places.where("start < before").select("path", "start"))
    records = found.where("gap IS NULL").join(small_side(nested), ["path", "start"], "left_anti").drop("gap")
    # gaps: between records, and after the last one
    ends = archives.where("size > 0").select("path", F.col("size").alias("start"), F.col("size").alias("stop"))
    gaps = places.where("start >= before").select("path", "start", "stop").unionByName(ends).withColumn("before", before).where("start > before").select("path", F.col("before").alias("start"), F.col("start").alias("stop"))
    logged = found.where("gap IS NOT NULL")
    reasons = logged.groupBy("path", "start").agg(F.min("gap").alias("reason"))
    parts = logged.where("gap LIKE 'in the member: %'").join(small_side(nested), ["path", "start"], "left_anti").select("path", "start", "stop", F.col("gap").alias("reason"))
    return records, gaps.join(reasons, ["path", "start"], "left").unionByName(parts)


def page_number(uri: str) -> Column:
    return F.expr(f"try_cast(regexp_extract({uri}, '^<urn:quadspark:page:(-?[0-9]+)>$', 1) AS BIGINT)")


def archive_pages(pages: DataFrame) -> DataFrame:
    """Writes the pages to archives, reads them back: page_id, payload_bytes, payload_digest,
    record_type, refers_to. A revisit's payload is that of the response it refers to, found by
    its digest. What was written is counted against what is read: a difference is an error, with
    the first gaps. Pages and addresses of any length are records like others. An empty table
    gives an empty result; repeated rows are repeated records."""
    archives = write_pages(pages)
    records, gaps = read_archives(archives, with_payload=False)
    wrote, read = archives.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0], records.count()
    if wrote != read:  # nothing is lost silently
        raise ValueError(f"{wrote} records written, {read} read; gaps: {gaps.take(5)}")
    records = records.select(page_number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_number("refers_to").alias("refers_to"))
    revisits = records.where("record_type = 'revisit'")
    originals = written(records.where("record_type = 'response'").join(revisits.select("payload_digest").distinct(), "payload_digest", "left_semi").groupBy(F.col("payload_digest").alias("of")).agg(F.max("payload_bytes").alias("full")))
    found = revisits.drop("payload_bytes").join(small_side(originals), F.col("payload_digest") == F.col("of"), "left").withColumnRenamed("full", "payload_bytes")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return records.where("record_type = 'response'").select(*columns).unionByName(found.select(*columns))


ARCHIVE_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
w AS (SELECT h, max(page_id) AS original FROM p GROUP BY h)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(p.h, (10 * (i // 8) + 1)::INT, 10))::BIGINT >> (35 - 5 * (i % 8))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = original THEN NULL ELSE original END AS refers_to
FROM p JOIN w ON p.h = w.h
"""
