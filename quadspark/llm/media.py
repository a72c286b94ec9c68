"""Media columns with content-defined payload chunking.

A payload is stored losslessly as a WAV file of 8-bit mono samples. The samples are cut where a
rolling gear hash of their bytes says so, so that shared passages give equal chunks wherever they
stand; the file's header, which holds its length, is kept beside the ordered chunk list. Chunk
digests are deduplicated by Spark: a chunk that several files may share is stored once in a chunk
table, others stay beside the file's list. Texts are chunked again for each of these rather than
stored whole in between. Reading back joins the lists with the chunk table, puts the
chunks together in order, and verifies them.

Which chunks may be shared is told by a bitmap of the digests that occur more than once. Its
size follows their number, up to a limit; where it is too small for the corpus, more chunks go to
the chunk table (and are found there), none is lost.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadspark.llm.common import bounded_batches, small_side, written

RATE, BLOCK = 8000, 64
#: Chunk sizes; a cut is likely every 2 ** CUT_BITS bytes after the least.
LEAST, MOST, CUT_BITS = 256, 4096, 10
#: Bits of the map of repeated digests: 64 for each, from 4 KB to 64 MB (broadcast).
MAP_BITS, MOST_MAP_BITS, BITS_EACH = 15, 29, 64
HEADER = 44


def _gear() -> np.ndarray:
    """256 fixed numbers, from a rule."""
    return np.array([int.from_bytes(hashlib.sha256(b"gear %d" % i).digest()[:4], "little") for i in range(256)], np.uint32)


GEAR = _gear()


def payload(text: bytes) -> bytes:
    """Zeros make it a positive multiple of the block."""
    return text + bytes(-len(text) % BLOCK or (0 if text else BLOCK))


def to_wav(data: bytes) -> bytes:
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(data)) + data


def from_wav(media: bytes) -> bytes:
    """The samples of a file made by to_wav; ValueError if it isn't one, or isn't whole."""
    if len(media) < HEADER or media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt " or media[36:40] != b"data":
        raise ValueError("no WAV file")
    channels, rate, _, _, bits = struct.unpack("<HIIHH", media[22:36])
    (n,) = struct.unpack("<I", media[40:44])
    if (channels, rate, bits) != (1, RATE, 8) or n != len(media) - HEADER:
        raise ValueError("not the samples that were stored")
    return media[HEADER:]


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks. The gear hash h = 2 h + GEAR[byte] (32 bits) is taken for all
    positions at once: by doubling, from windows of 1, 2, ... 32 bytes."""
    n = len(data)
    h = GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16):
        if k < n:
            shifted = h[:-k] << np.uint32(k)
            h = h.copy()
            h[k:] += shifted
    at = np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1
    ends, start = [], 0
    while n - start > LEAST:
        i = int(np.searchsorted(at, start + LEAST))
        end = min(int(at[i]) if i < len(at) else n, start + MOST, n)
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def chunks(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=20).digest()


def features(samples: bytes) -> str:
    """Figures of the signal: mean, root mean square, zero crossings, peak, and the shares (per
    mille) of 8 bands of values. From whole numbers, so the same wherever it is computed."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    n = len(x)
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    bands = np.bincount(np.frombuffer(samples, np.uint8) >> 5, minlength=8) * 1000 // n
    return f"mean={int(x.sum()) * 1000 // n};rms={int(np.sqrt(int((x * x).sum()) * 1_000_000 // n))};crossings={crossings};peak={int(np.abs(x).max())};bands={'/'.join(map(str, bands.tolist()))}"


PART = "array<struct<digest:binary,data:binary>>"
_PART = pa.list_(pa.struct([("digest", pa.binary()), ("data", pa.binary())]))


def _chunked(b: pa.RecordBatch) -> Iterator[tuple[bytes, bytes, list[tuple[bytes, bytes]]]]:
    """(text, file, ordered chunks with their digests) of each row; equal texts of a batch are cut once."""
    seen: dict[bytes, tuple] = {}
    for t in b.column("data").to_pylist():
        if t not in seen:
            media = to_wav(payload(t))
            seen[t] = (t, media, [(_digest(c), c) for c in chunks(media[HEADER:])])
        yield seen[t]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([d for *_, parts in _chunked(b) for d, _ in parts], pa.binary())], names=["digest"])


FILES = f"doc_id long, n_bytes long, media_bytes long, media_sha256 string, header binary, refs long, parts {PART}"


def _repeated_map(spark: SparkSession, digests: DataFrame):
    """(bits, broadcast bitmap) of the digests that occur more than once. Spark makes it, in pieces
    of 4 KB; the driver gets its size at most."""
    repeated = written(digests.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest"))
    bits = min(MOST_MAP_BITS, max(MAP_BITS, (BITS_EACH * repeated.count()).bit_length()))
    place = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    at = repeated.select((place % (1 << bits)).alias("bit")).select(F.bitmap_bucket_number("bit").alias("bucket"), F.bitmap_bit_position("bit").alias("at"))
    pieces = at.groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits")).collect()
    return spark.sparkContext.broadcast((bits, {r["bucket"]: bytes(r["bits"]) for r in pieces}))


def _may_repeat(known: tuple[int, dict[int, bytes]], digest: bytes) -> bool:
    bits, pieces = known
    bit = int.from_bytes(digest[:4], "big") % (1 << bits)
    bucket, at = (1 + (bit - 1) // 32768, (bit - 1) % 32768) if bit else (0, 0)  # as Spark numbers them
    piece = pieces.get(bucket)
    return piece is not None and bool(piece[at // 8] >> (at % 8) & 1)


def _shared(pieces):
    """The chunks that may be shared: digest, data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces.value
        for b in batches:
            found = {d: c for *_, parts in _chunked(b) for d, c in parts if _may_repeat(known, d)}
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], names=["digest", "data"])

    return run


def _referring(pieces):
    """The files with their header and ordered chunks, without the bytes of those that may be shared;
    refs counts these. Tables compress chunks together, which takes less room than each by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces.value
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("n_bytes", "media_bytes", "media_sha256", "header", "refs", "parts")}
            for t, media, parts in _chunked(b):
                own = [{"digest": d, "data": None if _may_repeat(known, d) else c} for d, c in parts]
                for k, v in zip(out, (len(t), len(media), hashlib.sha256(media).hexdigest(), media[:HEADER], sum(p["data"] is None for p in own), own), strict=True):
                    out[k].append(v)
            arrays = [b.column("doc_id"), *(pa.array(v, t) for v, t in zip(out.values(), (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64(), _PART), strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *out])

    return run


def _read_back(keep: list[str]):
    """Puts each file's header and chunks together, verifies chunks and file, and computes the features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sha, crc, feats, length = [], [], [], []
            for want, header, parts in zip(*(b.column(c).to_pylist() for c in ("media_sha256", "header", "parts")), strict=True):
                found = [header]
                for p in parts:
                    c = p["data"] if p["data"] is not None else b""
                    if _digest(c) != p["digest"]:
                        raise ValueError(f"a chunk of media {want} is missing or damaged")
                    found.append(c)
                media = b"".join(found)
                if hashlib.sha256(media).hexdigest() != want:
                    raise ValueError(f"media {want} isn't what was stored")
                samples = from_wav(media)
                sha.append(hashlib.sha256(samples).hexdigest()), crc.append(zlib.crc32(samples[-BLOCK:])), feats.append(features(samples)), length.append(len(samples))
            arrays = [*(b.column(k) for k in keep), pa.array(length, pa.int64()), pa.array(sha), pa.array(crc, pa.int64()), pa.array(feats)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "payload_bytes", "payload_sha256", "tail_crc32", "feature"])

    return run


READ = "payload_bytes long, payload_sha256 string, tail_crc32 long, feature string"


def store(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, chunk table), written. files: doc_id, n_bytes, media_bytes, media_sha256, header,
    refs (how many of its chunks are in the chunk table), parts (its ordered chunk list).

    docs are read and chunked three times, for the digests, the chunk table and the files: that takes
    less than a table of all chunks, which would stand beside the two and hold as much."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    pieces = _repeated_map(spark, rows.mapInArrow(_digests, "digest binary"))
    table = written(rows.mapInArrow(_shared(pieces), "digest binary, data binary").dropDuplicates(["digest"]))
    files = written(rows.mapInArrow(_referring(pieces), FILES))
    return files, table


def media_features(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature; all but n_bytes and media_* come from the bytes read back.

    A null text is an empty one (64 zero bytes). Very long texts are chunked whole. Equal texts
    share their chunks; a file is put together once, however many documents have it. Repeated
    rows give repeated results, an empty table none; other columns are not looked at."""
    files, table = store(docs)
    keep = ["doc_id", "n_bytes", "media_bytes", "media_sha256"]
    types = "doc_id long, n_bytes long, media_bytes long, media_sha256 string"
    alone = files.where("refs = 0").select(*keep, "header", "parts").mapInArrow(_read_back(keep), f"{types}, {READ}")
    some = files.where("refs > 0")
    distinct = written(some.select("media_sha256", "header", "parts").dropDuplicates(["media_sha256"]))
    parts = distinct.select("media_sha256", F.posexplode("parts").alias("at", "part")).select("media_sha256", "at", F.col("part.digest").alias("digest"), F.col("part.data").alias("own"))
    fetched = parts.where("own IS NULL").drop("own").join(table, "digest").select("media_sha256", "at", "digest", "data")
    whole = parts.where("own IS NOT NULL").select("media_sha256", "at", "digest", F.col("own").alias("data")).unionByName(fetched)
    listed = whole.groupBy("media_sha256").agg(F.sort_array(F.collect_list(F.struct("at", "digest", "data"))).alias("p"))  # the chunks of one file
    listed = listed.select("media_sha256", F.transform("p", lambda x: F.struct(x["digest"].alias("digest"), x["data"].alias("data"))).alias("parts"))
    listed = listed.join(distinct.select("media_sha256", "header"), "media_sha256")
    read = written(listed.mapInArrow(_read_back(["media_sha256"]), f"media_sha256 string, {READ}"))
    shared = some.select(*keep).join(small_side(read, 20_000), "media_sha256")
    columns = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return alone.select(*columns).unionByName(shared.select(*columns))
