"""Packing: concatenate and cut.

All documents' ids follow each other in one sequence, which is cut into windows of a fixed
length. The first pass tokenizes each partition, numbers its ids from 0 and totals them; a
prefix sum over the partitions' totals gives each partition's offset. The second pass adds
it and cuts; a document that crosses a window's end gets a record on both sides.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadspark.llm.common import bounded_batches, written

WINDOW, END = 2048, 1
VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Splitting of a byte-level BPE of this family, and texts for which both libraries' classes
#: of characters are tested to agree; others go to `tokenizers` itself.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OTHER = re.compile("[^\t\n\r\x20-\x7e\xa0-ɏ‐-‧]")


class Encoder:
    """Ids of a `tokenizers` byte-level BPE file.

    `tokenizers` takes some 0.28 CPU seconds for 1 MB of text, `tiktoken` over the same ranks
    0.07. A text of ordinary characters is encoded by the latter, if the file is a byte-level
    BPE whose ids are its ranks; all else by `tokenizers`, so also a text that holds the string
    of an added token, which is that token's id. Tests hold them equal."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.fast = self.added = None
        model = json.loads(self.slow.to_str())
        pre = model.get("pre_tokenizer") or {}
        if model.get("normalizer") is None and model["model"].get("type") == "BPE" and (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex")) == ("ByteLevel", False, True):
            import tiktoken

            shown = [b for b in range(256) if chr(b).isprintable() and b != 0x20 and b != 0xAD and not 0x7F <= b <= 0xA0]
            bytes_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*shown}))}
            special = {t["content"] for t in model.get("added_tokens", [])}
            self.added = re.compile("|".join(re.escape(t) for t in sorted(special))) if special else None
            ranks = {bytes(bytes_of[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
            self.fast = tiktoken.Encoding("local", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and not OTHER.search(text) and not (self.added and self.added.search(text)):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=())
            except ValueError:  # its regex gives up on white space about a million characters long
                pass
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One a worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _tokenize(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for b in batches:
            encode = encoder(path)
            ids = [np.append(encode(t or ""), np.uint32(end)) for t in b.column("text").to_pylist()]
            n = np.array([len(x) for x in ids], np.int64)
            starts = before + np.cumsum(n) - n
            before += int(n.sum())
            narrow = [x.astype("<u2") if x.max() < 65536 else x for x in ids]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.full(len(n), part, np.int64)), pa.array(starts), pa.array(n), pa.array([x.itemsize for x in narrow], pa.int32()), pa.array([x.tobytes() for x in narrow], pa.binary())],
                names=["doc_id", "part", "local", "doc_tokens", "width", "ids"],
            )

    return run


def _cut(base: dict[int, int], window: int, total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = total % window
        for b in batches:
            doc, start, length, crc, tokens, seq, offset, padded = ([] for _ in range(8))
            columns = (b.column(c).to_pylist() for c in ("doc_id", "part", "local", "doc_tokens", "width", "ids"))
            for d, part, local, n, width, raw in zip(*columns, strict=True):
                at, ids = base[part] + local, np.frombuffer(raw, f"<u{width}").astype("<u4")
                done = 0
                while done < n:
                    s, o = divmod(at + done, window)
                    k = min(n - done, window - o)
                    doc.append(d), start.append(done), length.append(k), tokens.append(n), seq.append(s), offset.append(o)
                    crc.append(zlib.crc32(ids[done : done + k].tobytes()))
                    alone = s == total // window and tail & (tail - 1) == 0  # the last one, a power of two long
                    padded.append(tail if alone else window)
                    done += k
            kinds = [b.schema.field("doc_id").type, *[pa.int64()] * 7]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip((doc, start, length, crc, tokens, seq, offset, padded), kinds, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length"])

    return run


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, end: int = END) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_length.

    A null or empty text is the end id alone. Rows with equal doc_id are documents each for
    itself; a null doc_id stays null. Only the last sequence needs padding. An empty table has
    no pieces. Which document follows which depends on how the table is split into tasks; the
    ids are stored with the partition they were numbered in, so lost tasks change nothing.
    The driver holds one number for each partition of the input.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    path = vocabulary or vocabulary_path()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    ids = written(docs.mapInArrow(_tokenize(path, end), "doc_id long, part long, local long, doc_tokens long, width int, ids binary"))
    base, total = {}, 0
    for r in sorted(ids.groupBy("part").agg(F.sum("doc_tokens").alias("n")).collect()):
        base[r["part"]] = total
        total += r["n"]
    return ids.mapInArrow(_cut(base, window, total), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long")
