"""SimHash near-dedup with pigeonring filtering.

Two 64-bit fingerprints that differ in at most t bits are cut into m segments in a ring. If
the differences of the segments sum to at most t, there is a segment from which every chain
of following segments stays within its proportional budget: l segments differ in at most
l * t / m bits together (the pigeonring principle). With t = 4 and m = 3 the chain's first
segment differs in at most 1 bit and its first two, 42 or 43 bits, in at most 2. So for each
of the three starts the two segments are indexed: fingerprints that differ there in at most
2 bits have a common neighbour at distance 1 or 0, and meet in its bucket. The chain's
budgets are checked there before the full Hamming distance.

Only distinct fingerprints are compared, and a bucket gives a spanning tree of each linked
group in it rather than all pairs. Components are then joined by the large-star small-star
algorithm, on tables.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadspark.llm.common import bounded_batches, discard, marked, row_key, small_side, written

SHINGLE_WORDS, DISTANCE, SEED = 4, 4, 42
#: Bits of the ring's segments, from the lowest.
SEGMENTS = (21, 21, 22)
#: Fingerprints whose distances are taken in one step.
PIECE = 1 << 14


def gram_hashes(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """64-bit hashes of the text's shingles, repeats included; none of a text without words."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # both know ASCII only
    if not w:
        return np.empty(0, "<u8")
    grams = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(g, SEED) for g in grams), "<u8")


def majority(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half of the hashes. Works through many piece by piece."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), PIECE):
        ones += np.unpackbits(hashes[i : i + PIECE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    return majority(gram_hashes(text, words))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        values = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
        kept = [n for n in b.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in kept), pa.array(values)], names=[*kept, "fp"])


def fingerprints(docs: DataFrame, keyed: bool = False) -> DataFrame:
    """(doc_id, fp): fp as a signed long. keyed: also _r1, _r2, by which a row is found again."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    rows = rows.select("*", *row_key(F.col("doc_id"), F.col("text"))) if keyed else rows
    return rows.mapInArrow(_fingerprints, ", ".join(f"{c} long" for c in rows.columns if c != "text") + ", fp long")


def ring(segments: tuple[int, ...] = SEGMENTS) -> list[tuple[int, int]]:
    """(lowest bit, bits) of each segment."""
    return [(sum(segments[:i]), n) for i, n in enumerate(segments)]


def chain_masks(start: int, segments: tuple[int, ...] = SEGMENTS) -> list[int]:
    """Masks of the chains of 1, 2, ... segments from start on."""
    places, masks, mask = ring(segments), [], 0
    for k in range(len(segments)):
        low, n = places[(start + k) % len(segments)]
        mask |= ((1 << n) - 1) << low
        masks.append(mask)
    return masks


def _neighbours(distance: int, segments: tuple[int, ...]):
    """For each start: the chain of two segments itself, and with each of its bits changed."""
    if 2 * distance // len(segments) > 2:
        raise ValueError("a bucket holds fingerprints that differ in 2 bits of two segments at most; take more segments")
    flips, masks = [], []
    for start in range(len(segments)):
        mask = chain_masks(start, segments)[1 % len(segments)]
        bits = [b for b in range(64) if mask >> b & 1]
        flips.append(np.array([0, *[1 << b for b in bits]], np.uint64))
        masks.append(np.uint64(mask))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for start, (flip, mask) in enumerate(zip(flips, masks, strict=True)):
                keys = ((fp & mask)[:, None] ^ flip[None, :]).ravel()
                # which start it is goes where the chain has no bits: other starts' keys then differ
                yield pa.RecordBatch.from_arrays([pa.array(_tagged(keys, start, int(mask)).view(np.int64)), pa.array(np.repeat(fp, len(flip)).view(np.int64))], names=["key", "fp"])

    return run


def _tagged(keys: np.ndarray, start: int, mask: int) -> np.ndarray:
    free = [b for b in range(64) if not mask >> b & 1][:2]
    tag = sum(1 << b for i, b in enumerate(free) if (start + 1) >> i & 1)
    return keys | np.uint64(tag)


def viable(x: np.ndarray, distance: int, segments: tuple[int, ...]) -> np.ndarray:
    """Which differences have a chain that stays within its budget at every length; the whole
    ring, which is the full Hamming check, is the last."""
    out = np.zeros(len(x), bool)
    for start in range(len(segments)):
        ok = np.ones(len(x), bool)
        for k, mask in enumerate(chain_masks(start, segments)):
            ok[ok] = np.bitwise_count(x[ok] & np.uint64(mask)) <= (k + 1) * distance // len(segments)
        out |= ok
    return out


def linked(fps: np.ndarray, distance: int, segments: tuple[int, ...] = SEGMENTS) -> list[tuple[int, int]]:
    """Edges that join all those of some distinct fingerprints that are linked among each other:
    each is reached once, from the first in its group, breadth first."""
    left, queue, edges = fps, [], []
    while len(left):
        if not queue:
            queue, left = [left[0]], left[1:]
        at = queue.pop()
        near = np.concatenate([np.zeros(0, bool), *(viable(left[i : i + PIECE] ^ at, distance, segments) for i in range(0, len(left), PIECE))])
        found = left[near]
        edges += [(int(at), f) for f in found.tolist()]
        queue += list(found)
        left = left[~near]
    return edges


def _meet(distance: int, segments: tuple[int, ...]):
    """Reads (key, fp) sorted by key, gives the edges of each bucket, each edge once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # of the last bucket, which may go on
        seen: set[tuple[int, int]] = set()

        def edges(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal seen
            same = np.flatnonzero(keys[1:] == keys[:-1])
            if not len(same):
                return
            gaps = np.diff(same) > 1
            firsts, lasts = same[np.r_[True, gaps]], same[np.r_[gaps, True]] + 2
            two = firsts[lasts - firsts == 2]
            two = two[viable(fps[two] ^ fps[two + 1], distance, segments)]
            out = set(zip(fps[two].tolist(), fps[two + 1].tolist(), strict=True))
            more = lasts - firsts > 2
            for i, j in zip(firsts[more].tolist(), lasts[more].tolist(), strict=True):
                out.update(linked(fps[i:j], distance, segments))
            out = {(min(e), max(e)) for e in out} - seen
            if len(seen) > 500_000:  # forgetting edges only repeats them
                seen = set()
            seen |= out
            if out:
                pairs = np.array(sorted(out), np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                yield from edges(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            k, f = batch.column("key").to_numpy(zero_copy_only=False), batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            cut = int(np.searchsorted(k, k[-1]))
            if cut or not held or held[-1][0][-1] != k[0]:
                if held and cut and held[-1][0][-1] == k[0]:  # the bucket ends in this batch
                    own = int(np.searchsorted(k, k[0], "right"))
                    held.append((k[:own], f[:own]))
                    k, f, cut = k[own:], f[own:], cut - own
                yield from flush()
                yield from edges(k[:cut], f[:cut])
            held.append((k[cut:], f[cut:]))
        yield from flush()

    return run


def links(fps: DataFrame, distance: int = DISTANCE, segments: tuple[int, ...] = SEGMENTS) -> DataFrame:
    """(a, b): links between distinct fingerprints fp, enough of them to join whatever is linked."""
    bounded_batches(fps.sparkSession)
    keys = fps.mapInArrow(_neighbours(distance, segments), "key long, fp long")
    spread = keys.repartition(F.col("key")).sortWithinPartitions("key")
    return spread.mapInArrow(_meet(distance, segments), "a long, b long").distinct()


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, root): for each node of the edges (a, b) the smallest node reachable. Alternates
    the large and the small star until nothing changes; each round is a table in the shared
    folder, and so is each round's smaller join side: a node of very many edges is no hot task."""

    def state(x: DataFrame) -> tuple:
        return tuple(x.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())

    at = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    was = state(at)
    for _ in range(most_rounds):
        # large star: a node's larger neighbours are joined to its smallest one
        both = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = written(at.select(F.col("v").alias("w"), F.col("u").alias("x")).join(small_side(least), F.col("w") == F.col("u")).select(F.col("x").alias("u"), F.col("m").alias("v")).distinct())
        # small star: a node and its smaller neighbours are joined to the smallest of them
        least = written(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(small_side(least), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        at = written(small)
        now = state(at)
        if now == was:
            return at.select(F.col("u").alias("node"), F.col("v").alias("root"))
        was = now
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, keyed: bool = False) -> DataFrame:
    """Per row of docs: doc_id, fp, component_id (smallest doc_id of its component), root (and
    with keyed _r1, _r2).

    A null text, or one without words, has fingerprint 0 and is linked like any other. Null
    ids don't count as smallest; a component of null ids alone has component_id null.
    Repeated rows give repeated results, an empty table none; other columns are not looked at."""
    prints = written(fingerprints(docs, keyed))
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    joined = written(components(links(distinct.select("fp"), distance)))
    rooted = distinct.join(joined, distinct["fp"] == joined["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    firsts = written(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    named = written(rooted.join(firsts, "root").select(F.col("fp").alias("of"), "component_id", "root"))
    return prints.join(named, prints["fp"] == named["of"]).select(*prints.columns, "component_id", "root")


def near_duplicates_digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup_stage(docs: DataFrame) -> DataFrame:
    """docs without all but one of each group that is joined by pairs of Jaccard similarity 0.8 or
    more over five-word shingles: the smallest doc_id stays (nulls last; of rows with that id one
    by content; of rows equal in id and text any one). Pairs are proposed by fingerprints of five-word
    shingles within DISTANCE bits, found by the pigeonring, and checked by their shingles; what is as
    similar but farther apart in bits is found by a second search (quadspark.llm.jaccard). Only rows
    that a bitmap of those that go has are joined; the others' texts aren't shuffled."""
    from quadspark.llm import jaccard

    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_r1", "_r2")).alias("best")
    found = written(jaccard.near_duplicates(docs))
    keep = written(found.groupBy("root").agg(best).select("best._r1", "best._r2"))
    times = found.groupBy("_r1", "_r2").agg(F.count(F.lit(1)).alias("n")).join(small_side(keep.withColumn("kept", F.lit(True))), ["_r1", "_r2"], "left")
    goes = written(times.where("kept IS NULL OR n > 1").select("_r1"))  # or is there more than once
    discard(found)
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), *row_key(F.col("doc_id").cast("long"), F.col("text")))
    rows = marked(rows, goes, "_r1")
    rest = rows.where("marked").join(small_side(keep), ["_r1", "_r2"], "left_semi").dropDuplicates(["_r1", "_r2"])
    return rows.where("NOT marked").select("row.*").unionByName(rest.select("row.*"))
