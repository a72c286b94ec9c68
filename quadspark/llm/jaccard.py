"""Near duplicates by word shingles: groups joined by all pairs of texts whose sets of five-word
shingles have a Jaccard similarity of 0.8 or more, none left out and none too many.

Candidates come first from the SimHash index (quadspark.llm.simhash) over fingerprints of
five-word shingles. At 0.8 two fingerprints of 64 bits differ in some 10 bits, more than any index
can search at once, so that a second search finds the rest.

That is prefix filtering: with shingles in one global order, two such sets share one of the first
n - ceil(0.8 n) + 1 of each. Sets meet in the buckets of these; pairs that can't be similar if
what they meet by is the first they share are dropped there. The others' bitmaps, of which each
shingle turns one bit over, differ in no more bits than the sets in shingles: most pairs go by that
without a look at their texts, and the rest are compared whole.
Shingles that are frequent in a sample come last in the order, the most frequent at its end, so
that few of them are in a prefix; the sample changes what is compared, not what is found.

Three rounds: the first checks SimHash's pairs, and compares each set of a bucket with the first
of its sizes, the second with the last one; only the third takes all pairs, and of these only
those that nothing has joined by then. A large group of near copies is then no square of pairs.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadspark.llm.common import bounded_batches, discard, row_key, small_side, written
from quadspark.llm.simhash import DISTANCE, SEED, components, gram_hashes, links, majority

WORDS = 5
#: Rows sampled for frequent shingles, how often one is then frequent, and how many are kept at most.
SAMPLE_ROWS, FREQUENT, MOST_FREQUENT = 10_000, 3, 100_000
#: Shingles of a set, besides the frequent ones, that the first rounds look at.
FIRST = 2
#: Bits of a set's bitmap at least; larger sets have as many as shingles, or up to twice that.
BITS = 1024
#: Pairs handed on at once.
PIECE = 1 << 16


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the text's shingles; of fewer than five words the text
    is one shingle, without words an empty one."""
    return _set(gram_hashes(text, WORDS))


def _set(hashes: np.ndarray) -> np.ndarray:
    return np.unique(hashes >> np.uint64(1)) if len(hashes) else np.array([xxhash.xxh64_intdigest(b"", SEED) >> 1], np.uint64)


def prefix(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard similarity of 0.8 or more, in whole numbers."""
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b))


def bitmap(s: np.ndarray) -> bytes:
    """Parities of how many hashes fall on each of a power of two of places."""
    bits = max(BITS, 1 << (len(s) - 1).bit_length())
    return np.packbits(np.bincount((s % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).tobytes()


def _node(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), SEED)).view(np.int64))


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for t in b.column("text").to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(shingles(t).view(np.int64))], names=["h"])


def frequent(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are frequent in a sample of rows (text, _r1), at most MOST_FREQUENT, and the
    place of each among them, the most frequent last."""
    share = min(1_000_000, 1 + SAMPLE_ROWS * 1_000_000 // max(rows.count(), 1))
    hashes = rows.where(F.pmod("_r1", F.lit(1_000_000)) < share).select("text").mapInArrow(_sample, "h long")
    found = hashes.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "h").limit(MOST_FREQUENT)
    hashes = np.array([r["h"] for r in found.select("h").collect()][::-1], np.int64).view(np.uint64)
    places = np.argsort(hashes)
    return hashes[places], places


def _prefixes(often):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, places = often.value
        for b in batches:
            node, size, keys, fp, bits = [], [], [], [], []
            for t in b.column("text").to_pylist():
                hashes = gram_hashes(t, WORDS)
                s = _set(hashes)
                node.append(_node(s)), size.append(len(s)), fp.append(majority(hashes)), bits.append(bitmap(s))
                found = np.minimum(np.searchsorted(last, s), len(last) - 1)
                late = last[found] == s if len(last) else np.zeros(len(s), bool)
                ordered = s[late][np.argsort(places[found[late]])]
                keys.append(np.concatenate([s[~late], ordered | np.uint64(1 << 63)])[: prefix(len(s))].tobytes())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "_r1", "_r2")), pa.array(node, pa.int64()), pa.array(size, pa.int64()), pa.array(keys, pa.binary()), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(bits, pa.binary())], names=["doc_id", "_r1", "_r2", "node", "n", "keys", "fp", "bits"])

    return run


def _spread(star: bool):
    """(key, node, n, root, at) of each set's prefix: at is the key's place. star: only the first
    keys, and those that are frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, at = [], []
            for k in b.column("keys").to_pylist():
                x = np.frombuffer(k, np.int64)
                places = np.flatnonzero((np.arange(len(x)) < FIRST) | (x < 0)) if star else np.arange(len(x))
                keys.append(x[places]), at.append(places)
            times = [len(k) for k in keys]
            if keys:
                columns = [np.repeat(b.column(c).to_numpy(zero_copy_only=False), times) for c in ("node", "n", "root")]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), *map(pa.array, columns), pa.array(np.concatenate(at).astype(np.int64))], names=["key", "node", "n", "root", "at"])

    return run


def _meet(star: int):
    """Reads (key, node, n, root, at) sorted by key and n, gives pairs of each bucket whose roots
    differ and that may be similar if this is the first key they share: what stands behind it in
    both is then all they can have in common. star: each with one of its sizes only, the first of
    them, or with 2 the last; 0: all pairs."""

    def pairs(node: np.ndarray, n: np.ndarray, root: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        i = 0
        while i < len(n) - 1:
            end = int(np.searchsorted(n, 5 * n[i] // 4, "right"))
            j, to = np.arange(i + 1, end), i
            if star == 2:
                j, to = np.arange(i, end - 1), end - 1
            behind = np.minimum(n[to] - at[to], n[j] - at[j])
            j = j[(root[j] != root[to]) & (9 * behind >= 4 * (n[to] + n[j]))]
            if len(j):
                yield np.full(len(j), node[to]), node[j]
            i = max(end, i + 1) if star else i + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # of the last bucket, which may go on
        out: list[tuple] = []
        count = 0

        def give() -> pa.RecordBatch:
            a, b = (np.concatenate(x) for x in zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        def buckets(x: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal out, count
            bounds = np.r_[0, np.flatnonzero(np.diff(x[0])) + 1, x.shape[1]]
            for k in np.flatnonzero(np.diff(bounds) > 1).tolist():
                i, j = bounds[k], bounds[k + 1]
                if x[3, i] == x[3, i:j].max() == x[3, i:j].min():
                    continue  # all are joined already
                for found in pairs(*x[1:, i:j]):
                    out.append(found)
                    count += len(found[0])
                    if count > PIECE:
                        yield give()
                        out, count = [], 0

        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "node", "n", "root", "at")])
            if held and x[0, -1] == held[0][0, 0]:
                held.append(x)
                continue
            x = np.concatenate([*held, x], axis=1)
            cut = int(np.searchsorted(x[0], x[0, -1]))
            yield from buckets(x[:, :cut])
            held = [x[:, cut:]]
        if held:
            yield from buckets(np.concatenate(held, axis=1))
        if out:
            yield give()

    return run


def differing(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """In how many bits the bitmaps of each pair differ; the larger one is folded to the other's size."""
    out, kinds = np.zeros(len(x), np.int64), np.array([[len(p), len(q)] for p, q in zip(x, y, strict=True)]).reshape(-1, 2)
    for kind in np.unique(kinds, axis=0):
        at = np.flatnonzero((kinds == kind).all(axis=1))
        p, q = (np.bitwise_xor.reduce(np.frombuffer(b"".join(v[i] for i in at), np.uint8).reshape(len(at), -1, kind.min()), axis=1) for v in (x, y))
        out[at] = np.bitwise_count(p ^ q).sum(axis=1, dtype=np.int64)
    return out


def _may_be_similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose bitmaps (x, y) don't differ in more bits than similar sets of m and n shingles can
    in shingles: a ninth of m + n."""
    for b in batches:
        m, n = (b.column(c).to_numpy(zero_copy_only=False) for c in ("m", "n"))
        yield b.select(["a", "b"]).filter(pa.array(9 * differing(b.column("x").to_pylist(), b.column("y").to_pylist()) <= m + n))


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingles(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "hashes"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ok = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)]
        yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def proposed(sets: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): pairs of sets (node, fp) whose fingerprints are linked, enough of them to join what
    the links join: each set with the least of its fingerprint, and those along the links."""
    least = written(sets.groupBy("fp").agg(F.min("node").alias("least")))
    equal = sets.select("node", "fp").join(small_side(least), "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    found = written(links(least.select("fp"), distance)).withColumnsRenamed({"a": "f", "b": "g"})
    ends = lambda x, to: least.select(F.col("fp").alias(x), F.col("least").alias(to))
    along = found.join(small_side(ends("f", "a")), "f").join(small_side(ends("g", "b")), "g").select("a", "b")
    return equal.unionByName(along).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _links(rows: DataFrame, sets: DataFrame, star: int, more: DataFrame | None = None) -> DataFrame:
    """(a, b): similar pairs among sets (node, n, keys, bits, root, _r1, _r2) of different roots, and
    of those in more."""
    spread = sets.select("node", "n", "root", "keys").mapInArrow(_spread(star > 0), "key long, node long, n long, root long, at long")
    pairs = spread.repartition(F.col("key")).sortWithinPartitions("key", "n", "node").mapInArrow(_meet(star), "a long, b long")
    met = written((pairs.unionByName(more) if more is not None else pairs).distinct())
    nodes = lambda pairs: pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    ends = written(sets.join(nodes(met), "node", "left_semi").select("node", "n", "bits", "_r1", "_r2"))
    left, right = ends.select(F.col("node").alias("a"), F.col("bits").alias("x"), F.col("n").alias("m")), ends.select(F.col("node").alias("b"), F.col("bits").alias("y"), "n")
    pairs = written(met.join(left, "a").join(right, "b").select("a", "b", "x", "y", "m", "n").mapInArrow(_may_be_similar, "a long, b long"))
    wanted = written(ends.join(nodes(pairs), "node", "left_semi").select("_r1", "_r2"))
    texts = rows.join(small_side(wanted), ["_r1", "_r2"], "left_semi").dropDuplicates(["_r1", "_r2"]).select("text")
    whole = written(texts.mapInArrow(_whole, "node long, hashes binary"))
    left, right = whole.select(F.col("node").alias("a"), F.col("hashes").alias("x")), whole.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    out = written(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_compare, "a long, b long"))
    for used in (whole, wanted, pairs, ends, met):
        discard(used)
    return out


def _rooted(sets: DataFrame, links: DataFrame) -> DataFrame:
    joined = written(components(links)).withColumnRenamed("root", "to")
    return sets.drop("root").join(small_side(joined), "node", "left").withColumn("root", F.coalesce("to", "node")).drop("to")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, _r1, _r2, root, which rows have in common that similar pairs join.
    Texts without words are alike."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    rows = rows.select("*", *row_key(F.col("doc_id"), F.col("text")))
    often = spark.sparkContext.broadcast(frequent(rows))
    prints = written(rows.mapInArrow(_prefixes(often), "doc_id long, _r1 long, _r2 long, node long, n long, keys binary, fp long, bits binary"))
    sets = written(prints.dropDuplicates(["node"]).select("node", "n", "keys", "fp", "bits", "_r1", "_r2", F.col("node").alias("root")))
    narrow = written(prints.select("doc_id", "_r1", "_r2", "node"))
    discard(prints)
    found = _links(rows, sets, 1, proposed(sets))
    for star in (2, 0):
        found = written(found.unionByName(_links(rows, _rooted(sets, found), star)))
    roots = written(_rooted(sets.select("node", "root"), found))
    discard(sets)
    return narrow.join(small_side(roots), "node").select("doc_id", "_r1", "_r2", "root")
