"""Quality classifier: a factorisation machine.

Inputs are a text's hashed words, statistics of its structure, and its measures (lengths), each
statistic as the bin it falls in. Every pair of inputs interacts through the product of two
short vectors. With the sum-of-squares identity the sum over all pairs takes linear time:
1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).
"""

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadspark.llm.common import bounded_batches, held_out, training_rows, written

#: Hashed words, length of the vectors, labelled rows a model is fitted on at most, and their characters.
WORDS, RANK, TRAIN_ROWS, TRAIN_CHARS = 1 << 15, 8, 12_000, 48_000_000
#: Edges of the bins of a share, and of a measure (powers of two).
SHARES = np.array([0.001, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.97])
BINS = len(SHARES) + 1
STATS = 14
MEMORY = 400_000


class Features:
    """(indices, values) of texts. Remembers the words' places."""

    def __init__(self) -> None:
        self.place: dict[str, int] = {}

    def word(self, w: str) -> int:
        p = self.place.get(w)
        if p is None:
            if len(self.place) >= MEMORY:
                self.place.clear()
            p = self.place[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORDS
        return p

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        text = text or ""
        tokens = text.split()
        counts = Counter(tokens)
        at = Counter()
        for w, n in counts.items():
            at[self.word(w.lower())] += n
        index = np.fromiter(at, np.int32, len(at))
        value = np.log1p(np.fromiter(at.values(), np.float64, len(at)))
        if len(value):
            value /= np.sqrt((value * value).sum())
        stats = _stats(text, tokens, counts)
        bins = WORDS + np.arange(STATS, dtype=np.int32) * BINS + stats
        return np.r_[index, bins].astype(np.int32), np.r_[value, np.full(STATS, 1 / math.sqrt(STATS))]


def _stats(text: str, tokens: list[str], counts: Counter) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kinds = np.bincount(raw, minlength=256)
    n, t = max(1, len(raw)), max(1, len(tokens))
    lines = text.split("\n")
    symbols = int(kinds[33:48].sum() + kinds[58:65].sum() + kinds[91:97].sum() + kinds[123:127].sum())
    plain = int(kinds[44] + kinds[46])
    shares = [
        (symbols - plain) / n * 3, plain / t, int(kinds[65:91].sum()) / n, int(kinds[48:58].sum()) / n * 3, int(kinds[124]) / t, int(kinds[33]) / t,
        len(counts) / t, max(counts.values(), default=0) / t, 1 - len(set(lines)) / len(lines), (len(lines) - 1) / t, sum(w.isupper() for w in counts) / max(1, len(counts)),
    ]
    measures = [math.log2(1 + n), math.log2(1 + t), n / t]
    return np.array([*np.searchsorted(SHARES, shares), *(min(BINS - 1, int(m)) for m in measures)], np.int32)


SIZE = WORDS + STATS * BINS


def _flat(docs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts = np.cumsum([0, *(len(i) for i, _ in docs[:-1])])
    return np.concatenate([i for i, _ in docs]), np.concatenate([v for _, v in docs]), starts


class Machine:
    def __init__(self, bias: float, linear: np.ndarray, vectors: np.ndarray) -> None:
        self.bias, self.linear, self.vectors = bias, linear, vectors

    def raw(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the logistic function, and each text's sums over its inputs. Every text has inputs."""
        vx = self.vectors[index] * value[:, None]
        sums = np.add.reduceat(vx, starts)
        pairs = 0.5 * (sums * sums - np.add.reduceat(vx * vx, starts)).sum(axis=1)
        return self.bias + np.add.reduceat(self.linear[index] * value, starts) + pairs, sums

    def scores(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(*_flat(docs))[0], -30, 30))) if docs else np.zeros(0)


def train(docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 8, batch: int = 128, rate: float = 0.02, decay: float = 1e-5, seed: int = 0) -> Machine:
    """Adam on the log loss, in an order that the seed fixes."""
    rng = np.random.default_rng(seed)
    m = Machine(math.log((y.sum() + 1) / (len(y) - y.sum() + 1)), np.zeros(SIZE), rng.normal(0, 0.05, (SIZE, RANK)))
    m1, m2 = np.zeros((SIZE, RANK + 1)), np.zeros((SIZE, RANK + 1))
    b1 = b2 = 0.0
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for lo in range(0, len(order), batch):
            pick = order[lo : lo + batch]
            step += 1
            index, value, starts = _flat([docs[i] for i in pick])
            raw, sums = m.raw(index, value, starts)
            g = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[pick]) / len(pick)
            lengths = np.diff(np.r_[starts, len(index)])
            each, of = np.repeat(g, lengths), np.repeat(np.arange(len(pick)), lengths)
            part = np.empty((len(index), RANK + 1))
            part[:, 0] = each * value
            part[:, 1:] = (each * value)[:, None] * (sums[of] - m.vectors[index] * value[:, None])
            places, back = np.unique(index, return_inverse=True)
            grad = np.zeros((len(places), RANK + 1))
            np.add.at(grad, back, part)
            grad[:, 0] += decay * m.linear[places]
            grad[:, 1:] += decay * m.vectors[places]
            m1[places] = 0.9 * m1[places] + 0.1 * grad
            m2[places] = 0.999 * m2[places] + 0.001 * grad * grad
            scale = rate * math.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            move = scale * m1[places] / (np.sqrt(m2[places]) + 1e-8)
            m.linear[places] -= move[:, 0]
            m.vectors[places] -= move[:, 1:]
            b1, b2 = 0.9 * b1 + 0.1 * g.sum(), 0.999 * b2 + 0.001 * g.sum() ** 2
            m.bias -= scale * b1 / (math.sqrt(b2) + 1e-8)
    return m


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features = Features()
    for b in batches:
        found = [features(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("of"), b.column("label"), pa.array([i.tobytes() for i, _ in found], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary())], names=["of", "label", "i", "v"])


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Machine | None:
    """A machine from at most `rows` labelled documents of `chars` characters in all (documented
    bounds: the labels are broadcast, and the driver holds their inputs, 8 bytes for each different
    word of a text). None without labels."""
    bounded_batches(docs.sparkSession)
    sample = training_rows(docs, labels, "quality", rows, chars)
    found = written(sample.mapInArrow(_extract, "of long, label int, i binary, v binary")).orderBy("of", "i", "v").collect()
    if not found:
        return None
    return train([(np.frombuffer(r["i"], np.int32), np.frombuffer(r["v"], "<f4").astype(np.float64)) for r in found], np.array([r["label"] for r in found], float))


def _score(machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, features = machine.value, Features()
        for b in batches:
            texts, out = b.column("text").to_pylist(), []
            for lo in range(0, len(texts), 64):
                found = [features(t) for t in texts[lo : lo + 64]]
                out += m.scores(found).tolist() if m is not None else [0.5] * len(found)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return run


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted.

    Only the text decides a score. A null text is an empty one, scored by its measures. Without
    labels every score is 0.5. A null doc_id is not held out. Very long texts are read whole, in
    time in proportion to their length. Repeated rows give repeated results, an empty table
    none; other columns are not looked at."""
    machine = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    out = rows.mapInArrow(_score(machine), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
