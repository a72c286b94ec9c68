"""Toxicity behind a noisy channel.

Letters may have been replaced by look-alikes, spread by spaces or dots, or repeated. Spans
that look so become lattices: at each character the letters it may stand for, and whether it
was put in; Viterbi finds the likeliest reading under a character trigram model. Its alphabet
and its counts come from all documents: letters of any script that are frequent enough are
classes of their own. The words of a text, and those of its spans as they are restored, are
scored with weights learned from labelled rows.
"""

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from heapq import nlargest

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadspark.llm.common import bounded_batches, held_out, training_rows, written

#: Letters that are classes of the model, at most: a to z, then the most frequent ones of all
#: documents. Class 0 is a word's border, the last one any other letter.
LETTERS_KEPT, BORDER = 126, 0
A_TO_Z = "abcdefghijklmnopqrstuvwxyz"
#: Look-alikes and the letters they may stand for.
LOOK_ALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "+": "t", "|": "il", "(": "c", "€": "e"}
SEPARATORS = " .-_*"
#: Costs of the channel, in nats.
SUBSTITUTED, KEPT, TWICE, REPEATED, SPREAD, BROKEN = 1.0, 8.0, 3.0, 0.5, 0.3, 2.0
#: Labelled rows that a model is fitted on, and their characters, at most.
TRAIN_ROWS, TRAIN_CHARS = 20_000, 64_000_000
#: The strongest words of a text that count: weak evidence must not add up with a text's length.
#: Characters of a word's beginning that count as a word of its own.
STRONGEST, BEGINNINGS = 3, (4, 5)
#: Readings a worker remembers before it starts anew.
MEMORY = 400_000
#: A character that is repeated more often is to the lattice as one repeated so often.
RUN = 4
#: Letters of short words, and how many of these are known at most.
SHORT, SHORT_KEPT = 3, 1000
SHORT_WORD = re.compile(rf"(?<!\w)[^\W\d_]{{1,{SHORT}}}(?!\w)")
DOUBLED = re.compile(r"(.)\1")
LONG_RUN = re.compile(rf"(.)\1{{{RUN},}}", re.S)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def _letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each letter, and each word of up to SHORT letters, is there."""
    counts, words = np.zeros(0x110000, np.int64), Counter()
    for b in batches:
        for t in b.column("text").to_pylist():
            x = _codes(t)
            if len(x):
                counts[: int(x.max()) + 1] += np.bincount(x)
                words.update(SHORT_WORD.findall(t.lower()))
        if len(words) > MEMORY:
            yield _counted(words)
            words = Counter()
    yield _counted(words + Counter({f"\0{chr(c)}": n for c, n in zip(np.flatnonzero(counts).tolist(), counts[counts > 0].tolist(), strict=True) if chr(c).isalpha()}))


def _counted(words: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["key", "n"])


def _trigrams(alphabet: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = len(alphabet) + 2
        table = np.zeros(0x110000, np.uint8)
        table[[c for c in range(0x110000) if chr(c).isalpha()]] = classes - 1
        for i, c in enumerate(alphabet):
            table[ord(c)] = i + 1
        counts = np.zeros(classes**3, np.int64)
        edge = np.zeros(2, np.int32)

        def add(x: np.ndarray) -> None:
            np.add(counts, np.bincount((x[:-2] * classes + x[1:-1]) * classes + x[2:], minlength=classes**3), out=counts)

        for b in batches:
            held, size = [edge], 2
            for t in b.column("text").to_pylist():  # texts follow each other, with borders between
                held += [table[_codes(t)].astype(np.int32), edge]
                size += len(held[-2]) + 2
                if size > 1 << 20:
                    add(np.concatenate(held))
                    held, size = [edge], 2
            add(np.concatenate(held))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at])], names=["code", "n"])

    return run


class Model:
    """Log probabilities of a class after two others, the class of each character, and the words of
    up to SHORT letters that are frequent as they are."""

    def __init__(self, alphabet: str, counts: np.ndarray, short: frozenset[str] = frozenset()) -> None:
        self.alphabet, self.short, n = alphabet, short, len(alphabet) + 2
        three = counts.reshape(n, n, n).astype(np.float64)
        two, one = three.sum(axis=0), three.sum(axis=(0, 1))
        p1 = (one + 1) / (one.sum() + n)
        p2 = (two + 5 * p1[None, :]) / (two.sum(axis=1, keepdims=True) + 5)
        self.n, self.logs = n, np.log((three + 5 * p2[None]) / (three.sum(axis=2, keepdims=True) + 5)).astype(np.float32).tobytes()
        self.costs: array | None = None
        self.of = {c: i + 1 for i, c in enumerate(alphabet)}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"costs": None}

    def cost(self) -> array:
        """Of class c after a and b: at (a n + b) n + c."""
        if self.costs is None:
            self.costs = array("f")
            self.costs.frombytes((-np.frombuffer(self.logs, np.float32)).tobytes())
        return self.costs

    def kind(self, c: str) -> int:
        k = self.of.get(c)
        return k if k is not None else self.n - 1 if c.isalpha() else BORDER


def character_model(docs: DataFrame, letters: int = LETTERS_KEPT, short: int = SHORT_KEPT) -> Model:
    """From all documents, in two passes: the alphabet and the short words, then the trigrams. The
    driver gets `letters` and `short` counts, then one of each trigram of classes that is there (2
    million at most); they grow with what the corpus holds."""
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    sums = written(texts.mapInArrow(_letters, "key string, n long").groupBy("key").agg(F.sum("n").alias("n")))
    top = lambda cond, most: [r["key"] for r in sums.where(cond).orderBy(F.desc("n"), "key").limit(most).collect()]
    found, words = top(F.col("key").startswith("\0"), letters), top(~F.col("key").startswith("\0"), short)
    alphabet = A_TO_Z + "".join(sorted({k[1] for k in found} - {*A_TO_Z}))[: letters - len(A_TO_Z)]
    sums = texts.mapInArrow(_trigrams(alphabet), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(alphabet) + 2) ** 3)
    counts[sums.column("code").to_numpy()] = sums.column("n").to_numpy()
    return Model(alphabet, counts, frozenset(words))


def _doubles(word: str, model: Model) -> str | None:
    """decode() of a word of letters, where each letter stands once or twice in a row and pairs have
    three letters or more between them: then each pair is read by itself. None for other words."""
    m = DOUBLED.search(word)
    if m is None:
        return word
    cost, n, out, last = model.cost(), model.n, [], -9
    padded = [BORDER, BORDER, *map(model.kind, word), BORDER]
    while m:
        i = m.start()
        if i - last < 5 or word[i + 2 : i + 3] == word[i]:
            return None
        last = i
        a, b, c = padded[i], padded[i + 1], padded[i + 2]  # two before, the letter
        end = padded[i + 4 : i + 6]
        both, one, x, y, u, v = cost[(a * n + b) * n + c] + cost[(b * n + c) * n + c], cost[(a * n + b) * n + c] + TWICE, c, c, b, c
        for d in end:
            both += cost[(x * n + y) * n + d]
            one += cost[(u * n + v) * n + d]
            x, y, u, v = y, d, v, d
        if one < both:
            out.append(i)
        m = DOUBLED.search(word, i + 1)
    for i in reversed(out):
        word = word[:i] + word[i + 1 :]
    return word


def decode(span: str, model: Model) -> str:
    """The likeliest reading of a lower-cased span. Linear in its length: a state is the last
    two classes, and few are reached."""
    span = LONG_RUN.sub(lambda m: m[1] * RUN, span)
    cost, n, kind = model.cost(), model.n, model.kind
    states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
    for i, ch in enumerate(span):
        again = bool(i) and span[i - 1] == ch
        extra_copy = REPEATED if again and (span[i + 1 : i + 2] == ch or span[i - 2 : i - 1] == ch) else TWICE
        if ch in SEPARATORS:
            arcs = [("", -1, SPREAD), (" ", BORDER, BROKEN)]
        elif ch in LOOK_ALIKES:
            arcs = [*((c, kind(c), SUBSTITUTED) for c in LOOK_ALIKES[ch]), (ch, kind(ch), KEPT)]
        else:
            arcs = [(ch, kind(ch), 0.0)]
        if again and (ch.isalpha() or ch in LOOK_ALIKES):
            arcs.append(("", -1, extra_copy))
        new: dict[int, tuple[float, tuple | None]] = {}
        for state, (so_far, way) in states.items():
            for out, c, extra in arcs:
                if c >= 0:
                    at = state * n + c
                    key, total, to = at % (n * n), so_far + extra + cost[at], (out, way)
                else:
                    key, total, to = state, so_far + extra, way
                if key not in new or total < new[key][0]:
                    new[key] = (total, to)
        states = new
    best = min(states.items(), key=lambda s: s[1][0] + cost[s[0] * n])[1][1]
    out = []
    while best is not None:
        out.append(best[0])
        best = best[1]
    return "".join(reversed(out))


_LETTER, _LOOKS, _APART = r"[^\W\d_]", re.escape("".join(LOOK_ALIKES)), re.escape(SEPARATORS)
_ANY = rf"(?:{_LETTER}|[{_LOOKS}])"
SPREAD_OUT = re.compile(rf"(?<![\w@$])(?:{_ANY}[{_APART}]{{1,2}}){{3,}}{_ANY}(?![\w@$])")
#: Groups of up to three characters, however far apart; what is white space is one blank to the lattice.
GROUPS = re.compile(rf"(?<![\w@$])(?:{_ANY}{{1,3}}[\s{_APART}]+)+{_ANY}{{1,3}}(?![\w@$])")
GAP = re.compile(rf"[\s{_APART}]+")
#: What the lattice may read otherwise: a look-alike beside a letter, a doubled letter, letters with separators between.
ODD = re.compile(rf"{_LETTER}[{_LOOKS}]|[{_LOOKS}]{_LETTER}|({_LETTER})\1|{_LETTER}[{_APART}]+{_LETTER}")
LETTERS = re.compile(r"[^\W\d_]+")
EDGES = " \t\n\r\x0b\x0c\"'`.,;:?*%#&()[]{}<>/\\=~^-_"
OUTSIDE = "".join(c for c in EDGES if c not in LOOK_ALIKES)


class Reader:
    """Words of texts, as they are and restored. Remembers what it read."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.memory: dict[str, frozenset[str] | tuple[str]] = {}  # of tokens
        self.spans: dict[str, frozenset[str]] = {}
        self.runs: dict[str, tuple[frozenset[str], frozenset[str]]] = {}

    def token(self, token: str) -> frozenset[str] | tuple[str]:
        """Words of a lower-cased token without white space."""
        core = token.strip(EDGES)
        if core.isalpha() and token.strip(OUTSIDE) == core:  # the usual case, shortened
            read = _doubles(core, self.model)
            if read is not None:
                return (core,) if read == core else (core, read)
        words = set(LETTERS.findall(core))
        # a look-alike at an end may as well be punctuation: both readings count
        for part in {core.rstrip("!"), token.strip(OUTSIDE)}:
            if ODD.search(part):
                words.update(LETTERS.findall(decode(part, self.model)))
        return frozenset(words)

    def read(self, token: str) -> str:
        """A suspicious token; what is no part of a word at its ends stays."""
        core = token.strip(EDGES).rstrip("!")
        before, _, after = token.partition(core)
        return before + decode(core, self.model) + after if core else token

    def words(self, token: str) -> frozenset[str] | tuple[str]:
        found = self.memory.get(token)
        if found is None:
            if len(self.memory) >= MEMORY:
                self.memory.clear()
            found = self.memory[token] = self.token(token)
        return found

    def span(self, key: str) -> frozenset[str]:
        found = self.spans.get(key)
        if found is None:
            if len(self.spans) >= MEMORY:
                self.spans.clear()
            found = self.spans[key] = frozenset(LETTERS.findall(decode(key, self.model))) if LETTERS.search(key) else frozenset()
        return found

    def run(self, run: str) -> tuple[frozenset[str], frozenset[str]]:
        """Restored words of what is spread out in a run of short groups, and of the run as a whole.
        A run of frequent short words of two letters or more is just that."""
        found = self.runs.get(run)
        if found is None:
            if len(self.runs) >= MEMORY:
                self.runs.clear()
            groups = GAP.sub(" ", run)
            plain = all(len(g) > 1 and g in self.model.short for g in groups.split())
            spread = frozenset().union(*(self.span(m[0]) for m in SPREAD_OUT.finditer(run)))
            found = self.runs[run] = spread, frozenset() if plain else self.span(groups)
        return found

    def apart(self, lower: str) -> set[str]:
        """Restored words of runs of short groups: those of letters that are spread out, and others
        that aren't words of the text as it is. What SPREAD_OUT finds lies in what GROUPS finds."""
        spread, whole = set(), set()
        for run in set(GROUPS.findall(lower)):
            x, y = self.run(run)
            spread |= x
            whole |= y
        return spread | whole.difference(LETTERS.findall(lower)) if whole else spread

    def all_words(self, text: str) -> set[str]:
        lower = text.lower()
        return set().union(self.apart(lower), *map(self.words, set(lower.split())))

    def restore(self, text: str) -> str:
        """The text, lower-cased, with suspicious spans replaced by their likeliest reading."""
        lower = SPREAD_OUT.sub(lambda m: decode(m[0], self.model), text.lower())
        return re.sub(r"\S+", lambda m: self.read(m[0]) if ODD.search(m[0].strip(EDGES)) else m[0], lower)


def marks(words: set[str]) -> set[str]:
    """What a text's words are counted as: themselves, and their beginnings."""
    return {f"{k}^{w[:k]}" for w in words for k in BEGINNINGS if len(w) > k} | words


def _count(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model.value)
        for b in batches:
            sums: dict[str, list[int]] = {}
            for t, y, fold in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), b.column("fold").to_pylist(), strict=True):
                at = 0 if y else 1
                for m in marks(reader.all_words(t)):
                    s = sums.get(m)
                    if s is None:
                        s = sums[m] = [0, 0, 0, 0]
                    s[at] += 1
                    s[at + 2] += fold
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), *(pa.array([s[i] for s in sums.values()], pa.int64()) for i in range(4))], names=["mark", "a", "b", "a1", "b1"])

    return run


def weight(a: float, b: float, pos: float, neg: float) -> float:
    """Lower bound (one in a hundred) of the log odds of a mark that a of pos and b of neg texts have."""
    return math.log((a + 0.5) / (pos + 1)) - math.log((b + 0.5) / (neg + 1)) - 2.33 * math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))


class Scorer:
    def __init__(self, model: Model, lexicon: dict[str, float], slope: float, bias: float) -> None:
        self.reader, self.lexicon, self.slope, self.bias = Reader(model), lexicon, slope, bias
        self.starts = [(k, {m[len(f"{k}^") :]: w for m, w in lexicon.items() if m.startswith(f"{k}^")}) for k in BEGINNINGS]
        self.known: set[str] = set()  # tokens, of which some have weights
        self.weights: dict[str, float] = {}

    def best(self, words: frozenset[str] | set[str] | tuple[str]) -> float:
        """Over marks(words)."""
        best = 0.0
        for w in words:
            best = max(best, self.lexicon.get(w, 0.0))
            for k, starts in self.starts:
                if len(w) > k and w[:k] in starts:
                    best = max(best, starts[w[:k]])
        return best

    def evidence(self, text: str | None) -> float:
        """The sum of the weights of the strongest different tokens."""
        lower = (text or "").lower()
        if len(self.known) >= MEMORY:
            self.known, self.weights = set(), {}
        tokens = set(lower.split())
        new = tokens - self.known
        self.known |= new
        for token in new:
            if w := self.best(self.reader.token(token)):
                self.weights[token] = w
        found = [self.weights[t] for t in tokens.intersection(self.weights)] if len(self.weights) < len(tokens) else [self.weights[t] for t in tokens if t in self.weights]
        found += [w for w in (self.best((x,)) for x in self.reader.apart(lower)) if w]
        return sum(nlargest(STRONGEST, found))

    def __call__(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * self.evidence(text) + self.bias))))


def _fit_line(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression with one input, slightly drawn to slope 1 and bias -4. Newton steps,
    halved as long as they make the loss worse."""

    def loss(w: np.ndarray) -> float:
        z = w[0] * x + w[1]
        return float((np.logaddexp(0, z) - y * z).sum() + 0.5 * (w[0] - 1) ** 2 + 0.005 * (w[1] + 4) ** 2)

    w = np.array([1.0, -4.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(w[0] * x + w[1], -30, 30)))
        g = np.array([((p - y) * x).sum() + w[0] - 1, (p - y).sum() + 0.01 * (w[1] + 4)])
        r = p * (1 - p)
        step = np.linalg.solve(np.array([[(r * x * x).sum() + 1, (r * x).sum()], [(r * x).sum(), r.sum() + 0.01]]), g)
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
            step /= 2
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def _evidence(parts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*parts.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([scorer.evidence(t) for t in b.column("text").to_pylist()], pa.float64()), b.column("label")], names=["x", "label"])

    return run


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS):
    """The parts of a Scorer. Character counts are of all documents. Word weights come from at
    most `rows` labelled rows of `chars` characters in all (documented bounds, so that the weights
    can be broadcast), a third of which calibrates scores made with the weights of the other two."""
    spark = docs.sparkSession
    bounded_batches(spark)
    model = character_model(docs)
    shared = spark.sparkContext.broadcast(model)
    fold = (F.pmod(F.xxhash64(F.lit(3), "of"), F.lit(3)) > 0).cast("int")
    sample = written(training_rows(docs, labels, "toxic", rows, chars).select("text", "label", fold.alias("fold")))
    total = {(r["label"], r["fold"]): r["n"] for r in sample.groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos1, neg1 = total.get((1, 1), 0), total.get((0, 1), 0)
    pos, neg = pos1 + total.get((1, 0), 0), neg1 + total.get((0, 0), 0)
    if not pos or not neg:
        return model, {}, 1.0, math.log((pos + 0.5) / (neg + 0.5)) if pos + neg else -5.0
    sums = sample.mapInArrow(_count(shared), "mark string, a long, b long, a1 long, b1 long").groupBy("mark").agg(*(F.sum(c).alias(c) for c in ("a", "b", "a1", "b1")))
    found = sums.where(f"a >= 2 AND a * {neg} > 2 * b * {pos}").orderBy("mark").collect()  # bounded by the training rows
    final = {r["mark"]: w for r in found if (w := weight(r["a"], r["b"], pos, neg)) > 0.3}
    early = {r["mark"]: w for r in found if r["a1"] and (w := weight(r["a1"], r["b1"], pos1, neg1)) > 0.3} if pos1 and neg1 else {}
    seen = sorted(sample.where("fold = 0").mapInArrow(_evidence(spark.sparkContext.broadcast((model, early, 1.0, 0.0))), "x double, label int").collect())
    x, y = np.array([r["x"] for r in seen], float), np.array([r["label"] for r in seen], float)
    slope, bias = _fit_line(x, y) if len(set(y.tolist())) > 1 else (1.0, -4.0)
    return model, final, max(slope, 0.05), bias


def _score(parts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*parts.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([scorer(t) for t in b.column("text").to_pylist()], pa.float64())], names=["doc_id", "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted.

    Only the text decides a score. A null text is an empty one; texts without words get the
    score of no evidence. Without labels of both kinds the score is one number for all. A null
    doc_id is not held out. Very long texts are read whole, in time in proportion to their
    length. Repeated rows give repeated results, an empty table none."""
    parts = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    out = rows.mapInArrow(_score(parts), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def toxicity_stage(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs without those that are rejected. All columns are kept as they are."""
    parts = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    scored = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.col("text").alias("_scored"))
    score = F.pandas_udf(_series(parts), "double")("_scored")
    return scored.where(score < threshold).select("row.*")


def _series(parts):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(*parts.value)
        for texts in batches:
            yield pd.Series([scorer(t) for t in texts], dtype="float64")

    return run
