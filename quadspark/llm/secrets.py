"""Secret scans through a trigram inverted index.

Each rule's pattern gives a Boolean query of mandatory trigrams: any of some alternatives, each
needing all of its trigrams. The trigrams of each text are extracted once. Postings of the
documents at hand are intersected, and only candidates are scanned with the pattern; a rule
without mandatory trigrams scans every document. The index is kept as a table as well:
documents are cut into blocks, and for each trigram a bitmap tells which blocks of a group of 64
have it. New rules are answered from that table, rereading the candidate blocks only.

Trigrams are of bytes, after ASCII letters are lower-cased. Whole texts are indexed and scanned.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadspark.llm.common import bounded_batches, row_key, small_side, written

#: Blocks of a group: bits of a posting.
BLOCKS = 64


def either_case(word: str) -> str:
    """A pattern for the word with its ASCII letters in either case, and no other letter."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isascii() and c.isalpha() else re.escape(c) for c in word)


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int = 0  # characters that a match must have,
    group: int = 0  # in this group
    scan: str | None = None  # a pattern that finds just the matches that are long enough, with fewer steps,
    span: int = 0  # as this group


NAMES = "|".join([*map(either_case, ("password", "passwd", "secret", "token")), either_case("api") + "_?" + either_case("key")])
#: The three base kinds, in their order.
BASE = (
    Rule("assign", rf"""({NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24, scan=r"[0-9a-f]{24,}"),  # either takes whole runs
)
#: Further kinds.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    # only the first eyJ of a run of such characters can begin a match: one step through each run
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", scan=r"(?<![A-Za-z0-9_-])(?:(?!eyJ)[A-Za-z0-9_-])*+(eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)", span=1),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("payment", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/:@]{3,64}@"),
)
#: A run of a pattern that can be more strings than that counts as unknown text.
MOST_STRINGS, MOST_CLAUSES = 64, 256

#: Any of these clauses, each: all of its trigrams (three bytes as one number). None demands nothing.
Query = frozenset[frozenset[int]] | None


# Patterns, as far as their mandatory text matters. A node is: ("text", characters) for one of
# them, ("row", nodes), ("any of", nodes), ("repeat", least, most, node), ("nothing",), ("unknown",).


class Pattern:
    """Reads a pattern. What it doesn't know, it takes for unknown text of any length."""

    def __init__(self, text: str) -> None:
        self.text, self.at, self.fold = text, 0, False

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self, wanted: str) -> bool:
        if self.text.startswith(wanted, self.at):
            self.at += len(wanted)
            return True
        return False

    def whole(self) -> tuple:
        found = self.alternatives()
        if self.at < len(self.text):
            raise ValueError(f"no pattern: {self.text!r}")
        return found

    def alternatives(self) -> tuple:
        parts = [self.row()]
        while self.take("|"):
            parts.append(self.row())
        return parts[0] if len(parts) == 1 else ("any of", parts)

    def row(self) -> tuple:
        nodes = []
        while self.peek() not in ("", "|", ")"):
            nodes.append(self.repeated(self.one()))
        return ("row", nodes)

    def repeated(self, node: tuple) -> tuple:
        while True:
            if m := re.compile(r"\{(\d*)(,?)(\d*)\}").match(self.text, self.at):
                least = int(m[1] or 0)
                most = least if not m[2] else int(m[3]) if m[3] else None
                self.at = m.end()
            elif self.peek() in ("*", "+", "?") and self.peek():
                least, most = {"*": (0, None), "+": (1, None), "?": (0, 1)}[self.peek()]
                self.at += 1
            else:
                return node
            node = ("repeat", least, most, node)
            if self.peek() in ("?", "+") and self.peek():  # lazy or possessive: the same texts or fewer
                self.at += 1

    def one(self) -> tuple:
        c = self.peek()
        self.at += 1
        if c == "(":
            return self.group()
        if c == "[":
            return self.chosen()
        if c == "\\":
            return self.escaped()
        if c in "^$":
            return ("nothing",)
        return ("unknown",) if c == "." else ("text", {c})

    def group(self) -> tuple:
        kind = "plain"
        if self.take("?"):
            m = re.compile(r":|=|!|<=|<!|>|P<\w+>|P=\w+(?=\))|#[^)]*(?=\))|\((?:\w+)\)|([a-zA-Z-]+)(?:\)|:)").match(self.text, self.at)
            if m is None:
                raise ValueError(f"no group: {self.text!r}")
            kind, self.at = m[0], m.end()
            if m[1]:
                self.fold |= "i" in m[1].partition("-")[0]
                if kind.endswith(")"):
                    return ("nothing",)
        inner = self.alternatives()
        if not self.take(")"):
            raise ValueError(f"a group isn't closed: {self.text!r}")
        if kind[0] in "=!#" or kind in ("<=", "<!"):
            return ("nothing",)  # looks around, takes no text
        return ("unknown",) if kind.startswith(("P=", "(")) else inner

    def escaped(self) -> tuple:
        c = self.peek()
        self.at += 1
        if m := re.compile(r"x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})").match(self.text, self.at - 1):
            self.at = m.end()
            return ("text", {chr(int(m[1] or m[2] or m[3], 16))})
        if c in "AZbB":
            return ("nothing",)
        known = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "v": "\v", "a": "\a"}.get(c)
        return ("text", {known}) if known else ("unknown",) if c.isalnum() else ("text", {c})

    def chosen(self) -> tuple:
        chars: set[str] | None = set()
        negated = self.take("^")
        first = True
        while first or self.peek() != "]":
            first = False
            if not self.peek():
                raise ValueError(f"a class isn't closed: {self.text!r}")
            low = self.member()
            if self.peek() == "-" and self.text[self.at + 1 : self.at + 2] not in ("]", ""):
                self.at += 1
                high = self.member()
                if chars is not None and low and high and ord(high) - ord(low) < MOST_STRINGS:
                    chars |= {chr(c) for c in range(ord(low), ord(high) + 1)}
                else:
                    chars = None
            elif chars is not None:
                chars = chars | {low} if low else None
        self.at += 1
        return ("unknown",) if negated or chars is None else ("text", chars)

    def member(self) -> str | None:
        c = self.peek()
        self.at += 1
        if c != "\\":
            return c
        node = self.escaped()
        return next(iter(node[1])) if node[0] == "text" else "\b" if node[0] == "nothing" else None


def _least(clauses) -> Query:
    """Without the clauses that another one implies."""
    return frozenset(c for c in clauses if not any(d < c for d in clauses))


def _and(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    both = _least({x | y for x in a for y in b})
    return both if len(both) <= MOST_CLAUSES else a  # demanding less is safe


def _or(a: Query, b: Query) -> Query:
    return None if a is None or b is None else _least(a | b)


def trigrams(data: bytes) -> set[int]:
    return {data[i] << 16 | data[i + 1] << 8 | data[i + 2] for i in range(len(data) - 2)}


def _demand(strings: set[bytes]) -> Query:
    """That one of the strings is there."""
    if any(len(s) < 3 for s in strings):
        return None
    return _least({frozenset(trigrams(s)) for s in strings})


def _row(nodes: list[tuple], fold: bool) -> tuple[set[bytes] | None, Query]:
    """All strings that the nodes in a row can match, lower-cased, or None if they are many or
    unknown; and what a match demands besides."""
    run, whole, query = {b""}, True, None
    for node in nodes:
        exact, own = _node(node, fold)
        query = _and(query, own)
        if exact is not None and len(run) * len(exact) <= MOST_STRINGS:
            run = {a + b for a in run for b in exact}
        else:
            query, whole = _and(query, _demand(run)), False
            run = exact if exact is not None else {b""}
    return (run, query) if whole else (None, _and(query, _demand(run)))


def _node(node: tuple, fold: bool) -> tuple[set[bytes] | None, Query]:
    match node:
        case ("text", chars):
            if fold and any(not c.isascii() or c in "iIkKsS" for c in chars):
                return None, None  # some of these have other cases outside of ASCII
            found = {c.encode("utf-8", "surrogatepass").lower() for c in chars}
            return (found, None) if len(found) <= 8 else (None, None)
        case ("nothing",):
            return {b""}, None
        case ("row", nodes):
            return _row(nodes, fold)
        case ("any of", nodes):
            parts = [_node(n, fold) for n in nodes]
            if all(e is not None for e, _ in parts):
                query = parts[0][1]
                for _, q in parts[1:]:
                    query = _or(query, q)
                return set().union(*(e for e, _ in parts)), query
            demands = [q if e is None else _and(q, _demand(e)) for e, q in parts]
            query = demands[0]
            for q in demands[1:]:
                query = _or(query, q)
            return None, query
        case ("repeat", least, most, inner):
            exact, query = _node(inner, fold)
            if least == 0:
                return (exact | {b""}, None) if exact is not None and most == 1 and query is None else (None, None)
            if exact is not None and least == most == 1:
                return exact, query
            return None, query if exact is None else _and(query, _demand(exact))
    return None, None


def trigram_query(pattern: str) -> Query:
    """What trigrams, of lower-cased bytes, each match of the pattern has."""
    p = Pattern(pattern)
    tree = p.whole()
    exact, query = _node(tree, p.fold)
    return query if exact is None else _and(query, _demand(exact))


def answer(query: Query, postings: Callable[[int], int], every: int) -> int:
    """The bits of the documents or blocks that the query leaves: postings are intersected in each
    clause, those of the clauses united."""
    if query is None:
        return every
    found = 0
    for clause in query:
        both = every
        for g in clause:
            both &= postings(g)
            if not both:
                break
        found |= both
    return found


def _codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams of all texts, and where each text's end. Texts shorter than three bytes have none."""
    data = b"".join(texts).lower()
    x = np.frombuffer(data, np.uint8).astype(np.uint32)
    return (x[:-2] << 16 | x[1:-1] << 8 | x[2:] if len(x) > 2 else np.empty(0, np.uint32)), np.cumsum([len(t) for t in texts])


class Block:
    """The trigram index of some documents, for the trigrams that rules ask for: which documents have each."""

    def __init__(self, texts: list[bytes], wanted: np.ndarray) -> None:
        codes, ends = _codes(texts)
        self.codes, self.ends, self.n = codes, ends, len(texts)
        at = np.flatnonzero(wanted[codes])
        of = np.searchsorted(ends, at, "right")
        inside = at + 3 <= ends[of] if len(at) else np.zeros(0, bool)  # not across a text's end
        pairs = np.unique(codes[at[inside]].astype(np.int64) << 32 | of[inside]) if len(at) else np.empty(0, np.int64)
        self.held: dict[int, int] = {}
        for pair in pairs.tolist():
            self.held[pair >> 32] = self.held.get(pair >> 32, 0) | 1 << (pair & 0xFFFFFFFF)

    def candidates(self, query: Query) -> list[int]:
        found = answer(query, lambda g: self.held.get(g, 0), (1 << self.n) - 1)
        return [i for i in range(self.n) if found >> i & 1]

    def blocks(self) -> np.ndarray:
        """The block of each document: BLOCKS of some equal size, a long document in one by itself."""
        total = max(1, int(self.ends[-1])) if self.n else 1
        starts = np.r_[0, self.ends[:-1]]
        return np.minimum(starts * BLOCKS // total, BLOCKS - 1)

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """(trigram, blocks that have it) of all trigrams."""
        block = self.blocks()
        keys, bits = [], []
        for k in np.unique(block).tolist():
            docs = np.flatnonzero(block == k)
            low, high = int(self.ends[docs[0] - 1]) if docs[0] else 0, int(self.ends[docs[-1]])
            found = np.unique(self.codes[low:high])  # one across a text's end is one too many, which is safe
            keys.append(found), bits.append(np.full(len(found), 1 << k, np.uint64))
        if not sum(map(len, keys)):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        key, bit = np.concatenate(keys), np.concatenate(bits)
        order = np.argsort(key, kind="stable")
        key, bit = key[order], bit[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        return key[first].astype(np.int64), np.bitwise_or.reduceat(bit, first).view(np.int64)


def matches(rule: Rule, compiled: re.Pattern, text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches; those that are too short are dropped afterwards."""
    return [m.span(rule.span) for m in compiled.finditer(text) if len(m.group(rule.group)) >= rule.least]


class Scanner:
    """Finds the spans of rules in texts, through their trigrams."""

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules, self.compiled = rules, [re.compile(r.scan or r.pattern) for r in rules]
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.wanted = np.zeros(1 << 24, bool)
        self.wanted[np.array([g for q in self.queries if q is not None for clause in q for g in clause], np.int64)] = True

    def __call__(self, texts: list[str]) -> tuple[list[list[tuple[int, int, int]]], Block]:
        """(start, rule's place, end) in order, of each text; and the texts' index."""
        index = Block([t.encode("utf-8", "surrogatepass") for t in texts], self.wanted)
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, (rule, pattern, query) in enumerate(zip(self.rules, self.compiled, self.queries, strict=True)):
            for i in index.candidates(query):
                found[i] += [(start, k, end) for start, end in matches(rule, pattern, texts[i])]
        return [sorted(f) for f in found], index


SCANNED = "kind string, doc_id long, _r1 long, _r2 long, found string, grp string, block int, keys binary, bits binary"


def _scan(base: tuple[Rule, ...], more: tuple[Rule, ...]):
    """A row for each document (its spans, and its block), and one for each group of blocks (the index)."""
    rules = (*base, *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        task = TaskContext.get()
        for n, b in enumerate(batches):
            if not b.num_rows:
                continue
            texts = [t or "" for t in b.column("text").to_pylist()]
            found, index = scanner(texts)
            spans = [",".join(f"{k}:{s}:{e}" for s, k, e in f) for f in found]
            group, rows = f"{task.partitionId()}.{n}", len(texts)
            keys, bits = index.table()
            columns = {
                "kind": ["doc"] * rows + ["index"], "doc_id": [*b.column("doc_id").to_pylist(), None], "_r1": [*b.column("_r1").to_pylist(), 0], "_r2": [*b.column("_r2").to_pylist(), 0],
                "found": [*spans, None], "grp": [group] * (rows + 1), "block": [*index.blocks().tolist(), -1], "keys": [None] * rows + [np.diff(keys, prepend=0).astype("<u4").tobytes()], "bits": [None] * rows + [bits.tobytes()],
            }
            kinds = {"doc_id": pa.int64(), "_r1": pa.int64(), "_r2": pa.int64(), "block": pa.int32(), "keys": pa.binary(), "bits": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.string())) for k, v in columns.items()], names=list(columns))

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return rows.select("*", *row_key(F.col("doc_id"), F.col("text")))


def _candidates(queries: list[Query]):
    """Blocks of each group that some query leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            groups, blocks = [], []
            for g, keys, bits in zip(*(b.column(c).to_pylist() for c in ("grp", "keys", "bits")), strict=True):
                key, bit = np.cumsum(np.frombuffer(keys, "<u4"), dtype=np.int64), np.frombuffer(bits, np.uint64)

                def postings(g: int, key=key, bit=bit) -> int:
                    i = int(np.searchsorted(key, g))
                    return int(bit[i]) if i < len(key) and key[i] == g else 0

                left = 0
                for q in queries:
                    left |= answer(q, postings, (1 << BLOCKS) - 1)
                for k in range(BLOCKS):
                    if left >> k & 1:
                        groups.append(g), blocks.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(groups, pa.string()), pa.array(blocks, pa.int32())], names=["grp", "block"])

    return run


def _again(rules: tuple[Rule, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for b in batches:
            found, _ = scanner([t or "" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([",".join(f"{rules[k].kind}:{s}:{e}" for s, k, e in f) for f in found], pa.string())], names=["doc_id", "spans"])

    return run


class Index:
    """The scan of a table of documents, and its trigram index, in the shared folder."""

    def __init__(self, docs: DataFrame, base: tuple[Rule, ...] = BASE, more: tuple[Rule, ...] = MORE) -> None:
        bounded_batches(docs.sparkSession)
        self.base, self.more, self.docs = base, more, docs
        self.table = written(_keyed(docs).mapInArrow(_scan(base, more), SCANNED))

    def found(self) -> DataFrame:
        """doc_id, n_<kind> of each base kind, base_sha256, spans."""
        every = F.split("found", ",")
        kinds = F.array(*[F.lit(r.kind) for r in (*self.base, *self.more)])
        place = lambda x: F.split(x, ":")[0].cast("int")
        named = lambda x: F.concat_ws(":", F.get(kinds, place(x)), F.split(x, ":")[1], F.split(x, ":")[2])
        rows = self.table.where("kind = 'doc'").select("doc_id", F.when(F.col("found") == "", F.array().cast("array<string>")).otherwise(every).alias("f"))
        own = F.filter("f", lambda x: place(x) < len(self.base))
        of_kind = lambda k: F.filter("f", lambda x: place(x) == k)
        counts = [F.size(of_kind(k)).cast("long").alias(f"n_{r.kind}") for k, r in enumerate(self.base)]
        text = lambda a: F.array_join(F.transform(a, named), ",")
        return rows.select("doc_id", *counts, F.sha2(text(own).cast("binary"), 256).alias("base_sha256"), text(F.col("f")).alias("spans"))

    def candidates(self, *rules: Rule) -> DataFrame:
        """(grp, block): blocks that may hold a match of one of the rules. Only the index is read."""
        return self.table.where("kind = 'index'").select("grp", "keys", "bits").mapInArrow(_candidates([trigram_query(r.pattern) for r in rules]), "grp string, block int")

    def search(self, *rules: Rule) -> DataFrame:
        """(doc_id, spans) of the documents in candidate blocks that match one of some new rules.
        Other documents are not scanned."""
        rows = self.table.where("kind = 'doc'").select("grp", "block", "_r1", "_r2")
        wanted = written(rows.join(small_side(written(self.candidates(*rules))), ["grp", "block"]).select("_r1", "_r2").distinct())
        texts = _keyed(self.docs).join(small_side(wanted), ["_r1", "_r2"], "left_semi").select("doc_id", "text")
        return texts.mapInArrow(_again(rules), "doc_id long, spans string").where("spans <> ''")


def find_secrets(docs: DataFrame, base: tuple[Rule, ...] = BASE, more: tuple[Rule, ...] = MORE) -> DataFrame:
    """Per row of docs: doc_id, n_<kind> of each base kind, base_sha256 (of the base spans), spans.

    A null text is an empty one, and has no spans. Very long texts are scanned whole, in time in
    proportion to their length. Repeated rows give repeated results, an empty table none; other
    columns are not looked at. Spans of different kinds may overlap."""
    return Index(docs, base, more).found()
