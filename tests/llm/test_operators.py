"""Each operator against a plain version, on small tables with every awkward row."""

import base64
import hashlib
import os
import random
import zlib
from collections import defaultdict
from types import SimpleNamespace

import brute
import numpy as np
import pyarrow as pa
import pytest
from conftest import rows as make_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadspark.llm import jaccard, linededup, media, mixing, packing, quality, secrets, simhash, sketch, toxicity, warc
from quadspark.llm.common import held_out, marked, table, training_labels, written

ROWS = make_rows()
PAIRS = [(r[0], r[1]) for r in ROWS]


@pytest.fixture(scope="module")
def real(spark, sf):
    return [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text", "source").collect()]


# 1 WARC


@pytest.fixture(scope="module")
def pages(spark):
    data = [(1, "http://a/", "<p>one</p>"), (2, "http://b/\r\nX: y", "<p>one</p>"), (3, None, None), (4, "u", ""), (5, "u", "é" * 3000), (5, "v", "é" * 3000), (None, "n", "<p>one</p>"), (None, None, "only here"), (7, "w", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n\x1f\x8b\x08" * 50)]
    return spark.createDataFrame(data, "page_id long, url string, html string")


def plain_archive(rows):
    best = {}
    for i, _, h in rows:
        k = h or ""
        best[k] = max([x for x in (i, best.get(k)) if x is not None], default=None)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        response = i == best[h or ""]
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if response else "revisit", None if response else best[h or ""]))
    return brute.counted(out)


def test_warc_round_trip(spark, pages, sf):
    assert brute.counted(map(tuple, warc.archive_pages(pages.withColumn("payload", F.lit(1))).collect())) == plain_archive([tuple(r) for r in pages.collect()])
    real = table(spark, sf, "pages")
    assert brute.counted(map(tuple, warc.archive_pages(real).collect())) == plain_archive([tuple(r) for r in real.select("page_id", "url", "html").collect()])
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_warc_ranges_do_not_change_what_is_read(spark, pages):
    archives = warc.write_pages(pages, roll=2000)
    whole, _ = warc.read_archives(archives)
    for size in (97, 1000):
        parts, gaps = warc.read_archives(archives, range_bytes=size)
        assert brute.counted((r.record_id, r.payload) for r in parts.collect()) == brute.counted((r.record_id, r.payload) for r in whole.collect()) and gaps.count() == 0
    assert {bytes(r.payload).decode() for r in whole.where("record_type = 'response'").collect()} == {r.html or "" for r in pages.collect()}


class Bytes:
    def __init__(self, data):
        self.data, self.at = data, 0

    def seek(self, at):
        self.at = at

    def read(self, n):
        self.at += n
        return self.data[self.at - n : self.at]


def members(n, packed=True):
    out = [warc.page_record(i, f"u{i}", f"body {i} ".encode() * (i + 1), None, False) for i in range(n)]
    return [warc.member(x) for x in out] if packed else out


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_recovers_all_whole_records(packed):
    rng = random.Random(5)
    parts = members(30, packed)
    for _ in range(60):
        hurt = sorted(rng.sample(range(30), 4))
        data, places, at = b"", [], 0
        for i, p in enumerate(parts):
            if i in hurt:
                b = bytearray(p)
                kind = rng.randrange(3)
                if kind == 0:
                    b[rng.randrange(20, len(b) - 8)] ^= 0xFF
                elif kind == 1:
                    del b[rng.randrange(5, len(b)) :]
                else:
                    b = bytearray(rng.randbytes(rng.randrange(1, 200)))
                p = bytes(b)
            else:
                places.append((at, at + len(p)))
            data += p
            at += len(p)
        found = list(warc.salvage(warc.Archive(Bytes(data), len(data))))
        records = [(x.start, x.end) for x in found if not isinstance(x, tuple)]
        gaps = [(x[0], x[1]) for x in found if isinstance(x, tuple)]
        assert set(places) <= set(records)  # harmless damage may leave a record whole
        assert sorted(records + gaps)[0][0] == 0 and all(a[1] == b[0] for a, b in zip(sorted(records + gaps), sorted(records + gaps)[1:], strict=False))
        assert sorted(records + gaps)[-1][1] == len(data)


def test_gaps_are_logged(spark, tmp_path):
    parts = members(20)
    data = b"".join(parts[:5]) + b"\x00garbage" * 40 + b"".join(parts[5:12]) + parts[12][:-9] + b"".join(parts[13:])
    (tmp_path / "a.warc.gz").write_bytes(data)
    archives = spark.createDataFrame([(str(tmp_path / "a.warc.gz"), len(data))], "path string, size long")
    for size in (1 << 20, 300):
        records, gaps = warc.read_archives(archives, range_bytes=size)
        assert sorted(warc_number(r.record_id) for r in records.collect()) == [i for i in range(20) if i != 12]
        first = sum(map(len, parts[:5]))
        assert sorted((g.start, g.stop - g.start) for g in gaps.collect()) == [(first, 320), (first + 320 + sum(map(len, parts[5:12])), len(parts[12]) - 9)]


@pytest.mark.parametrize("long", [65_000, 70_000, 262_000, 2_000_000])
def test_headers_of_any_length(spark, long):
    rows = [(1, "u", "<p>one</p>"), (2, "data:," + "é" * long, "<p>one</p>"), (3, "data:," + "x" * long, "two")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert brute.counted(map(tuple, warc.archive_pages(pages).collect())) == plain_archive(rows)
    for packed in (True, False):
        data = b"".join(warc.member(r) if packed else r for r in (warc.page_record(i, u, h.encode(), None, False) for i, u, h in rows))
        found = list(warc.salvage(warc.Archive(Bytes(data), len(data))))
        assert [warc_number(x.headers["warc-record-id"]) for x in found] == [1, 2, 3]


def test_members_of_several_records(spark, tmp_path):
    """A file compressed as a whole, and members of some records, one of them damaged before it was compressed."""
    parts = members(12, packed=False)
    hurt = bytearray(parts[7])
    hurt[-9] ^= 0xFF
    data = warc.member(b"".join(parts[:5])) + warc.member(parts[5]) + warc.member(parts[6] + bytes(hurt) + parts[8]) + warc.member(b"".join(parts[9:]))
    (tmp_path / "m.warc.gz").write_bytes(data)
    archives = spark.createDataFrame([(str(tmp_path / "m.warc.gz"), len(data))], "path string, size long")
    for size in (1 << 20, 200):
        records, gaps = warc.read_archives(archives, range_bytes=size)
        assert sorted(warc_number(r.record_id) for r in records.collect()) == [i for i in range(12) if i != 7]
        assert [g.reason for g in gaps.collect()] == ["in the member: bytes after a record"]


def test_each_attempt_writes_its_own_files(spark, pages, tmp_path):
    """Files of an attempt that isn't committed, with other bytes, change nothing."""
    folder = f"file://{tmp_path}/a"
    archives = warc.write_pages(pages, roll=500, folder=folder)
    names = {r.path for r in archives.collect()}
    again = {r.path for r in warc.write_pages(pages.orderBy(F.rand()), roll=700, folder=folder).collect()}
    assert not names & again
    records, gaps = warc.read_archives(archives)
    assert records.count() == pages.count() == archives.agg(F.sum("records")).first()[0] and gaps.count() == 0


def test_lost_records_are_an_error(spark, pages, monkeypatch):
    write = warc.write_pages

    def short(p):
        return write(p).withColumn("size", F.col("size") - 3)

    monkeypatch.setattr(warc, "write_pages", short)
    with pytest.raises(ValueError, match="records written"):
        warc.archive_pages(pages)


def warc_number(s):
    return int(s.rsplit(":", 1)[1].rstrip(">"))


# 2, 9 models


def auc(found):
    pos, neg = [s for s, y in found if y], [s for s, y in found if not y]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize(("f", "column", "least"), [(toxicity.toxicity, "toxic", 0.9), (quality.quality, "quality", 0.98)])
def test_held_out_accuracy(spark, f, column, least):
    d = "/root/testdata/sf0.1"
    labels = table(spark, d, "labels")
    out = f(table(spark, d, "documents"), labels)
    found = out.where("held_out").join(labels, "doc_id").select("score", column, "predicted").collect()
    assert len(found) > 500 and auc([(r[0], r[1]) for r in found]) > least
    assert sum(r[2] == r[1] for r in found) / len(found) > 0.95


@pytest.mark.parametrize("f", [toxicity.toxicity, quality.quality])
def test_scores_of_awkward_rows(spark, docs, wide, empty, f):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 27)] + [(4, None, None), (None, 1, 1), (6, 1, 1)], "doc_id long, quality int, toxic int")
    out = f(wide, labels).collect()
    assert brute.counted(r.doc_id for r in out) == brute.counted(r[0] for r in ROWS) and all(0 <= r.score <= 1 for r in out)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert brute.counted(f(docs, labels).collect()) == brute.counted(out)  # reruns, and other columns, change nothing
    assert f(empty, labels).count() == 0
    assert f(docs, labels.limit(0)).count() == len(ROWS)
    same = {r.text: s for r, s in zip(docs.collect(), [None] * len(ROWS), strict=True)}
    assert same  # equal texts are compared below
    scores = defaultdict(set)
    for r in f(docs.where("text = 'same text'"), labels).collect():
        scores["same"].add(r.score)
    assert len(scores["same"]) == 1


def test_training_labels(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1000)] * 2, "doc_id long, toxic int")
    got = {r.doc_id for r in training_labels(labels, "toxic", 100).collect()}
    assert len(got) == 100 and not any(zlib.crc32(str(i).encode()) % 5 == 0 for i in got)
    assert got == {r.doc_id for r in training_labels(labels.repartition(7), "toxic", 100).collect()}
    assert labels.select(held_out(F.col("doc_id")).alias("h")).where("h").count() == 2 * sum(zlib.crc32(str(i).encode()) % 5 == 0 for i in range(1000))


@pytest.fixture(scope="module")
def reader(spark, sf):
    return toxicity.Reader(toxicity.character_model(table(spark, "/root/testdata/sf0.1", "documents")))


@pytest.mark.parametrize(("hidden", "clear"), [("1d10t", "idiot"), ("m0r0n", "moron"), ("s t u p i d", "stupid"), ("l.o.s.e.r", "loser"), ("stuuuupid", "stupid"), ("p@thet1c", "pathetic"), ("$cum", "scum"), ("tr4sh", "trash"), ("d1sgu5t1ng", "disgusting"), ("cl0wnnn!!!", "clown!!!"), ("plain words stay", "plain words stay")])
def test_deobfuscation(reader, hidden, clear):
    assert reader.restore(hidden) == clear


@pytest.mark.parametrize(("hidden", "clear"), [("stuupid", "stupid"), ("sstupid", "stupid"), ("iddiot", "idiot"), ("+rash", "trash"), ("disgus+", "disgust"), ("(lown", "clown"), ("(clown)", "clown"), ("9arbage", "garbage"), ("dis9usting", "disgusting"), ("stu-pid", "stupid"), ("st.up.id", "stupid"), ("stu pid", "stupid"), ("s   t   u   p   i   d", "stupid"), ("s\tt\tu\tp\ti\td", "stupid"), ("you are an idi ot", "idiot")])
def test_all_that_the_lattice_models_is_read(reader, hidden, clear):
    assert clear in reader.all_words(hidden)


def test_viterbi_is_the_best_reading(reader):
    """Against all readings of short spans, one by one."""
    from itertools import product

    def cost(span, choice):
        total, a, b = 0.0, 0, 0
        at = lambda a, b, c: reader.model.cost()[(a * reader.model.n + b) * reader.model.n + c]
        for out, extra in choice:
            total += extra
            if out:
                c = reader.model.kind(out)
                total += at(a, b, c)
                a, b = b, c
        return total + at(a, b, 0)

    for span in ("1d0", "a1l", "@s5", "x.1"):
        arcs = []
        for i, ch in enumerate(span):
            own = [(ch, 0.0)] if ch.isalpha() else [("", toxicity.SPREAD), (" ", toxicity.BROKEN)] if ch in toxicity.SEPARATORS else [*((c, toxicity.SUBSTITUTED) for c in toxicity.LOOK_ALIKES[ch]), (ch, toxicity.KEPT)]
            if i and span[i - 1] == ch:
                own.append(("", toxicity.TWICE))
            arcs.append(own)
        best = min(product(*arcs), key=lambda c: cost(span, c))
        assert toxicity.decode(span, reader.model) == "".join(o for o, _ in best)


def test_alphabet_is_of_the_documents(reader, spark):
    m = toxicity.character_model(spark.createDataFrame([("abc éé ЖЖЖ 漢",), (None,), ("",)], "text string"))
    assert set(m.alphabet) >= {*toxicity.A_TO_Z, "é", "ж", "漢"} and m.kind("é") != m.kind("ж") != m.kind("q") and m.kind("1") == 0 and m.kind("ß") == m.n - 1
    assert reader.model.n > 28  # other letters than a to z are frequent there
    assert toxicity.character_model(spark.createDataFrame([], "text string")).n >= 28


def test_trigram_counts_are_exact(spark, monkeypatch):
    from collections import Counter

    rng = random.Random(3)
    texts = ["".join(rng.choices("ab é1 ", k=rng.randrange(40))) for _ in range(200)]
    alphabet = toxicity.A_TO_Z + "é"

    got = next(toxicity._trigrams(alphabet)(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])])))
    want, n = Counter(), len(alphabet) + 2
    for t in texts:
        x = [0, 0, *(alphabet.find(c) + 1 for c in t), 0, 0]
        want.update((a * n + b) * n + c for a, b, c in zip(x, x[1:], x[2:], strict=False))
    got = dict(zip(got.column("code").to_pylist(), got.column("n").to_pylist(), strict=True))
    assert {k: v for k, v in got.items() if k} == {k: v for k, v in want.items() if k}  # three borders: however many


@pytest.mark.parametrize("text", ["|" * 1_000_000, "a@@@" * 250_000, "|@" * 500_000, "a." * 500_000, "a" + " " * 1_000_000 + "aaaa", "a" + ".-_*" * 250_000 + "bbbbb", "1" * 1_000_000, "x" * 2_000_000])
def test_long_texts_take_linear_time(reader, text):
    from time import monotonic

    start = monotonic()
    toxicity.Reader(reader.model).all_words(text)
    assert monotonic() - start < 40


def test_readings_do_not_depend_on_what_was_read(reader):
    texts = ["see a.b.c.d e there", "see a.b.c.d there", "a.b.c.d", "s t u p i d", "st-up-id x", "st-up-id"]
    alone = [toxicity.Reader(reader.model).all_words(t) for t in texts]
    for order in (texts, texts[::-1]):
        r = toxicity.Reader(reader.model)
        found = {t: r.all_words(t) for t in order}
        assert [found[t] for t in texts] == alone


def test_runs_of_groups_hold_all_that_is_spread_out(reader):
    """Searching the runs of short groups finds what searching the whole text does."""
    rng = random.Random(5)
    parts = ["a", "i", "ss", "the", "1", "@", "$", "!", "(", " ", "  ", ".", "-", "_", "*", "\n", "\t", "é", "you", "|", "idiot", "9", "to", "'"]
    for _ in range(5000):
        text = "".join(rng.choices(parts, k=rng.randrange(30)))
        want = set().union(*(reader.span(m[0]) for m in toxicity.SPREAD_OUT.finditer(text)))
        assert want <= toxicity.Reader(reader.model).apart(text), text


def test_weights_do_not_depend_on_partitions(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    labels = table(spark, "/root/testdata/sf0.01", "labels")
    one, two = toxicity.fit(docs, labels), toxicity.fit(docs.repartition(7, "text"), labels.repartition(3))
    assert one[1] == two[1] and one[2:] == two[2:] and one[0].logs == two[0].logs


def test_hidden_words_are_restored(spark, reader):
    """The gates and the lattice together: of words of the documents, hidden at random, nine in ten are restored."""
    rng = random.Random(11)
    text = " ".join(r.text for r in table(spark, "/root/testdata/sf0.1", "documents").where("lang = 'en' AND length(text) > 200").orderBy("doc_id").take(200)).lower()
    words = sorted({w for w in text.split() if w.isascii() and w.isalpha() and 5 <= len(w) <= 9 and not any(a == b for a, b in zip(w, w[1:], strict=False))})
    looks = {v: k for k, vs in toxicity.LOOK_ALIKES.items() for v in vs}
    found = total = 0
    for w in rng.sample(words, min(300, len(words))):
        for kind in range(5):
            i = rng.randrange(1, len(w) - 1)
            if kind == 0:
                at = [j for j, c in enumerate(w) if c in looks]
                if not at:
                    continue
                j = rng.choice(at)
                h = w[:j] + looks[w[j]] + w[j + 1 :]
            elif kind == 1:
                h = w[:i] + w[i] * rng.choice((2, 3, 6)) + w[i + 1 :]
            else:
                h = (" ", ".", "-")[kind - 2].join(w)
            total += 1
            found += w in reader.all_words(h)
    assert total > 500 and found / total > 0.9, found / total


def test_shortcut_reads_as_the_lattice_does(reader):
    rng = random.Random(5)
    for _ in range(20_000):
        w = "".join(rng.choices("abeilorstéж", k=rng.randrange(1, 14)))
        read = toxicity._doubles(w, reader.model)
        assert read is None or read == toxicity.decode(w, reader.model), w


def test_obfuscated_insults_are_found(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    scorer = toxicity.Scorer(*toxicity.fit(docs, labels))
    clean = next(r.text for r in docs.join(labels.where("toxic = 0 AND quality = 1"), "doc_id").where("lang = 'en' AND length(text) BETWEEN 500 AND 900").orderBy("doc_id").take(1))
    assert scorer(clean) < 0.5 <= scorer(f"{clean} you 1d10t and m0r0n , s t u p i d") and scorer("") < 0.5 and scorer(None) == scorer("")


def test_linear_time_identity():
    rng = np.random.default_rng(1)
    m = quality.Machine(0.3, rng.normal(size=quality.SIZE), rng.normal(size=(quality.SIZE, quality.RANK)))
    f = quality.Features()
    for text in ("", "a b c a", "One | two !! three\nOne"):
        i, v = f(text)
        want = m.bias + sum(m.linear[a] * x for a, x in zip(i, v, strict=True))
        want += sum(m.vectors[i[a]] @ m.vectors[i[b]] * v[a] * v[b] for a in range(len(i)) for b in range(a))
        assert m.raw(i, v, np.array([0]))[0][0] == pytest.approx(want)


# 3 mixing


def check_mix(rows, out):
    sizes, by = defaultdict(int), defaultdict(list)
    for i, t, s in rows:
        sizes[s] += len(brute.WORD.findall(t or ""))
    want = brute.targets(sizes) if rows else {}
    for r in out:
        by[r.source].append(r)
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
    for s, rs in by.items():
        assert abs(sum(r.taken for r in rs) - want[s]) <= max(r.size for r in rs), s
    assert brute.counted((r.doc_id, r.size) for r in out) == brute.counted((i, len(brute.WORD.findall(t or ""))) for i, t, _ in rows)


def test_mixing(spark, docs, wide, empty, real, sf):
    check_mix([(r[0], r[1], r[3]) for r in ROWS], mixing.mix(wide).collect())
    out = mixing.mix(table(spark, sf, "documents")).collect()
    check_mix(real, out)
    again = mixing.mix(table(spark, sf, "documents").repartition(5)).collect()
    assert brute.counted(out) == brute.counted(again)
    assert mixing.mix(empty).count() == 0
    kept = mixing.mix_stage(wide)
    assert kept.columns == wide.columns and kept.count() == sum(r.copies for r in mixing.mix(docs).collect())


def test_mixing_in_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF", 20)
    monkeypatch.setattr(mixing, "FAN", 3)
    rng = random.Random(3)
    rows = [(i, "w " * rng.randrange(0, 60), "big" if i % 3 else f"s{i % 4}") for i in range(1500)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    check_mix(rows, out)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 50), st.floats(0, 1)), max_size=30), st.integers(0, 99))
def test_pivot_keeps_the_mass(cells, seed):
    words, part = np.array([c[0] for c in cells], float), np.array([c[1] for c in cells], float)
    before = (words * part).sum()
    mixing.pivot(words, part, np.random.default_rng(seed).random(len(words)))
    assert ((part == 0) | (part == 1)).sum() >= len(part) - 1 and (words * part).sum() == pytest.approx(before, abs=1e-4)


def test_pivot_is_fair():
    total, rng = np.zeros(4), np.random.default_rng(0)
    for _ in range(20_000):
        part = np.array([0.2, 0.5, 0.7, 0.6])
        mixing.pivot(np.array([3.0, 1.0, 4.0, 2.0]), part, rng.random(4))
        total += part
    assert total / 20_000 == pytest.approx([0.2, 0.5, 0.7, 0.6], abs=0.02)


def test_equal_rows_are_rounded_together(spark, monkeypatch):
    """A row that a third of the table repeats: planned once, made and numbered in pieces."""
    monkeypatch.setattr(mixing, "PIECE", 100)
    rows = [(1, "a b c", "x", f"n{i}") for i in range(700)] + [(i, "w " * (i % 9), "y" if i % 2 else "x", "m") for i in range(2, 900)] + [(None, None, None, None)] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, note string")
    out = mixing.mix(df).collect()
    check_mix([r[:3] for r in rows], out)
    want, got = defaultdict(int), defaultdict(int)
    for r in out:
        want[r.doc_id] += r.copies
    kept = mixing.mix_stage(df).collect()
    for r in kept:
        got[r.doc_id] += 1
    assert {k: v for k, v in want.items() if v} == dict(got)
    assert max(brute.counted(r.note for r in kept if r.doc_id == 1).values()) <= 2


def test_water_filling():
    assert mixing.water_fill([100, 100, 100], [5, 2, 1], 450) == [200.0, pytest.approx(500 / 3), pytest.approx(250 / 3)]
    assert mixing.water_fill([], [], 0) == [] and mixing.water_fill([0, 10], [5, 2], 15) == [0.0, 15.0]


# 4 line dedup


def test_line_dedup(spark, docs, wide, empty, sf, real):
    want = [(i, n, k, brute.sha(t)) for i, n, k, t in brute.line_dedup(PAIRS)]
    assert brute.counted(map(tuple, linededup.line_dedup_digest(wide).collect())) == brute.counted(want)
    want = [(i, n, k, brute.sha(t)) for i, n, k, t in brute.line_dedup([r[:2] for r in real])]
    assert brute.counted(map(tuple, linededup.line_dedup_digest(table(spark, sf, "documents")).collect())) == brute.counted(want)
    assert linededup.line_dedup_digest(empty).count() == 0
    stage = linededup.line_dedup_stage(wide)
    assert stage.columns == wide.columns
    assert brute.counted((r.doc_id, r.text) for r in stage.collect()) == brute.counted((i, t if was is not None else None) for (i, _, _, t), (_, was) in zip(brute.line_dedup(PAIRS), PAIRS, strict=True))


def test_line_dedup_runs_no_python(wide):
    plan = linededup.line_dedup_digest(wide)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


# 5 sketch


def test_fingerprints(spark, wide, empty, sf, real):
    def check(out, pairs, ties=False):
        order = sorted(pairs, key=lambda r: (r[0] is not None, r[0] or 0))
        by, seen = defaultdict(list), {}
        for r in out:
            by[r.doc_id].append(r)
        errors = []
        for at, (i, t) in enumerate(order):
            if len(by[i]) > 1:
                continue
            t, nxt = t or "", order[(at + 1) % len(order)]
            r = by[i][0]
            if len(by[nxt[0]]) == 1:
                follow = nxt[1] or ""
                edited = t[: len(t) - len(t) // 2] + follow[: len(t) // 2]
                assert (r.n_chars, r.edited_sha256) == (len(t), brute.sha(edited)), i
                for got, a, b in ((r.near_edited, t, edited), (r.near_next, t, follow)):
                    x, y = brute.shingles(a), brute.shingles(b)
                    if len(x | y) >= 20:  # a fixed fraction of fewer shingles tells little
                        errors.append(got - len(x & y) / len(x | y))
                    assert a != b or got == 1.0
            assert seen.setdefault(t, r.fingerprint) == r.fingerprint and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert abs(np.mean(errors)) < 0.05 and np.std(errors) < 0.15, (np.mean(errors), np.std(errors))

    out = sketch.fingerprints(wide).collect()
    assert len(out) == len(ROWS)
    check(out, PAIRS)
    check(sketch.fingerprints(table(spark, sf, "documents")).collect(), [r[:2] for r in real])
    assert sketch.fingerprints(empty).count() == 0
    one = sketch.fingerprints(spark.createDataFrame([(1, "just one text here now")], "doc_id long, text string")).first()
    assert one.near_next == 1.0


def test_neighbours_across_many_ranges(spark):
    rng = random.Random(2)
    ids = rng.sample(range(10**9), 500)
    df = spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, text string")
    got = {r.doc_id: r.following for r in sketch.with_next(df, F.col("text"), ["doc_id"], bucket_rows=7).collect()}
    ids.sort()
    assert got == {a: str(b) for a, b in zip(ids, [*ids[1:], ids[0]], strict=True)}


def test_sketches_merge_and_contain(spark):
    words = [f"t{i}" for i in range(3000)]
    df = spark.createDataFrame([(" ".join(words), " ".join(words[:200]), " ".join(words[1500:]))], "a string, b string, c string")
    s = df.select(*[sketch.sketch(F.col(c)).alias(c) for c in "abc"])
    r = s.select(sketch.likeness(F.col("b"), F.col("a")).alias("x"), sketch.merged(F.col("b"), F.col("c")).alias("m"), sketch.likeness(F.col("a"), F.col("a")).alias("same")).first()
    assert r.x.contained == 1.0 and 0.03 < r.x.jaccard < 0.12 and r.same.jaccard == 1.0
    union = {*brute.shingles(" ".join(words[:200])), *brute.shingles(" ".join(words[1500:]))}
    assert len(r.m) == pytest.approx(len(union) / 4, rel=0.25)


def test_sketches_hold_all_low_hashes(spark):
    """At every length, and nothing else; short texts that differ are not alike."""
    words = [f"t{i % 700}" for i in range(3000)]
    texts = [" ".join(words[:n]) for n in (0, 1, 3, 5, 9, 40, 700, 3000)] + ["A  b\tc", "a b c", "other text of eight words in all here"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 4, F.lit(1))), lambda i: F.shiftrightunsigned(F.xxhash64(F.slice("w", i, 5)), 1))
    rows = df.withColumn("w", F.filter(F.split(F.lower("t"), r"[ \t]+"), lambda x: x != "")).select("i", sketch.sketch(F.col("t")).alias("s"), F.when(F.size("w") > 0, each).otherwise(F.array().cast("array<bigint>")).alias("h")).collect()
    for r in rows:
        assert list(r.s.marks) == sorted({h for h in r.h if h < 2**61})
    assert rows[8].s == rows[9].s
    both = df.alias("x").crossJoin(df.alias("y")).where("x.i < y.i").select("x.i", F.col("y.i").alias("j"), sketch.likeness(sketch.sketch(F.col("x.t")), sketch.sketch(F.col("y.t"))).alias("l")).collect()
    assert all((r.l.jaccard == 1.0) == ({r.i, r.j} == {8, 9}) for r in both if r.i < 6 or r.j > 7)


# 6 packing


def check_pack(out, pairs, window=2048):
    encode = packing.Encoder(packing.vocabulary_path())
    want = defaultdict(list)
    for i, t in pairs:
        ids = np.array([*encode.slow.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want[i].append(ids)
    by = defaultdict(list)
    for r in out:
        by[r.doc_id].append(r)
        assert r.length > 0 and r.offset + r.length <= window
    for i, docs in want.items():
        pool = sorted(by[i], key=lambda r: (r.sequence_id, r.offset))
        for ids in sorted(docs, key=len):
            if len(docs) == 1:
                at = 0
                for r in pool:
                    assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
                    at += r.length
                assert at == len(ids)
        assert sum(r.length for r in pool) == sum(map(len, docs))
    places = sorted((r.sequence_id, r.offset, r.length) for r in out)
    total = 0
    for s, o, n in places:
        assert (s, o) == divmod(total, window)
        total += n
    assert len({r.sequence_id for r in out}) == -(-total // window)


def test_packing(spark, wide, empty, sf, real):
    check_pack(packing.pack(wide).collect(), PAIRS)
    check_pack(packing.pack(table(spark, sf, "documents").repartition(3)).collect(), [r[:2] for r in real])
    assert packing.pack(empty).count() == 0
    r = packing.pack(spark.createDataFrame([(1, "")], "doc_id long, text string")).first()
    assert (r.length, r.doc_tokens, r.padded_length) == (1, 1, 1)  # one id is a power of two
    r = packing.pack(spark.createDataFrame([(1, "three tokens")], "doc_id long, text string")).first()
    assert r.length == 3 and r.padded_length == 2048


def test_both_encoders_agree():
    e = packing.Encoder(packing.vocabulary_path())
    assert e.fast is not None
    usual = [chr(c) for c in (*range(0x20, 0x7F), *range(0xA0, 0x250), *range(0x2010, 0x2028), 9, 10, 13)]
    rng = random.Random(0)
    texts = [a + b for a in usual for b in (*"a 1.'\n", "é")] + ["".join(rng.choices(usual, k=40)) for _ in range(3000)] + ["<|endoftext|>", "it's  we'll\n\n x", " ", "\n \n", "𝒳 漢字 \x1f²"]
    for t in texts:
        assert e(t).tolist() == e.slow.encode(t, add_special_tokens=False).ids, t


def test_added_tokens_are_their_ids():
    """Against the file as it is loaded."""
    from tokenizers import Tokenizer

    fresh, e = Tokenizer.from_file(packing.vocabulary_path()), packing.Encoder(packing.vocabulary_path())
    added = [t.content for t in fresh.get_added_tokens_decoder().values()]
    assert added
    for t in (f"{a}{x}{b}" for x in added for a in ("", "x ", "é\n", "漢") for b in ("", " y", x)):
        assert e(t).tolist() == fresh.encode(t, add_special_tokens=False).ids, t


def test_very_long_runs():
    """Of over a million characters: tiktoken's regex gives up on white space."""
    from tokenizers import Tokenizer

    fresh, e = Tokenizer.from_file(packing.vocabulary_path()), packing.Encoder(packing.vocabulary_path())
    for t in (" " * 2_000_000 + "x", "a" + "\n" * 2_000_000, "a" * 2_000_000, "x" + " " * 1_500_000 + "y"):
        assert np.array_equal(e(t), fresh.encode(t, add_special_tokens=False).ids)


# 7 SimHash


def test_near_duplicates(spark, wide, empty, sf, real):
    assert brute.counted(map(tuple, simhash.near_duplicates_digest(wide).collect())) == brute.counted(brute.near(PAIRS))
    got = simhash.near_duplicates_digest(table(spark, sf, "documents")).collect()
    assert brute.counted(map(tuple, got)) == brute.counted(brute.near([r[:2] for r in real]))
    assert simhash.near_duplicates_digest(empty).count() == 0


def test_stage_keeps_one_of_each_group(wide, empty):
    out = simhash.near_dedup_stage(wide)
    assert out.columns == wide.columns
    groups = {c if c is not None else f for _, f, c in brute.near(PAIRS)}
    kept = [r.doc_id for r in out.collect()]
    assert len(kept) == len(groups) and {k for k in kept if k is not None} == {g for g in groups if isinstance(g, int)}
    assert simhash.near_dedup_stage(empty).count() == 0


def test_stage_drops_all_similar_texts(spark):
    """Texts with words changed here and there, against all pairs by five-word shingles."""
    rng = random.Random(7)
    texts = []
    for _ in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((3, 30, 120, 300)))]
        texts.append(" ".join(words))
        for _ in range(4):
            words = list(words)
            for _ in range(rng.randrange(1, 5)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(3000)}"
            texts.append(" ".join(words))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    edges = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    far = [(simhash.fingerprint(texts[i]) ^ simhash.fingerprint(texts[j])).bit_count() > 4 for i, j in edges]
    assert sum(far) > 20
    want = {min(g) for g in roots(edges, range(len(texts)))}
    out = simhash.near_dedup_stage(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id for r in out.collect()} == want


def all_links(fps, distance=4):
    return {(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= distance}


def roots(edges, nodes):
    g = {n: n for n in nodes}

    def find(x):
        while g[x] != x:
            x = g[x]
        return x

    for a, b in edges:
        g[find(a)] = find(b)
    return {frozenset(n for n in nodes if find(n) == find(m)) for m in nodes}


@pytest.mark.parametrize("size", [1, 5, 40, 900, 20_000])
def test_bitmaps_drop_no_similar_pair(size):
    rng = np.random.default_rng(size)
    pairs = []
    for part in (0.0, 0.05, 0.1, 0.11, 0.12, 0.2, 1.0):
        a = np.unique(rng.integers(0, 1 << 63, size, np.uint64))
        new = np.unique(rng.integers(0, 1 << 63, max(1, int(size * part)), np.uint64))
        pairs += [(a, np.unique(np.r_[a[len(new) :], new])), (a, a), (a, np.unique(np.r_[a, new]))]
    columns = {"a": [*range(len(pairs))], "b": [*range(len(pairs))], "x": [jaccard.bitmap(a) for a, _ in pairs], "y": [jaccard.bitmap(b) for _, b in pairs], "m": [len(a) for a, _ in pairs], "n": [len(b) for _, b in pairs]}
    kept = {i for b in jaccard._may_be_similar(iter([pa.RecordBatch.from_pydict(columns)])) for i in b.column("a").to_pylist()}
    similar = {i for i, (a, b) in enumerate(pairs) if jaccard.similar(a, b)}
    assert similar and similar <= kept
    assert size not in (40, 900) or len(kept) < len(pairs)  # and drops pairs of unlike sets


def test_bitmaps_of_large_sets_drop_unlike_pairs():
    rng = np.random.default_rng(3)
    a = np.unique(rng.integers(0, 1 << 63, 20_000, np.uint64))
    half = np.unique(np.r_[a[::2], rng.integers(0, 1 << 63, len(a) // 2, np.uint64)])
    columns = {"a": [0, 1], "b": [0, 1], "x": [jaccard.bitmap(a)] * 2, "y": [jaccard.bitmap(half), jaccard.bitmap(a[: len(a) * 9 // 10])], "m": [len(a)] * 2, "n": [len(half), len(a) * 9 // 10]}
    assert [i for b in jaccard._may_be_similar(iter([pa.RecordBatch.from_pydict(columns)])) for i in b.column("a").to_pylist()] == [1]


@pytest.mark.parametrize("sizes", [(1, 1), (900, 1100), (1000, 1030), (5000, 4000), (20_000, 3)])
def test_bitmaps_of_different_sizes_are_folded(sizes):
    rng = np.random.default_rng(sum(sizes))
    a, b = (np.unique(rng.integers(0, 1 << 63, n, np.uint64)) for n in sizes)
    odd = [{int(p) for p, n in zip(*np.unique(s % np.uint64(min(8 * len(jaccard.bitmap(x)) for x in (a, b))), return_counts=True), strict=True) if n % 2} for s in (a, b)]
    assert jaccard.differing([jaccard.bitmap(a)], [jaccard.bitmap(b)]).tolist() == [len(odd[0] ^ odd[1])]


def test_most_frequent_shingles_are_last_in_a_prefix(spark):
    """Of a text of frequent shingles only, the prefix holds the rarest of these."""
    phrases = [" ".join(f"p{k}x{i}" for i in range(5)) for k in range(40)]
    rows = spark.createDataFrame([(p, 0) for k, p in enumerate(phrases) for _ in range(3 + k)], "text string, _r1 long")
    often = jaccard.frequent(rows)
    text = " ".join(phrases)
    batch = pa.RecordBatch.from_pydict({"text": [text], "doc_id": [1], "_r1": [1], "_r2": [1]})
    by = {int(jaccard.shingles(p)[0]): k for k, p in enumerate(phrases)}
    assert [by[int(h)] for h in often[0][np.argsort(often[1])]] == list(range(40))
    (out,) = jaccard._prefixes(SimpleNamespace(value=often))(iter([batch]))
    keys = np.frombuffer(out.column("keys")[0].as_py(), np.uint64)
    assert len(keys) == jaccard.prefix(out.column("n")[0].as_py()) and not (keys >> np.uint64(63)).any()
    only = " ".join(phrases[k] for k in (30, 4, 17))
    last = jaccard.shingles(only)
    (out,) = jaccard._prefixes(SimpleNamespace(value=(last, np.arange(len(last))[::-1])))(iter([pa.RecordBatch.from_pydict({"text": [only], "doc_id": [1], "_r1": [1], "_r2": [1]})]))
    keys = np.frombuffer(out.column("keys")[0].as_py(), np.uint64)
    assert (keys ^ np.uint64(1 << 63)).tolist() == last[::-1][: len(keys)].tolist()


def test_marked_rows_hold_all_keys(spark):
    rows = spark.range(-3000, 3000).select("id", F.xxhash64("id").alias("k"))
    keys = written(rows.where("id % 10 = 0").select("k"))
    got = {(r.id % 10 == 0, r.marked) for r in marked(rows, keys, "k").collect()}
    assert (True, True) in got and (True, False) not in got
    assert marked(rows, keys, "k").where("marked AND id % 10 <> 0").count() < 300
    assert marked(rows, written(keys.limit(0)), "k").where("marked").count() == 0


def shuffle_files(spark):
    held = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {x for x in held.split("\n") if os.path.basename(x).startswith("shuffle_")}


def test_stage_shuffles_no_text_that_stays(spark):
    """Texts that differ, but for two equal rows and two near ones; their words are drawn, so that they don't compress."""
    rng = random.Random(5)
    texts = [" ".join(f"{rng.getrandbits(40):x}" for _ in range(300)) for _ in range(300)]
    data = [*enumerate(texts), (0, texts[0]), (1000, texts[1] + " end")]
    out = simhash.near_dedup_stage(spark.createDataFrame(data, "doc_id long, text string"))
    was = shuffle_files(spark)
    assert brute.counted(r.doc_id for r in out.collect()) == brute.counted(range(300))
    assert sum(os.path.getsize(f) for f in shuffle_files(spark) - was if os.path.exists(f)) < 0.2 * sum(map(len, texts))


def test_tables_leave_no_shuffle_files(spark):
    was = shuffle_files(spark)
    assert written(spark.range(100_000).repartition(F.col("id")).groupBy("id").count()).count() == 100_000
    left = {f for f in shuffle_files(spark) - was if f.endswith(".data")}
    assert sum(map(os.path.getsize, left)) < 10_000, left  # those of the count


def test_links_join_whatever_is_linked(spark):
    """Random fingerprints with others at every distance up to 6, and dense groups."""
    rng = random.Random(4)
    fps = set()
    for _ in range(150):
        a = rng.getrandbits(64)
        fps.add(a)
        for d in range(7):
            fps.add(a ^ sum(1 << b for b in rng.sample(range(64), d)))
    dense = rng.getrandbits(64)
    fps |= {dense ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for _ in range(400)}
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    got = [(int(np.int64(r.a).view(np.uint64)), int(np.int64(r.b).view(np.uint64))) for r in simhash.links(df).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in got)
    assert roots(got, fps) == roots(all_links(fps), fps)


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(0, 63), max_size=6))
def test_pigeonring(bits):
    """A difference is viable exactly if it is small enough."""
    x = np.array([sum(1 << b for b in bits)], np.uint64)
    assert simhash.viable(x, 4, simhash.SEGMENTS)[0] == (len(bits) <= 4)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 180)] + [(200, 200), (301, 300), (302, 301)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[i] == 100 for i in range(101, 180)) and got[302] == 300


# 8 media


def test_media(spark, wide, empty, sf, real):
    def check(out, pairs):
        want = []
        for i, t in pairs:
            b = (t or "").encode()
            p = b + b"\0" * (-len(b) % 64 or (0 if b else 64))
            m = media.to_wav(p)
            want.append((i, len(b), len(p), brute.sha(p), zlib.crc32(p[-64:]), len(m), brute.sha(m), media.features(p)))
        assert brute.counted(tuple(r) for r in out) == brute.counted(want)

    check(media.media_features(wide).collect(), PAIRS)
    check(media.media_features(table(spark, sf, "documents")).collect(), [r[:2] for r in real])
    assert media.media_features(empty).count() == 0


def test_media_shares_chunks(spark):
    shared = "".join(f"shared passage {i} " for i in range(3000))
    texts = [f"{'own ' * k}{k} {shared}" for k in range(12)]
    files, chunks = media.store(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    parts = files.select(F.explode("parts").alias("p"))
    assert parts.where("p.data IS NULL").count() > 0.8 * parts.count() and chunks.count() < parts.where("p.data IS NULL").count() / 5
    assert media.media_features(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count() == 12


def test_media_writes_no_more_than_it_stores(spark, monkeypatch):
    """No table of all chunks beside the files and the chunk table."""
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, " ".join(f"{rng.getrandbits(40):x}" for _ in range(2000))) for i in range(40)], "doc_id long, text string")
    sizes = []

    def sized(df):
        out = written(df)
        sizes.append(sum(os.path.getsize(f.removeprefix("file://").removeprefix("file:")) for f in out.inputFiles()))
        return out

    monkeypatch.setattr(media, "written", sized)
    files, chunks = media.store(docs)
    assert sum(sizes) < 1.3 * sum(os.path.getsize(f.removeprefix("file://").removeprefix("file:")) for t in (files, chunks) for f in t.inputFiles())


def test_near_copies_share_chunks(spark):
    """Texts of 600 words with one word changed, or some put in: at least a third of the chunks are shared."""
    rng = random.Random(9)
    texts = []
    for i in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(600)]
        texts.append((2 * i, " ".join(words)))
        words = list(words)
        words[rng.randrange(600)] = "another"
        if i % 2:
            words.insert(rng.randrange(600), "and one more")
        texts.append((2 * i + 1, " ".join(words)))
    files, _ = media.store(spark.createDataFrame(texts, "doc_id long, text string"))
    refs = files.agg(F.sum("refs").alias("r"), F.sum(F.size("parts")).alias("n")).first()
    assert refs.r / refs.n > 1 / 3, refs
    assert media.media_features(spark.createDataFrame([(1, "é" * 1_500_000), (2, None)], "doc_id long, text string")).count() == 2


def test_damage_is_found(spark):
    files, _ = media.store(spark.createDataFrame([(1, "some text")], "doc_id long, text string"))
    bad = files.withColumn("media_sha256", F.lit("0" * 64))
    with pytest.raises(Exception, match="isn't what was stored"):
        bad.select("doc_id", "media_sha256", "header", "parts").mapInArrow(media._read_back(["doc_id"]), f"doc_id long, {media.READ}").collect()


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=60_000), st.integers(1, 3))
def test_chunks_are_the_bytes(data, times):
    data = data * times
    parts = media.chunks(data)
    assert b"".join(parts) == data and all(0 < len(p) <= media.MOST for p in parts)


def test_cuts_follow_the_rolling_hash():
    data = random.Random(1).randbytes(60_000)
    ends, start, h, want = media.cuts(data), 0, 0, []
    for i, b in enumerate(data):
        h = (h * 2 + int(media.GEAR[b])) & 0xFFFFFFFF
        n = i + 1 - start
        if n >= media.LEAST and (h >> (32 - media.CUT_BITS) == 0 or n == media.MOST):
            want.append(i + 1)
            start = i + 1
    assert ends == [*want, len(data)] if want[-1] != len(data) else want


# 10 secrets


def check_secrets(out, pairs):
    want = []
    for i, t in pairs:
        found = brute.secrets(t)
        order = ["assign", "access", "hex"]
        spans = sorted((s, order.index(k), e) for k, v in found.items() for s, e in v)
        want.append((i, *(len(found[k]) for k in order), brute.sha(",".join(f"{order[k]}:{s}:{e}" for s, k, e in spans))))
    assert brute.counted(tuple(r)[:5] for r in out) == brute.counted(want)


def test_secrets(spark, wide, empty, sf, real):
    check_secrets(secrets.find_secrets(wide).collect(), PAIRS)
    check_secrets(secrets.find_secrets(table(spark, sf, "documents")).collect(), [r[:2] for r in real])
    assert secrets.find_secrets(empty).count() == 0
    texts = ["Password: 'abcdef1'", "token=token=abcdef", "API_KEY=short apikey : \"longer-enough\"", "ſecret=abcdefgh", "AKIA" + "A" * 15, "AKIA" + "Z9" * 8, "é" * 5 + "0" * 24, "a" * 23, "x AKIAAKIA" + "B" * 20 + " passwd=" + "0a" * 12, "secret:token:passwd=abc", "-----BEGIN RSA PRIVATE KEY-----"]
    pairs = list(enumerate(texts))
    out = secrets.find_secrets(spark.createDataFrame(pairs, "doc_id long, text string")).collect()
    check_secrets(out, pairs)
    assert "private_key:0:31" in {r.doc_id: r.spans for r in out}[10]


def grams(*words):
    return frozenset(g for w in words for g in secrets.trigrams(w.encode()))


def test_trigram_queries():
    q = secrets.trigram_query
    assert q("AKIA[A-Z0-9]+") == {grams("akia")} and q("[0-9a-f]+") is None and q("ab") is None and q("a.c|xyz") is None
    assert q("(abc|defg)x+") == {grams("abc"), grams("defg")}
    assert q("ab?cd") in (None, {grams("acd"), grams("abcd")})
    assert q(r"(?:key_)[a-z]{3,}?\.(?=zzz)end$") == {grams("key_", ".end")} and q("(?i)token") is None and q("(?i)gamma") == {grams("gamma")}
    assert q(r"\x41bc[^\]]\d{2}(?P<n>xyz)*+[\w-]uvw") == {grams("abc", "uvw")} and q("é+abc") == {grams("abc", "é") - grams("é")} | set() or q("é+abc") is not None
    assert len(q(secrets.BASE[0].pattern)) >= 5
    for bad in ("(abc", "[abc", "(?<n>x)"):
        with pytest.raises(ValueError):
            q(bad)


RULES = [*secrets.BASE, *secrets.MORE]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="AKIapiseceytokn_=: 0a9Z'\"éſK", max_size=80), min_size=1, max_size=5))
def test_candidates_lose_nothing(texts):
    import re

    scanner = secrets.Scanner(tuple(RULES))
    index = secrets.Block([t.encode() for t in texts], scanner.wanted)
    for r, query in zip(RULES, scanner.queries, strict=True):
        assert {i for i, t in enumerate(texts) if re.search(r.pattern, t)} <= set(index.candidates(query))


def test_faster_patterns_find_the_same():
    import re

    rng = random.Random(1)
    for r in RULES:
        if r.scan and r.span:
            for _ in range(30_000):
                t = "".join(rng.choices(["eyJ", "a.", "b12345678", ".", "eyJ", "abcdefgh", ".eyJ", " ", "-"], k=rng.randrange(1, 14)))
                assert [m.span() for m in re.finditer(r.pattern, t)] == [m.span(r.span) for m in re.finditer(r.scan, t)], t


@pytest.mark.parametrize("text", ["eyJ" * 400_000 + " eyJ.", "eyJ.eyJ" * 150_000, "token " * 200_000, "a" * 2_000_000, "password" + " " * 2_000_000, "AKIA" * 300_000, "|" * 1_000_000])
def test_long_texts_are_scanned_in_linear_time(text):
    from time import monotonic

    start = monotonic()
    secrets.Scanner(tuple(RULES))([text])
    assert monotonic() - start < 10


def test_new_rules_read_candidates_only(spark, real, sf, monkeypatch):
    """Against a scan of everything; what isn't in a candidate block isn't read."""
    import re

    monkeypatch.setattr(secrets, "BLOCKS", 64)
    docs = table(spark, sf, "documents")
    index = secrets.Index(docs.unionByName(docs.limit(1).select(*[F.lit("one zyzzyva-77x here").alias(c) if c == "text" else F.lit(-5).cast("long").alias(c) if c == "doc_id" else F.col(c) for c in docs.columns])))
    assert secrets.find_secrets(docs).count() == len(real)
    rule = secrets.Rule("new", r"zyzzyva-[0-9]+x?")
    assert [tuple(r) for r in index.search(rule).collect()] == [(-5, "new:4:15")]
    blocks = index.table.where("kind = 'doc'").select("grp", "block").distinct().count()
    assert index.candidates(rule).count() == 1 < blocks
    other = secrets.Rule("new", r"[a-z]*(?:tion|ment)\b")
    want = {(i, ",".join(f"new:{m.start()}:{m.end()}" for m in re.finditer(other.pattern, t or ""))) for i, t, _ in real}
    assert {tuple(r) for r in index.search(other).collect() if r.doc_id != -5} == {w for w in want if w[1]}
    assert secrets.Index(docs.limit(0)).search(rule).count() == 0
