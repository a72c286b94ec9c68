"""Mixing sources to target weights: pivotal dependent rounding.

A source's documents all start with the same fractional number of copies, target / size of
the source. Whole copies are certain; the fractions are rounded together. Two documents are
paired and mass (words) moves from one to the other, in a random direction whose odds keep
both expectations, until one fraction is 0 or 1. So the words a source gives stay at its
target but for one last fraction. Documents are paired in leaves of bounded size first; each
leaf leaves one residual at most, and the residuals are combined by a tree of further rounds.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadspark.llm.common import SPACE_CLASS, bounded_batches, row_key, small_side, written

#: Weights of the sources by code point, null last, repeating; the share of all words that is
#: taken; the most copies of a document.
WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
#: Documents of one leaf, and residuals that one later round combines.
LEAF, FAN = 1024, 64
#: Equal rows that one task makes at once, and groups that a row's repetitions are split into for numbering.
PIECE, SALTS = 1 << 16, 64
#: A fraction nearer to 0 or 1 counts as that.
TINY = 1e-9
WORD = f"[^{SPACE_CLASS}]+"


def water_fill(sizes: list[int], weights: list[float], total: float, most: float = MOST) -> list[float]:
    """Targets that share total by weight; those above most times their size stop there and
    the others share the excess by weight, until none is above. What no source can take is dropped."""
    targets, open_, left = [0.0] * len(sizes), set(range(len(sizes))), total
    while open_:
        weight = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / weight > most * sizes[i]}
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / weight
            break
        for i in over:
            targets[i] = most * sizes[i]
            left -= targets[i]
        open_ -= over
    return targets


def pivot(words: np.ndarray, part: np.ndarray, draws: np.ndarray) -> None:
    """Rounds the fractions in part, in place, in the order given; at most one stays between
    0 and 1. words > 0. One draw a document."""
    held = -1
    for i in range(len(words)):
        if not TINY < part[i] < 1 - TINY:
            part[i] = round(part[i])
            continue
        if held < 0:
            held = i
            continue
        a, b = words[held] * part[held], words[i] * part[i]
        up = min(words[held] - a, b)  # words that can move to the one held
        down = min(a, words[i] - b)  # and from it
        move = up if draws[i] * (up + down) < down else -down
        part[held], part[i] = (a + move) / words[held], (b - move) / words[i]
        if not TINY < part[held] < 1 - TINY:
            part[held] = round(part[held])
            held = i
        if not TINY < part[i] < 1 - TINY:
            part[i] = round(part[i])
            held = -1 if held == i else held


def _draws(keys: np.ndarray, seed: int, level: int) -> np.ndarray:
    """Uniform numbers from the rows' own keys, so that reruns agree."""
    x = keys.astype(np.uint64) ^ np.uint64((seed * 1_000_003 + level * 7919) & (2**63 - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / 2**53


def _round_leaf(seed: int, level: int, last: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_r1", "_r2"], kind="stable", ignore_index=True)
        words, part = rows["size"].to_numpy(np.float64), rows["part"].to_numpy(np.float64).copy()
        draws = _draws(rows["_r1"].to_numpy(), seed, level)
        pivot(words, part, draws)
        if last:
            open_ = (part > 0) & (part < 1)
            part[open_] = (draws[open_] < part[open_]).astype(float)
        return rows.assign(part=part)

    return run


def plan_copies(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 42) -> DataFrame:
    """Per different row of rows (doc_id, source, size, _r1, _r2): n (how often it is there), ups,
    floor_copies, source_size, target. Of the n equal rows, ups have one copy more than floor_copies.

    Equal rows are summed up first: n rows of fraction f are floor(n f) whole copies and one
    fraction that is rounded with the others, so a row of very many copies is one row here."""
    spark = rows.sparkSession
    equal = written(rows.groupBy("doc_id", "source", "size", "_r1", "_r2").agg(F.count(F.lit(1)).alias("n")))
    by_source = sorted(((r["source"], r["size"], r["n"]) for r in equal.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size"), F.count(F.lit(1)).alias("n")).collect()), key=lambda r: (r[0] is None, r[0] or ""))
    targets = water_fill([r[1] for r in by_source], [weights[i % len(weights)] for i in range(len(by_source))], share * sum(r[1] for r in by_source), most)
    plan = spark.createDataFrame(
        [(s, size, float(t), min(most, t / size) if size else 0.0, max(1, math.ceil(n / LEAF))) for (s, size, n), t in zip(by_source, targets, strict=True)],
        "of string, source_size long, target double, rate double, leaves long",
    )
    part = F.when(F.col("size") > 0, F.col("rate") - F.floor("rate")).otherwise(0.0)
    planned = equal.join(small_side(plan), equal["source"].eqNullSafe(F.col("of"))).drop("of").withColumn("mass", F.col("n") * part)
    planned = planned.withColumn("whole", F.floor(F.col("mass") + TINY))
    at = planned.select("source", "_r1", "_r2", "size", (F.col("mass") - F.col("whole")).alias("part"), F.pmod(F.xxhash64("_r1", "_r2"), F.col("leaves")).alias("leaf")).where(f"part > {TINY}")
    leaves, level = max([1, *(math.ceil(r[2] / LEAF) for r in by_source)]), 0
    ups = planned.where("whole > 0").select("_r1", "_r2", F.col("whole").cast("long").alias("ups"))
    while True:
        last = leaves == 1
        out = written(at.groupBy("source", "leaf").applyInPandas(_round_leaf(seed, level, last), "source string, _r1 long, _r2 long, size long, part double, leaf long"))
        ups = ups.unionByName(out.where("part >= 1").select("_r1", "_r2", F.lit(1).cast("long").alias("ups")))
        if last:
            break
        leaves, level = math.ceil(leaves / FAN), level + 1
        at = out.where("part > 0 AND part < 1").withColumn("leaf", F.floor(F.col("leaf") / FAN))
    ups = ups.groupBy("_r1", "_r2").agg(F.sum("ups").alias("ups"))
    return planned.join(ups, ["_r1", "_r2"], "left").select("doc_id", "source", "size", "_r1", "_r2", "n", F.coalesce("ups", F.lit(0)).alias("ups"), F.floor("rate").cast("long").alias("floor_copies"), "source_size", "target")


def _sized(docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("source"), size, *row_key(F.col("doc_id").cast("long"), F.col("source"), F.col("text")))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 42) -> DataFrame:
    """Per row of docs: doc_id, source, size, source_size, target (the source's), copies, taken =
    copies * size.

    size counts words; a null text has none. A source's number of copies is target / size of
    the source, at most `most`; documents without words take as many whole copies as that has
    (they move no mass). Null is a source of its own, the last one. Of repeated rows as many go
    up as their fractions give together; an empty table gives an empty result; very long texts
    are counted whole. Source names are held on the driver: they are few; documents never are."""
    bounded_batches(docs.sparkSession)
    planned = written(plan_copies(written(_sized(docs)), weights, share, most, seed))
    big = planned.where(F.col("n") > PIECE)
    pieces = planned.where(F.col("n") <= PIECE).select("*", F.lit(0).cast("long").alias("low"))
    if not big.isEmpty():  # rows of very many equal ones are made by many tasks
        pieces = pieces.unionByName(big.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(PIECE))).alias("low")).repartition("_r1", "low"))
    nth = F.explode(F.sequence(F.col("low"), F.least(F.col("low") + PIECE, F.col("n")) - 1))
    out = pieces.select("*", nth.alias("nth")).withColumn("copies", F.col("floor_copies") + F.when(F.col("nth") < F.col("ups"), 1).otherwise(0))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix_digest(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


def mix_stage(docs: DataFrame) -> DataFrame:
    """docs, each row as often as the mix takes it. Copies are planned on a narrow table and joined
    once. Only rows that repeat another one are numbered, in groups that a random number splits."""
    bounded_batches(docs.sparkSession)
    planned = written(plan_copies(written(_sized(docs))).select("_r1", "_r2", "n", "ups", "floor_copies"))
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), *row_key(F.col("doc_id").cast("long"), F.col("source"), F.col("text")))
    joined = rows.join(small_side(planned), ["_r1", "_r2"])
    single = joined.where("n = 1").select("row", (F.col("floor_copies") + F.col("ups")).alias("copies"))
    if not planned.where("n > 1").isEmpty():
        again = written(joined.where("n > 1").withColumn("salt", F.floor(F.rand(1) * SALTS)))
        key = ["_r1", "_r2"]
        counts = again.groupBy(*key, "salt").agg(F.count(F.lit(1)).alias("here"))
        before = F.coalesce(F.sum("here").over(Window.partitionBy(*key).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        offsets = written(counts.select(*key, "salt", before.alias("before")))
        nth = F.col("before") + F.row_number().over(Window.partitionBy(*key, "salt").orderBy("salt"))
        numbered = again.join(small_side(offsets), [*key, "salt"]).withColumn("nth", nth)
        single = single.unionByName(numbered.select("row", (F.col("floor_copies") + F.when(F.col("nth") <= F.col("ups"), 1).otherwise(0)).alias("copies")))
    return single.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("row.*")
