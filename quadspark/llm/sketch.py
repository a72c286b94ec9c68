"""Document fingerprints, in DataFrame functions only: a threshold-scaled sketch.

Every shingle hash below a fixed fraction of the hash range is retained, whatever the text's
length. Two sketches of very unequal documents then hold the same part of what the documents
share, so containment can be estimated, and the union of two sketches is the sketch of both
texts together. A fingerprint is the hash of the text's whole word sequence, by which equal texts
are told whatever was retained, and then the sketch.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadspark.llm.common import SPACE_CLASS, let, written

SHINGLE_WORDS = 5
FRACTION = 1 / 4
#: Documents of one range bucket, and the most buckets there are.
BUCKET_ROWS, MOST_BUCKETS = 1000, 20_000


def sketch(text: Column, words: int = SHINGLE_WORDS, fraction: float = FRACTION) -> Column:
    """struct(whole, marks): a hash of the text's words, and the sorted array of the retained 63-bit
    hashes of its word shingles. A text of fewer words is one shingle; none has no marks."""
    below = int(fraction * 2**63)

    def of(w: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(w) - (words - 1), F.lit(1)))
        hashes = F.when(F.size(w) > 0, F.transform(at, lambda i: F.shiftrightunsigned(F.xxhash64(F.slice(w, i, words)), 1))).otherwise(F.array().cast("array<bigint>"))
        return F.struct(F.xxhash64(w).alias("whole"), F.sort_array(F.array_distinct(F.filter(hashes, lambda x: x < below))).alias("marks"))

    return let(F.filter(F.split(F.lower(text), f"[{SPACE_CLASS}]+"), lambda x: x != ""), of)


def likeness(a: Column, b: Column) -> Column:
    """struct(jaccard, contained): estimates of the shared part of both documents' shingles, and of
    the part of a's that b has. Equal word sequences are alike (1); others of which nothing was
    retained aren't (0)."""

    def shares(n: Column) -> Column:
        both, x, y, same = (n.getField(k) for k in ("both", "x", "y", "same"))
        jaccard = F.when(same, 1.0).otherwise(both / F.greatest(x + y - both, F.lit(1)))
        return F.struct(jaccard.alias("jaccard"), F.when(same, 1.0).otherwise(both / F.greatest(x, F.lit(1))).alias("contained"))

    x, y = a["marks"], b["marks"]
    return let(F.struct(F.size(F.array_intersect(x, y)).alias("both"), F.size(x).alias("x"), F.size(y).alias("y"), (a["whole"] == b["whole"]).alias("same")), shares)


def merged(a: Column, b: Column) -> Column:
    """The marks of two documents together, from their sketches."""
    return F.sort_array(F.array_union(a["marks"], b["marks"]))


def as_text(s: Column) -> Column:
    digits = lambda x: F.lpad(F.hex(x), 16, "0")
    return F.lower(F.concat(digits(s["whole"]), F.array_join(F.transform(s["marks"], digits), "")))


def with_next(docs: DataFrame, value: Column, columns: list[str], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds following: value of the next document, ascending doc_id (nulls first, equal ids by
    a hash of the value), and of the first one after the last.

    No window over the whole table: ids are cut into ranges of some bucket_rows rows at
    quantiles, each range is sorted by itself, and the first document of each range is also dealt
    to the range before (that of the first to the last). The driver sees the quantiles, and the
    plan holds them: a text is shuffled once, to its range. Beyond MOST_BUCKETS ranges they hold
    more rows, and are sorted on disk."""
    rows = docs.select(F.col("doc_id").alias("_id"), *columns, value.alias("_value"))
    ids = docs.select(F.col("doc_id").alias("_id"))
    n = ids.count()
    buckets = min(MOST_BUCKETS, max(1, math.ceil(n / bucket_rows)))
    cuts = ids.agg(F.percentile_approx("_id", [(i + 1) / buckets for i in range(buckets - 1)], 10 * buckets)).first()[0] if buckets > 1 and n else None
    cuts = sorted(set(cuts or []))
    fan = max(1, math.isqrt(len(cuts)))
    groups = [cuts[i : i + fan] for i in range(0, len(cuts), fan)]

    def numbers(x: list) -> Column:
        return F.array(*[F.lit(v).cast("bigint") for v in x]) if x else F.array().cast("array<bigint>")

    def bucket(x: Column) -> Column:
        """Cuts below x: by groups of cuts first, then within one group."""
        if not groups:
            return F.lit(0)
        low = lambda a: F.size(F.filter(a, lambda c: c < x))
        return F.when(x.isNull(), 0).otherwise(let(low(numbers([g[-1] for g in groups])), lambda g: g * fan + low(F.coalesce(F.get(F.array(*[numbers(g) for g in groups]), g), numbers([])))))

    # the first id of each range, and the range before: few narrow rows, which are joined
    firsts = ids.groupBy(bucket(F.col("_id")).cast("int").alias("_at")).agg(F.when(F.max(F.col("_id").isNull()), None).otherwise(F.min("_id")).alias("_first"))
    before = F.coalesce(F.lag("_at").over(Window.orderBy("_at")), F.lit(0))  # of one row for each range
    firsts = written(firsts.withColumn("_before", before).select("_at", "_first", F.when(F.row_number().over(Window.orderBy("_at")) == 1, F.max("_at").over(Window.partitionBy())).otherwise(F.col("_before")).alias("_before")))
    rows = rows.withColumn("_b", bucket(F.col("_id")).cast("int")).join(F.broadcast(firsts), F.col("_b") == F.col("_at"))
    own, copy = F.struct(F.col("_b").alias("b"), F.lit(False).alias("copy")), F.struct(F.col("_before").alias("b"), F.lit(True).alias("copy"))
    rows = rows.withColumn("_to", F.explode(F.when(F.col("_id").eqNullSafe(F.col("_first")), F.array(own, copy)).otherwise(F.array(own)))).drop("_at", "_first", "_before", "_b")
    order = Window.partitionBy("_to.b").orderBy("_to.copy", F.col("_id").asc_nulls_first(), F.xxhash64("_value"))
    rows = rows.withColumn("following", F.lead("_value").over(order)).where(~F.col("_to.copy"))
    return rows.select(*columns, F.col("_value").alias("own"), "following")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, and the containments contained_edited, contained_next.

    A null text is an empty one, very long texts are sketched whole. Equal texts have equal
    fingerprints. The only document of a table is its own next one. Rows with equal doc_id follow each other by a hash of their
    text; an empty table gives an empty result; other columns are not looked at."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).select("doc_id", "text", sketch(F.col("text")).alias("marks"))
    rows = with_next(rows, F.struct("text", "marks"), ["doc_id"])
    n = F.char_length("own.text")
    half = F.shiftright(n, 1)
    edited = F.concat(F.substring(F.col("own.text"), F.lit(1), n - half), F.substring(F.col("following.text"), F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), F.col("own.marks").alias("own"), F.col("following.marks").alias("following"), edited.alias("edited"))
    rows = rows.select("*", sketch(F.col("edited")).alias("changed"))
    rows = rows.select("*", likeness(F.col("own"), F.col("changed")).alias("to_edited"), likeness(F.col("own"), F.col("following")).alias("to_next"))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text(F.col("own")).alias("fingerprint"), as_text(F.col("changed")).alias("edited_fingerprint"),
        F.col("to_edited.jaccard").alias("near_edited"), F.col("to_next.jaccard").alias("near_next"), F.col("to_edited.contained").alias("contained_edited"), F.col("to_next.contained").alias("contained_next"),
    )
