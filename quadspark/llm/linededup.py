"""Line dedup, in DataFrame functions only.

Explode normalised lines, hash, count distinct documents per hash, drop lines over the
threshold, and reassemble by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadspark.llm.common import LOWER, SPACES, UPPER, let, row_key, small_side, written


def line_key(line: Column) -> Column:
    """A line without white space at its ends, ASCII letters lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


def _occurrences(rows: DataFrame, min_chars: int) -> DataFrame:
    """(_r1, _r2, doc_id, pos, _k1, _k2): each line whose key is long enough, with its key's 128-bit hash."""
    lines = rows.select("_r1", "_r2", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    long = lines.where(F.char_length(F.btrim("line", F.lit(SPACES))) >= min_chars)  # lower-casing keeps the length
    return long.withColumn("key", line_key(F.col("line"))).select("_r1", "_r2", "doc_id", "pos", F.xxhash64("key").alias("_k1"), F.xxhash64(F.lit(1), "key").alias("_k2"))


def repeated_lines(rows: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(_k1, _k2, keeper): keys that at least min_docs documents hold. The distinct count is
    taken in two steps, each with map-side sums, so a line of very many documents is no hot task."""
    found = _occurrences(rows, min_chars).groupBy("_k1", "_k2").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("keeper"))
    return found.where(F.col("n") >= min_docs).drop("n")


def drop_repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """All columns of docs but text as struct rest, with text (as it was), kept_text, n_lines,
    n_dropped. A row a row.

    A null or empty text is one empty line (kept_text "", text stays null). Rows whose doc_id
    is null don't count as documents that hold a line, but lose their repeated lines.
    Repeated rows lose or keep the same lines; all rows of the largest doc_id keep theirs.
    An empty table gives an empty result. Other columns are carried in rest, whatever their names.
    """
    rest = F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != "text"])
    rows = docs.select(rest.alias("rest"), F.col("doc_id").alias("doc_id"), F.col("text").alias("was"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("*", *row_key(F.col("doc_id"), F.col("text")))
    narrow = rows.select("_r1", "_r2", "doc_id", "text")
    repeated = written(repeated_lines(narrow, min_chars, min_docs))
    gone = _occurrences(narrow, min_chars).join(small_side(repeated), ["_k1", "_k2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    gone = gone.groupBy("_r1", "_r2").agg(F.collect_set("pos").alias("gone"))  # at most the lines of one text

    def without(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
        return F.array_join(F.transform(left, lambda at: F.get(lines, at)), "\n")

    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(let(F.split("text", "\n", -1), without))
    joined = rows.drop("doc_id").join(gone, ["_r1", "_r2"], "left")
    return joined.select(
        "rest",
        F.col("was").alias("text"),
        kept.alias("kept_text"),
        (F.char_length("text") - F.char_length(F.translate("text", "\n", "")) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def line_dedup_digest(docs: DataFrame) -> DataFrame:
    out = drop_repeated_lines(docs.select("doc_id", "text"))
    return out.select(F.col("rest.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def line_dedup_stage(docs: DataFrame) -> DataFrame:
    """docs with the kept lines as text (null stays null) and n_chars, where there is one, of them."""
    out = drop_repeated_lines(docs)
    text = F.when(F.col("text").isNotNull(), F.col("kept_text"))
    new = {"text": text, "n_chars": F.when(F.col("text").isNull() | (F.col("n_dropped") == 0), F.col("rest.n_chars")).otherwise(F.char_length(text).cast("long"))} if "n_chars" in docs.columns else {"text": text}
    return out.select(*[(new[c] if c in new else F.col("rest").getField(c)).alias(c) for c in docs.columns])


LINE_DEDUP_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, i, lines[i + 1] AS line,
        translate(trim(lines[i + 1], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
      FROM (SELECT doc_id, string_split(text, chr(10)) AS lines, unnest(range(len(string_split(text, chr(10))))) AS i FROM d)),
r AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5)
SELECT l.doc_id, count(*)::BIGINT AS n_lines,
  (count(*) FILTER (WHERE r.k IS NOT NULL AND l.doc_id <> r.keeper))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE r.k IS NULL OR l.doc_id = r.keeper), '')) AS kept_sha256
FROM l LEFT JOIN r ON l.k = r.k GROUP BY l.doc_id
"""
