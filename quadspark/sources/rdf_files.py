"""RDF files and strings as DataFrames of quads.

N-Triples and N-Quads are read line by line with Spark's text reader and column expressions, so
large files are split. Other formats are parsed file by file on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadspark.functions.calls import parse_n3
from quadspark.sources.quads import QUADS, rows
from quadspark.sources.rdf_text import EXTENSIONS, parse
from quadspark.terms import BNODE, term_col

_TERM = r'<[^>]*>|_:[^\s<"]+|"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?|<<\(.*\)>>'
_LINE = rf"^\s*({_TERM})\s+<([^>]*)>\s+({_TERM})\s*(<[^>]*>|_:\S+)?\s*\.\s*(?:#.*)?$"


def read_lines(spark: SparkSession, path: str, lenient: bool = False) -> DataFrame:
    """N-Triples or N-Quads. A line that is no quad, comment or blank is an error; lenient: it is
    left out, and read_bad_lines shows it."""
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"))
    if not lenient:
        bad = F.raise_error(F.concat(F.lit("no quad: "), F.substring("value", 1, 200), F.lit(" in "), F.col("file"))).cast("boolean")
        lines = lines.where(F.when(F.col("value").rlike(_LINE), True).when(F.col("value").rlike(r"^\s*(#.*)?$"), False).otherwise(bad))
    part = lambda i: F.regexp_extract("value", _LINE, i)

    def scoped(t):  # noqa: ANN001, ANN202
        """Blank node labels belong to their file."""
        return F.when(t["k"] == BNODE, term_col(BNODE, F.concat(F.lit("f"), F.substring(F.md5("file"), 1, 10), F.lit("x"), t["v"]))).otherwise(t)

    found = lines.where(F.col("value").rlike(_LINE)).select(parse_n3(part(1)).alias("s"), part(2).alias("p"), parse_n3(part(3)).alias("o"), F.regexp_replace(part(4), "^<|>$", "").alias("g"), "file")
    return found.select(scoped(F.col("s")).alias("s"), "p", scoped(F.col("o")).alias("o"), "g")


def read_bad_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(~F.col("value").rlike(_LINE) & ~F.col("value").rlike(r"^\s*(#.*)?$"))


def read_rdf(spark: SparkSession, path: str | list[str], media_type: str | None = None, base: str | None = None, lenient: bool = False, attribute: bool = False) -> DataFrame:
    """Quads of a file, folder or glob, or of several, which are then one source. The format is
    told by media_type or each file's extension. lenient: broken files give nothing rather than
    an error. attribute: with a column source, the path a quad was asked for by."""
    if isinstance(path, list):
        out = None
        for p in path:
            df = read_rdf(spark, p, media_type, base, lenient, attribute)
            out = df if out is None else out.unionByName(df)
        return out
    if attribute:
        return read_rdf(spark, path, media_type, base, lenient).withColumn("source", F.lit(path))
    kind = media_type or EXTENSIONS.get(path.rsplit(".", 1)[-1].lower())
    if kind in ("application/n-triples", "application/n-quads"):
        return read_lines(spark, path, lenient)
    files = spark.read.format("binaryFile").load(path).select("path", F.col("content").cast("string").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, text in zip(b["path"], b["text"], strict=True):
                how = media_type or EXTENSIONS.get(p.rsplit(".", 1)[-1].lower(), "text/turtle")
                yield _frame(text, how, base or p, lenient)

    return files.mapInPandas(run, QUADS)


def _frame(text: str, media_type: str, base: str | None, lenient: bool) -> pd.DataFrame:
    try:
        found = parse(text, media_type, base)
    except Exception:
        if not lenient:
            raise
        found = []
    cell = lambda t: {"k": t.k, "v": t.v, "dt": t.dt, "lang": t.lang, "dir": t.dir}
    columns = {"s": [cell(q[0]) for q in found], "p": [q[1] for q in found], "o": [cell(q[2]) for q in found], "g": [q[3] for q in found]}
    return pd.DataFrame({k: pd.Series(v, dtype=object) for k, v in columns.items()})


def read_column(df: DataFrame, text: str, media_type: str = "text/html", base: str | None = None) -> DataFrame:
    """Quads of the documents in a column, such as the html of `pages`; base: a column of their addresses."""
    chosen = df.select(F.col(text).alias("text"), (F.col(base) if base else F.lit(None).cast("string")).alias("base")).where("text IS NOT NULL")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for t, at in zip(b["text"], b["base"], strict=True):
                yield _frame(t, media_type, at, True)

    return chosen.mapInPandas(run, QUADS)


def from_text(spark: SparkSession, text: str, media_type: str = "text/turtle", base: str | None = None) -> DataFrame:
    """Quads of a small document, parsed on the driver."""
    return rows(spark, parse(text, media_type, base))
