"""What the operators of this subpackage share: the shared scratch folder, tables
written there to cut lineage, joins whose broadcast side has a checked size, and a
bound on the rows of one Arrow batch."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The characters that separate words, as the inside of a character class and as a string.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A join side is broadcast up to so many rows of a few numbers (some 10 MB as a hash table).
BROADCAST_ROWS = 200_000
#: Bytes that are handed to a Python worker at once.
BATCH_BYTES = 8 << 20
#: The setting by which Spark deletes a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share. Only where that
    is unset (tests in local mode) a temporary folder takes its place."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = known.get() if known.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='quadspark-')}"
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/quadspark-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone at exit
        pass


def written(df: DataFrame) -> DataFrame:
    """df, evaluated once, from a Parquet table in the shared folder. Lost executors then
    cost no more than the tasks they ran. Its shuffle files go at once: nothing reads them
    again, but they would stay until the driver happens to collect its garbage."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the table of a written() result that nothing will read again."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/quadspark-" in folder:
            _delete(df.sparkSession, folder)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df (written already, narrow), marked for broadcasting only if it has few rows. Beyond
    that Spark shuffles both sides, and splits skewed partitions."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def marked(rows: DataFrame, keys: DataFrame, key: str, least: int = 15, most: int = 29, each: int = 64) -> DataFrame:
    """rows with a column marked: true where the long column key is one of the keys' (written already),
    and, by chance, of few others. From a broadcast bitmap of `each` bits a key, between 2 ** least and
    2 ** most bits, in pieces of 4 KB."""
    bits = min(most, max(least, (each * keys.count()).bit_length()))
    place = F.pmod(F.col(key), F.lit(1 << bits))
    pieces = written(keys.groupBy(F.bitmap_bucket_number(place).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_bits")))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (at % 8 + 1).cast("int"))) != 0
    joined = rows.withColumn("_bucket", F.bitmap_bucket_number(place)).join(F.broadcast(pieces), "_bucket", "left")
    return joined.withColumn("marked", F.coalesce(bit, F.lit(False))).drop("_bucket", "_bits")


def bounded_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Bounds what is handed to a Python worker at once, by bytes: texts may be very long."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(key).rstrip("bB")) <= most:
        spark.conf.set(key, str(most))


def let(value: Column, body) -> Column:
    """body(x) with x bound to value, which is evaluated once a row however often body uses it."""
    return F.transform(F.array(value), body)[0]


def row_key(*columns: Column) -> list[Column]:
    """128 bits that identify a row by content, nulls included. Rows that agree in all of
    the columns agree in it, whatever task makes it."""
    flags = [c.isNull() for c in columns]
    return [F.xxhash64(*columns, *flags).alias("_r1"), F.xxhash64(F.lit(0x5BD1E995), *flags, *columns).alias("_r2")]


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text is a multiple of folds; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def training_labels(labels: DataFrame, column: str, rows: int) -> DataFrame:
    """(doc_id, label) of at most rows labelled documents outside the held-out fold, chosen by
    a hash of the id, so that the same rows come whatever the partitions. A document with
    several labels counts with the largest; null labels don't count."""
    known = labels.select("doc_id", F.col(column).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def training_rows(docs: DataFrame, labels: DataFrame, column: str, rows: int, chars: int) -> DataFrame:
    """(of, label 0 or 1, text) of labelled documents: at most rows of them, with at most chars
    characters in all, in the order of training_labels (of equal ids the shorter text first)."""
    chosen = training_labels(labels, column, rows).withColumnRenamed("doc_id", "of")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    found = written(texts.join(F.broadcast(chosen), F.col("id") == F.col("of")).select("of", (F.col("label") > 0).cast("int").alias("label"), "text"))
    sizes = found.select("of", F.char_length("text").cast("long").alias("n"), F.xxhash64("text").alias("h")).distinct()
    order = Window.orderBy(F.xxhash64("of"), "of", "n", "h").rowsBetween(Window.unboundedPreceding, 0)  # of rows texts, or few more
    kept = sizes.withColumn("sum", F.sum("n").over(order)).where(F.col("sum") <= chars).select(F.col("of").alias("o"), "h")
    return found.join(F.broadcast(kept), (F.col("of") == F.col("o")) & (F.xxhash64("text") == F.col("h")), "left_semi")
