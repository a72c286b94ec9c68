"""The operators' queries over whole tables, and DuckDB SQL for those that SQL can express."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quadspark.llm import linededup, media, mixing, packing, quality, secrets, simhash, sketch, toxicity, warc
from quadspark.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_salvage": lambda spark, d: warc.archive_pages(table(spark, d, "pages")),
    "op2_toxicity_deobfuscation": lambda spark, d: toxicity.toxicity(table(spark, d, "documents"), table(spark, d, "labels")),
    "op3_pivotal_mixing": lambda spark, d: mixing.mix_digest(table(spark, d, "documents")),
    "op4_line_dedup": lambda spark, d: linededup.line_dedup_digest(table(spark, d, "documents")),
    "op5_scaled_sketch": lambda spark, d: sketch.fingerprints(table(spark, d, "documents")),
    "op6_concat_and_cut": lambda spark, d: packing.pack(table(spark, d, "documents")),
    "op7_simhash_pigeonring": lambda spark, d: simhash.near_duplicates_digest(table(spark, d, "documents")),
    "op8_media_chunks": lambda spark, d: media.media_features(table(spark, d, "documents")),
    "op9_quality_machine": lambda spark, d: quality.quality(table(spark, d, "documents"), table(spark, d, "labels")),
    "op10_secret_trigrams": lambda spark, d: secrets.find_secrets(table(spark, d, "documents")),
}

ORACLE_SQL: dict[str, str] = {"op1_warc_salvage": warc.ARCHIVE_SQL, "op4_line_dedup": linededup.LINE_DEDUP_SQL}
