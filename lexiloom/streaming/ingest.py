"""The corpus pipeline over a stream of texts: atoms, duplicates within a watermark, held-out texts, counts by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.atoms import corpus_atom_count, squeeze
from ..operators.corpus import digest


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """A stream of (at, text) from Parquet files that arrive in a folder."""
    return spark.readStream.schema("at timestamp, text string").parquet(path)


def clean_stream(texts: DataFrame, held_out: DataFrame, least: int, most: int, delay: str = "1 hour") -> DataFrame:
    """(at, text, digest, n_atoms) of texts of least..most atoms that aren't held out, once each within the delay; later copies go."""
    rows = texts.withWatermark("at", delay).select("at", squeeze(F.col("text")).alias("text"))
    rows = rows.withColumn("digest", digest(F.col("text"))).withColumn("n_atoms", corpus_atom_count(F.col("text"))).where(F.col("n_atoms").between(least, most))
    return rows.join(held_out.select("digest").distinct(), "digest", "left_anti").dropDuplicatesWithinWatermark(["digest"])


def counts_by_window(rows: DataFrame, width: str = "10 minutes") -> DataFrame:
    """(start, n, atoms) by tumbling window of event time."""
    return rows.groupBy(F.window("at", width).alias("w")).agg(F.count("*").alias("n"), F.sum("n_atoms").alias("atoms")).select(F.col("w.start").alias("start"), "n", "atoms")
