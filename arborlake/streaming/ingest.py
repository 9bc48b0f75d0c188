"""Incremental ingest of patch files: new files become hunks, hunks are counted into a table of templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.diffs import hunks


def stream_patches(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """(path, text) of patch files as they arrive in a folder."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).option("wholetext", "true").format("text").load(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def ingest(patches: DataFrame, table: str, checkpoint: str):
    """Appends each new file's hunks to the table at path ``table`` once, and ends when none is left.

    The checkpoint remembers the files; a batch is written under its number,
    so that one that is run again after a failure replaces its own rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        hunks(batch).write.mode("overwrite").parquet(f"{table}/batch={number}")

    query = patches.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def instance_counts(spark: SparkSession, table: str) -> DataFrame:
    """(change, instances): hunks by their changed lines without blanks at the ends, over all batches so far."""
    changed = F.array_join(F.transform(F.filter(F.split("content", "\n"), lambda x: F.substring(x, 1, 1).isin("+", "-")), lambda x: F.concat(F.substring(x, 1, 1), F.trim(F.substring(x, 2, 1 << 20)))), "\n")
    return spark.read.parquet(table).groupBy(changed.alias("change")).agg(F.count("*").alias("instances"))
