"""Page-at-a-time ingest as a stream over a folder of word files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.plans.ingest import entries
from termloom.schemas import TSV_WORDS
from termloom.sources.words import words_of

#: what a file's name ends with if it holds a part of its document only
PART = r"([._-]part\d+)?\.[^./]*$"


def _words(spark: SparkSession, folder: str, reader) -> DataFrame:
    path = F.col("_metadata.file_path")
    return reader.schema(TSV_WORDS).option("sep", "\t").option("header", True).option("quote", "").csv(folder).withColumn("doc", path)


def ingest_stream(spark: SparkSession, folder: str, out: str, checkpoint: str):
    """Starts a query that appends the entries of each new file to ``out`` and ends when all files are read.

    A file is a document; for documents in several files see ``ingest_parts``.
    """
    raw = _words(spark, folder, spark.readStream)

    def write(batch: DataFrame, epoch: int) -> None:
        entries(words_of(batch), ["doc", "page_num"]).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_parts(spark: SparkSession, folder: str, out: str, checkpoint: str, files_at_once: int = 1000):
    """As ``ingest_stream``, for documents in files of several parts (``name.part2.tsv``), a page of which may end in the next file.

    The words of each batch are kept under ``out``, and the entries of every page that
    a batch touches are made anew from all its words; ``ingested`` reads the newest.
    """
    raw = _words(spark, folder, spark.readStream.option("maxFilesPerTrigger", files_at_once))

    def write(batch: DataFrame, epoch: int) -> None:
        own = words_of(batch.withColumn("doc", F.regexp_replace("doc", PART, "")))
        own.write.mode("overwrite").parquet(f"{out}/words/epoch={epoch}")
        every = batch.sparkSession.read.parquet(f"{out}/words").where(F.col("epoch") <= epoch).drop("epoch")
        touched = batch.sparkSession.read.parquet(f"{out}/words/epoch={epoch}").select("doc", "page_num").distinct()
        pages = every.join(touched, ["doc", "page_num"], "left_semi")
        entries(pages, ["doc", "page_num"]).write.mode("overwrite").parquet(f"{out}/entries/epoch={epoch}")

    return raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingested(spark: SparkSession, out: str) -> DataFrame:
    """The entries of each page from the last batch that touched it."""
    words = spark.read.parquet(f"{out}/words").groupBy("doc", "page_num").agg(F.max("epoch").alias("epoch"))
    return spark.read.parquet(f"{out}/entries").join(words, ["doc", "page_num", "epoch"], "left_semi").drop("epoch")


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and sums of a stream of events by time window and type, late rows within a bound included."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
