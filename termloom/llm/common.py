"""What the operators share: reading tables, work folders and sizes."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: stands for a null id inside the operators; results carry null again
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a temporary one where it is unset and Spark runs in one process (tests)."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not shared:
        shared = spark.sparkContext.getCheckpointDir()
    if not shared and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not shared:
        shared = f"file://{tempfile.mkdtemp(prefix='termloom-')}"
        spark.sparkContext.setCheckpointDir(shared)
    return shared


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends there, and any executor can read it again."""
    spark = df.sparkSession
    path = f"{work_dir(spark).rstrip('/')}/termloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that ``written`` made and nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if folder.getName().startswith("termloom-"):
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def total_bytes(df: DataFrame, column: str) -> int:
    return int(df.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0)


def parts_for(n_bytes: int, each: int, least: int = 8) -> int:
    """How many buckets of about ``each`` bytes hold ``n_bytes``; grows with the input, without a cap."""
    return max(least, -(-n_bytes // each))


def id_column(name: str) -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def numbered(docs: DataFrame, id_col: str, text_col: str, key: str = "__tl_doc") -> tuple[DataFrame, DataFrame | None]:
    """``docs`` with a column ``key`` that rows share only if id and text are equal, in the order of the ids.

    The key is the id itself where no id, null among them, has two texts.  Else it is
    the row number of (id, hashes of the text) in order, and the second result is
    (key, id); the numbered documents are written, so that a row's number is found once.
    """
    body = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    marks = {"__tl_id": id_column(id_col), "__tl_h1": F.xxhash64(body), "__tl_h2": F.xxhash64(F.lit(1), body)}
    found = docs.select(*(c.alias(name) for name, c in marks.items()))
    differs = (F.min("__tl_h1") != F.max("__tl_h1")) | (F.min("__tl_h2") != F.max("__tl_h2"))
    if found.groupBy("__tl_id").agg(differs.alias("differs")).where("differs").isEmpty():
        return docs.withColumn(key, id_column(id_col)), None
    order = found.distinct().orderBy(*marks)
    numbers = written(order.withColumn(key, F.monotonically_increasing_id()), "numbers")
    out = written(docs.withColumns(marks).join(numbers, list(marks)).select(*docs.columns, key), "numbered")
    return out, numbers.select(key, F.col("__tl_id").alias("id"))


#: most rows and bytes that Arrow hands to Python at once
BATCH_ROWS, BATCH_BYTES = 500, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's bounds of a batch to BATCH_ROWS and BATCH_BYTES, so that very long texts don't fill a worker.

    The settings stay, as a plan reads them when it runs; smaller ones are left alone.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = re.sub(r"b$", "", spark.conf.get(key, str(2 * most)))
        if not now.isdigit() or int(now) <= 0 or int(now) > most:
            spark.conf.set(key, str(most))


def trim() -> None:
    """Gives freed memory back to the system; workers live on from task to task."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass
