"""Sharding by jump consistent hashing; DataFrame functions only.

The law is ``key``: doc_id and the number of shards alone decide.  A key jumps
along a rising chain of shard numbers, and its shard is the last one below the
number of shards; with one more shard it stays or jumps into the new one.  The
chain needs no ring table: its random numbers are ``xxhash64(doc_id, step)``.

Slots are numbered inside (shard, salt) first and then moved by the counts of
the salts before, so that no task sorts a whole shard, nor all rows of one doc_id.  A
shard has at least SALTS salts, and one for about each SALT_ROWS rows; the counts have
a row for each.  The texts are read once, for their sizes and checksums, which are written.

Results for odd input: null text has size 8 and the checksum of no bytes; all
null ids share a shard; repeated rows get a slot each; an empty table gives no
rows; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from termloom.llm.common import parts_for, table, written

SHARDS, SALTS, SALT_ROWS = 24, 64, 1 << 18


def jump_chain(key: str, most: int) -> Column:
    """The numbers below ``most`` that the key jumps to, in rising order, from 0."""
    step = f"cast(floor((element_at(c, -1) + 1) * (2147483648D / (shiftrightunsigned(xxhash64({key}, i), 33) + 1))) as bigint)"
    return F.expr(f"filter(aggregate(sequence(1, {most}), array(0L), (c, i) -> if(element_at(c, -1) < {most}, concat(c, array({step})), c)), x -> x < {most})")


def shard_rows(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row."""
    body = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    salts = parts_for(-(-docs.count() // shards), SALT_ROWS, SALTS)
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    rows = rows.withColumn("chain", jump_chain("doc_id", shards + 1))
    shard = F.element_at(F.filter("chain", lambda x: x < shards), -1).cast("int")
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int")
    rows = written(rows.select("doc_id", "size", "text_crc32", shard.alias("shard"), F.element_at("chain", -1).cast("int").alias("grown_shard"), salt.alias("salt")), "shards")
    counts = rows.groupBy("shard", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("shard").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("shard", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = W.partitionBy("shard", "salt").orderBy("doc_id", "text_crc32")
    return (
        rows.withColumn("rank", F.row_number().over(within) - 1)
        .join(F.broadcast(starts), ["shard", "salt"])  # a row for each of SALT_ROWS rows, and shards * SALTS at least
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("rank")).cast("long").alias("slot"), "grown_shard")
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))
