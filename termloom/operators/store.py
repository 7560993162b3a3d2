"""The term table: search, recent, insert, update, delete, and duplicates on the way in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from termloom.schemas import TERMS

#: fixed value: the state of a new term
DRAFT = "draft"
#: parts that new rows are numbered in, at least, and about how many rows each has
PARTS, PART_ROWS = 64, 1 << 20


def open_terms(spark: SparkSession, path: str) -> DataFrame:
    """The term table at ``path``; made empty there if nothing is."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        spark.createDataFrame([], TERMS).write.parquet(path)
    return spark.read.schema(TERMS).parquet(path)


def with_defaults(new: DataFrame, now: str | None = None) -> DataFrame:
    """New terms with the time of adding and the state ``draft`` where they have none."""
    time = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    have = lambda c, kind: F.col(c) if c in new.columns else F.lit(None).cast(kind)
    return new.withColumns({"date_added": F.coalesce(have("date_added", "timestamp"), time), "verified_status": F.coalesce(have("verified_status", "string"), F.lit(DRAFT))})


def search(df: DataFrame, pattern: str, columns: list[str], order: list[Column]) -> DataFrame:
    """Rows of which a column contains the pattern in any case; ``%`` and ``_`` are wildcards."""
    like = F.lit(False)
    for c in columns:
        like = like | F.coalesce(F.lower(c).like(f"%{pattern.lower()}%"), F.lit(False))
    return df.where(like).orderBy(*order)


def recent(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def added_after(df: DataFrame, column: str, cutoff: str, *order: Column) -> DataFrame:
    return df.where(F.col(column) > F.lit(cutoff).cast("timestamp")).orderBy(*order)


def insert(terms: DataFrame, new: DataFrame, required: list[str], id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """(terms with the new rows under ids that follow, rows that lack a required value).

    Ids go by the offsets of parts, so that no task numbers all new rows; the number of
    parts follows the number of rows.
    """
    parts = max(PARTS, -(-new.count() // PART_ROWS))
    missing = F.lit(False)
    for c in required:
        missing = missing | F.col(c).isNull()
    good = new.where(~missing).withColumn("__part", F.pmod(F.xxhash64(*new.columns), F.lit(parts)))
    counts = good.groupBy("__part").count().withColumn("__first", F.coalesce(F.sum("count").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # a row for each part
    top = terms.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("__top"))
    numbered = good.withColumn("__rank", F.row_number().over(W.partitionBy("__part").orderBy(*new.columns))).join(F.broadcast(counts), "__part").crossJoin(F.broadcast(top))
    ready = numbered.withColumn(id_col, (F.col("__top") + F.col("__first") + F.col("__rank")).cast("long"))
    return terms.unionByName(ready.select(*[c for c in terms.columns if c in ready.columns]), allowMissingColumns=True), new.where(missing)


def update(df: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    return df.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def delete(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids, key, "left_anti")


#: letters of the pieces by which names that may contain each other meet
PIECE = 4


def _pieces(name: Column, size: int) -> Column:
    n = F.length(name) - size + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(name, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def drop_contained(df: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """Rows without an earlier one of the same key whose name contains theirs; containment passes on, so this equals a sequential check.

    Names are compared without case, each different one once.  A name meets those that
    hold its rarest piece of PIECE letters (a shorter name is its own piece), so that a
    large group is not compared pair by pair.  Rows with a null key or name stay.
    """
    names = df.select(F.col(key).alias("__k"), F.lower(name).alias("__n"), F.col(order).alias("__o")).where("__k is not null and __n is not null").groupBy("__k", "__n").agg(F.min("__o").alias("__o"))
    n = F.col("__n")
    held = names.select("__k", n.alias("__b"), "__o", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), *[_pieces(n, s) for s in range(1, PIECE + 1)]))).alias("__p"))
    often = held.groupBy("__k", "__p").agg(F.count(F.lit(1)).alias("__c"))
    own = names.select("__k", "__n", F.explode(F.array_distinct(F.when(F.length(n) >= PIECE, _pieces(n, PIECE)).otherwise(F.array(n)))).alias("__p"))
    rarest = own.join(often, ["__k", "__p"]).groupBy("__k", "__n").agg(F.min(F.struct("__c", "__p"))["__p"].alias("__p"))
    first = rarest.join(held, ["__k", "__p"]).where(F.contains("__b", "__n")).groupBy("__k", "__n").agg(F.min("__o").alias("__first"))
    met = df.join(first, (F.col(key) == F.col("__k")) & (F.lower(name) == F.col("__n")), "left")
    return met.where(F.col("__first").isNull() | (F.col(order) <= F.col("__first"))).select(*df.columns)
