"""From recognised words to glossary entries, as one plan without Python functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from termloom.functions.text import SUBJECTS, clean_definition, clean_word, cut_term, subject_code
from termloom.operators.layout import bucket
from termloom.operators.store import drop_contained

#: fixed values: pixels of a line, gap between entries, and the columns' edges
LINE, GAP = 30, 90
ENGLISH_END, SUBJECT_END, TERM_END, DEFINITION_START = 850, 1100, 1400, 1460


def lines(words: DataFrame, keys: list[str]) -> DataFrame:
    """The four columns of each line, as a head line and as a continuation has them."""
    w = words.withColumn("line", bucket(F.col("top"), LINE)).withColumn("clean", clean_word(F.col("text"))).where(F.col("clean") != "")
    x = F.col("left")
    texts = lambda cond, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("left", "seq", "clean")))), lambda s: s["clean"]), sep)
    return w.groupBy(*keys, "line").agg(
        texts(x < ENGLISH_END, " ").alias("english"), texts((x >= ENGLISH_END) & (x < SUBJECT_END), " ").alias("subject_text"),
        texts((x >= SUBJECT_END) & (x < TERM_END), "").alias("head_term"), texts((x >= SUBJECT_END) & (x < DEFINITION_START), "").alias("more_term"),
        texts(x >= DEFINITION_START, "").alias("definition"),
    )


def entries(words: DataFrame, keys: list[str]) -> DataFrame:
    """An entry begins at a line with English and a subject, at the first line with English, or at one after a gap."""
    w = W.partitionBy(*keys).orderBy("line")
    run = w.rowsBetween(W.unboundedPreceding, 0)
    line = lines(words, keys).withColumn("subject", subject_code(F.col("subject_text")))
    seen = F.sum(F.when(F.col("english") != "", 1).otherwise(0)).over(run)
    start = (F.col("english") != "") & ((F.col("subject") != "") | (seen == 1) | F.coalesce(F.col("line") - F.lag("line").over(w) > GAP, F.lit(False)))
    line = line.withColumn("head", start).withColumn("entry", F.sum(start.cast("int")).over(run)).where("entry > 0")
    ordered = lambda value, keep=None: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("line", value.alias("v"))) if keep is not None else F.struct("line", value.alias("v")))), lambda s: s["v"]), "")
    english = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("english") != "", F.struct("line", "english")))), lambda s: s["english"]), " ")
    return line.groupBy(*keys, "entry").agg(
        english.alias("english"), F.coalesce(F.max_by("subject", F.when(F.col("subject") != "", F.col("line"))), F.lit("")).alias("subject"),
        ordered(F.when(F.col("head"), cut_term(F.col("head_term"))).otherwise(F.col("more_term"))).alias("term"),
        ordered(F.when(F.col("head"), clean_definition(F.col("definition"))).otherwise(F.col("definition"))).alias("definition"),
    )


def new_terms(words: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Valid entries that neither the table nor an earlier entry has: same term, and a name that contains theirs."""
    found = entries(words, keys).where(F.col("subject").isin(SUBJECTS)).withColumn("order", F.struct(*keys, "entry"))
    own = drop_contained(found, "term", "english", "order").drop("order")
    old = stored.select(F.col("target_term").alias("__t"), F.lower("source_term").alias("__s"), F.lower("target_term").alias("__l"))
    name = F.lower("english")
    fresh = own.join(old, (F.col("term") == F.col("__t")) & (F.col("__s").contains(name) | F.col("__l").contains(name)), "left_anti")
    return fresh.select(F.col("english").alias("source_term"), F.lit("en").alias("source_language"), F.col("term").alias("target_term"), F.lit("bo").alias("target_language"), F.col("subject").alias("context"), F.lit(None).cast("string").alias("contributor"), F.col("definition").alias("notes"))
