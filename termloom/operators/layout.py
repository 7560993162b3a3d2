"""Lines and columns from positions: buckets, bands, sessions, clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def bucket(c: Column, size: int) -> Column:
    return (F.floor(c / size) * size).cast("long")


def ordered_text(df: DataFrame, keys: list[str], order: list[str], text: str, sep: str, out: str = "text") -> DataFrame:
    """The texts of each group in order, joined."""
    parts = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("__t"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["__t"]), sep).alias(out))


def band(c: Column, edges: list[tuple[float, str | None]], last: str | None) -> Column:
    """The name of the first band whose upper edge is above the value."""
    out = F.when(c < edges[0][0], F.lit(edges[0][1]))
    for edge, name in edges[1:]:
        out = out.when(c < edge, F.lit(name))
    return out.otherwise(F.lit(last))


def sessions(df: DataFrame, keys: list[str], order: list[str], position: Column, gap, marker: Column | None = None, out: str = "session") -> DataFrame:
    """Numbers runs: a new one begins at a marker or after a gap greater than ``gap``; what precedes the first is 0."""
    w = W.partitionBy(*keys).orderBy(*order)
    start = position - F.lag(position).over(w) > gap
    start = F.coalesce(start, F.lit(marker is None))
    if marker is not None:
        start = start | marker
    return df.withColumn("__s", start.cast("int")).withColumn(out, F.sum("__s").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__s")


def leaders(values: Column, gap) -> Column:
    """The first values of greedy clusters of a sorted array: a value over ``gap`` from its cluster's first begins another."""
    return F.aggregate(values, F.slice(values, 1, 1), lambda acc, x: F.when(x - F.element_at(acc, -1) > gap, F.concat(acc, F.array(x))).otherwise(acc))


def white_columns(df: DataFrame, text: str, width: int | None = None, blank: str = r"\s") -> DataFrame:
    """(position, n): on how many lines a position is ``blank``, a pattern; on whole lines, or up to ``width``."""
    lines = df.select(F.explode(F.split(text, "\n")).alias("line"))
    own = F.col("line") if width is None else F.left("line", F.lit(width))
    places = F.filter(F.transform(F.split(own, ""), lambda ch, i: F.when(ch.rlike(blank), i)), lambda i: i.isNotNull())
    return lines.select(F.explode(places).alias("position")).groupBy("position").agg(F.count(F.lit(1)).alias("n"))


def wide_boundaries(df: DataFrame, text: str, share: float = 0.4, least: int = 2) -> DataFrame:
    """(start, end): runs of ``least`` places or more that are white on ``share`` of the lines.  The places are as many as the longest line has."""
    lines = df.select(F.explode(F.split(text, "\n")).alias("line")).agg(F.count(F.lit(1)).alias("__n"))  # one row
    often = white_columns(df, text).crossJoin(F.broadcast(lines)).where(F.col("n") >= F.greatest(F.lit(1.0), F.col("__n") * share))
    runs = often.withColumn("__g", F.col("position") - F.row_number().over(W.orderBy("position")))
    return runs.groupBy("__g").agg(F.min("position").alias("start"), (F.max("position") + 1).alias("end")).where(F.col("end") - F.col("start") >= least).select("start", "end")


def cut_at(line: Column, starts: Column, ends: Column) -> Column:
    """The columns of a line between boundaries (arrays in order), stripped, empty ones left out; without boundaries the line is split at two blanks."""
    begin = F.concat(F.array(F.lit(0)), ends)
    stop = F.concat(starts, F.array(F.length(line)))
    pieces = F.transform(begin, lambda b, i: F.trim(F.substr(line, b + 1, F.greatest(F.get(stop, i) - b, F.lit(0)))))
    return F.when(F.size(starts) == 0, F.split(line, r"\s{2,}")).otherwise(F.filter(pieces, lambda p: p != ""))


def spaced_line(df: DataFrame, keys: list[str], left: str = "left", width: str = "width", text: str = "text") -> DataFrame:
    """(keys, text): the words of a line with as many blanks between them as their gaps are wide: four over 100 pixels, two over 50, one over 10.

    Equal words at one place come by their widths, as the last of them makes the next gap.
    """
    w = W.partitionBy(*keys).orderBy(left, text, width)
    gap = F.col(left) - F.lag(F.col(left) + F.col(width)).over(w)
    own = df.withColumn("__t", F.concat(F.when(gap > 100, "    ").when(gap > 50, "  ").when(gap > 10, " ").otherwise(""), F.col(text))).withColumn("__r", F.row_number().over(w))
    return own.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__r", "__t"))), lambda s: s["__t"]), "").alias("text"))
