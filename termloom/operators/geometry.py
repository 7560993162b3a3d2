"""Boxes and intervals: unions, containment, overlap, nearest, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def bounding(df: DataFrame, keys: list[str]) -> DataFrame:
    """The box around all boxes (x, y, w, h) of a group."""
    right, bottom = F.max(F.col("x") + F.col("w")), F.max(F.col("y") + F.col("h"))
    return df.groupBy(*keys).agg(F.min("x").alias("x"), F.min("y").alias("y"), (right - F.min("x")).alias("w"), (bottom - F.min("y")).alias("h"))


def contained(outer: DataFrame, inner: DataFrame, key: str, lo: str, hi: str, id_col: str) -> DataFrame:
    """Pairs (key, outer_id, inner_id) of intervals of one key, the second within the first, edges included."""
    a = outer.select(key, F.col(id_col).alias("outer_id"), F.col(lo).alias("__l1"), F.col(hi).alias("__h1"))
    b = inner.select(key, F.col(id_col).alias("inner_id"), F.col(lo).alias("__l2"), F.col(hi).alias("__h2"))
    return a.join(b, key).where("__l1 <= __l2 and __h2 <= __h1 and outer_id <> inner_id").select(key, "outer_id", "inner_id", (F.col("__h1") - F.col("__l1")).alias("size"))


def innermost(pairs: DataFrame, key: str) -> DataFrame:
    """For each inner one the smallest that holds it; ties go to the smaller id."""
    return pairs.groupBy(key, "inner_id").agg(F.min(F.struct("size", "outer_id")).alias("m")).select(key, "inner_id", F.col("m.outer_id").alias("outer_id"))


def overlap_ratio(l1: Column, h1: Column, l2: Column, h2: Column) -> Column:
    """Common length over the shorter one's."""
    return F.greatest(F.lit(0.0), F.least(h1, h2) - F.greatest(l1, l2)) / F.least(h1 - l1, h2 - l2)


def merge_overlaps(df: DataFrame, key: str, lo: str, hi: str) -> DataFrame:
    """Disjoint unions of the overlapping intervals of each key."""
    w = W.partitionBy(key).orderBy(lo, hi)
    before = F.max(hi).over(w.rowsBetween(W.unboundedPreceding, -1))
    flagged = df.withColumn("__new", F.when(F.col(lo) <= before, 0).otherwise(1))
    numbered = flagged.withColumn("part", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(key, "part").agg(F.min(lo).alias(lo), F.max(hi).alias(hi), F.count(F.lit(1)).alias("n"))


def merge_hangoff(df: DataFrame, keys: list[str], limit: float = 0.6) -> DataFrame:
    """Characters from boxes (x, y, w, h) of a line: from left to right a box joins the running one if its hang-off share is under ``limit``."""
    import pandas as pd

    schema = df.select(*keys, F.lit(0).alias("part"), *[F.lit(0.0).alias(c) for c in "xywh"]).schema

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in group.sort_values(["x", "y", "w", "h"]).to_dict("records"):
            if out:
                b = out[-1]
                right = b["x"] + b["w"]
                if r["x"] <= right and (min(b["w"], r["w"]) - abs(right - r["x"])) / max(1e-9, min(b["w"], r["w"])) < limit:
                    x, y = min(b["x"], r["x"]), min(b["y"], r["y"])
                    b.update(w=max(right, r["x"] + r["w"]) - x, h=max(b["y"] + b["h"], r["y"] + r["h"]) - y, x=x, y=y)
                    continue
            out.append({**{k: r[k] for k in keys}, "part": len(out), **{c: float(r[c]) for c in "xywh"}})
        return pd.DataFrame(out, columns=[*keys, "part", *"xywh"])

    return df.groupBy(*keys).applyInPandas(run, schema)


def as_of(points: DataFrame, marks: DataFrame, keys: list[str], point: str, mark: str, value: str) -> DataFrame:
    """Each point with the value of the last mark at or before it, by one sort of both."""
    a = points.withColumn("__at", F.col(point)).withColumn("__kind", F.lit(1))
    b = marks.select(*keys, F.col(mark).alias("__at"), F.lit(0).alias("__kind"), F.col(value).alias("__v"))
    w = W.partitionBy(*keys).orderBy("__at", "__kind").rowsBetween(W.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn(value, F.last("__v", True).over(w))
    return both.where("__kind = 1").drop("__at", "__kind", "__v")


def cosine(x0: Column, y0: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The size of the cosine of the angle at the second point between the first and the third."""
    ax, ay, bx, by = x0 - x1, y0 - y1, x2 - x1, y2 - y1
    return F.abs((ax * bx + ay * by) / F.sqrt((ax * ax + ay * ay) * (bx * bx + by * by)))


def reading_order(df: DataFrame, keys: list[str], height: int = 50, out: str = "place", ties: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a page numbered by bands of ``height`` pixels and by x inside them; rows at one point by ``ties``, without it in any order."""
    return df.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(F.floor(F.col("y") / height), "x", "y", *ties)))
