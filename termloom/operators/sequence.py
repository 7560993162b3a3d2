"""Sequences: breaks, crossings, minima, smoothing, bigrams and decoding."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def breaks(key: Column, w) -> Column:
    """Whether the key differs from the row before."""
    return ~key.eqNullSafe(F.lag(key).over(w)) | (F.row_number().over(w) == 1)


def islands(df: DataFrame, keys: list[str], order: list[str], is_break: Column, out: str = "island") -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(is_break.cast("int")).over(w))


def carry_forward(c: Column, w) -> Column:
    return F.last(c, True).over(w.rowsBetween(W.unboundedPreceding, 0))


def crossings(value: Column, threshold, w) -> Column:
    """Whether the value falls below the threshold here."""
    return F.coalesce((value < threshold) & (F.lag(value).over(w) >= threshold), F.lit(False))


def local_minima(value: Column, w) -> Column:
    return F.coalesce((value < F.lag(value).over(w)) & (value < F.lead(value).over(w)), F.lit(False))


def majority(df: DataFrame, keys: list[str], label: str, out: str = "majority") -> DataFrame:
    """Each group's most frequent label; ties go to the smallest."""
    n = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(label).alias("v"))).alias("m")).select(*keys, F.col("m.v").alias(out))


def bigrams(tokens: DataFrame, keys: list[str], order: str, token: str) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(order)
    return tokens.withColumn("next", F.lead(token).over(w)).where(F.col("next").isNotNull())


def viterbi(emissions: DataFrame, start: dict[int, float], steps: dict[tuple[int, int], float], floor: float = 1e-7) -> DataFrame:
    """The likeliest states of each sequence; emissions (seq, t, state, p), models small enough to ship with the task.

    States whose emission is under ``floor`` after the first time are not entered then, unless all
    are; other probabilities are raised to ``floor``.
    """
    import numpy as np
    import pandas as pd

    states = np.array(sorted({*start, *(s for pair in steps for s in pair)}))
    first = np.log(np.maximum(floor, [start.get(s, 0) for s in states]))
    move = np.log(np.maximum(floor, [[steps.get((a, b), 0) for b in states] for a in states]))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        times, row = np.unique(group["t"], return_inverse=True)
        place = np.minimum(np.searchsorted(states, group["state"]), len(states) - 1)
        own = states[place] == group["state"].to_numpy()
        p = np.zeros((len(times), len(states)))
        np.maximum.at(p, (row[own], place[own]), group["p"].to_numpy(float)[own])
        entered = (p >= floor) | (p < floor).all(1, keepdims=True)
        entered[0] = True
        seen = np.where(entered, np.log(np.maximum(floor, p)), -np.inf)
        best, back = first + seen[0], []
        for step in seen[1:]:
            paths = best[:, None] + move
            back.append(paths.argmax(0))
            best = paths.max(0) + step
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return pd.DataFrame({"seq": group["seq"].iloc[0], "t": times, "state": states[path[::-1]]})

    return emissions.groupBy("seq").applyInPandas(run, "seq long, t int, state int")


def mark_choices(text: Column, mark: str, most: int | None = 8) -> Column:
    """All ways to keep or leave out the marks in a text, as an array.

    There are two to the power of the marks, so a text with more than ``most`` marks is
    only itself; with ``most`` None it gets all of them too.
    """
    parts = F.split(text, re.escape(mark))
    n = F.size(parts) - 1
    kept = lambda bits: F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.when((i < n) & (F.floor(bits / F.pow(F.lit(2), i)) % 2 == 1), F.lit(mark)).otherwise(F.lit("")))), "")
    few = n if most is None else F.least(n, F.lit(most))
    every = F.transform(F.sequence(F.lit(0).cast("long"), (F.pow(F.lit(2), few) - 1).cast("long")), kept)
    return every if most is None else F.when(n > most, F.array(text)).otherwise(every)


def over_others(value: Column, w) -> Column:
    """Whether a value exceeds the mean of its group's other values by over two of their deviations."""
    n, total, squares = F.count(value).over(w) - 1, F.sum(value).over(w) - value, F.sum(value * value).over(w) - value * value
    mean = total / n
    return F.coalesce((n > 0) & (value > mean + 2 * F.sqrt(F.greatest(squares / n - mean * mean, F.lit(0.0)))), F.lit(False))


def least_variance(df: DataFrame, keys: list[str], width: str, factors: tuple[float, ...] = (1.75, 2.5, 2.75, 3.0, 3.6, 4.0, 8.0)) -> DataFrame:
    """(keys, factor): the factor under which widths vary least when those of the mean and so many deviations or more are joined by pieces of mean width.

    A width is cut into as many pieces as mean less deviation fits into it; the least factor wins a tie.
    """
    stats = df.groupBy(*keys).agg(F.avg(width).alias("__m"), F.stddev_pop(width).alias("__s"))
    own = df.join(stats, keys).withColumn("factor", F.explode(F.array(*[F.lit(f) for f in factors])))
    pieces = F.when(F.col(width) >= F.col("__m") + F.col("factor") * F.col("__s"), F.floor(F.col(width) / (F.col("__m") - F.col("__s")))).otherwise(0)
    m, x = F.col("__m"), F.col(width)
    sums = own.withColumn("__p", pieces).groupBy(*keys, "factor").agg(F.sum(1 + F.col("__p")).alias("n"), F.sum(x + F.col("__p") * m).alias("t"), F.sum(x * x + F.col("__p") * m * m).alias("q"))
    variance = F.round(F.col("q") / F.col("n") - (F.col("t") / F.col("n")) ** 2, 6)
    return sums.groupBy(*keys).agg(F.min(F.struct(variance.alias("v"), "factor"))["factor"].alias("factor"))


def contrast(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, deviation, least, greatest value of each group, and the span between the last two."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("lo"), F.max(value).alias("hi"), (F.max(value) - F.min(value)).alias("contrast"))


def seeded_share(df: DataFrame, keys: list[str], share: float, seed: int) -> DataFrame:
    """The rows whose keys hash under ``share`` with a seed: the same rows on every run and in any order."""
    return df.where(F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1_000_000)) < int(share * 1_000_000))
