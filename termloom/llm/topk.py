"""Exact top-k inner products by pivot elimination.

Components become integers.  A bounded sample of the vectors gives the pivots:
each is the sampled vector farthest from what the ones before it span, until the
sample lies near their span.  Every vector gets its row of the pivot table once,
when its block is packed: its distances to all pivots, which fix its place in the
space that the pivots span and its height over that space.  Two vectors are at
least as far apart as their places and heights are, which is the greatest lower
bound that the distances to all pivots give together, and so the inner product
is bounded from above: (|q|^2 + |x|^2 - bound^2) / 2.

The sample also gives every query a score that k candidates reach, before any
block is looked at.  Query blocks and candidate blocks meet once each, on a key
of their own; candidates whose bound is under the known score are never
evaluated, the others are in the order of their bounds until the k-th best score
is greater than the next bound.

Results for odd input: vectors that are null or empty, or hold a null or
non-finite component, and rows with a null id take no part; only vectors of equal length are compared;
rows with the query's own id are never its candidates; every other row is one,
so repeated rows are found repeatedly, and a repeated query row gets its own k
rows; ties go to the smaller vec_id; scores beyond the range of a long are its ends; an
empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from termloom.llm.common import parts_for, table

K, EVERY, SCALE = 10, 100, 1024
#: bound of the sample that pivots and first scores are taken from; no result depends on it
SAMPLE = 4096
#: pivots are added until the sample's heights are on average so small a part of its distances
HEIGHT = 0.3
STEP = 64
QUERY_ROWS, BLOCK_ROWS, LEAST_ROWS = 2048, 16384, 1024
LONG = 2**63


class Pivots:
    """Pivots of one length of vectors, and the table rows of any vectors."""

    def __init__(self, sample: np.ndarray):
        self.origin = sample[0] if len(sample) else np.zeros(sample.shape[1])
        rest = sample - self.origin
        size = np.sqrt((rest**2).sum(1).mean()) if len(rest) else 0.0
        chosen: list[int] = []
        basis: list[np.ndarray] = []
        left = (rest**2).sum(1)
        while len(chosen) < sample.shape[1] and size and np.isfinite(size) and np.sqrt(left.mean()) > HEIGHT * size:
            at = int(left.argmax())
            v = rest[at].copy()
            for _ in range(2):  # twice, for rounding
                for b in basis:
                    v -= (v @ b) * b
            if not (length := np.sqrt(v @ v)) > 1e-6 * size:
                break
            basis.append(v / length)
            chosen.append(at)
            left = np.maximum(left - (rest @ basis[-1]) ** 2, 0)
        self.points = sample[chosen]
        #: the pivots' own places: row by row one more place than the row before
        self.lower = (self.points - self.origin) @ np.array(basis).T if basis else np.zeros((0, 0))

    def table(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places and height, half of what the squared size exceeds the squared distance from the origin by) from the distances to all pivots."""
        gap = x - self.origin
        first = (gap**2).sum(1)
        to = first[:, None] - 2 * gap @ (self.points - self.origin).T + ((self.points - self.origin) ** 2).sum(1)
        along = (first[:, None] - to + ((self.points - self.origin) ** 2).sum(1)) / 2
        place = np.linalg.solve(self.lower, along.T).T if len(self.lower) else np.zeros((len(x), 0))
        height = np.sqrt(np.maximum(first - (place**2).sum(1), 0))
        return np.hstack([place, height[:, None]]), ((x**2).sum(1) - first) / 2


class Block:
    """Vectors in the order of their ids, with their part of the pivot table."""

    FIELDS = ("ids", "kind", "x", "rows", "offsets", "reach")
    SCHEMA = "ids binary, kind string, x binary, rows binary, offsets binary, reach double"

    def __init__(self, ids, kind, x, rows, offsets, reach, dim):
        self.ids = np.frombuffer(ids, np.int64)
        self.x = np.frombuffer(x, np.dtype(kind)).reshape(-1, dim)
        self.rows = np.frombuffer(rows, np.float32).reshape(len(self.ids), -1)
        self.offsets = np.frombuffer(offsets, np.float64)
        self.reach = reach

    @staticmethod
    def packed(ids: np.ndarray, x: np.ndarray, pivots: Pivots) -> tuple:
        order = np.lexsort([*x.T[::-1], ids]) if len(np.unique(ids)) < len(ids) else np.argsort(ids)
        ids, x = ids[order], x[order]
        most = np.abs(x).max(initial=0)
        kind = "int16" if most < 2**15 else "int32" if most < 2**31 else "float64"
        with np.errstate(over="ignore", invalid="ignore"):
            rows, offsets = pivots.table(x)
            reach = np.sqrt((x**2).sum(1).max(initial=0)) + np.sqrt((pivots.origin**2).sum())
            return ids.tobytes(), kind, x.astype(kind).tobytes(), rows.astype(np.float32).tobytes(), offsets.tobytes(), float(reach)


def scores_of(x: np.ndarray, q: np.ndarray, most_x: float, most_q: float) -> np.ndarray:
    """Inner products as exact integers, clipped to the range of a long."""
    most = len(q) * most_x * most_q
    if most < 2**53:
        return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    if most < LONG:
        return x.astype(np.int64) @ q.astype(np.int64)
    own = [int(v) for v in q]
    return np.array([max(-LONG, min(LONG - 1, sum(int(a) * b for a, b in zip(row, own)))) for row in x], np.int64)


def first_scores(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
    """A score that k of the sampled candidates reach, for each query; minus infinity without k of them."""
    most_x, most_q = np.abs(x).max(initial=0), np.abs(q).max(initial=0)
    out = np.full(len(q), -np.inf)
    for i in range(len(q)):
        own = scores_of(x, q[i], most_x, most_q)[ids != q_ids[i]]
        if len(own) >= k:
            out[i] = np.partition(own, len(own) - k)[len(own) - k]
    return out


def best_of_block(q: Block, x: Block, least: np.ndarray, k: int = K) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """For each query the ids and scores of those of its k best that may stand in the block, and how many candidates were evaluated."""
    most_x, most_q = float(np.abs(x.x.astype(np.float64)).max(initial=0)), float(np.abs(q.x.astype(np.float64)).max(initial=0))
    slack = 1 + (x.rows.shape[1] + 8) * 2.0**-21 * q.reach * x.reach
    with np.errstate(over="ignore", invalid="ignore"):
        for a in range(0, len(q.ids), 256):
            bounds = (q.rows[a : a + 256] @ x.rows.T).astype(np.float64) + q.offsets[a : a + 256, None] + x.offsets + slack
            np.copyto(bounds, np.inf, where=~np.isfinite(bounds))
            np.maximum(bounds, -LONG, out=bounds)  # as scores are clipped
            for i, bound in enumerate(bounds, a):
                at = np.flatnonzero((bound >= least[i]) & (x.ids != q.ids[i]))
                at = at[np.argsort(-bound[at], kind="stable")]
                top_s, top_i, seen = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
                for s in range(0, len(at), STEP):
                    if len(top_s) == k and top_s[-1] > bound[at[s]]:
                        break
                    now = at[s : s + STEP]
                    seen += len(now)
                    score = np.concatenate([top_s, scores_of(x.x[now], q.x[i], most_x, most_q)])
                    name = np.concatenate([top_i, x.ids[now]])
                    best = np.lexsort((name, ~score))[:k]
                    top_s, top_i = score[best], name[best]
                yield top_i, top_s, seen


def top_k(vectors: DataFrame, is_query, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for the rows that ``is_query`` (a condition on vec_id) names, their k best."""
    component = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("e"), F.xxhash64(F.monotonically_increasing_id()).alias("at"))
    rows = rows.where(F.col("vec_id").isNotNull() & (F.size("e") > 0) & F.forall("e", component)).withColumn("dim", F.size("e"))
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q")).first()
    n_x, n_q = (parts_for(n[c], most, max(1, min(16, -(-n[c] // LEAST_ROWS)))) for c, most in (("n", BLOCK_ROWS), ("q", QUERY_ROWS)))
    whole = lambda t: np.floor(SCALE * t.column("e").combine_chunks().flatten().to_numpy()).reshape(t.num_rows, -1)
    sampled = rows.select("vec_id", "e", "dim").orderBy(F.xxhash64("vec_id", "e"), "vec_id").limit(SAMPLE).toArrow()  # at most SAMPLE vectors
    sample = {}
    for dim in sorted(set(sampled.column("dim").to_pylist())):
        own = sampled.filter(pa.compute.equal(sampled.column("dim"), dim))
        sample[dim] = (own.column("vec_id").to_numpy(), whole(own))
    pivots = {dim: Pivots(x) for dim, (_, x) in sample.items()}

    def pack(t: pa.Table) -> pa.Table:
        dim = t.column("dim")[0].as_py()
        block = Block.packed(t.column("vec_id").to_numpy(), whole(t), pivots.get(dim) or Pivots(np.zeros((0, dim))))
        return pa.table([t.column("dim").slice(0, 1), t.column("block").slice(0, 1), *(pa.array([v], kind) for v, kind in zip(block, (pa.binary(), pa.string(), *[pa.binary()] * 3, pa.float64())))], names=["dim", "block", *Block.FIELDS])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        dim = (left if left.num_rows else right).column("dim")[0].as_py()
        out: list[tuple] = []
        for a in left.to_pylist():
            q = Block(*(a[c] for c in Block.FIELDS), dim)
            ids, x = sample.get(dim, (np.zeros(0, np.int64), np.zeros((0, dim))))
            least = first_scores(ids, x, q.ids, q.x, k)
            for b in right.to_pylist():
                for i, (name, score, _) in enumerate(best_of_block(q, Block(*(b[c] for c in Block.FIELDS), dim), least, k)):
                    out.append((np.full(len(name), a["q_block"]), np.full(len(name), i), np.full(len(name), q.ids[i]), name, score))
        columns = [np.concatenate(c).astype(np.int64) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 5
        return pa.table([pa.array(np.full(len(columns[0]), dim), pa.int32()), *(pa.array(c) for c in columns)], names=["dim", "q_block", "place", "query_id", "vec_id", "score"])

    packed = lambda df, blocks: df.withColumn("block", F.pmod("at", F.lit(blocks)).cast("int")).select("dim", "block", "vec_id", "e").groupBy("dim", "block").applyInArrow(pack, f"dim int, block int, {Block.SCHEMA}")
    each = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = packed(rows.where(is_query), n_q).select("dim", F.col("block").alias("q_block"), each(n_x).alias("x_block"), *Block.FIELDS)
    right = packed(rows, n_x).select("dim", each(n_q).alias("q_block"), F.col("block").alias("x_block"), *Block.FIELDS)
    keys = ["dim", "q_block", "x_block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "dim int, q_block long, place long, query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("dim", "q_block", "place").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


ORACLE = f"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, len(embedding) AS dim, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT q.r, q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(q.e, x.e) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id % {EVERY} = 0 AND q.vec_id <> x.vec_id AND q.dim = x.dim
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {K}
"""
