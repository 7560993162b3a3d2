"""Near-duplicate documents by SetSketch registers, verified on whole shingle sets.

1. Map: each document's set of distinct ``WORDS``-word shingles, as 64-bit hashes,
   and its sketch: exponentially spaced, truncated minima of
   exponential variables that the shingles seed.  Sketches merge by maximum, and
   two sets agree in a register about as often as their Jaccard similarity says.
2. Documents with equal sets are one class; its least doc_id stands for it.
3. Bands of ROWS registers deal the classes into buckets.  Within a bucket
   (cut into blocks, block against block, if it is large) the similarity of a pair
   is the likelihood's maximum given how many registers are greater, less and
   equal, and the two sizes.  Only a spanning forest of the pairs that may reach
   the threshold leaves the bucket, never all pairs.
4. The forest's components are the candidates.  Whole shingle sets meet inside
   them, again in blocks; intersections are counted exactly and again only a
   spanning forest leaves.  Its components are the result.

A pair at the threshold misses all bands with a probability under 1e-6
((1 - threshold**ROWS)**bands), and the estimate's margin is five deviations.

Results for odd input: null text and texts without words have an empty set and
are linked with nothing; fewer than WORDS words count as one shingle; a null
doc_id is less than any other and comes back as null; rows that repeat a doc_id
with the same text share its result, with other texts they are documents of their
own, in the order of the texts' hashes, null ids among them; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from termloom.llm.bytescan import BASE, LOWER, U, flat, groups, mix, prefix_hash, span_hash, window_hash, words
from termloom.llm.common import NULL_ID, numbered, parts_for, small_batches, table, trim, written
from termloom.llm.components import components

WORDS, ROWS = 5, 5
#: similarity from which documents are linked, in hundredths: of the query, and of the pipeline's stage
LINK, STAGE_LINK = 85, 80
#: probability that a pair at the threshold misses all bands
MISSED = 1e-6
#: registers grow by this factor; the least exponential is read at this rate
SPACING, RATE, TOP = 1.001, 20.0, 65535
BLOCK = 512
#: blocks that even few rows are cut into where blocks meet
FEW = 16


def bands_for(link: int) -> int:
    """The fewest bands that a pair at the threshold misses with a probability under MISSED: 24 at 85, 35 at 80."""
    return math.ceil(math.log(MISSED) / math.log(1 - (link / 100) ** ROWS))


def possible(link: int) -> float:
    """Five deviations of an estimate from the threshold's registers below the threshold."""
    return link / 100 - 5 * (link / 100 * (1 - link / 100) / (bands_for(link) * ROWS)) ** 0.5


@cache
def seeds(count: int) -> tuple[np.ndarray, np.ndarray]:
    """What is added and multiplied for each of ``count`` registers; more registers begin with the same ones."""
    x = np.random.default_rng(7).integers(1, 2**63, (count, 2), dtype=U)
    return x[:, 0], x[:, 1] * U(2) + U(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Groups of texts: the first row's number and each row's sorted distinct shingle hashes."""
    for a, b in groups(offsets):
        base = int(offsets[a])
        text = LOWER[data[base : int(offsets[b])]]
        s, e, count = words(text, offsets[a : b + 1] - base)
        h = span_hash(prefix_hash(text), s, e)
        w = window_hash(h, WORDS)
        sets = []
        for first, last in zip(count[:-1].tolist(), count[1:].tolist()):
            n = last - first
            if n >= WORDS:
                x = np.sort(w[first : last - WORDS + 1])
                sets.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
            elif n:
                whole = U(n)
                with np.errstate(over="ignore"):
                    for x in h[first:last]:
                        whole = whole * BASE + x
                sets.append(mix(np.array([whole], U)))
            else:
                sets.append(np.zeros(0, U))
        yield a, sets


def registers(sets: list[np.ndarray], count: int) -> np.ndarray:
    """A sketch for each of the nonempty sets: rows of ``count`` 16-bit numbers."""
    add, mul = seeds(count)
    out = np.empty((count, len(sets)), U)
    x = np.concatenate(sets)
    first = np.cumsum([0, *map(len, sets[:-1])])
    for i in range(count):
        out[i] = np.minimum.reduceat((x ^ add[i]) * mul[i], first)
    least = -np.log1p(-np.minimum((out.T.astype(np.float64) + 1) / 2.0**64, 1 - 1e-16))
    return np.clip(np.floor(1 - np.log(least / RATE) / np.log(SPACING)), 0, TOP).astype(np.uint16)


SKETCH = "doc long, n long, sig1 long, sig2 long, regs binary"


def _sketches(count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            docs = batch.column(0).to_numpy()
            for a, sets in shingle_sets(data, offsets):
                n = np.array([len(x) for x in sets], np.int64)
                own = docs[a : a + len(sets)]
                sig1, sig2 = own.copy(), np.full(len(sets), -1, np.int64)
                regs: list[bytes | None] = [None] * len(sets)
                full = np.flatnonzero(n)
                if len(full):
                    x = np.concatenate(sets)
                    first = np.concatenate([[0], np.cumsum(n[full])[:-1]])
                    sig1[full] = np.add.reduceat(mix(x), first).view(np.int64)
                    sig2[full] = np.add.reduceat(mix(x * seeds(count)[1][0]), first).view(np.int64)
                    for k, r in zip(full.tolist(), registers([sets[k] for k in full], count)):
                        regs[k] = r.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n), pa.array(sig1), pa.array(sig2), pa.array(regs, pa.binary())], ["doc", "n", "sig1", "sig2", "regs"])
        trim()

    return run


def _bands(count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            r = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, count, ROWS).astype(U)
            key = np.zeros(r.shape[:2], U) + np.arange(1, count + 1, dtype=U)
            for i in range(ROWS):
                key = key * BASE + r[:, :, i]
            yield pa.RecordBatch.from_arrays([pa.array(mix(key.ravel()).view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), count))], ["key", "doc"])

    return run


def likely(greater: np.ndarray, less: np.ndarray, n: np.ndarray, m: np.ndarray, least: float, count: int) -> np.ndarray:
    """Whether the similarity of greatest likelihood is ``least`` or more.

    ``greater`` and ``less`` count the registers, of ``count``, in which a set of size n exceeds
    one of size m and falls short of it.  The likelihood is concave in the
    similarity, so its slope at ``least`` decides.
    """
    u, v = n / (n + m), m / (n + m)
    p = lambda x: -np.log1p(-np.clip(x, 1e-9, 1) * (SPACING - 1) / SPACING) / np.log(SPACING)

    def value(j: float) -> np.ndarray:
        up, down = p(u - v * j), p(v - u * j)
        return greater * np.log(up) + less * np.log(down) + (count - greater - less) * np.log(np.clip(1 - up - down, 1e-9, 1))

    return value(least + 1e-3) >= value(least - 1e-3)


def forest(docs: np.ndarray, near: np.ndarray) -> list[tuple[int, int]]:
    """(least document, document) for each component of a symmetric relation, itself left out."""
    out, new = [], np.ones(len(docs), bool)
    for i in np.argsort(docs):
        if not new[i]:
            continue
        new[i] = False
        seen, edge = [], np.array([i])
        while len(edge):
            reached = near[edge].any(0) & new
            edge = np.flatnonzero(reached)
            new[edge] = False
            seen.extend(edge.tolist())
        out += [(int(docs[i]), int(docs[k])) for k in seen if docs[k] != docs[i]]
    return out


def _may_link(n: np.ndarray, blobs: list[bytes], link: int) -> np.ndarray:
    count, least = bands_for(link) * ROWS, possible(link)
    r = np.frombuffer(b"".join(blobs), np.uint16).reshape(-1, count)
    near = np.zeros((len(r), len(r)), bool)
    first, second, more = [], [], []
    for i in range(len(r) - 1):
        size = np.minimum(n[i], n[i + 1 :]) * 100 >= link * np.maximum(n[i], n[i + 1 :])
        k = i + 1 + np.flatnonzero(size & (np.count_nonzero(r[i] == r[i + 1 :], axis=1) >= count * (least - 0.1)))
        if len(k):
            first.append(np.full(len(k), i))
            second.append(k)
            more.append(np.count_nonzero(r[i] > r[k], axis=1))
    if first:
        i, k, up = (np.concatenate(x) for x in (first, second, more))
        down = np.concatenate([np.count_nonzero(r[x[0]] < r[y], axis=1) for x, y in zip(first, second)])
        ok = likely(up, down, n[i].astype(float), n[k].astype(float), least, count)
        near[i[ok], k[ok]] = near[k[ok], i[ok]] = True
    return near


def _link(n: np.ndarray, blobs: list[bytes], link: int) -> np.ndarray:
    """Which sets reach the threshold, by exact counts of common shingles."""
    sets = [np.frombuffer(x, U) for x in blobs]
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    x = np.concatenate(sets)
    order = np.argsort(x, kind="stable")
    x, row = x[order], row[order]
    new = np.concatenate([[True], x[1:] != x[:-1]])
    column = np.cumsum(new) - 1
    many = np.bincount(column) > 1
    number = np.cumsum(many) - 1
    keep = many[column]
    row, column = row[keep], number[column[keep]]
    common = np.zeros((len(sets), len(sets)), np.float64)
    step = max(256, (1 << 21) // max(1, len(sets)))
    for c in range(0, int(many.sum()), step):
        own = slice(*np.searchsorted(column, [c, c + step]))
        has = np.zeros((len(sets), step), np.float32)
        has[row[own], column[own] - c] = 1
        common += has @ has.T
    return 100 * common >= link * (n[:, None] + n[None] - common)


def _grouped(relation, link: int):
    """(key, least document, document) of the forests of all groups of one part."""

    def run(t: pa.Table) -> pa.Table:
        g1, g2, g3, docs, n = (t[c].to_numpy() for c in ("key", "i", "j", "doc", "n"))
        blobs = t["blob"].to_pylist()
        order = np.lexsort((docs, g3, g2, g1))
        edge = np.flatnonzero(np.concatenate([[True], (np.diff(g1[order]) != 0) | (np.diff(g2[order]) != 0) | (np.diff(g3[order]) != 0), [True]]))
        out = []
        for s, e in zip(edge[:-1], edge[1:]):
            rows = order[s:e]
            rows = rows[np.concatenate([[True], docs[rows][1:] != docs[rows][:-1]])]
            if len(rows) > 1:
                key = int(g1[rows[0]])
                out += [(key, a, b) for a, b in forest(docs[rows], relation(n[rows].astype(np.int64), [blobs[k] for k in rows], link))]
        trim()
        return pa.table([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], names=["key", "a", "b"])

    return run


def _edges(dealt: DataFrame, n_parts: int, relation, link: int) -> DataFrame:
    """(key, a, b): edges of the forests of the groups that the rows (key, i, j, doc, n, blob) are dealt to."""
    dealt = dealt.select("key", "i", "j", "doc", "n", "blob").withColumn("part", F.pmod(F.xxhash64("key", "i", "j"), F.lit(n_parts)))
    tasks = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(tasks, "part").groupBy("part").applyInArrow(_grouped(relation, link), "key long, a long, b long")


def _blocks(size: Column) -> Column:
    """The number of blocks that meet pairwise: of up to BLOCK rows, and several even of few rows, so that many tasks share the pairs."""
    return F.greatest(F.ceil(size / BLOCK), F.least(F.lit(FEW), F.ceil(size * FEW / BLOCK))).cast("int")


def _met(rows: DataFrame, own: Column, partners: Column) -> DataFrame:
    """Rows dealt to the groups of their own block and each partner."""
    return rows.withColumn("own", own).withColumn("other", F.explode(partners)).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))


def _forest_of(members: DataFrame, sizes: DataFrame, n_parts: int, relation, link: int) -> DataFrame:
    """Edges that connect what ``relation`` connects inside each key; (key, doc, n, blob) and (key, size).

    A key of over BLOCK members is cut into blocks.  What one block connects is a part,
    and first the parts meet by their least members; only blocks that still hold
    different parts meet whole, pair by pair, and never two of the same part.  So a group whose
    members are all near each other costs as much as its members, not as their pairs.
    """
    hashed = F.xxhash64("doc", F.lit(3))
    large = written(sizes.where(F.col("size") > BLOCK).select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "large-keys")
    within = members.join(large, "key", "left").withColumn("i", F.pmod(hashed, F.coalesce("blocks", F.lit(1))).cast("int")).withColumn("j", F.col("i"))
    edges = _edges(within, n_parts, relation, link)
    if large.isEmpty():
        return edges
    edges = written(edges, "block-edges")
    big = written(members.join(large, "key", "left_semi"), "large-members")
    least = lambda found, name: found.groupBy("key", F.col("b").alias(name)).agg(F.min("a").alias("of"))  # noqa: E731  of forests, so what it is connected with
    own = big.select("key", "doc").join(least(edges, "doc"), ["key", "doc"], "left").select("key", "doc", F.coalesce("of", "doc").alias("head"))
    heads = written(own.where("doc = head").select("key", "doc"), "heads")
    blocks = heads.groupBy("key").agg(_blocks(F.count(F.lit(1))).alias("blocks"))
    met = _met(big.join(heads, ["key", "doc"]).join(blocks, "key"), F.pmod(hashed, F.col("blocks")).cast("int"), F.sequence(F.lit(0), F.col("blocks") - 1))
    more = written(_edges(met, n_parts, relation, link), "head-edges")
    named = own.join(least(more, "head"), ["key", "head"], "left").select("key", "doc", F.coalesce("of", "head").alias("of"))
    named = written(named, "parts")
    counted = named.groupBy("key", "of").agg(F.count(F.lit(1)).alias("m"))
    # keys with different parts of which one has members that have not met the others
    still = counted.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.max("m").alias("most")).where("parts > 1 and most > 1").select("key")
    # a part of over a block has blocks of its own, small ones share theirs
    counted = counted.join(still, "key", "left_semi").withColumn("share", F.when(F.col("m") > BLOCK, F.col("of")).otherwise(F.lit(NULL_ID)))
    shares = counted.groupBy("key", "share").agg(_blocks(F.sum("m")).alias("blocks"))
    order = W.partitionBy("key").orderBy("share")  # the large parts of a key
    shares = shares.withColumn("first", F.coalesce(F.sum("blocks").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("int")).withColumn("all", F.sum("blocks").over(W.partitionBy("key")).cast("int"))
    places = named.join(counted.select("key", "of", "share"), ["key", "of"]).join(shares, ["key", "share"])
    others = F.filter(F.sequence(F.lit(0), F.col("all") - 1), lambda x: (F.col("share") == NULL_ID) | (x < F.col("first")) | (x >= F.col("first") + F.col("blocks")))
    rest = _met(big.join(places, ["key", "doc"]), F.col("first") + F.pmod(hashed, F.col("blocks")).cast("int"), others)
    return edges.unionByName(more).unionByName(_edges(rest, n_parts, relation, link))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = flat(batch.column(1))
        for a, sets in shingle_sets(data, offsets):
            own = batch.slice(a, len(sets))
            yield pa.RecordBatch.from_arrays([own.column(2), own.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["key", "doc", "n", "blob"])


def _linked(keyed: DataFrame, text_col: str, link: int) -> DataFrame:
    """(doc, n, component) for each row of numbered documents."""
    small_batches(keyed.sparkSession)
    bodies = keyed.select(F.col("__tl_doc").alias("doc"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("body"))
    sketches = written(bodies.mapInArrow(_sketches(bands_for(link) * ROWS), SKETCH), "sketches")
    classes = written(sketches.where("n > 0").groupBy("n", "sig1", "sig2").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    reps = sketches.select("doc", "n", "regs").join(classes.select(F.col("rep").alias("doc")), "doc", "left_semi").dropDuplicates(["doc"])
    bands = reps.select("doc", "regs").mapInArrow(_bands(bands_for(link)), "key long, doc long")
    shared = bands.groupBy("key").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo < hi").select("key", "size")
    members = written(bands.join(shared, "key").select("key", "doc", "size"), "members")
    n_parts = parts_for(members.count(), 4096)
    with_regs = members.select("key", "doc").join(reps, "doc").select("key", "doc", "n", F.col("regs").alias("blob"))
    candidates = components(_forest_of(with_regs, members.select("key", "size").distinct(), n_parts, _may_link, link), "a", "b")
    candidates = written(candidates, "candidates")
    sets = bodies.join(candidates.select(F.col("node").alias("doc"), F.col("component").alias("key")), "doc").select("doc", "body", "key").mapInArrow(_sets, "key long, doc long, n long, blob binary")
    sizes = candidates.groupBy(F.col("component").alias("key")).agg(F.count(F.lit(1)).alias("size"))
    n_parts = parts_for(candidates.count(), 512)
    linked = components(_forest_of(sets, sizes, n_parts, _link, link), "a", "b")
    of_class = classes.join(linked.withColumnRenamed("node", "rep"), "rep", "left").select("n", "sig1", "sig2", F.coalesce("component", "rep").alias("component"))
    return sketches.select("doc", "n", "sig1", "sig2").join(of_class, ["n", "sig1", "sig2"], "left").select("doc", "n", F.coalesce("component", "doc").alias("component"))


def _results(docs: DataFrame, id_col: str, text_col: str, link: int) -> DataFrame:
    """(doc, n, component, kept) for each row, with ids again."""
    keyed, ids = numbered(docs, id_col, text_col)
    found = _linked(keyed, text_col, link).withColumn("kept", F.col("doc") == F.col("component"))
    if ids is not None:
        for c in ("doc", "component"):
            found = found.join(ids.select(F.col("__tl_doc").alias(c), F.col("id").alias(f"{c}_id")), c).drop(c).withColumnRenamed(f"{c}_id", c)
    return found.select("doc", "n", "component", "kept")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", link: int = LINK) -> DataFrame:
    """(doc, n, component) for each row; doc and component are NULL_ID for a null id.

    Pairs with a similarity of ``link`` hundredths or more are linked.
    """
    return _results(docs, id_col, text_col, link).drop("kept")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", link: int = LINK) -> DataFrame:
    """``docs`` without the documents whose component has a lesser id; every column stays."""
    keyed, _ = numbered(docs, id_col, text_col)
    gone = _linked(keyed, text_col, link).where("doc <> component").select(F.col("doc").alias("__tl_doc")).distinct()
    return keyed.join(gone, "__tl_doc", "left_anti").select(*docs.columns)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _results(table(spark, sf_dir, "documents"), "doc_id", "text", LINK)
    back = lambda c: F.nullif(F.col(c), F.lit(NULL_ID))
    return found.select(back("doc").alias("doc_id"), F.col("n").alias("n_shingles"), back("component").alias("component_id"), "kept")
