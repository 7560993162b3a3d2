"""Best-fit packing of token pieces by exact-complement hashing.

Pieces differ only in their length, and there are at most ``SIZE`` lengths.  So
the plan is made from the number of pieces of each length (a table of bounded
size): the longest length left takes, as often as the counts allow, a single
length, a pair or a triple that fills its gap exactly; what finds none, and a
share kept back for it, is placed best-fit.  A plan is a list of patterns with multiplicities.  Then each piece
gets its rank among those of its length and reads its place off the plan.

Documents over ``SIZE`` tokens are cut into ``SIZE``-token pieces, the first of
which may be shorter.

Results for odd input: null and empty texts hold the end token alone; repeated
rows are packed each; null ids stay null; an empty table gives no rows; other
columns are left out.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from termloom.llm.bpe import SETTLED, byte_symbols, tokenizer_path
from termloom.llm.common import small_batches, table, written

SIZE, END = 1024, 2
#: shares of each length that exact combinations leave to best-fit
RESERVES = (0.5, 0.25, 0.0)
#: pieces of one length are ranked in at least so many parts, of about so many pieces
SALTS, SALT_ROWS = 32, 65_536
_END = array("I", [END]).tobytes()
#: the split of byte-level BPE
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: control characters that libraries class differently, and long runs of white space
ODD = re.compile(r"[\x1c-\x1f\x85]|\s{256}")
LONG = 4096


class Encoder:
    """The ids of byte-level BPE as the tokenizers library gives them.

    Ordinary texts go through the faster library, with the same vocabulary as
    ranks and the same split; texts with added tokens, with characters whose
    class differs between versions of Unicode, or with very long runs of one kind
    go through the tokenizers library itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        byte = {c: i for i, c in enumerate(byte_symbols())}
        ranks = {bytes([byte[c] for c in t]): i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items()}
        self.fast = tiktoken.Encoding("byte-level", pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if (text.isascii() or max(text) < SETTLED) and not ODD.search(text) and max(map(len, text.split(" "))) < LONG and not any(s in text for s in self.special):
            return array("I", self.fast.encode_ordinary(text)).tobytes()
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "") + _END
                n = len(ids) // 4
                first = (n - 1) % SIZE + 1
                edges = [0, *range(first, n + 1, SIZE)]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    out.append((doc, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), *[pa.int64()] * 3))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how often each is used, for so many pieces of each length.

    Combinations that take all pieces of the short lengths leave the last long ones
    without fillers, so a share of each length is kept back for best-fit.  Which
    share leaves the fewest sequences depends on the lengths; the best of RESERVES is taken.
    """
    return min((_plan(counts, size, r) for r in RESERVES), key=lambda p: sum(k for _, k in p))


def _plan(counts: dict[int, int], size: int, reserve: float) -> list[tuple[tuple[int, ...], int]]:
    """A plan whose gaps are filled exactly by one, two or three lengths, but for ``reserve`` of the pieces of each length, before the rest is placed best-fit."""
    left, kept = np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64)
    for k, v in counts.items():
        kept[k] = math.ceil(reserve * v) if k < size else 0
        left[k] = v - kept[k]
    out: list[tuple[tuple[int, ...], int]] = []

    def use(*parts: int) -> None:
        need: dict[int, int] = defaultdict(int)
        for p in parts:
            need[p] += 1
        k = min(int(left[p]) // c for p, c in need.items())
        if k:
            for p, c in need.items():
                left[p] -= k * c
            out.append((parts, k))

    if left[size]:
        use(size)
    for a in range(size - 1, 0, -1):
        gap = size - a
        if left[a] and gap <= a:
            use(a, gap)
        if left[a]:
            for b in range(min(a, gap - 1), (gap - 1) // 2, -1):
                if left[b] and left[gap - b]:
                    use(a, b, gap - b)
                    if not left[a]:
                        break
        if left[a] and 3 * a >= gap:
            for b in range(min(a, gap - 2), (gap + 2) // 3 - 1, -1):
                if not left[b]:
                    continue
                two = gap - b
                low, high = (two + 1) // 2, min(b, two - 1)
                for c in np.flatnonzero((left[low : high + 1] > 0) & (left[two - high : two - low + 1][::-1] > 0)) + low if high >= low else ():
                    use(a, b, int(c), int(two - c))
                    if not left[a] or not left[b]:
                        break
                if not left[a]:
                    break
    bins: dict[int, list[list]] = defaultdict(list)
    for a in range(size - 1, 0, -1):
        n = int(left[a] + kept[a])
        while n:
            room = next((r for r in range(a, size) if bins.get(r)), None)
            if room is None:
                each = size // a
                whole, part = divmod(n, each)
                for times, parts in ((whole, (a,) * each), (1 if part else 0, (a,) * part)):
                    if times:
                        bins[size - sum(parts)].append([parts, times])
                break
            parts, times = bins[room].pop()
            k = min(n, times)
            if times > k:
                bins[room].append([parts, times - k])
            bins[room - a].append([(*parts, a), k])
            n -= k
    return out + [(p, k) for group in bins.values() for p, k in group]


def places(patterns: list[tuple[tuple[int, ...], int]], size: int = SIZE) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first ranks of its runs, the sequence of each run's first piece, and the offset there."""
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    base = 0
    for parts, times in patterns:
        offset = 0
        for p in parts:
            runs[p].append((used[p], base, offset))
            used[p] += times
            offset += p
        base += times
    return {p: tuple(np.array(c, np.int64) for c in zip(*r)) for p, r in runs.items()}


def pack(pieces: DataFrame, order: list[str], size: int = SIZE) -> DataFrame:
    """``pieces`` with sequence_id and offset; ``pieces`` must be a table that reads the same each time.

    ``order`` breaks ties between pieces of one length.  The driver holds the number
    of pieces of each length and of each part of a length: size * SALTS numbers and
    one more for every SALT_ROWS pieces.
    """
    total = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = {k: max(SALTS, -(-n // SALT_ROWS)) for k, n in total.items()}
    many = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k in sorted(parts) if parts[k] > SALTS for x in (k, parts[k])]), F.col("length")), F.lit(SALTS)) if any(k > SALTS for k in parts.values()) else F.lit(SALTS)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(*order), many).cast("int"))
    first = {k: np.zeros(n + 1, np.int64) for k, n in parts.items()}
    for r in salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).collect():
        first[r["length"]][r["salt"] + 1] = r["n"]
    first = {k: np.cumsum(n) for k, n in first.items()}
    where = places(plan(total, size), size)
    names = pieces.columns
    at = names.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(at).to_numpy()
            salt, rank = batch.column(len(names)).to_numpy(), batch.column(len(names) + 1).to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for n in np.unique(length):
                own = length == n
                starts, bases, offsets = where[int(n)]
                at_rank = first[int(n)][salt[own]] + rank[own]
                k = np.searchsorted(starts, at_rank, "right") - 1
                sequence[own], offset[own] = bases[k] + at_rank - starts[k], offsets[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    ranked = salted.withColumn("rank", F.row_number().over(W.partitionBy("length", "salt").orderBy(*order)) - 1)
    schema = pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema
    return ranked.mapInArrow(run, schema)


def packed_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each row."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = written(rows.mapInArrow(_cut(path), PIECES), "pieces")
    return pack(pieces, ["doc_id", "piece", "ids_crc32"])


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
