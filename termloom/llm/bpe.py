"""BPE encoding and decoding by forced-boundary splitting.

Two neighbouring symbols that stand side by side inside no vocabulary token can
never be merged, so a word may be cut between them: the fragments are encoded
independently and their ids concatenated.  Fragments recur far more often than
words, and each is encoded once per task (a memo of bounded size).  Texts are cut at
spaces before all that, as a token never crosses one.

The vocabulary, merges and added tokens are read from the tokenizer's file; what
is read is checked to be of the kind that is implemented (NFC, white space to
one space, lower case, split by a pattern, byte symbols, end-of-word suffix).

Results for odd input: null and empty texts have no ids and decode to nothing;
very long words are merged by a heap; repeated rows get a result each; null ids
stay null; other columns are left out.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from termloom.llm.common import small_batches, table

#: entries of a memo; it starts anew when full, which changes no result
MEMO = 600_000
#: from this code point on the classes of characters differ between versions of Unicode; such chunks are split by the library
SETTLED = "\u0530"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [], 0x100
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class Memo(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= MEMO:
            self.clear()
        made = self[key] = self.make(key)
        return made


class ForcedBoundaryBpe:
    def __init__(self, path: str):
        self.path, self.library = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        model = spec["model"]
        if kinds != ["NFC", "Replace", "Lowercase"] or split["type"] != "Split" or not split["invert"] or level["type"] != "ByteLevel" or spec["decoder"] is not None or model["type"] != "BPE":
            raise ValueError(f"{path} is not of the kind that is implemented")
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(a, b): i for i, (a, b) in enumerate(merges)}
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added_pattern = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.symbols = byte_symbols()
        self.inside = {pair for t in self.vocab for u in [t.removesuffix(self.suffix) if self.suffix else t] for pair in zip(u, u[1:])}
        self.token = {i: t.encode() + b" " for t, i in [*self.vocab.items(), *self.added.items()]}
        self.fragment = Memo(lambda f: self._merged(list(f)))
        self.last = Memo(lambda f: self._merged([*f[:-1], f[-1] + self.suffix]))
        self.word = Memo(self._word)
        self.ids = Memo(self._chunk)
        self.text = Memo(lambda chunk: self._decoded(self.ids[chunk]))

    def _merged(self, parts: list[str]) -> bytes:
        """The ids of one fragment: always the leftmost pair of least rank is merged."""
        rank, none = self.rank.get, 1 << 30
        if len(parts) > 48:
            parts = self._merged_long(parts)
        elif len(parts) > 1:
            ranks = [rank(p, none) for p in zip(parts, parts[1:])]
            while ranks and (best := min(ranks)) < none:
                i = ranks.index(best)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del ranks[i]
                if i < len(ranks):
                    ranks[i] = rank((parts[i], parts[i + 1]), none)
                if i:
                    ranks[i - 1] = rank((parts[i - 1], parts[i]), none)
        return array("I", [self.vocab[p] for p in parts if p in self.vocab]).tobytes()

    def _merged_long(self, parts: list[str]) -> list[str]:
        rank, n = self.rank, len(parts)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, p) for i, p in enumerate(zip(parts, parts[1:])) if (r := rank.get(p)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or (parts[i], parts[j]) != pair:
                continue
            parts[i] += parts[j]
            alive[j] = False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := rank.get((parts[a], parts[b]))) is not None:
                    heapq.heappush(heap, (r, a, (parts[a], parts[b])))
        return [p for p, x in zip(parts, alive) if x]

    def _words(self, chunk: str) -> list[str]:
        """The words of a text without a space, in byte symbols."""
        if not chunk.isascii() and max(chunk) >= SETTLED:
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.path)
            return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))]
        chunk = unicodedata.normalize("NFC", chunk)
        chunk = "".join(c.lower() for c in chunk) if "Σ" in chunk else chunk.lower()
        words = self.pattern.findall(chunk)
        return words if chunk.isascii() and chunk.isprintable() else [w if w.isascii() and w.isprintable() else "".join([self.symbols[b] for b in w.encode()]) for w in words]

    def _word(self, s: str) -> bytes:
        """The ids of one word: its fragments are encoded independently."""
        out, first = [], 0
        for i, pair in enumerate(zip(s, s[1:]), 1):
            if pair not in self.inside:
                out.append(self.fragment[s[first:i]])
                first = i
        out.append(self.last[s[first:]])
        return b"".join(out)

    def _chunk(self, chunk: str) -> bytes:
        """The ids of a text without a space."""
        return b"".join([self.word[s] for s in self._words(chunk)])

    def _decoded(self, ids: bytes) -> bytes:
        return b"".join([self.token[i] for i in array("I", ids)])

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """The ids as little-endian unsigned 32-bit integers, and the text they decode to in UTF-8."""
        if self.added_pattern is None or "<" not in text or not self.added_pattern.search(text):
            chunks = text.split(" ")
            return b"".join(map(self.ids.__getitem__, chunks)), b"".join(map(self.text.__getitem__, chunks))[:-1]
        ids = []
        for part in self.added_pattern.split(text):
            ids.append(array("I", [self.added[part]]).tobytes() if part in self.added else b"".join(map(self.ids.__getitem__, part.split(" "))))
        joined = b"".join(ids)
        return joined, self._decoded(joined)[:-1]


@functools.lru_cache(maxsize=2)
def loaded(path: str) -> ForcedBoundaryBpe:
    """One encoder for each worker process; its memos live on from task to task."""
    return ForcedBoundaryBpe(path)


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            out = []
            for text in batch.column(1):
                ids, back = bpe.encode(text.as_py() or "")
                out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.string())))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string) for each row."""

    def run(batches):
        bpe = loaded(path)
        for batch in batches:
            got = [bpe.encode(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([list(array("I", i)) for i, _ in got], pa.list_(pa.int32())), pa.array([b.decode() for _, b in got], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    return docs.select(docs.doc_id.cast("long").alias("doc_id"), "text").mapInArrow(_digests(tokenizer_path("word_bpe_49k.json")), DIGEST)
