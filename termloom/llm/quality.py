"""Quality rules by weak supervision.

Each rule votes low, good or abstains on a document's counts.  Rules that look at
the same thing are a family, and the votes of a family on a document share one
vote's weight, so that dependent rules don't count twice.  The votes of all documents
that pass the base are summed by pattern (at most 3**len(RULES) patterns, whatever the input).
Expectation-maximisation on the patterns estimates how many documents are low
and how often each rule votes low on good and on low documents; an abstention
says nothing.  A document is kept if its posterior probability of being good is
one half or more: a low vote of a rule that good documents often break is
outweighed by good votes of others.  The base checks come first and are not votes.

What is known beforehand is PRIOR alone, as votes that were already seen: of
good documents and of low ones, so that a rule without votes, or a table
without low documents, has rates.

Results for odd input: null and empty texts have no words and fail the base; a null
doc_id stays null; repeated rows are judged each; equal counts give equal
verdicts; an empty table gives no rows; ``op5`` leaves other columns out,
``keep_good`` passes them by.

``keep_good`` counts every text twice, for the fit and for the verdict: keeping the
counts with the rows would write and read all texts once more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.bytescan import LEAD, LOWER, SPACE, U, flat, groups, mix, prefix_hash, span_hash, window_hash, words
from termloom.llm.common import small_batches, table, trim, written


def _bytes(chars: bytes) -> np.ndarray:
    mask = np.zeros(256, bool)
    mask[list(chars)] = True
    return mask


SYMBOLS = _bytes(b"#*$%&|<>")
#: characters that hardly stand inside words of prose
MARKS = SYMBOLS | _bytes(b"@^~=\\_/+{}[]")
STOPS, ENDS = _bytes(b".,;:!?"), _bytes(b".!?\"':;)")
UPPER = _bytes(bytes(range(65, 91)))
LETTER = UPPER | _bytes(bytes(range(97, 123)))
LETTER[0xC0:] = True
#: frequent function words of English, German, French and Spanish
FUNCTION = "a al am an and are as at au aux avec be by con das de del dem den der des die du ein eine el en es est et for from für had has have he her his ich il in is ist it la las le les los mit ne nicht not of on or ou par para pas por pour que qui se sich sie son sur that the this to un una une und von war was which with y zu".split()
WINDOW = 8
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_plain", "n_lettered", "n_function", "n_doubled", "n_ended"]


def _share(part: str, whole: str, low, good):
    """Votes on 100 * part / whole: low if ``low`` holds of it, good if ``good`` does."""
    return lambda c: low(100 * c[part], c[whole]), lambda c: good(100 * c[part], c[whole])


#: name, family, votes low if, votes good if (after the first); each on counts as arrays, and only for texts with words
RULES = [
    ("symbols", "marks", *_share("n_symbols", "n_words", lambda x, n: x > 20 * n, lambda x, n: x <= 5 * n)),
    ("plain_words", "marks", *_share("n_plain", "n_words", lambda x, n: x < 75 * n, lambda x, n: x >= 95 * n)),
    ("lettered_words", "letters", *_share("n_lettered", "n_words", lambda x, n: x < 80 * n, lambda x, n: x >= 95 * n)),
    ("letters", "letters", *_share("n_letters", "word_chars", lambda x, n: x < 75 * n, lambda x, n: x >= 90 * n)),
    ("function_words", "language", *_share("n_function", "n_words", lambda x, n: x < 6 * n, lambda x, n: x >= 15 * n)),
    ("repeats", "repetition", *_share("n_repeat_words", "n_words", lambda x, n: x > 15 * n, lambda x, n: x <= 2 * n)),
    ("doubled_words", "repetition", *_share("n_doubled", "n_words", lambda x, n: x > 10 * n, lambda x, n: x <= 2 * n)),
    ("lines", "layout", *_share("n_dup_lines", "n_lines", lambda x, n: x > 15 * n, lambda x, n: x == 0)),
    ("line_ends", "layout", *_share("n_ended", "n_lines", lambda x, n: x < 30 * n, lambda x, n: x >= 80 * n)),
    ("word_length", "form", lambda c: (c["word_chars"] < 3 * c["n_words"]) | (c["word_chars"] > 8 * c["n_words"]), lambda c: (10 * c["word_chars"] >= 42 * c["n_words"]) & (c["word_chars"] <= 7 * c["n_words"])),
    ("capitals", "form", *_share("n_upper", "n_letters", lambda x, n: x > 30 * n, lambda x, n: x <= 10 * n)),
]
LOW, ABSTAIN, GOOD = 0, 1, 2
FAMILIES = sorted({family for _, family, _, _ in RULES})
FAMILY = np.array([FAMILIES.index(family) for _, family, _, _ in RULES])
#: documents known beforehand (good, low), and for each rule votes known beforehand: (low, all) on good documents, (low, all) on low ones
PRIOR = (9.0, 1.0), ((1.0, 20.0), (10.0, 20.0))


def _per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _twice(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur more than once, and which of them are not the first in sorted order."""
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    many, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    many[order[1:]] |= same
    many[order[:-1]] |= same
    later[order[1:]] = same
    return many, later


def _hashes(listed: list[str]) -> np.ndarray:
    raw = [w.encode() for w in listed]
    ends = np.cumsum([len(w) for w in raw])
    return np.sort(span_hash(prefix_hash(np.frombuffer(b"".join(raw), np.uint8)), ends - [len(w) for w in raw], ends))


def _lines(text: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the lines with a word."""
    begin = np.unique(np.concatenate([off[:-1], np.flatnonzero(text == 10) + 1]))
    begin = begin[begin < len(text)]
    end = np.append(begin[1:], len(text))
    end = np.where((end > begin) & (text[np.maximum(end - 1, 0)] == 10), end - 1, end)
    filled = np.concatenate([[0], np.cumsum(~SPACE[text], dtype=np.int64)])
    keep = filled[end] > filled[begin]
    return begin[keep], end[keep]


def text_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of every text of a batch."""
    out: list[list[np.ndarray]] = []
    function = _hashes(FUNCTION)
    for a, b in groups(offsets):
        base = int(offsets[a])
        text, off = data[base : int(offsets[b])], offsets[a : b + 1] - base
        n_rows = b - a
        s, e, count = words(text, off)
        p = prefix_hash(text)
        n_words = np.diff(count)
        row_of = np.repeat(np.arange(n_rows), n_words)
        per_row = lambda mask, rows=row_of, n=n_rows: np.bincount(rows[mask], minlength=n)
        h = span_hash(p, s, e)
        w = window_hash(h, WINDOW)
        repeat = np.zeros(n_rows, np.int64)
        if len(w):
            inside = np.flatnonzero(row_of[: len(w)] == row_of[WINDOW - 1 :])
            many, _ = _twice(mix(w[inside] + mix(row_of[inside].astype(U))))
            cover = np.zeros(len(row_of) + 1, np.int64)
            cover[inside[many]] += 1
            np.subtract.at(cover, inside[many] + WINDOW, 1)
            repeat = per_row(np.cumsum(cover[:-1]) > 0)
        held = lambda mask: (lambda c: c[e] - c[s])(np.concatenate([[0], np.cumsum(mask[text], dtype=np.int64)]))  # noqa: B023, E731
        lettered = held(LETTER) > 0
        doubled = np.zeros(len(h), bool)
        doubled[1:] = (h[1:] == h[:-1]) & (row_of[1:] == row_of[:-1])
        bare = e - (STOPS[text[e - 1]] & (e - s > 1)) if len(e) else e
        lower = span_hash(prefix_hash(LOWER[text]), s, bare)
        known = function[np.minimum(np.searchsorted(function, lower), len(function) - 1)] == lower
        begin, end = _lines(text, off)
        line_row = np.searchsorted(off, begin, "right") - 1
        _, later = _twice(mix(span_hash(p, begin, end) + mix(line_row.astype(U))))
        solid = np.maximum.accumulate(np.where(SPACE[text], -1, np.arange(len(text)))) if len(text) else np.zeros(0, np.int64)
        ended = ENDS[text[solid[end - 1]]] if len(end) else np.zeros(0, bool)
        out.append([
            n_words, _per_text(LEAD[text] & ~SPACE[text], off), _per_text(SYMBOLS[text], off), per_row(later, line_row), repeat,
            np.bincount(line_row, minlength=n_rows), _per_text(UPPER[text], off), _per_text(LETTER[text], off),
            per_row(lettered & (held(MARKS) == 0)), per_row(lettered), per_row(known), per_row(doubled), per_row(ended, line_row),
        ])
    return {c: np.concatenate([x[i] for x in out]).astype(np.int64) if out else np.zeros(0, np.int64) for i, c in enumerate(COUNTS)}


def base_failed(c: dict[str, np.ndarray]) -> np.ndarray:
    return (c["n_words"] < 20) | (100 * c["n_repeat_words"] > 30 * c["n_words"])


def patterns(c: dict[str, np.ndarray]) -> np.ndarray:
    """The votes of all rules on each text as one number in base 3."""
    out = np.zeros(len(c["n_words"]), np.int64)
    for _, _, low, good in RULES:
        vote = np.where(low(c), LOW, np.where(good(c), GOOD, ABSTAIN))
        out = 3 * out + np.where(c["n_words"] > 0, vote, ABSTAIN)
    return out


def votes_of(keys: list[int]) -> np.ndarray:
    return np.array([[k // 3**i % 3 for i in range(len(RULES))][::-1] for k in keys], np.int64).reshape(-1, len(RULES))


def estimated(counts: dict[int, int], rounds: int = 500) -> tuple[dict[int, float], np.ndarray]:
    """The posterior probability of being good for each pattern, and each rule's rates of low votes on good and on low documents.

    A vote weighs one over the number of votes of its family on the document.  At the
    start a document is as likely low as its share of low votes says.
    """
    keys = sorted(counts)
    weight = np.array([counts[k] for k in keys], float)
    votes = votes_of(keys)
    cast = votes != ABSTAIN
    low = (votes == LOW).astype(float)
    family = np.eye(len(FAMILIES))[FAMILY]
    share = cast / np.maximum(1, (cast @ family) @ family.T)
    (good_docs, low_docs), seen = PRIOR
    good = 1 - (low * share).sum(1) / np.maximum(1, share.sum(1))
    rates = np.array([[a / n] * len(RULES) for a, n in seen])
    for _ in range(rounds):
        prior = (weight @ good + good_docs) / (weight.sum() + good_docs + low_docs)
        rates = np.array([((weight * g) @ low + a) / ((weight * g) @ cast + n) for g, (a, n) in zip((good, 1 - good), seen)])
        says = low * np.log(rates[0] / rates[1]) + (cast - low) * np.log((1 - rates[0]) / (1 - rates[1]))
        odds = np.log(prior / (1 - prior)) + (share * says).sum(1)
        after = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        done = not len(after) or np.abs(after - good).max() < 1e-9
        good = after
        if done:
            break
    return dict(zip(keys, good.tolist())), rates


def fit(counts: dict[int, int]) -> dict[int, float]:
    """The posterior probability of being good for each pattern, by expectation-maximisation."""
    return estimated(counts)[0]


FEATURES = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, pattern long"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        c = text_counts(*flat(batch.column(1)))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c[k]) for k in COUNTS), pa.array(base_failed(c)), pa.array(patterns(c))], ["doc_id", *COUNTS, "base_failed", "pattern"])
    trim()


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("body")).mapInArrow(_features, FEATURES)


def posteriors(found: DataFrame) -> dict[int, float]:
    """Fits on the vote patterns of all rows that pass the base; at most 3**len(RULES) of them reach the driver."""
    return fit({r["pattern"]: r["n"] for r in found.where(~F.col("base_failed")).groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()})


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without those that fail the base or are more likely low than good."""
    good = posteriors(features(docs, id_col, text_col).select("pattern", "base_failed"))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = text_counts(*flat(batch.column(at)))
            likely = np.array([good.get(k, 1.0) >= 0.5 for k in patterns(c).tolist()], bool)
            yield batch.filter(pa.array(likely & ~base_failed(c)))

    return docs.mapInArrow(run, docs.schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = written(features(table(spark, sf_dir, "documents")), "features")
    good = spark.createDataFrame(sorted(posteriors(found).items()), "pattern long, p_good double")
    kept = ~F.col("base_failed") & (F.coalesce("p_good", F.lit(1.0)) >= 0.5)
    return found.join(F.broadcast(good), "pattern", "left").select("doc_id", *COUNTS[:5], "base_failed", kept.alias("kept"), "p_good")  # at most 3**len(RULES) rows
