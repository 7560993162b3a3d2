"""Toxicity by Levenshtein automata intersected with a lexicon trie.

The lexicon is learned from labelled documents: words of any length, and beginnings of words
(BEGINNINGS letters, for languages that build compounds), that toxic documents have and others
hardly ever do.  A trie of the terms is intersected with the automata that accept
all strings within as many edits as ``allowed`` says; the product is made
deterministic as far as words lead into it, so a word costs one step a character
and most die after a few.

A hit counts as abuse or, if quotation marks or words of reporting stand in the
window around it, as quotation.  Exact and misspelled hits, and misspelled hits of
short terms, are sums of their own, so that the regression judges what each is worth.
A logistic regression turns the sums of a
document into its score.  Lexicon and regression are fitted on at most
``FIT_ROWS`` labelled documents (those with the least hash of doc_id, of which
``crc32(doc_id) mod 5`` is not 0), which are read once; the lexicon holds every
term of theirs that tells.  Every document is scored, whole.

Results for odd input: null and empty texts get the score of a document without
hits; a null doc_id is scored, comes back as null and counts as not held out;
repeated rows are scored each; without labels of both kinds every score is 0; an
empty table gives no rows; ``op9`` leaves other columns out, ``drop_toxic``
passes them by.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.common import small_batches, table, trim, written

#: bound of the sample that lexicon and regression are fitted on
FIT_ROWS = 20_000
#: letters of beginnings; a longer one is covered by its first twelve
BEGINNINGS = range(4, 13)
FOLDS = 5
#: tokens before and after a hit that tell quotation from abuse
CONTEXT = 6
#: matched tokens and automaton states that are kept from one text to the next
MEMO, STATES = 600_000, 200_000
EDGE = ".,;:!?|#*$%&<>()[]{}\"'`~^_=+/\\-“”„«»‘’…"
QUOTES = frozenset("\"“”„«»")
#: words of reporting in the languages at hand
REPORTING = {"said", "says", "quote", "quoted", "wrote", "word", "term", "called", "sagte", "schrieb", "wort", "zitat", "dit", "écrit", "mot", "citation", "dijo", "escribió", "palabra", "cita"}


#: stands for the rest of a word whose beginning was met
REST = -1


def normal(token: str) -> str:
    return token.lower().strip(EDGE)


def allowed(term: str) -> int:
    """Edits to a term: none below four letters, one below nine, two from there on; one in a beginning of five letters or more."""
    n = len(term.rstrip("*"))
    return min(1, n // 5) if term.endswith("*") else 0 if n < 4 else 1 if n < 9 else 2


class Lexicon:
    """A deterministic automaton for words within a few edits of the terms; ``term*`` stands for any word that begins so."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.child: list[dict[str, int]] = [{}]
        self.ends: list[str | None] = [None]
        self.begins: list[str | None] = [None]
        self.limit = [0]
        for term in sorted(weights):
            bare, node = term.rstrip("*"), 0
            edits = allowed(term)
            self.limit[0] = max(self.limit[0], edits)
            for c in bare:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.ends.append(None)
                    self.begins.append(None)
                    self.limit.append(0)
                node = self.child[node][c]
                self.limit[node] = max(self.limit[node], edits)
            if term.endswith("*"):
                self.begins[node] = term
            else:
                self.ends[node] = term
        self.forget()

    def forget(self) -> None:
        """Drops the states made so far; they are made again as words lead into them."""
        self.states: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.steps: list[dict[str, int]] = []
        self.found: list[tuple[str, int] | None] = []
        #: whether only the rest of a word is left, which changes nothing
        self.over: list[bool] = []
        self.start = self._state({(0, 0, "")})

    def _state(self, items: set[tuple[int, int, str]]) -> int:
        """The number of a set of (node, edits, beginning met), with what a missing character leads to."""
        best: dict[tuple[int, str], int] = {}
        todo = list(items)
        while todo:
            node, e, met = todo.pop()
            if best.get((node, met), 9) <= e:
                continue
            best[node, met] = e
            if node >= 0:
                todo += [(n, e + 1, met) for n in self.child[node].values() if e < self.limit[n]]
                begun = self.begins[node]
                if begun and e <= allowed(begun):
                    todo.append((REST, e, begun))
        key = tuple(sorted((n, e, m) for (n, m), e in best.items()))
        if key not in self.states:
            hits = [(e, 0, t) for n, e, _ in key if n >= 0 and (t := self.ends[n]) and e <= allowed(t)]
            hits += [(e, -len(m), m) for n, e, m in key if n == REST]
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            self.over.append(all(n == REST for n, _, _ in key))
            nearest = min(hits, key=lambda h: (h[0], h[1] < 0, h[1], h[2])) if hits else None
            self.found.append((nearest[2], nearest[0]) if nearest else None)
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        after: set[tuple[int, int, str]] = set()
        for node, e, met in self.sets[state]:
            if node == REST:
                after.add((node, e, met))
                continue
            n = self.child[node].get(c)
            if n is not None:
                after.add((n, e, met))
            if e < self.limit[node]:
                after.add((node, e + 1, met))
                after.update((m, e + 1, met) for k, m in self.child[node].items() if k != c and e < self.limit[m])
        out = self.steps[state][c] = self._state(after) if after else -1
        return out

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term and the edits to it."""
        if len(self.sets) >= STATES:
            self.forget()
        state, steps, over = self.start, self.steps, self.over
        for c in word:
            after = steps[state].get(c)
            state = self._step(state, c) if after is None else after
            if state < 0:
                return None
            if over[state]:
                break
        return self.found[state]


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and other documents of a task have each term; the empty term stands for all documents."""
    pos, neg = Counter(), Counter()
    for batch in batches:
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = {w for t in set(text.split()) if (w := normal(t))}
            (pos if y > 0 else neg).update(words | {w[:k] + "*" for w in words for k in BEGINNINGS if k < len(w)} | {""})
    terms = list({**pos, **neg})
    if terms:
        yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array([pos[t] for t in terms], pa.int64()), pa.array([neg[t] for t in terms], pa.int64())], ["term", "pos", "neg"])


def learned_terms(counts: list[tuple[str, int, int]], n_pos: int, n_neg: int) -> dict[str, float]:
    """Terms and their weights (log odds); a beginning must cover clearly more than any longer one, and a term whose beginning is one already adds nothing."""
    support = {t: p for t, p, _ in counts}
    longer: dict[str, int] = Counter()
    for t, p in support.items():
        bare = t.rstrip("*")
        for shorter in ({bare[:-1] + "*"} if t.endswith("*") else {bare[:k] + "*" for k in (len(bare) - 1, len(bare), BEGINNINGS[-1])}):
            longer[shorter] = max(longer[shorter], p)
    counts = [x for x in counts if not x[0].endswith("*") or 10 * longer[x[0]] < 7 * x[1]]
    scored = {t: (math.log((p + 0.5) / (n_pos + 1)) - math.log((n + 0.5) / (n_neg + 1)), p) for t, p, n in counts}
    out: dict[str, float] = {}
    for t in sorted(scored, key=lambda t: (-scored[t][0] * math.log1p(scored[t][1]), t)):
        bare = t.rstrip("*")
        if not any(bare[:k] + "*" in out for k in BEGINNINGS if k <= len(bare)):
            out[t] = scored[t][0]
    return out


N_FEATURES = 9
#: misspelled hits of terms up to so many letters are a sum of their own
SHORT = 4


#: what a token tells about quotation
NOTHING, QUOTE, REPORT = 0, 1, 2
#: of tokens that are no hit and tell nothing
UNTOLD = (None, NOTHING)


class Scorer:
    def __init__(self, weights: dict[str, float]):
        self.lexicon = Lexicon(weights)
        #: of each token: its term and edits, or None, and what it tells about quotation
        self.memo: dict[str, tuple[tuple[str, int] | None, int]] = {}

    def read(self, token: str) -> None:
        word = normal(token)
        told = REPORT if word in REPORTING else NOTHING if QUOTES.isdisjoint(token) else QUOTE
        found = self.lexicon.match(word) if word else None
        self.memo[token] = (found, told) if found or told else UNTOLD

    def features(self, text: str) -> list[float]:
        tokens = text.split()
        memo, terms = self.memo, set()
        if len(memo) >= MEMO:  # between texts only: below, all tokens of this one are in it
            memo.clear()
        abuse = quoted = fuzzy = near = short = most = 0.0
        for t in set(tokens).difference(memo):
            self.read(t)
        seen = [memo[t] for t in tokens]
        told = None
        for i, (found, _) in enumerate(seen):
            if not found:
                continue
            term, edits = found
            w = self.lexicon.weights[term] * 0.6**edits
            if edits and len(term) <= SHORT:
                short += w
                continue
            told = told or [x for _, x in seen]
            around = told[max(0, i - CONTEXT) : i + CONTEXT + 1]
            if REPORT in around or around.count(QUOTE) >= 2:
                quoted += w
            else:
                abuse += w
                most = max(most, w)
            near += w * (edits > 0)
            fuzzy += edits > 0
            terms.add(term)
        return [math.log1p(abuse), math.log1p(quoted), math.log1p(fuzzy), math.log1p(near), math.log1p(short), math.log1p(len(terms)), most, math.sqrt(abuse / (len(tokens) + 20)), math.log1p(len(tokens))]


def regression(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, scales and coefficients (the last is the constant) by Newton's method."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    b = np.zeros(z.shape[1])
    keep = np.diag([ridge] * (z.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + keep, z.T @ (y - p) - keep @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, b


def fold(id_col: str) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"):
    """(weights, regression) from at most FIT_ROWS labelled documents of the learning folds, or None."""
    small_batches(docs.sparkSession)
    chosen = labels.select(F.col(id_col).alias("__tl_id"), F.col(label_col).alias("__tl_y")).where(F.col("__tl_y").isNotNull() & (fold("__tl_id") != 0)).groupBy("__tl_id").agg(F.max("__tl_y").alias("__tl_y")).orderBy(F.xxhash64("__tl_id"), "__tl_id").limit(FIT_ROWS)
    sample = docs.join(F.broadcast(chosen), docs[id_col] == F.col("__tl_id")).select("__tl_id", F.coalesce(docs[text_col], F.lit("")).alias("t"), F.col("__tl_y").cast("int").alias("y"))
    sample = written(sample.groupBy("__tl_id", "y").agg(F.min("t").alias("t")).select("t", "y"), "labelled")  # one row for each of at most FIT_ROWS ids
    counts = sample.mapInArrow(_term_counts, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    counts = written(counts.where((F.col("term") == "") | (F.col("pos") >= 4)), "terms")
    total = counts.where("term = ''").first()
    if not total or not total["pos"] or not total["neg"]:
        return None
    # of each 20 documents with a term at least 13 are toxic, and of 300 toxic documents one at least has it
    telling = counts.where(F.col("term") != "").where((F.col("pos") >= max(4, total["pos"] // 300)) & (F.col("pos") * 20 >= (F.col("pos") + F.col("neg")) * 13))
    weights = learned_terms([tuple(r) for r in telling.orderBy(F.desc("pos"), "neg", "term").collect()], total["pos"], total["neg"])
    if not weights:
        return None

    def measured(batches):
        scorer = Scorer(weights)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([scorer.features(t) for t in batch.column(0).to_pylist()], pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    rows = sample.mapInArrow(measured, "x array<double>, y int").collect()  # at most FIT_ROWS rows of N_FEATURES numbers
    rows.sort(key=lambda r: (r["x"], r["y"]))
    return weights, regression(np.array([r["x"] for r in rows]), np.array([r["y"] > 0 for r in rows], float))


def scores(scorer: Scorer, model, texts: list[str | None]) -> np.ndarray:
    mean, scale, b = model
    x = np.array([scorer.features(t or "") for t in texts]).reshape(-1, N_FEATURES)
    return 1 / (1 + np.exp(-np.clip((x - mean) / scale @ b[:-1] + b[-1], -30, 30)))


def _scored(fitted, at: int):
    """For each batch its scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        scorer = Scorer(fitted[0]) if fitted else None  # its memo goes with the task, as later stages need the memory
        for batch in batches:
            yield batch, (scores(scorer, fitted[1], batch.column(at).to_pylist()) if fitted else np.zeros(batch.num_rows))
        trim()

    return run


def toxicity(docs: DataFrame, fitted, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row."""
    small_batches(docs.sparkSession)
    score = _scored(fitted, 2)

    def run(batches):
        for batch, s in score(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(fold(id_col) == 0, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, fitted, text_col: str = "text") -> DataFrame:
    """``docs`` without those that score one half or more."""
    small_batches(docs.sparkSession)
    score = _scored(fitted, docs.columns.index(text_col))

    def run(batches):
        for batch, s in score(batches):
            yield batch.filter(pa.array(s < 0.5))

    return docs.mapInArrow(run, docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
