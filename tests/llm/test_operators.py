"""The operators against brute force, on small tables with all kinds of odd rows, and on empty tables."""

import collections
import hashlib
import math
import random
import re
import zlib
from array import array

import duckdb
import pytest
from pyspark.sql import functions as F
from termloom.llm import near_dedup, packing, quality, suffix_dedup, topk, toxicity
from termloom.llm.bpe import ForcedBoundaryBpe, tokenizer_path
from termloom.llm.html_text import Page
from termloom.llm.queries import ORACLE_SQL, QUERIES

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: names that operators use inside
CLASH = ("doc", "body", "key", "n", "rep", "component", "shard", "salt", "host", "path", "block", "bucket", "score", "length", "rank", "pattern", "starts", "u", "v", "regs", "dim", "stack")


def texts():
    random.seed(11)
    words = ["alpha", "beta", "Gamma", "delta", "été", "zeta", "日本", "tha", "ing", "###", "x|y"]
    base = [" ".join(random.choice(words) + str(random.randint(0, 40)) for _ in range(120)) for _ in range(4)]
    out = [None, "", " \n\t", "one", "two words", "a\n\na\nb", "x" * 5000, "aé" * 300, "<|endoftext|> and <|startoftext|>", "\x00\x1c\x7f"]
    for b in base:
        out += [b, b, b.upper(), b.replace("alpha1", "omega"), b[: len(b) // 2] + " mid " + b[len(b) // 2 :]]
        w = b.split()
        for k in (1, 3, 9, 27):
            out.append(" ".join([*w[:-k], *["new" + str(i) for i in range(k)]]))
    out += ["you idiot trash", "what an idiiot and trassh", 'she said "idiot" once'] * 6 + ["a clean text of plain words"] * 4
    out.append(" ".join(random.choice(words) for _ in range(40_000)))
    return list(enumerate(out)) + [(None, "no id here")]


TEXTS = texts()
VECTORS = [(i, [random.Random(i % 37).uniform(-1, 1) for _ in range(6)], i % 3) for i in range(230)] + [(900, None, 0), (1000, [], 0), (1100, [1.0, None], 0), (1200, [float("nan")] * 6, 0), (1300, [1.0, 2.0], 0), (1301, [2.0, 1.0], 0)]
PAGES = [(i, u, h) for i, (u, h) in enumerate([
    (None, None), ("nothing", ""), ("http://WWW.Example.com/en/x?y#z", "<p>a</p>"), ("https://net/fr/1", "<html><nav>m</nav><article><h1>T</h1><p>one &amp; <b>two</b><br>three</article><footer>f"),
    ("http://a.net/es/", "<<<>>><p"), ("http://example.com", "plain"), ("ftp://x.example.com/en", "<div id=content>text<div class='ad'>no</div></div>"), ("http://com/", "<script>var a='</p>'</script>ok"), ("http://evilexample.com/en/", "<!-- c --><p>z"),
    ("http://www.example.com/en/a://b/net/es/", "<main>m</main>" * 3), ("://example.com/en/", "&#x41;"), *[("http://h.org/p", f"<body><div class=menu>m</div><div class=post><p>story {i}</p></div><div class=x>same on all</div></body>") for i in range(6)],
])]


def tables(spark, folder, empty=False):
    docs = spark.createDataFrame([(d, t, "en", "src", len(t) if t is not None else None) for d, t in TEXTS], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(d, int("clean" in t), int("idiot" in t)) for d, t in TEXTS if t and d is not None and ("idiot" in t or "clean" in t)], "doc_id long, quality int, toxic int")
    for name, df in (("documents", docs), ("labels", labels), ("pages", spark.createDataFrame(PAGES, "page_id long, url string, html string")), ("embeddings", spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>, label int"))):
        extra = [c for c in CLASH if c not in df.columns]
        df.withColumns({c: F.lit(None).cast("string") for c in extra}).limit(0 if empty else 1_000_000).repartition(3).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("odd"))


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("none"), empty=True)


def rows(df):
    return {r[0]: tuple(r) for r in df.collect()}


@pytest.mark.parametrize("name", QUERIES)
def test_empty_tables(spark, none, name):
    assert QUERIES[name](spark, none).count() == 0


def test_repeated_rows(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.union(docs).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("op1_suffix_dedup", "op4_near_dedup", "op5_quality", "op6_bpe", "op8_sharding"):
        assert QUERIES[name](spark, str(tmp_path)).count() == 2 * len(TEXTS)
    once, twice = rows(QUERIES["op1_suffix_dedup"](spark, sf)), rows(QUERIES["op1_suffix_dedup"](spark, str(tmp_path)))
    assert once == twice
    assert rows(QUERIES["op4_near_dedup"](spark, sf)) == rows(QUERIES["op4_near_dedup"](spark, str(tmp_path)))


def repeats(pairs=TEXTS):
    """For each document its bytes and the places that stand earlier in a 100-byte string."""
    seen = set()
    for d, t in sorted(pairs, key=lambda x: -1 if x[0] is None else x[0]):
        b, gone = (t or "").encode(), set()
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone.update(range(p, p + 100))
            seen.add(b[p : p + 100])
        yield d, b, gone


def test_suffix_dedup(spark, sf):
    want = {}
    for d, b, gone in repeats():
        spans = sum(p - 1 not in gone for p in gone)
        want[d] = (d, len(b), len(gone), spans, hashlib.sha256(bytes(x for i, x in enumerate(b) if i not in gone)).hexdigest())
    assert rows(QUERIES["op1_suffix_dedup"](spark, sf)) == want
    assert sum(w[2] for w in want.values()) > 1000


def test_grams_in_many_places_are_split(spark):
    """A line, a passage and copies that most documents share, with grams that count as frequent from two or twenty places on."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    line, passage, copy = text(9)[:70], text(40), text(60)
    texts = [f"{text(rng.randint(0, 12))} {line} {text(rng.randint(0, 12))}" for _ in range(60)] + [f"{text(4)} {passage} {text(4)}" for _ in range(25)] + [copy] * 8 + [passage + passage, line * 5, "", None, passage[:99]]
    rng.shuffle(texts)
    pairs = list(enumerate(texts))
    bodies = spark.createDataFrame([(d, bytearray((t or "").encode())) for d, t in pairs], "doc long, body binary").repartition(5)
    want = {d: gone for d, _, gone in repeats(pairs) if gone}
    for many in (2, 20):
        got = {}
        for r in suffix_dedup.repeated_spans(bodies, 10_000, many).collect():
            got[r.doc] = {p for a, b in zip(r.starts, r.ends) for p in range(a, b)}
        assert got == want
    assert sum(map(len, want.values())) > 5000


def test_merge_runs_needs_no_known_prefix():
    random.seed(3)
    width = suffix_dedup.WIDTH
    make = lambda: bytes(random.choice(b"ab") for _ in range(6)).ljust(width, b"-")
    runs = [sorted(make() for _ in range(random.randint(0, 30))) for _ in range(7)]

    def coded(run):
        before = b""
        for k in run:
            yield k, next((i for i, (a, b) in enumerate(zip(before, k)) if a != b), min(len(before), len(k)))
            before = k

    got = list(suffix_dedup.merge_runs([coded(r) for r in runs]))
    assert [g[0] for g in got] == sorted(k for r in runs for k in r)
    for a, b in zip(got, got[1:]):
        assert b[1] == next((i for i in range(width) if a[0][i] != b[0][i]), width)


def components(pairs=TEXTS):
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    sets, least = {}, {}
    for d, t in pairs:
        w = WORD.findall((t or "").encode().translate(lower))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        least[d] = d
    order = lambda d: -1 if d is None else d

    def top(d):
        while least[d] != d:
            d = least[d]
        return d

    for a in sets:
        for b in sets:
            if a != b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)), key=order)
                least[y] = x
    return {d: (d, len(s), top(d), top(d) == d) for d, s in sets.items()}


def test_near_dedup(spark, sf):
    got, want = rows(QUERIES["op4_near_dedup"](spark, sf)), components()
    assert got == want
    assert sum(not w[3] for w in want.values()) > 10
    left = near_dedup.drop_near_duplicates(spark.read.parquet(f"{sf}/documents.parquet"))
    assert {r.doc_id for r in left.collect()} == {d for d, w in want.items() if w[3]}


def test_large_groups_are_cut_into_blocks(spark, monkeypatch):
    base = [f"w{i}" for i in range(200)]
    text = lambda i: " ".join([*base[: i % 190], f"e{i}", *base[i % 190 :]])
    docs = spark.createDataFrame([(i, text(i)) for i in range(700)], "doc_id long, text string")
    found = near_dedup.near_duplicates(docs).collect()
    assert {r.component for r in found} == {0}


def test_parts_of_a_large_group_meet(spark, monkeypatch):
    """Chains, two groups that one document joins, and strays, in buckets of many blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    rng = random.Random(17)
    word = lambda: "q" + str(rng.randrange(10**8))
    base = [word() for _ in range(120)]
    texts = []
    for i in range(40):  # each is near its neighbours only
        texts.append(" ".join(base[2 * i : 2 * i + 60] if i % 2 else base[2 * i - 2 : 2 * i + 58] if i else base[:60]))
    other = [word() for _ in range(90)]
    texts += [" ".join([*other[: k % 80], word(), *other[k % 80 :]]) for k in range(30)]
    far = [*other[:-12], *(word() for _ in range(12))]
    texts += [" ".join([*far[: k % 80], word(), *far[k % 80 :]]) for k in range(30)]
    texts += [" ".join([*other[:-6], *far[-6:]])] + [" ".join(word() for _ in range(50)) for _ in range(5)]
    pairs = list(enumerate(texts))
    rng.shuffle(pairs)
    found = {r.doc: (r.doc, r.n, r.component) for r in near_dedup.near_duplicates(spark.createDataFrame(pairs, "doc_id long, text string")).collect()}
    want = {d: w[:3] for d, w in components(sorted(pairs)).items()}
    assert found == want and len({w[2] for w in want.values()}) > 6
    stage = {r.doc_id for r in near_dedup.drop_near_duplicates(spark.createDataFrame(pairs, "doc_id long, text string")).collect()}
    assert stage == {d for d, w in want.items() if d == w[2]}


def test_quality(spark, sf):
    got = {r.doc_id: r for r in QUERIES["op5_quality"](spark, sf).collect()}
    for d, t in TEXTS:
        t = t or ""
        w = WORD.findall(t.encode())
        lines = [x for x in t.split("\n") if WORD.search(x.encode())]
        windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        twice = {k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
        failed = len(w) < 20 or 100 * len(twice) > 30 * len(w)
        assert tuple(got[d])[1:7] == (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(twice), failed)
        assert not (failed and got[d].kept)


def test_votes_are_weighed():
    """Low documents that a rule tells along with others are found, also where it is the only one to say so; abstentions say nothing."""
    n = len(quality.RULES)
    key = lambda **votes: sum(votes.get(f"r{i}", quality.GOOD) * 3 ** (n - 1 - i) for i in range(n))
    low = [key(r0=0, r4=0), key(r1=0, r4=0), key(r0=0, r1=0, r4=0), key(r4=0), key(r1=0, r4=0, r5=1)]
    clean = [key(), key(r1=1), key(r1=1, r2=1)]
    good = quality.fit({**dict.fromkeys(low, 250), clean[0]: 8000, clean[1]: 300, clean[2]: 200})
    assert all(good[k] < 0.5 for k in low) and all(good[k] > 0.9 for k in clean)


def test_accuracies_are_estimated():
    """Of two rules of equal standing the one that good documents often break is overruled, the other isn't."""
    name = {rule[0]: i for i, rule in enumerate(quality.RULES)}
    key = lambda **votes: sum((votes.get(r, quality.GOOD)) * 3 ** (len(name) - 1 - i) for r, i in name.items())
    junk = {key(symbols=0, function_words=0): 300, key(symbols=0, plain_words=0, function_words=0): 200, key(function_words=0, letters=0): 200}
    counts = {key(): 8000, key(lines=0): 900, key(lines=0, repeats=1): 300, **junk}
    good, rates = quality.estimated(counts)
    assert good[key(lines=0)] > 0.9 and good[key(lines=0, repeats=1)] > 0.9
    assert all(good[k] < 0.5 for k in junk)
    assert rates[0][name["lines"]] > 0.1 > 10 * rates[0][name["symbols"]] and rates[1][name["function_words"]] > 0.8


def test_posterior_is_not_all_must_pass(spark, tmp_path):
    """Whole texts: a low vote on repeated lines is outweighed by the other rules, one on symbols isn't."""
    rng = random.Random(6)
    prose = lambda n: " ".join(rng.choice(["the", "of", "and", "was"] if i % 3 == 0 else ["harbour", "window", "garden", "slowly", "letter", "winter"]) + ("." if i % 9 == 8 else "") for i in range(n)) + "."
    clean = [prose(rng.randint(40, 120)) for _ in range(300)]
    lined = [f"A line of licence.\n{prose(40)}\nA line of licence.\n{prose(30)}" for _ in range(60)]
    junk = [" ".join(w + rng.choice(["###", "%%%", "&&&"]) for w in prose(60).split()) for _ in range(40)]
    rows = list(enumerate([*clean, *lined, *junk]))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op5_quality"](spark, str(tmp_path)).collect()}
    assert all(got[i].n_dup_lines and not got[i].base_failed for i in range(300, 360))
    assert [got[i].kept for i in range(400)] == [True] * 360 + [False] * 40


def test_pivots_eliminate_and_lose_nothing():
    import numpy as np

    rng = np.random.default_rng(3)
    x = np.floor(1024 * (lambda v: v / np.linalg.norm(v, axis=1, keepdims=True))(rng.normal(size=(3000, 64))))
    x[1000:1400] = x[1000]
    ids = rng.permutation(3000)
    sample = rng.permutation(3000)[:1000]
    pivots = topk.Pivots(x[sample])
    places, offsets = pivots.table(x)
    bound, inner = places @ places.T + offsets[:, None] + offsets, x @ x.T
    assert (bound > inner - 1e-3).all()
    block = lambda own: topk.Block(*topk.Block.packed(ids[own], x[own], pivots), 64)
    q, every = block(ids % 100 == 0), block(ids >= 0)
    least = topk.first_scores(ids[sample], x[sample], q.ids, q.x, topk.K)
    place, seen = {int(d): i for i, d in enumerate(ids)}, 0
    for own, (found, score, n) in zip(q.ids, topk.best_of_block(q, every, least)):
        i = place[int(own)]
        want = sorted((-int(s), int(d)) for s, d in zip(inner[i], ids) if d != own)[: topk.K]
        assert [(-int(s), int(d)) for s, d in zip(score, found)] == want
        seen += n
    assert seen < 0.3 * 3000 * len(q.ids)


def test_topk_of_odd_rows(spark):
    """A query row that occurs twice gets its rows twice, one id with two vectors is two queries, huge components are exact."""
    rows = [(100, [1.0, 2.0]), (100, [1.0, 2.0]), (200, [1.0, 0.0]), (200, [0.0, -1.0]), *[(i, [float(i % 7), float(i % 5)]) for i in range(1, 40)], (7, [0.0, 2.0]), (300, [1e30, 1.0, 3.0]), (301, [1e30, 1.0, 2.0]), (302, [-1e30, 1.0, 2.0]), (303, [0.0, 1.0, 5e15])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).collect()
    floors = [(d, [math.floor(1024 * c) for c in v]) for d, v in rows]
    want = collections.Counter()
    for d, q in floors:
        if d % 100 == 0:
            own = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, v)))), n) for n, v in floors if n != d and len(v) == len(q))
            want.update((d, k + 1, n, -s) for k, (s, n) in enumerate(own[: topk.K]))
    assert collections.Counter(tuple(r) for r in got) == want


def test_bpe_and_packing(spark, sf):
    from tokenizers import Tokenizer

    word, byte = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")), Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = rows(QUERIES["op6_bpe"](spark, sf))
    for d, t in TEXTS:
        ids = word.encode(t or "", add_special_tokens=False).ids
        assert got[d] == (d, len(ids), sha(array("I", ids).tobytes()), sha(word.decode(ids, skip_special_tokens=False).encode()))
    placed = QUERIES["op7_packing"](spark, sf).collect()
    ids = {d: byte.encode(t or "", add_special_tokens=False).ids + [2] for d, t in TEXTS}
    assert sum(r.length for r in placed) == sum(map(len, ids.values()))
    full = collections.defaultdict(list)
    for r in placed:
        assert zlib.crc32(array("I", ids[r.doc_id][r.start : r.start + r.length]).tobytes()) == r.ids_crc32
        assert r.piece == 0 or r.length == packing.SIZE
        full[r.sequence_id].append((r.offset, r.length))
    for s in full.values():
        s.sort()
        assert s[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(s, s[1:])) and sum(s[-1]) <= packing.SIZE


def test_packing_with_many_parts_of_a_length(spark, monkeypatch):
    monkeypatch.setattr(packing, "SALTS", 2)
    monkeypatch.setattr(packing, "SALT_ROWS", 7)
    lengths = [1024] * 90 + [600] * 50 + [424] * 49 + [3] * 200
    pieces = spark.createDataFrame([(i, 0, n) for i, n in enumerate(lengths)], "doc_id long, piece int, length long")
    full = collections.defaultdict(list)
    for r in packing.pack(pieces, ["doc_id", "piece"]).collect():
        full[r.sequence_id].append((r.offset, r.length))
    assert sum(map(len, full.values())) == len(lengths)
    for s in full.values():
        s.sort()
        assert s[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(s, s[1:])) and sum(s[-1]) <= packing.SIZE
    assert len(full) == -(-sum(lengths) // packing.SIZE)


def test_forced_boundaries_against_the_library():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")), ForcedBoundaryBpe(tokenizer_path("word_bpe_49k.json"))
    random.seed(5)
    pool = ["a", "B", "é", "e\u0301", "Σ", "ΑΣ", "İ", "\x1c", "\x85", "  ", "\n", "'s", "'LL", "½", "<|endoftext|>", "<|", "!!!", "日本", "😀", "\u200d", "ǅ", "x" * 60, "힣", "thethe"]
    for _ in range(800):
        t = "".join(random.choice(pool) + random.choice(["", " "]) for _ in range(random.randint(0, 12)))
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == (array("I", ids).tobytes(), library.decode(ids, skip_special_tokens=False).encode())


def test_plan_uses_pairs_and_triples():
    rng = random.Random(12)
    counts = collections.Counter(min(1023, max(1, int(rng.lognormvariate(5.5, 1)))) for _ in range(20_000))
    plan = packing.plan(counts)
    used = collections.Counter()
    for parts, times in plan:
        assert sum(parts) <= packing.SIZE
        for p in parts:
            used[p] += times
    assert used == counts
    full = collections.Counter()
    for parts, times in plan:
        full[len(parts)] += times * (sum(parts) == packing.SIZE)
    bound = -(-sum(a * b for a, b in counts.items()) // packing.SIZE)
    assert full[2] > 100 and full[3] > 100 and full[4] > 10 and sum(k for _, k in plan) <= 1.002 * bound


def test_plan_fills_exactly():
    for counts in ({600: 10, 424: 10}, {500: 6, 300: 3, 224: 3}, {400: 4, 300: 4, 200: 4, 124: 4}):
        plan = packing.plan(counts)
        used = collections.Counter()
        for parts, times in plan:
            assert sum(parts) <= packing.SIZE
            for p in parts:
                used[p] += times
        assert used == counts
        assert sum(k for _, k in plan) == -(-sum(a * b for a, b in counts.items()) // packing.SIZE)


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet/*.parquet'")
    got = QUERIES[name](spark, sf)
    want = con.sql(ORACLE_SQL[name])
    order = [want.columns.index(c) for c in got.columns]
    key = lambda x: tuple((v is None, str(v)) for v in x)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=key)


def jump(draws, n):
    """The last number below n of the chain."""
    return max(x for x in draws if x < n)


def test_sharding(spark, sf):
    got = QUERIES["op8_sharding"](spark, sf).collect()
    text = dict(TEXTS)
    slots = collections.defaultdict(list)
    for r in got:
        body = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(body) + 8, zlib.crc32(body), "key") and r.grown_shard in (r.shard, 24)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    draws = {r[0]: r[1:] for r in spark.range(40).selectExpr("id", *[f"shiftrightunsigned(xxhash64(id, {i}), 33)" for i in range(1, 26)]).collect()}
    for r in got:
        if r.doc_id in draws:
            chain = [0]
            for x in draws[r.doc_id]:
                if chain[-1] < 25:
                    chain.append(int((chain[-1] + 1) * (2**31 / (x + 1))))
            assert (r.shard, r.grown_shard) == (jump(chain, 24), jump(chain, 25))


def test_toxicity(spark, sf):
    got = {r.doc_id: r for r in QUERIES["op9_toxicity"](spark, sf).collect()}
    assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    for d, t in TEXTS:
        assert got[d].held_out == (d is not None and zlib.crc32(str(d).encode()) % 5 == 0)
        if t == "you idiot trash":
            assert got[d].predicted == 1
        if t and "clean" in t:
            assert got[d].predicted == 0


def test_full_memos_change_no_score(monkeypatch):
    weights = {"idiot": 2.0, "trash": 1.5, "disgusting": 3.0}
    random.seed(4)
    many = [" ".join(random.choice(["idiot", "trsh", "trash", "disgustin", "calm"] + [f"w{i}" for i in range(40)]) for _ in range(60)) for _ in range(30)]
    want = [toxicity.Scorer(weights).features(t) for t in many]
    monkeypatch.setattr(toxicity, "MEMO", 7)
    monkeypatch.setattr(toxicity, "STATES", 5)
    scorer = toxicity.Scorer(weights)
    assert [scorer.features(t) for t in many] == want


def test_automata_accept_what_edit_distance_says():
    from functools import cache

    @cache
    def distance(a, b):
        return max(len(a), len(b)) if not a or not b else min(distance(a[1:], b) + 1, distance(a, b[1:]) + 1, distance(a[1:], b[1:]) + (a[0] != b[0]))

    terms = ["idiot", "trash", "disgusting", "scum"]
    lexicon = toxicity.Lexicon({t: 1.0 for t in terms})
    random.seed(9)
    for _ in range(1500):
        w = list(random.choice(terms))
        for _ in range(random.randint(0, 3)):
            i = random.randrange(len(w) + 1)
            w[i : i + random.randint(0, 1)] = random.choice(["", "s", "t", "x"])
        w = "".join(w)
        near = {t: distance(w, t) for t in terms if distance(w, t) <= (0 if len(t) < 4 else 1 if len(t) < 9 else 2)}
        found = lexicon.match(w)
        assert (found is not None) == bool(near) and (not near or near[found[0]] == found[1] == min(near.values()))
    begins = toxicity.Lexicon({"clow*": 1.0})
    assert begins.match("clowns") == ("clow*", 0) and begins.match("clo") is None
    begins = toxicity.Lexicon({"idiot*": 1.0, "tat": 1.0})
    for word in ("idiotisch", "idotisch", "idioltisch", "idiatisch", "didiotisch", "tat", "tst", "idoltisch"):
        edits = min(distance(word[:k], "idiot") for k in range(len(word) + 1))
        assert begins.match(word) == (("idiot*", edits) if edits < 2 else ("tat", 0) if word == "tat" else None), word


def test_page_text():
    page = "<html><head><title>t</title><body><header>top</header><nav>menu</nav><div class='cookie-notice'>c</div><div id='content'><h1>T&eacute;</h1><p>One <b>two</b>three<p>four<ul><li>a<li>b</ul><form>f</form><div class=comments><article class=comment>c</article></div></div><aside>s</aside><footer>z"
    assert Page(page).text([], set()) == "Té One twothree four a b"
    assert Page("<article><p>x <!-- no --> y<script>if (a<b) '</p>'</script></p></article>").text([], set()) == "x y"


def test_page_queries(spark, sf):
    got = rows(QUERIES["op10_html_extraction"](spark, sf))
    assert len(got) == len(PAGES) and got[0][2] == "" and got[3][2] == "T one & two three"
    assert all(r[3] == len(r[2]) for r in got.values())
    assert {got[i][2] for i in range(11, 17)} == {f"story {i}" for i in range(6)}
