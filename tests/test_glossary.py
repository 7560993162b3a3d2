import datetime
import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F
from termloom.functions import text as X
from termloom.operators import geometry as G
from termloom.operators import layout as L
from termloom.operators import sequence as S
from termloom.operators import store as R
from termloom.operators import vision as V
from termloom.plans import export, ingest
from termloom.schemas import TERMS, TSV_WORDS
from termloom.sources.words import merged_config, words_of
from termloom.streaming.ingest import ingest_stream


def one(spark, function, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(function(F.col("v"))).collect()]


def test_cleaning(spark):
    assert one(spark, X.clean_word, "word x", "x word", "a x b", "BNA text", None, "ཀཁ abc", "མེད'a") == ["word", "word", "a b", "text", "", "ཀཁ", "མེད"]
    long = "ཀ" * 25 + "་" + "ཁ" * 10
    assert one(spark, X.cut_term, "ཀཁ།ག", "ཀཁ", "ཀ་", "", long, "ཀ" * 40) == ["ཀཁ།", "ཀཁ།", "ཀ་", "", "ཀ" * 25 + "་", "ཀ" * 25 + "..."]
    assert one(spark, X.clean_definition, "ཀ 12 ABC ཁ", None, "ས་སུ་ག") == ["ཀཁ", "", "ག"]
    assert one(spark, X.subject_code, "com, Econ", "Bio.", "zzz", "com, zzz", None) == ["econ", "bio", "", "com", ""]
    assert one(spark, X.status_icon, "Verified", "reviewed", None, "odd") == ["✅", "🔍", "📝", "❓"]
    assert one(spark, lambda c: X.split_at_shad(c)[0], "ཀ།ཁ", "ཀ") == ["ཀ།", "ཀ"]
    assert one(spark, lambda c: X.split_at_shad(c)[1], "ཀ།ཁ", "ཀ") == ["ཁ", ""]
    assert one(spark, X.stacks, "བསྒྲུབས") == [["བ", "སྒྲུ", "བ", "ས"]]
    assert one(spark, X.page_break, "12", "word", " ", "absolute pressure 3") == [True, False, True, True]


def words(spark, rows):
    full = [("5", "1", "1", "1", "1", str(i), str(x), str(y), "10", "10", "90", t, "d") for i, (x, y, t) in enumerate(rows)]
    return words_of(spark.createDataFrame(full, ", ".join(f"{f.name} string" for f in TSV_WORDS) + ", doc string"))


def test_words_are_checked(spark):
    bad = [("4", *["1"] * 5, "1", "1", "1", "1", "9", "a", "d"), ("5", *["1"] * 5, "x", "1", "1", "1", "9", "a", "d"), ("5", *["1"] * 5, "1", "1", "1", "1", "9", " ", "d"), ("5", *["1"] * 5, "1", "1", "1", "1", "9", "good", "d")]
    assert [r.text for r in words_of(spark.createDataFrame(bad, ", ".join(f"{f.name} string" for f in TSV_WORDS) + ", doc string")).collect()] == ["good"]


def test_entries(spark):
    rows = [
        (900, 0, "bot"), (10, 30, "abiotic"), (60, 31, "factor"), (849, 59, "end"), (850, 32, "bio"), (1100, 30, "ཀཁ།"), (1420, 30, "དདད"), (1460, 30, "ངང"),
        (20, 60, "more"), (900, 60, "zzz"), (1420, 60, "ཚ"), (1500, 60, "ག"), (10, 180, "far"), (900, 210, "econ"), (1459, 210, "ཞ"),
    ]
    got = [(r.english, r.subject, r.term, r.definition) for r in ingest.entries(words(spark, rows), ["doc"]).orderBy("entry").collect()]
    assert got == [("abiotic factor end more", "bio", "ཀཁ།ཚ", "ངངག"), ("far", "econ", "ཞ", "")]


def test_entries_begin_as_a_fold_says(spark):
    random.seed(4)
    for _ in range(4):
        rows, want, current, before = [], 0, False, None
        for line in sorted(random.sample(range(0, 3000, 30), 25)):
            english, subject = random.random() < 0.6, random.random() < 0.3
            rows += ([(10, line, "w")] if english else []) + ([(900, line, "bio")] if subject else []) + [(1200, line, "ཀ")]
            if english and (subject or not current or line - before > ingest.GAP):
                want, current = want + 1, True
            before = line
        assert ingest.entries(words(spark, rows), ["doc"]).count() == want


def test_new_terms(spark):
    rows = []
    for i, (e, s, t) in enumerate([("alpha", "bio", "ཀ།"), ("alph", "bio", "ཀ།"), ("beta", "zzz", "ཁ།"), ("beta", "bio", "ཁ།"), ("old", "bio", "ག།")]):
        rows += [(10, 300 * i, e), (900, 300 * i, s), (1200, 300 * i, t)]
    stored = spark.createDataFrame([("older", "ག།")], "source_term string, target_term string")
    got = ingest.new_terms(words(spark, rows), stored, ["doc"]).collect()
    assert sorted((r.source_term, r.context) for r in got) == [("alpha", "bio"), ("beta", "bio")]


def test_dropping_contained_equals_a_fold(spark):
    random.seed(8)
    names = ["".join(random.choice("ab") for _ in range(random.randint(1, 4))) for _ in range(120)]
    kept = []
    for i, n in enumerate(names):
        if not any(n in names[j] for j in kept):
            kept.append(i)
    df = spark.createDataFrame([("k", n, i) for i, n in enumerate(names)], "k string, n string, i int")
    assert sorted(r.i for r in R.drop_contained(df, "k", "n", "i").collect()) == kept


def terms(spark):
    at = lambda d: datetime.datetime(2024, 1, d)
    rows = [(1, "Śamatha", "sa", "zhi", "bo", "ctx", "ann", at(1), None, None), (2, "a%b", "sa", "x", "bo", " ", None, at(2), "draft", None), (3, "c", "en", "SHI", "bo", None, "bob", at(2), "approved", "n")]
    return spark.createDataFrame(rows, TERMS)


def test_store(spark):
    t = terms(spark)
    found = lambda p: [r.id for r in R.search(t, p, ["source_term", "target_term"], [F.desc("date_added"), F.desc("id")]).collect()]
    assert found("HI") == [3, 1] and found("śam") == [1] and found("a_b") == [2] and found("zzz") == []
    assert [r.id for r in R.recent(t, 2, F.desc("date_added"), F.desc("id")).collect()] == [3, 2]
    new = spark.createDataFrame([("n", "en", "t", "bo"), (None, "en", "t", "bo")], "source_term string, source_language string, target_term string, target_language string")
    full, rejected = R.insert(t, new, ["source_term"])
    assert sorted(r.id for r in full.collect()) == [1, 2, 3, 4] and rejected.count() == 1
    assert [r.verified_status for r in R.update(t, F.col("id") == 1, {"verified_status": F.lit("reviewed")}).orderBy("id").collect()] == ["reviewed", "draft", "approved"]
    assert {r.id for r in R.delete(t, spark.createDataFrame([(2,)], "id long"), "id").collect()} == {1, 3}


def test_export(spark):
    text = "".join(r.line for r in export.export_recent(terms(spark), "2023-12-31 00:00:00").orderBy("position").collect())
    assert text.count("🌍") == 2 and text.startswith("🌍 *EN → BO*") and "_ctx_" in text and "👤 bob" in text
    assert export.export_by_contributor(terms(spark), "ann").count() == 1


def test_geometry(spark):
    boxes = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 5.0), (1, 2, 8.0, 0.0, 4.0, 5.0), (1, 3, 30.0, 0.0, 4.0, 5.0)], "page int, id int, x double, y double, w double, h double")
    assert tuple(G.bounding(boxes, ["page"]).first()) == (1, 0.0, 0.0, 34.0, 5.0)
    assert [(r.x, r.w) for r in G.merge_hangoff(boxes, ["page"]).orderBy("x").collect()] == [(0.0, 12.0), (30.0, 4.0)]
    spans = spark.createDataFrame([("k", i, lo, hi) for i, (lo, hi) in enumerate([(0, 100), (10, 50), (20, 30), (60, 120)])], "k string, id int, lo int, hi int")
    inside = {(r.outer_id, r.inner_id) for r in G.innermost(G.contained(spans, spans, "k", "lo", "hi", "id"), "k").collect()}
    assert inside == {(0, 1), (1, 2)}
    assert sorted((r.lo, r.hi) for r in G.merge_overlaps(spans, "k", "lo", "hi").collect()) == [(0, 120)]
    marks = spark.createDataFrame([("k", 5, "a"), ("k", 10, "b")], "k string, at int, v string")
    assert [r.v for r in G.as_of(spark.createDataFrame([("k", x) for x in (4, 5, 9, 10)], "k string, p int"), marks, ["k"], "p", "at", "v").orderBy("p").collect()] == [None, "a", "a", "b"]


def test_leaders(spark):
    assert spark.range(1).select(L.leaders(F.array(*[F.lit(x) for x in (0, 20, 40, 60)]), 30)).first()[0] == [0, 40]


def test_viterbi_against_all_paths(spark):
    random.seed(2)
    start, steps = {0: 0.6, 1: 0.3, 2: 0.1}, {(a, b): [[0.7, 0.2, 0.1], [0.3, 0.4, 0.3], [0.1, 0.1, 0.8]][a][b] for a in range(3) for b in range(3)}
    seen = [(s, t, k, random.uniform(0.05, 1)) for s in range(6) for t in range(4) for k in range(3)]
    got = S.viterbi(spark.createDataFrame(seen, "seq long, t int, state int, p double"), start, steps).collect()
    p = {(s, t, k): v for s, t, k, v in seen}
    for s in range(6):
        value = lambda path: math.log(start[path[0]] * p[s, 0, path[0]]) + sum(math.log(steps[a, b] * p[s, t, b]) for t, (a, b) in enumerate(zip(path, path[1:]), 1))  # noqa: B023, E731
        assert tuple(r.state for r in sorted((r for r in got if r.seq == s), key=lambda r: r.t)) == max(itertools.product(range(3), repeat=4), key=value)


def test_kernels():
    page = np.full((60, 60), 255)
    page[10:20, 10:50] = 0
    ink = V.binarize(page)
    assert V.ink_profile(ink)[:5].sum() == 0 and V.ink_profile(page < 128)[15] == 40
    assert V.transitions(page < 128)[15] == 2
    assert V.sobel_histogram(page).shape == (192,)
    weight, mean, dev = V.mixture(np.array([1.0] * 30 + [1.2] * 30 + [9.0] * 30 + [9.4] * 30))
    assert np.allclose(weight, 0.5, atol=0.01) and abs(mean[0] - 1.1) < 0.01 and abs(mean[1] - 9.2) < 0.01
    assert np.allclose(V.kmeans_1d(np.array([1.0, 2, 3, 11, 12, 13]), 2), [2, 12])


def test_image_pieces():
    rng = np.random.default_rng(3)
    for _ in range(20):
        ink = rng.random((14, 17)) < 0.35
        labels, boxes = V.components(ink)
        left, n = {tuple(p) for p in np.argwhere(ink)}, 0
        while left:
            todo, piece = [min(left)], set()
            while todo:
                y, x = todo.pop()
                if (y, x) in left:
                    left.remove((y, x))
                    piece.add((y, x))
                    todo += [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
            n += 1
            (k,) = {int(labels[p]) for p in piece}
            ys, xs = zip(*piece)
            assert tuple(boxes[k - 1]) == (min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(piece))
        assert n == len(boxes)
    assert V.components(np.zeros((3, 3), bool))[1].shape == (0, 5)
    page = rng.random((32, 32))
    assert V.zernike(page).shape == (90,) and np.allclose(V.zernike(page), V.zernike(np.rot90(page)))
    y, x = np.indices((200, 200))
    assert V.skew((np.round(y - np.tan(np.radians(3)) * x) % 25) == 0) == 3 and V.skew(y % 25 == 0) == 0
    assert V.skew(np.zeros((4, 4), bool)) == 0
    assert np.allclose(V.mixture(np.array([1.0, 2, 9]), np.array([3, 1, 4])), V.mixture(np.array([1.0, 1, 1, 2, 9, 9, 9, 9])))


def test_mark_choices(spark):
    assert sorted(one(spark, lambda v: S.mark_choices(v, "."), "a.b.c")[0]) == sorted(["abc", "a.bc", "ab.c", "a.b.c"])
    assert one(spark, lambda v: S.mark_choices(v, "."), "." * 9) == [["." * 9]]
    assert one(spark, lambda v: S.mark_choices(v, "."), "") == [[""]]


def test_config():
    base = {"a": 1, "b": True}
    assert merged_config(base, {"a": None, "b": False}) == {"a": 1, "b": False} and base["b"]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    head = "\t".join(f.name for f in TSV_WORDS)
    (tmp_path / "in/p.tsv").write_text(f"{head}\n5\t1\t1\t1\t1\t1\t10\t30\t9\t9\t90\talpha\n5\t1\t1\t1\t1\t2\t900\t30\t9\t9\t90\tbio\n")
    ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    assert [(r.english, r.subject) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("alpha", "bio")]
