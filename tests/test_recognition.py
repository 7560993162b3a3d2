"""Kernels and decoders against brute force, and sources, stores and streams that need files."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from termloom.functions import spelling
from termloom.operators import recognition as R
from termloom.operators import sequence as S
from termloom.operators import store, vision as V
from termloom.schemas import TERMS, TSV_WORDS
from termloom.sources import words as sources
from termloom.streaming import ingest


def test_directions_against_a_loop():
    rng = np.random.default_rng(5)
    for size in (32, 8):
        image = rng.integers(0, 2, (size, size)).astype(float)
        at = lambda y, x: image[-y if y < 0 else 2 * size - 2 - y if y >= size else y, -x if x < 0 else 2 * size - 2 - x if x >= size else x]  # noqa: B023, E731
        grad = {}
        for y, x in itertools.product(range(size), repeat=2):
            gx = sum(w * (at(y + d, x + 1) - at(y + d, x - 1)) for d, w in ((-1, 1), (0, 2), (1, 1)))
            gy = sum(w * (at(y + 1, x + d) - at(y - 1, x + d)) for d, w in ((-1, 1), (0, 2), (1, 1)))
            grad[y, x] = math.hypot(gx, gy), math.degrees(math.atan2(gy, gx))
        mean, want = sum(g for g, _ in grad.values()) / size**2, np.zeros(192, int)
        for (y, x), (g, angle) in grad.items():
            if g >= mean:
                cell = (y * 4 // size) * 4 + x * 4 // size
                low = math.floor(angle / 30) % 12
                want[cell * 12 + low] += 1
                if math.fmod(angle, 30) != 0:
                    want[cell * 12 + (low + 1) % 12] += 1
        assert (V.sobel_histogram(image) == want).all() and want.sum() > 0


def test_zernike_by_its_definition():
    rng = np.random.default_rng(6)
    image = rng.random((9, 9))
    got, k = V.zernike(image, 6), 0
    for n in range(7):
        for m in range(n % 2, n + 1, 2):
            total = 0j
            for y, x in itertools.product(range(9), repeat=2):
                px, py = (2 * x - 8) / math.hypot(9, 9), (2 * y - 8) / math.hypot(9, 9)
                r, turn = math.hypot(px, py), math.atan2(py, px)
                radial = sum((-1) ** s * math.factorial(n - s) / (math.factorial(s) * math.factorial((n + m) // 2 - s) * math.factorial((n - m) // 2 - s)) * r ** (n - 2 * s) for s in range((n - m) // 2 + 1))
                total += image[y, x] * radial * complex(math.cos(m * turn), -math.sin(m * turn))
            assert abs(got[k] - (n + 1) / math.pi * abs(total) * 4 / (2 * 81)) < 1e-9
            k += 1


def test_clusters_are_stable():
    """Every value is in the cluster of its nearest centre, and a centre is the mean of its values; so no exchange of one value helps."""
    rng = np.random.default_rng(7)
    for _ in range(20):
        x = rng.integers(0, 60, 40).astype(float)
        centres = V.kmeans_1d(x, 3)
        own = np.abs(x[:, None] - centres).argmin(1)
        assert all(np.isclose(x[own == i].mean(), centres[i]) for i in range(3) if (own == i).any())
    best = min((sum(((p - p.mean()) ** 2).sum() for p in (a, b)), tuple(a), tuple(b)) for a, b in ((np.array(s[:i]), np.array(s[i:])) for s in [sorted([1.0, 2, 2, 9, 10, 12])] for i in range(1, 6)))
    assert np.allclose(V.kmeans_1d(np.array([1.0, 2, 2, 9, 10, 12]), 2), [np.mean(best[1]), np.mean(best[2])])


def test_mixture_is_a_maximum():
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(5, 1, 300), rng.normal(20, 3, 200)])
    weight, mean, dev = V.mixture(x, rounds=500)
    like = lambda w, m, s: np.log((w / s * np.exp(-0.5 * ((x[:, None] - m) / s) ** 2)).sum(1)).sum()
    top = like(weight, mean, dev)
    for d in (-0.02, 0.02):
        for i in range(2):
            turn = np.eye(2)[i] * d
            assert like(weight, mean + turn, dev) <= top + 1e-6 and like(weight, mean, dev + turn) <= top + 1e-6
        assert like(weight + np.array([d, -d]), mean, dev) <= top + 1e-6


def test_lines_of_a_page():
    page = np.full((120, 80), 255)
    for y in (20, 50, 90):
        page[y : y + 12, 5:75] = 0
        page[y + 3, 5:75] = 0
    starts, base, line = V.cut_lines(page, np.array([5, 20, 21, 55, 95]), inflate=1)
    assert starts.tolist() == [18, 48, 88] and line.tolist() == [-1, 0, 0, 1, 2] and base.tolist() == [19, 49, 89]
    assert V.cut_lines(np.full((9, 9), 255), np.array([1, 2]))[2].tolist() == [0, 0]
    tall = V.too_tall(np.array([10.0, 11, 9, 10, 40]))
    assert tall.tolist() == [False] * 4 + [True]
    profile = np.full(600, 100.0)
    for y in (80, 280, 480):
        profile[y : y + 60] = 20
    assert V.count_lines(profile) == 3 and V.count_lines(np.full(50, 7.0)) == 0


def test_characters_fill_the_frame():
    tall, flat = np.zeros((40, 10), int), np.zeros((6, 24), int)
    a, b = V.normalised(tall), V.normalised(flat)
    assert a.shape == b.shape == (32, 32)
    assert (a == 0).sum(1).tolist() == [16] * 32 and (b == 0).sum(0).tolist() == [16] * 32
    assert (V.inverted(np.array([[0, 255]])) == [[1, 0]]).all() and V.padded(np.zeros((2, 2), int)).shape == (8, 8)
    own = V.region_contrast(np.arange(100).reshape(10, 10), 0, 0, 4)
    assert own["min"] == 0 and own["max"] == 11 and own["contrast"] == 11
    assert V.feature_vector(a).shape == (90 + 192 + 64,)
    vector = V.feature_vector(a)
    assert np.allclose(V.feature_vector(a, vector - 1, np.full(346, 2.0)), 0.5)


def test_faint_states_are_not_entered(spark):
    start, steps = {0: 0.5, 1: 0.5}, {(a, b): 0.9 if a == b else 0.1 for a in (0, 1) for b in (0, 1)}
    seen = [(1, 0, 0, 0.9), (1, 0, 1, 0.1), (1, 1, 0, 1e-9), (1, 1, 1, 2e-7), (1, 2, 0, 0.9), (1, 2, 1, 0.1)]
    got = S.viterbi(spark.createDataFrame(seen, "seq long, t int, state int, p double"), start, steps).orderBy("t").collect()
    assert [r.state for r in got] == [0, 1, 0]


def decoded(seen, start, steps, triples, mark):
    """All paths of two or three letters with and without marks between them, by the rule of the best way to each letter."""
    paths = {s: (p * seen[0].get(s, 0), [s]) for s, p in start.items()}
    for row in seen[1:]:
        marked = []
        for s, (p, path) in paths.items():
            run = 0
            while run < len(path) and path[-1 - run] != mark:
                run += 1
            third = 0.75 if len(path) == 1 else triples.get((path[-2], path[-1]), 0.5) * (1 + 2 * run)
            marked.append((p * steps.get((s, mark), 0) * third, s, [*path, mark]))
        marked = max(marked)
        after = {}
        for y, e in row.items():
            plain = max((p * steps.get((s, y), 0) * e, s) for s, (p, _) in paths.items() if p)
            with_mark = marked[0] * steps.get((mark, y), 0) * e
            after[y] = (with_mark, [*marked[2], y]) if with_mark > plain[0] else (plain[0], [*paths[plain[1]][1], y])
        paths = after
    return max((p, s, path) for s, (p, path) in paths.items())[2]


def test_hidden_marks(spark):
    rng = random.Random(3)
    start = {0: 0.5, 1: 0.3, 2: 0.2}
    steps = {(a, b): rng.uniform(0.05, 0.3 if b == 3 else 1) for a in range(4) for b in range(4)}
    triples = {(0, 1): 0.9, (1, 2): 0.05}
    every = [[{s: rng.uniform(0.05, 1) for s in range(3)} for _ in range(4)] for _ in range(25)]
    rows = [(i, t, s, p) for i, seen in enumerate(every) for t, row in enumerate(seen) for s, p in row.items()]
    got = R.hidden_marks(spark.createDataFrame(rows, "seq long, t int, state int, p double"), start, steps, triples, 3).collect()
    want = {i: decoded(seen, start, steps, triples, 3) for i, seen in enumerate(every)}
    assert {r.seq: r.states for r in got} == want and any(3 in w for w in want.values()) and any(3 not in w for w in want.values())


def test_classifier(spark):
    rng = np.random.default_rng(9)
    rows = [(int(k), [float(v) for v in rng.normal([k * 3, -k, 1], 0.5)]) for k in rng.integers(0, 3, 150)]
    df = spark.createDataFrame(rows, "label int, vec array<double>")
    model = R.train_classifier(df)
    got = R.classified(df, model).collect()
    assert sum(r.idx == r.label for r in got) > 145 and all(abs(sum(t.prob for t in r.top) - 1) < 1e-6 and r.top[0].idx == r.idx and r.prob == r.top[0].prob for r in got)
    with pytest.raises(ValueError):
        R.checked_model(df, 2000, "labels")
    assert R.checked_model(df, 150, "labels").count() == 150


def test_spelling(spark):
    syllables = ["པའི", "སྒྲུབ", "བཏགས", "ཀིི", "ཊཀ", "ངའི", "བགས", "དགས", "ཀཀ", ""]
    df = spark.createDataFrame([(i, s) for i, s in enumerate([*syllables, None])], "i int, s string")
    got = df.orderBy("i").select(spelling.breaks_rules(F.col("s")).alias("b"), spelling.root(F.col("s")).alias("r")).collect()
    assert [g.b for g in got] == [False, False, False, True, True, False, False, False, True, True, None]
    assert [g.r for g in got[:9]] == ["པ", "ྒ", "ཏ", "ཀ", "ཊ", "ང", "བ", "ག", "ཀ"]


def test_all_mark_choices(spark):
    got = spark.range(1).select(S.mark_choices(F.lit("a." * 9), ".", None).alias("v")).first().v
    assert len(got) == len(set(got)) == 512 and "a" * 9 in got and "a." * 9 in got


def test_term_store_is_made_once(spark, tmp_path):
    path = str(tmp_path / "terms")
    assert store.open_terms(spark, path).count() == 0 and store.open_terms(spark, path).schema.names == TERMS.names
    new = spark.createDataFrame([("a", "en", "b", "bo")], "source_term string, source_language string, target_term string, target_language string")
    full, _ = store.insert(store.open_terms(spark, path), store.with_defaults(new, "2024-05-06 07:08:09"), ["source_term"])
    row = full.first()
    assert (row.id, row.verified_status, str(row.date_added)) == (1, "draft", "2024-05-06 07:08:09")


def test_settings_are_kept_once(spark, tmp_path):
    path = str(tmp_path / "conf")
    one = spark.createDataFrame([("book", 2.5, True)], "page_type string, break_width double, low_ink boolean")
    other = spark.createDataFrame([("pecha", 2.5, True)], "page_type string, break_width double, low_ink boolean")
    assert [sources.save_config(c, path) for c in (one, one, other, one)] == [True, False, True, False]
    assert spark.read.json(path).count() == 2


def test_training_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,0,1,0\n2,1,1,1\n1,0,1,0\n\n3,1\n")
    (tmp_path / "b.csv").write_text("2,1,1,1\n7,0,0,0\n")
    got = sources.training_rows(spark, [str(tmp_path / f) for f in ("a.csv", "b.csv")], 3).collect()
    assert sorted((r.label, *r.px) for r in got) == [(1, 0, 1, 0), (2, 1, 1, 1), (7, 0, 0, 0)]


def test_volume(spark, tmp_path):
    pages = spark.createDataFrame([("p2", "two"), ("p1", "one\nmore")], "name string, text string")
    sources.write_volume(pages, str(tmp_path / "v"), "Title")
    assert [r.value for r in spark.read.text(str(tmp_path / "v")).collect()] == ["Title", "", "p1", "one", "more", "", "p2", "two"]


def test_a_page_in_two_files(spark, tmp_path):
    head = "\t".join(f.name for f in TSV_WORDS)
    line = lambda top, left, text: f"5\t1\t1\t1\t1\t1\t{left}\t{top}\t9\t9\t90\t{text}\n"
    (tmp_path / "in").mkdir()
    (tmp_path / "in/d.part1.tsv").write_text(head + "\n" + line(30, 10, "alpha") + line(30, 900, "bio"))
    ingest.ingest_parts(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    assert [(r.english, r.term) for r in ingest.ingested(spark, str(tmp_path / "out")).collect()] == [("alpha", "")]
    (tmp_path / "in/d.part2.tsv").write_text(head + "\n" + line(60, 10, "more") + line(60, 1200, "ཀ"))
    ingest.ingest_parts(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    assert [(r.english, r.term) for r in ingest.ingested(spark, str(tmp_path / "out")).collect()] == [("alpha more", "ཀ")]


def test_event_windows(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:10:00", "a", 4.0), ("2024-01-01 00:20:00", "b", 8.0), ("2024-01-01 09:00:00", "b", 1.0)]
    spark.createDataFrame(rows, "ts string, event_type string, value double").selectExpr("timestamp(ts) ts", "event_type", "value").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
    q = ingest.event_windows(stream).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = spark.sql("SELECT hour(window.start) h, event_type, n, total FROM windows").collect()
    assert sorted(map(tuple, got)) == [(0, "a", 2, 3.0), (0, "b", 1, 8.0), (1, "a", 1, 4.0), (9, "b", 1, 1.0)]


def test_levels_and_sizes():
    rng = np.random.default_rng(11)
    gray = np.concatenate([rng.integers(20, 60, 500), rng.integers(150, 220, 900)]).reshape(35, 40)
    level = V.otsu(gray)

    def spread(k):
        low, high = gray[gray <= k], gray[gray > k]
        return low.size * low.var() + high.size * high.var() if low.size and high.size else np.inf

    assert abs(spread(level) - min(spread(k) for k in range(256))) < 1e-6
    page = np.full((150, 300), 255)
    for i in range(5):
        page[20 : 20 + 8, 20 + 30 * i : 20 + 30 * i + 6] = 0
    page[100, 100] = 0
    assert V.character_size(page) == 8 and V.character_size(np.full((5, 5), 255)) == 16
    assert V.enlarged(page).shape == (225, 450) and V.enlarged(np.full((200, 300), 255)).shape == (200, 300)
    ink = V.without_specks(page == 0)
    assert not ink[100, 100] and ink.sum() == 5 * 48


def test_images(spark, tmp_path):
    (tmp_path / "a.pgm").write_bytes(b"P5\n# made up\n3 2\n255\n" + bytes([0, 1, 2, 253, 254, 255]))
    (tmp_path / "b.pgm").write_bytes(b"no image")
    got = {r.path.rsplit("/", 1)[1]: (r.h, r.w, bytes(r.px) if r.px else None) for r in sources.read_images(spark, str(tmp_path)).collect()}
    assert got == {"a.pgm": (2, 3, bytes([0, 1, 2, 253, 254, 255])), "b.pgm": (None, None, None)}


def test_sizes_of_stacks(spark):
    rng = random.Random(4)
    rows = [("ཀ", rng.randint(9, 12)) for _ in range(200)] + [("ཀ", rng.randint(30, 34)) for _ in range(100)] + [("ཁ", 7)] * 5
    got = {(r.ch, r.w): r.size for r in R.sized(spark.createDataFrame(rows, "ch string, w int"), "ch", "w").collect()}
    assert all(size == ("b" if w > 20 else "s") for (_, w), size in got.items()) and len(got) > 6


def test_commands(spark, tmp_path, capsys):
    from termloom.__main__ import main

    (tmp_path / "in").mkdir()
    head = "\t".join(f.name for f in TSV_WORDS)
    line = lambda left, text: f"5\t1\t1\t1\t1\t1\t{left}\t30\t9\t9\t90\t{text}\n"
    (tmp_path / "in/p.tsv").write_text(head + "\n" + line(10, "alpha") + line(900, "bio") + line(1200, "ཀ"))
    path = str(tmp_path / "store")
    assert main(["ingest", path, str(tmp_path / "in")]) == "1 new terms" and main(["ingest", path, str(tmp_path / "in")]) == "0 new terms"
    assert main(["search", path, "ALP"]) == main(["recent", path]) == "alpha → ཀ།"
    text = main(["export", path, "--days", "3", "--share"])
    assert "• **alpha**" in text and "📊 Total: 1 novos termos" in text and "🔗" in text
    assert main(["search", path, "zzz"]) == ""
