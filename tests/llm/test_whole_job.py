"""What the operators once left out, against brute force."""

import collections
import hashlib
import random
import re

import corpus_pipeline
from pyspark.sql import functions as F
from termloom.llm import html_text, near_dedup, suffix_dedup
from termloom.llm.queries import QUERIES
from tests.llm.test_operators import components, repeats, rows


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_near_dedup_stage_links_from_80(spark):
    rng = random.Random(8)
    word = lambda: "w" + str(rng.randrange(10**9))
    texts = []
    for k in range(120):
        w = [word() for _ in range(300)]
        texts += [" ".join(w), " ".join([*w[: 300 - (20 + k // 3)], *(word() for _ in range(20 + k // 3))])]
    pairs = [(shingles(a), shingles(b)) for a, b in zip(texts[::2], texts[1::2])]
    similar = [100 * len(a & b) / len(a | b) for a, b in pairs]
    assert sum(80 <= s < 85 for s in similar) > 20 and min(similar) < 80 < 85 < max(similar)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "").collect()}
    assert kept == {2 * i for i in range(120)} | {2 * i + 1 for i, s in enumerate(similar) if s < 80}
    at_85 = rows(near_dedup.near_duplicates(docs))
    assert {d for d, r in at_85.items() if r[2] != d} == {2 * i + 1 for i, s in enumerate(similar) if s >= 85}


def test_rows_of_one_id_with_other_texts_are_documents_of_their_own(spark, tmp_path):
    rng = random.Random(9)
    text = lambda n: " ".join("v" + str(rng.randrange(10**9)) for _ in range(n))
    shared, near = text(30), text(100)
    doubled = f"{text(20)} {shared} {shared} {text(20)}"
    own = [(None, doubled), (None, text(150)), (None, f"{near} {text(1)}"), (None, f"{near} {text(1)}"), (7, text(150)), (7, doubled), (8, text(90))]
    spark.createDataFrame([*own, (None, own[1][1])], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    order = docs.select("doc_id", "text", F.xxhash64(F.col("text").cast("binary")).alias("h")).distinct().collect()
    order = [(i, (r.doc_id, r.text)) for i, r in enumerate(sorted(order, key=lambda r: (-1 if r.doc_id is None else r.doc_id, r.h)))]
    cut = {}
    for (_, row), (_, b, gone) in zip(order, repeats([(i, t) for i, (_, t) in order])):
        cut[row] = bytes(x for i, x in enumerate(b) if i not in gone)
    assert sum(len(c) < len(t) for (_, t), c in cut.items()) == 3
    want = sorted((cut[r] for r in [*own, own[1]]), key=str)
    got = QUERIES["op1_suffix_dedup"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id is None, r.kept_sha256) for r in got) == sorted((d is None, hashlib.sha256(cut[d, t]).hexdigest()) for d, t in [*own, own[1]])
    assert sorted((r.text.encode() for r in suffix_dedup.remove_repeats(docs).collect()), key=str) == want
    found = components([(i, t) for i, (_, t) in order])
    ids, number = dict((i, d) for i, (d, _) in order), {row: i for i, row in order}
    verdict = [(d, ids[found[number[d, t]][2]], found[number[d, t]][3]) for d, t in [*own, own[1]]]
    assert sum(not v[2] for v in verdict) == 2
    got = QUERIES["op4_near_dedup"](spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=str) == sorted(verdict, key=str)
    left = near_dedup.drop_near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.text) for r in left), key=str) == sorted(((d, t) for (d, t), v in zip([*own, own[1]], verdict) if v[2]), key=str)


def extracted_texts(spark, pages):
    df = spark.createDataFrame([(i, f"http://{host}/p{i}", html) for i, (host, html) in enumerate(pages)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in html_text.extracted(df).collect()}


def test_copies_of_an_article_are_no_boilerplate(spark):
    page = lambda *texts: "<body><div class=content>" + "".join(f"<p>{t}</p>" for t in texts) + "</div></body>"
    article = lambda k: (f"the first part of article {k}", f"a second one of {k}", f"end {k}")
    mirrors = [("m.org", page(*article(k))) for k in (0, 0, 1, 2)]
    repeated = [("r.org", page(*article(5)))] * 6
    hot = [("h.org", page(*article(k), "menu")) for k in [0] * 8 + list(range(1, 8))]
    many = [f"line {k}" for k in range(300)]
    long = [("l.org", page(*article(k), *many)) for k in range(6)]
    want = [*(" ".join(article(k)) for k in (0, 0, 1, 2)), *[" ".join(article(5))] * 6, *(" ".join(article(k)) for k in [0] * 8 + list(range(1, 8))), *(" ".join(article(k)) for k in range(6))]
    got = extracted_texts(spark, [*mirrors, *repeated, *hot, *long])
    assert [got[i] for i in range(len(want))] == want
    assert html_text.Page(page("all of it recurs")).text([], {html_text.text_hash("all of it recurs")}) == "all of it recurs"


def test_sibling_holders_all_give_their_text(spark):
    sides = [("<article id='post-1'><p>one</p></article>", "<article id='post-2'><p>and two</p></article>"), ("<article class='lead'>one</article>", "<article class='body'>and two</article>"), ("<div id='text-1'>one</div>", "<div id='text-2'>and two</div>")]
    pages = [(f"s{i}.org", f"<body><p>no</p>{a}<p>no</p>{b}</body>") for i, (a, b) in enumerate(sides)]
    pages += [("t.org", f"<body><p>no</p><article class='lead'>one {i}</article><article class='body'>and two</article></body>") for i in range(5)]
    got = extracted_texts(spark, [*pages, ("u.org", "first <h1>one</h1><p>and two</p>")])
    assert got == {i: "one and two" for i in range(3)} | {3 + i: f"one {i} and two" for i in range(5)} | {8: "first one and two"}


def test_telling_names_around_the_article():
    text = lambda page: html_text.Page(page).text([], set())
    for name in ("has-sidebar", "no-sidebar", "with-comments", "sidebar-left", "sidebar"):
        assert text(f"<body><div>skip</div><div id='page' class='{name}'><nav>m</nav><p>one</p><p>and two of it</p><div class='sidebar'>s</div></div></body>") == "one and two of it"
    assert text("<body><p>top</p><div class='content social-science'><p>one</p><p>and two</p></div></body>") == "one and two"
    assert text("<body><p>a long text that stands before it</p><div class='widget'><article>one</article></div></body>") == "one"
    assert text("<body><div class=content>all that is said</div><div class='widget'><main>one</main></div></body>") == "one"
    assert text("<body><div class='alert'><p>only this</p></div></body>") == "only this"
    assert text("<body><div class=content>one</div><div class=related><article>a card with much more text</article></div></body>") == "one"
    assert text("<body><div class=content>one</div><div class=menu><p>a menu with much more text</p></div></body>") == "one"
    assert text("<body><div class=content>one<div class=comments><div class=text>a comment with much more text</div></div></div></body>") == "one"
    assert text("<body><div class=content>one<span class=share>share it</span> two</div></body>") == "one two"


def story(rng, k):
    return " ".join(f"{rng.choice(['window', 'harbour', 'letter', 'winter', 'garden'])}{k}" for _ in range(40))


def test_template_finds_the_slot_without_names(spark):
    """No element says what it is; what the pages of a host share and where their prose stands decide."""
    rng = random.Random(13)
    bar = lambda k: "<div class=c1>" + "".join(f"<a href=/{i}>word {rng.randrange(10**6)}</a> " for i in range(30)) + "</div>"
    side = lambda: f"<div class=c2><p>{rng.choice('abcdef')} short offer {rng.randrange(10**6)}</p></div>"
    pages, want = [], []
    for k in range(12):  # one layout; on some pages the offer is longer than the story
        long = side() if k % 4 else "<div class=c2><p>" + story(rng, 'x') + " " + story(rng, 'y') + "</p></div>"
        pages.append(("one.org", f"<body>{bar(k)}{long}<div class=c3><h2>title {k}</h2><div class=c4><p>{story(rng, k)}</p><p>{story(rng, k)}</p></div></div><div class=c5>all rights {rng.randrange(10**6)}</div></body>"))
        want.append(pages[-1][1].split("<div class=c3>")[1].split("<div class=c5>")[0])
    for k in range(15):  # three layouts of one host
        body = f"<p>{story(rng, k)}</p><p>{story(rng, k)}</p>"
        kind = k % 3
        pages.append(("many.org", [f"<body>{bar(k)}<div class=a1>{body}</div>{side()}</body>", f"<body><section class=s1>{side()}</section><section class=s2>{body}</section></body>", f"<body><table><tr><td class=t1>{bar(k)}</td><td class=t2>{body}</td></tr></table></body>"][kind]))
        want.append(body)
    got = extracted_texts(spark, pages)
    plain = lambda source: " ".join(re.sub(r"<[^>]*>", " ", source).split())
    assert [got[i] for i in range(len(want))] == [plain(w) for w in want]
    alone = [html_text.Page(source).text([], set()) for _, source in pages]
    assert sum(a != plain(w) for a, w in zip(alone, want)) > 20


def test_links_in_a_slot(spark):
    """A title or a paragraph that is a link stays, a list of links goes."""
    rng = random.Random(16)
    links = lambda n: "".join(f"<p><a href=/>word {rng.randrange(10**6)} and more</a></p>" for _ in range(n))
    made = [(links(5), f"<h2><a href=/>title {k}</a></h2><p>{story(rng, k)}</p><p><a href=/>see {k}</a></p><p>{story(rng, k)}</p>") for k in range(6)]
    got = extracted_texts(spark, [("l.org", f"<body><div class=c1><p>x {k}</p></div><div class=c2>{body}{more}</div></body>") for k, (more, body) in enumerate(made)])
    assert [got[k] for k in range(6)] == [" ".join(re.sub(r"<[^>]*>", " ", body).split()) for _, body in made]


def test_classes_against_brute_force(spark):
    """The template's containers are those whose occurrences on all pages equal another element's, up to the root."""
    rng = random.Random(14)
    pages = []
    for k in range(9):
        parts = [f"<div class=d{i}>" + f"<p>{story(rng, k)}</p>" * rng.choice([1, 1, 2]) + "</div>" for i in range(4) if rng.random() < 0.7]
        pages.append("<body><div class=top><span>x</span></div>" + "".join(parts) + "</body>")
    vectors, mass, total = collections.defaultdict(list), collections.Counter(), collections.Counter()
    for source in pages:
        page = html_text.Page(source, bare=True)
        prose = sum(len(t) - n for (t, _), n in zip(page.texts, page.linked))
        for i, key in enumerate(page.keys):
            if page.tags[i] in html_text.CONTAINERS:
                mass[key] += sum(len(t) for t, around in page.texts if i in around)
        for key in page.counts:
            total[key] += prose
    every = set().union(*(html_text.Page(p, bare=True).counts for p in pages))
    for source in pages:
        counts = html_text.Page(source, bare=True).counts
        for key in every:
            vectors[key].append(counts.get(key, 0))
    size = collections.Counter(tuple(v) for v in vectors.values())
    df = spark.createDataFrame([("h", p) for p in [*pages, pages[0]]], "host string, html string")
    batches = df.toArrow().to_batches()
    rows = collections.defaultdict(lambda: collections.Counter())
    for batch in html_text._statistics(iter(batches)):
        for r in batch.to_pylist():
            if r["kind"] == html_text.ELEMENT:
                rows[r["token"]].update({c: r[c] for c in html_text.SUMS})
    assert set(rows) == every
    found = collections.Counter((r["pages"], r["vector1"], r["vector2"]) for r in rows.values())
    for key, r in rows.items():
        assert found[r["pages"], r["vector1"], r["vector2"]] == size[tuple(vectors[key])]
        first = vectors[key][0] > 0
        assert r["pages"] == sum(n > 0 for n in vectors[key]) + first
    first = html_text.Page(pages[0], bare=True)
    for key, n in mass.items():
        again = sum(len(t) for i, k in enumerate(first.keys) if k == key for t, around in first.texts if i in around)
        assert rows[key]["mass"] == n + again


def test_repeated_and_long_pages(spark):
    rng = random.Random(15)
    page = lambda k: f"<body><div class=c1><a href=/>go</a> offer {k}</div><div class=c3><p>{story(rng, k)}</p></div></body>"
    once = [("r.org", page(k)) for k in range(6)]
    twice = [(f"twice.{h}", p) for h, p in once] * 2
    paragraphs = [f"{i} {story(rng, i)}" for i in range(8000)]
    long = [("long.org", "<body><article>" + "".join(f"<p>{p}" for p in paragraphs) + "</article></body>"), ("deep.org", "<div>" * 5000 + "deep inside"), ("stray.org", "</b>" * 20000 + "<main>" + "<b>" * 3000 + "plain</main>")]
    got = extracted_texts(spark, [*once, *twice, *long])
    text = lambda p: p.split("<p>")[1].split("</p>")[0]
    assert [got[i] for i in range(18)] == [text(p) for _, p in [*once, *twice]]
    assert [got[18], got[19], got[20]] == [" ".join(paragraphs), "deep inside", "plain"]
