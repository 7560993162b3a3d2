"""Repeated rows, two null ids with other texts, one id with two texts, and held-out accuracy where labels exist."""

import collections
import os
import re
import zlib

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from termloom.llm import html_text, toxicity
from termloom.llm.queries import QUERIES
from tests.llm.test_operators import PAGES, TEXTS, none, sf  # noqa: F401
from tests.llm.test_pipeline import corpus  # noqa: F401

SF = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
ODD = [(None, "one null id of two and some more words"), (None, "the other null id has quite another text"), (7, "an id with one text of a few words"), (7, "the same id with another text than before"), (8, ""), (9, None)]


@pytest.fixture(scope="module")
def twice(spark, sf, tmp_path_factory):  # noqa: F811
    folder = tmp_path_factory.mktemp("twice")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame(ODD, "doc_id long, text string")
    docs.unionByName(docs).unionByName(odd, allowMissingColumns=True).unionByName(odd, allowMissingColumns=True).repartition(5).write.parquet(f"{folder}/documents.parquet")
    for name in ("pages", "labels"):
        df = spark.read.parquet(f"{sf}/{name}.parquet")
        df.unionByName(df).repartition(4).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def counted(df, *left_out):
    return collections.Counter(tuple(r) for r in df.drop(*left_out).collect())


ALL = collections.Counter(d for d, _ in [*TEXTS, *ODD] for _ in range(2))


@pytest.mark.parametrize("name", ["op1_suffix_dedup", "op4_near_dedup", "op5_quality", "op6_bpe", "op7_packing", "op8_sharding", "op9_toxicity"])
def test_every_row_gets_its_result(spark, twice, name):
    rows = QUERIES[name](spark, twice)
    if name == "op7_packing":
        rows = rows.where("piece = 0")
    assert collections.Counter(r.doc_id for r in rows.select("doc_id").collect()) == ALL


@pytest.mark.parametrize("name", ["op1_suffix_dedup", "op4_near_dedup", "op5_quality", "op6_bpe", "op9_toxicity"])
def test_equal_rows_have_equal_results(spark, twice, name):
    assert all(n % 2 == 0 for n in counted(QUERIES[name](spark, twice)).values())


def test_pages_and_urls_of_repeated_rows(spark, sf, twice):  # noqa: F811
    once, both = (counted(QUERIES["op2_url_filters"](spark, d)) for d in (sf, twice))
    assert both == collections.Counter({k: 2 * n for k, n in once.items()})
    pages = counted(QUERIES["op10_html_extraction"](spark, twice))
    assert all(n % 2 == 0 for n in pages.values()) and sum(pages.values()) == 2 * len(PAGES)


def test_places_of_repeated_rows(spark, twice):
    packed, full = QUERIES["op7_packing"](spark, twice).collect(), collections.defaultdict(list)
    for r in packed:
        full[r.sequence_id].append((r.offset, r.length))
    for s in full.values():
        s.sort()
        assert s[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(s, s[1:])) and sum(s[-1]) <= 1024
    slots, shards = collections.defaultdict(list), collections.defaultdict(set)
    for r in QUERIES["op8_sharding"](spark, twice).collect():
        slots[r.shard].append(r.slot)
        shards[r.doc_id].add((r.shard, r.grown_shard))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in shards.values())


def test_pipeline_of_repeated_rows(spark, corpus, tmp_path):  # noqa: F811
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    odd = spark.createDataFrame([(d, f"{t} and it goes on with the words of a longer text that is of a kind with the others here") for d, t in ODD if t], "doc_id long, text string")
    docs.unionByName(docs).unionByName(odd, allowMissingColumns=True).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{corpus}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    stages, docs = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name in ("near_dedup", "suffix_dedup"):
        before = docs
        docs = stages[name](spark, docs, str(tmp_path))
        assert docs.columns == before.columns
        own = collections.Counter((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
        assert all(n % 2 == 0 for (d, _), n in own.items() if d not in (None, 7))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


@tables
def test_toxicity_of_held_out_labels(spark):
    """At least nine of ten labels that the fit has not seen are told."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").where("held_out").select("doc_id", "predicted", "score", "toxic").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    assert sum(r.predicted == r.toxic for r in rows) >= 0.9 * len(rows) and sum(r.toxic for r in rows) > 3


@tables
def test_quality_against_labels(spark):
    docs, labels = QUERIES["op5_quality"](spark, SF), spark.read.parquet(f"{SF}/labels.parquet")
    rows = docs.join(labels, "doc_id").where(~F.col("base_failed")).select("kept", "quality").collect()
    assert sum(r.kept == (r.quality == 1) for r in rows) >= 0.97 * len(rows)
    assert docs.where("kept and p_good < 0.5").count() == 0


@tables
def test_articles_without_their_marks(spark):
    """The template alone finds the articles of all pages, held against their source."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    bare = pages.withColumn("html", F.regexp_replace(F.regexp_replace(F.regexp_replace("html", "<article", "<div class=x1"), "</article", "</div"), 'class="ad"', "class=x2"))
    marked, unmarked = ({r.page_id: r.text for r in html_text.extracted(p).collect()} for p in (pages, bare))
    source = {r.page_id: r.html for r in pages.collect()}
    for k, page in source.items():
        inside = " ".join(m[1] for m in re.finditer(r"(?s)<article[^>]*>(.*?)</article>", page))
        plain = re.sub(r"(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>|<form.*?</form>|<aside.*?</aside>|<nav.*?</nav>", " ", inside)
        words = html_text.html.unescape(re.sub(r"</?(?:b|i|em|strong|a|span)\b[^>]*>", "", plain))
        words = re.sub(r"<[^>]*>", " ", words) if "<" in words else words
        assert sorted(marked[k].split()) == sorted(words.split())
    hosts = {r.host for r in html_text.templates(bare.select(html_text.host_and_path(F.col("url"))[0].alias("host"), "html")).where("size(slots) > 0").collect()}
    own = {r.page_id for r in bare.withColumn("host", html_text.host_and_path(F.col("url"))[0]).where(F.col("host").isin(hosts)).collect()}
    assert len(own) > 50 and all(unmarked[k] == marked[k] for k in own)


def test_any_rules_against_brute_force(spark):
    """Nested hosts and paths, upper case, equal rules with both verdicts, urls that repeat."""
    import random

    from termloom.llm import url_filter

    rng = random.Random(23)
    label = lambda: rng.choice(["a", "b", "cc", "Dd", "e-e"])
    host = lambda most: ".".join(label() for _ in range(rng.randint(1, most)))
    path = lambda most: "/" + "".join(rng.choice("xyz") + rng.choice(["", "/"]) for _ in range(rng.randint(0, most)))
    rules = [(rng.choice(["allow", "block"]), host(3), path(3)) for _ in range(150)] + [("allow", "a.b", "/x"), ("block", "a.b", "/x")]
    urls = [f"http://{host(5)}{path(6)}{rng.choice(['', '?q=/x', '#y'])}" for _ in range(600)] + ["a.b/x", None, "x://", "s://a.b/x"] * 2
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, spark.createDataFrame(rules, "verdict string, host string, path string")).collect()}
    for i, url in enumerate(urls):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        name = re.match(r"[^/?#]*", rest)[0].lower()
        own = re.match(r"[^/?#]*([^?#]*)", rest)[1]
        fits = [(len(h) + len(p), v == "block", h + p, v) for v, h, p in rules if (name == h.lower() or name.endswith("." + h.lower())) and own.startswith(p)]
        best = max(fits, default=None)
        assert got[i][:2] == (name, own)
        assert got[i][3] == (best[3] if best else "allow") and (got[i][2] or "").lower() == (best[2].lower() if best else ""), (url, got[i], best)
    assert sum(g[2] is not None for g in got.values()) > 200
