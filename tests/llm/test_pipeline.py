import collections
import random
import zlib
from array import array

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from termloom.llm.bpe import tokenizer_path
from termloom.llm.common import written
from termloom.llm.packing import SIZE
from termloom.llm.queries import QUERIES
from tests.llm.test_operators import TEXTS, components, none, repeats, sf  # noqa: F401


def prose():
    """Clean texts, among them near copies and a passage that many share; ids from 1000."""
    rng = random.Random(2)
    words = [a + b for a in ("lan", "mor", "ti", "vel", "so", "ka", "der", "pin") for b in ("der", "ing", "al", "este", "ow", "ith", "um", "ara")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, out = text(60), [text(rng.randint(80, 200)) for _ in range(40)]
    out += [f"{t} {text(1)}" for t in out[:6]] + out[6:9] + [f"{text(60)} {passage} {text(50)}" for _ in range(8)]
    return list(enumerate(out, 1000))


ALL = TEXTS + prose()


@pytest.fixture(scope="module")
def corpus(spark, sf, tmp_path_factory):  # noqa: F811
    folder = tmp_path_factory.mktemp("corpus")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    more = spark.createDataFrame([(d, t, "en", "src", len(t)) for d, t in prose()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.unionByName(more, allowMissingColumns=True).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def pairs_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_stages(spark, corpus, tmp_path):
    """Each stage against brute force or its operator's verdicts, on what the stage before it kept."""
    from tokenizers import Tokenizer

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns = docs.columns

    def after(name):
        out = written(stages[name](spark, docs, corpus), f"test-{name}")
        assert out.columns == columns
        return out

    verdict = {r.doc_id for r in QUERIES["op9_toxicity"](spark, corpus).where("predicted = 0").collect()}
    docs = after("toxicity")
    assert sorted(pairs_of(docs), key=str) == sorted((x for x in ALL if x[0] in verdict), key=str) and len(verdict) < len(ALL)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    verdict = {r.doc_id for r in QUERIES["op5_quality"](spark, str(tmp_path)).where("kept").collect()}
    before, docs = pairs_of(docs), after("quality")
    assert sorted(pairs_of(docs), key=str) == sorted((x for x in before if x[0] in verdict), key=str) and 0 < len(verdict) < len(before)
    before, docs = pairs_of(docs), after("near_dedup")
    found = components(before)
    assert 9 <= sum(not x[3] for x in found.values())
    assert sorted(pairs_of(docs), key=str) == sorted((x for x in before if found[x[0]][3]), key=str)
    before, docs = pairs_of(docs), after("suffix_dedup")
    want = {d: bytes(x for i, x in enumerate(b) if i not in gone).decode("utf-8", "ignore") for d, b, gone in repeats(before)}
    assert dict(pairs_of(docs)) == want and sum(want[d] != t for d, t in before) >= 7
    assert docs.where(F.length("text") != F.col("n_chars")).count() == 0
    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    ids = {d: library.encode(t, add_special_tokens=False).ids + [2] for d, t in want.items()}
    placed, full = stages["packing"](spark, docs, corpus).collect(), collections.defaultdict(list)
    assert sum(r.length for r in placed) == sum(map(len, ids.values()))
    for r in placed:
        assert zlib.crc32(array("I", ids[r.doc_id][r.start : r.start + r.length]).tobytes()) == r.ids_crc32
        full[r.sequence_id].append((r.offset, r.length))
    for s in full.values():
        s.sort()
        assert s[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(s, s[1:])) and sum(s[-1]) <= SIZE
    of = lambda rows: sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str)
    assert of(corpus_pipeline.run(spark, corpus).collect()) == of(placed)


def test_empty(spark, none):  # noqa: F811
    assert corpus_pipeline.run(spark, none).count() == 0
