"""The pipeline against a plain version of its stages, and the registered queries."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from paperwire.llm import langid, mixing
from paperwire.llm.queries import QUERIES
from tests.llm import brute
from tests.llm.test_llm import TIKTOKEN

SMALL = "/root/testdata/sf0.001"


def test_run_equals_a_plain_version(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    rows = [r for r in rows if r["text"] is not None and any(c.isalpha() for c in r["text"])]
    best = defaultdict(list)
    for r in rows:
        best["".join(brute.WORD.findall(r["text"]))].append(r)
    rows = [min(some, key=lambda r: (-len(r["text"]), r["doc_id"])) for some in best.values()]
    near = {doc for doc, _, least in brute.near([(r["doc_id"], r["text"]) for r in rows]) if doc == least}
    rows = [r for r in rows if r["doc_id"] in near]
    found = [r.asDict() for r in corpus_pipeline.run(spark, SMALL).collect()]
    whole = {r["doc_id"]: r for r in rows}
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += len(brute.WORD.findall(r["text"]))
    goal, taken, cut = brute.targets(sizes), Counter(), Counter()
    for r in found:
        taken[r["source"]] += len(brute.WORD.findall(r["text"]))
        cut[r["source"]] += r["text"] != whole[r["doc_id"]]["text"]
        assert whole[r["doc_id"]]["text"].startswith(r["text"])
        assert r["ids"] == TIKTOKEN.encode_ordinary(r["text"])
        assert {k: r[k] for k in ("lang", "source", "n_chars")} == {k: whole[r["doc_id"]][k] for k in ("lang", "source", "n_chars")}
    assert all(abs(taken[s] - goal[s]) < 1 and cut[s] <= 1 for s in sizes)


def test_stages_take_odd_rows_and_none(spark, odd, none, tmp_path):
    for name, docs in (("odd", odd), ("none", none)):
        for k, (stage, f) in enumerate(corpus_pipeline.STAGES):
            out = f(spark, docs, SMALL)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == odd.columns, stage
            out.write.parquet(path := str(tmp_path / f"{name}-{stage}"))
            docs = spark.read.parquet(path)
        assert (docs.count() > 0) == (name == "odd")


def test_language_stage_keeps_clean_documents(spark, odd):
    kept = corpus_pipeline.language(spark, odd, SMALL)
    letters = odd.where(langid.has_letter(F.col("text")))
    assert kept.count() == letters.count()


@pytest.mark.parametrize("name", QUERIES)
def test_queries_answer_every_row(spark, name):
    found = QUERIES[name](spark, SMALL)
    table = "embeddings" if name == "op7_vptree" else "documents"
    n = spark.read.parquet(f"{SMALL}/{table}.parquet").count()
    if name == "op12_spelling":  # a row per word
        assert found.count() == found.select("word").distinct().count() > 0
    else:
        assert found.count() == (n // 100 * 10 if name == "op7_vptree" else n)


def test_mix_is_the_same_again(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert mixing.mix(docs).exceptAll(mixing.mix(docs.repartition(5))).count() == 0
