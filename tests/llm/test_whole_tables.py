"""Registered queries against their SQL, and cases that the test tables do not hold."""

import re
from collections import Counter

import duckdb
import pytest
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from paperwire.llm import bpe, exact, langid, simhash, token_orc
from paperwire.llm.common import Remembered, drop_rows, free_name, identified, parted, sieve
from paperwire.llm.oracle import ORACLE_SQL
from paperwire.llm.queries import QUERIES
from tests.llm.conftest import KIND, odd_documents

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, tables, name):
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    result = tables.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in result.fetchall()]
    got = [tuple(r) for r in df.select(columns).collect()]

    def plain(rows):
        return Counter(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows)

    assert plain(got) == plain(want)


# Token files


def test_special_strings_leave_other_texts_alone(spark, tmp_path):
    texts = ["<|endoftext|>", "a b<|endoftext|>", "hello world", "some other text here", "<|startoftext|>x y", "ab<|endoftext|>cd",
             "日本<|endoftext|> 語", "don't <|endoftext", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    token_orc.write_tokens(df, path := str(tmp_path / "tokens"))
    found = {r["doc_id"]: r["ids"] for r in token_orc.read_tokens(spark, path).collect()}
    tool = tokenizers.Tokenizer.from_file(token_orc.VOCABULARY)
    for k, text in enumerate(texts):
        assert found[k] == tool.encode(text or "", add_special_tokens=False).ids + [token_orc.END], text


# Languages


def test_scripts_without_spaces_are_learned(spark, tmp_path):
    """Sentences far longer than a word, in two languages that share characters."""
    ja = ["これは長い文章であり、日本語で書かれていますので、ひらがなが多く含まれているはずです。" * 3, "昨日は雨が降っていたので、家で本を読んでいました。とても楽しかったです。" * 3]
    zh = ["这是一个很长的句子，因为它是用中文写的，所以里面没有假名，只有汉字而已。" * 3, "昨天下雨了，所以我在家里看书，觉得非常开心，明天还要继续看下去。" * 3]
    rows = [(k, (ja if k % 2 else zh)[k // 2 % 2][k % 17 :], "ja" if k % 2 else "zh") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    df.write.parquet(path := str(tmp_path / "docs"))
    df = spark.read.parquet(path)
    languages, model = langid.fit(df.where(~langid.held_out(F.col("doc_id"))))
    found = langid.predict(df, languages, model).where(langid.held_out(F.col("doc_id"))).collect()
    assert languages == ["ja", "zh"] and len(found) > 80
    assert all(r["lang_pred"] == r["lang"] and r["score"] > 0.9 for r in found)


def test_parts_of_a_long_word_are_whole_characters():
    word = ("日本語" * 100 + "a" * 50).encode()
    parts = langid.parts(word)
    assert b"".join(parts) == langid.START + word and all(len(p) <= langid.LONGEST and p.decode() for p in parts)
    assert langid.parts(b"short") == [langid.START + b"short"]


def test_language_sample_is_bounded_also_for_copies(spark, tmp_path):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("the one text").alias("text"), F.lit("en").alias("lang"))
    df.write.parquet(path := str(tmp_path / "docs"))
    place = identified(spark.read.parquet(path))
    part = F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "__row.i"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    assert 800 < place.where(part < 1000 / 20_000).count() < 1200


def test_language_equals_a_plain_forward_sum(spark, tmp_path):
    """Model and prediction against sums over all segmentations, one by one."""
    texts = [("the cat sat", "en"), ("der hund lief", "de"), ("the dog ran", "en"), ("die katze sass", "de"), ("a hat", "en")]
    df = spark.createDataFrame([(k, t, lang) for k, (t, lang) in enumerate(texts)], "doc_id bigint, text string, lang string")
    df.write.parquet(path := str(tmp_path / "docs"))
    languages, model = langid.fit(spark.read.parquet(path), rounds=2)
    names = {n: i for i, n in enumerate(langid.pieces(langid.VOCABULARY).names)}

    def forward(word, column):
        sums = [1.0] + [0.0] * len(word)
        for end in range(1, len(word) + 1):
            sums[end] = sum(sums[at] * column[names[word[at:end]]] for at in range(end) if word[at:end] in names)
        return sums

    def backward(word, column):
        sums = [0.0] * len(word) + [1.0]
        for at in range(len(word) - 1, -1, -1):
            sums[at] = sum(sums[end] * column[names[word[at:end]]] for end in range(at + 1, len(word) + 1) if word[at:end] in names)
        return sums

    plain = []
    for lang in ("de", "en"):
        column = [1 / len(names)] * len(names)
        for _ in range(2):
            used = [langid.SMOOTH] * len(names)
            for text, own in texts:
                for w in text.split() if own == lang else ():
                    w = langid.START + w.encode()
                    ahead, back = forward(w, column), backward(w, column)
                    for at in range(len(w)):
                        for end in range(at + 1, len(w) + 1):
                            if w[at:end] in names:
                                i = names[w[at:end]]
                                used[i] += ahead[at] * column[i] * back[end] / ahead[-1]
            column = [u / sum(used) for u in used]
        plain.append(column)
    assert languages == ["de", "en"]
    for k in range(2):
        assert model[:-1, k].tolist() == pytest.approx(plain[k], rel=1e-6)
    for row in langid.predict(df, languages, model).collect():
        odds = [1.0, 1.0]
        for k in range(2):
            for w in row["text"].split():
                odds[k] *= forward(langid.START + w.encode(), plain[k])[-1]
        best = max(range(2), key=lambda k: odds[k])
        assert row["lang_pred"] == languages[best] and row["score"] == pytest.approx(odds[best] / sum(odds), rel=1e-6)


# Shared helpers


def test_a_sieve_lets_all_listed_rows_through(spark, monkeypatch):
    monkeypatch.setattr("paperwire.llm.common.SIEVE_BITS", 1 << 16)
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 7 != 0, (F.col("id") % 100).cast("string")).alias("name"))
    keys = rows.where("id % 50 = 3")
    test = sieve(keys, ["id", "name"])
    assert keys.where(test(keys)).count() == 400
    maybe, rest = parted(rows, keys, ["id", "name"])
    assert maybe.count() + rest.count() == 20_000 and 400 <= maybe.count() < 700
    none, every = parted(rows, keys.limit(0), ["id", "name"])
    assert none.count() == 0 and every.count() == 20_000


def test_what_a_worker_remembers_is_bounded_in_bytes():
    known, asked = Remembered(50_000, longest=20), Counter()

    def make(words):
        asked.update(words)
        return [w.upper().encode() * 3 for w in words]

    for k in range(200):
        words = [f"w{k}-{i}" for i in range(20)] + ["always", "x" * 500]
        found = known.get([words], make)
        assert all(found[w] == w.upper().encode() * 3 for w in words)
        held = sum(len(w) + len(v) + Remembered.ENTRY for d in (known.young, known.old) for w, v in d.items())
        assert held < 2.5 * 50_000
    assert asked["always"] < 5 and asked["x" * 500] == 200


# Names that the operators use themselves

CLASHING = ["__row", "__file", "__i", "ids", "ids_", "_text", "_hash", "_id", "score", "lang_pred", "fp"]


@pytest.fixture(scope="module")
def clashing(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("clash") / "documents.parquet")
    rows = [(*r, len(r[1] or ""), *["x"] * len(CLASHING)) for r in odd_documents()]
    kind = KIND.split(", _row")[0] + "".join(f", {c} string" for c in CLASHING)
    spark.createDataFrame(rows, kind).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def test_extra_columns_may_have_any_name(spark, clashing, tmp_path):
    assert free_name(clashing, "__row") == "__row_" and free_name(clashing, "IDS") == "IDS__"
    kept = exact.drop_exact_duplicates(clashing)
    assert kept.columns == clashing.columns and 0 < kept.count() < clashing.count()
    docs = clashing
    for k, (stage, f) in enumerate(corpus_pipeline.STAGES):
        out = f(spark, docs, SMALL)
        last = k == len(corpus_pipeline.STAGES) - 1
        assert out.columns == clashing.columns + ["ids__"] * last, stage
        out.write.parquet(path := str(tmp_path / stage))
        docs = spark.read.parquet(path)
        assert {tuple(r) for r in docs.select(*CLASHING).distinct().collect()} == {("x",) * len(CLASHING)}
    made = bpe.with_tokens(clashing, ids="ids")
    assert made.schema["ids"].dataType.simpleString() == "array<int>"
    assert simhash.near_duplicates(clashing).count() == clashing.count()


def test_dropped_rows_are_those_listed(spark, odd):
    held = identified(odd, "place")
    listed = held.where("doc_id % 3 = 0")
    left = drop_rows(held, listed, "place")
    assert left.columns == odd.columns
    want = Counter(tuple(r) for r in odd.where("doc_id is null or doc_id % 3 <> 0").collect())
    assert Counter(tuple(r) for r in left.collect()) == want
    assert re.search("__", "".join(left.columns)) is None
