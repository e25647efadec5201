import hashlib
import random
import zlib
from collections import Counter, defaultdict

import base64
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from paperwire.llm import bpe, exact, langid, licenses, mixing, sharding, simhash, substring, token_orc, vptree
from paperwire.llm.common import drop_rows, identified, join_groups
from tests.llm import brute
from tests.llm.conftest import odd_documents

PAIRS = [(r[0], r[1]) for r in odd_documents()]


def rows(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


# Byte-level BPE

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCABULARY, "rb"))}
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_bpe_equals_the_library_and_decodes(spark, odd, none):
    found = bpe.with_tokens(odd).withColumn("back", bpe.decode(F.col("ids"))).select("text", "ids", "back").collect()
    assert len(found) == len(PAIRS)
    for text, ids, back in found:
        assert ids == TIKTOKEN.encode_ordinary(text or "")
        assert bytes(back) == (text or "").encode()
    assert bpe.with_tokens(none).count() == 0


def test_bpe_appends_and_edits_are_exact():
    rng = random.Random(1)
    alphabet = list("ab c  \n'trevld1é😀.,") + ["'re", " the", "ing", "'ll "]
    for _ in range(150):
        text, doc = "", bpe.Encoded()
        for _ in range(12):
            new = "".join(rng.choices(alphabet, k=rng.randrange(6)))
            start = rng.randrange(len(text) + 1)
            end = rng.randrange(start, min(len(text), start + 5) + 1)
            if rng.random() < 0.5:
                doc.append(new)
                text += new
            else:
                doc.edit(start, end, new)
                text = text[:start] + new + text[end:]
            assert doc.text == text and doc.ids() == TIKTOKEN.encode_ordinary(text), repr(text)


def test_bpe_edit_touches_few_pieces():
    text = " ".join(f"word{i}" for i in range(3000))
    doc = bpe.Encoded(text)
    assert doc.edit(6000, 6001, "Q") < 12
    table = bpe.Prefixes(bpe.vocabulary(bpe.VOCABULARY), b"unbelievable")
    table.cut(5)
    table.append(b"ievers")
    assert table.ids() == TIKTOKEN.encode_ordinary("unbelievers")


# Mixing

def test_mix_meets_targets(odd, none):
    found = mixing.mix(odd).collect()
    sizes, taken = Counter(), Counter()
    for r in found:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    words = Counter((d, len(brute.WORD.findall(t or ""))) for d, t in PAIRS)
    assert Counter((r["doc_id"], r["size"]) for r in found) == words
    goal = brute.targets(sizes)
    for r in found:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(goal[r["source"]])
    for source in sizes:
        assert abs(taken[source] - goal[source]) <= 3, source
    assert rows(mixing.mix(odd.repartition(3)), "doc_id", "size", "taken") == rows(mixing.mix(odd), "doc_id", "size", "taken")
    assert mixing.mix(none).count() == 0


def test_take_gives_the_words_of_the_mix(odd, none):
    made = mixing.take(odd)
    assert made.columns == odd.columns
    words = made.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n"))
    taken = mixing.mix(odd).groupBy("source").agg(F.sum("taken").alias("n"))
    assert rows(words.where("n > 0"), "source", "n") == rows(taken.where("n > 0"), "source", "n")
    assert mixing.take(none).count() == 0


# Sharding

def test_shards_match_the_mixture(odd, none):
    df = odd.drop("shard").withColumn("crc", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    made = sharding.interleave(df.withColumn("shard", F.lit("clash")), 8, ties=("crc",))
    found = made.collect()
    by = defaultdict(list)
    for r in found:
        by[r["shard"]].append(r["slot"])
    assert len(found) == len(PAIRS) and set(by) == set(range(8))
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    for source, n in Counter(r["source"] for r in found).items():
        spread = Counter(r["shard"] for r in found if r["source"] == source)
        assert all(abs(spread[k] - n / 8) <= 3 for k in range(8)), source
    again = sharding.interleave(df.repartition(7), 8, ties=("crc",))
    assert rows(again, "doc_id", "crc", "shard", "slot") == rows(made, "doc_id", "crc", "shard", "slot")
    assert sharding.interleave(none, 8).count() == 0


# SimHash

def test_simhash_equals_all_pairs(spark, odd, none):
    want = brute.counted(brute.near(PAIRS))
    assert rows(simhash.near_duplicates(odd), "doc_id", "fingerprint", "component_id") == want
    assert simhash.near_duplicates(none).count() == 0


def test_simhash_links_of_dense_groups(spark):
    """Thousands of fingerprints near one another, in chunks too small for them: one component, few links."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, dtype=np.uint64)
    bits = [(1 << a) | (1 << b) for a in range(60) for b in range(a)][:900]
    far = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    values = sorted({int(base) ^ x for x in bits} | {int(x) for x in far})
    prints = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in values], "fp bigint")
    for chunk in (40, 5000):
        found = simhash.links(prints, chunk=chunk).collect()
        root = {x: x for x in values}

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        for u, v in found:
            u, v = u % (1 << 64), v % (1 << 64)
            root[top(u)] = top(v)
        parts = Counter(top(x) for x in values)
        brute_root = {x: x for x in values}

        def brute_top(x):
            while brute_root[x] != x:
                x = brute_root[x]
            return x

        for i, x in enumerate(values):
            for y in values[:i]:
                if (x ^ y).bit_count() <= 3:
                    brute_root[brute_top(x)] = brute_top(y)
        assert sorted(parts.values()) == sorted(Counter(brute_top(x) for x in values).values())
        assert len(found) < 60 * len(values)


# Exact

def exact_want():
    groups = defaultdict(list)
    for d, t in PAIRS:
        groups["".join(brute.WORD.findall(t or ""))].append((-len(t or ""), brute.ident(d), d))
    out = Counter()
    for key, some in groups.items():
        best, sha = min(some, key=lambda x: x[:2]), hashlib.sha256(key.encode()).hexdigest()
        for x in some:
            out[x[2], best[2], len(some), sha] += 1
    return out


@pytest.mark.parametrize("bits", [64, 2])
def test_exact_groups(odd, bits):
    found = exact.exact_duplicates(identified(odd), bits=bits)
    assert rows(found, "doc_id", "keep_id", "group_size", "text_sha256") == exact_want()
    kept = found.where("kept").groupBy("text_sha256").count().collect()
    assert all(r["count"] == 1 for r in kept) and len(kept) == len({k[3] for k in exact_want()})
    assert found.where("kept").where("not (doc_id <=> keep_id)").count() == 0


def test_exact_drop_keeps_columns(spark, odd, none):
    left = exact.drop_exact_duplicates(odd)
    assert left.columns == odd.columns
    assert left.count() == len({k[3] for k in exact_want()})
    assert exact.drop_exact_duplicates(none).count() == 0
    built = spark.createDataFrame([(1, "a b"), (2, "ab"), (2, "ab")], "doc_id bigint, text string")
    assert [tuple(r) for r in exact.drop_exact_duplicates(built).collect()] == [(1, "a b")]


def test_chunks_follow_content():
    rng = random.Random(5)
    data = bytes(rng.randrange(256) for _ in range(300_000))
    parts = lambda d: {d[a:b] for a, b in zip([0, *exact.cuts(d)], exact.cuts(d))}
    assert b"".join(data[a:b] for a, b in zip([0, *exact.cuts(data)], exact.cuts(data))) == data
    moved = b"inserted" + data
    assert len(parts(data) & parts(moved)) > 0.9 * len(parts(data))
    assert all(len(p) <= exact.MOST for p in parts(data)) and exact.cuts(b"") == []
    assert exact.cuts(b"a" * 50_000)[-1] == 50_000


# Substrings

def test_repeats_equal_all_windows(odd, none):
    found = substring.without_repeats(odd).collect()
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], bytes(r["kept"]).decode()) for r in found)
    assert got == brute.counted(brute.without_repeats(PAIRS))
    assert all(sum(b - a for a, b in r["cut"]) == r["n_removed"] for r in found)
    assert substring.without_repeats(none).count() == 0


def test_repeats_random(spark):
    rng = random.Random(11)
    shared = [[f"p{i}_{j}" for j in range(90)] for i in range(4)]
    docs = []
    for i in range(120):
        words = [f"u{rng.randrange(40)}" for _ in range(rng.randrange(80))]
        for _ in range(rng.randrange(3)):
            some = rng.choice(shared)
            a = rng.randrange(40)
            at = rng.randrange(len(words) + 1)
            words[at:at] = some[a : a + rng.randrange(45, 60)]
        docs.append((rng.randrange(100), " ".join(words)))
    found = substring.without_repeats(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(6)).collect()
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], bytes(r["kept"]).decode()) for r in found)
    assert got == brute.counted(brute.without_repeats(docs))


# Nearest neighbours

def vectors():
    rng = np.random.default_rng(2)
    data = [(i, rng.normal(size=8).round(1).tolist()) for i in range(600)]
    data += [(1000 + i, data[3][1]) for i in range(300)]
    data += [(2000, None), (2001, []), (2002, [0.0] * 8), (2003, [float("nan")] * 8), (2004, [None] * 8), (2005, [float("inf")] * 8)]
    data += [(None, data[5][1]), (None, data[5][1]), (3000, [1.0, 2.0]), (3100, [1.0, 2.5]), data[100], data[100]]
    return data


def nearest_want(data, k):
    fine = [(i, v) for i, v in data if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    asked = {(i, tuple(v)) for i, v in fine if i is not None and i % 100 == 0}
    out = Counter()
    for q, qv in asked:
        found = sorted((round(float(np.linalg.norm(np.float32(v).astype(float) - np.float32(qv).astype(float))), 9), brute.ident(i)) for i, v in fine if i != q and len(v) == len(qv))
        for rank, (d, i) in enumerate(found[:k], 1):
            out[q, rank, None if i == brute.LAST else i, d] += 1
    return out


@pytest.mark.parametrize("shard,block", [(100, 3), (5000, 500)])
def test_neighbours_are_exact_at_factor_one(spark, shard, block):
    df = spark.createDataFrame(vectors(), "vec_id bigint, embedding array<float>")
    found = vptree.neighbours(df, df.where("vec_id % 100 = 0"), 10, 1.0, shard=shard, block=block)
    got = Counter((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in found.collect())
    assert got == nearest_want(vectors(), 10)
    assert vptree.neighbours(df.limit(0), df.limit(0)).count() == 0


def test_neighbours_with_a_factor(spark):
    df = spark.createDataFrame(vectors(), "vec_id bigint, embedding array<float>")
    asked = df.where("vec_id % 100 = 0")
    assert vptree.recall(vptree.neighbours(df, asked, 10, 1.2), vptree.exact_neighbours(df, asked)) >= 0.9
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    asked = table.where("vec_id % 20 = 0")
    assert vptree.recall(vptree.neighbours(table, asked, 10, 3.0), vptree.exact_neighbours(table, asked)) >= 0.9


# Token files

def test_token_files_round_trip(spark, odd, none, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_orc.VOCABULARY)
    path = str(tmp_path / "tokens")
    token_orc.write_tokens(odd, path)
    want = Counter((d, (*library.encode(t or "", add_special_tokens=False).ids, 1)) for d, t in PAIRS)
    held = token_orc.read_tokens(spark, path).orderBy("seq").collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in held) == want
    order = [brute.ident(r["doc_id"]) for r in held]
    assert order == sorted(order)
    start, wanted = 0, []
    for r in held:
        wanted.append((r["doc_id"], start, len(r["ids"]), zlib.crc32(np.array(r["ids"], "<u4").tobytes())))
        start += len(r["ids"])
    assert rows(token_orc.positions(spark, path), "doc_id", "start", "n_tokens", "ids_crc32") == Counter(wanted)
    assert {r["doc_id"] for r in token_orc.lookup(spark, path, [3, 300]).collect()} == {3, 300}
    plan = token_orc.lookup(spark, path, [3])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In" in plan or "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,3)]" in plan
    token_orc.write_tokens(none, path + "-none")
    assert token_orc.positions(spark, path + "-none").count() == 0


def test_words_apart_equal_whole_texts(spark, tmp_path):
    from tokenizers import Tokenizer

    library, rng = Tokenizer.from_file(token_orc.VOCABULARY), random.Random(4)
    alphabet = list("aAbÉΣσ1 2'\t\n\r\x0b\x0c\x1c\x85  　̧́.,😀ﬁİ") + ["'S", "'ll", "the", "é", "<|"]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(25))) for _ in range(800)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in df.select("text", token_orc.encode(F.col("text")).alias("ids")).collect():
        assert r["ids"] == [*library.encode(r["text"], add_special_tokens=False).ids, 1], repr(r["text"])


# Licences

def test_licences_and_inheritance(spark):
    mit, gpl = licenses.TEMPLATES["MIT"][0], licenses.TEMPLATES["GPL-3.0"][0]
    files = [
        (1, "a/LICENSE", mit), (2, "a/b/c/x.txt", "no notice here"), (3, "a/b/d/COPYING", gpl), (4, "a/b/d/y", "text\n" + mit.upper() + "\n" + "word " * 60),
        (5, "a/b/d/z", None), (6, "q/z", ""), (7, None, "nothing"), (None, "a/b/c/x.txt", "no notice here"), (8, "/a//b/c/e/", "x"), (1, "a/LICENSE", mit),
    ]
    df = spark.createDataFrame(files, "doc_id bigint, path string, text string").withColumn("licence", F.lit("clash"))
    found = {(r["doc_id"], r["path"]): (r["licence"], r["how"], r["folder"]) for r in licenses.scan(df).collect()}
    assert found == {
        (1, "a/LICENSE"): ("MIT", "notice", None), (2, "a/b/c/x.txt"): ("MIT", "inherited", "a"), (3, "a/b/d/COPYING"): ("GPL-3.0", "notice", None),
        (4, "a/b/d/y"): ("MIT", "notice", None), (5, "a/b/d/z"): ("GPL-3.0", "inherited", "a/b/d"), (6, "q/z"): (None, "none", None), (7, None): (None, "none", None),
        (None, "a/b/c/x.txt"): ("MIT", "inherited", "a"), (8, "/a//b/c/e/"): ("MIT", "inherited", "a"),
    }
    assert licenses.scan(df).count() == len(files)
    assert licenses.scan(df.limit(0)).count() == 0


def test_cosine_equals_dense_vectors():
    held = licenses.Templates(licenses.TEMPLATES)
    for name, some in licenses.TEMPLATES.items():
        for text in some:
            assert held.nearest(text, 0.8)[0] == name and held.nearest(text)[1] == pytest.approx(1)
    line = "This file is licensed under the Apache License version 2.0"
    terms = Counter(licenses.TERM.findall(line.lower()))
    weight = lambda t: held.weight.get(t, held.other)
    best = 0.0
    for some in licenses.TEMPLATES.values():
        for text in some:
            other = Counter(licenses.TERM.findall(text.lower()))
            dot = sum(terms[t] * other[t] * weight(t) ** 2 for t in terms)
            size = lambda c: sum((n * weight(t)) ** 2 for t, n in c.items()) ** 0.5
            best = max(best, dot / size(terms) / size(other))
    assert held.nearest(line)[1] == pytest.approx(best, abs=1e-8)


# Language

def test_word_probability_sums_all_segmentations():
    held = langid.pieces(langid.VOCABULARY)
    rng = np.random.default_rng(1)
    model = np.vstack([rng.dirichlet(np.full(held.size, 0.05), 2).T, np.zeros(2)])
    at = {name: i for i, name in enumerate(held.names)}

    def total(data):
        if not data:
            return np.ones(2)
        return sum((model[at[data[:k]]] * total(data[k:]) for k in range(1, len(data) + 1) if data[:k] in at), np.zeros(2))

    words = [b"", b"a", b"the", "été".encode(), b"zq9!", b"there", b"ing"]
    got = langid.log_probabilities(words, model)
    for word, found in zip(words, got):
        assert found == pytest.approx(np.log(total(langid.START + word)))
    # Expected counts: derivative of the log probability.
    used = langid.expected_counts([b"there"], np.array([2.0]), model[:, 0])
    piece, step = at[b"re"], 1e-7
    moved = model.copy()
    moved[piece] += step
    slope = (langid.log_probabilities([b"there"], moved) - langid.log_probabilities([b"there"], model))[0, 0] / step
    assert used[piece] == pytest.approx(2 * slope * model[piece, 0], rel=1e-3)
    assert np.isfinite(langid.log_probabilities([b"x" * 5000], model)).all()


def test_language_held_out_accuracy(spark, odd, none):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("out", langid.held_out(F.col("doc_id")))
    languages, model = langid.fit(df.where("not out"))
    found = langid.predict(df, languages, model)
    assert languages == ["de", "en", "es", "fr"]
    right = found.where("out").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.95
    odd_found = langid.predict(odd.withColumn("score", F.lit("clash")), languages, model)
    assert odd_found.count() == len(PAIRS)
    for r in odd_found.collect():
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1
    assert langid.predict(none, languages, model).count() == 0
    assert {r["lang_pred"] for r in langid.predict(odd, *langid.fit(none)).collect()} == {"und"}


# Shared helpers

def test_drop_rows_by_place(odd):
    held = identified(odd)
    some = held.where("doc_id = 3").limit(2)
    assert drop_rows(held, some.select("__row")).count() == len(PAIRS) - 2


def test_join_groups_keeps_hot_and_cold(spark):
    left = spark.range(5000).select((F.when(F.col("id") < 3000, 0).otherwise(F.col("id"))).alias("k"), "id")
    groups = left.groupBy("k").agg(F.count("*").alias("n"))
    found = join_groups(left, groups, "k", "n")
    assert found.count() == 5000 and found.where("k = 0 and n = 3000").count() == 3000


def test_workers_forget_at_a_new_stage(monkeypatch):
    from paperwire.llm import common

    class Context:
        def __init__(self, stage):
            self.stageId = lambda: stage

    known = common.Remembered(10_000)
    for stage, left in ((1, {}), (1, {"a": b"1"}), (2, {})):
        monkeypatch.setattr(common.TaskContext, "get", lambda stage=stage: Context(stage))
        common.forget_at_new_stage(known.clear)
        assert known.young == left
        assert known.get([["a"]], lambda words: [b"1" for _ in words]) == {"a": b"1"}
    monkeypatch.setattr(common.TaskContext, "get", lambda: Context(3))
    common.forget_at_new_stage()
    assert not known.young


def test_different_words_are_cut_once():
    places, words = token_orc._numbered(["Ab ab\x0bAB", "", "ab\xa0x\x1cc  ab "])
    assert sorted(words.dictionary.to_pylist()) == ["", "ab", "ab\xa0x\x1cc"]
    text = words.to_pylist()
    found = [[w for w in text[a:b] if w] for a, b in zip(places, places[1:])]
    assert found == [["ab", "ab", "ab"], [], ["ab\xa0x\x1cc", "ab"]]
