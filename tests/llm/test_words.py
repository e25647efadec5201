"""Toxicity, spelling variants and tokenizer alignment, in plain Python over small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperwire.llm import alignment, spelling, toxicity
from paperwire.llm.queries import QUERIES
from tests.llm.conftest import odd_documents

SMALL = "/root/testdata/sf0.001"
PAIRS = [(r[0], r[1]) for r in odd_documents()]


# Spelling variants


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_words(pairs, every=199, least=5):
    n = Counter()
    for doc, text in pairs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if doc is None else doc}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                n[run] += 1
    return {w: k for w, k in n.items() if k >= least}


def plain_near(n):
    """Words that share a form with one letter taken out, or are one letter longer; then compared."""
    by, near = defaultdict(set), {w: [] for w in n}
    for w in n:
        for key in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by[key].add(w)
    for some in by.values():
        for w in some:
            near[w] += [v for v in some if one_apart(w, v)]
    return {w: sorted(set(some)) for w, some in near.items()}


def plain_variants(n):
    near = plain_near(n)
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    rows = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root))
    return rows


COLUMNS = ["word", "n", "n_near", "form", "form_n", "root"]


def got(df):
    found = [tuple(r) for r in df.select(*COLUMNS).collect()]
    assert len(found) == len(set(found))
    return set(found)


def spelt(seed=2, words=120, rows=400):
    """Words of four letters' alphabets with their misspellings, some accented, some very long."""
    rng = random.Random(seed)
    base = ["".join(rng.choices("abé÷Z", k=rng.randrange(6, 12))) for _ in range(words)] + ["x" * 300 + "abc", "x" * 300 + "abd"]
    out = []
    for i in range(rows):
        some = rng.choices(base, weights=[1 / (k % 30 + 1) for k in range(len(base))], k=60)
        for k in range(0, 60, 7):
            w = some[k]
            at = rng.randrange(len(w))
            some[k] = rng.choice([w[:at] + w[at + 1 :], w[:at] + "q" + w[at:], w[:at] + "ü" + w[at + 1 :]])
        out.append((i if i % 9 else None, " ".join(some) if i % 11 else None))
    return out


def test_variants_equal_all_pairs(spark, odd, none):
    rows = spelt()
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = plain_variants(plain_words(rows))
    assert len(want) > 150 and sum(r[3] is not None for r in want) > 20
    assert got(spelling.variants(df)) == want
    assert got(spelling.variants(odd)) == plain_variants(plain_words(PAIRS))
    assert spelling.variants(none).count() == 0


@pytest.mark.parametrize("levels, groups, chunk", [(4, 10, 7), (1, 3, 5), (6, 6, 1000)])
def test_each_pair_meets_once_however_the_trie_is_dealt(spark, levels, groups, chunk):
    n = plain_words(spelt(5), least=1)
    found = spark.createDataFrame(list(n.items()), "word string, n bigint")
    near = {r["word"]: (r["n_near"], r["best"], r["best_n"]) for r in spelling.neighbours(found, levels, groups, chunk).collect()}
    for w, some in plain_near(n).items():
        best = min(some, key=lambda v: (-n[v], v), default=None)
        assert near.get(w, (0, None, None)) == (len(some), best, n.get(best)), w


def test_forms_are_followed_to_the_last(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(13)] + [("a", "b"), ("c", "b")]
    found = dict(spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect())
    assert found == {f"w{i}": "w13" for i in range(13)} | {"a": "b", "c": "b"}


def test_query_over_whole_table_equals_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert got(QUERIES["op12_spelling"](spark, SMALL)) == plain_variants(plain_words(rows))


# Tokenizer alignment


def plain_alignment(text, tool):
    """The whole text at once, from the bytes of its tokens alone."""
    data = (" " + text).encode()
    a, b = tool.a.encode(" " + text, add_special_tokens=False).ids, tool.b.encode(text)
    a_parts, b_parts = [tool.a_bytes[i] for i in a], [tool.b_bytes[i] for i in b]
    if not text or b"".join(a_parts) != data or b"".join(b_parts) != data:
        return None
    a_ends, b_ends = np.cumsum(list(map(len, a_parts))).tolist(), np.cumsum(list(map(len, b_parts))).tolist()
    groups, i, j = [], 0, 0
    a_at, b_at = {end: k + 1 for k, end in enumerate(a_ends)}, {end: k + 1 for k, end in enumerate(b_ends)}
    for end in sorted(a_at.keys() & b_at.keys()):
        x, y = a_at[end], b_at[end]
        groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
        i, j = x, y
    owner_a = [i for i, p in enumerate(a_parts) for _ in p]
    owner_b = [j for j, p in enumerate(b_parts) for _ in p]
    links = sorted(set(zip(owner_a, owner_b)))
    return len(a), len(b), groups, [(a[i], b[j]) for i, j in links]


def plain_corpus(pairs, tool):
    found = [(doc, plain_alignment(text or "", tool)) for doc, text in pairs]
    counts = Counter(link for _, x in found if x for link in x[3])
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    rows = Counter()
    for doc, x in found:
        if x is None:
            rows[(doc, 0, 0, 0, 0, 0, 0, "")] += 1
            continue
        n_a, n_b, groups, links = x
        best = sum(counts[link] == most[link[1]] for link in links)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        rows[(doc, n_a, n_b, len(groups), len(links), best, sum(counts[link] for link in links), digest)] += 1
    return rows


ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def aligned(df):
    return Counter(tuple(r) for r in df.select(*ALIGNED).collect())


def test_alignment_equals_the_whole_texts(spark, odd, none):
    tool = alignment.aligner()
    rows = PAIRS + [(500, "a▁b"), (501, "한국어 日本語 🙂🙂\n\n  x\r\n"), (502, " "), (503, "\n"), (504, "<|endoftext|> <s></s><unk> <0x0A>"), (505, "é ﬁ  x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = plain_corpus(rows, tool)
    assert aligned(alignment.align(df)) == want
    assert aligned(alignment.align(df, block=500)) == want  # pairs looked up in several blocks
    assert aligned(alignment.align(odd)) == plain_corpus(PAIRS, tool)
    assert alignment.align(none).count() == 0


def test_segments_are_what_the_tokenizers_cut(spark):
    rng, tool = random.Random(4), alignment.aligner()
    letters = list("ab  cé日🙂\n\n\t\r.,'1▁-") + ["  ", "\n\n", " the", "ing", "<s>", "<|endoftext|>", "\x00", "\x1c", "　", "é", "'re", "\r\n", "\u0085", "​"]
    for _ in range(1500):
        text = "".join(rng.choices(letters, k=rng.randrange(1, 30)))
        found, want = tool.align(tool.segments(text)), plain_alignment(text, tool)
        assert all(x.fits for x in found) == (want is not None), repr(text)
        if want:
            assert ";".join(x.text() for x in found) == ";".join(want[2]), repr(text)
            assert sum(len(x.links) for x in found) == len(want[3]), repr(text)


def test_alignment_query_equals_the_whole_texts(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert aligned(QUERIES["op13_alignment"](spark, SMALL)) == plain_corpus(rows, alignment.aligner())


# Toxicity


def test_machine_learns_pairs_that_weights_cannot():
    """Either insult is toxic beside its own group only, so no sum of weights tells the rows apart."""
    rng = random.Random(7)
    insults, groups, prose = ["vile", "filth"], ["tribe", "caste"], [f"w{i}" for i in range(100)]
    texts, labels = [], []
    for _ in range(3000):
        words, i, j = rng.choices(prose, k=8), rng.randrange(2), rng.randrange(2)
        said = rng.random() < 0.7
        words += [insults[i], groups[j]] if said else [rng.choice(insults + groups)] * (rng.random() < 0.3)
        texts.append(" ".join(words))
        labels.append(int(said and i == j))
    rows = [toxicity.terms_of(t).astype(np.int64) for t in texts]
    y = np.array(labels, float)
    machine = toxicity.train(rows[:2400], y[:2400], np.ones(2400))
    right = np.mean([(machine.score(r) >= 0.5) == bool(x) for r, x in zip(rows[2400:], y[2400:])])
    assert right > 0.97


def test_scores_equal_the_machine(spark, odd, none):
    rng = np.random.default_rng(3)
    machine = toxicity.Machine(-1.0, rng.normal(0, 0.1, toxicity.BUCKETS).astype(np.float32), rng.normal(0, 0.05, (toxicity.BUCKETS, 4)).astype(np.float32))
    machine.weights[::3] = 0
    machine.vectors[::3] = 0
    found = toxicity.score(odd.select("doc_id", "text"), machine).collect()
    assert len(found) == len(PAIRS)
    for _, text, score in found:
        assert score == pytest.approx(machine.score(toxicity.terms_of(text)), abs=1e-5)
    assert toxicity.score(none, machine).count() == 0


def test_toxicity_finds_held_out_rows_and_leaves_the_rest(spark):
    sf = "/root/testdata/sf0.01"
    found = QUERIES["op11_toxicity"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = found.join(labels, "doc_id").select("held_out", "predicted", "toxic", "score").collect()
    held = [r for r in rows if r["held_out"]]
    assert found.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert np.mean([r["predicted"] == r["toxic"] for r in held]) > 0.93
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    clean = [r["predicted"] for r in held if not r["toxic"]]
    assert np.mean(clean) < 0.02


def test_toxicity_takes_odd_rows_and_no_labels(spark, odd, none):
    labels = spark.createDataFrame([(d, 1, i % 2) for i, (d, _) in enumerate(PAIRS)] + [(1, 1, None), (None, 0, 1)], "doc_id bigint, quality int, toxic int")
    found = toxicity.detect(odd, labels)
    assert found.count() == len(PAIRS) and found.where("score is null or score < 0 or score > 1").count() == 0
    by = found.where("doc_id in (200, 201)").select("score").distinct().count()
    assert by == 1  # NULL and empty texts have the score of the bias
    assert toxicity.detect(none, labels).count() == 0
    unlearned = toxicity.detect(odd, labels.where("doc_id < -5"))
    assert {tuple(r) for r in unlearned.select("score", "predicted").distinct().collect()} == {(0.0, 0)}


def test_sample_is_bounded_whatever_repeats(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("the same words").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 10 == 0).cast("int").alias("toxic"))
    seen = []
    original = toxicity.train

    def watched(rows, *args, **kwargs):
        seen.append(len(rows))
        return original(rows[:10], *[a[:10] for a in args], **kwargs)

    toxicity.train = watched
    try:
        toxicity.fit(docs, labels, sample=400)
    finally:
        toxicity.train = original
    assert 300 < seen[0] < 500


def test_token_sizes_are_known():
    tool = alignment.aligner()
    assert tool.a_sizes.tolist() == list(map(len, tool.a_bytes)) and tool.b_sizes.tolist() == list(map(len, tool.b_bytes))
