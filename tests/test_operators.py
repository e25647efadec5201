"""Relational operators: results, skew and plans."""

import datetime as dt
import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from paperwire import constants as K
from paperwire.functions import windows as D
from paperwire.functions import text as X
from paperwire.operators import joins, keywords, outbox, requests, subscriptions
from paperwire.operators.author_rows import author_labels
from paperwire.operators.counts import source_counts
from paperwire.operators.numbering import number_rows
from paperwire.operators.topk import first_per_group, first_rows
from paperwire.operators.union import in_digest_order, union_sources

RUN = dt.date(2024, 1, 11)


# --- joins -----------------------------------------------------------------------------


def skewed(spark, rows=3000, seed=1):
    """Rows of which a third share one key and a tenth have none."""
    pick = random.Random(seed)
    data = []
    for n in range(rows):
        x = pick.random()
        data.append((n, "hot" if x < 0.34 else None if x < 0.44 else f"k{pick.randrange(900)}"))
    return spark.createDataFrame(data, "n INT, k STRING"), data


@pytest.mark.parametrize("known", [["hot", "k1", "k2"], ["k1", "k1", None], [], ["zzz", None]])
def test_matching_joins_by_set_rule(spark, no_broadcast, known):
    left, data = skewed(spark)
    keys = spark.createDataFrame([(k,) for k in known], "k STRING")
    kept = sorted(r["n"] for r in joins.keep_matching(left, keys, "k", "n").collect())
    dropped = sorted(r["n"] for r in joins.drop_matching(left, keys, "k", "n").collect())
    assert kept == [n for n, k in data if k in set(known)]
    # What is kept and what is dropped make up the input.
    assert sorted(kept + dropped) == list(range(len(data)))


def test_small_and_large_way_agree(spark):
    left, _ = skewed(spark, seed=2)
    keys = spark.createDataFrame([("hot",), ("k7",), (None,)], "k STRING")
    small = sorted(r["n"] for r in joins.drop_matching(left, keys, "k", "n").collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = sorted(r["n"] for r in joins.drop_matching(left, keys, "k").collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    assert small == large


def test_attach_keeps_every_left_row_once(spark, no_broadcast):
    left, data = skewed(spark)
    right = spark.createDataFrame(
        [("hot", 1, "h"), (None, 2, "none"), ("k3", 3, None)], "k STRING, v INT, w STRING"
    )
    got = {r["n"]: (r["v"], r["w"]) for r in joins.attach(left, right, "k", "n").collect()}
    values = {"hot": (1, "h"), None: (2, "none"), "k3": (3, None)}
    assert got == {n: values.get(k, (None, None)) for n, k in data}


def test_hot_keys_are_bounded_and_spread(spark, no_broadcast):
    """No reduce partition of the join gets the hot key whole."""
    hot = 20000
    left = spark.range(40000).select(
        F.col("id").alias("n"), F.when(F.col("id") < hot, -1).otherwise(F.col("id")).alias("k")
    )
    counts = left.groupBy("k").agg(F.count("*").alias("rows"))
    found = joins.hot_keys(counts, "k", "rows")
    assert [r["k"] for r in found.collect()] == [-1]
    right = spark.range(-1, 40000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = joins.attach(left, right, "k", "n")
        sizes = [
            r["count"]
            for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()
        ]
        assert joined.where(F.col("v") == F.col("k") * 2).count() == 40000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 40000 and max(sizes) < 0.4 * 40000


def test_distinct_values(spark):
    left, data = skewed(spark)
    got = [r["k"] for r in joins.distinct_values(left, "k").collect()]
    assert len(got) == len(set(got)) and set(got) == {k for _, k in data}


# --- windows, counts, order ------------------------------------------------------------


def test_day_windows(spark):
    first = dt.datetime(2024, 1, 1)
    hours = [(n, first + dt.timedelta(hours=6 * n)) for n in range(60)]
    df = spark.createDataFrame(hours, "n INT, ts TIMESTAMP_NTZ")

    def days(predicate):
        rows = df.where(predicate).select(F.to_date("ts").alias("d")).distinct().collect()
        return sorted(r["d"].day for r in rows)

    ts = F.col("ts")
    assert days(D.pubmed_window(ts, RUN, 1)) == [10, 11]
    assert days(D.arxiv_window(ts, RUN, 3)) == [8]
    assert days(D.arxiv_window(ts, RUN, 3, include_upper=True)) == [8, 9]
    assert days(D.biorxiv_window(ts, RUN, 1)) == [9, 10]
    assert days(D.single_day(ts, RUN, 1)) == [10]


def test_day_window_reaches_the_scan(spark, plan, tmp_path):
    spark.range(10).select(
        F.timestamp_seconds("id").cast("timestamp_ntz").alias("ts")
    ).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t")).where(D.single_day(F.col("ts"), RUN, 1))
    assert "GreaterThanOrEqual(ts" in plan(df) and "LessThan(ts" in plan(df)


def test_running_counts(spark):
    df = spark.createDataFrame([(0,)] * 3 + [(2,)] * 2 + [(1,)], "source_rank INT")
    got = [tuple(r) for r in source_counts(df).orderBy("source_rank").collect()]
    assert got == [(0, 3, 3, 6), (1, 1, 4, 6), (2, 2, 6, 6)]


def papers_for_numbers(spark, rows):
    return spark.createDataFrame(rows, "source_rank INT, source_seq BIGINT, paper_key STRING")


@pytest.mark.parametrize("blocks", [None, 2, 50])
def test_numbering_is_the_digest_order(spark, blocks):
    pick = random.Random(3)
    rows = [(pick.choice([0, 0, 0, 1, 2]), pick.randrange(-50, 400), f"p{n}") for n in range(900)]
    # A crowd on one place, rows without a place, and one far away.
    rows += [(1, 7, f"c{n}") for n in range(500)] + [(0, None, f"n{n}") for n in range(5)]
    rows += [(2, 2**62, "far")]
    got = number_rows(papers_for_numbers(spark, rows), blocks=blocks).collect()
    order = sorted(rows, key=lambda r: (r[0], -(2**63) if r[1] is None else r[1], r[2]))
    assert [r["paper_key"] for r in sorted(got, key=lambda r: r["position"])] == [
        r[2] for r in order
    ]
    assert sorted(r["position"] for r in got) == list(range(1, len(rows) + 1))
    assert {r["total"] for r in got} == {len(rows)}


def test_numbering_splits_a_crowd_of_copies(spark, plan):
    """A third of the rows are copies on one place; they are numbered by many tasks."""
    rows = spark.range(3000).select(
        F.lit(0).alias("source_rank"),
        F.when(F.col("id") % 3 == 0, 700).otherwise(F.col("id")).alias("source_seq"),
        F.lit("copy").alias("paper_key"),
        (F.col("id") * 7919 % 3001).alias("row_id"),
    )
    numbered = number_rows(rows, tie="row_id", blocks=30)
    got = numbered.orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(1, 3001))
    order = [(r["source_seq"], r["row_id"]) for r in got]
    assert order == sorted(order)
    window = plan(numbered).split("Window [row_number()")[1]
    assert "share" in window or "_block" in window
    groups = numbered.groupBy(F.spark_partition_id()).count().collect()
    assert max(g["count"] for g in groups) < 1600


@pytest.mark.parametrize("kind", ["text", "null"])
def test_numbering_splits_a_crowd_with_a_text_tie(spark, kind):
    """3000 rows on one place, told apart by their key alone."""
    key = F.concat(F.lit("p"), (F.col("id") * 7919 % 3001).cast("string"))
    rows = spark.range(3000).select(
        F.lit(0).alias("source_rank"),
        (F.lit(None) if kind == "null" else F.lit(7)).cast("bigint").alias("source_seq"),
        F.when(F.col("id") != 5, key).alias("paper_key"),
    )
    numbered = number_rows(rows, blocks=30)
    got = numbered.orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(1, 3001))
    keys = [r["paper_key"] or "" for r in got]
    assert keys == sorted(keys)
    # The position is used, so that its window stays in the plan; small partitions stay apart.
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    used = number_rows(rows, blocks=30).where(F.col("position") > 0)
    groups = used.groupBy(F.spark_partition_id()).count().collect()
    spark.conf.unset(key)
    assert len(groups) > 2 and max(g["count"] for g in groups) < 1700


def test_numbering_of_nothing_and_of_one_row(spark):
    assert number_rows(papers_for_numbers(spark, [])).count() == 0
    row = number_rows(papers_for_numbers(spark, [(0, 5, "p")])).first()
    assert (row["position"], row["total"]) == (1, 1)


def test_numbering_cuts_a_source_that_holds_most_rows(spark):
    rows = spark.range(20000).select(
        F.lit(0).alias("source_rank"), F.col("id").alias("source_seq"),
        F.col("id").cast("string").alias("paper_key"),
    )
    numbered = number_rows(rows, blocks=20)
    assert numbered.where(F.col("position") != F.col("source_seq") + 1).count() == 0


def test_numbering_sends_only_block_counts_to_one_partition(spark, plan):
    rows = spark.range(1000).select(
        (F.col("id") % 3).cast("int").alias("source_rank"), F.col("id").alias("source_seq"),
        F.col("id").cast("string").alias("paper_key"),
    )
    lines = plan(number_rows(rows)).split("\n")
    single = [n for n, line in enumerate(lines) if "Exchange SinglePartition" in line]
    assert len(single) == 1
    assert "HashAggregate(keys=[source_rank" in lines[single[0] + 1]


def test_top_k(spark, plan):
    left, data = skewed(spark)
    first = first_rows(left.where(F.col("k").isNotNull()), 5, F.desc("k"), "n")
    expected = sorted((d for d in data if d[1] is not None), key=lambda d: d[0])
    expected.sort(key=lambda d: d[1], reverse=True)
    assert [(r["n"], r["k"]) for r in first.collect()] == expected[:5]
    assert "TakeOrderedAndProject" in plan(first)
    groups = first_per_group(left, 2, "k", "n")
    wanted = Counter()
    kept = []
    for n, k in data:
        wanted[k] += 1
        if wanted[k] <= 2:
            kept.append(n)
    assert sorted(r["n"] for r in groups.collect()) == kept
    assert "row_number(), 2, Partial" in plan(groups)


def test_union_keeps_duplicates_and_order(spark):
    a = papers_for_numbers(spark, [(1, 2, "x"), (1, 1, "y")])
    b = papers_for_numbers(spark, [(0, 9, "x")])
    both = in_digest_order(union_sources(a, b.select("paper_key", "source_rank", "source_seq")))
    assert [r["paper_key"] for r in both.collect()] == ["x", "y", "x"]


# --- author rows -----------------------------------------------------------------------


def test_author_rows_label(spark):
    pick = random.Random(5)
    rows = [(k, n, f"a{n}", pick.choice(["", "i", None])) for k in range(60)
            for n in range(pick.randrange(1, 9))]
    rows += [(99, n, f"a{n}", "") for n in range(5000)]
    df = spark.createDataFrame(rows, "k INT, pos INT, name STRING, institution STRING")
    got = {r["k"]: (r["authors"], r["author_label"])
           for r in author_labels(df, "k", "pos").collect()}
    for key in {r[0] for r in rows}:
        named = [f"{r[2]} ({r[3]})" if r[3] else r[2] for r in rows if r[0] == key]
        label = ", ".join(named) if len(named) <= 3 else f"{named[0]}, {named[1]} ... {named[-1]}"
        assert got[key] == (len(named), label)


# --- keywords --------------------------------------------------------------------------


def corpus(spark):
    pick = random.Random(7)
    vocabulary = [f"w{n:03d}" for n in range(300)]
    texts = [" ".join(["Common", *pick.choices(vocabulary, k=pick.randrange(1, 60))]) + ", of."
             for _ in range(120)]
    texts += ["", "a b", "Common common common"]
    return spark.createDataFrame([(f"p{n}", t) for n, t in enumerate(texts)],
                                 "paper_key STRING, Abstract STRING"), texts


def tfidf_spec(texts, k=10):
    counts = [Counter("".join(c if c.isalnum() else " " for c in t.lower()).split()) for t in texts]
    df = Counter(w for c in counts for w in c)
    n = sum(1 for t in texts if t)
    out = {}
    for i, c in enumerate(counts):
        ranked = sorted(c, key=lambda w: (-round(c[w] * math.log(n / df[w]), 6), w))
        if ranked:
            out[f"p{i}"] = ", ".join(ranked[:k])
    return out


def summaries(df):
    return {r["paper_key"]: r["SummaryAbstract"] for r in df.collect()}


def test_tfidf_against_its_specification(spark):
    papers, texts = corpus(spark)
    assert summaries(keywords.tfidf_keywords(papers)) == tfidf_spec(texts)


def test_tfidf_without_broadcast(spark, no_broadcast):
    papers, texts = corpus(spark)
    assert summaries(keywords.tfidf_keywords(papers, keywords=4)) == tfidf_spec(texts, 4)


@pytest.mark.parametrize("common", [0, 5, 100])
def test_tfidf_shuffles_only_rare_words_that_may_win(spark, no_broadcast, monkeypatch, common):
    """Of words that all papers share, no row meets the table of the rare ones; the best are the same."""
    papers, texts = corpus(spark)
    left = []
    write = keywords.write_once

    def counted(rows, name):
        written = write(rows, name)
        if name == "contenders":
            left.append(written.count())
        return written

    monkeypatch.setattr(keywords, "write_once", counted)
    assert summaries(keywords.tfidf_keywords(papers, keywords=4, common=common)) == tfidf_spec(texts, 4)
    occurrences = sum(len(set(t.lower().replace(",", "").replace(".", "").split())) for t in texts)
    # Without a common word nothing is known of any score but its bounds.
    assert len(left) == 1 and (left[0] <= occurrences if not common else left[0] < occurrences)


def test_frequencies_are_cut_at_a_bounded_table(spark):
    words = spark.range(1, 1001).select(F.concat(F.lit("w"), "id").alias("term"), (F.lit(1000) / F.col("id") + 1).cast("bigint").alias("df"))
    for common in (0, 1, 10, 100, 999):
        cut = keywords.split_by_frequency(words, common)
        assert words.where(F.col("df") > cut).count() <= common
    assert keywords.split_by_frequency(words, 1000) == 1


def test_more_texts_give_more_tasks(spark, tmp_path, monkeypatch):
    from paperwire.operators import sizing

    path = str(tmp_path / "papers")
    corpus(spark)[0].write.parquet(path)
    monkeypatch.setattr(sizing, "TASK_BYTES", 1 << 10)
    papers = spark.read.parquet(path)
    tasks = sizing.tasks_for(papers)
    assert tasks > spark.sparkContext.defaultParallelism
    assert keywords.term_counts(papers, "paper_key").rdd.getNumPartitions() == tasks


def test_attach_gives_blank_where_there_is_no_summary(spark):
    papers, texts = corpus(spark)
    got = summaries(keywords.attach_summaries(papers, keywords.tfidf_keywords(papers)))
    assert len(got) == len(texts)
    assert (got["p120"], got["p121"]) == ("", "a, b")


def test_default_plans_run_no_python(spark, plan):
    papers, _ = corpus(spark)
    text = plan(keywords.tfidf_keywords(papers))
    assert "Python" not in text and "Pandas" not in text


def test_column_extractor_takes_a_pandas_udf(spark):
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def longest(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: max(t.split(), key=len))

    papers = spark.createDataFrame([("a", "x yyy"), ("b", "")], "paper_key STRING, Abstract STRING")
    assert summaries(keywords.by_column(longest)(papers)) == {"a": "yyy", "b": ""}


# --- requests and answers --------------------------------------------------------------


def test_request_record(spark):
    texts = [("a", 'Say "hi"\n'), ("b", "")]
    papers = spark.createDataFrame(texts, "paper_key STRING, Abstract STRING")
    rows = requests.request_json(requests.prompt_requests(papers, "PROMPT", "m")).collect()
    assert len(rows) == 1
    assert json.loads(rows[0]["body"]) == {
        "paper_key": "a",
        "model": "m",
        "messages": [
            {"role": "system", "content": K.SYSTEM_MESSAGE},
            {"role": "user", "content": 'PROMPT　Say "hi"\n'},
        ],
        "temperature": 1, "max_tokens": 1001, "top_p": 1,
        "frequency_penalty": 0, "presence_penalty": 0,
    }


def test_answers(spark):
    def body(*texts):
        return json.dumps({"choices": [{"message": {"content": t}} for t in texts]})

    rows = [("a", body("　 a\n", "second")), ("b", body()), ("c", "no json"), ("d", None),
            ("e", body("late")), ("e", body("early")), ("e", "broken")]
    df = spark.createDataFrame(rows, "paper_key STRING, body STRING")
    assert summaries(requests.answers(df)) == {"a": "a", "b": "", "c": "", "d": "", "e": "early"}


# --- outbox ----------------------------------------------------------------------------


def numbered(spark):
    rows = [("p1", 1, "T", "https://doi.org/10.1/a", "bioRxiv", "A (x)", "k1, k2"),
            ("p2", 2, "U", None, "bioRxiv", "B", "")]
    schema = ("paper_key STRING, position BIGINT, Title STRING, paperLink STRING, "
              "Source STRING, label STRING, SummaryAbstract STRING")
    df = spark.createDataFrame(rows, schema)
    return df.withColumn("total", F.lit(2).cast("bigint"))


@pytest.mark.parametrize("fmt", ["json", "parquet"])
def test_outbox_round_trip(spark, tmp_path, fmt):
    ts = dt.datetime(2024, 1, 1, 15, 30)
    rows = outbox.fan_out(numbered(spark), ts, "label", ("teams", "line", "slack", "discord"))
    path = str(tmp_path / "out")
    for _ in range(2):  # a second run replaces the first
        outbox.write_outbox(rows, path, fmt)
    sent = {r["channel"]: r for r in outbox.read_outbox(spark, path, fmt).collect()}
    assert set(sent) == {"teams", "line", "slack", "discord"}
    h = "2024/01/02 00:30 | bioRxiv | 1/2"
    assert sent["discord"]["message"] == (
        f"**{h}**\r**[T](<https://doi.org/10.1/a>)**\rA (x)\r\rk1, k2\r\r​"
    )
    assert sent["discord"]["username"] == K.DISCORD_USERNAME
    assert sent["line"]["username"] is None and sent["line"]["title"] == "T"
    assert json.loads(sent["slack"]["payload"]) == {"text": sent["slack"]["message"]}
    failed = outbox.read_outbox_errors(spark, path, fmt).collect()
    assert sorted((r["channel"], r["paper_key"]) for r in failed) == [
        (c, "p2") for c in ("discord", "line", "slack", "teams")
    ]


def test_fan_out_reads_the_papers_once(spark, plan, tmp_path):
    numbered(spark).write.parquet(str(tmp_path / "p"))
    papers = spark.read.parquet(str(tmp_path / "p"))
    rows = outbox.fan_out(papers, dt.datetime(2024, 1, 1), "label", ("teams", "line"))
    assert plan(rows).count("FileScan") == 1 and rows.count() == 4


def test_author_labels_read_their_input_once(spark, plan, no_broadcast, tmp_path):
    """Also a key with very many authors, and places alike."""
    rows = [(1, n, f"a{n:05}", "") for n in range(3000)] + [(2, 1, "b", "U"), (2, 1, "b", "U"), (3, 2, "d", None), (3, 1, "c", "V")]
    rows += [(4, n, f"e{n}", "W" if n == 3 else "") for n in range(4)] + [(5, n, f"f{n}", "") for n in range(3)]
    path = str(tmp_path / "authors")
    spark.createDataFrame(rows, "k INT, seq INT, name STRING, institution STRING").repartition(5).write.parquet(path)
    made = author_labels(spark.read.parquet(path), "k", "seq")
    assert plan(made).count("FileScan") == 1
    got = {r["k"]: (r["authors"], r["author_label"]) for r in made.collect()}
    assert got == {
        1: (3000, "a00000, a00001 ... a02999"), 2: (2, "b (U), b (U)"), 3: (2, "c (V), d"), 4: (4, "e0, e1 ... e3 (W)"),
        5: (3, "f0, f1, f2"),
    }


def test_more_input_gives_more_tasks(spark, tmp_path, monkeypatch):
    """The author step is dealt by the size of what is read, not by the cores."""
    from paperwire.operators import sizing

    path = str(tmp_path / "authors")
    spark.range(20000).select(
        (F.col("id") % 5000).alias("k"), F.col("id").alias("seq"), F.sha2(F.col("id").cast("string"), 256).alias("name"),
        F.lit("").alias("institution"),
    ).write.parquet(path)
    rows = spark.read.parquet(path)
    assert sizing.tasks_for(rows) == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(sizing, "TASK_BYTES", 1 << 16)
    tasks = sizing.tasks_for(rows)
    assert tasks > 15 and sizing.tasks_for(rows.crossJoin(rows.select("k").alias("other"))) <= 2 * tasks
    made = author_labels(rows, "k", "seq", tasks=tasks)
    assert made.rdd.getNumPartitions() == tasks and made.count() == 5000


# --- subscriptions ---------------------------------------------------------------------


def test_subscriptions_equal_every_pair_searched(spark, plan):
    pick = random.Random(8)
    texts = ["".join(pick.choices("ab cé", k=pick.randrange(0, 30))) for _ in range(150)] + ["", None, "ABBA Éc", "x" * 500 + "abc"]
    papers = [(n, t, texts[-1 - n]) for n, t in enumerate(texts)]
    words = ["", "a", "B", "bé", "abc", "abca", "a b", "zzz", "xxxxabc", "abba", "éc", "b  a", "cabba"]
    df = spark.createDataFrame(papers, "paper_key BIGINT, Title STRING, Abstract STRING")
    wanted = spark.createDataFrame([(w,) for w in [*words, "abc", None]], "keyword STRING")

    def matches(words):
        return {(n, w.lower()) for n, t, a in papers for w in words if w.lower() in (t or "").lower() or w.lower() in (a or "").lower()}

    found = subscriptions.keyword_matches(df, wanted, sample=40)
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == matches(words)
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)
    only = wanted.where("keyword = 'abca'")
    assert {tuple(r) for r in subscriptions.keyword_matches(df, only).collect()} == matches(["abca"])
    assert subscriptions.keyword_matches(df, wanted.limit(0)).count() == 0
    whole = {(n, w) for n, t, a in papers for w in {x.lower() for x in words} if w and w in (t or "").lower().split() + (a or "").lower().split()}
    by_word = subscriptions.word_matches(df, wanted)
    assert {tuple(r) for r in by_word.collect()} == whole and "NestedLoop" not in plan(by_word)
    subs = spark.createDataFrame([(1, "abc"), (1, "ABCA"), (2, "zzz"), (3, "")], "sub INT, keyword STRING")
    got = {tuple(r) for r in subscriptions.subscribed(found, subs, "paper_key", "sub").collect()}
    assert got == {(n, 1) for n, _ in matches(["abc"])} | {(n, 3) for n, _, _ in papers}


@pytest.mark.parametrize("listed", [1000, 2])
def test_subscriptions_move_no_text(spark, plan, monkeypatch, listed):
    """Texts are searched where they lie; the way for more keywords than can be broadcast gives the same."""
    texts = ["a\U0001F600b?cd", "?cd x", "\U0001F600", "abcdef", None]
    df = spark.createDataFrame([(n if n else None, t, "") for n, t in enumerate(texts)], "paper_key BIGINT, Title STRING, Abstract STRING")
    wanted = spark.createDataFrame([(w,) for w in ("\U0001F600b", "?", "?b", "?cd", "bcde", "\U0001F600")], "keyword STRING")
    monkeypatch.setattr(subscriptions, "LISTED", listed)
    found = subscriptions.keyword_matches(df, wanted)
    assert "SortMergeJoin" not in plan(found)
    rows = {tuple(r) for r in found.collect()}
    # A paper without a key is met by short keywords alone.
    assert rows == {
        (None, "\U0001F600b"), (None, "\U0001F600"), (None, "?"), (None, "?cd"), (1, "?"), (1, "?cd"), (2, "\U0001F600"), (3, "bcde"),
    }
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        large = {tuple(r) for r in subscriptions.keyword_matches(df, wanted).collect()}
    finally:
        spark.conf.set(key, before)
    assert large == rows


# --- the ledger of requests --------------------------------------------------------------


def reply(text):
    return json.dumps({"choices": [{"message": {"content": text}}]})


def test_requests_are_asked_until_they_are_answered(spark, tmp_path):
    rows = [(n, f"p{n}", f"abstract {n % 7}" if n % 5 else "") for n in range(60)]
    papers = spark.createDataFrame(rows, "row_id BIGINT, paper_key STRING, Abstract STRING")
    path = str(tmp_path / "requests")
    first = requests.asking(path)(papers)
    assert {r["SummaryAbstract"] for r in first.collect()} == {""}
    sent = spark.read.json(path)
    asked = {r["custom_id"]: r["body"]["messages"][1]["content"] for r in sent.collect()}
    assert sent.count() == len(asked) == 7  # equal questions once
    assert asked.keys() == {r["request_id"] for r in requests.with_id(requests.prompt_requests(papers)).collect()}
    known = sorted(asked)[:4]
    replies = [(k, reply(f"words of {asked[k][-1]} ")) for k in known[:3]] + [(known[3], "{}"), (known[0], "broken")]
    table = spark.createDataFrame(replies, "request_id STRING, body STRING")
    second = requests.asking(path, table)(papers).collect()
    assert {r["custom_id"] for r in spark.read.json(path).collect()} == set(asked) - set(known[:3])
    done = {asked[k][-1] for k in known[:3]}
    assert len(second) == 60
    for r in second:
        last = r["Abstract"][-1:]
        assert r["SummaryAbstract"] == (f"words of {last}" if last in done else "")
    everything = spark.createDataFrame([(k, reply("all")) for k in asked], "request_id STRING, body STRING")
    assert requests.write_requests(requests.with_id(requests.prompt_requests(papers)), path, everything) == 0


def test_request_files_have_bounded_bytes(spark, tmp_path):
    papers = spark.range(300).select(
        F.col("id").cast("string").alias("paper_key"), F.concat(F.lit("x" * 200), F.col("id").cast("string")).alias("Abstract")
    ).coalesce(1)
    path = tmp_path / "requests"
    asked = requests.with_id(requests.prompt_requests(papers))
    assert requests.write_requests(asked, str(path), file_bytes=20_000) == 300
    sizes = [f.stat().st_size for f in path.glob("part-*")]
    assert len(sizes) > 5 and max(sizes) <= 20_000


# --- words of all scripts ----------------------------------------------------------------


def test_words_of_spaced_and_unspaced_scripts(spark):
    texts = ["AI AI AI ML 3D robot", "自動化ラボ用AIロボット", "データ", "私 x", "ภาษาไทย!", "", "naïve Ümlaut"]
    want = [
        ["ai", "ai", "ai", "ml", "3d", "robot"],
        ["自動", "動化", "化ラ", "ラボ", "ボ用", "ai", "ロボ", "ボッ", "ット"],
        ["デー", "ータ"], ["私", "x"], ["ภา", "าษ", "ษา", "าไ", "ไท", "ทย"], [], ["naïve", "ümlaut"],
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING").select("t", X.words(F.col("t")).alias("w"))
    got = {r["t"]: [w for w in r["w"] if w] for r in df.collect()}
    assert [got[t] for t in texts] == want
    papers = spark.createDataFrame([("a", texts[0]), ("b", "robot")], "paper_key STRING, Abstract STRING")
    found = {r["paper_key"]: r["SummaryAbstract"] for r in keywords.tfidf_keywords(papers).collect()}
    assert found["a"] == "ai, 3d, ml, robot"


def test_the_bar_of_a_paper_is_one_pass(spark):
    """Four words, the bar at the second: a rare word stays if it may reach the bar; a short paper keeps all."""
    rows = [(1, "a", 3, 2), (1, "b", 2, 2), (1, "c", 1, 2), (1, "d", 1, None), (2, "e", 1, 5)]
    terms = spark.createDataFrame(rows, "key bigint, term string, tf bigint, df bigint")
    found = keywords.contenders(terms, lambda tf, df: tf * 10.0 / df, "key", 2, 4)
    assert {r["term"] for r in found.collect()} == {"a", "b", "d", "e"}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1
