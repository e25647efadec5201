"""Whole runs on landed fixtures, streaming, and the driver contract."""

import datetime as dt
import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from paperwire.operators import outbox
from paperwire.operators.requests import answered
from paperwire.plans import digest as G
from paperwire.plans.oracle import ORACLE_SQL
from paperwire.plans.queries import QUERIES
from paperwire.schema import LANDING, JobConfig
from paperwire.sources import atom, medline
from paperwire.streaming import intake
from test_sources import ATOM, BIORXIV, CHEMRXIV, MEDLINE

RUN_TS = dt.datetime(2024, 1, 11, 15, 30)
SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def landed(spark, tmp_path):
    (tmp_path / "pubmed.txt").write_text(MEDLINE)
    (tmp_path / "feed.xml").write_text(ATOM)
    at = dt.datetime(2024, 1, 11)
    rows = [
        ("biorxiv", "q", 0, "u", 200, json.dumps({"collection": BIORXIV}), at),
        ("chemrxiv", "q", 0, "u", 200, json.dumps(CHEMRXIV), at),
        ("biorxiv", "q", 100, "u", 503, "", at),
    ]
    return G.Landed(
        medline=medline.read_medline(spark, str(tmp_path / "pubmed.txt")),
        replies=spark.createDataFrame(rows, LANDING),
        atom=atom.read_atom(spark, str(tmp_path / "feed.xml")),
    )


def config(**changes):
    return JobConfig(**(dict(term="automation", term_biorxiv="Lab auto",
                             term_chemrxiv="on the", run_ts=RUN_TS) | changes))


def test_whole_run(spark, landed, tmp_path):
    out = str(tmp_path / "out")
    G.run(landed, config(), out)
    sent = outbox.read_outbox(spark, f"{out}/outbox").collect()
    line = sorted((r["position"], r["title"]) for r in sent if r["channel"] == "line")
    # Numbers count every selected paper, also those that cannot be sent for want of a link.
    assert line == [
        (1, "A long title that wraps here"),
        (2, "Lab robots"), (3, "Other"), (4, "Label text"), (5, "Lab robots v2"),
        (7, "On the bench"),
    ]
    teams = next(r for r in sent if r["channel"] == "teams" and r["position"] == 2)
    assert teams["message"] == (
        "**2024/01/12 00:30 | bioRxiv | 2/8** <br> **[Lab robots](https://doi.org/10.1/a)** <br> "
        "A, B., C, D. (U) <br><br> x <br><br> "
    )
    failed = outbox.read_outbox_errors(spark, f"{out}/outbox").collect()
    assert {(r["position"], r["title"]) for r in failed} == {(6, "Lab null"), (8, "Bench on")}
    counts = spark.read.json(f"{out}/counts").collect()
    assert {r["source_rank"]: r["papers_so_far"] for r in counts} == {0: 1, 1: 6, 2: 8}
    rejected = spark.read.json(f"{out}/rejects").collect()
    assert [(r["source"], r["status"], r["replies"]) for r in rejected] == [("biorxiv", 503, 1)]


def test_run_with_a_third_of_copies(spark, no_broadcast, tmp_path):
    """Copies of one reply stay, are numbered once each and are told apart by nothing else."""
    rows = []
    for n in range(600):
        k = 7 if n % 3 == 0 else n
        body = json.dumps({"collection": [item(f"10.1/{k}", "2024-01-10")]})
        # Another query each, so that the copies are pages of their own on one place.
        rows.append(("biorxiv", f"q{n}", k, "u", 200, body, dt.datetime(2024, 1, 11)))
    path, out = str(tmp_path / "landing"), str(tmp_path / "out")
    spark.createDataFrame(rows, LANDING).repartition(4).write.parquet(path)
    landed = G.Landed(replies=spark.read.schema(LANDING).parquet(path))
    G.run(landed, config(sources=("biorxiv",), channels=("line",)), out)
    sent = outbox.read_outbox(spark, f"{out}/outbox").orderBy("position").collect()
    assert [r["position"] for r in sent] == list(range(1, 601))
    want = sorted([7] * 200 + [n for n in range(600) if n % 3])
    assert [int(r["title"].split("/")[1]) for r in sent] == want
    copies = {r["message"].split("\n", 1)[1] for r in sent if r["title"] == "Lab 10.1/7"}
    assert len(copies) == 1


def test_switched_sources_channels_and_answers(spark, landed, tmp_path):
    chosen = config(sources=("arxiv",), channels=("slack",), term="lab robots")
    papers = G.land_papers(G.select_papers(landed, chosen))
    keys = [r["paper_key"] for r in papers.orderBy("source_seq").collect()]
    assert [k.split(":")[0] for k in keys] == ["arxiv", "arxiv"]
    body = json.dumps({"choices": [{"message": {"content": " 語, words　"}}]})
    replies = spark.createDataFrame([(keys[0], body)], "paper_key STRING, body STRING")
    rows = G.digest(papers, chosen, answered(replies)).orderBy("position").collect()
    assert [r["channel"] for r in rows] == ["slack", "slack"]
    assert rows[0]["message"].endswith("\n\n 語, words")
    assert rows[1]["message"].endswith("\n\n ")


def test_unknown_source_is_an_error(landed):
    with pytest.raises(ValueError):
        G.select_papers(landed, config(sources=("nowhere",)))


def item(doi, day):
    return dict(doi=doi, title=f"Lab {doi}", abstract="x", authors="A", date=day,
                author_corresponding_institution="I")


def land(spark, path, day, dois):
    rows = [("biorxiv", day, n, f"u{n}", 200, json.dumps({"collection": [item(d, day)]}), RUN_TS)
            for n, d in enumerate(dois)]
    spark.createDataFrame(rows, LANDING).coalesce(1).write.mode("append").parquet(path)


def test_intake_takes_each_landed_file_once(spark, tmp_path):
    path, out, state = (str(tmp_path / n) for n in ("landing", "papers", "state"))
    land(spark, path, "2024-01-09", ["10.1/a", "10.1/b"])
    papers = intake.paper_stream(intake.landing_stream(spark, path), "lab")
    intake.run_available(papers, out, state)
    land(spark, path, "2024-01-10", ["10.1/b", "10.1/c"])
    papers = intake.paper_stream(intake.landing_stream(spark, path), "lab")
    intake.run_available(papers, out, state)
    got = sorted((r["published"].day, r["DOI"]) for r in spark.read.parquet(out).collect())
    assert got == [(9, "10.1/a"), (9, "10.1/b"), (10, "10.1/b"), (10, "10.1/c")]


def test_unseen_remembers_between_runs_and_forgets_in_time(spark, tmp_path):
    path, out, state = (str(tmp_path / n) for n in ("landing", "papers", "state"))

    def run(**options):
        papers = intake.paper_stream(intake.landing_stream(spark, path, 1), "lab")
        intake.run_unseen(papers, out, state, keep=3, **options)
        return papers.schema

    land(spark, path, "2024-01-09", ["10.1/a", "10.1/b", *["10.1/hot"] * 50, None, None])
    run()
    land(spark, path, "2024-01-10", ["10.1/b", "10.1/c", "10.1/hot", None])
    run()
    land(spark, path, "2024-02-10", ["10.1/z"])
    run()
    # Beyond reach of the first days.
    land(spark, path, "2024-02-11", ["10.1/a"])
    run()
    # An old file that lands late is judged like any other; days before the ledger's are listed.
    land(spark, path, "2024-01-11", ["10.1/late", "10.1/c", "10.1/z"])
    land(spark, path, "2023-12-01", ["10.1/older"])
    schema = run(since=dt.date(2024, 1, 1))
    got = sorted((str(r["published"])[5:], r["DOI"] or "") for r in intake.read_unseen(spark, out, schema).collect())
    assert got == [
        ("01-09", ""), ("01-09", "10.1/a"), ("01-09", "10.1/b"), ("01-09", "10.1/hot"), ("01-10", "10.1/c"),
        ("01-11", "10.1/late"), ("01-11", "10.1/z"), ("02-10", "10.1/z"), ("02-11", "10.1/a"),
    ]
    assert [r["DOI"] for r in intake.read_unseen(spark, out, schema, "late").collect()] == ["10.1/older"]


@pytest.mark.parametrize("per_batch", [1, 3, 1000])
def test_unseen_rows_do_not_depend_on_the_batches(spark, tmp_path, per_batch):
    """Files of many days, out of order, with repeats near and far; undated items among them."""
    path, out, state = (str(tmp_path / n) for n in ("landing", "papers", "state"))
    days = ["2024-01-20", "2024-01-02", "2024-01-09", "bad", "2024-01-11", "2024-01-03", "2024-01-19"]
    arrived, want = [], set()
    for k, day in enumerate(days):
        dois = ["10.1/x", "10.1/x", f"10.1/{k % 2}", f"10.1/n{k % 3}"]
        known = {p.name for p in (tmp_path / "landing").glob("*.parquet")} if k else set()
        land(spark, path, day, dois)
        for file in (tmp_path / "landing").glob("*.parquet"):
            if file.name not in known:
                os.utime(file, (1_700_000_000 + 60 * k,) * 2)
        number = None if day == "bad" else dt.date.fromisoformat(day).toordinal()
        for doi in dois:
            near = any(d == doi and (n is None) == (number is None) and (n is None or abs(n - number) <= 7) for d, n in arrived)
            if not near:
                want.add((doi, None if number is None else day))
            arrived.append((doi, number))
    papers = intake.paper_stream(intake.landing_stream(spark, path, per_batch), "lab")
    intake.run_unseen(papers, out, state, keep=7)
    rows = intake.read_unseen(spark, out, papers.schema).collect()
    got = {(r["DOI"], r["published"] and str(r["published"])) for r in rows}
    assert len(rows) == len(got) and got == want


def test_a_batch_that_is_run_again_overwrites_itself(spark, tmp_path):
    schema = f"DOI STRING, published DATE, row_id BIGINT, arrival {intake.ARRIVAL_KIND}"
    at = (dt.datetime(2024, 1, 1), "f", 0)
    rows = spark.createDataFrame([("a", dt.date(2024, 1, 1), 1, at), ("b", None, 2, at)], schema)
    new, learned = intake.unseen(rows, None, "DOI", "published", 5, batch_id=4)
    assert sorted(r["row_id"] for r in new.collect()) == [1, 2]
    ledger = learned.withColumn("batch", F.lit(4).cast("bigint"))
    again, _ = intake.unseen(rows, ledger, "DOI", "published", 5, batch_id=4)
    later, _ = intake.unseen(rows, ledger, "DOI", "published", 5, batch_id=5)
    assert again.count() == 2 and later.count() == 0


# --- registered queries ----------------------------------------------------------------


def test_entry_returns_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["paper_key", "position", "message"]
    assert df.count() > 0


def test_every_query_has_an_oracle():
    assert set(ORACLE_SQL) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in ("nation supplier orders lineitem events documents pages benchmark labels "
                 "conversations").split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, tables, name):
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(columns).collect()), key=repr)
    result = tables.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    want = sorted((tuple(r[i] for i in places) for r in result.fetchall()), key=repr)
    assert got == want
