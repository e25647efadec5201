"""Hand-written records of every source and the Paper rows they must give."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from paperwire.plans import digest as G
from paperwire.schema import LANDING, JobConfig
from paperwire.sources import atom, corpus, landing, medline
from paperwire.sources.account import Account

RUN = dt.date(2024, 1, 11)
END, START = "2024-01-10", "2024-01-09"

MEDLINE = """
PMID- 100
TI  - A long title that
      wraps here
AB  - Automation abstract.
FAU - Doe, Jane
AU  - Doe J
AU  - Roe R
AD  - Inst A
AD  - Inst B
EDAT- 2024/01/10 06:00
LR  - 20240109
DP  - 2024 Jan 8
SO  - Nature. 2024 Jan;1(1):1-2. doi: 10.1038/s41586-024-1.2. Epub 2024 Jan 1.

PMID- 101
TI  - No abstract
AU  - Poe P
AD  - Inst C
EDAT- 2024/01/01 06:00
SO  - Cell. 2024. doi: 10.1016/j.cell.2024.01.

PMID- 102
TI  - No address, no DOI
AU  - Poe P
AU  - Quo Q
SO  - Cell. 2024.

PMID- 103

"""


@pytest.fixture
def records(spark, tmp_path):
    path = tmp_path / "pubmed.txt"
    path.write_text(MEDLINE)
    return medline.read_medline(spark, str(path))


def by(df, key):
    return {r[key]: r for r in df.collect()}


def test_medline_records_to_papers(records):
    papers = by(medline.medline_papers(records), "PMID")
    assert sorted(papers) == ["100", "101", "102", "103"]
    full = papers["100"]
    assert full["Title"] == "A long title that wraps here"
    assert full["Authors"] == ["Doe J", "Roe R"]
    assert full["Affiliation"] == ["Inst A", "Inst B"]
    assert full["Source"] == "Nature. 2024 Jan;1(1):1-2"
    assert full["DOI"] == "10.1038/s41586-024-1.2"
    assert full["paperLink"] == "https://pubmed.ncbi.nlm.nih.gov/100/"
    assert full["published"] == dt.date(2024, 1, 10)
    assert (full["source_kind"], full["source_rank"], full["source_seq"]) == ("pubmed", 0, -100)
    assert papers["101"]["Abstract"] == ""
    assert papers["101"]["DOI"] == "10.1016/j.cell.2024.01"
    assert papers["102"]["DOI"] is None
    assert papers["102"]["Affiliation"] == ["", ""]
    # Only a missing abstract survives in the original.
    bare = papers["103"]
    assert (bare["Title"], bare["Authors"], bare["Affiliation"], bare["Source"]) == ("", [], [], "")


def test_medline_file_is_one_record_per_row_whatever_the_splits(spark, tmp_path):
    path = tmp_path / "many.txt"
    record = (
        "PMID- {n}\nTI  - Title {n}\nAB  - line one\n      line two {n}\nSO  - J. doi: 10.1/{n}."
    )
    path.write_text("\n\n".join(record.format(n=n) for n in range(500)) + "\n\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = medline.read_medline(spark, str(path))
        assert got.rdd.getNumPartitions() > 4
        rows = by(got, "PMID")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 500
    assert rows["123"]["AB"] == "line one line two 123"


def test_search_by_date_type(records):
    def ids(term, kind, days):
        found = medline.search_ids(records, term, kind, days, RUN)
        return sorted(r["id"] for r in found.collect())

    assert ids("automation", "edat", 1) == ["100"]
    assert ids("automation", "mdat", 1) == []
    assert ids("automation", "mdat", 2) == ["100"]
    assert ids("automation", "pdat", 2) == []
    assert ids("automation", "pdat", 3) == ["100"]
    assert ids("abstract", "edat", 30) == ["100", "101"]
    assert ids("abstract title", "edat", 30) == ["100"]


def test_one_record_per_id(spark, records):
    copies = records.union(records).union(records.withColumn("mdat", F.lit(None).cast("date")))
    ids = spark.createDataFrame([("100",), ("101",)], "id STRING")
    got = {r["PMID"]: r["mdat"] for r in medline.fetch_by_id(copies, ids).collect()}
    assert got == {"100": dt.date(2024, 1, 9), "101": None}
    assert medline.search(copies, "abstract", "edat", 30, RUN).count() == 2


def test_fetch_by_id(spark, records):
    ids = spark.createDataFrame([("100",), ("999",), ("100",)], "id STRING")
    assert [r["PMID"] for r in medline.fetch_by_id(records, ids).collect()] == ["100"]


ATOM = """<?xml version="1.0" encoding="UTF-8"?>
<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom">
  <title>search</title>
  <entry>
    <id>http://arxiv.org/abs/1</id><published>2024-01-08T10:00:00Z</published>
    <title>Lab robots
      at &lt;work&gt;</title>
    <summary>robots in a lab, lab</summary>
    <author><name>Ann A</name></author><author><name>Bob B</name></author>
    <arxiv:doi>10.1/x</arxiv:doi>
    <link href="http://arxiv.org/abs/1" rel="alternate"/>
    <link href="http://arxiv.org/pdf/1" rel="related"/>
  </entry>
  <entry>
    <id>http://arxiv.org/abs/2</id><published>2024-01-09T10:00:00Z</published>
    <title>Lab robots again</title><summary>lab lab lab lab robots</summary>
    <author><name>Cy C</name></author>
    <link href="http://arxiv.org/abs/2" rel="alternate"/>
  </entry>
  <entry>
    <id>http://arxiv.org/abs/3</id><published>2024-01-08T23:59:59Z</published>
    <title>Lab lab lab</title><summary>robots, lab, lab</summary>
    <author><name>Di D</name></author>
    <link href="http://arxiv.org/abs/3" rel="alternate"/>
  </entry>
</feed>
"""


@pytest.fixture(params=["file", "landed"])
def entries(request, spark, tmp_path):
    if request.param == "file":
        path = tmp_path / "feed.xml"
        path.write_text(ATOM)
        return atom.read_atom(spark, str(path))
    return atom.scan_arxiv(replies(spark, [("arxiv", "q", 0, "u", 200, ATOM)]))


def test_atom_entries_to_papers(entries):
    papers = by(atom.atom_columns(entries), "id")
    one, two = papers["http://arxiv.org/abs/1"], papers["http://arxiv.org/abs/2"]
    assert one["Title"] == "Lab robots at <work>"
    assert one["Authors"] == ["Ann A", "Bob B"]
    assert one["Affiliation"] == ["", ""]
    assert (one["Source"], one["PMID"], one["DOI"]) == ("arXiv", "", "10.1/x")
    assert one["paperLink"] == "http://arxiv.org/abs/1"
    assert two["DOI"] is None


def test_arxiv_window_and_ranking(entries):
    def found(**options):
        papers = atom.arxiv_papers(entries, "lab robots", RUN, 3, **options)
        return [r["paperLink"][-1] for r in papers.orderBy("source_seq").collect()]

    assert found() == ["3", "1"]
    assert found(include_upper=True) == ["2", "3", "1"]
    assert found(include_upper=True, top=1) == ["2"]


def replies(spark, rows):
    fetched = dt.datetime(2024, 1, 11)
    return spark.createDataFrame([(*r, fetched) for r in rows], LANDING)


def biorxiv_item(doi, title, abstract, authors, inst, date):
    return dict(doi=doi, title=title, abstract=abstract, authors=authors,
                author_corresponding_institution=inst, date=date)


BIORXIV = [
    biorxiv_item("10.1/a", "Lab robots", "x", "A, B.; C, D.", "U", END),
    biorxiv_item("10.1/b", "Other", "AUTOmation", "E, F.", "V", END),
    biorxiv_item("10.1/c", "Label text", "x", "G, H.", "W", END),
    biorxiv_item("10.1/d", "Lab again", "x", "I, J.", "X", START),
    biorxiv_item("10.1/d", "Lab again", "x", "I, J.", "X", END),
    biorxiv_item("10.1/e", "Nothing", "none", "K, L.", "Y", END),
    biorxiv_item("10.1/a", "Lab robots v2", "x", "A, B.; C, D.", "U", END),
    biorxiv_item(None, "Lab null", None, "M, N.", "Z", END),
]


def biorxiv(spark, items, term):
    body = json.dumps({"collection": items})
    landed = replies(spark, [("biorxiv", "q", 0, "u", 200, body)])
    return landing.biorxiv_papers(landing.scan_biorxiv(landed), term, RUN, 1)


def test_biorxiv_day(spark):
    papers = biorxiv(spark, BIORXIV, "Lab auto").orderBy("source_seq").collect()
    assert [p["Title"] for p in papers] == [
        "Lab robots", "Other", "Label text", "Lab robots v2", "Lab null",
    ]
    first, last = papers[0], papers[-1]
    assert first["Authors"] == ["A, B.", "C, D."] and first["Affiliation"] == ["", "U"]
    assert first["paperLink"] == "https://doi.org/10.1/a"
    assert (last["DOI"], last["paperLink"], last["Abstract"]) == (None, None, "")
    assert len({p["paper_key"] for p in papers}) == 5


def test_biorxiv_empty_keyword_matches_all_new_rows(spark):
    assert biorxiv(spark, BIORXIV, "Lab  zzz").count() == 6


def test_biorxiv_null_doi_the_day_before_removes_null_dois(spark):
    null_before = biorxiv_item(None, "Lab old", "x", "M, N.", "Z", START)
    titles = [p["Title"] for p in biorxiv(spark, [*BIORXIV, null_before], "Lab auto").collect()]
    assert "Lab null" not in titles and len(titles) == 4


def test_biorxiv_day_without_broadcast(spark, no_broadcast):
    assert biorxiv(spark, BIORXIV, "Lab auto").count() == 5


CHEMRXIV = {
    "itemHits": [
        {"item": {
            "title": "On the bench", "abstract": "x", "doi": "10.2/a", "publishedDate": END,
            "authors": [
                {"firstName": "F", "lastName": "L",
                 "institutions": [{"name": "U"}, {"name": "V"}]},
                {"firstName": "G", "lastName": "M", "institutions": []},
                {"firstName": "H", "lastName": "N", "institutions": None},
            ]}},
        {"item": {"title": "Bench on", "abstract": "ON THE way", "doi": None,
                  "publishedDate": f"{END}T23:00:00Z", "authors": []}},
        {"item": {"title": "On the day before", "abstract": "x", "doi": "10.2/c",
                  "publishedDate": START, "authors": []}},
    ]
}


def test_chemrxiv_day(spark):
    landed = replies(spark, [("chemrxiv", "q", 0, "u", 200, json.dumps(CHEMRXIV))])
    items = landing.scan_chemrxiv(landed)
    papers = landing.chemrxiv_papers(items, "on the", RUN, 1).orderBy("source_seq").collect()
    assert [p["Title"] for p in papers] == ["On the bench", "Bench on"]
    assert papers[0]["Authors"] == ["F L", "G M", "H N"]
    assert papers[0]["Affiliation"] == ["U", "", ""]
    assert papers[0]["paperLink"] == "https://doi.org/10.2/a"
    assert papers[1]["paperLink"] is None
    limited = landing.chemrxiv_papers(items, "on the", RUN, 1, limit=1).collect()
    assert [p["Title"] for p in limited] == ["On the bench"]


def test_status_guard_and_rejects(spark):
    body = json.dumps({"collection": BIORXIV})
    landed = replies(spark, [
        ("biorxiv", "q", 0, "u", 200, body),
        ("biorxiv", "q", 100, "v", 500, body),
        ("biorxiv", "q", 200, "w", None, body),
        ("chemrxiv", "q", 0, "x", 404, "{}"),
    ])
    assert landing.scan_biorxiv(landed).count() == len(BIORXIV)
    got = {(r["source"], r["status"]): r["replies"] for r in landing.rejects(landed).collect()}
    assert got == {("biorxiv", 500): 1, ("biorxiv", None): 1, ("chemrxiv", 404): 1}


def test_page_limit(spark):
    body = json.dumps({"collection": BIORXIV[:2]})
    landed = replies(spark, [
        ("biorxiv", "q", 0, "u", 200, body), ("biorxiv", "q", 100, "v", 200, body),
        ("biorxiv", "r", 100, "w", 200, body),
    ])
    def cursors(limit):
        pages = landing.first_pages(landed, limit).collect()
        return sorted((p["query_key"], p["cursor"]) for p in pages)

    assert cursors(1) == [("q", 0), ("r", 100)]
    assert cursors(None) == [("q", 0), ("q", 100), ("r", 100)]
    places = landing.scan_biorxiv(landed).where(F.col("source_seq") >= 100)
    assert sorted(r["source_seq"] for r in places.collect()) == [100, 100, 101, 101]


def test_landed_since_keeps_every_reply_that_may_matter(spark):
    rows = [("biorxiv", "q", n, "u", 200, "{}", t) for n, t in enumerate([
        dt.datetime(2024, 1, 7, 23), dt.datetime(2024, 1, 8), dt.datetime(2024, 1, 12), None])]
    landed = spark.createDataFrame(rows, LANDING)
    kept = landing.landed_since(landed, dt.date(2024, 1, 9)).collect()
    assert sorted(r["cursor"] for r in kept) == [1, 2, 3]


def landed_rows(spark, rows):
    return spark.createDataFrame(rows, LANDING)


def test_one_good_reply_per_page(spark):
    at = [dt.datetime(2024, 1, 11, h) for h in range(6)]
    rows = [
        ("biorxiv", "q", 0, "a", 503, "", at[0]), ("biorxiv", "q", 0, "b", 200, "first", at[1]),
        ("biorxiv", "q", 0, "c", 200, "second", at[2]), ("biorxiv", "q", 0, "d", 500, "", at[3]),
        ("biorxiv", "q", 100, "e", 503, "", at[0]),
        ("biorxiv", "q", 200, "f", 200, "third", at[1]), ("biorxiv", "r", 0, "g", 200, "other", None),
        ("biorxiv", "q", 0, "h", 200, "later", at[5]),
    ]
    landed = landing.landed_until(landed_rows(spark, rows), at[4])
    account = Account()

    def urls(limit, account=None):
        return sorted(r["url"] for r in landing.current_pages(landed, limit, account).collect())

    assert urls(None) == ["c", "f", "g"]
    assert urls(1, account) == ["c", "g"]  # a failure is no page
    assert {k[2]: n for k, n in account.sums().items() if n} == {
        "status 503": 2, "status 500": 1, "superseded": 1, "page limit": 1}
    assert [r["url"] for r in landing.first_pages(landed_rows(spark, rows[:2]), 1).collect()] == ["b"]


def test_account_of_a_run_adds_up(spark, tmp_path):
    day = dt.datetime(2024, 1, 11)
    bodies = [json.dumps({"collection": BIORXIV}), "not json", '{"messages": []}', None,
              json.dumps({"collection": [biorxiv_item("10.1/u", "Lab", "x", "A", "U", "soon")]}),
              json.dumps({"collection": [biorxiv_item("10.1/o", "Lab", "x", "A", "U", "2023-12-01")]})]
    rows = [("biorxiv", "q", n * 100, "u", 200, b, day) for n, b in enumerate(bodies)]
    rows += [("biorxiv", "q", 0, "u", 404, "", day), ("chemrxiv", "q", 0, "u", 200, json.dumps(CHEMRXIV), day),
             ("arxiv", "q", 0, "u", 200, ATOM, day), ("arxiv", "q", 1, "u", 200, "<feed", day)]
    landed = G.Landed(replies=landed_rows(spark, rows))
    config = JobConfig(term="lab robots", term_biorxiv="Lab auto", term_chemrxiv="on the", chemrxiv_limit=1, arxiv_top=1,
                       run_ts=dt.datetime(2024, 1, 11, 15), sources=("biorxiv", "chemrxiv", "arxiv"))
    account = Account()
    papers = G.land_papers(G.select_papers(landed, config, account))
    sums = {k: n for k, n in G.settled(account).items() if n}
    assert sums == {
        ("biorxiv", "reply", "used"): 3, ("biorxiv", "reply", "unreadable"): 2, ("biorxiv", "reply", "no list"): 1,
        ("biorxiv", "reply", "status 404"): 1,
        ("biorxiv", "item", "used"): 5, ("biorxiv", "item", "seen the day before"): 1, ("biorxiv", "item", "no hit"): 1,
        ("biorxiv", "item", "other day"): 2, ("biorxiv", "item", "undated"): 1,
        ("chemrxiv", "reply", "used"): 1, ("chemrxiv", "item", "used"): 1, ("chemrxiv", "item", "cap"): 1,
        ("chemrxiv", "item", "other day"): 1,
        ("arxiv", "reply", "used"): 1, ("arxiv", "reply", "unreadable"): 1, ("arxiv", "item", "used"): 1,
        ("arxiv", "item", "cap"): 1, ("arxiv", "item", "other day"): 1,
    }
    assert papers.count() == 7


@pytest.mark.parametrize("bodies", [[], [json.dumps({"collection": []})], [json.dumps({"collection": [BIORXIV[3]]})]])
def test_account_of_a_day_without_papers(spark, no_broadcast, bodies):
    """Nothing landed, nothing listed, nothing of the day: the run ends and all counts are there."""
    rows = [("biorxiv", "q", n, "u", 200, b, dt.datetime(2024, 1, 11)) for n, b in enumerate(bodies)]
    landed = G.Landed(replies=landed_rows(spark, rows))
    config = JobConfig(term="lab", term_biorxiv="Lab", term_chemrxiv="on", run_ts=dt.datetime(2024, 1, 11, 15),
                       sources=("biorxiv", "chemrxiv", "arxiv"))
    account = Account()
    papers = G.land_papers(G.select_papers(landed, config, account))
    sums = {k: n for k, n in G.settled(account).items() if n}
    assert papers.count() == 0
    assert sums == ({("biorxiv", "reply", "used"): 1} if bodies else {}) | (
        {("biorxiv", "item", "other day"): 1} if bodies and "10.1/d" in bodies[0] else {})


def test_the_map_of_a_reply_prunes_before_the_parse(spark, tmp_path, plan):
    def body(*days):
        return json.dumps({"collection": [biorxiv_item(f"10.1/{d}", "Lab", "x", "A", "U", d) for d in days]})

    at = dt.datetime(2024, 1, 11)
    texts = [body("2024-01-01"), body(END, "2024-01-01"), body("undated"), body(), "no json", body(START)]
    rows = [("biorxiv", "q", n, "u", 200, t, at) for n, t in enumerate(texts)]
    rows += [("chemrxiv", "q", 0, "u", 200, json.dumps(CHEMRXIV), at), ("arxiv", "q", 0, "u", 200, ATOM, at)]
    path = str(tmp_path / "landing")
    landing.land(landed_rows(spark, rows), path)
    landed = landing.read_landing(spark, path)
    day = dt.date(2024, 1, 10)
    kept = landing.due(landed, "biorxiv", day, day, dt.datetime(2024, 1, 12))
    assert sorted(r["cursor"] for r in kept.collect()) == [1, 2, 3, 4]
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    scan = plan(landing.scan_biorxiv(kept))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = scan.split("PushedFilters")[1]
    assert "last_day" in pushed and "fetched" in pushed
    arxiv = [landing.due(landed, "arxiv", d, d, dt.datetime(2024, 1, 12)).count() for d in (dt.date(2024, 1, 8), day)]
    assert arxiv == [1, 0]
    old = landing.holding(landed_rows(spark, rows), day, day)
    assert old.count() == len(rows)  # landed without a map


def test_bodies_are_parsed_once(spark, tmp_path, plan, no_broadcast):
    path = str(tmp_path / "landing")
    replies(spark, [("biorxiv", "q", 0, "u", 200, json.dumps({"collection": BIORXIV}))]).write.parquet(path)
    items = landing.scan_biorxiv(landing.read_landing(spark, path))
    papers = landing.biorxiv_papers(items, "Lab auto", RUN, 1)
    assert "from_json" not in plan(papers)  # the two days have been written
    assert papers.count() == 5


def test_names_of_one_part(spark):
    hit = {"item": {"title": "On the", "abstract": "x", "doi": "d", "publishedDate": END, "authors": [
        {"firstName": None, "lastName": "L", "institutions": []}, {"firstName": "F", "lastName": None}]}}
    landed = replies(spark, [("chemrxiv", "q", 0, "u", 200, json.dumps({"itemHits": [hit]}))])
    papers = landing.chemrxiv_papers(landing.scan_chemrxiv(landed), "on the", RUN, 1)
    assert papers.first()["Authors"] == ["L", "F"]


def test_publication_dates_without_a_day(spark, tmp_path):
    path = tmp_path / "dates.txt"
    dates = ["2024 Jan 8", "2024 Jan 18", "2024 Jan", "2024", "2024 Jan-Feb", "2024 Spring", "soon"]
    path.write_text("\n\n".join(f"PMID- {n}\nTI  - T\nDP  - {d}" for n, d in enumerate(dates)))
    got = {r["PMID"]: r["pdat"] and str(r["pdat"]) for r in medline.read_medline(spark, str(path)).collect()}
    assert [got[str(n)] for n in range(7)] == [
        "2024-01-08", "2024-01-18", "2024-01-01", "2024-01-01", "2024-01-01", "2024-01-01", None]


def test_a_superseded_version_is_not_found(spark):
    day = dt.date(2024, 1, 10)
    rows = [("1", "lab robots", day, dt.date(2024, 1, 9)), ("1", "retracted", day, day), ("2", "lab robots", day, None),
            ("3", "lab robots", dt.date(2024, 3, 10), None)]
    records = spark.createDataFrame(rows, "PMID STRING, TI STRING, edat DATE, mdat DATE").withColumn("AB", F.lit(""))
    found = medline.search(records, "lab", "edat", 1, RUN)
    assert [r["PMID"] for r in found.collect()] == ["2"]  # nor one dated after the run


@pytest.fixture
def corpus_table(spark, tmp_path):
    name = f"corpus_{tmp_path.name.replace('-', '_')}"
    corpus.open_corpus(spark, name, str(tmp_path / "corpus"), 4)
    yield name
    spark.sql(f"DROP TABLE {name}")


def test_corpus_is_kept_current(spark, corpus_table, plan, no_broadcast, tmp_path):
    def batch(*rows):
        corpus.upsert(spark, corpus_table, spark.createDataFrame(rows, "PMID STRING, TI STRING, edat DATE, mdat DATE"), 4)

    def stored():
        return sorted((r["PMID"], r["TI"], r["edat"] and r["edat"].day) for r in corpus.read_corpus(spark, corpus_table).collect())

    d = dt.date
    batch(("1", "a", d(2024, 1, 1), d(2024, 1, 1)), ("2", "b", d(2024, 1, 1), None), ("3", "c", d(2024, 1, 2), d(2024, 1, 5)),
          (None, "x", d(2024, 1, 9), None), ("4", "n", None, None), ("1", "old a", d(2024, 1, 1), None))
    assert stored() == [("1", "a", 1), ("2", "b", 1), ("3", "c", 2), ("4", "n", None)]
    batch(("1", "a2", d(2024, 1, 3), d(2024, 1, 2)), ("3", "stale", d(2024, 1, 2), d(2024, 1, 4)), ("4", "m", d(2024, 1, 3), None))
    batch(("2", "b2", d(2024, 1, 3), None))
    now = [("1", "a2", 3), ("2", "b2", 3), ("3", "c", 2), ("4", "m", 3)]
    assert stored() == now  # the first day is empty now
    spark.sql(f"DROP TABLE {corpus_table}")
    corpus.open_corpus(spark, corpus_table, str(tmp_path / "corpus"), 4)
    assert stored() == now
    records = corpus.read_corpus(spark, corpus_table)
    ids = spark.createDataFrame([("1",), ("3",), ("9",), ("3",)], "id STRING")
    found = medline.fetch_by_id(records, ids, current=True)
    assert sorted(r["TI"] for r in found.collect()) == ["a2", "c"]
    left = plan(found).split("Exchange")[0]
    assert "Bucketed: true" in left  # the corpus comes before the only exchange, that of the ids
    assert plan(found).count("Exchange") <= 3
    searched = medline.search(records, "a2", "edat", 9, RUN, current=True)
    assert "Exchange" not in plan(searched) and "edat" in plan(searched).split("PartitionFilters")[1]
    got = medline.fetch_by_id(records, medline.search_ids(records, "b2", "edat", 9, RUN, current=True), current=True)
    assert [r["PMID"] for r in got.collect()] == ["2"]


def test_a_batch_is_written_once_beside_the_corpus(spark, corpus_table, no_broadcast, monkeypatch):
    """Of whole records only those of the batch that stay are written apart, whatever is stored."""
    written = {}
    write = corpus.write_once

    def counted(rows, name):
        made = write(rows, name)
        written[name] = made.count()
        return made

    monkeypatch.setattr(corpus, "write_once", counted)
    day = dt.date(2024, 1, 1)
    for batch in ([(str(n), "a", day, None) for n in range(30)], [("3", "b", day, day), ("3", "c", day, None), ("40", "d", day, None)]):
        corpus.upsert(spark, corpus_table, spark.createDataFrame(batch, "PMID STRING, TI STRING, edat DATE, mdat DATE"), 4)
    assert written == {"fresh": 2, "days": 1}
    stored = {r["PMID"]: r["TI"] for r in corpus.read_corpus(spark, corpus_table).collect()}
    assert stored == {str(n): "a" for n in range(30)} | {"3": "b", "40": "d"}
