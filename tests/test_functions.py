"""Scalar expressions against plain-Python specifications and the fixture tables."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperwire.functions import authors as A
from paperwire.functions import messages as M
from paperwire.functions import text as X


def one(spark, expr, **values):
    columns = [F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("x")]
    return spark.range(1).select(*columns).select(expr.alias("out")).first()["out"]


def label_spec(authors, institutions):
    """The label in words: pairs up to the shorter list, at most three shown."""
    pairs = [f"{a} ({i})" if i else a for a, i in zip(authors, institutions)]
    if len(authors) <= 3 or len(pairs) < 2:
        return ", ".join(pairs)
    return f"{pairs[0]}, {pairs[1]} ... {pairs[-1]}"


def label_frame(spark, cases):
    rows = [(n, a, i) for n, (a, i) in enumerate(cases)]
    return spark.createDataFrame(rows, "n INT, a ARRAY<STRING>, i ARRAY<STRING>")


def labels(spark, cases):
    df = label_frame(spark, cases)
    got = df.select("n", A.author_label(F.col("a"), F.col("i")).alias("label"))
    return [r["label"] for r in got.orderBy("n").collect()]


def test_author_label_fixtures(spark):
    cases = {
        (("A", "B"), ("x", "")): "A (x), B",
        (("A", "B", "C", "D"), ("", "", "", "z")): "A, B ... D (z)",
        (("A", "B", "C"), ("x",)): "A (x)",
        # Fails in the original: four authors, one pair.
        (("A", "B", "C", "D"), ("x",)): "A (x)",
        # The last pair is shown as the last author, as in the original.
        (("A", "B", "C", "D"), ("x", "y")): "A (x), B (y) ... B (y)",
        (("A", "B", "C", "D"), ()): "",
        ((), ()): "",
        (("A",), (None,)): "A",
    }
    assert labels(spark, [(list(a), list(i)) for a, i in cases]) == list(cases.values())


names = st.lists(st.text(alphabet="ABCé ", min_size=1, max_size=4), max_size=6)
places = st.lists(st.text(alphabet="xyz", max_size=3), max_size=7)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(names, places), min_size=20, max_size=40))
def test_author_label_matches_its_specification(spark, cases):
    assert labels(spark, cases) == [label_spec(a, i) for a, i in cases]


def test_strip_removes_what_python_strips(spark):
    blanks = "　 \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0   "
    text = f"{blanks}a{blanks}b​{blanks}"
    assert one(spark, X.strip(F.col("t")), t=text) == text.strip() == f"a{blanks}b​"


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab \n\t　​\x1c", max_size=8), min_size=10, max_size=30))
def test_strip_property(spark, texts):
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n INT, t STRING")
    got = [r["s"] for r in df.select("n", X.strip(F.col("t")).alias("s")).orderBy("n").collect()]
    assert got == [t.strip() for t in texts]


def keyword_spec(term, title, abstract):
    return any(k in (title or "").lower() or k in (abstract or "").lower()
               for k in term.lower().split(" "))


def test_any_keyword(spark):
    rows = [("Lab robots", "x"), ("Other", "AUTOmation"), ("Label text", "x"),
            ("Nothing", "none"), (None, "lab"), ("50% lab_", None), (None, None)]
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "n INT, t STRING, a STRING")
    for term in ("Lab auto", "lab", "Lab  zzz", "", "%", "_", "zzz"):
        hit = X.any_keyword(term, F.col("t"), F.col("a"))
        got = [r["h"] for r in df.select("n", hit.alias("h")).orderBy("n").collect()]
        assert got == [keyword_spec(term, *r) for r in rows], term


def test_phrase_and_all_words(spark):
    assert one(spark, X.phrase("Of The", F.col("t"), F.col("a")), t="x", a="end of the day")
    assert not one(spark, X.phrase("of the", F.col("t"), F.col("a")), t="of", a="the")
    assert one(spark, X.all_words("end Day", F.col("t"), F.col("a")), t="day", a="the end")
    assert not one(spark, X.all_words("end night", F.col("t"), F.col("a")), t="day", a="end")


def test_relevance_counts_occurrences(spark):
    score = X.relevance("ab c", F.col("t"), F.col("a"))
    assert one(spark, score, t="AB ab", a="c abc ccc") == 2 + 1 + 1 + 1 + 3


def test_citation_parts(spark):
    so = "Nature. 2024 Jan;1(1):1-2. doi: 10.1038/s41586-024-1.2. Epub 2024 Jan 1."
    assert one(spark, X.citation_source(F.col("c")), c=so) == "Nature. 2024 Jan;1(1):1-2"
    # The original cuts the DOI at its first dot, leaving 10.
    assert one(spark, X.citation_doi(F.col("c")), c=so) == "10.1038/s41586-024-1.2"
    end = "Cell. 2024. doi: 10.1016/j.cell.2024.01."
    assert one(spark, X.citation_doi(F.col("c")), c=end) == "10.1016/j.cell.2024.01"
    # The original fails without a DOI.
    assert one(spark, X.citation_doi(F.col("c")), c="Cell. 2024.") is None
    assert one(spark, X.citation_source(F.col("c")), c="Cell. 2024.") == "Cell. 2024."


def test_links(spark):
    assert one(spark, X.pubmed_link(F.col("p")), p="7") == "https://pubmed.ncbi.nlm.nih.gov/7/"
    assert one(spark, X.doi_link(F.col("d")), d="10.1/a") == "https://doi.org/10.1/a"
    assert one(spark, X.doi_link(F.lit(None).cast("string"))) is None


def test_split_and_pad(spark):
    names = A.split_authors(F.col("a"))
    assert one(spark, names, a="A, B.; C, D.") == ["A, B.", "C, D."]
    assert one(spark, names, a="") == [""]
    padded = A.last_author_affiliation(names, F.col("i"))
    assert one(spark, padded, a="A, B.; C, D.", i="U") == ["", "U"]
    assert one(spark, padded, a="A", i="U") == ["U"]


def test_header_time_is_nine_hours_ahead(spark):
    ts = M.utc(dt.datetime(2024, 1, 1, 15, 30))
    assert one(spark, M.header_time(ts)) == "2024/01/02 00:30"


def test_message_texts(spark):
    head = M.header(M.utc(dt.datetime(2024, 1, 1, 15, 30)), F.lit("bioRxiv"), F.lit(1), F.lit(2))
    fields = (head, F.lit("T"), F.lit("https://doi.org/10.1/a"), F.lit("A (x)"), F.lit("k1, k2"))
    h = "2024/01/02 00:30 | bioRxiv | 1/2"
    expected = {
        "teams": f"**{h}** <br> **[T](https://doi.org/10.1/a)** <br> A (x) <br><br> "
        "k1, k2 <br><br> ",
        "line": f"{h}\nT\nhttps://doi.org/10.1/a\nA (x)\n\nk1, k2",
        "slack": f"*{h}*\n\n <https://doi.org/10.1/a|*T*>\n A (x) \n\n k1, k2",
        "discord": f"**{h}**\r**[T](<https://doi.org/10.1/a>)**\rA (x)\r\rk1, k2\r\r​",
    }
    for channel, text in expected.items():
        assert one(spark, M.message(channel, *fields)) == text, channel
    slack = one(spark, M.payload("slack", M.message("slack", *fields)))
    import json

    assert json.loads(slack) == {"text": expected["slack"]}
