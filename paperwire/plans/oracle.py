"""The registered queries in DuckDB's SQL, written from their definitions.

Shared pieces are common table expressions, joined into one statement per query.
"""

from __future__ import annotations

from paperwire import constants as K

TERM_1, TERM_2 = "lytion", "eauou"


def text(value: str) -> str:
    """A string as a SQL expression, with control and invisible characters by code."""
    pieces: list[str] = []
    plain = ""
    for c in value:
        if c in "\n\r\t​　":
            if plain:
                pieces.append("'" + plain.replace("'", "''") + "'")
            pieces.append(f"chr({ord(c)})")
            plain = ""
        else:
            plain += c
    if plain or not pieces:
        pieces.append("'" + plain.replace("'", "''") + "'")
    return "(" + " || ".join(pieces) + ")"


# Documents as papers.
DOCS = """
docs AS (
  SELECT doc_id, 'doc:' || doc_id AS paper_key,
         CAST(regexp_extract(source, '([0-9]+)', 1) AS INTEGER) AS source_rank,
         'Document ' || doc_id || ' (' || lang || ')' AS title, source, text AS abstract,
         '10.5555/' || doc_id AS doi, 'https://doi.org/10.5555/' || doc_id AS link
  FROM documents)"""

# Position and total in digest order.
NUMBERED = """
numbered AS (
  SELECT *, row_number() OVER (ORDER BY source_rank, doc_id) AS position,
         count(*) OVER () AS total
  FROM docs)"""

# The longest word of each benchmark text, of every fifth also two letters.
SUBSCRIPTIONS = """
pieces AS (
  SELECT item_id, list_max(list_transform(str_split(text, ' '), lambda w: {'n': length(w), 'w': w})).w AS word
  FROM benchmark),
wanted AS (
  SELECT item_id, lower(word) AS keyword FROM pieces
  UNION SELECT item_id, lower(substr(word, 1, 2)) FROM pieces WHERE item_id % 5 = 0)"""

# One author per line item; the label shows three at most.
AUTHOR_LABELS = """
author_rows AS (
  SELECT l_orderkey,
         CASE WHEN l_returnflag = 'N' THEN s_name
              ELSE s_name || ' (' || n_name || ')' END AS named,
         row_number() OVER (
           PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, s_name,
           CASE WHEN l_returnflag = 'N' THEN '' ELSE n_name END) AS place,
         count(*) OVER (PARTITION BY l_orderkey) AS authors
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
author_labels AS (
  SELECT l_orderkey, authors,
         CASE WHEN authors <= 3 THEN string_agg(named, ', ' ORDER BY place)
              ELSE max(CASE WHEN place = 1 THEN named END) || ', ' ||
                   max(CASE WHEN place = 2 THEN named END) || ' ... ' ||
                   max(CASE WHEN place = authors THEN named END) END AS author_label
  FROM author_rows GROUP BY l_orderkey, authors)"""

LABELLED = """
ready AS (
  SELECT n.doc_id, n.paper_key, n.position, n.total, n.title, n.link,
         coalesce(a.author_label, '') AS label,
         coalesce('quality ' || l.quality || ', toxic ' || l.toxic, '') AS summary,
         '2024/01/12 00:30 | ' || n.source || ' | ' || n.position || '/' || n.total AS head
  FROM numbered n LEFT JOIN author_labels a ON a.l_orderkey = n.doc_id
  LEFT JOIN labels l ON l.doc_id = n.doc_id)"""

TEAMS = (
    "'**' || head || '** <br> **[' || title || '](' || link || ')** <br> ' || label"
    " || ' <br><br> ' || summary || ' <br><br> '"
)
LINE = (
    "head || chr(10) || title || chr(10) || link || chr(10) || label || chr(10) || chr(10)"
    " || summary"
)
SLACK = (
    "'*' || head || '*' || chr(10) || chr(10) || ' <' || link || '|*' || title || '*>' || chr(10)"
    " || ' ' || label || ' ' || chr(10) || chr(10) || ' ' || summary"
)
DISCORD = (
    "'**' || head || '**' || chr(13) || '**[' || title || '](<' || link || '>)**' || chr(13)"
    " || label || chr(13) || chr(13) || summary || chr(13) || chr(13) || chr(8203)"
)
TEXTS = {"teams": TEAMS, "line": LINE, "slack": SLACK, "discord": DISCORD}


def with_(*parts: str) -> str:
    return "WITH " + ",".join(parts)


READY = with_(DOCS, NUMBERED, AUTHOR_LABELS, LABELLED)


def slack_json(message: str) -> str:
    return f"CAST(json_object('text', {message}) AS VARCHAR)"


def message(channel: str) -> str:
    payload = slack_json("message") if channel == "slack" else "message"
    return f"""
{READY}, told AS (SELECT doc_id, {TEXTS[channel]} AS message FROM ready)
SELECT doc_id, message, {payload} AS payload FROM told"""


def fan_out(channels: tuple[str, ...], source: str = "ready") -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS channel, paper_key, position, total, title, {TEXTS[c]} AS message, "
        + (f"'{K.DISCORD_USERNAME}'" if c == "discord" else "CAST(NULL AS VARCHAR)")
        + f" AS username FROM {source}"
        for c in channels
    )


OUTBOX = (
    "SELECT channel, paper_key, position, total, title, message, "
    f"CASE WHEN channel = 'slack' THEN {slack_json('message')} ELSE message END AS payload, "
    "username FROM posts"
)

# Events as landed replies; only those with status 200 give an item.
ITEMS = """
items AS (
  SELECT event_id AS source_seq, '10.5555/u' || user_id AS doi, event_type AS title,
         props AS abstract, user_id, CAST(ts AS DATE) AS published
  FROM events WHERE event_type NOT IN ('error', 'signup'))"""


# Events as replies that fail, are landed twice or late; of each page the last good reply up to the run.
UNEVEN = r"""
made AS (
  SELECT event_id, user_id, event_type, props, event_id % 50 AS bad, ts AS fetched,
         CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 404 ELSE 200 END AS status,
         CASE WHEN event_id % 50 = 7 THEN '<html>busy</html>'
              WHEN event_id % 50 = 8 THEN '{"messages":[{"status":"no posts found"}]}'
              ELSE CAST(json_object('collection', [json_object(
                'doi', '10.5555/u' || user_id, 'title', event_type, 'abstract', props,
                'authors', 'Ab, ' || event_id || '.; Cd, ' || user_id || '.',
                'author_corresponding_institution', 'Inst ' || user_id,
                'date', strftime(ts, '%Y-%m-%d'))]) AS VARCHAR) END AS whole
  FROM events),
bodies AS (
  SELECT *, CASE WHEN bad = 9 THEN regexp_replace(whole, ',"date":"[^"]*"', '') ELSE whole END AS body
  FROM made),
landed AS (
  SELECT * FROM (
    SELECT *, fetched AS fetched_at FROM bodies
    UNION ALL SELECT * REPLACE (503 AS status, '' AS body), fetched - INTERVAL 1 HOUR FROM bodies
      WHERE event_id % 20 = 4
    UNION ALL SELECT *, fetched + INTERVAL 1 HOUR FROM bodies WHERE event_id % 20 = 5)
  WHERE fetched_at <= TIMESTAMP '2024-01-11 15:30:00'),
current AS (
  SELECT * FROM landed WHERE status = 200
  QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY fetched_at DESC) = 1)"""


def biorxiv(where: str) -> str:
    """Items as papers."""
    return f"""
SELECT 'biorxiv:' || doi || ':' || source_seq AS paper_key, 'biorxiv' AS source_kind,
       CAST(1 AS BIGINT) AS source_rank, source_seq, title AS "Title",
       'Ab, ' || source_seq || '.|Cd, ' || user_id || '.' AS "Authors", 'bioRxiv' AS "Source",
       abstract AS "Abstract", '' AS "PMID", '|Inst ' || user_id AS "Affiliation", doi AS "DOI",
       'https://doi.org/' || doi AS "paperLink"
FROM items WHERE {where}"""


NEW_ITEMS = """published = DATE '2024-01-10'
  AND doi NOT IN (SELECT doi FROM items WHERE published = DATE '2024-01-09')"""
CLICK_VIEW = """(contains(lower(title), 'click') OR contains(lower(abstract), 'click')
  OR contains(lower(title), 'vie') OR contains(lower(abstract), 'vie'))"""

# Documents as chemRxiv items.
CHEM = """
SELECT 'chemrxiv:10.5555/' || doc_id || ':' || doc_id AS paper_key, 'chemrxiv' AS source_kind,
       CAST(2 AS BIGINT) AS source_rank, doc_id AS source_seq,
       'Document ' || doc_id || ' (' || lang || ')' AS "Title", 'Doc ' || doc_id AS "Authors",
       'chemRxiv' AS "Source", text AS "Abstract", '' AS "PMID",
       CASE WHEN lang = 'en' THEN source ELSE '' END AS "Affiliation",
       '10.5555/' || doc_id AS "DOI", 'https://doi.org/10.5555/' || doc_id AS "paperLink"
FROM """
CHEM_50 = (
    CHEM
    + """(SELECT * FROM documents
  WHERE contains(lower(text), 'of the')
     OR contains(lower('Document ' || doc_id || ' (' || lang || ')'), 'of the')
  ORDER BY doc_id LIMIT 50)"""
)


def medline(abstract: str) -> str:
    """Documents as PubMed papers."""
    return f"""
SELECT 'pubmed:' || CASE WHEN lang = 'fr' THEN CAST(doc_id AS VARCHAR)
         ELSE '10.5555/' || source || '.' || doc_id END || ':' || (-doc_id) AS paper_key,
       'pubmed' AS source_kind, CAST(0 AS BIGINT) AS source_rank, -doc_id AS source_seq,
       'Document ' || doc_id || ' (' || lang || ')' AS "Title",
       source || ' A|' || lang || ' B' AS "Authors",
       CASE WHEN lang = 'fr' THEN 'Journal of ' || source || '. 2024.'
            ELSE 'Journal of ' || source || '. 2024;1(' || doc_id || '):1-9' END AS "Source",
       {abstract} AS "Abstract", CAST(doc_id AS VARCHAR) AS "PMID",
       CASE WHEN lang = 'en' THEN 'Inst ' || source || '|Inst ' || lang ELSE '|' END
         AS "Affiliation",
       CASE WHEN lang = 'fr' THEN NULL ELSE '10.5555/' || source || '.' || doc_id END AS "DOI",
       'https://pubmed.ncbi.nlm.nih.gov/' || doc_id || '/' AS "paperLink"
FROM documents"""


UNFOLDED = r"regexp_replace(trim(text), '\s*\n\s*', ' ', 'g')"

# Turns of conversations as Atom entries.
TURNS = """
turns AS (
  SELECT 'http://example.org/abs/' || conv_id || '.' || turn AS id, '2024-01-08' AS day,
         role || ' turn ' || conv_id || '.' || turn AS title, text AS abstract,
         'Author ' || conv_id || '|Author ' || role AS authors,
         CASE WHEN role = 'user' THEN '10.5555/t' || conv_id || '.' || turn END AS doi
  FROM conversations)"""


def hits(column: str, word: str) -> str:
    without = f"length(replace({column}, '{word}', ''))"
    return f"CAST((length({column}) - {without}) / {len(word)} AS BIGINT)"


BEST = f"""
scored AS (SELECT *, lower(title || chr(10) || abstract) AS whole FROM turns),
best AS (
  SELECT *, row_number() OVER (
    ORDER BY {hits("whole", "tion")} + {hits("whole", "the")} DESC, id) AS place
  FROM scored WHERE contains(whole, 'tion') AND contains(whole, 'the'))"""
ARXIV_10 = """
SELECT 'arxiv:' || coalesce(doi, id) || ':' || place AS paper_key, 'arxiv' AS source_kind,
       CAST(3 AS BIGINT) AS source_rank, place AS source_seq, title AS "Title",
       authors AS "Authors", 'arXiv' AS "Source", abstract AS "Abstract", '' AS "PMID",
       '|' AS "Affiliation", doi AS "DOI", id AS "paperLink"
FROM best WHERE place <= 10"""


# Scripts that put no space between words.
UNSPACED = r"\p{Han}\p{Hiragana}\p{Katakana}\x{30FC}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"


def tfidf(table: str, key: str, abstract: str) -> str:
    """``keywords``: the ten best words per row of ``table``; pairs of characters in unspaced scripts."""
    spaced = f"regexp_replace(lower({abstract}), '([{UNSPACED}]+)', ' \\1 ', 'g')"
    return rf"""
runs AS (
  SELECT {key} AS k, unnest(regexp_extract_all({spaced}, '[{UNSPACED}]+|[\p{{L}}\p{{N}}]+')) AS run
  FROM {table} WHERE {abstract} <> ''),
pieces AS (
  SELECT k, run AS term FROM runs WHERE length(run) = 1 OR NOT regexp_matches(run, '^[{UNSPACED}]')
  UNION ALL
  SELECT k, unnest(list_transform(range(1, length(run)), lambda i: substr(run, i, 2))) FROM runs
  WHERE length(run) > 1 AND regexp_matches(run, '^[{UNSPACED}]')),
tf AS (SELECT k, term, count(*) AS tf FROM pieces GROUP BY k, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
weighted AS (
  SELECT k, term, round(tf * ln((SELECT count(*) FROM {table} WHERE {abstract} <> '')
                                / CAST(df AS DOUBLE)), 6) AS score
  FROM tf JOIN df USING (term)),
placed AS (
  SELECT k, term, row_number() OVER (PARTITION BY k ORDER BY score DESC, term) AS place
  FROM weighted),
keywords AS (
  SELECT k, string_agg(term, ', ' ORDER BY place) AS keywords
  FROM placed WHERE place <= 10 GROUP BY k)"""


# The label of two authors given as 'a|b' and their institutions as 'x|y'.
def pair_label(authors: str, institutions: str) -> str:
    def one(i: int) -> str:
        author = f"split_part({authors}, '|', {i})"
        inst = f"split_part({institutions}, '|', {i})"
        return f"{author} || CASE WHEN {inst} <> '' THEN ' (' || {inst} || ')' ELSE '' END"

    return (
        f"{one(1)} || CASE WHEN contains({authors}, '|') THEN ', ' || {one(2)} ELSE '' END"
    )


DIGEST = f"""
{with_(ITEMS, TURNS, BEST)},
papers AS (
  SELECT * FROM ({medline(UNFOLDED)}
    WHERE contains(lower('Document ' || doc_id || ' (' || lang || ')' || chr(10) || text), 'tion')
      AND contains(lower('Document ' || doc_id || ' (' || lang || ')' || chr(10) || text), 'the'))
  UNION ALL {biorxiv(NEW_ITEMS + " AND " + CLICK_VIEW)}
  UNION ALL {CHEM_50}
  UNION ALL {ARXIV_10}),
numbered AS (
  SELECT *, row_number() OVER (ORDER BY source_rank, source_seq, paper_key) AS position,
         count(*) OVER () AS total FROM papers),
{tfidf("papers", "paper_key", '"Abstract"')},
ready AS (
  SELECT paper_key, position, total, "Title" AS title, "paperLink" AS link,
         {pair_label('"Authors"', '"Affiliation"')} AS label,
         coalesce(keywords, '') AS summary,
         '2024/01/12 00:30 | ' || "Source" || ' | ' || position || '/' || total AS head
  FROM numbered LEFT JOIN keywords ON k = paper_key),
posts AS ({fan_out(("teams", "line", "slack", "discord"))})
{OUTBOX}"""


ORACLE_SQL: dict[str, str] = {
    "kw_any_filter": f"""
{with_(DOCS)}
SELECT doc_id, title AS "Title", source AS "Source" FROM docs
WHERE contains(lower(title), '{TERM_1}') OR contains(lower(abstract), '{TERM_1}')
   OR contains(lower(title), '{TERM_2}') OR contains(lower(abstract), '{TERM_2}')""",
    "phrase_filter": f"""
{with_(DOCS)}
SELECT doc_id, title AS "Title", source AS "Source" FROM docs
WHERE contains(lower(title), 'of the') OR contains(lower(abstract), 'of the')""",
    "subscription_matches": f"""
{with_(DOCS, SUBSCRIPTIONS)},
found AS (
  SELECT DISTINCT doc_id, item_id FROM docs JOIN wanted
  ON contains(lower(title), keyword) OR contains(lower(abstract), keyword))
SELECT doc_id, count(*) AS subscriptions, CAST(sum(item_id) AS BIGINT) AS items FROM found GROUP BY doc_id""",
    "subscription_words": rf"""
{with_(DOCS, SUBSCRIPTIONS)},
words AS (
  SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(title || ' ' || abstract), '[\p{{L}}\p{{N}}]+')) AS word
  FROM docs),
found AS (SELECT DISTINCT doc_id, item_id FROM words JOIN wanted ON word = keyword)
SELECT doc_id, count(*) AS subscriptions, CAST(sum(item_id) AS BIGINT) AS items FROM found GROUP BY doc_id""",
    "term_and_date": """
SELECT event_id, user_id, event_type FROM events
WHERE contains(lower(event_type), 'pur') AND contains(lower(event_type), 'chase')
  AND ts >= DATE '2024-01-24' AND ts < DATE '2024-02-01'""",
    "date_window_lookback": """
WITH windows AS (
  SELECT * FROM (VALUES
    ('arxiv', DATE '2024-01-08', DATE '2024-01-08'),
    ('arxiv_upper', DATE '2024-01-08', DATE '2024-01-09'),
    ('biorxiv', DATE '2024-01-09', DATE '2024-01-10'),
    ('chemrxiv', DATE '2024-01-10', DATE '2024-01-10')) AS w(name, first, last))
SELECT name AS "window", strftime(ts, '%Y%m%d') AS day, count(*) AS papers
FROM events JOIN windows ON CAST(ts AS DATE) BETWEEN first AND last GROUP BY ALL""",
    "search_ids": """
SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders
WHERE o_orderdate >= DATE '2000-08-02' AND o_orderdate < DATE '2001-08-03'
  AND (contains(lower(o_orderpriority), 'high') OR contains(lower(o_orderstatus), 'high'))""",
    "anti_join_prev_day": """
SELECT event_id, user_id, event_type FROM events
WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-09' AND DATE '2024-01-10'
  AND user_id NOT IN (SELECT user_id FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-09')""",
    "distinct_doi": f"{with_(ITEMS)} SELECT DISTINCT doi FROM items",
    "id_semi_join": """
SELECT doc_id, lang, n_chars FROM documents
WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""",
    "author_label": f"""
{with_(AUTHOR_LABELS)} SELECT l_orderkey, authors, author_label FROM author_labels""",
    "author_label_arrays": """
WITH lines AS (
  SELECT l_orderkey, l_linenumber, l_suppkey, CAST(floor(l_quantity) AS BIGINT) % 8 AS given
  FROM lineitem),
pairs AS (
  SELECT l_orderkey, l_linenumber, given,
         list_transform(range(1, least(l_linenumber, given) + 1), lambda i:
           'A' || i || CASE WHEN (i - 1) % 2 = 0
                            THEN ' (I' || l_suppkey || '-' || (i - 1) || ')' ELSE '' END) AS named
  FROM lines)
SELECT l_orderkey, l_linenumber, given AS institutions,
       CASE WHEN l_linenumber <= 3 OR len(named) < 2 THEN coalesce(array_to_string(named, ', '), '')
            ELSE named[1] || ', ' || named[2] || ' ... ' || named[len(named)] END AS author_label
FROM pairs""",
    "author_split_pad": """
SELECT l_orderkey,
       array_to_string(list_transform(range(1, l_linenumber + 1), lambda i: 'A, ' || i || '.'), '|')
         AS authors,
       CAST(l_linenumber AS BIGINT) AS n_authors, repeat('|', l_linenumber - 1) AS blank,
       repeat('|', l_linenumber - 1) || 'Inst ' || l_suppkey AS padded
FROM lineitem""",
    "first_institution": """
SELECT l_orderkey, l_linenumber,
       l_returnflag || ' ' || l_partkey || '|' || l_linestatus || ' ' || l_suppkey AS authors,
       CASE WHEN l_linestatus = 'O' THEN 'Inst ' || l_suppkey ELSE '' END || '|' AS institutions
FROM lineitem""",
    "json_normalise": f"""
{with_(ITEMS)}
SELECT source_seq, doi, title, strftime(published, '%Y-%m-%d') AS day,
       CAST(json_extract_string(abstract, '$.k') AS BIGINT) AS k
FROM items""",
    "raw_record_title": """
SELECT page_id, url, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title FROM pages""",
    "doi_citation_split": """
SELECT CAST(doc_id AS VARCHAR) AS "PMID",
       CASE WHEN lang = 'fr' THEN 'Journal of ' || source || '. 2024.'
            ELSE 'Journal of ' || source || '. 2024;1(' || doc_id || '):1-9' END AS citation,
       CASE WHEN lang <> 'fr' THEN '10.5555/' || source || '.' || doc_id END AS doi,
       'https://pubmed.ncbi.nlm.nih.gov/' || doc_id || '/' AS pubmed_link,
       CASE WHEN lang <> 'fr' THEN 'https://doi.org/10.5555/' || source || '.' || doc_id END
         AS doi_link
FROM documents""",
    "strip_text": """
SELECT conv_id, turn, trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(12288))
         AS stripped
FROM conversations""",
    "jst_header": """
SELECT event_id,
       strftime(ts + INTERVAL 9 HOUR, '%Y/%m/%d %H:%M') || ' | ' || event_type || ' | '
         || event_id || '/' || user_id AS header,
       strftime(ts, '%Y%m%d') AS day
FROM events""",
    "medline_scan": medline(UNFOLDED),
    "blank_abstracts": rf"""
SELECT CAST(doc_id AS VARCHAR) AS "PMID",
       CASE WHEN doc_id % 7 = 0 THEN '' ELSE {UNFOLDED} END AS "Abstract", doc_id % 7 <> 0 AS asked
FROM documents""",
    "atom_scan": f"""
{with_(TURNS)}
SELECT id, day, title AS "Title", authors AS "Authors", 'arXiv' AS "Source",
       abstract AS "Abstract", '' AS "PMID", '|' AS "Affiliation", doi AS "DOI", id AS "paperLink"
FROM turns""",
    "landing_rejects": """
SELECT 'biorxiv' AS source, CAST(CASE event_type WHEN 'error' THEN 500 ELSE 404 END AS BIGINT)
         AS status, count(*) AS replies
FROM events WHERE event_type IN ('error', 'signup') GROUP BY ALL""",
    "landing_pages": f"""
{CHEM} (SELECT * FROM documents
        QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 2)""",
    "landing_current": f"""
{with_(UNEVEN)}
SELECT CAST(CAST(fetched AS DATE) AS VARCHAR) AS query_key, event_id AS cursor,
       CAST(200 AS BIGINT) AS status, strftime(fetched_at, '%Y-%m-%d %H:%M') AS fetched, body
FROM current
QUALIFY row_number() OVER (PARTITION BY CAST(fetched AS DATE) ORDER BY event_id) <= 3""",
    "landing_account": f"""
{with_(UNEVEN)},
judged AS (
  SELECT *, CASE WHEN bad = 7 THEN 'unreadable' WHEN bad = 8 THEN 'no list' ELSE 'used' END AS reply
  FROM current),
dated AS (
  SELECT *, '10.5555/u' || user_id AS doi,
         CASE WHEN bad <> 9 THEN CAST(fetched AS DATE) END AS published FROM judged WHERE reply = 'used'),
items AS (
  SELECT CASE WHEN published IS NULL THEN 'undated'
              WHEN published <> DATE '2024-01-10' THEN 'other day'
              WHEN doi IN (SELECT doi FROM dated WHERE published = DATE '2024-01-09')
                THEN 'seen the day before'
              WHEN contains(lower(event_type), 'click') OR contains(lower(props), 'click')
                OR contains(lower(event_type), 'vie') OR contains(lower(props), 'vie') THEN 'used'
              ELSE 'no hit' END AS outcome
  FROM dated),
rows AS (
  SELECT 'reply' AS unit, reply AS outcome FROM judged
  UNION ALL SELECT 'reply', 'status ' || status FROM landed WHERE status <> 200
  UNION ALL SELECT 'reply', 'superseded' FROM landed
    WHERE status = 200 AND (event_id, fetched_at) NOT IN (SELECT event_id, fetched_at FROM current)
  UNION ALL SELECT 'item', outcome FROM items)
SELECT 'biorxiv' AS source, unit, outcome, count(*) AS n FROM rows GROUP BY ALL""",
    "landing_days": """
SELECT event_id // 20 * 20 AS cursor, strftime(min(day), '%Y-%m-%d') AS first_day,
       strftime(max(day), '%Y-%m-%d') AS last_day,
       count(*) FILTER (day IS NULL) AS undated
FROM (SELECT event_id, CASE WHEN event_id % 173 <> 0 THEN CAST(ts AS DATE) END AS day FROM events)
GROUP BY ALL""",
    "landing_pruned": """
SELECT event_id // 20 * 20 + row_number() OVER (PARTITION BY event_id // 20 ORDER BY event_id) - 1
         AS source_seq,
       '10.5555/u' || user_id AS doi, event_type AS title
FROM events
QUALIFY CAST(ts AS DATE) = DATE '2024-01-09' AND event_id % 173 <> 0""",
    "pubmed_corpus": """
WITH r AS (
  SELECT *, DATE '2024-01-01' + CAST(doc_id % 10 AS INTEGER) AS day,
         'Document ' || doc_id || ' (' || lang || ')' AS title FROM documents),
now AS (
  SELECT doc_id, text,
         CASE WHEN doc_id % 4 = 1 THEN 'Last ' || title WHEN doc_id % 3 = 0 THEN 'Revised ' || title
              ELSE title END AS title,
         CASE WHEN doc_id % 4 <> 1 AND doc_id % 3 = 0 THEN day + 1 ELSE day END AS edat,
         CASE WHEN doc_id % 4 = 1 THEN DATE '2024-01-05' WHEN doc_id % 3 = 0 THEN DATE '2024-01-04'
              ELSE DATE '2024-01-02' END AS mdat
  FROM r)
SELECT CAST(doc_id AS VARCHAR) AS "PMID", title AS "TI", strftime(edat, '%Y-%m-%d') AS edat,
       strftime(mdat, '%Y-%m-%d') AS mdat FROM now
WHERE edat BETWEEN DATE '2024-01-06' AND DATE '2024-01-11'
  AND contains(lower(title || chr(10) || text), 'tion') AND contains(lower(title || chr(10) || text), 'the')""",
    "chemrxiv_papers": CHEM_50,
    "biorxiv_new_papers": f"{with_(ITEMS)} {biorxiv(NEW_ITEMS + ' AND ' + CLICK_VIEW)}",
    "arxiv_top": f"{with_(TURNS, BEST)} {ARXIV_10}",
    "union_sources": f"""
{medline("text")}
UNION ALL
SELECT 'biorxiv:10.5555/b' || item_id || ':' || item_id, 'biorxiv', 1, item_id,
       'Item ' || item_id, 'Able, ' || item_id || '.|Baker, B.', 'bioRxiv', text, '', '|Inst B',
       '10.5555/b' || item_id, 'https://doi.org/10.5555/b' || item_id
FROM benchmark
UNION ALL
SELECT 'chemrxiv:10.5555/c' || conv_id || '.' || turn || ':' || (conv_id * 1000 + turn),
       'chemrxiv', 2, conv_id * 1000 + turn, role || ' ' || turn,
       role || ' ' || conv_id || '|Turn ' || turn, 'chemRxiv', text, '',
       CASE WHEN role = 'user' THEN 'Inst user|' ELSE '|' END,
       '10.5555/c' || conv_id || '.' || turn, 'https://doi.org/10.5555/c' || conv_id || '.' || turn
FROM conversations
UNION ALL
SELECT 'arxiv:' || url || ':' || page_id, 'arxiv', 3, page_id,
       regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '\\s+', ' ', 'g'),
       'Page ' || page_id, 'arXiv', html, '', '', NULL, url
FROM pages""",
    "source_running_count": f"""
{with_(DOCS)}, counts AS (SELECT source_rank, count(*) AS papers FROM docs GROUP BY source_rank)
SELECT CAST(source_rank AS BIGINT) AS source_rank, papers,
       CAST(sum(papers) OVER (ORDER BY source_rank) AS BIGINT) AS papers_so_far,
       CAST(sum(papers) OVER () AS BIGINT) AS papers_total
FROM counts""",
    "top10_relevance": f"""
{with_(DOCS)}, whole AS (SELECT *, lower(title || chr(10) || abstract) AS w FROM docs)
SELECT doc_id, title AS "Title", {hits("w", TERM_1)} + {hits("w", TERM_2)} AS score
FROM whole ORDER BY score DESC, doc_id LIMIT 10""",
    "topk_per_source": """
SELECT source, doc_id, n_chars FROM documents
QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 5""",
    "digest_position": f"""
{with_(DOCS, NUMBERED)}
SELECT doc_id, position, total, position || '/' || total AS label FROM numbered""",
    "prompt_request": f"""
{with_(DOCS)}
SELECT paper_key, CAST(to_json(struct_pack(
         paper_key := paper_key, model := {text(K.MODEL)},
         messages := [
           struct_pack(role := 'system', content := {text(K.SYSTEM_MESSAGE)}),
           struct_pack(role := 'user',
                       content := {text(K.BASE_PROMPT + K.PROMPT_GAP)} || abstract)],
         temperature := 1, max_tokens := 1001, top_p := 1, frequency_penalty := 0,
         presence_penalty := 0)) AS VARCHAR) AS body
FROM docs WHERE abstract <> ''""",
    "response_attach": """
SELECT d.doc_id, coalesce('quality ' || quality || ', toxic ' || toxic, '') AS summary
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "tfidf_keywords10": f"""
{with_(tfidf("documents", "doc_id", "text"))}
SELECT doc_id, coalesce(keywords, '') AS keywords
FROM documents LEFT JOIN keywords ON k = doc_id""",
    "tfidf_scripts": f"""
WITH few AS (
  SELECT doc_id, array_to_string(str_split(text, ' ')[1:6], ' ') || ' '
         || ['AI 3D x', '自動化ラボ用AIロボット', '機械学習データ 2', 'ภาษาไทย lab'][doc_id % 4 + 1] AS abstract
  FROM documents),
{tfidf("few", "doc_id", "abstract")}
SELECT doc_id, coalesce(keywords, '') AS keywords
FROM documents LEFT JOIN keywords ON k = doc_id""",
    "request_resume": f"""
{with_(DOCS)},
asked AS (
  SELECT doc_id, abstract, substr(sha256(CAST(to_json(struct_pack(
         model := {text(K.MODEL)},
         messages := [
           struct_pack(role := 'system', content := {text(K.SYSTEM_MESSAGE)}),
           struct_pack(role := 'user',
                       content := {text(K.BASE_PROMPT + K.PROMPT_GAP)} || abstract)],
         temperature := 1, max_tokens := 1001, top_p := 1, frequency_penalty := 0,
         presence_penalty := 0)) AS VARCHAR)), 1, 1) < '8' AS known
  FROM docs WHERE abstract <> '')
SELECT doc_id, CASE WHEN known THEN 'answer ' || (length({text(K.BASE_PROMPT + K.PROMPT_GAP)}) + length(a.abstract))
                    ELSE '' END AS summary, coalesce(NOT known, false) AS asked_again
FROM docs LEFT JOIN asked a USING (doc_id)""",
    **{f"msg_{channel}": message(channel) for channel in TEXTS},
    "outbox_fanout": f"{READY}, posts AS ({fan_out(tuple(TEXTS))}) {OUTBOX}",
    "channel_switch": f"""
{READY}, posts AS ({fan_out(("line", "discord"))})
SELECT channel, paper_key, position, message, username FROM posts""",
    "outbox_errors": f"""
{with_(DOCS, NUMBERED)}
SELECT 'slack' AS channel, paper_key, position, total, title FROM numbered
WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "incremental_intake": f"{with_(ITEMS)} {biorxiv(CLICK_VIEW)}",
    "incremental_dedup": f'{with_(ITEMS)} SELECT DISTINCT doi AS "DOI" FROM items',
    "incremental_sources": f"""
{with_(TURNS)}
{CHEM} (SELECT * FROM documents
  WHERE contains(lower(text), 'of the')
     OR contains(lower('Document ' || doc_id || ' (' || lang || ')'), 'of the'))
UNION ALL
SELECT 'arxiv:' || coalesce(doi, id) || ':', 'arxiv', CAST(3 AS BIGINT), CAST(-1 AS BIGINT), title, authors, 'arXiv',
       abstract, '', '|', doi, id
FROM turns WHERE contains(lower(title || chr(10) || abstract), 'tion')
             AND contains(lower(title || chr(10) || abstract), 'the')""",
    "new_papers_to_slack": f"""
{with_(ITEMS)},
papers AS ({biorxiv(NEW_ITEMS + " AND " + CLICK_VIEW)}),
ready AS (
  SELECT paper_key, row_number() OVER (ORDER BY source_seq) AS position,
         "Title" AS title, "paperLink" AS link, '' AS summary,
         {pair_label('"Authors"', '"Affiliation"')} AS label,
         '2024/01/12 00:30 | bioRxiv | ' || row_number() OVER (ORDER BY source_seq) || '/'
           || count(*) OVER () AS head
  FROM papers)
SELECT paper_key, position, {SLACK} AS message FROM ready""",
    "digest_run": DIGEST,
}
