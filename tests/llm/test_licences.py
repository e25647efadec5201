"""Licence scans on a labelled set, against a plain version, and sharding against its law."""

import hashlib
import math
import os
import random
import re
from collections import Counter

import public_tokenizers

from paperwire.llm import licenses
from paperwire.llm.queries import QUERIES
from tests.llm.conftest import odd_documents

PROSE = "import the module and call it with a path to license plates or permission slips of the free software meeting held last year in the hall"


def wrapped(text, width, mark=""):
    out, line = [], ""
    for word in text.split():
        if len(line) + len(word) > width:
            out.append(mark + line.strip())
            line = ""
        line += word + " "
    return "\n".join([*out, mark + line.strip()])


def labelled():
    """Files with their licence: whole texts reflowed, in comments, with holders and years; and files without one."""
    rng, rows = random.Random(6), []
    for name, texts in licenses.WHOLE.items():
        for k, text in enumerate(texts):
            holder = text.replace("Copyright (c)", f"Copyright (c) {1990 + k} The {name[0]}uthors of example")
            rows.append((f"r{name}{k}/LICENSE", wrapped(holder, 72), name))
            rows.append((f"r{name}{k}/COPYING.txt", wrapped(holder, 40) + "\n", name))
            code = "\n\n" + "\n".join(" ".join(rng.choices(PROSE.split(), k=8)) for _ in range(30))
            rows.append((f"c{name}{k}/main.py", wrapped(holder, 70, "# ") + code, name))
            rows.append((f"d{name}{k}/main.c", "/*\n" + wrapped(holder, 60, " * ") + "\n */" + code, name))
    for name, texts in licenses.TEMPLATES.items():
        for k, text in enumerate(texts):
            rows.append((f"n{name}{k}/x.txt", f"{PROSE}\n{text}\n{PROSE}", name))
            rows.append((f"m{name}{k}/x.py", f"# {text.upper()}\n{PROSE}", name))
    for k in range(40):
        rows.append((f"p{k}/readme.md", "\n".join(" ".join(rng.choices(PROSE.split(), k=12)) for _ in range(20)), None))
    for k, text in enumerate((
        "This work is *not* licensed under the GNU General Public License, version 3.", "Never released under the MIT License.",
        "See the license for details.", "All rights reserved.", "You may not copy this file.", "The Apache helicopter, version 2.0", "",
    )):
        rows.append((f"q{k}/x.txt", text, None))
    return rows


def test_precision_and_recall_on_labelled_files(spark):
    rows = [(k, path, text, want) for k, (path, text, want) in enumerate(labelled())]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id bigint, path string, text string, want string").drop("want"))
    got = {r["doc_id"]: r["licence"] if r["how"] == "notice" else None for r in found.collect()}
    named = [k for k, _, _, want in rows if want]
    right = sum(got[k] == rows[k][3] for k in named)
    claimed = [k for k in got if got[k]]
    assert right / len(named) >= 0.97, Counter((rows[k][1], rows[k][3], got[k]) for k in named if got[k] != rows[k][3])
    assert sum(got[k] == rows[k][3] for k in claimed) / len(claimed) >= 0.97
    assert not any(got[k] for k, _, _, want in rows if not want)


def test_licences_of_the_installed_vocabularies(spark):
    with open(os.path.join(os.path.dirname(public_tokenizers.__file__), "LICENSES.txt")) as file:
        text = file.read()
    start = text.index("MIT License")
    mit = text[start : text.index("IN THE SOFTWARE", start) + len("IN THE SOFTWARE.")] if "IN THE SOFTWARE" in text else text[start : text.index("SOFTWARE.", start) + 9]
    apache = text[text.index("                                 Apache License") :]
    df = spark.createDataFrame([(1, "a/LICENSE", mit), (2, "b/LICENSE", apache), (3, "a/x/y.py", "pass")], "doc_id bigint, path string, text string")
    found = {r["doc_id"]: (r["licence"], r["how"]) for r in licenses.scan(df).collect()}
    assert found == {1: ("MIT", "notice"), 2: ("Apache-2.0", "notice"), 3: ("MIT", "inherited")}


def plain_scan(files):
    """Dense cosines of every part with every template, and folders one by one."""
    spaces = []
    for templates in (licenses.TEMPLATES, licenses.WHOLE):
        texts = [(name, Counter(licenses.TERM.findall(t.lower()))) for name in sorted(templates) for t in templates[name]]
        seen = Counter(w for _, terms in texts for w in terms)
        spaces.append((texts, lambda w, n=len(texts), seen=seen: math.log((1 + n) / (1 + seen[w])) + 1))

    def best(space, part):
        texts, weight = space
        terms, top = Counter(licenses.TERM.findall(part.lower())), (0.0, None)
        size = math.sqrt(sum((n * weight(w)) ** 2 for w, n in terms.items()))
        for name, other in texts:
            dot = sum(terms[w] * other[w] * weight(w) ** 2 for w in terms)
            length = math.sqrt(sum((n * weight(w)) ** 2 for w, n in other.items()))
            score = round(dot / size / length, 9) if dot else 0.0
            if score > top[0] and not (licenses.DENIALS - other.keys()) & terms.keys():
                top = score, name
        return top if top[0] >= licenses.THRESHOLD else (0.0, None)

    own = []
    for _, path, text in files:
        name, text, top = (path or "").rsplit("/", 1)[-1], text or "", (0.0, None, 0)
        named, some = bool(re.search(licenses.FILE_NAME, name)), licenses.paragraphs(text)
        several = [p for p in some if "\n" in p.strip()]
        parts = [(0, p) for p in [*text.split("\n"), *several, *[text] * named]] + [(1, p) for p in [*some, *[text] * (len(some) != 1)]]
        for k, part in parts:
            score, licence = best(spaces[k], part)
            if score > top[0]:
                top = score, licence, len(part.split()) / max(1, len(text.split()))
        own.append((*top, named, "/".join([p for p in (path or "").split("/") if p][:-1]), path or ""))
    given = {}
    for score, licence, share, named, folder, path in own:
        if licence and (named or share >= licenses.FOLDER_SHARE):
            given.setdefault(folder, []).append((-score, path, licence))
    out = []
    for (doc, path, _), (score, licence, _, _, folder, _) in zip(files, own):
        if licence:
            out.append((doc, path, licence, score, "notice", None))
            continue
        parts = folder.split("/") if folder else []
        above = ["/".join(parts[:n]) for n in range(len(parts), -1, -1)]
        near = next((f for f in above if f in given), None)
        if near is None:
            out.append((doc, path, None, 0.0, "none", None))
        else:
            first = min(given[near])
            out.append((doc, path, first[2], -first[0], "inherited", near))
    return Counter(out)


def test_scan_equals_a_plain_version(spark):
    rng = random.Random(9)
    files = [(k, path, text) for k, (path, text, _) in enumerate(labelled())][::3]
    mit = licenses.TEMPLATES["MIT"][0]
    for k in range(40):
        folder = "/".join(rng.choices(["a", "b", "c"], k=rng.randrange(4)))
        text = rng.choice(["nothing", mit, PROSE + "\n" + mit, "", None, licenses.TEMPLATES["GPL-3.0"][0]])
        files.append((900 + k, rng.choice([f"{folder}/f{k}", f"{folder}/LICENSE", f"{folder}/f{k}"]).lstrip("/"), text))
    files += [(None, None, None), (7, "a/b", "x " * 20_000 + "\n" + mit), files[0], files[0]]
    df = spark.createDataFrame(files, "doc_id bigint, path string, text string").repartition(3)
    found = licenses.scan(df).select("doc_id", "path", "licence", "score", "how", "folder").collect()
    assert Counter(tuple(r) for r in found) == plain_scan(files)


def test_scan_takes_odd_rows(spark, odd, none):
    rows = odd.selectExpr("*", "concat(source, '/', doc_id) as path")
    assert licenses.scan(rows).count() == len(odd_documents())
    assert licenses.scan(none.selectExpr("*", "'' as path")).count() == 0


# Sharding


def test_shards_follow_their_law(spark):
    """Whole table: key order by hash, fractional ranks, runs of equal length."""
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "source", "text").collect()]

    def digits(text):
        return hashlib.md5(text.encode()).hexdigest()

    by = {}
    for doc, source, text in rows:
        data = (text or "").encode()
        by.setdefault(source, []).append((digits(f"29:{'null' if doc is None else doc}")[:16], doc, len(data) + 16, data))
    placed = []
    for source, some in by.items():
        label = "29:" + ("null" if source is None else f"={source}")
        shift = int(digits(label)[:8], 16) / 2.0**32
        for rank, row in enumerate(sorted(some)):
            placed.append(((rank + shift) / len(some), source is None, source or "", row))
    placed.sort()
    want, slots = {}, Counter()
    for at, (_, _, _, (_, doc, size, _)) in enumerate(placed):
        shard = at * 40 // len(placed)
        want[doc] = size, shard, slots[shard]
        slots[shard] += 1
    found = QUERIES["op3_sharding"](spark, "/root/testdata/sf0.001").collect()
    assert len(found) == len(rows) == len(want)
    assert {r["doc_id"]: (r["size"], r["shard"], r["slot"]) for r in found} == want
    assert max(slots.values()) - min(slots.values()) <= 1
