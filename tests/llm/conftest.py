import random

import pytest

from paperwire.llm.common import on_workers

KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint, _row string, seq int, shard string"


def prose(rng, n, words=300):
    return [f"w{rng.randrange(words)}" for _ in range(n)]


def odd_documents():
    """Copies, near copies, shared passages, ties, repeated rows, NULLs everywhere, empty and very long texts."""
    rng = random.Random(3)
    passage, common = prose(rng, 70), prose(rng, 55)
    rows, base = [], [" ".join(prose(rng, rng.choice([1, 2, 3, 20, 60, 90, 120]))) for _ in range(40)]
    for i in range(60):
        words = base[i % 40].split()
        if i % 5 == 0:
            at = rng.randrange(len(words) + 1)
            words = words[:at] + passage[: rng.choice([49, 50, 60, 70])] + words[at:]
        if i % 7 == 0:
            words = common + words + common
        if i % 11 == 0 and words:
            words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words), ["en", "de", None][i % 3], f"s{i % 4}"))
    rows += [(100 + i, rows[7][1].replace(" ", ["  ", "\n", "\t", " \r\x0b\x0c"][i % 4]), "en", "s0") for i in range(12)]
    rows += [rows[3], rows[3], rows[3]]
    rows += [(None, rows[5][1], None, None), (None, None, None, None), (None, None, None, None), (None, "only a null id", "en", "s1")]
    rows += [(200, None, "en", "s1"), (201, "", "en", None), (202, " \n\t ", "de", "s2"), (203, "Ünïcode Ñandú ΑΒΓ 12345 !?", "fr", "s2")]
    rows += [(204, " \u0085 \x1c nb sp 'll don't I'VE <|endoftext|> \U0001f600é", "en", "ü")]
    rows += [(205, " ".join(prose(rng, 30_000, 5000)), "en", "long"), (206, "x" * 60_000, "en", "long")]
    rows += [(7, "same id as another row " + passage[0], "en", "s3")]
    rows += [(300, "Ab cD é eF", "en", "s1"), (301, "ab cd é ef", "en", "s1"), (302, "ab cd É ef", "en", "s1")]
    return rows


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """The rows in several files, with columns whose names the operators use themselves."""
    on_workers(spark)
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    rows = [(*r, len(r[1] or ""), "x", 1, "y") for r in odd_documents()]
    spark.createDataFrame(rows, KIND).repartition(5).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("doc_id < -1")
