import re

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, node long, version int, kept boolean, `a.b` int, removed int"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingle_set(text, width=5):
    w = words_of(text)
    return frozenset(tuple(w[j : j + width]) for j in range(max(1, len(w) - width + 1))) if w else frozenset()


def components_of(sets, percent=75):
    """Smallest key reachable by links, by comparing all pairs."""
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for n, i in enumerate(keys):
        for j in keys[:n]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}


LONG = " ".join(f"w{i}" for i in range(30_000))
PASSAGE = " ".join(f"passage{i}" for i in range(60))
BLOCK = "\n".join(f"line {i} of a block that many texts hold" for i in range(40))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names."""
    body = " ".join(f"term{i}" for i in range(50))
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two three four"), (6, body), (7, body), (8, body + " end"),
        (9, LONG), (10, LONG + " more"), (11, "x" * 50_000), (12, "start here\n" + PASSAGE + "\nend"), (13, "other\n" + PASSAGE),
        (14, BLOCK + "\nown tail of this text"), (15, "own head\n" + BLOCK), (16, "é ß 日本 😀 ▁   \x00 end"), (6, body),
        (None, "no id at all but words"), (17, "<|endoftext|> marks the end"), (18, "All rights reserved."),
    ]
    full = [(i, t, None if n % 3 else "en", None if n % 2 else "s", None, "x", n, n, True, n, n) for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (6, 1, 0), (None, 1, 1), (9, None, None), (12, 0, 1), (12, 0, 1)], "doc_id long, quality int, toxic int")
