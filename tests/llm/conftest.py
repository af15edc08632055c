import random

import pytest

WORDS = ["ab", "c", "The", "of", "É", "é", "zz", "q\0", "lorem", "xx yy", "\n", "it.", "a b", "日本"]


def text(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def messy():
    """(doc_id, text) rows with shared passages, near copies, copies, repeated ids, nulls, empty and long texts."""
    r = random.Random(4)
    passages = [text(r, 30) for _ in range(5)]
    rows = [(5, "a" * 300), (6, "b" + "a" * 200), (7, "ab" * 100), (3, "x" * 49), (4, "x" * 49), (8, ""), (9, None), (10, None), (11, " \t\n "), (12, "one two"), (13, "One  two")]
    for i in range(90):
        t = " ".join(r.choice([*passages, text(r, 12), text(r, 20)]) for _ in range(r.randint(0, 6)))
        if i % 5 == 1:
            t = r.choice(rows)[1] or ""
        if i % 5 == 2:  # a near copy
            w = (r.choice(rows)[1] or "").split(" ")
            w[r.randrange(len(w))] = "changed"
            t = " ".join(w)
        rows.append((r.randint(0, 60) if i % 9 == 0 else 100 + i, t))
    rows += [(900, rows[20][1]), (900, rows[20][1]), (901, text(r, 12000)), (902, "w" * 3000)]
    return rows


@pytest.fixture(scope="session")
def documents(spark, messy):
    """The rows as a table with columns that clash with the operators' own, and one row without an id."""
    rows = [(d, t, "x", 1.0, 2, "y") for d, t in messy] + [(None, "a text without id", "x", 1.0, 2, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, tid string, score double, block int, hashes string").repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string")
