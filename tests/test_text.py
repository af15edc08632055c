"""Cleaning functions against plain-Python models on random strings."""

import random
import re

from verdigraph.functions import text as T

ALPHABET = "ab/*'\"\\ \t\n\r\x0b\x1c\x85  　é.;"


def samples(n, alphabet=ALPHABET, longest=30, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest))) for _ in range(n)] + [""]


def scan_comments(source):
    """A hand-written scanner: literals kept, comments to a blank, blank lines dropped."""
    out, i = [], 0
    while i < len(source):
        c = source[i]
        if c in "'\"":
            j = i + 1
            while j < len(source) and source[j] != c:
                j += 2 if source[j] == "\\" else 1
            if j < len(source):
                out.append(source[i : j + 1])
                i = j + 1
                continue
        if source.startswith("//", i):
            end = source.find("\n", i)
            i = len(source) if end < 0 else end
            out.append(" ")
            continue
        if source.startswith("/*", i) and source.find("*/", i + 2) >= 0:
            i = source.find("*/", i + 2) + 2
            out.append(" ")
            continue
        out.append(c)
        i += 1
    return "\n".join(line for line in "".join(out).split("\n") if line.strip() != "")


def test_collapse_ws(column):
    xs = samples(2000)
    assert column(xs, T.collapse_ws) == [" ".join(x.split()) for x in xs]


def test_every_whitespace_character(column):
    xs = [f"a{chr(c)}b" for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    assert column(xs, T.collapse_ws) == [" ".join(x.split()) for x in xs]


def test_strip_ws(column):
    xs = samples(1000, " \t\n a")
    assert column(xs, T.strip_ws) == [x.strip() for x in xs]


def test_collapse_runs(column):
    xs = samples(1000, " \t\na") + ["a \t b", "  \n\t\tx"]
    assert column(xs, T.collapse_runs) == [re.sub(" +|\t+", " ", x) for x in xs]


def test_words_and_spaced_words(column):
    xs = samples(500)
    assert column(xs, T.words) == [x.split() for x in xs]
    assert ["".join(p) for p in column(xs, T.spaced_words)] == xs


def test_strip_comments_random(column):
    xs = samples(3000, "a/*'\"\\\n ", 24, 2)
    assert column(xs, T.strip_comments) == [scan_comments(x) for x in xs]


def test_strip_comments_cases(column):
    cases = {
        'a = "x // y"; // gone': 'a = "x // y";  ',
        "/* open": "/* open",
        "a/**/b\n\n  \nc": "a b\nc",
        "'\"' // c": "'\"'  ",
        "a / b": "a / b",
    }
    assert column(list(cases), T.strip_comments) == list(cases.values())


def test_strip_comments_long_pieces(column):
    long = '"' + "\\x41" * 60000 + '"' + "/*" + "*" * 200000 + "*/" + "'" + "y" * 200000
    assert column([long], T.strip_comments) == [scan_comments(long)]


def test_clean_for(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("x-PDBERT", "a \t b"), ("GraphCodeBERT", "a \t b"), ("other", " a \t b")], "n string, t string")
    got = [r[0] for r in rows.select(T.clean_for(F.col("n"), F.col("t"))).collect()]
    assert got == [re.sub(" +|\t+", " ", "a \t b"), "a \t b", "a b"]
