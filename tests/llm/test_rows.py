import hashlib
import random
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from brute import rows_of
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from verdigraph.llm import bpe, decontam, imi, licenses, pii, quality, tokenfile

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
ODD = [" ", "  ", "\n", "a", "the", "The", "é", "É", "\t", " \n", " ", "ß", "'s", "don't", "1", "23", "%%", "\0", "日本", "　", "\x1c", "😀", "é", ".", ",", "İ", "½"]


def odd_texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(ODD) for _ in range(r.randint(0, 14))) for _ in range(n)]


def test_bpe_equals_the_library():
    ranks = bpe.read_ranks(BYTE_BPE)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = odd_texts(1500, 1) + ["a" * 700, "xyzq" * 100, " ", "", "<|endoftext|>"]
    coder = bpe.codec(BYTE_BPE, public_tokenizers.PATTERN)
    got = coder.encode(rows[:700]) + coder.encode(rows[700:])
    assert [g.tolist() for g in got] == [library.encode_ordinary(t) for t in rows]
    assert coder.decode(got) == [t.encode() for t in rows]


def test_bpe_rows(documents, messy, nothing):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(BYTE_BPE), special_tokens={})
    want = []
    for d, t in [*messy, (None, "a text without id")]:
        ids = library.encode_ordinary(t or "")
        want.append((d, len(ids), brute.sha(" ".join(map(str, ids)).encode()), brute.sha((t or "").encode())))
    got = rows_of(bpe.round_trip(documents, BYTE_BPE, public_tokenizers.PATTERN), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == sorted(want, key=lambda r: tuple((x is not None, x) for x in r))
    assert bpe.round_trip(nothing, BYTE_BPE, public_tokenizers.PATTERN).count() == 0


def test_word_encoder_equals_the_library():
    library = Tokenizer.from_file(WORD_BPE)
    rows = odd_texts(1500, 2)
    got = [np.frombuffer(x, "<u2").tolist() for x in tokenfile.encoder(WORD_BPE).encode(rows)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in rows]


def test_token_file(documents, messy, nothing):
    library = Tokenizer.from_file(WORD_BPE)
    each = sorted((d, np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u2")) for d, t in messy if d not in (900,) and [x for x, _ in messy].count(d) == 1)
    got = {r["doc_id"]: r for r in tokenfile.token_table(documents, WORD_BPE).collect() if r["doc_id"] in dict(each)}
    for d, ids in each:
        assert (got[d]["n_tokens"], got[d]["ids_crc32"]) == (len(ids), zlib.crc32(ids.astype("<u4").tobytes())), d
    rows = sorted((tuple(r) for r in tokenfile.token_table(documents, WORD_BPE).collect()), key=lambda r: (r[1], r[0]))
    assert len(rows) == len(messy) and [r[0] for r in rows] == sorted(d for d, _ in messy)
    assert all(a[1] + a[2] == b[1] for a, b in zip(rows, rows[1:])) and rows[0][1] == 0
    assert tokenfile.token_table(nothing, WORD_BPE).count() == 0


@pytest.mark.parametrize("values", [[], [0], [7, 7, 7], [0, 1, 2, 3], [5] * 100 + [2**40], list(range(-90, 10**6, 977)), [0, 0, 10**12]])
def test_elias_fano(values):
    sequence, _ = tokenfile.EliasFano.load(tokenfile.EliasFano.of(np.array(values, dtype=np.int64)).dump(), 0)
    assert sequence.all().tolist() == values and [sequence.select(i) for i in range(len(values))] == values
    with pytest.raises(IndexError):
        sequence.select(len(values))


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(0).integers(1, 2000, 10_000))
    assert len(tokenfile.EliasFano.of(ends).dump()) < 10_000 * 14 / 8


def test_pii_base_spans():
    r = random.Random(2)
    bits = ["1", "0", "25", "255", "256", ".", ".", "@", "a", "b-", "+", "+1", " ", "-", "(", "4111111111111111", "x.y", "é", "%"]
    for _ in range(20_000):
        t = "".join(r.choice(bits) for _ in range(r.randint(0, 25)))
        assert [f"{k}:{s}:{e}" for s, e, k in pii.base_spans(t)] == [x[2] for x in brute.edges(t)], t
    for t in ("1" * 50_000, "a" * 50_000 + "@", "@" * 20_000, "+1" * 20_000, "1." * 20_000):
        pii.base_spans(t)


def test_pii_rows(spark, documents, nothing):
    texts = ["mail bob.1@mail.example.com now", "+1 (269) 555-3296 and 10.0.0.1", "card 4111 1111 1111 1111.", None, ""] * 8
    extra = spark.createDataFrame([(2000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    both = documents.select("doc_id", "text").unionByName(extra)
    by_text = {r["doc_id"]: r for r in pii.find(both).collect() if r["doc_id"] is not None and r["doc_id"] >= 2000}
    for i, t in enumerate(texts):
        row, want = by_text[2000 + i], [x[2] for x in brute.edges(t)]
        assert row["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(row["spans"].split(",") if row["spans"] else [])
        for kind in pii.KINDS:
            assert row[f"n_{kind}"] == sum(x[3] == kind for x in brute.edges(t))
    assert pii.find(nothing).count() == 0
    shown = {r["doc_id"]: r["text"] for r in pii.redact(extra).collect()}
    assert shown[2000] == "mail <EMAIL> now" and shown[2001] == "<PHONE> and <IP>" and shown[2003] is None


def test_pii_field_learns_other_forms():
    rows = [f"so wr{i}.te@mail{i}.example.com or +1 ({200 + i}) 555-{3000 + i} x" for i in range(150)] + [f"in {1900 + i} we had {i}.0 of {i}" for i in range(100)]
    field = pii.fit(rows)
    found = pii.all_spans("call (269) 555-3296 or bob.x@mail.example.org", field)
    assert len(found[0]) == 1 and (5, 19, "phone") in found[1]
    assert pii.all_spans("in 1987 we had 4.0 of 12", field) == ([], [])


def test_license_scan(spark, documents, messy, nothing):
    texts = ["Released under the MIT license, MIT License", "x\nLicensed under CC BY-NC 4.0.\ny", "All rights reserved.", "the apache license", "rights all", None]
    extra = spark.createDataFrame([(2000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(documents.select("doc_id", "text").unionByName(extra)).collect()}
    for d, t in [*messy[:8], *((2000 + i, t) for i, t in enumerate(texts))]:
        n, places = brute.license_places(t)
        starts = [s for s, _ in places]
        assert (got[d]["n_words"], got[d]["n_base"]) == (n, len(places))
        assert (got[d]["first_word"], got[d]["last_word"]) == (min(starts, default=None), max(starts, default=None))
        assert got[d]["base_labels"] == ",".join(sorted({x for _, x in places}))
    assert [got[2000 + i]["labels"] for i in range(6)] == ["mit", "cc-by-nc", "reserved", "apache", "", ""]
    assert licenses.scan(nothing).count() == 0


def test_license_index_is_exact():
    """Prefix, length and position filters lose no template that a plain comparison finds."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    templates = {f"t{i}": (" ".join(r.sample(words, r.randint(1, 9))),) for i in range(20)}
    frequency = {w.encode(): r.randrange(1000) for w in words}
    index = licenses.Index(templates, frequency, 0.8)
    for _ in range(500):
        block = {w.encode() for w in r.sample(words, r.randint(1, 20))}
        want = {}
        for label, (t,) in templates.items():
            held = {w.encode() for w in t.split()}
            if len(held & block) >= 0.8 * len(held) - 1e-9:
                want[label] = len(held & block) / len(held)
        assert index.match(block) == want


def test_wrapped_licenses(spark):
    """Templates wrapped at any word, with comment marks before the lines, are found."""
    rows, want = [], []
    for label, each in licenses.TEMPLATES.items():
        for template in each:
            words = template.split(" ")
            for at in range(1, len(words)):
                rows.append((len(rows), "so it\n# " + " ".join(words[:at]) + "\n#   " + " ".join(words[at:]) + "\nand on"))
                want.append(label)
    rows.append((len(rows), "\n".join("Redistribution and use in source and binary forms, with or without modification, are".split(" ")[::2])))
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [i for i, label in enumerate(want) if label not in got[i]["labels"].split(",") or got[i]["score"] != 1.0] == []
    assert got[len(want)]["labels"] == ""


def test_license_windows_are_exact():
    """The sweep around rare words finds what a plain comparison of all windows finds."""
    r = random.Random(6)
    words = [f"w{i}" for i in range(12)]
    templates = {f"t{i}": (" ".join(r.choice(words) for _ in range(r.randint(1, 9))),) for i in range(15)}
    index = licenses.Index(templates, {w.encode(): r.randrange(1000) for w in words}, 0.8)
    for _ in range(300):
        text = [r.choice([*words, *["x"] * r.randint(1, 40)]).encode() for _ in range(r.randint(0, 60))]
        want = {}
        for label, (t,) in templates.items():
            n, held = len(t.split()), {w.encode() for w in t.split()}
            best = max((len(held & set(text[i : i + n])) for i in range(max(1, len(text) - n + 1))), default=0)
            if best >= 0.8 * len(held) - 1e-9:
                want[label] = best / len(held)
        assert index.match_windows(text, {}) == want


def test_quality(spark, documents, nothing):
    r = random.Random(3)
    good = [" ".join(r.choice(["the", "cat", "sat", "on", "mats"]) for _ in range(30)) for _ in range(200)]
    bad = [" ".join(r.choice(["x%%%", "the!!", "q###"]) for _ in range(30)) for _ in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*good, *bad, None, ""])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 200)) for i in range(400)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == 402 and all(0 <= r["score"] <= 1 for r in got.values())
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    held = [i for i in range(400) if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == (i < 200) for i in held) >= 0.95 * len(held)
    assert got[400]["score"] == got[401]["score"]
    kept = quality.keep(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["predicted"]}
    assert quality.classify(nothing, labels).count() == 0
    none = quality.classify(documents, labels.limit(0))
    assert none.where("score <> 0.5").count() == 0 and none.count() == documents.count()


def test_quality_features_do_not_cross_words():
    whole = sorted(quality.features("the cat sat").tolist())
    assert whole == sorted(np.concatenate([quality.features(w) for w in ("the", "cat", "sat")]).tolist())
    assert len(quality.features("no no")) == 2 * len(quality.features("no")) + 1


def test_leaks(spark, documents, nothing):
    r = random.Random(6)
    items = [" ".join(f"b{r.randrange(500)}" for _ in range(30)) + ". " + " ".join(f"c{r.randrange(500)}" for _ in range(6)) + "." for _ in range(12)]
    noise = lambda n: " ".join(f"n{r.randrange(3000)}" for _ in range(n))
    reworded = items[1].split(" ")
    for i in range(0, len(reworded), 4):
        reworded[i] = "other"
    rows = [(2000, f"{noise(70)} {items[0]} {noise(50)}"), (2001, f"{noise(20)} {' '.join(reworded)} {noise(90)}"), (2002, noise(400)), (2003, items[2]), (2004, None)]
    rows += [(3000 + i, noise(150)) for i in range(60)]
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    bench = spark.createDataFrame([*enumerate(items), (50, None), (None, items[3]), (51, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, bench).collect()}
    assert got == {(2000, 0), (2001, 1), (2003, 2)}
    kept = decontam.without_leaks(docs, bench)
    assert kept.count() == docs.count() - 3 and kept.columns == docs.columns
    assert decontam.leaks(nothing, bench).count() == 0 and decontam.leaks(docs, bench.limit(0)).count() == 0


def test_frequent_leaks(spark):
    """Leaks are found where there are few passages, and where their copies hold a third or all of them."""
    r = random.Random(7)
    item = " ".join(f"b{r.randrange(500)}" for _ in range(30)) + "."
    words = item.split(" ")
    reworded = " ".join("other" if i % 4 == 0 else w for i, w in enumerate(words))
    bench = spark.createDataFrame([(0, item), (1, " ".join(f"n{i}" for i in range(400)))], "item_id long, text string")
    noise = lambda n: " ".join(f"n{r.randrange(400)}" for _ in range(n))
    for shown in (item, reworded):
        for copies, others in ((1, 0), (2, 1), (40, 80), (40, 0)):
            rows = [(i, f"{noise(12)} {shown} {noise(12)}") for i in range(copies)] + [(1000 + i, noise(55)) for i in range(others)]
            docs = spark.createDataFrame(rows, "doc_id long, text string")
            got = {x["doc_id"] for x in decontam.leaks(docs, bench).where("item_id = 0").collect()}
            assert got == set(range(copies)), (shown == item, copies, others)


def test_leaks_of_many_items(spark):
    """1,000 items of ordinary words: each is found verbatim, and nearly each with every fourth word replaced."""
    r = random.Random(8)
    texts = [x["text"].split(" ") for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect() if len((x["text"] or "").split()) > 80]
    items, rows = [], []
    for i in range(1000):
        source, n = r.choice(texts), r.randint(15, 59)
        start = r.randrange(len(source) - n)
        item = source[start : start + n]
        items.append((i, " ".join(item)))
        for k, shown in enumerate([item, ["changed" if j % 4 == 0 else w for j, w in enumerate(item)]]):
            around = r.choice(texts)[:300]
            at = r.randrange(len(around))
            rows.append((2 * i + k, " ".join(around[:at] + shown + around[at:])))
    items = [(i, t) for i, t in items if len(decontam.words_of(t)) >= decontam.SHORT]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string").repartition(8), spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontam.leaks(docs, bench).collect()}
    assert [i for i, _ in items if (2 * i, i) not in got] == []
    assert sum((2 * i + 1, i) in got for i, _ in items) >= 0.97 * len(items)


def test_lcs():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], max(row[j + 1], row[j]) if x != y else last + 1
        return row[-1]

    r = random.Random(9)
    for _ in range(300):
        a, b = ([r.choice(b"abcd") for _ in range(r.randint(1, 25))] for _ in range(2))
        masks = {}
        for i, x in enumerate(a):
            masks[x] = masks.get(x, 0) | 1 << i
        assert decontam.lcs(a, masks, b) == plain(a, b)


def test_nearest(spark):
    r = np.random.default_rng(1)
    vectors = [(i, r.standard_normal(12).round(3).tolist()) for i in range(400)]
    vectors[51] = (51, vectors[50][1])
    vectors[52] = (52, vectors[50][1])
    bad = [(600, None), (650, [0.0] * 12), (700, [float("nan")] * 12), (750, [None] + [1.0] * 11), (None, vectors[0][1]), (800, [1.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in vectors + bad], "vec_id long, embedding array<double>, cell string")
    want = brute.nearest(vectors)
    got = {}
    for row in imi.search(df, lambda v: v % 50 == 0, share=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(row["query_id"], []).append((row["vec_id"], row["score"]))
    assert list(got) == [q for q, _ in want]
    for q, best in want:
        assert [i for i, _ in got[q]] == [i for i, _ in best]
        assert np.allclose([s for _, s in got[q]], [s for _, s in best], atol=1e-12)
    assert [i for i, _ in got[50][:2]] == [51, 52]
    found = {(r["query_id"], r["vec_id"]) for r in imi.search(df, lambda v: v % 50 == 0).collect()}
    wanted = {(q, i) for q, best in want for i, _ in best}
    assert len(found & wanted) >= 0.8 * len(wanted)
    assert imi.search(df.limit(0), lambda v: v % 50 == 0).count() == 0
    few = imi.search(df.where(F.col("vec_id") < 3), lambda v: v % 50 == 0, share=1.0)
    assert few.count() == 2


def test_recall_on_the_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").collect()
    want = {(q, i) for q, best in brute.nearest([(r[0], r[1]) for r in rows]) for i, _ in best}
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    found = {(r["query_id"], r["vec_id"]) for r in imi.search(df, lambda v: v % 50 == 0).collect()}
    assert len(found & want) >= 0.9 * len(want)
