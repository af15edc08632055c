"""Cases that went wrong before: each with the input that showed it."""

import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from verdigraph.llm import blocks, bpe, decontam, imi, jaccard, pii, quality, tokenfile

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
STOP = "the to of is was that a in it and".split()


def test_frequent_words_are_no_leak(spark):
    """An item that half consists of frequent words matches none of 4,000 texts full of them, and each text that holds it."""
    r = random.Random(2)
    rare = [f"r{i}" for i in range(3000)]

    def text(n):
        return [r.choice(STOP) if r.random() < 0.6 else r.choice(rare) for _ in range(n)]

    item = "the key to the north of town is what was hidden that night near old mill".split()
    only = "it was that and it is the of a to in it was the".split()
    rows = [(i, " ".join(text(r.randint(60, 160)))) for i in range(4000)]
    leaks = []
    for k in range(20):
        around = text(120)
        shown = item if k % 2 else [w if j % 4 else "other" for j, w in enumerate(item)]
        leaks.append((5000 + k, " ".join(around[:50] + shown + around[50:])))
    leaks.append((6000, " ".join(text(40) + only + text(40))))
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(only)), (3, " ".join(rare[:30]))], "item_id long, text string")
    docs = spark.createDataFrame(rows + leaks, "doc_id long, text string").repartition(8)
    got = {(x["doc_id"], x["item_id"]) for x in decontam.leaks(docs, bench).collect()}
    assert {d for d, _ in got if d < 5000} == set()
    assert {(d, 1) for d, _ in leaks[:20]} <= got and (6000, 2) in got


def test_added_tokens_are_single_ids(spark):
    library = Tokenizer.from_file(WORD_BPE)
    texts = ["a <|endoftext|> b", "x<|endoftext|>y", "<|startoftext|><|endoftext|>", "<|endoftext", "word <|startoftext|>word", "plain words", "<|ENDOFTEXT|>"] + ["the next one"] * 5
    got = [np.frombuffer(x, "<u2").tolist() for x in tokenfile.encoder(WORD_BPE).encode(texts)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    start = 0
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in sorted(tokenfile.token_table(docs, WORD_BPE).collect()):
        ids = np.array([*library.encode(texts[row["doc_id"]], add_special_tokens=False).ids, 2], "<u4")
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_a_repeated_labelled_row_is_one(spark):
    r = random.Random(1)
    docs = [(i, " ".join(r.choice(["good", "fine"] if i % 2 else ["bad", "poor"]) + str(r.randrange(30)) for _ in range(30))) for i in range(600)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in docs], "doc_id long, quality int, toxic int")
    copied = spark.createDataFrame(docs + [docs[4]] * 7000, "doc_id long, text string").repartition(4)
    rows = quality.training_rows(copied, labels, 3000)
    assert len(rows) <= 600 and {q for q, _, _ in rows} == {0, 1}
    scored = quality.classify(spark.createDataFrame(docs, "doc_id long, text string"), labels).collect()
    held = [x for x in scored if x["held_out"]]
    assert sum(x["predicted"] == x["doc_id"] % 2 for x in held) >= 0.95 * len(held)


def test_one_id_in_most_rows_leaves_a_sample(spark):
    r = random.Random(3)
    rows = [(7, [r.gauss(0, 1) for _ in range(8)]) for _ in range(400)] + [(50, [1.0] * 8), (100, [r.gauss(0, 1) for _ in range(8)])]
    found = imi.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda v: v % 50 == 0, fit_rows=10)
    assert {x["query_id"] for x in found.collect()} == {50, 100}


def test_spans_cross_pieces_of_long_regions():
    rows = [f"so call ({200 + i}) 555-{3000 + i} x or +1 ({200 + i}) 555-{3000 + i}" for i in range(200)] + [f"in {1900 + i} we had {i}.0 of {i}" for i in range(100)]
    field = pii.fit(rows)
    found = {}
    for before in (100, 198, 199, 200, 345, 348, 349, 350, 351, 399, 649, 650, 999):
        head = "1 " * before
        text = head + "(269) 555-3296" + " x" * 3
        found[before] = [(s - len(head), e - len(head)) for s, e, kind in pii.all_spans(text, field)[1] if kind == "phone"]
    assert found[100] and all(f == found[100] for f in found.values()), found


def test_very_long_words():
    """Words around and far over the bound are encoded as the library does, whatever they repeat."""
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(BYTE_BPE), special_tokens={})
    r = random.Random(5)
    alphabets = ["a", "ab", "etaoinshr", "=-", "\n", " ", "éèçü", "ーンのアイウ", [chr(c) for c in range(0x4E00, 0x9FA5)], ["in", "ing", "tion", "st"]]
    rows = ["".join(r.choice(a) for _ in range(n)) for a in alphabets for n in (bpe.PIECE, bpe.LONG, bpe.LONG + 1, 700, 6000)]
    got = bpe.codec(BYTE_BPE, public_tokenizers.PATTERN).encode(rows)
    for row, ids in zip(rows, got):
        assert ids.tolist() == library.encode_ordinary(row), (row[:20], len(row))


def test_a_slice_looks_each_distinct_piece_up_once():
    class Counted(dict):
        looked = 0

        def get(self, key, default=None):
            Counted.looked += 1
            return super().get(key, default)

        def __getitem__(self, key):
            Counted.looked += 1
            return super().__getitem__(key)

    coder = tokenfile.WordEncoder(WORD_BPE)
    coder.pieces = Counted(coder.pieces)
    odd = ["", " ", " a  b ", "don't I'll 'S 's. it's, (foo) \"bar\" é.%! ª, µ. İx Ω.", "a\x85b c", "x<|endoftext|>y", "a\x1cb", "　a. 日本。"]
    rows = [*odd, "one two, Two. " * 500]
    found = coder.encode(rows)
    plain = [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in rows]
    assert [list(memoryview(x).cast("H")) for x in found] == plain
    assert Counted.looked < 100
    assert coder.encode([]) == []


def test_candidates_that_share_too_few_words_are_not_compared():
    """Every passage is near every item here; only those that hold enough of its words are compared, and none that passes is left out."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(2000)]
    texts = [r.choices(words, k=n) for n in (4, 7, 20, 40, 47, 60, 130)]
    compared = []

    class Watched(decontam.Item):
        def compare(self, other):
            compared.append(self.item_id)
            return super().compare(other)

    items = [Watched(k, " ".join(t[:-5]) + ". " + " ".join(t[-5:])) for k, t in enumerate(texts)]
    rows = [" ".join(r.choices(words, k=r.randint(0, 400))) for _ in range(200)] + [""]
    for k, t in enumerate(texts):
        half = [w if i % 10 < 6 or i >= len(t) - 5 else "other" for i, w in enumerate(t)]
        rows += [" ".join(r.choices(words, k=150) + part + r.choices(words, k=n)) for part in (t, half, t[: len(t) * 9 // 20]) for n in (0, 30, 200)]
    vocabulary = {w: decontam.bucket(w) for i in items for w in i.words}
    counts = np.ones(decontam.BUCKETS, dtype=np.int64)
    for item in items:
        item.weigh(counts > 0)
    table, images = np.ones((decontam.BUCKETS, 2), dtype=np.float32), np.ones((len(items), 1), dtype=np.float32)
    judge = decontam.Judge(vocabulary, table, images, items, counts, 1000)
    found = judge.find(rows)
    few = len(compared)
    judge.possible = lambda b, passages, items: np.ones(len(passages), dtype=bool)
    compared.clear()
    assert judge.find(rows) == found and len(found) > 30
    assert few * 5 < len(compared)


def test_hashes_and_their_least_are_found_in_parts():
    """Runs of units hash and compare in parts that fit a cache: the memory taken is that of the result, and the parts' borders do not show."""
    r = np.random.default_rng(7)
    units = r.integers(0, 1 << 62, 1 << 20).astype(np.uint64)
    for fn, size in ((blocks.rolling, 16), (blocks.window_least, 35)):
        tracemalloc.start()
        out = fn(units, size)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 1.5 * out.nbytes
    least = blocks.window_least(units, 35)
    for at in (0, 1, blocks.NEAR - 35, blocks.NEAR - 1, blocks.NEAR, len(least) - 1):
        assert least[at] == at + int(units[at : at + 35].argmin())
    few = r.integers(0, 5, blocks.NEAR + 40).astype(np.uint64)
    for size in (1, 2, 5, 16, 20):
        hashed = blocks.rolling(few, size)
        for at in (0, blocks.NEAR - 1, blocks.NEAR, len(few) - size):
            total = 0
            for x in few[at : at + size].tolist():
                total = (total * int(blocks.BASE) + x) % 2**64
            assert hashed[at] == blocks.mix(np.array([total], dtype=np.uint64))[0]
    assert len(blocks.rolling(few[:3], 4)) == len(blocks.window_least(few[:3], 4)) == 0


def test_documents_meet_the_ids_that_go(spark):
    """Of many documents few go: the ids of those that stay are not sent to the documents, nor are the documents moved for them."""
    text = [" ".join(f"w{(i * 7 + k) % 977}{'x' * (i % 3)}" for k in range(12)) for i in range(400)]
    rows = [(i, t) for i, t in enumerate(text)]
    rows += [(1000, text[3]), (1001, text[5] + " more"), (7, text[7]), (8, "another text of id eight"), (9, text[4]), (1000, text[3]), (None, text[3]), (None, text[3]), (2000, None), (2001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    links = {(r["doc_id"], r["component_id"]) for r in jaccard.link(docs).collect()}
    stay = {d for d, c in links if d == c}
    kept = jaccard.one_of_each(docs)
    expected = sorted({(d, t or "") for d, t in rows if d in stay}) + [(None, text[3])] * 2
    got = [(r["doc_id"], r["text"] or "") for r in kept.collect()]
    assert sorted((g for g in got if g[0] is not None)) + [g for g in got if g[0] is None] == expected
    assert 1000 not in stay and {2000, 2001, 7, 8, 9} <= stay
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "LeftSemi" not in plan
