"""Byte-level BPE by recursive DuckDB queries inside each partition.

Every match of the pattern is encoded on its own. Its bytes become token-position rows (word, position,
token, next position, next token). A recursive query joins neighbouring tokens with the merge table,
contracts each word's leftmost pair of least rank, and repeats until no word has a pair left. Decoding
joins (document, position, token) rows with the vocabulary and puts the pieces together by an ordered
aggregation.

Words repeat, so each Python worker keeps what it has encoded, up to a fixed number of entries. A query
runs at most ``STEPS`` rounds before its rows are handed to the next one, so its memory follows the words
at hand.

A word takes a round a contraction, so a word of more than ``LONG`` bytes is encoded in pieces side by side. A list
of tokens is the encoding of its text exactly if every two neighbours encode to themselves: a contraction over
a border would be the first one there for those two alone as well. So the borders of the pieces are
encoded too; where one does not hold, the tokens around it are encoded together, twice as many each time.

Cases: null and empty texts have no tokens; a repeated row gives a repeated result; a null doc_id stays null.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Generator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from verdigraph.llm.common import hold, map_texts

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
STEPS = 64
QUERY_BYTES, QUERY_ROWS = 400_000, 3_000_000
LONG, PIECE, REACH = 128, 64, 4
# Entries a worker keeps; what comes later, when the frequent words are in, is kept for its slice alone.
KEPT_WORDS, KEPT_PIECES = 400_000, 300_000
DECODE_TOKENS = 500_000
SPACE = re.compile(r"\s")

MERGE_SQL = f"""
WITH RECURSIVE s AS (
  SELECT w, pos, id, npos, nid, 0 AS step FROM src
  UNION ALL
  SELECT s.w, s.pos,
    CASE WHEN s.pos = b.pos THEN b.merged ELSE s.id END,
    CASE WHEN s.pos = b.pos THEN b.after_pos ELSE s.npos END,
    CASE WHEN s.pos = b.pos THEN b.after_id WHEN s.npos = b.pos THEN b.merged ELSE s.nid END,
    s.step + 1
  FROM s JOIN (
    SELECT c.w, c.pos, c.merged, g.pos AS gone, g.npos AS after_pos, g.nid AS after_id
    FROM (
      SELECT w, (min(k) & 4294967295)::INTEGER AS pos, (min(k) >> 32)::INTEGER AS merged, arg_min(npos, k) AS gone
      FROM (SELECT p.w, (m.merged::BIGINT << 32) + p.pos AS k, p.npos
            FROM s p JOIN merges m ON m.pair = (p.id::BIGINT << 32) + p.nid WHERE p.step < {STEPS})
      GROUP BY w) c
    JOIN s g ON g.pos = c.gone) b ON s.w = b.w
  WHERE s.pos <> b.gone
), fin AS (SELECT w, max(step) AS step FROM s GROUP BY w)
SELECT w, pos, id, npos, nid, step FROM s JOIN fin USING (w, step) ORDER BY pos
"""
# One thread: the aggregation takes the rows in the order of the inner query.
DECODE_SQL = """SELECT doc, string_agg(piece, '') AS text
FROM (SELECT doc, pos, piece FROM ids JOIN vocab USING (id) ORDER BY doc, pos) GROUP BY doc"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec:
    """Merge table and vocabulary in one in-process database, with the words encoded so far."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        ranks = read_ranks(path)
        self.pattern = regex.compile(pattern)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        merges = np.array(
            [(ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks],
            dtype=np.int64,
        ).reshape(-1, 2)
        ids = list(ranks.values())
        self.names = {i: str(i) for i in ids}
        self.tokens = {r: t for t, r in ranks.items()}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        self._load("merges", {"pair": merges[:, 0], "merged": merges[:, 1].astype(np.int32)})
        # A byte stands as the character of its number; 0 as 256, since a text may end at a zero.
        pieces = ["".join(chr(b or 256) for b in token) for token in ranks]
        self._load("vocab", {"id": np.array(ids, dtype=np.int32), "piece": pieces})
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes | None] = {}
        self.odd = False

    def _load(self, name: str, columns: dict) -> None:
        self.db.register("loading", pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM loading")
        self.db.unregister("loading")

    def _merge(self, rows: pa.Table) -> pa.Table:
        self.db.register("src", rows)
        out = self.db.sql(MERGE_SQL).to_arrow_table()
        self.db.unregister("src")
        return out

    def _contract(self, raw: list[bytes]) -> list[bytes]:
        """Token ids (int32) of each byte string, each for itself."""
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        ends = np.cumsum(sizes)
        n = int(ends[-1])
        ids = self.byte_ids[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        nxt, nid = np.arange(1, n + 1, dtype=np.int32), np.append(ids[1:], np.int32(-1))
        nxt[ends - 1] = nid[ends - 1] = -1
        rows = pa.table({"w": np.repeat(np.arange(len(raw), dtype=np.int32), sizes), "pos": np.arange(n, dtype=np.int32), "id": ids, "npos": nxt, "nid": nid})
        done_w, done_id = [], []
        while rows.num_rows:
            out = self._merge(rows)
            more = out["step"].to_numpy() == STEPS
            done_w.append(out["w"].to_numpy()[~more])
            done_id.append(out["id"].to_numpy()[~more])
            rows = out.filter(pa.array(more)).drop_columns(["step"])
        w, tokens = np.concatenate(done_w), np.concatenate(done_id)
        order = np.argsort(w, kind="stable")
        cuts = (4 * np.searchsorted(w[order], np.arange(len(raw) + 1))).tolist()
        data = tokens[order].astype(np.int32).tobytes()
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]

    def _contract_all(self, raw: list[bytes]) -> list[bytes]:
        """``_contract`` of any number of byte strings: a query holds the rows of all its rounds, about ``QUERY_ROWS``."""
        out: list[bytes] = []
        start = held = 0
        for i, r in enumerate(raw):
            held += len(r) * min(len(r), STEPS)
            if held >= QUERY_ROWS or i == len(raw) - 1:
                out += self._contract(raw[start : i + 1])
                start, held = i + 1, 0
        return out

    def _contract_long(self, raw: bytes) -> Generator[list[bytes], list[bytes], bytes]:
        """Token ids of one long byte string: pieces, then the tokens around every border that does not hold.

        Yields byte strings and is sent their tokens, so that many strings share a query.
        """
        parts = [np.frombuffer(p, dtype=np.int32) for p in (yield [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)])]
        reach = REACH
        borders = np.cumsum([len(p) for p in parts])[:-1]
        ids = np.concatenate(parts)
        while len(borders):
            pairs, where = np.unique(np.stack([ids[borders - 1], ids[borders]], axis=1), axis=0, return_inverse=True)
            both = yield [self.tokens[a] + self.tokens[b] for a, b in pairs.tolist()]
            holds = np.array([data == pair.tobytes() for data, pair in zip(both, pairs)])
            windows: list[list[int]] = []
            for b in borders[~holds[where.ravel()]].tolist():
                low, high = max(0, b - reach), min(len(ids), b + reach)
                if windows and low <= windows[-1][1]:
                    windows[-1][1] = high
                else:
                    windows.append([low, high])
            again = yield [b"".join(map(self.tokens.__getitem__, ids[low:high].tolist())) for low, high in windows]
            parts, edges, done, size = [], [], 0, 0
            for (low, high), data in zip(windows, again):
                new = np.frombuffer(data, dtype=np.int32)
                parts += [ids[done:low], new]
                edges += [size + low - done, size + low - done + len(new)]
                size, done = edges[-1], high
            parts.append(ids[done:])
            ids = np.concatenate(parts)
            borders = np.array([e for e in edges if 0 < e < len(ids)], dtype=np.int64)
            reach *= 2
        return ids.tobytes()

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Token ids (int32) of each word, every word one match of the pattern."""
        raw = [w.encode() for w in words]
        short = iter(self._contract_all([r for r in raw if len(r) <= LONG]))
        jobs = {i: self._contract_long(r) for i, r in enumerate(raw) if len(r) > LONG}
        asked, done = {i: next(job) for i, job in jobs.items()}, {}
        while asked:
            wanted = list(dict.fromkeys(chain.from_iterable(asked.values())))
            known = dict(zip(wanted, self._contract_all(wanted)))
            for i, strings in list(asked.items()):
                try:
                    asked[i] = jobs[i].send([known[x] for x in strings])
                except StopIteration as end:
                    done[i] = end.value
                    del asked[i]
        return [done[i] if i in done else next(short) for i in range(len(raw))]

    def _learn(self, words: set[str]) -> set[str]:
        """Encode the words not yet held, and name them."""
        missing = words - self.words.keys()
        batch, held = [], 0
        for word in sorted(missing):
            batch.append(word)
            held += len(word)
            if held >= QUERY_BYTES:
                self.words.update(zip(batch, self.encode_words(batch)))
                batch, held = [], 0
        if batch:
            self.words.update(zip(batch, self.encode_words(batch)))
        return missing

    def _matches(self, piece: str) -> list[str] | None:
        """Matches in a blank and the piece; None if the piece may not stand alone."""
        if piece.isalpha():
            return [" " + piece]
        if piece[:-1].isalpha() and piece[-1] in ".,":
            return [" " + piece[:-1], piece[-1]]
        if not piece or SPACE.match(piece[0]) or SPACE.match(piece[-1]):
            return None
        return self.pattern.findall(" " + piece)

    def encode(self, rows: list[str]) -> list[np.ndarray]:
        """Token ids of each text.

        A blank between two characters that are no white space always starts a match, so the pieces after
        such blanks encode alone; texts with other white space at a blank are matched as a whole.
        """
        cut = [t.split(" ") for t in rows]
        used = set().union(*[c[1:] for c in cut])
        fresh = used - self.pieces.keys()
        found = {p: self._matches(p) for p in fresh}
        kept = self.pieces
        kept.update((p, None) for p, m in found.items() if m is None)
        get = kept.get
        self.odd = self.odd or None in found.values()
        whole = [
            i for i, c in enumerate(cut)
            if c[0] and SPACE.match(c[0][-1]) or self.odd and any(kept.get(p, b"") is None for p in c[1:])
        ]
        heads = {i: self.pattern.findall(c[0]) for i, c in enumerate(cut)}
        heads.update((i, self.pattern.findall(rows[i])) for i in whole)
        learned = self._learn(set().union(*heads.values(), *[m for m in found.values() if m]))
        word = self.words.__getitem__
        kept.update((p, b"".join(map(word, m))) for p, m in found.items() if m)
        out = []
        skip = set(whole)
        for i, c in enumerate(cut):
            data = b"".join(map(word, heads[i]))
            if i not in skip:
                data += b"".join(map(get, c[1:]))
            out.append(np.frombuffer(data, dtype=np.int32))
        for held, new, most in ((kept, fresh, KEPT_PIECES), (self.words, learned, KEPT_WORDS)):
            if len(held) > most:
                for p in new:
                    del held[p]
        return out

    def decode(self, encoded: list[np.ndarray]) -> list[bytes]:
        """Bytes of each id list."""
        out: list[bytes] = [b""] * len(encoded)
        start = 0
        while start < len(encoded):
            end, held = start, 0
            while end < len(encoded) and (held == 0 or held + len(encoded[end]) <= DECODE_TOKENS):
                held += len(encoded[end])
                end += 1
            doc = np.repeat(np.arange(start, end, dtype=np.int32), [len(e) for e in encoded[start:end]])
            ids = np.concatenate(encoded[start:end])
            self.db.register("ids", pa.table({"doc": doc, "pos": np.arange(len(ids), dtype=np.int32), "id": ids}))
            for d, text in self.db.sql(DECODE_SQL).fetchall():
                out[d] = text.replace("Ā", "\0").encode("latin-1")
            self.db.unregister("ids")
            start = end
        return out

    def shown(self, ids: np.ndarray) -> str:
        """The ids as decimal numbers with blanks between."""
        return " ".join(map(self.names.__getitem__, ids.tolist()))


def codec(path: str, pattern: str) -> Codec:
    return hold(Codec, path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded_sha256: token ids of every text, and the digest of the bytes they decode to."""

    def run(ids, rows):
        coder = codec(path, pattern)
        encoded = coder.encode(rows)
        decoded = [hashlib.sha256(d).hexdigest() for d in coder.decode(encoded)]
        return {"doc_id": ids, "n_tokens": [len(e) for e in encoded], "ids": encoded, "decoded_sha256": decoded}

    return map_texts(docs, run, "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string", holds=True)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: ids of every text, and the bytes they decode to."""

    def sha(data: bytes) -> str:
        return hashlib.sha256(data).hexdigest()

    def run(ids, rows):
        coder = codec(path, pattern)
        encoded = coder.encode(rows)
        return {
            "doc_id": ids,
            "n_tokens": [len(e) for e in encoded],
            "ids_sha256": [sha(coder.shown(e).encode()) for e in encoded],
            "decoded_sha256": [sha(d) for d in coder.decode(encoded)],
        }

    return map_texts(docs, run, SCHEMA, holds=True)
