"""Personal data: fixed patterns, and a semi-Markov conditional random field for the forms they miss.

Base spans come from four patterns with checks (see ``base_spans``); they always stay. Around every token
that holds a digit, an ``@`` or an at-mark, a region of tokens is cut out. The field scores whole candidate
segments of up to ``MAX_TOKENS`` tokens by features of the complete span (digit count, separators, checksum,
octet range, shape) for each kind, single tokens outside any entity otherwise, and a dynamic programme picks
segments and kinds together. Its spans are added where they overlap no base span.

Training needs no labels by hand: regions of at most ``FIT_DOCS`` documents of up to 20,000 characters (chosen by a hash) with their
base spans as truth, and the same spans rewritten into forms the patterns do not know (no plus sign, a
spelled-out at). The likelihood's gradient comes from the forward-backward sums over all segmentations.

Cases: null and empty texts have no spans; repeated rows give repeated results; a null doc_id stays null;
white space and digits runs of any length take linear time.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigraph.llm.common import give_back, hashed_sample, let_go, map_texts, texts

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is entered at its first digit only; starting inside one can never succeed instead.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TOKEN = re.compile(r"[^\s,;:!?|<>\"']+")
MARK = re.compile(r"[0-9@]|\((?:at)\)|\[(?:at)\]")
FIT_DOCS = 2000
FIT_REGIONS = 4000
MAX_TOKENS = 5
MARGIN = 1.0
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum((2 * d) // 10 + (2 * d) % 10 for d in map(int, digits[-2::-2]))) % 10 == 0


def _emails(text: str) -> list[tuple[int, int, str]]:
    """Every match must hold an ``@``; its local part is the whole run of local characters before it."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            out.append((start, done, "email"))
            at = text.find("@", done)
        else:
            done = max(done, at + 1)
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), leftmost and non-overlapping within a kind, ordered by start, then kind."""
    out = _emails(text) if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
                out.append((m.start(), m.end(), "ip"))
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(DIGIT.findall(m.group())) <= 15:
                    out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def regions(text: str) -> list[list[tuple[int, int]]]:
    """Runs of tokens around marked tokens, one neighbour on either side."""
    if not MARK.search(text):
        return []
    out: list[list[tuple[int, int]]] = []
    last: tuple[int, int] | None = None
    pending = 0
    for m in TOKEN.finditer(text):
        end = m.end()
        while end > m.start() and text[end - 1] == ".":
            end -= 1
        token = (m.start(), end) if end > m.start() else (m.start(), m.end())
        if MARK.search(text, *token):
            if pending == 0:
                out.append([last] if last else [])
            out[-1].append(token)
            pending = 2
        elif pending:
            pending -= 1
            if pending:
                out[-1].append(token)
        last = token
    return out


def span_features(s: str, tokens: int) -> list[str]:
    """Features of a whole candidate span."""
    digits = DIGIT.findall(s)
    n = len(digits)
    letters = sum(c.isalpha() for c in s)
    out = [f"tokens{tokens}", f"digits{min(n, 20)}" if not letters else "mixed", "letters" if letters else "noletters"]
    if "@" in s:
        out.append("at1" if s.count("@") == 1 else "atmany")
        out.append("domain" if re.search(r"@[A-Za-z0-9-]+\.[A-Za-z]", s) else "nodomain")
    if re.search(r"[\[(]at[\])]", s):
        out.append("spelled-domain" if re.fullmatch(r"[\w.+%-]+ ?[\[(]at[\])] ?[\w-]+(\.[\w-]+)+", s) else "spelled")
    if not letters and n:
        out.append("plus" if s[0] == "+" else "paren" if s[0] == "(" else "bare")
        out.append("seps" + "".join(sorted({c for c in s if not c.isdigit()}))[:4])
        out.append("shape" + "-".join(str(len(p)) for p in re.findall(r"[0-9]+", s)[:6]))
        if 10 <= n <= 15:
            out.append("phone-length" + ("+" if s[0] == "+" else ""))
        if 14 <= n <= 19:
            out.append("luhn" if luhn("".join(digits)) else "noluhn")
        parts = s.split(".")
        if len(parts) == 4 and all(p.isdigit() for p in parts):
            out.append("octets" if all(int(p[-4:]) <= 255 for p in parts) else "nooctets")
    return out


class Field:
    """Weights by (feature, kind); kind 0 is outside."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None):
        self.weights = weights or {}

    def scores(self, text: str, tokens: list[tuple[int, int]]) -> dict[tuple[int, int], tuple[list[str], np.ndarray]]:
        """Features and scores per kind of each segment [i, j) of at most MAX_TOKENS tokens."""
        out = {}
        for i in range(len(tokens)):
            for j in range(i + 1, min(i + MAX_TOKENS, len(tokens)) + 1):
                names = span_features(text[tokens[i][0] : tokens[j - 1][1]], j - i)
                total = np.zeros(len(KINDS) + 1)
                for name in names:
                    w = self.weights.get(name)
                    if w is not None:
                        total = total + w
                if j - i > 1:
                    total[0] = -np.inf
                out[i, j] = (names, total)
        return out

    def decode(self, text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
        """The best segmentation's entities whose score beats leaving their tokens outside by MARGIN."""
        n = len(tokens)
        segments = self.scores(text, tokens)
        best, back = np.full(n + 1, -np.inf), [(0, 0)] * (n + 1)
        best[0] = 0
        for (i, j), (_, s) in sorted(segments.items(), key=lambda x: x[0][1]):
            kind = int(np.argmax(s))
            if best[i] + s[kind] > best[j]:
                best[j], back[j] = best[i] + s[kind], (i, kind)
        out, j = [], n
        while j:
            i, kind = back[j]
            if kind and segments[i, j][1][kind] - sum(segments[t, t + 1][1][0] for t in range(i, j)) > MARGIN:
                out.append((tokens[i][0], tokens[j - 1][1], KINDS[kind - 1]))
            j = i
        return out[::-1]

    def step(self, text: str, tokens: list[tuple[int, int]], gold: dict[tuple[int, int], int], rate: float) -> None:
        """One gradient step on the log-likelihood of a region's true segmentation."""
        n = len(tokens)
        segments = self.scores(text, tokens)
        by_end: dict[int, list] = {}
        for (i, j), (_, s) in segments.items():
            by_end.setdefault(j, []).append((i, s))
        fwd, bwd = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        fwd[0] = bwd[n] = 0
        for j in range(1, n + 1):
            fwd[j] = np.logaddexp.reduce([fwd[i] + np.logaddexp.reduce(s) for i, s in by_end[j]])
        for j in range(n, 0, -1):
            for i, s in by_end[j]:
                bwd[i] = np.logaddexp(bwd[i], bwd[j] + np.logaddexp.reduce(s))
        for (i, j), (names, s) in segments.items():
            change = -np.exp(fwd[i] + s + bwd[j] - fwd[n])
            if (i, j) in gold:
                change[gold[i, j]] += 1
            if np.abs(change).max() > 1e-4:
                for name in names:
                    self.weights[name] = self.weights.get(name, np.zeros(len(KINDS) + 1)) + rate * change


def rewritten(kind: str, span: str) -> list[str]:
    """A span in forms that the patterns do not know."""
    if kind == "phone":
        bare = span[1:].lstrip()
        return [bare] + ([bare[bare.index("(") :]] if "(" in bare else [])
    if kind == "email":
        return [span.replace("@", " [at] "), span.replace("@", "(at)")]
    return []


def truth(tokens: list[tuple[int, int]], spans: list[tuple[int, int, str]]) -> dict[tuple[int, int], int] | None:
    """Gold segments of a region; None where a span does not start and end with tokens."""
    starts, ends = {s: i for i, (s, _) in enumerate(tokens)}, {e: i + 1 for i, (_, e) in enumerate(tokens)}
    gold, covered = {}, set()
    for s, e, kind in spans:
        if e <= tokens[0][0] or s >= tokens[-1][1]:
            continue
        i, j = starts.get(s), ends.get(e)
        if i is None or j is None or not 0 < j - i <= MAX_TOKENS or covered & set(range(i, j)):
            return None
        gold[i, j] = KINDS.index(kind) + 1
        covered |= set(range(i, j))
    gold.update({(t, t + 1): 0 for t in range(len(tokens)) if t not in covered})
    return gold


def fit(rows: list[str], epochs: int = 3, rate: float = 0.2, seed: int = 5) -> Field:
    """A field trained on the regions of some texts."""
    samples = []
    for text in rows:
        spans = base_spans(text)
        for tokens in regions(text):
            if len(tokens) > 40:
                continue
            gold = truth(tokens, spans)
            if gold is not None:
                samples.append((text, tokens, gold))
        for s, e, kind in spans:
            for form in rewritten(kind, text[s:e]):
                other = f"so {form} it"
                toks = [(m.start(), m.end()) for m in TOKEN.finditer(other)]
                gold = truth(toks, [(3, 3 + len(form), kind)])
                if gold is not None:
                    samples.append((other, toks, gold))
    rng = np.random.default_rng(seed)
    field = Field()
    samples = [samples[i] for i in rng.permutation(len(samples))[:FIT_REGIONS]]
    for epoch in range(epochs):
        for text, tokens, gold in samples:
            field.step(text, tokens, gold, rate / (1 + epoch))
    return field


def fitted(docs: DataFrame, fit_docs: int = FIT_DOCS) -> Field:
    """A field fitted on at most ``fit_docs`` documents that hold marked tokens."""
    marked = texts(docs).where("text rlike '[0-9@]' and length(text) <= 20000").select("text")
    chosen = hashed_sample(marked, "text", fit_docs).collect()
    return fit([r["text"] for r in chosen])


PIECE, LAP = 400, 50


def all_spans(text: str, field: Field) -> tuple[list, list]:
    """(base spans, base and added spans), each in order."""
    base = base_spans(text)
    added = []
    for tokens in regions(text):
        for start in range(0, max(1, len(tokens) - 2 * LAP), PIECE - 2 * LAP):
            piece = tokens[start : start + PIECE]
            lo, hi = piece[0][0], piece[-1][1]
            near = [b for b in base if b[0] < hi and b[1] > lo]
            if near and sum(b[1] - b[0] for b in near) >= hi - lo:
                continue
            # Pieces overlap; each answers for the spans that begin in its own part, a lap away from its ends.
            own_lo = lo if not start else piece[LAP][0]
            own_hi = hi if start + PIECE >= len(tokens) else piece[PIECE - LAP][0]
            for s, e, kind in field.decode(text, piece):
                if own_lo <= s < own_hi and all(e <= b[0] or s >= b[1] for b in near):
                    added.append((s, e, kind))
    return base, sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def shown(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, e, kind in spans)


def find(docs: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """Counts and digest of base spans, and all spans, of every document."""
    field = fitted(docs, fit_docs)

    def run(ids, rows):
        pairs = [all_spans(t, field) for t in rows]
        out = {"doc_id": ids, "spans": [shown(a) for _, a in pairs]}
        for kind in KINDS:
            out[f"n_{kind}"] = [sum(k == kind for _, _, k in b) for b, _ in pairs]
        out["base_sha256"] = [hashlib.sha256(shown(b).encode()).hexdigest() for b, _ in pairs]
        return out

    return map_texts(docs, run, SCHEMA)


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span replaced by its kind in angle brackets; spans that overlap become one."""
    out, done = [], 0
    for s, e, kind in spans:
        if s >= done:
            out += [text[done:s], f"<{kind.upper()}>"]
        done = max(done, e)
    return "".join(out) + text[done:]


def redact(docs: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """The documents with all columns, personal data masked in ``text`` and ``n_chars``, if there, made to fit; a null text stays null."""
    field = fitted(docs, fit_docs)

    @F.pandas_udf("string")
    def cover(column):
        let_go()
        covered = column.map(lambda t: None if t is None else masked(t, all_spans(t, field)[1]))
        give_back()
        return covered

    out = docs.withColumn("text", cover(F.col("text").cast("string")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
