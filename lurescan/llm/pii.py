"""Personal data by rules and by a semi-Markov conditional random field (operator 10).

Rules give the base spans (email, ip, card, phone), leftmost and non-overlapping for each kind. The field
adds spans the rules miss, such as phone numbers without a plus, spelled-out addresses and secrets.

The field scores whole segments: features of a candidate (its digits, separators, checksum, the word before
it) are weighted for each kind, and a dynamic program over the tokens of a region picks boundaries and kinds
together; an entity has at most ``MAX_TOKENS`` tokens. Regions are the surroundings of digits, at signs,
spelled-out at signs before a spelled-out dot, and key words with a sign, widened to blanks, so plain prose
costs one scan. Weights are fitted by the conditional likelihood (forward and backward sums)
on regions of a bounded sample of the documents, labelled by the rules, by key words before long tokens, and
by rewriting known entities (plus signs dropped, at signs and dots spelled out). An added span must lead the
best reading without it by ``MARGIN``.

Null texts are empty and have no spans. Every row is judged alone; an empty table trains nothing and gives
no rows. Offsets count code points.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
MAX_TOKENS = 14
MARGIN = 2.0
#: regions that the weights are fitted on, at most
SAMPLE_REGIONS = 300

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Around each at sign: the run of local characters before it (not before the last match's end), then
    the domain. That is what a leftmost search finds, without trying every start."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        found = _DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            last = found.end()
            out.append((begin, last))
        at = text.find("@", max(at + 1, last))
    return out


def rule_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE}
    if "@" in text:
        out["email"] = _emails(text)
    if _DIGIT.search(text):
        out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            digits = re.sub("[ -]", "", m.group()) if m.end() - m.start() >= 16 else ""
            if 16 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
        if "+" in text:
            out["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


# --- regions, tokens, candidates ---

_NEAR = 48
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_", re.ASCII)
_KEYWORD = {"token", "secret", "password", "passwd", "apikey", "key", "pwd", "auth"}
_DOT = r"(?:\s?[(\[]dot[)\]]\s?|\sdot\s)"
_TRIGGER = re.compile(
    rf"[0-9@]|(?:\sat\s[A-Za-z0-9-]+{_DOT}|\s?[(\[]at[)\]]\s?[A-Za-z0-9-]+(?:\.|{_DOT}))[A-Za-z0-9-]"
    r"|\b(?:" + "|".join(sorted(_KEYWORD)) + r")\s?[=:]",
    re.IGNORECASE | re.ASCII,
)
_AT_WORD = re.compile(r"\sat\s|[(\[]at[)\]]", re.IGNORECASE)
_BLANK = re.compile(r"\s")
_DOT_BEFORE, _DOT_AFTER = re.compile(rf"{_DOT}$", re.IGNORECASE), re.compile(rf"{_DOT}[A-Za-z0-9-]", re.IGNORECASE)
_ADDRESS = re.compile(rf"[A-Za-z0-9_%+-]+(?:(?:\.|{_DOT})[A-Za-z0-9._%+-]+)*(?:@|\s?[(\[]at[)\]]\s?|\sat\s)[A-Za-z0-9-]+(?:(?:\.|{_DOT})[A-Za-z0-9-]+)+", re.IGNORECASE)
_CALL = {"phone", "tel", "call", "mobile", "fax", "telephone"}


def regions(text: str) -> list[tuple[int, int]]:
    """Surroundings of what ``_TRIGGER`` finds, joined where they overlap, cut at blanks."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - _NEAR), min(len(text), m.end() + _NEAR)
        last = out[-1][1] if out else 0
        if b <= last:
            continue
        while a > last and not text[a - 1].isspace():
            a -= 1
        blank = _BLANK.search(text, b)
        b = blank.start() if blank else len(text)
        if out and a <= last:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def features(text: str, tokens: list[tuple[int, int]], i: int, j: int) -> list[str]:
    """Features of the whole segment of tokens i to j-1; empty where it can't be an entity."""
    begin, end = tokens[i][0], tokens[j - 1][1]
    piece = text[begin:end]
    digits = sum(c.isdigit() for c in piece)
    letters = sum(c.isalpha() for c in piece)
    if not digits and "@" not in piece and not _AT_WORD.search(piece):
        return []
    if not (piece[0].isalnum() or piece[0] in "+(") or not piece[-1].isalnum():
        return []
    glued = (begin > 0 and (text[begin - 1].isalnum() or text[begin - 1] in "._@-+")) or (end < len(text) and (text[end].isalnum() or text[end] == "@"))
    if not glued and ("@" in piece or _AT_WORD.search(piece)):  # a spelled-out dot goes on outside
        glued = bool(_DOT_BEFORE.search(text[max(0, begin - 7) : begin]) or _DOT_AFTER.match(text, end))
    before = [text[a:b].lower() for a, b in tokens[max(0, i - 3) : i]]
    words = j - i
    out = [f"digits={'0' if not digits else '1-6' if digits < 7 else '7-9' if digits < 10 else '10-11' if digits < 12 else '12-15' if digits < 16 else '16-19' if digits < 20 else '20+'}"]
    out.append(f"letters={'none' if not letters else 'some' if letters < digits else 'most'}")
    out.append(f"at={'sign' if piece.count('@') == 1 else 'word' if _AT_WORD.search(piece) else 'none' if '@' not in piece else 'many'}")
    out.append(f"dots={min(piece.count('.') + len(re.findall(_DOT, piece, re.IGNORECASE)), 4)}")
    out.append(f"blanks={min(piece.count(' '), 4)}")
    if glued:
        out.append("glued")
    if piece[0] == "+":
        out.append("plus")
    if re.fullmatch(r"\+?[0-9]{0,3}[ .-]?\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}", piece):
        out.append("grouped")
    if re.fullmatch(r"[0-9]+(\.[0-9]+){3}", piece):
        out.append("quad" if all(int(p) <= 255 for p in piece.split(".")) else "quad over 255")
    if re.fullmatch(r"[0-9]([ -]?[0-9])+", piece) and 16 <= digits <= 19:
        out.append("luhn" if luhn(re.sub("[ -]", "", piece)) else "no luhn")
    if _ADDRESS.fullmatch(piece):
        out.append("address")
    if words == 1 and len(piece) >= 16 and digits and letters:
        out.append("long mixed word" if len(piece) >= 24 else "mixed word")
        if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", piece):
            out.append("hexadecimal")
    if _KEYWORD & set(before):
        out.append("key word" + (" and sign" if before and before[-1] in "=:\"'" else ""))
    if _CALL & set(before):
        out.append("call word")
    return out


class Region:
    """Tokens and candidate segments of a stretch of text."""

    def __init__(self, text: str, offset: int = 0):
        self.text, self.offset = text, offset
        self.tokens = [m.span() for m in _TOKEN.finditer(text)]
        n = len(self.tokens)
        self.candidates = [(i, j, f) for i in range(n) for j in range(i + 1, min(n, i + MAX_TOKENS) + 1) if (f := features(text, self.tokens, i, j))]

    def span(self, i: int, j: int) -> tuple[int, int]:
        return self.tokens[i][0], self.tokens[j - 1][1]


class SemiMarkov:
    """Weights of (feature, kind); tokens outside entities score 0. Kinds beside each other are free."""

    def __init__(self, index: dict[str, int], weights: np.ndarray):
        self.index, self.weights = index, weights

    def scores(self, region: Region) -> list[tuple[int, int, np.ndarray]]:
        return [(i, j, self.weights[[self.index[x] for x in f if x in self.index]].sum(axis=0) + self.weights[-1]) for i, j, f in region.candidates]

    def read(self, region: Region, margin: float = 0.0) -> list[tuple[str, int, int, float]]:
        """Best segmentation: (kind, start, end, lead over the outside reading)."""
        n = len(region.tokens)
        ending: dict[int, list] = {}
        for i, j, s in self.scores(region):
            k = int(s.argmax())
            if s[k] > margin:
                ending.setdefault(j, []).append((i, k, float(s[k])))
        best, back = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            best[j] = best[j - 1]
            for i, k, s in ending.get(j, ()):
                if best[i] + s > best[j]:
                    best[j], back[j] = best[i] + s, (i, k, s)
        out, j = [], n
        while j:
            if back[j]:
                i, k, s = back[j]
                a, b = region.span(i, j)
                out.append((KINDS[k], region.offset + a, region.offset + b, s))
                j = i
            else:
                j -= 1
        return out[::-1]


def fit(samples: list[tuple[str, list[tuple[str, int, int]]]], rounds: int = 60, rate: float = 0.2, penalty: float = 0.002) -> SemiMarkov:
    """Conditional likelihood by gradient ascent (Adam). samples: text and its labelled spans."""
    read = [(Region(text), gold) for text, gold in samples]
    index = {x: i for i, x in enumerate(sorted({x for r, _ in read for _, _, f in r.candidates for x in f}))}
    weights = np.zeros((len(index) + 1, len(KINDS)))
    weights[-1] = -1.0
    prepared = []
    for region, gold in read:
        if not region.candidates:
            continue
        spans = {(a, b): KINDS.index(k) for k, a, b in gold}
        rows = np.zeros((len(region.candidates), len(index) + 1))
        for c, (_, _, f) in enumerate(region.candidates):
            rows[c, [index[x] for x in f]] = 1
            rows[c, -1] = 1
        truth = np.zeros((len(region.candidates), len(KINDS)))
        for c, (i, j, _) in enumerate(region.candidates):
            if region.span(i, j) in spans:
                truth[c, spans[region.span(i, j)]] = 1
        prepared.append((len(region.tokens), [(i, j) for i, j, _ in region.candidates], rows, truth))
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for t in range(1, rounds + 1):
        gradient = -penalty * weights * max(len(prepared), 1)
        for n, where, rows, truth in prepared:
            score = rows @ weights
            segment = np.logaddexp.reduce(score, axis=1).tolist()
            ahead, behind = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
            by_end, by_start = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
            for c, (i, j) in enumerate(where):
                by_end[j].append((i, segment[c]))
                by_start[i].append((j, segment[c]))
            for j in range(1, n + 1):
                terms = [ahead[j - 1], *(ahead[i] + s for i, s in by_end[j])]
                top = max(terms)
                ahead[j] = top + math.log(sum(math.exp(x - top) for x in terms))
            for i in range(n - 1, -1, -1):
                terms = [behind[i + 1], *(behind[j] + s for j, s in by_start[i])]
                top = max(terms)
                behind[i] = top + math.log(sum(math.exp(x - top) for x in terms))
            around = np.array([ahead[i] + behind[j] - ahead[n] for i, j in where])
            gradient += rows.T @ (truth - np.exp(score + around[:, None]))
        gradient /= max(len(prepared), 1)
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        weights += rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return SemiMarkov(index, weights)


def label(text: str) -> list[tuple[str, int, int]]:
    """Training labels: the rules' spans, and long mixed words after a key word and a sign."""
    out = [(k, a, b) for k, spans in rule_spans(text).items() for a, b in spans]
    for m in re.finditer(r"(?i)\b(?:" + "|".join(sorted(_KEYWORD)) + r")\s*[=:]\s*[\"']?([A-Za-z0-9]{16,})", text):
        if re.search("[0-9]", m.group(1)) and not any(a < m.end(1) and m.start(1) < b for _, a, b in out):
            out.append(("secret", *m.span(1)))
    return sorted(out, key=lambda s: s[1])


def rewritten(text: str, gold: list[tuple[str, int, int]], turn: int, digits: bool = True) -> tuple[str, list[tuple[str, int, int]]]:
    """The same entities in another writing, which the rules don't know; ``digits=False``: addresses without digits."""
    out, spans, at = "", [], 0
    for kind, a, b in gold:
        if a < at:
            continue
        piece = text[a:b]
        if kind == "phone":
            piece = re.sub(r"^\+[0-9]{1,3} ?", "", piece) if turn % 2 else piece.lstrip("+")
            piece = piece if piece[:1].isalnum() or piece[:1] in "+(" else piece.lstrip(" .-)")
        elif kind == "email" and not digits:
            sign, dot = ((" at ", " dot "), (" (at) ", "."), (" [at] ", " [dot] "), (" (at) ", " (dot) "))[turn % 4]
            name, host = re.sub("[0-9]", lambda m: "abcdefghij"[int(m.group())], piece).split("@")
            name = name.replace(".", "") if turn // 4 % 2 else name
            host = host if turn // 8 % 2 else ".".join(host.split(".")[-2:])
            piece = name.replace(".", dot) + sign + host.replace(".", dot)
        elif kind == "email":
            piece = piece.replace("@", " at " if turn % 2 else " (at) ").replace(".", " dot ") if turn % 3 else piece.replace("@", " (at) ")
        out += text[at:a]
        if piece:
            spans.append((kind, len(out), len(out) + len(piece)))
        out += piece
        at = b
    return out + text[at:], spans


def train(docs: DataFrame, text: str = "text", sample: int = SAMPLE_REGIONS) -> SemiMarkov:
    """Fits the field on at most ``sample`` regions, the first by hash, as many rewritten ones,
    and those with addresses four times more, with letters for their digits and fewer dots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t[a:b] for v in batch.column(0) if (t := v.as_py()) for a, b in regions(t) if b - a <= 600]
            yield pa.RecordBatch.from_pydict({"region": pa.array(texts, pa.string())})

    found = docs.select(F.col(text)).mapInArrow(run, "region string").distinct()
    chosen = [r.region for r in found.orderBy(F.xxhash64("region"), "region").limit(sample).collect()]
    samples = [(t, label(t)) for t in chosen]
    told = [(t, gold) for t, gold in samples if any(k == "email" for k, _, _ in gold)]
    samples += [rewritten(t, gold, i) for i, (t, gold) in enumerate(samples) if gold]
    samples += [rewritten(t, gold, 5 * i + j, digits=False) for i, (t, gold) in enumerate(told) for j in (0, 1, 6, 11)]
    return fit(samples)


def find(text: str, model: SemiMarkov | None) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]:
    """(base spans by kind, all spans in order of kind and start)."""
    base = rule_spans(text)
    every = [(k, a, b) for k in BASE for a, b in base[k]]
    if model is not None:
        taken = sorted((a, b) for _, a, b in every)
        for a, b in regions(text):
            for kind, x, y, _ in model.read(Region(text[a:b], a), MARGIN):
                if not any(p < y and x < q for p, q in taken):
                    every.append((kind, x, y))
    return base, sorted(every, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


SPANS = "array<struct<kind: string, start: bigint, end: bigint>>"


def scan(docs: DataFrame, id_column: str = "doc_id", text: str = "text", model: SemiMarkov | None = None) -> DataFrame:
    """One row per document: id, base spans, all spans."""
    model = model or train(docs, text)
    index, weights = model.index, model.weights.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = SemiMarkov(index, np.array(weights).reshape(-1, len(KINDS)))
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            base, every = [], []
            for value in batch.column(1):
                b, e = find(value.as_py() or "", reader)
                base.append([{"kind": k, "start": x, "end": y} for k in BASE for x, y in b[k]])
                every.append([{"kind": k, "start": x, "end": y} for k, x, y in e])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, kind), pa.array(every, kind)], [id_column, "base", "spans"])

    shape = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column), F.col(text)).mapInArrow(run, f"`{id_column}` {shape}, base {SPANS}, spans {SPANS}")


def masked(docs: DataFrame, text: str = "text", length: str | None = None, model: SemiMarkov | None = None) -> DataFrame:
    """The documents with every span replaced by ``[KIND]``; ``length`` names a column with the text's length."""
    model = model or train(docs, text)
    index, weights = model.index, model.weights.tolist()
    names = docs.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = SemiMarkov(index, np.array(weights).reshape(-1, len(KINDS)))
        for batch in batches:
            columns = list(batch.columns)
            out = []
            for value in columns[at]:
                told = value.as_py()
                if told:
                    upto, parts = 0, []
                    for kind, a, b in sorted(find(told, reader)[1], key=lambda s: (s[1], -s[2])):
                        if b <= upto:
                            continue
                        parts += [told[upto : max(a, upto)], f"[{kind.upper()}]" if a >= upto else ""]
                        upto = b
                    told = "".join(parts) + told[upto:]
                out.append(told)
            columns[at] = pa.array(out, pa.string())
            if length is not None:
                where = names.index(length)
                sizes = pa.array([None if t is None else len(t) for t in out], batch.schema.field(where).type)
                same = [o if t is not None and t.as_py() == new else s for o, s, t, new in zip(columns[where], sizes, batch.columns[at], out, strict=True)]
                columns[where] = pa.array([x.as_py() for x in same], batch.schema.field(where).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.schema)
