"""Personal data by fixed patterns and a semi-Markov conditional random field.

The patterns (email, ip, card, phone) give the base spans.  They are greedy, so values that stand side by side swallow
one another and fail, and they know one way to write each kind.  The random field looks at every region of digits and
phone punctuation, of characters around an ``@``, and of words around an ``@`` that is set apart or spelt out: a
segmentation into typed spans and single tokens is scored by features of *whole spans* (groups of digits, check digit,
separators, what stands on either side), and dynamic programming over spans of at most ``MOST_TOKENS`` tokens picks
boundaries and types jointly.  Spans that overlap no base span are added: neighbours that swallowed one another, national
and trunk-dialled phone numbers, disguised addresses.

The weights maximise the conditional likelihood of regions whose segmentation is known: a bounded sample of the corpus's
regions in which base spans account for all that matters, pairs of them written side by side, and values made up in the
ways that the patterns don't know, beside dates, amounts, versions and plain numbers that are no personal data.

Defined cases: a null text is empty and has no span; equal rows give equal rows; positions are code points, the end
exclusive; with no region to learn from, the field knows the made-up ones alone; other columns are kept.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclake.llm.common import plain, saved, strings, with_made

KINDS = ("email", "ip", "card", "phone")
MOST_TOKENS = 24
#: Regions that the weights are learned from: the bound of the sample.
SAMPLE = 1200
#: Values made up to learn from.
MADE_UP = 600

Span = tuple[str, int, int]

_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_REGION = re.compile(r"[+(]*[0-9][\x20().+0-9-]*")
_TOKEN = re.compile(r"[0-9]+|\x20+|[A-Za-z%_]+|.", re.DOTALL)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping; time is linear in the text."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            found.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return found


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns by start, then kind."""
    found = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    for m in _DOTTED.finditer(text):
        if text.count(".", m.start(), m.end()) >= 3:
            at, parts = m.start(), m.group().split(".")
            for i in range(0, len(parts) - 3, 4):
                quad = parts[i : i + 4]
                end = at + sum(map(len, quad)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in quad):
                    found.append(("ip", at, end))
                at = end + 1
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append(("phone", m.start(), m.end()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


#: An @ that is set apart or spelt out, and what must follow it; characters before it that may be the name.
_AT = re.compile(r"\x20?[\[({]\x20?(?:at|@)\x20?[\])}]\x20?|\x20(?:at|@)\x20", re.IGNORECASE)
_DOT = r"(?:\x20?[\[({]\x20?(?:dot|\.)\x20?[\])}]\x20?|\x20dot\x20|\.)"
_HOST = re.compile(rf"[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,4}}", re.IGNORECASE)
_DOTS = re.compile(_DOT, re.IGNORECASE)
MOST_NAME = 64


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches of digits and phone punctuation with at least seven digits, and of address characters around an @, by start."""
    found = []
    for m in _REGION.finditer(text):
        raw = m.group().rstrip(" (+-.")
        if len(raw) >= 7 and sum(map(str.isdigit, raw)) >= 7:
            found.append((m.start(), m.start() + len(raw)))
    at = text.find("@")
    while at >= 0:
        a = b = at
        while a > 0 and text[a - 1] in _LOCAL:
            a -= 1
        while b + 1 < len(text) and (text[b + 1] in _LOCAL or text[b + 1] == "@"):
            b += 1
        found.append((a, b + 1))
        at = text.find("@", b + 1)
    for m in _AT.finditer(text):
        a, host = m.start(), _HOST.match(text, m.end())
        while host and a > max(0, m.start() - MOST_NAME) and text[a - 1] in _LOCAL:
            a -= 1
        # prose has "at" before sentences; an address spells its dots out too, or sets the @ apart by brackets
        if host and a < m.start() and (m.group().strip().lower() != "at" or "dot" in host.group().lower()):
            found.append((a, host.end()))
    return sorted(found)


#: Features of a whole span, for each kind; a token outside any span has one of its own.
_SHAPES = ("on", "ok", "bad", "plus", "paren", "solid", "grouped", "mixed", "cut_left", "cut_right", "spaced", "short", "long", "edge_sep", "national", "trunk", "disguised")
FEATURES = [f"{k}/{s}" for k in KINDS for s in _SHAPES] + ["out/digits", "out/other", "out/word"]
_INDEX = {f: i for i, f in enumerate(FEATURES)}


def _span_features(kind: str, text: str, before: str, after: str) -> list[int] | None:
    """Features of the span ``text`` as ``kind``; None if its characters can't be one."""
    digits = re.sub("[^0-9]", "", text)
    if kind != "email" and (before.isalnum() or after.isalnum()):  # a piece of a word or of a longer number
        return None
    if kind == "email":
        if not text[0].isalnum():
            return None
        given = text
        if (m := _AT.search(text)) is not None:
            text = text[: m.start()] + "@" + _DOTS.sub(".", text[m.end() :])
        if text.count("@") != 1:
            return None
        ok, short, long = bool(_DOMAIN.fullmatch(text, text.index("@"))), len(text) < 6, len(text) > 254
    elif kind == "ip":
        parts = text.split(".")
        if len(parts) != 4 or not all(p.isdigit() for p in parts):
            return None
        ok, short, long = all(len(p) <= 3 and int(p) <= 255 for p in parts), False, any(len(p) > 3 for p in parts)
    elif kind == "card":
        if not 12 <= len(digits) <= 19 or not _CARD.fullmatch(text):
            return None
        ok, short, long = luhn(digits), len(digits) < 14, len(digits) > 16
    else:
        if not (text[0] in "+(" or text[0].isdigit()) or not text[-1].isdigit() or "+" in text[1:] or text.count("(") != text.count(")"):
            return None
        if not 9 <= len(digits) <= 15:
            return None
        ok, short, long = text[0] == "+", len(digits) < 10, len(digits) > 13
    groups = [*map(len, re.findall("[0-9]+", text))]
    seps = set(re.sub("[0-9A-Za-z]", "", text))
    names = ["on", "ok" if ok else "bad"]
    names += [n for n, t in (("plus", text[0] == "+"), ("paren", "(" in text), ("solid", len(groups) == 1), ("grouped", len(groups) > 2 and max(groups) <= 4), ("mixed", len(seps) > 2), ("cut_left", before.isalnum()), ("cut_right", after.isalnum()), ("spaced", before in ("", " ") and after in ("", " ", ".", ",")), ("short", short), ("long", long), ("edge_sep", before in tuple(".-+") or after == "-"), ("national", kind == "phone" and groups == [3, 3, 4]), ("trunk", kind == "phone" and text.startswith("00")), ("disguised", kind == "email" and text != given)) if t]
    return [_INDEX[f"{kind}/{n}"] for n in names]


Candidate = tuple[int, int, int, list[int]]  # tokens [i, j), label, features


def lattice(region: str, before: str = "", after: str = "") -> tuple[list[int], list[list[Candidate]]]:
    """Token offsets and, for each token, the labelled segments that start there (label -1: outside)."""
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(region)]
    at = [a for a, _ in tokens] + [len(region)]
    starts: list[list[Candidate]] = []
    for i, (a, b) in enumerate(tokens):
        first = region[a]
        here: list[Candidate] = [(i, i + 1, -1, [_INDEX["out/digits" if first.isdigit() else "out/word" if first.isalpha() else "out/other"]])]
        if first.isalnum() or first in "+(%_":
            for j in range(i + 1, min(len(tokens), i + MOST_TOKENS) + 1):
                last = region[at[j] - 1]
                if not last.isalnum():
                    continue
                text = region[a : at[j]]
                left, right = region[a - 1] if a else before, region[at[j]] if at[j] < len(region) else after
                for k, kind in enumerate(KINDS):
                    if (f := _span_features(kind, text, left, right)) is not None:
                        here.append((i, j, k, f))
        starts.append(here)
    return at, starts


@dataclass(frozen=True)
class SpanField:
    weights: np.ndarray

    def best(self, region: str, before: str = "", after: str = "") -> list[Span]:
        """The segments of the most probable segmentation."""
        at, starts = lattice(region, before, after)
        n = len(starts)
        score, back = [-np.inf] * (n + 1), [None] * (n + 1)
        score[0] = 0.0
        for i in range(n):
            for c in starts[i]:
                s = score[i] + sum(self.weights[f] for f in c[3])
                if s > score[c[1]]:
                    score[c[1]], back[c[1]] = s, c
        spans, j = [], n
        while j:
            i, _, k, _ = back[j]
            if k >= 0:
                spans.append((KINDS[k], at[i], at[j]))
            j = i
        return spans[::-1]

    def spans(self, text: str) -> list[Span]:
        """Base spans, and those of the field that overlap none; time is linear in the text but for the sorting."""
        found = base_spans(text)
        starts, ends = [a for _, a, _ in found], [*accumulate((b for _, _, b in found), max)]
        more: list[Span] = []

        def furthest(before: int) -> int:
            """The furthest end of the base spans that start before a place."""
            i = bisect_left(starts, before)
            return ends[i - 1] if i else -1

        for a, b in regions(text):
            if furthest(a + 1) < b:
                more += [(kind, a + s, a + e) for kind, s, e in self.best(text[a:b], text[a - 1 : a], text[b : b + 1]) if furthest(a + e) <= a + s]
        free = 0
        for kind, a, b in sorted(more, key=lambda s: (s[1], -s[2])):
            if a >= free:
                found.append((kind, a, b))
                free = b
        return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _gradient(weights: np.ndarray, starts: list[list[Candidate]], gold: dict[tuple[int, int], int], grad: np.ndarray) -> float:
    """Add the gradient of the log-likelihood of the gold segmentation; returns that log-likelihood."""
    n = len(starts)
    scores = [[sum(weights[f] for f in c[3]) for c in here] for here in starts]
    alpha, beta = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    alpha[0], beta[n] = 0.0, 0.0
    for i in range(n):
        for c, s in zip(starts[i], scores[i], strict=True):
            alpha[c[1]] = np.logaddexp(alpha[c[1]], alpha[i] + s)
    for i in range(n - 1, -1, -1):
        for c, s in zip(starts[i], scores[i], strict=True):
            beta[i] = np.logaddexp(beta[i], beta[c[1]] + s)
    covered, reached = {t for i, j in gold for t in range(i, j)}, 0.0
    for i in range(n):
        for c, s in zip(starts[i], scores[i], strict=True):
            p = np.exp(alpha[i] + s + beta[c[1]] - alpha[n])
            right = gold.get((i, c[1])) == c[2] if c[2] >= 0 else i not in covered
            reached += s * right
            for f in c[3]:
                grad[f] += right - p
    return reached - alpha[n]


def train(examples: list[tuple[str, list[Span]]], steps: int = 60, rate: float = 0.3, ridge: float = 1e-3) -> SpanField:
    """Maximum likelihood by Adagrad over regions with their spans."""
    weights, seen = np.zeros(len(FEATURES)), np.full(len(FEATURES), 1e-6)
    known = []
    for region, spans in examples:
        at, starts = lattice(region)
        token = {a: i for i, a in enumerate(at)}
        if all(a in token and b in token for _, a, b in spans):
            known.append((starts, {(token[a], token[b]): KINDS.index(k) for k, a, b in spans}))
    for step in range(steps if known else 0):
        grad = np.zeros(len(FEATURES))
        for starts, gold in known[step % 4 :: 4]:
            _gradient(weights, starts, gold, grad)
        grad = grad / len(known) * 4 - ridge * weights
        seen += grad**2
        weights += rate * grad / np.sqrt(seen)
    return SpanField(weights)


def _known(texts: list[str]) -> Iterator[tuple[str, list[Span]]]:
    """Regions whose base spans lie inside and don't overlap, with these spans."""
    for t in texts:
        spans = base_spans(t)
        for a, b in regions(t):
            own = [(k, s - a, e - a) for k, s, e in spans if s < b and a < e]
            if all(0 <= s and e <= b - a for _, s, e in own) and all(x[2] <= y[1] for x, y in zip(own, own[1:], strict=False)) and b - a <= 80:
                left = sum(map(str.isdigit, t[a:b])) - sum(sum(map(str.isdigit, t[a + s : a + e])) for _, s, e in own)
                if left < 7 or not own:  # else something in it may have failed because of its neighbour
                    yield t[a:b], own


def made_up(n: int, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """Regions in ways that the patterns don't know, with their spans; and others without one."""
    draw, out = random.Random(seed), []
    digits = lambda k: str(draw.randrange(10 ** (k - 1), 10**k))
    name = lambda: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randrange(2, 9)))
    phones = [lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"{digits(3)}-{digits(3)}-{digits(4)}", lambda: f"{digits(3)}.{digits(3)}.{digits(4)}", lambda: f"{digits(3)} {digits(3)} {digits(4)}", lambda: f"00{digits(2)} {digits(2)} {digits(3)} {digits(4)}", lambda: f"00{digits(2)}-{digits(3)}-{digits(6)}"]
    mails = [lambda: f"{name()}.{name()} [at] {name()} [dot] com", lambda: f"{name()} at {name()} dot org", lambda: f"{name()} (at) {name()}.{name()}.net", lambda: f"{name()} @ {name()}.com", lambda: f"{name()}{digits(2)}[at]{name()}[dot]de"]
    others = [lambda: f"{draw.randrange(1900, 2100)}-{draw.randrange(10, 13)}-{draw.randrange(10, 29)} {draw.randrange(10, 24)}", lambda: f"{draw.randrange(1, 29)}.{draw.randrange(1, 13)}.{draw.randrange(1900, 2100)} {digits(4)}", lambda: digits(draw.randrange(7, 21)), lambda: f"{digits(1)} {digits(3)} {digits(3)} {digits(3)}", lambda: f"{digits(1)}.{digits(draw.randrange(7, 12))}", lambda: "-".join(digits(1) for _ in range(draw.randrange(7, 14))), lambda: ".".join(digits(draw.randrange(1, 3)) for _ in range(6)), lambda: f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", lambda: f"{digits(4)} {digits(4)} {digits(4)}", lambda: f"{digits(5)}-{digits(4)} {digits(2)}"]
    while len(out) < n:
        kind, ways = draw.choice((("phone", phones), ("email", mails), ("", others)))
        region = draw.choice(ways)()
        if not base_spans(region):
            out.append((region, [(kind, 0, len(region))] if kind else []))
    return out


def fit(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> SpanField:
    """Learn from a hashed sample of at most ``sample`` distinct regions of ``docs``."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {(r, written(s)) for r, s in _known(strings(batch.column(0)))}
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.string()), pa.array([s for _, s in rows], pa.string())], ["region", "spans"])

    looks = F.col(text).rlike("@|[0-9]([^A-Za-z]{0,8}[0-9]){6}")
    found = saved(docs.where(looks).select(F.col(text).alias("t")).mapInArrow(find, "region string, spans string").distinct(), "regions")
    kind = F.split("spans", ":")[0]  # as many of each kind, and of none
    rows = []
    for k in (*KINDS, ""):
        rows += [(r["region"], r["spans"]) for r in found.where(kind == k).orderBy(F.xxhash64("region", "spans"), "region", "spans").limit(sample // 5).collect()]
    examples = [(r, [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in s.split(",") if x)]) for r, s in rows]
    drawn = np.random.default_rng(7)
    joined = []
    for i, j in drawn.integers(0, max(1, len(examples)), (len(examples), 2)) if examples else []:
        (r, s), (q, u) = examples[i], examples[j]
        joined.append((f"{r} {q}", s + [(k, a + len(r) + 1, b + len(r) + 1) for k, a, b in u]))
    return train(examples + joined + made_up(MADE_UP))


def detect(docs: DataFrame, model: SpanField, text: str = "text") -> DataFrame:
    """``docs`` with counts of base spans, base_sha256 and spans."""

    def made(column: pa.Array) -> list[pa.Array]:
        texts = strings(column)
        base, every = [base_spans(t) for t in texts], [model.spans(t) for t in texts]
        counts = [pa.array([sum(k == kind for k, _, _ in s) for s in base], pa.int64()) for kind in KINDS]
        return [*counts, pa.array([hashlib.sha256(written(s).encode()).hexdigest() for s in base], pa.string()), pa.array([written(s) for s in every], pa.string())]

    return with_made(docs, text, [*((f"n_{k}", "long") for k in KINDS), ("base_sha256", "string"), ("spans", "string")], made)


def masked(text: str, spans: list[Span]) -> str:
    """``text`` with each span replaced by its kind in angle brackets; of overlapping spans the first names the whole."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, model: SpanField, text: str = "text") -> DataFrame:
    """``docs`` with the spans of its texts masked; null texts stay null."""

    def made(column: pa.Array) -> list[pa.Array]:
        return [pa.array([None if t is None else masked(t, model.spans(t)) for t in column.to_pylist()], pa.string())]

    i = docs.columns.index(text)
    out = with_made(docs, text, [(text, "string")], made)  # the masked text comes last, so put it back in its place
    return plain(out).select(*[f"c{n - (n > i)}" if n != i else f"c{len(docs.columns) - 1}" for n in range(len(docs.columns))]).toDF(*docs.columns)
