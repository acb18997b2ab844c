"""Toxicity by a counterfactual-regularised linear classifier.

Features are the presence of words and of their first four, five and six letters, hashed.  A first pass over the
labelled texts counts features by label and keeps those tied to the label; logistic regression then weighs them, with

* an l1 penalty, so that a weight needs evidence, and
* a counterfactual penalty: each labelled text that names a group is paired with copies that name other groups
  instead, and the squared change of the score between them is added to the loss.  As few texts name a group by
  themselves, one labelled text in ``MENTION_EVERY``, drawn by a hash of the text, is also learned from, with its label,
  with a neutral sentence about a group added to it; this copy is paired with those about other groups.  And for every
  group that a toxic text names, some clean text is learned from with a neutral sentence about that group.

A neutral mention of a group thus can't carry the score: it comes with both labels, and weights of group terms, and of
words that only travel with one of them, are pulled together.

Defined cases: a null or empty text gets the score of a text without known features; rows without a label, or with
one that contradicts a duplicate, count by their largest label; with no label of either kind to learn from, all scores
are the share of toxic labels (0.5 without labels); other columns of the input are kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclake.llm.common import char_class, chunks_of, codepoints, mix, run_hashes, runs, saved, strings, with_made

BUCKETS = 1 << 20
PREFIXES = (4, 5, 6)
#: Labelled texts to learn from, drawn by a hash of the key: the bound of the sample.
SAMPLE = 60_000
#: Characters of the sample, which bound what of it the driver holds.
SAMPLE_CHARS = 80_000_000
#: A feature is kept if at least so many texts have it and its z-score against the label is at least this.
LEAST_TEXTS = 6
LEAST_Z = 4.0

# Names of groups in each language; terms of a line may stand for one another.
IDENTITY = (
    ("women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual", "homosexual", "queer"),
    ("black", "white", "asian", "hispanic", "african", "european", "arab", "latino"),
    ("immigrants", "refugees", "foreigners", "locals", "natives"),
    ("disabled", "blind", "deaf", "elderly", "young", "old"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)
_OTHERS = {w: [v for v in line if v != w] for line in IDENTITY for w in line}
#: Copies made of a text that names a group.
SWAPS = 2
#: Neutral sentences about a group, and how many labelled texts there are for each that one is added to.
NEUTRAL = ("Some {} live here.", "We met {} today.", "Our neighbours are {}.", "There were {} at the market.")
MENTION_EVERY = 3


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, bucket) of every word and prefix; a feature may occur more than once."""
    codes, at = codepoints([t.lower() for t in texts])
    start, end = runs(char_class("isalnum")[codes])
    owner = np.searchsorted(at, start, side="right") - 1
    found = [run_hashes(codes, start, end)] + [run_hashes(codes, start[end - start > n], start[end - start > n] + n) ^ np.uint64(n) for n in PREFIXES]
    owners = [owner] + [owner[end - start > n] for n in PREFIXES]
    return np.concatenate(owners), (mix(np.concatenate(found)) & np.uint64(BUCKETS - 1)).astype(np.int64)


_TERMS = [w for line in IDENTITY for w in line]


def _bare(text: str) -> list[str]:
    return [w.lower().strip(".,;:!?\"'()") for w in text.split()]


def named(text: str) -> list[int]:
    """Groups that ``text`` names, as places among all terms."""
    words = {*_bare(text)} & _OTHERS.keys()
    return sorted(_TERMS.index(w) for w in words)


def counterfactuals(text: str) -> list[str]:
    """Copies of ``text`` that name other groups in place of those that it names."""
    words, bare = text.split(), _bare(text)
    hit = [i for i, w in enumerate(bare) if w in _OTHERS]
    return [" ".join(_OTHERS[bare[i]][k % len(_OTHERS[bare[i]])] if i in hit else w for i, w in enumerate(words)) for k in range(SWAPS)] if hit else []


def mentions(text: str) -> list[str]:
    """A neutral sentence to add to ``text``, and the same about other groups; none for most texts."""
    draw = zlib.crc32(text.encode("utf-8", "surrogatepass"))
    if draw % MENTION_EVERY:
        return []
    draw //= MENTION_EVERY
    line = IDENTITY[draw % len(IDENTITY)]
    at = draw // len(IDENTITY)
    sentence = NEUTRAL[at % len(NEUTRAL)]
    return [sentence.format(line[(at + k) % len(line)]) for k in range(min(len(line), SWAPS + 1))]


@dataclass(frozen=True)
class Classifier:
    kept: np.ndarray  # buckets, ascending
    weights: np.ndarray
    bias: float

    def logits(self, texts: list[str]) -> np.ndarray:
        place = np.full(BUCKETS, -1, np.int32)
        place[self.kept] = np.arange(len(self.kept))
        out = np.full(len(texts), self.bias)
        for lo, hi in chunks_of(texts):
            owner, bucket = features(texts[lo:hi])
            col = place[bucket]
            pairs = np.unique(owner[col >= 0] * len(self.kept) + col[col >= 0]) if len(self.kept) else np.zeros(0, np.int64)
            if len(pairs):
                np.add.at(out, lo + pairs // len(self.kept), self.weights[pairs % len(self.kept)])
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def learn(rows: list[np.ndarray], labels: np.ndarray, pairs: list[tuple[int, np.ndarray]], size: int, swap: float = 1.0, l1: float = 2e-4, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias.  rows: columns of each text; pairs: a row and the columns of its counterfactual."""
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    cols = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    c_owner = np.repeat(np.arange(len(pairs)), [len(c) for _, c in pairs])
    c_cols, c_row = np.concatenate([*[c for _, c in pairs], np.zeros(0, np.int64)]).astype(np.int64), np.array([i for i, _ in pairs], np.int64)
    n, w, b = len(rows), np.zeros(size), float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)))
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, steps + 1):
        logit = b + np.bincount(owner, w[cols], n)
        p = _sigmoid(logit)
        back = (p - labels) / n
        grad, gb = np.zeros(size), 0.0
        if len(pairs):
            q = _sigmoid(b + np.bincount(c_owner, w[c_cols], len(pairs)))
            gap = 2 * swap * (p[c_row] - q) / len(pairs)
            up, down = gap * p[c_row] * (1 - p[c_row]), gap * q * (1 - q)
            np.add.at(back, c_row, up)
            grad -= np.bincount(c_cols, down[c_owner], size)
            gb -= down.sum()
        grad += np.bincount(cols, back[owner], size)
        gb += back.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        rate = 0.1 / (1 + t / 100)
        scale = rate / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        w = w - scale * m / (1 - 0.9**t)
        w = np.sign(w) * np.maximum(0, np.abs(w) - scale * l1)
        b -= rate * mb / (1 - 0.9**t) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-6)
    return w, b


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with each feature, all and toxic, of this partition."""
    every, toxic = np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, np.int32)
    for batch in batches:
        texts, labels = strings(batch.column("t")), np.array(batch.column("toxic").to_pylist(), np.int64)
        for lo, hi in chunks_of(texts):
            owner, bucket = features(texts[lo:hi])
            pairs = np.unique(owner * BUCKETS + bucket)
            every += np.bincount(pairs % BUCKETS, minlength=BUCKETS).astype(np.int32)
            toxic += np.bincount(pairs[labels[lo + pairs // BUCKETS] > 0] % BUCKETS, minlength=BUCKETS).astype(np.int32)
    used = np.flatnonzero(every)
    for i in range(0, len(used), 100_000):
        part = used[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(every[part].astype(np.int64)), pa.array(toxic[part].astype(np.int64))], ["bucket", "n", "n_toxic"])


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    """A column of lists as views of its flat values."""
    out = []
    for chunk in column.chunks:
        out += np.split(chunk.flatten().to_numpy().astype(np.int64), np.cumsum(chunk.value_lengths().to_numpy())[:-1])[: len(chunk)]
    return out


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", sample: int = SAMPLE, swap: float = 1.0) -> Classifier:
    """Learn from the texts of ``docs`` that ``labels`` marks, or a hashed sample of about ``sample`` of them."""
    marks = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(F.col(label).cast("int")).alias("toxic"))
    n = marks.count()
    part = F.pmod(F.xxhash64(key), F.lit(1 << 30)) / float(1 << 30)
    words = docs.select(F.col(key).alias("__key"), F.length(text).alias("chars")).join(marks.select(F.col(key).alias("__key")), "__key").agg(F.sum("chars")).first()[0] or 0
    drawn = saved(marks.where(part < min(1.0, sample / max(1, n), SAMPLE_CHARS / max(1, words))).select(F.col(key).alias("__key"), "toxic"), "marks")
    share, size = drawn.agg(F.avg("toxic"), F.count(F.lit(1))).first()
    empty = Classifier(np.zeros(0, np.int64), np.zeros(0), 0.0)
    if share is None:
        return empty
    if share in (0.0, 1.0):
        return Classifier(empty.kept, empty.weights, 40.0 if share else -40.0)
    # at most about ``sample`` rows of 12 bytes are broadcast
    rows = docs.select(F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(F.broadcast(drawn), "__key").select("t", "toxic")
    counted = rows.mapInArrow(_count, "bucket long, n long, n_toxic long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("x"))
    z = (F.col("x") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    tied = counted.where((F.col("n") >= LEAST_TEXTS) & (F.abs(z) >= LEAST_Z)).select("bucket").toArrow()  # at most BUCKETS
    neutral = [n.format("") for n in NEUTRAL]
    kept = np.union1d(tied.column(0).to_numpy(), np.unique(features(_TERMS + neutral)[1]))
    place = np.full(BUCKETS, -1, np.int32)
    place[kept] = np.arange(len(kept))

    def columns(texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for lo, hi in chunks_of(texts):
            owner, bucket = features(texts[lo:hi])
            ok = place[bucket] >= 0
            pairs = np.unique(owner[ok] * BUCKETS + place[bucket[ok]])
            cut = np.searchsorted(pairs // BUCKETS, np.arange(hi - lo + 1))
            out += [(pairs[a:b] % BUCKETS).astype(np.int32) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return out

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column("t"))

            def several(of: list[list[str]]) -> pa.Array:
                flat = columns([c for cs in of for c in cs])
                at = np.concatenate([[0], np.cumsum([len(cs) for cs in of])])
                return pa.array([[c.tolist() for c in flat[a:b]] for a, b in zip(at[:-1], at[1:], strict=True)], pa.list_(pa.list_(pa.int32())))

            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array([c.tolist() for c in columns(texts)], pa.list_(pa.int32())), several([counterfactuals(t) for t in texts]), several([mentions(t) for t in texts]), pa.array([named(t) for t in texts], pa.list_(pa.int32()))],
                ["toxic", "own", "swapped", "added", "named"],
            )

    seen = rows.mapInArrow(extract, "toxic int, own array<int>, swapped array<array<int>>, added array<array<int>>, named array<int>").toArrow()  # of at most about SAMPLE_CHARS characters
    own, labels_ = _lists(seen.column("own")), seen.column("toxic").to_numpy().astype(float)
    pairs = [(i, np.array(c, np.int64)) for i, cs in enumerate(seen.column("swapped").to_pylist()) for c in cs]
    copies = []
    for i, added in enumerate(seen.column("added").to_pylist()):
        if added:
            pairs += [(len(own) + len(copies), np.union1d(own[i], np.array(c, np.int64))) for c in added[1:]]
            copies.append((i, np.union1d(own[i], np.array(added[0], np.int64))))
    clean = np.flatnonzero(labels_ == 0)
    told = [g for i, gs in enumerate(_lists(seen.column("named"))) if labels_[i] for g in gs]
    for n, g in enumerate(told):
        i, sentence = int(clean[n % len(clean)]), NEUTRAL[n % len(NEUTRAL)]
        own_, *others = columns([sentence.format(w) for w in (_TERMS[g], *_OTHERS[_TERMS[g]][:SWAPS])])
        pairs += [(len(own) + len(copies), np.union1d(own[i], c.astype(np.int64))) for c in others]
        copies.append((i, np.union1d(own[i], own_.astype(np.int64))))
    labels_ = np.concatenate([labels_, labels_[[i for i, _ in copies]]])
    own += [c for _, c in copies]
    weights, bias = learn(own, labels_, pairs, len(kept), swap)
    used = np.flatnonzero(weights)
    return Classifier(kept[used], weights[used], bias)


def score(docs: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """``docs`` with score and predicted."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most BUCKETS weights

    def made(texts: pa.Array) -> list[pa.Array]:
        p = _sigmoid(held.value.logits(strings(texts)))
        return [pa.array(p), pa.array((p >= 0.5).astype(np.int32))]

    return with_made(docs, text, [("score", "double"), ("predicted", "integer")], made)
