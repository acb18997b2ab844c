"""Language ID by a language-bitmask n-gram filter.

A bit-sliced Bloom filter holds one byte slice for every eight languages at each slot.  Setting an n-gram ORs the bits
of all languages that use it into its slots; looking one up ANDs its slots and so returns *all* languages that contain
it.  A text's n-grams give a popcount per language; each is corrected for the false positives that the language's
fill rate makes likely, and the largest corrected count decides.

Defined cases: a null text or one without a letter is ``und`` with score 0; a text whose n-grams are all unknown gets
the most common learned language with score 0; ties go to the smaller language code; with nothing to learn from, every
text is ``und``.  Other columns of the input are kept untouched unless named like an output column.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake.llm.common import char_class, chunks_of, codepoints, mix, saved, strings, with_made

UNKNOWN = "und"
SIZES = (2, 3)
#: Learning reads at most about this many texts of each language, drawn by a hash of the key: the bound of the sample.
SAMPLE_PER_LANGUAGE = 4000
#: An n-gram belongs to a language if it makes up this share of its n-grams, so a language has at most 1/LEAST of a size...
LEAST = 1e-5
#: ...and at least this part of the largest share that any language gives it.
PART = 0.25
#: Slots come from 21 bits of an n-gram's hash each.
HASHES = 3
MOST_SLOTS = 1 << 21


@dataclass(frozen=True)
class LanguageFilter:
    languages: tuple[str, ...]
    slots: np.ndarray  # (slots, ceil(languages / 8)) bytes
    common: int  # index of the most common language

    @property
    def false_positive(self) -> np.ndarray:
        """For each language, how often an n-gram that it lacks seems to be in it."""
        bits = np.unpackbits(self.slots, axis=1, bitorder="little")[:, : len(self.languages)]
        return bits.mean(axis=0) ** HASHES

    def masks(self, grams: np.ndarray) -> np.ndarray:
        found = self.slots[_slot(grams, 0, len(self.slots))]
        for i in range(1, HASHES):
            found &= self.slots[_slot(grams, i, len(self.slots))]
        return found


def _slot(grams: np.ndarray, i: int, n: int) -> np.ndarray:
    return ((grams >> np.uint64(21 * i)) & np.uint64(n - 1)).view(np.int64)


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the letter n-grams of all texts, the index of their text, and whether a text has a letter.

    Letters are lower-cased; anything else is a word boundary, and an n-gram holds one at its ends only.
    """
    codes, at = codepoints([t.lower() for t in texts])
    letter = char_class("isalpha")[codes]
    has = np.add.reduceat(letter, at[:-1]) > 0 if len(texts) else np.zeros(0, bool)
    keep = letter | np.concatenate([[True], letter[:-1]])  # one boundary after each word
    owner = np.repeat(np.arange(len(texts)), np.diff(at))[keep]
    values = np.where(letter, codes, 0)[keep].astype(np.uint64)
    values, owner = np.concatenate([[np.uint64(0)], values]), np.concatenate([owner[:1], owner])
    inner = values != 0
    hashes, owners = [], []
    for n in SIZES:
        m = len(values) - n + 1
        if m <= 0:
            continue
        ok = np.ones(m, bool)
        for j in range(1, n - 1):
            ok &= inner[j : m + j]
        ok &= inner[:m] | inner[n - 1 :]
        h = np.full(m, n, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(n):
                h = h * np.uint64(0x100000001B3) + values[j : m + j]
        hashes.append(mix(h[ok]))
        owners.append(owner[n - 1 :][ok])
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), has
    return np.concatenate(hashes), np.concatenate(owners), has


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, texts = batch.column(0).to_pylist(), strings(batch.column(1))
        for lo, hi in chunks_of(texts):
            grams, owners, _ = ngrams(texts[lo:hi])
            codes, index = np.unique(np.array(names[lo:hi], dtype=object), return_inverse=True)
            for i, code in enumerate(codes):
                g, n = np.unique(grams[index[owners] == i], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([code] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE_PER_LANGUAGE) -> LanguageFilter:
    """Learn the filter from the rows of ``docs`` with a text and a language: a hashed sample bounded by ``sample``."""
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(key).alias("key"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return LanguageFilter((), np.zeros((1, 1), np.uint8), 0)
    languages = tuple(sorted(sizes))
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, sample / sizes[k]))])
    part = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.where(part < share[F.col("lang")]).select("lang", "text")
    counts = saved(drawn.mapInArrow(_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = counts.join(total, "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("p")).where((F.col("p") >= LEAST) & (F.col("p") > 0))
    best = shares.groupBy("gram").agg(F.max("p").alias("best"))
    kept = shares.join(best, "gram").where(F.col("p") >= PART * F.col("best")).select("lang", "gram").toArrow()  # at most 1 / LEAST rows a language
    grams = kept.column("gram").to_numpy().view(np.uint64)
    index = np.searchsorted(np.array(languages), np.array(kept.column("lang").to_pylist(), dtype=np.array(languages).dtype))
    n = min(MOST_SLOTS, 1 << max(10, int(np.ceil(np.log2(8 * max(1, len(np.unique(grams))))))))
    slots = np.zeros((n, -(-len(languages) // 8)), np.uint8)
    for i in range(HASHES):
        np.bitwise_or.at(slots, (_slot(grams, i, n), index // 8), (1 << (index % 8)).astype(np.uint8))
    return LanguageFilter(languages, slots, max(range(len(languages)), key=lambda i: (sizes[languages[i]], -i)))


def identify(texts: list[str], model: LanguageFilter) -> tuple[list[str], list[float]]:
    """The language and score of each text: the share of the corrected popcounts that the language has."""
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if not model.languages:
        return names, scores
    size, bytes_ = len(model.languages), model.slots.shape[1]
    wrong, bit = model.false_positive, np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    for lo, hi in chunks_of(texts):
        grams, owners, has = ngrams(texts[lo:hi])
        masks, n = model.masks(grams), hi - lo
        found = np.concatenate([np.bincount(owners * 256 + masks[:, j], minlength=n * 256).reshape(n, 256) @ bit for j in range(bytes_)], axis=1)[:, :size]
        total = np.bincount(owners, minlength=n)[:, None]
        right = np.maximum(0.0, (found - total * wrong) / np.maximum(1e-9, 1 - wrong))
        best, mass = right.argmax(axis=1), right.sum(axis=1)
        for i in np.flatnonzero(has):
            sure = mass[i] > 0
            names[lo + i] = model.languages[best[i] if sure else model.common]
            scores[lo + i] = float(min(1.0, right[i, best[i]] / mass[i])) if sure else 0.0
    return names, scores


def predict(docs: DataFrame, model: LanguageFilter, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by LEAST

    def made(texts: pa.Array) -> list[pa.Array]:
        names, scores = identify(strings(texts), held.value)
        return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

    return with_made(docs, text, [("lang_pred", "string"), ("score", "double")], made)


def accepted(least: float = 0.0) -> Column:
    """Rows whose language is known with more than the score ``least``."""
    return (F.col("lang_pred") != UNKNOWN) & (F.col("score") > least)
