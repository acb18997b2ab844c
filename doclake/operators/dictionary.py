"""Which terms of a dictionary table a table of texts uses.

A term matches whatever the case and kind of blanks between its parts.  One of Latin letters, digits and a few signs must
stand as a word of its own, where ``plural`` allows an s or es behind it; any other matches within words too.

A dictionary of up to ``MOST_TERMS`` terms and ``MOST_CHARS`` characters, which is counted first, becomes one automaton
in each task, and each text is passed once.  A larger one is joined: terms and texts meet on a word (or the first
characters) of the term, and the same automaton, of a text's candidates only, decides.  Both give the same rows.

Defined cases: null and blank terms and null texts match nothing; terms that differ in case and blanks only match
together; equal rows of texts are found each; no texts or terms, no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from doclake.sources.shared import saved_large

MOST_TERMS, MOST_CHARS = 100_000, 4_000_000
#: Texts whose rows leave a task together.
SLICE = 512
#: Bytes of the set of bits that tells what no term wants.
BITS = 1 << 20
# Fixed value: what a term that must stand as a word is made of.
WORD_LIKE = r"[A-Za-z0-9_\s\-./+()'’]+"
#: The same blanks as Python's, in Java.
BLANKS = r"(?U)[\x1c-\x1f\s]+"
_WORD_LIKE, _BLANKS, _ENDS = re.compile(WORD_LIKE, re.ASCII), re.compile(r"\s+"), re.compile(r"(?:e?s)?(?![A-Za-z0-9])")
_WORDS = re.compile(r"[a-z0-9]+")
_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")


class Finder:
    """An automaton over terms; ``of`` gives those that a text has, longest first, then by spelling."""

    def __init__(self, terms: Iterable[str | None], plural: bool = True) -> None:
        self.plural = plural
        #: Terms that are one run of letters and digits, by that run: a text has them among its runs.
        self.runs: dict[str, set[str]] = {}
        spelt: dict[str, list[str]] = {}
        for t in terms:
            if t and t.strip():
                form = " ".join(t.lower().split())
                if _WORD_LIKE.fullmatch(t) and _WORDS.fullmatch(form):
                    self.runs.setdefault(form, set()).add(t)
                else:
                    spelt.setdefault(form, []).append(t)
        self.automaton = ahocorasick.Automaton()
        for form, same in spelt.items():
            self.automaton.add_word(form, (len(self.automaton), len(form), sorted(set(same)), [bool(_WORD_LIKE.fullmatch(t)) for t in sorted(set(same))]))
        if spelt:
            self.automaton.make_automaton()

    def of(self, text: str | None) -> list[str]:
        if not text:
            return []
        plain, found = _BLANKS.sub(" ", text.lower()), set()
        if self.runs:
            words = set(_WORDS.findall(plain))
            for w in _with_singulars(words) if self.plural else words:
                if w in self.runs:
                    found |= self.runs[w]
        if len(self.automaton):
            self._elsewhere(plain, found)
        return sorted(found, key=lambda t: (-len(t), t))

    def _elsewhere(self, plain: str, found: set[str]) -> None:
        """Add the terms of the automaton that a text has."""
        whole: set[int] = set()  # numbers of forms whose terms are all found
        for end, (number, size, terms, words) in self.automaton.iter(plain):
            if number in whole:
                continue
            start, after = end + 1 - size, end + 1
            if (start and plain[start - 1] in _LETTERS) or not (_ENDS.match(plain, after) if self.plural else plain[after : after + 1] not in _LETTERS):
                found.update(t for t, word in zip(terms, words, strict=True) if not word)
            else:
                found.update(terms)
                whole.add(number)


def _with_singulars(words: set[str]) -> set[str]:
    """Words, and those that end in s without it, in es without that."""
    return words | {w[:-1] for w in words if w[-1] == "s"} | {w[:-2] for w in words if w[-2:] == "es"}


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, SLICE):
            yield batch.slice(lo, SLICE)


def _with_terms(columns: list[pa.Array], found: list[list[str]], names: list[str]) -> pa.RecordBatch:
    rows = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
    return pa.RecordBatch.from_arrays([c.take(rows) for c in columns] + [pa.array([t for f in found for t in f], pa.string())], names)


def _result(texts: DataFrame, text: str, keep_text: bool) -> tuple[StructType, list[int]]:
    """The schema of the rows found, and the places of the columns of ``texts`` that they have."""
    at = [i for i, c in enumerate(texts.columns) if keep_text or c != text]
    return StructType([*(texts.schema.fields[i] for i in at), StructField("term", StringType())]), at


def _by_automaton(texts: DataFrame, text: str, terms: list[str], plural: bool, keep_text: bool) -> DataFrame:
    schema, kept = _result(texts, text, keep_text)
    at = texts.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(terms, plural)
        for batch in _slices(batches):
            yield _with_terms([batch.column(i) for i in kept], [finder.of(t) for t in batch.column(at).to_pylist()], schema.names)

    return texts.mapInArrow(run, schema)


def _anchor(term: str) -> str:
    """What a text must offer to have ``term``: the longest word of a term that stands as words, else its first two characters."""
    form = " ".join(term.lower().split())
    words = _WORDS.findall(form) if _WORD_LIKE.fullmatch(term) else []
    return "w" + max(words, key=len) if words else "c" + form[:2]


def _anchors(text: str, plural: bool, signs: bool = True) -> set[str]:
    """What a text offers: w and each of its words (without an s or es too), with ``signs`` c and each of its characters and pairs."""
    form = _BLANKS.sub(" ", text.lower())
    words = set(_WORDS.findall(form))
    offered = {"w" + w for w in (_with_singulars(words) if plural else words)}
    return offered | {"c" + c for c in {*form, *map(str.__add__, form, form[1:])}} if signs else offered


def _bits_of(wanted: DataFrame) -> bytes:
    """A set of bits with those of all wanted anchors; its size is fixed, and a bit too many only costs time."""
    bit = F.pmod(F.crc32(F.col("anchor").cast("binary")), F.lit(8 * BITS)) + 1
    rows = wanted.groupBy(F.bitmap_bucket_number(bit).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()  # of a fixed size
    out = bytearray(BITS)
    for r in rows:
        lo = (r["at"] - 1) * len(r["bits"])
        out[lo : lo + len(r["bits"])] = r["bits"]
    return bytes(out)


def _by_join(texts: DataFrame, text: str, terms: DataFrame, plural: bool, keep_text: bool) -> DataFrame:
    """Texts meet terms on the longest word of a term, or on the first two characters of one that need not be a word.

    Only what a text offers and some term may want leaves a task; texts themselves move once, to their candidates.
    """
    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(_anchor, batch.column(0).to_pylist()), pa.string())], ["term", "anchor"])

    wanted = saved_large(terms.select("term").mapInArrow(anchored, "term string, anchor string"), "wanted")
    bits, signs = _bits_of(wanted), not wanted.where("anchor LIKE 'c%'").isEmpty()

    def offered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[str, bool] = {}
        for batch in _slices(batches):
            found = []
            if len(asked) > MOST_TERMS:
                asked.clear()
            for t in batch.column(1).to_pylist():
                mine = []
                for a in _anchors(t, plural, signs) if t else ():
                    wants = asked.get(a)
                    if wants is None:
                        bit = zlib.crc32(a.encode()) % (8 * BITS)
                        wants = asked[a] = bool(bits[bit >> 3] >> (bit & 7) & 1)
                    if wants:
                        mine.append(a)
                found.append(mine)
            yield _with_terms([batch.column(0)], found, ["__row", "anchor"])

    rows = saved_large(texts.withColumn("__row", F.monotonically_increasing_id()), "texts")
    offers = rows.select("__row", text).mapInArrow(offered, "__row long, anchor string")
    met = offers.join(wanted, "anchor").groupBy("__row").agg(F.collect_set("term").alias("__terms"))
    return _asked(rows.join(met, "__row").select(*texts.columns, "__terms"), text, plural, keep_text)


def _asked(texts: DataFrame, text: str, plural: bool, keep_text: bool) -> DataFrame:
    """The terms that each of ``texts`` uses of those in its last column."""
    schema, kept = _result(texts.drop("__terms"), text, keep_text)
    at = texts.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, finder = None, Finder([])
        for batch in _slices(batches):
            found = []
            for t, terms in zip(batch.column(at).to_pylist(), batch.columns[-1].to_pylist(), strict=True):
                if terms != asked:
                    asked, finder = terms, Finder(terms, plural)
                found.append(finder.of(t))
            yield _with_terms([batch.column(i) for i in kept], found, schema.names)

    return texts.mapInArrow(run, schema)


def uses(texts: DataFrame, terms: DataFrame, text: str = "text", plural: bool = True, most_terms: int = MOST_TERMS, keep_text: bool = True) -> DataFrame:
    """``texts`` with a column ``term``: a row for each term of ``terms`` (term) that a text uses; without ``keep_text``, the texts stay in the tasks."""
    known = terms.select(F.col("term").cast("string").alias("term")).where("trim(term) <> ''").distinct()
    n, chars = known.agg(F.count("*"), F.coalesce(F.sum(F.length("term")), F.lit(0))).first()
    if n <= most_terms and chars <= MOST_CHARS:
        return _by_automaton(texts, text, [r["term"] for r in known.collect()], plural, keep_text)  # counted just before
    return _by_join(texts, text, known, plural, keep_text)


def glossary(texts: DataFrame, terms: DataFrame, most: int, text: str = "text") -> DataFrame:
    """(doc_id, block_id, term, target, place) of the terms that each block uses, longest first, at most ``most``.

    ``terms``: doc_id (null for all documents), term, target.  A document's own entry stands before the global one of
    the same spelling, whatever case and blanks.
    """
    key = F.trim(F.lower(F.regexp_replace("term", BLANKS, " ")))
    block, entries = ["doc_id", "block_id"], terms.where("trim(term) <> ''").withColumn("key", key)
    own = entries.where("doc_id IS NOT NULL").select("doc_id", "term", "key", "target", F.lit(0).alias("scope"))
    glob = entries.where("doc_id IS NULL").select("term", "key", "target", F.lit(1).alias("scope"))
    everywhere = uses(texts.select(*block, text), glob.select("term"), text, keep_text=False).join(glob, "term")
    asked = texts.select(*block, text).join(own.groupBy("doc_id").agg(F.array_sort(F.collect_set("term")).alias("__terms")), "doc_id")
    here = _asked(asked, text, True, keep_text=False).join(own, ["doc_id", "term"])
    hits = here.select(*block, "key", "scope", "term", "target").unionByName(everywhere.select(*block, "key", "scope", "term", "target")).repartition(*block)
    first = hits.groupBy(*block, "key").agg(F.min(F.struct("scope", "term", "target")).alias("e"))
    order = Window.partitionBy(*block).orderBy(F.desc(F.length("e.term")), "e.term")
    return first.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select(*block, "e.term", "e.target", "place")
