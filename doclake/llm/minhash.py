"""Near-duplicate documents by DartMinHash, banded joining and exact verification.

A document is the multiset of its runs of five words (lower-cased letters and digits); its similarity to another is the
weighted Jaccard of the two.  Each run of words that occurs w times is a region of w unit cells.  Darts rain on all
cells with ascending rank, placed by hashes of the cell alone, each at one of ``COORDINATES``; a document keeps the
earliest dart at each coordinate, so two documents agree at a coordinate with a probability of their similarity.  The
expected work is that of the cells plus the darts a signature needs, not their product.

Texts that are equal as word sequences are folded into one first.  Signatures are cut into bands; documents that share
a band are candidates.  All members of a band are held against a few leaders, exactly, and joined to classes.  Bands
whose members are then still in different classes are worked off in cells: blocks of the members outside the band's
largest class meet one another and the blocks of that class.  A cell first compares signatures and passes on, once,
each row that has a partner in another class; those rows then meet again with the sets of their runs of words, and only
links that join two classes leave the cell.  So no link between classes is lost (but by a chance of about 3e-7 at the
threshold itself), no pair is ever a row unless it is such a link, and members of one class are not compared.

Defined cases: a text without a word, or null, is alone in its class; a text of fewer than five words is one run; equal
rows are copies; an empty table gives no rows; other columns are kept out of the way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake.llm.common import char_class, chunks_of, codepoints, components, drop_saved, mix, numbered, place_of, run_hashes, runs, saved, strings

WORDS = 5
ROWS, BANDS = 5, 32
COORDINATES = ROWS * BANDS
#: Rank of the first layer of darts; later layers double it.
FIRST_RANK = 2.0**-6
#: Leaders that a band may have, by as many orders of the documents.
LEADERS = 3
#: Pairs of signatures that agree at a smaller share than the threshold by this much are not held against one another:
#: five standard deviations.
MARGIN = 0.16
#: Rows of a block and bytes of their sets.
CELL, CELL_BYTES = 1024, 24_000_000
#: Candidates of a row that are verified first, likeliest first: most rows are then in the class of all others.
FIRST = 16


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, hash) of every run of words of every text, ordered; and two hashes of each text's word sequence (0: no word)."""
    codes, at = codepoints([t.lower() for t in texts])
    start, end = runs(char_class("isalnum")[codes])
    owner = np.searchsorted(at, start, side="right") - 1
    word = run_hashes(codes, start, end)
    count = np.bincount(owner, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(count)])
    whole = run_hashes(word, first[:-1], first[1:])
    again = run_hashes(mix(word + np.uint64(99)), first[:-1], first[1:])
    size = np.minimum(WORDS, count)
    begin = np.arange(len(word)) <= (first[owner] + count[owner] - size[owner])
    at0 = np.flatnonzero(begin)
    found = run_hashes(word, at0, at0 + size[owner[at0]])
    none = count == 0
    order = np.lexsort((found, owner[at0]))
    return owner[at0][order], found[order], np.where(none, 0, whole | np.uint64(1)), np.where(none, 0, again)


def _occurrence(owner: np.ndarray, found: np.ndarray) -> np.ndarray:
    """How often an ordered (owner, hash) came before."""
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (found[1:] != found[:-1])]) if len(owner) else np.zeros(0, bool)
    i = np.arange(len(owner))
    return i - np.maximum.accumulate(np.where(new, i, 0))


def _poisson_table(rate: float) -> np.ndarray:
    """Cumulative probabilities of a Poisson count, until they are 1."""
    n = np.arange(int(rate + 12 * np.sqrt(rate) + 24))
    log = n * np.log(rate) - rate - np.concatenate([[0.0], np.cumsum(np.log(n[1:]))])
    return np.minimum(1.0, np.cumsum(np.exp(log)))


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(float) * (1.0 / (1 << 53))


def signatures(owner: np.ndarray, found: np.ndarray, n: int) -> np.ndarray:
    """The dart kept at each coordinate, as 32 bits; (n, COORDINATES).  Owners without cells keep zeros."""
    cell = cells_of(owner, found)
    out, filled = np.zeros(n * COORDINATES, np.uint32), np.zeros(n * COORDINATES, bool)
    low, high, layer = 0.0, FIRST_RANK, 1
    while len(cell):
        seed = mix(cell ^ mix(np.array([layer], np.uint64)))
        darts = np.searchsorted(_poisson_table(high - low), _unit(seed), side="right")
        hit = np.flatnonzero(darts)
        times = darts[hit]
        which = np.repeat(hit, times)
        number = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
        with np.errstate(over="ignore"):
            dart = mix(seed[which] + (number + 1).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        slot = owner[which] * COORDINATES + (dart % np.uint64(COORDINATES)).astype(np.int64)
        free = ~filled[slot]
        slot, dart = slot[free], dart[free]
        rank = mix(dart)  # uniform within the layer
        order = np.lexsort((rank, slot))
        slot, dart = slot[order], dart[order]
        first = np.concatenate([[True], slot[1:] != slot[:-1]]) if len(slot) else np.zeros(0, bool)
        out[slot[first]] = (mix(dart[first] ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)
        filled[slot[first]] = True
        going = ~filled.reshape(n, COORDINATES).all(axis=1)
        keep = going[owner]
        owner, cell = owner[keep], cell[keep]
        low, high, layer = high, 2 * high, layer + 1
    return out.reshape(n, COORDINATES)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """(documents, BANDS) hashes of the bands."""
    h = np.tile(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(signature), 1))
    rows = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    for i in range(ROWS):
        h = mix(h ^ rows[:, :, i])
    return h.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two multisets (distinct hashes, counts)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][i], b[1][j]).sum())
    return both / float(a[1].sum() + b[1].sum() - both)


def cells_of(owner: np.ndarray, found: np.ndarray) -> np.ndarray:
    """A hash of each unit cell of ordered (owner, hash) pairs: a run of words and which of its occurrences it is."""
    with np.errstate(over="ignore"):
        return mix(found + np.uint64(0x9E3779B97F4A7C15) * _occurrence(owner, found).astype(np.uint64))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = strings(batch.column("t"))
        for lo, hi in chunks_of(texts):
            owner, found, whole, again = shingles(texts[lo:hi])
            sigs = signatures(owner, found, hi - lo)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").slice(lo, hi - lo), pa.array(whole.view(np.int64)), pa.array(again.view(np.int64)), pa.array(np.bincount(owner, minlength=hi - lo)), pa.array([s.tobytes() for s in sigs], pa.binary())],
                ["id", "fp", "fp2", "n", "sig"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ordered cells of each text."""
    for batch in batches:
        texts = strings(batch.column("t"))
        for lo, hi in chunks_of(texts):
            owner, found, _, _ = shingles(texts[lo:hi])
            cells = cells_of(owner, found)
            cells = cells[np.lexsort((cells, owner))]
            cut = np.searchsorted(owner, np.arange(hi - lo + 1))
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), pa.array([cells[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["rep", "cells"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, len(batch), 2048):
            part = batch.slice(lo, 2048)
            keys = band_keys(_signatures_of(part.column("sig")))
            each = pa.array(np.repeat(np.arange(len(part)), BANDS))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(part))), part.column("rep").take(each), part.column("n").take(each)], ["key", "band", "rep", "n"])


def _signatures_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), COORDINATES)


class _Sets:
    """The cells of some rows end to end, to count what each shares with another."""

    def __init__(self, column: pa.ChunkedArray) -> None:
        self.sets = [np.frombuffer(x, np.uint64) for x in column.to_pylist()]
        self.size = np.array([len(x) for x in self.sets], np.int64)

    def similar(self, i: int, others: np.ndarray) -> np.ndarray:
        """Weighted Jaccard of row i with each of some other rows."""
        own, every = self.sets[i], np.concatenate([self.sets[j] for j in others])
        at = np.minimum(np.searchsorted(own, every), len(own) - 1)
        both = np.bincount(np.repeat(np.arange(len(others)), self.size[others]), own[at] == every, len(others))
        return both / (len(own) + self.size[others] - both)


def _with_leader(least: float):
    """Links of a leader with the members of a block."""

    def run(block: pa.Table) -> pa.Table:
        rep, leader = block.column("rep").to_numpy(), block.column("leader")[0].as_py()
        own = np.flatnonzero(rep == leader)
        members = np.flatnonzero(rep != leader)
        if len(own) and len(members):
            members = members[_Sets(block.column("cells")).similar(own[0], members) >= least]
        return pa.table({"a": np.minimum(rep[members], leader), "b": np.maximum(rep[members], leader)})

    return run


def _partners(i: int, right: np.ndarray, comp: np.ndarray, n: np.ndarray, sig: np.ndarray, band: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of another class that may be similar enough to row i, and share no earlier band with it; and how their signatures agree."""
    j = right[comp[right] != comp[i]]
    j = j[np.minimum(n[j], n[i]) >= least * np.maximum(n[j], n[i])]
    same = sig[j] == sig[i]
    agree = same.mean(axis=1)
    near = agree >= least - MARGIN
    j, agree, same = j[near], agree[near], same[near]
    first = same.reshape(len(j), BANDS, ROWS).all(axis=2).argmax(axis=1) == band
    return j[first], agree[first]


def _sides(cell: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    lo, hi, own = cell.column("lo")[0].as_py(), cell.column("hi")[0].as_py(), cell.column("own").to_numpy()
    left = np.flatnonzero(own == lo)
    return left, left if lo == hi else np.flatnonzero(own == hi), lo == hi


_OPEN = ["key", "lo", "hi", "own", "band", "rep", "comp", "n", "sig"]


def _hopeful(least: float):
    """The rows of a cell that have a partner."""

    def run(cell: pa.Table) -> pa.Table:
        left, right, one = _sides(cell)
        comp, n, sig, band = cell.column("comp").to_numpy(), cell.column("n").to_numpy(), _signatures_of(cell.column("sig")), cell.column("band")[0].as_py()
        some = np.zeros(len(cell), bool)
        for i in left:
            j, _ = _partners(i, right[right > i] if one else right, comp, n, sig, band, least)
            some[j] = True
            some[i] |= len(j) > 0
        return cell.select(_OPEN).filter(pa.array(some))

    return run


def _joining(least: float):
    """Links that join classes of a cell, verified on the sets; a row stops looking among the classes that it has joined."""

    def run(cell: pa.Table) -> pa.Table:
        left, right, one = _sides(cell)
        _, comp = np.unique(cell.column("comp").to_numpy(), return_inverse=True)
        n, sig, band, rep = cell.column("n").to_numpy(), _signatures_of(cell.column("sig")), cell.column("band")[0].as_py(), cell.column("rep").to_numpy()
        sets, links = _Sets(cell.column("cells")), []
        for i in left:
            j, agree = _partners(i, right[right > i] if one else right, comp, n, sig, band, least)
            j, take = j[np.argsort(-agree, kind="stable")], FIRST
            while len(j):
                now, j = j[:take], j[take:]
                for k in now[sets.similar(i, now) >= least]:
                    if comp[k] != comp[i]:
                        links.append((i, k))
                        comp[comp == comp[k]] = comp[i]
                j, take = j[comp[j] != comp[i]], CELL
        i, k = (rep[np.array([x[s] for x in links], np.int64)] for s in (0, 1))
        return pa.table({"a": np.minimum(i, k), "b": np.maximum(i, k)})

    return run


def _blocks(rows: str, cells: str) -> Column:
    return F.ceil(F.greatest(F.col(rows) / CELL, F.col(cells) * 8 / CELL_BYTES)).cast("long")


def near_duplicates(docs: DataFrame, least: float = 0.8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, component_id (smallest doc_id of its class), kept of every row of ``docs``."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"))
    sketched = saved(rows.mapInArrow(_sketch, "id long, fp long, fp2 long, n long, sig binary"), "sketches")
    worded = sketched.where("fp <> 0 and id is not null")
    reps = saved(worded.groupBy("fp", "fp2").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig")), "reps")
    banded = reps.select("rep", "n", "sig").mapInArrow(_bands, "key long, band int, rep long, n long")
    order = F.xxhash64("rep", F.col("band") % LEADERS)
    leaders = banded.groupBy("key").agg(F.min_by(F.struct("rep", "n"), order).alias("leader"), F.count(F.lit(1)).alias("members")).where("members > 1").drop("members")
    shared = saved(banded.join(leaders, "key").select("key", "band", "rep", "n", F.col("leader.rep").alias("leader"), F.col("leader.n").alias("leader_n")), "shared")

    involved = shared.select(F.col("rep").alias("id")).distinct()
    sets = saved(rows.join(involved, "id", "left_semi").dropDuplicates(["id"]).mapInArrow(_sets, "rep long, cells binary"), "sets")

    stars = shared.where((F.col("rep") != F.col("leader")) & (F.least("n", "leader_n") >= least * F.greatest("n", "leader_n"))).select("rep", "leader", "n").distinct()
    sizes = stars.groupBy("leader").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("cells")).select("leader", _blocks("rows", "cells").alias("blocks"))
    members = stars.join(sizes, "leader").select("leader", F.pmod(F.xxhash64("rep"), "blocks").alias("block"), "rep")
    heads = sizes.select("leader", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.col("leader").alias("rep"))
    links = saved(members.unionByName(heads).join(sets, "rep").groupBy("leader", "block").applyInArrow(_with_leader(least), "a long, b long"), "links")
    classes = saved(components(links), "classes")

    placed = shared.join(classes.withColumnRenamed("node", "rep"), "rep", "left").select("key", "band", "rep", "n", F.coalesce("component", "rep").alias("comp"))
    parts = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("cells"))
    split = parts.groupBy("key").agg(F.max(F.struct("rows", "comp", "cells")).alias("main"), F.sum("rows").alias("rows"), F.sum("cells").alias("cells"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    split = split.select("key", F.col("main.comp").alias("main"), F.col("main.rows").alias("m_rows"), F.col("main.cells").alias("m_cells"), (F.col("rows") - F.col("main.rows")).alias("rows"), (F.col("cells") - F.col("main.cells")).alias("cells"))
    split = split.select("key", "main", _blocks("rows", "cells").alias("minor"), _blocks("m_rows", "m_cells").alias("major"))
    place, is_main = F.xxhash64("rep"), F.col("comp") == F.col("main")
    own = F.when(is_main, F.col("minor") + F.pmod(place, "major")).otherwise(F.pmod(place, "minor"))
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.when(is_main, F.col("minor")).otherwise(F.col("minor") + F.col("major")) - 1))
    open_ = placed.join(split, "key").select("key", "band", "rep", "n", "comp", own.alias("own"), others.alias("other"))
    cells = open_.join(reps.select("rep", "sig"), "rep").select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "band", "rep", "comp", "n", "sig")
    at = ("key", "lo", "hi")
    hopeful = saved(cells.groupBy(*at).applyInArrow(_hopeful(least), "key long, lo long, hi long, own long, band int, rep long, comp long, n long, sig binary"), "hopeful")
    more = saved(hopeful.join(sets, "rep").groupBy(*at).applyInArrow(_joining(least), "a long, b long"), "links")
    if not more.isEmpty():
        classes = saved(components(links.unionByName(more)), "classes")
    for done in (shared, sets, links, hopeful, more):
        drop_saved(done)

    named = reps.join(classes.withColumnRenamed("node", "rep"), "rep", "left").select("fp", "fp2", F.coalesce("component", "rep").alias("component_id"))
    of_words = worded.select("id", "fp", "fp2").join(named, ["fp", "fp2"]).select("id", "component_id")
    alone = sketched.where("fp = 0 or id is null").select("id", F.col("id").alias("component_id"))
    return of_words.unionByName(alone).select(F.col("id").alias("doc_id"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def kept(docs: DataFrame, least: float = 0.8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each class of near-duplicates, that with the smallest key; keys may be null (the last) or repeat."""
    rows, k = numbered(docs), place_of(docs, key)
    found = near_duplicates(rows, least, place_of(docs, text), "row")
    order = F.struct(F.col(k).isNull(), F.col(k).cast("long"), F.col("row"))
    first = rows.select("row", k).join(found.select(F.col("doc_id").alias("row"), "component_id"), "row").groupBy("component_id").agg(F.min_by("row", order).alias("row")).select("row")
    return rows.join(first, "row", "left_semi").drop("row").toDF(*docs.columns)
