"""BPE encoding by dynamic programming over prefixes, and decoding.

Byte-pair merging splits every prefix of a word in one way only, and that of a longer prefix is that of a shorter one
and one more token.  So each prefix stores its last token: of the vocabulary entries that end there, which an automaton
over the vocabulary finds in one pass, the one that is compatible with the last token of the prefix before it.  Two
tokens are compatible if no merge joins parts of both before they are complete.  Following the last tokens back from
the end of the word gives its ids; time is linear in the word, however long it is.

Defined cases: a null text is empty and has no ids (the digests are those of the empty text); strings of the file's
added tokens are those tokens; repeated rows are encoded each; other columns stay, those that have a result's name are
replaced; no rows, no results; a very long text is encoded whole.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterable
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType

from doclake.llm.common import chunks_of, strings, with_made
from doclake.llm.tokens import TextTokenizer

#: Answers about pairs of tokens that are kept; beyond it all are asked anew, which changes no result.
KEPT_PAIRS = 1 << 19
#: The pre-tokenizer's rule (a fixed value of byte-level vocabularies).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NEVER = 1 << 40
START = -2
OPEN = -1


def byte_names() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself where it is printable, else from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Merges:
    """The vocabulary as an automaton, and which tokens may stand next to each other.

    A token is given as its number in ``ids``.  ``halves`` has the two tokens it is merged from and ``rank`` the place of
    that merge.  The method needs a file in which every token is made by one merge that comes after those of its parts.
    """

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]]) -> None:
        self.ids = vocab
        self.size = {i: len(name) for name, i in vocab.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        for place, (left, right) in enumerate(merges):
            pair, made = (vocab[left], vocab[right]), vocab[left + right]
            if made in self.halves:
                raise ValueError(f"the merge of {left!r} and {right!r} is not the only one of its token")
            self.rank[pair], self.halves[made], self.born[made] = place, pair, place
        if any(self.born.get(part, -1) > self.born[made] for made, pair in self.halves.items() for part in pair):
            raise ValueError("a merge comes before those of its parts")
        self._edges: tuple[dict, dict] = ({}, {})
        self.kept: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for name, i in vocab.items():
            if self.intact(i):
                self.automaton.add_word(name, i)
        self.automaton.make_automaton()

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at one side (0 left, 1 right) of ``token`` while it grows, and the merge that ends each."""
        found = self._edges[side].get(token)
        if found is None:
            found, now, until = [], token, NEVER
            while True:
                found.append((now, until))
                if now not in self.halves:
                    break
                now, until = self.halves[now][side], self.born[now]
            self._edges[side][token] = found
        return found

    def crossed(self, left: int, right: int, before: int = NEVER) -> bool:
        """Whether a merge before ``before`` joins the right edge of one token with the left edge of the next.

        Of equal merges the leftmost goes first: it must come before the one that ends the left part, and no later
        than the one that ends the right part.
        """
        for x, x_ends in self.edge(left, 1):
            for y, y_ends in self.edge(right, 0):
                place = self.rank.get((x, y))
                if place is not None and place < min(x_ends, before) and place <= y_ends:
                    return True
        return False

    def intact(self, token: int) -> bool:
        """Whether merging the characters of ``token`` gives the token."""
        if token not in self.halves:
            return self.size[token] == 1
        left, right = self.halves[token]
        return not self.crossed(left, right, self.born[token]) and self.intact(left) and self.intact(right)

    def encode(self, words: list[str]) -> list[array]:
        """The ids of each of many words, which are written in the characters of the vocabulary."""
        text = "\n".join(words)
        last, size, kept = array("i", [OPEN]) * (len(text) + 1), self.size, self.kept
        bounds = np.cumsum([0] + [len(w) + 1 for w in words])
        for at in bounds[:-1].tolist():
            last[at] = START
        for end, token in self.automaton.iter(text):
            end += 1
            if last[end] != OPEN:
                continue
            before = last[end - size[token]]
            if before >= 0:
                pair = before << 20 | token
                fits = kept.get(pair)
                if fits is None:
                    fits = kept[pair] = not self.crossed(before, token)
                if not fits:
                    continue
            last[end] = token
        if len(kept) > KEPT_PAIRS:
            kept.clear()
        found = []
        for start, after in pairwise(bounds.tolist()):
            at, ids = after - 1, array("I")
            while at > start:
                ids.append(last[at])
                at -= size[last[at]]
            ids.reverse()
            found.append(ids)
        return found


class PrefixTokenizer(TextTokenizer):
    """Ids of texts by the prefixes of their words; the parts of texts that recur are kept as by ``TextTokenizer``."""

    kept_bytes = 256 << 20

    def __init__(self, path: str) -> None:
        super().__init__(path)
        with open(path, encoding="utf-8") as source:
            rules = json.load(source)
        model, added = rules["model"], rules["added_tokens"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        plain = {k: v for k, v in model.items() if k not in ("vocab", "merges", "type")}
        steps = rules["pre_tokenizer"] or {}
        if any(plain.values()) or model["type"] != "BPE" or rules["normalizer"] or steps.get("type") != "ByteLevel" or steps.get("add_prefix_space") or not steps.get("use_regex", True):
            raise ValueError(f"{path} is not a plain byte-level vocabulary")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] for t in added):
            raise ValueError(f"{path} has added tokens that take their surroundings")
        self.added = {t["content"]: t["id"] for t in added}
        names = byte_names()
        self.spell = {b: names[b] for b in range(256)}
        values = {c: b for b, c in enumerate(names)}
        whole = {i: n.encode() for n, i in self.added.items()}
        vocab = {n: i for n, i in model["vocab"].items() if n not in self.added}
        written = {i: bytes(values[c] for c in n) for n, i in vocab.items()} | whole
        self.bytes_of = [written.get(i, b"") for i in range(max(written) + 1)]
        self.names = [str(i) for i in range(len(self.bytes_of))]
        self.merges = Merges(vocab, merges)
        self.word = regex.compile(WORDS)
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None

    def _encode(self, texts: list[str]) -> list[bytes]:
        words: list[str] = []
        plan: list[list[int]] = []  # of each text: the places of its words, or an added token as ~id
        place: dict[str, int] = {}
        for text in texts:
            mine: list[int] = []
            for piece in self.parts.split(text) if self.parts else [text]:
                if piece in self.added:
                    mine.append(~self.added[piece])
                    continue
                for w in self.word.findall(piece):
                    at = place.get(w)
                    if at is None:
                        at = place[w] = len(words)
                        words.append(w.encode().decode("latin-1").translate(self.spell))
                    mine.append(at)
            plan.append(mine)
        found = [x.tobytes() for x in self.merges.encode(words)]
        return [b"".join(found[i] if i >= 0 else array("I", [~i]).tobytes() for i in mine) for mine in plan]

    def _learn_together(self, words: list[str]) -> None:
        """Words that follow a space, each by its prefixes; those of many texts make up one text of the automaton."""
        self._learn(self.tails, words, " ")

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ``ids``; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_OPEN: dict[str, PrefixTokenizer] = {}


def prefix_tokenizer(path: str) -> PrefixTokenizer:
    """One tokenizer for each file and Python worker."""
    if path not in _OPEN:
        _OPEN[path] = PrefixTokenizer(path)
    return _OPEN[path]


def encoded(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (their token ids) and ``decoded`` (the text of those ids)."""

    def made(column: pa.Array) -> list[pa.Array]:
        known = prefix_tokenizer(path)
        ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in known(strings(column))]
        return [pa.array(ids, pa.list_(pa.int32())), pa.array([known.decode(x.tolist()) for x in ids], pa.string())]

    return with_made(docs, text, [("ids", ArrayType(IntegerType())), ("decoded", "string")], made)


def digests(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 and decoded_sha256; ids and texts don't leave the task."""

    def made(column: pa.Array) -> list[pa.Array]:
        known, texts = prefix_tokenizer(path), strings(column)
        sizes, of_ids, of_texts = [], [], []
        for lo, hi in chunks_of(texts):
            for raw in known(texts[lo:hi]):
                ids = np.frombuffer(raw, "<u4").tolist()
                sizes.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(known.names.__getitem__, ids)).encode()).hexdigest())
                of_texts.append(hashlib.sha256(known.decode(ids).encode()).hexdigest())
        return [pa.array(sizes, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_texts, pa.string())]

    return with_made(docs, text, [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")], made)
