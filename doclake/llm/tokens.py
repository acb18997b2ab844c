"""Token ids of whole texts with a tokenizers file, fast on corpora whose words recur."""

from __future__ import annotations

import gc
import json
import os
import re
import sys
from array import array
from itertools import compress, repeat
from operator import is_

import numpy as np

#: Bytes, roughly, of the words whose ids a Python worker keeps.  Beyond it only those of the texts at hand stay, the
#: frequent words among them; no result changes.
KEPT_BYTES = 160 << 20
#: Words of letters that are encoded as one text, whose ids are told apart by how their tokens begin or end.
TOGETHER = 64
_BEFORE_SPACE = re.compile(r"(?<=\S)(?= )")
_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+(?: [A-Za-zÀ-ÖØ-öø-ÿ]+)*")
_PIECES = re.compile(r"[A-Za-z0-9À-ÖØ-öø-ÿ]+|[.,;:!?#$%&*|()\"-]+\n?|\n")
_OPEN: dict[str, TextTokenizer] = {}
#: The rules, as files write them, of which it is known that no token spans the place before a space that
#: follows something else than white space, and that letters, digits and punctuation are apart.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_KNOWN_RULES = [
    {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}},
    {
        "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    },
]


def cuts_at_spaces(path: str) -> bool:
    """Whether the file's rules are known to cut texts before spaces."""
    with open(path, encoding="utf-8") as source:
        rules = json.load(source)
    return {k: rules[k] for k in ("normalizer", "pre_tokenizer")} in _KNOWN_RULES and not any(" " in t["content"] for t in rules["added_tokens"])


class TextTokenizer:
    """Ids as little-endian unsigned 32-bit integers.

    A text is cut before each space that follows a character other than white space.  No pre-token of a byte-level or
    a white-space-dropping BPE spans such a place, so the ids of the text are those of its parts, and each distinct
    part is encoded once.  Texts with other white space before a space are cut by a slower pattern.  A new part such as
    ``word.\nWord,`` is put together from its runs of letters and digits and its punctuation, between which these
    pre-tokenizers cut as well (an apostrophe may start a contraction, so such parts are encoded whole).  With a file of
    other rules, each text is encoded as a whole.
    """

    kept_bytes = KEPT_BYTES

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cuts = cuts_at_spaces(path)
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.end_of_word = self.tokenizer.model.end_of_word_suffix if hasattr(self.tokenizer.model, "end_of_word_suffix") else None
        #: Ids that end a word of letters, if the file marks ends, else those that begin one after a space.
        self.edges = np.array([n.endswith(self.end_of_word) if self.end_of_word else n.startswith("Ġ") for n in names], bool)
        self.heads: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.bytes = 0

    def _encode(self, texts: list[str]) -> list[bytes]:
        ids = (e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))
        return [array("I", x).tobytes() for x in ids] if sys.byteorder == "little" else [np.array(x, "<u4").tobytes() for x in ids]

    def _learn(self, store: dict, words: list[str], lead: str) -> None:
        store.update(zip(words, self._encode([lead + w for w in words]), strict=True))
        self.bytes += sum(map(len, words)) + 200 * len(words)

    def _learn_together(self, words: list[str]) -> None:
        """Words that follow a space; groups of those of letters alone as one text, in which each is one pre-token."""
        apart, groups, texts = [], [], []
        for i in range(0, len(words), TOGETHER):
            group = words[i : i + TOGETHER]
            text = " ".join(group)
            if _LETTERS.fullmatch(text):
                groups.append(group)
                texts.append(" " + text)
            else:
                letters = [w for w in group if _LETTERS.fullmatch(w)]
                apart += [w for w in group if not _LETTERS.fullmatch(w)]
                if letters:
                    groups.append(letters)
                    texts.append(" " + " ".join(letters))
        for group, e in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            at = np.flatnonzero(self.edges[ids]) * 4
            bounds = [0, *(at + 4).tolist()] if self.end_of_word else [*at.tolist(), 4 * len(ids)]
            if len(bounds) != len(group) + 1 or bounds[0] or bounds[-1] != 4 * len(ids):
                apart += group
                continue
            raw = ids.tobytes()
            self.tails.update(zip(group, [raw[i:j] for i, j in zip(bounds, bounds[1:], strict=False)], strict=True))
            self.bytes += sum(map(len, group)) + 200 * len(group)
        self._learn(self.tails, apart, " ")

    def _learn_tails(self, words: list[str]) -> None:
        """Parts that follow a space; those of several pieces from their pieces."""
        whole, made = [], []
        for w in words:
            if w.isalpha():
                whole.append(w)
                continue
            pieces = _PIECES.findall(w)
            if len(pieces) > 1 and pieces[0][0].isalnum() and "\n\n" not in w and sum(map(len, pieces)) == len(w):
                made.append((w, pieces))
            else:
                whole.append(w)
        firsts = {p[0] for _, p in made} - self.tails.keys()
        self._learn_together(list(firsts.union(whole)))
        self._learn(self.heads, list({x for _, p in made for x in p[1:]} - self.heads.keys()), "")
        self.tails.update((w, self.tails[p[0]] + b"".join(map(self.heads.__getitem__, p[1:]))) for w, p in made)
        self.bytes += 250 * len(made)

    def __call__(self, texts: list[str]) -> list[bytes]:
        collects = gc.isenabled()
        gc.disable()  # nothing here is cyclic, and a full collection would walk all parts of all texts
        try:
            return self._ids(texts)
        finally:
            if collects:
                gc.enable()

    def _ids(self, texts: list[str]) -> list[bytes]:
        if not self.cuts:
            return self._encode(texts)
        if self.bytes > self.kept_bytes:
            keep = {w for t in texts for w in t.split(" ")}
            self.heads, self.tails = {}, {w: self.tails[w] for w in keep if w in self.tails}
            self.bytes = sum(map(len, self.tails)) + 200 * len(self.tails)
        parts = [t.split(" ") for t in texts]
        found = [list(map(self.tails.get, p)) for p in parts]
        gaps = [list(compress(range(len(p)), map(is_, f, repeat(None)))) for p, f in zip(parts, found, strict=True)]
        new = dict.fromkeys(p[i] for p, g in zip(parts, gaps, strict=True) for i in g)
        self._learn_tails([w for w in new if w and not w[-1].isspace()])
        self._learn(self.heads, list({p[0] for p in parts} - self.heads.keys()), "")
        get, out = self.tails.get, []
        for text, p, f, g in zip(texts, parts, found, gaps, strict=True):
            for i in g:
                f[i] = get(p[i])
            f[0] = self.heads[p[0]]
            if len(p) > 1 and (None in f or not p[0] or p[0][-1].isspace()):  # a part that can't be cut off
                out.append(b"".join(self._encode(_BEFORE_SPACE.split(text))))
            else:
                out.append(b"".join(f))
        return out


def tokenizer(path: str) -> TextTokenizer:
    """One tokenizer for each file and Python worker."""
    if path not in _OPEN:
        _OPEN[path] = TextTokenizer(path)
    return _OPEN[path]
