"""The audit of filters, and encoding by prefixes, against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from itertools import permutations

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from doclake.llm import audit, prefix_bpe, tokens

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def brute_audit(docs, labels):
    marks = {}
    for key, good, bad in labels:
        g, b = marks.get(key, (False, False))
        marks[key] = (g or good == 1, b or bad == 1)
    least = {}
    for key, text, _ in docs:
        if key is not None:
            least[text or ""] = min(key, least.get(text or "", key))
    rows = []
    for key, text, part in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": key is not None and least[t] < key}
        rows.append((part or "", fails, *(marks.get(key, (False, False)) if key is not None else (False, False))))
    out = {}
    for order in permutations("ABCDE"):
        for part, fails, good, bad in rows:
            gone = next((k for k, f in enumerate(order, 1) if fails[f]), 6)
            for step, f in enumerate(order, 1):
                r = out.setdefault((part, "".join(order), step), [0] * 6)
                r[0] += gone > step
                r[1] += gone == step
                r[2] += fails[f] and gone < step
                r[3] += fails[f] and sum(fails.values()) == 1
                r[4] += gone == step and good
                r[5] += gone == step and bad
    shares = {}
    for (part, order, step), r in out.items():
        f = order[step - 1]
        shares[part, f] = shares.get((part, f), 0) + r[1]
    return {k: (*r, shares[k[0], k[1][k[2] - 1]]) for k, r in out.items()}


def test_audit_against_brute_force(spark):
    draw = random.Random(12)
    text = lambda: " ".join(draw.choice(["one", "two", "BIG", "x#y", "größer", "\v", "a\tb"]) + str(draw.randrange(draw.choice([3, 900]))) for _ in range(draw.choice([0, 5, 150, 230])))
    texts = [text() for _ in range(40)] + [None, "", " \n"]
    docs = [(draw.choice([None, *range(30)]), draw.choice(texts), draw.choice([None, "", "p", "q.r", "`"])) for _ in range(160)]
    docs += [(7, texts[0], "p")] * 3 + [(40, "$ " * 300_000, "long"), (41, "w" * 1_000_000, "long")]
    labels = [(draw.choice([None, *range(45)]), draw.choice([0, 1, None]), draw.choice([0, 1, None])) for _ in range(60)]
    frame = spark.createDataFrame([(*d, 1, "x", 2, 3) for d in docs], "doc_id long, text string, source string, n int, `a.b` string, `c0` int, key int").repartition(3)
    marks = spark.createDataFrame([(*x, 5) for x in labels], "doc_id long, quality int, toxic int, part int")
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in audit.audit(frame, marks).collect()}
    assert found == brute_audit(docs, labels)
    assert audit.audit(frame.where("false"), marks).count() == 0
    bare = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in audit.audit(frame, marks.where("false")).collect()}
    assert bare == brute_audit(docs, [])


@pytest.fixture(scope="module")
def prefixes():
    return prefix_bpe.PrefixTokenizer(BYTE)


def test_prefixes_against_the_library(prefixes):
    draw, plain = random.Random(13), Tokenizer.from_file(BYTE)
    letters = "ab  \n\t'stheéß漢字🙂▁ ́.,;0123\x1c\x85　"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randrange(50))) for _ in range(3000)]
    texts += ["".join(draw.choice(["<|endoftext|>", "<|endoftext", " ", "  ", "\n", "aaa", "xaxa", "'s"]) for _ in range(draw.randrange(12))) for _ in range(1000)]
    texts += [c * n for c in ("a", "ab", "=", " ", "é") for n in range(1, 120)] + ["".join(draw.choice("etaoin") for _ in range(100_000))]
    want = plain.encode_batch(texts, add_special_tokens=False)
    for text, raw, w in zip(texts, prefixes(texts), want, strict=True):
        ids = [int.from_bytes(raw[i : i + 4], "little") for i in range(0, len(raw), 4)]
        assert ids == w.ids, text
        assert prefixes.decode(ids) == plain.decode(ids, skip_special_tokens=False) == text


def test_decoding_of_any_ids(prefixes):
    draw, plain = random.Random(14), Tokenizer.from_file(BYTE)
    for _ in range(300):
        ids = [draw.randrange(50257) if draw.random() < 0.6 else draw.randrange(100, 256) for _ in range(draw.randrange(8))]
        assert prefixes.decode(ids) == plain.decode(ids, skip_special_tokens=False)


def test_one_last_token_for_each_prefix(prefixes):
    """Every other entry that ends at a place is refused, and stepwise merging gives the same tokens."""
    m = prefixes.merges
    name = {i: n for n, i in m.ids.items()}
    for word in ("Ġunbelievable", "Ġthththth", "aaaaaaa", "Ġinininterin", "0000000"):
        for end in range(1, len(word) + 1):
            parts = list(word[:end])
            while True:
                options = [(m.rank[p], i) for i, p in enumerate(zip(map(m.ids.get, parts), map(m.ids.get, parts[1:]), strict=False)) if p in m.rank]
                if not options:
                    break
                _, i = min(options)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            assert [name[i] for i in m.encode([word[:end]])[0]] == parts


def test_files_the_method_cannot_take():
    with pytest.raises(ValueError, match="before those of its parts"):
        prefix_bpe.Merges({"a": 0, "b": 1, "ab": 2, "abab": 3}, [("ab", "ab"), ("a", "b")])
    with pytest.raises(ValueError, match="not the only one"):
        prefix_bpe.Merges({"a": 0, "b": 1, "ab": 2, "ba": 3, "aba": 4}, [("a", "b"), ("b", "a"), ("ab", "a"), ("a", "ba")])
    with pytest.raises(ValueError, match="byte-level"):
        prefix_bpe.PrefixTokenizer(public_tokenizers.path("word_bpe_49k.json"))


def test_other_rules_are_encoded_whole(tmp_path):
    """A file whose pre-tokenizer isn't known is not cut at spaces."""
    from tokenizers import pre_tokenizers

    other = Tokenizer.from_file(BYTE)
    other.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    other.save(str(tmp_path / "other.json"))
    texts = ["of the and the", "in the  of", ""]
    found = tokens.TextTokenizer(str(tmp_path / "other.json"))(texts)
    assert found == [b"".join(i.to_bytes(4, "little") for i in e.ids) for e in other.encode_batch(texts, add_special_tokens=False)]
    assert not tokens.cuts_at_spaces(str(tmp_path / "other.json")) and tokens.cuts_at_spaces(BYTE) and tokens.cuts_at_spaces(public_tokenizers.path("word_bpe_49k.json"))


def test_digests_of_odd_rows(docs, rows, empty):
    plain = Tokenizer.from_file(BYTE)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ids = lambda t: plain.encode(t or "", add_special_tokens=False).ids
    found = prefix_bpe.digests(docs.union(docs.where("doc_id < 3")), BYTE)
    assert found.columns == [*docs.columns, "n_tokens", "ids_sha256", "decoded_sha256"]
    want = [(r[0], len(ids(r[1])), sha(",".join(map(str, ids(r[1])))), sha(r[1] or "")) for r in [*rows, *rows[:3]]]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, *tuple(r)[-3:]) for r in found.collect()) == sorted((w[0] is None, w[0] or 0, *w[1:]) for w in want)
    assert prefix_bpe.digests(empty, BYTE).count() == 0
    whole = prefix_bpe.encoded(docs.where("doc_id = 1"), BYTE).first()
    assert list(whole["ids"]) == ids(rows[1][1]) and whole["decoded"] == rows[1][1]
