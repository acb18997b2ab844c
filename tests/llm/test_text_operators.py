"""Language ID, toxicity, personal data, language-model scores on small documents."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from doclake.llm import language_id, pii, pitman_yor, toxicity
from doclake.llm.common import key_mod

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_language(docs, rows):
    model = language_id.fit(docs.where(key_mod("doc_id", 4) != 2))
    found = {r["doc_id"]: r for r in language_id.predict(docs, model).collect()}
    assert len(found) == len({r[0] for r in rows})
    assert all(found[r[0]]["lang_pred"] == r[2] for r in rows if r[1] and r[2] and r[0] not in (62, 63))
    assert {found[i]["lang_pred"] for i in (60, 61, 62, 63)} == {"und"} and found[60]["score"] == 0.0
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_language_counts_are_those_of_the_filter():
    """Popcounts, correction, choice and score against plain sets, with a filter so small that it errs."""
    draw = random.Random(21)
    word = lambda letters: "".join(draw.choice(letters) for _ in range(draw.randrange(1, 7)))
    own = {"aa": "abcdefgh", "bb": "efghijklm", "cc": "stuvwxyzé", "dd": "abxyzäö"}
    known = {k: set(language_id.ngrams([" ".join(word(v) for _ in range(60))])[0].tolist()) for k, v in own.items()}
    n = 1024
    places = lambda g: [(g >> 21 * i) % n for i in range(language_id.HASHES)]
    filled = {k: {p for g in v for p in places(g)} for k, v in known.items()}
    slots = np.zeros((n, 1), np.uint8)
    for bit, k in enumerate(own):
        slots[sorted(filled[k]), 0] |= 1 << bit
    model = language_id.LanguageFilter(tuple(own), slots, 2)
    texts = [" ".join(word(draw.choice(list(own.values()))) for _ in range(draw.randrange(1, 25))) for _ in range(300)] + ["", "12 ..", "ЖЖЖЖ", "The thing", "zwei über"]
    names, scores = language_id.identify(texts, model)
    errors = 0
    for text, name, score in zip(texts, names, scores, strict=True):
        grams = language_id.ngrams([text])[0].tolist() if any(c.isalpha() for c in text) else []
        seen = {k: sum(all(p in filled[k] for p in places(g)) for g in grams) for k in own}
        errors += sum(seen[k] - sum(g in known[k] for g in grams) for k in own)
        wrong = {k: (len(filled[k]) / n) ** language_id.HASHES for k in own}
        right = {k: max(0.0, (seen[k] - len(grams) * wrong[k]) / (1 - wrong[k])) for k in own}
        if not grams:
            assert (name, score) == ("und", 0.0)
        elif not sum(right.values()):
            assert (name, score) == ("cc", 0.0)  # the most common one
        else:
            assert name == max(own, key=lambda k: right[k]) and score == pytest.approx(right[name] / sum(right.values()), abs=1e-12)
    assert errors > 50


def test_ngrams_of_letters():
    """Lower-cased pairs and triples with the boundary of words at their ends only, one hash each."""
    grams, owners, _ = language_id.ngrams(["the thing", "zwei über"])
    assert set(owners) == {0, 1}
    whole = set(language_id.ngrams(["the thing"])[0].tolist())
    assert whole == set(grams[owners == 0].tolist()) == set(language_id.ngrams(["THE, thing"])[0].tolist())
    spelt = lambda t: {x[i : i + k] for k in language_id.SIZES for x in [f" {t} "] for i in range(len(x) - k + 1) if x[i : i + k].strip() and " " not in x[i + 1 : i + k - 1]}
    assert len(whole) == len(spelt("the thing"))


def test_language_empty(docs, empty):
    nothing = language_id.fit(empty)
    assert nothing.languages == ()
    assert {r["lang_pred"] for r in language_id.predict(docs, nothing).collect()} == {"und"}
    assert language_id.predict(empty, language_id.fit(docs)).count() == 0


def test_toxicity(spark, docs, rows, empty):
    labels = spark.createDataFrame([(r[0], 1, int("idiot" in (r[1] or ""))) for r in rows if r[0] is not None and r[0] < 60] + [(3, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    found = {r["doc_id"]: r for r in toxicity.score(docs.drop("toxic"), model).collect()}
    assert len(found) == len({r[0] for r in rows})
    assert found[4]["score"] > max(found[i]["score"] for i in (5, 6, 60, 61, 66))
    assert found[60]["score"] == found[61]["score"]
    assert toxicity.score(docs, toxicity.fit(docs, labels.where("false"))).agg(F.avg("score")).first()[0] == 0.5
    assert toxicity.score(empty, model).count() == 0


def test_counterfactual_penalty_shrinks_the_gap():
    """A group term that only occurs in toxic texts is blamed less with the penalty than without."""
    insult, group, other, plain = 0, 1, 2, 3
    rows = [np.array([insult, group])] * 20 + [np.array([insult])] * 10 + [np.array([plain])] * 30
    labels = np.array([1.0] * 30 + [0.0] * 30)
    pairs = [(i, np.array([insult, other])) for i in range(20)] + [(30 + i, np.array([plain, k])) for i in range(30) for k in (group, other)]
    free, _ = toxicity.learn(rows, labels, pairs, 4, swap=0.0)
    tied, _ = toxicity.learn(rows, labels, pairs, 4, swap=4.0)
    assert abs(tied[group] - tied[other]) < abs(free[group] - free[other])
    assert toxicity.counterfactuals("Nice Women, here") == ["Nice men here", "Nice girls here"]
    assert toxicity.counterfactuals("nothing") == []


def test_neutral_mentions_score_low(spark):
    """Toxic texts name one group, clean ones none: a plain classifier learns the group's name, this one doesn't."""
    draw = random.Random(8)
    filler = [f"w{i}" for i in range(60)]
    say = lambda: " ".join(draw.choice(filler) for _ in range(12))
    toxic = [f"{say()} muslims {draw.choice(['scum', 'vermin', 'idiots'])} {say()}" for _ in range(150)]
    clean = [say() for _ in range(300)]
    rows = [(i, t, int(i < len(toxic))) for i, t in enumerate(toxic + clean)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    neutral = [f"{say()} muslims {say()}" for _ in range(100)]
    insults = [f"{say()} {draw.choice(['christians', 'jews', ''])} {draw.choice(['scum', 'vermin', 'idiots'])} {say()}" for _ in range(100)]
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(neutral + insults)], "doc_id long, text string")
    model = toxicity.fit(docs, labels)
    found = {r["doc_id"]: r for r in toxicity.score(asked, model).collect()}
    assert sum(found[i]["predicted"] for i in range(100)) <= 2
    assert sum(found[i]["predicted"] for i in range(100, 200)) >= 95
    assert abs(np.diff(model.logits(["so muslims too", "so christians too"]))[0]) < 2


def brute_spans(t):
    found = []
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for kind, p in patterns.items():
        for m in re.finditer(p, t):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": lambda: True, "ip": lambda g=m.group(): all(int(x) <= 255 for x in g.split(".")), "card": lambda n=digits: 12 <= len(n) <= 19 and pii.luhn(n), "phone": lambda n=digits: 9 <= len(n) <= 15}[kind]()
            if ok:
                found.append((kind, m.start(), m.end()))
    return sorted(found, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans_against_the_patterns():
    draw = random.Random(1)
    for _ in range(20_000):
        t = "".join(draw.choice("a@.+-1 2(5)9_%x@.") for _ in range(draw.randrange(40)))
        assert pii.base_spans(t) == brute_spans(t)


def test_field_splits_what_the_patterns_swallow(spark):
    card, draw = "4111111111111111", random.Random(2)
    texts = []
    for _ in range(150):
        phone = f"+1 ({draw.randrange(200, 999)}) 555-{draw.randrange(1000, 9999)}"
        texts += [f"call {phone} now", f"host {'.'.join(str(draw.randrange(1, 255)) for _ in range(4))} up", f"pay {card} please", f"mail a{draw.randrange(99)}.b@host.example.com today", f"no {draw.randrange(10**15, 10**16 - 1)} id"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None), (-2, "+1 (645) 555-3345 4111111111111111 at 10.20.30.40")], "doc_id long, text string")
    model = pii.fit(docs)
    found = {r["doc_id"]: r for r in pii.detect(docs, model).collect()}
    assert found[-1]["spans"] == "" and found[-1]["n_email"] == 0
    assert found[-2]["spans"] == "phone:0:17,card:18:34,ip:38:49"
    assert all(set(pii.written(pii.base_spans(t)).split(",")) <= set(found[i]["spans"].split(",")) for i, t in enumerate(texts))
    masked = {r["doc_id"]: r["text"] for r in pii.redact(docs, model).collect()}
    assert masked[-2] == "<PHONE> <CARD> at <IP>" and masked[-1] is None


def brute_added(model, text):
    """The field's spans by comparing every region with every base span."""
    found, more, free = pii.base_spans(text), [], 0
    for a, b in pii.regions(text):
        if not any(s <= a and b <= e for _, s, e in found):
            more += [(k, a + s, a + e) for k, s, e in model.best(text[a:b], text[a - 1 : a], text[b : b + 1]) if all(a + e <= s2 or e2 <= a + s for _, s2, e2 in found)]
    for k, a, b in sorted(more, key=lambda s: (s[1], -s[2])):
        if a >= free:
            found.append((k, a, b))
            free = b
    return sorted(found, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@pytest.fixture(scope="module")
def field(spark):
    return pii.fit(spark.createDataFrame([], "doc_id long, text string"))


def test_field_finds_what_the_patterns_do_not_know(field):
    right = wrong = n = clean = 0
    for region, spans in pii.made_up(800, seed=99):
        text = f"so {region} it is"
        wanted = [(k, a + 3, b + 3) for k, a, b in spans]
        got = field.spans(text)
        if wanted:
            n, right = n + 1, right + (got == wanted)
        else:
            clean, wrong = clean + 1, wrong + bool(got)
    assert right >= 0.95 * n and wrong <= 0.02 * clean, (right, n, wrong, clean)
    assert field.spans("we look at things. A dot is at the end, at 12 or at 3.14 percent") == []


def test_added_spans_against_brute_force(field):
    draw = random.Random(3)
    for _ in range(3000):
        t = "".join(draw.choice(["a", "@", " at ", " dot ", ".", "555", "-", " ", "12", "(", ")", "+1", "99", "x"]) for _ in range(draw.randrange(30)))
        assert field.spans(t) == brute_added(field, t)


def test_spans_of_a_long_text_take_linear_time(field):
    import time

    def seconds(n):
        text = "call (555) 123-4567 or +1 645 555 3345, 10.20.30.40 x@y.example " * n
        start = time.perf_counter()
        found = field.spans(text)
        assert len(found) == 4 * n
        return time.perf_counter() - start

    assert seconds(4000) < 10 * max(0.05, seconds(1000))


def test_language_model(docs, rows, empty):
    found = pitman_yor.score(docs, key_mod("doc_id", 7) == 2).collect()
    held = {r["doc_id"]: r["held_out"] for r in found}
    lower = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    tokens = {r[0]: WORD.findall((r[1] or "").translate(lower)) + [None] for r in rows}
    counts = Counter(w for k, ws in tokens.items() if not held[k] for w in ws)
    n, v = sum(counts.values()), len(counts)
    assert len(found) == len(rows)
    for r in found:
        ws = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(counts[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
    assert sum(r["score"] for r in found) > sum(r["base_score"] for r in found)
    assert pitman_yor.score(empty, key_mod("doc_id", 7) == 2).count() == 0


def pair_probabilities(blocks, model):
    """(word, context) -> probability of everything that the blocks ask."""
    answers, out = {(r["block"], r["shard"]): r["log"] for r in model.answers().collect()}, {}
    for row in blocks.collect():
        b = pitman_yor.Block.of(row.asDict(), model.shards, model.hot)
        for s in np.flatnonzero(np.diff(b.cut)):
            mine, log = slice(b.cut[s], b.cut[s + 1]), np.frombuffer(answers[row["block"], s], np.float32)
            out |= {(int(b.words[w]), int(b.words[c])): 10.0 ** float(x) for w, c, x in zip(b.word[mine], b.context[mine], log, strict=True)}
    return out


def test_language_model_is_a_distribution(spark, monkeypatch):
    """For each context, the probabilities of all words and an unknown one add up to 1: code, sums and seating of production, with and without hot words."""
    draw = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words[min(59, int(draw.expovariate(0.1)))] for _ in range(120)) for _ in range(40)]
    seen = sorted({w for t in texts for w in t.split()})
    held = [f"{c} {w}" for c in [*seen[:12], "never"] for w in [*seen, "never"]]
    rows = spark.createDataFrame([(i, i >= len(texts), t) for i, t in enumerate(texts + held + [*seen, "never", "never never"])], "id long, held boolean, t string").repartition(2)
    blocks = pitman_yor.saved(rows.mapInArrow(pitman_yor._blocks, pitman_yor._BLOCK_ROW), "blocks")
    ids = {w: int(pitman_yor.tokens([w])[0][0]) for w in [*seen, "never"]}
    for hot, shards in ((10**6, 1), (30, 3)):
        monkeypatch.setattr(pitman_yor, "HOT", hot)
        model = pitman_yor.learn(blocks, shards)
        assert (len(model.hot) > 3) and (len(model.hot) < 20 or hot > 30)
        p = pair_probabilities(blocks, model)
        for c in [*seen[:12], "never"]:
            mass = sum(p[ids[w], ids[c]] for w in ids) + p[int(pitman_yor.END), ids[c]]
            assert math.isclose(mass, 1.0, abs_tol=1e-6), (c, mass)


def exact_tables(n, new, d):
    """Mean number of tables of n customers, given the weight of a new one."""
    weight = np.zeros(n + 1)
    weight[1] = new
    for k in range(1, n):
        weight[1:] = weight[:-1] * new + np.maximum(0.0, k - np.arange(1, n + 1) * d) * weight[1:]
        weight /= weight.sum()
    return (weight * np.arange(n + 1)).sum()


def test_language_model_revisits_every_customer():
    """A frequent pair's tables follow the root's probability, not how it was first seated."""
    n, rest = 3000, 400
    count = np.concatenate([[n], np.full(rest, 3)])
    shard = pitman_yor.Shard(0, np.arange(1, rest + 2, dtype=np.uint64), np.arange(rest + 1), np.arange(7, dtype=np.uint64), np.concatenate([[0], np.arange(rest) % 6 + 1]), count)
    none = np.zeros(0)
    sums = pitman_yor.Sums((0.7, 0.5), rest + 1, int(count.sum()), 20_000.0, 10_000.0, none.astype(np.uint64), none, none, none)
    at, found, wanted = pitman_yor.Restaurants(shard, sums, np.random.default_rng(1)), [], []
    for _ in range(12):
        new = (pitman_yor.STRENGTH + 0.7 * 60_000) * float(at.root_probability()[0])
        at.sweep(np.full(7, 60_000.0))
        found.append(int(at.seats.tables[0]))
        wanted.append(exact_tables(n, new, 0.7))
    assert abs(np.mean(found[4:]) / np.mean(wanted[4:]) - 1) < 0.15, (found, wanted)


def test_language_model_table_counts():
    """Tables of small dishes and of large ones against the exact distribution of 600 customers."""
    n, d, new, found = 600, 0.6, 3.0, []
    exact = exact_tables(n, new, d)
    for possible in (n, 10**6):
        seats = pitman_yor.Seating(np.full(300, n), np.full(300, possible), np.random.default_rng(4))
        for _ in range(6):
            seats.step(np.full(300, new), d)
        found.append(seats.tables.mean())
    assert abs(found[0] / exact - 1) < 0.05 and abs(found[1] / exact - 1) < 0.1, (found, exact)
