"""Tables, figures, offsets and outlines against plain Python."""

from __future__ import annotations

import html
import random
import re

import doclake.plans  # noqa: F401  registers the queries
from doclake.operators import layout, offsets, trees
from doclake.plans.queries import QUERIES

CELLS = "table_id int, row int, col int, row_end int, col_end int, header boolean, text string"
BLOCKS = "doc_id long, page int, ord int, type string, text string, x0 double, y0 double, x1 double, y1 double"


# --- tables ---


def drawn(cells, rows, cols):
    at = {(c[1], c[2]): c for c in cells}
    hidden, lines = set(), []
    for r in range(rows):
        line = ""
        for k in range(cols):
            if (r, k) in hidden:
                continue
            c = at.get((r, k))
            if c is None:
                line += "<td></td>"
                continue
            hidden |= {(i, j) for i in range(r, c[3]) for j in range(k, c[4])}
            tag = "th" if c[5] else "td"
            spans = "".join(f' {n}="{v}"' for n, v in (("rowspan", c[3] - r), ("colspan", c[4] - k)) if v > 1)
            line += f"<{tag}{spans}>{html.escape(c[6] or '')}</{tag}>"
        lines.append(f"<tr>{line}</tr>")
    return "<table>" + "".join(lines) + "</table>"


def test_tables_with_spans_that_overlap(spark):
    draw, rows = random.Random(1), []
    for t in range(60):
        places = draw.sample([(r, c) for r in range(4) for c in range(4)], draw.randrange(1, 12))
        rows += [(t, r, c, min(4, r + draw.choice([1, 1, 2, 3])), min(4, c + draw.choice([1, 1, 2])), r == 0, draw.choice(["a<b", "&", '"q\'', None, ""])) for r, c in places]
    found = {r["table_id"]: r["html"] for r in layout.table_html(spark.createDataFrame(rows, CELLS), spark.createDataFrame([(0, 5, 6)], "table_id int, rows int, cols int")).collect()}
    own = {t: [r for r in rows if r[0] == t] for t in {r[0] for r in rows}}
    assert found == {t: drawn(c, *((5, 6) if t == 0 else (max(x[3] for x in c), max(x[4] for x in c)))) for t, c in own.items()}
    assert layout.table_html(spark.createDataFrame([], CELLS)).count() == 0


# --- figures ---


def merged(page):
    """One page's blocks (ord, type, text, box): what the operator's docstring says, over lists."""
    gap = lambda a, b: max(0, b[0] - a[2], a[0] - b[2], b[1] - a[3], a[1] - b[3])
    union = lambda boxes: (min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes))
    figures = [b for b in page if b[1] == "figure"]
    marks = [b for b in page if b[1] in ("caption", "paragraph", "other", "heading") and re.match(layout.PART_MARK, b[2]) and (b[1] == "caption" or any(gap(b[3], f[3]) <= 20 for f in figures))]
    groups = []
    for n in figures + marks:
        near = [g for g in groups if any(gap(n[3], m[3]) <= 20 for m in g)]
        groups = [g for g in groups if g not in near] + [[n, *(m for g in near for m in g)]]
    gone, new = {b[0] for b in marks}, {}
    for g in sorted(groups, key=lambda g: min(m[0] for m in g)):
        if sum(m[1] == "figure" for m in g) < 2:
            continue
        u = union([m[3] for m in g])
        under = [c for c in page if c[1] == "caption" and c[0] not in {m[0] for m in marks} and re.match(layout.FIGURE_CAPTION, c[2]) and u[3] - 10 <= c[3][1] <= u[3] + 40 and min(u[2], c[3][2]) - max(u[0], c[3][0]) >= 0.5 * min(u[2] - u[0], c[3][2] - c[3][0])]
        inside = [b for b in page if b[1] != "figure" and b not in marks and (len(b[2]) >= 30 or b[1] in ("table", "equation")) and u[0] < (b[3][0] + b[3][2]) / 2 < u[2] and u[1] < (b[3][1] + b[3][3]) / 2 < u[3]]
        if under and not inside:
            gone |= {m[0] for m in g}
            new.setdefault(min(under, key=lambda c: (c[3][1], c[0]))[0], []).append(u)
    out = []
    for b in sorted(page):
        if b[0] in new:
            out.append(("figure", "", union(new[b[0]])))
        if b[0] not in gone:
            out.append((b[1], b[2], b[3]))
    return out


def test_figures_of_parts(spark):
    draw, pages = random.Random(2), {}
    kinds = ["figure"] * 5 + ["caption"] * 3 + ["paragraph", "other", "heading", "table"]
    for p in range(120):
        blocks = []
        for i in range(draw.randrange(1, 11)):
            kind = draw.choice(kinds)
            x, y = draw.randrange(0, 400, 10), draw.randrange(0, 300, 10)
            w, h = (draw.choice([60, 100, 150]), draw.choice([60, 100])) if kind == "figure" else (draw.choice([10, 200]), 12)
            text = "" if kind == "figure" else draw.choice(["(a)", "b.", "iv", "Figure 1. Both parts.", "图 2", "A long sentence of more than thirty letters.", "Fig no"])
            blocks.append((i, kind, text, (float(x), float(y), float(x + w), float(y + h))))
        pages[p] = blocks
    rows = [(p // 3, p % 3, i, k, t, *box) for p, page in pages.items() for i, k, t, box in page]
    want = [(p // 3, *b) for p, page in pages.items() for b in merged(page)]
    found = layout.merged_figures(spark.createDataFrame(rows, BLOCKS)).orderBy("doc_id", "ord").collect()
    assert [(r["doc_id"], r["type"], r["text"], (r["x0"], r["y0"], r["x1"], r["y1"])) for r in found] == want
    assert 0 < sum(k == "figure" and t == "" for _, k, t, _ in want) < sum(r[3] == "figure" for r in rows)
    assert layout.merged_figures(spark.createDataFrame([], BLOCKS)).count() == 0


def test_figures_of_whole_documents(spark, data):
    from doclake.plans.feature_queries import drawn_pages

    pages: dict = {}
    for r in drawn_pages(spark, data).collect():
        pages.setdefault((r["doc_id"], r["page"]), []).append((r["ord"], r["type"], r["text"], (r["x0"], r["y0"], r["x1"], r["y1"])))
    want: dict = {}
    for doc, page in sorted(pages):
        want.setdefault(doc, []).extend(merged(pages[doc, page]))
    found = {(r["doc_id"], r["ord"]): (r["type"], (r["x0"], r["y0"], r["x1"], r["y1"])) for r in QUERIES["figure_merge"](spark, data).collect()}
    assert found == {(doc, i): (k, box) for doc, blocks in want.items() for i, (k, _, box) in enumerate(blocks)}


# --- offsets ---


def pieces(text, marks):
    out, at = [], 0
    for part in re.split("(⟦[^⟧]*⟧)", text):
        if re.fullmatch("⟦[^⟧]*⟧", part):
            out.append((at, at + len(part), None))
        else:
            shown = [max((s for s, a, z in marks if a <= i < z), default=None) for i in range(at, at + len(part))]
            start = at
            for i in range(at + 1, at + len(part) + 1):
                if i == at + len(part) or shown[i - at] != shown[i - at - 1]:
                    out.append((start, i, shown[start - at]))
                    start = i
        at += len(part)
    return out


def test_segments_by_marks(spark):
    draw = random.Random(3)
    texts, marks = [], []
    for i in range(200):
        texts.append((1, f"b{i}", "".join(draw.choice(["ab ", "⟦CITE1⟧", "漢", "🙂", "⟦", "x"]) for _ in range(draw.randrange(8)))))
        marks += [(1, f"b{i}", s, a, a + draw.randrange(0, 9)) for s in range(draw.randrange(5)) for a in [draw.randrange(20)]]
    found: dict = {}
    for r in offsets.segments(spark.createDataFrame(texts, "doc_id long, block_id string, text string"), spark.createDataFrame(marks, "doc_id long, block_id string, seq int, start int, stop int")).collect():
        found.setdefault(r["block_id"], []).append((r["start"], r["stop"], r["mark"]))
    for _, b, t in texts:
        got = sorted(found.get(b, []), key=lambda p: p[:2])
        assert got == pieces(t, [m[2:] for m in marks if m[1] == b])
        assert "".join(t[a:z] for a, z, _ in got) == t


def test_anchors_behind_markers(spark):
    marker = r"\[b_[0-9]+\]"
    answers = [(1, "The cat[b_0001] sat on[b_0002][b_0003] the mat."), (2, "a.b (c) a b"), (3, "nothing")]
    anchors = [(1, 0, "x", "cat sat"), (1, 1, "y", "sat on"), (1, 2, "z", "on  the mat."), (1, 3, "w", " "), (1, 4, "v", "dog"), (2, 0, "p", "(c)"), (2, 1, "q", "a b"), (2, 2, "r", "a.b")]
    found = {(r["answer"], r["id"]): (r["start"], r["stop"]) for r in offsets.anchor_ranges(spark.createDataFrame(answers, "answer int, text string"), spark.createDataFrame(anchors, "answer int, seq int, id string, text string"), marker).collect()}
    text = dict(answers)
    shown = {k: re.sub(marker, "", text[k[0]][a:z]) for k, (a, z) in found.items()}
    assert shown == {(1, "x"): "cat sat", (1, "z"): "on the mat.", (2, "p"): "(c)", (2, "q"): "a b", (2, "r"): "a.b"}
    assert text[1][slice(*found[1, "x"])] == "cat[b_0001] sat"


# --- outlines ---


def outline(nodes):
    known = {n[0] for n in nodes}
    below: dict = {}
    for i, parent, name in nodes:
        below.setdefault(parent if parent in known else None, []).append((name, i))
    out = []

    def walk(parent, depth):
        for _, i in sorted(below.get(parent, [])):
            out.append((i, depth, len(out) + 1))
            walk(i, depth + 1)

    walk(None, 0)
    return out


def climbed(nodes):
    up = {i: p for i, p, _ in nodes}
    out = {}
    for i in up:
        cur, seen = i, set()
        while up.get(cur) is not None and cur not in seen:
            seen.add(cur)
            cur = up[cur]
        out[i] = cur
    return out


def test_outlines_and_roots(spark):
    draw, every = random.Random(4), {}
    for t in range(12):
        n = draw.randrange(1, 25)
        every[t] = [(i, draw.choice([None, 99, i, *range(n)] if t % 2 else [None, 99, *range(i)]), draw.choice("abc")) for i in range(n)]
    every[12] = [(i, i - 1 if i else None, "x") for i in range(40)]
    frame = spark.createDataFrame([(t, *n) for t, nodes in every.items() for n in nodes], "tree int, id int, parent int, name string")
    found = trees.preorder(frame).orderBy("tree", "place").collect()
    assert [tuple(r) for r in found] == [(t, *r) for t, nodes in every.items() for r in outline(nodes)]
    roots = {(r["tree"], r["id"]): r["root"] for r in trees.climbed_roots(frame).collect()}
    assert roots == {(t, i): r for t, nodes in every.items() for i, r in climbed(nodes).items()}
