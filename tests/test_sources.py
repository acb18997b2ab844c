"""File sources and the replacing sink."""

from __future__ import annotations

import hashlib
import json

from doclake.sources import files


def test_pdf_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.pdf").write_bytes(b"plain")
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.pdf_files(spark, str(tmp_path)).collect()}
    digest = hashlib.sha256(b"%PDF-1.7 x").hexdigest()
    assert got["a.pdf"]["sha256"] == digest and got["a.pdf"]["doc_id"] == "d_" + digest[:16]
    assert got["a.pdf"]["is_pdf"] and not got["b.pdf"]["is_pdf"]


def test_layout(spark, tmp_path):
    block = {"type": "text", "bbox": [0.1, 0.5, 1.2, 0.75], "content": [{"kind": "text", "s": "let"}, {"kind": "math", "s": "x"}]}
    (tmp_path / "l.json").write_text(json.dumps({"doc_id": "d", "pages": [{"width": 600, "height": 800, "blocks": [block]}]}))
    assert [tuple(r) for r in files.layout_blocks(spark, str(tmp_path)).collect()] == [("d", 0, 0, "text", 60.0, 400.0, 600.0, 600.0, "let $x$")]


def test_replace(spark, tmp_path):
    path, kind = str(tmp_path / "t"), "doc_id string, ord int"
    files.replace_documents(spark.createDataFrame([(f"d{i}", k) for i in range(40) for k in range(2)], kind), path)
    new = spark.createDataFrame([("d3", 7), ("d99", 0)], kind)
    after = files.with_replaced(spark.read.parquet(path).select("doc_id", "ord"), new).collect()
    files.replace_documents(spark.createDataFrame(after, kind), path)
    got = {(r["doc_id"], r["ord"]) for r in spark.read.parquet(path).collect()}
    assert got == {(f"d{i}", k) for i in range(40) for k in range(2) if i != 3} | {("d3", 7), ("d99", 0)}


def test_layouts_of_references(spark, tmp_path):
    """Reading order over references, hidden children, inline groups, tables, furniture and upward axes."""
    import json

    from doclake.sources.ref_layouts import ref_layouts

    ref = lambda *names: [{"$ref": f"#/{n}"} for n in names]
    at = lambda page, left, top, right, bottom, **kw: [{"page_no": page, "bbox": {"l": left, "t": top, "r": right, "b": bottom, **kw}}]
    text = lambda label, said, prov, **kw: {"label": label, "text": said, "prov": prov, **kw}
    doc = {
        "doc_id": "d1", "pages": {"1": {"size": {"width": 600, "height": 800}}, "2": {"size": {"width": 600, "height": 400}}},
        "body": {"children": ref("texts/0", "groups/0", "pictures/0", "tables/0", "texts/6", "texts/2", "texts/9")},
        "texts": [
            text("title", "T", at(1, 10, 790, 90, 780)), text("list_item", "one", at(1, 10, 700, 90, 690), marker="1."), text("text", "axis", at(1, 0, 1, 2, 0)), text("caption", "Figure 1", at(1, 5, 500, 50, 490)),
            text("footnote", "a note", at(2, 1, 20, 9, 30, coord_origin="TOPLEFT")), text("page_footer", "7", at(1, 0, 9, 9, 0)), text("section_header", "Head", at(2, 1, 390, 9, 380), level=2, children=ref("texts/7")),
            text("text", "below", at(2, 1, 300, 9, 290) + at(1, 0, 10, 1, 0)), text("formula", "x^2", at(1, 40, 600, 60, 590)), text("text", "", [], content_layer="furniture"), text("text", "with", at(1, 10, 610, 30, 600)),
        ],
        "groups": [{"label": "list", "children": ref("texts/1", "groups/1", "texts/5", "groups/0")}, {"label": "inline", "children": ref("texts/10", "texts/8")}],
        "pictures": [{"label": "picture", "prov": at(1, 0, 580, 100, 510), "captions": ref("texts/3"), "children": ref("texts/2")}],
        "tables": [{"label": "table", "prov": at(2, 0, 200, 50, 100), "footnotes": ref("texts/4"), "data": {"num_rows": 2, "num_cols": 2, "table_cells": [{"start_row_offset_idx": 0, "end_row_offset_idx": 1, "start_col_offset_idx": 0, "end_col_offset_idx": 2, "column_header": True, "text": "a & b"}, {"start_row_offset_idx": 1, "end_row_offset_idx": 2, "start_col_offset_idx": 1, "end_col_offset_idx": 2, "text": "v"}]}}],
    }
    (tmp_path / "d1.json").write_text(json.dumps(doc))
    (tmp_path / "d2.json").write_text(json.dumps({"doc_id": "d2", "pages": {}, "body": {"children": []}}))
    found = ref_layouts(spark, str(tmp_path)).orderBy("doc_id", "ord").collect()
    assert [(r["ord"], r["type"], r["text"], r["page"]) for r in found] == [
        (0, "title", "T", 0), (1, "list_item", "one", 0), (2, "paragraph", "with $x^2$", 0), (3, "figure", "", 0), (4, "caption", "Figure 1", 0), (5, "table", "", 1), (6, "footnote", "a note", 1), (7, "heading", "Head", 1), (8, "paragraph", "below", 1)]
    by = {r["text"] or r["type"]: r for r in found}
    assert tuple(by["T"][c] for c in ("x0", "y0", "x1", "y1")) == (10, 10, 90, 20) and tuple(by["a note"][c] for c in ("y0", "y1")) == (20, 30)
    assert tuple(by["with $x^2$"][c] for c in ("x0", "y0", "x1", "y1")) == (10, 190, 60, 210) and by["one"]["marker"] == "1." and by["Head"]["level"] == 2
    assert by["table"]["html"] == '<table><tr><th colspan="2">a &amp; b</th></tr><tr><td></td><td>v</td></tr></table>' and len(by["below"]["anchors"]) == 2
