"""Shapes of summaries: the same points from each."""

from __future__ import annotations

import json

from doclake.operators.summaries import section_points

TEMPLATE = [("goal", "What for"), ("method", "How"), ("result", "What came out")]
GOAL = [{"text": "It asks why [b_0001, B-2].", "block_ids": ["b_0003", "b_9"]}, {"point": "Second", "citations": "b_0002; b-0001"}, {"text": "[b_0001]"}, {"text": " "}, {"text": "b_0002, b_0003"}]
METHOD = [{"text": "By measuring", "block_ids": []}]
SHAPES = {
    "list": {"sections": [{"key": "goal", "points": GOAL}, {"key": "method", "name": "x", "points": METHOD}]},
    "map": {"sections": {"goal": GOAL, "method": METHOD, "note": "no points"}},
    "mixed": {"sections": [{"key": "goal", "points": GOAL, "method": METHOD, "block_ids": ["b_1"]}]},
    "names": {"sections": [{"key": "What for", "points": GOAL}, {"name": "How", "points": METHOD}, "talk"]},
    "places": {"sections": [{"points": GOAL}, {"key": "???", "points": METHOD}]},
    "alone": {"goal": GOAL, "How": METHOD},
}
WANT = [("goal", 0, "It asks why.", ["b_0003", "b_0001", "b_0002"], False, 1), ("goal", 1, "Second", ["b_0002", "b_0001"], False, 0), ("method", 0, "By measuring", [], True, 0)]


def test_every_shape_gives_the_same_points(spark):
    said = [(i, f"Here it is:\n```json\n{json.dumps(s)}\n```") for i, s in enumerate(SHAPES.values())]
    said += [(10, '{"sections": [{"key": "goal", "points": [{"text": "cut'), (11, "no object"), (12, None), (13, json.dumps({"sections": [{"key": "goal", "points": ["a string"]}, {"key": "goal", "points": METHOD}, {"key": "goal", "points": GOAL}]}))]
    replies = spark.createDataFrame(said, "doc_id long, reply string")
    blocks = spark.createDataFrame([(i, f"b_{n:04d}") for i in range(14) for n in (1, 2, 3)], "doc_id long, block_id string")
    found: dict = {}
    for r in section_points(replies, TEMPLATE, blocks).orderBy("doc_id", "section", "place").collect():
        found.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    for i, name in enumerate(SHAPES):
        assert found[i] == WANT, name
    assert found[13] == [("goal", 0, "By measuring", [], True, 0)] and set(found) == {*range(len(SHAPES)), 13}
    assert section_points(replies.where("false"), TEMPLATE, blocks).count() == 0
