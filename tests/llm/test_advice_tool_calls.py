"""Dependencies inside a turn and between calls without turns."""

from __future__ import annotations

from firmledger.llm import tool_calls


def test_dependencies_inside_a_turn_and_without_turns_are_ordered(spark):
    ask = '{"text":"x","words":1}'
    calls = [
        (1, "a", 1, "ask", ask, ["b"]), (1, "b", 1, "ask", ask, None), (2, "a", 1, "ask", ask, ["b"]), (2, "b", 1, "ask", ask, ["a"]),
        (3, "a", None, "ask", ask, ["b"]), (3, "b", None, "ask", ask, []), (4, "a", None, "ask", ask, ["b"]), (4, "b", 2, "ask", ask, ["a"]),
        (5, "b", 2, "ask", ask, ["a"]), (5, "a", 1, "ask", ask, []), (6, "a", 1, "ask", ask, ["a"]),
    ]
    results = [(c[0], c[1], 3, "R") for c in calls]
    got = tool_calls.link_calls(
        spark.createDataFrame(calls, "conv_id bigint, call_id string, turn bigint, name string, arguments string, depends_on array<string>"),
        spark.createDataFrame(results, "conv_id bigint, call_id string, turn bigint, content string"),
    ).collect()
    order = {c: [r.call_id for r in sorted((r for r in got if r.conv_id == c), key=lambda r: (r.level, r.turn or 0, r.call_id))] for c in (1, 3, 5)}
    assert order == {1: ["b", "a"], 3: ["b", "a"], 5: ["a", "b"]}
    status = {(r.conv_id, r.call_id): r.status for r in got}
    assert {key for key, value in status.items() if value == "cyclic"} == {(2, "a"), (2, "b"), (4, "a"), (4, "b"), (6, "a")}
    assert {r.level for r in got if r.conv_id == 5} == {0}
