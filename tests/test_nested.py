import json

from tests.conftest import rows
from tessela.operators.nested import nested_links, run_methods, scribble_table, state_links

STATE = {
    "scribbles": [
        {"id": 3, "points": [[0, 1], [1, 2]]}, {"id": "4", "points": [0.1, 0.2, 0.3]}, {"id": 5, "points": [{"x": 1, "y": 2}, None]},
        {"id": 6, "points": None}, {"id": 7}, None, {"points": [[1, 2]]}, {"id": 8, "points": []},
    ],
    "superpixels": {"A|/x.pth": [{"id": 1, "holes": [[[0, 0], [1, 1]], [[0, 0], [1, 1], [2, 2]], None]}, {"id": 2, "holes": None}, None], "B": None},
    "annotations": [{"id": 0, "method": "A", "parent_scribble": [1, "2", None]}, {"id": 1, "method": "A", "parent_scribble": "4"}, {"id": 2, "method": "B", "parent_scribble": 7}, {"id": 3, "method": "B"}],
}
LINKS = {
    ("scribble_point", "3", "0"), ("scribble_point", "3", "1"), ("scribble_point", "4", "0"), ("scribble_point", "5", "0"), ("sp_hole", "A|/x.pth#1", "1"),
    ("anno_scribble", "A#0", "1"), ("anno_scribble", "A#0", "2"), ("anno_scribble", "A#1", "4"), ("anno_scribble", "B#2", "7"),
}


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "c", "p") for i, t in enumerate(texts)], "record_id long, doc_json string, child_id string, link_kind string")


def test_notations_and_wraps(spark):
    text = json.dumps(STATE)
    wrapped = [text, json.dumps(text), json.dumps({"state": STATE, "by": "x"}), json.dumps([STATE]), json.dumps({"a": {"b": text}}), json.dumps(STATE, indent=1)]
    found = rows(state_links(docs(spark, wrapped)))
    assert found == {(i, *x) for i in range(len(wrapped)) for x in LINKS}


def test_states_under_many_wraps(spark):
    text = json.dumps(STATE)
    four = json.dumps({"a": {"b": [{"c": STATE}]}})
    wrapped = [four, json.dumps([[[[[text]]]]]), json.dumps(json.dumps(json.dumps(json.dumps(json.dumps(STATE))))), json.dumps([[[[[{"x": 1}]]], [STATE]]]), four[:-1]]
    assert rows(state_links(docs(spark, wrapped))) == {(i, *x) for i in range(4) for x in LINKS}
    alone = '{"scribbles":[{"id":1e2,"points":[[1.0,2]]},{"id":12345678901234567890,"points":[1,2]},{"id":"7.0","points":[1,2]}]}'
    raw = docs(spark, [alone, '{"a":' * 5 + alone + "}" * 5])
    got = rows(state_links(raw), "record_id", "parent_id")
    assert {p for i, p in got if i == 0} == {p for i, p in got if i == 1} and len(got) == 6


def test_texts_that_hold_nothing(spark):
    text = json.dumps(STATE)
    bad = [None, "", "  \n", "null", "{}", "[]", "17", '"x"', text[:-1], text + text, text + " x", "{" * 50, text.replace(":", ";", 1), '{"scribbles": 5, "superpixels": "x", "annotations": null}']
    assert state_links(docs(spark, bad)).count() == 0


def test_very_long_text_and_repeats(spark):
    state = {"scribbles": [{"id": 1, "points": [[i, i] for i in range(20_000)]}]}
    d = docs(spark, [json.dumps(state)])
    assert state_links(d.union(d)).count() == 20_000
    assert [r.n_points for r in scribble_table(d).collect()] == [20_000]


def test_runs(spark):
    kind = "array<struct<method:string,n_ok:int,n_failed:int,miou_mean:double,miou_variance:double,miou_std:double>>"
    m = lambda name: (name, 1, None, float("nan"), None, 0.5)
    data = [(1, "r", [m("a"), None, m(None), m(" "), m("b"), m("a")], 9), (1, "r", [m("a")], 9), (2, None, [m("a")], 9), (3, "s", None, 9), (4, "t", [], 9)]
    runs = spark.createDataFrame(data, f"record_id long, run_name string, methods {kind}, method int")
    assert rows(nested_links(runs, docs(spark, []))) == {(1, "run_method", "r", "a"), (1, "run_method", "r", "b")}
    assert [r.position for r in run_methods(runs).where("record_id = 1 AND method = 'b'").collect()] == [4]
    assert nested_links(runs.limit(0), docs(spark, [])).count() == 0
