import json

from tests.conftest import rows
from tessela.functions.schematree import assign, distance, parse_type, script
from tessela.operators.drift import changes, edits, unified

SCHEMA = "writer string, file_no int, line_no int, raw_line string, g string, name string"


def lines(spark, files, writer="w"):
    out = []
    for no, records in files.items():
        out += [(writer, no, i, r if isinstance(r, str) or r is None else json.dumps(r), "x", "y") for i, r in enumerate(records)]
    return spark.createDataFrame(out, SCHEMA)


def found(df):
    return {(r.file_no, r.change_kind, r.old_name, r.new_name) for r in changes(df).collect()}


def test_each_kind_of_change(spark):
    files = {
        1: [{"id": 0, "holes": [[[0.1, 0.2]]], "score": 0.5, "flag": True}, {"id": 1, "holes": [], "score": None, "flag": False}],
        3: [{"id": 0, "rings": [[[0.1, 0.2]]], "score": "0.50", "flag": True}, {"id": 1, "rings": [], "score": None, "flag": False}, None, "", '{"id":'],
        4: [{"id": 0, "rings": {"r": [[[0.1, 0.2]]]}, "flag": None, "note": "n"}, {"id": 1, "rings": {"r": []}, "flag": None, "note": "m"}],
        7: [{"id": 0, "rings": {"r": [[[0.1, 0.2]]]}, "direct": 1, "score": 0.5}, {"id": 1, "rings": {"r": []}, "direct": 0, "score": 1}],
    }
    want = {
        (3, "renamed", "holes", "rings"), (3, "retyped", "score", "score"), (4, "retyped", "rings", "rings"), (4, "removed", "score", ""), (4, "added", "", "note"),
        (7, "removed", "flag", ""), (7, "removed", "note", ""), (7, "added", "", "direct"), (7, "added", "", "score"),
    }
    df = lines(spark, files)
    assert found(df) == want
    assert found(df.union(df)) == want  # lines and files delivered twice


def test_rename_and_retype_at_once_and_type_over_nulls(spark):
    files = {
        1: [{"id": i, "code": i + 3, "s": 0.25 * i} for i in range(4)], 2: [{"id": i, "cls": str(i + 3), "s": None} for i in range(4)],
        3: [{"id": i, "cls": str(i + 3), "s": {"value": 0.25 * i}} for i in range(4)],
    }
    assert found(lines(spark, files)) == {(2, "renamed", "code", "cls"), (2, "retyped", "code", "cls"), (3, "retyped", "s", "s")}


def test_rename_with_values_on_one_side_only(spark):
    a = [{"id": i, "holes": [[[0.5, i]]], "score": 0.25 * i, "flag": i % 2 == 0} for i in range(6)]
    b = [{"id": i, "rings": [[[0.5, i]]], "prop": 0.25 * i, "direct": 1 - i % 2} for i in range(6)]
    a[0]["holes"], b[1]["rings"], a[2]["holes"], b[2]["rings"] = None, None, [], []
    del a[3]["score"], b[4]["prop"]
    b[5]["direct"] = None
    all_ = {(2, "renamed", "holes", "rings"), (2, "renamed", "score", "prop"), (2, "renamed", "flag", "direct"), (2, "retyped", "flag", "direct")}
    assert found(lines(spark, {1: a, 2: b})) == all_
    b[2]["rings"] = [[[9, 9]]]  # an empty list is a content: here it was [] before
    assert found(lines(spark, {1: a, 2: b})) == {x for x in all_ if x[2] != "holes"} | {(2, "removed", "holes", ""), (2, "added", "", "rings")}
    none = [{"id": 1, "old": None}], [{"id": 1, "new": None}]  # no value that both files hold: not enough for a rename
    assert found(lines(spark, {1: none[0], 2: none[1]})) == {(2, "removed", "old", ""), (2, "added", "", "new")}


def test_moves_and_nested_edits(spark):
    rec = lambda i, **kv: {"id": i, **kv}
    files = {
        1: [rec(i, score=0.5 * i, code=i + 1, meta={"a": {"x": f"t{i}"}, "n": i * 7}, empty={}) for i in range(4)],
        2: [rec(i, meta={"a": {"y": f"t{i}"}, "n": i * 7, "score": 0.5 * i}, code=i + 1, empty={}) for i in range(4)],  # score into meta, x renamed
        4: [rec(i, meta={"n": i * 7}, y=f"t{i}", box={"score": 0.5 * i, "new": 1}, code={"value": i + 1}, empty={}) for i in range(4)],  # out of and between objects, wrapped
    }
    df = lines(spark, files)
    got = {(r.file_no, r.change_kind, r.old_name, r.new_name) for r in edits(df).collect()}
    assert got == {
        (2, "moved", "score", "meta.score"), (2, "renamed", "meta.a.x", "meta.a.y"), (4, "moved", "meta.a.y", "y"), (4, "moved", "meta.score", "box.score"), (4, "moved", "code", "code.value"), (4, "added", "", "box.new"),
    }
    assert edits(df.limit(0)).count() == 0
    out = {(r.file_no, r.id): r for r in unified(df).collect()}
    assert len(out) == 12 and all(out[f, i].propagation_score == 0.5 * i and out[f, i].code == i + 1 for f in (1, 2, 4) for i in range(4))
    assert json.loads(out[4, 2].extras["box"]) == {"score": 1.0, "new": 1}


def test_records_without_id(spark):
    files = {1: [{"a": 1}, {"id": 2, "a": 5}, {}], 2: [{"b": 1}, {"id": 2, "b": 5}]}
    assert found(lines(spark, files)) == {(2, "renamed", "a", "b")}
    assert found(lines(spark, {1: [{"a": 1}], 2: [{"b": 1}]})) == {(2, "removed", "a", ""), (2, "added", "", "b")}


def test_same_key_twice_and_null_writer(spark):
    twice = '{"id":1,"code":3,"code":4}'
    df = lines(spark, {1: [twice, {"id": 2, "code": 5}], 2: [{"id": 2, "cls": "5"}], None: [{"id": 2, "x": 1}]}, None)
    assert rows(changes(df)) == {(None, 2, "renamed", "code", "cls"), (None, 2, "retyped", "code", "cls")}
    assert {(r.file_no, r.id, r.code) for r in unified(df).collect()} == {(1, 1, 4), (1, 2, 5), (2, 2, 5)}


def test_empty_nulls_and_one_file(spark):
    assert changes(lines(spark, {})).count() == 0
    assert found(lines(spark, {1: [None, "", "[1]", "{"], 2: [{"id": 1}]})) == set()
    both = lines(spark, {1: [{"id": 1, "a": 1}]}).union(lines(spark, {1: [{"id": 1, "b": 1}], 2: [{"id": 2, "c": 1}]}, None))
    assert rows(changes(both)) == {(None, 2, "removed", "b", ""), (None, 2, "added", "", "c")}


def test_unified_keeps_every_value(spark):
    files = {1: [{"id": 1, "code": 5, "holes": [], "extra": "e"}], 2: [{"id": 1, "cls": "5", "holes": {"rings": [[[1, 2]]]}, "parent_scribble": "16;15"}]}
    got = {r.file_no: r for r in unified(lines(spark, files)).collect()}
    assert got[1].code == got[2].code == 5 and got[2].parent_scribble == [16, 15] and json.loads(got[2].holes) == [[[1, 2]]] and got[1].extras == {"extra": "e"}


def test_unified_names_columns_alike_over_writers(spark):
    one = {1: [{"id": i, "prop_score": 0.25 * i, "interiors": [], "intersects_parent": True} for i in range(3)], 2: [{"id": i, "propagation_score": 0.25 * i, "interiors": [], "intersects_parent": 1} for i in range(3)]}
    two = {1: [{"id": i, "propagation_score": 0.5 * i} for i in range(3)], 2: [{"id": i, "score": str(0.5 * i)} for i in range(3)], 3: [{"id": i, "propagation_score": 0.5 * i} for i in range(3)]}
    odd = {n: [{"id": i, name: i + 4} for i in range(3)] for n, name in ((1, "klass"), (2, "code"))}
    df = lines(spark, one, "a").union(lines(spark, two, "b")).union(lines(spark, odd, "c")).union(lines(spark, {**odd, 3: odd[1]}, "d"))
    df = df.union(lines(spark, {1: odd[1]}, "e"))  # no column's name and no alias: as in the other writers
    got = {(r.writer, r.file_no, r.id): r for r in unified(df).collect()}
    assert len(got) == 33 and all(r.extras == {} for r in got.values())
    assert all(got["a", f, i].propagation_score == 0.25 * i and got["a", f, i].holes == "[]" and got["a", f, i].parent_intersect is True for f in (1, 2) for i in range(3))
    assert all(got["b", f, i].propagation_score == 0.5 * i for f in (1, 2, 3) for i in range(3))
    assert all(got[w, f, i].code == i + 4 for w, n in (("c", 2), ("d", 3), ("e", 1)) for f in range(1, n + 1) for i in range(3))


def test_unified_keeps_fields_of_one_name_and_failed_casts(spark):
    files = {
        1: [{"id": 1, "score": 0.5, "note": "n", "code": "x", "parent_intersect": "maybe", "parent_scribble": "1.5", "holes": {"rings": [], "by": "me"}}],
        2: [{"id": 1, "score": 0.5, "propagation_score": 0.75, "memo": "n", "code": 8.0, "parent_scribble": ["7"]}],
        3: [{"id": 1, "score": 0.5, "propagation_score": {"value": 0.75, "unit": "u"}, "memo": "n", "note": "other", "code": 99999999999, "parent_scribble": []}],
    }
    got = {r.file_no: r for r in unified(lines(spark, files)).collect()}
    assert got[1].propagation_score == 0.5 and got[1].code is None and got[1].parent_intersect is None and got[1].parent_scribble is None
    assert got[1].extras == {"note": "n", "code": "x", "parent_intersect": "maybe", "parent_scribble": "1.5"} and json.loads(got[1].holes) == {"rings": [], "by": "me"}
    assert (got[2].propagation_score, got[2].code, got[2].parent_scribble, got[2].extras) == (0.75, 8, [7], {"score": "0.5", "note": "n"})
    assert got[3].extras == {"score": "0.5", "propagation_score": '{"value":0.75,"unit":"u"}', "memo": "n", "note": "other", "code": "99999999999"} and got[3].parent_scribble == []


def test_tree_edit_distance():
    t = parse_type
    assert distance(t("BIGINT"), t("BIGINT")) == 0 and distance(t("BIGINT"), t("STRING")) == 1
    assert distance(t("ARRAY<BIGINT>"), t("OBJECT<rings: ARRAY<BIGINT>>")) == 2
    assert t("OBJECT<b: STRING, `a`: ARRAY<BIGINT>>") == ("OBJECT", (("a", (("ARRAY", (("BIGINT", ()),)),)), ("b", (("STRING", ()),))))
    assert assign([[4, 1, 3], [2, 0, 5], [3, 2, 2]]) == [1, 0, 2]
    assert script({"a": "STRING"}, {"b": "BIGINT", "c": "STRING"}, {("a", "b"), ("a", "c")}) == [("renamed", "a", "c"), ("added", "", "b")]
