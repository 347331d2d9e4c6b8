"""Deeply nested records to flat tables that keep their parent links.

Everything is a projection: JSON is opened with ``from_json`` level by level,
nested ``transform`` calls attach the ancestors' keys and positions, ``flatten``
joins the levels, and one ``inline`` per target table emits rows. No shuffle is
needed before the final removal of repeats.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

_STATE_KEYS = ("scribbles", "superpixels", "annotations")  # fixed values: the members that make a state
_WRAPS = 3  # how many values around a state are opened with functions; more are opened in Python
_NUMBER = "0b7c8f5e4d6a4f0e9a51-number:"  # marks a number's own notation while it is held as text


def complete_json(text: Column) -> Column:
    """``text`` where it is one complete JSON value, else null (blank, cut or followed by more)."""
    once = F.json_array_length(F.concat(F.lit("["), text, F.lit("]")))
    twice = F.json_array_length(F.concat(F.lit("[["), text, F.lit("]]")))
    return F.when((F.length(F.trim(text)) > 0) & (once == 1) & (twice == 1), text)


def _opens(text: Column, mark: str) -> Column:
    return text.rlike(rf"^\s*\{mark}")


def json_list(text: Column) -> Column:
    """The elements of a JSON array as JSON texts (strings unquoted), null for anything else."""
    return F.when(_opens(text, "["), F.from_json(text, "array<string>"))


def json_members(text: Column) -> Column:
    """The members of a JSON object as a map of JSON texts, null for anything else."""
    return F.when(_opens(text, "{"), F.from_json(text, "map<string,string>"))


def _or_empty(c: Column, kind: str) -> Column:
    return F.coalesce(c, F.array().cast(kind))


def is_state(text: Column) -> Column:
    """Whether a JSON object has a member that makes a state; only its keys are read."""
    return F.exists(F.json_object_keys(text), lambda k: k.isin(*_STATE_KEYS))


def _unwrap(text: Column) -> Column:
    inner = F.filter(F.map_values(json_members(text)), lambda v: _opens(v, "{") | _opens(v, "[") | _opens(v, '"'))
    quoted = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>")
    found = (
        F.when(_opens(text, "{"), F.when(is_state(text), F.array(text)).otherwise(inner))
        .when(_opens(text, '"'), quoted)
        .when(_opens(text, "["), json_list(text))
    )
    return F.filter(_or_empty(found, "array<string>"), lambda v: v.isNotNull())


def _states_within(text: str) -> list[str]:
    """The states under any number of wraps; numbers keep their notation."""

    def read(t: str) -> list:
        try:
            return [json.loads(t, parse_int=lambda x: _NUMBER + x, parse_float=lambda x: _NUMBER + x, strict=False)]
        except (ValueError, RecursionError):
            return []

    out, todo = [], read(text)
    while todo:
        value = todo.pop()
        if isinstance(value, dict) and any(k in value for k in _STATE_KEYS):
            out.append(re.sub(f'"{_NUMBER}([^"]*)"', r"\1", json.dumps(value, ensure_ascii=False)))
        elif isinstance(value, (dict, list)):
            todo += [*(value.values() if isinstance(value, dict) else value)][::-1]
        elif isinstance(value, str) and value.lstrip()[:1] in ("{", "[", '"'):
            todo += read(value)
    return out


@F.pandas_udf(ArrayType(StringType()))
def _deep_states(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for block in texts:
        yield block.map(lambda listed: None if listed is None else [s for t in listed for s in _states_within(t)])


def open_states(doc_json: Column) -> Column:
    """The states that a text holds, as JSON texts: one, or those wrapped in strings, objects or lists."""
    states = F.filter(F.array(complete_json(doc_json)), lambda v: v.isNotNull())
    for _ in range(_WRAPS):
        states = F.flatten(F.transform(states, _unwrap))
    opened = lambda s: _opens(s, "{") & F.coalesce(is_state(s), F.lit(False))
    closed = F.filter(states, lambda s: ~opened(s) & (_opens(s, "{") | _opens(s, "[") | _opens(s, '"')))
    return F.concat(F.filter(states, opened), _or_empty(_deep_states(F.when(F.size(closed) > 0, closed)), "array<string>"))


def point_positions(points: Column) -> Column:
    """The positions (from 0) of the points of a list in any of its notations.

    ``[[x, y], ..]``, ``[{"x":..,"y":..}, ..]``, flat ``[x, y, x, y, ..]``,
    ``{"x": [..], "y": [..]}``, or a text of numbers. Null entries are no points
    but keep their position; half a pair at the end of a flat list is none.
    """
    n = F.json_array_length(points)
    pairs = points.rlike(r"^\s*\[\s*(?:null\s*,\s*)*[\[{]")
    of_pairs = F.filter(
        F.transform(json_list(points), lambda e, i: F.when(_opens(e, "[") | _opens(e, "{"), i)), lambda i: i.isNotNull()
    )
    half = F.floor(n / 2).cast("int")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1))
    xs = json_list(F.element_at(json_members(points), "x"))
    numbers = F.size(F.regexp_extract_all(points, F.lit(r"-?[0-9.]+(?:[eE][-+]?[0-9]+)?"), F.lit(0)))
    found = (
        F.when(pairs & points.contains("null"), of_pairs)
        .when(pairs, upto(n))
        .when(_opens(points, "["), upto(half))
        .when(_opens(points, "{"), upto(F.size(xs)))
        .otherwise(upto(F.floor(numbers / 2).cast("int")))
    )
    return _or_empty(found, "array<int>")


def _items(text: Column, fields: str) -> Column:
    """The objects of a JSON list, each opened once to the named fields as JSON texts; other entries are left out."""
    objects = F.filter(_or_empty(json_list(text), "array<string>"), lambda e: _opens(e, "{"))
    return F.transform(objects, lambda e: F.from_json(e, ", ".join(f"{f} string" for f in fields.split())))


def _by_method(text: Column, fields: str) -> Column:
    """``superpixels`` or ``annotations`` as structs (method, item): a map by method, or a list of items that name theirs."""
    listed = F.transform(_items(text, fields), lambda e: F.struct(e["method"].alias("m"), e.alias("e")))
    mapped = F.flatten(
        F.transform(F.map_entries(json_members(text)), lambda kv: F.transform(_items(kv["value"], fields), lambda e: F.struct(kv["key"].alias("m"), e.alias("e"))))
    )
    kind = "array<struct<m:string,e:struct<" + ",".join(f"{f}:string" for f in fields.split()) + ">>>"
    return _or_empty(F.when(_opens(text, "["), listed).when(_opens(text, "{"), mapped), kind)


def _link(kind: str, parent: Column, child: Column) -> Column:
    return F.struct(F.lit(kind).alias("link_kind"), parent.cast("string").alias("parent_id"), child.cast("string").alias("child_id"))


_LINKS = "array<struct<link_kind:string,parent_id:string,child_id:string>>"


def _scribble_points(text: Column) -> Column:
    return F.flatten(
        F.transform(_items(text, "id points"), lambda s: F.transform(point_positions(s["points"]), lambda i: _link("scribble_point", s["id"], i)))
    )


def _holes(text: Column) -> Column:
    def of_one(sp: Column) -> Column:
        rings = _or_empty(json_list(sp["e"]["holes"]), "array<string>")
        kept = F.filter(F.transform(rings, lambda r, i: F.when(F.size(point_positions(r)) >= 3, i)), lambda i: i.isNotNull())
        return F.transform(kept, lambda i: _link("sp_hole", F.concat(sp["m"], F.lit("#"), sp["e"]["id"]), i))

    return F.flatten(F.transform(_by_method(text, "id method holes"), of_one))


def _parent_scribbles(text: Column) -> Column:
    def of_one(an: Column) -> Column:
        raw = an["e"]["parent_scribble"]
        ids = F.when(_opens(raw, "["), json_list(raw)).otherwise(F.split(raw, r"[;,\s]+"))
        named = F.filter(_or_empty(ids, "array<string>"), lambda i: i.isNotNull() & (F.trim(i) != ""))
        return F.transform(named, lambda i: _link("anno_scribble", F.concat(an["m"], F.lit("#"), an["e"]["id"]), F.trim(i)))

    return F.flatten(F.transform(_by_method(text, "id method parent_scribble"), of_one))


def _opened(docs: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """``record_id, st``: the states with their three members as JSON texts."""
    states = docs.select(F.col(id_col).alias("record_id"), F.explode(open_states(F.col(json_col))).alias("s"))
    return states.select("record_id", F.from_json("s", ", ".join(f"{k} string" for k in _STATE_KEYS)).alias("st"))


def state_links(docs: DataFrame, id_col: str = "record_id", json_col: str = "doc_json") -> DataFrame:
    """``record_id, link_kind, parent_id, child_id`` of all nested records of the state texts.

    * null, blank, cut or multiple JSON texts have no children; a state within a
      string, an object or a list counts as if it stood alone (to three wraps);
    * null entries are no children, and what has no id can't be named as parent;
    * repeated and late copies of a record give each row once;
    * only the two named columns are read; an empty table gives no rows.
    """
    parts = zip((_scribble_points, _holes, _parent_scribbles), _STATE_KEYS)
    links = F.concat(*[F.coalesce(f(F.col(f"st.{k}")), F.array().cast(_LINKS)) for f, k in parts])
    return _opened(docs, id_col, json_col).select("record_id", F.inline(links)).where("parent_id IS NOT NULL AND child_id IS NOT NULL").distinct()


def run_methods(runs: DataFrame) -> DataFrame:
    """``methods`` of the finished runs as rows under their run, with position and figures.

    Absent and empty lists, null entries and blank names give no rows.
    """
    rows = F.transform(
        "methods",
        lambda m, i: F.struct(
            i.alias("position"), m["method"].alias("method"), m["n_ok"].alias("n_ok"), m["n_failed"].alias("n_failed"),
            m["miou_mean"].alias("miou_mean"), m["miou_variance"].alias("miou_variance"), m["miou_std"].alias("miou_std"),
        ),
    )
    return runs.select("record_id", "run_name", F.inline(rows)).where("trim(method) <> ''")


def nested_links(runs: DataFrame, docs: DataFrame) -> DataFrame:
    """All parent-child rows of both nested sources, without repeats."""
    named = run_methods(runs).where("run_name IS NOT NULL").select(
        "record_id", F.lit("run_method").alias("link_kind"), F.col("run_name").alias("parent_id"), F.col("method").alias("child_id")
    ).distinct()
    return named.unionByName(state_links(docs))


def scribble_table(docs: DataFrame) -> DataFrame:
    """The scribbles of the states as a flat table: record, position, id, code, radius, number of points."""
    rows = F.transform(
        _items(F.col("st.scribbles"), "id points params"),
        lambda e, i: F.struct(
            i.alias("position"), e["id"].alias("scribble_id"), F.get_json_object(e["params"], "$.code").cast("int").alias("code"),
            F.get_json_object(e["params"], "$.radius").cast("double").alias("radius"), F.size(point_positions(e["points"])).alias("n_points"),
        ),
    )
    return _opened(docs, "record_id", "doc_json").select("record_id", F.inline(rows)).distinct()
