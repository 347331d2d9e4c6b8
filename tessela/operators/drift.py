"""Schemas that drift between files: one table, and a report of every change.

The lines are opened with ``from_json``/variant functions and summarised to one
schema per file; then only the files in which fields both went and came are opened
again, for the contents of those fields. Only such summaries are shuffled. The script of a pair of files is the cheapest
under tree edit distance (see ``schematree``), where a rename needs contents
that agree; the same over paths of nested fields gives moves. Lineages of fields over
renames and moves are trees of name segments, followed
with the hierarchy operator; types are compared along them in a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessela.functions.schematree import script
from tessela.operators.hierarchy import build_hierarchy
from tessela.operators.nested import complete_json
from tessela.storage import discard, materialise

#: The JSON types, and the heads of variant types that stand for them; any other head is a number's.
_TYPES = ("array", "boolean", "number", "object", "string")
_HEADS = {"ARRAY": "array", "BOOLEAN": "boolean", "OBJECT": "object", "STRING": "string"}


def _kind(tree: Column) -> Column:
    """The place in ``_TYPES`` of the JSON type at the head of a variant's schema; null for null."""
    places = F.create_map(*[F.lit(x) for head, name in _HEADS.items() for x in (head, _TYPES.index(name))])
    return F.when(tree != "VOID", F.coalesce(F.element_at(places, F.substring_index(tree, "<", 1)), F.lit(_TYPES.index("number"))))


def plain_content(js: Column) -> Column:
    """A value's scalars in order, free of how they are written.

    Names of members, brackets, quotes and kinds of separators vanish, true and
    false are 1 and 0, numbers lose idle zeros: ``8``, ``"8"``, ``8.0`` and
    ``{"value":8}`` are equal, as are ``[16,15]`` and ``"16;15"``.
    """
    bare = F.regexp_replace(js, r'\\?"(?:[^"\\]|\\[^"])*+\\?"\s*:', "")
    bare = F.regexp_replace(bare, r"(?i)\btrue\b", "1")
    bare = F.regexp_replace(bare, r"(?i)\bfalse\b", "0")
    bare = F.regexp_replace(bare, r"(?i)\bnull\b", "")
    bare = F.regexp_replace(bare, r"(?<=\d)\.0+(?!\d)", "")
    bare = F.regexp_replace(bare, r"(\.\d*?[1-9])0+(?!\d)", "$1")
    return F.trim(F.regexp_replace(bare, r'[\s\[\]{}",;\\]+', " "))


DEPTH = 4  # levels of objects that are opened where nested fields are compared; what lies deeper is part of its object's content


def _members(text: Column, depth: int = 1) -> Column:
    """The members of a complete JSON object as (key, value) entries, values as variants; null for anything else.

    With a ``depth``, members of objects come in their place, under the names on their way joined by points.
    """
    out = F.map_entries(F.from_json(F.when(F.ltrim(text).startswith("{"), complete_json(text)), "map<string,variant>"))

    def opened(e: Column) -> Column:
        inside = F.map_entries(F.try_variant_get(e["value"], "$", "map<string,variant>"))
        return F.when(F.size(inside) > 0, F.transform(inside, lambda m: F.struct(F.concat(e["key"], F.lit("."), m["key"]).alias("key"), m["value"].alias("value")))).otherwise(F.array(e))

    for _ in range(depth - 1):
        out = F.flatten(F.transform(out, opened))
    return out


def _keyed(lines: DataFrame, group: str, file_no: str, *more: Column) -> DataFrame:
    """``g, f`` and ``more`` of the lines in numbered files; ``g`` is the group as JSON, which is never null."""
    g = F.to_json(F.struct(F.col(group).alias("v")))
    return lines.where(F.col(file_no).isNotNull()).select(g.alias("g"), F.col(file_no).alias("f"), *more)


def _group(lines: DataFrame, group: str) -> Column:
    """The group again from ``g``."""
    return F.from_json("g", f"v {lines.schema[group].dataType.simpleString()}")["v"].alias(group)


def _schemas(lines: DataFrame, group: str, file_no: str, text: str, depth: int) -> DataFrame:
    """``g, f, name, kind``: one row per file and field, with the greatest of its types (places in ``_TYPES``) that isn't null.

    Readable is a complete JSON object; null, blank and broken lines are not.
    A record whose key is written twice has both values.
    """
    kinds = F.transform(_members(F.col(text), depth), lambda e: F.struct(e["key"].alias("name"), F.call_function("schema_of_variant", e["value"]).alias("tree")))
    each = _keyed(lines, group, file_no, F.inline(kinds))
    return each.groupBy("g", "f", "name").agg(F.max(_kind(F.col("tree"))).alias("kind"))


def _contents(lines: DataFrame, wanted: DataFrame, group: str, file_no: str, text: str, depth: int) -> DataFrame:
    """``g, pair, side, id, name, content, tree`` of the wanted fields: of one annotation the greatest content, values that are null left out.

    ``wanted``: ``g, f, pair, side, names``; only the lines of its files are
    opened, and only the values of its names are made comparable.
    """
    w = wanted.select(F.col("g").alias("wg"), F.col("f").alias("wf"), "pair", "side", "names")
    at = _keyed(lines, group, file_no, F.col(text).alias("t"))
    hit = at.join(w, (at["g"] == w["wg"]) & (at["f"] == w["wf"])).select("g", "pair", "side", "names", _members(F.col("t"), depth).alias("m"))
    written = lambda e: plain_content(F.to_json(e["value"]))
    kept = F.filter("m", lambda e: F.array_contains("names", e["key"]))
    rows = hit.select(
        "g", "pair", "side", F.get(F.transform(F.filter("m", lambda e: e["key"] == "id"), written), F.lit(0)).alias("id"),
        F.inline(F.transform(kept, lambda e: F.struct(e["key"].alias("name"), written(e).alias("content"), F.call_function("schema_of_variant", e["value"]).alias("tree")))),
    ).where("tree <> 'VOID'")
    return rows.groupBy("g", "pair", "side", "id", "name").agg(F.max(F.struct("content", "tree")).alias("v")).select("g", "pair", "side", "id", "name", "v.*")


def _scripts(pairs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for block in pairs:
        out = []
        for row in block.itertuples(index=False):
            tree = dict(row.trees or {})
            gone, new = ({name: tree.get(name, "VOID") for name in names} for names in (row.gone, row.new))
            same = {(x["old"], x["new"]) for x in (row.same if row.same is not None else ())}
            out += [(row.g, row.f, row.rank, *change) for change in script(gone, new, same)]
        yield pd.DataFrame(out, columns=["g", "f", "rank", "change_kind", "old_name", "new_name"])


def _file_pairs(schemas: DataFrame) -> DataFrame:
    """Each file with its rank and fields, and those of the group's nearest earlier file."""
    files = schemas.groupBy("g", "f").agg(F.sort_array(F.collect_list("name")).alias("now"))
    w = Window.partitionBy("g").orderBy("f")
    return files.select("g", "f", "now", F.row_number().over(w).alias("rank"), F.lag("f").over(w).alias("pf"), F.lag("now").over(w).alias("before"))


def analyse(lines: DataFrame, group: str = "writer", file_no: str = "file_no", text: str = "raw_line", depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """The changes, and the lineage of each field: what ``changes``, ``edits`` and ``unified`` share."""
    schemas = materialise(_schemas(lines, group, file_no, text, depth), "drift-schemas")
    pairs = materialise(_file_pairs(schemas).withColumns({"gone": F.array_except("before", "now"), "new": F.array_except("now", "before")}), "drift-pairs")
    both = pairs.where("size(gone) > 0 AND size(new) > 0")
    sides = [both.select("g", F.col(at).alias("f"), F.col("f").alias("pair"), F.lit(at).alias("side"), F.col(c).alias("names")) for at, c in (("pf", "gone"), ("f", "new"))]
    values = materialise(_contents(lines, sides[0].unionByName(sides[1]), group, file_no, text, depth), "drift-values")
    trees = values.groupBy("g", F.col("pair").alias("f"), "name").agg(F.max("tree").alias("tree")).groupBy("g", "f").agg(F.map_from_entries(F.collect_list(F.struct("name", "tree"))).alias("trees"))
    met = values.where("id <> ''").groupBy("g", "pair", "id").agg(*[
        F.collect_list(F.when(F.col("side") == at, F.struct("name", "content"))).alias(at) for at in ("pf", "f")
    ])
    agree = F.flatten(F.transform("pf", lambda a: F.transform(F.col("f"), lambda b: F.struct(a["name"].alias("old"), b["name"].alias("new"), (a["content"] == b["content"]).alias("same")))))
    same = (
        met.select("g", "pair", F.inline(agree)).groupBy("g", "pair", "old", "new").agg(F.min("same").alias("same"))
        .where("same").groupBy("g", F.col("pair").alias("f")).agg(F.collect_list(F.struct("old", "new")).alias("same"))
    )
    changed = pairs.where("pf IS NOT NULL AND (size(gone) > 0 OR size(new) > 0)").select("g", "f", "rank", "gone", "new")
    moves = materialise(
        changed.join(same, ["g", "f"], "left").join(trees, ["g", "f"], "left").mapInPandas(_scripts, f"g string, f {dict(lines.dtypes)[file_no]}, rank int, change_kind string, old_name string, new_name string"),
        "drift-moves",
    )

    ranks = pairs.select("g", "f", "rank")
    at = schemas.join(ranks, ["g", "f"])
    by_name = Window.partitionBy("g", "name").orderBy("rank")
    # A segment is an unbroken run of files that have a field under one name.
    fresh = F.coalesce((F.col("rank") != F.lag("rank").over(by_name) + 1).cast("int"), F.lit(1))
    seg = at.withColumn("fresh", fresh).withColumn("seg", F.sum("fresh").over(by_name.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    seg = materialise(seg, "drift-segments")
    discard(schemas, pairs, values)  # what follows reads only segments and moves
    key = lambda name, n: F.concat(F.col(n).cast("string"), F.lit("|"), F.col(name))
    begun = seg.where("fresh = 1").select("g", "name", "seg", "rank", key("name", "seg").alias("id"))
    ended = seg.select("g", F.col("name").alias("old_name"), (F.col("rank") + 1).alias("rank"), key("name", "seg").alias("from_id"))
    renames = moves.where("change_kind = 'renamed'").select("g", "rank", "old_name", F.col("new_name").alias("name"))
    links = begun.join(renames.join(ended, ["g", "rank", "old_name"]).select("g", "rank", "name", "from_id"), ["g", "rank", "name"], "left").select(
        "g", "id", F.array("from_id").alias("parents"), F.lit(0).alias("o")
    )
    lineage = build_hierarchy(links, keys=("g",), id_col="id", parents_col="parents", order_col="o", with_path=False).select("g", "id", "root_id")
    line = seg.withColumn("id", key("name", "seg")).join(lineage, ["g", "id"])
    w = Window.partitionBy("g", "root_id").orderBy("rank")
    line = line.select(
        "g", "f", "rank", "name", "kind", "root_id",
        F.lag("name").over(w).alias("old_name"),
        F.last("kind", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("old_kind"),
    )
    line = materialise(line, "drift-lineage")
    retyped = line.where("kind <> old_kind").select("g", "f", F.lit("retyped").alias("change_kind"), "old_name", F.col("name").alias("new_name"))
    changes = moves.select("g", "f", "change_kind", "old_name", "new_name").unionByName(retyped)
    return changes.select(_group(lines, group), F.col("f").alias(file_no), "change_kind", "old_name", "new_name"), line


def changes(lines: DataFrame, group: str = "writer", file_no: str = "file_no", text: str = "raw_line") -> DataFrame:
    """Every change of a top-level field between a file and the writer's nearest earlier file.

    ``added``, ``removed``, ``renamed``, ``retyped`` as rows with old and new
    name. A file counts if it has a readable record. A rename needs equal plain
    contents for all annotations (``id``) that have a value under the old name
    in the one file and under the new name in the other, and at least one of
    those: a value that is null, or whose key is missing, on either side says
    nothing, while an empty list is a content. Among rivals the edit script of least cost decides. If a field has
    several types in one file, the greatest name of a type stands for it. Null
    groups are a group; lines without a file number have no place in the order
    and don't count.
    Repeated lines and files change nothing; an empty table gives no rows.
    """
    return analyse(lines, group, file_no, text)[0].distinct()


def edits(lines: DataFrame, group: str = "writer", file_no: str = "file_no", text: str = "raw_line", depth: int = DEPTH) -> DataFrame:
    """Every edit of the nested schema between a file and the writer's nearest earlier file: ``changes`` of paths, with moves.

    A path is the names of the objects around a field and its own, joined by
    points, ``depth`` levels at most. ``moved``: gone under one object and in
    another (or at the top) with the same content, as for ``renamed``, which is
    of one object. A field that is wrapped in an object moves into it.
    """
    around = lambda c: F.regexp_extract(c, r"^(.*)\.[^.]*$", 1)
    moved = (F.col("change_kind") == "renamed") & (around("old_name") != around("new_name"))
    return analyse(lines, group, file_no, text, depth)[0].withColumn("change_kind", F.when(moved, "moved").otherwise(F.col("change_kind"))).distinct()


#: The fields of an annotation record and the types of the common table.
COLUMNS = {
    "id": "bigint", "code": "int", "border": "string", "holes": "string", "parent_superpixel": "bigint",
    "parent_scribble": "array<int>", "parent_intersect": "boolean", "propagation_score": "double",
}


#: Other names that writers give these columns, for lineages in which no column's own name occurs.
ALIASES = {
    "propagation_score": ("propagationScore", "prop_score", "spread_score", "score"),
    "holes": ("holeRings", "inner_rings", "interiors"),
    "parent_intersect": ("parentIntersect", "intersects_parent", "is_direct"),
    "code": ("class_code", "cls"),
    "parent_scribble": ("parentScribbles", "scribble_ids"),
}


def _plans(line: DataFrame) -> DataFrame:
    """``g, f, plan``: for each file the map from its field names to the names of the common table.

    A lineage has one name: the first name of ``COLUMNS`` along it; else that of
    the first alias along it; else the column that more than half of all
    lineages with one of its names, over all writers, belong to; else the name
    it began with. Where that is also the key of another field of the file, or
    the name of an older lineage in it, the field keeps its own key, so two
    fields of a file never meet.
    """
    known = F.create_map(*[F.lit(x) for column, others in ALIASES.items() for other in others for x in (other, column)])
    first = lambda value: F.min_by(value, F.when(value.isNotNull(), F.col("rank")))
    lineages = line.groupBy("g", "root_id").agg(
        first(F.when(F.col("name").isin(*COLUMNS), F.col("name"))).alias("own"),
        first(F.element_at(known, F.col("name"))).alias("alias"),
        F.min_by("name", "rank").alias("first_name"), F.min("rank").alias("begun"), F.collect_set("name").alias("names"),
    )
    held = lineages.select("own", F.explode("names").alias("name")).groupBy("name", "own").agg(F.count("*").alias("n"))
    share = held.withColumn("all", F.sum("n").over(Window.partitionBy("name"))).where("own IS NOT NULL AND 2 * n > all")
    agreed = (
        lineages.where("own IS NULL AND alias IS NULL").select("g", "root_id", F.explode("names").alias("name"))
        .join(share.select("name", "own", "n"), "name").groupBy("g", "root_id").agg(F.max_by("own", F.struct("n", "own")).alias("agreed"))
    )
    called = lineages.join(agreed, ["g", "root_id"], "left").select("g", "root_id", "begun", F.coalesce("own", "alias", "agreed", "first_name").alias("called"))
    file = Window.partitionBy("g", "f")
    each = line.select("g", "f", "name", "root_id").join(called, ["g", "root_id"]).withColumn("keys", F.collect_set("name").over(file))
    each = each.withColumn("called", F.when(F.array_contains("keys", F.col("called")), F.col("name")).otherwise(F.col("called")))
    nth = F.row_number().over(Window.partitionBy("g", "f", "called").orderBy("begun", "name"))
    each = each.withColumn("called", F.when(nth == 1, F.col("called")).otherwise(F.col("name")))
    return each.groupBy("g", "f").agg(F.map_from_entries(F.collect_list(F.struct("name", "called"))).alias("plan"))


def _moved(line: DataFrame) -> DataFrame:
    """``g, f, moved``: for each file the map from columns to the paths of nested fields whose lineage they are."""
    known = F.create_map(*[F.lit(x) for column, others in ALIASES.items() for other in others for x in (other, column)])
    first = lambda value: F.min_by(value, F.when(value.isNotNull(), F.col("rank")))
    column = F.coalesce(first(F.when(F.col("name").isin(*COLUMNS), F.col("name"))), first(F.element_at(known, F.col("name"))))
    lineages = line.groupBy("g", "root_id").agg(column.alias("column")).where("column IS NOT NULL")
    paths = line.where("instr(name, '.') > 0").join(lineages, ["g", "root_id"]).groupBy("g", "f", "column").agg(F.min("name").alias("path"))
    return paths.groupBy("g", "f").agg(F.map_from_entries(F.collect_list(F.struct("column", "path"))).alias("moved"))


def unified(lines: DataFrame, group: str = "writer", file_no: str = "file_no", text: str = "raw_line") -> DataFrame:
    """All readable records as one table with one set of columns.

    Each file's edit scripts are compiled into a projection: the map from its
    field names to the names of their lineages (see ``_plans``). Columns of
    ``COLUMNS`` are cast to their types (nested lists as JSON text); every other
    field is kept in the map ``extras``, and so is, under the column's name, a
    value that its column can't hold as a whole, so no value is lost. A field
    that moved into an object is found there by its lineage over moves (see
    ``edits``), where its column would be empty; the object stays in ``extras``.
    Repeats of a line stay.
    """
    plan = _plans(analyse(lines, group, file_no, text)[1]).join(_moved(analyse(lines, group, file_no, text, DEPTH)[1]), ["g", "f"], "left")
    rows = _keyed(lines, group, file_no, F.col("line_no"), complete_json(F.col(text)).alias("t")).where("t IS NOT NULL AND ltrim(t) LIKE '{%'").join(plan, ["g", "f"])
    # Of a key that a record has twice the last value counts, as it does for JSON readers.
    entries = rows.withColumn("m", F.map_entries(F.from_json("t", "map<string,string>"))).withColumn("k", F.transform("m", lambda e: e["key"]))
    last = F.filter("m", lambda e, i: ~F.array_contains(F.slice("k", i + 2, F.size("k")), e["key"]))
    named = entries.select("g", "f", "line_no", "t", "moved", F.map_from_entries(F.transform(last, lambda e: F.struct(F.element_at("plan", e["key"]), e["value"]))).alias("v"))
    at = lambda path: F.call_function("get_json_object", F.col("t"), F.concat(F.lit("$['"), F.replace(path, F.lit("."), F.lit("']['")), F.lit("']")))
    found = F.map_filter(F.transform_values("moved", lambda _, path: at(path)), lambda c, value: value.isNotNull() & ~F.map_contains_key("v", c))
    named = named.withColumn("v", F.when(F.col("moved").isNull(), F.col("v")).otherwise(F.map_concat("v", found)))

    def inner(raw: Column, key: str) -> Column:
        """What an object holds under its only key, else the value itself."""
        return F.when(F.json_object_keys(raw) == F.array(F.lit(key)), F.get_json_object(raw, f"$.{key}")).otherwise(raw)

    def typed(name: str, kind: str) -> Column:
        """The value in the column's type; null if it can't hold all of it."""
        raw = F.element_at("v", name)
        if kind == "string":
            return F.coalesce(inner(raw, "rings"), raw)
        if kind == "array<int>":
            found = F.transform(F.regexp_extract_all(raw, F.lit(r"-?\d+"), F.lit(0)), lambda x: x.try_cast("int"))
            return F.when(raw.rlike(r'^[\s\["]*(-?\d+(["\s]*[,;\s]["\s]*-?\d+)*)?[\s\]"]*$') & ~F.exists(found, lambda x: x.isNull()), found)
        scalar = inner(raw, "value")
        if kind == "boolean":
            return F.when(F.lower(scalar).isin("true", "1"), True).when(F.lower(scalar).isin("false", "0"), False)
        if kind in ("int", "bigint"):
            scalar = F.regexp_replace(scalar, r"^(\s*-?\d+)\.0+\s*$", "$1")
        return scalar.try_cast(kind)

    cast = named.select("g", "f", "line_no", "v", *[typed(n, k).alias(n) for n, k in COLUMNS.items()])
    lost = F.array_compact(F.array(*[F.when(F.col(n).isNull() & F.element_at("v", n).isNotNull(), F.lit(n)) for n in COLUMNS]))
    return cast.withColumn("lost", lost).select(
        _group(lines, group), F.col("f").alias(file_no), "line_no", *COLUMNS,
        F.map_filter("v", lambda k, _: ~k.isin(*COLUMNS) | F.array_contains("lost", k)).alias("extras"),
    )
