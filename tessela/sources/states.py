"""State documents as typed rows, their constraints, and the way back to JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessela.operators.nested import complete_json, json_list, json_members, open_states, point_positions

MAGIC, VERSION = "spanno", 3  # fixed values of the format


def _of(c: Column, name: str) -> Column:
    return F.element_at(json_members(c), name)


def states(docs: DataFrame, id_col: str = "record_id", json_col: str = "doc_json") -> DataFrame:
    """``record_id, state, magic, version, width, height``; a state without ``_meta`` is of version 1."""
    rows = docs.select(F.col(id_col).alias("record_id"), F.explode(open_states(F.col(json_col))).alias("state"))
    meta = lambda p: F.get_json_object("state", f"$._meta.{p}")
    return rows.select(
        "record_id", "state", F.coalesce(meta("magic"), F.lit(MAGIC)).alias("magic"), F.coalesce(meta("version").try_cast("int"), F.lit(1)).alias("version"),
        meta("image.size_wh[0]").try_cast("int").alias("width"), meta("image.size_wh[1]").try_cast("int").alias("height"),
    )


def _listed(member: str) -> Column:
    text = _of(F.col("state"), member)
    mapped = F.flatten(F.transform(F.map_entries(json_members(text)), lambda kv: F.transform(F.coalesce(json_list(kv["value"]), F.array().cast("array<string>")), lambda e: F.struct(kv["key"].alias("m"), e.alias("e")))))
    plain = F.transform(json_list(text), lambda e: F.struct(_of(e, "method").alias("m"), e.alias("e")))
    return F.coalesce(F.when(F.ltrim(text).startswith("["), plain).otherwise(mapped), F.array().cast("array<struct<m:string,e:string>>"))


def superpixels(rows: DataFrame) -> DataFrame:
    """``record_id, method, id, n_border, n_holes, direct_parent``: holes of fewer than three points don't count."""
    e = F.col("e")
    return rows.select("record_id", F.inline(_listed("superpixels"))).select(
        "record_id", F.col("m").alias("method"), _of(e, "id").try_cast("int").alias("id"), F.size(point_positions(_of(e, "border"))).alias("n_border"),
        F.size(F.filter(F.coalesce(json_list(_of(e, "holes")), F.array().cast("array<string>")), lambda h: F.size(point_positions(h)) >= 3)).alias("n_holes"),
        F.element_at(F.nullif(json_list(_of(e, "parents")), F.array().cast("array<string>")), -1).try_cast("int").alias("direct_parent"),
    )


def annotations(rows: DataFrame) -> DataFrame:
    """``record_id, method, id, code, parent_superpixel, parent_intersect``; defaults -1 and true."""
    e = F.col("e")
    return rows.select("record_id", F.inline(_listed("annotations"))).select(
        "record_id", F.col("m").alias("method"), _of(e, "id").try_cast("int").alias("id"), _of(e, "code").try_cast("int").alias("code"),
        F.coalesce(_of(e, "parent_superpixel").try_cast("int"), F.lit(-1)).alias("parent_superpixel"), F.coalesce(F.lower(_of(e, "parent_intersect")).isin("true", "1"), F.lit(True)).alias("parent_intersect"),
    )


def violations(rows: DataFrame) -> DataFrame:
    """``record_id, rule, method, id`` of every breach of the format's constraints.

    Magic and version, ids unique within a method, borders of three points at
    least, annotations on a superpixel that exists, one annotation a superpixel.
    """
    sp, an = superpixels(rows), annotations(rows)
    found = lambda df, rule, m="method", i="id": df.select("record_id", F.lit(rule).alias("rule"), F.col(m).alias("method"), F.col(i).cast("int").alias("id"))
    head = rows.where((F.col("magic") != MAGIC) | (F.col("version") > VERSION)).select("record_id", F.lit("header").alias("rule"), F.lit(None).cast("string").alias("method"), F.lit(None).cast("int").alias("id"))
    keys = sp.select("record_id", "method", F.col("id").alias("parent_superpixel")).distinct()
    return (
        head.unionByName(found(sp.groupBy("record_id", "method", "id").count().where("count > 1"), "repeated superpixel"))
        .unionByName(found(sp.where("n_border < 3"), "short border"))
        .unionByName(found(an.join(keys, ["record_id", "method", "parent_superpixel"], "left_anti"), "no superpixel"))
        .unionByName(found(an.groupBy("record_id", "method", "parent_superpixel").count().where("count > 1"), "several annotations", i="parent_superpixel"))
    )


def latest(docs: DataFrame, id_col: str = "record_id", order: str = "received_at", json_col: str = "doc_json") -> DataFrame:
    """Of each record the text that arrived last; ties by the greater text."""
    return docs.groupBy(id_col).agg(F.max(F.struct(order, json_col)).alias("b")).select(id_col, f"b.{json_col}")


def _keys(state: Column, member: str) -> Column:
    return F.coalesce(F.json_object_keys(_of(state, member)), F.array().cast("array<string>"))


def migrated(state: Column) -> Column:
    """A state of the format before ``_meta`` as one of version 1, with its methods listed; states with ``_meta`` stay as they are."""
    methods = F.array_sort(_keys(state, "superpixels"))
    meta = F.to_json(F.struct(F.lit(MAGIC).alias("magic"), F.lit(1).alias("version"), methods.alias("methods"), F.create_map().cast("map<string,int>").alias("checks")))
    rest = F.regexp_replace(state, r"^\s*\{\s*", "")
    join = F.when(rest.startswith("}"), "").otherwise(",")
    return F.when(F.array_contains(F.json_object_keys(state), "_meta"), state).otherwise(F.concat(F.lit('{"_meta":'), meta, join, rest))


def chosen_method(state: Column, wanted: str | None = None) -> Column:
    """The method of a state that is shown: the one wanted, the first of its list that it holds, else the first by name; null if there is none."""
    held = F.array_sort(F.array_union(_keys(state, "superpixels"), _keys(state, "annotations")))
    if wanted is not None:
        return F.when(F.array_contains(held, wanted), F.lit(wanted))
    listed = F.coalesce(json_list(F.get_json_object(state, "$._meta.methods")), F.array().cast("array<string>"))
    return F.coalesce(F.get(F.filter(listed, lambda m: F.array_contains(held, m)), F.lit(0)), F.get(held, F.lit(0)))


def scribbles(rows: DataFrame) -> DataFrame:
    """``record_id, id, code, n_points`` of the scribbles of the states; the code is 1 where none is given."""
    items = F.filter(F.coalesce(json_list(_of(F.col("state"), "scribbles")), F.array().cast("array<string>")), lambda e: F.ltrim(e).startswith("{"))
    e = F.col("e")
    return rows.select("record_id", F.explode(items).alias("e")).select(
        "record_id", _of(e, "id").try_cast("int").alias("id"), F.coalesce(F.get_json_object(e, "$.params.code").try_cast("int"), F.lit(1)).alias("code"), F.size(point_positions(_of(e, "points"))).alias("n_points"),
    )


def parsed_config(text: Column) -> Column:
    """``config`` (the members of a JSON object as a map of JSON texts, empty for blank and null texts) and ``problem``."""
    blank = text.isNull() | (F.trim(text) == "")
    members = json_members(complete_json(text))
    problem = F.when(~blank & complete_json(text).isNull(), "no JSON").when(~blank & members.isNull(), "no object")
    return F.struct(F.when(blank, F.create_map().cast("map<string,string>")).otherwise(members).alias("config"), problem.alias("problem"))


def method_configs(text: Column) -> Column:
    """Configs by method as an array of ``method, config, problem``: an object of methods, each with an object or a list of objects."""
    def of(kv: Column) -> Column:
        method = F.lower(F.trim(kv["key"]))
        listed = F.when(F.ltrim(kv["value"]).startswith("{"), F.array(kv["value"])).otherwise(json_list(kv["value"]))
        one = lambda c: F.struct(method.alias("method"), F.when(F.ltrim(c).startswith("{"), c).alias("config"), F.when(~F.coalesce(F.ltrim(c).startswith("{"), F.lit(False)), "no object").alias("problem"))
        empty = F.array(F.struct(method.alias("method"), F.lit(None).cast("string").alias("config"), F.lit("empty").alias("problem")))
        return F.when(F.size(listed) > 0, F.transform(listed, one)).otherwise(empty)

    none = F.array().cast("array<struct<method:string,config:string,problem:string>>")
    return F.coalesce(F.flatten(F.transform(F.map_entries(parsed_config(text)["config"]), of)), none)


def json_summary(text: Column) -> Column:
    """The figures of a summary file: of a comparison of methods (``methods``) or of before and after; null for no object.

    ``method_count, best_method, best_miou, n_images, before_miou, after_miou, delta_miou``; the first of equal best methods by name.
    """
    at = lambda p: F.get_json_object(text, f"$.{p}").try_cast("double")
    number = lambda c: F.when(~F.isnan(c), c)
    methods = F.from_json(F.get_json_object(text, "$.methods"), "map<string,string>")
    scored = F.transform(F.map_entries(methods), lambda e: F.struct(number(F.get_json_object(e["value"], "$.miou").try_cast("double")).alias("s"), e["key"].alias("name")))
    top = F.array_max(F.transform(scored, lambda x: x["s"]))
    best = F.array_min(F.transform(F.filter(scored, lambda x: x["s"] == top), lambda x: x["name"]))
    return F.when(json_members(complete_json(text)).isNotNull(), F.struct(
        F.size(methods).alias("method_count"), best.alias("best_method"), top.alias("best_miou"), at("n_images").cast("int").alias("n_images"),
        number(at("before.miou")).alias("before_miou"), number(at("after.miou")).alias("after_miou"), number(at("delta.miou")).alias("delta_miou"),
    ))


def full_items(rows: DataFrame) -> DataFrame:
    """``record_id, part, method, position, item``: every scribble, superpixel and annotation of the states as its whole JSON text, in place."""
    def part(member: str, listed: Column) -> Column:
        return F.transform(listed, lambda x, i: F.struct(F.lit(member).alias("part"), x["m"].alias("method"), i.alias("position"), x["e"].alias("item")))

    alone = F.transform(F.coalesce(json_list(_of(F.col("state"), "scribbles")), F.array().cast("array<string>")), lambda e: F.struct(F.lit(None).cast("string").alias("m"), e.alias("e")))
    every = F.concat(part("scribbles", alone), part("superpixels", _listed("superpixels")), part("annotations", _listed("annotations")))
    return rows.select("record_id", F.inline(every))


def documents(items: DataFrame, heads: DataFrame) -> DataFrame:
    """``record_id, doc_json``: the states again from ``full_items`` and ``heads`` (``record_id, width, height``), nothing of the items lost.

    Items keep their text and order; the head has the format's marks, the
    image's size and the counts. One document is one row, as large as the image
    it describes.
    """
    one = items.groupBy("record_id", "part", "method").agg(F.array_sort(F.collect_list(F.struct("position", "item"))).alias("l"))
    body = F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["item"]), ","), F.lit("]"))
    named = one.select("record_id", "part", "method", body.alias("body"), F.size("l").alias("n"))
    keyed = F.array_sort(F.collect_list(F.when(F.col("method").isNotNull(), F.struct("part", "method", "body", "n"))))
    quoted = lambda s: F.regexp_extract(F.to_json(F.struct(s.alias("k"))), r'^\{"k":(.*)\}$', 1)
    doc = named.groupBy("record_id").agg(keyed.alias("all"), F.max(F.when(F.col("part") == "scribbles", F.struct("body", "n"))).alias("scribbles"))
    members = lambda p, f: F.concat(F.lit("{"), F.array_join(F.transform(F.filter("all", lambda x: x["part"] == p), lambda x: F.concat(quoted(x["method"]), F.lit(":"), f(x))), ","), F.lit("}"))
    counts = lambda p: members(p, lambda x: x["n"].cast("string"))
    size = F.when(F.col("width").isNotNull() & F.col("height").isNotNull(), F.concat(F.lit('"image":{"size_wh":['), F.col("width").cast("string"), F.lit(","), F.col("height").cast("string"), F.lit("]},"))).otherwise("")
    methods = F.to_json(F.array_sort(F.array_distinct(F.transform("all", lambda x: x["method"]))))
    text = F.concat(
        F.lit(f'{{"_meta":{{"magic":"{MAGIC}","version":{VERSION},'), size, F.lit('"methods":'), methods, F.lit(',"checks":{"n_scribbles":'), F.coalesce(F.col("scribbles.n"), F.lit(0)).cast("string"),
        F.lit(',"n_superpixels":'), counts("superpixels"), F.lit(',"n_annotations":'), counts("annotations"), F.lit('}},"scribbles":'), F.coalesce("scribbles.body", F.lit("[]")),
        F.lit(',"superpixels":'), members("superpixels", lambda x: x["body"]), F.lit(',"annotations":'), members("annotations", lambda x: x["body"]), F.lit("}"),
    )
    return heads.select("record_id", "width", "height").join(doc, "record_id", "left").withColumn("all", F.coalesce("all", F.array().cast(doc.schema["all"].dataType))).select("record_id", text.alias("doc_json"))


def to_documents(sp: DataFrame, an: DataFrame, by: str = "record_id") -> DataFrame:
    """From flat tables: one JSON document for each ``by``, with items by method in the order of their ids, and counts as checks.

    Holds the columns of the tables only; ``documents`` keeps items whole.

    One document is one row, as large as the image it describes.
    """
    def nest(df: DataFrame, name: str) -> DataFrame:
        cols = [c for c in df.columns if c not in (by, "method")]
        one = df.groupBy(by, "method").agg(F.sort_array(F.collect_list(F.struct("id", *[c for c in cols if c != "id"]))).alias("items"))
        return one.groupBy(by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("method", "items")))).alias(name), F.sum(F.size("items")).alias(f"n_{name}"))

    both = nest(sp, "superpixels").join(nest(an, "annotations"), by, "full")
    meta = F.struct(F.lit(MAGIC).alias("magic"), F.lit(VERSION).alias("version"), F.struct(F.coalesce("n_superpixels", F.lit(0)).alias("n_superpixels"), F.coalesce("n_annotations", F.lit(0)).alias("n_annotations")).alias("checks"))
    return both.select(by, F.to_json(F.struct(meta.alias("_meta"), "superpixels", "annotations")).alias("doc_json"))
