"""Column functions on names, lists, colours, sizes, keys and prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


PIXELS_PER_SEGMENT = 3920  # fixed value: the area for which an image gets one segment


def sanitize_token(c: Column) -> Column:
    """A value as part of a file name: letters, digits, - and _ stay, points become p, all else becomes _; none at the ends, x if nothing is left."""
    safe = F.regexp_replace(F.replace(c.cast("string"), F.lit("."), F.lit("p")), r"[^\p{L}\p{N}_-]", "_")
    return F.coalesce(F.nullif(F.regexp_replace(safe, "^_+|_+$", ""), F.lit("")), F.when(c.isNotNull(), F.lit("x")))


def csv_list(c: Column) -> Column:
    """The trimmed parts of a comma-separated text, empty ones left out."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def csv_ints(c: Column) -> Column:
    """The distinct integers of a comma-separated text, in order."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(csv_list(c), lambda x: x.try_cast("int")), lambda x: x.isNotNull())))


def hex_to_rgb(c: Column) -> Column:
    """#RRGGBB as three numbers from 0 to 1."""
    part = lambda i: F.conv(F.substring(F.ltrim(F.translate(c, "#", "")), i, 2), 16, 10).cast("int") / 255.0
    return F.array(part(1), part(3), part(5))


def human_size(c: Column) -> Column:
    """Bytes as text in steps of 1024, TB at most."""
    out = F.format_string("%.1f TB", c / float(1024**4))
    for name, power in (("GB", 3), ("MB", 2), ("KB", 1), ("B", 0)):
        out = F.when(c < 1024 ** (power + 1), F.format_string(f"%.1f {name}", c / float(1024**power))).otherwise(out)
    return out


def method_key(name: Column) -> Column:
    """A method's canonical key taken apart: ``family, args, weights``."""
    head = F.element_at(F.split(name, r"\|"), 1)
    parts = F.split(head, "_")
    return F.struct(
        F.lower(parts[0]).alias("family"), F.transform(F.slice(parts, 2, F.size(parts)), lambda x: x.try_cast("double")).alias("args"),
        F.nullif(F.substring_index(F.regexp_replace(name, r"^[^|]*\|?", ""), "/", -1), F.lit("")).alias("weights"),
    )


def threshold_grid(start: float, stop: float, step: float) -> Column:
    """The thresholds from start to stop, both included, as an array."""
    n = round((stop - start) / step)
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.round(F.lit(start) + i * step, 6))


def polyline_length(points: Column, width: float = 1.0, height: float = 1.0) -> Column:
    """The length of a line through points (structs x, y), scaled to pixels."""
    legs = F.zip_with(
        F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))),
        lambda a, b: F.sqrt(((a["x"] - b["x"]) * width) ** 2 + ((a["y"] - b["y"]) * height) ** 2),
    )
    return F.aggregate(legs, F.lit(0.0), lambda s, x: s + x)


def tile_starts(length: Column, size: int, stride: int) -> Column:
    """Starts of tiles that cover a length: steps of the stride and one flush with the end."""
    last = F.greatest(length - size, F.lit(0))
    return F.array_union(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"), F.lit(stride).cast("bigint")), F.array(last.cast("bigint")))


def segment_hint(height: Column, width: Column) -> Column:
    """The number of segments for an image: one for ``PIXELS_PER_SEGMENT``, two at least, none for an empty image."""
    return F.when((height > 0) & (width > 0), F.greatest(F.lit(2).cast("bigint"), F.floor(height * width / PIXELS_PER_SEGMENT))).otherwise(F.lit(0).cast("bigint"))


def canonical_json(params: Column) -> Column:
    """A map as JSON with its keys in order; null for null."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(params))))


def label_parts(params: Column) -> Column:
    """The names and values that a case's label shows, in the order of the names (array of structs name, value).

    Of weights only the file name; a ``method_config`` that is a JSON object is
    opened, and its members are named ``cfg_..``.
    """
    shown = lambda v: F.when(v == "true", "True").when(v == "false", "False").otherwise(F.coalesce(v, F.lit("None")))
    pair = lambda name, value: F.struct(name.alias("name"), value.alias("value"))

    def opened(e: Column) -> Column:
        members = F.when(e["value"].rlike(r"^\s*\{"), F.from_json(e["value"], "map<string,string>"))
        inside = F.transform(F.array_sort(F.map_entries(members)), lambda m: pair(F.concat(F.lit("cfg_"), m["key"]), shown(m["value"])))
        weights = e["key"].isin("weights", "ssn_weights") & e["value"].isNotNull()
        plain = F.array(pair(e["key"], F.when(weights, F.regexp_extract(e["value"], "([^/]*)/*$", 1)).otherwise(F.coalesce(e["value"], F.lit("None")))))
        return F.when((e["key"] == "method_config") & members.isNotNull(), inside).otherwise(plain)

    return F.flatten(F.transform(F.array_sort(F.map_entries(params)), opened))


def case_label(method: Column, params: Column) -> Column:
    """A case's label: the method and what ``label_parts`` shows, each as name and value."""
    parts = F.transform(label_parts(params), lambda e: F.concat_ws("_", e["name"], sanitize_token(e["value"])))
    return F.concat_ws("__", F.concat(F.array(method), parts))


def study_label(method: Column, params: Column) -> Column:
    """A trial's label: the method and all parameters as they are, in the order of their names."""
    parts = F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat_ws("_", e["key"], sanitize_token(F.coalesce(e["value"], F.lit("None")))))
    return F.concat_ws("__", F.concat(F.array(method), parts))


def neural_case_params(config: Column) -> Column:
    """A method's config (a JSON object) as the parameters of its case: ``method_config`` without weights, in the order of its keys, and ``weights``.

    The weights are those of ``weights``, else of ``weight_path``; blank ones are
    left out, as is a config with nothing else in it. Null for what is no object.
    """
    members = F.when(config.rlike(r"^\s*\{"), F.from_json(config, "map<string,variant>"))
    text = F.from_json(config, "map<string,string>")
    # A null under one name gives way to the other name, which is taken out of the config only then.
    first = F.element_at(text, "weights")
    gone = F.when(first.isNull(), F.array(F.lit("weights"), F.lit("weight_path"))).otherwise(F.array(F.lit("weights")))
    rest = F.array_sort(F.transform(F.filter(F.map_entries(members), lambda e: ~F.array_contains(gone, e["key"])), lambda e: F.struct(e["key"].alias("k"), F.to_json(e["value"]).alias("v"))))
    body = F.concat(F.lit("{"), F.array_join(F.transform(rest, lambda e: F.concat(F.lit('"'), e["k"], F.lit('":'), e["v"])), ","), F.lit("}"))
    weights = F.coalesce(first, F.element_at(text, "weight_path"))
    made = F.array(
        F.when(F.size(rest) > 0, F.struct(F.lit("method_config").alias("key"), body.alias("value"))),
        F.when(F.trim(weights) != "", F.struct(F.lit("weights").alias("key"), weights.alias("value"))),
    )
    return F.when(members.isNotNull(), F.map_from_entries(F.array_compact(made)))


def rotated(step: Column, modes: list[str]) -> Column:
    """The mode of a step in a cycle of modes."""
    return F.element_at(F.array(*[F.lit(m) for m in modes]), (step % len(modes) + 1).cast("int"))


def fixed(value: Column, digits: int = 6) -> Column:
    """A number with fixed digits; NaN for null and NaN."""
    return F.when(value.isNull() | F.isnan(value), "NaN").otherwise(F.format_string(f"%.{digits}f", value))
