"""Prompts, candidate scribbles and the settings of propagation, as column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The weights of a candidate scribble's parts.
SCORE = {"direct_gain": 4.0, "core_covered": 0.90, "component_covered": 0.55, "center_support": 0.60, "min_support": 0.30, "length": 0.35}
#: Share of the sensitivity, of the radius and of the properties, and what is added to the threshold of
#: embeddings: careful and bold (late, and otherwise), with embeddings and without.
PROFILES = {
    True: {"careful": (0.55, 0.65, 0.85, 0.01), "late": (0.75, 0.90, 0.95, 0.0), "early": (0.65, 0.75, 0.95, 0.0)},
    False: {"careful": (0.45, 0.55, 0.55, 0.0), "late": (0.70, 0.85, 0.80, 0.0), "early": (0.60, 0.75, 0.80, 0.0)},
}


def prompt_points(kind: Column, points: Column) -> Column:
    """The points of a line that a prompt of a kind shows: the middle one, both ends, or all (scribble, mark); null for a box.

    ``points``: array of structs. An empty line gives an empty list.
    """
    kind = F.lower(kind)
    n = F.size(points)
    middle = F.when(n > 0, F.array(F.element_at(points, F.floor(n / 2).cast("int") + 1))).otherwise(points)
    ends = F.when(n >= 2, F.array(F.get(points, F.lit(0)), F.element_at(points, -1))).otherwise(points)
    return F.when(kind == "point", middle).when(kind == "line", ends).when(kind.isin("scribble", "mark"), points)


def prompt_box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """The box of a component's pixels, as shares of the image; null without pixels."""
    return F.when(x0.isNotNull(), F.struct((x0 / width).alias("x0"), (y0 / height).alias("y0"), (x1 / width).alias("x1"), (y1 / height).alias("y1")))


def scribble_score(df: DataFrame) -> DataFrame:
    """Adds ``direct_gain`` and ``score`` of candidate scribbles.

    Reads ``direct`` (pixels put right), ``union`` (of the class), ``core_covered``,
    ``component_covered``, ``center_support``, ``min_support`` (shares) and
    ``length`` (share of the longer side).
    """
    gain = F.col("direct") / F.greatest(F.lit(1), F.col("union"))
    out = df.withColumn("direct_gain", gain)
    parts = [F.lit(w) * F.col(name) for name, w in SCORE.items()]
    return out.withColumn("score", sum(parts[1:], parts[0]))


def arm_balance(points: Column, center: Column) -> Column:
    """How even the two arms of a line around one of its points are: the shorter over the longer, 0 for a line without length."""
    leg = F.zip_with(
        F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))),
        lambda a, b: F.sqrt((a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2),
    )
    length = lambda part: F.aggregate(part, F.lit(0.0), lambda s, v: s + v)
    a, b = length(F.filter(leg, lambda _, i: i < center)), length(F.filter(leg, lambda _, i: i >= center))
    return F.when(F.greatest(a, b) > 1e-6, F.least(a, b) / F.greatest(a, b)).otherwise(0.0)


def propagation_profiles(sensitivity: Column, iou: Column, class_scribbles: Column, all_scribbles: Column, classes: Column, embeddings: bool, threshold: float = 0.99) -> Column:
    """The settings with which a class is propagated, careful first: array of ``sens, radius_scale, property_scale, embedding_threshold``.

    None without sensitivity. The bold ones are added once the class is known
    well: late (6 scribbles, or one a class, at least) with 3 scribbles or an IoU
    of 0.45, or at any time with 4 scribbles and an IoU of 0.60.
    """
    late = all_scribbles >= F.greatest(F.lit(6), classes)
    bold = (late & ((class_scribbles >= 3) | (iou >= 0.45))) | ((class_scribbles >= 4) & (iou >= 0.60))

    def one(name: str) -> Column:
        share, radius, prop, more = PROFILES[embeddings][name]
        return F.struct(
            F.greatest(F.lit(1e-6), sensitivity * share).alias("sens"), F.lit(radius).alias("radius_scale"), F.lit(prop).alias("property_scale"),
            F.lit(min(1.0, max(0.0, min(1.0, max(0.0, threshold)) + more))).alias("embedding_threshold"),
        )

    careful = F.array(one("careful"))
    return F.when(sensitivity > 0, F.when(bold, F.concat(careful, F.array(F.when(late, one("late")).otherwise(one("early"))))).otherwise(careful)).otherwise(F.slice(careful, 1, 0))


def segments_cross(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether the segments a-b and c-d (structs x, y) touch."""
    side = lambda p, q, r: F.signum((q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"]))
    within = lambda p, q, r: (r["x"] >= F.least(p["x"], q["x"])) & (r["x"] <= F.greatest(p["x"], q["x"])) & (r["y"] >= F.least(p["y"], q["y"])) & (r["y"] <= F.greatest(p["y"], q["y"]))
    s = side(a, b, c), side(a, b, d), side(c, d, a), side(c, d, b)
    flat = ((s[0] == 0) & within(a, b, c)) | ((s[1] == 0) & within(a, b, d)) | ((s[2] == 0) & within(c, d, a)) | ((s[3] == 0) & within(c, d, b))
    return ((s[0] != s[1]) & (s[2] != s[3])) | flat


def crossings(new: DataFrame, old: DataFrame) -> DataFrame:
    """``new_id, old_id`` of the lines ``image, id, colour, points`` that touch though their colours differ: what makes a new line invalid.

    Legs are compared within an image and a cell of a grid, so only what lies near each other meets.
    """
    def legs(df: DataFrame, tag: str) -> DataFrame:
        pairs = F.zip_with(F.slice("points", 1, F.greatest(F.size("points") - 1, F.lit(0))), F.slice("points", 2, F.greatest(F.size("points") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        rows = df.select("image", F.col("id").alias(f"{tag}_id"), F.col("colour").alias(f"{tag}_colour"), F.inline(pairs))
        span = lambda k: F.sequence(F.floor(F.least(F.col(f"a.{k}"), F.col(f"b.{k}")) * 16), F.floor(F.greatest(F.col(f"a.{k}"), F.col(f"b.{k}")) * 16))
        rows = rows.withColumn("cx", F.explode(span("x"))).withColumn("cy", F.explode(span("y")))
        return rows.withColumnsRenamed({"a": f"{tag}_a", "b": f"{tag}_b"})

    met = legs(new, "new").join(legs(old, "old"), ["image", "cx", "cy"]).where("NOT (new_colour <=> old_colour)")
    c = F.col
    return met.where(segments_cross(c("new_a"), c("new_b"), c("old_a"), c("old_b"))).select("new_id", "old_id").distinct()


def metrics_footer(miou: Column, coverage: Column, precision: Column, annotated: Column, none: Column) -> Column:
    """A step's metrics as one line of text; metrics that are null are left out, and ``none`` says that there are none at all."""
    part = lambda name, c: F.when(c.isNotNull(), F.format_string(f"{name} %.3f", c.cast("double")))
    px = F.when(annotated.isNotNull(), F.concat(F.lit("annotated_px "), F.rint(annotated).cast("bigint").cast("string")))
    line = F.concat_ws(" | ", part("mIoU", miou), part("coverage", coverage), part("precision", precision), px, F.lit("New annotations pulse in their class color"))
    return F.when(none, "New annotations briefly intensify in their class color").otherwise(line)
