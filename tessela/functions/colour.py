"""Colours of pixels and palettes of classes."""

from __future__ import annotations

import colorsys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The white point and the two matrices of linear RGB and XYZ, and the bend of the lightness curve.
WHITE = (0.950456, 1.0, 1.088754)
TO_XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
TO_RGB = ((3.240479, -1.53715, -0.498535), (-0.969256, 1.875991, 0.041556), (0.055648, -0.204043, 1.057311))
BEND, SLOPE = 0.008856, 7.787


def _byte(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(255.0))


def rgb_to_lab(r: Column, g: Column, b: Column) -> Column:
    """Lightness 0 to 100 and the two colour axes, of RGB from 0 to 1; both sides in steps of 8 bits. Null in, null out."""
    linear = []
    for c in (r, g, b):
        v = F.floor(_byte(c * 255)) / 255
        linear.append(F.when(v > 0.04045, F.pow((v + 0.055) / 1.055, F.lit(2.4))).otherwise(v / 12.92))
    xyz = [sum((m * c for m, c in zip(row[1:], linear[1:])), row[0] * linear[0]) / w for row, w in zip(TO_XYZ, WHITE)]
    fx, fy, fz = (F.when(t > BEND, F.cbrt(t)).otherwise(SLOPE * t + 16 / 116) for t in xyz)
    lab = (F.when(xyz[1] > BEND, 116 * F.cbrt(xyz[1]) - 16).otherwise(903.3 * xyz[1]) * 2.55, 500 * (fx - fy) + 128, 200 * (fy - fz) + 128)
    whole = [F.rint(_byte(c)) for c in lab]
    return F.struct((whole[0] / 2.55).alias("l"), (whole[1] - 128).alias("a"), (whole[2] - 128).alias("b"))


def lab_to_rgb(l: Column, a: Column, b: Column) -> Column:
    """The way back: RGB from 0 to 1, both sides in steps of 8 bits."""
    l, a, b = F.floor(_byte(l * 2.55)) / 2.55, F.floor(_byte(a + 128)) - 128, F.floor(_byte(b + 128)) - 128
    low = l <= 8
    y = F.when(low, l / 903.3).otherwise(F.pow((l + 16) / 116, F.lit(3.0)))
    fy = F.when(low, SLOPE * y + 16 / 116).otherwise((l + 16) / 116)
    back = lambda f: F.when(f <= SLOPE * BEND + 16 / 116, (f - 16 / 116) / SLOPE).otherwise(F.pow(f, F.lit(3.0)))
    xyz = (back(fy + a / 500) * WHITE[0], y, back(fy - b / 200) * WHITE[2])
    out = []
    for row in TO_RGB:
        v = sum((m * c for m, c in zip(row[1:], xyz[1:])), row[0] * xyz[0])
        v = F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
        out.append(F.rint(255 * F.when(v <= 0.0031308, 12.92 * v).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)) / 255)
    return F.struct(*[c.alias(n) for c, n in zip(out, "rgb")])


#: The colours of the first classes; later ones take hues in steps of the golden ratio.
PALETTE = (
    (0, 0, 0), (255, 165, 0), (154, 205, 50), (255, 69, 0), (0, 191, 255), (169, 169, 169), (47, 79, 79), (255, 255, 0), (238, 130, 238), (85, 107, 47),
    (160, 82, 45), (72, 61, 139), (0, 128, 0), (0, 0, 139), (139, 0, 139),
)


def palette(n: int) -> list[tuple[int, int, int]]:
    """Colours for n classes, one at least."""
    out = list(PALETTE[: max(1, n)])
    for i in range(max(0, n - len(PALETTE))):
        hue = int(i * 0.6180339887498949 % 1.0 * 179) * 2 / 360
        out.append(tuple(round(255 * v) for v in colorsys.hsv_to_rgb(hue, 200 / 255, 1.0)))
    return out


def class_infos(codes: list[int]) -> list[dict]:
    """``index, code, name, rgb`` of classes given by their codes in the order of a model's outputs."""
    return [{"index": i, "code": c, "name": f"class_{c}", "rgb": list(rgb)} for i, (c, rgb) in enumerate(zip(codes, palette(len(codes))))]


def remap(codes: Column, infos: list[dict]) -> Column:
    """A mask's code as the index of its class, -1 for codes of no class and null."""
    known = F.create_map(*[F.lit(x) for i in infos for x in (i["code"], i["index"])])
    return F.coalesce(F.element_at(known, codes.cast("int")), F.lit(-1))


def unknown_codes(pixels: DataFrame, code: str, infos: list[dict]) -> DataFrame:
    """``code, n``: the codes of a mask that no class has."""
    return pixels.where(F.col(code).isNotNull() & ~F.col(code).isin([i["code"] for i in infos])).groupBy(F.col(code).alias("code")).agg(F.count(F.lit(1)).alias("n"))


def decode(index: Column, infos: list[dict]) -> Column:
    """An index as the code of its class; null for others."""
    return F.element_at(F.create_map(*[F.lit(x) for i in infos for x in (i["index"], i["code"])]), index.cast("int"))


def colorize(index: Column, infos: list[dict]) -> Column:
    """An index as the colour of its class (array of three bytes); null for others."""
    return F.element_at(F.create_map(*[x for i in infos for x in (F.lit(i["index"]), F.array(*[F.lit(v) for v in i["rgb"]]))]), index.cast("int"))


def blend(pixel: Column, colour: Column, alpha: float = 0.6) -> Column:
    """A colour laid over a pixel's (arrays of bytes), cut to whole bytes."""
    return F.zip_with(pixel, colour, lambda p, c: F.floor(F.least(F.greatest((1 - alpha) * p + alpha * c, F.lit(0.0)), F.lit(255.0))).cast("int"))


def class_colours(pixels: DataFrame, code: str = "code", rgb: str = "rgb") -> DataFrame:
    """``code, rgb``: the most frequent colour of each class in a coloured mask, the least on a tie."""
    n = pixels.groupBy(F.col(code).alias("code"), F.col(rgb).alias("rgb")).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("code").agg(F.min(F.struct(-F.col("n"), F.col("rgb"))).alias("b")).select("code", "b.rgb")


def present_classes(series: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """The rows of classes to be shown, of ``class, step, value``: those that a mask (``class``) holds, else those with any finite value."""
    real = series.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))).select("class").distinct()
    if present is None:
        return series.join(real, "class", "left_semi")
    held = series.join(present.select("class").distinct(), "class", "left_semi")
    any_held = held.agg((F.count(F.lit(1)) > 0).alias("any"))
    kept = series.join(present.select("class").distinct().withColumn("in_mask", F.lit(True)), "class", "left").join(real.withColumn("is_real", F.lit(True)), "class", "left")
    shown = F.when(F.col("any"), F.coalesce("in_mask", F.lit(False))).otherwise(F.coalesce("is_real", F.lit(False)))
    return kept.join(F.broadcast(any_held)).where(shown).select(*series.columns)  # one row


def merged_classes(sets: DataFrame, order: list[str]) -> DataFrame:
    """``code, name, rgb`` of several named class sets (``set, code, ..``) in one: of a code in more than one the row of the later set counts."""
    place = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("set"))
    names = [c for c in sets.columns if c not in ("set", "code")]
    best = sets.where(F.col("set").isin(*order)).groupBy("code").agg(F.max_by(F.struct(*names), F.struct(place, *names)).alias("b"))
    return best.select("code", "b.*")
