"""Soft assignment of pixels to the segments of a grid, its iterations and its losses.

A pixel looks at the segment of its grid cell and the eight around it. Pixels,
candidates and segments are relations: distances are an equality join on the
segment's number, updates are partial sums, and an image may hold any share of
the pixels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessela.storage import discard, materialise

EPS = 1e-6  # fixed value: what keeps means of empty segments finite
PLACE, COLOUR = 2.5, 0.75  # fixed values: the weights of place and colour in local logits


def grid_shape(width: Column, height: Column, count: int) -> tuple[Column, Column]:
    """Columns and rows of a grid of about ``count`` cells of the image's proportions; one each at least."""
    at_least_one = lambda c: F.greatest(F.lit(1), F.floor(F.sqrt(c)).cast("int"))
    return at_least_one(count * width / height), at_least_one(count * height / width)


def cells(pixels: DataFrame, count: int) -> DataFrame:
    """Adds ``nx, ny, cx, cy, cell``: the grid of a pixel's image, and its cell there."""
    dims = pixels.groupBy("image").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    nx, ny = grid_shape(F.col("w"), F.col("h"), count)
    out = pixels.join(dims.select("image", "w", "h", nx.alias("nx"), ny.alias("ny")), "image")
    out = out.withColumns({"cx": F.floor(F.col("x") * F.col("nx") / F.col("w")).cast("int"), "cy": F.floor(F.col("y") * F.col("ny") / F.col("h")).cast("int")})
    return out.withColumn("cell", F.col("cy") * F.col("nx") + F.col("cx")).drop("w", "h")


def centroids(pixels: DataFrame, features: list[str], segment: str = "cell", weight: Column | None = None) -> DataFrame:
    """``image, seg, n, f..``: the weighted means of the features of each segment."""
    w = F.lit(1.0) if weight is None else weight
    sums = pixels.groupBy("image", F.col(segment).alias("seg")).agg(F.sum(w).alias("n"), *[F.sum(F.col(f) * w).alias(f) for f in features])
    return sums.select("image", "seg", "n", *[(F.col(f) / (F.col("n") + EPS)).alias(f) for f in features])


def candidates(pixels: DataFrame) -> DataFrame:
    """Each pixel of ``cells`` nine times: ``k`` from 0 to 8, row by row, and ``seg``; places outside of the grid are left out."""
    out = pixels.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(8))))
    x, y = F.col("cx") + F.col("k") % 3 - 1, F.col("cy") + F.floor(F.col("k") / 3).cast("int") - 1
    inside = (x >= 0) & (x < F.col("nx")) & (y >= 0) & (y < F.col("ny"))
    return out.where(inside).withColumn("seg", (y * F.col("nx") + x).cast("int"))


def distances(near: DataFrame, means: DataFrame, features: list[str]) -> DataFrame:
    """``near`` with ``d``: the squared distance of a pixel's features to those of each candidate that exists."""
    m = means.select("image", "seg", *[F.col(f).alias(f"mean_{f}") for f in features])
    parts = [(F.col(f) - F.col(f"mean_{f}")) ** 2 for f in features]
    return near.join(m, ["image", "seg"]).withColumn("d", sum(parts[1:], parts[0])).drop(*[f"mean_{f}" for f in features])


def affinity(dist: DataFrame) -> DataFrame:
    """Adds ``a``: the softmax of -d over a pixel's candidates; adds up to one."""
    w = Window.partitionBy("image", "x", "y")
    raised = F.exp(F.min("d").over(w) - F.col("d"))
    return dist.withColumn("e", raised).withColumn("a", F.col("e") / F.sum("e").over(w)).drop("e")


def assign(pixels: DataFrame, features: list[str], count: int, rounds: int = 5) -> DataFrame:
    """``image, x, y, k, seg, d, a`` and the features after ``rounds`` of distances and means, from the grid's means on.

    Every round's means are a written table, so that a round never repeats the
    ones before. An empty table gives no rows.
    """
    near = candidates(cells(pixels.select("image", "x", "y", *features), count))
    means = centroids(cells(pixels, count), features)
    for i in range(rounds):
        soft = affinity(distances(near, means, features))
        if i + 1 < rounds:
            before, means = means, materialise(centroids(soft, features, "seg", F.col("a")), "means")
            if i:
                discard(before)
    return soft.select("image", "x", "y", "k", "seg", "d", "a", *features)


def hard_labels(soft: DataFrame) -> DataFrame:
    """``image, x, y, seg``: the candidate of the greatest affinity, the first in their order on a tie."""
    return soft.groupBy("image", "x", "y").agg(F.max_by("seg", F.struct("a", -F.col("k"))).alias("seg"))


def reconstruct(soft: DataFrame, values: list[str]) -> DataFrame:
    """``image, x, y, r_..``: each pixel's values again, as its segments' means weighted by affinity."""
    means = centroids(soft, values, "seg", F.col("a")).select("image", "seg", *[F.col(v).alias(f"m_{v}") for v in values])
    return soft.join(means, ["image", "seg"]).groupBy("image", "x", "y").agg(
        *[F.sum(F.col("a") * F.col(f"m_{v}")).alias(f"r_{v}") for v in values], *[F.first(v).alias(v) for v in values]
    )


def reconstruction_mse(soft: DataFrame, values: list[str]) -> DataFrame:
    """``image, mse``: over all values and pixels."""
    parts = [(F.col(f"r_{v}") - F.col(v)) ** 2 for v in values]
    return reconstruct(soft, values).groupBy("image").agg(F.avg(sum(parts[1:], parts[0]) / len(values)).alias("mse"))


def reconstruction_entropy(soft: DataFrame, onehot: list[str]) -> DataFrame:
    """``image, ce``: minus the log of what is reconstructed of a pixel's own classes, normalised, on average."""
    r = reconstruct(soft, onehot)
    total = sum((F.col(f"r_{v}") for v in onehot), F.lit(0.0)) + EPS
    terms = F.array(*[F.struct((F.col(v) > 0).alias("own"), (-F.log(F.col(f"r_{v}") / total + EPS)).alias("t")) for v in onehot])
    return r.select("image", F.inline(terms)).where("own").groupBy("image").agg(F.avg("t").alias("ce"))


def rim_loss(soft: DataFrame, share: float = 0.2) -> DataFrame:
    """``image, rim``: the mean entropy of a pixel's affinities, less ``share`` of the entropy of the segments' use.

    Segments of the grid that no pixel can reach count with the least affinity, as do candidates' missing places.
    """
    clip = lambda c: F.greatest(c, F.lit(EPS))
    local = soft.groupBy("image", "x", "y").agg(F.sum(-clip(F.col("a")) * F.log(clip(F.col("a")))).alias("h")).groupBy("image").agg(F.avg("h").alias("local"), F.count(F.lit(1)).alias("n"))
    use = soft.groupBy("image", "seg").agg(F.sum("a").alias("a")).join(local, "image").select("image", (F.col("a") / F.col("n")).alias("u"))
    whole = use.groupBy("image").agg(F.sum(-clip(F.col("u")) * F.log(clip(F.col("u")))).alias("global"))
    return local.join(whole, "image").select("image", (F.col("local") - share * F.col("global")).alias("rim"))


def variation(pixels: DataFrame, feature: str, guide: list[str], steep: float = 4.0) -> DataFrame:
    """``image, tv``: mean change of a feature to the right and downwards, damped where the guide changes too."""
    out = []
    for axis, other in (("x", "y"), ("y", "x")):
        w = Window.partitionBy("image", other).orderBy(axis)
        step = lambda c: F.lead(c).over(w) - F.col(c)  # noqa: B023, E731
        gaps = [F.abs(step(g)) for g in guide]
        damped = F.when(F.lead(axis).over(w) == F.col(axis) + 1, F.abs(step(feature)) * F.exp(-steep * sum(gaps[1:], gaps[0]) / len(guide)))
        out.append(pixels.select("image", damped.alias("v")).groupBy("image").agg(F.coalesce(F.avg("v"), F.lit(0.0)).alias(axis)))
    return out[0].join(out[1], "image").select("image", (F.col("x") + F.col("y")).alias("tv"))


def local_logits(pixels: DataFrame, colours: list[str], count: int) -> DataFrame:
    """``image, x, y, k, seg, logit``: minus the weighted distances in colour to a candidate's mean and in cells to its centre."""
    dims = pixels.groupBy("image").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    at = cells(pixels, count)
    near = distances(candidates(at).join(dims, "image"), centroids(at, colours), colours)
    sx, sy = F.col("w") / F.col("nx"), F.col("h") / F.col("ny")
    cx, cy = (F.col("seg") % F.col("nx") + 0.5) * sx, (F.floor(F.col("seg") / F.col("nx")) + 0.5) * sy
    spatial = ((F.col("x") - cx) / F.greatest(sx, F.lit(1.0))) ** 2 + ((F.col("y") - cy) / F.greatest(sy, F.lit(1.0))) ** 2
    return near.select("image", "x", "y", "k", "seg", (-(PLACE * spatial + COLOUR * F.col("d"))).alias("logit"))


def assignment(logits: DataFrame) -> DataFrame:
    """Adds ``a``: the softmax of a pixel's local logits; candidates outside of the grid aren't there and so have none of it."""
    return affinity(logits.withColumn("d", -F.col("logit"))).drop("d")


def handcrafted(pixels: DataFrame) -> DataFrame:
    """``image, x, y, h0..h7`` of pixels with ``l, a, b``: the scaled colours, the slopes of lightness across and down, the slope of the colour axes, and the place from 0 to 1.

    Slopes are half the difference of both neighbours, at an edge the difference
    to the only one, 0 without any.
    """
    dims = pixels.groupBy("image").agg(F.max("x").alias("mx"), F.max("y").alias("my"))
    lab = pixels.select("image", "x", "y", (F.col("l") / 100).alias("h0"), (F.col("a") / 128).alias("h1"), (F.col("b") / 128).alias("h2"))

    def slope(c: str, axis: str) -> Column:
        w = Window.partitionBy("image", "y" if axis == "x" else "x").orderBy(axis)
        before, after = F.lag(c).over(w), F.lead(c).over(w)
        return F.when(before.isNull() & after.isNull(), 0.0).when(before.isNull(), after - F.col(c)).when(after.isNull(), F.col(c) - before).otherwise((after - before) / 2)

    out = lab.withColumns({"h3": slope("h0", "x"), "h4": slope("h0", "y"), "da": slope("h1", "y"), "db": slope("h2", "x")}).join(dims, "image")
    share = lambda at, top: F.when(F.col(top) > 0, F.col(at) / F.col(top)).otherwise(0.0)
    return out.select("image", "x", "y", "h0", "h1", "h2", "h3", "h4", F.sqrt(F.col("da") ** 2 + F.col("db") ** 2).alias("h5"), share("x", "mx").alias("h6"), share("y", "my").alias("h7"))


def fitted(features: list[str], size: int) -> list[Column]:
    """``size`` features: the first ones, or all over and over, named f0 and so on."""
    return [F.col(features[i % len(features)]).alias(f"f{i}") for i in range(size)]
