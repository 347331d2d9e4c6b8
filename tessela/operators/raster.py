"""Raster and polygon operators.

What can be said about single pixels is said with built-in functions. Kernels whose
outcome at a pixel depends on the whole image (distance transforms, components,
segmentation) run per image on Arrow batches with numpy; an image is the unit of
the problem and bounds a group.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def per_image(df: DataFrame, kernel: Callable[..., np.ndarray], value: str, out: str, kind: str, **params) -> DataFrame:
    """Adds ``out``: ``kernel`` of an image's raster of ``value`` (``image, x, y, value``), at each pixel.

    Places that an image lacks count as 0, and give no rows.
    """
    names = df.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{out}` {kind}"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        x0, y0 = x.min(), y.min()
        raster = np.zeros((int(y.max() - y0) + 1, int(x.max() - x0) + 1), dtype=np.float64)
        raster[y - y0, x - x0] = pdf[value].to_numpy()
        pdf = pdf[names].copy()
        pdf[out] = kernel(raster, **params)[y - y0, x - x0]
        return pdf

    return df.groupBy("image").applyInPandas(run, schema)


def distance_inside(mask: np.ndarray) -> np.ndarray:
    """Euclidean distance of each pixel of a mask to the nearest pixel outside; beyond the frame is outside.

    Exact and separable: the distance along the columns, then for each row the
    least sum of squares over all columns.
    """
    m = np.pad(mask > 0, 1)
    h, w = m.shape
    far = h + w
    g = np.where(m, far, 0).astype(np.int64)
    for i in range(1, h):
        g[i] = np.minimum(g[i], g[i - 1] + 1)
    for i in range(h - 2, -1, -1):
        g[i] = np.minimum(g[i], g[i + 1] + 1)
    cols = np.arange(w)
    gap = (cols[:, None] - cols[None, :]) ** 2
    out = np.empty((h, w))
    for i in range(h):
        out[i] = np.sqrt((gap + (g[i] ** 2)[None, :]).min(axis=1))
    return out[1:-1, 1:-1]


def _spread(mask: np.ndarray, op: Callable, outside: bool, radius: int = 1) -> np.ndarray:
    p = np.pad(mask, radius, constant_values=outside)
    h, w = mask.shape
    rows = op.reduce([p[i : i + h] for i in range(2 * radius + 1)])
    return op.reduce([rows[:, j : j + w] for j in range(2 * radius + 1)])


def close_open(mask: np.ndarray, radius: int = 1, keep: float = 0.2) -> np.ndarray:
    """A mask closed, then opened with a square of ``radius``; beyond the frame is outside.

    If opening leaves less than ``keep`` of the mask's pixels (rounded down, one
    at least), the closed mask stays; if that is empty too, the mask itself.
    """
    m = mask > 0
    if radius <= 0 or not m.any():
        return m.astype(np.int32)
    closed = _spread(_spread(m, np.logical_or, False, radius), np.logical_and, False, radius)
    opened = _spread(_spread(closed, np.logical_and, False, radius), np.logical_or, False, radius)
    if opened.sum() >= max(1, int(keep * m.sum())):
        return opened.astype(np.int32)
    return (closed if closed.any() else m).astype(np.int32)


def label_components(labels: np.ndarray, zero: bool = True) -> np.ndarray:
    """Numbers from 1 for the 4-connected components of equal value, in the order of their first pixel; with ``zero``, value 0 stays 0."""
    h, w = labels.shape
    parent = np.arange(h * w)
    flat = labels.ravel()

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    at = np.arange(h * w).reshape(h, w)
    pairs = np.concatenate([np.stack([at[:, :-1].ravel(), at[:, 1:].ravel()], 1), np.stack([at[:-1].ravel(), at[1:].ravel()], 1)])
    for a, b in pairs[flat[pairs[:, 0]] == flat[pairs[:, 1]]]:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    root = np.array([find(i) for i in range(h * w)])
    kept = (flat != 0) if zero else np.ones(h * w, bool)
    out = np.zeros(h * w, np.int64)
    out[kept] = np.unique(root[kept], return_inverse=True)[1] + 1
    return out.reshape(h, w)


def holes(mask: np.ndarray) -> np.ndarray:
    """Components of what is not in the mask that don't touch the frame, numbered from 1."""
    comp = label_components((mask <= 0).astype(int))
    edge = np.unique(np.concatenate([comp[0], comp[-1], comp[:, 0], comp[:, -1]]))
    inner = np.where(np.isin(comp, edge), 0, comp)
    return np.where(inner > 0, np.unique(inner, return_inverse=True)[1].reshape(inner.shape), 0)


def drop_small(mask: np.ndarray, least: int = 100) -> np.ndarray:
    """The mask without components of fewer pixels."""
    comp = label_components((mask > 0).astype(int))
    return ((comp > 0) & (np.bincount(comp.ravel())[comp] >= least)).astype(np.int32)


def grid_segments(values: np.ndarray, count: int = 16, compactness: float = 10.0, rounds: int = 5) -> np.ndarray:
    """Segments by k-means on value and place from a regular grid of seeds; each pixel looks at the 9 cells around it."""
    h, w = values.shape
    nx = max(1, int(np.sqrt(count * w / max(1, h))))
    ny = max(1, int(np.ceil(count / nx)))
    step = max(h / ny, w / nx)
    yy, xx = np.mgrid[:h, :w]
    cell_y, cell_x = np.minimum(yy * ny // h, ny - 1), np.minimum(xx * nx // w, nx - 1)
    label = cell_y * nx + cell_x
    for _ in range(rounds):
        n = np.maximum(np.bincount(label.ravel(), minlength=nx * ny), 1e-6)
        mean = [np.bincount(label.ravel(), a.ravel().astype(float), minlength=nx * ny) / n for a in (values, yy, xx)]
        best, new = np.full((h, w), np.inf), label
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                cy, cx = cell_y + dy, cell_x + dx
                ok = (cy >= 0) & (cy < ny) & (cx >= 0) & (cx < nx)
                k = np.where(ok, cy * nx + cx, 0)
                d = (values - mean[0][k]) ** 2 + (compactness / step) ** 2 * ((yy - mean[1][k]) ** 2 + (xx - mean[2][k]) ** 2)
                d = np.where(ok & (n[k] > 0.5), d, np.inf)
                new = np.where(d < best, k, new)
                best = np.minimum(best, d)
        label = new
    return label + 1


def stamp_segments(points: DataFrame, size: int) -> DataFrame:
    """``id, x, y`` of the pixels of squares of radius ``size`` along lines of points ``id, pos, x, y`` (in pixels), each once."""
    w = Window.partitionBy("id").orderBy("pos")
    legs = points.select("id", "x", "y", F.coalesce(F.lead("x").over(w), F.col("x")).alias("x1"), F.coalesce(F.lead("y").over(w), F.col("y")).alias("y1"))
    n = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(F.col("x1") - F.col("x")), F.abs(F.col("y1") - F.col("y"))))).cast("int")
    along = legs.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n"))))
    at = along.select("id", F.round(F.col("x") + (F.col("x1") - F.col("x")) * F.col("k") / F.col("n")).cast("int").alias("cx"), F.round(F.col("y") + (F.col("y1") - F.col("y")) * F.col("k") / F.col("n")).cast("int").alias("cy")).distinct()
    side = F.sequence(F.lit(-size), F.lit(size))
    return at.withColumn("dx", F.explode(side)).withColumn("dy", F.explode(side)).select("id", (F.col("cx") + F.col("dx")).alias("x"), (F.col("cy") + F.col("dy")).alias("y")).distinct()


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point to a segment."""
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / length))).otherwise(0.0)
    return F.sqrt((px - ax - t * dx) ** 2 + (py - ay - t * dy) ** 2)


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies in a ring (array of structs x, y), by counting crossings; rings of fewer than three points hold nothing."""
    nxt = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    cross = F.zip_with(ring, nxt, lambda a, b: (
        ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.when(b["y"] != a["y"], b["y"] - a["y"]).otherwise(1.0) + a["x"])
    ).cast("int"))
    return (F.size(ring) >= 3) & (F.aggregate(cross, F.lit(0), lambda s, c: s + c) % 2 == 1)


def ring_area(ring: Column) -> Column:
    """The area of a ring, by the shoelace formula."""
    nxt = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.abs(F.aggregate(F.zip_with(ring, nxt, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, v: s + v)) / 2


def ring_box(ring: Column) -> Column:
    """The bounding box of a ring; null for an empty one."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.when(F.size(ring) > 0, F.struct(F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1")))


def paint(pixels: DataFrame, shapes: DataFrame, cell: float = 32.0) -> DataFrame:
    """``image, x, y, code``: pixels with the code of the last shape (``image, seq, code, ring``) over them, -1 without one.

    Shapes meet pixels in cells of their bounding boxes, then by the exact test;
    painter's order is a ``max_by``, so no order of arrival matters.
    """
    s = shapes.withColumn("b", ring_box(F.col("ring"))).where("b IS NOT NULL").select(
        "image", "seq", "code", "ring", F.explode(F.sequence(F.floor(F.col("b.x0") / cell), F.floor(F.col("b.x1") / cell))).alias("cx"), "b"
    ).withColumn("cy", F.explode(F.sequence(F.floor(F.col("b.y0") / cell), F.floor(F.col("b.y1") / cell)))).drop("b")
    p = pixels.select("image", "x", "y", F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"))
    hit = p.join(s, ["image", "cx", "cy"]).where(in_ring(F.col("x"), F.col("y"), F.col("ring")))
    top = hit.groupBy("image", "x", "y").agg(F.max_by("code", "seq").alias("code"))
    return pixels.select("image", "x", "y").join(top, ["image", "x", "y"], "left").select("image", "x", "y", F.coalesce("code", F.lit(-1)).alias("code"))


def principal_axes(points: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """``by.., n, cx, cy, major, minor, angle``: spread along the two axes of each group of points, from its sample covariance."""
    m = points.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.var_samp("x").alias("a"), F.var_samp("y").alias("c"), F.covar_samp("x", "y").alias("b")
    )
    half, root = (F.col("a") + F.col("c")) / 2, F.sqrt(((F.col("a") - F.col("c")) / 2) ** 2 + F.col("b") ** 2)
    return m.select(*by, "n", "cx", "cy", (half + root).alias("major"), (half - root).alias("minor"), (0.5 * F.atan2(2 * F.col("b"), F.col("a") - F.col("c"))).alias("angle"))


#: The weights of deficit, bad scribbles, few scribbles and failures in a class's priority.
PRIORITY = {"deficit": 0.75, "bad": 0.5, "few": 0.2, "failures": 0.25}


def region_priority(df: DataFrame) -> DataFrame:
    """Adds ``priority`` of a class to be annotated next: worse overlap, fewer scribbles and larger errors first.

    ``iou, fragments, deficit, bad, n_scribbles, failures`` are a class's state.
    """
    c = F.col
    return df.withColumn("priority", (1 - c("iou")) * c("fragments") + PRIORITY["deficit"] * c("deficit") + PRIORITY["bad"] * c("bad") + PRIORITY["few"] / (1 + c("n_scribbles")) - PRIORITY["failures"] * c("failures"))


def neighbour_cells(df: DataFrame, nx: int, ny: int) -> DataFrame:
    """``.., dx, dy, cell, inside``: the nine grid cells around each row's ``cx, cy``."""
    near = F.sequence(F.lit(-1), F.lit(1))
    out = df.withColumn("dx", F.explode(near)).withColumn("dy", F.explode(near))
    x, y = F.col("cx") + F.col("dx"), F.col("cy") + F.col("dy")
    return out.withColumns({"cell": y * nx + x, "inside": (x >= 0) & (x < nx) & (y >= 0) & (y < ny)})


def principal_direction(points: DataFrame, by: tuple[str, ...], quantile: float = 0.8) -> DataFrame:
    """``by.., dx, dy``: the main direction of the core of each group of ``x, y, dist``, weighted by ``dist``; (1, 0) if it has none.

    The core is what lies at least as deep as the quantile of the depths; a core
    of one point gives way to the whole group. The direction points to the right,
    straight down if it is upright.
    """
    c = F.col
    cut = points.groupBy(*by).agg(F.percentile("dist", F.lit(quantile)).alias("cut"), F.count(F.lit(1)).alias("all"))
    marked = points.join(cut, list(by)).withColumn("core", c("dist") >= c("cut"))
    size = marked.groupBy(*by).agg(F.count_if("core").alias("n_core"))
    rows = marked.join(size, list(by)).where((c("n_core") < 2) | c("core")).withColumn("w", F.greatest(c("dist"), F.lit(1e-6)))
    s = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum("w").alias("sw"), (F.sum(c("w") * c("x")) / F.sum("w")).alias("mx"), (F.sum(c("w") * c("y")) / F.sum("w")).alias("my"),
        F.sum(c("w") * c("x") * c("x")).alias("xx"), F.sum(c("w") * c("y") * c("y")).alias("yy"), F.sum(c("w") * c("x") * c("y")).alias("xy"),
    )
    a, d, b = c("xx") - c("sw") * c("mx") ** 2, c("yy") - c("sw") * c("my") ** 2, c("xy") - c("sw") * c("mx") * c("my")
    angle = F.atan2(2 * b, a - d) / 2
    flat = (c("n") < 2) | (F.greatest(a, d) <= 1e-12)
    dx, dy = F.cos(angle), F.sin(angle)
    turn = F.when((dx < -1e-12) | ((F.abs(dx) <= 1e-12) & (dy < 0)), -1).otherwise(1)
    return s.select(*by, F.when(flat, 1.0).otherwise(dx * turn).alias("dx"), F.when(flat, 0.0).otherwise(dy * turn).alias("dy"))


def discs(points: DataFrame, sizes: DataFrame, radius: int) -> DataFrame:
    """``image, x, y``: the pixels at most ``radius`` (one at least) from a point ``image, x, y`` in pixels, within the image's ``w, h``, each once."""
    r = max(1, int(radius))
    side = F.sequence(F.lit(-r - 1), F.lit(r + 1))
    at = points.select("image", F.col("x").alias("px"), F.col("y").alias("py")).dropna().join(sizes.select("image", "w", "h"), "image")
    rows = at.withColumn("x", F.explode(F.transform(side, lambda i: (F.floor("px") + i).cast("int")))).withColumn("y", F.explode(F.transform(side, lambda i: (F.floor("py") + i).cast("int"))))
    near = (F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2 <= r * r
    return rows.where(near & (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") < F.col("w")) & (F.col("y") < F.col("h"))).select("image", "x", "y").distinct()


def split_holes(mask: np.ndarray, least: int = 100) -> list[np.ndarray]:
    """The mask in parts without holes: cut along the main axis of its largest hole, parts of components below ``least`` pixels dropped, until none is left."""
    done, todo = [], [mask > 0]
    while todo:
        m = todo.pop()
        inner = holes(m)
        if not inner.any():
            if m.any():
                done.append(m)
            continue
        y, x = np.nonzero(inner == np.bincount(inner.ravel())[1:].argmax() + 1)
        axis = np.linalg.svd(np.stack([x - x.mean(), y - y.mean()], 1), full_matrices=False)[2][0] if len(x) > 1 else np.array([1.0, 0.0])
        yy, xx = np.indices(m.shape)
        across = -(xx - x.mean()) * axis[1] + (yy - y.mean()) * axis[0]
        for half in (m & (across < 0.5), m & (across >= -0.5)):
            kept = drop_small(half, least) > 0
            if kept.any():
                todo.append(kept)
    return done
