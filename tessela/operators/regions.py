"""Regions of rasters as relations: runs, components, distances, merging of thin regions, outlines.

Pixels are rows ``image, x, y, ..``. Rows and columns of an image are the groups
of every window, so that a single huge image spreads over the cluster; what is
gathered is a strip of rows, or the outline of one region.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessela.operators import graph
from tessela.operators.quality import adjacency
from tessela.storage import discard, materialise

STRIP = 64  # rows of an image that are searched together for distances
PART_ROWS = 256  # rows of an image whose components are found together
_SHIFT = 1 << 32  # the number of a run is its row times this plus its first column


def _along(axis: str) -> Window:
    return Window.partitionBy("image", "x" if axis == "y" else "y").orderBy(axis)


def runs(pixels: DataFrame, value: str = "value") -> DataFrame:
    """Adds ``run``: the number of the stretch of equal values and no gaps in a row that a pixel lies in, in the order of the rows."""
    w = _along("x")
    starts = F.coalesce((F.lag(value).over(w) != F.col(value)) | (F.lag("x").over(w) != F.col("x") - 1), F.lit(True))
    first = F.last(F.when(starts, F.col("x")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return pixels.withColumn("run", F.col("y").cast("bigint") * _SHIFT + first)


def components(pixels: DataFrame, value: str = "value", zero: bool = True) -> DataFrame:
    """Adds ``comp``: numbers from 1 for the 4-connected components of equal value, in the order of their first pixel.

    With ``zero`` pixels of value 0 are of component 0. Runs that touch are the
    edges of a graph, whose components are found in about log2 rounds; null
    values are a value of their own, and an empty table gives no rows.
    """
    at = runs(pixels.where(F.col(value).isNull() | (F.col(value) != 0)) if zero else pixels, value)
    w = _along("y")
    above = F.when((F.lag("y").over(w) == F.col("y") - 1) & F.lag(value).over(w).eqNullSafe(F.col(value)), F.lag("run").over(w))
    edges = at.select("image", F.col("run").alias("u"), above.alias("v")).where("v IS NOT NULL").distinct()
    found = graph.components(at.select("image", F.col("run").alias("node")), edges)
    order = found.select("image", "comp").distinct().withColumn("number", F.row_number().over(Window.partitionBy("image").orderBy("comp")))
    numbered = found.join(order, ["image", "comp"]).select("image", F.col("node").alias("run"), F.col("number").alias("comp"))
    out = at.join(numbered, ["image", "run"]).select(*pixels.columns, "comp")
    return out.unionByName(pixels.where(F.col(value) == 0).withColumn("comp", F.lit(0))) if zero else out


def _row_pass(pdf: pd.DataFrame) -> np.ndarray:
    """Distances in a strip of rows from those along the columns (``g``): the least of g^2 and the square of the way to it."""
    x, y = pdf["x"].to_numpy(np.int64), pdf["y"].to_numpy(np.int64)
    x0, y0 = x.min() - 1, y.min()
    g = np.zeros((y.max() - y0 + 1, x.max() - x0 + 2), np.float64)
    g[y - y0, x - x0] = pdf["g"].to_numpy(np.float64) ** 2
    best, width = g.copy(), g.shape[1]
    far = int(np.sqrt(g.max())) + 1
    for d in range(1, min(far, width - 1) + 1):  # a pixel farther away than the greatest distance along a column can't be the nearest
        np.minimum(best[:, d:], g[:, :-d] + d * d, out=best[:, d:])
        np.minimum(best[:, :-d], g[:, d:] + d * d, out=best[:, :-d])
    return np.sqrt(best[y - y0, x - x0])


def distance_inside(pixels: DataFrame, mask: str = "mask") -> DataFrame:
    """Adds ``dist``: the Euclidean distance of a pixel of the mask to the nearest one outside, 0 outside.

    Places that an image lacks, and all beyond its frame, are outside. Exact and
    separable: windows along the columns, then strips of ``STRIP`` rows.
    """
    w, down = _along("y"), Window.partitionBy("image", "x").orderBy(F.desc("y"))
    inside = F.coalesce(F.col(mask) > 0, F.lit(False))
    gap = lambda over, step: F.coalesce(F.lag("y").over(over) != F.col("y") + step, F.lit(True))
    above = F.last(F.when(~inside, F.col("y")).when(gap(w, -1), F.col("y") - 1), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    below = F.last(F.when(~inside, F.col("y")).when(gap(down, 1), F.col("y") + 1), ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0))
    at = pixels.withColumns({"above": above, "below": below}).withColumn("g", F.least(F.col("y") - F.col("above"), F.col("below") - F.col("y")))
    names = pixels.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pixels.schema.fields) + ", dist double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[names].assign(dist=_row_pass(pdf))

    return at.withColumn("strip", F.floor(F.col("y") / STRIP)).groupBy("image", "strip").applyInPandas(run, schema)


def normalised_distance(dist: DataFrame) -> DataFrame:
    """Adds ``share``: a distance over the greatest of its image, 0 where that is 0."""
    top = dist.groupBy("image").agg(F.max("dist").alias("top"))
    return dist.join(top, "image").withColumn("share", F.when(F.col("top") > 1e-6, F.least(F.greatest(F.col("dist") / F.col("top"), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)).drop("top")


def signatures(pixels: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """``by.., x0, y0, x1, y1, area``: what tells a component from another."""
    return pixels.groupBy(*by).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count(F.lit(1)).alias("area"))


def allowed(pixels: DataFrame, cls: int, margin: float = 0.0, overlap: bool = False) -> DataFrame:
    """``image, x, y`` where a scribble of a class may go: wrongly labelled pixels of the class, deeper than ``margin`` in its region, not yet used.

    ``pixels``: ``image, x, y, gt, pred, used``.
    """
    own = pixels.withColumn("mask", (F.col("gt") == cls).cast("int"))
    deep = distance_inside(own).where(F.col("dist") > margin) if margin > 0 else own.where("mask = 1")
    bad = deep.where(~F.col("pred").eqNullSafe(F.lit(cls)))
    return (bad if overlap else bad.where(~F.coalesce("used", F.lit(False)))).select("image", "x", "y")


def measure(labels: DataFrame, label: str = "label") -> DataFrame:
    """``image, label, area, radius``: pixels of each positive label, and the greatest distance of one to the outside of its label."""
    # A label is a mask of its own: a neighbour of another label is outside.
    parts = labels.where(F.col(label) > 0)
    own = parts.select(F.concat_ws("|", F.col("image").cast("string"), F.col(label).cast("string")).alias("image"), F.col("image").alias("of"), F.col(label).alias("label"), "x", "y", F.lit(1).alias("mask"))
    return distance_inside(own).groupBy("of", "label").agg(F.count(F.lit(1)).alias("area"), F.max("dist").alias("radius")).withColumnRenamed("of", "image")


def merge_small(labels: DataFrame, hint: int, share: float = 0.02, thin: float = 1.5, passes: int = 4, label: str = "label") -> DataFrame:
    """``labels`` with very small and very thin regions given to the neighbour with which they share most of their outline.

    Small is below ``share`` of an even region's area (8 pixels at least), thin
    a radius below ``thin``. A neighbour that is neither comes first, then the
    longer border, the larger area and radius, and the lower label. Within a
    pass regions change in the order of area, radius and label and see what
    changed before. The order makes an image's list of regions one group; it
    holds regions, not pixels. Stops after ``passes``, or when nothing changes.
    """
    out = materialise(labels.withColumn(label, F.coalesce(F.col(label), F.lit(0)).cast("bigint")), "merged")
    size = labels.where(F.col(label) > 0).groupBy("image").agg(F.greatest(F.lit(8.0), F.rint(share * F.greatest(F.lit(1.0), F.count(F.lit(1)) / max(1, hint)))).alias("least"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        area, radius = dict(zip(pdf["label"], pdf["area"])), dict(zip(pdf["label"], pdf["radius"]))
        near = {u: dict(zip(v, w)) if v is not None else {} for u, v, w in zip(pdf["label"], pdf["near"], pdf["weight"])}
        least = pdf["least"].iloc[0]
        bad = {u for u in area if area[u] < least or radius[u] < thin}
        rad = {u: 0.0 if area[u] < least else radius[u] for u in area}
        to = {}
        for u in sorted(bad, key=lambda u: (area[u], rad[u], u)):
            good = [v for v in near[u] if v not in bad and area.get(v, 0) > 0] or [v for v in near[u] if area.get(v, 0) > 0]
            if good and area[u] > 0 and (area[u] < least or rad[u] < thin):
                best = max(good, key=lambda v: (near[u][v], area[v], rad[v], -v))
                to[u] = best
                area[best], rad[best] = area[best] + area[u], max(rad[best], rad[u])
                area[u], rad[u] = 0, 0.0

        def end(u: int) -> int:
            while u in to:
                u = to[u]
            return u

        return pd.DataFrame({"image": pdf["image"], "label": pdf["label"], "new": [end(u) for u in pdf["label"]]})

    kind = dict(labels.dtypes)["image"]
    for _ in range(max(1, passes)):
        edges = adjacency(out.where(F.col(label) > 0).withColumn("sp", F.col(label)))
        near = graph.mirrored(edges).groupBy("image", F.col("u").alias("label")).agg(F.collect_list("v").alias("near"), F.collect_list(F.col("w").cast("double")).alias("weight"))
        rows = measure(out, label).join(near, ["image", "label"], "left").join(size, "image")
        moved = rows.groupBy("image").applyInPandas(run, f"image {kind}, label bigint, new bigint").where("label <> new")
        moved = materialise(moved, "moved")
        if not moved.limit(1).count():
            break
        m = moved.select("image", F.col("label").alias(label), "new")
        before, out = out, materialise(out.join(m, ["image", label], "left").withColumn(label, F.coalesce("new", label)).select(*labels.columns), "merged")
        discard(before, moved)
    return out


def postprocess(labels: DataFrame, hint: int, prune: bool = False, label: str = "label") -> DataFrame:
    """``labels`` with each label one component, small and thin ones merged if ``prune``, numbered from 1; 0 and null stay 0."""
    def split(df: DataFrame) -> DataFrame:
        return components(df.withColumn(label, F.coalesce(F.col(label), F.lit(0))), label).withColumn(label, F.col("comp").cast("bigint")).drop("comp")

    out = split(labels)
    return split(merge_small(out, hint, label=label)) if prune else out


def outline_edges(pixels: DataFrame, label: str = "label") -> DataFrame:
    """``image, label, x, y, dx, dy``: the unit edges around each positive label's pixels, with the label on their right in pixel axes."""
    c = F.col
    w, h = _along("x"), _along("y")
    back, down = Window.partitionBy("image", "y").orderBy(F.desc("x")), Window.partitionBy("image", "x").orderBy(F.desc("y"))
    free = lambda over, axis, step: ~F.coalesce((F.lag(label).over(over) == c(label)) & (F.lag(axis).over(over) == c(axis) - step), F.lit(False))
    sides = ((free(h, "y", 1), 0, 0, 1, 0), (free(back, "x", -1), 1, 0, 0, 1), (free(down, "y", -1), 1, 1, -1, 0), (free(w, "x", 1), 0, 1, 0, -1))
    at = pixels.withColumns({f"side{i}": side[0] for i, side in enumerate(sides)}).where(c(label) > 0)
    each = F.array(*[F.when(c(f"side{i}"), F.struct((c("x") + a).alias("px"), (c("y") + b).alias("py"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))) for i, (_, a, b, dx, dy) in enumerate(sides)])
    return at.select("image", c(label).alias("label"), F.inline(F.array_compact(each))).withColumnsRenamed({"px": "x", "py": "y"})


def rings_of(x: np.ndarray, y: np.ndarray, dx: np.ndarray, dy: np.ndarray) -> list[list[tuple[int, int]]]:
    """The closed rings of unit edges, corners only; where two rings touch in a point, pixels that meet in it stay apart."""
    after: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for a, b, u, v in zip(x.tolist(), y.tolist(), dx.tolist(), dy.tolist()):
        after.setdefault((a, b), []).append((u, v))
    rings = []
    for start in sorted(after):
        while after.get(start):
            at, way = start, after[start].pop()
            ring, first = [], way
            while True:
                at = (at[0] + way[0], at[1] + way[1])
                turn = (-way[1], way[0])  # towards the label first, so that a pixel is gone around closely
                ways = after[at]
                if at == start and turn not in ways:
                    if way != first:
                        ring.insert(0, start)
                    break
                nxt = turn if turn in ways else ways[0]
                ways.remove(nxt)
                if nxt != way:
                    ring.append(at)
                way = nxt
            rings.append(ring)
    return rings


def _area(ring: list[tuple[float, float]]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, [*ring[1:], ring[0]])) / 2


def _holds(ring: list[tuple[float, float]], p: tuple[float, float]) -> bool:
    inside = False
    for a, b in zip(ring, [*ring[1:], ring[0]]):
        if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]:
            inside = not inside
    return inside


def _parts(x: np.ndarray, y: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each pixel of a strip, the place in the arrays of the first pixel by rows of its 4-connected component of equal value."""
    order = np.lexsort((x, y))
    x, y, value = x[order], y[order], value[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1] + 1) | (y[1:] != y[:-1]) | (value[1:] != value[:-1])
    run, first = np.cumsum(new) - 1, np.flatnonzero(new)
    width = x.max() - x.min() + 2  # with a gap, so that rows don't run on
    key = (y - y.min()) * width + x - x.min()
    up = np.minimum(np.searchsorted(key, key - width), len(key) - 1)
    touch = (key[up] == key - width) & (value[up] == value)
    a, b = run[touch], run[up[touch]]
    root = np.arange(len(first))
    while True:
        low = np.minimum(root[a], root[b])
        now = root.copy()
        for side in (a, b):
            np.minimum.at(now, root[side], low)
            np.minimum.at(now, side, low)
        while (now[now] != now).any():
            now = now[now]
        if (now == root).all():
            break
        root = now
    out = np.empty(len(x), np.int64)
    out[order] = order[first[root[run]]]
    return out


def largest_parts(pixels: DataFrame) -> DataFrame:
    """The pixels ``image, x, y, label`` of each positive label's largest 4-connected component; of equal ones the leftmost, then topmost.

    Strips of rows find their own components, those that touch across strips are
    joined as a graph, so that only what crosses a border of strips is in rounds.
    """
    c = F.col
    kinds = dict(pixels.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["x"].to_numpy(np.int64), pdf["y"].to_numpy(np.int64)
        at = _parts(x, y, pdf["label"].to_numpy())
        return pdf[["image", "x", "y", "label"]].assign(part=y[at] * _SHIFT + x[at])

    strips = pixels.where("label > 0").withColumn("strip", F.floor(c("y") / PART_ROWS)).groupBy("image", "strip")
    own = materialise(strips.applyInPandas(run, f"image {kinds['image']}, x {kinds['x']}, y {kinds['y']}, label {kinds['label']}, part bigint"), "parts")
    above = own.where(F.pmod(c("y"), F.lit(PART_ROWS)) == PART_ROWS - 1).select("image", "x", (c("y") + 1).alias("y"), "label", c("part").alias("v"))
    links = materialise(own.where(F.pmod(c("y"), F.lit(PART_ROWS)) == 0).join(above, ["image", "x", "y", "label"]).select("image", c("part").alias("u"), "v").distinct(), "links")
    ends = links.select("image", c("u").alias("node")).unionByName(links.select("image", c("v").alias("node")))
    whole = graph.components(ends, links).select("image", c("node").alias("part"), "comp")
    sizes = own.groupBy("image", "label", "part").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("x", "y")).alias("first"))
    joined = sizes.join(whole, ["image", "part"], "left").withColumn("comp", F.coalesce("comp", "part"))
    whole_sizes = joined.groupBy("image", "label", "comp").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    best = whole_sizes.groupBy("image", "label").agg(F.min(F.struct((-c("n")).alias("n"), "first", "comp")).alias("b")).select("image", "label", c("b.comp").alias("comp"))
    picked = materialise(joined.select("image", "label", "part", "comp").join(best, ["image", "label", "comp"]).select("image", "label", "part"), "picked")
    out = materialise(own.join(picked, ["image", "label", "part"]).select(*pixels.columns), "largest")
    discard(own, links, picked)
    return out


POINTS = "array<struct<x:double,y:double>>"


def polygons(pixels: DataFrame, label: str = "label", box: tuple[float, float, float, float] = (0.0, 0.0, 1.0, 1.0)) -> DataFrame:
    """``image, label, border, holes, area``: the largest polygon of each positive label, its holes kept, scaled into ``box``.

    Pixels that touch only in a corner are apart. Borders are closed, and hold
    corners only. Areas are in pixels, holes taken off; of equal ones the leftmost,
    then topmost is taken. The group is the outline of that one polygon.
    """
    c, dims = F.col, pixels.groupBy("image").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    own = largest_parts(pixels.select("image", "x", "y", c(label).alias("label")))
    edges = outline_edges(own).join(dims, "image")
    kinds = dict(edges.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = rings_of(pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["dx"].to_numpy(), pdf["dy"].to_numpy())
        # One component has one border; all other rings are its holes.
        sized = [(_area(r), r) for r in found]
        border, inner = next(r for size, r in sized if size > 0), [r for size, r in sized if size < 0]
        area = sum(size for size, _ in sized)
        w, h = pdf["w"].iloc[0], pdf["h"].iloc[0]
        scaled = lambda r: [{"x": box[0] + x / w * (box[2] - box[0]), "y": box[1] + y / h * (box[3] - box[1])} for x, y in [*r, r[0]]]
        return pd.DataFrame({"image": [pdf["image"].iloc[0]], "label": [pdf["label"].iloc[0]], "border": [scaled(border)], "holes": [[scaled(r) for r in inner]], "area": [float(area)]})

    return edges.groupBy("image", "label").applyInPandas(run, f"image {kinds['image']}, label {kinds['label']}, border {POINTS}, holes array<{POINTS}>, area double")


def simplified(points: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """A line without the points that lie within ``tolerance`` of what is left; its ends stay."""
    keep = {0, len(points) - 1}
    todo = [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        (ax, ay), (bx, by) = points[a], points[b]
        length = (bx - ax) ** 2 + (by - ay) ** 2
        worst, at = -1.0, a
        for i in range(a + 1, b):
            px, py = points[i]
            t = max(0.0, min(1.0, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / length)) if length else 0.0
            d = (px - ax - t * (bx - ax)) ** 2 + (py - ay - t * (by - ay)) ** 2
            if d > worst:
                worst, at = d, i
        if worst > tolerance**2:
            keep.add(at)
            todo += [(a, at), (at, b)]
    return [points[i] for i in sorted(keep)]


def simplify(lines: DataFrame, column: str, tolerance: float = 1e-10) -> DataFrame:
    """``lines`` with the points (structs x, y) of a column simplified; fewer than three points stay as they are, null stays null."""
    names, schema = lines.columns, lines.schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f[column] = [
                None if p is None else p if len(p) < 3 else [{"x": x, "y": y} for x, y in simplified([(q["x"], q["y"]) for q in p], tolerance)] for p in f[column]
            ]
            yield f[names]

    return lines.mapInPandas(run, schema)


def ring_is_valid(ring: Column) -> Column:
    """Whether a ring has three different points and an area."""
    nxt = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    area = F.abs(F.aggregate(F.zip_with(ring, nxt, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, v: s + v))
    return (F.size(F.array_distinct(ring)) >= 3) & (area > 0)


def sanitised(border: Column, grid: float = 1e-9) -> Column:
    """A border on a grid, without repeats of the point before and without closing point; null if nothing with an area is left."""
    snapped = F.transform(border, lambda p: F.struct((F.rint(p["x"] / grid) * grid).alias("x"), (F.rint(p["y"] / grid) * grid).alias("y")))
    single = F.filter(snapped, lambda p, i: (i == 0) | (p != F.element_at(snapped, F.greatest(i, F.lit(1)))))
    open_ = F.when((F.size(single) > 1) & (single[0] == F.element_at(single, -1)), F.slice(single, 1, F.greatest(F.size(single) - 1, F.lit(0)))).otherwise(single)
    return F.when(ring_is_valid(open_), open_)
