"""Graphs of neighbouring regions: smoothing, components, cleanup, relabelling."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessela.storage import discard, made, materialise, remove, scratch_path, write_counted


def mirrored(edges: DataFrame) -> DataFrame:
    """Both directions of undirected edges ``image, u, v, w``; each edge is read once."""
    pair = lambda a, b: F.struct(F.col(a).alias("u"), F.col(b).alias("v"))
    return edges.select("image", "w", F.inline(F.array(pair("u", "v"), pair("v", "u")))).select("image", "u", "v", "w")


def per_region(rows: DataFrame) -> DataFrame:
    """Rows of one a region, for a join with edges or pixels: these are hashed, so that the many edges or pixels needn't be sorted."""
    return rows.hint("shuffle_hash")


def smooth(scores: DataFrame, edges: DataFrame, steps: int, alpha: float, k: int = 3) -> DataFrame:
    """``steps`` rounds of (1-a) s + a (weighted mean of neighbours), normalised each round.

    A region without neighbours keeps its scores. ``scores``: ``image, sp, s0..``.
    The edges are materialised once, if they aren't yet, and the scores before each
    round, of which there are few; a round is one join and one aggregate.
    """
    edges = materialise(edges, "edges") if steps > 0 and not made(edges) else edges
    floor = lambda c: F.greatest(c, F.lit(1e-8))
    for _ in range(steps):
        scores = materialise(scores.select("image", "sp", *[f"s{i}" for i in range(k)]), "scores")
        near = mirrored(edges).join(per_region(scores.withColumnRenamed("sp", "v")), ["image", "v"]).groupBy("image", F.col("u").alias("sp")).agg(
            F.sum("w").alias("w"), *[F.sum(F.col(f"s{i}") * F.col("w")).alias(f"n{i}") for i in range(k)]
        )
        mixed = scores.join(near, ["image", "sp"], "left").select(
            "image", "sp", *[F.when(F.col("w") > 0, (1 - alpha) * F.col(f"s{i}") + alpha * F.col(f"n{i}") / F.col("w")).otherwise(F.col(f"s{i}")).alias(f"s{i}") for i in range(k)]
        )
        total = sum((floor(F.col(f"s{i}")) for i in range(k)), F.lit(0.0))
        scores = mixed.select("image", "sp", *[(floor(F.col(f"s{i}")) / floor(total)).alias(f"s{i}") for i in range(k)])
    return scores


def components(nodes: DataFrame, edges: DataFrame, by: str = "image") -> DataFrame:
    """``by, node, comp``: the least node of each connected component.

    Every round gives each node, and the node that is its label, the least of
    the labels' own labels around it. As roots are hooked too, whole clusters
    merge in a round: a path of n nodes takes about log2 n rounds in any order of
    its nodes. It stops only when nothing changes, which is when both ends of
    every edge have one label. Every round is a written table in the shared
    folder. Null nodes and edges don't count.
    """
    spark = nodes.sparkSession
    base = scratch_path(spark, "components")
    e = edges.select(by, F.col("u").alias("a"), F.col("v").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    e.unionByName(e.select(by, F.col("b").alias("a"), F.col("a").alias("b"))).distinct().write.parquet(f"{base}/edges")
    e = spark.read.parquet(f"{base}/edges")
    nodes.select(by, "node").where("node IS NOT NULL").distinct().withColumn("comp", F.col("node")).write.parquet(f"{base}/0")
    i, moving = 0, True
    while moving:
        now = spark.read.parquet(f"{base}/{i}").select(by, "node", "comp")
        jump = now.select(by, F.col("node").alias("comp"), F.col("comp").alias("far"))
        jumped = now.join(jump, [by, "comp"], "left").select(by, "node", "comp", F.coalesce("far", "comp").alias("low"))
        at = jumped.select(by, F.col("node").alias("b"), F.col("low").alias("near"))
        least = e.join(at, [by, "b"]).groupBy(by, F.col("a").alias("node")).agg(F.min("near").alias("near"))
        hooked = jumped.join(least, [by, "node"], "left").select(by, "node", "comp", F.least("low", "near").alias("low"))
        roots = hooked.select(by, F.col("comp").alias("node"), F.lit(None).alias("comp"), "low")
        step = hooked.unionByName(roots).groupBy(by, "node").agg(F.min("low").alias("low"), F.max("comp").alias("comp"))
        i += 1
        write_counted(step.select(by, "node", F.col("low").alias("comp"), (F.col("low") < F.col("comp")).alias("moved")), f"{base}/{i}")
        moving = spark.read.parquet(f"{base}/{i}").where("moved").limit(1).count() > 0
        remove(spark, f"{base}/{i - 1}")
    remove(spark, f"{base}/edges")
    return spark.read.parquet(f"{base}/{i}").select(by, "node", "comp")


def relabel(df: DataFrame, label: str = "sp") -> DataFrame:
    """Adds ``dense``: labels numbered 1.. within each image in their order; from the distinct labels only."""
    order = df.select("image", label).distinct().withColumn("dense", F.row_number().over(Window.partitionBy("image").orderBy(label)))
    return df.join(order, ["image", label])


def _clean(limit: int, threshold: float | None = None, ratio: float = 0.0):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """The changed labels of one image's regions with few neighbours of their label, in the order of the regions; later components see earlier changes."""
        first = dict(zip(pdf["sp"], pdf["label"]))
        around, near = (dict(zip(pdf["sp"], pdf[c])) for c in ("around", "near"))
        if threshold is not None:
            known = {sp: (n, n * conf, changed) for sp, n, conf, changed in zip(pdf["sp"], pdf["n"], pdf["conf"], pdf["label"] != pdf["base"])}
        done: set[int] = set()
        new: dict[int, int] = {}
        for start in sorted(first):
            if start in done:
                continue
            own, part, todo = first[start], [], [start]
            done.add(start)
            stands = False
            while todo:
                u = todo.pop()
                part.append(u)
                links = [v for v, _ in near[u] if first[v] == own]
                stands |= any(label == own and n > len(links) for label, n, _ in around[u])  # beside one that isn't here, in a large component
                for v in links:
                    if v not in done:
                        done.add(v)
                        todo.append(v)
            if len(part) > limit or stands:
                continue
            if threshold is not None:
                size, sure, changed = zip(*(known[u] for u in part))
                if not any(changed) or sum(sure) / max(sum(size), 1) >= threshold:
                    continue
            votes: dict[int, list[int]] = {}
            moved = [(label, n, w) for u in part for v, w in near[u] if v in new for label, n, w in ((first[v], -1, -w), (new[v], 1, w))]
            for label, n, w in [*(x for u in part for x in around[u]), *moved]:
                so_far = votes.setdefault(label, [0, 0])
                so_far[0] += n
                so_far[1] += w
            support = {label: w for label, (n, w) in votes.items() if n and label != own}
            if support:
                best, most = max(support.items(), key=lambda x: (x[1], -x[0]))
                if most >= ratio * sum(support.values()):
                    new.update(dict.fromkeys(part, best))
        return pd.DataFrame({"image": pdf["image"].iloc[:1].repeat(len(new)), "sp": list(new), "clean": list(new.values())})

    return run


def _lists(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    """``image, sp`` and all their rows as sorted arrays of the columns."""
    return rows.groupBy("image", "sp").agg(F.sort_array(F.collect_list(F.array(*[F.col(c).cast("bigint") for c in columns]))).alias(name))


def _cleaned(labels: DataFrame, edges: DataFrame, limit: int, run) -> DataFrame:
    """``image, sp, label, clean``, with what can change decided by ``run``.

    A region that isn't done still has its first label, so the components are those
    of the first labels, and those of more than ``limit`` regions never change.
    A region with ``limit`` neighbours of its label is in such a one. Only the others
    are gathered by image, each with the sums of what surrounds it by label, and with
    those neighbours that may change too. Edges are never written again with labels.
    """
    c, extra = F.col, [x for x in labels.columns if x not in ("image", "sp", "label")]
    labels, own = materialise(labels, "labels"), not made(edges)
    edges = materialise(edges, "edges") if own else edges
    both = mirrored(edges).withColumnRenamed("u", "sp")
    other = per_region(labels.select("image", c("sp").alias("v"), c("label").alias("other")))
    sums = materialise(both.join(other, ["image", "v"]).groupBy("image", "sp", "other").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w")), "around")
    large = sums.where(c("n") >= limit).join(labels.select("image", "sp", c("label").alias("other")), ["image", "sp", "other"], "left_semi")
    few = materialise(labels.where("sp IS NOT NULL").join(large, ["image", "sp"], "left_anti"), "few")
    here = few.select("image", "sp")
    inner = both.join(per_region(here), ["image", "sp"], "left_semi").join(per_region(here.withColumnRenamed("sp", "v")), ["image", "v"], "left_semi")
    rows = few.select("image", "sp", "label", *extra).join(_lists(sums.join(here, ["image", "sp"], "left_semi"), "around", "other", "n", "w"), ["image", "sp"], "left")
    rows = rows.join(_lists(inner, "near", "v", "w"), ["image", "sp"], "left").withColumns({x: F.coalesce(x, F.array().cast("array<array<bigint>>")) for x in ("around", "near")})
    kinds = dict(labels.dtypes)
    changed = materialise(rows.groupBy("image").applyInPandas(run, f"image {kinds['image']}, sp {kinds['sp']}, clean int"), "changed")
    discard(sums, few, *([edges] if own else []))
    return labels.select("image", "sp", "label").join(changed, ["image", "sp"], "left").withColumn("clean", F.coalesce("clean", c("label").cast("int")))


def cleanup(labels: DataFrame, edges: DataFrame, limit: int = 2) -> DataFrame:
    """Components of equal label of at most ``limit`` regions take the label with most support around them.

    Sequential by definition, so those of one image's regions that can change are one
    group; large components and pixels are never gathered.
    """
    return _cleaned(labels.select("image", "sp", "label"), edges, limit, _clean(limit))


def cleanup_conservative(labels: DataFrame, edges: DataFrame, limit: int = 3, threshold: float = 0.75, ratio: float = 0.6) -> DataFrame:
    """As ``cleanup``, but only for components that hold a changed region and aren't sure, and only to a label with enough support.

    ``labels``: ``image, sp, label``, ``base`` (the label before), ``n`` pixels
    and ``conf``. A component changes if its mean confidence by pixels is below
    ``threshold`` and the best label around has at least ``ratio`` of the support.
    """
    return _cleaned(labels.select("image", "sp", "label", "base", "n", "conf"), edges, limit, _clean(limit, threshold, ratio))
