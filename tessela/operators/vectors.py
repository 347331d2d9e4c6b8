"""Embeddings: norms, prototypes, similarity, propagation to near and similar regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessela.operators.spatial import radius_join


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column) -> Column:
    """The vector at length 1; lengths below 1e-8 count as 1e-8."""
    n = F.greatest(norm(v), F.lit(1e-8))
    return F.transform(v, lambda x: x / n)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def prototypes(df: DataFrame, vec: str = "emb", code: str = "code") -> DataFrame:
    """``code, prototype``: the mean of a class's unit vectors, at length 1.

    Vectors are added place by place, which combines before the shuffle; only one
    row per class and place meets in the end.
    """
    parts = df.select(code, F.posexplode(unit(F.col(vec)))).groupBy(code, "pos").agg(F.avg("col").alias("v"))
    rows = parts.groupBy(code).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("mean"))
    return rows.where(norm(F.col("mean")) > 1e-8).select(code, unit(F.col("mean")).alias("prototype"))


def cosine_gate(df: DataFrame, protos: DataFrame, least: float, vec: str = "emb", code: str = "code") -> DataFrame:
    """Rows whose cosine to their class's prototype reaches ``least``, with it."""
    return df.join(protos, code).withColumn("cosine", dot(unit(F.col(vec)), F.col("prototype"))).where(F.col("cosine") >= least)


def chebyshev_similarity(a: Column, b: Column, limit: float) -> Column:
    """1 minus the greatest difference over ``limit``, within 0 and 1; null without a limit."""
    if limit <= 0:
        return F.lit(None).cast("double")
    gap = F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - gap / limit))


def propagate(df: DataFrame, seeds: DataFrame, radius: float, limit: float, least: float) -> DataFrame:
    """One hop: regions near a seed take its code if they are similar enough and not seeds of another class.

    ``df``: ``sp, cx, cy, emb``; ``seeds``: the annotated ones with ``code``. The
    most similar seed wins, the lowest on a tie.
    """
    pts = df.select(F.col("sp").alias("id"), F.col("cx").alias("x"), F.col("cy").alias("y"))
    near = radius_join(seeds.select(F.col("sp").alias("id"), F.col("cx").alias("x"), F.col("cy").alias("y")), pts, radius)
    s = seeds.select(F.col("sp").alias("a_id"), "code", F.col("emb").alias("a_emb"))
    t = df.select(F.col("sp").alias("b_id"), F.col("emb").alias("b_emb"))
    free = near.join(s, "a_id").join(t, "b_id").join(seeds.select(F.col("sp").alias("b_id")), "b_id", "left_anti")
    scored = free.withColumn("score", chebyshev_similarity(F.col("a_emb"), F.col("b_emb"), limit)).where(F.col("score") >= least)
    best = scored.groupBy("b_id").agg(F.max(F.struct("score", (-F.col("a_id")).alias("low"), "code")).alias("b"))
    return best.select(F.col("b_id").alias("sp"), (-F.col("b.low")).alias("seed"), F.col("b.code").alias("code"), F.col("b.score").alias("score"))
