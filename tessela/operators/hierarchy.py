"""Parent-child links to full hierarchies.

``build_hierarchy`` takes the latest row of each node, finds the roots, and then
extends the frontier of done levels downwards with joins that lengthen paths and
depths. A round of joins advances as many levels as are done already, since the
open links are composed alongside; each is written to the shared folder, so that
lineage stays short and a lost executor costs one round at most. Nodes that no
round reaches lie on a cycle or lead into one: in a forest in which each node has
one parent, a walk from a root can't meet a node twice, so reaching all but those
is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tessela.storage import scratch_path


def latest_links(
    df: DataFrame, keys: Sequence[str], id_col: str, parent: Column, order: Column
) -> DataFrame:
    """One row ``k0.. , id, parent`` per node: the row with the greatest ``order``.

    Rows with a null id don't count. Equal orders are settled by the greater
    parent, so the outcome doesn't depend on the arrival of rows; a null order
    is the least. Null keys form a group of their own.
    """
    ks = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]
    rows = df.select(*ks, F.col(id_col).alias("id"), order.alias("o"), parent.alias("p")).where("id IS NOT NULL")
    best = rows.groupBy(*[f"k{i}" for i in range(len(keys))], "id").agg(F.max(F.struct("o", "p")).alias("b"))
    return best.select(*[f"k{i}" for i in range(len(keys))], "id", F.col("b.p").alias("parent"))


def build_hierarchy(
    df: DataFrame,
    keys: Sequence[str] = ("image", "method"),
    id_col: str = "id",
    parents_col: str = "parents",
    order_col: str = "ingested_at",
    with_path: bool = True,
) -> DataFrame:
    """Path, depth and root of every node.

    Result: the key columns, ``id``, ``parent_id``, ``root_id``, ``depth``,
    ``path`` (root first, the node last; null without ``with_path``) and
    ``in_cycle``.

    * The direct parent is the last entry of ``parents_col``; a null or empty
      list, or a null entry at its end, means none.
    * A node whose parent has no row is a root: depth 0, its own id.
    * Nodes on a cycle, or leading into one, have root -1, depth -1, no path.
    * Null ids don't count; null keys are a key like any other; repeated rows
      are one node; an empty table gives an empty result. Only the named
      columns are read, so other columns may have any name.

    Scale: before round j the levels below 2^j are done, and every other node
    knows its ancestor 2^j levels up and the ids between. One join on that
    ancestor lets the frontier advance over the next 2^j levels at once and
    composes the links of the rest, so a tree of depth d takes log2(d) jobs of
    one shuffle each, in which only open links and the narrow rows that they
    may hang from take part. The join key is (keys, ancestor): no key is
    gathered in one task, an image may hold any share of the rows, and a node
    with very many children is a skewed join side, which adaptive execution
    splits. Every round is a written table in the shared folder.
    """
    spark = df.sparkSession
    kn = [f"k{i}" for i in range(len(keys))]
    last = F.when(F.size(parents_col) > 0, F.element_at(F.col(parents_col), -1))
    base = scratch_path(spark, "hierarchy")
    nodes = latest_links(df, keys, id_col, last, F.col(order_col)).withColumn("k", F.to_json(F.struct(*kn)))  # a key that is never null
    kind = nodes.schema["id"].dataType.simpleString()
    ids = F.array("id") if with_path else F.lit(None).cast(f"array<{kind}>")
    known = nodes.select("k", F.col("id").alias("up"), F.lit(True).alias("has_row"))
    first = nodes.withColumn("up", F.col("parent").cast(kind)).join(known, ["k", "up"], "left").select(
        *kn, "k", "id", F.col("parent").alias("parent_id"), F.when(F.col("has_row").isNull(), F.col("id")).alias("root_id"),
        F.when(F.col("has_row").isNull(), 0).alias("depth"), ids.alias("path"), "up",
    )
    rounds, shape = [f"{base}/0"], first.schema

    def write(step: DataFrame) -> tuple[int, int]:
        """Write a round; how many nodes it reached, and how many are open."""
        seen = Observation()
        step.observe(seen, F.count("root_id").alias("done"), F.count_if(F.col("root_id").isNull()).alias("open")).write.parquet(rounds[-1])
        return seen.get["done"], seen.get["open"]

    done, open_ = write(first)
    while done and open_:
        left = spark.read.schema(shape).parquet(rounds[-1]).where("root_id IS NULL").select(*kn, "k", "id", "parent_id", F.col("path").alias("below"), F.col("up").alias("on"))
        reached = spark.read.schema(shape).parquet(*rounds).where("root_id IS NOT NULL").select("k", F.col("id").alias("on"), "root_id", "depth", "path", F.lit(None).cast(kind).alias("up"))
        links = spark.read.schema(shape).parquet(rounds[-1]).where("root_id IS NULL").select("k", F.col("id").alias("on"), "root_id", "depth", "path", "up")
        step = left.join(reached.unionByName(links), ["k", "on"]).select(
            *kn, "k", "id", "parent_id", "root_id", (F.col("depth") + (1 << (len(rounds) - 1))).alias("depth"),
            (F.concat("path", "below") if with_path else F.col("path")).alias("path"), "up",
        )
        rounds.append(f"{base}/{len(rounds)}")
        done, open_ = write(step)
    whole = spark.read.schema(shape).parquet(*rounds).where("root_id IS NOT NULL")
    names = [F.col(k).alias(n) for k, n in zip(kn, keys)]
    out = whole.select(*names, "id", "parent_id", "root_id", "depth", "path", F.lit(False).alias("in_cycle"))
    if not open_:
        return out
    # What no round reached leads into a cycle.
    looped = spark.read.schema(shape).parquet(rounds[-1]).where("root_id IS NULL").select(
        *names, "id", "parent_id", F.lit(-1).cast(kind).alias("root_id"), F.lit(-1).alias("depth"), F.lit(None).cast(shape["path"].dataType).alias("path"), F.lit(True).alias("in_cycle")
    )
    return out.unionByName(looped)


def descendants(hierarchy: DataFrame, keys: Sequence[str] = ("image", "method")) -> DataFrame:
    """Every (ancestor, descendant) pair with its distance, from the paths alone.

    The pairs are the result asked for: as many as the sum of the depths. Nodes
    in cycles have no path and give none.
    """
    up = F.transform(
        F.slice("path", 1, F.col("depth")),
        lambda a, i: F.struct(a.alias("ancestor_id"), (F.col("depth") - i).alias("distance")),
    )
    return (
        hierarchy.where("depth > 0")
        .select(*keys, F.col("id").alias("descendant_id"), F.inline(up))
        .select(*keys, "ancestor_id", "descendant_id", "distance")
    )
