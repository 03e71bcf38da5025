"""Pairs within groups and connected components, without collecting a group anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.session import checkpointed

#: Members of a group that meet in one block of a blocked self-join.
BLOCK = 1000


def pairs_within(members: DataFrame, group: list[str], key: str, variant: str | None = None, block: int = BLOCK) -> DataFrame:
    """All pairs ``key_a < key_b`` of members that share ``group``.

    ``members`` has one row per member with the columns ``group``, ``key`` and, if given,
    ``variant``; with ``variant`` only pairs of unlike variants come out: the variants of a group are
    paired first and their members joined on, so a group of copies costs no more than it yields.
    Groups of one member are dropped before the join. A large group is cut into blocks by a hash
    of the key, and each block meets each other block as a join key of its own, so that no task
    holds more than two blocks.

    Null groups, keys or variants take part in nothing; an empty input gives an empty result.
    """
    if variant:
        base = members.select(*group, F.col(key).alias("_k"), F.col(variant).alias("_v")).dropna()
        unlike = pairs_within(base.select(*group, "_v").distinct(), group, "_v", block=block)
        sides = [base.select(*group, F.col("_v").alias(f"key_{s}"), F.col("_k").alias(f"_{s}")) for s in "ab"]
        both = unlike.join(sides[0], [*group, "key_a"]).join(sides[1], [*group, "key_b"]).filter("_a <> _b")
        return both.select(*group, F.least("_a", "_b").alias("key_a"), F.greatest("_a", "_b").alias("key_b")).distinct()
    base = members.select(*group, key).dropna()
    sizes = base.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    blocks = F.ceil(F.col("_n") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(key), F.col("_b")).cast("int")
    spread = (
        base.join(sizes, group)
        .withColumn("_b", blocks)
        .withColumn("_c", own)
        .withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
        .withColumn("_lo", F.least("_c", "_o"))
        .withColumn("_hi", F.greatest("_c", "_o"))
        .drop("_n", "_b", "_o")
    )
    left, right = (spread.select(*group, "_lo", "_hi", F.col("_c").alias(f"_c{s}"), F.col(key).alias(f"key_{s}")) for s in "ab")
    on = left.join(right, [*group, "_lo", "_hi"]).filter((F.col("key_a") < F.col("key_b")) & ((F.col("_lo") == F.col("_hi")) | (F.col("_ca") != F.col("_cb"))))
    return on.select(*group, "key_a", "key_b")


def connected_components(edges: DataFrame, a: str, b: str, rounds: int = 40) -> DataFrame:
    """The smallest node id reachable from each node: columns ``node, component``.

    Alternating large-star and small-star steps; every round is one shuffle of the edge list and
    is cut off by a checkpoint in the shared folder. The neighbour lists are never collected: the
    minimum per node is an aggregate and comes back by a join. Null ends are dropped, self-loops
    keep their node.
    """
    cur = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).dropna().distinct()
    nodes = cur.select(F.col("u").alias("node")).union(cur.select("v")).distinct()
    cur = checkpointed(cur.filter("u <> v"))
    for _ in range(rounds):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        new = checkpointed(small)
        sums = [x.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first() for x in (cur, new)]
        cur = new
        if sums[0] == sums[1]:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    found = cur.groupBy("u").agg(F.min("v").alias("c"))
    return nodes.join(found, nodes.node == found.u, "left").select("node", F.coalesce("c", "node").alias("component"))
