"""Topics, candidate pairs of topics, groups of them and the controls made from groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwork.operators.ordinal import numbered_id, with_ordinal
from siftwork.operators.vectors import against_all, unit
from siftwork.session import checkpointed


#: Bins of the similarities from -1 to 1 among which an order statistic is looked for.
BINS = 10_000


def similarity_quantile(topics: DataFrame, quantile: float) -> float | None:
    """The quantile of the similarities of topics of unlike parents, interpolated; None without such a pair.

    Counted per bin first; then only the values of the one or two bins that hold it are looked at.
    """

    def values(b: pd.DataFrame, other: pd.DataFrame, s: np.ndarray) -> np.ndarray:
        pair = (b["topic_id"].to_numpy()[:, None] < other["topic_id"].to_numpy()) & (b["parent"].to_numpy()[:, None] != other["parent"].to_numpy())
        return np.round(s[pair], 9)

    bin_of = lambda v: np.clip(((v + 1) / 2 * BINS).astype(np.int64), 0, BINS - 1)

    def counted(b: pd.DataFrame, other: pd.DataFrame, s: np.ndarray) -> pd.DataFrame:
        at, n = np.unique(bin_of(values(b, other, s)), return_counts=True)
        return pd.DataFrame({"bin": at, "n": n})

    of_all = lambda fn, schema: against_all(topics, "topic_id", ["parent"], "c", fn, schema)
    counts = of_all(counted, "bin bigint, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).orderBy("bin").toPandas()
    if not len(counts):
        return None
    upto = counts["n"].cumsum().to_numpy()
    place = quantile * (upto[-1] - 1)
    ranks = [int(np.floor(place)), int(np.ceil(place))]
    wanted = sorted({int(counts["bin"][np.searchsorted(upto, r, side="right")]) for r in ranks})

    def within(b: pd.DataFrame, other: pd.DataFrame, s: np.ndarray) -> pd.DataFrame:
        v = values(b, other, s)
        at, n = np.unique(v[np.isin(bin_of(v), wanted)], return_counts=True)
        return pd.DataFrame({"s": at, "n": n})

    # A bin has at most 2 * 10 ** 9 / BINS values of nine digits.
    found = of_all(within, "s double, n bigint").groupBy("s").agg(F.sum("n").alias("n")).orderBy("s").toPandas()
    before = upto[np.searchsorted(counts["bin"], wanted[0])] - counts["n"][np.searchsorted(counts["bin"], wanted[0])]
    sums = before + found["n"].cumsum().to_numpy()
    low, high = (float(found["s"][np.searchsorted(sums, r, side="right")]) for r in ranks)
    return low + (high - low) * (place - ranks[0])


def candidate_pairs(topics: DataFrame, k: int = 5, quantile: float = 0.95) -> DataFrame:
    """The pairs of ``topic_id, parent, centroid`` that a rule selects, with the rules as flags.

    Rules: each among the other's ``k`` nearest (``mutual``), one among the other's (``either``),
    similarity of at least the quantile over pairs of unlike parents (``high``). Topics are compared
    in blocks of a matrix; only selected pairs are written down.
    """
    t = checkpointed(topics.select("topic_id", "parent", unit("centroid").alias("c")))
    threshold = similarity_quantile(t, quantile)
    least = np.inf if threshold is None else round(threshold, 9)
    pair = "src string, dst string, cross_parent boolean, similarity double"

    def chosen(b: pd.DataFrame, other: pd.DataFrame, r: np.ndarray, c: np.ndarray, s: np.ndarray) -> pd.DataFrame:
        src, dst = b.iloc[r].reset_index(drop=True), other.iloc[c].reset_index(drop=True)
        return pd.DataFrame({"src": src["topic_id"], "dst": dst["topic_id"], "cross_parent": src["parent"] != dst["parent"], "similarity": s[r, c]})

    def nearest(b: pd.DataFrame, other: pd.DataFrame, s: np.ndarray) -> pd.DataFrame:
        s = np.round(s, 9)
        s[b["topic_id"].to_numpy()[:, None] == other["topic_id"].to_numpy()] = -np.inf
        edge = np.partition(s, -k, axis=1)[:, [-k]] if s.shape[1] > k else np.full((len(s), 1), -3.0)
        return chosen(b, other, *np.nonzero((s >= edge) & (s > -np.inf)), s)

    def high(b: pd.DataFrame, other: pd.DataFrame, s: np.ndarray) -> pd.DataFrame:
        s = np.round(s, 9)
        return chosen(b, other, *np.nonzero((s >= least) & (b["topic_id"].to_numpy()[:, None] < other["topic_id"].to_numpy())), s)

    of_all = lambda fn: against_all(t, "topic_id", ["parent"], "c", fn, pair)
    near = of_all(nearest).withColumn("r", F.row_number().over(W.partitionBy("src").orderBy(F.desc("similarity"), "dst"))).filter(F.col("r") <= k)
    both = near.select("src", "dst", "cross_parent", "similarity", F.lit(1).alias("v")).unionByName(of_all(high).withColumn("v", F.lit(0)))
    pairs = both.groupBy(F.least("src", "dst").alias("key_a"), F.greatest("src", "dst").alias("key_b")).agg(F.max("cross_parent").alias("cross_parent"), F.max("similarity").alias("similarity"), F.sum("v").alias("v"))
    return pairs.select("key_a", "key_b", "cross_parent", "similarity", (F.col("v") == 2).alias("mutual"), (F.col("v") >= 1).alias("either"), (F.col("similarity") >= least).alias("high"))


def rule_comparison(pairs: DataFrame) -> DataFrame:
    """Pairs and mean similarity per rule."""
    rules = {"mutual": F.col("mutual"), "either": F.col("either"), "high": F.col("high"), "mutual_or_high": F.col("mutual") | F.col("high")}
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), c.alias("on")) for n, c in rules.items()]))
    r = pairs.withColumn("x", each).filter("x.on")
    return r.groupBy(F.col("x.rule").alias("rule")).agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if("cross_parent").alias("n_cross_parent"), F.avg("similarity").alias("mean_similarity"))


def maximal_cliques(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``clique, node``: the maximal cliques of two or more nodes; a clique's name is its sorted nodes.

    Nodes are put in order by degree, and every clique is found from its first node: one search per
    node, among the neighbours behind it, which leaves out what a neighbour before it extends. So a
    task holds the neighbours of one node and the edges between them, and no component is held
    whole. Null ends and loops are dropped; a graph without edges has no clique.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna().filter("a <> b")
    e = checkpointed(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.groupBy("a").agg(F.count(F.lit(1)).alias("d"))
    ranked = both.join(degree, "a").join(degree.select(F.col("a").alias("b"), F.col("d").alias("e")), "b")
    star = checkpointed(ranked.select("a", "b", (F.struct("d", "a") < F.struct(F.col("e").alias("d"), F.col("b").alias("a"))).alias("later")))
    spokes = star.select(F.col("a").alias("first"), F.col("b").alias("x"), F.lit(None).cast(dict(e.dtypes)["a"]).alias("y"), "later")
    x, y = (star.select(F.col("a").alias("first"), F.col("b").alias(c)) for c in "xy")
    rims = e.select(F.col("a").alias("x"), F.col("b").alias("y")).join(x, "x").join(y, ["first", "y"]).select("first", "x", "y", F.lit(False).alias("later"))
    return spokes.unionByName(rims).groupBy("first").applyInPandas(_cliques_from, f"clique string, node {dict(e.dtypes)['a']}")


def _cliques_from(f: pd.DataFrame) -> pd.DataFrame:
    """The maximal cliques that start at one node, by branching on the neighbours that a pivot leaves; sets are bit masks."""
    spokes = f[f["y"].isna()]
    nodes = spokes["x"].tolist()
    at = {n: k for k, n in enumerate(nodes)}
    near = [0] * len(nodes)
    rims = f[f["y"].notna()]
    for x, y in zip(rims["x"], rims["y"], strict=True):
        near[at[x]] |= 1 << at[y]
        near[at[y]] |= 1 << at[x]
    bits = lambda mask: [k for k in range(mask.bit_length()) if mask >> k & 1]
    before = sum(1 << k for k, later in enumerate(spokes["later"]) if not later)
    todo, names = [(0, (1 << len(nodes)) - 1 & ~before, before)], []
    while todo:
        clique, can, seen = todo.pop()
        if not can:
            if not seen and clique:
                names.append(sorted([f["first"].iloc[0], *(nodes[k] for k in bits(clique))]))
            continue
        best = max(bits(can | seen), key=lambda k: (near[k] & can).bit_count())
        for k in bits(can & ~near[best]):
            todo.append((clique | 1 << k, can & near[k], seen & near[k]))
            can, seen = can & ~(1 << k), seen | 1 << k
    return pd.DataFrame([("|".join(map(str, c)), n) for c in names for n in c], columns=["clique", "node"])


def group_summary(cliques: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per clique its size and the number, mean and smallest similarity of its pairs."""
    size = cliques.groupBy("clique").agg(F.count(F.lit(1)).alias("n_topics"))
    left, right = (cliques.select("clique", F.col("node").alias(f"key_{x}")) for x in "ab")
    inside = left.join(pairs.select("key_a", "key_b", "similarity"), "key_a").join(right, ["clique", "key_b"])
    stats = inside.groupBy("clique").agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("similarity").alias("mean_similarity"), F.min("similarity").alias("min_similarity"))
    return size.join(stats, "clique")


def flatten(rows: DataFrame, key: str, nested: str) -> DataFrame:
    """One row per element of an array of structs, with its place from 0."""
    return rows.select(key, F.posexplode(nested).alias("place", "x")).select(key, "place", "x.*")


def diverse_sample(rows: DataFrame, by: str, mode: str, key: str, most: int) -> DataFrame:
    """Up to ``most`` rows per group, taken in turn from its modes in the order of mode and key."""
    turn = F.row_number().over(W.partitionBy(by, mode).orderBy(key))
    first = rows.withColumn("_t", turn).filter(F.col("_t") <= most)
    return first.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy("_t", mode, key))).filter(F.col("place") <= most).drop("_t")


def evidence_cards(rows: DataFrame, by: str, mode: str, supports: Column, topic: str) -> DataFrame:
    """Per group: units, supporting ones and their share, distinct topics, and the modes by count.

    Modes are counted in an aggregate first, so a card holds one entry per mode.
    """
    n = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n_units"), F.count_if(supports).alias("n_support"), F.countDistinct(F.when(supports, F.col(topic))).alias("n_topics"))
    modes = rows.filter(supports).groupBy(by, mode).agg(F.count(F.lit(1)).alias("m"))
    listed = modes.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("m")).alias("o"), F.col(mode).alias("v")))), lambda x: F.concat(x["v"], F.lit(":"), (-x["o"]).cast("string"))), ";").alias("modes"))
    return n.join(listed, by, "left").withColumn("support_ratio", F.col("n_support") / F.col("n_units"))


def top_samples(rows: DataFrame, by: list[str], order: list[Column], value: str, n: int) -> DataFrame:
    """The first ``n`` rows per group as one ordered list."""
    first = rows.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("_r") <= n)
    return first.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.col(value).cast("string").alias("v")))), lambda x: x["v"]), ",").alias("samples"))


def batched_requests(rows: DataFrame, batch: str, order: str, fields: list[str]) -> DataFrame:
    """Rows of a batch as one ordered array of structs, with a digest of its JSON; batches are of fixed size."""
    items = F.array_sort(F.collect_list(F.struct(order, *[f for f in fields if f != order])))
    return rows.groupBy(batch).agg(items.alias("items")).withColumn("n_items", F.size("items")).withColumn("payload_sha256", F.sha2(F.to_json("items", {"ignoreNullFields": "false"}), 256))


def controls(validations: DataFrame, request: str, groups: str) -> tuple[DataFrame, DataFrame]:
    """Controls and their members from nested answers ``array<struct<name, members: array<string>>>``.

    Controls are numbered ``CTRL-001`` and on by request and by the sorted members within it; a
    group of fewer than two distinct members is no control.
    """
    g = validations.select(request, F.posexplode(groups).alias("place", "g")).select(request, "place", F.col("g.name").alias("name"), F.array_sort(F.array_distinct("g.members")).alias("members"))
    g = g.filter(F.size("members") >= 2).withColumn("first", F.array_join("members", "\u001f"))
    numbered = with_ordinal(g, [request, "first", "place"], "n")
    named = numbered.withColumn("control_id", numbered_id("n", "CTRL-", 3))
    return named.select("control_id", request, "name", F.size("members").alias("n_members")), named.select("control_id", F.explode("members").alias("member"))


def partition_errors(asked: DataFrame, answered: DataFrame, request: str, item: str) -> DataFrame:
    """Items of a request that the answer misses, has in excess or holds twice: the answer must be an exact partition."""
    a = asked.select(request, item).distinct().withColumn("_a", F.lit(True))
    b = answered.groupBy(request, item).agg(F.count(F.lit(1)).alias("_n"))
    why = F.when(F.col("_n").isNull(), "missing").when(F.col("_a").isNull(), "unknown").when(F.col("_n") > 1, "repeated")
    return a.join(b, [request, item], "full").withColumn("reason", why).filter("reason IS NOT NULL").select(request, item, "reason")
