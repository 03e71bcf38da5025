"""Problem 3: the most similar vectors of every vector, by stable projections and a kd-tree.

Vectors are scaled to unit length, so the distance follows from the cosine (d^2 = 2 - 2 cos), and
projected to a few dimensions by Gaussian, that is 2-stable, directions. A kd-tree over the
projections, its splits fitted on a bounded sample, cuts the collection into cells whose number
follows the data. A vector is compared with its own cell first, which gives the distance d of its
k-th neighbour so far; then with further cells in the order of their projected distance r, in rounds
that each bring d up to date, until the chi-square test ``P(chi2_m <= c^2 r^2 / d^2) >= p`` holds for
the next one. All rows are indexed; a cell larger than ``CELL`` is cut into blocks that a query
visits one by one; equal vectors are indexed once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwork.session import checkpointed, table

#: Rows a cell should hold, leaves at most, and rows of the sample that the splits are fitted on: ``FIT`` a leaf, within bounds.
CELL, LEAVES, FIT, LEAST, MOST = 8192, 1 << 16, 16, 1 << 14, 1 << 18
#: Rows of the table of repeated vectors up to which it is broadcast.
DUPS = 200_000
PROJECTIONS, SLACK, STOP = 6, 2.0, 0.75
#: Cells after the own one that a query visits in each round; the last round takes all that are open still.
STEPS = (8, 64)
QUERIES_AT_ONCE = 2048


def directions(dim: int, m: int = PROJECTIONS, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, m)).astype(np.float32)


def chi2_cdf(x: np.ndarray, m: int) -> np.ndarray:
    """Of an even number of degrees of freedom."""
    h = np.asarray(x, float) / 2
    return 1 - np.exp(-h) * sum(h**i / math.factorial(i) for i in range(m // 2))


def pack(v: np.ndarray) -> np.ndarray:
    """Rows as unit vectors of 16-bit floats."""
    v = v / np.abs(v).max(1, keepdims=True)
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float16)


def unpack(packed: pd.Series, dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(packed), np.float16).reshape(-1, dim).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def chi2_at(p: float, m: int) -> float:
    """Where the distribution reaches ``p``, by halving."""
    lo, hi = 0.0, 1.0
    while chi2_cdf(np.array(hi), m) < p:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(np.array(mid), m) < p else (lo, mid)
    return hi


class Tree:
    """Splits of a kd-tree in breadth-first order."""

    def __init__(self, sample: np.ndarray, leaves: int):
        m = sample.shape[1]
        self.depth = max(0, math.ceil(math.log2(max(1, leaves))))
        self.axis, self.cut = np.zeros(1 << self.depth, np.int64), np.zeros(1 << self.depth, np.float32)
        self.leaves = 1 << self.depth
        parts = [sample]
        for level in range(self.depth):
            below = []
            for k, p in enumerate(parts):
                j = int(p.var(0).argmax()) if len(p) else level % m
                node = (1 << level) + k
                self.axis[node], self.cut[node] = j, np.median(p[:, j]) if len(p) else 0.0
                below += [p[p[:, j] <= self.cut[node]], p[p[:, j] > self.cut[node]]]
            parts = below

    def leaf(self, p: np.ndarray) -> np.ndarray:
        node = np.ones(len(p), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (p[np.arange(len(p)), self.axis[node]] > self.cut[node])
        return node - (1 << self.depth)

    def within(self, p: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of the leaves nearer than ``most`` (squared, by row), nearest first within a row.

        From the root down, a row follows the far side of a split only while that is near enough, so
        the work follows the number of leaves found.
        """
        row, node = np.arange(len(p)), np.ones(len(p), np.int64)
        off, d = np.zeros(p.shape, np.float32), np.zeros(len(p), np.float32)
        for _ in range(self.depth):
            j = self.axis[node]
            gap = p[row, j] - self.cut[node]
            at = np.arange(len(row))
            far = d - np.square(off[at, j]) + np.square(gap)
            go = far < most[row]
            new = off[go]
            new[np.arange(len(new)), j[go]] = np.abs(gap[go])
            near = 2 * node + (gap > 0)
            row, node = np.concatenate([row, row[go]]), np.concatenate([near, near[go] ^ 1])
            off, d = np.concatenate([off, new]), np.concatenate([d, far[go]])
        leaf = node - self.leaves
        order = np.lexsort((leaf, d, row))
        return row[order], leaf[order]


def usable(df: DataFrame, key: str, vector: str, order: str, dim: int) -> DataFrame:
    """``key, id, q, c``: the newest usable vector of each key, packed, and a digest of it. ``order`` is unique.

    Usable are vectors of ``dim`` finite numbers of which one is not zero.
    """
    v = F.col(vector)
    fine = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                q = pack(np.stack(b["v"].to_numpy()).astype(np.float64))
                q = [x.tobytes() for x in q]
                yield pd.DataFrame({"key": b["key"], "id": b["id"], "q": q})

    rows = df.filter(F.col(key).isNotNull() & F.col(order).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(key).alias("key"), F.col(order).cast("long").alias("id"), v.alias("v"))
    packed = rows.mapInPandas(run, "key string, id bigint, q binary")
    return packed.groupBy("key").agg(F.max("id").alias("id"), F.max_by("q", "id").alias("q")).withColumn("c", F.unhex(F.md5("q")))


def _search(index_id: np.ndarray, index: np.ndarray, ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, cosine) of up to k members per query with a cosine above its floor."""
    out = []
    for s in range(0, len(q), QUERIES_AT_ONCE):
        sim = q[s : s + QUERIES_AT_ONCE] @ index.T
        low = floor[s : s + QUERIES_AT_ONCE, None]
        if len(index) > 4 * k and (low <= -1).any():
            low = np.maximum(low, np.partition(sim, len(index) - k - 1, axis=1)[:, [len(index) - k - 1]])
        r, c = np.nonzero(sim >= low)
        own = ids[s + r] == index_id[c]
        r, c = r[~own], c[~own]
        x = sim[r, c]
        o = np.lexsort((index_id[c], -x, r))
        r, c, x = r[o], c[o], x[o]
        start = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.empty(0, np.int64)
        rank = np.arange(len(r)) - np.repeat(start, np.diff(np.r_[start, len(r)]))
        keep = rank < k
        out.append((s + r[keep], index_id[c[keep]], x[keep]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _cells(rows: DataFrame, dim: int, k: int) -> DataFrame:
    """Queries compared with the block they are sent to: ``id, q, ids, sims`` per query and block.

    ``rows`` has ``cell, block, kind, id, q, floor``; kind 0 is a member, 1 a member that asks,
    2 a query. Members of a block come first and are held (their number is bounded by the
    blocks); queries stream past them.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, parts, index, index_id = None, [], None, None

        def answer(b: pd.DataFrame) -> pd.DataFrame:
            q = unpack(b["q"], dim)
            r, i, x = _search(index_id, index, b["id"].to_numpy(), q, b["floor"].to_numpy(), k)
            cut = np.searchsorted(r, np.arange(len(b) + 1))
            return pd.DataFrame({"id": b["id"].to_numpy(), "q": b["q"].to_numpy(), "ids": [i[a:z] for a, z in zip(cut[:-1], cut[1:], strict=True)], "sims": [x[a:z] for a, z in zip(cut[:-1], cut[1:], strict=True)]})

        def settle() -> pd.DataFrame | None:
            nonlocal index, index_id, parts
            members = pd.concat(parts, ignore_index=True)
            index, index_id, parts = unpack(members["q"], dim), members["id"].to_numpy(), []
            asking = members[members["kind"] == 1]
            return answer(asking.reset_index(drop=True)) if len(asking) else None

        for b in batches:
            if not len(b):
                continue
            place = b["cell"].to_numpy() * (1 << 20) + b["block"].to_numpy()
            edges = [0, *(np.flatnonzero(place[1:] != place[:-1]) + 1), len(b)]
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                if place[a] != at:
                    if parts and (done := settle()) is not None:
                        yield done
                    at, parts, index = place[a], [], None
                part = b.iloc[a:z]
                member = (part["kind"] < 2).to_numpy()
                if member.any():
                    parts.append(part[member])
                if not member.all():
                    if parts and (done := settle()) is not None:
                        yield done
                    if index is not None:
                        yield answer(part[~member].reset_index(drop=True))
        if parts and (done := settle()) is not None:
            yield done

    placed = rows.repartition("cell", "block").sortWithinPartitions("cell", "block", "kind")
    return placed.mapInPandas(run, "id bigint, q binary, ids array<bigint>, sims array<float>")


def nearest(vectors: DataFrame, names: DataFrame, k: int, min_cosine: float = -1.0, dim: int = 64, asking=None, m: int = PROJECTIONS, slack: float = SLACK, stop: float = STOP, cell: int = CELL, steps: tuple[int, ...] = STEPS) -> DataFrame:
    """``key, neighbour, cosine, rank``: up to ``k`` other keys of highest cosine per key.

    ``vectors`` comes from :func:`usable`, ``names`` has the ``key`` of each ``id``. ``min_cosine`` leaves out what lies below it and so
    bounds the search; ``asking``, a condition on ``key`` and ``id``, restricts who asks, not what is
    searched. ``steps`` are the rounds before the last one. Ties go to the smaller ``id``. Cosines are of the packed vectors, off by about 0.0001.
    An empty table gives an empty result, a table of one key no neighbours.
    """
    sc = vectors.sparkSession.sparkContext
    slim = checkpointed(vectors.select("id", "q", "c", (asking if asking is not None else F.lit(True)).alias("a")))
    # Equal vectors: one of a class is indexed, and the first k + 1 stand for it as neighbours.
    ids = slim.select("c", "id")
    first_of = ids.groupBy("c").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("c", "rep")
    repeated = checkpointed(ids.withColumnRenamed("id", "mate").join(first_of, "c").select("rep", "mate"))
    dups = repeated.select(F.col("mate").alias("id"), (F.col("rep") == F.col("mate")).alias("is_rep"))
    dups = F.broadcast(dups) if repeated.count() <= DUPS else dups
    reps = slim.join(dups, "id", "left").filter("is_rep IS NULL OR is_rep").select("id", "q", (F.col("a") | F.col("is_rep").isNotNull()).alias("a"))
    mates = repeated.withColumn("rn", F.row_number().over(W.partitionBy("rep").orderBy("mate"))).filter(F.col("rn") <= k + 1).select(F.col("rep").alias("id"), "mate")
    n = reps.count()
    g = directions(dim, m)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"p": [(unpack(b["q"], dim) @ g).astype(np.float32).tobytes()]})

    leaves = min(LEAVES, max(1, math.ceil(n / cell)))
    rows = min(MOST, max(LEAST, FIT * leaves))
    part = reps.select("q").sample(rows / n, seed=5) if n > rows else reps.select("q")
    got = b"".join(bytes(r["p"]) for r in part.mapInPandas(project, "p binary").collect())
    tree = sc.broadcast(Tree(np.frombuffer(got, np.float32).reshape(-1, m), leaves))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"cell": tree.value.leaf(unpack(b["q"], dim) @ g).astype(np.int32), "id": b["id"], "q": b["q"], "a": b["a"]})

    placed = reps.select("id", "q", "a").mapInPandas(place, "cell int, id bigint, q binary, a boolean")
    blocks = np.ones(tree.value.leaves, np.int64)
    for r in placed.groupBy("cell").count().collect():  # at most LEAVES rows
        blocks[r["cell"]] = max(1, round(r["count"] / (2 * cell)))
    wide = np.flatnonzero(blocks > 1)
    count_of = F.lit(1)
    if len(wide):
        cut = vectors.sparkSession.createDataFrame(pd.DataFrame({"cell": wide.astype(np.int32), "n": blocks[wide].astype(np.int32)}), "cell int, n int")
        placed, count_of = placed.join(F.broadcast(cut), "cell", "left"), F.coalesce("n", F.lit(1))
    floor = F.lit(float(min_cosine))
    members = placed.select("cell", F.pmod(F.xxhash64("id"), count_of).cast("int").alias("block"), F.when(F.col("a") & (count_of == 1), 1).otherwise(0).alias("kind"), "id", "q", floor.alias("floor"))
    rows = members
    if len(wide):
        rows = rows.unionByName(placed.filter(F.col("a") & (count_of > 1)).select("cell", F.explode(F.sequence(F.lit(0), count_of - 1)).alias("block"), F.lit(2).alias("kind"), "id", "q", floor.alias("floor")))

    def best(df: DataFrame) -> DataFrame:
        """The k best of what a query found in all its places; a query's places are at most those of a round."""
        found = F.zip_with("sims", "ids", lambda x, i: F.struct((-x).alias("o"), i.alias("i")))
        each = df.groupBy("id").agg(F.first("q").alias("q"), F.slice(F.array_sort(F.flatten(F.collect_list(found))), 1, k).alias("z"))
        return each.select("id", "q", F.col("z.i").alias("ids"), F.transform("z.o", lambda x: -x).alias("sims"))

    found = _cells(rows, dim, k)
    found = checkpointed(best(found) if len(wide) else found)
    reach = chi2_at(stop, m) / slack**2

    def further(seen: int, most: int | None):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for s in range(0, len(b), 1024):
                    c = b.iloc[s : s + 1024]
                    p = (unpack(c["q"], dim) @ g).astype(np.float32)
                    floor = np.array([max(min_cosine, x[k - 1]) if len(x) >= k else min_cosine for x in c["sims"]], np.float32)
                    r, t = tree.value.within(p, reach * np.maximum(2 - 2 * floor, 1e-6))
                    other = t != tree.value.leaf(p)[r]
                    r, t = r[other], t[other]
                    rank = np.arange(len(r)) - np.searchsorted(r, r)
                    now = (rank >= seen) & (rank < most) if most else rank >= seen
                    r, t = r[now], t[now]
                    rep = blocks[t]
                    r, t = np.repeat(r, rep), np.repeat(t, rep)
                    block = np.arange(len(r)) - np.repeat(np.cumsum(rep) - rep, rep)
                    yield pd.DataFrame({"cell": t.astype(np.int32), "block": block.astype(np.int32), "kind": np.full(len(r), 2, np.int32), "id": c["id"].to_numpy()[r], "q": c["q"].to_numpy()[r], "floor": floor[r].astype(float)})

        return run

    # The cells that the test leaves open come first in the order of distance, so what was visited is known by its number.
    held, seen = members.withColumn("kind", F.lit(0)), 0
    for most in (*[x for x in steps if x < tree.value.leaves - 1], None):
        asked = found.mapInPandas(further(seen, most), "cell int, block int, kind int, id bigint, q binary, floor double")
        more = _cells(held.unionByName(asked), dim, k)
        if most is None:
            break
        found, seen = checkpointed(best(found.unionByName(more))), most
    hits = found.select("id", "ids", "sims").unionByName(more.select("id", "ids", "sims")).filter(F.size("ids") > 0)
    hits = hits.select("id", F.explode(F.arrays_zip("ids", "sims")).alias("z")).select("id", F.col("z.ids").alias("other"), F.col("z.sims").alias("cosine"))
    top = hits.withColumn("rn", F.row_number().over(W.partitionBy("id").orderBy(F.desc("cosine"), "other"))).filter(F.col("rn") <= k)
    # From representatives back to all keys, a class's own mates first. A vector's list is short, so a class of any size is joined with one row.
    others = top.select("id", "other", "cosine").join(mates.withColumnRenamed("id", "other"), "other", "left").select("id", F.coalesce("mate", "other").alias("n"), "cosine")
    lists = others.unionByName(mates.select("id", F.col("mate").alias("n"), F.lit(1.0).alias("cosine")))
    of_rep = lists.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("o"), "n"))).alias("l"))
    own = of_rep.join(repeated.select(F.col("rep").alias("id")).distinct(), "id", "left_anti")
    every = repeated.join(of_rep.withColumnRenamed("id", "rep"), "rep").select(F.col("mate").alias("id"), "l").unionByName(own.select("id", "l"))
    chosen = every.select("id", F.posexplode(F.slice(F.filter("l", lambda x: x["n"] != F.col("id")), 1, k)).alias("rank", "x"))
    full = chosen.select("id", F.col("x.n").alias("n"), (-F.col("x.o")).alias("cosine"), (F.col("rank") + 1).alias("rank"))
    named = full.join(names.filter(asking) if asking is not None else names, "id").join(names.select(F.col("id").alias("n"), F.col("key").alias("neighbour")), "n")
    return named.select("key", "neighbour", F.col("cosine").cast("double").alias("cosine"), "rank")


def cache_neighbours(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    t = table(spark, sf_dir, "embedding_cache")
    names = t.select(F.col("line_no").alias("id"), F.col("cache_key").alias("key"))
    return nearest(usable(t, "cache_key", "value", "line_no", 64), names, 5, **options)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cache_neighbours(spark, sf_dir, min_cosine=0.90, steps=())
    return found.select(F.least("key", "neighbour").alias("key_a"), F.greatest("key", "neighbour").alias("key_b")).distinct()


def p3_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest keys without a floor, for every row whose line_no is divisible by 100, among all rows."""
    return cache_neighbours(spark, sf_dir, asking=F.col("id") % 100 == 0, slack=1.5).withColumn("cosine", F.round("cosine", 2))


SQL = {
    "p3_found": """
WITH ok AS (SELECT cache_key, line_no, value FROM embedding_cache
  WHERE len(value) = 64 AND len(list_filter(value, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(value, lambda x: x <> 0)) > 0),
v AS (SELECT cache_key, line_no, list_transform(value, lambda x: x::DOUBLE) AS v FROM ok QUALIFY row_number() OVER (PARTITION BY cache_key ORDER BY line_no DESC) = 1),
s AS (SELECT a.cache_key AS k, b.cache_key AS o, list_cosine_similarity(a.v, b.v) AS c, b.line_no AS n FROM v a JOIN v b ON a.cache_key <> b.cache_key),
t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY k ORDER BY c DESC, n) <= 5)
SELECT DISTINCT least(k, o) AS key_a, greatest(k, o) AS key_b FROM t WHERE c >= 0.90"""
}
QUERIES = {"p3_found": p3_found, "p3_top5": p3_top5}
