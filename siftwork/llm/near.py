"""Problem 4: records that share most of their content, by Hamming BK-trees over shards.

A text becomes the set of its character trigrams, each an exact 63-bit number. Two sets with a
Jaccard similarity of at least t share a token among their rarest ones, so a shard is a class of
tokens, every set belongs to the shards of its rarest tokens, and no link is lost. The number of
shards follows the data, so that a shard holds about ``SHARD`` sets.

Every shard has a BK-tree. Its root is the empty set, and the children of a node are keyed by
their integer Hamming distance to it: below the root that of the whole sets, which is their size,
further down that of 256-bit maps of hashed trigrams. The distance of two maps is at most the size
of the symmetric difference of the sets, which the similarity bounds, so a query that follows only
the edges within that radius loses nothing. What it returns is checked on the sets themselves.

Shard trees are broadcast while they have at most ``SENT`` entries in all, and the sets stream past
them where they lie. Beyond that size trees and queries meet by a shuffle on the shard; a shard
larger than ``BLOCK`` is then cut into blocks, each with a tree of its own.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.llm.form import letters_and_digits
from siftwork.llm.lookalike import field_texts
from siftwork.operators.groups import connected_components, pairs_within
from siftwork.session import checkpointed

WORDS = 4
BUCKETS = 1 << 17
#: Sets a shard should hold, sets at most in one tree, entries of shard trees up to which they are broadcast.
SHARD, BLOCK, SENT = 64, 4096, 2_000_000
#: Rows of the search that are followed at once.
AT_ONCE = 4000
FIELDS = {"raw_text": ("raw_records", "record_id"), "finding": ("structured_records", "record_id")}


def split_at(values: np.ndarray, row: np.ndarray, rows: int) -> list[np.ndarray]:
    """``values``, in the order of ``row``, as one array per row."""
    return np.split(values, np.searchsorted(row, np.arange(1, rows)))


def trigrams(texts: list[str]) -> list[np.ndarray]:
    """Per text the distinct runs of three characters of the reduced text, as sorted numbers."""
    reduced = [letters_and_digits(x) for x in texts]
    row = np.repeat(np.arange(len(reduced)), [len(x) for x in reduced])
    cp = np.frombuffer("".join(reduced).encode("utf-32-le"), np.uint32).astype(np.int64)
    run, inside = (cp[:-2] << 42) | (cp[1:-1] << 21) | cp[2:], row[:-2] == row[2:]
    run, row = run[inside], row[:-2][inside]
    order = np.lexsort((run, row))
    run, row = run[order], row[order]
    new = np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1]) | (row[1:] != row[:-1])
    return split_at(run[new], row[new], len(reduced))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def bucket_of(tokens: np.ndarray) -> np.ndarray:
    return (_mixed(tokens) >> np.uint64(47)).astype(np.int64)


def bitmaps(tokens: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """The tokens of each row hashed to 64 * WORDS bits; a row of bytes for each."""
    out = np.zeros((rows, 64 * WORDS), np.uint8)
    out[row, (_mixed(tokens ^ 0x5555) >> np.uint64(56)).astype(np.int64)] = 1
    return np.packbits(out, axis=1, bitorder="little")


#: Texts that are worked on at once in a task.
ROWS = 1000


def token_sets(texts: DataFrame) -> DataFrame:
    """``field_name, key, digest, tokens`` of each text with at least one trigram."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for batch in batches:
            for k in range(0, len(batch), ROWS):
                b = batch.iloc[k : k + ROWS]
                sets = trigrams(b["text"].to_list())
                out = b[["field_name", "key"]].assign(digest=[hashlib.md5(x.tobytes()).digest() for x in sets], tokens=sets)
                yield out[[len(x) > 0 for x in sets]]

    return texts.filter("text IS NOT NULL AND key IS NOT NULL").mapInPandas(run, "field_name string, key string, digest binary, tokens array<bigint>")


def _lengths(n: int, t: float) -> tuple[int, int]:
    """How many of a set's rarest tokens it asks with, and how many it is found by."""
    return n - math.ceil(t * n - 1e-9) + 1, n - math.ceil(2 * t / (1 + t) * n - 1e-9) + 1


def token_counts(tokens: DataFrame, t: float) -> tuple[np.ndarray, int]:
    """How many rows hold a token of each bucket, and how many tree entries they have at most.

    Counts are of a fixed number of buckets, summed in Spark; any such order of tokens keeps the
    search exact.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, entries = np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            if len(b):
                total += np.bincount(bucket_of(np.concatenate(b["tokens"].to_list())), minlength=BUCKETS)
                entries += sum(_lengths(len(x), t)[1] for x in b["tokens"])
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": np.r_[-1, at], "n": np.r_[entries, total[at]]})

    counts = np.zeros(BUCKETS + 1, np.int64)
    rows = tokens.select("tokens").mapInPandas(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    counts[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return counts[:-1], int(counts[-1])


def placed_sets(tokens: DataFrame, t: float) -> tuple[DataFrame, int]:
    """The distinct sets with what the search needs of them, and how many tree entries they have at most.

    Columns are ``id, field_name, digest``, the size ``n``, the ``map`` and ``trees``: a number per
    field and shard for each shard that the set asks, of which the trees of the first ``hold`` hold
    it. Two trees with the same number are searched as one, which changes no result. Tokens are not
    moved: only what the search needs is.
    """
    counts, entries = token_counts(tokens, t)
    shared = tokens.sparkSession.sparkContext.broadcast(counts)
    shards = np.uint64(max(1, entries // SHARD))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), ROWS):
                b = batch.iloc[k : k + ROWS]
                codes, names = pd.factorize(b["field_name"])
                salt = pd.util.hash_array(np.asarray(names, object))[codes]
                size = b["tokens"].map(len).to_numpy()
                asked, held = np.array([_lengths(n, t) for n in size]).T
                row, x = np.repeat(np.arange(len(b)), size), np.concatenate(b["tokens"].to_list())
                maps = bitmaps(x, row, len(b))
                place = np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size)
                rare = x[np.lexsort((x, shared.value[bucket_of(x)], row))]
                asks = place < asked[row]
                row, place = row[asks], place[asks]
                tree = _mixed((_mixed(rare[asks] ^ 0x3333) >> np.uint64(1)) % shards ^ salt[row]).view(np.int64)
                order = np.lexsort((place, tree, row))
                row, place, tree = row[order], place[order], tree[order]
                first = np.ones(len(row), bool)
                first[1:] = (row[1:] != row[:-1]) | (tree[1:] != tree[:-1])
                row, place, tree = row[first], place[first], tree[first]
                order = np.lexsort((place, row))
                hold = np.bincount(row[place < held[row]], minlength=len(b))
                yield b[["field_name", "digest"]].assign(n=size, map=[m.tobytes() for m in maps], trees=split_at(tree[order], row[order], len(b)), hold=hold)

    placed = tokens.select("field_name", "digest", "tokens").mapInPandas(run, "field_name string, digest binary, n int, map binary, trees array<bigint>, hold int")
    return checkpointed(placed.dropDuplicates(["field_name", "digest"])).withColumn("id", F.monotonically_increasing_id()), entries


def far(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Hamming distances of the maps ``i`` of ``a`` to the maps ``j`` of ``b``; a row of each is a word of all maps."""
    out = np.zeros(len(i), np.int64)
    for x, y in zip(a, b, strict=True):
        out += np.bitwise_count(x[i] ^ y[j])
    return out


class Forest:
    """BK-trees of several shards, level by level: ``codes`` are the sorted edges, ``nodes`` what they lead to and ``inner`` which of those have children.

    An edge of level k is (number of the parent in level k - 1) times the largest distance plus the
    distance to it; on the first level the parent is the tree and the distance the size of the set.
    Nodes are numbers of rows of ``sets``, the sizes, maps and ids, which are not part of what is sent.
    """

    def __init__(self, tree: np.ndarray, member: np.ndarray, sets: tuple[np.ndarray, np.ndarray, np.ndarray]):
        self.trees, at = np.unique(tree, return_inverse=True)
        self.sets = sets
        size, maps, _ = sets
        self.span = int(size[member].max(initial=0)) + 1
        self.codes, self.nodes, self.inner, self.distances = [], [], [], 0
        left, code = np.arange(len(tree)), at * self.span + size[member]
        while len(left):
            edges, group = np.unique(code, return_inverse=True)
            order = np.argsort(group, kind="stable")
            left, group = left[order], group[order]
            first = np.r_[True, group[1:] != group[:-1]]
            node = member[left[first]]
            self.codes.append(edges)
            self.nodes.append(node.astype(np.int32))
            left, parent = left[~first], group[~first]
            inner = np.zeros(len(node), bool)
            inner[parent] = True
            self.inner.append(inner)
            code = parent * (64 * WORDS + 1) + far(maps, maps, member[left], node[parent])

    def __getstate__(self) -> dict:
        return self.__dict__ | {"sets": None}

    def search(self, at: np.ndarray, asker: np.ndarray, size: np.ndarray, maps: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
        """(asker, member) within reach, members no larger than the asker; ``size`` and ``maps`` are by asker.

        ``at`` are the places in ``trees`` of the trees that are asked.

        An asker of size s reaches a member of size m at a distance of at most s + m less twice the
        overlap they need; with the distance d to a node it follows the edges from d less that to d
        more than that.
        """
        none = np.empty(0, np.int64)
        found_q, found_m = [none], [none]
        own_size, own_maps, _ = self.sets
        for s in range(0, len(asker), AT_ONCE):
            q, base = asker[s : s + AT_ONCE], at[s : s + AT_ONCE] * self.span
            lo, hi = base + np.ceil(t * size[q] - 1e-9).astype(np.int64), base + np.minimum(size[q], self.span - 1)
            for codes, nodes, inner in zip(self.codes, self.nodes, self.inner, strict=True):
                a, z = np.searchsorted(codes, lo), np.searchsorted(codes, hi, side="right")
                k = np.maximum(z - a, 0)
                q = np.repeat(q, k)
                if not len(q):
                    break
                place = np.repeat(a - (np.cumsum(k) - k), k) + np.arange(len(q))
                node = nodes[place]
                self.distances += len(q)
                d = far(maps, own_maps, q, node)
                both = size[q] + own_size[node]
                reach = both - 2 * _need(t, int(both.max()))[both]
                near = d <= reach
                found_q.append(q[near])
                found_m.append(node[near])
                on = inner[place]
                q, d, reach, base = q[on], d[on], reach[on], place[on] * (64 * WORDS + 1)
                lo, hi = base + np.maximum(d - reach, 0), base + np.minimum(d + reach, 64 * WORDS)
        return np.concatenate(found_q), np.concatenate(found_m)


def _need(t: float, most: int) -> np.ndarray:
    """Shared tokens needed for a similarity of ``t``, by the sum of the two sizes."""
    return np.ceil(t / (1 + t) * np.arange(most + 1) - 1e-9).astype(np.int64)


class Forests:
    """Several forests and where each tree stands; a tree is in one of them."""

    def __init__(self, forests: list[Forest]):
        self.forests = forests
        trees = np.concatenate([f.trees for f in forests])
        order = np.argsort(trees)
        self.trees = trees[order]
        self.which = np.repeat(np.arange(len(forests)), [len(f.trees) for f in forests])[order]
        self.place = np.concatenate([np.arange(len(f.trees)) for f in forests])[order]

    def pairs(self, ids: np.ndarray, size: np.ndarray, maps: np.ndarray, tree: np.ndarray, asker: np.ndarray, t: float) -> pd.DataFrame:
        """Distinct pairs ``a, b`` of ids; of two equal sizes the one with the larger id asks."""
        at = np.minimum(np.searchsorted(self.trees, tree), len(self.trees) - 1)
        here = self.trees[at] == tree
        at, asker, out = at[here], asker[here], []
        for k, f in enumerate(self.forests):
            own = self.which[at] == k
            q, m = f.search(self.place[at[own]], asker[own], size, maps, t)
            a, b = ids[q], f.sets[2][m]
            keep = (f.sets[0][m] < size[q]) | (b < a)
            out.append(pd.DataFrame({"a": a[keep], "b": b[keep]}))
        return pd.concat(out, ignore_index=True).drop_duplicates()


def _maps(packed: pd.Series) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b"".join(packed), np.uint64).reshape(-1, WORDS).T)


def set_table(sets: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, maps and ids of a bounded number of sets, in the order of the ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"n": [b["n"].to_numpy(np.int64).tobytes()], "map": [b"".join(b["map"])], "id": [b["id"].to_numpy(np.int64).tobytes()]})

    parts = sets.select("n", "map", "id").mapInPandas(run, "n binary, map binary, id binary").collect()
    size, ids = (np.frombuffer(b"".join(bytes(p[c]) for p in parts), np.int64) for c in ("n", "id"))
    maps = np.frombuffer(b"".join(bytes(p["map"]) for p in parts), np.uint64).reshape(-1, WORDS)
    order = np.argsort(ids)
    return size[order], np.ascontiguousarray(maps[order].T), ids[order]


def search_sent(sets: DataFrame, t: float) -> DataFrame:
    """Candidates ``a, b`` by shard trees that tasks build and every task gets."""
    sc = sets.sparkSession.sparkContext
    known = sc.broadcast(set_table(sets))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if parts:
            b = pd.concat(parts, ignore_index=True)
            member = np.searchsorted(known.value[2], b["id"].to_numpy())
            yield pd.DataFrame({"forest": [pickle.dumps(Forest(b["tree"].to_numpy(), member, known.value))]})

    held = sets.select(F.explode(F.slice("trees", F.lit(1), F.col("hold"))).alias("tree"), "id")
    built = held.repartition("tree").mapInPandas(build, "forest binary")
    trees = sc.broadcast([bytes(r["forest"]) for r in built.collect()])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size, maps, ids = known.value
        forests = [pickle.loads(x) for x in trees.value]
        for f in forests:
            f.sets = known.value
        every = Forests(forests) if forests else None
        for b in batches:
            if len(b) and every:
                own = np.searchsorted(ids, b["id"].to_numpy())
                asker = np.repeat(np.arange(len(b)), b["trees"].map(len))
                yield every.pairs(ids[own], size[own], maps[:, own], np.concatenate(b["trees"].to_list()), asker, t)

    return sets.select("id", "trees").mapInPandas(run, "a bigint, b bigint")


PLACE = ["tree", "block"]


def search_shuffled(sets: DataFrame, t: float) -> DataFrame:
    """Candidates ``a, b`` by trees and askers that meet in a task per tree and block."""
    held, asks = (sets.select(F.explode(trees).alias("tree"), "n", "map", "id") for trees in (F.slice("trees", F.lit(1), F.col("hold")), F.col("trees")))
    load = checkpointed(held.groupBy("tree").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > BLOCK).select("tree", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks")))
    cut = lambda df: df.join(load, "tree", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = cut(held).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("held", F.lit(True))
    every = cut(asks).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("held", F.lit(False))

    def solve(df: pd.DataFrame) -> pd.DataFrame:
        members, askers = df[df["held"]], df[~df["held"]]
        if not len(members) or not len(askers):
            return pd.DataFrame(columns=["a", "b"])
        # Blocks of a tree are trees of their own.
        tree, block = df["tree"].to_numpy(), df["block"].to_numpy()
        tree = _mixed(tree ^ block).view(np.int64) if block.any() else tree
        table = (members["n"].to_numpy(np.int64), _maps(members["map"]), members["id"].to_numpy())
        forest = Forest(tree[df["held"].to_numpy()], np.arange(len(members)), table)
        return Forests([forest]).pairs(askers["id"].to_numpy(), askers["n"].to_numpy(np.int64), _maps(askers["map"]), tree[~df["held"].to_numpy()], np.arange(len(askers)), t)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting, n = [], 0
        for b in batches:
            if not len(b):
                continue
            waiting.append(b)
            n += len(b)
            if n < 200_000:
                continue
            whole = pd.concat(waiting, ignore_index=True)
            first = int(np.argmax((whole[PLACE] == whole[PLACE].iloc[-1]).all(axis=1).to_numpy()))
            yield solve(whole.iloc[: first or len(whole)])
            # A block's members come first; of a block that fills the batch they are kept for the askers still to come.
            rest = whole.iloc[first:] if first else whole[whole["held"]]
            waiting, n = [rest], len(rest)
        if waiting:
            yield solve(pd.concat(waiting, ignore_index=True))

    columns = [*PLACE, "held", "n", "id", "map"]
    met = own.select(columns).unionByName(every.select(columns)).repartition(*PLACE).sortWithinPartitions(*PLACE, F.desc("held"))
    return met.mapInPandas(run, "a bigint, b bigint").distinct()


#: Candidates up to which their ids and digests are sent to the sets; beyond it they meet by shuffle.
FEW = 200_000


def similar_sets(tokens: DataFrame, t: float) -> DataFrame:
    """``field_name, a, b, similarity`` of all pairs of digests of distinct token sets with at least ``t``."""
    sets, entries = placed_sets(tokens, t)
    found = checkpointed((search_sent if entries <= SENT else search_shuffled)(sets, t))
    sent = F.broadcast if found.count() <= FEW else lambda df: df
    wanted = sets.select("id", "field_name", "digest").join(sent(found.select(F.explode(F.array("a", "b")).alias("id")).distinct()), "id", "left_semi")
    slim = tokens.select("field_name", "digest", "tokens").join(sent(wanted), ["field_name", "digest"]).dropDuplicates(["id"])
    x, y = (slim.select(F.col("id").alias(s), F.col("field_name").alias(f"f{s}"), F.col("digest").alias(f"d{s}"), F.col("tokens").alias(f"t{s}")) for s in "ab")
    shared = F.size(F.array_intersect("ta", "tb"))
    sim = shared / (F.size("ta") + F.size("tb") - shared)
    both = found.join(x, "a").join(y, "b").filter("fa = fb")
    return both.select(F.col("fa").alias("field_name"), F.col("da").alias("a"), F.col("db").alias("b"), sim.alias("similarity")).filter(F.col("similarity") >= t)


def near_parts(texts: DataFrame, t: float) -> tuple[DataFrame, DataFrame]:
    """Members ``field_name, key, digest`` and links between digests."""
    tokens = checkpointed(token_sets(texts))
    return tokens.select("field_name", "key", "digest").distinct(), similar_sets(tokens, t)


def near_pairs(texts: DataFrame, t: float = 0.7) -> DataFrame:
    """Pairs of keys of one field with a trigram similarity of at least ``t``.

    Null texts and texts of fewer than three letters and digits have no set and are no case; texts
    with equal sets are. Rows that stand twice count once.
    """
    members, links = near_parts(texts, t)
    same = pairs_within(members, ["field_name", "digest"], "key").select("field_name", "key_a", "key_b")
    ends = links.join(members.select("field_name", F.col("digest").alias("a"), F.col("key").alias("ka")), ["field_name", "a"]).join(members.select("field_name", F.col("digest").alias("b"), F.col("key").alias("kb")), ["field_name", "b"])
    across = ends.filter("ka <> kb").select("field_name", F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b"))
    return same.unionByName(across).distinct()


def near_groups(texts: DataFrame, t: float = 0.7) -> DataFrame:
    """One row per record: ``field_name, key, group_key, n_links``.

    ``group_key`` is the smallest key of the record's connected group, ``n_links`` the number of
    unlike texts that the record's text is linked to.
    """
    members, links = near_parts(texts, t)
    links = checkpointed(links)
    node = lambda f, d: F.concat_ws(":", f, F.hex(d))
    comp = connected_components(links.select(node("field_name", "a").alias("a"), node("field_name", "b").alias("b")), "a", "b")
    ends = links.select("field_name", F.explode(F.array("a", "b")).alias("digest")).groupBy("field_name", "digest").agg(F.count(F.lit(1)).alias("n_links"))
    tagged = members.join(ends, ["field_name", "digest"], "left").withColumn("node", node("field_name", "digest")).join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = tagged.groupBy("component").agg(F.min("key").alias("group_key"))
    return tagged.join(least, "component").select("field_name", "key", "group_key", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_pairs(field_texts(spark, sf_dir, FIELDS), 0.7)


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(field_texts(spark, sf_dir, FIELDS), 0.7)


QUERIES = {"p4_found": p4_found, "p4_groups": p4_groups}
