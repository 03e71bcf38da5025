"""Cluster structure and separation over vectors, in one pass per statistic and without pair matrices.

Vectors are arrays of one length. Means per cluster are taken component by component in an
aggregate (``avg`` of each component), so nothing is exploded and partial sums are combined before
the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.operators.channels import MISSING, NOISE
from siftwork.operators.ordinal import rank_in_group
from siftwork.session import checkpointed

#: Topics whose mean vectors are sent to the workers at once, and topics and rows that a task compares at once.
TOPICS, TOPICS_AT_ONCE, ROWS_AT_ONCE = 1 << 16, 1024, 2000


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column | str) -> Column:
    """Scaled to length one; a zero vector stays zero."""
    v = F.col(v) if isinstance(v, str) else v
    norm = F.sqrt(dot(v, v))
    return F.zip_with(v, F.array_repeat(F.when(norm > 0, norm).otherwise(1.0), F.size(v)), lambda x, n: x.cast("double") / n)


def distance(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2.0)), F.lit(0.0), lambda s, x: s + x))


def centroids(rows: DataFrame, by: list[str], vector: str, dim: int) -> DataFrame:
    """``by..., centroid, n``: the mean vector of each group."""
    parts = [F.avg(F.element_at(vector, i + 1).cast("double")) for i in range(dim)]
    return rows.groupBy(*by).agg(F.array(*parts).alias("centroid"), F.count(F.lit(1)).alias("n"))


def centroid_ranks(rows: DataFrame, key: str, label: str, vector: str, dim: int, with_noise: bool = True) -> DataFrame:
    """Distance of each row to its cluster's centroid, and its rank from 1 within the cluster.

    With noise, noise rows are a cluster of their own; else they have neither distance nor rank.
    """
    live = rows if with_noise else rows.filter(F.col(label) >= 0)
    c = centroids(live, [label], vector, dim).drop("n")
    near = live.join(c, label).select(key, label, distance(vector, "centroid").alias("distance"))
    ranked = rank_in_group(near.withColumn("_d", F.round("distance", 9)), label, ["_d", key], "rank").select(key, label, "distance", "rank")
    if with_noise:
        return ranked
    rest = rows.filter(F.col(label) < 0).select(key, label, F.lit(None).cast("double").alias("distance"), F.lit(None).cast("int").alias("rank"))
    return ranked.unionByName(rest)


def structure(rows: DataFrame, label: str) -> DataFrame:
    """One row: counts, ratios and sizes of the topics. Noise and missing rows are no topic."""
    per = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    topic = F.col(label) >= 0
    total, missing, noise = F.sum("n"), F.sum(F.when(F.col(label) == MISSING, F.col("n")).otherwise(0)), F.sum(F.when(F.col(label) == NOISE, F.col("n")).otherwise(0))
    largest = F.coalesce(F.max(F.when(topic, F.col("n"))), F.lit(0))
    return per.agg(total.alias("record_count"), (total - missing).alias("clustered_record_count"), missing.alias("missing_count"), (missing / total).alias("missing_ratio"), F.count_if(topic).alias("cluster_count"), noise.alias("noise_count"), (noise / total).alias("noise_ratio"), F.coalesce(F.percentile(F.when(topic, F.col("n")), F.lit(0.5)), F.lit(0.0)).alias("median_topic_size"), largest.alias("largest_topic_size"), F.coalesce(F.try_divide(largest, total - missing), F.lit(0.0)).alias("largest_topic_ratio"))


def silhouette(rows: DataFrame, key: str, label: str, vector: str, dim: int, topics: int = TOPICS) -> DataFrame:
    """``key, label, silhouette`` by cosine distance, for rows of a topic.

    The mean cosine distance to a cluster is one less the product with the mean of its unit vectors,
    so a row is compared with the means alone. At most ``topics`` means are sent at a time; with
    more of them the rows are read in several passes, whose results are brought together by key.
    Rows of a topic of one row have 0; with a single topic there is no row.
    """
    u = rows.filter(F.col(label) >= 0).select(key, label, unit(vector).alias("u"))
    means = checkpointed(centroids(u, [label], "u", dim))
    n_topics = means.count()
    passes = max(1, -(-n_topics // topics))
    kinds = dict(rows_types(u, key, label))
    sc, parts = u.sparkSession.sparkContext, None
    for p in range(passes):
        some = means.filter(F.pmod(F.xxhash64(label), F.lit(passes)) == p).orderBy(label).collect()
        sent = sc.broadcast((np.array([r[label] for r in some]), np.array([r["centroid"] for r in some]).reshape(-1, dim), np.array([r["n"] for r in some])))

        def score(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            labels, m, n = sent.value
            for batch in batches:
                for k in range(0, len(batch), ROWS_AT_ONCE):
                    b = batch.iloc[k : k + ROWS_AT_ONCE]
                    x, own = np.stack(b["u"].to_numpy()), b[label].to_numpy()
                    a, other = np.full(len(b), np.nan), np.full(len(b), np.inf)
                    for c in range(0, len(labels), TOPICS_AT_ONCE):
                        d = 1 - x @ m[c : c + TOPICS_AT_ONCE].T
                        at = np.searchsorted(labels[c : c + TOPICS_AT_ONCE], own)
                        here = np.flatnonzero((at < d.shape[1]) & (labels[c + np.minimum(at, d.shape[1] - 1)] == own))
                        size = n[c + at[here]]
                        a[here] = np.where(size > 1, d[here, at[here]] * size / np.maximum(size - 1, 1), np.inf)
                        d[here, at[here]] = np.inf
                        other = np.minimum(other, d.min(1))
                    yield pd.DataFrame({key: b[key], label: own, "a": a, "b": other})

        found = u.mapInPandas(score, f"{key} {kinds[key]}, {label} {kinds[label]}, a double, b double")
        parts = found if parts is None else parts.unionByName(found)
    if n_topics < 2:
        return u.limit(0).select(key, label, F.lit(0.0).alias("silhouette"))
    if passes > 1:
        parts = parts.groupBy(key, label).agg(F.max(F.when(~F.isnan("a"), F.col("a"))).alias("a"), F.min("b").alias("b"))
    inf = F.lit(float("inf"))
    value = F.when((F.col("a") == inf) | (F.greatest("a", "b") == 0), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return parts.select(key, label, value.alias("silhouette"))


def rows_types(df: DataFrame, *columns: str) -> list[tuple[str, str]]:
    return [(c, t) for c, t in df.dtypes if c in columns]


def against_all(topics: DataFrame, key: str, columns: list[str], vector: str, fn, schema: str, lot: int = TOPICS) -> DataFrame:
    """``fn`` of every batch of topics against all topics, without a row per pair.

    ``fn(batch, lot, products)`` gets two frames of ``key`` and ``columns`` and the matrix of their
    vectors' products, a bounded piece at a time, and returns a frame of ``schema``; what it gives
    for the pieces of a row is for the caller to bring together. At most ``lot`` topics are sent at
    a time; ``topics`` is best checkpointed.
    """
    sc, out = topics.sparkSession.sparkContext, None
    passes = max(1, -(-topics.count() // lot))
    for p in range(passes):
        some = topics.filter(F.pmod(F.xxhash64(key), F.lit(passes)) == p).select(key, *columns, vector).toPandas()
        matrix = np.stack(some[vector].to_numpy()) if len(some) else np.empty((0, 0))
        sent = sc.broadcast((some[[key, *columns]], matrix))

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            other, m = sent.value
            for batch in batches:
                for k in range(0, len(batch), ROWS_AT_ONCE):
                    b = batch.iloc[k : k + ROWS_AT_ONCE]
                    x = np.stack(b[vector].to_numpy())
                    for c in range(0, len(other), TOPICS_AT_ONCE):
                        yield fn(b[[key, *columns]], other.iloc[c : c + TOPICS_AT_ONCE], x @ m[c : c + TOPICS_AT_ONCE].T)

        found = topics.select(key, *columns, vector).mapInPandas(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def topic_similarity(rows: DataFrame, label: str, vector: str, dim: int) -> DataFrame:
    """One row: the mean and the largest cosine between the centroids of two topics.

    The mean follows from the length of the sum of all unit centroids; no pair is written down.
    """
    c = centroids(rows.filter(F.col(label) >= 0).select(label, unit(vector).alias("u")), [label], "u", dim)
    c = checkpointed(c.select(F.col(label).alias("l"), unit("centroid").alias("c")))

    def largest(b: pd.DataFrame, other: pd.DataFrame, s: np.ndarray) -> pd.DataFrame:
        s[b["l"].to_numpy()[:, None] == other["l"].to_numpy()] = -np.inf
        return pd.DataFrame({"s": [s.max(initial=-np.inf)]})

    top = against_all(c, "l", [], "c", largest, "s double").agg(F.max("s").alias("m"))
    parts = [F.sum(F.element_at("c", i + 1)) for i in range(dim)]
    total = c.agg(F.count(F.lit(1)).alias("k"), sum((p * p for p in parts[1:]), parts[0] * parts[0]).alias("t"), F.sum(dot("c", "c")).alias("own"))
    n = (F.col("k") * (F.col("k") - 1) / 2).cast("bigint")
    some = F.col("k") > 1
    return total.join(top).select(n.alias("n_pairs"), F.when(some, (F.col("t") - F.col("own")) / 2 / n).alias("mean_similarity"), F.when(some, F.col("m")).alias("max_similarity"))


def recluster_noise(rows: DataFrame, label: str, second: Column, least_count: int, least_ratio: float) -> DataFrame:
    """Noise rows with a second label behind the first ones, if there is enough noise.

    ``second`` gives a noise row's label within the noise (negative: still noise). Added are
    ``final_label`` and ``level``; ratios are over clusterable rows.
    """
    s = rows.filter(F.col(label) != MISSING).agg(F.count_if(F.col(label) == NOISE).alias("_noise"), F.count(F.lit(1)).alias("_all"), F.greatest(F.max(label), F.lit(-1)).alias("_top"))
    r = rows.join(F.broadcast(s))
    go = (F.col("_noise") >= least_count) & (F.col("_noise") >= least_ratio * F.col("_all"))
    again = (F.col(label) == NOISE) & go
    final = F.when(again & (second >= 0), F.col("_top") + 1 + second).otherwise(F.col(label))
    level = F.when(F.col(label) == MISSING, "missing_channel").when(F.col(label) >= 0, "primary").when(~again, "primary_noise").when(second >= 0, "noise_recluster").otherwise("residual_noise")
    return r.withColumn("final_label", final).withColumn("level", level).drop("_noise", "_all", "_top")
