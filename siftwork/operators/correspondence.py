"""How two clusterings of the same rows correspond; all figures follow from the contingency counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwork.session import spread

def joined_labels(a: DataFrame, b: DataFrame, key: str, label_a: str, label_b: str, drop_sentinels: bool = True) -> DataFrame:
    """``a, b`` of the rows that both tables hold; noise and missing rows are dropped on request."""
    j = a.select(key, F.col(label_a).alias("a")).join(b.select(key, F.col(label_b).alias("b")), key)
    return j.filter((F.col("a") >= 0) & (F.col("b") >= 0)) if drop_sentinels else j


def contingency(pairs: DataFrame) -> DataFrame:
    """Non-zero cells with shares and dominance; ``pairs`` has the columns ``a`` and ``b``."""
    c = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    wa, wb = W.partitionBy("a"), W.partitionBy("b")
    c = c.withColumn("n_a", F.sum("n").over(wa)).withColumn("n_b", F.sum("n").over(wb)).withColumn("max_a", F.max("n").over(wa)).withColumn("max_b", F.max("n").over(wb))
    c = c.withColumn("dominant_a", F.col("n") == F.col("max_a")).withColumn("dominant_b", F.col("n") == F.col("max_b"))
    return c.select("a", "b", "n", "n_a", "n_b", (F.col("n") / F.col("n_a")).alias("share_a"), (F.col("n") / F.col("n_b")).alias("share_b"), "dominant_a", "dominant_b", (F.col("dominant_a") & F.col("dominant_b")).alias("mutual"), F.count_if("dominant_a").over(wa).alias("ties_a"), F.count_if("dominant_b").over(wb).alias("ties_b"))


def dominance_summary(cells: DataFrame) -> DataFrame:
    """One row: dominant records and pairs on either side, mutual ones, and clusters with ties."""
    single_a = F.col("dominant_a") & (F.col("b") == F.min(F.when(F.col("dominant_a"), F.col("b"))).over(W.partitionBy("a")))
    c = cells.withColumn("single_a", single_a)
    return c.agg(F.sum("n").alias("n_records"), F.countDistinct("a").alias("n_a_clusters"), F.countDistinct("b").alias("n_b_clusters"), F.sum(F.when(F.col("single_a"), F.col("n")).otherwise(0)).alias("dominant_records"), F.count_if("mutual").alias("mutual_pairs"), F.sum(F.when(F.col("mutual"), F.col("n")).otherwise(0)).alias("mutual_records"), F.countDistinct(F.when(F.col("ties_a") > 1, F.col("a"))).alias("tied_a"), F.countDistinct(F.when(F.col("ties_b") > 1, F.col("b"))).alias("tied_b"))


def profiles(cells: DataFrame) -> DataFrame:
    """Per cluster of ``a``: observed partners, the dominant one (lowest on a tie), its share and the normalised entropy."""
    best = F.min_by("b", F.struct(-F.col("n"), F.col("b")))
    k = F.count(F.lit(1))
    h = -F.sum(F.col("share_a") * F.ln("share_a"))
    return cells.groupBy("a").agg(F.sum("n").alias("n"), k.alias("n_partners"), best.alias("dominant"), F.max("share_a").alias("dominant_share"), F.when(k > 1, h / F.ln(k.cast("double"))).otherwise(0.0).alias("normalized_entropy"))


def agreement(cells: DataFrame, adjusted: bool = False) -> DataFrame:
    """One row: entropies, mutual information, V-measure, NMI (arithmetic), ARI and, with ``adjusted``, AMI.

    The expected mutual information of AMI depends on the marginals only, so it is summed over
    distinct pairs of marginal sizes, each weighted by how many pairs of clusters have them. There
    are at most as many sizes as the root of twice the number of rows.
    """
    total = cells.agg(F.sum("n").alias("n_all"))
    a = cells.groupBy("a").agg(F.sum("n").alias("n"))
    b = cells.groupBy("b").agg(F.sum("n").alias("n"))
    pair = lambda x: F.sum(F.col(x).cast("double") * (F.col(x) - 1) / 2)

    def side(x: DataFrame, name: str) -> DataFrame:
        p = F.col("n") / F.col("n_all")
        return x.crossJoin(total).agg((-F.sum(p * F.ln(p))).alias(f"h_{name}"), pair("n").alias(f"pairs_{name}"))

    p, q = F.col("n") / F.col("n_all"), F.col("n_a").cast("double") * F.col("n_b")
    mi = cells.crossJoin(total).agg(F.sum(p * F.ln(F.col("n") * F.col("n_all") / q)).alias("mi"), pair("n").alias("pairs"), F.max("n_all").alias("n_all"))
    r = mi.crossJoin(side(a, "a")).crossJoin(side(b, "b"))
    mean_h, ami = (F.col("h_a") + F.col("h_b")) / 2, []
    if adjusted:
        sizes = lambda x, s: x.groupBy(F.col("n").alias(f"s{s}")).agg(F.count(F.lit(1)).alias(f"k{s}"))
        grid = spread(sizes(a, "a").join(sizes(b, "b")).crossJoin(total))
        r = r.crossJoin(grid.mapInPandas(_expected, "emi double").agg(F.sum("emi").alias("emi")))
        ami = [F.coalesce(F.try_divide(F.col("mi") - F.col("emi"), mean_h - F.col("emi")), F.lit(1.0)).alias("ami")]
    all_pairs = F.col("n_all") * (F.col("n_all") - 1) / 2
    expected = F.col("pairs_a") * F.col("pairs_b") / all_pairs
    hom = F.when(F.col("h_a") > 0, F.col("mi") / F.col("h_a")).otherwise(1.0)
    com = F.when(F.col("h_b") > 0, F.col("mi") / F.col("h_b")).otherwise(1.0)
    return r.select(F.col("n_all").alias("n_records"), "h_a", "h_b", "mi", hom.alias("homogeneity"), com.alias("completeness"), F.coalesce(F.try_divide(2 * hom * com, hom + com), F.lit(0.0)).alias("v_measure"), F.coalesce(F.try_divide(F.col("mi"), mean_h), F.lit(1.0)).alias("nmi"), F.coalesce(F.try_divide(F.col("pairs") - expected, (F.col("pairs_a") + F.col("pairs_b")) / 2 - expected), F.lit(1.0)).alias("ari"), *ami)


#: Terms of the expected mutual information that a task holds at once.
TERMS = 1_000_000


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function from 1 on, by Stirling's series seven steps further up."""
    up = np.zeros_like(x)
    for k in range(7):
        up += np.log(x + k)
    z = x + 7
    i = 1 / (z * z)
    series = (1 / 12 - i * (1 / 360 - i * (1 / 1260 - i * (1 / 1680 - i / 1188)))) / z
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + series - up


def _expected(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Expected mutual information of pairs of marginal sizes under random labels."""
    g = lambda v: float(log_gamma(np.array([v], float))[0])
    for f in frames:
        out = 0.0
        for s, k, t, m, n in zip(f["sa"], f["ka"], f["sb"], f["kb"], f["n_all"], strict=True):
            fixed = g(s + 1) + g(t + 1) + g(n - s + 1) + g(n - t + 1) - g(n + 1)
            for low in range(max(1, s + t - n), min(s, t) + 1, TERMS):
                x = np.arange(low, min(low + TERMS, min(s, t) + 1), dtype=float)
                log_p = fixed - log_gamma(x + 1) - log_gamma(s - x + 1) - log_gamma(t - x + 1) - log_gamma(n - s - t + x + 1)
                out += k * m * float((x / n * np.log(n * x / (float(s) * t)) * np.exp(log_p)).sum())
        yield pd.DataFrame({"emi": [out]})


def inherited(parents: DataFrame, units: DataFrame, parent_id: str, label_p: str, label_u: str) -> DataFrame:
    """``a, b`` of units with their parent's label; units without a parent row get a null ``a``."""
    p = parents.select(F.col(parent_id), F.col(label_p).alias("a"))
    return units.select(parent_id, F.col(label_u).alias("b")).join(p, parent_id, "left").select("a", "b")


def parent_profiles(path: DataFrame, parent: str, valid: str) -> DataFrame:
    """Per non-noise parent: its units, those with a valid target, and their share."""
    n, v = F.count(F.lit(1)), F.count_if(F.col(valid))
    return path.filter(F.col(parent) >= 0).groupBy(parent).agg(n.alias("n_units"), v.alias("n_targets"), (v / n).alias("coverage"))


def threshold_grid(p: DataFrame, parent_min: list[int], target_min: list[int]) -> DataFrame:
    """Eligible parents and units for every pair of thresholds, in one aggregate over the profiles."""
    both = [(x, y) for x in parent_min for y in target_min]
    rows = F.explode(F.array(*[F.struct(F.lit(x).alias("parent_min"), F.lit(y).alias("target_min")) for x, y in both]))
    g = p.withColumn("t", rows)
    ok = (F.col("n_units") >= F.col("t.parent_min")) & (F.col("n_targets") >= F.col("t.target_min"))
    s = g.groupBy("t.parent_min", "t.target_min").agg(F.count_if(ok).alias("n_eligible"), F.sum(F.when(ok, F.col("n_units")).otherwise(0)).alias("eligible_units"), F.sum(F.when(ok, F.col("n_targets")).otherwise(0)).alias("eligible_targets"), F.sum("n_units").alias("all_units"))
    return s.withColumn("unit_share", F.try_divide("eligible_units", "all_units"))


def local_summary(results: DataFrame, children: str, weight: str, value: str) -> DataFrame:
    """One row: totals, share of parents with several children, quartiles and a weighted mean."""
    n = F.count(F.lit(1))
    q = lambda p: F.percentile(children, F.lit(p))
    return results.agg(n.alias("n_parents"), F.sum(children).alias("n_children"), (F.count_if(F.col(children) >= 2) / n).alias("multi_child_share"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"), F.try_divide(F.sum(F.col(weight) * F.col(value)), F.sum(F.when(F.col(value).isNotNull(), F.col(weight)))).alias("weighted_value"))
