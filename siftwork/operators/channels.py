"""Text channels of units, and the bookkeeping of their clusterings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.functions import text as T

# The channels and their fields; labels of noise and of blank channel texts.
CHANNELS = {"T1": ["finding"], "T2": ["object"], "T3": ["risk_scene"], "T4": ["loc_detail"], "T5": ["object", "finding"], "T6": ["risk_scene", "finding"], "T7": ["risk_scene", "object"], "T8": ["risk_scene", "object", "finding"]}
NOISE, MISSING = -1, -2


def channel_inputs(units: DataFrame, channels: dict[str, list[str]] = CHANNELS, key: str = "record_id") -> DataFrame:
    """``experiment_id, record_id, input_text``: one row per unit and channel, in one pass."""
    each = [F.struct(F.lit(e).alias("experiment_id"), T.channel_text({f: f for f in fields}).alias("input_text")) for e, fields in channels.items()]
    return units.select(F.col(key).alias("record_id"), F.explode(F.array(*each)).alias("x")).select("x.experiment_id", "record_id", "x.input_text")


def baseline_inputs(records: DataFrame, key: str, text: str) -> DataFrame:
    return records.select(F.lit("B1").alias("experiment_id"), F.col(key).alias("record_id"), F.coalesce(F.col(text), F.lit("")).alias("input_text"))


def provider_inputs(units: DataFrame, definitions: dict[str, list[str]], provider: str, key: str = "record_id") -> DataFrame:
    """Channel rows per provider: ``<experiment>-<provider>``."""
    out = channel_inputs(units.withColumn(key, F.struct(key, provider)), definitions, key)
    return out.select(F.concat_ws("-", "experiment_id", f"record_id.{provider}").alias("experiment_id"), F.col(f"record_id.{key}").alias("record_id"), "input_text")


# Experiments without a vote, a channel for each provider, and those over the voted units.
SINGLE = {"A1-F": ["finding"], "A1-O": ["object"], "A1-R": ["scene"]}
VOTED = {"A2-F": ["finding"], "A2-O": ["object"], "A2-R": ["risk_scene"], "A3-R": ["loc_detail", "risk_scene"], "A4-R": ["risk_scene"]}


def ablation_inputs(voted: DataFrame, single: DataFrame, provider: str) -> DataFrame:
    """Channel rows of all experiments that compare voted units with those of each provider alone."""
    return channel_inputs(voted, VOTED).unionByName(provider_inputs(single, SINGLE, provider))


def select_experiments(inputs: DataFrame, wanted: list[str]) -> DataFrame:
    """Rows of the wanted experiments with their place in the list."""
    place = F.array_position(F.array(*[F.lit(w) for w in wanted]), F.col("experiment_id"))
    return inputs.withColumn("place", place).filter("place > 0")


def composition(units: DataFrame, fields: list[str]) -> DataFrame:
    """``pattern, n, is_complete``: how many units have which of the fields; units with none are left out."""
    have = F.array_join(F.array_compact(F.array(*[F.when(T.channel_text({f: f}) != "", F.lit(f)) for f in fields])), "+")
    return units.groupBy(have.alias("pattern")).agg(F.count(F.lit(1)).alias("n")).filter("pattern <> ''").withColumn("is_complete", F.col("pattern") == "+".join(fields))


def label_or_missing(text: Column | str, label: Column | str) -> Column:
    return F.when(T.normalize_text(text) == "", MISSING).otherwise(T.col(label))


def coverage(assignments: DataFrame, by: str, label: str, parent: str) -> DataFrame:
    """Ratios over all rows including missing ones, and how many parents have a clustered unit."""
    n, noise, missing = F.count(F.lit(1)), F.count_if(F.col(label) == NOISE), F.count_if(F.col(label) == MISSING)
    covered = F.countDistinct(F.when(F.col(label) != MISSING, F.col(parent)))
    return assignments.groupBy(by).agg(n.alias("n_rows"), (n - missing).alias("n_clusterable"), missing.alias("n_missing"), (missing / n).alias("missing_ratio"), (noise / n).alias("noise_ratio"), F.countDistinct(F.when(F.col(label) >= 0, F.col(label))).alias("n_clusters"), F.countDistinct(parent).alias("n_parents"), covered.alias("n_covered_parents"), (covered / F.countDistinct(parent)).alias("parent_coverage"))


def channel_metadata(assignments: DataFrame, by: str, label: str, channels: list[str]) -> DataFrame:
    """Per channel: clustered rows, topics, noise and its share; a channel with nothing to cluster has zeros."""
    live = assignments.filter(F.col(label) != MISSING)
    n, noise = F.count(F.lit(1)), F.count_if(F.col(label) == NOISE)
    have = live.groupBy(by).agg(n.alias("record_count"), F.countDistinct(F.when(F.col(label) >= 0, F.col(label))).alias("cluster_count"), noise.alias("noise_count"), (noise / n).alias("noise_ratio"))
    every = assignments.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, channels))).alias(by))
    return every.join(have, by, "left").fillna(0)


def recluster_options(given: dict, override: dict | None = None) -> dict:
    """Options of the second clustering of noise: defaults, what the configuration gives, and what a call overrides."""
    return {"least_count": 100, "least_ratio": 0.1} | given | (override or {})


def field_values(rows: DataFrame, by: str, fields: list[str]) -> DataFrame:
    """``by, field, value, n``: every value that a cluster's rows hold in the fields, arrays taken apart, and how often."""
    kinds = dict(rows.dtypes)
    each = [F.struct(F.lit(f).alias("field"), (F.col(f) if kinds[f].startswith("array") else F.array(f)).alias("values")) for f in fields]
    x = rows.select(by, F.explode(F.array(*each)).alias("x")).select(by, "x.field", F.explode("x.values").alias("value")).filter("value <> ''")
    return x.groupBy(by, "field", "value").agg(F.count(F.lit(1)).alias("n"))
