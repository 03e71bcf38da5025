"""Nested requests and cards: groups with their relations, units in batches, evidence per control.

A request holds a bounded number of rows (a batch, a sample) or aggregates of its rows, so no group
is collected whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.operators.ordinal import numbered_id, rank_in_group, with_ordinal
from siftwork.operators.topics import diverse_sample


def ordered_list(order: list[str], fields: list[str]) -> Column:
    """An aggregate: the rows as an array of structs of ``fields``, in the order of ``order``."""
    rows = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*fields).alias("x"))))
    return F.transform(rows, lambda r: r["x"])


def group_requests(membership: DataFrame, group: str, member: str, relations: DataFrame, pair: str, a: str, b: str, fields: list[str], prefix: str) -> DataFrame:
    """Per group its sorted members and the relations between two of them, in the order of ``pair``.

    Groups are numbered in their order; a group without relations has an empty list. ``relations``
    holds the wanted ones only. Members and relations of a group are those of a clique.
    """
    m = membership.select(group, member).distinct()
    members = m.groupBy(group).agg(F.array_sort(F.collect_list(member)).alias("members"))
    left = m.select(F.col(group).alias("_g"), F.col(member).alias(a))
    right = m.select(F.col(group).alias("_g"), F.col(member).alias(b))
    inside = relations.join(left, a).join(right, ["_g", b]).groupBy(F.col("_g").alias(group)).agg(ordered_list([pair], [pair, a, b, *fields]).alias("relations"))
    both = members.join(inside, group, "left")
    return with_ordinal(both, [group], "_n").withColumn("request_id", numbered_id("_n", prefix, 4)).drop("_n")


def unit_requests(membership: DataFrame, control: str, topic: str, units: DataFrame, unit: str, fields: list[str], size: int, prefix: str) -> DataFrame:
    """Each control's distinct units in batches of ``size``, by unit; batches are numbered over all controls.

    A unit belongs to every control that has its topic. Units need a key of their own; a key that
    stands twice counts with its smallest row.
    """
    once = units.groupBy(unit).agg(F.min(F.struct(topic, *fields)).alias("_u")).select(unit, "_u.*")
    rows = membership.select(control, topic).distinct().join(once, topic)
    ranked = rank_in_group(rows, control, [unit], "_r").withColumn("_b", F.floor((F.col("_r") - 1) / size).cast("int"))
    batches = ranked.groupBy(control, "_b").agg(ordered_list([unit], [unit, topic, *fields]).alias("units"))
    return with_ordinal(batches, [control, "_b"], "_n").withColumn("request_id", numbered_id("_n", prefix)).drop("_n", "_b")


def evidence_requests(evidence: DataFrame, control: str, unit: str, mode: str, scene: str, objects: str, fields: list[str], samples: int) -> DataFrame:
    """Per control with evidence: its units, counts of modes, distinct scenes and objects, and a diverse sample.

    ``evidence`` holds supporting rows; a unit that stands twice under a control counts once. Modes
    come by name in ``mode_counts`` and by number of units in ``modes``. Sets are made distinct
    before they are collected.
    """
    e = evidence.groupBy(control, unit).agg(F.min(F.struct(mode, scene, objects, *fields)).alias("_e")).select(control, unit, "_e.*")
    sums = e.groupBy(control).agg(F.count(F.lit(1)).alias("n_units"))
    modes = e.groupBy(control, mode).agg(F.count(F.lit(1)).alias("_n")).groupBy(control)
    modes = modes.agg(ordered_list([mode], [mode, "_n"]).alias("mode_counts"), F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("o"), F.col(mode).alias("mode")))), lambda x: x["mode"]).alias("modes"))
    distinct = lambda value, to: e.select(control, value.alias("_v")).filter("trim(_v) <> ''").distinct().groupBy(control).agg(F.array_sort(F.collect_list("_v")).alias(to))
    scenes, things = distinct(F.col(scene), "scenes"), distinct(F.explode(objects), "objects")
    chosen = diverse_sample(e.select(control, unit, mode, scene, *fields), control, mode, unit, samples).groupBy(control).agg(ordered_list(["place"], [unit, mode, scene, *fields]).alias("samples"))
    out = sums.join(modes, control).join(scenes, control, "left").join(things, control, "left").join(chosen, control)
    none = F.array().cast("array<string>")
    return out.withColumns({c: F.coalesce(c, none) for c in ("scenes", "objects")})


def naming_requests(rows: DataFrame, by: list[str], rank: str, key: str, fields: list[str], most: int) -> DataFrame:
    """Per cluster its number of rows and its first ``most`` rows by rank and key, nested."""
    size = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"))
    place = F.struct(F.col(rank), F.col(key))
    first = rows.groupBy(*by).agg(F.slice(F.array_sort(F.collect_list(F.when(F.col(rank) <= most, F.struct(place.alias("o"), F.struct(key, rank, *fields).alias("x"))))), 1, most).alias("f"))
    return size.join(first, by).select(*by, "n_rows", F.transform("f", lambda r: r["x"]).alias("samples"))
