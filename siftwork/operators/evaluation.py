"""Extracted units against reference units: matching, hits, field scores and comparisons."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.functions import text as T
from siftwork.operators.ordinal import rank_in_group

#: Pairs of equal units that come out of one row of the matching of kinds.
STRETCH = 10_000


def unit_key(finding: str = "finding", objects: str = "objects", scene: str = "scene") -> Column:
    """Normalised finding, sorted distinct objects and normalised scene as one text."""
    return F.concat_ws("\u001f", T.compact_text(finding), F.array_join(F.array_sort(F.array_distinct(objects)), "\u001e"), T.compact_text(scene))


def char_f1(a: Column | str, b: Column | str) -> Column:
    """F1 of the bags of characters; both empty gives 1, one empty 0."""
    x, y = F.split(a, ""), F.split(b, "")
    count = lambda chars, c: F.size(F.filter(chars, lambda z: z == c))
    shared = F.aggregate(F.array_distinct(x), F.lit(0), lambda s, c: s + F.least(count(x, c), count(y, c)))
    la, lb = F.length(a), F.length(b)
    return F.when((la == 0) & (lb == 0), 1.0).when((la == 0) | (lb == 0), 0.0).otherwise(2.0 * shared / (la + lb))


def set_f1(a: Column | str, b: Column | str) -> Column:
    """F1 of two sets; both empty gives 1, one empty 0."""
    na, nb = F.size(F.array_distinct(a)), F.size(F.array_distinct(b))
    shared = F.size(F.array_intersect(a, b))
    return F.when((na == 0) & (nb == 0), 1.0).when((na == 0) | (nb == 0), 0.0).otherwise(2.0 * shared / (na + nb))


def prf(tp: Column, n_pred: Column, n_gold: Column) -> dict[str, Column]:
    p, r = F.coalesce(F.try_divide(tp, n_pred), F.lit(0.0)), F.coalesce(F.try_divide(tp, n_gold), F.lit(0.0))
    return {"precision": p, "recall": r, "f1": F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))}


def ranked_units(df: DataFrame, record: str, unit: str) -> DataFrame:
    """``record, unit, _k, _r``: the kind of every unit (equal units of a record) and its place in it."""
    keyed = df.select(record, unit, F.sha1(F.concat_ws("\u001d", record, unit_key())).alias("_k"))
    return rank_in_group(keyed, "_k", [unit], "_r")


def _exact(p: DataFrame, g: DataFrame, record: str, unit: str) -> DataFrame:
    left = p.select("_k", "_r", record, F.col(unit).alias("unit_p"))
    return left.join(g.select("_k", "_r", F.col(unit).alias("unit_g")), ["_k", "_r"])


def exact_matches(pred: DataFrame, gold: DataFrame, record: str, unit: str) -> DataFrame:
    """``record, unit_p, unit_g`` of units with equal keys, each used once, the first with the first."""
    return _exact(ranked_units(pred, record, unit), ranked_units(gold, record, unit), record, unit).select(record, "unit_p", "unit_g")


def transport(sim: np.ndarray, supply: np.ndarray, demand: np.ndarray) -> list[tuple[int, int, int]]:
    """Row, column and amount with the largest sum of similarities, by shortest augmenting paths.

    The side with less in all is used up. Each path carries as much as its narrowest step holds.
    """
    turned = sum(supply) > sum(demand)
    cost = -(sim.T if turned else sim)
    a, b = (list(map(int, x)) for x in ((demand, supply) if turned else (supply, demand)))
    n, m = cost.shape
    u, v, flow = cost.min(axis=1), np.zeros(m), [{} for _ in range(m)]
    for i in range(n):
        while a[i]:
            dist, way, done = np.full(m, np.inf), np.zeros(m, int), np.zeros(m, bool)
            at, came, fresh, low = {i: 0.0}, {}, [i], 0.0
            while True:
                for row in fresh:
                    reached = low + cost[row] - u[row] - v
                    better = ~done & (reached < dist)
                    dist[better], way[better] = reached[better], row
                j = int(np.argmin(np.where(done, np.inf, dist)))
                low = dist[j]
                done[j] = True
                if b[j]:
                    break
                fresh = [row for row in flow[j] if row not in at]
                at.update(dict.fromkeys(fresh, low))
                came.update(dict.fromkeys(fresh, j))
            for row, d in at.items():
                u[row] += low - d
            v[done] -= low - dist[done]
            steps = [(int(way[j]), j)]
            while steps[-1][0] != i:
                back = came[steps[-1][0]]
                steps.append((int(way[back]), back))
            much = min(a[i], b[j], *[flow[came[row]][row] for row, _ in steps[:-1]])
            for row, col in steps:
                flow[col][row] = flow[col].get(row, 0) + much
                if row != i:
                    flow[came[row]][row] -= much
                    if not flow[came[row]][row]:
                        del flow[came[row]][row]
            a[i], b[j] = a[i] - much, b[j] - much
    moved = [(row, col, much) for col in range(m) for row, much in flow[col].items()]
    return [(y, x, much) for x, y, much in moved] if turned else moved


def assignment(sim: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows and columns with the largest sum of similarities."""
    return [(i, j) for i, j, _ in transport(sim, np.ones(sim.shape[0]), np.ones(sim.shape[1]))]


def _f1s(a: list[Counter], b: list[Counter]) -> tuple[np.ndarray, np.ndarray]:
    """F1 of all pairs of bags, 0 where it is not defined, and where it is: not both empty."""
    shared, where = np.zeros((len(a), len(b)), int), {}
    for side, bags in enumerate((a, b)):
        for i, bag in enumerate(bags):
            for x, n in bag.items():
                where.setdefault(x, ([], []))[side].append((i, n))
    for left, right in where.values():
        if left and right:
            (i, x), (j, y) = np.array(left).T, np.array(right).T
            shared[np.ix_(i, j)] += np.minimum.outer(x, y)
    sizes = np.add.outer([x.total() for x in a], [x.total() for x in b])
    return 2 * shared / np.maximum(sizes, 1), sizes > 0


def similarities(p: list[dict], g: list[dict]) -> np.ndarray:
    """The mean of the field scores that are defined: characters of finding and scene, set of objects."""
    total = defined = 0
    for f, bag in (("finding", Counter), ("scene", Counter), ("objects", lambda x: Counter(set(x)))):
        score, there = _f1s([bag(x[f]) for x in p], [bag(x[f]) for x in g])
        total, defined = total + score, defined + there
    return total / np.maximum(defined, 1)


def match_units(pred: DataFrame, gold: DataFrame, record: str, unit: str) -> DataFrame:
    """``record, unit_p, unit_g, exact``: exact pairs first, then the best assignment of the rest.

    The rest is matched within a record, whatever its size, as counted kinds of equal units: a
    task holds the similarities of a record's kinds, not of its units. Units take their places
    within the amount that passes from kind to kind.
    """
    p, g = ranked_units(pred, record, unit), ranked_units(gold, record, unit)
    exact = _exact(p, g, record, unit)
    used = exact.groupBy("_k").agg(F.max("_r").alias("_x"))
    rest, kinds = {}, {}
    for ranked, df, s in ((p, pred, "p"), (g, gold, "g")):
        left = ranked.join(used, "_k", "left").withColumn("_r", F.col("_r") - F.coalesce("_x", F.lit(0))).filter("_r > 0")
        rest[s] = left.select(F.col("_k").alias(f"_k{s}"), F.col("_r").alias(f"_r{s}"), F.col(unit).alias(f"unit_{s}"), *([record] if s == "p" else []))
        size = left.groupBy(record, "_k").agg(F.max("_r").alias("_n"), F.min_by(unit, "_r").alias(unit))
        text = df.select(record, unit, T.compact_text("finding").alias("finding"), T.compact_text("scene").alias("scene"), "objects")
        kind = F.struct(unit, "_k", "_n", "finding", "scene", "objects")
        kinds[s] = text.join(size, [record, unit]).groupBy(record).agg(F.array_sort(F.collect_list(kind)).alias(s))
    moves = pa.schema([("_kp", pa.string()), ("_kg", pa.string()), ("_p", pa.int64()), ("_g", pa.int64()), ("_n", pa.int64())])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                p, g = r["p"], r["g"]
                n_p, n_g = ([x["_n"] for x in side] for side in (p, g))
                at_p, at_g = [0] * len(p), [0] * len(g)
                best = [(0, 0, min(n_p[0], n_g[0]))] if len(p) == len(g) == 1 else sorted(transport(similarities(p, g), n_p, n_g))
                for i, j, much in best:
                    for k in range(0, much, STRETCH):
                        out.append((p[i]["_k"], g[j]["_k"], at_p[i] + k, at_g[j] + k, min(STRETCH, much - k)))
                    at_p[i], at_g[j] = at_p[i] + much, at_g[j] + much
            yield pa.RecordBatch.from_pylist([dict(zip(moves.names, x, strict=True)) for x in out], schema=moves)

    moved = kinds["p"].join(kinds["g"], record).select("p", "g").mapInArrow(solve, "_kp string, _kg string, _p bigint, _g bigint, _n bigint")
    each = moved.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
    each = each.select("_kp", "_kg", (F.col("_p") + F.col("_i")).cast("int").alias("_rp"), (F.col("_g") + F.col("_i")).cast("int").alias("_rg"))
    best = each.join(rest["p"], ["_kp", "_rp"]).join(rest["g"], ["_kg", "_rg"])
    pair = [record, "unit_p", "unit_g"]
    return exact.select(*pair, F.lit(True).alias("exact")).unionByName(best.select(*pair, F.lit(False).alias("exact")))


def scored_pairs(matches: DataFrame, pred: DataFrame, gold: DataFrame, record: str, unit: str) -> DataFrame:
    """Matched pairs with their field scores; a text field blank on both sides has none."""
    side = {s: df.select(record, F.col(unit).alias(f"unit_{s}"), T.compact_text("finding").alias(f"f{s}"), T.compact_text("scene").alias(f"s{s}"), F.col("objects").alias(f"o{s}")) for s, df in (("p", pred), ("g", gold))}
    m = matches.join(side["p"], [record, "unit_p"]).join(side["g"], [record, "unit_g"])
    text = lambda a, b: F.when((F.col(a) != "") | (F.col(b) != ""), char_f1(a, b))
    obj = F.when((F.size("op") > 0) | (F.size("og") > 0), set_f1("op", "og"))
    kind = lambda a, b: F.when((F.col(a) == "") & (F.col(b) == ""), "both_empty").when(F.col(a) == "", "omission").when(F.col(b) == "", "overextraction").otherwise("both_present")
    return m.select(record, "unit_p", "unit_g", "exact", text("fp", "fg").alias("finding_f1"), text("sp", "sg").alias("scene_f1"), obj.alias("object_f1"), (F.col("fp") == F.col("fg")).alias("finding_exact"), (F.col("sp") == F.col("sg")).alias("scene_exact"), kind("fp", "fg").alias("finding_case"), kind("sp", "sg").alias("scene_case"))


def field_means() -> list[Column]:
    return [F.avg(f"{f}_f1").alias(f"mean_{f}_f1") for f in ("finding", "scene", "object")]


def summary(pred: DataFrame, gold: DataFrame, scored: DataFrame, system: str) -> DataFrame:
    """One row per system: complete hits with precision, recall and F1, and mean field scores over the pairs."""
    n = pred.groupBy(system).agg(F.count(F.lit(1)).alias("n_pred")).join(gold.agg(F.count(F.lit(1)).alias("n_gold")))
    cases = [F.count_if(F.col("scene_case") == c).alias(f"scene_{c}s") for c in ("omission", "overextraction")]
    hit = scored.groupBy(system).agg(F.count_if("exact").alias("n_hits"), F.count(F.lit(1)).alias("n_pairs"), *field_means(), *cases)
    r = n.join(hit, system, "left").fillna(0, ["n_hits", "n_pairs", "scene_omissions", "scene_overextractions"])
    return r.select("*", *[c.alias(k) for k, c in prf(F.col("n_hits"), F.col("n_pred"), F.col("n_gold")).items()])


def common_summary(scored: DataFrame, systems: DataFrame, system: str, unit: str) -> DataFrame:
    """Mean field scores per system over the reference units that every system matched."""
    every = scored.groupBy(unit).agg(F.countDistinct(system).alias("_s")).join(systems.agg(F.count(F.lit(1)).alias("_n"))).filter("_s = _n")
    means = scored.join(every.select(unit), unit, "left_semi").groupBy(system).agg(F.count(F.lit(1)).alias("n_common"), *field_means())
    return systems.join(means, system, "left").fillna(0, ["n_common"])


TEXT_FIELDS = ("finding", "scene", "loc_detail", "risk_scene")


def paired_fields(matches: DataFrame, pred: DataFrame, gold: DataFrame, record: str, unit: str, keep: list[str] = [], fields: tuple[str, ...] = TEXT_FIELDS) -> DataFrame:  # noqa: B006
    """Matched pairs with their compact text fields (``finding_p``, ``finding_g`` and so on) and objects of both sides."""
    both = matches
    for s, df in (("p", pred), ("g", gold)):
        own = [T.compact_text(f).alias(f"{f}_{s}") for f in fields if f in df.columns] + [F.lit("").alias(f"{f}_{s}") for f in fields if f not in df.columns]
        extra = [k for k in keep if s == "p"]
        both = both.join(df.select(record, F.col(unit).alias(f"unit_{s}"), F.col("objects").alias(f"objects_{s}"), *own, *extra), [record, f"unit_{s}"])
    return both


def match_summary(pairs: DataFrame, record: str, fields: tuple[str, ...] = TEXT_FIELDS) -> DataFrame:
    """One row per matched pair with the scores of all fields and their mean over those that are defined."""
    scores = {f: char_f1(f"{f}_p", f"{f}_g") for f in fields} | {"object": set_f1("objects_p", "objects_g")}
    there = {f: (F.col(f"{f}_p") != "") | (F.col(f"{f}_g") != "") for f in ("finding", "scene")} | {"object": (F.size("objects_p") > 0) | (F.size("objects_g") > 0)}
    total = sum((F.when(c, scores[f]).otherwise(0.0) for f, c in there.items()), F.lit(0.0))
    mean = F.coalesce(F.try_divide(total, sum((c.cast("int") for c in there.values()), F.lit(0))), F.lit(0.0))
    return pairs.select(record, "unit_p", "unit_g", "exact", mean.alias("pairing_score"), *[c.alias(f"{f}_f1") for f, c in scores.items()])


def field_summary(pairs: DataFrame, system: str, fields: tuple[str, ...] = TEXT_FIELDS) -> DataFrame:
    """Per system and field: mean F1 and share of equal values over pairs where either side has one, and the cases.

    Cases are ``omission`` (only the reference has a value), ``over_extraction`` (only the
    prediction), ``both_empty`` and ``both_present``.
    """
    row = lambda f, score, same, p, g: F.struct(F.lit(f).alias("field"), score.alias("score"), same.alias("same"), p.alias("p"), g.alias("g"))
    each = [row(f, char_f1(f"{f}_p", f"{f}_g"), F.col(f"{f}_p") == F.col(f"{f}_g"), F.col(f"{f}_p") != "", F.col(f"{f}_g") != "") for f in fields]
    sets = [F.array_sort(F.array_distinct(f"objects_{s}")) for s in "pg"]
    each.append(row("object", set_f1("objects_p", "objects_g"), sets[0] == sets[1], F.size("objects_p") > 0, F.size("objects_g") > 0))
    x = pairs.select(system, F.explode(F.array(*each)).alias("x")).select(system, "x.*")
    some = F.col("p") | F.col("g")
    cases = {"omission": ~F.col("p") & F.col("g"), "over_extraction": F.col("p") & ~F.col("g"), "both_empty": ~some, "both_present": F.col("p") & F.col("g")}
    mean = lambda c: F.coalesce(F.avg(F.when(some, c)), F.lit(0.0))
    return x.groupBy(system, "field").agg(mean(F.col("score")).alias("f1"), mean(F.col("same").cast("double")).alias("exact_match_rate"), F.count_if(some).alias("evaluated_count"), *[F.count_if(c).alias(k) for k, c in cases.items()])


def tall_summary(summary: DataFrame, system: str, metrics: list[str]) -> DataFrame:
    """``system, place, metric, value``: one row per metric in the given order."""
    each = F.posexplode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("place", "x")
    return summary.select(system, each).select(system, "place", "x.metric", "x.value")


def complete_hits(pred: DataFrame, gold: DataFrame, record: str, unit: str, system: str) -> DataFrame:
    """Per system: units, complete hits, precision, recall and F1, each against all reference units."""
    key = F.to_json(F.struct(system, record))
    systems = pred.select(system).distinct()
    each = pred.select(system, record).distinct().join(gold, record)
    hits = exact_matches(pred.withColumn("_key", key), each.withColumn("_key", key), "_key", unit)
    n = hits.groupBy(F.get_json_object("_key", f"$.{system}").alias(system)).agg(F.count(F.lit(1)).alias("n_hits"))
    counts = systems.join(pred.groupBy(system).agg(F.count(F.lit(1)).alias("n_pred")), system).join(n, system, "left").fillna(0, ["n_hits"])
    r = counts.join(gold.agg(F.count(F.lit(1)).alias("n_gold")))
    return r.select("*", *[c.alias(k) for k, c in prf(F.col("n_hits"), F.col("n_pred"), F.col("n_gold")).items()])


# Where the fields of a record may stand in a table of another make.
ALIASES = {
    "record_id": ["record_id", "gold_record_id", "id"], "gold_record_id": ["gold_record_id", "record_id", "id"], "raw_record_id": ["raw_record_id", "raw_id", "source_id"], "raw_text": ["raw_text", "text"],
    "finding": ["finding", "phenomenon_label"], "scene": ["scene", "scene_label"], "loc_detail": ["loc_detail", "location_label"], "risk_scene": ["risk_scene"],
}


def extraction_records(df: DataFrame, minimal: bool = False) -> DataFrame:
    """Any table of units as records of fixed columns: the first of a field's columns that has a text, and parsed objects.

    A table whose objects are an array already keeps them; ``minimal`` leaves out the raw text.
    """
    kinds = dict(df.dtypes)
    texts = {f: T.first_text(*[c for c in names if c in kinds]) for f, names in ALIASES.items() if not (minimal and f == "raw_text")}
    name = next((c for c in ("object", "object_json", "object_label") if c in kinds), None)
    objects = F.array().cast("array<string>") if name is None else F.coalesce(name, F.array().cast("array<string>")) if kinds[name].startswith("array") else T.parse_objects(name)
    return df.select(*[c.alias(f) for f, c in texts.items()], objects.alias("object"))
