"""Extraction scores over the given tables: a model's answers against the structured records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwork.functions import text as T
from siftwork.operators import evaluation as E
from siftwork.plans.clusters import round_all
from siftwork.plans.records import MODELS, c_, objects_
from siftwork.session import checkpointed, table


def gold(spark, d) -> DataFrame:
    s = table(spark, d, "structured_records")
    return s.select("raw_record_id", F.col("record_id").alias("unit"), "finding", T.parse_objects("object").alias("objects"), "scene")


def predictions(spark, d) -> DataFrame:
    """All models' candidates of records that have reference units, each once."""
    c = table(spark, d, "extraction_candidates").groupBy("candidate_id", "source_model", "raw_record_id", "finding", "object", "scene").agg(F.count(F.lit(1)).alias("n"))
    scope = table(spark, d, "structured_records").select("raw_record_id").distinct()
    return c.join(scope, "raw_record_id", "left_semi").select("source_model", "raw_record_id", F.col("candidate_id").alias("unit"), "finding", T.parse_objects("object").alias("objects"), "scene")


def exact_unit_match(spark, d):
    p = predictions(spark, d).filter(F.col("source_model") == "lm-aster")
    return E.exact_matches(p, gold(spark, d), "raw_record_id", "unit")


def field_scores(spark, d):
    """Character and set F1 of every candidate against its record's first unit."""
    g = gold(spark, d).groupBy("raw_record_id").agg(F.min_by(F.struct("finding", "objects"), "unit").alias("g"))
    p = predictions(spark, d).join(g, "raw_record_id")
    return round_all(p.select("unit", E.char_f1(T.compact_text("finding"), T.compact_text("g.finding")).alias("char_f1"), E.set_f1("objects", "g.objects").alias("set_f1")).distinct())


def _by_system(spark, d):
    """Predictions, references of the records that a model answered, and their pairs, a record for each model."""
    key = F.concat_ws("|", "source_model", "raw_record_id").alias("key")
    p, g = predictions(spark, d), gold(spark, d)
    asked = p.select("source_model", "raw_record_id").distinct()
    p, g = p.select("*", key), g.join(asked, "raw_record_id").select("*", key)
    scored = E.scored_pairs(E.match_units(p, g, "key", "unit"), p, g, "key", "unit")
    return p, scored.withColumn("source_model", F.substring_index("key", "|", 1))


def extraction_eval(spark, d):
    p, scored = _by_system(spark, d)
    return round_all(E.summary(p, gold(spark, d), scored, "source_model"))


def common_matches(spark, d):
    """Field scores of each model over the reference units that all models matched."""
    p, scored = _by_system(spark, d)
    return round_all(E.common_summary(checkpointed(scored), p.select("source_model").distinct(), "source_model", "unit_g"))


def exact_unit_match_all(spark, d):
    p, g = predictions(spark, d), gold(spark, d)
    key = F.concat_ws("|", "source_model", "raw_record_id").alias("key")
    each = g.join(p.select("source_model", "raw_record_id").distinct(), "raw_record_id")
    hits = E.exact_matches(p.select("*", key), each.select("*", key), "key", "unit")
    return hits.select(F.substring_index("key", "|", 1).alias("source_model"), F.expr("substr(key, instr(key, '|') + 1)").alias("raw_record_id"), "unit_p", "unit_g")


def system_comparison(spark, d):
    """Complete hits, precision, recall and F1 of each model."""
    p, g = predictions(spark, d), gold(spark, d)
    tagged = p.withColumn("raw_record_id", F.concat_ws("|", "source_model", "raw_record_id"))
    models = F.explode(F.array(*[F.lit(m) for m in MODELS]))
    gold_each = g.withColumn("m", models).withColumn("raw_record_id", F.concat_ws("|", "m", "raw_record_id"))
    hits = E.exact_matches(tagged, gold_each, "raw_record_id", "unit").groupBy(F.substring_index("raw_record_id", "|", 1).alias("source_model")).agg(F.count(F.lit(1)).alias("n_hits"))
    n_gold = g.agg(F.count(F.lit(1)).alias("n_gold"))
    s = p.groupBy("source_model").agg(F.count(F.lit(1)).alias("n_pred")).join(hits, "source_model", "left").fillna(0, ["n_hits"]).join(n_gold)
    return round_all(s.select("*", *[c.alias(k) for k, c in E.prf(F.col("n_hits"), F.col("n_pred"), F.col("n_gold")).items()]))


def shared_units(spark, d):
    """Reference findings that how many models gave literally."""
    p = predictions(spark, d).select("source_model", "raw_record_id", T.compact_text("finding").alias("f")).distinct()
    g = gold(spark, d).select("raw_record_id", "unit", T.compact_text("finding").alias("f")).filter("f <> ''")
    n = g.join(p, ["raw_record_id", "f"], "left").groupBy("unit").agg(F.countDistinct("source_model").alias("n_models"))
    return n.groupBy("n_models").agg(F.count(F.lit(1)).alias("n_units"))


def last_answers(spark, d):
    """Each model's last candidate per record."""
    c = table(spark, d, "extraction_candidates").distinct()
    r = F.row_number().over(W.partitionBy("raw_record_id", "source_model").orderBy(F.desc("cand_pos"), F.desc("candidate_id")))
    return c.withColumn("r", r).filter("r = 1").select("raw_record_id", "source_model", "candidate_id")


QUERIES = {f.__name__: f for f in (exact_unit_match, exact_unit_match_all, field_scores, extraction_eval, common_matches, system_comparison, shared_units, last_answers)}

KEY = f"{c_('finding')} || chr(31) || array_to_string({objects_('object')}, chr(30)) || chr(31) || {c_('scene')}"
BASE = f"""g AS (SELECT raw_record_id, record_id AS unit, {c_('finding')} AS f, {objects_('object')} AS o, {KEY} AS k FROM structured_records),
p0 AS (SELECT DISTINCT candidate_id, source_model, raw_record_id, finding, object, scene FROM extraction_candidates WHERE raw_record_id IN (SELECT raw_record_id FROM structured_records)),
p AS (SELECT source_model, raw_record_id, candidate_id AS unit, {c_('finding')} AS f, {objects_('object')} AS o, {KEY} AS k FROM p0),
gr AS (SELECT *, row_number() OVER (PARTITION BY raw_record_id, k ORDER BY unit) AS r FROM g), pr AS (SELECT *, row_number() OVER (PARTITION BY source_model, raw_record_id, k ORDER BY unit) AS r FROM p),
hit AS (SELECT pr.source_model, pr.raw_record_id, pr.unit AS unit_p, gr.unit AS unit_g FROM pr JOIN gr USING (raw_record_id, k, r))"""
SQL = {
    "exact_unit_match": f"WITH {BASE} SELECT raw_record_id, unit_p, unit_g FROM hit WHERE source_model = 'lm-aster'",
    "exact_unit_match_all": f"WITH {BASE} SELECT source_model, raw_record_id, unit_p, unit_g FROM hit",
    "field_scores": f"""WITH {BASE}, g1 AS (SELECT raw_record_id, f AS gf, o AS go FROM g QUALIFY row_number() OVER (PARTITION BY raw_record_id ORDER BY unit) = 1), j AS (SELECT unit, f, gf, o, go, list_sum(list_transform(list_distinct(string_split(f, '')), lambda c: least(length(f) - length(replace(f, c, '')), length(gf) - length(replace(gf, c, ''))))) AS s FROM p JOIN g1 USING (raw_record_id))
 SELECT DISTINCT unit, round(CASE WHEN f = '' AND gf = '' THEN 1 WHEN f = '' OR gf = '' THEN 0 ELSE 2 * s / (length(f) + length(gf)) END, 6) AS char_f1, round(CASE WHEN len(o) = 0 AND len(go) = 0 THEN 1 WHEN len(o) = 0 OR len(go) = 0 THEN 0 ELSE 2 * len(list_intersect(o, go)) / (len(o) + len(go)) END, 6) AS set_f1 FROM j""",
    "system_comparison": f"WITH {BASE}, a AS (SELECT source_model, count(*) AS n_pred FROM p GROUP BY 1), h AS (SELECT source_model, count(*) AS n_hits FROM hit GROUP BY 1), z AS (SELECT count(*) AS n_gold FROM g), r AS (SELECT source_model, n_pred, coalesce(n_hits, 0) AS n_hits, n_gold FROM a LEFT JOIN h USING (source_model), z) SELECT *, round(n_hits / n_pred, 6) AS precision, round(n_hits / n_gold, 6) AS recall, round(2 * n_hits / (n_pred + n_gold), 6) AS f1 FROM r",
    "shared_units": f"WITH {BASE}, n AS (SELECT g.unit, count(DISTINCT p.source_model) AS n_models FROM g LEFT JOIN p ON p.raw_record_id = g.raw_record_id AND p.f = g.f WHERE g.f <> '' GROUP BY 1) SELECT n_models, count(*) AS n_units FROM n GROUP BY 1",
    "last_answers": "SELECT raw_record_id, source_model, candidate_id FROM (SELECT DISTINCT * FROM extraction_candidates) QUALIFY row_number() OVER (PARTITION BY raw_record_id, source_model ORDER BY cand_pos DESC, candidate_id DESC) = 1",
}
