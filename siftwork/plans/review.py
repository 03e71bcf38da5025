"""Typed cells, readers, key checks, evaluation reports, name reviews and nested requests over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.functions import text as T
from siftwork.operators import channels as C
from siftwork.operators import correspondence as R
from siftwork.operators import dedup as D
from siftwork.operators import evaluation as E
from siftwork.operators import requests as Q
from siftwork.operators import vectors as X
from siftwork.operators.checks import unit_key_problems as problems_of
from siftwork.plans import clusters as P
from siftwork.plans.clusters import CELLS, DIM, LAB, VEC, cent, round_all
from siftwork.plans.evaluation import BASE, gold, predictions
from siftwork.plans.records import CANDS, GROUPS, UNITS, c_, channel_inputs_union, n_, objects_, piece, raw, s_, units
from siftwork.session import checkpointed, table
from siftwork.sources import tables as S

MARKERS = ["另", "also"]


def _sha(c) -> F.Column:
    return F.sha2(F.to_json(c, {"ignoreNullFields": "false"}), 256)


# Cells


def typed_cells(spark, d):
    """Optional numbers and flags, clean texts and JSON objects of the candidates' cells."""
    e = table(spark, d, "extraction_candidates").distinct()
    m = T.json_dict("metadata")
    return e.select(
        "candidate_id", T.optional_int(m["attempt"]).alias("attempt"), T.optional_int(m["tokens"]).alias("tokens"), F.size(m).alias("n_keys"), F.round(T.optional_float("confidence"), 6).alias("confidence"), T.optional_bool(m["attempt"]).alias("first_try"), T.clean("scene").alias("scene"),
        T.true_text(m["attempt"]).alias("is_first"), F.array_join(T.json_list("object"), "¦").alias("listed"), T.cluster_id(m["attempt"], m["tokens"]).alias("cluster_id"),
    )


def nested_json(spark, d):
    """Keys and scalars at every depth of an object made of a record, and its fenced forms."""
    s = table(spark, d, "structured_records")
    cell = F.to_json(F.named_struct(F.lit("record_id"), "record_id", F.lit("inner"), F.named_struct(F.lit("texts"), F.array(F.coalesce("finding", F.lit("")), F.coalesce("scene", F.lit(""))), F.lit("n"), F.lit(1))))
    answer = F.concat(F.lit("```json\n"), cell, F.lit("\n```"))
    return s.select(
        "record_id", F.array_join(T.json_paths(cell, "keys"), ",").alias("keys"), F.md5(F.array_join(T.json_paths(cell, "scalars"), "¦")).alias("scalars_md5"), F.size(T.json_paths(cell, "strings")).alias("n_strings"),
        T.fenced_object(answer).isNotNull().alias("is_object"), T.fenced_array(answer).isNotNull().alias("is_array"), F.size(T.clean_objects(T.json_list("object"))).alias("n_listed"),
    )


def concise_findings(spark, d):
    return table(spark, d, "structured_records").select("record_id", T.concise("finding", MARKERS, 24).alias("short"))


def extraction_records(spark, d):
    """Structured records under the fixed columns, their objects as one text."""
    return E.extraction_records(table(spark, d, "structured_records")).withColumn("object", F.array_join("object", "¦")).drop("raw_text", "loc_detail")


def sites_in_range(spark, d):
    """Mean confidence of each site against the range of the models' means."""
    c = table(spark, d, "extraction_candidates").distinct()
    models = c.groupBy("source_model").agg(F.avg("confidence").alias("m")).agg(F.min("m").alias("low"), F.max("m").alias("high"))
    sites = c.groupBy("site_code").agg(F.avg("confidence").alias("mean_confidence"))
    return round_all(sites.join(F.broadcast(models)).select("site_code", "mean_confidence", T.range_label(F.round("mean_confidence", 11), F.round("low", 11), F.round("high", 11)).alias("place")), 11)


# Readers and record levels


def _candidate_units(spark, d) -> DataFrame:
    """Each candidate once as a unit of its model, with its record's text."""
    c = table(spark, d, "extraction_candidates").groupBy("candidate_id", "source_model", "raw_record_id", "finding", "object", "scene").agg(F.count(F.lit(1)).alias("_n"))
    texts = raw(spark, d).groupBy("record_id").agg(F.min_by("raw_text", "src_pos").alias("raw_text"))
    u = c.join(texts.withColumnRenamed("record_id", "raw_record_id"), "raw_record_id")
    none = F.lit("")
    return u.select(F.col("candidate_id").alias("record_id"), "source_model", "raw_record_id", "raw_text", "finding", T.parse_objects("object").alias("object"), "scene", none.alias("loc_detail"), none.alias("risk_scene"))


def provider_units(spark, d):
    """Units and effective units of each model."""
    u = _candidate_units(spark, d)
    n = u.groupBy("source_model").agg(F.count(F.lit(1)).alias("n_units"))
    e = S.effective_units(u, "source_model", D.is_effective()).groupBy("source_model").agg(F.count(F.lit(1)).alias("n_effective"))
    return n.join(e, "source_model", "left").fillna(0)


def ablation_channels(spark, d):
    """Inputs of all experiments: each model's effective units alone, and the voted units."""
    return C.ablation_inputs(units(spark, d), S.effective_units(_candidate_units(spark, d), "source_model", D.is_effective()), "source_model")


def provider_record_levels(spark, d):
    """Each model's units de-duplicated and brought to the grain of canonical records."""
    g = checkpointed(D.canonical_groups(raw(spark, d)))
    out = D.provider_levels(g, checkpointed(S.without_split(_candidate_units(spark, d)).withColumns({"loc_detail": F.lit(""), "risk_scene": F.lit("")})), "source_model")
    return out.drop("loc_detail", "risk_scene")


def _assignments(spark, d) -> DataFrame:
    """Structured records with a cluster, as a table that was written as text."""
    s = P._labelled(spark, d)
    c = F.col("cluster_id").cast("string")
    return s.select(F.lit("T3").alias("experiment_id"), "record_id", c.alias("cluster_id"), F.when(F.col("cluster_id") < 0, "True").otherwise("False").alias("is_noise"), F.when(F.col("parent") > 2, (F.col("cluster_id") + 10).cast("string")).alias("final_cluster_id"), F.when(F.col("parent") == 0, "primary_noise").alias("cluster_level"), F.col("parent").cast("string").alias("representative_rank"))


def cluster_assignments(spark, d):
    return S.cluster_assignments(_assignments(spark, d)).select("experiment_id", "record_id", "cluster_id", "is_noise", "final_cluster_id", "cluster_level", "representative_rank")


def cluster_name_review(spark, d):
    """Assignments with their cluster's name, the commonest scene of the cluster; every third cluster's naming failed."""
    s = P._labelled(spark, d).filter("cluster_id >= 0")
    n = s.groupBy("cluster_id", "scene").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("cluster_id").agg(F.min_by("scene", F.struct(-F.col("n"), F.col("scene"))).alias("scene"), F.sum("n").alias("sample_count"))
    name = F.concat(F.when(F.col("cluster_id") % 3 == 0, "FAILED:").otherwise(""), F.col("scene"))
    names = S.cluster_names(best.select(F.lit("T3").alias("experiment_id"), "cluster_id", name.alias("cluster_name"), F.lit(None).cast("string").alias("explanation"), "sample_count"))
    r = S.name_review(S.cluster_assignments(_assignments(spark, d)), names, "FAILED:")
    return r.select("record_id", "cluster_id", "cluster_size", "cluster_name", "cluster_explanation", F.coalesce("name_sample_count", F.lit(0)).alias("name_sample_count"), "name_failed", "cluster_level")


def cluster_field_values(spark, d):
    """Values of scenes, findings and objects per cluster of the parents, with their counts."""
    u = units(spark, d).withColumn("scene", T.normalize_text("scene")).withColumn("finding", T.normalize_text("finding"))
    x = C.field_values(u.join(P._labelled(spark, d).select("record_id", "parent"), "record_id"), "parent", ["scene", "object", "finding"])
    return x.groupBy("parent", "field").agg(F.count(F.lit(1)).alias("n_values"), F.sum("n").alias("n_rows"), F.min("value").alias("first_value"))


def channel_metadata(spark, d):
    """Counts per channel, also of a channel that no unit has."""
    label = C.label_or_missing("input_text", T.hash_bucket(T.strip("input_text"), 6) - 1)
    a = channel_inputs_union(spark, d).withColumn("label", label)
    return round_all(C.channel_metadata(a, "experiment_id", "label", [*C.CHANNELS, "B1", "T9"]))


def unit_key_problems(spark, d):
    """Blank and repeated unit keys of references and of all candidates, counted."""
    g = problems_of(table(spark, d, "structured_records"), "raw_record_id", "record_id").withColumn("side", F.lit("gold"))
    p = problems_of(table(spark, d, "extraction_candidates"), "raw_record_id", "candidate_id").withColumn("side", F.lit("prediction"))
    return g.select("side", "reason", "n").unionByName(p.select("side", "reason", "n")).groupBy("side", "reason").agg(F.count(F.lit(1)).alias("n_keys"), F.sum("n").alias("n_rows"))


# Evaluation


def external_labels(spark, d):
    """NMI and ARI of two labellings of the vectors; noise and missing rows are clusters like any other."""
    v = checkpointed(P.vectors(spark, d).select("cache_key", "label", "other"))
    cells = checkpointed(R.contingency(R.joined_labels(v, v, "cache_key", "label", "other", drop_sentinels=False)))
    return round_all(R.agreement(cells).select("n_records", "nmi", "ari"))


def clustering_evaluation(spark, d):
    """Structure, separation and agreement of one clustering, in one row."""
    v = checkpointed(P.vectors(spark, d))
    s = X.structure(v, "label").select("record_count", "cluster_count", "noise_ratio", "largest_topic_ratio")
    sil = X.silhouette(v, "cache_key", "label", "value", DIM).agg(F.avg("silhouette").alias("silhouette"))
    sim = X.topic_similarity(v, "label", "value", DIM).select("mean_similarity", "max_similarity")
    ext = R.agreement(checkpointed(R.contingency(R.joined_labels(v, v, "cache_key", "label", "other", drop_sentinels=False)))).select("nmi", "ari")
    return round_all(s.join(sil).join(sim).join(ext), 5)


def _split_pairs(spark, d) -> DataFrame:
    """Each model's split of a record's scene against the split that was voted for."""
    u = units(spark, d)
    g = u.select(F.col("record_id").alias("unit"), F.col("record_id").alias("key"), "finding", F.col("object").alias("objects"), "scene", "loc_detail", "risk_scene")
    a = table(spark, d, "scene_split_candidates").groupBy("source_model", "structured_record_id").agg(F.min(F.struct(F.coalesce("loc_detail", F.lit("")).alias("loc_detail"), F.coalesce("risk_scene", F.lit("")).alias("risk_scene"))).alias("a"))
    p = a.join(u.select(F.col("record_id").alias("structured_record_id"), "finding", F.col("object").alias("objects"), "scene"), "structured_record_id")
    p = p.select("source_model", F.concat_ws("|", "source_model", "structured_record_id").alias("unit"), F.col("structured_record_id").alias("key"), "finding", "objects", "scene", "a.loc_detail", "a.risk_scene")
    matches = p.select("key", F.col("unit").alias("unit_p"), F.col("key").alias("unit_g"), F.lit(True).alias("exact"))
    return E.paired_fields(matches, p, g, "key", "unit", ["source_model"])


def scene_split_eval(spark, d):
    """Character F1 of the two parts of the scene per model, over the records that it split."""
    f = E.field_summary(checkpointed(_split_pairs(spark, d)), "source_model").filter("field IN ('loc_detail', 'risk_scene', 'scene')")
    return round_all(f.select("source_model", "field", "f1", "evaluated_count", "omission", "over_extraction", "both_empty", "both_present"), 5)


def split_match_summary(spark, d):
    """Every pair of a split and its reference with the scores of all fields."""
    return round_all(E.match_summary(_split_pairs(spark, d), "key"), 5)


def _scored(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Predictions, references and matched pairs of all models, a record for each model."""
    p, g = predictions(spark, d), gold(spark, d)
    key = F.concat_ws("|", "source_model", "raw_record_id").alias("key")
    each = g.join(p.select("source_model", "raw_record_id").distinct(), "raw_record_id").select("*", key)
    p = p.select("*", key)
    return p, g, E.paired_fields(E.match_units(p, each, "key", "unit"), p, each.drop("source_model"), "key", "unit", ["source_model"])


def evaluation_fields(spark, d):
    """Scores and cases of each field over the best matching, per model."""
    return round_all(E.field_summary(checkpointed(_scored(spark, d)[2]), "source_model"))


def evaluation_matches(spark, d):
    """Every matched pair with the scores of its fields."""
    return round_all(E.match_summary(_scored(spark, d)[2], "key"))


METRICS = ["n_pred", "n_gold", "n_hits", "precision", "recall", "f1"]


def evaluation_summary(spark, d):
    """The unit metrics of each model as one row per metric."""
    s = E.complete_hits(predictions(spark, d), gold(spark, d), "raw_record_id", "unit", "source_model")
    return round_all(E.tall_summary(s, "source_model", METRICS))


def source_evaluation(spark, d):
    """Voted candidates against the references, by how they were accepted."""
    v = V_extraction(spark, d)
    scope = gold(spark, d).select("raw_record_id").distinct()
    c = table(spark, d, "extraction_candidates").groupBy("candidate_id").agg(F.min(F.struct("finding", "object", "scene")).alias("c"))
    p = v.join(scope, "raw_record_id", "left_semi").join(c, "candidate_id").select("accepted_by", "raw_record_id", F.col("candidate_id").alias("unit"), "c.finding", T.parse_objects("c.object").alias("objects"), "c.scene")
    return round_all(E.complete_hits(p, gold(spark, d), "raw_record_id", "unit", "accepted_by"))


def V_extraction(spark, d):
    from siftwork.plans.records import vote_extraction

    return vote_extraction(spark, d).select("raw_record_id", "candidate_id", "accepted_by")


# Requests


def _supported(spark, d) -> DataFrame:
    """Units with their scene as topic and their voted risk scene as control; majority votes support it."""
    u = units(spark, d)
    return u.select(F.col("record_id").alias("unit_id"), T.normalize_text("scene").alias("topic_id"), F.col("risk_scene").alias("control_id"), F.coalesce("finding", F.lit("")).alias("finding"), "object", F.col("accepted_by").alias("mode"), (~F.coalesce("arbitration_required", F.lit(False))).alias("supports"))


def unit_requests(spark, d):
    """Units of each control's topics in batches of 12; a topic belongs to the controls that most of its units have."""
    s = checkpointed(_supported(spark, d).filter("topic_id <> '' AND control_id <> ''"))
    m = s.groupBy("control_id", "topic_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("control_id", "topic_id")
    r = Q.unit_requests(m, "control_id", "topic_id", s.drop("control_id"), "unit_id", ["finding"], 12, "UNT-")
    return r.select("request_id", "control_id", F.size("units").alias("n_units"), _sha("units").alias("payload_sha256"))


def _evidence(spark, d):
    return Q.evidence_requests(_supported(spark, d).filter("supports AND control_id <> ''"), "control_id", "unit_id", "mode", "topic_id", "object", ["finding"], 12)


def card_requests(spark, d):
    """Evidence of each control: counts of modes, distinct scenes and objects, and at most 12 units in turn of the modes."""
    e = _evidence(spark, d)
    return e.select("control_id", "n_units", F.array_join(F.transform("mode_counts", lambda m: F.concat_ws(":", m["mode"], m["_n"].cast("string"))), ";").alias("mode_counts"), F.md5(F.array_join("scenes", "¦")).alias("scenes_md5"), F.md5(F.array_join("objects", "¦")).alias("objects_md5"), F.array_join(F.transform("samples", lambda x: x["unit_id"]), ",").alias("samples"))


def control_cards(spark, d):
    """Cards with the modes by their number of units, and the numbers of topics and units behind them."""
    e = _evidence(spark, d)
    topics = _supported(spark, d).filter("control_id <> '' AND topic_id <> ''").groupBy("control_id").agg(F.countDistinct("topic_id").alias("n_topics"))
    return e.join(topics, "control_id", "left").select("control_id", "n_units", F.coalesce("n_topics", F.lit(0)).alias("n_topics"), F.array_join("modes", ";").alias("modes"), F.size("scenes").alias("n_scenes"), F.size("objects").alias("n_objects"))


def group_requests(spark, d):
    """Models that share a finding of a record as its group, with the pairs of them that share the scene too."""
    c = table(spark, d, "extraction_candidates").select("raw_record_id", "source_model", T.normalize_text("finding").alias("finding"), T.normalize_text("scene").alias("scene")).filter("finding <> ''").distinct()
    group = F.concat_ws("|", "raw_record_id", F.md5("finding")).alias("group_id")
    m = c.select(group, "source_model", "scene").distinct()
    tagged = m.select("group_id", F.concat_ws("|", "group_id", "source_model").alias("topic_id"), "scene", "source_model")
    sides = [tagged.filter("scene <> ''").select("group_id", "scene", F.col("topic_id").alias(f"topic_{x}"), F.col("source_model").alias(f"model_{x}")) for x in "ab"]
    relations = sides[0].join(sides[1], ["group_id", "scene"]).filter("topic_a < topic_b").select(F.concat_ws("|", "topic_a", "topic_b", "scene").alias("pair_id"), "topic_a", "topic_b", F.col("scene").alias("shared"))
    r = Q.group_requests(tagged, "group_id", "topic_id", relations, "pair_id", "topic_a", "topic_b", ["shared"], "GRP-")
    return r.select("request_id", "group_id", F.size("members").alias("n_members"), F.coalesce(F.size("relations"), F.lit(0)).alias("n_relations"), F.md5(F.array_join(F.transform("relations", lambda x: x["pair_id"]), ";")).alias("relations_md5"))


def validated_controls(spark, d):
    """Risk scenes that a record's models gave, as its validated groups, numbered over all records."""
    c = table(spark, d, "scene_split_candidates").select("structured_record_id", "source_model", T.normalize_text("risk_scene").alias("name")).filter("name <> ''").distinct()
    nested = c.groupBy("structured_record_id", "name").agg(F.array_sort(F.collect_set("source_model")).alias("members")).groupBy("structured_record_id").agg(Q.ordered_list(["name"], ["name", "members"]).alias("groups"))
    from siftwork.operators.topics import controls

    control, member = controls(checkpointed(nested), "structured_record_id", "groups")
    return control.join(member.groupBy("control_id").agg(F.count(F.lit(1)).alias("n_member_rows")), "control_id")


def naming_requests(spark, d):
    """Per topic its rows and the five nearest to its centroid, nested."""
    r = X.centroid_ranks(P.vectors(spark, d), "cache_key", "label", "value", DIM, with_noise=False).filter("label >= 0")
    n = Q.naming_requests(r, ["label"], "rank", "cache_key", [], 5)
    return n.select("label", "n_rows", F.array_join(F.transform("samples", lambda x: x["cache_key"]), ",").alias("samples"))


QUERIES = {f.__name__: f for f in (typed_cells, nested_json, concise_findings, extraction_records, sites_in_range, provider_units, ablation_channels, provider_record_levels, cluster_assignments, cluster_name_review, cluster_field_values, channel_metadata, unit_key_problems, external_labels, clustering_evaluation, scene_split_eval, split_match_summary, evaluation_fields, evaluation_matches, evaluation_summary, source_evaluation, unit_requests, card_requests, control_cards, group_requests, validated_controls, naming_requests)}

# DuckDB

J = lambda k: f"json_extract_string(metadata, '$.{k}')"
JSON_CELL = "json_object('record_id', record_id, 'inner', json_object('texts', [coalesce(finding, ''), coalesce(scene, '')], 'n', 1))"
LISTED = "CASE WHEN json_valid(object) AND object LIKE '[%' THEN list_filter(json_extract_string(object, '$[*]'), lambda x: trim(x) <> '') WHEN trim(coalesce(object, '')) = '' THEN []::VARCHAR[] ELSE [object] END"
EFFECTIVE = f"({n_('finding')} <> '' OR len(object) > 0 OR {n_('scene')} <> '')"
PUNITS = f"""pt AS (SELECT record_id AS raw_record_id, arg_min(raw_text, src_pos) AS raw_text FROM raw_records GROUP BY 1),
 pu AS (SELECT candidate_id AS record_id, source_model, raw_record_id, pt.raw_text, finding, {objects_('object')} AS object, scene FROM (SELECT DISTINCT candidate_id, source_model, raw_record_id, finding, object, scene FROM extraction_candidates) JOIN pt USING (raw_record_id))"""
SPLIT = f"""{UNITS}, a AS (SELECT source_model, structured_record_id, min(row(coalesce(loc_detail, ''), coalesce(risk_scene, ''))) AS a FROM scene_split_candidates GROUP BY 1, 2),
 sp AS (SELECT source_model, record_id AS key, {c_('a[1]')} AS lp, {c_('a[2]')} AS xp, {c_('u.loc_detail')} AS lg, {c_('u.risk_scene')} AS xg, {c_('u.scene')} AS sp, {c_('u.scene')} AS sg, {c_('u.finding')} AS fp, len(u.object) AS o FROM a JOIN u ON u.record_id = a.structured_record_id)"""


def f1_(a: str, b: str) -> str:
    shared = f"list_sum(list_transform(list_distinct(string_split({a}, '')), lambda c: least(length({a}) - length(replace({a}, c, '')), length({b}) - length(replace({b}, c, '')))))"
    return f"(CASE WHEN {a} = '' AND {b} = '' THEN 1.0 WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE 2.0 * {shared} / (length({a}) + length({b})) END)"


SUPPORTED = f"{UNITS}, su AS (SELECT u.record_id AS unit_id, {n_('u.scene')} AS topic_id, u.risk_scene AS control_id, coalesce(u.finding, '') AS finding, u.object, r.accepted_by AS mode, NOT coalesce(u.arbitration_required, false) AS supports FROM u JOIN structured_records r USING (record_id))"
CARDS = f"""{SUPPORTED}, e AS (SELECT * FROM su WHERE supports AND control_id <> ''), mc AS (SELECT control_id, mode, count(*) AS n FROM e GROUP BY 1, 2),
 modes AS (SELECT control_id, string_agg(mode || ':' || n, ';' ORDER BY mode) AS mode_counts, string_agg(mode, ';' ORDER BY n DESC, mode) AS modes FROM mc GROUP BY 1),
 sc AS (SELECT control_id, list_sort(list(DISTINCT topic_id)) AS scenes FROM e WHERE topic_id <> '' GROUP BY 1), ob AS (SELECT control_id, list_sort(list(DISTINCT o)) AS objects FROM (SELECT control_id, unnest(object) AS o FROM e) WHERE trim(o) <> '' GROUP BY 1),
 t AS (SELECT *, row_number() OVER (PARTITION BY control_id, mode ORDER BY unit_id) AS t FROM e), sm AS (SELECT control_id, string_agg(unit_id, ',' ORDER BY p) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY control_id ORDER BY t, mode, unit_id) AS p FROM t) WHERE p <= 12 GROUP BY 1),
 cards AS (SELECT control_id, n_units, mode_counts, modes, coalesce(scenes, []) AS scenes, coalesce(objects, []) AS objects, samples FROM (SELECT control_id, count(*) AS n_units FROM e GROUP BY 1) JOIN modes USING (control_id) LEFT JOIN sc USING (control_id) LEFT JOIN ob USING (control_id) JOIN sm USING (control_id))"""
REF = "p0 AS (SELECT label AS a, other AS b FROM v)"
ALL_CELLS = CELLS.replace("p AS (SELECT label AS a, other AS b FROM v WHERE label >= 0 AND other >= 0)", "p AS (SELECT label AS a, other AS b FROM v)")
AGREE = """t AS (SELECT sum(n)::DOUBLE AS tot FROM cells), ma AS (SELECT DISTINCT a, n_a FROM cells), mb AS (SELECT DISTINCT b, n_b FROM cells),
 x AS (SELECT -sum(n_a / tot * ln(n_a / tot)) AS h_a, sum(n_a * (n_a - 1) / 2.0) AS pa FROM ma, t), y AS (SELECT -sum(n_b / tot * ln(n_b / tot)) AS h_b, sum(n_b * (n_b - 1) / 2.0) AS pb FROM mb, t), z AS (SELECT sum(n / tot * ln(n * tot / (n_a * n_b::DOUBLE))) AS mi, sum(n * (n - 1) / 2.0) AS pp FROM cells, t),
 ext AS (SELECT tot::BIGINT AS n_records, mi / ((h_a + h_b) / 2) AS nmi, (pp - pa * pb / (tot * (tot - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (tot * (tot - 1) / 2)) AS ari FROM x, y, z, t)"""
CHANNEL_LABELS = "ch AS (" + " UNION ALL ".join(f"SELECT '{e}' AS experiment_id, concat_ws(' | ', {', '.join((lambda v, f: f'''CASE WHEN {v} <> '' THEN '{f}: ' || {v} END''')('''array_to_string(object, '; ')''' if f == 'object' else s_(f), f) for f in fields)}) AS t FROM u" for e, fields in C.CHANNELS.items()) + " UNION ALL SELECT 'B1', coalesce(raw_text, '') FROM (SELECT DISTINCT record_id, raw_text FROM raw_records))"
hash_ = lambda g, m: f"((('0x' || substr(md5({g}), 7, 2) || substr(md5({g}), 5, 2) || substr(md5({g}), 3, 2) || substr(md5({g}), 1, 2))::BIGINT) % {m})::INT"
CLEAN_SCENE = "CASE WHEN scene IS NULL OR scene IN ('NaN', 'nan') THEN '' ELSE scene END"


def short_(x: str) -> str:
    cut = f"CASE WHEN instr({x}, '另') > 0 THEN {s_(f'''split_part({x}, '另', 1)''')} ELSE {x} END"
    return f"CASE WHEN instr({cut}, 'also') > 0 THEN {s_(f'''split_part({cut}, 'also', 1)''')} ELSE {cut} END"


SQL = {
    "typed_cells": f"SELECT candidate_id, try_cast({J('attempt')} AS BIGINT) AS attempt, try_cast({J('tokens')} AS BIGINT) AS tokens, coalesce(len(json_keys(metadata)), 0)::INT AS n_keys, round(confidence, 6) AS confidence, {J('attempt')} = '1' AS first_try, {CLEAN_SCENE} AS scene, coalesce({J('attempt')}, '') = '1' AS is_first, array_to_string({LISTED}, '¦') AS listed, coalesce(try_cast(coalesce({J('attempt')}, {J('tokens')}) AS INT), 0) AS cluster_id FROM (SELECT DISTINCT * FROM extraction_candidates)",
    "nested_json": f"SELECT record_id, 'record_id,inner,texts,n' AS keys, md5(record_id || '¦' || coalesce(finding, '') || '¦' || coalesce(scene, '') || '¦1') AS scalars_md5, 3 AS n_strings, json_type({JSON_CELL}) = 'OBJECT' AS is_object, json_type({JSON_CELL}) = 'ARRAY' AS is_array, len(list_filter({LISTED}, lambda x: {n_('x')} <> ''))::INT AS n_listed FROM structured_records",
    "concise_findings": f"WITH a AS (SELECT record_id, {s_('finding')} AS x FROM structured_records), b AS (SELECT record_id, {short_('x')} AS x FROM a), c AS (SELECT *, list_filter(list_transform(regexp_split_to_array(regexp_replace(x, '([。！？；])', '\\1' || chr(10), 'g'), '[\\r\\n]+'), lambda p: {s_('p')}), lambda p: p <> '') AS s FROM b) SELECT record_id, CASE WHEN length(x) <= 24 THEN x ELSE {s_('substr(coalesce(s[1], x), 1, 24)')} END AS short FROM c",
    "extraction_records": f"WITH f AS (SELECT record_id, record_id AS gold_record_id, raw_record_id, {n_('finding')} AS f, {n_('scene')} AS s, array_to_string({objects_('object')}, '¦') AS object FROM structured_records) SELECT record_id, gold_record_id, raw_record_id, CASE WHEN lower(f) = 'nan' THEN '' ELSE f END AS finding, CASE WHEN lower(s) = 'nan' THEN '' ELSE s END AS scene, '' AS risk_scene, object FROM f",
    "sites_in_range": "WITH c AS (SELECT DISTINCT * FROM extraction_candidates), m AS (SELECT round(min(m), 11) AS low, round(max(m), 11) AS high FROM (SELECT avg(confidence) AS m FROM c GROUP BY source_model)), s AS (SELECT site_code, round(avg(confidence), 11) AS mean_confidence FROM c GROUP BY 1) SELECT site_code, mean_confidence, CASE WHEN mean_confidence < low THEN 'below' WHEN mean_confidence > high THEN 'above' WHEN mean_confidence IS NOT NULL THEN 'within' END AS place FROM s, m",
    "provider_units": f"WITH {PUNITS} SELECT source_model, count(*) AS n_units, count(*) FILTER ({EFFECTIVE}) AS n_effective FROM pu GROUP BY 1",
    "ablation_channels": f"WITH {UNITS}, {PUNITS} " + " UNION ALL ".join([f"SELECT '{e}' AS experiment_id, record_id, concat_ws(' | ', {', '.join(piece(f) for f in fields)}) AS input_text FROM u" for e, fields in C.VOTED.items()] + [f"SELECT '{e}-' || source_model, record_id, concat_ws(' | ', {', '.join(piece(f) for f in fields)}) FROM pu WHERE {EFFECTIVE}" for e, fields in C.SINGLE.items()]),
    "provider_record_levels": f"""WITH {GROUPS}, {PUNITS}, ua AS (SELECT pu.*, md5(source_model || chr(31) || {n_('raw_text')} || chr(31) || {n_('finding')}) AS k, (len(object) > 0)::INT AS o, ({n_('scene')} <> '')::INT AS s FROM pu JOIN (SELECT DISTINCT canon FROM g) c ON c.canon = pu.raw_record_id WHERE {EFFECTIVE}),
 ku AS (SELECT * FROM ua QUALIFY row_number() OVER (PARTITION BY k ORDER BY o + s DESC, s DESC, o DESC, len(object) DESC, record_id) = 1),
 vals AS (SELECT source_model, raw_record_id, 'finding' AS f, {n_('finding')} AS v, record_id AS ord, 0 AS p FROM ku UNION ALL SELECT source_model, raw_record_id, 'scene', {n_('scene')}, record_id, 0 FROM ku UNION ALL SELECT source_model, raw_record_id, 'objects', object[i], record_id, i FROM (SELECT ku.*, unnest(range(1, len(object) + 1)) AS i FROM ku)),
 dv AS (SELECT source_model, raw_record_id, f, v, min(row(ord, p)) AS ord FROM vals WHERE v <> '' GROUP BY 1, 2, 3, 4), jv AS (SELECT source_model, raw_record_id, string_agg(v, '；' ORDER BY ord) FILTER (f = 'finding') AS finding, string_agg(v, '；' ORDER BY ord) FILTER (f = 'scene') AS scene, string_agg(v, '；' ORDER BY ord) FILTER (f = 'objects') AS objects FROM dv GROUP BY 1, 2),
 nu AS (SELECT source_model, raw_record_id, count(*) AS n_units FROM ku GROUP BY 1, 2)
 SELECT m.source_model, 'U' || lpad(g.n::VARCHAR, greatest(5, len(g.n::VARCHAR))::INT, '0') AS analysis_record_id, canon AS raw_record_id, coalesce(objects, '') AS objects, coalesce(finding, '') AS finding, coalesce(scene, '') AS scene, coalesce(n_units, 0) AS n_units FROM g CROSS JOIN (SELECT DISTINCT source_model FROM pu) m LEFT JOIN jv ON jv.source_model = m.source_model AND jv.raw_record_id = canon LEFT JOIN nu ON nu.source_model = m.source_model AND nu.raw_record_id = canon""",
    "cluster_assignments": f"WITH {LAB} SELECT 'T3' AS experiment_id, record_id, cluster_id::BIGINT AS cluster_id, cluster_id < 0 AS is_noise, (CASE WHEN parent > 2 THEN cluster_id + 10 ELSE cluster_id END)::BIGINT AS final_cluster_id, CASE WHEN parent = 0 OR cluster_id < 0 THEN 'primary_noise' ELSE 'primary' END AS cluster_level, parent::BIGINT AS representative_rank FROM s",
    "cluster_name_review": f"WITH {LAB}, n AS (SELECT cluster_id, scene, count(*) AS n FROM s WHERE cluster_id >= 0 GROUP BY 1, 2), b AS (SELECT cluster_id, arg_min(scene, row(-n, scene)) AS scene, sum(n)::BIGINT AS c FROM n GROUP BY 1) SELECT record_id, s.cluster_id::BIGINT AS cluster_id, count(*) OVER (PARTITION BY s.cluster_id) AS cluster_size, coalesce(CASE WHEN s.cluster_id % 3 = 0 THEN 'FAILED:' ELSE '' END || b.scene, '') AS cluster_name, '' AS cluster_explanation, coalesce(b.c, 0) AS name_sample_count, coalesce(s.cluster_id >= 0 AND s.cluster_id % 3 = 0, false) AS name_failed, CASE WHEN parent = 0 OR s.cluster_id < 0 THEN 'primary_noise' ELSE 'primary' END AS cluster_level FROM s LEFT JOIN b ON b.cluster_id = s.cluster_id",
    "cluster_field_values": f"WITH {UNITS}, {LAB}, x AS (SELECT s.parent, 'scene' AS field, {n_('u.scene')} AS value FROM u JOIN s USING (record_id) UNION ALL SELECT s.parent, 'finding', {n_('u.finding')} FROM u JOIN s USING (record_id) UNION ALL SELECT s.parent, 'object', unnest(u.object) FROM u JOIN s USING (record_id)) SELECT parent, field, count(DISTINCT value) AS n_values, count(*) AS n_rows, min(value) AS first_value FROM x WHERE value <> '' GROUP BY 1, 2",
    "channel_metadata": f"WITH {UNITS}, {CHANNEL_LABELS}, l AS (SELECT experiment_id, {hash_(s_('t'), 6)} - 1 AS label FROM ch WHERE {n_('t')} <> ''), m AS (SELECT experiment_id, count(*) AS record_count, count(DISTINCT label) FILTER (label >= 0) AS cluster_count, count(*) FILTER (label = -1) AS noise_count, round(count(*) FILTER (label = -1) / count(*), 6) AS noise_ratio FROM l GROUP BY 1) SELECT e AS experiment_id, coalesce(record_count, 0) AS record_count, coalesce(cluster_count, 0) AS cluster_count, coalesce(noise_count, 0) AS noise_count, coalesce(noise_ratio, 0) AS noise_ratio FROM (SELECT unnest([{', '.join(f"'{e}'" for e in [*C.CHANNELS, 'B1', 'T9'])}]) AS e) LEFT JOIN m ON m.experiment_id = e",
    "unit_key_problems": " UNION ALL ".join(f"SELECT '{side}' AS side, reason, count(*) AS n_keys, sum(n)::BIGINT AS n_rows FROM (SELECT count(*) AS n, CASE WHEN {n_('raw_record_id')} = '' OR {n_(u)} = '' THEN 'blank' WHEN count(*) > 1 THEN 'repeated' END AS reason FROM {t} GROUP BY raw_record_id, {u}) WHERE reason IS NOT NULL GROUP BY 2" for side, t, u in (("gold", "structured_records", "record_id"), ("prediction", "extraction_candidates", "candidate_id"))),
    "external_labels": f"WITH {VEC}, {ALL_CELLS}, {AGREE} SELECT n_records, round(nmi, 6) AS nmi, round(ari, 6) AS ari FROM ext",
    "clustering_evaluation": f"""WITH {VEC}, {ALL_CELLS}, {AGREE}, lb AS (SELECT label, count(*) AS n FROM v GROUP BY 1), st AS (SELECT sum(n)::BIGINT AS record_count, count(*) FILTER (label >= 0) AS cluster_count, coalesce(sum(n) FILTER (label = -1), 0) / sum(n) AS noise_ratio, max(n) FILTER (label >= 0) / sum(n) FILTER (label <> -2) AS largest_topic_ratio FROM lb),
 uv AS (SELECT cache_key, label, list_transform(value, lambda x: x / sqrt(list_sum(list_transform(value, lambda y: y * y)))) AS u FROM v WHERE label >= 0), m AS {cent('label', 'uv', 'u')}, dd AS (SELECT cache_key, uv.label, m.label AS l, n, 1 - list_dot_product(u, c) AS d FROM uv, m), gg AS (SELECT cache_key, label, max(CASE WHEN l = label THEN d * n / nullif(n - 1, 0) END) AS a, max(CASE WHEN l = label THEN n END) AS n, min(CASE WHEN l <> label THEN d END) AS b FROM dd GROUP BY 1, 2),
 sil AS (SELECT avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM gg), sim AS (SELECT avg(list_cosine_similarity(i.c, j.c)) AS mean_similarity, max(list_cosine_similarity(i.c, j.c)) AS max_similarity FROM m i JOIN m j ON i.label < j.label)
 SELECT record_count, cluster_count, round(noise_ratio, 5) AS noise_ratio, round(largest_topic_ratio, 5) AS largest_topic_ratio, round(silhouette, 5) AS silhouette, round(mean_similarity, 5) AS mean_similarity, round(max_similarity, 5) AS max_similarity, round(nmi, 5) AS nmi, round(ari, 5) AS ari FROM st, sil, sim, ext""",
    "scene_split_eval": f"WITH {SPLIT}, x AS (SELECT source_model, 'loc_detail' AS field, lp AS p, lg AS g FROM sp UNION ALL SELECT source_model, 'risk_scene', xp, xg FROM sp UNION ALL SELECT source_model, 'scene', sp, sg FROM sp) SELECT source_model, field, round(coalesce(avg({f1_('p', 'g')}) FILTER (p <> '' OR g <> ''), 0), 5) AS f1, count(*) FILTER (p <> '' OR g <> '') AS evaluated_count, count(*) FILTER (p = '' AND g <> '') AS omission, count(*) FILTER (p <> '' AND g = '') AS over_extraction, count(*) FILTER (p = '' AND g = '') AS both_empty, count(*) FILTER (p <> '' AND g <> '') AS both_present FROM x GROUP BY 1, 2",
    "split_match_summary": f"WITH {SPLIT} SELECT key, source_model || '|' || key AS unit_p, key AS unit_g, true AS exact, CASE WHEN fp = '' AND sp = '' AND o = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS pairing_score, 1.0::DOUBLE AS finding_f1, 1.0::DOUBLE AS scene_f1, round({f1_('lp', 'lg')}, 5) AS loc_detail_f1, round({f1_('xp', 'xg')}, 5) AS risk_scene_f1, 1.0::DOUBLE AS object_f1 FROM sp",
    "evaluation_summary": f"WITH {BASE}, a AS (SELECT source_model, count(*) AS n_pred FROM p GROUP BY 1), h AS (SELECT source_model, count(*) AS n_hits FROM hit GROUP BY 1), z AS (SELECT count(*) AS n_gold FROM g), r AS (SELECT source_model, n_pred, coalesce(n_hits, 0) AS n_hits, n_gold FROM a LEFT JOIN h USING (source_model), z), l AS (SELECT source_model, unnest(['n_pred', 'n_gold', 'n_hits', 'precision', 'recall', 'f1']) AS metric, unnest([0, 1, 2, 3, 4, 5]) AS place, unnest([n_pred::DOUBLE, n_gold, n_hits, n_hits / n_pred, n_hits / n_gold, 2 * n_hits / (n_pred + n_gold)]) AS value FROM r) SELECT source_model, place::INT AS place, metric, round(value, 6) AS value FROM l",
    "source_evaluation": f"""WITH {CANDS}, k AS (SELECT raw_record_id, group_index, finding, objects, scene, count(DISTINCT source_model) AS support, min(row(cand_pos, candidate_id)) AS o, arg_min(candidate_id, row(cand_pos, candidate_id)) AS candidate_id FROM cg GROUP BY ALL),
 vt AS (SELECT raw_record_id, candidate_id, CASE WHEN support >= 2 THEN 'majority_vote' ELSE 'arbitration' END AS accepted_by FROM k QUALIFY row_number() OVER (PARTITION BY raw_record_id, group_index ORDER BY CASE WHEN support >= 2 THEN -support ELSE 0 END, o) = 1),
 cc AS (SELECT candidate_id, min(row(finding, object, scene)) AS c FROM extraction_candidates GROUP BY 1), pp AS (SELECT accepted_by, raw_record_id, candidate_id AS unit, c[1] AS finding, c[2] AS object, c[3] AS scene FROM vt JOIN cc USING (candidate_id) WHERE raw_record_id IN (SELECT raw_record_id FROM structured_records)),
 key_p AS (SELECT accepted_by, raw_record_id, unit, {c_('finding')} || chr(31) || array_to_string({objects_('object')}, chr(30)) || chr(31) || {c_('scene')} AS k FROM pp), key_g AS (SELECT raw_record_id, record_id AS unit, {c_('finding')} || chr(31) || array_to_string({objects_('object')}, chr(30)) || chr(31) || {c_('scene')} AS k FROM structured_records),
 rp AS (SELECT *, row_number() OVER (PARTITION BY accepted_by, raw_record_id, k ORDER BY unit) AS r FROM key_p), rg AS (SELECT *, row_number() OVER (PARTITION BY raw_record_id, k ORDER BY unit) AS r FROM key_g), h AS (SELECT accepted_by, count(*) AS n_hits FROM rp JOIN rg USING (raw_record_id, k, r) GROUP BY 1), n AS (SELECT accepted_by, count(*) AS n_pred FROM pp GROUP BY 1), z AS (SELECT count(*) AS n_gold FROM structured_records)
 SELECT accepted_by, n_pred, coalesce(n_hits, 0) AS n_hits, n_gold, round(coalesce(n_hits, 0) / n_pred, 6) AS precision, round(coalesce(n_hits, 0) / n_gold, 6) AS recall, round(2 * coalesce(n_hits, 0) / (n_pred + n_gold), 6) AS f1 FROM n LEFT JOIN h USING (accepted_by), z""",
    "unit_requests": f"WITH {SUPPORTED}, ok AS (SELECT * FROM su WHERE topic_id <> '' AND control_id <> ''), m AS (SELECT control_id, topic_id FROM ok GROUP BY 1, 2 HAVING count(*) >= 2), r AS (SELECT m.control_id, unit_id, topic_id, finding, (row_number() OVER (PARTITION BY m.control_id ORDER BY unit_id) - 1) // 12 AS b FROM m JOIN ok USING (topic_id)), q AS (SELECT control_id, b, count(*)::INT AS n_units, sha256('[' || string_agg(json_object('unit_id', unit_id, 'topic_id', topic_id, 'finding', finding)::VARCHAR, ',' ORDER BY unit_id) || ']') AS payload_sha256 FROM r GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (ORDER BY control_id, b) AS n FROM q) SELECT 'UNT-' || lpad(n::VARCHAR, greatest(5, len(n::VARCHAR))::INT, '0') AS request_id, control_id, n_units, payload_sha256 FROM n",
    "card_requests": f"WITH {CARDS} SELECT control_id, n_units, mode_counts, md5(array_to_string(scenes, '¦')) AS scenes_md5, md5(array_to_string(objects, '¦')) AS objects_md5, samples FROM cards",
    "control_cards": f"WITH {CARDS}, tp AS (SELECT control_id, count(DISTINCT topic_id) AS n_topics FROM su WHERE control_id <> '' AND topic_id <> '' GROUP BY 1) SELECT control_id, n_units, coalesce(n_topics, 0) AS n_topics, modes, len(scenes)::INT AS n_scenes, len(objects)::INT AS n_objects FROM cards LEFT JOIN tp USING (control_id)",
    "group_requests": f"WITH c AS (SELECT DISTINCT raw_record_id || '|' || md5({n_('finding')}) AS group_id, source_model, {n_('scene')} AS scene FROM extraction_candidates WHERE {n_('finding')} <> ''), m AS (SELECT group_id, count(DISTINCT source_model)::INT AS n_members FROM c GROUP BY 1), p AS (SELECT a.group_id, a.group_id || '|' || a.source_model || '|' || b.group_id || '|' || b.source_model || '|' || a.scene AS pair_id FROM c a JOIN c b ON a.group_id = b.group_id AND a.scene = b.scene AND a.source_model < b.source_model WHERE a.scene <> ''), r AS (SELECT group_id, count(*)::INT AS n_relations, md5(string_agg(pair_id, ';' ORDER BY pair_id)) AS relations_md5 FROM p GROUP BY 1), n AS (SELECT *, row_number() OVER (ORDER BY group_id) AS n FROM m) SELECT 'GRP-' || lpad(n::VARCHAR, greatest(4, len(n::VARCHAR))::INT, '0') AS request_id, group_id, n_members, coalesce(n_relations, 0) AS n_relations, relations_md5 FROM n LEFT JOIN r USING (group_id)",
    "validated_controls": f"WITH c AS (SELECT DISTINCT structured_record_id, {n_('risk_scene')} AS name, source_model FROM scene_split_candidates WHERE {n_('risk_scene')} <> ''), g AS (SELECT structured_record_id, name, list_sort(list(source_model)) AS m FROM c GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY structured_record_id ORDER BY name) AS place FROM g), n AS (SELECT *, row_number() OVER (ORDER BY structured_record_id, array_to_string(m, chr(31)), place) AS n FROM p WHERE len(m) >= 2) SELECT 'CTRL-' || lpad(n::VARCHAR, greatest(3, len(n::VARCHAR))::INT, '0') AS control_id, structured_record_id, name, len(m)::INT AS n_members, len(m) AS n_member_rows FROM n",
    "naming_requests": f"WITH {VEC}, c AS {cent('label', 'v', 'value')}, d AS (SELECT cache_key, label, list_distance(value, c) AS distance FROM v JOIN c USING (label) WHERE label >= 0), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(distance, 9), cache_key) AS r FROM d) SELECT label, count(*) AS n_rows, string_agg(cache_key, ',' ORDER BY r) FILTER (r <= 5) AS samples FROM r GROUP BY 1",
}
