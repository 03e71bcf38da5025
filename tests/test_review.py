"""Typed cells, readers, reports and requests on small tables written out by hand."""

import pytest
from pyspark.sql import functions as F

from siftwork.functions import text as T
from siftwork.operators import channels as C
from siftwork.operators import checks, dedup
from siftwork.operators import evaluation as E
from siftwork.operators import requests as Q
from siftwork.sources import tables as S

UNIT = "r string, unit string, finding string, objects array<string>, scene string, loc_detail string, risk_scene string"


def test_typed_cells(spark):
    rows = [("1", " 2.5 ", "Yes", '{"a": 1, "b": {"c": "x"}}'), (None, "NaN", None, "[1]"), ("x", "", "0", "{bad"), ("7.9", "1e3", " TRUE ", None)]
    df = spark.createDataFrame(rows, "i string, f string, b string, j string")
    got = df.select(T.optional_int("i").alias("i"), T.optional_float("f").alias("f"), T.optional_bool("b").alias("b"), T.json_dict("j").alias("j"), T.clean("f").alias("c")).collect()
    assert [r["i"] for r in got] == [1, None, None, 7] and [r["f"] for r in got] == [2.5, None, None, 1000.0]
    assert [r["b"] for r in got] == [True, None, False, True] and [r["c"] for r in got] == [" 2.5 ", "", "", "1e3"]
    assert [r["j"] for r in got] == [{"a": "1", "b": '{"c":"x"}'}, {}, {}, {}]


def test_json_is_walked_at_every_depth(spark):
    deep = '{"k":' * 500 + '"end"' + "}" * 500
    df = spark.createDataFrame([('{"a": {"b": ["x", 2, {"c": "y"}]}, "d": null}',), (deep,), ("no",), (None,), ("[" * 200_000,)], "j string")
    got = df.select(*[T.json_paths("j", w).alias(w) for w in ("keys", "strings", "scalars")]).collect()
    assert (got[0]["keys"], got[0]["strings"], got[0]["scalars"]) == (["a", "b", "c", "d"], ["x", "y"], ["x", "2", "y"])
    assert len(got[1]["keys"]) == 500 and got[1]["strings"] == ["end"] and got[2]["keys"] is got[3]["keys"] is got[4]["keys"] is None


def test_answers_of_one_kind_and_short_texts(spark):
    df = spark.createDataFrame([("```json\n[1]\n```",), ('{"a": 1}',), ("x",)], "t string")
    assert [(r[0], r[1]) for r in df.select(T.fenced_array("t"), T.fenced_object("t")).collect()] == [("[1]", None), (None, '{"a": 1}'), (None, None)]
    texts = spark.createDataFrame([("一二三。四五六七八九十",), ("一二 另：三",), ("一二三四五六七八九十",), (None,), (" 短 ",)], "t string")
    assert [r[0] for r in texts.select(T.concise("t", ["另"], 5)).collect()] == ["一二三。", "一二", "一二三四五", "", "短"]
    v = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,)], "v double")
    assert [r[0] for r in v.select(T.range_label("v", F.lit(2.0), F.lit(2.5))).collect()] == ["below", "within", "above", None]


def test_records_of_other_makes(spark):
    df = spark.createDataFrame([("9", None, "锈", '["泵", "阀"]'), ("8", "r", "nan", None)], "id string, raw_id string, phenomenon_label string, object_json string")
    got = [(r["record_id"], r["raw_record_id"], r["finding"], r["object"]) for r in E.extraction_records(df, minimal=True).collect()]
    assert got == [("9", "", "锈", ["泵", "阀"]), ("8", "r", "", [])]
    assert "raw_text" not in E.extraction_records(df, minimal=True).columns
    assert S.without_split(spark.createDataFrame([], UNIT)).columns == ["r", "unit", "finding", "objects", "scene"]


def test_reports_of_a_matching(spark):
    p = spark.createDataFrame([("1", "p1", "漏油", ["泵"], "仓", "东", ""), ("1", "p2", "锈", [], "", "", "高"), ("2", "p3", "裂", ["阀"], "间", "", "")], UNIT).withColumn("s", F.lit("m"))
    g = spark.createDataFrame([("1", "g1", "漏油", ["泵"], "仓", "东", "高"), ("1", "g2", "锈蚀", ["门"], "", "西", "高"), ("3", "g3", "空", [], "", "", "")], UNIT)
    m = E.match_units(p, g, "r", "unit")
    assert {(r["unit_p"], r["unit_g"], r["exact"]) for r in m.collect()} == {("p1", "g1", True), ("p2", "g2", False)}
    pairs = E.paired_fields(m, p, g, "r", "unit", ["s"])
    f = {r["field"]: r for r in E.field_summary(pairs, "s").collect()}
    assert f["finding"]["f1"] == pytest.approx((1 + 2 / 3) / 2) and f["finding"]["exact_match_rate"] == 0.5 and f["finding"]["evaluated_count"] == 2
    assert f["object"]["f1"] == 0.5 and (f["object"]["omission"], f["object"]["both_present"]) == (1, 1)
    assert (f["scene"]["evaluated_count"], f["scene"]["both_empty"]) == (1, 1) and (f["loc_detail"]["omission"], f["risk_scene"]["omission"]) == (1, 1)
    s = {r["unit_p"]: r for r in E.match_summary(pairs, "r").collect()}
    assert s["p1"]["pairing_score"] == 1 and s["p2"]["pairing_score"] == pytest.approx((2 / 3 + 0) / 2) and s["p2"]["risk_scene_f1"] == 1 and s["p1"]["risk_scene_f1"] == 0
    h = E.complete_hits(p, g, "r", "unit", "s").first()
    assert (h["n_pred"], h["n_gold"], h["n_hits"]) == (3, 3, 1) and h["f1"] == pytest.approx(1 / 3)
    tall = E.tall_summary(E.complete_hits(p, g, "r", "unit", "s"), "s", ["n_hits", "recall"]).orderBy("place").collect()
    assert [(r["metric"], r["value"]) for r in tall] == [("n_hits", 1.0), ("recall", pytest.approx(1 / 3))]


def test_keys_providers_and_channels(spark):
    keys = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "1"), (None, "2"), ("c", " ")], "r string, u string")
    assert {(r["r"], r["u"], r["n"], r["reason"]) for r in checks.unit_key_problems(keys, "r", "u").collect()} == {("a", "1", 2, "repeated"), ("", "2", 1, "blank"), ("c", " ", 1, "blank")}
    units = spark.createDataFrame([("x", "1", "f"), ("y", "2", "")], "p string, id string, finding string")
    assert S.effective_units(units, "p", F.col("finding") != "", ["x"]).count() == 1
    with pytest.raises(ValueError):
        S.effective_units(units, "p", F.col("finding") != "", ["x", "y"])
    a = spark.createDataFrame([("T1", 0), ("T1", -1), ("T2", -2)], "e string, l int")
    assert {r["e"]: (r["record_count"], r["cluster_count"], r["noise_ratio"]) for r in C.channel_metadata(a, "e", "l", ["T1", "T2", "T3"]).collect()} == {"T1": (2, 1, 0.5), "T2": (0, 0, 0.0), "T3": (0, 0, 0.0)}
    assert C.recluster_options({"least_count": 5}, {"least_ratio": 0.2}) == {"least_count": 5, "least_ratio": 0.2}


def test_levels_of_each_provider(spark):
    raw = spark.createDataFrame([("r1", "甲 乙", 1), ("r2", "甲  乙", 2), ("r3", "丙", 3)], "record_id string, raw_text string, src_pos long")
    unit = "record_id string, m string, raw_record_id string, raw_text string, finding string, object array<string>, scene string, loc_detail string, risk_scene string"
    rows = [("u1", "a", "r1", "甲 乙", "漏", ["泵"], "", "", ""), ("u2", "a", "r1", "甲 乙", "漏", ["泵"], "仓", "", ""), ("u3", "a", "r2", "甲  乙", "漏", [], "", "", ""), ("u4", "b", "r1", "甲 乙", "漏", [], "", "", ""), ("u5", "b", "r1", "甲 乙", "锈", ["阀"], "", "", "")]
    got = {(r["m"], r["raw_record_id"]): (r["finding"], r["objects"], r["scene"], r["n_units"]) for r in dedup.provider_levels(dedup.canonical_groups(raw), spark.createDataFrame(rows, unit), "m").collect()}
    assert got == {("a", "r1"): ("漏", "泵", "仓", 1), ("a", "r3"): ("", "", "", 0), ("b", "r1"): ("漏；锈", "阀", "", 2), ("b", "r3"): ("", "", "", 0)}


def test_requests(spark):
    m = spark.createDataFrame([("c1", "t1"), ("c1", "t2"), ("c2", "t2"), ("c1", "t1")], "c string, t string")
    u = spark.createDataFrame([(f"u{i}", "t1" if i < 4 else "t2", f"f{i}") for i in range(6)] + [("u0", "t1", "f0")], "u string, t string, f string")
    got = [(r["request_id"], r["c"], [x["u"] for x in r["units"]]) for r in Q.unit_requests(m, "c", "t", u, "u", ["f"], 4, "UNT-").orderBy("request_id").collect()]
    assert got == [("UNT-00001", "c1", ["u0", "u1", "u2", "u3"]), ("UNT-00002", "c1", ["u4", "u5"]), ("UNT-00003", "c2", ["u4", "u5"])]
    rel = spark.createDataFrame([("p2", "t2", "t1", "x"), ("p1", "t1", "t2", "y"), ("p3", "t1", "t9", "z")], "p string, a string, b string, why string")
    g = {r["c"]: (r["request_id"], r["members"], [x["p"] for x in r["relations"] or []]) for r in Q.group_requests(m, "c", "t", rel, "p", "a", "b", ["why"], "GRP-").collect()}
    assert g == {"c1": ("GRP-0001", ["t1", "t2"], ["p1", "p2"]), "c2": ("GRP-0002", ["t2"], [])}
    e = spark.createDataFrame([("c", f"u{i}", "ab"[i % 2] if i < 5 else "b", "s" if i else "", ["o", f"o{i % 2}"], "f") for i in range(7)] + [("c", "u1", "b", "s", ["o", "o1"], "f")], "c string, u string, m string, s string, o array<string>, f string")
    r = Q.evidence_requests(e, "c", "u", "m", "s", "o", ["f"], 3).first()
    assert r["n_units"] == 7 and [(x["m"], x["_n"]) for x in r["mode_counts"]] == [("a", 3), ("b", 4)] and r["modes"] == ["b", "a"]
    assert r["scenes"] == ["s"] and r["objects"] == ["o", "o0", "o1"] and [x["u"] for x in r["samples"]] == ["u0", "u1", "u2"]
    assert Q.evidence_requests(e.limit(0), "c", "u", "m", "s", "o", ["f"], 3).count() == 0
