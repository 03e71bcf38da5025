from siftwork.plans import records as P


def test_provenance_of_every_field(spark, tmp_path):
    """Every object is checked against its finding, and loc_detail against its scene."""
    unit = "record_id string, raw_record_id string, raw_text string, finding string, object string, scene string"
    rows = [("a", "r", "仓库东侧AC/DC泵漏油，阀松", "AC/DC泵漏油", "AC/DC泵；阀;灯", "仓库东侧"), ("b", "r", "x", "y", None, None)]
    split = "source_model string, structured_record_id string, loc_detail string, risk_scene string"
    spark.createDataFrame(rows, unit).write.parquet(f"{tmp_path}/structured_records.parquet")
    spark.createDataFrame([("m", "a", "东侧", "仓库"), ("n", "a", "东侧", "仓库"), ("m", "b", "", "")], split).write.parquet(f"{tmp_path}/scene_split_candidates.parquet")
    got = sorted((r["field"], r["value"], r["is_valid"], r["reason"]) for r in P.provenance_all_fields(spark, str(tmp_path)).filter("field IN ('object', 'loc_detail')").collect())
    assert got == [
        ("loc_detail", "东侧", True, "continuous_substring_of_scene"),
        ("object", "AC/DC泵", True, "continuous_substring_of_finding"),
        ("object", "灯", False, "not_continuous_substring_of_finding"),
        ("object", "阀", False, "not_in_finding_but_found_in_raw_text"),
    ]
    n = {r["field"]: (r["checked_fields"], r["invalid_fields"]) for r in P.validation_all_fields(spark, str(tmp_path)).collect()}
    assert n == {"finding": (2, 1), "scene": (2, 1), "object": (3, 2), "risk_scene": (1, 0), "loc_detail": (1, 0)}
