import re

import pytest

from rollbook.plans import schema_map as M


def profile_of(df):
    return {r["canonical_field"]: r for r in df.collect()}


HEADERS = {
    "FIRST_NM": "first_name", "LAST_NM": "last_name", "BUSINESS_NAME_1": "employer", "PRIMARY_BUSINESS_POSITION": "occupation",
    "CONSTITUENT_PREFERRED_EMAIL": "email", "HOME_CITY_1": "city", "LT_GIFT_AMT": "lifetime_giving", "LAST_CONTACT_DT": "last_contact_date",
    "CLASS_CD": "grad_year", "Do Not Contact": "do_not_contact", "person key": "constituent_id", "mostRecentGiftDate": "last_gift_date",
}


def test_headers_alone(frame):
    df = frame(list(HEADERS), [("",) * len(HEADERS)])
    found = {r["source"]: r["canonical_field"] for r in M.header_candidates(df).collect()}
    assert found == HEADERS


def test_alias_confidence(frame):
    df = frame(["Email", "e mail", "FirstName"], [("", "", "")])
    got = {(r["source"], r["canonical_field"]): (r["confidence"], r["method"]) for r in M.schema_candidates(df).collect()}
    assert got["Email", "email"][0] == 0.99 and got["e mail", "email"] == (0.96, "normalized_alias") and got["FirstName", "first_name"][1] == "exact_alias"


def test_cells_speak_for_columns(frame):
    rows = [(f"p{i}@a.com", f"q{i}@b.org", f"https://linkedin.com/in/{i}", str(1990 + i), "yes" if i % 2 else "N", f"${i}", f"2024-01-0{i + 1}", f"n{i}@c.io") for i in range(4)]
    df = frame(["PREF_EML", "xx", "link", "CLASS_X", "contact ok", "gift sum", "contact dt", "Notes"], rows)
    got = {(r["source"], r["canonical_field"]): r["confidence"] for r in M.sample_candidates(df, this_year=2025).collect()}
    assert got == {
        ("PREF_EML", "email"): 0.88, ("xx", "email"): 0.72, ("link", "linkedin_url"): 0.82, ("CLASS_X", "grad_year"): 0.84,
        ("contact ok", "do_not_contact"): 0.82, ("gift sum", "lifetime_giving"): 0.76, ("contact dt", "last_contact_date"): 0.79,
    }
    whole = {(r["source"], r["canonical_field"]): r["confidence"] for r in M.sample_candidates(df, sample=2, this_year=2025).collect()}
    assert whole == got


def test_selection_and_conflicts(frame):
    df = frame(["First Name", "Email 1", "Work Email", "Title", "Role", "Company", "Employer Name X"], [("a",) * 7])
    profile = profile_of(M.infer_schema(df))
    assert set(profile) == {"first_name", "email", "employer"}
    assert profile["email"]["source_columns"] == ["Email 1", "Work Email"] and profile["email"]["label"] == "high"
    conflicts = M.schema_conflicts(df).collect()
    assert [(r["type"], r["canonical_fields"], r["source_columns"]) for r in conflicts] == [
        ("single_field_multiple_sources", ["occupation"], ["Title", "Role"])
    ]
    row = M.schema_summary(M.infer_schema(df), df.columns, M.schema_conflicts(df)).first()
    assert (row.schema_mapped_count, row.schema_unmapped_count, row.schema_conflict_count) == (3, 3, 1)


def test_merge_and_apply(spark, frame):
    df = frame(["F_NM", "BUS", "E1", "E2", "Other"], [("Ada", "Acme", "a@x.com", "b@y.org", "z")])
    inferred = M.infer_schema(df)
    confirmed = M.confirmed_profile(spark, M.validate_mapping({"employer": ["BUS"], "email": ["E1", "E2"]}, df.columns))
    merged = M.merge_profile(inferred, confirmed)
    active = M.active_mapping(merged, df.columns)
    assert active == {"email": ["E1", "E2"], "employer": ["BUS"], "first_name": ["F_NM"]}
    row = M.apply_mapping(df, active).first()
    assert row.asDict() == {"email": ["a@x.com", "b@y.org"], "employer": "Acme", "first_name": "Ada", "Other": "z"}
    taken = M.confirmed_profile(spark, {"nickname": ["F_NM"]})
    assert set(profile_of(M.merge_profile(inferred, taken))) == {"nickname"}
    assert set(profile_of(M.merge_profile(inferred, taken, reset=True))) == {"first_name"}


@pytest.mark.parametrize(
    "mapping", [{"shoe_size": ["A"]}, {"city": ["A", "B"]}, {"city": ["C"]}, {"city": ["A"], "state": ["A"]}, {"city": ["B"]}]
)
def test_bad_mappings(mapping):
    with pytest.raises(ValueError):
        M.validate_mapping(mapping, ["A", "B"], ignored=["B"])


def test_metadata_masks_addresses(frame):
    df = frame(["mail", "n"], [("ada@a.com", "1"), ("ada@a.com", None), (None, "2")])
    got = {r["column"]: (r["type"], r["missing_count"], r["unique_count"], r["sample_values"]) for r in M.column_metadata(df).collect()}
    assert got == {"mail": ("text", 1, 1, ["a***@a.com"]), "n": ("text", 1, 2, ["1", "2"])}


def test_semantic_columns(frame):
    df = frame(["Email Status", "Home Email", "reach", "email notes", "City"], [("ok", "x", f"a{i}@b.co", "c@d.co", "Rome") for i in range(4)])
    assert M.semantic_columns(df, "email") == ["Home Email", "reach"]
    assert M.semantic_columns(df, "city") == ["City"]
    assert M.semantic_columns(df, "email", {"email": ["City"]}) == ["City"]


def test_no_task_of_schema_inference_gathers_partitions_or_values(spark):
    """Candidates are sent to one partition, not read from all of them by one task, and values are not grouped."""
    df = spark.createDataFrame([(i, f"p{i}@alpha.edu", 1990 + i) for i in range(9)], "_row_id long, PREF_EML string, CLASS_CD int")
    for found in (M.schema_conflicts(df), M.schema_summary(M.infer_schema(df), ["PREF_EML", "CLASS_CD"], M.schema_conflicts(df))):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Repartition 1, true" in plan and "Repartition 1, false" not in plan
        assert not re.search(r"Aggregate \[column#\d+L?, value#", plan)
    rates = {r["column"]: r for r in M.sample_rates(df).collect()}
    assert rates["PREF_EML"]["filled"] == 9 and rates["PREF_EML"]["email_rate"] == 1.0 and rates["CLASS_CD"]["year_rate"] == 1.0
