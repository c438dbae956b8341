"""Small rows for rules that the given tables' SQL alone does not pin down."""

import json
from datetime import datetime as D
from decimal import Decimal

from pyspark.sql import functions as F

from candela.operators import detail, quality
from candela.sources import registers


def payload(spark, *texts):
    return spark.createDataFrame([(t if isinstance(t, str) or t is None else json.dumps(t),) for t in texts], "payload string")


def lei(lei_id, name, **more):
    return {"id": lei_id, "attributes": {"lei": "A-" + (lei_id or "x"), "entity": {"legalName": {"name": name}, **more}}}


def test_lei_lists_give_their_first_record(spark):
    rows = payload(spark, {"data": [lei("1", "One"), lei("2", "Two")]}, {"data": lei("3", "Three", legalAddress={"country": "FR"})}, {"data": lei(None, "Four")}, {"data": []}, {"data": lei("5", None)}, {"other": 1}, "no json", None)
    records, problems = registers.lei_payloads(rows)
    assert {(r.lei, r.name, r.jurisdiction) for r in records.collect()} == {("1", "One", None), ("3", "Three", "FR"), ("A-x", "Four", None)}
    assert sorted(r.reason for r in problems.collect()) == ["payload holds no record"] * 4 + ["record lacks LEI or legal name"]


def test_tender_rows_are_found_under_four_names_and_inside(spark):
    row = lambda k: {"publication-number": k, "title-proc": {"en": f"T{k}"}, "result-value-notice": "5", "total-value": "7", "total-value-cur": "euro"}
    rows = payload(spark, {"notices": [row("1"), 5, "x"], "items": [row("0")]}, {"data": {"results": [row("2")]}}, {"results": {"items": [row("3")]}}, {"data": [row("4"), {"a": 1}]}, row("5"), {"notices": {}, "items": [row("6")]}, None)
    found = registers.tender_payload_rows(rows)
    got = {(r.publication_number, r.title, r.total_value, r.currency) for r in registers.tender_rows(found).collect()}
    assert got == {(k, f"T{k}", Decimal(5), "EUR"[:3]) for k in "12346"}
    assert [json.loads(r.payload) for r in registers.tender_problems(found).collect()] == [{"a": 1}]


def test_a_title_falls_back_to_the_number(spark):
    got = registers.tender_rows(payload(spark, {"notice-identifier": "9", "title-proc": " "})).first()
    assert got.title == "TED notice 9"


def test_the_last_end_of_a_job_stands(spark):
    log = spark.createDataFrame(
        [("a", 1, D(2024, 1, 1), "RUNNING", None, None, None), ("a", 2, D(2024, 1, 2), "FAILED", None, "f1", "boom"), ("a", 3, D(2024, 1, 3), "SUCCEEDED", "r", "f2", None), ("b", 4, D(2024, 1, 1), "RUNNING", None, None, None)],
        "job_id string, seq long, at timestamp_ntz, status string, source_record_id string, raw_artifact_id string, error string",
    )
    got = {r.job_id: tuple(r)[1:] for r in detail.current_jobs(log).collect()}
    assert got == {"a": (D(2024, 1, 1), D(2024, 1, 3), "SUCCEEDED", "r", "f2", None, 3), "b": (D(2024, 1, 1), None, "RUNNING", None, None, None, 1)}


def test_a_seed_wins_with_its_nulls(spark):
    shape = "name string, url string, publisher string, source_type string, is_active boolean"
    old = spark.createDataFrame([("id1", "A", "old", "u", "p", "t", False), ("id2", "B", "kept", "u", "p", "t", False)], f"source_id string, code string, {shape}")
    new = spark.createDataFrame([("A", "new", None, "q", None, None), ("C", "made", "v", None, "t", False)], f"code string, {shape}")
    got = {r.code: tuple(r)[1:] for r in detail.upsert_sources(old, new).collect()}
    assert got["A"] == ("id1", "new", None, "q", None, True, "UPDATED")
    assert got["B"] == ("id2", "kept", "u", "p", "t", False, "KEPT")
    assert got["C"][1:] == ("made", "v", None, "t", False, "CREATED")


def test_only_the_source_marks_a_case_synthetic(spark):
    cases = spark.createDataFrame([(1,), (2,), (3,)], "case_id int")
    claims = spark.createDataFrame([(1, 10), (2, 20)], "case_id int, claim_id int")
    evidence = spark.createDataFrame([(10, 100), (20, 200)], "claim_id int, source_record_id int")
    records = spark.createDataFrame([(100, 1, True), (200, 2, False)], "source_record_id int, source_id int, is_demo boolean")
    sources = spark.createDataFrame([(1, False), (2, True)], "source_id int, is_demo boolean")
    got = {r.case_id: (r.evidence, r.synthetic) for r in detail.synthetic_cases(cases, claims, evidence, records, sources).collect()}
    assert got == {1: (1, False), 2: (1, True), 3: (0, False)}


def test_countries_are_two_characters_and_amounts_fit(spark):
    rows = spark.createDataFrame([("k", "n", "PERSON", None, None, c) for c in ("cz", "CZ", "C", "CZE", None)], "key string, name string, entity_type string, scheme string, identifier string, country string")
    _, bad = quality.split(rows, quality.entity_rules())
    assert sorted(r.country for r in bad.collect()) == ["C", "CZE"]
    edges = spark.createDataFrame([(Decimal(a),) for a in ("1.5", "0.0000001", "999999999999999999", "9999999999999999999")], "amount decimal(38,12)")
    found = edges.select("amount", quality.broken_rules({"amount": quality.edge_rules()["amount"]}).alias("b")).collect()
    assert [bool(r.b) for r in found] == [False, True, False, True]


def test_parties_leave_identifiers_and_mappings_under_normal_forms(spark):
    parties = spark.createDataFrame(
        [("TED", "n1", "winner", 0, "Ácme, GmbH", "cz 12-3", "CZ"), ("TED", "n1", "winner", 1, "Ácme, GmbH", None, "CZ"), ("TED", "n2", "buyer", 0, "Town  Hall", " ", None), ("TED", "n3", "winner", 0, "Known", "7", "CZ")],
        "source string, notice_id string, role string, index int, name string, identifier string, country string",
    )
    identifiers = spark.createDataFrame([("e1", "NATIONAL_COMPANY_NUMBER", "CZ123", "CZ", True, 1)], "entity_id string, scheme string, value string, country string, verified boolean, created_at long")
    mappings = spark.createDataFrame([("TED", "winner:n3:0:7", "m1")], "source string, external_key string, entity_id string")
    matched = detail.match_parties(parties, mappings, identifiers)
    got = {r.external_key: (r.entity_id, r.method) for r in matched.collect()}
    assert set(got) == {"winner:n1:0:CZ123", "winner:n1:1:ácme", "buyer:n2:0:town hall", "winner:n3:0:7"}
    assert got["winner:n1:0:CZ123"] == ("e1", "CROSS_SOURCE_NATIONAL_ID_MATCH") and got["winner:n3:0:7"] == ("m1", "SOURCE_MAPPING")
    ids, rows = detail.party_rows(parties, matched)
    assert {(r.scheme, r.value, r.verified) for r in ids.collect()} == {("TED_ORG_IDENTIFIER", "CZ123", True), ("SOURCE:TED", "winner:n1:1:ácme", True), ("SOURCE:TED", "buyer:n2:0:town hall", True)}
    assert {(r.external_key, r.method, r.confidence) for r in rows.collect()} == {("winner:n1:0:CZ123", "CROSS_SOURCE_NATIONAL_ID_MATCH", 1.0), ("winner:n1:1:ácme", "SOURCE_SCOPED_ID", 1.0), ("buyer:n2:0:town hall", "SOURCE_SCOPED_ID", 1.0)}


def test_only_active_observations_count_and_details_merge(spark):
    from candela.operators import facts

    rows = [("r1", "k", 1, D(2024, 1, 1), Decimal(5), "ACTIVE", {"a": "1", "b": "1"}), ("r2", "k", 2, D(2024, 1, 2), Decimal(6), "SUPERSEDED", {"a": "x"}), ("r3", "k", 3, D(2024, 1, 3), Decimal(7), "ACTIVE", {"b": "2"}), ("r4", "j", 4, D(2024, 1, 1), None, "ACTIVE", None)]
    keyed = spark.createDataFrame(rows, "source_record_id string, semantic_key string, observation_id long, observed_at timestamp_ntz, amount decimal(24,6), observation_status string, details map<string,string>")
    for c in ("subject_id", "relation", "object_id", "currency"):
        keyed = keyed.withColumn(c, F.lit(c))
    for c in ("valid_from", "valid_to"):
        keyed = keyed.withColumn(c, F.lit(None).cast("timestamp_ntz"))
    got = {r.semantic_key: (r.observation_count, r.first_observation_id, r.details) for r in facts.canonical_edges(keyed).collect()}
    assert got == {"k": (2, 1, {"a": "1", "b": "2"}), "j": (1, 4, None)}
    assert [(r.observation_a, r.observation_b) for r in facts.numeric_mismatches(keyed).collect()] == [(1, 3)]
    links = facts.evidence_links(keyed.unionByName(keyed).withColumn("locator", F.lit("/x"))).collect()
    assert len(links) == 4 and {(r.evidence_strength, r.locator) for r in links} == {("E1", "/x")}


def test_parties_are_made_distinct_once(spark):
    parties = spark.createDataFrame([("TED", "n1", "winner", 0, "Known", "7", "CZ")] * 2, "source string, notice_id string, role string, index int, name string, identifier string, country string")
    identifiers = spark.createDataFrame([], "entity_id string, scheme string, value string, country string, verified boolean, created_at long")
    matched = detail.match_parties(parties, spark.createDataFrame([("TED", "winner:n1:0:7", "m1")], "source string, external_key string, entity_id string"), identifiers)
    assert [(r.external_key, r.entity_id) for r in matched.collect()] == [("winner:n1:0:7", "m1")]
    # All branches read what that gave.
    assert matched.inputFiles() and all("/parties-" in f for f in matched.inputFiles())


def test_tender_rows_are_parsed_once(spark):
    plan = registers.tender_rows(payload(spark, {"notice-identifier": "9"}))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json") + plan.count("parseJson") == 1
