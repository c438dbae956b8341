"""Operators on hand-built rows: edge cases that the given tables don't have."""

import datetime as dt
import difflib
import random
import re
import unicodedata
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from candela.functions import keys, predicates, text
from candela.operators import audit, cases, detail, evidence, facts, graph, quality, resolution, signals, statistics, temporal, wealth
from candela.sources import feeds, registers

D = dt.datetime


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first().r


# ---- functions


@pytest.mark.parametrize("value", ["Straße GmbH", "ＡＢＣ Ltd.", "a_b-c", "", None, "  Éa\tb ", "İx", "Acme, Inc. & Co"])
def test_normalize_text(spark, value):
    folded = unicodedata.normalize("NFKC", value or "").casefold()
    assert one(spark, text.normalize_text, value) == " ".join(re.sub(r"[^\w\s]", " ", folded).split())


def test_legal_forms_are_dropped_repeatedly(spark):
    assert one(spark, lambda c: text.drop_legal_forms(text.normalize_text(c)), "ACME Holding Ltd. S.A. GmbH") == "acme holding ltd s a"
    assert one(spark, lambda c: text.drop_legal_forms(text.normalize_text(c)), "Acme Ltd GmbH") == "acme"
    assert one(spark, lambda c: text.drop_legal_forms(text.normalize_text(c)), "GmbH") == ""


@pytest.mark.parametrize(("value", "want"), [("1 250,5", Decimal("1250.5")), ("1.250,50", None), ("x", None), (None, None)])
def test_loose_decimal(spark, value, want):
    assert one(spark, text.loose_decimal, value) == want


@pytest.mark.parametrize(("value", "want"), [("2.50", Decimal("2.5")), ("<0.1", None), ("−3", Decimal(-3)), ("1e5", None), (" 7 ", Decimal(7)), (None, None)])
def test_strict_number(spark, value, want):
    assert one(spark, text.strict_number, value) == want


@pytest.mark.parametrize(("value", "want"), [("2.500000000000", "2.5"), ("100.000000000000", "100"), ("0.000000000000", "0"), ("-0.1200", "-0.12")])
def test_plain_number(spark, value, want):
    assert one(spark, lambda c: text.plain_number(c.cast("decimal(38,12)")), value) == want


@pytest.mark.parametrize(("value", "want"), [("http://x/resource/celex/32016R0679?a#b", "32016R0679"), ("http://x/resource/celex/3%3F1", "3"), ("http://x/other", None), ("http://x/resource/celex/", None), (None, None)])
def test_celex(spark, value, want):
    assert one(spark, text.celex_of, value) == want


def test_html_title(spark):
    assert one(spark, text.html_title, "<p><TITLE lang='x'> A &amp;\n B </title><title>C</title>") == "A & B"
    assert one(spark, text.html_title, "<title> </title>") is None


def test_trigrams_and_ratio(spark):
    got = spark.range(1).select(text.trigrams(F.lit("Ab c")).alias("g"), text.sequence_ratio(F.lit("abcd"), F.lit("abxd")).alias("r"), text.sequence_ratio(F.lit(""), F.lit("")).alias("z")).first()
    assert set(got.g) == {"  a", " ab", "ab ", "  c", " c "}
    assert got.r == difflib.SequenceMatcher(None, "abcd", "abxd").ratio() and got.z == 0


def test_overlaps_with_unbounded_sides(spark):
    rows = [(1, None, None), (2, 5, 7), (3, None, 2), (4, 9, None)]
    df = spark.createDataFrame(rows, "id int, a int, b int")
    got = {r.id for r in df.where(predicates.overlaps(F.col("a"), F.col("b"), F.lit(3), F.lit(8))).collect()}
    assert got == {1, 2}


def test_semantic_key_tells_nulls_from_text(spark):
    rows = spark.createDataFrame([("a", None), ("a", "~"), ("a", "")], "x string, y string").select(keys.fingerprint(F.col("x"), F.col("y")).alias("k"))
    assert len({r.k for r in rows.collect()}) == 3


# ---- temporal


LOG = "record_id string, version_id long, committed_at timestamp_ntz, operation string, value int"


def test_snapshot_ties_tombstones_and_late_rows(spark):
    rows = [("a", 1, D(2024, 1, 1), "INSERT", 1), ("a", 2, D(2024, 1, 1), "UPDATE", 2), ("b", 3, D(2024, 1, 1), "INSERT", 3), ("b", 4, D(2024, 1, 2), "DELETE", 3), ("c", 5, D(2024, 1, 3), "INSERT", 5)]
    log = spark.createDataFrame(rows, LOG)
    at = lambda day: {(r.record_id, r.value) for r in temporal.snapshot(log, F.lit(D(2024, 1, day)).cast("timestamp_ntz")).collect()}
    assert at(1) == {("a", 2), ("b", 3)} and at(2) == {("a", 2)} and at(3) == {("a", 2), ("c", 5)}
    # A later row never changes an earlier snapshot.
    more = log.unionByName(spark.createDataFrame([("a", 9, D(2024, 2, 1), "UPDATE", 9)], LOG))
    assert {(r.record_id, r.value) for r in temporal.snapshot(more, F.lit(D(2024, 1, 2)).cast("timestamp_ntz")).collect()} == at(2)
    intervals = temporal.knowledge_intervals(log)
    for day in (1, 2, 3):
        cut = spark.createDataFrame([(D(2024, 1, day),)], "known_at timestamp_ntz")
        assert {(r.record_id, r.value) for r in temporal.as_of_many(intervals, cut).collect()} == at(day)


def test_versions_without_receipt_are_invisible_and_fail_closed(spark):
    versions = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("other", 1, "c")], "cluster_id string, txn_id long, record_id string")
    receipts = spark.createDataFrame([("k", 1, D(2024, 1, 1))], "cluster_id string, txn_id long, committed_at timestamp_ntz")
    assert [r.record_id for r in temporal.with_commit_times(versions, receipts).collect()] == ["a"]
    with pytest.raises(RuntimeError):
        temporal.require_receipts(versions, receipts, 2)


# ---- graph


EDGE = "edge_id string, subject_id string, object_id string, valid_from timestamp_ntz, valid_to timestamp_ntz, observed_at timestamp_ntz, observation_count long"
REQUEST = "request_id int, source_id string, target_id string, from_time timestamp_ntz, to_time timestamp_ntz, top int"


def test_paths_share_an_interval(spark):
    year = lambda y: (D(y, 1, 1), D(y, 12, 31))
    edges = spark.createDataFrame(
        [("1", "a", "b", *year(2020), D(2020, 1, 1), 2), ("2", "c", "b", *year(2020), D(2020, 1, 2), 1), ("3", "c", "d", *year(2022), D(2022, 1, 1), 1), ("4", "b", "e", None, None, D(2020, 1, 1), 1), ("5", "e", "c", None, D(2020, 5, 1), D(2020, 1, 1), 5)],
        EDGE,
    )
    requests = spark.createDataFrame([(1, "a", "c", None, None, 10), (2, "a", "d", None, None, 10), (3, "a", "a", None, None, 10), (4, "a", "c", D(2021, 1, 1), None, 10), (5, "a", "c", None, None, 1)], REQUEST)
    got = [(r.request_id, r.rank, r.nodes, r.support, r.uncertain) for r in graph.find_paths(edges, requests, max_depth=4).orderBy("request_id", "rank").collect()]
    assert got == [(1, 1, ["a", "b", "c"], 3, False), (1, 2, ["a", "b", "e", "c"], 8, True), (3, 1, ["a"], 0, False), (5, 1, ["a", "b", "c"], 3, False)]
    with pytest.raises(graph.BudgetExceeded):
        graph.find_paths(edges, requests, degree_budget=0)


def test_keys_move_as_texts_and_end_as_digests(spark):
    rows = [(1, "r", "a", "REL", "b", None, None, D(2020, 1, 2), Decimal(1), "EUR"), (2, "r", "a", "REL", "b", None, None, D(2020, 1, 1), Decimal(2), "EUR"), (3, "q", "a", "REL", "b", None, D(2021, 1, 1), D(2020, 1, 1), None, None), (4, "q", "a", "REL", "a", None, None, D(2020, 1, 1), None, None)]
    seen = spark.createDataFrame(rows, "observation_id long, source_record_id string, subject_id string, relation string, object_id string, valid_from timestamp_ntz, valid_to timestamp_ntz, observed_at timestamp_ntz, amount decimal(24,6), currency string")
    keyed, texts = facts.keyed_observations(seen), facts.keyed_observations(seen, digest=False)
    assert sorted(map(tuple, texts.withColumn("semantic_key", facts.digested("semantic_key")).collect())) == sorted(map(tuple, keyed.collect()))
    expected = keys.semantic_key(*[F.col(c) for c in facts.PARTS])
    assert keyed.where(expected != F.col("semantic_key")).count() == 0 and sorted(r.observation_id for r in keyed.collect()) == [2, 3]
    # The digest is made after the rows have moved.
    plan = texts._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" not in plan


# ---- resolution


SIDE = "struct<entity_type: string, name: string, jurisdiction_code: string, address: string, identifiers: map<string,string>, directors: array<string>, incorporation_date: date>"


def test_pair_scoring_ladder(spark):
    org = lambda **k: {"entity_type": "ORGANIZATION", "name": "Acme Ltd", "jurisdiction_code": "SK", "address": "Main 1", "identifiers": {}, "directors": ["A B"], "incorporation_date": dt.date(2000, 1, 1)} | k
    pairs = [
        (org(), org(name="ACME GmbH"), 1.0, "AUTO_MERGE"),
        (org(identifiers={"lei": "x-1"}, name="Other"), org(identifiers={"LEI": "X1"}), 0.995, "AUTO_MERGE"),
        (org(identifiers={"lei": "1"}), org(identifiers={"LEI": "2"}), 0.0, "KEEP_SEPARATE"),
        (org(), org(entity_type="PERSON"), 0.0, "KEEP_SEPARATE"),
        (org(entity_type="PERSON"), org(entity_type="PERSON"), 1.0, "HUMAN_REVIEW"),
        (org(directors=None, address=None, jurisdiction_code=None), org(), 0.58, "KEEP_SEPARATE"),
    ]
    df = spark.createDataFrame([(a, b) for a, b, _, _ in pairs], f"left {SIDE}, right {SIDE}")
    got = [(r.score, r.decision) for r in resolution.score_pairs(df).collect()]
    assert got == [(s, d) for _, _, s, d in pairs]


def test_name_candidates_lose_no_pair(spark):
    rows = [(k, "ORGANIZATION", n, j) for k, (n, j) in enumerate([("acme holding company europe", "SK"), ("acme holding company europa", None), ("acme holding company europe", "CZ"), ("zeta", "SK"), ("", "SK")])]
    df = spark.createDataFrame(rows, "entity_id long, entity_type string, normalized_name string, jurisdiction_code string")
    got = {(r.entity_id, r.other_id) for r in resolution.name_candidates(df, threshold=0.8, top=None).collect()}
    assert got == {(0, 1), (1, 0), (1, 2), (2, 1)}


def test_resolution_order(spark):
    records = spark.createDataFrame([("f", "1", "LEI", "A", "SK"), ("f", "2", "LEI", "A", None), ("f", "3", "LEI", "B", "SK"), ("f", "4", None, None, None)], "source string, external_key string, scheme string, value string, country string")
    mappings = spark.createDataFrame([("f", "1", "mapped")], "source string, external_key string, entity_id string")
    ids = spark.createDataFrame([("old", "LEI", "A", "CZ", False, 1), ("good", "LEI", "A", None, True, 2)], "entity_id string, scheme string, value string, country string, verified boolean, created_at long")
    got = {r.external_key: (r.entity_id, r.method) for r in resolution.resolve(records, mappings, ids).collect()}
    assert got["1"] == ("mapped", "SOURCE_MAPPING") and got["2"] == ("good", "IDENTIFIER_MATCH") and got["3"][1] == got["4"][1] == "MINTED"


def test_resolution_meets_each_shared_value_once(spark):
    rng = random.Random(3)
    country, value = lambda: rng.choice(["SK", "CZ", None]), lambda: rng.choice(["A", "B", "C", "", None])
    ids = [(f"e{k}", rng.choice(["LEI", "VAT"]), rng.choice("ABD"), country(), rng.random() < 0.3, rng.randrange(4)) for k in range(60)]
    asked = [("f", str(k), rng.choice(["LEI", "VAT", None]), value(), country()) for k in range(80)] + [("f", "5", "LEI", "A", "SK")]
    records = spark.createDataFrame(asked, "source string, external_key string, scheme string, value string, country string")
    none = spark.createDataFrame([], "source string, external_key string, entity_id string")
    rows = resolution.resolve(records, none, spark.createDataFrame(ids, "entity_id string, scheme string, value string, country string, verified boolean, created_at long"))
    hits = {}
    for _, key, scheme, v, c in asked:
        hits.setdefault(key, []).extend((not ok, at, e) for e, s, w, d, ok, at in ids if v and (s, w) == (scheme, v) and (c is None or d is None or c == d))
    assert sorted((r.external_key, r.entity_id if r.method == "IDENTIFIER_MATCH" else None) for r in rows.collect()) == sorted((key, min(hits[key])[2] if hits[key] else None) for _, key, *_ in asked)
    # All records and identifiers share one value: rows of the joins stay those of the records.
    same = spark.range(3000).select(F.lit("f").alias("source"), F.col("id").cast("string").alias("external_key"), F.lit("VAT").alias("scheme"), F.lit("1").alias("value"), F.when(F.col("id") % 3 != 0, F.lit("SK")).alias("country"))
    known = spark.range(3000).select(F.concat(F.lit("e"), "id").alias("entity_id"), F.lit("VAT").alias("scheme"), F.lit("1").alias("value"), F.when(F.col("id") % 5 != 4, F.lit("SK")).alias("country"), F.lit(True).alias("verified"), F.col("id").alias("created_at"))
    plan = resolution.resolve(same, none, known)
    assert [tuple(r) for r in plan.groupBy("entity_id").count().collect()] == [("e0", 3000)]
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "known_country#" not in "".join(line for line in text.splitlines() if "Join" in line)


# ---- statistics, wealth


def test_recalculation_cases(spark):
    obs = spark.createDataFrame([(1, "x", 2000, Decimal(100), "a"), (1, "y", 2000, Decimal(116), "a"), (1, "x", 2001, None, "b"), (2, "x", 2000, Decimal(0), "a"), (2, "x", 2001, Decimal(5), "a")], "snapshot_id int, geography string, period long, number decimal(38,12), dimension string")
    spec = "spec_id string, snapshot_id int, operation string, dimension string, base_period long, current_period long"
    specs = spark.createDataFrame([("sum", 1, "sum_values", None, 0, 0), ("mean", 1, "mean_values", "a", 0, 0), ("none", 1, "sum_values", "b", 0, 0), ("odd", 1, "sum", None, 0, 0), ("null", 1, None, None, 0, 0), ("zero", 2, "percent_change", None, 2000, 2001), ("gap", 1, "percent_change", None, 2000, 2001), ("empty", 9, "count_observations", None, 0, 0)], spec)
    got = {r.spec_id: (r.status, r.result) for r in statistics.recalculate(obs, specs).collect()}
    assert got == {"sum": ("OK", Decimal(216)), "mean": ("OK", Decimal(108)), "none": ("NO_NUMERIC", None), "zero": ("ZERO_BASE", None), "gap": ("NO_NUMERIC", None), "empty": ("OK", Decimal(0)), "odd": ("UNKNOWN_OPERATION", None), "null": ("UNKNOWN_OPERATION", None)}


def test_wealth_bridge(spark):
    names = wealth.COMPONENTS
    schema = ", ".join(f"{c} decimal(24,6)" for c in [*names, "tolerance"])
    base = dict.fromkeys(names, Decimal(0)) | {"opening_net_worth": Decimal(100), "closing_net_worth": Decimal(50150), "income": Decimal(50), "tolerance": Decimal(1)}
    rows = [base, base | {"closing_net_worth": Decimal(150)}, base | {"gifts": None}]
    got = [(r.status, r.residual, r.missing_components) for r in wealth.reconcile(spark.createDataFrame([tuple(r[c] for c in [*names, "tolerance"]) for r in rows], schema)).collect()]
    assert got == [("REVIEW_REQUIRED", Decimal(50000), ""), ("RECONCILED", Decimal(0), ""), ("INCOMPLETE", None, "gifts")]


# ---- signals, facts, cases, audit, evidence


CLAIM = "claim_id string, verification_status string, superseded_at timestamp_ntz"


def test_conflict_scan_dates_and_live_claims(spark):
    ok = ("c", "UNVERIFIED", None)
    roles = [(1, 10, D(2020, 1, 1), D(2020, 6, 1), False, *ok), (2, 10, None, None, False, "c2", "UNVERIFIED", None), (1, 10, None, None, False, "x", "RETRACTED", None), (3, 10, None, None, True, *ok), (4, 10, None, None, None, "d", None, D(2021, 1, 1))]
    owns = [(k, 20, D(2019, 1, 1) if k == 1 else D(2021, 1, 1), None, *ok) for k in (1, 2, 3, 4)] + [(1, 20, None, None, "y", "UNVERIFIED", D(2020, 1, 1))]
    awards = [(100, 10, 20, dt.date(2020, 6, 1), *ok), (101, 10, 20, dt.date(2020, 6, 2), *ok), (102, 10, 20, None, *ok), (103, 10, 20, None, "z", "RETRACTED", None)]
    frames = [
        spark.createDataFrame(roles, f"person_id int, body_id int, valid_from timestamp_ntz, valid_to timestamp_ntz, is_demo boolean, {CLAIM}"),
        spark.createDataFrame(owns, f"person_id int, company_id int, valid_from timestamp_ntz, valid_to timestamp_ntz, {CLAIM}"),
        spark.createDataFrame(awards, f"award_id int, body_id int, company_id int, decision_date date, {CLAIM}"),
    ]
    found = signals.conflict_scan(*frames, known_at="2024-01-01")
    assert {(r.person_id, r.award_id, r.temporal_uncertainty) for r in found.collect()} == {(1, 100, False), (1, 102, True), (2, 102, True)}
    assert 3 in {r.person_id for r in signals.conflict_scan(*frames, known_at="2024-01-01", include_demo=True).collect()}
    # A scan at another cutoff, or on other claims, gives signals of its own.
    later = signals.conflict_scan(*frames, known_at="2024-02-01")
    assert signals.new_signals(later, found).count() == 3 and signals.new_signals(found, found).count() == 0
    other = signals.conflict_scan(frames[0].withColumn("claim_id", F.concat("claim_id", F.lit("-new"))), *frames[1:], known_at="2024-01-01")
    assert signals.new_signals(other, found).count() == 3


def test_verified_statuses(spark):
    rows = [("VERIFIED_PRIMARY", "FACT"), ("VERIFIED_AUTHORITATIVE", "FACT"), ("CORROBORATED", "FACT"), ("VERIFIED_PRIMARY", "HYPOTHESIS"), ("UNVERIFIED", "FACT"), (None, "FACT"), ("CORROBORATED", None)]
    df = spark.createDataFrame(rows, "s string, c string")
    assert df.where(predicates.verified_only(F.col("s"), F.col("c"))).count() == 3


def test_latency_percentiles_by_place(spark):
    import statistics as st

    from candela.operators import metrics

    values = {"a": [5, 1, 9, 9, 2, 7, 7, 7, 3], "b": list(range(1, 121)), "c": [4]}
    df = spark.createDataFrame([(k, Decimal(v)) for k, vs in values.items() for v in vs], "route string, latency decimal(24,6)")
    got = {r.route: (r.p50, r.p95, r.p99) for r in metrics.latency_percentiles(df, ["route"]).collect()}
    for k, vs in values.items():
        vs = sorted(vs)
        assert got[k] == (st.median(vs), *(vs[max(0, int(len(vs) * q) - 1)] for q in (0.95, 0.99)))


@pytest.mark.parametrize(("path", "want"), [("/api/v1/a/b/c", "/api/v1/a"), ("/api/internal/x/1", "/api/internal/x"), ("/api/public/r/2", "/api/public/r"), ("/api/other/a/b", "/api/other/a/b"), ("/health", "/health")])
def test_route_group(spark, path, want):
    assert one(spark, text.route_group, path) == want


@pytest.mark.parametrize("threshold", [0.4, 0.6, 0.8, 0.9])
def test_name_candidates_equal_brute_force(spark, threshold):
    import random

    pick = random.Random(int(threshold * 10))
    names = ["".join(pick.choice("abc ") for _ in range(pick.randint(1, 14))).strip() or "a" for _ in range(80)] + ["ab", "a", "a", "b"]
    rows = [(k, pick.choice(["PERSON", "ORGANIZATION"]), " ".join(n.split()), pick.choice([None, "SK", "CZ"])) for k, n in enumerate(names)]
    df = spark.createDataFrame(rows, "entity_id long, entity_type string, normalized_name string, jurisdiction_code string")
    grams = lambda n: {f"  {w} "[i : i + 3] for w in n.split() for i in range(len(w) + 1)}
    want = {}
    for a, ta, na, ja in rows:
        own = []
        for b, tb, nb, jb in rows:
            score = len(grams(na) & grams(nb)) / len(grams(na) | grams(nb))
            if a != b and ta == tb and (ja is None or jb is None or ja == jb) and score >= threshold:
                own.append((-score, b))
        want[a] = {b for _, b in sorted(own)}, [b for _, b in sorted(own)[:5]]
    every, best = {}, {}
    for r in resolution.name_candidates(df, threshold=threshold, top=None).collect():
        every.setdefault(r.entity_id, set()).add(r.other_id)
    for r in sorted(resolution.name_candidates(df, threshold=threshold).collect(), key=lambda r: r["rank"]):
        best.setdefault(r.entity_id, []).append(r.other_id)
    assert every == {a: w for a, (w, _) in want.items() if w}
    assert best == {a: w for a, (_, w) in want.items() if w}


def test_observations_fold_and_disagree(spark):
    schema = "observation_id long, source_record_id string, subject_id string, relation string, object_id string, valid_from timestamp_ntz, valid_to timestamp_ntz, observed_at timestamp_ntz, amount decimal(24,6), currency string"
    row = lambda i, record, amount, obj="b": (i, record, "a", "OWNS", obj, None, None, D(2024, 1, i), amount, "EUR")
    keyed = facts.keyed_observations(spark.createDataFrame([row(1, "r1", Decimal(5)), row(2, "r1", Decimal(6)), row(3, "r2", Decimal(7)), row(4, "r3", Decimal(5)), row(5, "r4", Decimal(5), "a")], schema))
    assert keyed.count() == 3
    edge = facts.canonical_edges(keyed).first()
    assert (edge.first_observation_id, edge.observation_count) == (1, 3)
    assert [(r.observation_a, r.observation_b, r.members, r.other_members) for r in facts.numeric_mismatches(keyed).collect()] == [(1, 3, 2, 1)]
    assert facts.claims_of(keyed).count() == 3


def test_case_fold(spark):
    events = [(1, k, a) for k, a in enumerate(["publish", "review", "publish", "appeal", "review", "publish", "withdraw"])]
    got = cases.case_states(spark.createDataFrame(events, "case_id int, seq int, action string")).first()
    assert (got.state, got.accepted, got.rejected, got.published) == ("WITHDRAWN", 6, 1, 2)


def test_audit_chain_shows_tampering(spark):
    events = spark.createDataFrame([("x", k, f"p{k}") for k in range(4)], "chain string, id int, body string")
    sealed = audit.seal(events, "chain", "id", ["id", "body"])
    assert audit.check(sealed, "chain", "id", ["id", "body"]).count() == 0
    bad = sealed.withColumn("body", F.when(F.col("id") == 2, "z").otherwise(F.col("body")))
    assert [r.id for r in audit.check(bad, "chain", "id", ["id", "body"]).collect()] == [2]


def test_map_merge_right_wins(spark):
    got = spark.range(1).select(evidence.merge_maps(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("1")), F.create_map(F.lit("b"), F.lit("2"))).alias("m")).first().m
    assert got == {"a": "1", "b": "2"}


def test_null_rules_count_as_broken(spark):
    df = spark.createDataFrame([(None, None, None, None, None)], "key string, name string, entity_type string, scheme string, identifier string").withColumn("country", F.lit(None).cast("string"))
    _, bad = quality.split(df, quality.entity_rules())
    assert bad.first().broken == ["key_length", "name_length", "entity_type"]


# ---- sources


def test_contracting_release_cases(spark):
    release = lambda **k: {"position": 0, "version": "1.1", "ocid": "o", "id": "1", "date": "2024-01-01", "buyer": {"id": "B"}, "parties": [{"id": "B", "name": "Buyer"}, {"id": "S", "name": ""}, {"id": "T", "name": "T"}], "awards": []} | k
    award = lambda i, suppliers, status="active": {"id": i, "status": status, "date": "2024-01-01", "value": {"amount": Decimal(5), "currency": "EUR"}, "suppliers": [{"id": s} for s in suppliers]}
    rows = [release(awards=[award("1", ["S"]), award("2", ["S", "T"]), award("3", ["S"], "pending"), award("4", ["U"])]), release(position=1, version="1.0"), release(position=2, ocid="p", buyer={"id": "Z"}, awards=[award("1", ["S"])])]
    import json

    text_rows = spark.createDataFrame([(json.dumps(r, default=str),) for r in rows], "j string")
    parsed = feeds.contracting_releases(text_rows.select(F.from_json("j", feeds.OCDS).alias("r")).select("r.*"))
    edges = [(r.relation, r.object, r.amount) for r in parsed.edges.collect()]
    assert sorted((e for e in edges if e[0] == "AWARDED_TO"), key=str) == [("AWARDED_TO", "o:party:S", Decimal(5)), ("AWARDED_TO", "o:party:S", None), ("AWARDED_TO", "o:party:T", None)]
    levels = sorted((r.level, r.locator) for r in parsed.problems.collect())
    assert levels == [("ERROR", "/releases/0/awards/3"), ("ERROR", "/releases/1"), ("ERROR", "/releases/2/awards/0"), ("WARNING", "/releases/0/awards/1"), ("WARNING", "/releases/0/awards/2")]
    assert {r.key: r.entity_type for r in parsed.entities.collect()}["o:party:B"] == "PUBLIC_BODY"


def test_legal_xml_is_read(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        """<rdf:RDF xmlns:rdf="r" xmlns:cdm="c" xmlns:owl="o" xmlns:x="y">
        <rdf:Description rdf:about="http://x/resource/celex/32016R0679"><cdm:work_cites_work rdf:resource="http://x/resource/celex/31995L0046"/>
        <cdm:work_cites_work rdf:resource="http://x/resource/celex/32016R0679"/><x:amends rdf:resource="http://x/resource/celex/3"/></rdf:Description>
        <rdf:Description rdf:about="http://x/other"><owl:sameAs rdf:resource="http://x/resource/celex/32016R0680"/><cdm:amends rdf:resource="http://x/resource/celex/32008F0977"/></rdf:Description>
        </rdf:RDF>"""
    )
    nodes = registers.read_legal_xml(spark, str(tmp_path / "a.xml"))
    got = {tuple(r) for r in registers.legal_relations(nodes, registers.relation_table(spark)).collect()}
    assert got == {("32016R0679", "CITES", "31995L0046"), ("32016R0680", "AMENDS", "32008F0977")}


def test_corrupt_lines_are_kept_apart(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"position": 1, "recordId": "r"}\n{"position": 2, "recor')
    rows = feeds.read_json(spark, str(tmp_path / "a.json"), feeds.RECORD).cache()
    assert rows.where("_corrupt_record is null").count() == 1 and rows.where("_corrupt_record is not null").count() == 1


def test_positional_zip(spark):
    v = F.parse_json(F.lit('{"n": ["A", "A", "B"], "i": ["1"]}'))
    got = spark.range(1).select(registers.parties(registers.strings(v, ".n"), registers.strings(v, ".i"), F.array().cast("array<string>")).alias("p")).first().p
    assert [(p["name"], p["identifier"], p["country"]) for p in got] == [("A", "1", None), ("B", None, None)]


def test_archive_lines_and_quarantine(spark, tmp_path):
    import zipfile

    from candela.sources import landing

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.json", '{"position": 1, "recordId": "r"}\n{"position": 2, "rec')
    lines = landing.archive_lines(spark, str(tmp_path))
    good, bad = landing.parse_lines(lines, feeds.RECORD)
    assert [r.recordId for r in good.collect()] == ["r"] and [r.line for r in bad.collect()] == [1]
    assert landing.landed_files(spark, str(tmp_path)).count() == 1


def test_stored_snapshot_must_exist(spark):
    from candela.sources import landing

    rows = spark.createDataFrame([("a", 1)], "source_record_id string, v int")
    assert landing.stored_snapshot(rows, "a").count() == 1
    with pytest.raises(LookupError):
        landing.stored_snapshot(rows, "b")


def test_import_quarantines_unresolved_edges(spark):
    from candela.operators import imports
    from candela.sources import landing

    rows = spark.createDataFrame(
        [([("a", "A", "ORGANIZATION", "LEI", "1", None), ("b", "", "PERSON", None, None, None)], [("a", "a", "OWNS", None, None, None, None, None, None, "/1"), ("a", "b", "OWNS", None, None, None, None, None, None, "/2")], ["w"])],
        landing.ENVELOPE,
    )
    tables = imports.import_tables(landing.normalized_envelopes(rows), "s", "1", spark.createDataFrame([], imports.NO_MAPPINGS), spark.createDataFrame([], imports.NO_IDENTIFIERS))
    assert tables["entities"].count() == 1 and tables["edges"].count() == 0
    assert sorted(r.reason for r in tables["quarantine"].collect()) == ["name_length", "self_edge", "unresolved_reference"]


def test_export_paths_ignore_time(spark):
    edges = spark.createDataFrame([("1", "a", "b"), ("2", "c", "b")], "edge_id string, subject_id string, object_id string")
    requests = spark.createDataFrame([(1, "a", "c", None, None, 5)], REQUEST)
    assert [r.nodes for r in graph.export_paths(edges, requests, 8).collect()] == [["a", "b", "c"]]
    with pytest.raises(ValueError, match="max_depth"):
        graph.export_paths(edges, requests, 99)


def test_request_rules(spark):
    rows = spark.createDataFrame([("percent_change", 1, 1), ("percent_change", 1, 2), ("sum_values", None, None), ("sum", None, None)], "operation string, base_period int, current_period int")
    good, bad = quality.split(rows, quality.recalculation_rules())
    assert good.count() == 2 and [r.broken for r in bad.orderBy("operation").collect()] == [["periods"], ["operation"]]


def test_literal_claims_are_kept_once(spark):
    from candela.operators import imports

    rows = spark.createDataFrame([("s", "p", "1", "r")] * 2, "subject_id string, predicate string, literal_value string, source_record_id string")
    assert imports.literal_claims(rows).count() == 1


def rows_moved(spark, act):
    """Rows that the shuffles of an action write."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def stages():
        found = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {found.apply(k).stageId(): found.apply(k).shuffleWriteRecords() for k in range(found.size())}

    before = stages()
    act()
    return sum(n for k, n in stages().items() if k not in before)


def test_only_disputed_observations_move_for_conflicts(spark):
    row = lambda k: (k, f"k{k // 2}", Decimal(k if k < 4 else 5), None if k == 5 else "EUR")
    keyed = spark.createDataFrame([row(k) for k in range(4000)], "observation_id long, semantic_key string, amount decimal(24,6), currency string")
    found = []
    assert rows_moved(spark, lambda: found.extend(facts.numeric_mismatches(keyed).collect())) < 2500
    assert sorted((r.semantic_key, r.observation_a, r.observation_b) for r in found) == [("k0", 0, 1), ("k1", 2, 3), ("k2", 4, 5)]
    named = lambda c: F.concat(F.lit("o"), c)
    own = keyed.select(named("observation_id").alias("observation_id"), F.col("semantic_key").alias("edge_id"), F.col("observation_id").alias("source_record_id"))
    pairs = spark.createDataFrame([(r.semantic_key, f"o{r.observation_a}", f"o{r.observation_b}") for r in found], "conflict_id string, observation_a string, observation_b string")
    edges = own.select("edge_id").distinct()
    got = []
    assert rows_moved(spark, lambda: got.extend(graph.provenance(edges, own, pairs).collect())) < 7000
    assert {r.edge_id for r in got if r.conflicts} == {"k0", "k1", "k2"} and len(got) == 2000 and all(r.observations == 2 for r in got)


def test_matched_parties_tell_what_they_leave_behind(spark):
    parties = spark.createDataFrame([("T", "1", "winner", 1, "A", "n1", "CZ"), ("T", "1", "winner", 2, "B", None, None), ("T", "2", "winner", 1, "C", "n 2", "CZ"), ("T", "2", "winner", 2, "D", "n3", None), ("T", "2", "winner", 2, "D", "n3", None)], "source string, notice_id string, role string, index int, name string, identifier string, country string")
    known = "entity_id string, scheme string, value string, country string, verified boolean, created_at long"
    identifiers = spark.createDataFrame([("e1", "NATIONAL_COMPANY_NUMBER", "N1", "CZ", True, 1), ("e2", "NATIONAL_COMPANY_NUMBER", "N1", None, True, 2), ("t3", "TED_ORG_IDENTIFIER", "N3", "SK", False, 1)], known)
    mappings = spark.createDataFrame([("T", "winner:1:2:b", "m")], "source string, external_key string, entity_id string")
    plain = detail.match_parties(parties, mappings, identifiers)
    told = detail.match_parties(parties, mappings, identifiers, told=True)
    assert sorted(map(str, told.select(plain.columns).collect())) == sorted(map(str, plain.collect()))
    for joined, kept in zip(detail.party_rows(parties, plain), detail.party_rows(parties, told)):
        assert joined.count() == 3
        assert sorted(map(str, kept.select(sorted(kept.columns)).collect())) == sorted(map(str, joined.select(sorted(joined.columns)).collect()))
