"""Queries on knowledge time, facts, signals and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from candela.functions.predicates import live, verified_only
from candela.operators import facts, graph, signals, temporal, versions
from candela.plans import views
from candela.session import fresh_path, staged
from candela.plans.views import money, stamp, table

CUTOFF = "2024-01-15"


def asof_snapshot(spark, sf_dir):
    """W1."""
    return temporal.snapshot(views.version_log(spark, sf_dir), views.stamp(CUTOFF)).select("record_id", "version_id", "committed_at", "event_type", "value")


def asof_many_cutoffs(spark, sf_dir):
    """Live records and their value at each of four weekly cutoffs."""
    cutoffs = spark.range(4).select((views.stamp("2024-01-08") + F.make_dt_interval(F.col("id").cast("int") * 7)).alias("known_at"))
    rows = temporal.as_of_many(temporal.knowledge_intervals(views.version_log(spark, sf_dir)), cutoffs)
    return rows.groupBy("known_at").agg(F.count(F.lit(1)).alias("live"), F.sum("value").cast("decimal(34,6)").alias("total"))


def snapshot_diff(spark, sf_dir):
    """K4."""
    log = views.version_log(spark, sf_dir)
    return temporal.snapshot_diff(temporal.snapshot(log, views.stamp(CUTOFF)), temporal.snapshot(log, views.stamp("2024-01-22")), "record_id", ["event_type", "value"])


def asof_every_purchase(spark, sf_dir):
    """What was live at the time of each purchase."""
    log = views.version_log(spark, sf_dir)
    cutoffs = log.where("event_type = 'purchase'").select(F.col("committed_at").alias("known_at")).distinct()
    rows = temporal.live_totals(temporal.knowledge_intervals(log), cutoffs, "value")
    return rows.withColumn("total", F.col("total").cast("decimal(34,6)"))


def version_capture(spark, sf_dir):
    """Customers loaded three times into a version store: its images, and its snapshots before and after they are compacted."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("record_id"), F.col("c_mktsegment").alias("segment"), money("c_acctbal").alias("balance"))
    key = F.col("record_id")
    loads = [
        c.where(key % 5 != 0),
        c.where(key % 7 != 0).withColumn("balance", F.when(key % 3 == 0, F.col("balance") + 1).when(key % 11 == 0, F.lit(None)).otherwise(F.col("balance")).cast("decimal(24,6)")),
        c.where(key % 2 == 0),
    ]
    store = versions.VersionStore(spark, fresh_path(spark, "versions"), "record_id", {"record_id": "bigint", "segment": "string", "balance": "decimal(24,6)"})
    days = [f"2024-0{k}-01" for k in (1, 2, 3)]
    for rows, day in zip(loads, days):
        store.load(rows, stamp(day))
    columns = ["record_id", "segment", "balance"]
    part = lambda rows, name, operation: rows.select(F.lit(name).alias("part"), operation.alias("operation"), *columns)
    out = staged(part(store.log(), "image", F.col("operation")), "images")
    for day in days:
        out = out.unionByName(staged(part(store.snapshot(stamp(day)), day, F.lit(None).cast("string")), "snapshot"))
    store.compact(2)
    for day in days[1:]:
        out = out.unionByName(part(store.snapshot(stamp(day)), f"{day} compacted", F.lit(None).cast("string")))
    return out


def cutoff_status(spark, sf_dir):
    """orders' dates as cutoffs against a history from 1996 to 2001."""
    requests = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderdate")).alias("known_at"))
    rows = temporal.cutoff_status(requests, views.stamp("1996-01-01"), views.stamp("2001-01-01"))
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("requests"), F.min("resolved_at").alias("earliest"))


def conflict_scan(spark, sf_dir):
    """J4/P12/B17."""
    return signals.conflict_scan(views.roles(spark, sf_dir), views.owns(spark, sf_dir), views.awards(spark, sf_dir), CUTOFF)


def conflict_signals(spark, sf_dir):
    """Signals that aren't known, after their first reviews."""
    found = conflict_scan(spark, sf_dir)
    known = found.where("award_id % 7 = 0")
    new = signals.new_signals(found, known)
    reviews = found.where("award_id % 3 = 0").select("fingerprint", F.when(F.col("award_id") % 2 == 0, "DISMISSED").otherwise("ESCALATED").alias("decision"), F.col("decision_date").alias("reviewed_at"), F.col("award_id").alias("review_id"))
    return signals.review_signals(new, reviews).groupBy("status").agg(F.count(F.lit(1)).alias("signals"))


def _keyed(spark, sf_dir, digest=False):
    return facts.keyed_observations(views.observations(spark, sf_dir), digest)


def canonical_edges(spark, sf_dir):
    """B1/F7/W4/W8/G7."""
    return facts.canonical_edges(_keyed(spark, sf_dir)).select(facts.digested("semantic_key").alias("semantic_key"), "subject_id", "object_id", "observed_at", "observation_count")


def numeric_mismatch(spark, sf_dir):
    """B5/J8."""
    return facts.numeric_mismatches(_keyed(spark, sf_dir)).select(facts.digested("semantic_key").alias("semantic_key"), "observation_a", "observation_b", "members", "other_members", "conflict_type")


def edge_support(spark, sf_dir):
    """How many edges have how much support."""
    return facts.canonical_edges(_keyed(spark, sf_dir)).groupBy("observation_count").agg(F.count(F.lit(1)).alias("edges"))


def fact_claims(spark, sf_dir):
    """Claims per predicate."""
    return facts.claims_of(_keyed(spark, sf_dir, digest=True)).groupBy("predicate", "claim_type", "verification_status").agg(F.count(F.lit(1)).alias("claims"), F.countDistinct("source_record_id").alias("records"))


def money_flows(spark, sf_dir):
    """A flow per order with a single supplier."""
    rows = views.notices(spark, sf_dir).where(F.size("winners") == 1)
    awards = rows.select(F.col("buyers")[0].alias("payer_id"), F.col("winners")[0].alias("recipient_id"), F.col("total_value").alias("amount"), "currency", F.col("decision_date").alias("flow_date"), F.col("notice_id").alias("contract_id"), F.sha2("notice_id", 256).alias("claim_id"))
    return facts.money_flows(awards)


def ownership_rows(spark, sf_dir):
    """B7/J13."""
    owns = views.owns(spark, sf_dir)
    kind = F.when(F.col("person_id") % 2 == 0, "OWNS").otherwise("BENEFICIAL_OWNER_OF")
    edges = owns.select(F.col("person_id").alias("subject_id"), F.col("company_id").alias("object_id"), kind.alias("relation"), (F.col("person_id") % 101).cast("decimal(7,4)").alias("ownership_percent"), "valid_from", "valid_to", F.col("person_id").alias("claim_id"))
    return facts.ownership_interests(edges, edges.where("claim_id % 5 = 0")).select("claim_id", "owner_id", "owned_id", "basis", "ownership_percent")


def award_rows(spark, sf_dir):
    """B8."""
    return facts.award_rows(views.notices(spark, sf_dir)).select("notice_id", "buyer_id", "winner_id", "amount", "decision_date")


def tender_builder(spark, sf_dir):
    """B10/J17."""
    return facts.notice_edges(views.notices(spark, sf_dir))


def temporal_paths(spark, sf_dir):
    """PF1-PF3 on all edges, up to six hops."""
    rows, _ = graph.search_paths(views.all_edges(spark, sf_dir), views.path_requests(spark, sf_dir))
    return rows.select("request_id", "rank", F.col("hops").cast("long").alias("hops"), F.array_join("nodes", ">").alias("nodes"), F.array_join("edge_ids", ">").alias("edge_ids"), "common_from", "common_to", "uncertain", "support")


def paths_batch(spark, sf_dir):
    """PF4/T4: each request's outcome, on all edges, up to six hops."""
    edges = views.all_edges(spark, sf_dir)
    entities = edges.select(F.explode(F.array("subject_id", "object_id")).alias("entity_id")).distinct()
    return graph.investigate(edges, entities, views.path_requests(spark, sf_dir))


def _entities(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("entity_id"), F.lit("PUBLIC_BODY").alias("entity_type"), F.col("c_name").alias("name"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("entity_id"), F.lit("ORGANIZATION").alias("entity_type"), F.col("s_name").alias("name"))
    return c.unionByName(s)


def entity_summary(spark, sf_dir):
    """J7/V12."""
    orders = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_custkey")).alias("entity_id"), F.col("o_orderpriority").alias("identifier_id"))
    edges = views.all_edges(spark, sf_dir).select("edge_id", "subject_id", "object_id")
    return graph.entity_summary(_entities(spark, sf_dir), orders, edges)


def verified_edges(spark, sf_dir):
    """Live edges on verified claims."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "VERIFIED_PRIMARY").when(F.col("o_orderstatus") == "O", "UNVERIFIED")
    kind = F.when(F.col("o_orderkey") % 5 == 0, "HYPOTHESIS").otherwise("FACT")
    gone = F.when(F.col("o_orderkey") % 11 == 0, F.col("o_orderdate"))
    rows = o.select("o_orderkey", status.alias("status"), kind.alias("claim_type"), gone.alias("superseded_at"))
    return rows.where(live(F.col("superseded_at"), F.col("status")) & verified_only(F.col("status"), F.col("claim_type"))).select("o_orderkey", "status", "claim_type")


def graph_export(spark, sf_dir):
    """K5: node and edge rows."""
    edges = views.all_edges(spark, sf_dir).select("edge_id", "subject_id", "object_id", F.lit("AWARDED_TO").alias("relation"), "valid_from", "valid_to", F.col("edge_id").alias("claim_id"))
    claims = edges.where(F.col("edge_id").endswith("0")).select("claim_id", F.lit("VERIFIED_PRIMARY").alias("verification_status"))
    nodes, rows = graph.export(_entities(spark, sf_dir), edges, claims)
    none = F.lit(None).cast("timestamp_ntz")
    shown = nodes.select(F.lit("node").alias("part"), F.col("entity_id").alias("a"), F.col("name").alias("b"), F.col("entity_type").alias("kind"), none.alias("valid_from"), none.alias("valid_to"))
    return shown.unionByName(rows.select(F.lit("edge").alias("part"), F.col("subject_id").alias("a"), F.col("object_id").alias("b"), F.col("status").alias("kind"), "valid_from", "valid_to"))


def edge_provenance(spark, sf_dir):
    """PF6: canonical edges with their observations and conflicts."""
    keyed = staged(_keyed(spark, sf_dir), "keyed")
    edges = facts.canonical_edges(keyed).select(F.col("semantic_key").alias("edge_id"), "subject_id", "object_id")
    named = lambda c: F.concat_ws("/", "semantic_key", c)  # noqa: E731  observations are numbered within their key
    own = keyed.select(named("observation_id").alias("observation_id"), F.col("semantic_key").alias("edge_id"), "source_record_id")
    conflicts = facts.numeric_mismatches(keyed).select(F.concat_ws("-", named("observation_a"), "observation_b").alias("conflict_id"), named("observation_a").alias("observation_a"), named("observation_b").alias("observation_b"))
    return graph.provenance(edges, own, conflicts).select(facts.digested("edge_id").alias("edge_id"), "observations", F.size("sources").cast("long").alias("records"), "conflicts")


QUERIES = {f.__name__: f for f in (asof_snapshot, asof_many_cutoffs, asof_every_purchase, version_capture, snapshot_diff, cutoff_status, conflict_scan, conflict_signals, canonical_edges, numeric_mismatch, edge_support, fact_claims, money_flows, ownership_rows, award_rows, tender_builder, temporal_paths, paths_batch, entity_summary, verified_edges, graph_export, edge_provenance)}

_SNAP = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY committed_at DESC, version_id DESC) AS rn FROM ({views.LOG}) WHERE committed_at <= TIMESTAMP '@') WHERE rn = 1 AND operation <> 'DELETE')"
_SCAN = f"""
SELECT r.person_id, r.body_id, o.company_id, a.award_id, a.decision_date, true AS temporal_uncertainty,
  sha256('={CUTOFF}|=r-' || r.person_id || '-' || r.body_id || '|=o-' || r.person_id || '|=a-' || a.award_id || '-' || o.company_id || '|=' || a.award_id) AS fingerprint
FROM (SELECT a.c_custkey AS person_id, b.c_custkey AS body_id, DATE '1992-01-01' + CAST(a.c_custkey % 2000 AS INTEGER) AS since FROM customer a JOIN customer b ON b.c_custkey > a.c_custkey AND b.c_custkey <= a.c_custkey + 10
  WHERE b.c_custkey % 17 <> 0 AND a.c_custkey % 29 <> 0 AND a.c_custkey % 23 <> 0) r
JOIN (SELECT c_custkey AS person_id, c_custkey % (SELECT count(*) FROM supplier) AS company_id FROM customer WHERE c_custkey % 31 <> 0 AND c_custkey % 13 <> 0) o USING (person_id)
JOIN (SELECT DISTINCT o_orderkey AS award_id, o_custkey AS body_id, l_suppkey AS company_id, CAST(o_orderdate AS DATE) AS decision_date FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' AND o_orderkey % 19 <> 0) a
  ON a.body_id = r.body_id AND a.company_id = o.company_id
WHERE r.since <= a.decision_date
"""


def levels_sql(depth: int, timed: bool = True) -> str:
    """Breadth-first search in levels: a request that has its first paths leaves the frontier, and others go on."""
    started, lasts, seen, support = ("valid_from", "valid_to", "valid_from", "n") if timed else ("NULL::TIMESTAMP", "NULL::TIMESTAMP", "TIMESTAMP '1970-01-01'", "1")
    parts = [
        f"WITH e AS ({views.ALL_EDGES})",
        f"adj AS MATERIALIZED (SELECT a AS src, b AS dst, edge_id, {started} AS valid_from, {lasts} AS valid_to, {seen} AS seen, {support} AS n FROM e UNION ALL SELECT b, a, edge_id, {started}, {lasts}, {seen}, {support} FROM e)",
        f"req AS (SELECT * FROM ({views.PATH_REQUESTS}) WHERE target_id IN (SELECT src FROM adj))",
        "p0 AS (SELECT request_id, target_id, source_id AS tail, [source_id] AS nodes, CAST([] AS STRUCT(t TIMESTAMP, id VARCHAR)[]) AS keys, CAST(NULL AS TIMESTAMP) AS lo, CAST(NULL AS TIMESTAMP) AS hi, CAST(0 AS BIGINT) AS support, top AS need FROM req)",
    ]
    step = "request_id, target_id, dst AS tail, list_append(nodes, dst) AS nodes, list_append(keys, {'t': seen, 'id': edge_id}) AS keys, greatest(lo, valid_from) AS lo, least(hi, valid_to) AS hi, CAST(support + n AS BIGINT) AS support, need"
    fits = "NOT list_contains(nodes, dst) AND coalesce(greatest(lo, valid_from) <= least(hi, valid_to), true)"
    for k in range(1, depth + 1):
        parts += [
            f"f{k} AS MATERIALIZED (SELECT *, {k} AS hops FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY keys) AS rn FROM (SELECT {step} FROM p{k - 1} JOIN adj ON tail = src AND dst = target_id WHERE {fits})) WHERE rn <= need)",
            f"c{k} AS (SELECT request_id, count(*) AS got FROM f{k} GROUP BY 1)",
            f"p{k} AS MATERIALIZED (SELECT {step.replace('need', 'need - coalesce(got, 0) AS need')} FROM p{k - 1} LEFT JOIN c{k} USING (request_id) JOIN adj ON tail = src AND dst <> target_id WHERE need > coalesce(got, 0) AND {fits})",
        ]
    parts.append("first AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY hops, keys) AS found FROM (" + " UNION ALL ".join(f"SELECT * FROM f{k}" for k in range(1, depth + 1)) + "))")
    return ", ".join(parts)


_PATHS = levels_sql(6)

ORACLE_SQL = {
    "asof_snapshot": f"SELECT record_id, version_id, committed_at, event_type, value FROM {_SNAP.replace('@', CUTOFF)}",
    "asof_many_cutoffs": f"""
WITH v AS (SELECT *, lead(committed_at) OVER (PARTITION BY record_id ORDER BY committed_at) AS until FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_id, committed_at ORDER BY version_id DESC) AS rn FROM ({views.LOG})) WHERE rn = 1)),
c AS (SELECT TIMESTAMP '2024-01-08' + to_days(CAST(i * 7 AS INTEGER)) AS known_at FROM range(4) t(i))
SELECT known_at, count(*) AS live, CAST(sum(value) AS DECIMAL(34,6)) AS total FROM v JOIN c ON committed_at <= known_at AND (until IS NULL OR known_at < until) WHERE operation <> 'DELETE' GROUP BY 1""",
    "asof_every_purchase": f"""
WITH v AS (SELECT *, lead(committed_at) OVER (PARTITION BY record_id ORDER BY committed_at) AS until FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_id, committed_at ORDER BY version_id DESC) AS rn FROM ({views.LOG})) WHERE rn = 1)),
d AS (SELECT committed_at AS t, CASE WHEN operation <> 'DELETE' THEN 1 END AS n, CASE WHEN operation <> 'DELETE' THEN value END AS value FROM v
  UNION ALL SELECT until, CASE WHEN operation <> 'DELETE' THEN -1 END, CASE WHEN operation <> 'DELETE' THEN -value END FROM v WHERE until IS NOT NULL),
r AS (SELECT DISTINCT t, sum(n) OVER (ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS live, sum(value) OVER (ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM d)
SELECT t AS known_at, CAST(live AS BIGINT) AS live, CAST(total AS DECIMAL(34,6)) AS total FROM r WHERE t IN (SELECT ts FROM events WHERE event_type = 'purchase') AND live > 0""",
    "version_capture": """
WITH c AS (SELECT c_custkey AS k, c_mktsegment AS s, CAST(c_acctbal AS DECIMAL(24,6)) AS b FROM customer),
l1 AS (SELECT * FROM c WHERE k % 5 <> 0), l2 AS (SELECT k, s, CASE WHEN k % 3 = 0 THEN CAST(b + 1 AS DECIMAL(24,6)) WHEN k % 11 = 0 THEN NULL ELSE b END AS b FROM c WHERE k % 7 <> 0), l3 AS (SELECT * FROM c WHERE k % 2 = 0),
i AS (
  SELECT 'BASELINE' AS operation, k, s, b FROM l1
  UNION ALL SELECT CASE WHEN l1.k IS NULL THEN 'INSERT' WHEN l2.k IS NULL THEN 'DELETE' ELSE 'UPDATE' END, coalesce(l2.k, l1.k), coalesce(l2.s, l1.s), CASE WHEN l2.k IS NULL THEN l1.b ELSE l2.b END FROM l1 FULL JOIN l2 ON l1.k = l2.k WHERE l1.k IS NULL OR l2.k IS NULL OR l1.b IS DISTINCT FROM l2.b
  UNION ALL SELECT CASE WHEN l2.k IS NULL THEN 'INSERT' WHEN l3.k IS NULL THEN 'DELETE' ELSE 'UPDATE' END, coalesce(l3.k, l2.k), coalesce(l3.s, l2.s), CASE WHEN l3.k IS NULL THEN l2.b ELSE l3.b END FROM l2 FULL JOIN l3 ON l2.k = l3.k WHERE l2.k IS NULL OR l3.k IS NULL OR l2.b IS DISTINCT FROM l3.b)
SELECT 'image' AS part, operation, k AS record_id, s AS segment, b AS balance FROM i
UNION ALL SELECT '2024-01-01', NULL, k, s, b FROM l1 UNION ALL SELECT '2024-02-01' || x, NULL, k, s, b FROM l2, (VALUES (''), (' compacted')) t(x) UNION ALL SELECT '2024-03-01' || x, NULL, k, s, b FROM l3, (VALUES (''), (' compacted')) t(x)""",
    "snapshot_diff": f"""
WITH a AS {_SNAP.replace("@", CUTOFF)}, b AS {_SNAP.replace("@", "2024-01-22")}
SELECT * FROM (SELECT coalesce(a.record_id, b.record_id) AS record_id, CASE WHEN a.record_id IS NULL THEN 'INSERT' WHEN b.record_id IS NULL THEN 'DELETE' WHEN (a.event_type, a.value) <> (b.event_type, b.value) THEN 'UPDATE' END AS operation
FROM a FULL JOIN b ON a.record_id = b.record_id) WHERE operation IS NOT NULL""",
    "cutoff_status": """
SELECT status, count(*) AS requests, min(c) AS earliest FROM (SELECT c, CASE WHEN c > TIMESTAMP '2001-01-01' THEN 'FUTURE' WHEN c < TIMESTAMP '1996-01-01' THEN 'HISTORY_UNAVAILABLE' ELSE 'OK' END AS status
FROM (SELECT coalesce(CASE WHEN o_orderkey % 10 <> 0 THEN o_orderdate END, TIMESTAMP '2001-01-01') AS c FROM orders)) GROUP BY 1""",
    "conflict_scan": _SCAN,
    "conflict_signals": f"""
SELECT CASE WHEN award_id % 3 <> 0 THEN 'OPEN' WHEN award_id % 2 = 0 THEN 'DISMISSED' ELSE 'ESCALATED' END AS status, count(*) AS signals FROM ({_SCAN}) WHERE award_id % 7 <> 0 GROUP BY 1""",
    "canonical_edges": f"WITH {views.KEYED} SELECT semantic_key, min(subject_id) AS subject_id, min(object_id) AS object_id, min(observed_at) AS observed_at, count(*) AS observation_count FROM keyed GROUP BY 1",
    "numeric_mismatch": f"""
WITH {views.KEYED}, c AS (SELECT semantic_key, amount, currency, min(observation_id) AS id, count(*) AS members FROM keyed GROUP BY 1, 2, 3)
SELECT a.semantic_key, a.id AS observation_a, b.id AS observation_b, a.members, b.members AS other_members, 'NUMERIC_MISMATCH' AS conflict_type FROM c a JOIN c b ON a.semantic_key = b.semantic_key AND a.id < b.id""",
    "edge_support": f"WITH {views.KEYED} SELECT n AS observation_count, count(*) AS edges FROM (SELECT semantic_key, count(*) AS n FROM keyed GROUP BY 1) GROUP BY 1",
    "fact_claims": f"WITH {views.KEYED} SELECT relation AS predicate, 'FACT' AS claim_type, 'UNVERIFIED' AS verification_status, count(*) AS claims, count(DISTINCT source_record_id) AS records FROM keyed GROUP BY 1",
    "money_flows": f"SELECT buyer AS payer_id, winners[1] AS recipient_id, total_value AS amount, 'EUR' AS currency, 'PROCUREMENT' AS flow_type, 'AWARDED' AS flow_state, decision_date AS flow_date, notice_id AS contract_id, sha256(notice_id) AS claim_id FROM ({views.NOTICES}) WHERE len(winners) = 1 AND total_value IS NOT NULL",
    "ownership_rows": "SELECT c_custkey AS claim_id, c_custkey AS owner_id, c_custkey % (SELECT count(*) FROM supplier) AS owned_id, CASE WHEN c_custkey % 2 = 0 THEN 'OWNS' ELSE 'BENEFICIAL_OWNER_OF' END AS basis, CAST(c_custkey % 101 AS DECIMAL(7,4)) AS ownership_percent FROM customer WHERE c_custkey % 5 <> 0",
    "award_rows": f"SELECT notice_id, buyer AS buyer_id, unnest(winners) AS winner_id, CASE WHEN len(winners) = 1 THEN total_value END AS amount, decision_date FROM ({views.NOTICES})",
    "tender_builder": f"""
WITH n AS ({views.NOTICES})
SELECT notice_id, buyer AS subject_id, notice_id AS object_id, 'ISSUED_CONTRACT' AS relation, CAST(NULL AS DECIMAL(24,6)) AS amount, NULL AS currency, decision_date FROM n
UNION ALL SELECT notice_id, notice_id, w, 'HAS_WINNER', CASE WHEN len(winners) = 1 THEN total_value END, CASE WHEN len(winners) = 1 THEN 'EUR' END, decision_date FROM (SELECT *, unnest(winners) AS w FROM n)
UNION ALL SELECT notice_id, buyer, winners[1], 'AWARDED_TO', total_value, 'EUR', decision_date FROM n WHERE len(winners) = 1""",
    "temporal_paths": f"{_PATHS} SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY hops, support DESC, found) AS rank, CAST(hops AS BIGINT) AS hops, array_to_string(nodes, '>') AS nodes, array_to_string(list_transform(keys, lambda k: k.id), '>') AS edge_ids, lo AS common_from, hi AS common_to, false AS uncertain, support FROM first",
    "paths_batch": f"""{_PATHS}, known AS (SELECT a AS id FROM e UNION SELECT b FROM e)
SELECT r.request_id, CASE WHEN r.source_id NOT IN (SELECT id FROM known) OR r.target_id NOT IN (SELECT id FROM known) THEN 'UNKNOWN_ENTITY' WHEN count(f.found) = 0 THEN 'NO_PATH_FOUND' ELSE 'FOUND' END AS status,
  count(f.found) AS paths, CAST(min(f.hops) AS BIGINT) AS fewest_hops FROM ({views.PATH_REQUESTS}) r LEFT JOIN first f USING (request_id) GROUP BY r.request_id, r.source_id, r.target_id""",
    "entity_summary": f"""
WITH e AS ({views.ALL_EDGES}), ent AS (SELECT 'c' || c_custkey AS entity_id, 'PUBLIC_BODY' AS entity_type, c_name AS name FROM customer UNION ALL SELECT 's' || s_suppkey, 'ORGANIZATION', s_name FROM supplier),
i AS (SELECT 'c' || o_custkey AS entity_id, count(DISTINCT o_orderpriority) AS identifiers FROM orders GROUP BY 1),
t AS (SELECT entity_id, count(DISTINCT edge_id) AS relationships FROM (SELECT a AS entity_id, edge_id FROM e UNION ALL SELECT b, edge_id FROM e) GROUP BY 1)
SELECT entity_id, entity_type, name, coalesce(identifiers, 0) AS identifiers, coalesce(relationships, 0) AS relationships FROM ent LEFT JOIN i USING (entity_id) LEFT JOIN t USING (entity_id)""",
    "verified_edges": "SELECT o_orderkey, 'VERIFIED_PRIMARY' AS status, 'FACT' AS claim_type FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 5 <> 0 AND o_orderkey % 11 <> 0",
    "graph_export": f"""
WITH e AS ({views.ALL_EDGES})
SELECT 'node' AS part, 'c' || c_custkey AS a, c_name AS b, 'PUBLIC_BODY' AS kind, NULL::TIMESTAMP AS valid_from, NULL::TIMESTAMP AS valid_to FROM customer UNION ALL SELECT 'node', 's' || s_suppkey, s_name, 'ORGANIZATION', NULL, NULL FROM supplier
UNION ALL SELECT 'edge', a, b, CASE WHEN edge_id LIKE '%0' THEN 'VERIFIED_PRIMARY' ELSE 'UNVERIFIED' END, valid_from, valid_to FROM e""",
    "edge_provenance": f"""
WITH {views.KEYED}, c AS (SELECT semantic_key, amount, currency, min(observation_id) AS id FROM keyed GROUP BY 1, 2, 3),
m AS (SELECT a.semantic_key, count(*) AS conflicts FROM c a JOIN c b ON a.semantic_key = b.semantic_key AND a.id < b.id GROUP BY 1)
SELECT semantic_key AS edge_id, count(*) AS observations, count(DISTINCT source_record_id) AS records, coalesce(max(m.conflicts), 0) AS conflicts FROM keyed LEFT JOIN m USING (semantic_key) GROUP BY 1""",
}
