"""DuckDB SQL of the analysis queries."""

from __future__ import annotations

from candela.functions.text import LEGAL_FORMS
from candela.operators.metrics import BOUNDS

_OBS = """
obs AS (
  SELECT c_nationkey % 5 AS snapshot_id, c_nationkey AS geography, year(o_orderdate) AS period,
    CASE WHEN o_orderstatus <> 'P' THEN CAST(CAST(CAST(o_totalprice AS DECIMAL(24,6)) AS DECIMAL(24,2)) AS DECIMAL(38,12)) END AS number, o_orderpriority AS dimension
  FROM orders JOIN customer ON o_custkey = c_custkey
), specs AS (
  SELECT s.i || '-' || op || '-' || coalesce(dim, 'any') AS spec_id, s.i AS snapshot_id, op AS operation, dim
  FROM range(5) s(i), (SELECT unnest(['count_observations', 'count_distinct_geographies', 'sum_values', 'mean_values', 'percent_change', 'median_values']) AS op), (SELECT unnest([NULL, '1-URGENT']) AS dim)
), got AS (
  SELECT spec_id, any_value(operation) AS operation, count(geography) AS n, count(DISTINCT geography) AS geographies, count(number) AS numeric, sum(number) AS total,
    sum(number) FILTER (period = 1996) AS base, sum(number) FILTER (period = 1999) AS cur, count(geography) FILTER (period IN (1996, 1999)) AS both_n
  FROM specs LEFT JOIN obs ON obs.snapshot_id = specs.snapshot_id AND (dim IS NULL OR dim = obs.dimension) GROUP BY 1
), res AS (
  SELECT spec_id, operation, CASE WHEN operation = 'median_values' THEN 'UNKNOWN_OPERATION' WHEN operation IN ('sum_values', 'mean_values') AND numeric = 0 OR operation = 'percent_change' AND (base IS NULL OR cur IS NULL) THEN 'NO_NUMERIC' WHEN operation = 'percent_change' AND base = 0 THEN 'ZERO_BASE' ELSE 'OK' END AS status,
    CASE operation WHEN 'count_observations' THEN CAST(n AS DOUBLE) WHEN 'count_distinct_geographies' THEN CAST(geographies AS DOUBLE) WHEN 'sum_values' THEN CAST(total AS DOUBLE) WHEN 'mean_values' THEN CAST(total AS DOUBLE) / numeric
      ELSE (CAST(cur AS DOUBLE) - CAST(base AS DOUBLE)) / abs(CAST(base AS DOUBLE)) * 100 END AS value,
    CASE WHEN operation = 'median_values' THEN 0 WHEN operation = 'percent_change' THEN both_n WHEN operation IN ('sum_values', 'mean_values') THEN numeric ELSE n END AS used FROM got
)
"""
_NAMED = f"""
named AS (
  SELECT p_partkey AS entity_id, CASE WHEN p_size % 2 = 0 THEN 'ORGANIZATION' ELSE 'PUBLIC_BODY' END AS entity_type,
    trim(regexp_replace(trim(regexp_replace(regexp_replace(lower(concat_ws(' ', p_name, p_type, p_brand, CASE p_partkey % 3 WHEN 0 THEN 'GmbH' WHEN 1 THEN 'S.A.' END)), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g')), '(?:(?:^|\\s)(?:{"|".join(x for x in LEGAL_FORMS if "/" not in x)}))+$', '')) AS normalized_name,
    CASE WHEN p_size % 5 <> 0 THEN CAST(p_size % 5 AS VARCHAR) END AS jurisdiction_code
  FROM part
), grams AS (
  SELECT n, list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(n, '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS g
  FROM (SELECT DISTINCT normalized_name AS n FROM named)
)
"""
_CANDIDATES = f"""
{_NAMED}, gram AS (SELECT n, len(g) AS size, unnest(g) AS gram FROM grams), sim AS (
  SELECT x.n AS a, y.n AS b, count(*) / (any_value(x.size) + any_value(y.size) - count(*)) AS score
  FROM gram x JOIN gram y ON x.gram = y.gram AND x.size BETWEEN 0.9 * y.size - 1e-9 AND y.size / 0.9 + 1e-9 GROUP BY 1, 2
), cand AS (
  SELECT * FROM (
    SELECT l.entity_id, r.entity_id AS other_id, score, row_number() OVER (PARTITION BY l.entity_id ORDER BY score DESC, r.entity_id) AS rank
    FROM sim JOIN named l ON l.normalized_name = a JOIN named r ON r.normalized_name = b AND r.entity_type = l.entity_type AND r.entity_id <> l.entity_id
    WHERE score >= 0.9 AND (l.jurisdiction_code IS NULL OR r.jurisdiction_code IS NULL OR l.jurisdiction_code = r.jurisdiction_code)
  ) WHERE rank <= 5
)
"""
_IMPORT = """
imp AS (
  SELECT 'c' || o_custkey AS subject, CASE WHEN l_linenumber = 7 THEN 'c' || o_custkey ELSE 's' || l_suppkey END AS object, l_returnflag, o_orderdate, l_shipdate,
    CAST(l_extendedprice AS DECIMAL(24,6)) - 1000 AS amount, l_linestatus, l_quantity * 3 AS percent FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), bad AS (
  SELECT list_filter([CASE WHEN l_returnflag = 'R' THEN 'relation' END, CASE WHEN subject = object THEN 'self_edge' END, CASE WHEN l_shipdate < o_orderdate THEN 'interval' END,
    CASE WHEN l_linestatus <> 'O' THEN 'currency' END, CASE WHEN amount < 0 THEN 'amount' END, CASE WHEN percent > 100 THEN 'percent' END], lambda x: x IS NOT NULL) AS rules FROM imp
)
"""
_MANIFEST = """
man AS (
  SELECT DISTINCT source, external_id, h AS content_hash, n AS byte_length, concat_ws('/', source, h[1:2], regexp_replace(external_id, '[^A-Za-z0-9._-]', '_', 'g'), h) AS object_key
  FROM (SELECT source, 'doc/' || (doc_id % 700) || ' v' AS external_id, sha256(text) AS h, CAST(octet_length(encode(text)) AS BIGINT) AS n FROM documents)
)
"""
_SEALED = """
WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, props, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, '=' || event_id || '|=' || event_type || '|=' || props AS body FROM events),
s AS (
  SELECT user_id, event_id, i, repeat('0', 64) AS previous_hash, sha256(repeat('0', 64) || '|' || body) AS event_hash FROM e WHERE i = 1
  UNION ALL
  SELECT e.user_id, e.event_id, e.i, s.event_hash, sha256(s.event_hash || '|' || e.body) FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1
)
"""
_ACTION = "CASE event_type WHEN 'view' THEN 'review' WHEN 'click' THEN 'publish' WHEN 'error' THEN 'appeal' WHEN 'signup' THEN 'withdraw' ELSE 'note' END"

ORACLE_SQL = {
    "dimension_filter": "SELECT l_returnflag, l_linestatus, count(*) AS rows FROM lineitem WHERE l_returnflag IN ('R', 'N') AND l_linestatus = 'O' GROUP BY 1, 2",
    "page_completeness": """
WITH o AS (SELECT day(o_orderdate) AS s, o_orderkey % 4 AS p FROM orders), t AS (SELECT s, count(*) AS total FROM o GROUP BY 1),
p AS (SELECT s, p, count(*) - CASE WHEN s = 7 AND p = 0 THEN 1 ELSE 0 END AS rows, any_value(total) + CASE WHEN s = 5 AND p = 1 THEN 1 ELSE 0 END AS total FROM o JOIN t USING (s) WHERE NOT (s = 3 AND p = 2) GROUP BY 1, 2)
SELECT s AS snapshot_id, count(*) AS pages, CAST(sum(rows) AS BIGINT) AS rows, CASE WHEN min(total) <> max(total) THEN 'TOTALS_CHANGED' WHEN count(*) <> 4 OR max(p) <> 3 THEN 'PAGES_MISSING' WHEN sum(rows) <> max(total) THEN 'ROWS_MISSING' ELSE 'COMPLETE' END AS status FROM p GROUP BY 1""",
    "wealth_bridge": """
WITH per AS (SELECT o_custkey, coalesce(sum(CAST(o_totalprice AS DECIMAL(24,6))) FILTER (year(o_orderdate) = 1996), 0) AS y1996, coalesce(sum(CAST(o_totalprice AS DECIMAL(24,6))) FILTER (year(o_orderdate) = 1997), 0) AS y1997 FROM orders GROUP BY 1)
SELECT c_custkey AS entity_id, concat_ws(',', CASE WHEN c_custkey % 10 = 0 THEN 'income' END, CASE WHEN c_custkey % 15 = 0 THEN 'gifts' END) AS missing_components,
  CASE WHEN c_custkey % 10 <> 0 AND c_custkey % 15 <> 0 THEN CAST(c_custkey % 3 * 50 AS DECIMAL(30,6)) END AS residual,
  CASE WHEN c_custkey % 10 = 0 OR c_custkey % 15 = 0 THEN 'INCOMPLETE' WHEN c_custkey % 3 * 50 <= 60 THEN 'RECONCILED' ELSE 'REVIEW_REQUIRED' END AS status
FROM customer JOIN per ON c_custkey = o_custkey""",
    "row_quality": f"WITH {_IMPORT} SELECT rule, count(*) AS rows FROM (SELECT unnest(rules) AS rule FROM bad) GROUP BY 1",
    "row_quarantine": f"WITH {_IMPORT} SELECT 'valid' AS part, count(*) FILTER (len(rules) = 0) AS rows FROM bad UNION ALL SELECT 'quarantine', count(*) FILTER (len(rules) > 0) FROM bad",
    "unresolved_references": "SELECT DISTINCT 's' || l_suppkey AS key FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 7 <> 0) UNION SELECT DISTINCT 'p' || l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)",
    "validity_overlap": "SELECT l_linenumber, count(*) AS rows FROM lineitem WHERE l_returnflag <> 'A' AND l_shipdate <= TIMESTAMP '1996-06-30' AND (l_linenumber = 1 OR l_shipdate + INTERVAL 30 DAYS >= TIMESTAMP '1996-06-01') GROUP BY 1",
    "restricted_evidence": "SELECT doc_id FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0",
    "name_normalization": f"WITH {_NAMED} SELECT normalized_name, count(*) AS entities FROM named GROUP BY 1",
    "name_candidates": f"WITH {_CANDIDATES} SELECT entity_id, other_id, round(score, 6) AS score, rank FROM cand",
    "review_queue": f"""
WITH {_CANDIDATES}, s AS (SELECT least(CAST(entity_id AS VARCHAR), CAST(other_id AS VARCHAR)) AS entity_a, greatest(CAST(entity_id AS VARCHAR), CAST(other_id AS VARCHAR)) AS entity_b, score, entity_id + other_id AS t FROM cand)
SELECT entity_a, entity_b, round(max(score), 6) AS score FROM s GROUP BY 1, 2 HAVING bool_and(t % 4 <> 0)""",
    "pair_scoring": """
WITH p AS (SELECT * FROM (SELECT c_custkey AS a, lead(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS b FROM customer) WHERE b IS NOT NULL),
f AS (SELECT *, (a % 5 = 0) <> (b % 5 = 0) AS types, a % 4 = 0 AND b % 4 = 0 AS lei, a % 6 = 0 AND b % 6 = 0 AS vat, a // 8 = b // 8 AS same_lei, a % 5 = 0 AS person,
  list_distinct([a % 3, a % 4]) AS da, list_distinct([b % 3, b % 4]) AS db, a % 2 = b % 2 AS same_day FROM p),
g AS (SELECT *, lei AND NOT same_lei AS conflict, (lei AND same_lei) OR vat AS hit, len(list_intersect(da, db)) / len(list_distinct(list_concat(da, db))) AS dir FROM f),
s AS (SELECT *, CASE WHEN types OR conflict THEN 0.0 WHEN hit THEN 0.995 ELSE round(0.5 + 0.18 + 0.12 + 0.12 * dir + CASE WHEN same_day THEN 0.08 ELSE 0 END, 6) END AS score FROM g)
SELECT a AS pair_id, CAST(score AS DOUBLE) AS score,
  CASE WHEN types OR conflict THEN 'KEEP_SEPARATE' WHEN person AND NOT hit THEN CASE WHEN score >= 0.9 THEN 'HUMAN_REVIEW' ELSE 'KEEP_SEPARATE' END WHEN score >= 0.98 THEN 'AUTO_MERGE' WHEN score >= 0.9 THEN 'HUMAN_REVIEW' ELSE 'KEEP_SEPARATE' END AS decision,
  CASE WHEN types THEN 'entity types differ' WHEN conflict THEN 'conflicting strong identifiers: LEI' ELSE concat_ws('; ', CASE WHEN hit THEN 'exact identifier match: ' || concat_ws(', ', CASE WHEN lei THEN 'LEI' END, CASE WHEN vat THEN 'VAT' END) END,
    CASE WHEN person AND NOT hit THEN 'person auto-merge disabled without a strong exact identifier' END, 'very high normalized-name similarity', 'high address similarity', 'same jurisdiction',
    CASE WHEN dir > 0 THEN 'overlapping directors' END, CASE WHEN same_day THEN 'same incorporation date' END) END AS reasons FROM s""",
    "identifier_resolution": """
WITH r AS (SELECT CAST(o_orderkey AS VARCHAR) AS k, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_custkey % 150 AS VARCHAR) END AS v, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_custkey % 2 AS VARCHAR) END AS c, CASE WHEN o_orderkey % 6 = 0 THEN 'm' || o_custkey END AS m FROM orders),
i AS (SELECT 's' || s_suppkey AS id, CAST(s_suppkey % 60 AS VARCHAR) AS v, CASE WHEN s_suppkey % 5 <> 0 THEN CAST(s_suppkey % 2 AS VARCHAR) END AS c, s_suppkey % 3 = 0 AS verified, s_suppkey AS seq FROM supplier),
b AS (SELECT k, arg_min(id, row(NOT verified, seq, id)) AS id FROM r JOIN i ON r.v = i.v AND (r.c IS NULL OR i.c IS NULL OR r.c = i.c) GROUP BY 1)
SELECT 'feed' AS source, r.k AS external_key, coalesce(m, b.id, CASE WHEN v IS NOT NULL THEN sha256('=VAT|=' || v || '|' || coalesce('=' || c, '~')) ELSE sha256('=feed|=' || r.k) END) AS entity_id,
  CASE WHEN m IS NOT NULL THEN 'SOURCE_MAPPING' WHEN b.id IS NOT NULL THEN 'IDENTIFIER_MATCH' ELSE 'MINTED' END AS method FROM r LEFT JOIN b ON r.k = b.k""",
    "identifier_upsert": "SELECT l_suppkey AS entity_id, l_returnflag AS scheme, l_suppkey % 10 AS value, bool_or(l_linestatus = 'O') AS verified, min(l_orderkey) AS source_record_id FROM lineitem GROUP BY 1, 2, 3",
    "identifier_type_clash": "SELECT 'VAT' AS scheme, CAST(c_custkey // 3 AS VARCHAR) AS value, 'ORGANIZATION,PERSON' AS types FROM customer GROUP BY 2 HAVING count(DISTINCT c_nationkey % 2) > 1",
    "entity_search": f"""
WITH {_NAMED}, q AS (
  SELECT r_regionkey AS query_id, (['red widget', 'blue b', 'small ring eco', 'brand 17', 'zzz'])[r_regionkey + 1] AS q, CASE WHEN r_regionkey % 2 = 0 THEN 'ORGANIZATION' END AS t FROM region
), qg AS (
  SELECT *, list_distinct(flatten(list_transform(regexp_split_to_array(q, '[^a-z0-9]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS g FROM q
), h AS (
  SELECT query_id, t, n, len(list_intersect(grams.g, qg.g)) / len(list_distinct(list_concat(grams.g, qg.g))) AS score, contains(n, q) AS sub FROM grams, qg
)
SELECT * FROM (SELECT query_id, entity_id, normalized_name, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, normalized_name, entity_id) AS rank
  FROM h JOIN named ON n = normalized_name WHERE (score >= 0.3 OR sub) AND (t IS NULL OR t = entity_type)) WHERE rank <= 20""",
    "entity_search_as_of": f"""
WITH {_NAMED}, live AS (
  SELECT entity_id, normalized_name || CASE WHEN entity_id % 8 = 0 THEN ' renewed' ELSE '' END AS n FROM named WHERE NOT (entity_id % 8 = 0 AND entity_id % 9 = 0)
), known AS (SELECT entity_id, n FROM live WHERE entity_id % 13 <> 0
), q AS (SELECT p_type AS query_id, lower(p_type) || ' renewed' AS q FROM (SELECT DISTINCT p_type FROM part)
), ng AS (
  SELECT n, list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(n, '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS g FROM (SELECT DISTINCT n FROM known)
), qg AS (
  SELECT *, list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(q, '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS g FROM q
), h AS (SELECT query_id, n, len(list_intersect(ng.g, qg.g)) / len(list_distinct(list_concat(ng.g, qg.g))) AS score, contains(n, q) AS sub FROM ng, qg)
SELECT query_id, entity_id, n AS normalized_name, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, n, entity_id) AS rank FROM h JOIN known USING (n) WHERE score >= 0.3 OR sub) WHERE rank <= 10""",
    "legal_titles": r"""SELECT page_id, nullif(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')), '') AS title FROM pages""",
    "evidence_manifest": f"WITH {_MANIFEST} SELECT source, external_id, content_hash, byte_length, object_key FROM man",
    "evidence_write": f"""WITH {_MANIFEST}
SELECT '1 put' AS step, object_key, 'STORED' AS status FROM man WHERE byte_length % 3 <> 0
UNION ALL SELECT '2 put', object_key, CASE WHEN byte_length % 3 <> 0 THEN 'PRESENT' ELSE 'STORED' END FROM man
UNION ALL SELECT '3 check', object_key, 'CHANGED' FROM man WHERE byte_length % 12 = 0
UNION ALL SELECT '4 put', object_key, CASE WHEN byte_length % 12 = 0 THEN 'RESTORED' ELSE 'PRESENT' END FROM man""",
    "evidence_missing": f"WITH {_MANIFEST} SELECT object_key, byte_length FROM man WHERE byte_length % 3 = 0",
    "evidence_tampered": f"WITH {_MANIFEST} SELECT object_key, sha256(object_key) AS registered_hash FROM man WHERE byte_length % 4 = 0",
    "artifact_upsert": "SELECT source, doc_id % 300 AS external_id, max(doc_id) AS seq, arg_max(sha256(text), doc_id) AS content_hash FROM documents GROUP BY 1, 2",
    "evidence_digest": """
WITH d AS (SELECT source, doc_id, sha256(text) AS h, CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 256 AS b FROM documents),
p AS (SELECT source, b, sha256(array_to_string(list_sort(list(doc_id || '=' || h)), chr(10))) AS h, count(*) AS n FROM d GROUP BY 1, 2)
SELECT source, sha256(string_agg(h, chr(10) ORDER BY b)) AS digest, CAST(sum(n) AS BIGINT) AS members FROM p GROUP BY 1""",
    "plain_numbers": r"SELECT regexp_replace(CAST(CAST(l_extendedprice AS DECIMAL(24,6)) * 0.125 AS VARCHAR), '\.?0+$', '') AS value, count(*) AS rows FROM lineitem GROUP BY 1",
    "import_idempotence": "WITH d AS (SELECT doc_id, sha256(text) AS digest FROM documents) SELECT digest, min(doc_id) AS batch_id FROM d GROUP BY 1 HAVING bool_and(doc_id % 3 <> 0)",
    "audit_chain_seal": f"{_SEALED} SELECT user_id, event_id, previous_hash, event_hash FROM s",
    "audit_chain_check": f"""{_SEALED}
SELECT event_id, link_ok, hash_ok FROM (
  SELECT event_id, previous_hash = coalesce(lag(event_hash) OVER (PARTITION BY user_id ORDER BY event_id), repeat('0', 64)) AS link_ok, event_id % 97 <> 0 OR e.props = '{{}}' AS hash_ok
  FROM s JOIN e USING (user_id, event_id) WHERE event_id % 101 <> 0) WHERE NOT link_ok OR NOT hash_ok""",
    "case_state": f"""
WITH RECURSIVE e AS (SELECT user_id, {_ACTION} AS action, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
s AS (
  SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, 'OPEN' AS state, CAST(0 AS BIGINT) AS accepted, CAST(0 AS BIGINT) AS published FROM events
  UNION ALL
  SELECT user_id, i, coalesce(nxt, state), accepted + CASE WHEN nxt IS NULL THEN 0 ELSE 1 END, published + CASE WHEN nxt = 'PUBLISHED' THEN 1 ELSE 0 END FROM (
    SELECT s.user_id, e.i, s.state, s.accepted, s.published, CASE s.state || '/' || e.action WHEN 'OPEN/review' THEN 'REVIEWED' WHEN 'REVIEWED/publish' THEN 'PUBLISHED' WHEN 'PUBLISHED/withdraw' THEN 'WITHDRAWN' WHEN 'PUBLISHED/appeal' THEN 'OPEN' WHEN 'WITHDRAWN/appeal' THEN 'OPEN' END AS nxt
    FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)
)
SELECT user_id AS case_id, arg_max(state, i) AS state, max(accepted) AS accepted, max(i) - max(accepted) AS rejected, max(published) AS published FROM s GROUP BY 1""",
    "case_releases": f"""
WITH RECURSIVE e AS (SELECT user_id, event_id, {_ACTION} AS action, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
s AS (
  SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, 'OPEN' AS before, 'OPEN' AS state FROM events
  UNION ALL
  SELECT user_id, i, event_id, state, coalesce(CASE state || '/' || action WHEN 'OPEN/review' THEN 'REVIEWED' WHEN 'REVIEWED/publish' THEN 'PUBLISHED' WHEN 'PUBLISHED/withdraw' THEN 'WITHDRAWN' WHEN 'PUBLISHED/appeal' THEN 'OPEN' WHEN 'WITHDRAWN/appeal' THEN 'OPEN' END, state)
  FROM (SELECT s.user_id, e.i, e.event_id, s.state, e.action FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)
), m AS (SELECT user_id, event_id, state = 'PUBLISHED' AS opens, lead(event_id) OVER (PARTITION BY user_id ORDER BY i) AS until FROM s WHERE before <> state AND 'PUBLISHED' IN (before, state))
SELECT user_id AS case_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS number, event_id AS published_at, until AS withdrawn_at FROM m WHERE opens""",
    "public_releases": "SELECT o_orderkey AS release_id, o_orderpriority AS title, o_orderstatus AS summary, o_orderdate AS published_at FROM orders WHERE o_orderstatus <> 'P' ORDER BY o_orderdate DESC, o_orderkey LIMIT 100",
    "duty_violations": """
SELECT * FROM (SELECT o_orderkey AS case_id, o_custkey % 7 AS creator, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 7 END AS reviewer, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 5 END AS publisher FROM orders)
WHERE coalesce(reviewer = creator, false) OR coalesce(publisher = creator OR publisher = reviewer, false)""",
    "claim_review": """
WITH ev AS (SELECT l_orderkey, count(*) AS n, bool_or(l_linenumber = 7) AS demo FROM lineitem GROUP BY 1),
r AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'VERIFIED_PRIMARY' WHEN 'O' THEN 'CORROBORATED' ELSE 'RETRACTED' END AS s, coalesce(n, 0) AS n, coalesce(demo, false) AS demo FROM orders LEFT JOIN ev ON o_orderkey = l_orderkey),
o AS (SELECT *, CASE WHEN o_orderkey % 13 = 0 THEN 'UNKNOWN_CLAIM' WHEN s <> 'RETRACTED' AND n = 0 THEN 'NO_EVIDENCE' WHEN s <> 'RETRACTED' AND demo THEN 'SYNTHETIC_EVIDENCE' ELSE 'ACCEPTED' END AS outcome FROM r)
SELECT o_orderkey AS claim_id, outcome, CASE WHEN outcome = 'ACCEPTED' THEN s WHEN outcome <> 'UNKNOWN_CLAIM' THEN 'UNVERIFIED' END AS verification_status, n AS n_evidence FROM o""",
    "validity_correction": "SELECT o_orderkey AS edge_id, CASE WHEN o_orderkey % 9 = 0 THEN o_orderdate - INTERVAL 10 DAYS ELSE o_orderdate END AS valid_from, CASE WHEN o_orderkey % 9 = 0 THEN o_orderdate END AS valid_to, CASE WHEN o_orderkey % 9 = 0 THEN 'UNVERIFIED' ELSE 'VERIFIED_PRIMARY' END AS verification_status, o_orderkey % 9 = 0 AS corrected FROM orders",
    "parser_retirement": "SELECT CASE WHEN l_returnflag = 'R' THEN 'parser/1' ELSE 'parser/2' END AS derivation_method, CASE WHEN l_returnflag = 'R' THEN 'RETRACTED' ELSE 'UNVERIFIED' END AS verification_status, l_returnflag = 'R' OR l_linestatus = 'F' AS superseded, count(*) AS rows FROM lineitem GROUP BY 1, 2, 3",
    "request_metrics": "SELECT event_type AS route, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors, CAST(sum(l) AS DECIMAL(34,6)) AS latency_sum, "
    + ", ".join(f"count(*) FILTER (l <= {b}) AS le_{k}" for k, b in enumerate(BOUNDS))
    + " FROM (SELECT event_type, CAST(CAST(value AS DECIMAL(24,6)) / 100 AS DECIMAL(24,6)) AS l FROM events) GROUP BY 1",
    "latency_percentiles": "SELECT event_type AS route, CAST((l[(n + 1) // 2] + l[n // 2 + 1]) / 2 AS DOUBLE) AS p50, l[greatest(1, CAST(floor(n * CAST(0.95 AS DOUBLE)) AS BIGINT))] AS p95, l[greatest(1, CAST(floor(n * CAST(0.99 AS DOUBLE)) AS BIGINT))] AS p99 FROM (SELECT event_type, list_sort(list(l)) AS l, len(list(l)) AS n FROM (SELECT event_type, CAST(CAST(value AS DECIMAL(24,6)) / 100 AS DECIMAL(24,6)) AS l FROM events) GROUP BY 1)",
    "reconciliation_summary": "SELECT 'active_edges' AS part, count(*) AS rows FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT 'observations', count(*) FROM lineitem WHERE l_returnflag <> 'R' UNION ALL SELECT 'entities', count(*) FROM customer UNION ALL SELECT 'open_reviews', count(*) FROM events WHERE event_type = 'error'",
    "keyset_page": "SELECT event_id, event_type FROM events WHERE event_id > 1000 ORDER BY event_id LIMIT 50",
    "history_topk": "SELECT event_id, ts, user_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 25",
    "import_report": "SELECT source, count(*) AS documents, count(DISTINCT sha256(text)) AS texts, max(doc_id) AS latest FROM documents GROUP BY 1",
    "recalculate_batch": f"WITH {_OBS} SELECT spec_id, operation, status, CASE WHEN status = 'OK' THEN round(value, 4) END AS result, used FROM res",
    "recalculate_filtered": """
WITH obs AS (
  SELECT c_nationkey % 5 AS snapshot_id, c_nationkey, year(o_orderdate) AS period, c_mktsegment AS seg, o_orderpriority AS pri, o_orderstatus AS st,
    CASE WHEN o_orderstatus <> 'P' THEN CAST(CAST(CAST(o_totalprice AS DECIMAL(24,6)) AS DECIMAL(24,2)) AS DECIMAL(38,12)) END AS number
  FROM orders JOIN customer ON o_custkey = c_custkey
), specs AS (
  SELECT s.i AS snapshot_id, op, how, f FROM range(5) s(i), (VALUES ('count_observations', 'sum'), ('mean_values', 'sum'), ('percent_change', 'sum'), ('percent_change', 'mean')) o(op, how),
    (VALUES ('none'), ('segment'), ('tags'), ('both'), ('absent'), ('unmet')) t(f)
), got AS (
  SELECT specs.snapshot_id, op, how, f, count(c_nationkey) AS n, count(number) AS numeric, CAST(sum(number) AS DOUBLE) AS total, count(c_nationkey) FILTER (period IN (1996, 1999)) AS both_n,
    CAST(sum(number) FILTER (period = 1996) AS DOUBLE) AS b, CAST(sum(number) FILTER (period = 1999) AS DOUBLE) AS c, count(number) FILTER (period = 1996) AS bn, count(number) FILTER (period = 1999) AS cn
  FROM specs LEFT JOIN obs ON obs.snapshot_id = specs.snapshot_id AND CASE f WHEN 'segment' THEN seg = 'BUILDING' WHEN 'tags' THEN pri = '1-URGENT' OR st = 'P'
    WHEN 'both' THEN seg IN ('BUILDING', 'MACHINERY') AND st = 'F' AND c_nationkey BETWEEN 1 AND 5 WHEN 'unmet' THEN false ELSE true END
  GROUP BY ALL
), r AS (
  SELECT *, CASE WHEN op = 'mean_values' AND numeric = 0 OR op = 'percent_change' AND (b IS NULL OR c IS NULL) THEN 'NO_NUMERIC' ELSE 'OK' END AS status,
    CASE WHEN how = 'mean' THEN b / bn ELSE b END AS base, CASE WHEN how = 'mean' THEN c / cn ELSE c END AS cur FROM got
)
SELECT snapshot_id || '-' || op || '-' || how || '-' || f AS spec_id, snapshot_id, op AS operation, '1' AS engine_version, status,
  CASE WHEN status = 'OK' THEN round(CASE op WHEN 'count_observations' THEN n WHEN 'mean_values' THEN total / numeric ELSE (cur - base) / base * 100 END, 4) END AS result,
  CASE op WHEN 'count_observations' THEN n WHEN 'mean_values' THEN numeric ELSE both_n END AS used
FROM r""",
    "verify_assertions": f"""WITH {_OBS}
SELECT spec_id || '/' || k AS assertion_id, spec_id, CASE WHEN status = 'UNKNOWN_OPERATION' THEN status WHEN status <> 'OK' THEN 'INDETERMINATE' WHEN off <= 0.5 THEN 'VERIFIED' ELSE 'REFUTED' END AS verdict, CASE WHEN status = 'OK' THEN -off END AS delta
FROM res, (SELECT unnest([0, 1, 2]) AS k, unnest([0.0, 0.4, 2.0]) AS off)""",
}
