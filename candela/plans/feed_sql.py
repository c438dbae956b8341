"""DuckDB SQL of the feed and stream queries, on the tables that the payloads were made of."""

from __future__ import annotations

from candela.operators.metrics import BOUNDS
from candela.plans.analysis_sql import ORACLE_SQL as ANALYSIS
from candela.plans.views import NOTICES

_N = f"n AS (SELECT x.*, o_orderstatus FROM ({NOTICES}) x JOIN orders ON notice_id = CAST(o_orderkey AS VARCHAR))"
_IMPORTED = f"""{_N}, k AS (SELECT *, 'o-' || notice_id || ':party:' || buyer AS bk, 'o-' || notice_id || ':award:1' AS ck FROM n), w AS (SELECT *, 'o-' || notice_id || ':party:' || winner AS wk FROM (SELECT *, unnest(winners) AS winner FROM k)),
p AS (SELECT *, sha256('=releases|=' || bk) AS b_id, sha256('=releases|=' || ck) AS c_id, sha256('=releases|=' || wk) AS w_id, o_orderstatus <> 'P' AS live FROM w),
o AS (SELECT DISTINCT notice_id, buyer, bk, ck, b_id, c_id, live FROM p),
e AS (SELECT b_id AS a, c_id AS b, 'ISSUED_CONTRACT' AS kind FROM o WHERE live UNION ALL SELECT w_id, c_id, 'SUPPLIER_OF' FROM p WHERE live UNION ALL SELECT b_id, w_id, 'AWARDED_TO' FROM p WHERE live)"""
_OWN = "own AS (SELECT c_custkey AS p, c_custkey % (SELECT count(*) FROM supplier) AS s FROM customer)"
_DAY_2020 = "CAST(epoch(DATE '2020-01-01') AS BIGINT)"
_COLUMNS = {"a": "VARCHAR", "b": "VARCHAR", "scheme": "VARCHAR", "identifier": "VARCHAR", "currency": "VARCHAR", "contract": "VARCHAR", "locator": "VARCHAR", "level": "VARCHAR", "valid_from": "BIGINT", "valid_to": "BIGINT", "amount": "DOUBLE", "percent": "DOUBLE"}


def _rows(source: str, rows: list[tuple]) -> str:
    """Rows of (part, kind, table and condition, columns); what isn't given is null."""
    parts = [f"SELECT '{part}' AS part, '{kind}' AS kind, " + ", ".join(f"CAST({given.get(c, 'NULL')} AS {t}) AS {c}" for c, t in _COLUMNS.items()) + f" FROM {src}" for part, kind, src, given in rows]
    return f"WITH {source} " + " UNION ALL ".join(parts)


def _problem(locator: str, level: str = "WARNING") -> dict:
    return {"locator": locator, "level": f"'{level}'"}


ORACLE_SQL = {
    "src_contracting": _rows(
        f"{_N}, c AS (SELECT *, 'o-' || notice_id || ':party:' AS pre, 'o-' || notice_id || ':award:1' AS c, '/releases/' || notice_id || '/awards/0' AS place, CAST(epoch(decision_date) AS BIGINT) AS t FROM n), live AS (SELECT * FROM c WHERE o_orderstatus <> 'P'), w AS (SELECT *, unnest(winners) AS winner FROM live)",
        [
            ("edge", "ISSUED_CONTRACT", "live", {"a": "pre || buyer", "b": "c", "locator": "place", "valid_from": "t", "valid_to": "t"}),
            ("edge", "SUPPLIER_OF", "w", {"a": "pre || winner", "b": "c", "locator": "place", "valid_from": "t", "valid_to": "t"}),
            ("edge", "AWARDED_TO", "w", {"a": "pre || buyer", "b": "pre || winner", "contract": "c", "locator": "place", "valid_from": "t", "valid_to": "t", "amount": "CASE WHEN len(winners) = 1 THEN total_value END", "currency": "CASE WHEN len(winners) = 1 THEN 'EUR' END"}),
            ("entity", "PUBLIC_BODY", "c", {"a": "pre || buyer", "b": "'N ' || buyer"}),
            ("entity", "ORGANIZATION", "(SELECT pre, unnest(winners) AS winner FROM c)", {"a": "pre || winner", "b": "'N ' || winner"}),
            ("entity", "CONTRACT", "live", {"a": "c", "b": "c"}),
            ("problem", "award is not active", "c WHERE o_orderstatus = 'P'", _problem("place")),
            ("problem", "amount is not divided between suppliers", "live WHERE len(winners) <> 1", _problem("place")),
        ],
    ),
    "src_envelopes": _rows(
        "e AS (SELECT 'c' || c_custkey AS k, 's' || c_custkey % 10 AS o, c_name AS name, CAST(c_acctbal AS DECIMAL(24,6)) AS amount FROM customer), s AS (SELECT 's' || s_suppkey AS k, s_name AS name FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer))",
        [
            ("edge", "AWARDED_TO", "e", {"a": "k", "b": "o", "amount": "amount", "locator": "'/r'"}),
            ("entity", "PUBLIC_BODY", "e", {"a": "k", "b": "name"}),
            ("entity", "ORGANIZATION", "s", {"a": "k", "b": "name"}),
        ],
    ),
    "import_job": f"""
WITH {_IMPORTED}
SELECT 'entities' AS part, b_id AS a, 'N ' || buyer AS b, 'PUBLIC_BODY' AS kind, NULL::DOUBLE AS amount FROM o
UNION ALL SELECT 'entities', c_id, ck, 'CONTRACT', NULL FROM o WHERE live UNION ALL SELECT 'entities', w_id, 'N ' || winner, 'ORGANIZATION', NULL FROM p
UNION ALL SELECT 'edges', a, b, kind, NULL FROM e UNION ALL SELECT 'claims', a, NULL, kind, NULL FROM e
UNION ALL SELECT 'money_flows', b_id, w_id, 'AWARDED', CAST(total_value AS DOUBLE) FROM p WHERE live AND len(winners) = 1""",
    "import_replay": f"""
WITH {_IMPORTED}, c AS (SELECT (SELECT count(*) FROM o) + (SELECT count(*) FROM o WHERE live) + (SELECT count(*) FROM p) AS entities, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM p WHERE live AND len(winners) = 1) AS flows)
SELECT 'result' AS part, k || ' ' || name AS name, CAST(n AS VARCHAR) AS value FROM c, (VALUES (0), (1)) t(k),
  LATERAL (VALUES ('entities', entities), ('edges', edges), ('claims', edges), ('money_flows', flows), ('ownership', 0), ('quarantine', 0)) v(name, n)
UNION ALL VALUES ('result', '0 replayed', 'False'), ('result', '1 replayed', 'True'), ('receipt', 'releases', 'SUCCEEDED'), ('receipt', 'spreadsheet', 'ValueError'), ('job', 'SUCCEEDED', 'orders/-/2'), ('job', 'FAILED', '-/ValueError/2'),
  ('audit', 'IMPORT_REPLAYED', '{{}}'), ('audit', 'IMPORT_FAILED', '{{"error_code": "ValueError"}}')
UNION ALL SELECT 'audit', 'IMPORT_SUCCEEDED', '{{"claims": ' || edges || ', "format": "releases"}}' FROM c
UNION ALL SELECT 'edges', kind, a || '>' || b FROM e""",
    "document_versions": """
SELECT *, row_number() OVER (PARTITION BY source, external_id ORDER BY seen_at, content_hash) AS version
FROM (SELECT source, doc_id % 100 AS external_id, sha256(text) AS content_hash, min(split_part(text, chr(10), 1)) AS title, min(doc_id) AS seen_at FROM documents GROUP BY 1, 2, 3)""",
    "src_ownership_statements": _rows(
        f"{_OWN}, k AS (SELECT *, p % 2 = 0 AS ben FROM own WHERE p % 10 <> 0), i AS (SELECT *, unnest([true, p % 7 <> 0]) AS ok, unnest([0, 1]) AS j FROM k), good AS (SELECT *, {_DAY_2020} AS t FROM i WHERE ok)",
        [
            ("edge", kind, f"good WHERE {cond}", {"a": "'c' || p", "b": "'s' || s", "locator": "'/' || (2 * p + 1) || '/interests/' || j", "valid_from": "t", "percent": "CASE WHEN j = 0 THEN p % 100 END"})
            for kind, cond in (("BENEFICIAL_OWNER_OF", "ben"), ("OWNS", "NOT ben"))
        ]
        + [
            ("entity", "PERSON", "k", {"a": "'c' || p", "b": "'P ' || p"}),
            ("entity", "ORGANIZATION", "supplier", {"a": "'s' || s_suppkey", "b": "s_name"}),
            ("problem", "unknown person", "own WHERE p % 10 = 0", _problem("'c' || p")),
            ("problem", "owner or subject does not resolve", "own WHERE p % 10 = 0", _problem("'x' || p")),
            ("problem", "interest type is not supported", "i WHERE NOT ok", _problem("'x' || p")),
        ],
    ),
    "src_ownership_records": _rows(
        f"""{_OWN}, r AS (SELECT *, CASE WHEN p % 5 = 0 THEN 3 * p + 2 ELSE 3 * p + 1 END AS position, CASE WHEN p % 9 = 0 THEN 'GB-COH-' || lpad(CAST(s AS VARCHAR), 8, '0') ELSE 's' || s END AS owned FROM own),
cited AS (SELECT owned, min(position) AS position FROM r WHERE p % 9 = 0 GROUP BY 1), k AS (SELECT * FROM r WHERE p % 10 <> 0), live AS (SELECT *, {_DAY_2020} AS t FROM k WHERE p % 5 <> 0)""",
        [
            ("edge", "OWNS", "live", {"a": "'c' || p", "b": "owned", "locator": "'/' || position || '/recordDetails/interests'", "valid_from": "t", "percent": "CASE WHEN p % 4 <> 0 THEN p % 100 END"}),
            ("entity", "PERSON", "k", {"a": "'c' || p", "b": "'P'"}),
            ("entity", "ORGANIZATION", "supplier", {"a": "'s' || s_suppkey", "b": "s_name"}),
            ("entity", "ORGANIZATION", "cited", {"a": "owned", "b": "owned", "scheme": "'GB-COH'", "identifier": "substr(owned, 8, 8)"}),
            ("problem", "unknown person", "own WHERE p % 10 = 0", _problem("'/' || 3 * p")),
            ("problem", "subject is a register number only", "cited", _problem("'/' || position")),
            ("problem", "owner does not resolve", "r WHERE p % 10 = 0", _problem("'/' || position")),
            ("problem", "record is closed", "k WHERE p % 5 = 0", _problem("'/' || position")),
        ],
    ),
    "src_procurement": _rows(
        f"{_N}, k AS (SELECT *, 'VAT:' || buyer AS a, 'VAT:' || winners[1] AS b, CAST(epoch(decision_date) AS BIGINT) AS t FROM n WHERE len(winners) = 1 AND CAST(notice_id AS BIGINT) % 3 <> 0)",
        [
            ("edge", "AWARDED_TO", "k", {"a": "a", "b": "b", "contract": "notice_id", "locator": "'/notices/' || notice_id", "valid_from": "t", "valid_to": "t", "amount": "total_value", "currency": "'EUR'"}),
            ("entity", "PUBLIC_BODY", "(SELECT DISTINCT a, buyer FROM k)", {"a": "a", "b": "buyer", "scheme": "'VAT'", "identifier": "buyer"}),
            ("entity", "ORGANIZATION", "(SELECT DISTINCT b, winners[1] AS winner FROM k)", {"a": "b", "b": "winner", "scheme": "'VAT'", "identifier": "winner"}),
            ("entity", "CONTRACT", "k", {"a": "notice_id", "b": "notice_id"}),
        ],
    ),
    "src_lei": """
WITH c AS (SELECT *, CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 7 = 0 THEN 'payload holds no record' WHEN c_custkey % 8 = 0 THEN 'record lacks LEI or legal name' END AS problem FROM customer)
SELECT CASE WHEN problem IS NULL THEN CASE WHEN c_custkey % 2 = 0 THEN 'L' || c_custkey ELSE CAST(c_custkey AS VARCHAR) END END AS lei, CASE WHEN problem IS NULL THEN c_name END AS name,
  CASE WHEN problem IS NULL THEN CASE WHEN c_custkey % 3 <> 0 THEN 'N' ELSE 'A' END || c_nationkey END AS jurisdiction, CASE WHEN problem IS NULL THEN DATE '2020-02-03' END AS created, problem FROM c""",
    "src_lei_parents": """
WITH c AS (SELECT c_custkey AS k, 'L' || c_custkey AS lei, c_name AS name FROM customer),
r AS (SELECT lei, 'DIRECT_PARENT' AS kind, CASE WHEN k % 3 <> 0 THEN 'L' || k // 2 END AS parent FROM c UNION ALL SELECT lei, 'ULTIMATE_PARENT', 'L' || k * 2 FROM c)
SELECT r.lei, kind, parent, c.name AS parent_name, CASE WHEN parent IS NULL THEN 'NOT_REPORTED' WHEN c.name IS NULL THEN 'UNKNOWN_PARENT' ELSE 'EDGE' END AS status FROM r LEFT JOIN c ON c.lei = parent""",
    "src_tender_rows": f"SELECT notice_id AS publication_number, 'T ' || notice_id AS title, total_value, 'EUR' AS currency, len(winners) AS n_winners, array_to_string(winners, ',') AS winners FROM ({NOTICES})",
    "src_legal_relations": "SELECT DISTINCT '3' || l_orderkey AS subject, CASE l_linenumber % 3 WHEN 0 THEN 'CITES' ELSE 'AMENDS' END AS relation, '3' || l_partkey AS target FROM lineitem WHERE l_linenumber % 3 <> 2 AND l_partkey <> l_orderkey",
    "src_legal_xml": "SELECT DISTINCT '3' || l_orderkey AS subject, CASE l_linenumber % 3 WHEN 0 THEN 'CITES' ELSE 'AMENDS' END AS relation, '3' || l_partkey AS target FROM lineitem WHERE l_linenumber % 3 <> 2 AND l_partkey <> l_orderkey",
    "src_archives": """
WITH l AS (SELECT o_orderkey AS k, o_orderpriority AS p, o_orderstatus AS s, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS n FROM orders),
m AS (SELECT *, 'part-' || lpad(CAST(n // 500 AS VARCHAR), 5, '0') || '.ndjson' AS member FROM l)
SELECT CASE WHEN k % 50 = 0 THEN 'bad line' ELSE 'row' END AS part, member, n % 500 AS line, CASE WHEN k % 50 <> 0 THEN k END AS id, CASE WHEN k % 50 = 0 THEN '{"id": ' || k ELSE p END AS text FROM m
UNION ALL SELECT DISTINCT 'member', member, NULL, NULL, 'orders-' || s FROM m""",
    "src_sdg": """
SELECT DISTINCT o_orderkey % 40 AS snapshot_id, 'S' AS series, CAST(o_custkey % 30 AS VARCHAR) AS geography, CAST(year(o_orderdate) AS INTEGER) AS period, CASE WHEN o_orderstatus = 'P' THEN '<' ELSE '' END || o_orderkey % 50 || '.50' AS value,
  CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderkey % 50 AS DOUBLE) + 0.5 END AS number, '{"p":"' || o_orderpriority || '"}' AS dimensions FROM orders""",
    "src_lobbying": """
WITH o AS (SELECT 'T' || o_custkey AS s, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS i, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) END AS day, o_orderkey % 5 = 0 AS p FROM orders)
SELECT s AS subject, i AS object, 'MET_WITH' AS relation, day AS valid_from FROM o WHERE i IS NOT NULL AND day IS NOT NULL
UNION ALL SELECT s, '32016R0679', 'LOBBIED_ON', day FROM o WHERE p UNION ALL SELECT s, NULL, 'NOTE', day FROM o WHERE NOT p AND (i IS NULL OR day IS NULL)""",
    "src_wealth_rules": """
WITH r AS (SELECT list_filter([CASE WHEN c_custkey % 9 = 0 THEN 'period' END, CASE WHEN c_custkey % 4 = 0 THEN 'locator_opening_net_worth' END, CASE WHEN c_custkey % 4 = 0 THEN 'locator_closing_net_worth' END,
  CASE WHEN CAST(c_acctbal AS DECIMAL(24,6)) < 500 THEN 'sign_income' END], lambda x: x IS NOT NULL) AS rules FROM customer)
SELECT rule, count(*) AS rows FROM (SELECT unnest(rules) AS rule FROM r) GROUP BY 1""",
    "loose_values": """
SELECT (SELECT count(*) FROM orders WHERE o_orderkey % 4 <> 0) AS decimals, (SELECT count(*) FROM orders WHERE o_orderkey % 5 <> 0) AS dates, (SELECT max(date_trunc('day', o_orderdate)) FROM orders) AS latest,
  (SELECT count(DISTINCT split_part(url, '/', 1)) FROM pages) AS routes, (SELECT count(DISTINCT substr(regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g'), 1, 180)) FROM pages) AS keys, (SELECT count(*) FROM pages WHERE contains(url, '/resource/celex/')) AS acts""",
    "stream_metric_rollup": "SELECT date_trunc('hour', ts) AS window_start, event_type AS route, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors, "
    + ", ".join(f"count(*) FILTER (l <= {b}) AS le_{k}" for k, b in enumerate(BOUNDS))
    + " FROM (SELECT ts, event_type, CAST(CAST(value AS DECIMAL(24,6)) / 100 AS DECIMAL(24,6)) AS l FROM events) GROUP BY 1, 2",
    "stream_distinct_observations": "SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem",
    "stream_ingest": "SELECT sha256(text) AS digest, min(doc_id) AS batch_id FROM documents GROUP BY 1",
    "stream_versions": "SELECT user_id AS record_id, max(event_id) AS version_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1 HAVING arg_max(event_type, event_id) <> 'error'",
    "stream_audit_seal": ANALYSIS["audit_chain_seal"],
}
