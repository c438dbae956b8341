"""The model's tables, derived by Spark from the given ones; each has its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(column: str) -> Column:
    return F.col(column).cast("decimal(24,6)")


def stamp(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def version_log(spark, sf_dir) -> DataFrame:
    """events as versions of users; an error deletes."""
    operation = F.when(F.col("event_type") == "error", "DELETE").otherwise("UPDATE")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("record_id"), F.col("event_id").alias("version_id"), F.col("ts").alias("committed_at"), operation.alias("operation"), "event_type", money("value").alias("value"))


LOG = "SELECT user_id AS record_id, event_id AS version_id, ts AS committed_at, CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'UPDATE' END AS operation, event_type, CAST(value AS DECIMAL(24,6)) AS value FROM events"


def observations(spark, sf_dir) -> DataFrame:
    """lineitem as observations that a supplier supplies a part, in the order's record."""
    rows = table(spark, sf_dir, "lineitem")
    n = F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100 + F.pmod(F.col("l_partkey") + F.col("l_suppkey"), F.lit(100))
    return rows.select(
        n.alias("observation_id"),
        F.col("l_orderkey").alias("source_record_id"),
        F.concat(F.lit("p"), F.col("l_partkey")).alias("subject_id"),
        F.lit("SUPPLIER_OF").alias("relation"),
        F.concat(F.lit("s"), F.col("l_suppkey")).alias("object_id"),
        F.lit(None).cast("timestamp_ntz").alias("valid_from"),
        F.lit(None).cast("timestamp_ntz").alias("valid_to"),
        F.col("l_shipdate").alias("observed_at"),
        money("l_extendedprice").alias("amount"),
        F.when(F.col("l_linestatus") == "O", "EUR").otherwise("USD").alias("currency"),
    )


OBSERVATIONS = """
SELECT l_orderkey * 1000 + l_linenumber * 100 + (l_partkey + l_suppkey) % 100 AS observation_id, l_orderkey AS source_record_id,
  'p' || l_partkey AS subject_id, 'SUPPLIER_OF' AS relation, 's' || l_suppkey AS object_id, l_shipdate AS observed_at,
  CAST(l_extendedprice AS DECIMAL(24,6)) AS amount, CASE WHEN l_linestatus = 'O' THEN 'EUR' ELSE 'USD' END AS currency FROM lineitem
"""
KEYED = f"""
o AS ({OBSERVATIONS}),
k AS (SELECT *, sha256('=' || subject_id || '|=' || relation || '|=' || object_id || '|~|~') AS semantic_key FROM o),
keyed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_record_id, semantic_key ORDER BY observed_at, observation_id, amount, currency) AS rn FROM k) WHERE rn = 1)
"""


def notices(spark, sf_dir) -> DataFrame:
    """orders as tender notices: the customer buys, the distinct suppliers win."""
    won = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.concat(F.lit("s"), F.col("l_suppkey")))).alias("winners"))
    orders = table(spark, sf_dir, "orders")
    return orders.join(won, orders["o_orderkey"] == won["l_orderkey"]).select(
        F.col("o_orderkey").cast("string").alias("notice_id"),
        F.array(F.concat(F.lit("c"), F.col("o_custkey"))).alias("buyers"),
        "winners",
        money("o_totalprice").alias("total_value"),
        F.lit("EUR").alias("currency"),
        F.col("o_orderdate").cast("date").alias("decision_date"),
    )


NOTICES = """
SELECT CAST(o_orderkey AS VARCHAR) AS notice_id, 'c' || o_custkey AS buyer, w.winners, CAST(o_totalprice AS DECIMAL(24,6)) AS total_value,
  CAST(o_orderdate AS DATE) AS decision_date FROM orders JOIN (SELECT l_orderkey, list_sort(list(DISTINCT 's' || l_suppkey)) AS winners FROM lineitem GROUP BY 1) w ON o_orderkey = l_orderkey
"""


def _claimed(claim, retracted, superseded):
    """A claim's columns: its id, and whether it is retracted or its edge superseded."""
    status = F.when(retracted, "RETRACTED").otherwise("VERIFIED_PRIMARY")
    return [claim.alias("claim_id"), status.alias("verification_status"), F.when(superseded, F.lit("2024-01-01").cast("timestamp_ntz")).alias("superseded_at")]


def awards(spark, sf_dir) -> DataFrame:
    """Distinct (order, supplier) of orders that aren't pending."""
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    rows = line.join(orders.where("o_orderstatus <> 'P'"), F.col("l_orderkey") == F.col("o_orderkey"))
    found = rows.select(F.col("o_orderkey").alias("award_id"), F.col("o_custkey").alias("body_id"), F.col("l_suppkey").alias("company_id"), F.col("o_orderdate").cast("date").alias("decision_date")).distinct()
    return found.select("*", *_claimed(F.concat_ws("-", F.lit("a"), "award_id", "company_id"), F.col("award_id") % 19 == 0, F.lit(False)))


def roles(spark, sf_dir) -> DataFrame:
    """A customer has a role in the ten with the next keys, from some day on."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    a = c.select(F.col("c_custkey").alias("person_id"), F.explode(F.sequence(F.col("c_custkey") + 1, F.col("c_custkey") + 10)).alias("body_id"))
    start = F.date_add(F.lit("1992-01-01").cast("date"), F.pmod("person_id", F.lit(2000)).cast("int")).cast("timestamp_ntz")
    rows = a.join(c.select(F.col("c_custkey").alias("body_id")), "body_id", "left_semi")
    claim = _claimed(F.concat_ws("-", F.lit("r"), "person_id", "body_id"), F.col("body_id") % 17 == 0, F.col("person_id") % 29 == 0)
    return rows.select("person_id", "body_id", start.alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"), (F.col("person_id") % 23 == 0).alias("is_demo"), *claim)


def owns(spark, sf_dir) -> DataFrame:
    """A customer owns the supplier whose key is its own modulo their number."""
    n = table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n"))
    c = table(spark, sf_dir, "customer").crossJoin(F.broadcast(n))  # one row
    none = F.lit(None).cast("timestamp_ntz")
    claim = _claimed(F.concat_ws("-", F.lit("o"), F.col("c_custkey")), F.col("c_custkey") % 31 == 0, F.col("c_custkey") % 13 == 0)
    return c.select(F.col("c_custkey").alias("person_id"), F.pmod("c_custkey", "n").alias("company_id"), none.alias("valid_from"), none.alias("valid_to"), *claim)


def all_edges(spark, sf_dir) -> DataFrame:
    """Edges between customer and supplier of all lines, valid for a year from the first order."""
    return _edges_of(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"))


def _edges_of(line, orders) -> DataFrame:
    rows = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    per = rows.groupBy("o_custkey", "l_suppkey").agg(F.min("o_orderdate").alias("valid_from"), F.count(F.lit(1)).alias("observation_count"))
    return per.select(
        F.concat_ws("-", F.col("o_custkey"), F.col("l_suppkey")).alias("edge_id"),
        F.concat(F.lit("c"), F.col("o_custkey")).alias("subject_id"),
        F.concat(F.lit("s"), F.col("l_suppkey")).alias("object_id"),
        "valid_from",
        (F.col("valid_from") + F.expr("INTERVAL 365 DAYS")).alias("valid_to"),
        F.col("valid_from").alias("observed_at"),
        "observation_count",
    )


ALL_EDGES = """
SELECT o_custkey || '-' || l_suppkey AS edge_id, 'c' || o_custkey AS a, 's' || l_suppkey AS b, min(o_orderdate) AS valid_from,
  min(o_orderdate) + INTERVAL 365 DAYS AS valid_to, count(*) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_suppkey
"""

def path_requests(spark, sf_dir) -> DataFrame:
    """A request from each supplier to the one with the next number, and from each nation's first supplier to its first customer."""
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    following = s.select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("source_id"), F.concat(F.lit("s"), F.col("s_suppkey") + 1).alias("target_id"))
    first = s.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("s")).join(c.groupBy("c_nationkey").agg(F.min("c_custkey").alias("c")), F.col("s_nationkey") == F.col("c_nationkey"))
    rows = following.unionByName(first.select(F.concat(F.lit("s"), "s").alias("source_id"), F.concat(F.lit("c"), "c").alias("target_id")))
    none = F.lit(None).cast("timestamp_ntz")
    return rows.select(F.concat_ws(">", "source_id", "target_id").alias("request_id"), "source_id", "target_id", none.alias("from_time"), none.alias("to_time"), F.lit(5).alias("top"))


PATH_REQUESTS = """
SELECT s || '>' || t AS request_id, s AS source_id, t AS target_id, 5 AS top FROM (
  SELECT 's' || s_suppkey AS s, 's' || (s_suppkey + 1) AS t FROM supplier
  UNION ALL SELECT 's' || s, 'c' || c FROM (SELECT s_nationkey AS n, min(s_suppkey) AS s FROM supplier GROUP BY 1) JOIN (SELECT c_nationkey AS n, min(c_custkey) AS c FROM customer GROUP BY 1) USING (n)
)"""
