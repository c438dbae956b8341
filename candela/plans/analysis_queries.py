"""Queries on statistics, wealth, rules, resolution, evidence, audit, cases and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from candela.functions.predicates import dimensions_match, not_restricted, overlaps, shown
from candela.functions.text import drop_legal_forms, html_title, normalize_ascii, plain_number, strict_number
from candela.operators import audit, cases, evidence, metrics, quality, resolution, search, statistics, wealth
from candela.plans.views import money, stamp, table
from candela.session import fresh_path, staged

# ---- statistics


def _observations(spark, sf_dir):
    """Orders as published numbers: the nation's total by year; pending ones are text that is no number."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    value = F.concat(F.when(F.col("o_orderstatus") == "P", "<").otherwise(""), money("o_totalprice").cast("decimal(24,2)").cast("string"))
    return rows.select(
        F.pmod("c_nationkey", F.lit(5)).alias("snapshot_id"),
        F.col("c_nationkey").alias("geography"),
        F.year("o_orderdate").cast("long").alias("period"),
        strict_number(value).alias("number"),
        F.col("o_orderpriority").alias("dimension"),
    )


def _specs(spark):
    """Five operations and an unknown one for each of five snapshots, without and with a dimension filter."""
    ops = F.array(*[F.lit(x) for x in (*statistics.OPERATIONS, "median_values")])
    rows = spark.range(5).select(F.col("id").alias("snapshot_id"), F.posexplode(ops).alias("k", "operation"))
    rows = rows.withColumn("dimension", F.explode(F.array(F.lit(None).cast("string"), F.lit("1-URGENT"))))
    name = F.concat_ws("-", "snapshot_id", "operation", F.coalesce("dimension", F.lit("any")))
    return rows.select(name.alias("spec_id"), "snapshot_id", "operation", "dimension", F.lit(1996).cast("long").alias("base_period"), F.lit(1999).cast("long").alias("current_period"))


def _recalculated(spark, sf_dir):
    return statistics.recalculate(_observations(spark, sf_dir), _specs(spark))


def recalculate_batch(spark, sf_dir):
    """V1/G1-G5/F16/F17."""
    return _recalculated(spark, sf_dir).select("spec_id", "operation", "status", F.round(F.col("result").cast("double"), 4).alias("result"), "used")


def _filtered(spark, sf_dir):
    """Specs with filters on single and listed values, on a missing key and on attributes, over orders' numbers."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    value = F.concat(F.when(F.col("o_orderstatus") == "P", "<").otherwise(""), money("o_totalprice").cast("decimal(24,2)").cast("string"))
    own = lambda name: F.array(F.col(name).cast("string"))
    observations = rows.select(
        F.pmod("c_nationkey", F.lit(5)).alias("snapshot_id"), F.col("c_nationkey").alias("geography"), F.year("o_orderdate").cast("long").alias("period"), strict_number(value).alias("number"), F.lit(None).cast("string").alias("dimension"),
        F.create_map(F.lit("segment"), own("c_mktsegment"), F.lit("tags"), F.array(F.col("o_orderpriority"), F.col("o_orderstatus"))).alias("dimensions"),
        F.create_map(F.lit("nation"), own("c_nationkey")).alias("attributes"),
    )
    allowed = lambda **kw: F.create_map(*[x for k, v in kw.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in v]))]) if kw else F.create_map().cast("map<string,array<string>>")
    cases = [("none", {}, {}), ("segment", {"segment": ["BUILDING"]}, {}), ("tags", {"tags": ["1-URGENT", "P"]}, {}), ("both", {"segment": ["BUILDING", "MACHINERY"], "tags": ["F"]}, {"nation": ["1", "2", "3", "4", "5"]}), ("absent", {"region": ["None"]}, {}), ("unmet", {"region": ["EU"]}, {})]
    kinds = F.array(*[F.struct(F.lit(name).alias("name"), allowed(**d).alias("dimension_filters"), allowed(**a).alias("attribute_filters")) for name, d, a in cases])
    ops = F.array(*[F.struct(F.lit(op).alias("operation"), F.lit(how).alias("aggregation")) for op, how in (("count_observations", "sum"), ("mean_values", "sum"), ("percent_change", "sum"), ("percent_change", "mean"))])
    specs = spark.range(5).select(F.col("id").alias("snapshot_id"), F.explode(kinds).alias("f")).select("*", F.explode(ops).alias("o")).select("snapshot_id", "f.*", "o.*")
    name = F.concat_ws("-", "snapshot_id", "operation", "aggregation", "name")
    specs = specs.select(name.alias("spec_id"), "snapshot_id", "operation", "aggregation", "dimension_filters", "attribute_filters", F.lit(None).cast("string").alias("dimension"), F.lit(1996).cast("long").alias("base_period"), F.lit(1999).cast("long").alias("current_period"))
    return specs, statistics.recalculate(observations, specs)


def recalculate_filtered(spark, sf_dir):
    """V1 with P5's lists and G5's mean, as V2's log rows."""
    specs, got = _filtered(spark, sf_dir)
    log = statistics.run_log(specs, got, "1")
    return log.select("spec_id", "snapshot_id", "operation", "engine_version", "status", F.round(F.col("result").cast("double"), 4).alias("result"), "used")


def verify_assertions(spark, sf_dir):
    """V3: three assertions per spec: right, within tolerance, and wrong."""
    got = _recalculated(spark, sf_dir)
    offs = F.array(F.lit(0).cast("decimal(38,12)"), F.lit("0.4").cast("decimal(38,12)"), F.lit(2).cast("decimal(38,12)"))
    asserted = (F.coalesce("result", F.lit(0).cast("decimal(38,12)")) + F.col("off")).cast("decimal(38,12)")
    rows = got.select("spec_id", "result", F.posexplode(offs).alias("k", "off")).select(F.concat_ws("/", "spec_id", "k").alias("assertion_id"), "spec_id", asserted.alias("asserted"), F.lit("0.5").cast("decimal(38,12)").alias("tolerance"))
    return statistics.verify(got, rows).withColumn("delta", F.col("delta").cast("double"))


def page_completeness(spark, sf_dir):
    """V6: pages of orders by day of the month; some pages are damaged."""
    o = table(spark, sf_dir, "orders").select(F.dayofmonth("o_orderdate").alias("snapshot_id"), F.pmod("o_orderkey", F.lit(4)).alias("page_number"))
    size = o.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("total_elements"))
    pages = o.groupBy("snapshot_id", "page_number").agg(F.count(F.lit(1)).alias("rows")).join(size, "snapshot_id")
    pages = pages.where(~((F.col("snapshot_id") == 3) & (F.col("page_number") == 2)))
    total = F.when((F.col("snapshot_id") == 5) & (F.col("page_number") == 1), F.col("total_elements") + 1).otherwise(F.col("total_elements"))
    rows = F.when((F.col("snapshot_id") == 7) & (F.col("page_number") == 0), F.col("rows") - 1).otherwise(F.col("rows"))
    return statistics.page_completeness(pages.select("snapshot_id", (F.col("page_number") + 1).alias("page_number"), F.lit(4).alias("total_pages"), total.alias("total_elements"), rows.alias("rows")))


def dimension_filter(spark, sf_dir):
    """P5: lines whose flag or status is allowed, a missing key comparing as 'None'."""
    line = table(spark, sf_dir, "lineitem")
    dims = F.map_filter(F.create_map(F.lit("flag"), F.array("l_returnflag"), F.lit("status"), F.array("l_linestatus")), lambda k, v: ~((k == "flag") & F.array_contains(v, "N")))
    rows = line.where(dimensions_match(dims, {"flag": ["R", "None"], "status": ["O"]}))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("rows"))


def wealth_bridge(spark, sf_dir):
    """A customer's declarations from its orders of two years."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    per = o.groupBy("o_custkey").agg(*[F.coalesce(F.sum(F.when(F.year("o_orderdate") == y, money("o_totalprice"))), F.lit(0)).cast("decimal(24,6)").alias(f"y{y}") for y in (1996, 1997)])
    zero = F.lit(0).cast("decimal(24,6)")
    rows = c.join(per, F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("c_custkey").alias("entity_id"),
        money("c_acctbal").alias("opening_net_worth"),
        (money("c_acctbal") + F.col("y1996") - F.col("y1997") + F.pmod("c_custkey", F.lit(3)) * 50).cast("decimal(24,6)").alias("closing_net_worth"),
        F.when(F.col("c_custkey") % 10 != 0, F.col("y1996")).alias("income"),
        F.when(F.col("c_custkey") % 15 != 0, zero).alias("gifts"),
        zero.alias("realized_gains"),
        zero.alias("unrealized_gains"),
        F.col("y1997").alias("expenses"),
        zero.alias("taxes"),
        zero.alias("other_net"),
        F.lit(60).cast("decimal(24,6)").alias("tolerance"),
    )
    return wealth.reconcile(rows).select("entity_id", "missing_components", F.col("residual").cast("decimal(30,6)").alias("residual"), "status")


# ---- rules


def _import_rows(spark, sf_dir):
    line, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    rows = line.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(
        F.concat(F.lit("c"), F.col("o_custkey")).alias("subject"),
        F.concat(F.when(F.col("l_linenumber") == 7, "c").otherwise("s"), F.when(F.col("l_linenumber") == 7, F.col("o_custkey")).otherwise(F.col("l_suppkey"))).alias("object"),
        F.when(F.col("l_returnflag") == "A", "AWARDED_TO").when(F.col("l_returnflag") == "N", "SUPPLIER_OF").otherwise("UNKNOWN").alias("relation"),
        F.col("o_orderdate").alias("valid_from"),
        F.col("l_shipdate").alias("valid_to"),
        (money("l_extendedprice") - 1000).alias("amount"),
        F.when(F.col("l_linestatus") == "O", "EUR").otherwise("eur").alias("currency"),
        (F.col("l_quantity") * 3).cast("decimal(7,4)").alias("ownership_percent"),
        F.lit("/x").alias("locator"),
    )


def row_quality(spark, sf_dir):
    """Rows per broken rule."""
    return quality.rule_counts(_import_rows(spark, sf_dir), quality.edge_rules())


def row_quarantine(spark, sf_dir):
    """Valid and quarantined rows."""
    good, bad = quality.split(_import_rows(spark, sf_dir), quality.edge_rules())
    return good.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("valid").alias("part"), "rows").unionByName(bad.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("quarantine").alias("part"), "rows"))


def unresolved_references(spark, sf_dir):
    """Suppliers of lines that the kept suppliers lack."""
    line = table(spark, sf_dir, "lineitem")
    edges = line.select(F.concat(F.lit("p"), F.col("l_partkey")).alias("subject"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("object"), F.lit(None).cast("string").alias("contract"))
    kept = table(spark, sf_dir, "supplier").where("s_suppkey % 7 <> 0").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("key"))
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("key"))
    return quality.unresolved(edges, kept.unionByName(parts))


def validity_overlap(spark, sf_dir):
    """Lines valid from shipping (some without end) that overlap a window, without synthetic ones."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("a"), F.when(F.col("l_linenumber") != 1, F.col("l_shipdate") + F.expr("INTERVAL 30 DAYS")).alias("b"), (F.col("l_returnflag") == "A").alias("demo"))
    rows = line.where(overlaps(F.col("a"), F.col("b"), stamp("1996-06-01"), stamp("1996-06-30")) & shown(F.col("demo"), False))
    return rows.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("rows"))


def restricted_evidence(spark, sf_dir):
    """P10: documents shown to those who aren't admins."""
    d = table(spark, sf_dir, "documents")
    now, then = F.when(F.col("doc_id") % 5 == 0, "RESTRICTED"), F.when(F.col("doc_id") % 7 == 0, "RESTRICTED").otherwise("PUBLIC")
    return d.where(not_restricted(now, then, False)).select("doc_id")


# ---- resolution


def _named(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    name = F.concat_ws(" ", F.col("p_name"), F.col("p_type"), F.col("p_brand"), F.when(F.col("p_partkey") % 3 == 0, "GmbH").when(F.col("p_partkey") % 3 == 1, "S.A."))
    return p.select(F.col("p_partkey").alias("entity_id"), F.when(F.col("p_size") % 2 == 0, "ORGANIZATION").otherwise("PUBLIC_BODY").alias("entity_type"), drop_legal_forms(normalize_ascii(name)).alias("normalized_name"), F.when(F.col("p_size") % 5 != 0, (F.col("p_size") % 5).cast("string")).alias("jurisdiction_code"))


def name_normalization(spark, sf_dir):
    """F1/F2/ER1: rows per normalised name."""
    return _named(spark, sf_dir).groupBy("normalized_name").agg(F.count(F.lit(1)).alias("entities"))


def name_candidates(spark, sf_dir):
    """ER3/F4/J9/W7: each entity's five best partners by name."""
    rows = resolution.name_candidates(_named(spark, sf_dir))
    return rows.select("entity_id", "other_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def review_queue(spark, sf_dir):
    """ER4/F22: candidate pairs that no open entry holds."""
    found = staged(resolution.name_candidates(_named(spark, sf_dir)), "candidates")
    held = found.where("(entity_id + other_id) % 4 = 0").select(F.least(F.col("entity_id").cast("string"), F.col("other_id").cast("string")).alias("entity_a"), F.greatest(F.col("entity_id").cast("string"), F.col("other_id").cast("string")).alias("entity_b"))
    rows = resolution.review_queue(found, held.distinct())
    return rows.select("entity_a", "entity_b", F.round("score", 6).alias("score"))


def pair_scoring(spark, sf_dir):
    """ER2/U3/U4/F3/F5: each customer against the next one of its nation and segment."""
    c = table(spark, sf_dir, "customer")

    def side(k):
        key = F.col(f"{k}.c_custkey")
        ids = F.map_filter(F.create_map(F.lit("lei"), F.when(key % 4 == 0, F.concat(F.lit("L-"), F.floor(key / 8).cast("string"))), F.lit("VAT"), F.when(key % 6 == 0, F.lit("V 1"))), lambda _, v: v.isNotNull())
        return F.struct(
            F.when(key % 5 == 0, "PERSON").otherwise("ORGANIZATION").alias("entity_type"),
            F.concat(F.lit("Holding "), F.col(f"{k}.c_mktsegment"), F.lit(" Ltd")).alias("name"),
            F.col(f"{k}.c_nationkey").cast("string").alias("jurisdiction_code"),
            F.concat(F.lit("Street "), F.col(f"{k}.c_nationkey").cast("string")).alias("address"),
            ids.alias("identifiers"),
            F.array((key % 3).cast("string"), (key % 4).cast("string")).alias("directors"),
            F.date_add(F.lit("2000-01-01").cast("date"), (key % 2).cast("int")).alias("incorporation_date"),
        )

    w_key = F.expr("lead(c_custkey) over (partition by c_nationkey, c_mktsegment order by c_custkey)")
    a = c.withColumn("next_key", w_key).alias("a")
    pairs = a.join(c.alias("b"), F.col("a.next_key") == F.col("b.c_custkey")).select(F.col("a.c_custkey").alias("pair_id"), side("a").alias("left"), side("b").alias("right"))
    rows = resolution.score_pairs(pairs)
    return rows.select("pair_id", "score", "decision", F.array_join("reasons", "; ").alias("reasons"))


def identifier_resolution(spark, sf_dir):
    """ER5/ER6/J10/J11/P6: orders' clerks as external records, by mapping, identifier or minted id."""
    o, s = table(spark, sf_dir, "orders"), table(spark, sf_dir, "supplier")
    records = o.select(F.lit("feed").alias("source"), F.col("o_orderkey").cast("string").alias("external_key"), F.lit("VAT").alias("scheme"), F.when(F.col("o_orderkey") % 4 != 0, (F.col("o_custkey") % 150).cast("string")).alias("value"), F.when(F.col("o_orderkey") % 3 != 0, (F.col("o_custkey") % 2).cast("string")).alias("country"))
    mappings = o.where("o_orderkey % 6 = 0").select(F.lit("feed").alias("source"), F.col("o_orderkey").cast("string").alias("external_key"), F.concat(F.lit("m"), F.col("o_custkey")).alias("entity_id"))
    ids = s.select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("entity_id"), F.lit("VAT").alias("scheme"), (F.col("s_suppkey") % 60).cast("string").alias("value"), F.when(F.col("s_suppkey") % 5 != 0, (F.col("s_suppkey") % 2).cast("string")).alias("country"), (F.col("s_suppkey") % 3 == 0).alias("verified"), F.col("s_suppkey").alias("created_at"))
    return resolution.resolve(records, mappings, ids)


def identifier_upsert(spark, sf_dir):
    """ER7/J12: identifiers verified if any row is, the first source kept."""
    line = table(spark, sf_dir, "lineitem")
    rows = line.groupBy("l_suppkey", "l_returnflag", "l_orderkey").agg(F.max(F.col("l_linestatus") == "O").alias("v"))
    return resolution.merge_identifiers(rows.select(F.col("l_suppkey").alias("entity_id"), F.col("l_returnflag").alias("scheme"), (F.col("l_suppkey") % 10).alias("value"), F.col("v").alias("verified"), F.col("l_orderkey").alias("source_record_id"), F.col("l_orderkey").alias("seq")))


def identifier_type_clash(spark, sf_dir):
    """C7."""
    c = table(spark, sf_dir, "customer")
    rows = c.select(F.lit("VAT").alias("scheme"), F.floor(F.col("c_custkey") / 3).cast("string").alias("value"), F.when(F.col("c_nationkey") % 2 == 0, "PERSON").otherwise("ORGANIZATION").alias("entity_type"))
    return resolution.type_clashes(rows).select("scheme", "value", "types")


def entity_search(spark, sf_dir):
    """ER10/F6/P7/P8/T1: terms from the nations' and types' words against part names."""
    q = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("query_id"), F.element_at(F.array(*[F.lit(x) for x in ("  RED  widget", "blue b", "small ring eco", "brand 17", "zzz")]), F.col("r_regionkey") + 1).alias("query"), F.when(F.col("r_regionkey") % 2 == 0, "ORGANIZATION").alias("entity_type"), F.lit(20).alias("top"))
    rows = search.search(_named(spark, sf_dir), q)
    return rows.select("query_id", "entity_id", "normalized_name", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def entity_search_as_of(spark, sf_dir):
    """ER10/W1/P4/P8/T1: every part type against the part names known at a cutoff, without demo rows."""
    own = _named(spark, sf_dir).select("entity_id", "entity_type", "normalized_name", (F.col("entity_id") % 13 == 0).alias("is_demo"))
    key = F.col("entity_id")
    # Some names change before the cutoff, some after it, and some entities are deleted.
    versions = F.array(
        F.struct(F.lit(1).alias("version_id"), stamp("2024-01-01").alias("committed_at"), F.lit("INSERT").alias("operation"), F.lit("").alias("more")),
        F.struct(F.lit(2).alias("version_id"), F.when(key % 8 < 4, stamp("2024-01-10")).otherwise(stamp("2024-02-10")).alias("committed_at"), F.when(key % 9 == 0, "DELETE").otherwise("UPDATE").alias("operation"), F.lit(" renewed").alias("more")),
    )
    log = own.select("*", F.explode(F.when(key % 4 == 0, versions).otherwise(F.slice(versions, 1, 1))).alias("v")).select("entity_id", "entity_type", F.concat("normalized_name", "v.more").alias("normalized_name"), "is_demo", "v.version_id", "v.committed_at", "v.operation")
    q = table(spark, sf_dir, "part").select("p_type").distinct().select(F.col("p_type").alias("query_id"), F.concat(F.lit(" "), F.upper("p_type"), F.lit("  renewed")).alias("query"), F.lit(None).cast("string").alias("entity_type"), F.lit(10).alias("top"))
    rows = search.search_as_of(log, q, stamp("2024-01-20"))
    return rows.select("query_id", "entity_id", "normalized_name", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def legal_titles(spark, sf_dir):
    """S10."""
    return table(spark, sf_dir, "pages").select("page_id", html_title(F.col("html")).alias("title"))


# ---- evidence and audit


def _objects(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("source", F.concat(F.lit("doc/"), F.col("doc_id") % 700, F.lit(" v")).alias("external_id"), F.encode("text", "UTF-8").alias("content"))


def evidence_manifest(spark, sf_dir):
    """K1/F20."""
    return evidence.manifest(_objects(spark, sf_dir))


def evidence_write(spark, sf_dir):
    """K1/V7: objects put, put again with some new ones, and put once more after the bytes of some have changed."""
    own = _objects(spark, sf_dir)
    store = evidence.EvidenceStore(spark, fresh_path(spark, "evidence"))
    first = store.put(own.where("octet_length(content) % 3 <> 0"), "first")
    second = store.put(own, "second")
    # Bytes of the second put that change behind the store's back.
    rows = store.objects().where("put = 'second'").withColumn("content", F.when(F.col("byte_length") % 4 == 0, F.encode(F.lit("changed"), "UTF-8")).otherwise(F.col("content")))
    staged(rows.drop("put"), "changed").write.mode("overwrite").parquet(f"{store.path}/objects/put=second")
    told = staged(store.changed().select("object_key", F.lit("CHANGED").alias("status")), "told")
    third = store.put(own, "third")
    none = store.changed().select("object_key", F.lit("STILL_CHANGED").alias("status"))
    parts = [("1 put", first), ("2 put", second), ("3 check", told), ("4 put", third), ("5 check", none)]
    out = None
    for name, rows in parts:
        rows = rows.select(F.lit(name).alias("step"), "object_key", "status")
        out = rows if out is None else out.unionByName(rows)
    return out


def evidence_missing(spark, sf_dir):
    """V7/V8/K1: manifest rows that the store lacks."""
    own = evidence.manifest(_objects(spark, sf_dir))
    return evidence.not_stored(own, own.where("byte_length % 3 <> 0")).select("object_key", "byte_length")


def evidence_tampered(spark, sf_dir):
    """V7: stored objects whose registered hash differs."""
    own = evidence.manifest(_objects(spark, sf_dir))
    registered = own.withColumn("content_hash", F.when(F.col("byte_length") % 4 == 0, F.sha2("object_key", 256)).otherwise(F.col("content_hash")))
    return evidence.tampered(own, registered).select("object_key", "registered_hash")


def evidence_digest(spark, sf_dir):
    """G11."""
    d = table(spark, sf_dir, "documents").select("source", F.col("doc_id"), F.sha2("text", 256).alias("h"))
    return evidence.set_digest(d, "source", "doc_id", "h")


def artifact_upsert(spark, sf_dir):
    """K2/K3/K9/ER8: the latest row per source and external id over two loads."""
    d = table(spark, sf_dir, "documents").select("source", (F.col("doc_id") % 300).alias("external_id"), F.col("doc_id").alias("seq"), F.sha2("text", 256).alias("content_hash"))
    return evidence.upsert_latest(d.where("seq % 2 = 0"), d.where("seq % 2 = 1"), ["source", "external_id"], ["seq"])


def import_idempotence(spark, sf_dir):
    """K7/F8: batches that no successful receipt has."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("batch_id"), F.sha2("text", 256).alias("digest"))
    receipts = d.select("digest", F.when(F.col("batch_id") % 3 == 0, "SUCCEEDED").otherwise("FAILED").alias("status")).distinct()
    return evidence.new_batches(d, receipts)


PAYLOAD = ["event_id", "event_type", "props"]


def audit_chain_seal(spark, sf_dir):
    """ST6/B21: a chain per user."""
    e = table(spark, sf_dir, "events").select("user_id", *PAYLOAD)
    return audit.seal(e, "user_id", "event_id", PAYLOAD).select("user_id", "event_id", "previous_hash", "event_hash")


def audit_chain_check(spark, sf_dir):
    """Broken events after some were altered."""
    e = table(spark, sf_dir, "events").select("user_id", *PAYLOAD)
    sealed = audit.seal(e, "user_id", "event_id", PAYLOAD)
    altered = sealed.withColumn("props", F.when(F.col("event_id") % 97 == 0, "{}").otherwise(F.col("props"))).where("event_id % 101 <> 0")
    return audit.check(altered, "user_id", "event_id", PAYLOAD).select("event_id", "link_ok", "hash_ok")


# ---- cases


def case_state(spark, sf_dir):
    """Events of users as actions on cases."""
    action = F.when(F.col("event_type") == "view", "review").when(F.col("event_type") == "click", "publish").when(F.col("event_type") == "error", "appeal").when(F.col("event_type") == "signup", "withdraw").otherwise("note")
    return cases.case_states(table(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), F.col("event_id").alias("seq"), action.alias("action")))


def case_releases(spark, sf_dir):
    """Each publication of users' cases, with what ended it."""
    action = F.when(F.col("event_type") == "view", "review").when(F.col("event_type") == "click", "publish").when(F.col("event_type") == "error", "appeal").when(F.col("event_type") == "signup", "withdraw").otherwise("note")
    return cases.case_releases(table(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), F.col("event_id").alias("seq"), action.alias("action")))


def public_releases(spark, sf_dir):
    """K6/T3."""
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").alias("release_id"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("summary"), F.col("o_orderdate").alias("published_at"), F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate")).alias("withdrawn_at"))
    return cases.public_releases(rows, 100)


def duty_violations(spark, sf_dir):
    """C8."""
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").alias("case_id"), (F.col("o_custkey") % 7).alias("creator"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 7).alias("reviewer"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 5).alias("publisher"))
    return cases.duty_violations(rows)


def claim_review(spark, sf_dir):
    """B16/C9/G6."""
    o, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    claims = o.where("o_orderkey % 13 <> 0").select(F.col("o_orderkey").alias("claim_id"), F.lit("UNVERIFIED").alias("verification_status"))
    reviews = o.select(F.col("o_orderkey").alias("claim_id"), F.when(F.col("o_orderstatus") == "F", "VERIFIED_PRIMARY").when(F.col("o_orderstatus") == "O", "CORROBORATED").otherwise("RETRACTED").alias("new_status"))
    return cases.review_claims(claims, reviews, line.select(F.col("l_orderkey").alias("claim_id"), (F.col("l_linenumber") == 7).alias("is_demo")))


def validity_correction(spark, sf_dir):
    """B15."""
    o = table(spark, sf_dir, "orders")
    edges = o.select(F.col("o_orderkey").alias("edge_id"), F.col("o_orderdate").alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"), F.lit("VERIFIED_PRIMARY").alias("verification_status"))
    fixes = edges.where("edge_id % 9 = 0").select("edge_id", (F.col("valid_from") - F.expr("INTERVAL 10 DAYS")).alias("valid_from"), F.col("valid_from").alias("valid_to"))
    return cases.correct_validity(edges, fixes)


def parser_retirement(spark, sf_dir):
    """B14/G14."""
    line = table(spark, sf_dir, "lineitem")
    rows = line.select(F.when(F.col("l_returnflag") == "R", "parser/1").otherwise("parser/2").alias("derivation_method"), F.lit("UNVERIFIED").alias("verification_status"), (F.col("l_linestatus") == "F").alias("superseded"))
    return cases.retire_parser(rows, "parser/1").groupBy("derivation_method", "verification_status", "superseded").agg(F.count(F.lit(1)).alias("rows"))


# ---- metrics, listings


def _requests(spark, sf_dir):
    status = F.when(F.col("event_type") == "error", 500).otherwise(200)
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("route"), status.alias("status"), (money("value") / 100).cast("decimal(24,6)").alias("latency"))


def request_metrics(spark, sf_dir):
    """G12/F21."""
    rows = metrics.request_metrics(_requests(spark, sf_dir), ["route"])
    return rows.withColumn("latency_sum", F.col("latency_sum").cast("decimal(34,6)"))


def latency_percentiles(spark, sf_dir):
    """G13."""
    return metrics.latency_percentiles(_requests(spark, sf_dir), ["route"])


def reconciliation_summary(spark, sf_dir):
    """Four filtered counts."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("part"), "rows")
    parts = [("active_edges", table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")), ("observations", table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'")), ("entities", table(spark, sf_dir, "customer")), ("open_reviews", table(spark, sf_dir, "events").where("event_type = 'error'"))]
    out = count(parts[0][1], parts[0][0])
    for name, df in parts[1:]:
        out = out.unionByName(count(df, name))
    return out


def keyset_page(spark, sf_dir):
    """The page of 50 events after one."""
    return table(spark, sf_dir, "events").where("event_id > 1000").orderBy("event_id").limit(50).select("event_id", "event_type")


def history_topk(spark, sf_dir):
    """The 25 newest errors, ties by id."""
    return table(spark, sf_dir, "events").where("event_type = 'error'").orderBy(F.col("ts").desc(), "event_id").limit(25).select("event_id", "ts", "user_id")


def import_report(spark, sf_dir):
    """Per source how many documents, distinct texts, and the latest one."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.countDistinct(F.sha2("text", 256)).alias("texts"), F.max("doc_id").alias("latest"))


def plain_numbers(spark, sf_dir):
    """results as plain text."""
    return table(spark, sf_dir, "lineitem").select(plain_number((money("l_extendedprice") / 8).cast("decimal(38,12)")).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("rows"))


QUERIES = {
    f.__name__: f
    for f in (
        recalculate_batch, recalculate_filtered, verify_assertions, page_completeness, dimension_filter, wealth_bridge, row_quality, row_quarantine, unresolved_references, validity_overlap,
        evidence_write, case_releases, restricted_evidence, name_normalization, name_candidates, review_queue, pair_scoring, identifier_resolution, identifier_upsert, identifier_type_clash, entity_search, entity_search_as_of,
        legal_titles, evidence_manifest, evidence_missing, evidence_tampered, evidence_digest, artifact_upsert, import_idempotence, audit_chain_seal, audit_chain_check,
        case_state, public_releases, duty_violations, claim_review, validity_correction, parser_retirement, request_metrics, latency_percentiles, reconciliation_summary,
        keyset_page, history_topk, import_report, plain_numbers,
    )
}
