"""Queries on feeds and streams: payloads are made of the given tables by Spark and parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from candela.functions.text import celex_of, instant, loose_date, loose_decimal, object_key, route_group
from candela.operators import imports, quality, temporal
from candela.plans import views
from candela.plans.analysis_queries import PAYLOAD
from candela.plans.views import money, table
from candela.session import fresh_path, staged, staging
from candela.sources import archives, feeds, landing, legal_xml, registers
from candela.streaming import jobs


#: The tag of the export that the queries build and read.
PROCUREMENT_TAG = "procurement-export/1"
#: Order keys whose acts share a file.
ACT_KEYS = 40_000


def _through_json(rows, schema):
    """rows as JSON text, parsed back by the feed's schema and staged once for the readers' branches."""
    return staged(rows.select(F.to_json(F.struct(*rows.columns)).alias("j")).select(F.from_json("j", schema).alias("r")).select("r.*"), "feed")


def _parsed_rows(parsed):
    """Entities, edges and problems with all their columns in one table; times are seconds."""
    columns = {c: F.lit(None).cast("string") for c in ("a", "b", "scheme", "identifier", "currency", "contract", "locator", "level")}
    columns |= {"valid_from": F.lit(None).cast("long"), "valid_to": F.lit(None).cast("long"), "amount": F.lit(None).cast("double"), "percent": F.lit(None).cast("double")}

    def rows(frame, part, kind, **given):
        return frame.select(F.lit(part).alias("part"), F.col(kind).alias("kind"), *[given.get(c, none).alias(c) for c, none in columns.items()])

    same = lambda *names: {c: F.col(c) for c in names}
    second = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    entities = rows(parsed.entities, "entity", "entity_type", a=F.col("key"), b=F.col("name"), **same("scheme", "identifier"))
    edges = rows(
        parsed.edges, "edge", "relation", a=F.col("subject"), b=F.col("object"), valid_from=second("valid_from"), valid_to=second("valid_to"),
        amount=F.col("amount").cast("double"), percent=F.col("ownership_percent").cast("double"), **same("currency", "contract", "locator"),
    )
    return entities.unionByName(edges).unionByName(rows(parsed.problems, "problem", "reason", **same("locator", "level")))


def _releases(spark, sf_dir):
    """Orders as releases; pending ones are not active."""
    n = views.notices(spark, sf_dir).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("notice_id"), "o_orderstatus"), "notice_id")
    buyer = F.col("buyers")[0]
    party = lambda i: F.struct(i.alias("id"), F.concat(F.lit("N "), i).alias("name"))
    rows = n.select(
        F.lit("p").alias("package"), F.col("notice_id").cast("int").alias("position"), F.lit("1.1").alias("version"), F.concat(F.lit("o-"), "notice_id").alias("ocid"), F.col("notice_id").alias("id"), F.col("decision_date").cast("string").alias("date"),
        F.struct(buyer.alias("id")).alias("buyer"),
        F.transform(F.concat("buyers", "winners"), party).alias("parties"),
        F.array(F.struct(F.lit("1").alias("id"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise("active").alias("status"), F.col("decision_date").cast("string").alias("date"), F.struct(F.col("total_value").alias("amount"), F.lit("EUR").alias("currency")).alias("value"), F.transform("winners", party).alias("suppliers"))).alias("awards"),
    )
    return _through_json(rows, feeds.OCDS)


def _contracting(spark, sf_dir):
    return feeds.contracting_releases(_releases(spark, sf_dir))


def src_contracting(spark, sf_dir):
    """S1/P13."""
    return _parsed_rows(_contracting(spark, sf_dir))


def import_job(spark, sf_dir):
    """What the import of the releases wrote, read back: entities, edges, claims, flows, ownership and quarantine."""
    empty = [spark.createDataFrame([], s) for s in (imports.NO_MAPPINGS, imports.NO_IDENTIFIERS)]
    path = fresh_path(spark, "import")
    # What the import stages goes when its tables are written.
    with staging(spark):
        imports.write_import(imports.import_tables(_contracting(spark, sf_dir), "releases", "batch-1", *empty), path, "1", "none")
    shown = {
        "entities": ("entity_id", "name", "entity_type", None),
        "edges": ("subject_id", "object_id", "relation", None),
        "claims": ("subject_entity_id", None, "predicate", None),
        "money_flows": ("payer_id", "recipient_id", "flow_state", "amount"),
        "ownership": ("owner_id", "owned_id", None, "ownership_percent"),
        "quarantine": (None, None, "reason", None),
    }
    out = None
    for name, columns in shown.items():
        a, b, kind, amount = [F.col(c) if c else F.lit(None) for c in columns]
        own = spark.read.parquet(f"{path}/{name}").select(F.lit(name).alias("part"), a.cast("string").alias("a"), b.cast("string").alias("b"), kind.cast("string").alias("kind"), amount.cast("double").alias("amount"))
        out = own if out is None else out.unionByName(own)
    return out


def import_replay(spark, sf_dir):
    """Releases imported, imported again, and rows of no known format: results, jobs, audit rows and tables."""
    store = imports.ImportStore(spark, fresh_path(spark, "imports"))
    rows = _releases(spark, sf_dir)
    results = [store.run("releases", rows, "releases", "orders", "importer") for _ in range(2)]
    try:
        store.run("spreadsheet", rows, "sheets", "orders", "importer")
    except ValueError:
        pass  # what is left of it is in the receipts, jobs and audit rows
    said = [("result", f"{k} {name}", str(n)) for k, r in enumerate(results) for name, n in [("replayed", r["replayed"]), *r["counts"].items()] if name != "problems"]
    out = spark.createDataFrame(said, "part string, name string, value string")
    kept = store.receipts().select(F.lit("receipt").alias("part"), F.col("format").alias("name"), F.coalesce("error_code", "status").alias("value"))
    held = store.jobs().select(F.lit("job").alias("part"), "status", F.concat_ws("/", F.coalesce("source_record_id", F.lit("-")), F.coalesce("error", F.lit("-")), "entries"))
    notes = store.audit_log().select(F.lit("audit").alias("part"), "action", "details")
    edges = store.table("edges").select(F.lit("edges").alias("part"), "relation", F.concat_ws(">", "subject_id", "object_id"))
    for part in (kept, held, notes, edges):
        out = out.union(part)
    return out


def document_versions(spark, sf_dir):
    """Documents of a source under one external id as versions, equal texts once."""
    d = table(spark, sf_dir, "documents")
    rows = imports.document_versions(d.select("source", (F.col("doc_id") % 100).alias("external_id"), F.sha2("text", 256).alias("content_hash"), F.substring_index("text", "\n", 1).alias("title"), F.col("doc_id").alias("seen_at")))
    return rows.select("source", "external_id", "content_hash", "title", "seen_at", F.col("version").cast("long").alias("version"))


def src_envelopes(spark, sf_dir):
    """Nations as envelopes of their customers and suppliers."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    e = c.select("c_nationkey", F.struct(F.concat(F.lit("c"), "c_custkey").alias("key"), F.col("c_name").alias("name"), F.lit("PUBLIC_BODY").alias("entity_type")).alias("e"))
    e = e.unionByName(s.select(F.col("s_nationkey").alias("c_nationkey"), F.struct(F.concat(F.lit("s"), "s_suppkey").alias("key"), F.col("s_name").alias("name"), F.lit("ORGANIZATION").alias("entity_type")).alias("e")))
    r = c.select("c_nationkey", F.struct(F.concat(F.lit("c"), "c_custkey").alias("subject"), F.concat(F.lit("s"), F.col("c_custkey") % 10).alias("object"), F.lit("AWARDED_TO").alias("relation"), money("c_acctbal").alias("amount"), F.lit("/r").alias("locator")).alias("r"))
    left = e.groupBy("c_nationkey").agg(F.collect_list("e").alias("entities"))
    rows = left.join(r.groupBy("c_nationkey").agg(F.collect_list("r").alias("relationships")), "c_nationkey").drop("c_nationkey")
    return _parsed_rows(landing.normalized_envelopes(_through_json(rows, landing.ENVELOPE)))


def _people(spark, sf_dir):
    return views.owns(spark, sf_dir).select("person_id", "company_id")


def src_ownership_statements(spark, sf_dir):
    """Customers as persons, suppliers as entities, one ownership statement per customer."""
    c, s = _people(spark, sf_dir), table(spark, sf_dir, "supplier")
    details = F.struct(F.lit("0.3").alias("bodsVersion")).alias("publicationDetails")
    person = c.select((F.col("person_id") * 2).cast("int").alias("position"), F.concat(F.lit("c"), "person_id").alias("statementID"), F.lit("personStatement").alias("statementType"), details, F.when(F.col("person_id") % 10 == 0, "unknownPerson").otherwise("knownPerson").alias("personType"), F.array(F.struct(F.concat(F.lit("P "), "person_id").alias("fullName"))).alias("names"))
    entity = s.select((F.col("s_suppkey") + 10_000_000).cast("int").alias("position"), F.concat(F.lit("s"), "s_suppkey").alias("statementID"), F.lit("entityStatement").alias("statementType"), details, F.col("s_name").alias("name"))
    interest = lambda kind, exact: F.struct(kind.alias("type"), (F.col("person_id") % 2 == 0).alias("isBeneficialOwnershipOrControl"), F.lit("2020-01-01").alias("startDate"), F.struct(exact.alias("exact")).alias("share"))
    link = c.select((F.col("person_id") * 2 + 1).cast("int").alias("position"), F.concat(F.lit("x"), "person_id").alias("statementID"), F.lit("ownershipOrControlStatement").alias("statementType"), details, F.struct(F.concat(F.lit("s"), "company_id").alias("describedByEntityStatement")).alias("subject"), F.struct(F.concat(F.lit("c"), "person_id").alias("describedByPersonStatement")).alias("interestedParty"), F.array(interest(F.lit("shareholding"), (F.col("person_id") % 100).cast("decimal(7,4)")), interest(F.when(F.col("person_id") % 7 == 0, "gift").otherwise("voting-rights"), F.lit(None).cast("decimal(7,4)"))).alias("interests"))
    parts = [_through_json(x, feeds.STATEMENT) for x in (person, entity, link)]
    return _parsed_rows(feeds.ownership_statements(parts[0].unionByName(parts[1]).unionByName(parts[2])))


def src_ownership_records(spark, sf_dir):
    """The same as records of version 0.4, with later closures and cited register numbers."""
    c, s = _people(spark, sf_dir), table(spark, sf_dir, "supplier")
    details = F.struct(F.lit("0.4").alias("bodsVersion"), F.lit("2024-01-01").alias("publicationDate")).alias("publicationDetails")
    person = c.select((F.col("person_id") * 3).cast("int").alias("position"), F.concat(F.lit("c"), "person_id").alias("recordId"), F.lit("person").alias("recordType"), F.lit("new").alias("recordStatus"), F.lit("2024-01-01").alias("statementDate"), details, F.struct(F.when(F.col("person_id") % 10 == 0, "unknownPerson").otherwise("knownPerson").alias("personType"), F.array(F.struct(F.lit("P").alias("fullName"))).alias("names")).alias("recordDetails"))
    entity = s.select((F.col("s_suppkey") + 10_000_000).cast("int").alias("position"), F.concat(F.lit("s"), "s_suppkey").alias("recordId"), F.lit("entity").alias("recordType"), F.lit("new").alias("recordStatus"), F.lit("2024-01-01").alias("statementDate"), details, F.struct(F.col("s_name").alias("name")).alias("recordDetails"))
    interest = lambda kind, exact: F.struct(kind.alias("type"), F.lit(False).alias("beneficialOwnershipOrControl"), F.lit("2020-01-01").alias("startDate"), F.struct(exact.alias("exact")).alias("share"))
    owned = F.when(F.col("person_id") % 9 == 0, F.concat(F.lit("GB-COH-"), F.lpad(F.col("company_id").cast("string"), 8, "0"))).otherwise(F.concat(F.lit("s"), "company_id"))
    exact = (F.col("person_id") % 100).cast("decimal(7,4)")
    body = F.struct(owned.alias("subject"), F.concat(F.lit("c"), "person_id").alias("interestedParty"), F.array(interest(F.lit("shareholding"), exact), interest(F.when(F.col("person_id") % 4 == 0, "shareholding").otherwise("votingRights"), exact)).alias("interests")).alias("recordDetails")

    def link(k, status, day):
        return c.select((F.col("person_id") * 3 + k).cast("int").alias("position"), F.concat(F.lit("x"), "person_id").alias("recordId"), F.lit("relationship").alias("recordType"), F.lit(status).alias("recordStatus"), F.lit(day).alias("statementDate"), details, body, "person_id")

    parts = [person, entity, link(1, "new", "2024-01-01").drop("person_id"), link(2, "closed", "2024-02-01").where("person_id % 5 = 0").drop("person_id")]
    rows = [_through_json(x, feeds.RECORD) for x in parts]
    return _parsed_rows(feeds.ownership_records(rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])))


def src_procurement(spark, sf_dir):
    """Orders of one supplier as mapped notices."""
    n = views.notices(spark, sf_dir).where(F.size("winners") == 1)
    side = lambda i: F.struct(F.lit("VAT").alias("scheme"), i.alias("id"), i.alias("name"))
    rows = n.select(F.col("notice_id").cast("int").alias("position"), F.lit(PROCUREMENT_TAG).alias("schema"), F.col("notice_id").alias("id"), F.when(F.col("notice_id").cast("int") % 3 == 0, "DRAFT").otherwise("AWARDED").alias("status"), F.col("decision_date").cast("string").alias("decision_date"), F.col("total_value").alias("amount"), "currency", side(F.col("buyers")[0]).alias("buyer"), side(F.col("winners")[0]).alias("supplier"))
    return _parsed_rows(feeds.procurement_export(_through_json(rows, feeds.NOTICE), PROCUREMENT_TAG))


def src_lei(spark, sf_dir):
    """Customers as LEI payloads, of which some are lists."""
    c = table(spark, sf_dir, "customer")
    e = F.struct(F.struct(F.when(F.col("c_custkey") % 8 != 0, F.col("c_name")).alias("name")).alias("legalName"), F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("N"), "c_nationkey")).alias("legalJurisdiction"), F.lit("ACTIVE").alias("status"), F.lit("2020-02-03T00:00:00Z").alias("creationDate"), F.struct(F.concat(F.lit("A"), "c_nationkey").alias("country")).alias("legalAddress"))
    record = F.struct(F.when(F.col("c_custkey") % 2 == 1, F.col("c_custkey").cast("string")).alias("id"), F.struct(F.concat(F.lit("L"), "c_custkey").alias("lei"), e.alias("entity")).alias("attributes"))
    payload = F.when(F.col("c_custkey") % 5 == 0, F.to_json(F.struct(F.array(record).alias("data")))).when(F.col("c_custkey") % 7 == 0, F.lit('{"data":[]}')).otherwise(F.to_json(F.struct(record.alias("data"))))
    records, problems = registers.lei_payloads(staged(c.select(payload.alias("payload")), "lei"))
    none = F.lit(None).cast("string")
    return records.select("lei", "name", "jurisdiction", "created", none.alias("problem")).unionByName(problems.select(none.alias("lei"), none.alias("name"), none.alias("jurisdiction"), F.lit(None).cast("date").alias("created"), F.col("reason").alias("problem")))


def src_lei_parents(spark, sf_dir):
    """Parents by number; some are not reported, some unknown."""
    c = table(spark, sf_dir, "customer")
    name = lambda x: F.concat(F.lit("L"), x.cast("string"))
    key = F.col("c_custkey")
    children = c.select(name(key).alias("lei"), F.when(key % 3 != 0, name(F.floor(key / 2))).alias("direct_parent"), name(key * 2).alias("ultimate_parent"))
    return registers.lei_parents(children, c.select(name(key).alias("lei"), F.col("c_name").alias("name")))


def src_tender_rows(spark, sf_dir):
    """Orders as loose tender rows: titles as text, map or list, names as list or language map."""
    n = views.notices(spark, sf_dir)
    key = F.col("notice_id").cast("long")
    title = F.concat(F.lit("T "), F.col("notice_id"))
    payload = F.concat(
        F.when(key % 2 == 0, F.lit('{"publication-number":')).otherwise(F.lit('{"notice-identifier":')), F.to_json(F.struct(F.col("notice_id").alias("value"))),
        F.lit(',"notice-title":'), F.when(key % 3 == 0, F.to_json(F.struct(title.alias("en")))).when(key % 3 == 1, F.to_json(F.array(title))).otherwise(F.concat(F.lit('"'), title, F.lit(' "'))),
        F.lit(',"total-value":"'), F.replace(F.col("total_value").cast("string"), F.lit("."), F.lit(",")), F.lit('","total-value-cur":"euro","winner-name":'),
        F.when(key % 2 == 0, F.to_json("winners")).otherwise(F.to_json(F.struct(F.col("winners").alias("eng")))), F.lit("}"),
    )
    # Twenty rows a payload, under one of four names or one level deeper.
    group = F.floor(key / 20)
    listed = n.select(group.alias("g"), payload.alias("row")).groupBy("g").agg(F.concat(F.lit("["), F.array_join(F.collect_list("row"), ","), F.lit("]")).alias("rows"))
    shape = F.element_at(F.array(F.lit('{"notices":#}'), F.lit('{"data":{"results":#}}'), F.lit('{"items":#}'), F.lit('{"data":#}'), F.lit('{"results":{"items":#},"data":[]}')), (F.col("g") % 5 + 1).cast("int"))
    rows = registers.tender_rows(registers.tender_payload_rows(listed.select(F.replace(shape, F.lit("#"), F.col("rows")).alias("payload"))))
    return rows.select("publication_number", "title", "total_value", "currency", F.size("winners").cast("long").alias("n_winners"), F.array_join(F.transform("winners", lambda w: w["name"]), ",").alias("winners"))


def src_legal_relations(spark, sf_dir):
    """Orders as acts that cite parts, amend suppliers and name what is no relation."""
    line = table(spark, sf_dir, "lineitem")
    uri = lambda x: F.concat(F.lit("http://x/resource/celex/3"), x.cast("string"), F.lit("?lang=en"))
    name = F.element_at(F.array(F.lit("work_cites_work"), F.lit("resource_legal_amends_resource_legal"), F.lit("see_also")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    nodes = line.groupBy("l_orderkey").agg(F.collect_list(F.struct(name.alias("name"), uri(F.col("l_partkey")).alias("target"))).alias("predicates"))
    nodes = nodes.select(F.when(F.col("l_orderkey") % 2 == 0, uri(F.col("l_orderkey"))).otherwise("http://x/other").alias("about"), F.when(F.col("l_orderkey") % 2 == 1, F.array(uri(F.col("l_orderkey")))).otherwise(F.array()).alias("aliases"), "predicates")
    return registers.legal_relations(nodes, registers.relation_table(spark))


def src_legal_xml(spark, sf_dir):
    """S9 from landed RDF/XML: orders as acts, under a prefix of the file's own, with a nested node and a namesake of another model."""
    line = table(spark, sf_dir, "lineitem")
    uri = lambda x: F.concat(F.lit("http://x/resource/celex/3"), x.cast("string"))
    name = F.element_at(F.array(F.lit("m:work_cites_work"), F.lit("m:resource_legal_amends_resource_legal"), F.lit("cdm:amends")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    to = lambda tag, target: F.concat(F.lit("<"), tag, F.lit(' rdf:resource="'), target, F.lit('"/>'))
    acts = line.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(to(name, uri(F.col("l_partkey"))))), "").alias("body"))
    nested = F.concat(F.lit('<m:based_on><rdf:Description rdf:about="'), uri(F.col("l_orderkey")), F.lit('"><m:corrects rdf:resource="http://x/resource/celex/31"/></rdf:Description></m:based_on>'))
    about = F.when(F.col("l_orderkey") % 2 == 0, uri(F.col("l_orderkey"))).otherwise(F.lit("http://x/other"))
    alias = F.when(F.col("l_orderkey") % 2 == 1, to(F.lit("owl:sameAs"), uri(F.col("l_orderkey")))).otherwise(F.lit(""))
    node = F.concat(F.lit('<rdf:Description rdf:about="'), about, F.lit('">'), alias, "body", nested, F.lit("</rdf:Description>"))
    head = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:m="http://publications.europa.eu/ontology/cdm#" xmlns:cdm="http://elsewhere/cdm#">'
    # Some ten thousand acts a file, a line each, so that files are few and no task holds one whole.
    lines = acts.select(F.floor(F.col("l_orderkey") / ACT_KEYS).alias("file"), F.lit(1).alias("place"), node.alias("value"))
    ends = F.array(F.struct(F.lit(0).alias("place"), F.lit(head).alias("value")), F.struct(F.lit(2).alias("place"), F.lit("</rdf:RDF>").alias("value")))
    files = line.select(F.floor(F.col("l_orderkey") / ACT_KEYS).alias("file")).distinct().select("file", F.explode(ends).alias("e")).select("file", "e.*")
    path = fresh_path(spark, "acts")
    lines.unionByName(files).repartition("file").sortWithinPartitions("file", "place").drop("place").write.partitionBy("file").text(path)
    nodes, problems = legal_xml.read_legal_nodes(spark, path)
    found = registers.legal_relations(nodes, registers.relation_table(spark))
    return found.unionByName(problems.select(F.lit(None).cast("string").alias("subject"), F.col("problem").alias("relation"), F.lit(None).cast("string").alias("target")))


def src_archives(spark, sf_dir):
    """Orders as lines of ZIP archives by status, written and read back by member; some lines are no JSON."""
    o = table(spark, sf_dir, "orders")
    text = F.when(F.col("o_orderkey") % 50 == 0, F.concat(F.lit('{"id": '), "o_orderkey")).otherwise(F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"))))
    folder = fresh_path(spark, "archives")
    # The folder is made by a write that every store knows.
    spark.range(1).write.parquet(f"{folder}/made")
    made = staged(archives.write_archives(o.select(F.concat_ws("-", F.lit("orders"), "o_orderstatus").alias("archive"), "o_orderkey", text.alias("text")), "archive", "o_orderkey", "text", folder, per_member=500), "members")
    lines, damaged = archives.archive_lines(spark, folder, ".ndjson", pack_bytes=16 << 10)
    good, bad = landing.parse_lines(lines, "id BIGINT, priority STRING")
    none = lambda kind: F.lit(None).cast(kind)
    out = good.select(F.lit("row").alias("part"), "member", "line", "id", F.col("priority").alias("text"))
    out = out.unionByName(bad.select(F.lit("bad line").alias("part"), "member", "line", none("long").alias("id"), "text"))
    out = out.unionByName(damaged.select(F.lit("damaged").alias("part"), "member", "line", none("long").alias("id"), F.col("problem").alias("text")))
    return out.unionByName(made.select(F.lit("member").alias("part"), "member", none("long").alias("line"), none("long").alias("id"), F.col("archive").alias("text")))


def src_sdg(spark, sf_dir):
    """Orders as statistics pages; observations without their copies."""
    o = table(spark, sf_dir, "orders")
    value = F.concat(F.when(F.col("o_orderstatus") == "P", "<").otherwise(""), (F.col("o_orderkey") % 50).cast("string"), F.lit(".50"))
    row = F.struct(F.lit("S").alias("series"), (F.col("o_custkey") % 30).cast("string").alias("geoAreaCode"), F.year("o_orderdate").alias("timePeriodStart"), value.alias("value"), F.create_map(F.lit("p"), F.col("o_orderpriority")).alias("dimensions"))
    pages = o.groupBy((F.col("o_orderkey") % 40).alias("snapshot_id")).agg(F.collect_list(row).alias("data"))
    rows = pages.select("snapshot_id", F.from_json(F.to_json(F.struct("data")), registers.SDG_PAGE).alias("p")).select("snapshot_id", "p.data")
    return registers.sdg_observations(rows).select("snapshot_id", "series", "geography", "period", "value", F.col("number").cast("double").alias("number"), "dimensions")


def src_lobbying(spark, sf_dir):
    """Orders as lobbying rows."""
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.concat(F.lit("T"), "o_custkey").alias("transparency_id"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("institution_name"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate").cast("date")).alias("meeting_date"), F.when(F.col("o_orderkey") % 5 == 0, F.lit("32016R0679")).alias("policy_celex"))
    return registers.lobbying_edges(_through_json(rows, registers.LOBBYING))


def src_wealth_rules(spark, sf_dir):
    """Customers as declarations, rows per broken rule."""
    c = table(spark, sf_dir, "customer")
    rows = c.select(
        F.col("c_custkey").cast("string").alias("entity_id"), F.lit("2020-01-01").alias("period_start"), F.when(F.col("c_custkey") % 9 == 0, "2019-01-01").otherwise("2021-01-01").alias("period_end"),
        money("c_acctbal").alias("opening_net_worth"), money("c_acctbal").alias("closing_net_worth"), (money("c_acctbal") - 500).cast("decimal(24,6)").alias("income"),
        F.when(F.col("c_custkey") % 4 == 0, F.create_map(F.lit("income"), F.lit("p1"))).otherwise(F.create_map(F.lit("opening_net_worth"), F.lit("p1"), F.lit("closing_net_worth"), F.lit("p2"), F.lit("income"), F.lit("p3"))).alias("locators"),
    )
    return quality.rule_counts(_through_json(rows, registers.WEALTH), quality.wealth_rules())


def loose_values(spark, sf_dir):
    """loosely written values of orders and pages."""
    o, p = table(spark, sf_dir, "orders"), table(spark, sf_dir, "pages")
    a = o.select(
        loose_decimal(F.concat(F.lit(" "), F.replace(money("o_totalprice").cast("string"), F.lit("."), F.lit(",")), F.when(F.col("o_orderkey") % 4 == 0, ",0").otherwise(""))).alias("n"),
        loose_date(F.when(F.col("o_orderkey") % 5 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm"))).alias("d"),
        instant(F.date_format("o_orderdate", "yyyy-MM-dd")).cast("timestamp_ntz").alias("t"),
    )
    first = a.agg(F.count("n").alias("decimals"), F.count("d").alias("dates"), F.max("t").alias("latest"))
    second = p.agg(F.countDistinct(route_group(F.concat(F.lit("/api/v1/"), F.col("url")))).alias("routes"), F.countDistinct(object_key(F.col("url"))).alias("keys"), F.count(celex_of(F.col("url"))).alias("acts"))
    return first.crossJoin(second)  # one row each


# ---- streams


def _landed(spark, sf_dir, name):
    return jobs.read_landing(spark, f"{sf_dir}/{name}*.parquet", table(spark, sf_dir, name).schema)


def stream_metric_rollup(spark, sf_dir):
    """ST5."""
    status = F.when(F.col("event_type") == "error", 500).otherwise(200)
    rows = _landed(spark, sf_dir, "events").select("ts", F.col("event_type").alias("route"), status.alias("status"), (money("value") / 100).cast("decimal(24,6)").alias("latency"))
    out = fresh_path(spark, "rollup")
    jobs.metric_rollup(rows.withColumn("ts", F.col("ts").cast("timestamp")), out, fresh_path(spark, "ck")).awaitTermination()
    return jobs.latest_windows(spark, out).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def stream_distinct_observations(spark, sf_dir):
    """ST4."""
    out = fresh_path(spark, "distinct")
    keys = ["l_orderkey", "l_partkey", "l_suppkey"]
    jobs.distinct_observations(_landed(spark, sf_dir, "lineitem"), keys, out, fresh_path(spark, "ck")).awaitTermination()
    return spark.read.parquet(out).select(*keys)


def stream_ingest(spark, sf_dir):
    """ST1: documents as envelopes; a second run finds all receipts."""
    out = fresh_path(spark, "ingest")
    rows = _landed(spark, sf_dir, "documents").select(F.col("doc_id").alias("batch_id"), F.col("text").alias("payload"))
    for _ in range(2):
        jobs.ingest_envelopes(rows, out, fresh_path(spark, "ck")).awaitTermination()
    return jobs.committed(spark, out, jobs.ENVELOPES).select("digest", "batch_id")


def stream_versions(spark, sf_dir):
    """ST2/ST3/J2: events appended as versions, then a snapshot over receipts."""
    out = fresh_path(spark, "versions")
    rows = _landed(spark, sf_dir, "events").select(F.col("user_id").alias("record_id"), F.col("event_id").alias("version_id"), F.when(F.col("event_type") == "error", "DELETE").otherwise("UPDATE").alias("operation"), "event_type")
    jobs.append_versions(rows, out, fresh_path(spark, "ck"), "local").awaitTermination()
    log = temporal.with_commit_times(spark.read.parquet(f"{out}/versions"), spark.read.parquet(f"{out}/receipts"))
    return temporal.snapshot(log, F.current_timestamp()).select("record_id", "version_id", "event_type")


def stream_audit_seal(spark, sf_dir):
    """ST6: the batch chains, sealed as a stream."""
    out = fresh_path(spark, "seal")
    rows = _landed(spark, sf_dir, "events").select("user_id", *PAYLOAD)
    jobs.seal_events(rows, "user_id", "event_id", PAYLOAD, out, fresh_path(spark, "ck")).awaitTermination()
    return jobs.committed(spark, out, jobs.sealed_schema(rows, "user_id", "event_id"))


QUERIES = {
    f.__name__: f
    for f in (
        src_contracting, src_envelopes, import_job, import_replay, document_versions, src_ownership_statements, src_ownership_records, src_procurement, src_lei, src_lei_parents, src_tender_rows, src_legal_relations, src_legal_xml, src_archives, src_sdg, src_lobbying,
        src_wealth_rules, loose_values, stream_metric_rollup, stream_distinct_observations, stream_ingest, stream_versions, stream_audit_seal,
    )
}
