"""Register records, tender rows, legal relations, statistics pages, lobbying and wealth rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.functions.keys import fingerprint
from candela.functions.text import celex_of, currency_code, loose_date, loose_decimal, strict_number

LEI = """data STRUCT<id: STRING, attributes: STRUCT<lei: STRING, entity: STRUCT<legalName: STRUCT<name: STRING>, legalJurisdiction: STRING, status: STRING,
registeredAt: STRUCT<id: STRING>, registeredAs: STRING, creationDate: STRING, legalAddress: STRUCT<country: STRING>>>>"""
LOBBYING = """transparency_id STRING, registrant_name STRING, registrant_country STRING, institution_name STRING, meeting_date DATE, subject STRING,
policy_celex STRING, declared_budget_min DECIMAL(24,6), declared_budget_max DECIMAL(24,6), currency STRING, source_external_id STRING"""
WEALTH = """entity_id STRING, dataset_id STRING, period_start DATE, period_end DATE, currency STRING, opening_net_worth DECIMAL(24,6), closing_net_worth DECIMAL(24,6),
income DECIMAL(24,6), gifts DECIMAL(24,6), realized_gains DECIMAL(24,6), unrealized_gains DECIMAL(24,6), expenses DECIMAL(24,6), taxes DECIMAL(24,6), other_net DECIMAL(24,6),
tolerance DECIMAL(24,6), locators MAP<STRING,STRING>, demo BOOLEAN"""
SDG_PAGE = """pageNumber INT, totalPages INT, totalElements BIGINT, data ARRAY<STRUCT<series: STRING, geoAreaCode: STRING, geoAreaName: STRING, timePeriodStart: INT, value: STRING,
attributes: MAP<STRING,STRING>, dimensions: MAP<STRING,STRING>>>"""

#: Legal-relation names of the publisher's model and the relation each states.
LEGAL_RELATIONS = {
    "cites": "CITES",
    "cited_by": "CITED_BY",
    "work_cited_by_work": "CITED_BY",
    "amends": "AMENDS",
    "amended_by": "AMENDED_BY",
    "corrects": "CORRECTS",
    "corrected_by": "CORRECTED_BY",
    "resource_legal_corrected_by_resource_legal": "CORRECTED_BY",
    "resource_legal_corrects_resource_legal": "CORRECTS",
    "resource_legal_amended_by_resource_legal": "AMENDED_BY",
    "resource_legal_amends_resource_legal": "AMENDS",
    "basis_for": "BASIS_FOR",
    "based_on": "BASED_ON",
    "resource_legal_basis_for_resource_legal": "BASIS_FOR",
    "work_amends_work": "AMENDS",
    "work_is_amended_by_work": "AMENDED_BY",
    "work_cites_work": "CITES",
    "work_is_cited_by_work": "CITED_BY",
    "resource_legal_based_on_resource_legal": "BASED_ON",
    "resource_legal_is_basis_for_resource_legal": "BASIS_FOR",
    "work_is_logical_successor_of_work": "SUCCESSOR_OF",
    "work_has_logical_successor_work": "HAS_SUCCESSOR",
    "work_corrects_work": "CORRECTS",
    "work_is_corrected_by_work": "CORRECTED_BY",
}


def lei_records(payloads: DataFrame) -> DataFrame:
    """(lei, name, jurisdiction, status, registered_as, created) of records with an LEI and a legal name."""
    a = F.col("data.attributes")
    e = a["entity"]
    rows = payloads.select(
        F.coalesce(F.nullif(F.col("data.id"), F.lit("")), a["lei"]).alias("lei"),
        F.nullif(e["legalName"]["name"], F.lit("")).alias("name"),
        F.coalesce(F.nullif(e["legalJurisdiction"], F.lit("")), e["legalAddress"]["country"]).alias("jurisdiction"),
        e["status"].alias("status"),
        e["registeredAs"].alias("registered_as"),
        loose_date(e["creationDate"]).alias("created"),
    )
    return rows.where("lei is not null and name is not null")


#: The record of a LEI payload.
_LEI_RECORD = LEI.removeprefix("data ")


def lei_payloads(payloads: DataFrame, column: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(records, problems) of JSON texts whose `data` is a record or a list of which the first is meant.

    A payload without a record, or whose record lacks LEI or legal name, is a
    problem, with the payload.
    """
    v = F.try_parse_json(F.col(column))
    record = F.coalesce(F.try_variant_get(v, "$.data[0]", _LEI_RECORD), F.try_variant_get(v, "$.data", _LEI_RECORD))
    rows = payloads.withColumn("data", record)
    e = F.col("data.attributes.entity")
    named = F.coalesce(F.nullif(F.col("data.id"), F.lit("")), F.nullif(F.col("data.attributes.lei"), F.lit(""))).isNotNull() & F.nullif(e["legalName"]["name"], F.lit("")).isNotNull()
    reason = F.when(F.col("data").isNull(), "payload holds no record").when(~F.coalesce(named, F.lit(False)), "record lacks LEI or legal name")
    marked = rows.withColumn("reason", reason)
    return lei_records(marked.where("reason is null")), marked.where("reason is not null").select(column, "reason")


def lei_parents(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Direct and ultimate parent edges for children (lei, direct_parent, ultimate_parent); a missing parent gives a note."""
    kinds = F.array(F.struct(F.lit("DIRECT_PARENT").alias("kind"), F.col("direct_parent").alias("parent")), F.struct(F.lit("ULTIMATE_PARENT").alias("kind"), F.col("ultimate_parent").alias("parent")))
    rows = children.select("lei", F.explode(kinds).alias("k")).select("lei", "k.kind", "k.parent")
    out = rows.join(parents.select(F.col("lei").alias("parent"), F.col("name").alias("parent_name")), "parent", "left")
    status = F.when(F.col("parent").isNull(), "NOT_REPORTED").when(F.col("parent_name").isNull(), "UNKNOWN_PARENT").otherwise("EDGE")
    return out.select("lei", "kind", "parent", "parent_name", status.alias("status"))


def scalar(value: Column, *paths: str) -> Column:
    """the first text among a variant itself, its usual fields and its first element; blank is null."""
    found = []
    for path in paths:
        whole, *inner = [F.trim(F.try_variant_get(value, f"${path}{tail}", "string")) for tail in ("", ".value", ".name", ".label", ".text", ".en", "[0]", "[0].value")]
        # Objects and lists come back as JSON text and are passed over. What is inside is looked up in order, until a text is found, and only in those.
        plain = lambda t: F.when(t.rlike(r"^[^{\[]"), t)
        found.append(F.coalesce(plain(whole), F.when(whole.rlike(r"^[{\[]"), F.coalesce(*map(plain, inner)))))
    return F.coalesce(*found)


def strings(value: Column, path: str) -> Column:
    """the distinct texts of a list, one text, or a language map's lists, in order."""
    listed = F.try_variant_get(value, f"${path}", "array<string>")
    mapped = F.flatten(F.map_values(F.try_variant_get(value, f"${path}", "map<string,array<string>>")))
    plain = F.array(F.try_variant_get(value, f"${path}", "string"))
    found = F.coalesce(listed, mapped, plain)
    return F.array_distinct(F.filter(F.transform(found, lambda s: F.trim(s)), lambda s: s.isNotNull() & (s != "")))


def parties(names: Column, identifiers: Column, countries: Column) -> Column:
    """Distinct lists zipped by place, padded with null; parties without name and identifier are left out."""
    zipped = F.arrays_zip(names.alias("name"), identifiers.alias("identifier"), countries.alias("country"))
    named = F.transform(zipped, lambda z: F.struct(z["name"].alias("name"), z["identifier"].alias("identifier"), z["country"].alias("country")))
    return F.filter(named, lambda p: p["name"].isNotNull() | p["identifier"].isNotNull())


#: Where a tender payload has its rows, in this order; the first three also inside one of the four.
ROW_LISTS = ("notices", "results", "items", "data")


def _once(value: Column) -> Column:
    """A value that is made once: what is filtered by it afterwards, or reads it several times, doesn't make it again."""
    return F.explode(F.array(value))


def tender_payload_rows(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """The rows of tender payloads as JSON texts, with their place; the first list under one of four names counts.

    A name may hold an object that has the list instead. Elements that are no
    objects are left out; a payload without a list has no rows.
    """
    v = F.col("__v")
    at = lambda path: F.try_variant_get(v, f"$.{path}", "array<variant>")
    # Parsing a list of another kind gives null, so the order of tries is the order of names.
    tries = [at(p) for name in ROW_LISTS for p in (name, *(f"{name}.{inner}" for inner in ROW_LISTS[:3]))]
    rows = payloads.withColumn("__v", F.try_parse_json(F.col(column))).select(F.col(column).alias("__source"), F.posexplode(F.coalesce(*tries)).alias("position", "__row"))
    text = _once(F.to_json(F.col("__row")))
    return rows.select(F.col("__source").alias("source"), "position", text.alias(column)).where(F.col(column).startswith("{"))


def tender_problems(rows: DataFrame, column: str = "payload") -> DataFrame:
    """Rows that name no notice."""
    v = F.try_parse_json(F.col(column))
    return rows.where(F.coalesce(scalar(v, "['publication-number']"), scalar(v, "['notice-identifier']")).isNull()).withColumn("reason", F.lit("row names no notice"))


def tender_rows(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Tender notices from rows of JSON text whose fields are texts, lists or language maps."""
    v = F.col("__v")
    rows = payloads.select(_once(F.try_parse_json(F.col(column))).alias("__v"))
    # Fields are read into columns first: what is made of them names each several times.
    field = lambda *names: F.coalesce(*[scalar(v, f"['{n}']") for n in names])
    read = rows.select(
        field("publication-number", "notice-identifier").alias("number"), field("notice-title", "title-proc").alias("title"), field("procedure-identifier").alias("procedure_identifier"),
        field("publication-date").alias("published"), field("winner-decision-date").alias("decided"), field("result-value-notice").alias("result"), field("total-value").alias("total"),
        field("result-value-cur-notice", "total-value-cur").alias("code"),
        *[strings(v, f"['{side}-{part}']").alias(f"{side}_{part}") for side in ("buyer", "winner") for part in ("name", "identifier", "country")],
    )
    side = lambda s: parties(*[F.col(f"{s}_{part}") for part in ("name", "identifier", "country")])
    return read.select(
        F.col("number").alias("publication_number"),
        F.coalesce("title", F.concat(F.lit("TED notice "), "number")).alias("title"),
        "procedure_identifier",
        loose_date(F.col("published")).alias("publication_date"),
        loose_date(F.col("decided")).alias("decision_date"),
        F.coalesce(loose_decimal(F.col("result")), loose_decimal(F.col("total"))).alias("total_value"),
        currency_code(F.col("code")).alias("currency"),
        side("buyer").alias("buyers"),
        side("winner").alias("winners"),
    ).where("publication_number is not null")


def read_legal_xml(spark, path: str) -> DataFrame:
    """Description nodes of RDF/XML files, one row per node, with their predicates as (name, target) pairs.

    Spark's XML reader splits the files by node. Predicates count only under the
    prefix `cdm`, the model's own.
    """
    names = [f"`cdm:{n}` ARRAY<STRUCT<`_rdf:resource`: STRING>>" for n in sorted(LEGAL_RELATIONS)]
    schema = "`_rdf:about` STRING, `owl:sameAs` ARRAY<STRUCT<`_rdf:resource`: STRING>>, " + ", ".join(names)
    rows = spark.read.format("xml").option("rowTag", "rdf:Description").schema(schema).load(path)
    pairs = F.flatten(F.array(*[_pairs(n) for n in sorted(LEGAL_RELATIONS)]))
    none = F.array().cast("array<struct<`_rdf:resource`: string>>")
    aliases = F.transform(F.coalesce(F.col("`owl:sameAs`"), none), lambda x: x["_rdf:resource"])
    return rows.select(F.col("`_rdf:about`").alias("about"), aliases.alias("aliases"), pairs.alias("predicates"))


def _pairs(name: str) -> Column:
    def pair(x):
        return F.struct(F.lit(name).alias("name"), x["_rdf:resource"].alias("target"))

    empty = F.array().cast("array<struct<`_rdf:resource`: string>>")
    return F.transform(F.coalesce(F.col(f"`cdm:{name}`"), empty), pair)


def legal_relations(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """Distinct (subject, relation, target) acts of nodes (about, aliases, predicates).

    relations (name, relation) is the allow-list, a fixed table of 24 rows, and
    is broadcast. A target must be an act other than the subject.
    """
    subjects = F.array_distinct(F.array_compact(F.concat(F.array(celex_of(F.col("about"))), F.transform("aliases", celex_of))))
    rows = nodes.select(F.explode(subjects).alias("subject"), "predicates").select("subject", F.explode("predicates").alias("p"))
    rows = rows.select("subject", F.col("p.name").alias("name"), celex_of(F.col("p.target")).alias("target"))
    return rows.join(F.broadcast(relations), "name").where("target is not null and target <> subject").select("subject", "relation", "target").distinct()


def relation_table(spark) -> DataFrame:
    """The allow-list as a table."""
    return spark.createDataFrame(sorted(LEGAL_RELATIONS.items()), "name string, relation string")


def sdg_observations(pages: DataFrame) -> DataFrame:
    """Observations of landed statistics pages, one per fingerprint; text that is no number keeps a null number."""
    d = F.col("d")
    rows = pages.select("snapshot_id", F.explode("data").alias("d"))
    parts = rows.select("snapshot_id", d["series"].alias("series"), d["geoAreaCode"].alias("geography"), d["timePeriodStart"].alias("period"), d["value"].alias("value"), strict_number(d["value"]).alias("number"), F.to_json(F.map_from_entries(F.array_sort(F.map_entries(d["dimensions"])))).alias("dimensions"))
    return parts.withColumn("fingerprint", fingerprint(*[F.col(c) for c in ("snapshot_id", "series", "geography", "period", "value", "dimensions")])).dropDuplicates(["fingerprint"])


def lobbying_edges(rows: DataFrame) -> DataFrame:
    """MET_WITH needs institution and date, LOBBIED_ON an act's number; what has neither is a NOTE."""
    met = rows.where("institution_name is not null and meeting_date is not null").select(F.col("transparency_id").alias("subject"), F.col("institution_name").alias("object"), F.lit("MET_WITH").alias("relation"), F.col("meeting_date").alias("valid_from"))
    on = rows.where("policy_celex is not null").select(F.col("transparency_id").alias("subject"), F.col("policy_celex").alias("object"), F.lit("LOBBIED_ON").alias("relation"), F.col("meeting_date").alias("valid_from"))
    note = rows.where("policy_celex is null and (institution_name is null or meeting_date is null)").select(F.col("transparency_id").alias("subject"), F.lit(None).cast("string").alias("object"), F.lit("NOTE").alias("relation"), F.col("meeting_date").alias("valid_from"))
    return met.unionByName(on).unionByName(note)
