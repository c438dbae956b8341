"""Conflict-of-interest signals: a role, an ownership and an award that meet in time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candela.functions.keys import fingerprint
from candela.functions.predicates import covers_day, live, shown


def conflict_scan(roles: DataFrame, owns: DataFrame, awards: DataFrame, known_at: str, include_demo: bool = False) -> DataFrame:
    """(person, body, company, award) where the role's body awarded the owned company, as known at a cutoff.

    The three tables are snapshots at known_at. roles: person_id, body_id,
    valid_from, valid_to, is_demo (of the person); owns: person_id, company_id,
    valid_from, valid_to; awards: award_id, body_id, company_id, decision_date;
    each with its edge's claim_id, verification_status and superseded_at.
    Retracted claims, superseded edges and, unless asked for, synthetic persons
    are left out. Roles and ownerships meet on the person first, then both on
    the award's two parties, so every join has an equality; dates are checked
    beside it. The fingerprint is that of the cutoff, the claims and the award.
    """
    alive = live(F.col("superseded_at"), F.col("verification_status"))
    r = roles.where(alive & shown(F.col("is_demo"), include_demo)).select("person_id", "body_id", F.col("valid_from").alias("role_from"), F.col("valid_to").alias("role_to"), F.col("claim_id").alias("role_claim"))
    o = owns.where(alive).select("person_id", "company_id", F.col("valid_from").alias("own_from"), F.col("valid_to").alias("own_to"), F.col("claim_id").alias("own_claim"))
    a = awards.where(alive).select("award_id", "body_id", "company_id", "decision_date", F.col("claim_id").alias("award_claim"))
    found = r.join(o, "person_id").join(a, ["body_id", "company_id"])
    day = F.col("decision_date")
    found = found.where(covers_day(F.col("role_from"), F.col("role_to"), day) & covers_day(F.col("own_from"), F.col("own_to"), day))
    unsure = day.isNull() | F.col("role_from").isNull() | F.col("own_from").isNull()
    mark = fingerprint(F.lit(known_at), F.col("role_claim"), F.col("own_claim"), F.col("award_claim"), F.col("award_id"))
    return found.select("person_id", "body_id", "company_id", "award_id", "decision_date", unsure.alias("temporal_uncertainty"), mark.alias("fingerprint"))


def new_signals(found: DataFrame, known: DataFrame) -> DataFrame:
    """One OPEN signal per fingerprint that isn't known yet."""
    return found.dropDuplicates(["fingerprint"]).join(known.select("fingerprint"), "fingerprint", "left_anti").withColumn("status", F.lit("OPEN"))


def review_signals(signals: DataFrame, reviews: DataFrame) -> DataFrame:
    """The first review of an OPEN signal decides; DISMISSED and ESCALATED are the choices."""
    valid = reviews.where(F.col("decision").isin("DISMISSED", "ESCALATED"))
    first = valid.groupBy("fingerprint").agg(F.min_by("decision", F.struct("reviewed_at", "review_id")).alias("decision"))
    decided = signals.join(first, "fingerprint", "left")
    status = F.when(F.col("status") == "OPEN", F.coalesce("decision", "status")).otherwise(F.col("status"))
    return decided.withColumn("status", status).drop("decision")
