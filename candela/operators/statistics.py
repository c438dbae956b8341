"""Recalculation of published statistics and verification of assertions about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.functions.keys import fingerprint
from candela.functions.predicates import dimensions_allowed
from candela.functions.text import plain_number

#: The operations that a request can name.
OPERATIONS = ["count_observations", "count_distinct_geographies", "sum_values", "mean_values", "percent_change"]


def exact_mean(total: Column, n: Column) -> Column:
    """A decimal mean with twelve half-even places. The division alone would lose scale."""
    return F.bround(F.try_divide(total.cast("decimal(38,12)"), n.cast("decimal(12,0)")).cast("decimal(38,18)"), 12)


def recalculate(observations: DataFrame, specs: DataFrame) -> DataFrame:
    """Every spec against the observations of its snapshot, in one pass.

    observations: snapshot_id, geography, period, number (null where the text
    isn't numeric), dimension; specs: spec_id, snapshot_id, operation,
    dimension (null for any), base_period, current_period. Where specs have
    them, dimension_filters and attribute_filters (maps of allowed values) go by
    the observations' maps dimensions and attributes (P5), and aggregation, sum
    or mean, tells what percent_change compares (else sums). Specs are requests
    and join on the snapshot; errors are statuses, never missing rows. An operation
    that is none of OPERATIONS is UNKNOWN_OPERATION.
    """
    rows = specs.join(observations.withColumnRenamed("dimension", "own_dimension"), "snapshot_id")
    rows = rows.where(F.col("dimension").isNull() | F.col("dimension").eqNullSafe(F.col("own_dimension")))
    for filters, own in (("dimension_filters", "dimensions"), ("attribute_filters", "attributes")):
        if filters in specs.columns:
            rows = rows.where(dimensions_allowed(F.col(own), F.col(filters)))
    means = F.coalesce(F.col("aggregation") == "mean", F.lit(False)) if "aggregation" in specs.columns else F.lit(False)
    base, current = F.col("period") == F.col("base_period"), F.col("period") == F.col("current_period")
    got = rows.groupBy("spec_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("geography").alias("geographies"),
        F.count("number").alias("numeric"),
        F.sum("number").alias("total"),
        F.sum(F.when(base, F.col("number"))).alias("base_total"),
        F.sum(F.when(current, F.col("number"))).alias("current_total"),
        F.count(F.when(base, F.col("number"))).alias("base_n"),
        F.count(F.when(current, F.col("number"))).alias("current_n"),
        F.count(F.when(base | current, 1)).alias("both"),
    )
    full = specs.join(got, "spec_id", "left")
    for side in ("base", "current"):
        total = F.col(f"{side}_total").cast("decimal(38,12)")
        full = full.withColumn(f"{side}_total", F.when(means, exact_mean(total, F.col(f"{side}_n")).cast("decimal(38,12)")).otherwise(total))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(38,12)")
    op = F.col("operation")
    delta = (F.col("current_total") - F.col("base_total")).cast("decimal(38,12)")
    change = F.bround((F.try_divide(delta, F.abs(F.col("base_total")).cast("decimal(38,12)")) * 100).cast("decimal(38,16)"), 12)
    result = (
        F.when(op == "count_observations", zero("n"))
        .when(op == "count_distinct_geographies", zero("geographies"))
        .when(op == "sum_values", F.col("total").cast("decimal(38,12)"))
        .when(op == "mean_values", exact_mean(F.col("total"), F.col("numeric")).cast("decimal(38,12)"))
        .when(op == "percent_change", change.cast("decimal(38,12)"))
    )
    sums = op.isin("sum_values", "mean_values")
    needs = sums & (F.coalesce("numeric", F.lit(0)) == 0)
    absent = (op == "percent_change") & (F.col("base_total").isNull() | F.col("current_total").isNull())
    unknown = ~F.coalesce(op.isin(OPERATIONS), F.lit(False))
    status = F.when(unknown, "UNKNOWN_OPERATION").when(needs | absent, "NO_NUMERIC").when((op == "percent_change") & (F.col("base_total") == 0), "ZERO_BASE").otherwise("OK")
    used = F.when(unknown, F.lit(0)).when(op == "percent_change", F.col("both")).when(sums, F.col("numeric")).otherwise(F.col("n"))
    return full.select("spec_id", "operation", status.alias("status"), F.when(status == "OK", result).alias("result"), F.coalesce(used, F.lit(0)).alias("used"))


def run_log(specs: DataFrame, recalculated: DataFrame, engine_version: str) -> DataFrame:
    """V2: the runs' log rows; a run's id tells spec, engine and result, so a repeated run appends nothing new."""
    settings = [c for c in specs.columns if c not in ("spec_id", "snapshot_id", "operation")]
    rows = specs.select("spec_id", "snapshot_id", F.to_json(F.struct(*settings)).alias("settings")).join(recalculated, "spec_id")
    text = result_text()
    run = fingerprint(F.col("spec_id"), F.col("settings"), F.lit(engine_version), F.col("status"), text)
    return rows.select(run.alias("run_id"), "spec_id", "snapshot_id", "operation", "settings", F.lit(engine_version).alias("engine_version"), "status", text.alias("result"), "used")


def verify(recalculated: DataFrame, assertions: DataFrame) -> DataFrame:
    """V3: VERIFIED within tolerance, REFUTED beyond it, INDETERMINATE where nothing could be calculated, UNKNOWN_OPERATION as such."""
    rows = assertions.join(recalculated, "spec_id", "left")
    delta = (F.col("result") - F.col("asserted")).cast("decimal(38,12)")
    verdict = F.when(F.col("status") == "UNKNOWN_OPERATION", "UNKNOWN_OPERATION").when(F.col("status") != "OK", "INDETERMINATE").when(F.col("result").isNull(), "INDETERMINATE").when(F.abs(delta) <= F.col("tolerance"), "VERIFIED").otherwise("REFUTED")
    return rows.select("assertion_id", "spec_id", verdict.alias("verdict"), delta.alias("delta"))


def page_completeness(pages: DataFrame) -> DataFrame:
    """V6: per snapshot, whether its pages are all there and agree on their totals.

    pages: snapshot_id, page_number, total_pages, total_elements, rows.
    """
    got = pages.groupBy("snapshot_id").agg(
        F.count(F.lit(1)).alias("pages"),
        F.countDistinct("page_number").alias("numbers"),
        F.max("page_number").alias("last"),
        F.min("total_pages").alias("pages_min"),
        F.max("total_pages").alias("pages_max"),
        F.min("total_elements").alias("elements_min"),
        F.max("total_elements").alias("elements_max"),
        F.sum("rows").alias("rows"),
    )
    stable = (F.col("pages_min") == F.col("pages_max")) & (F.col("elements_min") == F.col("elements_max"))
    whole = (F.col("pages") == F.col("numbers")) & (F.col("last") == F.col("pages_max")) & (F.col("pages") == F.col("pages_max"))
    status = F.when(~stable, "TOTALS_CHANGED").when(~whole, "PAGES_MISSING").when(F.col("rows") != F.col("elements_max"), "ROWS_MISSING").otherwise("COMPLETE")
    return got.select("snapshot_id", "pages", "rows", status.alias("status"))


def result_text(column: str = "result") -> Column:
    """a result as plain text."""
    return plain_number(F.col(column))
