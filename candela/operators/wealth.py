"""Net-worth bridges: does the declared closing follow from the opening?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAINS = ["income", "gifts", "realized_gains", "unrealized_gains"]
LOSSES = ["expenses", "taxes"]
COMPONENTS = ["opening_net_worth", "closing_net_worth", *GAINS, *LOSSES, "other_net"]


def reconcile(declarations: DataFrame) -> DataFrame:
    """Expected closing, residual and status; a missing component makes it INCOMPLETE, never zero."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in COMPONENTS]))
    expected = F.col("opening_net_worth")
    for c in GAINS:
        expected = expected + F.col(c)
    for c in LOSSES:
        expected = expected - F.col(c)
    expected = (expected + F.col("other_net")).cast("decimal(30,6)")
    residual = (F.col("closing_net_worth") - expected).cast("decimal(30,6)")
    status = F.when(F.size(missing) > 0, "INCOMPLETE").when(F.abs(residual) <= F.col("tolerance"), "RECONCILED").otherwise("REVIEW_REQUIRED")
    return declarations.withColumns({"missing_components": F.array_join(missing, ","), "expected_closing": expected, "residual": residual, "status": status})
