"""Version capture: a baseline and row images of changes, stored load by load, from which any snapshot is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.operators import temporal


def images(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """K4: (key, operation, row) that turn one snapshot into another; the row is the new image, of a deleted one the old.

    Rows that equal their old image, nulls included, give nothing.
    """
    values = [c for c in after.columns if c != key]
    a = before.select(F.col(key), F.struct(*values).alias("old"))
    b = after.select(F.col(key), F.struct(*values).alias("new"))
    both = a.join(b, key, "full_outer")
    operation = F.when(F.col("old").isNull(), "INSERT").when(F.col("new").isNull(), "DELETE").when(~F.col("old").eqNullSafe(F.col("new")), "UPDATE")
    return both.select(key, operation.alias("operation"), F.coalesce("new", "old").alias("row")).where("operation is not null").select(key, "operation", "row.*")


class VersionStore:
    """K4: a table's versions in a folder. The first load is the BASELINE, each later one the images of what it changed.

    A load's images are in a folder of its own and its receipt, one row, comes
    last, so a load that fails is as if it had not been and may be run again.
    compact() puts all images up to a load into a new baseline; snapshots from
    there on stay as they are, earlier ones are no longer to be had.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, values: dict[str, str]):
        self.spark, self.path, self.key = spark, path, key
        self.columns = {key: values[key]} | {c: t for c, t in values.items() if c != key}
        own = ", ".join(f"`{c}` {t}" for c, t in self.columns.items())
        self.schema = f"{own}, operation string, load long"
        for name, schema in (("images", self.schema), ("base", self.schema), ("receipts", "committed_at timestamp_ntz, kind string, load long")):
            spark.createDataFrame([], schema).write.partitionBy("load").mode("ignore").parquet(f"{path}/{name}")

    def receipts(self) -> DataFrame:
        return self.spark.read.schema("committed_at timestamp_ntz, kind string, load long").parquet(f"{self.path}/receipts")

    def _last(self, kind: str) -> int:
        return self.receipts().where(F.col("kind") == kind).agg(F.max("load")).first()[0] or 0

    def log(self) -> DataFrame:
        """The versions, as temporal.snapshot and knowledge_intervals read them: the newest baseline and all later images."""
        base = self._last("base")
        own = self.receipts().where("kind = 'images'").select("load", "committed_at")
        read = lambda name: self.spark.read.schema(self.schema).parquet(f"{self.path}/{name}")
        rows = read("images").where(F.col("load") > base)
        if base:
            rows = read("base").where(F.col("load") == base).unionByName(rows)
        return rows.join(own, "load").select(*self.columns, "operation", F.col("load").alias("version_id"), "committed_at")

    def snapshot(self, known_at: Column) -> DataFrame:
        """W1 over the log; a cutoff before the newest baseline raises, for its history is gone."""
        base = self._last("base")
        if base and self.receipts().where("kind = 'images'").where(F.col("load") == base).where(F.col("committed_at") > known_at).count():
            raise LookupError("HISTORY_UNAVAILABLE: the cutoff is before the newest baseline")
        return temporal.snapshot(self.log(), known_at, keys=(self.key,)).select(*self.columns)

    def current(self) -> DataFrame:
        return temporal.snapshot(self.log(), F.lit("9999-01-01").cast("timestamp_ntz"), keys=(self.key,)).select(*self.columns)

    def _receipt(self, kind: str, load: int, committed_at: Column) -> None:
        row = self.spark.range(1).select(committed_at.cast("timestamp_ntz").alias("committed_at"), F.lit(kind).alias("kind")).coalesce(1)
        row.write.mode("append").parquet(f"{self.path}/receipts/load={load}")

    def load(self, rows: DataFrame, committed_at: Column) -> int:
        """Store what this state of the table changes; its number. Of rows with one key the greatest stands; a null key raises."""
        number = self._last("images") + 1
        rest = [c for c in self.columns if c != self.key]
        typed = rows.select(*[F.col(c).cast(t).alias(c) for c, t in self.columns.items()])
        one = typed.groupBy(F.coalesce(F.col(self.key), F.raise_error("a row without a key").cast(self.columns[self.key])).alias(self.key)).agg(F.max(F.struct(*rest)).alias("r")).select(self.key, "r.*")
        changed = one.withColumn("operation", F.lit("BASELINE")) if number == 1 else images(self.current(), one, self.key)
        changed.select(*self.columns, "operation").write.mode("overwrite").parquet(f"{self.path}/images/load={number}")
        self._receipt("images", number, committed_at)
        return number

    def compact(self, load: int | None = None) -> None:
        """Make the state at a load, else the last, the new baseline."""
        load = load or self._last("images")
        at = self.receipts().where("kind = 'images'").where(F.col("load") == load).first()["committed_at"]
        state = temporal.snapshot(self.log().where(F.col("version_id") <= load), F.lit(at).cast("timestamp_ntz"), keys=(self.key,))
        state.select(*self.columns, F.lit("BASELINE").alias("operation")).write.mode("overwrite").parquet(f"{self.path}/base/load={load}")
        self._receipt("base", load, F.lit(at))
