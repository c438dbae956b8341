"""Shared pieces of the corpus operators: tables, staging and column clean-up."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.session import staging_folder

WHITE_SPACE = r"[\x20\x09-\x0D]+"
#: A word of the licence and contamination contracts, in any case of A-Z.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage_table(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    That cuts the lineage: a lost executor costs a re-read, not a re-run, and
    values such as partition-based numbers are fixed from here on.
    """
    spark = df.sparkSession
    path = f"{staging_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(column: str = "text") -> Column:
    """The text, a null one as the empty string."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def small_batches(batches, rows: int = 1_000):
    """Arrow batches in slices of so many rows, so that a worker holds the Python forms of few texts at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def fresh_names(df: DataFrame, *stems: str) -> list[str]:
    """Names like these that no column of df has, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in stems:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shuffle_width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


#: Ids that one row of a bitmap covers, as Spark's bitmap functions lay it out.
BITMAP_ROW = 32_768
#: Most bits of a bitmap: 16 MB, whatever the number of ids.
BITMAP_BITS = 1 << 27


def split_by_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(rows whose id surely isn't in ids, rows whose id may be), ids having the one column id_col.

    Ids are hashed into a bitmap of at most 16 MB, which is broadcast, so rows
    that can't match are told apart in the scan and need no shuffle. Null ids
    are ids like any other.
    """
    wanted = ids.select(F.xxhash64(F.col(id_col).cast("long")).alias("__h"))
    bits = max(BITMAP_ROW, min(BITMAP_BITS, 1 << (16 * max(1, wanted.count()) - 1).bit_length()))
    slot = lambda h: F.pmod(h, F.lit(bits).cast("long")) + 1
    bucket, bits_of = fresh_names(docs, "bucket", "bits")
    bitmap = wanted.select(slot(F.col("__h")).alias("s")).groupBy(F.bitmap_bucket_number("s").alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias(bits_of))
    at = slot(F.xxhash64(F.col(id_col).cast("long")))
    # At most 4096 rows of 4 KB.
    marked = docs.join(F.broadcast(bitmap), F.bitmap_bucket_number(at) == F.col(bucket), "left")
    place = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring(bits_of, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    maybe = F.coalesce(F.getbit(byte, F.pmod(place, F.lit(8)).cast("int")), F.lit(0)) == 1
    return marked.where(~maybe).drop(bucket, bits_of), marked.where(maybe).drop(bucket, bits_of)


def drop_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of docs whose id isn't in ids; only those whose bit is set are shuffled."""
    sure, unsure = split_by_ids(docs, ids, id_col)
    named = ids.select(F.col(id_col).cast("long").alias("__dropped"))
    return sure.unionByName(unsure.join(named, unsure[id_col].cast("long").eqNullSafe(named["__dropped"]), "left_anti"))


def only_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of docs whose id is in ids; only those whose bit is set are shuffled."""
    _, unsure = split_by_ids(docs, ids, id_col)
    named = ids.select(F.col(id_col).cast("long").alias("__wanted"))
    return unsure.join(named, unsure[id_col].cast("long").eqNullSafe(named["__wanted"]), "left_semi")
