"""Reproducible sharding: a Feistel permutation over global row numbers.

Rows get numbers 0..N-1 in the order of their ids. A Feistel network over the
grid a x b, with a = ceil(sqrt(N)) and b = ceil(N / a), permutes those numbers;
a value that falls on N or beyond walks the cycle until it is back inside. The
place p of a row then is computable from its number alone: shard p mod S, slot
p div S. Only Spark SQL expressions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from candela.llm.common import stage_table, table, text_or_empty

ROUNDS = 6


def grid(n: int) -> tuple[int, int]:
    """Sides (a, b) of the smallest near-square grid with at least n cells."""
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def feistel(x: Column, n: int, seed: int) -> Column:
    """One pass of the network: a permutation of 0 .. a*b-1."""
    a, b = grid(n)
    left, right = F.expr("0L") + F.floor(x / F.lit(b)).cast("long"), F.pmod(x, F.lit(b).cast("long"))
    for k in range(ROUNDS):
        salt = F.lit(seed * ROUNDS + k).cast("long")
        if k % 2 == 0:
            left = F.pmod(left + F.pmod(F.xxhash64(right, salt), F.lit(a).cast("long")), F.lit(a).cast("long"))
        else:
            right = F.pmod(right + F.pmod(F.xxhash64(left, salt), F.lit(b).cast("long")), F.lit(b).cast("long"))
    return left * F.lit(b).cast("long") + right


def longest_walk(spark, n: int, seed: int) -> int:
    """How many passes bring the worst value back below n.

    A walk only continues through the values n .. a*b-1, fewer than sqrt(n)+1,
    so following those few tells the bound for all rows.
    """
    a, b = grid(n)
    passes, outside = 1, spark.range(n, a * b).withColumnRenamed("id", "x")
    while a * b > n:
        outside = stage_table(outside.select(feistel(F.col("x"), n, seed).alias("x")).where(F.col("x") >= n), "walk")
        passes += 1
        if outside.isEmpty():
            break
    return passes


def permuted(x: Column, n: int, seed: int, passes: int) -> Column:
    """The place of row number x among n, a permutation of 0 .. n-1."""
    out = feistel(x, n, seed)
    if passes == 1:
        return out
    walk = F.sequence(F.lit(2), F.lit(passes))
    return F.aggregate(walk, out, lambda acc, _: F.when(acc < n, acc).otherwise(feistel(acc, n, seed)))


def numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """rows with __row, the global number in the given order from 0, and how many there are.

    Range partitions are sorted, each row takes its place in its partition, and
    the partitions' sizes (one row each) give the offsets.
    """
    placed = rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
    placed = stage_table(placed.withColumn("__m", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftrightunsigned("__m", 33), F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(W.Window.orderBy("__p").rowsBetween(W.Window.unboundedPreceding, -1))
    offsets = sizes.select("__p", F.coalesce(before, F.lit(0)).alias("__before"))
    total = sizes.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    # One row per partition: a bound that does not depend on the rows' number.
    out = placed.withColumn("__p", part).join(F.broadcast(offsets), "__p").withColumn("__row", F.col("__before") + place)
    return out.drop("__m", "__p", "__before"), int(total)


def shard_rows(docs: DataFrame, shards: int = 16, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's shard and slot; row counts of shards differ by one at most.

    Defined results: a null text has no bytes and the checksum 0; null ids come
    first in the numbering; repeated rows get numbers of their own; an empty
    table gives an empty result.
    """
    text = F.col(text_col).cast("string")
    narrow = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(text_or_empty(text_col).cast("binary")).alias("text_crc32"),
    )
    rows, n = numbered(stage_table(narrow, "sizes"), ["doc_id", "text_crc32", "size"])
    place = permuted(F.col("__row"), n, seed, longest_walk(docs.sparkSession, n, seed)) if n else F.col("__row")
    out = rows.withColumn("__place", place)
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.pmod("__place", F.lit(shards).cast("long")).cast("int").alias("shard"),
        F.floor(F.col("__place") / F.lit(shards)).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_feistel_shards(spark, sf_dir: str) -> DataFrame:
    """All documents in 16 shards."""
    return shard_rows(table(spark, sf_dir, "documents"))
