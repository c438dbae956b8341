"""Exact dedup against immutable snapshots screened by binary-fuse filters.

Rows that are already known form a snapshot: one row per digest, dealt into
buckets, with one static 3-wise binary-fuse filter per bucket. A new batch is
first grouped by digest (its own duplicates meet there, pre-aggregated, so a
text that a third of the rows share is one row). Each group is screened by its
bucket's filter. A negative is certainly new. A positive joins the snapshot's
exact buckets, and the two texts are compared byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.llm.common import WHITE_SPACE, drop_ids, fresh_names, only_ids, shuffle_width, split_by_ids, stage_table, table, text_or_empty

#: Digests that one bucket, and so one filter and one task's group, holds on average.
BUCKET_DIGESTS = 20_000
FILTER_SCHEMA = "bucket int, seed long, segment long, segments long, prints binary"
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def normalised(column: str = "text") -> Column:
    """The text with each run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(text_or_empty(column), WHITE_SPACE, " ")


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """64 well-mixed bits for each key."""
    h = keys + np.uint64(seed) * _GOLD
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def _slots(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
    """The three slots of each key, in three consecutive segments."""
    mask = np.uint64(segment - 1)
    first = ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    base = first * np.uint64(segment)
    return np.stack([base + np.uint64(k * segment) + ((h >> np.uint64(18 * k)) & mask) for k in range(3)]).astype(np.int64)


def _print_of(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(29))) & np.uint64(0xFFFF)).astype(np.uint16)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """A binary-fuse filter with 16-bit prints over distinct 64-bit keys: (seed, segment, segments, prints).

    Keys that are alone in some slot are peeled, all at once per round; the
    prints are then set in the reverse order. A seed that leaves a core is
    given up for the next one.
    """
    keys = np.unique(keys.astype(np.uint64))
    n = max(len(keys), 2)
    segment = 1 << max(2, int(np.floor(np.log(n) / np.log(3.33) + 2.25)))
    slots_wanted = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(n)) * n + 8
    segments = max(1, int(np.ceil(slots_wanted / segment)))
    size = segment * (segments + 2)
    for seed in range(1, 200):
        h = _mix(keys, seed)
        slots = _slots(h, segment, segments)
        degree = np.bincount(slots.ravel(), minlength=size)
        total = np.zeros(size, np.int64)
        index = np.arange(len(keys))
        for row in slots:
            np.add.at(total, row, index)
        rounds, left = [], len(keys)
        while left:
            alone = np.flatnonzero(degree == 1)
            if not len(alone):
                break
            peeled, first = np.unique(total[alone], return_index=True)
            rounds.append((peeled, alone[first]))
            for row in slots[:, peeled]:
                np.subtract.at(degree, row, 1)
                np.subtract.at(total, row, peeled)
            left -= len(peeled)
        if left:
            continue
        prints, wanted = np.zeros(size, np.uint16), _print_of(h)
        for peeled, own in reversed(rounds):
            prints[own] = 0
            prints[own] = wanted[peeled] ^ np.bitwise_xor.reduce(prints[slots[:, peeled]], axis=0)
        return seed, segment, segments, prints.tobytes()
    raise ValueError("no seed peels these keys")


def maybe_in(keys: np.ndarray, seed: int, segment: int, segments: int, prints: bytes) -> np.ndarray:
    """True for every key of the filter, and for about 1 in 65,536 others."""
    h = _mix(keys.astype(np.uint64), seed)
    return np.bitwise_xor.reduce(np.frombuffer(prints, np.uint16)[_slots(h, segment, segments)], axis=0) == _print_of(h)


def _filter_of_bucket(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    seed, segment, segments, prints = build_filter(rows["__h"].to_numpy().astype(np.uint64))
    return pd.DataFrame([(key[0], seed, segment, segments, prints)], columns=["bucket", "seed", "segment", "segments", "prints"])


def _screen_bucket(key: tuple, groups: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    if len(groups) and len(filters):
        f = filters.iloc[0]
        hit = maybe_in(groups["__h"].to_numpy().astype(np.uint64), int(f.seed), int(f.segment), int(f.segments), f.prints)
        groups = groups[hit]
    else:
        groups = groups.iloc[:0]
    return groups[["__sha"]]


def digests_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, number of such rows), staged: the one pass over whole texts."""
    narrow = docs.select(F.col(id_col).cast("long").alias("__id"), F.sha2(normalised(text_col), 256).alias("__sha"))
    return stage_table(narrow.groupBy("__id", "__sha").agg(F.count(F.lit(1)).alias("__n")), "digests")


def _groups(rows: DataFrame, buckets: int) -> DataFrame:
    h = F.conv(F.substring("__sha", 1, 15), 16, 10).cast("long")
    grouped = rows.groupBy("__sha").agg(F.min("__id").alias("__first"), F.sum("__n").alias("__rows"))
    return grouped.withColumn("__h", h).withColumn("__bucket", F.pmod(F.col("__h"), F.lit(buckets)).cast("int"))


def build_snapshot(rows: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """The immutable snapshot of digest rows: (exact buckets, filters), both staged."""
    exact = stage_table(_groups(rows, buckets), "snapshot")
    filters = exact.groupBy(F.col("__bucket").alias("bucket")).applyInPandas(_filter_of_bucket, FILTER_SCHEMA)
    return exact, stage_table(filters, "filters")


def _same_bytes(docs: DataFrame, pairs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pairs (__sha, __new, __old) whose two normalised texts are equal byte for byte."""
    wanted = pairs.select("__sha", F.explode(F.array("__new", "__old")).alias("__id"))
    near = split_by_ids(docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__t")), wanted, "__id")[1]
    texts = near.select("__id", normalised("__t").alias("__t"))
    seen = wanted.join(texts, wanted["__id"].eqNullSafe(texts["__id"])).where(F.sha2("__t", 256) == F.col("__sha"))
    equal = seen.groupBy("__sha").agg((F.min("__t") == F.max("__t")).alias("__same"))
    return equal.where("__same").select("__sha")


def dedup_batch(docs: DataFrame, batch: DataFrame, snapshot: tuple[DataFrame, DataFrame], buckets: int, id_col: str, text_col: str) -> DataFrame:
    """Classes (__sha, __new, __keep, __rows) over the snapshot and the batch together, one row for each digest of either.

    Where the byte check shows that two texts of one digest differ, they are
    two classes.
    """
    exact, filters = snapshot
    groups = stage_table(_groups(batch, buckets), "batch")
    positive = groups.groupBy("__bucket").cogroup(filters.groupBy("bucket")).applyInPandas(_screen_bucket, "__sha string")
    pairs = stage_table(
        groups.join(positive, "__sha", "left_semi")
        .select("__sha", F.col("__first").alias("__new"))
        .join(exact.select("__sha", F.col("__first").alias("__old")), "__sha"),
        "pairs",
    )
    same = _same_bytes(docs, pairs, id_col, text_col).withColumn("__known", F.lit(True))
    new = groups.join(same, "__sha", "left").where("__known is null").select("__sha", F.lit(True).alias("__new"), F.col("__first").alias("__keep"), "__rows")
    known = groups.join(same, "__sha", "left_semi").select("__sha", "__first", "__rows", F.lit(True).alias("__new"))
    both = exact.select("__sha", "__first", "__rows", F.lit(False).alias("__new")).unionByName(known)
    joined = both.groupBy("__sha").agg(F.min("__first").alias("__keep"), F.sum("__rows").alias("__rows"), F.max("__new").alias("__both"))
    sides = F.when(F.col("__both"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    return joined.select("__sha", F.explode(sides).alias("__new"), "__keep", "__rows").unionByName(new)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", snapshot_share: float = 0.5) -> DataFrame:
    """One row per document: its id, the id that stays, the group's size, whether it stays, its digest.

    The rows below the snapshot_share quantile of the ids form the snapshot,
    the others the batch that comes in. Defined results: a null text is an empty
    one; of rows that repeat the id that stays, one stays; a null id never
    stays before another id; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    digests = digests_of(docs, id_col, text_col)
    pivot, rows = digests.agg(F.percentile_approx("__id", snapshot_share, 10_000), F.count(F.lit(1))).first()
    buckets = max(shuffle_width(spark), -(-rows // BUCKET_DIGESTS))
    old = F.col("__id") < F.lit(pivot if pivot is not None else 0)
    snapshot = build_snapshot(digests.where(old), buckets)
    # Staged, so that both sides of the join are plain exchanges and a hot digest's rows can be split.
    new = ~old | F.col("__id").isNull()
    classes = stage_table(dedup_batch(docs, digests.where(new), snapshot, buckets, id_col, text_col), "classes")
    out = digests.withColumn("__new", F.coalesce(new, F.lit(True))).join(classes, ["__sha", "__new"]).withColumn("__k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))))
    return out.select(
        F.col("__id").alias("doc_id"),
        F.col("__keep").alias("keep_id"),
        F.col("__rows").alias("group_size"),
        (F.col("__id").eqNullSafe(F.col("__keep")) & (F.col("__k") == 1)).alias("kept"),
        F.col("__sha").alias("text_sha256"),
    )




def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns; one row of each group of equal texts.

    Ids that only name rows that go are dropped without moving the other rows.
    An id that names rows of both kinds, or repeats, is settled row by row.
    """
    decided = stage_table(exact_dedup(docs, id_col, text_col), "decided")
    per_id = decided.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("kept").cast("int")).alias("k"))
    gone = stage_table(per_id.where("k < n").select(F.col("doc_id").alias(id_col), F.col("k")), "gone")
    kept = drop_ids(docs, gone.select(id_col), id_col)
    mixed = stage_table(gone.where("k > 0").select(id_col), "mixed")
    if mixed.isEmpty():
        return kept
    own, sha = fresh_names(docs, "own", "sha")
    rows = only_ids(docs, mixed, id_col).withColumns({own: F.col(id_col).cast("long"), sha: F.sha2(normalised(text_col), 256)})
    stays = decided.where("kept").select("doc_id", "text_sha256")
    match = rows[own].eqNullSafe(stays["doc_id"]) & (rows[sha] == stays["text_sha256"])
    return kept.unionByName(rows.join(stays, match, "left_semi").dropDuplicates([own, sha]).drop(own, sha))


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Exact dedup of all documents."""
    return exact_dedup(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
