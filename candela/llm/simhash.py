"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint is eight positional bytes. Two that differ in at most three bits
share at least five of them. Postings are kept for combinations of c byte
positions out of the first c + 3, of which such a pair shares at least one, so
nothing is missed, and c is raised with the number of fingerprints, so that a
posting list stays short. Inside a list the shared positional bytes of two
fingerprints are tallied; pairs with five or more are verified by their bits.

Equal fingerprints are one node from the start. A list gives links that span
it, not all its pairs, and components come from contraction over DataFrames.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from candela.llm.common import drop_ids, fresh_names, only_ids, small_batches, stage_table, table, text_or_empty
from candela.llm.components import components

BYTES, MAX_BITS = 8, 3
SHARED = BYTES - MAX_BITS
#: Shingles whose bits are unpacked at once.
CHUNK = 1 << 15


def fingerprint(text: str, words_per_shingle: int = 3) -> int:
    """The 64-bit SimHash of the text's word shingles, repeats included; no words: zero."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    xx, n = xxhash.xxh64_intdigest, len(words) - words_per_shingle + 1
    if n < 1:
        return xx(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    h = np.array([xx(joined[s:e], 42) for s, e in zip(starts[:n].tolist(), ends[words_per_shingle - 1 :].tolist())], np.uint64)
    counts = np.zeros(64, np.int64)
    for k in range(0, n, CHUNK):
        counts += np.unpackbits(h[k : k + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(words_per_shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = np.array([fingerprint(t, words_per_shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """(doc_id, fp as a signed long) for each row of docs."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(_fingerprints(words_per_shingle), "doc_id long, fp long")


def key_bytes(fingerprints_count: int) -> int:
    """Positional bytes in a posting's key, 3 to 5: as few as keep a list of unrelated fingerprints short."""
    return next((c for c in (3, 4) if fingerprints_count <= 256**c // 8), SHARED)


def _posting_keys(c: int):
    """For each combination of c of the first c + 3 positions, its number and those bytes, as one long."""
    fp = F.col("fp")
    keys = []
    for number, positions in enumerate(combinations(range(c + MAX_BITS), c)):
        parts = F.lit(number).cast("long")
        for p in positions:
            parts = F.shiftleft(parts, 8).bitwiseOR(F.shiftrightunsigned(fp, 8 * p).bitwiseAND(F.lit(255).cast("long")))
        keys.append(parts)
    return F.array(*keys)


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether pairs have five positional bytes in common, and then differ in three bits or fewer."""
    x = a ^ b
    shared = np.zeros(np.broadcast(a, b).shape, np.int8)
    for p in range(BYTES):
        shared += ((x >> np.uint64(8 * p)) & np.uint64(255)) == 0
    out = shared >= SHARED
    out[out] = np.bitwise_count(x[out]) <= MAX_BITS
    return out


def spanning_links(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected within one posting list, fewer than its members."""
    left, frontier = fps.astype(np.uint64), np.empty(0, np.uint64)
    a, b = [], []
    while len(left):
        if not len(frontier):
            frontier, left = left[:1], left[1:]
        node, frontier = frontier[0], frontier[1:]
        hit = _near(left, node)
        if hit.any():
            found, left = left[hit], left[~hit]
            a.append(np.full(len(found), node))
            b.append(found)
            frontier = np.concatenate((frontier, found))
    return (np.concatenate(a), np.concatenate(b)) if a else (left, left)


#: Posting lists up to this long are compared pairwise together with others of their task.
SHORT = 32


def _links_of(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within the runs of equal keys."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    lengths = np.diff(np.concatenate((starts, [len(keys)])))
    a, b = [], []
    for s, n in zip(starts[lengths > SHORT], lengths[lengths > SHORT]):
        x, y = spanning_links(fps[s : s + n])
        a.append(x)
        b.append(y)
    short = np.repeat((lengths > 1) & (lengths <= SHORT), lengths)
    keys, fps = keys[short], fps[short]
    for step in range(1, int(lengths[(lengths > 1) & (lengths <= SHORT)].max(initial=1))):
        at = np.flatnonzero(keys[step:] == keys[:-step])
        hit = at[_near(fps[at], fps[at + step])]
        a.append(fps[hit])
        b.append(fps[hit + step])
    none = np.empty(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _link_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a partition that is sorted by key; a list may run over batches."""
    keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)

    def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for batch in batches:
        keys = np.concatenate((keys, batch.column(0).to_numpy(zero_copy_only=False)))
        fps = np.concatenate((fps, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
        if len(keys) and keys[-1] != keys[0]:
            cut = int(np.searchsorted(keys, keys[-1]))
            yield out(*_links_of(keys[:cut], fps[:cut]))
            keys, fps = keys[cut:], fps[cut:]
    if len(keys):
        yield out(*_links_of(keys, fps))


def near_links(nodes: DataFrame, count: int) -> DataFrame:
    """Links (a, b) among distinct fingerprints that connect all within three bits of each other.

    A posting list holds distinct fingerprints with c bytes in common, so its
    length is bounded by what the other bytes can tell apart, and equal texts
    never lengthen it.
    """
    c = key_bytes(count)
    postings = nodes.select(F.explode(_posting_keys(c)).alias("key"), "fp")
    lists = postings.repartition("key").sortWithinPartitions("key")
    return lists.mapInArrow(_link_lists, "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): fingerprints and the smallest id reachable by links of three bits or fewer.

    Defined results: null and empty texts have fingerprint zero and link like
    any other; repeated rows give one row each; a null id is reachable but is
    named only where a component has no other id.
    """
    return rooted_components(docs, id_col, text_col, words_per_shingle).drop("root")


def rooted_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """simhash_components with each component's root, a fingerprint, as ids that are null or repeat name several components."""
    rows = stage_table(fingerprints(docs, id_col, text_col, words_per_shingle), "fingerprints")
    nodes = stage_table(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    linked = components(near_links(nodes.select("fp"), nodes.count()), "a", "b")
    named = linked.join(nodes, linked["node"] == nodes["fp"]).groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = linked.join(named, "root").select(F.col("node").alias("fp"), "component_id", "root")
    # Staged, so that both sides of the join are plain exchanges and a hot fingerprint's rows can be split.
    own = stage_table(nodes.join(of_fp, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("root", "fp").alias("root")), "named")
    return rows.join(own, "fp").select("doc_id", "fp", "component_id", "root")


def with_fingerprints(docs: DataFrame, name: str, text_col: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """docs with all their columns and their fingerprints under the given name."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = np.array([fingerprint(t or "", words_per_shingle) for t in batch.column(at).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.view(np.int64))], [*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, LongType())]))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: one row of each component.

    Ids that name one row are settled by id, without moving the other rows. An
    id that repeats, or null ids, can name rows of several components and are
    settled row by row, by their fingerprints.
    """
    found = stage_table(rooted_components(docs, id_col, text_col), "components")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    again = stage_table(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias(id_col)), "again")
    goes = found.where(~stays).select(F.col("doc_id").alias(id_col)).unionByName(again).distinct()
    kept = drop_ids(docs, stage_table(goes, "near"), id_col)
    if again.isEmpty():
        return kept
    own, fp = fresh_names(docs, "own", "fp")
    rows = with_fingerprints(only_ids(docs, again, id_col), fp, text_col).withColumn(own, F.col(id_col).cast("long"))
    named = only_ids(found.where(stays), again.select(F.col(id_col).alias("doc_id")), "doc_id")
    # Rows of the id that stays can differ in their fingerprints; the smallest is taken.
    one = named.groupBy("root", "doc_id").agg(F.min("fp").alias("fp")).select(F.col("doc_id").alias("__kept"), "fp")
    match = rows[own].eqNullSafe(one["__kept"]) & (rows[fp] == one["fp"])
    return kept.unionByName(rows.join(one, match, "left_semi").dropDuplicates([own, fp]).drop(own, fp))


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    """SimHash components of all documents."""
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
