"""Ranked lexical search for many queries at once, by common-subexpression evaluation.

1. Items are dealt into blocks of a bounded number of terms, which the tasks
   build: terms that the same items hold become one set, and the pair of sets
   that most items hold next to each other is replaced by a set of its own, over
   and over. So a block is a sharing DAG: each set is the sum of two earlier
   ones, and each item the sum of few sets.
2. Postings: each document's words are counted once a pass, and the terms of
   the pass's block, with the document's size, are staged; document frequencies
   are summed on the way.
3. Accumulators: per batch of documents each set's partial scores are computed
   once, from those of its parts, and items add up the sets they are made of.
   A task keeps each item's best documents, and Spark ranks what tasks kept.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candela.llm.common import small_batches, stage_table, table, text_or_empty
from candela.llm.decontam import words_of

TOP = 10
#: Terms of one block of items, repeats over its items included. A longer item is a block of its own.
BLOCK_TERMS = 200_000
#: Accumulators of one batch of documents: 8 bytes each.
CELLS = 4_000_000


@dataclass
class Block:
    """Items and the sets that they share.

    words: the block's terms; sets: the terms of each basic set; sums: for each
    further set the two earlier ones that it is the sum of; items: per item its
    row, its id and the sets that it is the sum of.
    """

    words: list[bytes]
    sets: list[list[int]]
    sums: list[tuple[int, int]] = field(default_factory=list)
    items: list[tuple[int, object, list[int]]] = field(default_factory=list)


def shared_pairs(lists: list[list[int]], first_new: int) -> list[tuple[int, int]]:
    """Replace, in place, neighbours that several lists share by new numbers; the pairs that those stand for.

    Each round counts all neighbours and replaces, most frequent first, those
    that occur at least twice, so a round costs what the lists are long.
    """
    sums: list[tuple[int, int]] = []
    while True:
        counts = Counter(pair for own in lists for pair in zip(own, own[1:]))
        known = {pair: n for pair, n in counts.items() if n > 1}
        if not known:
            return sums
        number: dict[tuple[int, int], int] = {}
        for k, own in enumerate(lists):
            out, at = [], 0
            while at < len(own):
                pair = tuple(own[at : at + 2])
                after = tuple(own[at + 1 : at + 3])
                if pair in known and known[pair] >= known.get(after, 0):
                    if pair not in number:
                        number[pair] = first_new + len(sums)
                        sums.append(pair)
                    out.append(number[pair])
                    at += 2
                else:
                    out.append(own[at])
                    at += 1
            lists[k] = out


def build_block(items: list[tuple[int, object, list[bytes]]]) -> Block:
    """A block of (row, id, distinct terms)."""
    holders: dict[bytes, list[int]] = defaultdict(list)
    for k, (_, _, terms) in enumerate(items):
        for term in terms:
            holders[term].append(k)
    words = sorted(holders)
    alike: dict[tuple[int, ...], list[int]] = defaultdict(list)
    for number, word in enumerate(words):
        alike[tuple(holders[word])].append(number)
    # Sets that most items hold come first, so items share the starts of their lists.
    order = sorted(alike, key=lambda own: (-len(own), own))
    lists: list[list[int]] = [[] for _ in items]
    for number, own in enumerate(order):
        for k in own:
            lists[k].append(number)
    sums = shared_pairs(lists, len(order))
    return Block(words, [alike[own] for own in order], sums, [(row, item, own) for (row, item, _), own in zip(items, lists)])


def _block_rows(block_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: list[tuple] = []
        size = 0

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(build_block(part), pickle.HIGHEST_PROTOCOL)], pa.binary())], ["payload"])

        for batch in small_batches(batches, 100):
            for row, item, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                terms = sorted(set(words_of(text)))
                if part and size + len(terms) > block_terms:
                    yield told()
                    part, size = [], 0
                if terms:
                    part.append((row, item, terms))
                    size += len(terms)
        if part:
            yield told()

    return run


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_terms: int) -> DataFrame:
    """(block, payload), staged; equal work for the tasks that build them."""
    rows = items.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("item_id"), text_or_empty(text_col).alias("text"))
    rows = stage_table(rows, "items")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Some six bytes a word: about a block for each task. Items of one range of rows stay together.
    n = -(-size // (6 * block_terms))
    dealt = rows.repartitionByRange(n, "row") if n > 1 else rows.coalesce(1)
    return stage_table(dealt.mapInArrow(_block_rows(block_terms), "payload binary").withColumn("block", F.monotonically_increasing_id()), "blocks")


_LOADED: dict = {}


def loaded(sent):
    """A broadcast's value, unpacked once in a worker, which holds one at a time."""
    if _LOADED.get("of") is not sent.value:
        _LOADED.clear()
        _LOADED.update(of=sent.value, value=pickle.loads(sent.value))
    return _LOADED["value"]


POSTINGS_SQL = "doc_id long, n long, terms binary, tf binary"


def _postings(sent):
    """(doc_id, text) as each document's size and its terms of the block, by number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = loaded(sent)
        for batch in small_batches(batches, 200):
            sizes, terms, counts = [], [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                found = Counter(words)
                own = [(number[w], n) for w, n in found.items() if w in number] if len(found) < len(number) else [(k, found[w]) for w, k in number.items() if w in found]
                own.sort()
                sizes.append(len(words))
                terms.append(np.array([k for k, _ in own], "<i4").tobytes())
                counts.append(np.array([n for _, n in own], "<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())], ["doc_id", "n", "terms", "tf"])

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings as (term, docs), summed over the task; term -1 counts documents and -2 their words."""
    held = np.zeros(0, np.int64)
    documents = words = 0
    for batch in batches:
        sizes = np.asarray(batch.column(1).to_numpy(zero_copy_only=False))
        documents += int((sizes > 0).sum())
        words += int(sizes.sum())
        found = np.bincount(np.frombuffer(b"".join(batch.column(2).to_pylist()), "<i4"), minlength=len(held))
        found[: len(held)] += held
        held = found
    term = np.flatnonzero(held)
    yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *term.tolist()], pa.int64()), pa.array([documents, words, *held[term].tolist()], pa.int64())], ["term", "docs"])


def weight(documents: int, holders: int) -> int:
    """A term's weight, by the number of documents that hold it."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holders + 1)))


def _best(held: tuple[np.ndarray, np.ndarray] | None, score: np.ndarray, doc: np.ndarray, null: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Per item (rows) the top scores and their documents, highest first, equal scores by id; held ones take part."""
    doc = np.broadcast_to(doc, score.shape)
    if held is not None:
        score, doc = np.hstack((held[0], score)), np.hstack((held[1], doc))
    if score.shape[1] > 4 * top:
        # All that reach the top-th score, ties included, are among the columns that stay.
        least = np.partition(score, -top, axis=1)[:, -top]
        wide = int((score >= np.maximum(least, 1)[:, None]).sum(axis=1).max(initial=0))
        if wide < score.shape[1] // 2:
            near = np.argsort(-score, axis=1, kind="stable")[:, : max(wide, top)]
            score, doc = np.take_along_axis(score, near, 1), np.take_along_axis(doc, near, 1)
    order = np.lexsort((doc, -score), axis=1)[:, :top]
    return np.take_along_axis(score, order, 1), np.take_along_axis(doc, order, 1)


#: Stands for a null document id, which comes after all others.
NO_ID = np.iinfo(np.int64).max


def _ranked(sent, top: int, cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, weights, documents, words = loaded(sent)
        held = None
        n_sets, n_all = len(block.sets), len(block.sets) + len(block.sums)
        set_of = np.zeros(len(block.words), np.int64)
        for k, terms in enumerate(block.sets):
            set_of[terms] = k
        for batch in small_batches(batches, max(1, cells // max(1, n_all + len(block.items)))):
            sizes = np.asarray(batch.column(1).to_numpy(zero_copy_only=False)).astype(np.int64)
            ids = np.array([NO_ID if x is None else x for x in batch.column(0).to_pylist()], np.int64)
            packed = batch.column(2).to_pylist()
            term, tf = np.frombuffer(b"".join(packed), "<i4"), np.frombuffer(b"".join(batch.column(3).to_pylist()), "<i4").astype(np.int64)
            doc = np.repeat(np.arange(len(ids)), [len(x) // 4 for x in packed])
            m = 10 + (90 * sizes * documents) // max(1, words)
            part = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
            # One row of accumulators for each set, shared by all items.
            sums = np.zeros((n_all, len(ids)), np.int64)
            np.add.at(sums, (set_of[term], doc), part)
            for k, (x, y) in enumerate(block.sums, n_sets):
                np.add(sums[x], sums[y], out=sums[k])
            score = np.stack([sums[own].sum(axis=0) for _, _, own in block.items])
            held = _best(held, score, ids, NO_ID, top)
        if held is None:
            return
        item, place = np.nonzero(held[0] > 0)
        found = held[1][item, place]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([block.items[k][0] for k in item.tolist()], pa.int64()), pa.array([block.items[k][1] for k in item.tolist()], pa.int64()),
                pa.array(found, pa.int64(), mask=found == NO_ID), pa.array(held[0][item, place], pa.int64()),
            ],
            ["row", "item_id", "doc_id", "score"],
        )

    return run


def rank_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", top: int = TOP, block_terms: int = BLOCK_TERMS, cells: int = CELLS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's top documents with a score above 0.

    Defined results: a null text has no terms; items without terms, and all
    items where no document has any, have no rows; repeated rows of documents
    are documents each, repeated items are ranked each; equal scores come by
    ascending document id, null ids last.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    blocks = item_blocks(items, item_col, item_text, block_terms)
    kept = None
    for r in sorted(blocks.select("block").collect()):
        block: Block = pickle.loads(bytes(blocks.where(F.col("block") == r["block"]).first()["payload"]))
        # At most block_terms words.
        number = spark.sparkContext.broadcast(pickle.dumps({w: k for k, w in enumerate(block.words)}, pickle.HIGHEST_PROTOCOL))
        postings = stage_table(rows.mapInArrow(_postings(number), POSTINGS_SQL), "postings")
        # At most two numbers more than the block has words.
        counts = {x["term"]: x["docs"] for x in postings.mapInArrow(_frequencies, "term long, docs long").groupBy("term").agg(F.sum("docs").alias("docs")).collect()}
        documents, words = counts.get(-1, 0), counts.get(-2, 0)
        weights = np.array([weight(documents, counts.get(k, 0)) for k in range(len(block.words))], np.int64)
        sent = spark.sparkContext.broadcast(pickle.dumps((block, weights, documents, words), pickle.HIGHEST_PROTOCOL))
        own = stage_table(postings.where("n > 0").mapInArrow(_ranked(sent, top, cells), "row long, item_id long, doc_id long, score long"), "kept")
        kept = own if kept is None else kept.unionByName(own)
    if kept is None:
        kept = spark.createDataFrame([], "row long, item_id long, doc_id long, score long")
    # At most `top` rows an item and task.
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return kept.withColumn("rank", place).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def op13_ranked_search(spark, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark
), s AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_words FROM d WHERE len(w) > 0
), p AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY 1, 2, 3
), f AS (SELECT t, count(*) AS df FROM p GROUP BY 1
), x AS (
  SELECT i.item_id, p.doc_id,
    CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_words))) AS part
  FROM i JOIN p USING (t) JOIN f USING (t), s
), r AS (
  SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM x GROUP BY 1, 2 HAVING sum(part) > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r) WHERE rank <= 10
"""
