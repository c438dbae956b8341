"""Benchmark decontamination by a generalised suffix automaton over item words.

The items' words form one automaton per block of items. Blocks are built by the
tasks, of a bounded number of words, and staged; a pass over the documents holds
at most PASS_BLOCKS of them, so what is sent to the tasks is bounded whatever the
benchmark's size, and a larger benchmark takes more passes, whose hits are put
together by row. Documents stream by in Arrow batches. Words are numbered by the
benchmark's vocabulary, and only stretches whose neighbouring words also are
neighbours in some item are walked through the automaton, which keeps the
longest matching length at each word. Matches that cover a window mark words.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candela.llm.common import fresh_names, small_batches, stage_table, table, text_or_empty

WINDOW = 13
#: Words of one block of items: about twice as many states, some 250 bytes each.
BLOCK_WORDS = 100_000
#: Blocks that one pass over the documents holds.
PASS_BLOCKS = 4
#: Documents are contaminated if hit words are at least one in this many.
COVERAGE = 20

_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """The contract's words: runs of digits, letters (A-Z lower-cased) and non-ASCII characters."""
    return text.encode("utf-8", "surrogatepass").translate(_KEEP).split()


class SuffixAutomaton:
    """A generalised suffix automaton over sequences of word numbers.

    step: transitions per state; link: suffix links; length: longest match of a
    state; items: per state the items of whose text it is a part, for states
    that can hold a whole window; whole: per state the short items that end
    there, and up: the nearest state on its links with such.
    """

    def __init__(self, sequences: list[tuple[int, list[int]]], window: int):
        self.window = window
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        owners: list[set[int]] = [set()]
        whole: list[list[int]] = [[]]
        self.owners = owners
        for item, sequence in sequences:
            last = 0
            for word in sequence:
                last = self._extend(last, word)
        for item, sequence in sequences:
            state = 0
            for word in sequence:
                state = self.step[state][word]
                at = state
                while self.length[at] >= window and item not in owners[at]:
                    owners[at].add(item)
                    at = self.link[at]
            if 0 < len(sequence) < window:
                whole.extend([] for _ in range(len(self.length) - len(whole)))
                whole[state].append(item)
        whole.extend([] for _ in range(len(self.length) - len(whole)))
        self.whole = whole
        self.up = [0] * len(self.length)
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            self.up[state] = state if whole[state] else self.up[self.link[state]]
        self.short = {len(s) for _, s in sequences if 0 < len(s) < window}

    def _new(self, length: int, link: int, step: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.step.append(step)
        self.owners.append(set())
        return len(self.length) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.step[q]))
        self.link[q] = clone
        while p >= 0 and self.step[p].get(word) == q:
            self.step[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: int) -> int:
        if word in self.step[last]:
            q = self.step[last][word]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        state = self._new(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and word not in self.step[p]:
            self.step[p][word] = state
            p = self.link[p]
        if p >= 0:
            q = self.step[p][word]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return state

    def matches(self, sequence: list[int]) -> Iterator[tuple[int, int, set[int]]]:
        """(end, length, items) for each place where a window ends; length: the longest that windows cover there."""
        state = length = 0
        window, step, link, long = self.window, self.step, self.link, self.length
        for end, word in enumerate(sequence, 1):
            while state and word not in step[state]:
                state = link[state]
                length = long[state]
            state = step[state].get(word, 0)
            length = length + 1 if state else 0
            items: set[int] = set()
            covered = 0
            at = state
            if length >= window:
                covered = length
                while long[link[at]] >= window:
                    at = link[at]
                items |= self.owners[at]
            at = state if self.length[state] <= length else self.link[state]
            at = self.up[at]
            while at:
                items.update(self.whole[at])
                covered = max(covered, long[at])
                at = self.up[self.link[at]]
            if items:
                yield end, covered, items


@dataclass
class Block:
    """What documents are held against: vocabulary, neighbouring pairs, automaton, item ids."""

    vocabulary: dict[bytes, int]
    pairs: np.ndarray
    least: int
    automaton: SuffixAutomaton
    ids: list


def build_block(items: list[tuple[object, list[bytes]]], window: int = WINDOW) -> Block:
    """A block of (id, words)."""
    vocabulary: dict[bytes, int] = {}
    sequences = [(k, [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words]) for k, (_, words) in enumerate(items) if words]
    size = len(vocabulary) + 1
    pairs = {a * size + b for _, s in sequences for a, b in zip(s, s[1:])}
    least = min([window, *(len(s) for _, s in sequences)])
    return Block(vocabulary, np.array(sorted(pairs), np.int64), least, SuffixAutomaton(sequences, window), [i for i, _ in items])


def stretches(numbers: np.ndarray, block: Block) -> Iterator[tuple[int, int]]:
    """(start, end) of the maximal stretches that can hold a window: neighbours there are neighbours in an item."""
    known = numbers > 0
    if not known.any():
        return
    size = len(block.vocabulary) + 1
    pair = numbers[:-1] * size + numbers[1:]
    if len(block.pairs):
        at = np.minimum(np.searchsorted(block.pairs, pair), len(block.pairs) - 1)
        joined = (block.pairs[at] == pair) & known[:-1] & known[1:]
    else:
        joined = np.zeros(len(pair), bool)
    # A word starts a stretch if it is known and not joined to the word before it.
    start = np.flatnonzero(known & ~np.concatenate(([False], joined)))
    end = np.flatnonzero(known & ~np.concatenate((joined, [False]))) + 1
    wide = end - start >= block.least
    yield from zip(start[wide].tolist(), end[wide].tolist())


def hits_of(words: list[bytes], blocks: list[Block]) -> tuple[np.ndarray, set]:
    """Per word whether it is inside a window's occurrence, and the items with such windows."""
    hit, found = np.zeros(len(words), bool), set()
    for block in blocks:
        get = block.vocabulary.get
        numbers = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        for s, e in stretches(numbers, block):
            for end, length, items in block.automaton.matches(numbers[s:e].tolist()):
                hit[s + end - length : s + end] = True
                found.update(block.ids[k] for k in items)
    return hit, found


def cut_item(words: list[bytes], most: int, window: int = WINDOW) -> Iterator[list[bytes]]:
    """An item in parts of at most so many words that overlap by one less than a window, so each window is in a part."""
    most = max(most, 2 * window)
    for s in range(0, max(1, len(words) - window + 1), most - window + 1):
        yield words[s : s + most]


def _block_rows(block_words: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: list[tuple] = []
        size = 0

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(build_block(part, window), pickle.HIGHEST_PROTOCOL)], pa.binary())], ["payload"])

        for batch in small_batches(batches, 100):
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for words in cut_item(words_of(text), block_words, window):
                    part.append((item, words))
                    size += len(words)
                    if size >= block_words:
                        yield told()
                        part, size = [], 0
        if size:
            yield told()

    return run


class Blocks:
    """The benchmark's blocks, staged, and the passes that go over them."""

    def __init__(self, benchmark: DataFrame, block_words: int = BLOCK_WORDS, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, pass_blocks: int = PASS_BLOCKS):
        rows = benchmark.select(F.col(id_col).alias("i"), text_or_empty(text_col).alias("t"))
        size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
        # Some six bytes a word: about a block for each task.
        dealt = rows.repartition(max(1, -(-size // (6 * block_words))))
        built = dealt.mapInArrow(_block_rows(block_words, window), "payload binary").withColumn("block", F.monotonically_increasing_id())
        self.staged = stage_table(built, "blocks")
        numbers = sorted(r["block"] for r in self.staged.select("block").collect())
        self.passes = [numbers[k : k + pass_blocks] for k in range(0, len(numbers), pass_blocks)] or [[]]

    def sent(self, numbers: list[int]):
        """A broadcast of one pass's blocks."""
        got = self.staged.where(F.col("block").isin(numbers)).select("payload").collect() if numbers else []
        return self.staged.sparkSession.sparkContext.broadcast([bytes(r["payload"]) for r in got])


_LOADED: dict[int, list[Block]] = {}


def loaded(sent) -> list[Block]:
    """The blocks of a broadcast, unpacked once in a worker, which holds one pass's at a time."""
    if sent.value is not _LOADED.get("of"):
        _LOADED.clear()
        _LOADED.update({"of": sent.value, "blocks": [pickle.loads(p) for p in sent.value]})
    return _LOADED["blocks"]


def _spans(hit: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return [{"first": int(a), "last": int(b) - 1} for a, b in zip(edge[::2], edge[1::2])]


SPAN = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


HIT = [("n_words", pa.int64()), ("spans", SPAN), ("items", pa.list_(pa.string()))]
HIT_SQL = "n_words long, spans array<struct<first: long, last: long>>, items array<string>"


def _hits(sent, only_hits: bool = False):
    """Rows (row, text) as (row, n_words, spans, items) by one pass's blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = loaded(sent)
        for batch in small_batches(batches):
            out: dict[str, list] = {k: [] for k, _ in HIT}
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                hit, found = hits_of(words, blocks)
                out["n_words"].append(len(words))
                out["spans"].append(_spans(hit) if found else [])
                out["items"].append(sorted(map(str, found)))
            got = pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[k], t) for k, t in HIT)], ["row", *out])
            yield got.filter(pa.array([bool(x) for x in out["items"]], pa.bool_())) if only_hits else got

    return run


def joined_spans(spans: list[dict]) -> list[dict]:
    """Spans that meet or overlap as one."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: (s["first"], s["last"])):
        if out and s["first"] <= out[-1]["last"] + 1:
            out[-1]["last"] = max(out[-1]["last"], s["last"])
        else:
            out.append(dict(s))
    return out


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        spans = pa.array([joined_spans(s) for s in batch.column(2).to_pylist()], SPAN)
        items = pa.array([sorted(set(x)) for x in batch.column(3).to_pylist()], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), spans, items], batch.schema.names)


def hits_by_row(rows: DataFrame, blocks: Blocks) -> DataFrame:
    """(row, n_words, spans, items) of rows (row, text); with several passes, rows must be staged and row numbers differ."""
    schema = f"row {rows.schema['row'].dataType.simpleString()}, {HIT_SQL}"
    if len(blocks.passes) == 1:
        return rows.mapInArrow(_hits(blocks.sent(blocks.passes[0])), schema)
    parts = None
    for k, numbers in enumerate(blocks.passes):
        sent = blocks.sent(numbers)
        got = stage_table(rows.mapInArrow(_hits(sent, only_hits=k > 0), schema), "hits")
        sent.unpersist()
        parts = got if parts is None else parts.unionByName(got)
    # At most as many parts a row as there are passes.
    put = parts.groupBy("row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    return put.mapInArrow(_joined, schema)


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS, pass_blocks: int = PASS_BLOCKS) -> DataFrame:
    """One row per document: words, hit words, items, their digest, spans of hit words and the verdict.

    Defined results: null texts and texts without words have no hits; equal
    items each count; an item without words never matches; an empty benchmark
    hits nothing; repeated rows are measured each.
    """
    blocks = Blocks(benchmark, block_words, pass_blocks=pass_blocks)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    if len(blocks.passes) == 1:
        found = hits_by_row(rows.select(F.col("doc_id").alias("row"), "text"), blocks).withColumnRenamed("row", "doc_id")
    else:
        rows = stage_table(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
        found = hits_by_row(rows.select("row", "text"), blocks).join(rows.select("row", "doc_id"), "row").drop("row")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["last"] - s["first"] + 1)
    found = found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), "spans")
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (COVERAGE * F.col("n_hit") >= F.col("n_words")))


def contaminated(n_words: int, spans: list[dict], min_span: int | None) -> bool:
    """Whether these spans contaminate a text of so many words."""
    sizes = [s["last"] - s["first"] + 1 for s in spans]
    return bool(sizes) and (COVERAGE * sum(sizes) >= n_words or bool(min_span) and max(sizes) >= min_span)


def _filter(sent, column: int, min_span: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = loaded(sent)
        for batch in small_batches(batches):
            keep = []
            for text in batch.column(column).to_pylist():
                words = words_of(text or "")
                hit, found = hits_of(words, blocks)
                keep.append(not (found and contaminated(len(words), _spans(hit), min_span)))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def _clean_rows(min_span: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad = [contaminated(n, spans, min_span) for n, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(bad, pa.bool_()))], ["row"])

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", min_span: int | None = None, block_words: int = BLOCK_WORDS, pass_blocks: int = PASS_BLOCKS) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns; where one pass is enough, without a shuffle.

    min_span also drops documents with a hit span of so many words, whatever
    their coverage. Null and empty texts stay; repeated rows are judged each.
    """
    blocks = Blocks(benchmark, block_words, pass_blocks=pass_blocks)
    if len(blocks.passes) == 1:
        return docs.mapInArrow(_filter(blocks.sent(blocks.passes[0]), docs.columns.index(text_col), min_span), docs.schema)
    (row,) = fresh_names(docs, "row")
    rows = stage_table(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = hits_by_row(rows.select(F.col(row).alias("row"), text_or_empty(text_col).alias("text")), blocks)
    bad = found.mapInArrow(_clean_rows(min_span), "row long").withColumnRenamed("row", row)
    return rows.join(bad, row, "left_anti").select(*docs.columns)


_CUT = None


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the characters from each span's first to its last word."""
    import regex

    global _CUT
    _CUT = _CUT or regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    places = [m.span() for m in _CUT.finditer(text)]
    out, at = [], 0
    for first, last in spans:
        out.append(text[at : places[first][0]])
        at = places[last][1]
    return "".join(out) + text[at:]


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cut = [cut_spans(t, [(s["first"], s["last"]) for s in spans or []]) for t, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cut, pa.string())], ["doc_id", "text"])


def remove_spans(docs: DataFrame, benchmark: DataFrame, min_words: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS, pass_blocks: int = PASS_BLOCKS) -> DataFrame:
    """(doc_id, text) with spans of hit words of at least min_words cut out of each text; a null text is an empty one."""
    blocks = Blocks(benchmark, block_words, pass_blocks=pass_blocks)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = stage_table(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    long = F.filter("spans", lambda s: s["last"] - s["first"] + 1 >= min_words)
    found = hits_by_row(rows.select("row", "text"), blocks).select("row", long.alias("spans")).where(F.size("spans") > 0)
    return rows.join(found, "row", "left").select("doc_id", "text", "spans").mapInArrow(_cut_rows, "doc_id long, text string")


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    """Contamination of all documents by the benchmark."""
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i + 1:i + least(len(w), 13)], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 12, least(len(w), 1)))) AS i FROM b)
), sizes AS (SELECT DISTINCT n FROM win
), occ AS (
  SELECT doc_id, i, n, array_to_string(w[i + 1:i + n], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(greatest(len(w) - n + 1, 0))) AS i FROM d, sizes)
), m AS (SELECT occ.doc_id, occ.i, occ.n, win.item_id FROM occ JOIN win USING (n, s)
), hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY 1
), its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))), ',') AS ids FROM m GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
