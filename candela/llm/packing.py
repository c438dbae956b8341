"""Best-fit packing of tokenised documents by a linear grouping scheme.

Only the histogram of piece lengths, at most `capacity` rows, reaches the
driver; the plan is made there for whole runs of alike sequences, so its size
and time do not depend on the number of documents:

1. large pieces, sorted by length, are cut into groups of equal cardinality
   and rounded up to their group's largest length;
2. a linear program over configurations of those few sizes is solved by column
   generation, and each configuration's count is rounded down;
3. actual pieces, which are no longer than their rounded size, take the places;
4. what rounding down has left is grouped anew, more finely as it is less, until
   no configuration is whole;
5. the few large pieces still left and the small ones, longest first, go where
   they fit best.

Pieces are numbered globally in order of length, and a run's place for a piece
is an interval of those numbers, looked up by binary search in the tasks.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candela.llm.common import small_batches, stage_table, table, text_or_empty
from candela.llm.sharding import numbered

CAPACITY = 2048
END_ID = 0
GROUPS = 256
#: Pieces of at most the capacity over this are small.
SMALL = 3

# ---- tokens


def default_tokenizer() -> str:
    """The place of the 50k byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, by rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


@lru_cache(maxsize=2)
def encoder(path: str):
    """An encoder for the vocabulary file: the same ids as the tokenizers library gives, in a fraction of its time.

    In such a file ids are merge ranks.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {x["content"]: x["id"] for x in model["added_tokens"]}
    alphabet = byte_alphabet()
    ranks = {bytes(alphabet[c] for c in word): rank for word, rank in model["model"]["vocab"].items() if word not in special}
    return tiktoken.Encoding("ids", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def document_ids(text: str, path: str, added_tokens: bool = False) -> np.ndarray:
    """The document's ids with the end id, as unsigned 32-bit little-endian numbers.

    added_tokens: the vocabulary's added tokens inside the text are tokens, as
    the tokenizers library has it by default; else they are ordinary text.
    """
    return np.append(encoder(path).encode_to_numpy(text, allowed_special="all" if added_tokens else set(), disallowed_special=()).astype("<u4"), np.array([END_ID], "<u4"))


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but the first, which takes the remainder."""
    first = (n - 1) % capacity + 1
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def _pieces(path: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = document_ids(text, path, added_tokens=True)
                for k, (s, n) in enumerate(cuts(len(ids), capacity)):
                    part = ids[s : s + n]
                    out.append((doc, k, s, n, zlib.crc32(part.tobytes()), part.tolist() if with_ids else None))
            columns = list(zip(*out)) if out else [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            k = 6 if with_ids else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[:k], kinds)], names[:k])

    return run


# ---- the plan, over length counts


class Runs:
    """Runs of alike sequences: how many, and for each place in them a length and the first piece's number."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = dict(counts)
        base, at = {}, 0
        for length in sorted(counts):
            base[length] = at
            at += counts[length]
        self.next = base
        self.open: dict[int, list[tuple[int, list[tuple[int, int]]]]] = defaultdict(list)
        self.rooms: list[int] = []

    def take(self, length: int, n: int) -> tuple[int, int]:
        """The next n pieces of a length, as a place of a run of n."""
        at = self.next[length]
        self.next[length] += n
        self.left[length] -= n
        return length, at

    def add(self, n: int, places: list[tuple[int, int]]) -> None:
        """A run of n sequences that hold these places."""
        if n:
            room = self.capacity - sum(length for length, _ in places)
            if not self.open[room]:
                bisect.insort(self.rooms, room)
            self.open[room].append((n, places))

    def best_fit(self, length: int) -> None:
        """Put all that is left of one length where it fits best, or into new sequences."""
        while n := self.left[length]:
            k = bisect.bisect_left(self.rooms, length)
            if k == len(self.rooms):
                runs, places, each = n, [], self.capacity // length
            else:
                room = self.rooms[k]
                runs, places = self.open[room].pop()
                if not self.open[room]:
                    self.rooms.pop(k)
                each = room // length
            full = min(runs, n // each)
            if full:
                self.add(full, places + [self.take(length, full) for _ in range(each)])
            else:
                self.add(1, places + [self.take(length, 1) for _ in range(n)])
                full = 1
            if places:
                self.add(runs - full, [(size, at + full) for size, at in places])

    def all(self) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        for room in self.rooms:
            yield from self.open[room]


def linear_groups(counts: dict[int, int], above: int, groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Lengths over `above`, longest first, in groups of equal cardinality: (rounded size, [(length, count)])."""
    lengths = [x for x in sorted(counts, reverse=True) if x > above]
    each = -(-sum(counts[x] for x in lengths) // groups) or 1
    out: list[tuple[int, list[tuple[int, int]]]] = []
    room = 0
    for length in lengths:
        n = counts[length]
        while n:
            if not room:
                out.append((length, []))
                room = each
            part = min(n, room)
            out[-1][1].append((length, part))
            n -= part
            room -= part
    return out


def _priced(sizes: list[int], prices: np.ndarray, capacity: int) -> tuple[float, list[int]]:
    """The configuration of most worth: a knapsack over the few sizes, one more piece a layer."""
    layers = [np.zeros(capacity + 1)]
    choices = []
    for _ in range(capacity // min(sizes)):
        best, choice = layers[-1].copy(), np.full(capacity + 1, -1)
        for k, (size, price) in enumerate(zip(sizes, prices)):
            worth = layers[-1][: capacity + 1 - size] + price
            better = worth > best[size:] + 1e-12
            best[size:][better] = worth[better]
            choice[size:][better] = k
        layers.append(best)
        choices.append(choice)
    config, c = [0] * len(sizes), capacity
    for choice in reversed(choices):
        k = int(choice[c])
        if k >= 0:
            config[k] += 1
            c -= sizes[k]
    return float(layers[-1][capacity]), config


def _times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Their product, without the linear algebra library, whose threads may hang in a process that has forked, as Spark's driver has."""
    return (matrix * vector).sum(axis=1)


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """The inverse, by elimination with row exchange."""
    n = len(matrix)
    both = np.concatenate((matrix, np.eye(n)), axis=1)
    for k in range(n):
        pivot = k + int(np.abs(both[k:, k]).argmax())
        both[[k, pivot]] = both[[pivot, k]]
        both[k] /= both[k, k]
        others = both[:, k].copy()
        others[k] = 0
        rows = np.flatnonzero(others)
        both[rows] -= others[rows, None] * both[k]
    return both[:, n:]


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 2000) -> list[tuple[int, list[int]]]:
    """(count, configuration) that hold at most the demand, from the linear program's optimum rounded down."""
    if not sizes:
        return []
    m = len(sizes)
    basis = [[capacity // s if j == k else 0 for j in range(m)] for k, s in enumerate(sizes)]
    inverse = np.diag([1.0 / (capacity // s) for s in sizes])
    x = _times(inverse, np.array(demand, float))
    for step in range(rounds):
        if step % 200 == 199:
            inverse = _inverse(np.array(basis, float).T)
            x = np.maximum(_times(inverse, np.array(demand, float)), 0)
        worth, config = _priced(sizes, np.maximum(inverse.sum(axis=0), 0), capacity)
        if worth <= 1 + 1e-7:
            break
        direction = _times(inverse, np.array(config, float))
        limits = np.where(direction > 1e-10, x / np.where(direction > 1e-10, direction, 1), np.inf)
        out = int(limits.argmin())
        x = x - limits[out] * direction
        x[out] = limits[out]
        row = inverse[out] / direction[out]
        inverse -= np.outer(direction, row)
        inverse[out] = row
        basis[out] = config
    left, chosen = list(demand), []
    for k in np.argsort(-x):
        config = basis[int(k)]
        n = min([int(x[k] + 1e-6), *(left[j] // a for j, a in enumerate(config) if a)])
        if n > 0:
            chosen.append((n, config))
            left = [b - n * a for b, a in zip(left, config)]
    return chosen


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> Runs:
    """Runs of sequences that hold every piece of these length counts once."""
    runs = Runs(counts, capacity)
    if full := counts.get(capacity):
        runs.add(full, [runs.take(capacity, full)])
    while True:
        grouped = linear_groups({k: n for k, n in runs.left.items() if n}, capacity // small, groups)
        chosen = configurations([size for size, _ in grouped], [sum(n for _, n in part) for _, part in grouped], capacity)
        if not chosen:
            break
        substitute(runs, chosen, [[list(x) for x in part] for _, part in grouped])
    for length in sorted(counts, reverse=True):
        runs.best_fit(length)
    return runs


def substitute(runs: Runs, chosen: list[tuple[int, list[int]]], parts: list[list[list[int]]]) -> None:
    """Add sequences of the chosen configurations with actual pieces, [length, how many are left] for each group, longest first."""
    for n, config in chosen:
        while n:
            # As many sequences as have one length in each place.
            wanted = [(j, parts[j][0], a) for j, a in enumerate(config) if a]
            whole = min([n, *(p[1] // a for _, p, a in wanted)])
            if whole:
                places = [runs.take(p[0], whole) for _, p, a in wanted for _ in range(a)]
                for _, p, a in wanted:
                    p[1] -= whole * a
                runs.add(whole, places)
            else:
                places, whole = [], 1
                for j, _, a in wanted:
                    for _ in range(a):
                        while not parts[j][0][1]:
                            parts[j].pop(0)
                        parts[j][0][1] -= 1
                        places.append(runs.take(parts[j][0][0], 1))
                runs.add(1, places)
            n -= whole
            for j, _, _ in wanted:
                while parts[j] and not parts[j][0][1]:
                    parts[j].pop(0)


def intervals(runs: Runs) -> dict[str, np.ndarray]:
    """The plan as intervals of piece numbers, sorted: first number, first sequence, offset."""
    at, sequence, offset, first = [], [], [], 0
    for n, places in runs.all():
        here = 0
        for length, start in places:
            at.append(start)
            sequence.append(first)
            offset.append(here)
            here += length
        first += n
    order = np.argsort(np.array(at, np.int64), kind="stable")
    return {k: np.array(v, np.int64)[order] for k, v in (("at", at), ("sequence", sequence), ("offset", offset))} | {"sequences": first}


# ---- the operator


def _place(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = held.value
        for batch in batches:
            number = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            k = np.searchsorted(found["at"], number, side="right") - 1
            sequence = found["sequence"][k] + number - found["at"][k]
            arrays = [*batch.columns[:-1], pa.array(sequence, pa.int64()), pa.array(found["offset"][k], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names[:-1], "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece of a document: where it was cut, its checksum, and its place in a sequence.

    with_ids also returns each piece's ids. Defined results: a null or empty
    text is the end id alone; repeated rows are packed each; an empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    pieces = stage_table(rows.mapInArrow(_pieces(tokenizer or default_tokenizer(), capacity, with_ids), schema), "pieces")
    # At most `capacity` rows.
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    held = spark.sparkContext.broadcast(intervals(plan(counts, capacity)))
    ordered, _ = numbered(pieces, ["length", "doc_id", "piece"])
    names = [x.strip().split(" ")[0] for x in schema.split(", ")]
    return ordered.select(*names, F.col("__row").cast("long")).mapInArrow(_place(held), f"{schema}, sequence_id long, offset long")


def packed_sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of pack_documents(..., with_ids=True): at most `capacity` ids each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))


def op1_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))
