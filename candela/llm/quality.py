"""Document quality by Bradley-Terry pairwise ranking.

A document's worth is linear in features of its text. A pair of a good and a
bad labelled document is a preference; the chance that the good one wins is the
logistic function of the difference of their worths, so weights are learned by
the logistic loss on feature differences. Every labelled document is in a pair.
The score is the worth on a logistic scale whose threshold sits at the quantile
of all labelled documents' worths that leaves out the labelled share of bad ones.

Labelled documents' features are staged; tasks send sums of them to the driver.

Features come from whole texts, in Arrow batches inside the scan.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candela.llm.common import small_batches, split_by_ids, stage_table, table, text_or_empty

#: Labelled rows of one block, within which preference pairs are made, and how many of the rarer label a block is to have.
BLOCK, RARER = 4_000, 50
#: Bins of a pass that looks for a quantile.
BINS = 4_096
THRESHOLD = 0.7

NAMES = [
    "log_words", "log_chars", "mean_word", "long_word", "unique_share", "top_word", "top_bigram", "upper_share", "symbol_share", "digit_share",
    "space_share", "lines_per_word", "repeated_lines", "repeated_line_chars", "pipe_words", "bang_words", "tail_symbols", "sentence_ends",
    "short_words", "capital_words", "adjacent_repeats", "inner_symbols", "unique_four", "compressed",
]

_CLASS = np.zeros(256, np.uint8)
_CLASS[list(range(65, 91))] = 1  # upper
_CLASS[list(range(97, 123)) + list(range(128, 256))] = 2  # other letters
_CLASS[list(range(48, 58))] = 3
_CLASS[[32, 9, 10, 11, 12, 13]] = 4


def compressed_size(raw: bytes, chunk: int = 1 << 16) -> int:
    """Bytes of the whole text when compressed, of which a chunk's are held at a time."""
    z = zlib.compressobj(1)
    return sum(len(z.compress(raw[k : k + chunk])) for k in range(0, len(raw), chunk)) + len(z.flush())


def features(text: str) -> list[float]:
    """The feature vector of a whole text; an empty one gives zeros."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = len(words), len(raw)
    if not n:
        return [0.0] * len(NAMES)
    kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=5)
    upper, lower, digits, spaces = int(kinds[1]), int(kinds[2]), int(kinds[3]), int(kinds[4])
    symbols = int(kinds[0])
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lengths = np.fromiter(map(len, words), np.int64, n)
    pairs: dict[tuple, int] = {}
    for p in zip(words, words[1:]):
        pairs[p] = pairs.get(p, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    seen: set[bytes] = set()
    twice = twice_chars = 0
    for x in lines:
        if x in seen:
            twice += 1
            twice_chars += len(x)
        seen.add(x)
    marks = raw.translate(None, _LETTERS_ETC)
    return [
        np.log1p(n), np.log1p(size), float(lengths.mean()), float((lengths > 15).mean()), len(counts) / n, max(counts.values()) / n,
        max(pairs.values(), default=0) / n, upper / max(1, upper + lower), symbols / size, digits / size, spaces / size, len(lines) / n,
        twice / len(lines), twice_chars / size, words.count(b"|") / n, raw.count(b"!") / n, sum(1 for w in words if w[-1] in _ODD) / n,
        (raw.count(b". ") + raw.count(b".\n") + raw.endswith(b".")) / n, float((lengths <= 3).mean()), sum(1 for w in words if 65 <= w[0] <= 90) / n,
        sum(1 for a, b in zip(words, words[1:]) if a == b) / n, len(marks) / size, len(set(zip(words, words[1:], words[2:], words[3:]))) / n,
        compressed_size(raw) / size,
    ]


_ODD = frozenset(b"*$&%#@^~<>{}|=+_\\!")
_LETTERS_ETC = bytes([c for c in range(256) if _CLASS[c] or c in b".,;:!?'\"-()"])


def matrix(texts: list[str]) -> np.ndarray:
    """One row of features for each text."""
    return np.array([features(t) for t in texts], np.float64).reshape(len(texts), len(NAMES))


@dataclass
class Ranking:
    """A fitted ranking: how features are scaled, their weights, and the score's scale."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    middle: float
    slope: float

    def worth(self, x: np.ndarray) -> np.ndarray:
        return _terms((x - self.mean) / self.spread) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.worth(x) - self.middle) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _terms(z: np.ndarray) -> np.ndarray:
    """Scaled features and their squares, both held within four spreads."""
    z = np.clip(z, -4, 4)
    return np.concatenate((z, z * z), axis=1)


def _differences(terms: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Good minus bad terms of pairs in which each row of either label is at least once."""
    better, worse = terms[good == 1], terms[good == 0]
    n = max(len(better), len(worse)) if len(better) and len(worse) else 0
    k = np.arange(n)
    return better[k % max(1, len(better))] - worse[k % max(1, len(worse))]


def _slopes(diff: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Number of pairs, gradient and curvature of their logistic loss, as one vector of sums."""
    lost = 1 / (1 + np.exp(np.clip(diff @ weights, -500, 500)))
    return np.concatenate(([len(diff)], -(diff * lost[:, None]).sum(axis=0), ((diff * (lost * (1 - lost))[:, None]).T @ diff).ravel()))


def _newton(sums, size: int, steps: int = 25, decay: float = 1e-3) -> np.ndarray:
    """Weights of least mean logistic loss with weight decay; sums(weights) gives _slopes over all pairs."""
    weights = np.zeros(size)
    for _ in range(steps):
        total = sums(weights)
        if not total[0]:
            break
        slope = total[1 : size + 1] / total[0] + decay * weights
        curve = total[size + 1 :].reshape(size, size) / total[0] + decay * np.eye(size)
        step = np.linalg.solve(curve, slope)
        # A long step is cut, as the loss is no parabola far from its least point.
        weights -= step * min(1.0, 5 / max(1e-12, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-6:
            break
    return weights


def fit(x: np.ndarray, good: np.ndarray) -> Ranking:
    """The ranking learned from all rows of one block."""
    if not len(x):
        return Ranking(np.zeros(len(NAMES)), np.ones(len(NAMES)), np.zeros(2 * len(NAMES)), 0.0, 1.0)
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    terms = _terms((x - mean) / spread)
    diff = _differences(terms, good)
    weights = _newton(lambda w: _slopes(diff, w), terms.shape[1])
    return Ranking(mean, spread, weights, float(np.quantile(terms @ weights, (good == 0).mean())), 1.0)


def labelled_features(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, quality, x): features and labels of all rows that may be learned from, staged.

    Rows whose crc32 of the id is 2 modulo 4 are held out. Texts are read where
    they lie; only features are moved to their labels.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("quality"))
    marks = marks.where("quality in (0, 1) and id is not null").groupBy("id").agg(F.min("quality").alias("quality"))
    marks = marks.where(F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(4)) != 2)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    chosen = split_by_ids(rows, marks.select("id"), "id")[1].select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            x = matrix(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x.tolist(), pa.list_(pa.float64()))], ["id", "x"])

    return stage_table(chosen.mapInArrow(run, "id long, x array<double>").join(marks, "id").select("id", "quality", "x"), "labelled")


def _vectors(column) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64).reshape(len(column), -1)


def _summed(rows: DataFrame, of) -> np.ndarray | None:
    """The sum of `of(batch)`, a vector, over all Arrow batches of rows; each task sends one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = of(batch)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["v"])

    # In a fixed order, so that a sum is the same on each run.
    parts = sorted(rows.mapInArrow(run, "v array<double>").toArrow().column(0).to_pylist())
    return np.sum(np.array(parts), axis=0) if parts else None


def _order_statistic(worths: DataFrame, low: float, high: float, rank: int) -> float:
    """The value with this many smaller or earlier ones among all worths, by counts in ever narrower bins."""
    below = 0
    while True:
        edges = np.linspace(low, high, BINS + 1)
        if not (np.diff(edges) > 0).all():
            return float(low)
        inside = worths.where((F.col("w") >= float(low)) & (F.col("w") <= float(high)))
        counts = _summed(inside, lambda b, e=edges: np.histogram(b.column(0).to_numpy(), e)[0].astype(np.float64))
        at = int(np.searchsorted(below + np.cumsum(counts), rank, side="right"))
        below += int(counts[:at].sum())
        low, high, last = edges[at], edges[at + 1], at == BINS - 1
        if counts[at] <= BINS:
            end = F.col("w") <= float(high) if last else F.col("w") < float(high)
            own = np.sort(worths.where((F.col("w") >= float(low)) & end).toArrow().column(0).to_numpy())
            return float(own[rank - below])
        if not last:
            high = float(np.nextafter(high, -np.inf))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Ranking:
    """The ranking learned from all labelled rows of docs that aren't held out."""
    rows = labelled_features(docs, labels, id_col, text_col)
    size = len(NAMES)

    def counted(batch: pa.RecordBatch) -> np.ndarray:
        good = batch.column(1).to_numpy()
        return np.concatenate(([len(good), good.sum()], _vectors(batch.column(2)).sum(axis=0)))

    total = _summed(rows, counted)
    if total is None:
        return fit(np.zeros((0, size)), np.zeros(0, np.int64))
    n, better = int(total[0]), int(total[1])
    mean = total[2:] / n
    spread = np.sqrt(_summed(rows, lambda b: ((_vectors(b.column(2)) - mean) ** 2).sum(axis=0)) / n) + 1e-6
    # Rows are dealt to blocks; the rarer label's go to several where there are too few for all.
    blocks = -(-n // BLOCK)
    rare = min(better, n - better)
    copies = min(blocks, max(1, -(-RARER * blocks // max(1, rare))))
    scarce = F.col("quality") == int(better <= n - better)
    shifts = F.when(scarce, F.array(*[F.lit(k * blocks // copies) for k in range(copies)]) if copies < 1_000 else F.sequence(F.lit(0), F.lit(blocks - 1))).otherwise(F.array(F.lit(0)))
    dealt = rows.withColumn("shift", F.explode(shifts)).withColumn("block", F.pmod(F.xxhash64("id") + F.col("shift"), F.lit(blocks))).drop("shift")

    def paired(block: pa.Table) -> pa.Table:
        block = block.sort_by([("id", "ascending")])
        diff = _differences(_terms((_vectors(block.column("x")) - mean) / spread), block.column("quality").to_numpy())
        return pa.table({"d": pa.array(diff.tolist(), pa.list_(pa.float64()))})

    pairs = stage_table(dealt.groupBy("block").applyInArrow(paired, "d array<double>"), "preferences")
    none = np.zeros(1 + 2 * size + 4 * size * size)

    def slopes(weights: np.ndarray) -> np.ndarray:
        found = _summed(pairs, lambda b: _slopes(_vectors(b.column(0)), weights))
        return none if found is None else found

    ranking = Ranking(mean, spread, _newton(slopes, 2 * size), 0.0, 1.0)

    def worth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(ranking.worth(_vectors(batch.column(2))) if batch.num_rows else [], pa.float64())], ["w"])

    worths = stage_table(rows.mapInArrow(worth, "w double"), "worths")
    low, high = worths.agg(F.min("w"), F.max("w")).first()
    place = (n - better) / n * (n - 1)
    at = min(n - 1, int(place))
    lower = _order_statistic(worths, low, high, at)
    upper = _order_statistic(worths, low, high, min(n - 1, at + 1))
    ranking.middle = lower + (upper - lower) * (place - at)
    return ranking


def score_quality(docs: DataFrame, ranking: Ranking, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row.

    Defined results: null and empty texts have a score, that of a text without
    features; a null id isn't held out; repeated rows are scored each.
    """
    held = docs.sparkSession.sparkContext.broadcast(ranking)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            score = held.value.scores(matrix(batch.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], ["doc_id", "held_out", "score"])

    out_of_fit = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), out_of_fit.alias("held_out"), text_or_empty(text_col).alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_poor(docs: DataFrame, ranking: Ranking, text_col: str = "text") -> DataFrame:
    """The rows of docs that reach the threshold, with all their columns, in one pass without a shuffle."""
    held, at = docs.sparkSession.sparkContext.broadcast(ranking), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            yield batch.filter(pa.array(held.value.scores(matrix([t or "" for t in batch.column(at).to_pylist()])) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of all documents."""
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train(docs, table(spark, sf_dir, "labels")))
