"""Toxicity by cumulative-link ordinal regression on sparse text features.

Features are words and word beginnings that labelled toxic rows have
significantly more often than others; a text's features are which of them it
has and how often any occurs. Labels only tell toxic from clean, so severity
grades are 0 for rows labelled clean and 1 to 3 for toxic ones, by thirds of how
often marker words occur. The markers that grade a row are those of the other
half of the labelled rows, so no row's grade comes from a list that it, or the
model's own features, took part in.

P(grade > k) = logistic(w.x - t_k). One weight vector is shared by the ordered
thresholds t_0 < t_1 < t_2; weights and thresholds are learned together by the
ordinal likelihood, in time linear in the features that rows have.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.llm.common import small_batches, stage_table, table, text_or_empty

#: Most labelled rows of either label that the fit sees, those with the smallest hashes of their ids.
FIT_ROWS = 5_000
GRADES = 3
#: Letters of a word's beginnings that are features beside the word.
STARTS = (5, 6, 7)
#: Toxic rows that must have a feature, the least lower bound of its log odds ratio, and how many standard errors lower that is.
LEAST_ROWS, LEAST_ODDS, SIGMAS = 4, 1.0, 2.33
#: Features whose counts a task holds before it passes them on.
HELD = 200_000

_WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[str]:
    """A word's features: itself and its beginnings."""
    return [word, *(f"{word[:n]}*" for n in STARTS if len(word) >= n)]


def text_words(text: str) -> Counter:
    """How often each word is in the whole text, lower-cased."""
    return Counter(_WORD.findall(text.lower()))


@dataclass
class Rows:
    """Sparse rows: for each entry its row and feature, and per row the logarithm of how many words have a feature."""

    row: np.ndarray
    feature: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, has: list[list[int]], times: list[float]) -> Rows:
        sizes = np.fromiter(map(len, has), np.int64, len(has))
        return cls(np.repeat(np.arange(len(has)), sizes), np.array([k for h in has for k in h], np.int64), np.array(times, float))

    def dot(self, weights: np.ndarray) -> np.ndarray:
        """Each row's sum of weights; the last weight is that of times."""
        return np.bincount(self.row, weights[self.feature], len(self.times)) + weights[-1] * self.times

    def back(self, values: np.ndarray, width: int) -> np.ndarray:
        """Each feature's sum of its rows' values."""
        out = np.bincount(self.feature, values[self.row], width).astype(float)
        out[-1] += values @ self.times
        return out


@dataclass
class Severity:
    """A fitted model: kept features by number, weights with the count's last, ordered thresholds, the cut of P(grade > k)."""

    number: dict[str, int]
    weights: np.ndarray
    limits: np.ndarray
    cut: float = 0.5

    def rows(self, texts: list[str]) -> Rows:
        """The features of whole texts."""
        cache: dict[str, list[int]] = {}
        get = self.number.get
        has, times = [], []
        for text in texts:
            own: set[int] = set()
            n = 0
            for word, k in text_words(text).items():
                got = cache.get(word)
                if got is None:
                    got = cache[word] = [x for f in word_features(word) if (x := get(f)) is not None]
                if got:
                    own.update(got)
                    n += k
            has.append(sorted(own))
            times.append(float(np.log1p(n)))
        return Rows.of(has, times)

    def chances(self, rows: Rows) -> np.ndarray:
        """P(grade > k) for each row and threshold."""
        return logistic(rows.dot(self.weights)[:, None] - self.limits[None, :])


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def ordinal_loss(values: np.ndarray, rows: Rows, grade: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Minus the log likelihood of the grades and its slope.

    values: the weights, the first threshold, and the logarithms of the steps
    to the others, so thresholds are in order whatever the values.
    """
    width = len(values) - GRADES
    weights, steps = values[:width], np.exp(values[width + 1 :])
    limits = values[width] + np.concatenate(([0], np.cumsum(steps)))
    z = rows.dot(weights)
    above, below = grade > 0, grade < GRADES
    # P(grade) = logistic(u) - logistic(v): u is what lies over the threshold below the grade, v over that above it.
    u = np.where(above, z - limits[np.maximum(grade, 1) - 1], np.inf)
    v = np.where(below, z - limits[np.minimum(grade, GRADES - 1)], -np.inf)
    between = above & below
    gap = steps[grade[between] - 1]
    loss = np.logaddexp(0, -u[above]).sum() + np.logaddexp(0, v[below]).sum() - np.log(-np.expm1(-gap)).sum()
    over, under = np.where(above, 1 - logistic(u), 0), np.where(below, logistic(v), 0)
    slope = np.zeros_like(values)
    slope[:width] = rows.back(under - over, width)
    on_limit = np.bincount(grade[above] - 1, over[above], GRADES) - np.bincount(grade[below], under[below], GRADES)
    slope[width] = on_limit.sum()
    for k in range(1, GRADES):
        slope[width + k] = steps[k - 1] * (on_limit[k:].sum() - (1 / np.expm1(gap[grade[between] == k])).sum())
    slope[:width] += ridge * weights
    return float(loss + ridge / 2 * weights @ weights), slope


def minimum(f: Callable, x: np.ndarray, steps: int = 200, memory: int = 10, enough: float = 1e-4) -> np.ndarray:
    """Where f, which gives value and slope, is smallest: limited-memory quasi-Newton steps with backtracking."""
    value, slope = f(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        if np.abs(slope).max(initial=0) < enough:
            break
        move, used = -slope, []
        for s, y, r in reversed(past):
            a = r * (s @ move)
            used.append(a)
            move = move - a * y
        if past:
            s, y, _ = past[-1]
            move = move * ((s @ y) / (y @ y))
        else:
            move = move / max(1.0, np.abs(move).max())
        for (s, y, r), a in zip(past, reversed(used)):
            move = move + s * (a - r * (y @ move))
        down, length = slope @ move, 1.0
        for _ in range(40):
            new_value, new_slope = f(x + length * move)
            if new_value <= value + 1e-4 * length * down:
                break
            length /= 2
        else:
            break
        s, y = length * move, new_slope - slope
        if s @ y > 1e-10:
            past = [*past[-memory + 1 :], (s, y, 1 / (s @ y))]
        x, value, slope = x + s, new_value, new_slope
    return x


def fit_rows(number: dict[str, int], rows: Rows, grade: np.ndarray, ridge: float = 1.0) -> Severity:
    """The model with the largest ordinal likelihood of these rows' grades, weights held small."""
    width = len(number) + 1
    start = np.zeros(width + GRADES)
    share = (grade > 0).mean() if len(grade) else 0.5
    start[width] = np.log((1 - share + 1e-6) / (share + 1e-6))
    values = minimum(lambda v: ordinal_loss(v, rows, grade, ridge), start) if len(grade) else start
    model = Severity(number, values[:width], values[width] + np.concatenate(([0], np.cumsum(np.exp(values[width + 1 :])))))
    model.cut = best_cut(model.chances(rows)[:, 0], grade > 0)
    return model


def best_cut(chance: np.ndarray, toxic: np.ndarray) -> float:
    """The cut of P(grade > 0) with the best F1 on the fitted rows; one half where there are no toxic ones."""
    if not toxic.any():
        return 0.5
    order = np.argsort(-chance, kind="stable")
    hits = np.cumsum(toxic[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + hits[-1])
    f1[:-1][chance[order][:-1] == chance[order][1:]] = 0  # a cut can't part equal chances
    k = int(f1.argmax())
    below = chance[order][k + 1] if k + 1 < len(order) else 0.0
    return float((chance[order][k] + below) / 2)


def grades_of(toxic: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """0 for clean rows, 1 to 3 for toxic ones by thirds of their marks."""
    if not (toxic == 1).any():
        return np.zeros(len(toxic), np.int64)
    thirds = np.quantile(marks[toxic == 1], [1 / 3, 2 / 3])
    return np.where(toxic == 1, 1 + (marks > thirds[0]) + (marks > thirds[1]), 0).astype(np.int64)


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, rows of each half and label) of rows (half, toxic, id, text), summed as far as a task goes."""
    seen: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0, 0])

    def told() -> pa.RecordBatch:
        columns = [pa.array(list(seen), pa.string()), *(pa.array([v[k] for v in seen.values()], pa.int64()) for k in range(4))]
        seen.clear()
        return pa.RecordBatch.from_arrays(columns, ["feature", "b0", "a0", "b1", "a1"])

    for batch in small_batches(batches, 100):
        for half, toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
            for f in {f for w in text_words(text) for f in word_features(w)}:
                seen[f][2 * half + toxic] += 1
            if len(seen) > HELD:
                yield told()
    yield told()


def significant(a: Column, b: Column, n_toxic: Column, n_clean: Column) -> Column:
    """Whether a of the toxic and b of the clean rows tell that toxic rows have a feature more often."""
    odds = F.log((a + 0.5) / (n_toxic - a + 0.5)) - F.log((b + 0.5) / (n_clean - b + 0.5))
    least = odds - SIGMAS * F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    return (a >= LEAST_ROWS) & (least >= LEAST_ODDS)


def feature_lists(sample: DataFrame) -> tuple[list[str], list[set[str]]]:
    """The model's features, and each half's marker words, of rows (half, toxic, id, text)."""
    n = {(r["half"], r["toxic"]): r["n"] for r in sample.groupBy("half", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = [[F.lit(n.get((half, toxic), 0)) for toxic in (0, 1)] for half in (0, 1)]
    counts = sample.mapInArrow(_feature_counts, "feature string, b0 long, a0 long, b1 long, a1 long")
    sums = counts.groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("b0", "a0", "b1", "a1")])
    whole = significant(F.col("a0") + F.col("a1"), F.col("b0") + F.col("b1"), rows[0][1] + rows[1][1], rows[0][0] + rows[1][0])
    word = ~F.col("feature").endswith("*")
    marks = [word & significant(F.col(f"a{h}"), F.col(f"b{h}"), rows[h][1], rows[h][0]) for h in (0, 1)]
    # Features that pass: fewer than the words of the bounded sample over LEAST_ROWS; in practice some hundreds.
    got = sums.select("feature", whole.alias("whole"), marks[0].alias("m0"), marks[1].alias("m1")).where("whole or m0 or m1").collect()
    return sorted(r["feature"] for r in got if r["whole"]), [{r["feature"] for r in got if r[f"m{h}"]} for h in (0, 1)]


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, limit: int) -> DataFrame:
    """(half, toxic, id, text), staged, of at most `limit` labelled rows of either label; rows with crc32(id) mod 4 = 2 are held out."""
    marks = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"))
    marks = marks.where("toxic in (0, 1) and id is not null").groupBy("id").agg(F.max("toxic").alias("toxic"))
    marks = marks.where(F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(4)) != 2).withColumn("h", F.xxhash64("id"))
    part = [marks.where(F.col("toxic") == k).orderBy("h", "id").limit(limit).select("id", "toxic") for k in (0, 1)]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    half = F.pmod(F.shiftright(F.xxhash64("id"), 7), F.lit(2)).cast("int")
    # At most 2 * limit rows of two numbers are broadcast.
    return stage_table(rows.join(F.broadcast(part[0].unionByName(part[1])), "id").select(half.alias("half"), "toxic", "id", "text"), "sample")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = FIT_ROWS) -> Severity:
    """The model learned from a bounded sample of the labelled rows.

    Features are counted and chosen in Spark; what comes to the driver is, per
    sample row, the numbers of its features. Defined results: labels of a null
    id or other than 0 and 1 are left out; of repeated labels the larger counts.
    """
    sample = training_sample(docs, labels, id_col, text_col, limit)
    names, markers = feature_lists(sample)
    model = Severity({f: k for k, f in enumerate(names)}, np.zeros(len(names) + 1), np.arange(GRADES, dtype=float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = batch.column(3).to_pylist()
            rows = model.rows(texts)
            has = np.split(rows.feature, np.cumsum(np.bincount(rows.row, minlength=len(texts)))[:-1])
            marks = [sum(n for w, n in text_words(t).items() if w in markers[1 - half]) for half, t in zip(batch.column(0).to_pylist(), texts)]
            columns = [batch.column(2), batch.column(1), pa.array([h.tolist() for h in has], pa.list_(pa.int32())), pa.array(rows.times), pa.array(marks, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "toxic", "has", "times", "marks"])

    got = sample.mapInArrow(run, "id long, toxic int, has array<int>, times double, marks long").toArrow().to_pylist()
    got.sort(key=lambda r: (r["id"], r["has"], r["times"]))
    toxic, marks = (np.array([r[c] for r in got], np.int64) for c in ("toxic", "marks"))
    return fit_rows(model.number, Rows.of([r["has"] for r in got], [r["times"] for r in got]), grades_of(toxic, marks))


def score_toxicity(docs: DataFrame, model: Severity, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, severity, grade, p_toxic, toxic) for each row; severity is the expected grade, 0 to 3.

    grade is how many of the P(grade > k) reach the model's cut; toxic is a
    grade over 0. Defined results: null and empty texts have no features and so
    the least severity; repeated rows are scored each; an empty table gives an
    empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            p = held.value.chances(held.value.rows(batch.column(1).to_pylist()))
            grade = pa.array((p >= held.value.cut).sum(axis=1), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p.sum(axis=1)), grade, pa.array(p[:, 0])], ["doc_id", "severity", "grade", "p_toxic"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, severity double, grade int, p_toxic double").withColumn("toxic", F.col("grade") > 0)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """Severity of all documents."""
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
