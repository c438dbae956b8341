"""Secret scans by grammar inference.

1. Base spans: three patterns find labelled credentials in each whole text.
2. Sample: distinct labelled values of each kind, and ordinary runs of the same
   letters, at most FIT_VALUES each, the ones whose hashes are smallest.
3. Inference, one task a kind: the values form a prefix tree; states whose
   following symbols and ends don't differ by more than a Hoeffding bound are
   merged, most frequent first, into a probabilistic automaton.
4. Scores: every run of credential letters in the corpus is scored by how much
   likelier a kind's automaton makes it than that of ordinary runs. Runs that
   score at least half of what nearly all held-out labelled values reach become
   spans: rare unlabelled credentials are among the ordinary runs, too.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candela.llm.common import small_batches, stage_table, table, text_or_empty

# The patterns of the contract, and the characters that the patterns' values have at least.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

KINDS = ("assign", "access", "hex", "format")
PLAIN = "plain"
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
LEAST_RUN = 16
#: Values of each kind that are fitted, the longest of them, and the fewest for an automaton.
FIT_VALUES, FIT_SYMBOLS, LEAST_VALUES = 3_000, 128, 30
#: One in so many labelled values is kept out of the fit, for the threshold.
HELD_OUT = 3
#: All held-out values but this share reach a score; the threshold is half-way from even odds to it, and at least LEAST_SCORE (nats a symbol).
MISSED, LEAST_SCORE = 0.02, 0.3
#: The error probability of the bound that states are compared by.
ALPHA = 0.05
SYMBOLS, UNSEEN = 68, 0.05


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind's place, end, value) of the base patterns' matches, by start, then kind."""
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def other_runs(text: str, base: list[tuple[int, int, int, str]]) -> Iterator[tuple[int, int]]:
    """Runs of credential letters, without full stops at their ends, that no base span touches."""
    at = 0
    longest = 0
    for m in RUN.finditer(text):
        start, end = m.span()
        while start < end and text[start] == ".":
            start += 1
        while start < end and text[end - 1] == ".":
            end -= 1
        while at < len(base) and base[at][0] < end:
            longest = max(longest, base[at][2])
            at += 1
        if end - start >= LEAST_RUN and longest <= start:
            yield start, end


# ---- inference


@dataclass
class Automaton:
    """Per state the next state and log likelihood of each symbol, of an unseen symbol, and of an end."""

    step: list[dict[str, tuple[int, float]]]
    unseen: list[float]
    stop: list[float]

    def score(self, value: str) -> float:
        """Log likelihood; an unseen symbol leads back to the first state."""
        state, total, unseen = 0, 0.0, self.unseen
        for symbol in value:
            found = self.step[state].get(symbol)
            if found is None:
                total += unseen[state]
                state = 0
            else:
                total += found[1]
                state = found[0]
        return total + self.stop[state]


@dataclass
class Tree:
    """A prefix tree, and what merging makes of it: visits, ends, children and visits of each child by symbol."""

    visits: list[int] = field(default_factory=lambda: [0])
    ends: list[int] = field(default_factory=lambda: [0])
    child: list[dict[str, int]] = field(default_factory=lambda: [{}])
    flow: list[dict[str, int]] = field(default_factory=lambda: [{}])

    def add(self, value: str) -> None:
        at = 0
        self.visits[0] += 1
        for symbol in value:
            if symbol not in self.child[at]:
                self.child[at][symbol] = len(self.visits)
                self.visits.append(0)
                self.ends.append(0)
                self.child.append({})
                self.flow.append({})
            self.flow[at][symbol] = self.flow[at].get(symbol, 0) + 1
            at = self.child[at][symbol]
            self.visits[at] += 1
        self.ends[at] += 1

    def compatible(self, p: int, q: int, alpha: float) -> bool:
        """Whether no end and no symbol's share differs by more than the bound, in these states and those below q."""
        scale = math.sqrt(0.5 * math.log(2 / alpha))
        stack = [(p, q)]
        while stack:
            p, q = stack.pop()
            n, m = self.visits[p], self.visits[q]
            bound = scale * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.ends[p] / n - self.ends[q] / m) > bound:
                return False
            for symbol in self.flow[p].keys() | self.flow[q].keys():
                if abs(self.flow[p].get(symbol, 0) / n - self.flow[q].get(symbol, 0) / m) > bound:
                    return False
            stack += [(self.child[p][s], below) for s, below in self.child[q].items() if s in self.child[p]]
        return True

    def fold(self, p: int, q: int) -> None:
        """Add the tree below q to p."""
        stack = [(p, q)]
        while stack:
            p, q = stack.pop()
            self.visits[p] += self.visits[q]
            self.ends[p] += self.ends[q]
            for symbol, below in self.child[q].items():
                self.flow[p][symbol] = self.flow[p].get(symbol, 0) + self.flow[q][symbol]
                if symbol in self.child[p]:
                    stack.append((self.child[p][symbol], below))
                else:
                    self.child[p][symbol] = below


def infer(values: list[str], alpha: float = ALPHA) -> Automaton:
    """The automaton of these values: each state of the prefix tree's border merges with the first that it is compatible with, or stays."""
    tree = Tree()
    for value in values:
        tree.add(value)
    kept = [0]
    while True:
        known = set(kept)
        border = [(-tree.visits[c], p, s, c) for p in kept for s, c in tree.child[p].items() if c not in known]
        if not border:
            break
        _, p, symbol, q = min(border)
        for r in kept:
            if tree.compatible(r, q, alpha):
                tree.child[p][symbol] = r
                tree.fold(r, q)
                break
        else:
            kept.append(q)
    number = {state: k for k, state in enumerate(kept)}
    rest = UNSEEN * (SYMBOLS + 1)
    return Automaton(
        [{s: (number[tree.child[k][s]], math.log((n + UNSEEN) / (tree.visits[k] + rest))) for s, n in tree.flow[k].items()} for k in kept],
        [math.log(UNSEEN / (tree.visits[k] + rest)) for k in kept],
        [math.log((tree.ends[k] + UNSEEN) / (tree.visits[k] + rest)) for k in kept],
    )


# ---- the corpus


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as (kind, value): labelled credentials and ordinary runs that can be fitted."""
    for batch in small_batches(batches):
        out: set[tuple[str, str]] = set()
        for text in batch.column(0).to_pylist():
            base = base_spans(text)
            out.update((KINDS[k], value) for _, k, _, value in base if len(value) <= FIT_SYMBOLS)
            out.update((PLAIN, text[s:e]) for s, e in other_runs(text, base) if e - s <= FIT_SYMBOLS)
        kinds, values = zip(*sorted(out)) if out else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string())], ["kind", "value"])


def _inferred(alpha: float):
    def run(own):
        import pandas as pd

        values = sorted(own["value"])
        held = [v for v in values if hashlib.sha256(v.encode()).digest()[0] % HELD_OUT == 0]
        fitted = sorted(set(values) - set(held)) or values
        payload = pickle.dumps(infer(fitted, alpha), pickle.HIGHEST_PROTOCOL)
        return pd.DataFrame({"kind": [own["kind"].iloc[0]], "n": [len(values)], "payload": [payload], "held": [held or values]})

    return run


@dataclass
class Formats:
    """The automaton of ordinary runs, and of each kind with its threshold."""

    plain: Automaton
    kinds: dict[str, tuple[Automaton, float]]

    def ratio(self, own: Automaton, value: str, plain: float) -> float:
        return (own.score(value) - plain) / (len(value) + 1)

    def best(self, value: str) -> tuple[str, float] | None:
        """The kind whose automaton fits best, and by how much, if that reaches the kind's threshold."""
        plain = self.plain.score(value)
        scores = [(self.ratio(own, value, plain), kind, least) for kind, (own, least) in self.kinds.items()]
        return max(((kind, score) for score, kind, least in scores if score >= least), key=lambda x: (x[1], x[0]), default=None)


def learn_formats(docs: DataFrame, text_col: str = "text", fit_values: int = FIT_VALUES, alpha: float = ALPHA) -> Formats:
    """Automata of the labelled credentials in docs, from at most fit_values distinct values of each kind.

    A kind with fewer than LEAST_VALUES has none; without ordinary runs any
    symbol is as likely as another.
    """
    found = docs.select(text_or_empty(text_col).alias("text")).mapInArrow(_values, "kind string, value string").distinct()
    found = stage_table(found, "values")
    sample = None
    for kind in (*KINDS[:3], PLAIN):
        own = found.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(fit_values)
        sample = own if sample is None else sample.unionByName(own)
    fitted = sample.groupBy("kind").applyInPandas(_inferred(alpha), "kind string, n long, payload binary, held array<string>").collect()
    automata = {r["kind"]: (pickle.loads(bytes(r["payload"])), list(r["held"])) for r in fitted if r["kind"] == PLAIN or r["n"] >= LEAST_VALUES}
    even = math.log(1 / (SYMBOLS + 1))
    formats = Formats(automata.pop(PLAIN, (Automaton([{}], [even], [even]), []))[0], {})
    for kind, (own, held) in sorted(automata.items()):
        scores = sorted(formats.ratio(own, v, formats.plain.score(v)) for v in held)
        formats.kinds[kind] = own, max(LEAST_SCORE, scores[int(MISSED * len(scores))] / 2)
    return formats


SPAN = pa.struct([("kind", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("format", pa.string()), ("score", pa.float64())])
SPANS_SQL = "array<struct<kind: string, first: long, end: long, format: string, score: double>>"


def spans_of(text: str, formats: Formats) -> list[dict]:
    """All spans of a text, by start, then kind as listed."""
    base = base_spans(text)
    found = [(start, kind, end, KINDS[kind], None) for start, kind, end, _ in base]
    for start, end in other_runs(text, base):
        best = formats.best(text[start:end])
        if best:
            found.append((start, 3, end, *best))
    return [{"kind": KINDS[k], "first": s, "end": e, "format": of, "score": score} for s, k, e, of, score in sorted(found, key=lambda x: x[:3])]


def _scanned(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        formats = pickle.loads(sent.value)
        for batch in small_batches(batches):
            spans = [spans_of(text, formats) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(SPAN))], ["doc_id", "spans"])

    return run


def find_secrets(docs: DataFrame, formats: Formats | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) of each row of docs; places are code points, ends exclusive.

    A base span's kind is that of its pattern; spans that the automata add have
    the kind 'format', the labelled kind they look like and their score. They
    touch no base span.

    Defined results: null and empty texts have no spans; repeated rows are
    scanned each; null ids stay; an empty table gives none.
    """
    # Automata of at most four samples.
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(formats or learn_formats(docs, text_col), pickle.HIGHEST_PROTOCOL))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(_scanned(sent), f"doc_id long, spans {SPANS_SQL}")


def redacted(text: str, spans: list[dict], mark: str) -> str:
    """The text with mark for each stretch that spans cover."""
    out, at = [], 0
    for s in spans:
        if s["end"] <= at:
            continue
        if s["first"] >= at:
            out += [text[at : s["first"]], mark]
        at = s["end"]
    return "".join(out) + text[at:]


def _redacted(sent, column: int, mark: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        formats = pickle.loads(sent.value)
        for batch in small_batches(batches):
            texts = [t if t is None else redacted(t, spans_of(t, formats), mark) for t in batch.column(column).to_pylist()]
            columns = [pa.array(texts, pa.string()) if k == column else batch.column(k) for k in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return run


def redact_secrets(docs: DataFrame, formats: Formats | None = None, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with mark in place of each secret; stretches that several spans cover are one; a null text stays."""
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(formats or learn_formats(docs, text_col), pickle.HIGHEST_PROTOCOL))
    return docs.mapInArrow(_redacted(sent, docs.columns.index(text_col), mark), docs.schema)


def op11_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["first"], s["end"])), ",")
    of_kind = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [of_kind(kind) for kind in KINDS[:3]]
    base = F.sha2(joined(F.filter("spans", lambda s: s["kind"] != KINDS[3])), 256).alias("base_sha256")
    return found.select("doc_id", *counts, base, joined(F.col("spans")).alias("spans"))
