"""Cross-tokenizer alignment by merge-path partitioning of two tokenizers' token ends.

1. Tokens: each text is encoded by both tokenizers; where the tokens' bytes are
   the text's, the byte offsets at which A's and B's tokens end are two sorted
   lists over one range.
2. Pieces: diagonal binary searches cut the merging of both lists into pieces of
   equal work, whatever the text; each carries the tokens it consumes, the ones
   then open, and its offsets, so it is merged without any other piece.
   Pieces are rows of a staged table, which Spark deals out anew.
3. Overlaps: a piece emits a link for each interval between neighbouring ends,
   and counts of the id pairs of documents; Spark adds the counts up.
4. Scores: the counts go out in blocks of bounded size, one pass over the pieces
   for each PASS_PAIRS pairs, and each piece looks its links up.
5. Stitching: a document of several pieces is folded in their order: a group
   that is open at a piece's end goes on in the next one.

Both tokenizers merge within stretches that begin at a space after another
character, so stretches are encoded apart and frequent ones are remembered.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candela.llm.common import small_batches, stage_table, table, text_or_empty
from candela.llm.packing import default_tokenizer, encoder

#: Ends that one piece merges.
PIECE = 1 << 16
#: Id pairs of one pass over the pieces: 17 bytes each.
PASS_PAIRS = 6_000_000
#: Stretches that a worker remembers; all are forgotten after a batch with so many characters of new ones.
REMEMBERED, REMEMBERED_CHARS = 400_000, 4_000_000
SPACE = "▁"


def default_pieces() -> str:
    """The place of the 32k sentence-piece model."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


# ---- tokens


#: Places where white space on both sides of a space, or a space next to one, forbids to cut at each space.
_DENSE = re.compile(r"  | \Z|[^\S ] [^\S ]")
#: From a space after a character that is no white space, up to the next such place.
_STRETCH = re.compile(r"\s+\S+(?:[^\S ]\s*\S+)*(?:\s+\Z)?")


class Tokenizer:
    """One tokenizer: ids of a space and a text, and the bytes of each token."""

    def __init__(self, encode, token_bytes: list[bytes], kind: np.dtype):
        self.encode, self.token_bytes, self.kind = encode, token_bytes, kind
        self.size = np.array([len(x) for x in token_bytes])
        #: Ids of a space and a stretch, as bytes, by stretch.
        self.known: dict[str, bytes] = {}

    def ids(self, text: str) -> np.ndarray | None:
        """Ids of a space and the text, None where the tokens' bytes differ from it."""
        ids = np.asarray(self.encode(text), self.kind)
        return ids if b"".join([self.token_bytes[k] for k in ids.tolist()]) == (" " + text).encode("utf-8", "surrogatepass") else None

    def learn(self, stretches: list[str]) -> bool:
        """Encode stretches in one text, cut again where they end; whether that could be done."""
        ids = self.ids(" ".join(stretches))
        if ids is None:
            return False
        ends = np.cumsum(self.size[ids])
        wanted = np.cumsum([len(s.encode("utf-8", "surrogatepass")) + 1 for s in stretches])
        at = np.searchsorted(ends, wanted)
        if not np.array_equal(ends[at], wanted):
            return False
        at = (np.concatenate(([0], at + 1)) * self.kind.itemsize).tolist()
        held = ids.tobytes()
        self.known.update((s, held[i:j]) for s, i, j in zip(stretches, at, at[1:]))
        return True


@dataclass
class Pair:
    """Both tokenizers, and whether stretches may be encoded apart."""

    a: Tokenizer
    b: Tokenizer
    cut: bool

    @property
    def kind(self) -> np.dtype:
        return self.a.kind

    def stretches(self, text: str) -> list[str]:
        """The text's stretches, each without the space that it begins with, the first after the space before the text."""
        full = " " + text
        if not _DENSE.search(full):
            return text.split(" ")
        found = _STRETCH.findall(full)
        return [s[1:] for s in found] if sum(map(len, found)) == len(full) else [text]

    def ids(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """A's and B's ids of a space and each text; None where it is empty or the tokens' bytes differ from it."""
        cut = [self.stretches(t) if t and self.cut and SPACE not in t else None for t in texts]
        new = {s for own in cut if own for s in own if s not in self.a.known}
        if len(self.a.known) + len(new) > REMEMBERED:
            self.a.known.clear()
            self.b.known.clear()
            new = {s for own in cut if own for s in own}
        # Only a text's last stretch can end in white space; it is not to be followed by another.
        plain = [s for s in new if s and not s[-1].isspace()]
        learned = not plain or self.a.learn(plain) and self.b.learn(plain)
        for s in new if not learned else [s for s in new if not s or s[-1].isspace()]:
            ids = self.a.ids(s), self.b.ids(s)
            if ids[0] is not None and ids[1] is not None:
                self.a.known[s], self.b.known[s] = ids[0].tobytes(), ids[1].tobytes()
        out = []
        for text, own in zip(texts, cut):
            if not text or SPACE in text:
                out.append(None)
                continue
            try:
                ids = tuple(np.frombuffer(b"".join(map(of.known.__getitem__, own or [None])), self.kind) for of in (self.a, self.b))
            except KeyError:
                ids = self.a.ids(text), self.b.ids(text)
            out.append(None if ids[0] is None or ids[1] is None else ids)
        if sum(len(s) for s in new) > REMEMBERED_CHARS:
            self.a.known.clear()
            self.b.known.clear()
        return out


@lru_cache(maxsize=2)
def pair(a_path: str, b_path: str) -> Pair:
    """The two tokenizers of these files."""
    import sentencepiece

    own = encoder(a_path)
    a_bytes = [own.decode_single_token_bytes(k) for k in range(own.n_vocab)]
    model = sentencepiece.SentencePieceProcessor(model_file=b_path)
    names = [model.id_to_piece(k) for k in range(model.get_piece_size())]
    b_bytes = [bytes([int(s[3:5], 16)]) if model.is_byte(k) else s.replace(SPACE, " ").encode() for k, s in enumerate(names)]
    kind = np.dtype("<u2" if max(len(a_bytes), len(b_bytes)) <= 1 << 16 else "<u4")
    # Pieces that hold a space behind another character would be lost at a cut.
    cut = not any(SPACE in s.lstrip(SPACE) for s in names)
    return Pair(
        Tokenizer(lambda s: own.encode_to_numpy(" " + s, allowed_special=set(), disallowed_special=()), a_bytes, kind),
        Tokenizer(lambda s: model.encode(s, num_threads=1), b_bytes, kind), cut,
    )


def diagonals(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """How many of A's and of B's ends are among the first 0, work, 2 * work ... merged ones, A's first at ties.

    One binary search along each diagonal, for all diagonals at once.
    """
    d = np.append(np.arange(0, len(a) + len(b), work), len(a) + len(b))
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        before = a[np.minimum(mid, len(a) - 1)] <= b[np.clip(d - mid - 1, 0, len(b) - 1)]
        low, high = np.where(open_ & before, mid + 1, low), np.where(open_ & ~before, mid, high)
    return low, d - low


PIECES = [("row", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("pieces", pa.int32()), ("a_at", pa.int64()), ("b_at", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("a", pa.binary()), ("b", pa.binary())]
PIECES_SQL = "row long, doc_id long, piece int, pieces int, a_at long, b_at long, n_a long, n_b long, a binary, b binary"


def pieces_of(a: np.ndarray, b: np.ndarray, both: Pair, work: int) -> Iterator[tuple]:
    """(a_at, b_at, n_a, n_b, a, b) of each piece; a and b hold the next token too, where there is one."""
    if len(a) + len(b) <= work:
        yield 0, 0, len(a), len(b), a.tobytes(), b.tobytes()
        return
    a_end, b_end = np.cumsum(both.a.size[a]), np.cumsum(both.b.size[b])
    at = list(zip(*(x.tolist() for x in diagonals(a_end, b_end, work))))
    for (i, j), (k, m) in zip(at, at[1:]):
        yield int(a_end[i - 1]) if i else 0, int(b_end[j - 1]) if j else 0, k - i, m - j, a[i : k + 1].tobytes(), b[j : m + 1].tobytes()


def _pieces(a_path: str, b_path: str, work: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(a_path, b_path)
        out: list[tuple] = []
        size = 0

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), PIECES)], [n for n, _ in PIECES])

        for batch in small_batches(batches, 200):
            for row, doc, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), both.ids(batch.column(2).to_pylist())):
                if found is None:
                    out.append((row, doc, 0, 1, 0, 0, 0, 0, b"", b""))
                    continue
                cuts = list(pieces_of(*found, both, work))
                for k, own in enumerate(cuts):
                    out.append((row, doc, k, len(cuts), *own))
                    size += len(own[4]) + len(own[5])
                    if size > 4_000_000:
                        yield told()
                        out, size = [], 0
            if out:
                yield told()
                out, size = [], 0

    return run


# ---- overlaps


@dataclass
class Merged:
    """The merged ends of a piece, or of several whole documents one behind the other."""

    a: np.ndarray
    b: np.ndarray
    n_a: int
    n_b: int
    #: Per A token the B tokens that end before it ends; per B token the A tokens that end by then.
    b_open: np.ndarray
    a_done: np.ndarray
    #: Whether an A token ends with this B token.
    tie: np.ndarray


def merged(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int, both: Pair, a_at: int = 0, b_at: int = 0) -> Merged:
    a_end = a_at + np.concatenate(([0], np.cumsum(both.a.size[a[:n_a]])))
    b_end = b_at + np.cumsum(both.b.size[b[:n_b]])
    a_done = np.searchsorted(a_end[1:], b_end, "right")
    return Merged(a, b, n_a, n_b, np.searchsorted(b_end, a_end[1:], "left"), a_done, a_end[a_done] == b_end)


def link_codes(m: Merged, both: Pair) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the links that A's ends close, and of those that B's ends close where no A token ends."""
    wide = len(both.b.size)
    b = np.flatnonzero(~m.tie)
    return m.a[: m.n_a].astype(np.int64) * wide + m.b[m.b_open], m.a[m.a_done[b]].astype(np.int64) * wide + m.b[b]


@lru_cache(maxsize=2)
def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Digits of 0 to n - 1, at the right of their columns with a place for a separator, and which places are used."""
    wide = len(str(n - 1))
    text = np.char.rjust(np.arange(n).astype(f"U{wide}"), wide)
    digits = np.array([list(s.encode()) for s in text.tolist()], np.uint8)
    return np.hstack((digits, np.zeros((n, 1), np.uint8))), np.hstack((digits != 32, np.ones((n, 1), bool)))


def groups_text(m: Merged, both: Pair) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All groups as text, the places of tokens in it, and per group but an open last one its ends in A and B.

    Each token is followed by one separator: ',' within a list, '|' behind a
    group's last A token, ';' behind its last B token.
    """
    n_a, n_b = m.n_a, m.n_b
    b_last = np.flatnonzero(m.tie)
    a_last = m.a_done[b_last]
    before = np.concatenate(([0], np.cumsum(m.tie)))
    at_a = np.arange(n_a) + np.concatenate(([0], b_last + 1))[before[m.b_open]]
    at_b = np.arange(n_b) + np.concatenate((a_last, [n_a]))[before[:-1]]
    ids, sign = np.empty(n_a + n_b, np.int64), np.full(n_a + n_b, ord(","), np.uint8)
    ids[at_a], ids[at_b] = m.a[:n_a], m.b[:n_b]
    sign[at_a[a_last[a_last > 0] - 1]] = ord("|")
    sign[at_b[b_last]] = ord(";")
    digits, used = _decimals(max(len(both.a.size), len(both.b.size)))
    shown, keep = digits[ids], used[ids]
    shown[:, -1] = sign
    places = np.concatenate(([0], np.cumsum(keep.sum(axis=1))))
    return shown[keep].tobytes(), places, a_last, b_last + 1


# ---- counts


def _sorted_counts(codes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        codes = np.sort(codes)
        first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.zeros(0, np.int64)
        return codes[first], np.diff(np.append(first, len(codes)))
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


class Batch:
    """The pieces of a batch: whole documents one behind the other, and parts of long ones each for itself."""

    def __init__(self, batch: pa.RecordBatch, both: Pair):
        self.both = both
        self.columns = {n: batch.column(n).to_pylist() for n, _ in PIECES}
        self.whole = [k for k, n in enumerate(self.columns["pieces"]) if n == 1]
        self.parts = [k for k, n in enumerate(self.columns["pieces"]) if n > 1]

    def documents(self) -> Merged:
        c = self.columns
        a, b = (np.frombuffer(b"".join([c[x][k] for k in self.whole]), self.both.kind) for x in "ab")
        return merged(a, b, len(a), len(b), self.both)

    def sizes(self, name: str) -> np.ndarray:
        return np.array([self.columns[name][k] for k in self.whole], np.int64)

    def part(self, k: int) -> Merged:
        c = self.columns
        a, b = (np.frombuffer(c[x][k], self.both.kind) for x in "ab")
        return merged(a, b, c["n_a"][k], c["n_b"][k], self.both, c["a_at"][k], c["b_at"][k])

    def keys(self, m: Merged) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of whole documents: the document of each distinct pair in it, the pair's code, and its links."""
        codes = link_codes(m, self.both)
        doc = np.arange(len(self.whole))
        of_a, of_b = np.repeat(doc, self.sizes("n_a")), np.repeat(doc, self.sizes("n_b"))[~m.tie]
        wide = len(self.both.a.size) * len(self.both.b.size)
        keys, links = _sorted_counts(np.concatenate((of_a * wide + codes[0], of_b * wide + codes[1])))
        return keys // wide, keys % wide, links


def _batches(batches: Iterator[pa.RecordBatch], both: Pair) -> Iterator[Batch]:
    for batch in small_batches(batches, 200):
        yield Batch(batch, both)


def _counted(a_path: str, b_path: str):
    """Pieces as (row, code, docs): sums over whole documents with a null row, and each part's pairs with its row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(a_path, b_path)
        held, size = [], 0

        def told(row, codes, docs) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([row] * len(codes) if row is not None else pa.nulls(len(codes), pa.int64()), pa.int64()), pa.array(codes, pa.int64()), pa.array(docs, pa.int64())], ["row", "code", "docs"])

        for own in _batches(batches, both):
            for k in own.parts:
                codes, _ = _sorted_counts(np.concatenate(link_codes(own.part(k), both)))
                yield told(own.columns["row"][k], codes, np.ones(len(codes), np.int64))
            _, codes, _ = own.keys(own.documents())
            held.append(_sorted_counts(codes))
            size += len(held[-1][0])
            if size > 1_500_000:
                held = [_sorted_counts(*(np.concatenate(x) for x in zip(*held)))]
                size = len(held[0][0])
                if size > 750_000:
                    yield told(None, *held[0])
                    held, size = [], 0
        if held:
            yield told(None, *_sorted_counts(*(np.concatenate(x) for x in zip(*held))))

    return run


def pair_counts(pieces: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(code, docs, best): each linked id pair with the documents that hold it, and whether no pair of its A id has more.

    A document counts once, however many of its pieces hold the pair.
    """
    found = stage_table(pieces.where("n_a > 0 OR n_b > 0").mapInArrow(_counted(a_path, b_path), "row long, code long, docs long"), "pairs")
    whole = found.where("row IS NULL").select("code", "docs")
    parts = found.where("row IS NOT NULL").select("row", "code").distinct().select("code", F.lit(1).cast("long").alias("docs"))
    both = pair(a_path, b_path)
    counts = stage_table(whole.unionByName(parts).groupBy("code").agg(F.sum("docs").alias("docs")).withColumn("a", F.expr(f"code div {len(both.b.size)}")), "counts")
    # At most one row for each of A's ids.
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))
    return counts.join(F.broadcast(most), "a").select("code", "docs", (F.col("docs") == F.col("most")).alias("best"))


def _payload(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, most):
            code, docs, best = (np.asarray(batch.column(k).to_numpy(zero_copy_only=False)) for k in range(3))
            order = np.argsort(code)
            rows = [code[order].astype("<i8").tobytes(), docs[order].astype("<i8").tobytes(), best[order].astype(np.uint8).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([len(code)], pa.int64()), *(pa.array([x], pa.binary()) for x in rows)], ["n", "code", "docs", "best"])

    return run


class Lookup:
    """The counts of one pass."""

    def __init__(self, rows: list[tuple[bytes, bytes, bytes]]):
        code, docs, best = (np.concatenate([np.frombuffer(r[k], kind) for r in rows] or [np.zeros(0, kind)]) for k, kind in enumerate(("<i8", "<i8", np.uint8)))
        order = np.argsort(code)
        self.code, self.docs, self.best = code[order], docs[order], best[order]

    def of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each pair's documents and whether it is best; 0 for pairs of another pass."""
        if not len(self.code):
            return np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
        at = np.minimum(np.searchsorted(self.code, codes), len(self.code) - 1)
        known = self.code[at] == codes
        return np.where(known, self.docs[at], 0), np.where(known, self.best[at], 0).astype(np.int64)


_LOOKUP: dict = {}


def lookup(sent) -> Lookup:
    """A broadcast's counts; a worker holds one pass's at a time."""
    if _LOOKUP.get("of") is not sent.value:
        _LOOKUP.clear()
        _LOOKUP.update(of=sent.value, counts=Lookup(sent.value))
    return _LOOKUP["counts"]


# ---- scores

SCORED = [("row", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("pieces", pa.int32()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())]
#: Of a part: its first and last group, which may go on in other parts, and the groups between.
SIDES = [("head_a", pa.binary()), ("head_b", pa.binary()), ("inner", pa.binary()), ("tail_a", pa.binary()), ("tail_b", pa.binary())]
SCORED_SQL = "row long, doc_id long, piece int, pieces int, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
SIDES_SQL = "head_a binary, head_b binary, inner binary, tail_a binary, tail_b binary"


def _sides(m: Merged, both: Pair) -> tuple[bytes, bytes, bytes, bytes, bytes]:
    text, at, a_last, b_last = groups_text(m, both)

    def part(first: int, end: int) -> bytes:
        return text[at[first] : max(at[first], at[end] - 1)]

    if not len(a_last):
        return part(0, m.n_a), part(m.n_a, m.n_a + m.n_b), b"", b"", b""
    head, tail = int(a_last[0] + b_last[0]), int(a_last[-1] + b_last[-1])
    a_tail = tail + m.n_a - int(a_last[-1])
    return part(0, int(a_last[0])), part(int(a_last[0]), head), part(head, tail), part(tail, a_tail), part(a_tail, m.n_a + m.n_b)


def _scored(sent, a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, counts = pair(a_path, b_path), lookup(sent)
        names = [n for n, _ in SCORED + SIDES]
        for own in _batches(batches, both):
            c, out = own.columns, []
            m = own.documents()
            doc, codes, links = own.keys(m)
            docs, best = counts.of(codes)
            n = len(own.whole)
            sums = [np.bincount(doc, weights, n).astype(np.int64) for weights in (links, links * best)]
            total = np.zeros(n, np.int64)
            np.add.at(total, doc, links * docs)
            n_a, n_b = own.sizes("n_a"), own.sizes("n_b")
            text, at, _, _ = groups_text(m, both)
            ends = np.cumsum(n_a + n_b)
            ties = np.concatenate(([0], np.cumsum(m.tie)))[np.concatenate(([0], np.cumsum(n_b)))]
            for x, k in enumerate(own.whole):
                first, end = at[ends[x] - n_a[x] - n_b[x]], at[ends[x]] - 1
                digest = hashlib.sha256(text[first:end]).hexdigest() if n_a[x] else ""
                out.append((c["row"][k], c["doc_id"][k], 0, 1, n_a[x], n_b[x], ties[x + 1] - ties[x], sums[0][x], sums[1][x], total[x], digest, *[None] * 5))
            for k in own.parts:
                m = own.part(k)
                codes = np.concatenate(link_codes(m, both))
                docs, best = counts.of(codes)
                out.append((c["row"][k], c["doc_id"][k], c["piece"][k], c["pieces"][k], m.n_a, m.n_b, int(m.tie.sum()), len(codes), int(best.sum()), int(docs.sum()), None, *_sides(m, both)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([int(v) if isinstance(v, np.integer) else v for v in col], t) for col, (_, t) in zip(zip(*out), SCORED + SIDES)], names)

    return run


class Stitch:
    """The digest of a document's groups, from its parts in order."""

    def __init__(self):
        self.digest, self.started = hashlib.sha256(), False
        self.open_a: list[bytes] = []
        self.open_b: list[bytes] = []

    def put(self, text: bytes) -> None:
        if text:
            self.digest.update(b";" * self.started + text)
            self.started = True

    def add(self, cuts: int, head_a: bytes, head_b: bytes, inner: bytes, tail_a: bytes, tail_b: bytes) -> None:
        self.open_a += [head_a] * bool(head_a)
        self.open_b += [head_b] * bool(head_b)
        if cuts:
            self.put(b",".join(self.open_a) + b"|" + b",".join(self.open_b))
            self.put(inner)
            self.open_a, self.open_b = [tail_a] * bool(tail_a), [tail_b] * bool(tail_b)


def _stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts sorted by (row, piece) as one row a document; an open group and running sums are held, no more."""
    names = [n for n, _ in SCORED]
    held: list | None = None
    stitch = Stitch()

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip([*held, stitch.digest.hexdigest()], SCORED)], names)

    for batch in small_batches(batches, 50):
        for r in batch.to_pylist():
            sums = [r[n] for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
            if held and held[0] == r["row"]:
                held[4:] = [x + y for x, y in zip(held[4:], sums)]
            else:
                if held:
                    yield told()
                held, stitch = [r["row"], r["doc_id"], 0, r["pieces"], *sums], Stitch()
            stitch.add(r["n_groups"], *(r[n] for n, _ in SIDES))
    if held:
        yield told()


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None, work: int = PIECE) -> DataFrame:
    """The documents' tokens in pieces of equal work, staged."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return stage_table(rows.mapInArrow(_pieces(a_path or default_tokenizer(), b_path or default_pieces(), work), PIECES_SQL), "pieces")


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None, work: int = PIECE, pass_pairs: int = PASS_PAIRS) -> DataFrame:
    """One row per row of docs: tokens, groups, links, their counts and the groups' digest.

    Defined results: null and empty texts, and texts that hold the space sign
    of B's pieces or otherwise don't come back from the tokens' bytes, have no
    tokens, zeros and an empty digest; repeated rows are documents each; a null
    id stays null; an empty table gives none.
    """
    a_path, b_path = a_path or default_tokenizer(), b_path or default_pieces()
    pieces = token_pieces(docs, id_col, text_col, a_path, b_path, work)
    counts = pair_counts(pieces, a_path, b_path)
    blocks = stage_table(counts.mapInArrow(_payload(max(1, pass_pairs // 8)), "n long, code binary, docs binary, best binary").withColumn("block", F.monotonically_increasing_id()), "blocks")
    passes: list[list[int]] = [[]]
    room = pass_pairs
    for r in sorted(blocks.select("block", "n").collect()):
        if r["n"] > room and passes[-1]:
            passes.append([])
            room = pass_pairs
        passes[-1].append(r["block"])
        room -= r["n"]
    scored, more = None, []
    for own in passes:
        got = blocks.where(F.col("block").isin(own)).select("code", "docs", "best").collect() if own else []
        sent = pieces.sparkSession.sparkContext.broadcast([(bytes(r[0]), bytes(r[1]), bytes(r[2])) for r in got])
        found = pieces.mapInArrow(_scored(sent, a_path, b_path), f"{SCORED_SQL}, {SIDES_SQL}")
        if scored is None:
            scored = stage_table(found, "scored")
        else:
            more.append(stage_table(found.select("row", "piece", "n_best", "count_sum"), "scored"))
    if more:
        sums = [x.select("row", "piece", "n_best", "count_sum") for x in [scored, *more]]
        added = sums[0]
        for x in sums[1:]:
            added = added.unionByName(x)
        added = added.groupBy("row", "piece").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
        scored = scored.drop("n_best", "count_sum").join(added, ["row", "piece"]).select(*[n for n, _ in SCORED + SIDES])
    parts = scored.where("pieces > 1").repartition("row").sortWithinPartitions("row", "piece")
    stitched = parts.mapInArrow(_stitched, SCORED_SQL)
    whole = scored.where("pieces = 1").select(*[n for n, _ in SCORED])
    return whole.unionByName(stitched).drop("row", "piece")


def op12_cross_tokenizer(spark, sf_dir: str) -> DataFrame:
    """Alignment of the byte-level and the piece vocabulary on all documents."""
    found = align(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
