"""Substring dedup by collinear chaining of shared k-mer seeds.

1. Seeds: hashes of five consecutive words, thinned to window minima, so any
   common run of SPREAD + SEED - 1 words shares one.
2. Anchors: within a seed's documents, in order of their ids, every occurrence
   is tied to the first document's and to the one before it. The work is linear
   in the occurrences, and a passage that thousands share never gives all pairs.
3. Runs: where all window minima are shared, every LEAST_WORDS words in a row
   are a group too, tied to its first document. So each such run of equal words
   has a partner that holds all of it, whoever shares parts of it.
4. Chains: per document and partner, anchors in order in both texts are chained
   with linear gap costs through a Fenwick tree of prefix maxima.
5. Alignment: a chain's word slices are compared along its diagonals, extended
   at both ends, and kept as a passage if long and alike enough. All chains are
   aligned, also those whose words another partner's passage covers.
6. Membership: runs of equal words that no passage of their documents tells of
   stay as rows. So all documents that hold a run name its first document, and
   which share it can be read from the rows; class_id is the smallest document
   reachable by passages.
7. The rest: words that passages cover form classes of places. Two seeds near each
   other, in order, are a key, which any chain has, and all places of a key that
   are not of one class are compared, whoever came first. So no two documents
   are left apart for want of a tie, and copies of a passage aren't paired.
   The words around tell which pairs can be a passage. Places with equal ones in
   one document are one, and of a class's places one meets the most alike alone
   if they are a passage for sure, since its rows tell of the others.

Texts that are equal are one from the start: only that of the smallest id goes
through these steps, and each copy has one row with it over all words.

Sorted partitions stream through the tasks: nothing but one document's anchors
or words is held at a time.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candela.llm.common import BITMAP_ROW, drop_ids, only_ids, split_by_ids, stage_table, table, text_or_empty
from candela.llm.components import components
from candela.llm.decontam import _KEEP

SEED, SPREAD = 5, 16
#: A passage has at least so many words, and so many of them alike.
LEAST_WORDS, LEAST_ALIKE = 50, 0.8
#: Cost of a word of gap in a chain, in words.
GAP = 0.1
#: Words beyond a chain's ends that alignment may take in.
MARGIN = 64
#: Slices of one document that are cut in one task; of a document asked for more, copies go to several.
REQUESTS = 256
#: Such documents whose number of copies may be broadcast: some 16 MB.
MOST_HOT = 1_000_000
#: Two anchors that follow one another in a chain are less than so many words apart in either text: a larger gap costs more than a seed is worth.
NEAR = SEED + round(SEED / GAP)
#: Places of one key that a task holds against so many others; a key with more is dealt over several tasks.
BLOCK = 512
#: Pairs of places of a key whose words around are held against each other at once.
PAIRS = 8_192
#: A seed with so many ties at most has tied all its documents with each other.
ALL_TIED = 3
#: Words on either side of two near seeds by which places are told apart: all but a seed's of the shortest passage.
SIDE = LEAST_WORDS - SEED
#: Of a shortest passage in at most four pieces on diagonals of their own, two that follow one another have so many equal words.
LEAST_SEEN = round(LEAST_WORDS * LEAST_ALIKE) // 2
#: So many places of a class are all compared with a place; of more, the most alike alone if it is sure to be a passage.
FEW = 4

#: What words_of keeps of each byte, 0 between words.
_WORD_BYTES = np.array([0 if c == 32 else c for c in _KEEP], np.uint8)
#: Masks of the first n bytes of eight.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Bytes of texts whose words are numbered at once; a longer text is numbered alone.
CHUNK = 1 << 21


def numbered(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit number for each word of texts that lie one behind the other in raw and end at ends, and how many words the texts up to each have."""
    kept = np.zeros(len(raw) + 8, np.uint8)
    np.take(_WORD_BYTES, raw, out=kept[: len(raw)])
    inside = np.concatenate(([False], kept[: len(raw)] != 0, [False]))
    first = inside[1:] & ~inside[:-1]
    last = inside[:-1] & ~inside[1:]
    # Where a text ends inside a word, so does the word, and the next text may begin with one.
    cut = ends[inside[ends] & inside[ends + 1]]
    first[cut] = last[cut] = True
    start, size = np.flatnonzero(first), np.flatnonzero(last)
    size -= start
    # Eight bytes from each place on, little-endian.
    eight = np.ndarray((len(raw) + 1,), "<u8", kept, strides=(1,))
    out = mixed(size.astype(np.uint64), eight[start] & _FIRST[np.minimum(size, 8)])
    more, at = np.flatnonzero(size > 8), 8
    while len(more):
        out[more] = mixed(out[more], eight[start[more] + at] & _FIRST[np.minimum(size[more] - at, 8)])
        at += 8
        more = more[size[more] > at]
    return mixed(out, np.uint64(SEED)), np.searchsorted(start, ends)


def word_numbers(text: str) -> np.ndarray:
    """A 64-bit number for each word of the text."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return numbered(raw, np.array([len(raw)]))[0]


def worded(texts: pa.Array) -> Iterator[np.ndarray]:
    """The words' numbers of each text of a column."""
    texts = texts.cast(pa.large_binary())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    k = 0
    while k < len(texts):
        upto = max(k + 1, int(np.searchsorted(at, at[k] + CHUNK, side="right")) - 1)
        words, ends = numbered(raw[at[k] : at[upto]], at[k + 1 : upto + 1] - at[k])
        yield from np.split(words, ends[:-1])
        k = upto


def mixed(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Hashes h with x taken in."""
    h = (h ^ x) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def grams(words: np.ndarray) -> np.ndarray:
    """The hash of SEED words from each position on."""
    n = len(words) - SEED + 1
    h = np.zeros(max(n, 0), np.uint64)
    for k in range(SEED if n > 0 else 0):
        h = mixed(h, words[k : k + n])
    return h


def lowest(h: np.ndarray) -> np.ndarray:
    """The place of the minimum of each window of SPREAD hashes, the first of equal ones; places never go back."""
    at, width = np.arange(len(h)), 1
    while width < SPREAD:
        step = min(width, SPREAD - width)
        left, right = at[:-step], at[step:]
        at = np.where(h[right] < h[left], right, left)
        width += step
    return at


def seeds(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of the window minima over hashes of SEED words."""
    n = len(words) - SEED + 1
    if n < 1:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = grams(words)
    if n <= SPREAD:
        at = np.array([int(h.argmin())])
    else:
        at = lowest(h)
        at = at[np.concatenate(([True], at[1:] != at[:-1]))]
    # Words that repeat make every window's minimum equal: of such a run, one a window is enough,
    # numbered from the run's start, so that runs tie in order.
    same = np.concatenate(([False], (h[at[1:]] == h[at[:-1]]) & (np.diff(at) < SPREAD)))
    start = at[np.maximum.accumulate(np.where(same, 0, np.arange(len(at))))]
    step = (at - start) // SPREAD
    kept = ~same | (step != np.concatenate(([-1], step[:-1])))
    return h[at[kept]] ^ (step[kept].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), at[kept]


def runs(words: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of LEAST_WORDS words in a row, wherever another document may hold them too.

    shared is a bitmap of seeds that two documents have. A run of equal words has
    the same minima in all windows inside it, so only positions whose minima are
    all in the bitmap can be shared.
    """
    if len(words) < LEAST_WORDS:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = grams(words)
    low = lowest(h)
    at = low[np.concatenate(([True], low[1:] != low[:-1]))]
    slot = h[at] & np.uint64(8 * len(shared) - 1)
    known = (shared[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
    # Minima that repeat are numbered or left out among the seeds, so they may always be shared.
    same = (h[at[1:]] == h[at[:-1]]) & (np.diff(at) < SPREAD)
    known[1:] |= same
    known[:-1] |= same
    total = np.concatenate(([0], np.cumsum(known[np.searchsorted(at, low)])))
    inside = LEAST_WORDS - SEED - SPREAD + 2
    found = np.flatnonzero(total[inside:] - total[:-inside] == inside)
    out = np.zeros(len(found), np.uint64)
    for k in range(0, LEAST_WORDS, SEED):
        out = mixed(out, h[found + k])
    return _apart(out, found)


def _apart(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs that repeat in a document, the first and as many as cover the words of all."""
    order = np.lexsort((at, h))
    h, at = h[order], at[order]
    again = h[1:] == h[:-1]
    if not again.any():
        return h, at
    kept = np.ones(len(h), bool)
    # Those with an equal one before and after them.
    last = 0
    for k in (np.flatnonzero(again[:-1] & again[1:]) + 1).tolist():
        if not again[k - 1] or k == 1 or not again[k - 2]:
            last = int(at[k - 1])
        if at[k + 1] <= last + LEAST_WORDS:
            kept[k] = False
        else:
            last = int(at[k])
    return h[kept], at[kept]


def _run_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            h, doc, at = [], [], []
            for d, words in zip(batch.column(0).to_pylist(), worded(batch.column(1))):
                x, y = runs(words, bits)
                h.append(x)
                at.append(y)
                doc.append(np.full(len(x), d, np.int64))
            if h:
                arrays = [pa.array(np.concatenate(h).view(np.int64)), pa.array(np.concatenate(doc)), pa.array(np.concatenate(at).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(arrays, ["h", "doc", "at"])

    return run


def _run_anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ties of runs to their first document's first one, in a partition sorted by (h, doc, at)."""
    first = None  # (h, doc, at)
    for batch in batches:
        h, doc, at = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if not len(h):
            continue
        new = np.concatenate(([first is None or first[0] != h[0]], h[1:] != h[:-1]))
        start = np.maximum.accumulate(np.where(new, np.arange(len(h)), -1))
        b, y = doc[start].copy(), at[start].copy()
        if first is not None:
            b[start < 0], y[start < 0] = first[1:]
        tied = doc != b
        if tied.any():
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c[tied], t) for c, t in zip((doc, b, at, y), kinds)], ["a", "b", "x", "y"])
        first = (h[-1], int(b[-1]), int(y[-1]))


def word_marks(words: np.ndarray) -> bytes:
    """A byte from 1 to 255 for each word's number."""
    return (words % np.uint64(255) + np.uint64(1)).astype(np.uint8).tobytes()


def _seed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Seeds; the first of a document has the marks of its words."""
    for batch in batches:
        h, doc, at, marks = [], [], [], []
        for d, words in zip(batch.column(0).to_pylist(), worded(batch.column(1))):
            x, y = seeds(words)
            h.append(x)
            at.append(y)
            doc.append(np.full(len(x), d, np.int64))
            if len(x):
                marks += [word_marks(words)] + [None] * (len(x) - 1)
        if h:
            arrays = [pa.array(np.concatenate(h).view(np.int64)), pa.array(np.concatenate(doc)), pa.array(np.concatenate(at).astype(np.int32)), pa.array(marks, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["h", "doc", "at", "marks"])


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ties within the runs of a partition sorted by (h, doc, at); a run may go over batches.

    Carried from batch to batch: the run's seed, its first occurrence, and the
    last occurrences of the two latest documents.
    """
    carry = None  # (h, first doc, first at, doc, at, previous doc, previous at)
    for batch in batches:
        h, doc, at = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        n = len(h)
        if not n:
            continue
        k = np.arange(n)
        new_run = np.concatenate(([carry is None or carry[0] != h[0]], h[1:] != h[:-1]))
        new_doc = new_run | np.concatenate(([carry is None or carry[3] != doc[0]], doc[1:] != doc[:-1]))
        run = np.maximum.accumulate(np.where(new_run, k, -1))
        own = np.maximum.accumulate(np.where(new_doc, k, -1))
        first_doc, first_at = doc[run].copy(), at[run].copy()
        # The occurrence before the document's first one: in this run, the previous document's last.
        before = own - 1
        has_before = (own > run) & (before >= 0)
        prev_doc, prev_at = np.where(has_before, doc[before], -1), np.where(has_before, at[before], -1)
        known = has_before.copy()
        if carry is not None:
            same = run < 0
            first_doc[same], first_at[same] = carry[1], carry[2]
            still = same & (own < 0)  # still the carried document
            prev_doc[still], prev_at[still] = carry[5], carry[6]
            known[still] = carry[5] is not None and carry[7]
            start = same & (own == 0)
            prev_doc[start], prev_at[start] = carry[3], carry[4]
            known[start] = True
        tied = doc != first_doc
        also = tied & known & (prev_doc != first_doc)
        if tied.any():
            a = np.concatenate((doc[tied], doc[also]))
            x = np.concatenate((at[tied], at[also]))
            b = np.concatenate((first_doc[tied], prev_doc[also]))
            y = np.concatenate((first_at[tied], prev_at[also]))
            seed = np.concatenate((h[tied], h[also]))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b.astype(np.int64)), pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32)), pa.array(seed)], ["a", "b", "x", "y", "h"])
        carry = (h[-1], int(first_doc[-1]), int(first_at[-1]), int(doc[-1]), int(at[-1]), int(prev_doc[-1]), int(prev_at[-1]), bool(known[-1]))


def _in_bitmap(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    slot = h.view(np.uint64) & np.uint64(8 * len(bits) - 1)
    return (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _shared_rows(shared):
    """Seeds of two documents or more, and whether more than ALL_TIED may tie them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(_in_bitmap(batch.column(0).to_numpy(), np.frombuffer(shared.value[0], np.uint8))))
            often = _in_bitmap(some.column(0).to_numpy(), np.frombuffer(shared.value[1], np.uint8))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(often)], ["h", "doc", "at", "often"])

    return run


def near_seeds(h: np.ndarray, doc: np.ndarray, at: np.ndarray, often: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """(key, class, doc, first at, second at) of two seeds less than NEAR words apart, one of them frequent; sorted by (doc, at).

    The class is that of both seeds' places, or -1.
    """
    first, second = [], []
    for k in range(1, len(h)):
        i = np.flatnonzero((doc[k:] == doc[:-k]) & (at[k:] - at[:-k] < NEAR))
        if not len(i):
            break
        i = i[often[i] | often[i + k]]
        first.append(i)
        second.append(i + k)
    i, j = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (first, second))
    u = h.view(np.uint64)
    key = mixed(mixed(np.zeros(len(i), np.uint64), u[i]), u[j])
    return key.view(np.int64), np.where(place[i] == place[j], place[i], -1), doc[i], at[i], at[j]


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of a partition sorted by (doc, at) that holds seeds and covered places (upto not null), places first."""
    names = ["h", "doc", "at", "often", "upto", "place"]
    empty = pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int64())], names)
    held = [empty]

    def told(rows: pa.Table) -> pa.RecordBatch:
        h, doc, at, often, upto, place = (rows.column(n).combine_chunks().fill_null(v).to_numpy(zero_copy_only=False) for n, v in zip(names, (0, 0, 0, False, -1, -1)))
        last = np.maximum.accumulate(np.where(upto >= 0, np.arange(len(h)), -1))
        inside = (last >= 0) & (doc[last] == doc) & (at + SEED <= upto[last])
        seed = upto < 0
        found = near_seeds(h[seed], doc[seed], at[seed], often[seed], np.where(inside, place[last], -1)[seed])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["k", "c", "doc", "x1", "x2"])

    for batch in batches:
        if not batch.num_rows:
            continue
        doc = batch.column(1).to_numpy()
        cut = int(np.searchsorted(doc, doc[-1]))
        if cut or held[-1].num_rows and held[-1].column(1)[-1].as_py() != doc[-1]:
            yield told(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if sum(b.num_rows for b in held):
        yield told(pa.Table.from_batches(held))


def around(marks: bytes, x1: int, x2: int) -> bytes:
    """The marks of SIDE words before two near seeds, of theirs and those between, and of SIDE words after; 0 where there are none."""
    before, after = marks[max(0, x1 - SIDE) : x1], marks[x2 + SEED : x2 + SEED + SIDE]
    return before.rjust(SIDE, b"\0") + marks[x1 : x2 + SEED].ljust(NEAR + SEED, b"\0") + after.ljust(SIDE, b"\0")


def _around_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of keys with the marks around them, in a partition sorted by doc whose documents' marks (k null) come first; of equal ones in a document the first."""
    owner, held, seen = None, b"", set()
    kinds = [("k", pa.int64()), ("c", pa.int64()), ("doc", pa.int64()), ("x1", pa.int32()), ("x2", pa.int32()), ("near", pa.binary())]
    for batch in batches:
        out: list[tuple] = []
        for k, c, doc, x1, x2, marks in zip(*(v.to_pylist() for v in batch.columns)):
            if k is None:
                owner, held, seen = doc, marks, set()
            elif doc == owner:
                near = around(held, x1, x2)
                if (k, c, x2 - x1, near) not in seen:
                    seen.add((k, c, x2 - x1, near))
                    out.append((k, c, doc, x1, x2, near))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(zip(*out), kinds)], [n for n, _ in kinds])


def equal_around(near: np.ndarray, gap: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Equal words around places i and places j, before and after the seeds; between them all of the fewer if their gaps differ."""
    equal = (near[j] == near[i]) & (near[i] != 0)
    between = np.where(gap[j] == gap[i], equal[:, SIDE:-SIDE].sum(axis=1), np.minimum(gap[j], gap[i]) + SEED)
    return equal[:, :SIDE].sum(axis=1) + equal[:, -SIDE:].sum(axis=1) + between


def sure(near: np.ndarray, gap: np.ndarray, i: int, j: int) -> bool:
    """Whether the words around two places, with those between, are a passage by themselves."""
    if gap[i] != gap[j]:
        return False
    words = np.r_[: SIDE + gap[i] + SEED, near.shape[1] - SIDE : near.shape[1]]
    return bool(best_stretches(np.where((near[i, words] == near[j, words]) & (near[i, words] != 0), 1, -4)))


def most_alike(c: np.ndarray, doc: np.ndarray, x1: np.ndarray, gap: np.ndarray, near: np.ndarray, i: np.ndarray, j: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """Which pairs (i, j) stay: all but those of a place with a class of which it surely has a passage with the most alike."""
    stays = (c[i] < 0) & (c[j] < 0)
    for p, q in ((i, j), (j, i)):
        own = np.flatnonzero(c[q] >= 0)
        own = own[np.lexsort((x1[q[own]], doc[q[own]], -equal[own], c[q[own]], p[own]))]
        if len(own):
            cuts = np.flatnonzero(np.concatenate(([True], (p[own[1:]] != p[own[:-1]]) | (c[q[own[1:]]] != c[q[own[:-1]]]), [True]))).tolist()
            for s, e in zip(cuts[:-1], cuts[1:]):
                best = own[s]
                stays[own[s : s + 1] if e - s > FEW and sure(near, gap, p[best], q[best]) else own[s:e]] = True
    return stays


def key_pairs(c: np.ndarray, doc: np.ndarray, x1: np.ndarray, x2: np.ndarray, block: np.ndarray, near: np.ndarray | None = None) -> np.ndarray:
    """Rows a, b, x1, x2, y1, y2 of the pairs among places of a key, or between two blocks of them, in two documents and not of one class.

    With the marks around the places, of those that can be a passage, and of a class with the most alike if that is sure to be one.
    """
    two = block[0] != block[-1]
    left, right, alike = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    n, s = len(doc), 0
    while s < n - 1:
        # So many places at a time as have PAIRS pairs with those after them.
        e = min(n - 1, s + max(1, PAIRS // (n - s)))
        i, j = np.nonzero(np.arange(n) > np.arange(s, e)[:, None])
        i += s
        # A chain takes both seeds only if the gaps in both texts cost less than the first is worth.
        ok = (doc[j] != doc[i]) & ((c[j] != c[i]) | (c[i] < 0)) & (x2[i] - x1[i] + x2[j] - x1[j] < NEAR + SEED)
        if two:
            ok &= block[j] != block[i]
        i, j = i[ok], j[ok]
        if near is not None and len(j):
            equal = equal_around(near, x2 - x1, i, j)
            seen = equal >= LEAST_SEEN
            i, j = i[seen], j[seen]
            alike.append(equal[seen])
        left.append(i)
        right.append(j)
        s = e
    i, j = np.concatenate(left), np.concatenate(right)
    if near is not None:
        stays = most_alike(c, doc, x1, x2 - x1, near, i, j, np.concatenate(alike))
        i, j = i[stays], j[stays]
    up = doc[j] < doc[i]
    a, b = np.where(up, i, j), np.where(up, j, i)
    return np.stack((doc[a], doc[b], x1[a], x2[a], x1[b], x2[b]))


def _compared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a partition of places, with or without the marks around them, that is sorted by (k, low, high, block)."""
    kinds = [("a", pa.int64()), ("b", pa.int64()), ("x1", pa.int32()), ("x2", pa.int32()), ("y1", pa.int32()), ("y2", pa.int32())]

    def told(rows: list[np.ndarray], last: bool) -> tuple[list[pa.RecordBatch], list[np.ndarray]]:
        k, low, high, block, *rest = rows
        rest.insert(4, block)
        if not len(k):
            return [], rows
        cuts = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])))).tolist()
        cuts += [len(k)] * last
        found = [pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(key_pairs(*(v[s:e] for v in rest)), kinds)], [n for n, _ in kinds]) for s, e in zip(cuts[:-1], cuts[1:])]
        whole = pa.Table.from_batches(found).combine_chunks().to_batches() if found else []
        return whole, [v[cuts[-1] :] for v in rows]

    held = [np.empty(0, np.int64)] * 8
    for batch in batches:
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:8]]
        if batch.num_columns > 8:
            rows.append(np.frombuffer(b"".join(batch.column(8).to_pylist()), np.uint8).reshape(len(rows[0]), -1))
            held = held if len(held) > 8 else [*held, rows[8][:0]]
        found, held = told([np.concatenate(v) for v in zip(held, rows)], last=False)
        yield from found
    yield from told(held, last=True)[0]


class _PrefixMax:
    """A Fenwick tree of (score, index) maxima over ranks 1..n."""

    def __init__(self, n: int):
        self.best: list[tuple[float, int]] = [(-1e18, -1)] * (n + 1)

    def put(self, at: int, value: tuple[float, int]) -> None:
        while at < len(self.best):
            if value > self.best[at]:
                self.best[at] = value
            at += at & -at

    def get(self, at: int) -> tuple[float, int]:
        found = (-1e18, -1)
        while at:
            if self.best[at] > found:
                found = self.best[at]
            at -= at & -at
        return found


def stretches(b: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[list, ...]:
    """Anchors of n words with one partner b, on one diagonal and no further apart than a seed window, as (b, x0, y0, words, anchors), in order.

    A run counts for as many anchors as are asked for.
    """
    order = np.lexsort((x, y - x, b))
    b, x, y, n = b[order], x[order], y[order], n[order]
    d = y - x
    turn = np.concatenate(([True], (d[1:] != d[:-1]) | (b[1:] != b[:-1])))
    base = np.cumsum(turn) * (int((x + n).max()) + 1)
    reach = np.maximum.accumulate(x + n + base) - base
    cut = np.flatnonzero(turn | np.concatenate(([False], x[1:] - reach[:-1] > SPREAD)))
    ends = np.concatenate((cut[1:], [len(x)])) - 1
    anchors = np.add.reduceat(np.where(n > SEED, LEAST_ANCHORS, 1), cut)
    b, x, y, words = b[cut], x[cut], y[cut], reach[ends] - x[cut]
    order = np.lexsort((anchors, words, y, x, b))
    return tuple(v[order].tolist() for v in (b, x, y, words, anchors))


def chains(x: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> list[tuple[float, int, list[tuple[int, int, int]]]]:
    """(score, anchors, stretches (x0, y0, words) in order in both texts), best first, each stretch in one chain."""
    n = np.full(len(x), SEED) if n is None else n
    return chained_parts(list(zip(*stretches(np.zeros(len(x), np.int64), x, y, n)[1:])))


def chained_parts(parts: list[tuple[int, int, int, int]]) -> list[tuple[float, int, list[tuple[int, int, int]]]]:
    """chains() of stretches (x0, y0, words, anchors) in order."""
    if len(parts) == 1:
        return [(float(parts[0][2]), parts[0][3], [parts[0][:3]])]
    ends = sorted({b + n for _, b, n, _ in parts})
    tree = _PrefixMax(len(ends))
    score, back = [0.0] * len(parts), [-1] * len(parts)
    # A stretch may follow those that end, in both texts, where it starts or before.
    pending = sorted(range(len(parts)), key=lambda i: parts[i][0] + parts[i][2])
    done = 0
    for i, (a, b, n, _) in enumerate(parts):
        while done < len(pending) and parts[pending[done]][0] + parts[pending[done]][2] <= a:
            j = pending[done]
            xa, yb, m, _ = parts[j]
            tree.put(bisect.bisect_left(ends, yb + m) + 1, (score[j] + GAP * (xa + m + yb + m), j))
            done += 1
        best, j = tree.get(bisect.bisect_right(ends, b))
        gain = best - GAP * (a + b)
        score[i] = n + max(0.0, gain)
        back[i] = j if gain > 0 else -1
    used, out = [False] * len(parts), []
    for i in sorted(range(len(parts)), key=lambda i: -score[i]):
        worth, anchors, chain = score[i], 0, []
        while i >= 0 and not used[i]:
            used[i] = True
            anchors += parts[i][3]
            chain.append(parts[i][:3])
            i = back[i]
        if chain:
            out.append((worth, anchors, chain[::-1]))
    return out


def equal_runs(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> list[tuple[int, int, int]]:
    """The runs of LEAST_WORDS equal words among anchors, joined where they meet on a diagonal, as (x0, y0, words)."""
    long = n >= LEAST_WORDS
    x, y, n = x[long], y[long], n[long]
    if not len(x):
        return []
    order = np.lexsort((x, y - x))
    x, y, n = x[order], y[order], n[order]
    cut = np.flatnonzero(np.concatenate(([True], (np.diff(y - x) != 0) | (x[1:] > x[:-1] + n[:-1]))))
    last = np.concatenate((cut[1:], [len(x)])) - 1
    return [(int(x[s]), int(y[s]), int(x[e] + n[e] - x[s])) for s, e in zip(cut, last)]


CHAIN = "a long, b long, x0 int, x1 int, y0 int, y1 int, xs array<int>, ds array<int>"


#: A run of LEAST_WORDS equal words has so many anchors at least, so far apart.
LEAST_ANCHORS = 2
LEAST_SPAN = LEAST_WORDS - 2 * (SPREAD + SEED)


def chains_of_document(b: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """(partner, chain) of a document's anchors, whatever other chains tell of its words; b is sorted."""
    n = np.full(len(x), SEED) if n is None else n
    first = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
    some = np.logical_or(np.diff(np.concatenate((first, [len(b)]))) >= LEAST_ANCHORS, np.maximum.reduceat(n, first) >= LEAST_WORDS)
    held = np.repeat(some, np.diff(np.concatenate((first, [len(b)]))))
    if not held.any():
        return []
    partner, *parts = stretches(b[held], x[held], y[held], n[held])
    parts, s, out = list(zip(*parts)), 0, []
    while s < len(parts):
        e = bisect.bisect_right(partner, partner[s], s)
        for _, anchors, chain in chained_parts(parts[s:e]):
            if anchors >= LEAST_ANCHORS and chain[-1][0] + chain[-1][2] - chain[0][0] >= LEAST_SPAN:
                out.append((partner[s], chain))
        s = e
    return out


def _chain_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains, and runs of equal words (xs null), of each document in a partition sorted by (a, b)."""
    ints = pa.list_(pa.int32())
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), ints, ints]
    names = ["a", "b", "x0", "x1", "y0", "y1", "xs", "ds"]

    def told(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    held: list[np.ndarray] = [np.empty(0, np.int64)] * 5
    for batch in batches:
        held = [np.concatenate((p, c.to_numpy(zero_copy_only=False))) for p, c in zip(held, batch.columns)]
        rows, held = _whole_documents(held, last=False)
        if rows:
            yield told(rows)
    rows, _ = _whole_documents(held, last=True)
    if rows:
        yield told(rows)


def _whole_documents(held: list[np.ndarray], last: bool) -> tuple[list[tuple], list[np.ndarray]]:
    """Rows of the documents whose anchors are all here, and what is left of the last one."""
    a, b, x, y, n = held
    if not len(a):
        return [], held
    bounds = np.concatenate((np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))), [len(a)])).tolist()
    if not last:
        bounds = bounds[:-1]
    rows: list[tuple] = []
    for s, e in zip(bounds[:-1], bounds[1:]):
        for partner, chain in chains_of_document(b[s:e], *(v[s:e].astype(np.int64) for v in (x, y, n))):
            (x0, y0, _), (x1, y1, words) = chain[0], chain[-1]
            rows.append((int(a[s]), partner, x0, x1 + words, y0, y1 + words, [c[0] for c in chain], [c[1] - c[0] for c in chain]))
        if n[s:e].max() < LEAST_WORDS:
            continue
        cuts = np.concatenate(([s], s + 1 + np.flatnonzero(b[s + 1 : e] != b[s : e - 1]), [e])).tolist()
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            for x0, y0, words in equal_runs(*(v[lo:hi].astype(np.int64) for v in (x, y, n))):
                rows.append((int(a[s]), int(b[lo]), x0, x0 + words, y0, y0 + words, None, None))
    return rows, [v[bounds[-1] :] for v in held]


def _slice_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word slices for the requests on each document; the document's text comes before its requests."""
    doc, words = None, np.empty(0, np.int32)

    def told(rows: list[tuple], slices: list[np.ndarray]) -> pa.RecordBatch:
        cols = [pa.array(v, t) for v, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32()))]
        held = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, slices)]), pa.int32()), pa.array(np.concatenate(slices), pa.int32()))
        return pa.RecordBatch.from_arrays([*cols, held], ["chain", "side", "lo", "words"])

    for batch in batches:
        texts = worded(batch.column(1).filter(batch.column(2).is_null()))
        rows, slices, size = [], [], 0
        for d, chain, side, lo, hi in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4, 5))):
            if chain is None:
                doc, words = d, next(texts).view(np.int64).astype(np.int32)
            elif d == doc:
                lo = max(0, lo)
                rows.append((chain, side, lo))
                slices.append(words[lo:hi])
                size += len(slices[-1])
                if size > CHUNK:
                    yield told(rows, slices)
                    rows, slices, size = [], [], 0
        if rows:
            yield told(rows, slices)


def best_stretches(gain: np.ndarray) -> list[tuple[int, int]]:
    """Stretches (start, end) of LEAST_WORDS or more with the largest sums, apart from each other, in order.

    That is the stretch of the largest sum, then those before and after it in
    the same way, found in one pass over the runs of one sign.
    """
    if not len(gain):
        return []
    cut = np.concatenate(([0], np.flatnonzero((gain[1:] > 0) != (gain[:-1] > 0)) + 1, [len(gain)]))
    total = np.concatenate(([0], np.cumsum(gain)))[cut].tolist()
    cut = cut.tolist()
    # (start, end, sum before it, sum with it, place of the last stretch before it whose sum before is less)
    found: list[tuple[int, int, float, float, int]] = []
    for k in range(len(cut) - 1):
        if total[k + 1] <= total[k]:
            continue
        start, end, low, high = cut[k], cut[k + 1], total[k], total[k + 1]
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= high:
                break
            start, _, low, _, _ = found[j]
            del found[j:]
            j = len(found) - 1
        found.append((start, end, low, high, j))
    return [(s, e) for s, e, *_ in found if e - s >= LEAST_WORDS]


def align(a: np.ndarray, b: np.ndarray, a_lo: int, b_lo: int, xs: list[int], ds: list[int]) -> list[tuple[int, int, int, int, float]]:
    """Passages along a chain: (first and last word in a, in b, share of equal words).

    Each word of a is held against b on the diagonal of the chain's stretch it
    is in or follows; a passage is a stretch whose equal words outweigh the
    unequal ones, which count four times, by the most.
    """
    at = np.arange(a_lo, a_lo + len(a))
    diagonal = np.array(ds)[np.maximum(np.searchsorted(np.array(xs), at, side="right") - 1, 0)]
    other = at + diagonal - b_lo
    inside = (other >= 0) & (other < len(b))
    equal = np.zeros(len(a), bool)
    equal[inside] = a[inside] == b[other[inside]]
    out = []
    for s, e in best_stretches(np.where(equal, 1, -4)):
        alike = float(equal[s:e].mean())
        if alike >= LEAST_ALIKE:
            out.append((int(at[s]), int(at[e - 1]), int(at[s] + diagonal[s]), int(at[e - 1] + diagonal[e - 1]), alike))
    return out


def _align_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [("doc_id", pa.int64()), ("first_word", pa.int32()), ("last_word", pa.int32()), ("other_id", pa.int64()), ("other_first", pa.int32()), ("other_last", pa.int32()), ("alike", pa.float64())]
    for batch in batches:
        out: list[tuple] = []
        a_words, b_words = (np.split(c.values.to_numpy(), c.offsets.to_numpy())[1:-1] for c in (batch.column(5), batch.column(7)))
        for a, b, xs, ds, a_lo, wa, b_lo, wb in zip(*(c.to_pylist() for c in batch.columns[:5]), a_words, batch.column(6).to_pylist(), b_words):
            for found in align(wa, wb, a_lo, b_lo, xs, ds):
                out.append((a, *found[:2], b, *found[2:4], round(found[4], 6)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), kinds)], [n for n, _ in kinds])


PASSAGE = "doc_id long, first_word int, last_word int, other_id long, other_first int, other_last int, alike double"


def _aligned(rows: DataFrame, chained: DataFrame) -> DataFrame:
    """Passages along staged chains, between rows (doc, text)."""
    sides = F.array(
        F.struct(F.col("a").alias("doc"), F.lit(0).alias("side"), (F.col("x0") - MARGIN).alias("lo"), (F.col("x1") + MARGIN).alias("hi")),
        F.struct(F.col("b").alias("doc"), F.lit(1).alias("side"), (F.col("y0") - MARGIN).alias("lo"), (F.col("y1") + MARGIN).alias("hi")),
    )
    asked = stage_table(chained.select("chain", F.explode(sides).alias("s")).select("s.doc", "chain", "s.side", "s.lo", "s.hi"), "asked")
    counts = stage_table(asked.groupBy("doc").agg(F.ceil(F.count(F.lit(1)) / REQUESTS).cast("int").alias("copies")), "counts")
    hot = counts.where("copies > 1")
    n_hot = hot.count()

    def dealt(df: DataFrame, copy) -> DataFrame:
        if not n_hot:
            return df.withColumn("copy", F.lit(0))
        joined = df.join(F.broadcast(hot) if n_hot <= MOST_HOT else hot, "doc", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
        return joined.withColumn("copy", copy).drop("copies")

    none = F.lit(None).cast("int")
    # Rows whose id may be asked for; a text that nobody asks for gives no slice.
    texts = split_by_ids(rows, counts.select("doc"), "doc")[1].select("doc", "text", F.lit(None).cast("long").alias("chain"), none.alias("side"), none.alias("lo"), none.alias("hi"))
    texts = dealt(texts, F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    asked = dealt(asked.select("doc", F.lit(None).cast("string").alias("text"), "chain", "side", "lo", "hi"), F.pmod(F.col("chain"), F.col("copies").cast("long")).cast("int"))
    served = texts.unionByName(asked).repartition("doc", "copy").sortWithinPartitions("doc", "copy", F.col("chain").asc_nulls_first()).drop("copy")
    slices = served.mapInArrow(_slice_rows, "chain long, side int, lo int, words array<int>")
    both = slices.groupBy("chain").pivot("side", [0, 1]).agg(F.first("lo").alias("lo"), F.first("words").alias("words"))
    ready = chained.join(both, "chain").select("a", "b", "xs", "ds", "0_lo", "0_words", "1_lo", "1_words")
    return ready.mapInArrow(_align_rows, PASSAGE)


#: Bits of the bitmap of shared seeds: 16 MB at most. With more seeds it tells less apart, and more runs are grouped.
SHARED_BITS = 1 << 27


def shared_seeds(anchors: DataFrame) -> bytes:
    """A bitmap of the anchors' seeds."""
    bits = max(BITMAP_ROW, min(SHARED_BITS, 1 << (16 * max(1, anchors.count()) - 1).bit_length()))
    slot = F.pmod("h", F.lit(bits).cast("long")) + 1
    # At most 4096 rows of 4 KB.
    part = anchors.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("m")).collect()
    out = np.zeros((bits // BITMAP_ROW, BITMAP_ROW // 8), np.uint8)
    for r in part:
        out[r["k"] - 1] = np.frombuffer(r["m"], np.uint8)
    return out.tobytes()


def one_row_an_id(rows: DataFrame) -> DataFrame:
    """rows (doc, text) with one row per id: of those that repeat an id, that with the smallest text."""
    again = stage_table(rows.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc"), "again")
    if again.isEmpty():
        return rows
    return drop_ids(rows, again, "doc").unionByName(only_ids(rows, again, "doc").groupBy("doc").agg(F.min("text").alias("text")))


def equal_texts(rows: DataFrame) -> DataFrame:
    """(doc, first), staged, for rows (doc, text) whose text a smaller id has too: the smallest such id."""
    marks = stage_table(rows.select("doc", F.md5(F.col("text").cast("binary")).alias("mark"), F.octet_length("text").alias("size")), "marks")
    # Staged, so that both sides of the join are plain exchanges and a hot text's rows can be split.
    groups = stage_table(marks.groupBy("mark", "size").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "groups")
    return stage_table(marks.join(groups, ["mark", "size"]).where("doc <> first").select("doc", "first"), "copies")


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(words) for words in worded(batch.column(1))], pa.int32())], ["doc", "n"])


def copied_passages(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """The whole text of each copy as one passage, if it is long enough."""
    firsts = copies.select(F.col("first").alias("doc")).distinct()
    sizes = stage_table(split_by_ids(rows, firsts, "doc")[1].mapInArrow(_word_counts, "doc long, n int").where(f"n >= {LEAST_WORDS}"), "sizes")
    last, zero = (F.col("n") - 1).cast("int"), F.lit(0)
    found = copies.join(sizes.select(F.col("doc").alias("first"), "n"), "first")
    return found.select("doc", zero.alias("first_word"), last.alias("last_word"), F.col("first").alias("other_id"), zero.alias("other_first"), last.alias("other_last"), F.lit(1.0).alias("alike")).withColumnRenamed("doc", "doc_id")


def may_hold_runs(anchors: DataFrame) -> DataFrame:
    """Documents with LEAST_ANCHORS seeds that another one has too; others can't share LEAST_WORDS words in a row."""
    places = anchors.select(F.explode(F.array(F.struct(F.col("a").alias("doc"), F.col("x").alias("at")), F.struct(F.col("b").alias("doc"), F.col("y").alias("at")))).alias("s"))
    # Two places that differ are enough to know of.
    ends = places.groupBy("s.doc").agg(F.min("s.at").alias("low"), F.max("s.at").alias("high"))
    return stage_table(ends.where("low < high").select("doc"), "holders")


def place_classes(passages: DataFrame) -> DataFrame:
    """(doc, at, upto, place): the stretches of words that passages cover, and the least stretch that passages lead to from them."""
    sides = F.array(F.struct(F.col("doc_id").alias("doc"), F.col("first_word").alias("at"), (F.col("last_word") + 1).alias("upto")), F.struct(F.col("other_id").alias("doc"), F.col("other_first").alias("at"), (F.col("other_last") + 1).alias("upto")))
    ends = stage_table(passages.withColumn("link", F.monotonically_increasing_id()).select("link", F.explode(sides).alias("s")).select("link", "s.*"), "ends")
    order = Window.partitionBy("doc").orderBy("at", "upto")
    before = F.max("upto").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = ends.select("doc", "at", "upto").distinct().withColumn("new", F.when(before.isNull() | (F.col("at") >= before), 1).otherwise(0))
    numbered = marked.withColumn("n", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = stage_table(numbered.groupBy("doc", "n").agg(F.min("at").alias("at"), F.max("upto").alias("upto")).drop("n").withColumn("place", F.monotonically_increasing_id()), "places")
    spans = merged.select("doc", F.col("at").alias("lo"), F.col("upto").alias("hi"), "place")
    held = ends.join(spans, "doc").where("at >= lo and upto <= hi").groupBy("link").agg(F.min("place").alias("p"), F.max("place").alias("q"))
    roots = components(held, "p", "q").select(F.col("node").alias("place"), "root")
    return merged.join(roots, "place", "left").select("doc", "at", "upto", F.coalesce("root", "place").alias("place"))


def compared_places(found: DataFrame, anchors: DataFrame, shared, passages: DataFrame) -> DataFrame:
    """Anchors (a, b, x, y) of all documents that share two near seeds at places that passages don't lead to from each other.

    Every chain has two such seeds. Of a document's places of a key with equal
    words around one is compared, and of many of a class the most alike if it is
    sure to be a passage, as its rows tell of the others. A key with more than BLOCK places is dealt by pairs of blocks,
    so that no task holds more than two blocks of it.
    """
    spark = found.sparkSession
    often = spark.sparkContext.broadcast((shared, shared_seeds(anchors.join(stage_table(anchors.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(f"n > {ALL_TIED}").select("h"), "often"), "h"))))
    seeds = found.select("h", "doc", "at").mapInArrow(_shared_rows(often), "h long, doc long, at int, often boolean")
    both = seeds.unionByName(place_classes(passages), allowMissingColumns=True).repartition("doc").sortWithinPartitions("doc", "at", F.col("upto").desc_nulls_last())
    keys = stage_table(both.mapInArrow(_key_rows, "k long, c long, doc long, x1 int, x2 int"), "keys")
    kind = F.struct("c", F.when(F.col("c") < 0, F.col("doc")).alias("d"))
    of_two = lambda df: df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min(kind).alias("low"), F.max(kind).alias("high")).where("low <> high")
    asked = keys.join(stage_table(of_two(keys).select("k"), "known"), "k", "left_semi").select("k", "c", "doc", "x1", "x2", F.lit(None).cast("binary").alias("marks"))
    asked = asked.unionByName(found.where("marks is not null").select("doc", "marks"), allowMissingColumns=True).repartition("doc").sortWithinPartitions("doc", F.col("k").isNotNull(), "k", "x1", "x2")
    keys = stage_table(asked.mapInArrow(_around_rows, "k long, c long, doc long, x1 int, x2 int, near binary"), "around")
    sizes = stage_table(of_two(keys).select("k", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "sizes")
    block = F.pmod(F.xxhash64("doc", "x1"), F.col("blocks").cast("long")).cast("int")
    dealt = keys.join(sizes, "k").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = dealt.select("k", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "c", "doc", "x1", "x2", "near")
    pairs = tiles.repartition("k", "low", "high").sortWithinPartitions("k", "low", "high", "block").mapInArrow(_compared_rows, "a long, b long, x1 int, x2 int, y1 int, y2 int")
    each = F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))))
    return pairs.select("a", "b", each.alias("s")).select("a", "b", "s.x", "s.y").distinct()


def passage_classes(passages: DataFrame) -> DataFrame:
    """(doc_id, class_id, links) for each document in a passage: the smallest id reachable, and how many documents it has a row with."""
    pairs = stage_table(passages.select("doc_id", "other_id").distinct(), "pairs")
    linked = components(pairs, "doc_id", "other_id")
    named = linked.groupBy("root").agg(F.min("node").alias("class_id"))
    links = pairs.select(F.explode(F.array("doc_id", "other_id")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    return linked.join(named, "root").join(links, "node").select(F.col("node").alias("doc_id"), "class_id", "links")


def shared_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Passages of LEAST_WORDS or more that a document shares with one of a smaller id.

    One row per passage; candidates for its partner are the first and the
    previous document of each seed, the first of each run of LEAST_WORDS
    equal words, so each such run is in a row with that document, and all
    documents with two near seeds of it at places that those rows don't lead to.
    Documents whose places rows do lead to are of one class, and aren't paired. A text that equals one of a smaller id has one row with the
    smallest such id, whose own rows tell of other partners. Words count from 0. Defined results: null and empty texts and
    null ids have no passages; of rows that repeat an id that with the smallest
    text counts; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), text_or_empty(text_col).alias("text")).where("doc is not null")
    every = one_row_an_id(rows)
    copies = equal_texts(every)
    rows = drop_ids(every, copies.select("doc"), "doc")
    seeded = stage_table(rows.mapInArrow(_seed_rows, "h long, doc long, at int, marks binary"), "seeds")
    sorted_seeds = seeded.select("h", "doc", "at").repartition("h").sortWithinPartitions("h", "doc", "at")
    anchors = stage_table(sorted_seeds.mapInArrow(_anchor_rows, "a long, b long, x int, y int, h long"), "anchors")
    bits = shared_seeds(anchors)
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    whole = split_by_ids(rows, may_hold_runs(anchors), "doc")[1].mapInArrow(_run_rows(shared), "h long, doc long, at int").repartition("h").sortWithinPartitions("h", "doc", "at")
    ties = whole.mapInArrow(_run_anchor_rows, "a long, b long, x int, y int").withColumn("n", F.lit(LEAST_WORDS))
    tied = anchors.drop("h").withColumn("n", F.lit(SEED)).unionByName(ties)
    by_document = tied.repartition("a").sortWithinPartitions("a", "b", "x", "y")
    told = stage_table(by_document.mapInArrow(_chain_rows, CHAIN).withColumn("chain", F.monotonically_increasing_id()), "chains")
    chained, runs = told.where("xs is not null"), told.where("xs is null")
    # All are aligned: words that a passage with one partner covers may link the document to another one too.
    passages = stage_table(_aligned(rows, chained), "passages")
    inside = (F.col("a") == F.col("doc_id")) & (F.col("b") == F.col("other_id")) & (F.col("x0") >= F.col("first_word")) & (F.col("x1") <= F.col("last_word") + 1)
    inside &= (F.col("y0") >= F.col("other_first")) & (F.col("y1") <= F.col("other_last") + 1)
    members = runs.join(passages, inside, "left_anti")
    last = lambda end: (F.col(end) - 1).cast("int")
    members = members.select(F.col("a").alias("doc_id"), F.col("x0").alias("first_word"), last("x1").alias("last_word"), F.col("b").alias("other_id"), F.col("y0").alias("other_first"), last("y1").alias("other_last"), F.lit(1.0).alias("alike"))
    found = stage_table(passages.unionByName(members), "shared")
    apart = compared_places(seeded, anchors, bits, found).withColumn("n", F.lit(SEED)).repartition("a").sortWithinPartitions("a", "b", "x", "y")
    apart = stage_table(apart.mapInArrow(_chain_rows, CHAIN).where("xs is not null").withColumn("chain", F.monotonically_increasing_id()), "apart")
    found = stage_table(found.unionByName(_aligned(rows, apart)).distinct(), "all")
    classes = stage_table(passage_classes(found).select("doc_id", "class_id"), "classes")
    copied = copied_passages(every, copies).join(classes.withColumnRenamed("doc_id", "other_id"), "other_id", "left")
    copied = copied.withColumn("class_id", F.coalesce("class_id", "other_id"))
    return found.join(classes, "doc_id").unionByName(copied)


def op5_shared_passages(spark, sf_dir: str) -> DataFrame:
    """Shared passages of all documents."""
    return shared_passages(table(spark, sf_dir, "documents"))
