"""Cross-tokenizer alignment against pairwise comparison of byte ranges, with both libraries' own ids."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from candela.llm import alignment
from candela.llm.packing import byte_alphabet, default_tokenizer

TEXTS = [
    None, "", " ", "  ", "a", "a b  c   d", "</s> <s> <unk> x", "<|endoftext|> y", "<0x41>", "▁x", "\x00\x01 q", "\t\n  \n x\r\n", "é ß İ ﬁ 日本語 🎉🎉",
    "the same text here", "the same text here", "x" * 4000, "word.\nNext line\n\n  indented   far ", " lead", "tail ", "a b  c 　d\x1c e", "word " * 3000 + "日本" * 50,
]


def library_tokens(text):
    """Ids and bytes by the libraries themselves, on the whole text."""
    held = library_tokens.__dict__
    if not held:
        import sentencepiece
        from tokenizers import Tokenizer

        held["a"] = Tokenizer.from_file(default_tokenizer())
        held["a"].encode_special_tokens = True
        held["b"] = sentencepiece.SentencePieceProcessor(model_file=alignment.default_pieces())
    if not text:
        return None
    a, b = held["a"].encode(" " + text, add_special_tokens=False).ids, held["b"].encode(text)
    letters = byte_alphabet()
    a_bytes = [bytes(letters[c] for c in held["a"].id_to_token(k)) for k in a]
    b_bytes = [bytes([int(s[3:5], 16)]) if held["b"].is_byte(k) else s.replace("▁", " ").encode() for k in b for s in [held["b"].id_to_piece(k)]]
    whole = (" " + text).encode()
    return (a, a_bytes, b, b_bytes) if b"".join(a_bytes) == whole == b"".join(b_bytes) else None


def brute(texts):
    """The contract's columns, by comparing every A token with every B token near it."""
    per, counts = [], Counter()
    for text in texts:
        found = library_tokens(text)
        if found is None:
            per.append((0, 0, [], [], ""))
            continue
        a, a_bytes, b, b_bytes = found
        ends_a, ends_b = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
        links = []
        low = 0
        for i, end in enumerate(ends_a):
            start = end - len(a_bytes[i])
            while ends_b[low] <= start:
                low += 1
            j = low
            while j < len(b) and ends_b[j] - len(b_bytes[j]) < end:
                links.append((a[i], b[j]))
                j += 1
        groups, at_a, at_b = [], 0, 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            own_a = [k for k, e in zip(a[at_a:], ends_a[at_a:]) if e <= cut]
            own_b = [k for k, e in zip(b[at_b:], ends_b[at_b:]) if e <= cut]
            groups.append(",".join(map(str, own_a)) + "|" + ",".join(map(str, own_b)))
            at_a, at_b = at_a + len(own_a), at_b + len(own_b)
        per.append((len(a), len(b), groups, links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
        counts.update(set(links))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    return [(n_a, n_b, len(g), len(ls), sum(counts[p] == best[p[0]] for p in ls), sum(counts[p] for p in ls), d) for n_a, n_b, g, ls, d in per]


COLUMNS = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()


def found(spark, texts, **options):
    docs = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)], "doc_id long, text string, row long")
    return [tuple(r)[1:] for r in sorted(alignment.align(docs, **options).select(*COLUMNS).collect())]


@pytest.mark.parametrize("options", [{}, {"work": 7}, {"work": 64, "pass_pairs": 40}])
def test_alignment_equals_brute_force(spark, options):
    texts = [t if options.get("work") != 7 or len(t or "") < 5000 else t[:2000] for t in TEXTS]
    assert found(spark, texts, **options) == brute(texts)


def test_alignment_of_the_given_table(spark):
    rows = sorted(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect())
    got = sorted(alignment.op12_cross_tokenizer(spark, "/root/testdata/sf0.001").collect())
    assert [r.doc_id for r in got] == [r.doc_id for r in rows]
    want = brute([r.text for r in rows])
    assert [tuple(r[c] for c in COLUMNS[1:]) for r in got] == want


def test_repeated_rows_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b")], "doc_id long, text string")
    got = alignment.align(docs).collect()
    assert len(got) == 3 and {r.doc_id for r in got} == {1, None}
    assert {r.count_sum for r in got} == {3 * got[0].n_links}
    assert alignment.align(docs.where("false")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(list("ab .'\n\t\r  \x1c1é日🎉<s>|")), max_size=40))
def test_stretches_give_the_libraries_ids(text):
    want, got = library_tokens(text), alignment.pair(default_tokenizer(), alignment.default_pieces()).ids([text, "other words"])[0]
    assert (want is None) == (got is None)
    if want:
        assert (got[0].tolist(), got[1].tolist()) == (want[0], want[2])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=30), st.lists(st.integers(1, 5), min_size=1, max_size=30), st.integers(1, 9))
def test_diagonals_cut_the_merge_into_equal_work(a, b, work):
    a, b = np.cumsum(a), np.cumsum(b)
    order = sorted([(e, 0) for e in a.tolist()] + [(e, 1) for e in b.tolist()])
    i, j = alignment.diagonals(a, b, work)
    for d, x, y in zip([*range(0, len(order), work), len(order)], i.tolist(), j.tolist()):
        assert (x, y) == (sum(k == 0 for _, k in order[:d]), sum(k == 1 for _, k in order[:d]))
