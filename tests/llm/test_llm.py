"""The corpus operators against brute force, on small tables with nulls, ties, repeats and odd columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from candela.llm import chat, decontam, exact_dedup, licenses, packing, quality, sharding, simhash, substring, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size int, spans string"
LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(30_000))
TEXTS = [
    None, "", " ", "a", "a", "A  b\tc", "a b c", "a b c ", "Released under the MIT License, or CC BY-SA 4.0", "the GNU General Public License, version 3",
    "one two three four five", "one two three four five six", LONG, LONG, "é É ß 日本 word", "mit license mit license",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", "s", 1, None, None, None) for k, t in enumerate(TEXTS)]
    rows.append((3, "a", None, None, None, None, None, None))  # a repeated row
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


# ---- 1


def check_packing(got, texts, capacity=2048):
    pieces, places = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    for doc, text in texts.items():
        ids = np.array(library_ids(text))
        at = 0
        for k, r in enumerate(sorted(pieces[doc], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and 0 < r.length <= capacity
            assert k == 0 or r.length == capacity
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].astype("<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_packing_places_every_piece(spark):
    texts = {k: t or "" for k, t in enumerate(TEXTS)}
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    packed = packing.pack_documents(docs, with_ids=True)
    got = packed.collect()
    n = check_packing(got, texts)
    assert n == -(-sum(r.length for r in got) // 2048)
    assert sum(len(r.ids) for r in packing.packed_sequences(packed).collect()) == sum(r.length for r in got)


def test_packing_query(spark):
    got = packing.op1_packing(spark, SF).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert check_packing(got, texts) <= -(-sum(r.length for r in got) // 2048) * 1.005 + 1


def test_packing_empty(none):
    assert packing.pack_documents(none).count() == 0


def library_ids(text):
    from tokenizers import Tokenizer

    library_ids.held = getattr(library_ids, "held", None) or Tokenizer.from_file(packing.default_tokenizer())
    return [*library_ids.held.encode(text, add_special_tokens=False).ids, 0]


def test_ids_equal_the_tokenizers_library():
    path = packing.default_tokenizer()
    for text in [*(t or "" for t in TEXTS), "<|endoftext|> x", "x<|endoftext|>", "I'LL 's  \r\n\n z", "🎉 ﬀ İK", "a" * 3000, "\x00\x01"]:
        assert packing.document_ids(text, path, added_tokens=True).tolist() == library_ids(text)


def test_the_linear_program_places_the_large_pieces(monkeypatch):
    rng = np.random.default_rng(6)
    counts = Counter(np.clip(rng.lognormal(6, 1, 20_000), 1, 2047).astype(int).tolist())
    through = 0
    own = packing.substitute

    def counted(runs, chosen, parts):
        nonlocal through
        through += sum(n * sum(config) for n, config in chosen)
        own(runs, chosen, parts)

    monkeypatch.setattr(packing, "substitute", counted)
    runs = packing.plan(counts)
    large = sum(n for k, n in counts.items() if k > packing.CAPACITY // packing.SMALL)
    assert through > 0.95 * large
    assert sum(n for n, _ in runs.all()) <= 1.005 * sum(k * n for k, n in counts.items()) / packing.CAPACITY + 1


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), max_size=30), st.sampled_from([4, 16]))
def test_plan_holds_every_piece_once(counts, groups):
    runs = packing.plan(counts, 64, groups)
    seen = []
    for n, places in runs.all():
        assert sum(length for length, _ in places) <= 64
        seen += [(at + k, length) for length, at in places for k in range(n)]
    assert [x[1] for x in sorted(seen)] == [x for x in sorted(counts) for _ in range(counts[x])]
    assert [x[0] for x in sorted(seen)] == list(range(sum(counts.values())))


def test_added_tokens_in_a_text_are_the_tokenizers_librarys(spark):
    texts = ["x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|><|endoftext|>b <|endoftext", *(t or "" for t in TEXTS)]
    packed = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), with_ids=True).collect()
    for k, text in enumerate(texts):
        assert [x for r in sorted((r for r in packed if r.doc_id == k), key=lambda r: r.piece) for x in r.ids] == library_ids(text)


# ---- 2


def feistel(x, n, seed):
    a, b = sharding.grid(n)
    left, right = divmod(x, b)

    def h(v, salt):
        out = 42
        for y in (v, salt):
            out = xxhash.xxh64_intdigest(int(y).to_bytes(8, "little", signed=True), out)
        return out - (1 << 64) if out >> 63 else out

    for k in range(sharding.ROUNDS):
        if k % 2 == 0:
            left = (left + h(right, seed * sharding.ROUNDS + k) % a) % a
        else:
            right = (right + h(left, seed * sharding.ROUNDS + k) % b) % b
    return left * b + right


def test_sharding_is_the_permutation(spark, docs):
    got = sharding.shard_rows(docs, 4, seed=5).collect()
    rows = sorted((d, zlib.crc32(t.encode()), len(t.encode()) + 1) for d, t in rows_of(docs))
    n = len(rows)
    want = []
    for k, (doc, crc, size) in enumerate(rows):
        x = feistel(k, n, 5)
        while x >= n:
            x = feistel(x, n, 5)
        want.append((doc, size, crc, x % 4, x // 4))
    assert sorted(want) == sorted((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got)


def test_sharding_query_is_even_and_gapless(spark):
    got = sharding.op2_feistel_shards(spark, SF).collect()
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r.slot)
    assert set(shards) == set(range(16)) and max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in shards.values())
    again = sharding.op2_feistel_shards(spark, SF).collect()
    assert sorted(got) == sorted(again)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 97])
def test_permutation_of_any_size(spark, n):
    from pyspark.sql import functions as F

    passes = sharding.longest_walk(spark, n, 3)
    got = [r.p for r in spark.range(n).select(sharding.permuted(F.col("id"), n, 3, passes).alias("p")).collect()]
    assert sorted(got) == list(range(n))


def test_sharding_empty(none):
    assert sharding.shard_rows(none).count() == 0


# ---- 3


def test_exact_dedup(docs):
    got = exact_dedup.exact_dedup(docs).collect()
    groups = defaultdict(list)
    for doc, text in rows_of(docs):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text)].append(doc)
    want = []
    for text, ids in groups.items():
        sha = hashlib.sha256(text.encode()).hexdigest()
        for k, doc in enumerate(sorted(ids)):
            want.append((doc, min(ids), len(ids), k == 0, sha))
    assert sorted(map(tuple, got)) == sorted(want)


def test_exact_dedup_stage_keeps_columns_and_one_row_a_group(docs):
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({re.sub(r"[\x20\x09-\x0D]+", " ", t) for _, t in rows_of(docs)})


def test_exact_dedup_empty(none):
    assert exact_dedup.exact_dedup(none).count() == 0
    assert exact_dedup.drop_exact_copies(none).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 20_000])
def test_filter_knows_its_keys(n):
    keys = np.random.default_rng(n).integers(0, 1 << 60, n, dtype=np.uint64)
    built = exact_dedup.build_filter(keys)
    assert exact_dedup.maybe_in(keys, *built).all()
    others = np.random.default_rng(n + 1).integers(0, 1 << 60, 50_000, dtype=np.uint64)
    assert exact_dedup.maybe_in(others, *built).mean() < 0.01


# ---- 4


def test_license_scan(docs):
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    for doc, text in rows_of(docs):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        at = {k: [i for i in range(len(words)) if words[i : i + len(p.split())] == p.split()] for k, (_, p) in enumerate(licenses.BASE + licenses.MORE)}
        base = [i for k in range(4) for i in at[k]]
        r = got[doc]
        assert (r.n_words, r.n_base) == (len(words), len(base))
        assert (r.first_word, r.last_word) == ((min(base), max(base)) if base else (None, None))
        assert r.base_labels == ",".join(sorted({licenses.BASE[k][0] for k in range(4) if at[k]}))
        assert r.labels == ",".join(sorted({(licenses.BASE + licenses.MORE)[k][0] for k in at if at[k]}))
        assert 0 <= r.score <= 1


def test_license_templates_align_and_verify(spark):
    """The key phrase alone, within its notice, a notice whose phrase is broken, and a scattered notice."""
    body = licenses.BODIES["gpl"]
    broken = body.replace("general public", "general and public")
    scattered = " filler ".join(body.replace("gnu general public license", "gnu license").split())
    texts = ["gnu general public license", f"x y {body} z", broken, scattered, "public license", body + " " + body]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert [got[k].base_labels for k in range(6)] == ["gpl", "gpl", "", "", "", "gpl"]
    assert got[1].score == 1.0 and got[5].score == 1.0 and got[5].n_base == 2
    templates, vocabulary = licenses.templates_of(licenses.BASE, licenses.MORE)
    files = [t.split() for t in texts]
    weight = [int(1000 * (np.log(7 / (sum(w in f for f in files) + 1)) + 1) + 0.5) for w in vocabulary]
    for doc, words in enumerate(files):
        best = 0.0
        for t in templates:
            names = [vocabulary[w] for w in t.phrase]
            rarest = max(t.phrase, key=lambda w: weight[w])
            if vocabulary[rarest] not in words:
                continue
            start_sums = [sum(weight[w] for place, w in t.body if 0 <= i + place < len(words) and words[i + place] == vocabulary[w]) for i in range(-40, len(words) + 40)]
            stands = any(words[i : i + len(names)] == names for i in range(len(words)))
            best = max(best, 0.5 * stands + 0.5 * max(start_sums) / sum(weight[w] for _, w in t.body))
        assert abs(got[doc].score - best) < 1e-6
    assert got[3].score < got[2].score < 0.5 < got[0].score < 1.0
    assert got[4].score < got[0].score and got[1].first_word == 2 + body.split().index("gnu")


def test_license_scan_empty(none):
    assert licenses.scan_licenses(none).count() == 0


# ---- 5


def test_shared_passages_finds_planted_ones(spark):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 6))
    passage = [word() for _ in range(60)]
    fuzzy = list(passage)
    fuzzy[30] = "other"
    rows = [(k, " ".join([word() for _ in range(100)] + (passage if k % 2 else fuzzy) + [word() for _ in range(80)])) for k in range(6)]
    rows += [(100 + k, " ".join(word() for _ in range(300))) for k in range(6)] + [(200, None), (201, ""), (None, rows[0][1])]
    got = substring.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} | {r.other_id for r in got} == set(range(6))
    assert all(r.first_word == 100 and r.last_word == 159 and r.other_first == 100 for r in got)


def uncovered(texts, got):
    """Words of runs of LEAST_WORDS that a smaller id holds too, and that no passage tells of."""
    n, first, out = substring.LEAST_WORDS, {}, []
    for doc in sorted(texts):
        words = texts[doc].split()
        told = {k for r in got if r.doc_id == doc for k in range(r.first_word, r.last_word + 1)}
        for k in range(len(words) - n + 1):
            if first.setdefault(tuple(words[k : k + n]), doc) != doc:
                out += [(doc, x) for x in range(k, k + n) if x not in told]
    return out


def test_shared_passages_through_partial_sharers(spark):
    texts = {}
    for trial in range(12):
        p = [f"p{trial}x{k}" for k in range(60)]
        for doc in range(1, 10):
            own = {1: p[:40], 7: p[:40], 2: p[20:], 8: p[20:], 5: p, 9: p}.get(doc, [])
            fill = [[f"f{trial}x{doc}x{side}x{k}" for k in range(70)] for side in (0, 1)]
            texts[trial * 10 + doc] = " ".join(fill[0] + own + fill[1])
    got = substring.shared_passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert not uncovered(texts, got)


def test_shared_passages_of_repeated_words(spark):
    texts = {k: " ".join(["a"] * 40 * k + ["b", "c"] * 50 + [f"w{k}"] * 60) for k in range(1, 5)}
    got = substring.shared_passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert not uncovered(texts, got)


def test_shared_passages_when_a_better_chain_gives_none(spark):
    texts = {}
    for trial in range(12):
        w = [f"p{trial}x{k}" for k in range(55 + 20 + 45)]
        fill = lambda tag, n: [f"{tag}{trial}x{k}" for k in range(n)]  # noqa: E731, B023
        texts[trial * 10 + 1] = " ".join(fill("q", 70) + w[:55] + fill("r", 70))
        texts[trial * 10 + 2] = " ".join(fill("s", 70) + w[:49] + fill("t", 26) + w[75:] + fill("u", 70))
        texts[trial * 10 + 3] = " ".join(fill("v", 70) + w + fill("x", 70))
    got = substring.shared_passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert not uncovered(texts, got)


def test_shared_passages_with_all_partners_of_covered_words(spark):
    # All of the third's words are in its passage with the second; the first holds some of them, one edited, so that no run of LEAST_WORDS is shared.
    texts = {}
    for trial in range(6):
        p = [f"p{trial}x{k}" for k in range(120)]
        some = [w if k != 45 else "edited" for k, w in enumerate(p)][:90]
        for doc, own in {1: some, 2: p, 3: p}.items():
            texts[10 * trial + doc] = " ".join([f"f{trial}x{doc}x{k}" for k in range(70)] + own + [f"g{trial}x{doc}x{k}" for k in range(70)])
    got = substring.shared_passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {(r.doc_id, r.other_id) for r in got} == {(10 * t + a, 10 * t + b) for t in range(6) for a, b in ((2, 1), (3, 1), (3, 2))}


def test_word_numbers_are_of_the_words_alone():
    texts = ["", "ab", "cd ", "Ab-ab abcdefgh abcdefghi", "\u00e9l\u00e9ment\u00e9 x", "x" * 100 + " " + "x" * 99, "", "z"]
    seen, names = {}, {}
    for text, numbers in zip(texts, substring.worded(pa.array(["left out", *texts])[1:])):
        words = decontam.words_of(text)
        assert len(words) == len(numbers) and (substring.word_numbers(text) == numbers).all()
        for word, number in zip(words, numbers.tolist()):
            assert seen.setdefault(word, number) == number and names.setdefault(number, word) == word


def stretches_by_recursion(gain, at=0):
    """The definition: the stretch of the largest sum, then those before and after it in the same way."""
    best, where = 0, None
    for s in range(len(gain)):
        total = 0
        for e in range(s, len(gain)):
            total += gain[e]
            if total > best or total == best and where and e + 1 - s > where[1] - where[0]:
                best, where = total, (s, e + 1)
    if where is None:
        return []
    s, e = where
    return [*stretches_by_recursion(gain[:s], at), (at + s, at + e), *stretches_by_recursion(gain[e:], at + e)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([1, -4]), max_size=60), st.integers(1, 5))
def test_best_stretches(gain, least):
    kept, substring.LEAST_WORDS = substring.LEAST_WORDS, least
    try:
        got = substring.best_stretches(np.array(gain, int))
    finally:
        substring.LEAST_WORDS = kept
    total = lambda p: sum(gain[p[0] : p[1]])
    want = [p for p in stretches_by_recursion(gain) if p[1] - p[0] >= least]
    assert [total(p) for p in got] == [total(p) for p in want] or sum(map(total, got)) >= sum(map(total, want))
    assert all(a[1] <= b[0] for a, b in zip(got, got[1:]))


def test_thousands_of_passages_in_one_chain():
    gain = np.tile(np.concatenate((np.ones(60), np.full(60, -4))), 5_000)
    assert substring.best_stretches(gain) == [(120 * k, 120 * k + 60) for k in range(5_000)]


def holders(texts):
    """Documents of each run of LEAST_WORDS words."""
    out = defaultdict(set)
    for doc, text in texts.items():
        words = text.split()
        for k in range(len(words) - substring.LEAST_WORDS + 1):
            out[tuple(words[k : k + substring.LEAST_WORDS])].add(doc)
    return out


def test_members_of_a_run_name_its_first_document(spark):
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 6))
    passages = [[word() for _ in range(int(n))] for n in rng.integers(50, 150, 12)]
    texts = {}
    for doc in range(60):
        parts = [word() for _ in range(30)]
        for k in rng.choice(12, 3, replace=False):
            p = passages[k]
            cut = sorted(rng.integers(0, len(p) + 1, 2)) if rng.random() < 0.5 else (0, len(p))
            parts += p[cut[0] : cut[1]] + [word() for _ in range(int(rng.integers(1, 40)))]
        texts[doc] = " ".join(parts)
    got = substring.shared_passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    words = {d: t.split() for d, t in texts.items()}
    classes = {}
    for r in got:
        assert classes.setdefault(r.doc_id, r.class_id) == r.class_id <= r.other_id < r.doc_id
    for run, docs in holders(texts).items():
        first = min(docs)
        for doc in docs - {first}:
            at = [k for k in range(len(words[doc])) if tuple(words[doc][k : k + len(run)]) == run]
            rows = [r for r in got if r.doc_id == doc and r.other_id == first]
            assert any(r.first_word <= k and k + len(run) - 1 <= r.last_word for r in rows for k in at), (doc, first)
            assert first not in classes or classes[doc] == classes[first]


@pytest.mark.parametrize(("alike", "least"), [(0.9, 0.9), (0.95, 0.95), (1.0, 1.0)])
def test_recall_of_passages(spark, alike, least):
    rng = np.random.default_rng(int(100 * alike))
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 6))
    texts, places = {}, {}
    for group in range(60):
        passage = [word() for _ in range(int(rng.integers(80, 240)))]
        for member in range(int(rng.integers(2, 5))):
            own = list(passage)
            if member:
                for k in rng.choice(len(own), round((1 - alike) * len(own)), replace=False):
                    own[k] = word()
            lead = int(rng.integers(0, 120))
            doc = len(texts)
            texts[doc] = " ".join([word() for _ in range(lead)] + own + [word() for _ in range(int(rng.integers(0, 120)))])
            places[doc] = (group, member, lead, lead + len(own))
    got = defaultdict(set)
    for r in substring.shared_passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect():
        got[r.doc_id].update(range(r.first_word, r.last_word + 1))
        assert places[r.doc_id][0] == places[r.other_id][0]
    # Every later member of a group is alike to a smaller id, word by word.
    later = [doc for doc, p in places.items() if p[1]]
    found = [len(got[d] & set(range(*places[d][2:]))) >= 0.5 * (places[d][3] - places[d][2]) for d in later]
    assert np.mean(found) >= least, np.mean(found)


def test_shared_passages_of_repeated_ids_and_hot_documents(spark, monkeypatch):
    monkeypatch.setattr(substring, "REQUESTS", 2)
    p = " ".join(f"p{k}" for k in range(60))
    rows = [(k, f"own{k} {p} end{k}") for k in range(9)] + [(3, p), (3, "zzz"), (None, p), (None, p), (20, None)]
    got = substring.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == set(range(1, 9)) and {r.class_id for r in got} == {0}
    links = {r.doc_id: r.links for r in substring.passage_classes(spark.createDataFrame([(r.doc_id, r.other_id) for r in got], "doc_id long, other_id long")).collect()}
    assert set(links) == set(range(9)) and min(links.values()) >= 1


def test_passages_between_later_sharers_of_common_seeds(spark):
    # Every seed of the passage has a document before, and one between, the two that hold all of it; none of those shares 50 words.
    texts = {}
    for trial in range(6):
        p = [f"p{trial}x{k}" for k in range(80)]
        edited = [w if k != 40 else "edited" for k, w in enumerate(p)]
        parts = {0: p[:36], 1: p[18:58], 2: p[44:], 3: p, 4: p[:36], 5: p[18:58], 6: p[44:], 7: edited}
        for doc, own in parts.items():
            texts[trial * 10 + doc] = " ".join([f"f{trial}x{doc}x{k}" for k in range(70)] + own + [f"g{trial}x{doc}x{k}" for k in range(70)])
    got = substring.shared_passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {(r.doc_id, r.other_id, r.class_id) for r in got} == {(10 * t + 7, 10 * t + 3, 10 * t + 3) for t in range(6)}


def test_key_pairs_over_blocks_are_all_pairs():
    rng = np.random.default_rng(2)
    n = 200
    c, doc, x1 = rng.integers(-1, 3, n), rng.integers(0, 80, n), rng.integers(0, 500, n)
    x2, block = x1 + rng.integers(1, substring.NEAR, n), rng.integers(0, 3, n)
    rows = list(zip(c.tolist(), doc.tolist(), x1.tolist(), x2.tolist()))
    near = lambda p, q: p[3] - p[2] + q[3] - q[2] < substring.NEAR + substring.SEED
    want = sorted((q[1], p[1], q[2], q[3], p[2], p[3]) for p in rows for q in rows if p[1] < q[1] and (p[0] != q[0] or p[0] < 0) and near(p, q))
    tiles = []
    for low in range(3):
        for high in range(low, 3):
            at = np.flatnonzero((block == low) | (block == high))
            at = at[np.argsort(block[at], kind="stable")]
            tiles.append(pa.RecordBatch.from_arrays([pa.array(v) for v in (np.zeros(len(at), int), np.full(len(at), low), np.full(len(at), high), block[at], c[at], doc[at], x1[at], x2[at])], list("klhocdxy")))
    cut = [b.slice(s, 7) for b in tiles for s in range(0, b.num_rows, 7)]
    got = [tuple(r.values()) for b in substring._compared_rows(iter(cut)) for r in b.to_pylist()]
    assert sorted(got) == want


def test_places_with_equal_words_around_are_compared_once():
    # A line of 12 words 60 times in each of two documents: without the words around, each place meets all of the other's.
    line = [f"w{k}" for k in range(12)]
    marks = substring.word_marks(substring.word_numbers(" ".join(line * 60)))
    rows = [(None, None, d, None, None, marks) for d in (1, 2)]
    rows += [(7, -1, d, 12 * n, 12 * n + 4, None) for d in (1, 2) for n in range(60)]
    rows.sort(key=lambda r: (r[2], r[0] is not None))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    batch = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], ["k", "c", "doc", "x1", "x2", "marks"])
    kept = [r for b in substring._around_rows(iter([batch.slice(0, 50), batch.slice(50)])) for r in b.to_pylist()]
    assert sorted({r["x1"] for r in kept if r["doc"] == 2}) == [12 * n for n in (0, 1, 2, 3, 4, 56, 57, 58, 59)]


def test_many_of_a_class_meet_a_place_once_if_it_is_a_passage():
    rng = np.random.default_rng(4)
    words = rng.integers(0, 2**63, 120).astype(np.uint64)
    near = [substring.around(substring.word_marks(words), 50, 60)]
    for n in range(30):
        own = words.copy()
        own[rng.integers(0, 120, n)] = 1
        own[50:65] = words[50:65]
        near.append(substring.around(substring.word_marks(own), 50, 60))
    n = len(near)
    c, doc, at = np.array([-1] + [5] * (n - 1)), np.arange(n)[::-1].copy(), np.full(n, 50)
    marks = np.frombuffer(b"".join(near), np.uint8).reshape(n, -1)
    assert len(substring.key_pairs(c, doc, at, at + 10, np.zeros(n, int), marks)[0]) == 1
    # Where none is a passage by itself, all that may be pieces of one stay.
    apart = marks.copy()
    apart[1:, : substring.SIDE - 4] = 255 - apart[0, : substring.SIDE - 4]
    apart[1:, 4 - substring.SIDE :] = 255 - apart[0, 4 - substring.SIDE :]
    assert len(substring.key_pairs(c, doc, at, at + 10, np.zeros(n, int), apart)[0]) > substring.FEW


def test_shared_passages_empty(none):
    assert substring.shared_passages(none).count() == 0


def test_chain_follows_order_in_both_texts():
    x, y = np.array([0, 10, 20, 40, 12]), np.array([5, 15, 25, 47, 90])
    best = substring.chains(x, y)[0][2]
    assert [s[0] for s in best] == sorted(s[0] for s in best) and best[0][0] == 0


# ---- 6, 10


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in toxicity.op6_toxicity(spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    marks = [(r.toxic, got[r.doc_id]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(g.toxic for t, g in marks if t) >= 0.9 * sum(t for t, _ in marks)
    assert sum(g.toxic for t, g in marks if not t) <= 0.005 * len(marks)
    assert {g.grade for t, g in marks if t} == {0, 1, 2, 3}
    assert all(g.toxic == (g.grade > 0) for _, g in marks)


def brute_chances(model, text):
    words = Counter(re.findall(r"[^\W\d_]+", text.lower()))
    has, times = set(), 0
    for w, n in words.items():
        own = {f for f in [w, *(w[:k] + "*" for k in toxicity.STARTS if len(w) >= k)] if f in model.number}
        has |= own
        times += n * bool(own)
    z = sum(model.weights[model.number[f]] for f in has) + model.weights[-1] * np.log1p(times)
    return [1 / (1 + np.exp(t - z)) for t in model.limits]


def test_toxicity_scores_equal_brute_force(docs):
    model = toxicity.Severity({"mit": 0, "licens*": 1, "w1x1": 2, "é": 3}, np.array([0.5, -1.0, 2.0, 0.3, 0.7]), np.array([-1.0, 0.5, 2.0]), 0.4)
    got = sorted(toxicity.score_toxicity(docs, model).collect())
    want = sorted((d, sum(p), sum(x >= 0.4 for x in p), p[0], p[0] >= 0.4) for d, t in rows_of(docs) for p in [brute_chances(model, t)])
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert (g.doc_id, g.grade, g.toxic) == (w[0], w[2], w[4]) and (g.severity, g.p_toxic) == pytest.approx((w[1], w[3]))


def test_ordinal_slope_is_that_of_the_loss():
    rng = np.random.default_rng(2)
    rows = toxicity.Rows.of([sorted(set(rng.integers(0, 6, 3).tolist())) for _ in range(40)], rng.random(40).tolist())
    grade, values = rng.integers(0, 4, 40), rng.normal(size=7 + toxicity.GRADES)
    limits = values[7] + np.concatenate(([0], np.cumsum(np.exp(values[8:]))))
    p = 1 / (1 + np.exp(limits[None, :] - rows.dot(values[:7])[:, None]))
    p = np.concatenate((np.ones((40, 1)), p, np.zeros((40, 1))), axis=1)
    loss, slope = toxicity.ordinal_loss(values, rows, grade, 0.5)
    assert loss == pytest.approx(-np.log(p[np.arange(40), grade] - p[np.arange(40), grade + 1]).sum() + 0.25 * (values[:7] ** 2).sum())
    for k in range(len(values)):
        step = np.zeros_like(values)
        step[k] = 1e-5
        assert slope[k] == pytest.approx((toxicity.ordinal_loss(values + step, rows, grade, 0.5)[0] - toxicity.ordinal_loss(values - step, rows, grade, 0.5)[0]) / 2e-5, abs=1e-4)


def test_toxicity_learns_ordered_grades():
    rng = np.random.default_rng(4)
    has = [sorted(rng.choice(8, rng.integers(0, 6), replace=False).tolist()) for _ in range(600)]
    rows = toxicity.Rows.of(has, [np.log1p(len(h)) for h in has])
    grade = np.digitize([len([k for k in h if k < 4]) for h in has], [1, 2, 3])
    model = toxicity.fit_rows({str(k): k for k in range(8)}, rows, grade)
    assert (np.diff(model.limits) > 0).all()
    severity = model.chances(rows).sum(axis=1)
    assert [severity[grade == k].mean() for k in range(4)] == sorted(severity[grade == k].mean() for k in range(4))
    assert np.abs(severity - grade).mean() < 0.2


def test_toxicity_of_odd_labels(spark):
    rows = [(k, "clean words here" if k % 2 else "vile words here vile") for k in range(40)] + [(None, "vile"), (3, None), (3, "vile"), (50, "")]
    labels = [(k, 1 - k % 2) for k in range(40)] + [(None, 1), (2, 0), (2, 1), (5, None), (7, 9), (900, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = toxicity.score_toxicity(docs, model).collect()
    assert len(got) == len(rows)
    assert {r.doc_id for r in got if r.toxic} >= {k for k in range(0, 40, 2)} and not any(r.toxic for r in got if r.doc_id in (50, 1))
    assert toxicity.train(docs.limit(0), spark.createDataFrame(labels, "doc_id long, toxic int")).number == {}


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in quality.op10_quality(spark, sf).collect()}
    for doc, r in got.items():
        assert r.held_out == (zlib.crc32(str(doc).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    marks = [(r.quality, got[r.doc_id].predicted) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert np.mean([q == p for q, p in marks]) > 0.95


def brute_features(text):
    words, size = text.encode().split(), len(text.encode())
    n = len(words)
    if not n:
        return [0.0] * len(quality.NAMES)
    raw = text.encode()
    upper, digits, spaces = (sum(1 for c in raw if chr(c) in x) for x in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\n\v\f\r"))
    lower = sum(1 for c in raw if 97 <= c <= 122 or c >= 128)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = [x for k, x in enumerate(lines) if x in lines[:k]]
    grams = lambda k: [tuple(words[i : i + k]) for i in range(n - k + 1)]
    most = lambda xs: max(Counter(xs).values(), default=0)
    odd = sum(1 for c in raw if not (chr(c).isalnum() and c < 128) and c < 128 and chr(c) not in " \t\n\v\f\r.,;:!?'\"-()")
    return [
        np.log(1 + n), np.log(1 + size), sum(map(len, words)) / n, sum(len(w) > 15 for w in words) / n, len(set(words)) / n, most(words) / n, most(grams(2)) / n,
        upper / max(1, upper + lower), (size - upper - lower - digits - spaces) / size, digits / size, spaces / size, len(lines) / n, len(repeated) / len(lines),
        sum(map(len, repeated)) / size, sum(w == b"|" for w in words) / n, raw.count(b"!") / n, sum(chr(w[-1]) in "*$&%#@^~<>{}|=+_\\!" for w in words) / n,
        (raw.count(b". ") + raw.count(b".\n") + raw.endswith(b".")) / n, sum(len(w) <= 3 for w in words) / n, sum(65 <= w[0] <= 90 for w in words) / n,
        sum(a == b for a, b in grams(2)) / n, odd / size, len(set(grams(4))) / n, len(zlib.compress(raw, 1)) / size,
    ]


def test_quality_scores_equal_brute_force(spark, docs):
    texts = [t for _, t in rows_of(docs) if len(t) < 5_000] + ["A a\nA a\n\n* | |! x.y. \x00\x7f $$", "x" * 40 + " | 12 ab.\ncd ef gh ij kl ef gh ij kl", "É é? (Ok) -"]
    for t in texts:
        assert quality.features(t) == pytest.approx(brute_features(t), rel=5e-3), t
    rng = np.random.default_rng(8)
    n = len(quality.NAMES)
    model = quality.Ranking(rng.normal(size=n), rng.random(n) + 0.5, rng.normal(size=2 * n), 0.3, 1.0)
    got = sorted((r.doc_id, r.score, r.predicted) for r in quality.score_quality(docs, model).collect())
    want = []
    for doc, text in rows_of(docs):
        z = [min(4.0, max(-4.0, (v - m) / s)) for v, m, s in zip(quality.features(text), model.mean, model.spread)]
        worth = sum(w * v for w, v in zip(model.weights, [*z, *(v * v for v in z)]))
        score = 1 / (1 + np.exp(-(worth - 0.3 + np.log(0.7 / 0.3))))
        want.append((doc, score, int(score >= 0.7)))
    for g, w in zip(got, sorted(want)):
        assert g == (w[0], pytest.approx(w[1]), w[2])


def test_quality_weights_lessen_the_pairwise_loss():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, len(quality.NAMES)))
    good = (x[:, 0] - x[:, 3] > 0).astype(int)
    model = quality.fit(x, good)
    worth = model.worth(x)
    wins = np.mean([worth[a] > worth[b] for a in np.flatnonzero(good == 1)[:60] for b in np.flatnonzero(good == 0)[:60]])
    assert wins > 0.97
    # The threshold leaves out the labelled share of bad rows.
    assert np.mean(model.scores(x) >= quality.THRESHOLD) == pytest.approx(good.mean(), abs=0.01)


def test_quality_learns_from_every_labelled_row(spark, monkeypatch):
    monkeypatch.setattr(quality, "BINS", 16)
    n = 11_000
    texts = [(k, "plain words that say something. " * (1 + k % 7) + ("$$ ## " * (k % 5) if k % 3 == 0 else "")) for k in range(n)]
    docs, labels = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(k, int(k % 3 != 0)) for k in range(n)], "doc_id long, quality int")
    learned = [(k, t) for k, t in texts if zlib.crc32(str(k).encode()) % 4 != 2]
    x, good = quality.matrix([t for _, t in learned]), np.array([int(k % 3 != 0) for k, _ in learned])
    model = quality.train(docs, labels)
    assert model.mean == pytest.approx(x.mean(axis=0), rel=1e-9)
    assert model.spread == pytest.approx(x.std(axis=0) + 1e-6, rel=1e-6, abs=1e-9)
    assert model.middle == pytest.approx(np.quantile(model.worth(x), (good == 0).mean()), rel=1e-9)
    monkeypatch.setattr(quality, "BLOCK", 20_000)
    assert quality.train(docs, labels).weights == pytest.approx(quality.fit(x, good).weights, abs=1e-6)


def test_quality_of_odd_labels(spark):
    rows = [(k, f"A fine sentence number {k}, with words." if k % 2 else "$$ ## $$ ##") for k in range(40)] + [(None, "x"), (3, None), (3, "y"), (50, "")]
    labels = [(k, k % 2) for k in range(40)] + [(None, 1), (2, 0), (2, 1), (5, None), (900, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = quality.score_quality(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    assert quality.drop_poor(docs, model).columns == docs.columns


def test_compression_is_of_whole_texts():
    rng = np.random.default_rng(5)
    head = " ".join("".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(800))
    at = quality.NAMES.index("compressed")
    for tail in (" spam" * 40_000, " " + head[::-1]):
        raw = (head + tail).encode()
        assert quality.features(head + tail)[at] == pytest.approx(len(zlib.compress(raw, 1)) / len(raw), rel=1e-3)
    assert quality.features(head + " spam" * 40_000)[at] < 0.1


def test_quality_degenerate(spark, docs, none):
    model = quality.fit(np.zeros((0, len(quality.NAMES))), np.zeros(0, int))
    assert quality.score_quality(none, model).count() == 0
    assert quality.score_quality(docs, quality.fit(quality.matrix(["a b", "c"]), np.array([1, 0]))).count() == docs.count()


# ---- 7


def brute_fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_fingerprints_equal_spark_hashes(spark, docs):
    from pyspark.sql import functions as F

    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % (1 << 64) == xxhash.xxh64_intdigest("a b c", 42)
    for _, text in rows_of(docs):
        assert simhash.fingerprint(text) == brute_fingerprint(text)


def brute_components(fps):
    out = {k: k for k in fps}

    def find(x):
        while out[x] != x:
            x = out[x]
        return x

    ids = sorted(fps)
    for i in ids:
        for j in ids:
            if j > i and (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                out[max(a, b)] = min(a, b)
    return {k: find(k) for k in ids}


def test_simhash_query(spark):
    got = simhash.op7_simhash(spark, SF).collect()
    fps = {r.doc_id: int(r.fingerprint, 16) for r in got}
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert fps == {k: brute_fingerprint(t) for k, t in texts.items()}
    assert {r.doc_id: r.component_id for r in got} == brute_components(fps)


def test_links_span_dense_lists(spark):
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 1 << 62))
    fps = sorted({base ^ int(1 << a) ^ int(1 << b) for a, b in rng.integers(0, 62, (300, 2))} | {int(x) for x in rng.integers(0, 1 << 62, 200)})
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    links = simhash.near_links(nodes, len(fps)).collect()
    assert all((r.a ^ r.b).bit_count() <= 3 for r in links)
    want = brute_components(dict(enumerate(fps)))
    at = {f: k for k, f in enumerate(fps)}
    found = {r.node: r.root for r in simhash.components(simhash.near_links(nodes, len(fps)), "a", "b").collect()}
    groups = defaultdict(set)
    for f in fps:
        groups[found.get(f, f)].add(at[f])
    wanted = defaultdict(set)
    for k, root in want.items():
        wanted[root].add(k)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_near_dedup_stage(docs, none):
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    fps = {d: brute_fingerprint(t) for d, t in rows_of(docs)}
    assert Counter(r.doc_id for r in kept.collect()) == Counter(set(brute_components(fps).values()))
    assert simhash.drop_near_copies(none).count() == 0


def test_near_dedup_stage_settles_repeated_and_null_ids_row_by_row(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(None, text(1)), (None, text(2)), (None, text(3)), (1, text(3)), (2, text(4)), (2, text(5)), (3, text(5)), (4, text(6)), (4, text(6)), (5, text(7)), (5, text(3)), (None, text(2)), (6, text(8))]
    kept = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([(None, text(1)), (None, text(2)), (1, text(3)), (2, text(4)), (2, text(5)), (4, text(6)), (5, text(7)), (6, text(8))])


# ---- 8


def brute_contamination(text, items):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.encode().lower())
    hit, found = set(), set()
    for name, item in items:
        own = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", item.encode().lower())
        n = min(13, len(own))
        windows = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if own else set()
        for k in range(len(words) - n + 1):
            if tuple(words[k : k + n]) in windows:
                hit |= set(range(k, k + n))
                found.add(name)
    return len(words), len(hit), found


def test_parts_of_an_item_hold_all_its_windows():
    words = [b"%d" % k for k in range(200)]
    for n in (0, 5, 13, 14, 26, 27, 200):
        parts = list(decontam.cut_item(words[:n], 3))
        windows = {tuple(p[k : k + 13]) for p in parts for k in range(len(p) - 12)}
        assert windows == {tuple(words[k : k + 13]) for k in range(n - 12)}
        assert all(len(p) <= 26 for p in parts) and (n >= 13 or parts == [words[:n]])


WORDS = st.lists(st.sampled_from("abcd"), max_size=40).map(" ".join)


@settings(max_examples=150, deadline=None)
@given(WORDS, st.lists(WORDS, max_size=5))
def test_decontamination_equals_brute_force(text, items):
    named = list(enumerate(items))
    block = decontam.build_block([(k, decontam.words_of(t)) for k, t in named])
    hit, found = decontam.hits_of(decontam.words_of(text), [block])
    n_words, n_hit, want = brute_contamination(text, named)
    assert (len(hit), int(hit.sum()), found) == (n_words, n_hit, want)


def test_decontamination_in_blocks(spark, docs, none):
    bench = spark.createDataFrame([(1, "one two three four five"), (2, "word"), (3, None), (4, LONG[:400]), (5, "one two three four five")], "item_id long, text string")
    items = [(r.item_id, r.text or "") for r in bench.collect()]
    for block_words, pass_blocks in ((3, 1), (3, 2), (10_000, 4)):
        got = {r.doc_id: r for r in decontam.find_contamination(docs.dropDuplicates(["doc_id"]), bench, block_words=block_words, pass_blocks=pass_blocks).collect()}
        assert len(decontam.find_contamination(docs, bench, block_words=block_words, pass_blocks=pass_blocks).collect()) == docs.count()
        clean = decontam.drop_contaminated(docs, bench, block_words=block_words, pass_blocks=pass_blocks)
        assert clean.columns == docs.columns
        assert sorted((r.doc_id, r.text or "") for r in clean.collect()) == sorted((d, t) for d, t in rows_of(docs) if not got[d].contaminated)
        cut = {r.doc_id: r.text for r in decontam.remove_spans(docs, bench, block_words=block_words, pass_blocks=pass_blocks).collect()}
        assert cut[10] == "one two three four five" and len(cut[12]) < len(LONG) - 300
        for doc, text in rows_of(docs):
            n_words, n_hit, found = brute_contamination(text, items)
            r = got[doc]
            assert (r.n_words, r.n_hit, r.n_items) == (n_words, n_hit, len(found))
            assert r.items_sha256 == hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
            assert r.contaminated == (n_hit > 0 and 20 * n_hit >= n_words)
            assert sum(s["last"] - s["first"] + 1 for s in r.spans) == n_hit
    kept = decontam.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and not {10, 11, 14} & {r.doc_id for r in kept.collect()}
    assert decontam.find_contamination(none, bench).count() == 0
    assert decontam.find_contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def test_spans_are_cut():
    assert decontam.cut_spans("a, B c! d", [(1, 2)]) == "a, ! d"


# ---- 9


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet="<|>turnedsI[/]\\ \n", max_size=20), min_size=1, max_size=5))
def test_escapes_are_reversible(spark, texts):
    rows = [(1, k, "assistant" if k % 2 else "us\ner\\", t) for k, t in enumerate(texts)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    segments = chat.format_turns(turns)
    for r in segments.collect():
        assert r.segment.count(chat.OPEN) == 1 and r.segment.count(chat.CLOSE) == 1
    rows_placed = chat.placed(segments)
    got = chat.read_back(chat.examples(rows_placed), rows_placed).first()
    assert got.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in rows).encode()).hexdigest()
    loss = "".join(t for _, k, _, t in rows if k % 2)
    assert (got.loss_chars, got.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


CHAT = "conv_id long, turn long, role string, text string"


def test_examples_are_prefixes(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "one </s>"), (1, 2, "user", None), (1, 3, "assistant", "two"), (2, 0, "user", "x"), (None, 0, "assistant", "y"), (1, 3, "assistant", "two"), (1, None, "system", "s"), (1, 4, None, "")]
    segments = chat.placed(chat.format_turns(spark.createDataFrame(rows, CHAT)))
    own = chat.examples(segments)
    got = {(r.conv_id, r.example): r for r in chat.render_examples(own, segments).collect()}
    assert set(got) == {(1, 0), (1, 1), (1, 2), (None, 0)}
    assert got[1, 1].text.startswith(got[1, 0].text) and got[1, 2].text.startswith(got[1, 1].text)
    for key, reply in (((1, 0), "one </s>"), ((1, 1), "two"), ((1, 2), "two"), ((None, 0), "y")):
        r = got[key]
        assert chat.unescaped(r.text[r.loss_start : r.loss_start + r.loss_chars]) == reply
        assert r.text.endswith(chat.CLOSE) and r.loss_start + r.loss_chars + len(chat.CLOSE) == len(r.text)
    total = sum(len(r.text) for r in got.values())
    assert total == sum(r.formatted_chars for r in chat.read_back(own, segments).collect())


def test_read_back_depends_on_every_example(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", f"text {k}") for k in range(6)]
    segments = chat.placed(chat.format_turns(spark.createDataFrame(rows, CHAT)))
    own = chat.examples(segments)
    whole = chat.read_back(own, segments).first()
    for k in range(3):
        less = chat.read_back(own.where(f"example <> {k}"), segments).first()
        assert less.loss_sha256 != whole.loss_sha256 and less.loss_chars < whole.loss_chars and less.formatted_chars < whole.formatted_chars
    with pytest.raises(Exception, match="does not end with the turn"):
        chat.read_back(own.withColumn("chars", own["chars"] + 1), segments).collect()


def test_a_conversation_over_many_partitions(spark):
    rows = [(c, k, "assistant" if (k + c) % 3 else "user", "x" * ((7 * k + c) % 40)) for c, n in ((1, 3), (2, 900), (3, 2), (4, 300)) for k in range(n)]
    segments = chat.placed(chat.format_turns(spark.createDataFrame(rows, CHAT)))
    own = defaultdict(list)
    for r in sorted(segments.collect(), key=lambda r: (r.conv_id, r.turn)):
        own[r.conv_id].append(r)
    for parts in own.values():
        chars = replies = 0
        for k, r in enumerate(parts):
            assert (r.k, r.start, r.example) == (k, chars, replies)
            chars += len(r.segment)
            replies += r.loss_start is not None


def test_chat_empty(spark):
    segments = chat.placed(chat.format_turns(spark.createDataFrame([], CHAT)))
    assert chat.read_back(chat.examples(segments), segments).count() == 0


# ---- all

CLASHES = "b m __b __m __i __sha __fp __row row bucket bits own sha fp __dropped __wanted doc h chain __keep __new x0 k id".split()


def test_columns_whose_names_the_operators_use(spark, docs):
    from pyspark.sql import functions as F

    bench = spark.createDataFrame([(1, "one two three four five")], "item_id long, text string")
    odd = docs.select("doc_id", "text", *[F.lit(c).alias(c) for c in CLASHES])
    plain = docs.select("doc_id", "text")
    counted = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    for stage in (exact_dedup.drop_exact_copies, simhash.drop_near_copies, lambda d: decontam.drop_contaminated(d, bench), lambda d: decontam.drop_contaminated(d, bench, block_words=3, pass_blocks=1)):
        got = stage(odd)
        assert got.columns == odd.columns and counted(got) == counted(stage(plain))
    model = quality.fit(quality.matrix(["a b", "c"]), np.array([1, 0]))
    assert quality.drop_poor(odd, model).columns == odd.columns
    assert packing.pack_documents(odd).count() == packing.pack_documents(plain).count()
    assert counted(odd) == counted(plain) and sharding.shard_rows(odd).count() == docs.count()
    assert licenses.scan_licenses(odd).count() == docs.count() and exact_dedup.exact_dedup(odd).count() == docs.count()
    assert len(substring.shared_passages(odd).collect()) == len(substring.shared_passages(plain).collect())


# ---- the pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs_after = stage(spark, docs, SF)
        assert docs_after.columns == docs.columns, name
        docs = docs_after.cache()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == set(texts)
    check_packing(got, texts)
