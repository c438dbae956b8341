"""Licence scan by a positional rare-token index, in Spark SQL expressions only.

A template is a stretch of a licence's text with a mandatory key phrase in it.
One pass over whole texts keeps, per file, the number of words and the
positions of licence words; document frequencies over all files give each
licence word its IDF. Templates are indexed by the rarest word of their key
phrase: a file's licence words, highest IDF first, are looked up there, and
only the templates found are candidates. The file's postings are taken relative
to a candidate's words; where many fall on one start, the template is aligned
there. The mandatory key phrase is verified apart from that, by intersecting
the postings of its words. A file with the whole phrase has its rarest word, so
the lookup loses no place.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.llm.common import ALNUM_WORD, stage_table, table, text_or_empty

#: Label, mandatory key phrase. The first four are the contract's base.
BASE = [
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
]
MORE = [
    ("agpl", "gnu affero general public license"),
    ("apache-2.0", "apache license version 2 0"),
    ("bsd", "bsd license"),
    ("bsd-notice", "without specific prior written permission"),
    ("cc-by-nc", "cc by nc"),
    ("cc-by-nd", "cc by nd"),
    ("cc-by-sa", "cc by sa"),
    ("gpl-2", "gnu general public license version 2"),
    ("gpl-3", "gnu general public license version 3"),
    ("lgpl", "gnu lesser general public license"),
    ("mit-notice", "associated documentation files"),
    ("mpl", "mozilla public license"),
]
#: The stretch of text around the key phrase, from the public licences' own notices.
BODIES = {
    "gpl": "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "agpl": "redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
    "lgpl": "redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "gpl-2": "under the terms of the gnu general public license version 2 as published by the free software foundation",
    "gpl-3": "under the terms of the gnu general public license version 3 as published by the free software foundation",
    "apache": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "apache-2.0": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "mit": "mit license copyright permission is hereby granted free of charge to any person obtaining a copy of this software",
    "mit-notice": "obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "bsd-notice": "may be used to endorse or promote products derived from this software without specific prior written permission",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0",
}
#: Words too common to be licence words, unless a key phrase holds them.
COMMON = set("a an and any as at be code copy file for form free in is it may not of or source terms the this to under use used v with without you".split())


class Template(NamedTuple):
    """label; the key phrase's word numbers; (place, word number) of the licence words, places from the phrase's start."""

    label: str
    is_base: bool
    phrase: list[int]
    body: list[tuple[int, int]]


def templates_of(base, more) -> tuple[list[Template], list[str]]:
    """The templates and the licence words, in order."""
    rows = [(label, phrase.split(), BODIES.get(label, phrase).split(), k < len(base)) for k, (label, phrase) in enumerate(base + more)]
    named = {w for _, phrase, _, _ in rows for w in phrase}
    vocabulary = sorted(named | {w for _, _, body, _ in rows for w in body if w not in COMMON})
    number = {w: k for k, w in enumerate(vocabulary)}
    out = []
    for label, phrase, body, is_base in rows:
        lead = next((k for k in range(len(body)) if body[k : k + len(phrase)] == phrase), None)
        if lead is None:
            raise ValueError(f"the text of {label} lacks its key phrase")
        out.append(Template(label, is_base, [number[w] for w in phrase], [(k - lead, number[w]) for k, w in enumerate(body) if w in number]))
    return out, vocabulary


def license_hits(docs: DataFrame, vocabulary: list[str], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_words, hits), staged: hits are the licence words' (position, word number), in order."""
    if any("k" in w for w in vocabulary):
        raise ValueError("lower() turns the Kelvin sign into k; licence words here have none")
    words = F.regexp_extract_all(F.lower(text_or_empty(text_col)), F.lit(ALNUM_WORD), F.lit(0))
    number = F.create_map(*[x for k, w in enumerate(vocabulary) for x in (F.lit(w), F.lit(k))])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), words.alias("__w"))
    placed = F.filter(F.transform("__w", lambda w, i: F.struct(i.cast("long").alias("at"), w.alias("word"))), lambda x: x["word"].isin(vocabulary))
    coded = F.transform(placed, lambda x: F.struct(x["at"].alias("at"), F.element_at(number, x["word"]).alias("word")))
    return stage_table(rows.select("doc_id", F.size("__w").cast("long").alias("n_words"), coded.alias("hits")), "hits")


def weights_of(hits: DataFrame, vocabulary: list[str]) -> list[int]:
    """The IDF of each licence word over all files, in thousandths; the result is as long as the vocabulary."""
    seen = hits.select(F.explode(F.array_distinct(F.transform("hits", lambda x: x["word"]))).alias("w")).groupBy("w").count()
    df = dict(seen.collect())
    n = hits.count()
    return [math.floor(1000 * (math.log((n + 1) / (df.get(k, 0) + 1)) + 1.0) + 0.5) for k in range(len(vocabulary))]


def _starts(word: Column, place: Column) -> Column:
    """Where a template would start by each posting of one of its words."""
    return F.transform(F.filter("hits", lambda x: x["word"] == word), lambda x: x["at"] - place)


def _phrase_starts(phrase: Column) -> Column:
    """Starts of a whole key phrase: its words' relative postings intersected, rarest word first."""
    rarest = F.element_at(phrase, 1)
    rest = F.slice(phrase, 2, F.size(phrase))
    return F.aggregate(rest, _starts(rarest["word"], rarest["place"]), lambda acc, p: F.array_intersect(acc, _starts(p["word"], p["place"])))


def _best_alignment(body: Column) -> Column:
    """The largest weight of a template's words that fall on one start."""
    votes = F.flatten(F.transform(body, lambda p: F.transform(_starts(p["word"], p["place"]), lambda at: F.struct(at.alias("at"), p["weight"].alias("weight")))))
    zero = F.struct(F.lit(None).cast("long").alias("at"), F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("best"))

    def step(acc, v):
        total = F.when(acc["at"] == v["at"], acc["sum"]).otherwise(F.lit(0).cast("long")) + v["weight"]
        return F.struct(v["at"].alias("at"), total.alias("sum"), F.greatest(acc["best"], total).alias("best"))

    return F.aggregate(F.sort_array(votes), zero, step, lambda acc: acc["best"])


def scan_licenses(docs: DataFrame, base=None, more=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: word count, base places, first and last of them, labels and a score.

    A label is given where its template is a candidate and its mandatory key
    phrase stands. score is the best of the candidates: half for the phrase,
    half times the IDF-weighted share of the template's licence words that fall
    on one start. Defined results: a null or empty text has no words and score
    0, as has a file without candidates; templates of one start count each;
    repeated rows are scanned each; an empty table gives an empty result.
    """
    base, more = base or BASE, more or MORE
    templates, vocabulary = templates_of(base, more)
    hits = license_hits(docs, vocabulary, id_col, text_col)
    weight = weights_of(hits, vocabulary)
    posting = lambda place, word: F.struct(F.lit(place).cast("long").alias("place"), F.lit(word).alias("word"), F.lit(weight[word]).cast("long").alias("weight"))
    index: dict[int, list[int]] = {}
    shapes = []
    for k, t in enumerate(templates):
        order = sorted(range(len(t.phrase)), key=lambda i: (-weight[t.phrase[i]], i))
        index.setdefault(t.phrase[order[0]], []).append(k)
        shapes.append(F.struct(F.array(*[posting(i, t.phrase[i]) for i in order]).alias("phrase"), F.array(*[posting(*p) for p in t.body]).alias("body"), F.lit(sum(weight[w] for _, w in t.body)).cast("long").alias("total")))
    rare_first = F.array(*[F.lit(w) for w in sorted(index, key=lambda w: (-weight[w], w))])
    filed = F.create_map(*[x for w, ks in index.items() for x in (F.lit(w), F.array(*[F.lit(k) for k in ks]))])
    has = F.array_distinct(F.transform("hits", lambda x: x["word"]))
    rows = hits.withColumn("__rare", F.array_intersect(rare_first, has))
    rows = rows.withColumn("__t", F.flatten(F.transform("__rare", lambda w: F.element_at(filed, w))))

    def judged(k):
        shape = F.element_at(F.array(*shapes), k + 1)
        return F.struct(k.alias("k"), _phrase_starts(shape["phrase"]).alias("at"), (_best_alignment(shape["body"]) / shape["total"]).alias("share"))

    rows = rows.withColumn("__c", F.transform("__t", judged)).select("doc_id", "n_words", "__c")
    verified = F.filter("__c", lambda c: F.size(c["at"]) > 0)
    names = F.array(*[F.lit(t.label) for t in templates])
    base_at = F.flatten(F.transform(F.filter("__c", lambda c: c["k"] < len(base)), lambda c: c["at"]))

    def labels(of: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda c: F.element_at(names, c["k"] + 1)))), ",")

    score = F.array_max(F.transform("__c", lambda c: F.when(F.size(c["at"]) > 0, 0.5).otherwise(0.0) + c["share"] * 0.5))
    return rows.select(
        "doc_id",
        "n_words",
        F.size(base_at).cast("long").alias("n_base"),
        F.array_min(base_at).alias("first_word"),
        F.array_max(base_at).alias("last_word"),
        labels(F.filter(verified, lambda c: c["k"] < len(base))).alias("base_labels"),
        labels(verified).alias("labels"),
        F.coalesce(F.round(score, 6), F.lit(0.0)).alias("score"),
    )


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licence scan of all documents."""
    return scan_licenses(table(spark, sf_dir, "documents"))


def _op4_sql() -> str:
    """The same rows by joins of words with template postings, grouped by start."""
    templates, vocabulary = templates_of(BASE, MORE)
    words = ", ".join(f"({k}, '{w}')" for k, w in enumerate(vocabulary))
    labels = ", ".join(f"({k}, '{t.label}', {t.is_base}, {len(t.phrase)})" for k, t in enumerate(templates))
    bodies = ", ".join(f"({k}, {place}, {w})" for k, t in enumerate(templates) for place, w in t.body)
    phrases = ", ".join(f"({k}, {place}, {w})" for k, t in enumerate(templates) for place, w in enumerate(t.phrase))
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), voc(word, text) AS (VALUES {words}), lab(t, label, is_base, n) AS (VALUES {labels}),
body(t, place, word) AS (VALUES {bodies}), phrase(t, place, word) AS (VALUES {phrases}),
u AS (SELECT r, unnest(w) AS text, generate_subscripts(w, 1) - 1 AS pos FROM d),
h AS (SELECT r, pos, word FROM u JOIN voc USING (text)),
f AS (SELECT word, CAST(floor(1000 * (ln((SELECT count(*) + 1 FROM d) / (count(DISTINCT r) + 1)) + 1.0) + 0.5) AS BIGINT) AS weight FROM voc LEFT JOIN h USING (word) GROUP BY word),
anchor AS (SELECT t, word FROM phrase JOIN f USING (word) QUALIFY row_number() OVER (PARTITION BY t ORDER BY weight DESC, place) = 1),
cand AS (SELECT DISTINCT r, t FROM h JOIN anchor USING (word)),
votes AS (SELECT r, t, pos - place AS start, sum(weight) AS s FROM cand JOIN body USING (t) JOIN h USING (r, word) JOIN f USING (word) GROUP BY ALL),
total AS (SELECT t, sum(weight) AS all_of FROM body JOIN f USING (word) GROUP BY t),
share AS (SELECT r, t, max(s) / any_value(all_of) AS share FROM votes JOIN total USING (t) GROUP BY r, t),
place AS (SELECT r, t, pos - place AS start FROM phrase JOIN h USING (word) JOIN lab USING (t) GROUP BY r, t, start, n HAVING count(*) = n),
scored AS (SELECT r, max(CASE WHEN (r, t) IN (SELECT (r, t) FROM place) THEN 0.5 ELSE 0.0 END + 0.5 * share) AS score FROM share GROUP BY r),
got AS (
  SELECT r, count(*) FILTER (is_base) AS n_base, min(start) FILTER (is_base) AS first_word, max(start) FILTER (is_base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM place JOIN lab USING (t) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(round(CAST(score AS DOUBLE), 6), 0.0) AS score
FROM d LEFT JOIN got USING (r) LEFT JOIN scored USING (r)
"""


OP4_SQL = _op4_sql()
