"""Name search against comparing every name with every query."""

from datetime import datetime as D

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from candela.operators import search

WORDS = ["acme", "acme2", "steel", "st", "works", "work", "north", "no", "x", "é"]


def grams(text):
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return {f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)}


def brute(entities, queries, threshold=0.3):
    out = set()
    for qid, query, kind, top in queries:
        q = " ".join((query or "").lower().split())
        hits = []
        for eid, own, name in entities:
            if name is None or query is None or kind and kind != own:
                continue
            a, b = grams(name), grams(q)
            score = len(a & b) / len(a | b) if a | b else 0.0
            if score >= threshold or q in name:
                hits.append((-score, name, eid))
        out |= {(qid, eid, name, round(-s, 9), k) for k, (s, name, eid) in enumerate(sorted(hits)[:top], 1)}
    return out


def found(spark, entities, queries):
    e = spark.createDataFrame(entities, "entity_id int, entity_type string, normalized_name string")
    q = spark.createDataFrame(queries, "query_id int, query string, entity_type string, top int")
    return {(r.query_id, r.entity_id, r.normalized_name, round(r.score, 9), r.rank) for r in search.search(e, q).collect()}


ENTITIES = [(k, "PERSON" if k % 3 else "ORGANIZATION", " ".join(WORDS[(k * j) % len(WORDS)] for j in range(1, 2 + k % 4))) for k in range(60)] + [(100, "PERSON", None), (101, None, "100% steel_works"), (102, "PERSON", "")]
QUERIES = [(1, "  Acme  WORKS", None, 5), (2, "st", "PERSON", 50), (3, "e", None, 50), (4, "nothing like it", None, 5), (5, "% s", None, 5), (6, "l_w", None, 5), (7, "   ", None, 4), (8, None, None, 5), (9, "ks no", None, 9), (10, "é", "ORGANIZATION", 9), (11, " ", "ORGANIZATION", 3), (12, "north north", None, 0)]


def test_search_equals_comparing_all(spark):
    assert found(spark, ENTITIES, QUERIES) == brute(ENTITIES, QUERIES)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("abc %")), max_size=9), min_size=5, max_size=20), st.lists(st.text(st.sampled_from(list("abc %")), min_size=1, max_size=7), min_size=4, max_size=8))
def test_search_on_random_texts(spark, names, queries):
    entities = [(k, "PERSON", " ".join(n.split())) for k, n in enumerate(names)]
    asked = [(k, q, None, 50) for k, q in enumerate(queries)]
    assert found(spark, entities, asked) == brute(entities, asked)


@pytest.mark.parametrize(("day", "want"), [(1, {(1, "old name")}), (5, {(1, "new name"), (2, "other name")}), (9, {(1, "new name")})])
def test_search_sees_what_was_known_at_the_cutoff(spark, day, want):
    log = spark.createDataFrame(
        [(1, 1, D(2024, 1, 1), "INSERT", "old name", False), (1, 2, D(2024, 1, 3), "UPDATE", "new name", False), (2, 3, D(2024, 1, 4), "INSERT", "other name", False), (2, 4, D(2024, 1, 8), "DELETE", "other name", False), (3, 5, D(2024, 1, 1), "INSERT", "demo name", True)],
        "entity_id int, version_id int, committed_at timestamp_ntz, operation string, normalized_name string, is_demo boolean",
    ).withColumn("entity_type", F.lit("PERSON"))
    q = spark.createDataFrame([(1, "name", None, 9)], "query_id int, query string, entity_type string, top int")
    got = search.search_as_of(log, q, F.lit(f"2024-01-0{day}").cast("timestamp_ntz")).collect()
    assert {(r.entity_id, r.normalized_name) for r in got} == want
    assert len(search.search_as_of(log, q, F.lit("2024-02-01").cast("timestamp_ntz"), include_demo=True).collect()) == 2


def test_no_query_is_held_against_all_names(spark, capsys):
    index = search.NameIndex(spark.createDataFrame(ENTITIES, "entity_id int, entity_type string, normalized_name string"))
    q = spark.createDataFrame([(1, "acme", ["  a", " ac"])], "query_id int, q string, qg array<string>")
    index.similar(q, 0.3).unionByName(index.containing(q)).explain()
    assert not {"NestedLoop", "Cartesian"} & set(capsys.readouterr().out.replace("Join", " ").split())
